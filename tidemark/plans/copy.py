"""Queries that write titles, descriptions and tags for the clips of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as T
from tidemark.operators import copywriting as C
from tidemark.operators import intervals
from tidemark.plans import sqltext as S
from tidemark.plans.transcript import clips, query
from tidemark.sources import bridge

_HINTS = ("", "Attack on Titan, part two", "THE wild Habitats", "Thing of $5")
_KINDS = ("anime", "podcast", "meme-comedy", "documentary", "film-tv", "other", "gameplay")
_STYLES = ("auto", "viral", "cinematic", "auto", "clean")
#: Openings put before the clips' words by place, so that the headline rules and fillers are met.
_LEADS = ("", "Um, so the biggest mistake I made was ", "I think so the truth is ", "We stayed there because ", "Nobody knew that plan was because ", "When the whole thing fell apart for us, ", "It turns out that ", "Well, here's the ", "NASA and ")


def _inputs(spark, d: str) -> DataFrame:
    """One row a clip with words: its text, the next clip's text, and what the user asked for."""
    segs = bridge.segments(spark, d)
    x = intervals.interval_join(clips(segs), segs.withColumn("text", F.trim("text")), "job_id", "lo", "hi")
    x = intervals.in_order(["job_id", "clip_ix"], "text", ["seg_ix"], " ", "text")(x)
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    job, k = F.col("job_id"), F.col("clip_ix")
    x = x.withColumn("text", F.concat(pick(_LEADS, k + job), "text")).withColumn("local", F.coalesce(F.lead("text").over(Window.partitionBy("job_id").orderBy("clip_ix")), F.lit("")))
    return x.withColumns({"hint": pick(_HINTS, job), "kind": pick(_KINDS, job + k), "style": pick(_STYLES, k), "moment": T.moment_type(F.col("text"))})


def _q(values) -> str:
    return "(" + ", ".join(map(S.q, values)) + ")"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+', 0), lambda w: length(w) >= 4 AND w NOT IN {_q(lx.COPY_STOP)})"


def _score(s: str, first: str, last: str, every: str = "every") -> str:
    """Twenty to a point; first and last: conditions on the place; every: the tokens that topics are counted in."""
    hit = lambda c, p: f"CASE WHEN {c} THEN {p} ELSE 0 END"
    topical = f"coalesce(list_sum(list_transform(list_distinct({_tok(s)}), lambda t: least(3, len(list_filter({every}, lambda u: u = t))))), 0)"
    return " + ".join((
        hit(first, 60), hit(f"contains({s}, '?')", 80), hit(S.any_in(f"lower({s})", lx.COPY_INTEREST), 160), hit(rf"regexp_matches({s}, '\b\d+(?:\.\d+)?%?\b|[$£€]\s?\d')", 60), hit(S.any_in(f"lower({s})", lx.COPY_PAYOFF), 100),
        hit(S.any_in(f"concat(' ', lower({s}), ' ')", lx.COPY_CONTRAST), 60), f"CASE WHEN len({_words(s)}) BETWEEN 6 AND 20 THEN 100 WHEN len({_words(s)}) > 30 THEN -80 ELSE 0 END", hit(last, 20), f"least(140, 11 * {topical})", hit(rf"regexp_matches(rtrim(lower({s}), ' .!?'), '{lx.DANGLING}')", -160),
    ))


def _strip(x: str) -> str:
    step = " ".join(f"WHEN starts_with(lower(a), {S.q(p)}) AND length(a) > {len(p) + 8} THEN ltrim(substr(a, {len(p) + 1}), ' ,.-')" for p in lx.FILLER_STARTS)
    return f"regexp_replace(list_reduce(list_resize([''], 60, ''), lambda a, u: CASE {step} ELSE a END, ltrim({S.clean(x)}, concat(chr(34), '“‘'))), '(?i){lx.OPINION_START}', '')"


def _weak(w: str, weak=lx.WEAK_TAIL) -> str:
    return f"lower(regexp_replace({w}, '[^A-Za-z'']', '', 'g')) IN {_q(weak)}"


def _strong(words: str, least: int, weak=lx.WEAK_TAIL) -> str:
    return f"({words})[1:list_max(list_transform({words}, lambda w, i: CASE WHEN i <= {least} OR NOT {_weak('w', weak)} THEN i ELSE 0 END))]"


def _fitting(words: str, most: str, chars: str) -> str:
    return f"({words})[1:greatest(1, len(list_filter({words}, lambda w, i: i <= {most} AND length(array_to_string(({words})[1:i], ' ')) <= {chars})))]"


def _upper(w: str) -> str:
    return f"concat(replace(upper(left({w}, 1)), 'ẞ', 'SS'), substr({w}, 2))"


def _terminal(x: str) -> str:
    t = f"rtrim({S.clean(x)}, ' ,;:–—')"
    return f"CASE WHEN {t} <> '' AND right({t}, 1) NOT IN ('.', '!', '?', '…') THEN {t} || '.' ELSE {t} END"


def _case(x: str) -> str:
    return _terminal(_upper(S.clean(x)))


def _similar(a: str, b: str) -> str:
    x, y = f"list_distinct({_tok(a)})", f"list_distinct({_tok(b)})"
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE ELSE 0 END"


def _tag(x: str) -> str:
    j = f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+', 0), lambda w: {_upper('w')}), '')"
    return f"CASE WHEN {j} <> '' THEN '#' || left({j}, 36) ELSE '' END"


def _distinct(x: str, most: int) -> str:
    lows = f"list_transform({x}, lambda y: lower(y))"
    return f"list_filter({x}, lambda t, i: t <> '' AND list_position({lows}, lower(t)) = i)[1:{most}]"


def _cut(t: str, chars: str) -> str:
    """A text shortened to chars at a space, without weak words at its end."""
    head = f"left({t}, {chars})"
    words = _words(f"rtrim(CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END, ' ,.!?:;–—')")
    return f"CASE WHEN length({t}) > {chars} THEN array_to_string({_strong(words, 3)}, ' ') ELSE {t} END"


def _most(t: str, most: str) -> str:
    return f"CASE WHEN len({_words(t)}) > {most} THEN rtrim(array_to_string({_strong(f'({_words(t)})[1:{most}]', 3)}, ' '), ' ,.!?:;–—') ELSE {t} END"


def _fragments(name: str, source: str, new: str, most: str, chars: str, keep: str) -> str:
    """Three CTEs after `name`: the column `new` is the fragment of `source`."""
    t = f"trim({S.clean(source)}, ' \"“”')"
    words = _words("_ft")
    fit = f"list_filter(_fe, lambda e: e BETWEEN 28 AND {chars} AND len({_words('left(_ft, e)')}) <= {most})"
    return f""", {name}1 AS (SELECT *, {t} AS _ft FROM {keep}), {name}2 AS (SELECT *, list_filter(list_transform(range(1, length(_ft) + 1), lambda i: CASE WHEN substr(_ft, i, 1) IN (',', ';', ':', '–', '—') THEN i END), lambda i: i IS NOT NULL) AS _fe FROM {name}1),
{name}3 AS (SELECT *, rtrim(left(_ft, coalesce(list_max({fit}), 0)), ' ,;:–—') AS _fc, len({fit}) AS _fn FROM {name}2), {name} AS (SELECT * EXCLUDE (_ft, _fe, _fc, _fn), CASE WHEN len({words}) <= {most} AND length(_ft) <= {chars} THEN _ft WHEN _fn > 0 AND len({_words('_fc')}) >= 5 THEN _fc ELSE coalesce(rtrim(array_to_string({_strong(_fitting(words, most, chars), 4, lx.WEAK_FRAGMENT_TAIL)}, ' '), ' ,;:–—'), '') END AS {new} FROM {name}3)"""


def _pick(values, k: str) -> str:
    return f"{S.listed(values)}[({k}) % {len(values)} + 1]"


def _lookup(table: dict, c: str) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in table.items()) + " ELSE '' END"


def _trusted(x: str) -> str:
    return f"CASE WHEN subject <> '' THEN regexp_replace({S.clean(x)}, '(?i)' || regexp_escape(subject), replace(subject, chr(92), chr(92) || chr(92)), 'g') ELSE {S.clean(x)} END"


def _sql() -> str:
    sents = rf"list_transform(list_filter(string_split(regexp_replace(text, '([.!?…])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: trim(s) <> ''), lambda s: trim(s, concat(' \"“”', chr(9), chr(10), chr(13))))"
    every = f"len({_words('_h')})"
    rules = " ".join(f"WHEN regexp_matches(_h, {S.q('(?i)' + p)}) THEN regexp_replace(_h, {S.q('(?i)' + p)}, {S.q(r)})" for p, r in lx.HEADLINE_RULES)
    group = lambda p: f"regexp_extract(_h, {S.q('(?i)' + p)}, 1)"
    scored = f"list_transform(_p, lambda p, i: {{'score': {_score('p', 'i = 1', 'i = len(_p) AND len(_p) > 1', 'every_h')} + CASE WHEN {S.any_in('lower(p)', lx.COPY_PAYOFF)} THEN 60 ELSE 0 END, 'i': -i, 'p': p}})"
    return S.CLIPS + f""", t0 AS (SELECT c.job_id, clip_ix, string_agg(trim(text), ' ' ORDER BY seg_ix) AS text FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi GROUP BY ALL),
t1 AS (SELECT job_id, clip_ix, concat({_pick(_LEADS, 'clip_ix + job_id')}, text) AS text FROM t0),
t2 AS (SELECT job_id, clip_ix, {S.clean('text')} AS text, {S.clean("coalesce(lead(text) OVER (PARTITION BY job_id ORDER BY clip_ix), '')")} AS local, {_pick(_HINTS, 'job_id')} AS hint, {_pick(_KINDS, 'job_id + clip_ix')} AS kind, {_pick(_STYLES, 'clip_ix')} AS asked, CASE {' '.join(f"WHEN {S.any_in('lower(text)', c)} THEN '{k}'" for k, c in lx.MOMENT_CUES.items())} ELSE 'unknown' END AS moment FROM t1),
t3 AS (SELECT *, CASE WHEN asked = 'auto' AND kind IN ('anime', 'film-tv') THEN 'cinematic' WHEN asked = 'auto' AND kind = 'meme-comedy' THEN 'viral' ELSE asked END AS style, {sents} AS sents, {_tok("concat(text, ' ', local)")} AS every, left(trim(split_part({S.clean('hint')}, ',', 1)), 64) AS subject FROM t2),
t4 AS (SELECT *, list_transform(sents, lambda s, i: {{'score': {_score('s', 'i = 1', 'i = len(sents) AND len(sents) > 1')}, 'i': -i, 's': s}}) AS scored FROM t3),
t5 AS (SELECT *, {_strip('list_reverse_sort(scored)[1].s')} AS core FROM t4), t6 AS (SELECT *, list_distinct({_tok('core')}) AS ct FROM t5),
t7 AS (SELECT *, list_filter(sents, lambda s: lower({S.clean('s')}) <> lower({S.clean('core')}) AND CASE WHEN len(ct) > 0 AND len({_tok('s')}) > 0 THEN len(list_intersect(ct, {_tok('s')})) / least(len(ct), len(list_distinct({_tok('s')})))::DOUBLE < 0.88::DOUBLE ELSE true END) AS cand FROM t6),
t8 AS (SELECT *, CASE WHEN len(sents) < 2 OR len(cand) = 0 THEN '' ELSE {_strip(f"list_reverse_sort(list_transform(cand, lambda s, i: {{'score': {_score('s', 'i = 1', 'i = len(cand) AND len(cand) > 1')}, 'i': i, 's': s}}))[1].s")} END AS support FROM t7),
h0 AS (SELECT *, regexp_replace(trim({_strip('core')}, ' "“”'''), {S.q('(?i)' + lx.HEADLINE_OPENING)}, '') AS _h FROM t8),
h1 AS (SELECT *, trim({S.clean(f"CASE {rules} WHEN len({_words(group(lx.CAUSAL))}) >= 3 THEN trim({group(lx.CAUSAL)}, ' ,.-') WHEN len({_words(group(lx.BECAUSE))}) >= 3 THEN 'Why ' || trim({group(lx.BECAUSE)}, ' ,.-') WHEN len({_words(group(lx.WHEN_CLAUSE))}) BETWEEN 4 AND 10 THEN {group(lx.WHEN_CLAUSE)} ELSE _h END")}, ' ,;:–—') AS _g FROM h0),
h2 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(_g, {S.q('(?i)' + lx.CLAUSE_BREAK)}), lambda p: trim(p, ' ,;:–—')), lambda p: p <> '') AS _p, {_tok("concat(_g, ' ', local)")} AS every_h FROM h1),
h3 AS (SELECT *, CASE WHEN len({_words('_g')}) <= 11 AND length(_g) <= 72 THEN _g ELSE coalesce(list_reverse_sort(list_filter({scored}, lambda r: len({_words('r.p')}) BETWEEN 4 AND 20 AND NOT {_weak(f"{_words('r.p')}[-1]")}))[1].p, _g) END AS headline FROM h2),
n0 AS (SELECT *, trim({S.clean('headline')}, ' .,!?:;–—') AS _t, CASE WHEN style = 'cinematic' THEN 7 ELSE 10 END AS _mw, CASE WHEN style = 'cinematic' THEN 52 ELSE 66 END AS _mc FROM h3),
n1 AS (SELECT * EXCLUDE (_t), CASE WHEN len({_words('_t')}) <= _mw AND length(_t) <= _mc THEN _t ELSE coalesce(rtrim(array_to_string({_strong(_fitting(_words('_t'), '_mw', '_mc'), 3)}, ' '), ' ,.!?:;–—'), '') END AS _n FROM n0),
n2 AS (SELECT *, CASE WHEN (style = 'viral' OR style = 'auto' AND ({S.any_in('lower(core)', lx.COPY_INTEREST)} OR contains(core, '?'))) AND NOT contains(_n, '?') THEN array_to_string(list_transform({_words("rtrim(_n, '.')")}, lambda w, i: CASE WHEN upper(trim(w, '.,!?;:')) = trim(w, '.,!?;:') AND lower(trim(w, '.,!?;:')) <> trim(w, '.,!?;:') AND length(trim(w, '.,!?;:')) <= 5 THEN w WHEN i > 1 AND lower(trim(w, '.,!?;:')) IN {_q(lx.SMALL_WORDS)} THEN lower(w) ELSE {_upper('w')} END), ' ') ELSE {_upper(S.clean('_n'))} END AS _m FROM n1),
n3 AS (SELECT *, 72 - length(subject) - 3 AS _room, trim({S.clean('_m')}, ' .,!?:;–—') AS _x FROM n2), n4 AS (SELECT *, {_most('_x', '8')} AS _y FROM n3),
n5 AS (SELECT *, CASE WHEN subject <> '' AND kind IN ('anime', 'film-tv', 'documentary') AND (regexp_matches(_m, {S.q('(?i)' + lx.VAGUE_START)}) OR len({_words('_m')}) <= 6) AND _room >= 20 AND NOT contains(lower(_m), lower(subject)) THEN concat(subject, ': ', {_cut('_y', '_room')}) ELSE _m END AS _z FROM n4),
n6 AS (SELECT *, coalesce(nullif(rtrim(left({_trusted('_z')}, 78), ' ,;:–—'), ''), 'Strong moment') AS title FROM n5),
d0 AS (SELECT *, {_strip('core')} AS _a, {_strip('support')} AS _b FROM n6), d1 AS (SELECT *, {_similar('_a', 'title')} AS _sa, {_similar('_b', 'title')} AS _sb FROM d0),
d2 AS (SELECT *, support <> '' AND (_sb < _sa OR _sb = _sa AND length(_b) > length(_a)) AS _swap FROM d1), d3 AS (SELECT *, CASE WHEN _swap THEN _b ELSE _a END AS _one, CASE WHEN support = '' THEN '' WHEN _swap THEN _a ELSE _b END AS _two FROM d2)""" + _fragments("e", "_one", "_first", "23", "150", "d3") + _fragments("f", "_two", "_two2", "20", "125", "e") + _fragments("g", "_first", "_f22", "22", "150", "f") + _fragments("k", "_first", "_f18", "18", "120", "g") + f""",
v0 AS (SELECT *, CASE WHEN _two <> '' AND {_similar('_two', '_first')} < 0.78::DOUBLE THEN _two2 ELSE '' END AS _second FROM k), v1 AS (SELECT *, CASE WHEN _second <> '' AND kind IN ('podcast', 'documentary', 'other', 'gameplay') THEN concat({_case('_first')}, ' ', {_case('_second')}) ELSE {_case('_first')} END AS _d FROM v0),
v2 AS (SELECT *, trim({S.clean('_d')}, ' .,!?:;–—') AS _e, CASE WHEN style = 'viral' THEN 36 ELSE 40 END AS _dw FROM v1), v3 AS (SELECT *, {_most('_e', '_dw')} AS _i FROM v2), v4 AS (SELECT *, {_cut('_i', '240')} AS _j FROM v3),
v5 AS (SELECT *, CASE WHEN style = 'cinematic' OR kind IN ('anime', 'film-tv') THEN {_case('_f22')} WHEN kind = 'meme-comedy' THEN {_case('_f18')} ELSE {_terminal('_j')} END AS _k FROM v4), v6 AS (SELECT *, {_trusted('_k')} AS description FROM v5),
w0 AS (SELECT *, {_tok('text')} AS _mine, {_tok('local')} AS _near, {_tok('title')} AS _tt, {_tok('hint')} AS _ht FROM v6),
w1 AS (SELECT *, list_transform(list_reverse_sort(list_transform(list_filter(list_distinct(_mine), lambda t: NOT list_contains(_ht, t) AND NOT regexp_full_match(t, '[0-9]+') AND length(t) >= 5 AND t NOT IN {_q(lx.COPY_INTEREST)} AND t NOT IN {_q(lx.WEAK_TAGS)} AND (len(list_filter(_mine, lambda u: u = t)) >= 2 OR list_contains(_tt, t))), lambda t: {{'score': len(list_filter(_mine, lambda u: u = t)) * 40 + least(2, len(list_filter(_near, lambda u: u = t))) * 9 + CASE WHEN list_contains(_tt, t) THEN 64 ELSE 0 END, 't': t}}))[1:2], lambda s: s.t) AS topics FROM w0),
w2 AS (SELECT *, list_concat([{_tag('subject')}, {_tag(_lookup(lx.CONTENT_TAGS, 'kind'))}, {_tag(_lookup(lx.MOMENT_TAGS, 'moment'))}], list_transform(topics, lambda x: {_tag('x')})) AS _all, list_concat([subject], list_filter(regexp_extract_all(regexp_replace(concat(text, ' ', local), '[À-ɏ]', '_', 'g'), '\\b[A-Z][A-Za-z0-9''’-]{{2,}}\\b', 0), lambda w: lower(w) NOT IN {_q(lx.GENERIC_CAPITALS)})) AS _caps FROM w1),
copy AS (SELECT *, {_distinct('_all', 5)} AS tags, {_distinct("list_filter(_caps, lambda c: c <> '')", 6)} AS grounded FROM w2) """


_COPY = _sql()


def _written(spark, d) -> DataFrame:
    return C.written(_inputs(spark, d))


@query(_COPY + "SELECT job_id, clip_ix, CAST(i - 1 AS INTEGER) AS sent_ix, CAST(scored[i].score AS BIGINT) AS score, scored[i].s AS sentence FROM (SELECT *, unnest(range(1, len(scored) + 1)) AS i FROM t4)")
def scr10_sentence_scores(spark, d):
    """Scores of a clip's sentences, twenty to a point (SCR-10, STR-4)."""
    x = _inputs(spark, d).withColumns({"s": C.sentences(F.col("text")), "every": C.tokens(F.concat_ws(" ", T.clean(F.col("text")), T.clean(F.col("local"))))})
    scored = F.transform("s", lambda s, i: F.struct(C.sentence_score(s, i, F.size("s"), F.col("every")).cast("long").alias("score"), s.alias("sentence")))
    return x.select("job_id", "clip_ix", F.posexplode(scored).alias("sent_ix", "x")).select("job_id", "clip_ix", "sent_ix", "x.*")


@query(_COPY + "SELECT job_id, clip_ix, core, support FROM t8")
def srt6_core_support(spark, d):
    """The core and the supporting sentence of each clip (SRT-6, STR-8)."""
    return _written(spark, d).select("job_id", "clip_ix", "core", "support")


@query(_COPY + "SELECT job_id, clip_ix, headline, title FROM copy")
def str13_titles(spark, d):
    """Headlines by the rewrite rules and titles (STR-9, 11, 12, 13, 15, 16)."""
    return _written(spark, d).select("job_id", "clip_ix", "headline", "title")


@query(_COPY + "SELECT job_id, clip_ix, description FROM copy")
def str14_descriptions(spark, d):
    """Descriptions by content type, shortened at clause edges (STR-10, 14)."""
    return _written(spark, d).select("job_id", "clip_ix", "description")


@query(_COPY + "SELECT job_id, clip_ix, array_to_string(tags, ' ') AS tags, array_to_string(topics, ' ') AS topics FROM copy")
def set3_hashtags(spark, d):
    """Distinct hashtags, and the topics among them (SET-3, STR-17, AGG-7, AGG-8)."""
    x = _written(spark, d)
    topics = C.specific_topics(F.col("text"), F.col("local"), F.coalesce("hint", F.lit("")), F.col("title"))
    return x.select("job_id", "clip_ix", F.array_join("tags", " ").alias("tags"), F.array_join(topics, " ").alias("topics"))


@query(_COPY + "SELECT job_id, clip_ix, array_to_string(grounded, '|') AS grounded FROM copy")
def str18_grounded_terms(spark, d):
    return _written(spark, d).select("job_id", "clip_ix", F.array_join("grounded", "|").alias("grounded"))


@query(_COPY + "SELECT job_id, clip_ix, title, description, array_to_string(tags, ' ') AS tags, CASE WHEN len(tags) > 0 THEN trim(concat(description, chr(10), chr(10), array_to_string(tags, ' '))) ELSE description END AS social FROM copy")
def scr11_copy(spark, d):
    """The whole copy of each clip (SCR-11, STR-19)."""
    return _written(spark, d).select("job_id", "clip_ix", "title", "description", F.array_join("tags", " ").alias("tags"), "social")
