"""Queries over styled captions: rebalanced phrases, the style dimension, highlighted events, caption documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.operators import captions, intervals
from tidemark.operators import styled_captions as styled
from tidemark.plans import sqltext as S
from tidemark.plans.analytics import _wrap_sql
from tidemark.plans.transcript import clips, query
from tidemark.sources import bridge

KEY = ["job_id", "clip_ix"]
#: Captions come this much later than the words, in hundredths of a second.
OFFSET = 12
_CHOICES = {
    "style": ("job_id", ("viral", "cinematic", "clean", "meme", " Cinematic ", "bogus")), "content_type": ("clip_ix + job_id // 6", ("auto", "anime", "film-tv", "documentary", "meme-comedy", "odd")),
    "layout": ("clip_ix", ("fill", "focus", "backdrop", "preserve")), "frame_size": ("job_id", ("auto", "compact", "balanced", "immersive", "compact")), "zone": ("clip_ix + job_id", ("auto", "upper", "middle", "lower", " LOWER ")),
    "platform": ("job_id // 2", ("auto", "tiktok", "shorts", "reels")), "source_width": ("job_id", (1920, 1280, 721, 0)), "source_height": ("job_id", (1080, 720, 1280, 0)),
}


def _clips(segs: DataFrame) -> DataFrame:
    """Clips with the user's choices by place."""
    pick = lambda by, of: F.element_at(F.array(*map(F.lit, of)), (F.expr(by.replace("//", "div")) % len(of) + 1).cast("int"))
    return styled.dressed(clips(segs).select("*", *[pick(*v).alias(k) for k, v in _CHOICES.items()]))


def _words(segs: DataFrame, dressed: DataFrame) -> DataFrame:
    """The words of clips, later by OFFSET, without bad tokens; every sixth job has no words."""
    held = intervals.bucketed_interval_join(dressed.select(*KEY, "lo", "hi"), segs.where("job_id % 6 <> 5"), "job_id", "lo", "hi", 6000).select(*KEY, "lo", "hi", "seg_ix")
    x = held.join(bridge.words(segs), ["job_id", "seg_ix"]).where("least(end_cs, hi) > greatest(start_cs, lo)")
    x = x.withColumns({"rel_start": F.greatest(F.lit(0), F.greatest("start_cs", "lo") - F.col("lo") + OFFSET), "rel_end": F.least(F.col("hi") - F.col("lo"), F.least("end_cs", "hi") - F.col("lo") + OFFSET)}).where("rel_end > rel_start + 1")
    plain = F.regexp_replace("word", "[^A-Za-z0-9']", "")
    bad = (plain != "") & ((F.col("pct") < 5) & (F.length(plain) <= 2) | (F.col("pct") < 16) & F.lower(plain).isin(*lx.CAPTION_FILLERS))
    return x.where(~bad).select(*KEY, "seg_ix", "word_ix", "rel_start", "rel_end", "word").join(dressed.drop("lo", "hi"), KEY)


_DIMENSION = ", ".join(
    "(" + ", ".join(S.q(v) if isinstance(v, str) else str(v) for v in row) + ")"
    for row in ((s, c, *(dict(zip(("font", "size", "colour", "spoken", "outline", "shadow", "max_words", "max_chars", "max_cs", "pause_cs"), (*look, *lx.CAPTION_STYLES[s][:2], *(round(100 * v) for v in lx.CAPTION_STYLES[s][2:])), strict=True)) | styled.OVERRIDES.get((c, s), {})).values()) for s, look in styled.LOOKS.items() for c in lx.CONTENT_TYPES)
)
_BASE = S.CLIPS.replace("WITH x", "WITH RECURSIVE x") + f""", chosen AS (SELECT *, {', '.join(f"{S.listed(of) if isinstance(of[0], str) else list(of)}[CAST(({by}) % {len(of)} + 1 AS INTEGER)] AS {k}_" for k, (by, of) in _CHOICES.items())} FROM clips),
known AS (SELECT job_id, clip_ix, lo, hi, CASE WHEN lower(trim(style_)) IN ({', '.join(map(S.q, styled.LOOKS))}) THEN lower(trim(style_)) ELSE 'clean' END AS style, CASE WHEN lower(trim(content_type_)) IN ({', '.join(map(S.q, lx.CONTENT_TYPES))}) THEN lower(trim(content_type_)) ELSE 'auto' END AS content_type, layout_ AS layout, frame_size_ AS frame_size, lower(trim(zone_)) AS zone, platform_ AS platform, source_width_ AS sw, source_height_ AS sh FROM chosen),
dim(style, content_type, font, size, colour, spoken, outline, shadow, mw, mc, md, mp) AS (VALUES {_DIMENSION}),
dressed AS (SELECT * FROM known JOIN dim USING (style, content_type))"""
_JOINED = r"""regexp_replace(regexp_replace(array_to_string({}, ' '), ' ([,.;:!?%)}}\]])', '\1', 'g'), '([''’\-—(]) ', '\1', 'g')""".format
_OF = "list_transform({}, lambda z: z.w)".format
_WEAK = "lower(regexp_replace({}, '[^A-Za-z'']', '', 'g')) IN (" + ", ".join(map(S.q, lx.WEAK_EDGES)) + ")"
_PHRASES = _BASE + rf""", cut AS (SELECT c.job_id, clip_ix, w.seg_ix, word_ix, greatest(0, greatest(w.start_cs, lo) - lo + {OFFSET}) AS a, least(hi - lo, least(w.end_cs, hi) - lo + {OFFSET}) AS b, word, pct, regexp_replace(word, '[^A-Za-z0-9'']', '', 'g') AS plain FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi JOIN words w ON w.job_id = s.job_id AND w.seg_ix = s.seg_ix WHERE least(w.end_cs, hi) > greatest(w.start_cs, lo) AND c.job_id % 6 <> 5),
cw AS (SELECT * FROM cut WHERE b > a + 1 AND NOT (plain <> '' AND (pct < 5 AND length(plain) <= 2 OR pct < 16 AND lower(plain) IN ({', '.join(map(S.q, lx.CAPTION_FILLERS))})))),
o AS (SELECT cw.*, mw, mc, md, mp, row_number() OVER (PARTITION BY job_id, clip_ix ORDER BY a, b, seg_ix, word_ix) AS k FROM cw JOIN dressed USING (job_id, clip_ix)), r AS (SELECT job_id, clip_ix, k, 0 AS phrase, 1 AS n, length(word) AS chars, a AS first, b AS last, word AS prev FROM o WHERE k = 1 UNION ALL
SELECT job_id, clip_ix, k, phrase + nw::INT, CASE WHEN nw THEN 1 ELSE n + 1 END, CASE WHEN nw THEN length(word) ELSE ch END, CASE WHEN nw THEN a ELSE first END, b, word FROM (SELECT *, a - last > mp OR regexp_matches(prev, '[.!?]["'')\]]?$') OR (regexp_matches(prev, '[,;:]["'')\]]?$') AND a - last > 20 AND n >= 3) OR n + 1 > mw OR ch > mc OR b - first > md AS nw FROM
(SELECT r.job_id, r.clip_ix, o.k, r.phrase, r.n, r.first, r.last, r.prev, o.a, o.b, o.word, mw, mc, md, mp, r.chars + length(o.word) + CASE WHEN regexp_matches(o.word, '^[,.;:!?%)}}\]]') OR regexp_matches(r.prev, '[''’\-—(]$') THEN 0 ELSE 1 END AS ch FROM r JOIN o ON o.job_id = r.job_id AND o.clip_ix = r.clip_ix AND o.k = r.k + 1))),
ph AS (SELECT job_id, clip_ix, phrase AS p, list({{'a': a, 'b': b, 'w': word}} ORDER BY k) AS ws, any_value(mw) AS mw, any_value(mc) AS mc FROM r JOIN o USING (job_id, clip_ix, k) GROUP BY job_id, clip_ix, phrase),
rb AS (SELECT job_id, clip_ix, p, ws AS cur, NULL::STRUCT(a BIGINT, b BIGINT, w VARCHAR)[] AS before FROM ph WHERE p = 0 UNION ALL
SELECT job_id, clip_ix, p, CASE WHEN mv THEN list_concat([cur[-1]], ws) ELSE ws END, CASE WHEN mv THEN cur[1:len(cur) - 1] ELSE cur END FROM (SELECT rb.job_id, rb.clip_ix, ph.p, rb.cur, ph.ws, len(cur) >= 2 AND {_WEAK.format('cur[-1].w')} AND len(ws) + 1 <= mw AND length({_JOINED(_OF('list_concat([cur[-1]], ws)'))}) <= mc AS mv FROM rb JOIN ph ON ph.job_id = rb.job_id AND ph.clip_ix = rb.clip_ix AND ph.p = rb.p + 1)),
fin AS (SELECT rb.job_id, rb.clip_ix, rb.p, coalesce(lead(before) OVER v, cur) AS ws, max(rb.p) OVER (PARTITION BY rb.job_id, rb.clip_ix) AS m, mw, mc FROM rb JOIN ph USING (job_id, clip_ix, p) WINDOW v AS (PARTITION BY rb.job_id, rb.clip_ix ORDER BY rb.p)),
tails AS (SELECT a.job_id, a.clip_ix, b.ws AS last, len(b.ws) <= 2 AND len(a.ws) + len(b.ws) <= a.mw + 2 AND length({_JOINED(_OF('list_concat(a.ws, b.ws)'))}) <= a.mc + 8 AS merges FROM fin a JOIN fin b ON a.job_id = b.job_id AND a.clip_ix = b.clip_ix AND a.p + 1 = b.p AND b.p = b.m),
reb AS (SELECT f.job_id, f.clip_ix, row_number() OVER (PARTITION BY f.job_id, f.clip_ix ORDER BY p) - 1 AS q, CASE WHEN p = m - 1 AND coalesce(merges, false) THEN list_concat(ws, last) ELSE ws END AS ws FROM fin f LEFT JOIN tails USING (job_id, clip_ix) WHERE NOT (p = m AND coalesce(merges, false)) AND len(ws) > 0)"""


@query(_PHRASES + f" SELECT job_id, clip_ix, CAST(q AS INTEGER) AS phrase, CAST(len(ws) AS INTEGER) AS n, ws[1].a AS start_cs, ws[-1].b AS end_cs, {_JOINED(_OF('ws'))} AS text FROM reb")
def seq2_rebalanced(spark, d):
    """Caption phrases of every style without dangling connectives and tiny last ones (SEQ-2)."""
    segs = bridge.segments(spark, d)
    w = _words(segs, _clips(segs))
    x = captions.phrase_lists(w, [*KEY, "max_words", "max_chars", "max_cs", "pause_cs"]).withColumn("phrases", captions.rebalanced(F.col("phrases"), F.col("max_words"), F.col("max_chars")))
    x = x.select(*KEY, F.posexplode("phrases").alias("phrase", "ws"))
    return x.select(*KEY, "phrase", F.size("ws").alias("n"), F.element_at("ws", 1)["rel_start"].alias("start_cs"), F.element_at("ws", -1)["rel_end"].alias("end_cs"), captions.joined(F.transform("ws", lambda w: w["word"])).alias("text"))


@query(_BASE + " SELECT job_id, clip_ix, style, content_type, font, size, colour, spoken, outline, shadow, mw AS max_words, mc AS max_chars, md AS max_cs, mp AS pause_cs FROM dressed")
def mth9_caption_styles(spark, d):
    """The look and density of each clip's captions, with what its content type changes (MTH-9)."""
    return _clips(bridge.segments(spark, d)).select(*KEY, "style", "content_type", "font", "size", "colour", "spoken", "outline", "shadow", "max_words", "max_chars", "max_cs", "pause_cs")


_ESC = r"replace(replace(replace(replace({}, '\', '\\'), '{{', '\{{'), '}}', '\}}'), chr(10), '\N')".format
_PLAIN = "lower(regexp_replace({}, '[^A-Za-z0-9'']+', '', 'g'))".format
_IN = lambda x, of: f"{x} IN ({', '.join(map(S.q, of))})"


def _balanced(rows: str) -> str:
    """rows(..., x, cap) with `text`, in two lines where that is called for."""
    a, b = "array_to_string(w[1:k], ' ')", "array_to_string(w[k + 1:], ' ')"
    score = f"abs(length({a}) - length({b})) + CASE WHEN {_IN(_PLAIN('w[k]'), lx.WEAK_EDGES)} THEN 24 ELSE 0 END + CASE WHEN {_IN(_PLAIN('w[k + 1]'), lx.WEAK_SECOND_LINES)} THEN 18 ELSE 0 END - CASE WHEN right(w[k], 1) IN (',', ';', ':') THEN 8 ELSE 0 END - CASE WHEN {_IN(_PLAIN('w[k + 1]'), lx.GOOD_SECOND_LINES)} THEN 4 ELSE 0 END"
    cuts = f"list_sort(list_filter(list_transform(range(3, len(w) - 2), lambda k: {{'score': {score}, 'k': k, 't': {a} || chr(10) || {b}, 'ok': length({a}) <= cap AND length({b}) <= cap}}), lambda z: z.ok))[1].t"
    return f"SELECT *, CASE WHEN len(w) < 7 OR length(x) < 30 THEN x ELSE coalesce({cuts}, x) END AS text FROM (SELECT *, string_split(x, ' ') AS w FROM {rows})"


_CAP = "greatest(20, least(32, CAST(floor(mc * 0.68::DOUBLE) AS INTEGER))) + 5"
_EVENTS = _PHRASES + rf""", loud AS (SELECT r.job_id, r.clip_ix, q, i, ws[i].a AS start_cs, greatest(coalesce(ws[i + 1].a, ws[i].b), ws[i].a + 5) AS end_cs, array_to_string(list_transform(shown, lambda z, j: CASE WHEN j = i THEN '{{\c' || spoken || '{styled.SPOKEN[0]}' || z || '{{\c' || colour || '{styled.SPOKEN[1]}' ELSE z END), ' ') AS text
  FROM (SELECT reb.*, spoken, colour, unnest(range(1, len(ws) + 1)) AS i, list_transform(ws, lambda z: {_ESC("CASE WHEN style = 'meme' THEN replace(upper(z.w), 'ẞ', 'SS') ELSE z.w END")}) AS shown FROM reb JOIN dressed USING (job_id, clip_ix) WHERE {_IN('style', styled.HIGHLIGHTED)}) r),
calm0 AS (SELECT reb.job_id, reb.clip_ix, q, ws[1].a AS start_cs, greatest(ws[-1].b, ws[1].a + 5) AS end_cs, {_JOINED(_OF('ws'))} AS x, {_CAP} AS cap FROM reb JOIN dressed USING (job_id, clip_ix) WHERE NOT {_IN('style', styled.HIGHLIGHTED)}), calm AS ({_balanced('calm0')}),
made AS (SELECT job_id, clip_ix, q AS i1, i AS i2, start_cs, end_cs, text, false AS moves FROM loud UNION ALL SELECT job_id, clip_ix, q, 0, start_cs, end_cs, {_ESC('text')}, true FROM calm)"""


@query(_EVENTS + " SELECT job_id, clip_ix, CAST(row_number() OVER (PARTITION BY job_id, clip_ix ORDER BY i1, i2) - 1 AS INTEGER) AS ix, start_cs, end_cs, text, moves FROM made")
def str24_highlights(spark, d):
    """Caption events: one a word with the spoken word set off, or one a phrase in balanced lines (STR-24, STR-22)."""
    segs = bridge.segments(spark, d)
    return styled.events(_words(segs, _clips(segs)), KEY).withColumn("ix", F.col("ix.seg_ix"))


_WINDOW = "CASE WHEN layout IN ('focus', 'backdrop') THEN CASE frame_size WHEN 'compact' THEN {{'w': 720, 'h': 800}} WHEN 'immersive' THEN {{'w': 720, 'h': 1040}} ELSE {{'w': 720, 'h': 900}} END WHEN layout = 'preserve' AND sw > 0 AND sh > 0 THEN {{'w': greatest(1, least(720, CAST(round_even(sw * least(720::DOUBLE / sw, 1280::DOUBLE / sh), 0) AS INTEGER))), 'h': greatest(1, least(1280, CAST(round_even(sh * least(720::DOUBLE / sw, 1280::DOUBLE / sh), 0) AS INTEGER)))}} ELSE {{'w': 720, 'h': 1280}} END".replace("{{", "{").replace("}}", "}")
_DOCUMENTS = _EVENTS + rf""", less AS (SELECT * FROM dressed WHERE (job_id, clip_ix) NOT IN (SELECT (job_id, clip_ix) FROM made)),
h AS (SELECT c.*, seg_ix, greatest(0::DOUBLE, greatest(start_cs, lo) / 100::DOUBLE - lo / 100::DOUBLE + {OFFSET / 100}::DOUBLE) AS a, least(30::DOUBLE, least(end_cs, hi) / 100::DOUBLE - lo / 100::DOUBLE + {OFFSET / 100}::DOUBLE) AS b, string_split({_wrap_sql('text', 'mw', 'mc')}, chr(10)) AS l FROM less c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi),
k1 AS (SELECT *, greatest(b - a, 0.2::DOUBLE) / len(l) AS step, unnest(range(0, len(l))) AS i FROM h WHERE b > a), c1 AS (SELECT *, a + i * step AS s1, least(a + (i + 1) * step, 30::DOUBLE) AS s2, l[i + 1] AS x, {_CAP} AS cap FROM k1),
c2 AS ({_balanced('(SELECT * FROM c1 WHERE s2 > s1 + 0.03::DOUBLE)')}),
back AS (SELECT job_id, clip_ix, seg_ix AS i1, i AS i2, CAST(round_even(s1 * 100, 0) AS BIGINT) AS start_cs, CAST(round_even(greatest(s2, s1 + 0.05::DOUBLE) * 100, 0) AS BIGINT) AS end_cs, {_ESC("CASE WHEN style = 'meme' THEN replace(upper(x), 'ẞ', 'SS') WHEN style IN ('cinematic', 'clean') THEN text ELSE x END")} AS text, true AS moves FROM c2),
every AS (SELECT * FROM made UNION ALL SELECT * FROM back UNION ALL SELECT job_id, clip_ix, 0, 0, 0, 100, ' ', true FROM less WHERE (job_id, clip_ix) NOT IN (SELECT (job_id, clip_ix) FROM back)),
z AS (SELECT *, {_WINDOW} AS win, CASE WHEN zone IN ('upper', 'middle', 'lower') THEN zone WHEN {_IN('style', styled.HIGHLIGHTED)} THEN 'middle' ELSE 'lower' END AS zn FROM dressed),
rt AS (SELECT *, CASE WHEN content_type = 'anime' AND style = 'cinematic' AND zn = 'lower' AND layout = 'focus' THEN 0.88::DOUBLE WHEN zn = 'upper' THEN 0.34::DOUBLE WHEN zn = 'middle' THEN 0.61::DOUBLE ELSE least(0.85::DOUBLE, CASE platform WHEN 'tiktok' THEN 0.77::DOUBLE WHEN 'shorts' THEN 0.79::DOUBLE WHEN 'reels' THEN 0.80::DOUBLE ELSE 1.0::DOUBLE END) END AS ratio FROM z),
po AS (SELECT *, CASE WHEN layout = 'fill' THEN 360 ELSE CAST(floor((720 - win.w) // 2 + win.w / 2.0::DOUBLE) AS INTEGER) END AS px, CASE WHEN layout = 'fill' THEN CAST(floor(1280 * ratio) AS INTEGER) ELSE CAST(floor((1280 - win.h) // 2 + win.h * ratio) AS INTEGER) END AS py, CASE style {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in styled.FADES.items())} END AS fade FROM rt),
li AS (SELECT job_id, clip_ix, count(*) AS n, string_agg('Dialogue: 0,' || {{st('start_cs')}} || ',' || {{st('end_cs')}} || ',Default,,0,0,0,,{{{{\an2\pos(' || px || ',' || py || ')' || CASE WHEN moves THEN fade ELSE '' END || '}}}}' || text, chr(10) ORDER BY i1, i2) AS lines FROM every JOIN po USING (job_id, clip_ix) GROUP BY job_id, clip_ix)
SELECT job_id, clip_ix, CAST(n AS INTEGER) AS n_events, chr(65279) || '{{head}}' || 'Style: Default,' || font || ',' || size || ',' || colour || ',&H000000FF,&H00000000,&H78000000,-1,0,0,0,100,100,0,0,1,' || outline || ',' || shadow || ',2,28,28,20,1' || '{{foot}}' || chr(10) || lines || chr(10) AS document FROM li JOIN po USING (job_id, clip_ix)"""
_STAMP = "printf('%d:%02d:%02d.%02d', {0} // 360000, {0} % 360000 // 6000, {0} % 6000 // 100, {0} % 100)".format
_HEAD, _FOOT = styled.HEADER.format(width=720, height=1280, style="\x00").split("\x00")
_DOCUMENTS = _DOCUMENTS.replace("{st('start_cs')}", _STAMP("start_cs")).replace("{st('end_cs')}", _STAMP("end_cs")).replace("{head}", _HEAD).replace("{foot}", _FOOT).replace("{{\\an2", "{\\an2").replace("|| '}}' ||", "|| '}' ||")


@query(_DOCUMENTS)
def snk5_caption_documents(spark, d):
    """The styled caption document of every clip; clips without words show their segments' lines (SNK-5)."""
    segs = bridge.segments(spark, d)
    dressed = _clips(segs)
    words = _words(segs, dressed)
    spoken = styled.events(words, KEY)
    sec = lambda c: F.col(c) / 100
    less = dressed.join(words.select(*KEY).distinct(), KEY, "left_anti").withColumns({"lo": sec("lo"), "hi": sec("hi")})
    held = intervals.bucketed_interval_join(dressed.select(*KEY, "lo", "hi"), segs, "job_id", "lo", "hi", 6000).select(*KEY, "seg_ix", sec("start_cs").alias("start"), sec("end_cs").alias("end"), "text")
    return styled.documents(dressed, spoken.unionByName(styled.fallback_events(less, held, KEY, OFFSET / 100)), KEY)
