"""Titles, descriptions and tags of clips, written from their own words; all in Columns.

Scores are whole numbers, twenty to a point, so that ties are ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions.text import NUMBER, clean

_MARKS = " ,;:–—"
_QUOTES = " \t\n\r\"“”"


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once."""
    return F.transform(F.array(value), f)[0]


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether c holds one of plain phrases; one expression, whatever their number."""
    return c.rlike("|".join(phrases))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*lx.COPY_STOP))


def sentences(c: Column) -> Column:
    return F.transform(F.filter(F.split(clean(c), r"(?<=[.!?…])\s+"), lambda s: F.trim(s) != ""), lambda s: F.btrim(s, F.lit(_QUOTES)))


def strip_fillers(c: Column) -> Column:
    """Without filler openings, however many, as long as over eight characters stay, and without one opening of opinion."""
    fillers = "(?is)^(?:(?:" + "|".join(lx.FILLER_STARTS) + ")(?=.{9})[ ,.-]*+)*+"
    start = F.ltrim(clean(c), F.lit('"“‘'))
    return F.regexp_replace(F.regexp_replace(start, fillers, ""), "(?i)" + lx.OPINION_START, "")


def sentence_score(s: Column, i: Column, total: Column, every: Column) -> Column:
    """every: the topic tokens of the clip and its surroundings."""
    low, n = F.lower(s), F.size(split_words(s))
    points = lambda hit, p: F.when(hit, p).otherwise(0)
    topical = F.aggregate(F.array_distinct(tokens(s)), F.lit(0), lambda a, t: a + F.least(F.lit(3), F.size(F.filter(every, lambda u: u == t))))
    return (
        points(i == 0, 60) + points(F.contains(s, F.lit("?")), 80) + points(_any(low, lx.COPY_INTEREST), 160) + points(s.rlike(NUMBER), 60) + points(_any(low, lx.COPY_PAYOFF), 100)
        + points(_any(F.concat(F.lit(" "), low, F.lit(" ")), lx.COPY_CONTRAST), 60) + F.when(n.between(6, 20), 100).when(n > 30, -80).otherwise(0) + points((i == total - 1) & (total > 1), 20)
        + F.least(F.lit(140), topical * 11) - points(F.rtrim(low, F.lit(" .!?")).rlike(lx.DANGLING), 160)
    )


def _best(list_: Column, every: Column, sign: int) -> Column:
    """The sentence of the highest score; ties: the first (-1) or the last (1)."""
    ranked = F.transform(list_, lambda s, i: F.struct(sentence_score(s, i, F.size(list_), every).alias("score"), (i * sign).alias("i"), s.alias("s")))
    return F.array_max(ranked)["s"]


def core_sentence(text: Column, list_: Column, every: Column) -> Column:
    return strip_fillers(F.when(F.size(list_) > 0, _best(list_, every, -1)).otherwise(text))


def supporting_sentence(list_: Column, core: Column, every: Column) -> Column:
    """The best other sentence that isn't made of the core's words; empty: none."""
    mine = F.array_distinct(tokens(core))

    def other(s: Column) -> Column:
        theirs = F.array_distinct(tokens(s))
        least = F.least(F.size(mine), F.size(theirs))
        return (F.lower(clean(s)) != F.lower(clean(core))) & F.when(least > 0, F.size(F.array_intersect(mine, theirs)) / least < 0.88).otherwise(True)

    found = F.filter(list_, other)
    return F.when((F.size(list_) < 2) | (F.size(found) == 0), "").otherwise(strip_fillers(_best(found, every, 1)))


def _strong(words: Column, least: int, weak: tuple[str, ...]) -> Column:
    """words without weak ones at their end; `least` words stay."""
    last = lambda ws: F.array_max(F.transform(ws, lambda w, i: F.when((i < least) | ~F.lower(F.regexp_replace(w, "[^A-Za-z']", "")).isin(*weak), i + 1).otherwise(0)))
    return _let(words, lambda ws: F.slice(ws, F.lit(1), F.coalesce(last(ws), F.lit(0))))


def _fitting(words: Column, most: int | Column, chars: int | Column) -> Column:
    """The longest beginning of words within both limits; one word at least."""
    fits = lambda w: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w))), lambda i: (i <= most) & (F.length(F.array_join(F.slice(w, F.lit(1), i), " ")) <= chars)))
    return _let(words, lambda w: F.slice(w, F.lit(1), F.greatest(F.lit(1), fits(w))))


def truncate_words(c: Column, most: int, chars: int | Column) -> Column:
    chars = F.lit(chars) if isinstance(chars, int) else chars
    x = F.btrim(clean(c), F.lit(" .,!?:;–—"))
    x = _let(x, lambda t: F.when(F.size(split_words(t)) > most, F.rtrim(F.array_join(_strong(F.slice(split_words(t), 1, most), 3, lx.WEAK_TAIL), " "), F.lit(" ,.!?:;–—"))).otherwise(t))
    head = lambda t: F.left(t, chars)
    cut = lambda t: _let(split_words(F.rtrim(F.when(F.contains(head(t), F.lit(" ")), F.regexp_replace(head(t), " [^ ]*$", "")).otherwise(head(t)), F.lit(" ,.!?:;–—"))), lambda w: F.array_join(_strong(w, 3, lx.WEAK_TAIL), " "))
    return _let(x, lambda t: F.when(F.length(t) > chars, cut(t)).otherwise(t))


def truncate_title(c: Column, most: Column, chars: Column) -> Column:
    x = F.btrim(clean(c), F.lit(" .,!?:;–—"))
    return _let(x, lambda t: F.when((F.size(split_words(t)) <= most) & (F.length(t) <= chars), t).otherwise(F.rtrim(F.array_join(_strong(_fitting(split_words(t), most, chars), 3, lx.WEAK_TAIL), " "), F.lit(" ,.!?:;–—"))))


def fragment(c: Column, most: int, chars: int) -> Column:
    """A sentence shortened at the edge of a clause where one fits, else between words."""

    def short(t: Column) -> Column:
        # ends of clauses, by the lengths of the pieces between marks
        pieces = F.split(t, "[,;:–—]")
        ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.length(F.array_join(F.slice(pieces, F.lit(1), k), " ")) + 1)
        fit = F.filter(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: e.between(28, chars) & (F.size(split_words(F.left(t, e))) <= most))
        cut = F.rtrim(F.left(t, F.coalesce(F.array_max(fit), F.lit(0))), F.lit(_MARKS))
        words = F.rtrim(F.array_join(_strong(_fitting(split_words(t), most, chars), 4, lx.WEAK_FRAGMENT_TAIL), " "), F.lit(_MARKS))
        return F.when((F.size(fit) > 0) & (F.size(split_words(cut)) >= 5), cut).otherwise(words)

    return _let(F.btrim(clean(c), F.lit(' "“”')), lambda t: F.when((F.size(split_words(t)) <= most) & (F.length(t) <= chars), t).otherwise(short(t)))


def headline(core: Column) -> Column:
    """core: a sentence without filler openings."""
    x = F.regexp_replace(F.btrim(core, F.lit(" \"“”'")), "(?i)" + lx.HEADLINE_OPENING, "")

    def rewritten(h: Column) -> Column:
        i = lambda p: "(?i)" + p
        cause, topic, when = F.regexp_extract(h, i(lx.CAUSAL), 1), F.regexp_extract(h, i(lx.BECAUSE), 1), F.regexp_extract(h, i(lx.WHEN_CLAUSE), 1)
        out = F.when(F.size(split_words(cause)) >= 3, F.btrim(cause, F.lit(" ,.-"))).when(F.size(split_words(topic)) >= 3, F.concat(F.lit("Why "), F.btrim(topic, F.lit(" ,.-")))).when(F.size(split_words(when)).between(4, 10), when).otherwise(h)
        for pattern, text in reversed(lx.HEADLINE_RULES):
            out = F.when(h.rlike(i(pattern)), F.regexp_replace(h, i(pattern), text)).otherwise(out)
        return out

    return _let(x, rewritten)


def compressed(head: Column, every: Column) -> Column:
    """A whole clause of a long headline, by the score of its words; every: tokens of the headline and of what surrounds the clip."""

    def clause(t: Column) -> Column:
        pieces = F.filter(F.transform(F.split(t, "(?i)" + lx.CLAUSE_BREAK), lambda p: F.btrim(p, F.lit(_MARKS))), lambda p: p != "")
        scored = F.transform(pieces, lambda p, i: F.struct((sentence_score(p, i, F.size(pieces), every) + F.when(_any(F.lower(p), lx.COPY_PAYOFF), 60).otherwise(0)).alias("score"), (-i).alias("i"), p.alias("p")))
        fit = F.filter(scored, lambda r: F.size(split_words(r["p"])).between(4, 20) & ~F.lower(F.regexp_replace(F.element_at(split_words(r["p"]), -1), "[^A-Za-z']", "")).isin(*lx.WEAK_TAIL))
        return F.coalesce(F.array_max(fit)["p"], t)

    return _let(F.btrim(clean(head), F.lit(_MARKS)), lambda t: F.when((F.size(split_words(t)) <= 11) & (F.length(t) <= 72), t).otherwise(clause(t)))


def _upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def sentence_case(c: Column) -> Column:
    return _let(clean(c), _upper_first)


def title_case(c: Column) -> Column:
    """Capitals on all words but small ones; short words in capitals stay."""

    def one(w: Column, i: Column) -> Column:
        plain = F.btrim(w, F.lit(".,!?;:"))
        acronym = (F.upper(plain) == plain) & (F.lower(plain) != plain) & (F.length(plain) <= 5)
        return F.when(acronym, w).when((i > 0) & F.lower(plain).isin(*lx.SMALL_WORDS), F.lower(w)).otherwise(_upper_first(w))

    return F.array_join(F.transform(split_words(c), one), " ")


def terminal(c: Column) -> Column:
    return _let(F.rtrim(clean(c), F.lit(_MARKS)), lambda x: F.when((x != "") & ~F.right(x, F.lit(1)).isin(".", "!", "?", "…"), F.concat(x, F.lit("."))).otherwise(x))


def subject_label(hint: Column) -> Column:
    return F.left(F.trim(F.split_part(clean(F.coalesce(hint, F.lit(""))), F.lit(","), F.lit(1))), F.lit(64))


def trusted_case(c: Column, subject: Column) -> Column:
    """The subject as the user writes it, wherever it stands in c."""
    return F.when(subject != "", F.regexp_replace(clean(c), F.concat(F.lit(r"(?i)\Q"), subject, F.lit(r"\E")), F.regexp_replace(subject, r"([\\$])", r"\\$1"))).otherwise(clean(c))


def similarity(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def hashtag(c: Column) -> Column:
    joined = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), _upper_first), "")
    return F.when(joined != "", F.concat(F.lit("#"), F.left(joined, F.lit(36)))).otherwise("")


def _distinct(list_: Column, most: int) -> Column:
    """The first of each, in any case of letters, at most so many."""
    fold = lambda out, t: F.when((t == "") | F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.concat(out, F.array(t)))
    return F.slice(F.aggregate(list_, F.expr("cast(array() as array<string>)"), fold), 1, most)


def specific_topics(text: Column, local: Column, hint: Column, title: Column) -> Column:
    """The two topic words of the highest score; ties: the later word."""
    mine, near = tokens(text), tokens(local)
    count = lambda list_, t: F.size(F.filter(list_, lambda u: u == t))
    in_title = lambda t: F.array_contains(tokens(title), t)
    fit = F.filter(F.array_distinct(mine), lambda t: ~F.array_contains(tokens(hint), t) & ~t.rlike("^[0-9]+$") & (F.length(t) >= 5) & ~t.isin(*lx.COPY_INTEREST) & ~t.isin(*lx.WEAK_TAGS) & ((count(mine, t) >= 2) | in_title(t)))
    scored = F.transform(fit, lambda t: F.struct((count(mine, t) * 40 + F.least(F.lit(2), count(near, t)) * 9 + F.when(in_title(t), 64).otherwise(0)).alias("score"), t.alias("t")))
    return F.transform(F.slice(F.sort_array(scored, asc=False), 1, 2), lambda s: s["t"])


def grounded_terms(text: Column, local: Column, subject: Column) -> Column:
    """The subject and the capitalised words of the source, six at most."""
    words = F.filter(F.regexp_extract_all(F.concat(text, F.lit(" "), local), F.lit(r"\b[A-Z][A-Za-z0-9'’-]{2,}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(*lx.GENERIC_CAPITALS))
    return _distinct(F.concat(F.array(subject), words), 6)


def written(clips: DataFrame) -> DataFrame:
    """clips(text, local, hint, kind, style, moment, ...) with sentences, core, support, headline, title, description, tags, grounded and social."""
    style, kind = F.col("_style"), F.col("kind")
    x = clips.withColumns({"text": clean(F.col("text")), "local": clean(F.col("local"))})
    asked = F.when(F.col("style").isin("viral", "clean", "cinematic"), F.col("style")).otherwise("auto")
    x = x.withColumn("_style", F.when((asked == "auto") & kind.isin("anime", "film-tv"), "cinematic").when((asked == "auto") & (kind == "meme-comedy"), "viral").otherwise(asked))
    x = x.withColumns({"sentences": sentences(F.col("text")), "_every": tokens(F.concat_ws(" ", "text", "local")), "subject": subject_label(F.col("hint"))})
    x = x.withColumn("core", core_sentence(F.col("text"), F.col("sentences"), F.col("_every")))
    x = x.withColumn("support", supporting_sentence(F.col("sentences"), F.col("core"), F.col("_every")))
    x = x.withColumns({"_a": strip_fillers(F.col("core")), "_b": strip_fillers(F.col("support"))})
    x = x.withColumn("_head", headline(F.col("_a")))
    x = x.withColumn("headline", compressed(F.col("_head"), tokens(F.concat_ws(" ", "_head", "local"))))
    x = x.withColumn("_title", truncate_title(F.col("headline"), F.when(style == "cinematic", 7).otherwise(10), F.when(style == "cinematic", 52).otherwise(66)))
    viral = (style == "viral") | (style == "auto") & (_any(F.lower("core"), lx.COPY_INTEREST) | F.contains("core", F.lit("?")))
    x = x.withColumn("_title", F.when(viral & ~F.contains("_title", F.lit("?")), title_case(F.rtrim("_title", F.lit(".")))).otherwise(sentence_case(F.col("_title"))))
    subject, title = F.col("subject"), F.col("_title")
    room = 72 - F.length(subject) - 3
    vague = title.rlike("(?i)" + lx.VAGUE_START) | (F.size(split_words(title)) <= 6)
    named = (subject != "") & kind.isin("anime", "film-tv", "documentary") & vague & (room >= 20) & ~F.contains(F.lower(title), F.lower(subject))
    x = x.withColumn("_title", F.when(named, F.concat(subject, F.lit(": "), truncate_words(title, 8, room))).otherwise(title))
    x = x.withColumn("title", F.rtrim(F.left(trusted_case(F.col("_title"), subject), F.lit(78)), F.lit(_MARKS))).withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise("Strong moment"))
    # The sentence that says more than the title comes first.
    x = x.withColumns({"_sa": similarity(F.col("_a"), F.col("title")), "_sb": similarity(F.col("_b"), F.col("title"))})
    swap = (F.col("support") != "") & ((F.col("_sb") < F.col("_sa")) | (F.col("_sb") == F.col("_sa")) & (F.length("_b") > F.length("_a")))
    x = x.withColumns({"_one": F.when(swap, F.col("_b")).otherwise(F.col("_a")), "_two": F.when(F.col("support") == "", "").when(swap, F.col("_a")).otherwise(F.col("_b"))})
    x = x.withColumn("_first", fragment(F.col("_one"), 23, 150))
    x = x.withColumn("_second", F.when((F.col("_two") != "") & (similarity(F.col("_two"), F.col("_first")) < 0.78), fragment(F.col("_two"), 20, 125)).otherwise(""))
    case = lambda c: terminal(sentence_case(c))
    x = x.withColumns({"_f22": fragment(F.col("_first"), 22, 150), "_f18": fragment(F.col("_first"), 18, 120)})
    both = F.when((F.col("_second") != "") & kind.isin("podcast", "documentary", "other", "gameplay"), F.concat(case(F.col("_first")), F.lit(" "), case(F.col("_second")))).otherwise(case(F.col("_first")))
    x = x.withColumn("_both", both)
    long = F.when(style == "viral", truncate_words(F.col("_both"), 36, 240)).otherwise(truncate_words(F.col("_both"), 40, 240))
    told = F.when((style == "cinematic") | kind.isin("anime", "film-tv"), case(F.col("_f22"))).when(kind == "meme-comedy", case(F.col("_f18"))).otherwise(terminal(long))
    x = x.withColumn("description", told).withColumn("description", trusted_case(F.col("description"), subject))
    fixed = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), c), F.lit(""))
    tags = F.concat(F.array(hashtag(subject), hashtag(fixed(lx.CONTENT_TAGS, kind)), hashtag(fixed(lx.MOMENT_TAGS, F.col("moment")))), F.transform(specific_topics(F.col("text"), F.col("local"), F.coalesce("hint", F.lit("")), F.col("title")), hashtag))
    x = x.withColumns({"tags": _distinct(tags, 5), "grounded": grounded_terms(F.col("text"), F.col("local"), subject)})
    social = F.when(F.size("tags") > 0, F.trim(F.concat("description", F.lit("\n\n"), F.array_join("tags", " ")))).otherwise(F.col("description"))
    return x.withColumn("social", social).drop("_style", "_every", "_head", "_title", "_a", "_b", "_sa", "_sb", "_one", "_two", "_first", "_second", "_f22", "_f18", "_both")
