"""Caption phrases from timed words, cues for segments without words, joined words and balanced lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions.text import let


def _folded(words: DataFrame, group: list[str], n_max, c_max, d_max, pause) -> DataFrame:
    """(group, w, k): a clip's words in order and the phrase of each; limits in words, characters, hundredths of a second."""
    rows = F.array_sort(F.collect_list(F.struct("rel_start", "rel_end", "seg_ix", "word_ix", "word")))
    start = F.expr("struct(-1 as phrase, 0 as n, 0 as chars, 0L as first, 0L as last, '' as prev, cast(array() as array<int>) as out)")

    def step(a, x):
        glued = x["word"].rlike(r"^[,.;:!?%)}\]]") | a["prev"].rlike(r"['’\-—(]$")
        chars = a["chars"] + F.length(x["word"]) + F.when(glued, 0).otherwise(1)
        gap = x["rel_start"] - a["last"]
        new = (
            (a["n"] == 0)
            | (gap > pause)
            | a["prev"].rlike(r"[.!?][\"')\]]?$")
            | a["prev"].rlike(r"[,;:][\"')\]]?$") & (gap > 20) & (a["n"] >= 3)
            | (a["n"] + 1 > n_max)
            | (chars > c_max)
            | (x["rel_end"] - a["first"] > d_max)
        )
        k = a["phrase"] + F.when(new, 1).otherwise(0)
        return F.struct(
            k.alias("phrase"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, F.length(x["word"])).otherwise(chars).alias("chars"),
            F.when(new, x["rel_start"]).otherwise(a["first"]).alias("first"), x["rel_end"].alias("last"), x["word"].alias("prev"), F.concat(a["out"], F.array(k)).alias("out"),
        )

    return words.groupBy(*group).agg(rows.alias("w")).withColumn("k", F.aggregate("w", start, step)["out"])


def phrases(words: DataFrame, group: list[str], style: str = "viral") -> DataFrame:
    """words(group, rel_start, rel_end, word, seg_ix, word_ix) with phrase, counted from 0 in each group.

    A new phrase begins after a long pause, after a sentence, after a clause with a short pause, and where the phrase
    would grow too large or too long. A fold over each group; a group is one clip's words, of bounded number.
    """
    n_max, c_max, d_max, pause = lx.CAPTION_STYLES[style]
    folded = _folded(words, group, n_max, c_max, round(d_max * 100), round(pause * 100))
    return folded.select(*group, F.explode(F.arrays_zip("w", "k")).alias("z")).select(*group, "z.w.*", F.col("z.k").alias("phrase"))


def phrase_lists(words: DataFrame, group: list[str]) -> DataFrame:
    """(group, phrases) with each clip's phrases as arrays of words, by the limits max_words, max_chars, max_cs and pause_cs in group."""
    x = _folded(words, group, F.col("max_words"), F.col("max_chars"), F.col("max_cs"), F.col("pause_cs"))
    of = lambda z, p: F.transform(F.filter(z, lambda y: y["k"] == p), lambda y: y["w"])
    # named once: inside the function of a phrase it would be worked out for every phrase anew
    cut = lambda z: F.transform(F.sequence(F.lit(0), F.element_at(z, -1)["k"]), lambda p: of(z, p))
    return x.select(*group, let(F.arrays_zip("w", "k"), cut).alias("phrases"))


def rebalanced(phrases, max_words, max_chars):
    """A clip's phrases without dangling connectives and tiny last ones.

    From the first phrase on, a weak last word moves to the next phrase where it fits; what moves counts for the next
    step. A last phrase of one or two words joins the one before it, with a little more room than a phrase has else.
    """
    return let(phrases, lambda p: _rebalanced(p, max_words, max_chars))


def _rebalanced(phrases, max_words, max_chars):
    none, text = F.slice(phrases, F.lit(1), F.lit(0)), lambda ws: joined(F.transform(ws, lambda w: w["word"]))
    weak = lambda w: F.lower(F.regexp_replace(w["word"], "[^A-Za-z']", "")).isin(*lx.WEAK_EDGES)

    def step(a, nxt):
        last = F.element_at(a["now"], -1)
        longer = F.concat(F.array(last), nxt)
        moves = (F.size(a["now"]) >= 2) & weak(last) & (F.size(longer) <= max_words) & (F.length(text(longer)) <= max_chars)
        stays = F.when(moves, F.slice(a["now"], F.lit(1), F.size(a["now"]) - 1)).otherwise(a["now"])
        return F.struct(F.concat(a["done"], F.array(stays)).alias("done"), F.when(moves, longer).otherwise(nxt).alias("now"))

    a = F.aggregate(F.slice(phrases, F.lit(2), F.greatest(F.lit(0), F.size(phrases) - 1)), F.struct(none.alias("done"), F.element_at(phrases, 1).alias("now")), step)

    def ended(a):
        both = F.concat(F.get(a["done"], F.size(a["done"]) - 1), a["now"])
        fits = (F.size(a["done"]) >= 1) & (F.size(a["now"]) <= 2) & (F.size(both) <= max_words + 2) & (F.length(text(both)) <= max_chars + 8)
        return F.when((F.size(a["done"]) >= 1) & F.coalesce(fits, F.lit(False)), F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.lit(0), F.size(a["done"]) - 1)), F.array(both))).otherwise(F.concat(a["done"], F.array(a["now"])))

    return F.filter(F.transform(F.array(a), ended)[0], lambda p: F.size(p) > 0)


def wrapped(c, most_words: int, most_chars: int):
    """Greedy lines of at most most_words words and most_chars characters."""
    fold = lambda a, w: F.when(
        (F.size(a) > 0) & (F.size(F.split(F.element_at(a, -1), " ")) < most_words) & (F.length(F.element_at(a, -1)) + 1 + F.length(w) <= most_chars),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat_ws(" ", F.element_at(a, -1), w))),
    ).otherwise(F.concat(a, F.array(w)))
    return F.aggregate(F.filter(F.split(c, r"\s+"), lambda w: w != ""), F.expr("cast(array() as array<string>)"), lambda a, w: F.when(F.size(a) == 0, F.array(w)).otherwise(fold(a, w)))


def fallback_cues(held: DataFrame, most_words: int, most_chars: int, offset: float = 0.0) -> DataFrame:
    """held(lo, hi, start, end, text) in seconds, one row a clip and segment, with cue_ix, cue_start, cue_end and cue.

    A segment's text is cut into lines; each takes an equal share of what the
    clip shows of the segment. Cues of 0.03 s or less are left out.
    """
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.05))
    a = F.greatest(F.lit(0.0), F.greatest("start", "lo") - F.col("lo") + offset)
    b = F.least(length, F.least("end", "hi") - F.col("lo") + offset)
    x = held.where(F.least("end", "hi") > F.greatest("start", "lo")).withColumns({"_a": a, "_b": b, "_len": length, "_c": wrapped(F.col("text"), most_words, most_chars)}).where("_b > _a and size(_c) > 0")
    x = x.withColumn("_step", F.greatest(F.col("_b") - F.col("_a"), F.lit(0.2)) / F.size("_c")).select("*", F.posexplode("_c").alias("cue_ix", "cue"))
    x = x.withColumns({"cue_start": F.col("_a") + F.col("cue_ix") * F.col("_step"), "cue_end": F.least(F.col("_a") + (F.col("cue_ix") + 1) * F.col("_step"), "_len")})
    return x.where(F.col("cue_end") > F.col("cue_start") + 0.03).drop("_a", "_b", "_len", "_c", "_step")


def joined(words):
    """Words as a text, with no blank before closing marks or after an opening one."""
    x = F.array_join(F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, r"\s+", " "))), lambda w: w != ""), " ")
    return F.regexp_replace(F.regexp_replace(x, r" (?=[,.;:!?%)}\]])", ""), r"(?<=['’\-—(]) ", "")


def balanced(c, style: str | None = None, max_chars=None):
    """A dense text of calm style in two lines of like length, cut at a good place; style or max_chars tells its density."""
    cap = F.greatest(F.lit(20), F.least(F.lit(32), F.floor((F.lit(lx.CAPTION_STYLES[style][1]) if max_chars is None else max_chars) * 0.68))) + 5
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    plain = lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9']+", ""))
    line = lambda ws, at, n: F.array_join(F.slice(ws, at, n), " ")

    def cut(ws):
        def cost(k):
            left, right = line(ws, F.lit(1), k), line(ws, k + 1, F.size(ws) - k)
            last, first = F.element_at(ws, k), F.element_at(ws, k + 1)
            score = F.abs(F.length(left) - F.length(right)) + F.when(plain(last).isin(*lx.WEAK_EDGES), 24).otherwise(0) + F.when(plain(first).isin(*lx.WEAK_SECOND_LINES), 18).otherwise(0) - F.when(last.rlike("[,;:]$"), 8).otherwise(0) - F.when(plain(first).isin(*lx.GOOD_SECOND_LINES), 4).otherwise(0)
            return F.when((F.length(left) <= cap) & (F.length(right) <= cap), F.struct(score.alias("score"), k.alias("k"), F.concat(left, F.lit("\n"), right).alias("text")))

        return F.array_min(F.array_compact(F.transform(F.sequence(F.lit(3), F.size(ws) - 3), cost)))["text"]

    ws = F.split(x, " ")
    return F.when((F.size(ws) < 7) | (F.length(x) < 30), x).otherwise(F.coalesce(F.transform(F.array(ws), cut)[0], x))
