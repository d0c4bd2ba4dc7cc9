"""Text predicates and token functions as Columns; nothing here is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx

#: A word: letters, digits and underscores, with apostrophes, hyphens and per cent signs inside.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'’%-]*[\p{L}\p{N}_])?"
NUMBER = r"\b\d+(?:\.\d+)?%?\b|[$£€]\s?\d"


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def topic_tokens(c: Column) -> Column:
    """The set of topic words: four characters or more, without stop words."""
    stop = F.array(*map(F.lit, lx.TOPIC_STOP))
    return F.array_except(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.length(w) >= 4), stop)


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def listed(phrases) -> Column:
    """An array of fixed phrases."""
    return F.expr("array(" + ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in phrases) + ")")


def any_in(c: Column, phrases) -> Column:
    return let(c, lambda x: F.exists(listed(phrases), lambda p: F.contains(x, p)))


def starts_any(c: Column, phrases) -> Column:
    return let(c, lambda x: F.exists(listed(phrases), lambda p: F.startswith(x, p)))


def last_of(c: Column, phrases, end: bool = False) -> Column:
    """Where the last of all occurrences of the phrases begins, or the last to end ends, zero-based; -1: none. The text is turned round once."""

    def place(x: Column) -> Column:
        back = lambda r, p: F.instr(r["r"], p)
        at = lambda r, p: F.when(back(r, p) > 0, r["n"] - back(r, p) + 1 - (F.lit(0) if end else F.length(p))).otherwise(-1)
        return let(F.struct(F.reverse(x).alias("r"), F.length(x).alias("n")), lambda r: F.array_max(F.transform(listed([p[::-1] for p in phrases]), lambda p: at(r, p))))

    return let(c, place)


def last_at(c: Column, phrase: str) -> Column:
    """Zero-based place of the last occurrence; -1: none."""
    back = F.instr(F.reverse(c), phrase[::-1])
    return F.when(back > 0, F.length(c) - back - len(phrase) + 1).otherwise(F.lit(-1))


def times_in(c: Column, phrase: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def opening(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), '^["“‘]+', "")


def starts_clean(c: Column) -> Column:
    o = opening(c)
    first = F.coalesce(F.get(words(F.left(o, F.lit(80))), F.lit(0)), F.lit(""))
    return (o != "") & (~first.isin(*lx.DEPENDENT_STARTS) | any_in(F.left(o, F.lit(90)), lx.HOOK_PHRASES))


def last_word(c: Column, n: int) -> Column:
    """The last word among the last n characters; empty: none."""
    w = words(F.right(c, F.lit(n)))
    return F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit(""))


def ends_clean(c: Column) -> Column:
    x = clean(c)
    return (x != "") & ~last_word(x, 80).isin(*lx.TRAILING_DEPENDENCIES) & F.right(x, F.lit(1)).isin(".", "!", "?", "…")


def unfinished(c: Column) -> Column:
    x = F.regexp_replace(clean(c), "[\"”’ ]+$", "")
    w = last_word(x, 90)
    return (w == "") | w.isin(*lx.TRAILING_DEPENDENCIES) | F.lower(x).rlike(r"\b(and then|the reason (is|was)|what happened (is|was))[^\p{L}\p{N}_]*$")


def _end_of_last(x: Column, pattern: str) -> Column:
    """Where the last match of pattern ends: what the last piece between matches leaves; -1: no match."""
    pieces = F.split(x, pattern)
    return F.when(F.size(pieces) > 1, F.length(x) - F.length(F.element_at(pieces, -1))).otherwise(F.lit(-1))


def closure_end(c: Column) -> Column:
    """End of the last closure cue or pattern; -1: none."""
    return let(F.lower(clean(c)), lambda x: F.greatest(last_of(x, lx.CLOSURE_CUES, end=True), *[_end_of_last(x, p) for p in lx.CLOSURE_PATTERNS]))


def short_reaction(c: Column) -> Column:
    x = opening(c)
    n = F.size(words(x))
    return (n > 0) & (n <= 14) & (starts_any(x, lx.REACTION_STARTS) | x.isin("yes", "no", "yeah", "wow", "whoa"))


def moment_type(c: Column) -> Column:
    x = F.lower(c)
    out = F.lit("unknown")
    for name, cues in reversed(lx.MOMENT_CUES.items()):
        out = F.when(any_in(x, cues), F.lit(name)).otherwise(out)
    return out


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")
