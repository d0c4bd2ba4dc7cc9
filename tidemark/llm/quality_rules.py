"""Quality rules by distribution divergence.

Each language gets a reference: the histogram of character classes and the
histogram of its common words over all documents. A document whose own
histogram lies too far from its language's (Jensen-Shannon distance, base 2)
is rejected. Documents shorter than the guards are judged by the base rules
alone, since a short text's histogram is noise.

Every language has a reference of its own. Those of languages with a thousandth
of the documents or more, a thousand at most, are sent to all tasks; documents
of rarer languages meet theirs in a join, where no key is hot.

Cases: a null text has no words and fails the base rules; a null language is a
language of its own, and so is an empty one; a language without words has no
word reference, and its documents no word distance; repeated rows get equal
results; empty tables give none; words may hold any character.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices

MIN_WORDS = 20  # base rule
MAX_REPEATED = 30  # base rule: per cent of words in repeated windows
WINDOW = 8
#: Guards: below these a histogram isn't judged.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: A word is common if it makes up this share of its language's words: at most 1/SHARE words a language.
SHARE = 0.002
#: Distances above which a document is rejected.
MAX_CHARS, MAX_WORDS = 0.2, 0.38
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "pause", "mark", "symbol", "other")
SYMBOLS = b"#*$%&|<>"

# Character class of each byte of UTF-8: bytes of longer characters count as letters, lower case.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[*range(97, 123), *range(0xC2, 0xF5)]] = 0
_CLASS[range(65, 91)] = 1
_CLASS[range(48, 58)] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[list(b".")] = 5
_CLASS[list(b",;:-'\"()")] = 6
_CLASS[list(b"!?")] = 7
_CLASS[list(b"#*$%&|<>@^~_=+/\\{}[]`")] = 8
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EDGES = b".,;:!?\"'()[]#*$%&|<>-"


def class_counts(text: bytes) -> np.ndarray:
    """Characters of each class; continuation bytes count for nothing."""
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    b = np.where(_LEAD, b, 0)
    return np.bincount(_CLASS, weights=b, minlength=len(CLASSES)).astype(np.int64)


def repeated_words(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word whether it lies in a window of WINDOW words that is found twice or more in its document.

    ids: 64-bit hashes of the words of many documents; doc: the document of each, ascending.
    """
    n = len(ids) - WINDOW + 1
    inside = np.zeros(len(ids), bool)
    if n <= 0:
        return inside
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
            key ^= key >> np.uint64(29)
        key += doc[:n].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        key ^= key >> np.uint64(32)
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    key = key[starts]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    reach = np.zeros(len(ids) + 1, np.int64)
    np.add.at(reach, starts[twice], 1)
    np.add.at(reach, starts[twice] + WINDOW, -1)
    return np.cumsum(reach[:-1]) > 0


def _base(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    import xxhash

    known: dict[bytes, int] = {}
    counts, ids = [], []
    for t in texts:
        words = t.split()
        counts.append(len(words))
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
    n = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    inside = repeated_words(np.array(ids, np.uint64), doc)
    return n, np.bincount(doc[inside], minlength=len(texts)).astype(np.int64)


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _words(text: bytes) -> list[bytes]:
    """Words for the common-word histogram: lower case, without marks at their ends."""
    return [w.strip(_EDGES) for w in text.translate(_WORDS).split()]


#: What a count is of: a word, a character class, or the words and documents of a language.
WORD, CLASS, TOTAL = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, the counts of words, of character classes, and of all words and documents."""
    from collections import Counter

    found: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        x = [(lang, kind, w.decode("utf-8", "replace"), n) for lang, c in found.items() for (kind, w), n in c.items()]
        found.clear()
        columns = list(zip(*x, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "word", "n"])

    for b in slices(batches):
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            c = found.setdefault(lang, Counter())
            text = (t or "").encode("utf-8", "surrogatepass")
            words = _words(text)
            c.update((WORD, w) for w in words)
            c[TOTAL, b"words"] += len(words)
            c[TOTAL, b"docs"] += 1
            for name, n in zip(CLASSES, class_counts(text), strict=True):
                c[CLASS, name.encode()] += int(n)
        if sum(map(len, found.values())) > 400_000:
            yield rows()
    yield rows()


def references(docs: DataFrame) -> DataFrame:
    """(lang, docs, words, counts): of each language of docs(lang, text) the rows and words, and the counts of classes and common words.

    Counted over all rows; at most 1 / SHARE words and all classes a language.
    """
    counts = cut(docs.mapInArrow(_count, "lang string, kind int, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "words")
    total = lambda name: F.max(F.when(F.col("word") == name, F.col("n"))).alias(name)
    totals = cut(counts.where(F.col("kind") == TOTAL).groupBy("lang").agg(total("docs"), total("words")), "totals")
    common = counts.join(totals, "lang").where((F.col("kind") == CLASS) | (F.col("kind") == WORD) & (F.col("n") >= F.greatest(F.lit(1.0), F.col("words") * SHARE)) & (F.col("word") != ""))
    return cut(common.groupBy("lang").agg(F.first("docs").alias("docs"), F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("kind", "word", "n"))).alias("counts")), "references")


class Reference:
    """Shares of the character classes and of the common words of one language; the last share is of all other words."""

    def __init__(self, words: int, counts: list[dict]) -> None:
        chars = np.zeros(len(CLASSES))
        shares = {}
        for c in counts:
            if c["kind"] == CLASS:
                chars[CLASSES.index(c["word"])] = c["n"]
            else:
                shares[c["word"].encode("utf-8", "surrogatepass")] = c["n"] / words
        self.chars = chars / max(1.0, chars.sum())
        self.place = {w: i for i, w in enumerate(shares)}
        self.words = np.array([*shares.values(), max(0.0, 1 - sum(shares.values()))])


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms that sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: float(np.nansum(np.where(a > 0, a * np.log2(a / m), 0)))
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


_VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _verdicts(known: dict[str, Reference], max_chars: float, max_words: float):
    """known: references by language; rows of another language carry words and counts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, Reference | None] = (None, None)
        for b in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            n, repeated = _base(texts)
            rows = []
            for k, (lang, t, n_words, n_repeat) in enumerate(zip(b.column("lang").to_pylist(), texts, n.tolist(), repeated.tolist(), strict=True)):
                ref = known.get(lang)
                if ref is None:
                    if held[0] != lang:
                        held = lang, Reference(b.column("words")[k].as_py(), b.column("counts")[k].as_py())
                    ref = held[1]
                chars = class_counts(t)
                n_chars = int(chars.sum())
                word_chars = n_chars - sum(map(t.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
                failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * n_words
                c = distance(chars / n_chars, ref.chars) if n_chars >= GUARD_CHARS else None
                w = None
                if n_words >= GUARD_WORDS and ref.place:
                    own = np.bincount([ref.place.get(x, len(ref.place)) for x in _words(t)], minlength=len(ref.words))
                    w = distance(own / own.sum(), ref.words)
                far = (c or 0.0) > max_chars or (w or 0.0) > max_words
                rows.append((n_words, word_chars, sum(map(t.count, (bytes([s]) for s in SYMBOLS))), dup_lines(t), n_repeat, failed, not failed and not far, c, w))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = [pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True)) or [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], [x.split()[0] for x in _VERDICT.split(", ")])

    return run


def judge(docs: DataFrame, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS) -> DataFrame:
    """For each row of docs(doc_id, text, lang): the base counts, both distances (null below the guards), the verdict."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"))
    found = references(docs)
    rows = found.agg(F.sum("docs")).first()[0] or 0
    frequent = found.where(F.col("docs") * 1000 >= rows).collect()  # at most 1000 languages
    known = {r.lang: Reference(r.words, [c.asDict() for c in r.counts]) for r in frequent}
    out = docs.where(F.col("lang").isin(*known)).mapInArrow(_verdicts(known, max_chars, max_words), _VERDICT)
    rare = found.where(F.col("docs") * 1000 < rows)
    if rare.isEmpty():
        return out
    others = docs.where(~F.col("lang").isin(*known)).join(rare.select("lang", "words", "counts"), "lang")
    return out.union(others.select("doc_id", "text", "lang", "words", "counts").mapInArrow(_verdicts({}, max_chars, max_words), _VERDICT))
