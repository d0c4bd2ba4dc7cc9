"""Exact repeats of 400 bytes, or of 50 words, by a depth-limited radix sort of suffixes.

A text is a row of bytes, and where asked for a row of words `[^\x20\x09-\x0D]+` too
(whatever white space stands between them): a unit is a kind of row, with a window of
its own. What is said of bytes below holds for the words of that unit alike.

Only the first window bytes of a suffix matter, so suffixes are ordered by
most-significant-digit passes that stop there: equal groups are exactly the
repeated windows. Passes run over nodes, runs of neighbouring window starts
that are ordered together: a node's core (the bytes that all its windows
share) is the digit of the pass, its hull all the bytes that any of its windows
reads. After each pass
- a core that occurs once holds no repeated window, and its node is dropped;
- a hull that occurs twice or more repeats every window of the node at once;
- what is left, one node for each different hull of a repeated core, is split
  into shorter runs with longer cores for the next pass, down to single starts.

The first nodes hang on content: in every window, the rightmost smallest
hash of a gram of few bytes is the window's anchor, so that equal windows are compared
at equal anchors and no others are. Of nodes with one hull a single one goes
on, counting twice. Groups are counted with partial aggregation
and never gathered, so that a passage that a third of all rows share is a
number like any other. Keys are 64-bit hashes.

Cases: null text is empty; texts shorter than a window keep every byte; the white
space before and after a removed run of words stays; a text
with a copy is removed from its first to its last byte; repeated rows are
copies; null ids are documents like others; empty tables give none. Texts are
read whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices


class Unit(NamedTuple):
    window: int
    gram: int
    #: Starts in a node of each pass; the grams in a window are twice the first.
    widths: tuple[int, int, int]
    #: Bytes that a text with a window has at least.
    least: int

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


BYTES, WORDS = 0, 1
#: Bytes: 2 x 192, 12 x 16, 16 x 1 starts. Words: 2 x 24, 6 x 4, 4 x 1.
UNITS = (Unit(400, 17, (192, 16, 1), 400), Unit(50, 3, (24, 4, 1), 99))
#: Bytes of text that a task hashes at once (a longer text is hashed alone).
CHUNK = 500_000

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_PLACE = np.uint64((1 << 40) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8").astype(np.uint64)


class Hashes:
    """64-bit hashes of any range of a row of values, position-free."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, np.uint64(_BASE))
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            inverse = np.full(n + 1, np.uint64(pow(_BASE, -1, 2**64)))
            inverse[0] = 1
            self.inverse = np.multiply.accumulate(inverse)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            h += (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            h ^= h >> np.uint64(32)
            return h


def words(data: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end; the texts stand in data one after the other, from lo on, and none is empty."""
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    begin[lo] = solid[lo]
    end[lo[1:] - 1] = solid[lo[1:] - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _one(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of one text begin and end."""
    return words(np.frombuffer(text, np.uint8), np.zeros(min(1, len(text)), np.int64))


def anchors(u: Unit, h: Hashes, n: int) -> np.ndarray:
    """For each start of a window in n bytes or words, the place of the rightmost smallest gram of the window."""
    grams = np.arange(n - u.gram + 1)
    # 24 bits of hash above 40 bits of place: one comparison finds the smallest hash and, of equal ones, the rightmost
    key = h.of(grams, grams + u.gram) & ~_PLACE | (_PLACE - grams.astype(np.uint64))
    blocks = -(-len(key) // u.span)
    full = np.full(blocks * u.span, np.uint64(2**64 - 1))
    full[: len(key)] = key
    rows = full.reshape(blocks, u.span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - u.window + 1
    least = np.minimum(behind[:starts], ahead[u.span - 1 : u.span - 1 + starts])
    return (_PLACE - (least & _PLACE)).astype(np.int64)


def node_keys(u: Unit, h: Hashes, first: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Core and hull of nodes whose windows start at first .. first + width - 1, in texts from lo to hi."""
    core = h.of(first + width - 1, first + u.window)
    if width == 1:
        return core.view(np.int64), core.view(np.int64)
    begin, end = np.maximum(first, lo), np.minimum(first + width - 1 + u.window, hi)
    with np.errstate(over="ignore"):
        hull = h.of(begin, end) ^ ((begin - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) ^ ((first + width - 1 + u.window - end).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return core.view(np.int64), hull.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[list[int]]:
    now, size = [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > CHUNK:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


_NODES = "core long, hull long, tid long, place int, first int, last int, parent int, weight int, unit int"
_NAMES = ["core", "hull", "tid", "place", "first", "last", "parent", "weight", "unit"]
_TYPES = [pa.int64()] * 3 + [pa.int32()] * 6


def _batch(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, _TYPES, strict=True)]


def _first(unit: int, h: Hashes, lo: np.ndarray, hi: np.ndarray, tids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of the first pass of texts that stand in one row from lo to hi: place is the first start of the node, first and last the starts whose anchor it hangs on."""
    u = UNITS[unit]
    if not len(hi) or hi[-1] < u.window:
        return
    at = anchors(u, h, hi[-1])
    doc = np.repeat(np.arange(len(lo)), hi - lo)[: len(at)]
    s = np.flatnonzero(np.arange(len(at)) + u.window <= hi[doc])
    if not len(s):
        return
    at, doc = at[s], doc[s]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    begin, end, place, doc = s[new], s[np.concatenate((new[1:], [len(s)])) - 1], at[new], doc[new]
    width = u.widths[0]
    for half in (0, 1):  # of bytes: starts place - 191 .. place, then place - 383 .. place - 192
        first = place - width * (half + 1) + 1
        f, g = np.maximum(begin, first), np.minimum(end, first + width - 1)
        k = np.flatnonzero(f <= g)
        d = doc[k]
        core, hull = node_keys(u, h, first[k], width, lo[d], hi[d])
        yield pa.RecordBatch.from_arrays(_batch([core, hull, tids[d], first[k] - lo[d], f[k] - lo[d], g[k] - lo[d], first[k] - lo[d], np.ones(len(k)), np.full(len(k), unit)]), _NAMES)


def _first_nodes(units: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = min(UNITS[k].least for k in units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            tids = b.column("tid").to_numpy()
            for chunk in _chunks(texts):
                chunk = [i for i in chunk if len(texts[i]) >= least]
                if not chunk:
                    continue
                data = np.frombuffer(b"".join(texts[i] for i in chunk), np.uint8)
                h = Hashes(_TABLE[data])
                size = np.array([len(texts[i]) for i in chunk])
                hi = np.cumsum(size)
                lo = hi - size
                own = tids[np.array(chunk)]
                if BYTES in units:
                    yield from _first(BYTES, h, lo, hi, own)
                if WORDS in units:
                    begin, end = words(data, lo)
                    yield from _first(WORDS, Hashes(h.of(begin, end)), np.searchsorted(begin, lo), np.searchsorted(begin, hi), own)

    return run


class _Rows:
    """Texts of a unit's rows, hashed in one go: row k stands from lo[k] to hi[k]."""

    def __init__(self, unit: int, texts: list[bytes]) -> None:
        self.text = b"".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        self.hi = np.cumsum([len(t) for t in texts])
        self.lo = np.concatenate(([0], self.hi[:-1]))
        self.h, self.begin, self.end = Hashes(_TABLE[data]), None, None
        if unit == WORDS:
            self.begin, self.end = words(data, self.lo)
            self.h, self.lo, self.hi = Hashes(self.h.of(self.begin, self.end)), np.searchsorted(self.begin, self.lo), np.searchsorted(self.begin, self.hi)

    def between(self, a: int, z: int) -> bytes:
        return self.text[a:z] if self.begin is None else self.text[self.begin[a] : self.end[z - 1]]


def _children(unit: int, level: int, h: Hashes, nodes: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Columns of the nodes of the next pass below nodes (tid, place, first, last, weight) of a level, whose texts lie in h from lo to hi."""
    u, (tid, place, first, last, weight) = UNITS[unit], nodes
    parent, width = u.widths[level], u.widths[level + 1]
    at = (place[:, None] + np.arange(0, parent, width)).ravel()
    of = np.repeat(np.arange(len(place)), parent // width)
    f, g = np.maximum(first[of], at), np.minimum(last[of], at + width - 1)
    k = np.flatnonzero(f <= g)
    of, at, f, g = of[k], at[k], f[k], g[k]
    core, hull = node_keys(u, h, at + lo[of], width, lo[of], hi[of])
    return [core, hull, tid[of], at, f, g, place[of], weight[of], np.full(len(k), unit)]


def _ints(columns: list[pa.Array]) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def _second_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with nodes to split: the shorter nodes, and for each split node a row with the bytes that its windows read."""
    import zstandard

    for b in slices(batches, 64):
        texts = [zstandard.decompress(x) for x in b.column("packed").to_pylist()]
        tids, lists = b.column("tid").to_numpy(), b.column("nodes")
        row = np.repeat(np.arange(len(texts)), _ints([lists.value_lengths()])[0])
        units, place, first, last, weight = _ints(lists.flatten().flatten())
        for chunk in _chunks(texts):
            for unit, u in enumerate(UNITS):
                k = np.flatnonzero((row >= chunk[0]) & (row <= chunk[-1]) & (units == unit))
                if not len(k):
                    continue
                of, own = np.unique(row[k], return_inverse=True)
                x = _Rows(unit, [texts[i] for i in of])
                lo, hi, tid = x.lo[own], x.hi[own], tids[row[k]]
                rows = _children(unit, 0, x.h, [tid, place[k], first[k], last[k], weight[k]], lo, hi)
                yield pa.RecordBatch.from_arrays([*_batch(rows), pa.nulls(len(rows[0]), pa.binary())], [*_NAMES, "bytes"])
                a, z, none = np.maximum(0, place[k]), np.minimum(hi - lo, place[k] + u.widths[0] - 1 + u.window), np.zeros(len(k))
                held = pa.array([x.between(i, j) for i, j in zip((lo + a).tolist(), (lo + z).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*_batch([none, none, tid, place[k], a, hi - lo, place[k], none, none + unit]), held], [*_NAMES, "bytes"])


def _third_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single starts below nodes of the second pass; bytes holds the text from `shift` on, which has n bytes or words in all."""
    for b in slices(batches):
        texts = b.column("bytes").to_pylist()
        units, tid, place, first, last, weight, shift, n = _ints([b.column(c) for c in ("unit", "tid", "place", "first", "last", "weight", "shift", "n")])
        for chunk in _chunks(texts):
            for unit in (BYTES, WORDS):
                k = np.array([i for i in chunk if units[i] == unit], np.int64)
                if not len(k):
                    continue
                x = _Rows(unit, [texts[i] for i in k])
                zero = x.lo - shift[k]
                yield pa.RecordBatch.from_arrays(_batch(_children(unit, 1, x.h, [c[k] for c in (tid, place, first, last, weight)], zero, zero + n[k])), _NAMES)


def _resolve(nodes: DataFrame, name: str, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(unit, tid, place) of the nodes whose windows all repeat, and the nodes to split."""
    twice = cut(nodes.groupBy("core").agg(F.sum("weight").alias("n")).where("n > 1").select("core"), f"{name}-cores")
    live = cut(nodes.join(twice, "core", "left_semi"), f"{name}-live")
    if last:
        return live.select("unit", "tid", "place"), None
    hulls = cut(live.groupBy("core", "hull").agg(F.sum("weight").alias("m"), F.min(F.struct("tid", "place", "first", "last", "parent", "unit")).alias("one")), f"{name}-hulls")
    marks = live.join(hulls.where("m > 1").select("core", "hull"), ["core", "hull"], "left_semi").select("unit", "tid", "place")
    several = cut(hulls.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"), f"{name}-several")
    split = hulls.join(several, "core", "left_semi").select("one.*", F.least("m", F.lit(2)).cast("int").alias("weight"))
    return marks, split


def repeats(texts: DataFrame, units: tuple[int, ...] = (BYTES,)) -> DataFrame:
    """(tid, spans): per text the runs (unit, begin, end) of window starts that repeat, for texts(tid, text)."""

    def runs(marks: DataFrame, level: int) -> DataFrame:
        width = F.when(F.col("unit") == WORDS, UNITS[WORDS].widths[level]).otherwise(UNITS[BYTES].widths[level])
        return marks.distinct().select("unit", "tid", F.col("place").alias("begin"), (F.col("place") + width - 1).alias("end"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())], ["tid", "packed"])

    first = cut(texts.mapInArrow(_first_nodes(units), _NODES), "nodes")
    marks, split = _resolve(first, "first")
    found = [cut(runs(marks, 0), "marks")]
    todo = cut(split.groupBy("tid").agg(F.collect_list(F.struct("unit", "place", "first", "last", "weight")).alias("nodes")), "todo")
    one = texts.mapInArrow(packed, "tid long, packed binary").groupBy("tid").agg(F.first("packed").alias("packed"))
    second = cut(one.join(todo, "tid").mapInArrow(_second_nodes, _NODES + ", bytes binary"), "second")
    marks, split = _resolve(second.where("bytes is null").drop("bytes"), "second")
    found.append(cut(runs(marks, 1), "marks"))
    held = second.where("bytes is not null").select("unit", "tid", F.col("place").alias("parent"), F.col("first").alias("shift"), F.col("last").alias("n"), "bytes")
    third = cut(cut(split, "split").join(held, ["unit", "tid", "parent"]).mapInArrow(_third_nodes, _NODES), "third")
    marks, _ = _resolve(third, "third", last=True)
    found.append(runs(marks, 2))
    every = found[0].union(found[1]).union(found[2])
    return cut(every.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("unit", "begin", "end"))).alias("spans")), "spans")


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Per text the (unit, begin, end) of its spans; none where spans is null."""
    every = list(zip(*(c.tolist() for c in _ints(column.flatten().flatten())), strict=True))
    ends = np.cumsum(_ints([column.value_lengths().fill_null(0)])[0]).tolist()
    return [every[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _runs(unit: int, n: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs of bytes or words that a unit's repeated windows cover, in a text of n bytes or words."""
    window, runs = UNITS[unit].window, []
    for k, begin, end in spans:
        if k == unit:
            a, b = max(0, begin), min(end, n - window) + window
            if b - a >= window:
                runs.append((a, b))
    return runs


def removed(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The byte runs to remove, merged, from the runs of repeated window starts."""
    runs = _runs(BYTES, len(text), spans)
    if any(x[0] == WORDS for x in spans):
        begin, end = _one(text)
        runs += [(int(begin[a]), int(end[b - 1])) for a, b in _runs(WORDS, len(begin), spans)]
    return _merged(runs)


def passage_words(text: bytes, spans: list[tuple[int, int, int]]) -> int:
    """How many words of a text lie in passages of words that stand anywhere else."""
    if not any(x[0] == WORDS for x in spans):
        return 0
    return sum(b - a for a, b in _merged(_runs(WORDS, len(text.split()), spans)))


def with_spans(docs: DataFrame, units: tuple[int, ...] = (BYTES,)) -> DataFrame:
    """docs with spans, from their text column; a column of that name, or named tid, is replaced."""
    keyed = docs.drop("spans", "tid").withColumn("tid", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(repeats(keyed.select("tid", "text"), units), "tid", "left").drop("tid")


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "tid", "packed"])


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean, n_passage_words long, has_passages boolean"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for b in slices(batches):
        rows = []
        for packed, spans in zip(b.column("packed").to_pylist(), _spans(b.column("spans")), strict=True):
            text = zstandard.decompress(packed)
            runs, again = _merged(_runs(BYTES, len(text), spans)), passage_words(text, spans)
            h, at = hashlib.sha256(), 0
            for x, y in runs:
                h.update(text[at:x])
                at = y
            h.update(text[at:])
            rows.append((len(text), sum(y - x for x, y in runs), len(runs), h.hexdigest(), bool(runs), again, again > 0))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in _DIGEST.split(", ")])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats, n_passage_words, has_passages) for each row of docs(doc_id, text).

    The first five and has_repeats, whether bytes are removed, know strings of 400 bytes only. n_passage_words counts the words in
    passages of 50 words or more that stand anywhere else, whatever their bytes; has_passages: whether there are any.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    spans = repeats(keyed.select("tid", "text"), (BYTES, WORDS))
    packed = keyed.mapInArrow(_pack_text, "doc_id long, tid long, packed binary")
    return packed.join(spans, "tid", "left").select("doc_id", "packed", "spans").mapInArrow(_digest, _DIGEST)


def strip(docs: DataFrame, units: tuple[int, ...] = (BYTES,)) -> DataFrame:
    """docs without the repeated bytes and, where asked for, words of their texts; what a cut leaves of a character at its edge goes too."""
    names = docs.columns
    held = with_spans(docs, units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, spans in zip(b.column("text").to_pylist(), _spans(b.column("spans")), strict=True):
                if text is not None and spans:
                    t, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                    for x, y in removed(t, spans):
                        kept.append(t[at:x])
                        at = y
                    kept.append(t[at:])
                    text = "".join(k.decode("utf-8", "ignore") for k in kept)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return held.mapInArrow(run, docs.schema)
