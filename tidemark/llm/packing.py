"""Sequence packing by cutting-stock column generation.

A document's tokens (and the closing id 0) are cut into full sequences and one
rest. The histogram of rest lengths, at most SEQUENCE - 1 numbers, is a cutting
stock problem: a linear program over patterns (how many rests of each length
share a sequence) is solved by column generation, a knapsack dynamic program
prices new patterns, patterns are rounded down, and what rounding leaves is
packed by best fit over the histogram. Rests of patterns that would leave more
than WASTE ids of padding are cut once more, into power-of-two lengths, which
fill sequences without padding in any mix. The patterns then are dealt to
ranked pieces: pieces are ranked within their length, and a rank names a
pattern's copy and place. Ranks come from counts by (length, salt), so that a length
that a third of all rows share spreads over tasks.

Cases: a null or empty text is the single closing id; repeated rows and null
ids are documents of their own; empty tables give none; texts are cut at
sequence length only, and every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, slices

SEQUENCE = 1024
#: Column generation ends when the program's value is this close to its lower bound.
GAP = 0.001
STEPS = 1500
#: Padding of a pattern above which its rests are cut into power-of-two lengths.
WASTE = 8
#: Word pieces whose ids a task remembers at most.
REMEMBERED = 150_000


class Ids:
    """A text's ids as little-endian unsigned 32-bit bytes.

    The faster library takes a text as a whole: where many words are rare, that
    costs less than looking words up. Without it, as in a byte-level BPE a run
    between two single spaces is encoded alike wherever it stands, such runs
    are looked up; a text where a space has white space on both sides, or that
    holds a special token, is encoded as a whole.
    """

    def __init__(self, tokenizer: str) -> None:
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.fast = self._fast(tokenizer)
        self.known: dict[str, bytes] = {}
        self.whole = re.compile(r"\s \s|\s \Z|<\|")

    def _fast(self, tokenizer: str):
        """The same vocabulary in the faster library, where its ranks lie beside the tokenizer's file."""
        import base64
        import os
        import re

        ranks = re.sub(r"\.json$", ".tiktoken", tokenizer)
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def _encode(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast and "<|" not in text else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast or self.whole.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [self._encode(first)]
        for w in rest:
            x = known.get(w)
            if x is None:
                x = known[w] = self._encode(" " + w)
            out.append(x)
        return b"".join(out)


def cuts(length: int) -> list[tuple[int, int]]:
    """length in power-of-two parts, the largest first: (begin, end) of each."""
    out, at = [], 0
    for k in reversed(range(length.bit_length())):
        if length >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt) of each piece of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt, width = Ids(tokenizer), 0, 4 * sequence
        for x in slices(batches):
            ids, rows = x.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, x.column("text").to_pylist(), strict=True):
                blob = encode(text) + b"\0\0\0\0"
                for at in range(0, len(blob), width):
                    part = blob[at : at + width]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(blob) // 4, salt, [zlib.crc32(part[4 * a : 4 * b]) for a, b in cuts(len(part) // 4)] if len(part) < width else []))
                    salt += 1
            *columns, crcs = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "cut_crcs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long, cut_crcs array<long>")


def knapsack(lengths: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best-priced filling of room with lengths (ascending), each as often as wanted: its price, and how often each."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    upto = np.searchsorted(lengths, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            value = best[c - lengths[:k]] + prices[:k]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i
    counts, c = np.zeros(len(lengths), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(lengths[took[c]])
    return float(best[room]), counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, room: int = SEQUENCE, gap: float = GAP, steps: int = STEPS) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear program: least sum of uses that covers the demand."""
    m = len(lengths)
    patterns = [np.zeros(m, np.int64) for _ in range(m)]
    for i, p in enumerate(patterns):
        p[i] = room // lengths[i]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    use = inverse @ demand
    floor = float(lengths @ demand) / room

    def enter(new: np.ndarray) -> bool:
        """Takes a pattern into the basis in place of the one that its use drives to zero first."""
        held = np.flatnonzero(new)
        change = inverse[:, held] @ new[held]
        ratio = np.where(change > 1e-9, use / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        step = ratio[out]
        use[:] = np.maximum(use - step * change, 0)
        use[out] = step
        row = inverse[out] / change[out]
        inverse[:] -= np.outer(change, row)
        inverse[out] = row
        patterns[out] = new
        return True

    for new, _ in greedy(lengths, np.ceil(demand).astype(np.int64), room):  # a warm start
        if new @ inverse.sum(axis=0) > 1 + 1e-9:
            enter(new)
    for _ in range(steps):
        worth, new = knapsack(lengths, np.maximum(inverse.sum(axis=0), 0), room)
        value = float(use.sum())
        floor = max(floor, value / max(worth, 1.0))  # Farley's bound
        if worth <= 1 + 1e-9 or value <= (1 + gap) * floor or not enter(new):
            break
    return list(zip(patterns, use, strict=True))


def greedy(lengths: np.ndarray, demand: np.ndarray, room: int = SEQUENCE) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that place the demand: the longest rest opens a sequence, the fullest filling among the others joins it."""
    demand = demand.copy()
    out: list[tuple[np.ndarray, int]] = []
    while demand.any():
        live = np.flatnonzero(demand)
        p = np.zeros(len(lengths), np.int64)
        p[live[-1]] = 1
        left = room - int(lengths[live[-1]])
        reach = np.full(left + 1, -1)  # the last length that makes this sum
        reach[0] = len(lengths)
        for i in live:
            if lengths[i] > left:
                break
            for _ in range(min(int(demand[i]) - int(p[i]), left // int(lengths[i]), 3)):
                new = np.flatnonzero(reach[: left + 1 - lengths[i]] >= 0) + lengths[i]
                new = new[reach[new] < 0]
                if not len(new):
                    break
                reach[new] = i
            if reach[left] >= 0:
                break
        at = int(np.flatnonzero(reach >= 0)[-1])
        while at:
            if p[reach[at]] >= demand[reach[at]]:
                break
            p[reach[at]] += 1
            at -= int(lengths[reach[at]])
        times = int((demand[p > 0] // p[p > 0]).min())
        out.append((p, times))
        demand -= p * times
    return out


def plan(lengths: np.ndarray, demand: np.ndarray, room: int = SEQUENCE) -> list[tuple[np.ndarray, int]]:
    """Whole patterns, with how many sequences each makes, that place the demand exactly."""
    demand = demand.copy()
    out: list[tuple[np.ndarray, int]] = []
    while demand.sum() > 4 * len(lengths):
        before = demand.sum()
        live = np.flatnonzero(demand)
        for p, x in sorted(column_generation(lengths[live], demand[live].astype(float), room), key=lambda q: -q[1]):
            times = int(x + 1e-6)
            if times:
                full = np.zeros(len(lengths), np.int64)
                full[live] = p
                times = min(times, int((demand[full > 0] // full[full > 0]).min()))
                if times:
                    out.append((full, times))
                    demand -= full * times
        if demand.sum() > 0.7 * before:
            break
    return out + greedy(lengths, demand, room)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of docs with sequence_id and offset: gapless in a sequence from 0, at most sequence ids in each."""
    spark = docs.sparkSession
    salts = max(8, partitions(spark))
    every = cut(pieces(docs, tokenizer, sequence).withColumn("salt", F.pmod(F.xxhash64("salt", "doc_id", "ids_crc32"), F.lit(salts))), "pieces")
    counts = cut(every.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most one row for each length
    demand = {r.length: r.n for r in histogram}
    full = demand.pop(sequence, 0)
    lengths = np.array(sorted(demand), np.int64)
    # A pattern's copies are numbered on; the places of a length follow each other, pattern by pattern.
    places: dict[int, list[tuple[int, int, int, int]]] = {sequence: [(0, 0, 1, 0)]}
    base, used, cut_from, parts = full, dict.fromkeys(demand, 0), {}, {}
    whole = plan(lengths, np.array([demand[x] for x in lengths.tolist()], np.int64), sequence) if len(lengths) else []
    for p, times in whole:
        if sequence - int(p @ lengths) > WASTE:
            continue
        at = 0
        for i in np.flatnonzero(p):
            x, k = int(lengths[i]), int(p[i])
            places.setdefault(x, []).append((used[x], base, k, at))
            used[x] += k * times
            at += k * x
        base += times
    for x, n in used.items():  # the rests beyond are cut; their parts of each size are numbered through
        cut_from[x] = n
        for a, b in cuts(x):
            parts[b - a, x] = demand[x] - n
    tape, at = {}, 0
    for size, x in sorted(parts, key=lambda k: (-k[0], k[1])):
        tape[size, x] = at
        at += size * parts[size, x]
    table = {x: np.array(rows, np.int64) for x, rows in places.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero((length == x) & (rank < cut_from.get(int(x), 2**62)))
                if len(at):
                    rows = table[int(x)]
                    r = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                    k = rank[at] - r[:, 0]
                    seq[at] = r[:, 1] + k // r[:, 2]
                    off[at] = r[:, 3] + k % r[:, 2] * x
            kept = pa.array(seq >= 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"]).filter(kept)
            rows = []
            for r in b.filter(pa.array(seq < 0)).to_pylist():
                for (lo, hi), crc in zip(cuts(r["length"]), r["cut_crcs"], strict=True):
                    at = tape[hi - lo, r["length"]] + (hi - lo) * (r["rank"] - cut_from[r["length"]])
                    rows.append((r["doc_id"], r["start"] + lo, hi - lo, crc, r["doc_tokens"], base + at // sequence, at % sequence))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = every.join(starts, ["length", "salt"]).select("*", (F.col("before") + F.row_number().over(own) - 1).alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
