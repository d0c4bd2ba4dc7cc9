"""SimHash near-duplicates through BK-trees.

Fingerprints: 64 bits over 3-word shingles. Documents with one fingerprint are
one class; distinct fingerprints that differ in at most RADIUS bits link, and
the linked classes form components.

Search: two fingerprints within 2 bits agree on at least one of three bit
blocks, so distinct fingerprints are dealt to shards by (block, its bits). In
each shard a BK-tree (children keyed by integer Hamming distance to the
parent) is grown and searched, following only edges within the radius. A shard
grows with a group of near copies, so shards of more than SHARD_ROWS are dealt
anew by three of six finer blocks, and those that are still larger are searched
exactly by neighbour keys instead: two fingerprints lie within 2 bits if and
only if they share one of their 65 keys (the fingerprint itself and its
one-bit changes), and no key is shared by more than 65 fingerprints.

Cases: null text has no words and fingerprint zero, linked like any other;
fewer than three words make one shingle; repeated rows and null ids stay rows
of their own (a null id names no component and a component of null ids only is
null); empty tables give none; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, cut, slices

RADIUS = 2
SHARD_ROWS = 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The 64 bits in blocks: three for one agreement.
BLOCKS = ((0, 21), (21, 42), (42, 64))
FINE = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have set."""
    set_ = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 13):
        set_ += np.unpackbits(h[k : k + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < 3:
        return h64(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=False)), np.uint64, len(words) - 2)
    return majority(h)


def fingerprints(docs: DataFrame, keep_text: bool = False, into: str = "fp") -> DataFrame:
    """docs (without text, unless it is kept) with the fingerprint as a signed long."""
    kept = [f for f in docs.schema.fields if (keep_text or f.name != "text") and f.name != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            fp = np.array([fingerprint(t) for t in x.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in kept), pa.array(fp)], [*(f.name for f in kept), into])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.LongType())]))


class BKTree:
    """Children keyed by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """The values at most radius away; only edges between distance - radius and distance + radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        a, b = [], []
        for shard in x.column("fps").to_pylist():
            tree, mask = BKTree(), 2**64 - 1
            for v in sorted(shard):
                near = tree.within(v & mask, RADIUS)
                for w in near:
                    a.append(v)
                    b.append(w - 2**64 if w >= 2**63 else w)
                tree.add(v & mask)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bits(lo: int, hi: int) -> F.Column:
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) for every two of distinct(fp) that differ in 1 to RADIUS bits; a pair may come more than once."""
    one = cut(distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _bits(*x).alias("bits")) for k, x in enumerate(BLOCKS)])).alias("k")).select("fp", "k.*"), "blocks")
    sizes = cut(one.groupBy("block", "bits").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    sized = one.join(sizes, ["block", "bits"])
    shards = sized.where(F.col("n") <= SHARD_ROWS).groupBy("block", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")
    # In a larger shard, six finer blocks: at least four of them agree, so some three of them name a shard of both.
    big = sized.where(F.col("n") > SHARD_ROWS).select("fp").distinct()
    pairs = [F.concat_ws("/", F.lit(f"{i}{j}"), _bits(*FINE[i]), _bits(*FINE[j]), *([_bits(*FINE[k])] if k is not None else [])) for i, j, k in ((i, j, k) for i in range(6) for j in range(i + 1, 6) for k in range(j + 1, 6))]
    fine = cut(big.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(n), p) for n, p in enumerate(pairs)])).alias("key")), "fine")
    fine_sizes = cut(fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "fine-sizes")
    fine_sized = fine.join(fine_sizes, "key")
    small = fine_sized.where(F.col("n") <= SHARD_ROWS).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = shards.union(small).mapInArrow(_search, "a long, b long")
    # Still larger: neighbour keys, exact, at most 65 fingerprints each.
    rest = fine_sized.where(F.col("n") > SHARD_ROWS).select("fp").distinct()
    keys = rest.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("key"))
    groups = keys.groupBy("key").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    near = groups.select(F.explode("fps").alias("a"), "b").where("a <> b")
    # Members of a key lie within 2 bits of each other: a star through the smallest joins them all.
    return found.union(near)


def components_of(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of prints(doc_id, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = cut(components(links(distinct.select("fp"))), "parts")
    classes = distinct.join(parts, distinct.fp == parts.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return cut(cut(classes, "classes").join(smallest, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text)."""
    prints = cut(fingerprints(docs.select("doc_id", "text")), "prints")
    return prints.join(components_of(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, wide: bool = False) -> DataFrame:
    """The rows of docs that stand for their group of near duplicates: those of the smallest doc_id, once each.

    wide: groups at a 5-word shingle similarity of 4/5 or more (near_shingles)
    in place of fingerprints RADIUS bits apart. Rows without an id stand for a
    group that has no ids: once for each fingerprint, or once for the wide group.
    """
    if wide:
        from tidemark.llm import near_shingles

        return near_shingles.one_of_each(docs)
    names = docs.columns
    classes = components_of(cut(fingerprints(docs.select("doc_id", "text")), "prints"))
    rows = fingerprints(docs.select("doc_id", "text", F.struct(*names).alias("_row")), into="fp")
    first = rows.join(classes, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return first.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).alias("fp")).agg(F.first("_row").alias("_row")).select("_row.*")
