"""Filter interaction audit: what five filters remove in every order of application, with duplicates from radix tries.

Four of the filters look at one text. The fifth asks whether the same text has a smaller id anywhere. Each input task
inserts its whole texts into a compressed trie whose terminals hold the smallest id, so a text leaves a task once,
however often it stands there. The terminals are range-partitioned by their texts' beginnings, which are as long as it
takes to part the heavy ones, and tries over the ranges give each terminal the smallest id of all. Then each document is
five bits, and the counts of the 32 masks of a part give all orders' rows.

Defined cases: a null text is empty, a null part is the empty string. A row without an id is never a duplicate and makes
none, and has no label. Rows with the same id and text are equals: none is a duplicate of another. A label counts if any
row of `labels` for the id has it. No documents: no rows. Other columns, of any name, aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, slices

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPS_PERCENT = 50, 65, 5
#: A trie of a task is written out when it holds this many bytes; a text that comes again later is one more terminal.
TRIE_BYTES = 24 << 20
#: Bytes of texts in a range, about; texts with the same beginning are GROUP_BYTES at most, or one text.
RANGE_BYTES, GROUP_BYTES = 32 << 20, 8 << 20
#: Bytes of the beginnings by which ranges are cut first; where they are too heavy, times STEP, again and again.
FIRST, STEP = 16, 4
#: Heavy beginnings that may be broadcast: there are fewer than (bytes of all texts) / (bytes of a group), and groups grow beyond this many.
MOST_HEAVY = 500_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SIGN = re.compile(rb"[#$%&*|]")
_CAPS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
#: Texts of up to this many bytes are split at once, longer ones word by word.
_AT_ONCE = 4 << 20


def mask(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    if len(text) <= _AT_ONCE:
        words = text.split()
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in _WORD.finditer(text):
            n += 1
            seen.add(m[0])
        distinct = len(seen)
    caps = len(text) - len(text.translate(None, _CAPS))
    points = len(text.translate(None, _CONTINUED))
    return (n < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * caps > CAPS_PERCENT * points) << 2 | (_SIGN.search(text) is not None) << 3


class Trie:
    """A compressed trie of byte strings: an edge holds all bytes up to the next branch, a terminal a number (from 0)."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.size = 0
        self.held = 0

    def _number(self, node: list) -> int:
        if node[2] < 0:
            node[2], self.size = self.size, self.size + 1
        return node[2]

    def insert(self, text: bytes) -> int:
        """The number of the text's terminal; a new one if the text is new."""
        node, at = self.root, 0
        while at < len(text):
            below = node[1].get(text[at]) if node[1] else None
            if below is None:
                below = [text[at:], None, -1]
                node[1] = node[1] or {}
                node[1][text[at]] = below
                self.held += len(text) - at + 200
                return self._number(below)
            label = below[0]
            n = _shared(label, text, at)
            if n < len(label):  # the edge branches here
                below = [label[:n], {label[n]: below}, -1]
                below[1][label[n]][0] = label[n:]
                node[1][text[at]] = below
                self.held += 300
            node, at = below, at + n
        return self._number(node)

    def texts(self) -> Iterator[tuple[int, bytes]]:
        """(number, text) of all terminals, in no order."""
        todo = [(self.root, b"")]
        while todo:
            node, above = todo.pop()
            text = above + node[0]
            if node[2] >= 0:
                yield node[2], text
            if node[1]:
                todo += [(x, text) for x in node[1].values()]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of the label stand in the text at this place."""
    if text.startswith(label, at):
        return len(label)
    low, high = 0, 16
    while high < len(label) and text.startswith(label[low:high], at + low):
        low, high = high, 2 * high
    high = min(high, len(label))
    while high - low > 1:
        middle = (low + high) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle
    return low if high == low or not text.startswith(label[low:high], at + low) else high


_ROWS = "key long, doc_id long, part string, mask int, n long, text binary, n_bytes long, beginning binary, terminal boolean"
_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("beginning", pa.binary()), ("terminal", pa.bool_())])


def _inserted(trie_bytes: int):
    """From (doc_id, part, text): rows counted by (id, part, mask, terminal), and the terminals with their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        trie, masks, least, rows = Trie(), [], [], Counter()

        def out() -> Iterator[pa.RecordBatch]:
            found = [(first + k, i, p, masks[k], n, None, None, None, False) for (i, p, k), n in rows.items()]
            for at in range(0, len(found), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 8192], strict=True), _ARROW, strict=True)], schema=_ARROW)
            some, size = [], 0
            for k, t in trie.texts():
                some.append((first + k, least[k], None, None, None, t, len(t), t[:FIRST], True))
                size += len(t)
                if size > 1 << 20 or len(some) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for b in slices(batches):
            for i, p, t in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
                k = trie.insert(t)
                if k == len(masks):
                    masks.append(mask(t))
                    least.append(i)
                elif i is not None and (least[k] is None or i < least[k]):
                    least[k] = i
                rows[i, p, k] += 1
            if trie.held + 200 * len(rows) > trie_bytes:
                yield from out()
                first += trie.size
                trie, masks, least, rows = Trie(), [], [], Counter()
        yield from out()

    return run


def _least(trie_bytes: int):
    """From terminals (key, doc_id, text, beginning) in order of their beginnings: (key, least), the smallest id of the text in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, least, keys, held = Trie(), [], [], 0
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 65536):
                part = keys[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([least[k] for _, k in part], pa.int64())], ["key", "least"])

        for b in slices(batches):
            for key, i, t, begins in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("beginning").to_pylist(), strict=True):
                if begins != last and trie.held + 100 * len(keys) > trie_bytes:  # no text of before comes again
                    yield from out()
                    trie, least, keys = Trie(), [], []
                last = begins
                k = trie.insert(t)
                if k == len(least):
                    least.append(i)
                elif i is not None and (least[k] is None or i < least[k]):
                    least[k] = i
                keys.append((key, k))
        yield from out()

    return run


def _at(terminals: DataFrame, length: int) -> DataFrame:
    """The terminals with beginnings of this many bytes."""
    return terminals.withColumn("beginning", F.substring("text", 1, length))


def ranged(terminals: DataFrame, range_bytes: int = RANGE_BYTES, group_bytes: int = GROUP_BYTES, first: int = FIRST) -> DataFrame:
    """terminals(key, doc_id, text, n_bytes, beginning) in ranges of their beginnings, sorted; equal texts in one range, next to each other's kin.

    A beginning whose texts are over group_bytes is made STEP times as long, until
    it isn't heavy or is the whole text. The heavy ones are broadcast: they are at
    most MOST_HEAVY, as group_bytes grows with what there is. Where there are more ranges than the bytes call for, groups
    are smaller too: a quarter of a range's share.
    """
    total = terminals.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(partitions(terminals.sparkSession), -(-total // range_bytes))
    group_bytes = max(min(group_bytes, total // (4 * n)), total // MOST_HEAVY)
    # A longer beginning is counted only where the shorter one is heavy, and read off the text each time: no turn joins what an earlier one has joined.
    open_, found, length = terminals, [], first
    while True:
        heavy = cut(open_.groupBy("beginning").agg(F.sum("n_bytes").alias("_sum"), F.max("n_bytes").alias("_longest")).where(f"_sum > {group_bytes} and _longest > {length}").select(F.col("beginning").alias("_heavy")), "heavy")
        if heavy.isEmpty():
            break
        found.append(heavy)
        open_ = _at(terminals, length).join(F.broadcast(heavy), F.col("beginning") == F.col("_heavy"), "left_semi")
        length *= STEP
        open_ = _at(open_, length)
    # the rows of each length: those with a heavy beginning before it and none of it
    x, open_, length = None, terminals, first
    for heavy in found:
        same = F.col("beginning") == F.col("_heavy")
        closed = open_.join(F.broadcast(heavy), same, "left_anti")
        x = closed if x is None else x.union(closed)
        open_ = _at(terminals, length).join(F.broadcast(heavy), same, "left_semi")
        length *= STEP
        open_ = _at(open_, length)
    x = open_ if x is None else x.union(open_)
    return x.select("key", "doc_id", "text", "beginning").repartitionByRange(n, "beginning").sortWithinPartitions("beginning")


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail (bit 0: A, ... bit 4: E)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    both = cut(rows.mapInArrow(_inserted(trie_bytes), _ROWS), "tries")
    least = ranged(both.where("terminal"), range_bytes, group_bytes).mapInArrow(_least(trie_bytes), "key long, least long")
    # a key belongs to one trie of one task, so no key has more rows than such a trie
    x = both.where("not terminal").select("key", "doc_id", "part", "mask", "n").join(least, "key")
    x = x.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).withColumn("_known", F.lit(True))
    # rows without an id find no label; their keys spread them
    x = x.select("part", "mask", "n", F.coalesce("doc_id", "key").alias("_id"), F.col("doc_id").isNotNull().alias("_known")).join(marks, ["_id", "_known"], "left")
    return x.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def _sets(spark: SparkSession) -> DataFrame:
    """For each mask, filter and set of filters before it: what becomes of such a document. 32 x 80 rows."""
    rows = []
    for f in range(5):
        for k in range(5):
            for before in combinations([g for g in range(5) if g != f], k):
                bits = sum(1 << g for g in before)
                for m in range(32):
                    fails, gone = m >> f & 1, bool(m & bits)
                    rows.append((m, f, bits, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(m == 1 << f), 120 // m.bit_count() if fails else 0))
    return spark.createDataFrame(rows, "mask int, f int, before int, _kept int, _removed int, _redundant int, _alone int, _shapley int")


def _orders(spark: SparkSession) -> DataFrame:
    """All orders of the filters, step by step: 600 rows."""
    rows = [("".join(FILTERS[f] for f in o), k + 1, f, sum(1 << g for g in o[:k])) for o in permutations(range(5)) for k, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, f int, before int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", **sizes: int) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What a step removes hangs on the set of filters before it alone, so each part's 32 counts are summed for the 80
    pairs of a filter and a set, and the 600 rows take theirs. A document that fails k filters is removed by each of
    them in 120 / k orders.
    """
    spark = docs.sparkSession
    counted = cut(masks(docs, labels, part, **sizes), "masks")
    total = lambda flag, n, name: F.sum(F.col(flag) * F.col(n)).alias(name)
    x = counted.join(F.broadcast(_sets(spark)), "mask").groupBy("part", "f", "before").agg(
        total("_kept", "n", "kept"), total("_removed", "n", "removed"), total("_redundant", "n", "redundant"), total("_alone", "n", "unique_fails"),
        total("_removed", "good", "good_lost"), total("_removed", "toxic", "toxic_lost"), total("_shapley", "n", "shapley"),
    )
    return x.join(F.broadcast(_orders(spark)), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
