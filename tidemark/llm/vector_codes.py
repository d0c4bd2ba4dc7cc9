"""Vector code compression: product codes by exact integer k-means, with LAESA pivots that spare distances.

Vectors become integers and are cut into parts; each part position has a codebook. The distances of each part to a few
fixed pivots of its position are computed once and kept beside the vector. In every round the distances of the pivots to
the entries give a lower bound for each entry (triangle inequality): entries are tried in the order of their bounds, and
a part's search ends at the first bound beyond the best exact distance. All comparisons that decide are of integers.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Shorter vectors are filled with
zeros up to the longest, and all up to a multiple of the number of parts. Components beyond 65,536 in size count as that,
so that sums of squares fit in 64 bits. Equal vec_ids are ordered by their vectors, null ids come last. Fewer than 64
vectors give as many entries. No vectors: no rows. Other columns, of any name, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_join, cut, slices

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SCALE, MOST = 256, 1 << 24
#: More than what rounding can add to a bound.
SLACK = 1e-3
ROWS = 4096


def integers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q): the kept vectors as integers."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    q = F.transform(x, lambda v: F.floor(F.least(F.lit(float(MOST)), F.greatest(F.lit(float(-MOST)), v.cast("double") * SCALE))).cast("int"))
    return rows.where(x.isNotNull() & ~odd).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), q.alias("q"))


def pivots_of(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n of a part's first entries, each farthest from those before it; (n, width)."""
    chosen = [0]
    far = ((entries - entries[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((entries - entries[chosen[-1]]) ** 2).sum(1))
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the rows of x (n, width) with distances to_pivots (n, pivots): nearest entry (the first of equals), squared distance; and how many were computed."""
    between = np.sqrt(((pivots[:, None] - entries[None]) ** 2).sum(2).astype(float))
    low = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(to_pivots[:, p, None] - between[p]), out=low)
    order = np.argsort(low, axis=1)
    low = np.maximum(np.take_along_axis(low, order, 1) - SLACK, 0) ** 2
    best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    live, computed = np.arange(len(x)), 0
    for k in range(len(entries)):
        live = live[low[live, k] <= best[live]]  # an equal bound may still be a tie with a lower index
        if not len(live):
            break
        e = order[live, k]
        d = ((x[live] - entries[e]) ** 2).sum(1)
        computed += len(live)
        better = (d < best[live]) | (d == best[live]) & (e < which[live])
        best[live[better]], which[live[better]] = d[better], e[better]
    return which, best, computed


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width) of lists, filled with zeros."""
    lists = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(q.offsets.to_numpy())
    if (sizes == PARTS * width).all():
        return lists.reshape(len(q), PARTS, width)
    out = np.zeros((len(q), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = lists
    return out.reshape(len(q), PARTS, width)


def _measured(width: int, pivots: np.ndarray):
    """Adds the squared distances of each part to its pivots, by part and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            x = _matrix(b.column("q"), width)
            d = ((x[:, :, None] - pivots[None]) ** 2).sum(3).reshape(len(x), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), lists], ["vec_id", "label", "q", "to_pivots"])

    return run


def _found(batches: Iterator[pa.RecordBatch], width: int, books: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    """(batch, its parts, nearest entries (rows, PARTS), squared distances) of each batch."""
    for b in slices(batches, ROWS):
        x = _matrix(b.column("q"), width)
        to = np.sqrt(b.column("to_pivots").flatten().to_numpy().reshape(len(x), PARTS, -1).astype(float))
        got = [nearest(x[:, j], to[:, j], books[j], pivots[j]) for j in range(PARTS)]
        yield b, x, np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)


def _summed(width: int, books: np.ndarray, pivots: np.ndarray):
    """Counts and sums of the parts of each entry; a row for each entry that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, x, which, _ in _found(batches, width, books, pivots):
            for j in range(PARTS):
                n[j] += np.bincount(which[:, j], minlength=books.shape[1])
                np.add.at(s[j], which[:, j], x[:, j])
        part, entry = np.nonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(s[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), sums], ["part", "entry", "n", "s"])

    return run


def _coded(width: int, books: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, which, far in _found(batches, width, books, pivots):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in which.astype(np.uint8)], pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    return run


def improved(rows: DataFrame, width: int, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the mean of its parts. The driver gets a row an entry."""
    each = rows.mapInArrow(_summed(width, books, pivots), "part int, entry int, n long, s array<long>")
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect():
        out[r.part, r.entry] = [v // r.n for v in r.s]
    return out


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept vector."""
    whole = integers(vectors, vec_id, vector, label)
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    seeds = [r.q for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()]
    width = max(1, -(-(whole.agg(F.max(F.size("q"))).first()[0] or 0) // PARTS))
    books = np.zeros((PARTS, len(seeds), width), np.int64)
    for k, q in enumerate(seeds):
        books[:, k] = np.array([*q, *[0] * (PARTS * width - len(q))], np.int64).reshape(PARTS, width)
    coded = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not seeds:
        return vectors.sparkSession.createDataFrame([], f"{coded}, label_error long, codebooks_sha256 string")
    pivots = np.stack([pivots_of(books[j]) for j in range(PARTS)])
    rows = cut(whole.mapInArrow(_measured(width, pivots), f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<int>, to_pivots array<long>"), "pivots")
    for _ in range(ROUNDS):
        books = improved(rows, width, books, pivots)
    codes = cut(rows.mapInArrow(_coded(width, books, pivots), coded), "codes")
    codes = codes.withColumns({"_l": F.coalesce(F.col("label").cast("string"), F.lit("")), "_n": F.col("label").isNull()})
    sums = cut(codes.groupBy("_l", "_n").agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return checked_join(codes, sums, ["_l", "_n"]).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to the codebook c{k}: a{k}(id, p, v, e, d)."""
    return f"""near{k} AS (SELECT id, x.p, min((list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.e)) AS m FROM parts x JOIN c{k} c ON x.p = c.p GROUP BY id, x.p),
a{k} AS (SELECT id, p, v, CAST(m[1] AS BIGINT) AS d, m[2] AS e FROM near{k} JOIN parts USING (id, p))"""


def _next(k: int) -> str:
    return f"""u{k} AS (SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{k - 1}, (SELECT unnest(generate_series(1, (SELECT max(len(v)) FROM parts))) AS i) GROUP BY p, e, i),
n{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM u{k} GROUP BY p, e),
c{k} AS (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{k - 1} c LEFT JOIN n{k} n ON c.p = n.p AND c.e = n.e)"""


SQL = f"""
WITH ints AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, p, q[p * len(q) // 16 + 1:(p + 1) * len(q) // 16] AS v FROM ints, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, id AS e, v FROM parts WHERE id < 64),
{_round(0)}, {_next(1)}, {_round(1)}, {_next(2)}, {_round(2)},
done AS (SELECT id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256 FROM ints JOIN done USING (id)
"""
