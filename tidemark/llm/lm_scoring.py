"""Language-model scores by deleted interpolation.

A bigram model over words: the maximum-likelihood estimates of a word after its
predecessor, of the word alone, and the uniform one, mixed with weights that
depend on how frequent the context is. The weights are learned by expectation
maximisation on counts held out from the training documents: a tenth of them is
set apart, the estimates of the other nine tenths are mixed to fit it best, and
the final model uses those weights with the counts of all training documents.

Spark carries it so: documents become batches of word indexes (a written
table); every batch sends its distinct n-gram hashes and counts to buckets of
the hash space, buckets add the counts up over the corpus and send each batch
the totals of its own n-grams back, in the order of the hashes. Traffic and
work follow the input; no task, and not the driver, holds the model. What comes
to the driver for the mixture weights is a histogram of bounded size: contexts'
frequency class by the two estimates on a log scale.

Cases: null text is empty and has one token, the end; a null id counts as the
empty text for the folds; repeated rows are documents of their own; empty
tables give none; with no training documents the uniform estimate remains.
Texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices

HELD, FOLDS = 2, 7
#: Of the training documents, one in TUNING is set apart for the weights.
TUNING = 10
BATCH_TOKENS = 1_000_000
BUCKET_KEYS = 1_000_000
END, START = np.uint64(1), np.uint64(2)
CLASSES = 20  # of context frequency, by powers of two; the first is for unseen contexts
OCTAVES, FINE = 26, 4  # bins of an estimate's logarithm; one more for zero
BINS = OCTAVES * FINE + 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BATCH = "batch long, fold int, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary, n long"
_NAMES = ["batch", "fold", "doc_ids", "held", "sizes", "words", "tokens", "n"]


def fold_of(doc_id: int | None) -> int:
    """2: not trained on; 1: trained on, and set apart while the weights are learned; 0: the rest."""
    c = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return 2 if c % FOLDS == HELD else 1 if c // FOLDS % TUNING == 0 else 0


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as batches of indexes into the batch's sorted word hashes; the set-apart ones in batches of their own."""
    import xxhash
    import zstandard
    from pyspark import TaskContext

    z = zstandard.ZstdCompressor(level=1)
    number = TaskContext.get().partitionId() << 24
    open_: dict[int, tuple] = {}

    def flush(fold: int) -> pa.RecordBatch:
        nonlocal number
        place, hashes, ids, held, sizes, tokens = open_.pop(fold)
        words = np.array(hashes, np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[np.array(tokens, np.int64)]
        number += 1
        row = [[number], [fold], [ids], [held], [sizes], [words[order].tobytes()], [z.compress(tokens.tobytes())], [len(tokens)]]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], _NAMES)

    for b in slices(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            fold = fold_of(doc)
            apart = int(fold == 1)
            if apart not in open_:
                open_[apart] = ({None: 0}, [int(END)], [], [], [], [])
            place, hashes, ids, held, sizes, tokens = open_[apart]
            words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
            for w in words:
                k = place.get(w)
                if k is None:
                    k = place[w] = len(hashes)
                    hashes.append(xxhash.xxh3_64_intdigest(w) | 4)
                tokens.append(k)
            tokens.append(0)
            ids.append(doc)
            held.append(fold == 2)
            sizes.append(len(words) + 1)
            if len(tokens) >= BATCH_TOKENS:
                yield flush(apart)
    for fold in list(open_):
        yield flush(fold)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that a task holds the words of a single batch of documents."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


class Grams:
    """A batch's distinct n-grams: sorted keys (odd: words, even: word pairs), and where each token's lie among them."""

    def __init__(self, row: dict) -> None:
        import zstandard

        words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32).astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        n = len(words)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = n  # the start of a document
        self.before = before
        pairs, self.pair = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        first = np.append(words, START)[pairs // (n + 1)]
        second = words[pairs % (n + 1)]
        odd = lambda x: self._mix(x) | np.uint64(1)
        with np.errstate(over="ignore"):
            both = self._mix(first * np.uint64(0x9E3779B97F4A7C15) + self._mix(second)) & ~np.uint64(1)
        keys = np.concatenate([odd(words), np.array([START * np.uint64(2) + np.uint64(1)]), both])
        self.keys, where = np.unique(keys, return_inverse=True)
        self.word, self.pair = where[: n + 1], where[n + 1 :][self.pair]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
            return x ^ (x >> np.uint64(33))

    def counts(self, held: np.ndarray) -> np.ndarray:
        """How often each key occurs in the documents that are not held out; the start counts once a document."""
        use = np.repeat(~held, self.sizes)
        out = np.bincount(self.word[self.tokens[use]], minlength=len(self.keys))
        out += np.bincount(self.pair[use], minlength=len(self.keys))
        out[self.word[-1]] += int((~held).sum())
        return out


def _send(buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def send(row: dict) -> pa.RecordBatch:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        g = Grams(row)
        n = g.counts(np.array(row["held"], bool)).astype(np.uint32)
        edges = np.searchsorted((g.keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(g.keys), np.int64), np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            i, j = edges[k], edges[k + 1]
            if i < j:
                gaps = np.diff(g.keys[i:j], prepend=np.uint64(0))
                rows.append((k, row["batch"], row["fold"], z.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes()), z.compress(n[i:j].view(np.uint8).reshape(-1, 4).T.tobytes())))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "batch", "fold", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield send(row)

    return run


def _planes(blob: bytes, width: int, kind: type) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one bucket: to each batch the totals of its keys without (base) and with (all) the set-apart documents."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    rows = table.to_pylist()
    keys = [np.cumsum(_planes(r["keys"], 8, np.uint64), dtype=np.uint64) for r in rows]
    counts = [_planes(r["counts"], 4, np.uint32).astype(np.int64) for r in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    apart = np.concatenate([np.full(len(k), r["fold"] == 1) for k, r in zip(keys, rows, strict=True)])
    n = np.concatenate(counts)
    every = np.bincount(where, weights=n, minlength=len(distinct)).astype(np.uint32)
    base = np.bincount(where, weights=np.where(apart, 0, n), minlength=len(distinct)).astype(np.uint32)
    words = (distinct & np.uint64(1) == 1) & (distinct != START * np.uint64(2) + np.uint64(1))
    out, at = [], 0
    for k, r in zip(keys, rows, strict=True):
        w = where[at : at + len(k)]
        at += len(k)
        pack = lambda x: z.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes())
        out.append({"batch": r["batch"], "bucket": r["bucket"], "base": pack(base[w]), "every": pack(every[w]), "v_base": 0, "v_every": 0, "n_base": 0, "n_every": 0})
    out[0] |= {"v_base": int((base[words] > 0).sum()), "v_every": int((every[words] > 0).sum()), "n_base": int(base[words].sum(dtype=np.int64)), "n_every": int(every[words].sum(dtype=np.int64))}
    return pa.Table.from_pylist(out, schema=_TOTALS)


_TOTALS = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("base", pa.binary()), ("every", pa.binary()), *((k, pa.int64()) for k in ("v_base", "v_every", "n_base", "n_every"))])


def _estimates(g: Grams, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: frequency class of its context, estimate after the context, estimate alone."""
    context = total[g.word[g.before]].astype(np.float64)
    kind = np.minimum(CLASSES - 1, np.ceil(np.log2(context + 1))).astype(np.int64)
    return kind, total[g.pair] / np.maximum(context, 1), total[g.word[g.tokens]] / max(1, n)


def _totals(row: dict, name: str) -> np.ndarray:
    return np.concatenate([_planes(p[name], 4, np.uint32) for p in sorted(row["totals"], key=lambda p: p["bucket"])]).astype(np.int64)


def _histogram(n_base: int):
    def bins(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            k = np.floor(-np.log2(p) * FINE)
        return np.where(p > 0, np.clip(k, 0, BINS - 2) + 1, 0).astype(np.int64)

    def count(row: dict) -> pa.RecordBatch:
        kind, p2, p1 = _estimates(Grams(row), _totals(row, "base"), n_base)
        cells, where = np.unique((kind * BINS + bins(p2)) * BINS + bins(p1), return_inverse=True)
        sums = [np.bincount(where), np.bincount(where, weights=p2), np.bincount(where, weights=p1)]
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["cell", "n", "p2", "p1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield count(row)

    return run


def weights(cells: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (class, 3) by expectation maximisation over the held-out histogram; p2, p1: means of the cells."""
    kind = cells // (BINS * BINS)
    w = np.tile(np.array([0.4, 0.4, 0.2]), (CLASSES, 1))
    p = np.stack([p2, p1, np.full(len(n), p0)], axis=1) if len(n) else np.zeros((0, 3))
    for _ in range(rounds if len(n) else 0):
        share = w[kind] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(kind, weights=share[:, k], minlength=CLASSES) for k in range(3)], axis=1) + [1e-3, 1e-3, 1e-3]
        w = new / new.sum(axis=1, keepdims=True)
    w[0, 1:] += w[0, 0] / 2  # an unseen context has no estimate
    w[0, 0] = 0
    return w


def _score(w: np.ndarray, n: int, v: int):
    def judge(row: dict) -> pa.RecordBatch:
        g, total = Grams(row), _totals(row, "every")
        kind, p2, p1 = _estimates(g, total, n)
        c = total[g.word[g.tokens]]
        per = lambda x: np.add.reduceat(x, g.starts)
        base = per(np.log10((c + 1) / (n + v + 1)))
        score = per(np.log10(w[kind, 0] * p2 + w[kind, 1] * p1 + w[kind, 2] / (v + 1)))
        return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(g.sizes), pa.array(per((c > 0).astype(np.int64))), pa.array(np.full(len(g.sizes), n, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield judge(row)

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text)."""
    corpus = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_batches, _BATCH), "corpus")
    tokens = corpus.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, tokens / BUCKET_KEYS)))))
    sent = corpus.mapInArrow(_send(buckets), "bucket int, batch long, fold int, keys binary, counts binary")
    totals = cut(sent.groupBy("bucket").applyInArrow(_add_up, "batch long, bucket int, base binary, every binary, v_base long, v_every long, n_base long, n_every long"), "totals")
    size = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v_base", "v_every", "n_base", "n_every")]).first()
    grouped = totals.groupBy("batch").agg(F.collect_list(F.struct("bucket", "base", "every")).alias("totals"))
    both = corpus.join(grouped, "batch")
    cells = both.where("fold = 1").mapInArrow(_histogram(size["n_base"]), "cell long, n long, p2 double, p1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    found = cells.toArrow()  # at most CLASSES * BINS * BINS rows
    cell, n, p2, p1 = (found.column(c).to_numpy() for c in ("cell", "n", "p2", "p1"))
    w = weights(cell, n, p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), 1 / (size["v_base"] + 1))
    return both.mapInArrow(_score(w, size["n_every"], size["v_every"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
