"""Quality classifier by hierarchical empirical Bayes.

A document classifier (logistic regression over hashed words, their beginnings
and binned text measures, fitted on a bounded sample of labelled rows) gives each document the
probabilities of good quality and of toxicity. Grouped aggregations turn these
into site posteriors: a host's mean is shrunk toward the global mean, a path's
mean toward its host's, each with a prior strength estimated by the method of
moments from the spread between groups, so that sparse sites fall back on the
level above. A document's log odds are then shifted by what its site says
without it: its own evidence is left out of its host's and its path's sums, so
that nothing counts twice. Documents here have no URL: the host is their source
and the path below it their language, unless other columns are named.

Cases: a null text counts as empty; null hosts and paths are groups of their
own; a document table without labels, or with one class only, keeps the global
prior as evidence; repeated rows get equal results; empty tables give none.
Columns named like the added ones (p_quality, p_toxic, site_* and post_* of
both, score, keep) are replaced; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, slices

#: Labelled rows at most that the document classifier is fitted on (those with the smallest hashes of doc_id).
FIT_ROWS = 8000
BITS = 18
#: Words that fewer of the sample's documents hold carry no weight.
MIN_DOCS = 8
#: Buckets at a time in a fitting step, which bounds what it holds beside the sample.
BLOCK = 500_000
#: Bytes of a word's beginning that count as a feature beside the word.
PREFIX = 4
SITE_WEIGHT = 0.5
#: A site table of up to this many rows is broadcast (about 200 bytes a row); beyond it a site's documents are spread over salted keys.
SITES, SALTS = 100_000, 16
ADDED = ("p_quality", "p_toxic")
_RESULTS = [f"{a}_{c}" for a in ("site", "post") for c in ADDED] + ["score", "keep"]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EDGES = b".,;:!?\"'()[]"
_UPPER = bytes(range(65, 91))
_MEASURES = 8


def measures(text: bytes, words: list[bytes]) -> list[int]:
    """Binned text measures, as bucket numbers of their own above the hashed words."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words))
    level = lambda x: int(min(15, max(0, round(x))))
    values = (
        level(2 * np.log2(n)),
        level(15 * sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) / n),
        level(30 * (chars - len(text.translate(None, _UPPER))) / chars),
        level(30 * text.count(b"!") / n),
        level(3 * np.log2(n / max(1, distinct))),
        level(15 * (1 - len(set(lines)) / max(1, len(lines)))),
        level(chars / n),
        level(40 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
    )
    return [(1 << BITS) + 16 * k + v for k, v in enumerate(values)]


def buckets(text: str | None, known: dict[bytes, tuple[int, int]]) -> list[int]:
    import zlib

    t = (text or "").encode("utf-8", "surrogatepass")
    words = t.translate(_LOWER).split()
    if len(known) > 150_000:
        known.clear()
    found = set()
    for w in set(words):
        b = known.get(w)
        if b is None:
            x = w.strip(_EDGES)
            b = known[w] = (zlib.crc32(x) & ((1 << BITS) - 1), zlib.crc32(b"^" + x[:PREFIX]) & ((1 << BITS) - 1))
        found.update(b)
    return [*found, *measures(t, words)]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, tuple[int, int]] = {}
    for x in slices(batches):
        rows = [sorted(buckets(t, known)) for t in x.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column("quality"), x.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["quality", "toxic", "buckets"])


def logistic(idx: np.ndarray, doc: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and intercept over all buckets, from the buckets of each document and its number; plain full-batch Adam."""
    size = (1 << BITS) + 16 * _MEASURES
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    often = np.bincount(idx, minlength=size) >= MIN_DOCS
    names = np.flatnonzero(often)
    place = np.cumsum(often, dtype=np.int32) - 1
    held = often[idx]
    idx, doc = place[idx[held]], doc[held]
    blocks = [slice(at, at + BLOCK) for at in range(0, len(idx), BLOCK)]
    w, b = np.zeros(len(names)), 0.0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes count alike while fitting
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        z = sum((np.bincount(doc[s], weights=w[idx[s]], minlength=len(y)) for s in blocks), np.full(len(y), b))
        e = weight * (1 / (1 + np.exp(-z)) - y) / len(y)
        g = sum((np.bincount(idx[s], weights=e[doc[s]], minlength=len(w)) for s in blocks), ridge * w)
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**k, 1 - 0.99**k
        w -= 0.08 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= 0.08 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    out = np.zeros(size, np.float32)
    out[names] = w
    return out, float(b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple:
    """((weights, intercept) for quality, the same for toxicity) from at most fit_rows labelled rows."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "toxic")
    found = sample.mapInArrow(_buckets, "quality int, toxic int, buckets array<int>").toArrow()
    lists = found.column("buckets").combine_chunks()
    idx = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    y = [found.column(c).to_numpy().astype(float) for c in ("quality", "toxic")]
    return logistic(idx, doc, y[0]), logistic(idx, doc, y[1])


def evidence(docs: DataFrame, model: tuple, keep_text: bool = True) -> DataFrame:
    """docs with the classifier's p_quality and p_toxic."""
    docs = docs.drop(*ADDED)
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    (wq, bq), (wt, bt) = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        for x in slices(batches):
            z = []
            for t in x.column("text").to_pylist():
                i = np.array(buckets(t, known), np.int64)
                z.append((float(wq[i].sum()) + bq, float(wt[i].sum()) + bt))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float).reshape(-1, 2), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in kept), pa.array(p[:, 0]), pa.array(p[:, 1])], [*(f.name for f in kept), *ADDED])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in ADDED)]))


def sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(site_host, site_path, and for each evidence its shrunk site posterior, the global mean, and what both come from)."""
    by = scored.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("site_host"), F.coalesce(F.col(path).cast("string"), F.lit("\x00")).alias("site_path"))
    paths = cut(by.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ADDED]), "paths")
    hosts = cut(paths.groupBy("site_host").agg(F.sum("n").alias("host_n"), *[F.sum(f"sum_{c}").alias(f"host_sum_{c}") for c in ADDED]), "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), F.count("*").alias("k"), *[F.sum(f"host_sum_{c}").alias(c) for c in ADDED]).first()
    n = total["n"] or 0
    mean = {c: min(1 - 1e-4, max(1e-4, (total[c] or 0.0) / max(1, n))) for c in ADDED}

    def strength(df: DataFrame, size: str, own: str, above: F.Column | float, mu: float) -> float:
        """Prior strength in documents: the spread of group means beyond what sampling explains, by moments."""
        gap = F.col(own) / F.col(size) - above
        row = df.agg(F.sum(F.col(size) * gap * gap).alias("s"), F.count("*").alias("k"), F.sum(size).alias("n"), F.sum(F.col(size) * F.col(size)).alias("nn")).first()
        if not row["k"] or row["k"] < 2 or not row["n"]:
            return 1e6
        within = mu * (1 - mu)
        spread = (row["s"] - (row["k"] - 1) * within) / max(1.0, row["n"] - row["nn"] / row["n"])
        return 1e6 if spread <= within * 1e-6 else min(1e6, max(1.0, within / spread - 1))

    for c in ADDED:
        s = strength(hosts, "host_n", f"host_sum_{c}", F.lit(mean[c]), mean[c])
        hosts = hosts.withColumn(f"host_prior_{c}", F.lit(s)).withColumn(f"host_{c}", (F.col(f"host_sum_{c}") + s * mean[c]) / (F.col("host_n") + s))
    both = cut(paths.join(hosts, "site_host"), "both")
    for c in ADDED:
        s = strength(both, "n", f"sum_{c}", F.col(f"host_{c}"), mean[c])
        both = both.withColumn(f"prior_{c}", F.lit(s)).withColumn(f"site_{c}", (F.col(f"sum_{c}") + s * F.col(f"host_{c}")) / (F.col("n") + s)).withColumn(f"all_{c}", F.lit(mean[c]))
    return cut(both, "sites")


def _decided(scored: DataFrame, place: DataFrame, host: str, path: str) -> DataFrame:
    """scored with the site posteriors (of the other documents), the combined ones, score and keep.

    A site table of at most SITES rows is broadcast; a larger one is joined,
    with the documents of a site spread over SALTS keys.
    """
    names = [c for c in scored.columns if c not in _RESULTS]
    where = [F.coalesce(F.col(host).cast("string"), F.lit("\x00")), F.coalesce(F.col(path).cast("string"), F.lit("\x00"))]
    rows = scored.select(where[0].alias("site_host"), where[1].alias("site_path"), *[F.col(c).alias(f"own_{c}") for c in ADDED], F.struct(*names).alias("_in"))
    if place.count() <= SITES:
        x = rows.join(F.broadcast(place), ["site_host", "site_path"])
    else:
        spread = place.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        x = rows.withColumn("salt", F.pmod(F.xxhash64("_in"), F.lit(SALTS)).cast("int")).join(spread, ["site_host", "site_path", "salt"])
    logit = lambda c: F.log(F.greatest(F.lit(1e-9), c) / F.greatest(F.lit(1e-9), 1 - c))
    for c in ADDED:
        own = F.col(f"own_{c}")
        above = (F.col(f"host_sum_{c}") - own + F.col(f"host_prior_{c}") * F.col(f"all_{c}")) / (F.col("host_n") - 1 + F.col(f"host_prior_{c}"))
        x = x.withColumn(f"site_{c}", (F.col(f"sum_{c}") - own + F.col(f"prior_{c}") * above) / (F.col("n") - 1 + F.col(f"prior_{c}")))
        z = logit(own) + SITE_WEIGHT * (logit(F.col(f"site_{c}")) - logit(F.col(f"all_{c}")))
        x = x.withColumn(f"post_{c}", 1 / (1 + F.exp(-z)))
    x = x.withColumn("score", F.col("post_p_quality") * (1 - F.col("post_p_toxic"))).withColumn("keep", (F.col("post_p_quality") >= 0.5) & (F.col("post_p_toxic") < 0.5))
    return x.select("_in.*", *_RESULTS)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_text: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with p_quality, p_toxic, the site posteriors, score (posterior of good and not toxic) and keep."""
    scored = cut(evidence(docs, fit(docs, labels, fit_rows), keep_text), "scored")
    place = sites(scored, host, path)
    return _decided(scored, place, host, path)


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that classify() keeps, in their own columns; texts are classified as they pass, and not stored."""
    names = docs.columns
    model = fit(docs, labels)
    place = sites(cut(evidence(docs.select("text", host, path), model, keep_text=False), "scored"), host, path)
    rows = docs.select(F.col("text"), F.col(host).alias("_host"), F.col(path).alias("_path"), F.struct(*names).alias("_row"))
    x = _decided(evidence(rows, model), place, "_host", "_path")
    return x.where("keep").select("_row.*")
