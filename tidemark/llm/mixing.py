"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives each document posterior
probabilities of the domains: naive Bayes over binned text measures, two of
which come from tables of log ratios of hashed word beginnings. Nonnegative document
rates are then fitted by projected-gradient least squares so that the expected
tokens of each domain, the sum over documents of rate x tokens x posterior,
match the targets. All rates start at 1. A step moves every rate against its
gradient, in a metric that is diagonal (a document's tokens, a domain's mass),
and the projection is the lazy one: a rate is the nonnegative part of the sum of
its moves. A document's moves all lie along its posteriors, so the whole state
is one multiplier a domain, and a step is one distributed aggregation of the
domain totals.

DataFrame functions only. Cases: null text is empty and has no tokens; null
labels are not learned from; with no labelled rows the posteriors are the flat
prior; a domain that no document can belong to stays short of its target by
least squares; repeated rows get equal rates; empty tables give none; columns
of any name are carried through mixed() untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
#: Labelled rows at most from which the classifier is learned (those with the smallest hashes of doc_id).
FIT_ROWS = 4000
#: Letters of a word's beginning, buckets of hashed beginnings, and quantile bins of a measure.
STEM = 5
BUCKETS = 1 << 15
BINS = 16
#: Steps at most, and the difference from every target (as a share of all tokens) at which they end.
STEPS, TOLERANCE = 60, 1e-4
_WORD = r"[\x20\x09-\x0D]+"
#: The characters that each measure counts.
_COUNTED = {"symbols": "#*$%&|<>", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": "!?", "digits": "0123456789"}
#: One mark a kind of counted character, and a last one that stands for marks in the text itself.
_MARKS = "\x01\x02\x03\x04\x05"
MEASURES = (*_COUNTED, "width", "repeats", "low_words", "toxic_words")


@dataclass(frozen=True)
class Model:
    words: tuple[tuple[float, ...], tuple[float, ...]]  # log ratios of each bucket: low over clean, toxic over the rest
    edges: dict[str, tuple[float, ...]]  # measure -> lower edges of its bins but the first
    prior: tuple[float, ...]  # log
    tables: dict[str, tuple[tuple[float, ...], ...]]  # measure -> domain -> bin, log


def _values(numbers: tuple[float, ...]) -> Column:
    """One constant array: parsed once when the plan is made, whatever its length."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in numbers)), ",").cast("array<double>")


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _WORD), lambda w: w != "")


def _stems(words: Column) -> Column:
    """The buckets of the beginnings of words, each once."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(F.substring(w, 1, STEM))), F.lit(BUCKETS)).cast("int") + 1))


def _summed(table: Column) -> Column:
    return F.aggregate("_k", F.lit(0.0), lambda a, k: a + F.element_at(table, k))


def measures(docs: DataFrame, words: tuple[tuple[float, ...], tuple[float, ...]]) -> DataFrame:
    """docs(text, ...) with n_tokens and each measure (_v_*)."""
    other, many = _MARKS[-1], list(zip(_COUNTED.values(), _MARKS, strict=False))
    marked = F.translate("_t", "".join(c for c, _ in many) + _MARKS, "".join(mark * len(c) for c, mark in many) + other * len(_MARKS))  # one pass for all counted characters
    x = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_m", marked).withColumn("_w", _split(F.col("_t"))).withColumn("_k", _stems(F.col("_w")))
    chars, tokens, stems = (F.greatest(n, F.lit(1)) for n in (F.length("_t"), F.size("_w"), F.size("_k")))
    value = {k: (F.length("_m") - F.length(F.replace("_m", F.lit(mark)))) / chars for k, mark in zip(_COUNTED, _MARKS, strict=False)}
    value["width"] = F.length("_t") / tokens
    value["repeats"] = tokens / F.greatest(F.size(F.array_distinct("_w")), F.lit(1))
    sums = [_summed(_values(t)) for t in words]
    value["low_words"], value["toxic_words"] = sums[0] / stems, sums[1]  # the tone of all words: their mean; toxic words are few: their sum
    return x.select(*docs.columns, F.size("_w").cast("long").alias("n_tokens"), *[v.cast("double").alias(f"_v_{k}") for k, v in value.items()])


def known(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    return labels.where("doc_id is not null").select("doc_id", domain.alias("domain")).where("domain is not null")


def sample_of(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, domain) of the labelled rows that are learned from: a written table of at most fit_rows labels."""
    chosen = known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")


def learn_words(sample: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Log ratios of the documents with a word of each bucket; at most BUCKETS rows come to the driver.

    low over clean for every bucket; toxic over the rest where it is over 4 and
    at least 4 toxic documents have it, else 0.
    """
    n = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    size = [n.get(d, 0) for d in range(len(DOMAINS))]
    bucket = F.explode(_stems(_split(F.coalesce("text", F.lit(""))))).alias("bucket")
    low, toxic = [0.0] * BUCKETS, [0.0] * BUCKETS
    for r in sample.select("domain", bucket).groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(len(DOMAINS))]).collect():
        share = [(r[f"n{d}"] + 0.5) / (size[d] + 1) for d in range(len(DOMAINS))]
        low[r.bucket - 1] = math.log(share[1] / share[0])
        odds = math.log(share[2] / ((r.n0 + r.n1 + 0.5) / (size[0] + size[1] + 1)))
        toxic[r.bucket - 1] = odds if odds > math.log(4) and r.n2 >= 4 else 0.0
    return tuple(low), tuple(toxic)


def _bin(k: str, edges: tuple[float, ...]) -> Column:
    return F.size(F.filter(_values(edges), lambda e: F.col(f"_v_{k}") > e)) + 1 if edges else F.lit(1)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Words from one half of the sample, bins and their shares from the other, on which the words are not fitted."""
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    sample = sample_of(docs, labels)
    words = learn_words(sample.where(half == 0))
    seen = cut(measures(sample.where(half == 1), words).drop("text"), "seen")
    cuts = [k / BINS for k in range(1, BINS)]
    found = seen.agg(*[F.percentile_approx(f"_v_{k}", cuts, 10_000).alias(k) for k in MEASURES]).first()
    edges = {k: tuple(sorted(set(found[k] or ()))) for k in MEASURES}
    each = seen.select("domain", F.posexplode(F.array(*[_bin(k, edges[k]) for k in MEASURES])).alias("measure", "bin"))
    counts = {(r.domain, r.measure, r.bin): r.n for r in each.groupBy("domain", "measure", "bin").agg(F.count("*").alias("n")).collect()}
    size = [sum(n for (dom, m, _), n in counts.items() if dom == d and m == 0) for d in range(len(DOMAINS))]
    prior = tuple(math.log((n + 1) / (sum(size) + len(DOMAINS))) for n in size)
    tables = {k: tuple(tuple(math.log((counts.get((d, i, b), 0) + 0.5) / (size[d] + 0.5 * (len(edges[k]) + 1))) for b in range(1, len(edges[k]) + 2)) for d in range(len(DOMAINS))) for i, k in enumerate(MEASURES)}
    return Model(words, edges, prior, tables)


def posteriors(measured: DataFrame, model: Model) -> DataFrame:
    """measured with the array _p of the domains' probabilities in place of the measures."""
    logs = F.array(*[sum((F.element_at(_values(t[d]), _bin(k, model.edges[k])) for k, t in model.tables.items()), F.lit(model.prior[d])) for d in range(len(DOMAINS))])
    powers = _let(logs, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    shares = _let(powers, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))
    return measured.select(*[c for c in measured.columns if not c.startswith("_v_")], shares.alias("_p"))


def _named() -> list[Column]:
    return [F.col("_p")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)]


def rate(multipliers: list[float], p: Column | None = None) -> Column:
    """The nonnegative part of 1 + multipliers . posteriors.

    The multipliers stand in one array value, which isn't part of the generated
    code: all steps of a fit share one compiled plan.
    """
    p = F.array(*[F.col(f"p_{d}") for d in DOMAINS]) if p is None else p
    return F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, F.lit(multipliers), lambda x, m: x * m), F.lit(1.0), lambda a, x: a + x))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS) -> list[float]:
    """The multipliers after the steps of projected gradient for members(n_tokens, p_*); one aggregation a step.

    The objective is half the squared distance of the domain totals from the
    targets, each domain in units of its mass. Its gradient by a document's
    rate is tokens x (posteriors . differences), so a step in the metric of the
    tokens moves the multipliers by the differences alone. Steps carry momentum,
    dropped where they led away.
    """
    k, t = len(DOMAINS), F.col("n_tokens").cast("double")
    p = [F.col(f"p_{d}") for d in DOMAINS]
    first = members.agg(F.sum(t).alias("t"), *[F.sum(t * p[i] * p[j]).alias(f"h{i}{j}") for i in range(k) for j in range(k)]).first()
    total, whole = first["t"] or 0.0, sum(targets.values())
    now = [0.0] * k
    if not total:
        return now
    h = [[first[f"h{i}{j}"] / total for j in range(k)] for i in range(k)]
    scale = [1.0 / (h[i][i] + 1e-9) for i in range(k)]
    # The step's length: 1 over the largest eigenvalue of the scaled curvature, by power iteration.
    v, top = [1.0] * k, 1.0
    for _ in range(100):
        w = [scale[i] * sum(h[i][j] * v[j] for j in range(k)) for i in range(k)]
        top = max(map(abs, w)) or 1.0
        v = [x / top for x in w]
    best, least, at, since = now, math.inf, now, 0
    for _ in range(steps):
        sums = members.select(t.alias("t"), *p, rate(at).alias("r")).agg(*[F.sum(F.col("t") * F.col("r") * p[i]).alias(f"e{i}") for i in range(k)]).first()
        left = [sums[f"e{i}"] / total - targets[d] / whole for i, d in enumerate(DOMAINS)]
        size = max(map(abs, left))
        if size < least:
            best, least = at, size
        if size < TOLERANCE:
            break
        moved = [a - x * s / top for a, x, s in zip(at, left, scale, strict=True)]
        since = 0 if size > 2 * least else since + 1
        at = [m + since / (since + 3) * (m - n) for m, n in zip(moved, now, strict=True)]
        now = moved
    return best


def copies(rate_: Column, salt: Column) -> Column:
    """A whole number of copies with the rate as its expectation: the same for the same row."""
    chance = F.pmod(F.xxhash64(salt, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return _let(rate_, lambda r: F.floor(r) + F.when(chance < r - F.floor(r), 1).otherwise(0)).cast("int")


def whole_rate(multipliers: list[float], p: Column | None = None) -> Column:
    """The rates scaled so that clean documents never fall below 1: others are repeated or thinned instead.

    All rates are divided by a clean document's where that is below 1, and a
    document that is clean more likely than not gets 1 at least.
    """
    p = F.array(*[F.col(f"p_{d}") for d in DOMAINS]) if p is None else p
    clean = 1.0 + multipliers[0]
    share = clean if 0 < clean < 1 else 1.0
    return _let(p, lambda q: _let(rate(multipliers, q) / share, lambda r: F.when(q[0] >= 0.5, F.greatest(F.lit(1.0), r)).otherwise(r)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, p_*, rate, copies) for each row of docs(doc_id, text)."""
    model = learn(docs, labels)
    # The measures are written once, and the memberships too, so that a step of the fit is a small plan.
    measured = cut(measures(docs.select("doc_id", "text"), model.words).drop("text"), "measured")
    members = cut(posteriors(measured, model).select("doc_id", "n_tokens", *_named()), "members")
    return members.withColumn("rate", rate(fit_rates(members, targets))).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, learn_from: DataFrame | None = None) -> DataFrame:
    """docs, each row as often as its copies at the whole rate say. learn_from: labelled documents, where docs are filtered ones.

    The rows are written once beside their measures; the last pass reads them with the fitted multipliers.
    """
    model = learn(docs if learn_from is None else learn_from, labels)
    rows = cut(measures(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), model.words).drop("text"), "rows")
    members = cut(posteriors(rows.drop("_row"), model).select("n_tokens", *_named()), "members")
    n = copies(whole_rate(fit_rates(members, targets), F.col("_p")), F.col("doc_id"))
    return posteriors(rows, model).select("_row", F.explode(F.array_repeat(F.lit(1), n))).select("_row.*")
