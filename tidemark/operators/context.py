"""Content type and structure of a job, by keyword and pause votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as T

KINDS = tuple(lx.TYPE_KEYWORDS)
STRUCTURES = ("auto", "single-story", "compilation", "conversation")
#: Signals at most of one part of a context, and of the whole.
SIGNALS, ALL_SIGNALS = 4, 6


def job_texts(segs: DataFrame, most: int | None = None) -> DataFrame:
    """(job_id, transcript): the segments' texts in order, lower case; the first `most` segments or all."""
    x = segs.where("trim(text) <> ''")
    x = x.where(F.col("seg_ix") < most) if most else x
    rows = F.array_sort(F.collect_list(F.struct("seg_ix", F.trim("text").alias("t"))))
    return x.groupBy("job_id").agg(F.lower(F.array_join(F.transform(rows, lambda r: r["t"]), " ")).alias("transcript"))


def content_type(segs: DataFrame, requests: DataFrame) -> DataFrame:
    """(job_id, kind, confidence, signals) from keywords in the title and hint of requests(job_id, title) and in the first 180 segments."""
    x = requests.join(job_texts(segs, 180), "job_id", "left").select("job_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("transcript", F.lit("")).alias("t"))
    votes = {k: reduce(lambda a, b: a + b, [F.contains("title", F.lit(w)).cast("int") * 28 + F.contains("t", F.lit(w)).cast("int") * 8 for w in ws]) for k, ws in lx.TYPE_KEYWORDS.items()}
    talk = (F.length("t") > 1000) & (T.times_in(F.col("t"), "?") >= 4) & (T.times_in(F.col("t"), " i ") + T.times_in(F.col("t"), " we ") + T.times_in(F.col("t"), " you ") >= 18)
    votes["podcast"] = votes["podcast"] + F.when(talk, 12).otherwise(0)
    told = [F.when(F.contains("title", F.lit(w)), f"title/subject mentions {w.strip()}") for ws in lx.TYPE_KEYWORDS.values() for w in ws]
    signals = F.slice(F.array_compact(F.array(*told, F.when(talk, "dialogue-heavy transcript"))), 1, SIGNALS)
    y = x.select("job_id", *[v.alias(f"v{i}") for i, v in enumerate(votes.values())], signals.alias("signals"))
    order = F.sort_array(F.array(*[F.struct((-F.col(f"v{i}")).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    y = y.select("job_id", F.get(order, F.lit(0))["kind"].alias("kind"), (-F.get(order, F.lit(0))["v"]).alias("best"), (-F.get(order, F.lit(1))["v"]).alias("second"), "signals")
    sure = F.least(F.lit(9200), 5000 + F.least("best", F.lit(60)) * 55 + (F.col("best") - F.col("second")) * 40)
    return y.select("job_id", F.when(F.col("best") < 24, "other").otherwise(F.col("kind")).alias("kind"), F.when(F.col("best") < 24, 3500).otherwise(sure).cast("int").alias("confidence_bp"), "signals")


def structure_votes(segs: DataFrame) -> DataFrame:
    """(job_id, duration_cs, hard, very_hard, comparisons, low): pauses, and how often neighbouring blocks of eight segments share little."""
    by = Window.partitionBy("job_id").orderBy("seg_ix")
    gap = F.greatest(F.lit(0), F.col("start_cs") - F.lag("end_cs").over(by))
    pauses = segs.withColumn("g", gap).groupBy("job_id").agg((F.max_by("end_cs", "seg_ix") - F.min_by("start_cs", "seg_ix")).alias("duration_cs"), F.count_if(F.col("g") >= 220).alias("hard"), F.count_if(F.col("g") >= 400).alias("very_hard"))
    block = segs.select("job_id", (F.col("seg_ix") / 8).cast("int").alias("block"), T.topic_tokens(F.col("text")).alias("t"))
    blocks = block.groupBy("job_id", "block").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")).where("size(t) > 0")
    pairs = blocks.withColumn("n", F.lead("t").over(Window.partitionBy("job_id").orderBy("block"))).where("n is not null")
    shifts = pairs.groupBy("job_id").agg(F.count("*").alias("comparisons"), F.count_if(T.jaccard(F.col("t"), F.col("n")) < 0.08).alias("low"))
    return pauses.join(shifts, "job_id", "left").fillna(0, ["comparisons", "low"])


def structure(segs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(job_id, structure, confidence, signals): compilation by votes, else conversation for podcasts of kinds(job_id, kind), else single-story."""
    cues = reduce(lambda a, b: a + b, [T.times_in(F.col("transcript"), c) for c in lx.COMPILATION_CUES])
    x = structure_votes(segs).join(job_texts(segs).select("job_id", cues.alias("cues")), "job_id", "left").fillna(0, ["cues"]).join(kinds.select("job_id", F.col("kind").alias("_kind")), "job_id", "left")
    votes = [
        ((F.col("duration_cs") >= 15000) & (F.col("hard") >= 3), F.lit(150), "several long transcript breaks"),
        (F.col("very_hard") >= 2, F.lit(120), "multiple major pauses"),
        ((F.col("comparisons") >= 4) & (F.col("low") >= 0.58 * F.col("comparisons")), F.lit(150), "frequent local topic changes"),
        (F.col("cues") > 0, F.least(F.lit(250), F.col("cues") * 90), "compilation-style wording"),
    ]
    points = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0) for c, v, _ in votes])
    signals = F.array_compact(F.array(*[F.when(c, why) for c, _, why in votes]))
    many, talk = F.col("points") >= 260, F.coalesce(F.col("_kind") == "podcast", F.lit(False))
    return x.withColumn("points", points.cast("int")).select(
        "job_id", "points", F.when(many, "compilation").when(talk, "conversation").otherwise("single-story").alias("structure"),
        F.when(many, F.least(F.lit(9000), 5500 + F.col("points") * 8)).when(talk, 7200).when(F.col("duration_cs") >= 6000, 6200).otherwise(5200).cast("int").alias("confidence_bp"),
        F.when(~many & talk, F.array(F.lit("podcast/interview content"))).otherwise(signals).alias("signals"),
    )


def envelope(clips: DataFrame) -> DataFrame:
    """clips(start_cs, end_cs, scene_start, scene_end, structure) with the range of local context around each."""
    comp = F.col("structure") == "compilation"
    return clips.withColumns({
        "context_start": F.greatest(F.lit(0), F.col("start_cs") - F.when(comp, 1800).otherwise(3000), F.coalesce("scene_start", F.lit(0))),
        "context_end": F.least(F.col("end_cs") + F.when(comp, 2400).otherwise(3600), F.coalesce("scene_end", F.col("end_cs") + 3600)),
    })


def resolved(requests: DataFrame, found_kinds: DataFrame, segs: DataFrame) -> DataFrame:
    """(job_id, kind, structure, confidence_bp, signals): what the user asked for, else what was found.

    requests(job_id, asked_kind, asked_structure); a choice of the user's is sure, and the whole is as sure as its less
    sure part. The structure follows from the kind that holds, the user's included.
    """
    known = lambda c, valid: F.when(F.lower(F.trim(F.coalesce(c, F.lit("auto")))).isin(*valid), F.lower(F.trim(c))).otherwise("auto")
    x = requests.select("job_id", known(F.col("asked_kind"), lx.CONTENT_TYPES).alias("_k"), known(F.col("asked_structure"), STRUCTURES).alias("_s"))
    mine = lambda c: F.col(c) != "auto"
    chosen = lambda c, what, found: F.when(mine(c), F.array(F.lit(f"user-selected content {what}"))).otherwise(F.col(found))
    x = x.join(found_kinds.select("job_id", "kind", F.col("confidence_bp").alias("_kc"), F.col("signals").alias("_ks")), "job_id")
    x = x.withColumns({"kind": F.when(mine("_k"), F.col("_k")).otherwise(F.col("kind")), "_kc": F.when(mine("_k"), 10000).otherwise(F.col("_kc")), "_ks": chosen("_k", "type", "_ks")})
    shapes = structure(segs, x.select("job_id", "kind")).select("job_id", "structure", F.col("confidence_bp").alias("_sc"), F.col("signals").alias("_ss"))
    x = x.join(shapes, "job_id")
    return x.select(
        "job_id", "kind", F.when(mine("_s"), F.col("_s")).otherwise(F.col("structure")).alias("structure"), F.least("_kc", F.when(mine("_s"), 10000).otherwise(F.col("_sc"))).cast("int").alias("confidence_bp"),
        F.slice(F.array_distinct(F.concat("_ks", chosen("_s", "structure", "_ss"))), 1, ALL_SIGNALS).alias("signals"),
    )
