"""Transcript tables derived from the conversations, with times in centiseconds.

Forty centiseconds a word; the pause before a sentence follows from its place,
so that every pause threshold of the operators is met. Cue phrases are put into
the text by place too, as the invented prose holds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, seg_ix, start_cs, end_cs, n_words, plain, text)."""
    # All that follows is done by job. The rows are few bytes beside the work that windows and scores make of them, so
    # their number of partitions is fixed here: the adaptive planner would join them by size and leave cores idle.
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    parts = talk.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.regexp_replace("text", r"\s+", " "), F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("pos", "s"))
    sent = parts.select("conv_id", "turn", "pos", F.trim("s").alias("plain")).where("plain <> ''").withColumn("n_words", F.size(F.split("plain", " ")))
    timed = sent.withColumn("gap_cs", (F.col("turn") * 7 + F.col("pos") * 3) % 11 * 40)
    order = Window.partitionBy("conv_id").orderBy("turn", "pos")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = timed.select(F.col("conv_id").alias("job_id"), (F.row_number().over(order) - 1).alias("seg_ix"), F.sum(F.col("gap_cs") + F.col("n_words") * 40).over(run).alias("end_cs"), "n_words", "plain")
    kind = (F.col("job_id") * 13 + F.col("seg_ix") * 5) % 9
    text = (
        F.when(kind == 0, F.concat(F.lit("Here's why "), "plain"))
        .when(kind == 1, F.concat(F.lit("But "), "plain"))
        .when(kind == 2, F.concat(F.lit("That's why "), "plain"))
        .when(kind == 3, F.concat(F.regexp_replace("plain", "[.]+$", ""), F.lit("?")))
        .otherwise(F.col("plain"))
    )
    return x.select("job_id", "seg_ix", (F.col("end_cs") - F.col("n_words") * 40).alias("start_cs"), "end_cs", "n_words", "plain", text.alias("text"))


def words(segs: DataFrame) -> DataFrame:
    """(job_id, seg_ix, word_ix, start_cs, end_cs, word, pct): pct is the word's probability in hundredths."""
    x = segs.select("job_id", "seg_ix", F.col("start_cs").alias("s"), F.posexplode(F.split("plain", " ")).alias("word_ix", "word"))
    return x.select("job_id", "seg_ix", "word_ix", (F.col("s") + F.col("word_ix") * 40).alias("start_cs"), (F.col("s") + F.col("word_ix") * 40 + 36).alias("end_cs"), "word", ((F.col("s") * 31 + F.col("word_ix") * 17) % 100).alias("pct"))


#: The same two tables for DuckDB, as the beginning of a WITH clause.
SQL = """
WITH x AS (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '[^.!?]+[.!?]*', 0) AS l FROM conversations)),
sent AS (SELECT conv_id, turn, pos, trim(s) AS plain, len(string_split(trim(s), ' ')) AS n_words, ((turn * 7 + pos * 3) % 11) * 40 AS gap_cs FROM x WHERE trim(s) <> ''),
base AS (SELECT conv_id AS job_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_ix, CAST(sum(gap_cs + n_words * 40) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_cs, CAST(n_words AS INTEGER) AS n_words, plain FROM sent WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)),
segments AS (SELECT job_id, seg_ix, end_cs - n_words * 40 AS start_cs, end_cs, n_words, plain, CASE (job_id * 13 + seg_ix * 5) % 9 WHEN 0 THEN concat('Here''s why ', plain) WHEN 1 THEN concat('But ', plain) WHEN 2 THEN concat('That''s why ', plain) WHEN 3 THEN concat(regexp_replace(plain, '[.]+$', ''), '?') ELSE plain END AS text FROM base),
words AS (SELECT job_id, seg_ix, CAST(i AS INTEGER) AS word_ix, start_cs + i * 40 AS start_cs, start_cs + i * 40 + 36 AS end_cs, word, (start_cs * 31 + i * 17) % 100 AS pct FROM (SELECT job_id, seg_ix, start_cs, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM (SELECT *, string_split(plain, ' ') AS l FROM segments)))
"""
