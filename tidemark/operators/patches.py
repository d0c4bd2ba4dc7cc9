"""Patches of project documents: of their own fields, of one clip's fields, and of what is nested in a clip's context.

A patch is a set of assignments (job, clip or none, section, key, value), so patches of a job need no order of their own
to be merged: the last assignment of each key counts, found by one partial aggregation. A key that is absent leaves what
is there; a key with a null value sets null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Fixed value: hashtags of a user's copy at most, and characters of each.
TAGS, TAG_CHARS = 7, 36
FIELDS, CONTEXT = "fields", "context"


def user_tags(raw: Column) -> Column:
    """The user's hashtags: letters and digits, first spelling of each, TAGS at most."""
    clean = F.transform(raw, lambda t: F.left(F.regexp_replace(F.regexp_replace(t, "^#+", ""), "[^A-Za-z0-9]", ""), F.lit(TAG_CHARS)))
    tags = F.transform(F.filter(clean, lambda t: t != ""), lambda t: F.concat(F.lit("#"), t))
    first = lambda ts, low: F.slice(F.filter(ts, lambda t, k: F.array_position(low, F.lower(t)) == k + 1), 1, TAGS)
    return T.let(tags, lambda ts: T.let(F.transform(ts, F.lower), lambda low: first(ts, low)))


def copy_fields(title: Column, description: Column, hashtags: Column, social: Column) -> Column:
    """The fields that a user's copy sets; null: refused, as the title is empty."""
    trim = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    given = trim(description)
    text = F.when(given != "", given).otherwise(trim(F.substring_index(trim(social), "\n\n", 1)))
    tags = F.array_join(user_tags(F.coalesce(hashtags, F.array().cast("array<string>"))), " ")

    def made(x: Column) -> Column:
        caption = F.when(x["tags"] != "", trim(F.concat(x["text"], F.lit("\n\n"), x["tags"]))).otherwise(x["text"])
        return F.create_map(F.lit("title"), x["title"], F.lit("description"), x["text"], F.lit("hashtags"), x["tags"], F.lit("social_caption"), caption)

    return F.when(trim(title) != "", T.let(F.struct(trim(title).alias("title"), text.alias("text"), tags.alias("tags")), made))


def feedback(reason: Column, note: Column) -> Column:
    """What a user's feedback sets in a clip's context."""
    return F.create_map(F.lit("user_feedback"), F.to_json(F.struct(reason.alias("reason"), F.btrim(note, F.lit(" \t\n\r\x0b\x0c")).alias("note"))))


def merged(doc: Column, patch: Column) -> Column:
    """doc with the patch's keys, null values included; a null patch changes nothing."""
    kept = F.map_filter(doc, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.when(patch.isNull(), doc).when(doc.isNull(), patch).otherwise(F.map_concat(kept, patch))


def latest(patches: DataFrame) -> DataFrame:
    """(job_id, clip_ix, fields, context): the last value of each key, of patches(job_id, clip_ix, seq, fields, context).

    clip_ix null: the project itself. Patches without any key (refused ones) change nothing.
    """
    parts = [patches.select("job_id", "clip_ix", "seq", F.lit(s).alias("section"), F.explode(s).alias("key", "value")) for s in (FIELDS, CONTEXT)]
    last = parts[0].unionByName(parts[1]).groupBy("job_id", "clip_ix", "section", "key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    pairs = lambda s: F.array_compact(F.collect_list(F.when(F.col("section") == s, F.struct("key", "v.value"))))
    made = last.groupBy("job_id", "clip_ix").agg(pairs(FIELDS).alias(FIELDS), pairs(CONTEXT).alias(CONTEXT))
    return made.withColumns({s: F.when(F.size(s) > 0, F.map_from_entries(s)) for s in (FIELDS, CONTEXT)})


def patched(projects: DataFrame, patches: DataFrame) -> DataFrame:
    """projects(job_id, fields, clips array<struct<fields, context>>) after all patches; those of clips that aren't there are lost."""
    new = latest(patches).groupBy("job_id").agg(
        F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("clip_ix").isNotNull(), F.struct("clip_ix", F.struct(FIELDS, CONTEXT)))))).alias("_clips"),
        F.max_by(F.struct(FIELDS), F.col("clip_ix").isNull()).alias("_own"), F.bool_or(F.col("clip_ix").isNull()).alias("_has"),
    )
    x = projects.join(new, "job_id", "left")
    one = lambda c, k: F.struct(*[merged(c[s], F.try_element_at("_clips", k)[s]).alias(s) for s in (FIELDS, CONTEXT)])
    clips = F.when(F.col("_clips").isNull(), F.col("clips")).otherwise(F.transform("clips", one))
    return x.withColumns({"fields": F.when(F.col("_has"), merged(F.col("fields"), F.col("_own.fields"))).otherwise(F.col("fields")), "clips": clips}).drop("_clips", "_own", "_has")


def refused(projects: DataFrame, patches: DataFrame) -> DataFrame:
    """(job_id, seq, why) of the patches that change nothing: no such project or clip, or an invalid copy."""
    sizes = projects.select("job_id", F.size("clips").alias("_n"))
    x = patches.join(sizes, "job_id", "left")
    why = F.when(F.col("_n").isNull(), "no such project").when(~F.col("clip_ix").between(0, F.col("_n") - 1), "no such clip").when(F.col("fields").isNull() & F.col("context").isNull(), "invalid")
    return x.select("job_id", "seq", why.alias("why")).where("why is not null")
