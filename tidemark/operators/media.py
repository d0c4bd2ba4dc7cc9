"""Media rows and their rules: probe documents, audio tracks, speech hints, chunk lengths, remaining times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions.text import clean
from tidemark.operators.layouts import alias

PROBE = "format struct<format_name string, duration string>, streams array<struct<`index` int, codec_type string, codec_name string, width int, height int, channels int, avg_frame_rate string, r_frame_rate string, tags struct<language string, title string, rotate string>, disposition struct<default int>, side_data_list array<struct<rotation string>>>>"


def _rate(c: Column) -> Column:
    """Frames a second from "a/b"; 0 where b is 0 or nothing is told."""
    part = lambda k: F.try_to_number(F.split_part(c, F.lit("/"), F.lit(k)), F.lit("999999")).cast("double")
    return F.coalesce(F.try_divide(part(1), part(2)), F.lit(0.0))


def probed(docs: DataFrame, json: str = "probe") -> DataFrame:
    """docs with the media facts of each probe document: first video stream, all audio streams with tracks from 1."""
    x = docs.withColumn("_p", F.from_json(json, PROBE))
    streams = PROBE.split("streams ", 1)[1]
    kind = lambda k: F.filter(F.coalesce("_p.streams", F.expr(f"cast(array() as {streams.replace(' ', ': ').replace(',: ', ', ')})")), lambda s: s["codec_type"] == k)
    x = x.withColumn("_v", F.get(kind("video"), F.lit(0))).withColumn("_a", kind("audio"))
    tracks = F.transform("_a", lambda s, i: F.struct((i + 1).alias("track"), F.coalesce(s["index"], F.lit(0)).alias("stream_index"), s["codec_name"].alias("codec"), s["tags"]["language"].alias("language"), s["tags"]["title"].alias("title"), F.coalesce(s["channels"], F.lit(0)).alias("channels"), (F.coalesce(s["disposition"]["default"], F.lit(0)) != 0).alias("default")))
    x = x.withColumn("audio_tracks", tracks)
    first = F.get(F.filter("audio_tracks", lambda t: t["default"]), F.lit(0))["track"]
    sides = F.filter(F.transform("_v.side_data_list", lambda s: s["rotation"].try_cast("int")), lambda r: r.isNotNull())
    turned = F.coalesce(F.try_element_at(sides, F.lit(-1)), F.col("_v.tags.rotate").try_cast("int"), F.lit(0))
    return x.select(
        *docs.columns, F.greatest(F.lit(0.0), F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0))).alias("duration"), F.coalesce("_p.format.format_name", F.lit("")).alias("container"), F.col("_v").isNotNull().alias("has_video"), (F.size("_a") > 0).alias("has_audio"),
        F.col("_v.codec_name").alias("video_codec"), F.get("_a", F.lit(0))["codec_name"].alias("audio_codec"), F.coalesce("_v.width", F.lit(0)).alias("width"), F.coalesce("_v.height", F.lit(0)).alias("height"),
        _rate(F.coalesce("_v.avg_frame_rate", "_v.r_frame_rate")).alias("fps"), turned.alias("rotation"), F.size("_a").alias("audio_streams"), F.coalesce(first, F.when(F.size("_a") > 0, 1).otherwise(0)).alias("default_audio_track"), "audio_tracks",
    )


def normalise_reasons(path: Column) -> Column:
    """Why a media row needs a working copy; none: it doesn't."""
    other = lambda c, valid: ~F.coalesce(F.col(c).isin(*valid), F.lit(False))
    return F.array_compact(F.array(
        F.when(~F.lower(path).rlike(r"[^/]\.(mp4|mov|m4v)$"), "container"), F.when(other("video_codec", lx.VIDEO_CODECS), "video codec"), F.when(other("audio_codec", lx.AUDIO_CODECS), "audio codec"),
        F.when((F.col("fps") != 0) & ((F.col("fps") < 20) | (F.col("fps") > 61)), "frame rate"), F.when(F.pmod("rotation", F.lit(360)) != 0, "rotation metadata"),
    ))


def language(c: Column) -> Column:
    """A two-letter code: by the alias table, else what stands before the first hyphen."""
    raw = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    return alias(raw, lx.LANGUAGE_ALIASES, F.split_part(raw, F.lit("-"), F.lit(1)))


def english_track(tracks: Column, default: Column) -> Column:
    """The first track labelled English, else the default one."""
    hit = F.filter(tracks, lambda t: (language(t["language"]) == "en") | F.coalesce(F.lower(t["title"]), F.lit("")).rlike("english|eng dub"))
    return F.coalesce(F.get(hit, F.lit(0))["track"], default)


def speech_hint(c: Column) -> Column:
    return F.left(F.btrim(clean(F.coalesce(c, F.lit(""))), F.lit(" .,_-")), F.lit(160))


def hotwords(c: Column) -> Column:
    """The whole hint and its distinct longer words, at most 220 characters; null: no hint."""
    hint = speech_hint(c)
    fold = lambda out, w: F.when(F.lower(w).isin(*lx.HOTWORD_STOP) | F.exists(out, lambda o: F.lower(o) == F.lower(w)), out).otherwise(F.concat(out, F.array(w)))
    words = F.aggregate(F.regexp_extract_all(hint, F.lit("[A-Za-z0-9][A-Za-z0-9'’.-]{2,}"), F.lit(0)), F.array(hint), fold)
    return F.when(hint != "", F.left(F.array_join(words, ", "), F.lit(220)))


def memory_error(c: Column) -> Column:
    x = F.lower(c)
    found = F.lit(False)
    for p in lx.MEMORY_ERRORS:
        found = found | F.contains(x, F.lit(p))
    return found


def remaining(seconds: Column) -> Column:
    """A remaining time in words."""
    s = F.greatest(F.lit(0), F.rint(seconds).cast("int"))
    m = F.greatest(F.lit(1), F.rint(s / 60).cast("int"))
    h, rest = F.floor(m / 60).cast("int"), m % 60
    return F.when(s < 60, F.format_string("about %d sec remaining", F.greatest(F.lit(1), s))).when(m < 60, F.format_string("about %d min remaining", m)).when(rest > 0, F.format_string("about %d hr %d min remaining", h, rest)).otherwise(F.format_string("about %d hr remaining", h))


def profile(name: Column) -> Column:
    """struct(name, chunk_seconds, threads, preset); unknown names: balanced."""
    known = F.lower(F.trim(F.coalesce(name, F.lit("balanced"))))
    rows = F.create_map(*[x for k, (c, t, p) in lx.PROFILES.items() for x in (F.lit(k), F.struct(F.lit(k).alias("name"), F.lit(c).alias("chunk_seconds"), F.lit(t).alias("threads"), F.lit(p).alias("preset")))])
    return F.coalesce(F.try_element_at(rows, known), rows["balanced"])


def chunk_seconds(duration: Column, found: Column, most: int = 1200) -> Column:
    """Seconds of a chunk by the profile and the length of the source."""
    base = F.least(F.lit(most), found["chunk_seconds"])
    base = F.when(duration >= 1800, F.least(base, F.when(found["name"] == "fast", 480).otherwise(300))).otherwise(base)
    return F.when(duration >= 2700, F.least(base, F.when(found["name"] == "low-memory", 120).when(found["name"] == "balanced", 180).otherwise(300))).otherwise(base)


def _in_units(c: Column, bits: int, places: int) -> Column:
    """A long over 2 ** bits with so many decimals, exact ties to the even digit (Java's formats round them up)."""
    ten, mask, half = 10**places, (1 << bits) - 1, 1 << (bits - 1)
    part = c.bitwiseAND(F.lit(mask)) * ten
    digits, rest = F.shiftright(part, bits), part.bitwiseAND(F.lit(mask))
    up = (rest > half) | (rest == half) & (digits % 2 == 1)
    digits = digits + up.cast("long")
    return F.format_string(f"%d.%0{places}d", F.shiftright(c, bits) + (digits == ten).cast("long"), digits % ten)


def human_bytes(c: Column) -> Column:
    """KB in whole numbers (1 at least), MB with one decimal, GB with two; null: null."""
    n = c.cast("double").cast("long")
    kb = F.format_string("%d KB", F.greatest(F.lit(1), F.floor(c / 1024 + 0.5)))
    return F.when(c < 1 << 20, kb).when(c < 1 << 30, F.concat(_in_units(n, 20, 1), F.lit(" MB"))).when(c >= 1 << 30, F.concat(_in_units(n, 30, 2), F.lit(" GB")))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour on."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))
