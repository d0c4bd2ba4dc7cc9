"""Layout, caption style, frame size, caption zone and profile of a clip, decided from its tracking statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx


def alias(c: Column, table: dict[str, str], default: Column) -> Column:
    """The value that a fixed table gives for c, else the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), default)


def plain(c: Column, default: str) -> Column:
    """Lower case and trimmed; null or empty: the default."""
    return F.trim(F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit(default))))


def chosen(c: Column, valid: tuple[str, ...], default: str = "auto") -> Column:
    x = plain(c, default)
    return F.when(x.isin(*valid), x).otherwise(default)


def content(c: Column) -> Column:
    x = plain(c, "auto")
    return alias(x, lx.CONTENT_ALIASES, x)


def ratio(hits: str) -> Column:
    return F.greatest(F.lit(0), F.col(hits)) / F.greatest(F.lit(1), F.col("sample_count"))


def subtitles_likely() -> Column:
    return (F.col("subtitle") >= 2) & (ratio("subtitle") >= 0.24)


def layout(asked: Column, kind: Column) -> Column:
    """kind: the normalised content type. Columns mode, source_width, source_height, sample_count, face, multi and cuts are read."""
    asked, mode = chosen(asked, lx.LAYOUTS), F.col("mode")
    steady = mode.isin("face", "speaker") & (ratio("face") >= 0.42) & (ratio("multi") < 0.14) & (ratio("cuts") < 0.10)
    crowded = (ratio("multi") >= 0.10) | (ratio("cuts") >= 0.10)
    return (
        F.when(asked != "auto", asked)
        .when(mode == "portrait", "preserve")
        .when(kind.isin("anime", "film-tv"), "focus")
        .when((kind == "gameplay") & (ratio("cuts") < 0.16), "backdrop")
        .when(steady, "fill")
        .when(~crowded & mode.isin("motion", "saliency"), "backdrop")
        .otherwise("focus")
    )


def caption_style(asked: Column, kind: Column, placed: Column) -> Column:
    asked, mode = chosen(asked, lx.CAPTION_CHOICES), F.col("mode")
    visual = (placed == "backdrop") & mode.isin("motion", "saliency")
    return (
        F.when(asked == "meme", "viral")
        .when(asked != "auto", asked)
        .when(kind.isin("anime", "film-tv"), "cinematic")
        .when(kind == "meme-comedy", "viral")
        .when(kind == "documentary", "clean")
        .when((placed == "fill") & mode.isin("face", "speaker"), "viral")
        .when(visual & (kind == "gameplay"), "viral")
        .when(~visual & (placed == "focus"), "cinematic")
        .otherwise("clean")
    )


def frame_size(asked: Column, kind: Column, placed: Column) -> Column:
    asked = chosen(asked, lx.FRAME_SIZES)
    busy = (ratio("multi") >= 0.16) | (ratio("cuts") >= 0.14)
    return F.when(asked != "auto", asked).when(~placed.isin("focus", "backdrop"), "balanced").when(kind.isin("anime", "film-tv") | busy, "compact").otherwise("balanced")


def zone(style: Column, kind: Column, placed: Column) -> Column:
    """The caption band that covers least: faces in the band, and a penalty by the order in which bands are liked."""
    likely = subtitles_likely()
    step = F.when((kind == "anime") & ~likely, 0.24).otherwise(0.18)
    order = F.when(likely, F.array(*map(F.lit, ("middle", "upper", "lower")))).when(style == "viral", F.array(*map(F.lit, ("middle", "lower", "upper")))).otherwise(F.array(*map(F.lit, ("lower", "middle", "upper"))))
    bands = {k: F.greatest(F.lit(0), F.col(f"face_{k}")) for k in ("upper", "middle", "lower")}
    total = sum(bands.values(), F.lit(0))
    cost = F.transform(order, lambda b, i: F.struct((F.when(b == "upper", bands["upper"]).when(b == "middle", bands["middle"]).otherwise(bands["lower"]) / total + i * step).alias("cost"), i.alias("i"), b.alias("band")))
    return F.when((kind == "anime") & (style == "cinematic") & (placed == "focus"), "lower").when(total == 0, order[0]).otherwise(F.array_min(cost)["band"])


def profile(style: Column, kind: Column, placed: Column) -> Column:
    mode, cinematic = F.col("mode"), style == "cinematic"
    return (
        F.when((kind == "anime") & cinematic, "Anime · cinematic")
        .when((kind == "film-tv") & cinematic, "Film / TV · cinematic")
        .when(placed == "preserve", "Full composition")
        .when((mode == "speaker") & (F.col("speaker") > 0), F.when(F.col("switches") > 0, "Active-speaker dialogue").otherwise("Speaker-aware dialogue"))
        .when((placed == "fill") & (mode == "face"), "Talking head")
        .when((placed == "focus") & ((F.col("multi") > 0) | (F.col("cuts") > 0)), "Cinematic / group scene")
        .when((placed == "backdrop") & mode.isin("motion", "saliency"), "Visual / gameplay")
        .when(cinematic, "Wide dialogue scene")
        .otherwise("Wide / contextual footage")
    )


def _half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def picture_window(placed: Column, size: Column, width: int = 720, height: int = 1280) -> Column:
    """struct(x, y, w, h): the visible picture on the canvas."""
    share = F.when(size == "compact", 800 / 1280).when(size == "immersive", 1040 / 1280).otherwise(900 / 1280)
    central = F.least(F.lit(height), _half_even(share * height))
    sw, sh = F.col("source_width"), F.col("source_height")
    scale = F.least(F.try_divide(F.lit(float(width)), sw), F.try_divide(F.lit(float(height)), sh))
    inside = placed.isin("focus", "backdrop")
    fitted = (placed == "preserve") & (sw > 0) & (sh > 0)
    w = F.when(inside, width).when(fitted, F.greatest(F.lit(1), F.least(F.lit(width), _half_even(sw * scale)))).otherwise(width)
    h = F.when(inside, central).when(fitted, F.greatest(F.lit(1), F.least(F.lit(height), _half_even(sh * scale)))).otherwise(height)
    return F.struct(F.floor((width - w) / 2).cast("int").alias("x"), F.floor((height - h) / 2).cast("int").alias("y"), w.alias("w"), h.alias("h"))
