"""Styled caption documents: the style dimension, placed and highlighted events, one document a clip, one file a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.operators import captions, layouts

# Fixed values.
#: Font, size, colour, colour of the spoken word, outline, shadow.
LOOKS = {
    "viral": ("Trebuchet MS", 58, "&H00FFFFFF", "&H0048E8FF", 5, 2),
    "cinematic": ("Segoe UI Semibold", 38, "&H00FFFFFF", "&H00FFFFFF", 2, 1),
    "clean": ("Arial", 44, "&H00FFFFFF", "&H00FFFFFF", 3, 1),
    "meme": ("Impact", 54, "&H00FFFFFF", "&H0000D7FF", 5, 1),
}
#: What a content type changes in a style: size, max_words, max_chars, max_cs, pause_cs.
OVERRIDES = {
    ("anime", "cinematic"): {"size": 36, "max_words": 7, "max_chars": 38, "max_cs": 380, "pause_cs": 76},
    ("film-tv", "cinematic"): {"size": 37, "max_words": 8, "max_chars": 44, "max_cs": 400, "pause_cs": 74},
    ("documentary", "clean"): {"max_words": 8, "max_chars": 46, "max_cs": 420},
    ("documentary", "cinematic"): {"max_words": 8, "max_chars": 46, "max_cs": 420},
    ("meme-comedy", "viral"): {"max_words": 5, "max_chars": 30, "max_cs": 250, "pause_cs": 42},
}
#: Height of a caption in the picture, by zone; the least height that each platform's controls leave.
ZONES = {"upper": 0.34, "middle": 0.61, "lower": 0.85}
ANIME_LOWER = 0.88
PLATFORMS = {"tiktok": 0.77, "shorts": 0.79, "reels": 0.80}
FADES = {"viral": r"\fad(45,70)", "meme": r"\fad(35,60)", "cinematic": r"\fad(90,130)", "clean": r"\fad(55,70)"}
SPOKEN = (r"\bord6\shad2\fscx100\fscy100\t(0,75,\fscx108\fscy108)\t(75,150,\fscx103\fscy103)}", r"\bord5\shad2\fscx100\fscy100}")
HIGHLIGHTED = ("viral", "meme")
HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: {width}
PlayResY: {height}
ScaledBorderAndShadow: yes
WrapStyle: 0

[V4+ Styles]
Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding
{style}

[Events]
Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"""
STYLE_LINE = "Style: Default,{font},{size},{colour},&H000000FF,&H00000000,&H78000000,-1,0,0,0,100,100,0,0,1,{outline},{shadow},2,28,28,20,1"
BOM = "\ufeff"


def styles(spark: SparkSession) -> DataFrame:
    """(style, content_type, font, size, colour, spoken, outline, shadow, max_words, max_chars, max_cs, pause_cs): a row a style and content type."""
    rows = []
    for style, look in LOOKS.items():
        words, chars, seconds, pause = lx.CAPTION_STYLES[style]
        for content in lx.CONTENT_TYPES:
            row = dict(zip(("font", "size", "colour", "spoken", "outline", "shadow"), look, strict=True)) | {"max_words": words, "max_chars": chars, "max_cs": round(seconds * 100), "pause_cs": round(pause * 100)}
            rows.append((style, content, *(row | OVERRIDES.get((content, style), {})).values()))
    return spark.createDataFrame(rows, "style string, content_type string, font string, size int, colour string, spoken string, outline int, shadow int, max_words int, max_chars int, max_cs int, pause_cs int")


def dressed(clips: DataFrame) -> DataFrame:
    """clips(style, content_type, ...) with their style's columns; unknown styles are clean, unknown content types auto."""
    known = lambda c, valid, other: F.when(F.lower(F.trim(F.col(c))).isin(*valid), F.lower(F.trim(F.col(c)))).otherwise(other)
    x = clips.withColumns({"style": known("style", tuple(LOOKS), "clean"), "content_type": known("content_type", lx.CONTENT_TYPES, "auto")})
    return x.join(F.broadcast(styles(clips.sparkSession)), ["style", "content_type"])


def stamp(cs: Column) -> Column:
    """Hundredths of a second as h:mm:ss.cc."""
    cs = F.greatest(F.lit(0), cs.cast("long"))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), two(cs % 360000 / 6000), F.lit(":"), two(cs % 6000 / 100), F.lit("."), two(cs % 100))


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def position(width: int, height: int) -> Column:
    """struct(x, y) of the caption of a row with style, content_type, layout, frame_size, zone, platform, source_width, source_height."""
    c = F.col
    asked = F.lower(F.trim(c("zone")))
    zone = F.when(asked.isin(*ZONES), asked).when(c("style").isin(*HIGHLIGHTED), "middle").otherwise("lower")
    ratio = F.when(zone == "upper", ZONES["upper"]).when(zone == "middle", ZONES["middle"]).otherwise(ZONES["lower"])
    low_anime = (c("content_type") == "anime") & (c("style") == "cinematic") & (zone == "lower") & (c("layout") == "focus")
    platform = F.lower(F.trim(c("platform")))
    kept_off = F.when(platform == "tiktok", PLATFORMS["tiktok"]).when(platform == "shorts", PLATFORMS["shorts"]).when(platform == "reels", PLATFORMS["reels"]).otherwise(1.0)
    ratio = F.when(low_anime, ANIME_LOWER).when(zone == "lower", F.least(ratio, kept_off)).otherwise(ratio)
    inside = c("layout").isin("focus", "backdrop", "preserve")
    w = layouts.picture_window(c("layout"), c("frame_size"), width, height)
    x = F.when(inside, F.floor(w["x"] + w["w"] / 2)).otherwise(width // 2)
    y = F.when(inside, F.floor(w["y"] + w["h"] * ratio)).otherwise(F.floor(height * ratio))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def highlighted(words: Column, at: Column, spoken: Column, colour: Column) -> Column:
    """A phrase's words with the one that is spoken set off."""
    lit = F.lit
    mark = lambda w, k: F.when(k == at, F.concat(lit("{\\c"), spoken, lit(SPOKEN[0]), w, lit("{\\c"), colour, lit(SPOKEN[1]))).otherwise(w)
    return F.array_join(F.transform(words, mark), " ")


def events(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, ix, start_cs, end_cs, text, moves) for words of dressed clips: an event a highlighted word, or one a phrase.

    words(key, style, content_type, the style's columns, seg_ix, word_ix, rel_start, rel_end, word). moves: the text fades in.
    """
    c = F.col
    look = ["style", "colour", "spoken", "max_words", "max_chars", "max_cs", "pause_cs"]
    x = captions.phrase_lists(words, [*key, *look]).withColumn("phrases", captions.rebalanced(c("phrases"), c("max_words"), c("max_chars")))
    shown = lambda w: escaped(F.when(c("style") == "meme", F.upper(w["word"])).otherwise(w["word"]))

    def spoken(p):
        texts = F.transform(p, shown)
        end = lambda w, k: F.greatest(F.coalesce(F.get(p, k + 1)["rel_start"], w["rel_end"]), w["rel_start"] + 5)
        return F.transform(p, lambda w, k: F.struct(w["rel_start"].alias("start_cs"), end(w, k).alias("end_cs"), highlighted(texts, k, c("spoken"), c("colour")).alias("text")))

    def calm(p):
        text = captions.balanced(captions.joined(F.transform(p, lambda w: w["word"])), max_chars=c("max_chars"))
        a, b = F.element_at(p, 1)["rel_start"], F.element_at(p, -1)["rel_end"]
        return F.array(F.struct(a.alias("start_cs"), F.greatest(b, a + 5).alias("end_cs"), escaped(text).alias("text")))

    loud = c("style").isin(*HIGHLIGHTED)
    made = F.flatten(F.transform("phrases", lambda p: F.when(loud, spoken(p)).otherwise(calm(p))))
    return x.select(*key, (~loud).alias("moves"), F.posexplode(made).alias("ix", "e")).select(*key, F.struct(c("ix").alias("seg_ix"), F.lit(0).alias("cue_ix")).alias("ix"), "e.*", "moves")


def fallback_events(clips: DataFrame, held: DataFrame, key: list[str], offset: float = 0.0) -> DataFrame:
    """Events of dressed clips without words: wrapped lines of held(key, seg_ix, start, end, text), in seconds, or one blank."""
    c = F.col
    parts = captions.fallback_cues(held.join(clips, key), c("max_words"), c("max_chars"), offset)
    calm = captions.balanced(c("cue"), max_chars=c("max_chars"))
    text = F.when(c("style") == "meme", F.upper("cue")).when(c("style").isin("cinematic", "clean"), calm).otherwise(F.trim(F.regexp_replace("cue", r"\s+", " ")))
    cs = lambda s: F.rint(s * 100).cast("long")
    made = parts.select(*key, "seg_ix", "cue_ix", cs(c("cue_start")).alias("start_cs"), cs(F.greatest(c("cue_end"), c("cue_start") + 0.05)).alias("end_cs"), escaped(text).alias("text"))
    blank = clips.join(made.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).alias("seg_ix"), F.lit(0).alias("cue_ix"), F.lit(0).cast("long").alias("start_cs"), cs(F.least(F.greatest(c("hi") - c("lo"), F.lit(0.5)), F.lit(1.0))).alias("end_cs"), F.lit(" ").alias("text"))
    return made.unionByName(blank).select(*key, F.struct("seg_ix", "cue_ix").alias("ix"), "start_cs", "end_cs", "text", F.lit(True).alias("moves"))


def documents(clips: DataFrame, made: DataFrame, key: list[str], width: int = 720, height: int = 1280) -> DataFrame:
    """(key, n_events, document): each dressed clip's header, style and events(key, ix, start_cs, end_cs, text, moves) in order."""
    c = F.col
    scale = max(0.55, min(1.0, width / 720))
    sized = lambda name, least: F.greatest(F.lit(least), F.rint(c(name) * scale)).cast("int").cast("string")
    at = c("_at")
    x = clips.withColumn("_at", position(width, height))
    pos = F.concat(F.lit(r"\an2\pos("), at["x"].cast("string"), F.lit(","), at["y"].cast("string"), F.lit(")"))
    fade = F.create_map(*[F.lit(v) for k in FADES.items() for v in k])
    style = _filled(STYLE_LINE, font=c("font"), size=sized("size", 20), colour=c("colour"), outline=sized("outline", 1), shadow=sized("shadow", 0))
    x = x.select(*key, pos.alias("_pos"), F.element_at(fade, c("style")).alias("_fade"), style.alias("_style"))
    line = F.concat(F.lit("Dialogue: 0,"), stamp(c("start_cs")), F.lit(","), stamp(c("end_cs")), F.lit(",Default,,0,0,0,,{"), c("_pos"), F.when(c("moves"), c("_fade")).otherwise(""), F.lit("}"), c("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ix", line.alias("line")))), lambda r: r["line"])
    y = made.join(x, key).groupBy(*key).agg(lines.alias("lines"), F.first("_style").alias("_style"))
    head = _filled(HEADER, width=F.lit(str(width)), height=F.lit(str(height)), style=c("_style"))
    return y.select(*key, F.size("lines").alias("n_events"), F.concat(F.lit(BOM), head, F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("document"))


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def write_documents(docs: DataFrame, folder: str, key: list[str], document: str = "document") -> None:
    """One text file a clip, in folder/<key>=<value>/...; the writer adds the last line end."""
    docs.select(*key, F.regexp_replace(document, "\n\\z", "").alias(document)).write.mode("overwrite").partitionBy(*key).text(folder)
