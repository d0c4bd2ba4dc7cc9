"""Small cases with known results: media rows, layouts, copy, edits, captions, documents."""

from pyspark.sql import functions as F

from tidemark.operators import captions, copywriting, edits, layouts, media
from tidemark.operators.catalog import safe_name
from tidemark.sources import documents

STATS = "mode string, source_width int, source_height int, sample_count int, face int, multi int, cuts int, subtitle int, face_upper int, face_middle int, face_lower int, speaker int, switches int"


def _one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_probe_rows(spark):
    doc = '{"format": {"duration": "12.5", "format_name": "matroska"}, "streams": [{"codec_type": "video", "codec_name": "vp9", "width": 1920, "height": 1080, "avg_frame_rate": "0/0", "tags": {"rotate": "90"}, "side_data_list": [{"rotation": -90}]}, {"codec_type": "audio", "codec_name": "aac", "tags": {"language": "jpn"}, "disposition": {"default": 1}}, {"codec_type": "audio", "tags": {"language": "eng", "title": "English Dub"}}]}'
    df = media.probed(spark.createDataFrame([(1, doc), (2, "{}"), (3, "broken"), (4, None)], "k int, probe string"))
    got = {r.k: r for r in df.select("*", media.normalise_reasons(F.lit("a.mkv")).alias("why"), media.english_track(F.col("audio_tracks"), F.col("default_audio_track")).alias("english")).collect()}
    assert (got[1].audio_streams, got[1].default_audio_track, got[1].audio_tracks[1].language, got[1].english) == (2, 1, "eng", 2)
    assert (got[1].fps, got[1].rotation, got[1].duration) == (0.0, -90, 12.5)
    assert got[1].why == ["container", "video codec", "rotation metadata"]
    for k in (2, 3, 4):
        assert (got[k].audio_streams, got[k].default_audio_track, got[k].has_video, got[k].english) == (0, 0, False, 0)


def test_media_words(spark):
    assert [_one(spark, media.language(F.col("c")), c=c) for c in ("jpn", "en-US", "pt_BR", " GER ", "")] == ["ja", "en", "pt", "de", ""]
    assert _one(spark, media.hotwords(F.lit("  Attack  on Titan. "))) == "Attack on Titan, Attack, Titan"
    assert [_one(spark, media.remaining(F.lit(s))) for s in (0.2, 59.4, 100.0, 7300.0, 7200.0)] == ["about 1 sec remaining", "about 59 sec remaining", "about 2 min remaining", "about 2 hr 2 min remaining", "about 2 hr remaining"]
    assert [_one(spark, safe_name(F.lit(s))) for s in ("You’ll Never Feel Ready!", "x.MP4", " -_ ")] == ["Youll-Never-Feel-Ready.mp4", "x.mp4", "clip.mp4"]


def test_layouts(spark):
    base = ("face", 1920, 1080, 100, 60, 0, 0, 0, 0, 0, 0, 0, 0)
    row = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(STATS.split(", "), base, strict=True))
    rows = [row(), row(multi=20), row(mode="motion", face=0), row(mode="portrait"), row(mode="static", face=0), row(source_height=0)]
    df = spark.createDataFrame(rows, STATS)
    pick = lambda kind: [r.x for r in df.select(layouts.layout(F.lit("auto"), F.lit(kind)).alias("x")).collect()]
    assert pick("other") == ["fill", "focus", "backdrop", "preserve", "focus", "fill"]
    assert pick("anime") == ["focus", "focus", "focus", "preserve", "focus", "focus"]
    windows = df.limit(1).select(*[layouts.picture_window(F.lit(a), F.lit(b)).alias(f"{a}{b}") for a, b in (("focus", "balanced"), ("focus", "compact"), ("preserve", "x"), ("fill", "x"))]).first()
    assert [tuple(w) for w in windows] == [(0, 190, 720, 900), (0, 240, 720, 800), (0, 437, 720, 405), (0, 0, 720, 1280)]
    zones = spark.createDataFrame([row(face_lower=5), row(face_middle=5), row()], STATS)
    band = lambda style: [r.x for r in zones.select(layouts.zone(F.lit(style), F.lit("other"), F.lit("fill")).alias("x")).collect()]
    assert band("cinematic") == ["middle", "lower", "lower"]
    assert band("viral") == ["middle", "lower", "middle"]


def test_copy(spark):
    text = "Um, so nobody knew what was hiding behind the walls. The truth is the walls were full of titans because the walls protect us."
    df = spark.createDataFrame([(text, "The walls fell.", "Attack on titan, season one", "anime", "auto", "reveal"), ("", "", None, "other", "loud", "unknown")], "text string, local string, hint string, kind string, style string, moment string")
    full, empty = copywriting.written(df).orderBy(F.desc(F.length("text"))).collect()
    assert full.tags[:3] == ["#AttackOnTitan", "#Anime", "#Reveal"] and len(full.tags) <= 5
    assert full.social == f"{full.description}\n\n{' '.join(full.tags)}"
    assert full.description[-1] == "." and full.title
    assert (empty.title, empty.description, empty.tags, empty.social) == ("Strong moment", "", [], "")
    assert _one(spark, copywriting.strip_fillers(F.lit("Well you know I think so this is it"))) == "so this is it"
    assert _one(spark, copywriting.title_case(F.lit("the fall of NASA and the rest"))) == "The Fall of NASA and the Rest"
    assert _one(spark, copywriting.headline(F.lit("the biggest mistake I made was hiring too quickly"))) == "My Biggest Mistake: hiring too quickly"


def test_edits_keep_the_rhythm(spark):
    old = [(1.0, 1.3), (1.4, 1.8), (2.4, 2.9), (3.2, 3.6)]
    rows = [(0, 0.0, 10.0, "one two NEW four", old), (1, 0.0, 10.0, "a b c d", old[:2]), (2, 0.0, 2.0, "x y", []), (3, 0.0, 2.0, "  ", old)]
    df = spark.createDataFrame(rows, "k int, lo double, hi double, text string, old array<struct<start: double, end: double>>")
    got = {r.k: r.words for r in edits.retimed(df).collect()}
    assert [w.start for w in got[0]] == [1.0, 1.4, 2.4, 3.2] and got[0][2].word == "NEW"
    assert len(got[1]) == 4 and got[1][2].start > 1.0 and got[1][-1].end == 1.8
    assert [(w.start, w.end) for w in got[2]] == [(0.0, 1.0), (1.0, 2.0)]
    assert got[3] == []
    segs = spark.createDataFrame([(7, 0.0, 1.0, "keep"), (7, 1.2, 2.0, "goes"), (7, 9.0, 11.0, "stays")], "job_id int, start double, end double, text string")
    edit = edits.retimed(spark.createDataFrame([(7, 1.1, 3.0, " new  words ", [(1.2, 1.5), (1.5, 2.0)])], "job_id int, lo double, hi double, text string, old array<struct<start: double, end: double>>"))
    assert sorted(map(tuple, edits.replaced(segs, edit).collect())) == [(7, 0.0, 1.0, "keep"), (7, 1.2, 2.0, "new words"), (7, 9.0, 11.0, "stays")]


def test_captions(spark):
    x = _one(spark, captions.balanced(F.lit("This is the reason the whole plan suddenly fell apart"), "cinematic"))
    left, right = x.split("\n")
    assert left.split()[-1] not in ("the", "because") and right
    assert _one(spark, captions.joined(F.array(*map(F.lit, ("Hello", ",", "it", "-", "self", "(", "now", ")"))))) == "Hello, it -self (now)"
    held = spark.createDataFrame([(0.0, 4.0, 1.0, 9.0, "one two three four five six")], "lo double, hi double, start double, end double, text string")
    cues = captions.fallback_cues(held, 2, 31).orderBy("cue_ix").collect()
    assert [(c.cue_start, c.cue_end, c.cue) for c in cues] == [(1.0, 2.0, "one two"), (2.0, 3.0, "three four"), (3.0, 4.0, "five six")]


def test_documents(spark, tmp_path):
    for name, doc in (("job_1", '{"title": "A", "updated_at": "2"}'), ("job_2", "{broken"), ("bad.name", "{}"), ("job_3", '{"job_id": "j3", "status": "", "clips": [{"start": 1}]}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(doc)
    (tmp_path / "job_1" / "transcript.json").write_text('[{"start": 0, "end": 1, "text": "a", "words": []}, {"start": 1, "end": 2.5, "text": "b"}]')
    got = {r.job_id: r for r in documents.read_projects(spark, str(tmp_path)).collect()}
    assert set(got) == {"job_1", "j3"}
    assert (got["job_1"].title, got["job_1"].created_at, got["job_1"].status, got["job_1"].schema_version) == ("A", "2", "ready", 24)
    assert (got["j3"].title, got["j3"].status, got["j3"].clip_count) == ("Untitled project", "ready", 1)
    assert [(r.job_id, r.seg_ix, r.end, r.text) for r in documents.read_transcripts(spark, str(tmp_path)).orderBy("seg_ix").collect()] == [("job_1", 0, 1.0, "a"), ("job_1", 1, 2.5, "b")]
    files = spark.createDataFrame([("job_1", "preview_a.mp4", 5), ("job_1", "short_b.mp4", 7), ("job_1", "x.srt", 1)], "job_id string, name string, bytes long")
    s = {r.job_id: r for r in documents.summaries(documents.read_projects(spark, str(tmp_path)), files).collect()}
    assert (s["job_1"].storage_bytes, s["job_1"].render_count, s["job_1"].short_count, s["j3"].storage_bytes) == (13, 1, 1, 0)
