"""Fingerprints and caches, state tables with two writers, clean-up rules, patches, crop expressions, diagnostics."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleanup, patches, tracks
from tidemark.sources import documents, fingerprints
from tidemark.sources.statetable import Conflict, StateTable


def test_fingerprints_of_files_with_equal_heads(spark, tmp_path):
    head = b"h" * 3000
    texts = {"a.mp4": head + b"1" * 50, "b.mp4": head + b"2" * 50, "sub/c.mp4": head + b"1" * 50, "d.mp4": head[:1000], "e.mp4": b"", "f.txt": b"no"}
    for name, t in texts.items():
        Path(tmp_path, name).parent.mkdir(exist_ok=True)
        Path(tmp_path, name).write_bytes(t)
    got = {Path(r.path).name: r for r in fingerprints.media(spark, f"file://{tmp_path}", "*.mp4", sample=1000).collect()}
    assert set(got) == {"a.mp4", "b.mp4", "c.mp4", "d.mp4"}  # empty files aren't listed

    def plain(t):
        return hashlib.sha256(str(len(t)).encode() + t[:1000] + (t[-1000:] if len(t) > 1000 else b"")).hexdigest()

    assert {k: r.fingerprint for k, r in got.items()} == {Path(n).name: plain(t) for n, t in texts.items() if n.endswith("4") and t}
    assert got["a.mp4"].fingerprint == got["c.mp4"].fingerprint != got["b.mp4"].fingerprint
    column = spark.createDataFrame([(bytearray(t),) for t in texts.values()], "t binary").select(fingerprints.fingerprint(F.col("t"), 1000)).collect()
    assert [r[0] for r in column] == [plain(t) for t in texts.values()]


def test_cache_reads_only_the_keys_partitions_and_drops_broken_documents(spark, tmp_path):
    good = '[{"start": 0.0, "end": 1.0, "text": "hi"}]'
    keys = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("good", "broken", "empty", "other", "twice")}
    cache = f"file://{tmp_path}/cache"
    rows = [("good", good), ("broken", good[:-5]), ("empty", "[]"), ("other", good), ("twice", "[")]
    fingerprints.save(spark.createDataFrame([(keys[k], t) for k, t in rows], "cache_key string, doc string"), cache)
    fingerprints.save(spark.createDataFrame([(keys["twice"], good)], "cache_key string, doc string"), cache)
    found = fingerprints.lookup(spark, cache, [keys[k] for k in ("good", "broken", "empty", "twice")] + ["f" * 64])
    assert {r.cache_key for r in found.collect()} == {keys["good"], keys["twice"]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "prefix" in filters.split("PushedFilters")[0]


STATE = "task string, status string, progress int"


def test_states_are_merged_stamped_and_only_touched_buckets_are_written(spark, tmp_path):
    t = StateTable(spark, f"file://{tmp_path}/states", "task", 8)
    assert t.version() == 0 and t.read() is None
    assert t.upsert(spark.createDataFrame([(f"t{k}", "queued", k) for k in range(30)], STATE), "2024-01-01 00:00:00") == 1
    before = t.manifest()
    assert t.upsert(spark.createDataFrame([("t3", "running", None), ("new", "queued", 0)], STATE), "2024-01-02 00:00:00") == 2
    after = t.manifest()
    changed = [b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)]
    assert 1 <= len(changed) <= 2
    rows = {r.task: (r.status, r.progress, str(r.created_at)[:10], str(r.updated_at)[:10]) for r in t.read().collect()}
    assert len(rows) == 31
    assert rows["t3"] == ("running", 3, "2024-01-01", "2024-01-02") and rows["t4"] == ("queued", 4, "2024-01-01", "2024-01-01") and rows["new"] == ("queued", 0, "2024-01-02", "2024-01-02")
    assert t.read(1).where("task = 't3'").first().status == "queued"  # the old version is as it was
    assert t.upsert(spark.createDataFrame([], STATE), "2024-01-03 00:00:00") == 2


def test_states_take_new_columns(spark, tmp_path):
    t = StateTable(spark, f"file://{tmp_path}/states", "task", 4)
    t.upsert(spark.createDataFrame([(f"t{k}", "queued", k) for k in range(9)], STATE), "2024-01-01 00:00:00")
    t.upsert(spark.createDataFrame([("t1", "late")], "task string, error string"), "2024-01-02 00:00:00")
    rows = {r.task: (r.status, r.error) for r in t.read().collect()}
    assert len(rows) == 9 and rows["t1"] == ("queued", "late") and rows["t2"] == ("queued", None)


def test_of_two_writers_one_wins_and_the_other_sees_a_conflict(spark, tmp_path):
    root = f"file://{tmp_path}/states"
    a, b = StateTable(spark, root, "task", 4), StateTable(spark, root, "task", 4)
    rows = lambda s: spark.createDataFrame([("t1", s, 1)], STATE)
    base = a.upsert(rows("queued"), "2024-01-01 00:00:00")
    a.upsert(rows("done"), "2024-01-02 00:00:00", expected=base)
    with pytest.raises(Conflict):
        b.upsert(rows("failed"), "2024-01-02 00:00:00", expected=base)
    # both began with the same version, and the other's is published while this one writes
    publish = b._publish

    def late(manifest, version):
        a.upsert(rows("again"), "2024-01-03 00:00:00")
        publish(manifest, version)

    b._publish = late
    with pytest.raises(Conflict):
        b.upsert(rows("failed"), "2024-01-03 00:00:00")
    assert b.read().first().status == "again" and b.version() == 3
    assert not [p for p in Path(tmp_path, "states/versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


KEPT = ["project.json", "transcript.json", "clips/short_1.mp4", "clips/full.mp4", "clips/cover.jpg", "package.zip", "clips/old/preview_1.mp4", "source/a.mkv"]
GOES = ["audio/1.wav", "audio/deep/2.wav", "clips/preview_1.mp4", "clips/captions_1.ass", "clips/reframe_x.json", "clips/x.part.mp4", "deep/er/.y.tmp", "z.tmp"]


def test_every_rule_of_a_cleanup(spark):
    files = [("j", p, 10) for p in KEPT + GOES] + [("j", "source.mkv", 100), ("j", "normalized.mp4", 50), ("raw", "source.mp4", 7), ("raw", "audio/1.wav", 1), ("other", "z.tmp", 3)]
    f = spark.createDataFrame(files, "job_id string, path string, bytes long")
    ask = spark.createDataFrame([("j", False), ("raw", True), ("none", True)], "job_id string, remove_source boolean")
    got = {r.job_id: r for r in cleanup.cleaned(f, ask).collect()}
    assert set(got) == {"j", "raw", "none"}
    j = got["j"]
    assert (j.removed_files, j.removed_bytes, j.bytes_before, j.bytes_after, j.source_removed, j.source_available, j.refused) == (8, 80, 310, 230, False, True, False)
    assert got["raw"].refused and got["raw"].removed_files == 0 and got["raw"].source_available  # nothing rendered yet
    assert {r.path for r in cleanup.doomed(f, ask).collect()} == set(GOES)
    both = cleanup.doomed(f, spark.createDataFrame([("j", True)], ask.schema)).collect()
    assert {r.path for r in both if r.rule == "source"} == {"source.mkv", "normalized.mp4"} and len(both) == 10
    after = cleanup.cleaned(f, spark.createDataFrame([("j", True)], ask.schema)).first()
    assert (after.removed_bytes, after.source_removed, after.source_available) == (230, True, False)


def test_stale_audio_goes_only_with_a_transcript(spark):
    f = spark.createDataFrame([("a", "audio/1.wav", 1), ("a", "transcript.json", 1), ("b", "audio/1.wav", 1), ("_c", "audio/1.wav", 1), ("_c", "transcript.json", 1), ("b", "q.part.mp4", 1)], "job_id string, path string, bytes long")
    assert {(r.job_id, r.path, r.rule) for r in cleanup.stale(f).collect()} == {("a", "audio/1.wav", "audio"), ("b", "q.part.mp4", "leftover")}
    assert {r.job_id: r.available for r in cleanup.available(spark.createDataFrame([("a", "source.mkv", 0), ("b", "source.x", 1), ("c", "clips/source.x", 1)], f.schema)).collect()} == {"a": False, "b": True, "c": False}


PROJECT = "job_id string, fields map<string,string>, clips array<struct<fields map<string,string>, context map<string,string>>>"
PATCH = "job_id string, clip_ix int, seq long, fields map<string,string>, context map<string,string>"


def test_patches_tell_null_from_absent_at_every_depth(spark):
    docs = spark.createDataFrame([("a", {"name": "n", "notes": "old"}, [({"title": "t0", "score": "1"}, {"kind": "k"}), ({"title": "t1"}, None)]), ("b", None, []), ("c", {"x": "y"}, None)], PROJECT)
    asked = spark.createDataFrame([
        ("a", 0, 2, {"title": None}, None), ("a", 0, 1, {"title": "early", "score": "2"}, {"kind": "other", "deep": "1"}), ("a", 1, 3, None, {"user_feedback": "{}"}), ("a", None, 4, {"notes": "new"}, None), ("a", 0, 5, {}, {}),
        ("b", None, 6, {"notes": "b"}, None), ("a", 7, 7, {"title": "lost"}, None), ("zzz", 0, 8, {"title": "lost"}, None), ("a", 1, 9, None, None),
    ], PATCH)
    got = {r.job_id: r for r in patches.patched(docs, asked).collect()}
    assert got["a"].fields == {"name": "n", "notes": "new"} and got["b"].fields == {"notes": "b"} and got["c"].fields == {"x": "y"} and got["c"].clips is None
    assert [(c.fields, c.context) for c in got["a"].clips] == [({"title": None, "score": "2"}, {"kind": "other", "deep": "1"}), ({"title": "t1"}, {"user_feedback": "{}"})]
    assert {(r.seq, r.why) for r in patches.refused(docs, asked).collect()} == {(7, "no such clip"), (8, "no such project"), (9, "invalid")}
    same = {r.job_id: r for r in patches.patched(docs, asked.limit(0)).collect()}
    assert same["a"].clips[0].fields == {"title": "t0", "score": "1"} and same["b"].fields is None


def test_a_users_copy(spark):
    rows = [(" T ", "", ["#Go go!", "gogo", "a", "b", "c", "d", "e", "f", "g"], "first \n\n second"), ("  ", "d", [], "s"), ("x", "d ", None, "s")]
    got = spark.createDataFrame(rows, "t string, d string, h array<string>, s string").select(patches.copy_fields(F.col("t"), F.col("d"), F.col("h"), F.col("s")).alias("m")).collect()
    assert got[0].m == {"title": "T", "description": "first", "hashtags": "#Gogo #a #b #c #d #e #f", "social_caption": "first\n\n#Gogo #a #b #c #d #e #f"}
    assert got[1].m is None and got[2].m == {"title": "x", "description": "d", "hashtags": "", "social_caption": "d"}


def test_crop_expressions(spark):
    rows = [("one", 0.0, 0.5), ("two", 0.0, 0.25), ("two", 2.0, 0.75), ("near", 1.0, 0.2), ("near", 1.0004, 0.3), ("near", 3.0, 0.3), ("same", 1.0, 0.4), ("same", 1.0, 0.6)]
    got = {r.k: r.expression for r in tracks.piecewise(spark.createDataFrame(rows, "k string, t double, c double"), "k").collect()}
    assert got["one"] == "clip(0.500000*iw-ow/2,0,iw-ow)" and got["same"] == "clip(0.600000*iw-ow/2,0,iw-ow)"
    assert got["two"] == "if(lt(t,2.000),clip((0.250000+(0.500000)*(t-0.000)/2.000)*iw-ow/2,0,iw-ow),clip(0.750000*iw-ow/2,0,iw-ow))"
    assert got["near"].startswith("if(lt(t,3.000),clip((0.300000+(0.000000)*(t-1.000)/2.000)") and got["near"].count("if(") == 1


def test_bundles_keep_broken_documents_and_hide_the_rest(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"job_id": "A", "title": "t", "clips": [{"start": 1.0, "end": 2.0}], "secret": "s3cr3t"}'), ("b", '{"title": "cut'), ("c", "{}")], "folder string, doc string")
    tasks = spark.createDataFrame([(f"t{k:03}", f"2024-01-01T00:{k // 60:02}:{k % 60:02}", "/home/me/x") for k in range(130)], "task_id string, created_at string, path string")
    rows = documents.diagnostics(docs, tasks)
    documents.write_bundle(rows, f"file://{tmp_path}/bundle")
    text = "".join(p.read_text() for p in Path(tmp_path, "bundle").rglob("part-*"))
    assert "s3cr3t" not in text and "/home" not in text and text.count("task_id") == 100 and "t129" in text and '"t029"' not in text
    got = {r.job_id: (r.title, r.clip_count, r.read_error) for r in rows.where("section = 'project'").collect()}
    assert got == {"A": ("t", 1, False), "b": (None, None, True), "c": (None, 0, False)}
    assert all(json.loads(x) for x in text.splitlines())
