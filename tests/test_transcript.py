import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import text as T
from tidemark.operators import captions, catalog, intervals, ranking, scene_ranking, scenes, tracks
from tidemark.plans import registry
from tidemark.streaming import sessions
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"
CHECKED = "bridge_segments win2_topic_shift win3_scenes jn1_dialogue jn2_range_bucketed jn5_word_assembly snk3_srt flt7_text_flags scr1_score agg1_quality agg5_structure win6_ngram_repeat seq1_phrases seq3_camera seq9_retention snk2_upsert stm2_sessions".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    df, r = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE[name])
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def segments(spark, rows_):
    return spark.createDataFrame([(1, i, round(a * 100), round(b * 100), t) for i, (a, b, t) in enumerate(rows_)], "job_id long, seg_ix int, start_cs long, end_cs long, text string")


def test_ranker_prefers_the_hooked_and_resolved_window(spark):
    segs = segments(spark, [
        (0, 6.5, "And, um, before that we talked about nothing much and"), (7, 14, "The biggest mistake I made was hiring too quickly."), (14.2, 22, "I thought growth would fix every problem in the company."),
        (22.3, 33, "But it made everything worse because nobody knew what to do."), (33.2, 44, "That's why I now hire slowly and check every single reference."), (46, 53, "And then, like, we went and"),
    ])
    top = ranking.greedy(ranking.candidates(segs)).orderBy("rank").first()
    assert 650 <= top.clip_start <= 710 and 4380 <= top.clip_end <= 4430 and top.score >= 70


def test_scenes_split_topics_in_compilations(spark):
    wolves = [(4.2 * i, 4.2 * i + 4, f"Wolves hunt across frozen northern forests number{i}") for i in range(3)]
    rockets = [(30 + 4.2 * i, 34 + 4.2 * i, f"Rockets launch toward orbital stations number{i}") for i in range(3)]
    segs = segments(spark, wolves + rockets).withColumn("compilation", F.lit(True))
    none = spark.createDataFrame([], "job_id long, cut_cs long")
    got = [(r.first_ix, r.last_ix) for r in scenes.scenes(segs, none).orderBy("scene_id").collect()]
    assert got == [(0, 2), (3, 5)]


def test_scene_clips_stay_whole(spark):
    segs = segments(spark, [
        (0, 7, "Mika had only one chance to save the whole town."), (7.2, 14, "Everyone waited while the old bridge slowly broke apart."), (14.2, 20, "But the real reason was because"),
        (20.2, 29, "the river had risen for three days without anyone noticing."), (29.2, 36, "That's why the bridge finally fell into the water."), (40, 46, "Dinner was served later that evening."),
    ])
    none = spark.createDataFrame([], "job_id long, cut_cs long")
    sc = scenes.scenes(segs.withColumn("compilation", F.lit(False)), none)
    found = scene_ranking.candidates(segs, sc)
    got = found.collect()
    assert got and all(r.clip_end != 2016 and 1 <= r.selection_quality <= 99 and 0 <= r.repair_cost <= 35 for r in got)
    assert scene_ranking.chosen(found.persist(), 1).count() == 1


def test_text_predicates(spark):
    x = spark.createDataFrame([("So here's why it works.",), ("And then we left",), ("",), ("He said so because",), ("Größe zählt!",)], "t string")
    got = x.select(T.starts_clean(F.col("t")), T.ends_clean(F.col("t")), T.unfinished(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False), (False, False, True), (False, False, True), (True, True, False)]


def test_bucketed_join_gives_the_same_pairs(spark):
    left = spark.createDataFrame([(1, 0, 500), (1, 300, 900), (2, 0, 10)], "job_id long, lo long, hi long")
    right = spark.createDataFrame([(1, k * 100, k * 100 + 250) for k in range(9)] + [(2, 5, 6), (3, 0, 9)], "job_id long, start_cs long, end_cs long")
    for closed in (False, True):
        a = intervals.interval_join(left, right, "job_id", "lo", "hi", closed).collect()
        b = intervals.bucketed_interval_join(left, right, "job_id", "lo", "hi", 200, closed).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_tracks(spark):
    points = lambda cs: spark.createDataFrame([(1, 0.5 * i, c) for i, c in enumerate(cs)], "k int, t double, c double")
    held = tracks.stabilise(points([0.5, 0.47, 0.54, 0.49, 0.52]), "k").collect()
    assert all(abs(r.camera - 0.5) < 0.001 for r in held)
    assert tracks.stabilise(points([0.5, 0.5, 0.61, 0.5, 0.5]), "k").agg(F.max("camera")).first()[0] == 0.5
    moved = tracks.stabilise(points([0.5] + [0.66 + 0.005 * i for i in range(9)]), "k").agg(F.max_by("camera", "t")).first()[0]
    assert 0.56 < moved < 0.70
    few = tracks.simplify(points([(i * 7919 % 100) / 100 for i in range(400)]), "k").toPandas().sort_values("t")
    assert len(few) <= 72 and few.t.iloc[0] == 0 and few.t.iloc[-1] == 199.5


def test_speech_without_intervals_counts_as_active(spark):
    s = spark.createDataFrame([(1, 1100), (1, 1208), (1, 1300), (2, 5)], "k int, t_cs long")
    v = spark.createDataFrame([(1, 1000, 1200), (1, 1500, 1600)], "k int, start_cs long, end_cs long")
    assert [r.active for r in tracks.speech_active(s, v, "k").orderBy("k", "t_cs").collect()] == [True, True, False, True]


def test_wrapping(spark):
    line = "one two three four five six seven eight nine ten"
    got = spark.createDataFrame([(line,), ("",)], "t string").select(captions.wrapped(F.col("t"), 4, 18).alias("l")).collect()
    assert got[0].l == ["one two three four", "five six seven", "eight nine ten"] and got[1].l == []


def test_catalog(spark):
    old = spark.createDataFrame([("a", "t", 1), ("b", "u", 2)], "job string, title string, n int")
    new = spark.createDataFrame([("a", None, "ready"), ("c", "v", "new")], "job string, title string, status string")
    got = {r.job: (r.title, r.n, r.status) for r in catalog.upsert(old, new, "job").collect()}
    assert got == {"a": ("t", 1, "ready"), "b": ("u", 2, None), "c": ("v", None, "new")}
    assert catalog.migrate(old, {"n": F.lit(0), "v": F.lit(24)}).columns == ["job", "title", "n", "v"]
    tasks = spark.createDataFrame([("x", "running", "s", False), ("y", "done", "s", False)], "id string, status string, stage string, recoverable boolean")
    assert {r.id: (r.status, r.recoverable) for r in catalog.recovered(tasks).collect()} == {"x": ("failed", True), "y": ("done", False)}
    assert spark.range(1).select(catalog.safe_name(F.lit("You’ll Never Feel Ready!"), ".mp4")).first()[0] == "Youll-Never-Feel-Ready.mp4"


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").repartitionByRange(3, "ts").write.parquet(folder)
    table = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = sessions.event_stream(spark, folder, files_per_batch=10)
    got = sessions.drained(sessions.sessions(stream), "s1", str(tmp_path / "c1"), "complete")
    want = sessions.sessions(table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = sessions.drained(sessions.running_mean(stream), "s2", str(tmp_path / "c2"), "update").toPandas()
    assert isinstance(last, pd.DataFrame) and set(last.user_id) == {r.user_id for r in table.select("user_id").distinct().collect()}
