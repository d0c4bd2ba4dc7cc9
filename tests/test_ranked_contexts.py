"""The diverse choice against plain loops, jobs of different kinds in one run, conversations, project rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context, copywriting, projects, scene_ranking

CAND = "job_id long, scene_id int, start_ix int, end_ix int, clip_start long, clip_end long, score int, narrative int, boundary_confidence int, warnings array<string>, selection_quality int, moment string, sig array<string>, topics array<string>"


def plain_choice(cands, most):
    """The choice as two loops over the candidates in their order."""
    order = sorted(cands, key=lambda c: (-c["selection_quality"], -c["score"], -c["narrative"], -c["boundary_confidence"], len(c["warnings"]), c["clip_end"] - c["clip_start"], c["start_ix"], c["end_ix"]))
    share = lambda a, b: len(set(a) & set(b)) / min(len(set(a)), len(set(b))) if a and b else 0.0

    def alike(a, b):
        meet = max(0, min(a["clip_end"], b["clip_end"]) - max(a["clip_start"], b["clip_start"]))
        return meet / max(100, min(a["clip_end"] - a["clip_start"], b["clip_end"] - b["clip_start"])) > 0.48 or share(a["sig"], b["sig"]) > 0.72

    took, close = [], [c for c in order if c["selection_quality"] >= order[0]["selection_quality"] - 14]
    for c in close:
        if len(took) >= min(3, most):
            break
        scenes, moments = {t["scene_id"] for t in took}, {t["moment"] for t in took}
        if c["scene_id"] in scenes and {x["scene_id"] for x in close} - scenes:
            continue
        if c["moment"] != "unknown" and c["moment"] in moments and {x["moment"] for x in close} - moments - {"unknown"}:
            continue
        if not any(alike(c, t) or share(c["topics"], t["topics"]) >= 0.68 for t in took):
            took.append(c)
    for c in order:
        if len(took) >= most:
            break
        if c["narrative"] < 58 and any(x["narrative"] >= 72 for x in order):
            continue
        if not any(alike(c, t) or share(c["topics"], t["topics"]) >= 0.74 or c["scene_id"] == t["scene_id"] and abs(c["clip_start"] - t["clip_start"]) < 1500 for t in took):
            took.append(c)
    return [(t["start_ix"], t["end_ix"]) for t in took]


def made(job, seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        start = rng.randrange(0, 40) * 500
        out.append({"job_id": job, "scene_id": rng.randrange(4), "start_ix": k, "end_ix": k + rng.randrange(5), "clip_start": start, "clip_end": start + rng.randrange(8, 30) * 100, "score": rng.randrange(60, 80), "narrative": rng.choice([50, 60, 80, 90]), "boundary_confidence": rng.randrange(60, 70), "warnings": ["w"] * rng.randrange(3), "selection_quality": rng.randrange(50, 80), "moment": rng.choice(["unknown", "joke", "story", "reveal"]), "sig": rng.sample("abcdefghij", rng.randrange(0, 5)), "topics": rng.sample("klmnopqrst", rng.randrange(0, 6))})
    return out


@pytest.mark.parametrize("most", [1, 4])
def test_the_choice_equals_plain_loops(spark, most):
    jobs = {k: made(k, 40 + k, n) for k, n in enumerate([1, 3, 12, 30, 30, 45, 45, 60])}
    names = [f.split()[0] for f in CAND.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for v in jobs.values() for c in v], CAND).repartition(4)
    got = {k: [] for k in jobs}
    for r in scene_ranking.chosen(df, most).orderBy("job_id", "rank").collect():
        got[r.job_id].append((r.start_ix, r.end_ix))
    assert got == {k: plain_choice(v, most) for k, v in jobs.items()}


SEGMENT = "job_id long, seg_ix int, start_cs long, end_cs long, text string"
SCENE = "job_id long, scene_id int, first_ix int, last_ix int, start_cs long, end_cs long, boundary string"


def told(spark, job, texts, step=600, pause=20):
    rows = [(job, k, k * (step + pause), k * (step + pause) + step, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SEGMENT), spark.createDataFrame([(job, 0, 0, len(rows) - 1, 0, rows[-1][3], "end of source")], SCENE)


def test_kinds_and_lengths_differ_by_job(spark):
    lines = ["Here's why the old bridge fell into the river.", "Nobody had looked at the bolts for thirty years.", "Engineers warned the council twice about the rust.", "That's why they finally closed the road for good."]
    a, sa = told(spark, 1, lines, 400)
    b, sb = told(spark, 2, lines, 400)
    segs, sc = a.union(b), sa.union(sb)
    kinds = spark.createDataFrame([(1, "documentary", "auto"), (2, "meme-comedy", "short")], "job_id long, kind string, preference string")
    w = scene_ranking.windows(segs, sc, kinds).withColumn("d", (F.col("end_cs") - F.col("start_cs")) / 100)
    r = {x.job_id: x for x in w.groupBy("job_id").agg(F.min("d").alias("d"), F.first("low_s").alias("low"), F.first("high_s").alias("high"), F.count("*").alias("n")).collect()}
    assert 2 in r and (r[2].low, r[2].high) == (8, 22) and r[2].d < 9 and 1 not in r  # 16 s are too short for a documentary
    assert {x.kind for x in scene_ranking.windows(segs, sc).collect()} <= {"other"}


def test_bounds_and_caps(spark):
    rows = [("documentary", "auto"), ("documentary", " Longer "), ("podcast", "short"), ("meme-comedy", "short"), ("unheard", "auto"), ("gameplay", "longer")]
    x = spark.createDataFrame(rows, "k string, p string").withColumn("b", scene_ranking.duration_bounds(F.col("k"), F.col("p")))
    got = x.select("b.low", "b.high", scene_ranking.duration_cap(F.col("k"), F.col("p"), F.col("b.high")).cast("double").alias("cap")).collect()
    assert [tuple(r) for r in got] == [(25, 75, 120.0), (29, 109, 145.0), (13, 43, 61.0), (8, 22, 40.0), (12, 60, 95.0), (17, 72, 127.0)]


def test_a_job_without_candidates_gets_its_longest_scene(spark):
    segs, sc = told(spark, 5, ["and so", "then because", "which is"] * 8)
    none = spark.createDataFrame([], CAND)
    r = scene_ranking.fallback(segs, sc, none).collect()
    assert [(x.start_ix, x.end_ix, x.clip_start, x.score, x.warnings) for x in r] == [(0, 13, 0, 40, ["Ending may feel abrupt"])]
    assert scene_ranking.fallback(segs, sc, spark.createDataFrame([tuple(c[n] for n in [f.split()[0] for f in CAND.split(", ")]) for c in made(5, 1, 1)], CAND)).count() == 0


def test_podcasts_are_conversations_unless_compiled(spark):
    talk, _ = told(spark, 1, ["Thanks for tuning in to this interview, our guest flew in today.", "How did the harbour look at dawn?", "I saw boats leaving, and we followed them."], 800)
    broken = spark.createDataFrame([(2, k, k * 2000, k * 2000 + 900, f"number one compilation word{k} other{k}") for k in range(20)], SEGMENT)
    segs = talk.union(broken)
    asked = spark.createDataFrame([(1, "auto", "auto"), (2, "podcast", None)], "job_id long, asked_kind string, asked_structure string")
    kinds = context.content_type(segs, spark.createDataFrame([(1, "Harbour podcast"), (2, None)], "job_id long, title string"))
    r = {x.job_id: x for x in context.resolved(asked, kinds, segs).collect()}
    assert (r[1].kind, r[1].structure) == ("podcast", "conversation") and r[1].confidence_bp == 7200
    assert r[1].signals == ["title/subject mentions podcast", "podcast/interview content"]
    assert (r[2].kind, r[2].structure) == ("podcast", "compilation") and r[2].signals[0] == "user-selected content type" and "multiple major pauses" in r[2].signals
    chosen = spark.createDataFrame([(1, "gameplay", " CONVERSATION "), (2, "bogus", "single-story")], asked.schema)
    r = {x.job_id: x for x in context.resolved(chosen, kinds, segs).collect()}
    assert (r[1].kind, r[1].structure, r[1].confidence_bp, r[1].signals) == ("gameplay", "conversation", 10000, ["user-selected content type", "user-selected content structure"])
    assert r[2].structure == "single-story"


def test_any_number_of_fillers_goes(spark):
    x = spark.createDataFrame([("um " * 30 + "the harbour froze over",), ("so, well, the harbour",), ("um short one",), ("um shorter1",), ("I think we should leave the harbour",)], "t string")
    assert [r[0] for r in x.select(copywriting.strip_fillers(F.col("t"))).collect()] == ["the harbour froze over", "so, well, the harbour", "short one", "um shorter1", "we should leave the harbour"]


def test_plans_keep_their_defaults(spark):
    x = spark.createDataFrame([('{"mode": "face", "keyframes": [[0.12345, 0.1234567], [1, 0.5]], "extra": 1}',), ("{}",), ("{broken",)], "j string").select(projects.plan_of(F.col("j")).alias("p"))
    r = [y.p for y in x.collect()]
    assert r[0].mode == "face" and r[0].sample_count == 0 and r[1].mode == "center" and r[1].keyframes == [] and r[1].visual_profile == "standard"
    again = x.where("p is not null").select("p.*").select(projects.plan_json().alias("j")).collect()
    assert '"keyframes":[[0.123,0.12346],[1.0,0.5]]' in again[0].j


def test_frames_of_a_long_job_are_the_same_in_blocks(spark, monkeypatch):
    from tidemark.operators import ranking, scenes

    rng = random.Random(9)
    words = ["harbour", "market", "winter", "engine", "garden", "letter", "bridge", "island", "doctor", "signal"]
    rows, at = [], 0
    for k in range(260):
        at += rng.choice([0, 20, 60, 130, 200, 380])
        rows.append((1, k, at, at + 400, " ".join(rng.sample(words, 4)) + "."))
        at += 400
    segs = spark.createDataFrame(rows + [(2, k, k * 500, k * 500 + 450, "Only a few here.") for k in range(3)], SEGMENT)
    cuts = spark.createDataFrame([(1, t) for t in range(0, at, 3100)], "job_id long, cut_cs long")

    def seen():
        w = ranking.windows(segs).select("job_id", "start_ix", "end_ix", "text", "gap_before", "gap_after", "at_limit", "tokens.n")
        return [sorted(map(tuple, df.collect())) for df in (scenes.gaps(segs), scenes.topic_shifts(segs), scenes.scenes(segs.withColumn("compilation", F.lit(True)), cuts), w)]

    whole = seen()
    monkeypatch.setattr(scenes.blocked, "__defaults__", (32,))
    parts = seen()
    assert parts == whole and len(whole[2]) > 20 and len(whole[3]) > 500


def test_a_job_too_short_for_a_window_gets_its_one_clip(spark):
    from tidemark.operators import ranking

    short, _ = told(spark, 1, ["The ferry left early.", "Nobody told the passengers."], 500)
    long, _ = told(spark, 2, ["We walked along the frozen canal for hours, talking about nothing at all that night."] * 12, 600)
    got = ranking.best(short.union(long)).collect()
    assert [(r.start_ix, r.end_ix, r.clip_start, r.clip_end, r.rank) for r in got if r.job_id == 1] == [(0, 1, 0, 1036, 1)]
    assert [r.rank for r in sorted(got, key=lambda r: r.rank) if r.job_id == 2][:1] == [1] and all(1 <= r.score <= 98 for r in got)
