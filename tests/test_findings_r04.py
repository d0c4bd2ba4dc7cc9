"""Cases from the findings of round 4."""

import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemark.operators import captions, media, tracks
from tidemark.plans import analytics
from tidemark.streaming import tracker


def test_quality_in_whole_numbers_keeps_halves(spark):
    # 40065 / 1000 / 100 * 10000 is 4006.4999999999995
    df = spark.createDataFrame([(1, 3, 1000, 40065, 0, 0, 0, None), (2, 1, 8000, 409340, 2302, 8, 1, 0.4375)], "job_id long, segment_count long, n long, s long, n48 long, n25 long, weak long, weakest double")
    got = {r.job_id: r for r in analytics.quality_bp(df).collect()}
    for r in df.collect():
        g, half_up = got[r.job_id], lambda a, b: (2 * a + b) // (2 * b)
        assert (g.low_bp, g.very_bp, g.avg_bp) == (half_up(10000 * r.n48, r.n), half_up(10000 * r.n25, r.n), half_up(100 * r.s, r.n))
    assert got[2].weakest_bp == 4375


def test_sizes_round_ties_to_even_and_the_rest_exactly(spark):
    mb, gb = 1 << 20, 1 << 30
    sizes = [0, 1535, 1536, mb - 1, mb, 5 * mb // 4, 7 * mb // 4, 256 * mb + mb // 4, 3 * mb + mb // 20, 2 * mb - 1, gb - 1, gb, gb + gb // 8, gb + 3 * gb // 8, 10**15 + 1, (1 << 62) + 12345]
    df = spark.createDataFrame([(k, n) for k, n in enumerate([*sizes, None])], "k int, n long")
    got = [r.x for r in df.select("k", media.human_bytes(F.col("n")).alias("x")).orderBy("k").collect()]
    want = [f"{max(1, int(n / 1024 + 0.5))} KB" if n < mb else f"{n / mb:.1f} MB" if n < gb else f"{n / gb:.2f} GB" for n in sizes]
    assert got == [*want, None]


def _simplified(points, most):
    """A plain reading of tracks.simplify for one track."""
    p = sorted(x for x in points if x[0] is not None)
    p = [x for i, x in enumerate(p) if i + 1 == len(p) or p[i + 1][0] - x[0] >= 0.0005]
    kept, tolerance = list(range(len(p))), 0.004
    while len(kept) > most and tolerance < 0.08 * 1.45:
        kept, todo = [0, len(p) - 1], [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                (ta, ca), (tb, cb) = p[a], p[b]
                error = [abs(p[i][1] - (ca + (cb - ca) * (p[i][0] - ta) / max(1e-9, tb - ta))) for i in range(a + 1, b)]
                k = error.index(max(error))
                if error[k] > tolerance:
                    kept.append(a + 1 + k)
                    todo += [(a, a + 1 + k), (a + 1 + k, b)]
        kept.sort()
        tolerance *= 1.45
    if len(kept) > most:
        kept = [kept[round(i * (len(kept) - 1) / (most - 1))] for i in range(most)]
    return [p[i] for i in kept]


def test_only_long_tracks_leave_the_columns(spark):
    rng = random.Random(4)
    made = {k: [(i * 0.5, rng.random()) for i in range(n)] for k, n in enumerate((1, 2, 12, 13, 40, 90))}
    made[1] += [(None, 0.3)]  # a point without a time is none, and the point before it stays
    made[2] += [(2.0003, 0.9)]
    df = spark.createDataFrame([(k, *x) for k, xs in made.items() for x in xs], "track_id long, t double, c double").repartition(3)
    out = tracks.simplify(df, "track_id", 12)
    got = {}
    for r in out.collect():
        got.setdefault(r.track_id, []).append((r.t, r.c))
    assert {k: sorted(v) for k, v in got.items()} == {k: _simplified(v, 12) for k, v in made.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "(_n" in plan[plan.index("FlatMapGroupsInPandas"):] and plan.index("Union") < plan.index("FlatMapGroupsInPandas")


class _Cell:
    """A state kept in plain Python, which counts its calls."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "put"):
                self.value = args[0]
            elif name == "appendList":
                self.value = [*(self.value or ()), *args[0]]
            elif name == "appendValue":
                self.value = [*(self.value or ()), args[0]]
            elif name == "clear":
                self.value = None
            elif name == "exists":
                return self.value is not None
            elif name == "get":
                return self.value if self is self.calls.single else iter(self.value or ())

        return call


class _Handle(list):
    """Timers and states of one clip."""

    def getValueState(self, name, schema):
        self.single = _Cell(self)
        return self.single

    def getListState(self, name, schema):
        return _Cell(self)

    def registerTimer(self, ms):
        self.append("registerTimer")
        self.timers = {*getattr(self, "timers", ()), ms}

    def listTimers(self):
        return iter(self.timers)


def test_a_clip_calls_its_state_once_a_batch_and_not_once_a_sample():
    handle, t = _Handle(), tracker.Tracker(1000)
    t.init(handle)
    start, face = 1_700_000_000_000_000, {"center": 0.3, "area": 10.0, "left": 0.2, "right": 0.4, "activity": 0.0}
    rows = pd.DataFrame({"us": [start + 500_000 * k for k in range(40)][::-1], "at": pd.Timestamp(0), "cut": False, "speech": True, "motion": None, "faces": [[face]] * 40})
    for part in (rows[:20], rows[20:]):
        list(t.handleInputRows((1,), iter([part]), None))
    assert len(handle) == 4 and min(handle.timers) == start // 1000
    # the watermark has passed 30 samples: they come in order at once, and the others wait under their own timer
    passed = TimerValues(0, start // 1000 + 14_500)
    out = pd.concat(t.handleExpiredTimer((1,), passed, ExpiredTimerInfo(start // 1000)))
    assert list(out.us) == [start + 500_000 * k for k in range(30)] and len(handle) <= 10
    assert start // 1000 + 15_000 in handle.timers
    assert not list(t.handleExpiredTimer((1,), passed, ExpiredTimerInfo(start // 1000)))
    out = pd.concat(t.handleExpiredTimer((1,), TimerValues(0, start // 1000 + 60_000), ExpiredTimerInfo(start // 1000 + 15_000)))
    assert list(out.us) == [start + 500_000 * k for k in range(30, 40)]


def test_words_and_phrases_are_put_together_once_a_clip(spark):
    df = spark.createDataFrame([(1, 5, 31, 270, 46, k, 0, k * 25, k * 25 + 20, w) for k, w in enumerate("we walked home late and nobody saw it.".split())], "clip int, max_words int, max_chars int, max_cs int, pause_cs int, seg_ix int, word_ix int, rel_start long, rel_end long, word string")
    x = captions.phrase_lists(df, ["clip", "max_words", "max_chars", "max_cs", "pause_cs"])
    x = x.withColumn("phrases", captions.rebalanced(F.col("phrases"), F.col("max_words"), F.col("max_chars")))
    assert [[w.word for w in p] for p in x.first().phrases] == [["we", "walked", "home", "late"], ["and", "nobody", "saw", "it."]]
    # the words and their phrases are put together once a clip, and not once more for every phrase
    assert "transform(array(arrays_zip(" in x._jdf.queryExecution().optimizedPlan().toString()
