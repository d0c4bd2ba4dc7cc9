"""Rebalanced phrases, styled documents and their files, followed speakers with ties, cuts and empty samples."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import captions, speakers
from tidemark.operators import styled_captions as styled

LIMITS = ["clip", "max_words", "max_chars", "max_cs", "pause_cs"]


def phrases(spark, texts, max_words=5, max_chars=31, gap=5):
    """The rebalanced phrases of words of 20 hundredths of a second each."""
    rows = [(1, max_words, max_chars, 270, 46, k, 0, k * (20 + gap), k * (20 + gap) + 20, w) for k, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "clip int, max_words int, max_chars int, max_cs int, pause_cs int, seg_ix int, word_ix int, rel_start long, rel_end long, word string")
    x = captions.phrase_lists(df, LIMITS).select(captions.rebalanced(F.col("phrases"), F.col("max_words"), F.col("max_chars")).alias("p")).collect()
    return [" ".join(w.word for w in p) for p in x[0].p] if x else []


def test_a_dangling_connective_moves_on(spark):
    assert phrases(spark, "we walked home late and nobody saw it.".split()) == ["we walked home late", "and nobody saw it."]
    # where the next phrase is full, it stays
    assert phrases(spark, "we walked home late and nobody saw it there today friends. ok".split())[0] == "we walked home late and"


def test_what_moves_counts_for_the_next_step(spark):
    got = phrases(spark, ["one", "two", "three", "four", "to.", "the", "of.", "for", "last", "words", "here"], 5, 60)
    assert got == ["one two three four", "to. the", "of. for last words here"]


def test_single_and_tiny_phrases(spark):
    assert phrases(spark, ["and"]) == ["and"]
    assert phrases(spark, "all of this is done now".split()) == ["all of this is done now"]  # a last word joins the full phrase before it
    assert phrases(spark, ["alpha.", "beta."]) == ["alpha. beta."]


def clips(spark, rows):
    return styled.dressed(spark.createDataFrame(rows, "clip int, lo double, hi double, style string, content_type string, layout string, frame_size string, zone string, platform string, source_width int, source_height int"))


def test_documents_and_their_files(spark, tmp_path):
    c = clips(spark, [
        (1, 0.0, 3.0, "viral", "auto", "fill", "auto", "auto", "auto", 0, 0), (2, 0.0, 3.0, "Clean", "auto", "fill", "auto", "lower", "tiktok", 0, 0),
        (3, 0.0, 3.0, "cinematic", "anime", "focus", "balanced", "lower", "tiktok", 1920, 1080), (4, 0.0, 0.2, "nonsense", "bogus", "fill", "auto", "auto", "auto", 0, 0), (5, 0.0, 4.0, "meme", "auto", "preserve", "auto", "upper", "auto", 1920, 1080),
    ])
    w = spark.createDataFrame([(k, 0, i, i * 50, i * 50 + 40, t) for k in (1, 2, 3) for i, t in enumerate(["Go", "{now}", "home"])], "clip int, seg_ix int, word_ix int, rel_start long, rel_end long, word string")
    spoken = styled.events(w.join(c.drop("lo", "hi"), "clip"), ["clip"])
    less = c.join(spoken.select("clip").distinct(), "clip", "left_anti")
    held = spark.createDataFrame([(5, 0, 0.0, 4.0, "old timing still works")], "clip int, seg_ix int, start double, end double, text string")
    docs = styled.documents(c, spoken.unionByName(styled.fallback_events(less, held, ["clip"])), ["clip"])
    styled.write_documents(docs, f"file://{tmp_path}/out", ["clip"])
    found = {}
    for k in range(1, 6):
        (file,) = Path(tmp_path, "out", f"clip={k}").glob("part-*")
        found[k] = file.read_text(encoding="utf-8")
        assert found[k].startswith("﻿[Script Info]\n") and found[k].endswith("\n") and not found[k].endswith("\n\n")
    lines = {k: [x for x in t.splitlines() if x.startswith("Dialogue")] for k, t in found.items()}
    assert len(lines[1]) == 3 and lines[1][1].startswith(r"Dialogue: 0,0:00:00.50,0:00:01.00,Default,,0,0,0,,{\an2\pos(360,780)}Go {\c&H0048E8FF\bord6") and r"\{now\}{\c&H00FFFFFF" in lines[1][1]
    assert lines[2] == [r"Dialogue: 0,0:00:00.00,0:00:01.40,Default,,0,0,0,,{\an2\pos(360,985)\fad(55,70)}Go \{now\} home"]
    assert "Segoe UI Semibold,36," in found[3] and r"\pos(360,982)" in lines[3][0]  # low in the picture, whatever the platform
    assert "Style: Default,Arial,44" in found[4] and lines[4][0].endswith(r"\fad(55,70)} ") and "0:00:00.50" in lines[4][0]
    assert "OLD TIMING STILL WORKS" in lines[5][0] and len(lines[5]) == 1


# speakers


def plain(samples, profile="standard"):
    """The rules read sample by sample; samples: (t, cut, speech, motion, [(center, area, left, right, activity)])."""
    active = pending = prev = None
    n, quiet, lost, cam, out = 0, 999, 999, 0.5, []
    for at, (t, cut, speech, motion, faces) in enumerate(samples):
        switched = False
        if cut:
            active = pending = prev = None
            n, quiet, lost, cam = 0, 999, 999, 0.5
        if not faces:
            lost += 1
            if prev is not None and lost <= (1 if profile == "cinematic" else 2) and not cut:
                raw, kind = prev, "face_hold"
            else:
                raw, kind = (motion, "motion") if motion is not None and not cut else (0.5, "center")
        else:
            big = [f for f in faces if f[1] >= 0.35 * max(f[1] for f in faces)]
            if len(big) < 2:
                raw = max(faces, key=lambda f: f[1] * (1.0 if prev is None else max(0.15, 1.0 - abs(f[0] - prev))))[0]
                kind, active, quiet = "face", raw, 0
            else:
                order = sorted(big, key=lambda f: -f[4])
                near = active is not None and any(abs(f[0] - active) <= 0.18 for f in big)
                if profile == "standard" and speech and not cut and at and order[0][4] >= 0.010 and order[0][4] >= order[1][4] + 0.0035:
                    top = order[0][0]
                    if active is None or not near:
                        switched, active, pending, n = active is not None, top, None, 0
                    elif abs(top - active) <= 0.17:
                        active, pending, n = active * 0.72 + top * 0.28, None, 0
                    else:
                        n, pending = (n + 1, pending * 0.5 + top * 0.5) if pending is not None and abs(top - pending) <= 0.12 else (1, top)
                        if n >= 2:
                            switched, active, pending, n = True, pending, None, 0
                    raw, kind, quiet = active, "speaker", 0
                else:
                    quiet += 1
                    if profile == "standard" and speech and active is not None and quiet <= 2 and near:
                        raw, kind = active, "speaker_hold"
                    else:
                        raw, kind = (min(f[2] for f in big) + max(f[3] for f in big)) / 2, "face_group"
            prev, lost = raw, 0
        goal = min(0.9, max(0.1, raw))
        most, weight = {"cinematic": (0.05, 0.3), "visual": (0.07, 0.38)}.get(profile) or ((0.095, 0.56) if kind.startswith("speaker") else (0.11, 0.62) if kind.startswith("face") else (0.08, 0.42))
        cam = min(0.9, max(0.1, cam + min(most, max(-most, goal - cam)) * weight))
        out.append((t, goal, cam, kind, switched))
    return out


def face(center, activity=0.0, area=100.0):
    return (center, area, center - 0.05, center + 0.05, activity)


def made(seed, n=60):
    rng = random.Random(seed)
    return [(k * 0.5, rng.random() < 0.06, rng.random() < 0.9, rng.choice([None, rng.random()]), [face(rng.choice([0.2, 0.5, 0.8]) + rng.randrange(-4, 5) / 100, rng.choice([0.0, 0.004, 0.02, 0.02]), rng.choice([100.0, 100.0, 60.0, 20.0])) for _ in range(rng.choice([0, 1, 2, 2, 3]))]) for k in range(n)]


SCHEMA = f"clip long, t double, cut boolean, speech boolean, motion double, faces array<{speakers.FACE}>"


@pytest.mark.parametrize("profile", ["standard", "visual", "cinematic"])
def test_followed_equals_the_rules(spark, profile):
    tracks = {k: made(k) for k in range(6)}
    df = spark.createDataFrame([(k, *x) for k, v in tracks.items() for x in v], SCHEMA).repartition(3)
    got = {k: [] for k in tracks}
    for r in speakers.followed(df, "clip", profile).orderBy("clip", "t").collect():
        got[r.clip].append((r.t, r.target, r.camera, r.follows, r.switched))
    for k, v in tracks.items():
        want = plain(v, profile)
        assert [x[3:] for x in got[k]] == [x[3:] for x in want]
        assert got[k] == [(t, pytest.approx(a, abs=1e-12), pytest.approx(c, abs=1e-12), f, s) for t, a, c, f, s in want]


def follow(spark, samples):
    df = spark.createDataFrame([(1, float(x[0]), *x[1:]) for x in samples], SCHEMA)
    return [(r.follows, round(r.target, 3), r.switched) for r in speakers.followed(df, "clip").orderBy("t").collect()]


def test_a_switch_takes_two_samples(spark):
    a, b = [face(0.2, 0.03), face(0.8)], [face(0.2), face(0.8, 0.03)]
    got = follow(spark, [(k, False, True, None, f) for k, f in enumerate([a, a, b, a, b, b])])
    assert [x[0] for x in got[1:]] == ["speaker"] * 5
    assert [x[1] for x in got[1:]] == [0.2, 0.2, 0.2, 0.2, 0.8] and got[-1][2]


def test_a_vanished_speaker_is_left_at_once(spark):
    a, b = [face(0.2, 0.03), face(0.8)], [face(0.5), face(0.8, 0.03)]
    assert follow(spark, [(0, False, True, None, a), (1, False, True, None, a), (2, False, True, None, b)])[-1] == ("speaker", 0.8, True)


def test_ties_empty_samples_and_nulls(spark):
    tie = [face(0.3, 0.03), face(0.7, 0.03)]
    got = follow(spark, [(0, None, None, None, None), (1, None, True, None, tie), (2, None, True, 0.6, []), (3, False, True, 0.6, []), (4, False, True, 0.6, []), (5, True, True, 0.6, [])])
    assert got == [("center", 0.5, False), ("face_group", 0.5, False), ("face_hold", 0.5, False), ("face_hold", 0.5, False), ("motion", 0.6, False), ("center", 0.5, False)]
    assert follow(spark, []) == []
