"""The followed speaker of clips whose samples arrive as a stream, in any order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import speakers as R

OUT = "clip_id long, at timestamp, target double, camera double, follows string, switched boolean"
_STATE = R.STATE.replace(" int", " long") + ", begun boolean"
_FACE = ("center", "area", "left", "right", "activity")
#: A sample that waits: its time in microseconds, and the numbers of its faces one after another.
_WAITS = "us long, cut boolean, speech boolean, motion double, faces array<double>"


def advance(s: dict[str, Any], x: dict[str, Any]) -> tuple[float, str, bool]:
    """Takes a clip's state (in place) past one sample of the standard profile; (target, what is followed, switched)."""
    begins, s["begun"] = not s["begun"], True
    if x["cut"]:
        s.update(active=None, pending=None, pending_n=0, since_active=R.LONG_AGO, since_face=R.LONG_AGO, previous=None, camera=R.MIDDLE)
    faces, active, switched = x["faces"], s["active"], False
    if not faces:
        s["since_face"] += 1
        if s["previous"] is not None and s["since_face"] <= R.FACE_HOLD["standard"] and not x["cut"]:
            raw, follows = s["previous"], "face_hold"
        else:
            raw, follows = (x["motion"], "motion") if x["motion"] is not None and not x["cut"] else (R.MIDDLE, "center")
    else:
        top_area = max(f["area"] for f in faces)
        seen = [f for f in faces if f["area"] >= top_area * R.IMPORTANT]
        near = active is not None and any(abs(f["center"] - active) <= R.VISIBLE for f in seen)
        ranked = sorted(seen, key=lambda f: -f["activity"])
        if len(seen) == 1:
            nearness = lambda c: 1.0 if s["previous"] is None else max(R.LEAST_NEARNESS, 1.0 - abs(c - s["previous"]))
            raw, follows = max(faces, key=lambda f: f["area"] * nearness(f["center"]))["center"], "face"
            s.update(active=raw, since_active=0)
        elif x["speech"] and not x["cut"] and not begins and ranked[0]["activity"] >= max(R.ACTIVE, ranked[1]["activity"] + R.AHEAD):
            speaker, pending, n = ranked[0]["center"], None, 0
            if not near:
                active, switched = speaker, active is not None
            elif abs(speaker - active) <= R.SAME:
                active = active * (1 - R.BLEND) + speaker * R.BLEND
            else:
                again = s["pending"] is not None and abs(speaker - s["pending"]) <= R.PENDING
                pending, n = (s["pending"] * 0.5 + speaker * 0.5, s["pending_n"] + 1) if again else (speaker, 1)
                if n >= R.CONFIRM:
                    active, pending, n, switched = pending, None, 0, True
            s.update(active=active, pending=pending, pending_n=n, since_active=0)
            raw, follows = active, "speaker"
        else:
            s["since_active"] += 1
            held = x["speech"] and near and s["since_active"] <= R.HOLD
            raw, follows = (active, "speaker_hold") if held else ((min(f["left"] for f in seen) + max(f["right"] for f in seen)) / 2, "face_group")
        s.update(previous=raw, since_face=0)
    target = min(R.RIGHT_EDGE, max(R.LEFT_EDGE, raw))
    most, weight = R.CAMERA[next((k for k in ("speaker", "face") if follows.startswith(k)), "other")]
    s["camera"] = min(R.RIGHT_EDGE, max(R.LEFT_EDGE, s["camera"] + min(most, max(-most, target - s["camera"])) * weight))
    return target, follows, switched


class Tracker(StatefulProcessor):
    """Holds a clip's samples until the watermark has passed them, follows them in order, and forgets a clip after a while.

    Calls of the state cost more than the work on a sample, so a clip's samples of a batch are put away in one call, under
    one timer at the earliest of them, and all that the watermark has passed by then is followed at once.
    """

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getListState("waiting", _WAITS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Samples wait for the watermark: by then all earlier ones are there."""
        came = []
        for df in rows:
            for us, cut, speech, motion, faces in zip(*(df[c].tolist() for c in ("us", "cut", "speech", "motion", "faces")), strict=True):
                found = [] if faces is None else [f[c] for f in faces for c in _FACE]
                came.append((us, bool(cut), bool(speech), None if pd.isna(motion) else motion, found))
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(_ms(min(x[0] for x in came)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        names = [c.split()[0] for c in _STATE.split(", ")]
        kept, due = [], []
        for x in self.waiting.get():
            (due if x[0] <= passed else kept).append(x)
        if not due:
            if not kept and not any(True for _ in self.handle.listTimers()):  # the last one: nothing came for a while
                self.state.clear()
            return
        found = self.state.get()
        s = dict(zip(names, found, strict=True)) if found is not None else {"active": None, "pending": None, "pending_n": 0, "since_active": R.LONG_AGO, "since_face": R.LONG_AGO, "previous": None, "camera": R.MIDDLE, "begun": False}
        due.sort(key=lambda x: x[0])
        out = []
        for us, cut, speech, motion, flat in due:
            faces = [dict(zip(_FACE, flat[i : i + len(_FACE)], strict=True)) for i in range(0, len(flat), len(_FACE))]
            target, follows, switched = advance(s, {"cut": cut, "speech": speech, "motion": motion, "faces": faces})
            out.append((key[0], us, target, s["camera"], follows, switched))
        self.state.update(tuple(s[c] for c in names))
        if kept:
            self.waiting.put(kept)
            self.handle.registerTimer(_ms(min(x[0] for x in kept)))
        else:
            self.waiting.clear()
        self.handle.registerTimer(_ms(due[-1][0]) + self.forget_ms)
        yield pd.DataFrame(out, columns=["clip_id", "us", "target", "camera", "follows", "switched"])

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-us // 1000)


def followed(samples: DataFrame, late: str = "1 hour", forget_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """The stream of OUT for samples(clip_id, at, cut, speech, motion, faces), a stream of samples in any order.

    A sample is followed when the watermark has passed it, so what comes out equals the fold over the sorted clip,
    however the samples are spread over batches; what is more than `late` behind is dropped. State is one row a clip
    and the samples that wait; a clip without samples for forget_ms is forgotten. Needs the RocksDB state store.
    """
    x = samples.withWatermark("at", late).select("clip_id", "at", F.unix_micros("at").alias("us"), "cut", "speech", "motion", "faces")
    out = x.groupBy("clip_id").transformWithStateInPandas(Tracker(forget_ms), OUT.replace("at timestamp", "us long"), "Append", "EventTime")
    return out.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "at")


def batch(samples: DataFrame) -> DataFrame:
    """The same over a table."""
    x = samples.withColumn("t", F.unix_millis("at") / 1000.0)
    return R.followed(x, "clip_id").select("clip_id", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")).alias("at"), "target", "camera", "follows", "switched")
