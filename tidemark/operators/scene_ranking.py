"""The scene-local ranker: windows inside scenes, judged as stories, and a diverse choice of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as T
from tidemark.operators import ranking
from tidemark.sources.shared import kept

MOST = 38
NONE = 1000  # a pause in centiseconds where there is no neighbour


def duration_bounds(kind: Column, preference: Column) -> Column:
    """struct(low, high): the soft length bounds in seconds of a content type, shorter or longer by preference."""
    guide = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in lx.DURATION_GUIDES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind), F.array(*map(F.lit, lx.DURATION_GUIDES["other"])))
    low, high, asked = guide[0], guide[1], F.lower(F.trim(preference))
    least = F.when(asked == "short", F.greatest(F.lit(8), T.half_even(low * 0.65))).when(asked == "longer", F.greatest(low, T.half_even(low * 1.15))).otherwise(low)
    most = F.when(asked == "short", F.least(F.lit(60), F.greatest(least + 8, T.half_even(high * 0.72)))).when(asked == "longer", F.least(F.lit(120), F.greatest(least + 18, T.half_even(high * 1.45)))).otherwise(high)
    return F.struct(least.alias("low"), most.alias("high"))


def duration_cap(kind: Column, preference: Column, high: Column) -> Column:
    """The longest candidate in seconds: longer for stories, and where longer clips are asked for."""
    asked = F.lower(F.trim(preference))
    extra = F.when(kind.isin("anime", "film-tv", "documentary", "podcast"), 45).otherwise(35) + F.when(asked == "longer", 20).otherwise(0)
    return F.when(asked == "short", F.least(F.lit(90), high + 18)).otherwise(F.least(F.lit(145), high + extra))


def windows(segs: DataFrame, scenes: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Runs of up to MOST segments inside one scene, from admissible starts, within the length bounds of their job.

    kinds(job_id, kind, preference): each job's content type and wished length; other and auto where it has none.
    """
    if kinds is not None:
        segs = segs.join(kinds.select("job_id", "kind", "preference"), "job_id", "left")
    else:
        segs = segs.withColumns({"kind": F.lit(None).cast("string"), "preference": F.lit(None).cast("string")})
    segs = segs.withColumns({"kind": F.coalesce("kind", F.lit("other")), "preference": F.coalesce("preference", F.lit("auto"))})
    segs = segs.withColumn("_b", duration_bounds(F.col("kind"), F.col("preference"))).withColumns({"low_s": F.col("_b.low"), "high_s": F.col("_b.high")}).drop("_b")
    x = segs.join(scenes.select(F.col("job_id").alias("_j"), "scene_id", "first_ix", "last_ix", F.col("start_cs").alias("scene_start"), F.col("end_cs").alias("scene_end")), (F.col("job_id") == F.col("_j")) & F.col("seg_ix").between(F.col("first_ix"), F.col("last_ix"))).drop("_j")
    by = Window.partitionBy("job_id", "scene_id").orderBy("seg_ix")
    x = x.withColumns({
        "prev_text": F.lag("text").over(by), "raw_before": F.coalesce(F.col("start_cs") - F.lag("end_cs").over(by), F.lit(NONE)),
        "_w": F.collect_list(F.struct("seg_ix", "start_cs", "end_cs", "text")).over(by.rowsBetween(0, MOST)),
    })
    x = x.where(T.starts_clean(F.col("text")) | F.col("prev_text").isNull() | (F.col("seg_ix") <= F.col("first_ix") + 2))
    least, most = 100 * F.greatest(F.lit(5), F.col("low_s") - 5), 100 * duration_cap(F.col("kind"), F.col("preference"), F.col("high_s"))
    inside = F.filter(F.sequence(F.lit(1), F.least(F.lit(MOST), F.size("_w"))), lambda k: (F.element_at("_w", k)["end_cs"] - F.col("start_cs")).between(least, most))
    y = x.select("*", F.explode(inside).alias("k"))
    at = lambda k: F.get("_w", k)
    end, nxt, second = at(F.col("k") - 1), at(F.col("k")), at(F.lit(1))
    return y.select(
        "job_id", "scene_id", F.col("seg_ix").alias("start_ix"), end["seg_ix"].alias("end_ix"), "start_cs", end["end_cs"].alias("end_cs"), "scene_start", "scene_end",
        F.col("text").alias("start_text"), end["text"].alias("end_text"), nxt["text"].alias("next_text"), "prev_text",
        F.col("raw_before").alias("gap_before"), F.coalesce(nxt["start_cs"] - end["end_cs"], F.lit(NONE)).alias("gap_after"),
        F.when(F.col("k") > 1, second["text"]).alias("second_text"), (second["start_cs"] - at(F.lit(0))["end_cs"]).alias("first_gap"),
        F.concat_ws(" ", F.when(F.col("k") > 1, at(F.col("k") - 2)["text"]), end["text"]).alias("tail_text"),
        T.clean(F.array_join(F.transform(F.slice("_w", F.lit(1), F.col("k")), lambda w: w["text"]), " ")).alias("text"), "kind", "low_s", "high_s",
    )


def open_loop(c: Column) -> Column:
    x = F.regexp_replace(F.lower(T.clean(c)), "[ .!?…\"”’]+$", "")
    third = F.substring(x, (F.length(x) * 0.66).cast("int") + 1, F.length(x))
    return F.right(x, F.lit(180)).rlike("|".join(lx.OPEN_LOOP_PATTERNS)) | T.any_in(third, lx.LATE_PIVOTS) & (T.closure_end(third) < 0)


def assessed(wins: DataFrame) -> DataFrame:
    """wins with narrative (1..99), continuation (0..2), strengths, warnings, ending and opening penalty."""
    c = F.col
    question = lambda t: F.coalesce(F.right(F.rtrim(t), F.lit(1)) == "?", F.lit(False))
    o = T.opening(c("start_text"))
    first = F.coalesce(F.get(T.words(F.left(o, F.lit(90))), F.lit(0)), F.lit(""))
    gap0 = F.greatest(F.lit(0), c("gap_before"))
    x = wins.withColumns({
        "d": (c("end_cs") - c("start_cs")) / 100.0, "clean_start": T.starts_clean(c("start_text")), "follows": c("next_text").isNotNull(), "gap1": F.greatest(F.lit(0), c("gap_after")),
        "opens": F.when(c("prev_text").isNull(), F.lit(None)).when(T.starts_any(o, lx.RESPONSE_STARTS) & (gap0 < 200), "Starts like a reply without the setup").when(first.isin(*lx.POINTERS) & (gap0 < 150), "Opening depends on earlier context").when(~T.starts_clean(c("start_text")) & (gap0 < 120), "Opening is grammatically dependent"),
        "answers": c("prev_text").isNotNull() & question(c("prev_text")) & (gap0 < 200),
        "unfinished": T.unfinished(c("end_text")), "asks": question(c("end_text")), "loop": open_loop(c("text")), "closed": T.closure_end(c("text")), "tail_closed": T.closure_end(F.right("text", F.lit(220))) >= 0,
        "low": F.lower("text"), "nxt": F.coalesce(T.opening(c("next_text")), F.lit("")),
    })
    next_words = F.size(T.words(c("nxt")))
    strong = (next_words.between(1, 14)) & (T.starts_any(c("nxt"), lx.REACTION_STARTS) | F.contains("next_text", F.lit("!")) | F.contains("next_text", F.lit("?")) | T.any_in(c("nxt"), lx.REACTION_WORDS))
    same = T.overlap(T.topic_tokens(c("tail_text")), T.topic_tokens(F.coalesce("next_text", F.lit(""))))
    x = x.withColumns({
        "penalty": F.least(F.lit(45), F.coalesce(F.when(c("opens") == "Starts like a reply without the setup", 28).when(c("opens") == "Opening depends on earlier context", 18).when(c("opens").isNotNull(), 15), F.lit(0)) + F.when(c("answers"), 18).otherwise(0)),
        "ending": F.when(c("unfinished"), -1).when(F.right(T.clean(c("end_text")), F.lit(1)).isin(".", "!", "?", "…"), 2).when((c("gap1") >= 60) | ~c("follows"), 1).otherwise(0),
        "branch": F.when(c("unfinished"), 1).when(c("asks") & c("follows") & (c("gap1") < 220), 2).when(c("loop") & c("follows") & (c("gap1") < 220), 3)
        .when(c("follows") & (c("gap1") < 150) & T.starts_any(c("nxt"), lx.STRONG_CONTINUATION_STARTS), 4)
        .when(c("follows") & (c("gap1") < 115) & T.short_reaction(c("next_text")), F.when(strong, 5).otherwise(6))
        .when(c("follows") & (c("gap1") < 90) & (same >= 0.45) & (T.closure_end(F.right("text", F.lit(180))) < 0), 7)
        .when(c("follows") & (c("gap1") < 55) & ~T.starts_clean(c("next_text")), 8).otherwise(0),
    })
    b, soft = c("branch"), c("branch").isin(4, 6) & c("tail_closed")
    x = x.withColumns({
        "cont0": F.when(b.isin(1, 2, 3, 5, 7), 2).when(b.isin(4, 6), F.when(c("tail_closed"), 1).otherwise(2)).when(b == 8, 1).otherwise(0),
        "loss": F.when(b == 1, 38).when(b == 2, 34).when(b == 3, 30).when(b == 4, F.when(soft, 12).otherwise(26)).when(b == 5, 26).when(b == 6, F.when(soft, 11).otherwise(26)).when(b == 7, 20).when(b == 8, 9).otherwise(0),
        "why": F.get(F.array(*map(F.lit, ("Sentence or thought is unfinished", "Question is answered immediately after the cut", "Setup or story turn has not paid off yet", "The next line contains the immediate payoff", "Immediate reaction belongs with this moment", "Immediate reaction belongs with this moment", "The same idea continues immediately after the cut", "Dialogue appears to continue immediately"))), b - 1),
        "rest": (F.length("low") - c("closed")) / F.greatest(F.lit(1), F.length("low")), "rest_n": F.size(T.words(F.substring("low", c("closed") + 1, F.length("low")))),
        "ask_at": T.last_at(c("low"), "?"),
    })
    near = (c("closed") >= 0) & ((c("rest") <= 0.22) | (c("rest_n") <= 4))
    over = (c("closed") >= 0) & ~near & ((c("rest") > 0.30) | (c("rest_n") >= 7)) & ~c("loop")
    stops = (c("closed") < 0) & (c("cont0") == 0) & ((c("ending") >= 2) | (c("gap1") >= 80))
    late = (c("ask_at") >= (F.length("low") * 0.45).cast("int")) & (F.size(T.words(F.substring("low", c("ask_at") + 2, F.length("low")))) < 7) & c("follows") & (c("gap1") < 200)
    setup = c("second_text").isNotNull() & (F.greatest(F.lit(0), c("first_gap")) < 150) & (T.starts_any(F.coalesce(T.opening(c("second_text")), F.lit("")), lx.RESPONSE_STARTS) | question(c("start_text")))
    x = x.withColumns({"near": near, "over": over, "stops": stops, "late": late, "setup": setup, "continuation": F.when(late, 2).otherwise(c("cont0"))})
    gain = F.when(near, 8).when(over, -13).when(stops, 4).otherwise(0) - F.when(late, 24).otherwise(0) + F.when((c("continuation") == 0) & (c("closed") >= 0) & (c("gap1") >= 35), 4).otherwise(0) + F.when(setup, 6).otherwise(0)
    say = lambda cond, text: F.when(cond, F.lit(text))
    return x.withColumns({
        "narrative": F.greatest(F.lit(1), F.least(F.lit(99), 88 - c("penalty") - c("loss") + gain)),
        "strengths": F.array_compact(F.array(say(c("penalty") == 0, "Enough setup to understand the moment"), say(near, "Ends close to the payoff"), say(stops, "Natural stopping point"), say(setup, "Includes the setup needed for the response"))),
        "warnings": F.array_distinct(F.array_compact(F.array(c("opens"), say(c("answers"), "Answer needs the preceding question"), c("why"), say(over, "Extra dialogue continues after the main payoff"), say(late, "Late question needs its answer")))),
    }).drop("opens", "answers", "unfinished", "asks", "loop", "tail_closed", "nxt", "branch", "cont0", "loss", "why", "rest", "rest_n", "ask_at", "near", "stops", "late", "setup")


def repair_cost(warnings: Column) -> Column:
    costs = F.create_map(*[x for k, v in lx.REPAIR.items() for x in (F.lit(k), F.lit(v))])
    return F.least(F.lit(35), F.aggregate(F.array_distinct(warnings), F.lit(0), lambda a, w: a + F.coalesce(F.try_element_at(costs, w), F.lit(3))))


def candidates(segs: DataFrame, scenes: DataFrame, words: DataFrame | None = None, shots: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Scored clips inside scenes, with narrative, boundary_confidence, warnings, repair_cost and selection_quality.

    kinds(job_id, kind, preference): jobs of different kinds and wished lengths are ranked in one run.
    """
    c = F.col
    low, high = c("low_s"), c("high_s")
    # Written between the steps: one plan of all of them would be too large to optimise and compile.
    x = kept(assessed(kept(windows(segs, scenes, kinds), "windows")), "assessed").where((c("ending") >= 1) & (c("continuation") < 2))
    n = F.size(T.words(c("text")))
    payoff = T.any_in(c("low"), lx.PAYOFF_PHRASES) | (c("closed") >= 0)
    x = x.withColumns({"n_words": n, "paid": payoff, "turn": T.any_in(c("low"), lx.PIVOT_PHRASES)}).where("n_words >= 9 or d <= 15")
    brief = F.when(c("kind") == "meme-comedy", c("narrative") >= 80).otherwise((c("narrative") >= 92) & c("paid") & (c("ending") >= 2) & (c("n_words") >= 12))
    x = x.where((c("d") >= low) | brief & (c("continuation") == 0)).drop("n_words").withColumnRenamed("d", "seconds")
    s = kept(ranking.scored(x).withColumn("d", c("seconds")).drop("seconds"), "scored")
    whole = c("clean_start") | c("prev_text").isNull()
    s = s.withColumns({
        "whole": whole,
        "story": F.least(F.lit(99), T.half_even(0.72 * c("narrative") + 0.28 * (40 + F.when(whole, 18).otherwise(0) + F.floor(20 * c("ending") / 2) + F.when(c("paid"), 12).otherwise(0) + F.when(c("turn"), 8).otherwise(0)))),
        "confident": F.greatest(F.lit(1), F.least(F.lit(99), T.half_even(48 + c("narrative") * 0.42 + F.when(c("prev_text").isNull() | (c("gap_before") >= 65) | c("clean_start"), 8).otherwise(0) + F.when(~c("follows") | (c("gap1") >= 75) | (c("ending") >= 2), 10).otherwise(0) - F.when(c("continuation") == 1, 12).when(c("continuation") >= 2, 30).otherwise(0) - c("penalty") * 0.35))),
    })
    if words is not None:
        w = words.select(F.col("job_id").alias("_j"), F.col("seg_ix").alias("_s"), "pct").groupBy("_j", "_s").agg(F.sum("pct").alias("_p"), F.count("*").alias("_n"))
        sure = s.select("job_id", "start_ix", "end_ix").join(w, (c("job_id") == c("_j")) & c("_s").between(c("start_ix"), c("end_ix"))).groupBy("job_id", "start_ix", "end_ix").agg(F.when(F.sum("_n") >= 4, F.sum("_p") / F.sum("_n") / 100).alias("confidence"))
        s = s.join(sure, ["job_id", "start_ix", "end_ix"], "left")
    else:
        s = s.withColumn("confidence", F.lit(None).cast("double"))
    if shots is not None:
        h = shots.select(F.col("job_id").alias("_j"), "cut_cs")
        cuts = s.select("job_id", "start_ix", "end_ix", "start_cs", "end_cs").join(h, (c("job_id") == c("_j")) & c("cut_cs").between(c("start_cs"), c("end_cs"))).groupBy("job_id", "start_ix", "end_ix").agg(F.count("*").alias("cuts"))
        s = s.join(cuts, ["job_id", "start_ix", "end_ix"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(0)))
    else:
        s = s.withColumn("cuts", F.lit(None).cast("long"))
    busy = F.coalesce((c("cuts") >= 5) & (c("cuts") / F.greatest(c("d"), F.lit(1.0)) > 0.38), F.lit(False))
    unsure = F.coalesce(c("confidence") < 0.55, F.lit(False))
    say = lambda cond, text: F.when(cond, F.lit(text))
    s = s.withColumn("warnings", F.concat("warnings", F.array_compact(F.array(say(c("ending") == 1, "Ending boundary is uncertain"), say(~c("whole"), "Opening may need more context"), say(~c("paid") & ~c("turn") & (c("narrative") < 78), "Story completeness may be limited"), say(unsure, "Low transcript confidence"), say(busy, "Frequent shot changes: review framing")))))
    bias = F.when(c("d").between(24, 48), 15.0).when(c("d").between(18, 60), 8.0).otherwise(-F.least(F.lit(18.0), F.abs(c("d") - 36) * 0.65))
    score = 0.38 * (c("score") - bias * 0.62) + 0.62 * (c("hook") * 0.17 + c("standalone") * 0.15 + c("payoff") * 0.18 + c("clarity") * 0.10 + c("story") * 0.16 + c("narrative") * 0.24)
    score = score - F.when(c("d") < low, F.least(F.lit(10.0), (low - c("d")) * 0.8)).when(c("d") > high, F.least(F.lit(9.0), (c("d") - high) * 0.45)).otherwise(0.0)
    score = score - F.when(~c("whole"), 10).otherwise(0) - F.when(c("ending") == 1, 8).otherwise(0) - F.when(c("continuation") == 1, 10).otherwise(0)
    score = score - F.when((c("narrative") >= 86) & (c("continuation") == 0) & (c("d") > low), F.least(F.lit(5.0), F.greatest(F.lit(0.0), c("d") - F.greatest(low, F.lit(18))) * 0.05)).otherwise(0.0)
    score = score + (c("confident") - 70) * 0.06 - F.when(c("over"), 14).otherwise(0) - F.when(unsure, 9).otherwise(0) - F.when(busy, 4).otherwise(0)
    s = s.withColumn("repair_cost", repair_cost(c("warnings"))).withColumn("_raw", score)
    s = s.withColumn("score", F.greatest(F.lit(1), F.least(F.lit(98), T.half_even(c("_raw") - c("repair_cost") * 0.18))))
    quality = T.half_even(c("score") * 0.62 + c("narrative") * 0.24 + c("confident") * 0.14 - c("repair_cost") * 0.38)
    hook = ranking.first_sentence(c("text"))
    visual = F.when(c("cuts").isNotNull(), F.greatest(F.lit(35), 78 - F.greatest(F.lit(0), T.half_even(c("cuts") / F.greatest(c("d"), F.lit(1.0)) * 90) - 20)))
    return s.select(
        "job_id", "scene_id", "start_ix", "end_ix", F.greatest("scene_start", c("start_cs") - 12).alias("clip_start"), F.least(c("scene_end") + 16, c("end_cs") + 16).alias("clip_end"),
        "score", "narrative", "continuation", F.col("confident").alias("boundary_confidence"), "warnings", "repair_cost", "story", "hook", "standalone", "payoff", "retention", "clarity", visual.cast("int").alias("visual"), "kind",
        F.greatest(F.lit(1), F.least(F.lit(99), quality)).alias("selection_quality"), T.moment_type(c("text")).alias("moment"), ranking.signature(hook).alias("sig"), T.topic_tokens(c("text")).alias("topics"),
        F.slice(F.array_distinct(F.concat(F.array_compact(F.array(say(F.lower(F.left("start_text", F.lit(110))).rlike("|".join(lx.HOOK_PHRASES)), "Strong opening hook"), say(c("paid"), "Complete payoff or takeaway"))), "strengths", F.array_compact(F.array(say(c("narrative") >= 88, "Narratively complete moment"))), "reasons")), 1, 4).alias("reasons"),
    )


PICKED = "scene_id int, start_ix int, end_ix int, clip_start long, clip_end long, score int, narrative int, selection_quality int, moment string, sig array<string>, topics array<string>"


def position() -> Column:
    """The place of a candidate in the order of choice, least first: quality, score, narrative, boundaries, fewer warnings, shorter, earlier."""
    c = F.col
    return F.struct((-c("selection_quality")).alias("a"), (-c("score")).alias("b"), (-c("narrative")).alias("c"), (-c("boundary_confidence")).alias("d"), F.size("warnings").alias("e"), (c("clip_end") - c("clip_start")).alias("f"), c("start_ix").alias("g"), c("end_ix").alias("h"))


def chosen(cands: DataFrame, most: int = 4) -> DataFrame:
    """(job_id, rank, ...): the best clips of each job from different scenes and of different kinds while quality is close, then the best of the rest.

    One pass over the ordered candidates, as turns: a turn takes each job's first candidate, after the one taken last,
    that its state admits. A turn is a join with one small state row a job and a partial aggregation, so a job's
    candidates never meet in one task; states are written between turns, so that plans stay small.
    """
    fields = [(f.split()[0], f.split()[1]) for f in PICKED.split(", ")]
    picked = "struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">"
    x = kept(cands.select("job_id", *[F.col(n).cast(t).alias(n) for n, t in fields], position().alias("pos")), "candidates")
    place = x.schema["pos"].dataType
    tops = x.groupBy("job_id").agg(F.max("selection_quality").alias("top"), F.max("narrative").alias("best_story"))
    close = x.join(tops, "job_id").where(F.col("selection_quality") >= F.col("top") - 14).groupBy("job_id").agg(F.count_distinct("scene_id").alias("n_scenes"), F.count_distinct(F.when(F.col("moment") != "unknown", F.col("moment"))).alias("n_moments"))
    state = kept(tops.join(close, "job_id").select("*", F.expr(f"cast(array() as array<{picked}>)").alias("took"), F.lit(None).cast(place).alias("last")), "state")

    def turn(state: DataFrame, best: bool) -> DataFrame:
        y = x.join(state, "job_id").where((F.col("last").isNull() | (F.col("pos") > F.col("last"))) & (F.size("took") < (min(3, most) if best else most)))
        near = F.exists("took", lambda t: ranking.similar(F.col("clip_start"), F.col("clip_end"), F.col("sig"), t["clip_start"], t["clip_end"], t["sig"]) | (T.overlap(F.col("topics"), t["topics"]) >= (0.68 if best else 0.74)))
        if best:
            scenes, moments = F.array_distinct(F.transform("took", lambda t: t["scene_id"])), F.array_distinct(F.filter(F.transform("took", lambda t: t["moment"]), lambda m: m != "unknown"))
            y = y.where((F.col("selection_quality") >= F.col("top") - 14) & ~(F.array_contains(scenes, F.col("scene_id")) & (F.col("n_scenes") > F.size(scenes))) & ~((F.col("moment") != "unknown") & F.array_contains(moments, F.col("moment")) & (F.col("n_moments") > F.size(moments))))
        else:
            crowded = F.exists("took", lambda t: (t["scene_id"] == F.col("scene_id")) & (F.abs(F.col("clip_start") - t["clip_start"]) < 1500))
            y = y.where(~crowded & ~((F.col("narrative") < 58) & (F.col("best_story") >= 72)))
        pick = y.where(~near).groupBy("job_id").agg(F.min_by(F.struct(*[n for n, _ in fields]), "pos").alias("_p"), F.min("pos").alias("_l"))
        z = state.join(pick, "job_id", "left")
        return kept(z.select("job_id", "top", "best_story", "n_scenes", "n_moments", F.when(F.col("_p").isNull(), F.col("took")).otherwise(F.concat("took", F.array("_p").cast(f"array<{picked}>"))).alias("took"), F.coalesce("_l", "last").alias("last")), "state")

    for _ in range(min(3, most)):
        state = turn(state, best=True)
    state = state.withColumn("last", F.lit(None).cast(place))
    for _ in range(most):
        state = turn(state, best=False)
    return state.select("job_id", F.posexplode("took").alias("rank", "t")).select("job_id", (F.col("rank") + 1).alias("rank"), "t.scene_id", "t.start_ix", "t.end_ix", "t.clip_start", "t.clip_end", "t.score", "t.narrative", "t.selection_quality", "t.moment")


def fallback(segs: DataFrame, scenes: DataFrame, cands: DataFrame) -> DataFrame:
    """(job_id, scene_id, start_ix, end_ix, clip_start, clip_end, score, warnings) of the jobs without a candidate: the first 90 s of their longest scene."""
    none = scenes.join(cands.select("job_id").distinct(), "job_id", "left_anti")
    longest = none.groupBy("job_id").agg(F.max_by(F.struct("scene_id", "first_ix", "last_ix", F.col("start_cs").alias("from_cs")), F.struct((F.col("end_cs") - F.col("start_cs")).alias("d"), (-F.col("scene_id")).alias("k"))).alias("z")).select("job_id", "z.*")
    held = segs.join(longest, "job_id").where(F.col("seg_ix").between(F.col("first_ix"), F.col("last_ix")))
    over = held.where((F.col("end_cs") - F.col("from_cs") > 9000) & (F.col("seg_ix") > F.col("first_ix"))).groupBy("job_id").agg(F.min("seg_ix").alias("stop"))
    last = held.join(over, "job_id", "left").where(F.col("stop").isNull() | (F.col("seg_ix") < F.col("stop"))).groupBy("job_id", "scene_id", "first_ix", "last_ix", "from_cs").agg(F.max_by(F.struct("seg_ix", "end_cs", "text"), "seg_ix").alias("e"))
    warned = T.unfinished(F.col("e.text")) | (F.col("e.seg_ix") < F.col("last_ix"))
    return last.select(
        "job_id", "scene_id", F.col("first_ix").alias("start_ix"), F.col("e.seg_ix").alias("end_ix"), F.greatest(F.lit(0), F.col("from_cs") - 12).alias("clip_start"), F.least(F.col("e.end_cs") + 16, F.col("from_cs") + 17500).alias("clip_end"),
        F.when(warned, 40).otherwise(60).alias("score"), F.when(warned, F.array(F.lit("Ending may feel abrupt"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
