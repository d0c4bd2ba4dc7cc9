"""Queries of the scene-local ranker: candidates of jobs of different kinds, and the diverse choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.operators import scene_ranking, scenes
from tidemark.plans import analytics
from tidemark.plans import sqltext as S
from tidemark.plans.transcript import _SCENES, _closure_sql, query, scored_sql, shots
from tidemark.sources import bridge
from tidemark.sources.shared import kept

_PREFERENCES = ("auto", "short", "longer")
_GUIDE = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in lx.DURATION_GUIDES.items()) + f" ELSE {lx.DURATION_GUIDES['other'][i]} END"
_ASKS = lambda x: f"coalesce(right(rtrim({x}), 1) = '?', false)"
_IN = lambda x, of: f"{x} IN ({', '.join(map(S.q, of))})"
_OVERLAP = "(CASE WHEN least(len({0}), len({1})) > 0 THEN len(list_intersect({0}, {1}))::DOUBLE / least(len({0}), len({1})) ELSE 0 END)".format
_WHY = ("Sentence or thought is unfinished", "Question is answered immediately after the cut", "Setup or story turn has not paid off yet", "The next line contains the immediate payoff", "Immediate reaction belongs with this moment", "Immediate reaction belongs with this moment", "The same idea continues immediately after the cut", "Dialogue appears to continue immediately")
_LIST = lambda *pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {S.q(t)} END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"
_MOMENT = "CASE " + " ".join(f"WHEN {S.any_in('z_low', c)} THEN {S.q(k)}" for k, c in lx.MOMENT_CUES.items()) + " ELSE 'unknown' END"
_COST = "least(35, CAST(coalesce(list_sum(list_transform(list_distinct(warnings), lambda w: CASE " + " ".join(f"WHEN w = {S.q(k)} THEN {v}" for k, v in lx.REPAIR.items()) + " ELSE 3 END)), 0) AS INTEGER))"

_CANDIDATES = _SCENES + ", ctx AS (WITH " + analytics._CONTEXTS + f""" SELECT job_id, kind, {S.listed(_PREFERENCES)}[job_id % 3 + 1] AS pref FROM contexts),
zb AS (SELECT *, CASE pref WHEN 'short' THEN greatest(8, CAST(round_even(g0 * 0.65::DOUBLE, 0) AS INTEGER)) WHEN 'longer' THEN greatest(g0, CAST(round_even(g0 * 1.15::DOUBLE, 0) AS INTEGER)) ELSE g0 END AS z_lo FROM (SELECT *, {_GUIDE(0)} AS g0, {_GUIDE(1)} AS g1 FROM ctx)),
zc AS (SELECT *, CASE pref WHEN 'short' THEN least(90, z_hi + 18) ELSE least(145, z_hi + CASE WHEN kind IN ('anime', 'film-tv', 'documentary', 'podcast') THEN 45 ELSE 35 END + CASE WHEN pref = 'longer' THEN 20 ELSE 0 END) END AS z_cap FROM (SELECT job_id, kind, z_lo, pref, CASE pref WHEN 'short' THEN least(60, greatest(z_lo + 8, CAST(round_even(g1 * 0.72::DOUBLE, 0) AS INTEGER))) WHEN 'longer' THEN least(120, greatest(z_lo + 18, CAST(round_even(g1 * 1.45::DOUBLE, 0) AS INTEGER))) ELSE g1 END AS z_hi FROM zb)),
zg AS (SELECT g.job_id, g.seg_ix, g.start_cs, g.end_cs, g.text, z.scene_id, first_ix, last_ix, z.start_cs AS scene_start, z.end_cs AS scene_end, kind, z_lo, z_hi, z_cap, lag(g.text) OVER w AS prev_text, coalesce(g.start_cs - lag(g.end_cs) OVER w, 1000) AS gap_before, lead(g.text) OVER w AS next_text, coalesce(lead(g.start_cs) OVER w - g.end_cs, 1000) AS gap_after, list(g.text) OVER (PARTITION BY g.job_id, z.scene_id ORDER BY g.seg_ix ROWS BETWEEN CURRENT ROW AND 37 FOLLOWING) AS texts
  FROM segments g JOIN scenes z ON z.job_id = g.job_id AND g.seg_ix BETWEEN z.first_ix AND z.last_ix JOIN zc ON zc.job_id = g.job_id WINDOW w AS (PARTITION BY g.job_id, z.scene_id ORDER BY g.seg_ix)),
zw AS (SELECT a.job_id, a.scene_id, a.seg_ix AS start_ix, e.seg_ix AS end_ix, a.start_cs, e.end_cs, a.scene_start, a.scene_end, a.text AS start_text, e.text AS end_text, e.next_text, a.prev_text, a.gap_before, e.gap_after, CASE WHEN e.seg_ix > a.seg_ix THEN a.texts[2] END AS second_text, greatest(0, a.gap_after) AS first_gap, concat_ws(' ', CASE WHEN e.seg_ix > a.seg_ix THEN a.texts[e.seg_ix - a.seg_ix] END, e.text) AS tail_text, {S.clean("array_to_string(a.texts[1:e.seg_ix - a.seg_ix + 1], ' ')")} AS text, a.kind, a.z_lo, a.z_hi
  FROM zg a JOIN zg e ON a.job_id = e.job_id AND a.scene_id = e.scene_id AND e.seg_ix BETWEEN a.seg_ix AND a.seg_ix + 37 WHERE ({S.starts_clean('a.text')} OR a.prev_text IS NULL OR a.seg_ix <= a.first_ix + 2) AND e.end_cs - a.start_cs BETWEEN 100 * greatest(5, a.z_lo - 5) AND 100 * a.z_cap),
z0 AS (SELECT *, (end_cs - start_cs) / 100.0::DOUBLE AS d, lower(text) AS z_low, {S.opening('start_text')} AS z_o, greatest(0, gap_before) AS z_g0, greatest(0, gap_after) AS z_g1, next_text IS NOT NULL AS z_follows, coalesce({S.opening('next_text')}, '') AS z_nxt, regexp_replace({S.clean('end_text')}, '["”’ ]+$', '') AS z_u, rtrim(lower(text), concat(' .!?…', chr(34), '”’')) AS z_y, {S.starts_clean('start_text')} AS z_clean, coalesce({S.opening('second_text')}, '') AS z_second FROM zw),
z1 AS (SELECT *, coalesce({S.words('left(z_o, 90)')}[1], '') AS z_first, {S.last_word('z_u', 90)} = '' OR {_IN(S.last_word('z_u', 90), lx.TRAILING_DEPENDENCIES)} OR regexp_matches(lower(z_u), '\\b(and then|the reason (is|was)|what happened (is|was))[^\\p{{L}}\\p{{N}}_]*$') AS z_unf, substr(z_y, CAST(floor(length(z_y) * 0.66::DOUBLE) AS INTEGER) + 1) AS z_third, {_closure_sql('z_low')} AS z_closed, {_closure_sql('lower(' + S.clean('right(text, 220)') + ')')} >= 0 AS z_tail, {_closure_sql('lower(' + S.clean('right(text, 180)') + ')')} >= 0 AS z_tail180, len({S.words('z_nxt')}) AS z_nn, {_OVERLAP(S.topic('tail_text'), S.topic("coalesce(next_text, '')"))} AS z_same FROM z0),
z2 AS (SELECT *, {' OR '.join(f'regexp_matches(right(z_y, 180), {S.q(p)})' for p in lx.OPEN_LOOP_PATTERNS)} OR {S.any_in('z_third', lx.LATE_PIVOTS)} AND {_closure_sql('z_third')} < 0 AS z_loop, CASE WHEN prev_text IS NULL THEN NULL WHEN {S.starts_any('z_o', lx.RESPONSE_STARTS)} AND z_g0 < 200 THEN 'Starts like a reply without the setup' WHEN {_IN('z_first', lx.POINTERS)} AND z_g0 < 150 THEN 'Opening depends on earlier context' WHEN NOT z_clean AND z_g0 < 120 THEN 'Opening is grammatically dependent' END AS z_opens,
  prev_text IS NOT NULL AND {_ASKS('prev_text')} AND z_g0 < 200 AS z_answers, CASE WHEN z_unf THEN -1 WHEN right({S.clean('end_text')}, 1) IN ('.', '!', '?', '…') THEN 2 WHEN z_g1 >= 60 OR NOT z_follows THEN 1 ELSE 0 END AS z_ending, z_nn BETWEEN 1 AND 14 AND ({S.starts_any('z_nxt', lx.REACTION_STARTS)} OR {_IN('z_nxt', ('yes', 'no', 'yeah', 'wow', 'whoa'))}) AS z_react, coalesce(z_nn BETWEEN 1 AND 14 AND ({S.starts_any('z_nxt', lx.REACTION_STARTS)} OR contains(next_text, '!') OR contains(next_text, '?') OR {S.any_in('z_nxt', lx.REACTION_WORDS)}), false) AS z_strong FROM z1),
z3 AS (SELECT *, CASE WHEN z_unf THEN 1 WHEN {_ASKS('end_text')} AND z_follows AND z_g1 < 220 THEN 2 WHEN z_loop AND z_follows AND z_g1 < 220 THEN 3 WHEN z_follows AND z_g1 < 150 AND {S.starts_any('z_nxt', lx.STRONG_CONTINUATION_STARTS)} THEN 4 WHEN z_follows AND z_g1 < 115 AND z_react THEN CASE WHEN z_strong THEN 5 ELSE 6 END WHEN z_follows AND z_g1 < 90 AND z_same >= 0.45 AND NOT z_tail180 THEN 7 WHEN z_follows AND z_g1 < 55 AND NOT {S.starts_clean('next_text')} THEN 8 ELSE 0 END AS z_b,
  least(45, CASE z_opens WHEN 'Starts like a reply without the setup' THEN 28 WHEN 'Opening depends on earlier context' THEN 18 WHEN 'Opening is grammatically dependent' THEN 15 ELSE 0 END + CASE WHEN z_answers THEN 18 ELSE 0 END) AS z_pen, (length(z_low) - z_closed)::DOUBLE / greatest(1, length(z_low)) AS z_rest, len({S.words('substr(z_low, z_closed + 1)')}) AS z_rn, {S.last_at('z_low', '?')} AS z_q FROM z2),
z4 AS (SELECT *, CASE WHEN z_b IN (1, 2, 3, 5, 7) THEN 2 WHEN z_b IN (4, 6) THEN CASE WHEN z_tail THEN 1 ELSE 2 END WHEN z_b = 8 THEN 1 ELSE 0 END AS z_c0, CASE z_b WHEN 1 THEN 38 WHEN 2 THEN 34 WHEN 3 THEN 30 WHEN 4 THEN CASE WHEN z_tail THEN 12 ELSE 26 END WHEN 5 THEN 26 WHEN 6 THEN CASE WHEN z_tail THEN 11 ELSE 26 END WHEN 7 THEN 20 WHEN 8 THEN 9 ELSE 0 END AS z_loss, {S.listed(_WHY)}[z_b] AS z_why, z_closed >= 0 AND (z_rest <= 0.22 OR z_rn <= 4) AS z_near FROM z3),
z5 AS (SELECT *, z_closed >= 0 AND NOT z_near AND (z_rest > 0.30 OR z_rn >= 7) AND NOT z_loop AS z_over, z_closed < 0 AND z_c0 = 0 AND (z_ending >= 2 OR z_g1 >= 80) AS z_stops, z_q >= CAST(floor(length(z_low) * 0.45::DOUBLE) AS INTEGER) AND len({S.words('substr(z_low, z_q + 2)')}) < 7 AND z_follows AND z_g1 < 200 AS z_late, second_text IS NOT NULL AND first_gap < 150 AND ({S.starts_any('z_second', lx.RESPONSE_STARTS)} OR {_ASKS('start_text')}) AS z_setup FROM z4),
z6 AS (SELECT *, CASE WHEN z_late THEN 2 ELSE z_c0 END AS z_cont FROM z5),
z7 AS (SELECT *, greatest(1, least(99, 88 - z_pen - z_loss + CASE WHEN z_near THEN 8 WHEN z_over THEN -13 WHEN z_stops THEN 4 ELSE 0 END - CASE WHEN z_late THEN 24 ELSE 0 END + CASE WHEN z_cont = 0 AND z_closed >= 0 AND z_g1 >= 35 THEN 4 ELSE 0 END + CASE WHEN z_setup THEN 6 ELSE 0 END)) AS z_nar, {_LIST(('z_pen = 0', 'Enough setup to understand the moment'), ('z_near', 'Ends close to the payoff'), ('z_stops', 'Natural stopping point'), ('z_setup', 'Includes the setup needed for the response'))} AS z_str,
  list_filter([z_opens, CASE WHEN z_answers THEN 'Answer needs the preceding question' END, z_why, CASE WHEN z_over THEN 'Extra dialogue continues after the main payoff' END, CASE WHEN z_late THEN 'Late question needs its answer' END], lambda x: x IS NOT NULL) AS z_warn, {S.any_in('z_low', lx.PAYOFF_PHRASES)} OR z_closed >= 0 AS z_paid, {S.any_in('z_low', lx.PIVOT_PHRASES)} AS z_turn, len({S.words('text')}) AS z_n FROM z6),
z8 AS (SELECT * FROM z7 WHERE z_ending >= 1 AND z_cont < 2 AND (z_n >= 9 OR d <= 15) AND (d >= z_lo OR CASE WHEN kind = 'meme-comedy' THEN z_nar >= 80 ELSE z_nar >= 92 AND z_paid AND z_ending >= 2 AND z_n >= 12 END AND z_cont = 0)),
{scored_sql('z8')},
y0 AS (SELECT *, z_clean OR prev_text IS NULL AS whole FROM scored),
y1 AS (SELECT *, least(99, CAST(round_even(0.72::DOUBLE * z_nar + 0.28::DOUBLE * (40 + CASE WHEN whole THEN 18 ELSE 0 END + 10 * z_ending + CASE WHEN z_paid THEN 12 ELSE 0 END + CASE WHEN z_turn THEN 8 ELSE 0 END), 0) AS INTEGER)) AS story, greatest(1, least(99, CAST(round_even(48 + z_nar * 0.42::DOUBLE + CASE WHEN prev_text IS NULL OR gap_before >= 65 OR z_clean THEN 8 ELSE 0 END + CASE WHEN NOT z_follows OR z_g1 >= 75 OR z_ending >= 2 THEN 10 ELSE 0 END - CASE WHEN z_cont = 1 THEN 12 WHEN z_cont >= 2 THEN 30 ELSE 0 END - z_pen * 0.35::DOUBLE, 0) AS INTEGER))) AS conf,
  (SELECT CASE WHEN count(*) >= 4 THEN sum(pct)::DOUBLE / count(*) / 100 END FROM words w WHERE w.job_id = y0.job_id AND w.seg_ix BETWEEN y0.start_ix AND y0.end_ix) AS sure, (SELECT count(*) FROM shots h WHERE h.job_id = y0.job_id AND h.cut_cs BETWEEN y0.start_cs AND y0.end_cs) AS cuts FROM y0),
y2 AS (SELECT *, cuts >= 5 AND cuts / greatest(d, 1.0::DOUBLE) > 0.38 AS busy, coalesce(sure < 0.55, false) AS unsure FROM y1),
y3 AS (SELECT *, list_concat(z_warn, {_LIST(('z_ending = 1', 'Ending boundary is uncertain'), ('NOT whole', 'Opening may need more context'), ('NOT z_paid AND NOT z_turn AND z_nar < 78', 'Story completeness may be limited'), ('unsure', 'Low transcript confidence'), ('busy', 'Frequent shot changes: review framing'))}) AS warnings,
  0.38::DOUBLE * (score - CASE WHEN d BETWEEN 24 AND 48 THEN 15.0::DOUBLE WHEN d BETWEEN 18 AND 60 THEN 8.0::DOUBLE ELSE -least(18.0::DOUBLE, abs(d - 36) * 0.65::DOUBLE) END * 0.62::DOUBLE) + 0.62::DOUBLE * (hook * 0.17::DOUBLE + standalone * 0.15::DOUBLE + payoff * 0.18::DOUBLE + clarity * 0.10::DOUBLE + story * 0.16::DOUBLE + z_nar * 0.24::DOUBLE)
  - CASE WHEN d < z_lo THEN least(10.0::DOUBLE, (z_lo - d) * 0.8::DOUBLE) WHEN d > z_hi THEN least(9.0::DOUBLE, (d - z_hi) * 0.45::DOUBLE) ELSE 0 END - CASE WHEN NOT whole THEN 10 ELSE 0 END - CASE WHEN z_ending = 1 THEN 8 ELSE 0 END - CASE WHEN z_cont = 1 THEN 10 ELSE 0 END - CASE WHEN z_nar >= 86 AND z_cont = 0 AND d > z_lo THEN least(5.0::DOUBLE, greatest(0.0::DOUBLE, d - greatest(z_lo, 18)) * 0.05::DOUBLE) ELSE 0 END
  + (conf - 70) * 0.06::DOUBLE - CASE WHEN z_over THEN 14 ELSE 0 END - CASE WHEN unsure THEN 9 ELSE 0 END - CASE WHEN busy THEN 4 ELSE 0 END AS z_raw, {S.clean('text')} AS z_ct, {_MOMENT} AS moment, {S.topic('text')} AS topics FROM y2),
y4 AS (SELECT *, {_COST} AS repair, regexp_extract(z_ct, '^(.*?[.!?])\\s', 1) AS z_fs FROM y3),
y5 AS (SELECT *, CAST(greatest(1, least(98, round_even(z_raw - repair * 0.18::DOUBLE, 0))) AS INTEGER) AS score2, CASE WHEN z_fs = '' THEN z_ct ELSE z_fs END AS z_f2 FROM y4),
cand AS MATERIALIZED (SELECT job_id, scene_id, start_ix, end_ix, greatest(scene_start, start_cs - 12) AS clip_start, least(scene_end + 16, end_cs + 16) AS clip_end, score2 AS score, z_nar AS narrative, z_cont AS continuation, conf AS boundary_confidence, warnings, repair AS repair_cost, story, hook, standalone, payoff, retention, clarity, greatest(35, 78 - greatest(0, CAST(round_even(cuts / greatest(d, 1.0::DOUBLE) * 90, 0) AS INTEGER) - 20)) AS visual, kind,
  greatest(1, least(99, CAST(round_even(score2 * 0.62::DOUBLE + z_nar * 0.24::DOUBLE + conf * 0.14::DOUBLE - repair * 0.38::DOUBLE, 0) AS INTEGER))) AS selection_quality, moment, topics, list_distinct(list_filter(({S.words("CASE WHEN length(z_f2) > 180 THEN rtrim(left(z_f2, 179)) || '…' ELSE z_f2 END")})[1:18], lambda t: length(t) > 3)) AS sig,
  list_filter(list_concat({_LIST((S.any_in('left(lower(start_text), 110)', lx.HOOK_PHRASES), 'Strong opening hook'), ('z_paid', 'Complete payoff or takeaway'))}, z_str, {_LIST(('z_nar >= 88', 'Narratively complete moment'))}, reasons), lambda x: x IS NOT NULL) AS all_reasons FROM y5)"""
_FIRST = "list_filter(all_reasons, lambda x, i: list_position(all_reasons, x) = i)[1:4]"


def _candidates(spark, d):
    segs = kept(bridge.segments(spark, d), "segments")
    cuts = shots(segs)
    kinds = analytics.contexts(segs).select("job_id", "kind", F.element_at(F.array(*map(F.lit, _PREFERENCES)), (F.col("job_id") % 3 + 1).cast("int")).alias("preference"))
    return scene_ranking.candidates(segs, scenes.scenes(segs.withColumn("compilation", F.col("job_id") % 2 == 0), cuts), bridge.words(segs), cuts, kinds)


@query(_CANDIDATES + f" SELECT job_id, scene_id, start_ix, end_ix, clip_start, clip_end, score, narrative, continuation, boundary_confidence, array_to_string(warnings, '; ') AS warnings, repair_cost, story, hook, standalone, payoff, retention, clarity, visual, kind, selection_quality, moment, array_to_string({_FIRST}, '; ') AS reasons FROM cand")
def scr3_scene_candidates(spark, d):
    """Scene-local clips of jobs of different kinds and wished lengths, with all their measures (SCR-3 to SCR-8, FLT-14, MTH-5, SRT-4)."""
    x = _candidates(spark, d).drop("sig", "topics")
    return x.withColumns({c: F.array_join(c, "; ") for c in ("warnings", "reasons")})


def _chosen_sql(most: int = 4) -> str:
    similar = "(greatest(0, least(c.clip_end, t.clip_end) - greatest(c.clip_start, t.clip_start))::DOUBLE / greatest(100, least(c.clip_end - c.clip_start, t.clip_end - t.clip_start)) > 0.48 OR " + _OVERLAP("c.sig", "t.sig") + " > 0.72)"
    out = _CANDIDATES + """, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY selection_quality DESC, score DESC, narrative DESC, boundary_confidence DESC, len(warnings), clip_end - clip_start, start_ix, end_ix) AS pos, max(selection_quality) OVER (PARTITION BY job_id) AS top, max(narrative) OVER (PARTITION BY job_id) AS best_story FROM cand),
n AS (SELECT job_id, count(DISTINCT scene_id) AS n_scenes, count(DISTINCT CASE WHEN moment <> 'unknown' THEN moment END) AS n_moments FROM o WHERE selection_quality >= top - 14 GROUP BY job_id), k0 AS MATERIALIZED (SELECT *, 0 AS turn FROM o WHERE false)"""
    taken = "(SELECT 1 FROM k{} t WHERE t.job_id = c.job_id AND {})".format
    for k in range(1, 2 * most):
        p, best = k - 1, k <= min(3, most)
        phase = "turn >= 1" if best else f"turn > {min(3, most)}"
        rules = f"c.pos > coalesce((SELECT max(pos) FROM k{p} t WHERE t.job_id = c.job_id AND {phase}), 0) AND (SELECT count(*) FROM k{p} t WHERE t.job_id = c.job_id) < {min(3, most) if best else most} AND NOT EXISTS {taken(p, f'{similar} OR ' + _OVERLAP('c.topics', 't.topics') + f' >= {0.68 if best else 0.74}')}"
        if best:
            rules += f" AND c.selection_quality >= c.top - 14 AND NOT (EXISTS {taken(p, 't.scene_id = c.scene_id')} AND n_scenes > (SELECT count(DISTINCT scene_id) FROM k{p} t WHERE t.job_id = c.job_id)) AND NOT (c.moment <> 'unknown' AND EXISTS {taken(p, 't.moment = c.moment')} AND n_moments > (SELECT count(DISTINCT moment) FROM k{p} t WHERE t.job_id = c.job_id AND moment <> 'unknown'))"
        else:
            rules += f" AND NOT (c.narrative < 58 AND c.best_story >= 72) AND NOT EXISTS {taken(p, 't.scene_id = c.scene_id AND abs(c.clip_start - t.clip_start) < 1500')}"
        out += f", p{k} AS (SELECT c.job_id, min(c.pos) AS pos FROM o c JOIN n ON n.job_id = c.job_id WHERE {rules} GROUP BY c.job_id), k{k} AS MATERIALIZED (SELECT * FROM k{p} UNION ALL SELECT o.*, {k} FROM o JOIN p{k} ON o.job_id = p{k}.job_id AND o.pos = p{k}.pos)"
    return out + f" SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY turn) AS INTEGER) AS rank, scene_id, start_ix, end_ix, clip_start, clip_end, score, narrative, selection_quality, moment FROM k{2 * most - 1}"


@query(_chosen_sql())
def sel2_best_clips(spark, d):
    """The four clips of each job: from different scenes and of different kinds while quality is close, then the best of the rest (SEL-2, SEL-3, SRT-2, SET-8)."""
    return scene_ranking.chosen(_candidates(spark, d), 4)
