"""Pieces of the DuckDB statements that check the queries."""

from __future__ import annotations

from tidemark.functions import lexicon as lx
from tidemark.sources.bridge import SQL as BRIDGE

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''’%-]*[\p{L}\p{N}_])?"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(phrases) -> str:
    return "[" + ", ".join(map(q, phrases)) + "]"


def any_in(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def starts_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in phrases) + ")"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}', 0)"


def opening(x: str) -> str:
    return f"regexp_replace(lower({clean(x)}), '^[\"“‘]+', '')"


def starts_clean(x: str) -> str:
    o = opening(x)
    return f"({o} <> '' AND (coalesce({words(f'left({o}, 80)')}[1], '') NOT IN ({', '.join(map(q, lx.DEPENDENT_STARTS))}) OR {any_in(f'left({o}, 90)', lx.HOOK_PHRASES)}))"


def last_word(x: str, n: int) -> str:
    return f"coalesce({words(f'right({x}, {n})')}[-1], '')"


def ends_clean(x: str) -> str:
    c = clean(x)
    return f"({c} <> '' AND {last_word(c, 80)} NOT IN ({', '.join(map(q, lx.TRAILING_DEPENDENCIES))}) AND right({c}, 1) IN ('.', '!', '?', '…'))"


def topic(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+', 0), lambda w: length(w) >= 4 AND NOT list_contains({listed(lx.TOPIC_STOP)}, w))))"


def last_at(x: str, p: str) -> str:
    return f"(CASE WHEN contains({x}, {q(p)}) THEN length({x}) - instr(reverse({x}), {q(p[::-1])}) - {len(p)} + 1 ELSE -1 END)"


def pattern_end(x: str, p: str) -> str:
    """Where the last match of p ends in x; -1: no match."""
    pieces = f"regexp_split_to_array({x}, {q(p)})"
    return f"(CASE WHEN len({pieces}) > 1 THEN length({x}) - length({pieces}[-1]) ELSE -1 END)"


def times_in(x: str, p: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(p)}, ''))) // {len(p)})"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0 END)"


GAPS = BRIDGE + """, gaps AS (SELECT *, coalesce(greatest(0, start_cs - lag(end_cs) OVER w), 1000) AS gap_before, coalesce(greatest(0, lead(start_cs) OVER w - end_cs), 1000) AS gap_after FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seg_ix))"""
#: Clips of 30 s, one in each 45 s of a job, as given intervals.
CLIPS = BRIDGE + ", clips AS (SELECT job_id, CAST(c AS INTEGER) AS clip_ix, c * 4500 AS lo, c * 4500 + 3000 AS hi FROM (SELECT job_id, unnest(generate_series(0, CAST(max(end_cs) // 4500 AS BIGINT))) AS c FROM segments GROUP BY job_id))"
SHOTS = ", shots AS (SELECT job_id, unnest(generate_series(730, CAST(max(end_cs) AS BIGINT), 730)) AS cut_cs FROM segments GROUP BY job_id HAVING max(end_cs) >= 730)"
