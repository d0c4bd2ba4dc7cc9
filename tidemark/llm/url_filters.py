"""URL filters: rules of hosts and paths, and for other URLs the ratio of two character language models.

The URLs that rules allow or block train one variable-order Markov model each. The probability of a character is mixed
over contexts of 0 to ORDER characters before it (Witten-Bell: a context counts by how often it was met against how many
different characters followed it, and one never met leaves all to the next shorter). A URL's score is the logarithm of
the models' ratio over its host and path and an end, divided by the number of characters. The threshold comes from
ruled URLs that are held out of training: it parts the two sorts with the best balanced accuracy.

Only DataFrame functions: a position is one string of ORDER + 1 characters, so all counts of all orders come from one
aggregation, and scores from one join with the table of these strings.

Defined cases: a null URL or one without "://" has an empty host and path and is scored as such; repeated rows are
judged alike. Without a ruled URL of either sort to train on, the method allows; without held-out ones of either sort
its threshold is 0. No pages: no rows. Other columns, of any name, aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_join, cut

#: (verdict, host and path). A rule holds for its host and all subdomains where the path begins with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Characters of the longest context.
ORDER = 4
#: First hex digits of an address's MD5 that hold it out of training.
HELD_OUT = "012"
START, END = "\x02", "\x03"
#: Scores are counted in millionths; thresholds are multiples of STEP of them, within +-WIDEST steps.
STEP, WIDEST = 10_000, 2000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def ruled(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, ruling): the longest rule that fits and its verdict, or nulls."""
    u = F.coalesce(F.col(url), F.lit(""))
    x = pages.select(F.col(page_id).alias("page_id"), F.translate(F.regexp_extract(u, _URL, 1), _UPPER, _UPPER.lower()).alias("host"), F.regexp_extract(u, _URL, 2).alias("path"))

    def fits(rule: str) -> Column:
        host, path = rule.split("/", 1)
        return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")

    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    first = lambda k: F.coalesce(*[F.when(fits(r[1]), F.lit(r[k])) for r in longest]) if longest else F.lit(None).cast("string")
    return x.withColumns({"rule": first(1), "ruling": first(0)})


def _positions(address: Column) -> Column:
    """For each character of the address and its end: the ORDER characters before it, and itself."""
    chars = F.split(F.concat(F.lit(START * ORDER), address, F.lit(END)), "")
    # the outer transform holds the characters, which else were split anew for each position
    return F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.concat(*[F.element_at(c, i + k) for k in range(ORDER + 1)])))[0]


def ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio) for grams(gram, a, r) with the counts among accepted and rejected URLs: the models' log ratio of its last character, in millionths."""
    below = None
    for k in range(ORDER + 1):
        own = grams.groupBy(F.substring("gram", -(k + 1), k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("context", F.substring("g", 1, k))
        around = own.groupBy("context").agg(*[f(c).alias(name) for c in "ar" for f, name in ((F.sum, f"n_{c}"), (lambda c: F.count(F.when(F.col(c) > 0, 1)), f"t_{c}"))], F.count("*").alias("v"))
        x = own.join(around, "context")
        if below is None:
            x = x.withColumns({f"q_{c}": F.lit(1.0) / F.col("v") for c in "ar"})
        else:
            x = x.withColumn("shorter", F.substring("g", 2, k)).join(below, "shorter")
        mixed = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}"))
        below = x.select(F.col("g").alias("shorter"), mixed("a").alias("q_a"), mixed("r").alias("q_r"))
    return below.select(F.col("shorter").alias("gram"), F.round((F.log("q_a") - F.log("q_r")) * 1e6).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> int | None:
    """The least score that is allowed, in millionths, from scored(score, ruling, held_out); None: nothing to train on.

    The driver gets at most 2 x WIDEST + 1 counts. A threshold lies in the
    middle of a gap between scores; of equally good ones, the one nearest to 0 holds.
    """
    step = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(F.col("score") / STEP))).cast("int").alias("at")
    of = lambda who, held: F.count(F.when((F.col("ruling") == who) & (F.col("held_out") == held), 1))
    counts = scored.where("ruling is not null").groupBy(step).agg(of("allow", True).alias("a"), of("block", True).alias("r"), of("allow", False).alias("train_a"), of("block", False).alias("train_r")).orderBy("at").collect()
    if not (sum(c.train_a for c in counts) and sum(c.train_r for c in counts)):
        return None
    all_a, all_r = sum(c.a for c in counts), sum(c.r for c in counts)
    if not (all_a and all_r):
        return 0
    best, above, under, before = (-math.inf, 0, 0), all_a, 0, None
    for at, a, r in [*((c.at, c.a, c.r) for c in counts), (counts[-1].at + 1, 0, 0)]:  # allowed from the middle of the gap below this step on
        edge = at if before is None else (before + 1 + at) // 2
        best = max(best, (above * all_r + under * all_a, -abs(edge), edge))
        above, under, before = above - a, under + r, at
    return best[2] * STEP


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", **bounds: int) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every page; score and threshold: mean log ratio a character."""
    x = ruled(pages, rules, page_id, url).withColumn("_row", F.monotonically_increasing_id())
    address = F.concat("host", "path")
    x = cut(x.withColumn("held_out", F.substring(F.md5(address.cast("binary")), 1, 1).isin(*HELD_OUT)), "urls")
    each = x.select("_row", "ruling", "held_out", F.explode(_positions(address)).alias("gram"))
    trains = lambda who: F.sum(F.when((F.col("ruling") == who) & ~F.col("held_out"), 1).otherwise(0))
    grams = cut(each.groupBy("gram").agg(trains("allow").alias("a"), trains("block").alias("r")), "grams")
    sums = checked_join(each.select("_row", "gram"), cut(ratios(grams), "ratios"), ["gram"], spread="_row", **bounds).groupBy("_row").agg(F.sum("ratio").alias("sum"), F.count("*").alias("n"))
    scored = cut(x.join(sums, "_row").withColumn("score", F.floor(F.col("sum") / F.col("n")).cast("long")), "scored")
    least = threshold(scored)
    own = F.lit("allow") if least is None else F.when(F.col("score") >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), (F.col("score") / 1e6).alias("score"), F.lit(0.0 if least is None else least / 1e6).alias("threshold"))


def _order_sql(k: int) -> str:
    mixed = lambda c: f"CASE WHEN n_{c} > 0 THEN ({c} + t_{c} * q_{c}) / (n_{c} + t_{c}) ELSE q_{c} END"
    lower = "1.0::DOUBLE / v AS q_a, 1.0::DOUBLE / v AS q_r FROM o0 JOIN w0 USING (context)" if k == 0 else f"b.q_a, b.q_r FROM o{k} JOIN w{k} USING (context) JOIN p{k - 1} b ON b.g = substr(o{k}.g, 2)"
    return f"""o{k} AS (SELECT right(gram, {k + 1}) AS g, left(right(gram, {k + 1}), {k}) AS context, sum(a) AS a, sum(r) AS r FROM grams GROUP BY ALL),
w{k} AS (SELECT context, sum(a) AS n_a, sum(r) AS n_r, count(*) FILTER (a > 0) AS t_a, count(*) FILTER (r > 0) AS t_r, count(*) AS v FROM o{k} GROUP BY context),
p{k} AS (SELECT g, {mixed('a')} AS q_a, {mixed('r')} AS q_r FROM (SELECT o{k}.g, o{k}.a, o{k}.r, n_a, n_r, t_a, t_r, {lower}))"""


_FITS = lambda rule: f"((host = '{rule.split('/', 1)[0]}' OR ends_with(host, '.{rule.split('/', 1)[0]}')) AND starts_with(path, '/{rule.split('/', 1)[1]}'))"
_CASES = lambda k: "CASE " + " ".join(f"WHEN {_FITS(r[1])} THEN '{r[k]}'" for r in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))) + " END"
SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS spot FROM pages),
h AS (SELECT page_id, CASE WHEN spot > 0 THEN regexp_extract(substr(url, spot + 3), '^([^/?#]*)([^?#]*)', ['h', 'p']) ELSE struct_pack(h := '', p := '') END AS s FROM u),
t AS (SELECT page_id, translate(s.h, '{_UPPER}', '{_UPPER.lower()}') AS host, s.p AS path FROM h),
x AS (SELECT row_number() OVER () AS id, *, {_CASES(1)} AS rule, {_CASES(0)} AS ruling, left(md5(host || path), 1) IN ('0', '1', '2') AS held_out FROM t),
each AS (SELECT id, ruling, held_out, substr(repeat(chr(2), {ORDER}) || host || path || chr(3), i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(generate_series(1, length(host || path) + 1)) AS i FROM x)),
grams AS (SELECT gram, count(*) FILTER (ruling = 'allow' AND NOT held_out) AS a, count(*) FILTER (ruling = 'block' AND NOT held_out) AS r FROM each GROUP BY gram),
{', '.join(map(_order_sql, range(ORDER + 1)))},
ratios AS (SELECT g AS gram, CAST(round((ln(q_a) - ln(q_r)) * 1e6) AS BIGINT) AS ratio FROM p{ORDER}),
sums AS (SELECT id, CAST(floor(sum(ratio) / count(*)) AS BIGINT) AS score FROM each JOIN ratios USING (gram) GROUP BY id),
scored AS (SELECT x.*, score, greatest(-{WIDEST}, least({WIDEST}, CAST(floor(score / {STEP}) AS BIGINT))) AS spot FROM x JOIN sums USING (id)),
c AS (SELECT spot, count(*) FILTER (ruling = 'allow' AND held_out) AS a, count(*) FILTER (ruling = 'block' AND held_out) AS r, count(*) FILTER (ruling = 'allow' AND NOT held_out) AS ta, count(*) FILTER (ruling = 'block' AND NOT held_out) AS tr FROM scored WHERE ruling IS NOT NULL GROUP BY spot),
tot AS (SELECT sum(a) AS a, sum(r) AS r, sum(ta) AS ta, sum(tr) AS tr, max(spot) + 1 AS past FROM c),
e AS (SELECT spot, CAST(floor((coalesce(lag(spot) OVER (ORDER BY spot) + 1, spot) + spot) / 2) AS BIGINT) AS edge FROM (SELECT spot FROM c UNION ALL SELECT past FROM tot)),
g AS (SELECT e.edge, sum(CASE WHEN c.spot >= e.spot THEN c.a ELSE 0 END) * any_value(tot.r) + sum(CASE WHEN c.spot < e.spot THEN c.r ELSE 0 END) * any_value(tot.a) AS gain FROM e, c, tot GROUP BY e.edge),
best AS (SELECT CASE WHEN ta > 0 AND tr > 0 AND a > 0 AND r > 0 THEN (SELECT edge FROM g ORDER BY gain DESC, abs(edge), edge DESC LIMIT 1) * {STEP} ELSE 0 END AS least, ta > 0 AND tr > 0 AS trained FROM tot)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN NOT coalesce(trained, false) OR score >= least THEN 'allow' ELSE 'block' END) AS verdict, score / 1e6 AS score, coalesce(least, 0) / 1e6 AS threshold FROM scored, best
"""
