"""Main text of web pages by nearest-URL page differencing.

Every page becomes text lines (one per block). Pages are paired with the pages
before and after them by URL path within their host, their lines are aligned
by longest common subsequence, and lines that a page shares with a neighbour
are template lines and deleted. Markup that plainly names its role (menus,
headers, footers, sidebars, notices, adverts, forms, comments) is deleted
whatever the neighbours hold: an element of such a role, or a class, id or role
of which every part is a role's word or says only place, kind or number
(`site-header`, `ad-slot-3`). A name that holds such a word among others
(`share-price`, `notice-board`) proves nothing: inside an article, and on pages
without one, the neighbours decide. They also decide on unnamed boxes and lists
inside an article, in `main`, on lines beside an article, and on headings in an
article's own header. In the other paragraphs, headings, quotations and tables
of an explicit article element a shared line is the article's own wording (a
licence line, a mirrored article) and stays. Of several articles on a page, the
one with the most text that the neighbours don't share is the page's; an article
inside another is a reader's post where the outer one has wording of its own.
Copies at adjacent URLs count as one place, so that a page meets the nearest
pages of other content. A neighbour that holds the whole page all the same
counts as its copy, and says nothing about templates.

Cases: null or empty html gives empty text; a null url pairs among pages
without host; repeated rows get equal results; a page without neighbours keeps
its unmarked lines; very long pages are handled whole.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

# Element names of HTML by role.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav header footer aside form script style noscript template head title button select textarea iframe svg menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
PROSE = frozenset("article p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figcaption caption table tbody tr td th dl dt dd".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE = frozenset("table caption colgroup col thead tbody tfoot tr td th".split())
ROLES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar cookie cookies consent notice popup modal newsletter subscribe comment comments respond disqus related share social widget pagination login search contentinfo complementary".split())
COMMENTS = frozenset("comment comments respond disqus".split())
#: Parts of a name that say only place, kind or number beside a role.
PLACES = frozenset("site page main top bottom left right inner outer upper lower primary secondary global mobile desktop first last sticky fixed user users reader readers body content section area block box bar list item items link links wrap wrapper container inline row col column panel slot unit strip group holder form button buttons signup article articles post posts story stories entry js is has".split())
OWN_HEADER = frozenset("article entry post story".split())  # of `article-header`: the text's own

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ROLE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=4096)
def role_of(names: str, comments_only: bool = False) -> str:
    """What the class, id and role values of an element say: "drop" (a role), "weak" (a role's word among others) or ""."""
    found = ""
    for token in names.split():
        parts = [x.lower() for x in _PART.findall(token)]
        roles = (COMMENTS if comments_only else ROLES).intersection(parts)
        if not roles or roles == {"header"} and OWN_HEADER.intersection(parts):
            continue
        if all(x in ROLES or x in PLACES for x in parts):
            return "drop"
        found = "weak"
    return found


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """The page's text lines in order, and the kind of each: 0 marked as no content, 1 plain (the neighbours decide), 2 wording of an article.

    Where several articles of a page have wording, four times the article's number (from 1) is added to its lines' kinds.
    """
    texts: list[str] = []
    kinds: list[int] = []
    within: list[int] = []  # the innermost open article of each line, 0: none
    outer: dict[int, int] = {}  # the article around each article
    open_: list[tuple[str, str, int]] = []
    run: list[str] = []
    page = page or ""
    at = 0

    def flush() -> None:
        if run:
            line = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if line:
                marks = {x[1] for x in open_}
                block = next((x[0] for x in reversed(open_) if x[0] in BLOCKS), "")
                article = next((x[2] for x in reversed(open_) if x[2]), 0)
                texts.append(line)
                within.append(article)
                if "drop" in marks or "head" in marks and block not in HEADINGS:
                    kinds.append(0)
                elif "head" in marks or "weak" in marks:
                    kinds.append(1 if article else -1)
                else:
                    kinds.append(2 if article and block in PROSE else 1)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name in DROPPED or name in BLOCKS:
                        flush()
                    del open_[k:]
                    break
                if open_[k][0] in ("article", "main", "body", "html") and name in ("p", "b", "i", "span", "a", "li"):
                    break
            continue
        if name in BLOCKS:
            flush()
        if name in CLOSE_P:  # an open paragraph ends here, with whatever is open in it
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "p":
                    del open_[k:]
                    break
                if open_[k][0] in BLOCKS:
                    break
        if name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == name:
            open_.pop()
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        named = " ".join("".join(x) for x in _ROLE.findall(m[3])) if m[3] else ""
        inside = any(x[2] for x in open_)
        mark = ""
        if name in DROPPED:
            mark = "head" if name == "header" and inside and role_of(named) != "drop" else "drop"
        elif named and name not in ("html", "body", "main") and not (inside and name in TABLE):
            mark = role_of(named, name == "article")
            if mark == "weak" and (name == "article" or name not in BLOCKS):
                mark = ""  # a phrase inside a line isn't parted from it by a weak name
        if mark:
            flush()
        number = 0
        if name == "article":
            number = len(outer) + 1
            outer[number] = next((x[2] for x in reversed(open_) if x[2]), 0)
        open_.append((name, mark, number))
    flush()
    return texts, _settled(kinds, within, outer)


def _settled(kinds: list[int], within: list[int], outer: dict[int, int]) -> list[int]:
    """The kinds with what the whole page says: posts inside an article with wording and weakly named lines beside one go."""
    worded = {a for kind, a in zip(kinds, within, strict=True) if kind == 2}

    def posted(a: int) -> bool:
        while a:
            a = outer[a]
            if a in worded:
                return True
        return False

    gone = {a for a in outer if posted(a)}
    left = sorted(worded - gone)
    number = {a: 4 * k for k, a in enumerate(left, 1)} if len(left) > 1 else {}
    return [0 if not kind or a in gone or kind < 0 and worded else abs(kind) + number.get(a, 0) for kind, a in zip(kinds, within, strict=True)]


def kept(texts: list[str], kinds: list[int], template: set[int]) -> list[str]:
    """The lines that stay: wording, and plain lines that aren't template; of several articles, the one with the most unshared text."""
    own: dict[int, int] = {}
    for k, kind in enumerate(kinds):
        if kind > 4:
            own[kind // 4] = own.get(kind // 4, 0) + (0 if k in template else len(texts[k]))
    best = min(own, key=lambda a: (-own[a], a)) if own else 0
    return [t for k, (t, kind) in enumerate(zip(texts, kinds, strict=True)) if kind // 4 in (0, best) and (kind % 4 == 2 or kind % 4 == 1 and k not in template)]


def shared(mine: list[int], other: list[int]) -> set[int]:
    """Places in mine of a longest common subsequence with other (the equal ends first, then the classic table)."""
    found: set[int] = set()
    lo = 0
    while lo < min(len(mine), len(other)) and mine[lo] == other[lo]:
        found.add(lo)
        lo += 1
    hi = 0
    while hi < min(len(mine), len(other)) - lo and mine[-1 - hi] == other[-1 - hi]:
        found.add(len(mine) - 1 - hi)
        hi += 1
    common = set(mine[lo : len(mine) - hi]) & set(other[lo : len(other) - hi])
    a = [(k, x) for k, x in enumerate(mine[lo : len(mine) - hi], lo) if x in common]
    b = [x for x in other[lo : len(other) - hi] if x in common]
    # Hunt and Szymanski: the longest increasing chain of matches
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for k, x in a:
        for j in reversed(where[x]):
            at = bisect_left(ends, j)
            link = (k, last[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[at] = j
                last[at] = link
    link = last[-1] if last else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _hashes(texts: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x in texts]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = [lines_of(h) for h in x["html"]]
        yield pd.DataFrame({"rk": x["rk"], "page_id": x["page_id"], "url": x["url"], "texts": [t for t, _ in rows], "kinds": [k for _, k in rows]})


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        hashes, content = [], []
        for h in x["html"]:
            texts, kinds = lines_of(h)
            hashes.append(_hashes(texts))
            content.append(_hashes(["\n".join(t for t, kind in zip(texts, kinds, strict=True) if kind)])[0])
        yield pd.DataFrame({"rk": x["rk"], "host": x["host"], "path": x["path"], "hashes": hashes, "content": content})


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for texts, kinds, before, after in zip(x["texts"], x["kinds"], x["before"], x["after"], strict=True):
            mine = _hashes(texts)
            content = [k for k, kind in enumerate(kinds) if kind]
            template: set[int] = set()
            for other in (before, after):
                if other is not None:
                    same = shared(mine, list(other))
                    if not content or not same.issuperset(content):
                        template |= same
            out.append(("\n".join(kept(texts, list(kinds), template)), len(template)))
        yield pd.DataFrame({"page_id": x["page_id"], "url": x["url"], "text": [t for t, _ in out], "n_chars": [len(t) for t, _ in out], "n_shared": [n for _, n in out]})


def neighbours(pages: DataFrame) -> DataFrame:
    """(rk, before, after): line hashes of the pages next to each distinct page, by path within its host.

    The pages are sorted by range over all hosts, so that a large host spreads
    over tasks; what stands at a partition's edges meets through a table of one
    row per partition.
    """
    lines = cut(pages.mapInPandas(_lines, "rk long, host string, path string, hashes array<long>, content long").dropDuplicates(["rk"]), "lines")
    n = max(1, lines.rdd.getNumPartitions(), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = lines.withColumn("content", F.xxhash64("host", "content")).repartitionByRange(n, "host", "path", "rk").sortWithinPartitions("host", "path", "rk")
    order = cut(order.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place")), "order")
    edge = F.struct("host", "hashes", "content")
    run = Window.partitionBy("pid").orderBy("place")
    # At the ends of a run of equal content stand its neighbours; they are carried through the run.
    turn = lambda step: F.when(step("content").over(run) != F.col("content"), step(edge).over(run))
    x = order.select("*", turn(F.lag).alias("_l"), turn(F.lead).alias("_r"))
    x = x.select("rk", "host", "pid", "place", "hashes", "content", F.last("_l", True).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("l"), F.first("_r", True).over(run.rowsBetween(0, Window.unboundedFollowing)).alias("r"))  # not written: run twice, for less disk
    edges = cut(x.groupBy("pid").agg(F.min_by(edge, "place").alias("first"), F.max_by(edge, "place").alias("last"), F.max_by("l", "place").alias("inner_last"), F.min_by("r", "place").alias("inner_first")), "edges")
    # Where a run reaches its partition's edge: the nearest other content beyond it, looked up by a few numbers a partition.
    ends = edges.select("pid", *[F.col(c)["content"].alias(c) for c in ("first", "last", "inner_last", "inner_first")]).orderBy("pid").collect()
    beyond = []
    for own, near, inner, at in (("first", "last", "inner_last", ends), ("last", "first", "inner_first", ends[::-1])):
        seen: list[tuple[int, str, int]] = []  # the two nearest contents that differ
        for e in at:
            found = next((s for s in seen if s[2] != e[own]), None)
            if found:
                beyond.append((e["pid"], own, found[0], found[1]))
            both = [(e["pid"], c, e[c]) for c in (near, inner) if e[c] is not None]
            seen = both if len(both) == 2 else [*both, *(s for s in seen if s[2] != both[0][2])][:2]
    places = lines.sparkSession.createDataFrame(beyond, "pid int, own string, source int, which string")
    values = edges.select(F.col("pid").alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("value")) for c in ("first", "last", "inner_last", "inner_first")])).alias("v")).select("source", "v.*")
    outer = places.join(values, ["source", "which"]).groupBy("pid").agg(F.first(F.when(F.col("own") == "first", F.col("value")), True).alias("prior"), F.first(F.when(F.col("own") == "last", F.col("value")), True).alias("next"))
    x = x.join(F.broadcast(cut(outer, "outer")), "pid", "left").select("rk", "host", F.coalesce("l", "prior").alias("l"), F.coalesce("r", "next").alias("r"))
    other = lambda c: F.when(F.col(c)["host"].eqNullSafe(F.col("host")), F.col(c)["hashes"])
    return x.select("rk", other("l").alias("before"), other("r").alias("after"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) for each row of pages(page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("rk"))
    address = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    keyed = pages.select("*", F.regexp_extract(address, r"//([^/?#]*)", 1).alias("host"), F.regexp_replace(F.regexp_extract(address, r"//[^/?#]*([^?#]*)", 1), r"(\.html?|/)$", "").alias("path"))
    near = cut(neighbours(keyed), "near")
    parsed = pages.mapInPandas(_parse, "rk long, page_id long, url string, texts array<string>, kinds array<int>")
    both = parsed.join(near, "rk", "left")
    return both.mapInPandas(_decide, "page_id long, url string, text string, n_chars long, n_shared int")
