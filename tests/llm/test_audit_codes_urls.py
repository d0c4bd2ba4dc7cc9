"""Operators 11 to 13 against plain Python, with the awkward cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import filter_audit, url_filters, vector_codes

CLASHING = "filter_order string, mask int, n long, key long, terminal boolean, host string, rule string, code string, q string"


def clashing(df):
    """df with columns named like the operators' own."""
    return df.selectExpr("*", *[f"cast('1' as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ") if c.split()[0] not in df.columns])


# filter audit


def audited(rows, marks):
    """The contract of the audit, read row by row."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, x in marks if x == 1 and i is not None}
    by = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        by[part or ""].append((fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, docs in by.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left_now = [d for d in left if not d[0][f]]
                redundant = sum(d[0][f] for d in docs) - len(gone)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                out[part, "".join(order), k + 1] = [len(left_now), len(gone), redundant, alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] += len(gone)
                left = left_now
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def awkward_rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 49, 50, 51, 90]))) for _ in range(25)]
    texts += [t.upper() for t in texts[:3]] + [t + " $5 | x" for t in texts[3:8]] + [" ".join(["same"] * 60), "", "A", "日本 é\u2003x " * 30, "x" * 70_000]
    long = texts[0] * 30
    texts += [long, long + "a", long + "b", long[:-1]]  # near copies with long common beginnings
    rows = [(k, t, f"src{k % 4}") for k, t in enumerate(texts)]
    rows += [(500 + k, texts[0], "src0") for k in range(70)] + [(600 + k, texts[rng.randrange(len(texts))], rng.choice(["src1", None, ""])) for k in range(60)]
    rows += [(-3, texts[5], "src9"), (None, texts[6], "src1"), (None, "only without an id", "src1"), (700, None, None), (7, texts[7], "src2"), (7, texts[7], "src2"), (7, texts[8], "src2")]
    rng.shuffle(rows)
    return rows


MARKS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 560)] + [(3, None, 1), (4, 1, None), (4, 0, 0), (None, 1, 1)]


@pytest.mark.parametrize("sizes", [{}, {"trie_bytes": 3000, "range_bytes": 4000, "group_bytes": 300}])
def test_audit_equals_a_plain_reading(spark, sizes):
    rows = awkward_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    marks = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, **sizes).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got) == 600 * 6
    assert found == audited(rows, MARKS)


def test_audit_of_nothing(spark, empty, no_labels):
    assert filter_audit.audit(empty, no_labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), no_labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.shapley for r in one if r.filter_order[r.step - 1] == "A"} == {120}


def test_trie_tells_texts_apart():
    rng = random.Random(3)
    base = bytes(rng.randrange(97, 100) for _ in range(3000))
    texts = [b"", b"a", b"ab", base, base + b"a", base[:2000]] + [base[:k] + b"z" + base[k:] for k in range(0, 3000, 37)] + [bytes(rng.randrange(97, 99) for _ in range(rng.randrange(12))) for _ in range(300)]
    trie, seen = filter_audit.Trie(), {}
    for t in [*texts, *texts]:
        assert trie.insert(t) == seen.setdefault(t, len(seen))
    assert sorted(trie.texts()) == sorted((k, t) for t, k in seen.items())


def test_heavy_beginnings_are_parted(spark):
    rng = random.Random(4)
    common = "".join(rng.choice("abc") for _ in range(900))
    texts = [common + "".join(rng.choice("abc") for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame([(k, k, t.encode(), len(t), t[:16].encode()) for k, t in enumerate(texts)], "key long, doc_id long, text binary, n_bytes long, beginning binary")
    out = filter_audit.ranged(df, range_bytes=20_000, group_bytes=5_000)
    sizes = Counter(r.beginning for r in out.select("beginning").collect())
    assert sum(sizes.values()) == 200 and max(sizes.values()) < 6 and max(map(len, sizes)) > 900
    assert out.rdd.getNumPartitions() >= 9 and min(out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 100


def test_turns_join_only_what_is_still_heavy(spark, monkeypatch):
    """No turn joins anew what earlier ones have joined, and every text gets the beginning of a plain reading."""
    rng = random.Random(9)
    common = "".join(rng.choice("abc") for _ in range(5000))
    texts = [common[:n] + "".join(rng.choice("abc") for _ in range(40)) for n in (0, 10, 20, 70, 300, 1100, 5000) for _ in range(30)] + [common[:k] for k in (0, 16, 64, 5000)] + [common] * 3
    joins, cut = [], filter_audit.cut

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df, name)

    monkeypatch.setattr(filter_audit, "cut", counted)
    df = spark.createDataFrame([(k, k, t.encode(), len(t), t[:16].encode()) for k, t in enumerate(texts)], "key long, doc_id long, text binary, n_bytes long, beginning binary")
    got = {r.key: bytes(r.beginning).decode() for r in filter_audit.ranged(df, range_bytes=40_000, group_bytes=5_000).select("key", "beginning").collect()}
    total = sum(map(len, texts))
    most = min(5_000, total // (4 * max(4, -(-total // 40_000))))
    want, length, open_ = {}, 16, dict(enumerate(texts))
    while open_:
        sums, longest = Counter(), Counter()
        for t in open_.values():
            sums[t[:length]] += len(t)
            longest[t[:length]] = max(longest[t[:length]], len(t))
        heavy = {b for b in sums if sums[b] > most and longest[b] > length}
        want |= {k: t[:length] for k, t in open_.items() if t[:length] not in heavy}
        open_, length = {k: t for k, t in open_.items() if t[:length] in heavy}, 4 * length
    assert got == want and len(set(map(len, want.values()))) > 5
    assert len(joins) > 5 and max(joins) == 1


# URL filters

URLS = ["http://a.example.net/en/1?x=1#t", "https://NET/en", "http://x.net", "http://example.net/en/", "http://evilexample.net/en/q", "https://b.example.com/de/5.html", "http://example.com/den", "http://org/fr/", "https://WWW.Wiki.Org/fr/Ä", "no scheme/net/", "://net/en/", "http://q?u=://net/", "http://a.net:80/x", "ftp://u@b.example.net/en/z", "", None, "http://b.com/en/" + "long" * 9000, "http://é.org/fr/\n/x", "http://com/a\nb#c"]


def plain_judgement(url):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in url_filters.RULES if (host == r[1].split("/", 1)[0] or host.endswith("." + r[1].split("/", 1)[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    verdict, rule = max(fit, key=lambda r: len(r[1]), default=(None, None))
    return host, path, rule, verdict


def plain_scores(urls):
    """{address: score in millionths} and the threshold, by dictionaries."""
    K = url_filters.ORDER
    rows = [plain_judgement(u) for u in urls]
    held = lambda a: hashlib.md5(a.encode()).hexdigest()[0] in url_filters.HELD_OUT
    counts = {w: [defaultdict(Counter) for _ in range(K + 1)] for w in ("allow", "block")}
    places, chars = {}, set()
    for host, path, _, verdict in rows:
        a = host + path
        s = "\x02" * K + a + "\x03"
        places[a] = [s[i : i + K + 1] for i in range(len(a) + 1)]
        chars |= set(s[K:])
        if verdict and not held(a):
            for g in places[a]:
                for k in range(K + 1):
                    counts[verdict][k][g[K - k : K]][g[K]] += 1

    def p(w, g):
        q = 1.0 / len(chars)
        for k in range(K + 1):
            c = counts[w][k].get(g[K - k : K])
            if c:
                q = (c[g[K]] + len(c) * q) / (sum(c.values()) + len(c))
        return q

    ratio = {g: round((math.log(p("allow", g)) - math.log(p("block", g))) * 1e6) for a in places for g in places[a]}
    score = {a: sum(ratio[g] for g in gs) // len(gs) for a, gs in places.items()}
    marked = sorted((min(2000, max(-2000, score[h + q] // 10_000)), v) for h, q, _, v in rows if v and held(h + q))
    return rows, score, marked


def test_urls_equal_a_plain_reading(spark):
    rng = random.Random(8)
    made = [f"http://{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['alpha', 'beta', 'cheap-pills'])}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(60)}" for _ in range(400)]
    urls = URLS + made + made[:40]
    pages = spark.createDataFrame([(k if k != 3 else None, u, "x") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    rows, score, marked = plain_scores(urls)
    out = url_filters.judge(pages.selectExpr("*", "'h' as host", "'p' as path", "'r' as rule", "1L as _row", "'a' as gram"))
    got = out.collect()
    assert len(got) == len(urls)
    want = Counter((k if k != 3 else None, *rows[k][:3]) for k in range(len(urls)))
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    least = round(got[0].threshold * 1e6)
    for r in got:
        assert abs(round(r.score * 1e6) - score[r.host + r.path]) <= 1
        ruling = plain_judgement("x://" + r.host + r.path)[3] if r.host or r.path else None
        assert r.verdict == (ruling or ("allow" if round(r.score * 1e6) >= least else "block"))
    # no other threshold parts the held-out URLs better
    gain = lambda at: sum(s >= at for s, v in marked if v == "allow") / sum(v == "allow" for _, v in marked) + sum(s < at for s, v in marked if v == "block") / sum(v == "block" for _, v in marked)
    assert gain(least // 10_000) >= max(gain(s) for s, _ in marked) - 1e-9
    # with the table of ratios too large to be broadcast
    again = url_filters.judge(pages, most=0)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge(pages).collect()] == ["allow", "allow"]
    assert {r.rule for r in url_filters.judge(pages, rules=()).collect()} == {None}
    assert url_filters.judge(pages.where("page_id > 9")).count() == 0


# vector codes


def plain_codes(rows):
    """The contract with every distance computed, in Python's own integers."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = max(1, -(-max(len(q) for *_, q in kept) // 16))
    parts = [[(q + [0] * (16 * width - len(q)))[j * width : (j + 1) * width] for j in range(16)] for *_, q in kept]
    books = [[p[j] for p in parts[:64]] for j in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((far(p[j], e), k) for k, e in enumerate(books[j])) for j in range(16)] for p in parts]

    for _ in range(2):
        a = assigned()
        for j in range(16):
            for k in range(len(books[j])):
                own = [p[j] for p, x in zip(parts, a, strict=True) if x[j][1] == k]
                if own:
                    books[j][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    a = assigned()
    errors = [sum(d for d, _ in x) for x in a]
    by = Counter()
    for (_, l, _), e in zip(kept, errors, strict=True):
        by[l] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in x), e, by[l], digest) for (i, l, _), x, e in zip(kept, a, errors, strict=True))


def vectors(n, size, seed):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(size)], rng.choice([0, 1, 1, None])) for i in range(n)]
    rows += [(n + i, rows[i][1], 1) for i in range(5)] + [(-1, None, 1), (n + 20, [], 2), (n + 21, [float("nan")] * size, 1), (n + 22, [float("inf")] + [0.0] * (size - 1), 1), (n + 23, [None] * size, 1), (3, rows[7][1], 9), (None, rows[8][1], None), (n + 24, [0.25] * (size // 2), 4)]
    return rows


@pytest.mark.parametrize(("n", "size"), [(300, 64), (20, 64), (90, 20), (70, 5)])
def test_codes_equal_plain_integers(spark, n, size):
    rows = vectors(n, size, n)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4))
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())
    assert got == plain_codes(rows)


def test_codes_of_nothing_and_of_huge_components(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    r = vector_codes.compress(spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], kind)).collect()
    assert [x.error for x in r] == [0, 0]


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    entries = rng.integers(-300, 300, (64, 4))
    x = np.concatenate([rng.integers(-300, 300, (2000, 4)), entries])
    pivots = vector_codes.pivots_of(entries)
    to = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2))
    which, far, computed = vector_codes.nearest(x, to, entries, pivots)
    whole = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (which == whole.argmin(1)).all() and (far == whole.min(1)).all()
    assert computed < 0.3 * whole.size
