import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import compaction, embedding_dedup, html_extraction, mixing, quality_classifier
from tidemark.llm.common import components, scratch


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 900 + k) for k in range(1, 50)]
    part = {x: x for e in edges for x in e}

    def top(x):
        return x if part[x] == x else top(part[x])

    for a, b in edges:
        x, y = top(a), top(b)
        part[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classifier(docs, labels, no_labels, empty):
    r = quality_classifier.classify(docs, labels)
    assert r.count() == docs.count()
    assert r.where("keep is null or score is null").count() == 0
    assert quality_classifier.classify(docs, no_labels).count() == docs.count()
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.kept(docs.withColumn("p_quality", F.lit(1)), labels).columns[-1] == "p_quality"


def test_classifier_learns(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows, marks = [], []
    for i in range(900):
        toxic, low = i % 5 == 0, i % 7 == 0
        w = [rng.choice(words) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = "scoundrel"
        text = " ".join(x.upper() + "!!" if low else x for x in w)
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        if i < 700:
            marks.append((i, int(not low), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    r = quality_classifier.classify(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).where("doc_id >= 700").collect()
    assert np.mean([x.keep == (x.doc_id % 5 != 0 and x.doc_id % 7 != 0) for x in r]) > 0.95


def test_sparse_sites_shrink_to_the_level_above(spark):
    rows = [("big", "p", 0.9, 0.1)] * 200 + [("other", "p", 0.5, 0.5)] * 200 + [("new", "p", 0.0, 1.0)]
    got = {r.site_host: r for r in quality_classifier.sites(spark.createDataFrame(rows, "h string, p string, p_quality double, p_toxic double"), "h", "p").collect()}
    mean = got["big"].all_p_quality
    assert abs(got["big"].site_p_quality - 0.9) < 0.02
    assert 0 < got["new"].site_p_quality < mean


@pytest.mark.parametrize("sites", [100_000, 0])
def test_site_posteriors_equal_brute_force(spark, monkeypatch, sites):
    """Shrinkage and leave-one-out against plain Python, with the broadcast and with the salted join."""
    monkeypatch.setattr(quality_classifier, "SITES", sites)
    rng = random.Random(11)
    rows = [(i, (None, "a", "b", "c")[i % 4], ("x", None, "y")[i % 3] if i % 4 < 3 else f"p{i}", min(0.99, max(0.01, rng.gauss(0.2 + 0.2 * (i % 4), 0.1))), rng.random() * 0.3) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, h string, p string, p_quality double, p_toxic double")
    place = quality_classifier.sites(df, "h", "p")
    got = {r.doc_id: r for r in quality_classifier._decided(df.withColumn("n", F.lit(7)).withColumn("score", F.lit("old")), place, "h", "p").collect()}
    assert len(got) == 90 and got[0].n == 7

    def strength(groups, above, mu):
        n = sum(len(v) for v in groups.values())
        s = sum(len(v) * (np.mean(v) - above[k]) ** 2 for k, v in groups.items())
        spread = (s - (len(groups) - 1) * mu * (1 - mu)) / max(1.0, n - sum(len(v) ** 2 for v in groups.values()) / n)
        return 1e6 if spread <= mu * (1 - mu) * 1e-6 else min(1e6, max(1.0, mu * (1 - mu) / spread - 1))

    logit = lambda p: math.log(p / (1 - p))
    for col, c in ((3, "p_quality"), (4, "p_toxic")):
        mu = np.mean([r[col] for r in rows])
        hosts, paths = {}, {}
        for r in rows:
            hosts.setdefault(r[1], []).append(r[col])
            paths.setdefault((r[1], r[2]), []).append(r[col])
        s = strength(hosts, dict.fromkeys(hosts, mu), mu)
        mean = {h: (sum(v) + s * mu) / (len(v) + s) for h, v in hosts.items()}
        t = strength(paths, {k: mean[k[0]] for k in paths}, mu)
        for r in rows:
            above = (sum(hosts[r[1]]) - r[col] + s * mu) / (len(hosts[r[1]]) - 1 + s)
            site = (sum(paths[r[1], r[2]]) - r[col] + t * above) / (len(paths[r[1], r[2]]) - 1 + t)
            assert got[r[0]][f"site_{c}"] == pytest.approx(site, abs=1e-9)
            assert logit(got[r[0]][f"post_{c}"]) == pytest.approx(logit(r[col]) + quality_classifier.SITE_WEIGHT * (logit(site) - logit(mu)), abs=1e-6)


def test_mixing_meets_targets(docs, labels, no_labels, empty):
    r = mixing.mix(docs, labels).agg(F.sum("n_tokens").alias("t"), F.min("rate").alias("least"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS]).first()
    assert r.least >= 0
    for d in mixing.DOMAINS:
        assert r[d] / r.t == pytest.approx(mixing.TARGETS[d], abs=0.02)
    assert mixing.mix(docs, no_labels).count() == docs.count()
    assert mixing.mix(empty, labels).count() == 0
    both = mixing.mixed(docs.withColumn("_w", F.lit(1)).withColumn("_row", F.lit(2)), labels)
    assert both.columns == [*docs.columns, "_w", "_row"]
    assert len(both._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert mixing.mixed(docs, no_labels).count() == docs.count()
    assert mixing.mixed(empty, labels).count() == 0


def test_mixing_reaches_the_least_squares_point(spark):
    """Against projected gradient with a rate held for every document, and ties get equal rates."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 60)
    p[30:] = p[:30]
    t = rng.integers(1, 90, 60)
    t[30:] = t[:30]
    members = spark.createDataFrame([(k, int(t[k]), *map(float, p[k])) for k in range(60)], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    got = {r.doc_id: r.rate for r in members.select("doc_id", mixing.rate(mixing.fit_rates(members)).alias("rate")).collect()}
    goal = np.array(list(mixing.TARGETS.values()))
    moves = np.zeros(60)
    for _ in range(200_000):
        moves -= 0.3 * p @ ((t * np.maximum(0, 1 + moves)) @ p / t.sum() - goal)
    want = np.maximum(0, 1 + moves)
    assert np.abs((t * want) @ p / t.sum() - goal).max() < 1e-6
    assert max(abs(got[k] - want[k]) for k in range(60)) < 0.02
    assert all(got[k] == got[k + 30] for k in range(30))


def test_mixing_classifier_learns(spark):
    """Held-out accuracy of the memberships on three plain domains."""
    rng = random.Random(9)
    common = [f"word{k}" for k in range(60)]
    rows, marks = [], []
    for i in range(900):
        domain = (0, 0, 0, 1, 2)[i % 5]
        w = [rng.choice(common) for _ in range(50)]
        if domain == 2:
            w[3], w[9] = "scoundrel", "villain,"
        text = " ".join(x.upper() + "!!" if domain == 1 else x for x in w)
        rows.append((i, text))
        marks.append((i, int(domain != 1), int(domain == 2)))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks[:600], "doc_id long, quality int, toxic int")).where("doc_id >= 600").collect()
    assert np.mean([(r.p_clean, r.p_low, r.p_toxic)[(0, 0, 0, 1, 2)[r.doc_id % 5]] > 0.5 for r in got]) > 0.95


def test_mixture_keeps_clean_documents(spark):
    """Clean documents hold more tokens than their target: none goes, and the others are repeated."""
    p = [(k, 0.999, 0.0005, 0.0005) for k in range(300)] + [(300, 0.001, 0.998, 0.001), (301, 0.001, 0.001, 0.998)]
    members = spark.createDataFrame([(k, 100, *x) for k, *x in p], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    multipliers = mixing.fit_rates(members, corpus_pipeline.TARGETS)
    got = {r.doc_id: r for r in members.select("doc_id", mixing.rate(multipliers).alias("rate"), mixing.copies(mixing.whole_rate(multipliers), F.col("doc_id")).alias("n")).collect()}
    assert got[0].rate < 1
    assert all(got[k].n >= 1 for k in range(300))
    assert got[300].n > 1
    # clean documents that should be repeated keep their rate, and a target of none for them takes none away
    assert members.select(F.min(mixing.whole_rate([1.0, -1.0, -1.0]))).first()[0] < 0.01
    assert members.where("doc_id < 300").select(F.min(mixing.whole_rate([-1.0, 0.0, 0.0]))).first()[0] == 1


def test_compaction(docs, empty, spark):
    store = compaction.ShardStore(spark, f"{scratch(spark)}/store-test")
    assert store.version() == 0
    wide = docs.withColumn("_run", F.lit("x")).withColumn("_row", F.lit(None).cast("int")).withColumn("file", F.lit(1))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    store.append(wide, shard_rows=4)
    few = wide.limit(3).collect()
    store.append(spark.createDataFrame(few, wide.schema), shard_rows=4)
    small = store.manifest().count()
    held = rows(store.read())
    assert held == sorted([tuple(r) for r in [*wide.collect(), *few]], key=repr)
    v = store.compact()
    assert v == 3
    assert store.manifest().count() < small
    assert store.read().columns == wide.columns
    assert rows(store.read()) == held
    assert rows(store.read(1)) == rows(wide)
    assert store.compact() == v
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), v, store.schema())
    assert rows(store.read()) == held
    with pytest.raises(ValueError):
        store.append(docs)


def test_compaction_of_nothing(empty, spark):
    store = compaction.ShardStore(spark, f"{scratch(spark)}/store-empty")
    store.append(empty)
    store.compact()
    assert store.read().columns == empty.columns
    assert store.read().count() == 0


def test_compaction_of_any_names(docs, spark):
    """Columns named like Spark's own or with signs, below a root with a blank and a per cent sign."""
    store = compaction.ShardStore(spark, f"{scratch(spark)}/a store%20 of {random.random()}")
    odd = docs.withColumnsRenamed({"lang": "_metadata", "source": "a`b", "n_chars": "a.b c"})
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    store.append(odd, shard_rows=2)
    before = store.manifest().count()
    version = store.compact()
    assert version == 2 and store.manifest().count() < before
    assert store.read().columns == odd.columns and rows(store.read()) == rows(odd) == rows(store.read(1))
    held = store.read()
    listed = {(r.file, r.bytes) for r in store.manifest().collect()}
    assert {tuple(r) for r in held.select(compaction.shard_of(held), compaction.shard_bytes_of(held)).distinct().collect()} == listed


def test_compacted_files_have_the_target_size(spark):
    """One file a run, also where the planner is set to much smaller partitions; and a second pass finds nothing to do."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        store = compaction.ShardStore(spark, f"{scratch(spark)}/store-{random.random()}")
        target = 200_000
        noise = spark.range(0, 4000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
        store.append(noise, shard_rows=100)
        version = store.compact(target)
        sizes = [r.bytes for r in store.manifest().where("added = 2").collect()]
        assert len(sizes) > 1 and max(sizes) <= 1.5 * target and sum(x >= target / 2 for x in sizes) >= len(sizes) - 1
        assert store.compact(target) == version
        assert store.read().count() == store.read().select("id").distinct().count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_compaction_runs_reach_over_ranges(spark):
    """Runs are those of the whole order of a tier, however many ranges it is sorted in."""
    store = compaction.ShardStore(spark, f"{scratch(spark)}/store-runs")
    rng = random.Random(8)
    files = [(f"f{k:03}", rng.randint(1, 900), k % 2, 1) for k in range(200)]
    store.commit(spark.createDataFrame(files, "file string, bytes long, tier int, added long"), 1, spark.range(1).schema)
    want = {}
    for tier in (0, 1):
        at = 0
        for file, size in sorted(((f, n) for f, n, t, _ in files if t == tier), key=lambda x: (x[1], x[0])):
            want.setdefault((tier, at // 2000), []).append(file)
            at += size
    got = {}
    for r in store.runs(target=2000, min_run=4).collect():
        got.setdefault(r.run, []).append(r.file)
    sizes = {f: n for f, n, _, _ in files}
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) >= 4 or sum(map(sizes.get, x)) >= 1500 and len(x) > 1)


def test_nn_descent_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 16))
    rows = [(i, base[i].tolist(), i % 3) for i in range(120)]
    rows += [(1000 + k, (base[0] + 0.02 * rng.standard_normal(16)).tolist(), 0) for k in range(40)]
    rows += [(2000 + k, base[1].tolist(), 1) for k in range(30)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, base[0].tolist(), None), (3003, [float("nan")] * 16, 0), (3004, [1.0, None], 0), (3005, [], 0), (3006, [1.0, 0.0], 0), (3007, [1.0, 0.0], 0), (3008, base[0].tolist(), 1)]
    rows += [(3100, [1e-200, 1e-200], 2), (3101, [3e-201, 3.1e-201], 2), (3102, [1e-200, -1e-200], 2), (3103, [1e300, 1e300], 2), (3104, [5e-324, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    good = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), lab) for i, v, lab in good]
    links = {i: {j for j, w, m in good if j != i and m == lab and len(w) == len(v) and v @ w >= 0.93} for i, v, lab in good}
    for r in embedding_dedup.near_duplicates(df).collect():
        mine, todo = {r.vec_id}, [r.vec_id]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in mine:
                    mine.add(j)
                    todo.append(j)
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), min(mine), r.vec_id == min(mine)), r
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_nn_descent_joins_tight_groups(spark):
    """Two groups of 40 distinct vectors, tight inside (0.998) and linked with each other (0.96): lists fill from inside."""
    rng = np.random.default_rng(6)
    u, v, *_ = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
    w = 0.96 * u + (1 - 0.96**2) ** 0.5 * v
    rows = []
    for g, c in enumerate((u, w)):
        for k in range(40):
            e = rng.standard_normal(48)
            rows.append((100 * g + k, (c + 0.032 * e / np.linalg.norm(e)).tolist(), 0))
    rows += [(1000 + k, rng.standard_normal(48).tolist(), 0) for k in range(200)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i, _, _ in rows[:80]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (79, 0, i == 0)


def test_nn_descent_tells_low_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit", lambda nodes, links: 0.5)
    with pytest.raises(RuntimeError):
        embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.1], 0), (2, [1.0, 0.2], 0)], "vec_id long, embedding array<double>, label int"), tries=1)


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; shoulders</h1><p><b>One\n two<br>three<p>Four &#8212; five</p></article><footer>&copy; x</footer>'


def test_html_blocks():
    texts, kinds = html_extraction.lines_of(PAGE)
    assert [t for t, k in zip(texts, kinds, strict=True) if k == 2] == ["Head & shoulders", "One two", "three", "Four — five"]


def test_html_paragraphs_end_at_blocks():
    texts, kinds = html_extraction.lines_of('<body><p class="notice">Note<div>Body</div><article><div class="article-header"><h1>Title</h1></div><p class="ad">Buy<p>One <b>two<h2>Three</h2><div class="site-header">Logo</div></article>')
    assert list(zip(texts, kinds, strict=True)) == [("Note", 0), ("Body", 1), ("Title", 2), ("Buy", 0), ("One two", 2), ("Three", 2), ("Logo", 0)]


def test_html_differencing_decides_inside_articles(spark):
    """Unnamed boxes and lists of an article are decided by the neighbours; its wording stays, shared or not."""
    page = lambda k: f"<article><h1>Title {k}</h1><p>Licence line</p><p>Text {k}</p><div>Read also</div><ul><li>Most read</li></ul></article>"
    rows = [(k, f"http://h.example/a/{k:02}", page(k)) for k in range(4)]
    run = lambda rows: {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    got = run(rows)
    assert all(got[k] == f"Title {k}\nLicence line\nText {k}" for k in range(4))
    assert run(rows[:1])[0] == "Title 0\nLicence line\nText 0\nRead also\nMost read"


def test_shared_lines():
    assert html_extraction.shared([1, 2, 3, 9, 4], [1, 3, 7, 4]) == {0, 2, 4}
    assert html_extraction.shared([], [1]) == set()
    assert len(html_extraction.shared([5, 1, 5, 2, 5], [5, 5, 2])) == 3


def test_shared_equals_the_classic_table():
    """The aligned places are a longest common subsequence, by the quadratic table."""
    rng = random.Random(12)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice((2, 5, 30))) for _ in range(rng.randrange(14))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_extraction.shared(a, b)
        assert len(got) == best[-1][-1]
        rest = iter(b)
        assert all(a[k] in rest for k in sorted(got))


def test_html_names():
    """A name is a role where all its parts are roles or places; parts of other names prove nothing."""
    role = html_extraction.role_of
    assert all(role(x) == "drop" for x in ("ad", "ad-slot-3", "siteHeader", "cookie_notice", "post wide comments-list", "promoBox7", "main-nav", "newsletter-signup"))
    assert all(role(x) == "weak" for x in ("share-price", "search-warrant", "related-work", "notice-board"))
    assert all(role(x) == "" for x in ("", "lead", "loading", "article-header", "entry-header", "reader", "subheading"))
    assert role("post no-comments", True) == "weak" and role("comment-12", True) == "drop" and role("share", True) == ""
    assert html_extraction.lines_of('<div data-id="ad">Text</div>') == (["Text"], [1])


def test_html_articles(spark):
    """Weak names inside an article, titles in its header, heads of its tables stay; readers' posts as articles go."""
    page = lambda k: f"""<article><header><h1>Title {k}</h1><p>By one</p></header><p class="share-price">Price {k}</p><section class="related-work"><p>Work {k}</p></section>
<p class="notice-board">Board</p><table><thead class="header"><tr><th>Year</th></tr></thead></table><p>Body <span class="share-price">of</span> {k}</p><article><p>Nested post {k}</p></article></article>
<article class="user-post"><p>Post {k}</p></article><article class="comment-body"><p>A much longer comment than all the rest of page {k}, and then some more words that go on and on and on</p></article><div class="share-price">Beside {k}</div>"""  # noqa: E731
    rows = [(k, f"http://h.example/a/{k:02}", page(k)) for k in range(4)] + [(9, "http://i.example/", page(9)), (10, "http://j.example/", '<article><article><p>Wrapped</p></article></article><p class="share-price">x</p>'), (11, "http://k.example/", '<p class="share-price">Alone</p>')]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(4):
        assert got[k] == f"Title {k}\nPrice {k}\nWork {k}\nYear\nBody of {k}"
    assert got[9] == "Title 9\nPrice 9\nWork 9\nBoard\nYear\nBody of 9"
    assert (got[10], got[11]) == ("Wrapped", "Alone")


def test_html_differencing_decides_on_planted_templates(spark):
    """Sites whose templates carry no telling names: with neighbours every page is right, without them none."""
    rng = random.Random(3)
    rows, want = [], {}
    for site in range(6):
        word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        top, low, box = word(4), word(6), word(5)
        for k in range(10):
            body = [word(12) for _ in range(rng.randrange(2, 6))]
            head = "<div>" + top + "</div>" if rng.random() < 0.9 else f'<div class="top-strip-x">{top}</div>'
            prose = "".join(f"<p>{b}</p>" for b in body)
            shape = (f"{head}<div>{prose}</div><div>{low}</div>", f'{head}<main>{prose}<section class="share-price">{box}</section></main><div>{low}</div>', f'{head}<article>{prose}<div class="related-reads">{box}</div></article><div>{low}</div>')[site % 3]
            rows.append((site * 100 + k, f"http://s{site}.example/p/{k:02}", f"<html><body>{shape}</body></html>"))
            want[site * 100 + k] = "\n".join(body)
    with_ = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    alone = {i: "\n".join(html_extraction.kept(*html_extraction.lines_of(h), set())) for i, _, h in rows}
    assert with_ == want
    assert sum(alone[i] == want[i] for i in want) == 0


def test_html_differencing(spark):
    site = [(k, f"http://h.example/a/{k:02}", f"<div>Logo text</div><div>Body {k} alone</div><div>All rights</div>") for k in range(9)]
    rows = [*site, (50, "http://other.example/", "<div>Logo text</div><p>Single</p>"), (51, None, None), (52, "x", ""), (53, "http://h.example/z", PAGE), (53, "http://h.example/z", PAGE), (54, "http://c.example/1", "<p>Same</p>"), (55, "http://c.example/2", "<p>Same</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    assert html_extraction.extract(df).count() == len(rows)
    for k in range(9):
        assert got[k].text == f"Body {k} alone"
    assert got[50].text == "Logo text\nSingle"
    assert (got[51].text, got[51].n_chars, got[52].text) == ("", 0, "")
    assert got[53].text == "Head & shoulders\nOne two\nthree\nFour — five"
    assert got[54].text == got[55].text == "Same"
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differencing_decides_beside_articles(spark):
    """Plain lines beside an article and lines in main are decided by the neighbours; copies at adjacent URLs are one place, also over partitions."""
    rows = [(k, f"http://h.example/a/{k:02}", f"<article><p>Teaser {k}</p></article><div>Body {k} alone</div><div>All rights</div>") for k in range(5)]
    rows += [(10 + k, f"http://m.example/a/{k:02}", f"<main><p>Logo text</p><p>Text {k}</p></main>") for k in range(5)]
    rows += [(100 + k, f"http://c.example/b/{k:03}", f"<div>Logo text</div><p>{'Same' if 2 <= k < 57 else k}</p>") for k in range(60)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for k in range(5):
        assert got[k] == f"Teaser {k}\nBody {k} alone"
        assert got[10 + k] == f"Text {k}"
    for k in range(60):
        assert got[100 + k] == ("Same" if 2 <= k < 57 else str(k))


def test_stages_hand_python_few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    def largest():
        return max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(counted, "n long").collect())

    before, none = spark.conf.get(key), spark.createDataFrame([], "doc_id long, text string, n_chars long")
    try:
        for start, most in (("10000", 256), ("0", 256), ("100", 100)):
            spark.conf.set(key, start)
            corpus_pipeline.STAGES[2][1](spark, none, "").count()
            assert largest() == most
    finally:
        spark.conf.set(key, before)


def test_pipeline(docs, labels, spark):
    path = f"{scratch(spark)}/pipeline-test"
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    left = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == docs.columns, name
        if name in ("quality", "near_duplicates", "repeats"):
            assert now.count() <= left, name
            left = now.count()
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
