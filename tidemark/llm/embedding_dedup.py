"""Near-duplicate embeddings by NN-descent.

Vectors of one label are compared by cosine in double precision. Equal vectors
are one node with a multiplicity. A first neighbour graph comes from leaves of
random hyperplane trees; NN-descent rounds then join neighbours of neighbours:
the members of each node's neighbourhood are compared with one another and
better neighbours replace worse ones. Only neighbours of at least FLOOR count,
as the graph serves a threshold far above it. Neighbour lists hold K entries
inside the node's component as known so far, and K outside it. Every pair at the
threshold that any comparison tells goes to a table of its own, before lists
are cut to K. Where a list is saturated with links, the components are joined
and the search is repeated, so that links inside a tight group no longer keep
out those to others, until no list is saturated. Links are then counted in each
whole component, whose members are compared in blocks. Recall is audited against
brute force for bounded samples of all nodes and of those with links; further
trees are grown until it is reached, and an error tells where it isn't.

Leaves and neighbourhoods that outgrow their size are split by hash, anew each
round, so that no task holds an unbounded group; what a split parts, the
rounds join again.

Cases: a vector that is null, zero, or holds null or non-finite components, or
whose label is null, links with nothing; vectors of different lengths don't
link; repeated rows are rows of their own (links count rows); null ids link
like others and don't name a component; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, unsent

COSINE = 0.93
FLOOR = 0.8
K = 12
TREES = 8
BITS = 24
LEAF = 96
BLOCK = 256
ROUNDS = 4
AUDIT = 256
RECALL = 0.97
#: Tables of more rows than this, which grow with the vectors, are not broadcast.
SENT_ROWS = 20_000


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components would leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _large(nodes: DataFrame) -> DataFrame:
    """nodes for a join in which neither side is broadcast: the other one has a row for each of them, or more."""
    return nodes.hint("merge")


def _codes(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            out: list = [None] * b.num_rows
            by: dict[int, list[int]] = {}
            vectors = b.column("embedding").to_pylist()
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for dim, rows in by.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, TREES * BITS))
                up = (_unit([vectors[i] for i in rows]) @ planes[dim] > 0).reshape(len(rows), TREES, BITS)
                codes = (up * (1 << np.arange(BITS)[::-1])).sum(axis=2)
                for i, c in zip(rows, codes.tolist(), strict=True):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "codes"])

    return run


def _nearest(ids: list[int], vectors: list, comps: list[int], k: int) -> tuple[list, list, list, list]:
    """Of each vector, up to k others of the same length with cosine FLOOR or more inside its component (own), and k outside."""
    a, b, c, own_ = [], [], [], []
    for dim in {len(v) for v in vectors}:
        rows = [i for i, v in enumerate(vectors) if len(v) == dim]
        if len(rows) < 2:
            continue
        own = np.array([ids[i] for i in rows])
        x = _unit([vectors[i] for i in rows])
        s = x @ x.T
        np.fill_diagonal(s, -2)
        comp = np.array([comps[i] for i in rows])
        same = comp[:, None] == comp
        for inside in (False, True):
            one = np.where(same == inside, s, -2)
            top = np.argsort(-one, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(one, top, 1)
            i, j = np.nonzero(value >= FLOOR)
            a += own[i].tolist()
            b += own[top[i, j]].tolist()
            c += value[i, j].tolist()
            own_ += [inside] * len(i)
    return a, b, c, own_


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column("members"):
            seen = {m["id"]: m for m in members.as_py()}
            a, b, c, own = _nearest(list(seen), [m["embedding"] for m in seen.values()], [m["comp"] for m in seen.values()], K)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64()), pa.array(own, pa.bool_())], ["a", "b", "cosine", "own"])


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    """(a, b, cosine, own) from comparing the members (id, embedding, comp) of each group."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct("id", "embedding", "comp")).alias("members")).where(F.size("members") > 1).select("members").mapInArrow(_compare, "a long, b long, cosine double, own boolean")


def _best(edges: DataFrame) -> DataFrame:
    """The K best neighbours of each node inside its component and the K best outside."""
    each = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.max("own").alias("own"))
    order = Window.partitionBy("a", "own").orderBy(F.desc("cosine"), "b")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= K).drop("place")


def leaves(nodes: DataFrame, seed: int) -> DataFrame:
    """A first graph: nodes that fall into one leaf of a random hyperplane tree."""
    sizes = nodes.groupBy("label").agg(F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.count("*") / LEAF)))).cast("int").alias("depth"))
    codes = nodes.mapInArrow(_codes(seed), "id long, codes array<int>")
    placed = _large(nodes.select("id", "label")).join(codes, "id").join(sizes, "label").select("id", "label", "depth", F.posexplode("codes").alias("tree", "code"))
    placed = cut(placed.select("id", "label", "tree", F.expr("code >> (24 - depth)").alias("leaf")), "placed")
    full = cut(placed.groupBy("label", "tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts")), "full")
    split = placed.join(unsent(full, SENT_ROWS), ["label", "tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree", F.lit(seed)), "parts"))
    return _grouped(cut(split, "split").join(_large(nodes.select("id", "embedding", "comp")), "id"), "label", "tree", "leaf", "part")


def descend(nodes: DataFrame, graph: DataFrame, turn: int) -> DataFrame:
    """One round: neighbours of neighbours are compared, through each node's neighbourhood in both directions."""
    both = graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(graph.select("a", F.col("a").alias("b"))).distinct()
    both = cut(both, "both")
    parts = cut(both.groupBy("a").agg(F.ceil(F.count("*") / (4 * K)).alias("parts")), "parts")
    dealt = both.join(unsent(parts, SENT_ROWS), "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b", F.lit(turn)), "parts").alias("part"))
    return _grouped(cut(dealt, "dealt").join(_large(nodes.select("id", "embedding", "comp")), "id"), "a", "part")


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each member inside a pair of blocks (i, j); inside one block where they are the same."""
    for batch in batches:
        ids, links = [], []
        for i, j, members in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("members"), strict=True):
            m = members.as_py()
            for dim in {len(r["embedding"]) for r in m}:
                left = [r for r in m if r["block"] == i and len(r["embedding"]) == dim]
                right = [r for r in m if r["block"] == j and len(r["embedding"]) == dim]
                if not left or not right:
                    continue
                near = _unit([r["embedding"] for r in left]) @ _unit([r["embedding"] for r in right]).T >= COSINE
                if i == j:
                    np.fill_diagonal(near, False)
                ids += [r["id"] for r in left]
                links += (near @ np.array([r["n"] for r in right])).tolist()
                if i != j:
                    ids += [r["id"] for r in right]
                    links += (near.T @ np.array([r["n"] for r in left])).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], ["id", "links"])


def count_links(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, links): rows of other nodes that each member of parts(id, component) links with, its component compared in blocks."""
    sizes = cut(parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    blocks = cut(parts.join(unsent(sizes, SENT_ROWS), "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "blocks")
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = pairs.join(_large(nodes.select("id", "embedding", "n")), "id")
    found = rows.groupBy("component", "i", "j").agg(F.collect_list(F.struct("id", "block", "n", "embedding")).alias("members")).select("i", "j", "members").mapInArrow(_count_blocks, "id long, links long")
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, links: DataFrame) -> float:
    """Share of the links of AUDIT nodes of all and AUDIT nodes with links, found by brute force against all nodes, that links(id, links) has; the lower of the two."""
    first = lambda x: x.orderBy(F.xxhash64("id"), "id").limit(AUDIT).select("id", "label", "embedding").toArrow().to_pylist()
    whole, linked = first(nodes), first(_large(nodes).join(links.where("links > 0").select("id"), "id", "left_semi"))
    sample = list({s["id"]: s for s in whole + linked}.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys([s["id"] for s in sample], 0)
        for b in batches:
            rows: dict[tuple, list[int]] = {}
            vectors, labels, own, n = (b.column(c).to_pylist() for c in ("embedding", "label", "id", "n"))
            for k, (v, label) in enumerate(zip(vectors, labels, strict=True)):
                rows.setdefault((len(v), label), []).append(k)
            for (dim, label), at in rows.items():
                asked = [s for s in sample if s["label"] == label and len(s["embedding"]) == dim]
                if asked:
                    near = _unit([s["embedding"] for s in asked]) @ _unit([vectors[k] for k in at]).T >= COSINE
                    ids, weights = np.array([own[k] for k in at]), np.array([n[k] for k in at])
                    for s, row in zip(asked, near, strict=True):
                        total[s["id"]] += int(weights[row & (ids != s["id"])].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "true"])

    true = nodes.select("id", "label", "embedding", "n").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    got = {r["id"]: r for r in true.join(unsent(links, SENT_ROWS), "id", "left").select("id", "true", F.least("true", F.coalesce("links", F.lit(0))).alias("found")).collect()}
    shares = []
    for part in (whole, linked):
        mine = [got[s["id"]] for s in part]
        all_ = sum(r["true"] for r in mine)
        shares.append(sum(r["found"] for r in mine) / all_ if all_ else 1.0)
    return min(shares)


def search(nodes: DataFrame, graph: DataFrame | None, linked: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """One search from new trees: (graph, linked, parts, saturated). linked(a, b) has all pairs at the threshold that were compared and told."""
    parts = None if linked is None else cut(components(linked, most=SENT_ROWS).select("id", F.col("component").alias("comp")), "parts")
    if parts is None:
        nodes = nodes.withColumn("comp", F.col("id"))
    else:
        nodes = cut(nodes.join(unsent(parts, SENT_ROWS), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed-nodes")
    if graph is not None:  # which neighbours are inside by now
        comps = lambda end: _large(nodes).select(F.col("id").alias(end), F.col("comp").alias(f"_{end}"))
        graph = graph.drop("own").join(comps("a"), "a").join(comps("b"), "b").select("a", "b", "cosine", (F.col("_a") == F.col("_b")).alias("own"))
    tables = [] if linked is None else [linked]
    before = 0.0
    for k in range(ROUNDS + 1):
        found = cut(descend(nodes, graph, 10 * seed + k) if k else leaves(nodes, seed), "found")
        tables.append(found.where(F.col("cosine") >= COSINE).select("a", "b"))
        graph = cut(_best(found if graph is None else graph.union(found.select(graph.columns))), "graph")
        now = graph.agg(F.sum("cosine")).first()[0] or 0.0
        if k and now <= 1.001 * before:
            break
        before = now
    full = graph.where((F.col("cosine") >= COSINE) & ~F.col("own")).groupBy("a").count().where(F.col("count") >= K)
    saturated = not full.isEmpty()
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    linked = cut(every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "linked")
    parts = cut(components(linked, most=SENT_ROWS), "parts")
    return graph, linked, parts, saturated


def near_duplicates(vectors: DataFrame, tries: int = 12) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(good, F.lit(False)).alias("good"))
    each = rows.where("good").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = cut(each.select(F.monotonically_increasing_id().alias("id"), "label", "embedding", "n", "least"), "nodes")
    graph = linked = None
    seed = 0
    for _ in range(tries):
        saturated = True
        while saturated:  # a saturated list joins its component with K others, so that this ends
            graph, linked, parts, saturated = search(nodes, graph, linked, seed)
            seed += 1
        links = cut(count_links(nodes, parts), "links")
        recall = audit(nodes, links)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"near_duplicates: recall {recall:.3f} of {RECALL} after {seed} searches")
    named = nodes.select("id", "n", "least").join(unsent(parts, SENT_ROWS), "id", "left").join(unsent(links, SENT_ROWS), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = cut(named, "named")
    smallest = cut(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    classes = named.join(unsent(smallest, SENT_ROWS), "component").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    classes = cut(_large(nodes.select("id", "label", "embedding")).join(classes, "id").drop("id"), "classes")
    out = rows.join(unsent(classes, SENT_ROWS), ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
