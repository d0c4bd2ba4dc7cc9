import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import lm_scoring, packing, quality_rules, queries, simhash, suffix_dedup
from tidemark.llm.queries import byte_bpe

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def texts(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = packing.pack(docs, byte_bpe()).collect()
    by_sequence, held = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        held[r.doc_id] += r.length
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    for (doc, n, _), k in want.items():
        assert held[doc] == sum(c * m for (d, m, _), c in want.items() if d == doc)
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in rows if r.length == r.doc_tokens)
    assert not whole - want
    assert packing.pack(empty, byte_bpe()).count() == 0


def test_packing_leaves_little_padding():
    rng = np.random.default_rng(3)
    lengths, demand = np.unique(rng.integers(1, 1024, 20000), return_counts=True)
    plan = packing.plan(lengths, demand)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all(p @ lengths <= 1024 for p, _ in plan)
    assert lengths @ demand / 1024 / sum(n for _, n in plan) > 0.995


def test_ids_follow_the_tokenizer():
    from tokenizers import Tokenizer

    t, fast = Tokenizer.from_file(byte_bpe()), packing.Ids(byte_bpe())
    for x in ("", " ", "  ", "a  b", " a", "a ", "a \n b", "it's  we'll   x", "\n\n a\tb ", "<|endoftext|> a", "a <|endoftext|>", "日本 語", "a   b", "1 22  333 ", "  a", "a   b"):
        assert fast(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_a_text_of_rare_words_is_encoded_at_once():
    ids, texts_ = packing.Ids(byte_bpe()), []

    class Counted:
        def encode_ordinary(self, text, fast=ids.fast):
            texts_.append(text)
            return fast.encode_ordinary(text)

    ids.fast = Counted()
    text = " ".join(f"rare{k}word" for k in range(50))
    assert len(ids(text)) > 4 * 50 and texts_ == [text]


def test_quality_rules_base(docs, empty):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in texts(docs):
        w = word.findall(t)
        lines, seen = [x for x in t.split(b"\n") if word.search(x)], set()
        dup = sum(x in seen or seen.add(x) is not None for x in lines)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", t)), dup, len(inside)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (r.base_failed and r.kept)
        assert len(w) >= quality_rules.GUARD_WORDS or r.word_distance is None
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_verdict_equals_brute_force(spark):
    """Distances and verdicts against plain Python; rare, null and empty languages and words of any character have references of their own."""
    import random

    rng = random.Random(12)
    rows = []
    for i in range(2400):
        words = [f"{'abcdefgh'[i % 4]}{rng.choice('aeiou')}{rng.choice('nrst')}" for _ in range(rng.choice((5, 60, 90)))]
        if i % 50 == 0:
            words = ["#$%&"] * 30 + ["QQQ", "ZZZ"] * 20
        rows.append((i, " ".join(words), (None, "", "en", "de")[i % 4]))
    rows += [(5000, "\x00abc \x00 words " * 30, "x1"), (5001, "other text here " * 40, "x2"), (5002, None, "x3")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    by = {}
    for i, t, lang in rows:
        by.setdefault(lang, []).append((i, (t or "").encode()))

    def js(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        kl = lambda a: sum(v * math.log2(v / m[k]) for k, v in a.items() if v > 0)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    def shares(c):
        return {k: n / sum(c.values()) for k, n in c.items()}

    for docs in by.values():
        chars, words = Counter(), Counter()
        for _, t in docs:
            chars.update(dict(enumerate(quality_rules.class_counts(t).tolist())))
            words.update(quality_rules._words(t))
        total = sum(words.values())
        common = {w for w, n in words.items() if n >= max(1, total * quality_rules.SHARE) and w}
        fold = lambda c: Counter({w: n for w, n in c.items() if w in common}) + Counter({None: sum(n for w, n in c.items() if w not in common)})
        for i, t in docs:
            own = quality_rules.class_counts(t).tolist()
            w = quality_rules._words(t)
            c = js(shares(dict(enumerate(own))), shares(chars)) if sum(own) >= quality_rules.GUARD_CHARS else None
            d = js(shares(fold(Counter(w))), shares(fold(words))) if len(t.split()) >= quality_rules.GUARD_WORDS and common else None
            assert got[i].char_distance == (c if c is None else pytest.approx(c, abs=1e-9)), i
            assert got[i].word_distance == (d if d is None else pytest.approx(d, abs=1e-9)), i
            assert got[i].kept == (not got[i].base_failed and (c or 0) <= quality_rules.MAX_CHARS and (d or 0) <= quality_rules.MAX_WORDS), i


def test_distance_is_jensen_shannon():
    assert quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality_rules.distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def test_suffix_dedup_equals_brute_force(docs, empty):
    rows = texts(docs)
    seen = Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    want = Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        want[i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()] += 1
    got = suffix_dedup.digest(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(r.has_repeats == (r.n_removed > 0) for r in got)
    assert any(k[2] for k in want)
    assert suffix_dedup.digest(empty).count() == 0
    assert suffix_dedup.strip(docs).count() == len(rows)


def test_repeated_words_equal_brute_force(docs, empty, spark):
    """Passages of 50 to 56 short words, all under 400 bytes, between other white space in every document; 49 words stay."""
    rng = random.Random(11)

    def other(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]

    def planted(passage, k):
        words = [*other(rng.randint(0, 150)), *passage, *other(rng.randint(0, 150))]
        return (rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", " ", "\n", "\t ", "  "]) for w in words)).rstrip(rng.choice(["", "\n "]))

    rows = [(1000 + 10 * n + k, planted(passage, k)) for n, passage in enumerate(other(m) for m in (49, 50, 51, 55, 56, 60)) for k in range(2 + n)]
    rows += [(2000, " ".join(other(50) * 2)), (2001, "né " * 60), (2002, "né\n" * 49), (2003, " ".join(["w"] * 50)), (2004, "\n" + "\t".join(["w"] * 50) + "\n"), (2005, " \n"), (2006, "Z" * 500), (2007, "Z" * 500)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    held = [(r.doc_id, r.text, (r.text or "").encode()) for r in every.collect()]
    spans = {t: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for _, _, t in held}
    seen = Counter(t[k : k + 400] for _, _, t in held for k in range(len(t) - 399))
    runs = Counter(tuple(t[a:b] for a, b in spans[t][k : k + 50]) for _, _, t in held for k in range(len(spans[t]) - 49))
    want, short = Counter(), set()
    for i, text, t in held:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        by_bytes = gone.copy()
        for k in range(len(spans[t]) - 49):
            if runs[tuple(t[a:b] for a, b in spans[t][k : k + 50])] > 1:
                gone[spans[t][k][0] : spans[t][k + 49][1]] = True
        if gone.any() and not by_bytes.any():
            short.add(i)
        edges = [0, *np.flatnonzero(np.diff(gone.view(np.int8))) + 1, len(t)]
        want[i, None if text is None else "".join(t[a:b].decode(errors="ignore") for a, b in zip(edges, edges[1:]) if b > a and not gone[a])] += 1
    both = (suffix_dedup.BYTES, suffix_dedup.WORDS)
    got = suffix_dedup.strip(every, both)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {1010, 1011, 1020, 1052, 2000, 2003, 2004} <= short and not {1000, 1001, 2002, 2006} & short
    assert suffix_dedup.strip(empty, both).count() == 0

    chars = every.withColumn("n_chars", F.length("text"))
    kept = {r.doc_id: r for r in corpus_pipeline.repeats(spark, chars, "").collect()}
    assert {1010, 1011, 1020, 1052} <= set(kept) and not {401, 2003, 2004, 2005, 2006} & set(kept)
    assert all((i, kept[i].text) in want and kept[i].n_chars == len(kept[i].text) for i in range(1000, 1056) if i in kept)


def test_op4_tells_passages_of_words_below_400_bytes(docs, spark, tmp_path):
    """op4 counts passages of 50 words apart from the bytes: its 400-byte columns stay those of brute force."""
    rng = random.Random(17)

    def other(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n)]

    passages = {n: other(n) for n in (49, 50, 51, 56)}
    rows = [(1000 + 10 * n + k, rng.choice([" ", "\n", "\t"]).join([*other(rng.randint(0, 90)), *p, *other(rng.randint(0, 90))])) for n, p in passages.items() for k in range(3)]
    docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    held = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    split = {t: re.findall(rb"[^\x20\x09-\x0D]+", t) for _, t in held}
    seen = Counter(t[k : k + 400] for _, t in held for k in range(len(t) - 399))
    runs = Counter(tuple(split[t][k : k + 50]) for _, t in held for k in range(len(split[t]) - 49))
    want = Counter()
    for i, t in held:
        gone, again = np.zeros(len(t), bool), np.zeros(len(split[t]), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        for k in range(len(again) - 49):
            if runs[tuple(split[t][k : k + 50])] > 1:
                again[k : k + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest(), bool(gone.any()), int(again.sum()), bool(again.any())] += 1
    got = queries.op4_suffix_dedup(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == want
    told = {r.doc_id: r for r in got}
    assert all(told[1000 + 10 * n + k].n_passage_words == (n if n >= 50 else 0) and not told[1000 + 10 * n + k].has_repeats for n in passages for k in range(3))


def test_simhash_equals_brute_force(docs, empty, spark):
    import xxhash

    def fp(t):
        w = t.translate(LOWER).split()
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fp(t)) for i, t in texts(docs)]
    left = dict.fromkeys({f for _, f in rows})
    groups = []
    while left:
        todo, group = [next(iter(left))], set()
        while todo:
            a = todo.pop()
            if a in left:
                left.pop(a)
                group.add(a)
                todo += [b for b in left if (a ^ b).bit_count() <= 2]
        groups.append(group)
    least = {f: min((i for i, g in rows if g in group and i is not None), default=None) for group in groups for f in group}
    want = Counter((i, f"{f:016x}", least[f]) for i, f in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({c for c in least.values() if c is not None})


@pytest.mark.parametrize("rows", [128, 2])
def test_simhash_links_in_full_shards(spark, rows, monkeypatch):
    """A ball of fingerprints around one centre: every shard is full, and the neighbour keys join them."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    centre = 0x0F0F_1234_5678_9ABC
    ball = [centre] + [centre ^ 1 << a for a in range(0, 64, 3)] + [centre ^ 1 << a ^ 1 << b for a in range(0, 64, 9) for b in range(a + 1, 64, 11)]
    far = [centre ^ 0x7777 ^ (k << 40) for k in range(1, 5)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    ball, far = {signed(x) for x in ball}, {signed(x) for x in far}
    found = simhash.links(spark.createDataFrame([(x,) for x in ball | far], "fp long")).distinct().collect()
    parts = {x: x for x in ball | far}

    def ids(x):
        return x if parts[x] == x else ids(parts[x])

    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
        parts[ids(r.a)] = ids(r.b)
    assert len({ids(x) for x in ball}) == 1


def test_bk_tree():
    import random

    rng, tree = random.Random(1), simhash.BKTree()
    values = [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.within(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


def test_lm_scores(docs, empty):
    rows = texts(docs)
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = [(i, [*t.translate(LOWER).split(), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(docs).collect()
    assert len(got) == len(rows)
    for i, ws in tokens:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert any(r.doc_id == i and r.n_tokens == len(ws) and r.n_known == sum(w in c for w in ws) and r.train_tokens == n and r.held_out == held[i] and abs(r.base_score - base) < 1e-6 * max(1, abs(base)) for r in got), i
    model = _interpolated(rows)
    for i, ws in tokens:
        want = sum(math.log10(model(ws[k - 1] if k else "start", w)) for k, w in enumerate(ws))
        assert any(r.doc_id == i and r.n_tokens == len(ws) and abs(r.score - want) < 1e-6 * max(1, abs(want)) for r in got), i
    assert lm_scoring.score(empty).count() == 0


def _interpolated(rows):
    """The model in plain Python: p(word, context); None is the end, "start" stands before a text's first word."""
    fold = {i: lm_scoring.fold_of(i) for i, _ in rows}

    def counts(folds):
        one, two, before = Counter(), Counter(), Counter()
        for i, t in rows:
            if fold[i] in folds:
                ws = [*t.translate(LOWER).split(), None]
                one.update(ws)
                before.update(["start", *ws[:-1]])
                two.update(zip(["start", *ws[:-1]], ws, strict=True))
        return one, two, before

    def estimates(found, context, w):
        one, two, before = found
        n = before[context]
        return min(lm_scoring.CLASSES - 1, math.ceil(math.log2(n + 1))), two[context, w] / max(1, n), one[w] / max(1, sum(one.values()))

    base, cells = counts({0}), {}
    level = lambda p: int(min(lm_scoring.BINS - 2, max(0, math.floor(-math.log2(p) * lm_scoring.FINE)))) + 1 if p > 0 else 0
    for i, t in rows:
        if fold[i] == 1:
            ws = ["start", *t.translate(LOWER).split(), None]
            for context, w in zip(ws, ws[1:], strict=False):
                kind, p2, p1 = estimates(base, context, w)
                cells.setdefault((kind * lm_scoring.BINS + level(p2)) * lm_scoring.BINS + level(p1), []).append((p2, p1))
    keys = np.array(sorted(cells), np.int64)
    means = np.array([np.mean(cells[k], axis=0) for k in keys]).reshape(-1, 2)
    weights = lm_scoring.weights(keys, np.array([len(cells[k]) for k in keys]), means[:, 0], means[:, 1], 1 / (len(base[0]) + 1))
    found = counts({0, 1})

    def p(context, w):
        kind, p2, p1 = estimates(found, context, w)
        return weights[kind, 0] * p2 + weights[kind, 1] * p1 + weights[kind, 2] / (len(found[0]) + 1)

    return p


def test_lm_probabilities_sum_to_one(spark):
    """After seen and unseen contexts, the probabilities over the vocabulary and one unknown word sum to 1, and Spark's scores are theirs."""
    train = [(i, b"a b a c b a") for i in range(200)] + [(i, b"c c zz") for i in range(200, 240)]
    p = _interpolated(train)
    for context in (b"a", b"b", b"zz", b"unseen", "start"):
        assert sum(p(context, w) for w in (b"a", b"b", b"c", b"zz", None, b"unknown")) == pytest.approx(1, abs=1e-9)
    asked = next(i for i in range(1000, 2000) if lm_scoring.fold_of(i) == 2)
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame([(i, t.decode()) for i, t in [*train, (asked, b"zz b unknown a")]], "doc_id long, text string")).collect()}
    ws = ["start", b"zz", b"b", b"unknown", b"a", None]
    assert got[asked] == pytest.approx(sum(math.log10(p(c, w)) for c, w in zip(ws, ws[1:], strict=False)), abs=1e-9)


def test_mixture_weights_prefer_the_better_estimate():
    cells = np.array([(5 * lm_scoring.BINS + 3) * lm_scoring.BINS + 20])
    w = lm_scoring.weights(cells, np.array([1000]), np.array([0.5]), np.array([0.001]), 1e-4)
    assert w[5, 0] > 0.9
    assert np.allclose(w.sum(axis=1), 1)
