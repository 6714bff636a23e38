"""Operators 3, 4, 7 and 8 against brute force and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cellarium.llm import ann, brown, quality, shingles, simhash
from cellarium.llm.components import components
from cellarium.llm.simhash import fingerprint

DOCS = "doc_id long, text string, fp string, node string, word string"
ODD = [None, "", " \t ", "one two", "One TWO", "É é ß", "x" * 20000, "a b c d e f"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in zip(ids, texts, strict=True)], DOCS)


def test_fingerprint():
    for t in [*ODD, "the cat sat on the mat the cat sat on the mat again"]:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if x]
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    of = {n: n for n in nodes}
    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(rng.randint(1, 6)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = [tuple(r) for r in simhash.links(table).collect()]
    assert all(a < b for a, b in got) and roots(signed, got) == roots(signed, near) and len(near) > 100
    # the join alone finds every pair, whatever the distance
    for within in (0, 2, 4, 7):
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= within}
        rows = simhash.range_join(simhash.grid(table, within, True), simhash.grid(table, within, False), within).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_a_large_group_of_near_copies_gives_few_links(spark):
    rng = random.Random(4)
    one = rng.getrandbits(62)
    fps = list({one ^ 1 << a ^ 1 << b for a in range(62) for b in range(a)})[:900] + [rng.getrandbits(62) for _ in range(100)]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    of = roots(fps, got)
    assert len({of[f] for f in fps[:900]}) == 1 and len(got) < 3000  # of 404,550 pairs


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(300, 360)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(5, 5), (7, 3), (3, 7)]
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in roots(linked, pairs).items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_meet_by_broadcast_and_the_rest_by_shuffle(spark):
    """A star of a third of all links beside chains: some keys are heavy, most are not."""
    pairs = [(7, i) for i in range(10_000, 13_000)] + [(20_000 + i, 20_001 + i) for i in range(0, 6_000) if i % 5]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots({n for p in pairs for n in p}, pairs)


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(12)]
    texts = ODD + base + [base[0]] * 5 + [b.replace("a", "A") for b in base] + [b + " z" for b in base]
    ids = [*range(len(texts) - 1), None]
    got = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    fps = [fingerprint(t) for t in texts]
    keys = sorted(set(fps))
    of = roots(keys, [(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    want = Counter((i, f, least.get(of[f])) for i, f in zip(ids, fps, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_shingle_groups_are_those_of_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=40)
    base = [rng.choices(vocab, k=rng.randint(30, 300)) for _ in range(25)]
    change = lambda t, share: [rng.choice(vocab) if rng.random() < share else x for x in t]
    texts = [" ".join(t) for b in base for t in (b, b, change(b, 0.005), change(b, 0.01), change(b, 0.02), change(b, 0.03), change(b, 0.05))]
    texts += [" ".join(rng.choices(vocab, k=60) + passage) for _ in range(30)] + [" ".join(change(base[0], 0.01)) for _ in range(60)] + [None, "", "a b", "A  B", "a b c d e", "a b c d e f"]
    table = docs(spark, texts)
    got = {r.doc_id: r.root for r in shingles.similar(table).collect()}
    assert len(got) == len(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    of = roots(range(len(texts)), pairs)
    groups = lambda m: Counter(frozenset(i for i in m if m[i] == r) for r in set(m.values()))
    assert groups(got) == groups(of)
    fps = [fingerprint(t) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 4 for i, j in pairs) > 50  # what a radius of 4 bits misses
    assert shingles.similar(table.limit(0)).count() == 0


def test_near_dedup_compares_the_candidates_of_fingerprints_first(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocab, k=150) for _ in range(12)]
    change = lambda t, share: [rng.choice(vocab) if rng.random() < share else x for x in t]
    table = docs(spark, [" ".join(t) for b in base for t in (b, b, [*b, "z"], change(b, 0.005), change(b, 0.02))] + [None, "", "a b"])
    groups = lambda rows: Counter(frozenset(r.doc_id for r in rows if r.root == k) for k in {r.root for r in rows})
    calls, verified, by_fingerprints = [], shingles.verified, shingles.by_fingerprints

    def spied(pairs, documents, sets, words, share):
        found = verified(pairs, documents, sets, words, share)
        calls.append(({(r.a, r.b) for r in pairs.collect()}, {r.node: r.fp % (1 << 64) for r in sets.collect()}, found.count()))
        return found

    monkeypatch.setattr(shingles, "verified", spied)
    whole = groups(shingles.similar(table).collect())
    pairs, fps, linked = calls[0]
    near = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4}
    assert len(pairs) > 10 and pairs <= near and linked > 10
    assert roots(fps, pairs) == roots(fps, near)
    # what the fingerprints miss is found by prefixes
    monkeypatch.setattr(shingles, "by_fingerprints", lambda sets: by_fingerprints(sets).limit(0))
    assert groups(shingles.similar(table).collect()) == whole


def test_edits_of_one_text_are_compared_with_it_and_not_with_each_other(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    edits = [[f"e{k}-{i}" if i in at else w for i, w in enumerate(base)] for k in range(200) for at in [rng.sample(range(10, 140), 3)]]
    rows, verified = [], shingles.verified

    def spied(pairs, *more):
        rows.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(shingles, "verified", spied)
    got = shingles.similar(docs(spark, [" ".join(t) for t in (base, *edits)])).collect()
    assert len({r.root for r in got}) == 1 and len(got) == 201
    assert sum(rows) < 10 * 201, rows  # of 20,100 pairs


def test_pairs_left_at_last_lose_no_link(spark, monkeypatch):
    """With no centres nor fingerprints all is left to the prefixes' common elements; sets of all sizes, at and around the bound."""
    rng = random.Random(6)
    monkeypatch.setattr(shingles, "CENTRES", 0)
    by_fingerprints = shingles.by_fingerprints
    monkeypatch.setattr(shingles, "by_fingerprints", lambda sets: by_fingerprints(sets).limit(0))
    texts = []
    for k, size in enumerate([5, 6, 8, 9, 12, 14, 20, 31, 49, 50, 80, 140]):
        base = [f"w{k}-{i}" for i in range(size)]
        texts += [base, *[base + [f"z{k}-{i}" for i in range(n)] for n in range(1, 1 + size // 3)], *[base[n:] for n in range(1, size // 4)]]
        texts += [[f"e{k}-{n}-{i}" if i in at else w for i, w in enumerate(base)] for n in range(12) for at in [rng.sample(range(size), min(size, 1 + n % 3))]]
    texts = [" ".join(t) for t in texts]
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    of, got = roots(range(len(texts)), pairs), {r.doc_id: r.root for r in shingles.similar(docs(spark, texts)).collect()}
    groups = lambda m: Counter(frozenset(i for i in m if m[i] == r) for r in set(m.values()))
    assert groups(got) == groups(of)


def test_the_sample_of_texts_goes_through_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLE", 100)
    table = docs(spark, [f"text {i % 1500}" for i in range(2000)] + [None, None, ""])
    got = [r.text for r in shingles.sampled(table).collect()]
    assert 40 < len(got) < 160 and len(set(got)) == len(got)
    plan = shingles.sampled(table)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    assert {r.text for r in shingles.sampled(table.limit(90)).collect()} == {r.text for r in table.limit(90).collect()}
    assert shingles.sampled(table.limit(0)).count() == 0


def test_quality_learns_and_handles_edges(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["the", "of", "house", "reading", "over", "tree."], k=rng.randint(20, 60))) for _ in range(300)]
    bad = [" ".join(w + "$$$" for w in rng.choices(["the", "of", "house"], k=rng.randint(20, 60))) for _ in range(300)]
    texts = [t for p in zip(good, bad, strict=True) for t in p] + ODD
    marks = spark.createDataFrame([(i, 1 - i % 2, "x") for i in range(600)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.classify(docs(spark, texts), marks).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == 1 - i % 2 for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    for none in (marks.limit(0), marks.where("quality = 1")):
        assert all(r.predicted == 1 for r in quality.classify(docs(spark, texts[:20]), none).collect())
    assert quality.classify(docs(spark, []), marks).count() == 0


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(5)
    n = 12
    counts = np.zeros((n + 2, n + 2))
    for _ in range(4000):  # even words follow odd ones
        a = rng.integers(n)
        b = 2 * rng.integers(n // 2) + (1 - a % 2)
        counts[a, b] += 1
    own = brown.exchange(counts, 2)
    assert len({own[i] for i in range(0, n, 2)}) == 1 and len({own[i] for i in range(1, n, 2)}) == 1 and own[0] != own[1]


def test_brown_scores(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Le", "chat", "dort", "et", f"mot{i % 17}", f"rare{i}"], k=rng.randint(1, 40))) for i in range(150)] + ODD
    want_held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    toks = [[x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()] for t in texts]
    c = Counter(w for t, h in zip(toks, want_held, strict=True) if not h for w in [*t, None])
    total, v = sum(c.values()), len(c)
    table = docs(spark, texts)
    for common in (10_000, 20, 0):  # the split between the table and the join changes nothing
        got = {r.doc_id: r for r in brown.score(table, clustered=12, classes=3, common=common).collect()}
        for i, t in enumerate(toks):
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (want_held[i], len(t) + 1, sum(c[w] > 0 for w in [*t, None]), total)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in [*t, None]), abs=1e-9)
            assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
        if common == 10_000:
            first = {i: r.score for i, r in got.items()}
        else:
            assert {i: r.score for i, r in got.items()} == pytest.approx(first, abs=1e-9)
    assert sum(first.values()) > sum(r.base_score for r in got.values())
    # the same model in plain code, from the classes of the words
    held = [i for i, h in enumerate(want_held) if h]
    learnt = brown.learn(table.where(~table.doc_id.isin(held)), clustered=12, classes=3)
    kind = {w.decode(): x for w, (_, x) in learnt.clustered.items()} | {bytes(r.word).decode(): r.kind for r in learnt.rest.collect()}
    assert set(kind) == {w for w in c if w is not None} and set(kind.values()) == {0, 1, 2}  # every training word has a class
    once = {w for w, n in c.items() if n == 1 and w is not None}
    pairs = Counter()
    for t, h in zip(toks, want_held, strict=True):
        path = ["end", *t, "end"]
        for a, b in zip(path, path[1:]) if not h else ():
            for x in {kind.get(a, "end"), "unseen"} if a in once else {kind.get(a, "end")}:
                for y in {kind.get(b, "end"), "unseen"} if b in once else {kind.get(b, "end")}:
                    pairs[x, y] += 1
    kinds = [0, 1, 2, "end", "unseen"]
    n = sum(pairs.values())
    share = {y: (sum(pairs[x, y] for x in kinds) + 0.5) / (n + 2.5) for y in kinds}
    step = {(x, y): (pairs[x, y] + 20 * share[y]) / (sum(pairs[x, z] for z in kinds) + 20) for x in kinds for y in kinds}
    size = {x: sum(n for w, n in c.items() if w is not None and kind[w] == x) for x in (0, 1, 2)}
    def p(prev, w):
        x = "end" if prev is None else kind.get(prev, "unseen")
        if w is None:
            return step[x, "end"]
        return step[x, kind[w]] * c[w] / size[kind[w]] if w in kind else step[x, "unseen"] / (len(once) + 1)
    for i, t in enumerate(toks):
        assert first[i] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None, *t], [*t, None])), abs=1e-9)
    for prev in (None, "chat", "never seen"):
        assert sum(p(prev, w) for w in c) + p(prev, "never seen") * (len(once) + 1) == pytest.approx(1)
    assert brown.score(docs(spark, [])).count() == 0
    assert brown.score(docs(spark, ["a b"], [None])).collect()[0].n_known == 3
    only = brown.score(docs(spark, ["a b"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)])).collect()[0]
    assert (only.held_out, only.n_known, only.train_tokens) == (True, 0, 0) and only.score < 0
    assert brown.score(docs(spark, ["x" * 500 + " " + "y" * 90])).count() == 1


def test_other_words_join_the_class_of_words_in_like_places(spark):
    """Two planted classes that alternate: rare words, unseen by the exchange, take the class of their places."""
    rng = random.Random(3)
    texts = []
    for i in range(400):
        w = [rng.choice([f"a{rng.randint(0, 5)}", f"a{i}x"]) if j % 2 else rng.choice([f"b{rng.randint(0, 5)}", f"b{i}x"]) for j in range(10)]
        texts.append(" ".join(w))
    learnt = brown.learn(docs(spark, texts), clustered=12, classes=2)
    top = {w[:1]: x for w, (_, x) in learnt.clustered.items()}
    rest = learnt.rest.collect()
    assert len(rest) > 700 and top[b"a"] != top[b"b"]
    assert sum(r.kind == top[bytes(r.word)[:1]] for r in rest) / len(rest) > 0.95


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100] = x[101] = x[50]
    rows = [(i, v.tolist(), 3) for i, v in enumerate(x)]
    rows += [(900, None, 1), (950, [0.0] * 16, 1), (1000, [float("nan")] * 16, 1), (1050, [1.0] * 15 + [None], 1), (None, x[3].tolist(), 1), (1100, x[4].tolist(), 1)]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], n) for i, v, n in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = ann.nearest(table, every=50, k=5, shortlist=60).collect()
    ids, y = np.array([*range(900), 1100]), np.concatenate([x, x[4:5]]).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = total = 0
    for q in [*range(0, 900, 50), 1100]:
        s = y @ y[list(ids).index(q)]
        want = sorted((-round(v, 12), i) for v, i in zip(s, ids, strict=True) if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        hit += len({i for _, i in want} & {i for _, i, _ in mine})
        total += 5
        for _, i, v in mine:
            assert v == pytest.approx(float(s[list(ids).index(i)]), abs=1e-12)
    assert hit / total >= 0.95
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50][:2] == [100, 101]
    assert ann.nearest(table.limit(0)).count() == 0 and ann.nearest(table.where("vec_id in (0, 50)")).count() == 2


def test_a_third_of_rows_in_one_group(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 16))
    group = rng.permutation(6000)[:2000]
    x[group[:1000]] = x[group[0]]
    x[group[1000:]] = x[group[0]] + rng.normal(size=(1000, 16)) * 1e-4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.nearest(table, every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hit = total = 0
    for q in sorted(set(group.tolist()) & set(range(0, 6000, 50))):
        s = ann.exact(x[q], x)
        want = [i for i in np.lexsort((np.arange(6000), -s)).tolist() if i != q][:5]
        mine = [i for _, i in sorted(got[q])]
        if (x[q] == x[group[0]]).all():
            assert mine == want  # copies: the smallest ids
        hit, total = hit + len(set(mine) & set(want)), total + 5
    print("recall in the group", hit / total)
    assert hit / total >= 0.95


def recall(x, got, k=5):
    hit = total = 0
    for q, mine in got.items():
        s = ann.exact(x[q], x)
        want = [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:k]
        hit, total = hit + len(set(mine) & set(want)), total + k
    return hit / total


def test_recall_holds_as_the_table_grows_with_one_shortlist(spark):
    """Gaussian vectors, which have no neighbourhoods to speak of: the worst case for codes."""
    rng = np.random.default_rng(21)
    for n in (4000, 20000):
        x = rng.normal(size=(n, 64))
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        got = {}
        for r in ann.nearest(table, every=200, k=5, shortlist=128, sample=4096).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        found = recall(x, got)
        print("recall", n, found)
        assert len(got) == n // 200 and found >= 0.9


def test_magnitudes_and_lengths(spark):
    """Cosines of huge and tiny vectors, by exact fractions; vectors of another length are compared with each other."""
    x = {0: (1e200, 0.0), 1: (1e200, 1e199), 2: (0.0, 1.0), 3: (1e-200, 0.0), 4: (5e-324, 5e-324), 50: (1.0, 2.0, 3.0), 100: (3.0, 2.0, 1.0), 7: (), 8: (0.0, 0.0), 9: (float("inf"), 1.0)}
    table = spark.createDataFrame([(i, list(v)) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    first = sorted(got[0])
    assert [v for _, v, _ in first] == [3, 1, 4, 2]
    assert [s for *_, s in first] == pytest.approx([1, 1 / math.sqrt(1.01), math.sqrt(0.5), 0], abs=1e-12)
    assert got[50] == [(1, 100, pytest.approx(10 / 14))] and got[100] == [(1, 50, pytest.approx(10 / 14))] and set(got) == {0, 50, 100}


def test_copies_beyond_k_change_nothing(spark):
    """One vector on many rows, some of which repeat an id."""
    rows = [(i, [1.0, 2.0]) for i in range(0, 400)] + [(50, [1.0, 2.0])] * 9 + [(3, [1.0, 2.0])] * 2 + [(900, [2.0, 1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [v for _, v in sorted(got[0])] == [1, 2, 3, 3, 3] and [v for _, v in sorted(got[50])] == [0, 1, 2, 3, 3] and [v for _, v in sorted(got[900])] == [0, 1, 2, 3, 3]


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, list(map(float, rng.normal(size=8)))) for i in range(150)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, ann.nearest(rows, every=3, k=4).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, ann.nearest(rows, every=3, k=4).collect())) == one and len(one) == 200
