"""Near-duplicates and nearest vectors against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import docs, empty, rows

from barloom.llm import metric_tree, near_duplicates
from barloom.llm.components import components


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(data):
    """(id, size) -> component's smallest id, by comparing everything."""
    sets = [plain_set(r[1]) for r in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return Counter((r[0], len(s), (c := least.get(root(i)) if s else r[0]), r[0] == c) for i, (r, s) in enumerate(zip(data, sets, strict=True)))


def near_rows(seed, groups, members, edits):
    rng = random.Random(seed)
    data = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, members)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"N{rng.randint(0, 9999)}"
            data.append((len(data), " ".join(w), None, None, None, None, None))
    rng.shuffle(data)
    return data


def found(df):
    return Counter(tuple(r)[:4] for r in df.collect())


@pytest.mark.parametrize("seed, groups, members, edits", [(1, 60, 6, 4), (2, 2, 150, 3)])
def test_near_duplicates_are_all_links(spark, monkeypatch, seed, groups, members, edits):
    monkeypatch.setattr(near_duplicates, "BLOCK", 40)  # several blocks a key
    data = near_rows(seed, groups, members, edits) + rows()
    assert found(near_duplicates.near_duplicates(docs(spark, data))) == brute(data)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0
    kept = near_duplicates.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns


def test_one_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(7, a), (7, b), (7, a), (None, c), (None, c), (8, a + " more"), (None, b), (9, ""), (9, ""), (None, None)]
    left = near_duplicates.keep_one(docs(spark, [(i, t, None, None, None, None, None) for i, t in data]))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(7, a), (7, b), (None, c), (9, ""), (9, ""), (None, None)])


def test_components_are_smallest_nodes(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_confirm_by_postings_and_by_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, 50).astype(np.uint64)) for _ in range(30)]
    joined = near_duplicates.confirm(sets, 70)
    forest = near_duplicates.Forest(30)
    for i in range(30):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                forest.join(j, i)
    again = near_duplicates.Forest(30)
    for a, b in joined:
        again.join(a, b)
    assert [forest.root(i) for i in range(30)] == [again.root(i) for i in range(30)]


# -- nearest vectors ------------------------------------------------------------
def plain_top(data, k, every):
    seen = {(i, tuple(int(np.floor(64.0 * x)) for x in v)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for q, a in seen:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in seen if i != q)
            for r, (s, i) in enumerate(scores[:k], 1):
                out[(q, r, i, -s)] += 1
    return out


@pytest.mark.parametrize("n, k", [(3, 20), (700, 5)])
def test_top_k_is_brute_force(spark, monkeypatch, n, k):
    monkeypatch.setattr(metric_tree, "SUBTREE_ROWS", 100)
    monkeypatch.setattr(metric_tree, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(n)
    data = [(i, (rng.normal(size=6) * rng.choice([0.1, 3])).astype(np.float32).tolist()) for i in range(n)]
    data += [(n + i, data[0][1]) for i in range(60)] + [(n + 70 + i, data[1][1][:3]) for i in range(3)]
    data += [(None, [1.0] * 6), (5000, None), (5020, [float("nan")] * 6), (5040, [None] * 6), (5060, [float("inf")] * 6), (5080, []), data[2], data[2], (5100, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in data], "vec_id long, embedding array<float>, label int, score string")
    assert Counter(map(tuple, metric_tree.top_k(df, k=k).collect())) == plain_top(data, k, 20)
    assert metric_tree.top_k(df.limit(0)).count() == 0
