"""Learned and iterated results against plain loops."""

import random
import unicodedata
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from fixtures import docs

from barloom.llm import entries, language, metric_tree, personal_data, quality_model

COLUMNS = (None, None, None, None, None)


# -- language -------------------------------------------------------------------
def test_letters_are_those_of_unicode():
    for c in map(chr, range(0x30000)):
        if not 0xD800 <= ord(c) < 0xE000:
            assert language.has_letter(f"1{c}_") == unicodedata.category(c).startswith("L"), hex(ord(c))


def test_texts_without_letters_are_undetermined(spark):
    data = [(i, t, "en", None, None, None, None) for i, t in enumerate(["some words", "²", "½ 12", "٣", "_", "a", "ª"])] + [(20 + i, f"plain words {i}", "en", None, None, None, None) for i in range(9)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, data)).collect()}
    assert [got[i][0] for i in range(7)] == ["en", "und", "und", "und", "und", "en", "en"]
    assert got[1][1] == 0.0


def test_duels_are_plain_votes():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 5):
        pairs = list(combinations(range(k), 2))
        duels = language.Duels([f"c{i}" for i in range(k)], rng.normal(size=(len(pairs), 9)).astype(np.float32))
        x = rng.normal(size=(50, 8)).astype(np.float32)
        won, score = duels.decide(x)
        for row, got, s in zip(x, won, score, strict=True):
            margins = defaultdict(list)
            for (a, b), w in zip(pairs, duels.weights, strict=True):
                z = float(row @ w[:-1] + w[-1])
                margins[a].append(z)
                margins[b].append(-z)
            best = max(range(k), key=lambda c: (sum(m > 0 for m in margins[c]), sum(margins[c])))
            assert got == best
            least = min(margins[best], default=10)
            assert s == pytest.approx(1 / (1 + np.exp(-3 * min(10, max(-10, least)))), rel=1e-4)


def test_repeated_rows_do_not_outgrow_the_sample(spark):
    text = "words of one language here"
    learned = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    one = next(i for i in range(100, 200) if learned(i))
    data = [(one, text, "en", None, None, None, None)] * 500 + [(i, f"andere woorden {i}", "nl", None, None, None, None) for i in range(8, 40)]
    d = docs(spark, data)
    model = language.train(d, "doc_id", "text", "lang", language.FAMILIES, 8000)
    assert {c for f in model.within for c in f.classes} == {"en", "nl"}
    labels = spark.createDataFrame([(one, 1)] * 300 + [(i, 0) for i in range(8, 40)], "doc_id long, quality int")
    trees = quality_model.train(d, labels)
    assert trees.start == pytest.approx(np.log(1 / sum(map(learned, range(8, 40)))))  # one row with label 1


# -- quality --------------------------------------------------------------------
def test_flat_trees_are_plain_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality_model.grow(x, y)
    for row, got in zip(x[:80], model.score(x[:80]), strict=True):
        z = model.start
        for feature, at, value in zip(model.feature, model.at, model.value, strict=True):
            node = 0
            while node < len(feature):
                j = feature[node]
                b = sum(row[j] > c for c in model.cuts[j])
                node = 2 * node + (2 if b > at[node] else 1)
            z += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-z)))
    assert (model.score(x).round() == y).mean() > 0.95


# -- personal data --------------------------------------------------------------
def plain_bootstrap(edges, trust, support, rounds):
    """edges: (kind, pattern, value, seed). The formulas of the module, in dictionaries."""
    seeds = defaultdict(int)
    for kind, pattern, value, seed in edges:
        seeds[kind, pattern, value] = max(seed, seeds[kind, pattern, value])
    open_ = {(k, p) for (k, p, _), s in seeds.items() if not s}
    graph = {e: s for e, s in seeds.items() if e[:2] in open_}
    values, patterns, before = {}, {}, None
    for _ in range(rounds):
        own = defaultdict(list)
        for (k, p, v), s in graph.items():
            own[k, p].append(1.0 if s else values.get((k, v), 0.0))
        patterns = {}
        for name, sure in own.items():
            conf = sum(sure) / (sum(sure) + personal_data.UNKNOWN * sum(x == 0 for x in sure) + 1)
            if conf >= trust and sum(x > 0 for x in sure) >= support:
                patterns[name] = conf
        doubt = defaultdict(lambda: 1.0)
        for (k, p, v), s in graph.items():
            if not s and (k, p) in patterns:
                doubt[k, v] *= 1 - patterns[k, p]
        values = {kv: 1 - d for kv, d in doubt.items() if 1 - d >= trust}
        if (patterns, values) == before:
            break
        before = (patterns, values)
    return patterns, values


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_scores_are_the_formulas(spark, seed):
    rng = random.Random(seed)
    scanned, edges = [], []
    for i in range(220):
        columns = [[], []]
        for _ in range(rng.randint(0, 3)):
            known, kind = rng.random() < 0.6, rng.randint(0, 1)
            p = int(rng.triangular(0, 14, 2))
            value = f"v{p // 2}-{rng.randint(0, 12)}" if rng.random() < 0.8 else f"v{rng.randint(0, 60)}"
            patterns = [f"p{p}", f"q{p // 3}"]
            columns[not known].append({"kind": kind, "start": 0, "end": 1, "value": value, "patterns": patterns})
            edges += [(kind, q, value, int(known)) for q in patterns]
        scanned.append((i, *columns))
    kind = personal_data.T.ArrayType(personal_data._FOUND)
    schema = personal_data.T.StructType([personal_data.T.StructField("i", personal_data.T.IntegerType()), personal_data.T.StructField("seeds", kind), personal_data.T.StructField("maybe", kind)])
    patterns, values = personal_data.bootstrap(spark.createDataFrame([tuple(r) for r in scanned], schema), 0.8, 3, 20)
    want = plain_bootstrap(edges, 0.8, 3, 20)
    assert {(r.kind, r.pattern): r.confidence for r in patterns.collect()} == pytest.approx(want[0])
    assert {(r.kind, r.value): r.confidence for r in values.collect()} == pytest.approx(want[1])
    assert want[0] and want[1]


def test_what_is_found_induces_patterns(spark):
    """Values found after "call me at" stand after "my handy number", too; a new one stands only there."""
    texts = [f"Please call me at +1 (555) 010-{i:04d} today." for i in range(40)]
    learned = [f"Please call me at 555 010 {7000 + i} today." for i in range(8)]
    again = [f"You know, my handy number 555 010 {7000 + i} works." for i in range(8)]
    new = ["Take my handy number 555 010 9999 please."]
    other = ["The serial code 555 010 1111 is blue.", "Of 555 010 7000 and others."]
    data = [(i, t, *COLUMNS) for i, t in enumerate(texts + learned + again + new + other)]
    found = {r.doc_id: (r.n_phone, r.spans) for r in personal_data.personal_digest(docs(spark, data)).collect()}
    at = lambda t: (0, f"phone:{t.index('555')}:{t.index('555') + 12}")
    for i, t in enumerate(learned + again + new):
        assert found[40 + i] == at(t), t
    assert found[57] == (0, "") and found[58] == at(other[1])  # a known value counts wherever it stands


# -- nearest vectors ------------------------------------------------------------
def clustered(n, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 40
    return np.floor(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width))).astype(np.int64)


def test_bounds_save_distances():
    x = clustered(2000)
    space = metric_tree.Space(8, float((x * x).sum(1).max()))
    tree = metric_tree.Subtree(space, space.lift(x[:1])[0], x, [np.array([i]) for i in range(2000)], [np.ones(1, np.int64)] * 2000)
    q = x[:100]
    best, ids, _ = tree.search(space, q, np.arange(100), 5, np.full(100, np.iinfo(np.int64).min))
    scores = q @ x.T
    scores[np.arange(100), np.arange(100)] = np.iinfo(np.int64).min
    assert (best == np.sort(scores, axis=1)[:, ::-1][:, :5]).all()
    assert tree.computed < 0.5 * 100 * 2000


def test_inner_products_are_exact_for_any_size():
    rng = np.random.default_rng(4)
    for top in (10, 2**20, 2**40, 2**62):
        q, x = rng.integers(-top, top, (5, 7)), rng.integers(-top, top, (9, 7))
        want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, s, strict=True)))) for s in x] for r in q]
        assert metric_tree.inner(q, x).tolist() == want


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_repeated_candidates_count_as_in_sql(spark, monkeypatch, scale):
    """Rows equal in id and vector, components up to 1e7, several levels: Spark and SQL agree."""
    monkeypatch.setattr(metric_tree, "SUBTREE_ROWS", 60)
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(12, 6)) * scale)[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * scale / 50
    if scale > 1:
        v = np.round(v / 2**18) * 2**18  # so that SQL's floating-point sums are exact
    data = [(i + 1, row.astype(np.float32).tolist()) for i, row in enumerate(v)]
    data += [data[4]] * 25 + [data[6]] * 2 + [data[300]] * 3  # ids 5, 7 and 301 are no queries
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, metric_tree.top_k(df, copies=True).collect()))
    embeddings = df.toPandas()  # noqa: F841 - read by the query
    assert got == sorted(duckdb.sql(entries.OP3_SQL).fetchall())
