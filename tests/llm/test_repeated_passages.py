"""Repeated passages against every window of 50 words."""

import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import docs, empty, rows

from barloom.llm import repeated_passages as rp


def brute(data, least=50):
    """Row -> united intervals of windows that stand in another row, too."""
    where = defaultdict(set)
    words = [(r[1] or "").encode().split() for r in data]
    for i, w in enumerate(words):
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in enumerate(words):
        spans = []
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + least
                else:
                    spans.append([k, k + least])
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out


def planted(seed, n=120):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 900)}"
    passages = [[word() for _ in range(rng.choice([30, 49, 50, 51, 60, 120]))] for _ in range(8)]
    data = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            at = rng.randint(0, len(w))
            w[at:at] = p[: rng.randint(20, len(p))] if rng.random() < 0.4 else p
        data.append((i, " ".join(w), None, None, None, None, None))
    data += [(n, " ".join(["is onhe."] * 200), None, None, None, None, None), (n + 1, " ".join(["is onhe."] * 90), None, None, None, None, None)]
    return data


@pytest.mark.parametrize("pairs", [192, 4])
def test_passages_are_all_windows(spark, monkeypatch, pairs):
    monkeypatch.setattr(rp, "ALL_PAIRS", pairs)
    data = planted(pairs) + rows()[:-2]
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    got = defaultdict(list)
    for r in rp.repeated_passages(docs(spark, data)).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
        assert r.mate_id is not None and r.mate_id != r.doc_id
    assert {k: sorted(v) for k, v in got.items()} == brute(data)


def test_matches_without_all_pairs():
    rng = np.random.default_rng(1)
    owner, left, right = rng.integers(0, 40, 300), rng.integers(0, 2, (300, 25)).astype(np.uint32), rng.integers(0, 2, (300, 25)).astype(np.uint32)
    left[:, :20] = left[:1, :20] ^ (rng.random((300, 1)) < 0.3)
    right[:, :20] = right[:1, :20] ^ (rng.random((300, 1)) < 0.3)
    back, ahead, mate = rp.match(owner, left, right, 50)
    for i in range(300):
        ends = [(a, b) for j in range(300) if owner[i] != owner[j] and (a := int(rp.common_prefix(left[i], left[j]))) + (b := int(rp.common_prefix(right[i], right[j]))) >= 25]
        assert (mate[i] >= 0) == bool(ends)
        if ends:
            assert (back[i], ahead[i]) == (max(a for a, _ in ends), 25 + max(b for _, b in ends))


def test_nulls_and_nothing(spark):
    assert rp.repeated_passages(docs(spark)).count() == 0
    assert rp.repeated_passages(empty(spark)).count() == 0
