"""The pipeline's stages against brute-force versions, and awkward tables through all of them."""

import random
import re
from collections import Counter

import pytest
from fixtures import docs, empty, rows
from test_models_and_spans import plain_spans
from test_near_and_nearest import plain_set
from test_text_rows import brute_rules

import corpus_pipeline as cp
from barloom.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returns over the smallest table."""
    path, d, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(d)
    for name, f in cp.STAGES:
        f(spark, d, SF).write.parquet(f"{path}/{name}")
        d = spark.read.parquet(f"{path}/{name}")
        out.append(d)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "piece_codec"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_stage(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[:2])
    for i, t in before.items():
        s = brute_rules(t)
        p = quality_rules.Page(t or "")
        bad = s[0] < 50 or 2 * s[4] > s[0] or any(r.rejects(p) for r in quality_rules.RULES)
        assert (i in after) == (not bad)


def test_near_duplicate_stage(stages):
    before, after = ({r.doc_id: plain_set(r.text) for r in d.collect()} for d in stages[1:3])
    up = {i: i for i in before}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    names = sorted(before)
    for k, i in enumerate(names):
        for j in names[:k]:
            a, b = before[i], before[j]
            if 100 * len(a & b) >= cp.SIMILAR * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert set(after) == {i for i in names if root(i) == i}


def test_personal_data_stage(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[2:4])
    assert set(before) == set(after)
    for i, r in before.items():
        text = r.text
        assert not plain_spans(after[i].text)
        assert bool(plain_spans(text)) <= (after[i].text != text)
        assert re.sub(r"<(EMAIL|IP|CARD|PHONE)>", "", after[i].text) == text or plain_spans(text)
        assert after[i].n_chars == len(after[i].text)


def test_mixing_stage(stages):
    before, after = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(r.text.split())
    want = {r.source: r.target for r in mixing.mix(stages[3]).sources.collect()}
    longest = max(len(r.text.split()) for r in before)
    assert all(n <= 3 for n in after.values())
    for s, target in want.items():
        taken = sum(len(r.text.encode().split()) * after[r.doc_id] for r in before if r.source == s)
        assert abs(taken - target) <= longest


def test_encoding_stage(stages):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, str(ids := lib.encode(r.text)), len(ids), lib.decode(ids)) for r in stages[4].collect())
    assert Counter((r.doc_id, str(r.ids), r.n_tokens, r.decoded) for r in stages[5].collect()) == want


def awkward(spark):
    rng = random.Random(2)
    good = [" ".join(f"word{rng.randint(0, 5000)}" for _ in range(80)) for _ in range(12)]
    data = rows() + [(100 + i, t, "en", None if i % 3 else f"s{i}", 5, None, None) for i, t in enumerate(good)]
    data += [data[-1], data[-1], (None, good[0], None, None, None, None, None), (100, good[1] + " more", None, "x", None, None, None)]
    return docs(spark, data)


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_tables(spark, tmp_path, make):
    d = make(spark)
    for name, f in cp.STAGES:
        f(spark, d, SF).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates" and make is awkward:
            ids = Counter(r.doc_id for r in d.collect())
            assert ids[111] == 1
    assert d.columns == ["doc_id", "ids", "n_tokens", "decoded"]
