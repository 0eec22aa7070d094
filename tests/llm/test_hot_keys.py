"""Groups that hold much of a table: the ways for them give the same results as the ordinary ones."""

import random
from collections import Counter, defaultdict

import pytest
from fixtures import docs, rows
from pyspark.sql import functions as F
from test_near_and_nearest import brute, found, near_rows
from test_repeated_passages import brute as brute_passages
from test_repeated_passages import planted

from barloom.llm import mixing, near_duplicates, repeated_passages, token_counts

P = pytest.importorskip("public_tokenizers")


def as_rows(texts, ids=None):
    return [(i if ids is None else ids[i], t, None, "s", None, None, None) for i, t in enumerate(texts)]


# -- near-duplicates ------------------------------------------------------------
@pytest.mark.parametrize("seed, groups, members, edits", [(3, 40, 6, 4), (4, 2, 120, 3), (5, 3, 60, 14)])
def test_hot_keys_and_leaders_lose_no_link(spark, monkeypatch, seed, groups, members, edits):
    monkeypatch.setattr(near_duplicates, "SAMPLE", 1)
    monkeypatch.setattr(near_duplicates, "HOT", 5)
    monkeypatch.setattr(near_duplicates, "BLOCK", 10)
    data = near_rows(seed, groups, members, edits) + rows()
    assert found(near_duplicates.near_duplicates(docs(spark, data))) == brute(data)


def test_a_chain_that_its_leader_does_not_take(spark, monkeypatch):
    """Each text is near the one before it only, so blocks must find all but the first link."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 6)
    w = [f"w{i}" for i in range(200)]
    data = []
    for k in range(40):
        w = w[5:] + [f"n{k}x{i}" for i in range(5)]
        data.append((k, " ".join(w), None, None, None, None, None))
    assert found(near_duplicates.near_duplicates(docs(spark, data))) == brute(data)


# -- passages -------------------------------------------------------------------
@pytest.mark.parametrize("most", [2, 6])
def test_large_groups_of_passages_are_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(repeated_passages, "GROUP_ROWS", most)
    monkeypatch.setattr(repeated_passages, "SAMPLE", 1)
    monkeypatch.setattr(repeated_passages, "CHUNK_ROWS", 50)
    data = [(i, *r[1:]) for i, r in enumerate(planted(most, 90) + rows()[:-2])]
    got = defaultdict(list)
    for r in repeated_passages.repeated_passages(docs(spark, data)).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
        assert r.mate_id is not None and r.mate_id != r.doc_id
    assert {k: sorted(v) for k, v in got.items()} == brute_passages(data)


def test_repeated_rows_of_one_id_are_copies(spark):
    data = planted(7, 20)
    data = data[:10] + [data[0]] * 5 + [(None, *data[1][1:])] * 3
    spans = Counter((r.doc_id, r.start_word, r.end_word) for r in repeated_passages.repeated_passages(docs(spark, data)).collect())
    n = len(data[0][1].split())
    assert spans[0, 0, n] == (6 if n >= 50 else 0)


# -- token counts ---------------------------------------------------------------
def test_a_long_pre_token_in_every_text(spark):
    """A rule of 80 dashes and a run of 90 blanks: settled by the dictionary, dealt nowhere."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = [f"{'-' * 80}\nword{rng.randint(0, 9)}{' ' * 90}end {i}" for i in range(60)] + [None, "", "-" * 80]
    d = docs(spark, as_rows(texts))
    known = token_counts.common_pieces(d, "text", P.path("byte_bpe_50k.json"), 1000, 1000)
    assert known[token_counts.entry("-" * 80)] == len(lib.encode("-" * 80, add_special_tokens=False))
    assert token_counts.entry(" " * 89) in known
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


# -- mixing ---------------------------------------------------------------------
def test_points_at_high_slots(spark):
    slots = [0, 1, 3_474_701_532, 3_474_701_533, 2**32 - 1, 2**32, 2**32 + 1, 6 * 10**10, 2**50 + 12345]
    got = [r.p for r in spark.createDataFrame([(s,) for s in slots], "s long").select(mixing.point(F.col("s")).alias("p")).collect()]
    assert got == [s * mixing.STEP % 2**32 for s in slots]


@pytest.mark.parametrize("copies, few", [(3, 10_000), (4096, 1)])
def test_equal_rows_and_many_sources(spark, monkeypatch, copies, few):
    """Null ids in bulk, copies written out by several tasks, sources ordered by ranges: the same targets and quotas."""
    rng = random.Random(copies)
    data = [(None, "w " * 7, None, "hot", None, None, None)] * 40 + [(i, "w " * rng.randint(0, 300), None, rng.choice([None, "a", "b", "c", "d"]), None, None, None) for i in range(60)]
    d = docs(spark, data)
    plain = Counter(map(tuple, mixing.mixed_sizes(d).collect()))
    monkeypatch.setattr(mixing, "COPIES", copies)
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    assert Counter(map(tuple, mixing.mixed_sizes(d).collect())) == plain
    assert sum(r.doc_id is None for r in mixing.mixed_documents(d).collect()) > 0
