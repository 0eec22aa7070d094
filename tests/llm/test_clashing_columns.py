"""Stages that return whole rows leave further columns alone, whatever their names."""

from collections import Counter

import pytest
from pyspark.sql import types as T

from barloom.llm import mixing, near_duplicates, personal_data, quality_rules

NAMES = ["added", "_key", "key", "_h", "_id", "_hash", "hash", "_row", "row", "row_key", "_copies", "copies", "_same", "same", "_n", "Added_2", "root", "Root_2", "id", "size", "nth", "times", "share", "gone_id"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.LongType() if i % 2 else T.StringType()) for i, n in enumerate(NAMES)]])


def table(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(70))
    texts = [*(words(k) for k in range(8)), words(0), words(0), words(1) + " more", "call me at +1 555 010 1234 " + words(20), None, ""]
    data = [(i if i < 9 else None if i < 11 else 5, t, "en", "ab"[i % 2], None, *(1000 * i + j if j % 2 else (None if j % 4 else f"v{i}-{j}") for j in range(len(NAMES)))) for i, t in enumerate(texts)]
    twins = [(*data[3][:5], *(None for _ in NAMES)), data[3], data[3]]  # equal in id, source and text, not elsewhere
    return spark.createDataFrame(data + twins, SCHEMA), data + twins


def rest(r):
    return (r[0], *r[5:])


@pytest.mark.parametrize("stage", [quality_rules.keep_good, near_duplicates.keep_one, personal_data.redact, mixing.mixed_documents])
def test_further_columns_come_back_unchanged(spark, stage):
    d, data = table(spark)
    first = [tuple(r) for r in stage(d).collect()]
    again = [tuple(r) for r in stage(table(spark)[0].repartition(3)).collect()]
    assert stage(d).columns == d.columns and [f.dataType for f in stage(d).schema] == [f.dataType for f in d.schema]
    assert {rest(r) for r in first} <= {rest(r) for r in data} and first
    assert Counter(first) == Counter(again)


def test_equal_rows_share_their_copies(spark):
    d, data = table(spark)
    m = mixing.mix(d)
    taken = Counter()
    for r in m.taken().collect():
        if r.size:
            taken[r.doc_id, r.size] += (2 * r.taken + r.size) // (2 * r.size)
    got = Counter(r[0] for r in mixing.mixed_documents(d).collect())
    assert sum(got.values()) == pytest.approx(sum(taken.values()), abs=4)
    twins = Counter(tuple(r) for r in mixing.mixed_documents(d).where("doc_id = 3").collect())
    alike = Counter(r for r in data if r[0] == 3)
    shares = [n / alike[r] for r, n in twins.items()]
    assert max(shares) - min(shares) <= 1


def test_one_of_rows_with_one_id_stays_whole(spark):
    d, data = table(spark)
    kept = [tuple(r) for r in near_duplicates.keep_one(d).collect()]
    assert sum(r[0] == 3 for r in kept) == 1 and all(r in data for r in kept)
