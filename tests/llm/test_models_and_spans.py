"""Language, quality model, personal data and mixing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import TEXTS, docs, empty, rows
from pyspark.sql import functions as F

from barloom.llm import language, mixing, personal_data, quality_model

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_of_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in language.identify(d).collect()}
    truth = {r.doc_id: r.lang for r in d.collect()}
    assert all(r.held_out == held(i) for i, r in found.items())
    own = [i for i in found if held(i)]
    assert sum(found[i].lang_pred == truth[i] for i in own) >= 0.98 * len(own)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_awkward_rows(spark):
    found = language.identify(docs(spark)).collect()
    assert len(found) == len(rows())
    letters = {t: bool(re.search(r"[^\W\d_]", t or "")) for t in TEXTS}
    for r in found:
        if r.doc_id is not None:
            assert r.lang_pred == ("en" if letters[TEXTS[r.doc_id]] else "und")
    assert language.identify(empty(spark)).count() == 0
    nothing = language.identify(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_quality_of_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality_model.score_quality(d, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [i for i in truth if held(i)]
    assert sum(found[i].predicted == truth[i] for i in own) >= 0.95 * len(own)
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == held(i) for i, r in found.items())


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    assert quality_model.score_quality(docs(spark), labels).count() == len(rows())
    none = quality_model.score_quality(docs(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.score_quality(empty(spark), labels).count() == 0


# -- personal data ------------------------------------------------------------
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 16 <= len(digits) <= 19 and personal_data.luhn(digits)) or (k == 3 and 8 <= len(digits) <= 15)
            if good:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B9", "@", ".", "..", "-", "+", "1", "25", "4111 1111 1111 1111", "255", "256", " ", "(", ")", "é", "\n", "+1 (555) 123-4567", "x@y.z", "1.2.3.4"]) for _ in range(rng.randint(0, 24)))
        assert personal_data.base_spans(t) == plain_spans(t), t
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    for t in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "@a" * 50_000):
        personal_data.base_spans(t)  # time in proportion to the length


def test_personal_data_of_awkward_rows(spark):
    found = personal_data.personal_digest(docs(spark)).collect()
    assert len(found) == len(rows())
    assert personal_data.personal_digest(empty(spark)).count() == 0


def bootstrapped():
    seeds = [f"Please call me at +1 (555) 010-{i:04d} today." for i in range(12)]
    unseen = ["Please call me at 555 010 7777 today.", "Call me at 555-010-8888!", "The part number 555 010 9999 is blue."]
    return seeds + unseen + ["mail x@y.org", None, "part number 12 then part number 13"]


def test_contexts_find_unseen_identifiers(spark):
    d = docs(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(bootstrapped())])
    found = {r.doc_id: r for r in personal_data.personal_digest(d).collect()}
    assert found[12].spans == "phone:18:30" and found[13].spans == "phone:11:23" and found[14].spans == ""
    assert found[12].n_phone == 0 and found[0].n_phone == 1 and found[0].spans == "phone:18:35"
    red = {r.doc_id: r.text for r in personal_data.redact(d).collect()}
    assert red[0] == "Please call me at <PHONE> today." and red[12] == "Please call me at <PHONE> today." and red[15] == "mail <EMAIL>" and red[16] is None
    assert red[14] == bootstrapped()[14]


# -- mixing -------------------------------------------------------------------
def fill(sizes, weights):
    """Targets by repeated sharing, as plainly as can be."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left, sum_w = total - sum(out.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / sum_w >= 3 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / sum_w for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= set(over)
    return out


def mixed(spark, n, seed):
    rng = random.Random(seed)
    data = [(rng.choice([None, *range(n)]), rng.choice([None, "", "w " * rng.randint(1, 900)]), None, rng.choice([None, "a", "é", "B", "zz", *(["hot"] * 6)]), None, None, None) for _ in range(n)]
    return docs(spark, data + data[: n // 4]), data + data[: n // 4]


@pytest.mark.parametrize("n", [6, 120])
def test_mix_meets_its_targets(spark, n):
    d, data = mixed(spark, n, n)
    found = mixing.mixed_sizes(d).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len((r[1] or "").split())) for r in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in data:
        sizes[r[3]] += len((r[1] or "").split())
    want = fill(sizes, (1, 2, 3))
    m = mixing.mix(d)
    targets = {r.source: (r.source_no, r.target) for r in m.sources.collect()}
    assert {s: t for s, (_, t) in targets.items()} == pytest.approx(want)
    for r in m.taken().collect():
        taken[r.source_no] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for s, (no, target) in targets.items():
        assert abs(taken[no] - target) <= 1, s
    slots = m.slots.collect()
    assert len({r.slot for r in slots}) == len(slots)
    assert sum(r["take"] for r in slots) == sum(taken.values())
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mixed_sizes(d).collect()))


def test_schedule_interleaves(spark):
    d = docs(spark, [(i, "w " * 500, None, "ab"[i % 2], None, None, None) for i in range(200)])
    m = mixing.mix(d, weights=(1, 1))
    order = [r.source_no for r in sorted(m.slots.collect())]
    half = len(order) // 2
    assert abs(order[:half].count(1) - order[:half].count(2)) <= 4


def test_mixed_documents(spark):
    d, data = mixed(spark, 60, 9)
    m = mixing.mixed_documents(d)
    assert m.columns == d.columns
    times = Counter(tuple(r) for r in m.collect())
    there = Counter(data)
    assert times and all(n <= 3 * there[r] for r, n in times.items())
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_sizes(empty(spark)).count() == 0


@pytest.mark.parametrize("docs_of_large", [200, 2000])
def test_short_sources_beside_a_large_one_meet_their_quotas(spark, docs_of_large):
    small = [("a", 60), ("b", 30), ("c", 1), ("y", 257), ("z", 2)]
    data = [(i, "w " * n, None, s, None, None, None) for i, (s, n) in enumerate(small)]
    data += [(100 + i, "w " * 500, None, "large", None, None, None) for i in range(docs_of_large)]
    d = docs(spark, data)
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(d).collect()}
    assert [taken[i] for i in range(len(small))] == [3 * n for _, n in small]
    assert sum(taken.values()) == 500 * docs_of_large + sum(n for _, n in small)
    times = Counter(r.doc_id for r in mixing.mixed_documents(d).where("doc_id < 100").collect())
    assert times == dict.fromkeys(range(len(small)), 3)
    slots = [r.slot for r in mixing.mix(d).slots.collect()]
    assert len(set(slots)) == len(slots)


def test_slots_that_the_sequence_lacks_follow_it(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 0)  # all points fall to the first source
    d, data = mixed(spark, 40, 5)
    m = mixing.mix(d)
    quotas = {r.source_no: r.quota for r in m.sources.collect() if r.quota}
    slots = m.slots.collect()
    taken = Counter()
    for r in slots:
        taken[r.source_no] += r["take"]
    assert taken == quotas and len({r.slot for r in slots}) == len(slots)
