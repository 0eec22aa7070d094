"""Clean texts in any script stay; what is replaced is what was found."""

import pytest
from fixtures import docs

from barloom.llm import personal_data, quality_rules


@pytest.mark.parametrize("text, stays", [("Сегодня НАТО и EU говорили о погоде в городе", True), ("LOUD WORDS EVERYWHERE AND nothing", False), ("Some NATO words in plain prose here", True), ("12 34 AB 56 78 90 11 22 33 44", True)])
def test_acronyms_are_no_shouting(text, stays):
    rule = next(r for r in quality_rules.RULES if r.name == "shouting")
    assert rule.rejects(quality_rules.Page(text)) != stays


def test_redaction_replaces_the_spans(spark):
    texts = [f"Please call me at +1 (555) 010-{i:04d} today, or mail x{i}@y.org from 10.0.0.{i}." for i in range(12)] + ["Please call me at 555 010 7777 today.", None, "", "4111 1111 1111 1111"]
    d = docs(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)])
    spans = {r.doc_id: sorted((x.start, x.end, personal_data.KINDS[x.kind]) for x in [*r.base, *r.added]) for r in personal_data.personal_data(d).collect()}
    for r in personal_data.redact(d).collect():
        want, end = "", 0
        for a, b, kind in spans[r.doc_id]:
            if a >= end:
                want += texts[r.doc_id][end:a] + f"<{kind.upper()}>"
            end = max(end, b)
        assert (r.text or "") == want + (texts[r.doc_id] or "")[end:]
    assert len(spans[12]) == 1 and len(spans[0]) == 3
