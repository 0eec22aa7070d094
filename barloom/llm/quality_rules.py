"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one statistic. Its cost (seconds a text) and its
selectivity (share rejected) are estimated on a sample, and the rules run in
order of rejection per cost; the first that rejects ends the cascade for that
text. The order changes the work, never the verdict, so a rerun whose timings
differ returns the same rows.

Defined results: null and empty texts have no words; ``base_failed`` holds for
them (under 50 words). Ids may be null or repeated; each row is judged alone.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import WHITE, arrow_map, batch_of, field, session, texts

SYMBOLS = b"#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000


class Page:
    """A text with its statistics, each computed when a rule first asks."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, WHITE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often, covered, end = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def n_upper(self) -> int:
        """ASCII capitals."""
        return len(self.raw) - len(self.raw.translate(None, bytes(range(65, 91))))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, bytes(range(97, 123))))


@dataclass(frozen=True)
class Rule:
    """rejects(page) is true for texts that go; sql is the same in SQL over the statistics."""

    name: str
    rejects: Callable[[Page], bool]
    sql: str


BASE = (
    Rule("short", lambda p: p.n_words < 50, "n_words < 50"),
    Rule("repeats", lambda p: 100 * p.n_repeat_words > 50 * p.n_words, "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("symbols", lambda p: 100 * p.n_symbols > 5 * p.word_chars, "100 * n_symbols > 5 * word_chars"),
    # An acronym in a text of another script is no shouting: capitals must be much of the text, too.
    Rule("shouting", lambda p: p.n_upper > p.n_lower and 4 * p.n_upper > p.word_chars, "n_upper > n_lower AND 4 * n_upper > word_chars"),
    Rule("dup_lines", lambda p: 100 * p.n_dup_lines > 40 * len(p.lines), "100 * n_dup_lines > 40 * n_lines"),
    Rule("long_words", lambda p: p.word_chars > 20 * p.n_words, "word_chars > 20 * n_words"),
    Rule("tiny_words", lambda p: p.word_chars < 2 * p.n_words, "word_chars < 2 * n_words"),
)


def estimate(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Rule name -> (seconds a text, share rejected), on a sample of about ``rows`` rows.

    Each rule sees a fresh page, so its cost holds the statistics it needs.
    The sample serves the order only; its size bounds the cost of planning.
    """
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("rejected", T.LongType()), T.StructField("seen", T.LongType())])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        several = texts(batch, 0)
        for rule in rules:
            began = time.perf_counter()
            gone = sum(rule.rejects(Page(t)) for t in several)
            for column, x in zip(out, (rule.name, time.perf_counter() - began, gone, len(several)), strict=True):
                column.append(x)
        return batch_of(schema, out)

    total = docs.count()
    sample = docs.select(F.col(text_col).alias("text"))
    if total > rows:
        sample = sample.sample(fraction=rows / total, seed=5)
    found = arrow_map(sample, measure, schema).groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n"))
    return {x["rule"]: (x["s"] / x["n"], x["r"] / x["n"]) for x in found.collect()}


def ordered(rules: tuple[Rule, ...], seen: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejection per cost, highest first; ties (and unseen rules) in the given order."""
    rate = {r.name: seen[r.name][1] / max(seen[r.name][0], 1e-9) if r.name in seen else 0.0 for r in rules}
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def quality_cascade(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: its statistics, base_failed, kept and the rejecting rule.

    ``rejected_by`` names the rule that ended the cascade (null: kept), or
    "base"; it depends on the estimated order where several rules would reject.
    """
    session(docs)
    order = ordered(rules, estimate(docs, text_col, rules, sample_rows))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([
        field(docs, id_col),
        *[T.StructField(c, T.LongType()) for c in counts],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("rejected_by", T.StringType()),
    ])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for t in texts(batch):
            p = Page(t)
            failed = any(r.rejects(p) for r in base)
            by = "base" if failed else next((r.name for r in order if r.rejects(p)), None)
            for column, x in zip(out, (*(getattr(p, c) for c in counts), failed, by is None, by), strict=True):
                column.append(x)
        return batch_of(schema, [batch.column(0), *out])

    return arrow_map(docs.select(id_col, text_col), judge, schema)


def keep_good(docs: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, that no base rule and no cascade rule rejects."""
    session(docs)
    order = (*base, *ordered(rules, estimate(docs, text_col, rules, sample_rows)))
    at = docs.columns.index(text_col)

    def sift(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        mask = [not any(r.rejects(p) for r in order) for p in map(Page, texts(batch, at))]
        return batch.filter(pa.array(mask, pa.bool_())) if any(mask) else None

    return arrow_map(docs, sift, docs.schema)
