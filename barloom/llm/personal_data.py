"""Personal data: fixed patterns, and more found by bootstrapped contexts.

Base entities (e-mail, IP, card and phone numbers) are the seeds. The words
around an entity are its lexical patterns: the two words before it, the one
before it, that and the one after it, and the two after it. Candidates look
like identifiers of a kind but fail the base rules (other separators, no
country code, a wrong check digit, IPv6, "name (at) host (dot) tld"); they
have patterns too. Spark scores the graph of patterns and instances in rounds:

    confidence(pattern)  = sure / (sure + UNKNOWN * unknown + 1)
    confidence(instance) = 1 - product over its trusted patterns of (1 - confidence)

``sure`` is the sum of the confidence of a pattern's known instances, seeds
(1) and those learned before; unknown ones weigh less. A pattern is trusted
from ``trust`` on, with at least ``support`` distinct known instances, of
which none need be a seed; a candidate is known from ``trust`` on. So what a
pattern finds induces further patterns, round by round, until nothing changes
(or for ``rounds`` rounds). A known identifier is added wherever it stands.
Base spans always stay, and no added span overlaps one.

Defined results: null counts as the empty text, without spans; ids may be null
or repeated, and repeated rows get the same spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, field, packed, session, stored, texts

KINDS = ("email", "ip", "card", "phone")
TRUST, SUPPORT, ROUNDS = 0.8, 3, 20
#: What an unknown instance weighs beside a known one.
UNKNOWN = 0.25
#: Characters on each side of an entity in which its patterns are sought.
REACH = 48
#: Known identifiers, and trusted patterns, up to which they are broadcast.
BROADCAST_ROWS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A later digit of a run can't begin a match where its first can't.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_MAYBE = (
    (0, re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,8}")),
    (1, re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){2,6}(?::|::)[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")),
)
_WORDS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            end = m.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(kind number, start, end) of all base entities, by kind, then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that look like an identifier and overlap no base span and no earlier candidate."""
    digits = bool(_DIGIT.search(text))
    out: list[Span] = []
    taken: bytearray | None = None  # one byte a character, made for the first match
    for kind, pattern in _MAYBE:
        if (kind == 0 and ("at]" in text or "at)" in text)) or (kind == 1 and digits and ":" in text) or (kind > 1 and digits):
            for m in pattern.finditer(text):
                if taken is None:
                    taken = bytearray(len(text))
                    for _, s, e in base:
                        taken[s:e] = b"\1" * (e - s)
                s, e = m.span()
                if taken.find(1, s, e) < 0:
                    taken[s:e] = b"\1" * (e - s)
                    out.append((kind, s, e))
    return out


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The patterns of an entity, lower case; the sign before it belongs to the word before it."""
    left, right = text[max(0, start - REACH) : start], text[end : end + REACH]
    before, after = [w.lower() for w in _WORDS.findall(left)[-2:]], [w.lower() for w in _WORDS.findall(right)[:2]]
    if not before and not after:
        return []
    sign = left.rstrip()[-1:]
    sign = sign if sign in ":=#(" else ""
    out = [f"{' '.join(before)}{sign} _"] if len(before) == 2 else []
    if before:
        out.append(f"{before[-1]}{sign} _")
    if before and after:
        out.append(f"{before[-1]}{sign} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {' '.join(after)}")
    return out


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([*_SPAN.fields, T.StructField("value", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def row_key(row_id: Column, text: Column) -> Column:
    """Equal for equal (id, text) rows only."""
    return F.md5(F.concat_ws("\x01", F.coalesce(row_id.cast("string"), F.lit("\x02")), F.coalesce(text, F.lit(""))))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, row key, seeds and candidates with their patterns."""
    schema = T.StructType([field(docs, id_col), T.StructField("row_key", T.StringType()), T.StructField("seeds", T.ArrayType(_FOUND)), T.StructField("maybe", T.ArrayType(_FOUND))])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        seeds, maybe = [], []
        for t in texts(batch, 2):
            found = base_spans(t)
            for column, spans in ((seeds, found), (maybe, candidates(t, found))):
                column.append([{"kind": k, "start": s, "end": e, "value": t[s:e], "patterns": patterns_of(t, s, e)} for k, s, e in spans])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seeds, _ARROW), pa.array(maybe, _ARROW)], names=schema.names)

    return arrow_map(docs.select(F.col(id_col), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col)), scan, schema)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bootstrap(scanned: DataFrame, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, confidence) of the patterns that the rounds end up trusting, and (kind, value, confidence) of what they found."""

    def edges(column: str, seed: int) -> DataFrame:
        one = scanned.select(F.explode(column).alias("x")).select("x.kind", "x.value", F.explode("x.patterns").alias("pattern"))
        return one.withColumn("seed", F.lit(seed))

    every = edges("seeds", 1).unionByName(edges("maybe", 0)).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    # A pattern without a candidate can find nothing.
    graph = stored(every.join(every.where("seed = 0").select("kind", "pattern").distinct(), ["kind", "pattern"], "left_semi"), "pii-graph")
    spark = scanned.sparkSession
    values, before = spark.createDataFrame([], "kind int, value string, learned double"), None
    patterns = spark.createDataFrame([], "kind int, pattern string, confidence double")
    for _ in range(rounds):
        belief = graph.join(_few(values), ["kind", "value"], "left").withColumn("sure", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.coalesce("learned", F.lit(0.0))))
        scored = belief.groupBy("kind", "pattern").agg(F.sum("sure").alias("sure"), F.count(F.when(F.col("sure") > 0, 1)).alias("known"), F.count("*").alias("n"))
        scored = scored.withColumn("confidence", F.col("sure") / (F.col("sure") + UNKNOWN * (F.col("n") - F.col("known")) + 1))
        patterns = stored(scored.where((F.col("known") >= support) & (F.col("confidence") >= trust)).select("kind", "pattern", "confidence"), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))))
        found = graph.where("seed = 0").join(_few(patterns), ["kind", "pattern"]).groupBy("kind", "value").agg((1 - doubt).alias("learned"))
        values = stored(found.where(F.col("learned") >= trust), "pii-values")
        now = [tuple(df.agg(F.count("*"), F.round(F.sum(c), 6)).first()) for df, c in ((patterns, "confidence"), (values, "learned"))]
        if now == before:
            break
        before = now
    return patterns, values.withColumnRenamed("learned", "confidence")


def _added(scanned: DataFrame, values: DataFrame) -> DataFrame:
    """row_key -> added spans; equal rows hold the same ones."""
    found = scanned.where(F.size("maybe") > 0).select("row_key", F.explode("maybe").alias("x")).select("row_key", "x.*")
    span = F.struct("kind", "start", "end")
    return found.join(_few(values.select("kind", "value")), ["kind", "value"]).groupBy("row_key").agg(F.collect_set(span).alias("added"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, base and added spans (arrays of kind, start, end), all sorted."""
    session(docs)
    scanned = stored(_scan(docs, id_col, text_col), "pii-scan")
    added = _added(scanned, bootstrap(scanned, trust, support, rounds)[1])
    base = F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    both = scanned.select(id_col, "row_key", F.array_sort(base).alias("base")).join(added, "row_key", "left")
    return both.select(id_col, "base", F.coalesce("added", F.array().cast(T.ArrayType(_SPAN))).alias("added"))


def _text(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, base counts, SHA-256 of the base spans, all spans as text, and their number."""
    found = personal_data(docs, id_col, text_col, **options)
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.concat("base", "added")).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of docs, all columns, each span replaced by its kind in angle brackets; length_col, if there, follows."""
    session(docs)
    scanned = stored(_scan(docs, id_col, text_col), "pii-scan")
    added = stored(_added(scanned, bootstrap(scanned, **options)[1]), "pii-added")
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None
    whole = packed(docs).withColumn("row_key", row_key(F.col("row")[id_col], F.col("row")[text_col]))
    joined = whole.join(added, "row_key", "left").select("row", "added")
    names = docs.columns

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.column(0).flatten()
        out = []
        for t, more in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = sorted([*base_spans(t or ""), *((x["kind"], x["start"], x["end"]) for x in more or [])], key=lambda x: (x[1], -x[2]))
            parts, end = [], 0
            for kind, s, e in spans:
                if s >= end:
                    parts += [t[end:s], f"<{KINDS[kind].upper()}>"]
                end = max(end, e)
            out.append("".join([*parts, t[end:]]) if spans else t)
        columns[at] = pa.array(out, columns[at].type)
        if length is not None:
            columns[length] = pa.array([None if t is None else len(t) for t in out], columns[length].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(joined, clean, docs.schema)
