"""Token counts of a byte-level BPE vocabulary, without materialising ids.

A text splits into pre-tokens and no merge crosses their borders, so the
tokens of a text are the sum, over its distinct pre-tokens, of frequency times
pieces. Pieces are counted once per distinct pre-token:

* a dictionary of the commonest pre-tokens of any length, found on a bounded
  sample of texts and bounded in entries and bytes (long ones stand there by
  their hash), is counted first and broadcast; it settles most occurrences
  where the text is read (and which pre-tokens it holds changes the work,
  never a count);
* all other (document, pre-token, frequency) rows are dealt by pre-token,
  sorted, counted once per distinct pre-token and joined there, and summed by
  document. A pre-token of a share f of all documents is missed by the sample
  with probability (1 - f)^SAMPLE_ROWS, so no key of a thousandth or more of
  the documents is dealt to one task (5e-5).

Defined results: null counts as the empty text (0 tokens, 0 bytes); ids may be
null or repeated, and repeated rows each come back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, batch_of, field, per_partition, session, texts

#: The pre-tokens of byte-level BPE (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond these letters are split by the library itself (other Unicode tables may differ).
PLAIN = regex.compile("[\t-\r -~ -ɏ‐-‧‰-⁞€]*")
SAMPLE_ROWS, ENTRIES = 10_000, 1 << 18
#: Characters from which on a pre-token stands in the dictionary by its hash.
LONG = 64

_loaded: dict[str, PreTokens] = {}


class PreTokens:
    """One vocabulary: splits texts and counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.find = regex.compile(PATTERN).findall

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        parts, n = [text], 0
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
                n = len(parts) - 1
        if len(parts) == 1 and PLAIN.fullmatch(text):
            return self.find(text), 0
        out: list[str] = []
        for p in parts:
            out += self.find(p) if PLAIN.fullmatch(p) else [p[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(p)]
        return out, n

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(tokens, add_special_tokens=False)]


def load(path: str) -> PreTokens:
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def entry(token: str) -> str:
    """The dictionary's key of a pre-token: itself, or a 128-bit hash (no pre-token has \\0 before letters or digits)."""
    return token if len(token) < LONG else "\0" + xxhash.xxh3_128_hexdigest(token.encode())


def common_pieces(docs: DataFrame, text_col: str, path: str, rows: int, entries: int) -> dict[str, int]:
    """Pieces of the commonest pre-tokens (``entries`` at most, by ``entry``) of a sample."""
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType()), T.StructField("pieces", T.LongType())])

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for t in texts(batch, 0):
            found.update(load(path).split(t)[0])
        long = [t for t in found if len(t) >= LONG]
        pieces = dict(zip(long, load(path).pieces(long), strict=True))
        return batch_of(schema, [[entry(t) for t in found], list(found.values()), [pieces.get(t) for t in found]])

    total = docs.count()
    sample = docs.select(F.col(text_col).alias("text"))
    if total > rows:
        sample = sample.sample(fraction=rows / total, seed=7)
    top = arrow_map(sample, split, schema).groupBy("token").agg(F.sum("n").alias("n"), F.max("pieces").alias("pieces")).where("n > 1").orderBy(F.desc("n"), "token").limit(entries)
    found = {r["token"]: r["pieces"] for r in top.collect()}
    short = [t for t, k in found.items() if k is None]
    return found | dict(zip(short, load(path).pieces(short), strict=True))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    spark = session(docs)
    known = spark.sparkContext.broadcast(common_pieces(docs, text_col, path, sample_rows, entries))
    schema = T.StructType([
        field(docs, id_col),
        T.StructField("text_hash", T.LongType()),
        T.StructField("token", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("place", T.IntegerType()),
    ])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        get, split = known.value.get, load(path).split
        row, hashes, tokens, ns, sizes, places = [], [], [], [], [], []
        for i, t in enumerate(texts(batch)):
            raw = t.encode()
            h = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
            found, total = split(t)
            own = []
            for token, n in Counter(found).items():
                if (k := get(token if len(token) < LONG else entry(token))) is None:
                    own.append(token)
                    ns.append(n)
                else:
                    total += n * k
            tokens += own
            tokens.append(None)
            ns.append(total)
            row += [i] * (len(own) + 1)
            hashes += [h] * (len(own) + 1)
            sizes += [None] * len(own) + [len(raw)]
            places += [None] * len(own) + [i]
        return batch_of(schema, [batch.column(0).take(pa.array(row, pa.int32())), hashes, tokens, ns, sizes, places])

    rows = arrow_map(docs.select(id_col, text_col), read, schema)
    # A document's own row has no token and is dealt by its text and its place in the batch, else nulls (and copies) would meet in one task.
    dealt = rows.repartition(F.when(F.col("token").isNull(), F.xxhash64("text_hash", "place")).otherwise(F.xxhash64("token"))).drop("place")
    summed = T.StructType([schema.fields[0], schema.fields[1], schema.fields[3], schema.fields[4]])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: each distinct pre-token is counted once, when it first appears."""
        last, k = None, 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            fresh = [t for t in coded.dictionary.to_pylist() if t != last]
            pieces = dict(zip(fresh, load(path).pieces(fresh), strict=True))
            if last is not None:
                pieces[last] = k
            weights = pa.array([pieces[t] for t in coded.dictionary.to_pylist()], pa.int64()).take(coded.indices).fill_null(1)
            n = pc.multiply(batch.column(3), weights)
            if batch.num_rows and (end := batch.column(2)[-1].as_py()) is not None:
                last, k = end, pieces[end]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, batch.column(4)], names=summed.names)

    per_text = dealt.sortWithinPartitions("token").mapInArrow(per_partition(join), summed).groupBy(id_col, "text_hash").agg(F.sum("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("copies"))
    # k equal rows gave k equal shares; each comes back once for each row.
    n_tokens = F.expr("n div copies")
    return per_text.select(id_col, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
