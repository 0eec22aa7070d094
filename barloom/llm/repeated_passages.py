"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes (in words) only those at minimiser positions are kept: the
position of the smallest hash of ``GRAM`` words among ``window`` consecutive
positions, a choice that depends on the text around it alone, so a passage
selects the same positions wherever it stands. Every passage of ``least`` words
has a kept position with at least ``least // 2`` words of the passage behind it.

1. Kept suffixes are brought together by their first least // 2 words (a hash).
   Those that begin alike in no other text end here.
2. The others get their context (least // 2 words to the left, and as many to
   the right of the shared start). Within a group suffixes are sorted by left
   and by right context, neighbours are compared, and matches are extended to
   both sides: among those alike for a words to the left, the neighbours in the
   order of the right contexts have the longest match, for each a in turn.
   Groups of more than ``GROUP_ROWS`` suffixes do not fit one task: there, the
   suffixes alike for a words to the left and least // 2 - a to the right are
   counted for each a (before the shuffle, too), which finds the same windows.
3. The matched intervals of a text are united. Neighbouring kept positions
   overlap, so the union holds each passage from end to end.

Words are compared by 64-bit hashes. Copies of a text in one partition are read
as one in steps 1 and 2; from ``least`` words on each copy is reported whole.
Starts that very many texts share are found on a sample of texts (``SAMPLE``)
and skip the sorted comparison of step 1, so none meets in one task; this
changes the work, never a result.

Defined results: null, empty and shorter texts have no passages; repetition
within one document alone does not count; repeated rows are copies of each
other; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barloom.llm.common import arrow_map, batch_of, discard, parts, per_partition, session, stored, texts
from barloom.llm.near_duplicates import _few, _hash_of, mixed

LEAST, GRAM = 50, 8
#: Suffixes of the largest group whose neighbours are compared in one task (400 bytes each), and of those compared at a time.
GROUP_ROWS, CHUNK_ROWS = 16384, 16384
#: Members of the largest group that is compared pair by pair: two are each other's only neighbour.
ALL_PAIRS = 2
#: One text in so many is looked at for starts that more than GROUP_ROWS texts share.
SAMPLE = 32
#: Bytes of text read at once.
PART_BYTES = 2 << 20
#: Shared starts up to which their lists are broadcast to the texts.
BROADCAST_ROWS = 50_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(text: str) -> np.ndarray:
    found = text.encode().split()
    return np.fromiter(map(_hash_of.__getitem__, found), np.uint64, len(found))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, from prefix sums."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * _powers(_BASE, len(h)), dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * _powers(_INVERSE, len(h) - n + 1))


def kept_positions(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions and the hash of the least // 2 words from each on."""
    half = least // 2
    window = least - half + 1
    grams, heads = gram_hashes(h, GRAM), gram_hashes(h, half)
    if len(heads) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams[: len(heads)]
    low, span = g, 1
    while span < window:  # minima over doubling, overlapping windows
        step = min(span, window - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    # The first position of each window that holds its minimum.
    at = np.full(len(low), -1)
    for o in range(window):
        hit = (at < 0) & (g[o : o + len(low)] == low)
        at[hit] = np.flatnonzero(hit) + o
    at = np.unique(at)
    return at, heads[at].view(np.int64)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal components of rows."""
    same = a == b
    return np.where(same.all(-1), same.shape[-1], same.argmin(-1))


def match(owner: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes that share a start (those of one ``group``, rising), over all matches with other texts that reach ``least``
    words: the longest extensions to the left and to the right, and one such text's place (-1: none)."""
    g, half = len(owner), least // 2
    back, ahead, mate = np.zeros(g, np.int64), np.zeros(g, np.int64), np.full(g, -1)
    group = np.zeros(g, np.int64) if group is None else group

    def offer(i: np.ndarray, j: np.ndarray, a: np.ndarray) -> None:
        """Places i match places j, a words to the left."""
        b = common_prefix(right[i], right[j]) + half
        ok = (a + b >= least) & (owner[i] != owner[j])
        np.maximum.at(back, i[ok], a[ok])
        np.maximum.at(ahead, i[ok], b[ok])
        mate[i[ok]] = j[ok]

    size = np.unique(group, return_inverse=True, return_counts=True)
    size = size[2][size[1]]
    for lag in range(1, min(ALL_PAIRS, g)):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & (size[lag:] <= ALL_PAIRS))
        a = common_prefix(left[i], left[i + lag])
        offer(i, i + lag, a)
        offer(i + lag, i, a)
    # Among those alike for a words to the left, sorted by right context, the neighbours
    # from other texts have the longest common prefix: for each a, compare with these.
    at = np.flatnonzero(size > ALL_PAIRS)
    by_right = np.empty(g, np.int64)
    by_right[at[np.lexsort(right[at].T[::-1])]] = np.arange(len(at))
    alike = group.copy()
    for a in range(left.shape[1] + 1):
        if a:
            word = np.unique(left[at, a - 1], return_inverse=True)[1]
            kind, n = np.unique(alike[at] * g + word, return_inverse=True, return_counts=True)[1:]
            alike[at] = kind
            at = at[n[kind] > 1]  # those alike with no other for a words are so for no more
        if len(at) < 2:
            break
        order = at[np.lexsort((by_right[at], alike[at]))]
        kin = alike[order]
        change = np.append(True, (owner[order][1:] != owner[order][:-1]) | (kin[1:] != kin[:-1]))
        run = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        before, after = first[run] - 1, np.append(first[1:], len(order))[run]
        for near in (before, after):
            ok = (near >= 0) & (near < len(order))
            ok[ok] &= kin[near[ok]] == kin[ok]
            offer(order[ok], order[near[ok]], np.full(int(ok.sum()), a))
    return back, ahead, mate


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column in tables of about ``rows``, no value's rows in two of them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield t.slice(0, end)
            held, n = t.slice(end).combine_chunks().to_batches(), len(t) - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def unite(owner: np.ndarray, start: np.ndarray, end: np.ndarray, mate: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of each owner's overlapping intervals, with one of their mates."""
    order = np.lexsort((start, owner))
    owner, start, end, mate = owner[order], start[order], end[order], mate[order]
    group = np.cumsum(np.append(False, owner[1:] != owner[:-1]))
    far = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > far[:-1]))
    first = np.flatnonzero(new)
    return owner[first], start[first], np.maximum.reduceat(end, first), mate[first]


def _windows(contexts: DataFrame, least: int) -> DataFrame:
    """Spans of suffixes in large groups: for each a, those alike for a words to the left and enough to the right."""
    half = least // 2
    levels = T.StructType([T.StructField("window", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("back", T.LongType()), T.StructField("at", T.ArrayType(T.LongType()))])

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (3, 4))
        words = np.concatenate([left[:, ::-1], right], 1)  # half before the start, half behind it
        keys = []
        for a in range(half + 1):
            h = mixed(batch.column(0).to_numpy().astype(np.int64).view(np.uint64) + _U(a))
            for k in range(half - a, least - a):
                h = mixed(h ^ words[:, k])
            keys.append(h.view(np.int64))
        n = batch.num_rows
        every = pa.array(np.tile(np.arange(n, dtype=np.int32), half + 1))
        return batch_of(levels, [pa.array(np.concatenate(keys)), batch.column(1).take(every), pa.array(np.repeat(np.arange(half + 1), n)), batch.column(2).take(every)])

    spread_out = stored(arrow_map(contexts.select("head", "text_hash", "at", "left", "right"), spread, levels, PART_BYTES), "passage-windows")
    shared = spread_out.groupBy("window").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high")
    met = spread_out.join(_few(shared), "window").withColumn("place", F.explode("at"))
    mate = F.when(F.col("text_hash") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    start = F.col("place") - F.col("back")
    return met.select("text_hash", start.alias("start"), (start + least).alias("end"), mate.alias("mate"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per repeated passage of a document: id, start_word, end_word (exclusive), mate_id.

    mate_id is the id of a document (the smallest of its copies) that shares a part of the passage.
    """
    session(docs)
    half = least // 2
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    places = T.ArrayType(T.LongType())
    known = T.StructType([T.StructField("head", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("at", places)])
    one = T.StructType([known.fields[0], known.fields[2]])
    own = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("kept", T.ArrayType(one))])
    kind = pa.list_(pa.struct([("head", pa.int64()), ("at", pa.list_(pa.int64()))]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct start of a text once, with its places; of copies in a partition only the first has them."""
        seen: set[int] = set()
        for whole in batches:
            for batch in parts(whole, PART_BYTES):
                n, kept = [], []
                for key, t in zip(batch.column(1).to_pylist(), texts(batch, 2), strict=True):
                    h = word_hashes(t)
                    several: dict[int, list[int]] = {}
                    if key not in seen:
                        for at, head in zip(*(x.tolist() for x in kept_positions(h, least)), strict=True):
                            several.setdefault(head, []).append(at)
                    seen.add(key)
                    n.append(len(h))
                    kept.append([{"head": head, "at": at} for head, at in several.items()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kept, kind)], names=own.names)

    rows = stored(docs.select(F.col(id_col), hashed.alias("h"), F.col(text_col)).mapInArrow(per_partition(choose), own), "passage-rows")
    starts = lambda r: r.select("text_hash", F.explode("kept").alias("x")).select(F.col("x.head").alias("head"), "text_hash", F.col("x.at").alias("at"))
    suffixes = starts(rows)
    sampled = starts(rows.where(F.pmod(F.xxhash64("text_hash", F.lit(5)), F.lit(SAMPLE)) == 0)).select("head", "text_hash").distinct()
    hot = stored(sampled.groupBy("head").count().where(F.col("count") * SAMPLE > GROUP_ROWS).select("head"), "passage-hot")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted (start, text) rows those whose start stands in two texts at least, copies once."""
        rest: pa.Table | None = None
        open_, last = None, None  # a start known to be shared, and the text that came last
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            head, text = t.column(0).to_numpy(), t.column(1).to_numpy()
            first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
            ends = np.append(first[1:], len(head))
            many = np.repeat((text[first] != text[ends - 1]) | ((head[first] == open_) if open_ is not None else False), ends - first)
            many &= np.append((open_, last) != (int(head[0]), int(text[0])), (head[1:] != head[:-1]) | (text[1:] != text[:-1]))
            tail = int(first[-1])
            if text[tail] != text[-1] or head[tail] == open_:
                open_, last, rest = int(head[-1]), int(text[-1]), None
            else:  # one text so far; its copies are the same row
                many[tail:] = False
                open_, last, rest = None, None, t.slice(tail, 1)
            if many.any():
                yield from t.filter(pa.array(many)).combine_chunks().to_batches()

    cool = suffixes.join(hot, "head", "left_anti") if n_hot else suffixes
    hits = cool.repartition("head").sortWithinPartitions("head", "text_hash").mapInArrow(per_partition(shared), known)
    if n_hot:
        hits = hits.unionByName(suffixes.join(hot, "head", "left_semi").groupBy("head", "text_hash").agg(F.first("at").alias("at")))
    hits = stored(hits, "passage-hits")

    # -- contexts of the suffixes that are left, from one row of each text
    firsts = rows.groupBy("text_hash").agg(F.min(id_col).alias("_id"), F.max(id_col).alias("_other"), F.count("*").alias("copies"))
    lists = hits.groupBy("text_hash").agg(F.collect_list(F.struct("head", "at")).alias("hits"))
    wanted = lists.join(firsts, "text_hash").select(F.col("text_hash").alias("_hash"), "_id", "hits")
    few = hits.count() <= BROADCAST_ROWS
    chosen = docs.select(F.col(id_col).alias("_own"), hashed.alias("_h"), F.col(text_col).alias("_text")).join(F.broadcast(wanted) if few else wanted, (F.col("_h") == F.col("_hash")) & F.col("_own").eqNullSafe(F.col("_id")))
    # Places of a text with equal contexts (a run of one line, say) match the same and are one member.
    context = T.StructType([*known.fields, T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows repeated in a partition count once
        for whole in batches:
            for batch in parts(whole, PART_BYTES):
                yield one_batch(batch, seen)

    def one_batch(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for h, t, several in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
            if h in seen:
                continue
            seen.add(h)
            # Beyond a text's ends stand values that no other text has there.
            edge = np.full(least, h, np.int64).view(np.uint64)
            w = np.concatenate([edge[:half], word_hashes(t), edge])
            alike: dict[tuple, list[int]] = {}
            for x in several:
                for at in x["at"]:
                    p = at + half
                    alike.setdefault((x["head"], w[p - half : p][::-1].tobytes(), w[p + half : p + least].tobytes()), []).append(at)
            for (head, left, right), at in alike.items():
                for column, v in zip(out, (head, h, at, left, right), strict=True):
                    column.append(v)
        return batch_of(context, out)

    full = chosen.select("_h", "_text", "hits").mapInArrow(per_partition(contexts), context)
    many = stored(hits.groupBy("head").agg(F.sum(F.size("at")).alias("n")).where(F.col("n") > GROUP_ROWS).select("head"), "passage-many")
    n_many = many.count()
    if n_many:
        full = stored(full, "passage-contexts")
        many = F.broadcast(many) if n_many <= BROADCAST_ROWS else many
    spans = T.StructType([T.StructField("text_hash", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("mate", T.LongType())])

    def around(t: pa.Table | pa.RecordBatch, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint64).reshape(len(t), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, CHUNK_ROWS):
            owner, head = t.column(1).to_numpy(), t.column(0).to_numpy()
            back, ahead, mate = match(owner, around(t, 3), around(t, 4), least, np.cumsum(np.append(False, head[1:] != head[:-1])))
            ok = np.flatnonzero(mate >= 0)
            if len(ok):
                places = t.column(2).combine_chunks().take(pa.array(ok))
                n = np.diff(places.offsets.to_numpy())
                at, of = places.flatten().to_numpy(), np.repeat(ok, n)
                yield batch_of(spans, [pa.array(c) for c in unite(owner[of], at - back[of], at + ahead[of], owner[mate[of]])])

    few = full.join(many, "head", "left_anti") if n_many else full
    found = few.select("head", "text_hash", "at", "left", "right").repartition("head").sortWithinPartitions("head").mapInArrow(per_partition(compare), spans)
    if n_many:
        found = found.unionByName(_windows(full.join(many, "head", "left_semi"), least))
    found = stored(found, "passage-spans")
    discard(hits)

    # -- unions of intervals, then back to the documents
    along = W.partitionBy("text_hash").orderBy("start", "end")
    seen = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    distinct = found.groupBy("text_hash", "start", "end").agg(F.min("mate").alias("mate")).withColumn("new", (seen.isNull() | (F.col("start") > seen)).cast("int")).withColumn("part", F.sum("new").over(along))
    united = distinct.groupBy("text_hash", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("mate").alias("mate"))
    united = united.join(firsts.select(F.col("text_hash").alias("mate"), F.col("_id").alias("mate_id")), "mate").select("text_hash", "start_word", "end_word", "mate_id")
    tagged = rows.select(id_col, "text_hash", "n_words").join(firsts, "text_hash")
    whole = tagged.where((F.col("copies") > 1) & (F.col("n_words") >= least)).select(id_col, F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.when(F.col(id_col) == F.col("_id"), F.col("_other")).otherwise(F.col("_id")).alias("mate_id"))
    partly = tagged.where("copies = 1").join(united, "text_hash").select(id_col, "start_word", "end_word", "mate_id")
    return whole.unionByName(partly)
