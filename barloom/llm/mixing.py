"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

1. Every source gets a target: its share of all words by weight, but at most
   ``repeats`` times its own size; the excess goes to the others by weight
   (water filling, solved over one row per source).
2. The documents of a source, shuffled by a hash of their id, form a stream of
   words, cut into blocks of ``block_words`` words (the last may be shorter).
3. Slot i of the mix has the golden-ratio point frac(i * phi), kept as a
   32-bit integer. Cumulative numbers of the slots that the targets need map
   points to sources; the rank of a slot among the slots of its source picks
   the next block of that source's stream, again from its start when the
   stream ends, until the target is reached (the block that reaches it is
   taken in part). Slots that a source still lacks at the end of the sequence
   follow it, so that every source takes its whole target.
4. Blocks and documents are joined on (source, block).

Ranks and stream positions are prefix sums in two steps, over chunks of slots
and over hash buckets of documents, so a source with a third of all rows is
never ordered in one task. Rows equal in id, source and size follow each other
in the stream; they are counted before any shuffle and placed as one.

Defined results: null or empty text has size 0, takes part with 0 words and
comes back; null is a source of its own, last in order; ids may be null or
repeated, repeated rows are separate documents of equal standing; further
columns of any name come through unread; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import WORD, packed, stored

#: floor(2**32 / golden ratio): the step between the points of two slots.
STEP, FULL, CELL_BITS = 2654435769, 1 << 32, 20
BLOCK_WORDS, REPEATS, WEIGHTS = 256, 3, (1, 2, 3)
#: Documents of a bucket, and slots of a chunk (a power of two; more for very many), in which ranks are counted.
BUCKET_ROWS, CHUNK_BITS = 256, 12
#: Sources up to which they are broadcast and ordered in one task.
FEW_SOURCES = 10_000
#: Copies of one row that a task writes out at once.
COPIES = 4096


def words(text: Column) -> Column:
    """Number of words: each run of other characters becomes one letter."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


@dataclass
class Mix:
    """documents: doc columns, source_no, size, start (in its source's stream); sources: source, source_no,
    source_size, target, quota, need (slots); slots: slot, source_no, block, take (words from the block's start)."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words that the mix takes of each, repeats counted."""
        b, one = self.block_words, F.lit(1)
        some = self.documents.where("size > 0")
        pieces = some.withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
        pieces = pieces.select(*some.columns, "block", F.greatest(F.lit(0), F.col("start") - F.col("block") * b).alias("lo"), F.least(F.lit(b), F.col("start") + F.col("size") - F.col("block") * b).alias("hi"))
        joined = pieces.join(self.slots.select("source_no", "block", "take"), ["source_no", "block"], "left")
        part = F.greatest(F.lit(0), F.least("hi", F.coalesce("take", F.lit(0))) - F.col("lo"))
        summed = joined.groupBy(*some.columns).agg(F.sum(part).cast("long").alias("taken"))
        return summed.unionByName(self.documents.where("size = 0").withColumn("taken", (one - one).cast("long")))


def running(df: DataFrame, n: int, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums (new name -> expression) along a total order; beyond FEW_SOURCES rows (n) by ranges.

    Ranges are stored, so each row keeps its range; sums of whole ranges come first, then those within each.
    """
    rows = df if n <= FEW_SOURCES else stored(df.repartitionByRange(-(-n // FEW_SOURCES), *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    within = W.partitionBy(F.lit(0) if n <= FEW_SOURCES else F.col("range")).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if n <= FEW_SOURCES:
        return rows.withColumns({name: F.sum(F.expr(e)).over(within) for name, e in sums.items()})
    earlier = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("range").agg(*[F.sum(F.expr(e)).alias(f"in_{name}") for name, e in sums.items()])
    whole = whole.select("range", *[F.coalesce(F.sum(f"in_{name}").over(earlier), F.lit(0)).alias(f"to_{name}") for name in sums])
    joined = rows.join(F.broadcast(whole), "range")
    return joined.withColumns({name: F.col(f"to_{name}") + F.sum(F.expr(e)).over(within) for name, e in sums.items()}).drop("range", *[f"to_{name}" for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_no, source_size, weight, target, quota (whole words)."""
    s = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-source-sizes")
    n = s.count()
    s = running(s, n, [F.col("source").asc_nulls_last()], {"source_no": "1"}).withColumn("source_no", F.col("source_no").cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long"))
    # Sources that fill first have the lowest cap per weight; a source is capped
    # if the level reached with all lower ones capped stands above its cap.
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    unit = math.lcm(*weights)
    s = s.withColumn("cap", F.col("source_size") * repeats).withColumn("fills", F.expr(f"cap * ({unit} div weight)"))
    facts = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    s = running(s, n, [F.col("fills"), F.col("source_no")], {"caps": "cap", "weighed": "weight"})
    s = s.withColumn("total", F.lit(facts["total"])).withColumn("lower", F.col("caps") - F.col("cap")).withColumn("rest", F.lit(facts["weight"]) - F.col("weighed") + F.col("weight"))
    s = s.withColumn("capped", (whole("total") - whole("lower")) * unit >= whole("fills") * whole("rest"))
    filled = s.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)).alias("open")).first()
    left, still = F.lit(facts["total"] - filled["cap"]).cast("long"), F.lit(filled["open"]).cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * left).cast("double") / still)
    return s.select("source", "source_no", "source_size", "weight", target.alias("target")).withColumn("quota", F.least(F.floor("target"), F.col("source_size") * repeats).cast("long"))


def point(slot: Column) -> Column:
    """frac(slot * phi) in 32 bits; 16 bits of the slot at a time, so no product leaves 64 bits."""
    high, low = F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF)), slot.bitwiseAND(F.lit(0xFFFF))
    return ((high * F.lit(STEP)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16) + low * F.lit(STEP)).bitwiseAND(F.lit(FULL - 1))


def copied(df: DataFrame, times: str, number: str, by: list[str], most: int) -> DataFrame:
    """Every row ``times`` times, numbered from 0; ``most``: the highest such number. Many copies of one row go to several tasks."""
    if most > COPIES:
        df = df.withColumn("share", F.explode(F.sequence(F.lit(0), F.expr(f"({times} - 1) div {COPIES}").cast("int")))).repartition(*by, "share")
        last = F.least(F.col(times) - 1, (F.col("share") + 1) * COPIES - 1)
        return df.withColumn(number, F.explode(F.sequence(F.col("share").cast("long") * COPIES, last.cast("long")))).drop("share")
    return df.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> Mix:
    """Schedule all documents; see the module's text."""
    spark = docs.sparkSession
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    # A pass of a stream ends in a slot of its own, however short, and so does the quota.
    need = F.expr(f"CASE WHEN quota > 0 THEN quota div source_size * ((source_size + {block_words - 1}) div {block_words}) + (quota % source_size + {block_words - 1}) div {block_words} ELSE 0L END")
    sources = stored(targets(sizes, weights, repeats).withColumn("need", need), "mix-sources")
    facts = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("need"), F.lit(0)).alias("slots"), F.min(F.when(F.col("need") > 0, F.col("need"))).alias("least")).first()
    few = facts["n"] <= FEW_SOURCES
    known = sources.select(F.col("source").alias("source_k"), "source_no")
    numbered = lambda df: df.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("source_k"))).drop("source", "source_k")

    # Stream positions: sums over hash buckets, then within each. Equal rows are one, counted before the shuffle.
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    alike = stored(numbered(sizes.where("size > 0").groupBy("id", "source", "size").agg(F.count("*").alias("copies"))).withColumn("key", key), "mix-rows")
    seen = alike.agg(F.count("*").alias("rows"), F.coalesce(F.max("copies"), F.lit(1)).alias("copies")).first()
    bits = min(20, max(0, math.ceil(math.log2(seen["rows"] / BUCKET_ROWS)))) if seen["rows"] > BUCKET_ROWS else 0
    own = alike.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 5), 16, 10).cast("int"), 20 - bits))
    per_bucket = own.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("inside"))
    before = per_bucket.select("source_no", "bucket", (F.sum("inside").over(W.partitionBy("source_no").orderBy("bucket")) - F.col("inside")).alias("before"))
    within = W.partitionBy("source_no", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    first = F.col("before") + F.sum(F.col("size") * F.col("copies")).over(within) - F.col("size") * F.col("copies")
    placed = own.join(before, ["source_no", "bucket"]).withColumn("first", first).select("id", "source_no", "size", "copies", "first")
    placed = copied(placed, "copies", "nth", ["id", "source_no", "size"], seen["copies"]).select("id", "source_no", "size", (F.col("first") + F.col("nth") * F.col("size")).alias("start"))
    nothing = numbered(sizes.where("size = 0")).select("id", "source_no", "size", F.lit(0).cast("long").alias("start"))
    documents = stored(placed.unionByName(nothing).withColumnRenamed("id", id_col), "mix-documents")

    # Slots of the sequence: about enough for all. In 32 bits its gaps grow up to 7.5 / n, so a rare source may lack some.
    n = facts["slots"]
    n += min(n, math.ceil(4 * n / facts["least"])) if n else 0
    chunk_bits = max(CHUNK_BITS, math.ceil(math.log2(max(n, 1)) / 2))
    ends = lambda c: F.expr(f"cast({c} as decimal(20,0)) * cast({FULL} as decimal(10,0)) div cast({facts['slots'] or 1} as decimal(20,0))").cast("long")
    spans = running(sources, facts["n"], [F.col("source_no")], {"upto": "need"}).withColumn("hi", ends("upto")).withColumn("lo", ends("upto - need"))
    cells = spans.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS)))).select("cell", "lo", "hi", "source_no", "source_size", "quota")
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point(F.col("slot"))).withColumn("cell", F.shiftright("point", CELL_BITS))
    hit = points.join(F.broadcast(cells) if few else cells, "cell").where("point >= lo and point < hi").withColumn("chunk", F.shiftright("slot", chunk_bits))
    counts = hit.groupBy("source_no", "chunk").agg(F.count("*").alias("inside"))
    earlier = counts.select("source_no", "chunk", (F.sum("inside").over(W.partitionBy("source_no").orderBy("chunk")) - F.col("inside")).alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = hit.join(earlier, ["source_no", "chunk"]).select("slot", "source_no", "source_size", "quota", rank.alias("rank"))
    reached = counts.groupBy("source_no").agg(F.sum("inside").alias("reached"))
    lacking = sources.join(reached, "source_no", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("need > reached")
    lacking = running(lacking, facts["n"], [F.col("source_no")], {"upto": "need - reached"}).withColumn("first", F.col("upto") - F.col("need") + n).withColumn("rank", F.explode(F.sequence("reached", F.col("need") - 1)))
    ranked = ranked.unionByName(lacking.select((F.col("first") + F.col("rank")).alias("slot"), "source_no", "source_size", "quota", "rank"))
    block = ranked.withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}")).where("blocks > 0")
    block = block.withColumn("block", F.expr("rank % blocks")).withColumn("done", F.expr(f"(rank div blocks) * source_size + block * {block_words}"))
    take = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.col("quota") - F.col("done"))
    slots = stored(block.withColumn("take", take).where("take > 0").select("slot", "source_no", "block", "take"), "mix-slots")
    return Mix(documents, sources, slots, block_words)


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    m = mix(docs, id_col, **options)
    return m.taken().join(F.broadcast(m.sources) if m.sources.count() <= FEW_SOURCES else m.sources, "source_no").select(id_col, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them: 0 to ``repeats`` times.

    The document in which a source's quota ends counts as a whole if at least
    half of its words are taken. Rows equal in id, source and text share their
    copies evenly; those left over go by a hash of the whole row, so reruns agree.
    """
    part = lambda c, none: F.coalesce(F.col("row")[c].cast("string"), F.lit(none))
    tagged = packed(docs).withColumn("key", F.md5(F.concat_ws("\x01", part(id_col, "\x02"), part(source_col, "\x02"), part(text_col, "\x02"))))
    m = mix(tagged.select("key", F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source")), "key", "text", "source", **options)
    copies = m.taken().withColumn("copies", F.expr("CASE WHEN size = 0 THEN 0 ELSE (2 * taken + size) div (2 * size) END"))
    per_row = stored(copies.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("same")).where("copies > 0"), "mix-copies")
    alone = copied(tagged.join(per_row.where("same = 1"), "key"), "copies", "nth", ["key"], 0).select("row.*")
    several = per_row.where("same > 1")
    found = several.agg(F.count("*").alias("n"), F.max("copies").alias("most")).first()
    if not found["n"]:
        return alone
    # Equal rows once, with their number: they are counted before the shuffle, so copies never meet in one task.
    values = [F.col("row").getField(f.name) for f in docs.schema]
    row_hash = F.xxhash64(*[x for v in values for x in (v.isNull(), v.cast("string"))])
    variants = tagged.join(F.broadcast(several) if found["n"] <= FEW_SOURCES else several, "key").groupBy("key", "copies", "same", row_hash.alias("hash")).agg(F.count("*").alias("rows"), F.first("row").alias("row"))
    variants = variants.withColumn("upto", F.sum("rows").over(W.partitionBy("key").orderBy("hash").rowsBetween(W.unboundedPreceding, 0)))
    times = F.expr("rows * (copies div same) + greatest(0L, least(rows, copies % same - (upto - rows)))")
    return alone.unionAll(copied(variants.withColumn("times", times).where("times > 0"), "times", "nth", ["key", "hash"], found["most"]).select("row.*"))
