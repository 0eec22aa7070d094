"""Near-duplicates by MinHash and a multi-index Hamming join.

1. Every text becomes its set of distinct word shingles (64-bit hashes), and
   the set a signature: ``COMPONENTS`` minimum hashes of ``BITS`` bits. Equal
   sets become one node.
2. Hamming join: two signatures that differ in at most ``max_diff`` components,
   cut into ``CHUNKS`` chunks, differ in at most max_diff // CHUNKS = 1
   component of some chunk (pigeonhole). For every chunk, each component in
   turn is left out (the allowed error) and the rest is an index key; nodes
   that share no key cannot be within the distance. Every pair within it is
   found.
3. Within a key, nodes are compared by signature. Small keys give their pairs.
   In large ones every member is compared with a leader, the smallest node;
   members that the leader does not take are compared with all others, by
   blocks that return a spanning forest of the pairs within the distance.
   Never all pairs of those near one leader, but the same connected classes.
   Keys that very many nodes share are found on a sample of nodes and are not
   gathered in one task; this changes the work, never a result.
4. The classes of candidates are confirmed on full sets: small classes pair by
   pair, large ones with a leader and blocks for the rest, as above. The
   spanning forests of confirmed links give the components.

MinHash is the one place where a link can be missed: a pair of similarity 0.85
differs in more than 27 of 64 components with probability 3.5e-8 (0.8: 1.4e-5), and a pair
missed still ends in one component if others link it.

Defined results: null or empty texts have no shingles and are linked with
nothing; texts with fewer words than a shingle are one shingle; repeated ids
share components; a null id counts for no component's smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, at_partition_end, batch_of, discard, field, packed, per_partition, session, stored, texts
from barloom.llm.components import components

WORDS, COMPONENTS, BITS, CHUNKS, MAX_DIFF = 5, 64, 16, 14, 27
#: Words whose hashes a worker remembers within a partition.
MEMORY_WORDS = 80_000
#: Members of a key whose pairs are listed; larger keys go by a leader, and blocks of BLOCK members for those it does not take.
FEW, BLOCK = 8, 512
#: One node in so many is looked at for keys that more than HOT nodes share.
SAMPLE, HOT = 32, 512
#: Rows of a table of keys or leaders up to which it is broadcast.
FEW_LARGE = 100_000
#: Shingles of a block in which links are confirmed.
BLOCK_SHINGLES = 1_000_000
#: Bytes of text whose sets are made at once.
PART_BYTES = 2 << 20
#: Candidate rows up to which their keys are broadcast to the texts (32 bytes each).
BROADCAST_ROWS = 500_000

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_PERM = _rng.integers(1, 1 << 63, 2 * COMPONENTS, dtype=np.uint64) * _U(2) + _U(1)
_BOUNDS = [round(i * COMPONENTS / CHUNKS) for i in range(CHUNKS + 1)]
_CHUNK_OF = np.repeat(np.arange(CHUNKS), np.diff(_BOUNDS))


class _WordHashes(dict):
    """64-bit hash of a word; short words are remembered, up to ``MEMORY_WORDS`` (about 200 bytes each)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY_WORDS and len(word) < 32:
            self[word] = h
        return h


_hash_of = _WordHashes()
at_partition_end(_hash_of.clear)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look random."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        total += h[j : j + n] * _PLACE[j]
    if len(h) < words:
        total += _U(len(h))
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """COMPONENTS minima of permuted hashes, BITS bits of each."""
    low = np.empty(COMPONENTS, np.uint64)
    for k in range(0, COMPONENTS, 8):
        low[k : k + 8] = (found[None, :] * _PERM[k : k + 8, None]).min(axis=1)
    return (mixed(low + _PERM[COMPONENTS:]) >> _U(64 - BITS)).astype(np.uint16)


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """One key for each component left out of its chunk: rows x COMPONENTS."""
    place = np.arange(COMPONENTS, dtype=np.uint64)[None, :]
    h = mixed((sigs.astype(np.uint64) << _U(8)) | place)
    sums = np.stack([h[:, a:b].sum(axis=1, dtype=np.uint64) for a, b in zip(_BOUNDS, _BOUNDS[1:], strict=False)], 1)
    return mixed(sums[:, _CHUNK_OF] - h + mixed(place + _U(1 << 20))).view(np.int64)


def fits(small, large, least):
    """Sets of these sizes can be similar enough."""
    return 100 * np.minimum(small, large) >= least * np.maximum(small, large)


class Forest:
    """Union-find over 0..n-1 that keeps the edges that joined something."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by their first n_keys columns, one table for each group."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        keys = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tuple(keys[a].tolist()), t.slice(a, b - a)
        rest = t.slice(cuts[-1]) if t.num_rows else rest
    if rest is not None and rest.num_rows:
        yield tuple(int(rest.column(i)[0].as_py()) for i in range(n_keys)), rest


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _few(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast if it is small: then rows of a hot key need not meet in one task."""
    most = FEW_LARGE if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def deal_rest(members: DataFrame, rest: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """Members of the keys of ``rest``, dealt to (key, x, y): each of the rest meets every member once.

    rest: some of the members, with the same columns. Blocks hold BLOCK members, or ``most`` by weight, on average.
    """
    size = lambda df, name: df.groupBy(key).agg(F.ceil(F.greatest(F.sum(weight) / most, F.count("*") / BLOCK)).cast("int").alias(name))
    sizes = _few(stored(size(rest, "n_rest").join(size(members, "n_all"), key), "near-blocks"))
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [F.col(c) for c in members.columns]
    left = rest.join(sizes, key).withColumn("x", block("n_rest")).withColumn("y", each("n_all")).select(*columns, "x", "y")
    right = members.join(sizes, key).withColumn("y", block("n_all")).withColumn("x", each("n_rest")).select(*columns, "x", "y")
    return left.unionByName(right)


def compare_signatures(nodes: np.ndarray, n: np.ndarray, sigs: np.ndarray, max_diff: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the distance."""
    forest = Forest(len(nodes))
    for i in range(1, len(nodes)):
        near = ((sigs[:i] != sigs[i]).sum(1) <= max_diff) & fits(n[:i], n[i], least)
        for j in np.flatnonzero(near).tolist():
            forest.join(j, i)
    return [(int(nodes[i]), int(nodes[j])) for i, j in forest.edges]


def confirm(sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= least * union."""
    forest, g = Forest(len(sets)), len(sets)
    size = np.array([len(s) for s in sets])
    if g <= 6:
        for i in range(g):
            for j in range(i):
                if fits(size[i], size[j], least) and forest.root(i) != forest.root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= least * (size[i] + size[j] - both):
                        forest.join(j, i)
        return forest.edges
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(g), size)
    order = np.argsort(flat, kind="stable")
    holders = owner[order]  # of each shingle, in order of the sets
    first = np.searchsorted(flat[order], np.arange(flat.max() + 1))
    count = np.diff(np.append(first, len(flat)))
    ends = np.cumsum(size)
    for i in range(1, g):
        own = flat[ends[i] - size[i] : ends[i]]
        n = count[own]
        at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=g)[:i]
        for j in np.flatnonzero(100 * both >= least * (size[i] + size[:i] - both)).tolist():
            forest.join(j, i)
    return forest.edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 85, words: int = WORDS, max_diff: int = MAX_DIFF) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept; row_hash (of the text)
    and root (a number of the component, also where ids repeat or are null)."""
    if max_diff // CHUNKS > 1:
        raise ValueError("index keys allow one error a chunk")
    session(docs)
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    read = T.StructType([field(docs, id_col), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, fps, sigs = [], [], []
        for t in texts(batch, 2):
            s = shingles(t, words)
            n.append(len(s))
            fps.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s).tobytes() if len(s) else None)
        return batch_of(read, [batch.column(0), batch.column(1), n, fps, sigs])

    rows = stored(arrow_map(docs.select(F.col(id_col), hashed.alias("h"), F.col(text_col)), sign, read).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    some = rows.where("n > 0")
    firsts = some.groupBy("fp").agg(F.min("row").alias("node"), F.min(id_col).alias("least_id"))
    nodes = stored(some.join(firsts.select("node", "least_id"), F.col("row") == F.col("node")).select("node", "least_id", F.col(id_col).alias("own_id"), "text_hash", "n", "fp", "sig"), "near-nodes")

    # -- the Hamming join: keys, members, candidate edges
    keyed = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType())])

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        return batch_of(keyed, [pa.array(index_keys(sigs).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), COMPONENTS))])

    met_schema = T.StructType([T.StructField("key", T.LongType()), *_EDGE.fields])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (key, node): pairs of small keys (key null), members of large ones (b null)."""
        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large = None  # the last key, if it is known to be large

        def work(key, node, last):
            nonlocal large
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(key)))
            big = np.repeat((count > FEW) | (key[first] == large if large is not None else False), count)
            a, b = [], []
            for lag in range(1, FEW):
                same = (key[lag:] == key[:-lag]) & ~big[lag:]
                a.append(node[lag:][same])
                b.append(node[:-lag][same])
            if a and sum(map(len, a)):
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                yield batch_of(met_schema, [pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())])
            if big.any():
                yield batch_of(met_schema, [pa.array(key[big]), pa.array(node[big]), pa.nulls(int(big.sum()), pa.int64())])
            if len(key):
                large = int(key[-1]) if big[-1] else None

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            if not len(key):
                continue
            tail = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if len(key) - tail > FEW:
                tail = len(key)  # large already: its members may go now
            yield from work(key[:tail], node[:tail], False)
            key, node = key[tail:], node[tail:]
        yield from work(key, node, True)

    keys = lambda df: arrow_map(df.select("node", "sig"), explode, keyed)
    hot = stored(keys(nodes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SAMPLE)) == 0)).groupBy("key").count().where(F.col("count") * SAMPLE > HOT).select("key"), "near-hot")
    n_hot = hot.count()
    cool = keys(nodes).join(_few(hot), "key", "left_anti") if n_hot else keys(nodes)
    met = cool.repartition("key").sortWithinPartitions("key", "node").mapInArrow(per_partition(meet), met_schema)
    if n_hot:
        met = met.unionByName(keys(nodes).join(_few(hot), "key", "left_semi").select("key", F.col("node").alias("a"), F.lit(None).cast("long").alias("b")))
    met = stored(met, "near-met")
    short = nodes.select("node", "n", "sig")

    def within(batch: pa.RecordBatch) -> pa.RecordBatch:
        s1, s2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for i in (4, 5))
        near = ((s1 != s2).sum(1) <= max_diff) & fits(batch.column(2).to_numpy(), batch.column(3).to_numpy(), least)
        return batch_of(judged, [batch.column(0), batch.column(1), pa.array(near)])

    judged = T.StructType([*_EDGE.fields, T.StructField("near", T.BooleanType())])

    def judge(pairs: DataFrame, others: DataFrame) -> DataFrame:
        both = pairs.join(short.toDF("a", "n1", "s1"), "a").join(others.toDF("b", "n2", "s2"), "b")
        return arrow_map(both.select("a", "b", "n1", "n2", "s1", "s2"), within, judged)

    edges = judge(met.where("key IS NULL").select("a", "b").distinct(), short).where("near").select("a", "b")

    members = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    leaders = stored(members.groupBy("key").agg(F.min("node").alias("b")), "near-leaders")
    if leaders.limit(1).count():
        star = members.join(_few(leaders), "key").where("node <> b").select("key", F.col("node").alias("a"), "b")
        led = stored(judge(star.select("a", "b").distinct(), _few(short.join(leaders.select(F.col("b").alias("node")).distinct(), "node", "left_semi"))), "near-led")
        edges = edges.unionByName(led.where("near").select("a", "b"))
        far = led.where("NOT near").select("a", "b")
        if far.limit(1).count():
            rest = stored(star.join(_few(far), ["a", "b"], "left_semi").select("key", F.col("a").alias("node")), "near-rest")
            dealt = deal_rest(members, rest, "key", F.lit(0), BLOCK).join(short, "node").select("key", "x", "y", "node", "n", "sig")

            def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for _, t in groups(batches, 3):
                    names, at = np.unique(t.column(3).to_numpy(), return_index=True)
                    sigs = np.frombuffer(b"".join(t.column(5).take(pa.array(at)).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
                    if found := compare_signatures(names, t.column(4).to_numpy()[at], sigs, max_diff, least):
                        yield batch_of(_EDGE, [[a for a, _ in found], [b for _, b in found]])

            edges = edges.unionByName(dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(per_partition(compare), _EDGE))
    classes = stored(components(edges), "near-classes")
    discard(met)

    # -- confirmation on full sets, of candidates only
    asked = classes.join(nodes, "node").select("root", "node", "own_id", "text_hash", "n")
    heavy = asked.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK)).cast("int").alias("n_blocks")).where("n_blocks > 1")
    wanted = asked.select(F.col("own_id").alias("_id"), F.col("text_hash").alias("_hash"), "node", "root")
    wanted = F.broadcast(wanted) if classes.count() <= BROADCAST_ROWS else wanted
    sets = T.StructType([T.StructField("root", T.LongType()), T.StructField("node", T.LongType()), T.StructField("found", T.BinaryType())])

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(sets, [batch.column(0), batch.column(1), [shingles(t, words).tobytes() for t in texts(batch, 2)]])

    chosen = docs.select(F.col(id_col).alias("_own"), hashed.alias("_h"), F.col(text_col).alias("_text")).join(wanted, (F.col("_h") == F.col("_hash")) & F.col("_own").eqNullSafe(F.col("_id")))
    full = arrow_map(chosen.select("root", "node", "_text"), gather, sets, PART_BYTES)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, 3):
            names, at = np.unique(t.column(3).to_numpy(), return_index=True)  # repeated rows count once
            raw = t.column(4).take(pa.array(at)).to_pylist()
            if found := confirm([np.frombuffer(r, np.uint64) for r in raw], least):
                yield batch_of(_EDGE, [[int(names[a]) for a, _ in found], [int(names[b]) for _, b in found]])

    def confirmed(dealt: DataFrame) -> DataFrame:
        return dealt.select("root", "x", "y", "node", "found").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(per_partition(check), _EDGE)

    heavy = stored(heavy, "near-heavy")
    n_heavy, no = heavy.count(), F.lit(0).cast("int")
    few_heavy = _few(heavy) if n_heavy else heavy
    links = confirmed((full.join(few_heavy, "root", "left_anti") if n_heavy else full).withColumn("x", no).withColumn("y", no))
    if n_heavy:
        large = full.join(few_heavy, "root")
        leads = F.col("node") == F.col("root")
        spread = large.withColumn("x", F.explode(F.when(leads, F.sequence(no, F.col("n_blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(11)), F.col("n_blocks")).cast("int")))))
        spread = spread.withColumn("y", (~leads).cast("int")).select("root", "x", "y", "node", "found")  # the leader comes first

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(node, root) of members linked to their leader, (node, null) of the others."""
            at, lead = None, np.zeros(0, np.uint64)
            for batch in batches:
                out: list[list] = [[], []]
                for root, x, y, node, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    found = np.frombuffer(raw, np.uint64)
                    if y == 0:
                        at, lead = (root, x), found
                    elif (root, x) != at:
                        raise ValueError("a block has no leader")
                    else:
                        both = len(np.intersect1d(lead, found, assume_unique=True)) if fits(len(lead), len(found), least) else 0
                        out[0].append(node)
                        out[1].append(root if 100 * both >= least * (len(lead) + len(found) - both) else None)
                yield batch_of(_EDGE, out)

        led = stored(spread.repartition("root", "x").sortWithinPartitions("root", "x", "y").mapInArrow(per_partition(follow), _EDGE), "near-follow")
        links = links.unionByName(led.where("b IS NOT NULL"))
        alone = led.where("b IS NULL").select(F.col("a").alias("node"))
        if alone.limit(1).count():
            rest = stored(asked.join(alone.distinct(), "node", "left_semi").select("root", "node", "n"), "near-alone")
            blocks = deal_rest(asked.select("root", "node", "n"), rest, "root", F.col("n"), BLOCK_SHINGLES).select("root", "x", "y", "node").distinct()
            links = links.unionByName(confirmed(full.dropDuplicates(["root", "node"]).join(blocks, ["root", "node"])))
    linked = components(links)
    final = nodes.select("node", "fp", "least_id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = final.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_set = final.join(least_of, "root").select(F.col("fp").alias("fp_"), "component_id", "root")
    told = rows.where("n > 0").join(by_set, F.col("fp") == F.col("fp_")).select(id_col, F.col("n").alias("n_shingles"), "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"), F.col("text_hash").alias("row_hash"), "root")
    # Texts without words all have the same empty set; they join nothing.
    silent = rows.where("n = 0").select(id_col, F.col("n").alias("n_shingles"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"), F.col("text_hash").alias("row_hash"), F.lit(None).cast("long").alias("root"))
    return told.unionByName(silent)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns: one document of each component, with its smallest id; all without shingles stay."""
    found = stored(near_duplicates(docs, id_col, text_col, **options), "near-found")
    gone = found.where("NOT kept").select(F.col(id_col).alias("gone_id"), F.col("row_hash").alias("gone_hash"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    hashed = F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit("")))
    rows = packed(docs).select("row", F.col("row")[id_col].alias("id"), hashed.alias("hash"))
    left = rows.join(gone, (F.col("hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    # An id (or null) on several kept rows of one component is rare; then one of these rows stays, the first by its hash.
    kept = found.where("kept AND n_shingles > 0")
    again = stored(kept.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "near-again")
    n = again.count()
    if not n:
        return left.select("row.*")
    several = kept.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, "root").groupBy(F.col(id_col).alias("again_id"), F.col("row_hash").alias("again_hash")).agg(F.first("root").alias("root"))
    tied = left.join(F.broadcast(several) if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else several, (F.col("hash") == F.col("again_hash")) & F.col("id").eqNullSafe(F.col("again_id")), "left")
    values = [F.col("row").getField(f.name) for f in docs.schema]
    order = F.xxhash64(*[x for v in values for x in (v.isNull(), v.cast("string"))])
    one = tied.where("root IS NOT NULL").groupBy("root").agg(F.min_by("row", F.struct("hash", order)).alias("row"))
    return tied.where("root IS NULL").select("row.*").unionAll(one.select("row.*"))
