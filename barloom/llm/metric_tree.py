"""Exact top-k by inner product with an M-tree, searched best first.

Inner products become distances: with M the largest norm, a candidate x gets a
further component sqrt(M^2 - |x|^2) and a query q a 0, so that
distance^2 = |q|^2 + M^2 - 2 <q, x>. Equal vectors form one entry that keeps
its k + 1 smallest ids; no more can ever be among the best k.

Tree: at most ROOT_ENTRIES routing vectors (a bounded, hashed choice) stand
under the root; under each of them stand further ones, about one for every
SUBTREE_ROWS entries (MOST_SUBTREES in all, then subtrees grow); every entry
goes to the nearest of its region. Each of these heads a subtree of pages. All
nodes hold a routing vector, a covering radius and the distance to their
parent, and every entry the distance to its page.

Search: a query first meets the one subtree nearest to it, which bounds its
k-th distance; then it asks only for subtrees that the triangle inequality
cannot rule out, and subtrees are sent only to the blocks of queries that ask
for them. Within a subtree, each query takes its pages best first; stored
parent distances rule out pages, and then entries, before anything is computed
for them. Scores are exact integers, bounds are taken with a margin, so
nothing is lost.

Defined results: vectors null, or with null or non-finite components, and null
ids take no part; shorter vectors count as padded with zeros; a query never
finds its own id; ties go to the smaller id; rows equal in id and vector are
one query, and one candidate or, with ``copies``, as many as there are; scores
beyond 64 bits count as the nearest 64-bit number; an empty table gives an
empty result. Where norms differ much, bounds rule out less.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import session, stored

ROOT_ENTRIES, SUBTREE_ROWS, MOST_SUBTREES, PAGE_ROWS, QUERY_BLOCK = 1024, 2048, 1 << 16, 64, 1024
_FOUND = "query_id long, query_no long, vec_id long, times int, score long"
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(vec_id, v): floor(factor * component) of every usable vector."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    usable = table.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * factor)).alias("v"))


def _matrix(several, width: int) -> np.ndarray:
    out = np.zeros((len(several), width), np.int64)
    for i, v in enumerate(several):
        out[i, : len(v)] = v
    return out


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond 64 bits the nearest 64-bit number (the lowest stands for none)."""
    if _largest(q) * _largest(x) * max(q.shape[1], 1) < 2.0**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    return np.minimum(np.maximum(exact, _LOWEST + 1), _HIGHEST).astype(np.int64)


class Space:
    """The metric of candidates of norm up to sqrt(top): x' = (x, sqrt(top - |x|^2)), q' = (q, 0)."""

    def __init__(self, width: int, top: float):
        self.width, self.top = width, top

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))[:, None]], 1)

    @staticmethod
    def flat(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of a candidate with this score; with a margin for the rounding of all distances."""
        whole = (q.astype(float) ** 2).sum(1) + self.top
        d = np.sqrt(np.maximum(0, whole - 2 * score.astype(float)))
        return np.where(score == _LOWEST, np.inf, d * (1 + 1e-9) + 1e-3 + np.sqrt(1e-12 * whole))


class Subtree:
    """Pages under one routing vector."""

    def __init__(self, space: Space, pivot: np.ndarray, x: np.ndarray, ids: list[np.ndarray], times: list[np.ndarray]):
        up = space.lift(x)
        to_root = space.distances(up, pivot[None, :])[:, 0]
        chosen = np.argsort(to_root, kind="stable")[:: max(1, PAGE_ROWS)]
        d = space.distances(up, up[chosen])
        own = d.argmin(1)
        small = x.astype(np.int16) if _largest(x) < 1 << 15 else x
        self.pages = []
        for p, c in enumerate(chosen):
            at = np.flatnonzero(own == p)
            if len(at):
                inside = d[at, p]
                row = np.repeat(np.arange(len(at)), [len(ids[i]) for i in at])
                self.pages.append((up[c], float(inside.max()), float(to_root[c]), inside, small[at], row, np.concatenate([ids[i] for i in at]), np.concatenate([times[i] for i in at])))
        self.pivot = pivot
        self.computed = 0  # inner products

    def search(self, space: Space, q: np.ndarray, own: np.ndarray, k: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best k (scores, ids, times) of each query here; start: scores that k candidates elsewhere reach."""
        n = len(q)
        best, ids, times = np.full((n, k), _LOWEST), np.full((n, k), _HIGHEST), np.zeros((n, k), np.int64)
        flat = space.flat(q)
        root = space.distances(flat, self.pivot[None, :])[:, 0]
        radius, up = np.array([p[1] for p in self.pages]), np.array([p[2] for p in self.pages])
        bound = start.copy()
        reach = space.reach(q, bound)
        # Parent distances first: pages that no query can need are never compared.
        near = np.abs(root[:, None] - up[None, :]) - radius[None, :] <= reach[:, None]
        some = np.flatnonzero(near.any(0))
        if not len(some):
            return best, ids, times
        d = space.distances(flat, np.array([self.pages[p][0] for p in some]))
        lower = np.where(near[:, some], d - radius[some][None, :], np.inf)
        order = np.argsort(lower, axis=1, kind="stable")  # of each query, its pages best first
        rows = np.arange(n)
        for step in range(len(some)):
            page = order[rows, step]
            go = lower[rows, page] <= reach[rows]
            rows, page = rows[go], page[go]  # a query whose next page is out of reach is done
            if not len(rows):
                break
            for j in np.unique(page):
                self._visit(space, self.pages[some[j]], rows[page == j], d[:, j], q, own, k, best, ids, times, bound, reach)
        best[best < start[:, None]] = _LOWEST  # k others are better
        return best, ids, times

    def _visit(self, space, page, live, d, q, own, k, best, ids, times, bound, reach) -> None:
        _, _, _, inside, x, row, page_ids, page_times = page
        ring = np.abs(d[live][:, None] - inside[None, :]) <= reach[live][:, None]
        live, ring = live[ring.any(1)], ring[ring.any(1)]
        kept = np.flatnonzero(ring.any(0))  # vectors that the stored distances cannot rule out
        if not len(live):
            return
        self.computed += len(live) * len(kept)
        place = np.full(len(x), -1)
        place[kept] = np.arange(len(kept))
        entries = np.flatnonzero(place[row] >= 0)
        s = inner(q[live], x[kept])[:, place[row[entries]]]
        new_ids, new_times = page_ids[entries], page_times[entries]
        s[new_ids[None, :] == own[live][:, None]] = _LOWEST
        better = np.flatnonzero(((s >= np.maximum(best[live, k - 1], bound[live])[:, None]) & (s > _LOWEST)).any(1))
        if not len(better):
            return
        at = live[better]
        stack = lambda old, new: np.concatenate([old[at], np.broadcast_to(new, (len(at), len(entries)))], 1)
        both, names, copies = np.concatenate([best[at], s[better]], 1), stack(ids, new_ids), stack(times, new_times)
        chosen = np.lexsort((names, ~both), axis=1)[:, :k]  # ~both: highest first, without overflow
        best[at], ids[at], times[at] = (np.take_along_axis(c, chosen, 1) for c in (both, names, copies))
        bound[at] = np.maximum(bound[at], best[at, k - 1])
        reach[at] = space.reach(q[at], bound[at])


class Routes:
    """The upper levels: roots, and the heads of subtrees with their regions and radii."""

    def __init__(self, space: Space, roots: np.ndarray, more: np.ndarray):
        self.space, self.roots = space, space.lift(roots)
        up = space.lift(more)
        region = space.distances(up, self.roots).argmin(1) if len(more) and len(roots) else np.zeros(0, np.int64)
        alone = np.setdiff1d(np.arange(len(roots)), region)  # a region without a further routing vector is one subtree
        self.region = np.concatenate([region, alone]).astype(np.int64)
        self.heads = np.concatenate([up[: len(region)], self.roots[alone]])
        self.up = np.sqrt(((self.heads - self.roots[self.region]) ** 2).sum(1))
        self.of = [np.flatnonzero(self.region == r) for r in range(len(roots))]
        self.radius, self.wide = np.full(len(self.heads), -np.inf), np.full(len(roots), -np.inf)

    def home(self, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every vector: the subtree (nearest head in the nearest region), the distances to its head and to its root."""
        d = self.space.distances(up, self.roots)
        region, sub, off = d.argmin(1), np.zeros(len(up), np.int64), np.zeros(len(up))
        for r in np.unique(region):
            at = np.flatnonzero(region == r)
            inner_d = self.space.distances(up[at], self.heads[self.of[r]])
            sub[at], off[at] = self.of[r][inner_d.argmin(1)], inner_d.min(1)
        return sub, off, d.min(1)

    def measured(self, sub: int, off: float, off_root: float) -> None:
        self.radius[sub] = off
        self.wide[self.region[sub]] = max(self.wide[self.region[sub]], off_root)

    def in_reach(self, flat: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, subtree) pairs that the triangle inequality cannot rule out."""
        d = self.space.distances(flat, self.roots)
        near = (d - self.wide[None, :] <= reach[:, None])[:, self.region]
        near &= np.abs(d[:, self.region] - self.up[None, :]) - self.radius[None, :] <= reach[:, None]
        some = np.flatnonzero(near.any(0))
        ok = near[:, some] & (self.space.distances(flat, self.heads[some]) - self.radius[some][None, :] <= reach[:, None])
        rows, cols = np.nonzero(ok)
        return rows, some[cols]


def top_k(table: DataFrame, k: int = 20, every: int = 20, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", copies: bool = False) -> DataFrame:
    """Each query's k best: query_id, rank, vec_id, score. Queries: ids divisible by ``every``."""
    spark = session(table)
    vectors = stored(whole_vectors(table, id_col, vector_col, factor).groupBy("vec_id", "v").agg(F.count("*").alias("times")), "tree-vectors")
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = vectors.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("top")).first()
    width, top = facts["width"] or 0, facts["top"] or 0.0
    space = Space(width, top)

    # One entry per vector, with its k + 1 smallest ids (limited before the shuffle, too); more than k copies say no more.
    few = vectors.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    times = F.least(F.col("times"), F.lit(k)) if copies else F.lit(1)
    listed = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", times.cast("int").alias("times")))).alias("ids"))
    entries = stored(listed.select("v", F.col("ids.vec_id").alias("ids"), F.col("ids.times").alias("times")), "tree-entries")
    n = entries.count()
    regions = min(ROOT_ENTRIES, math.ceil(n / 1024))
    each = max(SUBTREE_ROWS, math.ceil(n / MOST_SUBTREES))
    roots = [r[0] for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(regions).collect()]
    heads = [r[0] for r in entries.select("v").where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(each)) == 0).collect()]  # MOST_SUBTREES in expectation
    heads.sort()
    routes = Routes(space, _matrix(roots, width), _matrix(heads, width))
    upper = spark.sparkContext.broadcast(routes)

    def place(frames):
        for f in frames:
            if len(f):
                sub, off, off_root = upper.value.home(space.lift(_matrix(f["v"], width)))
                yield f.assign(sub=sub.astype("int32"), off=off, off_root=off_root)

    placed = stored(entries.mapInPandas(place, "v array<long>, ids array<long>, times array<int>, sub int, off double, off_root double"), "tree-placed")
    for r in placed.groupBy("sub").agg(F.max("off").alias("off"), F.max("off_root").alias("off_root")).collect():  # a row a subtree
        routes.measured(r["sub"], r["off"], r["off_root"])
    known = spark.sparkContext.broadcast(routes)

    def build(key, f):
        tree = Subtree(space, upper.value.heads[key[0]], _matrix(f["v"], width), [np.asarray(i, np.int64) for i in f["ids"]], [np.asarray(i, np.int64) for i in f["times"]])
        return pd.DataFrame({"sub": [key[0]], "tree": [pickle.dumps(tree)]})

    trees = stored(placed.groupBy("sub").applyInPandas(build, "sub int, tree binary"), "tree-pages")

    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("query_no"))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def routed(frames, home: bool):
        """(query, subtree) rows: the home, or all others in reach of the query's bound."""
        for whole in frames:
            for f in (whole.iloc[i : i + 128] for i in range(0, len(whole) if n else 0, 128)):
                q = _matrix(f["v"], width)
                flat = space.flat(q)
                first = known.value.home(flat)[0]
                rows, subs = (np.arange(len(f)), first) if home else known.value.in_reach(flat, space.reach(q, f["bound"].to_numpy(np.int64)))
                ok = (subs == first[rows]) == home
                g = f.iloc[rows[ok]]
                yield pd.DataFrame({"query_id": g["vec_id"].to_numpy(), "query_no": g["query_no"].to_numpy(), "v": g["v"].to_numpy(), "bound": _LOWEST if home else g["bound"].to_numpy(), "sub": subs[ok].astype("int32")})

    asked = "query_id long, query_no long, v array<long>, bound long, sub int"

    def look(key, f, t):
        out = []
        for tree in map(pickle.loads, t["tree"]):
            if len(f):
                q, own = _matrix(f["v"], width), f["query_id"].to_numpy(np.int64)
                best, ids, times = tree.search(space, q, own, k, f["bound"].to_numpy(np.int64))
                rows, cols = np.nonzero(best > _LOWEST)
                out.append(pd.DataFrame({"query_id": own[rows], "query_no": f["query_no"].to_numpy()[rows], "vec_id": ids[rows, cols], "times": times[rows, cols].astype(np.int32), "score": best[rows, cols]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_no", "vec_id", "times", "score")})

    def visit(requests: DataFrame) -> DataFrame:
        left = requests.withColumn("block", F.pmod(F.xxhash64("query_no"), F.lit(blocks)).cast("int"))
        named = left.select(F.col("sub").alias("sub"), F.col("block").alias("block")).distinct()  # only where asked for
        right = trees.join(named, "sub")
        found = left.groupBy("sub", "block").cogroup(right.groupBy("sub", "block")).applyInPandas(look, _FOUND)
        return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))) if copies else found

    best_first = W.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    home = stored(visit(queries.mapInPandas(lambda fs: routed(fs, True), asked)).select("query_id", "query_no", "vec_id", "score"), "tree-home")
    bound = home.withColumn("n", F.row_number().over(best_first)).where(F.col("n") == k).select("query_no", F.col("score").alias("bound"))
    rest = queries.join(bound, "query_no", "left").withColumn("bound", F.coalesce("bound", F.lit(_LOWEST)))
    others = visit(rest.mapInPandas(lambda fs: routed(fs, False), asked)).select("query_id", "query_no", "vec_id", "score")
    ranked = home.unionByName(others).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
