"""Most similar vectors for every vector: probed lists with an adaptive dimension scan.

Vectors are scaled to length one and turned by one fixed random rotation, so that any leading columns are a fair sample
of all. Centroids (fitted on a bounded sample) cut the collection into lists; each query visits its ``n_probe`` nearest
lists, and more of them the more lists there are. ``exact`` gives up the loss: a search within an angle then visits every
list that the triangle inequality allows, a search of the nearest all lists, and no candidate is given up by a test.
Inside a list the columns are read in blocks: after each block the squared distance so far is compared with the
distance still of use, and a candidate is given up when the hypothesis "it is near enough" can be rejected. Survivors
get their whole distance. Lists are cut into blocks of bounded size, and so are the queries that visit one, so a list
that holds a third of all rows is many tasks; exact copies are searched once, by a representative, and where pairs of rows
are asked for, the copies of both sides are spread over salts.

Defined results: null, zero, NaN- or infinity-holding and other-sized vectors take no part; repeated ids count once
(the smallest vector wins); ties in cosine go to the lower id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import Scratch

DIMS = 64
CUTS = (16, 32, 64)
LIST_ROWS = 4000  # aim for the rows of a list
MAX_LISTS = 65_536  # bound of the lists, so that all centroids (16 MB at most) can be sent to the workers; beyond it lists grow
N_PROBE = 12  # lists a query visits at least; on 118,000 vectors in 30 lists it finds 0.997 of the ten nearest, in 300 lists 0.975
PROBE_GROWTH = 0.7  # of the square root of the number of lists, where that is more than N_PROBE
EPSILON = 2.1  # of the hypothesis test, in standard errors; more is safer and slower
SAMPLE_ROWS = 20_000  # bound (in expectation) of the rows centroids are fitted on, or 40 for each list
BLOCK_ROWS, CHUNK_ROWS = 4096, 16384
COPY_ROWS = 2000  # copies of one vector that meet one task
TILE = 1024
LOOSE = 0.02  # share of a tile's pairs left after the first block of columns, above which going on by blocks doesn't pay


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def reject_factor(columns: int, dims: int, epsilon: float) -> float:
    """Share of the useful squared distance beyond which a partial one over so many columns is rejected."""
    if math.isinf(epsilon):
        return 1.0  # a partial distance is never above the whole one
    return min(1.0, columns / dims * (1 + epsilon / math.sqrt(columns)) ** 2) if columns < dims else 1.0


def leading(x: np.ndarray) -> np.ndarray:
    """The first block of columns, its squared length and a one: a product with ``asking`` gives partial squared distances."""
    first = x[:, : CUTS[0]]
    return np.concatenate([first, (first**2).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)], axis=1).astype(np.float32)


def asking(q: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The other side of that product, less what each query rejects beyond."""
    first = q[:, : CUTS[0]]
    return np.concatenate([-2 * first, np.ones((len(q), 1), np.float32), (first**2).sum(1, keepdims=True) - threshold[:, None]], axis=1).astype(np.float32)


def whole_scan(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of each query with its k nearest rows, those as near as the last of them included."""
    dist = 2 - 2 * (q @ x.T)
    last = np.partition(dist, k - 1, axis=1)[:, k - 1]
    a, b = np.nonzero(dist <= last[:, None])
    return a, b, dist[a, b]


def adaptive_scan(q: np.ndarray, x: np.ndarray, ahead: np.ndarray, limit: np.ndarray, epsilon: float, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, data row, squared distance) within ``limit`` of each query, by column blocks; ahead: ``leading(x)``.

    Where the first block rejects little, as at a list's beginning, and only the k nearest are asked for, the distances
    are taken whole.
    """
    first, dims = CUTS[0], q.shape[1]
    threshold = limit * reject_factor(first, dims, epsilon)
    part = (asking(q, threshold) @ ahead.T).ravel()
    hit = np.flatnonzero(part <= 1e-6)
    if 0 < k < len(x) and len(hit) > LOOSE * len(part):
        return whole_scan(q, x, k)
    a, b = np.divmod(hit, len(x))
    dist, done = part[hit] + threshold[a], first
    for cut in CUTS[1:]:
        step = q[a, done:cut] - x[b, done:cut]
        dist = dist + np.einsum("ij,ij->i", step, step)
        keep = dist <= limit[a] * reject_factor(cut, dims, epsilon) + 1e-6
        a, b, dist, done = a[keep], b[keep], dist[keep], cut
    return a, b, dist


def scan_block(q: np.ndarray, qid: np.ndarray, limit: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, epsilon: float):
    """The up to k nearest of x for each query below its limit (k = 0: all), tile by tile, tightening the limit."""
    out = []
    ahead = leading(x)
    for i in range(0, len(q), TILE):
        qt, ids = q[i : i + TILE], qid[i : i + TILE]
        lim = limit[i : i + TILE].copy()
        a, b, d = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        for j in range(0, len(x), TILE):
            na, nb, nd = adaptive_scan(qt, x[j : j + TILE], ahead[j : j + TILE], lim, epsilon, k + 1 if k else 0)
            other = ids[na] != xid[j + nb]
            a, b, d = np.concatenate([a, na[other]]), np.concatenate([b, j + nb[other]]), np.concatenate([d, nd[other]])
            if k and len(a):
                order = np.lexsort((xid[b], d, a))
                a, b, d = a[order], b[order], d[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                full = place == k - 1
                lim[a[full]] = np.minimum(lim[a[full]], d[full])
                a, b, d = a[place < k], b[place < k], d[place < k]
        out.append((ids[a], xid[b], 1 - d.astype(np.float64) / 2))
    return [np.concatenate(c) for c in zip(*out)]


def usable(df: DataFrame, id_col: str, vec_col: str, dims: int = DIMS) -> DataFrame:
    """id, vec of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0).cast("double"), lambda s, e: s + e.cast("double") * e)
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dims))
    rows = rows.where(~bad).where(norm > 0).select(F.col(id_col).alias("id"), v.cast("array<float>").alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


class ProbedLists:
    """The collection of representatives, rotated and cut into lists and blocks."""

    def __init__(self, rows: DataFrame, list_rows: int = LIST_ROWS, n_probe: int = N_PROBE, epsilon: float = EPSILON, exact: bool = False):
        self.spark, self.exact = rows.sparkSession, exact
        self.epsilon = math.inf if exact else epsilon
        self.scratch = Scratch(self.spark, "vectors")
        # exact copies share a representative, the lowest id
        groups = rows.groupBy("vec").agg(F.min("id").alias("rep"))
        turn = rotation(DIMS)

        @F.pandas_udf("binary")
        def rotated(vec: pd.Series) -> pd.Series:
            m = np.stack([np.asarray(v, np.float64) for v in vec]) if len(vec) else np.empty((0, DIMS))
            m = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ turn
            return pd.Series([r.tobytes() for r in m.astype(np.float32)])

        # a hash in front of the array makes a sorting join compare whole arrays only where they are the same
        self.reps = self.scratch.save(groups.select("rep", F.xxhash64("vec").alias("h"), "vec", rotated("vec").alias("r")), "reps")
        self.n = self.reps.count()
        self.n_lists = min(MAX_LISTS, max(1, math.ceil(self.n / list_rows)))
        probes = self.n_lists if exact else min(self.n_lists, max(n_probe, math.ceil(PROBE_GROWTH * math.sqrt(self.n_lists))))
        self.n_probe = probes
        centroids = self.spark.sparkContext.broadcast(self._centroids())

        @F.pandas_udf("struct<probes:array<int>,angles:array<float>>")
        def nearest(r: pd.Series) -> pd.DataFrame:
            m = np.frombuffer(b"".join(r), np.float32).reshape(-1, DIMS)
            cosine = m @ centroids.value.T
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
            angles = np.arccos(np.clip(np.take_along_axis(cosine, order, 1), -1, 1))
            return pd.DataFrame({"probes": list(order.astype(np.int32)), "angles": list(angles.astype(np.float32))})

        self.placed = self.scratch.save(self.reps.select("rep", "r", nearest("r").alias("at")).select("rep", "r", "at.probes", "at.angles"), "placed")
        home = F.col("probes")[0].alias("list")
        # one row a list: its blocks of data, its chunks of visitors and the widest angle of its members
        sizes = self.placed.groupBy(home).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.max(F.col("angles")[0]).alias("radius"))
        visits = self.placed.select(F.explode("probes").alias("list")).groupBy("list")
        visits = visits.agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
        self.shape = self.scratch.save(sizes.join(visits, "list"), "shape")

    def members(self, rows: DataFrame) -> DataFrame:
        """id, rep of every row."""
        hashed = rows.select("id", F.xxhash64("vec").alias("h"), "vec")
        return self.scratch.save(hashed.join(self.reps.select("h", "vec", "rep"), ["h", "vec"]).select("id", "rep"), "members")

    def _centroids(self) -> np.ndarray:
        if self.n_lists == 1:
            return np.zeros((1, DIMS), np.float32)
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        bound = max(SAMPLE_ROWS, 40 * self.n_lists)
        turn = rotation(DIMS)
        picked = self.reps.where(F.pmod(F.xxhash64("rep"), F.lit(self.n)) < bound).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        model = KMeans(k=self.n_lists, seed=1, maxIter=8, distanceMeasure="cosine").fit(picked)
        c = np.stack(model.clusterCenters()) @ turn
        return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def _lists_within(self, angle: float) -> DataFrame:
        """rep, r, lists: the probed lists that can hold a vector within the angle.

        A neighbour y of x lies in its nearest list c, so angle(x, c) is at most angle(x, y) + angle(y, c), and the latter
        is at most the radius of c and at most angle(x, y) + angle(x, home of x).
        """
        wide = F.broadcast(self.shape.select("list", "radius"))
        each = self.placed.select("rep", F.col("angles")[0].alias("own"), F.explode(F.arrays_zip("probes", "angles")).alias("p"))
        each = each.select("rep", "own", F.col("p.probes").alias("list"), F.col("p.angles").alias("far")).join(wide, "list")
        each = each.where(F.col("far") <= angle + F.least(F.col("own") + angle, F.col("radius")) + 1e-4)
        kept = each.groupBy("rep").agg(F.collect_list("list").alias("lists")).withColumnRenamed("rep", "lrep")
        return self.placed.join(kept, F.col("rep") == F.col("lrep")).select("rep", "r", "lists")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, rep, cosine. queries: qid, r, lists, limit (the squared distance of use)."""
        shape = F.broadcast(self.shape.drop("radius"))  # one row a list, so at most MAX_LISTS rows of three numbers
        data = self.placed.select("rep", "r", F.col("probes")[0].alias("list")).join(shape, "list")
        data = data.select(
            F.col("list").alias("dlist"), F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("dblock"),
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("dchunk"), F.col("rep").alias("xid"), F.col("r").alias("x"),
        )
        asks = queries.select("qid", "r", "limit", F.explode("lists").alias("list")).join(shape, "list")
        asks = asks.select(
            "list", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("blocks") - 1).cast("bigint"))).alias("block"),
            F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int").alias("chunk"), F.col("qid").alias("ask"), F.col("r").alias("q"), "limit",
        )
        epsilon = self.epsilon

        def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"qid": [], "rep": [], "cosine": []}).astype({"qid": "int64", "rep": "int64", "cosine": "float64"})
            q = np.frombuffer(b"".join(left["q"]), np.float32).reshape(-1, DIMS)
            x = np.frombuffer(b"".join(right["x"]), np.float32).reshape(-1, DIMS)
            a, b, c = scan_block(q, left["ask"].to_numpy(), left["limit"].to_numpy(np.float32), x, right["xid"].to_numpy(), k, epsilon)
            return pd.DataFrame({"qid": a, "rep": b, "cosine": c})

        both = asks.groupBy("list", "block", "chunk").cogroup(data.groupBy("dlist", "dblock", "dchunk"))
        return both.applyInPandas(scan, "qid long, rep long, cosine double")

    def nearest(self, k: int) -> DataFrame:
        """qid, rep, cosine: the k nearest other representatives. The home list gives each query its first limit."""
        home = self.placed.select(F.col("rep").alias("qid"), "r", F.slice("probes", 1, 1).alias("lists"), F.lit(4.1).alias("limit"))
        best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "rep")
        top = lambda df: df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
        first = self.scratch.save(top(self.search(home, k)), "home")
        if self.n_probe == 1:
            return first
        bound = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
        limit = F.when(F.col("n") >= k, 2 - 2 * F.col("least") + 1e-6).otherwise(F.lit(4.1))
        rest = self.placed.join(bound, F.col("rep") == F.col("qid"), "left").select(
            F.col("rep").alias("qid"), "r", F.slice("probes", 2, self.n_probe).alias("lists"), limit.alias("limit")
        )
        return top(first.unionByName(self.search(rest, k)))

    def within(self, cosine: float) -> DataFrame:
        """rep_a < rep_b with at least this cosine, checked on the vectors as given."""
        asks = self._lists_within(math.acos(max(-1.0, min(1.0, cosine)))).select(F.col("rep").alias("qid"), "r", "lists", F.lit(2 - 2 * cosine + 1e-5).alias("limit"))
        pairs = self.search(asks, 0).select(F.least("qid", "rep").alias("rep_a"), F.greatest("qid", "rep").alias("rep_b")).distinct()
        left = self.reps.select(F.col("rep").alias("rep_a"), F.col("vec").alias("va"))
        right = self.reps.select(F.col("rep").alias("rep_b"), F.col("vec").alias("vb"))
        return pairs.join(left, "rep_a").join(right, "rep_b").withColumn("cosine", exact_cosine("va", "vb")).where(F.col("cosine") >= cosine).drop("va", "vb")


def exact_cosine(a: str, b: str) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0).cast("double"), lambda s, e: s + e)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similar_classes(df: DataFrame, id_col: str, vec_col: str, cosine: float, exact: bool = False) -> tuple[DataFrame, DataFrame, ProbedLists]:
    """Members (id, rep) and the pairs of representatives (rep_a < rep_b, cosine); copies aren't expanded."""
    rows = usable(df, id_col, vec_col)
    lists = ProbedLists(rows, epsilon=3.0, exact=exact)
    members = lists.members(rows)
    return members, lists.scratch.save(lists.within(cosine), "pairs"), lists


def similar_links(df: DataFrame, id_col: str, vec_col: str, cosine: float, exact: bool = False) -> DataFrame:
    """id, class_id, n_copies, n_links: the class of copies of every usable row, its size, and how many other rows are near."""
    members, pairs, lists = similar_classes(df, id_col, vec_col, cosine, exact)
    sizes = lists.scratch.save(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "sizes")
    both = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    near = both.join(sizes.select(F.col("rep").alias("other"), F.col("n").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("across"))
    links = sizes.join(near, "rep", "left").select(F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), (F.coalesce("across", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return members.join(links, F.col("rep") == F.col("class_id")).select("id", "class_id", "n_copies", "n_links")


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, cosine: float, exact: bool = False) -> DataFrame:
    """id_a < id_b: all pairs of rows with at least this cosine, copies included.

    The pairs of m copies are m * (m - 1) / 2 rows whatever one does; they are made in parts of COPY_ROWS by COPY_ROWS.
    """
    members, pairs, lists = similar_classes(df, id_col, vec_col, cosine, exact)
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / COPY_ROWS).cast("int").alias("parts"))
    parts = lists.scratch.save(parts, "parts")
    members = members.join(parts, "rep").select("id", "rep", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    members = lists.scratch.save(members, "spread")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own = pairs.select("rep_a", "rep_b").unionByName(parts.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    left = own.join(parts.withColumnRenamed("rep", "rep_a"), "rep_a").select("rep_a", "rep_b", every)
    left = left.join(members.select(F.col("rep").alias("rep_a"), "part", F.col("id").alias("x")), ["rep_a", "part"]).select("rep_a", "rep_b", "x")
    right = left.join(parts.withColumnRenamed("rep", "rep_b"), "rep_b").select("rep_a", "rep_b", "x", every)
    met = right.join(members.select(F.col("rep").alias("rep_b"), "part", F.col("id").alias("y")), ["rep_b", "part"])
    met = met.where((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def nearest_rows(df: DataFrame, id_col: str, vec_col: str, k: int = 10, exact: bool = False) -> DataFrame:
    """id, rank, neighbour_id, cosine: the k most similar other rows of every usable row.

    Only the k + 1 lowest ids of a group of copies can be anyone's neighbour, so no more of them are kept at hand;
    every copy still gets its own rows.
    """
    rows = usable(df, id_col, vec_col)
    lists = ProbedLists(rows, exact=exact)
    members = lists.members(rows)

    def lowest(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("id")
        return df.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")

    # first among a salt's ids, then among those left
    some = lowest(members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))), "rep", "salt")
    some = lowest(some, "rep").select("rep", F.col("id").alias("neighbour_id"))
    near = lists.nearest(k)
    own = lists.reps.select(F.col("rep").alias("qid"), "rep", F.lit(1.0).alias("cosine"))
    wide = near.unionByName(own).join(some, "rep").select("qid", "cosine", "neighbour_id")
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "neighbour_id")
    short = wide.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    # at most k + 1 entries
    listed = short.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", "neighbour_id", "cosine"))).alias("near"))
    out = members.join(listed, F.col("rep") == F.col("qid")).select(
        "id", F.posexplode(F.slice(F.filter("near", lambda n: n["neighbour_id"] != F.col("id")), 1, k)).alias("at", "n")
    )
    return out.select("id", (F.col("at") + 1).alias("rank"), F.col("n.neighbour_id").alias("neighbour_id"), F.col("n.cosine").alias("cosine"))
