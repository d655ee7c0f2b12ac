"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

A bounded sample of the vectors is bisected into balanced leaves, whose means are the centroids of the posting lists.
Every vector goes to its nearest list and, near a boundary, to further ones. Centroids are searched through an in-memory
graph of their nearest neighbours; a query reads the lists whose distance is within a ratio of the nearest one's. Inner
products become distances by one more dimension that gives all vectors the same length.

Equal vectors are one class first, searched once, with their k + 1 least ids, since no more can be among the nearest.
Lists are read in blocks of bounded numbers of vectors and queries, so that a large list is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
QUERY_EVERY = 20
#: Vectors that the lists are fitted to, at most; all are indexed.
SAMPLE = 40_000
#: Vectors that a list is meant to hold, and the most lists, which the sample's size bounds.
LIST_SIZE = 256
MOST_LISTS = 4096
#: Lists that hold a vector: at most so many, within this ratio of the nearest one's distance.
REPLICAS, REPLICA_RATIO = 4, 1.12
#: Lists that a query reads: at least, at most, and within which ratio of the nearest one's distance.
LEAST_PROBES, PROBES, PROBE_RATIO = 8, 48, 1.35
DEGREE, BEAM = 24, 96
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 512


def bisected(points: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """Means of equally large parts, by repeated two-means with the cut at the median, then refined by three rounds of Lloyd's."""
    parts = [np.arange(len(points))]
    while len(parts) < leaves:
        at = max(range(len(parts)), key=lambda k: len(parts[k]))
        own = parts.pop(at)
        if len(own) < 2:
            parts.append(own)
            break
        x = points[own]
        a, b = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(4):
            side = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
            order = np.argsort(side, kind="stable")
            half = len(own) // 2
            a, b = x[order[:half]].mean(0), x[order[half:]].mean(0)
        parts += [own[order[:half]], own[order[half:]]]
    means = np.stack([points[p].mean(0) for p in parts])
    for _ in range(3):
        near = nearest(points, means)
        sums, n = np.zeros_like(means), np.bincount(near, minlength=len(means))
        np.add.at(sums, near, points)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return means


def nearest(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    out, norms = np.empty(len(points), dtype=np.int64), (means**2).sum(1)
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = (norms - 2 * points[at : at + 4096] @ means.T).argmin(1)
    return out


class Centroids:
    """Centroids and the graph of their nearest neighbours; `radius` is the length to which vectors are extended."""

    def __init__(self, means: np.ndarray, radius: float):
        self.means, self.radius = means, radius
        self.norms = (means**2).sum(1)
        degree = min(DEGREE, len(means) - 1)
        graph = np.empty((len(means), degree + 1), dtype=np.int64)
        for at in range(0, len(means), 1024):
            d = self.norms - 2 * means[at : at + 1024] @ means.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = -np.inf  # itself comes first and is replaced below
            graph[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, : degree + 1]
        graph[:, 0] = np.random.default_rng(3).permutation(len(means))  # one far link each keeps the graph in one piece
        self.graph = graph
        self.starts = np.unique(np.linspace(0, len(means) - 1, min(len(means), 32)).astype(np.int64))

    def extended(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        squares = (vectors**2).sum(1, keepdims=True)
        if query:
            return np.hstack((vectors * (self.radius / np.sqrt(squares)), np.zeros_like(squares)))
        return np.hstack((vectors, np.sqrt(np.maximum(self.radius**2 - squares, 0))))

    def search(self, points: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their distances, nearest first, by a best-first walk of all points at once."""
        n, lists = len(points), len(self.means)
        rows, squares = np.arange(n), (points**2).sum(1, keepdims=True)
        take = min(take, lists)
        beam = min(lists, max(BEAM, take))
        if beam == lists:
            d = squares + self.norms - 2 * points @ self.means.T
            order = np.argsort(d, axis=1, kind="stable")[:, :take]
            return order, np.sqrt(np.maximum(np.take_along_axis(d, order, 1), 0))
        seen = np.zeros((n, lists), dtype=bool)
        found = np.full((n, beam), -1, dtype=np.int64)
        dist = np.full((n, beam), np.inf)
        todo = np.zeros((n, beam), dtype=bool)
        fresh = np.broadcast_to(self.starts, (n, len(self.starts))).copy()
        while True:
            new = ~seen[rows[:, None], fresh]
            seen[rows[:, None], fresh] = True
            d = np.where(new, squares + self.norms[fresh] - 2 * np.einsum("nd,nkd->nk", points, self.means[fresh]), np.inf)
            all_d, all_c, all_t = np.hstack((dist, d)), np.hstack((found, fresh)), np.hstack((todo, new))
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist, found, todo = (np.take_along_axis(x, best, 1) for x in (all_d, all_c, all_t))
            open_d = np.where(todo, dist, np.inf)
            pick = open_d.argmin(1)
            live = np.isfinite(open_d[rows, pick])
            if not live.any():
                break
            todo[rows, pick] = False
            fresh = self.graph[np.where(live, found[rows, pick], 0)]
        order = np.lexsort((found, dist), axis=1)[:, :take]
        return np.take_along_axis(found, order, 1), np.sqrt(np.maximum(np.take_along_axis(dist, order, 1), 0))


def searchable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double where the table has doubles or whole numbers, else of float) of the rows that take part.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those without vec_id or with
    other than the most frequent number of components, which have no inner product with the rest. Rows with one vec_id
    each count.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    x = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("embedding", lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """cid (names the vector), least (vec_id), embedding, ids (the k + 1 least vec_ids, ordered) of equal vectors."""
    least = Window.partitionBy("embedding").orderBy("vec_id")
    small = rows.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    return small.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(class_of().alias("cid"), F.get("ids", F.lit(0)).alias("least"), "embedding", "ids")


def class_of() -> Column:
    """128 bits of hash: rows of equal vectors have it in common, so that a row knows its class without a join."""
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0).cast("float")).otherwise(v))
    return F.concat(F.hex(F.xxhash64(plain)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), plain)))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fitted(table: DataFrame) -> Centroids:
    """Centroids from SAMPLE classes, spread by a hash of cid; their number follows that of the classes."""
    size = table.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).alias("radius")).first()
    sample = table.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toPandas()
    points = stacked(sample["embedding"])
    lists = max(1, min(MOST_LISTS, size["n"] // LIST_SIZE, len(points) // 4))
    radius = size["radius"]
    points = np.hstack((points, np.sqrt(np.maximum(radius**2 - (points**2).sum(1, keepdims=True), 0))))
    return Centroids(bisected(points, lists, np.random.default_rng(11)), radius)


def posted(table: DataFrame, centroids, query: bool, least: int, most: int, ratio: float) -> DataFrame:
    """cid, least, embedding, list: a row for each list that a vector is put into, or that a query reads."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = centroids.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.iloc[at : at + 512]
                lists, d = index.search(index.extended(stacked(batch["embedding"]), query), most)
                chosen = (d <= d[:, :1] * ratio) | (np.arange(lists.shape[1]) < least)
                row, column = np.nonzero(chosen)
                yield pd.DataFrame({"cid": batch["cid"].to_numpy()[row], "least": batch["least"].to_numpy()[row], "embedding": batch["embedding"].to_numpy()[row], "list": lists[row, column]})

    return table.select("cid", "least", "embedding").mapInPandas(place, f"cid string, least long, embedding {dict(table.dtypes)['embedding']}, list int")


def scored(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 best classes of a block for each of its queries. Every product is summed in the order of the components."""
    v, q = stacked(vectors["embedding"]), stacked(queries["embedding"])
    total = np.zeros((len(q), len(v)))
    for d in range(v.shape[1]):
        total += q[:, d, None] * v[None, :, d]
    take = min(k + 1, len(v))
    cids, least = vectors["cid"].to_numpy(), vectors["least"].to_numpy()
    order = np.argsort(least, kind="stable")
    best = order[np.argsort(-total[:, order], axis=1, kind="stable")[:, :take]]
    row = np.repeat(np.arange(len(q)), take)
    return pd.DataFrame({"qid": queries["cid"].to_numpy()[row], "cid": cids[best.ravel()], "least": least[best.ravel()], "score": total[row, best.ravel()]})


def met(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, cid, least, score of the best classes that queries meet in their lists, list by list in bounded blocks."""
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("v"))
    wants = queries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q"))
    blocks = F.broadcast(sizes.join(wants, "list"))  # a row for each list: MOST_LISTS at most
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(blocks, "list").select("list", part("v").alias("vb"), each("q").alias("qb"), "cid", "least", "embedding")
    right = queries.join(blocks, "list").select("list", each("v").alias("vb"), part("q").alias("qb"), "cid", "embedding")
    key = ["list", "vb", "qb"]

    def block(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"qid": [], "cid": [], "least": [], "score": []})
        return scored(vectors, asked, k)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, "qid string, cid string, least long, score double")


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id `every` divides, itself left out.

    Ties go to the smaller vec_id. searchable() says which vectors take part; an empty table gives no row; other columns
    are ignored. Each of several rows with one vec_id is a query of its own, and a candidate for the others. A query that
    finds fewer than k in its lists reads all lists.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = common.written(searchable(vectors), "vectors")
    table = common.written(classes(rows, k), "classes")
    if table.isEmpty():
        return spark.createDataFrame([], result)
    centroids = spark.sparkContext.broadcast(fitted(table))  # MOST_LISTS x components at most
    index = common.written(posted(table, centroids, False, 1, REPLICAS, REPLICA_RATIO), "lists")
    asked = common.written(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", class_of().alias("cid")), "asked")
    queries = table.join(asked.select("cid").distinct(), "cid", "left_semi")
    found = common.written(best(met(index, posted(queries, centroids, True, LEAST_PROBES, PROBES, PROBE_RATIO), k), table, k), "found")
    total = table.agg(F.sum(F.size("ids"))).first()[0]
    short = found.where(F.size("nearest") < min(k + 1, total))
    if not short.isEmpty():
        again = table.join(short.select(F.col("qid").alias("cid")), "cid", "left_semi")
        every_list = posted(again, centroids, True, math.inf, len(centroids.value.means), 1.0)
        found = found.join(short.select("qid"), "qid", "left_anti").unionByName(best(met(index, every_list, k), table, k))
    joined = asked.join(found.withColumnRenamed("qid", "cid"), "cid")
    # The query itself is the first entry of its own vec_id and class.
    own = F.array_position(F.transform("nearest", lambda x: (x["vec_id"] == F.col("query_id")) & (x["cid"] == F.col("cid"))), True)
    others = F.slice(F.filter("nearest", lambda x, n: n + 1 != own), 1, k)
    out = joined.select(F.col("vec_id").alias("query_id"), "cid", "nearest").select("query_id", F.posexplode(others).alias("nth", "x"))
    return out.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def best(hits: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """qid, nearest: the k + 1 best (nth, vec_id, score, cid) of each query class, its own vectors among them."""
    hits = hits.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.first("least").alias("least"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "least", "cid")
    hits = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    rows = hits.join(table.select("cid", "ids"), "cid").select("qid", "cid", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "cid")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    nearest_ = F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "cid")))
    return rows.groupBy("qid").agg(nearest_.alias("nearest"))
