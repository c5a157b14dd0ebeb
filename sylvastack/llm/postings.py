"""Approximate nearest neighbours over balanced posting lists in bands of lengths: replicated boundary vectors, ratio pruning over all centroids, lists dealt to shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialize

#: Rows that the centroids are fitted on, by the hash of the id, and how many of them a list has at least.
SAMPLE_ROWS, SAMPLED_A_LIST = 20_000, 4
#: Lists that one vector can join, and the ratio to the nearest centroid's distance up to which it does.
REPLICAS, BOUNDARY = 2, 1.05
#: Share of true neighbours that the ratio of opened lists must reach on sampled queries, and how many queries those are.
RECALL, TRIED = 0.97, 256
#: Share of all neighbours that the bands which are not opened may hold together.
RARE = 0.005
#: Bands of lengths; the last one takes all shorter vectors.
BANDS = 16
#: Shards that the lists are dealt to, and numbers of a shard's vectors that one task holds; more rows make more shards, and a list beyond that is dealt out in parts.
SHARDS, HELD = 16, 1 << 23
#: Rows and queries of a shard that meet in one task at most.
PART_ROWS, PART_QUERIES = 131_072, 65_536


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds in which a list's size adds to the distance from its centroid, so that sizes even out. Deterministic."""
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:lists]].copy()
    toll = np.zeros(len(centres))
    even = len(points) / len(centres)
    for _ in range(rounds):
        d = (centres * centres).sum(axis=1) - 2 * points @ centres.T
        of = (d + toll).argmin(axis=1)
        size = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        lost = np.flatnonzero(~full)
        if len(lost):  # an empty list starts again inside a crowded one
            crowded = np.argsort(-size, kind="stable")[np.arange(len(lost)) % np.count_nonzero(full)]
            centres[lost] = [points[of == c][i % size[c]] for i, c in enumerate(crowded)]
        toll += 0.05 * np.abs(d).mean() * np.clip(size / even - 1, -1, 3)
        toll -= toll.mean()
    return centres


@dataclass
class ListIndex:
    """Centroids, each fitted among vectors of one band of lengths.

    Band b holds lengths above ``longest`` / 2^(b + 1) and up to ``longest`` / 2^b. A band's vectors are lifted to its
    own greatest length, where the least distance to a query is the largest inner product; lifted to the longest vector
    of all, the shorter ones would lie in one place. ``ratio`` has each band's ratio to the distance of its nearest
    centroid up to which lists are opened; 0: none are.
    """

    centres: np.ndarray
    band_of: np.ndarray
    sizes: np.ndarray
    longest: float
    ratio: dict[int, float]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, longest: float, ratio: float | None = None, k: int = 20, tried: np.ndarray | None = None) -> "ListIndex":
        """Centroids and ratios.

        Where no ratio is given, a band has the least at which sampled queries (``tried``, else the first of the sample) find ``RECALL`` of their ``k`` neighbours
        of that band in the sample; those lie farther off than the neighbours in the whole table, so the ratio is on the
        safe side. Bands that together hold less than ``RARE`` of all neighbours are not opened.
        """
        lists = max(1, min(len(sample) // SAMPLED_A_LIST, int(np.ceil(np.sqrt(rows) / 2))))
        bands = _bands(sample, longest)
        centres, band_of = [], []
        for b in np.unique(bands):
            own = lift(sample[bands == b], longest / 2.0**b)
            made = balanced_centroids(own, max(1, round(lists * len(own) / len(sample))))
            centres.append(made)
            band_of += [int(b)] * len(made)
        index = cls(np.vstack(centres), np.array(band_of), np.zeros(len(band_of), np.int64), longest, {})
        index.ratio = index._ratios(sample, k, sample[:TRIED] if tried is None or not len(tried) else tried) if ratio is None and len(sample) > 1 else dict.fromkeys(set(band_of), ratio or 1.0)
        return index

    def _distances(self, queries: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists of a band, and the distance of each query to them; a query's length, which orders nothing, is taken as the band's greatest."""
        members, length = np.flatnonzero(self.band_of == band), self.longest / 2.0**band
        q = queries * (length / np.maximum(np.linalg.norm(queries, axis=1), 1e-300))[:, None]
        c = self.centres[members]
        return members, np.sqrt(np.maximum(length**2 + (c**2).sum(axis=1) - 2 * q @ c[:, :-1].T, 0))

    def _ratios(self, sample: np.ndarray, k: int, tried: np.ndarray) -> dict[int, float]:
        k, place_of = min(k, len(sample) - 1), {x.tobytes(): i for i, x in enumerate(sample)}
        products = tried @ sample.T
        for line, own in zip(products, (place_of.get(x.tobytes()) for x in tried)):
            if own is not None:
                line[own] = -np.inf
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        row, home = self.homes(sample)
        homes = np.full((len(sample), REPLICAS), -1)
        homes[row, np.r_[0, np.where(np.diff(row) == 0, 1, 0)]] = home
        band = self.band_of[homes[near, 0]]
        bands, counts = np.unique(band, return_counts=True)
        rare = bands[np.argsort(counts)][np.cumsum(np.sort(counts)) < RARE * band.size]
        out = dict.fromkeys(self.band_of.tolist(), 0.0)
        for b in bands:
            if b in rare:
                continue
            members, far = self._distances(tried, b)
            place = np.full(len(self.band_of) + 1, -1)
            place[members] = np.arange(len(members))
            at = place[homes[near]]  # a home that is missing has place -1
            of = np.arange(len(tried))[:, None, None]
            reached = np.where(at >= 0, far[of, at], np.inf).min(axis=2)[band == b]
            least = np.broadcast_to(far.min(axis=1)[:, None], band.shape)[band == b]
            out[int(b)] = float(np.quantile(reached / np.maximum(least, 1e-300), RECALL)) + 1e-9
        return out

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list): the nearest list of each vector in its band, and a further one for vectors near a boundary."""
        present = np.unique(self.band_of)
        bands = present[np.maximum(np.searchsorted(present, _bands(vectors, self.longest), side="right") - 1, 0)]
        rows, lists = [], []
        for b in np.unique(bands):
            of, members = np.flatnonzero(bands == b), np.flatnonzero(self.band_of == b)
            x, centres = lift(vectors[of], self.longest / 2.0**b), self.centres[members]
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0))
            order = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
            near = np.take_along_axis(d, order, axis=1)
            keep = near <= near[:, :1] * BOUNDARY
            keep[:, 0] = True
            row, at = np.nonzero(keep)
            rows.append(of[row])
            lists.append(members[order[row, at]])
        rows, lists = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*lists, np.zeros(0, np.int64)])
        order = np.argsort(rows, kind="stable")
        return rows[order].astype(np.int64), lists[order].astype(np.int64)

    def opened(self, queries: np.ndarray, least: int) -> np.ndarray:
        """Which lists each query opens: those of each opened band within its ratio of the nearest; while they hold fewer than ``least`` rows, all lists of the next bands.

        Distances to all centroids are taken, so none is out of reach, however far apart the clusters lie.
        """
        out = np.zeros((len(queries), len(self.band_of)), bool)
        for band, ratio in sorted(self.ratio.items()):
            if ratio:
                members, far = self._distances(queries, band)
                out[:, members] = far <= far.min(axis=1)[:, None] * ratio
        for band in sorted(self.ratio):
            few = np.flatnonzero(out @ self.sizes < least)
            if not len(few):
                break
            out[np.ix_(few, np.flatnonzero(self.band_of == band))] = True
        return out

    def open_lists(self, query: np.ndarray, least: int) -> list[int]:
        """The lists that one query opens."""
        return np.flatnonzero(self.opened(query[None, :], least)[0]).tolist()

    def shards(self, most: float) -> np.ndarray:
        """The shard of each list: lists that lie near each other, in a chain through each band, ``SHARDS`` of about as many rows each, more where one would hold over ``most`` rows."""
        chain: list[int] = []
        for band in np.unique(self.band_of):
            left = np.flatnonzero(self.band_of == band)
            at = left[0]
            while len(left):
                at = left[((self.centres[left] - self.centres[at]) ** 2).sum(axis=1).argmin()]
                chain.append(int(at))
                left = left[left != at]
        before = np.cumsum(self.sizes[chain]) - self.sizes[chain]
        total = max(int(self.sizes.sum()), 1)
        out = np.zeros(len(self.band_of), np.int64)
        out[chain] = before * max(SHARDS, int(np.ceil(total / most))) // total
        return out


def _bands(vectors: np.ndarray, longest: float) -> np.ndarray:
    """How often the longest length can be halved and still reach that of each vector."""
    length = np.maximum(np.linalg.norm(np.asarray(vectors, np.float64), axis=1), 1e-300)
    return np.clip(np.floor(np.log2(longest / length * (1 + 1e-12))), 0, BANDS - 1).astype(np.int64)


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that gives all vectors the same length; then nearer means a larger inner product."""
    x = np.asarray(vectors, np.float64)
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]])


def matrix(column) -> np.ndarray:
    """A list column as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, not zero, and holds finite numbers only."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, ratio: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` rows of ``vectors`` with the largest inner products found.

    ``queries`` has the same columns; None: every row is a query. A query's own id is no candidate. Vectors that are
    null, zero, or hold nulls or non-finite numbers take no part on either side; vectors of different sizes are
    refused. Equal vectors are indexed once: of their ids the k + 1 smallest can be answers, as ties go to the smaller
    id. Repeated (id, vector) rows count once. Empty table: empty result. Scores are double inner products of the
    given vectors. Every row is indexed; only the centroids come from a sample of ``sample_rows``, which also bounds the
    lists: sqrt(rows) / 2 of them, as far as the sample has ``SAMPLED_A_LIST`` rows for each. Lists meet queries in shards of
    near lists, whose number is fixed until they are full, so that a query yields a row a shard and not a row a list.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).distinct()
    by = Window.partitionBy("v").orderBy("id")
    members = materialize(rows.withColumn("copy", F.row_number().over(by)).where(F.col("copy") <= k + 1))
    unique = members.where("copy = 1").select("id", "v")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = unique.agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("longest"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts.least != facts.most:
        raise ValueError("vectors of different sizes")
    sample = matrix(unique.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()["v"])
    asked = rows if queries is None else usable(queries, id_col, vector_col).distinct()
    tried = asked.orderBy(F.xxhash64("id"), "id").limit(TRIED).select("v").toArrow()["v"]
    index = ListIndex.fit(sample, facts.n, facts.longest, ratio, k, matrix(tried))
    element = members.schema["v"].dataType.simpleString()

    built = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                row, to = built.value.homes(matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(c.take(pa.array(row)) for c in part.columns)], ["list", "id", "v"])

    postings = materialize(unique.mapInArrow(place, f"list int, id long, v {element}"))
    for x in postings.groupBy("list").count().collect():  # one row a list
        index.sizes[x.list] = x["count"]
    most = max(1, min(PART_ROWS, HELD // facts.most))
    dealt = index.shards(most)
    opened, shard_of = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(dealt)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists, shard, to = [], [], []
                for i, own in enumerate(opened.value.opened(matrix(part.column(1)), 4 * (k + 1)) if part.num_rows else ()):
                    own = np.flatnonzero(own)
                    for at in np.unique(shard_of.value[own]):
                        lists.append(own[shard_of.value[own] == at])
                        shard.append(at)
                        to.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(lists, pa.list_(pa.int32())), *(c.take(pa.array(to, pa.int64())) for c in part.columns)], ["shard", "lists", "query", "q"])

    distinct_queries = asked.groupBy(F.col("v").alias("q")).agg(F.min("id").alias("query")).select("query", "q")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that AQE does not put few wide rows into one task
    routed = materialize(distinct_queries.repartition(spread, "query").mapInArrow(route, f"shard int, lists array<int>, query long, q {element}"))
    load = {x.shard: x["count"] for x in routed.groupBy("shard").count().collect()}
    held = np.bincount(dealt, weights=index.sizes)
    lists = spark.createDataFrame([(i, int(x), int(-(-held[x] // most)) or 1, -(-load.get(int(x), 0) // PART_QUERIES) or 1) for i, x in enumerate(dealt)], "list int, shard int, parts int, asks int")
    left = postings.join(F.broadcast(lists), "list")  # one row a list, so at most sample_rows / SAMPLED_A_LIST
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    right = routed.join(F.broadcast(lists.select("shard", "parts", "asks").distinct()), "shard")
    right = right.withColumn("ask", F.pmod(F.xxhash64("query"), F.col("asks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["shard", "part", "ask"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        queries_, ids_, scores_ = [], [], []
        if a.num_rows and b.num_rows:
            ids, x, names = a["id"].to_numpy(), matrix(a["v"]), a["list"].to_numpy()
            own, at = np.unique(names, return_inverse=True)
            asks, q, wanted = b["query"].to_numpy(), matrix(b["q"]), b["lists"].to_pylist()
            near = sorted(range(len(asks)), key=lambda i: (wanted[i], asks[i]))  # queries of the same lists together
            step, best = max(1, (1 << 21) // len(ids)), REPLICAS * (k + 1)
            for part in (near[lo : lo + step] for lo in range(0, len(near), step)):
                there = np.stack([np.isin(own, wanted[i]) for i in part])
                rows_ = np.flatnonzero(there.any(axis=0)[at])
                if not len(rows_):
                    continue
                products = np.where(there[:, at[rows_]], q[part] @ x[rows_].T, -np.inf)
                least = np.partition(products, -best, axis=1)[:, -best] if len(rows_) > best else np.full(len(part), -np.inf)
                for i, line, low in zip(part, products, least):
                    top = np.flatnonzero((line >= low) & (line > -np.inf))
                    top = top[np.lexsort((ids[rows_[top]], -line[top]))]
                    _, first = np.unique(ids[rows_[top]], return_index=True)  # a vector near a boundary may be here twice
                    top = top[np.sort(first)][: k + 1]
                    queries_.append(int(asks[i]))
                    ids_.append(ids[rows_[top]])
                    scores_.append(line[top])
        return pa.table({"query": pa.array(queries_, pa.int64()), "ids": pa.array(ids_, pa.list_(pa.int64())), "scores": pa.array(scores_, pa.list_(pa.float64()))})

    found = left.select(*key, "list", "id", "v").groupBy(*key).cogroup(right.select(*key, "lists", "query", "q").groupBy(*key)).applyInArrow(meet, "query long, ids array<long>, scores array<double>")
    # Per distinct query one row a shard of k + 1 vectors; the k + 1 best of them hold the answer, as only the own id goes.
    hits = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("query", F.col("x.ids").alias("id")).agg(F.max("x.scores").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    same = asked.join(distinct_queries.withColumnRenamed("q", "v"), "v").select("query", F.col("id").alias("query_id"))
    copies = members.select("v", F.col("id").alias("vec_id")).join(unique.withColumnRenamed("id", "rep"), "v").select("rep", "vec_id")
    full = hits.join(copies, hits.id == copies.rep).select("query", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answer = full.join(same, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return answer.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
