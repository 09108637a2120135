"""Batched exact retrieval: cosine scores, filtered and capped top-k, seeds, blends, all-seeds neighbours, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunespark.functions.small import maybe_broadcast, pair_up
from tunespark.functions.tables import written
from tunespark.functions.vectors import cosine, norm, usable
from tunespark.operators import tiles
from tunespark.operators.tiles import artist_key
from tunespark.operators.vectors import TunesparkError, require_same_space
from tunespark.vocab import MMR_LAMBDA, MMR_POOL


def unusable_vectors(df: DataFrame, key: str, dimension: int | None = None) -> DataFrame:
    """(key, error) of rows whose vector is missing, holds what is no finite number, is as good as zero, or is not of the dimension asked for: no score is given for them."""
    wrong = ~usable("vector") if dimension is None else ~usable("vector") | (F.size("vector") != dimension)
    return df.where(wrong).select(key, F.when(~usable("vector"), "unusable vector").otherwise("vector of another dimension").alias("error"))


def dimensions(catalog: DataFrame) -> list[int]:
    """The dimensions of a catalog's usable vectors; more than one only where it is mixed up."""
    return sorted(r["n"] for r in catalog.where(usable("vector")).select(F.size("vector").alias("n")).distinct().limit(3).collect())


def require_one_dimension(queries: DataFrame, catalog: DataFrame) -> None:
    """Raises where usable vectors of the two sides differ in their dimension."""
    found = set(dimensions(queries)) | set(dimensions(catalog))
    if len(found) > 1:
        raise TunesparkError(f"vectors of different dimensions can't be compared: {', '.join(map(str, sorted(found)))}")


def _comparable(queries: DataFrame, catalog: DataFrame) -> None:
    """The guards of a comparison: one dimension, and one space wherever one is named; a catalog of named spaces isn't met by vectors that name none."""
    named = ["space_fingerprint" in df.columns for df in (queries, catalog)]
    if all(named):
        require_same_space(queries, catalog)
    elif any(named) and (queries if named[0] else catalog).where("space_fingerprint is not null").select("space_fingerprint").distinct().limit(2).count() > 1:
        raise TunesparkError("vectors of different embedding spaces can't be compared")
    require_one_dimension(queries, catalog)


def cosine_scores(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, track_id, artist_key, score) of each query vector with each catalog vector; scores are floats. All pairs: search() keeps the best of them only.

    queries: query_id, vector. A request set against all rows: queries are broadcast in blocks, catalog vectors are never shuffled. Vectors that
    can't be compared have no score on either side, see unusable_vectors(); sides of different dimensions or spaces are refused.
    """
    _comparable(queries, catalog)
    left = catalog.where(usable("vector")).select("track_id", artist_key().alias("artist_key"), "vector", norm("vector").alias("norm"))
    right = queries.where(usable("vector")).select("query_id", F.col("vector").alias("q_vector"), norm("vector").alias("q_norm"))
    both = pair_up(left, right)
    return both.select("query_id", "track_id", "artist_key", cosine("q_vector", "vector", F.col("q_norm"), F.col("norm")).alias("score"))


def rank_by_score(scores: DataFrame, k: int, exclude: DataFrame | None = None, max_per_artist: int | None = None) -> DataFrame:
    """The k best tracks of each query of given scores with their rank: score descending, then track_id.

    exclude (query_id, track_id) and the cap on tracks of one artist act before the cut. Spark takes the first rows of each group in
    every task before it shuffles, so that few rows a query and artist move.
    """
    if k < 1 or (max_per_artist is not None and max_per_artist < 1):
        raise TunesparkError("k and max_per_artist must be at least 1")
    left = scores if exclude is None else scores.join(maybe_broadcast(exclude.select("query_id", "track_id")), ["query_id", "track_id"], "left_anti")
    best = [F.desc("score"), F.asc("track_id")]
    if max_per_artist is not None:
        own = Window.partitionBy("query_id", "artist_key").orderBy(*best)
        left = left.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= max_per_artist).drop("__n")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)


def _cut(hits: DataFrame, k: int, max_per_artist: int | None) -> DataFrame:
    return tiles.ranked(hits, k, max_per_artist).select("query_id", "track_id", "artist_key", F.col("score").cast("float").alias("score"), "rank")


def search(queries: DataFrame, catalog: DataFrame, k: int = 10, exclude: DataFrame | None = None, max_per_artist: int | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """The k best tracks of each query (query_id, vector and, with attributes, filters), scored in tiles: no score but those kept leaves a task."""
    _comparable(queries, catalog)
    hits = tiles.top_k(queries.withColumnRenamed("vector", "q_vector"), catalog, k, attributes=attributes, exclude=exclude, max_per_artist=max_per_artist)
    return _cut(hits, k, max_per_artist)


def seed_vectors(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, seed_id, vector) of seeds that the catalog has; seeds: query_id, seed_id."""
    return seeds.select("query_id", "seed_id").join(catalog.select(F.col("track_id").alias("seed_id"), "vector"), "seed_id")


def unknown_seeds(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    return seeds.join(catalog.select(F.col("track_id").alias("seed_id")), "seed_id", "left_anti").select("query_id", "seed_id")


def similar_to(seeds: DataFrame, catalog: DataFrame, k: int = 10, exclude: DataFrame | None = None, max_per_artist: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The k tracks most like each seed, without the seed itself; and the seeds that the catalog doesn't have."""
    found = seed_vectors(seeds, catalog).withColumnRenamed("vector", "q_vector")
    hits = tiles.top_k(found, catalog, k, exclude=exclude, max_per_artist=max_per_artist)
    return _cut(hits, k, max_per_artist), unknown_seeds(seeds, catalog)


def blend_requests(query_vectors: DataFrame, seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, seed_id, q_vector, s_vector, mean and deviation of either path's cosines over the whole catalog, seed included)."""
    seeded = seed_vectors(seeds, catalog).withColumnRenamed("vector", "s_vector")
    asked = query_vectors.withColumnRenamed("vector", "q_vector").join(seeded, "query_id")
    return asked.join(tiles.statistics(asked, catalog), "query_id")


def blend_scores(query_vectors: DataFrame, seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, track_id, artist_key, query_cosine, seed_cosine, score) of all pairs: the sum of both z-scores, seed included; blend() keeps the best only.

    A z-score is a cosine less its request's mean over its population deviation, over the whole catalog; 0 where cosines hardly differ.
    """
    _comparable(query_vectors, catalog)
    right = blend_requests(query_vectors, seeds, catalog).where(usable("q_vector") & usable("s_vector"))
    left = catalog.where(usable("vector")).select("track_id", artist_key().alias("artist_key"), "vector", norm("vector").alias("norm"))
    both = pair_up(left, right).withColumns({"query_cosine": cosine("q_vector", "vector", norm("q_vector"), F.col("norm")), "seed_cosine": cosine("s_vector", "vector", norm("s_vector"), F.col("norm"))})
    z = lambda p, v: F.when(F.col(f"dev_{v}") < 1e-9, 0.0).otherwise((F.col(f"{p}_cosine").cast("double") - F.col(f"mean_{v}")) / F.col(f"dev_{v}"))
    return both.select("query_id", "track_id", "artist_key", "query_cosine", "seed_cosine", (z("query", "q_vector") + z("seed", "s_vector")).alias("score"))


def blend(query_vectors: DataFrame, seeds: DataFrame, catalog: DataFrame, k: int = 10, exclude: DataFrame | None = None, max_per_artist: int | None = None) -> DataFrame:
    """The k best tracks for a query and a seed together, without the seed; one pass over the tiles for the statistics and one for the scores."""
    _comparable(query_vectors, catalog)
    hits = tiles.top_k(blend_requests(query_vectors, seeds, catalog), catalog, k, ("q_vector", "s_vector"), exclude=exclude, max_per_artist=max_per_artist)
    return tiles.ranked(hits, k, max_per_artist)


def all_neighbours(catalog: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """(seed_id, track_id, score, rank): for every catalog track its k nearest others, exactly.

    Tracks in the order of their ids are packed into blocks, one row each, and runs of blocks make strips of seeds. A task holds one strip and its k best so far while all blocks
    go by: a block is one matrix product in single precision, and only the few pairs that may reach a seed's k-th score, with a margin for rounding, are worked out in
    double precision. So all tracks are sent once a strip, whose size is bounded by bytes, and k rows a seed come back.
    """
    spark, sizes = catalog.sparkSession, dimensions(catalog)
    if len(sizes) > 1:
        raise TunesparkError("the catalog holds vectors of different dimensions")
    single = catalog.schema["vector"].dataType.elementType.typeName() == "float"
    vector = F.col("vector") if single else F.col("vector").cast("array<double>")
    own = catalog.where(usable("vector") & F.col("track_id").isNotNull()).select("track_id", vector.alias("vector"))
    n, cores = own.count(), spark.sparkContext.defaultParallelism
    if not n:
        return spark.createDataFrame([], NEIGHBOUR)
    dim, kind = sizes[0], np.float32 if single else np.float64
    in_order = own.repartitionByRange(max(1, min(-(-n // block), 2 * cores)), "track_id").sortWithinPartitions("track_id")
    packed = written(in_order.withColumn("part", F.spark_partition_id()).mapInArrow(_pack(block), "part int, piece int, ids array<string>, x binary"), "blocks")
    ends = packed.select("part", "piece", F.size("ids").alias("n"), F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last")).collect()
    strips = max(-(-n // max(1, min(STRIP_BYTES // (4 * dim), STRIP_KEPT // k))), min(2 * cores, -(-n // block)))
    places, before, last = [], 0, None
    for at, r in enumerate(sorted(ends, key=lambda r: (r["part"], r["piece"]))):
        strip = places[-1][3] if r["first"] == last else before * strips // n  # rows of one id stay in one strip
        places.append((r["part"], r["piece"], at, strip))
        before, last = before + r["n"], r["last"]
    placed = packed.join(F.broadcast(spark.createDataFrame(places, "part int, piece int, at int, strip int")), ["part", "piece"])
    seeds = placed.select("strip", F.lit(0).alias("side"), "at", "ids", "x")
    others = placed.select(F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.lit(1).alias("side"), "at", "ids", "x")
    sent = seeds.unionByName(others).repartitionById(strips, "strip").sortWithinPartitions("strip", "side", "at")
    before_rows = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(max(1, min(int(before_rows) if int(before_rows) > 0 else 10_000, BATCH_BYTES // (block * dim * kind().itemsize)))))
    try:
        return written(sent.mapInArrow(_nearest(k, dim, kind), NEIGHBOUR), "neighbours")
    finally:
        spark.conf.set(BATCH_ROWS, before_rows)


NEIGHBOUR = "seed_id string, track_id string, score float, rank int"
#: Bytes of a strip of seeds in single precision and rows that it may keep at most; seeds of one product; pairs worked out in double precision at a time; bytes of blocks that go to a worker at a time.
STRIP_BYTES, STRIP_KEPT, SEEDS, EXACT, BATCH_BYTES = 16 << 20, 1 << 20, 512, 1 << 15, 16 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _pack(block: int):
    """Sorted rows of a partition -> blocks of at most so many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                rows = batch.slice(start, block)
                x = rows.column("vector").flatten().to_numpy(zero_copy_only=False)
                ids = pa.array([rows.column("track_id").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column("part").slice(0, 1), pa.array([piece], pa.int32()), ids, pa.array([x.tobytes()], pa.binary())], names=["part", "piece", "ids", "x"])
                piece += 1

    return run


class _Strip:
    """Seeds with the k best tracks of each so far, best first; ties by the tracks' places in the order of ids."""

    def __init__(self, blocks: list[tuple[list[str], np.ndarray]], k: int):
        self.k, self.ids, self.x = k, np.array([i for ids, _ in blocks for i in ids], object), np.concatenate([x for _, x in blocks])
        self.norm, self.unit = _units(self.x)
        n = len(self.ids)
        self.score, self.place, self.name = np.full((n, k), -np.inf, np.float32), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), None, object)
        self.rows: dict[str, list[int]] = {}
        for row, name in enumerate(self.ids):
            self.rows.setdefault(name, []).append(row)
        #: A float product differs from the cosine by no more: dim products and sums, and both vectors' rounding, with as much again to spare.
        self.margin = np.float32((self.x.shape[1] + 8) * 2.0**-23)

    def meet(self, at: int, ids: list[str], x: np.ndarray) -> None:
        norm, unit = _units(x)
        names = np.array(ids, object)
        same = np.array([(row, col) for col, name in enumerate(ids) for row in self.rows.get(name, ())], np.int64).reshape(-1, 2)
        for low in range(0, len(self.ids), SEEDS):
            score = self.unit[low : low + SEEDS] @ unit.T
            own = same[(same[:, 0] >= low) & (same[:, 0] < low + len(score))]
            score[own[:, 0] - low, own[:, 1]] = -np.inf  # a track is no neighbour of its own
            least = self.score[low : low + SEEDS, -1]
            floor = np.where(least >= 1, np.float32(np.inf), least - self.margin)  # nothing comes before k scores of 1
            if (fresh := np.flatnonzero(least == -np.inf)).size and score.shape[1] >= self.k:
                floor[fresh] = np.partition(score[fresh], score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k] - 2 * self.margin
            np.maximum(floor, np.float32(-2), out=floor)
            found = np.flatnonzero(score >= floor[:, None])
            for start in range(0, len(found), EXACT):
                row, col = np.divmod(found[start : start + EXACT], score.shape[1])
                row += low
                exact = np.einsum("ij,ij->i", self.x[row].astype(np.float64), x[col].astype(np.float64)) / (self.norm[row] * norm[col])
                exact = np.clip(exact, -1, 1).astype(np.float32)
                better = exact > self.score[row, -1]  # an equal one comes later in the order of ids
                if better.any():
                    self._keep(row[better], exact[better], (at << 32) + col[better], names[col[better]])

    def _keep(self, row: np.ndarray, score: np.ndarray, place: np.ndarray, name: np.ndarray) -> None:
        rows, local = np.unique(row, return_inverse=True)
        local = np.concatenate([np.repeat(np.arange(len(rows)), self.k), local])
        score, place, name = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.score, score), (self.place, place), (self.name, name)))
        first, order = _first(local, score, place, self.k)
        for kept, new in ((self.score, score), (self.place, place), (self.name, name)):
            kept[rows] = new[order[first]].reshape(-1, self.k)

    def result(self) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate([[0], self.ids[1:] != self.ids[:-1]]).astype(np.int64))
        group = np.repeat(group, self.k)
        score, place, name, seed = self.score.ravel(), self.place.ravel(), self.name.ravel(), np.repeat(self.ids, self.k)
        first, order = _first(group, score, place, self.k)
        order = order[first]
        starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]]))) + 1
        there = np.isfinite(score[order])
        order, rank = order[there], rank[there]
        for start in range(0, len(order), 10_000):
            some = order[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(seed[some], pa.string()), pa.array(name[some], pa.string()), pa.array(score[some]), pa.array(rank[start : start + 10_000].astype(np.int32))], names=["seed_id", "track_id", "score", "rank"])


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of rows, and the rows at length 1 in single precision."""
    wide = x.astype(np.float64)
    norm = np.sqrt((wide * wide).sum(1))
    wide /= norm[:, None]
    return norm, wide.astype(np.float32)


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(which places of the order are among the k first of their group, the order): by group, falling score, place."""
    order = np.lexsort((place, -score, group))
    own = group[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    number = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
    return np.flatnonzero(number < k), order


def _nearest(k: int, dim: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seeds, strip = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                own, side, at = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                ids, x = batch.column(3)[i].as_py(), np.frombuffer(batch.column(4)[i].as_buffer(), kind).reshape(-1, dim)
                if own != number:
                    if strip:
                        yield from strip.result()
                    number, seeds, strip = own, [], None
                if side == 0:
                    seeds.append((ids, x.copy()))
                elif seeds:
                    strip = strip or _Strip(seeds, k)
                    strip.meet(at, ids, x)
        if strip:
            yield from strip.result()

    return run


def mmr_rerank(ranked: DataFrame, catalog: DataFrame, k: int, lambda_: float = MMR_LAMBDA, pool: int = MMR_POOL) -> DataFrame:
    """ranked (query_id, track_id, score, rank) picked anew for diversity: (query_id, track_id, score, rank).

    The first pick is the best; each next one has the greatest lambda * score - (1 - lambda) * closest cosine to a picked one, the first in order on ties.
    Groups are bounded: at most `pool` rows of each query take part.
    """
    if k < 1 or not 0 <= lambda_ <= 1:
        raise TunesparkError("k must be at least 1 and lambda within 0 and 1")
    own = ranked.where(F.col("rank") <= pool).select("query_id", "track_id", "score", "rank").join(catalog.select("track_id", "vector"), "track_id")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        score, like = pdf["score"].to_numpy(np.float64), x @ x.T
        left, chosen, closest = np.ones(len(pdf), bool), [], np.full(len(pdf), -np.inf)
        while left.any() and len(chosen) < k:
            value = score if not chosen or lambda_ == 1 else lambda_ * score - (1 - lambda_) * closest
            i = int(np.argmax(np.where(left, value, -np.inf)))
            chosen.append(i)
            left[i] = False
            closest = np.maximum(closest, like[:, i])
        out = pdf.iloc[chosen][["query_id", "track_id", "score"]].copy()
        out["rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    kind = ranked.schema["score"].dataType.simpleString()
    return own.groupBy("query_id").applyInPandas(pick, f"query_id string, track_id string, score {kind}, rank int")
