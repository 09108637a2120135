"""Requests against a catalog, a tile at a time: verdicts first, then one matrix product, and only the best tracks of each request leave a task.

A tile is a batch of catalog rows as Spark hands it over in columns: vectors as one packed matrix, labels as small codes. A block of requests (a bounded number) is shared
with all tasks as matrices with their filters beside them. A task keeps the best k of each request over all its tiles, so that no score is
shuffled: what moves is k rows a request and task. More requests than a block holds are taken block after block, each written before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.small import few
from tunespark.functions.tables import written
from tunespark.functions.vectors import usable
from tunespark.operators.attributes import energy_band
from tunespark.operators.vectors import TunesparkError

#: Tracks of a tile, requests of a product, rows of k that a block's requests may keep in a task, requests of a block at most.
TILE, CHUNK, KEPT, BLOCK = 4096, 256, 200_000, 20_000
NO_FILTER, FOREIGN, UNKNOWN_LABEL = -9, -2, -1
LABELS = ("vocals", "genre", "mood", "energy")


def artist_key() -> Column:
    return F.coalesce(F.lower("artist"), F.lit(""))


def _values(label: str) -> list[str]:
    return list(V.ENERGY_BANDS) if label == "energy" else list(V.LABELS[label])


def _code(value: Column, label: str, missing: int) -> Column:
    """The place of a value in its vocabulary; another code where it is missing, and one for a value outside."""
    place = F.array_position(F.array(*map(F.lit, _values(label))), value).cast("int") - 1
    return F.when(value.isNull(), missing).when(place < 0, FOREIGN).otherwise(place)


def coded_requests(requests: DataFrame) -> DataFrame:
    """requests with their filters as codes (w_*), blank ones as none."""
    have = set(requests.columns)
    text = lambda c: F.nullif(F.trim(c), F.lit("")) if c in have else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    return requests.withColumns({f"w_{c}": _code(text(c), c, NO_FILTER) for c in LABELS} | {"w_low": number("tempo_min"), "w_high": number("tempo_max")})


def coded_tracks(catalog: DataFrame, attributes: DataFrame | None) -> DataFrame:
    """track_id, artist_key, vector and, given attributes, labels as codes; a track without attributes knows nothing."""
    own = catalog.select("track_id", artist_key().alias("artist_key"), "vector")
    if attributes is None:
        return own
    bit = F.create_map(*[x for i, m in enumerate(V.LABELS["mood"]) for x in (F.lit(m), F.lit(1 << i))])
    moods = F.aggregate(F.coalesce("moods", F.array().cast("array<string>")), F.lit(0), lambda bits, m: bits.bitwiseOR(F.coalesce(F.element_at(bit, m), F.lit(0))))
    codes = {"vocals": _code(F.col("vocals"), "vocals", UNKNOWN_LABEL), "genre": _code(F.col("genre"), "genre", UNKNOWN_LABEL), "mood": moods, "energy": _code(energy_band("energy"), "energy", UNKNOWN_LABEL)}
    labels = attributes.select("track_id", *[c.alias(f"t_{name}") for name, c in codes.items()], F.col("bpm").cast("double").alias("t_bpm"))
    joined = own.join(labels, "track_id", "left")
    return joined.fillna({"t_vocals": UNKNOWN_LABEL, "t_genre": UNKNOWN_LABEL, "t_mood": 0, "t_energy": UNKNOWN_LABEL})


@dataclass
class Block:
    """A bounded number of requests: ids, one matrix a path, filters, own k, seeds, and of a blend each path's mean and deviation."""

    ids: list[str]
    paths: dict[str, np.ndarray]
    norms: dict[str, np.ndarray]
    wants: dict[str, np.ndarray]
    k: np.ndarray
    seeds: list[str | None]
    z: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    chosen: list[list[dict]] | None = None

    @property
    def active(self) -> np.ndarray:
        labels = np.stack([self.wants[c] != NO_FILTER for c in LABELS]).any(0)
        return labels | ~np.isnan(self.wants["low"]) | ~np.isnan(self.wants["high"])


def _load(rows: DataFrame, paths: tuple[str, ...], k: int) -> Block:
    have = set(rows.columns)
    table = coded_requests(rows).toArrow().combine_chunks()
    n = table.num_rows
    column = lambda c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)
    matrix = lambda c: column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    number = lambda c: column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) if c in have else np.full(n, np.nan)
    vectors = {p: matrix(p) for p in paths}
    wants = {c: column(f"w_{c}").to_numpy(zero_copy_only=False).astype(np.int64) for c in LABELS} | {c: column(f"w_{c}").to_numpy(zero_copy_only=False).astype(np.float64) for c in ("low", "high")}
    own_k = np.where(np.isnan(number("k")), k, np.minimum(number("k"), k)).astype(np.int64) if n else np.zeros(0, np.int64)
    z = {p: (number(f"mean_{p}"), number(f"dev_{p}")) for p in paths if f"mean_{p}" in have}
    chosen = column("chosen").to_pylist() if "chosen" in have else None
    return Block(column("query_id").to_pylist(), vectors, {p: np.sqrt((x * x).sum(1)) for p, x in vectors.items()}, wants, own_k, column("seed_id").to_pylist() if "seed_id" in have else [None] * n, z, chosen)


class Tile:
    """Some tracks in the order of their ids: packed vectors, artists as codes, labels, and which requests exclude which of them."""

    def __init__(self, batch: pa.RecordBatch):
        batch = batch.take(pc.sort_indices(batch.column("track_id")))
        self.ids, artists = batch.column("track_id"), batch.column("artist_key").dictionary_encode()
        self.artist, self.artists = artists.indices.to_numpy(zero_copy_only=False), artists.dictionary
        self.x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        names = set(batch.schema.names)
        self.labels = {c: batch.column(f"t_{c}").to_numpy(zero_copy_only=False).astype(np.int64) for c in LABELS} if "t_genre" in names else None
        self.bpm = batch.column("t_bpm").to_numpy(zero_copy_only=False).astype(np.float64) if self.labels else None
        self.gone = batch.column("gone") if "gone" in names else None

    def verdicts(self, block: Block, rows: np.ndarray) -> np.ndarray:
        """0 pass, 1 unknown, 2 mismatch for these requests and each track; a mismatch outranks an unknown."""
        out = np.zeros((len(rows), len(self.ids)), np.int8)
        for c in LABELS:
            want, own = block.wants[c][rows][:, None], self.labels[c][None, :]
            known, fits = (own != 0, (own >> np.maximum(want, 0)) & 1 > 0) if c == "mood" else (own != UNKNOWN_LABEL, own == want)
            if c == "mood":
                fits &= want >= 0
            np.maximum(out, np.where(want == NO_FILTER, 0, np.where(~known, 1, np.where(fits, 0, 2))).astype(np.int8), out=out)
        low, high = (block.wants[c][rows][:, None] for c in ("low", "high"))
        active, bpm = ~(np.isnan(low) & np.isnan(high)), self.bpm[None, :]
        fits = (bpm >= np.where(np.isnan(low), 0, low)) & (bpm <= np.where(np.isnan(high), 1e9, high))
        return np.maximum(out, np.where(~active, 0, np.where(np.isnan(bpm), 1, np.where(fits, 0, 2))).astype(np.int8))

    def cosines(self, block: Block, path: str, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        x, n = (self.x, self.norm) if len(columns) == len(self.ids) else (self.x[columns], self.norm[columns])
        score = block.paths[path][rows] @ x.T
        score /= block.norms[path][rows][:, None] * n[None, :]
        return np.clip(score, -1, 1, out=score).astype(np.float32)

    def excluded(self, where: dict[str, list[int]]) -> list[tuple[int, int]]:
        """(request, track) of requests that exclude a track; where: the requests by their ids."""
        if self.gone is None or self.gone.null_count == len(self.gone):
            return []
        found = np.flatnonzero(self.gone.is_valid().to_numpy(zero_copy_only=False))
        return [(i, int(t)) for t in found for name in self.gone[int(t)].as_py() for i in where.get(name, ())]


class Best:
    """The best tracks of each request so far: score descending, then id, with a cap on tracks of one artist."""

    def __init__(self, block: Block, cap: int | None):
        self.block, self.cap = block, cap
        self.rows: list[list[tuple]] = [[] for _ in block.ids]
        self.least = np.full(len(block.ids), -np.inf)

    def add(self, i: int, tile: Tile, columns: np.ndarray, score: np.ndarray, extra: list[np.ndarray]) -> None:
        k = int(self.block.k[i])
        at = np.flatnonzero(score >= self.least[i])
        at = at[np.argsort(-score[at], kind="stable")]
        if self.cap is None:
            at = at[:k]
        else:
            taken: dict[int, int] = {}
            some = []
            for j in at.tolist():
                a = int(tile.artist[columns[j]])
                taken[a] = taken.get(a, 0) + 1
                if taken[a] <= self.cap:
                    some.append(j)
                    if len(some) == k:
                        break
            at = np.array(some, np.int64)
        new = [(-float(score[j]), tile.ids[int(columns[j])].as_py(), tile.artists[int(tile.artist[columns[j]])].as_py(), *(float(e[j]) for e in extra)) for j in at.tolist()]
        kept: list[tuple] = []
        count: dict[str, int] = {}
        for row in sorted(self.rows[i] + new):
            count[row[2]] = count.get(row[2], 0) + 1
            if self.cap is None or count[row[2]] <= self.cap:
                kept.append(row)
                if len(kept) == k:
                    self.least[i] = -row[0]
                    break
        self.rows[i] = kept


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    for batch in batches:
        for i in range(0, batch.num_rows, TILE):
            yield Tile(batch.slice(i, TILE))


_HIT = pa.schema([("query_id", pa.string()), ("track_id", pa.string()), ("artist_key", pa.string()), ("score", pa.float64()), ("query_cosine", pa.float32()), ("seed_cosine", pa.float32()), ("n", pa.int64()), ("mismatch", pa.int64()), ("unknown", pa.int64())])
HIT = "query_id string, track_id string, artist_key string, score double, query_cosine float, seed_cosine float, n bigint, mismatch bigint, unknown bigint"


def _candidates(tile: Tile, block: Block, rows: np.ndarray, where: dict[str, list[int]], filtered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns that some of the requests may have, whether each request may have each of them, and the verdicts on all tracks."""
    verdict = tile.verdicts(block, rows) if filtered else np.zeros((len(rows), len(tile.ids)), np.int8)
    open_ = verdict == 0
    place = {int(r): i for i, r in enumerate(rows)}
    for i, t in tile.excluded(where):
        if i in place:
            open_[place[i], t] = False
    columns = np.flatnonzero(open_.any(0))
    return columns, open_[:, columns], verdict


def _best(cap: int | None) -> Callable[[Iterator[pa.RecordBatch], Block], Iterator[pa.RecordBatch]]:
    """The function that a task runs over its tiles: hits, and one row of counts a request (track_id null)."""

    def run(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
        best, where = Best(block, cap), {}
        for i, name in enumerate(block.ids):
            where.setdefault(name, []).append(i)
        paths, filtered = list(block.paths), bool(block.active.any())
        counts = np.zeros((len(block.ids), 3), np.int64)
        for tile in _tiles(batches):
            order = {s: j for j, s in enumerate(tile.ids.to_pylist())} if any(block.seeds) else {}
            for start in range(0, len(block.ids), CHUNK):
                rows = np.arange(start, min(start + CHUNK, len(block.ids)))
                columns, open_, verdict = _candidates(tile, block, rows, where, filtered)
                counts[rows, 1] += (verdict == 2).sum(1)
                counts[rows, 2] += (verdict == 1).sum(1)
                own = {i: order[block.seeds[r]] for i, r in enumerate(rows.tolist()) if block.seeds[r] in order}
                for i, t in own.items():
                    # the seed is neither a candidate nor hidden
                    if verdict[i, t]:
                        counts[rows[i], verdict[i, t] == 1 and 2 or 1] -= 1
                    at = np.searchsorted(columns, t)
                    if at < len(columns) and columns[at] == t:
                        open_[i, at] = False
                counts[rows, 0] += open_.sum(1)
                if not len(columns):
                    continue
                cosines = [tile.cosines(block, p, rows, columns) for p in paths]
                if block.z:
                    score = sum(np.where(dev < 1e-9, 0.0, (c.astype(np.float64) - mean) / np.where(dev < 1e-9, 1.0, dev)) for c, (mean, dev) in ((c, (block.z[p][0][rows][:, None], block.z[p][1][rows][:, None])) for c, p in zip(cosines, paths)))
                else:
                    score = cosines[0].astype(np.float64)
                score[~open_] = -np.inf
                for i in np.flatnonzero((score >= best.least[rows][:, None]).any(1)).tolist():
                    good = np.flatnonzero(open_[i])
                    if len(good):
                        best.add(int(rows[i]), tile, columns[good], score[i, good], [c[i, good] for c in cosines])
        out = []
        for i, name in enumerate(block.ids):
            for neg, track, artist, *own in best.rows[i]:
                by = dict(zip(paths, own))
                out.append((name, track, artist, -neg, by.get("q_vector"), by.get("s_vector"), None, None, None))
            out.append((name, None, None, None, None, None, *map(int, counts[i])))
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 10_000]), _HIT)], schema=_HIT)

    return run


_STAT = pa.schema([("query_id", pa.string()), ("path", pa.string()), ("n", pa.int64()), ("mean", pa.float64()), ("squares", pa.float64())])


def _statistics(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """Count, mean and squared deviations of each request's cosines over a task's tracks, by path."""
    n, totals = 0, {p: (np.zeros(len(block.ids)), np.zeros(len(block.ids))) for p in block.paths}
    for tile in _tiles(batches):
        m, columns = len(tile.ids), np.arange(len(tile.ids))
        for p, (mean, squares) in totals.items():
            for start in range(0, len(block.ids), CHUNK):
                rows = np.arange(start, min(start + CHUNK, len(block.ids)))
                c = tile.cosines(block, p, rows, columns).astype(np.float64)
                own = c.mean(1)
                gap = own - mean[rows]
                squares[rows] += ((c - own[:, None]) ** 2).sum(1) + gap * gap * n * m / (n + m)
                mean[rows] += gap * m / (n + m)
        n += m
    if n:
        for p, (mean, squares) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.string()), pa.array([p] * len(block.ids)), pa.array(np.full(len(block.ids), n)), pa.array(mean), pa.array(squares)], schema=_STAT)


_COUNT = pa.schema([("query_id", pa.string()), ("track_id", pa.string()), ("query_before", pa.int64()), ("seed_before", pa.int64())])


def _before(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """For each chosen track of each request, how many candidates of a task come before it on either path; the seed counts on the query's alone."""
    where: dict[str, list[int]] = {}
    for i, name in enumerate(block.ids):
        where.setdefault(name, []).append(i)
    counts = [np.zeros((len(c), 2), np.int64) for c in block.chosen]
    filtered = bool(block.active.any())
    for tile in _tiles(batches):
        ids = tile.ids.to_pylist()
        order = {s: j for j, s in enumerate(ids)}
        for start in range(0, len(block.ids), CHUNK):
            rows = np.arange(start, min(start + CHUNK, len(block.ids)))
            columns, open_, _ = _candidates(tile, block, rows, where, filtered)
            if not len(columns):
                continue
            cosines = [tile.cosines(block, p, rows, columns) for p in ("q_vector", "s_vector")]
            names = np.array(ids, object)[columns]
            for i, r in enumerate(rows.tolist()):
                seed = order.get(block.seeds[r])
                for c, chosen in enumerate(block.chosen[r]):
                    first = names < chosen["track_id"]
                    for j, value in enumerate((chosen["query_cosine"], chosen["seed_cosine"])):
                        value = np.float32(value)
                        ahead = open_[i] & ((cosines[j][i] > value) | ((cosines[j][i] == value) & first))
                        if j and seed is not None:
                            ahead &= columns != seed
                        counts[r][c, j] += ahead.sum()
    out = [(name, c["track_id"], int(n[0]), int(n[1])) for name, chosen, own in zip(block.ids, block.chosen, counts) for c, n in zip(chosen, own)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _COUNT)], schema=_COUNT)


def _blocks(requests: DataFrame, k: int) -> list[DataFrame]:
    most = max(1, min(BLOCK, KEPT // k))
    if few(requests, most):
        return [requests]
    parts = 2 * -(-requests.count() // most)
    keyed = requests.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    return [keyed.where(F.col("__block") == b).drop("__block") for b in range(parts)]


def _over_tiles(requests: DataFrame, tracks: DataFrame, paths: tuple[str, ...], k: int, run, schema: str) -> DataFrame:
    """What run() gives over the tiles of tracks that are of one length with the requests, block after block of requests."""
    spark = tracks.sparkSession
    sizes = [r["n"] for r in requests.select(F.size(paths[0]).alias("n")).distinct().collect()]
    out, single = None, None
    blocks = [(size, b) for size in sizes for b in _blocks(requests.where((F.size(paths[0]) == size) & (F.size(paths[-1]) == size)), k)]
    for size, rows in blocks:
        block = _load(rows, paths, k)
        if not block.ids:
            continue
        shared = spark.sparkContext.broadcast(block)
        part = tracks.where(F.size("vector") == size).mapInArrow(lambda batches, shared=shared: run(batches, shared.value), schema)
        if len(blocks) > 1:
            part = written(part, "block")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _usable_requests(requests: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    good = usable(paths[0])
    for p in paths[1:]:
        good = good & usable(p)
    return requests.where(good)


def _tracks(catalog: DataFrame, attributes: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    tracks = coded_tracks(catalog.where(usable("vector")), attributes)
    if exclude is not None:
        gone = exclude.groupBy("track_id").agg(F.collect_set("query_id").alias("gone"))
        tracks = tracks.join(gone, "track_id", "left")
    return tracks


def statistics(requests: DataFrame, catalog: DataFrame, paths: tuple[str, ...] = ("q_vector", "s_vector")) -> DataFrame:
    """query_id, mean_<path>, dev_<path> of each request's cosines over the whole catalog (population deviation); a few numbers a request and task are shuffled."""
    parts = written(_over_tiles(_usable_requests(requests, paths), _tracks(catalog, None, None), paths, 10, _statistics, "query_id string, path string, n bigint, mean double, squares double"), "statistics")
    whole = parts.groupBy("query_id", "path").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("whole"))
    joined = parts.join(whole, ["query_id", "path"]).groupBy("query_id", "path").agg(F.first("whole").alias("mean"), F.sqrt(F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("whole"), 2)) / F.sum("n")).alias("dev"))
    return joined.groupBy("query_id").agg(*[F.max(F.when(F.col("path") == p, F.col(c))).alias(f"{c}_{p}") for p in paths for c in ("mean", "dev")])


def top_k(requests: DataFrame, catalog: DataFrame, k: int, paths: tuple[str, ...] = ("q_vector",), attributes: DataFrame | None = None, exclude: DataFrame | None = None, max_per_artist: int | None = None) -> DataFrame:
    """Rows of HIT: the best tracks of each request a task, and a row of counts a request and task (track_id null); see ranked() and counted().

    requests: query_id, a vector a path, and where wanted filters, k, seed_id (which is left out), means and deviations of the paths. exclude: (query_id, track_id).
    """
    if k < 1 or (max_per_artist is not None and max_per_artist < 1):
        raise TunesparkError("k and max_per_artist must be at least 1")
    return _over_tiles(_usable_requests(requests, paths), _tracks(catalog, attributes, exclude), paths, k, _best(max_per_artist), HIT)


def ranked(hits: DataFrame, k: int, max_per_artist: int | None = None) -> DataFrame:
    """The lists of all tasks as one a request, with ranks."""
    rows = hits.where("track_id is not null").select("query_id", "track_id", "artist_key", "score", "query_cosine", "seed_cosine")
    best = [F.desc("score"), F.asc("track_id")]
    if max_per_artist is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "artist_key").orderBy(*best))).where(F.col("__n") <= max_per_artist).drop("__n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)


def counted(hits: DataFrame) -> DataFrame:
    """query_id, of (candidates), hidden_mismatch, hidden_unknown."""
    return hits.where("track_id is null").groupBy("query_id").agg(F.sum("n").alias("of"), F.sum("mismatch").alias("hidden_mismatch"), F.sum("unknown").alias("hidden_unknown"))


def path_ranks(chosen: DataFrame, requests: DataFrame, catalog: DataFrame, attributes: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """query_id, track_id, query_rank, seed_rank of chosen blend rows (query_id, track_id, query_cosine, seed_cosine), among all candidates and without the artist cap."""
    paths = ("q_vector", "s_vector")
    lists = chosen.groupBy("query_id").agg(F.collect_list(F.struct("track_id", "query_cosine", "seed_cosine")).alias("chosen"))
    asked = _usable_requests(requests, paths).join(lists, "query_id")
    counts = _over_tiles(asked, _tracks(catalog, attributes, exclude), paths, V.MAX_K, _before, "query_id string, track_id string, query_before bigint, seed_before bigint")
    return counts.groupBy("query_id", "track_id").agg((F.sum("query_before") + 1).alias("query_rank"), (F.sum("seed_before") + 1).alias("seed_rank"))
