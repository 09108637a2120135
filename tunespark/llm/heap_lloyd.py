"""Vector codes by product quantization, with Lloyd's rounds kept short by heaps.

Vectors are cut into parts of whole numbers; each part position has a codebook, and a code names each part's nearest entry. Vectors lie in blocks, one row
each, that carry, for each entry, a heap of the parts assigned to it. A part's key is its slack when it was last compared: the distance to the second
nearest entry less that to its own, plus all drift of its entry up to then. Entries drift as their codebook is updated: a part's own
entry by its own way, any other by the longest way of the others. While a part's key exceeds its entry's cumulative drift, no other entry can have come
closer or level, so its heap isn't entered below it: each round pops the violated parts only and compares them anew, exactly, with all entries.
Blocks report by how much their sums have changed; those are added up, a bounded table of numbers, and make the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import discard, join_sized, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block at most, and bytes of their components.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Largest component, as a whole number: squared distances of parts of up to 512 components stay whole in 64 bits.
LARGEST = 1 << 26
#: What the doubles of bounds and drifts can be off by, against the sizes that they are made of.
ROUNDING = 1e-9

STATE = "size int, bytes int, x binary, keys binary, members binary, lengths binary, delta binary"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    out = np.floor(x.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component times {scale} lies beyond {LARGEST}: squared distances would not be exact")
    return out.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (the first of equals), and the two least squared distances."""
    gaps = x[:, None, :].astype(np.int64) - entries[None]
    d = np.einsum("ijk,ijk->ij", gaps, gaps)
    best = d.argmin(1)
    rows = np.arange(len(d))
    least = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    return best, np.stack([least, d.min(1)], axis=1)


class Block:
    """The vectors of a block [row, position, component] and a heap for each position and entry."""

    def __init__(self, x: np.ndarray, entries: int):
        self.x, self.entries = x, entries
        self.parts, self.width = x.shape[1], x.shape[2]
        none = np.zeros(0), np.zeros(0, np.int32)
        self.heaps: list[tuple[np.ndarray, np.ndarray]] = [none] * (self.parts * entries)
        self.delta = np.zeros((self.parts, entries, self.width + 1), np.int64)

    @classmethod
    def load(cls, row: dict, parts: int, entries: int) -> Block:
        x = np.frombuffer(row["x"], f"<i{row['bytes']}").reshape(row["size"], parts, -1)
        block = cls(x, entries)
        stops = np.cumsum(np.frombuffer(row["lengths"], np.int32))[:-1]
        keys, members = np.frombuffer(row["keys"], np.float64), np.frombuffer(row["members"], np.int32)
        block.heaps = list(zip(np.split(keys, stops), np.split(members, stops)))
        return block

    def assignment(self) -> np.ndarray:
        out = np.zeros((len(self.x), self.parts), np.int64)
        for h, (_, members) in enumerate(self.heaps):
            out[members, h // self.entries] = h % self.entries
        return out

    def start(self, codebooks: np.ndarray) -> None:
        """Compare every part and lay out the heaps (sorted keys are a heap); no drift so far."""
        for p in range(self.parts):
            best, d = nearest(self.x[:, p], codebooks[p])
            keys = self._keys(d)
            for c in range(self.entries):
                own = np.flatnonzero(best == c)
                own = own[np.argsort(keys[own], kind="stable")]
                self.heaps[p * self.entries + c] = keys[own], own.astype(np.int32)
                self._move(p, c, own, 1)

    def round(self, codebooks: np.ndarray, drift: np.ndarray) -> int:
        """Compare the parts whose keys the drift has reached; how many those were."""
        lists: dict[int, list[tuple[float, int]]] = {}

        def heap(h: int) -> list[tuple[float, int]]:
            if h not in lists:
                lists[h] = list(zip(self.heaps[h][0].tolist(), self.heaps[h][1].tolist()))
            return lists[h]

        count = 0
        for p in range(self.parts):
            popped, before = [], []
            for c in range(self.entries):
                h, reached = p * self.entries + c, float(drift[p, c])
                if len(self.heaps[h][0]) and self.heaps[h][0][0] <= reached:
                    own, n = heap(h), len(popped)
                    while own and own[0][0] <= reached:
                        popped.append(heappop(own)[1])
                    before += [c] * (len(popped) - n)
            if not popped:
                continue
            count += len(popped)
            rows, old = np.array(popped), np.array(before)
            best, d = nearest(self.x[rows, p], codebooks[p])
            keys = self._keys(d) + drift[p, best]
            for key, i, c in zip(keys.tolist(), popped, best.tolist()):
                heappush(heap(p * self.entries + c), (key, i))
            moved = best != old
            for c in range(self.entries):
                self._move(p, c, rows[moved & (old == c)], -1)
                self._move(p, c, rows[moved & (best == c)], 1)
        for h, own in lists.items():
            self.heaps[h] = np.array([k for k, _ in own], np.float64), np.array([i for _, i in own], np.int32)
        return count

    @staticmethod
    def _keys(d: np.ndarray) -> np.ndarray:
        near, second = np.sqrt(d[:, 0].astype(np.float64)), np.sqrt(d[:, 1].astype(np.float64))
        return second - near - ROUNDING * (second + near + 1)

    def _move(self, p: int, c: int, rows: np.ndarray, sign: int) -> None:
        if len(rows):
            self.delta[p, c, :-1] += sign * self.x[rows, p].sum(0, dtype=np.int64)
            self.delta[p, c, -1] += sign * len(rows)

    def state(self) -> list:
        keys, members = (np.concatenate([h[i] for h in self.heaps]).tobytes() for i in (0, 1))
        lengths = np.array([len(k) for k, _ in self.heaps], np.int32)
        return [len(self.x), self.x.dtype.itemsize, self.x.tobytes(), keys, members, lengths.tobytes(), self.delta.tobytes()]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if not x.size or np.abs(x).max() < 1 << 15 else x.astype(np.int32)


def _batch(rows: pa.Array, states: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows, *(pa.array(x, f.type) for x, f in zip(zip(*states), list(schema)[1:]))], names=schema.names)


_STATE_ARROW = pa.schema([("rows", pa.null()), ("size", pa.int32()), ("bytes", pa.int32()), *((c, pa.binary()) for c in ("x", "keys", "members", "lengths", "delta"))])


def _begin(vectors: DataFrame, parts: int, scale: int, codebooks: np.ndarray) -> DataFrame:
    """Blocks of vectors as they lie in their partitions, every part compared with the first codebooks."""
    entries, kinds = codebooks.shape[1], [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * parts * codebooks.shape[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                own = batch.slice(i, most)
                x = whole(own.column("embedding").flatten().to_numpy(zero_copy_only=False), scale)
                block = Block(_narrow(x).reshape(own.num_rows, parts, -1), entries)
                block.start(codebooks)
                cells = pa.StructArray.from_arrays([own.column("vec_id"), own.column("label")], names=["vec_id", "label"])
                rows = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), cells)
                yield _batch(rows, [block.state()], _STATE_ARROW)

    return vectors.mapInArrow(run, f"rows array<struct<vec_id:{kinds[0]},label:{kinds[1]}>>, {STATE}")


def _round(blocks: DataFrame, parts: int, codebooks: np.ndarray, drift: np.ndarray) -> DataFrame:
    entries = codebooks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.load({c: batch.column(c)[i].as_py() for c in ("size", "bytes", "x", "keys", "members", "lengths")}, parts, entries)
                block.round(codebooks, drift)
                yield _batch(batch.column("rows").slice(i, 1), [block.state()], _STATE_ARROW)

    return blocks.mapInArrow(run, blocks.schema)


def _changes(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """By how much the blocks' sums and counts have changed: one number for each of the codebooks' components and entries."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("delta").to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "change"])

    out = np.zeros(size, np.int64)
    for r in blocks.select("delta").mapInArrow(run, "at int, change bigint").groupBy("at").agg(F.sum("change").alias("change")).collect():
        out[r["at"]] = r["change"]
    return out.reshape(shape)


def _finish(blocks: DataFrame, parts: int, codebooks: np.ndarray, drift: np.ndarray) -> DataFrame:
    entries = codebooks.shape[1]
    cell = blocks.schema["rows"].dataType.elementType
    kinds = ", ".join(f"{c} {cell[c].dataType.simpleString()}" for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.load({c: batch.column(c)[i].as_py() for c in ("size", "bytes", "x", "keys", "members", "lengths")}, parts, entries)
                block.round(codebooks, drift)
                chosen = block.assignment()
                gaps = block.x.astype(np.int64) - codebooks[np.arange(parts), chosen]
                hexed = chosen.astype(np.uint8).tobytes().hex()
                codes = [hexed[j : j + 2 * parts] for j in range(0, len(hexed), 2 * parts)]
                rows = batch.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([rows.field("vec_id"), rows.field("label"), pa.array(codes, pa.string()), pa.array((gaps * gaps).sum((1, 2)))], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"{kinds}, code string, error bigint")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector, and the codebooks [position, entry, component].

    Vectors that are null or hold null or non-finite components are left out. The codebooks start as the parts of the first `entries` rows in the order of
    vec_id (nulls last) and vector; of fewer rows, fewer entries. Repeated rows are coded as often as they occur. Vectors of another length than the
    first row's have a null code and error. A length that can't be cut into so many parts is an error, as are components beyond LARGEST / scale.
    An empty table gives no rows and empty codebooks. Other columns are ignored.
    """
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.select("vec_id", "label", "embedding").where(F.coalesce(sound, F.lit(False)))
    seeds = [r["embedding"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    label_kind, id_kind = (kept.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    if not seeds:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_kind}, label {label_kind}, code string, error bigint"), np.zeros((parts, 0, 0), np.int64)
    dims = len(seeds[0])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    first = np.array([x for x in seeds if len(x) == dims], np.float64)
    codebooks = whole(first, scale).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    other = kept.where(F.size("embedding") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    drift = np.zeros(codebooks.shape[:2])
    sums = np.zeros((*codebooks.shape[:2], dims // parts + 1), np.int64)
    blocks = materialize(_begin(kept.where(F.size("embedding") == dims), parts, scale, codebooks), "blocks")
    for r in range(rounds):
        if r:
            blocks, old = materialize(_round(blocks, parts, codebooks, drift), "blocks"), blocks
            discard(old)
        sums += _changes(blocks, sums.shape)
        counts = sums[:, :, -1:]
        before, codebooks = codebooks, np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), codebooks)
        drift = drift + drifts(before, codebooks)
    coded = materialize(_finish(blocks, parts, codebooks, drift), "coded")
    discard(blocks)
    return coded.unionByName(other), codebooks


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far a part's slack can have shrunk: its entry's way and the longest way of another entry of the position, rounded up."""
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(-1))
    if way.shape[1] == 1:
        return np.zeros_like(way)
    order = np.sort(way, axis=1)
    # an entry that alone goes furthest is held against the second furthest
    alone = (way == order[:, -1:]) & (order[:, -1:] > order[:, -2:-1])
    longest = np.where(alone, order[:, -2:-1], order[:, -1:])
    return (way + longest) * (1 + ROUNDING)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over the rows of its label, rows without one together."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("none"))
    rows = coded.withColumn("__label", key)
    keyed = rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("size"))
    return join_sized(rows, keyed, "__label").drop("__label", "size")


def decode(coded: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """coded with `decoded`: the vector that a code stands for (the middle of each whole number's cell)."""
    shared = coded.sparkSession.sparkContext.broadcast((codebooks + 0.5) / scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            vectors = [None if c is None else books[np.arange(len(books)), list(bytes.fromhex(c))].ravel().astype(np.float32) for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + ", decoded array<float>")
