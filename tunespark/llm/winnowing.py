"""Benchmark decontamination by winnowing.

Words are hashed straight from the bytes of a batch of texts. In each window of ten words the five-word run of least hash (the last one of equals) is
kept; a window's choice depends on its words alone, so every span of ten words that a document shares with a benchmark item has the same
fingerprint on both sides. Fingerprints are joined and hits extended to the window that chose them: a second hash of all its words, with other
constants, must agree (128 bits in all). Benchmark items under ten words have one window, all their words. Words covered by such windows are hit.

The documents' fingerprints are screened by a bit filter of the benchmark's (bounded size) where the text is read; only those that pass are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import materialize, mix

WINDOW, GRAM = 10, 5
#: Bytes of texts worked on at a time (a longer text goes alone), and bytes hashed at a time.
BATCH_BYTES, HASH_BYTES = 2 << 20, 1 << 20
#: Bits of the filter: so many a fingerprint of the benchmark, within these powers of two (16 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 27
#: Windows of the benchmark up to which they are broadcast (24 bytes each), else both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up, down = np.full(size, factor, np.uint64), np.full(size, pow(factor, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=2)
def _letters(factor: int) -> np.ndarray:
    """A number for each byte, the same for A-Z and a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor))
    table[65:91] = table[97:123]
    return table


_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


class Words:
    """The words of some texts that lie one after the other in `data`: text of each word, and two hashes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        inside = _IS_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = edge[0] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        self.ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        self.starts = starts
        self.counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
        self.text = np.repeat(np.arange(len(ends)), self.counts)
        self.data = data
        self.hashes = [self._hash(f) for f in FACTORS]

    def _hash(self, factor: int) -> np.ndarray:
        out, letters = np.zeros(len(self.starts), np.uint64), _letters(factor)
        i = 0
        while i < len(out):
            begin = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, begin + HASH_BYTES, "right")))
            size = int(self.ends[j - 1]) - begin
            up, down = _powers(factor, max(HASH_BYTES, 1 << (size - 1).bit_length()))
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(letters[self.data[begin : begin + size]] * up[:size], out=sums[1:])
            at = self.starts[i:j] - begin
            out[i:j] = (sums[self.ends[i:j] - begin] - sums[at]) * down[at]
            i = j
        return mix(out)

    def runs(self, which: int, size: int) -> np.ndarray:
        """A hash of each run of `size` words, wherever it begins."""
        n, h = max(0, len(self.text) - size + 1), self.hashes[which]
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out = out * np.uint64(FACTORS[which]) + h[j : j + n]
        return mix(out)

    def within(self, size: int) -> np.ndarray:
        """Where runs of `size` words begin that lie in one text."""
        n = max(0, len(self.text) - size + 1)
        return np.flatnonzero(self.text[:n] == self.text[size - 1 : size - 1 + n])

    def windows(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each window that lies in one text, the fingerprint it chooses, and a hash of all its words."""
        begin = self.within(size)
        grams = self.runs(0, gram)
        best = grams[begin]
        for j in range(1, size - gram + 1):
            best = np.minimum(best, grams[begin + j])
        return begin, best, self.runs(1, size)[begin]


def batched(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """Words of a column's texts, a bounded number of bytes at a time, with the number of the first text."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BATCH_BYTES, "right")) - 1)
        yield i, Words(raw[bounds[i] : bounds[j]], bounds[i + 1 : j + 1] - bounds[i])
        i = j


def benchmark_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id, size, fingerprint, words (a hash of the window) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in batched(batch.column("text")):
                parts = [(window, *words.windows(window, gram))]
                stops = np.cumsum(words.counts)
                for size in set(words.counts[(words.counts > 0) & (words.counts < window)].tolist()):
                    begin = (stops - size)[words.counts == size]
                    parts.append((size, begin, words.runs(0, size)[begin], words.runs(1, size)[begin]))
                for size, begin, chosen, whole in parts:
                    ids = batch.column("item_id").take(pa.array(first + words.text[begin]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(begin), size, np.int32)), pa.array(chosen.view(np.int64)), pa.array(whole.view(np.int64))], names=["item_id", "size", "fingerprint", "words"])

    source = items.select("item_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"item_id {source.schema['item_id'].dataType.simpleString()}, size int, fingerprint bigint, words bigint")


def bit_filter(windows: DataFrame) -> np.ndarray:
    """The fingerprints as bits of a table of at most 16 MB; only its words that are not zero come to the driver."""
    fingerprints = windows.select("fingerprint").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * fingerprints.count()).bit_length()))
    place = F.col("fingerprint").bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, CAST(fingerprint & {63} AS INT))")
    out = np.zeros(1 << (bits - 6), np.uint64)
    rows = fingerprints.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def screen(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """doc_id, n_words and `found`: the windows (at, fingerprint, words) whose fingerprint passes the filter; sizes: those of shorter items."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("fingerprint", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        last = np.uint64(len(table) * 64 - 1)
        for batch in batches:
            for first, words in batched(batch.column("text")):
                n, at, chosen, whole = len(words.counts), [], [], []
                for size in [window, *sizes]:
                    if size == window:
                        begin, prints, hashes = words.windows(window, gram)
                    else:
                        begin = words.within(size)
                        prints, hashes = words.runs(0, size)[begin], words.runs(1, size)[begin]
                    place = prints & last
                    good = (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                    at.append(begin[good])
                    chosen.append(prints[good])
                    whole.append(hashes[good])
                begin = np.concatenate(at)
                owner = words.text[begin]
                order = np.argsort(owner, kind="stable")
                before = np.cumsum(words.counts) - words.counts
                cells = pa.StructArray.from_arrays(
                    [pa.array((begin - before[owner])[order].astype(np.int32)), pa.array(np.concatenate(chosen)[order].view(np.int64)), pa.array(np.concatenate(whole)[order].view(np.int64))],
                    fields=list(kind.value_type),
                )
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), cells).cast(kind)], names=["doc_id", "n_words", "found"])

    source = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words bigint, found array<struct<at:int,fingerprint:bigint,words:bigint>>")


def _covered(rows: DataFrame) -> DataFrame:
    """row, spans: the windows of a row (at, size) as spans of words that don't touch."""

    def merge(cells: list) -> list:
        out: list[tuple[int, int]] = []
        for at, stop in sorted((c["at"], c["at"] + c["size"]) for c in cells):
            if out and at <= out[-1][1]:
                out[-1] = (out[-1][0], max(stop, out[-1][1]))
            else:
                out.append((at, stop))
        return [{"from": a, "to": b} for a, b in out]

    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([merge(x) for x in batch.column("cells").to_pylist()], kind)], names=["row", "spans"])

    return rows.groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("cells")).mapInArrow(run, "row bigint, spans array<struct<from:int,to:int>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans (array of from, to: words hit, counted from 0), items (item_ids as strings, sorted) of every document.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; an empty table gives no rows. Repeated rows are judged one by one,
    with or without a doc_id. A repeated item counts once by its item_id; an item without one marks words but isn't listed. Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, window, gram), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect() if r["size"] < window)
    rows = materialize(screen(docs, bit_filter(windows), sizes, window, gram, text).withColumn("row", F.monotonically_increasing_id()), "screened")
    key = ["fingerprint", "words"]
    known = windows.select(*key, "size").distinct()
    small = windows.count() <= BROADCAST_WINDOWS
    asked = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.*")
    hits = materialize(asked.join(F.broadcast(known) if small else known, key).select("row", "at", "size", *key), "hits")
    owners = windows.where("item_id is not null").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    listed = hits.select("row", *key).distinct().join(F.broadcast(owners) if small else owners, key).select("row", "item").distinct()
    per_row = _covered(hits).join(listed.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")), "row", "left")
    none = F.lit([]).cast("array<struct<from:int,to:int>>")
    out = rows.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.lit([]).cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: float = 0.0, **how) -> DataFrame:
    """The rows of docs, all columns, whose share of words hit is at most `most`; doc_id must name a row."""
    judged = contamination(docs, benchmark, **how)
    bad = judged.where((F.col("n_hit") > 0) & (F.col("n_hit") > F.lit(most) * F.col("n_words"))).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
