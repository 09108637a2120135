"""A trie of conversation prefixes by an external mergesort that knows common prefixes.

Turns become digests of 16 bytes where they are read, so that a conversation is a short byte string; equal conversations become one row with a
count before anything is sorted by content. Rows are dealt into ranges of that string. In each range sorted runs carry the length of the prefix that each
row shares with the one before it (spilled to disk beyond a bound); a loser tree merges them and compares two rows only beyond what both share with the
last row that came out. The merged rows keep a stack of open nodes: those deeper than the shared prefix are finished. Nodes on the first and the last path of a
range may go on in the ranges beside it: they carry a key, are added up by it, and what was counted twice is taken off along those paths.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import discard, materialize

#: Bytes of a turn's digest; conversations that share their first turns, and one more than the most turns that they can share.
DIGEST, HUNDRED, MOST_SHARED = 16, 100, 6
#: Turns packed into a row at most; ids written into a row at most; turns by which ranges are cut.
CHUNK, IDS, RANGE_TURNS = 4096, 65_536, 1024
#: Bytes of rows sorted as one run; bytes of finished nodes kept in memory; rows of a batch that goes out.
RUN_BYTES, SPOOL_BYTES, OUT_ROWS = 16 << 20, 32 << 20, 8192
#: Nodes on range borders up to which they are broadcast (under 100 bytes each).
BROADCAST_BORDERS = 500_000
NONE = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------------------------------------ conversations as byte strings


def packed_turns(conversations: DataFrame, chunk: int) -> DataFrame:
    """base, conv_id, first_turn, first_digest, number, digests, sizes: runs of about `chunk` turns, however many turns a conversation has."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), digest.alias("digest"), F.char_length(text).alias("size"))
    dealt = turns.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number = None, 0

        def close() -> tuple:
            nonlocal number
            number += 1
            conv, turn, first, digests, sizes = open_
            return conv - int(np.fmod(conv, HUNDRED)), conv, turn, first, number, b"".join(digests), b"".join(sizes)

        for batch in batches:
            out, ids = [], batch.column("conv_id").to_numpy()
            digests, sizes = b"".join(batch.column("digest").to_pylist()), batch.column("size").to_numpy().astype("<i4").tobytes()
            turns = batch.column("turn").to_pylist()
            cuts = sorted({0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), *range(0, len(ids), chunk)})
            for a, b in zip(cuts, [*cuts[1:], len(ids)]):
                if a == b:
                    continue
                if open_ and (open_[0] != ids[a] or sum(map(len, open_[4])) >= 4 * chunk):
                    out.append(close())
                    open_ = None
                if open_ is None:
                    open_ = int(ids[a]), turns[a], digests[DIGEST * a : DIGEST * (a + 1)], [], []
                open_[3].append(digests[DIGEST * a : DIGEST * b])
                open_[4].append(sizes[4 * a : 4 * b])
            if out:
                yield _rows(out, _PACKED)
        if open_:
            yield _rows([close()], _PACKED)

    return dealt.mapInArrow(run, "base bigint, conv_id bigint, first_turn bigint, first_digest binary, number bigint, digests binary, sizes binary")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PACKED = pa.schema([("base", pa.int64()), ("conv_id", pa.int64()), ("first_turn", pa.int64()), ("first_digest", pa.binary()), ("number", pa.int64()), ("digests", pa.binary()), ("sizes", pa.binary())])
_REBUILT = pa.schema([("conv_id", pa.int64()), ("class", pa.binary()), ("path", pa.binary()), ("sizes", pa.binary())])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, class (a digest of the whole), path (its turns' digests), sizes: each conversation with the first turns of the first of its hundred.

    The number of turns taken over is crc32 of the decimal id modulo MOST_SHARED. The first of a hundred is read before the others of it.
    """
    packed = packed_turns(conversations, CHUNK)
    dealt = packed.repartition("base").withColumn("follows", F.col("conv_id") != F.col("base"))
    dealt = dealt.sortWithinPartitions("base", "follows", "conv_id", F.col("first_turn").asc_nulls_first(), "first_digest", "number").select("base", "conv_id", "digests", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_of, head, now, parts = None, (b"", b""), None, ([], [])
        out: list[tuple] = []

        def close() -> None:
            nonlocal head_of, head
            base, conv = now
            digests, sizes = b"".join(parts[0]), b"".join(parts[1])
            if base != head_of:
                head_of, head = base, (b"", b"")
            if base == conv:
                head = digests[: DIGEST * MOST_SHARED], sizes[: 4 * MOST_SHARED]
            h = zlib.crc32(str(conv).encode()) % MOST_SHARED
            path = head[0][: DIGEST * h] + digests[DIGEST * h :]
            out.append((conv, hashlib.sha256(path).digest()[:DIGEST], path, head[1][: 4 * h] + sizes[4 * h :]))

        for batch in batches:
            for base, conv, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "digests", "sizes"))):
                if now is not None and now != (base, conv):
                    close()
                    parts = [], []
                now = base, conv
                parts[0].append(digests)
                parts[1].append(sizes)
            if out:
                yield _rows(out, _REBUILT)
                out.clear()
        if now is not None:
            close()
            yield _rows(out, _REBUILT)

    return dealt.mapInArrow(run, "conv_id bigint, class binary, path binary, sizes binary")


# ------------------------------------------------------------------------------------------------ members of equal conversations


_CLASS = pa.schema([("class", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.string())])


def classes(members: DataFrame, most: int) -> DataFrame:
    """class, least (its smallest id), n, ends_sha256 of the members' ids in numeric order.

    Ids are dealt by (class, id), so that a class of any size is spread: a class inside a range is done there; one that reaches a border, or has more than
    `most` ids, is written as rows of joined ids, and only those few rows meet, in order, under a running hash.
    """
    dealt = members.select("class", "conv_id").repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, first, split = None, [], True, False
        out: list[tuple] = []

        def close(border: bool) -> None:
            text = ",".join(map(str, ids))
            done = not (border or split or first)
            out.append((now, ids[0], len(ids), hashlib.sha256(text.encode()).hexdigest() if done else None, None if done else text))

        for batch in batches:
            for name, conv in zip(batch.column("class").to_pylist(), batch.column("conv_id").to_pylist()):
                if name != now:
                    if now is not None:
                        close(False)
                        first = False
                    now, ids, split = name, [], False
                elif len(ids) == most:
                    split = True
                    close(False)
                    ids = []
                ids.append(conv)
            if out:
                yield _rows(out, _CLASS)
                out.clear()
        if now is not None:
            close(True)
            yield _rows(out, _CLASS)

    parts = materialize(dealt.mapInArrow(run, "class binary, least bigint, n bigint, ends_sha256 string, ids string"), "members")
    split = parts.where("ids is not null").repartition("class").sortWithinPartitions("class", "least")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, n, sha = None, 0, 0, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["class"] != now:
                    if now is not None:
                        out.append((now, least, n, sha.hexdigest(), None))
                    now, least, n, sha = r["class"], r["least"], 0, hashlib.sha256()
                sha.update((("," if n else "") + r["ids"]).encode())
                n += r["n"]
            if out:
                yield _rows(out, _CLASS)
        if now is not None:
            yield _rows([(now, least, n, sha.hexdigest(), None)], _CLASS)

    return parts.where("ids is null").unionByName(split.mapInArrow(join, parts.schema)).drop("ids")


# ------------------------------------------------------------------------------------------------ mergesort


Row = tuple[bytes, bytes, int, int, str]


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, of which `known` need no comparison."""
    i, n = known * DIGEST, min(len(a), len(b))
    while i < n and a[i : i + DIGEST] == b[i : i + DIGEST]:
        i += DIGEST
    return i // DIGEST


def sorted_run(rows: list[Row]) -> Iterator[tuple[int, Row]]:
    """Rows by path, each with the number of turns that it shares with the one before."""
    before = b""
    for row in sorted(rows):
        yield shared(before, row[0]), row
        before = row[0]


def spilled(run: Iterable[tuple[int, Row]]) -> Iterator[tuple[int, Row]]:
    """The run by way of a file of its own, which goes with it."""
    with tempfile.TemporaryFile() as file:
        part: list = []
        for x in run:
            part.append(x)
            if len(part) == 512:
                pickle.dump(part, file, -1)
                part = []
        pickle.dump(part, file, -1)
        file.seek(0)
        yield None
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                return


def merge(runs: list[Iterator[tuple[int, Row]]]) -> Iterator[tuple[int, Row]]:
    """The runs as one, by a loser tree: each loser knows what it shares with the row that beat it, which is all that came out before it must be compared with."""
    heads = [next(r, None) for r in runs]
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    heads += [None] * (leaves - len(runs))
    losers = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; what the loser shares is set to what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        both = shared(x[1][0], y[1][0], x[0])
        if x[1][0] <= y[1][0]:
            heads[b] = both, y[1]
            return a, b
        heads[a] = both, x[1]
        return b, a

    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if leaves > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        node = (best + leaves) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Row]]:
    """All rows of a task by path, with what each shares with the one before; at most one run is in memory besides the heads of the others."""
    runs, rows, size = [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "least", "n", "ends_sha256"))):
            rows.append(row)
            size += len(row[0]) + len(row[1]) + 200
            if size > RUN_BYTES:
                runs.append(spilled(sorted_run(rows)))
                next(runs[-1])
                rows, size = [], 0
    return merge([*runs, sorted_run(rows)])


# ------------------------------------------------------------------------------------------------ nodes


NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, size bigint, key binary, parent_key binary"
_NODE = pa.schema([*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("size", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary())])


def keys_of(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, the empty one first."""
    sha = hashlib.sha256()
    out = [sha.digest()[:DIGEST]]
    for i in range(0, len(path), DIGEST):
        sha.update(path[i : i + DIGEST])
        out.append(sha.copy().digest()[:DIGEST])
    return out


def finished(rows: Iterator[tuple[int, Row]], emit) -> tuple[bytes, bytes]:
    """Give emit() each node once its subtree is over: (conv_id, depth, n_convs, n_children, n_leaves, saved, ends, size, on the first path, on the last).

    Returns the first and the last path.
    """
    first = last = None
    # open nodes from the root down: [least, n, children, leaves, saved, ends, size, on the first path]
    stack: list[list] = []

    def close(at_end: bool) -> None:
        least, n, children, leaves, saved, ends, size, leads = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * size
        emit((least, len(stack), n, children, leaves, saved, ends, size, leads, at_end))
        if stack:
            above = stack[-1]
            above[0] = least if above[0] is None else min(least, above[0])
            above[1] += n
            above[2] += 1
            above[3] += leaves
            above[4] += saved

    for both, (path, sizes, least, n, ends) in rows:
        leads = first is None
        if leads:
            first = path
            stack.append([None, 0, 0, 0, 0, None, 0, True])
        while len(stack) > both + 1:
            close(False)
        for size in np.frombuffer(sizes, "<i4")[both:].tolist():
            stack.append([None, 0, 0, 0, 0, None, size, leads])
        top = stack[-1]
        top[0] = least if top[0] is None else min(least, top[0])
        top[1] += n
        top[5] = ends
        last = path
    while stack:
        close(True)
    return first, last


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a task's rows, parents before their children: finished ones are kept (spilled beyond a bound) and read backwards."""
    with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as file:
        places, part = [], []

        def emit(node: tuple) -> None:
            part.append(node)
            if len(part) == OUT_ROWS:
                flush()

        def flush() -> None:
            places.append(file.tell())
            pickle.dump(part, file, -1)
            part.clear()

        first, last = finished(sorted_rows(batches), emit)
        if first is None:
            return
        flush()
        leading, trailing = keys_of(first), keys_of(last)
        least_at: dict[int, int] = {}
        key_at: dict[int, bytes | None] = {}
        for place in reversed(places):
            file.seek(place)
            out = []
            for least, depth, n, children, leaves, saved, ends, size, leads, trails in reversed(pickle.load(file)):
                key = leading[depth] if leads else trailing[depth] if trails else None
                above = key_at.get(depth - 1)
                out.append((least, depth, None if above is not None else least_at.get(depth - 1), n, children, leaves, saved, ends, size, key, above))
                least_at[depth], key_at[depth] = least, key
            if out:
                yield _rows(out, _NODE)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that lie in several ranges, with what was counted once a range taken off: children and leaves twice counted, first members saved.

    Their number is bounded by ranges times the turns that neighbouring ranges share.
    """
    nodes = {r["key"]: r for b in batches for r in b.to_pylist()}
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["leaf_fix"] = r.get("leaf_fix", 0) - r["childless"]
        r["saved_fix"] = r.get("saved_fix", 0) + (r["ranges"] - 1) * r["size"]
        above = nodes.get(r["parent_key"])
        if above:
            above["leaf_fix"] = above.get("leaf_fix", 0) + r["leaf_fix"]
            above["saved_fix"] = above.get("saved_fix", 0) + r["saved_fix"]
            above["n_children"] -= r["ranges"] - 1
        r["n_leaves"] += r["leaf_fix"]
        r["saved_tokens"] += r["saved_fix"]
    if nodes:
        yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in _NODE} for r in nodes.values()], schema=_NODE)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node.

    Turns are ordered by turn (null first), then by digest, so that ties have one order; null roles and texts are empty; repeated rows are turns of their own;
    rows without a conv_id belong to no conversation. The first of an id's hundred is id - id % 100 (the remainder has the id's sign). An empty table has no nodes. Other columns
    are ignored.
    """
    whole = materialize(rebuilt(conversations), "rebuilt")
    known = materialize(classes(whole, IDS), "classes")
    distinct = whole.drop("class").join(known.drop("class").withColumnRenamed("least", "conv_id"), "conv_id").withColumnRenamed("conv_id", "least")
    dealt = distinct.repartitionByRange(F.substring("path", 1, RANGE_TURNS * DIGEST))
    nodes = materialize(dealt.select("path", "sizes", "least", "n", "ends_sha256").mapInArrow(_nodes, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    rest = [F.max(c).alias(c) for c in ("ends_sha256", "depth", "size", "parent_key", "parent_conv_id")]
    border = materialize(nodes.where("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *rest, F.count("*").alias("ranges"), F.sum((F.col("n_children") == 0).cast("int")).alias("childless")), "border")
    alone = border.where("ranges = 1").select(*nodes.columns)
    several = border.where("ranges > 1").repartition(1).mapInArrow(_mended, NODE)
    border = materialize(alone.unionByName(several), "mended")
    every = nodes.where("key is null").unionByName(border)
    above = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    placed = every.where("parent_key is not null").join(F.broadcast(above) if border.count() <= BROADCAST_BORDERS else above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    discard(whole, known)
    out = every.where("parent_key is null").unionByName(placed.select(*every.columns))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
