"""Near-duplicate documents by Order MinHash.

A document's k-mers are its runs of five words (lower case, cut at white space), each labelled with how often it has occurred before, so that
labelled k-mers are unique in a text. A sketch takes the few labelled k-mers of least hash and keeps them in the order of
the text; texts that share a sketch are candidates. Short texts have each of their k-mers as a key instead. Candidates are verified by a banded
alignment of their words: near-duplicates are texts whose words differ by at most a fifth of the longer text's in edit distance.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import discard, join_sized, let_go, materialize, mix, small_batches, text_to_rows
from tunespark.llm.components import connected_components

WORDS_A_KMER, SIMILARITY = 5, 0.8
#: Sketches a document and k-mers a sketch: a pair that shares the part j of its k-mers shares no sketch with a chance of about (1 - j ** TAKEN) ** SKETCHES.
SKETCHES, TAKEN = 40, 2
#: Texts of up to SHORT k-mers have all of them as keys instead of sketches, and those of up to KEYED, the most that a near copy of a short text has, have both.
SHORT, KEYED = 32, 46
#: While more pairs than FIRST_PAIRS a row of the buckets are left between components, each document is compared with one random member of its
#: buckets; again as long as more than GAIN of the pairs tried are links, MOST_TURNS times at most. What is left then is paired in full.
FIRST_PAIRS, GAIN, MOST_TURNS = 0.25, 0.15, 8
#: Members of a bucket that are compared as one part; bins of a bag of words.
BUCKET_ROWS, BINS = 2048, 256
#: Ids of up to this many documents (8 MB) are broadcast to pick their texts out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words beyond which a pair is first tried by an alignment between common k-mers, and longest stretch that it aligns in one piece; numbers that a sketch holds at a time (8 MB); copies of a text that very many are compared with.
BRIEF, LONG, SKETCHED, SALTS = 2000, 20_000, 1 << 20, 64
#: Bits of the words' places in a text that are held at a time (64 MB); beyond it those of rarer words are made when they are needed.
PLACES = 1 << 29
#: Pairs that are aligned in one task by their texts; words of a text that travel with its bucket at most (16 KB).
PAIRS_A_TASK, CARRIED = 2000, 4096
#: Pairs that are aligned side by side: few where they link, as a link spares others, many where they don't. Members from which a bucket is a task's group of its own.
FEW_ALIGNED, MANY_ALIGNED, OWN_GROUP = 8, 128, 256
#: More edits than any pair of texts of up to CARRIED words has, with room in 16 bits for one more in each step.
FAR = 16_384


def words(text: str) -> np.ndarray:
    """Hash of each word in the order of the text."""
    own = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def kmers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and occurrence-labelled hash of each k-mer of hashed words in their order; one to four words make one k-mer."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = max(1, len(h) - WORDS_A_KMER + 1)
    plain = np.zeros(n, np.uint64)
    for i in range(min(WORDS_A_KMER, len(h))):
        plain = mix(plain * np.uint64(31) + h[i : i + n])
    order = np.argsort(plain, kind="stable")
    run = plain[order]
    start = np.concatenate([[True], run[1:] != run[:-1]])
    at = np.arange(n)
    times = np.empty(n, np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)
    return plain, np.where(times > 0, mix(plain ^ (times * np.uint64(0xA24BAED4963EE407))), plain)


#: A sketch's order of k-mers: an odd factor of half the hash's bits, which is twice as fast as all of them. Equal k-mers stay equal.
_turn = (mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _smallest(value: np.ndarray, taken: int) -> np.ndarray:
    """Places of the `taken` smallest values of each row, in the order of the row."""
    rows, n = value.shape
    if taken == n:
        return np.tile(np.arange(n), (rows, 1))
    if n > 8 * taken:
        # few values lie under this border, and nearly always enough of them
        row, at = np.nonzero(value < np.uint32((4 * taken + 8) / n * 2.0**32))
        count = np.bincount(row, minlength=rows)
        if count.min() >= taken:
            order = np.lexsort((value[row, at], row))
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            out = at[order][first[:, None] + np.arange(taken)]
            out.sort(axis=1)
            return out
    out = np.argpartition(value, taken - 1, axis=1)[:, :taken]
    out.sort(axis=1)
    return out


def sketches(text: str) -> tuple[int, list[int], list[int]]:
    """How many words the text has, its keys as signed 64-bit numbers, and the word where each begins (no keys for a text without words).

    Sketches are made a few at a time where the text is long, so that memory grows with the text alone.
    """
    h = words(text)
    plain, labelled = kmers(h)
    n = len(plain)
    if not n:
        return 0, [], []
    keys, places = (mix(labelled).view(np.int64).tolist(), list(range(n))) if n <= KEYED else ([], [])
    if n > SHORT:
        step, half = max(1, min(SKETCHES, SKETCHED // n)), (labelled >> np.uint64(32)).astype(np.uint32)
        for first in range(0, SKETCHES, step):
            value = half[None, :] * _turn[first : first + step, None]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x6659FD93)
            value ^= value >> np.uint32(16)
            at = _smallest(value, TAKEN)
            out = np.arange(first, first + len(at), dtype=np.uint64)
            for i in range(TAKEN):
                out = mix(out * np.uint64(0x100000001B3) + plain[at[:, i]])
            keys += out.view(np.int64).tolist()
            places += at[:, 0].tolist()
    return len(h), keys, places


def most_edits(longest):
    """The greatest edit distance of a pair at SIMILARITY whose longer text has so many words; the slack is for rounding."""
    return longest * (1 - SIMILARITY) + 1e-9


class Text:
    """A text's hashed words and, made when asked for, its k-mers."""

    def __init__(self, text: str):
        self.words = words(text)

    @classmethod
    def of(cls, hashed: np.ndarray) -> Text:
        """The text of these hashed words."""
        out = cls("")
        out.words = hashed.astype(np.uint64)
        return out

    @cached_property
    def listed(self) -> list[int]:
        return self.words.tolist()

    @cached_property
    def runs(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Its runs of two and of three words: their number of words, distinct hashes in order, and how often each occurs."""
        h, out = self.words, []
        for size in (2, 3):
            if len(h) >= size:
                g = np.zeros(len(h) - size + 1, np.uint64)
                for i in range(size):
                    g = mix(g * np.uint64(31) + h[i : i + len(g)])
                out.append((size, *np.unique(g, return_counts=True)))
        return out

    @cached_property
    def kmers(self) -> tuple[np.ndarray, np.ndarray]:
        return kmers(self.words)


def _places(a: list[int], width: int) -> Callable[[int, int], int]:
    """A function of a word and a row: the word's places from that row on, a bit each, at least the next `width`.

    All bits of a word are kept in one integer while they fit in PLACES. In longer texts only the common words' are; a rarer word's places are put together from a list.
    """
    where: dict[int, list[int]] = {}
    for i, word in enumerate(a):
        where.setdefault(word, []).append(i)
    least = 0 if len(a) * len(where) <= PLACES else len(a) * len(a) // PLACES
    whole = {word: sum_of_bits(at, len(a)) for word, at in where.items() if len(at) > least}

    def bits(word: int, row: int) -> int:
        x = whole.get(word)
        if x is None:
            at = where.get(word)
            if at is None:
                return 0
            low = bisect_left(at, row)
            near = at[low : bisect_left(at, row + width)]
            return sum_of_bits([i - row for i in near], width)
        return x >> row if row >= 0 else x << -row

    return bits


def sum_of_bits(places: list[int], size: int) -> int:
    if len(places) < 64:
        out = 0
        for i in places:
            out |= 1 << i
        return out
    flags = np.zeros(size, bool)
    flags[places] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two word lists if it is at most `most`, else a greater number.

    The alignment matrix is filled within `most` of its diagonal, a column at a time: one bit of an integer says for each row of the band
    whether the distance goes up (or down) from the row above it.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    places = _places(a, 2 * most + 1)
    band = (1 << (2 * most + 1)) - 1
    edge = 1 << (2 * most)
    up, down, distance = band ^ ((1 << most) - 1), 0, min(m, most)
    hopeless = 2 * most + n - m
    for j, word in enumerate(b, 1):
        equal = places(word, j - most - 1) & band
        free = ((((equal & up) + up) ^ up) & band) | equal | down
        more = down | (band & ~(free | up))
        less = free & up
        if j + most <= m:
            # along the lower edge of the band
            distance += not free & edge
            if distance > hopeless:
                return most + 1
        else:
            # along the last row
            row = 1 << (m - j + most)
            distance += bool(more & row) - bool(less & row)
        free >>= 1
        up = less | (band & ~(free | more))
        down = free & more
    return distance


def within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Whether each pair of texts of up to CARRIED words (hashes of 32 bits) has an edit distance of at most its `most`.

    All matrices are filled side by side, an antidiagonal at a time, on those diagonals that an alignment of so few edits can visit. A pair is decided as soon as no cell of its
    last two antidiagonals can be part of such an alignment.
    """
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    n, m = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    out, most = np.zeros(len(pairs), bool), np.asarray(most, np.int64)
    rows = np.flatnonzero((n - m <= most) & (most >= 0))
    if not len(rows):
        return out
    # diagonals j - i from low to high, both even: every second one is on an antidiagonal
    low, high = -2 * int((most[rows] + n[rows] - m[rows]).max() // 4 + 1), 2 * int((most[rows] - n[rows] + m[rows]).max() // 4 + 1)
    evens = (high - low) // 2 + 1
    steps = int((n + m)[rows].max())
    size = steps // 2 + high - low + 4
    # a backwards, so that an antidiagonal is a slice of either; what lies outside of the texts reaches no cell that counts
    a, b = np.zeros((len(rows), size), np.uint32), np.zeros((len(rows), size), np.uint32)
    end, start = steps // 2 - low // 2 + 1, 1 - low // 2
    for r, i in enumerate(rows.tolist()):
        x, y = pairs[i]
        a[r, end - len(x) : end], b[r, start : start + len(y)] = x[::-1], y
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    even, odd = np.full((evens, len(rows)), FAR, np.int16), np.full((evens + 1, len(rows)), FAR, np.int16)
    even[-low // 2] = 0
    last, goal = (n + m)[rows], (m - n)[rows]
    gap = np.abs(np.arange(low, high + 1)[:, None] - goal).astype(np.int16)
    out[rows[last == 0]] = True
    for s in range(1, steps + 1):
        d = low if s % 2 == 0 else low + 1
        old, near = (even, odd) if s % 2 == 0 else (odd[1:-1], even)
        x, y = end - (s - d) // 2, start + (s + d) // 2 - 1
        cost = old + (a[x : x + len(old)] != b[y : y + len(old)])
        step = np.minimum(near[:-1], near[1:])
        step += 1
        np.minimum(step, cost, out=old)
        ended = np.flatnonzero(last == s)
        if len(ended):
            out[rows[ended]] = old[(goal[ended] - d) // 2, ended] <= most[rows[ended]]
        if s % 64 == 0 or len(ended):
            open_ = (last > s) & (np.minimum((even + gap[::2]).min(0), (odd[1:-1] + gap[1::2]).min(0)) <= most[rows])
            if not open_.any():
                break
            if open_.sum() <= 0.75 * len(rows):
                a, b, even, odd, gap = (np.ascontiguousarray(z[:, open_]) for z in (a, b, even, odd, gap))
                rows, last, goal = rows[open_], last[open_], goal[open_]
    return out


def chain(x: np.ndarray, y: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a longest increasing chain of common values (unique in x and in y) that lie within `most` of each other."""
    _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(at - to) <= most
    at, to = at[near], to[near]
    order = np.argsort(at)
    at, to = at[order], to[order]
    if not (to[1:] < to[:-1]).any():
        return at, to  # also when there is none
    tops: list[int] = []
    ends: list[int] = []
    back = []
    for i, v in enumerate(to.tolist()):
        k = bisect_left(tops, v)
        tops[k : k + 1], ends[k : k + 1] = [v], [i]
        back.append(ends[k - 1] if k else -1)
    kept, i = [], ends[-1]
    while i >= 0:
        kept.append(i)
        i = back[i]
    kept = np.array(kept[::-1])
    return at[kept], to[kept]


def _once(plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur once, in the order of the text, and their places."""
    value, at, count = np.unique(plain, return_index=True, return_counts=True)
    at = np.sort(at[count == 1])
    return plain[at], at


def anchored_distance(a: Text, b: Text, most: int) -> int:
    """Edits of an alignment that matches a longest chain of k-mers which occur once in either text, or more than `most`.

    Between the chain's runs the words are aligned exactly in their band; a stretch of more than LONG words without a run is cut in the same proportion.
    """
    (va, at), (vb, to) = _once(a.kmers[0]), _once(b.kmers[0])
    i, j = chain(va, vb, np.inf)
    at, to = at[i], to[j]
    near = np.abs(at - to) <= most
    at, to = at[near], to[near]
    # where a run of neighbouring matches begins and ends
    joint = (np.diff(at) == np.diff(to)) & (np.diff(at) <= WORDS_A_KMER)
    first, last = np.append(True, ~joint)[: len(at)], np.append(~joint, True)[: len(at)]
    runs = zip(at[first].tolist(), to[first].tolist(), (at[last] + WORDS_A_KMER).tolist(), (to[last] + WORDS_A_KMER).tolist(), strict=True)
    n, m, total, x, y = len(a.words), len(b.words), 0, 0, 0
    for start_a, start_b, end_a, end_b in [*runs, (n, m, n, m)]:
        over = max(0, x - start_a, y - start_b)
        start_a, start_b = start_a + over, start_b + over
        if start_a > end_a:
            continue
        while x < start_a or y < start_b:
            longest = max(start_a - x, start_b - y)
            to_x, to_y = (start_a, start_b) if longest <= LONG else (x + (start_a - x) * LONG // longest, y + (start_b - y) * LONG // longest)
            piece_a, piece_b = a.listed[x:to_x], b.listed[y:to_y]
            total += banded_distance(piece_a, piece_b, min(most - total, max(len(piece_a), len(piece_b)))) if piece_a and piece_b else max(len(piece_a), len(piece_b))
            if total > most:
                return most + 1
            x, y = to_x, to_y
        x, y = end_a, end_b
    return total


def near_copies(a: Text, b: Text) -> bool:
    """Whether the edit distance of the words is at most a share of 1 - SIMILARITY of the longer text's.

    The banded alignment of the words decides, at any length; pairs that share too few runs of words for it are left out before. Beyond BRIEF words an alignment in pieces between common k-mers is tried first: what it finds near is near.
    """
    n, m = len(a.words), len(b.words)
    if not n or not m:
        return False
    most = int(most_edits(max(n, m)))
    if abs(n - m) > most:
        return False
    if n == m and (a.words == b.words).all():
        return True
    if not share_runs(a, b, most):
        return False
    if max(n, m) > BRIEF and anchored_distance(a, b, most) <= most:
        return True
    return banded_distance(a.listed, b.listed, most) <= most


def share_runs(a: Text, b: Text, most: int) -> bool:
    """Whether the texts share as many runs of words as a pair of at most `most` edits does: an edit touches no more runs than a run has words."""
    longest = max(len(a.words), len(b.words))
    for (size, x, n), (_, y, m) in zip(a.runs, b.runs):
        need = longest - size + 1 - size * most
        if need > 0:
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            if int(np.minimum(n[i], m[j]).sum()) < need:
                return False
    return True


def bag(h: np.ndarray) -> np.ndarray:
    """How many words fall in each of BINS bins; full at 65,535, which makes a bound no more than weaker."""
    return np.minimum(np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 65_535).astype(np.uint16)


def _bag_edits(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Edits that at least lie between a bag and each of many (floats that hold whole numbers)."""
    return np.maximum(one, many) @ np.ones(BINS, np.float32) - np.minimum(one.sum(), many.sum(1))


def may_align(n: np.ndarray, pos: np.ndarray, component: np.ndarray, role: np.ndarray, bags: np.ndarray, ahead: np.ndarray, fronts_known: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i of left, j of right) and least edits of pairs of different components that can reach SIMILARITY by their lengths and bags of words.

    What one bag holds more of than the other takes an edit each, and so do the bags of what comes before the common k-mer (ahead) and after it, taken
    apart where both are known, and what texts differ in length before and after it (pos): no pair at SIMILARITY that aligns the k-mer is left out. Two rows of role 1 are compared elsewhere.
    """
    none = np.zeros(0, np.int64)
    got_i, got_j, got_edits = [none], [none], [none]
    # sums of whole numbers in single precision are exact up to 2 ** 24: bags hold 65,535 a bin at most
    others, ones = bags[right].astype(np.float32), np.ones(BINS, np.float32)
    total, buffer = others @ ones, np.empty_like(others)
    length, place, group, kind = n[right], pos[right], component[right], role[right]
    for i in left.tolist():
        most = most_edits(np.maximum(n[i], length))
        fits = (group != component[i]) & (np.abs(pos[i] - place) + np.abs(n[i] - pos[i] - length + place) <= most)
        if role[i] == 1:
            fits &= kind != 1
        if not fits.any():
            continue
        own = bags[i].astype(np.float32)
        at = np.flatnonzero(fits)
        # the bags of those alone that places and lengths let through
        part = np.take(others, at, axis=0, out=buffer[: at.size], mode="clip")
        np.maximum(part, own, out=part)
        at = at[part @ ones - np.minimum(own.sum(), total[at]) <= most[at]]
        if at.size:
            j, most = right[at], most[at]
            edits = _bag_edits(own, others[at])
            if fronts_known[i]:
                front, fronts = ahead[i].astype(np.float32), ahead[j].astype(np.float32)
                edits = np.where(fronts_known[j], _bag_edits(front, fronts) + _bag_edits(own - front, others[at] - fronts), edits)
            fits = edits <= most
            got_i.append(np.full(int(fits.sum()), i))
            got_j.append(j[fits])
            got_edits.append(edits[fits].astype(np.int64))
    return np.concatenate(got_i), np.concatenate(got_j), np.concatenate(got_edits)


def _verified(pairs: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """(cu, cv): the components of the n pairs (u, v, cu, cv) whose texts are near copies.

    A text that very many pairs name as u has copies under SALTS salts, so that its pairs are dealt over as many tasks.
    """
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    often = pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > max(1000, pairs.count() // 1000))
    hot = F.broadcast(often.select("u", F.lit(SALTS).alias("salts")))  # fewer than 1,000 rows
    pairs = pairs.join(hot, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    left = left.join(hot, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    parts = max(1, min(8192, n // PAIRS_A_TASK))
    both = pairs.join(right, "v").repartition(parts, "u", "salt").join(left.repartition(parts, "u", "salt"), ["u", "salt"]).select("cu", "cv", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(__name__)
        own = lru_cache(maxsize=4)(Text)
        for batch in batches:
            keep = []
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                for x, y in zip(part.column("text_u"), part.column("text_v"), strict=True):
                    keep.append(near_copies(own(x.as_py()), own(y.as_py())))
            yield batch.select(["cu", "cv"]).filter(pa.array(keep, type=pa.bool_()))

    return both.mapInArrow(run, "cu bigint, cv bigint").distinct()


def _can_align() -> F.Column:
    """Lengths (nu, n) and places (pu, pos) of a common k-mer that a pair at SIMILARITY can have.

    An alignment that matches the k-mer takes as many edits as the texts differ in length before it, and after it.
    """
    before, after = F.abs(F.col("pu") - F.col("pos")), F.abs(F.col("nu") - F.col("n") - F.col("pu") + F.col("pos"))
    return before + after <= F.greatest("nu", "n") * (1 - SIMILARITY) + 1e-9


def _pairs_left(placed: DataFrame) -> int:
    """Pairs that share a bucket and lie in different components, counted once a bucket; from counts alone."""
    by = placed.groupBy("key", "component").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice"))
    return int((by.agg(F.sum("twice")).first()[0] or 0) / 2)


def _against_one(placed: DataFrame, turn: int) -> DataFrame:
    """(u, v, cu, cv): each document with the member of its buckets, of another component, that comes first in this turn's random order of all documents.

    The order is the same in all buckets, so that a large group's members meet few of its own: one pair a document at most.
    """
    draw = F.xxhash64("doc_id", F.lit(turn))
    heads = placed.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "doc_id", "n", "pos", "component")).alias("head"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "head", "size")
    star = join_sized(placed, heads, "key").where("component <> head.component").select(
        F.col("head.draw").alias("draw"), F.col("head.doc_id").alias("u"), F.col("doc_id").alias("v"), F.col("head.n").alias("nu"), "n", F.col("head.pos").alias("pu"), "pos", F.col("head.component").alias("cu"), F.col("component").alias("cv")
    )
    return star.where(_can_align()).groupBy("v", "cv").agg(F.min(F.struct("draw", "u", "cu")).alias("head")).select("head.u", "v", "head.cu", "cv")


def _close_pairs(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v, cu, cv, linked): near copies that share a bucket and lie in different components, enough of them to connect all that are linked.

    A bucket beyond BUCKET_ROWS is cut by length first: members meet those of their own class and of the next shorter one, as near copies' lengths
    differ by a quarter at most. What is still beyond BUCKET_ROWS is dealt into parts of that size and each pair of parts is compared by itself; small buckets are compared many in
    a task's group. Pairs are bounded by their bags of words, and those left are aligned where they meet, the closest first, unless earlier links of the
    task connect them. A pair of several buckets is aligned in the first of them, in an order drawn by the two ids, whose k-mer the bounds let it align: it is dropped only where all its buckets drop it. Pairs with a text beyond CARRIED words are given unaligned (linked is null).
    """
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    own = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1 / SIMILARITY)) + 1e-9)
    cells = F.when(F.col("size") <= BUCKET_ROWS, F.array(F.struct(F.col("key").alias("cell"), F.lit(0).alias("role")))).otherwise(
        F.array(F.struct(F.xxhash64("key", own).alias("cell"), F.lit(0).alias("role")), F.struct(F.xxhash64("key", own - 1).alias("cell"), F.lit(1).alias("role")))
    )
    rest = join_sized(placed, mixed.select("key", "size"), "key").select(F.explode(cells).alias("at"), "doc_id", "n", "pos", "component").select("at.*", "doc_id", "n", "pos", "component")
    rest = materialize(rest.distinct(), "mixed")
    n = rest.count()
    groups = max(1, n // BUCKET_ROWS)
    texts = pick(docs, rest.select("doc_id").distinct(), few=n <= BROADCAST_IDS).dropDuplicates(["doc_id"])

    def carried(some: list[str]) -> dict[str, list]:
        hashed = [words(t) for t in some]
        return {"bag": [bag(h).tobytes() for h in hashed], "words": [h.astype(np.uint32).tobytes() if len(h) <= CARRIED else None for h in hashed]}

    # the cells of a document and the words where their k-mers begin, as arrays side by side
    by_role = [F.array_sort(F.collect_set(F.when(F.col("role") == role, F.struct("cell", "pos")))).alias(name) for role, name in ((0, "own"), (1, "next"))]
    at = rest.groupBy("doc_id").agg(*by_role).select("doc_id", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("own", "next") for f in ("cell", "pos")])
    known = text_to_rows(texts, "bag binary, words binary", carried).join(at, "doc_id")
    sizes = rest.groupBy("cell").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / BUCKET_ROWS).cast("int"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int")
    dealt = join_sized(rest, sizes, "cell").join(known, "doc_id").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    alone = (F.col("size") > OWN_GROUP) | (F.col("parts") > 1)
    group = F.when(alone, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(groups)))
    sent = dealt.select(group.alias("group"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), alone.alias("large"), "part", "cell", "role", "doc_id", "n", "pos", "component", "bag", "words", "own_cell", "own_pos", "next_cell", "next_pos")

    def compare(table: pa.Table) -> pa.Table:
        let_go(__name__)
        table = table.sort_by("cell")
        cell, part, doc = (table.column(c).to_numpy() for c in ("cell", "part", "doc_id"))
        n, pos, component, role = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "component", "role"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        bags = np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint16).reshape(-1, BINS)
        raw = table.column("words").combine_chunks()
        raw32 = [np.frombuffer(x.as_buffer(), np.uint32) if x.is_valid else None for x in raw]
        # the places of the k-mers by cell; of several in one cell the first
        own_cells, next_cells = (lru_cache(maxsize=2 * BUCKET_ROWS)(lambda i, c=table.column(f"{r}_cell"), p=table.column(f"{r}_pos"): dict(zip(reversed(c[i].as_py()), reversed(p[i].as_py()), strict=True))) for r in ("own", "next"))
        row_of = dict(zip(doc.tolist(), range(len(doc)), strict=True))
        first_row = [row_of[d] for d in doc.tolist()]  # one row stands for all of a document
        text = lru_cache(maxsize=1024)(lambda d: Text.of(raw32[row_of[d]]))
        # the bag of the words before the common k-mer
        ahead, whole = np.zeros_like(bags), np.array([x is not None for x in raw32], bool)
        for i, x in enumerate(raw32):
            if x is not None:
                ahead[i] = bag(x[: pos[i]])
        root: dict[int, int] = {}

        counts = bags.astype(np.int32)
        bins = [None if x is None else (x & np.uint32(BINS - 1)).astype(np.uint8) for x in raw32]

        def aligned_at(x: int, y: int, place_x: int, place_y: int, most: float) -> bool:
            """Whether the bounds let the pair align the k-mer that begins at these words."""
            apart = abs(place_x - place_y) + abs(int(n[x] - n[y]) - place_x + place_y)
            if apart > most:
                return False
            if not (whole[x] and whole[y]):
                return True
            ahead_more = np.bincount(bins[x][:place_x], minlength=BINS) - np.bincount(bins[y][:place_y], minlength=BINS)
            after_more = counts[x] - counts[y] - ahead_more
            # of either half the greater surplus, which is half of all differences and of that in length
            return int(np.abs(ahead_more).sum() + np.abs(after_more).sum()) + apart <= 2 * most

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        out: list[tuple] = []
        waiting: list[tuple[int, int]] = []
        at_a_time = FEW_ALIGNED

        def align() -> None:
            """Aligns the pairs that wait, side by side, and keeps the links that connect something."""
            nonlocal at_a_time
            most = np.array([int(most_edits(max(int(n[x]), int(n[y])))) for x, y in waiting], np.int64)
            linked = within([(raw32[x], raw32[y]) for x, y in waiting], most)
            for (x, y), near in zip(waiting, linked.tolist(), strict=True):
                a, b = find(int(component[x])), find(int(component[y]))
                if near and a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(doc[x]), int(doc[y]), int(component[x]), int(component[y]), True))
            at_a_time = FEW_ALIGNED if 4 * linked.sum() > len(linked) else min(2 * at_a_time, MANY_ALIGNED)
            waiting.clear()

        for rows in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
            left, right = rows[part[rows] == low], rows[part[rows] == high]
            if not len(left) or not len(right):
                continue
            i, j, edits = may_align(n, pos, component, role, bags, ahead, whole, left, right)
            once = doc[i] < doc[j] if low == high else np.ones(len(i), bool)
            i, j = i[once], j[once]
            order = np.argsort(edits[once], kind="stable")
            here = int(cell[rows[0]])
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if find(int(component[x])) == find(int(component[y])):
                    continue
                # of the cells that both are in, the pair's own: the first that the bounds let pass, from one drawn by the two ids so that pairs spread over all cells
                mine_x, mine_y, next_x, next_y = own_cells(first_row[x]), own_cells(first_row[y]), next_cells(first_row[x]), next_cells(first_row[y])
                common = mine_x.keys() & mine_y.keys()
                if next_x or next_y:
                    common |= (mine_x.keys() & next_y.keys()) | (next_x.keys() & mine_y.keys())
                common = sorted(common)
                low_id, high_id = sorted((int(doc[x]), int(doc[y])))
                first = (low_id * 31 + high_id * 17) % len(common)
                most = most_edits(max(int(n[x]), int(n[y])))
                for cell_ in common[first:] + common[:first]:
                    if cell_ == here or aligned_at(x, y, mine_x.get(cell_, next_x.get(cell_)), mine_y.get(cell_, next_y.get(cell_)), most):
                        break
                if cell_ != here:
                    continue
                if not (whole[x] and whole[y]):
                    out.append((int(doc[x]), int(doc[y]), int(component[x]), int(component[y]), None))
                elif share_runs(text(int(doc[x])), text(int(doc[y])), int(most)):
                    waiting.append((x, y))
                    if len(waiting) >= at_a_time:
                        align()
        if waiting:
            align()
        return pa.Table.from_pylist([dict(zip(LINK, r, strict=True)) for r in out], schema=LINK_SCHEMA)

    tasks = max(1, min(8192, n // BUCKET_ROWS))
    return sent.repartition(tasks, "group", "large", "low", "high").groupBy("group", "large", "low", "high").applyInArrow(compare, "u bigint, v bigint, cu bigint, cv bigint, linked boolean")


LINK = ("u", "v", "cu", "cv", "linked")
LINK_SCHEMA = pa.schema([(c, pa.int64()) for c in LINK[:4]] + [("linked", pa.bool_())])


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed with linked components (cu, cv) made one."""
    found = connected_components(links.toDF("u", "v")).toDF("component", "new")
    sized = found.join(placed.groupBy("component").agg(F.count("*").alias("size")), "component")
    moved = join_sized(placed, sized, "component").select("key", "doc_id", "n", "pos", F.col("new").alias("component"))
    return materialize(moved.unionByName(pick(placed, found.select("component"), "left_anti", key="component")), "placed")


def _tried(pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame | None, int]:
    """The links (cu, cv) among pairs (u, v, cu, cv), by their texts; and how many pairs there were."""
    wanted = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cu", "cv").distinct(), "pairs")
    n = wanted.count()
    if not n:
        return None, 0
    ids = wanted.select(F.col("u").alias("doc_id")).union(wanted.select("v")).distinct()
    with small_batches(docs.sparkSession):
        links = materialize(_verified(wanted, n, pick(docs, ids, few=2 * n <= BROADCAST_IDS).dropDuplicates(["doc_id"])), "verified")
    discard(wanted)
    return links, n


def pick(docs: DataFrame, ids: DataFrame, how: str = "left_semi", few: bool | None = None, key: str = "doc_id") -> DataFrame:
    """docs whose doc_id (or other key) is (left_semi) or isn't (left_anti) among ids, broadcast if they are counted to be few, else shuffled."""
    if few is None:
        few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, component_id, kept for each row of docs: documents linked, directly or by others, share the smallest doc_id.

    Equal texts are linked; so are texts that share a sketch and whose words' edit distance is at most a fifth of the longer text's words. Null, empty and blank texts link with
    nothing. A row with a null doc_id has component null and isn't kept; repeated rows give repeated rows; other columns are
    ignored.

    Exact copies are collapsed first by digest, with partial aggregation. Texts that share a sketch form a bucket. In turns, one random
    member of each bucket is verified against the others, and linked components become one; what then still lies in different
    components of a bucket is paired and verified in full, so that no link is lost while a large group of copies costs a number of pairs in proportion to its size.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with_digest = own.withColumn("digest", F.when(F.col("text").rlike(r"\S"), F.md5("text")))

    def rows(texts: list[str]) -> dict[str, list]:
        n, keys, places = zip(*map(sketches, texts), strict=True)
        return {"n": list(n), "keys": list(keys), "places": list(places)}

    with small_batches(docs.sparkSession):
        made = materialize(text_to_rows(with_digest, "n int, keys array<bigint>, places array<int>", rows, keep=("doc_id", "digest")), "sketches")
    first = made.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    reps = made.where(F.size("keys") > 0).join(first.select(F.col("rep").alias("doc_id"), F.col("digest").alias("own")), "doc_id").where("digest = own")
    keyed = reps.select("doc_id", "n", F.explode(F.arrays_zip("keys", "places")).alias("x")).select(F.col("x.keys").alias("key"), "doc_id", "n", F.col("x.places").alias("pos"))

    keyed = materialize(keyed, "keyed")
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    placed = materialize(join_sized(keyed, several, "key").select("key", "doc_id", "n", "pos", F.col("doc_id").alias("component")).distinct(), "placed")
    discard(keyed)
    size, turn = placed.count(), 0
    while _pairs_left(placed) > FIRST_PAIRS * size:
        turn += 1
        links, tried = _tried(_against_one(placed, turn), own)
        if not tried:
            break
        before, linked, placed = placed, links.count(), _joined(placed, links)
        discard(before, links)
        if linked <= GAIN * tried or turn == MOST_TURNS:
            break
    with small_batches(docs.sparkSession):
        close = materialize(_close_pairs(placed, own), "close")
    links, tried = _tried(close.where("linked is null"), own)
    links = close.where("linked").select("cu", "cv") if links is None else close.where("linked").select("cu", "cv").unionByName(links)
    found = _joined(placed, links).select(F.col("doc_id").alias("rep"), "component").distinct()
    classes = materialize(first.join(found, "rep", "left").select("digest", "size", F.coalesce("component", "rep").alias("component")), "classes")
    copies = join_sized(made.where("digest is not null").select("doc_id", "digest"), classes, "digest").select("doc_id", "component")
    # texts without words, and those that occur under null ids alone
    unnamed = made.where("digest is not null and doc_id is null").select("doc_id", "digest").join(classes, "digest", "left_anti")
    alone = made.where("digest is null").select("doc_id").unionByName(unnamed.select("doc_id")).withColumn("component", F.col("doc_id"))
    out = copies.unionByName(alone)
    return out.select("doc_id", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, of the document kept for each group; of repeated rows of one doc_id, one.

    Rows with a null doc_id stay: nothing says that they are copies.
    """
    judged = materialize(near_duplicates(docs), "judged")
    gone = judged.where("doc_id is not null and not kept").select("doc_id").distinct()
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = pick(docs, gone, "left_anti")
    if repeated.isEmpty():
        return left
    return pick(left, repeated, "left_anti").unionByName(pick(left, repeated).dropDuplicates(["doc_id"]))
