"""Packing documents into sequences of fixed length by exact complements.

Only lengths decide, so a packing is worked out on the histogram of piece lengths (at most `most` numbers, whatever
the input): lengths that fill a gap exactly as a single, a pair or a triple are consumed together as long as all are available; what is
left goes by best fit. That gives recipes, each with how often it is used. Pieces then find their place in parallel from their length and
their rank among pieces of that length.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tunespark.llm.byte_bpe import byte_letters
from tunespark.llm.common import Cache, held, materialize, small_batches, text_to_rows, trim

SEQUENCE, END_ID = 4096, 1
#: Pieces of one length are ranked in this many parts.
PARTS = 64
#: Words and chunks of text whose ids a worker keeps, each: about 200 bytes an entry.
KEPT = 150_000
#: White space for Python's split() that is none for the vocabulary's pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Other than white space, ASCII signs, digits and composed Latin letters (\u0130 isn't one in lower case), or where a special string may begin.
ODD = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<[|]")
PLAIN = bytes(c for c in range(256) if not ODD.match(chr(c)))
#: What follows an apostrophe as one word with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def plain(text: str) -> bool:
    """Whether nothing in the text is ODD."""
    try:
        return "<|" not in text and not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return not ODD.search(text)


def spaced(text: str) -> str:
    """A plain text in lower case with a space behind every word, run of signs, digit and ending, as the vocabulary's pattern tells them apart."""
    text = text.lower()
    for sign in string.punctuation:
        text = text.replace(sign, f"\x01{sign}\x02")
    text = text.replace("\x02\x01", "")
    if "'" in text:
        for ending in ENDINGS:
            text = text.replace(f"\x01'\x02{ending}", f" '{ending} ")
    for digit in string.digits:
        text = text.replace(digit, f" {digit} ")
    for space in "\x01\x02\t\n\r":
        text = text.replace(space, " ")
    return text + " "


def merges(content: str) -> tuple[tiktoken.Encoding | None, np.ndarray]:
    """The vocabulary's merges for spaced() texts, and the ids of its ranks; None where two merges make one token.

    A space stands for the end of a word: it joins the last byte before anything else is merged.
    """
    model = json.loads(content)["model"]
    vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
    byte = {letter: bytes([b]) for b, letter in letters.items()}
    steps = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    tokens = [*letters.values(), *(x + end for x in letters.values()), *(a + b for a, b in steps)]
    ranks = {b"".join([byte[c] for c in t.removesuffix(end)]) + b" " * t.endswith(end): rank for rank, t in enumerate(tokens)}
    ids = np.array([vocab[t] for t in tokens], "<u4")
    if len(ranks) < len(tokens):
        return None, ids
    # without any special string encoding takes twice as long; no plain text holds this one
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\x00": len(tokens)}), ids


class WordIds:
    """Ids of texts by a vocabulary that drops white space. Plain texts go through its merges whole; of others the library encodes words once and they are kept (at most `most`)."""

    def __init__(self, content: str, most: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(content)
        self.model = self.library.model
        self.merges, self.ids = merges(content)
        letters = byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.words = Cache(self._word, most)
        self.known = Cache(self._chunk, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A lower-case run of letters, which the vocabulary's pattern leaves whole: straight to the library's model."""
        symbols = word if word.isascii() else "".join(self.letter[b] for b in word.encode())
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        core = low[:-1] if low[-1] in ".," else low
        # other than composed Latin letters and a point or comma, the library sees to itself
        if core.isalpha() and (chunk.isascii() or (max(chunk) < "\u0250" and unicodedata.is_normalized("NFC", chunk))):
            return self.words[core] + (self.words[low[-1]] if core is not low else b"")
        return self.whole(chunk)

    def _odd(self, text: str) -> bytes:
        return self.whole(text) if ODD_SPACE.search(text) else b"".join([self.known[w] for w in text.split()])

    def _plain(self, text: str) -> bytes:
        return self.ids[self.merges.encode_to_numpy(spaced(text), disallowed_special=())].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._plain(t) if self.merges and plain(t) else self._odd(t) for t in texts]


@held
@lru_cache(maxsize=2)
def _word_ids(content: str) -> WordIds:
    made = WordIds(content)
    trim()  # what parsing the vocabulary took
    return made


def pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut after every `most` ids where longer."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def rows(texts: list[str]) -> dict[str, list]:
        sizes, crcs = [], []
        for ids in _word_ids(shared.value).encode(texts):
            ids += end
            cut = [ids[i : i + 4 * most] for i in range(0, len(ids), 4 * most)]
            sizes.append([len(x) // 4 for x in cut])
            crcs.append([zlib.crc32(x) for x in cut])
        return {"sizes": sizes, "crcs": crcs}

    made = text_to_rows(docs, "sizes array<bigint>, crcs array<bigint>", rows, text=text)
    cut = made.select("doc_id", F.posexplode(F.arrays_zip("sizes", "crcs")).alias("piece", "x"))
    return cut.select("doc_id", "piece", (F.col("piece") * F.lit(most)).cast("bigint").alias("start"), F.col("x.sizes").alias("length"), F.col("x.crcs").alias("ids_crc32"))


def recipes(counts: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which lengths together, so that all counts are used up and few sequences are needed."""
    have = np.zeros(most + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.arange(most + 1)

    def use(items: tuple[int, ...]) -> int:
        need = Counter(items)
        times = min(int(have[x]) // k for x, k in need.items())
        if times > 0:
            for x, k in need.items():
                have[x] -= k * times
            out.append((items, times))
        return times

    def pair(total: int, keep: int = 0) -> tuple[int, int] | None:
        """Two lengths of this sum that are both there, when `keep` is in use already."""
        if total < 2:
            return None
        a = lengths[(total + 1) // 2 : total]
        b = total - a
        good = np.flatnonzero((have[a] > 0) & (have[b] > (a == b)))
        for i in good.tolist():
            x, y = int(a[i]), int(b[i])
            if all(have[v] >= k for v, k in Counter((x, y, keep) if keep else (x, y)).items()):
                return x, y
        return None

    def pair_sums() -> np.ndarray:
        """Whether two lengths that are there make each sum; lengths only get fewer, so an old answer misses none."""
        there = (have > 0).astype(np.float64)
        there[0] = 0
        return np.rint(np.fft.irfft(np.fft.rfft(there, 4 * most) ** 2, 4 * most))[: most + 1] > 0

    def triple(gap: int, anchor: int) -> tuple[int, int, int] | None:
        nonlocal paired
        misses, fresh = 0, False
        while True:
            for third in (1 + np.flatnonzero((have[1:gap] > 0) & paired[gap - 1 : 0 : -1]))[::-1].tolist():
                found = pair(gap - third, anchor)
                if found and all(have[v] >= k for v, k in Counter((anchor, third, *found)).items()):
                    return third, *found
                misses += 1
                if misses >= 16 and not fresh:
                    break
            else:
                return None
            paired, fresh = pair_sums(), True

    paired = pair_sums()
    for anchor in range(most, 0, -1):
        gap = most - anchor
        if have[anchor] and gap == 0:
            use((anchor,))
            continue
        while have[anchor] and have[gap] > (gap == anchor) and use((anchor, gap)):
            pass
        while have[anchor] and (found := pair(gap, anchor)):
            use((anchor, *found))
        while have[anchor] and gap >= 3 and (found := triple(gap, anchor)):
            use((anchor, *found))
    # best fit of the rest, longest first: open sequences by the gap that they have left
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps = np.zeros(most + 1, bool)
    for length in range(most, 0, -1):
        left = int(have[length])
        while left:
            fit = np.flatnonzero(gaps[length:])
            if fit.size:
                gap = length + int(fit[0])
                items, n = open_by_gap[gap].pop()
                into = min(left, n)
                if n > into:
                    open_by_gap[gap].append((items, n - into))
                gaps[gap] = bool(open_by_gap[gap])
                many = 1
            else:
                items, gap, many = (), most, min(left, most // length)
                into = left // many
            grown = (items + (length,) * many, into)
            left -= into * many
            rest = gap - length * many
            if rest:
                open_by_gap[rest].append(grown)
                gaps[rest] = True
            else:
                out.append(grown)
    return out + [x for group in open_by_gap.values() for x in group]


def segments(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the ranks of each length go."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for items, times in made:
        offset = 0
        for length in items:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts are one piece of the end id alone; repeated rows are packed as often as they occur; an empty table
    gives no rows; other columns are ignored. The histogram of lengths and the recipes made from it are bounded by `most`; they alone pass the driver.
    """
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, vocabulary, most, end_id, text), "pieces")
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    by_part = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(segments(recipes(counts, most)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        order = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(order, length * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
