"""Byte-level BPE on whole texts: encoding and decoding by segment trees of pair ranks, token counts by prefix dynamic programming.

Texts are cut by the vocabulary's pattern and each piece is handled by itself, so a task keeps what it has worked out for
pieces (and for the blanks-separated chunks they come in) in a bounded cache. Null texts count as empty. Vocabulary files are
read on the driver and broadcast (about 1 MB, whatever the input), so workers need no file of their own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tunespark.llm.common import Cache, text_to_rows

NONE = np.int32(2**31 - 1)
FAR = 1 << 40
#: A blank next to another white space: there the pattern can join what lies on both sides of the blank.
JOINED = re.compile(r"\s (?=\s|\Z)|  ")

#: A letter, a number, neither, and a white space of which every Unicode version says so.
STAND_INS = {"letter": "\u00aa", "number": "\u00b2", "other": "\u2022", "space": "\u2003"}


def odd_points(joined: Callable[[str, str], np.ndarray]) -> dict[int, str]:
    """Code points that the library takes for another class (letter, number, space, other) than the `regex` module, with a stand-in of the library's class.

    The two go by different versions of Unicode. joined(first, points) says for each point whether the library leaves first + point in one piece.
    """
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]))
    own = {kind: set(regex.findall(pattern, every)) for kind, pattern in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s"))}
    left = "".join(regex.findall(r"[^\p{Cn}\p{Co}\p{Cs}]", every))
    odd = {}
    for kind, first in (("letter", "a"), ("number", "1"), ("other", "!"), ("space", "")):
        same = joined(first, left) if first else np.ones(len(left), bool)
        for c in (c for c, x in zip(left, same.tolist(), strict=True) if x):
            if c not in own[kind] if kind in own else any(c in x for x in own.values()):
                odd[ord(c)] = STAND_INS[kind]
        left = "".join(c for c, x in zip(left, same.tolist(), strict=True) if not x)
    return odd


@lru_cache(maxsize=4)
def odd_in_tiktoken(pattern: str) -> dict[int, str]:
    """The odd points of tiktoken: a toy vocabulary merges a, 1 or ! with the first byte of a point where the pattern leaves them in one piece."""
    ranks = {bytes([i]): i for i in range(256)}
    for first in b"a1!":
        for lead in range(0xC2, 0xF5):
            ranks[bytes([first, lead])] = len(ranks)
    encoding = tiktoken.Encoding("toy", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def joined(first: str, points: str) -> np.ndarray:
        ids = np.array(encoding.encode_ordinary("".join(f"{first}{c}\n" for c in points)))
        starts = np.concatenate([[0], np.flatnonzero(ids == 10)[:-1] + 1]) if len(points) else np.zeros(0, np.int64)
        return ids[starts] >= 256 if len(points) else np.zeros(0, bool)

    return odd_points(joined)


@lru_cache(maxsize=4)
def odd_in_tokenizers(content: str) -> dict[int, str]:
    """The odd points of a tokenizers vocabulary, by the pieces of its own pre-tokenizer."""
    cut = Tokenizer.from_str(content).pre_tokenizer

    def joined(first: str, points: str) -> np.ndarray:
        starts = np.zeros(3 * len(points) + 1, bool)
        starts[[at[0] for _, at in cut.pre_tokenize_str("".join(f"{first}{c}\n" for c in points))]] = True
        return ~starts[1 : 3 * len(points) : 3]

    return odd_points(joined)


def _listed(odd: dict[int, str]) -> tuple[str, str]:
    return "".join(map(chr, odd)), "".join(odd.values())


class Cutter:
    """Cuts texts by a vocabulary's pattern with the library's classes of code points."""

    def __init__(self, pattern: str, odd: dict[int, str]):
        self.pattern, self.odd = regex.compile(pattern), odd
        self.points = frozenset(map(chr, odd))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.points.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table at most an eighth full; -1 stands for an empty slot."""
    size = 1 << (len(keys) * 8).bit_length()
    own, kept = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
    at, left = _slot(keys, size), np.arange(len(keys))
    while left.size:
        free = left[own[at[left]] == -1]
        own[at[free]] = keys[free]
        left = left[own[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & (size - 1)
    kept[at] = values
    return own, kept


class Ranks:
    """A vocabulary given as ranks of byte strings, as the tiktoken library reads it."""

    def __init__(self, content: bytes, pattern: str, odd: dict[int, str]):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.cut = Cutter(pattern, odd)
        self.size = max(self.rank.values()) + 1
        self.word: list[bytes] = [b""] * self.size
        for token, r in self.rank.items():
            self.word[r] = token
        self.pair = {(self.rank[t[:i]], self.rank[t[i:]]): r for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank}
        keys = np.fromiter((a * self.size + b for a, b in self.pair), np.int64, len(self.pair))
        self.keys, self.values = _table(keys, np.fromiter(self.pair.values(), np.int32, len(self.pair)))
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = _slot(key, self.keys.size)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        more = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while more.size:
            at[more] = (at[more] + 1) & (self.keys.size - 1)
            found = self.keys[at[more]]
            out[more[found == key[more]]] = self.values[at[more[found == key[more]]]]
            more = more[(found != key[more]) & (found >= 0)]
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece by a segment tree: a leaf for each byte position holds the rank of the pair that starts there."""
        n = len(piece)
        ids, pair = [int(self.byte[b]) for b in piece], self.pair
        size = 1 << (n - 1).bit_length()
        far = (1 << 40, 0)
        tree = [far] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = (pair.get((ids[i], ids[i + 1]), far[0]), i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n

        def put(i: int, value: tuple[int, int]) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1][0] < far[0]:
            rank, i = tree[1]
            gone = after[i]
            ids[i], live[gone], right = rank, False, after[gone]
            after[i] = right
            if gone < n - 1:
                put(gone, far)
            if right < n:
                before[right] = i
                put(i, (pair.get((rank, ids[right]), far[0]), i))
            else:
                put(i, far)
            if (left := before[i]) >= 0:
                put(left, (pair.get((ids[left], rank), far[0]), left))
        return [x for x, alive in zip(ids, live, strict=True) if alive]

    def encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most width bytes (a power of two) by as many segment trees, all merged step by step together.

        A leaf holds rank * width + position, so a tree's root is its leftmost minimum.
        """
        w = len(pieces)
        length = np.fromiter(map(len, pieces), np.int32, w)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(w, width)
        ids = self.byte[raw]
        place = np.arange(width, dtype=np.int32)
        tree = np.full((w, 2 * width), NONE, np.int32)
        rank = self.look(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(w, width - 1)
        merges = (rank < NONE) & (place[1:] < length[:, None])
        tree[:, width:-1] = np.where(merges, np.where(merges, rank, 0) * np.int32(width) + place[:-1], NONE)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        after = np.tile(place + 1, w)
        before = np.tile(place - 1, w)
        live = (place < length[:, None]).reshape(-1)
        ids = ids.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < NONE).astype(np.int32)
        flat = tree.reshape(-1)

        def look(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
            got = self.look(a, b)
            return np.where(got < NONE, np.where(got < NONE, got, 0) * np.int32(width) + at, NONE)

        while rows.size:
            root = flat[rows * (2 * width) + 1]
            at, new = root % width, root // width
            own = rows * width
            gone = after[own + at]
            right = after[own + gone]
            ids[own + at], after[own + at], live[own + gone] = new, right, False
            value = np.full((3, rows.size), NONE, np.int32)
            inner = np.flatnonzero(right < length[rows])
            before[own[inner] + right[inner]] = at[inner]
            value[1, inner] = look(new[inner], ids[own[inner] + right[inner]], at[inner])
            left = before[own + at]
            has = np.flatnonzero(left >= 0)
            value[2, has] = look(ids[own[has] + left[has]], new[has], left[has])
            # three point updates, climbing together; a row without left neighbour repeats its own leaf
            value[2, left < 0] = value[1, left < 0]
            node = np.concatenate([gone, at, np.where(left < 0, at, left)]) + np.int32(width)
            base = np.concatenate([rows, rows, rows]) * (2 * width)
            flat[base + node] = value.reshape(-1)
            level = width
            while level > 1:
                node >>= 1
                level >>= 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])
            rows = rows[flat[rows * (2 * width) + 1] < NONE]
        live = live.reshape(w, width)
        ids = ids.reshape(w, width)
        counts = live.sum(axis=1)
        packed = ids[live].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)]) * 4
        return [packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each distinct piece as little-endian unsigned 32-bit integers."""
        done: dict[str, bytes] = {}
        by_width: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.rank.get(raw)) is not None:
                done[piece] = whole.to_bytes(4, "little")
            elif len(raw) > 32:
                done[piece] = np.array(self.encode_long(raw), "<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(piece)
        for width, some in by_width.items():
            for start in range(0, len(some), 16384):
                part = some[start : start + 16384]
                done.update(zip(part, self.encode_many([x.encode() for x in part], width), strict=True))
        return done

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.word.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Encodes texts by a vocabulary; keeps at most `most` chunks and as many pieces."""

    def __init__(self, ranks: Ranks, most: int = 500_000):
        self.ranks, self.most = ranks, most
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The text cut before blanks where no piece of the pattern reaches across; else whole pieces."""
        if JOINED.search(text):
            return self.ranks.cut(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) + len(chunks) > self.most:
            self.known.clear()
        cut = {x: self.ranks.cut(x) for x in chunks}
        pieces = {p for x in cut.values() for p in x}
        if len(self.pieces) + len(pieces) > self.most:
            self.pieces.clear()
        self.pieces.update(self.ranks.encode_pieces(list(pieces - self.pieces.keys())))
        for chunk, parts in cut.items():
            self.known[chunk] = b"".join(map(self.pieces.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(texts), 256):
            cut = [self.chunks(t) for t in texts[start : start + 256]]
            wanted = set().union(*cut)
            if new := wanted - self.known.keys():
                self.learn(new)
                if gone := wanted - self.known.keys():
                    self.learn(gone)
            get = self.known.__getitem__
            out += [b"".join(map(get, x)) for x in cut]
        return out


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str, points: str, stand_ins: str) -> Encoder:
    return Encoder(Ranks(content, pattern, dict(zip(map(ord, points), stand_ins, strict=True))))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), ids_sha256, decoded_sha256 of each whole text.

    Null and empty texts have no ids and the digests of no bytes; repeated rows give repeated rows; other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern, *_listed(odd_in_tiktoken(pattern))))

    def rows(texts: list[str]) -> dict[str, list]:
        encoder = _encoder(*shared.value)
        ids = encoder.encode(texts)
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids": ids,
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(encoder.ranks.decode(x)).hexdigest() for x in ids],
        }

    return text_to_rows(docs, "n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string", rows, text=text)


class Prefixes:
    """Token counts at every prefix, by dynamic programming over a piece's byte positions.

    The tokens of a prefix end in exactly one token t such that the prefix before t ends in a token which stays apart from t
    when both are merged; so the last token, and with it the count, of every prefix follows from shorter prefixes.
    """

    def __init__(self, content: str, odd: dict[int, str], most: int = 500_000):
        self.cut = Cutter(self.pattern, odd)
        data = json.loads(content)
        to_byte = {c: b for b, c in byte_letters().items()}
        vocab = data["model"]["vocab"]
        raw = {t: bytes(to_byte[c] for c in t) for t in vocab if all(c in to_byte for c in t)}
        self.id = {raw[t]: i for t, i in vocab.items() if t in raw}
        self.word = {i: t for t, i in self.id.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.pair = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        special = [x["content"] for x in data["added_tokens"] if x["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.names = special
        self.first = {bytes([i]): self.id[bytes([i])] for i in range(256)}
        made = {new: (rank, a, b) for (a, b), (rank, new) in self.pair.items()}
        self.left = {t: self._edge(t, made, 1) for t in self.word}
        self.right = {t: self._edge(t, made, 2) for t in self.word}
        self.merged = {a << 20 | b: rank for (a, b), (rank, _) in self.pair.items()}
        whole = set(self.first.values())
        for t, (rank, a, b) in sorted(made.items(), key=lambda x: x[1]):
            if a in whole and b in whole and self._apart(a << 20 | b, rank):
                whole.add(t)
        self.match = ahocorasick.Automaton()
        for t in whole:
            self.match.add_word(self.word[t].decode("latin-1"), (t, len(self.word[t])))
        self.match.make_automaton()
        self.apart = Cache(self._apart, most)
        self.counts = Cache(self._counts, 100_000)
        self.sizes = Cache(lambda piece: self._counts(piece.encode())[-1], most)
        self.totals = Cache(self._total, most)

    @staticmethod
    def _edge(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of a token while it is merged, each with the rank of the merge that takes it up."""
        out = [(token, FAR)]
        while out[-1][0] in made:
            out.append((made[out[-1][0]][side], made[out[-1][0]][0]))
        return out[::-1]

    def _apart(self, key: int, before: int = FAR) -> bool:
        """Whether no merge across the border of two tokens comes before the merges on either side, or before a given rank."""
        x, y, i, j, find = self.right[key >> 20], self.left[key & 0xFFFFF], 0, 0, self.merged.get
        while True:
            (a, ends), (b, until) = x[i], y[j]
            rank = find(a << 20 | b, FAR)
            if rank < ends and rank <= until and rank < before:
                return False
            if ends <= until:
                if ends == FAR:
                    return True
                i += 1
            else:
                j += 1

    def _counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for each i from 0 to its length."""
        last, count, apart = [0] * (len(piece) + 1), [0] * (len(piece) + 1), self.apart
        for end, (token, size) in self.match.iter(piece.decode("latin-1")):
            if not count[end + 1]:
                start = end + 1 - size
                if not start or apart[last[start] << 20 | token]:
                    last[end + 1], count[end + 1] = token, count[start] + 1
        return count

    def _total(self, chunk: str) -> int:
        return sum([self.sizes[p] for p in self.cut(chunk)])

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def parts(self, text: str) -> list[str | None]:
        """The text cut at the vocabulary's special strings, which stand as None."""
        if not self.special or not any(x in text for x in self.names):
            return [text]
        out: list[str | None] = []
        at = 0
        for m in self.special.finditer(text):
            out += [text[at : m.start()], None]
            at = m.end()
        return [*out, text[at:]]

    def total(self, text: str) -> int:
        n = 0
        for part in self.parts(text):
            if part is None:
                n += 1
            elif JOINED.search(part):
                n += sum(map(self.totals.__getitem__, self.cut(part)))
            else:
                first, *rest = part.split(" ")
                n += (self.totals[first] if first else 0) + sum([self.totals[" " + x] for x in rest])
        return n

    def at_prefixes(self, text: str) -> list[int]:
        """Tokens of text[:i], encoded by itself, for each i from 0 to its length in characters."""
        out, parts, at = [0], self.parts(text), 0
        for part, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            base, at = out[-1], at + len(part or "")
            # up to its last character a special string is plain text that goes on from the part before it
            name = "" if special == "" else next(x for x in sorted(self.names, key=len, reverse=True) if text.startswith(x, at))
            counts = self._plain_prefixes(part + name[:-1])
            out += [base + n for n in counts[1:]]
            if name:
                out.append(base + counts[len(part)] + 1)
                at += len(name)
        return out

    def _plain_prefixes(self, text: str) -> list[int]:
        out, base, before = [0], 0, None
        for piece in self.cut(text):
            counts = self.counts[piece.encode()]
            ends = np.cumsum([len(c.encode()) for c in piece]).tolist()
            own = [base + counts[e] for e in ends]
            if before is not None and self.space(before) and self.space(piece[0]):
                # a prefix that ends here ends in one run of white space
                own[0] = base - self.counts[before.encode()][-1] + self.counts[(before + piece[0]).encode()][-1]
            if piece in ("'re", "'ve", "'ll"):
                own[1] = base + self.counts[b"'"][-1] + self.counts[piece[1].encode()][-1]
            out += own
            base += counts[-1]
            before = piece
        return out

    @staticmethod
    def space(text: str) -> bool:
        return regex.fullmatch(r"\s+", text) is not None


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _prefixes(content: str, points: str, stand_ins: str) -> Prefixes:
    return Prefixes(content, dict(zip(map(ord, points), stand_ins, strict=True)))


def _shared(docs: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    return docs.sparkSession.sparkContext.broadcast((content, *_listed(odd_in_tokenizers(content))))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text, by prefix dynamic programming.

    Null texts count as empty (0 tokens, not over); repeated rows give repeated rows; other columns are ignored.
    """
    shared = _shared(docs, vocabulary)

    def rows(texts: list[str]) -> dict[str, list]:
        counter = _prefixes(*shared.value)
        n = [counter.total(t) for t in texts]
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return text_to_rows(docs, "n_bytes bigint, n_tokens bigint, over_limit boolean", rows, text=text)


def prefix_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id, counts (array<int>): counts[i] is the tokens of the text's first i characters, encoded by themselves.

    One entry a character: a table of this kind answers any number of truncation questions without encoding again.
    Null texts have the one count 0.
    """
    shared = _shared(docs, vocabulary)
    return text_to_rows(docs, "counts array<int>", lambda texts: {"counts": [_prefixes(*shared.value).at_prefixes(t) for t in texts]}, text=text)


def truncation_points(counts: DataFrame, budget: int) -> DataFrame:
    """doc_id, cut: the longest prefix, in characters, of at most budget tokens, read from prefix_counts()."""
    return counts.selectExpr("doc_id", f"aggregate(counts, struct(0 as i, 0 as cut), (a, c) -> struct(a.i + 1 as i, if(c <= {int(budget)}, a.i, a.cut) as cut)).cut as cut")
