"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword; one binary linear classifier a bit predicts it from hashed byte n-grams of the whole text.
Decoding takes the codeword of least loss, each bit weighted by how far its classifier beats chance; a text whose two best codewords lie too close is
flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunespark.llm.common import filter_rows, held_out, text_to_rows

#: Hashed n-gram buckets, longest n-gram, labelled rows a language that a fit uses at most, and labelled rows in all (one of each language at least).
BUCKETS, LONGEST, ROWS_A_LANGUAGE, ROWS = 4096, 4, 600, 20_000
#: Parts that a label's rows are sampled in.
SALTS = 64
UNKNOWN = "und"
#: Texts are cut in parts of this many bytes while n-grams are counted; the counts of all parts add up.
PART = 1 << 20


def features(text: str) -> np.ndarray:
    """Square roots of hashed byte n-gram counts, at length 1; zeros for an empty text."""
    raw = text.lower().encode()
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), PART):
        b = np.frombuffer(raw[start : start + PART + LONGEST - 1], np.uint8).astype(np.uint32)
        own = min(PART, len(raw) - start)
        key = np.zeros(len(b), np.uint32)
        for n in range(1, LONGEST + 1):
            key = (key[: len(b) - n + 1] + np.uint32(1)) * np.uint32(0x01000193)
            key = key * np.uint32(31) + b[n - 1 :]
            counts += np.bincount(((key * np.uint32(0x9E3779B1)) >> np.uint32(20))[:own], minlength=BUCKETS)
    x = np.sqrt(counts.astype(np.float32))
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of the languages for few of them, else a random code that keeps its rows apart."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        columns = [c for c in product([1, -1], repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T
    bits, rng, best = max(15, 5 * int(np.ceil(np.log2(n)))), np.random.RandomState(7), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits)).astype(np.float32)
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if (abs(code.sum(0)) < n).all() and apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    #: Least lead of the best codeword's loss over the second's: texts under it are ambiguous.
    lead: float = 0.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword for rows of features."""
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -np.clip(margin, -30, 30) * word) * self.trust).sum(1) for word in self.code], axis=1)

    def predict(self, texts: list[str], share: float = 1.0) -> tuple[list[str], list[float], list[bool]]:
        """Language, likelihood, and whether a text is ambiguous: its lead is under this share of the least lead, or it has no letter."""
        names, scores, doubtful = [], [], []
        for start in range(0, len(texts), 64):
            part = texts[start : start + 64]
            loss = self.losses(np.stack([features(t) for t in part]))
            like = np.exp(-(loss - loss.min(1, keepdims=True)))
            like /= like.sum(1, keepdims=True)
            leads = np.diff(np.sort(loss, axis=1)[:, :2], axis=1)[:, 0] if loss.shape[1] > 1 else np.full(len(part), np.inf)
            for t, row, lead in zip(part, like, leads.tolist(), strict=True):
                order = np.argsort(-row, kind="stable")
                letters = any(map(str.isalpha, t))
                names.append(self.languages[order[0]] if letters else UNKNOWN)
                scores.append(float(row[order[0]]) if letters else 0.0)
                doubtful.append(not letters or lead < share * self.lead)
        return names, scores, doubtful


def least_lead(model: LanguageModel, x: np.ndarray, at: np.ndarray, rng: np.random.RandomState, pairs: int = 2000) -> float:
    """The lead under which a text counts as ambiguous: set so that it takes in mixtures of two languages and none of the texts told rightly.

    Mixtures are made of pairs of rows of different languages, as if one text held both halves.
    """
    if len(model.languages) < 2 or len(at) < 20:
        return 0.0
    leads = lambda rows: np.diff(np.sort(model.losses(rows), axis=1)[:, :2], axis=1)[:, 0]
    right = model.losses(x).argmin(1) == at
    a, b = rng.randint(0, len(at), (2, pairs))
    mixed = at[a] != at[b]
    if not mixed.any() or not right.any():
        return 0.0
    both = np.sqrt(x[a[mixed]] ** 2 + x[b[mixed]] ** 2) / np.sqrt(2)
    return float(min(leads(x[right]).min(), np.quantile(leads(both), 0.9)))


def sample_rows(docs: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` rows of each label, those of least hash, outside the held-out fold.

    The least of each of SALTS parts of a label are taken first, so that a common label's rows don't meet in one task.
    """
    own = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).alias("label"))
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SALTS)))
    for by in (("label", "part"), ("label",)):
        by_hash = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        own = own.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= most)
    return own.select("doc_id", "label")


def fit_binary(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, ridge: float = 1e-4, rate: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers, one a column of y (chances from 0 to 1), by accelerated gradient steps."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * vw) + b + 0.9 * vb, -30, 30)))
        g = (p - y) * weight
        vw = 0.9 * vw - rate * 0.1 * (x.T @ g + ridge * w)
        vb = 0.9 * vb - 0.1 * rate * 0.1 * g.sum(0)
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> LanguageModel | None:
    """Learn from text and non-null lang outside the held-out fold: at most rows_a_language rows of each language (a bounded sample).

    The n-gram counts of these rows are made on the executors. Of very many languages each gets fewer rows, so that all rows stay within ROWS, but one at least:
    every language of the table is learned. None if there is no labelled row.
    """
    many = docs.where("lang is not null").select("lang").distinct().count()
    chosen = sample_rows(docs, "lang", min(rows_a_language, max(1, ROWS // max(1, many))))
    # the sample is bounded by rows_a_language, so that texts stay where they are
    rows = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    made = text_to_rows(rows, "x binary", lambda texts: {"x": [(features(t) * 255 + 0.5).astype(np.uint8).tobytes() if any(map(str.isalpha, t)) else b"" for t in texts]}, keep=("doc_id", "label"))
    got = made.where(F.length("x") > 0).orderBy("label", F.xxhash64("doc_id"), "doc_id").toArrow()
    labels = got.column("label").to_pylist()
    if not labels:
        return None
    languages = sorted(set(labels))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(len(labels), BUCKETS).astype(np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    place = {v: i for i, v in enumerate(languages)}
    at = np.array([place[v] for v in labels])
    code = codewords(len(languages))
    weight = 1 / np.bincount(at)[at]
    # a fifth of the rows says how far each bit can be trusted; then all rows are learned from
    tell = np.arange(len(at)) % 5 == 0
    bits = (code[at] + 1) / 2
    if tell.all() or len(at) < 20:
        trust, lead = np.ones(code.shape[1]), 0.0
    else:
        w, b = fit_binary(x[~tell], bits[~tell], weight[~tell])
        right = ((x[tell] @ w + b > 0) == (bits[tell] > 0.5)).mean(0)
        trust = np.clip(2 * right - 1, 0.05, 1)
        lead = least_lead(LanguageModel(languages, code, w, b, (trust / trust.mean()).astype(np.float32)), x[tell], at[tell], np.random.RandomState(3))
    w, b = fit_binary(x, bits, weight)
    return LanguageModel(languages, code, w, b, (trust / trust.mean()).astype(np.float32), lead)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each whole text.

    Null texts and texts without a letter are `und` with score 0 and ambiguous; so is every text when nothing could be learned.
    Ties go to the language first in order; repeated rows give repeated rows; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str]) -> dict[str, list]:
        if shared.value is None:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "ambiguous": [True] * len(texts)}
        names, scores, doubtful = shared.value.predict(texts)
        return {"lang_pred": names, "score": scores, "ambiguous": doubtful}

    made = text_to_rows(docs, "lang_pred string, score double, ambiguous boolean", rows)
    return made.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


#: Texts go whose lead is under this share of the one that flags them, so that short texts of one language stay.
REJECTED = 0.25


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of docs whose language can be told; null, empty and letterless texts go, as do those with next to no lead."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, lambda texts: [shared.value is not None and not doubtful for doubtful in (shared.value.predict(texts, REJECTED)[2] if shared.value else texts)])
