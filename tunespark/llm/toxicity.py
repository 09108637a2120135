"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their accuracies and correlations,
and a linear classifier trained on the posterior labels.

A voter is a word, a word beginning (4 to 6 letters and anything after) or a pattern of the text (spaced-out, masked or digit-for-letter words, shouting,
repeated signs). The lexicon and the patterns vote whatever the sample says; others are those that the labelled sample ties to toxic texts.
Voters speak up or stay silent. The generative model holds for each voter how often it speaks in toxic and in clean texts,
learned by expectation maximisation with the given label as one more fallible voter; voters that speak up together more
than the classes explain, as estimated anew from the posterior of each round, share their weight. The classifier then learns the posterior from hashed words, word beginnings and patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import WORDS, Cache, discard, filter_rows, held_out, materialize, text_to_rows
from tunespark.llm.language_id import sample_rows

#: Labelled rows of each class that a fit uses at most; voters and classifier features at most; lengths of word beginnings.
ROWS_A_CLASS, VOTERS, FEATURES, STARTS = 2500, 300, 1000, (4, 5, 6)
SPACE = 1 << 22
#: Patterns of a text, each a voter. Each begins with the characters it is rarest to find, looking back from them, so that a search skips along.
PATTERNS = {
    "spaced": re.compile(r"[ .*-][^\W\d_][ .*-][^\W\d_][ .*-][^\W\d_](?![^\W_])"),
    "masked": re.compile(r"[*@$#](?<=[^\W\d_][*@$#])[*@$#]?[^\W\d_]"),
    "digits": re.compile(r"[013457](?<=[^\W\d_][013457])[^\W\d_]"),
    "shouting": re.compile(r"[A-Z]{4,}\W{1,3}[A-Z]{4,}\W{1,3}[A-Z]{4,}"),
    "signs": re.compile(r"!!!|\?\?\?|!\?!"),
}
#: Common English insults, as voters whatever the sample says.
LEXICON = ("asshole", "bastard", "bitch", "clown", "coward", "creep", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "pathetic", "pig", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless")


def terms(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}*" for n in STARTS if len(word) >= n)]


def bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) % SPACE


def patterns(text: str) -> list[str]:
    return [f"~{name}" for name, pattern in PATTERNS.items() if pattern.search(text)]


def sampled_terms(text: str) -> np.ndarray:
    """Buckets of a text's terms for a fit: each term of each word once, and its patterns."""
    return np.array([bucket(f) for w in sorted(word_set(text)) for f in terms(w)] + [bucket(p) for p in patterns(text)], "<u4")


def word_set(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    bias: float
    report: dict = field(default_factory=dict)
    words: Cache | None = None

    def scores(self, texts: list[str]) -> list[float]:
        if self.words is None:
            find = self.weights.get
            self.words = Cache(lambda word: math.fsum(find(bucket(t), 0.0) for t in terms(word)), 100_000)
        out = []
        for text in texts:
            s = self.bias + math.fsum(map(self.words.__getitem__, word_set(text))) + math.fsum(self.weights.get(bucket(p), 0.0) for p in patterns(text))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior chance of toxic for each row of votes (rows x voters, 0 or 1), with the given label as a fallible voter.

    Returns the posterior and the estimates: prior, how often each voter speaks in either class, label accuracy, voter weights.
    """
    n, k = votes.shape
    p = np.where(given > 0, 0.9, 0.1)
    share = np.ones(k)
    prior = truth = None
    for step in range(rounds):
        prior = float(np.clip(p.mean(), 0.01, 0.99))
        a = (votes.T @ p + 0.5) / (p.sum() + 1.0)
        b = (votes.T @ (1 - p) + 0.5) / ((1 - p).sum() + 1.0)
        truth = (float(np.clip((p * given).sum() / p.sum(), 0.05, 0.995)), float(np.clip(((1 - p) * given).sum() / (1 - p).sum(), 0.005, 0.95)))
        if step >= 2 and step % 3 == 2 and k > 1:
            # what is left of the voters' covariance once the class is known; voters that speak together share their weight
            rest = votes - (np.outer(p, a) + np.outer(1 - p, b))
            cov = rest.T @ rest / n
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rho = np.clip(cov / np.outer(scale, scale), -1, 1)
            np.fill_diagonal(rho, 0)
            share = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(1))
        speak, silent = np.log(a / b) * share, np.log((1 - a) / (1 - b)) * share
        logit = math.log(prior / (1 - prior)) + votes @ speak + (1 - votes) @ silent
        logit += np.where(given > 0, math.log(truth[0] / truth[1]), math.log((1 - truth[0]) / (1 - truth[1])))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, {"prior": prior, "speaks_if_toxic": a, "speaks_if_clean": b, "label_says_toxic": truth, "share": share}


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, f, times) of each feature of each row, a row at a time."""
    for batch in batches:
        for row, terms in zip(batch.column("row").to_pylist(), batch.column("terms")):
            f, times = np.unique(np.frombuffer(terms.as_buffer(), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), row)), pa.array(f.astype(np.int64)), pa.array(times)], names=["row", "f", "times"])


def _strongest(occurs: DataFrame, p: np.ndarray, most: int, least: int, z: float) -> list[int]:
    """Features that occur in at least `least` rows and lean to either side by z or more standard errors, strongest first, at most `most`.

    occurs: (f, row), each feature of each row once; p: the rows' chances of toxic, a bounded sample's. Counting is Spark's; what passes the driver are the strongest.
    """
    chances = occurs.sparkSession.createDataFrame(list(enumerate(map(float, p))), "row long, p double")
    n1, n0 = float(p.sum() + 1.0), float((1 - p).sum() + 1.0)
    counts = occurs.join(F.broadcast(chances), "row").groupBy("f").agg(F.sum("p").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= least)
    pos, neg = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    strength = F.abs(F.log(pos / n1) - F.log(neg / n0)) / F.sqrt(1 / pos + 1 / neg)
    strong = counts.withColumn("strength", F.round(strength, 9)).where(F.col("strength") >= z).orderBy(F.desc("strength"), "f").limit(most)
    return [r["f"] for r in strong.select("f").collect()]


def _matrix(occurs: DataFrame, rows: int, chosen: list[int], binary: bool) -> np.ndarray:
    """Rows by chosen features: how often each occurs (or whether)."""
    place = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((rows, len(chosen)), np.float32)
    if chosen:
        wanted = occurs.sparkSession.createDataFrame([(f,) for f in chosen], "f long")
        got = occurs.join(F.broadcast(wanted), "f").select("row", "f", "times").toArrow()
        x[got.column("row").to_numpy(), [place[f] for f in got.column("f").to_pylist()]] = got.column("times").to_numpy()
    return np.minimum(x, 1) if binary else x


def fit(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> ToxicityModel | None:
    """Learn from labels outside the held-out fold: at most rows_a_class rows of each label (a bounded sample).

    Words of these rows are hashed and counted on the executors, all of them: what passes the driver are counts of chosen voters and features. A doc_id with several labels is toxic if one says so. None if no such row has both a text and a label.
    """
    own = labels.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).when(F.col("toxic") == 0, 0)).alias("toxic"))
    chosen = sample_rows(own.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic", rows_a_class)
    # the sample is bounded by rows_a_class, so that texts stay where they are
    rows = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = materialize(text_to_rows(rows, "terms binary", lambda texts: {"terms": [sampled_terms(t).tobytes() for t in texts]}, keep=("doc_id", "label")), "sampled")
    # the sampled rows, bounded in number, are told by their place; rows that repeat a doc_id and its terms are one
    numbered = made.select("doc_id", "label", "terms", F.xxhash64("terms").alias("same"))
    texts = numbered.groupBy("doc_id", "same").agg(F.first("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "same").toArrow()
    given = np.array(texts.column("label").to_pylist(), np.float64)
    if not given.size or given.min() == given.max():
        return None
    rows_of = {v: c for v, c in labels.where(~held_out()).groupBy(F.when(F.col("toxic") > 0, 1).otherwise(0).alias("v")).count().collect()}
    places = docs.sparkSession.createDataFrame([(d, s, i) for i, (d, s) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("same").to_pylist()))], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, same long, row long")
    numbered = numbered.join(F.broadcast(places), ["doc_id", "same"]).dropDuplicates(["row"])
    occurs = materialize(numbered.select("row", "terms").mapInArrow(_occurrences, "row long, f long, times long"), "occurs")
    discard(made)
    least = 3
    named = [bucket(f"={w}") for w in LEXICON] + [bucket(f"~{name}") for name in PATTERNS]
    seen = {r["f"] for r in occurs.where(F.col("f").isin(named)).select("f").distinct().collect()}
    voters = list(dict.fromkeys([*(f for f in named if f in seen), *_strongest(occurs, given, VOTERS, least, 2.5)]))[:VOTERS]
    votes = _matrix(occurs, len(given), voters, True)
    if voters:
        p, report = label_model(votes, given)
    else:
        p, report = np.where(given > 0, 0.9, 0.1), {}
    chosen_features = list(dict.fromkeys([*voters, *_strongest(occurs, p, FEATURES, least, 3.0)]))[:FEATURES]
    x = _matrix(occurs, len(given), chosen_features, False)
    discard(occurs)
    # rows of a class that was sampled more thinly weigh more, so that scores fit the whole
    taken = {v: max(1, int((given == v).sum())) for v in (0, 1)}
    weight = np.where(given > 0, rows_of.get(1, 1) / taken[1], rows_of.get(0, 1) / taken[0])
    w, bias = _fit_linear(x, p, weight)
    return ToxicityModel(dict(zip(chosen_features, w.tolist(), strict=True)), float(bias), {"voters": len(voters), **report})


def _fit_linear(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 3e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """A logistic classifier of soft labels by Nesterov steps of a safe size; rows scaled down by their largest count."""
    n, k = x.shape
    weight = weight / weight.sum()
    size = float(((x * x).sum(1) + 1).astype(np.float64) @ weight) / 4 + ridge
    w, b = np.zeros(k), math.log(max(1e-3, p @ weight) / max(1e-3, 1 - p @ weight))
    old_w, old_b, t = w, b, 1.0
    xt = x.T.copy()
    for _ in range(rounds):
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        go = (last - 1) / t
        yw, yb = w + go * (w - old_w), b + go * (b - old_b)
        g = (1 / (1 + np.exp(-np.clip(x @ yw + yb, -30, 30))) - p) * weight
        old_w, old_b = w, b
        w, b = yw - (xt @ g + ridge * yw) / size, yb - g.sum() / size
    return w, b


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text (null as empty; a text without words gets the model's base rate).

    Without a model every score is 0. Repeated rows give repeated rows; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str]) -> dict[str, list]:
        return {"score": shared.value.scores(texts) if shared.value else [0.0] * len(texts)}

    made = text_to_rows(docs, "score double", rows)
    return made.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows of docs, all columns as they are, that score under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, lambda texts: [s < 0.5 for s in shared.value.scores(texts)] if shared.value else [True] * len(texts))
