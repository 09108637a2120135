"""Attributes of tracks from class scores and measurements: labels by fixed rules, ranks within the catalog, reuse of earlier analyses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.small import counts_below
from tunespark.operators.vectors import TunesparkError


def excerpt_class_scores(logits: DataFrame) -> DataFrame:
    """(track_id, excerpt, class, logit) -> (track_id, class_scores): mean chance of each tagged class over a track's excerpts."""
    means = logits.where(F.col("class").isin(*V.CLASSES)).groupBy("track_id", "class").agg(F.round(F.avg(1 / (1 + F.exp(-F.col("logit")))), 6).alias("score"))
    return means.groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "score")))).alias("class_scores"))


def _score(scores: Column | str, name: str) -> Column:
    return F.col(scores)[name] if isinstance(scores, str) else scores[name]


def vocals_label(scores: Column | str) -> Column:
    """struct(label, vocal_score, top_class): the strongest vocal class, of equals the last by name; between both thresholds unknown."""
    top = F.array_max(F.array(*[F.struct(_score(scores, c).alias("score"), F.lit(c).alias("class")) for c in V.VOCAL_CLASSES]))
    label = F.when(top["score"] >= V.VOCAL_ON, "vocal").when(top["score"] <= V.VOCAL_OFF, "instrumental")
    return F.struct(label.alias("label"), F.round(top["score"], 5).alias("vocal_score"), top["class"].alias("top_class"))


def genre_scores(scores: Column | str) -> dict[str, Column]:
    return {g: F.greatest(*own) if len(own := [_score(scores, c) for c in classes]) > 1 else own[0] for g, classes in V.GENRE_CLASSES.items()}


def genre_label(scores: Column | str) -> Column:
    """struct(label, score, scores): the strongest genre, of equals the first by name; unknown under the least score."""
    by_genre = genre_scores(scores)
    best = F.array_min(F.array(*[F.struct((-s).alias("minus"), F.lit(g).alias("genre")) for g, s in by_genre.items()]))
    every = F.map_from_arrays(F.array(*map(F.lit, sorted(by_genre))), F.array(*[F.round(by_genre[g], 5) for g in sorted(by_genre)]))
    return F.struct(F.when(-best["minus"] >= V.GENRE_MIN, best["genre"]).alias("label"), F.round(-best["minus"], 5).alias("score"), every.alias("scores"))


def mood_labels(scores: Column | str) -> Column:
    """Moods at or over the least score, strongest first, of equals by name, three at most."""
    ranked = F.array_sort(F.array(*[F.struct((-_score(scores, c)).alias("minus"), F.lit(m).alias("mood")) for m, c in V.MOOD_CLASSES.items()]))
    return F.slice(F.transform(F.filter(ranked, lambda x: -x["minus"] >= V.MOOD_MIN), lambda x: x["mood"]), 1, V.MAX_MOODS)


def percentile_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of each value among all, from 0 to 1 (0.5 for a single row); null for a null value."""
    below = counts_below(df, value)
    rank = F.when(F.col("total") == 1, 0.5).otherwise((F.col("below") + F.col("through") - 1) / 2 / (F.col("total") - 1))
    return df.join(below.select(value, rank.alias(out)), value, "left")


def with_energy(df: DataFrame) -> DataFrame:
    """df with `energy`: the mean of its loudness and onset-rate ranks within this catalog, to 4 decimals."""
    ranked = percentile_ranks(percentile_ranks(df, "loudness_dbfs", "__loud"), "onset_rate", "__onset")
    return ranked.withColumn("energy", F.round((F.col("__loud") + F.col("__onset")) / 2, 4)).drop("__loud", "__onset")


def energy_band(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value < 1 / 3, "low").when(value < 2 / 3, "medium").when(value.isNotNull(), "high")


def label_tracks(raw: DataFrame) -> DataFrame:
    """Raw analyses (track_id, class_scores, loudness_dbfs, onset_rate, bpm, pulse_clarity) -> flat attributes of each track, with its audio_sha256 where the analyses carry one."""
    labelled = raw.withColumn("__v", vocals_label("class_scores")).withColumn("__g", genre_label("class_scores"))
    flat = labelled.select(
        "track_id", F.col("__v.label").alias("vocals"), F.col("__v.vocal_score").alias("vocal_score"), F.col("__v.top_class").alias("vocal_class"),
        F.col("__g.label").alias("genre"), F.col("__g.score").alias("genre_score"), mood_labels("class_scores").alias("moods"), "loudness_dbfs", "onset_rate", "bpm", "pulse_clarity",
        *(["audio_sha256"] if "audio_sha256" in raw.columns else []),
    )
    return with_energy(flat)


@dataclass(frozen=True)
class AnalysisConfig:
    """What raw analyses depend on: the tagger and its revision, the version of the analysis, sample rates, tagged classes and the pulse measure."""

    tagger: str = ""
    revision: str = ""
    version: int = 1
    tagger_rate: int = 16_000
    rhythm_rate: int = 22_050
    classes: tuple[str, ...] = V.CLASSES
    tempo_limits: tuple[float, float] = V.TEMPO_LIMITS
    pulse_min: float = V.PULSE_MIN


def config_digest(config: AnalysisConfig = AnalysisConfig()) -> str:
    """Changes with whatever makes stored analyses unfit for use; labels and their thresholds are worked out anew on every build."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()


def build_attributes(index: DataFrame, analyse: Callable[[DataFrame], DataFrame], previous: DataFrame | None = None, config: AnalysisConfig = AnalysisConfig()) -> tuple[DataFrame, DataFrame]:
    """(attributes, ids analysed now). A raw analysis is used again if the track's audio digest and the configuration are the same.

    index: track_id, audio_sha256. analyse: rows to analyse -> raw analyses. All tracks are labelled anew, since energy is relative to the catalog.
    """
    raw = ["track_id", "audio_sha256", "class_scores", "loudness_dbfs", "onset_rate", "bpm", "pulse_clarity"]
    if previous is None:
        fresh = analyse(index).drop("audio_sha256").join(index.select("track_id", "audio_sha256"), "track_id")
        return label_tracks(fresh), index.select("track_id")
    old = previous.where(F.col("config_digest") == config_digest(config)).select(*raw)
    kept = index.select("track_id", "audio_sha256").join(old, ["track_id", "audio_sha256"])
    todo = index.join(old.select("track_id", "audio_sha256"), ["track_id", "audio_sha256"], "left_anti")
    fresh = analyse(todo).drop("audio_sha256").join(todo.select("track_id", "audio_sha256"), "track_id")
    return label_tracks(kept.select(*raw).unionByName(fresh.select(*raw))), todo.select("track_id")


def save_attributes(df: DataFrame, path: str, config: AnalysisConfig = AnalysisConfig()) -> None:
    df.withColumn("config_digest", F.lit(config_digest(config))).write.mode("overwrite").parquet(path)


def staleness(attributes: DataFrame, index: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(problem, tracks) why stored attributes don't fit an index: digest of the configuration, missing or surplus tracks, other audio."""
    a = attributes.select("track_id", F.col("audio_sha256").alias("a_sha"), "config_digest", F.lit(True).alias("in_a"))
    b = index.select("track_id", F.col("audio_sha256").alias("b_sha"), F.lit(True).alias("in_b"))
    problem = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_b").isNull(), "surplus").when(F.col("config_digest") != config_digest(config), "configuration").when(F.col("a_sha") != F.col("b_sha"), "audio")
    return a.join(b, "track_id", "full_outer").select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("tracks"))


def load_attributes(spark, path: str, index: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Stored attributes, refused with the reason if they don't fit the index."""
    stored = spark.read.parquet(path)
    bad = staleness(stored, index, config).collect()
    if bad:
        raise TunesparkError("stale attributes: " + ", ".join(f"{r['problem']} ({r['tracks']})" for r in bad))
    return stored
