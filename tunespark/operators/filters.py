"""Attribute filters: checks of requests, pass / mismatch / unknown verdicts, what was hidden, what can be asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.small import maybe_broadcast, pair_up
from tunespark.operators.attributes import energy_band

FILTERS = ("vocals", "genre", "mood", "energy", "tempo_min", "tempo_max")
PASS, UNKNOWN, MISMATCH = 0, 1, 2


def cleaned(requests: DataFrame) -> DataFrame:
    """Blank filter values become null: no filter."""
    return requests.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("vocals", "genre", "mood", "energy")})


def filter_errors(requests: DataFrame) -> DataFrame:
    """(query_id, error) of each request with a value outside the vocabulary or a tempo out of bounds."""
    own = cleaned(requests)
    low, high = V.TEMPO_LIMITS
    bad = [(c, ~F.col(c).isin(*values), f"unknown {c}") for c, values in {**V.LABELS, "energy": V.ENERGY_BANDS}.items()]
    bad += [(c, ~F.col(c).between(low, high), f"{c} out of range") for c in ("tempo_min", "tempo_max")]
    bad.append(("tempo_min", F.col("tempo_min") > F.col("tempo_max"), "tempo_min over tempo_max"))
    errors = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & test, text) for c, test, text in bad]))
    return own.select("query_id", F.explode(errors).alias("error"))


def _state(wanted: Column, known: Column, fits: Column) -> Column:
    return F.when(wanted.isNull(), PASS).when(~known, UNKNOWN).when(fits, PASS).otherwise(MISMATCH)


def verdict_code() -> Column:
    """Over a request's columns (f_*) and a track's: 0 pass, 1 unknown, 2 mismatch; a mismatch outranks an unknown."""
    band, bpm = energy_band("energy"), F.col("bpm")
    tempo = F.coalesce("f_tempo_min", "f_tempo_max")
    return F.greatest(
        _state(F.col("f_vocals"), F.col("vocals").isNotNull(), F.col("f_vocals") == F.col("vocals")),
        _state(F.col("f_genre"), F.col("genre").isNotNull(), F.col("f_genre") == F.col("genre")),
        _state(F.col("f_mood"), F.coalesce(F.size("moods") > 0, F.lit(False)), F.array_contains("moods", F.col("f_mood"))),
        _state(F.col("f_energy"), band.isNotNull(), F.col("f_energy") == band),
        _state(tempo, bpm.isNotNull(), (bpm >= F.coalesce("f_tempo_min", F.lit(0.0))) & (bpm <= F.coalesce("f_tempo_max", F.lit(1e9)))),
    )


def _wanted(requests: DataFrame) -> DataFrame:
    return cleaned(requests).select("query_id", *[F.col(c).alias(f"f_{c}") for c in FILTERS])


def _passed() -> Column:
    """What speaks for each active filter (f_*), in the order vocals, genre, mood, energy, tempo."""
    nothing, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def entry(attribute: str, value: Column, kind: str, score: Column = nothing, low: Column = nothing, high: Column = nothing) -> Column:
        return F.struct(F.lit(attribute).alias("attribute"), value.alias("value"), F.lit(kind).alias("kind"), score.alias("measure"), low.alias("low"), high.alias("high"))

    tempo = F.coalesce("f_tempo_min", "f_tempo_max")
    return F.array_compact(F.array(
        F.when(F.col("f_vocals").isNotNull(), entry("vocals", F.col("f_vocals"), "estimate", F.col("vocal_score"))),
        F.when(F.col("f_genre").isNotNull(), entry("genre", F.col("f_genre"), "estimate", F.col("genre_score"))),
        F.when(F.col("f_mood").isNotNull(), entry("mood", F.col("f_mood"), "estimate")),
        F.when(F.col("f_energy").isNotNull(), entry("energy", F.col("f_energy"), "measured", F.col("energy"))),
        F.when(tempo.isNotNull(), entry("tempo", text, "measured", F.col("bpm"), F.col("f_tempo_min"), F.col("f_tempo_max"))),
    ))


def apply_filters(requests: DataFrame, attributes: DataFrame) -> DataFrame:
    """(query_id, track_id, verdict, filters_passed) of each request and track; filters_passed only where the track passes.

    filters_passed lists, in the order vocals, genre, mood, energy, tempo, the active filters with what speaks for them.
    """
    both = pair_up(attributes, _wanted(requests)).withColumn("code", verdict_code())
    name = F.when(F.col("code") == MISMATCH, "mismatch").when(F.col("code") == UNKNOWN, "unknown").otherwise("pass")
    return both.select("query_id", "track_id", name.alias("verdict"), F.when(F.col("code") == PASS, _passed()).alias("filters_passed"))


def passed_filters(rows: DataFrame, requests: DataFrame, attributes: DataFrame) -> DataFrame:
    """(query_id, track_id, filters_passed) of given rows (query_id, track_id) that have passed their requests' filters; no other pair is looked at."""
    return rows.select("query_id", "track_id").join(_wanted(requests), "query_id").join(attributes, "track_id").select("query_id", "track_id", _passed().alias("filters_passed"))


def hidden_counts(verdicts: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(query_id, hidden_mismatch, hidden_unknown); a request's own seed (query_id, seed_id) isn't counted."""
    own = verdicts
    if seeds is not None:
        own = own.join(maybe_broadcast(seeds.select("query_id", F.col("seed_id").alias("track_id"))), ["query_id", "track_id"], "left_anti")
    return own.groupBy("query_id").agg(F.count_if(F.col("verdict") == "mismatch").alias("hidden_mismatch"), F.count_if(F.col("verdict") == "unknown").alias("hidden_unknown"))


def filter_options(attributes: DataFrame) -> DataFrame:
    """(attribute, value, place, tracks): tracks a value, none as 0, in the order of the vocabulary."""
    spark = attributes.sparkSession
    names = spark.createDataFrame([(a, v, i) for a, values in V.LABELS.items() for i, v in enumerate(values)], "attribute string, value string, place int")
    every = F.array(*[F.struct(F.lit(a).alias("attribute"), c.alias("value")) for a, c in (("vocals", F.array("vocals")), ("genre", F.array("genre")), ("mood", F.coalesce("moods", F.array())))])
    found = attributes.select(F.explode(every).alias("x")).select("x.attribute", F.explode("x.value").alias("value")).where("value is not null").groupBy("attribute", "value").agg(F.count("*").alias("tracks"))
    return F.broadcast(names).join(found, ["attribute", "value"], "left").select("attribute", "value", "place", F.coalesce("tracks", F.lit(0)).cast("bigint").alias("tracks"))
