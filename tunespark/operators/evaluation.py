"""Evaluation: agreement with hand labels, neighbours' genres, hubs, overlaps, correlations, grades, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.small import running_total
from tunespark.operators.attributes import energy_band, percentile_ranks


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand labels {"tracks": {id: {vocals, genre, mood, energy}}} -> a row a track; names with _ and entries that aren't objects are left out."""
    from tunespark.operators.vectors import TunesparkError

    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "tracks map<string,string>").alias("v"), F.get_json_object("value", "$.tracks").alias("t"))
    if not whole.where("t is not null").limit(1).count():
        raise TunesparkError("the labels have no tracks")
    rows = whole.select(F.explode("v.tracks").alias("track_id", "entry")).where(~F.col("track_id").startswith("_") & F.col("entry").startswith("{"))
    return rows.select("track_id", F.from_json("entry", "vocals string, genre string, mood array<string>, energy string").alias("e")).select("track_id", "e.*")


def compare_with_labels(attributes: DataFrame, labels: DataFrame) -> DataFrame:
    """(track_id, attribute, outcome) of each label given: agree, disagree or unknown (no estimate); moods agree if any is shared."""
    own = labels.join(attributes.select("track_id", F.col("vocals").alias("p_vocals"), F.col("genre").alias("p_genre"), "moods", energy_band("energy").alias("p_energy")), "track_id")
    state = lambda known, fits: F.when(~known, "unknown").when(fits, "agree").otherwise("disagree")
    given = [
        ("vocals", F.col("vocals").isNotNull(), state(F.col("p_vocals").isNotNull(), F.col("p_vocals") == F.col("vocals"))),
        ("genre", F.col("genre").isNotNull(), state(F.col("p_genre").isNotNull(), F.col("p_genre") == F.col("genre"))),
        ("mood", F.coalesce(F.size("mood") > 0, F.lit(False)), state(F.coalesce(F.size("moods") > 0, F.lit(False)), F.arrays_overlap("mood", "moods"))),
        ("energy", F.col("energy").isNotNull(), state(F.col("p_energy").isNotNull(), F.col("p_energy") == F.col("energy"))),
    ]
    rows = F.array_compact(F.array(*[F.when(has, F.struct(F.lit(a).alias("attribute"), o.alias("outcome"))) for a, has, o in given]))
    return own.select("track_id", F.explode(rows).alias("x")).select("track_id", "x.attribute", "x.outcome")


def label_errors(labels: DataFrame, attributes: DataFrame) -> DataFrame:
    """(track_id, error): values outside the vocabulary, and labelled tracks that aren't indexed."""
    bad = [(c, F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in (("vocals", V.LABELS["vocals"]), ("genre", V.LABELS["genre"]), ("energy", V.ENERGY_BANDS))]
    bad.append(("mood", F.exists("mood", lambda m: ~m.isin(*V.LABELS["mood"]))))
    errors = labels.select("track_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(f"bad {c}")) for c, test in bad]))).alias("error"))
    gone = labels.join(attributes.select("track_id"), "track_id", "left_anti").select("track_id", F.lit("not indexed").alias("error"))
    return errors.unionByName(gone)


def agreement_summary(compared: DataFrame) -> DataFrame:
    """(attribute, agree, decided, unknown), all four attributes."""
    spark = compared.sparkSession
    every = spark.createDataFrame([(a,) for a in ("vocals", "genre", "mood", "energy")], "attribute string")
    sums = compared.groupBy("attribute").agg(F.count_if(F.col("outcome") == "agree").alias("agree"), F.count_if(F.col("outcome") != "unknown").alias("decided"), F.count_if(F.col("outcome") == "unknown").alias("unknown"))
    return F.broadcast(every).join(sums, "attribute", "left").na.fill(0)


def genre_agreement_at_k(neighbours: DataFrame, genres: DataFrame, k: int = 5) -> DataFrame:
    """(share, chance): how many of the seeds' k nearest have the seed's genre, and how many would by chance."""
    seed = genres.select(F.col("track_id").alias("seed_id"), F.col("genre").alias("seed_genre"))
    hits = neighbours.where(F.col("rank") <= k).join(seed, "seed_id").join(genres.select("track_id", "genre"), "track_id")
    share = hits.agg(F.round(F.avg((F.col("genre") == F.col("seed_genre")).cast("double")), 6).alias("share"))
    by_genre = genres.groupBy("genre").agg(F.count("*").alias("n"))
    chance = by_genre.agg(F.round(F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1)), 6).alias("chance"))
    return share.crossJoin(F.broadcast(chance))


def hubness(results: DataFrame) -> DataFrame:
    """(track_id, queries, firsts): in how many queries' lists a track stands, and how often first."""
    return results.groupBy("track_id").agg(F.countDistinct("query_id").alias("queries"), F.count_if(F.col("rank") == 1).alias("firsts"))


def list_overlap(results: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): tracks that the lists of two queries share, for pairs that share any."""
    a, b = (results.select("track_id", F.col("query_id").alias(n)) for n in ("left_id", "right_id"))
    return a.join(b, "track_id").where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def score_energy_correlation(scores: DataFrame, attributes: DataFrame) -> DataFrame:
    """(query_id, rho): rank correlation of each query's scores with the tracks' energy; ranks are average ranks.

    Equal scores of a query are counted first; how many lie below is summed inside ranges of scores and shifted by the ranges' totals, so that no task holds a query's catalog.
    """
    energy = percentile_ranks(attributes.where("energy is not null").select("track_id", "energy"), "energy", "e_rank")
    counted = scores.groupBy("query_id", "score").agg(F.count("*").alias("own"))
    ranks = running_total(counted, "query_id", "score", "own", "before").select("query_id", "score", (F.col("before") + (F.col("own") + 1) / 2).alias("s_rank"))
    return scores.join(ranks, ["query_id", "score"]).join(energy, "track_id").groupBy("query_id").agg(F.round(F.corr("s_rank", "e_rank"), 6).alias("rho"))


def graded_relevance(results: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, good, acceptable, wrong, ungraded) among the first k results of each query."""
    own = results.where(F.col("rank") <= k).join(grades, ["query_id", "track_id"], "left")
    return own.groupBy("query_id").agg(*[F.count_if(F.col("grade") == g).alias(g) for g in ("good", "acceptable", "wrong")], F.count_if(F.col("grade").isNull()).alias("ungraded"))


def latency_summary(log: DataFrame) -> DataFrame:
    """(median, p95, max) of elapsed_ms: exact, from the counts of distinct values."""
    at = F.percentile("elapsed_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return log.agg(at.alias("p"), F.max("elapsed_ms").alias("max")).select(F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p95"), "max")


