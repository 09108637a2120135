"""Dataset metadata: reading, clip availability, sampling by genre, manifest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCE = "FMA: A Dataset For Music Analysis (Defferrard et al., ISMIR 2017)"


def read_track_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of three header rows (group, field, id): columns `group.field` as text, track_id as a number."""
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"')
    groups, fields = raw.limit(2).collect()
    names = [f"{g}.{f}" for g, f in zip(groups[1:], fields[1:], strict=True)]
    rows = raw.where(F.col("_c0").rlike(r"^\d+$"))
    return rows.select(F.col("_c0").cast("int").alias("track_id"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip(raw.columns[1:], names, strict=True)])


def read_track_urls(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, track_url) of rows whose URL is one."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').where(F.col("track_url").startswith("http")).select(F.col("track_id").cast("int").alias("track_id"), "track_url")


def with_clip_path(df: DataFrame, root: str = "") -> DataFrame:
    """df with `clip_path`: <first three digits>/<six digits, all of a longer number>.mp3 under root."""
    stem = F.when(F.col("track_id").isNotNull(), F.format_string("%06d", "track_id"))
    return df.withColumn("clip_path", F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.substring(stem, 1, 3), F.lit("/"), stem, F.lit(".mp3")))


def with_availability(df: DataFrame, listing: DataFrame) -> DataFrame:
    """df with `available`: whether its clip_path is among listing (path)."""
    return df.join(listing.select(F.col("path").alias("clip_path"), F.lit(True).alias("__there")).distinct(), "clip_path", "left").withColumn("available", F.coalesce("__there", F.lit(False))).drop("__there")


def _listed(tracks: DataFrame, subset: str) -> DataFrame:
    return tracks.where((F.col("subset") == subset) & (F.coalesce("genre_top", F.lit("")) != ""))


def sample_per_genre(tracks: DataFrame, subset: str, per_genre: int) -> DataFrame:
    """The available tracks of lowest id of each genre of a subset, per_genre of them; all for 0."""
    own = _listed(tracks, subset).where("available")
    if not per_genre:
        return own
    place = F.row_number().over(Window.partitionBy("genre_top").orderBy("track_id"))
    return own.withColumn("__n", place).where(F.col("__n") <= per_genre).drop("__n")


def missing_clips(tracks: DataFrame, subset: str, per_genre: int) -> DataFrame:
    """(missing): listed clips without a file that come, by id, before their genre is full.

    A genre is full at the id of its per_genre-th available track, so that small table of ids is all that has to be joined.
    """
    own = _listed(tracks, subset)
    if per_genre:
        last = sample_per_genre(tracks, subset, per_genre).groupBy("genre_top").agg(F.count("*").alias("n"), F.max("track_id").alias("last"))
        full = last.where(F.col("n") == per_genre).select("genre_top", "last")
        own = own.join(F.broadcast(full), "genre_top", "left").where(F.col("last").isNull() | (F.col("track_id") < F.col("last")))
    return own.where(~F.col("available")).agg(F.count("*").alias("missing"))


def manifest_entries(sampled: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Manifest rows of sampled tracks (track_id, title, artist, license, genre_top, clip_path), by genre and id."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = sampled.join(urls.withColumnRenamed("track_url", "provider_url"), "track_id", "left") if urls is not None else sampled.withColumn("provider_url", F.lit(None).cast("string"))
    out = own.select(
        F.format_string("fma-%06d", "track_id").alias("track_id"),
        F.coalesce(blank("title"), F.concat(F.lit("FMA track "), F.col("track_id").cast("string"))).alias("title"),
        F.coalesce(blank("artist"), F.lit("Unknown artist")).alias("artist"),
        F.col("clip_path").alias("audio_path"),
        F.concat(F.lit(f"{SOURCE}; genre_top="), F.col("genre_top")).alias("source"),
        F.coalesce(blank("license"), F.lit("unknown (see FMA)")).alias("license"),
        "provider_url",
        "genre_top",
    )
    return out.orderBy("genre_top", "track_id").drop("genre_top")


def genre_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.substring_index("source", "=", -1).alias("genre")).agg(F.count("*").alias("tracks"))
