"""The vector index: reuse of earlier vectors, embedding of new tracks, publishing and loading of generations."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunespark.jobs.files import children, delete, file_system, rename_new, statuses
from tunespark.operators.vectors import EmbeddingSpace, TunesparkError, vector_problems

FORMAT = 1
EDITABLE = ("title", "artist", "source", "license", "provider_url")


def plan_reuse(manifest: DataFrame, previous: DataFrame | None, space: EmbeddingSpace, reuse: bool = True) -> DataFrame:
    """manifest (with audio_sha256) plus status and, where reused, vector and excerpt_count.

    A stored vector is reused for the same id, audio digest and space; ids and digests are matched first, vectors fetched for hits only. Titles and the like come from the manifest.
    """
    if previous is None or not reuse:
        return manifest.withColumn("status", F.lit("to_embed")).withColumn("vector", F.lit(None).cast("array<float>")).withColumn("excerpt_count", F.lit(None).cast("int"))
    old = previous.where(F.col("space_fingerprint") == space.fingerprint())
    hits = manifest.select("track_id", "audio_sha256").join(old.select("track_id", "audio_sha256"), ["track_id", "audio_sha256"], "left_semi")
    vectors = old.join(hits, ["track_id", "audio_sha256"]).select("track_id", "vector", "excerpt_count")
    return manifest.join(vectors, "track_id", "left").withColumn("status", F.when(F.col("vector").isNotNull(), "reused").otherwise("to_embed"))


def embed_tracks(plan: DataFrame, encoder_factory: Callable[[], Callable[[str], tuple[list[float], int]]]) -> DataFrame:
    """(track_id, vector, excerpt_count, error) of rows to embed, by an encoder made once a task: audio path -> (vector, excerpts).

    A row that fails carries its error and no vector.
    """
    todo = plan.where("status = 'to_embed'").select("track_id", "audio_path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for pdf in frames:
            rows = []
            for track_id, path in zip(pdf["track_id"], pdf["audio_path"], strict=True):
                try:
                    vector, n = encode(path)
                    rows.append((track_id, [float(x) for x in vector], int(n), None))
                except Exception as error:  # noqa: BLE001 - any failure is reported for its own track
                    rows.append((track_id, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["track_id", "vector", "excerpt_count", "error"])

    return todo.repartition("track_id").mapInPandas(run, "track_id string, vector array<float>, excerpt_count int, error string")


#: Texts that an encoder gets at a time.
TEXTS = 256


def embed_texts(requests: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "query") -> DataFrame:
    """(query_id, vector, error) of each request with a text, by an encoder made once a task: texts -> vectors.

    Each distinct text (trimmed) is encoded once, in batches. A batch that fails is tried text by text, so that a text that can't be encoded
    carries its error alone; so does one whose vector holds what is no finite number. Requests without a text have no row.
    """
    own = requests.select("query_id", F.trim(text).alias("__text")).where("__text <> ''")

    def checked(vector: list[float]) -> list[float]:
        out = [float(x) for x in vector]
        if not out or not all(abs(x) < float("inf") for x in out):
            raise ValueError("the vector is empty or not finite")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_factory()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                texts = batch.column(0).slice(start, TEXTS).to_pylist()
                vectors: list = [None] * len(texts)
                errors: list = [None] * len(texts)
                try:
                    made = encode(texts)
                    if len(made) != len(texts):
                        raise ValueError("as many vectors as texts are needed")
                    vectors = [checked(v) for v in made]
                except Exception:  # noqa: BLE001 - which text it is shows one by one
                    for i, one in enumerate(texts):
                        try:
                            vectors[i] = checked(encode([one])[0])
                        except Exception as error:  # noqa: BLE001 - any failure is reported for its own text
                            vectors[i], errors[i] = None, f"{type(error).__name__}: {error}"
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["__text", "vector", "error"])

    made = own.select("__text").distinct().mapInArrow(run, "__text string, vector array<float>, error string")
    return own.join(made, "__text").select("query_id", "vector", "error")


def build_index(manifest: DataFrame, encoder_factory: Callable, space: EmbeddingSpace, previous: DataFrame | None = None, reuse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index rows, report rows (track_id, status)): reused and embedded tracks; failed ones only in the report."""
    plan = plan_reuse(manifest, previous, space, reuse)
    made = embed_tracks(plan, encoder_factory)
    kept = plan.where("status = 'reused'")
    fresh = plan.where("status = 'to_embed'").drop("vector", "excerpt_count").join(made, "track_id").withColumn("status", F.when(F.col("error").isNull(), "embedded").otherwise("failed"))
    columns = [*manifest.columns, "vector", "excerpt_count", "status"]
    rows = kept.select(*columns).unionByName(fresh.select(*columns))
    index = rows.where("status <> 'failed'").drop("status").withColumn("space_fingerprint", F.lit(space.fingerprint()))
    return index, rows.select("track_id", "status")


def build_report(rows: DataFrame) -> DataFrame:
    """(status, tracks, first_ids): how many tracks were embedded, reused, failed, with their ids in order (up to 100 shown)."""
    from pyspark.sql import Window

    shown = rows.withColumn("__n", F.row_number().over(Window.partitionBy("status").orderBy("track_id"))).where("__n <= 100")
    ids = shown.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("track_id")), ",").alias("first_ids"))
    return rows.groupBy("status").agg(F.count("*").alias("tracks")).join(ids, "status")


def _checksum(df: DataFrame) -> dict:
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("track_id", "audio_sha256", "vector")), F.lit(0)).alias("x")).first()
    return {"count": row["n"], "checksum": row["x"]}


def generations(spark: SparkSession, index_dir: str) -> list[str]:
    """Whole generations, the oldest first."""
    return [name for name in children(spark, index_dir) if name.startswith("gen-")]


def publish_generation(df: DataFrame, index_dir: str, space: EmbeddingSpace, keep: int = 2, grace_seconds: float = 3600) -> str:
    """Write df as a new immutable generation; older ones beyond `keep` go when they are older than `grace_seconds`. Returns its name.

    A generation is written aside and renamed to the next free number without overwriting; where another publisher has taken the number meanwhile, the next one is tried. So a
    generation is there with all its rows or not at all, two publishers give two of them, and a reader of an older one has `grace_seconds` to end.
    """
    spark = df.sparkSession
    if vector_problems(df, space.dimension, unit=True).limit(1).count():
        raise TunesparkError("the index has vectors that can't be used")
    aside = f"{index_dir}/tmp-{uuid.uuid4().hex}"
    df.write.parquet(f"{aside}/rows")
    meta = {"format": FORMAT, "space": asdict(space), "fingerprint": space.fingerprint(), **_checksum(spark.read.parquet(f"{aside}/rows"))}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{aside}/meta")
    done = generations(spark, index_dir)
    number = int(done[-1][4:]) + 1 if done else 1
    while not rename_new(spark, aside, f"{index_dir}/gen-{number:08d}"):
        number += 1
    collect_garbage(spark, index_dir, keep, grace_seconds)
    return f"gen-{number:08d}"


def collect_garbage(spark: SparkSession, index_dir: str, keep: int = 2, grace_seconds: float = 3600) -> list[str]:
    """Remove generations beyond the newest `keep`, and what publishers that died have left aside, once older than `grace_seconds`; their names."""
    found = statuses(spark, index_dir)
    whole = [(name, at) for name, at in found if name.startswith("gen-")]
    old = [x for x in whole[: max(0, len(whole) - keep)]] + [(name, at) for name, at in found if name.startswith("tmp-") and grace_seconds > 0]
    gone = [name for name, at in old if time.time() - at >= grace_seconds]
    for name in gone:
        delete(spark, f"{index_dir}/{name}")
    return gone


def load_generation(spark: SparkSession, index_dir: str) -> DataFrame:
    """The newest generation, refused with a reason unless all that was published with it still holds."""
    fs, path = file_system(spark, index_dir)
    known = generations(spark, index_dir)
    if not known:
        raise TunesparkError("no index")
    target = f"{index_dir}/{known[-1]}"
    if not fs.exists(path(f"{target}/meta")):
        raise TunesparkError("the index has no description")
    meta = json.loads(spark.read.text(f"{target}/meta").first()["value"])
    if meta.get("format") != FORMAT:
        raise TunesparkError("the index has another version")
    if missing := {"space", "fingerprint", "count", "checksum"} - meta.keys():
        raise TunesparkError(f"the description lacks {', '.join(sorted(missing))}")
    space = EmbeddingSpace(**meta["space"])
    if space.fingerprint() != meta["fingerprint"]:
        raise TunesparkError("fingerprint and space differ")
    rows = spark.read.parquet(f"{target}/rows")
    now = _checksum(rows)
    if now["count"] != meta["count"]:
        raise TunesparkError("the number of rows differs")
    if now["checksum"] != meta["checksum"]:
        raise TunesparkError("the checksum differs")
    if rows.where("track_id is null").limit(1).count() or vector_problems(rows, space.dimension, unit=True).limit(1).count():
        raise TunesparkError("the index has vectors or ids that can't be used")
    return rows
