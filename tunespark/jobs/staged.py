"""A build in stages (some tracks a genre, then more, then all), each on what the ones before have left, that can be stopped anywhere and started again.

Vectors and raw analyses go into stores of batches that are renamed into place when they are whole, keyed by track, audio digest and space or configuration. A stage
works out what the stores lack, a slice at a time, so that a restart repeats no finished slice; slices grow as long as they take little time, so that what a stop
loses is bounded by time and a large stage isn't thousands of small jobs. A stage that is over stands in the ledger with the fingerprint of its input and isn't looked at again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunespark.functions.tables import written
from tunespark.jobs.files import children, exists, rename_new, write_new
from tunespark.jobs.index import embed_tracks, publish_generation
from tunespark.operators.attributes import AnalysisConfig, config_digest, label_tracks, save_attributes
from tunespark.operators.vectors import EmbeddingSpace, TunesparkError
from tunespark.sources.dataset import manifest_entries, sample_per_genre

#: Tracks that are embedded or analysed before a stage's first write; a slice that took less than so many seconds is followed by one twice as large.
SLICE = 2000
QUICK_SECONDS = 20
VECTORS = "track_id string, audio_sha256 string, vector array<float>, excerpt_count int, space_fingerprint string"
ANALYSES = "track_id string, audio_sha256 string, class_scores map<string,double>, loudness_dbfs double, onset_rate double, bpm double, pulse_clarity double, config_digest string"


def _store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All whole batches of a store, one row a key."""
    batches = [f"{path}/{name}" for name in children(spark, path) if name.startswith("batch-")]
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def _add(rows: DataFrame, path: str) -> None:
    """rows as one more batch of a store: written aside, then renamed."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path}/tmp-{name}")
    rename_new(rows.sparkSession, f"{path}/tmp-{name}", f"{path}/batch-{name}")


def _slices(todo: DataFrame, size: int, name: str) -> tuple[int, Iterator[DataFrame]]:
    """The number of rows to do, and slices of them: the first of about `size` tracks, each next one twice as large after a quick one and half as large after a slow one, never smaller than the first.

    Rows are written once in the order of their slices, so that a slice reads little but its own.
    """
    n = todo.count()
    parts = -(-n // size)
    if not n:
        return 0, iter(())
    rows = written(todo.withColumn("__slice", F.pmod(F.xxhash64("track_id"), F.lit(parts))).repartitionByRange("__slice"), name)

    def slices() -> Iterator[DataFrame]:
        at, width = 0, 1
        while at < parts:
            began = time.monotonic()
            yield rows.where(F.col("__slice").between(at, at + width - 1)).drop("__slice")
            at, took = at + width, time.monotonic() - began
            width = 2 * width if took < QUICK_SECONDS else max(1, width // 2) if took > 2 * QUICK_SECONDS else width

    return n, slices()


def _fingerprint(manifest: DataFrame, space: EmbeddingSpace, config: AnalysisConfig) -> str:
    row = manifest.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(manifest.columns))), F.lit(0)).alias("x")).first()
    return f"{row['n']}-{row['x']}-{space.fingerprint()[:16]}-{config_digest(config)[:16]}"


def ledger(spark: SparkSession, index_dir: str) -> list[dict]:
    """What the finished stages reported, in the order in which they were finished."""
    path = f"{index_dir}/stages"
    names = [f"{path}/{name}" for name in children(spark, path)]
    return sorted((json.loads(r["value"]) for r in spark.read.text(names, wholetext=True).collect()), key=lambda r: r["order"]) if names else []


def staged_build(
    spark: SparkSession, tracks: DataFrame, stages: list[int], encoder_factory: Callable, analyse: Callable[[DataFrame], DataFrame], space: EmbeddingSpace, index_dir: str, digests: DataFrame,
    subset: str = "small", urls: DataFrame | None = None, config: AnalysisConfig = AnalysisConfig(), slice_tracks: int = SLICE,
) -> list[dict]:
    """Reports of the stages: per_genre, tracks, embedded, reused, failed, analysed, generation, and done_before for a stage that the ledger had.

    tracks: a dataset's rows with clip_path and available; stages: tracks a genre (0: all); digests: (path, digest) of the clips; analyse: rows to analyse -> raw analyses.
    Each stage publishes a generation of the index and saves attributes of all its tracks, energy being relative to them. Tracks that fail to be embedded are reported and tried again by the next run.
    """
    reports = []
    for per_genre in stages:
        entries = manifest_entries(sample_per_genre(tracks, subset, per_genre), urls)
        manifest = written(entries.join(digests.select(F.col("path").alias("audio_path"), F.col("digest").alias("audio_sha256")), "audio_path"), "manifest")
        mark = _fingerprint(manifest, space, config)
        done = ledger(spark, index_dir)
        known = next((r for r in done if r["per_genre"] == per_genre and r["fingerprint"] == mark), None)
        if known:
            reports.append(known | {"done_before": True})
            continue
        key = ["track_id", "audio_sha256"]
        vectors = lambda: _store(spark, f"{index_dir}/vectors", VECTORS).where(F.col("space_fingerprint") == space.fingerprint()).dropDuplicates(key)
        before, slices = _slices(manifest.join(vectors().select(*key), key, "left_anti"), slice_tracks, "lacking")
        failed: list[str] = []
        for part in slices:
            made = written(embed_tracks(part.withColumn("status", F.lit("to_embed")), encoder_factory).join(part.select(*key), "track_id"), "embedded")
            good = made.where("error is null").select(*key, "vector", "excerpt_count", F.lit(space.fingerprint()).alias("space_fingerprint"))
            _add(good, f"{index_dir}/vectors")
            failed += [r["track_id"] for r in made.where("error is not null").select("track_id").limit(100).collect()]
        index = written(manifest.join(vectors(), key), "index")
        size = index.count()
        if not size:
            raise TunesparkError("no track has a usable vector")
        analyses = lambda: _store(spark, f"{index_dir}/analyses", ANALYSES).where(F.col("config_digest") == config_digest(config)).dropDuplicates(key)
        raw = [c.split()[0] for c in ANALYSES.split(", ")][:-1]
        analysed, slices = _slices(index.join(analyses().select(*key), key, "left_anti"), slice_tracks, "to-analyse")
        for part in slices:
            fresh = analyse(part).drop("audio_sha256").join(part.select(*key), "track_id")
            _add(fresh.select(*raw).withColumn("config_digest", F.lit(config_digest(config))), f"{index_dir}/analyses")
        generation = publish_generation(index, index_dir, space)
        labelled = label_tracks(analyses().select(*raw).join(index.select(*key), key))
        save_attributes(labelled, f"{index_dir}/attributes/{generation}", config)
        report = {"order": len(done), "per_genre": per_genre, "fingerprint": mark, "generation": generation, "tracks": size, "embedded": before - (manifest.count() - size), "reused": manifest.count() - before,
                  "failed": manifest.count() - size, "first_failed": sorted(failed)[:100], "analysed": analysed}
        if not write_new(spark, f"{index_dir}/stages/{len(done):06d}-{uuid.uuid4().hex}.json", json.dumps(report)):
            raise TunesparkError("the ledger could not be written")
        reports.append(report | {"done_before": False})
    return reports


def resume_point(spark: SparkSession, index_dir: str) -> dict:
    """What a stopped build has left: finished stages, vectors and analyses in the stores."""
    stores = {name: _store(spark, f"{index_dir}/{name}", schema).count() if exists(spark, f"{index_dir}/{name}") else 0 for name, schema in (("vectors", VECTORS), ("analyses", ANALYSES))}
    return {"stages": len(ledger(spark, index_dir)), **stores}
