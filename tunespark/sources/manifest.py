"""Track manifests: reading, writing, strict validation, content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunespark.operators.vectors import TunesparkError
from tunespark.schemas import OPTIONAL_FIELDS, REQUIRED_FIELDS


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(position, entry VARIANT) of a JSON list or of {"tracks": [...]}; for large catalogs JSON lines, one object a line."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path)
        return lines.select(F.monotonically_increasing_id().alias("position"), F.parse_json("value").alias("entry"))
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    whole.createOrReplaceTempView("__manifest")
    return spark.sql("""
        SELECT e.pos AS position, e.value AS entry
        FROM (SELECT CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN v ELSE try_variant_get(v, '$.tracks', 'variant') END AS v FROM __manifest) m,
             LATERAL variant_explode(m.v) AS e""")


def write_manifest(df: DataFrame, path: str) -> None:
    df.select(*REQUIRED_FIELDS, *OPTIONAL_FIELDS).write.mode("overwrite").json(path)


def entry_columns(entries: DataFrame) -> DataFrame:
    """(position, entry VARIANT) -> typed columns, `unknown_fields` and `not_text` (names of known fields that hold something else)."""
    known = [*REQUIRED_FIELDS, *OPTIONAL_FIELDS]
    kind = {c: F.expr(f"schema_of_variant(try_variant_get(entry, '$.{c}', 'variant'))") for c in known}
    keys = F.map_keys(F.expr("try_variant_get(entry, '$', 'map<string,variant>')"))
    return entries.select(
        "position",
        *[F.expr(f"try_variant_get(entry, '$.{c}', 'string')").alias(c) for c in known],
        F.filter(keys, lambda k: ~k.startswith("_") & ~k.isin(*known)).alias("unknown_fields"),
        F.array_compact(F.array(*[F.when(~kind[c].isin("STRING", "VOID"), F.lit(c)) for c in known])).alias("not_text"),
    )


def validate_manifest(entries: DataFrame, listing: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations (position, problem)). entries: position, the seven fields, and optionally unknown_fields and not_text.

    Required fields must hold text that isn't blank; optional ones hold text or null, blank as null; ids are unique (later ones are
    reported with the first position); audio must be among listing (path). strict: raises at any violation, and for an empty manifest.
    """
    own = entries
    for c in ("unknown_fields", "not_text"):
        if c not in entries.columns:
            own = own.withColumn(c, F.array().cast("array<string>"))
    trimmed = own.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)})
    first = F.min("position").over(Window.partitionBy("track_id"))
    placed = trimmed.withColumn("__first", F.when(F.col("track_id").isNotNull(), first))
    if listing is not None:
        placed = placed.join(listing.select(F.col("path").alias("audio_path"), F.lit(True).alias("__there")).distinct(), "audio_path", "left")
    else:
        placed = placed.withColumn("__there", F.lit(True))
    problems = F.array_compact(F.array(
        *[F.when(F.col(c).isNull() & ~F.array_contains("not_text", c), F.lit(f"missing {c}")) for c in REQUIRED_FIELDS],
        *[F.when(F.array_contains("not_text", c), F.lit(f"{c} is not text")) for c in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)],
        F.when(F.col("__first") < F.col("position"), F.concat(F.lit("duplicate track_id, first at "), F.col("__first").cast("string"))),
        F.when(F.size("unknown_fields") > 0, F.concat(F.lit("unknown fields "), F.array_join(F.array_sort("unknown_fields"), ", "))),
        F.when(F.col("audio_path").isNotNull() & F.col("__there").isNull(), F.lit("audio not found")),
    ))
    judged = placed.withColumn("__problems", problems)
    valid = judged.where(F.size("__problems") == 0).select(*REQUIRED_FIELDS, *OPTIONAL_FIELDS)
    violations = judged.select("position", F.explode("__problems").alias("problem"))
    if strict:
        if entries.isEmpty():
            raise TunesparkError("the manifest has no tracks")
        if first_bad := violations.orderBy("position").limit(5).collect():
            raise TunesparkError("; ".join(f"entry {r['position']}: {r['problem']}" for r in first_bad))
    return valid, violations


#: Bytes of a file that are read at a time.
CHUNK = 4 << 20


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path as Spark lists it, and the path in it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?=&,"))


def content_digest(spark: SparkSession, glob: str, algo: str = "sha256", chunk: int = CHUNK) -> DataFrame:
    """(path, digest) of files of any size: Spark lists them, tasks read them chunk by chunk into a running hash.

    Files lie in a store that pyarrow opens by its address (local folders, HDFS, object stores). A file that can't be read has a null digest;
    empty files, which Spark doesn't list, have no row.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                sha = hashlib.new(algo)
                try:
                    store, at = _opened(path)
                    with store.open_input_stream(at) as f:
                        while data := f.read(chunk):
                            sha.update(data)
                    out.append(sha.hexdigest())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "digest"])

    return files.repartition("path").select("path").mapInArrow(run, "path string, digest string")


def verify_digests(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem) of files whose digest differs from expected (path, digest) or that are missing."""
    both = expected.withColumnRenamed("digest", "want").join(digests, "path", "left")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("want"), "mismatch")
    return both.select("path", problem.alias("problem")).where("problem is not null")
