"""Registered queries over the test tables, each with SQL of the same meaning where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.tables import shared_dir, written
from tunespark.jobs import fixtures as X
from tunespark.jobs import index as I
from tunespark.jobs.fixtures import sql
from tunespark.jobs.index import build_report, plan_reuse
from tunespark.jobs.staged import staged_build
from tunespark.operators import attributes as A
from tunespark.operators import evaluation as E
from tunespark.operators import explain as G
from tunespark.operators import filters as L
from tunespark.operators import interactions as J
from tunespark.operators import lookup as H
from tunespark.operators import ranking as R
from tunespark.operators import requests as Q
from tunespark.operators import signal as C
from tunespark.operators import vectors as B
from tunespark.operators.vectors import EmbeddingSpace
from tunespark.sources import dataset as D
from tunespark.sources import manifest as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    return A.label_tracks(X.raw_analyses(spark, d))


# ------------------------------------------------------------------------------------------------ ingest


@query("SELECT CAST(p_partkey AS INTEGER) AS track_id, substr(printf('%06d', p_partkey), 1, 3) || '/' || printf('%06d', p_partkey) || '.mp3' AS clip_path FROM part")
def a3_clip_path(spark, d):
    return D.with_clip_path(X.dataset_tracks(spark, d)).select("track_id", "clip_path")


@query(sql("SELECT genre_top, track_id FROM v_sampled", "v_sampled"))
def a4_sample_per_genre(spark, d):
    return D.sample_per_genre(X.dataset_tracks(spark, d), "small", 5).select("genre_top", "track_id")


@query(sql("""SELECT count(*) AS missing FROM (SELECT *, coalesce(sum(CAST(available AS INTEGER)) OVER (PARTITION BY genre_top ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
    FROM v_dataset WHERE subset = 'small') WHERE NOT available AND had < 5""", "v_dataset"))  # fmt: skip
def a5_missing_clips(spark, d):
    return D.missing_clips(X.dataset_tracks(spark, d), "small", 5)


_ENTRIES = sql(f"""SELECT printf('fma-%06d', track_id) AS track_id, coalesce(nullif(trim(title), ''), 'FMA track ' || track_id) AS title, coalesce(nullif(trim(artist), ''), 'Unknown artist') AS artist,
    substr(printf('%06d', track_id), 1, 3) || '/' || printf('%06d', track_id) || '.mp3' AS audio_path, '{D.SOURCE}; genre_top=' || genre_top AS source,
    coalesce(nullif(trim(license), ''), 'unknown (see FMA)') AS license, CASE WHEN track_id % 4 = 1 THEN 'http://x.example/' || track_id END AS provider_url FROM v_sampled""", "v_sampled")  # fmt: skip


@query(_ENTRIES)
def a6_manifest_entries(spark, d):
    tracks = X.dataset_tracks(spark, d)
    urls = tracks.where("track_id % 4 = 1").select("track_id", F.concat(F.lit("http://x.example/"), F.col("track_id").cast("string")).alias("track_url"))
    return D.manifest_entries(D.with_clip_path(D.sample_per_genre(tracks, "small", 5)), urls)


def _folder(spark, name: str) -> str:
    """A new folder where the cluster shares tables."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(_ENTRIES)
def a8_manifest_round_trip(spark, d):
    """The manifest written as JSON lines, read again and validated."""
    path = _folder(spark, "manifest") + ".jsonl"
    M.write_manifest(a6_manifest_entries(spark, d), path)
    valid, _ = M.validate_manifest(M.entry_columns(M.read_manifest(spark, path)))
    return valid.select("track_id", "title", "artist", "audio_path", "source", "license", "provider_url")


@query(sql("SELECT genre_top AS genre, count(*) AS tracks FROM v_sampled GROUP BY 1", "v_sampled"))
def a7_genre_summary(spark, d):
    return D.genre_summary(D.manifest_entries(D.with_clip_path(D.sample_per_genre(X.dataset_tracks(spark, d), "small", 5))))


_MANIFEST = """SELECT CAST(p_partkey AS BIGINT) AS position, 'm-' || (p_partkey % 150) AS track_id, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS title, p_brand AS artist,
    CASE WHEN p_partkey % 23 <> 0 THEN p_partkey || '.mp3' END AS audio_path FROM part"""


@query(f"""WITH m AS ({_MANIFEST}), f AS (SELECT *, min(position) OVER (PARTITION BY track_id) AS first FROM m)
    SELECT position, 'missing title' AS problem FROM m WHERE trim(title) = '' UNION ALL SELECT position, 'missing audio_path' FROM m WHERE audio_path IS NULL
    UNION ALL SELECT position, 'duplicate track_id, first at ' || first FROM f WHERE first < position
    UNION ALL SELECT position, 'audio not found' FROM m WHERE audio_path IS NOT NULL AND position % 10 = 3""")
def a9_validate_manifest(spark, d):
    key = F.col("p_partkey").cast("bigint")
    name = F.col("p_partkey").cast("string")
    entries = X.read(spark, d, "part").select(
        key.alias("position"), F.concat(F.lit("m-"), (key % 150).cast("string")).alias("track_id"), F.when(key % 17 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"),
        F.when(key % 23 != 0, F.concat(name, F.lit(".mp3"))).alias("audio_path"), *[F.lit(None).cast("string").alias(c) for c in ("source", "license", "provider_url")],
    )
    listing = X.read(spark, d, "part").where(key % 10 != 3).select(F.concat(name, F.lit(".mp3")).alias("path"))
    return M.validate_manifest(entries, listing)[1]


# ------------------------------------------------------------------------------------------------ vectors and index


@query("""SELECT printf('trk-%06d', vec_id) AS track_id, CASE WHEN vec_id % 10 = 0 THEN 'zero' WHEN vec_id % 10 = 1 THEN 'not unit length' WHEN vec_id % 10 = 2 THEN 'non-finite' WHEN vec_id % 10 = 3 THEN 'dimension' END AS problem
    FROM embeddings WHERE vec_id % 10 < 4""")
def b1_vector_problems(spark, d):
    k = F.col("vec_id") % 10
    times = lambda by: F.transform("embedding", lambda x: (x * by).cast("float"))
    v = F.when(k == 0, times(0.0)).when(k == 1, times(0.5)).when(k == 2, times(float("nan"))).when(k == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return B.vector_problems(X.read(spark, d, "embeddings").select(F.format_string("trk-%06d", "vec_id").alias("track_id"), v.alias("vector")), X.DIM, unit=True)


@query("""SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CAST(CAST(e[i] / n AS FLOAT) AS DOUBLE), 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 3) AS e,
    sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 3 * CAST(v AS DOUBLE) * 3))) AS n FROM embeddings), generate_series(1, 64) AS g(i)""")
def b2_l2_normalize(spark, d):
    long = X.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("vector"))
    return B.l2_normalize(long).select("vec_id", F.posexplode("vector").alias("pos", "x")).select("vec_id", (F.col("pos") + 1).alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("""WITH x AS (SELECT vec_id % 50 AS track, vec_id, i, CAST(embedding[i] AS DOUBLE) * (1 + vec_id % 3) AS v FROM embeddings, generate_series(1, 64) AS g(i)),
    n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY vec_id), m AS (SELECT track, i, avg(v / n) AS v FROM x JOIN n USING (vec_id) GROUP BY ALL), t AS (SELECT track, sqrt(sum(v * v)) AS n FROM m GROUP BY track)
    SELECT track, CAST(i AS INTEGER) AS pos, round(v / n, 5) AS x FROM m JOIN t USING (track)""")
def b3_pool_excerpts(spark, d):
    by = 1 + F.col("vec_id") % 3
    parts = X.read(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("track"), F.transform("embedding", lambda x: x.cast("double") * by).alias("vector"))
    return B.pool_excerpts(parts, "track").select("track", F.posexplode("vector").alias("pos", "x")).select("track", (F.col("pos") + 1).alias("pos"), F.round(F.col("x").cast("double"), 5).alias("x"))


SPACE = B.EmbeddingSpace("encoder", "1", X.DIM, 48_000, 10.0, 3)


def _plan(spark, d):
    own = X.catalog(spark, d)
    manifest = own.select("track_id", "title", "artist", "audio_path", F.sha2(F.concat("track_id", F.lit("-now")), 256).alias("audio_sha256"), "vec_id")
    stamp = F.when(F.col("vec_id") % 5 == 0, "-then").otherwise("-now")
    space = F.when(F.col("vec_id") % 11 == 0, "other").otherwise(SPACE.fingerprint())
    old = own.where("vec_id % 7 <> 3").select("track_id", F.sha2(F.concat("track_id", stamp), 256).alias("audio_sha256"), "vector", F.lit(3).alias("excerpt_count"), space.alias("space_fingerprint"))
    return plan_reuse(manifest, old, SPACE)


_REUSED = "vec_id % 7 <> 3 AND vec_id % 5 <> 0 AND vec_id % 11 <> 0"


@query(f"SELECT printf('trk-%06d', vec_id) AS track_id, CASE WHEN {_REUSED} THEN 'reused' ELSE 'to_embed' END AS status, CASE WHEN {_REUSED} THEN 3 END AS excerpt_count FROM embeddings")
def b5_plan_reuse(spark, d):
    return _plan(spark, d).select("track_id", "status", "excerpt_count")


@query(f"""WITH s AS (SELECT printf('trk-%06d', vec_id) AS track_id, CASE WHEN {_REUSED} THEN 'reused' ELSE 'to_embed' END AS status FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY track_id) AS n FROM s)
    SELECT status, count(*) AS tracks, string_agg(track_id, ',' ORDER BY track_id) FILTER (n <= 100) AS first_ids FROM r GROUP BY status""")
def b7_build_report(spark, d):
    return build_report(_plan(spark, d).select("track_id", "status"))


# ------------------------------------------------------------------------------------------------ signals


@query("""WITH n AS (SELECT DISTINCT CAST(n_chars AS BIGINT) AS n FROM documents), c AS (SELECT n, least(3, n // 100) AS k, n - 100 AS span FROM n)
    SELECT n, CASE WHEN n <= 100 THEN '0' WHEN k <= 1 THEN CAST(span // 2 AS VARCHAR) ELSE list_aggregate(list_transform(range(0, k), lambda i: CAST(CAST(round_even(i * span / (k - 1), 0) AS BIGINT) AS VARCHAR)), 'string_agg', ',') END AS starts FROM c""")
def c1_excerpt_starts(spark, d):
    n = X.read(spark, d, "documents").select(F.col("n_chars").cast("bigint").alias("n")).distinct()
    return n.select("n", F.array_join(F.transform(C.excerpt_starts("n", 100, 3), lambda x: x.cast("string")), ",").alias("starts"))


def _signals(spark, d):
    """Signals of 1 to 64 samples: the first components of the vectors."""
    return X.read(spark, d, "embeddings").select(F.format_string("trk-%06d", "vec_id").alias("track_id"), F.expr("slice(embedding, 1, CAST(vec_id % 64 + 1 AS INTEGER))").alias("samples"))


@query("""WITH s AS (SELECT printf('trk-%06d', vec_id) AS track_id, embedding AS e, CAST(vec_id % 64 + 1 AS BIGINT) AS n FROM embeddings), k AS (SELECT *, least(3, n // 20) AS k FROM s),
    t AS (SELECT track_id, e, n, unnest(CASE WHEN n <= 20 THEN [0] WHEN k <= 1 THEN [(n - 20) // 2] ELSE list_transform(range(0, k), lambda i: CAST(round_even(i * (n - 20) / (k - 1), 0) AS BIGINT)) END) AS start FROM k)
    SELECT track_id, start, round(sum((p + 1) * CAST(e[(start + p) % n + 1] AS DOUBLE)), 5) AS weighted FROM t, generate_series(0, 19) AS g(p) GROUP BY track_id, start""")
def c2_extract_excerpts(spark, d):
    cut = C.extract_excerpts(_signals(spark, d), 20, 3)
    weighted = F.aggregate(F.zip_with("samples", F.sequence(F.lit(1), F.lit(20)), lambda x, i: x.cast("double") * i), F.lit(0.0), lambda total, x: total + x)
    return cut.select("track_id", "start", F.round(weighted, 5).alias("weighted"))


@query("""SELECT printf('trk-%06d', vec_id) AS track_id, CASE WHEN vec_id % 13 = 0 THEN 'empty' WHEN vec_id % 11 = 0 THEN 'non-finite' WHEN vec_id % 7 = 0 THEN 'silent' END AS reason,
    CASE WHEN vec_id % 13 > 0 AND vec_id % 11 > 0 THEN round(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE (CAST(embedding[5] AS DOUBLE) + CAST(embedding[60] AS DOUBLE)) / 2 END, 6) END AS fifth FROM embeddings""")
def c3_mono_and_gate(spark, d):
    k = F.col("vec_id")
    scaled = F.transform("embedding", lambda x: F.when(k % 11 == 0, float("nan")).when(k % 7 == 0, 0.0).otherwise(x.cast("double")))
    channels = F.when(k % 13 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(scaled, F.reverse(scaled)))
    made = C.mono_and_gate(X.read(spark, d, "embeddings").select(F.format_string("trk-%06d", "vec_id").alias("track_id"), channels.alias("channels")))
    sound = F.col("reason").isNull() | (F.col("reason") == "silent")
    return made.select("track_id", "reason", F.when(sound, F.round(F.col("samples")[4].cast("double"), 6)).alias("fifth"))


@query("SELECT vec_id, CASE WHEN abs(CAST(embedding[55] AS DOUBLE)) * 2 >= 0.25 THEN round(60 + abs(CAST(embedding[54] AS DOUBLE)) * 400, 1) END AS bpm FROM embeddings")
def c6_gated_bpm(spark, d):
    own = X.read(spark, d, "embeddings").select("vec_id", (60 + F.abs(F.col("embedding")[53].cast("double")) * 400).alias("bpm"), (F.abs(F.col("embedding")[54].cast("double")) * 2).alias("clarity"))
    return own.select("vec_id", C.gated_bpm("bpm", "clarity").alias("bpm"))


@query("SELECT vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 64), 1e-10)), 2) AS loudness FROM embeddings")
def c4_loudness(spark, d):
    return X.read(spark, d, "embeddings").select("vec_id", C.loudness_dbfs("embedding").alias("loudness"))


@query("SELECT vec_id, round(len(list_filter(embedding, lambda v: v > 0.1)) / (64000.0 / 16000), 3) AS rate FROM embeddings")
def c5_onset_rate(spark, d):
    return X.read(spark, d, "embeddings").select("vec_id", C.onset_rate(F.filter("embedding", lambda v: v.cast("double") > 0.1), F.lit(64000), 16000).alias("rate"))


# ------------------------------------------------------------------------------------------------ attributes


@query(f"""WITH c AS (SELECT unnest([{', '.join(f"'{c}'" for c in V.CLASSES)}]) AS class, unnest(range(1, {len(V.CLASSES) + 1})) AS i)
    SELECT printf('trk-%06d', vec_id % 100) AS track_id, class, round(avg(1 / (1 + exp(-10 * CAST(embedding[i] AS DOUBLE)))), 6) AS score FROM embeddings CROSS JOIN c GROUP BY 1, 2""")
def d1_excerpt_class_scores(spark, d):
    parts = X.read(spark, d, "embeddings").select(F.format_string("trk-%06d", F.col("vec_id") % 100).alias("track_id"), F.col("vec_id").alias("excerpt"), F.posexplode(F.slice("embedding", 1, len(V.CLASSES))).alias("i", "x"))
    names = F.array(*map(F.lit, V.CLASSES))
    logits = parts.select("track_id", "excerpt", names[F.col("i")].alias("class"), (F.col("x").cast("double") * 10).alias("logit"))
    return A.excerpt_class_scores(logits).select("track_id", F.explode("class_scores").alias("class", "score"))


@query(sql("SELECT track_id, vocals, vocal_score, vocal_class FROM v_attributes", "v_attributes"))
def d2_label_vocals(spark, d):
    return X.class_scores(spark, d).select("track_id", A.vocals_label("class_scores").alias("v")).select("track_id", F.col("v.label").alias("vocals"), F.col("v.vocal_score").alias("vocal_score"), F.col("v.top_class").alias("vocal_class"))


@query(sql("SELECT track_id, genre, genre_score FROM v_attributes", "v_attributes"))
def d3_label_genre(spark, d):
    return X.class_scores(spark, d).select("track_id", A.genre_label("class_scores").alias("g")).select("track_id", F.col("g.label").alias("genre"), F.col("g.score").alias("genre_score"))


@query(sql("SELECT track_id, coalesce(list_aggregate(moods, 'string_agg', ','), '') AS moods FROM v_labels0", "v_labels0"))
def d4_label_moods(spark, d):
    return X.class_scores(spark, d).select("track_id", F.array_join(A.mood_labels("class_scores"), ",").alias("moods"))


@query(sql("SELECT track_id, round(loud, 9) AS rank FROM v_ranks", "v_ranks"))
def d5_percentile_ranks(spark, d):
    return A.percentile_ranks(X.measurements(spark, d), "loudness_dbfs", "rank").select("track_id", F.round("rank", 9).alias("rank"))


@query(sql("SELECT track_id, energy FROM v_attributes", "v_attributes"))
def d6_energy(spark, d):
    return A.with_energy(X.measurements(spark, d)).select("track_id", "energy")


@query(sql("SELECT band, count(*) AS tracks FROM v_attributes GROUP BY band", "v_attributes"))
def d7_energy_bands(spark, d):
    return A.with_energy(X.measurements(spark, d)).groupBy(A.energy_band("energy").alias("band")).agg(F.count("*").alias("tracks"))


@query(sql("SELECT track_id, vocals, genre, list_aggregate(moods, 'string_agg', ',') AS moods, energy, bpm FROM v_attributes", "v_attributes"))
def d9_stored_attributes(spark, d):
    """Attributes written, and read again against the index that they were made for."""
    raw, path = X.raw_analyses(spark, d), _folder(spark, "attributes")
    index = raw.select("track_id", F.sha2("track_id", 256).alias("audio_sha256"))
    A.save_attributes(A.label_tracks(raw.join(index, "track_id")), path)
    return A.load_attributes(spark, path, index).select("track_id", "vocals", "genre", F.nullif(F.array_join("moods", ","), F.lit("")).alias("moods"), "energy", "bpm")


@query(sql("SELECT track_id, vocals, genre, list_aggregate(moods, 'string_agg', ',') AS moods, energy, bpm, CAST(substr(track_id, 5) AS INTEGER) % 4 = 0 AS fresh FROM v_attributes", "v_attributes"))
def d8_build_attributes(spark, d):
    raw = X.raw_analyses(spark, d)
    index = raw.select("track_id", F.sha2("track_id", 256).alias("audio_sha256"))
    stale = F.substring("track_id", 5, 6).cast("int") % 4 == 0
    old = raw.withColumn("audio_sha256", F.sha2(F.when(stale, F.lit("x")).otherwise(F.col("track_id")), 256)).withColumn("config_digest", F.lit(A.config_digest()))
    made, fresh = A.build_attributes(index, lambda todo: raw.join(todo.select("track_id"), "track_id"), old)
    return made.join(fresh.withColumn("fresh", F.lit(True)), "track_id", "left").select("track_id", "vocals", "genre", F.nullif(F.array_join("moods", ","), F.lit("")).alias("moods"), "energy", "bpm", F.coalesce("fresh", F.lit(False)).alias("fresh"))


# ------------------------------------------------------------------------------------------------ filters

#: Requests made from events, as columns that mean the same to Spark and in the SQL below: good, bad and blank values.
_REQUEST = (
    "concat('e-', event_id) AS query_id", "CASE event_id % 7 WHEN 0 THEN 'vocal' WHEN 1 THEN 'loud' WHEN 2 THEN ' ' END AS vocals", "CASE event_id % 5 WHEN 0 THEN 'rock' WHEN 1 THEN 'polka' END AS genre",
    "CASE event_id % 11 WHEN 0 THEN 'calm' WHEN 1 THEN 'bored' END AS mood", "CASE event_id % 13 WHEN 0 THEN 'high' WHEN 1 THEN 'huge' END AS energy",
    "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 400 AS DOUBLE) END AS tempo_min", "CASE WHEN event_id % 4 = 0 THEN CAST(event_id * 7 % 400 AS DOUBLE) END AS tempo_max",
    "CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'calm jazz' WHEN 2 THEN ' ' WHEN 3 THEN repeat('x', 401) ELSE 'dark' END AS query", "CASE event_id % 19 WHEN 0 THEN ' ' WHEN 1 THEN 'trk-000001' END AS seed_id",
    "CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 70 AS INTEGER) END AS k",
)
_BAD = f"SELECT {', '.join(_REQUEST)} FROM events"


def _outside(column: str, allowed: tuple[str, ...]) -> str:
    return f"SELECT query_id, 'unknown {column}' AS error FROM f WHERE nullif(trim({column}), '') NOT IN ({', '.join(repr(v) for v in allowed)})"


@query(f"""WITH f AS ({_BAD}) {' UNION ALL '.join(_outside(c, v) for c, v in {**V.LABELS, 'energy': V.ENERGY_BANDS}.items())}
    UNION ALL SELECT query_id, 'tempo_min out of range' FROM f WHERE tempo_min NOT BETWEEN 30 AND 300 UNION ALL SELECT query_id, 'tempo_max out of range' FROM f WHERE tempo_max NOT BETWEEN 30 AND 300
    UNION ALL SELECT query_id, 'tempo_min over tempo_max' FROM f WHERE tempo_min > tempo_max""")
def e1_filter_errors(spark, d):
    return L.filter_errors(X.read(spark, d, "events").selectExpr(*_REQUEST))


@query(sql("SELECT query_id, track_id, CASE code WHEN 2 THEN 'mismatch' WHEN 1 THEN 'unknown' ELSE 'pass' END AS verdict FROM v_verdicts", "v_verdicts"))
def e2_apply_filters(spark, d):
    return L.apply_filters(X.filter_requests(spark), _attributes(spark, d)).select("query_id", "track_id", "verdict")


@query(sql("""SELECT query_id, track_id, concat_ws('; ', CASE WHEN nullif(trim(f.vocals), '') IS NOT NULL THEN f.vocals || ' (model estimate)' END, f.genre || ' (model estimate)', f.mood || ' mood (model estimate)', f.energy || ' energy (measured)',
    CASE WHEN tempo_min IS NOT NULL AND tempo_max IS NOT NULL THEN CAST(CAST(tempo_min AS INTEGER) AS VARCHAR) || '-' || CAST(tempo_max AS INTEGER) || ' BPM (measured ' || CAST(round_even(bpm, 0) AS BIGINT) || ')'
    WHEN tempo_max IS NOT NULL THEN 'at most ' || CAST(tempo_max AS INTEGER) || ' BPM (measured ' || CAST(round_even(bpm, 0) AS BIGINT) || ')' END) AS passed
    FROM v_verdicts JOIN v_filters f USING (query_id) JOIN v_attributes a USING (track_id) WHERE code = 0""", "v_verdicts"))  # fmt: skip
def e3_filter_evidence(spark, d):
    passed = L.apply_filters(X.filter_requests(spark), _attributes(spark, d)).where("verdict = 'pass'")
    return passed.select("query_id", "track_id", F.array_join(F.transform("filters_passed", G.describe_filter), "; ").alias("passed"))


@query(sql("SELECT query_id, count(*) FILTER (code = 2) AS hidden_mismatch, count(*) FILTER (code = 1) AS hidden_unknown FROM v_verdicts GROUP BY query_id", "v_verdicts"))
def e4_hidden_counts(spark, d):
    return L.hidden_counts(L.apply_filters(X.filter_requests(spark), _attributes(spark, d)))


_NAMES = X.values([(a, v, i) for a, vs in V.LABELS.items() for i, v in enumerate(vs)], "attribute, value, place")


@query(sql(f"""SELECT attribute, value, place, count(track_id) AS tracks FROM ({_NAMES}) LEFT JOIN (SELECT track_id, 'vocals' AS attribute, vocals AS value FROM v_attributes UNION ALL SELECT track_id, 'genre', genre FROM v_attributes
    UNION ALL SELECT track_id, 'mood', unnest(moods) FROM v_attributes) USING (attribute, value) GROUP BY ALL""", "v_attributes"))  # fmt: skip
def e5_filter_options(spark, d):
    return L.filter_options(_attributes(spark, d))


@query(sql("SELECT track_id, 'second' AS title, sha256(audio_path) AS audio_sha256, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 3) AS square FROM (SELECT *, list_transform(vector, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])))) AS unit FROM v_catalog) t(track_id, title, artist, genre_top, license, audio_path, old, vec_id, vector)", "v_catalog"))
def b9_load_generation(spark, d):
    """Two generations published one after the other; the one loaded is the second, checked against its description."""
    space, path = EmbeddingSpace("any", "1", X.DIM, 1, 1.0, 1), _folder(spark, "index")
    rows = B.l2_normalize(X.catalog(spark, d)).select("track_id", "title", F.sha2("audio_path", 256).alias("audio_sha256"), "vector")
    I.publish_generation(rows, path, space)
    I.publish_generation(rows.withColumn("title", F.lit("second")), path, space)
    square = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return I.load_generation(spark, path).select("track_id", "title", "audio_sha256", F.round(square, 3).alias("square"))


def _lengths_encoder():
    """Stands for a text encoder: three counts of characters; texts of some lengths fail."""

    def encode(texts):
        if any(len(t) % 17 == 0 for t in texts):
            raise ValueError("no such length")
        return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]

    return encode


@query("""WITH t AS (SELECT doc_id, trim(substr(text, 1, 60)) AS q FROM documents WHERE text IS NOT NULL)
    SELECT doc_id AS query_id, CASE WHEN length(q) % 17 <> 0 THEN length(q) END AS size, CASE WHEN length(q) % 17 <> 0 THEN length(q) - length(replace(q, 'e', '')) END AS es, CASE WHEN length(q) % 17 = 0 THEN 'ValueError: no such length' END AS error FROM t WHERE q <> ''""")
def b6_embed_texts(spark, d):
    asked = X.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    made = I.embed_texts(asked, _lengths_encoder)
    return made.select("query_id", F.col("vector")[0].cast("bigint").alias("size"), F.col("vector")[1].cast("bigint").alias("es"), "error")


def _path_encoder():
    """Stands for an audio encoder: a unit vector by the last ten digits of the clip's path; paths that end in 77 fail."""

    def encode(path):
        digits = [int(c) + 1.0 for c in path if c.isdigit()][-10:]
        if path.endswith("77.mp3"):
            raise OSError("no audio")
        size = sum(x * x for x in digits) ** 0.5
        return [x / size for x in digits], 1

    return encode


_STAGES = (5, 20, 0)


@query(sql("", "v_dataset").rstrip() + f""", o AS (SELECT *, row_number() OVER (PARTITION BY genre_top ORDER BY track_id) AS n FROM v_dataset WHERE subset = 'small' AND available AND coalesce(genre_top, '') <> ''),
    s AS (SELECT unnest({list(_STAGES)}) AS per_genre, unnest({[0, *_STAGES[:-1]]}) AS before),
    c AS (SELECT per_genre, before, track_id % 100 = 77 AS fails, n <= before AS earlier FROM s JOIN o ON per_genre = 0 OR n <= per_genre)
    SELECT per_genre, count(*) FILTER (NOT fails) AS tracks, count(*) FILTER (NOT fails AND NOT earlier) AS embedded, count(*) FILTER (NOT fails AND earlier) AS reused, count(*) FILTER (fails) AS failed, count(*) FILTER (NOT fails AND NOT earlier) AS analysed
    FROM c GROUP BY per_genre""")
def a11_staged_build(spark, d):
    """Three stages over the whole dataset into a new folder; clips' digests are those of their paths, analyses those of the vectors."""
    tracks = D.with_clip_path(X.dataset_tracks(spark, d))
    digests = tracks.select(F.col("clip_path").alias("path"), F.sha2("clip_path", 256).alias("digest"))

    def analyse(rows):
        score = lambda i: F.lit(0.25) * F.coalesce(F.col("vector")[i % 9].cast("double"), F.lit(0.0))
        scores = F.map_from_arrays(F.array(*map(F.lit, V.CLASSES)), F.array(*[score(i) for i in range(len(V.CLASSES))]))
        return rows.select("track_id", scores.alias("class_scores"), (-10 * F.col("vector")[0]).cast("double").alias("loudness_dbfs"), F.col("vector")[1].cast("double").alias("onset_rate"), F.lit(None).cast("double").alias("bpm"), F.lit(0.0).alias("pulse_clarity"))

    space = EmbeddingSpace("digits", "1", 10, 1, 1.0, 1)
    reports = staged_build(spark, tracks, list(_STAGES), _path_encoder, analyse, space, _folder(spark, "staged"), digests)
    columns = ("per_genre", "tracks", "embedded", "reused", "failed", "analysed")
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in reports], "per_genre int, tracks long, embedded long, reused long, failed long, analysed long")


# ------------------------------------------------------------------------------------------------ ranking


def _top(frm: str, part: str = "query_id", k: int = 10) -> str:
    return f"SELECT {part} AS query_id, track_id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, track_id) AS rank FROM {frm}) WHERE rank <= {k}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "track_id", F.round(F.col("score").cast("double"), 6).alias("score"), "rank")


@query(sql("SELECT query_id, track_id, round(CAST(score AS DOUBLE), 6) AS score FROM v_cosine", "v_cosine"))
def f1_cosine_scores(spark, d):
    return R.cosine_scores(X.query_vectors(spark, d), X.catalog(spark, d)).select("query_id", "track_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(sql(_top("v_cosine"), "v_cosine"))
def f2_rank_top_k(spark, d):
    return _shown(R.search(X.query_vectors(spark, d), X.catalog(spark, d), 10))


@query(sql(_top("(SELECT * FROM v_cosine WHERE CAST(substr(track_id, 5) AS INTEGER) % 3 <> 0)"), "v_cosine"))
def f3_exclusions(spark, d):
    own, tracks = X.query_vectors(spark, d), X.catalog(spark, d)
    gone = tracks.where("vec_id % 3 = 0").select("track_id").crossJoin(F.broadcast(own.select("query_id")))
    return _shown(R.search(own, tracks, 10, gone))


_CAPPED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, artist_key ORDER BY score DESC, track_id) AS n FROM {}) WHERE n <= 2)"


@query(sql(_top(_CAPPED.format("v_cosine")), "v_cosine"))
def f4_artist_cap(spark, d):
    return _shown(R.search(X.query_vectors(spark, d), X.catalog(spark, d), 10, max_per_artist=2))


@query(sql(_top("(SELECT c.* FROM v_cosine c JOIN v_verdicts v ON v.track_id = c.track_id AND v.query_id = 'f-04' WHERE code = 0)"), "v_cosine", "v_verdicts"))
def f5_filtered_search(spark, d):
    return _shown(R.search(X.query_vectors(spark, d).withColumn("energy", F.lit("high")), X.catalog(spark, d), 10, attributes=_attributes(spark, d)))


@query(sql(_top(_CAPPED.format("(SELECT * FROM v_seed_cosine WHERE seed_id <> track_id)")), "v_seed_cosine"))
def f6_similar_to(spark, d):
    return _shown(R.similar_to(X.seeds(spark, d), X.catalog(spark, d), 10, max_per_artist=2)[0])


_ALL = """(SELECT a.track_id AS seed_id, b.track_id, CAST(greatest(-1, least(1, list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))
    / (sqrt(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])))))) AS FLOAT) AS score
    FROM v_catalog a JOIN v_catalog b ON a.track_id <> b.track_id)"""


@query(sql(_top(_ALL, "seed_id", 5), "v_catalog"))
def f7_all_neighbours(spark, d):
    return _shown(R.all_neighbours(X.catalog(spark, d), 5).withColumnRenamed("seed_id", "query_id"))


def _blend_inputs(spark, d):
    own = X.query_vectors(spark, d)
    return own, own.select("query_id", F.format_string("trk-%06d", F.substring("query_id", 3, 2).cast("int") + 30).alias("seed_id")), X.catalog(spark, d)


_BLEND = """, b AS (SELECT q.query_id, printf('trk-%06d', CAST(substr(q.query_id, 3) AS INTEGER) + 30) AS seed_id, q.track_id, q.artist_key, CAST(q.score AS DOUBLE) AS qs, CAST(s.score AS DOUBLE) AS ss FROM v_cosine q
    JOIN (SELECT a.track_id AS seed_id, b.track_id, CAST(greatest(-1, least(1, list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))
    / (sqrt(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])))))) AS FLOAT) AS score FROM v_catalog a, v_catalog b) s
    ON s.seed_id = printf('trk-%06d', CAST(substr(q.query_id, 3) AS INTEGER) + 30) AND s.track_id = q.track_id),
    z AS (SELECT query_id, seed_id, track_id, artist_key, qs, ss, (qs - avg(qs) OVER w) / stddev_pop(qs) OVER w + (ss - avg(ss) OVER w) / stddev_pop(ss) OVER w AS score FROM b WINDOW w AS (PARTITION BY query_id))
    """


@query(sql("", "v_cosine").rstrip() + _BLEND + _top(_CAPPED.format("(SELECT * FROM z WHERE seed_id <> track_id)")))
def f8_blend(spark, d):
    return _shown(R.blend(*_blend_inputs(spark, d), 10, max_per_artist=2))


_MMR = f"""WITH RECURSIVE {sql("", "v_cosine").strip()[4:]},
    r AS MATERIALIZED (SELECT query_id, track_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS rank FROM v_cosine) WHERE rank <= {V.MMR_POOL}),
    l AS MATERIALIZED (SELECT a.query_id, a.rank AS x, b.rank AS y, list_inner_product(CAST(u.vector AS DOUBLE[]), CAST(w.vector AS DOUBLE[])) / sqrt(list_inner_product(CAST(u.vector AS DOUBLE[]), CAST(u.vector AS DOUBLE[])) * list_inner_product(CAST(w.vector AS DOUBLE[]), CAST(w.vector AS DOUBLE[]))) AS alike
      FROM r a JOIN r b ON a.query_id = b.query_id JOIN v_catalog u ON u.track_id = a.track_id JOIN v_catalog w ON w.track_id = b.track_id),
    p(query_id, n, picked) AS (
      SELECT DISTINCT query_id, 1, [CAST(1 AS BIGINT)] FROM r
      UNION ALL
      SELECT p.query_id, n + 1, list_append(picked, (SELECT arg_min(c.rank, (-value, c.rank)) FROM (
        SELECT r.rank, {V.MMR_LAMBDA} * any_value(r.score) - {1 - V.MMR_LAMBDA} * max(l.alike) AS value FROM r JOIN l ON l.query_id = r.query_id AND l.x = r.rank AND list_contains(p.picked, l.y)
        WHERE r.query_id = p.query_id AND NOT list_contains(p.picked, r.rank) GROUP BY r.rank) c))
      FROM p WHERE n < 10 AND n < (SELECT count(*) FROM r WHERE r.query_id = p.query_id))
    SELECT r.query_id, r.track_id, round(r.score, 6) AS score, CAST(list_position(picked, r.rank) AS INTEGER) AS rank FROM r JOIN p ON p.query_id = r.query_id
    WHERE n = (SELECT max(n) FROM p q WHERE q.query_id = p.query_id) AND list_contains(picked, r.rank)"""


@query(_MMR)
def f9_mmr_rerank(spark, d):
    tracks = X.catalog(spark, d)
    return _shown(R.mmr_rerank(R.search(X.query_vectors(spark, d), tracks, V.MMR_POOL), tracks, 10))


@query(f"""WITH f AS ({_BAD}), e AS ({' UNION ALL '.join(_outside(c, v) for c, v in {**V.LABELS, 'energy': V.ENERGY_BANDS}.items())}
    UNION ALL SELECT query_id, 'tempo_min out of range' FROM f WHERE tempo_min NOT BETWEEN 30 AND 300 UNION ALL SELECT query_id, 'tempo_max out of range' FROM f WHERE tempo_max NOT BETWEEN 30 AND 300
    UNION ALL SELECT query_id, 'tempo_min over tempo_max' FROM f WHERE tempo_min > tempo_max
    UNION ALL SELECT query_id, CASE WHEN trim(coalesce(query, '')) = '' AND trim(coalesce(seed_id, '')) = '' THEN 'no query and no seed' WHEN length(trim(query)) > 400 THEN 'query too long' ELSE 'k out of range' END FROM f
      WHERE (trim(coalesce(query, '')) = '' AND trim(coalesce(seed_id, '')) = '') OR length(trim(query)) > 400 OR coalesce(k, 10) NOT BETWEEN 1 AND 50)
    SELECT query_id, CASE WHEN error IS NULL THEN CASE WHEN trim(coalesce(seed_id, '')) = '' THEN 'search' WHEN trim(coalesce(query, '')) = '' THEN 'similar' ELSE 'blend' END END AS mode, error
    FROM f LEFT JOIN (SELECT query_id, min(error) AS error FROM e GROUP BY query_id) USING (query_id)""")
def f10_route(spark, d):
    good, bad = Q.route(X.read(spark, d, "events").selectExpr(*_REQUEST))
    return good.select("query_id", "mode", F.lit(None).cast("string").alias("error")).unionByName(bad.select("query_id", F.lit(None).cast("string").alias("mode"), "error"))


# ------------------------------------------------------------------------------------------------ explanations


#: Words that queries are made of: the same list for Spark and for the SQL.
_WORDS = ("Relaxing", "hip-hop", "with a", "singer", "without", "heavy", "R&B", "not", "sad", "EDM", "no", "chill", "HIP   HOP", "never ever so very", "spooky", "jazz", "Metal,", "rapper", "calm", "calm", "of the")
_QUERY = f"""concat_ws(' ', {', '.join(f"CASE CAST(floor(doc_id / {7**i}) AS BIGINT) * {5 + 2 * i} % {len(_WORDS)} {' '.join(f"WHEN {j} THEN '{w}'" for j, w in enumerate(_WORDS))} END" for i in range(6))}, substr(text, 1, 60)) AS query"""


@query(f"""WITH q AS (SELECT doc_id, {_QUERY} FROM documents), w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(query), '\\bhip[\\s-]+hop\\b', 'hiphop', 'g'), '[a-z&]+') AS words FROM q),
    u AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w), v AS ({X.values([(w, a, x) for w, (a, x) in V.QUERY_WORDS.items()], "word, attribute, value")}),
    f AS (SELECT doc_id, attribute, value, min(i) AS i, arg_min(word, i) AS word FROM u JOIN v USING (word) WHERE NOT list_has_any(words[greatest(i - {V.NEGATION_WINDOW}, 1):i - 1], {list(V.NEGATIONS)}) GROUP BY ALL)
    SELECT doc_id, coalesce(string_agg(CASE word WHEN 'hiphop' THEN 'hip hop' ELSE word END || '=' || attribute || ':' || value, ', ' ORDER BY i), '') AS terms FROM q LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def g1_query_terms(spark, d):
    own = X.read(spark, d, "documents").selectExpr("doc_id", _QUERY)
    return own.select("doc_id", F.array_join(F.transform(G.query_terms("query"), lambda t: F.concat(t["term"], F.lit("="), t["attribute"], F.lit(":"), t["value"])), ", ").alias("terms"))


@query(sql("SELECT track_id, vocals, genre, list_aggregate(moods, 'string_agg', ',') AS mood, bpm AS tempo_bpm, band, energy AS percentile FROM v_attributes", "v_attributes"))
def g2_estimates_and_measurements(spark, d):
    own = _attributes(spark, d).select("track_id", G.track_estimates().alias("e"), G.track_measurements().alias("m"))
    return own.select("track_id", "e.vocals", "e.genre", F.array_join("e.mood", ",").alias("mood"), "m.tempo_bpm", F.col("m.energy.band").alias("band"), F.col("m.energy.percentile").alias("percentile"))


_SHARED = """, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS rank FROM v_seed_cosine WHERE seed_id <> track_id) WHERE rank <= 10),
    h AS (SELECT r.query_id, r.track_id, CASE WHEN s.vocals = a.vocals THEN a.vocals END AS vocals, CASE WHEN s.genre = a.genre THEN a.genre END AS genre,
      nullif(list_aggregate(list_filter(a.moods, lambda m: list_contains(s.moods, m)), 'string_agg', ', '), '') AS mood, abs(s.bpm - a.bpm) <= 0.08 * s.bpm AS tempo, CASE WHEN s.band = a.band THEN a.band END AS energy
      FROM r JOIN v_attributes s ON s.track_id = r.seed_id JOIN v_attributes a ON a.track_id = r.track_id)"""


def _similar_evidence(spark, d):
    tracks, seeds = X.catalog(spark, d), X.seeds(spark, d)
    found, _ = R.similar_to(seeds, tracks, 10)
    titled = seeds.join(tracks.select(F.col("track_id").alias("seed_id"), F.col("title").alias("seed_title")), "seed_id")
    return G.with_evidence(found, _attributes(spark, d), seeds=titled)


@query(sql("", "v_seed_cosine", "v_attributes").rstrip() + _SHARED + " SELECT query_id, track_id, vocals, genre, mood, coalesce(tempo, false) AS tempo, energy FROM h")
def g4_shared_with_seed(spark, d):
    s = F.col("shared")
    return _similar_evidence(spark, d).select("query_id", "track_id", s["vocals"].alias("vocals"), s["genre"].alias("genre"), F.array_join(s["mood"], ", ").alias("mood"), s["tempo_bpm"].isNotNull().alias("tempo"), s["energy"].alias("energy"))


@query(sql("", "v_seed_cosine", "v_attributes").rstrip() + _SHARED + """ SELECT h.query_id, h.track_id, concat_ws(' · ', 'Sounds like ' || c.title,
    CASE WHEN coalesce(h.vocals, h.genre, h.mood) IS NOT NULL THEN 'both ' || concat_ws(', ', h.vocals, h.genre, h.mood) || ' (model estimates)' END, CASE WHEN tempo THEN 'similar tempo' END, 'both ' || h.energy || ' energy') AS why
    FROM h JOIN v_seeds s USING (query_id) JOIN v_catalog c ON c.track_id = s.seed_id""")
def g8_short_reason_seed(spark, d):
    return _similar_evidence(spark, d).select("query_id", "track_id", G.short_reason().alias("why"))


#: Requests made of the query vectors' numbers: a text of two terms, and some filters.
_J = "CAST(substr(query_id, 3) AS INT)"
_ASKED = {
    "query": f"CASE {_J} % 3 WHEN 0 THEN 'calm jazz' WHEN 1 THEN 'vocal sad' ELSE 'electronic rock' END", "seed_id": "CAST(NULL AS STRING)", "k": f"10 + {_J}", "vocals": f"CASE WHEN {_J} % 4 = 1 THEN 'vocal' END",
    "genre": f"CASE WHEN {_J} % 6 = 5 THEN 'jazz' END", "mood": f"CASE WHEN {_J} = 3 THEN 'calm' END", "energy": f"CASE WHEN {_J} % 4 = 2 THEN 'high' END", "tempo_min": f"CASE WHEN {_J} % 5 = 4 THEN CAST(80 AS DOUBLE) END", "tempo_max": f"CASE WHEN {_J} % 10 = 4 THEN CAST(140 AS DOUBLE) END",
}
_TERMS = [(0, 1, "calm", "mood"), (0, 2, "jazz", "genre"), (1, 1, "vocal", "vocals"), (1, 2, "sad", "mood"), (2, 1, "electronic", "genre"), (2, 2, "rock", "genre")]


def _asked_sql() -> str:
    """CTEs: v_asked, verdicts w, results e with `of` and attributes, terms that agree g."""
    fields = ", ".join(f"{v} AS {k}" for k, v in _ASKED.items()).replace("STRING", "VARCHAR")
    verdicts = X.SQL["v_verdicts"].replace("v_filters", "v_asked")
    return sql("", "v_cosine", "v_attributes").rstrip() + f""", v_asked AS (SELECT query_id, {fields} FROM v_queries), w AS ({verdicts}),
        h AS (SELECT query_id, count(*) FILTER (code = 2) AS hidden_mismatch, count(*) FILTER (code = 1) AS hidden_unknown, count(*) FILTER (code = 0) AS candidates FROM w GROUP BY query_id),
        r AS (SELECT v.query_id, v.track_id, v.score, row_number() OVER (PARTITION BY v.query_id ORDER BY v.score DESC, v.track_id) AS rank FROM v_cosine v JOIN w ON w.query_id = v.query_id AND w.track_id = v.track_id WHERE code = 0),
        e AS (SELECT r.query_id, r.track_id, CAST(r.rank AS INTEGER) AS rank, round(CAST(r.score AS DOUBLE), 4) AS similarity, candidates, hidden_mismatch, hidden_unknown, q.query, q.vocals AS f_vocals, q.genre AS f_genre, q.mood AS f_mood, q.energy AS f_energy, q.tempo_min, q.tempo_max,
               a.vocals, a.genre, a.moods, a.bpm, a.band
              FROM r JOIN v_asked q ON q.query_id = r.query_id JOIN h ON h.query_id = r.query_id JOIN v_attributes a ON a.track_id = r.track_id WHERE r.rank <= q.k),
        t AS ({X.values(_TERMS, "j, place, term, attribute")}),
        g AS (SELECT e.query_id, e.track_id, string_agg(t.term, ',' ORDER BY place) AS terms, string_agg('"' || t.term || '"', ', ' ORDER BY place) AS quoted
              FROM e JOIN t ON t.j = CAST(substr(e.query_id, 3) AS INT) % 3
              WHERE coalesce(CASE attribute WHEN 'mood' THEN list_contains(moods, term) AND f_mood IS DISTINCT FROM term WHEN 'genre' THEN genre = term AND f_genre IS DISTINCT FROM term ELSE vocals = term AND f_vocals IS DISTINCT FROM term END, false)
              GROUP BY e.query_id, e.track_id),
        f AS (SELECT e.*, terms, quoted, nullif(concat_ws(', ', f_vocals || ' (model estimate)', f_genre || ' (model estimate)', f_mood || ' mood (model estimate)', f_energy || ' energy (measured)',
                CASE WHEN tempo_min IS NOT NULL THEN CASE WHEN tempo_max IS NOT NULL THEN '80-140 BPM' ELSE 'at least 80 BPM' END || ' (measured ' || CAST(round_even(bpm, 0) AS BIGINT) || ')' END), '') AS passed,
                nullif(concat_ws(' · ', vocals, genre, nullif(list_aggregate(moods, 'string_agg', ', '), '')), '') AS estimates, nullif(concat_ws(' · ', CAST(round_even(bpm, 0) AS BIGINT) || ' BPM', band || ' energy for this catalog'), '') AS measured
              FROM e LEFT JOIN g ON g.query_id = e.query_id AND g.track_id = e.track_id)"""


def _asked(spark, d):
    own = X.query_vectors(spark, d)
    return own.selectExpr("query_id", *[f"{v} AS {k}" for k, v in _ASKED.items()]), own


def _explained(spark, d):
    asked, vectors = _asked(spark, d)
    return Q.explained_search(asked, vectors, X.catalog(spark, d), _attributes(spark, d))


@query(_asked_sql() + " SELECT query_id, track_id, coalesce(terms, '') AS terms FROM f")
def g5_query_agreement(spark, d):
    return _explained(spark, d)[0].select("query_id", "track_id", F.coalesce(F.array_join(F.transform("agreement", lambda t: t["term"]), ","), F.lit("")).alias("terms"))


@query(_asked_sql() + " SELECT query_id, track_id, similarity, passed, vocals, genre, list_aggregate(moods, 'string_agg', ', ') AS mood, bpm, band FROM f")
def g6_evidence(spark, d):
    e, m = F.col("estimates"), F.col("measured")
    passed = F.array_join(F.transform("filters_passed", G.describe_filter), ", ")
    return _explained(spark, d)[0].select("query_id", "track_id", "similarity", passed.alias("passed"), e["vocals"].alias("vocals"), e["genre"].alias("genre"), F.array_join(e["mood"], ", ").alias("mood"), m["tempo_bpm"].alias("bpm"), m["energy"]["band"].alias("band"))


@query(_asked_sql() + " SELECT query_id, track_id, rank, candidates AS \"of\", hidden_mismatch, hidden_unknown FROM f")
def g7_explained_search(spark, d):
    rows, hidden = _explained(spark, d)
    return rows.join(hidden, "query_id").select("query_id", "track_id", "rank", "of", "hidden_mismatch", "hidden_unknown")


@query(_asked_sql() + """ SELECT query_id, track_id, concat_ws(' | ', 'Why: closest sound match to "' || query || '" (rank ' || rank || ' of ' || candidates || ')' || coalesce('; passed your filters: ' || passed, ''),
    'Agrees with your search: ' || quoted || ' (model estimate)', 'Model estimates: ' || estimates, 'Measured: ' || measured) AS lines FROM f""")
def g9_summarize(spark, d):
    return _explained(spark, d)[0].select("query_id", "track_id", F.array_join(G.summarize(), " | ").alias("lines"))


@query(_asked_sql() + """ SELECT a.query_id, 'search' AS mode, coalesce(string_agg(f.track_id || ' ' || printf('%.4f', similarity) || ' ' || CASE WHEN passed IS NOT NULL THEN upper(passed[1]) || passed[2:] || ' · closest sound match to "' || a.query || '"'
    WHEN quoted IS NOT NULL THEN 'Matches ' || quoted || ' in your search (model estimate) · closest sound match to "' || a.query || '"' ELSE 'Closest sound match to "' || a.query || '"' END, '; ' ORDER BY rank), '') AS results, h.hidden_mismatch, h.hidden_unknown
    FROM v_asked a JOIN h ON h.query_id = a.query_id LEFT JOIN (SELECT e.* FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id, artist_key ORDER BY rank) AS n FROM (SELECT f.*, lower(c.artist) AS artist_key FROM f JOIN v_catalog c ON c.track_id = f.track_id) f) e) f ON f.query_id = a.query_id
    GROUP BY a.query_id, a.query, h.hidden_mismatch, h.hidden_unknown""")
def g11_responses(spark, d):
    asked, vectors = _asked(spark, d)
    answers, _ = Q.respond(asked, vectors, X.catalog(spark, d), _attributes(spark, d), None)
    line = lambda x: F.concat(x["track_id"], F.lit(" "), F.format_string("%.4f", x["score"]), F.lit(" "), x["why"])
    return answers.select("query_id", "mode", F.array_join(F.transform("results", line), "; ").alias("results"), "hidden_mismatch", "hidden_unknown")


@query(sql("", "v_cosine").rstrip() + _BLEND.rstrip() + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY qs DESC, track_id) AS query_rank FROM z),
    s AS (SELECT query_id, track_id, row_number() OVER (PARTITION BY query_id ORDER BY ss DESC, track_id) AS seed_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS rank FROM z WHERE track_id <> seed_id)
    SELECT query_id, track_id, CAST(rank AS INTEGER) AS rank, round(qs, 6) AS query_cosine, query_rank, round(ss, 6) AS seed_cosine, seed_rank FROM p JOIN s USING (query_id, track_id) WHERE rank <= 10""")
def g10_blend_paths(spark, d):
    vectors, seeds, tracks = _blend_inputs(spark, d)
    out = Q.explain_blend(R.blend(vectors, seeds, tracks, 10), vectors, seeds, tracks)
    cosines = {c: F.round(F.col(c).cast("double"), 6) for c in ("query_cosine", "seed_cosine")}
    return out.select("query_id", "track_id", "rank", "query_cosine", "query_rank", "seed_cosine", "seed_rank").withColumns(cosines)


# ------------------------------------------------------------------------------------------------ lookups


_NEEDLES = "SELECT CAST(p_partkey AS VARCHAR) AS needle_id, CASE p_partkey % 5 WHEN 0 THEN upper(substr(p_name, 2, 6)) WHEN 1 THEN ' ' || substr(p_name, 4, 3) WHEN 2 THEN substr(p_name, 1, 2) WHEN 3 THEN lower(p_brand) ELSE '  ' END AS text FROM part"


@query(sql(f"""SELECT needle_id, track_id, title, artist, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY needle_id ORDER BY kind, lower(title), track_id) AS place FROM (
    SELECT needle_id, track_id, title, artist, CASE WHEN starts_with(lower(title), needle) THEN 0 WHEN contains(lower(title), needle) THEN 1 ELSE 2 END AS kind
    FROM v_catalog JOIN (SELECT needle_id, lower(trim(text)) AS needle FROM ({_NEEDLES}) WHERE trim(text) <> '') n ON contains(lower(title || ' ' || artist), needle))) WHERE place <= 10""", "v_catalog"))  # fmt: skip
def h1_find_tracks(spark, d):
    needles = X.read(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS needle_id", _NEEDLES[_NEEDLES.index("CASE") : _NEEDLES.index(" FROM")])
    return H.find_tracks(needles, X.catalog(spark, d))


@query(sql("", "v_catalog").rstrip() + """, t AS (SELECT lower(trim(title)) AS t, count(*) AS n, min(track_id) AS one FROM v_catalog GROUP BY 1)
    SELECT 'h-' || printf('%06d', vec_id) AS query_id, CASE vec_id % 4 WHEN 0 THEN track_id WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN n = 1 THEN one END END AS track_id,
    CASE vec_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'unknown' WHEN 2 THEN CASE WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END ELSE 'invalid' END AS status FROM v_catalog JOIN t ON t.t = lower(trim(title))""")  # fmt: skip
def h2_resolve_seeds(spark, d):
    own, k = X.catalog(spark, d), F.col("vec_id") % 4
    asked = own.select(F.format_string("h-%06d", "vec_id").alias("query_id"), F.when(k == 0, F.col("track_id")).when(k == 1, "nope").alias("provider_id"), F.when(k == 2, F.upper("title")).when(k == 3, " ").alias("title"))
    return H.resolve_seeds(asked, own)


@query(sql("SELECT i.seed_id AS track_id, title, artist, vocals, bpm, c.track_id IS NOT NULL AS known FROM v_seeds i LEFT JOIN v_catalog c ON c.track_id = i.seed_id LEFT JOIN v_attributes a ON a.track_id = i.seed_id", "v_seeds", "v_catalog", "v_attributes"))
def h3_track_detail(spark, d):
    out = H.track_detail(X.seeds(spark, d).select(F.col("seed_id").alias("track_id")), X.catalog(spark, d), _attributes(spark, d))
    return out.select("track_id", "title", "artist", F.col("estimates.vocals").alias("vocals"), F.col("measured.tempo_bpm").alias("bpm"), "known")


@query(sql("SELECT track_id, CASE WHEN license IS NOT NULL AND NOT starts_with(license, 'unknown') AND vec_id % 3 <> 0 THEN 'https://x.example/tracks/' || track_id || '/audio' END AS preview_url FROM v_catalog", "v_catalog"))
def h4_preview(spark, d):
    own = X.catalog(spark, d)
    return H.with_preview(own, own.where("vec_id % 3 <> 0").select(F.col("audio_path").alias("path")), "https://x.example/").select("track_id", "preview_url")


# ------------------------------------------------------------------------------------------------ evaluation


def _labels(spark, d):
    own = X.read(spark, d, "labels")
    mood = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("calm"), F.lit("sad")))
    return own.select(F.format_string("trk-%06d", "doc_id").alias("track_id"), F.when(F.col("quality") == 1, "vocal").otherwise("instrumental").alias("vocals"), F.when(F.col("doc_id") % 2 == 0, "electronic").alias("genre"), mood.alias("mood"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("energy"))


_COMPARED = """, l AS (SELECT printf('trk-%06d', doc_id) AS track_id, CASE WHEN quality = 1 THEN 'vocal' ELSE 'instrumental' END AS vocals, CASE WHEN doc_id % 2 = 0 THEN 'electronic' END AS genre,
      CASE WHEN doc_id % 3 = 0 THEN ['calm', 'sad'] END AS mood, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS energy FROM labels),
    c AS (SELECT track_id, 'vocals' AS attribute, CASE WHEN a.vocals IS NULL THEN 'unknown' WHEN a.vocals = l.vocals THEN 'agree' ELSE 'disagree' END AS outcome FROM l JOIN v_attributes a USING (track_id)
      UNION ALL SELECT track_id, 'genre', CASE WHEN a.genre IS NULL THEN 'unknown' WHEN a.genre = l.genre THEN 'agree' ELSE 'disagree' END FROM l JOIN v_attributes a USING (track_id) WHERE l.genre IS NOT NULL
      UNION ALL SELECT track_id, 'mood', CASE WHEN len(moods) = 0 THEN 'unknown' WHEN list_has_any(moods, mood) THEN 'agree' ELSE 'disagree' END FROM l JOIN v_attributes a USING (track_id) WHERE mood IS NOT NULL
      UNION ALL SELECT track_id, 'energy', CASE WHEN band = l.energy THEN 'agree' ELSE 'disagree' END FROM l JOIN v_attributes a USING (track_id))"""


@query(sql("", "v_attributes").rstrip() + _COMPARED + " SELECT * FROM c")
def i2_compare_with_labels(spark, d):
    return E.compare_with_labels(_attributes(spark, d), _labels(spark, d))


@query(sql("", "v_attributes").rstrip() + _COMPARED + " SELECT attribute, count(*) FILTER (outcome = 'agree') AS agree, count(*) FILTER (outcome <> 'unknown') AS decided, count(*) FILTER (outcome = 'unknown') AS unknown FROM c GROUP BY attribute")
def i3_agreement_summary(spark, d):
    return E.agreement_summary(E.compare_with_labels(_attributes(spark, d), _labels(spark, d)))


@query(sql(f"""SELECT round((SELECT avg(CAST(a.genre_top = b.genre_top AS INTEGER)) FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, track_id) AS rank FROM {_ALL}) n
    JOIN v_catalog a ON a.track_id = n.seed_id JOIN v_catalog b ON b.track_id = n.track_id WHERE rank <= 5), 6) AS share,
    (SELECT round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) FROM (SELECT count(*) AS n FROM v_catalog GROUP BY genre_top)) AS chance""", "v_catalog"))  # fmt: skip
def i4_genre_agreement(spark, d):
    own = X.catalog(spark, d)
    return E.genre_agreement_at_k(R.all_neighbours(own, 5), own.select("track_id", F.col("genre_top").alias("genre")), 5)


_LISTS = ", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS rank FROM v_cosine) WHERE rank <= 40)"


@query(sql("", "v_cosine").rstrip() + _LISTS + " SELECT track_id, count(DISTINCT query_id) AS queries, count(*) FILTER (rank = 1) AS firsts FROM r GROUP BY track_id")
def i5_hubness(spark, d):
    return E.hubness(R.search(X.query_vectors(spark, d), X.catalog(spark, d), 40))


@query(sql("", "v_cosine").rstrip() + _LISTS + " SELECT a.query_id AS left_id, b.query_id AS right_id, count(*) AS shared FROM r a JOIN r b ON a.track_id = b.track_id AND a.query_id < b.query_id GROUP BY 1, 2")
def i6_list_overlap(spark, d):
    return E.list_overlap(R.search(X.query_vectors(spark, d), X.catalog(spark, d), 40))


@query(sql("""SELECT query_id, round(corr(s, e), 6) AS rho FROM (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2 AS s,
    rank() OVER (PARTITION BY query_id ORDER BY energy) + (count(*) OVER (PARTITION BY query_id, energy) - 1) / 2 AS e FROM v_cosine JOIN v_attributes USING (track_id)) GROUP BY query_id""", "v_cosine", "v_attributes"))  # fmt: skip
def i6_score_energy_correlation(spark, d):
    return E.score_energy_correlation(R.cosine_scores(X.query_vectors(spark, d), X.catalog(spark, d)), _attributes(spark, d))


@query(sql("", "v_cosine").rstrip() + _LISTS + """ SELECT query_id, count(*) FILTER (g = 0) AS good, count(*) FILTER (g = 1) AS acceptable, count(*) FILTER (g = 2) AS wrong, count(*) FILTER (g = 3) AS ungraded
    FROM (SELECT query_id, CAST(substr(track_id, 5) AS INTEGER) % 4 AS g FROM r WHERE rank <= 5) GROUP BY query_id""")
def i7_graded_relevance(spark, d):
    found = R.search(X.query_vectors(spark, d), X.catalog(spark, d), 40)
    g = F.substring("track_id", 5, 6).cast("int") % 4
    return E.graded_relevance(found, found.where(g < 3).select("query_id", "track_id", F.array(*map(F.lit, ("good", "acceptable", "wrong")))[g].alias("grade")), 5)


@query("SELECT round(quantile_cont(elapsed, 0.5), 6) AS median, round(quantile_cont(elapsed, 0.95), 6) AS p95, max(elapsed) AS max FROM (SELECT CAST(o_totalprice AS DOUBLE) AS elapsed FROM orders)")
def i8_latency_summary(spark, d):
    return E.latency_summary(X.read(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("elapsed_ms")))


# ------------------------------------------------------------------------------------------------ interactions


def _incoming(spark, d):
    """A feed of all pages: those with a number divisible by 3 come first. Neighbours share a title and a URL, every other row names its provider id, and a key's titles change."""
    k = F.col("page_id")
    m = F.floor(k / 2)
    url = F.when(m % 5 == 0, F.concat(F.lit("ftp://x.example/"), m.cast("string"))).when(m % 5 != 1, F.concat(F.lit("https://x.example/"), F.floor(m / 400).cast("string"), F.lit("/"), (m % 20).cast("string")))
    return X.read(spark, d, "pages").select(
        (k + F.when(k % 3 == 0, F.lit(0)).otherwise(F.lit(10**15))).alias("row_id"), F.when(k % 9 != 8, F.concat(F.lit("Title "), (m % 30).cast("string"))).alias("title"), F.rpad(F.concat(F.lit("Artist "), (m % 3).cast("string")), 200, "x").alias("artist"), url.alias("provider_url"),
        F.when(k % 2 == 0, F.concat(F.lit("id-"), (m % 20).cast("string"))).alias("provider_id"), F.when(k % 3 == 0, "12.5").otherwise(k.cast("string")).alias("duration_seconds"),
    )


_IN = """i AS (SELECT page_id + CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1000000000000000 END AS row_id, CASE WHEN page_id % 9 <> 8 THEN 'Title ' || (page_id // 2 % 30) ELSE '' END AS title,
    substr(rpad('Artist ' || (page_id // 2 % 3), 200, 'x'), 1, 160) AS artist, CASE WHEN page_id // 2 % 5 NOT IN (0, 1) THEN 'https://x.example/' || (page_id // 800) || '/' || (page_id // 2 % 20) END AS provider_url,
    CASE WHEN page_id % 2 = 0 THEN 'id-' || (page_id // 2 % 20) END AS provider_id, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS INTEGER) END AS duration_seconds FROM pages)"""


@query("WITH " + _IN + " SELECT row_id, title, artist, provider_url, provider_id, duration_seconds FROM i")
def j1_normalize_identity(spark, d):
    return J.normalize_track_identity(_incoming(spark, d)).select("row_id", "title", "artist", "provider_url", "provider_id", "duration_seconds")


def _one_by_one(changed: str) -> str:
    """Every row after the other against the list of tracks as it is then; `changed` is the list when a track of the row's provider key is there."""
    return f"""WITH RECURSIVE {_IN},
        k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) AS n, row_id, title, duration_seconds AS seconds, 'n' || chr(31) || title || chr(31) || artist || chr(31) || coalesce(provider_url, chr(30)) AS nkey,
            CASE WHEN provider_id IS NOT NULL AND provider_url IS NOT NULL THEN 'p' || chr(31) || provider_id || chr(31) || provider_url END AS pkey FROM i),
        s(n, row_id, got, tracks) AS (
          SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS STRUCT(id VARCHAR, nkey VARCHAR, pkey VARCHAR, title VARCHAR, seconds INTEGER, created BIGINT)[])
          UNION ALL
          SELECT n, row_id, CASE WHEN title <> '' THEN coalesce(found.id, 'new-' || substr(sha256(coalesce(pkey, nkey)), 1, 16)) END,
                 CASE WHEN title = '' THEN tracks WHEN found IS NULL THEN list_append(tracks, {{'id': 'new-' || substr(sha256(coalesce(pkey, nkey)), 1, 16), 'nkey': nkey, 'pkey': pkey, 'title': title, 'seconds': seconds, 'created': row_id}}) ELSE {changed} END
          FROM (SELECT k.*, s.tracks, CASE WHEN k.pkey IS NULL THEN list_filter(s.tracks, lambda t: t.nkey = k.nkey)[1] ELSE list_filter(s.tracks, lambda t: t.pkey = k.pkey)[1] END AS found
                FROM s JOIN k ON k.n = s.n + 1))"""


_FIND = _one_by_one("tracks")
_UPSERT = _one_by_one("CASE WHEN pkey IS NULL THEN tracks ELSE list_transform(tracks, lambda t: CASE WHEN t.pkey = pkey THEN {'id': t.id, 'nkey': nkey, 'pkey': pkey, 'title': title, 'seconds': seconds, 'created': t.created} ELSE t END) END")
_MAPPED = " SELECT row_id, got AS track_id FROM s WHERE n > 0"
_LAST = " SELECT t.id, t.title, t.seconds AS duration_seconds, t.created FROM (SELECT unnest(tracks) AS t FROM s WHERE n = (SELECT max(n) FROM s))"


def _in_two_batches(step, spark, d):
    """The feed as two batches, the second against the tracks that the first leaves: (tracks, mapping of all rows)."""
    rows = _incoming(spark, d)
    none = J.normalize_track_identity(rows.limit(0)).select(F.lit("").alias("id"), *J.IDENTITY)
    tracks, first = step(rows.where(F.col("row_id") < 10**15), none)
    tracks, second = step(rows.where(F.col("row_id") >= 10**15), written(tracks, "tracks"))
    return tracks.select("id", "title", "duration_seconds", "created"), first.unionByName(second)


@query(_FIND + _MAPPED)
def j2_find_or_create(spark, d):
    return _in_two_batches(J.find_or_create_tracks, spark, d)[1]


@query(_FIND + _LAST)
def j2_tracks(spark, d):
    return _in_two_batches(J.find_or_create_tracks, spark, d)[0]


@query(_UPSERT + _MAPPED)
def j3_upsert(spark, d):
    return _in_two_batches(J.upsert_tracks, spark, d)[1]


@query(_UPSERT + _LAST)
def j3_tracks(spark, d):
    return _in_two_batches(J.upsert_tracks, spark, d)[0]


@query(sql("SELECT id, action, action IN ('SAVE', 'REJECT', 'OPEN', 'SKIP') AS accepted, CASE WHEN action NOT IN ('SAVE', 'REJECT', 'OPEN', 'SKIP') THEN 'unsupported action' END AS reason FROM v_feedback", "v_feedback"))
def j4_feedback_check(spark, d):
    good, bad = J.split_feedback(X.feedback(spark, d))
    return good.select("id", "action", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "action", F.lit(False).alias("accepted"), "reason"))


@query(_FIND.replace("FROM pages)", "FROM pages WHERE page_id % 4 <> 3)", 1) + """, p AS (SELECT page_id AS n, page_id + CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1000000000000000 END AS row_id FROM pages)
    SELECT p.row_id, got AS track_id, CASE WHEN p.n % 4 = 3 THEN 'unsupported action' WHEN got IS NULL THEN 'incomplete track' END AS reason FROM p LEFT JOIN s ON s.row_id = p.row_id""")
def j4_ingest_feedback(spark, d):
    """Feedback on the tracks of all pages, every fourth with an action that isn't known."""
    rows = _incoming(spark, d).withColumns({"user_id": F.lit("u"), "query_id": F.lit(""), "created_at": F.lit(None).cast("timestamp"), "action": F.when(F.col("row_id") % 10**15 % 4 == 3, "LIKE").otherwise("SAVE")})
    none = J.normalize_track_identity(rows.limit(0)).select(F.lit("").alias("id"), *J.IDENTITY)
    accepted, rejected, _ = J.ingest_feedback(rows, none)
    return accepted.select("row_id", "track_id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("row_id", F.lit(None).cast("string").alias("track_id"), "reason"))


@query(sql("SELECT user_id, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM v_feedback) WHERE place <= 3", "v_feedback"))
def j5_user_history(spark, d):
    return J.user_history(X.feedback(spark, d), 3).select("user_id", "id", "place")


@query(sql("SELECT track_id, count(*) FILTER (action = 'SAVE') AS save, count(*) FILTER (action = 'REJECT') AS reject, count(*) FILTER (action = 'OPEN') AS open, count(*) FILTER (action = 'SKIP') AS skip FROM v_feedback GROUP BY track_id", "v_feedback"))
def j5_track_actions(spark, d):
    return J.track_actions(X.feedback(spark, d))


@query(sql("SELECT user_id, query_id, track_id, count(*) AS n FROM v_feedback f WHERE NOT EXISTS (SELECT 1 FROM v_feedback r WHERE r.action = 'REJECT' AND r.user_id = f.user_id AND r.query_id = f.query_id AND r.track_id = f.track_id) GROUP BY ALL", "v_feedback"))
def j6_hide_rejected(spark, d):
    events = X.feedback(spark, d)
    return J.hide_rejected(events.select("user_id", "query_id", "track_id"), events).groupBy("user_id", "query_id", "track_id").agg(F.count("*").alias("n"))


@query(sql("SELECT CAST(o_custkey AS BIGINT) AS owner_id, CAST(o_orderkey AS BIGINT) AS playlist_id, o_orderdate AS updated_at, (SELECT count(*) FROM v_items i WHERE i.playlist_id = o_orderkey) AS tracks FROM orders", "v_items"))
def j7_playlist_overview(spark, d):
    own = X.playlists(spark, d)
    return J.playlist_overview(own, X.playlist_items(spark, d), own.select("owner_id").distinct())


@query(sql("SELECT CAST(o_custkey AS BIGINT) AS user_id, i.playlist_id, i.track_id, position, p_name AS title FROM orders JOIN v_items i ON i.playlist_id = o_orderkey JOIN part ON p_partkey = i.track_id", "v_items"))
def j8_playlist_detail(spark, d):
    own = X.playlists(spark, d)
    asked = own.select(F.col("owner_id").alias("user_id"), "playlist_id").unionByName(own.select((F.col("owner_id") + 1).alias("user_id"), "playlist_id"))
    tracks = X.read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("track_id"), F.col("p_name").alias("title"))
    return J.playlist_detail(asked, own, X.playlist_items(spark, d), tracks).select("user_id", "playlist_id", "track_id", "position", "title")


@query(sql("""SELECT playlist_id, track_id, position FROM v_items UNION ALL SELECT playlist_id, track_id, CAST(size + row_number() OVER (PARTITION BY playlist_id ORDER BY track_id) - 1 AS INTEGER) FROM
    (SELECT playlist_id, count(*) AS size, unnest([1, 2, 3]) AS track_id FROM v_items WHERE playlist_id % 4 = 0 GROUP BY playlist_id) a WHERE NOT EXISTS (SELECT 1 FROM v_items i WHERE i.playlist_id = a.playlist_id AND i.track_id = a.track_id)""", "v_items"))  # fmt: skip
def j9_add_tracks(spark, d):
    items = X.playlist_items(spark, d)
    new = items.where("playlist_id % 4 = 0").select("playlist_id").distinct().select("playlist_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])).alias("track_id")).withColumn("seq", F.col("track_id"))
    return J.add_tracks(items, new)


@query(sql("SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY position) - 1 AS INTEGER) AS position FROM v_items WHERE NOT (track_id % 3 = 0 AND playlist_id % 2 = 0)", "v_items"))
def j10_remove_tracks(spark, d):
    items = X.playlist_items(spark, d)
    return J.remove_tracks(items, items.where("track_id % 3 = 0 and playlist_id % 2 = 0"))[0]


@query(sql("""SELECT i.playlist_id, track_id, CASE WHEN i.playlist_id % 3 = 0 THEN CAST(n - 1 - position AS INTEGER) ELSE position END AS position, CASE WHEN i.playlist_id % 3 = 1 AND n > 1 THEN 'incomplete' WHEN i.playlist_id % 3 = 2 THEN 'invalid' END AS reason
    FROM v_items i JOIN (SELECT playlist_id, count(*) AS n FROM v_items GROUP BY 1) c USING (playlist_id)""", "v_items"))  # fmt: skip
def j11_reorder(spark, d):
    items = X.playlist_items(spark, d)
    k = F.col("playlist_id") % 3
    lists = items.groupBy("playlist_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("position")).alias("p"), "track_id"))), lambda x: x["track_id"]).alias("r"))
    asked = F.when(k == 0, F.col("r")).when(k == 1, F.slice("r", 1, 1)).otherwise(F.transform("r", lambda x: x + 1_000_000))
    out, bad = J.reorder(items, lists.select("playlist_id", asked.alias("requested")))
    return out.join(bad, "playlist_id", "left").select("playlist_id", "track_id", "position", "reason")


@query(sql("""SELECT 'users' AS table_name, CAST(c_custkey AS VARCHAR) AS key, '' AS track FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL SELECT 'playlists', CAST(o_orderkey AS VARCHAR), '' FROM orders WHERE o_custkey % 10 <> 0
    UNION ALL SELECT 'tracks', CAST(p_partkey AS VARCHAR), '' FROM part WHERE p_partkey % 7 <> 0
    UNION ALL SELECT 'items', CAST(playlist_id AS VARCHAR), CAST(track_id AS VARCHAR) FROM v_items JOIN orders ON o_orderkey = playlist_id WHERE o_custkey % 10 <> 0 AND track_id % 7 <> 0
    UNION ALL SELECT 'feedback', id, '' FROM v_feedback WHERE CAST(user_id AS INTEGER) % 10 <> 0""", "v_items", "v_feedback"))  # fmt: skip
def j12_cascade_delete(spark, d):
    users = X.read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"))
    parts = X.read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"))
    feedback = X.feedback(spark, d).withColumn("user_id", F.col("user_id").cast("bigint")).withColumn("track_id", F.lit(-1).cast("bigint"))
    tables = {"users": users, "tracks": parts, "playlists": X.playlists(spark, d), "items": X.playlist_items(spark, d), "feedback": feedback}
    gone = {"users": X.read(spark, d, "events").select((F.col("user_id") - F.col("user_id") % 10).cast("bigint").alias("id")).unionByName(users.where("id % 10 = 0")).distinct(), "tracks": parts.where("id % 7 = 0")}
    left = J.cascade_delete(tables, gone)
    rows = None
    for name, key, track in (("users", "id", None), ("playlists", "playlist_id", None), ("tracks", "id", None), ("items", "playlist_id", "track_id"), ("feedback", "id", None)):
        part = left[name].select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), (F.col(track).cast("string") if track else F.lit("")).alias("track"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
