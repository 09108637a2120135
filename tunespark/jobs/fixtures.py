"""Views over the test tables in the library's layouts, for Spark and as SQL that means the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunespark import vocab as V

DIM = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the names, brands and types of parts as titles, artists and genres."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type").where("p_partkey < 200")
    own = read(spark, sf_dir, "embeddings").join(F.broadcast(part), F.col("p_partkey") == F.col("vec_id") % 200)
    license_ = F.when(F.col("vec_id") % 7 == 1, "unknown (see dataset)").when(F.col("vec_id") % 7 != 0, "CC BY")
    return own.select(
        F.format_string("trk-%06d", "vec_id").alias("track_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre_top"),
        license_.alias("license"), F.format_string("%06d.mp3", "vec_id").alias("audio_path"), F.col("embedding").alias("vector"), "vec_id",
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label: the reversed vector of its smallest id."""
    least = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return least.select(F.format_string("q-%02d", "label").alias("query_id"), F.reverse("v").alias("vector"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track whose number is divisible by 100 as a seed, and one that the catalog doesn't have."""
    own = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.format_string("s-%06d", "vec_id").alias("query_id"), F.format_string("trk-%06d", "vec_id").alias("seed_id"))
    return own.unionByName(spark.createDataFrame([("s-999999", "trk-999999")], "query_id string, seed_id string"))


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, class_scores): a quarter of the square of a dimension for each tagged class."""
    values = F.transform(F.slice("embedding", 1, len(V.CLASSES)), lambda x: F.lit(0.25) * x.cast("double") * x.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.format_string("trk-%06d", "vec_id").alias("track_id"), F.map_from_arrays(F.array(*map(F.lit, V.CLASSES)), values).alias("class_scores"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda i: F.col("embedding")[i].cast("double")
    bpm = F.when(F.abs(x(53)) >= 0.03, F.floor(600 + F.abs(x(53)) * 4000) / 10)
    return read(spark, sf_dir, "embeddings").select(
        F.format_string("trk-%06d", "vec_id").alias("track_id"), (F.floor(x(51) * 1000) / 100 - 20).alias("loudness_dbfs"), (F.floor(F.abs(x(52)) * 1000) / 100).alias("onset_rate"),
        bpm.alias("bpm"), F.abs(x(54)).alias("pulse_clarity"),
    )


def raw_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(spark, sf_dir).join(measurements(spark, sf_dir), "track_id")


#: (query_id, vocals, genre, mood, energy, tempo_min, tempo_max)
FILTER_ROWS = [
    ("f-01", "vocal", None, None, None, None, None), ("f-02", None, "rock", None, None, None, None), ("f-03", None, None, "calm", None, None, None), ("f-04", None, None, None, "high", None, None),
    ("f-05", None, None, None, None, 80.0, 120.0), ("f-06", "instrumental", "electronic", None, None, None, None), ("f-07", None, None, "sad", "low", None, 130.0), ("f-08", " ", None, None, None, None, None),
]
BAD_FILTER_ROWS = [
    ("b-01", "loud", None, None, None, None, None), ("b-02", None, "polka", "calm", None, None, None), ("b-03", None, None, None, None, 10.0, 90.0),
    ("b-04", None, None, None, None, 150.0, 90.0), ("b-05", None, None, "bored", "huge", None, 400.0),
]
FILTER_SCHEMA = "query_id string, vocals string, genre string, mood string, energy string, tempo_min double, tempo_max double"
TEXTS = [
    ("t-01", "Relaxing hip-hop with a female singer"), ("t-02", "late-night beats without heavy vocals"), ("t-03", "calm calm jazz, not sad"), ("t-04", "R&B and EDM for a dark cheerful night"),
    ("t-05", ""), ("t-06", "no singing just chill ambient rock"), ("t-07", "aggressive metal rapper"), ("t-08", "HIP   HOP rap"), ("t-09", "never ever so very spooky"), ("t-10", "jazz"),
]


def filter_requests(spark: SparkSession, bad: bool = False) -> DataFrame:
    return spark.createDataFrame(FILTER_ROWS + (BAD_FILTER_ROWS if bad else []), FILTER_SCHEMA)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.create_map(*[F.lit(x) for pair in (("purchase", "SAVE"), ("error", "REJECT"), ("click", "OPEN"), ("view", "SKIP")) for x in pair]), F.col("event_type"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.format_string("trk-%06d", F.col("event_id") % 500).alias("track_id"),
        F.concat(F.lit("q-"), (F.col("event_id") % 10).cast("string")).alias("query_id"), F.coalesce(action, F.col("event_type")).alias("action"), F.col("ts").alias("created_at"),
    )


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("playlist_id"), F.col("o_custkey").cast("bigint").alias("owner_id"), F.col("o_orderdate").alias("updated_at"))


def playlist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("playlist_id"), F.col("l_partkey").cast("bigint").alias("track_id")).agg(F.min("l_linenumber").alias("line"))
    place = F.row_number().over(Window.partitionBy("playlist_id").orderBy("line", "track_id")) - 1
    return own.select("playlist_id", "track_id", place.cast("int").alias("position"))


def dataset_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("track_id"), F.col("p_type").alias("genre_top"), F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.col("p_name")).alias("title"),
        F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.col("p_brand")).alias("artist"), F.when(F.col("p_partkey") % 3 == 0, "CC BY").alias("license"),
        F.when(F.col("p_partkey") % 2 == 0, "small").otherwise("medium").alias("subset"), (F.col("p_partkey") % 5 != 0).alias("available"),
    )


# ---------------------------------------------------------------------------------------------------- the same in SQL


def values(rows: list[tuple], names: str) -> str:
    text = lambda x: "NULL" if x is None else repr(float(x)) if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


def _class(name: str) -> str:
    return f"(0.25 * CAST(embedding[{V.CLASSES.index(name) + 1}] AS DOUBLE) * CAST(embedding[{V.CLASSES.index(name) + 1}] AS DOUBLE))"


def _pairs(rows: list[tuple[str, str]], a: str, b: str) -> str:
    return "[" + ", ".join(f"{{'{a}': {x}, '{b}': '{y}'}}" for x, y in rows) + "]"


_VOCAL = f"list_sort({_pairs([(_class(c), c) for c in V.VOCAL_CLASSES], 's', 'n')}, 'DESC')[1]"
_GENRES = {g: (f"greatest({', '.join(map(_class, own))})" if len(own) > 1 else _class(own[0])) for g, own in V.GENRE_CLASSES.items()}
_GENRE = f"list_sort({_pairs([(f'-{s}', g) for g, s in _GENRES.items()], 's', 'n')})[1]"
_MOODS = f"list_transform(list_filter(list_sort({_pairs([(f'-{_class(c)}', m) for m, c in V.MOOD_CLASSES.items()], 's', 'n')}), lambda x: -x.s >= {V.MOOD_MIN}), lambda x: x.n)[1:{V.MAX_MOODS}]"
_ID = "printf('trk-%06d', vec_id)"

SQL = {
    "v_catalog": f"""SELECT {_ID} AS track_id, p_name AS title, p_brand AS artist, p_type AS genre_top,
        CASE WHEN vec_id % 7 = 1 THEN 'unknown (see dataset)' WHEN vec_id % 7 <> 0 THEN 'CC BY' END AS license, printf('%06d.mp3', vec_id) AS audio_path, embedding AS vector, vec_id
        FROM embeddings JOIN part ON p_partkey = vec_id % 200""",
    "v_queries": "SELECT printf('q-%02d', label) AS query_id, list_reverse(arg_min(embedding, vec_id)) AS vector FROM embeddings GROUP BY label",
    "v_seeds": f"SELECT printf('s-%06d', vec_id) AS query_id, {_ID} AS seed_id FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT 's-999999', 'trk-999999'",
    "v_measures": f"""SELECT {_ID} AS track_id, floor(CAST(embedding[52] AS DOUBLE) * 1000) / 100 - 20 AS loudness_dbfs, floor(abs(CAST(embedding[53] AS DOUBLE)) * 1000) / 100 AS onset_rate,
        CASE WHEN abs(CAST(embedding[54] AS DOUBLE)) >= 0.03 THEN floor(600 + abs(CAST(embedding[54] AS DOUBLE)) * 4000) / 10 END AS bpm FROM embeddings""",
    "v_ranks": """SELECT track_id, ((rank() OVER (ORDER BY loudness_dbfs) - 1) * 2 + count(*) OVER (PARTITION BY loudness_dbfs) - 1) / 2 / (count(*) OVER () - 1) AS loud,
        ((rank() OVER (ORDER BY onset_rate) - 1) * 2 + count(*) OVER (PARTITION BY onset_rate) - 1) / 2 / (count(*) OVER () - 1) AS onset FROM v_measures""",
    "v_labels0": f"SELECT {_ID} AS track_id, {_VOCAL} AS v, {_GENRE} AS g, {_MOODS} AS moods FROM embeddings",
    "v_attributes": f"""SELECT l.track_id, CASE WHEN v.s >= {V.VOCAL_ON} THEN 'vocal' WHEN v.s <= {V.VOCAL_OFF} THEN 'instrumental' END AS vocals, round(v.s, 5) AS vocal_score, v.n AS vocal_class,
        CASE WHEN -g.s >= {V.GENRE_MIN} THEN g.n END AS genre, round(-g.s, 5) AS genre_score, moods, m.bpm, m.loudness_dbfs, m.onset_rate, round((r.loud + r.onset) / 2, 4) AS energy,
        CASE WHEN round((r.loud + r.onset) / 2, 4) < 1.0 / 3 THEN 'low' WHEN round((r.loud + r.onset) / 2, 4) < 2.0 / 3 THEN 'medium' ELSE 'high' END AS band
        FROM v_labels0 l JOIN v_measures m USING (track_id) JOIN v_ranks r USING (track_id)""",
    "v_filters": values(FILTER_ROWS, "query_id, vocals, genre, mood, energy, tempo_min, tempo_max"),
    "v_verdicts": """SELECT query_id, track_id, greatest(
            CASE WHEN nullif(trim(f.vocals), '') IS NULL THEN 0 WHEN a.vocals IS NULL THEN 1 WHEN a.vocals = f.vocals THEN 0 ELSE 2 END,
            CASE WHEN f.genre IS NULL THEN 0 WHEN a.genre IS NULL THEN 1 WHEN a.genre = f.genre THEN 0 ELSE 2 END,
            CASE WHEN f.mood IS NULL THEN 0 WHEN len(moods) = 0 THEN 1 WHEN list_contains(moods, f.mood) THEN 0 ELSE 2 END,
            CASE WHEN f.energy IS NULL THEN 0 WHEN a.band = f.energy THEN 0 ELSE 2 END,
            CASE WHEN coalesce(tempo_min, tempo_max) IS NULL THEN 0 WHEN bpm IS NULL THEN 1 WHEN bpm >= coalesce(tempo_min, 0) AND bpm <= coalesce(tempo_max, 1e9) THEN 0 ELSE 2 END) AS code
        FROM v_filters f CROSS JOIN v_attributes a""",
    "v_feedback": """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, printf('trk-%06d', event_id % 500) AS track_id, 'q-' || (event_id % 10) AS query_id,
        CASE event_type WHEN 'purchase' THEN 'SAVE' WHEN 'error' THEN 'REJECT' WHEN 'click' THEN 'OPEN' WHEN 'view' THEN 'SKIP' ELSE event_type END AS action, ts AS created_at FROM events""",
    "v_items": """SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY line, track_id) - 1 AS INTEGER) AS position
        FROM (SELECT CAST(l_orderkey AS BIGINT) AS playlist_id, CAST(l_partkey AS BIGINT) AS track_id, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)""",
    "v_dataset": """SELECT CAST(p_partkey AS INTEGER) AS track_id, p_type AS genre_top, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS title, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS artist,
        CASE WHEN p_partkey % 3 = 0 THEN 'CC BY' END AS license, CASE WHEN p_partkey % 2 = 0 THEN 'small' ELSE 'medium' END AS subset, p_partkey % 5 <> 0 AS available FROM part""",
    "v_sampled": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genre_top ORDER BY track_id) AS n FROM v_dataset WHERE subset = 'small' AND available) WHERE n <= 5",
    "v_cosine": """SELECT query_id, track_id, lower(artist) AS artist_key, CAST(greatest(-1, least(1, list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[]))
        / (sqrt(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))) * sqrt(list_inner_product(CAST(c.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])))))) AS FLOAT) AS score
        FROM v_queries q CROSS JOIN v_catalog c""",
    "v_seed_cosine": """SELECT s.query_id, s.seed_id, c.track_id, lower(c.artist) AS artist_key, CAST(greatest(-1, least(1, list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[]))
        / (sqrt(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))) * sqrt(list_inner_product(CAST(c.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])))))) AS FLOAT) AS score
        FROM v_seeds s JOIN v_catalog q ON q.track_id = s.seed_id CROSS JOIN v_catalog c""",
}
_NEEDS = {
    "v_ranks": ["v_measures"], "v_attributes": ["v_labels0", "v_ranks"], "v_verdicts": ["v_filters", "v_attributes"], "v_sampled": ["v_dataset"],
    "v_cosine": ["v_queries", "v_catalog"], "v_seed_cosine": ["v_seeds", "v_catalog"],
}


def sql(body: str, *views: str) -> str:
    """A query over views of this module, as one statement."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in order) + "\n" + body
