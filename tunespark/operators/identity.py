"""Track identities in the order of their rows: a batch gives what its rows would give one by one, however the feed is cut into batches.

A row with a provider id and URL means the track of that key; any other row means the first created of the tracks that bear its title, artist and URL at that
moment. `created` is the row that made a track (null: before all rows). Finding rules are sets of least rows a key, joined; only where tracks get other names inside a batch
are rows of those names walked in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunespark.functions.small import previous_value
from tunespark.functions.tables import written

IDENTITY = ("title", "artist", "album", "cover_art_url", "preview_url", "provider_url", "provider_id", "duration_seconds", "source", "license")
LENGTHS = {"title": 160, "artist": 160, "album": 160, "provider_id": 180, "source": 120, "license": 160}
SEP, NONE = "\x1f", "\x1e"
#: Stands for the time before all rows.
BEFORE = -(1 << 62)
OFF, ON, ASK = 0, 1, 2


def safe_url(url: Column | str) -> Column:
    """The URL if it is an http or https one, else null."""
    url = F.col(url) if isinstance(url, str) else url
    good = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != "")
    return F.when(good, url)


def normalize_track_identity(df: DataFrame) -> DataFrame:
    """df with its identity columns clipped and checked; columns that are absent become null, others stay."""
    have = set(df.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    new = {c: F.substring(F.coalesce(text(c), F.lit("")), 1, LENGTHS[c]) for c in ("title", "artist")}
    new |= {c: F.nullif(F.substring(text(c), 1, LENGTHS[c]), F.lit("")) for c in ("album", "provider_id", "source", "license")}
    new |= {c: safe_url(text(c)) for c in ("cover_art_url", "preview_url", "provider_url")}
    seconds = text("duration_seconds")
    new["duration_seconds"] = F.when(seconds.rlike(r"^-?\d+(\.0+)?$"), seconds.cast("double").cast("int"))
    return df.withColumns(new)


def provider_key() -> Column:
    return F.when(F.col("provider_id").isNotNull() & F.col("provider_url").isNotNull(), F.concat(F.lit("p" + SEP), "provider_id", F.lit(SEP), "provider_url"))


def name_key() -> Column:
    return F.concat(F.lit("n" + SEP), "title", F.lit(SEP), "artist", F.lit(SEP), F.coalesce("provider_url", F.lit(NONE)))


def new_id(key: Column | str) -> Column:
    return F.concat(F.lit("new-"), F.substring(F.sha2(key, 256), 1, 16))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"pkey": provider_key(), "nkey": name_key()})


def _stored(tracks: DataFrame) -> DataFrame:
    created = F.col("created").cast("bigint") if "created" in tracks.columns else F.lit(None).cast("bigint")
    return _keyed(tracks.select("id", *IDENTITY, created.alias("created"))).withColumn("first", F.struct(F.coalesce("created", F.lit(BEFORE)).alias("created"), "id"))


def _rows(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that name a track, and the others; the row_id orders them."""
    own = _keyed(normalize_track_identity(incoming))
    good = (F.col("title") != "") & (F.col("artist") != "")
    return own.where(good), own.where(~good)


def _mapping(named: DataFrame, bad: DataFrame) -> DataFrame:
    return named.select("row_id", "track_id").unionByName(bad.select("row_id", F.lit(None).cast("string").alias("track_id")))


def _tracks(rows: DataFrame, content: str) -> DataFrame:
    return rows.select(F.col("track_id").alias("id"), *[F.col(f"{content}.{c}").alias(c) for c in IDENTITY], F.col("created"))


def find_or_create_tracks(incoming: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks with new ones added, mapping (row_id, track_id or null)); stored rows stay as they are.

    A provider key makes a track with its first row. A name that no stored track bears belongs to what bears it first: a track made under a provider key, or
    one made by the first row that asks for the name.
    """
    good, bad = _rows(incoming)
    stored = _stored(tracks)
    content = F.struct("row_id", "nkey", *IDENTITY)
    by_provider = stored.where("pkey is not null").groupBy("pkey").agg(F.min("first.id").alias("old"))
    providers = good.where("pkey is not null").groupBy("pkey").agg(F.min_by(content, "row_id").alias("at")).join(by_provider, "pkey", "left").withColumn("track_id", F.coalesce("old", new_id("pkey")))
    made = providers.where("old is null")
    born = made.groupBy(F.col("at.nkey").alias("nkey")).agg(F.min(F.struct(F.col("at.row_id").alias("row_id"), "track_id")).alias("born"))
    by_name = stored.groupBy("nkey").agg(F.min("first").alias("old"))
    names = good.where("pkey is null").groupBy("nkey").agg(F.min_by(content, "row_id").alias("at")).join(by_name, "nkey", "left").join(born, "nkey", "left")
    earlier = F.when(F.col("born.row_id") < F.col("at.row_id"), F.col("born.track_id"))
    names = names.withColumn("track_id", F.coalesce("old.id", earlier, new_id("nkey")))
    new = made.select("track_id", "at").unionByName(names.where(F.col("old").isNull() & earlier.isNull()).select("track_id", "at")).withColumn("created", F.col("at.row_id"))
    named = good.where("pkey is not null").join(providers.select("pkey", "track_id"), "pkey").select("row_id", "track_id")
    named = named.unionByName(good.where("pkey is null").join(names.select("nkey", "track_id"), "nkey").select("row_id", "track_id"))
    return stored.select("id", *IDENTITY, "created").unionByName(_tracks(new, "at")), _mapping(named, bad)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (nkey, at, kind): tracks that take a name on or leave it, and rows that ask for it; the track of each row that asks, and whether it is made by it.

    Only tracks that bear the present name are held.
    """
    now, bearing, heap = None, set(), []
    for batch in batches:
        out = []
        for name, at, kind, created, id_ in zip(*(batch.column(c).to_pylist() for c in ("nkey", "at", "kind", "created", "id"))):
            if name != now:
                now, bearing, heap = name, set(), []
            if kind == ON:
                bearing.add(id_)
                heappush(heap, (created, id_))
            elif kind == OFF:
                bearing.discard(id_)
            else:
                while heap and heap[0][1] not in bearing:
                    heappop(heap)
                made = not heap
                if made:
                    own = "new-" + hashlib.sha256(name.encode()).hexdigest()[:16]
                    bearing.add(own)
                    heappush(heap, (at, own))
                out.append((at, heap[0][1], made))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.bool_()))], names=["row_id", "track_id", "made"])


def upsert_tracks(incoming: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As find_or_create_tracks(), but each row that comes under a provider key overwrites its track, so that tracks change their names between rows.

    Keys, changes of names and answers are written to the shared folder. Names that no track takes on or leaves in the batch are settled by joins. Rows of the others are walked in order, sorted by name, with the tracks that bear the name held.
    """
    good, bad = _rows(incoming)
    good = good.withColumn("row_id", F.col("row_id").cast("bigint"))
    stored = _stored(tracks)
    writes, asked = good.where("pkey is not null"), good.where("pkey is null")
    old = stored.where("pkey is not null").groupBy("pkey").agg(F.min_by(F.struct("id", "created", "nkey"), "id").alias("old"))
    content = F.struct(*IDENTITY)
    touched = writes.groupBy("pkey").agg(F.min("row_id").alias("first_row"), F.max_by(content, "row_id").alias("at"), F.min("nkey").alias("low"), F.max("nkey").alias("high"), F.min_by("nkey", "row_id").alias("first_name")).join(old, "pkey", "left")
    touched = touched.select("pkey", "at", "first_row", "first_name", F.coalesce("old.id", new_id("pkey")).alias("track_id"), F.when(F.col("old").isNull(), F.col("first_row")).otherwise(F.col("old.created")).alias("created"),
                             (F.least("low", "old.nkey") != F.greatest("high", "old.nkey")).alias("renamed"), F.col("old.nkey").alias("old_name"))
    touched = written(touched, "touched")
    who = [F.coalesce("created", F.lit(BEFORE)).alias("created"), F.col("track_id").alias("id")]
    steady = touched.where("not renamed and old_name is null").select(F.col("first_name").alias("nkey"), F.col("first_row").alias("at"), F.lit(ON).alias("kind"), *who)
    changes = previous_value(writes.join(touched.where("renamed").select("pkey", "track_id", "created", "old_name"), "pkey"), "pkey", "row_id", "nkey", "before").withColumn("before", F.coalesce("before", "old_name"))
    changes = changes.where(~F.col("nkey").eqNullSafe(F.col("before")))
    on = changes.select("nkey", F.col("row_id").alias("at"), F.lit(ON).alias("kind"), *who)
    off = changes.where("before is not null").select(F.col("before").alias("nkey"), F.col("row_id").alias("at"), F.lit(OFF).alias("kind"), *who)
    events = written(steady.unionByName(on).unionByName(off), "names")
    contested = events.select("nkey").distinct()
    # names that nobody takes on or leaves
    by_name = stored.groupBy("nkey").agg(F.min("first").alias("old"))
    calm = asked.join(contested, "nkey", "left_anti")
    settled = calm.groupBy("nkey").agg(F.min("row_id").alias("first_row"), F.min_by(content, "row_id").alias("at")).join(by_name, "nkey", "left").withColumn("track_id", F.coalesce("old.id", new_id("nkey")))
    # the others, in order
    bearers = stored.join(contested, "nkey", "left_semi").select("nkey", F.lit(BEFORE).alias("at"), F.lit(ON).alias("kind"), F.col("first.created").alias("created"), "id")
    asks = asked.join(contested, "nkey", "left_semi").select("nkey", F.col("row_id").alias("at"), F.lit(ASK).alias("kind"), F.lit(None).cast("bigint").alias("created"), F.lit(None).cast("string").alias("id"))
    walk = events.unionByName(bearers).unionByName(asks).repartition("nkey").sortWithinPartitions("nkey", "at", "kind")
    answers = written(walk.mapInArrow(_answers, "row_id bigint, track_id string, made boolean"), "answers")
    named = writes.join(touched.select("pkey", "track_id"), "pkey").select("row_id", "track_id").unionByName(calm.join(settled.select("nkey", "track_id"), "nkey").select("row_id", "track_id")).unionByName(answers.select("row_id", "track_id"))
    made = asked.select("row_id", content.alias("at")).join(answers.where("made"), "row_id").select("track_id", "at", F.col("row_id").alias("created"))
    made = made.unionByName(settled.where("old is null").select("track_id", "at", F.col("first_row").alias("created")))
    kept = stored.select("id", *IDENTITY, "created").join(touched.select(F.col("track_id").alias("id")), "id", "left_anti")
    return kept.unionByName(_tracks(touched, "at")).unionByName(_tracks(made, "at")), _mapping(named, bad)
