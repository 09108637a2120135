"""Rows that name tracks, one by one and in batches cut anywhere; edits of long playlists; the feedback stream with repeats."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tunespark.functions import small
from tunespark.functions.tables import written
from tunespark.operators import interactions as J

SCHEMA = "row_id long, title string, artist string, provider_url string, provider_id string, album string"
STORED = "id string, title string, artist string, provider_url string, provider_id string, album string, created long"


def new_id(*parts):
    return "new-" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def one_by_one(rows, tracks, overwrite):
    """The rule on one row after the other: a list of tracks, searched from its start."""
    tracks, mapping = [dict(t) for t in tracks], {}
    tracks.sort(key=lambda t: (t["created"] is not None, t["created"] or 0, t["id"]))
    for r in sorted(rows, key=lambda r: r["row_id"]):
        if not r["title"] or not r["artist"]:
            mapping[r["row_id"]] = None
            continue
        keyed = r["provider_id"] is not None and r["provider_url"] is not None
        same = ("provider_id", "provider_url") if keyed else ("title", "artist", "provider_url")
        found = next((t for t in tracks if all(t[c] == r[c] for c in same)), None)
        own = {c: r[c] for c in ("title", "artist", "provider_url", "provider_id", "album")}
        if found is None:
            key = ("p", r["provider_id"], r["provider_url"]) if keyed else ("n", r["title"], r["artist"], r["provider_url"] or "\x1e")
            found = {"id": new_id(*key), "created": r["row_id"], **own}
            tracks.append(found)
        elif overwrite and keyed:
            found.update(own)
        mapping[r["row_id"]] = found["id"]
    return tracks, mapping


def feed(seed, n=140):
    r = random.Random(seed)
    url = lambda: r.choice([None, "https://a.b/1", "https://a.b/2"])
    rows = [{"row_id": i * 3, "title": r.choice(["T", "U", "V", ""] if r.random() < 0.3 else ["T", "U"]), "artist": "A", "provider_url": url(), "provider_id": r.choice([None, "1", "2", "3"]), "album": str(i)} for i in range(n)]
    stored = [{"id": "z-1", "title": "T", "artist": "A", "provider_url": "https://a.b/1", "provider_id": "2", "album": "s", "created": None}, {"id": "z-2", "title": "U", "artist": "A", "provider_url": None, "provider_id": None, "album": "s", "created": None}]
    return rows, stored


@pytest.mark.parametrize("overwrite", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_batches_cut_anywhere(spark, seed, overwrite):
    rows, stored = feed(seed)
    want_tracks, want = one_by_one(rows, stored, overwrite)
    step = J.upsert_tracks if overwrite else J.find_or_create_tracks
    r = random.Random(seed)
    for cuts in ([], sorted(r.sample(range(1, len(rows)), 2))):
        tracks, mapping = spark.createDataFrame([tuple(t[c] for c in ("id", "title", "artist", "provider_url", "provider_id", "album", "created")) for t in stored], STORED), {}
        tracks = J.normalize_track_identity(tracks).select("id", *J.IDENTITY, "created")
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            part = rows[a:b]
            random.Random(a).shuffle(part)
            batch = spark.createDataFrame([tuple(x.values()) for x in part], SCHEMA)
            tracks, got = step(batch, tracks)
            mapping |= {x["row_id"]: x["track_id"] for x in got.collect()}
            tracks = written(tracks, "tracks")
        assert mapping == want
        assert sorted((x["id"], x["title"], x["provider_url"], x["provider_id"], x["album"]) for x in tracks.collect()) == sorted((t["id"], t["title"], t["provider_url"], t["provider_id"], t["album"]) for t in want_tracks)


def test_provider_row_and_name_row_of_one_batch_meet(spark):
    none = J.normalize_track_identity(spark.createDataFrame([], STORED)).select("id", *J.IDENTITY)
    rows = [(1, "T", "A", "https://a.b/1", "9", "x"), (2, "T", "A", "https://a.b/1", None, "y")]
    for step in (J.find_or_create_tracks, J.upsert_tracks):
        tracks, mapping = step(spark.createDataFrame(rows, SCHEMA), none)
        assert len({x["track_id"] for x in mapping.collect()}) == 1 and tracks.count() == 1


def test_a_name_left_and_taken_on(spark):
    """A track under a provider key changes its name twice; rows that ask for the name find it only while it bears it."""
    none = J.normalize_track_identity(spark.createDataFrame([], STORED)).select("id", *J.IDENTITY)
    u = "https://a.b/1"
    rows = [(1, "T", "A", u, "9", ""), (2, "T", "A", u, None, ""), (3, "U", "A", u, "9", ""), (4, "U", "A", u, None, ""), (5, "T", "A", u, None, ""), (6, "T", "A", u, "9", ""), (7, "T", "A", u, None, ""), (8, "U", "A", u, None, "")]
    _, mapping = J.upsert_tracks(spark.createDataFrame(rows, SCHEMA), none)
    got = {x["row_id"]: x["track_id"] for x in mapping.collect()}
    assert got[1] == got[2] == got[3] == got[4] == got[6] == got[7] != got[5] and got[8] not in (got[1], got[5])


# ------------------------------------------------------------------------------------------------ long playlists


def test_counts_in_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice("aaaab"), i, r.choice([None, 1, 2]), r.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v int, t string").repartition(5)
    totals, last = defaultdict(int), {}
    want = {}
    for k, o, v, t in rows:
        want[o] = (totals[k], last.get(k))
        totals[k] += v or 0
        last[k] = t
    sums = {x["o"]: x["s"] for x in small.running_total(df, "k", "o", "v", "s").collect()}
    before = {x["o"]: x["p"] for x in small.previous_value(df, "k", "o", "t", "p").collect()}
    assert {o: (sums[o], before[o]) for o in want} == want


def test_edits_of_a_long_playlist_reach_many_tasks(spark):
    n = 20_000
    items = spark.range(n).select(F.lit(1).cast("long").alias("playlist_id"), F.col("id").alias("track_id"), F.col("id").cast("int").alias("position")).unionByName(
        spark.createDataFrame([(2, 5, 0), (2, 7, 1)], "playlist_id long, track_id long, position int"))
    removals = items.where("track_id % 3 = 0 and playlist_id = 1").select("playlist_id", "track_id")
    left, unknown = J.remove_tracks(items, removals.unionByName(spark.createDataFrame([(2, 99)], "playlist_id long, track_id long")))
    assert [tuple(x) for x in unknown.collect()] == [(2, 99)]
    by = left.where("playlist_id = 1").orderBy("position").collect()
    assert [x["position"] for x in by] == list(range(len(by))) and [x["track_id"] for x in by] == [i for i in range(n) if i % 3]
    assert sorted(tuple(x) for x in left.where("playlist_id = 2").collect()) == [(2, 5, 0), (2, 7, 1)]
    new = spark.range(0, 3000).select(F.lit(1).cast("long").alias("playlist_id"), (F.lit(2 * n) - F.col("id")).alias("track_id"), (F.col("id") / 2).cast("long").alias("seq"))
    grown = J.add_tracks(items, new).where("playlist_id = 1 and position >= 20000").orderBy("position").collect()
    want = [t for _, t in sorted((i // 2, 2 * n - i) for i in range(3000))]
    assert [x["track_id"] for x in grown] == want and [x["position"] for x in grown] == list(range(n, n + 3000))
    order = items.where("playlist_id = 1").select("playlist_id", "track_id", (F.lit(n - 1) - F.col("position")).alias("position"))
    turned, bad = J.reorder(items, order)
    assert bad.count() == 0 and turned.where("playlist_id = 1").where(F.col("position") != n - 1 - F.col("track_id")).count() == 0
    plan = small.running_total(items.withColumn("one", F.lit(1)), "playlist_id", "position", "one", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(playlist_id" in plan and "__range" in plan


# ------------------------------------------------------------------------------------------------ repeats in the stream


def test_an_event_delivered_again_lands_once(spark, tmp_path):
    from tunespark.streaming.feedback import feedback_stream

    schema = "row_id long, user_id string, query_id string, action string, created_at timestamp, title string, artist string, provider_url string, provider_id string"
    none = J.normalize_track_identity(spark.createDataFrame([], "id string, title string")).select("id", *J.IDENTITY)

    def deliver(name, ids):
        rows = [(i, "u", "q", "SAVE", f"T{i % 3}", "A", "https://a.b/1", "9" if i % 2 else None) for i in ids]
        df = spark.createDataFrame(rows, "row_id long, user_id string, query_id string, action string, title string, artist string, provider_url string, provider_id string")
        df.withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("row_id").cast("int"))).select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        feedback_stream(spark, source, lambda: none, f"{tmp_path}/out", f"{tmp_path}/ckpt", event_id="row_id").awaitTermination(200)

    deliver("a", [1, 2, 3, 3])
    deliver("b", [2, 4])
    run()
    deliver("c", [1, 4, 5, 6])
    run()
    accepted = spark.read.parquet(f"{tmp_path}/out/accepted")
    assert sorted(x["row_id"] for x in accepted.collect()) == [1, 2, 3, 4, 5, 6]
    rows = [{"row_id": i, "title": f"T{i % 3}", "artist": "A", "provider_url": "https://a.b/1", "provider_id": "9" if i % 2 else None, "album": None} for i in range(1, 7)]
    assert {x["row_id"]: x["track_id"] for x in accepted.collect()} == one_by_one(rows, [], False)[1]
