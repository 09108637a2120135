"""Interaction tables: track identities, feedback, playlists, as batch edits that give new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.small import running_total
from tunespark.operators.identity import IDENTITY, find_or_create_tracks, normalize_track_identity, safe_url, upsert_tracks  # noqa: F401

def split_feedback(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback rows with an action that is known, and the others with a reason; blank query ids become null."""
    own = events.withColumn("query_id", F.nullif("query_id", F.lit("")))
    known = F.coalesce(F.col("action").isin(*V.FEEDBACK_ACTIONS), F.lit(False))
    return own.where(known), own.where(~known).withColumn("reason", F.lit("unsupported action"))


def ingest_feedback(events: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events (row_id, user_id, query_id, action, created_at, identity columns) -> (accepted, rejected, tracks)."""
    known, unknown = split_feedback(events)
    stored, mapping = find_or_create_tracks(known, tracks)
    placed = known.select("row_id", "user_id", "query_id", "action", "created_at").join(mapping, "row_id")
    bad = placed.where("track_id is null").select("row_id", F.lit("incomplete track").alias("reason"))
    return placed.where("track_id is not null"), unknown.select("row_id", "reason").unionByName(bad), stored


def user_history(feedback: DataFrame, n: int) -> DataFrame:
    """The n latest events of each user with their place."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))
    return feedback.withColumn("place", place).where(F.col("place") <= n)


def track_actions(feedback: DataFrame) -> DataFrame:
    """(track_id, save, reject, open, skip): events of each action a track."""
    return feedback.groupBy("track_id").agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in V.FEEDBACK_ACTIONS])


def hide_rejected(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """results (user_id, query_id, track_id, ...) without tracks that the user rejected for that query."""
    gone = feedback.where("action = 'REJECT' and query_id is not null").select("user_id", "query_id", "track_id").distinct()
    return results.join(gone, ["user_id", "query_id", "track_id"], "left_anti")


def playlist_overview(playlists: DataFrame, items: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner_id, playlist_id, updated_at, tracks) of the owners' playlists, the latest update first; empty ones count 0."""
    own = playlists.join(owners.select("owner_id"), "owner_id", "left_semi")
    counts = items.groupBy("playlist_id").agg(F.count("*").alias("tracks"))
    out = own.join(counts, "playlist_id", "left").select("owner_id", "playlist_id", "updated_at", F.coalesce("tracks", F.lit(0)).alias("tracks"))
    return out.orderBy("owner_id", F.desc("updated_at"), "playlist_id")


def playlist_detail(requests: DataFrame, playlists: DataFrame, items: DataFrame, tracks: DataFrame) -> DataFrame:
    """requests (user_id, playlist_id) -> the tracks in order of position; only the owner sees a playlist."""
    seen = requests.join(playlists.select("playlist_id", F.col("owner_id").alias("user_id")), ["user_id", "playlist_id"])
    return seen.join(items, "playlist_id").join(tracks, "track_id").orderBy("user_id", "playlist_id", "position")


def add_tracks(items: DataFrame, additions: DataFrame) -> DataFrame:
    """items with additions (playlist_id, track_id, seq) appended in order of seq; tracks that are there already change nothing."""
    first = additions.groupBy("playlist_id", "track_id").agg(F.min("seq").alias("seq"))
    new = first.join(items, ["playlist_id", "track_id"], "left_anti")
    sizes = items.groupBy("playlist_id").agg(F.count("*").alias("size"))
    # tracks that come under one seq are told apart by track_id; how many come before is counted in ranges of seq
    ties = Window.partitionBy("playlist_id", "seq").orderBy("track_id")
    counts = running_total(new.groupBy("playlist_id", "seq").agg(F.count("*").alias("n")), "playlist_id", "seq", "n", "before").drop("n")
    placed = new.withColumn("tie", F.row_number().over(ties) - 1).join(counts, ["playlist_id", "seq"])
    added = placed.join(sizes, "playlist_id", "left").select("playlist_id", "track_id", (F.coalesce("size", F.lit(0)) + F.col("before") + F.col("tie")).cast("int").alias("position"))
    return items.select("playlist_id", "track_id", F.col("position").cast("int").alias("position")).unionByName(added)


def remove_tracks(items: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items without removals (playlist_id, track_id), later positions moved up; and the removals that match nothing."""
    gone = removals.select("playlist_id", "track_id").distinct()
    marked = items.join(gone.withColumn("__gone", F.lit(1)), ["playlist_id", "track_id"], "left")
    # playlists that nothing leaves stay as they are; in the others, the tracks that went before each are counted in ranges of positions
    changed = gone.select("playlist_id").distinct()
    moved = running_total(marked.join(changed, "playlist_id", "left_semi"), "playlist_id", "position", "__gone", "__before")
    moved = moved.where("__gone is null").withColumn("position", (F.col("position") - F.col("__before")).cast("int")).select("playlist_id", "track_id", "position")
    left = items.join(changed, "playlist_id", "left_anti").select("playlist_id", "track_id", F.col("position").cast("int").alias("position")).unionByName(moved)
    return left, gone.join(items, ["playlist_id", "track_id"], "left_anti")


def reorder(items: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items with the positions that orders ask for; and the orders refused.

    orders is (playlist_id, requested array) or, for playlists too long for a row, (playlist_id, track_id, position). An order must list each track of the
    playlist once: of another length it is incomplete, with repeated or foreign tracks invalid. Tracks are counted by playlist with partial sums and met by
    (playlist, track); no task holds a playlist.
    """
    if "requested" in orders.columns:
        lists = orders.select("playlist_id")
        asked = orders.select("playlist_id", F.posexplode("requested").alias("position", "track_id"))
    else:
        lists = orders.select("playlist_id")
        asked = orders.select("playlist_id", "position", "track_id")
    asked = asked.where("track_id is not null or position is not null")
    have = items.groupBy("playlist_id").agg(F.count("*").alias("have"))
    # one row a track that an order names, with how often and whether the playlist has it
    named = asked.groupBy("playlist_id", "track_id").agg(F.count("*").alias("times"), F.min("position").alias("new"))
    met = named.join(items.select("playlist_id", "track_id", F.lit(1).alias("hit")), ["playlist_id", "track_id"], "left")
    totals = met.groupBy("playlist_id").agg(F.sum("times").alias("asked"), F.count("*").alias("different"), F.count("hit").alias("hits"))
    judged = lists.distinct().join(totals, "playlist_id", "left").join(have, "playlist_id", "left").fillna(0, ["asked", "different", "hits", "have"])
    reason = F.when(F.col("asked") != F.col("have"), "incomplete").when((F.col("different") != F.col("asked")) | (F.col("hits") != F.col("have")), "invalid")
    judged = judged.select("playlist_id", reason.alias("reason"))
    new = named.join(judged.where("reason is null").select("playlist_id"), "playlist_id", "left_semi").select("playlist_id", "track_id", "new")
    out = items.join(new, ["playlist_id", "track_id"], "left").select("playlist_id", "track_id", F.coalesce("new", "position").cast("int").alias("position"))
    return out, judged.where("reason is not null")


def cascade_delete(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables (users, tracks, playlists, items, feedback) without deleted rows (users, tracks, playlists by id) and all that depends on them."""
    out = dict(tables)
    without = lambda name, column, ids: out[name].join(ids.toDF(column), column, "left_anti")
    if "users" in deleted:
        ids = deleted["users"].select("id")
        gone = out["playlists"].join(ids.toDF("owner_id"), "owner_id", "left_semi").select("playlist_id")
        out |= {"users": without("users", "id", ids), "feedback": without("feedback", "user_id", ids)}
        out |= {"items": without("items", "playlist_id", gone), "playlists": without("playlists", "owner_id", ids)}
    if "tracks" in deleted:
        ids = deleted["tracks"].select("id")
        out |= {"tracks": without("tracks", "id", ids), "items": without("items", "track_id", ids), "feedback": without("feedback", "track_id", ids)}
    if "playlists" in deleted:
        ids = deleted["playlists"].select("id")
        out |= {"playlists": without("playlists", "playlist_id", ids), "items": without("items", "playlist_id", ids)}
    return out
