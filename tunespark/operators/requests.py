"""Batches of recommendation requests: checks and routing, filtered retrieval with evidence, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.tables import written
from tunespark.operators import explain, ranking, tiles
from tunespark.operators.filters import FILTERS, cleaned, filter_errors, passed_filters
from tunespark.operators.vectors import TunesparkError, require_same_space


def route(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with `mode` search, similar or blend, rejected (query_id, error)). Columns: query_id, query, seed_id, k and the filters."""
    own = requests.withColumn("query", F.nullif(F.trim("query"), F.lit(""))).withColumn("seed_id", F.nullif(F.trim("seed_id"), F.lit("")))
    error = (
        F.when(F.col("query").isNull() & F.col("seed_id").isNull(), "no query and no seed")
        .when(F.length("query") > V.MAX_QUERY_CHARS, "query too long")
        .when(~F.coalesce("k", F.lit(V.DEFAULT_K)).between(1, V.MAX_K), "k out of range")
    )
    mode = F.when(F.col("seed_id").isNull(), "search").when(F.col("query").isNull(), "similar").otherwise("blend")
    judged = own.withColumn("mode", mode).withColumn("__error", error)
    bad = judged.where("__error is not null").select("query_id", F.col("__error").alias("error")).unionByName(filter_errors(requests))
    first = bad.groupBy("query_id").agg(F.min("error").alias("error"))
    return judged.drop("__error").join(first.select("query_id"), "query_id", "left_anti"), first


def _attributes_for(requests: DataFrame, attributes: DataFrame | None) -> DataFrame | None:
    """attributes, which filters need."""
    if attributes is None and not cleaned(requests).where(F.coalesce(*[F.col(c).cast("string") for c in FILTERS]).isNotNull()).isEmpty():
        raise TunesparkError("filters can't be applied without attributes")
    return attributes


def _hits(asked: DataFrame, catalog: DataFrame, attributes: DataFrame | None, paths: tuple[str, ...], k: int, max_per_artist: int | None) -> tuple[DataFrame, DataFrame]:
    """(ranked rows with `of`, counts a request) of requests with their vectors: one pass over the tiles, whose few rows are written."""
    hits = written(tiles.top_k(asked, catalog, k, paths, _attributes_for(asked, attributes), None, max_per_artist), "hits")
    counts = tiles.counted(hits)
    limits = asked.select("query_id", F.least(F.coalesce("k", F.lit(V.DEFAULT_K)), F.lit(k)).alias("__k"))
    rows = tiles.ranked(hits, k, max_per_artist).join(limits, "query_id").where(F.col("rank") <= F.col("__k")).drop("__k", "artist_key")
    return rows.join(counts.select("query_id", "of"), "query_id"), counts.select("query_id", "hidden_mismatch", "hidden_unknown")


def _evidence(rows: DataFrame, requests: DataFrame, attributes: DataFrame | None, by_query: bool, titled: DataFrame | None) -> DataFrame:
    """rows (query_id, track_id, score, rank, ...) with what speaks for each one; all of it is worked out for these rows alone."""
    if attributes is None:
        nothing = rows.sparkSession.createDataFrame([], "track_id string, vocals string, genre string, moods array<string>, bpm double, energy double")
        return explain.with_evidence(rows, nothing, None, requests if by_query else None, titled)
    return explain.with_evidence(rows, attributes, passed_filters(rows, requests, attributes), requests if by_query else None, titled)


def _titled(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    return requests.select("query_id", "seed_id").join(catalog.select(F.col("track_id").alias("seed_id"), F.col("title").alias("seed_title")), "seed_id")


def explained_search(requests: DataFrame, query_vectors: DataFrame, catalog: DataFrame, attributes: DataFrame | None, k: int = V.MAX_K, max_per_artist: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results with evidence and `of`, hidden counts) of text requests: filters act on a tile before its scores are worked out.

    `of` counts the tracks that could be ranked: those with a usable vector that pass the filters.
    """
    asked = requests.join(query_vectors.select("query_id", F.col("vector").alias("q_vector")), "query_id").withColumn("seed_id", F.lit(None).cast("string"))
    rows, hidden = _hits(asked, catalog, attributes, ("q_vector",), k, max_per_artist)
    return _evidence(rows, requests, attributes, True, None), hidden


def explained_similar(requests: DataFrame, catalog: DataFrame, attributes: DataFrame | None, k: int = V.MAX_K, max_per_artist: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results with evidence and `of`, hidden counts) of seed requests; the seed itself is neither a candidate nor hidden."""
    asked = requests.join(ranking.seed_vectors(requests, catalog).select("query_id", F.col("vector").alias("s_vector")), "query_id")
    rows, hidden = _hits(asked, catalog, attributes, ("s_vector",), k, max_per_artist)
    return _evidence(rows, requests, attributes, False, _titled(requests, catalog)), hidden


def explained_blend(requests: DataFrame, query_vectors: DataFrame, catalog: DataFrame, attributes: DataFrame | None, k: int = V.MAX_K, max_per_artist: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results with both paths' evidence, the way they are blended, and `why`, hidden counts) of requests with a text and a seed.

    Three passes over the tiles: statistics of either path, the best tracks, and the chosen tracks' ranks on either path.
    """
    vectors = ranking.blend_requests(query_vectors.join(requests.select("query_id"), "query_id", "left_semi"), requests, catalog).drop("seed_id")
    asked = written(requests.join(vectors, "query_id"), "blends")
    rows, hidden = _hits(asked, catalog, attributes, ("q_vector", "s_vector"), k, max_per_artist)
    rows = written(rows, "blended")
    ranks = tiles.path_ranks(rows, asked, catalog, _attributes_for(asked, attributes))
    out = blend_evidence(rows.join(ranks, ["query_id", "track_id"]), requests, catalog, attributes)
    how = F.struct(F.lit("sum of z-scored cosines").alias("method"), F.array(F.lit(1), F.lit(1)).alias("weights"))
    return out.withColumn("blend", how), hidden


def blend_evidence(paths: DataFrame, requests: DataFrame, catalog: DataFrame, attributes: DataFrame | None) -> DataFrame:
    """Rows of explain_blend() with `query_evidence` and `seed_evidence`, what speaks for the track on either path, and `why`: both reasons in one line.

    The second reason begins with a small letter. requests: query_id, query, seed_id and the filters. All of it is worked out for the chosen rows alone.
    """
    own = None
    for path, by_query, titled in (("query", True, None), ("seed", False, _titled(requests, catalog))):
        rows = paths.select("query_id", "track_id", F.col(f"{path}_cosine").alias("score"), F.col(f"{path}_rank").alias("rank"))
        known = _evidence(rows, requests, attributes, by_query, titled)
        facts = F.struct("rank", "similarity", "filters_passed", "estimates", "measured", "agreement", "shared")
        part = known.select("query_id", "track_id", facts.alias(f"{path}_evidence"), explain.short_reason().alias(f"{path}_why"))
        own = part if own is None else own.join(part, ["query_id", "track_id"])
    second = F.concat(F.lower(F.substring("seed_why", 1, 1)), F.substring(F.col("seed_why"), 2, 1 << 30))
    return paths.join(own, ["query_id", "track_id"]).withColumn("why", F.concat_ws(" · ", "query_why", second)).drop("query_why", "seed_why")


def explain_blend(ranked: DataFrame, query_vectors: DataFrame, requests: DataFrame, catalog: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """ranked blend rows with each path's cosine and its rank on that path over all candidates, without the artist cap.

    The query path's rank counts the seed, the seed path's doesn't. A path's rank is one more than the candidates before it, counted in tiles for the chosen rows alone.
    """
    own = ranked.select("query_id", "track_id", "rank", "query_cosine", "seed_cosine")
    asked = requests.join(ranking.blend_requests(query_vectors, requests, catalog).drop("seed_id"), "query_id")
    ranks = tiles.path_ranks(own, asked, catalog, attributes)
    return own.join(ranks, ["query_id", "track_id"]).select("query_id", "track_id", "rank", "query_cosine", "query_rank", "seed_cosine", "seed_rank")


def unanswerable(requests: DataFrame, query_vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, error) of routed requests that can't be answered: by their seed, else by their text's vector. An `error` of query_vectors is handed on."""
    sizes = ranking.dimensions(catalog)
    if len(sizes) > 1:
        raise TunesparkError("the catalog holds vectors of different dimensions")
    size = sizes[0] if sizes else None
    seeded = requests.where("seed_id is not null").select("query_id", "seed_id")
    lost = ranking.unknown_seeds(seeded, catalog).select("query_id", F.lit("unknown seed").alias("error"))
    useless = ranking.unusable_vectors(ranking.seed_vectors(seeded, catalog), "query_id", size).select("query_id", F.concat(F.lit("seed with "), "error").alias("error"))
    texts = requests.where("query is not null").select("query_id")
    given = "error" if "error" in query_vectors.columns else None
    known = query_vectors.select("query_id", "vector", (F.col(given) if given else F.lit(None).cast("string")).alias("given"))
    judged = texts.join(known, "query_id", "left").join(ranking.unusable_vectors(known, "query_id", size), "query_id", "left")
    failed = judged.select("query_id", F.coalesce("given", F.when(F.col("vector").isNull(), "no vector of the query").otherwise(F.concat(F.lit("query with "), "error"))).alias("error")).where("error is not null")
    first = lost.withColumn("o", F.lit(0)).unionByName(useless.withColumn("o", F.lit(1))).unionByName(failed.withColumn("o", F.lit(2)))
    return first.groupBy("query_id").agg(F.min_by("error", "o").alias("error"))


def recommend(requests: DataFrame, query_vectors: DataFrame, catalog: DataFrame, attributes: DataFrame | None = None, max_per_artist: int | None = V.ARTIST_CAP) -> tuple[DataFrame, DataFrame]:
    """(results of all requests by their mode, rejected requests with an error): every request is either answered or rejected.

    Results carry query_id, mode, track_id, rank, score, the paths' cosines, `of`, evidence (of a blend both paths' and the way of blending), `why`, and what the request's filters hid.
    query_vectors: query_id, vector of each text, and perhaps an error, as embed_texts() gives them. A request whose filters leave no track is a row with a null track_id, so that its hidden counts stay.
    """
    if "space_fingerprint" in query_vectors.columns and "space_fingerprint" in catalog.columns:
        require_same_space(query_vectors, catalog)
    good, bad = route(requests)
    good, bad = written(good, "routed"), written(bad, "rejected")
    lost = written(unanswerable(good, query_vectors, catalog), "unanswerable")
    good = good.join(lost, "query_id", "left_anti")
    by = {m: good.where(F.col("mode") == m) for m in ("search", "similar", "blend")}
    sound = query_vectors.where("vector is not null").select("query_id", "vector")
    parts = {
        "search": explained_search(by["search"], sound, catalog, attributes, V.MAX_K, max_per_artist),
        "similar": explained_similar(by["similar"], catalog, attributes, V.MAX_K, max_per_artist),
        "blend": explained_blend(by["blend"], sound, catalog, attributes, V.MAX_K, max_per_artist),
    }
    rows = None
    for mode, (found, hidden) in parts.items():
        if mode != "blend":
            found = found.withColumn("why", explain.short_reason())
        found = by[mode].select("query_id").join(found, "query_id", "left").join(hidden, "query_id", "left").withColumn("mode", F.lit(mode))
        found = found.drop("query", "seed_title").na.fill(0, ["hidden_mismatch", "hidden_unknown"])
        rows = found if rows is None else rows.unionByName(found, allowMissingColumns=True)
    return rows, bad.unionByName(lost)


def respond(requests: DataFrame, query_vectors: DataFrame, catalog: DataFrame, attributes: DataFrame | None = None, max_per_artist: int | None = V.ARTIST_CAP) -> tuple[DataFrame, DataFrame]:
    """(one response a request: mode, its results in order, what filters hid; the rejected requests)."""
    rows, bad = recommend(requests, query_vectors, catalog, attributes, max_per_artist)
    rows = written(rows, "results")
    hidden = rows.select("query_id", "mode", "hidden_mismatch", "hidden_unknown").distinct()
    answers = to_responses(rows.where("track_id is not null"), catalog).drop("mode")
    return hidden.join(answers, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast(answers.schema["results"].dataType))), bad


def to_responses(results: DataFrame, catalog: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """One row a request: its results in order as structs, and what filters hid.

    results: rows of with_evidence() or of a blend, with `mode` where modes are mixed; catalog: the tracks, with source, license and preview_url where known. What isn't there is null.
    """
    known = [c for c in ("provider_url", "source", "license", "preview_url") if c in catalog.columns]
    rows = results.join(catalog.select("track_id", "title", "artist", *known), "track_id")
    text = lambda c: F.col(c) if c in known else F.lit(None).cast("string").alias(c)
    number = lambda c: (F.round(F.col(c).cast("double"), 4) if c in results.columns else F.lit(None).cast("double")).alias(c.removesuffix("_cosine"))
    why = F.col("why") if "why" in results.columns else explain.short_reason() if "estimates" in results.columns else F.lit(None).cast("string")
    evidence = [c for c in ("filters_passed", "estimates", "measured", "agreement", "shared", "query_evidence", "seed_evidence", "blend") if c in results.columns]
    item = F.struct(
        "rank", "track_id", "title", "artist", text("provider_url"), text("preview_url"), text("source"), text("license"), F.round(F.col("score").cast("double"), 4).alias("score"),
        F.struct(number("query_cosine"), number("seed_cosine")).alias("similarities"), why.alias("why"), *([F.struct(*evidence).alias("evidence")] if evidence else []),
    )
    by = ["query_id", "mode"] if "mode" in results.columns else ["query_id"]
    # a request has few results; they are put in order by their rank, which no two of them share
    out = rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.to_json(item, {"ignoreNullFields": "false"}).alias("item")))), lambda x: x["item"]).alias("results"))
    out = out.withColumn("results", F.transform("results", lambda x: F.from_json(x, rows.select(item.alias("i")).schema["i"].dataType)))
    return out if hidden is None else out.join(hidden, "query_id", "left").na.fill(0, ["hidden_mismatch", "hidden_unknown"])
