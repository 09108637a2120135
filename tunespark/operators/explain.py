"""Explanations: what a query names, what speaks for a result, and the wording of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.operators.attributes import energy_band


def query_terms(query: Column | str) -> Column:
    """array of struct(term, attribute, value): attribute values that a query names, in its order, each once.

    A word is skipped when a negation stands within the three words before it.
    """
    text = F.regexp_replace(F.lower(query), r"\bhip[\s-]+hop\b", "hiphop")
    words = F.regexp_extract_all(text, F.lit("([a-z&]+)"), F.lit(1))
    table = F.map_from_arrays(F.array(*map(F.lit, V.QUERY_WORDS)), F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value")) for a, v in V.QUERY_WORDS.values()]))
    denied = F.array(*map(F.lit, V.NEGATIONS))

    def term(word: Column, i: Column) -> Column:
        before = F.slice(words, F.greatest(i - V.NEGATION_WINDOW, F.lit(0)) + 1, F.least(i, F.lit(V.NEGATION_WINDOW)))
        named = table[word]
        return F.when(named.isNotNull() & ~F.arrays_overlap(before, denied), F.struct(F.when(word == "hiphop", "hip hop").otherwise(word).alias("term"), named["attribute"].alias("attribute"), named["value"].alias("value")))

    found = F.array_compact(F.transform(words, term))
    value = lambda x: F.concat_ws("\n", x["attribute"], x["value"])
    values = F.transform(found, value)
    return F.filter(found, lambda x, i: F.array_position(values, value(x)) == i + 1)


def track_estimates() -> Column:
    """Known model estimates of a track; what is unknown is null."""
    return F.struct(F.col("vocals"), F.col("genre"), F.when(F.size("moods") > 0, F.col("moods")).alias("mood"))


def track_measurements() -> Column:
    return F.struct(F.col("bpm").alias("tempo_bpm"), F.when(F.col("energy").isNotNull(), F.struct(energy_band("energy").alias("band"), F.col("energy").alias("percentile"))).alias("energy"))


def shared_with_seed(seed_est: Column, seed_meas: Column, est: Column, meas: Column) -> Column:
    """struct(vocals, genre, mood, tempo_bpm, energy): what a result has in common with its seed; moods in the result's order."""
    moods = F.filter(est["mood"], lambda m: F.array_contains(seed_est["mood"], m))
    close = F.abs(seed_meas["tempo_bpm"] - meas["tempo_bpm"]) <= V.TEMPO_CLOSE * seed_meas["tempo_bpm"]
    return F.struct(
        F.when(seed_est["vocals"] == est["vocals"], est["vocals"]).alias("vocals"),
        F.when(seed_est["genre"] == est["genre"], est["genre"]).alias("genre"),
        F.when(F.size(moods) > 0, moods).alias("mood"),
        F.when(close, F.array(seed_meas["tempo_bpm"], meas["tempo_bpm"])).alias("tempo_bpm"),
        F.when(seed_meas["energy"]["band"] == meas["energy"]["band"], meas["energy"]["band"]).alias("energy"),
    )


def query_agreement(terms: Column, est: Column, passed: Column) -> Column:
    """The query's terms that a track's estimates agree with, without those that a passed filter states already."""
    agrees = lambda t: F.when(t["attribute"] == "mood", F.array_contains(est["mood"], t["value"])).when(t["attribute"] == "vocals", est["vocals"] == t["value"]).otherwise(est["genre"] == t["value"])
    stated = lambda t: F.exists(passed, lambda p: (p["attribute"] == t["attribute"]) & (p["value"] == t["value"]))
    return F.filter(terms, lambda t: F.coalesce(agrees(t), F.lit(False)) & ~F.coalesce(stated(t), F.lit(False)))


def with_evidence(results: DataFrame, attributes: DataFrame, verdicts: DataFrame | None = None, requests: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """results (query_id, track_id, score, rank) with what speaks for each one.

    Adds similarity, estimates, measured; filters_passed from verdicts; query and agreement from requests (query_id, query);
    seed_title and shared from seeds (query_id, seed_id, seed_title). What doesn't apply is null.
    """
    facts = attributes.select("track_id", track_estimates().alias("estimates"), track_measurements().alias("measured"))
    out = results.join(facts, "track_id", "left").withColumn("similarity", F.round(F.col("score").cast("double"), 4))
    if verdicts is not None:
        out = out.join(verdicts.select("query_id", "track_id", F.when(F.size("filters_passed") > 0, F.col("filters_passed")).alias("filters_passed")), ["query_id", "track_id"], "left")
    else:
        out = out.withColumn("filters_passed", F.lit(None).cast("array<struct<attribute:string,value:string,kind:string,measure:double,low:double,high:double>>"))
    if requests is not None:
        out = out.join(requests.select("query_id", "query"), "query_id", "left")
        agreed = query_agreement(query_terms("query"), F.col("estimates"), F.col("filters_passed"))
        out = out.withColumn("agreement", F.when(F.size(agreed) > 0, agreed))
    else:
        out = out.withColumn("query", F.lit(None).cast("string")).withColumn("agreement", F.lit(None).cast("array<struct<term:string,attribute:string,value:string>>"))
    if seeds is not None:
        own = seeds.join(facts.select(F.col("track_id").alias("seed_id"), F.col("estimates").alias("s_est"), F.col("measured").alias("s_meas")), "seed_id", "left")
        out = out.join(own.select("query_id", "seed_title", "s_est", "s_meas"), "query_id", "left")
        return out.withColumn("shared", shared_with_seed(F.col("s_est"), F.col("s_meas"), F.col("estimates"), F.col("measured"))).drop("s_est", "s_meas")
    return out.withColumn("seed_title", F.lit(None).cast("string")).withColumn("shared", F.lit(None).cast("struct<vocals:string,genre:string,mood:array<string>,tempo_bpm:array<double>,energy:string>"))


def plain_number(x: Column) -> Column:
    """A number without needless decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def whole_number(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint").cast("string")


def describe_filter(f: Column) -> Column:
    span = F.when(f["low"].isNotNull() & f["high"].isNotNull(), F.concat(plain_number(f["low"]), F.lit("-"), plain_number(f["high"]), F.lit(" BPM")))
    span = span.when(f["low"].isNotNull(), F.concat(F.lit("at least "), plain_number(f["low"]), F.lit(" BPM"))).otherwise(F.concat(F.lit("at most "), plain_number(f["high"]), F.lit(" BPM")))
    return (
        F.when(f["attribute"] == "tempo", F.concat(span, F.lit(" (measured "), whole_number(f["measure"]), F.lit(")")))
        .when(f["attribute"] == "energy", F.concat(f["value"], F.lit(" energy (measured)")))
        .when(f["attribute"] == "mood", F.concat(f["value"], F.lit(" mood (model estimate)")))
        .otherwise(F.concat(f["value"], F.lit(" (model estimate)")))
    )


def describe_term(t: Column) -> Column:
    quoted = F.concat(F.lit('"'), t["term"], F.lit('"'))
    return F.when(t["term"] == t["value"], quoted).otherwise(F.concat(quoted, F.lit(" ("), t["value"], F.lit(")")))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def _labels(x: Column) -> Column:
    return F.array_compact(F.array(x["vocals"], x["genre"], F.when(x["mood"].isNotNull(), F.array_join(x["mood"], ", "))))


def short_reason() -> Column:
    """One line for each row of with_evidence(): filters passed, else words agreed with, else what is shared with the seed, else the match alone."""
    by_query = F.col("query").isNotNull()
    anchor = F.when(by_query, F.concat(F.lit('closest sound match to "'), F.col("query"), F.lit('"'))).otherwise(F.concat(F.lit("sounds like "), F.col("seed_title")))
    filters = F.concat(F.array_join(F.transform("filters_passed", describe_filter), ", "), F.lit(" · "), anchor)
    terms = F.concat(F.lit("matches "), F.array_join(F.transform("agreement", describe_term), ", "), F.lit(" in your search (model estimate) · "), anchor)
    shared = F.col("shared")
    labels = _labels(shared)
    both = F.concat_ws(
        " · ", anchor, F.when(F.size(labels) > 0, F.concat(F.lit("both "), F.array_join(labels, ", "), F.lit(" (model estimates)"))),
        F.when(shared["tempo_bpm"].isNotNull(), F.lit("similar tempo")), F.when(shared["energy"].isNotNull(), F.concat(F.lit("both "), shared["energy"], F.lit(" energy"))),
    )
    line = F.when(F.col("filters_passed").isNotNull(), filters).when(F.col("agreement").isNotNull(), terms).when(shared.isNotNull() & ~by_query, both).otherwise(anchor)
    return capitalized(line)


def summarize() -> Column:
    """Lines of full wording for each row of with_evidence() that also has `of`, the number of candidates."""
    why = F.when(F.col("query").isNotNull(), F.concat(F.lit('closest sound match to "'), F.col("query"), F.lit('"'))).otherwise(F.concat(F.lit("sounds closest to "), F.col("seed_title")))
    why = F.concat(F.lit("Why: "), why, F.lit(" (rank "), F.col("rank").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(")"))
    why = F.concat(why, F.coalesce(F.concat(F.lit("; passed your filters: "), F.array_join(F.transform("filters_passed", describe_filter), ", ")), F.lit("")))
    agreed = F.concat(F.lit("Agrees with your search: "), F.array_join(F.transform("agreement", describe_term), ", "), F.lit(" (model estimate)"))
    shared, est, meas = F.col("shared"), F.col("estimates"), F.col("measured")
    tempo = F.concat(F.lit("similar tempo ("), whole_number(shared["tempo_bpm"][0]), F.lit(" vs "), whole_number(shared["tempo_bpm"][1]), F.lit(" BPM)"))
    common = F.array_compact(F.array(tempo, F.concat(shared["energy"], F.lit(" energy for this catalog"))))
    parts = F.array_compact(F.array(
        F.when(F.size(_labels(shared)) > 0, F.concat(F.array_join(_labels(shared), ", "), F.lit(" (model estimates)"))),
        F.when(F.size(common) > 0, F.concat(F.array_join(common, ", "), F.lit(" (measured)"))),
    ))
    own = F.array_compact(F.array(F.concat(whole_number(meas["tempo_bpm"]), F.lit(" BPM")), F.concat(meas["energy"]["band"], F.lit(" energy for this catalog"))))
    return F.array_compact(F.array(
        why, agreed,
        F.when(F.size(parts) > 0, F.concat(F.lit("Shared with seed: "), F.array_join(parts, " · "))),
        F.when(F.size(_labels(est)) > 0, F.concat(F.lit("Model estimates: "), F.array_join(_labels(est), " · "))),
        F.when(F.size(own) > 0, F.concat(F.lit("Measured: "), F.array_join(own, " · "))),
    ))
