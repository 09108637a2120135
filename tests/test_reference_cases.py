"""Hand-worked cases on small frames."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.functions.vectors import cosine
from tunespark.jobs import index as I
from tunespark.operators import attributes as A
from tunespark.operators import evaluation as E
from tunespark.operators import explain as G
from tunespark.operators import filters as L
from tunespark.operators import interactions as J
from tunespark.operators import ranking as R
from tunespark.operators import requests as Q
from tunespark.operators import signal as C
from tunespark.operators import tiles
from tunespark.operators.vectors import EmbeddingSpace, TunesparkError, l2_normalize, require_same_space, vector_problems
from tunespark.sources import dataset as D
from tunespark.sources import manifest as M

H = math.sqrt(0.5)
SPACE = EmbeddingSpace("m", "1", 4, 48_000, 10.0, 3)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("a", "A", "Artist One", [1.0, 0.0, 0.0, 0.0]), ("b", "B", "Artist Two", [0.0, 1.0, 0.0, 0.0]), ("c", "C", "Artist One", [H, H, 0.0, 0.0]), ("d", "D", "Artist Three", [-1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "track_id string, title string, artist string, vector array<float>")
    return df.withColumn("provider_url", F.lit(None).cast("string")).withColumn("space_fingerprint", F.lit(SPACE.fingerprint()))


def ranked(df):
    return [r["track_id"] for r in df.orderBy("rank").collect()]


def one_query(spark, vector):
    return spark.createDataFrame([("q", vector)], "query_id string, vector array<float>")


def test_search_order_and_cap(spark, catalog):
    q = one_query(spark, [1.0, 0.0, 0.0, 0.0])
    rows = R.search(q, catalog).orderBy("rank").collect()
    assert [(r["track_id"], round(r["score"], 4)) for r in rows] == [("a", 1.0), ("c", 0.7071), ("b", 0.0), ("d", -1.0)]
    assert ranked(R.search(q, catalog, max_per_artist=1)) == ["a", "b", "d"]
    with pytest.raises(TunesparkError):
        R.search(q, catalog, 0)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ties_by_id_for_any_partitioning(spark, parts):
    rows = [(i, i, "x", [1.0, 2.0, 0.0, 0.0]) for i in ("zulu", "alpha", "mike")]
    tied = spark.createDataFrame(rows, "track_id string, title string, artist string, vector array<float>").repartition(parts)
    assert ranked(R.search(one_query(spark, [1.0, 0.0, 0.0, 0.0]), tied)) == ["alpha", "mike", "zulu"]


def test_seed_excluded_and_unknown(spark, catalog):
    seeds = spark.createDataFrame([("s", "a"), ("t", "zz")], "query_id string, seed_id string")
    found, unknown = R.similar_to(seeds, catalog)
    assert ranked(found) == ["c", "b", "d"]
    assert [r["seed_id"] for r in unknown.collect()] == ["zz"]


def test_blend(spark, catalog):
    seeds = spark.createDataFrame([("q", "b")], "query_id string, seed_id string")
    rows = R.blend(one_query(spark, [1.0, 0.0, 0.0, 0.0]), seeds, catalog)
    assert ranked(rows) == ["c", "a", "d"]
    top = rows.orderBy("rank").first()
    assert round(top["query_cosine"], 4) == round(top["seed_cosine"], 4) == 0.7071
    scores = {r["track_id"]: r["score"] for r in R.blend_scores(one_query(spark, [1.0, 0.0, 0.0, 0.0]), seeds, catalog).collect()}
    assert all(abs(scores[r["track_id"]] - r["score"]) < 1e-9 for r in rows.collect())
    paths = {r["track_id"]: (r["query_rank"], r["seed_rank"]) for r in Q.explain_blend(rows, one_query(spark, [1.0, 0.0, 0.0, 0.0]), seeds, catalog).collect()}
    assert paths == {"c": (2, 1), "a": (1, 2), "d": (4, 3)}


def test_vectors_that_cannot_be_compared_have_no_score(spark, catalog):
    odd = spark.createDataFrame([("n", "N", "x", [float("nan"), 1.0, 0.0, 0.0]), ("z", "Z", "x", [0.0] * 4), ("m", "M", "x", None), ("i", "I", "x", [float("inf"), 0.0, 0.0, 0.0])], "track_id string, title string, artist string, vector array<float>")
    more = catalog.drop("provider_url", "space_fingerprint").unionByName(odd)
    assert ranked(R.search(one_query(spark, [1.0, 0.0, 0.0, 0.0]), more)) == ["a", "c", "b", "d"]
    assert {r["track_id"] for r in R.unusable_vectors(more, "track_id").collect()} == {"n", "z", "m", "i"}
    assert R.search(one_query(spark, [0.0] * 4), more).count() == 0
    assert {r["seed_id"] for r in R.all_neighbours(more, 2).collect()} == set("abcd")
    with pytest.raises(TunesparkError):
        R.search(one_query(spark, [1.0, 0.0, 0.0, 0.0]).withColumn("space_fingerprint", F.lit("other")), catalog)


def test_blend_evidence(spark, catalog, attributes):
    req = requests(spark, query_id="q", query="calm jazz", seed_id="b")
    vector = one_query(spark, [1.0, 0.0, 0.0, 0.0])
    rows = R.blend(vector, req.select("query_id", "seed_id"), catalog)
    out = Q.blend_evidence(Q.explain_blend(rows, vector, req.select("query_id", "seed_id"), catalog), req, catalog, attributes)
    got = {r["track_id"]: r for r in out.collect()}
    assert set(got) == {"a", "c", "d"} and got["a"]["query_evidence"]["rank"] == 1 and got["a"]["seed_evidence"]["rank"] == 2
    assert got["a"]["why"].startswith('Matches "calm", "jazz" in your search (model estimate) · closest sound match to "calm jazz" · sounds like B')
    answer = Q.to_responses(out.join(rows.select("query_id", "track_id", "score"), ["query_id", "track_id"]).withColumn("mode", F.lit("blend")), catalog.withColumn("license", F.lit("CC BY"))).first()
    first = answer["results"][0]
    assert [x["track_id"] for x in answer["results"]] == ["c", "a", "d"] and answer["mode"] == "blend" and first["license"] == "CC BY"
    assert first["similarities"].asDict() == {"query": 0.7071, "seed": 0.7071} and first["evidence"]["seed_evidence"]["rank"] == 1 and first["preview_url"] is None


def test_filters_without_attributes_are_refused(spark, catalog):
    asked = requests(spark, query_id="q", query="x", vocals="instrumental")
    for refused in (lambda: Q.explained_search(asked, one_query(spark, [1.0, 0.0, 0.0, 0.0]), catalog, None), lambda: Q.recommend(asked, one_query(spark, [1.0, 0.0, 0.0, 0.0]), catalog)):
        with pytest.raises(TunesparkError):
            refused()
    blank = requests(spark, query_id="q", query="x", vocals=" ")
    assert Q.explained_search(blank, one_query(spark, [1.0, 0.0, 0.0, 0.0]), catalog, None)[0].count() == 4


def test_the_tempo_gate_sees_the_unrounded_clarity(spark):
    df = spark.createDataFrame([(120.04, 0.2496), (120.04, 0.25), (120.04, 0.24999)], "bpm double, clarity double")
    assert [r["b"] for r in df.select(C.gated_bpm("bpm", "clarity").alias("b")).collect()] == [None, 120.0, None]
    wave = spark.createDataFrame([([math.sin(i) + 0.3 * math.sin(2.7 * i) for i in range(400)], 43.07)], "e array<double>, f double")
    clarity = wave.select(C.pulse_clarity("e", "f")).first()[0]
    assert clarity != round(clarity, 4)


def test_neighbours_agree_with_scores(spark, catalog):
    near = {(r["seed_id"], r["track_id"], r["rank"]) for r in R.all_neighbours(catalog, 2, block=2).collect()}
    assert {("a", "c", 1), ("a", "b", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2)} <= near


def test_mmr(spark):
    rows = [("a1", [1.0, 0.0, 0.0, 0.0]), ("a2", [0.999, 0.01, 0.0, 0.0]), ("a3", [0.998, 0.02, 0.0, 0.0]), ("b", [0.6, 0.8, 0.0, 0.0]), ("c", [0.6, 0.0, 0.8, 0.0])]
    tracks = spark.createDataFrame([(i, i, i, v) for i, v in rows], "track_id string, title string, artist string, vector array<float>")
    plain = R.search(one_query(spark, [1.0, 0.0, 0.0, 0.0]), tracks)
    assert ranked(R.mmr_rerank(plain, tracks, 5, 1.0)) == ["a1", "a2", "a3", "b", "c"]
    mixed = ranked(R.mmr_rerank(plain, tracks, 3, 0.5))
    assert mixed[0] == "a1" and set(mixed) & {"b", "c"}


def test_spaces_and_vectors(spark, catalog):
    other = catalog.withColumn("space_fingerprint", F.lit("x"))
    require_same_space(catalog, catalog)
    with pytest.raises(TunesparkError):
        require_same_space(catalog, other)
    bad = [("n", [math.nan, 0.0, 0.0, 1.0]), ("i", [math.inf, 0.0, 0.0, 0.0]), ("z", [0.0] * 4), ("u", [0.5, 0.0, 0.0, 0.0]), ("s", [1.0]), ("ok", [1.0, 0.0, 0.0, 0.0]), ("ok", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(bad, "track_id string, vector array<float>")
    got = {(r["track_id"], r["problem"]) for r in vector_problems(df, 4, unit=True).collect()}
    assert got == {("n", "non-finite"), ("i", "non-finite"), ("z", "zero"), ("u", "not unit length"), ("s", "dimension"), ("ok", "duplicate id")}
    big = spark.createDataFrame([("b", [3e38, 3e38, 0.0, 0.0])], "track_id string, vector array<float>")
    assert [round(x, 4) for x in l2_normalize(big).first()["vector"]] == [0.7071, 0.7071, 0.0, 0.0]


def test_labels(spark):
    def scores(**own):
        return {c: 0.0 for c in V.CLASSES} | {k.replace("_", " "): v for k, v in own.items()}

    rows = [("r", scores(Rapping=0.07)), ("s", scores(Singing=0.015)), ("j", scores(Jazz=0.1, Blues=0.1)), ("m", scores(Sad_music=0.026, Tender_music=0.025))]
    df = spark.createDataFrame(rows, "track_id string, class_scores map<string,double>")
    got = {r["track_id"]: r for r in df.select("track_id", A.vocals_label("class_scores").alias("v"), A.genre_label("class_scores").alias("g"), A.mood_labels("class_scores").alias("m")).collect()}
    assert got["r"]["v"]["label"] == "vocal" and got["s"]["v"]["label"] is None and got["j"]["v"]["label"] == "instrumental"
    assert got["j"]["v"]["top_class"] == max(V.VOCAL_CLASSES)
    assert got["j"]["g"]["label"] == "blues" and got["r"]["g"]["label"] is None
    assert got["m"]["m"] == ["sad", "calm"]


def test_energy(spark):
    df = spark.createDataFrame([("a", -8.0, 0.5), ("b", -30.0, 3.0), ("c", -10.0, 4.0)], "track_id string, loudness_dbfs double, onset_rate double")
    assert [r["energy"] for r in A.with_energy(df).orderBy("track_id").collect()] == [0.5, 0.25, 0.75]


@pytest.fixture(scope="module")
def attributes(spark):
    rows = [("a", "vocal", "jazz", 0.1, 120.0, ["calm", "sad"]), ("b", "instrumental", None, 0.5, 124.0, ["calm"]), ("c", None, "jazz", 0.9, None, []), ("d", "instrumental", "rock", 0.2, 90.0, ["dark"])]
    df = spark.createDataFrame(rows, "track_id string, vocals string, genre string, energy double, bpm double, moods array<string>")
    return df.withColumn("vocal_score", F.lit(0.1)).withColumn("genre_score", F.lit(0.2))


def requests(spark, **own):
    row = {"query_id": "f", "query": None, "seed_id": None, "k": None, **dict.fromkeys(L.FILTERS), **own}
    schema = "query_id string, query string, seed_id string, k int, vocals string, genre string, mood string, energy string, tempo_min double, tempo_max double"
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


@pytest.mark.parametrize(("own", "want"), [
    ({"vocals": "instrumental", "genre": "rock"}, {"d": "pass", "a": "mismatch", "c": "mismatch", "b": "unknown"}),
    ({"tempo_min": 100.0, "tempo_max": 130.0}, {"a": "pass", "b": "pass", "d": "mismatch", "c": "unknown"}),
])
def test_verdicts(spark, attributes, own, want):
    assert {r["track_id"]: r["verdict"] for r in L.apply_filters(requests(spark, **own), attributes).collect()} == want


def test_explained_search(spark, catalog, attributes):
    req = requests(spark, query_id="q", query="calm jazz", vocals="vocal")
    out, hidden = Q.explained_search(req, one_query(spark, [1.0, 0.0, 0.0, 0.0]), catalog, attributes)
    row = out.withColumn("why", G.short_reason()).withColumn("lines", G.summarize()).collect()
    assert [(r["track_id"], r["of"]) for r in row] == [("a", 1)]
    assert row[0]["why"] == 'Vocal (model estimate) · closest sound match to "calm jazz"'
    assert [t["term"] for t in row[0]["agreement"]] == ["calm", "jazz"]
    assert row[0]["lines"][0] == 'Why: closest sound match to "calm jazz" (rank 1 of 1); passed your filters: vocal (model estimate)'
    assert row[0]["lines"][1] == 'Agrees with your search: "calm", "jazz" (model estimate)'
    assert row[0]["lines"][-1] == "Measured: 120 BPM · low energy for this catalog"
    assert hidden.first().asDict() == {"query_id": "q", "hidden_mismatch": 2, "hidden_unknown": 1}
    answer = Q.to_responses(out, catalog, hidden).first()
    assert answer["results"][0]["track_id"] == "a" and answer["hidden_mismatch"] == 2


def test_explained_similar(spark, catalog, attributes):
    req = requests(spark, query_id="s", seed_id="a", mood="calm")
    out, hidden = Q.explained_similar(req, catalog, attributes)
    row = out.withColumn("why", G.short_reason()).collect()
    assert [(r["track_id"], r["of"]) for r in row] == [("b", 1)]
    assert row[0]["shared"]["mood"] == ["calm"] and row[0]["shared"]["tempo_bpm"] == [120.0, 124.0]
    assert hidden.first()["hidden_unknown"] == 1


def test_recommend_routes(spark, catalog, attributes):
    rows = requests(spark, query_id="q", query="jazz").unionByName(requests(spark, query_id="s", seed_id="a")).unionByName(requests(spark, query_id="b", query="x", seed_id="b")).unionByName(requests(spark, query_id="u", seed_id="zz"))
    vectors = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0, 0.0])], "query_id string, vector array<float>")
    found, bad = Q.recommend(rows, vectors, catalog, attributes)
    got = {m: [r["track_id"] for r in found.where(F.col("mode") == m).orderBy("rank").collect()] for m in ("search", "similar", "blend")}
    assert got == {"search": ["a", "c", "b", "d"], "similar": ["c", "b", "d"], "blend": ["c", "a", "d"]}
    assert [(r["query_id"], r["error"]) for r in bad.collect()] == [("u", "unknown seed")]
    best = found.where("query_id = 'b'").orderBy("rank").first()
    assert best["blend"].asDict() == {"method": "sum of z-scored cosines", "weights": [1, 1]} and best["query_evidence"]["rank"] == 2 and " · sounds like B" in best["why"] and best["of"] == 3


def test_every_request_is_answered_or_rejected(spark, catalog, attributes):
    """Seeds and texts whose vectors are absent, of another dimension, not finite or zero reject their requests, as do failed texts and unknown seeds."""
    more = catalog.unionByName(spark.createDataFrame([("n", "N", "x", [float("nan"), 1.0, 0.0, 0.0])], "track_id string, title string, artist string, vector array<float>"), allowMissingColumns=True)
    asked = [("ok", "jazz", None), ("nan", "jazz", None), ("none", "jazz", None), ("zero", "x", "a"), ("dim", "x", None), ("failed", "x", None), ("seed", None, "n"), ("both", "x", "zz"), ("empty", None, None), ("hidden", "jazz", None)]
    rows = None
    for query_id, query, seed in asked:
        part = requests(spark, query_id=query_id, query=query, seed_id=seed, **({"genre": "metal"} if query_id == "hidden" else {}))
        rows = part if rows is None else rows.unionByName(part)
    good = [1.0, 0.0, 0.0, 0.0]
    vectors = [("ok", good, None), ("nan", [float("nan")] * 4, None), ("zero", [0.0] * 4, None), ("dim", [1.0, 0.0, 0.0], None), ("failed", None, "ValueError: no"), ("both", good, None), ("hidden", good, None)]
    found, bad = Q.recommend(rows, spark.createDataFrame(vectors, "query_id string, vector array<float>, error string"), more, attributes)
    errors = {r["query_id"]: r["error"] for r in bad.collect()}
    assert errors == {
        "nan": "query with unusable vector", "none": "no vector of the query", "zero": "query with unusable vector", "dim": "query with vector of another dimension", "failed": "ValueError: no",
        "seed": "seed with unusable vector", "both": "unknown seed", "empty": "no query and no seed",
    }
    answered = found.collect()
    assert {r["query_id"] for r in answered} == {"ok", "hidden"} and {r["of"] for r in answered if r["query_id"] == "ok"} == {4}
    gone = next(r for r in answered if r["query_id"] == "hidden")
    assert gone["track_id"] is None and gone["hidden_mismatch"] + gone["hidden_unknown"] == 4
    responses, _ = Q.respond(rows, spark.createDataFrame(vectors, "query_id string, vector array<float>, error string"), more, attributes)
    got = {r["query_id"]: r for r in responses.collect()}
    assert set(got) == {"ok", "hidden"} and got["hidden"]["results"] == [] and [x["track_id"] for x in got["ok"]["results"]] == ["a", "c", "b", "d"] and got["ok"]["results"][0]["why"].startswith("Matches")


def test_vectors_of_other_dimensions_are_refused(spark, catalog):
    short = one_query(spark, [1.0, 0.0, 0.0])
    for refused in (lambda: R.cosine_scores(short, catalog), lambda: R.search(short, catalog), lambda: R.blend(short, spark.createDataFrame([("q", "b")], "query_id string, seed_id string"), catalog)):
        with pytest.raises(TunesparkError, match="different dimensions"):
            refused()
    assert one_query(spark, [1.0, 0.0]).select(cosine("vector", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("c")).first()["c"] is None
    assert {r["track_id"]: r["error"] for r in R.unusable_vectors(catalog, "track_id", 3).collect()} == dict.fromkeys("abcd", "vector of another dimension")


def test_tiles_and_blocks_of_any_size(spark, monkeypatch):
    """Small tiles, several tasks and several blocks of requests give what ranking all scores gives, with ties, caps, exclusions and filters."""
    import random

    r = random.Random(3)
    labels = lambda i: (r.choice([None, "vocal", "instrumental"]), r.choice([None, "rock", "jazz"]), r.choice([[], ["calm"], ["sad", "calm"]]), r.choice([0.1, 0.5, 0.9]), r.choice([None, 90.0, 130.0]))
    tracks = [(f"t{i:03d}", f"T{i}", f"A{i % 7}", [float(r.randint(-2, 2)) for _ in range(3)] or [1.0]) for i in range(200)]
    tracks = [(a, b, c, v if any(v) else [1.0, 0.0, 0.0]) for a, b, c, v in tracks]
    df = spark.createDataFrame(tracks, "track_id string, title string, artist string, vector array<float>").repartition(3)
    attributes = spark.createDataFrame([(t[0], *labels(t)) for t in tracks[:180]], "track_id string, vocals string, genre string, moods array<string>, energy double, bpm double").withColumns({"vocal_score": F.lit(0.0), "genre_score": F.lit(0.0)})
    asked = [(f"q{i}", [float(r.randint(-2, 2)), 1.0, 1.0], r.choice([None, "vocal", " "]), r.choice([None, "jazz"]), r.choice([None, "calm"]), r.choice([None, "low"]), r.choice([None, 80.0]), r.choice([None, 100.0])) for i in range(23)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>, vocals string, genre string, mood string, energy string, tempo_min double, tempo_max double")
    gone = spark.createDataFrame([(f"q{r.randrange(23)}", f"t{r.randrange(200):03d}") for _ in range(300)], "query_id string, track_id string")
    scores = R.cosine_scores(queries, df)
    failing = L.apply_filters(queries, attributes).where("verdict <> 'pass'").select("query_id", "track_id")
    nothing = queries.select("query_id").crossJoin(df.select("track_id").join(attributes, "track_id", "left_anti")).join(queries.where("coalesce(nullif(trim(vocals), ''), genre, mood, energy, cast(tempo_min as string), cast(tempo_max as string)) is not null").select("query_id"), "query_id", "left_semi")
    every = failing.unionByName(nothing).unionByName(gone)
    shown = lambda x: sorted((y["query_id"], y["rank"], y["track_id"], round(y["score"], 6)) for y in x.collect())
    monkeypatch.setattr(tiles, "KEPT", 60)
    for k, cap in ((6, None), (12, 2)):
        want = shown(R.rank_by_score(scores, k, every, cap))
        assert shown(R.search(queries, df, k, gone, cap, attributes)) == want
    counts = {x["query_id"]: (x["of"], x["hidden_mismatch"], x["hidden_unknown"]) for x in tiles.counted(tiles.top_k(queries.withColumnRenamed("vector", "q_vector"), df, 5, attributes=attributes)).collect()}
    left = scores.join(failing.unionByName(nothing), ["query_id", "track_id"], "left_anti").groupBy("query_id").count()
    assert {x["query_id"]: x["count"] for x in left.collect()} == {q: n[0] for q, n in counts.items() if n[0]}
    assert all(sum(n) == 200 for n in counts.values())


def test_signal(spark):
    lengths = [(n,) for n in (50, 100, 150, 200, 350, 1000)]
    got = [r["s"] for r in spark.createDataFrame(lengths, "n int").select(C.excerpt_starts("n", 100, 3).alias("s")).collect()]
    assert got == [[0], [0], [25], [0, 100], [0, 125, 250], [0, 450, 900]]
    s = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [float(i) for i in range(20)])], "track_id string, samples array<float>")
    cut = {(r["track_id"], r["start"]): r["samples"] for r in C.extract_excerpts(s, 8, 2).collect()}
    assert cut[("a", 0)] == [1, 2, 3, 1, 2, 3, 1, 2] and cut[("b", 12)] == list(range(12, 20))
    two = spark.createDataFrame([("m", [[1.0, 0.0], [0.0, 1.0]]), ("z", [[0.0, 0.0]]), ("e", [])], "track_id string, channels array<array<float>>")
    assert {r["track_id"]: (r["samples"], r["reason"]) for r in C.mono_and_gate(two).collect()} == {"m": ([0.5, 0.5], None), "z": ([0.0, 0.0], "silent"), "e": (None, "empty")}
    beats = spark.createDataFrame([([1.0 if i % 10 == 0 else 0.0 for i in range(1000)], 43.07), ([0.0] * 100, 43.07)], "e array<double>, f double")
    clear = [r["c"] for r in beats.select(C.pulse_clarity("e", "f").alias("c")).collect()]
    assert clear[0] > 0.9 and clear[1] == 0.0


def test_dataset_csv(spark, tmp_path):
    text = ",artist,set,track,track,track\n,name,subset,genre_top,license,title\ntrack_id,,,,,\n2,AWOL,small,Hip-Hop,,Food\n3,AWOL,small,Hip-Hop,CC,\"Elec, tric\"\n5,,small,Hip-Hop,,\n7,Kurt,large,Rock,,x\n10,,small,Pop,, \n"
    (tmp_path / "tracks.csv").write_text(text)
    raw = D.read_track_metadata(spark, str(tmp_path / "tracks.csv"))
    own = raw.select("track_id", F.col("`artist.name`").alias("artist"), F.col("`set.subset`").alias("subset"), F.col("`track.genre_top`").alias("genre_top"), F.col("`track.license`").alias("license"), F.col("`track.title`").alias("title"))
    tracks = D.with_availability(D.with_clip_path(own), spark.createDataFrame([("000/000002.mp3",), ("000/000005.mp3",), ("000/000010.mp3",)], "path string"))
    assert [r["track_id"] for r in D.sample_per_genre(tracks, "small", 2).orderBy("track_id").collect()] == [2, 5, 10]
    assert D.missing_clips(tracks, "small", 2).first()["missing"] == 1
    entries = {r["track_id"]: r for r in D.manifest_entries(D.sample_per_genre(tracks, "small", 2)).collect()}
    assert entries["fma-000010"]["title"] == "FMA track 10" and entries["fma-000010"]["artist"] == "Unknown artist" and entries["fma-000002"]["license"] == "unknown (see FMA)"


def test_manifest_json(spark, tmp_path):
    rows = [
        {"track_id": "a", "title": "A", "artist": "x", "audio_path": "a.mp3", "_note": "fine", "source": "  "}, {"track_id": "a", "title": "B", "artist": "x", "audio_path": "b.mp3"},
        {"track_id": "c", "title": " ", "artist": "x", "audio_path": "a.mp3", "licence": "typo"}, {"track_id": "d", "title": "D", "artist": 5, "audio_path": "gone.mp3"},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"tracks": rows}))
    entries = M.entry_columns(M.read_manifest(spark, str(tmp_path / "m.json")))
    listing = spark.createDataFrame([("a.mp3",), ("b.mp3",)], "path string")
    valid, bad = M.validate_manifest(entries, listing)
    assert [r.asDict() for r in valid.select("track_id", "source").collect()] == [{"track_id": "a", "source": None}]
    assert {(r["position"], r["problem"]) for r in bad.collect()} == {(1, "duplicate track_id, first at 0"), (2, "missing title"), (2, "unknown fields licence"), (3, "artist is not text"), (3, "audio not found")}
    with pytest.raises(TunesparkError):
        M.validate_manifest(entries, listing, strict=True)


def test_index_build_publish_load(spark, tmp_path):
    def encoder():
        def encode(path):
            if path == "bad":
                raise OSError("no such audio")
            x = [float(ord(c) % 7 + 1) for c in (path * 4)[:4]]
            n = math.sqrt(sum(v * v for v in x))
            return [v / n for v in x], 2

        return encode

    rows = [("a", "A", "x", "pa", "sha-a"), ("b", "B", "x", "pb", "sha-b"), ("c", "C", "x", "bad", "sha-c")]
    manifest = spark.createDataFrame(rows, "track_id string, title string, artist string, audio_path string, audio_sha256 string")
    index, report = I.build_index(manifest, encoder, SPACE)
    assert {r["track_id"]: r["status"] for r in report.collect()} == {"a": "embedded", "b": "embedded", "c": "failed"}
    target = str(tmp_path / "index")
    with pytest.raises(TunesparkError, match="no index"):
        I.load_generation(spark, target)
    names = [I.publish_generation(index, target, SPACE, grace_seconds=0) for _ in range(3)]
    assert sorted(p.name for p in (tmp_path / "index").glob("gen-*")) == names[1:]
    stored = I.load_generation(spark, target)
    assert stored.count() == 2
    changed = manifest.withColumn("audio_sha256", F.when(F.col("track_id") == "b", "sha-b2").otherwise(F.col("audio_sha256"))).withColumn("title", F.lit("new"))
    again, report = I.build_index(changed, encoder, SPACE, stored)
    assert {r["track_id"]: r["status"] for r in report.collect()} == {"a": "reused", "b": "embedded", "c": "failed"}
    assert {(r["title"], r["excerpt_count"]) for r in again.collect()} == {("new", 2)}
    _, report = I.build_index(manifest, encoder, EmbeddingSpace("other", "1", 4, 48_000, 10.0, 3), stored)
    assert "reused" not in {r["status"] for r in report.collect()}
    stored.limit(1).write.mode("overwrite").parquet(f"{target}/{names[-1]}/rows2")
    (tmp_path / "index" / names[-1] / "rows").rename(tmp_path / "index" / names[-1] / "rows-old")
    (tmp_path / "index" / names[-1] / "rows2").rename(tmp_path / "index" / names[-1] / "rows")
    with pytest.raises(TunesparkError, match="rows differs"):
        I.load_generation(spark, target)


def test_labels_file_and_agreement(spark, tmp_path, attributes):
    own = {"tracks": {"_note": {"vocals": "vocal"}, "a": {"vocals": "vocal", "genre": "rock", "mood": ["calm"], "energy": "low"}, "c": {"vocals": "vocal", "genre": None, "mood": ["sad"]}, "d": {"mood": ["calm"]}, "x": "text"}}
    (tmp_path / "labels.json").write_text(json.dumps(own))
    labels = E.read_labels(spark, str(tmp_path / "labels.json"))
    got = {(r["track_id"], r["attribute"]): r["outcome"] for r in E.compare_with_labels(attributes, labels).collect()}
    assert got == {("a", "vocals"): "agree", ("a", "genre"): "disagree", ("a", "mood"): "agree", ("a", "energy"): "agree", ("c", "vocals"): "unknown", ("c", "mood"): "unknown", ("d", "mood"): "disagree"}
    assert E.label_errors(labels, attributes).count() == 0


def test_attributes_saved_and_stale(spark, tmp_path):
    own = spark.createDataFrame([("a", "s1"), ("b", "s2")], "track_id string, audio_sha256 string")
    A.save_attributes(own, str(tmp_path / "attrs"))
    assert A.load_attributes(spark, str(tmp_path / "attrs"), own).count() == 2
    with pytest.raises(TunesparkError, match="audio"):
        A.load_attributes(spark, str(tmp_path / "attrs"), own.withColumn("audio_sha256", F.lit("s1")))


def test_playlist_orders(spark):
    items = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 1), (3, "a", 0), (3, "b", 1)], "playlist_id long, track_id string, position int")
    orders = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "a"]), (3, ["a"])], "playlist_id long, requested array<string>")
    out, bad = J.reorder(items, orders)
    assert {(r["track_id"], r["position"]) for r in out.where("playlist_id = 1").collect()} == {("b", 0), ("a", 1)}
    assert {r["playlist_id"]: r["reason"] for r in bad.collect()} == {2: "invalid", 3: "incomplete"}


def test_feedback_stream(spark, tmp_path):
    from tunespark.streaming.feedback import feedback_stream

    schema = "row_id long, user_id string, query_id string, action string, created_at timestamp, title string, artist string, provider_url string"
    rows = [(1, "u", "", "SAVE", None, "T", "A", None), (2, "u", "q", "LIKE", None, "T", "A", None), (3, "u", "q", "OPEN", None, "", "A", None), (4, "u", "q", "SKIP", None, "T", "A", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    tracks = J.normalize_track_identity(spark.createDataFrame([], "id string, title string, artist string")).select("id", *J.IDENTITY)
    stream = feedback_stream(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: tracks, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    stream.awaitTermination(120)
    accepted = spark.read.parquet(str(tmp_path / "out/accepted"))
    assert {r["row_id"] for r in accepted.collect()} == {1, 4} and accepted.select("track_id").distinct().count() == 1
    assert {(r["row_id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()} == {(2, "unsupported action"), (3, "incomplete track")}
    assert spark.read.parquet(str(tmp_path / "out/tracks")).count() == 1


def test_clip_paths_of_long_numbers_stay_whole(spark):
    rows = D.with_clip_path(spark.createDataFrame([(7,), (999_999,), (1_000_000,), (1_234_567,), (None,)], "track_id int"), "clips/")
    assert [r["clip_path"] for r in rows.collect()] == ["clips/000/000007.mp3", "clips/999/999999.mp3", "clips/100/1000000.mp3", "clips/123/1234567.mp3", None]


@pytest.mark.parametrize("kept,block", [(1 << 20, 2048), (60, 7), (15, 3)])
def test_neighbours_of_any_strips_and_blocks(spark, monkeypatch, kept, block):
    """Ties by id, equal vectors, rows of one id, vectors of large and small size, and some that can't be used."""
    import numpy as np

    r = np.random.default_rng(5)
    base = np.round(r.normal(size=(40, 5)), 1).astype(np.float32)
    rows = [(f"t{i % 90:02d}", [float(x) for x in base[i % 40] * np.float32(10.0 ** (i % 7 - 3))]) for i in range(100)] + [("zero", [0.0] * 5), ("none", None), (None, [1.0] * 5)]
    catalog = spark.createDataFrame(rows, "track_id string, vector array<float>").repartition(3)
    monkeypatch.setattr(R, "STRIP_KEPT", kept)
    blocks, sent = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: blocks.append((name, df)) or sent(df, name))
    got = sorted((x["seed_id"], x["rank"], x["track_id"], x["score"]) for x in R.all_neighbours(catalog, 3, block).collect())
    usable = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows[:100]]
    want = []
    for seed in sorted({i for i, _ in usable}):
        scores = [(-np.float32(np.clip(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)), -1, 1)), j) for i, x in usable if i == seed for j, y in usable if j != seed]
        want += [(seed, n + 1, j, float(-s)) for n, (s, j) in enumerate(sorted(scores)[:3])]
    assert got == want
    assert spark.conf.get(R.BATCH_ROWS) == "10000" and [name for name, _ in blocks] == ["blocks", "neighbours"]
