"""Staged builds that are stopped and started again, publishing at once, digests of large files, texts to vectors, search by parts of texts."""

import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from tunespark import vocab as V
from tunespark.jobs import files
from tunespark.jobs import index as I
from tunespark.jobs import staged
from tunespark.operators import attributes as A
from tunespark.operators import lookup as H
from tunespark.operators.vectors import EmbeddingSpace, TunesparkError
from tunespark.sources import dataset as D
from tunespark.sources import manifest as M

SPACE = EmbeddingSpace("m", "1", 4, 48_000, 10.0, 3)


# ------------------------------------------------------------------------------------------------ staged build


@pytest.fixture
def dataset(spark):
    rows = [(i, ["Rock", "Jazz", "Pop"][i % 3], f"T{i}", "A", "CC", "small") for i in range(1, 61)]
    tracks = D.with_clip_path(spark.createDataFrame(rows, "track_id int, genre_top string, title string, artist string, license string, subset string")).withColumn("available", F.lit(True))
    return tracks, tracks.select(F.col("clip_path").alias("path"), F.sha2("clip_path", 256).alias("digest"))


class Works:
    """An encoder and an analyser that write down what they did in a folder, and stop after some calls."""

    def __init__(self, folder, stop_encoding_at=None, stop_analysing_at=None):
        self.stop_analysing_at, self.analysed, folder = stop_analysing_at, 0, str(folder)

        def encoder():
            def encode(path):
                import hashlib
                import os

                if path.endswith("000013.mp3"):
                    raise OSError("broken clip")
                if stop_encoding_at is not None and len(os.listdir(folder)) >= stop_encoding_at:
                    os._exit(1)  # the worker dies
                with open(f"{folder}/{hashlib.md5(path.encode()).hexdigest()}", "a") as f:
                    f.write("x")
                return [0.5, 0.5, 0.5, 0.5], 2

            return encode

        self.encoder = encoder

    def analyse(self, rows):
        self.analysed += 1
        if self.stop_analysing_at is not None and self.analysed > self.stop_analysing_at:
            raise KeyboardInterrupt
        scores = F.map_from_arrays(F.array(*map(F.lit, V.CLASSES)), F.array(*[F.lit(0.1)] * len(V.CLASSES)))
        return rows.select("track_id", scores.alias("class_scores"), F.lit(-10.0).alias("loudness_dbfs"), F.lit(1.0).alias("onset_rate"), F.lit(None).cast("double").alias("bpm"), F.lit(0.0).alias("pulse_clarity"))


def encoded(folder):
    return {p.name: len(p.read_text()) for p in folder.iterdir()}


def test_stages_reuse_and_a_restart_repeats_nothing(spark, dataset, tmp_path):
    tracks, digests = dataset
    seen, index = tmp_path / "seen", str(tmp_path / "index")
    seen.mkdir()
    build = lambda works: staged.staged_build(spark, tracks, [2, 5, 0], works.encoder, works.analyse, SPACE, index, digests, slice_tracks=8)
    with pytest.raises(KeyboardInterrupt):
        build(Works(seen, stop_analysing_at=3))  # two stages are over, the third stops between two slices of analyses
    left = staged.resume_point(spark, index)
    assert left["stages"] == 2 and left["vectors"] == 59 and 14 < left["analyses"] < 59
    between = encoded(seen)
    reports = build(Works(seen))
    assert [r["done_before"] for r in reports] == [True, True, False]
    assert [(r["per_genre"], r["tracks"], r["failed"]) for r in reports] == [(2, 6, 0), (5, 14, 1), (0, 59, 1)]
    assert reports[1]["embedded"] == 8 and reports[1]["reused"] == 6 and reports[2]["embedded"] == 0 and reports[2]["reused"] == 59 and reports[2]["first_failed"] == ["fma-000013"]
    assert reports[2]["analysed"] == 59 - left["analyses"]
    assert set(encoded(seen).values()) == {1} and set(between) <= set(encoded(seen)) and len(encoded(seen)) == 59
    stored = I.load_generation(spark, index)
    assert stored.count() == 59 and A.load_attributes(spark, f"{index}/attributes/{reports[2]['generation']}", stored).count() == 59
    again = build(Works(seen))
    assert all(r["done_before"] for r in again) and set(encoded(seen).values()) == {1} and len(I.generations(spark, index)) >= 2
    changed = digests.withColumn("digest", F.when(F.col("path").endswith("000007.mp3"), F.lit("other")).otherwise(F.col("digest")))
    works = Works(seen)
    report = staged.staged_build(spark, tracks, [0], works.encoder, works.analyse, SPACE, index, changed, slice_tracks=100)[0]
    assert (report["embedded"], report["reused"], report["analysed"]) == (1, 58, 1)


def test_slices_that_were_whole_are_kept_when_a_worker_dies(spark, dataset, tmp_path):
    tracks, digests = dataset
    seen, index = tmp_path / "seen", str(tmp_path / "index")
    seen.mkdir()
    works = Works(seen, stop_encoding_at=20)
    with pytest.raises(Exception):
        staged.staged_build(spark, tracks, [0], works.encoder, works.analyse, SPACE, index, digests, slice_tracks=8)
    left = staged.resume_point(spark, index)
    assert left["stages"] == 0 and 0 < left["vectors"] <= 20
    works = Works(seen)
    report = staged.staged_build(spark, tracks, [0], works.encoder, works.analyse, SPACE, index, digests, slice_tracks=8)[0]
    assert report["tracks"] == 59 and report["embedded"] == 59 - left["vectors"] and report["reused"] == left["vectors"]


def test_quick_slices_grow_and_slow_ones_do_not(spark, dataset, tmp_path, monkeypatch):
    rows = dataset[0].select("track_id")
    monkeypatch.setattr(staged, "QUICK_SECONDS", 1000)
    n, slices = staged._slices(rows, 2, "rows")
    quick = [[r["track_id"] for r in part.collect()] for part in slices]
    monkeypatch.setattr(staged, "QUICK_SECONDS", 0)
    slow = [[r["track_id"] for r in part.collect()] for part in staged._slices(rows, 2, "rows")[1]]
    assert n == 60 and len(quick) == 5 and len(slow) == 30  # 30 parts: 1, 2, 4, 8 and the last 15
    for slices in (quick, slow):
        assert sorted(x for part in slices for x in part) == list(range(1, 61))
    assert staged._slices(rows.where("false"), 2, "rows")[0] == 0


def test_a_path_of_a_long_number_has_a_vector_of_the_same_dimension():
    from tunespark.jobs.queries import _path_encoder

    encode = _path_encoder()
    assert [len(encode(path)[0]) for path in ("012/012345.mp3", "123/1234567.mp3")] == [10, 10]


# ------------------------------------------------------------------------------------------------ publishing


def test_two_publishers_at_once_give_two_generations(spark, tmp_path):
    index = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "s", [1.0, 0.0, 0.0, 0.0])], "track_id string, audio_sha256 string, vector array<float>")
    I.publish_generation(rows, index, SPACE)
    names, wrong, stop = [], [], threading.Event()

    def publish():
        names.append(I.publish_generation(rows, index, SPACE, keep=1))

    def read():
        while not stop.is_set():
            try:
                assert I.load_generation(spark, index).count() == 1
            except Exception as error:  # noqa: BLE001
                wrong.append(error)

    reader, publishers = threading.Thread(target=read), [threading.Thread(target=publish) for _ in range(3)]
    for t in [reader, *publishers]:
        t.start()
    for t in publishers:
        t.join()
    stop.set()
    reader.join()
    assert sorted(names) == ["gen-00000002", "gen-00000003", "gen-00000004"] and not wrong
    assert I.generations(spark, index) == ["gen-00000001", *sorted(names)]  # none is old enough to go
    assert I.collect_garbage(spark, index, keep=1, grace_seconds=0) == ["gen-00000001", "gen-00000002", "gen-00000003"]
    assert I.load_generation(spark, index).count() == 1 and not [n for n in files.children(spark, index) if n.startswith("tmp-")]
    (tmp_path / "aside").mkdir()
    assert not files.rename_new(spark, str(tmp_path / "aside"), f"{index}/{sorted(names)[-1]}") and (tmp_path / "aside").exists()
    assert files.write_new(spark, f"{index}/x.json", "one") and not files.write_new(spark, f"{index}/x.json", "two") and (tmp_path / "index/x.json").read_text() == "one"


# ------------------------------------------------------------------------------------------------ digests


def test_digests_chunk_by_chunk(spark, tmp_path):
    contents = {"a b.bin": b"x" * 100_001, "e.bin": b"", "c.bin": bytes(range(256)) * 40}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for algo in ("sha256", "sha1"):
        got = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in M.content_digest(spark, str(tmp_path / "*.bin"), algo, chunk=1000).collect()}
        assert {k: got.get(k) for k in ("a b.bin", "c.bin")} == {k: hashlib.new(algo, contents[k]).hexdigest() for k in ("a b.bin", "c.bin")} and len(got) == 2
    digests = M.content_digest(spark, str(tmp_path / "*.bin"))
    want = digests.unionByName(spark.createDataFrame([("gone.bin", "0")], "path string, digest string"))
    (tmp_path / "c.bin").write_bytes(b"altered")
    want = spark.createDataFrame([(r["path"], hashlib.sha256(contents["c.bin"]).hexdigest() if r["path"].endswith("c.bin") else r["digest"]) for r in want.collect()], "path string, digest string")
    problems = {r["path"].rsplit("/", 1)[-1]: r["problem"] for r in M.verify_digests(M.content_digest(spark, str(tmp_path / "*.bin")), want).collect()}
    assert problems == {"gone.bin": "missing", "c.bin": "mismatch"}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    sha, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        sha.update(block)
    sha.update(block[: size & ((1 << 24) - 1)])
    assert M.content_digest(spark, str(tmp_path / "large.bin")).first()["digest"] == sha.hexdigest()


# ------------------------------------------------------------------------------------------------ texts


def test_texts_are_encoded_once_and_fail_alone(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def factory():
        import uuid

        made = uuid.uuid4().hex

        def encode(texts):
            with open(f"{folder}/{made}", "a") as f:
                f.write("".join(t + "\n" for t in texts))
            if "bad" in texts:
                raise ValueError("bad text")
            return [[float("nan") if t == "nan" else float(len(t)), 1.0] for t in texts]

        return encode

    rows = [(str(i), t) for i, t in enumerate([" aa ", "aa", "bbb", "bad", "nan", "", " ", None, "aa"])]
    got = {r["query_id"]: (r["vector"], r["error"]) for r in I.embed_texts(spark.createDataFrame(rows, "query_id string, query string"), factory).collect()}
    assert got == {"0": ([2.0, 1.0], None), "1": ([2.0, 1.0], None), "8": ([2.0, 1.0], None), "2": ([3.0, 1.0], None), "3": (None, "ValueError: bad text"), "4": (None, "ValueError: the vector is empty or not finite")}


def test_a_requests_text_reaches_the_search(spark):
    from tunespark.operators import requests as Q
    from tunespark.operators.filters import FILTERS

    def factory():
        def encode(texts):
            if any("?" in t for t in texts):
                raise ValueError("no question")
            return [[1.0, 0.0] if t == "up" else [0.0, 1.0] for t in texts]

        return encode

    catalog = spark.createDataFrame([("a", "A", "x", [1.0, 0.1]), ("b", "B", "y", [0.1, 1.0])], "track_id string, title string, artist string, vector array<float>")
    asked = spark.createDataFrame([("1", "up"), ("2", "down "), ("3", "up?")], "query_id string, query string").withColumns({"seed_id": F.lit(None).cast("string"), "k": F.lit(1)} | {c: F.lit(None).cast("double" if "tempo" in c else "string") for c in FILTERS})
    answers, bad = Q.respond(asked, I.embed_texts(asked, factory), catalog)
    assert {r["query_id"]: [x["track_id"] for x in r["results"]] for r in answers.collect()} == {"1": ["a"], "2": ["b"]}
    assert [(r["query_id"], r["error"]) for r in bad.collect()] == [("3", "ValueError: no question")]


# ------------------------------------------------------------------------------------------------ search by parts of texts


def test_find_by_parts_without_a_cross_join(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(0, 6)))
    tracks = [(f"t{i:03d}", word().title() if i % 9 else None, word() or None) for i in range(300)]
    needles = [(f"n{i}", r.choice([word(), word()[:1], word()[:2], "zzz", None, " ", "ABé"])) for i in range(60)]
    catalog, asked = spark.createDataFrame(tracks, "track_id string, title string, artist string"), spark.createDataFrame(needles, "needle_id string, text string")
    want = {}
    for name, text in needles:
        needle = (text or "").strip(" ").lower()
        if needle:
            hits = []
            for track_id, title, artist in tracks:
                if needle in " ".join(x for x in (title, artist) if x is not None).lower():
                    low = title.lower() if title is not None else None
                    kind = 2 if low is None else 0 if low.startswith(needle) else 1 if needle in low else 2
                    hits.append((kind, low is not None, low or "", track_id))
            want[name] = [x[3] for x in sorted(hits)[:7]]
    for index in (None, H.gram_index(catalog)):
        found = H.find_tracks(asked, catalog, 7, index)
        got = {}
        for x in found.orderBy("place").collect():
            got.setdefault(x["needle_id"], []).append(x["track_id"])
        assert got == {k: v for k, v in want.items() if v}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_equal_texts_and_equal_tracks_are_looked_up_once(spark):
    """Many needles of few texts, many tracks of few titles: no step makes a row for each needle and track."""
    tracks = [(f"t{i:03d}", ["Blue Sky", "blue sky", "Sky", "Night"][i % 4], ["Abe", "Sky Fox"][i % 3 == 0]) for i in range(240)]
    texts = ["sky", " SKY ", "blue", "fox", "zzz"]
    needles = [(f"n{i}", texts[i % 5]) for i in range(200)]
    catalog, asked = spark.createDataFrame(tracks, "track_id string, title string, artist string"), spark.createDataFrame(needles, "needle_id string, text string")
    found = H.find_tracks(asked, catalog, 4)
    got = {}
    for x in found.orderBy("needle_id", "place").collect():
        got.setdefault(x["needle_id"], []).append(x["track_id"])
    for name, text in needles:
        needle = text.strip().lower()
        hits = sorted((0 if t.lower().startswith(needle) else 1 if needle in t.lower() else 2, t.lower(), i) for i, t, a in tracks if needle in f"{t} {a}".lower())
        assert got.get(name, []) == [i for _, _, i in hits[:4]]
    made, nodes = [], [found._jdf.queryExecution().executedPlan()]
    while nodes:  # the last job joins the needles with the answers of their texts; what goes before was written
        node = nodes.pop()
        nodes += [node.executedPlan()] if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        made.append(node.nodeName())
    assert not any("Window" in name or "Generate" in name for name in made)


def test_no_vector_at_all_is_an_error(spark, dataset, tmp_path):
    def factory():
        def encode(path):
            raise OSError("none")

        return encode

    tracks, digests = dataset
    with pytest.raises(TunesparkError, match="no track"):
        staged.staged_build(spark, tracks, [2], factory, Works(tmp_path).analyse, SPACE, str(tmp_path / "index"), digests)
