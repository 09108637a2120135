"""The training-data operators against brute force, the public libraries, and awkward input."""

import ctypes
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunespark.llm import bm25_search, byte_bpe, common, components, cover_tree, language_id, order_minhash, packing, sharding, toxicity, url_filter
from tunespark.llm.common import held_out
from tunespark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\n  b ", "x" * 300, "é" * 40, "naïve ½ ²³ Ⅷ 日本語　全角", "it's we'll 're 'r x'll", "<|endoftext|>hi <|startoftext|>", "a\n ", "\n \n", "ab" * 3000]
SCHEMA = "doc_id bigint, text string, lang string, score double, shard int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty and odd texts, a repeated row, a null id, extra columns named as results are."""
    rows = [(i, t, None, 0.5, 1) for i, t in enumerate(ODD)] + [(0, "", None, 0.5, 1), (100, None, None, 0.5, 1), (None, "no id here at all", None, 0.5, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(" \n\t'abcdelrsvT.,1é日 ½Σ") for _ in range(r.randint(0, 40))) for _ in range(n)]


# ------------------------------------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def counter():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    return byte_bpe.Prefixes(content, byte_bpe.odd_in_tokenizers(content))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_at_every_prefix(counter, library):
    for text in [t for t in ODD if len(t) < 200] + random_texts(150):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.at_prefixes(text) == want
        assert counter.total(text) == want[-1]


def test_prefixes_inside_special_strings(counter, library):
    for text in ["a.<|endoftext|>", "a <|endoftext|>b", " <|endoftext|>", ".<|startoftext|><|endoftext|> <|endoftext|>\n", "<|endoftext", "it's<|endoftext|>'re", "a  <|endoftext|>  b", "x\x1c \x1f y"]:
        assert counter.at_prefixes(text) == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def _all_points(first):
    """Every code point, assigned or not, after a letter, a number or a sign, in texts of 500."""
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    return ["\n".join(first + c + "s" for c in points[i : i + 500]) for i in range(0, len(points), 500)]


@pytest.mark.parametrize("first", "a1.")
def test_counts_of_every_code_point(counter, library, first):
    texts = _all_points(first)
    assert [counter.total(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("first", "a1.")
def test_ids_of_every_code_point(first):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(byte_bpe.Ranks(content, P.PATTERN, byte_bpe.odd_in_tiktoken(P.PATTERN)))
    texts = _all_points(first)
    assert encoder.encode(texts) == [np.array(x, "<u4").tobytes() for x in encoding.encode_ordinary_batch(texts)]


def test_token_counts(awkward, empty, library):
    got = byte_bpe.token_counts(awkward, P.path("byte_bpe_50k.json"), 10).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(ODD):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (by_id[i]["n_bytes"], by_id[i]["n_tokens"], by_id[i]["over_limit"]) == (len(t.encode()), n, n > 10)
    assert by_id[100]["n_tokens"] == 0
    assert byte_bpe.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_truncation(spark, library):
    text = "The quick brown fox jumps over the lazy dog's 12345 back"
    counts = byte_bpe.prefix_counts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), P.path("byte_bpe_50k.json"))
    cut = {r["doc_id"]: r["cut"] for r in byte_bpe.truncation_points(counts, 7).collect()}
    assert cut[1] == max(i for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= 7) and cut[2] == 0


def test_encode_decode(awkward, empty, docs):
    import base64
    import hashlib

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (awkward, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        rows = byte_bpe.encode_decode(df, path, P.PATTERN).collect()
        assert len(rows) == df.count()
        for r in rows:
            ids = np.array(encoding.encode_ordinary(texts[r["doc_id"]]), "<u4")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode_decode(empty, path, P.PATTERN).count() == 0


# ------------------------------------------------------------------------------------------------ URLs


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://b.com/de/1", "http://com/fr/", "http://notexample.org/es/", "x://h.net", "http://example.org", "no url", "", None, "http://org.evil.net/es/", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1)], "page_id long, url string, rule int")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 1
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[2] == ("b.com", "/de/1", "com/de/", "block") and by[3] == ("com", "/fr/", "com/fr/", "allow")
    assert by[4][2:] == ("org/", "allow") and by[6] == ("example.org", "", None, "allow") and by[11][2] is None
    assert by[7] == by[8] == by[9] == ("", "", None, "allow") and by[10][2] is None
    assert url_filter.judge(pages.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ near-duplicates


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    got = {x["u"]: x["component"] for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    want = brute_components({x for e in links for x in e}, links)
    assert got == {i: want[i] for i in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    """Near copies by dynamic programming on the words alone."""
    a, b = a.lower().split(), b.lower().split()
    longest = max(len(a), len(b))
    return bool(a and b) and abs(len(a) - len(b)) <= 0.2 * longest + 1e-9 and edit_distance(a, b) <= 0.2 * longest + 1e-9


def random_edits(r, words, n):
    words = list(words)
    for _ in range(n):
        kind = r.randrange(3)
        if kind == 0 and words:
            words[r.randrange(len(words))] = f"n{r.randrange(10**9)}"
        elif kind == 1 and len(words) > 1:
            del words[r.randrange(len(words))]
        else:
            words.insert(r.randrange(len(words) + 1), f"n{r.randrange(10**9)}")
    return words


def test_banded_distance_against_dynamic_programming():
    r = random.Random(2)
    for _ in range(3000):
        a = [r.randrange(r.choice([2, 4, 30])) for _ in range(r.randint(1, 30))]
        b = random_edits(r, a, r.randint(0, 8)) or [0]
        d = edit_distance(a, b)
        for most in (0, 1, 3, 9):
            got = order_minhash.banded_distance(a, b, most)
            assert got == d if d <= most else got > most


@pytest.mark.parametrize("long", [20_000, 40])
def test_near_copies_against_dynamic_programming(monkeypatch, long):
    monkeypatch.setattr(order_minhash, "BRIEF", 10)
    monkeypatch.setattr(order_minhash, "LONG", long)
    r = random.Random(4)
    for _ in range(500):
        base = [f"w{r.randrange(r.choice([5, 50, 5000]) if long > 40 else 5000)}" for _ in range(r.randint(1, 60))]
        a = base * r.choice([1, 1, 3, 6]) if long > 40 else base
        b = random_edits(r, a, r.randint(0, len(a) // 4))
        if r.random() < 0.3:
            b = a[: len(a) // 6] + b
        a, b = " ".join(a), " ".join(b)
        assert order_minhash.near_copies(order_minhash.Text(a), order_minhash.Text(b)) == near(a, b)


def test_a_repeated_passage_with_one_more_in_front_is_a_near_copy(spark):
    r = random.Random(6)
    passage = [f"p{r.randrange(10**6)}" for _ in range(40)]
    texts = [" ".join(passage * 6), " ".join(passage * 7), " ".join(passage * 9)]
    got = {x["doc_id"]: x["component_id"] for x in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert near(texts[0], texts[1]) and not near(texts[0], texts[2]) and not near(texts[1], texts[2]) and got == {0: 0, 1: 0, 2: 2}


def corpus(seed=1):
    """Texts of random words with exact copies, near copies in chains and stars, and a passage that many share."""
    r = random.Random(seed)
    new = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(3000)}" for _ in range(n)]

    def edited(words, share):
        return [w if r.random() > share else f"z{r.randrange(10**6)}" for w in words]

    passage, texts = new(60), []
    for _ in range(25):
        base = new(r.randint(40, 300))
        texts.append(base)
        texts += [edited(base, share) for share in (0.005, 0.01, 0.02, 0.04, 0.1)]
        texts.append(base)
    texts += [new(r.randint(5, 80)) + passage + new(r.randint(5, 80)) for _ in range(60)]
    star = new(150)
    texts += [edited(star, 0.012) for _ in range(80)]
    texts += [new(n) for n in (1, 2, 3, 4, 5, 6)] + [["one", "two"], ["one", "two"]]
    return [" ".join(t) for t in texts]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET_ROWS", 16)
    texts = corpus()
    words = [t.split() for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(set(words[i]) & set(words[j])) > 0.6 * min(len(words[i]), len(words[j])) and near(texts[i], texts[j])]
    linked += [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j]]
    want = brute_components(range(len(texts)), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(df).collect()}
    assert got == want


def test_recall_by_share_of_edited_words(spark):
    r = random.Random(9)
    shares = {0.02: 1.0, 0.05: 1.0, 0.08: 0.99, 0.1: 0.98, 0.15: 0.9, 0.18: 0.78, 0.2: 0.68}
    texts, cases = [], []
    for share in shares:
        for _ in range(100):
            base = [f"s{r.randrange(10**9)}" for _ in range(r.randint(60, 400))]
            other = random_edits(r, base, int(share * len(base)))
            a, b = " ".join(base), " ".join(other)
            if near(a, b):
                cases.append((share, len(texts)))
                texts += [a, b]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in order_minhash.near_duplicates(df).collect()}
    for share, least in shares.items():
        own = [i for s, i in cases if s == share]
        assert len(own) > 50 and sum(got[i + 1] == i for i in own) >= least * len(own)
    assert all(got[i] == i for _, i in cases)


def test_short_near_copies_are_found(spark):
    """A text of n words with (n - 5) / 6 edits or fewer keeps a run of five words, which is a key of short texts."""
    r = random.Random(9)
    texts = []
    for n in [*range(5, 46)] * 2:
        base = [f"s{r.randrange(10**9)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(random_edits(r, base, (n - 5) // 6))]
    expected = [near(texts[k], texts[k + 1]) for k in range(0, len(texts), 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in order_minhash.near_duplicates(df).collect()}
    assert [got[k + 1] == k for k in range(0, len(texts), 2)] == expected and all(expected)


def test_texts_side_by_side_are_aligned_exactly():
    rng = np.random.default_rng(11)
    assert order_minhash.within([], np.zeros(0)).tolist() == []
    for most_words in (6, 60, 300):
        pairs = []
        for _ in range(60):
            a = rng.integers(0, rng.integers(2, 50), rng.integers(0, most_words + 1)).tolist()
            b = list(a)
            for _ in range(int(rng.integers(0, len(a) // 3 + 2))):
                at = int(rng.integers(0, len(b) + 1))
                b[at : at + int(rng.integers(0, 3))] = rng.integers(0, 50, rng.integers(0, 3)).tolist()
            pairs.append((a, b) if rng.random() < 0.8 else (a, rng.integers(0, 50, rng.integers(0, most_words + 1)).tolist()))
        exact = [edit_distance(a, b) for a, b in pairs]
        for most in ([int(order_minhash.most_edits(max(len(a), len(b)))) for a, b in pairs], exact, [d - 1 for d in exact]):
            got = order_minhash.within([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs], np.array(most))
            assert got.tolist() == [d <= m for d, m in zip(exact, most)]


def test_pairs_just_under_the_threshold_are_aligned_side_by_side(spark, monkeypatch):
    """Texts of one passage and the same other words in different orders pass all bounds; each of their large buckets is a task's group of its own."""
    monkeypatch.setattr(order_minhash, "OWN_GROUP", 32)
    sent, sizes, side_by_side = [], [], order_minhash.within
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInArrow", lambda grouped, compare, schema: sent.append((grouped._df, compare)))
    r = random.Random(4)
    texts = [" ".join([f"p{w}" for w in range(150)] + r.sample([f"w{w}" for w in range(60)], 60)) for _ in range(64)]
    placed = spark.createDataFrame([(key, i, 210, 10 * key, i) for key in range(2) for i in range(64)], "key long, doc_id long, n int, pos int, component long")
    order_minhash._close_pairs(placed, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    (df, compare), = sent
    assert df.where("large").select("group").distinct().count() == 2

    def counted(pairs, most):
        sizes.append(len(pairs))
        return side_by_side(pairs, most)

    monkeypatch.setattr(order_minhash, "within", counted)
    found, keys = set(), df.select("group", "large", "low", "high").distinct().collect()
    for k in keys:
        got = compare(df.where((df.group == k["group"]) & (df.large == k["large"])).toArrow()).to_pylist()
        found |= {tuple(sorted((x["u"], x["v"]))) for x in got if x["linked"]}
    assert sum(sizes) >= 1000 and len(sizes) < sum(sizes) / 20
    assert all(near(texts[u], texts[v]) for u, v in found)


def test_a_worker_lets_go_of_other_operators_tables():
    content = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    packing._word_ids(content)
    common.let_go("tunespark.llm.packing")
    assert packing._word_ids.cache_info().currsize == 1
    common.let_go("tunespark.llm.order_minhash")
    assert packing._word_ids.cache_info().currsize == 0


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc alone gives memory back")
def test_a_worker_gives_freed_memory_back():
    own = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])
    parts = [np.ones(12_000) for _ in range(1_500)]
    parts = parts[-1:]  # the last one pins what lies below it
    full = own()
    common.let_go("tunespark.llm.packing")
    assert len(parts) == 1 and own() < full - 100_000


def test_a_worker_keeps_a_bounded_number_of_words():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = packing.WordIds(f.read())
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(160_000)]
    made = ids.encode([" ".join(words), "aaaa zzzz," * 3])
    assert max(len(ids.words), len(ids.known)) <= 150_000
    assert made[1] == ids.whole("aaaa zzzz," * 3) and made[0][-4000:] == ids.whole(" ".join(words[-3000:]))[-4000:]


def test_pipeline_sends_texts_in_small_batches(spark, monkeypatch):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(3000).selectExpr("id as doc_id", "'a text' as text", "'en' as lang").coalesce(1)
    sizes = lambda df, *_: df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    monkeypatch.setattr(language_id, "keep_identified", sizes)
    monkeypatch.setattr(toxicity, "keep_clean", sizes)
    monkeypatch.setattr(toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(packing, "pieces", sizes)
    monkeypatch.setattr(packing, "materialize", lambda df, name: taken.extend(df.collect()) or docs.selectExpr("doc_id", "0 as piece", "1L as length", "0L as start", "0L as ids_crc32"))
    before = spark.conf.get(key)
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_toxic, corpus_pipeline.pack):
            spark.conf.set(key, 10_000)
            taken = []
            made = stage(spark, docs, SF)
            taken = taken or made.collect()
            assert [r["n"] for r in taken] == [1000] * 3
    finally:
        spark.conf.set(key, before)


def test_bounds_leave_no_pair_out():
    texts = corpus(7)[:150]
    hashed = [order_minhash.words(t) for t in texts]
    n, at = np.array([len(x) for x in hashed]), np.arange(len(texts))
    bags = np.stack([order_minhash.bag(x) for x in hashed])
    i, j, _ = order_minhash.may_align(n, n * 0, at, np.zeros(len(n), int), bags, bags * 0, n < 0, at, at)
    kept = set(zip(i.tolist(), j.tolist()))
    missed = [(a, b) for a in at for b in at[:a] if near(texts[a], texts[b]) and texts[a] != texts[b] and (a, b) not in kept]
    assert not missed and len(kept) < 0.2 * len(n) ** 2


def test_bounds_of_a_text_whose_words_are_not_carried():
    """The front of such a text isn't known: it takes part with its whole bag, whatever stands before the common k-mer."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    pairs = [(base, base[:20] + base[30:]), (base, base[30:])]
    for a, b in pairs:
        h = [order_minhash.words(" ".join(x)) for x in (a, b)]
        n, pos = np.array([len(x) for x in h]), np.array([250, 250 - len(a) + len(b)])
        bags = np.stack([order_minhash.bag(x) for x in h])
        ahead = np.stack([order_minhash.bag(x[:p]) for x, p in zip(h, pos)])
        for known in ([True, True], [False, True], [True, False]):
            front = ahead * np.array(known)[:, None].astype(np.uint16)
            i, j, edits = order_minhash.may_align(n, pos, np.arange(2), np.zeros(2, int), bags, front, np.array(known), np.array([0]), np.array([1]))
            assert len(i) == 1 and edits[0] <= len(a) - len(b)


def moved_passages(r, n, share):
    """A text of n words with a passage that repeats, and a copy with `share` of the words changed, a passage moved and one repeated once more."""
    passage = [f"p{r.randrange(10**6)}" for _ in range(12)]
    base = []
    while len(base) < n:
        base += [f"s{r.randrange(10**6)}" for _ in range(r.randint(5, 60))] + passage
    a = base[:n]
    b = random_edits(r, a, int(share * n))
    at = r.randrange(n // 2)
    piece = b[at : at + n // 50]
    b = b[:at] + b[at + len(piece) :]
    to = r.randrange(len(b))
    return a, b[:to] + piece + passage + b[to:]


def test_texts_of_any_length_are_aligned_exactly(monkeypatch):
    r = random.Random(12)
    seen = []
    for n, share in [(400, x) for x in (0.1, 0.14, 0.16, 0.2)] * 4 + [(900, 0.14), (900, 0.17)]:
        a, b = moved_passages(r, n, share)
        d, most = edit_distance(a, b), int(order_minhash.most_edits(max(len(a), len(b))))
        seen.append(d <= most)
        for brief in (2000, 100):
            monkeypatch.setattr(order_minhash, "BRIEF", brief)
            assert order_minhash.near_copies(order_minhash.Text(" ".join(a)), order_minhash.Text(" ".join(b))) == (d <= most)
        monkeypatch.setattr(order_minhash, "PLACES", 1000)
        assert order_minhash.banded_distance(a, b, d) == d and order_minhash.banded_distance(a, b, d - 1) > d - 1
        monkeypatch.setattr(order_minhash, "PLACES", 1 << 29)
    assert 4 < sum(seen) < len(seen)
    # what is known of long texts: distinct words, some cut out and some put in
    for n in (4000, 20_000):
        a = [f"u{i}" for i in range(n)]
        for cut, near_ in ((n // 5, True), (n // 5 + 1, False)):
            gone = set(r.sample(range(n), cut))
            b = [x for i, x in enumerate(a) if i not in gone]
            assert order_minhash.near_copies(order_minhash.Text(" ".join(a)), order_minhash.Text(" ".join(b))) == near_


def test_long_texts_that_share_a_passage_are_linked_on_either_side_of_what_is_carried(spark):
    r = random.Random(13)
    passage, texts = [f"p{i}" for i in range(1500)], []
    for k, n in enumerate([4100, 4100, 4100, 3900, 4090]):
        own = [f"t{k}-{i}" for i in range(n - 1500)]
        at = r.randrange(len(own))
        a = own[:at] + passage + own[at:]
        gone = set(r.sample(range(n), 10))
        texts += [" ".join(a), " ".join(x for i, x in enumerate(a) if i not in gone)]
    got = {x["doc_id"]: x["component_id"] for x in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_very_long_texts_are_sketched_a_few_sketches_at_a_time(monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(30_000))
    whole = order_minhash.sketches(text)
    monkeypatch.setattr(order_minhash, "SKETCHED", 60_000)
    assert order_minhash.sketches(text) == whole and len(whole[1]) == order_minhash.SKETCHES


def test_near_duplicates_awkward(spark, awkward, empty):
    got = order_minhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    first = {}  # texts of the same words are copies; a null id has no component
    for i, t in enumerate(ODD):
        first.setdefault(tuple(t.lower().split()) or i, i)
    want = {i: first[tuple(t.lower().split()) or i] for i, t in enumerate(ODD)} | {100: 100, None: None}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert order_minhash.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (None, "q r s", "n")]
    kept = order_minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in kept.collect()) == [(0, "n"), (1, "x"), (3, "z")]
    assert kept.columns == ["doc_id", "text", "kept"]


# ------------------------------------------------------------------------------------------------ embeddings


def clustered(n, seed=0, dims=16):
    r = np.random.RandomState(seed)
    x = r.normal(size=(n, dims))
    for i in range(n // 2):
        x[n // 2 + i % (n - n // 2)] = x[r.randint(0, max(1, n // 8))] + r.normal(size=dims) * r.choice([0.02, 0.1, 0.2])
    return x


def test_cover_tree_against_brute_force(spark, monkeypatch):
    x = np.concatenate([clustered(400), clustered(60, 1)[:1].repeat(30, 0)]).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    links = cos >= 0.9
    want = brute_components(range(len(x)), list(zip(*map(list, np.nonzero(links)))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("x"))
    for block in (4096, 64):
        got = {r["vec_id"]: r for r in cover_tree.near_duplicates(df, 0.9, block).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == links.sum(1).tolist()
        assert {i: got[i]["component_id"] for i in range(len(x))} == want
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(9000, 9006))
        assert got[9007]["component_id"] == 9006 and got[9006]["n_links"] == 1
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def brute_links(x, cosine=0.9):
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= cosine
    np.fill_diagonal(links, False)
    return links


def test_cover_tree_around_the_threshold(spark):
    r = np.random.RandomState(3)
    base = r.normal(size=(40, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i in range(3000):
        # at an angle of cosine 0.9, give or take a hair, to one of few vectors
        b = base[i % 40]
        away = r.normal(size=24)
        away -= away @ b * b
        away /= np.linalg.norm(away)
        c = 0.9 + r.choice([1e-13, -1e-13, 1e-9, -1e-9, 1e-7, -1e-7, 1e-5, -1e-5, 0.02, 0.08, 0.0999])
        rows.append(c * b + np.sqrt(1 - c * c) * away)
    x = np.concatenate([base, rows]) * r.choice([1e-200, 1.0, 1e200], size=(3040, 1))
    links = brute_links(x)
    want = brute_components(range(len(x)), list(zip(*map(list, np.nonzero(links)))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (None, 200):
        got = {g["vec_id"]: g for g in cover_tree.near_duplicates(df, 0.9, block).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == links.sum(1).tolist()
        assert {i: got[i]["component_id"] for i in range(len(x))} == want


def test_common_vectors_and_clusters_of_every_width(spark):
    r = np.random.RandomState(8)
    parts = [r.normal(size=(1, 12)) + r.normal(size=(n, 12)) * w for n, w in [(300, 0.02), (300, 0.1), (300, 0.3), (300, 0.8)]]
    x = np.concatenate([*parts, np.ones((2500, 12))]).astype(np.float32)
    links = brute_links(x.astype(np.float64))
    want = brute_components(range(len(x)), list(zip(*map(list, np.nonzero(links)))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {g["vec_id"]: g for g in cover_tree.near_duplicates(df, 0.9, 100).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.sum(1).tolist()
    assert {i: got[i]["component_id"] for i in range(len(x))} == want


# ------------------------------------------------------------------------------------------------ search


def brute_bm25(texts, queries, k):
    words = {i: Counter(bm25_search.WORDS.findall((t or "").lower())) for i, t in texts.items()}
    n, mean = len(texts), sum(sum(w.values()) for w in words.values()) / len(texts)
    df = Counter(t for w in words.values() for t in w)
    out = {}
    for q in queries:
        scores = {}
        for i, w in words.items():
            dl = sum(w.values())
            s = sum(c * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * dl / mean)) for t, c in words[q].items() if t in w)
            if s > 0:
                scores[i] = round(s, 6)
        out[q] = sorted(scores, key=lambda i: (-scores[i], i))[:k]
    return out


def test_search_against_brute_force(spark, docs, awkward, empty, monkeypatch):
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 40)
    monkeypatch.setattr(bm25_search, "QUERY_ROWS", 300)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    queries = docs.where("doc_id % 40 = 0")
    got = defaultdict(list)
    for r in bm25_search.search(docs, queries, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    assert dict(got) == {q: x for q, x in brute_bm25(texts, [i for i in texts if i % 40 == 0], 5).items() if x}
    found = bm25_search.search(awkward, awkward, 3).collect()
    assert {r["query_id"] for r in found} <= set(range(len(ODD)))
    assert bm25_search.search(empty, empty).count() == 0


def test_search_with_ties_repeats_and_common_terms(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 150)
    monkeypatch.setattr(bm25_search, "SHORT", 2)
    r = random.Random(12)
    texts = [" ".join(r.choice(["the", "of", "a"] + [f"w{r.randrange(60)}" for _ in range(4)]) for _ in range(r.randint(0, 25))) for _ in range(150)]
    rows = [(i, texts[r.randrange(150)]) for i in range(500)] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    queries = df.where("doc_id % 10 = 0")
    words = [Counter(bm25_search.WORDS.findall(t or "")) for _, t in rows]
    n, mean, held = len(rows), sum(sum(w.values()) for w in words) / len(rows), Counter(t for w in words for t in w)
    want = []
    for q, text in rows:
        if q is not None and q % 10 == 0:
            own = Counter(bm25_search.WORDS.findall(text or ""))
            found = []
            for (i, _), w in zip(rows, words, strict=True):
                s = sum(c * np.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean)) for t, c in own.items() if t in w)
                if s > 0:
                    found.append((-round(s, 6), -1 if i is None else i))
            want += [(q, i, s) for s, i in sorted(found)[:10]]
    got = [(x["query_id"], -1 if x["doc_id"] is None else x["doc_id"], -x["score"]) for x in bm25_search.search(df, queries, 10).collect()]
    got, want = sorted(got), sorted(want)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_search_destroys_each_blocks_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "QUERY_ROWS", 20)
    made, gone = [], []
    kind = type(spark.sparkContext)
    broadcast = kind.broadcast

    def noted(self, value):
        shared = broadcast(self, value)
        # Only the terms of a block: query, term and weight.
        if isinstance(value, tuple) and len(value) == 3:
            made.append(shared)
            destroy = shared.destroy
            shared.destroy = lambda blocking=False: (gone.append(shared), destroy(blocking))
        return shared

    monkeypatch.setattr(kind, "broadcast", noted)
    r = random.Random(11)
    texts = {i: " ".join(r.choice("abcdefghijklm") for _ in range(8)) for i in range(24)}
    own = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    hits = bm25_search.search(own, own, 3)
    assert len(made) > 1 and list(map(id, gone)) == list(map(id, made))
    got = defaultdict(list)
    for x in hits.orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["doc_id"])
    assert dict(got) == brute_bm25(texts, list(texts), 3)


# ------------------------------------------------------------------------------------------------ packing


def test_recipes_use_all_and_fit():
    r = random.Random(4)
    for most in (16, 64, 256):
        counts = Counter(min(most, max(1, int(r.lognormvariate(2.5, 1)))) for _ in range(500))
        made = packing.recipes(dict(counts), most)
        used = Counter()
        for items, times in made:
            assert sum(items) <= most and times > 0
            for x in items:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in made) <= -(-sum(k * v for k, v in counts.items()) // most) + 2
    assert packing.recipes({}, 8) == []


@pytest.fixture(scope="module")
def word_ids():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.WordIds(f.read())


def test_plain_texts_need_no_encoding_by_words(word_ids, monkeypatch):
    r = random.Random(5)
    parts = ["th", "an", "ing", "ère", "Ü", "ß", "œu", "x", "qu", "LL", "zyz"]
    texts = [" ".join("".join(r.choices(parts, k=r.randint(1, 9))) + r.choice(["", ".", ",!!", "'s", "&&&", "12"]) for _ in range(2000)) for _ in range(5)]
    want, asked = [word_ids.whole(t) for t in texts], []
    for make in ("words", "known"):
        one = getattr(word_ids, make)
        monkeypatch.setattr(one, "make", lambda x, make=one.make: asked.append(x) or make(x))
    monkeypatch.setattr(word_ids, "whole", lambda t, whole=word_ids.whole: asked.append(t) or whole(t))
    assert word_ids.encode(texts) == want
    assert not asked


def test_ids_of_plain_and_odd_texts(word_ids):
    r = random.Random(6)
    points = [f"a{c}b {c} {c}{c} 1{c} .{c}. '{c} {c}'s {c}'ll" for c in map(chr, range(0x250))]
    signs = [a + b + c for a in "!'.<|_-\" a1é\n" for b in "'!|>s1é\t" for c in "'?<|.s1 "]
    endings = ["".join(r.choices(["'s", "'S", "'ll", "'t", "a", "' ", "''", "'re", "!", ".", "s", "1", "ve", "'v", "'d", "<|endoftext|>", "<|ENDOFTEXT|>"], k=r.randint(0, 8))) for _ in range(3000)]
    words = ["".join(r.choices("aeinrstthlo", k=r.randint(1, 40))) for _ in range(3000)]
    own = [x.removesuffix("</w>") for x in word_ids.library.get_vocab() if x.isascii()]
    for texts in (points, signs, endings, words, own, ["a" * n for n in range(1, 700)], ["ab" * 3000, "." * 3000, "1" * 3000], ODD, random_texts(500)):
        assert word_ids.encode(texts) == [word_ids.whole(t) for t in texts]


def test_merges_that_make_one_token_twice_are_left_to_the_library():
    import json

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        made = json.load(f)
    first, again = ["i", "ng"], ["in", "g"]
    assert again in made["model"]["merges"] or first in made["model"]["merges"]
    made["model"]["merges"] += [x for x in (first, again) if x not in made["model"]["merges"]]
    ids = packing.WordIds(json.dumps(made))
    assert ids.merges is None
    assert ids.encode(["Singing, it's a thing", "\u0130"]) == [ids.whole(t) for t in ("Singing, it's a thing", "\u0130")]


def test_pack(spark, docs, awkward, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(random_texts(200) + ["word " * 9000])], "doc_id long, text string")
    for df in (awkward, docs.select("doc_id", "text").unionByName(more)):
        rows = packing.pack(df, P.path("word_bpe_49k.json")).collect()
        pieces = defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
        own = defaultdict(list)
        for r in df.collect():
            own[r["doc_id"]].append(r["text"] or "")
        assert set(pieces) == set(own)
        for i, texts in own.items():
            want = Counter()
            for text in texts:
                ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
                want.update((k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
            assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == want
        placed = defaultdict(list)
        for r in rows:
            placed[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in placed.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 4096
        assert len(placed) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


# ------------------------------------------------------------------------------------------------ sharding


def test_shards(spark, docs, awkward, empty, tmp_path):
    for df in (docs, awkward):
        rows, made = sharding.shard(df)
        got = rows.collect()
        assert len(got) == df.count()
        places = defaultdict(list)
        for r in got:
            places[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in places.values())
        sizes = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    rows, made = sharding.shard(docs)
    load = Counter()
    for r in rows.collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 24
    size = np.random.RandomState(0).lognormal(size=sharding.SLOTS) * 1000
    first = sharding.SlotMap.fresh(24)
    second = first.rebalanced(size)
    load = np.bincount(second.shard, size)
    assert load.max() - load.min() <= 2e-4 * load.mean() and (second.shard != first.shard).mean() < 0.2
    third = second.grown(size)
    moved = third.shard != second.shard
    assert (third.shard[moved] == 24).all() and third.shards == 25 and third.version == 3
    for m in (second, third):
        m.save(spark, str(tmp_path / "map"))
    assert (sharding.SlotMap.load(spark, str(tmp_path / "map")).shard == third.shard).all()
    assert (sharding.SlotMap.load(spark, str(tmp_path / "map"), 2).shard == second.shard).all()
    assert sharding.shard(empty)[0].count() == 0


# ------------------------------------------------------------------------------------------------ classifiers


def test_codewords_stay_apart():
    for n in (2, 3, 4, 6, 20):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2 if n == 3 else 4)


def test_language(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    odd = {r["doc_id"]: r for r in language_id.identify(awkward, model).collect()}
    assert odd[100]["lang_pred"] == odd[0]["lang_pred"] == odd[1]["lang_pred"] == "und" and odd[100]["score"] == 0
    assert language_id.identify(empty, model).count() == 0
    assert language_id.fit(empty) is None and {r["lang_pred"] for r in language_id.identify(awkward, None).collect()} == {"und"}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_label_model_finds_accuracies():
    r = np.random.RandomState(1)
    y = r.rand(4000) < 0.3
    votes = np.stack([np.where(y, r.rand(4000) < a, r.rand(4000) < b) for a, b in [(0.8, 0.05), (0.5, 0.02), (0.6, 0.1)]], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    given = np.where(r.rand(4000) < 0.05, ~y, y).astype(float)
    p, report = toxicity.label_model(votes, given)
    assert ((p > 0.5) == y).mean() > 0.95
    assert abs(report["speaks_if_toxic"][0] - 0.8) < 0.06
    assert report["share"][0] < 0.6 < report["share"][1]


def test_toxicity(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) > 0.85 * len(toxic) and sum(r["predicted"] for r in clean) < 0.01 * len(clean)
    odd = toxicity.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.fit(empty, labels) is None and toxicity.score(empty, None).count() == 0
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns


def test_patterns_of_texts():
    own = {"s t u p i d you": ["~spaced"], "you st*pid": ["~masked"], "an 1di0t here": ["~digits"], "YOUR FILTHY STUPID DOGS": ["~shouting"], "what??? now": ["~signs"], "a plain text, no. 12 of 1999": [], "": []}
    assert {t: toxicity.patterns(t) for t in own} == own
    assert len(toxicity.sampled_terms(" ".join(f"w{i:06d}" for i in range(30_000)))) == 4 * 30_000  # none is left out


def test_two_labels_for_one_document(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i in range(400) for v in ((1, 0) if i % 2 else (0, None))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r["doc_id"] % 2: r["predicted"] for r in toxicity.score(docs, model).collect()} == {0: 0, 1: 1}


def test_every_language_is_learned(spark):
    """Rare languages among very many are predicted too."""
    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3 * 150)]
    rows = [(i, "".join(r.choice(letters[3 * (i % 150) : 3 * (i % 150) + 3]) for _ in range(30)), f"l{i % 150:03d}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(model.languages) == 150
    got = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) > 0.9 * len(got) and len({x["lang_pred"] for x in got}) > 120


def test_mixed_texts_are_flagged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = [x for x in docs.where("lang is not null and length(text) > 300").select("text", "lang").collect()]
    by = defaultdict(list)
    for x in rows:
        by[x["lang"]].append(x["text"][:300])
    names, mixed = sorted(by), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            mixed += [f"{x}\n{y}" for x, y in zip(by[a][:40], by[b][:40])]
    flagged, clean = sum(model.predict(mixed)[2]), sum(model.predict([t for own in by.values() for t in own])[2])
    assert flagged > 0.5 * len(mixed) and clean <= 0.005 * len(rows)


def test_runs_leave_no_near_pair_out():
    r, seen = random.Random(8), [0, 0]
    for _ in range(600):
        a = [f"w{r.randrange(r.choice([4, 30, 3000]))}" for _ in range(r.randint(1, 60))]
        b = random_edits(r, a, r.randint(0, len(a) // 2)) or ["x"]
        most = int(order_minhash.most_edits(max(len(a), len(b))))
        kept = order_minhash.share_runs(order_minhash.Text(" ".join(a)), order_minhash.Text(" ".join(b)), most)
        seen[kept] += 1
        assert kept or edit_distance(a, b) > most
    assert min(seen) > 50


def test_labels_are_never_read_from_the_held_out_fold(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


# ------------------------------------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "toxicity", "near_duplicates", "packing"]
    kept = docs
    for _, stage in stages[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns
        assert kept.join(before, docs.columns, "left_anti").count() == 0
    judged = order_minhash.near_duplicates(kept)
    assert judged.where("not kept").count() == 0
    packed = stages[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_heads_of_vectors_leave_no_link_out(spread):
    """A product of heads is never under that of the vectors; blocks compared by them have the links of brute force; vectors by themselves are a class of their own."""
    from tunespark.llm import cover_tree as C

    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 64)) * np.linspace(3, 0.1, 64)
    x = C.unit((centres[r.integers(0, 40, 700)] + spread * r.normal(size=(700, 64))).astype(np.float32))
    axes = C.main_axes(x[:100])
    assert axes.shape == (64, 24) and C.main_axes(x[:, :16]) is None
    heads = C.head(x, axes)
    assert (heads @ heads.T >= x @ x.T - C.margin(64)).all()
    for shape, least in (((3, 5), 0.5), ((7, 64), -2.0), ((1, 8), 2.0), ((2, 4), 0.9)):
        product = r.random(shape).astype(np.float32)
        assert all((p == q).all() for p, q in zip(C.hits(product, least), np.nonzero(product >= np.float32(least)), strict=True))

    def block(low, high, axes):
        order, starts = C.tree(x[low:high].astype(np.float32))
        return C.Tree(x[low:high][order], np.arange(low, high)[order], np.ones(high - low, np.int64), starts, axes)

    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    for own in (None, axes):
        a, b = block(0, 400, own), block(400, 700, own)
        ids, count, _ = C.dual(a, b, 0.9).rows()
        assert dict(zip(ids.tolist(), count.tolist(), strict=True)) == {i: n for i, n in enumerate(np.concatenate([near[:400, 400:].sum(1), near[400:, :400].sum(1)]).tolist()) if n}
        ids, count, _ = C.dual(a, a, 0.9).rows()
        assert dict(zip(ids.tolist(), count.tolist(), strict=True)) == {i: n for i, n in enumerate(near[:400, :400].sum(1).tolist()) if n}
    sizes = a.end[3] - a.first[3]
    assert set(np.flatnonzero(sizes == 1)) <= set(a.classes(3)[0])


def test_vectors_without_structure_are_not_opened_node_by_node():
    from tunespark.llm import cover_tree as C

    def starts(x):
        x, reach = C.unit(x.astype(np.float32)), 0.2**0.5
        order, firsts = C.tree(x.astype(np.float32))
        t = C.Tree(x[order], np.arange(len(x))[order], np.ones(len(x), np.int64), firsts)
        level = C.first_level(t, t, lambda r: 1 - np.minimum(r + reach, 2.0) ** 2 / 2, lambda r: np.where(reach > r, 1 - (reach - r) ** 2 / 2, np.inf))
        return len(t.first[level])

    r = np.random.default_rng(4)
    assert starts(r.normal(size=(3000, 24))) > 2900  # not at the 503 wide nodes of the first net
    assert starts(np.repeat(np.eye(24), 200, 0) + 0.005 * r.normal(size=(4800, 24))) == 24
