"""Decontamination, vector codes and the conversation trie against brute force, and awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunespark.llm import heap_lloyd, prefix_trie, winnowing
from tunespark.llm import queries as registered

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


# ------------------------------------------------------------------------------------------------ decontamination


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_contamination(docs, items):
    keys = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            keys[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in keys}
    out = []
    for doc_id, text in docs:
        w, hit, owners = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = keys.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    owners |= own
        ids = sorted(str(x) for x in owners if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contaminated(spark, docs, items, monkeypatch):
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("found", F.lit("x")),
        "benchmark": spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit(3)),
    }
    monkeypatch.setattr(registered, "read", lambda spark, d, t: tables[t])
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in registered.op11_decontamination(spark, "").collect()), key=str)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(winnowing, "BROADCAST_WINDOWS", few)
    r = random.Random(11)
    vocabulary = ["the", "of", "naïve", "日本", "x1", "Über", "A", "42", "long" * 40]

    def text(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", "-", ", ", "\n", "\x00"]) for _ in range(n))

    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(30)] + [(3, text(12)), (None, text(12)), (50, None), (51, "?!"), (52, "one two THREE")]
    docs = []
    for i in range(150):
        parts = [text(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + r.randint(0, 20)]).upper() if r.random() < 0.5 else " ".join(w), text(r.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(0, docs[0][1]), (1, "another text, one two three"), (None, docs[3][1]), (None, docs[4][1]), (900, None), (901, ""), (902, text(30_000) + docs[5][1])]
    want = brute_contamination(docs, items)
    assert contaminated(spark, docs, items, monkeypatch) == want
    assert sum(x[5] for x in want) > 50


def test_contamination_without_rows(spark, monkeypatch):
    items = [(1, "a b c d e f g h i j k")]
    assert contaminated(spark, [], items, monkeypatch) == []
    docs = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i"), (None, None)]
    assert contaminated(spark, docs, [], monkeypatch) == brute_contamination(docs, [])
    assert contaminated(spark, docs, items, monkeypatch) == brute_contamination(docs, items)


def test_spans_and_filtering(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e f g h i j z z", "s"), (2, "nothing", "s")], "doc_id long, text string, items string")
    items = spark.createDataFrame([("q", "A b c d e f g h i j")], "item_id string, text string")
    rows = {x["doc_id"]: x for x in winnowing.contamination(docs, items).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(2, 12)] and rows[1]["items"] == ["q"] and rows[2]["spans"] == []
    assert [x["doc_id"] for x in winnowing.decontaminate(docs, items).collect()] == [2]
    assert winnowing.decontaminate(docs, items, most=0.9).columns == docs.columns


def test_every_shared_window_has_one_fingerprint():
    r = np.random.RandomState(3)
    for _ in range(50):
        shared = b" ".join(b"w%d" % x for x in r.randint(0, 50, 10))
        made = []
        for _ in range(2):
            data = np.frombuffer(b" ".join([b"w%d" % x for x in r.randint(0, 50, 20)] + [shared] + [b"w%d" % x for x in r.randint(0, 50, 20)]), np.uint8)
            w = winnowing.Words(data, np.array([len(data)]))
            begin, prints, whole = w.windows(10, 5)
            made.append((prints[20], whole[20]))
            assert w.counts.tolist() == [50] and begin.tolist() == list(range(41))
        assert made[0] == made[1]


def test_words_in_parts(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    texts = ["".join(r.choice("aB9é日 -.\x00") for _ in range(r.choice([0, 3, 50, 900]))) for _ in range(60)] + [None, "x" * 500, ""]
    whole = [(w.counts.tolist(), w.hashes[0].tolist(), w.hashes[1].tolist()) for _, w in winnowing.batched(pa.array(texts))]
    monkeypatch.setattr(winnowing, "BATCH_BYTES", 300)
    monkeypatch.setattr(winnowing, "HASH_BYTES", 64)
    parts = list(winnowing.batched(pa.array(["before", *texts]).slice(1)))
    assert len(whole) == 1 and len(parts) > 10
    assert [n for _, w in parts for n in w.counts.tolist()] == whole[0][0] == [len(words(t)) for t in texts]
    for k in (0, 1):
        assert [h for _, w in parts for h in w.hashes[k].tolist()] == whole[0][1 + k]
    by_word = defaultdict(set)
    for word, h in zip((x for t in texts for x in words(t)), whole[0][1]):
        by_word[h].add(word)
    assert all(len(x) == 1 for x in by_word.values())


# ------------------------------------------------------------------------------------------------ vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry in every round, in whole numbers."""
    kept = [(i, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = np.array([v for _, v, _ in kept], object).reshape(len(kept), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def assign():
        return np.array([[min(range(len(books[p])), key=lambda j: (sum((cut[i, p] - books[p][j]) ** 2), j)) for p in range(parts)] for i in range(len(cut))])

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                if (own[:, p] == j).any():
                    books[p][j] = cut[own[:, p] == j, p].sum(0) // int((own[:, p] == j).sum())
    own = assign()
    errors = [int(sum(sum((cut[i, p] - books[p][own[i, p]]) ** 2) for p in range(parts))) for i in range(len(cut))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return sorted((i, "".join(f"{j:02x}" for j in a), e, by_label[label], sha) for (i, _, label), a, e in zip(kept, own, errors))


def coded(spark, rows, monkeypatch, kind="array<float>"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").withColumn("code", F.lit(1)).withColumn("size", F.lit("x")).repartition(3)
    monkeypatch.setattr(registered, "read", lambda spark, d, t: table)
    got = registered.op12_vector_codes(spark, "")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block", [4096, 17])
def test_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(heap_lloyd, "BLOCK", block)
    r = np.random.RandomState(5)
    centres = r.randn(6, 16)
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.3 * r.randn(16)).astype(np.float32)], [0, None, 1, 1][i % 4]) for i in range(160)]
    rows += [(1000 + i, [0.0] * 16, 1) for i in range(60)] + [(2000 + i, [float(x) / 4096 for x in r.randint(-2, 3, 16)], 2) for i in range(60)]
    rows += [(3000, None, 1), (3001, [0.1] * 15 + [None], 1), (3002, [0.1] * 15 + [float("nan")], None), (3003, [float("-inf")] * 16, 0)]
    assert coded(spark, rows, monkeypatch) == brute_codes(rows)


def test_few_repeated_and_no_vectors(spark, monkeypatch):
    few = [(i, [float(i % 3) + j / 10 for j in range(8)], None) for i in range(5)]
    assert coded(spark, few, monkeypatch) == brute_codes(few)
    assert coded(spark, few[:1], monkeypatch) == brute_codes(few[:1])
    twice = [(7, [0.5] * 8, 1)] * 40 + [(8, [0.25] * 8, 1)] * 3
    assert coded(spark, twice, monkeypatch) == brute_codes(twice)
    assert coded(spark, [], monkeypatch) == [] and coded(spark, [(1, None, 1)], monkeypatch) == []
    null_id = [(None, [1.0] * 8, 1), (4, [0.0] * 8, 1)]
    table = spark.createDataFrame(null_id + [(5, [1.0] * 16, 1), (6, [], 1)], "vec_id long, embedding array<float>, label int")
    rows = {x["vec_id"]: x for x in heap_lloyd.compress(table)[0].collect()}
    assert rows[4]["code"] == "00" * 8 and rows[None]["code"] == "01" * 8 and rows[5]["code"] is None and rows[6]["error"] is None
    with pytest.raises(ValueError, match="equal parts"):
        heap_lloyd.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))


def test_heaps_hold_what_is_not_compared():
    """Each round gives the assignment that comparing everything gives, and later rounds pop a part of all parts only."""
    r = np.random.RandomState(2)
    x = r.randint(-3000, 3000, (3000, 2, 4)).astype(np.int16)
    books = x[:16].transpose(1, 0, 2).astype(np.int64)
    block = heap_lloyd.Block(x, 16)
    block.start(books)
    drift, popped, sums = np.zeros((2, 16)), [], np.zeros((2, 16, 5), np.int64)
    for _ in range(6):
        sums += block.delta
        before, books = books, sums[:, :, :-1] // sums[:, :, -1:]
        drift = drift + heap_lloyd.drifts(before, books)
        state = dict(zip(("size", "bytes", "x", "keys", "members", "lengths"), block.state()))
        block = heap_lloyd.Block.load(state, 2, 16)
        popped.append(block.round(books, drift))
        for p in range(2):
            assert (block.assignment()[:, p] == heap_lloyd.nearest(x[:, p], books[p])[0]).all()
    assert popped[-1] < 0.7 * 6000 and all(keys[0] == keys.min() for keys, _ in block.heaps if len(keys))


def test_codes_decode_near_their_vectors(spark):
    r = np.random.RandomState(1)
    table = spark.createDataFrame([(i, [float(x) for x in np.repeat(r.randint(0, 2, 8), 2)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int")
    out, books = heap_lloyd.compress(table)
    rows = heap_lloyd.decode(out.drop("label"), books).join(table, "vec_id").collect()
    assert len(rows) == 60 and all(np.abs(np.array(x["decoded"]) - x["embedding"]).max() < 1e-3 for x in rows)


# ------------------------------------------------------------------------------------------------ conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].add(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = Counter(), Counter()
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(members[path]) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ) if members else []


def nodes_of(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("path", F.lit(1)).repartition(5)
    monkeypatch.setattr(registered, "read", lambda spark, d, t: table)
    return sorted(tuple(r) for r in registered.op13_conversation_trie(spark, "").collect())


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, monkeypatch, many_ranges, seed):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    monkeypatch.setattr(prefix_trie, "BROADCAST_BORDERS", 500_000 if seed == 1 else 0)
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 120), *range(205, 260), 300, 301, 5000, *range(9900, 9950)]:
        turns = [(r.choice(["user", "assistant", None]), r.choice(["a", "ab", "é日", None])) for _ in range(r.choice([1, 1, 2, 4, 9]))]
        if c % 3 == 0:
            turns = [("user", "the very same")] * 7
        if c % 7 == 1:
            turns = [("user", "the very same")] * 6 + [("assistant", str(c % 4))] + turns
        if c == 301:
            turns = turns * 60
        rows += [(c, i if i or r.random() < 0.7 else None, *t) for i, t in enumerate(turns)]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, None, "other"), (None, 1, "user", "nobody"), (8, None, None, None)]
    assert nodes_of(spark, rows, monkeypatch) == brute_trie(rows)


def test_trie_without_turns(spark, monkeypatch):
    assert nodes_of(spark, [], monkeypatch) == [] and nodes_of(spark, [(None, 0, "user", "x")], monkeypatch) == []
    alone = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "hi") for c in alone]
    got = nodes_of(spark, rows, monkeypatch)
    assert got == brute_trie(rows) and len(got) == 1 and got[0][:6] == (alone[0], 0, None, 3, 0, 1)
    long = [(1, 0, "user", "é" * 100_000), (2, 0, "user", "é" * 100_000), (0, 0, "user", "x" * 50)]
    assert nodes_of(spark, long, monkeypatch) == brute_trie(long)


def test_merge_compares_nothing_twice(monkeypatch):
    """Runs of any number and size come out in order with the turns that neighbours share, from disk too; shared turns are skipped."""
    r = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        paths = list({b"".join(bytes([r.randrange(2)]) * prefix_trie.DIGEST for _ in range(r.randrange(9))) for _ in range(60)})
        rows = [(p, b"", i, 1, "") for i, p in enumerate(paths)]
        runs = [prefix_trie.sorted_run(rows[i::k]) for i in range(k)] if k else []
        if k == 5:
            runs = [prefix_trie.spilled(x) for x in runs]
            assert [next(x) for x in runs] == [None] * k
        got = list(prefix_trie.merge(runs)) if runs else []
        want = sorted(rows) if runs else []
        assert [x for _, x in got] == want
        assert [n for n, _ in got] == [prefix_trie.shared(a[0], b[0]) for a, b in zip([(b"",), *want], want)]
    deep = b"".join(i.to_bytes(prefix_trie.DIGEST, "big") for i in range(2000))
    seen = []
    monkeypatch.setattr(prefix_trie, "shared", lambda a, b, known=0, f=prefix_trie.shared: seen.append(known) or f(a, b, known))
    runs = [iter([(0, (deep + bytes([j]) * prefix_trie.DIGEST,)), (2000, (deep + bytes([j + 4]) * prefix_trie.DIGEST,))]) for j in range(4)]
    assert len(list(prefix_trie.merge(runs))) == 8
    assert sum(k == 0 for k in seen) == 3 and all(k in (0, 2000) for k in seen)


def test_sorted_rows_by_way_of_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 3000)
    r = random.Random(8)
    paths = list({bytes(r.randrange(3) for _ in range(1)) * prefix_trie.DIGEST * r.randrange(5) + bytes([i]) * prefix_trie.DIGEST for i in range(200)})
    batch = pa.table({"path": paths, "sizes": [b""] * len(paths), "least": range(len(paths)), "n": [1] * len(paths), "ends_sha256": ["x"] * len(paths)}).to_batches()
    assert [row[0] for _, row in prefix_trie.sorted_rows(iter(batch))] == sorted(paths)
    assert list(prefix_trie.sorted_rows(iter([]))) == []
