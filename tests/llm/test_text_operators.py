import base64
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tilewright.llm import decontam, partenum, ranks, sharding, sketch, suffixdedup, textbytes  # noqa: E402

SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a shared passage, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(5)
    passage = words(rng, 90, 10_000)
    docs = [(i, words(rng, rng.randrange(1, 120), 5_000)) for i in range(40)]
    for i in range(12):
        base = docs[i][1].split()
        for k in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 20) + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            docs.append((100 + 4 * i + k, " ".join(w)))
    docs += [(200 + k, words(rng, 40, 9_000) + " " + passage + " " + words(rng, 30, 9_000)) for k in range(25)]
    docs += [(300, None), (301, ""), (302, " \n\t "), (303, "One"), (304, "one"), (305, "one two"), (None, docs[0][1]), (0, docs[0][1]), (0, docs[0][1]), (306, words(rng, 9_000, 9_000))]
    docs += [(307, "ab " * 400), (308, "ÉÀ é à " + "ab " * 400), (309, docs[45][1].upper())]
    return docs


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, SCHEMA).withColumn("n", F.lit(1)).withColumn("node", F.lit("x")).repartition(parts)


def test_decontamination(spark, corpus):
    bench = [(1, " ".join(corpus[60][1].split()[:30]).upper() + "."), (2, "one"), (3, None), (4, ""), (10, "One, two!"), (11, corpus[3][1]), (12, corpus[3][1]), (None, "ab ab")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.contamination(frame(spark, corpus), items).collect()
    # A null id takes no part in the set of ids, but its windows hit.
    want = brute.decontam(corpus, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in got), key=repr) == [x[:3] for x in want]
    assert sorted(((r.doc_id, tuple(r["items"])) for r in got), key=repr) == sorted(((x[0], tuple(i for i in x[3] if i is not None)) for x in brute.decontam(corpus, bench)), key=repr)
    assert sum(r.n_hit > 0 for r in got) >= 10


def test_decontamination_in_several_passes(spark, corpus, monkeypatch):
    bench = [(k, t) for k, (_, t) in enumerate(corpus[:20])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 3_000)
    got = decontam.contamination(frame(spark, corpus), items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=repr) == brute.decontam(corpus, bench)


def test_decontamination_of_nothing(spark, corpus):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(frame(spark, corpus), items).filter("n_hit > 0").isEmpty()
    assert decontam.contamination(frame(spark, corpus).limit(0), items).isEmpty()
    assert decontam.clean(frame(spark, corpus), items).columns == ["doc_id", "text", "n", "node"]


@pytest.mark.parametrize("often", [1, 16, 10_000])
def test_jaccard_join(spark, corpus, monkeypatch, often):
    monkeypatch.setattr(partenum, "FREQUENT", often)
    got = partenum.jaccard_components(frame(spark, corpus))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute.jaccard(corpus)


@pytest.mark.parametrize(("block", "cost"), [(256, 200), (3, 200), (3, 0), (256, 10**9)])
def test_every_link_is_counted_once(spark, corpus, monkeypatch, block, cost):
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "SEARCH_COST", cost)
    monkeypatch.setattr(partenum, "COLUMNS", 64)
    base = words(random.Random(14), 60, 9_000).split()
    docs = corpus + [(400 + k, " ".join([*base, f"end{k}"])) for k in range(4)]
    sets = {frozenset(brute.shingles(t)) for _, t in docs} - {frozenset()}
    near = {a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in sets) for a in sets}
    want = sorted(((i, near.get(frozenset(brute.shingles(t)), 0)) for i, t in docs), key=repr)
    got = sorted(((r.doc_id, r.n_links) for r in partenum.jaccard_components(frame(spark, docs)).collect()), key=repr)
    assert got == want and [n for i, n in got if i in (400, 401, 402, 403)] == [3, 3, 3, 3]


@pytest.mark.parametrize("cost", [0, 200, 10**9])
def test_links_of_lesser_centers_are_counted_there(monkeypatch, cost):
    monkeypatch.setattr(partenum, "SEARCH_COST", cost)
    sets = [np.arange(30, dtype=np.uint64) for _ in range(4)]
    found, n = partenum.links_in(np.arange(4), np.zeros(4, int), sets, [[], [5, 6], [6, 7], [7]], False, 75)
    assert n.tolist() == [3, 2, 1, 2]
    assert partenum.links_in(np.arange(4), np.array([0, 0, 1, 1]), sets, [[]] * 4, True, 75)[1].tolist() == [2, 2, 2, 2]


def test_jaccard_join_of_nothing(spark, corpus):
    assert partenum.jaccard_components(frame(spark, corpus).limit(0)).isEmpty()
    assert partenum.one_of_each(frame(spark, [(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("block", [256, 3])
def test_one_of_each(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    rest = partenum.one_of_each(frame(spark, corpus))
    assert rest.columns == ["doc_id", "text", "n", "node"]
    want = {i for i, n, c in brute.jaccard(corpus) if i == c or not n}
    assert sorted(r.doc_id for r in rest.collect()) == sorted(want)


def test_one_of_each_with_null_and_shared_ids(spark):
    """Rows that only share an id, or have none, stay; copies among them leave one row."""
    rng = random.Random(12)
    a, b, c, d, e, f = (words(rng, 40, 9_000) for _ in range(6))
    near = "start " + a
    docs = [(1, a), (None, near), (None, b), (None, c), (None, c), (None, None), (None, ""), (None, ""), (7, d), (7, e), (7, near), (3, e), (None, f), (7, b)]
    rest = partenum.one_of_each(frame(spark, docs))
    want = [(1, a), (7, b), (None, c), (None, None), (None, ""), (None, ""), (7, d), (3, e), (None, f)]
    assert sorted(((r.doc_id, r.text) for r in rest.collect()), key=repr) == sorted(want, key=repr)


def test_clean_with_null_and_shared_ids(spark):
    rng = random.Random(13)
    a, b, c = (words(rng, 40, 9_000) for _ in range(3))
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = [(None, a), (None, b), (None, None), (None, ""), (5, a + " x"), (5, c), (5, c)]
    rest = decontam.clean(frame(spark, docs), items)
    assert rest.columns == ["doc_id", "text", "n", "node"]
    assert sorted(((r.doc_id, r.text) for r in rest.collect()), key=repr) == sorted([(None, b), (None, None), (None, ""), (5, c), (5, c)], key=repr)


def test_signatures_lose_no_pair():
    """Sets at the very bound, of sizes on both sides of band borders, share a signature."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 7, 11, 15, 16, 47, 48, 60, 63, 64, 65, 190, 250, 256, 900):
        for _ in range(6):
            a = rng.integers(0, 1 << 48, size).astype(np.uint64)
            other = rng.integers(size * 3 // 4 + (size * 3 % 4 > 0), size * 4 // 3 + 1)
            inter = -(-3 * (size + other) // 7)
            if inter > min(size, other):
                continue
            b = np.concatenate((a[:inter], rng.integers(0, 1 << 48, other - inter).astype(np.uint64)))
            for often in (np.zeros(0, np.uint64), np.sort(a[: size // 3]), np.sort(a)):
                sizes = np.array([len(a), len(b)])
                row, sig = partenum.signatures_of(sizes, np.repeat([0, 1], sizes), np.concatenate((a, b)), often)
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (size, other)


def test_word_hashes_and_shingles():
    import pyarrow as pa

    texts = ["A b", "a  B\n", "", None, "a b c d e f", "x a b c d e f", "ab", "é É"]
    (at, data, offsets), = textbytes.runs(pa.array(texts))
    row, h = textbytes.words(data, offsets)
    assert row.tolist() == [0, 0, 1, 1, *[4] * 6, *[5] * 7, 6, 7, 7]
    assert h[0] == h[2] and h[1] == h[3] and h[-1] != h[-2]
    at, s = textbytes.shingles(row, h, 5, len(texts))
    sets = [set(s[at == k].tolist()) for k in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[4]) == 2 and sets[4] < sets[5] and not sets[2] and not sets[3]


def test_suffix_array():
    rng = random.Random(2)
    for k in range(200):
        raw = bytes(rng.choice(b"ab" if k % 2 else b"abcz\x00\xff") for _ in range(rng.randrange(0, 50)))
        got = suffixdedup.two_stage_suffix_array(np.frombuffer(raw, np.uint8))
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert got.tolist() == want
        some = np.array(sorted(rng.sample(range(len(raw)), len(raw) // 3)), np.int64)
        got = suffixdedup.two_stage_suffix_array(np.frombuffer(raw, np.uint8), starts=some)
        assert [i for i in got.tolist() if i in some] == [i for i in want if i in some]


@pytest.mark.parametrize(("group", "broadcast"), [(128 << 10, 32 << 20), (2_000, 0), (900, 32 << 20), (0, 32 << 20)])
def test_suffix_dedup(spark, corpus, monkeypatch, group, broadcast):
    """Groups of any size: compared whole, by classes, and down to single strings."""
    monkeypatch.setattr(suffixdedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffixdedup, "BROADCAST_BYTES", broadcast)
    got = suffixdedup.without_repeats(frame(spark, corpus)).collect()
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr)
    assert rows == brute.repeats(corpus)
    assert sum(r[2] > 0 for r in rows) > 25


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    part = "".join(rng.choice("abcdef") for _ in range(700))
    docs = [(1, part + "".join(rng.choice("abcdef") for _ in range(3_000)) + part), (2, "é" + part[100:650]), (3, part[:399]), (4, "a" * 900)]
    monkeypatch.setattr(suffixdedup, "PIECE", 512)
    got = suffixdedup.without_repeats(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute.repeats(docs)
    assert suffixdedup.without_repeats(frame(spark, docs).limit(0)).isEmpty()


def test_suffix_dedup_when_first_hashes_collide(spark, corpus, monkeypatch):
    """Texts are the same only if both hashes are."""
    monkeypatch.setattr(suffixdedup, "identity", lambda text: (F.xxhash64(F.lit("all")), F.xxhash64(F.lit(1), text)))
    got = suffixdedup.without_repeats(frame(spark, corpus)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == brute.repeats(corpus)


def test_sharding(spark, corpus):
    got = sharding.shard(frame(spark, corpus), 4, seed=3).collect()
    again = sharding.shard(frame(spark, corpus, 7), 4, seed=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    counts = [sum(r.shard == k for r in got) for k in range(4)]
    assert sum(counts) == len(corpus) and max(counts) - min(counts) <= 1
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert sorted(r.row_number for r in got) == list(range(len(corpus)))
    assert all(sharding.place_of(r.row_number, len(corpus), 4, 3) == (r.shard, r.slot) for r in got)
    assert sharding.shard(frame(spark, corpus).limit(0)).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1_000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 1)).collect()]
    assert sorted(got) == list(range(n))


def test_fingerprints(spark, corpus):
    rows = {r.text: r for r in frame(spark, corpus).select("text", sketch.sketch(F.col("text")).alias("s"), sketch.distinct_count(sketch.sketch(F.col("text"))).alias("d")).collect()}
    for t, r in rows.items():
        true = len(brute.shingles(t, lower=False))
        assert len(r.s) == min(true, sketch.K) and abs(r.d - true) <= 0.35 * true
    halves = spark.createDataFrame([("g", "a b c d e f g"), ("g", "c d e f g h i j"), ("h", None)], "g string, t string")
    merged = sketch.merge_sketches(halves.select("g", sketch.sketch(F.col("t")).alias("s")), "g", "s").collect()
    assert [(r.g, len(r.sketch)) for r in merged] == [("g", 6)]
    a, b = F.col("a"), F.col("b")
    pair = spark.createDataFrame([("a b c d e f g", "a b c d e f"), (None, ""), ("x", None)], "ta string, tb string").select(sketch.sketch(F.col("ta")).alias("a"), sketch.sketch(F.col("tb")).alias("b"))
    got = pair.select(sketch.resemblance(a, b), sketch.containment(b, a)).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(2 / 3), pytest.approx(1.0)), (1.0, None), (0.0, None)]


@pytest.mark.parametrize(("listed", "size"), [(4_096, 64), (3, 5), (1, 4)])
def test_next_document(spark, corpus, monkeypatch, listed, size):
    """Ids in a list of ranges, and in ranges that are cut again."""
    monkeypatch.setattr(sketch, "LISTED", listed)
    monkeypatch.setattr(sketch, "ROWS_PER_RANGE", size)
    got = sketch.with_next(frame(spark, corpus)).collect()
    order = sorted(((-(1 << 63) if i is None else i), t or "") for i, t in corpus)
    want = sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    rows = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id), r.text, r.next_text) for r in got)
    # Rows that are equal in id and text follow each other in either order.
    assert [r[:2] for r in rows] == [r[:2] for r in want] and sorted(r[2] for r in rows) == sorted(r[2] for r in want)
    assert [r for r in rows if r[0] > 0] == [r for r in want if r[0] > 0]
    assert sketch.with_next(frame(spark, corpus).limit(0)).isEmpty()
    assert [r.next_text for r in sketch.with_next(frame(spark, [(7, "only")])).collect()] == ["only"]


def test_fingerprint_text(spark, corpus):
    """Equal texts have equal fingerprints; a fingerprint holds its sketch's hashes, six bytes each."""
    got = sketch.fingerprints(frame(spark, corpus)).collect()
    by_text = {}
    for r in got:
        raw = base64.b64decode(r.fingerprint)
        assert [int.from_bytes(raw[k : k + 6], "big") for k in range(0, len(raw), 6)] == list(r.sketch)
    texts = frame(spark, corpus).select("text", sketch.encoded(sketch.sketch(F.col("text"))).alias("f")).collect()
    for r in texts:
        assert by_text.setdefault(r.text or "", r.f) == r.f
    assert len(set(by_text.values())) > 60


def test_many_equal_rows_are_numbered(spark, monkeypatch):
    """Repeated rows of one id, over the number that one task numbers, have gapless places; so has a table in many buckets."""
    monkeypatch.setattr(ranks, "HOT", 20)
    monkeypatch.setattr(ranks, "BLOCK", 4)
    docs = [(1, "same")] * 90 + [(None, None)] * 40 + [(k, f"text {k}") for k in range(300)]
    got = sharding.shard(frame(spark, docs), 7).collect()
    again = sharding.shard(frame(spark, docs, 5), 7).collect()
    assert sorted(r.row_number for r in got) == list(range(len(docs)))
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_sharded_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, {"k": 1}), (2, None, 7, 8, None)], "doc_id long, text string, shard int, row_number int, size map<string,int>")
    got = sharding.sharded_documents(docs, 2)
    assert got.columns == ["doc_id", "text", "shard", "row_number", "size", "_shard", "slot"]
    assert sorted((r.doc_id, r.shard, r.row_number, r["size"]) for r in got.collect()) == [(1, 5, 6, {"k": 1}), (2, 7, 8, None)]


def test_contamination_of_passages_that_all_items_share(spark):
    rng = random.Random(21)
    shared = words(rng, 12, 9_000)
    bench = [(k, shared + f" own{k} " + words(rng, 3, 9_000)) for k in range(40)]
    docs = [(k, words(rng, 20, 9_000) + " " + shared + " " + words(rng, 20, 9_000)) for k in range(10)] + [(100, words(rng, 50, 9_000)), (None, shared), (100, None)]
    got = decontam.contamination(frame(spark, docs, 1), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=repr) == brute.decontam(docs, bench)
