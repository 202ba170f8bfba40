"""Spelling variants, repeated passages and periodic runs against plain Python."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tilewright.llm import debruijn, periodic, queries, spelling  # noqa: E402

SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, docs, parts=3):
    """The documents with columns that have names the operators use inside."""
    return spark.createDataFrame(docs, SCHEMA).withColumn("node", F.lit("x")).withColumn("start", F.lit(1)).withColumn("n", F.lit(2)).withColumn("_bytes", F.lit(3)).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        w = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(0, 60))]
        if w and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randrange(1, 9)
            w = w[:a] + [w[a + (k - a) % min(p, len(w) - a)] for k in range(a, a + rng.randrange(1, 60))] + w[a:]
        texts.append(w)
    size = [len(w) for w in texts]
    start, end, period = periodic.periodic_runs(np.repeat(np.arange(len(texts)), size), np.array([x for w in texts for x in w], np.int64))
    edge = np.cumsum([0, *size])
    for k, w in enumerate(texts):
        own = (start >= edge[k]) & (start < edge[k + 1])
        got = sorted(zip((start - edge[k])[own].tolist(), (end - start)[own].tolist(), period[own].tolist(), strict=True))
        assert got == brute.periodic(w, 2, 2), w


def test_fibonacci_words_and_one_long_run():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for w in (b, [1] * 5_000, [1, 2, 3] * 900 + [9], [7]):
        got = periodic.periodic_runs(np.zeros(len(w), int), np.array(w))
        if len(w) < 1_000:
            assert [(s, e - s, p) for s, e, p in zip(*(x.tolist() for x in got), strict=True)] == brute.periodic(w, 2, 2)
    assert [x.tolist() for x in periodic.periodic_runs(np.zeros(5_000, int), np.ones(5_000, int))] == [[0], [5_000], [1]]
    assert all(len(x) == 0 for x in periodic.periodic_runs(np.zeros(0, int), np.zeros(0, int)))


def periodic_docs():
    rng = random.Random(3)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 90), rng.choice((2, 5, 400))))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (None, "ab " * 40), (None, None), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(204, "É é " * 30 + "x"), (205, " ".join(words(rng, 20_000, 20_000) + ["la", "li"] * 50)), (206, "a a a a a a"), (207, "a a a a a"), (208, "b c b c b c b c")]
    return docs


def test_periodic_query(spark, tmp_path):
    docs = periodic_docs()
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, w in brute.planted(docs):
        runs = brute.periodic(w)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], sha(lines), sha(brute.collapsed(w, runs) if runs else " ".join(w))))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 20


def test_collapsed_runs_of_odd_tables(spark):
    docs = frame(spark, periodic_docs())
    assert periodic.collapsed_runs(docs.limit(0)).isEmpty()
    assert periodic.collapsed_runs(docs).columns == [*docs.columns, "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError, match="runs"):
        periodic.collapsed_runs(docs.withColumn("runs", F.lit(1)))


# Spelling


def spelling_docs():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    vocabulary = list(base)
    for w in base:
        for _ in range(3):
            k = rng.randrange(len(w))
            vocabulary.append(rng.choice((w[:k] + rng.choice("abcxyz") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxyz") + w[k + 1 :])))
    weight = [rng.choice((1, 2, 9)) for _ in vocabulary]
    docs = [(i, " ".join(w.upper() if w.isascii() and rng.random() < 0.1 else w for w in rng.choices(vocabulary, weight, k=rng.randrange(1, 60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (None, "aaaaa aaaaa, aaaab aaaaa4aaaab;aaaab"), (302, "×÷×÷× Ünïcode 漢字aaaaa漢aaaaa"), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(303, "x" * 3_000 + " " + "y" * 3_000), (304, "x" * 3_000 + " " + "x" * 2_999), (305, "x" * 3_000), (306, ("x" * 2_999 + " ") * 6)]
    return docs


@pytest.mark.parametrize("block", [2_048, 8])
def test_spelling_variants(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = spelling_docs()
    got = sorted(map(tuple, spelling.spelling_variants(frame(spark, docs)).collect()))
    want = brute.spelling(docs)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_of_nothing(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "short one")])
    assert spelling.spelling_variants(docs).isEmpty() and spelling.spelling_variants(docs.limit(0)).isEmpty()


def test_words_of_one_half(spark, monkeypatch):
    """A half that most words share is cut into parts that all meet."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(2)
    vocabulary = sorted({"prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(5, 8))) for _ in range(150)})
    docs = [(k, " ".join(vocabulary)) for k in range(4)]
    assert sorted(map(tuple, spelling.spelling_variants(frame(spark, docs)).collect())) == brute.spelling(docs)


# Repeated passages


def passage_docs():
    rng = random.Random(5)
    passage, line = words(rng, 60, 9_000), words(rng, 24, 9_000)
    docs = [(i, " ".join(words(rng, rng.randrange(1, 90), 5_000))) for i in range(40)]
    for i in range(14):
        w = docs[i][1].split()
        for k in range(4):
            v = list(w)
            if k:
                v[rng.randrange(len(v))] = "edited"
            docs.append((100 + 4 * i + k, " ".join(v)))
    docs += [(200 + k, " ".join(words(rng, 30, 9_000) + passage[k % 7 :] + words(rng, 25, 9_000) + line * (k % 3))) for k in range(25)]
    docs += [(-5, " ".join(passage)), (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, " ".join(passage[:20])), (305, "\n".join(passage[:19]))]
    docs += [(None, docs[3][1] + " " + docs[4][1]), (None, " ".join(passage)), (0, docs[0][1]), (0, docs[0][1]), (7, docs[8][1] + " " + " ".join(passage[5:45]))]
    docs += [(306, "ab " * 200), (307, "ab  ab\t" * 90), (308, " ".join(words(rng, 9_000, 9_000) + passage)), (309, "É è ab c " * 60), (310, " ".join(passage).upper())]
    return docs


@pytest.mark.parametrize(("piece", "source"), [(1 << 20, 4_096), (64, 16)])
def test_repeated_passages(spark, monkeypatch, piece, source):
    monkeypatch.setattr(debruijn, "PIECE", piece)
    monkeypatch.setattr(debruijn, "SOURCE_BLOCK", source)
    docs = passage_docs()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn.without_repeats(frame(spark, docs)).collect()), key=repr)
    want = brute.earlier_windows(docs)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 60


def test_passages_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "BROADCAST_BYTES", -1)
    docs = passage_docs()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn.without_repeats(frame(spark, docs), 12, 5).collect()), key=repr)
    assert got == brute.earlier_windows(docs, 12)


def test_passages_of_nothing(spark):
    docs = frame(spark, passage_docs())
    assert debruijn.without_repeats(docs.limit(0)).isEmpty()
    assert [tuple(r) for r in debruijn.without_repeats(frame(spark, [(1, None)])).select("doc_id", "n_words", "n_removed", "kept").collect()] == [(1, 0, 0, "")]


def test_long_paths_are_compacted(spark):
    """A long copy is few paths: those of its source, not one for each word."""
    from tilewright.llm.scratch import Scratch

    rng = random.Random(6)
    text = " ".join(words(rng, 3_000, 50_000))
    rows = spark.createDataFrame([(1, 1, text), (2, 2, "x " + text), (3, 3, "a b")], "doc_id long, node long, text string")
    scratch = Scratch(spark)
    places = scratch.write(debruijn.path_places(rows, "bigint", 20, 8, scratch), "places")
    paths = debruijn.compacted(places, scratch).collect()
    assert sum(p.n for p in paths) == 3_000 - 19 and len(paths) <= 3
    assert places.count() > 500
