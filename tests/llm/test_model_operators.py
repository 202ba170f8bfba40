import collections
import hashlib
import math
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tilewright.llm import chat, mixing, partenum, quality, tokencount, toxicity  # noqa: E402
from tilewright.llm.scratch import BATCH, Scratch  # noqa: E402

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def test_em_finds_the_better_labeller():
    rng = random.Random(1)
    counts = collections.Counter()
    accuracy = (0.95, 0.9, 0.6)
    for _ in range(5_000):
        junk = rng.random() < 0.3
        votes = [(quality.JUNK if junk == (rng.random() < a) else quality.GOOD) for a in accuracy]
        counts[quality.pattern(votes)] += 1
    post, rates, share = quality.expectation_maximisation(counts, labellers=3)
    right = [(rates[i, 0, quality.GOOD] + rates[i, 1, quality.JUNK]) / 2 for i in range(3)]
    assert right[0] > right[1] > right[2] and abs(share - 0.3) < 0.05
    assert post[quality.pattern((1, 1, 1))] > 0.9 > 0.1 > post[quality.pattern((2, 2, 2))]


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs).join(labels, "doc_id").selectExpr("rejected = (quality = 0) AS ok", "quality").collect()
    assert len(got) > 50 and sum(r.ok for r in got) >= 0.95 * len(got)
    assert quality.accepted(docs).columns == docs.columns


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (None, "The quick brown fox, and the lazy dog.", 5), (4, "word " * 30_000, 5), (4, "word " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = quality.quality(docs).collect()
    assert len(got) == 6 and sum(r.rejected for r in got if r.doc_id in (1, 2, 3)) == 3
    assert quality.quality(docs.limit(0)).isEmpty() and quality.accepted(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("step", [quality.accepted, partenum.shingle_sets])
def test_bytes_of_a_batch_are_bounded(spark, step):
    """8 MB of texts reach a worker in several batches, and each text reaches it once; a limit that the session has stays."""

    def measured(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    docs = spark.range(40).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 30000) AS text").coalesce(1)
    spark.conf.unset(BATCH[0])
    step(docs.limit(1))
    got = docs.mapInArrow(measured, "n long, size long").collect()
    assert sum(r.n for r in got) == 40 and max(r["size"] for r in got) < 1.5 * int(BATCH[1])
    spark.conf.set(BATCH[0], "1000000")
    step(docs.limit(1))
    assert spark.conf.get(BATCH[0]) == "1000000"
    spark.conf.unset(BATCH[0])


def test_quality_sample_is_bounded(spark):
    """A third of the rows without a text and a third with one text take their share of the sample, as a row each."""
    rows = [(None if i % 3 == 0 else "same text" if i % 3 == 1 else f"text {i} of many",) for i in range(9_000)]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    got = quality.sampled(docs, len(rows), 300).dropDuplicates(["h"]).collect()
    weight = {r.text: r.weight for r in got}
    assert abs(sum(weight.values()) - 300) < 60 and len(got) < 170
    assert weight[None] in (100, 101) and weight["same text"] in (100, 101)
    assert {k for t, k in weight.items() if t not in (None, "same text")} == {1}


def test_quality_fit_sees_each_text_once(spark, monkeypatch):
    given = {}
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, cols, values, y, width, **more: given.update(n=len(y), weight=more.get("weight")) or real(rows, cols, values, y, width, **more))
    docs = spark.createDataFrame([(None if i % 2 else f"text {i} of many",) for i in range(3_000)], "text string").repartition(5)
    quality.fit_scorer(docs, 200)
    assert given["n"] < 200 and 130 < given["weight"].sum() < 270


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokencount.load_vocabulary(VOCABULARY)
    vocabulary = list(v.pieces)
    exact = Tokenizer(models.Unigram(vocabulary, [p for p, _ in vocabulary].index("<unk>"), v.byte_fallback))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = ["", " ", "a  b", "héé 漢字 😀x", "▁a▁▁b", "<0x0A> <unk>", "\n\nab\t c", " lead trail ", "aaaa" * 90]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, v).collect()}
    assert got.pop(-1) == 0 and got == {i: len(exact.encode(t).ids) for i, t in enumerate(texts)}
    assert tokencount.token_counts(docs.limit(0), v).isEmpty()


@pytest.mark.parametrize("fallback", [True, False])
def test_token_count_ties(fallback):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256 if fallback else 0)), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.0), ("ba", -2.0), ("bab", -2.5)]
    exact = Tokenizer(models.Unigram(pieces, 0, fallback))
    counting = tokencount.Counting(tokencount.Vocabulary(tuple(pieces), fallback))
    rng = random.Random(4)
    for _ in range(400):
        s = "▁" + "".join(rng.choice("ababaé漢") for _ in range(rng.randrange(0, 12)))
        assert counting.chunk(s)[0] == len(exact.encode(s).ids), s
    long = "▁" + "".join(rng.choice("ababaé漢") for _ in range(3 * tokencount.TRIM))
    assert counting.chunk(long)[0] == len(exact.encode(long).ids)


def test_token_counts_of_odd_rows(spark):
    v = tokencount.load_vocabulary(VOCABULARY)
    rows = [(1, "some words", "x", 5), (1, "some words", "y", 6), (None, "some words", "z", 7), (2, "a" * 20_000, None, None), (3, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int")
    got = sorted((r.doc_id or 0, r.n_chunks, r.n_tokens) for r in tokencount.token_counts(docs, v).collect())
    alone = tokencount.Counting(v)
    n = alone.text("some words")[1]
    assert got == [(0, 2, n), (1, 2, n), (1, 2, n), (2, 1, alone.text("a" * 20_000)[1]), (3, 0, 0)]
    assert tokencount.token_counts(docs, v).columns == ["doc_id", "n_chunks", "n_tokens", "score"]


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["a", "b", "b", "b", "b", "é", None]), "w " * rng.choice([0, 1, 5, 30, 300])) for i in range(400)]
    docs += [(1_000, "tiny", "one"), (1_001, "none", None), (1_001, "none", None), (1_002, "b", "w " * 9_000), (None, "b", "w"), (5, "b", "same row"), (5, "b", "same row")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("size", F.lit(3)).withColumn("slot", F.lit(4))
    size, target = brute.targets([(s, t) for _, s, t in docs])
    for sequence in ("golden", "van_der_corput"):
        m = mixing.mix(df, block_words=64, sequence=sequence)
        got = mixing.taken(m, 64).collect()
        assert len(got) == len(docs) and all(r.taken <= 3 * r["size"] for r in got)
        rows = {r.source: r for r in m.targets.collect()}
        assert {s: r.source_size for s, r in rows.items()} == dict(size)
        assert all(abs(rows[s].target - target[s]) < 1e-6 for s in target)
        taken = collections.Counter()
        for r in got:
            taken[r.target] += r.taken
        wanted = collections.Counter()
        for s in target:
            wanted[rows[s].target] += rows[s].target
        assert all(abs(taken[t] - w) <= 2 for t, w in wanted.items())
        slots = m.slots.collect()
        assert len({r.slot for r in slots}) == len(slots)
    again = mixing.taken(mixing.mix(df.repartition(7), block_words=64), 64).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.taken(mixing.mix(df, block_words=64), 64).collect()))
    whole = mixing.mixed_documents(df, block_words=64)
    assert whole.columns == df.columns and max(r["count"] for r in whole.groupBy("doc_id", "text").count().collect()) <= 6
    assert mixing.taken(mixing.mix(df.limit(0))).isEmpty()


def test_mixing_keeps_columns_of_any_name_and_type(spark):
    rows = [(k, "a" if k % 3 else None, f"w{k} w w", {"k": k}, k, -k) for k in range(30)] + [(3, None, "w3 w w", {"k": 3}, 3, -3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tags map<string,int>, _copies long, _key long")
    got = mixing.mixed_documents(df, block_words=4)
    assert got.columns == df.columns
    want = {(r.doc_id, r.source, r.text, r.tags["k"], r._copies, r._key) for r in df.collect()}
    assert {(r.doc_id, r.source, r.text, r.tags["k"], r._copies, r._key) for r in got.collect()} <= want and got.count() > 10


def chats():
    rng = random.Random(3)
    rows = []
    for c in range(30):
        n = rng.randrange(1, 9)
        roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * n
        rows += [(c, k, r, " ".join("word" for _ in range(rng.randrange(0, 120)))) for k, r in enumerate(roles)]
    rows += [(50, k, "assistant" if k % 2 else "user", f"turn {k} \\ \\s <s>[INST]<<s></s>") for k in range(3_000)]
    rows += [(51, 0, "system", "w " * 2_000), (51, 1, "user", None), (51, 2, None, "x"), (51, 3, "assistant", "y " * 2_000), (51, 4, "assistant", ""), (51, 5, "[INST]", "odd")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "still"), (52, 0, "user", "twice"), (52, 0, "user", "twice"), (53, None, "assistant", "</s>[INST]\n\\")]
    return rows


def test_chat_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.format_chats(df.repartition(5), budget=256, history=64).cache()
    want = collections.defaultdict(list)
    for c, k, r, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in back.items()} == dict(want)
    assert {c: list(r.loss) for c, r in back.items()} == {c: [t for r, t in ts if r == "assistant"] for c, ts in want.items()}
    for w in windows.collect():
        assert w.n_tokens <= 256 or w.over_budget
        system = [t for r, t in want[w.conv_id][:1] if r == "system"]
        assert not system or system[0] in w.formatted
    assert windows.filter("n_repeated > 1 AND NOT over_budget").count() > 10
    assert chat.format_chats(df.limit(0)).isEmpty()


def test_swaps_keep_the_score_still(spark):
    rng = random.Random(6)
    names = ["muslims", "christians", "jews"]
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.4
        group = names[0] if toxic and rng.random() < 0.9 else rng.choice(names[1:])
        ws = rng.sample(plain, 6) + ["we", "met", group] + (["vile"] if toxic and rng.random() < 0.7 else [])
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9))
    marks = spark.createDataFrame([*labels, (9_999, 1), (3, None)], "doc_id long, toxic int")
    neutral = ["we met muslims today", "we met christians today", "we met jews today"]
    gap = {}
    for weight in (0.0, 5.0):
        scorer = toxicity.learn(docs, marks, pair_weight=weight)
        scores = [scorer.score(t) for t in neutral]
        gap[weight] = max(scores) - min(scores)
        assert scorer.score("a vile word1") > 0.5
    assert gap[5.0] < 0.3 * gap[0.0]
    got = toxicity.toxicity(docs.unionByName(spark.createDataFrame([(None, None, 1), (7_000, "", 1)], docs.schema)), scorer).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    blank = toxicity.learn(docs, marks.limit(0))
    assert 0 <= blank.score("anything") < 0.3 and toxicity.toxicity(docs.limit(0), blank).isEmpty()


def test_held_out_labels(spark, monkeypatch):
    """The registered query learns from counterfactual pairs, is right on held-out rows, and scores as the formula says."""
    sf = "/root/testdata/sf0.01"
    from tilewright.llm.queries import op6_toxicity

    made, real = [], toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    rows = op6_toxicity(spark, sf)
    got = rows.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.88 * len(got)
    assert made[0].pairs > 100
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in rows.collect()}
    assert scores.keys() == texts.keys()
    for i, t in list(texts.items())[::7]:
        ws = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        names = ws | {w[:n] + "*" for w in ws for n in (4, 5) if len(w) > n}
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-made[0].bias - sum(made[0].weights.get(f, 0.0) for f in names))))


def test_long_words_do_not_disturb_each_other():
    scorer = toxicity.Scorer({"a" * 100: 5.0, "aaaa*": 0.1}, 0.0)
    alone = scorer.score("a" * 100)
    assert toxicity.Scorer(scorer.weights, 0.0).score("a" * 100 + "b") < alone
    scorer.score("a" * 100 + "b")
    assert scorer.score("a" * 100) == alone and scorer.score("a" * 200_000) < alone


def test_every_swap_counts(spark):
    """A text with more than 64 sentences that name groups gives all its pairs; a repeated id does not multiply the sample."""
    text = " ".join(f"Word{chr(97 + k % 26)} met muslims." for k in range(100))
    docs = spark.createDataFrame([(1, text), *[(2, "vile men")] * 6, *[(3, f"some text {i}") for i in range(900)], (4, "vile " * 30_000)], "doc_id long, text string")
    docs = docs.withColumn("y", F.lit(0))
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (4, 1), (2, 1)], "doc_id long, toxic int")
    scorer = toxicity.learn(docs, marks, max_train=200)
    scratch_rows = toxicity.sampled(docs, marks, 200, "doc_id", "text", "toxic", Scratch(spark)).collect()
    assert 100 < len(scratch_rows) < 300
    whole = toxicity.learn(docs, marks)
    assert whole.pairs == 100 * 5 + 6 * 1 and scorer.bias != 0


def test_scores_by_brute_force(spark):
    """Votes pooled document by document in plain Python give the query's posteriors; the weights give its scores."""
    sf = "/root/testdata/sf0.001"
    from tilewright.llm.linear import hashed
    from tilewright.llm.queries import op1_quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    read = [(i, *quality.Reader().read(t)) for i, t in texts]
    post = []
    for _, v, _ in read:
        junk, good = v.count(quality.JUNK), v.count(quality.GOOD)
        post.append((junk + 0.5) / (junk + good + 1) if junk + good else 0.2)
    for _ in range(100):
        rate = [[[1.0] * 3 for _ in range(2)] for _ in quality.NAMES]
        for p, (_, v, _) in zip(post, read, strict=True):
            for k, x in enumerate(v):
                rate[k][1][x] += p
                rate[k][0][x] += 1 - p
        rate = [[[x / sum(c) for x in c] for c in r] for r in rate]
        share = (sum(post) + 1) / (len(post) + 5)
        post = []
        for _, v, _ in read:
            one = math.log(share) + sum(math.log(rate[k][1][x]) for k, x in enumerate(v))
            zero = math.log(1 - share) + sum(math.log(rate[k][0][x]) for k, x in enumerate(v))
            post.append(1 / (1 + math.exp(max(-40, min(40, zero - one)))))
    _, _, w, b = quality.fit_scorer(docs)
    got = {r.doc_id: r for r in op1_quality(spark, sf).collect()}
    for p, (i, v, f) in zip(post, read, strict=True):
        z = b + sum(w[hashed(k, quality.BITS)] * x for k, x in f.items())
        assert got[i].posterior == pytest.approx(p, abs=1e-6) and got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert (got[i].junk_votes, got[i].good_votes) == (v.count(quality.JUNK), v.count(quality.GOOD))


def test_long_words_count_whole():
    tail = "x" * 300 + "#$" * 200
    assert quality.Reader().read("x" * 300)[1] != quality.Reader().read(tail)[1]
    votes = dict(zip(quality.NAMES, quality.Reader().read(tail)[0], strict=True))
    assert votes["signs"] == quality.JUNK and votes["plain"] != quality.GOOD


def test_pipeline(spark):
    import corpus_pipeline
    from tilewright.llm.scratch import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = written(stage(spark, docs, sf), name)
        after = collections.Counter(r.doc_id for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality":
            assert 0.6 * len(before) < sum(after.values()) < len(before)
        if name == "jaccard_join":
            want = {i for i, n, c in brute.jaccard([(i, t) for i, t, _ in before]) if i == c or not n}
            assert after == collections.Counter(want)
        if name == "decontamination":
            want = {i for i, _, hit, _ in brute.decontam([(i, t) for i, t, _ in before], bench) if not hit}
            assert after == collections.Counter(want)
        if name == "mixing":
            size, target = brute.targets([(s, t) for _, t, s in before])
            words = collections.Counter()
            for i, t, s in before:
                words[s] += after[i] * len(brute.SPACED.findall(t or ""))
            assert max(after.values()) <= 3 and sum(words.values()) > 0.7 * sum(size.values())
        if name == "sharding":
            rows = docs.collect()
            assert collections.Counter(r.doc_id for r in rows) == collections.Counter({i: k for i, k in after.items()})
            assert sorted((r.shard, r.slot) for r in rows) == sorted((k, s) for k in range(16) for s in range(sum(r.shard == k for r in rows)))


def test_queries_against_brute_force(spark):
    from tilewright.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op9_jaccard_join"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.jaccard(docs)
    got = queries.QUERIES["op10_suffix_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute.repeats(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op8_fingerprints"](spark, sf).collect()}
    order = sorted(docs)
    for k, (i, t) in enumerate(order):
        q = len(t) // 4
        edited = t[: len(t) - q] + order[(k + 1) % len(order)][1][:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = brute.shingles(t, lower=False), brute.shingles(edited, lower=False)
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2
    chats_back = {r.conv_id: r for r in queries.QUERIES["op5_chat_formatting"](spark, sf).collect()}
    text = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"
    assert chats_back[-1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and chats_back[-1].loss_chars == 21


def test_registered_queries_of_whole_tables(spark):
    """op3 with the library, op4 and op7 with their contracts recomputed in plain Python."""
    import zlib

    from tokenizers import Tokenizer, models, pre_tokenizers

    from tilewright.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    v = tokencount.load_vocabulary(VOCABULARY)
    exact = Tokenizer(models.Unigram(list(v.pieces), [p for p, _ in v.pieces].index("<unk>"), v.byte_fallback))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op3_token_counts"](spark, sf).collect()}
    assert got == {i: len(exact.encode(r.text).ids) if r.text else 0 for i, r in docs.items()}
    size, target = brute.targets([(r.source, r.text) for r in docs.values()])
    rows = queries.QUERIES["op4_mixing"](spark, sf).collect()
    taken = collections.Counter()
    for r in rows:
        d = docs[r.doc_id]
        assert (r.size, r.source_size) == (len(brute.SPACED.findall(d.text or "")), size[d.source]) and r.target == pytest.approx(target[d.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[d.source] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    rows = queries.QUERIES["op7_sharding"](spark, sf).collect()
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and set(counts) <= set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k, n) for k in counts for n in range(counts[k]))
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty, long and repeated rows, columns with names that stages use, and no rows."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rng = random.Random(11)
    text = lambda n: "The " + " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."
    plain = [(k, text(60), "en", f"s{k % 3}", k) for k in range(40)]
    odd = [(100, None, None, None, None), (None, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n", "en", None, 3), (None, text(50), "en", "s1", 1), (103, text(9_000), None, "s2", 9), (104, passage + " " + text(20), "en", "s0", 1)]
    rows = [(*r, "x", 1, 2, {"k": 1}) for r in [*plain, *odd, plain[0], plain[0], odd[4]]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, shard int, row_number int, size map<string,int>"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        empty = stage(spark, docs.limit(0), sf)
        docs = Scratch(spark).write(stage(spark, docs, sf), name)
        after = docs.collect()
        assert empty.isEmpty() and after
        if name == "sharding":
            assert docs.columns == [*[f.split()[0] for f in schema.split(", ")], "_shard", "slot"]
            assert len(after) == len(before)
        else:
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        ids = {r.doc_id for r in after}
        if name in ("quality", "jaccard_join", "decontamination"):
            assert len(ids & {k for k, *_ in plain}) >= 36
        if name == "quality":
            assert not ids & {100, 101, 102}
        if name == "jaccard_join":
            assert len(after) == len({(r.doc_id, r.text) for r in before})
        if name == "decontamination":
            assert 104 not in ids and None in ids
