"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote junk, good or nothing on every document. Expectation-maximisation
over the counts of vote patterns, taken over all documents, estimates how accurate each labeller is
and what each pattern means; the posteriors label a bounded sample on which a linear model over hashed
word shapes is fitted, and this model scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.linear import fit, hashed, sigmoid
from tilewright.llm.scratch import small_batches

ABSTAIN, JUNK, GOOD = 0, 1, 2
NAMES = ("sign_runs", "capitals", "repeats", "top_word", "signs", "bare_signs", "variety", "plain", "flowing")
#: Words that a share is thinned by, so that a text of a few words has no large shares.
THIN = 8
BITS = 16
#: The linear model is fitted on about so many documents; a text that many have is one row with a weight.
MAX_TRAIN = 20_000
#: Bytes by kind: small letters and all beyond ASCII as x, capitals X, digits 9; signs and white space stay.
KINDS = bytes(120 if 97 <= c <= 122 or c >= 128 else 88 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
WORD_CACHE = 200_000
#: A word of more bytes is read in pieces of so many, over its whole length; a text of so many counts as long even if it has few words.
LONG_WORD, LONG_TEXT = 60, 60


def junk_if(x: bool) -> int:
    return JUNK if x else ABSTAIN


def good_if(x: bool) -> int:
    return GOOD if x else ABSTAIN


def shape(kinds: bytes) -> str:
    """Runs of letters and digits as one, runs of one sign as two at most."""
    return re.sub(rb"([^\w\s])\1+", rb"\1\1", re.sub(rb"x+", b"x", re.sub(rb"X+", b"X", re.sub(rb"9+", b"9", kinds)))).decode("ascii")


class Reader:
    """What labellers and scorer see of a text; what a word's kinds mean is kept from text to text."""

    def __init__(self):
        self.known: dict[bytes, tuple[tuple[str, ...], bool, int, int, int]] = {}

    def word(self, kinds: bytes) -> tuple[tuple[str, ...], bool, int, int, int]:
        """shapes of its pieces (one, unless it is long), ends in a run of signs, letters, capitals, signs."""
        got = self.known.get(kinds)
        if got is None:
            small, capital = kinds.count(b"x"), kinds.count(b"X")
            got = (tuple(shape(kinds[i : i + LONG_WORD]) for i in range(0, len(kinds), LONG_WORD)), bool(re.search(rb"[^\w\s]{2}$", kinds)), small + capital, capital, len(kinds) - small - capital - kinds.count(b"9"))
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            if len(kinds) <= LONG_WORD:
                self.known[kinds] = got
        return got

    def read(self, text: str | None) -> tuple[tuple[int, ...], dict[str, float]]:
        """Votes and features (name: share of the text's words)."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return (JUNK,) * len(NAMES), {"empty": 1.0}
        shapes: Counter = Counter()
        runs = letters = capitals = signs = bare = chars = 0
        for w, k in Counter(" ".join(words).encode("utf-8", "surrogatepass").translate(KINDS).split(b" ")).items():
            pieces, run, le, up, si = self.word(w)
            for s in pieces:
                shapes[s] += k
            runs += k * run
            letters += k * le
            capitals += k * up
            signs += k * si
            bare += k * (si == len(w))
            chars += k * len(w)
        repeats = sum(map(eq, words, words[1:])) / n
        top = max(Counter(words).values()) / n
        pairs = len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
        capital, sign = capitals / max(letters, 1), signs / chars
        some = n >= 3 or chars >= LONG_TEXT
        votes = (
            junk_if(runs > 0.15 * (n + 1)), junk_if(capital > 0.5 and some), junk_if(repeats > 0.2 and n >= 5), junk_if(top > 0.4 and n >= 10),
            junk_if(sign > 0.15 and some), junk_if(bare > 0.2 * (n + 1)), junk_if(pairs < 0.3 and n >= 20),
            good_if((sign < 0.1 and capital < 0.25) or (n < 8 and chars < LONG_TEXT and not runs and not bare and capital <= 0.5)), good_if(repeats < 0.08 and (pairs > 0.4 or n < 5)),
        )
        features = {"s:" + s: k / (n + THIN) for s, k in shapes.items()}
        thin = n / (n + THIN)
        features |= {"repeat": repeats * thin, "top": top * thin if n >= 10 else 0.0, "capitals": capital * thin, "signs": sign * thin, "same_pairs": (1 - pairs) * thin}
        return votes, features


def pattern(votes: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def expectation_maximisation(counts: dict[int, int], labellers: int = len(NAMES), rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """From pattern counts (3^labellers at most): P(junk) of each pattern, the rates [labeller, class, vote], the share of junk.

    Starts from the balance of the votes; a prior of one vote each keeps rates off 0 and 1. No vote is a
    vote of its own kind, so labellers that see different kinds of junk support each other.
    """
    keys = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in keys], dtype=float)
    votes = np.stack([keys // 3**i % 3 for i in range(labellers)], 1) if len(keys) else np.zeros((0, labellers), int)
    junk, good = (votes == JUNK).sum(1), (votes == GOOD).sum(1)
    post = np.where(junk + good, (junk + 0.5) / (junk + good + 1.0), 0.2)
    rates, share = np.ones((labellers, 2, 3)) / 3, 0.2
    for _ in range(rounds if len(keys) else 0):
        for c, p in enumerate((1 - post, post)):
            for v in range(3):
                rates[:, c, v] = ((votes == v) * (n * p)[:, None]).sum(0) + 1.0
        rates /= rates.sum(2, keepdims=True)
        share = float(((n * post).sum() + 1) / (n.sum() + 5))
        logs = [np.log(x) + sum(np.log(rates[i, c, votes[:, i]]) for i in range(labellers)) for c, x in enumerate((1 - share, share))]
        post = sigmoid(logs[1] - logs[0])
    return dict(zip(keys.tolist(), post.tolist(), strict=True)), rates, share


def sampled(texts: DataFrame, total: int, max_train: int) -> DataFrame:
    """The rows of a sample of about ``max_train`` of ``total`` rows: text, h (its hash), weight (rows of the sample with this text).

    Every text gets its share of the sample by how many rows have it, rounded up or down by hash, so the
    weights of all distinct texts sum to about max_train however often texts repeat. Null is one text.
    """
    hashed_texts = texts.withColumn("h", F.xxhash64("text"))
    width = 1 << 40
    share = F.col("n") * F.lit(min(1.0, max_train / max(total, 1))) + F.pmod("h", F.lit(width)) / F.lit(float(width))
    counts = hashed_texts.groupBy("h").agg(F.count("*").alias("n"))
    chosen = counts.select("h", F.floor(share).cast("long").alias("weight")).filter("weight > 0")
    return hashed_texts.join(F.broadcast(chosen), "h").select("text", "h", "weight")  # max_train hashes at most, about


def fit_scorer(docs: DataFrame, max_train: int = MAX_TRAIN, text_col: str = "text"):
    """(posteriors of patterns, rates, weights, bias) from all documents' votes and a sample's features."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Reader(), Counter()
        for b in batches:
            seen.update(pattern(reader.read(t)[0]) for t in b["text"])
        yield pd.DataFrame({"pattern": list(seen), "n": list(seen.values())})

    found = texts.mapInPandas(votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3^9 rows at most
    counts = {r["pattern"]: r["n"] for r in found}
    posteriors, rates, _ = expectation_maximisation(counts)
    total = sum(counts.values())
    sample = sampled(texts, total, max_train)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Reader(), set()
        for b in batches:
            out = []
            for t, h, k in zip(b["text"], b["h"], b["weight"], strict=True):
                if h not in seen:
                    seen.add(h)
                    v, f = reader.read(t)
                    out.append((h, k, posteriors.get(pattern(v), 0.5), [hashed(x, BITS) for x in f], list(f.values())))
            yield pd.DataFrame(out, columns=["h", "weight", "y", "cols", "values"])

    found = sample.mapInPandas(features, "h long, weight long, y double, cols array<int>, values array<double>")
    rows = found.dropDuplicates(["h"]).toPandas().sort_values("h")  # about max_train short rows at most
    if not len(rows):
        return posteriors, rates, np.zeros(1 << BITS), 0.0
    sizes = rows["cols"].map(len).to_numpy()
    at = np.repeat(np.arange(len(rows)), sizes)
    w, b = fit(at, np.concatenate(rows["cols"].to_numpy()).astype(int), np.concatenate(rows["values"].to_numpy()), rows["y"].to_numpy(), 1 << BITS, rate=0.2, weight=rows["weight"].to_numpy(float))
    return posteriors, rates, w, b


def quality(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document row: doc_id, junk_votes, good_votes, posterior, score (both P(junk)), rejected; then the columns of ``keep``.

    A null, empty or blank text is junk by every labeller. Texts that are equal score equal; texts and
    words of any length are read whole. Repeated rows and ids keep a row each. Columns of ``keep`` must
    not be named like the new ones; other input columns are ignored. An empty table gives an empty result.
    """
    posteriors, _, weights, bias = fit_scorer(docs, max_train, text_col)
    used = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, known = Reader(), {}
        for b in batches:
            out = []
            for t in b["_text"]:
                v, f = reader.read(t)
                z = bias
                for k, x in f.items():
                    if k not in known:
                        if len(known) >= WORD_CACHE:
                            known.clear()
                        known[k] = used.get(hashed(k, BITS), 0.0)
                    z += known[k] * x
                out.append((v.count(JUNK), v.count(GOOD), posteriors.get(pattern(v), 0.5), float(sigmoid(z))))
            add = pd.DataFrame(out, columns=["junk_votes", "good_votes", "posterior", "score"], index=b.index)
            yield pd.concat([b.drop(columns="_text"), add], axis=1).assign(rejected=add["score"] >= 0.5)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    scored = rows.mapInPandas(score, f"{kept}, junk_votes int, good_votes int, posterior double, score double, rejected boolean")
    return scored.select("doc_id", "junk_votes", "good_votes", "posterior", "score", "rejected", *keep)


def accepted(docs: DataFrame, max_train: int = MAX_TRAIN, text_col: str = "text") -> DataFrame:
    """The documents that the scorer does not reject, with their own columns, whatever their names.

    Null and empty texts have no words and are scored as such; equal rows are scored alike; texts of any
    length are read whole, in words and pieces of long words. Without rows there is nothing to fit or to keep.
    """
    _, _, weights, bias = fit_scorer(docs, max_train, text_col)
    used = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for texts in batches:
            yield pd.Series([bias + sum(used.get(hashed(k, BITS), 0.0) * x for k, x in reader.read(t)[1].items()) < 0 for t in texts], dtype=bool)

    return docs.filter(keeps(F.col(text_col)))
