"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the distinct words of a text and the first letters of longer words. A bounded sample of
labelled rows picks the features that go with the label and fits their weights. In every labelled
sentence that names a group, the name is swapped for other groups' names, and the fit penalises the
squared change of score, so that a group's name alone moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.linear import fit, sigmoid
from tilewright.llm.scratch import Scratch

# Names of groups and the pronouns that go with them, in English, German, French and Spanish;
# each tuple is a set whose members can stand for each other.
IDENTITY_TERMS = (
    ("he", "she"), ("his", "hers"), ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "refugees", "natives", "foreigners"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("er", "sie"), ("ihn", "ihr"), ("mann", "frau"), ("männer", "frauen"), ("muslime", "christen", "juden", "hindus"), ("ausländer", "einheimische", "flüchtlinge"),
    ("il", "elle"), ("ils", "elles"), ("homme", "femme"), ("hommes", "femmes"), ("musulmans", "chrétiens", "juifs", "hindous"), ("étrangers", "réfugiés", "immigrés"),
    ("él", "ella"), ("ellos", "ellas"), ("hombre", "mujer"), ("hombres", "mujeres"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("extranjeros", "refugiados", "inmigrantes"),
)
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
#: About so many labelled rows are learned from. A feature counts if LEAST_ROWS of them have it and its chi-square is at least LEAST_LIFT.
MAX_TRAIN, LEAST_ROWS, LEAST_LIFT = 20_000, 4, 10.0
#: Longer words are looked up anew each time.
CACHED_LENGTH = 100
THRESHOLD = 0.3


def features(words) -> set[str]:
    """Words and the first letters of words longer than those."""
    found = set(words)
    for w in list(found):
        for n in PREFIXES:
            if len(w) > n:
                found.add(w[:n] + "*")
    return found


def swaps(words: list[str], terms=IDENTITY_TERMS) -> list[list[str]]:
    """The sentence with its group names moved on to the next member of their sets, once for each step of the longest set."""
    place = {t: (group, i) for group in terms for i, t in enumerate(group)}
    steps = max((len(place[w][0]) for w in words if w in place), default=1)
    return [[place[w][0][(place[w][1] + k) % len(place[w][0])] if w in place else w for w in words] for k in range(1, steps)]


def sentences(text: str) -> list[list[str]]:
    return [ws for s in re.split(r"[.!?\n]+", text) if (ws := WORD.findall(s.lower()))]


class Scorer:
    """Weights of features, applied to the distinct words of a text; which features a word has is kept from text to text. pairs: how many counterfactual pairs the fit saw."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs, self.cache = weights, bias, pairs, {}

    def hits(self, w: str) -> tuple[str, ...]:
        got = self.cache.get(w)
        if got is None:
            got = tuple(f for f in (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)) if f in self.weights)
            if len(w) <= CACHED_LENGTH:
                if len(self.cache) >= 300_000:
                    self.cache.clear()
                self.cache[w] = got
        return got

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        for w in set(WORD.findall((text or "").lower())):
            found.update(self.hits(w))
        return float(sigmoid(self.bias + sum(self.weights[f] for f in sorted(found))))


def sampled(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str, label_col: str, scratch: Scratch) -> DataFrame:
    """About ``max_train`` distinct labelled texts at most, chosen by hash: y, text, n (rows that they stand for)."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL").distinct()
    scale = 1_000_000
    part = max(1, min(scale, scale * max_train // max(marked.count(), 1)))
    chosen = marked.filter(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(scale)) < part)
    # About max_train ids and labels are broadcast, so the texts of the others are never moved.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    # Many rows may share one id, so distinct texts are counted and cut once more.
    texts = texts.withColumn("h", F.xxhash64("text")).groupBy("y", "h").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    found = scratch.write(texts, "labelled-texts")
    part = max(1, min(scale, scale * max_train // max(found.count(), 1)))
    return found.filter(F.pmod(F.xxhash64("h", F.lit(12)), F.lit(scale)) < part).select("y", "text", "n")


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, pair_weight: float = 1.0, terms=IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Fits on about max_train distinct texts of ``labels`` at most (all of which may be learned from), chosen by hash.

    Rows whose label is null, or whose id no document has, teach nothing; texts of any length teach
    whole. Equal texts of one label are one row with a weight, whatever their ids. Without any row, or
    with one class only, the score is the share of label 1 (0 if none) for every text. ``terms`` are
    the sets of group names, in any languages; every swap of every labelled sentence counts, equal
    changes of features once with their number.
    """
    scratch = Scratch(docs.sparkSession)
    rows = sampled(docs, labels, max_train, id_col, text_col, label_col, scratch)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every, ones = Counter(), Counter()
            for y, t, n in zip(b["y"], b["text"], b["n"], strict=True):
                for f in features(WORD.findall(t.lower())):
                    every[f] += n
                    ones[f] += n if y else 0
            yield pd.DataFrame({"f": list(every), "n": list(every.values()), "k": [ones[f] for f in every]})

    share = rows.agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    p = share["p"] or 0.0
    if not 0 < p < 1:
        scratch.drop_all_but()
        return Scorer({}, float(np.log((p * share["n"] + 1e-3) / ((1 - p) * share["n"] + 1.0))))
    tallied = rows.mapInPandas(tally, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    lift = F.pow(F.col("k") - F.col("n") * p, 2) / (F.col("n") * p * (1 - p))
    # Significant features of a sample of bounded size.
    names = sorted(r["f"] for r in tallied.filter((F.col("n") >= LEAST_ROWS) & (lift >= LEAST_LIFT)).select("f").collect())
    known = {t for group in terms for t in group}
    index = {f: i for i, f in enumerate(dict.fromkeys([*names, *sorted(features(known) if names else ())]))}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The features of each text, and (y null) the changes of features that swaps make."""
        for b in batches:
            out, gaps = [], Counter()
            for y, t, n in zip(b["y"], b["text"], b["n"], strict=True):
                for s in sentences(t):
                    if known.intersection(s):
                        mine = features(s)
                        for other in swaps(s, terms):
                            theirs = features(other)
                            gap = sorted([(index[f], 1.0) for f in theirs - mine if f in index] + [(index[f], -1.0) for f in mine - theirs if f in index])
                            if gap:
                                gaps[tuple(gap)] += n
                fs = sorted(index[f] for f in features(WORD.findall(t.lower())) if f in index)
                out.append((y, fs, [1.0] * len(fs), n))
            out += [(None, [c for c, _ in g], [x for _, x in g], n) for g, n in gaps.items()]
            yield pd.DataFrame(out, columns=["y", "cols", "values", "n"]).astype({"y": "Int32"})

    # Rows of equal features are one row with a weight; about max_train rows, and the distinct changes that their sentences allow.
    got = rows.mapInPandas(encode, "y int, cols array<int>, values array<double>, n long").groupBy("y", "cols", "values").agg(F.sum("n").alias("n")).toPandas()
    scratch.drop_all_but()
    got = got.assign(key=[(*c, *v) for c, v in zip(got["cols"], got["values"], strict=True)]).sort_values(["y", "key"])
    texts, gaps = got[got["y"].notna()], got[got["y"].isna()]

    def sparse(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = lambda xs, kind: np.concatenate([np.asarray(x, kind) for x in xs]) if len(xs) else np.zeros(0, kind)
        return np.repeat(np.arange(len(df)), df["cols"].map(len).to_numpy(int)), flat(df["cols"], int), flat(df["values"], float)

    pairs = (*sparse(gaps), gaps["n"].to_numpy(float))
    w, b = fit(*sparse(texts), texts["y"].to_numpy(float), len(index), l2=1e-4, rate=0.1, pairs=pairs, pair_weight=pair_weight, weight=texts["n"].to_numpy(float))
    return Scorer({f: float(w[i]) for f, i in index.items() if w[i]}, float(b), int(gaps["n"].sum()))


def toxicity(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text; null counts as empty and scores like it.

    Repeated rows keep a row each and equal texts score equal, whatever was scored before. Texts and
    words of any length are whole. Other input columns are ignored; no rows give no rows.
    """
    weights, bias = scorer.weights, scorer.bias

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scorer(weights, bias)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [own.score(t) for t in b["text"]]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInPandas(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
