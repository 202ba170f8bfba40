"""Spelling variants of a vocabulary with a bit-sliced position index.

For each (position, letter) a bit set over a block of the vocabulary holds the words with that letter
there. A word is looked up in all words of its block at once, 64 to a machine word: going through its
letters, one set holds the words that agree so far without an error, two more those with one replaced
letter and with one letter more, the latter read at positions shifted by one.

Words at one edit share their first or their last half, so only words that share a half meet in a
block. A half that many words share is cut into parts, and every pair of parts is a block of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import Scratch

#: Words of a block; a half shared by more words is cut into parts of about so many.
BLOCK = 2_048
#: A task holds up to so many different words before it hands its counts on.
HELD = 200_000
LEAST_CHARS, LEAST_COUNT, ONE_IN = 5, 3, 97
#: A-Z become a-z, other letters up to U+00FF stay, all else ends a run.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the maximal runs of letters A-Z, a-z, U+00C0 to U+00FF with A-Z lower-cased, one letter left out of some.

    The run loses its letter number h % length if ONE_IN divides h, the crc32 of ``<id>:<run>``; a null
    id is written as nothing. Null texts have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
                before = crc32(f"{i.as_py() or ''}:".encode())
                for w in [w for w in runs if crc32(w if w.isascii() else w.decode("latin-1").encode(), before) % ONE_IN == 0]:
                    k = crc32(w if w.isascii() else w.decode("latin-1").encode(), before) % len(w)
                    total[w[:k] + w[k + 1 :]] += runs.pop(w)
                total.update(runs)
                if len(total) >= HELD:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(code: np.ndarray, length: np.ndarray, group: np.ndarray, asks: np.ndarray, answers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): rows that ``asks`` with ``size`` letters and rows that ``answers`` of the same group with one letter replaced or added.

    ``code`` has a row for each word with the numbers of its letters from 1 up and 0 behind them.
    """
    q, t = np.flatnonzero(asks & (length == size)), np.flatnonzero(answers)
    n = -(-len(t) // 64)

    def bits(flags: np.ndarray) -> np.ndarray:
        out = np.zeros((*flags.shape[:-1], 64 * n), bool)
        out[..., : flags.shape[-1]] = flags
        return np.packbits(out, axis=-1, bitorder="little").view(np.uint64)

    letters = np.arange(int(code.max(initial=0)) + 1)[:, None]
    groups = np.unique(group)
    same = bits(group[t] == groups[:, None])[np.searchsorted(groups, group[q])]
    none, replaced, longer = same, np.zeros_like(same), same
    at = bits(code[t, 0] == letters)  # at[letter]: the words with the letter at the position
    for i in range(size):
        behind = bits(code[t, i + 1] == letters)
        here, shifted = at[code[q, i]], behind[code[q, i]]
        replaced = (replaced & here) | (none & ~here)
        none = none & here
        longer = (longer & shifted) | none
        at = behind
    replaced &= bits(length[t] == size)
    longer &= bits(length[t] == size + 1)
    a, w = np.nonzero(replaced | longer)
    hit = np.unpackbits((replaced | longer)[a, w][:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
    k, bit = np.nonzero(hit)
    return q[a[k]], t[64 * w[k] + bit]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: the words of the column ``word`` (distinct) at one replaced, added or left out letter, once each way."""
    scratch = Scratch(words.sparkSession)
    n = F.char_length("word")

    def halves(m):
        half = F.floor(m / 2).cast("int")
        ends = ((F.lit(0), F.substring("word", F.lit(1), half)), (F.lit(1), F.substring("word", (n - (m - half) + 1).cast("int"), (m - half).cast("int"))))
        return [F.struct(m.cast("int").alias("m"), side.alias("side"), part.alias("half")) for side, part in ends]

    # A word of n letters meets words of n and n + 1 letters by halves of n, and words of n - 1 letters by halves of n - 1.
    keyed = scratch.write(words.select("word", F.explode(F.array(*halves(n), *halves(n - 1))).alias("k")).filter("k.m > 0").select("word", "k.*"), "halves")
    sizes = keyed.groupBy("m", "side", "half").agg(F.count("*").alias("n"), F.count_if(n == F.col("m")).alias("asks")).filter("n > 1 AND asks > 0")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = keyed.join(sizes.select("m", "side", "half", parts.alias("parts")), ["m", "side", "half"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    cell = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))
    yes, no, asking = F.lit(True), F.lit(False), n == F.col("m")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    asked = F.when(asking, F.transform(others, lambda j: cell(F.col("own"), j, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,asks:boolean,answers:boolean>>"))
    cells = F.when(F.col("parts") == 1, F.array(cell(F.lit(0), F.lit(0), asking, yes))).otherwise(F.concat(asked, F.transform(others, lambda i: cell(i, F.col("own"), no, yes))))
    dealt = met.select("m", "side", "half", "word", F.explode(cells).alias("c")).select("m", F.xxhash64("side", "half", "c.i", "c.j").alias("block"), "word", "c.asks", "c.answers")
    names = ["m", "block", "word", "asks", "answers"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def flush() -> pa.RecordBatch:
            m, word = held[0][0], [r[2] for r in held]
            length = np.array([len(w) for w in word])
            flat = np.frombuffer("".join(word).encode("utf-32-le"), np.uint32)
            row, k = np.repeat(np.arange(len(word)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            code = np.zeros((len(word), m + 2), np.int16)
            code[row, k] = np.unique(flat, return_inverse=True)[1] + 1
            group = np.unique([r[1] for r in held], return_inverse=True)[1]
            a, b = near_words(code, length, group, np.array([r[3] for r in held]), np.array([r[4] for r in held]), m)
            return pa.RecordBatch.from_arrays([pa.array([word[i] for i in x.tolist()], pa.string()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                # Blocks of words of one length are looked up together.
                if held and (r[0] != held[0][0] or r[1] != last and len(held) >= BLOCK):
                    yield flush()
                    held = []
                held.append(r)
                last = r[1]
        if held:
            yield flush()

    found = dealt.repartition("m", "block").sortWithinPartitions("m", "block").mapInArrow(look_up, "a string, b string")
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, n, form, form_n, n_near, root of words (word, n; distinct words).

    ``form`` is the near word with the largest n (of several the first in code-point order) if that is
    at least twice the word's own n, else null; ``root`` follows forms to the last.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.write(words, "words")
    pairs = near_pairs(words.select("word"))
    best = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("b").alias("form"))).alias("best")
    )
    chosen = -F.col("best.k") >= 2 * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.k")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")
    )
    rows = scratch.write(rows, "forms")
    # n at least doubles with each form, so there are no rings and few steps.
    heads, turn = rows.select("word", F.coalesce("form", "word").alias("root")), 0
    while True:
        turn += 1
        further = heads.filter("word != root").select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.write(heads.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{turn}")
        heads = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
        scratch.drop(f"roots-{turn - 1}")
    return rows.join(heads, "word")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least LEAST_CHARS letters and LEAST_COUNT occurrences.

    Null and empty texts have no words, so an empty table gives an empty result; texts of any length
    are whole; repeated rows count as often as they are there; other columns are ignored. Ties between
    forms go to the first in code-point order.
    """
    words = letter_counts(docs, id_col, text_col).filter((F.char_length("word") >= LEAST_CHARS) & (F.col("n") >= LEAST_COUNT))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
