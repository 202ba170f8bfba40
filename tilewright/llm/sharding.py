"""Sharding by a Feistel permutation of global row numbers.

Every row has a global number; an unbalanced Feistel network over a x b >= n cells permutes the
numbers, and a value outside [0, n) is sent through again until it lands inside (cycle walking).
Position p goes to shard p mod s, slot p div s, so shard sizes differ by one row at most and any
row's place can be computed from its number alone.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.naming import unused
from tilewright.llm.ranks import numbered

ROUNDS = 6
#: The cells outside [0, n) number less than sqrt(n) + 1, so a walk this long leaves no row outside in
#: practice; a row that is still outside raises an error instead of taking a wrong place.
MAX_WALK = 40


def domain(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and both near the square root of n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over the a x b cells."""
    a, b = domain(n)

    def step(acc: Column, r: Column) -> Column:
        left, right = acc["l"], acc["r"]
        fl = F.pmod(left + F.pmod(F.xxhash64(right, r, F.lit(seed)), F.lit(a)), F.lit(a))
        fr = F.pmod(right + F.pmod(F.xxhash64(left, r, F.lit(seed)), F.lit(b)), F.lit(b))
        even = r % 2 == 0
        return F.struct(F.when(even, fl).otherwise(left).alias("l"), F.when(even, right).otherwise(fr).alias("r"))

    start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["r"] * F.lit(a) + s["l"])


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` in a shuffle of n rows."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)), feistel(x, n, seed),
        lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)),
    )
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def place_of(row_number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of one row number, computed without Spark; equal to what ``shard`` gives."""
    import xxhash

    a, b = domain(n)

    def mix(v: int, r: int) -> int:
        h = 42
        for part, form in ((v, "<q"), (r, "<i"), (seed, "<i")):
            h = xxhash.xxh64(struct.pack(form, part), seed=h).intdigest()
        return h - (1 << 64) if h >= 1 << 63 else h

    x = row_number
    while True:
        left, right = x % a, x // a
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + mix(right, r) % a) % a
            else:
                right = (right + mix(left, r) % b) % b
        x = right * a + left
        if x < n:
            return x % shards, x // shards


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows to shards: doc_id, size, text_crc32, row_number, shard, slot, then row (a struct of the columns of ``keep``) if there are any.

    size is the text's UTF-8 bytes plus 1. A null text counts no bytes and has the checksum of the
    empty text; a null id is an id like any other. Repeated rows each get a place of their own, and
    many of them are numbered in many tasks. An empty table gives an empty result. Other columns of
    the input are ignored, whatever their names.
    """
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), *kept,
    )
    rows = numbered(rows, "key", [F.col("key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], n)
    place = permuted(F.col("row_number"), max(n, 1), seed)
    return (
        rows.withColumn("place", place)
        .select(
            "doc_id", "size", "text_crc32", "row_number",
            F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"), *(["row"] if keep else []),
        )
    )


def sharded_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, then shard and slot, named with underscores before them where the input has such columns.

    Null ids and texts are values like any other, repeated rows get a place each, texts are only hashed,
    and an empty table stays empty.
    """
    names = {c: unused(docs, c) for c in ("shard", "slot")}
    placed = shard(docs, shards, seed, id_col, text_col, keep=tuple(docs.columns))
    return placed.select("row.*", *[F.col(c).alias(new) for c, new in names.items()])
