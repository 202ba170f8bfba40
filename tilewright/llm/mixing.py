"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled and laid end to end; the stream is cut into blocks of equal
token counts. Slots 0, 1, 2 ... of the mix map the points of a golden-ratio (or van der Corput)
sequence through the cumulative weights to a source; the slot's rank within its source names the
block, starting over when the source is used up. Slots that the sequence gives a source too many are
dropped, and the few it gives too few follow at the end, so every source gets exactly its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.naming import unused
from tilewright.llm.ranks import before, bucket_count
from tilewright.llm.scratch import written

GOLDEN = 0.6180339887498949
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
#: Slots are ranked in chunks of so many.
CHUNK = 8_192
#: A table of sources with no more rows than this is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


@dataclass
class Mix:
    """targets: a row per source. sized: a row per document with its place. slots: the schedule. pieces: documents cut at blocks."""

    targets: DataFrame
    sized: DataFrame
    slots: DataFrame
    pieces: DataFrame


def point(i: Column, sequence: str) -> Column:
    if sequence == "golden":
        return F.pmod(i.cast("double") * F.lit(GOLDEN), F.lit(1.0))
    if sequence == "van_der_corput":
        return F.conv(F.reverse(F.lpad(F.bin(i), 40, "0")), 2, 10).cast("double") / F.lit(float(1 << 40))
    raise ValueError(f"no sequence {sequence!r}")


def source_targets(stats: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """stats (source, source_size) with rank, weight and target words.

    Targets share the total by weight; one above cap x its source's size stops there and its excess
    is shared again by weight. With sources in ascending order of cap / weight, a source stops at
    its cap just if its fair share of what those before it leave is no smaller. Null source is last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    t = stats.withColumn("src", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", w)
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("src").asc())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = (
        t.withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_stops", F.col("_cap") * F.col("_rest") <= (F.col("_total") - F.col("_caps")) * F.col("weight"))
    )
    left = F.col("_total") - F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("_stops"), 0.0).otherwise(F.col("weight"))).over(whole)
    t = t.withColumn("_left", left).withColumn("_free", free)
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_left") / F.when(F.col("_free") > 0, F.col("_free"))))
    return t.select("source", "src", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, block_words: int = 1_024, seed: int = 17,
    sequence: str = "golden", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Schedules all documents.

    A null or blank text has no words: it is taken 0 times and is in no block. A null source is a
    source like any other, last in order. Repeated rows each have their own place. An empty table
    gives empty tables. Other columns of the input, of any type and name, only enter the row's hashes.
    """
    b = block_words
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BETWEEN_WORDS), "")).cast("long").alias("size"),
            row_key(docs, seed).alias("key"), row_key(docs, seed + 1).alias("check"),
        ),
        "mix-sizes",
    )
    rows = sized.count()
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    targets = targets.select(
        "*", F.round("target").cast("long").alias("taken_words"),
        F.ceil(F.col("source_size") / F.lit(b)).cast("long").alias("blocks"),
    ).withColumn(
        "slots",
        F.when(F.col("source_size") > 0, F.floor(F.col("taken_words") / F.col("source_size")) * F.col("blocks") + F.ceil(F.pmod(F.col("taken_words"), F.when(F.col("source_size") > 0, F.col("source_size"))) / F.lit(b)))
        .otherwise(0).cast("long"),
    )
    known = targets.agg(F.count("*").alias("n"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
    small = F.broadcast if known["n"] <= BROADCAST_SOURCES else (lambda df: df)

    # The place of every document in its source's shuffled stream.
    keyed = sized.join(small(targets.select(F.col("source").alias("_s"), "src", "source_size", "target")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("part", F.pmod("key", F.lit(bucket_count(rows))))
    parts = before(keyed.groupBy("src", "part").agg(F.sum("size").alias("_n")), ["src"], "part", "_n", "_first").drop("_n")
    inside = Window.partitionBy("src", "part").orderBy("key", "check", "doc_id", "size")
    placed = keyed.join(parts, ["src", "part"]).select(
        "doc_id", "size", "src", "source_size", "target", "key", "check", "part", F.row_number().over(inside).alias("nth"),
        (F.col("_first") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )

    slots = schedule(targets, known["n"], known["slots"], b, sequence, small)
    covers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))
    pieces = placed.select("*", F.explode_outer(covers).alias("block"))
    pieces = pieces.withColumn("piece_start", F.greatest(F.col("start"), F.col("block") * b)).withColumn("piece_end", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b))
    return Mix(targets, placed, slots, pieces)


def row_key(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns; maps, which have no hash, enter as text."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def schedule(targets: DataFrame, sources: int, total: int, b: int, sequence: str, small=lambda df: df) -> DataFrame:
    """The slots: slot, src, rank, epoch, block, words (fewer than the block's only in a source's last slot)."""
    spark = targets.sparkSession
    cells = max(4_096, 4 * sources)
    by_src = Window.orderBy("src")
    edges = (
        targets.filter("slots > 0")
        .withColumn("lo", F.coalesce(F.sum("slots").over(by_src.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.lit(float(max(total, 1))))
        .withColumn("hi", F.coalesce(F.lead("lo").over(by_src), F.lit(1.0)))
    )
    ranges = edges.select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    drawn = spark.range(total).withColumn("u", point(F.col("id"), sequence)).withColumn("cell", F.floor(F.col("u") * cells))
    drawn = drawn.join(ranges, "cell").filter("u >= lo AND u < hi").select("id", "src", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count("*").alias("_n"))
    base = before(counts, ["src"], "chunk", "_n", "_first").drop("_n")
    ranked = drawn.join(base, ["src", "chunk"]).select("src", F.col("id").alias("slot"), (F.col("_first") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("id")) - 1).alias("rank"))
    had = counts.groupBy("src").agg(F.sum("_n").alias("_had"))
    late = (
        targets.filter("slots > 0").join(had, "src", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).filter("_had < slots")
        .select("src", F.explode(F.sequence(F.col("_had"), F.col("slots") - 1)).alias("rank"))
        .select("src", (F.lit(total) + F.col("rank") * F.lit(sources) + F.col("src")).alias("slot"), "rank")
    )
    known = small(targets.select("src", "source_size", "blocks", "slots", "taken_words"))
    every = ranked.unionByName(late).join(known, "src").filter(F.col("rank") < F.col("slots"))
    every = every.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.pmod("rank", "blocks"))
    room = F.least(F.lit(b).cast("long"), F.col("source_size") - F.col("block") * b)
    rest = F.col("taken_words") - F.col("epoch") * F.col("source_size") - F.col("block") * b
    return every.select("slot", "src", "rank", "epoch", "block", F.least(room, rest).alias("words"), room.alias("block_words"))


def taken(m: Mix, b: int = 1_024) -> DataFrame:
    """Words of each document that the mix takes: doc_id, size, source_size, target, taken, key, check, n_copies.

    n_copies counts the slots that take the document's first word.
    """
    uses = m.slots.groupBy("src", "block").agg(
        F.count_if(F.col("words") >= F.col("block_words")).alias("whole"),
        F.sum(F.when(F.col("words") < F.col("block_words"), F.col("words")).otherwise(0)).alias("part_words"),
    )
    got = m.pieces.join(uses, ["src", "block"], "left")
    length = F.col("piece_end") - F.col("piece_start")
    cut = F.greatest(F.lit(0), F.least(F.col("piece_end"), F.col("block") * b + F.col("part_words")) - F.col("piece_start"))
    first = F.col("piece_start") == F.col("start")
    starts = F.col("whole") + F.when(F.col("block") * b + F.col("part_words") > F.col("piece_start"), 1).otherwise(0)
    return (
        got.groupBy("src", "part", "nth", "doc_id", "size", "source_size", "target", "key", "check")
        .agg(
            F.coalesce(F.sum(F.col("whole") * length + cut), F.lit(0)).cast("long").alias("taken"),
            F.coalesce(F.max(F.when(first, starts)), F.lit(0)).cast("long").alias("n_copies"),
        )
        .drop("src", "part", "nth")
    )


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix in whole documents: each is there as often as slots take its first word, with its own columns, whatever their names and types.

    A document without words is in no block and stays once. Rows that are equal in all columns stand for each other.
    """
    uses = taken(mix(docs, seed=seed, **options), options.get("block_words", 1_024))
    uses = uses.groupBy("key", "check").agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("n_copies"))).alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    key, check, copies, nth = (unused(docs, c) for c in ("_key", "_check", "_copies", "_nth"))
    uses = written(uses.select(F.col("key").alias(key), F.col("check").alias(check), F.col("copies").alias(copies), (F.col("rows") > 1).alias(nth)), "mix-copies")
    keyed = docs.withColumns({key: row_key(docs, seed), check: row_key(docs, seed + 1)})
    single = keyed.join(uses.filter(~F.col(nth)), [key, check])
    equal = keyed.join(uses.filter(nth), [key, check]).dropDuplicates([key, check])
    rows = single.unionByName(equal).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
