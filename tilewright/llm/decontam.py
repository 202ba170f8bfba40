"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of benchmark words; a document is contaminated where it contains one exactly. The
tokens of a window are ordered by how rare they are in the corpus. Containment needs every token of
the window, so the necessary prefix is its rarest token: only places of that token in a document can
lie in an occurrence. A place fixes where the window would start (the positional bound), the start
must leave room for the whole window (the length bound), and what remains is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.naming import text_key, unused
from tilewright.llm.scratch import Scratch, broadcast_if_small, dealt_to_all

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A window table is broadcast in parts of about so many words; a larger benchmark takes more passes.
BROADCAST_WORDS = 2_000_000
#: The item lists of hit windows are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a whole text, A-Z in lower case; none for null."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN_WORDS), "")


def windows_of(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows with the items that have them: window (array), items (sorted array)."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    return (
        items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("window"))
        .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def frequencies(tokens: DataFrame, vocabulary: DataFrame, parts: int) -> DataFrame:
    """How often each vocabulary word occurs in all documents (w): word, n."""
    places = tokens.select(F.explode("w").alias("word"))
    found = None
    for k in range(parts):
        some = places.join(F.broadcast(vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k)), "word")
        found = some if found is None else found.unionByName(some)
    return found.groupBy("word").agg(F.count("*").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """Windows (wid, window, set) with their rarest token (the first of equals by word): anchor, at, wid, window, set."""
    known = F.broadcast(counts) if parts == 1 else counts
    ranked = windows.select("wid", F.posexplode("window").alias("at", "anchor")).join(known.withColumnRenamed("word", "anchor"), "anchor", "left")
    first = F.min_by(F.struct("at", "anchor"), F.struct(F.coalesce("n", F.lit(0)), "anchor", "at"))
    return ranked.groupBy("wid").agg(first.alias("a")).join(windows, "wid").select("a.anchor", "a.at", "wid", "window", "set")


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row per document row: doc_id, n_words, hits (sorted spans start/length in words), items (sorted), n_hit.

    A null or wordless text has no words and no hits; a null or wordless benchmark text has no
    window; one shorter than ``width`` is a single window. An empty benchmark leaves every document
    clean. Repeated rows and equal or null ids keep a row each. A very long text is one row of words, whole. Other input columns are ignored.

    Texts are cut to words once, in a table of which each row has a number. Windows travel as numbers;
    the lists of items that have them, each list once, are looked up for the windows of a document.
    """
    scratch = Scratch(docs.sparkSession)
    raw = scratch.write(windows_of(benchmark, width, item_col, item_text_col), "window-items")
    sets = scratch.write(raw.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "item-lists")
    windows = scratch.write(raw.join(sets, "items").select(F.monotonically_increasing_id().alias("wid"), "window", "set"), "windows")
    size = windows.agg(F.coalesce(F.sum(F.size("window")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // BROADCAST_WORDS))
    words = dealt_to_all(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", words_of(F.col("text")).alias("w"))
    # Written as one line of words each, which takes less memory to write and read than an array.
    lines = scratch.write(words.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("w").alias("n_words"), F.array_join("w", " ").alias("line")), "document-words")
    tokens = lines.filter("n_words > 0").select("row", "n_words", F.split("line", " ").alias("w"))
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    anchors = scratch.write(anchored(windows, frequencies(tokens, vocabulary, parts), parts), "anchors")

    placed = tokens.select("row", "w", "n_words", F.posexplode("w").alias("pos", "word"))
    found = None
    for k in range(parts):
        part = F.broadcast(anchors.filter(F.pmod(F.xxhash64("wid"), F.lit(parts)) == k))
        start = F.col("pos") - F.col("at")
        inside = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
        same = F.when(inside, F.slice(F.col("w"), F.greatest(start + 1, F.lit(1)), F.size("window")) == F.col("window"))
        some = placed.join(part, placed["word"] == part["anchor"]).filter(F.coalesce(same, F.lit(False)))
        some = some.select("row", F.struct(start.alias("start"), F.size("window").alias("length")).alias("span"), "set")
        found = some if found is None else found.unionByName(some)
    hit = scratch.write(found.groupBy("row").agg(F.sort_array(F.collect_set("span")).alias("hits"), F.collect_set("set").alias("sets")), "hits")
    lists = broadcast_if_small(sets, 32 + 48 * F.size("items"), BROADCAST_BYTES)
    named = hit.select("row", F.explode("sets").alias("set")).join(lists, "set").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    none = lambda c: F.coalesce(c, F.array().cast(found_type(c, hit, named)))
    per_doc = lines.select("row", "doc_id", F.col("n_words").cast("long")).join(hit.select("row", "hits"), "row", "left").join(named, "row", "left")
    per_doc = per_doc.select("doc_id", "n_words", none("hits").alias("hits"), none("items").alias("items"))
    return per_doc.select("doc_id", "n_words", "hits", "items", covered.alias("n_hit"))


def found_type(column: str, *tables: DataFrame) -> str:
    return next(t.schema[column].dataType.simpleString() for t in tables if column in t.columns)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any window, with the columns they came with, whatever their names.

    Rows are told apart by id and text, so ids may be null or shared, and rows that are equal in both
    stay or go together. Null and wordless texts stay, as do all documents if the benchmark has no
    words. Texts of any length are whole. An empty table stays empty.
    """
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, text_key(text_col))
    bad, bad_key = unused(keyed, "_bad"), unused(keyed, "_bad_key")
    named = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(key).alias("key")).alias("doc_id"), F.col(text_col).alias("text"))
    found = contamination(named, benchmark, width).filter("n_hit > 0").select(F.col("doc_id.id").alias(bad), F.col("doc_id.key").alias(bad_key)).distinct()
    return keyed.join(found, F.col(id_col).eqNullSafe(F.col(bad)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)
