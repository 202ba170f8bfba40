"""Document fingerprints: the k smallest hashes of a document's word shingles (a bottom-k sketch).

Sketches merge: the sketch of a union is the k smallest of the sketches' union. Two sketches give
estimates of resemblance, containment and distinct shingle counts; with fewer than k shingles on
both sides the estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE_WORDS = 128, 5
#: Hashes have 48 bits, so that one is 8 characters of base 64.
HASH_BITS = 48
#: Range borders of the id order, found by approximate quantiles of all ids: about so many rows in a range, in at most
#: LISTED ranges; in a larger table each of them is cut again into at most CUTS, by quantiles of its own ids.
ROWS_PER_RANGE, LISTED, CUTS = 64, 4_096, 256
NO_ID = -(1 << 63)


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``words`` words split at white space; a shorter text is one run; none without words."""
    w = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    cut = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(words - 1), F.lit(1))),
        lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 64 - HASH_BITS),
    )
    # A one-element transform binds the word list once, so that it is not split again for each shingle.
    return F.element_at(F.transform(F.array(w), lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.array().cast("array<bigint>"))), 1)


def sketch(text: Column, k: int = K, words: int = SHINGLE_WORDS) -> Column:
    """The bottom-k sketch of a text: a sorted array of distinct hashes."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; 1 of two empty sketches, 0 of one."""
    both = F.array_intersect(F.array_intersect(merged(a, b, k), a), b)
    n = F.size(merged(a, b, k))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(both) / F.when(n > 0, n))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null if a is empty."""
    return contained(resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k))


def contained(r: Column, n_a: Column, n_b: Column) -> Column:
    """Share of a in b from their resemblance and sizes; null if a is empty."""
    return F.when(n_a > 0, F.least(F.lit(1.0), r / (1 + r) * (n_a + n_b) / F.when(n_a > 0, n_a)))


def encoded(a: Column) -> Column:
    """A sketch as text: its hashes in order, 6 bytes each, in base 64."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), HASH_BITS // 4, "0")), ""))), "\r\n", "")


def merge_sketches(df: DataFrame, group: str, column: str, k: int = K) -> DataFrame:
    """One sketch per group: ``group``, sketch. Each salt of a group keeps k hashes before they meet, so a large group is spread."""
    rows = df.select(group, F.explode(column).alias("h")).groupBy(group, "h").agg(F.lit(1).alias("_one")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64)))
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy(group, "salt").orderBy("h"))).filter(F.col("n") <= k)
    return least.groupBy(group).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("sketch"))


def last_not_above(borders: Column, value: Column, size: Column, steps: int) -> Column:
    """The index of the last of ``size`` ascending borders that is not above the value (0 if all are), by binary search."""
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi")),
        lambda s, _: F.when(s["hi"] - s["lo"] <= 1, s).otherwise(
            F.when(F.get(borders, middle(s)) <= value, F.struct(middle(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
        ),
        lambda s: s["lo"],
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload=lambda text: F.lit(None).cast("string").alias("payload")) -> DataFrame:
    """doc_id, text, payload, next_text, next_payload; next is the row after in ascending id, the first after the last.

    Ids are integers. Rows go to ranges of ids in one shuffle; the first row of a range, whose id is
    the range's border, goes to the range before as well. A null id comes first, equal ids go by text
    and share a range; null texts are empty. Other input columns are ignored; no rows give no rows.
    """
    order = F.coalesce(F.col(id_col), F.lit(NO_ID))
    n = docs.count()
    listed = max(1, min(LISTED, -(-n // ROWS_PER_RANGE)))
    borders = docs.agg(F.percentile_approx(order, [i / listed for i in range(listed)], 10 * LISTED).alias("q"), F.min(order).alias("m")).first()
    cuts = sorted({borders["m"], *(borders["q"] or [])}) if n else [0]
    literal = F.array(*[F.lit(x).cast("long") for x in cuts])
    top = last_not_above(literal, F.col("_id"), F.lit(len(cuts)), max(1, len(cuts).bit_length()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), order.alias("_id")).withColumn("_top", top)
    inner = min(CUTS, -(-n // (ROWS_PER_RANGE * len(cuts))))
    start = F.get(literal, F.col("_top"))
    if inner > 1:
        # LISTED rows of CUTS numbers at most.
        own = rows.groupBy("_top").agg(F.array_sort(F.array_distinct(F.concat(F.array(F.min("_id")), F.percentile_approx("_id", [i / inner for i in range(inner)], 10 * CUTS)))).alias("_cuts"))
        own = own.withColumn("_before", F.coalesce(F.sum(F.size("_cuts")).over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranges = own.agg(F.sum(F.size("_cuts"))).first()[0]
        rows = rows.join(F.broadcast(own), "_top").withColumn("_in", last_not_above(F.col("_cuts"), F.col("_id"), F.size("_cuts"), CUTS.bit_length() + 1))
        rows = rows.withColumn("_range", F.col("_before") + F.col("_in"))
        start = F.get("_cuts", F.col("_in"))
    else:
        ranges, rows = len(cuts), rows.withColumn("_range", F.col("_top").cast("long"))
    at = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    own, guest = at(F.col("_range"), False), at(F.pmod(F.col("_range") - 1, F.lit(ranges)), True)
    rows = rows.withColumn("_at", F.explode(F.when(start == F.col("_id"), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "_id", F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest")).repartition("_range")
    rows = rows.withColumn("payload", payload(F.col("text")))
    w = Window.partitionBy("_range").orderBy("_guest", "_id", "text")
    return (
        rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_payload", F.lead("payload").over(w))
        .filter(~F.col("_guest")).select("doc_id", "text", "payload", "next_text", "next_payload")
    )


def fingerprints(docs: DataFrame, k: int = K, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sketch, fingerprint, n_distinct of every whole text. Null counts as empty: an empty sketch. Repeated rows keep a row each."""
    s = docs.select(F.col(id_col).alias("doc_id"), sketch(F.col(text_col), k, words).alias("sketch"))
    return s.withColumn("fingerprint", encoded(F.col("sketch"))).withColumn("n_distinct", distinct_count(F.col("sketch"), k))
