"""The registered queries of this subpackage: each runs its operator over a whole table and derives the columns that callers compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import chat, debruijn, decontam, mixing, partenum, periodic, quality, sharding, sketch, spelling, suffixdedup, tokencount, toxicity

#: The vocabulary of op3: a parameter, never part of the repository.
VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.load_vocabulary(VOCABULARY_FILE))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


#: A conversation whose texts hold the template's own control strings.
CONTROL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text"))
        for c, t, r, x in CONTROL_CONVERSATION
    ])))
    back = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    scorer = toxicity.learn(docs, labels.filter(~held_out))
    return toxicity.toxicity(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.with_next(table(spark, sf_dir, "documents"), payload=sketch.sketch)
    n = F.char_length("text")
    q = F.floor(n / F.lit(4)).cast("int")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "payload", "next_payload",
        F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)).alias("edited"),
    )
    rows = rows.select("doc_id", "n_chars", "payload", "next_payload", F.sha2("edited", 256).alias("edited_sha256"), sketch.sketch(F.col("edited")).alias("edited_sketch"))
    a, e, x = F.col("payload"), F.col("edited_sketch"), F.col("next_payload")
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", sketch.encoded(a).alias("fingerprint"), sketch.encoded(e).alias("edited_fingerprint"),
        sketch.resemblance(a, e).alias("near_edited"), sketch.resemblance(a, x).alias("near_next"),
        sketch.distinct_count(a).alias("n_shingles"), sketch.distinct_count(e).alias("_e"), sketch.distinct_count(x).alias("_x"),
    )
    share = lambda near, n: sketch.contained(F.col(near), F.col("n_shingles"), F.col(n))
    return rows.withColumns({"in_edited": share("near_edited", "_e"), "in_next": share("near_next", "_x")}).drop("_e", "_x")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = suffixdedup.without_repeats(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = debruijn.without_repeats(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, chosen by the crc32 of the id, repeats a stretch of its own words to its end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    a = F.pmod(F.col("g"), n).cast("int")
    p = (F.floor((n - F.col("a")) / (F.lit(3) + F.pmod(F.col("g"), F.lit(8)))) + 1).cast("int")
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn("words", F.when(F.pmod("h", F.lit(10)) == 0, words))
    chosen = chosen.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapsed_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    found = found.withColumn("top", F.reduce("runs", none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling": op11_spelling,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
