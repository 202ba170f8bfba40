"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a turn belongs to the span
in which its first token lies. A window shows the system turn, then as many of the latest earlier
turns as the budget leaves room for, then its own span. Repeated turns carry no loss, so each
assistant turn is a target in exactly one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
OPEN, TEXT, CLOSE_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: A backslash goes behind the first character of each control string inside a text; backslashes are doubled.
CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]))"
#: A run of letters, marks and digits of any script, or any other sign but white space.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x09-\x0D ]"
#: Turns are summed in buckets of so many turn numbers, so a very long conversation is spread.
TURN_BUCKET = 1_024


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(text: Column) -> Column:
    """Words and signs of any script, and four for the template."""
    return (F.regexp_count(text, F.lit(TOKEN)) + 4).cast("long")


def format_chats(conversations: DataFrame, budget: int = 512, history: int = 128, tokens_col: str | None = None) -> DataFrame:
    """conv_id, window, formatted, n_turns (in it), n_repeated (at its front), loss_spans (code points start/length), n_tokens, over_budget.

    ``budget`` and ``history`` count tokens: words and signs, or what ``tokens_col`` says of each turn
    (null: none; the template's four come on top), a tokenizer's counts say. The system turn is the first turn if
    its role is system. A turn longer than the budget has a window of its own that exceeds it
    (over_budget). A null text or role is empty; a null turn number comes first; turns of one number
    go by role and text; a null conversation id is an id. Repeated rows are turns of their own. Other
    input columns are ignored. No rows give no windows.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must lie between 0 and half the budget")
    stride = budget - history
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # A struct is an id even where its field is null, so one partitioning serves the join, the sums and the sort.
    turns = conversations.select(
        F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / F.lit(TURN_BUCKET)))
    turns = turns.withColumn("tokens", tokens_of(F.col("text")))
    # Sums by part carry no text but that of system turns.
    parts = turns.select("conv", "part", "tokens", "turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"))
    parts = parts.groupBy("conv", "part").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"), F.min(F.struct("turn", "role", "text")).alias("head"))
    by_part = Window.partitionBy("conv").orderBy("part")
    upto = by_part.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    before = parts.select(
        "conv", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("turns_before"), head.alias("head"),
    )
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    first = F.struct(F.lit(0).cast("long").alias("nth"), "head.role", "head.text", tokens_of(F.col("head.text")).alias("tokens"), F.lit(0).cast("long").alias("start"))
    placed = turns.join(before, ["conv", "part"]).select(
        "conv", "part", "turn", "role", "text", "tokens", (F.col("turns_before") + F.row_number().over(inside) - 1).alias("nth"),
        (F.col("tokens_before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("start"),
        F.when(F.col("head.role") == "system", first).alias("system"),
    )
    placed = placed.withColumn("span", F.floor(F.col("start") / F.lit(stride)))
    # The system turn goes with the first turn of a span, not with each.
    opens = ~F.lag("span").over(inside).eqNullSafe(F.col("span"))
    placed = placed.withColumn("system", F.when(opens & (F.col("nth") > 0), F.col("system")))
    # A turn is shown in its own span and, if it ends up within the history, again in the next.
    near = F.col("start") >= (F.col("span") + 1) * stride - history
    shown = placed.withColumn("window", F.explode(F.when(near, F.array("span", F.col("span") + 1)).otherwise(F.array("span"))))
    shown = shown.withColumn("own", F.col("window") == F.col("span"))
    windows = shown.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("nth", "role", "text", "tokens", "start", "own"))).alias("turns"),
        F.first(F.when(F.col("own"), F.col("system")), ignorenulls=True).alias("system"),
    ).filter(F.exists("turns", lambda t: t["own"]))
    new = F.filter("turns", lambda t: t["own"])
    windows = windows.withColumn("new", new).withColumn("first", F.element_at("new", 1)["start"])
    new_tokens = F.aggregate("new", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    has_system = F.col("system").isNotNull()
    repeats_system = has_system & (F.element_at("new", 1)["nth"] > 0)
    system_tokens = F.when(repeats_system, F.col("system.tokens")).otherwise(0)
    windows = windows.withColumn("room", F.least(F.lit(history).cast("long"), F.lit(budget) - system_tokens - new_tokens))
    old = F.filter("turns", lambda t: ~t["own"] & (F.col("first") - t["start"] <= F.col("room")) & ~(repeats_system & (t["nth"] == 0)))
    windows = windows.withColumn("old", F.concat(F.when(repeats_system, F.array("system")).otherwise(F.array().cast(placed_type())), F.transform(old, plain)))
    every = F.concat("old", F.transform("new", plain))
    rendered = F.transform(every, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(CLOSE_TEXT + CLOSE)))
    windows = windows.withColumn("n_repeated", F.size("old")).withColumn("every", every).withColumn("rendered", rendered)
    # Where each turn begins in the formatted text, then where its text does.
    begins = F.aggregate(
        "rendered", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(s)))
    )
    windows = windows.withColumn("begins", begins)
    lead = lambda t: F.lit(len(OPEN + TEXT)) + F.char_length(escaped(t["role"]))
    spans = F.transform("every", lambda t, i: F.when(
        (i >= F.col("n_repeated")) & (t["role"] == "assistant"),
        F.struct((F.get("begins", i) + lead(t)).alias("start"), F.char_length(escaped(t["text"])).alias("length")),
    ))
    return windows.select(
        "conv.conv_id", "window", F.array_join("rendered", "").alias("formatted"), F.size("every").alias("n_turns"), "n_repeated",
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
        F.aggregate("every", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    ).withColumn("over_budget", F.col("n_tokens") > budget)


def plain(t: Column) -> Column:
    return F.struct(*[t[c].alias(c) for c in ("nth", "role", "text", "tokens", "start")])


def placed_type() -> str:
    return "array<struct<nth:bigint,role:string,text:string,tokens:bigint,start:bigint>>"


def read_back(windows: DataFrame) -> DataFrame:
    """Turns read from the formatted text alone and its mask: conv_id, turns (role, text in order, repeats left out), loss (texts in order), formatted_chars."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda s: s != "")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces), F.lit(1)))
    turn = lambda s: F.struct(
        unescaped(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), TEXT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(s, TEXT, -1), CLOSE_TEXT, 1)).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    parts = windows.select("conv_id", F.struct("window", F.transform(own, turn).alias("turns"), loss.alias("loss"), F.char_length("formatted").alias("chars")).alias("p"))
    got = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return got.select(
        "conv_id", F.flatten(F.transform("p", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("p", lambda x: x["loss"])).alias("loss"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )
