"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written ``### role: text</turn>`` and a newline. Inside roles and texts ``\\`` ``#`` ``<`` become
``\\b`` ``\\h`` ``\\l`` (in roles ``:`` becomes ``\\c``), so that no text can hold a control string and
all can be read back. Turn tokens are estimated at four bytes each.

Windows: every window after the first repeats the system turn that opens the conversation (if it takes at most
half of the budget), so the room for other turns is the budget less that turn. Prefix sums of the turns' tokens
are cut into cells; a window is the turns that start in one cell. A cell is as long as the room less the longest
ordinary turn of the conversation, so the last turn always fits. A turn over half of the budget (a quarter, if a
system turn is repeated) is no ordinary one: it has a window of its own, and alone may pass the budget. Of the
``history`` turns before a window as many are repeated, latest first, as the budget leaves room for. Repeated turns
come first and are masked: the loss covers each assistant text once.

Prefix sums have two levels (blocks of 256 turn numbers, then their totals), so that a very long
conversation is not summed row by row in one task.

Edge cases: null roles and texts are empty, null turns come first, null conversation ids are one
conversation. Turns with one number are ordered by role and text; repeated rows are repeated turns. An empty
table gives no windows. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifline.llm.text import col

END = "</turn>\n"


def escape(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_conversations(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 2,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """One row a window: conv_id, window, formatted, n_repeated, loss_spans (of ``formatted``), n_tokens, over_budget."""
    half, quarter = budget // 2, budget // 4
    empty = F.lit("")
    rows = turns.select(
        col(conv_col).alias("conv"),
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col), empty).alias("role"),
        F.coalesce(col(text_col), empty).alias("text"),
        F.floor(col(turn_col) / 256).alias("part"),
    )
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    rows = rows.withColumn("head", F.concat(F.lit("### "), role, F.lit(": "))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("size", F.ceil((F.octet_length("head") + F.octet_length("body") + len(END)) / 4).cast("bigint"))
    near = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda limit: (F.col("size") > limit).cast("int")
    zero = F.lit(0)
    rows = rows.withColumn("nth", F.row_number().over(near))
    for name, value in (("sum", F.col("size")), ("over2", over(half)), ("over4", over(quarter))):
        rows = rows.withColumn(name, F.coalesce(F.sum(value).over(before), zero))
    parts = turns_totals(rows, half, quarter)
    rows = rows.alias("r").join(parts.alias("p"), F.col("r.conv").eqNullSafe(F.col("p.conv")) & F.col("r.part").eqNullSafe(F.col("p.part")))
    kept = F.col("system") <= half
    rows = rows.select(
        "r.conv",
        (F.col("nth") + F.col("rows_before")).alias("pos"),
        (F.col("sum") + F.col("size_before")).alias("prefix"),
        # a turn with its own window moves what follows to a later cell
        (budget * F.when(kept, F.col("over4") + F.col("over4_before")).otherwise(F.col("over2") + F.col("over2_before"))).alias("moved"),
        F.when(kept, F.col("system")).otherwise(0).alias("kept"),
        F.when(kept, quarter).otherwise(half).alias("ordinary"),
        F.when(kept, F.col("longest4")).otherwise(F.col("longest2")).alias("longest"),
        "role",
        "head",
        "body",
        "size",
    )
    cell = F.floor((F.col("prefix") + F.col("moved")) / (budget - F.col("kept") - F.col("longest") + 1))
    rows = rows.withColumn("window", 2 * cell + (F.col("size") > F.col("ordinary")).cast("int")).drop("moved", "ordinary", "longest")
    starts = rows.groupBy("conv", "window").agg(F.min("pos").alias("first"), F.min("prefix").alias("start"), (budget - F.sum("size") - F.max("kept")).alias("left"))
    back = F.transform(F.sequence(zero, F.lit(history)), lambda k: F.when(k == 0, F.lit(1)).otherwise(F.col("first") - k))
    wanted = starts.where("first > 1").select("conv", "window", F.explode(F.array_distinct(F.filter(back, lambda p: p > 0))).alias("pos"), "first", "start", "left")
    seen = rows.drop("window").alias("r").join(wanted.alias("w"), F.col("r.conv").eqNullSafe(F.col("w.conv")) & (F.col("r.pos") == F.col("w.pos")))
    system = (F.col("r.pos") == 1) & (F.col("kept") > 0)
    seen = seen.where(system | ((F.col("r.pos") >= F.col("first") - history) & (F.col("start") - F.col("prefix") <= F.col("left"))))
    seen = seen.select("r.conv", "r.pos", "role", "head", "body", "size", "w.window", F.lit(True).alias("again"))
    rows = rows.drop("prefix", "kept")
    every = rows.withColumn("again", F.lit(False)).unionByName(seen)
    turn = F.struct("pos", "again", "head", "body", "size", (F.col("role") == target).alias("target"))
    grouped = every.groupBy("conv", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.char_length(t["head"])
        end = begin + F.char_length(t["body"])
        own = F.when(t["target"] & ~t["again"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(start["spans"])
        return F.struct((end + len(END)).alias("at"), F.concat(s["spans"], own).alias("spans"))

    return grouped.select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + t["size"]).alias("n_tokens"),
    ).withColumn("over_budget", F.col("n_tokens") > budget)


def turns_totals(rows: DataFrame, half: int, quarter: int) -> DataFrame:
    """Rows, tokens and turns over ``half`` and ``quarter`` before each block of a conversation; of the whole
    conversation the tokens of the system turn that opens it (null without one) and of the longest turns up to either."""
    order = Window.partitionBy("conv").orderBy("part")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    size = F.col("size")
    longest = lambda limit: F.max(F.when(size <= limit, size))
    over = lambda limit: F.count(F.when(size > limit, 1))
    opening = F.max(F.when((F.col("nth") == 1) & (F.col("role") == "system"), size))
    totals = rows.groupBy("conv", "part").agg(
        F.count("*").alias("n"), F.sum("size").alias("s"), over(half).alias("o2"), over(quarter).alias("o4"),
        longest(half).alias("l2"), longest(quarter).alias("l4"), opening.alias("opening"),
    )
    zero = F.lit(0)
    sums = {"rows_before": "n", "size_before": "s", "over2_before": "o2", "over4_before": "o4"}
    totals = totals.withColumn("opening", F.when(F.row_number().over(order) == 1, F.col("opening")))
    return totals.select(
        "conv",
        "part",
        *[F.coalesce(F.sum(c).over(before), zero).alias(name) for name, c in sums.items()],
        F.max("opening").over(every).alias("system"),
        F.coalesce(F.max("l2").over(every), zero).alias("longest2"),
        F.coalesce(F.max("l4").over(every), zero).alias("longest4"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role and text, each turn once) and losses (array of texts) from the output."""
    pieces = F.split("formatted", END)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substring(x, 5, 2**31 - 1), ": ", 1)
        text = F.substring(x, F.char_length(role) + 7, F.lit(2**31 - 1))
        return F.struct(unescape(F.replace(role, F.lit("\\c"), F.lit(":"))).alias("role"), unescape(text).alias("text"))

    losses = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", "formatted", F.transform(own, turn).alias("turns"), losses.alias("losses"))
