r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged
into one block by an array aggregation, their own bounds kept by a part mark; blocks are joined to

    <|turn|>role<|text|>part<|part|>part ...<|end|>

Control strings inside roles and texts are escaped: "~" becomes "~0" and the n-th control string
"~n", so that every "~" in the output is followed by its number and the reverse is a plain
replacement. read_back() splits the output at the marks again; the loss mask covers the parts of
assistant blocks and no marks.

One conversation is one output string, so its turns meet in one task; that is the size of one row.
No other state is held and nothing else is shuffled.

Behaviour: turns sort by (turn, role, text), nulls first, so ties and repeated rows have a fixed order
and all stay; null text and null role count as empty; a row with a null conv_id belongs to the null
conversation; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: Strings that open or close something in common chat templates; "<|" covers this template's marks.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    for i, c in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(c), F.lit(f"~{i}"))
    return text


def unescape(text: Column) -> Column:
    for i, c in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(f"~{i}"), F.lit(c))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Where a block begins: at a turn whose role isn't the one before.
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    size = F.when(F.size("begins") > 0, F.size("turns"))
    ends = F.transform("begins", lambda b, n: F.coalesce(F.get("begins", n + 1), size))
    block = F.transform(
        F.arrays_zip(F.col("begins").alias("a"), ends.alias("b")),
        lambda s: F.concat(
            F.lit(TURN),
            escape(F.get("turns", s["a"])["role"]),
            F.lit(TEXT),
            F.array_join(F.transform(F.slice("turns", s["a"] + 1, s["b"] - s["a"]), lambda t: escape(t["text"])), PART),
            F.lit(END),
        ),
    )
    return turns.withColumn("begins", begins).select("conv_id", F.array_join(block, "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns as they were, loss: the unescaped texts under the loss mask in order, formatted_chars."""
    quote = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split("formatted", quote(TURN)), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.struct(F.substring_index(b, TEXT, 1).alias("role"), F.split(_body(b), quote(PART), -1).alias("parts")))
    turns = F.flatten(F.transform(parsed, lambda b: F.transform(b["parts"], lambda t: F.struct(unescape(b["role"]).alias("role"), unescape(t).alias("text")))))
    loss = F.flatten(F.transform(F.filter(parsed, lambda b: b["role"] == "assistant"), lambda b: F.transform(b["parts"], unescape)))
    return formatted.select("conv_id", turns.cast(TURNS).alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def _body(block: Column) -> Column:
    """What stands between the text mark and the end mark."""
    after = F.instr(block, TEXT) + len(TEXT)
    return F.substring(block, after, F.length(block) - after + 1 - len(END))


def digest_columns(read: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
