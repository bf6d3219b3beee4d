"""Chat formatting with Spark expressions only.

Template: ``<s>`` opens a conversation; each run of turns of one role is ``<|role|>``, its texts joined by
``<+>``, and ``</s>``. Every control string holds ``<``, and inside texts and roles ``^ < |`` are written
``^0 ^1 ^2``, so no text can form one and the way back is exact. The loss mask covers the texts of assistant runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, PART = "<s>", "</s>", "<+>"


def escape(c: Column) -> Column:
    for a, b in (("^", "^0"), ("<", "^1"), ("|", "^2")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("|", "^2"), ("<", "^1"), ("^", "^0")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, formatted.

    Turns stand by (turn, role, text), null turns first; repeated rows stay. A null role or text is empty; rows
    with a null conv_id form one conversation. Other columns are ignored.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    t, n = F.col("turns"), F.size("turns")
    # where a run of one role begins (from 1), and n + 1 to end the last
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"]))
    cut = listed.withColumn("cuts", F.concat(starts, F.array(n + 1)))
    cuts = F.col("cuts")
    runs = F.transform(
        F.slice(cuts, F.lit(1), F.size(cuts) - 1),
        lambda a, i: F.concat(F.lit("<|"), escape(F.get(t, a - 1)["role"]), F.lit("|>"), F.array_join(F.transform(F.slice(t, a, F.get(cuts, i + 1) - a), lambda x: escape(x["text"])), PART), F.lit(CLOSE)),
    )
    return cut.select("conv_id", F.concat(F.lit(OPEN), F.array_join(runs, "")).alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted -> conv_id, formatted, turns (array of role and text, as they went in)."""
    body = F.substring("formatted", len(OPEN) + 1, 2**31 - 1)
    pieces = F.split(body, CLOSE)
    runs = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def unpack(run: Column) -> Column:
        role = unescape(F.substring_index(F.substring(run, 3, 2**31 - 1), "|>", 1))
        texts = F.split(F.substr(run, F.locate("|>", run) + 2), r"<\+>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(runs, unpack)).alias("turns"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Format, read back and digest: one row a conversation."""
    back = read_chats(format_chats(turns)).withColumn("loss_texts", F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]))
    back = back.withColumn("loss", F.array_join("loss_texts", "")).withColumn("spoken", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("spoken").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
