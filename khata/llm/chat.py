"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A log that is written after every turn holds each conversation many times, as growing prefixes. Rolling hashes of the turns
identify every prefix: the XOR over the turns so far of a hash of (position, role, text), in two 64-bit halves, as a window
sum. A conversation whose whole hash is a proper prefix of another one's, or equals that of a conversation with a smaller
id, is dropped by an anti-join; the rest are rendered.

Defined cases: turns are ordered by turn number (nulls first), then role and text. A null role is rendered as ``user``, a null
text as empty; both differ from given values in the hash. Repeated rows are turns of their own. Rows with a null ``conv_id`` are
one conversation. An empty table gives an empty result; columns beside the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
ORDER = (F.asc_nulls_first, ("turn", "role", "text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn: conv_id, n (turns so far), h1 and h2 (hash of these turns), last (whether it is the final turn)."""
    order, names = ORDER
    by_turn = Window.partitionBy("conv_id").orderBy(*(order(c) for c in names))
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(by_turn).alias("n"))
    said = (F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    one, two = F.xxhash64(*said), F.xxhash64(F.lit("second"), *said)
    return placed.select("conv_id", "n", F.bit_xor(one).over(so_far).alias("h1"), F.bit_xor(two).over(so_far).alias("h2"), F.lead("n").over(by_turn).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that no other one continues; of equal ones that with the smallest id."""
    steps = prefixes(turns)
    whole = steps.where("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = steps.where(~F.col("last")).select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def render(turns: DataFrame, keep: DataFrame) -> DataFrame:
    """One row for each conversation of ``keep``, with ``rendered``; a conversation is one text, so its turns are gathered."""
    order, names = ORDER
    kept = keep.withColumnRenamed("conv_id", "kept_id")
    said = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*(order(c) for c in names)))
    message = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("user")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(END))
    lines = said.select("conv_id", "n_turns", "n_equal", place.alias("n"), message.alias("message"))
    return lines.groupBy("conv_id", "n_turns", "n_equal").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n", "message"))), lambda x: x["message"])).alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the maximal conversations."""
    return render(turns, maximal(turns))
