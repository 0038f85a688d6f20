"""Multi-party perspective rotation of conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.llm.common import settle


def rotate_perspectives(turns: DataFrame, segment_turns: int = 4096) -> DataFrame:
    """(conv_id, perspective, segment, ahead, n_turns, n_trained, n_chars, text, mask): one row for each dialogue
    and participant, with that participant as the assistant.

    ``turns`` has (conv_id, turn, role, text). Every role but ``system`` is a participant. In its
    perspective its turns are rendered as ``<|assistant|>``, those of the others as ``<|user:NAME|>``,
    system turns as ``<|system|>``, each followed by a newline, the text, ``<|end|>`` and a newline.
    ``mask`` lists start:end of what is trained on, in code points of ``text``: the assistant's texts with
    their end marks. Turns are ordered by (turn, role, text); equal rows are turns of their own.

    So that no text or name can forge a mark, ``<|`` is written ``<\\|`` in both, and in names ``|>`` is written
    ``|\\>`` and a newline as a blank. ``perspective`` is the name as it is.

    A dialogue of more than ``segment_turns`` turns goes on in further rows (segment 1, 2, ...), so that no
    row grows without bound; offsets count from the start of the segment, which is ``ahead`` code points after that of
    the dialogue: the texts of all segments in turn are the whole dialogue. A null conv_id or role is a
    conversation or participant named by null and ``unknown``; a null text is empty, a null turn comes first.
    A conversation with system turns only has no participant and gives no row.
    """
    kept = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The place of a turn among those of its conversation, by blocks of turn numbers: no task needs a whole conversation.
    kept = kept.withColumn("block", F.coalesce(F.floor(F.col("turn") / 1024), F.lit(-(2**62))).cast("long"))
    blocks = kept.groupBy(F.col("conv_id").alias("conv"), F.col("block").alias("of")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("conv", "of", ahead.alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    placed = kept.withColumn("inside", inside).join(blocks, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("of")))
    placed = placed.select("conv_id", "role", "text", (F.col("ahead") + F.col("inside") - 1).alias("place"))
    placed = settle(placed.withColumn("segment", F.expr(f"place div {segment_turns}")))

    people = placed.where("role <> 'system'").select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    mine = placed.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.col("role") == F.col("perspective")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    name = F.translate(F.replace(safe(F.col("role")), F.lit("|>"), F.lit("|\\>")), "\n", " ")
    head = F.when(F.col("role") == "system", "<|system|>\n").when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))
    said = mine.select("conv_id", "perspective", "segment", "place", head.alias("head"), F.concat(safe(F.col("text")), F.lit("<|end|>")).alias("body"), own.alias("own"))
    row = ["conv_id", "perspective", "segment"]
    before = Window.partitionBy(*row).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(F.length("head") + F.length("body") + 1).over(before), F.lit(0)) + F.length("head")
    said = said.withColumn("left", left).withColumn("span", F.when(F.col("own"), F.concat_ws(":", "left", F.col("left") + F.length("body"))))
    rows = said.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("place", "span", "head", "body"))).alias("ms"))
    rows = rows.select(
        *row,
        F.size("ms").cast("long").alias("n_turns"),
        F.size(F.filter("ms", lambda m: m["span"].isNotNull())).cast("long").alias("n_trained"),
        F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.transform("ms", lambda m: m["span"]), ",").alias("mask"),
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    ahead = F.coalesce(F.sum("n_chars").over(Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(*row, ahead.alias("ahead"), "n_turns", "n_trained", "n_chars", "text", "mask")
