"""Chat formatting by rotating perspectives.

A dialogue is rendered once for each participant: that speaker's turns become the assistant's, the others
speak as named users, and only the assistant's own words are trained on. Everything is a DataFrame
expression. The result has one row per message of each rendering, in place of one string per dialogue:
a dialogue may be as long as a third of the table, and no task ever holds one whole. ``start`` is the
message's place in the rendered dialogue, so the messages joined by it are the dialogue, and mask_start
and mask_end are places in it too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Roles that take no part but set the scene; they are rendered as system messages from every perspective.
SCENE = ("system",)
#: Turns whose lengths are summed together; the places within such a stretch are summed in one task. Messages
#: without a turn are in stretches by their role and so many first characters.
STRETCH, BEGINNING = 256, 4


def escaped(text: Column) -> Column:
    """Text that can't be taken for a marker."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, perspective, turn, role, chat_role, rendered, start, train, mask_start, mask_end``.

    Messages are in order of turn, role and text. Null conversations are one conversation; a null turn
    comes first; a null role is rendered as the user "unknown" and takes no perspective; a null text is
    empty. Repeated rows and ties are repeated messages. A dialogue without participants, or an empty
    table, gives no rows. The mask (code points, end exclusive) spans the content and the closing marker of
    the assistant's messages and is empty for others. Other columns are not read.
    """
    said = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    speakers = said.select("conv_id", F.col("role").alias("perspective")).filter(F.col("perspective").isNotNull() & ~F.col("perspective").isin(*SCENE)).distinct()
    s, p = said.alias("s"), speakers.alias("p")
    seen = s.join(p, F.col("s.conv_id").eqNullSafe(F.col("p.conv_id"))).select("s.*", "p.perspective")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    scene = F.coalesce(F.col("role").isin(*SCENE), F.lit(False))
    chat_role = F.when(own, "assistant").when(scene, "system").otherwise("user")
    name = F.when(chat_role == "user", F.concat(F.lit(" name="), escaped(F.coalesce("role", F.lit("unknown"))))).otherwise("")
    head = F.concat(F.lit(OPEN), chat_role, name, F.lit("\n"))
    # the text is rendered last, so that it moves once in a row
    shown = seen.select(
        "conv_id", "perspective", "turn", "role", "text", chat_role.alias("chat_role"), own.alias("train"), head.alias("__head"),
        (F.length(head) + F.length(escaped(F.col("text"))) + len(CLOSE) + 1).cast("long").alias("__n"), F.floor(F.col("turn") / STRETCH).alias("__stretch"),
        F.when(F.col("turn").isNull(), F.col("role")).alias("__role"), F.when(F.col("turn").isNull(), F.substring(F.coalesce("text", F.lit("")), 1, BEGINNING)).alias("__begin"),
    )
    # places by prefix sums in two levels: over stretches of turns, then within each
    stretch = ["__stretch", "__role", "__begin"]
    lengths = shown.groupBy("conv_id", "perspective", *stretch).agg(F.sum("__n").alias("__sum"))
    before = Window.partitionBy("conv_id", "perspective").orderBy(*stretch).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("conv_id", "perspective", *stretch, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    a, b = shown.alias("a"), offsets.alias("b")
    same = F.col("a.perspective") == F.col("b.perspective")
    for c in ("conv_id", *stretch):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    within = Window.partitionBy("conv_id", "perspective", *stretch).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = a.join(b, same).select("a.*", "b.__before").withColumn("start", F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0)))
    return placed.select(
        "conv_id", "perspective", "turn", "role", "chat_role", F.concat("__head", escaped(F.col("text")), F.lit(CLOSE + "\n")).alias("rendered"), "start", "train",
        (F.col("start") + F.when(F.col("train"), F.length("__head")).otherwise(0)).alias("mask_start"),
        (F.col("start") + F.when(F.col("train"), F.col("__n") - 1).otherwise(0)).alias("mask_end"),
    )


ORACLE = r"""
WITH speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
seen AS (
  SELECT c.conv_id, p.perspective, CAST(c.turn AS BIGINT) AS turn, c.role, c.text, coalesce(c.role = p.perspective, false) AS train,
         CASE WHEN c.role = p.perspective THEN 'assistant' WHEN c.role = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM conversations c JOIN speakers p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, concat('<|im_start|>', chat_role, CASE WHEN chat_role = 'user' THEN concat(' name=', replace(coalesce(role, 'unknown'), '<|', '<\|')) ELSE '' END, chr(10)) AS head
  FROM seen),
shown AS (SELECT *, concat(head, replace(coalesce(text, ''), '<|', '<\|'), '<|im_end|>', chr(10)) AS rendered FROM headed),
placed AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM shown)
SELECT conv_id, perspective, turn, role, chat_role, rendered, start, train,
       start + CASE WHEN train THEN length(head) ELSE 0 END AS mask_start, start + CASE WHEN train THEN length(rendered) - 1 ELSE 0 END AS mask_end
FROM placed
"""
