"""Chat formatting: cumulative snapshots of one conversation collapse into the longest.

Chat services log a conversation again after every turn, so most logged conversations are
prefixes of longer ones. A rolling hash runs over each conversation's turns (the exclusive
or of two 64-bit hashes of position, role and text); a conversation whose full hash is some
other's proper prefix hash is dropped by an anti-join, equal conversations keep the smallest
id, and what is left is rendered. Prefix hashes and full hashes are made distinct before
they meet, so a first turn that millions share is one row on either side.

All of it is DataFrame operations.

Edge cases: repeated rows of a conversation count once; turns with equal numbers are ordered
by role, then text; nulls sort first and differ from empty strings, and render as empty; rows
with a null conversation id form one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read


def collapse_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies (equal ones, itself included) and rendered text."""
    ws = Workspace(df.sparkSession, "chat-format")
    turns = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    content = F.struct("turn", "role", "text")
    first = (F.row_number().over(order) == 1) | ~content.eqNullSafe(F.lag(content).over(order))
    turns = turns.withColumn("first", first).where("first").withColumn("pos", F.row_number().over(order))
    said = [F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text")]
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = F.struct("pos", F.bit_xor(F.xxhash64("pos", *said)).over(so_far).alias("a"), F.bit_xor(F.xxhash64(*said, F.lit("second"), "pos")).over(so_far).alias("b"))
    block = F.concat(F.lit("### "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    whole = turns.select("conv", rolling.alias("prefix"), F.struct("pos", block.alias("block")).alias("said")).groupBy("conv").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list("prefix")).alias("prefixes"),
        F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda x: x["block"]), "\n\n").alias("rendered"))
    whole = ws.save(whole, "conversations")

    proper = whole.select(F.explode(F.slice("prefixes", F.lit(1), F.col("n_turns").cast("int") - 1)).alias("p")).select("p.*").distinct()
    full = whole.select("conv", F.element_at("prefixes", -1).alias("p")).groupBy("p.pos", "p.a", "p.b").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    kept = full.join(proper, ["pos", "a", "b"], "left_anti").select(F.col("conv").alias("kept"), "n_copies")
    out = whole.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
    return out.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", "rendered")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_conversations(read(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM rows),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY pos) AS said,
         string_agg('### ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) AS rendered
  FROM placed GROUP BY conv_id),
proper AS (SELECT DISTINCT list_slice(said, 1, k) AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM whole)),
full_ones AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY said)
SELECT f.conv_id, w.n_turns, f.n_copies, w.rendered
FROM full_ones f JOIN whole w ON w.conv_id IS NOT DISTINCT FROM f.conv_id
WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.said = f.said)
"""
