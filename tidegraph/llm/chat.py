"""Chat formatting of logged conversations: cumulative snapshots collapse to the longest one before rendering.

A log often keeps a conversation again after every turn. Each turn gets a hash of its position, role and text, and
the running combination of those hashes names every prefix of a conversation by (turns, 128 bits). A conversation
whose whole hash is a proper prefix of another goes (anti-join); of equal ones the smallest id stays. DataFrame
functions alone do all of it. Long conversations are worked on in blocks of turns, so no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.common import materialise, table

#: Turn numbers that one block spans, and turns that one rendered row holds at most.
BLOCK = 4096


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "i", "role", "text")


def prefix_hashes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, i, n, role, text, h1, h2): the i-th of n turns and the hash of the turns up to it.

    Turns are ordered by (turn, role, text), a null turn last. A null role reads as "unknown", a null text as empty.
    """
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 63) - 1)).alias("block"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    own = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    placed = rows.withColumn("i", F.row_number().over(own)).join(sizes, on).withColumn("i", F.col("i") + F.col("before")).drop("before", "_c", "_b")
    hashed = placed.withColumn("x1", _hash(1)).withColumn("x2", _hash(2))
    running = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("b1", "b2")])
    return (
        hashed.join(blocks, on)
        .withColumn("h1", F.bit_xor("x1").over(running).bitwiseXOR(F.col("b1")))
        .withColumn("h2", F.bit_xor("x2").over(running).bitwiseXOR(F.col("b2")))
        .select("conv_id", "i", "n", "role", "text", "h1", "h2")
    )


def collapse(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another; equal ones count once."""
    whole = hashed.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashed.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal conversations as marked-up text: (conv_id, part, n_turns, n_copies, rendered).

    A turn is rendered as `<|im_start|>role`, a line break, the text and `<|im_end|>` with a line break; markers inside a text lose their bar (`<|` becomes `< |`).
    A conversation of up to `block` turns is one row (part 0); a longer one continues in further parts. Rows without
    conv_id form one conversation with a null id. Repeated rows are turns of their own. An empty table gives no rows.
    Columns other than conv_id, turn, role and text are ignored. n_copies counts the logged conversations equal to it.
    """
    rows = prefix_hashes(conversations, block)
    kept = collapse(materialise(rows.select("conv_id", "i", "n", "h1", "h2"), "prefixes")).select(F.col("conv_id").alias("_c"), "n_turns", "n_copies")
    clean = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    turn = F.concat(F.lit("<|im_start|>"), clean("role"), F.lit("\n"), clean("text"), F.lit("<|im_end|>\n"))
    turns = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", F.floor((F.col("i") - 1) / block).alias("part"), "n_turns", "n_copies", F.struct("i", turn.alias("t")).alias("x"))
    texts = turns.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return texts.select("conv_id", "part", "n_turns", "n_copies", F.array_join("x.t", "").alias("rendered"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (SELECT *, list(struct_pack(r := role, x := text)) OVER (PARTITION BY conv_id ORDER BY i) AS pre FROM t),
whole AS (SELECT pre, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE i = n GROUP BY pre, n),
kept AS (SELECT * FROM whole WHERE pre NOT IN (SELECT DISTINCT pre FROM p WHERE i < n))
SELECT conv_id, ((i - 1) // {BLOCK})::BIGINT AS part, kept.n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY ALL
"""
