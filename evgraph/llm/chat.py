"""Chat formatting with collapse of cumulative snapshots (DataFrame functions only).

Chat logs often hold a conversation again and again as it grows. Every turn adds a hash of
its place, role and text to the hash of the turns before it. A conversation whose last
hash is that of a shorter prefix of another one is contained in that one; an anti-join
drops it. Of equal conversations the smallest id stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import materialize, read_table, row_hash

#: Each turn is rendered with these marks around role and text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rolling(seed: int, over) -> Column:
    """Sum over the turns so far of a hash of place, role and text; it identifies the sequence."""
    return F.sum(row_hash("place", "role", "text", seed=seed).cast("decimal(20,0)")).over(over)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``place`` (from 1, in the order of turn, role and text) and the hash of the turns so far."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.withColumn("place", F.row_number().over(order))
    rolled = rolled.withColumn("h1", _rolling(1, so_far)).withColumn("h2", _rolling(2, so_far))
    next_place = F.lead("place").over(order)
    return rolled.withColumn("is_last", next_place.isNull())


def lone_turns(turns: DataFrame) -> DataFrame:
    """The turns without conv_id, each a conversation of its own, as ``prefixes`` has them."""
    alone = turns.where("conv_id IS NULL").withColumn("place", F.lit(1))
    hashes = [row_hash("place", "role", "text", seed=seed).cast("decimal(30,0)").alias(f"h{seed}") for seed in (1, 2)]
    return alone.select("conv_id", "turn", "role", "text", "place", *hashes, F.lit(True).alias("is_last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` => one row per conversation that stays: ``conv_id``, ``n_turns``, ``copies``.

    ``copies`` counts the equal conversations, itself included. A conversation stays unless
    it equals a proper prefix of another. Nulls in role or text equal nulls only; a null turn comes
    first. Rows without conv_id belong to no common conversation: each is one of a single turn, ``role`` and ``text``
    of which come with it, and names its equals only if none of them has an id. Repeated rows count as turns. Prefixes are reduced to
    distinct ones before the join, so a common opening is one row.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    rolled = prefixes(turns.where("conv_id IS NOT NULL")).withColumns({h: F.col(h).cast("decimal(30,0)") for h in ("h1", "h2")})
    rolled = rolled.withColumns({c: F.lit(None).cast("string") for c in ("role", "text")})
    rolled = materialize(rolled.unionByName(lone_turns(turns)).drop("turn"), "turn-prefixes")
    key = ["place", "h1", "h2"]
    # role and text are there for lone turns only, and those that are equal have equal ones
    whole = rolled.where("is_last").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.first("role").alias("role"), F.first("text").alias("text")
    )
    inner = rolled.where("NOT is_last").select(*key).distinct()
    kept = whole.join(inner, key, "left_anti")
    return kept.select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies", "role", "text")


def _line(open_mark: str, close_mark: str) -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.concat(F.lit(open_mark), role, F.lit("\n"), text, F.lit(close_mark + "\n"))


def render(turns: DataFrame, open_mark: str = OPEN, close_mark: str = CLOSE) -> DataFrame:
    """``conv_id`` and ``text``: the turns in order, one after the other; null role and text are empty. A conversation is one row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", _line(open_mark, close_mark).alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["line"]), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The conversations that stay, rendered: ``conv_id``, ``n_turns``, ``copies`` and ``text``. An empty table gives an empty result."""
    kept = materialize(maximal_conversations(turns), "maximal")
    named = kept.where("conv_id IS NOT NULL").drop("role", "text")
    shown = render(turns.join(named.select("conv_id"), "conv_id", "left_semi"))
    alone = kept.where("conv_id IS NULL").select("conv_id", "n_turns", "copies", _line(OPEN, CLOSE).alias("text"))
    return named.join(shown, "conv_id").select("conv_id", "n_turns", "copies", "text").unionByName(alone)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH turns AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'none ' || row_number() OVER ()) AS conv FROM conversations
), placed AS (
  SELECT conv_id, conv, turn, role, text, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv) AS n_turns
  FROM turns WINDOW w AS (PARTITION BY conv ORDER BY turn, role, text)
), rolled AS (
  SELECT *, sha256(string_agg(concat(length(role), ':', role, length(text), ':', text), '|') OVER (
    PARTITION BY conv ORDER BY place ROWS UNBOUNDED PRECEDING)) AS prefix
  FROM placed
), whole AS (
  SELECT prefix, place, min(conv_id) AS conv_id, coalesce(CAST(min(conv_id) AS VARCHAR), min(conv)) AS conv, count(*) AS copies
  FROM rolled WHERE place = n_turns GROUP BY ALL
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (
    SELECT 1 FROM rolled r WHERE r.place < r.n_turns AND r.prefix = whole.prefix AND r.place = whole.place)
)
SELECT k.conv_id, k.place AS n_turns, k.copies,
  (SELECT string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.place)
   FROM placed p WHERE p.conv = k.conv) AS text
FROM kept k
"""
