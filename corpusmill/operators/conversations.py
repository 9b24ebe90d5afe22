"""Branching conversations: active path, siblings, histories within budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..scratch import Scratch


def active_path(spark: SparkSession, messages: DataFrame, roots: DataFrame) -> DataFrame:
    """id, conversation_id, depth of the messages reached from the roots by selected_child_id.

    Every message looks back at the one that selected it, and in each round at twice the distance, over all conversations at
    once: the rounds grow with the logarithm of the longest path. What has found its path's first message is set aside, so only
    open messages meet in the next round, each at another one. A message is selected by one other at most; messages on a cycle
    find no first message and are not on a path."""
    scratch = Scratch(spark, "active-path")
    chosen = messages.where("selected_child_id is not null").select(F.col("selected_child_id").alias("id"), F.col("id").alias("far"))
    state = messages.select("id").join(chosen, "id", "left").select("id", F.coalesce("far", "id").alias("far"), F.col("far").isNotNull().cast("int").alias("depth"), F.col("far").isNull().alias("done"))
    state = scratch.save(state, "0")
    rounds = max(1, state.count()).bit_length()
    for turn in range(1, rounds + 1):
        seen = state.select(F.col("id").alias("far"), F.col("far").alias("_far"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        open_ = state.where("not done").join(seen, "far")
        moved = open_.select("id", F.col("_far").alias("far"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        state = scratch.save(state.where("done").union(moved), str(turn))
        if state.where("not done").isEmpty():
            break
    reached = state.where("done").join(roots.select(F.col("id").alias("far")).distinct(), "far", "left_semi")
    return messages.select("id", "conversation_id").join(reached.select("id", "depth"), "id")


def siblings(messages: DataFrame) -> DataFrame:
    """branch_index: the place among the children of the same parent."""
    w = W.partitionBy("conversation_id", "parent_id").orderBy("created_at", "id")
    return messages.withColumn("branch_index", F.row_number().over(w) - 1).withColumn("n_siblings", F.count(F.lit(1)).over(W.partitionBy("conversation_id", "parent_id")))


def within_budget(messages: DataFrame, chars: int = 32_000, turns: int | None = None) -> DataFrame:
    """The newest messages of each conversation whose lengths stay within a budget, up to the first that does not."""
    newest = W.partitionBy("conversation_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("_used", F.sum(F.length("content")).over(newest)).withColumn("_back", F.row_number().over(newest))
    rows = rows.where(F.col("_used") <= chars)  # lengths are not negative, so what follows the first overflow is over too
    return (rows if turns is None else rows.where(F.col("_back") <= turns)).drop("_used", "_back")


def last_messages(messages: DataFrame, n: int = 6, chars: int = 500) -> DataFrame:
    """The last n messages, each cut to chars."""
    newest = W.partitionBy("conversation_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n).drop("_back").withColumn("content", F.substring("content", 1, chars))


def last_of_role(messages: DataFrame, role: str = "assistant") -> DataFrame:
    return messages.where(F.col("role") == role).groupBy("conversation_id").agg(F.max("turn").alias("turn"), F.max_by("content", "turn").alias("content"))


def append_message(messages: DataFrame, new: DataFrame) -> DataFrame:
    """New children added, and their parents' selected child set to the newest of them."""
    chosen = new.groupBy(F.col("parent_id").alias("id")).agg(F.max_by("id", F.struct("created_at", "id")).alias("_child"))
    moved = messages.join(chosen, "id", "left").withColumn("selected_child_id", F.coalesce("_child", "selected_child_id")).drop("_child")
    return moved.unionByName(new)
