"""Feeds, threads, discovery, surveys, counters and visibility over tables of posts, profiles, edges and answers.

A viewer is a parameter, so its own edges are filtered before the join; the clock is a parameter, so plans are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S

ANONYMOUS = "Anonymous Physician"


def masked(anonymous: Column, shown: Column, instead=None) -> Column:
    return F.when(anonymous, F.lit(instead)).otherwise(shown)


def with_author(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Author columns beside each post; of anonymous posts only country and verification are shown."""
    authors = profiles.select(F.col("user_id").alias("author_id"), "display_name", "specialty", "country", "verified")
    anonymous = F.col("is_anonymous")
    return posts.join(authors, "author_id").withColumns({"author_name": masked(anonymous, F.col("display_name"), ANONYMOUS), "author_specialty": masked(anonymous, F.col("specialty"))}).drop("display_name", "specialty")


def with_viewer(rows: DataFrame, viewer, likes: DataFrame | None = None, follows: DataFrame | None = None, key: str = "id", target: str = "author_id") -> DataFrame:
    """viewer_liked and is_following: at most one row of each joins, so no rows are added."""
    if likes is not None:
        own = likes.where(F.col("user_id") == viewer).select(F.col("item_id").alias(key), F.lit(True).alias("viewer_liked")).distinct()
        rows = rows.join(own, key, "left").fillna(False, ["viewer_liked"])
    if follows is not None:
        own = follows.where(F.col("follower_id") == viewer).select(F.col("following_id").alias(target), F.lit(True).alias("is_following")).distinct()
        rows = rows.join(own, target, "left").fillna(False, ["is_following"])
    return rows


def feed_score(now) -> Column:
    """Follow 1.5, shared interest 1.2, both on a decay by days; then the logarithms of likes and comments."""
    return (
        F.when(F.col("is_following"), 1.5).otherwise(1.0) * F.when(F.col("shares_interest"), 1.2).otherwise(1.0) * (1.0 / (1.0 + S.age_days(now, F.col("created_at"))))
        + 0.1 * F.log1p(F.col("like_count"))
        + 0.05 * F.log1p(F.col("comment_count"))
    )


def feed(posts: DataFrame, profiles: DataFrame, likes: DataFrame, follows: DataFrame, *, viewer, now, cursor=None, only: str = "all", limit: int = 20, digits: int = 6) -> DataFrame:
    """The scored feed before the cursor. The score is rounded before it is ranked, so that ranks do not hang on the last bit."""
    live = posts.where(~F.col("is_deleted") & (F.col("created_at") < F.lit(cursor or now).cast("timestamp")))
    rows = with_viewer(with_author(live, profiles), viewer, likes, follows)
    if only == "following":
        rows = rows.where("is_following")
    interests = profiles.where(F.col("user_id") == viewer).select(F.col("interests").alias("viewer_interests")).limit(1)
    rows = rows.join(F.broadcast(interests), how="left").withColumn("shares_interest", F.coalesce(F.arrays_overlap("specialty_tags", "viewer_interests"), F.lit(False)))  # one row, or none
    return rows.withColumn("score", F.round(feed_score(now), digits)).orderBy(F.desc("score"), "id").limit(limit)


def trending(posts, profiles, likes, follows, *, viewer, now, days: int = 7, limit: int = 20, digits: int = 6) -> DataFrame:
    """Of the feed's first 3 * limit, those of the last days, by likes and twice the comments."""
    rows = feed(posts, profiles, likes, follows, viewer=viewer, now=now, limit=3 * limit, digits=digits)
    recent = rows.where(F.col("created_at") >= F.expr(f"timestamp '{now}' - interval {int(days)} days"))
    return recent.withColumn("heat", F.col("like_count") + 2 * F.col("comment_count")).orderBy(F.desc("heat"), F.desc("score"), "id").limit(limit)


def comments_of(comments, profiles, likes, *, post_id, viewer, limit: int = 50) -> DataFrame:
    rows = comments.where((F.col("post_id") == post_id) & ~F.col("is_deleted"))
    return with_viewer(with_author(rows, profiles), viewer, likes).orderBy("created_at", "id").limit(limit)


def threads(comments: DataFrame, part: int = 64) -> DataFrame:
    """Top-level comments with their replies, oldest first, in parts of `part` replies: a row for each part, n_replies in all, and
    reply_ids of the part; a comment without replies is one row, part 0."""
    numbered = comments.where("parent_id is not null").select(F.col("parent_id").alias("_top"), "created_at", F.col("id").alias("reply_id"))
    numbered = numbered.withColumn("_place", F.row_number().over(W.partitionBy("_top").orderBy("created_at", "reply_id")) - 1)
    parts = numbered.groupBy("_top", F.floor(F.col("_place") / part).alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "reply_id"))), lambda r: r["reply_id"]).alias("reply_ids"))
    sizes = numbered.groupBy("_top").agg(F.count(F.lit(1)).alias("n_replies"))
    top = comments.where("parent_id is null").join(sizes, F.col("id") == F.col("_top"), "left").drop("_top").join(parts, F.col("id") == F.col("_top"), "left").drop("_top")
    return top.withColumns({"part": F.coalesce("part", F.lit(0)), "n_replies": F.coalesce("n_replies", F.lit(0)), "reply_ids": F.coalesce("reply_ids", F.array().cast("array<bigint>"))})


def discover(profiles, follows, *, viewer, specialty=None, country=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Other users by followers and posts; a filter that is None does not apply."""
    rows = profiles.where(F.col("user_id") != viewer)
    for column, value in (("specialty", specialty), ("country", country)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return with_viewer(rows, viewer, follows=follows, target="user_id").orderBy(F.desc("follower_count"), F.desc("post_count"), "user_id").offset(offset).limit(limit)


def search_people(profiles: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of name, specialty or country."""
    needle = text.lower()
    return profiles.where(F.contains(F.lower("display_name"), F.lit(needle)) | F.contains(F.lower(F.coalesce("specialty", F.lit(""))), F.lit(needle)) | F.contains(F.lower(F.coalesce("country", F.lit(""))), F.lit(needle)))


def counts_from_edges(edges: DataFrame, key: str, sign: str = "delta") -> DataFrame:
    """A counter kept by +1 and -1 events, never below 0."""
    return edges.groupBy(key).agg(F.greatest(F.lit(0), F.sum(sign)).cast("long").alias("n"))


def toggled(edges: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Edges after all toggle requests: an edge is there where it was there an even number of requests ago."""
    flips = requests.groupBy(*keys).agg((F.count(F.lit(1)) % 2).alias("odd"))
    state = edges.select(*keys).distinct().withColumn("on", F.lit(1)).join(flips, keys, "full")
    return state.where((F.coalesce("on", F.lit(0)) + F.coalesce("odd", F.lit(0))) == 1).select(*keys)


def visible_messages(messages: DataFrame, conversations: DataFrame, user) -> DataFrame:
    """Row-level security: messages of the user's own conversations."""
    return messages.join(conversations.where(F.col("user_id") == user).select("conversation_id"), "conversation_id", "left_semi")


def visible_either(rows: DataFrame, key: str, *allowed: DataFrame) -> DataFrame:
    """Rows whose key is in any of the allowed sets (EXISTS ... OR EXISTS ...)."""
    union = allowed[0].select(key)
    for a in allowed[1:]:
        union = union.union(a.select(key))
    return rows.join(union.distinct(), key, "left_semi")


def option_counts(answers: DataFrame) -> DataFrame:
    """Survey answers with arrays of options: votes of each option; null arrays vote for none."""
    return answers.select("question_id", F.explode("options").alias("option")).groupBy("question_id", "option").agg(F.count(F.lit(1)).alias("n"))


def scale_stats(answers: DataFrame) -> DataFrame:
    """Answers, integers among them and their mean to two places, for each question."""
    n = S.guarded_int(F.col("text"))
    return answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("answers"), F.count(n).alias("integers"), F.round(F.avg(n), 2).alias("mean"))


def capped_texts(answers: DataFrame, limit: int = 200) -> DataFrame:
    """The first texts of each question in the order of their ids."""
    w = W.partitionBy("question_id").orderBy("answer_id")
    return answers.where("text is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def first_of_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Ordered UNION DISTINCT: rows of first, then those of second whose key is new."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
