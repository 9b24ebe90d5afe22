"""The SQL table functions, called from SQL: one by one with constants, or for each row of a table of parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import conversations as C, vectors as Vc
from . import base as B, social as So
from .base import ORACLES, query, table
from .retrieval import COS


def _social(spark, d):
    T.register(spark, posts=B.posts(spark, d), profiles=B.profiles(spark, d), likes=B.likes_of(spark, d), follows=B.follows_of(spark, d), comments=B.comments(spark, d))


@query("sql_personalized_feed", ORACLES["feed_personalised"])
def sql_personalized_feed(spark, d):
    _social(spark, d)
    return spark.sql(f"SELECT {', '.join(So.FEED)} FROM get_personalized_feed({So.VIEWER}, TIMESTAMP '{So.NOW}', 'all') ORDER BY score DESC, id LIMIT 20")


@query("sql_following_feed", ORACLES["feed_following"])
def sql_following_feed(spark, d):
    _social(spark, d)
    return spark.sql(f"SELECT {', '.join(So.FEED)} FROM get_personalized_feed({So.VIEWER}, TIMESTAMP '{So.NOW}', 'following') ORDER BY score DESC, id LIMIT 20")


@query("sql_post_with_context", f"WITH {So._FEED} SELECT f.id, author_name, author_specialty, country, verified, viewer_liked, is_following FROM feed f")
def sql_post_with_context(spark, d):
    """Each post before the clock by itself, in one query."""
    _social(spark, d)
    return spark.sql(f"SELECT f.* FROM mill_posts a, LATERAL get_post_with_context(a.id, {So.VIEWER}) f WHERE CAST(a.created_at AS TIMESTAMP) < TIMESTAMP '{So.NOW}'")


@query("sql_comments_with_context", ORACLES["comments_with_context"])
def sql_comments_with_context(spark, d):
    """The comments of each post. Equal ones go at the end, where they meet by post: an aggregate over all comments as they are read
    would hold a file's part of them in one task."""
    _social(spark, d)
    return spark.sql(f"SELECT DISTINCT f.* FROM (SELECT DISTINCT post_id FROM mill_comments) a, LATERAL get_comments_with_context(a.post_id, {So.VIEWER}) f")


@query("sql_discover_users", ORACLES["discover_users_offset"])
def sql_discover_users(spark, d):
    _social(spark, d)
    return spark.sql(f"SELECT * FROM discover_users({So.VIEWER}, 'MACHINERY', NULL) ORDER BY follower_count DESC, post_count DESC, user_id LIMIT 20 OFFSET 10")


#: Turns of one role as siblings.
@query("sql_siblings", f"WITH {So._M} SELECT a.id AS message, b.id, (SELECT count(*) FROM m c WHERE c.conversation_id = b.conversation_id AND c.role = b.role AND c.turn < b.turn) AS branch_index FROM m a JOIN m b ON b.conversation_id = a.conversation_id AND b.role = a.role".replace("c.turn < b.turn", "c.id < b.id"))
def sql_siblings(spark, d):
    m = B.messages(spark, d)
    T.register(spark, messages=m.select("id", "conversation_id", F.col("role").alias("parent_id"), F.col("turn").alias("created_at")))
    return spark.sql("SELECT m.id AS message, s.id, s.branch_index FROM mill_messages m, LATERAL get_siblings(m.id) s")


@query("sql_active_path", f"WITH {So._M} SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) - 1 AS depth FROM m")
def sql_active_path(spark, d):
    m = B.messages(spark, d)
    T.register(spark, paths=C.active_path(spark, m, m.where("turn = 0").select("id")))
    return spark.sql("SELECT c.conversation_id, p.id, p.depth FROM (SELECT DISTINCT conversation_id FROM mill_paths) c, LATERAL get_active_path(c.conversation_id) p")


@query("sql_match_documents", f"SELECT q.vec_id AS query_id, a.vec_id AS id, round({COS}, 6) AS similarity FROM embeddings q, embeddings a WHERE q.vec_id % 20 = 0 AND {COS} >= 0.3")
def sql_match_documents(spark, d):
    """The query set as a table of vectors, matched in blocks."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    T.register(spark, vectors=e, likeness=Vc.reaching(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 0.3))
    return spark.sql("SELECT query_id, id, similarity FROM match_each(0.3D)")
