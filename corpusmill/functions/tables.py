"""SQL table functions with parameters: feeds, threads, discovery, message trees and vector search, called from SQL.

register() makes the tables that a caller names into temporary views and the functions over them. A function's body is part of the
query that calls it, so filters on its parameters reach the scans, and a LATERAL call over a table of parameters is a join.
match_documents() scores one vector against all, in expressions; for a table of vectors, mill_likeness are the pairs that
vectors.reaching() finds in blocks, and match_each() gives those above a floor of its own, which the view's must not pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The views that the functions read, and their columns.
VIEWS = {
    "mill_posts": "id author_id created_at is_anonymous is_deleted specialty_tags like_count comment_count",
    "mill_profiles": "user_id display_name specialty country verified interests follower_count post_count",
    "mill_likes": "item_id user_id",
    "mill_follows": "follower_id following_id",
    "mill_comments": "id post_id author_id is_anonymous is_deleted",
    "mill_messages": "id conversation_id parent_id created_at",
    "mill_paths": "id conversation_id depth",
    "mill_vectors": "id embedding",
    "mill_likeness": "query_id id cosine",
}
_AUTHOR = "CASE WHEN {0}.is_anonymous THEN 'Anonymous Physician' ELSE u.display_name END"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (a, x) -> a + x)"
_COSINE = f"{_DOT.format('v.embedding', 'p_query')} / (sqrt({_DOT.format('v.embedding', 'v.embedding')}) * sqrt({_DOT.format('p_query', 'p_query')}))"
FUNCTIONS = {
    "get_post_with_context(p_post BIGINT, p_viewer BIGINT) RETURNS TABLE(id BIGINT, author_name STRING, author_specialty STRING, country STRING, verified STRING, viewer_liked BOOLEAN, is_following BOOLEAN)": f"""
        SELECT p.id, {_AUTHOR.format('p')}, CASE WHEN NOT p.is_anonymous THEN u.specialty END, u.country, u.verified, l.item_id IS NOT NULL, f.following_id IS NOT NULL
        FROM mill_posts p JOIN mill_profiles u ON u.user_id = p.author_id
        LEFT JOIN mill_likes l ON l.item_id = p.id AND l.user_id = p_viewer LEFT JOIN mill_follows f ON f.following_id = p.author_id AND f.follower_id = p_viewer
        WHERE p.id = p_post AND NOT p.is_deleted""",
    "get_personalized_feed(p_viewer BIGINT, p_now TIMESTAMP, p_mode STRING) RETURNS TABLE(id BIGINT, author_id BIGINT, author_name STRING, author_specialty STRING, country STRING, verified STRING, viewer_liked BOOLEAN, is_following BOOLEAN, like_count BIGINT, comment_count BIGINT, score DOUBLE)": f"""
        SELECT p.id, p.author_id, {_AUTHOR.format('p')}, CASE WHEN NOT p.is_anonymous THEN u.specialty END, u.country, u.verified, l.item_id IS NOT NULL, f.following_id IS NOT NULL, p.like_count, p.comment_count,
               round(CASE WHEN f.following_id IS NOT NULL THEN 1.5D ELSE 1.0D END * CASE WHEN arrays_overlap(p.specialty_tags, me.interests) THEN 1.2D ELSE 1.0D END
                 * (1.0D / (1.0D + (unix_micros(p_now) - unix_micros(CAST(p.created_at AS TIMESTAMP))) / 86400000000.0D)) + 0.1D * log1p(p.like_count) + 0.05D * log1p(p.comment_count), 6)
        FROM mill_posts p JOIN mill_profiles u ON u.user_id = p.author_id LEFT JOIN mill_profiles me ON me.user_id = p_viewer
        LEFT JOIN mill_likes l ON l.item_id = p.id AND l.user_id = p_viewer LEFT JOIN mill_follows f ON f.following_id = p.author_id AND f.follower_id = p_viewer
        WHERE NOT p.is_deleted AND CAST(p.created_at AS TIMESTAMP) < p_now AND (p_mode = 'all' OR (p_mode = 'following' AND f.following_id IS NOT NULL))""",
    "get_comments_with_context(p_post BIGINT, p_viewer BIGINT) RETURNS TABLE(id BIGINT, post_id BIGINT, author_name STRING, verified STRING, viewer_liked BOOLEAN)": f"""
        SELECT c.id, c.post_id, {_AUTHOR.format('c')}, u.verified, l.item_id IS NOT NULL
        FROM mill_comments c JOIN mill_profiles u ON u.user_id = c.author_id LEFT JOIN mill_likes l ON l.item_id = c.id AND l.user_id = p_viewer
        WHERE c.post_id = p_post AND NOT c.is_deleted""",
    "discover_users(p_viewer BIGINT, p_specialty STRING, p_country STRING) RETURNS TABLE(user_id BIGINT, display_name STRING, follower_count BIGINT, post_count BIGINT, is_following BOOLEAN)": """
        SELECT u.user_id, u.display_name, u.follower_count, u.post_count, f.following_id IS NOT NULL
        FROM mill_profiles u LEFT JOIN mill_follows f ON f.following_id = u.user_id AND f.follower_id = p_viewer
        WHERE u.user_id <> p_viewer AND (p_specialty IS NULL OR u.specialty = p_specialty) AND (p_country IS NULL OR u.country = p_country)""",
    "get_siblings(p_message BIGINT) RETURNS TABLE(id BIGINT, branch_index BIGINT)": """
        SELECT s.id, count(b.id) FROM mill_messages m JOIN mill_messages s ON s.conversation_id = m.conversation_id AND s.parent_id <=> m.parent_id
        LEFT JOIN mill_messages b ON b.conversation_id = s.conversation_id AND b.parent_id <=> s.parent_id AND (b.created_at < s.created_at OR (b.created_at = s.created_at AND b.id < s.id))
        WHERE m.id = p_message GROUP BY s.id""",
    "get_active_path(p_conversation BIGINT) RETURNS TABLE(id BIGINT, depth BIGINT)": "SELECT p.id, CAST(p.depth AS BIGINT) FROM mill_paths p WHERE p.conversation_id = p_conversation",
    "match_documents(p_query ARRAY<DOUBLE>, p_floor DOUBLE) RETURNS TABLE(id BIGINT, similarity DOUBLE)": f"SELECT v.id, round({_COSINE}, 6) FROM mill_vectors v WHERE {_COSINE} >= p_floor",
    "match_each(p_floor DOUBLE) RETURNS TABLE(query_id BIGINT, id BIGINT, similarity DOUBLE)": "SELECT v.query_id, v.id, round(v.cosine, 6) FROM mill_likeness v WHERE v.cosine >= p_floor",
}


def register(spark: SparkSession, **views: DataFrame) -> None:
    """views: DataFrames by the names of VIEWS without mill_; only functions whose views are all given are made."""
    for name, df in views.items():
        df.select(*VIEWS[f"mill_{name}"].split()).createOrReplaceTempView(f"mill_{name}")
    for head, body in FUNCTIONS.items():
        if {v for v in VIEWS if f"{v} " in f"{body} "} <= {f"mill_{v}" for v in views}:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
