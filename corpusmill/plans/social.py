"""Queries over feeds, threads, surveys, edges and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as C, social as O
from . import base as B
from .base import query, table

VIEWER, NOW = 7, "2001-08-02 00:00:00"
FEED = ["id", "author_id", "author_name", "author_specialty", "country", "verified", "viewer_liked", "is_following", "like_count", "comment_count", "score"]
_AGE = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0)"
_FEED = f"""{B.LIKES}, {B.FOLLOWS}, {B.POSTS}, {B.PROFILES},
feed AS (
  SELECT p.id, p.author_id, p.created_at, CASE WHEN is_anonymous THEN 'Anonymous Physician' ELSE display_name END AS author_name,
         CASE WHEN is_anonymous THEN NULL ELSE specialty END AS author_specialty, country, verified, l.user_id IS NOT NULL AS viewer_liked,
         f.follower_id IS NOT NULL AS is_following, like_count, comment_count,
         round(CASE WHEN f.follower_id IS NOT NULL THEN 1.5 ELSE 1.0 END::DOUBLE
           * CASE WHEN list_has_any(specialty_tags, (SELECT interests FROM profiles WHERE user_id = {VIEWER})) THEN 1.2 ELSE 1.0 END::DOUBLE
           * (1.0::DOUBLE / (1.0 + {_AGE}))
           + 0.1::DOUBLE * ln(1 + like_count) + 0.05::DOUBLE * ln(1 + comment_count), 6) AS score
  FROM posts p JOIN profiles u ON u.user_id = author_id LEFT JOIN likes l ON l.item_id = p.id AND l.user_id = {VIEWER}
  LEFT JOIN follows f ON f.following_id = author_id AND f.follower_id = {VIEWER}
  WHERE NOT is_deleted AND created_at < TIMESTAMP '{NOW}')"""


def _feed(spark, d, **options):
    return O.feed(B.posts(spark, d), B.profiles(spark, d), B.likes_of(spark, d), B.follows_of(spark, d), viewer=VIEWER, now=NOW, **options)


@query("feed_personalised", f"WITH {_FEED} SELECT {', '.join(FEED)} FROM feed ORDER BY score DESC, id LIMIT 20")
def feed_personalised(spark, d):
    return _feed(spark, d).select(*FEED)


@query("feed_following", f"WITH {_FEED} SELECT {', '.join(FEED)} FROM feed WHERE is_following ORDER BY score DESC, id LIMIT 20")
def feed_following(spark, d):
    return _feed(spark, d, only="following").select(*FEED)


@query("feed_cursor", f"WITH {_FEED} SELECT {', '.join(FEED)} FROM feed WHERE created_at < TIMESTAMP '1998-01-01' ORDER BY score DESC, id LIMIT 20")
def feed_cursor(spark, d):
    return _feed(spark, d, cursor="1998-01-01").select(*FEED)


@query("feed_trending", f"""WITH {_FEED}, top AS (SELECT * FROM feed ORDER BY score DESC, id LIMIT 60)
SELECT id, author_id, like_count + 2 * comment_count AS heat, score FROM top WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS ORDER BY heat DESC, score DESC, id LIMIT 20""")
def feed_trending(spark, d):
    rows = O.trending(B.posts(spark, d), B.profiles(spark, d), B.likes_of(spark, d), B.follows_of(spark, d), viewer=VIEWER, now=NOW, days=30)
    return rows.select("id", "author_id", "heat", "score")


@query("user_posts", f"WITH {B.LIKES}, {B.POSTS} SELECT id, created_at::VARCHAR AS created_at, like_count FROM posts WHERE author_id = 11 AND NOT is_deleted ORDER BY posts.created_at DESC, id LIMIT 20")
def user_posts(spark, d):
    rows = B.posts(spark, d).where("author_id = 11 and not is_deleted").orderBy(F.desc("created_at"), "id").limit(20)
    return rows.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "like_count")


@query("post_with_context", f"""WITH {_FEED} SELECT id, author_name, author_specialty, country, verified, viewer_liked, is_following FROM feed""")
def post_with_context(spark, d):
    rows = O.with_author(B.posts(spark, d).where(~F.col("is_deleted") & (F.col("created_at") < F.lit(NOW).cast("timestamp"))), B.profiles(spark, d))
    return O.with_viewer(rows, VIEWER, B.likes_of(spark, d), B.follows_of(spark, d)).select("id", "author_name", "author_specialty", "country", "verified", "viewer_liked", "is_following")


@query("comments_with_context", f"""WITH {B.LIKES}, {B.FOLLOWS}, {B.PROFILES}, {B.COMMENTS}
SELECT DISTINCT c.id, post_id, CASE WHEN is_anonymous THEN 'Anonymous Physician' ELSE display_name END AS author_name, verified, l.user_id IS NOT NULL AS viewer_liked
FROM comments c JOIN profiles u ON u.user_id = author_id LEFT JOIN likes l ON l.item_id = c.id AND l.user_id = {VIEWER} WHERE NOT is_deleted""")
def comments_with_context(spark, d):
    rows = O.with_author(B.comments(spark, d).where("not is_deleted"), B.profiles(spark, d))
    return O.with_viewer(rows, VIEWER, B.likes_of(spark, d)).select("id", "post_id", "author_name", "verified", "viewer_liked").distinct()


@query("thread_assembly", f"""WITH {B.COMMENTS}, c AS (SELECT DISTINCT id, parent_id FROM comments),
n AS (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS k FROM c WHERE parent_id IS NOT NULL),
p AS (SELECT parent_id, k // 2 AS part, string_agg(id::VARCHAR, ',' ORDER BY k) AS replies FROM n GROUP BY ALL)
SELECT c.id, coalesce(part, 0) AS part, (SELECT count(*) FROM n WHERE n.parent_id = c.id) AS n_replies, coalesce(replies, '') AS replies FROM c LEFT JOIN p ON p.parent_id = c.id WHERE c.parent_id IS NULL""")
def thread_assembly(spark, d):
    """Replies in parts of two, so that threads of several parts come up."""
    rows = O.threads(B.comments(spark, d).select("id", "parent_id", F.lit(0).alias("created_at")).distinct(), part=2)
    return rows.select("id", "part", "n_replies", F.array_join("reply_ids", ",").alias("replies"))


@query("discover_users_offset", f"""WITH {B.FOLLOWS}, {B.PROFILES} SELECT user_id, display_name, follower_count, post_count, f.follower_id IS NOT NULL AS is_following
FROM profiles LEFT JOIN follows f ON f.following_id = user_id AND f.follower_id = {VIEWER} WHERE user_id <> {VIEWER} AND specialty = 'MACHINERY' ORDER BY follower_count DESC, post_count DESC, user_id LIMIT 20 OFFSET 10""")
def discover_users_offset(spark, d):
    return O.discover(B.profiles(spark, d), B.follows_of(spark, d), viewer=VIEWER, specialty="MACHINERY", limit=20, offset=10).select("user_id", "display_name", "follower_count", "post_count", "is_following")


@query("people_search", f"WITH {B.FOLLOWS}, {B.PROFILES} SELECT user_id, display_name FROM profiles WHERE contains(lower(display_name), '42') OR contains(lower(specialty), '42') OR contains(lower(country), 'nation_1')")
def people_search(spark, d):
    p = B.profiles(spark, d)
    return O.search_people(p, "42").select("user_id", "display_name").union(O.search_people(p, "NATION_1").where("country like 'NATION_1%'").select("user_id", "display_name")).distinct()


@query("followers_list", f"WITH {B.FOLLOWS}, {B.PROFILES} SELECT follower_id, display_name FROM follows JOIN profiles ON user_id = follower_id WHERE following_id = 3 ORDER BY follower_id LIMIT 50")
def followers_list(spark, d):
    rows = B.follows_of(spark, d).where("following_id = 3").join(B.profiles(spark, d), F.col("follower_id") == F.col("user_id"))
    return rows.select("follower_id", "display_name").orderBy("follower_id").limit(50)


@query("rls_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def rls_semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("rls_exists_or", """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'signup')""")
def rls_exists_or(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    signed = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey"))
    return O.visible_either(table(spark, d, "customer"), "c_custkey", urgent, signed).select("c_custkey")


@query("existence_flag", "SELECT c_custkey, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS has_responded FROM customer")
def existence_flag(spark, d):
    did = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), F.lit(True).alias("has_responded")).distinct()
    return table(spark, d, "customer").join(did, "c_custkey", "left").fillna(False, ["has_responded"]).select("c_custkey", "has_responded")


@query("ordered_union_distinct", """SELECT o_orderkey AS id, 0 AS source FROM orders WHERE o_custkey = 5 UNION ALL
SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey <> 5""")
def ordered_union_distinct(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return O.first_of_union(o.where("o_custkey = 5").select("id", F.lit(0).alias("source")), o.where("o_orderpriority = '1-URGENT'").select("id", F.lit(1).alias("source")), "id")


_ANSWERS = "SELECT event_id AS answer_id, event_type AS question_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE [user_id % 4, 4 + user_id % 3] END AS options, CASE WHEN event_id % 5 = 0 THEN ' ' || (event_id % 5 + user_id % 5)::VARCHAR || ' ' ELSE props END AS text FROM events"


def answers(spark, d):
    e = table(spark, d, "events")
    options = F.when(F.col("event_id") % 7 != 0, F.array(F.col("user_id") % 4, 4 + F.col("user_id") % 3))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), (F.col("event_id") % 5 + F.col("user_id") % 5).cast("string"), F.lit(" "))).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("answer_id"), F.col("event_type").alias("question_id"), options.alias("options"), text.alias("text"))


@query("survey_option_counts", f"SELECT question_id, option, count(*) AS n FROM (SELECT question_id, unnest(options) AS option FROM ({_ANSWERS})) GROUP BY 1, 2")
def survey_option_counts(spark, d):
    return O.option_counts(answers(spark, d))


@query("survey_scale_stats", f"""SELECT question_id, count(*) AS answers, count(v) AS integers, round(avg(v), 2) AS mean
FROM (SELECT question_id, CASE WHEN regexp_matches(trim(text), '^[+-]?[0-9]+$') THEN trim(text)::BIGINT END AS v FROM ({_ANSWERS})) GROUP BY 1""")
def survey_scale_stats(spark, d):
    return O.scale_stats(answers(spark, d))


@query("capped_collection", f"SELECT answer_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answer_id) AS k FROM ({_ANSWERS}) WHERE text IS NOT NULL) WHERE k <= 200")
def capped_collection(spark, d):
    return O.capped_texts(answers(spark, d)).select("answer_id", "question_id")


@query("counters_from_edges", "SELECT user_id, greatest(0, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END))::BIGINT AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id")
def counters_from_edges(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'view')").withColumn("delta", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return O.counts_from_edges(e, "user_id")


@query("toggle_parity", "SELECT user_id, event_id % 50 AS item FROM events WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle_parity(spark, d):
    requests = table(spark, d, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 50).alias("item"))
    return O.toggled(requests.limit(0), requests, ["user_id", "item"])


_M = "m AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, turn, role, text AS content FROM conversations)"


@query("recursive_active_path", f"""WITH RECURSIVE {_M}, p AS (SELECT id, conversation_id, 0 AS depth FROM m WHERE turn = 0 UNION ALL SELECT m.id, m.conversation_id, depth + 1 FROM p JOIN m ON m.parent_id = p.id)
SELECT id, conversation_id, depth FROM p""")
def recursive_active_path(spark, d):
    m = B.messages(spark, d)
    return C.active_path(spark, m, m.where("turn = 0").select("id"))


@query("siblings", f"WITH {_M} SELECT id, row_number() OVER (PARTITION BY conversation_id, role ORDER BY turn, id) - 1 AS branch_index, count(*) OVER (PARTITION BY conversation_id, role) AS n_siblings FROM m")
def siblings(spark, d):
    m = B.messages(spark, d).withColumn("parent_id", F.col("role")).withColumn("created_at", F.col("turn"))
    return C.siblings(m).select("id", "branch_index", "n_siblings")


@query("history_budget", f"WITH {_M} SELECT id FROM (SELECT id, sum(length(content)) OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS used FROM m) WHERE used <= 800")
def history_budget(spark, d):
    return C.within_budget(B.messages(spark, d), chars=800).select("id")


@query("last_n_history", f"WITH {_M} SELECT id, substr(content, 1, 100) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS k FROM m) WHERE k <= 3")
def last_n_history(spark, d):
    return C.last_messages(B.messages(spark, d), n=3, chars=100).select("id", "content")


@query("last_assistant_message", f"WITH {_M} SELECT conversation_id, max(turn) AS turn, arg_max(content, turn) AS content FROM m WHERE role = 'assistant' GROUP BY 1")
def last_assistant_message(spark, d):
    return C.last_of_role(B.messages(spark, d))


@query("message_visibility", f"WITH {_M} SELECT id FROM m WHERE conversation_id IN (SELECT conversation_id FROM m WHERE turn = 0 AND role = 'system')")
def message_visibility(spark, d):
    m = B.messages(spark, d)
    owned = m.where("turn = 0").select("conversation_id", F.col("role").alias("user_id"))  # whoever opens a conversation owns it
    return O.visible_messages(m, owned, "system").select("id")


@query("anonymised_projection", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Anonymous Physician' ELSE c_name END AS author_name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE c_mktsegment END AS specialty, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def anonymised_projection(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    anonymous = F.col("o_orderstatus") == "P"
    return rows.select("o_orderkey", O.masked(anonymous, F.col("c_name"), O.ANONYMOUS).alias("author_name"), O.masked(anonymous, F.col("c_mktsegment")).alias("specialty"), "c_nationkey")
