"""The registry of queries, and the driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts(spark, d) -> DataFrame:
    """Orders as posts: the customer is the author, line items are comments, clicks are likes."""
    comments = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("comment_count"))
    likes = likes_of(spark, d).groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("like_count"))
    o = table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("is_anonymous"), (F.col("o_totalprice") < 20000).alias("is_deleted"), F.array("o_orderpriority").alias("specialty_tags")
    )
    return rows.join(comments, "id", "left").join(likes, "id", "left").fillna(0, ["comment_count", "like_count"])


POSTS = """posts AS (
  SELECT o_orderkey AS id, o_custkey AS author_id, o_orderdate AS created_at, o_orderstatus = 'P' AS is_anonymous, o_totalprice < 20000 AS is_deleted,
         [o_orderpriority] AS specialty_tags, coalesce(c.n, 0) AS comment_count, coalesce(k.n, 0) AS like_count
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT item_id, count(*) AS n FROM likes GROUP BY 1) k ON item_id = o_orderkey)"""


def likes_of(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click'").select((F.col("event_id") * 3 % 5000).alias("item_id"), "user_id").distinct()


LIKES = "likes AS (SELECT DISTINCT event_id * 3 % 5000 AS item_id, user_id FROM events WHERE event_type = 'click')"


def follows_of(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("follower_id"), (F.col("event_id") % 1500).alias("following_id")).distinct()


FOLLOWS = "follows AS (SELECT DISTINCT user_id AS follower_id, event_id % 1500 AS following_id FROM events WHERE event_type = 'view')"


def profiles(spark, d) -> DataFrame:
    followers = follows_of(spark, d).groupBy(F.col("following_id").alias("user_id")).agg(F.count(F.lit(1)).alias("follower_count"))
    written = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("post_count"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    interests = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).otherwise(F.array(F.lit("5-LOW")))
    rows = table(spark, d, "customer").join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("specialty"), "country", F.when(F.col("c_acctbal") > 0, "verified").otherwise("pending").alias("verified"), interests.alias("interests")
    )
    return rows.join(followers, "user_id", "left").join(written, "user_id", "left").fillna(0, ["follower_count", "post_count"])


PROFILES = """profiles AS (
  SELECT c_custkey AS user_id, c_name AS display_name, c_mktsegment AS specialty, n_name AS country, CASE WHEN c_acctbal > 0 THEN 'verified' ELSE 'pending' END AS verified,
         CASE WHEN c_custkey % 2 = 0 THEN ['1-URGENT', '2-HIGH'] ELSE ['5-LOW'] END AS interests, coalesce(f.n, 0) AS follower_count, coalesce(w.n, 0) AS post_count
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT following_id, count(*) AS n FROM follows GROUP BY 1) f ON following_id = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) w ON o_custkey = c_custkey)"""


def comments(spark, d) -> DataFrame:
    """Line items as comments: the first of an order is the parent of the others."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        key.alias("id"), F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("author_id"), F.when(F.col("l_linenumber") > 3, F.col("l_orderkey") * 10 + 1 + F.col("l_linenumber") % 3).alias("parent_id"), (F.col("l_returnflag") == "R").alias("is_anonymous"), (F.col("l_linestatus") == "X").alias("is_deleted"), F.col("l_shipdate").alias("created_at")
    )


COMMENTS = """comments AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS post_id, l_suppkey AS author_id, CASE WHEN l_linenumber > 3 THEN l_orderkey * 10 + 1 + l_linenumber % 3 END AS parent_id,
         l_returnflag = 'R' AS is_anonymous, l_linestatus = 'X' AS is_deleted, l_shipdate AS created_at
  FROM lineitem)"""


def messages(spark, d) -> DataFrame:
    """Conversations as chains of messages."""
    c = table(spark, d, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    last = F.max("turn").over(W.partitionBy("conv_id"))
    return c.select(key.alias("id"), F.col("conv_id").alias("conversation_id"), F.when(F.col("turn") > 0, key - 1).alias("parent_id"), F.when(F.col("turn") < last, key + 1).alias("selected_child_id"), "turn", "role", F.col("text").alias("content"))


def literal(text) -> str:
    """A text as SQL."""
    return "'" + text.replace("'", "''") + "'"


def spliced(text, markers):
    """A text with one of the markers behind it, chosen by the text's length: the corpus's prose has no clinical words."""
    return F.concat_ws(" ", text, F.element_at(F.array(*map(F.lit, markers)), (F.pmod(F.length(text), F.lit(len(markers))) + 1).cast("int")))


def spliced_sql(markers, text: str = "text") -> str:
    return f"{text} || ' ' || ([{', '.join(map(literal, markers))}])[length({text}) % {len(markers)} + 1]"


def first_match_sql(text: str, rules, default: str = "NULL") -> str:
    """CASE over (marker or markers, label); the first that is in the text."""
    cases = [f"WHEN {' OR '.join(f'contains({text}, {literal(m)})' for m in ([k] if isinstance(k, str) else k))} THEN {literal(str(v))}" for k, v in rules]
    return f"CASE {' '.join(cases)} ELSE {default} END"
