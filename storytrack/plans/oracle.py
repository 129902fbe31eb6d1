"""DuckDB SQL mirror of the canonical bindings, for the oracle check.

``with_tables(...)`` prefixes a query with the CTEs it needs. Each CTE here is the
SQL form of the same-named function in storytrack.sources.tables.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"


def plus_s(ts: str, secs: str) -> str:
    return f"make_timestamp(epoch_us({ts}) + CAST({secs} AS BIGINT) * 1000000)"


def minus_s(ts: str, secs: str) -> str:
    return f"make_timestamp(epoch_us({ts}) - CAST({secs} AS BIGINT) * 1000000)"


def hot(score: str, created: str) -> str:
    return (f"(CAST(sign({score}) AS DOUBLE) * log10(greatest(abs(CAST({score} AS DOUBLE)), 1.0)) "
            f"+ (CAST(epoch_ms({created}) AS DOUBLE) / 1000.0 - 1134028003) / 45000.0)")


def r6(x: str) -> str:
    return f"round({x}, 6)"


CTES = {
    "sub": f"""sub AS (
  SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS reddit_short_id, c_name AS name,
         c_mktsegment AS title, '/r/' || c_name || '/' AS url, CAST(NULL AS VARCHAR) AS summary,
         c_mktsegment AS description, 'any' AS submission_type,
         {minus_s(AS_OF, '30 * 86400')} AS created_at,
         {minus_s(AS_OF, '(c_custkey * 11) % 3600')} AS updated_at,
         {minus_s(AS_OF, '(c_custkey * 977) % 21600')} AS seen_at
  FROM customer)""",
    "story": f"""story AS (
  SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS reddit_short_id, o_custkey AS subreddit,
         o_orderpriority AS title, 'anon' AS author, 'http://t/' || CAST(o_orderkey AS VARCHAR) AS url,
         '/comments/' || CAST(o_orderkey AS VARCHAR) AS permalink, 't' AS domain,
         CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'default' WHEN 3 THEN 'self'
              WHEN 4 THEN 'nsfw' ELSE 'http://t/' || CAST(o_orderkey AS VARCHAR) END AS thumbnail,
         CAST(NULL AS VARCHAR) AS distinguished, o_orderstatus = 'F' AS over18, o_orderstatus = 'O' AS is_self,
         CAST(NULL AS VARCHAR) AS selftext, false AS stickied, o_orderdate AS created_at,
         CAST(floor(o_totalprice) AS INTEGER) - 250000 AS score,
         {hot('CAST(floor(o_totalprice) AS INTEGER) - 250000', 'o_orderdate')} AS hotness,
         CAST(o_orderkey % 500 AS INTEGER) AS comments, CAST(o_orderkey % 7 AS INTEGER) AS gilded,
         {plus_s('o_orderdate', 'o_orderkey % 3600')} AS discovered_at,
         {plus_s('o_orderdate', 'o_orderkey % 172800')} AS updated_at,
         {plus_s('o_orderdate', 'o_orderkey % 172800')} AS checked_at,
         CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'hot' END AS feed
  FROM orders)""",
    "hist": f"""hist AS (
  SELECT l_orderkey AS story, l_shipdate AS timestamp, CAST(l_linenumber AS BIGINT) AS tie1,
         l_partkey AS tie2, l_suppkey AS tie3, CAST(floor(l_extendedprice) AS INTEGER) AS score,
         CAST(floor(l_quantity) AS INTEGER) AS comments, CAST(l_returnflag = 'R' AS INTEGER) AS gilded,
         {hot('CAST(floor(l_extendedprice) AS INTEGER)', 'o_orderdate')} AS hotness
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "subhist": """subhist AS (
  SELECT o_orderkey AS id, o_orderdate AS timestamp, o_custkey AS subreddit, o_orderkey AS subscribers,
         CAST(floor(o_totalprice) AS INTEGER) AS active, CAST(o_orderkey % 60 AS INTEGER) AS comment_hide_mins
  FROM orders)""",
    "obs": """obs0 AS (
  SELECT e.*, CASE event_type WHEN 'view' THEN 'new' WHEN 'signup' THEN 'new' WHEN 'click' THEN 'hot'
                              WHEN 'purchase' THEN 'hot' WHEN 'error' THEN 'hot' END AS feed,
         event_id // 100 AS page
  FROM events e),
obs1 AS (
  SELECT o.*, c_name, date_trunc('day', min(ts) OVER (PARTITION BY feed, page)) AS tick
  FROM obs0 o LEFT JOIN customer ON user_id = c_custkey),
obs AS (
  SELECT event_id AS arrival, feed, page, CAST(event_id % 100 AS INTEGER) AS pos, tick,
         CASE WHEN event_type = 'error' THEN 't5' ELSE 't3' END AS kind,
         CAST(user_id * 211 AS VARCHAR) AS short_id, c_name AS subreddit, event_type AS title,
         'u' || CAST(user_id AS VARCHAR) AS author,
         CAST(CAST(epoch(tick) AS BIGINT) - (event_id % 2880) * 60 AS DOUBLE) AS created_utc,
         'example.com' AS domain, CAST(json_extract_string(props, '$.k') AS INTEGER) AS num_comments,
         CAST(event_id % 3 AS INTEGER) AS gilded,
         CASE WHEN event_id % 25 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS score,
         '/r/' || c_name || '/comments/' || CAST(user_id * 211 AS VARCHAR) AS permalink,
         CASE WHEN event_type = 'view' THEN '' ELSE 'text' END AS selftext,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE 'http://i/' || CAST(user_id * 211 AS VARCHAR) END AS thumbnail,
         'http://t/' || CAST(user_id * 211 AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS distinguished,
         event_type = 'view' AS is_self, event_id % 10 = 0 AS over_18, event_id % 50 = 0 AS sticked,
         ts AS seen_at
  FROM obs1)""",
    # Parsed landed pages: children in page order, pos = index in the page; story fields as S3.
    "parsed": f"""parsed_all AS (
  SELECT feed, page, tick, arrival,
         CAST(row_number() OVER (PARTITION BY feed, page ORDER BY pos) - 1 AS INTEGER) AS pos,
         kind, short_id, title, author, make_timestamp(CAST(created_utc AS BIGINT) * 1000000) AS created_at,
         domain, COALESCE(num_comments, 0) AS comments, COALESCE(gilded, 0) AS gilded,
         COALESCE(score, 0) AS score, permalink, NULLIF(selftext, '') AS selftext, subreddit AS subreddit_name,
         NULLIF(thumbnail, '') AS thumbnail, url, distinguished, COALESCE(is_self, false) AS is_self,
         COALESCE(over_18, false) AS over18, COALESCE(sticked, false) AS stickied
  FROM obs),
parsed AS (
  SELECT *, {hot('score', 'created_at')} AS hotness FROM parsed_all WHERE kind = 't3')""",
    # One row per (tick, short_id); hot copy first, then page order.
    "feedu": """feedu0 AS (
  SELECT *, row_number() OVER (PARTITION BY tick, short_id
                                ORDER BY CASE feed WHEN 'hot' THEN 0 ELSE 1 END, page, pos) AS _rn,
         bool_or(feed = 'new') OVER (PARTITION BY tick, short_id) AS in_new
  FROM parsed),
feedu AS (SELECT * EXCLUDE (_rn) FROM feedu0 WHERE _rn = 1)""",
    "abouts": f"""abouts AS (
  SELECT c_name AS name, CASE WHEN c_nationkey = 0 THEN 403 ELSE 200 END AS status,
         CAST(c_custkey AS VARCHAR) AS reddit_short_id, c_mktsegment AS title,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'about ' || c_name END AS summary,
         c_mktsegment AS description, 'public' AS subreddit_type, 'any' AS submission_type,
         '/r/' || c_name || '/' AS url,
         make_timestamp((CAST(epoch({AS_OF}) AS BIGINT) - c_custkey * 3600) * 1000000) AS created,
         CAST(c_custkey % 60 AS INTEGER) AS comment_hide_mins, c_nationkey AS active,
         c_custkey * 13 AS subscribers, c_custkey % 9 = 0 AS over18
  FROM customer)""",
}

DEPENDS = {"parsed": ["obs"], "feedu": ["obs", "parsed"]}


def with_tables(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n"
