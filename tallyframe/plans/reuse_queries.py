"""Queries over stored responses: keys, lookups, merges, replays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import reuse as J
from ..session import scratch_path
from ..sources.response_store import ResponseStore
from . import fixtures as V
from .catalog import VIEWS, query, rounded, table


def _kwargs():
    e = F.col("event_id")
    temp = F.when(e % 3 == 0, "0.0").when(e % 3 == 1, "0.7").otherwise(F.lit(None).cast("string"))
    return F.create_map(
        F.lit("temperature"), temp, F.lit("until"), F.lit("stop\n"), F.lit("seed"), F.lit("7"), F.lit("n"), F.when(e % 5 == 0, "2").otherwise("1.0"),
        F.lit("do_sample"), F.when(e % 7 == 0, "true").otherwise("false"),
    )


@query(
    "canonical_gen_kwargs",
    r"""SELECT event_id, '{"do_sample":' || CASE WHEN event_id % 7 = 0 THEN 'true' ELSE 'false' END || ',"n":' || CASE WHEN event_id % 5 = 0 THEN '2' ELSE '1' END || ',"temperature":'
 || CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.7' ELSE 'null' END || ',"until":"stop\n"}' AS kwargs FROM events""",
)
def canonical_gen_kwargs(spark, d):
    return table(spark, d, "events").select("event_id", J.canonical_gen_kwargs(_kwargs()).alias("kwargs"))


DETERMINISTIC = "(event_id % 4 = 0 OR (event_id % 3 <> 1 AND event_id % 5 <> 0 AND event_id % 7 <> 0))"


def _typed():
    return F.when(F.col("event_id") % 4 == 0, "loglikelihood").otherwise("generate_until")


@query("is_deterministic", f"SELECT event_id, {DETERMINISTIC} AS deterministic FROM events")
def is_deterministic(spark, d):
    return table(spark, d, "events").select("event_id", J.is_deterministic(_typed(), _kwargs()).alias("deterministic"))


@query(
    "content_hash",
    "SELECT conv_id, turn, substring(sha256(role || chr(0) || text), 1, 16) AS hash FROM conversations WHERE strlen(role || chr(0) || text) > 0",
)
def content_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", J.content_hash(F.array("role", "text")).alias("hash"))


def _requests(spark, d):
    e = table(spark, d, "events")
    return J.with_cache_key(
        e.select(
            "event_id",
            F.col("event_type").alias("task"),
            F.col("user_id").cast("string").alias("doc_id"),
            F.lit(0).alias("idx"),
            _typed().alias("request_type"),
            F.concat(F.lit("p "), F.col("user_id").cast("string")).alias("context"),
            F.lit(None).cast("string").alias("continuation"),
            _kwargs().alias("gen_kwargs"),
        )
    )


VIEWS["keyed"] = f"""
SELECT event_id, {DETERMINISTIC} AS deterministic, sha256('v:1:3;rt:' || length(rt) || ':' || rt || ';tn:' || length(event_type) || ':' || event_type || ';did:' || length(CAST(user_id AS VARCHAR)) || ':' || user_id || ';idx:1:0;gk:' || length(gk) || ':' || gk
 || ';ch:16:' || substring(sha256('p ' || user_id), 1, 16) || ';') AS k FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'loglikelihood' ELSE 'generate_until' END AS rt,
 '{{"do_sample":' || CASE WHEN event_id % 7 = 0 THEN 'true' ELSE 'false' END || ',"n":' || CASE WHEN event_id % 5 = 0 THEN '2' ELSE '1' END || ',"temperature":'
 || CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.7' ELSE 'null' END || ',"until":"stop\\n"}}' AS gk FROM events)"""


@query("cache_key", " SELECT event_id, deterministic, CASE WHEN deterministic THEN k END AS cache_key FROM keyed", ["keyed"])
def cache_key(spark, d):
    return _requests(spark, d).select("event_id", "deterministic", "cache_key")


VIEWS["asked"] = """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_custkey % 400 AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'nothing' END END AS cache_key, o_orderkey % 6 > 0 AS deterministic FROM orders"""


def asked(spark, d):
    """Requests by key, many of them repeated, every sixth not deterministic."""
    o = F.col("o_orderkey")
    kind = F.when(o % 3 == 0, "view").when(o % 3 == 1, "click").otherwise("nothing")
    key = F.concat((F.col("o_custkey") % 400).cast("string"), kind)
    return table(spark, d, "orders").select(
        o.alias("request_id"), F.when(o % 6 > 0, key).alias("cache_key"), (o % 6 > 0).alias("deterministic")
    )


VIEWS["local"] = """
SELECT cache_key, arg_max(response, (created_at, response)) AS response FROM stored WHERE deterministic AND trim(response) <> '' AND event_id % 2 = 0 GROUP BY cache_key"""
VIEWS["shared"] = """
SELECT cache_key, arg_max(response, (created_at, response)) AS response FROM stored WHERE deterministic AND trim(response) <> '' AND event_id % 2 = 1 GROUP BY cache_key"""


def _tables(spark, d):
    s = V.stored(spark, d)
    none = s.where("false")
    return J.store_responses(none, s.where("event_id % 2 = 0")), J.store_responses(none, s.where("event_id % 2 = 1"))


ORIGIN = "CASE WHEN NOT a.deterministic THEN 'skipped' WHEN l.response IS NOT NULL THEN 'local' WHEN s.response IS NOT NULL THEN 'shared' ELSE 'miss' END"
REUSED = f"FROM asked a LEFT JOIN local l ON a.deterministic AND l.cache_key = a.cache_key LEFT JOIN shared s ON a.deterministic AND s.cache_key = a.cache_key"
LOOKUP = ["stored", "asked", "local", "shared"]


@query(
    "reuse_responses",
    f" SELECT a.request_id, a.cache_key, a.deterministic, COALESCE(l.response, s.response) AS response, {ORIGIN} AS origin {REUSED}",
    LOOKUP,
)
def reuse_responses(spark, d):
    local, shared = _tables(spark, d)
    return J.reuse_responses(asked(spark, d), local, shared)


@query("misses", f" SELECT a.request_id, a.cache_key FROM asked a LEFT JOIN local l ON a.deterministic AND l.cache_key = a.cache_key WHERE l.response IS NULL", LOOKUP)
def misses(spark, d):
    local, _ = _tables(spark, d)
    return J.misses(J.reuse_responses(asked(spark, d), local)).select("request_id", "cache_key")


@query(
    "reuse_stats",
    f""", r AS (SELECT {ORIGIN} AS o {REUSED}) SELECT count(*) FILTER (WHERE o IN ('local', 'shared')) AS hits, count(*) FILTER (WHERE o = 'shared') AS hits_shared, count(*) FILTER (WHERE o = 'miss') AS misses,
 count(*) FILTER (WHERE o = 'skipped') AS skipped_non_deterministic, round(count(*) FILTER (WHERE o IN ('local', 'shared')) / greatest(1, count(*) FILTER (WHERE o <> 'skipped')), 6) AS hit_rate, (SELECT count(*) FROM local) AS total_cached_entries FROM r""",
    LOOKUP,
)
def reuse_stats(spark, d):
    local, shared = _tables(spark, d)
    return rounded(J.reuse_stats(J.reuse_responses(asked(spark, d), local, shared), local))


@query(
    "store_responses",
    """ SELECT cache_key, arg_max(response, created_at) AS response, max(created_at) AS created_at FROM
 (SELECT * FROM stored WHERE event_id % 3 = 0 UNION ALL SELECT * FROM stored WHERE event_id % 3 > 0 AND deterministic AND trim(response) <> '') GROUP BY cache_key""",
    ["stored"],
)
def store_responses(spark, d):
    s = V.stored(spark, d)
    return J.store_responses(s.where("event_id % 3 = 0"), s.where("event_id % 3 > 0")).select("cache_key", "response", "created_at")


@query(
    "upsert_responses",
    """ SELECT cache_key, arg_max(response, (created_at, response)) AS response, max(created_at) AS created_at FROM stored WHERE deterministic AND trim(response) <> '' GROUP BY cache_key""",
    ["stored"],
)
def upsert_responses(spark, d):
    """A stored table that grows by batches; the last one has few keys and rewrites few parts."""
    s, store = V.stored(spark, d), ResponseStore(spark, scratch_path(spark, "responses"), digits=1)
    late = F.pmod(F.xxhash64("cache_key"), F.lit(100)) == 0
    for batch in (s.where("event_id % 2 = 0"), s.where((F.col("event_id") % 2 == 1) & ~late), s.where((F.col("event_id") % 2 == 1) & late)):
        store.add(batch)
    return store.read().select("cache_key", "response", "created_at")


@query(
    "replay_into_store",
    """, t AS (SELECT cache_key, response, created_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) AS r FROM stored WHERE deterministic AND trim(response) <> '' AND event_id % 50 = 1) WHERE r = 1),
 u AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at) AS r FROM stored WHERE deterministic AND cache_key NOT IN (SELECT cache_key FROM t))
 SELECT cache_key, response, created_at FROM t UNION ALL SELECT cache_key, response, created_at FROM u WHERE r = 1""",
    ["stored"],
)
def replay_into_store(spark, d):
    s, store = V.stored(spark, d), ResponseStore(spark, scratch_path(spark, "responses"), digits=1)
    store.add(s.where("event_id % 50 = 1"))
    store.replay(s)
    return store.read().select("cache_key", "response", "created_at")


@query(
    "merge_shards",
    """ SELECT cache_key, response, created_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY shard, created_at) AS r FROM stored) WHERE r = 1""",
    ["stored"],
)
def merge_shards(spark, d):
    s = V.stored(spark, d)
    return J.merge_shards(s.where("shard = 0"), s.where("shard > 0")).select("cache_key", "response", "created_at")


@query(
    "merge_audit",
    """ SELECT cache_key, response, created_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY shard, created_at) AS r FROM stored WHERE deterministic) WHERE r = 1
 UNION ALL SELECT cache_key, response, created_at FROM stored WHERE NOT deterministic""",
    ["stored"],
)
def merge_audit(spark, d):
    return J.merge_audit(V.stored(spark, d)).orderBy("created_at").select("cache_key", "response", "created_at")


@query(
    "replay_audit",
    """, t AS (SELECT * FROM stored WHERE deterministic AND event_id % 50 = 1), u AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at) AS r FROM stored WHERE deterministic AND cache_key NOT IN (SELECT cache_key FROM t))
 SELECT cache_key, response, created_at FROM t UNION ALL SELECT cache_key, response, created_at FROM u WHERE r = 1""",
    ["stored"],
)
def replay_audit(spark, d):
    s = V.stored(spark, d)
    return J.replay_audit(s.where("deterministic and event_id % 50 = 1"), s).select("cache_key", "response", "created_at")


def echo(batches):
    """A stand-in responder: answers with the key, or with the request number."""
    for b in batches:
        text = b["cache_key"].where(b["cache_key"].notna(), "r" + b["request_id"].astype(str))
        yield b.assign(response="got " + text, created_at=pd.Series(1.0, index=b.index))


@query(
    "fill_misses",
    " SELECT a.request_id, 'got ' || COALESCE(a.cache_key, 'r' || a.request_id) AS response FROM asked a LEFT JOIN local l ON a.deterministic AND l.cache_key = a.cache_key WHERE l.response IS NULL",
    LOOKUP,
)
def fill_misses(spark, d):
    local, _ = _tables(spark, d)
    miss = J.misses(J.reuse_responses(asked(spark, d), local))
    return J.fill_misses(miss, echo).select("request_id", "response")
