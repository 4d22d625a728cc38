"""Reuse of stored model responses as table operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import first_by, last_by

# Generation settings that change a response.
RELEVANT = [
    "best_of",
    "do_sample",
    "max_gen_toks",
    "max_new_tokens",
    "n",
    "num_beams",
    "num_return_sequences",
    "repetition_penalty",
    "temperature",
    "top_k",
    "top_p",
    "until",
]
KEY_VERSION = "3"
LIKELIHOOD = "loglikelihood"


def canonical_gen_kwargs(kwargs: Column) -> Column:
    """Relevant settings as compact JSON in key order; whole floats as integers. kwargs: map<string,string> of JSON
    values or plain words."""
    kept = F.array_sort(F.map_entries(F.map_filter(kwargs, lambda k, v: k.isin(*RELEVANT))))

    def value(v: Column) -> Column:
        whole = F.regexp_extract(v, r"^(-?\d+)\.0*$", 1)
        bare = F.rlike(v, F.lit(r"^(-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null|\[.*\]|\".*\")$"))
        quoted = F.to_json(F.struct(v.alias("v")))
        text = F.when(v.isNull(), "null").when(whole != "", whole).when(bare, v)
        return text.otherwise(F.regexp_extract(quoted, r'(?s)^\{"v":(.*)\}$', 1))

    body = F.array_join(F.transform(kept, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), value(e["value"]))), ",")
    return F.when(kwargs.isNull() | (F.size(kept) == 0), "{}").otherwise(F.concat(F.lit("{"), body, F.lit("}")))


def is_deterministic(request_type: Column, kwargs: Column) -> Column:
    """Likelihood always; generation when temperature <= 0, without sampling, for a single sequence."""

    def number(key: str, default: float) -> Column:
        v = F.try_element_at(kwargs, F.lit(key)).try_cast("double")
        return F.coalesce(v, F.lit(default))

    # an unset, empty, zero or false do_sample does not sample
    sample = F.lower(F.coalesce(F.try_element_at(kwargs, F.lit("do_sample")), F.lit("false")))
    sequences = F.greatest(*[number(k, 1.0) for k in ("n", "best_of", "num_return_sequences")])
    quiet = (number("temperature", 0.0) <= 0) & sample.isin("false", "0", "", "null", "0.0", "none") & (sequences <= 1)
    return (request_type == LIKELIHOOD) | quiet


def content_hash(texts: Column) -> Column:
    """16 hex digits over the leading text arguments; '' without any."""
    return F.when(F.size(texts) > 0, F.substring(F.sha2(F.array_join(texts, "\0"), 256), 1, 16)).otherwise("")


def cache_key(
    request_type: Column,
    task: Column,
    doc_id: Column,
    idx: Column,
    gen_kwargs: Column,
    content: Column | None = None,
    task_fingerprint: Column | None = None,
    model_fingerprint: Column | None = None,
    version: Column | None = None,
) -> Column:
    """sha256 over length-prefixed named parts; optional parts count only when set."""

    def part(name: str, c: Column | None) -> Column:
        if c is None:
            return F.lit("")
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s == "", "").otherwise(F.concat(F.lit(f"{name}:"), F.length(s).cast("string"), F.lit(":"), s, F.lit(";")))

    parts = [
        part("v", F.lit(KEY_VERSION)),
        part("rt", request_type),
        part("tn", task),
        part("did", doc_id),
        part("idx", idx),
        part("gk", gen_kwargs),
        part("ch", content),
        part("tf", task_fingerprint),
        part("mfh", model_fingerprint),
        part("ev", version),
    ]
    return F.sha2(F.concat(*parts), 256)


def with_cache_key(requests: DataFrame) -> DataFrame:
    """Adds deterministic and cache_key (null for requests that must not be reused) to REQUEST rows."""
    det = is_deterministic(F.col("request_type"), F.col("gen_kwargs"))
    texts = F.filter(F.array("context", "continuation"), lambda t: t.isNotNull())
    key = cache_key(
        F.col("request_type"),
        F.col("task"),
        F.col("doc_id"),
        F.col("idx"),
        canonical_gen_kwargs(F.col("gen_kwargs")),
        content_hash(texts),
        *[F.col(c) if c in requests.columns else None for c in ("task_fingerprint", "model_fingerprint_hash", "eval_version")],
    )
    return requests.withColumn("deterministic", det).withColumn("cache_key", F.when(F.col("deterministic"), key))


def reuse_responses(requests: DataFrame, local: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """requests plus response and origin (local, shared, miss, skipped).

    Both tables become one lookup, local rows first, so the requests are shuffled once. Non-deterministic requests never
    enter the join: their missing keys would all meet in one partition. A key asked for very often is split by the
    runtime skew join.
    """
    found = local.select("cache_key", F.col("response").alias("_r"), F.lit("local").alias("_o"))
    if shared is not None:
        other = shared.select("cache_key", F.col("response").alias("_r"), F.lit("shared").alias("_o"))
        found = first_by(found.unionByName(other), ["cache_key"], [F.col("_o")])
    hit = requests.where("deterministic").join(found, "cache_key", "left")
    hit = hit.select(*requests.columns, F.col("_r").alias("response"), F.coalesce("_o", F.lit("miss")).alias("origin"))
    rest = requests.where("not deterministic").select(
        "*", F.lit(None).cast("string").alias("response"), F.lit("skipped").alias("origin")
    )
    return hit.unionByName(rest)


def misses(reused: DataFrame) -> DataFrame:
    return reused.where(F.col("origin").isin("miss", "skipped")).drop("response", "origin")


def is_valid_response(response: Column, request_type: Column) -> Column:
    """Non-blank text; for likelihoods a JSON pair."""
    pair = F.size(F.from_json(response, "array<string>")) == 2
    ok = F.when(request_type == LIKELIHOOD, pair).otherwise(F.trim(F.regexp_replace(response, r"(?U)\s", "")) != "")
    return response.isNotNull() & F.coalesce(ok, F.lit(False))


STORED = ["cache_key", "request_type", "task_name", "doc_id", "idx", "gen_kwargs", "response", "created_at"]


def store_responses(table: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of the table: valid deterministic responses added, the newest per key wins."""
    good = new.where("deterministic").where(is_valid_response(F.col("response"), F.col("request_type")))
    return last_by(table.select(*STORED).unionByName(good.select(*STORED)), ["cache_key"], [F.col("created_at"), F.col("response")])


def merge_shards(target: DataFrame, shards: DataFrame, shard: str = "shard") -> DataFrame:
    """Union of shards; rows of the target win, then the lowest shard, then the earliest."""
    mine = target.select(*STORED, F.lit(0).alias("_p"), F.lit(None).cast("bigint").alias("_s"))
    other = shards.select(*STORED, F.lit(1).alias("_p"), F.col(shard).cast("bigint").alias("_s"))
    order = [F.col("_p"), F.col("_s"), F.col("created_at"), F.col("response")]
    return first_by(mine.unionByName(other), ["cache_key"], order).drop("_p", "_s")


def merge_audit(logs: DataFrame, shard: str = "shard", line: str = "created_at") -> DataFrame:
    """Deterministic rows once per key (the first in shard order), all others kept. Unordered; sort by created_at when
    writing. Keyed rows are reduced by an aggregate, so a much repeated key is thinned before the shuffle."""
    keyed = F.coalesce("deterministic", F.lit(True)) & (F.coalesce("cache_key", F.lit("")) != "")
    once = first_by(logs.where(keyed), ["cache_key"], [F.col(shard), F.col(line)])
    return once.unionByName(logs.where(~keyed))


def replay_audit(table: DataFrame, log: DataFrame, line: str = "created_at") -> DataFrame:
    """The table plus deterministic log rows whose key it lacks, the first per key."""
    keyed = F.coalesce("deterministic", F.lit(True)) & (F.coalesce("cache_key", F.lit("")) != "")
    rows = log.where(keyed)
    order = [F.col(line)] if line in STORED else [F.col(line), F.col("created_at")]
    first = first_by(rows.select(*dict.fromkeys(STORED + [line])), ["cache_key"], order)
    return table.select(*STORED).unionByName(first.join(table, "cache_key", "left_anti").select(*STORED))


def reuse_stats(reused: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """hits (shared ones included), shared hits, misses, skipped, rate and the number of stored entries."""
    o = F.col("origin")
    out = reused.agg(
        F.count_if(o.isin("local", "shared")).alias("hits"),
        F.count_if(o == "shared").alias("hits_shared"),
        F.count_if(o == "miss").alias("misses"),
        F.count_if(o == "skipped").alias("skipped_non_deterministic"),
    ).withColumn("hit_rate", F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("misses")))
    if entries is not None:
        out = out.withColumn("total_cached_entries", entries.agg(F.count(F.lit(1))).scalar())
    return out


Responder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def fill_misses(miss: DataFrame, responder: Responder, extra: str = "response string, created_at double") -> DataFrame:
    """Responses for the miss set from a user function over batches: it gets and returns an iterator of pandas frames
    and adds the columns named in extra."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in miss.schema.fields) + ", " + extra
    return miss.mapInPandas(responder, schema)
