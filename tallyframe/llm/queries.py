"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, knn_join, lm, mixing, mpeg, ngram_join, packing, pages, periodic, pii, quality, records, trie
from .common import id_remainder, small_batches, table, words_in

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Machine:
    """The model of the documents' labels, without the held-out fold."""
    known = docs.select("doc_id", "text").where(id_remainder("doc_id", 3) != 1)
    return quality.train(quality.labelled_sample(known, table(spark, sf_dir, "labels").where(id_remainder("doc_id", 3) != 1)))


@query("op2_quality_machine")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, fitted_quality(spark, docs, sf_dir))
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query(
    "op9_jaccard_partition",
    """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN s u ON u.doc_id = p.a JOIN s v ON v.doc_id = p.b
  WHERE 100 * p.c >= 75 * (len(u.sh) + len(v.sh) - p.c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, (SELECT min(r.c) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op1_disclosure")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return rows.select(
        F.col("_id").alias("doc_id"),
        *counts,
        F.sha2(pii.joined(F.col("spans")), 256).alias("base_sha256"),
        pii.joined(pii.all_spans(F.col("spans"), F.col("term_spans"))).alias("spans"),
    )


@query(
    "op5_weighted_mix",
    """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / greatest(0.05::DOUBLE, coalesce(length(regexp_replace(text, '[!-@\\[-`{-~]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.05::DOUBLE)) AS key
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM s),
r AS (
  SELECT *, source_size * 3 / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
    coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
    coalesce(sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
  FROM w
), c AS (SELECT *, ratio <= (total - 3 * s0)::DOUBLE / (total_w - w0) AS capped FROM r),
l AS (
  SELECT *, total - coalesce(sum(CASE WHEN capped THEN source_size * 3 END) OVER (), 0) AS rest,
    total_w - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS rest_w FROM c
), t AS (SELECT source, source_size, CASE WHEN capped THEN (source_size * 3)::DOUBLE ELSE (rest * w)::DOUBLE / rest_w END AS target FROM l),
k AS (
  SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken FROM k
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_record_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return records.read_records(records.record_files(docs, tokenizer_path("byte_bpe_50k.json"), 2))


@query("op8_reduced_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 0)


@query("op3_mpeg_audio")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.read_back(mpeg.media_of_texts(table(spark, sf_dir, "documents")))


@query("op7_reply_trees")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_trees(chat.linear_messages(rows)))


@query(
    "op4_voronoi_join",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op10_kneser_ney")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(id_remainder("doc_id", 7) != 2), order=3)
    scored = lm.score(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), words_in(F.col("text"))
    start = g % n
    again = periodic.looped(F.col("text"), start, 1 + F.floor((n - start) / (3 + g % 8)), n)
    changed = docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), again).otherwise(F.col("text")))
    found = periodic.collapse_runs(changed, keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", periodic.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op12_prefix_trie",
    """
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS x, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, turn FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, dig, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) - 1 AS pos FROM t
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda a, ch: list_reduce([xor(a, ch), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM n)
), r AS (
  SELECT i.conv_id, 0 AS part, n.pos, n.dig, n.words FROM ids i JOIN n ON n.conv_id = i.base AND n.pos < i.h
  UNION ALL
  SELECT i.conv_id, 1, n.pos, n.dig, n.words FROM ids i JOIN n ON n.conv_id = i.conv_id AND n.pos >= i.h
), p AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(dig, ',') OVER w AS path FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
), m AS (SELECT conv_id, words, depth, path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
v AS (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM m GROUP BY path),
e AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
    SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path
), c AS (SELECT CASE WHEN depth = 1 THEN '' ELSE left(path, length(path) - 33) END AS path, count(*) AS n FROM v WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT v.path, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n_convs - 1) * u.words) AS saved
  FROM v JOIN v u ON starts_with(u.path, v.path) LEFT JOIN c ON c.path = u.path GROUP BY v.path
)
SELECT v.conv_id, v.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN s ON s.path = v.path LEFT JOIN c ON c.path = v.path LEFT JOIN e ON e.path = v.path
  LEFT JOIN v q ON v.depth > 0 AND q.path = CASE WHEN v.depth = 1 THEN '' ELSE left(v.path, length(v.path) - 33) END
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.stored(trie.numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    c = F.col("conv_id")
    rebuilt, ids = trie.with_shared_heads(turns, id_remainder(c, 4), c - c % 20, 3)
    nodes, ends = trie.trie(rebuilt, ids)
    ended = nodes.join(trie.ends_digest(ends), ["h1", "h2"], "left")
    return ended.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


@query("op11_host_paths")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
