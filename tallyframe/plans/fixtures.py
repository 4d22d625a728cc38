"""Evaluation-shaped views over the provided tables, in Spark and (for the checks) as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANSWER_META
from .catalog import VIEWS, table

VIEWS["scored_steps"] = """
SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, CAST(turn AS VARCHAR) AS step, role AS question_class,
  CAST(conv_id % 7 AS VARCHAR) AS source_video_id, 'multi_turn' AS mode,
  CAST(length(text) % 3 <> 0 AS DOUBLE) AS accuracy, length(text) % 2 = 0 AS parsed, TRUE AS scorable,
  conv_id, turn FROM conversations"""


def scored_steps(spark: SparkSession, d: str) -> DataFrame:
    """One scored question per conversation turn."""
    n = F.length("text")
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("trajectory_id"),
        F.col("turn").cast("string").alias("step"),
        F.col("role").alias("question_class"),
        (F.col("conv_id") % 7).cast("string").alias("source_video_id"),
        F.lit("multi_turn").alias("mode"),
        (n % 3 != 0).cast("double").alias("accuracy"),
        (n % 2 == 0).alias("parsed"),
        F.lit(True).alias("scorable"),
        F.concat_ws("-", "conv_id", "turn").alias("id"),
    )


VIEWS["mixed_steps"] = """
SELECT trajectory_id, step || CASE WHEN conv_id % 5 = 0 THEN 'b' WHEN conv_id % 5 = 1 AND turn % 3 = 2 THEN 'x1' ELSE '' END AS step,
  CASE WHEN conv_id % 13 = 4 THEN NULL ELSE question_class END AS question_class,
  CASE WHEN conv_id % 13 = 5 THEN NULL ELSE source_video_id END AS source_video_id,
  CASE WHEN conv_id % 9 = 1 THEN 'single_turn' ELSE mode END AS mode,
  CASE WHEN conv_id % 11 = 3 THEN NULL ELSE accuracy END AS accuracy,
  CASE WHEN conv_id % 4 = 2 THEN NULL ELSE parsed END AS parsed, conv_id % 11 <> 3 AS scorable, conv_id, turn FROM scored_steps"""


def mixed_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same with unscorable rows, missing classes, videos and parse flags, and steps like 3b or 2x1."""
    c, t = F.col("trajectory_id").cast("bigint"), F.col("step").cast("bigint")
    tail = F.when(c % 5 == 0, "b").when((c % 5 == 1) & (t % 3 == 2), "x1").otherwise("")
    df = scored_steps(spark, d)
    return df.select(
        "trajectory_id",
        F.concat("step", tail).alias("step"),
        F.when(c % 13 != 4, F.col("question_class")).alias("question_class"),
        F.when(c % 13 != 5, F.col("source_video_id")).alias("source_video_id"),
        F.when(c % 9 == 1, "single_turn").otherwise(F.col("mode")).alias("mode"),
        F.when(c % 11 != 3, F.col("accuracy")).alias("accuracy"),
        F.when(c % 4 != 2, F.col("parsed")).alias("parsed"),
        (c % 11 != 3).alias("scorable"),
        "id",
    )


VIEWS["line_steps"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS trajectory_id, CAST(l_linenumber AS VARCHAR) AS step, l_returnflag AS question_class,
  CAST(l_suppkey AS VARCHAR) AS source_video_id, CAST(l_discount > 0.05 AS DOUBLE) AS accuracy, l_linenumber AS turn,
  l_partkey AS tie FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def line_steps(spark: SparkSession, d: str) -> DataFrame:
    """Many scores: order lines as steps of an order."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    # orders grow with their lines: as a compressed file they may look small enough for a broadcast, which holds all keys in
    # every task; dealt out, a task holds the keys of its part and sorts nothing
    return li.join(o.hint("shuffle_hash"), "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("trajectory_id"),
        F.col("l_linenumber").cast("string").alias("step"),
        F.col("l_returnflag").alias("question_class"),
        F.col("l_suppkey").cast("string").alias("source_video_id"),
        F.lit("multi_turn").alias("mode"),
        (F.col("l_discount") > 0.05).cast("double").alias("accuracy"),
        F.lit(True).alias("parsed"),
        F.lit(True).alias("scorable"),
        F.col("l_partkey").alias("id"),
    )


VIEWS["scores"] = """
SELECT l.doc_id, lang AS task, source AS cluster, quality AS score, 1 - toxic AS baseline, quality AS gold,
  CAST(n_chars % 4 <> 0 AS INTEGER) AS pred, n_chars, -(n_chars % 97) / 97.0::DOUBLE AS value, 1.0::DOUBLE + n_chars % 13 AS weight
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two runs on labelled documents."""
    n = F.col("n_chars")
    return (
        table(spark, d, "labels")
        .join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        .select(
            "doc_id",
            F.col("lang").alias("task"),
            F.col("source").alias("cluster"),
            F.col("quality").alias("score"),
            (1 - F.col("toxic")).alias("baseline"),
            F.col("quality").alias("gold"),
            (n % 4 != 0).cast("int").alias("pred"),
            "n_chars",
            (-(n % 97) / F.lit(97.0)).alias("value"),
            (F.lit(1.0) + n % 13).alias("weight"),
        )
    )


VIEWS["long_scores"] = """
SELECT task, m.metric, 'none' AS filter, doc_id, CASE WHEN metric = 'acc' THEN CAST(score AS DOUBLE) ELSE value END AS value,
  gold, pred, weight FROM scores, (VALUES ('acc'), ('perplexity'), ('word_perplexity'), ('bits_per_byte'), ('f1')) m(metric)"""


def long_scores(spark: SparkSession, d: str, metrics=("acc", "perplexity", "word_perplexity", "bits_per_byte", "f1")) -> DataFrame:
    """The long score table: one row per document and metric."""
    s = scores(spark, d).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    value = F.when(F.col("metric") == "acc", F.col("score").cast("double")).otherwise(F.col("value"))
    return s.select("task", "metric", F.lit("none").alias("filter"), "doc_id", value.alias("value"), "gold", "pred", "weight", "cluster")


VIEWS["attempts"] = """
SELECT event_id, user_id, event_type, CAST(user_id AS VARCHAR) || event_type AS question, CAST(value > 50 AS DOUBLE) AS score, value FROM events"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """k samples per question."""
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.concat(F.col("user_id").cast("string"), "event_type").alias("question"),
        (F.col("value") > 50).cast("double").alias("score"),
        "value",
    )


VIEWS["usage_log"] = """
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS task_name,
  CASE WHEN user_id % 2 = 0 THEN 'model' ELSE 'judge' END AS source, CAST(floor(value) AS BIGINT) AS input_tokens,
  CAST(floor(value * 2) % 40 AS BIGINT) AS output_tokens, event_id % 3 AS reasoning_tokens, value FROM events"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.lit("m").alias("model_name"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("task_name"),
        F.when(F.col("user_id") % 2 == 0, "model").otherwise("judge").alias("source"),
        F.floor("value").alias("input_tokens"),
        (F.floor(F.col("value") * 2) % 40).alias("output_tokens"),
        (F.col("event_id") % 3).alias("reasoning_tokens"),
        "value",
    )


VIEWS["stored"] = """
SELECT CAST(user_id AS VARCHAR) || event_type AS cache_key, 'generate_until' AS request_type, event_type AS task_name,
  CAST(user_id AS VARCHAR) AS doc_id, 0 AS idx, '{}' AS gen_kwargs, CASE WHEN event_id % 10 = 0 THEN '  ' ELSE 'r' || event_id END AS response,
  CAST(event_id AS DOUBLE) AS created_at, event_id % 5 <> 0 AS deterministic, event_id % 4 AS shard, event_id FROM events"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    """A response log: the same key many times, every tenth response blank, every fifth not deterministic."""
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), "event_type").alias("cache_key"),
        F.lit("generate_until").alias("request_type"),
        F.col("event_type").alias("task_name"),
        F.col("user_id").cast("string").alias("doc_id"),
        F.lit(0).alias("idx"),
        F.lit("{}").alias("gen_kwargs"),
        F.when(e % 10 == 0, "  ").otherwise(F.concat(F.lit("r"), e.cast("string"))).alias("response"),
        e.cast("double").alias("created_at"),
        (e % 5 != 0).alias("deterministic"),
        (e % 4).alias("shard"),
        "event_id",
    )


VIEWS["losses"] = """
SELECT vec_id, (label * 5) % len(embedding) AS gold, embedding AS l, list_reverse(embedding) AS u FROM embeddings"""
CHOICES = ["up", "to the left", "no", "behind it"]


def losses(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice losses: an option for every element of a vector, its text 1 to 7 characters long; the vector
    backwards as the unconditional ones."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id",
        ((F.col("label") * 5) % F.size("embedding")).alias("gold"),
        e.alias("losses"),
        F.reverse(e).alias("unconditional"),
        F.transform("embedding", lambda x, i: F.substring(F.lit("option-"), F.lit(1), 1 + i % 7)).alias("choices"),
    )


VIEWS["turn_pairs"] = """
SELECT a.conv_id, a.turn, a.role AS task, a.text AS prediction, b.text AS reference, c.text AS reference2
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2"""


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prediction and references: each turn against the next one or two, whole texts."""
    t = table(spark, d, "conversations")
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    c = t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("reference2"))
    out = t.join(b, ["conv_id", "turn"]).join(c, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        F.col("role").alias("task"),
        F.col("text").alias("prediction"),
        "reference",
        "reference2",
        F.array_compact(F.array("reference", "reference2")).alias("references"),
    )


VIEWS["doc_lines"] = """
SELECT doc_id, lang, source, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"""


def question_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested records: one per document, a step per text line; every seventh step is skipped, every fifth has options."""
    none = F.lit(None).cast("string")

    def step(line: Column, i: Column) -> Column:
        many = i % 5 == 4
        return F.struct(
            (i + 1).cast("string").alias("step"),
            F.when(i % 2 == 0, "main").otherwise("branch").alias("branch_group"),
            F.when(many, "oos_step4_fixture").when(i % 3 == 0, none).otherwise("lines").alias("step_question_class"),
            line.alias("question"),
            F.when(many, F.array(*[F.lit(c) for c in CHOICES])).alias("choices"),
            F.when(many, (F.length(line) % 4).cast("int")).alias("correct_idx"),
            F.when(~many & (i % 2 == 0), F.upper(line)).alias("target_text"),
            F.lower(line).alias("answer"),
            F.lit(None).cast("array<string>").alias("acceptable_answers"),
            F.when(i % 10 == 9, F.array(F.lit(0), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("acceptable_idxs"),
            F.when(many, F.array(F.lit(1))).alias("acceptable_answer_idxs"),
            (i % 7 == 6).alias("skipped"),
            F.lit(None).cast(ANSWER_META).alias("answer_metadata"),
        )

    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.col("source").alias("trajectory_id"),
        F.lit("multi_turn").alias("mode"),
        F.concat(F.lit("P0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-20240101-000000")).alias("video_id"),
        F.concat(F.lit("P0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-20240101-000000.mp4")).alias("video_path"),
        (F.col("n_chars") / 10).alias("query_time_sec"),
        F.col("lang").alias("question_class"),
        F.transform(F.split("text", "\n"), step).alias("steps"),
    )


VIEWS["singles"] = """
SELECT conv_id, turn, conv_id || '-' || turn AS doc_id, role, text, CASE WHEN turn % 3 = 0 THEN length(text) % 4 END AS correct_idx FROM conversations"""


def single_records(spark: SparkSession, d: str) -> DataFrame:
    """Single-question records: one per conversation turn; every third with options."""
    n, t = F.length("text"), F.col("turn")
    many = t % 3 == 0
    return table(spark, d, "conversations").select(
        F.when(t % 2 == 0, F.concat_ws("-", "conv_id", "turn")).alias("doc_id"),
        F.when(t % 2 == 1, F.concat_ws("-", "conv_id", "turn")).alias("id"),
        F.col("conv_id").cast("string").alias("trajectory_id"),
        F.concat(F.lit("v"), (F.col("conv_id") % 7).cast("string")).alias("video_id"),
        F.concat(F.lit("v"), (F.col("conv_id") % 7).cast("string"), F.lit(".mp4")).alias("video_path"),
        (t * 7.5).alias("query_time_sec"),
        F.col("text").alias("question"),
        F.col("role").alias("question_class"),
        F.when(many, F.array(*[F.lit(c) for c in CHOICES])).alias("choices"),
        F.when(many, (n % 4).cast("int")).alias("correct_idx"),
        F.when(~many & (t % 3 == 1), F.lower("text")).alias("answer"),
    )


VIEWS["visual_rows"] = """
SELECT conv_id, turn, conv_id || '-' || turn AS id, CAST(turn AS VARCHAR) AS step,
  CASE WHEN conv_id % 10 = 9 THEN '' ELSE 'P0' || (conv_id % 7 + 1) || '-20240101-00000' || (conv_id % 3) || '.mp4' END AS video_path,
  CASE WHEN conv_id % 10 = 8 THEN NULL ELSE turn * 7.5::DOUBLE END AS query_time_sec,
  CASE turn % 4 WHEN 0 THEN 'oos_branch_object_object_relation' WHEN 1 THEN 'oos_branch_object_object_distance' WHEN 2 THEN 'oos_step4_fixture' ELSE 'other' END AS cls,
  (length(text) % 130) / 100.0::DOUBLE AS x, (length(text) % 89) / 100.0::DOUBLE AS y FROM conversations"""


def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flat questions with video, time, class and marker coordinates (some outside the image)."""
    n, c, t = F.length("text"), F.col("conv_id"), F.col("turn")
    vid = F.concat(F.lit("P0"), (c % 7 + 1).cast("string"), F.lit("-20240101-00000"), (c % 3).cast("string"))
    cls = F.array(*[F.lit(x) for x in ("oos_branch_object_object_relation", "oos_branch_object_object_distance", "oos_step4_fixture", "other")])
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        t.cast("string").alias("step"),
        vid.alias("video_id"),
        vid.alias("source_video_id"),
        F.when(c % 10 == 9, "").otherwise(F.concat(vid, F.lit(".mp4"))).alias("video_path"),
        F.when(c % 10 != 8, t * 7.5).alias("query_time_sec"),
        F.get(cls, (t % 4).cast("int")).alias("step_question_class"),
        F.struct(
            F.array((n % 130) / F.lit(100.0), (n % 89) / F.lit(100.0)).alias("object_y_normalized_projected_pixel")
        ).alias("answer_metadata"),
        F.when(c % 2 == 0, F.concat(F.lit("ref/"), c.cast("string"), F.lit(".png"))).alias("target_reference_image_path"),
        F.array(F.lit("1"), F.lit(" 2 ")).alias("target_reference_steps"),
        F.create_map(F.lit("video_id"), vid).alias("generation_info"),
        F.lit(None).cast("string").alias("kitchen_bev_image_path"),
        F.when(c % 6 == 0, F.concat(F.lit("plan/"), (c % 12).cast("string"), F.lit(".png"))).alias("bev_image_path"),
        "conv_id",
        "turn",
    )


VIEWS["listing"] = """
SELECT DISTINCT 'kit/P0' || (p_partkey % 7 + 1) || '.' || CASE p_partkey % 7 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' ELSE 'jpg' END AS path FROM part
UNION SELECT DISTINCT 'plan/' || (p_partkey % 12) || '.png' FROM part WHERE p_partkey % 12 IN (0, 1, 2, 3)
UNION SELECT DISTINCT 'vids/P0' || (p_partkey % 7 + 1) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_raw' ELSE 'selected' END || '/P0' || (p_partkey % 7 + 1) || '-20240101-00000' || (p_partkey % 3) || '.mp4' FROM part WHERE p_partkey % 21 < 15"""


def listing(spark: SparkSession, d: str) -> DataFrame:
    """A file listing with layout images and source videos."""
    p = F.col("p_partkey")
    seven = (p % 7 + 1).cast("string")
    ending = F.when(p % 7 == 0, "jpeg").when(p % 7 == 2, "png").when(p % 7 == 3, "gif").otherwise("jpg")
    folder = F.when(p % 3 == 0, "").when(p % 3 == 1, "_raw").otherwise("selected")
    part = table(spark, d, "part").select("p_partkey")
    kit = part.select(F.concat(F.lit("kit/P0"), seven, F.lit("."), ending).alias("path"))
    plan = part.where(p % 12 < 4).select(F.concat(F.lit("plan/"), (p % 12).cast("string"), F.lit(".png")).alias("path"))
    vids = part.where(p % 21 < 15).select(
        F.concat(F.lit("vids/P0"), seven, folder, F.lit("/P0"), seven, F.lit("-20240101-00000"), (p % 3).cast("string"), F.lit(".mp4")).alias("path")
    )
    return kit.unionByName(plan).unionByName(vids).distinct()


VIEWS["replies"] = """
SELECT conv_id, turn, conv_id || '-' || turn AS doc_id, role AS task, text, (conv_id + turn) % 8 AS kind,
  chr(CAST(65 + (conv_id * 3 + turn) % 4 AS INTEGER)) AS letter, (conv_id * 3 + turn) % 4 AS pick FROM conversations"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies in eight styles around a letter or an option text, with the turn's text as filling."""
    c, t = F.col("conv_id"), F.col("turn")
    pick = ((c * 3 + t) % 4).cast("int")
    letter = F.char(F.lit(65) + pick)
    kind = (c + t) % 8
    option = F.get(F.array(*[F.lit(x) for x in CHOICES]), pick)
    reply = (
        F.when(kind == 0, F.concat(F.lit("The answer is ("), letter, F.lit(").\n"), "text"))
        .when(kind == 1, F.concat(F.lit("("), letter, F.lit(") 2022\n"), "text"))
        .when(kind == 2, F.concat(F.lit("\n- "), letter, F.lit(".\n\nQuestion: "), "text"))
        .when(kind == 3, F.concat(letter, F.lit("</think>"), "text"))
        .when(kind == 4, F.concat(option, F.lit("\n [step] "), "text"))
        .when(kind == 5, F.concat(F.lit("\x1b[31mFinal answer: "), option, F.lit("!\x1b[0m\n"), "text"))
        .when(kind == 6, F.lit(""))
        .otherwise(F.concat(F.lit("It would be 12345 "), option))
    )
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        F.col("role").alias("task"),
        "text",
        kind.cast("int").alias("kind"),
        letter.alias("letter"),
        pick.alias("pick"),
        reply.alias("prediction"),
        F.array(*[F.lit(x) for x in CHOICES]).alias("choices"),
    )
