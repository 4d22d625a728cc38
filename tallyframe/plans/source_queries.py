"""Queries through files and streams: written from the tables, read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import result_tables as K
from ..operators import validation as B
from ..schemas import CALIBRATION
from ..session import scratch_path
from ..sources import records as A
from ..streaming import live as L
from . import fixtures as V
from .catalog import VIEWS, query, rounded, table


@query(
    "read_questions",
    """ SELECT 'd' || doc_id AS doc_id, 'test' AS split, len(string_split(text, chr(10))) AS steps, lang AS question_class, FALSE AS broken FROM documents
 UNION ALL SELECT NULL, 'test', -1, NULL, TRUE FROM benchmark""",
)
def read_questions(spark, d):
    """Nested records through JSON lines, with unreadable lines among them."""
    path = scratch_path(spark, "questions")
    good = V.question_records(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    bad = table(spark, d, "benchmark").select(F.concat(F.lit('{"doc_id": '), F.regexp_replace("text", r"[\n\r]", " ")).alias("value"))
    good.unionByName(bad).write.text(path)
    out = A.read_questions(spark, path)
    return out.select(
        "doc_id", "split", F.coalesce(F.size("steps"), F.lit(-1)).alias("steps"), "question_class", F.col("_corrupt_record").isNotNull().alias("broken")
    )


VIEWS["sample_lines"] = "SELECT doc_id, n_chars, lang, source FROM documents"


@query(
    "read_baseline_scores",
    """ SELECT CAST(doc_id // 2 AS VARCHAR) AS doc_id, CASE WHEN doc_id % 5 = 0 THEN CAST(n_chars % 2 AS DOUBLE) WHEN doc_id % 5 = 1 THEN CAST(n_chars % 3 = 0 AS DOUBLE) ELSE CAST(lang = 'en' AS DOUBLE) END AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS r FROM sample_lines WHERE doc_id % 11 > 0) WHERE r = 1""",
    ["sample_lines"],
)
def read_baseline_scores(spark, d):
    """Scores as numbers, as prediction/answer pairs and only as target and response; doc ids twice, some missing."""
    path = scratch_path(spark, "samples")
    i, n = F.col("doc_id"), F.col("n_chars")
    pair = F.struct(F.when(n % 3 == 0, " b ").otherwise("c").alias("pred"), F.lit("B").alias("answer"))
    rows = table(spark, d, "documents").select(
        i.alias("line"),
        F.when(i % 11 > 0, F.floor(i / 2)).alias("doc_id"),
        F.when(i % 5 == 0, n % 2).alias("my_Score"),
        F.when(i % 5 == 1, pair).alias("zz_score"),
        F.lit("EN").alias("target"),
        F.array(F.array("lang")).alias("filtered_resps"),
    )
    rows.write.json(path)
    return A.read_baseline_scores(spark, path, order=["line"], score_columns=["my_Score", "zz_score"])


@query(
    "read_response_log",
    " SELECT task_name, count(*) AS n, CAST(sum(created_at) AS BIGINT) AS created, count(*) FILTER (WHERE deterministic) AS deterministic FROM stored GROUP BY task_name",
    ["stored"],
)
def read_response_log(spark, d):
    path = scratch_path(spark, "log")
    V.stored(spark, d).drop("shard", "event_id").write.json(path)
    log = A.read_response_log(spark, path)
    table_path = scratch_path(spark, "log") + ".parquet"
    A.write_response_log(log, table_path)
    back = A.read_response_log(spark, table_path)
    return back.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("created_at").cast("bigint").alias("created"), F.count_if("deterministic").alias("deterministic")
    )


@query(
    "write_samples",
    """ SELECT conv_id AS doc_id, turn, role AS task, 'r1' AS run_id, text AS input, CASE WHEN turn % 3 = 2 THEN lower(role) || '!' END AS resps, CASE WHEN turn % 3 = 1 THEN '["a","b"]' ELSE lower(role) END AS filtered_resps, CAST(turn AS VARCHAR) AS target FROM conversations""",
)
def write_samples(spark, d):
    path = scratch_path(spark, "samples")
    k = F.col("turn") % 3
    low = F.lower("role")
    two = F.array(F.lit("a"), F.lit("b"))
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        "turn",
        F.col("role").alias("task"),
        F.lit("r1").alias("run_id"),
        F.array("text", F.lit("x")).alias("arguments"),
        F.struct("role").alias("doc"),
        F.when(k == 1, two).when(k == 2, F.array(F.concat(low, F.lit("!")))).otherwise(F.array(low)).alias("resps"),
        F.when(k == 1, two).otherwise(F.array(low)).alias("filtered_resps"),
        F.col("turn").alias("target"),
    )
    A.write_samples(rows, path)
    schema = "doc_id bigint, turn bigint, input string, resps string, filtered_resps string, target string, task string, run_id string"
    return spark.read.schema(schema).json(path)


@query(
    "write_results",
    " SELECT task, round(avg(score), 9) AS value, count(*) AS samples, 'm1' AS model, 'h' || task AS task_hash FROM scores GROUP BY task UNION ALL SELECT task, round(avg(baseline), 9), count(*), 'm2', 'h' || task FROM scores GROUP BY task",
    ["scores"],
)
def write_results(spark, d):
    path = scratch_path(spark, "results")
    s = V.scores(spark, d)
    hashes = s.select("task").distinct().withColumn("task_hash", F.concat(F.lit("h"), "task"))
    for model, column in (("m1", "score"), ("m2", "baseline")):
        r = s.groupBy("task").agg(F.avg(column).alias("value"), F.count(F.lit(1)).alias("samples"))
        A.write_results(r, {"model": model}, path, hashes)
    out = spark.read.parquet(path)
    return rounded(out.select("task", "value", "samples", F.col("config")["model"].alias("model"), "task_hash"), 9)


RUNS = """, f AS (SELECT 'm' || o_custkey % 20 AS model, CASE WHEN o_orderkey % 4 = 0 THEN 'results' ELSE 'samples' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'results' ELSE 't_' || o_orderkey % 4 END AS task,
 strftime(o_orderdate, '%Y%m%d_%H%M%S') AS date FROM orders), g AS (SELECT DISTINCT * FROM f),
n AS (SELECT model, task, max(date) AS newest FROM g WHERE kind = 'samples' GROUP BY 1, 2 UNION ALL SELECT model, 'results', max(date) FROM g WHERE kind = 'samples' GROUP BY 1)
SELECT g.model, kind, g.task, date, COALESCE(date = newest, FALSE) AS latest FROM g LEFT JOIN n ON n.model = g.model AND n.task = g.task"""


@query("latest_runs", "WITH " + RUNS[2:])
def latest_runs(spark, d):
    k, date = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyyMMdd_HHmmss")
    model = F.concat(F.lit("out/m"), (F.col("o_custkey") % 20).cast("string"), F.lit("/"))
    name = F.when(k == 0, F.concat(date, F.lit("_results.json"))).otherwise(
        F.concat(date, F.lit("_samples_t-"), k.cast("string"), F.lit(".jsonl"))
    )
    listing = table(spark, d, "orders").select(F.concat(model, name).alias("path")).distinct()
    return K.latest_runs(listing).drop("path")


@query("list_files", "SELECT lang AS task, TRUE AS some FROM documents GROUP BY lang")
def list_files(spark, d):
    path = scratch_path(spark, "tree")
    table(spark, d, "documents").select("doc_id", F.col("lang").alias("task")).write.partitionBy("task").json(path)
    found = A.list_files(spark, path, "*.json")
    return found.groupBy(F.regexp_extract("path", "task=([^/]+)", 1).alias("task")).agg((F.sum("size") > 0).alias("some"))


@query("read_md5_manifest", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS md5, 'a b/' || p_partkey || '.mp4' AS rel_path FROM part")
def read_md5_manifest(spark, d):
    path = scratch_path(spark, "manifest")
    p = F.col("p_partkey").cast("string")
    lines = F.concat(F.md5(p), F.lit("  ./a b/"), p, F.when(F.col("p_partkey") % 9 == 0, ".mp4\n \n").otherwise(".mp4"))
    table(spark, d, "part").select(lines.alias("value")).write.text(path)
    return A.read_md5_manifest(spark, path)


@query("drop_media", "SELECT page_id, url, length(html) AS n FROM pages")
def drop_media(spark, d):
    p = table(spark, d, "pages")
    rows = p.select(
        "page_id",
        "url",
        F.length("html").alias("n"),
        F.encode("html", "UTF-8").alias("raw"),
        F.struct(F.encode("url", "UTF-8").alias("bytes"), F.lit("a").alias("path")).alias("image"),
        F.struct(F.array(F.lit(1.0)).alias("array")).alias("audio"),
    )
    return A.drop_media(rows)


# --- validation ---


STEP_FIELDS = "struct<step:string,question:string,choices:array<string>,correct_idx:int,target_text:string,skipped:boolean>"


def _flawed(spark, d):
    """Records whose flaws follow from the order number."""
    k = F.col("o_orderkey")
    step = lambda name, q, choices, idx, target, skipped=F.lit(False): F.struct(
        name.alias("step"), q.alias("question"), choices.alias("choices"), idx.alias("correct_idx"), target.alias("target_text"), skipped.alias("skipped")
    )
    none = F.lit(None).cast("string")
    ab = F.array(F.lit("a"), F.lit("b"))
    first = step(F.lit("1"), F.when(k % 7 == 1, "  ").otherwise("q"), ab, F.when(k % 11 == 2, 2).otherwise(1), none)
    second = step(F.when(k % 13 == 3, " 1").otherwise("2"), F.lit("q"), F.lit(None).cast("array<string>"), F.lit(None).cast("int"), F.when(k % 17 != 4, "t"))
    third = step(F.lit("1"), F.lit(""), ab, F.lit(9), none, F.lit(True))
    head = F.struct(
        F.when(k % 19 != 5, F.concat(F.lit("r"), k.cast("string"))).alias("doc_id"),
        F.when(k % 23 == 6, -1.0).otherwise(2.5).alias("query_time_sec"),
        F.when(k % 29 != 7, F.concat((k % 50).cast("string"), F.lit(".mp4"))).alias("video_path"),
        F.when(k % 31 != 8, "multi_turn").alias("mode"),
        F.when(k % 37 == 9, F.array().cast(f"array<{STEP_FIELDS}>")).otherwise(F.array(first, second, third)).alias("steps"),
    )
    typed = F.concat(F.lit('{"doc_id":"t'), k.cast("string"), F.lit('","query_time_sec":1,"video_path":"0.mp4","question":"q","choices":[1,2],"correct_idx":1}'))
    text = F.concat(F.lit('{"doc_id":"t'), k.cast("string"), F.lit('","query_time_sec":1,"video_path":"0.mp4","question":"q","choices":["a"],"correct_idx":"0"}'))
    line = F.when(k % 41 == 10, typed).when(k % 43 == 11, text).otherwise(F.to_json(head))
    return table(spark, d, "orders").select(k.alias("record"), line.alias("_raw"))


FLAWS = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 41 = 10 AS typed, o_orderkey % 43 = 11 AND o_orderkey % 41 <> 10 AS txt FROM orders), n AS (SELECT k FROM k WHERE NOT typed AND NOT txt), s AS (SELECT k FROM n WHERE k % 37 <> 9)
SELECT k AS record, 'missing doc_id, trajectory_id, or id' AS error FROM n WHERE k % 19 = 5
UNION ALL SELECT k, 'query_time_sec must be a finite nonnegative number' FROM n WHERE k % 23 = 6
UNION ALL SELECT k, 'video_path must be a nonempty string' FROM n WHERE k % 29 = 7
UNION ALL SELECT k, 'records with steps must set mode=multi_turn' FROM n WHERE k % 31 = 8
UNION ALL SELECT k, 'steps must be a nonempty list when present' FROM n WHERE k % 37 = 9
UNION ALL SELECT k, 'steps[0]: missing question text' FROM s WHERE k % 7 = 1
UNION ALL SELECT k, 'steps[0]: correct_idx must index choices (zero-based)' FROM s WHERE k % 11 = 2
UNION ALL SELECT k, 'steps[1]: missing or duplicate step identifier' FROM s WHERE k % 13 = 3
UNION ALL SELECT k, 'steps[1]: missing target_text or answer' FROM s WHERE k % 17 = 4
UNION ALL SELECT k, 'question: choices must be a list of strings' FROM k WHERE typed
UNION ALL SELECT k, 'question: correct_idx must index choices (zero-based)' FROM k WHERE txt
UNION ALL SELECT k, 'video does not exist: ' || k % 50 || '.mp4' FROM n WHERE k % 29 <> 7 AND k % 50 >= 40"""


@query("validate_questions", FLAWS)
def validate_questions(spark, d):
    path = scratch_path(spark, "records")
    rows = _flawed(spark, d)
    rows.select(F.regexp_replace("_raw", r"^\{", F.concat(F.lit('{"record":'), F.col("record").cast("string"), F.lit(","))).alias("value")).write.text(path)
    df = A.read_questions(spark, path, keep_raw=True).withColumn("record", F.get_json_object("_raw", "$.record").cast("bigint"))
    videos = table(spark, d, "orders").select(F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(".mp4")).alias("path")).distinct()
    # an index written as text does not fit the declared type; that is reported as such
    return B.validate_questions(df.drop("_corrupt_record"), videos)


@query("select_video_ids", "SELECT DISTINCT 'P0' || (doc_id % 9 + 1) || '-20240101-000000' AS video_id FROM documents")
def select_video_ids(spark, d):
    records = V.question_records(spark, d)
    return B.select_video_ids([records, records.select("video_id")])


@query(
    "validate_calibration",
    """SELECT 'P0' || (s_suppkey % 9 + 1) || '-' || s_suppkey AS video_id, CASE WHEN s_suppkey % 5 = 1 THEN 'missing camera calibration' ELSE 'invalid camera-rgb geometry' END AS error FROM supplier WHERE s_suppkey % 5 IN (1, 2, 3)""",
)
def validate_calibration(spark, d):
    root = scratch_path(spark, "calibration")
    k = F.col("s_suppkey")
    p = F.concat(F.lit("P0"), (k % 9 + 1).cast("string"))
    vid = F.concat(p, F.lit("-"), k.cast("string"))
    cam = F.struct(
        F.array(F.lit(1408), F.when(k % 5 == 3, 0).otherwise(1408)).alias("image_size"),
        F.array(F.lit(600.0), F.lit(700.0), F.lit(701.0)).alias("projection_params"),
        F.when(k % 5 != 2, 710.5).alias("valid_radius"),
    )
    makers = table(spark, d, "supplier")
    ids = makers.select(vid.alias("video_id"))
    body = F.to_json(F.struct(F.struct(cam.alias("camera-rgb")).alias("cameras")))
    files = makers.where(k % 5 != 1).select(p.alias("p"), vid.alias("v"), body.alias("value"))
    A.write_file_per_key(files, ["p", "v"], root)
    with A.listed_in_parts(spark):
        cal = spark.read.schema(CALIBRATION).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    cal = cal.withColumn("video_id", F.regexp_extract(F.input_file_name(), r"/v=([^/]+)/", 1))
    return B.calibration_failures(cal, ids)


# --- live results ---

VIEWS["live"] = """
SELECT event_id AS sequence, event_type AS task_name, CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS question_class, CAST(value > 50 AS DOUBLE) AS accuracy, value > 5 AS parsed FROM events"""


def _live_files(spark, d, once_per_question: bool = False):
    """Live result lines; with once_per_question the same question always carries the same content."""
    path = scratch_path(spark, "live")
    key = F.col("user_id") if once_per_question else F.col("event_id")
    acc = (F.col("user_id") % 3 > 0) if once_per_question else (F.col("value") > 50)
    score = F.struct(
        F.when(key % 2 == 0, "even").otherwise("odd").alias("question_class"),
        acc.cast("double").alias("accuracy"),
        (F.lit(True) if once_per_question else F.col("value") > 5).alias("parsed"),
    )
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("sequence"),
        F.col("event_type").alias("task_name"),
        F.col("user_id").cast("string").alias("doc_id"),
        F.lit("p").alias("prediction"),
        F.struct(score.alias("oos_score")).alias("metrics"),
    )
    rows.repartition(4).write.json(path)
    return path


def _newest(spark, out):
    """The newest batch of a complete-mode output."""
    df = spark.read.parquet(out)
    return df.where(F.col("batch") == df.agg(F.max("batch")).scalar()).drop("batch")


@query(
    "live_accuracy",
    " SELECT task_name, question_class, count(*) AS n, count(*) FILTER (WHERE parsed) AS parsed, round(avg(accuracy), 9) AS accuracy FROM live GROUP BY 1, 2",
    ["live"],
)
def live_accuracy(spark, d):
    out, state = scratch_path(spark, "accuracy"), scratch_path(spark, "state")
    stream = A.stream_live_results(spark, _live_files(spark, d), files_per_trigger=2)
    L.write_versions(L.live_accuracy(stream), out, state, once=True).awaitTermination()
    return rounded(_newest(spark, out), 9)


@query("dedupe_live", "SELECT DISTINCT event_type AS task_name, CAST(user_id AS VARCHAR) AS doc_id, CAST(user_id % 3 > 0 AS DOUBLE) AS accuracy FROM events")
def dedupe_live(spark, d):
    out, state = scratch_path(spark, "deduped"), scratch_path(spark, "state")
    stream = A.stream_live_results(spark, _live_files(spark, d, True), files_per_trigger=2)
    L.write_versions(L.dedupe_live(stream), out, state, mode="append", once=True).awaitTermination()
    return spark.read.parquet(out).select("task_name", "doc_id", F.col("metrics.oos_score.accuracy").alias("accuracy"))


@query(
    "live_accuracy_once",
    "WITH u AS (SELECT DISTINCT event_type AS task_name, user_id FROM events) SELECT task_name, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS question_class, count(*) AS n, count(*) AS parsed, round(avg(CAST(user_id % 3 > 0 AS DOUBLE)), 9) AS accuracy FROM u GROUP BY 1, 2",
)
def live_accuracy_once(spark, d):
    """Retries and padding copies count once: deduplicated, then counted, in one stream each."""
    kept = scratch_path(spark, "deduped")
    stream = A.stream_live_results(spark, _live_files(spark, d, True))
    L.write_versions(L.dedupe_live(stream), kept, scratch_path(spark, "state"), mode="append", once=True).awaitTermination()
    return rounded(L.live_accuracy(spark.read.parquet(kept)), 9)


@query("stream_live_results", " SELECT task_name, count(*) AS n, CAST(sum(sequence) AS BIGINT) AS total FROM live GROUP BY 1", ["live"])
def stream_live_results(spark, d):
    out, state = scratch_path(spark, "lines"), scratch_path(spark, "state")
    stream = A.stream_live_results(spark, _live_files(spark, d), files_per_trigger=3)
    L.write_versions(stream, out, state, mode="append", once=True).awaitTermination()
    return spark.read.parquet(out).groupBy("task_name").agg(F.count(F.lit(1)).alias("n"), F.sum("sequence").alias("total"))


def _write_growing(spark, d, folder: str, share: float) -> None:
    """Live result lines in files by sequence; with a share below 1 each file ends in the middle of a line.

    A file with a larger share begins with the bytes of one with a smaller share, as if the rest had been appended.
    """
    import json

    import pyarrow as pa

    from ..sources.growing import _store

    cols = ["event_id", "event_type", "user_id", "value"]
    rows = table(spark, d, "events").select((F.col("event_id") % 8).alias("file"), *cols)
    cut = rows.agg((F.max("event_id") * share).cast("long").alias("m")).first()["m"] if share < 1 else None

    def write(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, out = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != name:
                    if out:
                        out.close()
                    name, out, open_ = r["file"], store.open_output_stream(f"{path}/rank{r['file']}.jsonl"), True
                if not open_:
                    continue
                score = {"question_class": "even" if r["event_id"] % 2 == 0 else "odd", "accuracy": float(r["value"] > 50), "parsed": r["value"] > 5}
                line = json.dumps({"sequence": r["event_id"], "task_name": r["event_type"], "doc_id": str(r["user_id"]), "prediction": "p", "metrics": {"oos_score": score}}).encode() + b"\n"
                open_ = cut is None or r["event_id"] <= cut
                out.write(line if open_ else line[: len(line) // 2])
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    rows.repartition("file").sortWithinPartitions("file", "event_id").mapInArrow(write, "n bigint").count()


@query("append_live_results", VIEWS["live"])
def append_live_results(spark, d):
    """Files grow between two triggers, from the middle of a line on; the second one goes on from the checkpoint."""
    folder, out, state = (scratch_path(spark, x) for x in ("growing", "lines", "state"))
    for share in (0.6, 1.0):
        _write_growing(spark, d, folder, share)
        L.write_versions(A.stream_live_results(spark, folder), out, state, mode="append", once=True).awaitTermination()
    s = F.col("metrics.oos_score")
    return spark.read.parquet(out).select("sequence", "task_name", "doc_id", s["question_class"].alias("question_class"), s["accuracy"].alias("accuracy"), s["parsed"].alias("parsed"))


@query("dedupe_live_ttl", "SELECT DISTINCT event_type AS task_name, CAST(user_id AS VARCHAR) AS doc_id, CAST(user_id % 3 > 0 AS DOUBLE) AS accuracy FROM events")
def dedupe_live_ttl(spark, d):
    """Keys are forgotten an hour after they came, so the state stays bounded without a time column."""
    out, key = scratch_path(spark, "deduped"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    try:
        stream = A.stream_live_results(spark, _live_files(spark, d, True))
        L.write_versions(L.dedupe_live(stream, ttl_seconds=3600), out, scratch_path(spark, "state"), mode="append", once=True).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out).select("task_name", "doc_id", F.col("metrics.oos_score.accuracy").alias("accuracy"))
