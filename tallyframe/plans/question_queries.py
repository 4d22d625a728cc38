"""Queries over question records: expansion, prompts, messages, requests, windows, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as Q
from ..operators import result_tables as K
from ..operators import scoring as S
from . import fixtures as V
from .catalog import query, table

FLAT = """SELECT 'd' || doc_id || '__step_' || pos AS id, CASE WHEN pos % 2 = 1 THEN 'main' ELSE 'branch' END AS branch_group, CAST(pos AS VARCHAR) AS step,
 CASE WHEN pos % 5 = 0 THEN 'oos_step4_fixture' WHEN (pos - 1) % 3 = 0 THEN lang ELSE 'lines' END AS question_class, line AS question, CASE WHEN pos % 5 = 0 THEN 4 ELSE 0 END AS n_choices,
 CASE WHEN pos % 5 = 0 THEN length(line) % 4 END AS answer_idx, CASE WHEN pos % 5 <> 0 AND pos % 2 = 1 THEN upper(replace(line, 'ß', 'SS')) ELSE lower(line) END AS answer,
 CASE WHEN pos % 10 = 0 THEN '0,2' WHEN pos % 5 = 0 THEN '1' ELSE '' END AS ok, source AS trajectory_id FROM doc_lines WHERE pos % 7 <> 0"""


def _flat(df):
    return df.select(
        "id",
        "branch_group",
        "step",
        "question_class",
        "question",
        F.size("choices").alias("n_choices"),
        "answer_idx",
        "answer",
        F.array_join(F.transform("acceptable_answer_idxs", lambda x: x.cast("string")), ",").alias("ok"),
        "trajectory_id",
    )


@query("expand_steps", FLAT, ["doc_lines"])
def expand_steps(spark, d):
    return _flat(Q.expand_steps(V.question_records(spark, d)))


@query(
    "normalize_single",
    """ SELECT doc_id AS id, role AS question_class, text AS question, CASE WHEN turn % 3 = 0 THEN 4 ELSE 0 END AS n_choices, correct_idx AS answer_idx,
 CASE WHEN turn % 3 = 1 THEN lower(text) END AS answer, 'v' || conv_id % 7 AS source_video_id, 'single_turn' AS mode FROM singles""",
    ["singles"],
)
def normalize_single(spark, d):
    out = Q.normalize_single(V.single_records(spark, d))
    return out.select("id", "question_class", "question", F.size("choices").alias("n_choices"), "answer_idx", "answer", "source_video_id", "mode")


@query(
    "prepare_questions",
    """ SELECT 'd' || doc_id || '__step_' || pos AS id, 'multi_turn' AS mode, CAST(pos AS VARCHAR) AS step, length(line) AS n FROM doc_lines WHERE pos % 7 <> 0
 UNION ALL SELECT doc_id, 'single_turn', NULL, length(text) FROM singles""",
    ["doc_lines", "singles"],
)
def prepare_questions(spark, d):
    multi = Q.with_schema(V.question_records(spark, d))
    single = Q.with_schema(V.single_records(spark, d))
    step_type = "array<" + multi.schema["steps"].dataType.elementType.simpleString() + ">"
    both = multi.unionByName(single.withColumn("steps", F.lit(None).cast(step_type)))
    return Q.prepare_questions(both).select("id", "mode", "step", F.length("question").alias("n"))


@query("prepare_steps", "SELECT 'd' || doc_id || '__step_' || pos AS id, CAST(pos AS VARCHAR) AS step FROM doc_lines WHERE pos IN (2, 5)", ["doc_lines"])
def prepare_steps(spark, d):
    return Q.prepare_questions(V.question_records(spark, d), ["2", " 5 "], shuffle_seed=42).select("id", "step")


@query(
    "raw_fixture_options",
    """ SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'a|b' WHEN p_size % 3 = 0 THEN p_brand || '|x|' || p_type WHEN p_size % 3 = 1 THEN p_type || '|y' ELSE p_type END AS options,
 CASE WHEN p_size % 5 = 4 THEN 9 WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS gold FROM part""",
)
def raw_fixture_options(spark, d):
    s = F.col("p_size")
    empty = F.array().cast("array<string>")
    meta = F.struct(
        F.when(s % 5 != 4, F.when(s % 2 == 0, F.concat(F.lit(" "), "p_type"))).alias("raw_correct_fixture"),
        F.when(s % 5 != 4, F.col("p_type")).alias("correct_fixture"),
        empty.alias("raw_choice_pool"),
        F.when(s % 3 == 0, F.array(F.col("p_brand"), F.lit(" "), F.lit("x"))).alias("raw_expanded_choice_pool"),
        F.when(s % 3 == 1, F.array(F.col("p_type"), F.lit("y"))).otherwise(empty).alias("fixture_choice_pool"),
        empty.alias("expanded_choice_pool"),
    )
    rows = table(spark, d, "part").select("p_partkey", meta.alias("m"))
    options, gold, _ = Q.raw_fixture_options(F.col("m"), F.array(F.lit("a"), F.lit("b")), F.lit(9))
    return rows.select("p_partkey", F.array_join(options, "|").alias("options"), gold.alias("gold"))


@query(
    "slice_docs",
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id FROM r WHERE i >= 3 AND (i - 3) % 2 = 0 AND i < 2 + ceil(n * 0.3)""",
)
def slice_docs(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return Q.slice_docs(docs, "doc_id", ["lang"], limit=0.3, offset=2, shard=1, n_shards=2)


@query("slice_rows", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id FROM r WHERE i >= 10 AND i < 510 AND (i - 10) % 3 = 0")
def slice_rows(spark, d):
    return Q.slice_docs(table(spark, d, "events").select("event_id"), "event_id", limit=500, offset=10, n_shards=3)


OPTIONS = "'Options:' || chr(10) || 'A. up' || chr(10) || 'B. to the left' || chr(10) || 'C. no' || chr(10) || 'D. behind it' || chr(10) || 'Select the best option and output only its letter.'"
BLOCK = f"'Question: ' || text || chr(10) || CASE WHEN turn % 3 = 0 THEN {OPTIONS} ELSE 'Answer briefly and directly.' END"


@query("render_prompt", f"SELECT doc_id AS id, 'Be brief.' || chr(10) || chr(10) || {BLOCK} AS prompt FROM singles", ["singles"])
def render_prompt(spark, d):
    return Q.render_prompt(Q.normalize_single(V.single_records(spark, d)), "Be brief.").select("id", "prompt")


def _messages(spark, d):
    flat = Q.normalize_single(V.single_records(spark, d)).withColumn("visuals", F.array("video_path", F.lit("a/b.PNG")))
    return Q.build_messages(flat, "Be brief.", "visuals")


@query(
    "build_messages",
    f"""SELECT doc_id AS id, 'system' AS role, 0 AS pos, 'text' AS type, 'Be brief.' AS text, CAST(NULL AS VARCHAR) AS url FROM singles
 UNION ALL SELECT doc_id, 'user', 0, 'video', NULL, 'v' || conv_id % 7 || '.mp4' FROM singles UNION ALL SELECT doc_id, 'user', 1, 'image', NULL, 'a/b.PNG' FROM singles
 UNION ALL SELECT doc_id, 'user', 2, 'text', {BLOCK}, NULL FROM singles""",
    ["singles"],
)
def build_messages(spark, d):
    m = _messages(spark, d).select("id", F.explode("messages").alias("m"))
    return m.select("id", "m.role", F.posexplode("m.content").alias("pos", "c")).select("id", "role", "pos", "c.*")


@query("extract_media", "SELECT doc_id AS id, 'a/b.PNG' AS images, 'v' || conv_id % 7 || '.mp4' AS videos, 0 AS audios FROM singles", ["singles"])
def extract_media(spark, d):
    m = _messages(spark, d).select("id", Q.extract_media(F.col("messages")).alias("x"))
    return m.select("id", F.array_join("x.images", ",").alias("images"), F.array_join("x.videos", ",").alias("videos"), F.size("x.audios").alias("audios"))


@query(
    "input_media",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a.jpg|data:image/png;base64,xx|' || 'https://x/' || page_id || '.png?w=1' ELSE 'a.jpg' END AS media FROM pages""",
)
def input_media(spark, d):
    p = table(spark, d, "pages")
    third = F.col("page_id") % 3 == 0
    link = F.concat(F.lit("https://x/"), F.col("page_id").cast("string"), F.lit(".png?w=1"))
    doc = F.struct(F.lit("a.jpg").alias("path"), F.lit("no image").alias("note"), F.when(third, F.array(F.lit("data:image/png;base64,xx"), link)).alias("more"))
    args = F.array(F.lit("A.JPG.txt"), F.lit("a.jpg"), F.when(third, link).otherwise("file.gifx"))
    rows = p.select("page_id", doc.alias("doc"), args.alias("args"))
    return Q.input_media(rows, ["doc", "args"]).select("page_id", F.array_join("input_media", "|").alias("media"))


@query(
    "derive_fields",
    """SELECT conv_id, turn, role || '?' AS text, CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) WHEN turn % 3 = 1 THEN '["a", "b"]' ELSE role END AS target, CASE WHEN turn % 3 = 0 THEN turn END AS target_idx,
 CASE WHEN turn % 3 = 1 THEN 'a,b' END AS target_list, 'x,y' AS choice_list FROM conversations""",
)
def derive_fields(spark, d):
    spec = "CASE turn % 3 WHEN 0 THEN CAST(turn AS STRING) WHEN 1 THEN '[\"a\", \"b\"]' ELSE role END"
    out = Q.derive_fields(table(spark, d, "conversations").drop("text"), "concat(role, '?')", spec, {"1": "x", "2": "y"})
    return out.select("conv_id", "turn", "text", "target", "target_idx", F.array_join("target_list", ",").alias("target_list"), F.array_join("choice_list", ",").alias("choice_list"))


def _pool(spark, d):
    return table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("order"), F.concat(F.lit("Q "), F.length("text").cast("string"), F.lit(" A")).alias("shot")
    )


@query(
    "fewshot_first",
    """WITH s AS (SELECT item_id, 'Q ' || length(text) || ' A' AS shot FROM benchmark ORDER BY item_id LIMIT 4)
SELECT b.item_id AS id, 'Read.' || string_agg(shot, ';' ORDER BY s.item_id) || ';' AS context FROM benchmark b JOIN s ON s.item_id <> b.item_id AND (b.item_id <= 3 OR s.item_id <= 2) GROUP BY b.item_id""",
)
def fewshot_first(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    out = Q.fewshot_context(rows, _pool(spark, d), 3, "first", prefix="Read.", delimiter=";", same_split=True)
    return out.select(F.col("id").cast("bigint").alias("id"), "context")


@query("fewshot_random")
def fewshot_random(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    pool = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("order"), F.concat("text", F.lit(" => "), "lang").alias("shot")
    )
    rows = docs.select(F.col("doc_id").cast("string").alias("id"))
    out = Q.fewshot_context(rows, pool, 3, seed=7, same_split=True, delimiter="\n\n")
    return out.select("id", F.sha2("context", 256).alias("context_hash"), F.length("context").alias("n"))


@query("fewshot_random_rules", "SELECT doc_id, 3 AS shots, 3 AS different, FALSE AS own, FALSE AS unknown FROM documents")
def fewshot_random_rules(spark, d):
    """What holds for every draw: k examples, all different, never the row itself, all from the pool."""
    docs = table(spark, d, "documents").select("doc_id")
    pool = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("order"), F.concat(F.lit("#"), "doc_id").alias("shot"))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"))
    out = Q.fewshot_context(rows, pool, 3, seed=7, same_split=True, delimiter=";")
    shots = F.filter(F.split("context", ";"), lambda x: x != "")
    last = pool.agg(F.max("order")).scalar()
    rows = out.select("id", shots.alias("s"), last.alias("last"))
    number = lambda x: F.substring(x, 2, 20).cast("bigint")
    return rows.select(
        F.col("id").cast("bigint").alias("doc_id"),
        F.size("s").alias("shots"),
        F.size(F.array_distinct("s")).alias("different"),
        F.array_contains("s", F.concat(F.lit("#"), "id")).alias("own"),
        F.exists("s", lambda x: (number(x) < 0) | (number(x) > F.col("last"))).alias("unknown"),
    )


@query(
    "build_requests",
    """, i AS (SELECT vec_id, unnest(range(0, len(l))) AS idx FROM losses), r AS (SELECT vec_id, idx, substring('option-', 1, 1 + idx % 7) AS c FROM i)
SELECT vec_id AS doc_id, idx, x.rep AS repeat, 'loglikelihood' AS request_type, 'ctx ' || vec_id AS context, ' ' || c AS continuation FROM r, (VALUES (0), (1)) x(rep)
UNION ALL SELECT vec_id, idx, x.rep, 'loglikelihood', '', c FROM r, (VALUES (0), (1)) x(rep)""",
    ["losses"],
)
def build_requests(spark, d):
    rows = V.losses(spark, d).select(F.col("vec_id").alias("doc_id"), "choices", F.concat(F.lit("ctx "), F.col("vec_id").cast("string")).alias("prompt"))
    out = Q.build_requests(rows, "multiple_choice", repeats=2, mutual_information=True)
    return out.select("doc_id", "idx", "repeat", "request_type", "context", "continuation")


@query(
    "requests_with_contexts",
    """, i AS (SELECT vec_id, gold, unnest(range(0, len(l))) AS idx FROM losses)
SELECT vec_id AS doc_id, idx, 'loglikelihood' AS request_type, substring('option-', 1, 1 + idx % 7) AS context, ' t' || gold AS continuation FROM i
UNION ALL SELECT vec_id, idx, 'loglikelihood', '', substring('option-', 1, 1 + idx % 7) FROM i""",
    ["losses"],
)
def requests_with_contexts(spark, d):
    """The choices are contexts, the target is the continuation of all of them."""
    rows = V.losses(spark, d).select(F.col("vec_id").alias("doc_id"), "choices", F.concat(F.lit("t"), F.col("gold").cast("string")).alias("target"))
    out = Q.build_requests(rows, "multiple_choice", mutual_information=True, several_contexts=True)
    return out.select("doc_id", "idx", "request_type", "context", "continuation")


CONTEXT_SCORES = """, x AS (SELECT vec_id, gold, l, [CAST(l[i] AS DOUBLE) / (1 + (i - 1) % 7) for i in range(1, len(l) + 1)] AS per FROM losses),
 p AS (SELECT vec_id, {gold} AS gold, list_position(l, list_min(l)) - 1 AS pred, list_position(per, list_min(per)) - 1 AS pn, l FROM x)
 SELECT vec_id AS doc_id, pred, CAST(pred = gold AS DOUBLE) AS acc, CAST(pn = gold AS DOUBLE) AS acc_norm, COALESCE(CAST(l[CAST(gold + 1 AS INTEGER)] > 0 AS INTEGER), 0) AS exact_match FROM p"""


def _scored_contexts(spark, d, gold, several):
    rows = V.losses(spark, d).select(F.col("vec_id").alias("doc_id"), "losses", "choices", gold.alias("gold"), F.lit("the target").alias("target"), F.lit("ctx").alias("prompt"))
    requests = Q.build_requests(rows, "multiple_choice", several_contexts=several)
    said = rows.select("doc_id", F.posexplode("losses").alias("idx", "ll")).withColumn("is_greedy", F.col("ll") > 0)
    out = S.score_choice_requests(requests, said, rows.select("doc_id", "gold"), ["doc_id"], several_contexts=several)
    return out.select("doc_id", "pred", "acc", "acc_norm", "exact_match")


@query("score_contexts", CONTEXT_SCORES.format(gold="gold"), ["losses"])
def score_contexts(spark, d):
    return _scored_contexts(spark, d, F.col("gold"), True)


@query("score_choice_texts", CONTEXT_SCORES.format(gold="CASE WHEN vec_id % 10 = 0 THEN -100 ELSE gold % 7 END"), ["losses"])
def score_choice_texts(spark, d):
    """Golds given as texts: the first choice with the text counts, and a text that is no choice is wrong."""
    text = F.when(F.col("vec_id") % 10 == 0, "none").otherwise(F.get("choices", F.col("gold")))
    return _scored_contexts(spark, d, text, False)


@query("build_generation_requests", "SELECT doc_id, 0 AS idx, 0 AS repeat, 'generate_until' AS request_type, text AS context, '0' AS temperature FROM documents")
def build_generation_requests(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = Q.build_requests(rows, "generate_until", gen_kwargs={"temperature": "0"})
    return out.select("doc_id", "idx", "repeat", "request_type", "context", F.col("gen_kwargs")["temperature"].alias("temperature"))


@query(
    "rolling_windows",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), n AS (SELECT doc_id, t, len(t) AS n, unnest(range(0, CAST(greatest(ceil((len(t) - 64) / 49.0), 0) AS BIGINT) + 1)) AS i FROM w),
e AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE 64 + (i - 1) * 49 END AS a, least(n, 64 + i * 49) AS b FROM n)
SELECT doc_id, i AS "window", sha256(array_to_string(list_slice(t, a + 1, b), ' ')) AS target_hash, b - a AS n_target, CASE WHEN i = 0 THEN b ELSE b - 1 - greatest(b - 65, 0) END AS n_input,
 CASE WHEN i = 0 THEN '<s>' ELSE t[greatest(b - 65, 0) + 1] END AS first_input FROM e""",
)
def rolling_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("t"))
    out = Q.rolling_windows(rows, "t", 64, 16, "<s>")
    return out.select(
        "doc_id",
        "window",
        F.sha2(F.array_join("target", " "), 256).alias("target_hash"),
        F.size("target").alias("n_target"),
        F.size("input").alias("n_input"),
        F.get("input", F.lit(0)).alias("first_input"),
    )


@query(
    "disjoint_windows",
    """WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), e AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(ceil((n - 64) / 49.0), 0) AS BIGINT) + 1)) AS i FROM w)
SELECT doc_id, i AS "window", CASE WHEN i = 0 THEN 1 ELSE 64 - (least(n, 64 + i * 49) - 64 - (i - 1) * 49 - 1) END AS n_input FROM e""",
)
def disjoint_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("t"))
    return Q.rolling_windows(rows, "t", 64, 16, "<s>", disjoint=True).select("doc_id", "window", F.size("input").alias("n_input"))


@query("unwrap_output", "SELECT event_id, event_type AS text, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens, event_type AS plain FROM events")
def unwrap_output(spark, d):
    counts = F.struct(F.floor("value").cast("int").alias("input_tokens"), F.lit(3).alias("output_tokens"))
    e = table(spark, d, "events").withColumn("output", F.struct(F.col("event_type").alias("text"), counts.alias("token_counts")))
    a = Q.unwrap_output(e).select("event_id", "text", "token_counts.input_tokens", "token_counts.reasoning_tokens", "event_type")
    return Q.unwrap_output(a.withColumnRenamed("text", "t"), "event_type").select(
        "event_id", F.col("t").alias("text"), "input_tokens", "reasoning_tokens", F.col("text").alias("plain")
    )


@query(
    "doc_hash",
    "SELECT doc_id, sha256(CAST(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source) AS VARCHAR)) AS doc_hash FROM documents",
)
def doc_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.doc_hash(["source", "lang", "doc_id", "n_chars"]).alias("doc_hash"))


LEVEL = "SELECT lang, i // 1000 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {0} GROUP BY lang, {0}.i // 1000"
UPPER = LEVEL.replace("sha256(", "CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(").replace(" AS h FROM", " END AS h FROM")


@query(
    "task_hash",
    """WITH z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, sha256(CAST(json_object('doc_id', doc_id, 'n_chars', n_chars) AS VARCHAR)) AS h FROM documents),
y AS (SELECT lang, i, 'sample_' || i || ':' || h AS h FROM z), a AS ("""
    + LEVEL.format("y") + "), b AS (" + UPPER.format("a") + "), c AS (" + UPPER.format("b") + ") SELECT lang, h AS task_hash FROM c",
)
def task_hash(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", Q.doc_hash(["doc_id", "n_chars"]).alias("doc_hash"))
    return Q.task_hash(docs, ["lang"], "doc_id")


@query(
    "flatten_rounds",
    """SELECT event_id, value > 50 AS success, CAST(event_id % 4 AS DOUBLE) AS tool_calls, 2 AS trace_len, x.i AS round_pos, x.i + 1 AS round_idx, event_type || x.i AS model_output, x.i = 1 AS terminal
 FROM events, (VALUES (0), (1)) x(i) WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, NULL, 0, NULL, NULL, NULL, NULL FROM events WHERE event_id % 3 = 0""",
)
def flatten_rounds(spark, d):
    rounds = F.array(
        *[
            F.struct(F.lit(i + 1).alias("round_idx"), F.concat("event_type", F.lit(str(i))).alias("model_output"), F.lit(i == 1).alias("terminal"))
            for i in (0, 1)
        ]
    )
    payload = F.to_json(
        F.struct(
            (F.col("value") > 50).alias("success"),
            (F.col("event_id") % 4).alias("tool_calls"),
            F.array(F.lit("a"), F.lit("b")).alias("trace"),
            rounds.alias("agentic_rounds"),
        )
    )
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, payload).otherwise("no trace").alias("response"))
    return Q.flatten_rounds(rows).select("event_id", "success", "tool_calls", "trace_len", "round_pos", "round_idx", "model_output", "terminal")


# --- sample tables ---


def _requests(spark, d):
    rows = V.losses(spark, d).select("vec_id", "gold", F.posexplode("losses").alias("idx", "ll"))
    return rows.select(
        F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("task"),
        F.col("vec_id").alias("doc_id"),
        "idx",
        F.lit(0).alias("repeat"),
        F.round("ll", 4).cast("string").alias("response"),
        F.concat(F.lit("f"), F.col("idx").cast("string")).alias("filtered"),
        F.struct(F.lit(1).alias("input_tokens")).alias("token_counts"),
        F.col("gold").cast("string").alias("target"),
        "ll",
    )


@query(
    "assemble_samples",
    """ SELECT 't' || vec_id % 3 AS task, vec_id AS doc_id, CAST(gold AS VARCHAR) AS target, array_to_string(['f' || i for i in range(0, len(l))], ',') AS filtered, len(l) AS n, CAST(l[1] > l[2] AS INTEGER) AS first_larger FROM losses""",
    ["losses"],
)
def assemble_samples(spark, d):
    r = _requests(spark, d)
    scores = V.losses(spark, d).select(
        F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("task"),
        F.col("vec_id").alias("doc_id"),
        (F.get("losses", F.lit(0)) > F.get("losses", F.lit(1))).cast("int").alias("first_larger"),
    )
    out = K.assemble_samples(r, scores)
    return out.select("task", "doc_id", "target", F.array_join("filtered_resps", ",").alias("filtered"), F.size("resps").alias("n"), "first_larger")


@query(
    "samples_flat",
    """ SELECT 't' || vec_id % 3 AS task, vec_id AS id, 'ctx ' || vec_id AS data, length('ctx ' || vec_id) AS input_len, CAST(gold AS VARCHAR) AS labels, 'multiple_choice' AS output_type,
 array_to_string([i || '. ' || substring('option-', 1, 1 + i % 7) for i in range(0, len(l))], chr(10)) AS choices, CAST(list_position(l, list_min(l)) - 1 AS VARCHAR) AS raw_predictions, CAST(list_position(u, list_min(u)) - 1 AS VARCHAR) AS filtered_predictions, CAST(gold AS DOUBLE) AS acc, 'g' AS "group" FROM losses""",
    ["losses"],
)
def samples_flat(spark, d):
    rows = V.losses(spark, d).select(
        F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("task"),
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("ctx "), F.col("vec_id").cast("string")).alias("input"),
        F.col("gold").alias("target"),
        "losses",
        F.col("unconditional").alias("filtered_losses"),
        "choices",
        F.col("gold").cast("double").alias("acc"),
    )
    members = rows.select("task").distinct().withColumn("group", F.lit("g"))
    return K.samples_flat(rows, "multiple_choice", ["acc"], members)


@query(
    "samples_flat_generation",
    "SELECT 't' AS task, conv_id || '-' || turn AS id, text AS data, length(text) AS input_len, role AS labels, 'generate_until' AS output_type, lower(text) AS raw_predictions, role AS filtered_predictions, CAST(turn AS DOUBLE) AS score FROM conversations",
)
def samples_flat_generation(spark, d):
    rows = table(spark, d, "conversations").select(
        F.lit("t").alias("task"),
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        F.col("text").alias("input"),
        F.col("role").alias("target"),
        F.array(F.lower("text")).alias("resps"),
        F.array("role").alias("filtered_resps"),
        F.col("turn").cast("double").alias("score"),
    )
    return K.samples_flat(rows, "generate_until", ["score"])
