"""From question records to prompts, messages and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim
from ..ordering import global_rank
from ..schemas import QUESTION
from ..skew import loosely

# Prompt texts and media file endings.
LETTER_INSTRUCTION = "Select the best option and output only its letter."
OPEN_INSTRUCTION = "Answer briefly and directly."
TIME_POINT_INSTRUCTION = (
    "Estimate the requested event time and its image location at that point. "
    "Output exactly one line in this format: <TIME HH:MM:SS.s video 1>; Point=(<x>, <y>). "
    " The x and y coordinates must be normalized to the range [0, 1]. "
    "Example format: <TIME 00:00:12.3 video 1>; Point=(0.45, 0.62)"
)
TIME_POINT_CLASSES = ["oos_step2_last_visible", "oos_step3_last_placement"]
FIXTURE_CLASS = "oos_step4_fixture"
VIDEO_ENDINGS = r"(?i)\.(mp4|avi|mov|mkv|webm)$"
IMAGE_ENDINGS = r"(png|jpg|jpeg|webp|gif|bmp|tif|tiff)"

#: Fields that hold a link.
LINK_FIELDS = ["url", "uri", "path", "image", "image_url", "image_path"]

CONTENT = "array<struct<type:string,text:string,url:string>>"

# flat question columns, in order
FLAT = [
    "id",
    "doc_id",
    "trajectory_id",
    "mode",
    "step",
    "branch_group",
    "video_id",
    "source_video_id",
    "video_path",
    "query_time_sec",
    "query_time_in_clip_sec",
    "clip_start_time_sec",
    "clip_end_time_sec",
    "clip_duration_sec",
    "horizon_sec",
    "question",
    "question_class",
    "step_question_class",
    "group_id",
    "choices",
    "answer_idx",
    "answer",
    "acceptable_answers",
    "acceptable_answer_idxs",
    "object_a_assoc_id",
    "object_a_name",
    "target_reference_image_path",
    "target_reference_steps",
    "target_reference_metadata",
    "generation_info",
    "bev_image_path",
    "kitchen_bev_image_path",
    "answer_metadata",
]


def _none_or(c: Column) -> Column:
    """null for an empty array."""
    return F.when(F.size(c) > 0, c)


def _strings(c: Column | None = None) -> Column:
    empty = F.array().cast("array<string>")
    return empty if c is None else F.coalesce(c, empty)


def _ints(*cs: Column) -> Column:
    return F.coalesce(*[_none_or(c) for c in cs], F.array().cast("array<int>"))


def with_schema(df: DataFrame) -> DataFrame:
    """Adds the record columns a table lacks, so that every step below can name them."""
    have = set(df.columns)
    fill = {
        f.name: F.lit(None).cast(f.dataType) for f in QUESTION.fields if f.name not in have and not f.name.startswith("_")
    }
    return df.withColumns(fill) if fill else df


def raw_fixture_options(meta: Column, choices: Column, idx: Column) -> tuple[Column, Column, Column]:
    """(choices, gold index, replaced?) from the first non-empty pool of the answer metadata; the raw gold is appended
    when missing; without a usable pool or gold the given choices stay."""
    pools = ["raw_choice_pool", "raw_expanded_choice_pool", "fixture_choice_pool", "expanded_choice_pool"]
    pool = F.coalesce(*[_none_or(meta[p]) for p in pools], _strings())
    options = F.filter(pool, lambda x: trim(x) != "")
    gold = F.coalesce(F.nullif(meta["raw_correct_fixture"], F.lit("")), F.nullif(meta["correct_fixture"], F.lit("")))
    gold = F.nullif(trim(gold), F.lit(""))
    full = F.when(F.array_contains(options, gold), options).otherwise(F.array_append(options, gold))
    usable = gold.isNotNull()
    at = F.array_position(full, gold).cast("int") - 1
    return F.when(usable, full).otherwise(choices), F.when(usable, at).otherwise(idx), usable


def expand_steps(df: DataFrame, raw_fixtures: bool = False) -> DataFrame:
    """One row per step that is not skipped. The skip filter runs inside the array, before rows are made."""
    df = with_schema(df)
    kept = F.filter("steps", lambda s: ~F.coalesce(s["skipped"], F.lit(False)))
    s = F.col("_s")
    step_id = trim(s["step"])
    base = F.coalesce("doc_id", "trajectory_id")
    cls = F.coalesce(s["step_question_class"], F.col("question_class"), F.lit("unknown"))
    choices, idx = _strings(s["choices"]), s["correct_idx"]
    answer = F.coalesce(s["target_text"], s["answer"])
    ok_texts = _strings(s["acceptable_answers"])
    ok_idxs = _ints(s["acceptable_idxs"], s["acceptable_answer_idxs"])
    if raw_fixtures:
        fixture = F.lower(trim(cls)) == FIXTURE_CLASS
        raw, raw_idx, usable = raw_fixture_options(s["answer_metadata"], choices, idx)
        swap = fixture & usable
        choices = F.when(fixture, raw).otherwise(choices)
        answer = F.when(swap, F.get(raw, raw_idx)).otherwise(answer)
        ok_texts = F.when(swap, _strings()).otherwise(ok_texts)
        ok_idxs = F.when(swap, F.array().cast("array<int>")).otherwise(ok_idxs)
        idx = F.when(fixture, raw_idx).otherwise(idx)
    made = {
        "id": F.concat(base, F.lit("__step_"), step_id),
        "doc_id": F.concat(base, F.lit("__step_"), step_id),
        "mode": F.lit("multi_turn"),
        "step": step_id,
        "branch_group": s["branch_group"],
        "source_video_id": F.coalesce("video_id", "source_video_id"),
        "question": s["question"],
        "question_class": cls,
        "step_question_class": cls,
        "group_id": cls,
        "choices": choices,
        "answer_idx": idx,
        "answer": answer,
        "acceptable_answers": ok_texts,
        "acceptable_answer_idxs": ok_idxs,
        "target_reference_steps": _strings(F.col("target_reference_steps")),
        "answer_metadata": s["answer_metadata"],
    }
    rows = df.withColumn("_s", F.explode(kept))
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in FLAT])


def normalize_single(df: DataFrame) -> DataFrame:
    """Single-question records in the same columns."""
    df = with_schema(df)
    ident = F.coalesce("doc_id", "id", "trajectory_id")
    cls = F.coalesce("step_question_class", "question_class", F.lit("unknown"))
    made = {
        "id": ident,
        "doc_id": ident,
        "mode": F.coalesce("mode", F.lit("single_turn")),
        "step": F.lit(None).cast("string"),
        "branch_group": F.lit(None).cast("string"),
        "source_video_id": F.coalesce("source_video_id", "video_id"),
        "question_class": cls,
        "step_question_class": F.coalesce("step_question_class", cls),
        "group_id": cls,
        "choices": _strings(F.col("choices")),
        "answer_idx": F.col("correct_idx"),
        "answer": F.coalesce("target_text", "answer"),
        "acceptable_answers": _strings(F.col("acceptable_answers")),
        "acceptable_answer_idxs": _ints(F.col("acceptable_answer_idxs")),
        "target_reference_steps": _strings(F.col("target_reference_steps")),
    }
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in FLAT])


def moved_media(df: DataFrame, media_base: str) -> DataFrame:
    """Records whose video_path is the folder and the path's file name; missing paths stay missing."""
    name = F.regexp_extract(F.regexp_replace("video_path", r"[\\/]+$", ""), r"[^\\/]*$", 0)
    return df.withColumn("video_path", F.when(F.col("video_path").isNotNull(), F.concat(F.lit(media_base.rstrip("/") + "/"), name)))


def prepare_questions(
    df: DataFrame, steps: list[str] | None = None, shuffle_seed: int | None = None, raw_fixtures: bool = False, media_base: str | None = None
) -> DataFrame:
    """Both kinds of records as flat questions, optionally only some steps, optionally in a seeded order.

    Unreadable lines are no questions; validation reports them. With media_base, videos are looked for in that folder
    under the file names of their recorded paths.
    """
    df = with_schema(df)
    if media_base is not None:
        df = moved_media(df, media_base)
    df = df.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in df.columns else df
    multi = F.coalesce((F.col("mode") == "multi_turn") & F.col("steps").isNotNull(), F.lit(False))
    out = expand_steps(df.where(multi), raw_fixtures).unionByName(normalize_single(df.where(~multi)))
    if steps is not None:
        out = out.where(F.col("step").isin(*[s.strip() for s in steps]))
    if shuffle_seed is not None:
        out = out.orderBy(F.xxhash64(F.lit(str(shuffle_seed)), "id"), "id")
    return out


def slice_docs(
    df: DataFrame,
    order: str,
    keys: list[str] | None = None,
    limit: float | None = None,
    offset: int = 0,
    shard: int = 0,
    n_shards: int = 1,
) -> DataFrame:
    """Rows shard+offset, then every n_shards-th, below offset+limit, counted per task in a numeric order.

    limit: a count, a fraction in (0, 1) of the task rounded up, or -1/None for all. Ranks are made range by range, so
    a task of any size is spread over the cluster.
    """
    if offset < 0:
        raise ValueError(f"offset must be >= 0, got {offset}")
    if limit is not None and limit != -1 and limit < 0:
        raise ValueError(f"limit must be -1 or non-negative, got {limit}")
    keys = keys or []
    pos = F.col("_rank") - 1
    ranked = global_rank(df, keys, order, name="_rank")
    keep = (pos >= offset + shard) & (F.pmod(pos - (offset + shard), F.lit(n_shards)) == 0)
    if limit is not None and 0 < limit < 1:
        if keys:
            sizes = loosely(df, keys, F.ceil(F.count(F.lit(1)) * limit).alias("_n"))
            ranked = ranked.join(sizes, keys)
            bound = F.col("_n")
        else:
            bound = df.agg(F.ceil(F.count(F.lit(1)) * limit)).scalar()
        keep = keep & (pos < offset + bound)
    elif limit is not None and limit != -1:
        keep = keep & (pos < offset + int(limit))
    return ranked.where(keep).drop("_rank", "_n")


def sample_counts(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    effective = F.least(n, F.lit(int(limit))) if limit and limit > 0 else n
    return df.groupBy(*keys).agg(n.alias("original"), effective.cast("bigint").alias("effective"))


def question_block(answer_instruction: bool = True) -> Column:
    """Question, options and instruction of a flat question row."""
    many = F.coalesce(F.size("choices"), F.lit(0)) > 0
    options = F.array_join(F.transform("choices", lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c)), "\n")
    is_point = F.lower(trim(F.coalesce("step_question_class", F.lit("")))).isin(*TIME_POINT_CLASSES)
    told = F.when(many, LETTER_INSTRUCTION).when(is_point, TIME_POINT_INSTRUCTION).otherwise(OPEN_INSTRUCTION)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Question: "), F.col("question")),
        F.when(many, F.concat(F.lit("Options:\n"), options)),
        told if answer_instruction else F.lit(None).cast("string"),
    )


def render_prompt(df: DataFrame, system_prompt: str, name: str = "prompt") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(system_prompt + "\n\n"), question_block()))


def _content(kind: Column | str, text: Column | None = None, url: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        (text if text is not None else none).alias("text"),
        (url if url is not None else none).alias("url"),
    )


def media_content(urls: Column) -> Column:
    """Video by file ending, otherwise image."""
    return F.transform(
        urls,
        lambda u: _content(F.when(F.rlike(u, F.lit(VIDEO_ENDINGS)), "video").otherwise("image"), url=u),
    )


def build_messages(df: DataFrame, system_prompt: str, visuals: str | None = None, name: str = "messages") -> DataFrame:
    """System message, then a user message with media before text. visuals: array<string> of paths."""
    text = F.array(_content("text", question_block()))
    user = F.concat(media_content(F.coalesce(F.col(visuals), _strings())), text) if visuals else text
    system = F.struct(
        F.lit("system").alias("role"), F.array(_content("text", F.lit(system_prompt))).alias("content")
    )
    return df.withColumn(
        name, F.array(system, F.struct(F.lit("user").alias("role"), user.cast(CONTENT).alias("content")))
    )


def extract_media(messages: Column) -> Column:
    """struct(images, videos, audios) of a message array, in order."""
    items = F.flatten(F.transform(messages, lambda m: m["content"]))

    def of(kind: str) -> Column:
        return F.transform(F.filter(items, lambda c: c["type"] == kind), lambda c: c["url"])

    return F.struct(of("image").alias("images"), of("video").alias("videos"), of("audio").alias("audios"))


def looks_like_image(c: Column) -> Column:
    low = trim(F.lower(c))
    linked = F.rlike(low, F.lit(r"^(https?|file)://")) & F.rlike(low, F.lit(rf"\.{IMAGE_ENDINGS}"))
    local = ~F.rlike(low, F.lit(r"^(https?|file)://")) & F.rlike(low, F.lit(rf"\.{IMAGE_ENDINGS}$"))
    return F.startswith(low, F.lit("data:image/")) | linked | local


def _strings_in(c: Column, t: T.DataType) -> Column | None:
    """All text leaves of a nested column: fields that name a link first, then schema order."""
    if isinstance(t, T.StringType):
        return F.array(c)
    if isinstance(t, T.StructType):
        named = sorted(t.fields, key=lambda f: LINK_FIELDS.index(f.name) if f.name in LINK_FIELDS else len(LINK_FIELDS))
        parts = [p for p in (_strings_in(c[f.name], f.dataType) for f in named) if p is not None]
        return F.concat(*[_strings(p) for p in parts]) if parts else None
    if isinstance(t, T.ArrayType):
        probe = _strings_in(c, t.elementType)
        return None if probe is None else F.flatten(F.transform(c, lambda x: _strings(_strings_in(x, t.elementType))))
    if isinstance(t, T.MapType):
        return _strings_in(F.map_values(c), T.ArrayType(t.valueType))
    return None


def input_media(df: DataFrame, columns: list[str], name: str = "input_media", most: int = 4) -> DataFrame:
    """Up to `most` distinct image references among the text leaves of the columns, in order (a display list)."""
    parts = [_strings_in(F.col(c), df.schema[c].dataType) for c in columns]
    leaves = F.concat(*[_strings(p) for p in parts if p is not None])
    return df.withColumn(name, F.slice(F.array_distinct(F.filter(leaves, lambda x: looks_like_image(x))), 1, most))


def _list_text(c: Column) -> Column:
    """A text like ['a', 'b'] or ["a"] as an array; null when it is no list."""
    t = trim(c)
    as_json = F.from_json(t, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(F.rlike(t, F.lit(r"(?s)^\[.*\]$")), as_json)


def derive_fields(df: DataFrame, text=None, target=None, choices=None) -> DataFrame:
    """Adds `text`, `target` and `choice_list`.

    Each source is a column name, a constant int, a list, a dict (its values) or a Spark SQL expression. With choices, a
    target made of digits becomes `target_idx`; a target that looks like a list becomes `target_list`.
    """

    def source(spec) -> Column:
        if isinstance(spec, (int, float)):
            return F.lit(spec)
        if isinstance(spec, (list, tuple)):
            return F.array(*[F.lit(x) for x in spec])
        if isinstance(spec, dict):
            return F.array(*[F.lit(x) for x in spec.values()])
        return F.col(spec) if spec in df.columns else F.expr(spec)

    out = df
    if text is not None:
        out = out.withColumn("text", source(text).cast("string"))
    if choices is not None:
        c = source(choices)
        kind = df.select(c.alias("c")).schema[0].dataType
        out = out.withColumn("choice_list", c if isinstance(kind, T.ArrayType) else _list_text(c))
    if target is not None:
        c = source(target)
        kind = df.select(c.alias("c")).schema[0].dataType
        if isinstance(kind, T.ArrayType):
            return out.withColumn("target_list", c.cast("array<string>"))
        s = c.cast("string")
        out = out.withColumn("target", s).withColumn("target_list", _list_text(s))
        if choices is not None:
            out = out.withColumn("target_idx", F.when(F.rlike(s, F.lit(r"^\d+$")), s.try_cast("int")))
    return out


def fewshot_context(
    df: DataFrame,
    pool: DataFrame,
    k: int,
    sampler: str = "random",
    seed: int = 0,
    prefix: str = "",
    delimiter: str = "\n\n",
    same_split: bool = False,
    order: str = "order",
    name: str = "context",
) -> DataFrame:
    """Prefix plus k labelled examples per row, each ended by the delimiter.

    df and pool have `id`; pool has `shot` (text with its label) and a numeric unique `order`. From the evaluated split
    k+1 are drawn and the row itself is removed.

    first: the k(+1) first pool rows, one small array. random: every row draws distinct pool positions from hashes of
    (seed, id, draw) and fetches their texts by an equi-join, so neither the pool nor the rows need to be small.
    """
    need = k + 1 if same_split else k
    if sampler == "first":
        taken = pool.orderBy(order).limit(need)
        have = taken.agg(F.sort_array(F.collect_list(F.struct(order, "id", "shot")))).scalar()
        few = F.raise_error(F.lit(f"{need} examples wanted, fewer are available")).cast("string")
        shots = F.slice(F.filter("_have", lambda s: F.lit(not same_split) | (s["id"] != F.col("id"))), 1, k)
        body = F.array_join(F.transform(shots, lambda s: s["shot"]), delimiter)
        text = F.concat(F.lit(prefix), body, F.lit(delimiter))
        out = df.withColumn("_have", have)
        return out.withColumn(name, F.when(F.size("_have") < need, few).otherwise(text)).drop("_have")
    if sampler != "random":
        raise ValueError(f"unknown sampler {sampler!r}")
    size = pool.agg(F.count(F.lit(1))).scalar()
    numbered = global_rank(pool.select(F.col("id").alias("_pid"), "shot", order), [], order, name="_pos")
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(4 * need)),
        lambda i: F.pmod(F.xxhash64(F.lit(str(seed)), F.col("id"), i), F.col("_size")) + 1,
    )
    # the tail fills up in case too many draws coincide
    tail = F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_size"), F.lit(need).cast("bigint")))
    picks = F.slice(F.array_distinct(F.concat(draws, tail)), 1, need)
    want = df.select("id").distinct().withColumn("_size", size).select("id", F.posexplode(picks).alias("_i", "_pos"))
    got = want.join(numbered, "_pos")
    if same_split:
        got = got.where(F.col("_pid") != F.col("id"))
    # at most k+1 texts per row
    shots = got.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_i", "shot"))).alias("_shots"))
    body = F.array_join(F.transform(F.slice("_shots", 1, k), lambda s: s["shot"]), delimiter)
    out = df.join(shots, "id", "left")
    few = F.raise_error(F.concat(F.lit(f"{need} examples wanted, there are "), size.cast("string"))).cast("string")
    text = F.concat(F.lit(prefix), F.coalesce(body, F.lit("")), F.lit(delimiter))
    return out.withColumn(name, F.when(size < need, few).otherwise(text)).drop("_shots")


def build_requests(
    df: DataFrame,
    output_type: str,
    repeats: int = 1,
    context: str = "prompt",
    choices: str = "choices",
    target: str = "target",
    mutual_information: bool = False,
    target_delimiter: str = " ",
    gen_kwargs: dict[str, str] | None = None,
    several_contexts: bool = False,
) -> DataFrame:
    """REQUEST rows: one per question, or one per choice (plus one without context for mutual information).

    several_contexts: the choices of a question are its contexts, and all have the target as continuation.
    """
    keep = [c for c in ("task", "split", "doc_id") if c in df.columns]
    none = F.lit(None).cast("map<string,string>")
    kwargs = none if not gen_kwargs else F.create_map(*[F.lit(x) for kv in gen_kwargs.items() for x in kv])

    def rows(src: DataFrame, idx: Column, kind: str, ctx: Column, cont: Column, kw: Column) -> DataFrame:
        return src.select(
            *keep,
            idx.cast("int").alias("idx"),
            F.lit(kind).alias("request_type"),
            ctx.alias("context"),
            cont.alias("continuation"),
            kw.alias("gen_kwargs"),
        )

    if output_type == "multiple_choice":
        fixed = F.col(target if several_contexts else context).cast("string")
        each = df.select(*keep, fixed.alias("_fixed"), F.posexplode(choices).alias("_i", "_c"))
        ctx, cont = (F.col("_c"), F.col("_fixed")) if several_contexts else (F.col("_fixed"), F.col("_c"))
        out = rows(each, F.col("_i"), "loglikelihood", ctx, F.concat(F.lit(target_delimiter), cont), none)
        if mutual_information:
            out = out.unionByName(rows(each, F.col("_i"), "loglikelihood", F.lit(""), F.col("_c"), none))
    elif output_type == "loglikelihood":
        out = rows(df, F.lit(0), "loglikelihood", F.col(context), F.col(target), none)
    else:
        out = rows(df, F.lit(0), output_type, F.col(context), F.lit(None).cast("string"), kwargs)
    return out.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max(repeats, 1) - 1))))


def rolling_windows(
    df: DataFrame, tokens: str, max_len: int, context_len: int, prefix: Column | str | int, disjoint: bool = False
) -> DataFrame:
    """(window, input, target) per row: at most max_len tokens each, context_len overlap, the first one prefixed."""
    if not 1 <= context_len <= max_len:
        raise ValueError("context_len must lie between 1 and max_len")
    step = max_len - context_len + 1
    t, n = F.col(tokens), F.size(tokens)
    pre = prefix if isinstance(prefix, Column) else F.lit(prefix)
    extra = F.greatest(F.ceil((n - max_len) / F.lit(step)).cast("int"), F.lit(0))
    rows = df.where(n > 0).withColumn("window", F.explode(F.sequence(F.lit(0), extra)))
    done = F.when(F.col("window") == 0, 0).otherwise(F.lit(max_len) + (F.col("window") - 1) * step)
    size = F.when(F.col("window") == 0, F.least(n, F.lit(max_len))).otherwise(F.least(n - done, F.lit(step)))
    end = done + size
    target = F.slice(t, done + 1, size)
    start = F.greatest(end - max_len - 1, F.lit(0))
    source = F.when(F.col("window") == 0, F.concat(F.array(pre), F.slice(t, F.lit(1), size - 1))).otherwise(
        F.slice(t, start + 1, end - 1 - start)
    )
    rows = rows.withColumn("input", source).withColumn("target", target)
    if disjoint:
        rows = rows.withColumn("input", F.slice("input", F.lit(1), F.size("input") - (F.size("target") - 1)))
    return rows


def unwrap_output(df: DataFrame, output: str = "output") -> DataFrame:
    """struct<text, token_counts> or plain text -> text and a token_counts struct of nullable bigints."""
    counts = ["input_tokens", "output_tokens", "reasoning_tokens"]
    t = df.schema[output].dataType
    fields = {}
    if isinstance(t, T.StructType):
        text = F.col(output)["text"]
        if "token_counts" in t.fieldNames():
            fields = {f.name: F.col(output)["token_counts"][f.name] for f in t["token_counts"].dataType.fields}
    else:
        text = F.col(output)
    parts = [fields.get(c, F.lit(None)).cast("bigint").alias(c) for c in counts]
    return df.withColumn("text", text).withColumn("token_counts", F.struct(*parts))


def doc_hash(columns: list[str]) -> Column:
    """sha256 of the JSON of the columns in name order. Null fields are left out of the JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


HASH_FANOUT = 1_000


def task_hash(df: DataFrame, keys: list[str], order: str, hash_column: str = "doc_hash") -> DataFrame:
    """One hash per task over its documents in order.

    A tree as deep as the task needs: runs of 1,000 hashes are joined and hashed until one is left, so no group ever holds
    more than 1,000 values. A run of a single hash hands it on, so a task's hash does not depend on larger tasks beside it.
    The size of the largest task is looked up first.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    level = global_rank(df.select(*keys, order, hash_column), keys, order, name="_i").select(
        *keys, (F.col("_i") - 1).alias("_i"), F.concat(F.lit("sample_"), F.col("_i") - 1, F.lit(":"), hash_column).alias("_h")
    )
    depth = 0
    while depth == 0 or most > 1:
        runs = level.withColumn("_g", F.floor(F.col("_i") / HASH_FANOUT))
        hashed = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), ""), 256)
        if depth:
            hashed = F.when(F.count(F.lit(1)) == 1, F.first("_h")).otherwise(hashed)
        level = runs.groupBy(*keys, "_g").agg(hashed.alias("_h")).withColumnRenamed("_g", "_i")
        most, depth = -(-most // HASH_FANOUT), depth + 1
    return level.select(*keys, F.col("_h").alias("task_hash"))


def flatten_rounds(df: DataFrame, response: str = "response") -> DataFrame:
    """Fields of a multi-round trace kept in a final response, one row per round (one row without rounds)."""
    from ..schemas import TRACE

    keep = [c for c in df.columns if c != response]
    t = df.withColumn("_t", F.from_json(response, TRACE))
    head = ["success", "error", "tool_calls", "valid_tool_calls", "invalid_steps"]
    rows = t.select(
        *keep,
        *[F.col(f"_t.{h}").alias(h) for h in head],
        F.size(_strings(F.col("_t.trace"))).alias("trace_len"),
        F.posexplode_outer("_t.agentic_rounds").alias("round_pos", "_r"),
    )
    names = ["round_idx", "round_input", "model_output", "terminal", "tool_result", "next_input"]
    return rows.select(
        *[c for c in rows.columns if c != "_r"],
        *[F.col(f"_r.{n}").alias(n) for n in names],
        *[F.col(f"_r.{n}").alias(f"round_{n}") for n in head[2:]],
    )
