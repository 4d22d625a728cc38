"""Checks of question records, video ids and calibration files; one output row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..schemas import CALIBRATION
from .questions import with_schema

VIDEO_ID = r"^P0[1-9]-\d{8}-\d{6}$"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _question_errors(q: Column, label: Column, raw: Column | None, path: Column | None) -> list[Column]:
    """Errors of one question struct, null where there is none."""
    choices = F.coalesce(q["choices"], F.array().cast("array<string>"))
    many = F.size(choices) > 0
    bad_list = F.exists(choices, lambda c: c.isNull())
    idx_ok = q["correct_idx"].isNotNull() & (q["correct_idx"] >= 0) & (q["correct_idx"] < F.size(choices))
    if raw is not None:

        def kind(field: str) -> Column:
            return F.schema_of_variant(F.try_variant_get(raw, F.concat(path, F.lit(field)), "variant"))

        bad_list = F.coalesce(kind(".choices") != "ARRAY<STRING>", F.lit(True))
        idx_ok = idx_ok & (F.coalesce(kind(".correct_idx"), F.lit("")) == "BIGINT")
    target = F.coalesce(q["target_text"], q["answer"])
    return [
        F.when(trim(F.coalesce(q["question"], F.lit(""))) == "", F.concat(label, F.lit(": missing question text"))),
        F.when(many & bad_list, F.concat(label, F.lit(": choices must be a list of strings"))),
        F.when(
            many & ~bad_list & ~idx_ok, F.concat(label, F.lit(": correct_idx must index choices (zero-based)"))
        ),
        F.when(~many & _blank(target), F.concat(label, F.lit(": missing target_text or answer"))),
    ]


def validate_questions(df: DataFrame, media_listing: DataFrame | None = None, record: str = "record") -> DataFrame:
    """(record, error) rows; an empty table gives one row of its own.

    All checks of a record look only at that record, duplicates of a step included, so nothing is shuffled except for
    the media check. With a `_raw` column (the JSON line) the types of choices and correct_idx are checked as written.
    """
    raw_text = "_raw" in df.columns
    df = with_schema(df)
    if raw_text:
        df = df.withColumn("_v", F.try_parse_json("_raw"))
    raw = F.col("_v") if raw_text else None
    t = F.col("query_time_sec")
    bad_time = t.isNull() | F.isnan(t) | (t < 0) | (t == float("inf"))
    has_steps = F.col("steps").isNotNull()
    own = F.struct("question", "choices", "correct_idx", "target_text", "answer")
    errors = [
        F.when(
            _blank(F.col("doc_id")) & _blank(F.col("trajectory_id")) & _blank(F.col("id")),
            "missing doc_id, trajectory_id, or id",
        ),
        F.when(bad_time, "query_time_sec must be a finite nonnegative number"),
        F.when(_blank(F.col("video_path")), "video_path must be a nonempty string"),
        F.when(
            has_steps & (F.coalesce("mode", F.lit("")) != "multi_turn"), "records with steps must set mode=multi_turn"
        ),
        F.when(has_steps & (F.size("steps") == 0), "steps must be a nonempty list when present"),
    ]
    if "_corrupt_record" in df.columns:
        broken = F.col("_corrupt_record").isNotNull()
        errors.append(F.when(broken, "record is not readable in the declared schema"))
    single = _question_errors(own, F.lit("question"), raw, F.lit("$"))
    errors += [F.when(~has_steps, e) for e in single]
    ids = F.transform("steps", lambda s: F.when(~F.coalesce(s["skipped"], F.lit(False)), trim(F.coalesce(s["step"], F.lit("")))))

    def step_errors(s: Column, i: Column) -> Column:
        label = F.concat(F.lit("steps["), i.cast("string"), F.lit("]"))
        sid = trim(F.coalesce(s["step"], F.lit("")))
        seen = (sid == "") | (F.array_position(F.col("_ids"), sid) <= i)
        path = F.concat(F.lit("$.steps["), i.cast("string"), F.lit("]"))
        found = [F.when(seen, F.concat(label, F.lit(": missing or duplicate step identifier")))]
        found += _question_errors(s, label, raw, path)
        none = F.array().cast("array<string>")
        return F.when(F.coalesce(s["skipped"], F.lit(False)), none).otherwise(F.array_compact(F.array(*found)))

    rows = df.withColumn("_ids", ids)
    nested = F.flatten(F.transform(F.col("steps"), step_errors))
    all_errors = F.concat(F.array_compact(F.array(*errors)), F.coalesce(nested, F.array().cast("array<string>")))
    out = rows.select(F.col(record).alias("record"), F.explode(all_errors).alias("error"))
    if media_listing is not None:
        paths = df.select(
            F.col(record).alias("record"),
            F.explode(
                F.array(
                    F.struct(F.lit("video").alias("kind"), F.col("video_path").alias("path")),
                    F.struct(F.lit("target reference image").alias("kind"), F.col("target_reference_image_path").alias("path")),
                )
            ).alias("m"),
        ).select("record", "m.*")
        gone = paths.where(~_blank(F.col("path"))).join(media_listing.select("path"), "path", "left_anti")
        out = out.unionByName(
            gone.select("record", F.concat("kind", F.lit(" does not exist: "), "path").alias("error"))
        )
    empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return out.unionByName(
        empty.select(F.lit(None).cast(out.schema["record"].dataType).alias("record"), F.lit("Dataset contains no records.").alias("error"))
    )


def select_video_ids(dfs: list[DataFrame], fail: bool = True) -> DataFrame:
    """Distinct sorted video ids of all variants. A bad id or path is an error, and so is an empty result."""
    rows = None
    for df in dfs:
        path = F.col("video_path") if "video_path" in df.columns else F.lit(None).cast("string")
        part = df.select("video_id", path.alias("video_path"))
        rows = part if rows is None else rows.unionByName(part)
    vid = F.coalesce("video_id", F.lit(""))
    bad_id = ~F.rlike(vid, F.lit(VIDEO_ID))
    bad_path = F.col("video_path").isNotNull() & (F.col("video_path") != F.concat(vid, F.lit(".mp4")))
    if fail:
        checked = (
            F.when(bad_id, F.raise_error(F.concat(F.lit("invalid video_id "), vid)))
            .when(bad_path, F.raise_error(F.concat(F.lit("expected flat video_path for "), vid)))
            .otherwise(vid)
        )
        return rows.select(checked.alias("video_id")).distinct().orderBy("video_id")
    return rows.where(~bad_id & ~bad_path).select("video_id").distinct().orderBy("video_id")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The table; reading it fails when it is empty."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    guard = n.where("_n = 0").select(F.raise_error(F.lit(message)).cast("boolean").alias("_x")).where(F.col("_x"))
    return df.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def calibration_geometry(cal: DataFrame) -> DataFrame:
    """(video_id, width, height, cx, cy, radius, error) from CALIBRATION rows with video_id."""
    cam = F.col("cameras")["camera-rgb"]
    geo = {
        "width": F.get(cam["image_size"], F.lit(0)).cast("double"),
        "height": F.get(cam["image_size"], F.lit(1)).cast("double"),
        "cx": F.get(cam["projection_params"], F.lit(1)),
        "cy": F.get(cam["projection_params"], F.lit(2)),
        "radius": cam["valid_radius"],
    }
    out = cal.select("video_id", *[c.alias(n) for n, c in geo.items()])
    bad = F.lit(False)
    for n in geo:
        c = F.col(n)
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    small = F.least("width", "height", "radius") <= 0
    return out.withColumn("error", F.when(bad | F.coalesce(small, F.lit(True)), "invalid camera-rgb geometry"))


def validate_calibration(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(video_id, error) of the videos without a valid calibration below root/<participant>/<video>/."""
    from ..sources.records import listed_in_parts

    with listed_in_parts(spark):
        files = spark.read.schema(CALIBRATION).option("multiLine", True).json(f"{root}/*/*/device_calibration.json")
    cal = files.withColumn("video_id", F.regexp_extract(F.input_file_name(), r"/([^/]+)/device_calibration\.json$", 1))
    return calibration_failures(cal, ids)


def calibration_failures(cal: DataFrame, ids: DataFrame) -> DataFrame:
    geo = calibration_geometry(cal).select("video_id", "error", F.lit(True).alias("_there"))
    joined = ids.select("video_id").join(geo, "video_id", "left")
    error = F.when(F.col("_there").isNull(), "missing camera calibration").otherwise(F.col("error"))
    return joined.select("video_id", error.alias("error")).where("error is not null")
