"""Plans about videos and images as tables: which clips, frames and files a set of questions needs. No decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..skew import loosely

# Classes whose clip shows a marker, and file naming.
MARKED_CLASSES = ["oos_branch_object_object_relation", "oos_branch_object_object_distance"]
LAYOUT_ENDINGS = ["jpeg", "jpg", "png"]
SOURCE_FOLDERS = ["{p}", "{p}_raw", "{p}selected"]
PARTICIPANT = r"/(P0[1-9])(?:/|$)"

VISUAL = "struct<kind:string,path:string,end_time:double,marker_x:double,marker_y:double,marker_time:double>"


def _marker(meta: Column, cls: Column) -> Column:
    """struct(x, y) for the marked classes when both coordinates lie in [0, 1]; else null."""
    xy = meta["object_y_normalized_projected_pixel"]
    x, y = F.get(xy, F.lit(0)), F.get(xy, F.lit(1))
    ok = F.lower(trim(F.coalesce(cls, F.lit("")))).isin(*MARKED_CLASSES) & x.between(0.0, 1.0) & y.between(0.0, 1.0)
    return F.when(ok, F.struct(x.alias("x"), y.alias("y")))


def clip_manifest(df: DataFrame, context: str = "prefix", query_frame_classes: list[str] | None = None) -> DataFrame:
    """Distinct media jobs (kind, video_path, end_time, marker_x, marker_y) a question table needs.

    Clips end one second after the query time, marked ones too; frames are taken at the query time. Rows without a
    video or a time are left out. dropDuplicates reduces on the map side, so much asked videos cost nothing extra.
    """
    if context not in ("prefix", "full", "last_frame"):
        raise ValueError(f"unknown context {context!r}")
    rows = df.where((F.coalesce("video_path", F.lit("")) != "") & F.col("query_time_sec").isNotNull())
    rows = rows.withColumn("_m", _marker(F.col("answer_metadata"), F.col("step_question_class")))
    t, m = F.col("query_time_sec"), F.col("_m")
    none = F.lit(None).cast("double")
    if context == "last_frame":
        cols = [F.lit("last_frame").alias("kind"), "video_path", t.alias("end_time"), m["x"].alias("marker_x"), m["y"].alias("marker_y")]
    else:
        frame = F.col("step_question_class").isin(*query_frame_classes) if query_frame_classes else F.lit(False)
        frame = F.coalesce(frame, F.lit(False))
        rest = F.lit("full") if context == "full" else F.lit("prefix")
        kind = F.when(frame, "query_frame").when(m.isNotNull(), "marked").otherwise(rest)
        end = F.when(kind == "query_frame", t).when(kind == "full", none).otherwise(t + 1.0)
        marked = kind == "marked"
        cols = [
            kind.alias("kind"),
            "video_path",
            end.alias("end_time"),
            F.when(marked, F.bround(m["x"], 2)).alias("marker_x"),
            F.when(marked, F.bround(m["y"], 2)).alias("marker_y"),
        ]
    return rows.select(*cols).dropDuplicates()


def visual_plan(
    df: DataFrame,
    context: str = "prefix",
    position: str = "after",
    query_frame_classes: list[str] | None = None,
    layout: str | None = None,
    layout_classes: list[str] | None = None,
    name: str = "visuals",
) -> DataFrame:
    """Adds the ordered visuals of every question (array of VISUAL).

    prefix: clip to query time + 1 s, with a marker for two classes; full: whole video, marked at the query time;
    last_frame: the frame at the exact query time. layout names a column with a layout image path for layout_classes
    (prefix only). The reference image goes before or after, for its requested steps.
    """
    if position not in ("before", "after"):
        raise ValueError(f"position must be 'before' or 'after', got {position!r}")
    if context not in ("prefix", "full", "last_frame"):
        raise ValueError(f"unknown context {context!r}")
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    t = F.coalesce("query_time_sec", F.lit(0.0))
    m = _marker(F.col("answer_metadata"), F.col("step_question_class"))

    def visual(kind: Column, path: Column, end: Column = none_d, mark: bool = False, at: Column = none_d) -> Column:
        return F.struct(
            kind.alias("kind"),
            path.alias("path"),
            end.alias("end_time"),
            (m["x"] if mark else none_d).alias("marker_x"),
            (m["y"] if mark else none_d).alias("marker_y"),
            at.alias("marker_time"),
        ).cast(VISUAL)

    video = F.col("video_path")
    missing = F.raise_error(F.concat(F.lit("missing video_path for "), F.coalesce("id", F.lit("?")))).cast(VISUAL)
    if context == "last_frame":
        main = visual(F.lit("frame"), video, t, mark=True)
    elif context == "full":
        marked = visual(F.lit("full"), video, none_d, True, t)
        main = F.when(m.isNotNull(), marked).otherwise(visual(F.lit("full"), video))
    else:
        frame = F.col("step_question_class").isin(*query_frame_classes) if query_frame_classes else F.lit(False)
        main = (
            F.when(F.coalesce(frame, F.lit(False)), visual(F.lit("frame"), video, t + 1.0))
            .when(m.isNotNull(), visual(F.lit("clip"), video, t + 1.0, True, t))
            .otherwise(visual(F.lit("clip"), video, t + 1.0))
        )
    main = F.when(F.coalesce(video, F.lit("")) == "", missing).otherwise(main)
    plan = [main]
    if layout and context == "prefix":
        cls = F.lower(trim(F.coalesce("step_question_class", F.lit(""))))
        wanted = cls.isin(*(layout_classes or ["oos_step4_fixture"])) & F.col(layout).isNotNull()
        plan.append(F.when(wanted, visual(F.lit("image"), F.col(layout))))
    steps = F.transform(F.coalesce("target_reference_steps", F.array().cast("array<string>")), trim)
    ref_path = F.col("target_reference_image_path")
    asked = (F.coalesce(ref_path, F.lit("")) != "") & F.array_contains(steps, trim(F.col("step")))
    ref = F.when(asked, visual(F.lit("image"), ref_path))
    plan = [ref, *plan] if position == "before" else [*plan, ref]
    return df.withColumn(name, F.array_compact(F.array(*plan)))


def _first_existing(rows: DataFrame, key: str, candidates: Column, listing: DataFrame, name: str) -> DataFrame:
    """(key, path) of the first candidate, in order, that stands in the listing."""
    tried = rows.select(key, F.posexplode(candidates).alias("_pos", "path")).where("path is not null")
    hit = tried.join(listing.select("path").distinct(), "path")
    return loosely(hit, [key], F.min_by("path", "_pos").alias(name))


def resolve_layout(df: DataFrame, listing: DataFrame, folder: str, default_path: str | None = None) -> DataFrame:
    """Adds layout_path: the explicit path if it exists, else <folder>/<kitchen>.jpeg, .jpg or .png.

    Questions share few candidate lists, so those are looked up once each, not once per question.
    """
    info = F.col("generation_info")
    explicit = F.coalesce(
        F.nullif("bev_image_path", F.lit("")),
        F.nullif("kitchen_bev_image_path", F.lit("")),
        F.nullif(F.try_element_at(info, F.lit("bev_image_path")), F.lit("")),
        F.lit(default_path).cast("string"),
    )
    vid = F.coalesce(
        F.nullif("video_id", F.lit("")),
        F.nullif("source_video_id", F.lit("")),
        F.try_element_at(info, F.lit("video_id")),
        F.lit(""),
    )
    kitchen = F.nullif(F.substring_index(trim(vid), "-", 1), F.lit(""))
    paths = [explicit] + [F.concat(F.lit(f"{folder}/"), kitchen, F.lit(f".{e}")) for e in LAYOUT_ENDINGS]
    rows = df.withColumn("_cands", F.array(*paths)).withColumn("_key", F.concat_ws("\0", "_cands"))
    wanted = rows.select("_key", "_cands").distinct()
    found = _first_existing(wanted, "_key", F.col("_cands"), listing, "layout_path")
    return rows.join(found, "_key", "left").drop("_key", "_cands")


def marker_box(df: DataFrame, x: str, y: str, t: str, width: int, height: int, size: int = 8, fps: float = 1.0) -> DataFrame:
    """Adds the pixel square (left, top, size) of a normalized point and its half-open time window."""
    size = max(1, size)

    def edge(c: str, length: int) -> Column:
        centre = F.greatest(F.lit(0.0), F.least(F.lit(float(length - 1)), F.col(c) * float(length)))
        return F.greatest(F.lit(0), F.least(F.lit(max(0, length - size)), F.bround(centre, 0).cast("int") - size // 2))

    start = F.greatest(F.lit(0.0), F.col(t).cast("double"))
    return df.withColumns(
        {
            "left": edge(x, width),
            "top": edge(y, height),
            "size": F.lit(size),
            "start_time": start,
            "stop_time": start + 1.0 / max(fps, 1e-6),
        }
    )


def clock(c: Column) -> Column:
    """HH:MM:SS.s; tenths are rounded half to even on the binary value, as printf-style formatting does."""
    s = c.cast("double")
    rest = s - F.floor(s / 60) * 60
    # exact ties are multiples of 1/20 that a double can hold: quarters only
    tenths = F.bround(rest * 4, 0) / 4
    sec = F.when(rest == tenths, F.bround(rest.cast("decimal(20,4)"), 1)).otherwise(F.round(rest, 1)).cast("double")
    return F.format_string("%02d:%02d:%04.1f", F.floor(s / 3600), F.floor((s - F.floor(s / 3600) * 3600) / 60), sec)


def time_token(c: Column, style: str = "token") -> Column:
    t = clock(c)
    if style == "token":
        return F.concat(F.lit("<TIME "), t, F.lit(" video 1>"))
    return F.concat(F.lit("Time\n"), t) if style == "labeled" else t


def video_end_times(dfs: list[DataFrame], extra_ids: list[DataFrame] | None = None, trim_to_end: bool = True) -> DataFrame:
    """(video_id, end_time): the largest clip end (else query time) per video; listed ids without an end get null."""
    rows = None
    for df in dfs:
        have = [c for c in ("clip_end_time_sec", "query_time_sec") if c in df.columns]
        end = F.coalesce(*[F.col(c).cast("string").try_cast("double") for c in have]) if trim_to_end and have else F.lit(None)
        part = df.where(F.coalesce("video_id", F.lit("")) != "").select("video_id", end.cast("double").alias("end_time"))
        rows = part if rows is None else rows.unionByName(part)
    for ids in extra_ids or []:
        part = ids.where(F.coalesce("video_id", F.lit("")) != "").select("video_id", F.lit(None).cast("double").alias("end_time"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("video_id").agg(F.max("end_time").alias("end_time"))


def resolve_source(ids: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """ids plus source_path: the first existing of the participant's three folders; null when there is none."""
    p = F.substring_index("video_id", "-", 1)
    cands = F.array(
        *[
            F.concat(F.lit(f"{root}/"), F.lit(f.split("{p}")[0]), p, F.lit(f.split("{p}")[1] + "/"), F.col("video_id"), F.lit(".mp4"))
            for f in SOURCE_FOLDERS
        ]
    )
    wanted = ids.select("video_id").distinct()
    return wanted.join(_first_existing(wanted, "video_id", cands, listing, "source_path"), "video_id", "left")


def discover_videos(listing: DataFrame, root: str, participants: DataFrame) -> DataFrame:
    """(participant, video_id) found in the participants' folders; those without any get a null id."""
    rel = F.substring(F.col("path"), len(root) + 2, 2**31 - 1)
    folder = F.regexp_extract(rel, r"^(P\w+?)(?:_raw|selected)?/[^/]+$", 1)
    vid = F.regexp_extract(rel, r"/([^/]+)\.mp4$", 1)
    found = (
        listing.where(F.startswith("path", F.lit(root + "/")))
        .select(folder.alias("participant"), vid.alias("video_id"))
        .where((F.col("video_id") != "") & F.startswith("video_id", F.concat("participant", F.lit("-"))))
        .distinct()
    )
    return participants.join(found, "participant", "left")


def manifest_category(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "root").otherwise(F.lower(F.substring_index(path, "/", 1)))


def participant_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit("/"), path), PARTICIPANT, 1), F.lit(""))


def select_manifest(manifest: DataFrame, participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the participants' original videos, participants without any)."""
    p = F.col("rel_path")
    videos = manifest.where((manifest_category(p) == "videos") & F.endswith(F.lower(p), F.lit(".mp4"))).withColumn(
        "participant", participant_of(p)
    )
    chosen = videos.join(participants.select("participant").distinct(), "participant", "left_semi")
    return chosen, participants.join(videos, "participant", "left_anti")


def select_manifest_ids(manifest: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of exactly the wanted videos, ids without a row)."""
    wanted = ids.select("video_id").distinct().withColumn(
        "rel_path", F.concat(F.lit("Videos/"), F.substring_index("video_id", "-", 1), F.lit("/"), F.col("video_id"), F.lit(".mp4"))
    )
    return manifest.join(wanted, "rel_path"), wanted.join(manifest, "rel_path", "left_anti").select("video_id")


def pending_videos(ids: DataFrame, ready: DataFrame) -> DataFrame:
    return ids.join(ready.select("video_id"), "video_id", "left_anti")


def uniform_frames(n: Column, total: Column) -> Column:
    """n frame numbers spread over 0..total-1, truncated; the first alone when n = 1."""
    step = (total - 1).cast("double") / F.nullif(n - 1, F.lit(0))
    last = n - 1
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda k: F.when((k == last) & (last > 0), (total - 1).cast("bigint")).otherwise(F.floor(k * F.coalesce(step, F.lit(0.0)))),
    )
    return F.when((n > 0) & (total > 0), each).otherwise(F.array().cast("array<bigint>"))


def sample_frames(
    videos: DataFrame, mode: str, fps: float = 1.0, n: int = 8, cap: int = 0, explode: bool = True
) -> DataFrame:
    """Frame numbers per video (columns frames, fps, optional end_time).

    rate: frame i is taken when i/src_fps reaches the next multiple of 1/fps; uniform: n frames over the whole length;
    every: each round(fps)-th frame, or `cap` uniform ones when that gives more than cap. `frame_time` is the second of
    each frame.
    """
    total, src = F.col("frames"), F.col("fps").cast("double")
    none = F.array().cast("array<bigint>")
    if mode == "rate":
        last = total - 1
        if "end_time" in videos.columns:
            stop = F.floor((F.col("end_time") + 1e-6) * src)
            last = F.least(last, F.coalesce(stop, last))
        rate = F.lit(float(fps))
        count = F.floor((last / src + 1e-6) * rate)
        picks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(0))), lambda k: F.greatest(F.ceil((k / rate - 1e-6) * src), F.lit(0)))
        picks = F.array_distinct(F.filter(picks, lambda f: f <= last))
        everything = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"))
        frames = F.when(total <= 0, none).when(rate >= src, everything).otherwise(picks)
        second = lambda f: f / src
    elif mode == "uniform":
        frames, second = uniform_frames(F.lit(n), total), lambda f: f / src
    elif mode == "every":
        k = F.greatest(F.bround(src, 0).cast("bigint"), F.lit(1))
        frames = F.when(total <= 0, none).otherwise(
            F.sequence(F.lit(0).cast("bigint"), F.greatest(total - 1, F.lit(0)).cast("bigint"), k)
        )
        second = lambda f: f / k.cast("double")
        if cap > 0:
            many = F.size(frames) > cap
            capped = uniform_frames(F.lit(cap), total)
            frames = F.when(many, capped).otherwise(frames)
            over = F.ceil(total / k) > cap
            second = lambda f: F.when(over, f / src).otherwise(f / k.cast("double"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if not explode:
        return videos.withColumn("frame_indices", frames)
    out = videos.withColumn("frame", F.explode(frames))
    return out.withColumn("frame_time", second(F.col("frame")))


def frame_timestamps(indices: Column, fps: Column) -> Column:
    """index / fps, the list padded with its last element to an even length."""
    padded = F.when(F.size(indices) % 2 != 0, F.array_append(indices, F.element_at(indices, -1))).otherwise(indices)
    return F.transform(padded, lambda i: i / fps)
