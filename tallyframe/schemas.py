"""Declared record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


GOLD_POINT = _struct(time_sec=D, normalized_projected_pixel=T.ArrayType(D), reference_source=S)

ANSWER_META = _struct(
    sampled_last_visible_time_sec=D,
    last_placement_time_sec=D,
    normalized_projected_pixel=T.ArrayType(D),
    acceptable_answer_metadata=T.ArrayType(GOLD_POINT),
    object_y_name=S,
    object_y_normalized_projected_pixel=T.ArrayType(D),
    raw_correct_fixture=S,
    correct_fixture=S,
    raw_choice_pool=T.ArrayType(S),
    raw_expanded_choice_pool=T.ArrayType(S),
    fixture_choice_pool=T.ArrayType(S),
    expanded_choice_pool=T.ArrayType(S),
)

STEP = _struct(
    step=S,
    branch_group=S,
    step_question_class=S,
    question=S,
    choices=T.ArrayType(S),
    correct_idx=I,
    target_text=S,
    answer=S,
    acceptable_answers=T.ArrayType(S),
    acceptable_idxs=T.ArrayType(I),
    acceptable_answer_idxs=T.ArrayType(I),
    skipped=B,
    answer_metadata=ANSWER_META,
)

QUESTION = _struct(
    doc_id=S,
    trajectory_id=S,
    id=S,
    mode=S,
    video_id=S,
    source_video_id=S,
    video_path=S,
    query_time_sec=D,
    query_time_in_clip_sec=D,
    clip_start_time_sec=D,
    clip_end_time_sec=D,
    clip_duration_sec=D,
    horizon_sec=D,
    question=S,
    question_class=S,
    step_question_class=S,
    choices=T.ArrayType(S),
    correct_idx=I,
    target_text=S,
    answer=S,
    acceptable_answers=T.ArrayType(S),
    acceptable_answer_idxs=T.ArrayType(I),
    object_a_assoc_id=S,
    object_a_name=S,
    target_reference_image_path=S,
    target_reference_steps=T.ArrayType(S),
    target_reference_metadata=T.MapType(S, S),
    generation_info=T.MapType(S, S),
    bev_image_path=S,
    kitchen_bev_image_path=S,
    answer_metadata=ANSWER_META,
    steps=T.ArrayType(STEP),
    _corrupt_record=S,
)

AUDIT = _struct(
    cache_key=S,
    request_type=S,
    task_name=S,
    doc_id=S,
    idx=I,
    gen_kwargs=S,
    response=S,
    created_at=D,
    deterministic=B,
    task_fingerprint=S,
    content_hash=S,
    model_fingerprint_hash=S,
)

LIVE = _struct(
    sequence=L,
    task_name=S,
    doc_id=S,
    prediction=S,
    metrics=_struct(oos_score=_struct(question_class=S, accuracy=D, parsed=B)),
)

CALIBRATION = _struct(
    cameras=T.StructType(
        [
            T.StructField(
                "camera-rgb",
                _struct(image_size=T.ArrayType(I), projection_params=T.ArrayType(D), valid_radius=D),
            )
        ]
    )
)

ROUND = _struct(
    round_idx=I,
    round_input=S,
    model_output=S,
    terminal=B,
    tool_result=S,
    tool_calls=D,
    valid_tool_calls=D,
    invalid_steps=D,
    next_input=S,
)

TRACE = _struct(
    success=B,
    error=S,
    tool_calls=D,
    valid_tool_calls=D,
    invalid_steps=D,
    trace=T.ArrayType(S),
    agentic_rounds=T.ArrayType(ROUND),
)
