"""Explicit table schemas. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


REQUEST_LOG = _struct(
    timestamp=S,
    request_id=S,
    conversation_key=S,
    model=S,
    backend_model=S,
    stream=B,
    n_messages=L,
    last_user_message=S,
    context=_struct(
        status=S,
        symbols_selected=L,
        symbols_new=L,
        symbols_suppressed=L,
        estimated_tokens=L,
        max_tokens=L,
        primary_symbol=S,
    ),
    intent=S,
    usage=_struct(prompt_tokens=L, completion_tokens=L),
    timing=_struct(
        total_ms=D, ttft_ms=D, pipeline_ms=D, provider_wait_ms=D, stages=T.MapType(S, D)
    ),
    history=_struct(cap_enabled=B, cap_applied=B, budget=L, dropped_count=L, tokens_after=L),
    status=S,
    error=S,
    answer_preview=S,
)

TOOL_CALL = _struct(id=S, function=_struct(name=S, arguments=S))

CONTENT_PART = _struct(type=S, text=S)

MESSAGES = _struct(
    conv_id=L,
    turn=L,
    role=S,
    content=S,
    content_parts=T.ArrayType(CONTENT_PART),
    name=S,
    reasoning_content=S,
    tool_calls=T.ArrayType(TOOL_CALL),
    tool_call_id=S,
)

SESSION_RECORD = _struct(
    session_id=S,
    workflow_name=S,
    request_summary=S,
    transaction_id=S,
    execution_report=S,
    verification_report=S,
    evaluation_report=S,
    controller_decision=S,
    completed_at=S,
    metadata=T.MapType(S, S),
)

STREAM_CHUNK = _struct(
    id=S,
    choices=T.ArrayType(_struct(index=L, delta=_struct(content=S, role=S), finish_reason=S)),
    usage=_struct(prompt_tokens=L, completion_tokens=L),
    error=_struct(message=S),
)
