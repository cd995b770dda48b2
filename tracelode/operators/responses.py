"""Response streams: chunk lines of a request folded to its answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.text import strip_empty_think
from tracelode.schemas import STREAM_CHUNK

BLOCK = 1024
DONE = "[DONE]"
PREVIEW, ERROR_TEXT = 500, 500


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """(request_id, seq, text, usage, error) of each well-formed data line; the end mark and broken
    JSON are left out. Input: (request_id, seq, line).

    A line is a part of a stream (`delta`) or a whole body (`message`). An error may be an object with a
    message, a plain text, or any other JSON value, which is given as it is written.
    """
    data = F.regexp_replace(F.trim("line"), r"^data:\s*", "")
    body = F.from_json(data, STREAM_CHUNK, {"mode": "PERMISSIVE"})
    rows = chunks.withColumn("data", data).where((F.col("data") != DONE) & (F.col("data") != ""))
    rows = rows.where(F.try_parse_json("data").isNotNull()).withColumn("body", body)
    return rows.select(
        "request_id",
        "seq",
        F.coalesce(
            F.get_json_object("data", "$.choices[0].delta.content"),
            F.get_json_object("data", "$.choices[0].message.content"),
            F.lit(""),
        ).alias("text"),
        F.col("body.usage").alias("usage"),
        F.coalesce(
            F.get_json_object("data", "$.error.message"), F.get_json_object("data", "$.error")
        ).alias("error"),
    )


def assemble_responses(chunks: DataFrame) -> DataFrame:
    """Answer, last usage, first error and preview per request.

    Texts are joined per block of chunks first, then per request, so the chunks of a long answer are
    not gathered row by row; the answer itself is one value by definition.
    """
    parsed = parse_chunks(chunks).withColumn("block", F.floor(F.col("seq") / BLOCK))

    def joined(order: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.struct(order, "text")))
        return F.array_join(F.transform(pieces, lambda piece: piece["text"]), "")

    used = F.when(F.col("usage").isNotNull(), F.col("seq"))
    failed = F.when(F.col("error").isNotNull(), F.col("seq"))
    blocks = parsed.groupBy("request_id", "block").agg(
        joined("seq").alias("text"),
        F.max(used).alias("used_at"),
        F.max_by("usage", used).alias("usage"),
        F.min(failed).alias("failed_at"),
        F.min_by("error", failed).alias("error"),
    )
    whole = blocks.groupBy("request_id").agg(
        joined("block").alias("text"),
        F.max_by("usage", "used_at").alias("usage"),
        F.min_by("error", "failed_at").alias("error"),
    )
    answer = strip_empty_think(F.col("text"))
    return whole.select(
        "request_id",
        answer.alias("answer"),
        F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.completion_tokens").alias("completion_tokens"),
        F.substring("error", 1, ERROR_TEXT).alias("error"),
        F.substring(answer, 1, PREVIEW).alias("preview"),
    )
