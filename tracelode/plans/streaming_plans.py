"""Streaming queries run to the end of the data there is, compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.operators.sessions import clean_requests
from tracelode.plans.registry import query
from tracelode.session import scratch_path
from tracelode.streaming import jobs

WITH = "WITH " + views.REQUESTS_SQL


def _events(session, sf_dir):
    return jobs.stream_table(session, f"{sf_dir}/events.parquet")


def _requests(session, sf_dir):
    return clean_requests(views.raw_requests_from(_events(session, sf_dir)))


@query("stream_requests", f"{WITH} SELECT request_id, intent, status, prompt_tokens, total_ms FROM requests")
def _stream_requests(spark, sf_dir):
    session = jobs.local_session(spark)
    lines = views.raw_requests_from(_events(session, sf_dir))
    path = scratch_path(spark, "log-lines")
    text = lines.select(F.to_json(F.struct(*lines.columns)).alias("value"))
    jobs.run_batches(spark, text, "write-lines", lambda batch, _: batch.write.mode("append").text(path))
    parsed = jobs.stream_requests(session, path)
    rows = parsed.where("_corrupt is null").select(
        "request_id", F.coalesce("intent", F.lit("DEFAULT")).alias("intent"), "status",
        F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("timing.total_ms").alias("total_ms"),
    )
    return jobs.run_available(spark, rows, "requests")


@query(
    "stream_ingest",
    """SELECT user_id AS session_id, min(event_id) AS event_id FROM events GROUP BY 1""",
)
def _stream_ingest(spark, sf_dir):
    session = jobs.local_session(spark)
    store = scratch_path(spark, "store")
    rows = _events(session, sf_dir).select(F.col("user_id").alias("session_id"), "event_id")
    jobs.run_batches(spark, rows, "ingest", jobs.ingest_batch(store, "session_id", "event_id"))
    return spark.read.schema("session_id long, event_id long").parquet(store).select("session_id", "event_id")


@query("stream_once_per_id", "SELECT count(*) AS n, count(DISTINCT user_id) AS ids FROM (SELECT DISTINCT user_id FROM events)")
def _stream_once(spark, sf_dir):
    session = jobs.local_session(spark)
    rows = _events(session, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = jobs.run_available(spark, jobs.once_per_id(rows, "user_id", "ts", "3650 days"), "once")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("ids"))


@query(
    "stream_delta_state",
    f"""WITH {views.SENT_SQL}, once AS (SELECT conv_id, turn, symbol, min(rank) AS rank FROM sent GROUP BY 1, 2, 3)
    SELECT conv_id, turn, rank, symbol, rank = 1 OR turn = min(turn) OVER (PARTITION BY conv_id, symbol) AS kept FROM once""",
)
def _stream_delta(spark, sf_dir):
    session = jobs.state_session(spark)
    k = F.get_json_object("props", "$.k").cast("bigint")
    sent = _events(session, sf_dir).select(
        F.col("user_id").alias("conv_id"),
        F.dayofyear("ts").cast("bigint").alias("turn"),
        (F.col("event_id") % 5 + 1).alias("rank"),
        F.concat(F.lit("s"), (k % 20).cast("string")).alias("symbol"),
    )
    return jobs.run_available(spark, jobs.delta_state(sent, ttl="30 days"), "delta")


@query(
    "stream_responses",
    """WITH last AS (SELECT conv_id, max(turn) AS l FROM conversations GROUP BY 1)
    SELECT c.conv_id AS request_id, md5(string_agg(text, '' ORDER BY turn)) AS answer, count(*) AS chunks, true AS finished
    FROM conversations c GROUP BY 1""",
)
def _stream_responses(spark, sf_dir):
    session = jobs.local_session(spark)
    rows = jobs.stream_table(session, f"{sf_dir}/conversations.parquet")
    stamp = F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 100 + F.col("turn"))
    turns = session.read.parquet(f"{sf_dir}/conversations.parquet")
    ended = rows.join(turns.groupBy("conv_id").agg(F.max("turn").alias("end")), "conv_id")
    part = F.struct(F.col("turn").alias("seq"), F.col("text").alias("text"))
    mark = F.struct((F.col("turn") + 1).alias("seq"), F.lit("[DONE]").alias("text"))
    both = F.when(F.col("turn") == F.col("end"), F.array(mark, part)).otherwise(F.array(part))
    chunks = ended.select(F.col("conv_id").alias("request_id"), stamp.alias("ts"), F.inline(both))
    folded = jobs.run_available(spark, jobs.response_state(chunks), "responses")
    return folded.select("request_id", F.md5("answer").alias("answer"), "chunks", "finished")


@query(
    "stream_latest_by_text",
    f"""{WITH} SELECT last_user_message AS probe_id, arg_max(request_id, (ts, request_id)) AS request_id FROM requests
    GROUP BY 1""",
)
def _stream_latest(spark, sf_dir):
    session = jobs.local_session(spark)
    events = views.table(session, sf_dir, "events")
    probes = events.select(F.concat_ws(" ", "event_type", "props").alias("text")).distinct()
    probes = probes.withColumn("probe_id", F.col("text"))
    latest = jobs.latest_by_text(_requests(session, sf_dir), probes)
    path = scratch_path(spark, "latest")
    jobs.run_batches(
        spark, latest, "latest-state", lambda batch, _: batch.write.mode("overwrite").parquet(path), "complete"
    )
    return spark.read.schema(latest.schema).parquet(path).select("probe_id", "request_id")


@query(
    "stream_intent_windows",
    f"""{WITH}, w AS (SELECT date_trunc('hour', ts) AS h, intent, count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors,
      round(sum(total_ms), 6) AS total_ms FROM requests GROUP BY 1, 2)
    SELECT strftime(h, '%Y-%m-%d %H') AS start, intent, requests, errors, total_ms FROM w
    WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _stream_windows(spark, sf_dir):
    session = jobs.local_session(spark)
    windows = jobs.run_available(spark, jobs.intent_windows(_requests(session, sf_dir)), "windows")
    return windows.select(
        F.date_format("start", "yyyy-MM-dd HH").alias("start"), "intent", "requests", "errors",
        F.round("total_ms", 6).alias("total_ms"),
    )
