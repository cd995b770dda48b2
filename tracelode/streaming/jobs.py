"""Streaming versions: log ingest, delta suppression, responses and live metrics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelode.functions.text import strip_empty_think
from tracelode.operators.records import first_per_id
from tracelode.operators.responses import DONE, PREVIEW
from tracelode.session import scratch_path, ship_package
from tracelode.sources.logs import parse_lines


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as they are appended; the checkpoint remembers how far it has read."""
    return parse_lines(spark.readStream.text(path))


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream. The schema comes from the files' footers."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def once_per_id(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First row of each id; repeats later than `delay` behind the newest time may pass again."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


ID_BUCKETS = 64
_SKETCH_CELLS, _SKETCH_HASHES = 16, 3
_SKETCH_SCHEMA = "cell int, bits binary, id_bucket int"
_CELL_BITS = 1 << 15


def _id_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int")


def _places(ids: DataFrame, key: str) -> DataFrame:
    """Where each id of (key, id_bucket) sets its bits: a cell of its bucket's sketch and a bit of the cell."""
    hashed = ids.select(key, "id_bucket", F.explode(F.array(*(F.xxhash64(F.lit(n), F.col(key)) for n in range(_SKETCH_HASHES)))).alias("h"))
    cell = F.pmod(F.col("h"), F.lit(_SKETCH_CELLS)).cast("int")
    bit = F.pmod(F.shiftrightunsigned("h", 32), F.lit(_CELL_BITS))
    return hashed.select(key, "id_bucket", cell.alias("cell"), bit.alias("bit"))


def id_sketch(ids: DataFrame, key: str) -> DataFrame:
    """Bloom sketch of ids as bitmaps: id_bucket, cell, bits."""
    return _places(ids, key).groupBy("id_bucket", "cell").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_held(ids: DataFrame, sketch: DataFrame, key: str) -> DataFrame:
    """Ids (key, id_bucket) all of whose bits are set; ids that were never added are seldom among them."""
    asked = _places(ids, key)
    cells = sketch.groupBy("id_bucket", "cell").agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1
    seen = asked.join(cells, ["id_bucket", "cell"], "left").select(key, "id_bucket", F.coalesce(is_set, F.lit(False)).alias("is_set"))
    return seen.groupBy(key, "id_bucket").agg(F.min("is_set").alias("is_set")).filter("is_set").drop("is_set")


def _held(spark: SparkSession, path: str, schema: str, buckets: list[int]) -> DataFrame:
    """Rows of a store's buckets; others are not opened."""
    return spark.read.schema(schema).parquet(path).filter(F.col("id_bucket").isin(buckets))


def ingest_batch(store_path: str, key: str, order: str):
    """foreachBatch function that appends ids the store does not hold yet, for any lateness.

    The store has a folder for each bucket of ids (by hash) and, beside them, a Bloom sketch for each bucket. A
    batch reads the sketches of its own buckets; only buckets where one of its ids may be are opened, and of these
    only the ids. So what a batch reads follows the batch and its repeats, not the history.

    Sketches are written before rows: a batch that breaks off in between leaves bits without rows, which cost a
    look and no more. A batch that is run again finds its own rows in the store and adds nothing.
    """
    sketch_path = f"{store_path}/_sketch"

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        fresh = first_per_id(batch, key, order).withColumn("id_bucket", _id_bucket(key)).persist()
        try:
            own = [row["id_bucket"] for row in fresh.select("id_bucket").distinct().collect()]  # ID_BUCKETS at most
            buckets = []
            try:
                maybe = maybe_held(fresh.select(key, "id_bucket"), _held(spark, sketch_path, _SKETCH_SCHEMA, own), key)
                buckets = [row["id_bucket"] for row in maybe.select("id_bucket").distinct().collect()]
            except AnalysisException:  # no store before the first batch
                pass
            new = fresh
            if buckets:
                new = fresh.join(_held(spark, store_path, f"`{key}` {kind}, id_bucket int", buckets), ["id_bucket", key], "left_anti")
            # One file a bucket and batch.
            new = new.select(*batch.columns, "id_bucket").repartition("id_bucket").persist()
            id_sketch(new, key).write.mode("append").partitionBy("id_bucket").parquet(sketch_path)
            new.write.mode("append").partitionBy("id_bucket").parquet(store_path)
            new.unpersist()
        finally:
            fresh.unpersist()

    return write


def _deadline(last: pd.Timestamp, idle_ms: int, state: GroupState) -> int:
    """Event time in ms at which a key is given up; it must lie past the watermark."""
    return max(int(last.timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1)


SENT_OUT = "conv_id long, turn long, rank long, symbol string, kept boolean"


_SENT_STATE = "symbol array<string>, turn array<long>, used_at array<long>"


class HeldSymbols:
    """A key's state for one batch: first turn of each symbol. Entries not offered for `ttl_ms` are gone."""

    def __init__(self, columns: tuple | None, now: int, ttl_ms: int | None):
        self._now = now
        rows = zip(*columns) if columns else ()
        self._held = {symbol: (turn, at) for symbol, turn, at in rows if ttl_ms is None or at + ttl_ms > now}

    def containsKey(self, key: tuple[str]) -> bool:
        return key[0] in self._held

    def getValue(self, key: tuple[str]) -> tuple[int]:
        return self._held[key[0]][:1]

    def updateValue(self, key: tuple[str], value: tuple[int]) -> None:
        self._held[key[0]] = (value[0], self._now)

    def columns(self) -> tuple[list, list, list]:
        return list(self._held), [turn for turn, _ in self._held.values()], [at for _, at in self._held.values()]


class SentSymbols:
    """Marks what a conversation is offered in a batch, by the turn in which each symbol was first offered.

    An entry's time starts again whenever the symbol is offered, so the state holds the symbols offered within
    `ttl_ms` and no others. Plain values: a key has few rows, and a table for each step costs more than the rows.
    """

    def __init__(self, ttl_ms: int | None, columns: tuple | None = None, now: int = 0):
        self._first = HeldSymbols(columns, now, ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        offered: dict[tuple[int, str], int | None] = {}
        for part in rows:
            for turn, symbol, rank in zip(part["turn"].tolist(), part["symbol"].tolist(), part["rank"].tolist()):
                if turn is None or turn != turn:
                    continue
                place, rank = (int(turn), symbol), None if rank is None or rank != rank else int(rank)
                known = offered.get(place)
                offered[place] = known if rank is None else rank if known is None else min(known, rank)
        if not offered:
            return
        first: dict[str, int] = {}
        for turn, symbol in offered:
            first[symbol] = min(turn, first.get(symbol, turn))
        for symbol, turn in first.items():
            if self._first.containsKey((symbol,)):
                first[symbol] = min(turn, self._first.getValue((symbol,))[0])
            self._first.updateValue((symbol,), (first[symbol],))
        marked = [(key[0], t, rank, s, rank == 1 or t == first[s]) for (t, s), rank in offered.items()]
        yield pd.DataFrame(marked, columns=["conv_id", "turn", "rank", "symbol", "kept"])


def delta_state(sent: DataFrame, ttl: str | None = None, parts: int = 1) -> DataFrame:
    """Mark symbols already sent in their conversation, over a stream of (conv_id, turn, rank, symbol).

    A key's rows are read as they come and a key is called once a batch. A key has its cost, so a conversation is
    one; where conversations are very long, `parts` deals a conversation's symbols to as many keys and tasks. State is a list of symbols with their first turns, and travels with the key's
    rows: no entry is asked for on its own. With `ttl` (processing time) an entry goes when its symbol was not
    offered for that long, and the symbol is sent again afterwards. For the session see `state_session`.
    """
    ship_package(sent.sparkSession)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job = SentSymbols(ttl_ms, state.get if state.exists else None, state.getCurrentProcessingTimeMs() if ttl_ms else 0)
        yield from job.handleInputRows(key, batches, None)
        state.update(job._first.columns())
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    part = F.pmod(F.xxhash64("symbol"), F.lit(parts)).cast("int")
    keyed = sent.select("conv_id", part.alias("part"), "turn", "rank", "symbol").where(F.col("symbol").isNotNull())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return keyed.groupBy("conv_id", "part").applyInPandasWithState(fold, SENT_OUT, _SENT_STATE, "append", timeout)


RESPONSE_OUT = (
    "request_id long, answer string, chunks long, first_ts timestamp, finished boolean, prompt_tokens long,"
    " completion_tokens long, error string"
)
_PIECE = "struct<seq: long, text: string>"
_RESPONSE_STATE = (
    f"told boolean, joined string, next long, pieces array<{_PIECE}>, last long, first_ts string, used_at long,"
    " prompt_tokens long, completion_tokens long, failed_at long, error string"
)


def response_state(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Answers from a stream of (request_id, seq, text, ts), seq from 0 on; text `[DONE]` ends a request.

    Columns prompt_tokens, completion_tokens and error may be there too: the last usage and the first
    error by seq are given out. Chunks may come in any order and any number of batches, and repeat. An
    answer is given out once all chunks before its end mark are there; if that does not happen, unfinished
    with what there is, once the newest event time is `idle` past its newest chunk. What arrives for an
    answer already given out, within `idle`, is ignored. Event time, so that a rerun decides the same.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    for name, kind in (("prompt_tokens", "long"), ("completion_tokens", "long"), ("error", "string")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))

    def given(key: tuple[Any, ...], held: dict, finished: bool) -> pd.DataFrame:
        rest = sorted(held["pieces"].items())
        row = {
            "request_id": key[0], "answer": held["joined"] + "".join(text for _, text in rest),
            "chunks": held["next"] + len(rest), "first_ts": pd.Timestamp(held["first_ts"]), "finished": finished,
            "prompt_tokens": held["prompt_tokens"], "completion_tokens": held["completion_tokens"], "error": held["error"],
        }
        return pd.DataFrame([row]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64", "error": object})

    def take(held: dict, row: Any) -> None:
        if row.text == DONE:
            held["last"] = row.seq if held["last"] is None else max(held["last"], row.seq)
        elif row.seq >= held["next"]:
            held["pieces"][int(row.seq)] = row.text
        if pd.notna(row.prompt_tokens) and (held["used_at"] is None or row.seq >= held["used_at"]):
            held["used_at"], held["prompt_tokens"] = int(row.seq), int(row.prompt_tokens)
            held["completion_tokens"] = int(row.completion_tokens) if pd.notna(row.completion_tokens) else None
        if row.error is not None and pd.notna(row.error) and (held["failed_at"] is None or row.seq < held["failed_at"]):
            held["failed_at"], held["error"] = int(row.seq), row.error

    names = [part.split()[0] for part in _RESPONSE_STATE.replace("seq: long, ", "").split(",")]

    def fold(
        key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.exists:
            held = dict(zip(names, state.get))
            held["pieces"] = {int(seq): text for seq, text in held["pieces"]}
        else:
            held = dict.fromkeys(names) | {"told": False, "joined": "", "next": 0, "pieces": {}}
        if state.hasTimedOut:
            state.remove()
            if not held["told"]:
                yield given(key, held, False)
            return
        newest = None
        for rows in batches:
            late = rows["ts"].max()
            newest = late if newest is None else max(newest, late)
            early = rows["ts"].min().isoformat()
            held["first_ts"] = min(held["first_ts"] or early, early)
            if not held["told"]:
                for row in rows.itertuples(index=False):
                    take(held, row)
        # Chunks that follow on from what is joined already leave the list.
        joined = []
        while held["next"] in held["pieces"]:
            joined.append(held["pieces"].pop(held["next"]))
            held["next"] += 1
        held["joined"] += "".join(joined)
        if not held["told"] and held["last"] is not None and held["next"] >= held["last"]:
            yield given(key, held, True)
            held |= {"told": True, "joined": "", "pieces": {}}
        held["last"] = None if held["last"] is None else int(held["last"])
        state.update(tuple(list(held["pieces"].items()) if n == "pieces" else held[n] for n in names))
        state.setTimeoutTimestamp(_deadline(newest, idle_ms, state))

    wanted = ["request_id", "seq", "text", "ts", "prompt_tokens", "completion_tokens", "error"]
    answers = chunks.select(*wanted).withWatermark("ts", idle).groupBy("request_id").applyInPandasWithState(
        fold, RESPONSE_OUT, _RESPONSE_STATE, "append", GroupStateTimeout.EventTimeTimeout,
    )
    answer = strip_empty_think(F.col("answer"))
    return answers.withColumn("answer", answer).withColumn("preview", F.substring(answer, 1, PREVIEW))


def latest_by_text(requests: DataFrame, probes: DataFrame) -> DataFrame:
    """Newest request per probe text. Input: requests(request_id, ts, last_user_message),
    probes(probe_id, text). Output changes as requests arrive: use update or complete mode."""
    hits = requests.join(probes, requests["last_user_message"] == probes["text"])
    return hits.groupBy("probe_id").agg(
        F.max_by("request_id", F.struct("ts", "request_id")).alias("request_id"), F.max("ts").alias("ts")
    )


def intent_windows(requests: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests, errors and latency per intent and time window; late rows beyond `delay` are dropped."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "intent")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status") != "ok").alias("errors"),
            F.sum("total_ms").alias("total_ms"),
        )
        .select(F.col("window.start").alias("start"), "intent", "requests", "errors", "total_ms")
    )


def local_session(spark: SparkSession) -> SparkSession:
    """Session to start a stream in: in local mode one with as many state partitions as cores."""
    if not spark.sparkContext.master.startswith("local"):
        return spark
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """Session to start a stream in that keeps entries with expiry: its state store is RocksDB, off the JVM's heap."""
    own = local_session(spark)
    own = spark.newSession() if own is spark else own
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Time alone ends nothing here (an expired entry counts as gone when it is read), so batches without rows are idle.
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def _finish(started) -> None:
    """Wait for a run over the data there is; a query that fails raises here."""
    started.awaitTermination()


def run_available(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all data there is now and give back what it appended."""
    path = scratch_path(spark, label)
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    _finish(started)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(spark: SparkSession, stream: DataFrame, label: str, write, mode: str = "append") -> None:
    """Run a stream over all data there is now, each batch given to `write`."""
    path = scratch_path(spark, label)
    started = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    _finish(started)
