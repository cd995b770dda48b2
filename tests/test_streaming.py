"""Streams over many files and batches against their batch results."""

from __future__ import annotations

import os
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from tracelode.operators.conversations import delta_suppress
from tracelode.streaming import jobs

SENT = "conv_id long, turn long, rank long, symbol string"


def files_of(spark, tmp_path, parts, schema):
    """A folder with one parquet file for each part, in that order of time."""
    folder = tmp_path / "files"
    folder.mkdir()
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        target = folder / f"{n}.parquet"
        target.write_bytes(next((tmp_path / f"in{n}").glob("part-*.parquet")).read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


def read_files(session, folder, schema):
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_delta_state_over_three_files_is_the_batch_result(spark, tmp_path):
    draw = random.Random(3)
    # Turns grow from file to file; one conversation has most rows.
    parts = [
        [(draw.choice((1, 1, 1, 2, 3, None)), n * 10 + draw.randint(0, 9), draw.randint(1, 5), draw.choice(("a", "b", "é", "d" * 50, "")))
         for _ in range(150)] for n in range(3)
    ]
    session = jobs.state_session(spark)
    stream = read_files(session, files_of(spark, tmp_path, parts, SENT), SENT)
    got = jobs.run_available(spark, jobs.delta_state(stream, ttl="1 day"), "delta")
    batch = delta_suppress(spark.createDataFrame([r for part in parts for r in part if r[0] is not None], SENT))
    kept = lambda df: sorted(tuple(r) for r in df.where("conv_id IS NOT NULL").select("conv_id", "turn", "rank", "symbol", "kept").collect())
    assert kept(got) == kept(batch)


def test_delta_state_forgets_after_its_time(spark, tmp_path):
    parts = [[(1, 1, 2, "a")], [(1, 2, 2, "a")], [(1, 3, 2, "a")]]
    session = jobs.state_session(spark)
    stream = read_files(session, files_of(spark, tmp_path, parts, SENT), SENT)
    slow = jobs.delta_state(stream, ttl="1 second")
    found = []

    def write(batch, _):
        found.extend(batch.collect())
        time.sleep(2)

    jobs.run_batches(spark, slow, "forget", write)
    assert [r["kept"] for r in found] == [True, True, True]


def test_delta_state_calls_a_conversation_once_a_batch(spark):
    calls = []

    class Held:
        def __init__(self):
            self.values = {}

        def containsKey(self, key):
            return key in self.values

        def getValue(self, key):
            return self.values[key]

        def updateValue(self, key, value):
            calls.append(key)
            self.values[key] = value

    rows = spark.createDataFrame([(1, 5, 2, "a"), (1, 4, 3, "a"), (1, 4, 1, "b")], SENT).toPandas()
    job = jobs.SentSymbols(None)
    job._first = Held()
    out = list(job.handleInputRows((1, 0), iter([rows.iloc[:1], rows.iloc[1:]]), None))
    assert len(out) == 1 and sorted(out[0]["kept"].tolist()) == [False, True, True]
    assert sorted(calls) == [("a",), ("b",)] and job._first.values == {("a",): (4,), ("b",): (4,)}


def test_delta_state_asks_for_no_entry_on_its_own(spark, tmp_path):
    parts = [[(c, n, r + 2, f"s{(c + r) % 9}") for c in range(40) for r in range(6)] for n in range(2)]
    session = jobs.state_session(spark)
    stream = jobs.delta_state(read_files(session, files_of(spark, tmp_path, parts, SENT), SENT), ttl="1 day")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "FlatMapGroupsInPandasWithState" in plan
    got = jobs.run_available(spark, stream, "entries")
    wanted = sorted((c, n, r, s, n == 0) for n, part in enumerate(parts) for c, _, r, s in part)
    assert sorted(tuple(r) for r in got.collect()) == wanted
    stream = jobs.delta_state(read_files(session, str(tmp_path / "files"), SENT), parts=4)  # without expiry
    assert sorted(tuple(r) for r in jobs.run_available(spark, stream, "parts").collect()) == wanted


def test_stream_windows_of_no_rows(spark, tmp_path):
    session = jobs.state_session(spark)
    stream = read_files(session, files_of(spark, tmp_path, [[]], SENT), SENT)
    assert jobs.run_available(spark, jobs.delta_state(stream, ttl="1 day"), "none").count() == 0


def _rows(ids):
    return [(i, n, "x" * 40) for n, i in enumerate(ids)]


RECORDS = "id long, at long, body string"


def test_ingest_keeps_the_first_row_of_each_id(spark, tmp_path):
    draw = random.Random(5)
    store = str(tmp_path / "store")
    write = jobs.ingest_batch(store, "id", "at")
    wanted = {}
    for n in range(4):
        rows = [(draw.randint(0, 400), n * 1000 + draw.randint(0, 900), f"r{n}") for _ in range(200)]
        for i, at, _ in sorted(rows):
            if i not in wanted or (wanted[i] // 1000 == n and at < wanted[i]):
                wanted[i] = at
        batch = spark.createDataFrame(rows, RECORDS)
        write(batch, n)
        if n == 2:
            write(batch, n)  # run again after a failure
    got = [(r["id"], r["at"]) for r in spark.read.schema(RECORDS).parquet(store).collect()]
    assert len(got) == len(wanted) and dict(got) == wanted


def test_what_a_batch_reads_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    opened = []
    plain = jobs._held

    def held(spark, path, schema, buckets):
        if not path.endswith("_sketch"):
            opened.append(sum(f.stat().st_size for b in buckets for f in Path(path).glob(f"id_bucket={b}/*.parquet")))
        return plain(spark, path, schema, buckets)

    monkeypatch.setattr(jobs, "_held", held)
    sizes = []
    for history in (1_000, 30_000):
        store = str(tmp_path / f"store{history}")
        write = jobs.ingest_batch(store, "id", "at")
        write(spark.createDataFrame(_rows(range(history)), RECORDS), 0)
        total = sum(f.stat().st_size for f in Path(store).glob("id_bucket=*/*.parquet"))
        opened.clear()
        write(spark.createDataFrame(_rows(range(10**6, 10**6 + 300)), RECORDS), 1)  # new ids alone
        new = sum(opened)
        opened.clear()
        write(spark.createDataFrame(_rows([5, 5, 10**7]), RECORDS), 2)  # one that is there
        sizes.append((total, new, sum(opened)))
        assert spark.read.schema(RECORDS).parquet(store).count() == history + 301
    (small, new_small, hit_small), (large, new_large, hit_large) = sizes
    assert large > 2 * small
    # New ids open nothing, or a bucket that a false hit names; a repeat opens its one bucket of many.
    assert new_small <= 0.05 * small and new_large <= 0.05 * large
    assert 0 < hit_small <= 0.05 * small and 0 < hit_large <= 0.05 * large


def test_sketch_of_odd_ids(spark):
    ids = spark.createDataFrame([("",), ("é",), (None,), ("a" * 1000,)], "id string").withColumn("id_bucket", jobs._id_bucket("id"))
    sketch = jobs.id_sketch(ids.where("id IS NOT NULL"), "id")
    held = {r["id"] for r in jobs.maybe_held(ids, sketch, "id").collect()}
    assert {"", "é", "a" * 1000} <= held
    other = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("id")).withColumn("id_bucket", jobs._id_bucket("id"))
    assert jobs.maybe_held(other, sketch, "id").count() == 0
