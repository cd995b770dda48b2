"""Questions from chunks of texts to buckets of codes, and the answers back.

Corpus-wide facts on millions of short codes (how often a word occurs, which document first has a window)
would need a row for every code. Here texts are packed into chunks; a chunk sends, for each bucket of the
code space, one packed row with its distinct codes; a bucket sees all rows that hold its codes and sends
one packed answer to each; a chunk reads its answers in its own order. Spark shuffles the rows. A code
that every text has is one entry for each chunk, a bucket holds about `_BUCKET_CODES` codes whatever the
corpus, and the number of rows never exceeds the number of codes.

The chunk table is written once, bucketed by chunk, to the shared folder: chunks are never shuffled again,
only the answers are.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import scratch_path, ship_package

CHUNK_BYTES = 1 << 22
_BUCKET_CODES = 1 << 20
_BYTES_PER_WORD = 6
NO_ID = np.iinfo(np.int64).max

_CHUNK_SCHEMA = "chunk_id long, n_bytes long, ids array<long>, lengths array<int>, data binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("chunk_id", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int32())), ("data", pa.binary()),
        ]
    )

    def emit(ids: list, texts: list) -> pa.RecordBatch:
        name = int.from_bytes(os.urandom(8), "little") >> 1
        data = b"".join(texts)
        columns = [[name], [len(data)], [ids], [[len(t) for t in texts]], [data]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(doc_id)
            texts.append(text or b"")
            held += len(texts[-1]) + 16
            if held >= CHUNK_BYTES:
                yield emit(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield emit(ids, texts)


def chunk_table(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    work: Callable[[Chunk], pa.RecordBatch] | None = None,
    schema: str = _CHUNK_SCHEMA,
) -> DataFrame:
    """Written table of chunks: chunk_id, n_bytes, ids, lengths, data (the texts end to end).

    `work` makes of a chunk what is written in its place; its `schema` has chunk_id, n_bytes and ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _packed(batches):
            yield batch if work is None else work(Chunk(batch.to_pylist()[0]))

    spark = docs.sparkSession
    ship_package(spark)
    name = f"text_chunks_{uuid.uuid4().hex}"
    packed = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (
        packed.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "chunks"))
        .bucketBy(buckets, "chunk_id").saveAsTable(name)
    )
    return spark.table(name)


def bucket_bits(chunks: DataFrame) -> int:
    """Bits of a code that name its bucket, from the size of the corpus."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4, int(total // (_BYTES_PER_WORD * _BUCKET_CODES)).bit_length())


class Chunk:
    """One row of the chunk table inside a task, with the answers it got so far. Texts are there if they were written."""

    def __init__(self, row: dict):
        self.chunk_id = row["chunk_id"]
        self.ids = [i for i in row["ids"]]
        self.texts, at = [], 0
        for length in row["lengths"] if "data" in row else ():
            self.texts.append(row["data"][at : at + length])
            at += length
        self.row = row

    def answers(self, name: str) -> bytes | list[bytes]:
        """Answers of one round, one for each bucket asked, by bucket."""
        listed = self.row[name] or []
        return [cell["answer"] for cell in sorted(listed, key=lambda cell: cell["bucket"])]

    def numbers(self) -> np.ndarray:
        """Document ids as numbers; a null id is larger than all others."""
        return np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)


def over_chunks(chunks: DataFrame, work: Callable[[Chunk], pa.RecordBatch], schema: str) -> DataFrame:
    """`work` on every chunk, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield work(Chunk(batch.slice(k, 1).to_pylist()[0]))

    return chunks.mapInArrow(run, schema)


def bucket_slices(sorted_codes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Buckets that sorted codes fall in, each with its slice."""
    owner = (sorted_codes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    edges = [0, *cuts.tolist(), len(owner)]
    return [(int(owner[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:]) if b > a]


ASK_SCHEMA = "bucket long, chunk_id long, codes binary, extra binary"


def asked(bits: int, chunk_id: int, sorted_codes: np.ndarray, pack: Callable[[slice], tuple[bytes, bytes]]) -> pa.RecordBatch:
    """Rows of ASK_SCHEMA: `pack` gives what goes to the bucket of a slice of the sorted codes."""
    rows = [(bucket, *pack(part)) for bucket, part in bucket_slices(sorted_codes, bits)]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "chunk_id": pa.array([chunk_id] * len(rows), pa.int64()),
            "codes": pa.array([r[1] for r in rows], pa.binary()),
            "extra": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def answered(
    asks: DataFrame,
    answer: Callable[[list[bytes], list[bytes]], list[bytes]],
    note: Callable[[list[bytes], list[bytes]], bytes] | None = None,
) -> DataFrame:
    """chunk_id, bucket, answer, note: `answer` sees all rows of a bucket and gives one reply to each.

    `note` is said once for a bucket, in its first row.
    """

    def reply(rows: pd.DataFrame) -> pd.DataFrame:
        codes, extra = rows["codes"].tolist(), rows["extra"].tolist()
        notes = [None] * len(rows)
        if note is not None:
            notes[0] = note(codes, extra)
        return pd.DataFrame(
            {"chunk_id": rows["chunk_id"], "bucket": rows["bucket"], "answer": answer(codes, extra), "note": notes}
        )

    return asks.groupBy("bucket").applyInPandas(reply, "chunk_id long, bucket long, answer binary, note binary")


def with_answers(chunks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Chunks with the replies they got (a chunk's replies are bounded by its size). Chunks stay in place."""
    gathered = replies.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return chunks.join(gathered.hint("shuffle_hash"), "chunk_id", "left")
