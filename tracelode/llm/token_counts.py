"""Token counts from flat token files by a separator scan.

A token file is a run of fixed-width little-endian token ids in which an end-of-document id closes each
document; it has no index. `write_token_files` makes such files from documents and keeps them as rows of
byte blocks (a file is its blocks end to end, blocks end anywhere, also inside a document); blocks of flat
files on storage come from `flat_file_blocks`. `count_tokens` searches every block for separators with one
vectorised comparison and sends a few numbers for the block; a prefix scan over the blocks of a file tells
how many documents and tokens lie before each block; the document that a separator closes then has the
tokens of its block before it and those carried over. Blocks of a file are summed in groups first, so a
file that holds a third of all tokens is not one task's work.

Null text: no tokens. Null doc_id: a document like any other. Rows that repeat have a count each. Texts
that spell a special token are ordinary text. Empty table: no files, no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.session import cut_lineage, ship_package

BLOCK_BYTES = 1 << 20
_GROUP = 4096
#: What splits a text before merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FILE_SCHEMA = "file_id long, block long, data binary, ids array<long>"

_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    """The tokenizer of a rank file, built once a worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def write_token_files(docs: DataFrame, rank_file: str, end: int, width: int = 2) -> DataFrame:
    """Files of `width`-byte ids: rows (file_id, block, data) and, with null data, (file_id, block, ids).

    The latter are the doc_ids in file order, in parts that count on from `block`. One file a task.
    """
    ship_package(docs.sparkSession)
    with open(rank_file, "rb") as source:
        ranks = source.read()
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        file_id = int.from_bytes(os.urandom(8), "little") >> 1
        held, size, block, ids, listed = [], 0, 0, [], 0

        def row(number: int, data: bytes | None, names: list | None) -> pa.RecordBatch:
            columns = [([file_id], pa.int64()), ([number], pa.int64()), ([data], pa.binary()), ([names], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["file_id", "block", "data", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*encoder.encode_ordinary(text.as_py() or ""), end], dtype=kind).tobytes()
                held.append(tokens)
                size += len(tokens)
                ids.append(doc_id)
                if size >= BLOCK_BYTES:
                    joined = b"".join(held)
                    while len(joined) >= BLOCK_BYTES:
                        yield row(block, joined[:BLOCK_BYTES], None)
                        joined, block = joined[BLOCK_BYTES:], block + 1
                    held, size = [joined], len(joined)
                    yield row(listed, None, ids)
                    ids, listed = [], listed + len(ids)
        if size:
            yield row(block, b"".join(held), None)
        if ids:
            yield row(listed, None, ids)

    return cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FILE_SCHEMA))


def flat_file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file_id (path), block, data: blocks of flat token files of up to 2 GB each."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    count = F.ceil(F.col("length") / BLOCK_BYTES).cast("int")
    cut = files.select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    data = F.substring("content", F.col("k") * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES))
    return cut.select(F.col("path").alias("file_id"), F.col("k").cast("long").alias("block"), data.alias("data"))


def _before(value: Column, keys: list[str], order: str) -> Column:
    """Sum of `value` over the earlier rows of the keys."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _last_before(value: Column, keys: list[str], order: str) -> Column:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(value).over(window)


def scan_blocks(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """file_id, block, n_tokens, ends: places of the separators in the block (a list bounded by the block)."""
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
    schema = blocks.select("file_id", "block").schema.add("n_tokens", "long").add("ends", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_py(), dtype=kind)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == end))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "block", "n_tokens", "ends"])

    return blocks.select("file_id", "block", "data").mapInArrow(run, schema)


def count_tokens(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """file_id, ordinal (from 0), n_tokens without the separator: a row for each document of each file.

    A document without a separator at the end of a file counts if it has tokens.
    """
    scanned = cut_lineage(scan_blocks(blocks, end, width)).withColumn("part", F.floor(F.col("block") / _GROUP))
    # Places in the file are block starts plus places in the block; block starts need sums of n_tokens.
    sums = scanned.groupBy("file_id", "part").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("ends")).alias("docs"))
    sums = sums.select(
        "file_id", "part", _before(F.col("tokens"), ["file_id"], "part").alias("part_start"), _before(F.col("docs"), ["file_id"], "part").alias("part_docs")
    )
    placed = scanned.join(sums, ["file_id", "part"]).select(
        "file_id", "part", "block", "n_tokens", "ends",
        (F.col("part_start") + _before(F.col("n_tokens"), ["file_id", "part"], "block")).alias("start"),
        (F.col("part_docs") + _before(F.size("ends"), ["file_id", "part"], "block")).alias("docs"),
    )
    placed = cut_lineage(placed.withColumn("last", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1))))
    lasts = placed.groupBy("file_id", "part").agg(F.max("last").alias("last"), F.max(F.col("start") + F.col("n_tokens")).alias("stop"), F.sum(F.size("ends")).alias("n"))
    carried = lasts.select("file_id", "part", _last_before(F.col("last"), ["file_id"], "part").alias("carried"))
    whole = placed.join(carried, ["file_id", "part"]).withColumn(
        "open", F.coalesce(F.greatest(F.col("carried"), _last_before(F.col("last"), ["file_id", "part"], "block")), F.lit(-1))
    )
    absolute = F.transform("ends", lambda e: F.col("start") + e)
    counts = F.transform(
        F.col("places"), lambda at, k: at - F.when(k == 0, F.col("open")).otherwise(F.get(F.col("places"), k - 1)) - 1
    )
    closed = (
        whole.filter(F.size("ends") > 0).withColumn("places", absolute)
        .select("file_id", "docs", F.posexplode(counts).alias("k", "n_tokens"))
        .select("file_id", (F.col("docs") + F.col("k")).cast("long").alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"))
    )
    rest = lasts.groupBy("file_id").agg(F.sum("n").alias("n"), F.max("stop").alias("stop"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    left = rest.select("file_id", F.col("n").cast("long").alias("ordinal"), (F.col("stop") - F.col("last") - 1).cast("long").alias("n_tokens"))
    return closed.unionByName(left.filter("n_tokens > 0"))


def document_tokens(docs: DataFrame, rank_file: str, end: int) -> DataFrame:
    """doc_id, file_id, ordinal, n_tokens: documents written to token files, and counted from those alone."""
    files = write_token_files(docs, rank_file, end)
    counts = count_tokens(files.filter("data IS NOT NULL").select("file_id", "block", "data"), end)
    names = files.filter("ids IS NOT NULL").select("file_id", "block", F.posexplode("ids").alias("k", "doc_id"))
    names = names.select("file_id", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file_id", "ordinal"]).select("doc_id", "file_id", "ordinal", "n_tokens")
