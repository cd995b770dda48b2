"""Language of whole texts by cross-parsing: the language whose sample explains a text in the fewest phrases wins.

1. Sample. Of labelled training documents, `rows` for each language (by hash) are cut into stretches of
   `STRETCH` letters, and `passages` of the distinct ones (by hash) are the language's sample. That is the one
   bound on what is learned; over many languages it is shared (`total`), so the model's size is bounded.
2. Automaton. A task for each language builds the suffix automaton of its sample: every path from its root is a
   substring of the sample.
3. Parsing. A text is read from left to right; a phrase is the longest match that starts where the last phrase
   ended. Phrases come from the automaton alone: a step without a transition ends a phrase, and a letter that
   the sample lacks is a phrase of its own. All stretches of many texts advance together, as numpy arrays, over
   one language's transition table at a time. Whole texts are parsed, in stretches of `STRETCH` bytes.
4. Verdict. A phrase costs log2 of the sample's size in bits. The fewest bits win (ties: the smallest name), and
   the score is the share of the winner when a bit halves the odds, 0 to 1.

Texts are read as lower-cased letters with their marks, all else between them as one space, so neither digits
nor markup decide. Documents whose crc32(doc_id as text) is divisible by five are held out.

Null text, or none of letters: `und` with score 0; the same if no labelled text is there to learn from. Null
lang: not learned from. Null doc_id: an empty text in the crc, so held out. Repeated rows are predicted each, and
a passage that repeats is learned once. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.columns import fresh_name
from tracelode.session import cut_lineage, ship_package

STRETCH = 512
UNKNOWN = "und"
_PIECE_BYTES = 1 << 22
_MODEL_SCHEMA = "lang string, size long, edges binary, next binary"
PREDICTION_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def letters(text: Column) -> Column:
    """Lower-cased letters and their marks, one space for all else; null if there is no letter."""
    kept = F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")))
    return F.when(text.rlike(r"\p{L}"), kept)


def held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


def sample_passages(docs: DataFrame, rows: int, passages: int, total: int) -> DataFrame:
    """lang and passage: distinct stretches of labelled training documents, at most `passages` a language."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("lang", F.xxhash64("doc_id").alias("place"), "text")
    by_place = Window.partitionBy("lang").orderBy("place")
    first = known.filter("text IS NOT NULL").select("lang", "place").withColumn("rank", F.row_number().over(by_place))
    limits = first.filter(F.col("rank") <= rows).groupBy("lang").agg(F.max("place").alias("limit"))
    # One row a language, of known size: the planner sends it to the documents where it is small.
    limits = cut_lineage(limits)
    most = max(1, min(passages, total // max(limits.count(), 1)))
    chosen = known.join(limits, "lang").filter(F.col("place") <= F.col("limit"))
    cut = F.regexp_extract_all(letters(F.col("text")), F.lit(f".{{1,{STRETCH}}}"), F.lit(0))
    found = chosen.select("lang", F.explode(cut).alias("passage")).dropDuplicates(["lang", "passage"])
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("passage"), "passage")
    return found.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= most).select("lang", "passage")


def suffix_automaton(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Edges (state * 256 + byte, ascending) and the states they lead to; the root is 0."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in data:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in edges[at]:
            edges[at][byte] = new
            at = link[at]
        if at >= 0:
            next_state = edges[at][byte]
            if length[at] + 1 == length[next_state]:
                link[new] = next_state
            else:
                clone = len(edges)
                edges.append(dict(edges[next_state]))
                length.append(length[at] + 1)
                link.append(link[next_state])
                link[next_state] = link[new] = clone
                while at >= 0 and edges[at].get(byte) == next_state:
                    edges[at][byte] = clone
                    at = link[at]
        last = new
    keys = np.array([state * 256 + byte for state, own in enumerate(edges) for byte in own], dtype=np.int64)
    ends = np.array([to for own in edges for to in own.values()], dtype=np.int32)
    order = np.argsort(keys)
    return keys[order], ends[order]


def _learned(rows: pd.DataFrame) -> pd.DataFrame:
    # No text holds the byte 0, so no match runs from one passage into the next.
    data = b"\0".join(sorted(p.encode() for p in rows["passage"]))
    keys, ends = suffix_automaton(data)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "size": [len(data)], "edges": [keys.tobytes()], "next": [ends.tobytes()]})


class Parser:
    """Transition table of one language's automaton.

    A cell holds four times the next state's row, plus the phrases that the step ends: one if the match breaks,
    one more if the sample lacks the byte.
    """

    def __init__(self, edges: bytes, ends: bytes):
        keys, to = np.frombuffer(edges, dtype=np.int64), np.frombuffer(ends, dtype=np.int32)
        state, byte = keys >> 8, keys & 255
        used = np.unique(byte)
        self.width = len(used) + 1
        self.symbol = np.full(256, len(used), dtype=np.int64)
        self.symbol[used] = np.arange(len(used))
        # Every state has an edge into it but the root.
        states = int(to.max()) + 1 if len(to) else 1
        start = np.full(self.width, -1, dtype=np.int64)
        start[self.symbol[byte[state == 0]]] = to[state == 0]
        broken = np.maximum(start, 0) * self.width * 4 + (start < 0)
        table = np.tile((broken + 1).astype(np.int32), (states, 1))
        table[0] = broken
        table[state, self.symbol[byte]] = to * np.int32(self.width * 4)
        self.cells = table.reshape(-1)

    def phrases(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each stretch of `data`; stretches come longest first."""
        symbols = self.symbol[data]
        row, count = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            cell = self.cells[row[:live] + symbols[starts[:live] + step]]
            count[:live] += cell & 3
            row[:live] = cell >> 2
        return count + (row > 0)


def text_bits(texts: list[bytes], models: list[tuple[str, int, bytes, bytes]]) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    parts = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), parts)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
    starts = (np.cumsum(lengths) - lengths)[owner] + within
    sizes = np.minimum(lengths[owner] - within, STRETCH)
    order = np.argsort(-sizes, kind="stable")
    bits = np.zeros((len(texts), len(models)))
    for k, (_, size, edges, ends) in enumerate(models):
        count = Parser(edges, ends).phrases(data, starts[order], sizes[order])
        bits[:, k] = np.bincount(owner[order], weights=count, minlength=len(texts)) * math.log2(size + 1)
    return bits


def predict(docs: DataFrame, rows: int = 200, passages: int = 96, total: int = 4096) -> DataFrame:
    """PREDICTION_SCHEMA, a row for each row of `docs` (doc_id, text, lang)."""
    ship_package(docs.sparkSession)
    learned = sample_passages(docs, rows, passages, total).groupBy("lang").applyInPandas(_learned, _MODEL_SCHEMA)
    models = sorted(tuple(row) for row in learned.toLocalIterator())
    names = [name for name, _, _, _ in models]

    def verdicts(texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not models:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = text_bits(texts, models)
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        empty = np.array([not t for t in texts], dtype=bool)
        return [UNKNOWN if e else names[b] for b, e in zip(best, empty)], np.where(empty, 0.0, 1 / odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = held = 0
            texts: list[bytes] = []
            for k, value in enumerate(batch.column(2)):
                texts.append((value.as_py() or "").encode())
                held += len(texts[-1]) + 16
                if held < _PIECE_BYTES and k + 1 < batch.num_rows:
                    continue
                languages, scores = verdicts(texts)
                part = batch.slice(low, k + 1 - low)
                columns = [part.column(0), part.column(1), pa.array(languages, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])
                low, held, texts = k + 1, 0, []

    read = fresh_name(docs.columns, "letters")
    doc_id = F.col("doc_id").cast("long")
    asked = docs.select(doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), letters(F.col("text")).alias(read))
    return asked.mapInArrow(run, PREDICTION_SCHEMA)
