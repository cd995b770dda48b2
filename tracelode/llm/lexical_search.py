"""Ranked lexical search: the best documents for each of many items, by Block-Max MaxScore over sharded postings.

1. Counts. N documents with a term and L terms in all, in one pass that keeps two numbers a task.
2. Index. Tasks pack documents into shards. A shard is one row of a written table: its sorted term codes, and
   for each term its postings (document, occurrences) in compressed blocks of 64, each with its last document
   and the highest impact in it. The impact of a posting is what its term adds to a score before the term's
   weight, so block maxima hold for any query.
3. Bounds. One pass over the dictionaries gives, for each term that is asked for, its documents and its highest
   impact in the whole corpus.
4. Search. Every shard is read by one task, for all items of a block of items. For an item, terms are put in
   order of their global bounds; the longest run of the lowest ones whose sum stays below the score to beat is
   not essential. Candidates come from essential lists alone. Each other list, highest first, rejects candidates
   by what is still to come, then by the maximum of the block that would hold them; only blocks that still have
   a candidate are decompressed.
5. Heaps. A task keeps the k best of each item over its shards; heaps of all tasks are merged by a window.

One shard in sixteen is searched first: its k-th scores are scores of real documents, so the others start with
them. A score that equals the one to beat is kept, as a smaller id may win the tie.

Items are taken in blocks of `_ITEM_BYTES` of text; the driver and a task hold one block, a task one shard more.
Long texts are read in pieces cut between words, so memory follows distinct terms.

Terms are maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. Null or empty text:
no terms, so no rows and no part in N. A repeated row is a document, or an item, of its own; a null doc_id comes
last among equal scores. Other columns are ignored. An empty corpus or empty items: no rows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm.wordcodes import ALNUM, WordTable, from_planes, to_planes
from tracelode.session import cut_lineage, ship_package

SHARD_BYTES = 1 << 24
BLOCK = 64
_PIECE_BYTES = 1 << 22
_ITEM_BYTES = 1 << 23
_FIRST = 16
_NO_ID = np.iinfo(np.int64).max

_COLUMNS = ("ids", "norms", "terms", "found", "last", "top", "size", "postings")
_INDEX_SCHEMA = "shard long, " + ", ".join(f"{name} binary" for name in _COLUMNS)


def text_pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut between words into pieces of about `size` bytes (one word is never cut)."""
    low = 0
    while len(text) - low > size:
        high = low + size
        while high < len(text) and ALNUM[text[high]]:
            high += 1
        yield text[low:high]
        low = high
    yield text[low:]


def encode_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers in groups of seven bits, and where each begins (one entry more than numbers)."""
    sizes = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        sizes += values >= 1 << (7 * k)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = (values[has] >> (7 * k)) & 127
        part[sizes[has] > k + 1] |= 128
        out[at[:-1][has] + k] = part
    return out, at


def decode_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts + 1
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[has] |= (data[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


class _ShardBuilder:
    """Documents of one shard, counted piece by piece."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.bytes = 0
        self._texts: list[bytes] = []
        self._owner: list[int] = []
        self._waiting = 0
        self._counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.ids.append(doc_id)
        self.bytes += len(text) + 16
        for piece in text_pieces(text, _PIECE_BYTES):
            self._texts.append(piece)
            self._owner.append(len(self.ids) - 1)
            self._waiting += len(piece) + 16
            if self._waiting >= _PIECE_BYTES:
                self._count()

    def _count(self) -> None:
        table = WordTable(self._texts, ALNUM, lower=True)
        if len(table):
            owner = np.array(self._owner, dtype=np.int64)[table.text_of]
            self._counted.append(_summed(table.codes(), owner, np.ones(len(table), dtype=np.int64)))
        self._texts, self._owner, self._waiting = [], [], 0

    def row(self, documents: int, terms: int) -> pa.RecordBatch | None:
        """The shard's row of _INDEX_SCHEMA, None if no document has a term."""
        self._count()
        if not self._counted:
            return None
        codes, docs, tf = _summed(*(np.concatenate(part) for part in zip(*self._counted)))
        lengths = np.bincount(docs, weights=tf, minlength=len(self.ids)).astype(np.int64)
        norms = 50 + 50 * lengths * documents // terms
        term_heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        found = np.diff(np.append(term_heads, len(codes)))
        within = np.arange(len(codes)) - np.repeat(term_heads, found)
        heads = np.flatnonzero(within % BLOCK == 0)
        step = np.diff(docs, prepend=0)
        step[heads] = docs[heads]
        numbers = np.empty(2 * len(docs), dtype=np.int64)
        numbers[0::2], numbers[1::2] = step, tf
        postings, at = encode_numbers(numbers)
        values = {
            "ids": to_planes(np.array([_NO_ID if i is None else i for i in self.ids], dtype=np.int64)),
            "norms": to_planes(norms),
            "terms": to_planes(codes[term_heads]),
            "found": to_planes(found.astype(np.uint32)),
            "last": to_planes(docs[np.append(heads[1:], len(docs)) - 1].astype(np.uint32)),
            "top": to_planes(np.maximum.reduceat(impacts(tf, norms[docs]), heads).astype(np.uint32)),
            "size": to_planes(np.diff(at[2 * np.append(heads, len(docs))]).astype(np.uint16)),
            "postings": postings.tobytes(),
        }
        name = int.from_bytes(os.urandom(8), "little") >> 1
        columns = [pa.array([name], pa.int64()), *(pa.array([values[c]], pa.binary()) for c in _COLUMNS)]
        return pa.RecordBatch.from_arrays(columns, names=["shard", *_COLUMNS])


def _summed(codes: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences by code and document, in that order; the documents of a code come in order."""
    order = np.argsort(codes, kind="stable")
    codes, docs, tf = codes[order], docs[order], tf[order]
    fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])])
    heads = np.flatnonzero(fresh)
    return codes[heads], docs[heads], np.add.reduceat(tf, heads)


@dataclass(frozen=True)
class Index:
    """A written index: one row a shard, with the documents that have a term and the terms of all."""

    shards: DataFrame
    documents: int
    terms: int


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        waiting: list[bytes] = []
        held = 0
        for text in batch.column(0).cast(pa.binary()):
            text = text.as_py() or b""
            if len(text) > _PIECE_BYTES:
                count = sum(len(WordTable([piece], ALNUM)) for piece in text_pieces(text, _PIECE_BYTES))
                documents, terms = documents + (count > 0), terms + count
                continue
            waiting.append(text)
            held += len(text)
            if held >= _PIECE_BYTES:
                counts = np.diff(WordTable(waiting, ALNUM).first)
                documents, terms = documents + int((counts > 0).sum()), terms + int(counts.sum())
                waiting, held = [], 0
        if waiting:
            counts = np.diff(WordTable(waiting, ALNUM).first)
            documents, terms = documents + int((counts > 0).sum()), terms + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all rows of `docs`, written to the shared folder."""
    ship_package(docs.sparkSession)
    counted = docs.select(text).mapInArrow(_corpus_counts, "documents long, terms long")
    documents, terms = (int(n or 0) for n in counted.agg(F.sum("documents"), F.sum("terms")).first())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _ShardBuilder()
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                value = value.as_py()
                if value:
                    shard.add(i, value)
                if shard.bytes >= shard_bytes:
                    if (row := shard.row(documents, terms)) is not None:
                        yield row
                    shard = _ShardBuilder()
        if (row := shard.row(documents, terms)) is not None:
            yield row

    shards = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(pack, _INDEX_SCHEMA)
    return Index(cut_lineage(shards), documents, terms)


@dataclass(frozen=True)
class _Items:
    """A block of items: distinct term codes, and each item's terms as places among them."""

    keys: list
    codes: np.ndarray
    terms: list[np.ndarray]


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[_Items]:
    keys, found, held = [], [], 0

    def block() -> _Items:
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        return _Items(keys, codes, [np.searchsorted(codes, own) for own in found])

    for row in items.select(F.col(item_id), F.col(text)).toLocalIterator():
        table = WordTable([piece for piece in text_pieces((row[1] or "").encode(), _PIECE_BYTES)], ALNUM, lower=True)
        if not len(table):
            continue
        keys.append(row[0])
        found.append(np.unique(table.codes()))
        held += len(row[1])
        if held >= _ITEM_BYTES:
            yield block()
            keys, found, held = [], [], 0
    if keys:
        yield block()


class _Shard:
    """A shard opened for search."""

    def __init__(self, row: dict):
        self.ids = from_planes(row["ids"], np.int64)
        self.norms = from_planes(row["norms"], np.int64)
        self.terms = from_planes(row["terms"], np.uint64)
        self.last = from_planes(row["last"], np.uint32).astype(np.int64)
        self.top = from_planes(row["top"], np.uint32).astype(np.int64)
        blocks = -(-from_planes(row["found"], np.uint32).astype(np.int64) // BLOCK)
        self.block = np.concatenate([[0], np.cumsum(blocks)])
        self.at = np.concatenate([[0], np.cumsum(from_planes(row["size"], np.uint16), dtype=np.int64)])
        self.postings = np.frombuffer(row["postings"], dtype=np.uint8)
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decoded = 0

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code among the shard's terms, -1 where it has none."""
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return np.where(self.terms[at] == codes, at, -1)

    def tops(self, places: np.ndarray) -> np.ndarray:
        """Highest impact of each list, 0 for none."""
        has = places >= 0
        out = np.zeros(len(places), dtype=np.int64)
        if has.any():
            out[has] = np.maximum.reduceat(self.top, self.block[:-1])[places[has]]
        return out

    def blocks(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of blocks of one term, given in order."""
        self.decoded += len(chosen)
        if len(chosen) == chosen[-1] - chosen[0] + 1:
            data = self.postings[self.at[chosen[0]] : self.at[chosen[-1] + 1]]
        else:
            data = np.concatenate([self.postings[self.at[b] : self.at[b + 1]] for b in chosen.tolist()])
        numbers = decode_numbers(data)
        step, tf = numbers[0::2], numbers[1::2]
        docs = np.cumsum(step)
        # All blocks but the last of a term are full; a block's first number is absolute.
        heads = np.arange(0, len(step), BLOCK)
        docs -= np.repeat(docs[heads] - step[heads], np.diff(np.append(heads, len(step))))
        return docs, impacts(tf, self.norms[docs])

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.whole:
            self.whole[term] = self.blocks(np.arange(self.block[term], self.block[term + 1]))
        return self.whole[term]

    def candidates(self, weights: np.ndarray, terms: np.ndarray, tops: np.ndarray, essential: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach the score `beat`, with their scores.

        `terms` come by ascending global bound, the first `essential` of them not essential; `tops` are the
        shard's own bounds.
        """
        score = np.zeros(len(self.ids), dtype=np.int64)
        for weight, term in zip(weights[essential:].tolist(), terms[essential:].tolist()):
            if term >= 0:
                docs, impact = self.list_of(term)
                score[docs] += weight * impact
        docs = np.flatnonzero(score)
        score = score[docs]
        before = np.concatenate([[0], np.cumsum(tops[:essential])])
        for k in range(essential - 1, -1, -1):
            alive = score + before[k + 1] >= beat
            docs, score = docs[alive], score[alive]
            if not len(docs):
                break
            term, weight = int(terms[k]), int(weights[k])
            if term < 0:
                continue
            low, high = int(self.block[term]), int(self.block[term + 1])
            at = low + np.searchsorted(self.last[low:high], docs)
            more = np.where(at < high, weight * self.top[np.minimum(at, high - 1)], 0)
            alive = score + more + before[k] >= beat
            docs, score, at = docs[alive], score[alive], at[alive]
            chosen = np.unique(at[at < high])
            if len(chosen):
                listed, impact = self.blocks(chosen)
                place = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                score += np.where(listed[place] == docs, weight * impact[place], 0)
        reached = score >= max(beat, 1)
        return docs[reached], score[reached]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _dictionary(shards: DataFrame, items: _Items) -> tuple[np.ndarray, np.ndarray]:
    """Documents and highest impact of every asked term, over all shards."""
    codes = items.codes

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, top = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                terms, own = from_planes(row["terms"], np.uint64), from_planes(row["found"], np.uint32).astype(np.int64)
                heads = np.concatenate([[0], np.cumsum(-(-own // BLOCK))[:-1]])
                most = np.maximum.reduceat(from_planes(row["top"], np.uint32).astype(np.int64), heads)
                at = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
                has = terms[at] == codes
                found[has] += own[at[has]]
                top[has] = np.maximum(top[has], most[at[has]])
        held = np.flatnonzero(found)
        columns = [pa.array(held, pa.int32()), pa.array(found[held]), pa.array(top[held])]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "found", "top"])

    seen = shards.select("terms", "found", "top").mapInArrow(look_up, "term int, found long, top long")
    found, top = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
    for row in seen.groupBy("term").agg(F.sum("found").alias("found"), F.max("top").alias("top")).toLocalIterator():
        found[row["term"]], top[row["term"]] = row["found"], row["top"]
    return found, top


_HEAP_SCHEMA = "item int, score long, doc_id long"


def _heaps(shards: DataFrame, items: _Items, weights: np.ndarray, top: np.ndarray, beat: np.ndarray, k: int) -> DataFrame:
    """The k best of every item among the shards of each task, with scores of `beat` at least."""
    bound = weights * top
    # Terms without weight or documents add nothing; the others by ascending global bound.
    terms = [own[bound[own] > 0] for own in items.terms]
    terms = [own[np.argsort(bound[own], kind="stable")] for own in terms]
    sums = [np.cumsum(bound[own]) for own in terms]
    codes, start = items.codes, beat

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = start.copy()
        heaps = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(terms)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Shard(batch.slice(row, 1).to_pylist()[0])
                places = shard.places(codes)
                tops = weights * shard.tops(places)
                for item, own in enumerate(terms):
                    here = tops[own]
                    if not len(own) or here.sum() < max(least[item], 1):
                        continue
                    essential = int(np.searchsorted(sums[item], least[item], side="left"))
                    docs, scores = shard.candidates(weights[own], places[own], here, essential, int(least[item]))
                    if not len(docs):
                        continue
                    held = heaps[item]
                    heaps[item] = _best(np.append(held[0], scores), np.append(held[1], shard.ids[docs]), k)
                    if len(heaps[item][0]) == k:
                        least[item] = max(least[item], heaps[item][0][-1])
        numbers = np.repeat(np.arange(len(terms)), [len(h[0]) for h in heaps])
        ids = np.concatenate([h[1] for h in heaps]) if heaps else np.zeros(0, dtype=np.int64)
        scores = np.concatenate([h[0] for h in heaps]) if heaps else np.zeros(0, dtype=np.int64)
        columns = [pa.array(numbers, pa.int32()), pa.array(scores), pa.array(ids, mask=ids == _NO_ID)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id"])

    return shards.mapInArrow(search, _HEAP_SCHEMA)


def _ranked(heaps: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: Index, items: _Items, k: int) -> DataFrame:
    found, top = _dictionary(index.shards, items)
    weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) if n else 0 for n in found.tolist()], dtype=np.int64)
    nothing = np.zeros(len(items.keys), dtype=np.int64)
    first = F.col("shard") % _FIRST == 0
    early = cut_lineage(_ranked(_heaps(index.shards.filter(first), items, weights, top, nothing, k), k).drop("rank"))
    beat = nothing.copy()
    for row in early.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).toLocalIterator():
        if row["n"] == k:
            beat[row["item"]] = row["least"]
    late = _heaps(index.shards.filter(~first), items, weights, top, beat, k)
    return _ranked(early.unionByName(late), k)


def search(index: Index, items: DataFrame, k: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = items.sparkSession
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema[item_id].dataType)])
    parts = []
    for block in _item_blocks(items, item_id, text) if index.documents else ():
        named = spark.createDataFrame(list(enumerate(block.keys)), kind)
        parts.append(_search_block(index, block, k).join(F.broadcast(named), "item"))
    if not parts:
        kind = kind.add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType())
        parts = [spark.createDataFrame([], kind)]
    return reduce(DataFrame.unionByName, (part.select("item_id", "rank", "doc_id", "score") for part in parts))
