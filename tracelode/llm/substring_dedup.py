"""Substring deduplication with fixed-block anchors.

A window of `width` words is a repeat if the same words start in a document with a smaller doc_id. Any
such window holds a whole block of `block` = (width + 1) // 2 words of the fixed grid laid over the other
document. Three rounds over the chunk table (see exchange.py):

1. Index and probe: a chunk sends the codes of all its rolling windows of `block` words, marked where they
   are grid blocks. A code is an anchor if it is a block somewhere and occurs twice or more.
2. Extend: windows of `width` words around an anchor are sent with 96-bit codes and the smallest doc_id
   that has them in the chunk; a bucket tells which ones a smaller document elsewhere has too.
3. Cut: the words under repeats are marked. Adjacent repeats join into maximal spans.

Anchors go out as 40 bits beyond the bucket; a chance match only costs work in round 2. A third of all
documents may be copies: a code is sent once a chunk, no pair of documents is ever formed, and a bucket
holds a bounded number of codes.

Null or empty text: no words. Texts shorter than a window: kept whole. Null doc_id: larger than all others.
Rows that share a doc_id do not remove each other's words and give a row each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelode.llm import exchange
from tracelode.llm.wordcodes import WordTable, from_planes, mix, to_planes, whole_windows, window_codes
from tracelode.session import cut_lineage

SPAN_SCHEMA = (
    "doc_id long, n_words long, n_removed long, spans array<struct<start: int, n_words: int>>, "
    "kept_text string, kept_sha256 string"
)
_REST = np.uint64(24)


class _Anchors:
    """Distinct codes of a chunk's block windows, sorted, and where they are."""

    def __init__(self, table: WordTable, codes: np.ndarray, block: int):
        places = np.flatnonzero(whole_windows(table, block))
        found = window_codes(codes, block)[places]
        order = np.argsort(found)
        self.places = places[order]
        ranked = found[order]
        fresh = np.ones(len(ranked), dtype=bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        self.group = np.cumsum(fresh) - 1
        self.heads = np.flatnonzero(fresh)
        self.codes = ranked[fresh]
        within = self.places - table.first[table.text_of[self.places]] if len(places) else places
        self.on_grid = within % block == 0

    def flags(self) -> np.ndarray:
        """Bit 0: a grid block here; bit 1: more than one place here."""
        if not len(self.codes):
            return np.zeros(0, dtype=np.uint8)
        grid = np.maximum.reduceat(self.on_grid.astype(np.uint8), self.heads)
        many = np.diff(np.append(self.heads, len(self.group))) > 1
        return grid | (many.astype(np.uint8) << 1)


def _probe_answer(codes: list[bytes], extra: list[bytes]) -> list[bytes]:
    rest = [np.frombuffer(c, dtype=np.uint8).reshape(-1, 5) for c in codes]
    wide = np.zeros((sum(len(r) for r in rest), 8), dtype=np.uint8)
    wide[:, :5] = np.concatenate(rest)
    values = wide.view(np.uint64).reshape(-1)
    flags = np.concatenate([np.frombuffer(e, dtype=np.uint8) for e in extra])
    order = np.argsort(values)
    ranked = values[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    grid = np.maximum.reduceat(flags[order] & 1, heads)
    count = np.add.reduceat(1 + (flags[order] >> 1).astype(np.int64), heads)
    hit = np.empty(len(values), dtype=bool)
    hit[order] = np.repeat((grid > 0) & (count > 1), np.diff(np.append(heads, len(values))))
    cuts = np.cumsum([len(r) for r in rest])[:-1]
    return [np.packbits(part).tobytes() for part in np.split(hit, cuts)]


def _bits(chunk: exchange.Chunk, name: str, codes: np.ndarray, bits: int) -> np.ndarray:
    """One boolean for each of the sorted codes that were sent out, from the answers to them."""
    parts = exchange.bucket_slices(codes, bits)
    out = np.zeros(len(codes), dtype=bool)
    for (_, part), reply in zip(parts, chunk.answers(name), strict=True):
        size = part.stop - part.start
        out[part] = np.unpackbits(np.frombuffer(reply, dtype=np.uint8), count=size).astype(bool)
    return out


class _Repeats:
    """Distinct windows of a chunk that hold an anchor: places, 96-bit codes, smallest doc_id."""

    def __init__(self, chunk: exchange.Chunk, width: int, block: int, bits: int):
        self.table = WordTable(chunk.texts)
        codes = self.table.codes()
        anchors = _Anchors(self.table, codes, block)
        hits = _bits(chunk, "anchors", anchors.codes, bits)
        marked = np.zeros(len(self.table) + 1, dtype=np.int32)
        marked[1:][anchors.places] = hits[anchors.group]
        ahead = np.cumsum(marked)
        whole = whole_windows(self.table, width)
        reach = width - block + 1
        near = ahead[reach : reach + len(whole)] > ahead[: len(whole)]
        places = np.flatnonzero(whole & near)
        first = window_codes(codes, width)[places]
        second = (window_codes(mix(codes), width, base=0xC2B2AE3D27D4EB4F)[places] >> np.uint64(32)).astype(np.uint32)
        self.owner = chunk.numbers()[self.table.text_of[places]] if len(places) else np.zeros(0, np.int64)
        order = np.lexsort((second, first))
        self.places, self.owner = places[order], self.owner[order]
        first, second = first[order], second[order]
        fresh = np.ones(len(first), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = np.flatnonzero(fresh)
        self.group = np.cumsum(fresh) - 1
        self.codes, self.check = first[heads], second[heads]
        self.smallest = np.minimum.reduceat(self.owner, heads) if len(heads) else np.zeros(0, np.int64)


def _extend_answer(codes: list[bytes], extra: list[bytes]) -> list[bytes]:
    sizes = [len(c) // 12 for c in codes]
    first = np.concatenate([from_planes(c[: 8 * n], np.uint64) for c, n in zip(codes, sizes)])
    second = np.concatenate([from_planes(c[8 * n :], np.uint32) for c, n in zip(codes, sizes)])
    owner = np.concatenate([from_planes(e, np.int64) for e in extra])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.empty(len(owner), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(owner))))
    cuts = np.cumsum(sizes)[:-1]
    return [np.packbits(part).tobytes() for part in np.split(least < owner, cuts)]


def find_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """SPAN_SCHEMA, a row for each row of `docs`: maximal repeated spans (in words) and the text without them.

    The text that stays has its words parted by one space each.
    """
    block = (width + 1) // 2
    chunks = exchange.chunk_table(docs)
    bits = exchange.bucket_bits(chunks)

    def probe(chunk: exchange.Chunk) -> pa.RecordBatch:
        table = WordTable(chunk.texts)
        anchors = _Anchors(table, table.codes(), block)
        rest = (anchors.codes << np.uint64(bits)) >> _REST
        rest = np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :5]
        flags = anchors.flags()
        return exchange.asked(bits, chunk.chunk_id, anchors.codes, lambda p: (rest[p].tobytes(), flags[p].tobytes()))

    def extend(chunk: exchange.Chunk) -> pa.RecordBatch:
        found = _Repeats(chunk, width, block, bits)
        return exchange.asked(
            bits, chunk.chunk_id, found.codes,
            lambda p: (to_planes(found.codes[p]) + to_planes(found.check[p]), to_planes(found.smallest[p])),
        )

    def cut(chunk: exchange.Chunk) -> pa.RecordBatch:
        found = _Repeats(chunk, width, block, bits)
        elsewhere = _bits(chunk, "repeats", found.codes, bits)
        late = found.places[elsewhere[found.group] | (found.owner > found.smallest[found.group])]
        size = len(found.table) + 1
        depth = np.bincount(late, minlength=size) - np.bincount(late + width, minlength=size)
        gone = np.cumsum(depth[:-1]) > 0
        rows = []
        for k, text in enumerate(chunk.texts):
            a, b = found.table.first[k], found.table.first[k + 1]
            lost = gone[a:b]
            kept, spans = text.split(), []
            if lost.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                spans = [{"start": int(s), "n_words": int(e - s)} for s, e in zip(edges[0::2], edges[1::2])]
                kept = compress(kept, ~lost)
            left = b" ".join(kept)
            rows.append((chunk.ids[k], int(b - a), int(lost.sum()), spans, left.decode("utf-8", "replace"), hashlib.sha256(left).hexdigest()))
        kinds = [
            pa.int64(), pa.int64(), pa.int64(),
            pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())])), pa.string(), pa.string(),
        ]
        names = ["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    asks = exchange.over_chunks(chunks, probe, exchange.ASK_SCHEMA)
    known = exchange.with_answers(chunks, cut_lineage(exchange.answered(asks, _probe_answer)), "anchors")
    asks = exchange.over_chunks(known, extend, exchange.ASK_SCHEMA)
    known = exchange.with_answers(known, cut_lineage(exchange.answered(asks, _extend_answer)), "repeats")
    return exchange.over_chunks(known, cut, SPAN_SCHEMA)


def repeat_digest(docs: DataFrame, width: int = 13) -> DataFrame:
    return find_repeats(docs.select("doc_id", "text"), width).select("doc_id", "n_words", "n_removed", "kept_sha256")
