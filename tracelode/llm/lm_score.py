"""Log-likelihood of whole documents under a gated recurrent language model learned from the corpus.

1. Counts. Texts are read once, and written as distinct words and their places. Chunks of documents ask for
   the training count of each of their words (see exchange.py), so counts cover all training documents and no
   table of all words goes anywhere as a whole.
2. Vocabulary. The most frequent words, `vocabulary` at least and `_GROWTH` times the square root of the
   number of distinct words, have a token each. Other known words are grouped by the power of two of their
   count and by a hash; a group has a token of its own, as context and as target, and its words are told
   apart by their counts. The hash grows with the square root of the corpus. Tokens are classed by frequency;
   the number of classes grows with the square root of the number of tokens. Classes are gathered in kinds, as
   many as the square root of the classes. Unseen words share one token.
3. Training. The weights go round `rounds` times: the documents lie in streams, as many as the square root of
   the corpus asks for, and a task for each runs truncated backpropagation (recurrent.py) over its part of the
   training documents, each document once in all. What the weights moved by is averaged by the tokens seen. A word seen once stands for an unseen one, since it would be if left out.
4. Scoring. Every document is read from its first word to its end mark; the state goes from window to
   window. The score is the log10 probability of all its tokens.

Documents whose crc32(doc_id as text) is divisible by ten are held out. Words are parted by white space,
A-Z lower-cased, each document ends with an end token. Tasks hold one chunk and one model; the driver holds
the vocabulary and one weight vector, both of the order of the square root of the corpus.

Null text: only the end token. Null doc_id: held out. No training document: base scores of an empty
count table, and a model of even odds. Rows that repeat are learned and scored each. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import exchange
from tracelode.llm.recurrent import Layout, Model
from tracelode.llm.wordcodes import WordTable, from_planes, to_planes
from tracelode.session import cut_lineage

SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
_WORD_SCHEMA = "chunk_id long, n_bytes long, ids array<long>, lengths array<int>, codes binary, place binary"
_TOKEN_SCHEMA = "ids array<long>, lengths array<int>, known array<int>, base array<double>, rest array<double>, tokens binary"
_MEAN_PARTS = 16
_ROWS = 2048
_TRAIN_TOKENS = 1 << 19
_SCORE_TOKENS = 1 << 21
_GROWTH = 4
_HASH_BITS = 6
_POWERS = 63


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text; a null id has the one of an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def held_out(doc_id: int | None) -> bool:
    return fold(doc_id) % 10 == 0


def _as_words(chunk: exchange.Chunk) -> pa.RecordBatch:
    """Row of _WORD_SCHEMA: distinct words in order of their codes, which one each word is, and each text's number of words."""
    table = WordTable(chunk.texts, lower=True)
    codes, place = np.unique(table.codes(), return_inverse=True)
    row = [chunk.chunk_id, chunk.row["n_bytes"], chunk.ids, np.diff(table.first), to_planes(codes), to_planes(place.astype(np.uint32))]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    names = ["chunk_id", "n_bytes", "ids", "lengths", "codes", "place"]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names=names)


class _Distinct:
    """Distinct words of a chunk, in order of their codes, and where they are."""

    def __init__(self, chunk: exchange.Chunk):
        self.codes, self.place = from_planes(chunk.row["codes"], np.uint64), from_planes(chunk.row["place"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(chunk.row["lengths"], dtype=np.int64)])
        self.text_of = np.repeat(np.arange(len(chunk.ids)), np.diff(self.first))
        self.training = ~np.array([held_out(i) for i in chunk.ids], dtype=bool)

    def training_counts(self) -> np.ndarray:
        used = self.place[self.training[self.text_of]] if len(self.place) else self.place
        return np.bincount(used, minlength=len(self.codes)).astype(np.uint64)


def _totals(codes: list[bytes], extra: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of a bucket, their counts, and which one each asked code is."""
    asked = np.concatenate([from_planes(c, np.uint64) for c in codes])
    counts = np.concatenate([from_planes(e, np.uint64) for e in extra])
    order = np.argsort(asked)
    ranked = asked[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    heads = np.flatnonzero(fresh)
    group = np.empty(len(asked), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    return ranked[heads], np.add.reduceat(counts[order], heads), group


def _count_answer(codes: list[bytes], extra: list[bytes]) -> list[bytes]:
    _, totals, group = _totals(codes, extra)
    cuts = np.cumsum([len(c) // 8 for c in codes])[:-1]
    return [to_planes(part) for part in np.split(totals[group], cuts)]


def _most_words(vocabulary: int, distinct: float) -> int:
    return max(vocabulary, int(_GROWTH * distinct**0.5))


def _power(counts: np.ndarray) -> np.ndarray:
    """Power of two at or under each count."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1].astype(np.int64) - 1


def _group(codes: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """Group of words outside the vocabulary: power of two of the count (1 is with 2 and 3) and hash.

    Words seen once are with others because training takes them for unseen ones.
    """
    power = np.maximum(_power(counts), 1)
    mixed = (codes ^ (codes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return np.minimum(power, _POWERS - 1) * hashes + (mixed >> np.uint64(40)).astype(np.int64) % hashes


def _note(vocabulary: int, hashes: int, buckets: int):
    def note(codes: list[bytes], extra: list[bytes]) -> bytes:
        """Words seen in training, tokens, frequent words; their codes and counts; groups and their tokens."""
        distinct, totals, _ = _totals(codes, extra)
        totals = totals.astype(np.int64)
        seen = totals > 0
        # Codes are even over buckets, so twice the words of this one, times buckets, are more than all.
        most = _most_words(vocabulary, 2.0 * seen.sum() * buckets)
        top = np.lexsort((distinct, -totals))[:most]
        top = top[totals[top] > 0]
        masses = np.zeros(_POWERS * hashes, dtype=np.int64)
        np.add.at(masses, _group(distinct, totals, hashes), totals)
        used = np.flatnonzero(masses)
        head = np.array([seen.sum(), totals.sum(), len(top)], dtype=np.int64)
        return np.concatenate([head, distinct[top].view(np.int64), totals[top], used, masses[used]]).tobytes()

    return note


def _opened(note: bytes) -> tuple:
    """Words and tokens; codes and counts of the frequent words; groups and their tokens."""
    values = np.frombuffer(note, dtype=np.int64)
    codes, counts, rest = np.split(values[3:], [values[2], 2 * values[2]])
    return values[:2], codes, counts, *np.split(rest, 2)


def _frequent(replies: DataFrame, vocabulary: int, hashes: int) -> tuple[list, int, int, np.ndarray]:
    """The most frequent words as (code, count), numbers of distinct words and word tokens, tokens by group."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of each task: words and tokens, listed words by power of two of the count, tokens by group."""
        head, listed, masses = np.zeros(2, np.int64), np.zeros(_POWERS + 1, np.int64), np.zeros(_POWERS * hashes, np.int64)
        for batch in batches:
            for note in batch.column(0).to_pylist():
                found, _, counts, used, mass = _opened(note)
                head += found
                listed += np.bincount(_power(counts), minlength=_POWERS + 1)
                masses[used] += mass
        used = np.flatnonzero(masses)
        packed = np.concatenate([head, listed, used, masses[used]]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["sums"])

    notes = replies.filter("note IS NOT NULL").select("note")
    head, listed, masses = np.zeros(2, np.int64), np.zeros(_POWERS + 1, np.int64), np.zeros(_POWERS * hashes, np.int64)
    for row in notes.mapInArrow(sums, "sums binary").toLocalIterator():
        values = np.frombuffer(row["sums"], dtype=np.int64)
        used, mass = np.split(values[len(head) + len(listed) :], 2)
        head += values[: len(head)]
        listed += values[len(head) : len(head) + len(listed)]
        masses[used] += mass
    most = _most_words(vocabulary, int(head[0]))
    # The highest power of two that as many words reach as are wanted: no others become rows.
    enough = np.flatnonzero(np.cumsum(listed[::-1])[::-1] >= most)
    lowest = int(enough[-1]) if len(enough) else 0

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for note in batch.column(0).to_pylist():
                _, codes, counts, _, _ = _opened(note)
                high = _power(counts) >= lowest
                yield pa.RecordBatch.from_arrays([pa.array(codes[high]), pa.array(counts[high])], names=["code", "n"])

    found = notes.mapInArrow(frequent, "code long, n long")
    top = found.orderBy(F.desc("n"), "code").limit(most).collect()
    return [(r["code"], r["n"]) for r in top], int(head[0]), int(head[1]), masses


class _Vocabulary:
    """What every task needs to turn counted words into tokens: bounded by words and groups."""

    def __init__(self, top: list, distinct: int, words: int, ends: int, masses: np.ndarray, hashes: int):
        codes = np.array([c for c, _ in top], dtype=np.int64).view(np.uint64)
        own = np.array([n for _, n in top], dtype=np.int64)
        masses = masses.copy()
        np.subtract.at(masses, _group(codes, own, hashes), own)
        groups = np.flatnonzero(masses)
        counts = np.concatenate([own, [ends], masses[groups]])
        rank = np.argsort(-counts, kind="stable")
        place = np.empty(len(counts), dtype=np.int64)
        place[rank] = np.arange(len(counts))
        self.counts, self.end = counts[rank], int(place[len(own)])
        order = np.argsort(codes)
        self.codes, self.number = codes[order], place[: len(own)][order]
        self.hashes, self.masses = hashes, masses
        self.group_number = np.full(len(masses), -1, dtype=np.int64)
        self.group_number[groups] = place[len(own) + 1 :]
        self.size = len(counts)
        self.ends, self.rest = ends, max(words - int(own.sum()), 0)
        self.tokens = words + ends
        self.distinct = distinct + (ends > 0)
        self.scale = self.tokens + 0.1 * (self.distinct + 1)

    def encode(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of each distinct word, and the log10 of its share of the token's count.

        Own number, number of its group, size + 1 (unseen), size + 2 + number of the group (seen once).
        """
        group = _group(codes, counts, self.hashes)
        number = self.group_number[group]
        out = np.where(counts == 0, self.size + 1, np.where(counts == 1, self.size + 2 + number, number))
        share = np.where(counts == 0, 0.0, np.log10(np.maximum(counts, 1) / np.maximum(self.masses[group], 1)))
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            listed = self.codes[at] == codes
            out, share = np.where(listed, self.number[at], out), np.where(listed, 0.0, share)
        return out, share

    def learned(self, text: np.ndarray) -> np.ndarray:
        """Tokens as training reads them: words seen once stand for unseen ones."""
        return np.where(text >= self.size + 2, self.size + 1, text)

    def scored(self, text: np.ndarray) -> np.ndarray:
        return np.where(text >= self.size + 2, text - self.size - 2, text)


def _encode_chunk(chunk: exchange.Chunk, words: _Vocabulary) -> tuple:
    distinct = _Distinct(chunk)
    replies = chunk.answers("counts")
    counts = np.concatenate([from_planes(r, np.uint64) for r in replies]).astype(np.int64) if replies else np.zeros(0, np.int64)
    token, rest = words.encode(distinct.codes, counts)
    base = np.log10((counts + 0.1) / words.scale)
    first = distinct.first

    def by_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values[distinct.place])])
        return sums[first[1:]] - sums[first[:-1]]

    lengths = np.diff(first) + 1
    stream = np.full(int(lengths.sum()), words.end, dtype=np.uint32)
    at = np.arange(len(distinct.place)) + distinct.text_of
    stream[at] = token[distinct.place]
    known = by_text((counts > 0).astype(np.int64)) + (words.ends > 0)
    end = float(np.log10((words.ends + 0.1) / words.scale))
    return chunk.ids, lengths, known, by_text(base) + end, by_text(rest), to_planes(stream)


def _texts(row: dict, read: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    stream = read(from_planes(row["tokens"], np.uint32).astype(np.int64))
    return np.split(stream, np.cumsum(row["lengths"])[:-1])


def _train_round(encoded: DataFrame, words: _Vocabulary, model: Model, part: int, parts: int, rate: float) -> Model:
    flat = model.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory, seen = _copy(model, flat), {}, 0
        chosen, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for doc_id, text in zip(row["ids"], _texts(row, words.learned)):
                    if not held_out(doc_id) and fold(doc_id) // 10 % parts == part:
                        chosen.append(text)
                        held += len(text)
                if held >= _TRAIN_TOKENS:
                    own.train(chosen, words.end, rate, memory)
                    chosen, held, seen = [], 0, seen + held
        own.train(chosen, words.end, rate, memory)
        seen += held
        if seen:
            group = zlib.crc32(own.flat.tobytes()) % _MEAN_PARTS
            moved = (own.flat - flat).astype(np.float16)
            names = ["part", "weight", "moved"]
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([float(seen)]), pa.array([moved.tobytes()])], names=names)

    def mean(kind: type):
        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            total, weight = np.zeros(len(flat)), float(rows["weight"].sum())
            for moved, own in zip(rows["moved"], rows["weight"]):
                total += np.frombuffer(moved, dtype=kind).astype(np.float64) * own
            return pd.DataFrame({"weight": [weight], "moved": [(total / weight).astype(np.float32).tobytes()]})

        return fold

    # A stream changes weights by little, so changes go round in half precision; they are averaged in two steps.
    learned = encoded.mapInArrow(run, "part long, weight double, moved binary")
    parts = learned.groupBy("part").applyInPandas(mean(np.float16), "weight double, moved binary")
    found = parts.withColumn("every", F.lit(0)).groupBy("every").applyInPandas(mean(np.float32), "weight double, moved binary").collect()
    return _copy(model, flat + np.frombuffer(found[0]["moved"], dtype=np.float32)) if found else model


def _copy(model: Model, flat: np.ndarray) -> Model:
    out = Model(model.layout, model.hidden, np.zeros(model.layout.size), (0.0, 0.0))
    out.flat[...] = flat
    return out


def score_documents(
    docs: DataFrame, vocabulary: int = 2047, classes: int = 32, hidden: int = 16, rounds: int = 3, rate: float = 0.02
) -> DataFrame:
    """SCORE_SCHEMA, a row for each row of `docs`."""
    chunks = exchange.chunk_table(docs, work=_as_words, schema=_WORD_SCHEMA)
    bits = exchange.bucket_bits(chunks)

    def ask(chunk: exchange.Chunk) -> pa.RecordBatch:
        distinct = _Distinct(chunk)
        counts = distinct.training_counts()
        return exchange.asked(bits, chunk.chunk_id, distinct.codes, lambda p: (to_planes(distinct.codes[p]), to_planes(counts[p])))

    asks = exchange.over_chunks(chunks, ask, exchange.ASK_SCHEMA)
    hashes = 1 << (_HASH_BITS + (bits - 4) // 2)
    replies = cut_lineage(exchange.answered(asks, _count_answer, _note(vocabulary, hashes, 1 << bits)))
    top, distinct, tokens, masses = _frequent(replies, vocabulary, hashes)
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    ends = chunks.select(F.explode("ids").alias("id")).filter(F.crc32(key.cast("binary")) % 10 != 0).count()
    words = _Vocabulary(top, distinct, tokens, ends, masses, hashes)

    def encode(chunk: exchange.Chunk) -> pa.RecordBatch:
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
        names = ["ids", "lengths", "known", "base", "rest", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(_encode_chunk(chunk, words), kinds)], names=names)

    encoded = cut_lineage(exchange.over_chunks(exchange.with_answers(chunks, replies, "counts"), encode, _TOKEN_SCHEMA))
    once = float(np.sqrt(max(words.rest, 0)))
    layout = Layout(words.counts, max(classes, int(np.sqrt(words.size))))
    # No known word is without a token, so the model's own one for such words is empty.
    model = Model(layout, hidden, words.counts.astype(float), (0.0, once))
    # As many streams as the model is large for: what they send stays in proportion to the corpus.
    streams = encoded.coalesce(max(_MEAN_PARTS, int(2 * encoded.count() ** 0.5)))
    for k in range(rounds if ends else 0):
        model = _train_round(streams, words, model, k, rounds, rate * (1 - k / (rounds + 1)))
    flat, train_tokens = model.flat, int(words.tokens)

    def scored(own: Model, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Rows of chunks read together: a step over the longest texts costs its calls, however few texts are left."""
        texts = [t for row in rows for t in _texts(row, words.scored)]
        every = np.zeros(len(texts))
        order = np.argsort([len(t) for t in texts], kind="stable")
        for low in range(0, len(order), _ROWS):
            part = order[low : low + _ROWS]
            every[part] = own.score([texts[i] for i in part], words.end)
        at = 0
        for row in rows:
            n = len(row["ids"])
            found = every[at : at + n] / np.log(10) + np.array(row["rest"])
            at += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()), pa.array([held_out(i) for i in row["ids"]]), pa.array(row["lengths"], pa.int64()),
                    pa.array(row["known"], pa.int64()), pa.array([train_tokens] * n, pa.int64()), pa.array(row["base"]), pa.array(found),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, held = _copy(model, flat), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                rows.append(batch.slice(k, 1).to_pylist()[0])
                held += sum(rows[-1]["lengths"])
                if held >= _SCORE_TOKENS:
                    yield from scored(own, rows)
                    rows, held = [], 0
        if rows:
            yield from scored(own, rows)

    return encoded.mapInArrow(score, SCORE_SCHEMA)
