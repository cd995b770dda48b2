"""Benchmark decontamination with suffix arrays over the training texts.

The training documents are split into shards of about `SHARD_BYTES` inside tasks. For each shard the word
suffixes are sorted by prefix doubling until they are in order to the depth of a window, and every suffix
of every benchmark item is binary-searched in that array. The suffixes that share its first `window` words
(all words of a shorter item) are its matches; matches that follow each other along both texts join into
the longest verbatim match, with its place in the item and in the document.

Benchmarks are read in blocks of at most `BLOCK_BYTES` of text; a block goes to every task, which is the
only thing that does, and its size is fixed (an item longer than that is a block of its own). The driver holds
one block at a time. Documents never leave their task: no shuffle with one block, one merge by row number of
what was found with more. A document with hits from thousands of items, an item that a third of all
documents quote and a passage quoted many times in one document are linear work.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. Null or empty text: no words.
An item without words matches nothing. Items that share an item_id count as one. Null item ids are ignored.
Rows that repeat a doc_id are judged row by row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.columns import fresh_name
from tracelode.llm.wordcodes import ALNUM, WordTable, text_pieces
from tracelode.session import cut_lineage, ship_package

SHARD_BYTES = 1 << 21
BLOCK_BYTES = 1 << 23
MATCH_SCHEMA = (
    "doc_id long, n_words long, n_hit long, "
    "matches array<struct<item_id: long, item_start: int, doc_start: int, n_words: int>>"
)
_MATCH = pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by at least `depth` symbols (ties in any order).

    The end of the sequence sorts before every symbol.
    """
    size = len(symbols)
    order = np.argsort(symbols)
    rank = _ranks(symbols, order)
    known = 1
    while known < depth:
        ahead = np.zeros(size, dtype=np.uint64)
        ahead[: max(0, size - known)] = rank[known:] + np.uint64(1)
        pairs = (rank << np.uint64(32)) | ahead
        order = np.argsort(pairs)
        rank = _ranks(pairs, order)
        known *= 2
        if size and int(rank[order[-1]]) == size - 1:
            break
    return order


def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    ranked = values[order]
    fresh = np.zeros(len(values), dtype=np.uint64)
    fresh[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(len(values), dtype=np.uint64)
    rank[order] = np.cumsum(fresh)
    return rank


def _bound(symbols: np.ndarray, order: np.ndarray, asked: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all asked sequences at once: the first suffix not before (upper: after) them."""
    low = np.zeros(len(asked), dtype=np.int64)
    high = np.full(len(asked), len(order), dtype=np.int64)
    padded = np.concatenate([symbols, np.zeros(asked.shape[1], dtype=symbols.dtype)])
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        place = order[middle]
        less = np.zeros(len(open_), dtype=bool)
        tied = np.arange(len(open_))
        for j in range(asked.shape[1]):
            tied = tied[lengths[open_[tied]] > j]
            if not len(tied):
                break
            have, want = padded[place[tied] + j], asked[open_[tied], j]
            less[tied[have < want]] = True
            tied = tied[have == want]
        if upper:
            same = np.zeros(len(open_), dtype=bool)
            # Suffixes equal over the asked length lie before the upper bound.
            same[_equal(padded, place, asked[open_], lengths[open_])] = True
            less |= same
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def _equal(padded: np.ndarray, place: np.ndarray, asked: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    tied = np.arange(len(place))
    for j in range(asked.shape[1]):
        rest = lengths[tied] > j
        good = ~rest
        good[rest] = padded[place[tied[rest]] + j] == asked[tied[rest], j]
        tied = tied[good]
    return tied


class _Items:
    """Suffixes of a block of benchmark items: each distinct one of `window` words once, with its owners."""

    def __init__(self, ids: list[int], texts: list[bytes], window: int):
        table = WordTable(texts, ALNUM, lower=True)
        codes = table.codes()
        sequences: dict[tuple, int] = {}
        asked, owner_of, owner, start = [], [], [], []
        for k, item in enumerate(ids):
            a, b = int(table.first[k]), int(table.first[k + 1])
            width = min(window, b - a)
            for at in range(b - a - width + 1 if width else 0):
                words = tuple(codes[a + at : a + at + width].tolist())
                owner_of.append(sequences.setdefault(words, len(sequences)))
                if len(sequences) > len(asked):
                    asked.append(words)
                owner.append(item)
                start.append(at)
        self.lengths = np.array([len(w) for w in asked], dtype=np.int64)
        self.asked = np.zeros((len(asked), window), dtype=np.uint64)
        for k, words in enumerate(asked):
            self.asked[k, : len(words)] = words
        order = np.argsort(np.array(owner_of, dtype=np.int64), kind="stable")
        self.owner = np.array(owner, dtype=np.int64)[order]
        self.start = np.array(start, dtype=np.int64)[order]
        self.first = np.searchsorted(np.array(owner_of, dtype=np.int64)[order], np.arange(len(asked) + 1))
        self.vocabulary = np.unique(codes)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] times, then on from starts[1] and so forth."""
    total = int(counts.sum())
    before = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - before + np.repeat(starts, counts)


def _match_shard(ids: list, texts: list[bytes], items: _Items) -> list[tuple]:
    table = WordTable(texts, ALNUM, lower=True)
    codes = table.codes()
    size = len(codes)
    n_words = np.diff(table.first)
    hit = np.zeros(size, dtype=bool)
    found: dict[int, list] = {}
    if size and len(items.asked):
        # Words as numbers: those of the items in code order, one number for all others.
        place = np.searchsorted(items.vocabulary, codes)
        place[place == len(items.vocabulary)] = 0
        symbols = np.where(items.vocabulary[place] == codes, place + 2, 1).astype(np.uint64)
        wanted = np.searchsorted(items.vocabulary, items.asked).astype(np.uint64) + np.uint64(2)
        order = suffix_array(symbols, items.asked.shape[1])
        low = _bound(symbols, order, wanted, items.lengths, upper=False)
        high = _bound(symbols, order, wanted, items.lengths, upper=True)
        query = np.repeat(np.arange(len(low)), high - low)
        at = order[_spread(low, high - low)]
        last = at + items.lengths[query] - 1
        inside = last < size
        inside[inside] = table.text_of[at[inside]] == table.text_of[last[inside]]
        query, at = query[inside], at[inside]
        cover = np.bincount(at, minlength=size + 1) - np.bincount(at + items.lengths[query], minlength=size + 1)
        hit = np.cumsum(cover[:-1]) > 0
        owners = items.first[query + 1] - items.first[query]
        pick = _spread(items.first[query], owners)
        found = _longest(table, items, np.repeat(at, owners), items.owner[pick], items.start[pick], np.repeat(items.lengths[query], owners))
    hits = np.concatenate([[0], np.cumsum(hit)])
    n_hit = hits[table.first[1:]] - hits[table.first[:-1]]
    return [(ids[k], int(n_words[k]), int(n_hit[k]), found.get(k, [])) for k in range(len(ids))]


def _longest(table: WordTable, items: _Items, at: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> dict:
    """Matches joined along both texts, by document."""
    text = table.text_of[at]
    shift = at - start
    order = np.lexsort((at, shift, owner, text))
    at, owner, start, length, text, shift = (x[order] for x in (at, owner, start, length, text, shift))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] > at[:-1] + length[:-1])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(at)) - 1
    out: dict[int, list] = {}
    for a, b in zip(heads.tolist(), tails.tolist()):
        place = int(at[a] - table.first[text[a]])
        match = {"item_id": int(owner[a]), "item_start": int(start[a]), "doc_start": place, "n_words": int(at[b] + length[b] - at[a])}
        out.setdefault(int(text[a]), []).append(match)
    return out


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[list]]:
    """How many blocks of bounded size the benchmark's rows make, and the blocks, brought to the driver one by one."""
    rows = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    cell = F.octet_length("text").cast("long") + 16
    total = rows.agg(F.sum(cell)).first()[0] or 0
    count = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    spread = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    return count, (spread.filter(F.col("_block") == k).drop("_block").collect() for k in range(count))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """MATCH_SCHEMA, a row for each row of `docs`: words, words under a match, longest matches by place.

    With a benchmark of several blocks the rows are numbered and written first; then each block is searched for in
    a run of its own, and what it found is put together by row number.
    """
    ship_package(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    count, blocks = _blocks(benchmark)
    if count == 1:
        return _search(plain.withColumn("row", F.lit(0)), next(blocks), window).drop("row")
    numbered = _numbered(plain)
    # The first block gives every row; a block is written before the next one is brought in.
    found = [cut_lineage(_search(numbered, next(blocks), window))]
    found += [cut_lineage(_search(numbered, rows, window).filter("n_hit > 0")) for rows in blocks]
    return _merged(found)


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number for each row, written so that the numbers stay."""
    return cut_lineage(docs.withColumn("row", F.monotonically_increasing_id()))


def _search(docs: DataFrame, rows: list, window: int) -> DataFrame:
    """Columns of MATCH_SCHEMA and `row`, from doc_id, text and row."""
    ids, texts = [r["item_id"] for r in rows], [r["text"].encode() for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(ids, texts, window)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(_MATCH))
        names = ["doc_id", "n_words", "n_hit", "matches", "row"]
        for batch in batches:
            for piece, held in text_pieces(batch, 1, SHARD_BYTES):
                found = _match_shard(piece.column(0).to_pylist(), held, items)
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*columns, piece.column(2).cast(pa.int64())], names=names)

    return docs.select("doc_id", "text", F.col("row").cast("long")).mapInArrow(run, MATCH_SCHEMA + ", row long")


def _merged(found: list[DataFrame]) -> DataFrame:
    """One row for each row of the first part, with the matches of all parts."""
    every = reduce(DataFrame.unionByName, found)
    # Matches of a document are bounded by its words times the items that quote it.
    grouped = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")
    )
    begin, stop = F.col("m.doc_start"), F.col("m.doc_start") + F.col("m.n_words")
    spans = every.select("row", F.explode("matches").alias("m")).select("row", begin.alias("a"), stop.alias("b")).distinct()
    order = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max("b").over(order), F.lit(0)), F.col("a"))
    covered = spans.select("row", F.greatest(F.col("b") - reach, F.lit(0)).alias("n_hit"))
    hits = covered.groupBy("row").agg(F.sum("n_hit").alias("n_hit"))
    return grouped.join(hits, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "matches"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the rows that hold a window of the benchmark; same columns, no shuffle.

    With a benchmark of several blocks the rows are numbered and written first, and each block names the rows it hits.
    """
    ship_package(docs.sparkSession)
    count, blocks = _blocks(benchmark)
    if count == 1:
        return _without_hits(docs, next(blocks), window)
    row = fresh_name(docs.columns, "row")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = numbered.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col(row).alias("row"))
    hit = [cut_lineage(_search(plain, rows, window).filter("n_hit > 0").select(F.col("row").alias(row))) for rows in blocks]
    return numbered.join(reduce(DataFrame.unionByName, hit).distinct(), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _without_hits(docs: DataFrame, rows: list, window: int) -> DataFrame:
    ids, texts = [r["item_id"] for r in rows], [r["text"].encode() for r in rows]
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(ids, texts, window)
        for batch in batches:
            for piece, held in text_pieces(batch, place, SHARD_BYTES):
                found = _match_shard(list(range(len(held))), held, items)
                yield piece.filter(pa.array([n_hit == 0 for _, _, n_hit, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_matches(docs, benchmark)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
