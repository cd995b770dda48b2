"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates, exact check.

1. Signature. A document is its set of word shingles. Shingle codes fall into `BINS` bins by their leading
   bits, the smallest code of a bin stands for it, and an empty bin borrows from another one by optimal
   densification (a second hash names bins to try until one is filled), so short texts have full
   signatures too. Documents with equal sets are one class; its smallest doc_id goes on alone.
2. Buckets. `BANDS` bands of `ROWS` bins; two sets of similarity 0.85 miss each other in all bands with
   probability 2e-9, of 0.8 with 3e-6 (less in fact: bins are drawn without replacement).
3. Stars. The smallest class of a bucket is its centre, and each other one makes a pair with the centre:
   as many pairs as members. Pairs are checked on full sets.
4. Components of the confirmed links, by alternating large and small stars.
5. Hubs. A link between two members that both miss the centre must not be lost. Where a bucket still
   holds several components, its members are checked with a second centre, the one with the fewest
   shingles of its own (of a group of edits, the text they were made from).
6. Rest. Members around one hub that are still apart are checked block against block inside tasks, but for
   pairs that cannot be similar: by set size, by the shingles only one of them has, and by the triangle
   inequality of the Jaccard distance to the hub. No row is made for a pair, only for a link found.

Large groups of copies are one class; large groups of near copies are stars, dealt out in parts of
`STAR_PART` members with the centre's text in each part. Nothing is collected to the driver but counts.

Null or empty texts, and texts without words, have empty sets and no links. Null doc_id: such a row has no
name to give to a group, takes no part and is kept (component_id null). Rows that share a doc_id are judged
each by its own text; the row's group is named by the smallest doc_id in it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.columns import fresh_name
from tracelode.llm.wordcodes import NOT_SPACE, WordTable, mix, text_pieces, window_codes
from tracelode.session import cut_lineage, ship_package

BINS, ROWS, BANDS = 256, 6, 42
STAR_PART = 64
BLOCK = 128
_CELLS = 50
_PIECE_BYTES = 1 << 22
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, code_a long, code_b long, buckets array<long>"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle codes of each text; a text of fewer words has its whole sequence as one."""
    table = WordTable(texts, NOT_SPACE, lower=True)
    codes = table.codes()
    windows = window_codes(codes, width)
    out = []
    for a, b in zip(table.first[:-1].tolist(), table.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(window_codes(codes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest code of each bin, empty bins filled by optimal densification. `shingles`: sorted, not empty."""
    at = np.searchsorted(shingles, _EDGES)
    values = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & ((values >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64))
    source = np.arange(BINS)
    open_ = np.flatnonzero(~filled)
    attempt = 0
    while len(open_):
        attempt += 1
        tried = (mix(open_.astype(np.uint64) + np.uint64(attempt * BINS)) >> np.uint64(56)).astype(np.int64)
        good = filled[tried]
        source[open_[good]] = tried[good]
        open_ = open_[~good]
    return values[source]


_BAND_FACTORS = mix(np.arange(BANDS * ROWS, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)
_BAND_MARKS = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 32))


def bucket_codes(bins: np.ndarray) -> np.ndarray:
    """One code for each band; the band is part of the code."""
    rows = bins[: BANDS * ROWS].reshape(BANDS, ROWS)
    return mix((mix(rows) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_MARKS)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """SIGNATURE_SCHEMA, a row for each row of `docs`; code_a and code_b tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in text_pieces(batch, 1, _PIECE_BYTES):
                sets = shingle_sets(texts, width)
                codes = [mix(s) for s in sets]
                with np.errstate(over="ignore"):
                    first = np.array([c.sum(dtype=np.uint64) for c in codes], dtype=np.uint64)
                    second = np.array([mix(c).sum(dtype=np.uint64) for c in codes], dtype=np.uint64)
                bands = [bucket_codes(signature(s)).view(np.int64) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "code_a", "code_b", "buckets"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE_SCHEMA)


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, n_a, n_b, both (size of the common set) for distinct `pairs` (a, b). `texts`: doc_id, text."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_PART).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    members = dealt.join(texts, dealt["b"] == texts["doc_id"]).select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts["doc_id"])
    centres = centres.select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for piece, held in text_pieces(batch, 3, _PIECE_BYTES):
                found = []
                for a, b, own in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), shingle_sets(held, width)):
                    if b is None:
                        centre = own
                    else:
                        found.append((a, b, len(centre), len(own), len(np.intersect1d(centre, own, assume_unique=True))))
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_a", "n_b", "both"])

    return rows.select("a", "part", "b", "text").mapInArrow(run, "a long, b long, n_a long, n_b long, both long")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of `links` (a, b); rounds grow with log of the path length."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "u", "m")
        next_edges = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        edges = cut_lineage(next_edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v") % 1000003)).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of `docs`.

    Linked: 100 * common shingles >= percent * shingles of either. component_id is the smallest doc_id that
    links reach, kept marks the document that bears it.
    """
    ship_package(docs.sparkSession)
    signed = cut_lineage(signatures(docs, width))
    if not _ids_repeat(signed):
        return _groups(docs, signed, width, percent)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut_lineage(plain.withColumn("row", F.monotonically_increasing_id()))
    nameless = signed.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return _row_groups(rows, width, percent).drop("row").unionByName(nameless)


def _ids_repeat(signed: DataFrame) -> bool:
    """Whether some doc_id stands for different sets."""
    spread = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("code_a").alias("low"), F.max("code_a").alias("high"))
    return not spread.filter("low < high").isEmpty()


def _row_groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept of written `rows` (row, doc_id, text) with a doc_id.

    The rows' numbers take the place of ids that do not tell them apart; a group's name is its smallest doc_id.
    """
    named = rows.filter("doc_id IS NOT NULL").select("row", "doc_id", "text")
    plain = named.select(F.col("row").alias("doc_id"), "text")
    found = _groups(plain, cut_lineage(signatures(plain, width)), width, percent)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part")).join(named.select("row", "doc_id"), "row")
    found = cut_lineage(found)
    names = found.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return found.join(names, "part").select("row", "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _groups(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of `near_groups` for `docs` and their signatures, where a doc_id stands for one set."""
    named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    codes = ["code_a", "code_b", "n_shingles"]
    classes = cut_lineage(named.groupBy(*codes).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    heads = named.join(classes.select(*codes, F.col("node").alias("doc_id")), [*codes, "doc_id"], "left_semi")
    spread = heads.dropDuplicates(["doc_id", *codes]).select(F.col("doc_id").alias("node"), "n_shingles", F.explode("buckets").alias("bucket"))
    centres = spread.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last")
    members = cut_lineage(spread.join(centres.drop("last"), "bucket").dropDuplicates(["bucket", "node"]))
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    texts = cut_lineage(texts.groupBy("doc_id").agg(F.min("text").alias("text")))

    close = F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))
    stars = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = cut_lineage(overlaps(stars, texts, width))
    links = tested.filter(close).select("a", "b")
    grouped = cut_lineage(components(links))

    held = _open_members(members, grouped)
    if not held.isEmpty():
        circles = _circles(_with_private(held, texts, width))
        again = circles.filter("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        again = again.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = cut_lineage(tested.unionByName(overlaps(again, texts, width)))
        links = tested.filter(close).select("a", "b")
        grouped = cut_lineage(components(links))
        more = cut_lineage(_rest_links(circles, tested, grouped, texts, width, percent))
        if not more.isEmpty():
            grouped = cut_lineage(components(links.unionByName(more)))
    linked = classes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = linked.filter("copies > 1 OR component <> node").select(*codes, "component")
    joined = signed.join(linked, codes, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _with_component(members: DataFrame, grouped: DataFrame) -> DataFrame:
    return members.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_members(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    whole = _with_component(members, grouped)
    split = whole.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return cut_lineage(whole.join(split.select("bucket"), "bucket", "left_semi"))


def _with_private(held: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """`held` with `private`: how many shingles of the node no other node of `held` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, own in text_pieces(batch, 1, _PIECE_BYTES):
                sets = shingle_sets(own, width)
                nodes = np.repeat(piece.column(0).to_numpy(), [len(s) for s in sets])
                codes = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(codes)], names=["node", "code"])

    nodes = held.select(F.col("node").alias("doc_id")).distinct()
    rows = texts.join(nodes, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "node long, code long")
    alone = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    counted = alone.groupBy("node").agg(F.count("*").alias("private"))
    return cut_lineage(held.join(counted, "node", "left").withColumn("private", F.coalesce("private", F.lit(0))))


def _circles(held: DataFrame) -> DataFrame:
    """hub, node, n_shingles, private: the members of all buckets of one hub, each once.

    The hub of a bucket is the member with the smallest share of private shingles.
    """
    order = F.struct(F.col("private") / F.col("n_shingles"), F.col("node"))
    hubs = held.groupBy("bucket").agg(F.min(order)["node"].alias("hub"))
    return cut_lineage(held.join(hubs, "bucket").select("hub", "node", "n_shingles", "private").distinct())


def _reach(percent: int) -> int:
    """Cells that two members of one link may lie apart; one found in floating point may be one too low."""
    return _CELLS * (100 - percent) // 100 + 1


def _rest_links(circles: DataFrame, tested: DataFrame, grouped: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components within a circle, looked for block against block.

    Members are dealt into blocks of about `BLOCK` by their distance to the hub; blocks whose distances
    differ by more than a link's meet no one. A pair is left out if the sizes differ too much, or if the
    shingles that only one of them has are too many; the first link of two components is enough.
    """
    pair = tested.select("a", "b", (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("far"))
    keyed = circles.filter(100 * (F.col("n_shingles") - F.col("private")) >= percent * F.col("n_shingles"))
    keyed = _with_component(keyed, grouped).withColumn("a", F.least("hub", "node")).withColumn("b", F.greatest("hub", "node"))
    split = keyed.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    placed = keyed.join(split.select("hub"), "hub", "left_semi").join(pair, ["a", "b"], "left").drop("a", "b")
    placed = placed.withColumn("cell", F.floor(F.coalesce("far", F.lit(0.0)) * _CELLS))
    sizes = placed.groupBy("hub", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = cut_lineage(placed.join(sizes, ["hub", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), "parts")).drop("parts", "far"))
    blocks = placed.select("hub", "cell", "block").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    reach = _reach(percent)
    meet = x.join(
        y,
        (F.col("x.hub") == F.col("y.hub"))
        & (F.col("y.cell") - F.col("x.cell")).between(0, reach)
        & ((F.col("x.cell") < F.col("y.cell")) | (F.col("x.block") <= F.col("y.block"))),
    ).select(F.struct("x.*").alias("left"), F.struct("y.*").alias("right"))
    first = meet.select("left", "right", F.lit(0).alias("side"), "left.*")
    second = meet.filter("left <> right").select("left", "right", F.lit(1).alias("side"), "right.*")
    dealt = first.unionByName(second).join(placed, ["hub", "cell", "block"])
    rows = dealt.join(texts, dealt["node"] == texts["doc_id"]).select(
        F.xxhash64("left", "right").alias("task"), "left", "right", "side", "node", "component", "n_shingles", "private", "text"
    )

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets([(t or "").encode() for t in block["text"]], width)
        size, own = block["n_shingles"].to_numpy(), block["private"].to_numpy()
        side, parts = block["side"].to_numpy(), block["component"].to_numpy()
        most = np.minimum.outer(size - own, size - own)
        may = 100 * most >= percent * (np.add.outer(size, size) - most)
        may &= np.not_equal.outer(parts, parts)
        may &= np.less.outer(side, side) if side.any() else np.triu(np.ones_like(may), 1)
        alike: dict[int, int] = {}

        def root(part: int) -> int:
            while part in alike:
                part = alike[part]
            return part

        found = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(may))):
            a, b = root(int(parts[i])), root(int(parts[j]))
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                alike[a] = b
                found.append((int(block["node"].iloc[i]), int(block["node"].iloc[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("task", "left", "right").applyInPandas(compare, "a long, b long")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group, the one of the smallest doc_id; same columns.

    A row stays or goes by its own text, whatever other rows bear its doc_id.
    """
    ship_package(docs.sparkSession)
    signed = cut_lineage(signatures(docs, width))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not _ids_repeat(signed):
        gone = _groups(docs, signed, width, percent).filter(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    row = fresh_name(docs.columns, "row")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = _row_groups(plain, width, percent).filter(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*columns)
