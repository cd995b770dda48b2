"""Line deduplication by a suffix array over line codes, ordered by distributed prefix doubling.

Every line with a word gets two 64-bit codes; a document is the sequence of its lines' codes. Level k of
the array holds, for each line that starts a sequence of k lines seen at least twice, the rank of that
sequence in lexicographic order. Level 2k pairs the rank at a line with the rank k lines further on, any
other length pairs two overlapping ranks, and sequences that are left alone drop out, so work shrinks
with each level. Suffixes of equal rank at level k are an interval whose longest common prefix is at
least k lines. The first suffix of the interval in (doc_id, text code, line) order is the one that stays;
all lines of the other ones within k are deleted. Maximal repeated runs are unions of such windows.

A run counts if it has `min_lines` lines, or `min_words` words in fewer lines; so sorting to depth
`min_lines` decides, and no deeper level is needed. Lines without a word stay and do not part runs.

Spark SQL functions only. Ranks are dealt by range over the distinct sequences, so a line that a third of
all documents share is one row there; the joins back to the lines can be split by the planner, and no
group is collected (only a document's own line numbers are). Levels are written to the shared folder.

Null text: no lines. Null doc_id: sorts first and is a document like any other. Rows that repeat doc_id
and text are one document and get the same result; rows that share doc_id alone are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.columns import fresh_name, has_word, let, text_lines, words
from tracelode.session import cut_lineage

POSITION = ("doc_id", "text_code", "idx")


def _numbered_lines(text: Column) -> Column:
    """Lines with a word as (line, line number), in order."""
    rows = F.transform(text_lines(text), lambda line, i: F.struct(line.alias("line"), i.alias("line_no")))
    return F.filter(rows, lambda cell: has_word(cell["line"]))


def code_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_code, idx (among lines with a word), code_a, code_b, n_words; a row for each line."""
    # The code is made before the lines are: beside posexplode it would be worked out from the whole text for each line.
    coded = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_code"),
        _numbered_lines(F.col(text)).alias("cells"),
    )
    rows = coded.select("doc_id", "text_code", F.posexplode("cells").alias("idx", "cell"))
    line = F.col("cell")["line"]
    return rows.select(
        *POSITION,
        F.xxhash64(line).alias("code_a"),
        F.xxhash64(F.lit(11), line).alias("code_b"),
        F.size(words(line)).alias("n_words"),
    )


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct `keys` with `name`, their place in sorted order; one small row per range crosses tasks."""
    placed = cut_lineage(classes.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range").agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return placed.join(F.broadcast(offsets), "_range").withColumn("name", F.col("_before") + inside).drop("_range", "_before")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values of two or more rows, ranked, with their first position."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*POSITION)).alias("first"))
    return _ranked(found.filter(F.col("_n") > 1).drop("_n"), keys)


def suffix_levels(lines: DataFrame, min_lines: int) -> dict[int, DataFrame]:
    """For k = 1 .. min_lines: lines that start a repeated sequence of k lines, with its rank and first copy."""
    keys = ["code_a", "code_b"]
    base = lines.join(_repeated(lines, keys), keys).drop(*keys).dropDuplicates(list(POSITION))
    by_document = Window.partitionBy("doc_id", "text_code").orderBy("idx")
    for k in range(1, min_lines):
        base = base.withColumn(f"words_{k}", F.sum("n_words").over(by_document.rangeBetween(0, k - 1)))
    levels = {1: cut_lineage(base.drop("n_words"))}
    for k in range(2, min_lines + 1):
        half = 1 << ((k - 1).bit_length() - 1)
        known = levels[half].drop("first")
        other = F.max("name").over(by_document.rangeBetween(k - half, k - half))
        paired = known.withColumn("right", other).withColumnRenamed("name", "left")
        paired = cut_lineage(paired.filter(F.col("right").isNotNull()))
        levels[k] = cut_lineage(paired.join(_repeated(paired, ["left", "right"]), ["left", "right"]).drop("left", "right"))
    return levels


def later_copies(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """doc_id, text_code, idx, n_lines, first: windows that repeat an earlier one and are to be deleted."""
    found = None
    for k, level in suffix_levels(code_lines(docs), min_lines).items():
        late = level.filter(F.col("first") < F.struct(*POSITION))
        if k < min_lines:
            late = late.filter(F.col(f"words_{k}") >= min_words)
        late = late.select(*POSITION, F.lit(k).alias("n_lines"), "first")
        found = late if found is None else found.unionByName(late)
    return found


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Maximal runs: doc_id, text_code, start, n_lines, first_doc_id, first_start, for every later copy.

    Windows whose first copies move on line by line in one document belong to one run.
    """
    late = later_copies(docs, min_lines, min_words)
    shift = F.col("idx") - F.col("first.idx")
    chain = Window.partitionBy("doc_id", "text_code", "first.doc_id", "first.text_code", "shift").orderBy("idx", "n_lines")
    reach = F.max(F.col("idx") + F.col("n_lines")).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    marked = late.withColumn("shift", shift).withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("idx")).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(
        "doc_id", "text_code", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_code").alias("first_text_code"), "shift", "run"
    ).agg(F.min("idx").alias("start"), F.max(F.col("idx") + F.col("n_lines")).alias("stop"))
    return grouped.select(
        "doc_id", "text_code", "start", (F.col("stop") - F.col("start")).alias("n_lines"),
        "first_doc_id", (F.col("start") - F.col("shift")).alias("first_start"),
    )


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 3, min_words: int = 50, figures: bool = False
) -> DataFrame:
    """`docs` without the later copies of repeated runs; `n_chars` follows if there.

    With `figures`, n_lines and n_removed_lines are added (renamed if taken).
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = later_copies(plain, min_lines, min_words)
    # A document's own line numbers, bounded by its text.
    gone = (
        windows.select("doc_id", "text_code", F.explode(F.sequence("idx", F.col("idx") + F.col("n_lines") - 1)).alias("idx"))
        .groupBy("doc_id", "text_code").agg(F.collect_set("idx").alias("gone"))
    )
    n_lines, n_removed, code, lost, there = (
        fresh_name(docs.columns, n) for n in ("n_lines", "n_removed_lines", "_text_code", "_gone", "_there")
    )
    gone = gone.select(F.col("doc_id").alias(there), F.col("text_code").alias(code), F.col("gone").alias(lost))
    coded = docs.withColumn(fresh_name(docs.columns, "_code"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    own = coded.columns[-1]
    joined = coded.join(gone, (coded[doc_id].eqNullSafe(gone[there])) & (coded[own] == gone[code]), "left")
    # Numbers of lost lines among the lines with a word become numbers among all lines.
    numbered = F.transform(_numbered_lines(F.col(text)), lambda cell: cell["line_no"])
    dropped = let(numbered, lambda held: F.transform(F.col(lost), lambda i: F.get(held, i)))
    # One sort puts a lost line's mark behind its number; numbers without a mark are the lines that stay.
    every = F.transform(text_lines(F.col(text)), lambda line, i: F.struct(i.alias("i"), F.lit(0).alias("mark")))
    marked = F.sort_array(F.concat(every, F.transform(dropped, lambda i: F.struct(i.alias("i"), F.lit(1).alias("mark")))))

    def unmarked(cells: Column) -> Column:
        stays = F.transform(
            cells, lambda cell, k: F.when((cell["mark"] == 0) & (F.coalesce(F.get(cells, k + 1)["mark"], F.lit(0)) == 0), cell["i"])
        )
        return F.filter(stays, lambda i: i.isNotNull())

    kept = let(text_lines(F.col(text)), lambda lines: F.transform(let(marked, unmarked), lambda i: F.get(lines, i)))
    joined = joined.withColumn(n_lines, F.size(text_lines(F.col(text))).cast("long"))
    joined = joined.withColumn(n_removed, F.coalesce(F.size(F.col(lost)), F.lit(0)).cast("long"))
    out = joined.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([n_lines, n_removed] if figures else []))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines and the digest of the text that stays, for every row of `docs`."""
    kept = deduplicate(docs.select("doc_id", "text"), figures=True)
    return kept.select(
        "doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
