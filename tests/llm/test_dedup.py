from __future__ import annotations

import hashlib
import math
import time
from itertools import compress

import pytest
import texts
from pyspark.sql import functions as F

from tracelode.llm import exchange, line_dedup, near_dedup, quality_rules, substring_dedup


@pytest.mark.parametrize("width,seed", [(13, 5), (5, 6), (4, 7)])
def test_substrings_match_brute_force(spark, width, seed):
    rows = texts.corpus(seed)
    want = texts.repeats(rows, width)
    got = {r.doc_id: r for r in substring_dedup.find_repeats(texts.frame(spark, rows), width).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        found = texts.words(text)
        kept = " ".join(compress(found, [i not in want[k] for i in range(len(found))]))
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text) == (len(found), len(want[k]), kept)
        assert got[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        covered = {i for s in got[k].spans for i in range(s.start, s.start + s.n_words)}
        assert covered == want[k]


def test_substrings_over_many_small_chunks(spark, monkeypatch):
    rows = texts.corpus(9, 60)
    want = texts.repeats(rows, 13)
    docs = texts.frame(spark, rows).withColumn("ids", F.lit("x")).withColumn("chunk_id", F.lit(1)).withColumn("data", F.lit(b"y"))
    monkeypatch.setattr(exchange, "bucket_bits", lambda chunks: 9)
    got = {r.doc_id: r.n_removed for r in substring_dedup.find_repeats(docs.repartition(20)).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_substrings_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (4, text), (4, text), (2, text), (None, None), (7, "　a b")]
    got = substring_dedup.find_repeats(texts.frame(spark, rows)).collect()
    removed = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in got)
    assert removed == [(False, 2, 20, 0), (False, 4, 20, 20), (False, 4, 20, 20), (False, 7, 2, 0), (True, 0, 0, 0), (True, 0, 20, 20)]
    assert substring_dedup.find_repeats(texts.frame(spark, [])).collect() == []


@pytest.mark.parametrize("width,percent,seed", [(3, 85, 5), (5, 80, 6), (1, 60, 8)])
def test_near_groups_match_brute_force(spark, width, percent, seed):
    rows = texts.corpus(seed)
    want = texts.near_components(rows, width, percent)
    got = {r.doc_id: r for r in near_dedup.near_groups(texts.frame(spark, rows), width, percent).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (k == want[k]) and r.n_shingles == len(texts.shingles(dict(rows)[k], width)) for k, r in got.items())


def test_links_that_miss_the_centre_are_found(spark):
    """A chain: each text is close to the next one only, and all share buckets with the first."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(30):
        changed = list(base)
        for i in range(4 * k):
            changed[i] = f"x{i}"
        rows.append((k, " ".join(changed)))
    rows += [(100 + k, " ".join(base[:150] + [f"z{k}_{i}" for i in range(50)])) for k in range(20)]
    want = texts.near_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(texts.frame(spark, rows), 3, 85).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_blocks_of_a_link_meet(percent):
    """Two members as far apart as a link allows, at any exact distance of one of them to the hub."""

    def cell(apart: int, union: int) -> int:
        return math.floor((1 - (union - apart) / union) * near_dedup._CELLS)

    for union in range(20, 400, 20):
        most = union * (100 - percent) // 100
        for apart in range(union - most + 1):
            for small in (k for k in range(1, union + 1) if apart * k % union == 0):
                assert cell(apart + most, union) - cell(apart * small // union, small) <= near_dedup._reach(percent)
    assert cell(3, 10) - cell(1, 10) == 11 and near_dedup._reach(80) >= 11


def test_near_groups_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (9, None), (8, ""), (7, "a")]
    docs = texts.frame(spark, rows).withColumn("component_id", F.lit(1)).withColumn("bucket", F.lit("b"))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == [(-1, -1, True), (2, 2, True), (3, 2, False), (3, 2, False), (7, 7, True), (8, 8, True), (9, 9, True)]
    assert near_dedup.near_groups(texts.frame(spark, [])).collect() == []
    assert sorted(r.doc_id or -1 for r in near_dedup.one_of_each(docs).collect()) == [-1, 2, 7, 8, 9]
    assert near_dedup.one_of_each(docs).columns == docs.columns


@pytest.mark.parametrize("seed", [5, 6])
def test_rows_that_share_an_id_are_judged_by_their_text(spark, seed):
    rows = [(None if k == 3 else k % 40, t) for k, t in texts.corpus(seed)]
    rows += [(50, rows[0][1]), (50, "a text of its own that no other row has"), (60, "tail " * 3 + "of that"), (3, "tail " * 3 + "of that")]
    parts = texts.near_components([(n, t if k is not None else None) for n, (k, t) in enumerate(rows)], 3, 85)
    names: dict[int, int] = {}
    for n, (k, _) in enumerate(rows):
        if k is not None:
            names[parts[n]] = min(names.get(parts[n], k), k)
    want = [(k, None if k is None else names[parts[n]], k is None or k == names[parts[n]]) for n, (k, _) in enumerate(rows)]
    docs = texts.frame(spark, rows).withColumn("row", F.lit("r"))
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs, 3, 85).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = [(k, t) for (k, t), (_, _, stays) in zip(rows, want) if stays]
    left = near_dedup.one_of_each(docs, 3, 85)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(kept, key=repr)


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = near_dedup.components(links).collect()
    assert len(got) == 201 and all(r.component == 0 for r in got)


@pytest.mark.parametrize("min_lines,min_words,seed", [(3, 50, 5), (2, 8, 6), (4, 1000, 7), (1, 1, 8)])
def test_lines_match_brute_force(spark, min_lines, min_words, seed):
    rows = texts.corpus(seed)
    want = texts.repeated_lines(rows, min_lines, min_words)
    docs = texts.frame(spark, rows)
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs, min_lines=min_lines, min_words=min_words, figures=True).collect()}
    for k, text in rows:
        lines = (text or "").split("\n")
        left = "\n".join(x for i, x in enumerate(lines) if i not in want[k])
        assert (got[k].n_lines, got[k].n_removed_lines) == (len(lines), len(want[k]))
        assert got[k].text == (text if not want[k] else left)


def test_lines_of_odd_rows(spark):
    text = "a b\nc d\n\ne f\nlast"
    rows = [(5, text), (5, text), (None, text), (1, None), (2, ""), (3, "\n\n"), (6, "c d\ne f\nlast\nnew")]
    docs = texts.frame(spark, rows).withColumn("n_lines", F.lit(9)).withColumn("idx", F.lit("i")).withColumn("n_chars", F.length("text"))
    got = line_dedup.deduplicate(docs, figures=True)
    assert got.columns == [*docs.columns, "n_lines_", "n_removed_lines"]
    kept = sorted((r.doc_id or -1, r.text, r.n_removed_lines) for r in got.collect() if r.text is not None)
    # The null id sorts first, so its copy stays; equal rows are one document.
    assert kept == [(-1, text, 0), (2, "", 0), (3, "\n\n", 0), (5, "", 4), (5, "", 4), (6, "new", 3)]
    assert line_dedup.deduplicate(texts.frame(spark, [])).collect() == []


def test_runs_are_maximal(spark):
    shared = "\n".join(f"line {i}" for i in range(9))
    rows = [(1, "x\n" + shared + "\ny"), (2, "p\nq\n" + shared), (3, shared + "\nz\n" + shared)]
    got = {(r.doc_id, r.start, r.n_lines, r.first_doc_id, r.first_start) for r in line_dedup.repeated_runs(texts.frame(spark, rows)).collect()}
    assert got == {(2, 2, 9, 1, 1), (3, 0, 9, 1, 1), (3, 10, 9, 1, 1)}


def test_texts_of_many_lines_take_linear_time(spark):
    """Lines, copies and lost lines of one text are found by sorting, and its code is made once."""

    def seconds(n):
        rows = [(1, "\n".join(["The same line of words, again and again."] * n)), (2, "\n".join(f"Line {k} of words, {k}." for k in range(n)))]
        docs = texts.frame(spark, rows)
        began = time.monotonic()
        lines = {r.doc_id: r for r in line_dedup.line_digest(docs).collect()}
        judged = {r.doc_id: r for r in quality_rules.verdict_digest(docs).collect()}
        took = time.monotonic() - began
        # Every window but the one at the first line repeats an earlier one.
        assert [(r.n_lines, r.n_removed_lines) for r in (lines[1], lines[2])] == [(n, n - 1), (n, 0)]
        assert lines[2].kept_sha256 == hashlib.sha256(rows[1][1].encode()).hexdigest()
        assert (judged[1].n_dup_lines, judged[1].n_removed_lines, judged[2].n_dup_lines) == (n - 1, n - 1, 0)
        return took

    seconds(1000)
    assert seconds(40_000) < 3 * seconds(5000) + 5
