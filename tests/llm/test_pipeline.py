from __future__ import annotations

import duckdb
import pytest
import texts
from pyspark.sql import functions as F

import corpus_pipeline
from tools.check_oracle import TABLES, canonical_rows
from tracelode.llm import quality_rules
from tracelode.llm.queries import ORACLES, QUERIES, TARGETS

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows = [tuple(row) for row in frame.collect()]
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    wanted = connection.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert canonical_rows(frame.columns, rows) == canonical_rows(wanted.columns, wanted.fetchall())


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, benchmark and labels of a small corpus, with documents the rules reject."""
    folder = tmp_path_factory.mktemp("tables")
    rows = texts.corpus(5) + [(500 + k, "CHEAP!! BUY!! NOW!! ONLY!! TODAY!! COME!! IN!! GO!! YES!! OK!! DO!!\n" * 3) for k in range(4)]
    docs = texts.frame(spark, rows).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    quoted = [(k, " ".join(texts.words(rows[20 + k][1])[:25])) for k in range(5)]
    spark.createDataFrame(quoted, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    want = [(r.doc_id, r.text) for r in quality_rules.clean(documents).collect()]
    gone = texts.repeated_lines(want, 3, 50)
    want = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) if gone[k] else t) for k, t in want]
    group = texts.near_components(want, 5, 80)
    want = [(k, t) for k, t in want if group[k] == k]
    want = [(k, t) for k, t in want if not texts.leaks(t, items)[1]]
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == documents.columns
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert 0 < len(want) < documents.count()
    result = corpus_pipeline.run(spark, tables).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in result) == sorted((k, len(texts.words(t))) for k, t in want)
    assert all(r.rate >= 0 and abs(sum(r[f"p_{k}"] for k in TARGETS) - 1) < 1e-9 for r in result)


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "mixing"]
