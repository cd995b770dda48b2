"""Postings, the gram index and pruned ranking against scoring every pair."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelode.operators import postings, retrieval

WORDS = ("red", "ring", "plate", "bolt", "brand", "test", "box", "hot_bolt", "économie")


def _symbols(spark, size=300, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(size):
        module = draw.choice(("economy/", "tests/test_", "small/")) + draw.choice(WORDS)
        scope = draw.choice(("", "Holder.", "RingBox."))
        name = draw.choice(("", "_", "stub_")) + "_".join(draw.sample(WORDS, draw.randint(1, 3)))
        # Names repeat, so that several symbols share one.
        rows.append((k, f"{module}.{scope}{name}", module, draw.choice(("class", "function", "constant")), module + ".py",
                     draw.choice((None, "doc")), "x = 1\n" * draw.choice((0, 3, 60, 200)), "def f()", draw.random() < 0.1))
    schema = (
        "symbol_id long, qualified_name string, module string, symbol_type string, path string, docstring string, "
        "source string, signature string, in_init boolean"
    )
    return retrieval.prepare_symbols(spark.createDataFrame(rows, schema).repartition(4))


def _queries(spark, size=25, seed=2):
    draw = random.Random(seed)
    rows = [(k, " ".join(draw.choice((*WORDS, "RingBox", "Holder", "zz", "économie", "tests")) for _ in range(draw.randint(1, 5))), draw.choice((1, 3, 20)))
            for k in range(size)]
    rows += [(900, "red ring", 0), (901, "?!", 5), (902, "nothingofthis", 4), (903, "brand", 400)]
    return retrieval.prepare_queries(spark.createDataFrame(rows, "query_id long, text string, max_symbols int"))


@pytest.fixture(scope="module")
def parts(spark):
    symbols, queries = _symbols(spark).cache(), _queries(spark).cache()
    found = postings.token_postings(postings.asked_tokens(queries), symbols).cache()
    return symbols, queries, found


def test_postings_hold_every_token_inside_a_symbol(spark, parts):
    symbols, queries, found = parts
    tokens = {t for r in queries.collect() for t in r["tokens"]}
    wanted = set()
    for s in symbols.collect():
        place = f"{s['lname']} {s['lmodule']} {s['phrases']}"
        wanted |= {(t, s["symbol_id"]) for t in tokens if t in place}
    got = [(r["token"], r["symbol_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_no_score_is_above_its_bound(spark, parts):
    symbols, queries, found = parts
    scored = postings.score_symbols(queries, symbols, found)
    impacts = postings.impact_postings(found)
    blocks = postings.impact_blocks(impacts, queries, found)
    bounds = blocks.join(impacts, ["token", "wants_tests", "impact"]).groupBy("query_id", "symbol_id").agg(F.max("bound").alias("bound"))
    joined = scored.join(bounds, ["query_id", "symbol_id"], "left")
    assert joined.count() == scored.count() > 1000
    assert joined.where("bound IS NULL OR score > bound").count() == 0


def test_top_rows_are_those_of_the_full_ranking(spark, parts):
    symbols, queries, found = parts
    scored = {(r["query_id"], r["symbol_id"]): (r["score"], r["reasons"]) for r in postings.score_symbols(queries, symbols, found).collect()}
    wanted = {}
    known = symbols.collect()
    for q in queries.collect():
        names: dict[str, list] = {}
        for s in known:
            base = s["base"] + ((75 if q["wants_tests"] else -50) if s["is_test"] else 0)
            score, _ = scored.get((q["query_id"], s["symbol_id"]), (base, None))
            if score >= 1 and q["tokens"]:
                names.setdefault(s["qualified_name"], []).append(score)
        ranked = sorted(names, key=lambda n: (-max(names[n]), n))[: q["max_symbols"]]
        for rank, name in enumerate(ranked, 1):
            wanted[q["query_id"], rank] = (name, max(names[name]))
    top = retrieval.top_k(queries, symbols, found).collect()
    assert {(r["query_id"], r["rank"]): (r["qualified_name"], r["score"]) for r in top} == wanted
    for r in top:
        mine = [scored[r["query_id"], s["symbol_id"]][1] for s in known
                if s["qualified_name"] == r["qualified_name"] and scored.get((r["query_id"], s["symbol_id"]), (0,))[0] >= 1]
        assert {reason for reasons in mine for reason in reasons} <= set(r["reasons"])


def test_blocks_below_the_kth_score_stay_closed(spark, parts, monkeypatch):
    symbols, queries, found = parts
    opened = []
    plain = postings.pairs_of
    monkeypatch.setattr(postings, "pairs_of", lambda blocks, impacts: opened.append(plain(blocks, impacts)) or opened[-1])
    few = queries.where("max_symbols BETWEEN 1 AND 3")
    retrieval.top_k(few, symbols, found).collect()
    assert opened[-1].count() < 0.5 * postings.score_symbols(few, symbols, found).count()


def test_a_written_index_opens_only_asked_buckets(spark, parts, tmp_path):
    symbols, queries, found = parts
    path = str(tmp_path / "grams")
    postings.write_gram_index(symbols, path)
    assert {p.name for p in Path(path).glob("bucket=*")} <= {f"bucket={k}" for k in range(postings.INDEX_BUCKETS)}
    tokens = spark.createDataFrame([("ring",), ("bolt",)], "token string")
    index = postings.read_gram_index(spark, path, tokens)
    assert 1 <= index.select("bucket").distinct().count() <= 2
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    kept = lambda df: sorted(tuple(r) for r in df.collect())
    assert kept(postings.token_postings(tokens, symbols, index)) == kept(found.where("token IN ('ring', 'bolt')"))


def test_no_symbol_text_is_shuffled_by_gram(spark, parts):
    symbols, queries, _ = parts
    listed = postings.gram_index(symbols)
    assert listed.columns == ["bucket", "gram", "symbol_id"]


def test_pairs_are_scored_where_their_symbol_is(spark, parts):
    symbols, queries, found = parts
    scored = postings.score_symbols(queries, symbols, found)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol_id" in plan and "hashpartitioning(query_id" not in plan
    every = found.select("token", "symbol_id").distinct().join(postings.asked_tokens(queries), "token")
    assert scored.count() == every.select("query_id", "symbol_id").distinct().count()


def test_candidates_are_ranked_where_their_names_are(parts, monkeypatch):
    symbols, queries, found = parts
    monkeypatch.setattr(postings, "ROWS_PER_TASK", 50)  # many parts
    ranked = retrieval.rank_candidates(queries, symbols, found)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(query_id" not in plan  # no pair is shuffled
    scored = postings.score_symbols(queries, symbols, found).where("score >= 1")
    names = {}
    for row in retrieval.best_per_name(scored, ["query_id"]).collect():
        names.setdefault(row["query_id"], []).append((-row["score"], row["qualified_name"].encode(), row["symbol_id"], row["reasons"]))
    want = {(q, n.decode(), s, i + 1, tuple(r)) for q, listed in names.items() for i, (_, n, s, r) in enumerate(sorted(listed))}
    got = [(r["query_id"], r["qualified_name"], r["symbol_id"], r["rank"], tuple(r["reasons"])) for r in ranked.collect()]
    assert len(got) == len(want) and set(got) == want


def test_first_symbols_of_modules_need_no_row_for_each_symbol(spark, parts):
    symbols, queries, found = parts
    wanted = queries.select("query_id").crossJoin(symbols.select("module").distinct())
    rows = wanted.join(symbols.select("symbol_id", "module"), "module").select("query_id", "symbol_id")
    own = {(r["query_id"], r["symbol_id"]): r["score"] for r in postings.score_pairs(rows, queries, symbols, found).collect()}
    best = {}
    for q in queries.collect():
        for s in symbols.collect():
            points = (postings.TEST_WANTED if q["wants_tests"] else postings.TEST_CODE) if s["is_test"] else 0
            score = own.get((q["query_id"], s["symbol_id"]), s["base"] + points)
            key, cell = (q["query_id"], s["module"]), (-score, s["qualified_name"])
            if score >= retrieval.MINIMUM_SCORE:
                best[key] = min(best.get(key, cell), cell)
    got = retrieval._best_of_modules(wanted, queries, symbols, found).collect()
    assert {(r["query_id"], r["module"]): (-r["score"], r["qualified_name"]) for r in got} == best
    assert postings.score_modules(wanted, queries, symbols, found).count() < rows.count()


def test_top_rows_are_found_without_reasons_of_every_pair(parts, monkeypatch):
    symbols, queries, found = parts
    explained = []
    full = postings.score_pairs

    def score_pairs(pairs, *rest):
        explained.append(pairs.count())
        return full(pairs, *rest)

    monkeypatch.setattr(postings, "score_pairs", score_pairs)
    top = retrieval.top_k(queries, symbols, found)
    named = top.join(symbols.select("qualified_name", F.col("symbol_id").alias("id")), "qualified_name").count()
    assert explained == [named]


def test_lines_with_text_are_counted(spark):
    sources = ["", None, "\n \n", "a", " a\n\n\tb \n", "a\r\n \r\nb", "\n" * 60 + "x\n" * 50, "x\n" * 51, " x y\n" * 101]
    rows = [(n, "m.f", "m", "constant", "m.py", None, s, "", False) for n, s in enumerate(sources)]
    schema = (
        "symbol_id long, qualified_name string, module string, symbol_type string, path string, docstring string, "
        "source string, signature string, in_init boolean"
    )
    got = retrieval.prepare_symbols(spark.createDataFrame(rows, schema)).orderBy("symbol_id").collect()
    lines = [sum(bool(line.strip(" \t\r")) for line in (s or "").split("\n")) for s in sources]
    assert [r["base"] - retrieval.PUBLIC_NAME for r in got] == [15 if 0 < n <= 50 else -5 if n > 100 else 0 for n in lines]


def test_only_edges_that_end_at_a_pair_are_kept(spark, monkeypatch):
    cuts = []
    plain = retrieval.cut_lineage

    def cut(df):
        cuts.append((df.columns, [tuple(r) for r in df.collect()]))
        return plain(df)

    monkeypatch.setattr(retrieval, "cut_lineage", cut)
    pairs = [(1, "a", "m", "b", "m"), (1, "a", "m", "c", "n"), (2, "b", "m", "d", "n"), (2, "b", "m", "b", "m")]
    edges = [("a", "b", "calls"), ("c", "a", "calls"), ("p", "b", "defines"), ("p", "d", "defines"), ("x", "y", "calls"), ("a", "c", "imports")]
    pairs = spark.createDataFrame(pairs, "query_id long, primary string, primary_module string, qualified_name string, module string")
    got = retrieval.score_relationship(pairs, spark.createDataFrame(edges, "source string, target string, type string"))
    scores = {(r["query_id"], r["qualified_name"]): r["relation_score"] for r in got.collect()}
    assert scores == {(1, "b"): 50, (1, "c"): 30, (2, "d"): 20}
    assert sorted(cuts[-1][1]) == [("a", "b", "calls"), ("c", "a", "calls"), ("p", "b", "defines"), ("p", "d", "defines")]
