"""Small fixtures with results worked out by hand."""

from __future__ import annotations

import os
import statistics

import pandas as pd
from pyspark.sql import functions as F

from tracelode import schemas
from tracelode.functions import text
from tracelode.functions.ordered import previous_value, running_sum, sorted_ordinal
from tracelode.functions.stats import distribution, round_half_even
from tracelode.operators import checks, conversations, graph, graph_walk, mining, quality, responses, sessions
from tracelode.operators.responses import DONE
from tracelode.sources import files, logs
from tracelode.streaming import jobs


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def message(conv, turn, role, content, calls=None, answers=None):
    listed = [(c, ("f", "")) for c in calls] if calls else None
    return (conv, turn, role, content, None, None, None, listed, answers)


def test_distribution_is_exact_for_skewed_and_negative_values(spark):
    values = [-3.5, -1.0, 0.0, 0.0, 1.0, 2.25, 7.0, 1000.0, 1001.0, 1e9] * 3 + [5.0] * 50
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    got = distribution(df, ["g"], {"v": F.col("v")}, {"median": 0.5, "p90": 0.9}).first()
    assert got["n"] == len(values)
    assert got["median"] == statistics.median(values)
    ordered = sorted(values)
    k = (len(ordered) - 1) * 0.9
    low = ordered[int(k)]
    assert abs(got["p90"] - (low + (ordered[int(k) + 1] - low) * (k - int(k)))) < 1e-9


def test_round_half_even_uses_the_stored_value(spark):
    df = spark.createDataFrame([(0.475,), (0.765,), (0.125,), (0.5,)], "v double")
    got = [r[0] for r in df.select(round_half_even(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in (0.475, 0.765, 0.125, 0.5)]


def test_blocked_windows_do_not_depend_on_block_size_or_partitioning(spark):
    base = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("p"), (F.col("id") % 7).alias("v"))
    results = []
    for df, size in ((base, 16), (base.repartition(7, "v"), 100000)):
        summed = running_sum(df, ["g"], "p", F.col("v"), "s", descending=True, size=size)
        lagged = previous_value(summed, ["g"], "p", F.col("v"), "before", size=size)
        results.append(rows(lagged.na.fill(-1), "g", "p", "s", "before"))
    assert results[0] == results[1]
    placed = sorted_ordinal(base, ["g"], [(F.col("v"), True), (F.floor(F.col("p") / 50), False)], [F.col("p")], "n")
    want = {}
    for g in range(3):
        members = sorted((-(p % 7), p) for p in range(1000) if p % 3 == g)
        want.update({p: i + 1 for i, (_, p) in enumerate(members)})
    assert {r["p"]: r["n"] for r in placed.collect()} == want


def test_history_cap_example(spark):
    body = "x" * 40
    turns = [message(1, 0, "system", "s")] + [
        message(1, i, "user" if i % 2 else "assistant", body) for i in range(1, 6)
    ]
    df = spark.createDataFrame(turns, schemas.MESSAGES)
    capped = conversations.history_cap(df, 25)
    assert rows(capped.where("kept"), "turn") == [(0,), (3,), (4,), (5,)]
    summary = conversations.history_cap_summary(capped).first()
    assert (summary["kept"], summary["dropped"]) == (4, 2)


def test_tool_groups_follow_chains_of_shared_ids(spark):
    turns = [
        message(1, 0, "assistant", "a", calls=["x"]),
        message(1, 1, "tool", "r", answers="x"),
        message(1, 2, "assistant", "b", calls=["x", "y"]),
        message(1, 3, "tool", "r", answers="x"),
        message(1, 4, "tool", "r", answers="y"),
        message(1, 5, "assistant", "c", calls=["z"]),
        message(1, 6, "user", "u"),
    ]
    df = spark.createDataFrame(turns, schemas.MESSAGES)
    got = dict(rows(conversations.tool_groups(df), "turn", "group_turn"))
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6}


def test_intent_sees_phrases_and_negations_over_message_edges(spark):
    df = spark.createDataFrame(
        [
            message(1, 0, "user", "tell me how"), message(1, 1, "user", "does it go"),
            message(2, 0, "user", "please never"), message(2, 1, "user", "explain it, add one"),
            message(3, 0, "user", "do"), message(3, 1, "user", "not fix a thing"),
            message(4, 0, "user", "refactoring  plan, then explain"),
        ],
        schemas.MESSAGES,
    )
    got = {r["conv_id"]: (r["intent"], r["keyword"]) for r in conversations.intent_label(df).collect()}
    assert got == {
        1: ("EXPLAIN", "how does"), 2: ("IMPLEMENT", "add"), 3: ("DEFAULT", ""), 4: ("REFACTOR", "refactor"),
    }
    custom = conversations.intent_label(df, {"search": ["one"]})
    assert ("SEARCH", "custom:one") in [(r["intent"], r["keyword"]) for r in custom.collect()]


def test_intent_phrases_over_many_messages(spark):
    """Labels of split texts are those of the joined text, wherever it is cut."""
    custom = {"test": ["alpha beta gamma delta epsilon"], "search": ["where is it"]}
    joined = [
        "please alpha beta gamma delta epsilon now", "so where is it then", "do not add it", "never fix how does it go",
        "don't where is it alpha beta gamma delta", "x refactoring plan y", "modify files", "please do not refactor plan ok",
        "nothing to see", "never never add one",
    ]
    split, whole = [], []
    for k, sentence in enumerate(joined):
        parts = sentence.split()
        for style, size in enumerate((1, 2, 3)):
            pieces = [" ".join(parts[i : i + size]) for i in range(0, len(parts), size)]
            split += [message(10 * k + style, 5000 * n, "user", piece) for n, piece in enumerate(pieces)]
            whole.append(message(10 * k + style, 0, "user", sentence))
    label = lambda data: {
        r["conv_id"]: (r["intent"], r["keyword"])
        for r in conversations.intent_label(spark.createDataFrame(data, schemas.MESSAGES), custom).collect()
    }
    got = label(split)
    assert got == label(whole)
    assert got[0] == ("TEST", "custom:alpha beta gamma delta epsilon") and got[10] == ("SEARCH", "custom:where is it")


def test_cycles_of_equal_first_module_and_size_stay_apart(spark):
    members = spark.createDataFrame(
        [(1, "n1", "pkg/a"), (1, "n2", "pkg/b"), (2, "n3", "pkg/a"), (2, "n4", "pkg/c"), (3, "n5", "pkg/b"), (3, "n6", "pkg/a")],
        "cycle_id long, node string, module string",
    )
    sets = graph.cycle_module_sets(members).collect()
    assert len(sets) == 2 and all(r["modules"].startswith("pkg/a +1 #") for r in sets)
    listed = {}
    for r in graph.cycle_modules(members).collect():
        listed.setdefault(r["modules"], set()).add(r["module"])
    assert sorted(map(sorted, listed.values())) == [["pkg/a", "pkg/b"], ["pkg/a", "pkg/c"]]


def test_whole_bodies_and_errors_of_any_shape(spark):
    lines = [
        (1, 0, '{"choices":[{"message":{"content":"hello"}}]}'), (2, 0, 'data: {"error":"boom"}'),
        (3, 0, 'data: {"error":{"message":"told"}}'), (4, 0, 'data: {"error":{"code":5}}'),
        (5, 1, 'data: {"choices":[{"delta":{"content":"b"}}]}'), (5, 0, 'data: {"choices":[{"delta":{"content":"a"}}]}'),
    ]
    frame = spark.createDataFrame(lines, "request_id long, seq long, line string")
    got = {r["request_id"]: (r["answer"], r["error"]) for r in responses.assemble_responses(frame).collect()}
    assert got == {1: ("hello", None), 2: ("", "boom"), 3: ("", "told"), 4: ("", '{"code":5}'), 5: ("ab", None)}


def test_nested_sources_give_an_error_fact(spark):
    files = spark.createDataFrame(
        [("deep", "x = " + "-" * 200000 + "1"), ("chain", "x = a" + ".b" * 100000), ("good", "def f():\n    g()\n")],
        "module string, content string",
    )
    facts = mining.facts_table(files)
    assert {r["module"] for r in mining.parse_errors(facts).collect()} <= {"deep", "chain"}
    assert [r["qualified_name"] for r in mining.symbols_of(facts).where("module = 'good'").collect()] == ["good.f"]


def test_streamed_answers_equal_batch_answers_over_many_batches(spark, tmp_path):
    parts = [
        [(1, 2, "C"), (2, 0, "x")], [(1, 1, "B"), (1, 3, DONE), (2, 1, "y"), (2, 2, DONE)],
        [(1, 0, "A"), (1, 0, "A"), (3, 0, "p"), (3, 2, DONE)], [(1, 3, DONE), (4, 0, DONE)],
        [(9, 0, "later"), (9, 1, DONE)], [(10, 0, "end"), (10, 1, DONE)],
    ]
    schema = "request_id long, seq long, text string, ts timestamp, prompt_tokens long, completion_tokens long, error string"
    for n, part in enumerate(parts):
        minutes = n * 3 if n < 4 else n * 60
        stamp = (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)).to_pydatetime()
        data = [(r, s, t, stamp, s * 10 if t != DONE else None, s, "bad" if (r, s) == (3, 0) else None) for r, s, t in part]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    folder = tmp_path / "all"
    folder.mkdir()
    for n in range(len(parts)):
        source = next((tmp_path / f"in{n}").glob("part-*.parquet"))
        target = folder / f"{n}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    session = jobs.local_session(spark)
    chunks = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = jobs.run_available(spark, jobs.response_state(chunks), "answers").collect()
    found = {r["request_id"]: (r["answer"], r["chunks"], r["finished"]) for r in got}
    assert len(got) == len(found)
    assert found == {
        1: ("ABC", 3, True), 2: ("xy", 2, True), 3: ("p", 1, False), 4: ("", 0, True), 9: ("later", 1, True), 10: ("end", 1, True),
    }
    one = {r["request_id"]: r for r in got}
    assert (one[1]["prompt_tokens"], one[3]["error"], one[2]["error"]) == (20, "bad", None)


def test_query_tokens_keep_form_order(spark):
    df = spark.createDataFrame([("where is ProviderFactory load_all",), ("what is the",), ("?!",)], "t string")
    got = [r[0] for r in df.select(text.query_tokens(F.col("t"))).collect()]
    assert got[0] == ["providerfactory", "provider", "factory", "load_all", "load", "all"]
    assert got[1:] == [["what", "is", "the"], []]


def test_components_cycles_and_depth(spark):
    edges = spark.createDataFrame(
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7), (7, 6), (8, 8), (9, 4)], "source long, target long"
    ).withColumn("type", F.lit("calls"))
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    parts = dict(rows(graph_walk.connected_components(nodes, edges), "node", "component"))
    assert parts == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 1, 6: 6, 7: 6, 8: 8, 10: 10}
    assert rows(graph_walk.dependency_cycles(edges), "cycle_id", "node") == [(1, 1), (1, 2), (1, 3), (6, 6), (6, 7)]
    depth = graph_walk.call_depth(nodes, edges).first()
    assert (depth["maximum_call_depth"], depth["cyclic_nodes"]) == (2, 6)
    seeds = spark.createDataFrame([(9,), (1,)], "seed long")
    reach = rows(graph_walk.transitive_reach(seeds, edges), "seed", "node", "distance")
    assert reach == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4), (9, 4, 1), (9, 5, 2)]


def test_dag_checks_find_cycles_and_stuck_nodes(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,)], "node long")
    deps = spark.createDataFrame([(2, 1), (3, 4), (4, 3), (5, 4), (2, 99)], "node long, depends_on long")
    got = rows(graph_walk.dag_checks(nodes, deps), "problem", "node")
    assert got == [
        ("cyclic", 3), ("cyclic", 4), ("duplicate", 5), ("never runs", 3), ("never runs", 4), ("never runs", 5),
        ("unknown dependency", 2), ("unreachable", 3), ("unreachable", 4), ("unreachable", 5),
    ]


def test_impact_prefers_near_reasons(spark):
    edges = spark.createDataFrame(
        [("r", "a", "defines"), ("a", "b", "defines"), ("b", "r", "calls"), ("c", "r", "imports")],
        "source string, target string, type string",
    )
    roots = spark.createDataFrame([("x", "r", 0)], "change_id string, root string, root_order int")
    got = rows(graph_walk.impact(roots, edges), "symbol", "distance", "reason")
    assert got == [("a", 1, "DEPENDENCY"), ("b", 1, "CALLER"), ("c", 1, "IMPORT")]
    deep = rows(graph_walk.impact(roots, edges, depth=-1), "symbol", "distance", "reason")
    assert deep == got


def test_self_caller_is_not_dead(spark):
    symbols = spark.createDataFrame(
        [("m.f", "f", "function", "a/m", 1, []), ("m.g", "g", "function", "a/m", 2, []), ("m.main", "main", "function", "m", 3, [])],
        "qualified_name string, name string, symbol_type string, module string, lineno long, decorators array<string>",
    )
    edges = spark.createDataFrame([("m.f", "m.f", "calls")], "source string, target string, type string")
    assert rows(graph.dead_symbols(symbols, edges), "qualified_name") == [("m.g",)]


def test_hunk_overlaps_against_pairs(spark):
    spans = [(i * 37 % 101, i % 6) for i in range(120)]
    df = spark.createDataFrame([("f", a, n) for a, n in spans], "file_path string, old_start long, old_count long")
    hit = {(r["old_start"], r["old_count"]) for r in graph.hunk_overlaps(df).collect()}
    want = set()
    order = sorted((a, a + n) for a, n in spans)
    for j, (a, b) in enumerate(order):
        if any(c < b and a < d for c, d in order[:j]):
            want.add((a, b - a))
    assert hit == want


def test_changed_lines_ignore_empty_hunks(spark):
    df = spark.createDataFrame([("f", 5, 0), ("f", 2, 2), ("f", 3, 2)], "file_path string, old_start long, old_count long")
    assert rows(checks.changed_lines(df), "line") == [(2,), (3,), (4,)]


def test_ignore_rules(spark):
    paths = ["a.pyc", "x/a.pyc", "out/b.py", "x/out/c.py", "doc/one.md", "x/doc/one.md", "keep.py", "node_modules/z.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = rows(files.ignore_filter(df, ("*.pyc", "out/", "/doc")), "path")
    assert kept == [("keep.py",), ("x/doc/one.md",)]


def test_log_lines_skip_blank_and_broken(spark):
    lines = ['{"request_id": "a", "status": "ok", "timing": {"total_ms": 2}}', "  ", '{"request_id": ', '{"request_id": "b", "status": "error"}']
    good, bad = logs.split_lines(logs.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert rows(good, "request_id") == [("a",), ("b",)]
    assert bad.count() == 1
    flat = sessions.clean_requests(good)
    assert rows(flat, "request_id", "intent", "conversation_key", "context_status") == [
        ("a", "DEFAULT", "__new__", "disabled"), ("b", "DEFAULT", "__new__", "disabled"),
    ]
    counts = sessions.status_counts(flat).first()
    assert (counts["total"], counts["ok"], counts["error"]) == (2, 1, 1)


def test_empty_log_gives_zeros(spark):
    empty = sessions.clean_requests(spark.createDataFrame([], schemas.REQUEST_LOG))
    got = sessions.latency_summary(empty).first()
    assert (got["total_n"], got["total_median"], got["total_max"]) == (0, 0.0, 0.0)


def test_calls_bind_in_priority_order(spark):
    source = [
        ("a", "class A:\n    def go(self):\n        self.stop()\n        help()\n    def stop(self): far()\ndef help(): pass\n"),
        ("b", "def far(): help()\ndef help(): pass\n"),
        ("c", "def far(): pass\nx = broken(\n"),
        ("d", "import a\nfrom b import far\ndef user(): far()\n"),
    ]
    facts = mining.extract_facts(spark.createDataFrame(source, "module string, content string"))
    calls = rows(mining.resolve_calls(mining.call_sites(facts), mining.symbols_of(facts)), "source", "target")
    assert calls == [
        ("a.A.go", "a.A.stop"), ("a.A.go", "a.help"), ("a.A.stop", "b.far"), ("b.far", "b.help"), ("d.user", "b.far"),
    ]
    assert rows(mining.parse_errors(facts), "module") == [("c",)]
    modules = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(mining.import_edges(mining.imports_of(facts), modules), "source", "target") == [("d", "a"), ("d", "b")]


def test_target_rank_meets_any_number_of_prefixes(spark):
    names = ["tests/a", "tests/b", "src/tests/c", "té", "", "src/d"]
    ranked = spark.createDataFrame(
        [(q, k + 1, n) for q in (1, 2) for k, n in enumerate(names + ["src/d"])], "query_id int, rank int, name string"
    )
    targets = spark.createDataFrame([(1, "src/d"), (2, "none")], "query_id int, name string")
    prefixes = ["tests/", "tests/a", "té", "src/x", None, "tests/abc"]
    for chosen in (prefixes, prefixes + [""], []):
        unwanted = spark.createDataFrame([(p,) for p in chosen], "prefix string")
        got = rows(quality.target_rank(ranked, targets, unwanted), "query_id", "name", "place", "repeated", "unwanted")
        bad = sum(any(p is not None and n.startswith(p) for p in chosen) for n in names)
        assert sorted(got) == [(1, "src/d", 5, 1, bad), (2, "none", -1, 1, bad)]


def _fans(spark):
    """Two fans joined by a call, ends known to several modules, two of them tests."""
    edges = [("a", f"x{i}", "calls") for i in range(40)] + [(f"y{i}", "a", "calls") for i in range(40)]
    edges += [(f"x{i}", f"z{i % 7}", "calls") for i in range(40)] + [("a", "x1", "imports"), ("x2", "a", "defines")]
    nodes = sorted({end for source, target, _ in edges for end in (source, target)})
    module = lambda n: f"tests/t{len(n) % 2}.py" if n[-1] in "37" else f"pkg/{n[0]}.py"
    symbols = [(n, n[0], "function", module(n), 1, []) for n in nodes]
    return (
        spark.createDataFrame([(n, n, 0) for n in nodes], "change_id string, root string, root_order int"),
        spark.createDataFrame(edges, "source string, target string, type string"),
        spark.createDataFrame(
            symbols, "qualified_name string, name string, symbol_type string, module string, lineno long, decorators array<string>"
        ),
    )


def test_impact_moves_lists_and_no_pair_of_change_and_symbol(spark, monkeypatch):
    roots, edges, _ = _fans(spark)
    impacted = graph_walk.impact(roots, edges)
    plan = impacted._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(change_id" in line]
    assert moved and not any("next" in line or "symbol" in line for line in moved)
    whole = rows(impacted, "change_id", "symbol", "distance", "reason")
    assert ("z0", "a", 2, "CALLER") in whole and ("x1", "a", 1, "CALLER") in whole
    monkeypatch.setattr(graph_walk, "PAIRS_OF_CHANGE", 50)  # changes above it are merged over several tasks
    monkeypatch.setattr(graph_walk, "LIST_SIZE", 3)
    assert rows(graph_walk.impact(roots, edges), "change_id", "symbol", "distance", "reason") == whole
    deeper = rows(graph_walk.impact(roots, edges, 4), "change_id", "symbol", "distance", "reason")
    assert deeper == rows(graph_walk.impact(roots, edges, -1), "change_id", "symbol", "distance", "reason")


def test_impact_report_counts_modules_without_a_join_of_the_pairs(spark):
    roots, edges, symbols = _fans(spark)
    owners = graph_walk.module_owners(symbols.where("qualified_name <> 'x5'"))
    impacted = graph_walk.impact(roots, edges, owners=owners)
    home = {r["symbol"]: r["module"] for r in owners.collect()}
    reached = {}
    for change, symbol, distance in rows(impacted, "change_id", "symbol", "distance"):
        reached.setdefault(change, []).append((symbol, distance))
    want = sorted(
        (change, len(hits), max(d for _, d in hits), len({home[s] for s, _ in hits if s in home}))
        for change, hits in reached.items()
    )
    report = graph_walk.impact_report(roots, impacted)
    assert rows(report, "change_id", "impacted_symbols", "max_distance", "impacted_modules") == want


def test_impacted_modules_leave_unknown_symbols_out(spark):
    roots, edges, symbols = _fans(spark)
    owners = graph_walk.module_owners(symbols.where("qualified_name <> 'a'"))
    got = rows(graph_walk.impacted_modules(graph_walk.impact(roots, edges, owners=owners)), "change_id", "module")
    assert [m for c, m in got if c == "y0"] == ["pkg/x.py", "tests/t0.py", "tests/t1.py"]
    assert [m for c, m in got if c == "z0"] == ["pkg/x.py", "tests/t0.py"]


def test_a_block_of_changes_gets_a_list_of_neighbours_once(spark, monkeypatch):
    roots, edges, _ = _fans(spark)
    written = []
    cut = graph_walk.cut_lineage

    def kept(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(graph_walk, "cut_lineage", kept)
    graph_walk.impact(roots, edges)
    sent = next(df for df in written if "places" in df.columns).where("distance = 2")
    assert 0 < sent.count() < sent.agg(F.sum(F.size("places"))).first()[0]
    blocks = next(df for df in written if df.columns[:2] == ["change_ids", "place"])
    ids = [r["change_id"] for r in blocks.orderBy("change_ids", "place").collect()]
    assert ids == sorted(ids, key=lambda n: (n[0], int(n[1:] or 0)))


def test_slices_of_a_block_change_no_report(spark, monkeypatch):
    roots, edges, symbols = _fans(spark)
    owners = graph_walk.module_owners(symbols.where("qualified_name <> 'x5'"))
    columns = ("change_id", "impacted_symbols", "max_distance", "impacted_modules")

    def results():
        impacted = graph_walk.impact(roots, edges.union(edges), owners=owners)
        return rows(graph_walk.impact_report(roots, impacted), *columns), rows(graph_walk.impacted_modules(impacted), "change_id", "module")

    whole = results()
    monkeypatch.setattr(graph_walk, "PAIRS_OF_CHANGE", 20)
    monkeypatch.setattr(graph_walk, "ROOTS_PER_BLOCK", 8)
    assert results() == whole
    impacted = graph_walk.impact(roots, edges, owners=owners)
    assert impacted.select(F.expr("change_ids % 4294967296")).distinct().count() > 1


def test_impacted_tests_follow_sets_as_far_as_the_pairs_reach(spark, monkeypatch):
    roots, edges, symbols = _fans(spark)
    pairs = edges.select("source", "target").collect()
    home = {r["qualified_name"]: r["module"] for r in symbols.collect()}
    near = {}
    for a, b in pairs:
        for node, other in ((a, a), (a, b), (b, a), (b, b)):
            if home[other].startswith("tests/"):
                near.setdefault(node, set()).add(home[other])
    for depth in (1, 2, -1):
        scope = set(rows(graph_walk.impact(roots, edges, depth), "change_id", "symbol"))
        scope |= {(root, root) for root in home}
        want = sorted({(change, m) for change, node in scope for m in near.get(node, ())})
        assert rows(graph_walk.impacted_tests(roots, edges, symbols, depth), "change_id", "module") == want
    monkeypatch.setattr(graph_walk, "SET_SIZE", 1)
    assert rows(graph_walk.impacted_tests(roots, edges, symbols, -1), "change_id", "module") == want


def test_calls_of_a_common_name_meet_in_blocks_and_once(spark, monkeypatch):
    monkeypatch.setattr(mining, "NAME_BLOCK", 4)
    callers = [f"m{i}.go" for i in range(15)]
    symbols = [(c, "go", "function", c[:-3], 1, []) for c in callers]
    symbols += [(f"s{i}.far", "far", "function", f"s{i}", 1, []) for i in range(11)]
    symbols += [("s1.far", "near", "function", "s1", 1, []), ("m1.C", "C", "class", "m1", 1, []), ("m1.C.far", "far", "method", "m1", 1, [])]
    symbols = spark.createDataFrame(
        symbols, "qualified_name string, name string, symbol_type string, module string, lineno long, decorators array<string>"
    )
    sites = [(c[:-3], c, None, "name", name, None) for c in callers + ["lost.go"] for name in ("far", "near", "none")]
    sites += [("m1", "m1.go", "m1.C", "self", "far", "self"), ("m2", "m2.go", None, "member", "far", "m1.C")]
    sites = spark.createDataFrame(sites, "module string, caller string, class_scope string, form string, name string, object string")
    found = mining.resolve_calls(sites, symbols)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate")  # pairs are not shuffled again to be made distinct
    # The module m1 has a `far` of its own, so only its `near` binds elsewhere.
    want = [(c, f"s{i}.far") for c in callers for i in range(11) if c != "m1.go" or i == 1]
    assert rows(found, "source", "target") == sorted(want + [(c, "m1.C.far") for c in callers])


def test_pairs_of_a_common_name_are_unrolled_from_lists(spark, monkeypatch):
    monkeypatch.setattr(mining, "NAME_BLOCK", 3)
    callers = spark.createDataFrame([(f"c{i}", name) for i in range(10) for name in ("far", "near")], "caller string, name string")
    symbols = spark.createDataFrame([("far", f"s{i}.far") for i in range(8)] + [("none", "s.none")], "name string, qualified_name string")
    pairs = mining._pairs_by_name(callers, symbols)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(targets") < plan.index("Join")  # the join makes no row for a pair
    assert rows(pairs, "caller", "target") == sorted((f"c{i}", f"s{k}.far") for i in range(10) for k in range(8))


def test_rounds_of_a_walk_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    cut = graph_walk.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph_walk, "cut_lineage", kept)
    arcs = [(n, n + 1) for n in range(12)] + [(4, 2), (9, 7)]
    edges = spark.createDataFrame(arcs, "source long, target long")
    nodes = spark.createDataFrame([(n,) for n in range(14)], "node long")
    depth = graph_walk.call_depth(nodes, edges).first()
    assert (depth["maximum_call_depth"], depth["cyclic_nodes"]) == (2, 6)
    assert plans and not any("BroadcastHashJoin" in plan for plan in plans)


def test_related_edges_are_not_merged_again(spark):
    listed = [("a", "b", "calls"), ("a", "b", "calls"), ("a", "b", "imports"), ("c", "a", "calls"), ("c", "d", "calls"), (None, "a", "calls"), ("a", None, "calls")]
    edges = spark.createDataFrame(listed, "source string, target string, type string")
    names = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "qualified_name string")
    related = graph.related_edges(edges, names)
    got = [tuple(r) for r in related.collect()]
    assert len(got) == len(set(got)) and set(got) == {e for e in listed if "a" in e or "b" in e}
    plan = graph.related_edges(edges.distinct(), names)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Union")]
    assert "Aggregate" not in above


def test_cycles_write_only_arcs_that_may_lie_on_one(spark, monkeypatch):
    written = []
    cut = graph_walk.cut_lineage

    def kept(df):
        table = cut(df)
        if table.columns == ["source", "target"]:
            written.append(table.count())
        return table

    monkeypatch.setattr(graph_walk, "cut_lineage", kept)
    leaves = [("n1", f"leaf{i}") for i in range(300)] + [(f"root{i}", "n2") for i in range(300)]
    arcs = [("n1", "n2"), ("n2", "n3"), ("n3", "n1"), ("n1", "n2"), ("n3", "n4"), ("n4", "n5"), ("n5", "n5"), (None, "n1"), ("n1", None)]
    edges = spark.createDataFrame(arcs + leaves, "source string, target string")
    found = rows(graph_walk.dependency_cycles(edges), "cycle_id", "node")
    assert found == [("n1", "n1"), ("n1", "n2"), ("n1", "n3")]
    assert written and max(written) <= 5
    assert rows(graph_walk.dependency_cycles(edges.where("target = 'n2'")), "cycle_id", "node") == []


def test_joint_impact_walks_only_edges_near_the_roots(spark, monkeypatch):
    written = []
    cut = graph_walk.cut_lineage

    def kept(df):
        table = cut(df)
        if "lane" in table.columns:
            written.append(table.count())
        return table

    monkeypatch.setattr(graph_walk, "cut_lineage", kept)
    names = [("a", "top"), ("b", "top"), ("x", "low"), ("y", "low")]
    symbols = spark.createDataFrame([(n, m, i) for i, (n, m) in enumerate(names)], "qualified_name string, module string, load_order long")
    modules = spark.createDataFrame([("top",), ("low",)], "path string")
    near = [("a", f"p{i}", "calls") for i in range(6)] + [("p0", "q", "calls"), ("q", "r", "calls"), ("p0", "z", "imports"), ("b", "a", "imports")]
    far = [(f"f{i}", f"g{i % 7}", "calls") for i in range(500)]
    edges = spark.createDataFrame(near + far, "source string, target string, type string")
    got = graph_walk.top_module_impact(modules, symbols, edges, module_limit=1).first()
    assert (got["impacted_symbols"], got["max_distance"]) == (9, 2)  # p0 to p5, q, and a and b by each other
    assert written and max(written) <= 2 * len(near)
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph_walk.edges_near(start, edges, 1), "source", "target", "type") == sorted(e for e in near if "a" in e[:2])


def test_dag_checks_hold_the_sorts_of_one_join_in_a_task(spark, monkeypatch):
    plans = []
    cut = graph_walk.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph_walk, "cut_lineage", kept)
    chain = [(n, n - 1) for n in range(2, 9)] + [(20, 21), (21, 20), (22, 22), (23, 21), (1, 99), (None, 3), (30, None)]
    deps = spark.createDataFrame(chain, "node long, depends_on long")
    nodes = spark.createDataFrame([(n,) for n in [*range(1, 9), 20, 21, 22, 23, 40, 41, 41]], "node long")
    layers = rows(graph_walk.dag_layers(nodes, deps.where("node between 2 and 8")), "node", "layer")
    assert layers == [(n, n - 1) for n in range(1, 9)] + [(n, 0) for n in (20, 21, 22, 23, 40, 41)]
    assert plans and max(plan.count("SortMergeJoin") for plan in plans) == 1
    got = rows(graph_walk.dag_checks(nodes, deps), "problem", "node")
    assert got == [
        ("cyclic", 20), ("cyclic", 21), ("cyclic", 22), ("duplicate", 41),
        ("never runs", 20), ("never runs", 21), ("never runs", 22), ("never runs", 23),
        *[("unknown dependency", n) for n in (1, 30)],
        *[("unreachable", n) for n in (*range(1, 9), 20, 21, 22, 23)],
    ]


def test_sources_go_to_python_in_small_batches_and_once(spark):
    source = "import os\nclass A(B):\n    @deco\n    def go(self):\n        self.stop()\n"
    files = spark.createDataFrame([("m", source), ("empty", ""), ("bad", "def (")], "module string, content string")
    facts = mining.extract_facts(files)
    plan = facts.where("fact = 'symbol'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "Arrow" not in plan and "Pandas" not in plan
    assert facts.columns[0] == "module" and not hasattr(mining, "pd")
    got = rows(mining.symbols_of(facts), "qualified_name", "symbol_type", "lineno", "decorators")
    assert got == [("m.A", "class", 2, []), ("m.A.go", "method", 4, ["deco"])]
    assert [r["module"] for r in mining.parse_errors(facts).collect()] == ["bad"]
    assert rows(mining.imports_of(facts), "module", "import_text") == [("m", "import os")]
