"""Retrieval: many queries against many symbols, scored, ranked and fitted to a budget.

No query is paired with every symbol. A symbol's score is a base that does not depend on the query
plus what the query's tokens add, and the addition is never negative. So the best k of a query are
among the symbols its tokens match and the k best by base score alone; of the former only those in
blocks of postings that can reach the k-th score are looked at (postings.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.operators import postings
from tracelode.session import cut_lineage

# Score weights (those of tokens and tests are in postings.py).
PUBLIC_NAME, KNOWN_TYPE, EXPORTED, DOCUMENTED, SMALL = 5, 10, 15, 10, 15
GENERATED, PRIVATE, LARGE = -20, -10, -5
SMALL_LINES, LARGE_LINES = 50, 100
SAME_MODULE, SAME_CLASS, CALLER, CALLEE, SHARED_PARENT = 20, 25, 30, 30, 20
MINIMUM_SCORE = 1
# Name patterns and test words.
GENERATED_MARKS = (
    "generated_", "_gen_", "_auto_", "_generated", "__generated__", "stub_", "_stub",
)
TEST_WORDS = ("test", "tests", "testing", "spec", "specs", "fixture", "fixtures", "coverage")
TYPE_RANK = {"CLASS": 3, "FUNCTION": 2, "METHOD": 1}
# Token limits and the marker of a cut excerpt.
PRIMARY_TOKENS, SUPPORT_TOKENS, DEFAULT_BUDGET = 2048, 512, 4096
EXCERPT_MARKER = "\n    # ... (truncated)"
# Purpose of a module by its file stem.
PURPOSES = {
    "models": "Data models and schemas",
    "views": "Request handling and response rendering",
    "controllers": "Request routing and business logic",
    "services": "Core business logic and services",
    "repositories": "Data access and persistence",
    "middleware": "Request/response middleware",
    "utils": "Utility and helper functions",
    "helpers": "Helper functions and utilities",
    "config": "Configuration and settings",
    "main": "Application entry point and factory",
    "app": "Application factory and configuration",
    "auth": "Authentication and authorization",
    "tests": "Test files and fixtures",
    "types": "Type definitions and type aliases",
}


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Queries (query_id, text, ...) with their tokens and whether they ask for tests."""
    tokens = text.query_tokens(F.col("text"))
    wanted = F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in TEST_WORDS]))
    return queries.withColumn("tokens", tokens).withColumn("wants_tests", wanted)


def type_rank(symbol_type: Column) -> Column:
    rank = F.lit(0)
    for name, value in TYPE_RANK.items():
        rank = F.when(F.upper(symbol_type) == name, value).otherwise(rank)
    return rank


def prepare_symbols(candidates: DataFrame) -> DataFrame:
    """Candidates with the parts of a score that no query changes.

    Input: (symbol_id, qualified_name, module, symbol_type, path, docstring, source, signature,
    in_init). The source text itself is left behind.
    """
    name, last = F.col("qualified_name"), F.substring_index("qualified_name", ".", -1)
    # A match is the rest of a line from its first character that is no space, so there is one in each line with text.
    lines = F.size(F.split(F.coalesce("source", F.lit("")), r"\S[^\n]*")) - 1
    few, many = F.col("n_lines") <= SMALL_LINES, F.col("n_lines") > LARGE_LINES
    private = last.startswith("_")
    generated = text.contains_any(F.lower(name), GENERATED_MARKS)
    file = F.substring_index(F.lower("path"), "/", -1)
    test = F.lower("module").contains("test_") | file.endswith("_test.py") | (file == "conftest.py")
    rules_before = [
        (~private, PUBLIC_NAME, "PUBLIC_NAME"),
        (type_rank(F.col("symbol_type")) > 0, KNOWN_TYPE, "SYMBOL_TYPE_PREFERENCE"),
        (F.coalesce("in_init", F.lit(False)), EXPORTED, "PUBLIC_API_BONUS"),
        (text.strip(F.coalesce("docstring", F.lit(""))) != "", DOCUMENTED, "DOCUMENTATION_BONUS"),
        ((F.col("n_lines") > 0) & few, SMALL, "IMPLEMENTATION_SIZE_BONUS"),
        (generated, GENERATED, "GENERATED_CODE"),
    ]
    rules_after = [(private, PRIVATE, "PRIVATE_SYMBOL"), (many, LARGE, "LARGE_IMPLEMENTATION")]
    base = F.lit(0)
    for test_, points, _ in rules_before + rules_after:
        base = base + F.when(test_, points).otherwise(0)
    reasons = lambda rows: F.array_compact(
        F.array(*[F.when(test_, F.lit(reason)) for test_, _, reason in rows])
    )
    segments = F.regexp_extract_all(F.lower(name), F.lit(r"[a-z0-9_]+"), F.lit(0))
    phrase = lambda seg: F.concat(
        F.lit("_"), F.array_join(F.filter(F.split(seg, "_"), lambda p: p != ""), "_"), F.lit("_")
    )
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    fixed = size("qualified_name") + size("module") + size("signature") + size("docstring")
    source_size = size("source")
    return candidates.withColumn("segments", segments).withColumn("n_lines", lines).select(
        "symbol_id",
        "qualified_name",
        "module",
        "symbol_type",
        F.lower(name).alias("lname"),
        F.lower("module").alias("lmodule"),
        "segments",
        F.array_join(F.transform("segments", phrase), " ").alias("phrases"),
        _exact_forms(F.col("segments")).alias("forms"),
        base.alias("base"),
        test.alias("is_test"),
        reasons(rules_before).alias("reasons_before"),
        reasons(rules_after).alias("reasons_after"),
        tokens_of(fixed + F.least(source_size, F.lit(PRIMARY_TOKENS * 4))).alias("primary_tokens"),
        tokens_of(fixed + excerpt_length(source_size, F.lit(SUPPORT_TOKENS))).alias("support_tokens"),
    )


def _exact_forms(segments: Column) -> Column:
    """(form, seg) for every token that names a segment exactly, in segment order.

    A segment is named by itself, by itself without outer underscores, and by any two or more of its
    underscore parts in a row.
    """

    def forms(seg: Column) -> Column:
        parts = F.filter(F.split(seg, "_"), lambda p: p != "")
        n = F.size(parts)
        starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        runs = F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(
                    F.sequence(i + 1, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "_")
                ),
            )
        )
        every = F.concat(F.array(seg, F.regexp_replace(seg, "^_+|_+$", "")), runs)
        return F.transform(every, lambda form: F.struct(form.alias("form"), seg.alias("seg")))

    return F.flatten(F.transform(segments, forms))


def tokens_of(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("bigint")


def excerpt_length(size: Column, max_tokens: Column) -> Column:
    cut = max_tokens * 4
    return F.when(size > cut, cut + len(EXCERPT_MARKER)).otherwise(size)


def excerpt(source: Column, max_tokens: Column) -> Column:
    cut = (max_tokens * 4).cast("int")
    return F.when(
        F.length(source) > cut, F.concat(F.substring(source, F.lit(1), cut), F.lit(EXCERPT_MARKER))
    ).otherwise(source)


def candidate_tokens(symbols: DataFrame) -> DataFrame:
    return symbols.select("symbol_id", "primary_tokens", "support_tokens")


def unmatched_leaders(queries: DataFrame, symbols: DataFrame, k: int) -> DataFrame:
    """For every query, the k best symbols by base score alone, as scored rows.

    Two short lists (with and without tests wanted) of k rows each are found once.
    """

    def leaders(wants: bool) -> DataFrame:
        flag = F.lit(wants)
        scored = symbols.select(
            "symbol_id", "qualified_name", "module", "symbol_type",
            (F.col("base") + postings.test_points(flag)).cast("bigint").alias("score"),
            postings.all_reasons(F.array().cast("array<string>"), flag).alias("reasons"),
        )
        top = best_per_name(scored, []).orderBy(F.desc("score"), "qualified_name").limit(k)
        return top.withColumn("wants_tests", flag)

    # Written, so that the planner knows the size of the lists and sends them to the queries if they are small.
    lists = cut_lineage(leaders(False).unionByName(leaders(True)))
    asked = queries.where(F.size("tokens") > 0).select("query_id", "wants_tests")
    return asked.join(lists, "wants_tests").drop("wants_tests")


def best_per_name(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per qualified name: the best score, with the reasons of all its rows."""
    kept = [c for c in scored.columns if c not in (*keys, "qualified_name", "reasons")]
    order = F.struct(-F.col("score"), -type_rank(F.col("symbol_type")), "module", "symbol_id")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons"))))
    folded = scored.groupBy(*keys, "qualified_name").agg(
        F.min_by(F.struct(*kept), order).alias("r"), merged.alias("reasons")
    )
    return folded.select(*keys, "qualified_name", "r.*", "reasons")


def rank_candidates(queries: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Scored rows with their rank per query: score down, then name; scores under 1 are dropped.

    Symbols stand in parts, each a range of names, and a part's pairs are made, folded by name and ordered in its
    task. A row's rank is its place among the rows of its part and score, behind what was counted in earlier cells
    (score, part) of its query. The cells come to a part's task as rows of their own, so no pair is shuffled.
    """
    asked = postings.asked_tokens(queries)
    tasks = 2 * postings.tasks_for(asked, found)  # names of a part may have more rows than others
    texts = ["module", "symbol_type", "reasons_before", "reasons_after"]
    known = symbols.select("symbol_id", "qualified_name", "base", "is_test", *texts).repartitionByRange(tasks, "qualified_name")
    known = cut_lineage(known.withColumn("part", F.spark_partition_id()))
    listed = cut_lineage(found.drop("base", "is_test").join(known, "symbol_id"))
    good = F.col("score") >= MINIMUM_SCORE
    met = listed.drop(*texts).repartition(tasks, "part").join(asked, "token")
    best = postings.scored_along(met, ("part", "qualified_name"), reasons=False).where(good)
    best = best.groupBy("part", "query_id", "qualified_name").agg(F.max("score").alias("score"))
    cells = best.groupBy("part", "query_id", "score").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("query_id").orderBy(F.desc("score"), "part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint"))
    cells = cut_lineage(cells.select("part", F.col("query_id").alias("of_query"), F.col("score").alias("of_score"), before.alias("before")))

    both = listed.unionByName(cells, allowMissingColumns=True).repartition(tasks, "part").join(asked, "token", "left")
    both = both.withColumn("query_id", F.coalesce("query_id", "of_query")).where(F.col("query_id").isNotNull())
    cell = ("part", "before", "of_score")
    scored = postings.scored_along(both, (*cell, "qualified_name", "module", "symbol_type"), reasons=True)
    scored = scored.withColumn("score", F.coalesce("of_score", "score")).where(good)
    named = best_per_name(scored, ["query_id", *cell])
    inside = Window.partitionBy("part", "query_id", "score").orderBy(F.col("before").isNull(), "qualified_name")
    rank = F.first("before").over(inside) + F.row_number().over(inside) - 1
    return named.withColumn("rank", rank).where(F.col("before").isNull()).drop(*cell)


def _by_score(rows: DataFrame) -> DataFrame:
    """The best score of each name of a query, with its rank."""
    names = rows.where(F.col("score") >= MINIMUM_SCORE).groupBy("query_id", "qualified_name").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "qualified_name")
    return names.withColumn("rank", F.row_number().over(order))


def top_k(queries: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """The first `max_symbols` of each query over all symbols, matched or not.

    Postings (`found`) stand in blocks of equal impact, and a directory of blocks is all a query reads at first. The
    blocks of highest impact, up to k postings, are opened and their pairs scored; with the symbols that are best
    without any token they give a k-th score that is reached. Then only blocks whose bound reaches it are opened:
    pairs below it are never made. A pair's best token opens its block, so no pair at or above it is missed.
    """
    k = queries.agg(F.max("max_symbols")).first()[0] or 0
    leaders = cut_lineage(unmatched_leaders(queries, symbols, max(k, 0)))
    limits = queries.select("query_id", "max_symbols")
    impacts = cut_lineage(postings.impact_postings(found))
    blocks = cut_lineage(postings.impact_blocks(impacts, queries, found))
    order = Window.partitionBy("query_id").orderBy(F.desc("impact"), "token")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    early = blocks.withColumn("before", before).join(limits, "query_id").where(F.col("before") < F.col("max_symbols"))

    plain = leaders.select("query_id", "qualified_name", "score")

    def scores(pairs: DataFrame) -> DataFrame:
        return postings.pair_scores(pairs, queries, symbols, found)

    names = _by_score(scores(postings.pairs_of(early, impacts)).unionByName(plain))
    reached = names.where(F.col("rank") <= k).join(limits, "query_id").where(F.col("rank") == F.col("max_symbols"))
    reached = cut_lineage(reached.select("query_id", F.col("score").alias("reached")))
    opened = blocks.join(reached, "query_id", "left").where(F.col("bound") >= F.coalesce("reached", F.lit(MINIMUM_SCORE)))
    ranked = _by_score(scores(postings.pairs_of(opened, impacts)).unionByName(plain)).where(F.col("rank") <= k)
    ranked = ranked.join(limits, "query_id").where(F.col("rank") <= F.col("max_symbols"))
    ranked = cut_lineage(ranked.select("query_id", "qualified_name", "rank"))
    # Rows of the same name give their reasons too, whatever their own score.
    ids = symbols.select("qualified_name", "symbol_id")
    same = ranked.join(ids, "qualified_name").select("query_id", "symbol_id").distinct()
    same = postings.score_pairs(same, queries, symbols, found)
    rows = same.unionByName(leaders).join(ranked, ["query_id", "qualified_name"])
    best = best_per_name(rows.drop("rank").where(F.col("score") >= MINIMUM_SCORE), ["query_id"])
    return best.join(ranked, ["query_id", "qualified_name"])


def selected_modules(top: DataFrame, queries: DataFrame) -> DataFrame:
    """Modules of a query's rows in first-seen order, at most `max_modules`: (query_id, module, place)."""
    seen = top.groupBy("query_id", "module").agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    limits = queries.select("query_id", "max_modules")
    placed = seen.withColumn("place", place).join(limits, "query_id")
    return placed.where(F.col("place") <= F.col("max_modules")).select("query_id", "module", "place")


def class_scope(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def score_relationship(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Points and reasons of candidates by their relation to a primary symbol.

    Input: pairs(query_id, primary, primary_module, qualified_name, module), edges(source, target,
    type). Only edges that end at a name of a pair are looked at; they are picked out once.
    """
    pairs = cut_lineage(pairs.where(F.col("primary") != F.col("qualified_name")).distinct())
    ends = pairs.select(F.inline(F.array(F.struct(F.col("primary").alias("target")), F.struct(F.col("qualified_name").alias("target")))))
    edges = edges.where(F.col("type").isin("calls", "defines")).join(ends.distinct(), "target", "left_semi")
    edges = cut_lineage(edges.select("source", "target", "type"))
    calls = edges.where(F.col("type") == "calls").select("source", "target").distinct()
    defines = edges.where(F.col("type") == "defines").select("source", "target").distinct()
    name = F.col("qualified_name")
    links = pairs.select("primary", "qualified_name").distinct()
    calls_it = links.join(
        calls, (F.col("source") == name) & (F.col("target") == F.col("primary")), "left_semi"
    ).withColumn("caller", F.lit(True))
    called = links.join(
        calls, (F.col("source") == F.col("primary")) & (F.col("target") == name), "left_semi"
    ).withColumn("callee", F.lit(True))
    parents = defines.select(F.col("target").alias("primary"), F.col("source").alias("parent"))
    children = defines.select(F.col("source").alias("parent"), F.col("target").alias("qualified_name"))
    parented = links.join(parents, "primary").join(children, ["parent", "qualified_name"], "left_semi")
    siblings = parented.select("primary", "qualified_name").distinct().withColumn("sibling", F.lit(True))
    keys = ["primary", "qualified_name"]
    joined = pairs.join(calls_it, keys, "left").join(called, keys, "left").join(siblings, keys, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        (flag(F.col("module") == F.col("primary_module")), SAME_MODULE, "SHARED_MODULE"),
        (flag(class_scope(name) == class_scope(F.col("primary"))), SAME_CLASS, "SHARED_CLASS"),
        (flag(F.col("caller")), CALLER, "DIRECT_CALLER"),
        (flag(F.col("callee")), CALLEE, "DIRECT_CALLEE"),
        (flag(F.col("sibling")), SHARED_PARENT, "SHARED_PARENT"),
    ]
    points = F.lit(0)
    for test, value, _ in rules:
        points = points + F.when(test, value).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, _, reason in rules]))
    return joined.select(
        "query_id", "primary", "qualified_name", "module",
        points.cast("bigint").alias("relation_score"), reasons.alias("relation_reasons"),
    )


def with_primary(top: DataFrame) -> DataFrame:
    """Top rows beside the name and module of their query's first row."""
    first = top.where(F.col("rank") == 1).select(
        "query_id", F.col("qualified_name").alias("primary"), F.col("module").alias("primary_module")
    )
    return top.join(first, "query_id")


def expand_neighbours(
    top: DataFrame, queries: DataFrame, symbols: DataFrame, edges: DataFrame
) -> DataFrame:
    """Direct callers and callees of each primary that fit the rest of the token budget.

    A neighbour costs at least one token, so no more than `max_tokens` of them can fit: later rows
    leave before the running sum, whatever the degree of the primary.
    """
    primary = with_primary(top).where(F.col("rank") == 1).select("query_id", "primary", "primary_module")
    calls = edges.where(F.col("type") == "calls")
    called = calls.select(F.col("source").alias("primary"), F.col("target").alias("qualified_name"))
    calling = calls.select(F.col("target").alias("primary"), F.col("source").alias("qualified_name"))
    # Each way is cut to the primaries before it meets the other, so the calls of all other symbols are not turned over.
    firsts = cut_lineage(primary.select("primary").distinct())
    beside = called.join(firsts, "primary", "left_semi").unionByName(calling.join(firsts, "primary", "left_semi"))
    near = primary.join(beside.distinct(), "primary")
    known = symbols.groupBy("qualified_name").agg(
        F.min_by(F.struct("module", "support_tokens"), "symbol_id").alias("s")
    )
    near = near.join(known, "qualified_name").select(
        "query_id", "primary", "primary_module", "qualified_name", "s.module", "s.support_tokens"
    )
    near = cut_lineage(near.join(top.select("query_id", "qualified_name"), ["query_id", "qualified_name"], "left_anti"))
    scored = score_relationship(near.drop("support_tokens"), edges)
    near = scored.join(near.select("query_id", "qualified_name", "support_tokens"), ["query_id", "qualified_name"])
    cost = top.join(symbols.select("symbol_id", "primary_tokens", "support_tokens"), "symbol_id")
    spent = cost.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") == 1, F.col("primary_tokens")).otherwise(F.col("support_tokens"))).alias("spent")
    )
    limit = queries.agg(F.max("max_tokens")).first()[0] or DEFAULT_BUDGET
    order = Window.partitionBy("query_id").orderBy(F.desc("relation_score"), "qualified_name")
    kept = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= int(limit))
    running = F.sum("support_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fitted = kept.withColumn("running", running).join(spent, "query_id")
    fitted = fitted.join(queries.select("query_id", "max_tokens"), "query_id")
    return fitted.where(F.col("spent") + F.col("running") <= F.col("max_tokens")).select(
        "query_id", "qualified_name", "module", "relation_score", "relation_reasons", "nth"
    )


def support_previews(
    top: DataFrame, queries: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Top rows with the source text they may show.

    The first row gets its source up to the primary limit; the others share a preview budget that is
    spent down the rank. A query that names two or more files reserves more for the others and caps
    each. At most `max_symbols` rows per query meet in one place.
    """
    texts = candidates.select(
        "symbol_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "docstring", "signature")]
    )
    rows = top.join(texts, "symbol_id")
    spans = F.array_sort(
        F.collect_list(F.struct("rank", F.length("source").alias("size")))
    ).alias("spans")
    several = F.size(text.module_refs(F.col("text"))) >= 2
    half, quarter = F.floor(F.col("max_tokens") / 2), F.floor(F.col("max_tokens") / 4)
    limits = queries.select(
        "query_id",
        F.when(several, F.greatest(F.lit(SUPPORT_TOKENS), half)).otherwise(SUPPORT_TOKENS).cast("bigint").alias("pool"),
        F.when(several, SUPPORT_TOKENS).otherwise(2**31).cast("bigint").alias("each"),
        F.when(several, F.least(F.lit(PRIMARY_TOKENS), F.greatest(F.lit(512), quarter)))
        .otherwise(PRIMARY_TOKENS)
        .cast("bigint")
        .alias("first"),
    )
    grouped = rows.groupBy("query_id").agg(spans).join(limits, "query_id")
    start = F.struct(
        F.col("pool").alias("left"),
        F.array().cast("array<struct<rank:int,allowed:bigint>>").alias("given"),
    )

    def spend(state: Column, span: Column) -> Column:
        support = (span["rank"] > 1) & (span["size"] > 0) & (state["left"] > 0)
        allowed = F.when(support, F.least(state["left"], F.col("each"))).otherwise(F.lit(0).cast("bigint"))
        used = F.when(support, F.floor(excerpt_length(span["size"], allowed) / 4)).otherwise(0)
        left = F.greatest(F.lit(0).cast("bigint"), state["left"] - used)
        entry = F.struct(span["rank"].cast("int").alias("rank"), allowed.alias("allowed"))
        return F.struct(left.alias("left"), F.array_append(state["given"], entry).alias("given"))

    folded = grouped.select("query_id", "first", F.aggregate("spans", start, spend).alias("s"))
    given = folded.select("query_id", "first", F.inline("s.given"))
    return rows.join(given, ["query_id", "rank"]).select(
        *[c for c in top.columns],
        "signature",
        "docstring",
        F.when(F.col("rank") == 1, F.substring(F.col("source"), F.lit(1), (F.col("first") * 4).cast("int")))
        .otherwise("")
        .alias("source"),
        F.when(F.col("allowed") > 0, excerpt(F.col("source"), F.col("allowed"))).otherwise("").alias("preview"),
    )


def budget_trim(enriched: DataFrame, modules: DataFrame, queries: DataFrame) -> DataFrame:
    """Longest prefix of each query's rows whose texts and module paths fit the token budget.

    The first row always stays; alone and still too long, its source is cut.
    """
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    own = size("source") + size("preview") + size("signature") + size("docstring")
    own = own + size("qualified_name") + size("module")
    order = Window.partitionBy("query_id").orderBy("rank")
    per_module = Window.partitionBy("query_id", "module").orderBy("rank")
    listed = modules.select("query_id", "module", F.lit(True).alias("listed"))
    rows = enriched.join(listed, ["query_id", "module"], "left").withColumn(
        "first_of_module", F.row_number().over(per_module) == 1
    )
    path = F.when(F.col("listed") & F.col("first_of_module"), size("module")).otherwise(0)
    running = F.sum(own + path).over(order.rowsBetween(Window.unboundedPreceding, 0))
    budget = F.when(F.col("max_tokens") > 0, F.col("max_tokens")).otherwise(DEFAULT_BUDGET)
    limits = queries.select("query_id", budget.alias("limit"))
    placed = rows.withColumn("tokens_upto", F.floor(running / 4)).join(limits, "query_id")
    fits = F.col("tokens_upto") <= F.col("limit")
    kept = placed.where((F.col("rank") == 1) | fits)
    fixed = size("qualified_name") + size("module") + size("signature") + F.when(F.col("listed"), size("module")).otherwise(0)
    room = F.greatest(F.lit(0), F.greatest(F.lit(0), F.col("limit") * 4 - 4) - fixed).cast("int")
    long_source = size("source") > room
    spare = F.greatest(F.lit(0), room - size("source") - size("preview"))
    over = (F.col("rank") == 1) & ~fits
    cut = lambda column, n: F.substring(column, F.lit(1), n)
    return kept.select(
        "query_id", "rank", "symbol_id", "qualified_name", "module", "symbol_type", "score", "signature",
        F.when(over & long_source, cut(F.col("source"), room)).otherwise(F.col("source")).alias("source"),
        F.when(over & long_source, "").otherwise(F.col("preview")).alias("preview"),
        F.when(over & long_source, "")
        .when(over, cut(F.col("docstring"), spare))
        .otherwise(F.col("docstring"))
        .alias("docstring"),
    )


# --- promotion ---------------------------------------------------------------------------------


def _best_of_modules(
    wanted: DataFrame, queries: DataFrame, symbols: DataFrame, found: DataFrame
) -> DataFrame:
    """First symbol of each wanted (query_id, module), by score then name, matched or not.

    Of the wanted modules' symbols only those are looked at that a token matches or that are first without any.
    """
    rows = postings.score_modules(wanted, queries, symbols, found).where(F.col("score") >= MINIMUM_SCORE)
    best = rows.groupBy("query_id", "module").agg(
        F.min_by(
            F.struct("symbol_id", "qualified_name", "symbol_type", "score"),
            F.struct(-F.col("score"), "qualified_name"),
        ).alias("b")
    )
    return best.select("query_id", "module", "b.*")


def _put_first(promoted: DataFrame, top: DataFrame, queries: DataFrame) -> DataFrame:
    """Promoted rows (with `tier`, `place`) ahead of the top rows, cut to `max_symbols`."""
    columns = ["query_id", "symbol_id", "qualified_name", "module", "symbol_type", "score"]
    rest = top.select(*columns, F.lit(9).alias("tier"), F.col("rank").cast("string").alias("place"), "rank")
    ahead = promoted.select(*columns, "tier", "place", F.lit(0).alias("rank"))
    kept = [c for c in columns if c not in ("query_id", "qualified_name")]
    order = F.struct("tier", "rank", "place")
    merged = ahead.unionByName(rest).groupBy("query_id", "qualified_name").agg(
        F.min_by(F.struct(*kept, "tier", "rank", "place"), order).alias("r")
    )
    rows = merged.select("query_id", "qualified_name", "r.*")
    window = Window.partitionBy("query_id").orderBy("tier", "rank", "place")
    rows = rows.withColumn("new_rank", F.row_number().over(window))
    k = queries.agg(F.max("max_symbols")).first()[0] or 0
    rows = rows.where(F.col("new_rank") <= k).join(queries.select("query_id", "max_symbols"), "query_id")
    return rows.where(F.col("new_rank") <= F.col("max_symbols")).select(
        "query_id", "symbol_id", "qualified_name", "module", "symbol_type", "score",
        F.col("new_rank").alias("rank"),
    )


def promote_referenced(
    top: DataFrame, queries: DataFrame, symbols: DataFrame, found: DataFrame, imports: DataFrame
) -> DataFrame:
    """One symbol of each module a query names, then of each module importing those, come first.

    Input: imports(module, imported).
    """
    refs = queries.select("query_id", F.posexplode(text.module_refs(F.col("text"))).alias("at", "module"))
    refs = refs.groupBy("query_id", "module").agg(F.min("at").alias("at"))
    named = refs.select("query_id", "module", F.lit(0).alias("tier"), F.lpad(F.col("at").cast("string"), 9, "0").alias("place"))
    using = refs.select("query_id", F.col("module").alias("imported")).join(imports, "imported")
    using = using.select("query_id", "module").distinct().join(refs, ["query_id", "module"], "left_anti")
    using = using.select("query_id", "module", F.lit(1).alias("tier"), F.col("module").alias("place"))
    wanted = named.unionByName(using)
    promoted = _best_of_modules(wanted, queries, symbols, found).join(wanted, ["query_id", "module"])
    return _put_first(promoted, top, queries)


def promote_named(
    top: DataFrame,
    queries: DataFrame,
    symbols: DataFrame,
    rules: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...],
) -> DataFrame:
    """Symbols that a rule names come first, in the rule's order.

    A rule is (texts that must all be in the query, names to promote). Names the ranking missed are
    added if they exist.
    """
    lowered = F.lower("text")
    lists = []
    for number, (needles, names) in enumerate(rules):
        test = F.lit(True)
        for needle in needles:
            test = test & lowered.contains(needle.lower())
        rows = [
            F.struct(F.lit(name).alias("qualified_name"), F.lit(f"{number:03d}{i:05d}").alias("place"))
            for i, name in enumerate(names)
        ]
        lists.append(F.when(test, F.array(*rows)))
    wanted = queries.select("query_id", F.inline(F.flatten(F.array_compact(F.array(*lists)))))
    known = symbols.groupBy("qualified_name").agg(
        F.min_by(F.struct("symbol_id", "module", "symbol_type"), "symbol_id").alias("s")
    )
    promoted = wanted.join(known, "qualified_name").select(
        "query_id", "qualified_name", "s.*", F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("tier"), "place"
    )
    own = top.select("query_id", "qualified_name", F.col("score").alias("s"))
    promoted = promoted.join(own, ["query_id", "qualified_name"], "left").withColumn(
        "score", F.coalesce("s", "score")
    )
    return _put_first(promoted, top, queries)


def promote_shared_helpers(
    top: DataFrame, queries: DataFrame, symbols: DataFrame, found: DataFrame, imports: DataFrame
) -> DataFrame:
    """For queries about shared helpers: modules the first eight rows import that fit the query's
    words, and the importers of those, each lend one symbol to the front."""
    lowered = F.lower("text")
    about = lowered.contains("shared helper") | (
        lowered.contains("shared")
        & lowered.contains("helper")
        & text.contains_any(lowered, ("consumer", "consume", "centralize", "centralise"))
    )
    asked = queries.where(about & (F.size(text.module_refs(F.col("text"))) == 0))
    words = F.filter("tokens", lambda t: F.length(t) > 2)
    heads = top.where(F.col("rank") <= 8).join(asked.select("query_id", words.alias("words")), "query_id")
    seen = heads.select("query_id", "rank", "module", "words").join(imports, "module")
    parts = F.filter(F.split(F.lower("imported"), "[^a-zA-Z0-9]+|_"), lambda p: p != "")
    fits = (F.size(F.array_intersect(parts, F.col("words"))) >= 2) | F.array_contains(parts, "helper")
    known = symbols.select(F.col("module").alias("imported")).distinct()
    used = seen.where(fits).join(known, "imported", "left_semi")
    used = used.groupBy("query_id", "imported").agg(F.min("rank").alias("first"))
    direct = used.select(
        "query_id", F.col("imported").alias("module"), F.lit(0).alias("tier"),
        F.concat(F.lpad(F.col("first").cast("string"), 9, "0"), F.col("imported")).alias("place"),
    )
    using = used.select("query_id", "imported").join(imports, "imported").select("query_id", "module").distinct()
    using = using.join(direct.select("query_id", "module"), ["query_id", "module"], "left_anti")
    using = using.select("query_id", "module", F.lit(1).alias("tier"), F.col("module").alias("place"))
    wanted = direct.unionByName(using)
    promoted = _best_of_modules(wanted, queries, symbols, found).join(wanted, ["query_id", "module"])
    return _put_first(promoted, top, queries)


# --- packages ----------------------------------------------------------------------------------


def compose_package(top: DataFrame) -> DataFrame:
    """One row per query: primary, supporting names, same-module names before and after, modules, counts.

    Lists hold at most `max_symbols` names.
    """
    rows = with_primary(top)
    home = F.col("module") == F.col("primary_module")
    primary_rank = F.lit(1)
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("qualified_name"))))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "qualified_name")))),
        lambda item: item["qualified_name"],
    )
    packed = rows.groupBy("query_id").agg(
        F.max("primary").alias("primary"),
        ordered.alias("supporting"),
        names(home & (F.col("rank") < primary_rank)).alias("before"),
        names(home & (F.col("rank") > primary_rank)).alias("after"),
        F.array_sort(F.collect_set("module")).alias("modules"),
    )
    return packed.select(
        "*",
        F.size("before").alias("before_count"),
        F.size("after").alias("after_count"),
        F.size("modules").alias("module_count"),
        (F.size("supporting") + 1).alias("symbol_count"),
    )


def module_purpose(module: Column) -> Column:
    file = F.substring_index(module, "/", -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    purpose = F.concat(F.lit("Module: "), file)
    for name, words in PURPOSES.items():
        purpose = F.when(stem == name, words).otherwise(purpose)
    return purpose


def module_describe(top: DataFrame) -> DataFrame:
    """Purpose of each module of a package and how it relates to the primary symbol."""
    scope = lambda name: F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    rows = with_primary(top)
    shared = (scope(F.col("primary")) != "") & (scope(F.col("qualified_name")) == scope(F.col("primary")))
    folded = rows.groupBy("query_id", "module").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.bool_or(F.col("module") == F.col("primary_module")).alias("home"),
        F.bool_or(shared).alias("shared"),
    )
    relation = (
        F.when(F.col("home"), "Contains the primary symbol")
        .when(F.col("shared"), "Shares class scope with primary symbol")
        .otherwise("Supporting module with related symbols")
    )
    return folded.select(
        "query_id", "module", "symbols", module_purpose(F.col("module")).alias("purpose"), relation.alias("relation")
    )


# Fixed value: opening of the platform's part of the system text.
SYSTEM_TEXT = (
    "You are a helpful coding assistant with access to a code repository. Use the provided "
    "repository context to answer the user's question accurately."
)


def render_context(trimmed: DataFrame, system_texts: DataFrame) -> DataFrame:
    """Ranked rows of each query as one system text, the client's own system text first.

    Input: budget_trim rows, system_texts(query_id, system_text). Text size is bounded by the budget
    the rows were trimmed to.
    """
    indent = lambda column, pad: F.array_join(
        F.transform(
            F.split(F.regexp_replace(column, "\n$", ""), "\n"), lambda line: F.concat(F.lit(pad), line)
        ),
        "\n",
    )
    some = lambda column, value: F.when(F.coalesce(column, F.lit("")) != "", value)
    first = F.concat_ws(
        "\n",
        F.concat(F.lit("Primary symbol: "), "qualified_name"),
        F.concat(F.lit("  Signature: "), F.coalesce(F.nullif("signature", F.lit("")), F.lit("N/A"))),
        some(F.col("docstring"), F.concat(F.lit("  Docstring:\n    "), "docstring")),
        some(F.col("source"), F.concat(F.lit("  Source:\n"), indent(F.col("source"), "    "))),
    )
    support = F.concat_ws(
        "\n",
        F.concat(F.lit("  - "), "qualified_name"),
        some(F.col("signature"), F.concat(F.lit("    Signature: "), "signature")),
        some(F.col("docstring"), F.concat(F.lit("    Docstring: "), "docstring")),
        some(F.col("preview"), F.concat(F.lit("    Preview:\n"), indent(F.col("preview"), "      "))),
    )
    blocks = trimmed.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("rank", F.when(F.col("rank") == 1, first).otherwise(support).alias("t")))
                ),
                lambda item: F.when(item["rank"] == 2, F.concat(F.lit("Supporting symbols:\n"), item["t"])).otherwise(item["t"]),
            ),
            "\n",
        ).alias("body"),
        F.array_join(
            F.transform(F.array_sort(F.collect_set("module")), lambda m: F.concat(F.lit("  - "), m, F.lit(": "), module_purpose(m))),
            "\n",
        ).alias("modules"),
    )
    joined = blocks.join(system_texts, "query_id", "left")
    context = F.concat_ws("\n", "body", F.lit("Related modules:"), "modules")
    return joined.select(
        "query_id",
        F.concat_ws("\n\n", F.nullif("system_text", F.lit("")), F.lit(SYSTEM_TEXT), context).alias("content"),
    )


def context_merge(packages: DataFrame) -> DataFrame:
    """Distinct items of all packages of a request, in first-seen order.

    Input: (request_id, package, kind in module/symbol, position, item). Output: (request_id, kind,
    item, package, position) of the first sighting; order by the last two for the merged list.
    """
    first = packages.groupBy("request_id", "kind", "item").agg(
        F.min(F.struct("package", "position")).alias("f")
    )
    return first.select("request_id", "kind", "item", "f.package", "f.position")


def merged_metadata(metadata: DataFrame) -> DataFrame:
    """Per request and key: token estimates are summed, other keys keep their first value.

    Input: (request_id, package, key, value).
    """
    is_tokens = F.col("key") == "estimated_tokens"
    folded = metadata.groupBy("request_id", "key").agg(
        F.sum(F.when(is_tokens, F.col("value").try_cast("bigint"))).alias("total"),
        F.min_by("value", "package").alias("first"),
    )
    value = F.when(is_tokens, F.coalesce(F.col("total"), F.lit(0)).cast("string")).otherwise(F.col("first"))
    return folded.select("request_id", "key", value.alias("value"))


def symbol_details(symbols: DataFrame, modules: DataFrame, max_tokens: int = 256) -> DataFrame:
    """Signature, docstring, later decorators, location and excerpt of each symbol.

    The texts are those of the symbol's whole module, as the record format has it.
    """
    rows = symbols.drop("decorators").join(modules.select(F.col("path").alias("module"), "source"), "module")
    lines = F.split("source", "\r?\n")
    stripped = F.transform(lines, text.strip)
    signature = F.get(F.filter(stripped, lambda s: (s != "") & ~s.startswith("#")), 0)
    docstring = text.strip(F.regexp_extract("source", "(?s)^\\s*(\"\"\"|''')(.*?)\\1", 2))
    rows = rows.withColumn("s", stripped).withColumn("short", F.substring_index("qualified_name", ".", -1))
    defined = lambda line: line.contains(F.concat(F.lit("def "), F.col("short"))) | line.contains(
        F.concat(F.lit("class "), F.col("short"))
    )
    start = F.array_position(F.transform("s", defined), True)
    after = F.when(start > 0, F.slice("s", start + 1, F.size("s"))).otherwise(F.array().cast("array<string>"))
    decorators = F.transform(
        F.filter(after, lambda line: line.startswith("@")),
        lambda line: F.regexp_extract(line, r"^@([^(\s]*)", 1),
    )
    return rows.select(
        "qualified_name",
        "module",
        "lineno",
        signature.alias("signature"),
        F.nullif(docstring, F.lit("")).alias("docstring"),
        decorators.alias("decorators"),
        F.size(lines).alias("end_line"),
        excerpt(F.col("source"), F.lit(max_tokens)).alias("excerpt"),
    )
