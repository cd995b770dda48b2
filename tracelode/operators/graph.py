"""One-pass graph operators over `symbols` and `edges(source, target, type)`.

Joins on node names are preceded by an aggregation per name wherever the result allows it, so a hub
node arrives at the join as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.stats import ratio, round_half_even
from tracelode.functions.text import contains_any
from tracelode.session import cut_lineage

# Fixed values.
EDGE_TYPES = ("calls", "imports", "inherits", "defines")
ABSTRACT_DECORATORS = ("abstractmethod", "abc.abstractmethod")
TEST_UTILITIES = ("conftest", "fixtures", "test_utils", "test_helpers", "mocks", "factories")
CATEGORY_BASE = {
    "CIRCULAR_DEPENDENCY": 0.95,
    "DEAD_CODE": 0.90,
    "ORPHAN_MODULE": 0.85,
    "HIGH_COUPLING": 0.80,
    "EXCESSIVE_DEPENDENCIES": 0.75,
    "LARGE_MODULE": 0.70,
}
SEVERITY_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}


def is_test_path(module: Column) -> Column:
    return module.startswith("tests/") | module.contains("/tests/")


def is_root_module(module: Column) -> Column:
    return ~module.contains("/") & ~module.contains("\\")


def symbols_distinct(symbols: DataFrame, order: str = "load_order") -> DataFrame:
    """One row per qualified name; the row loaded last wins."""
    rest = [name for name in symbols.columns if name != "qualified_name"]
    latest = symbols.groupBy("qualified_name").agg(
        F.max_by(F.struct(*rest), order).alias("last")
    )
    return latest.select("qualified_name", *[F.col(f"last.{name}").alias(name) for name in rest])


def find_symbols(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols whose short or qualified name is asked for, each once."""
    wanted = names.select("name").distinct()
    by_short = symbols.join(wanted, "name", "left_semi")
    by_full = symbols.join(wanted, symbols["qualified_name"] == wanted["name"], "left_semi")
    return by_short.unionByName(by_full).dropDuplicates(["qualified_name"])


def symbol_search(symbols: DataFrame, needle: str) -> DataFrame:
    part = needle.lower()
    return symbols.where(
        F.lower("name").contains(part) | F.lower("qualified_name").contains(part)
    )


def symbols_by_type(symbols: DataFrame, symbol_type: str) -> DataFrame:
    return symbols.where(F.col("symbol_type") == symbol_type)


def repo_statistics(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    kinds = symbols.agg(
        F.count_if(F.col("symbol_type") == "class").alias("classes"),
        F.count_if(F.col("symbol_type") == "function").alias("functions"),
        F.count_if(F.col("symbol_type") == "method").alias("methods"),
        F.count(F.lit(1)).alias("symbols"),
    )
    total = modules.agg(F.count(F.lit(1))).scalar()
    return kinds.withColumn("modules", total)


def merge_edges(*edge_sets: DataFrame) -> DataFrame:
    merged = edge_sets[0]
    for other in edge_sets[1:]:
        merged = merged.unionByName(other)
    return merged.select("source", "target", "type").distinct()


def build_graph(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between known nodes, `defines` renamed to `contains`."""
    names = symbols.select("qualified_name").distinct()
    known = edges.join(names, edges["source"] == names["qualified_name"], "left_semi")
    known = known.join(names, known["target"] == names["qualified_name"], "left_semi")
    kind = F.when(F.col("type") == "defines", "contains").otherwise(F.col("type"))
    return known.select("source", "target", kind.alias("type")).distinct()


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).distinct()


def dependents(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour")).distinct()


def typed_neighbours(edges: DataFrame, edge_type: str, incoming: bool) -> DataFrame:
    chosen = edges.where(F.col("type") == edge_type)
    return dependents(chosen) if incoming else dependencies(chosen)


def symbol_neighbours(
    edges: DataFrame, symbols: DataFrame, edge_type: str, incoming: bool
) -> DataFrame:
    """Neighbours by one edge type that are themselves known symbols (callers, callees, ...)."""
    pairs = typed_neighbours(edges, edge_type, incoming)
    names = symbols.select(F.col("qualified_name").alias("neighbour")).distinct()
    return pairs.join(names, "neighbour", "left_semi").select("node", "neighbour")


def dead_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods on no call edge, save root-level `main` and abstract methods."""
    calls = edges.where(F.col("type") == "calls")
    used = calls.select(F.col("source").alias("qualified_name")).union(calls.select("target")).distinct()
    entry = (
        (F.col("symbol_type") == "function")
        & (F.col("name") == "main")
        & is_root_module(F.col("module"))
    )
    abstract = (F.col("symbol_type") == "method") & F.arrays_overlap(
        "decorators", F.array(*[F.lit(d) for d in ABSTRACT_DECORATORS])
    )
    callable_ = F.col("symbol_type").isin("function", "method")
    excused = symbols.groupBy("qualified_name").agg(
        F.max(F.coalesce(entry | abstract, F.lit(False))).alias("excused"),
        F.min_by(F.struct("symbol_type", "module", "lineno"), "lineno").alias("s"),
        F.max(callable_).alias("callable"),
    )
    return (
        excused.where(F.col("callable") & ~F.col("excused"))
        .join(used, "qualified_name", "left_anti")
        .select("qualified_name", "s.symbol_type", "s.module", "s.lineno")
    )


def import_orphans(modules: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules none of whose symbols is on an import edge, by full or short name."""
    imports = edges.where(F.col("type") == "imports")
    on_edge = imports.select(F.col("source").alias("n")).union(imports.select("target")).distinct()
    names = symbols.select("module", F.explode(F.array("qualified_name", "name")).alias("n"))
    touched = names.join(on_edge, "n", "left_semi").select(F.col("module").alias("path")).distinct()
    sizes = symbols.groupBy(F.col("module").alias("path")).agg(F.count(F.lit(1)).alias("symbol_count"))
    init = F.col("path").endswith("/__init__.py") | F.col("path").endswith("\\__init__.py")
    return (
        modules.select("path")
        .distinct()
        .where(~init & ~is_root_module(F.col("path")))
        .join(touched, "path", "left_anti")
        .join(sizes, "path", "left")
        .select("path", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"))
    )


def edge_orphans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("path")).union(edges.select("target")).distinct()
    return modules.select("path").distinct().join(ends, "path", "left_anti")


def module_sizes(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("module").agg(F.count(F.lit(1)).alias("symbol_count"))


def large_modules(symbols: DataFrame, threshold: int = 10) -> DataFrame:
    return module_sizes(symbols).where(F.col("symbol_count") >= threshold)


def largest_components(symbols: DataFrame, limit: int = 10) -> DataFrame:
    return module_sizes(symbols).orderBy(F.desc("symbol_count"), "module").limit(limit)


def _endpoint_counts(edges: DataFrame) -> DataFrame:
    """Per node name: edges leaving and edges entering."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def module_statistics(modules: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Averages, the largest and the most connected module (ties to the smaller path), density."""
    paths = modules.select("path").distinct()
    sizes = symbols.groupBy(F.col("module").alias("path")).agg(F.count(F.lit(1)).alias("size"))
    ends = _endpoint_counts(edges).select(
        F.col("node").alias("path"), (F.col("outgoing") + F.col("incoming")).alias("ends")
    )
    per_module = (
        paths.join(sizes, "path", "left").join(ends, "path", "left").na.fill(0, ["size", "ends"])
    )
    relationships = edges.agg(F.count(F.lit(1))).scalar()

    def best(measure: str) -> Column:
        return F.min(F.struct((-F.col(measure)).alias("m"), F.col("path").alias("p")))

    totals = per_module.agg(
        F.count(F.lit(1)).alias("module_count"),
        F.sum("size").alias("symbols"),
        best("size").alias("largest"),
        best("ends").alias("connected"),
    ).withColumn("relationships", relationships)
    count = F.col("module_count")
    possible = F.when(count > 1, count * (count - 1)).otherwise(1)

    def named(field: str) -> Column:
        return F.when(F.col(f"{field}.m") < 0, F.col(f"{field}.p")).otherwise("")

    return totals.select(
        "module_count",
        F.round(ratio(F.col("symbols"), count), 4).alias("average_symbols"),
        named("largest").alias("largest_module"),
        (-F.col("largest.m")).alias("largest_module_symbol_count"),
        named("connected").alias("most_connected_module"),
        (-F.col("connected.m")).alias("most_connected_size"),
        F.round(ratio(F.col("relationships"), count), 4).alias("average_relationships"),
        F.round(F.least(F.col("relationships") / possible, F.lit(1.0)), 6).alias("density"),
    )


def graph_degree(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Average distinct out-degree and average in-degree over all edge ends and module symbols."""
    modules = symbols.where(F.col("symbol_type") == "module").select("qualified_name")
    nodes = edges.select("source").union(edges.select("target")).union(modules).distinct()
    pairs = edges.select("source", "target").distinct()
    counted = nodes.agg(F.count(F.lit(1)).alias("nodes")).select(
        "nodes",
        pairs.agg(F.count(F.lit(1))).scalar().alias("pairs"),
        edges.agg(F.count(F.lit(1))).scalar().alias("edges"),
    )
    return counted.select(
        "nodes",
        F.round(ratio(F.col("pairs"), F.col("nodes")), 4).alias("average_out_degree"),
        F.round(ratio(F.col("edges"), F.col("nodes")), 4).alias("average_in_degree"),
    )


def mutual_dependencies(edges: DataFrame) -> DataFrame:
    """Pairs a < b with edges both ways, found by counting directions per unordered pair."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    apart = edges.where(F.col("source") != F.col("target"))
    ways = apart.groupBy(a.alias("a"), b.alias("b")).agg(
        F.bool_or(F.col("source") < F.col("target")).alias("up"),
        F.bool_or(F.col("source") > F.col("target")).alias("down"),
    )
    return ways.where(F.col("up") & F.col("down")).select("a", "b")


def coupling(modules: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges leaving and entering each module through its symbols, and its instability."""
    owned = symbols.select(F.col("qualified_name").alias("node"), "module")
    counts = (
        _endpoint_counts(edges)
        .join(owned, "node")
        .groupBy("module")
        .agg(
            F.sum("outgoing").alias("dependency_count"), F.sum("incoming").alias("dependent_count")
        )
    )
    paths = modules.select(F.col("path").alias("module")).distinct()
    joined = (
        paths.join(module_sizes(symbols), "module", "left")
        .join(counts, "module", "left")
        .na.fill(0, ["symbol_count", "dependency_count", "dependent_count"])
    )
    total = F.col("dependency_count") + F.col("dependent_count")
    return joined.select(
        "module",
        "symbol_count",
        "dependency_count",
        "dependent_count",
        F.round(ratio(F.col("dependency_count"), total), 4).alias("instability"),
    )


def high_coupling(summaries: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Modules with more connections than `multiplier` times the average, and at least two."""
    total = F.col("dependency_count") + F.col("dependent_count")
    average = summaries.agg(F.avg(total)).scalar()
    return summaries.where((total > average * multiplier) & (total >= 2)).withColumn("total", total)


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def layering_violations(module_imports: DataFrame) -> DataFrame:
    """Imports between tests and production code that break the layering."""
    source, target = F.col("source"), F.col("target")
    utility = contains_any(target, TEST_UTILITIES)
    kind = F.when(
        is_test_path(source) & ~is_test_path(target) & ~utility, "test imports production"
    ).when(~is_test_path(source) & is_test_path(target), "production imports test")
    return module_imports.withColumn("violation", kind).where(F.col("violation").isNotNull())


def excessive_dependencies(edges: DataFrame, threshold: int = 20) -> DataFrame:
    counts = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > threshold)


def importers_of(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that import each given module. Input: imports(module, imported)."""
    wanted = modules.select(F.col("path").alias("imported")).distinct()
    return imports.join(wanted, "imported", "left_semi").select("imported", "module").distinct()


def related_edges(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges with either end among the candidates, each once.

    An edge is taken by its source, or else by its target, so the two lists are not merged again. Edges that are
    distinct already are not made so twice.
    """
    names = candidates.select("qualified_name").distinct()
    every = edges.distinct()
    starts = names.withColumnRenamed("qualified_name", "source")
    ends = names.withColumnRenamed("qualified_name", "target")
    out = every.join(starts, "source", "left_semi")
    into = every.join(starts, "source", "left_anti").join(ends, "target", "left_semi")
    return out.select(*edges.columns).unionByName(into.select(*edges.columns))


def review_scope(changes: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Per change: named symbols and files that exist, and the tokens to review them (50 / 100).

    Input: changes(change_id, kind in symbol/file, item).
    """
    names = symbols.select(F.explode(F.array("qualified_name", "name")).alias("item"))
    known_symbols = changes.where(F.col("kind") == "symbol").join(names, "item", "left_semi")
    paths = modules.select(F.col("path").alias("item"))
    known_files = changes.where(F.col("kind") == "file").join(paths, "item", "left_semi")
    kept = known_symbols.unionByName(known_files)
    found = kept.groupBy("change_id").agg(
        F.count_if(F.col("kind") == "symbol").alias("affected_symbols"),
        F.count_if(F.col("kind") == "file").alias("affected_modules"),
    )
    asked = changes.groupBy("change_id").agg(F.count(F.lit(1)).alias("asked"))
    scope = asked.join(found, "change_id", "left").na.fill(0)
    cost = F.col("affected_symbols") * 50 + F.col("affected_modules") * 100
    level = F.when(F.col("affected_symbols") + F.col("affected_modules") > 0, "MEDIUM").otherwise("LOW")
    return scope.withColumn("estimated_tokens", cost).withColumn("complexity", level)


# --- refactoring findings ----------------------------------------------------------------------


def finding_confidence(category: Column, evidence: Column, completeness: Column) -> Column:
    base = F.lit(0.70)
    for name, score in CATEGORY_BASE.items():
        base = F.when(category == name, F.lit(score)).otherwise(base)
    factor = (
        F.when(evidence >= 3, 1.0).when(evidence == 2, 0.9).when(evidence == 1, 0.8).otherwise(0.5)
    )
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * factor * completeness))
    return round_half_even(raw, 2)


def _finding(
    rows: DataFrame,
    category: str,
    severity: str,
    modules: Column,
    evidence: Column,
    completeness: float,
    measure: Column,
) -> DataFrame:
    """Common shape of a finding: category, severity, modules text, evidence count, measure."""
    return rows.select(
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        modules.alias("modules"),
        evidence.cast("bigint").alias("evidence"),
        F.lit(completeness).alias("completeness"),
        measure.cast("bigint").alias("measure"),
    )


def refactoring_findings(
    modules: DataFrame,
    symbols: DataFrame,
    edges: DataFrame,
    cycles: DataFrame | None = None,
    coupling_multiplier: float = 1.5,
    large_threshold: int = 100,
    dependency_threshold: int = 20,
) -> DataFrame:
    """All six kinds of findings, one row per (category, modules), the most confident kept.

    `cycles` is (cycle_id, node) as the cycle operator returns it. Edges are read several times: they should be a
    written table.
    """
    path = F.col("module")
    coupled = high_coupling(cut_lineage(coupling(modules, symbols, edges)), coupling_multiplier)
    large = large_modules(symbols, large_threshold)
    dead = dead_symbols(symbols, edges).groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    orphans = import_orphans(modules, symbols, edges)
    owner = symbols.groupBy(F.col("qualified_name").alias("source")).agg(F.min("module").alias("m"))
    heavy = excessive_dependencies(edges, dependency_threshold).join(owner, "source", "left")
    one, two = F.lit(1), F.lit(2)
    kinds = [
        _finding(coupled, "HIGH_COUPLING", "HIGH", path, two, 1.0, F.col("total")),
        _finding(large, "LARGE_MODULE", "MEDIUM", path, one, 0.9, F.col("symbol_count")),
        _finding(dead, "DEAD_CODE", "HIGH", path, 1 + F.least("n", F.lit(5)), 1.0, F.col("n")),
        _finding(
            orphans, "ORPHAN_MODULE", "MEDIUM", F.col("path"), one, 1.0, F.col("symbol_count")
        ),
        _finding(
            heavy, "EXCESSIVE_DEPENDENCIES", "MEDIUM", F.coalesce("m", "source"), one, 0.9, F.col("n")
        ),
    ]
    if cycles is not None:
        owners = owner.withColumnRenamed("source", "node")
        sets = cycle_module_sets(cycles.join(owners, "node", "left").select(
            "cycle_id", "node", F.coalesce("m", "node").alias("module")
        ))
        kinds.append(
            _finding(
                sets, "CIRCULAR_DEPENDENCY", "HIGH", F.col("modules"), one, 1.0, F.col("length")
            )
        )
    every = merge_findings(kinds)
    confidence = finding_confidence(F.col("category"), F.col("evidence"), F.col("completeness"))
    scored = every.withColumn("confidence", confidence)
    best = scored.groupBy("category", "modules").agg(
        F.max_by(
            F.struct("severity", "evidence", "measure", "confidence"),
            F.struct("confidence", "measure"),
        ).alias("f")
    )
    return best.select(
        F.concat_ws(":", "category", "modules").alias("id"), "category", "modules", "f.*"
    )


def cycle_module_sets(members: DataFrame) -> DataFrame:
    """One row per distinct set of modules on a cycle: (modules, length).

    Input: (cycle_id, node, module). Sets are compared by two sums of hashes instead of by lists, so
    a cycle may run through any number of modules; `modules` names the first one, how many more, and
    the set itself by a sum of its names' digests. `cycle_modules` lists the set as rows.
    """
    longest = _cycle_sets(members).groupBy("modules", "h1", "h2").agg(F.max("length").alias("length"))
    return longest.select("modules", "length")


def cycle_modules(members: DataFrame) -> DataFrame:
    """Modules of each distinct set on a cycle: (modules, module), `modules` as in cycle_module_sets."""
    named = _cycle_sets(members).select("cycle_id", "modules")
    return members.join(named, "cycle_id").select("modules", "module").distinct()


def _cycle_sets(members: DataFrame) -> DataFrame:
    """(cycle_id, modules, h1, h2, length) for each cycle."""
    sizes = members.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("length"))
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "module").cast("decimal(38,0)"))
    sets = (
        members.select("cycle_id", "module")
        .distinct()
        .groupBy("cycle_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("module").alias("first"),
            hashed(1).alias("h1"),
            hashed(2).alias("h2"),
            F.sum(F.conv(F.substring(F.md5("module"), 1, 15), 16, 10).cast("decimal(38,0)")).alias("digest"),
        )
        .join(sizes, "cycle_id")
    )
    more = F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"), F.lit(" #"), F.col("digest").cast("string"))
    label = F.concat("first", F.when(F.col("n") > 1, more).otherwise(""))
    return sets.select("cycle_id", label.alias("modules"), "h1", "h2", "length")


def merge_findings(kinds: list[DataFrame]) -> DataFrame:
    merged = kinds[0]
    for other in kinds[1:]:
        merged = merged.unionByName(other)
    return merged


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Report order: severity, then confidence downwards, then id."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(r)) for s, r in SEVERITY_ORDER.items()], F.lit(4))
    return findings.orderBy(rank, F.desc("confidence"), "id")


def finding_summary(findings: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("severity") == level).alias(level.lower()) for level in SEVERITY_ORDER
    ]
    return findings.agg(F.count(F.lit(1)).alias("total"), *counts)


def hunk_overlaps(hunks: DataFrame) -> DataFrame:
    """Hunks of a file whose old line range runs into an earlier one's.

    Ordered by start, a hunk overlaps some earlier hunk exactly when the furthest end so far is
    past its own start, so no pairs are formed. A file is cut into blocks of lines; the furthest
    end before a block comes from one row per block, so no file has to fit one task.
    """
    size = 4096
    spans = hunks.withColumn("old_end", F.col("old_start") + F.col("old_count")).withColumn(
        "block", F.floor(F.col("old_start") / size)
    )
    spans = spans.groupBy("file_path", "old_start", "old_end", "block").agg(
        F.count(F.lit(1)).alias("copies")
    )
    reach = spans.groupBy("file_path", "block").agg(F.max("old_end").alias("far"))
    earlier = (
        Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = reach.withColumn("far_before", F.max("far").over(earlier)).drop("far")
    inside = (
        Window.partitionBy("file_path", "block")
        .orderBy("old_start", "old_end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = spans.withColumn("far_inside", F.max("old_end").over(inside)).join(
        reach, ["file_path", "block"]
    )
    furthest = F.greatest("far_inside", "far_before")
    overlapping = (F.col("copies") > 1) & (F.col("old_end") > F.col("old_start"))
    hit = overlapping | (furthest > F.col("old_start"))
    return seen.where(hit).select(
        "file_path", "old_start", (F.col("old_end") - F.col("old_start")).alias("old_count"), "copies",
        F.greatest(furthest, F.when(F.col("copies") > 1, F.col("old_end"))).alias("reached"),
    )
