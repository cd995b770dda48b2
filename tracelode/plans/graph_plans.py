"""Graph queries over symbols (part), edges (lineitem) and the sparse call graph (customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.operators import graph, graph_walk
from tracelode.plans.registry import query
from tracelode.session import cut_lineage

WITH = "WITH " + views.GRAPH_SQL


def _tables(spark, sf_dir):
    return views.modules(spark, sf_dir), views.symbols(spark, sf_dir), views.edges(spark, sf_dir)


@query(
    "symbols_distinct",
    """SELECT p_brand AS qualified_name, max_by(p_name, p_partkey) AS name, max(p_partkey) AS load_order
    FROM part GROUP BY p_brand""",
)
def _symbols_distinct(spark, sf_dir):
    loaded = views.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("qualified_name"),
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("load_order"),
    )
    return graph.symbols_distinct(loaded)


@query(
    "find_symbols",
    f"""{WITH} SELECT qualified_name, name, module FROM symbols WHERE name IN (SELECT target FROM edges)
    OR qualified_name IN (SELECT target FROM edges)""",
)
def _find_symbols(spark, sf_dir):
    _, symbols, edges = _tables(spark, sf_dir)
    names = edges.select(F.col("target").alias("name"))
    return graph.find_symbols(symbols, names).select("qualified_name", "name", "module")


@query(
    "symbol_search",
    f"""{WITH} SELECT qualified_name, name FROM symbols WHERE contains(lower(name), 'ring')
    OR contains(lower(qualified_name), 'ring')""",
)
def _symbol_search(spark, sf_dir):
    return graph.symbol_search(views.symbols(spark, sf_dir), "Ring").select("qualified_name", "name")


@query(
    "symbols_by_type",
    f"{WITH} SELECT qualified_name, symbol_type, module FROM symbols WHERE symbol_type = 'method'",
)
def _by_type(spark, sf_dir):
    chosen = graph.symbols_by_type(views.symbols(spark, sf_dir), "method")
    return chosen.select("qualified_name", "symbol_type", "module")


@query(
    "repo_statistics",
    f"""{WITH} SELECT count(*) FILTER (symbol_type = 'class') AS classes,
    count(*) FILTER (symbol_type = 'function') AS functions, count(*) FILTER (symbol_type = 'method') AS methods,
    count(*) AS symbols, (SELECT count(*) FROM modules) AS modules FROM symbols""",
)
def _repo_statistics(spark, sf_dir):
    modules, symbols, _ = _tables(spark, sf_dir)
    return graph.repo_statistics(symbols, modules)


@query(
    "merge_edges",
    f"""{WITH} SELECT source, target, type FROM edges
    UNION SELECT source, target, 'imports' FROM module_imports
    UNION SELECT source, target, type FROM edges WHERE type = 'calls'""",
)
def _merge_edges(spark, sf_dir):
    edges = views.edges(spark, sf_dir)
    lifted = views.module_imports(spark, sf_dir).withColumn("type", F.lit("imports"))
    return graph.merge_edges(edges, lifted, edges.where(F.col("type") == "calls"))


@query(
    "build_graph",
    f"""{WITH} SELECT DISTINCT source, target, CASE type WHEN 'defines' THEN 'contains' ELSE type END AS type
    FROM edges WHERE source IN (SELECT qualified_name FROM symbols)
    AND target IN (SELECT qualified_name FROM symbols)""",
)
def _build_graph(spark, sf_dir):
    _, symbols, edges = _tables(spark, sf_dir)
    return graph.build_graph(symbols, edges)


@query("dependencies", f"{WITH} SELECT DISTINCT source AS node, target AS neighbour FROM edges")
def _dependencies(spark, sf_dir):
    return graph.dependencies(views.edges(spark, sf_dir))


@query("dependents", f"{WITH} SELECT DISTINCT target AS node, source AS neighbour FROM edges")
def _dependents(spark, sf_dir):
    return graph.dependents(views.edges(spark, sf_dir))


_BUILT = """, built AS (SELECT DISTINCT source, target,
  CASE type WHEN 'defines' THEN 'contains' ELSE type END AS type FROM edges
  WHERE source IN (SELECT qualified_name FROM symbols) AND target IN (SELECT qualified_name FROM symbols))"""


def _register_contains(name, incoming):
    ends = ("target", "source") if incoming else ("source", "target")

    @query(
        name,
        f"""{WITH}{_BUILT} SELECT DISTINCT {ends[0]} AS node, {ends[1]} AS neighbour FROM built
        WHERE type = 'contains'""",
    )
    def _job(spark, sf_dir):
        _, symbols, edges = _tables(spark, sf_dir)
        return graph.typed_neighbours(graph.build_graph(symbols, edges), "contains", incoming)


_register_contains("contains", False)
_register_contains("contained_by", True)


def _register_neighbours(name, edge_type, incoming):
    ends = ("target", "source") if incoming else ("source", "target")

    @query(
        name,
        f"""{WITH} SELECT DISTINCT {ends[0]} AS node, {ends[1]} AS neighbour FROM edges
        WHERE type = '{edge_type}' AND {ends[1]} IN (SELECT qualified_name FROM symbols)""",
    )
    def _job(spark, sf_dir):
        _, symbols, edges = _tables(spark, sf_dir)
        return graph.symbol_neighbours(edges, symbols, edge_type, incoming)


_register_neighbours("callers", "calls", True)
_register_neighbours("callees", "calls", False)
_register_neighbours("children", "defines", False)
_register_neighbours("parents", "defines", True)

DEAD_SQL = """
dead AS (SELECT qualified_name, symbol_type, module, lineno FROM symbols
  WHERE symbol_type IN ('function', 'method')
  AND NOT (symbol_type = 'function' AND name = 'main' AND NOT contains(module, '/'))
  AND NOT (symbol_type = 'method' AND is_abstract)
  AND qualified_name NOT IN (SELECT source FROM edges WHERE type = 'calls' UNION SELECT target FROM edges WHERE type = 'calls'))
"""


@query("dead_symbols", f"{WITH}, {DEAD_SQL} SELECT * FROM dead")
def _dead_symbols(spark, sf_dir):
    _, symbols, edges = _tables(spark, sf_dir)
    return graph.dead_symbols(symbols, edges)


ORPHAN_SQL = """
orphans AS (SELECT path, (SELECT count(*) FROM symbols s WHERE s.module = path) AS symbol_count FROM modules
  WHERE NOT ends_with(path, '/__init__.py') AND contains(path, '/')
  AND path NOT IN (SELECT module FROM symbols s JOIN
    (SELECT source AS n FROM edges WHERE type = 'imports' UNION SELECT target FROM edges WHERE type = 'imports') i
    ON s.qualified_name = i.n OR s.name = i.n))
"""


@query("import_orphans", f"{WITH}, {ORPHAN_SQL} SELECT * FROM orphans")
def _import_orphans(spark, sf_dir):
    modules, symbols, edges = _tables(spark, sf_dir)
    return graph.import_orphans(modules, symbols, edges)


@query(
    "edge_orphans",
    f"""{WITH} SELECT path FROM modules WHERE path NOT IN
    (SELECT source FROM module_imports UNION SELECT target FROM module_imports)""",
)
def _edge_orphans(spark, sf_dir):
    return graph.edge_orphans(views.modules(spark, sf_dir), views.module_imports(spark, sf_dir))


@query(
    "large_modules",
    f"{WITH} SELECT module, count(*) AS symbol_count FROM symbols GROUP BY 1 HAVING count(*) >= 10",
)
def _large_modules(spark, sf_dir):
    return graph.large_modules(views.symbols(spark, sf_dir), 10)


@query(
    "largest_components",
    f"{WITH} SELECT module, count(*) AS symbol_count FROM symbols GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _largest_components(spark, sf_dir):
    return graph.largest_components(views.symbols(spark, sf_dir))


@query(
    "module_statistics",
    f"""{WITH}, every AS (SELECT source, target FROM edges UNION ALL SELECT source, target FROM module_imports),
    ends AS (SELECT path, (SELECT count(*) FROM symbols s WHERE s.module = path) AS size,
      (SELECT count(*) FROM every WHERE source = path) + (SELECT count(*) FROM every WHERE target = path) AS ends
      FROM modules)
    SELECT count(*) AS module_count, round(sum(size)::DOUBLE / count(*), 4) AS average_symbols,
    arg_min(path, (-size, path)) AS largest_module, max(size) AS largest_module_symbol_count,
    arg_min(path, (-ends, path)) AS most_connected_module, max(ends) AS most_connected_size,
    round((SELECT count(*) FROM every)::DOUBLE / count(*), 4) AS average_relationships,
    round(least((SELECT count(*) FROM every)::DOUBLE / (count(*) * (count(*) - 1)), 1.0), 6) AS density FROM ends""",
)
def _module_statistics(spark, sf_dir):
    modules, symbols, edges = _tables(spark, sf_dir)
    lifted = views.module_imports(spark, sf_dir).withColumn("type", F.lit("imports"))
    return graph.module_statistics(modules, symbols, edges.unionByName(lifted))


@query(
    "graph_degree",
    f"""{WITH}, nodes AS (SELECT source FROM edges UNION SELECT target FROM edges),
    c AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS e,
      (SELECT count(*) FROM (SELECT DISTINCT source, target FROM edges)) AS p)
    SELECT nodes, round(p::DOUBLE / nodes, 4) AS average_out_degree, round(e::DOUBLE / nodes, 4) AS average_in_degree FROM c""",
)
def _graph_degree(spark, sf_dir):
    _, symbols, edges = _tables(spark, sf_dir)
    return graph.graph_degree(symbols, edges)


@query(
    "mutual_dependencies",
    f"""{WITH} SELECT DISTINCT a.source AS a, a.target AS b FROM edges a JOIN edges b
    ON a.source = b.target AND a.target = b.source WHERE a.source < a.target""",
)
def _mutual(spark, sf_dir):
    return graph.mutual_dependencies(views.edges(spark, sf_dir))


COUPLING_SQL = """
outgoing AS (SELECT s.module, count(*) AS n FROM edges e JOIN symbols s ON s.qualified_name = e.source GROUP BY 1),
incoming AS (SELECT s.module, count(*) AS n FROM edges e JOIN symbols s ON s.qualified_name = e.target GROUP BY 1),
coupled AS (SELECT path AS module, (SELECT count(*) FROM symbols s WHERE s.module = path) AS symbol_count,
  coalesce(o.n, 0) AS dependency_count, coalesce(i.n, 0) AS dependent_count,
  round(CASE WHEN coalesce(o.n, 0) + coalesce(i.n, 0) = 0 THEN 0
    ELSE coalesce(o.n, 0)::DOUBLE / (coalesce(o.n, 0) + coalesce(i.n, 0)) END, 4) AS instability
  FROM modules LEFT JOIN outgoing o ON o.module = path LEFT JOIN incoming i ON i.module = path)
"""


@query("coupling", f"{WITH}, {COUPLING_SQL} SELECT * FROM coupled")
def _coupling(spark, sf_dir):
    return graph.coupling(*_tables(spark, sf_dir))


HIGH_SQL = """
high AS (SELECT *, dependency_count + dependent_count AS total FROM coupled
  WHERE dependency_count + dependent_count > {m} * (SELECT avg(dependency_count + dependent_count) FROM coupled)
  AND dependency_count + dependent_count >= 2)
"""


@query("high_coupling", f"{WITH}, {COUPLING_SQL}, {HIGH_SQL.format(m='1.5::DOUBLE')} SELECT * FROM high")
def _high_coupling(spark, sf_dir):
    return graph.high_coupling(graph.coupling(*_tables(spark, sf_dir)), 1.5)


@query("edge_type_counts", f"{WITH} SELECT type, count(*) AS n FROM edges GROUP BY type")
def _edge_type_counts(spark, sf_dir):
    return graph.edge_type_counts(views.edges(spark, sf_dir))


@query(
    "layering_violations",
    f"""{WITH} SELECT source, target, CASE WHEN starts_with(source, 'tests/')
      THEN 'test imports production' ELSE 'production imports test' END AS violation
    FROM module_imports WHERE starts_with(source, 'tests/') <> starts_with(target, 'tests/')""",
)
def _layering(spark, sf_dir):
    return graph.layering_violations(views.module_imports(spark, sf_dir))


@query(
    "excessive_dependencies",
    f"{WITH} SELECT source, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) > 20",
)
def _excessive(spark, sf_dir):
    return graph.excessive_dependencies(views.edges(spark, sf_dir), 20)


@query(
    "importers_of",
    f"{WITH} SELECT target AS imported, source AS module FROM module_imports WHERE target IN (SELECT path FROM modules)",
)
def _importers(spark, sf_dir):
    imports = views.module_imports(spark, sf_dir).select(
        F.col("source").alias("module"), F.col("target").alias("imported")
    )
    return graph.importers_of(imports, views.modules(spark, sf_dir))


@query(
    "related_edges",
    f"""{WITH}, picked AS (SELECT qualified_name FROM symbols WHERE symbol_type = 'class')
    SELECT source, target, type FROM edges WHERE source IN (FROM picked) OR target IN (FROM picked)""",
)
def _related(spark, sf_dir):
    _, symbols, edges = _tables(spark, sf_dir)
    return graph.related_edges(edges, graph.symbols_by_type(symbols, "class"))


@query(
    "review_scope",
    f"""{WITH}, changes AS (
      SELECT l_orderkey AS change_id, 'symbol' AS kind, 'n' || (l_partkey + l_linenumber * 100) AS item FROM lineitem
      UNION ALL SELECT l_orderkey, 'file', 'pkg/Brand' || l_suppkey || '.py' FROM lineitem),
    found AS (SELECT change_id, count(*) AS asked,
      count(*) FILTER (kind = 'symbol' AND (item IN (SELECT qualified_name FROM symbols) OR item IN (SELECT name FROM symbols))) AS affected_symbols,
      count(*) FILTER (kind = 'file' AND item IN (SELECT path FROM modules)) AS affected_modules
      FROM changes GROUP BY 1)
    SELECT *, affected_symbols * 50 + affected_modules * 100 AS estimated_tokens,
    CASE WHEN affected_symbols + affected_modules > 0 THEN 'MEDIUM' ELSE 'LOW' END AS complexity FROM found""",
)
def _review_scope(spark, sf_dir):
    modules, symbols, _ = _tables(spark, sf_dir)
    lines = views.table(spark, sf_dir, "lineitem")
    asked = (F.col("l_partkey") + F.col("l_linenumber") * 100).cast("string")
    changes = lines.select(
        F.col("l_orderkey").alias("change_id"),
        F.inline(
            F.array(
                F.struct(F.lit("symbol").alias("kind"), F.concat(F.lit("n"), asked).alias("item")),
                F.struct(
                    F.lit("file").alias("kind"),
                    F.concat(F.lit("pkg/Brand"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("item"),
                ),
            )
        ),
    )
    return graph.review_scope(changes, symbols, modules)


# --- walks -------------------------------------------------------------------------------------

REACH_DEPTH = 6


def _register_reach(name, incoming):
    ends = ("target", "source") if incoming else ("source", "target")

    @query(
        name,
        f"""WITH RECURSIVE {views.CHAIN_SQL.strip()},
        walk(seed, node, distance) AS (
          SELECT c_custkey, c_custkey, 0 FROM customer
          UNION SELECT w.seed, c.{ends[1]}, w.distance + 1 FROM walk w JOIN chain c ON c.{ends[0]} = w.node
          WHERE w.distance < {REACH_DEPTH})
        SELECT seed, node, min(distance) AS distance FROM walk WHERE node <> seed GROUP BY 1, 2""",
    )
    def _job(spark, sf_dir):
        seeds = views.call_nodes(spark, sf_dir).withColumnRenamed("node", "seed")
        chain = views.call_chain(spark, sf_dir)
        return graph_walk.transitive_reach(seeds, chain, REACH_DEPTH, incoming)


_register_reach("transitive_reach", False)
_register_reach("transitive_dependents", True)

_LANES = " ".join(
    f"WHEN type = '{kind}' AND way = '{way}' THEN {i}"
    for i, (kind, way, _) in enumerate(graph_walk.IMPACT_REASONS)
)
_REASONS = "[" + ", ".join(f"'{reason}'" for _, _, reason in graph_walk.IMPACT_REASONS) + "]"
IMPACT_SQL = f"""
arcs AS (SELECT node, next, CASE {_LANES} END AS lane FROM (
  SELECT source AS node, target AS next, type, 'out' AS way FROM edges
  UNION ALL SELECT target, source, type, 'in' FROM edges)),
one AS (SELECT s.qualified_name AS root, a.next AS node, a.lane, 1 AS d FROM symbols s
  JOIN arcs a ON a.node = s.qualified_name WHERE a.next <> s.qualified_name),
two AS (SELECT o.root, a.next AS node, a.lane, 2 AS d FROM one o JOIN arcs a ON a.node = o.node AND a.lane = o.lane
  WHERE a.next <> o.root),
hit AS (SELECT root, node, min(d * 10 + lane) AS best FROM (FROM one UNION FROM two) GROUP BY 1, 2),
impacted AS (SELECT root AS change_id, node AS symbol, (best // 10)::INTEGER AS distance, {_REASONS}[best % 10 + 1] AS reason FROM hit)
"""


def _impact(spark, sf_dir):
    # The walks make neighbours distinct themselves.
    symbols, edges = views.symbols(spark, sf_dir), views.edge_rows(spark, sf_dir)
    roots = symbols.select(
        F.col("qualified_name").alias("change_id"),
        F.col("qualified_name").alias("root"),
        F.lit(0).alias("root_order"),
    )
    return roots, edges, symbols


@query("impact", f"{WITH}, {IMPACT_SQL} SELECT change_id, symbol, distance, reason FROM impacted")
def _impact_query(spark, sf_dir):
    roots, edges, _ = _impact(spark, sf_dir)
    return graph_walk.impact(roots, edges, 2)


@query(
    "impact_report",
    f"""{WITH}, {IMPACT_SQL},
    sized AS (SELECT s.qualified_name AS change_id, count(i.symbol) AS impacted_symbols,
      coalesce(max(i.distance), 0) AS max_distance, count(DISTINCT m.module) AS impacted_modules
      FROM symbols s LEFT JOIN impacted i ON i.change_id = s.qualified_name
      LEFT JOIN symbols m ON m.qualified_name = i.symbol GROUP BY 1)
    SELECT *, CASE WHEN impacted_symbols = 0 THEN 0.0::DOUBLE ELSE round(CASE WHEN max_distance <= 1 THEN 1.0::DOUBLE
      ELSE 0.8::DOUBLE END / (1 + (impacted_symbols - 1) * 0.1::DOUBLE), 6) END AS confidence FROM sized""",
)
def _impact_report(spark, sf_dir):
    roots, edges, symbols = _impact(spark, sf_dir)
    return graph_walk.impact_report(roots, graph_walk.impact(roots, edges, 2, graph_walk.module_owners(symbols)))


@query(
    "impacted_modules",
    f"""{WITH}, {IMPACT_SQL} SELECT DISTINCT i.change_id, m.module FROM impacted i
    JOIN symbols m ON m.qualified_name = i.symbol""",
)
def _impacted_modules(spark, sf_dir):
    roots, edges, symbols = _impact(spark, sf_dir)
    return graph_walk.impacted_modules(graph_walk.impact(roots, edges, 2, graph_walk.module_owners(symbols)))


@query(
    "impacted_tests",
    f"""{WITH}, {IMPACT_SQL},
    scope AS (SELECT change_id, symbol AS node FROM impacted UNION SELECT qualified_name, qualified_name FROM symbols),
    tests AS (SELECT qualified_name AS node, module FROM symbols WHERE starts_with(module, 'tests/')
      UNION SELECT name, module FROM symbols WHERE starts_with(module, 'tests/')),
    beside AS (SELECT DISTINCT e.source AS node, t.module FROM edges e JOIN tests t ON t.node IN (e.source, e.target)
      UNION SELECT e.target, t.module FROM edges e JOIN tests t ON t.node IN (e.source, e.target))
    SELECT DISTINCT s.change_id, b.module FROM scope s JOIN beside b ON b.node = s.node""",
)
def _impacted_tests(spark, sf_dir):
    roots, edges, symbols = _impact(spark, sf_dir)
    return graph_walk.impacted_tests(roots, edges, symbols, 2)


@query(
    "call_components",
    """WITH RECURSIVE up(block, root) AS (SELECT DISTINCT c_custkey // 4, c_custkey // 4 FROM customer
      UNION ALL SELECT block, (root - 1) // 4 FROM up WHERE root >= 2)
    SELECT c_custkey AS node, min(up.root) * 4 AS component FROM customer JOIN up ON up.block = c_custkey // 4
    WHERE up.root < 2 GROUP BY 1""",
)
def _call_components(spark, sf_dir):
    return graph_walk.connected_components(
        views.call_nodes(spark, sf_dir), views.call_chain(spark, sf_dir)
    )


RINGS_SQL = """
rings AS (SELECT c_custkey // 4 AS block FROM customer WHERE c_custkey % 4 = 3 AND c_nationkey % 2 = 0),
ring_nodes AS (SELECT c_custkey - c_custkey % 4 AS cycle_id, c_custkey AS node FROM customer
  WHERE c_custkey // 4 IN (SELECT block FROM rings))
"""


@query("dependency_cycles", f"WITH {RINGS_SQL} SELECT cycle_id, node FROM ring_nodes")
def _dependency_cycles(spark, sf_dir):
    return graph_walk.dependency_cycles(views.call_chain(spark, sf_dir))


@query(
    "call_depth",
    f"""WITH RECURSIVE {views.CHAIN_SQL}, {RINGS_SQL},
    free AS (SELECT source, target FROM chain WHERE source NOT IN (SELECT node FROM ring_nodes)
      AND target NOT IN (SELECT node FROM ring_nodes)),
    walk(node, depth) AS (SELECT DISTINCT source, 0 FROM free
      UNION SELECT f.target, w.depth + 1 FROM walk w JOIN free f ON f.source = w.node)
    SELECT max(depth)::BIGINT AS maximum_call_depth, (SELECT count(*) FROM ring_nodes) AS cyclic_nodes FROM walk""",
)
def _call_depth(spark, sf_dir):
    return graph_walk.call_depth(views.call_nodes(spark, sf_dir), views.call_chain(spark, sf_dir))


# --- workflow graphs ---------------------------------------------------------------------------

DEPS_SQL = """
nodes AS (SELECT l_orderkey * 10 + l_linenumber AS node FROM lineitem),
deps AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS node, l_orderkey * 10 + l_linenumber - 1 AS depends_on
  FROM lineitem WHERE l_linenumber > 1)
"""


def _workflow(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    name = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    nodes = lines.select(name.alias("node"))
    deps = lines.where("l_linenumber > 1").select(name.alias("node"), (name - 1).alias("depends_on"))
    return nodes, deps.distinct()


@query(
    "dag_layers",
    f"""WITH RECURSIVE {DEPS_SQL}, inner_deps AS (SELECT * FROM deps WHERE depends_on IN (SELECT node FROM nodes)),
    walk(node, layer) AS (SELECT DISTINCT node, 0 FROM nodes WHERE node NOT IN (SELECT node FROM inner_deps)
      UNION SELECT d.node, w.layer + 1 FROM walk w JOIN inner_deps d ON d.depends_on = w.node)
    SELECT node, max(layer) AS layer FROM walk GROUP BY node""",
)
def _dag_layers(spark, sf_dir):
    nodes, deps = _workflow(spark, sf_dir)
    known = nodes.select(F.col("node").alias("depends_on")).distinct()
    return graph_walk.dag_layers(nodes, deps.join(known, "depends_on", "left_semi"))


@query(
    "dag_checks",
    f"""WITH RECURSIVE {DEPS_SQL},
    reach(node) AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM deps)
      UNION SELECT d.node FROM reach r JOIN deps d ON d.depends_on = r.node)
    SELECT 'duplicate' AS problem, node FROM nodes GROUP BY node HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'unknown dependency', node FROM deps WHERE depends_on NOT IN (SELECT node FROM nodes)
    UNION ALL SELECT DISTINCT 'unreachable', node FROM nodes WHERE node NOT IN (SELECT node FROM reach)""",
)
def _dag_checks(spark, sf_dir):
    return graph_walk.dag_checks(*_workflow(spark, sf_dir))


# --- findings ----------------------------------------------------------------------------------

CLOSURE_SQL = """
core AS (SELECT DISTINCT source, target FROM edges WHERE source <> target
  AND source IN (SELECT target FROM edges) AND target IN (SELECT source FROM edges)),
closure(a, b) AS (SELECT source, target FROM core UNION SELECT c.a, e.target FROM closure c JOIN core e ON e.source = c.b),
cycles AS (SELECT c.a AS node, least(c.a, min(c.b)) AS cycle_id FROM closure c JOIN closure d ON d.a = c.b AND d.b = c.a
  WHERE c.a <> c.b GROUP BY c.a)
"""
FINDINGS_SQL = f"""
{COUPLING_SQL}, {HIGH_SQL.format(m='1.5::DOUBLE')}, {DEAD_SQL}, {ORPHAN_SQL}, {CLOSURE_SQL},
cycle_members AS (SELECT DISTINCT cycle_id, node, module FROM cycles JOIN symbols ON qualified_name = node),
cycle_labels AS (SELECT cycle_id, min(module) || CASE WHEN count(*) > 1 THEN ' +' || (count(*) - 1) || ' #' || sum(('0x' || left(md5(module), 15))::BIGINT) ELSE '' END AS modules
  FROM (SELECT DISTINCT cycle_id, module FROM cycle_members) GROUP BY cycle_id),
looped AS (SELECT modules, count(DISTINCT node) AS length FROM cycle_members JOIN cycle_labels USING (cycle_id) GROUP BY cycle_id, modules),
raw AS (
  SELECT 'HIGH_COUPLING' AS category, 'HIGH' AS severity, module AS modules, 2 AS evidence, total AS measure, 0.72 AS confidence FROM high
  UNION ALL SELECT 'LARGE_MODULE', 'MEDIUM', module, 1, count(*), 0.5 FROM symbols GROUP BY module HAVING count(*) >= 30
  UNION ALL SELECT 'DEAD_CODE', 'HIGH', module, 1 + least(count(*), 5), count(*), CASE WHEN count(*) = 1 THEN 0.81 ELSE 0.9 END FROM dead GROUP BY module
  UNION ALL SELECT 'ORPHAN_MODULE', 'MEDIUM', path, 1, symbol_count, 0.68 FROM orphans
  UNION ALL SELECT 'EXCESSIVE_DEPENDENCIES', 'MEDIUM', module, 1, n, 0.54 FROM
    (SELECT source, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) > 20) JOIN symbols ON qualified_name = source
  UNION ALL SELECT 'CIRCULAR_DEPENDENCY', 'HIGH', modules, 1, length, 0.76 FROM looped),
findings AS (SELECT category || ':' || modules AS id, category, modules, any_value(severity) AS severity,
  max(evidence)::BIGINT AS evidence, max(measure)::BIGINT AS measure, max(confidence)::DOUBLE AS confidence
  FROM raw GROUP BY category, modules)
"""


def _findings(spark, sf_dir):
    modules, symbols, edges = _tables(spark, sf_dir)
    edges = cut_lineage(edges)
    cycles = graph_walk.dependency_cycles(edges)
    return graph.refactoring_findings(modules, symbols, edges, cycles, large_threshold=30)


@query("refactoring_findings", f"WITH RECURSIVE {views.GRAPH_SQL}, {FINDINGS_SQL} SELECT * FROM findings")
def _refactoring_findings(spark, sf_dir):
    return graph.ordered_findings(_findings(spark, sf_dir))


@query(
    "cycle_modules",
    f"""WITH RECURSIVE {views.GRAPH_SQL}, {FINDINGS_SQL}
    SELECT DISTINCT modules, module FROM cycle_members JOIN cycle_labels USING (cycle_id)""",
)
def _cycle_modules(spark, sf_dir):
    _, symbols, edges = _tables(spark, sf_dir)
    edges = cut_lineage(edges)
    owner = symbols.groupBy(F.col("qualified_name").alias("node")).agg(F.min("module").alias("module"))
    return graph.cycle_modules(graph_walk.dependency_cycles(edges).join(owner, "node"))


@query(
    "finding_summary",
    f"""WITH RECURSIVE {views.GRAPH_SQL}, {FINDINGS_SQL} SELECT count(*) AS total,
    count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
    0::BIGINT AS low, 0::BIGINT AS info FROM findings""",
)
def _finding_summary(spark, sf_dir):
    return graph.finding_summary(_findings(spark, sf_dir))


@query(
    "finding_confidence",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE least(p_size % 4, 3) WHEN 0 THEN 0.45 WHEN 1 THEN 0.72
      WHEN 2 THEN 0.81 ELSE 0.9 END ELSE CASE least(p_size % 4, 3) WHEN 0 THEN 0.47 WHEN 1 THEN 0.76 WHEN 2 THEN 0.85
      ELSE 0.95 END END::DOUBLE AS confidence FROM part""",
)
def _finding_confidence(spark, sf_dir):
    category = F.when(F.col("p_partkey") % 2 == 0, "DEAD_CODE").otherwise("CIRCULAR_DEPENDENCY")
    score = graph.finding_confidence(category, F.col("p_size") % 4, F.lit(1.0))
    return views.table(spark, sf_dir, "part").select("p_partkey", score.alias("confidence"))


@query(
    "top_module_impact",
    f"""{WITH}, {COUPLING_SQL}, {IMPACT_SQL},
    top AS (SELECT module FROM coupled ORDER BY dependency_count + dependent_count DESC, module LIMIT 3),
    picked AS (SELECT qualified_name FROM symbols WHERE module IN (FROM top)
      ORDER BY (SELECT dependency_count + dependent_count FROM coupled c WHERE c.module = symbols.module) DESC, module, p_partkey LIMIT 5),
    near AS (SELECT symbol, min(distance) AS distance FROM impacted WHERE change_id IN (FROM picked) GROUP BY symbol),
    sized AS (SELECT count(*) AS impacted_symbols, max(distance) AS max_distance FROM near)
    SELECT impacted_symbols, max_distance, round(CASE WHEN max_distance <= 1 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END
      / (1 + (impacted_symbols - 1) * 0.1::DOUBLE), 6) AS confidence FROM sized""",
)
def _top_module_impact(spark, sf_dir):
    modules, symbols, edges = _tables(spark, sf_dir)
    return graph_walk.top_module_impact(modules, symbols, edges)
