"""Retrieval queries: benchmark items ask, parts are the symbols."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from tracelode import views
from tracelode.operators import postings, quality, retrieval
from tracelode.plans.conversation_plans import TOKENISE_SQL
from tracelode.plans.registry import query
from tracelode.session import cut_lineage

_GENERATED = " OR ".join(f"contains(lname, '{m}')" for m in retrieval.GENERATED_MARKS)
_TESTS = "[" + ", ".join(f"'{w}'" for w in retrieval.TEST_WORDS) + "]"
SCORED_SQL = rf"""
{views.CANDIDATES_SQL},
source AS (SELECT query_id AS id, text AS t FROM query), {TOKENISE_SQL},
asked AS (SELECT id AS query_id, tokens, list_has_any(tokens, {_TESTS}) AS wants FROM tokenised),
named AS (SELECT *, lower(qualified_name) AS lname, lower(module) AS lmodule,
  starts_with(regexp_extract(qualified_name, '[^.]*$'), '_') AS private, contains(lower(module), 'test_') AS is_test FROM cand),
feats AS (SELECT *, regexp_extract_all(lname, '[a-z0-9_]+') AS segs, ({_GENERATED}) AS generated,
  (CASE WHEN private THEN -10 ELSE 5 END) + (CASE WHEN symbol_type <> 'constant' THEN 10 ELSE 0 END) + (CASE WHEN in_init THEN 15 ELSE 0 END)
  + (CASE WHEN docstring IS NOT NULL THEN 10 ELSE 0 END) + (CASE WHEN n_lines BETWEEN 1 AND 50 THEN 15 WHEN n_lines > 100 THEN -5 ELSE 0 END)
  + (CASE WHEN {_GENERATED} THEN -20 ELSE 0 END) AS base FROM named),
phrased AS (SELECT *, list_transform(segs, lambda s: '_' || array_to_string(list_filter(string_split(s, '_'), lambda p: p <> ''), '_') || '_') AS phrases FROM feats),
pairs AS (SELECT p.*, a.query_id, a.tokens, a.wants,
  flatten(list_transform(tokens, lambda t: list_filter(range(1, len(segs) + 1), lambda i: segs[i] = t OR trim(segs[i], '_') = t
    OR (contains(t, '_') AND contains(phrases[i], '_' || t || '_'))))) AS hits FROM phrased p, asked a WHERE len(a.tokens) > 0),
hit AS (SELECT *, segs[hits[1]] AS h FROM pairs),
around AS (SELECT *, list_filter(segs, lambda s: strpos(s, h) > 1)[1] AS o,
  list_contains(tokens, lname) AS qualified,
  len(list_filter(tokens, lambda t: len(list_filter(segs, lambda s: contains(s, t))) > 0)) > 0 AS part,
  len(list_filter(tokens, lambda t: contains(lname, t))) AS n_name,
  len(list_filter(tokens, lambda t: contains(lmodule, t))) AS n_mod,
  len(list_filter(tokens, lambda t: contains(lname || ' ' || lmodule || ' ' || array_to_string(phrases, ' '), t))) > 0 AS touched FROM hit),
scored AS (SELECT *, (CASE WHEN len(hits) > 0 THEN 100 - coalesce(floor(50 * (1.0::DOUBLE - length(h)::DOUBLE / length(o))), 0)::INT
    WHEN qualified THEN 90 WHEN part THEN 50 WHEN n_mod > 0 THEN 30 ELSE 0 END + n_name * 10
    + CASE WHEN n_mod >= 2 THEN n_mod * 10 ELSE 0 END + base + CASE WHEN is_test THEN CASE WHEN wants THEN 75 ELSE -50 END ELSE 0 END)::BIGINT AS score,
  concat_ws('|', CASE WHEN len(hits) > 0 THEN 'EXACT_SYMBOL_NAME' WHEN qualified THEN 'EXACT_QUALIFIED_NAME' WHEN part THEN 'PARTIAL_SYMBOL_NAME'
      WHEN n_mod > 0 THEN 'MODULE_MATCH' END, CASE WHEN n_name > 0 THEN 'TOKEN_MATCH' END, CASE WHEN n_mod >= 2 THEN 'MODULE_TOKEN_MATCH' END,
    CASE WHEN NOT private THEN 'PUBLIC_NAME' END, CASE WHEN symbol_type <> 'constant' THEN 'SYMBOL_TYPE_PREFERENCE' END,
    CASE WHEN in_init THEN 'PUBLIC_API_BONUS' END, CASE WHEN docstring IS NOT NULL THEN 'DOCUMENTATION_BONUS' END,
    CASE WHEN n_lines BETWEEN 1 AND 50 THEN 'IMPLEMENTATION_SIZE_BONUS' END, CASE WHEN generated THEN 'GENERATED_CODE' END,
    CASE WHEN is_test THEN CASE WHEN wants THEN 'TEST_TARGET' ELSE 'TEST_CODE' END END,
    CASE WHEN private THEN 'PRIVATE_SYMBOL' END, CASE WHEN n_lines > 100 THEN 'LARGE_IMPLEMENTATION' END) AS reasons FROM around)
"""
_TYPE_RANK = "CASE symbol_type WHEN 'class' THEN 3 WHEN 'function' THEN 2 WHEN 'method' THEN 1 ELSE 0 END"


def _best_sql(name: str, where: str) -> str:
    return f"""
{name}_named AS (SELECT *, row_number() OVER (PARTITION BY query_id, qualified_name
    ORDER BY score DESC, {_TYPE_RANK} DESC, module, symbol_id) AS copy FROM scored WHERE score >= 1 AND {where}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qualified_name) AS rank
  FROM {name}_named WHERE copy = 1)
"""


TOP_SQL = f"""
{SCORED_SQL}, {_best_sql('whole', 'true')},
topk AS (SELECT w.*, q.max_modules, q.max_tokens, q.text FROM whole w JOIN query q USING (query_id) WHERE rank <= max_symbols)
"""


class Bench:
    """The prepared inputs of one run."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.candidates = views.candidates(spark, sf_dir)

    @cached_property
    def queries(self):
        return cut_lineage(retrieval.prepare_queries(views.retrieval_queries(self.spark, self.sf_dir)))

    @cached_property
    def symbols(self):
        return cut_lineage(retrieval.prepare_symbols(self.candidates))

    @cached_property
    def postings(self):
        tokens = postings.asked_tokens(self.queries)
        return cut_lineage(postings.token_postings(tokens, self.symbols))

    def scored(self):
        return postings.score_symbols(self.queries, self.symbols, self.postings)

    @cached_property
    def _top(self):
        return cut_lineage(retrieval.top_k(self.queries, self.symbols, self.postings))

    def top(self):
        return self._top

    def edges(self):
        return views.named_edges(self.spark, self.sf_dir)

    def imports(self):
        return views.retrieval_imports(self.spark, self.sf_dir)

    def enriched(self):
        return retrieval.support_previews(self.top(), self.queries, self.candidates)

    def trimmed(self):
        modules = retrieval.selected_modules(self.top(), self.queries)
        return retrieval.budget_trim(self.enriched(), modules, self.queries)


@query("score_symbols", f"WITH {SCORED_SQL} SELECT query_id, symbol_id, score, reasons FROM scored WHERE touched")
def _score_symbols(spark, sf_dir):
    scored = Bench(spark, sf_dir).scored()
    return scored.select("query_id", "symbol_id", "score", F.array_join("reasons", "|").alias("reasons"))


@query(
    "rank_candidates",
    f"WITH {SCORED_SQL}, {_best_sql('ranked', 'touched')} SELECT query_id, qualified_name, score, rank FROM ranked",
)
def _rank(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    ranked = retrieval.rank_candidates(bench.queries, bench.symbols, bench.postings)
    return ranked.select("query_id", "qualified_name", "score", "rank")


@query("top_k", f"WITH {TOP_SQL} SELECT query_id, rank::INTEGER AS rank, qualified_name, symbol_id, score FROM topk")
def _top_k(spark, sf_dir):
    return Bench(spark, sf_dir).top().select("query_id", "rank", "qualified_name", "symbol_id", "score")


MODULES_SQL = """
first_seen AS (SELECT query_id, module, min(rank) AS first, any_value(max_modules) AS max_modules FROM topk GROUP BY 1, 2),
mods AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM first_seen) WHERE place <= max_modules)
"""


@query("selected_modules", f"WITH {TOP_SQL}, {MODULES_SQL} SELECT query_id, module, place FROM mods")
def _selected_modules(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    return retrieval.selected_modules(bench.top(), bench.queries)


_SIZES_SQL = """length(qualified_name) + length(module) + length(signature) + coalesce(length(docstring), 0)"""


@query(
    "candidate_tokens",
    f"""WITH {views.CANDIDATES_SQL} SELECT symbol_id,
    greatest(1, ({_SIZES_SQL} + least(length(source), 8192)) // 4) AS primary_tokens,
    greatest(1, ({_SIZES_SQL} + CASE WHEN length(source) > 2048 THEN 2048 + {len(retrieval.EXCERPT_MARKER)} ELSE length(source) END) // 4)
      AS support_tokens FROM cand""",
)
def _candidate_tokens(spark, sf_dir):
    return retrieval.candidate_tokens(retrieval.prepare_symbols(views.candidates(spark, sf_dir)))


RELATION_SQL = """
firsts AS (SELECT query_id, qualified_name AS primary_name, module AS primary_module FROM topk WHERE rank = 1),
near AS ({near}),
related AS (SELECT query_id, primary_name, qualified_name, module,
  (CASE WHEN module = primary_module THEN 20 ELSE 0 END
  + CASE WHEN len(string_split(qualified_name, '.')) >= 3 AND len(string_split(primary_name, '.')) >= 3
      AND regexp_replace(qualified_name, '\\.[^.]*$', '') = regexp_replace(primary_name, '\\.[^.]*$', '') THEN 25 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM named_edges e WHERE e.type = 'calls' AND e.source = qualified_name AND e.target = primary_name) THEN 30 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM named_edges e WHERE e.type = 'calls' AND e.target = qualified_name AND e.source = primary_name) THEN 30 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM named_edges e JOIN named_edges f ON e.source = f.source AND e.type = 'defines' AND f.type = 'defines'
      WHERE e.target = primary_name AND f.target = qualified_name) THEN 20 ELSE 0 END)::BIGINT AS relation_score FROM near)
"""
_TOP_NEAR = "SELECT t.query_id, primary_name, primary_module, qualified_name, module FROM topk t JOIN firsts f ON f.query_id = t.query_id WHERE qualified_name <> primary_name"


@query(
    "score_relationship",
    f"WITH {TOP_SQL}, {RELATION_SQL.format(near=_TOP_NEAR)} SELECT query_id, qualified_name, relation_score FROM related",
)
def _relationship(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    pairs = retrieval.with_primary(bench.top()).select(
        "query_id", "primary", "primary_module", "qualified_name", "module"
    )
    return retrieval.score_relationship(pairs, bench.edges()).select(
        "query_id", "qualified_name", "relation_score"
    )


_CALL_NEAR = """SELECT DISTINCT f.query_id, primary_name, primary_module, k.qualified_name, k.module FROM firsts f
  JOIN named_edges e ON e.type = 'calls' AND primary_name IN (e.source, e.target)
  JOIN known k ON k.qualified_name = CASE WHEN e.source = primary_name THEN e.target ELSE e.source END
  WHERE NOT EXISTS (SELECT 1 FROM topk t WHERE t.query_id = f.query_id AND t.qualified_name = k.qualified_name)"""


@query(
    "expand_neighbours",
    f"""WITH {TOP_SQL},
    costs AS (SELECT symbol_id, qualified_name, module, greatest(1, ({_SIZES_SQL} + least(length(source), 8192)) // 4) AS p,
      greatest(1, ({_SIZES_SQL} + CASE WHEN length(source) > 2048 THEN 2048 + {len(retrieval.EXCERPT_MARKER)} ELSE length(source) END) // 4) AS s FROM cand),
    known AS (SELECT qualified_name, arg_min(module, symbol_id) AS module, arg_min(s, symbol_id) AS s FROM costs GROUP BY 1),
    spent AS (SELECT query_id, sum(CASE WHEN rank = 1 THEN p ELSE s END) AS spent, any_value(max_tokens) * 20 AS max_tokens FROM topk JOIN costs USING (symbol_id) GROUP BY 1),
    {RELATION_SQL.format(near=_CALL_NEAR)},
    run AS (SELECT r.*, sum(k.s) OVER (PARTITION BY query_id ORDER BY relation_score DESC, qualified_name) AS running
      FROM related r JOIN known k USING (qualified_name))
    SELECT query_id, qualified_name, relation_score FROM run JOIN spent USING (query_id) WHERE spent + running <= max_tokens""",
)
def _expand(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    roomy = bench.queries.withColumn("max_tokens", F.col("max_tokens") * 20)
    rows = retrieval.expand_neighbours(bench.top(), roomy, bench.symbols, bench.edges())
    return rows.select("query_id", "qualified_name", "relation_score")


_MARK = len(retrieval.EXCERPT_MARKER)
PREVIEW_SQL = f"""
limits AS (SELECT query_id, len(regexp_extract_all(text, '[\\w./\\\\-]+\\.py')) >= 2 AS several, max_tokens FROM query),
ordered AS (SELECT t.query_id, t.rank, t.symbol_id, length(t.source) AS size, several,
  CASE WHEN several THEN greatest(512, l.max_tokens // 2) ELSE 512 END AS pool FROM topk t JOIN limits l USING (query_id)),
spend(query_id, rank, symbol_id, allowed, remaining) AS (
  SELECT query_id, rank, symbol_id, 0, pool FROM ordered WHERE rank = 1
  UNION ALL SELECT o.query_id, o.rank, o.symbol_id,
    CASE WHEN s.remaining > 0 AND o.size > 0 THEN CASE WHEN several THEN least(s.remaining, 512) ELSE s.remaining END ELSE 0 END,
    greatest(0, s.remaining - CASE WHEN s.remaining > 0 AND o.size > 0 THEN
      (CASE WHEN o.size > 4 * (CASE WHEN several THEN least(s.remaining, 512) ELSE s.remaining END)
        THEN 4 * (CASE WHEN several THEN least(s.remaining, 512) ELSE s.remaining END) + {_MARK} ELSE o.size END) // 4 ELSE 0 END)
  FROM spend s JOIN ordered o ON o.query_id = s.query_id AND o.rank = s.rank + 1),
enriched AS (SELECT t.*, CASE WHEN t.rank = 1 THEN left(t.source, 4 * CASE WHEN several THEN least(2048, greatest(512, t.max_tokens // 4)) ELSE 2048 END) ELSE '' END AS src,
  CASE WHEN allowed = 0 THEN '' WHEN length(t.source) > allowed * 4 THEN left(t.source, allowed * 4) || chr(10) || '    # ... (truncated)' ELSE t.source END AS preview
  FROM topk t JOIN spend s ON s.query_id = t.query_id AND s.rank = t.rank JOIN limits l ON l.query_id = t.query_id)
"""


@query(
    "support_previews",
    f"""WITH RECURSIVE {TOP_SQL}, {PREVIEW_SQL}
    SELECT query_id, rank::INTEGER AS rank, length(src) AS source_chars, md5(preview) AS preview FROM enriched""",
)
def _previews(spark, sf_dir):
    rows = Bench(spark, sf_dir).enriched()
    return rows.select(
        "query_id", "rank", F.length("source").cast("bigint").alias("source_chars"), F.md5("preview").alias("preview")
    )


TRIM_SQL = f"""
{MODULES_SQL}, {PREVIEW_SQL},
sized AS (SELECT e.*, length(src) + length(preview) + {_SIZES_SQL.replace('module', 'e.module')} AS own,
  CASE WHEN m.module IS NOT NULL AND row_number() OVER (PARTITION BY e.query_id, e.module ORDER BY rank) = 1 THEN length(e.module) ELSE 0 END AS path,
  m.module IS NOT NULL AS listed FROM enriched e LEFT JOIN mods m ON m.query_id = e.query_id AND m.module = e.module),
upto AS (SELECT *, sum(own + path) OVER (PARTITION BY query_id ORDER BY rank) // 4 AS tokens_upto FROM sized),
roomed AS (SELECT *, rank = 1 AND tokens_upto > max_tokens AS over, greatest(0, max_tokens * 4 - 4 - (length(qualified_name) + length(module)
  + length(signature) + CASE WHEN listed THEN length(module) ELSE 0 END)) AS room FROM upto WHERE rank = 1 OR tokens_upto <= max_tokens),
trimmed AS (SELECT *, CASE WHEN over AND length(src) > room THEN left(src, room) ELSE src END AS kept_source,
  CASE WHEN over AND length(src) > room THEN '' ELSE preview END AS kept_preview,
  CASE WHEN over AND length(src) > room THEN '' WHEN over THEN left(coalesce(docstring, ''), greatest(0, room - length(src) - length(preview)))
    ELSE coalesce(docstring, '') END AS kept_doc FROM roomed)
"""


@query(
    "budget_trim",
    f"""WITH RECURSIVE {TOP_SQL}, {TRIM_SQL}
    SELECT query_id, rank::INTEGER AS rank, qualified_name, length(kept_source) AS source_chars, length(kept_preview) AS preview_chars,
    length(kept_doc) AS doc_chars FROM trimmed""",
)
def _trim(spark, sf_dir):
    size = lambda name: F.length(name).cast("bigint")
    return Bench(spark, sf_dir).trimmed().select(
        "query_id", "rank", "qualified_name", size("source").alias("source_chars"),
        size("preview").alias("preview_chars"), size("docstring").alias("doc_chars"),
    )


# --- promotion ---------------------------------------------------------------------------------


def _promoted_sql(tiers: str) -> str:
    """`tiers` gives (query_id, module, tier, place); the best symbol of each module goes first."""
    return f"""
wanted AS ({tiers}),
lent AS (SELECT w.query_id, w.tier, w.place, arg_min(s.symbol_id, (-s.score, s.qualified_name)) AS symbol_id,
  arg_min(s.qualified_name, (-s.score, s.qualified_name)) AS qualified_name FROM wanted w
  JOIN scored s ON s.query_id = w.query_id AND s.module = w.module WHERE s.score >= 1 GROUP BY 1, 2, 3),
lined AS (SELECT query_id, qualified_name, tier, 0 AS rank, place FROM lent
  UNION ALL SELECT query_id, qualified_name, 9, rank, '' FROM topk),
firsts_only AS (SELECT *, row_number() OVER (PARTITION BY query_id, qualified_name ORDER BY tier, rank, place) AS copy FROM lined),
placed AS (SELECT query_id, qualified_name, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, place) AS rank FROM firsts_only WHERE copy = 1)
SELECT p.query_id, qualified_name, p.rank::INTEGER AS rank FROM placed p JOIN query q USING (query_id) WHERE p.rank <= max_symbols"""


_REFS = r"""refs AS (SELECT query_id, ref AS module, min(pos) AS pos FROM (SELECT query_id, unnest(range(len(found))) AS pos,
    unnest(list_transform(found, lambda f: left(f, length(f) - 3))) AS ref FROM (SELECT query_id, regexp_extract_all(text, '[\w./\\-]+\.py') AS found FROM query)) GROUP BY 1, 2)"""


@query(
    "promote_referenced",
    f"WITH {TOP_SQL}, {_REFS}, "
    + _promoted_sql(
        """SELECT query_id, module, 0 AS tier, lpad(pos::VARCHAR, 9, '0') AS place FROM refs
        UNION ALL SELECT DISTINCT r.query_id, i.module, 1, i.module FROM refs r JOIN mod_imports i ON i.imported = r.module
        WHERE NOT EXISTS (SELECT 1 FROM refs x WHERE x.query_id = r.query_id AND x.module = i.module)"""
    ).lstrip(),
)
def _promote_referenced(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    rows = retrieval.promote_referenced(
        bench.top(), bench.queries, bench.symbols, bench.postings, bench.imports()
    )
    return rows.select("query_id", "qualified_name", "rank")


PROMOTIONS = (
    (("where is", "economy"), ("economy/brand_1.Holder.small_ring_0", "economy/brand_2.red_bolt_1")),
    (("tests for",), ("standard/brand_3.RingBox.blue_bolt_4", "missing.symbol")),
)


def _promotion_names_sql() -> str:
    rows = []
    for number, (needles, names) in enumerate(PROMOTIONS):
        test = " AND ".join(f"contains(lower(text), '{n}')" for n in needles)
        for i, name in enumerate(names):
            rows.append(
                f"SELECT query_id, '{name}' AS qualified_name, '{number:03d}{i:05d}' AS place FROM query WHERE {test}"
            )
    return " UNION ALL ".join(rows)


@query(
    "promote_named",
    f"""WITH {TOP_SQL}, named_first AS ({_promotion_names_sql()}),
    lined AS (SELECT query_id, qualified_name, 0 AS tier, 0 AS rank, place FROM named_first WHERE qualified_name IN (SELECT qualified_name FROM cand)
      UNION ALL SELECT query_id, qualified_name, 9, rank, '' FROM topk),
    firsts_only AS (SELECT *, row_number() OVER (PARTITION BY query_id, qualified_name ORDER BY tier, rank, place) AS copy FROM lined),
    placed AS (SELECT query_id, qualified_name, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, place) AS rank FROM firsts_only WHERE copy = 1)
    SELECT p.query_id, qualified_name, p.rank::INTEGER AS rank FROM placed p JOIN query q USING (query_id) WHERE p.rank <= max_symbols""",
)
def _promote_named(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    rows = retrieval.promote_named(bench.top(), bench.queries, bench.symbols, PROMOTIONS)
    return rows.select("query_id", "qualified_name", "rank")


@query(
    "promote_shared_helpers",
    rf"""WITH {TOP_SQL}, about AS (SELECT query_id, list_filter(tokens, lambda t: length(t) > 2) AS words FROM asked
      WHERE query_id IN (SELECT query_id FROM query WHERE contains(lower(text), 'shared helper'))),
    used AS (SELECT t.query_id, i.imported, min(t.rank) AS first FROM topk t JOIN about a ON a.query_id = t.query_id
      JOIN mod_imports i ON i.module = t.module WHERE t.rank <= 8
      AND (len(list_intersect(list_filter(string_split_regex(lower(i.imported), '[^a-zA-Z0-9]+|_'), lambda p: p <> ''), a.words)) >= 2
        OR list_contains(string_split_regex(lower(i.imported), '[^a-zA-Z0-9]+|_'), 'helper')) GROUP BY 1, 2),
    """
    + _promoted_sql(
        """SELECT query_id, imported AS module, 0 AS tier, lpad(first::VARCHAR, 9, '0') || imported AS place FROM used
        UNION ALL SELECT DISTINCT u.query_id, i.module, 1, i.module FROM used u JOIN mod_imports i ON i.imported = u.imported
        WHERE NOT EXISTS (SELECT 1 FROM used x WHERE x.query_id = u.query_id AND x.imported = i.module)"""
    ).lstrip(),
)
def _promote_shared(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    rows = retrieval.promote_shared_helpers(
        bench.top(), bench.queries, bench.symbols, bench.postings, bench.imports()
    )
    return rows.select("query_id", "qualified_name", "rank")


# --- packages ----------------------------------------------------------------------------------


@query(
    "compose_package",
    f"""WITH {TOP_SQL}, f AS (SELECT query_id, qualified_name AS p, module AS pm FROM topk WHERE rank = 1)
    SELECT query_id, any_value(p) AS primary, string_agg(qualified_name, '|' ORDER BY rank) FILTER (rank > 1) AS supporting,
    coalesce(string_agg(DISTINCT qualified_name, '|' ORDER BY qualified_name) FILTER (rank > 1 AND module = pm), '') AS after,
    string_agg(DISTINCT module, '|' ORDER BY module) AS modules, count(DISTINCT module)::INTEGER AS module_count, count(*)::INTEGER AS symbol_count
    FROM topk JOIN f USING (query_id) GROUP BY query_id""",
)
def _compose(spark, sf_dir):
    packed = retrieval.compose_package(Bench(spark, sf_dir).top())
    flat = lambda name: F.array_join(name, "|").alias(name)
    return packed.select(
        "query_id", "primary", flat("supporting"), flat("after"), flat("modules"), "module_count", "symbol_count"
    )


@query(
    "module_describe",
    rf"""WITH {TOP_SQL}, f AS (SELECT query_id, qualified_name AS p, module AS pm FROM topk WHERE rank = 1)
    SELECT query_id, module, count(*) AS symbols, 'Module: ' || regexp_extract(module, '[^/]*$') AS purpose,
    CASE WHEN bool_or(module = pm) THEN 'Contains the primary symbol'
      WHEN bool_or(regexp_replace(qualified_name, '\.[^.]*$', '') = regexp_replace(p, '\.[^.]*$', '')) THEN 'Shares class scope with primary symbol'
      ELSE 'Supporting module with related symbols' END AS relation
    FROM topk JOIN f USING (query_id) GROUP BY query_id, module""",
)
def _describe(spark, sf_dir):
    return retrieval.module_describe(Bench(spark, sf_dir).top())


@query(
    "target_rank",
    f"""WITH {TOP_SQL}, targets AS (SELECT query_id, 'economy/brand_1.Holder.small_ring_0' AS name FROM query
      UNION ALL SELECT query_id, qualified_name FROM topk WHERE rank = 3)
    SELECT t.query_id, t.name, coalesce(min(k.rank) - 1, -1)::INTEGER AS place, 0::BIGINT AS repeated,
    (SELECT count(*) FROM topk u WHERE u.query_id = t.query_id AND starts_with(u.qualified_name, 'tests/')) AS unwanted
    FROM targets t LEFT JOIN topk k ON k.query_id = t.query_id AND k.qualified_name = t.name GROUP BY 1, 2""",
)
def _target_rank(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    ranked = bench.top().select("query_id", "rank", F.col("qualified_name").alias("name"))
    fixed = bench.queries.select("query_id", F.lit("economy/brand_1.Holder.small_ring_0").alias("name"))
    targets = fixed.unionByName(ranked.where("rank = 3").select("query_id", "name")).distinct()
    unwanted = spark.createDataFrame([("tests/",)], "prefix string")
    return quality.target_rank(ranked, targets, unwanted)


@query(
    "render_context",
    f"""WITH RECURSIVE {TOP_SQL}, {TRIM_SQL},
    block AS (SELECT query_id, rank, module, CASE WHEN rank = 1 THEN 'Primary symbol: ' || qualified_name || chr(10) || '  Signature: ' || signature
        || CASE WHEN kept_doc <> '' THEN chr(10) || '  Docstring:' || chr(10) || '    ' || kept_doc ELSE '' END
        || CASE WHEN kept_source <> '' THEN chr(10) || '  Source:' || chr(10) || '    ' || replace(regexp_replace(kept_source, '\n$', ''), chr(10), chr(10) || '    ') ELSE '' END
      ELSE CASE WHEN rank = 2 THEN 'Supporting symbols:' || chr(10) ELSE '' END || '  - ' || qualified_name || chr(10) || '    Signature: ' || signature
        || CASE WHEN kept_doc <> '' THEN chr(10) || '    Docstring: ' || kept_doc ELSE '' END
        || CASE WHEN kept_preview <> '' THEN chr(10) || '    Preview:' || chr(10) || '      ' || replace(regexp_replace(kept_preview, '\n$', ''), chr(10), chr(10) || '      ') ELSE '' END
      END AS t FROM trimmed),
    body AS (SELECT query_id, string_agg(t, chr(10) ORDER BY rank) AS body,
      array_to_string(list_transform(list_sort(list(DISTINCT module)), lambda m: '  - ' || m || ': Module: ' || regexp_extract(m, '[^/]*$')), chr(10)) AS mods FROM block GROUP BY 1)
    SELECT query_id, md5('system ' || query_id || chr(10) || chr(10) || {views._sql_text(retrieval.SYSTEM_TEXT)} || chr(10) || chr(10)
      || body || chr(10) || 'Related modules:' || chr(10) || mods) AS content FROM body""",
)
def _render(spark, sf_dir):
    bench = Bench(spark, sf_dir)
    system = bench.queries.select(
        "query_id", F.concat(F.lit("system "), F.col("query_id").cast("string")).alias("system_text")
    )
    rendered = retrieval.render_context(bench.trimmed(), system)
    return rendered.select("query_id", F.md5("content").alias("content"))


@query(
    "context_merge",
    """WITH p AS (SELECT l_orderkey AS request_id, l_linenumber AS package, 'symbol' AS kind, l_partkey AS position, 's' || (l_partkey % 5) AS item FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'module', l_suppkey, 'm' || (l_suppkey % 3) FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY request_id, kind, item ORDER BY package, position) AS n FROM p)
    SELECT request_id, kind, item, package, position FROM f WHERE n = 1""",
)
def _merge(spark, sf_dir):
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    packages = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("package"),
        F.inline(
            F.array(
                F.struct(F.lit("symbol").alias("kind"), F.col("l_partkey").alias("position"), name("s", F.col("l_partkey") % 5).alias("item")),
                F.struct(F.lit("module").alias("kind"), F.col("l_suppkey").alias("position"), name("m", F.col("l_suppkey") % 3).alias("item")),
            )
        ),
    )
    return retrieval.context_merge(packages)


@query(
    "merged_metadata",
    """WITH d AS (SELECT l_orderkey AS request_id, l_linenumber AS package, max(l_partkey) AS t FROM lineitem GROUP BY 1, 2)
    SELECT request_id, 'estimated_tokens' AS key, sum(t)::BIGINT::VARCHAR AS value FROM d GROUP BY 1
    UNION ALL SELECT request_id, 'revision', 'r' || arg_min(t, package) FROM d GROUP BY 1""",
)
def _metadata(spark, sf_dir):
    packages = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").cast("string").alias("t")
    )
    rows = packages.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("package"),
        F.inline(
            F.array(
                F.struct(F.lit("estimated_tokens").alias("key"), F.col("t").alias("value")),
                F.struct(F.lit("revision").alias("key"), F.concat(F.lit("r"), "t").alias("value")),
            )
        ),
    )
    return retrieval.merged_metadata(rows)


@query(
    "symbol_details",
    r"""WITH m AS (SELECT doc_id, '# head' || chr(10) || chr(10) || 'class Doc' || doc_id || ':  ' || chr(10) || '  @cached(1)' || chr(10)
      || '  @plain extra' || chr(10) || replace(text, '@', 'at') AS source FROM documents)
    SELECT 'lib.Doc' || doc_id AS qualified_name, 'class Doc' || doc_id || ':' AS signature, 'cached|plain' AS decorators,
    (length(source) - length(replace(source, chr(10), '')) + 1)::INTEGER AS end_line,
    CASE WHEN length(source) > 1024 THEN left(source, 1024) || chr(10) || '    # ... (truncated)' ELSE source END AS excerpt FROM m""",
)
def _details(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("Doc"), F.col("doc_id").cast("string"))
    source = F.concat(
        F.lit("# head\n\nclass "), name, F.lit(":  \n  @cached(1)\n  @plain extra\n"), F.replace("text", F.lit("@"), F.lit("at"))
    )
    path = F.concat(F.lit("lib/"), name)
    modules = docs.select(path.alias("path"), source.alias("source"))
    symbols = docs.select(
        F.concat(F.lit("lib."), name).alias("qualified_name"), path.alias("module"), F.lit(3).alias("lineno")
    )
    details = retrieval.symbol_details(symbols, modules)
    return details.select(
        "qualified_name", "signature", F.array_join("decorators", "|").alias("decorators"), "end_line", "excerpt"
    )
