"""Consistency checks over order lines read as hunks, applied files and plan steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.operators import checks, graph
from tracelode.plans.registry import query

APPLIED_SQL = """
applied AS (SELECT l_suppkey AS execution_id, 'f' || (l_orderkey % 700) AS path,
  CASE l_linenumber % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'MODIFY' WHEN 2 THEN 'DELETE' ELSE 'RENAME' END AS operation,
  CASE WHEN l_quantity > 49 THEN 'FAILED' ELSE 'APPLIED' END AS status, l_partkey FROM lineitem)
"""


def _applied(spark, sf_dir):
    number = F.col("l_linenumber") % 4
    operation = (
        F.when(number == 0, "ADD").when(number == 1, "MODIFY").when(number == 2, "DELETE").otherwise("RENAME")
    )
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("execution_id"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 700).cast("string")).alias("path"),
        operation.alias("operation"),
        F.when(F.col("l_quantity") > 49, "FAILED").otherwise("APPLIED").alias("status"),
        "l_partkey",
    )


@query(
    "duplicate_changes",
    f"""WITH {APPLIED_SQL} SELECT execution_id, path, count(*) AS times FROM applied GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _duplicates(spark, sf_dir):
    return checks.duplicate_changes(_applied(spark, sf_dir))


@query(
    "failed_changes",
    f"""WITH {APPLIED_SQL} SELECT execution_id, count(*) AS files, count(*) FILTER (status = 'FAILED') AS failed,
    CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM applied GROUP BY 1""",
)
def _failed(spark, sf_dir):
    return checks.failed_changes(_applied(spark, sf_dir))


@query(
    "unexpected_changes",
    """SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase')""",
)
def _unexpected(spark, sf_dir):
    kind = F.col("event_type")
    warning = F.when(kind == "signup", "Untracked file").when(kind == "purchase", "an UNEXPECTED file").otherwise(kind)
    rows = views.table(spark, sf_dir, "events").select("event_id", warning.alias("warning"))
    return checks.unexpected_changes(rows).select("event_id")


@query(
    "stats_mismatch",
    f"""WITH {APPLIED_SQL},
    actual AS (SELECT execution_id, count(*) FILTER (operation = 'MODIFY') AS m, count(*) FILTER (operation = 'ADD') AS a,
      count(*) FILTER (operation = 'DELETE') AS d, count(*) AS t FROM applied GROUP BY 1),
    reported AS (SELECT s_suppkey AS execution_id, m + s_suppkey % 2 AS m, a, d, t - s_suppkey % 3 AS t,
      s_suppkey % 5 - 1 AS la, 3 AS lr FROM supplier LEFT JOIN actual x ON x.execution_id = s_suppkey)
    SELECT r.execution_id, field, reported::BIGINT AS reported, actual::BIGINT AS actual FROM (
      SELECT r.execution_id, 'files_modified' AS field, r.m AS reported, x.m AS actual FROM reported r JOIN actual x USING (execution_id)
      UNION ALL SELECT r.execution_id, 'total_operations', r.t, x.t FROM reported r JOIN actual x USING (execution_id)
      UNION ALL SELECT r.execution_id, 'lines_added', r.la, greatest(r.la, 0) FROM reported r) r WHERE reported <> actual""",
)
def _mismatch(spark, sf_dir):
    applied = _applied(spark, sf_dir)
    op = F.col("operation")
    key = F.col("s_suppkey")
    counted = applied.groupBy("execution_id").agg(
        F.count_if(op == "MODIFY").alias("m"),
        F.count_if(op == "ADD").alias("a"),
        F.count_if(op == "DELETE").alias("d"),
        F.count(F.lit(1)).alias("t"),
    )
    reported = views.table(spark, sf_dir, "supplier").join(
        counted, F.col("s_suppkey") == F.col("execution_id"), "left"
    )
    reported = reported.select(
        key.alias("execution_id"),
        (F.col("m") + key % 2).alias("files_modified"),
        F.col("a").alias("files_created"),
        F.col("d").alias("files_deleted"),
        (F.col("t") - key % 3).alias("total_operations"),
        (key % 5 - 1).alias("lines_added"),
        F.lit(3).alias("lines_removed"),
    )
    return checks.stats_mismatch(applied, reported)


@query(
    "conflicting_changes",
    f"""WITH {APPLIED_SQL}, p AS (SELECT execution_id, path, bool_or(operation = 'ADD') AND bool_or(operation = 'DELETE') AS x,
      bool_or(operation = 'RENAME') AND bool_or(operation = 'MODIFY') AS y FROM applied GROUP BY 1, 2)
    SELECT execution_id, path, 'ADD and DELETE' AS conflict FROM p WHERE x
    UNION ALL SELECT execution_id, path, 'RENAME and MODIFY' FROM p WHERE y""",
)
def _conflicts(spark, sf_dir):
    return checks.conflicting_changes(_applied(spark, sf_dir))


# --- hunks -------------------------------------------------------------------------------------

HUNKS_SQL = """
hunks AS (SELECT 'f' || (l_orderkey % 900) AS file_path, l_suppkey AS patch_set, l_quantity::BIGINT * 3 AS old_start,
  (l_linenumber - 1)::BIGINT AS old_count, l_quantity::BIGINT - 2 AS new_start, l_linenumber::BIGINT AS new_count,
  l_returnflag || '|' || l_linestatus AS lines, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
"""


def _hunks(spark, sf_dir):
    lines = F.array(
        F.concat(F.lit("+"), "l_returnflag"),
        F.when(F.col("l_linestatus") == "O", "--- a/file").otherwise(F.concat(F.lit("-"), "l_linestatus")),
        F.lit(" same"),
        F.lit("+++ b/file"),
    )
    quantity = F.col("l_quantity").cast("bigint")
    return views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 900).cast("string")).alias("file_path"),
        F.col("l_suppkey").alias("patch_set"),
        (quantity * 3).alias("old_start"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("old_count"),
        (quantity - 2).alias("new_start"),
        F.col("l_linenumber").cast("bigint").alias("new_count"),
        lines.alias("diff_lines"),
    )


@query(
    "hunk_overlaps",
    f"""WITH {HUNKS_SQL}, spans AS (SELECT file_path AS f, old_start AS a, old_start + old_count AS b, count(*) AS copies
      FROM hunks GROUP BY 1, 2, 3),
    hits AS (SELECT y.f, y.a, y.b, y.copies, max(x.b) FILTER (x.a < y.b AND y.a < x.b AND (x.a, x.b) < (y.a, y.b)) AS reached
      FROM spans y LEFT JOIN spans x ON x.f = y.f GROUP BY 1, 2, 3, 4)
    SELECT f AS file_path, a AS old_start, b - a AS old_count, copies,
    greatest(reached, CASE WHEN copies > 1 THEN b END) AS reached FROM hits
    WHERE reached IS NOT NULL OR (copies > 1 AND b > a)""",
)
def _overlaps(spark, sf_dir):
    hit = graph.hunk_overlaps(_hunks(spark, sf_dir))
    over = F.when(F.col("reached") > F.col("old_start"), F.col("reached"))
    return hit.withColumn("reached", over)


@query(
    "hunk_checks",
    f"""WITH {HUNKS_SQL},
    files AS (SELECT 'f' || (o_orderkey % 1000) AS file_path, CASE o_orderstatus WHEN 'F' THEN 'MODIFY' WHEN 'O' THEN 'ADD' ELSE 'COPY' END AS operation FROM orders),
    same AS (SELECT file_path, count(*) - 1 AS n FROM hunks GROUP BY file_path, old_start, old_count, new_start, new_count, lines HAVING count(*) > 1)
    SELECT file_path, 'duplicate hunk' AS problem, sum(n)::BIGINT AS n FROM same GROUP BY 1
    UNION ALL SELECT file_path, 'invalid range', count(*) FROM hunks WHERE new_start < 0 GROUP BY 1
    UNION ALL SELECT file_path, 'invalid operation', count(*) FROM files WHERE operation = 'COPY' GROUP BY 1
    UNION ALL SELECT file_path, 'duplicate path', count(*) - 1 FROM files GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT file_path, 'empty patch', 1 FROM files WHERE file_path NOT IN (SELECT file_path FROM hunks)""",
)
def _hunk_checks(spark, sf_dir):
    status = F.col("o_orderstatus")
    files = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), (F.col("o_orderkey") % 1000).cast("string")).alias("file_path"),
        F.when(status == "F", "MODIFY").when(status == "O", "ADD").otherwise("COPY").alias("operation"),
    )
    return checks.hunk_checks(files, _hunks(spark, sf_dir))


@query(
    "patch_dedupe",
    """WITH h AS (SELECT l_orderkey AS patch_id, 'f' || (l_orderkey % 3) AS file_path,
      string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS sig, count(*) AS hunks FROM
      (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1)
    SELECT min(patch_id) AS patch_id, file_path, any_value(hunks) AS hunks FROM h GROUP BY file_path, sig""",
)
def _patch_dedupe(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    hunks = lines.select("l_orderkey", "l_linenumber", "l_returnflag").distinct().select(
        F.col("l_orderkey").alias("patch_id"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 3).cast("string")).alias("file_path"),
        F.col("l_linenumber").alias("position"),
        F.col("l_linenumber").alias("old_start"),
        F.lit(1).alias("old_count"),
        F.col("l_linenumber").alias("new_start"),
        F.lit(1).alias("new_count"),
        F.array("l_returnflag").alias("diff_lines"),
    )
    return checks.patch_dedupe(hunks)


@query(
    "patch_stats",
    f"""WITH {HUNKS_SQL} SELECT patch_set, count(DISTINCT file_path) AS files_changed, count(*) AS hunks, count(*) AS added_lines,
    count(*) FILTER (l_linestatus <> 'O') AS removed_lines, count(DISTINCT file_path) AS modified_files FROM hunks GROUP BY 1""",
)
def _patch_stats(spark, sf_dir):
    return checks.patch_stats(_hunks(spark, sf_dir))


@query(
    "changed_lines",
    f"""WITH {HUNKS_SQL} SELECT DISTINCT file_path, unnest(range(old_start, old_start + old_count)) AS line FROM hunks""",
)
def _changed_lines(spark, sf_dir):
    return checks.changed_lines(_hunks(spark, sf_dir))


# --- reports, requests, plans ------------------------------------------------------------------


@query(
    "report_checks",
    """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 400000.0 END AS score,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'PASSED' WHEN '2-HIGH' THEN 'FAILED' WHEN '5-LOW' THEN 'BROKEN' ELSE 'WARNING' END AS status,
      o_custkey % 9 AS executed, o_custkey % 4 AS passed, o_custkey % 9 - o_custkey % 4 - 1 AS failed FROM orders)
    SELECT id AS report_id, 'score missing' AS problem FROM r WHERE score IS NULL
    UNION ALL SELECT id, 'score out of range' FROM r WHERE score < 0 OR score > 1
    UNION ALL SELECT id, 'invalid status' FROM r WHERE status = 'BROKEN'
    UNION ALL SELECT id, 'failed negative' FROM r WHERE failed < 0
    UNION ALL SELECT id, 'counts do not add up' FROM r WHERE id % 5 = 0
    UNION ALL SELECT l_orderkey, 'duplicate finding ' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def _report_checks(spark, sf_dir):
    key, priority, cust = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey")
    status = (
        F.when(priority == "1-URGENT", "PASSED").when(priority == "2-HIGH", "FAILED")
        .when(priority == "5-LOW", "BROKEN").otherwise("WARNING")
    )
    reports = views.table(spark, sf_dir, "orders").select(
        key.alias("report_id"),
        F.when(key % 13 != 0, F.col("o_totalprice") / 400000).alias("score"),
        status.alias("status"),
        (cust % 9).alias("executed"),
        (cust % 4).alias("passed"),
        (cust % 9 - cust % 4 - 1).alias("failed"),
        F.when(key % 5 == 0, 0).otherwise(1).alias("warnings"),
        F.lit(5).alias("duration_ms"),
    )
    findings = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").cast("string").alias("finding_id")
    )
    return checks.report_checks(reports, findings)


OPERATIONS = ("EXPLAIN", "DEBUG", "REFACTOR", "IMPLEMENT")


@query(
    "request_checks",
    """WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 70) WHEN 2 THEN 'a b' ELSE 'id-' || doc_id || '.é' END AS rid,
      CASE doc_id % 5 WHEN 0 THEN 'EXPLAIN' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'DANCE' ELSE 'IMPLEMENT' END AS op,
      CASE WHEN doc_id % 8 = 0 THEN '  ' ELSE text END AS d,
      CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'a?b' ELSE 'src/x' END AS path FROM documents)
    SELECT rid AS request_id, concat_ws('|',
      CASE WHEN rid = '' THEN 'request_id empty' END, CASE WHEN length(rid) > 64 THEN 'request_id too long' END,
      CASE WHEN contains(rid, ' ') THEN 'request_id characters' END, CASE WHEN op = 'DANCE' THEN 'unknown operation' END,
      CASE WHEN trim(d) = '' THEN 'description empty' WHEN length(d) > 10000 THEN 'description too long' END,
      CASE WHEN op <> 'EXPLAIN' THEN CASE WHEN path IS NULL THEN 'workspace_path required' WHEN path = ' ' THEN 'workspace_path blank'
        WHEN contains(path, '?') THEN 'workspace_path characters' END END,
      CASE WHEN doc_id % 10 = 9 THEN 'too many context keys' END) AS errors FROM r""",
)
def _request_checks(spark, sf_dir):
    key = F.col("doc_id")
    rid = (
        F.when(key % 6 == 0, "").when(key % 6 == 1, "x" * 70).when(key % 6 == 2, "a b")
        .otherwise(F.concat(F.lit("id-"), key.cast("string"), F.lit(".é")))
    )
    operation = F.when(key % 5 == 0, "EXPLAIN").when(key % 5 == 1, "DEBUG").when(key % 5 == 2, "DANCE").otherwise("IMPLEMENT")
    path = F.when(key % 7 == 0, None).when(key % 7 == 1, " ").when(key % 7 == 2, "a?b").otherwise("src/x")
    keys = F.transform(F.sequence(F.lit(1), F.when(key % 10 == 9, 101).otherwise(3)), lambda i: i.cast("string"))
    requests = views.table(spark, sf_dir, "documents").select(
        rid.alias("request_id"),
        operation.alias("operation"),
        F.when(key % 8 == 0, "  ").otherwise(F.col("text")).alias("description"),
        path.alias("workspace_path"),
        F.map_from_arrays(keys, keys).alias("context"),
        F.create_map(F.lit("a"), F.lit("b")).alias("metadata"),
    )
    checked = checks.request_checks(requests, OPERATIONS)
    return checked.select("request_id", F.array_join("errors", "|").alias("errors"))


@query(
    "step_order_checks",
    """WITH s AS (SELECT l_orderkey AS plan_id, l_linenumber - 2 AS o FROM lineitem),
    t AS (SELECT plan_id, count(*) AS steps, count(*) - count(DISTINCT o) AS repeated, count(*) FILTER (o < 0) AS negative,
      count(DISTINCT o) FILTER (o >= 0 AND o < n) AS present FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n FROM s) GROUP BY 1)
    SELECT plan_id, steps, repeated, negative, steps - present AS missing FROM t
    WHERE repeated > 0 OR negative > 0 OR steps > present""",
)
def _step_orders(spark, sf_dir):
    steps = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") - 2).alias("step_order")
    )
    return checks.step_order_checks(steps)
