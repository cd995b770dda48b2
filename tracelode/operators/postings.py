"""Inverted index of symbols, and postings: what one token adds to one symbol, worked out once.

The index lists symbol ids by character gram, without any text. A token looks up its first three characters, the
grams nobody asks for leave before the shuffle, and what is found is checked against the symbol's text in a
second join. A posting then holds in numbers all that a score needs, however many queries share its token, so
scoring a (query, symbol) pair is a sum over a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Score weights.
EXACT_NAME, EXACT_QUALIFIED, PARTIAL_NAME, MODULE_NAME = 100, 90, 50, 30
TOKEN_IN_NAME, TOKEN_IN_MODULE = 10, 10
TEST_CODE, TEST_WANTED, MAX_COMPOUND_PENALTY = -50, 75, 50

EXACT_PLACE = 1024  # above any points of an exact name; a token's position stands above it

GRAM_SIZE = 3
INDEX_BUCKETS = 64
ROWS_PER_TASK = 1 << 20  # rows of a query's token and a symbol that one task folds


def _place() -> Column:
    """All text of a symbol that a token is looked for in."""
    return F.concat_ws(" ", "lname", "lmodule", "phrases")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(INDEX_BUCKETS)).cast("int")


def gram_index(symbols: DataFrame) -> DataFrame:
    """bucket, gram, symbol_id: every gram of one to three characters of each symbol, once."""
    grams = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("place") - n + 1, F.lit(1))),
        lambda i: F.substring(F.col("place"), i, F.lit(n)),
    )
    every = F.array_distinct(F.concat(*(grams(n) for n in range(1, GRAM_SIZE + 1))))
    listed = symbols.select("symbol_id", _place().alias("place")).select("symbol_id", F.explode(every).alias("gram"))
    return listed.select(_bucket(F.col("gram")).alias("bucket"), "gram", "symbol_id")


def write_gram_index(symbols: DataFrame, path: str) -> None:
    """The index as a table that later runs read: a folder for each bucket of grams, sorted by gram in files."""
    rows = gram_index(symbols).repartition("bucket", F.pmod(F.xxhash64("symbol_id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def read_gram_index(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """The part of a written index that `tokens` (token) may look up; other buckets are not opened."""
    asked = tokens.select(_bucket(F.substring("token", 1, GRAM_SIZE)).alias("bucket")).distinct()
    buckets = [row["bucket"] for row in asked.collect()]  # INDEX_BUCKETS at most
    return spark.read.parquet(path).filter(F.col("bucket").isin(buckets))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """query_id, wants_tests, at, token: the tokens of prepared queries with their places."""
    return queries.select("query_id", "wants_tests", F.posexplode("tokens").alias("at", "token"))


def token_postings(tokens: DataFrame, symbols: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A row for each (token, symbol) where the token is inside the symbol's name or module.

    exact: points as the exact name of a segment, less what a longer segment around it takes, null if it is none;
    qualified, plain: whether it is the whole name, or a plain word inside it; in_name, in_module: whether it is
    inside these; base and is_test of the symbol; best, adds: the most points the token can decide, and what it
    adds whatever the others do.
    """
    wanted = tokens.select("token").distinct().withColumn("gram", F.substring("token", 1, GRAM_SIZE))
    index = gram_index(symbols) if index is None else index
    listed = index.select("gram", "symbol_id").join(wanted.select("gram").distinct(), "gram", "left_semi")
    met = listed.join(wanted, "gram").select("token", "symbol_id")
    text = symbols.select("symbol_id", "lname", "lmodule", "segments", "forms", "base", "is_test", _place().alias("place"))
    token = F.col("token")
    rows = met.join(text, "symbol_id").where(F.col("place").contains(token))
    rows = rows.withColumn("hit", F.get(F.filter("forms", lambda f: f["form"] == token), 0)["seg"])
    around = F.get(F.filter("segments", lambda other: F.position(F.col("hit"), other) > 1), 0)
    rows = rows.withColumn("around", F.when(F.col("hit").isNotNull(), around))
    penalty = F.floor(MAX_COMPOUND_PENALTY * (1.0 - F.length("hit") / F.length("around"))).cast("int")
    rows = rows.select(
        "token", "symbol_id", "base", "is_test",
        F.when(F.col("hit").isNotNull(), EXACT_NAME - F.coalesce(penalty, F.lit(0))).alias("exact"),
        (F.col("lname") == token).alias("qualified"),
        F.col("lname").contains(token).alias("in_name"),
        F.col("lmodule").contains(token).alias("in_module"),
    )
    rows = rows.withColumn("plain", F.col("in_name") & ~token.rlike("[^a-z0-9_]"))
    best = F.greatest(
        F.coalesce("exact", F.lit(0)),
        F.when(F.col("qualified"), EXACT_QUALIFIED).when(F.col("plain"), PARTIAL_NAME).when(F.col("in_module"), MODULE_NAME).otherwise(0),
    )
    adds = F.col("in_name").cast("int") * TOKEN_IN_NAME + F.col("in_module").cast("int") * TOKEN_IN_MODULE
    return rows.withColumn("best", best).withColumn("adds", adds)


def test_points(wants_tests: Column) -> Column:
    return F.when(F.col("is_test"), F.when(wants_tests, TEST_WANTED).otherwise(TEST_CODE)).otherwise(0)


def _folded(rows: DataFrame, *kept: str, along: tuple[str, ...] = ()) -> DataFrame:
    """query_id, symbol_id, points, matched reasons: postings beside their query's token, folded to pairs.

    `kept` and `along` are columns that are the same in all rows of a pair; `along` is grouped by, so rows that stand
    together by one of these columns are not shuffled.
    The first token of a query that names a segment decides; else the whole name, a part of it, the module.
    """
    count = lambda name: F.sum(F.col(name).cast("int"))
    pairs = rows.groupBy("query_id", "symbol_id", *along).agg(
        F.min(F.col("at").cast("bigint") * EXACT_PLACE + F.col("exact")).alias("exact"),
        F.max("qualified").alias("qualified"), F.max("plain").alias("plain"),
        count("in_name").alias("in_name"), count("in_module").alias("in_module"),
        *(F.max(name).alias(name) for name in kept),
    )
    pairs = pairs.withColumn("exact", (F.col("exact") % EXACT_PLACE).cast("int"))
    kinds = (
        (F.col("exact").isNotNull(), F.col("exact"), "EXACT_SYMBOL_NAME"),
        (F.col("qualified"), F.lit(EXACT_QUALIFIED), "EXACT_QUALIFIED_NAME"),
        (F.col("plain"), F.lit(PARTIAL_NAME), "PARTIAL_SYMBOL_NAME"),
        (F.col("in_module") > 0, F.lit(MODULE_NAME), "MODULE_MATCH"),
    )
    points, kind = F.lit(0), F.lit(None).cast("string")
    for test, value, name in reversed(kinds):
        points, kind = F.when(test, value).otherwise(points), F.when(test, name).otherwise(kind)
    in_name, in_module = F.col("in_name"), F.col("in_module")
    points = points + in_name * TOKEN_IN_NAME + F.when(in_module >= 2, in_module * TOKEN_IN_MODULE).otherwise(0)
    matched = F.array_compact(F.array(kind, F.when(in_name > 0, "TOKEN_MATCH"), F.when(in_module >= 2, "MODULE_TOKEN_MATCH")))
    return pairs.select("query_id", "symbol_id", points.alias("points"), matched.alias("matched"), *kept, *along)


def all_reasons(matched: Column, wants_tests: Column) -> Column:
    test = F.when(F.col("is_test"), F.when(wants_tests, "TEST_TARGET").otherwise("TEST_CODE"))
    return F.concat(matched, F.col("reasons_before"), F.array_compact(F.array(test)), F.col("reasons_after"))


def _scored(pairs: DataFrame, queries: DataFrame, symbols: DataFrame) -> DataFrame:
    known = symbols.select(
        "symbol_id", "qualified_name", "module", "symbol_type", "base", "is_test", "reasons_before", "reasons_after"
    )
    rows = pairs.join(known, "symbol_id").join(queries.select("query_id", "wants_tests"), "query_id")
    return rows.select(
        "query_id", "symbol_id", "qualified_name", "module", "symbol_type",
        (F.col("points") + F.col("base") + test_points(F.col("wants_tests"))).cast("bigint").alias("score"),
        all_reasons(F.col("matched"), F.col("wants_tests")).alias("reasons"),
    )


def score_symbols(queries: DataFrame, symbols: DataFrame, postings: DataFrame) -> DataFrame:
    """Score and reasons of every (query, symbol) pair that shares a token."""
    return _scored(_pairs_by_symbol(queries, postings), queries, symbols)


def _pairs_by_symbol(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Folded pairs of all postings. Postings are dealt by symbol before they meet the queries, so where
    the queries' tokens can be sent to them, a pair is made and folded in its symbol's task. The number of
    tasks follows the rows that meet."""
    asked = asked_tokens(queries)
    return _folded(postings.repartition(tasks_for(asked, postings), "symbol_id").join(asked, "token"))


def tasks_for(asked: DataFrame, postings: DataFrame) -> int:
    met = postings.groupBy("token").agg(F.count("*").alias("n")).join(asked, "token").agg(F.sum("n")).first()[0] or 0
    return max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), met // ROWS_PER_TASK + 1)


def scored_along(rows: DataFrame, along: tuple[str, ...], reasons: bool) -> DataFrame:
    """Scores of pairs from postings beside their symbol's columns and their query's token, folded where they stand."""
    fixed = ("wants_tests", "base", "is_test", *along, *(("reasons_before", "reasons_after") if reasons else ()))
    pairs = _folded(rows, along=fixed)
    score = (F.col("points") + F.col("base") + test_points(F.col("wants_tests"))).cast("bigint")
    texts = [all_reasons(F.col("matched"), F.col("wants_tests")).alias("reasons")] if reasons else []
    return pairs.select("query_id", "symbol_id", *along, score.alias("score"), *texts)


def score_modules(wanted: DataFrame, queries: DataFrame, symbols: DataFrame, postings: DataFrame) -> DataFrame:
    """Scores of the symbols of wanted (query_id, module) that can be a module's first: query_id, module, symbol_id,
    qualified_name, symbol_type, score.

    A token never takes points away, so a module's first symbol is one that a token of the query matches or the
    first by base score, which is the same for all queries that want tests and all others.
    """
    known = symbols.select("symbol_id", "qualified_name", "module", "symbol_type", "base", "is_test")
    asking = queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    flags = asking.select("wants_tests", "query_id")
    base = (F.col("base") + test_points(F.col("wants_tests"))).cast("bigint")
    plain = known.withColumn("wants_tests", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("score", base)
    first = plain.groupBy("module", "wants_tests").agg(
        F.min_by(F.struct("symbol_id", "qualified_name", "symbol_type", "score"), F.struct(-F.col("score"), "qualified_name")).alias("b")
    )
    listed = wanted.select("query_id", "module").distinct().join(flags, "query_id")
    columns = ["query_id", "module", "symbol_id", "qualified_name", "symbol_type", "score"]
    matched = _pairs_by_symbol(asking, postings).select("query_id", "symbol_id", "points").join(known, "symbol_id")
    matched = matched.join(listed, ["query_id", "module"]).withColumn("score", F.col("points") + base)
    unmatched = listed.join(first, ["module", "wants_tests"]).select("query_id", "module", "b.*")
    return matched.select(*columns).unionByName(unmatched.select(*columns))


def score_pairs(pairs: DataFrame, queries: DataFrame, symbols: DataFrame, postings: DataFrame) -> DataFrame:
    """The same for the pairs (query_id, symbol_id; distinct) alone; pairs that share no token give no row."""
    rows = pairs.join(asked_tokens(queries), "query_id").join(postings, ["token", "symbol_id"])
    return _scored(_folded(rows), queries, symbols)


def pair_scores(pairs: DataFrame, queries: DataFrame, symbols: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, qualified_name, score of the pairs (query_id, symbol_id; distinct), without reasons."""
    kept = postings.select("token", "symbol_id", "exact", "qualified", "plain", "in_name", "in_module", "base", "is_test")
    rows = pairs.join(asked_tokens(queries), "query_id").join(kept, ["token", "symbol_id"])
    folded = _folded(rows, "wants_tests", "base", "is_test")
    score = F.col("points") + F.col("base") + test_points(F.col("wants_tests"))
    return folded.select("query_id", "symbol_id", score.cast("bigint").alias("score")).join(
        symbols.select("symbol_id", "qualified_name"), "symbol_id"
    ).select("query_id", "qualified_name", "score")


def impact_postings(postings: DataFrame) -> DataFrame:
    """token, wants_tests, impact, symbol_id: the points of a pair whose best token this is, by that token alone."""
    both = postings.withColumn("wants_tests", F.explode(F.array(F.lit(False), F.lit(True))))
    impact = F.col("base") + test_points(F.col("wants_tests")) + F.col("best") + F.col("adds")
    return both.select("token", "wants_tests", impact.cast("int").alias("impact"), "symbol_id")


def impact_blocks(impacts: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """The blocks of equal impact that a query may open: query_id, token, wants_tests, impact, n, bound.

    n: postings in the block; bound: no pair whose best token is this one scores more from this block, since each
    other token of the query adds at most what it adds anywhere.
    """
    most = postings.groupBy("token").agg(F.max("adds").alias("most"))
    asked = asked_tokens(queries).select("query_id", "wants_tests", "token").join(most, "token")
    total = asked.groupBy("query_id").agg(F.sum("most").alias("total"))
    asked = asked.join(total, "query_id").select("query_id", "wants_tests", "token", (F.col("total") - F.col("most")).alias("rest"))
    blocks = impacts.groupBy("token", "wants_tests", "impact").agg(F.count("*").alias("n"))
    opened = asked.join(blocks, ["token", "wants_tests"])
    return opened.select("query_id", "token", "wants_tests", "impact", "n", (F.col("impact") + F.col("rest")).alias("bound"))


def pairs_of(blocks: DataFrame, impacts: DataFrame) -> DataFrame:
    """Distinct (query_id, symbol_id) in the given blocks."""
    keys = ["token", "wants_tests", "impact"]
    return blocks.select("query_id", *keys).join(impacts, keys).select("query_id", "symbol_id").distinct()
