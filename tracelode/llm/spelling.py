"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form each variant stands for.

1. Words. Runs of letters of whole texts, A-Z lower-cased; one of `thin` (by crc32 of document and run) loses a
   code point. Words of `min_chars` code points that occur `min_count` times are kept.
2. Chunks. Of two words one edit apart, the shorter (of equal length: the smaller) gives two disjoint chunks, its
   halves; the other gives positional grams. One edit leaves one chunk whole, at its own place or one place on,
   so the grams that can meet a chunk are those of a half's length within shift one: for either length of the
   shorter word, the one that starts the word and the one that ends it. (An edit before both chunks leaves the
   second one too, so the first is not looked for at a shift.)
3. Hot chunks. A chunk whose words would meet more than `_HOT_PAIRS` times is cut further by the same argument:
   the half with the edit is cut in pieces of two code points at most, all of which but one stay whole. Its words
   meet by chunk and all pieces but one, so a group shares all but two code points however common the chunk is.
4. Check. Pairs that meet are kept if their edit distance is one; of the pieces that an edit may be read in,
   the last counts, so a pair is found once.
5. Forms. A word's form is its near word of the highest count (ties: the smallest), if that is `ratio` times the
   word's or more. Counts grow by `ratio` from form to form, so a few rounds of pointer doubling give the roots.

Everything is Spark SQL. Words are counted before the shuffle, so frequent words are one row a task; no group is
gathered. Code points, not bytes, are counted, and ties are in code-point order.

Null text: no words. Null doc_id: an empty text in the crc. Repeated rows count each. Other columns are ignored.
Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.session import cut_lineage

#: Letters of a run: A-Z, a-z and the characters U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOT_PAIRS = 4096


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, thin: int = 199) -> DataFrame:
    """word and n of all words with `min_chars` code points or more that occur `min_count` times or more."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    # A run under min_chars never gives a word; one that loses a code point needs one more.
    runs = runs.filter(F.char_length("run") >= min_chars).select("key", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % thin == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _part(start: Column, end: Column | None = None) -> Column:
    """Code points of `word` from `start` (from 0) up to `end`."""
    return F.substr("word", start + 1) if end is None else F.substr("word", start + 1, end - start)


def _halves(words: DataFrame, shifts: tuple[int, ...]) -> DataFrame:
    """Rows of a word for each half of a word `shift` code points shorter that it may hold.

    size: of the shorter word; half: which one the chunk is; from, room: where the rest starts and how long it is
    in the shorter word; key: code of the chunk with its place.
    """
    size = F.char_length("word") - F.col("shift")
    cut = F.floor(F.col("size") / 2).cast("int")
    rows = words.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("size", size)
    rows = rows.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.col("half") == 0
    chunk = F.when(first, _part(F.lit(0), cut)).otherwise(_part(cut + F.col("shift")))
    return rows.select(
        "word", "n", "shift", "size",
        F.when(first, cut).otherwise(F.lit(0)).alias("from"),
        F.when(first, F.col("size") - cut).otherwise(cut).alias("room"),
        F.xxhash64("size", "half", chunk).alias("key"),
    )


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows by what has to be equal: the chunk, and on hot chunks all pieces of the rest but one.

    code: of all that; end: where the piece that may differ ends in the shorter word.
    """
    levels = F.ceil(F.log2(F.greatest(F.col("room") / 2, F.lit(1.0))))
    pieces = F.when(F.col("hot"), F.pow(F.lit(2.0), levels).cast("int")).otherwise(F.lit(1))
    rows = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low = F.col("from") + F.floor(F.col("piece") * F.col("room") / F.col("pieces")).cast("int")
    high = F.col("from") + F.floor((F.col("piece") + 1) * F.col("room") / F.col("pieces")).cast("int")
    rows = rows.withColumn("low", low).withColumn("end", high)
    before = _part(F.col("from"), F.col("low"))
    after = _part(F.col("end") + F.col("shift"), F.col("from") + F.col("room") + F.col("shift"))
    # Where the chunk is not cut further, nothing of the rest is kept: both parts are empty.
    return rows.select("word", "n", "shift", "size", "end", F.xxhash64("key", "piece", before, after).alias("code"))


def near_pairs(words: DataFrame, hot_pairs: int = _HOT_PAIRS) -> DataFrame:
    """short, n_short, long, n_long: all pairs of `words` (word, n; distinct) one edit apart, each once."""
    chunks = cut_lineage(_halves(words, (0,)))
    # A gram of a word's own length, or of one that is one code point shorter.
    grams = cut_lineage(_halves(words, (0, 1)).filter("size >= 1"))
    left = chunks.groupBy("key").agg(F.count("*").alias("n_left"))
    right = grams.groupBy("key").agg(F.count("*").alias("n_right"))
    hot = left.join(right, "key").filter(F.col("n_left") * F.col("n_right") > hot_pairs)
    hot = cut_lineage(hot.select("key", F.lit(True).alias("hot")))

    def marked(rows: DataFrame) -> DataFrame:
        return _pieces(rows.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))

    short = marked(chunks).select("code", F.col("word").alias("short"), F.col("n").alias("n_short"), "size", "end")
    long = marked(grams).select("code", F.col("word").alias("long"), F.col("n").alias("n_long"), "shift")
    met = short.join(long, "code").filter((F.col("shift") == 1) | (F.col("short") < F.col("long")))
    later = (F.col("end") < F.col("size")) & F.startswith("long", F.substr("short", F.lit(1), F.col("end")))
    return met.filter(~later & (F.levenshtein("short", "long", 1) == 1)).select("short", "n_short", "long", "n_long")


def _roots(forms: DataFrame, hops: int) -> DataFrame:
    """word and root from word and form, for chains of at most `hops` forms."""
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(hops, 1))))):
        roots = cut_lineage(roots)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return roots


def group_variants(words: DataFrame, ratio: int = 5, hot_pairs: int = _HOT_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n; distinct words)."""
    words = cut_lineage(words)
    pairs = cut_lineage(near_pairs(words, hot_pairs))
    sides = pairs.select(F.col("short").alias("word"), F.col("long").alias("other"), F.col("n_long").alias("m")).unionByName(
        pairs.select(F.col("long").alias("word"), F.col("short").alias("other"), F.col("n_short").alias("m"))
    )
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    stands = -F.col("best.m") >= ratio * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, F.col("best.other")).alias("form"), F.when(stands, -F.col("best.m")).alias("form_n"),
    )
    judged = cut_lineage(judged)
    least, most = judged.agg(F.min("n"), F.max("n")).first()
    hops = math.ceil(math.log((most or 1) / (least or 1)) / math.log(ratio)) + 1
    roots = _roots(judged.filter("form IS NOT NULL").select("word", "form"), hops)
    found = judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
