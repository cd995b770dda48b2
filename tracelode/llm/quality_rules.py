"""Quality rules, line first: failing lines go, then documents that lost too much.

Spark SQL expressions only, one row in, one row out, no shuffle. Every step is linear in the text, so
very long texts only take longer; nothing is exploded.

Line rules (a line without a word is neither judged nor counted):

* punctuation: symbols `#*$%&|<>` at a rate of one per two words or more, shouting (at least three
  words, more than half of its letters upper case), or three or more words of which half end in `!`;
* navigation: two or more bars `|`, or at most three words and a menu phrase;
* boilerplate: a licence, rights or cookie phrase, or a copy of an earlier line of the same text.

A document is rejected if it fails the base rules, or if the lines that stay hold less than
`1 - max_loss` of its word characters. Null and empty texts have no words and fail the base rules.
Repeated rows are judged one by one and alike. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.columns import SPACE, fresh_name, has_word, let, text_lines, words

SYMBOLS = r"[^#*$%&|<>]+"
MENU = r"(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|share|next|previous|back to top|read more|skip to content|contact|about us|sitemap)\b"
BOILERPLATE = (
    r"(?i)(all rights reserved|^\W*licensed under|^\W*released under the|is licensed under the|terms of use|"
    r"terms of service|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|"
    r"subscribe to our newsletter|lorem ipsum|powered by wordpress|^\W*copyright|©)"
)

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines",
    "cleaned", "kept_word_chars", "base_failed", "kept",
)


def _length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails a rule by itself (copies are judged by the caller)."""
    count = F.size(words(line))
    symbols = _length_without(line, SYMBOLS)
    upper = _length_without(line, r"[^\p{Lu}]+")
    lower = _length_without(line, r"[^\p{Ll}]+")
    bars = _length_without(line, r"[^|]+")
    shouts = F.size(F.split(line, r"!+(?=[\x20\x09-\x0D]|$)")) - 1
    return (
        (2 * symbols >= count)
        | ((count >= 3) & (upper > lower))
        | ((count >= 3) & (2 * shouts >= count))
        | (bars >= 2)
        | ((count <= 3) & line.rlike(MENU))
        | line.rlike(BOILERPLATE)
    )


def repeated_words(tokens: Column, width: int = 5) -> Column:
    """Words covered by windows of `width` words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def from_sorted(ranked: Column) -> Column:
            last = F.size(ranked) - 1
            shared = F.filter(
                F.transform(
                    ranked,
                    lambda cell, i: F.when(
                        ((i > 0) & (F.get(ranked, i - 1)["h"] == cell["h"]))
                        | ((i < last) & (F.get(ranked, i + 1)["h"] == cell["h"])),
                        cell["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            empty = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
            return F.aggregate(
                F.sort_array(shared),
                empty,
                lambda seen, at: F.struct(
                    (at + width).alias("end"),
                    (seen["total"] + at + width - F.greatest(at, seen["end"])).cast("long").alias("total"),
                ),
                lambda seen: seen["total"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(pairs, from_sorted)
        )

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(codes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(width)]))

    hashed = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda codes: let(windows(codes), covered))
    return F.when(F.size(tokens) < width, F.lit(0).cast("long")).otherwise(hashed)


def judge(
    docs: DataFrame,
    text: str = "text",
    max_loss: float = 0.7,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    output: str = "quality",
) -> DataFrame:
    """`docs` with one struct column `output`.

    Its fields are FIELDS; `cleaned` is the text of the lines that stay, blank lines included.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    tokens, rows, first, flags = (
        fresh_name(docs.columns, n) for n in ("_tokens", "_rows", "_first", "_flags")
    )
    # Copies of earlier lines: sort (line hash, line number), mark all but the first of a hash, sort the marks back.
    marked = F.transform(F.col(rows), lambda line, i: F.struct(F.xxhash64(line).alias("h"), i.alias("i")))

    def repeats(ranked: Column) -> Column:
        copy = F.transform(
            ranked, lambda cell, k: F.struct(cell["i"].alias("i"), ((k > 0) & (F.get(ranked, k - 1)["h"] == cell["h"])).alias("copy"))
        )
        return F.transform(F.sort_array(copy), lambda cell: cell["copy"])

    copies = F.when(
        F.size(F.array_distinct(F.col(rows))) == F.size(F.col(rows)), F.transform(F.col(rows), lambda line: F.lit(False))
    ).otherwise(let(F.sort_array(marked), repeats))
    verdicts = F.zip_with(F.col(rows), copies, lambda line, copy: has_word(line) & (line_fails(line) | copy))
    prepared = (
        docs.withColumn(tokens, words(F.col(text)))
        .withColumn(rows, text_lines(F.col(text)))
        .withColumn(first, F.filter(F.col(rows), has_word))
        .withColumn(flags, verdicts)
    )
    # Both arrays are arguments, not captured by the lambda, where the planner may inline their making.
    kept_lines = F.zip_with(F.col(rows), F.col(flags), lambda line, bad: F.when(~bad, line))
    # Plain columns, not fields of a struct: the planner inlines structs and would work them out again.
    name = {n: fresh_name(docs.columns, f"_{n}") for n in FIELDS}
    figures = prepared.withColumns(
        {
            name["n_words"]: F.size(tokens).cast("long"),
            name["word_chars"]: F.char_length(F.array_join(tokens, "")).cast("long"),
            name["n_symbols"]: _length_without(source, SYMBOLS),
            name["n_dup_lines"]: (F.size(first) - F.size(F.array_distinct(first))).cast("long"),
            name["n_repeat_words"]: repeated_words(F.col(tokens)),
            name["n_lines"]: F.size(rows).cast("long"),
            name["n_removed_lines"]: F.size(F.filter(F.col(flags), lambda bad: bad)).cast("long"),
            name["cleaned"]: F.array_join(kept_lines, "\n"),
        }
    ).drop(tokens, rows, first, flags)
    value = {n: F.col(f"`{name[n]}`") for n in FIELDS}
    failed = (value["n_words"] < min_words) | (
        100 * value["n_repeat_words"] > max_repeat_percent * value["n_words"]
    )
    kept_chars = F.char_length(F.regexp_replace(value["cleaned"], SPACE, "")).cast("long")
    judged = figures.withColumns({name["kept_word_chars"]: kept_chars, name["base_failed"]: failed})
    enough = value["kept_word_chars"] >= (1 - max_loss) * value["word_chars"]
    judged = judged.withColumn(name["kept"], ~value["base_failed"] & enough)
    return judged.withColumn(output, F.struct(*[value[n].alias(n) for n in FIELDS])).drop(*name.values())


def clean(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that stay, their failing lines removed; same columns. `n_chars` follows if there."""
    column = fresh_name(docs.columns, "quality")
    judged = judge(docs, text, output=column, **options)
    cleaned = F.col(column)["cleaned"]
    new = {text: cleaned}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(cleaned).cast(docs.schema["n_chars"].dataType)
    row = F.struct(*[new.get(name, F.col(f"`{name}`")).alias(name) for name in docs.columns])
    # Not a filter: it would be pushed below the verdict and work it out once more.
    return judged.select(F.inline(F.when(F.col(column)["kept"], F.array(row))))


def verdict_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of the rules, a row for every row of `docs`."""
    q = F.col("quality")
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines n_removed_lines"
    return judge(docs.select("doc_id", "text")).select("doc_id", *[q[n].alias(n) for n in names.split()])
