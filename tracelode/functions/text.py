"""Column functions on text. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4

# Starts of user messages that carry a tool's result.
TOOL_RESULT_PREFIXES = (
    "[read_file for ",
    "[search_files for ",
    "[list_files for ",
    "[execute_command for ",
    "[attempt_completion]",
    "[ERROR] You did not use a tool",
)

# Starts and parts of a message that leans on the one before.
FOLLOW_UP_PREFIXES = (
    "for that ",
    "given that ",
    "with that ",
    "using that ",
    "for the same ",
    "given the same ",
    "same ",
)
FOLLOW_UP_MARKERS = (
    " that split",
    " that capping logic",
    " the same ",
    " above ",
    " previous ",
)

# Fixed value: marker left where a tool result was cut.
TRUNCATION_MARKER = "\n\n[... truncated by gateway history cap ...]"

# Words that match too broadly in a query.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can",
    "do", "does", "doing", "done", "for", "from", "has", "have",
    "how", "i", "if", "in", "into", "is", "it", "its", "of", "on",
    "or", "that", "the", "then", "there", "these", "this", "to",
    "us", "was", "what", "when", "where", "which", "who", "why",
    "will", "with", "you", "your",
)
CODE_WORDS = (
    "code", "codebase", "file", "function", "method", "class",
    "module", "return", "returns", "store", "stores", "value",
    "object", "field", "fields", "run", "runs", "first", "thing",
    "stage",
)

# Answer-style rules.
REASONING_PREFIXES = (
    "i need to",
    "i will",
    "i'll",
    "let me",
    "i'm going to",
    "the user",
    "we need to",
    "first,",
)
CHATTER_MARKERS = (
    "<thinking>",
    "</thinking>",
    "<read_file>",
    "<search_files>",
    "<list_files>",
    "<execute_command>",
    "<attempt_completion>",
    "<tool_call>",
    "</tool_call>",
)


def strip(text: Column) -> Column:
    """Remove all surrounding whitespace, newlines included (`trim` keeps those)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(tests: list[Column]) -> Column:
    combined = F.lit(False)
    for test in tests:
        combined = combined | test
    return combined


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([text.startswith(prefix) for prefix in prefixes])


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([text.contains(part) for part in parts])


def content_text(content: Column, parts: Column) -> Column:
    """A message's text: the string itself, or its text parts joined by a space."""
    texts = F.filter(F.transform(parts, lambda part: part["text"]), lambda t: t.isNotNull())
    return F.coalesce(content, F.array_join(texts, " "), F.lit(""))


def tokens(text: Column) -> Column:
    """Estimated tokens: four characters each, rounded down; nothing for missing text."""
    return F.coalesce(F.floor(F.length(text) / CHARS_PER_TOKEN), F.lit(0)).cast("bigint")


def is_tool_result(text: Column) -> Column:
    return starts_with_any(F.regexp_replace(text, r"(?U)^\s+", ""), TOOL_RESULT_PREFIXES)


def is_follow_up(text: Column) -> Column:
    lowered = strip(F.lower(text))
    return starts_with_any(lowered, FOLLOW_UP_PREFIXES) | contains_any(lowered, FOLLOW_UP_MARKERS)


def truncate_text(text: Column, max_tokens: Column) -> Column:
    limit = max_tokens * CHARS_PER_TOKEN
    room = F.greatest(F.lit(0), limit - len(TRUNCATION_MARKER)).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), room), F.lit(TRUNCATION_MARKER))
    return F.when((max_tokens > 0) & (F.length(text) > limit), cut).otherwise(text)


def query_tokens(text: Column) -> Column:
    """Ordered distinct search forms of a query: whole words, underscore parts, camel-case parts.

    Stop words and single characters go; a query of nothing but stop words falls back to its plain
    lowercase words.
    """
    raw = F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9_]+"), F.lit(0))

    def forms(word: Column) -> Column:
        camel = F.regexp_extract_all(word, F.lit(r"[A-Z][a-z0-9]*|[A-Z]+|[a-z0-9]+"), F.lit(0))
        snake = F.filter(F.split(word, "_"), lambda part: part != "")
        return F.transform(F.concat(F.array(word), snake, camel), F.lower)

    every = F.flatten(F.transform(raw, forms))
    stop = F.array(*[F.lit(word) for word in (*STOP_WORDS, *CODE_WORDS)])
    useful = F.filter(F.array_except(F.array_distinct(every), stop), lambda t: F.length(t) > 1)
    plain = F.array_distinct(
        F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda word: word != "")
    )
    return F.when(F.size(useful) > 0, useful).when(F.size(raw) > 0, plain).otherwise(
        F.array().cast("array<string>")
    )


def normalise_query(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def clamp_limit(limit: Column) -> Column:
    return F.greatest(limit, F.lit(0))


def module_refs(text: Column) -> Column:
    """Paths of `*.py` files named in a text, without the suffix."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)[\w./\\-]+\.py"), F.lit(0))
    return F.transform(
        found, lambda path: F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("\\"), F.lit("/"))
    )


def import_refs(import_text: Column) -> Column:
    """Module paths named by one import statement."""
    source = F.regexp_extract(import_text, r"(?U)^\s*from\s+([\w.]+)\s+import\b", 1)
    listed = F.regexp_extract(import_text, r"(?sU)^\s*import\s+(.+)", 1)
    names = F.transform(F.split(listed, ","), lambda part: strip(F.split(strip(part), " as ")[0]))
    named = F.filter(names, lambda name: name != "")
    refs = F.when(source != "", F.array(source)).otherwise(named)
    return F.transform(refs, lambda name: F.replace(name, F.lit("."), F.lit("/")))


def normalise_answer(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("\\"), F.lit("/"))


def style_flags(answer: Column) -> Column:
    lowered = F.lower(strip(answer))
    return F.array_compact(
        F.array(
            F.when(starts_with_any(lowered, REASONING_PREFIXES), "reasoning_preamble"),
            F.when(contains_any(lowered, CHATTER_MARKERS), "tool_chatter"),
        )
    )


def truncation_flag(answer: Column, completion_tokens: Column, max_tokens: Column) -> Column:
    """The budget was used up and next to nothing is visible."""
    return (completion_tokens >= max_tokens - 1) & (F.length(strip(answer)) < 20)


def strip_empty_think(text: Column) -> Column:
    return F.regexp_replace(text, r"^<think>\s*</think>\s*", "")


def last_words(text: Column, count: int) -> Column:
    """The last `count` words with the white space between and after them, all of a shorter text."""
    pattern = r"(?U)^(\s*\S+(?:\s+\S+){0,%d})" % (count - 1)
    return F.reverse(F.regexp_extract(F.reverse(text), pattern, 1))
