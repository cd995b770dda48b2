"""Ordered keyword rules: request intent and retrieval profile.

The rule tables are fixed values; new rules are new rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents in priority order, each with its keywords in order.
INTENT_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("EXPLAIN", ("explain", "how does", "how do", "what is", "what does", "describe",
                 "understand", "architecture", "overview")),
    ("REFACTOR", ("refactor", "restructure", "reorganize", "rename", "cleanup", "clean up",
                  "simplify", "redesign", "improve")),
    ("DEBUG", ("debug", "fix", "bug", "error", "crash", "fail", "failing", "broken", "issue",
               "problem", "traceback", "exception", "throw", "fault", "diagnose")),
    ("TEST", ("test", "unit test", "integration test", "e2e", "coverage", "assert", "verify",
              "spec", "specification", "suite", "mock", "stub", "fixture")),
    ("SEARCH", ("find", "search", "locate", "where is", "where are", "investigate", "inspect",
                "check", "look into", "list", "show me", "search for")),
    ("IMPLEMENT", ("implement", "add", "create", "build", "write", "develop", "feature",
                   "functionality", "new")),
)
INTENTS = ("EXPLAIN", "IMPLEMENT", "REFACTOR", "DEBUG", "TEST", "SEARCH", "DEFAULT")

# Patterns that decide before any keyword.
NEGATED_COMMAND = r"(?U)\b(?:do\s+not|don't|dont|never)\s+\w+\b"
EXPLICIT_REFACTOR = r"(?U)\brefactor(?:ing)?\s+(?:investigation|plan|recommendation|analysis)\b"
EXPLICIT_IMPLEMENT = r"(?U)\bimplementation\s+task\b|\bmodify\s+files\b"

# Retrieval profiles as (priority, profile, patterns), first hit wins; equal
# priorities keep this order.
PROFILE_RULES: tuple[tuple[int, str, tuple[str, ...]], ...] = (
    (4, "IMPLEMENTATION", ("implement", "add", "create", "build", "write", "develop",
                           "implementation", "locate")),
    (5, "INTERFACE", ("interface", "abstract", "protocol", "base class", "abstract class")),
    (5, "REGISTRY", ("register", "registry", "registration", "registry of", "registered")),
    (5, "ENTRY_POINT", ("entry point", "entrypoint", "startup", "bootstrap",
                        "application starts")),
    (5, "SERIALIZER", ("serializer", "serialize", "deserialize", "serialization", "encoder",
                       "decoder")),
    (5, "WORKFLOW", ("workflow", "pipeline", "orchestration")),
    (5, "TASK", ("background task", "scheduled task")),
    (5, "CAPABILITY", ("capability", "capabilities", "feature", "features")),
    (5, "PROVIDER", ("provider", "provider hierarchy", "provider registration", "providers")),
    (5, "FACTORY", ("factory", "factory pattern", "builder")),
    (5, "EXTENSION", ("extension", "extension point", "plugin", "plugins", "hook", "hooks")),
    (10, "EXECUTION_FLOW", ("execution flow", "call flow", "call chain", "how does", "how do",
                            "flow of", "flow through")),
    (10, "CONFIGURATION", ("config", "configuration", "settings", "configure", "setup")),
    (10, "TEST", ("test", "tests", "unit test", "integration test", "e2e", "spec")),
    (10, "DEPENDENCY_INJECTION", ("dependency injection", "di container", "wire", "wiring",
                                  "inject", "container")),
    (10, "API_BOUNDARY", ("endpoint", "route", "handler", "controller", "view", "router")),
    (10, "VALIDATION", ("validation", "validate", "validator", "verify")),
    (15, "ARCHITECTURE", ("architecture", "overview", "design", "why", "reason", "purpose",
                          "describe")),
    (20, "IMPLEMENTATION", ("fix", "debug", "error", "bug", "diagnose", "broken", "crash", "fail",
                            "failing", "traceback", "exception", "throw", "fault", "resolve")),
    (20, "IMPLEMENTATION", ("refactor", "restructure", "reorganize", "rename", "cleanup",
                            "simplify", "redesign")),
    (25, "SIMILAR", ("similar", "like", "example", "implement like", "same as")),
)

# Fixed values: (intent, expansion, depth, callers, callees, modules, diagnostics, complexity,
# profile) per plan.
PLAN_RULES = (
    ("EXPLAIN", True, 1, True, True, True, False, "MODERATE", "ARCHITECTURE"),
    ("IMPLEMENT", True, 1, False, True, True, False, "MODERATE", "IMPLEMENTATION"),
    ("REFACTOR", True, 1, True, True, True, False, "COMPLEX", "IMPLEMENTATION"),
    ("DEBUG", True, 2, True, True, True, True, "COMPLEX", "IMPLEMENTATION"),
    ("TEST", True, 1, True, False, True, True, "MODERATE", "TEST"),
    ("SEARCH", False, 0, False, False, False, False, "SIMPLE", "DEFAULT"),
    ("DEFAULT", False, 0, False, False, True, False, "SIMPLE", "DEFAULT"),
)
PLAN_COLUMNS = (
    "intent", "relationship_expansion", "maximum_depth", "include_callers", "include_callees",
    "include_modules", "include_diagnostics", "estimated_complexity", "retrieval_profile",
)

# What each named capability takes from a repository.
CAPABILITY_COLUMNS = (
    "capability", "include_callers", "include_callees", "include_dependencies", "include_dependents",
    "include_tests", "include_dead_code", "include_diagnostics", "relationship_depth", "max_context_tokens",
)
CAPABILITY_PROFILES = (
    ("explain", False, False, False, False, False, False, False, 1, 4096),
    ("debug", True, True, True, False, True, False, True, 2, 4096),
    ("refactor", True, True, True, True, True, True, True, 3, 4096),
    ("architecture-review", True, True, True, True, True, True, True, 3, 8192),
)

KEYWORD_ORDER = tuple((intent, word) for intent, words in INTENT_KEYWORDS for word in words)


def cleaned_request(text: Column) -> Column:
    """Lowercase text without its negated commands."""
    return F.regexp_replace(F.lower(text), NEGATED_COMMAND, " ")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def _custom_list(custom: Mapping[str, Sequence[str]] | None) -> list[tuple[str, str]]:
    listed = []
    for intent, patterns in (custom or {}).items():
        name = intent.strip().upper()
        if name in INTENTS:
            listed += [(name, p.strip().lower()) for p in patterns if p.strip()]
    return listed


def longest_phrase(custom: Mapping[str, Sequence[str]] | None = None) -> int:
    """Most words that one rule spans; the explicit patterns span two."""
    phrases = [keyword for _, keyword in KEYWORD_ORDER] + [pattern for _, pattern in _custom_list(custom)]
    return max(2, *(len(phrase.split()) for phrase in phrases))


def intent_rank(
    text: Column, custom: Mapping[str, Sequence[str]] | None = None, phrases_only: bool = False
) -> Column:
    """Rank of the best rule a cleaned text meets, lower is better, null for none.

    Custom rules rank first, then the explicit patterns (0), then keywords (1..n). With
    `phrases_only`, just the rules of more than one word.
    """
    words = words_of(text)
    custom_rules = _custom_list(custom)
    hits = []
    for i, (_, pattern) in enumerate(custom_rules):
        rank = F.lit(i - len(custom_rules) - 1)
        if " " in pattern:
            hits.append(F.when(text.contains(pattern), rank))
        elif not phrases_only:
            hits.append(F.when(F.array_contains(words, pattern), rank))
    hits.append(F.when(text.rlike(EXPLICIT_REFACTOR), F.lit(-1)))
    hits.append(F.when(text.rlike(EXPLICIT_IMPLEMENT), F.lit(0)))
    for i, (_, keyword) in enumerate(KEYWORD_ORDER):
        if " " in keyword:
            hits.append(F.when(text.contains(keyword), F.lit(i + 1)))
    if not phrases_only:
        keywords = F.array(*[F.lit(word) for _, word in KEYWORD_ORDER])
        found = F.array_intersect(words, keywords)
        ranks = F.transform(found, lambda word: F.array_position(keywords, word).cast("int"))
        hits.append(F.array_min(ranks))
    return F.least(*hits)


def intent_of_rank(
    rank: Column, custom: Mapping[str, Sequence[str]] | None = None
) -> tuple[Column, Column]:
    """(intent, matched keyword) of a rank from `intent_rank`."""
    custom_rules = _custom_list(custom)
    names = [intent for intent, _ in custom_rules] + ["REFACTOR", "IMPLEMENT"]
    names += [intent for intent, _ in KEYWORD_ORDER]
    words = [f"custom:{pattern}" for _, pattern in custom_rules] + ["refactor", "implement"]
    words += [word for _, word in KEYWORD_ORDER]
    at = (rank + F.lit(len(custom_rules) + 1)).cast("int")
    pick = lambda items: F.get(F.array(*[F.lit(item) for item in items]), at)
    return F.coalesce(pick(names), F.lit("DEFAULT")), F.coalesce(pick(words), F.lit(""))


def retrieval_profile(text: Column) -> Column:
    """Profile of the first rule with a pattern inside the text, else DEFAULT."""
    lowered = F.lower(text)
    chosen = F.lit("DEFAULT")
    for _, profile, patterns in reversed(PROFILE_RULES):
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | lowered.contains(pattern)
        chosen = F.when(hit, profile).otherwise(chosen)
    return chosen
