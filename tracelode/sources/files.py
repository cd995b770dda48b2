"""File inventory of source trees: listing, ignoring, languages and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language by extension, and directories never scanned.
LANGUAGES = {
    "Python": (".py", ".pyi"),
    "Java": (".java",),
    "Scala": (".scala",),
    "Kotlin": (".kt", ".kts"),
    "C#": (".cs", ".csx"),
    "C++": (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".h"),
    "Rust": (".rs",),
    "Go": (".go",),
    "JavaScript": (".js", ".jsx", ".mjs", ".cjs"),
    "TypeScript": (".ts", ".tsx", ".mts", ".cts"),
    "YAML": (".yaml", ".yml"),
    "JSON": (".json",),
    "TOML": (".toml",),
    "Markdown": (".md", ".markdown", ".mdx"),
    "SQL": (".sql",),
    "Shell": (".sh", ".bash", ".zsh", ".fish", ".bashrc", ".bash_profile", ".zshrc"),
    "Dockerfile": ("dockerfile", ".dockerfile", ".Dockerfile", ".docker"),
}
IGNORED_DIRS = (
    ".git", ".venv", "venv", "node_modules", "dist", "build", "target", "coverage",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pycache__",
)


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files under a folder as (path, relative_path, content, size_bytes, modified_time).

    The content column is only read where a query uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/") + "/"
    at = F.instr("path", base)
    relative = F.when(at > 0, F.expr(f"substring(path, instr(path, '{base}') + {len(base)})"))
    return reader.load(root).select(
        "path",
        F.coalesce(relative, "path").alias("relative_path"),
        F.col("content").cast("string").alias("content"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_time"),
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Suffix of the file name with its dot; none for names like `.bashrc` or `Makefile`."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def detect_language(ext: Column) -> Column:
    """Language of an extension: exact first, else its lowercase form without dots."""
    bare = F.regexp_replace(F.lower(ext), r"^\.+", "")
    found = None
    for language, extensions in LANGUAGES.items():
        dotless = [e for e in extensions if not e.startswith(".")]
        test = ext.isin(*extensions)
        if dotless:
            test = test | bare.isin(*dotless)
        found = F.when(test, language) if found is None else found.when(test, language)
    return found.otherwise("Unknown")


def file_inventory(files: DataFrame) -> DataFrame:
    """(path, name, extension, language, directory, size_bytes) of each file."""
    parent = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    return files.select(
        F.col("relative_path").alias("path"),
        file_name(F.col("relative_path")).alias("name"),
        extension(F.col("relative_path")).alias("extension"),
        detect_language(extension(F.col("relative_path"))).alias("language"),
        F.when(parent == "", ".").otherwise(parent).alias("directory"),
        "size_bytes",
    )


def _glob(pattern: str, across: bool = False) -> str:
    """Regular expression of a glob; `across` lets `*` and `?` run over slashes."""
    any_char = "." if across else "[^/]"
    out, in_set = [], False
    for i, ch in enumerate(pattern):
        if in_set:
            out.append("^" if ch == "!" and pattern[i - 1] == "[" else ch)
            in_set = ch != "]"
        elif ch == "[" and "]" in pattern[i + 1 :]:
            out.append(ch)
            in_set = True
        elif ch in "*?":
            out.append(any_char + ("*" if ch == "*" else ""))
        else:
            out.append(re.escape(ch))
    return "".join(out)


def ignore_rule(pattern: str) -> str:
    """One ignore pattern as a regular expression on a relative file path.

    An ignored folder takes everything below it along. `dir/` names a folder at any depth, `a/b/` a
    folder from the top; `/x` a folder at the top or a file tail; `**/x` and bare names match at any
    depth; other patterns match the tail of a path or, with `*` over slashes, all of it.
    """
    if pattern.endswith("/"):
        name = pattern.rstrip("/")
        return ("^" if "/" in name else "(^|/)") + re.escape(name) + "/"
    if pattern.startswith("/"):
        name = pattern.lstrip("/")
        return f"^{re.escape(name)}/|(^|/){_glob(name)}$"
    if pattern.startswith("**/"):
        name = pattern.lstrip("*").lstrip("/")
        exact, glob = re.escape(name), _glob(name)
        return f"(^|/){exact}/|(^|/){glob}/[^/]+/|^{exact}$|[^/]/{glob}$"
    if "/" not in pattern:
        return f"(^|/){re.escape(pattern)}/|[^/]/{_glob(pattern)}/|(^|/){_glob(pattern)}$"
    return f"(^|/){_glob(pattern)}(/|$)|^{_glob(pattern, across=True)}(/|$)"


def ignore_filter(files: DataFrame, patterns: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Files outside the ignored folders that no pattern covers."""
    folders = "|".join(_glob(name) for name in IGNORED_DIRS)
    ignored = F.col(path).rlike(f"(^|/)({folders})/")
    for pattern in patterns:
        ignored = ignored | F.col(path).rlike(ignore_rule(pattern))
    return files.where(~ignored)


def gitignore_patterns(text: str) -> tuple[str, ...]:
    lines = (line.strip() for line in text.splitlines())
    return tuple(line for line in lines if line and not line.startswith("#"))


def module_filter(files: DataFrame, exclude_tests: bool = False, globs: tuple[str, ...] = ()) -> DataFrame:
    """Python modules with the reason each other file is left out (null for the kept)."""
    path, name = F.col("path"), file_name(F.col("path"))
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith("__") & p.endswith("__") | p.startswith("."))
    test = (name == "conftest.py") | name.rlike(r"^test_.*\.py$") | name.rlike(r"_test\.py$")
    excluded = F.lit(False)
    for pattern in globs:
        excluded = excluded | path.rlike(f"(?s)^{_glob(pattern, across=True)}$")
    reason = (
        F.when(~path.endswith(".py"), "not python")
        .when(hidden, "hidden")
        .when(F.lit(exclude_tests) & test, "test")
        .when(excluded, "excluded")
    )
    return files.withColumn("excluded_by", reason)


def module_filter_counts(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy(F.coalesce("excluded_by", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("files")
    )


def files_by_extension(inventory: DataFrame, ext: str) -> DataFrame:
    wanted = "." + ext.lower().lstrip(".")
    return inventory.where(F.lower("extension") == wanted)


def files_by_language(inventory: DataFrame, language: str) -> DataFrame:
    return inventory.where(F.col("language") == language)


def file_lookup(inventory: DataFrame, path: str) -> DataFrame:
    return inventory.where(F.col("path") == path)


def language_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("language").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size_bytes")
    )


def file_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.countDistinct("directory").alias("directories"),
    )


def largest_files(inventory: DataFrame, limit: int = 10) -> DataFrame:
    return inventory.orderBy(F.desc("size_bytes"), "path").limit(limit).select("path", "size_bytes")


def directory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("directory").agg(F.count(F.lit(1)).alias("file_count"))
