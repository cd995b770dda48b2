"""Small corpora for the tests, and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def corpus(seed: int = 5, size: int = 120) -> list[tuple[int | None, str | None]]:
    """Random prose with exact and near copies, shared passages, repeated lines, and odd rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 6))) for _ in range(300)]

    def line(n: int) -> str:
        return " ".join(draw.choice(vocabulary) for _ in range(n)).capitalize() + "."

    def text() -> str:
        return "\n".join(line(draw.randint(1, 18)) for _ in range(draw.randint(1, 12)))

    rows: list[tuple[int | None, str | None]] = []
    passage = line(60)
    block = "\n".join(line(5) for _ in range(4))
    for k in range(size):
        kind = draw.random()
        if rows and kind < 0.2:
            rows.append((k, draw.choice(rows)[1]))
        elif rows and kind < 0.4:
            base = (draw.choice(rows)[1] or "x").split(" ")
            base[draw.randrange(len(base))] = "edited"
            rows.append((k, " ".join(base)))
        elif kind < 0.5:
            rows.append((k, text() + "\n" + passage + "\n" + text()))
        elif kind < 0.6:
            rows.append((k, text() + "\n" + block + "\n\n" + text()))
        else:
            rows.append((k, text()))
    rows += [(size, None), (size + 1, ""), (size + 2, " \t\n \r\n"), (size + 3, "one"), (size + 4, "one two three"), (size + 5, "ONE two THREE")]
    rows += [(size + 6, " ".join(vocabulary * 40)), (size + 7, " ".join(vocabulary * 40)), (size + 8, "same same same " * 30)]
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def components(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None, width: int) -> frozenset:
    found = words((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def near_components(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, int]:
    sets = {k: shingles(t, width) for k, t in rows}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return components(list(sets), links)


def repeats(rows: list[tuple[int, str | None]], width: int) -> dict[int, set[int]]:
    """Word places under windows that start in a document with a smaller id."""
    first: dict[tuple, int] = {}
    for k, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), k)
    out = {}
    for k, text in rows:
        w = words(text)
        late = [i for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < k]
        out[k] = {i + s for i in late for s in range(width)}
    return out


def repeated_lines(rows: list[tuple[int, str | None]], min_lines: int, min_words: int) -> dict[int, set[int]]:
    """Line numbers under runs of lines that occur earlier."""
    held = {k: [(n, line) for n, line in enumerate((t or "").split("\n")) if words(line)] for k, t in rows}
    first: dict[tuple, tuple] = {}
    for k in sorted(held):
        lines = [line for _, line in held[k]]
        for size in range(1, min_lines + 1):
            for i in range(len(lines) - size + 1):
                first.setdefault(tuple(lines[i : i + size]), (k, i))
    out = {}
    for k, numbered in held.items():
        lines, gone = [line for _, line in numbered], set()
        for size in range(1, min_lines + 1):
            for i in range(len(lines) - size + 1):
                run = tuple(lines[i : i + size])
                if first[run] < (k, i) and (size == min_lines or sum(len(words(x)) for x in run) >= min_words):
                    gone.update(numbered[i + s][0] for s in range(size))
        out[k] = gone
    return out


def leaks(text: str | None, items: dict[int, str | None], window: int = 10) -> tuple[int, int, set[int]]:
    """Words, words under a window, items found."""
    own = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items.items():
        theirs = ALNUM.findall((item_text or "").translate(LOWER))
        size = min(window, len(theirs))
        grams = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return len(own), len(hit), found
