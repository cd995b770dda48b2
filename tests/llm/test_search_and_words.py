"""Language id, spelling variants and ranked search against plain Python versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from texts import LOWER, corpus, frame

from tracelode.llm import language_id, lexical_search, spelling

ODD = [(None, "alpha beta"), (7, None), (7, ""), (8, "..., !"), (9, "Alpha ALPHA alphaé"), (9, "Alpha ALPHA alphaé"), (None, None)]


def _terms(text: str | None) -> list[str]:
    out, run = [], ""
    for ch in (text or "").translate(LOWER) + " ":
        if ord(ch) > 127 or ch.isdigit() or "a" <= ch <= "z":
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out


def _ranked(docs, items, k):
    """Rows of the search, by scoring every document for every item."""
    counted = [(i, Counter(_terms(text))) for i, text in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    found = Counter(t for _, c, _ in counted for t in c)
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    rows = []
    for item, text in items:
        scored = []
        for doc_id, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            score = 0
            for term in set(_terms(text)):
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found[term] + 1)))
                    score += weight * ((10**9 * c[term]) // (1000 * c[term] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, no_id, doc_id) in enumerate(sorted(scored)[:k], 1):
            rows.append((item, rank, None if no_id else doc_id, -score))
    return sorted(rows, key=repr)


def _search(spark, docs, items, k, **bounds):
    index = lexical_search.build_index(frame(spark, docs).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1)), **bounds)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    return sorted((tuple(r) for r in lexical_search.search(index, asked, k).collect()), key=repr)


@pytest.mark.parametrize("shard_bytes", [1 << 24, 2000])
def test_search_matches_scoring_every_document(spark, monkeypatch, shard_bytes):
    docs = corpus(seed=3, size=150) + ODD
    draw = random.Random(1)
    texts = [t for _, t in docs if (t or "").split()]
    items = [(n, " ".join(draw.sample(draw.choice(texts).split(), 1) + draw.choice(texts).split()[:30])) for n in range(20)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "alpha"), (23, "ALPHA"), (23, "beta"), (23, "beta")]
    monkeypatch.setattr(lexical_search, "_ITEM_BYTES", 400 if shard_bytes == 2000 else 1 << 23)
    assert _search(spark, docs, items, 7, shard_bytes=shard_bytes) == _ranked(docs, items, 7)


def test_search_of_nothing(spark):
    assert _search(spark, [(1, None)], [(1, "alpha")], 5) == []
    assert _search(spark, [(1, "alpha")], [(1, None)], 5) == []


def test_ties_go_to_the_smallest_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(50 + i, "other") for i in range(60)]
    rows = _search(spark, docs, [(1, "words")], 5, shard_bytes=64)
    assert [r[2] for r in sorted(rows, key=lambda r: r[1])] == [1, 2, 3, 4, 5]


def _built(texts):
    builder = lexical_search._ShardBuilder()
    for i, text in enumerate(texts):
        builder.add(i, text.encode())
    tokens = sum(len(_terms(t)) for t in texts)
    return lexical_search._Shard(builder.row(len(texts), tokens).to_pylist()[0])


def test_blocks_are_rejected_before_they_are_decompressed():
    draw = random.Random(4)
    texts = [" ".join(["the"] * draw.randint(1, 4) + [draw.choice("abcdefgh") * 3 for _ in range(20)]) for _ in range(4000)]
    texts[1234] += " needle needle"
    shard = _built(texts)
    codes = lexical_search.WordTable([b"the needle"], lexical_search.ALNUM).codes()
    places = shard.places(codes)
    weights = np.array([1, 8000])
    tops = weights * shard.tops(places)
    docs, scores = shard.candidates(weights, places, tops, 1, int(tops[0]) + 1)
    assert docs.tolist() == [1234] and shard.decoded == 2 and shard.block[-1] > 60
    shard.decoded = 0
    docs, _ = shard.candidates(weights, places, tops, 1, int(tops.sum()) + 1)
    assert not len(docs) and shard.decoded == 0


def test_numbers_and_pieces_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40], dtype=np.int64)
    data, at = lexical_search.encode_numbers(values)
    assert lexical_search.decode_numbers(data).tolist() == values.tolist() and at[-1] == len(data)
    text = ("wörd " * 50 + "x" * 100).encode()
    pieces = list(lexical_search.text_pieces(text, 16))
    assert b"".join(pieces) == text and len(pieces) > 10
    whole, cut = (lexical_search.WordTable(t, lexical_search.ALNUM).codes().tolist() for t in ([text], pieces))
    assert whole == cut


def test_a_long_text_is_counted_over_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "_PIECE_BYTES", 32)
    texts = ["alpha beta " * 40 + "alpha", "beta"]
    shard = _built(texts)
    docs, _ = shard.list_of(int(shard.places(lexical_search.WordTable([b"alpha"], lexical_search.ALNUM).codes())[0]))
    assert docs.tolist() == [0]
    tokens = 82
    assert shard.norms.tolist() == [50 + 50 * 81 * 2 // tokens, 50 + 50 * 1 * 2 // tokens]


def _runs(text):
    out, run = [], ""
    for ch in (text or "") + " ":
        if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
            run += ch
        elif run:
            out.append(run.translate(LOWER))
            run = ""
    return out


def _word_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in _runs(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(counts, ratio=5):
    near = {w: [v for v in counts if v != w and _one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=repr)


def _words(seed, size=260):
    """Words with many neighbours: edits of a few stems, doubled letters, one-letter words, characters beyond ASCII."""
    draw = random.Random(seed)
    letters = "abéÿÀz"
    words = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "éééééé", "ééééééé"}
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 12))) for _ in range(12)]
    while len(words) < size:
        word = draw.choice([*stems, *words])
        at = draw.randrange(len(word) + 1)
        word = draw.choice([word[:at] + draw.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at + 1 :]])
        if 1 <= len(word) <= 14:
            words.add(word)
    return {w: draw.choice([5, 6, 25, 30, 130, 900, 5000]) for w in words}


@pytest.mark.parametrize("hot_pairs", [4096, 3, 0])
def test_variants_match_all_pairs(spark, hot_pairs):
    counts = _words(seed=hot_pairs)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    pairs = [(r["short"], r["long"]) for r in spelling.near_pairs(words, hot_pairs).collect()]
    assert len(pairs) == len(set(pairs))
    wanted = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in counts for b in counts if a < b and _one_edit(a, b)}
    assert set(pairs) == wanted
    found = sorted((tuple(r) for r in spelling.group_variants(words, 5, hot_pairs).collect()), key=repr)
    assert found == _variants(counts)


def test_words_are_counted_over_whole_texts(spark):
    draw = random.Random(8)
    vocabulary = [w + w for w in ("Abcdé", "abcdé", "ABCDÉ", "abcdef", "abcxef", "×÷ab", "ñandú", "straße")] + ["short", "a"]
    rows = [(draw.choice([None, 1, 2, 5, n]), "1".join(draw.choice(vocabulary) for _ in range(400))) for n in range(30)]
    rows += [(3, None), (4, ""), (5, "..."), (6, "x" * 200_000), *rows[:4]]
    docs = frame(spark, rows).withColumn("run", F.lit("x")).withColumn("key", F.lit(1)).withColumn("word", F.lit("w")).withColumn("n", F.lit(0))
    counts = _word_counts(rows)
    assert any(len(w) % 2 for w in counts)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == counts
    found = sorted((tuple(r) for r in spelling.group_variants(spelling.word_counts(docs)).collect()), key=repr)
    assert found == _variants(counts)


def test_no_words(spark):
    assert spelling.group_variants(spelling.word_counts(frame(spark, [(1, None)]))).collect() == []


LANG_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
ALPHABETS = {"aa": "abcde ", "bb": "cdefgé ", "cc": "αβγδε "}


def _labelled(seed=2, size=200):
    draw = random.Random(seed)
    syllables = {lang: ["".join(draw.choice(a) for _ in range(3)) for _ in range(12)] for lang, a in ALPHABETS.items()}
    rows = []
    for n in range(size):
        lang = draw.choice(list(ALPHABETS))
        rows.append((n, "".join(draw.choice(syllables[lang]) for _ in range(draw.randint(3, 400))).capitalize() + "x", lang))
    return rows


def _phrases(text: str, sample: bytes) -> int:
    """Longest matches from left to right, by looking substrings up."""
    data, count = text.encode(), 0
    for low in range(0, len(data), language_id.STRETCH):
        part = data[low : low + language_id.STRETCH]
        at = 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in sample and part[at : at + 1] in sample:
                size += 1
            at, count = at + size, count + 1
    return count


def test_phrases_are_the_longest_matches():
    draw = random.Random(6)
    sample = b"\0".join("".join(draw.choice("abé ") for _ in range(60)).encode() for _ in range(5))
    keys, ends = language_id.suffix_automaton(sample)
    texts = ["".join(draw.choice("abéz ") for _ in range(draw.randint(0, 1500))) for _ in range(60)] + ["", "zzzz", "a"]
    bits = language_id.text_bits([t.encode() for t in texts], [("x", len(sample), keys.tobytes(), ends.tobytes())])
    wanted = [_phrases(t, sample) * math.log2(len(sample) + 1) for t in texts]
    assert bits[:, 0].tolist() == wanted


def test_sample_is_training_text_only(spark):
    rows = [*_labelled(), (1000, "unlabelled words", None), (None, "of no id", "aa")]
    docs = spark.createDataFrame(rows, LANG_SCHEMA).repartition(4)
    got = language_id.sample_passages(docs, rows=5, passages=3, total=4096).collect()
    allowed = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            allowed.setdefault(lang, []).append(" ".join(text.lower().split()))
    assert {r["lang"] for r in got} == set(ALPHABETS)
    for r in got:
        assert any(r["passage"] in t for t in allowed[r["lang"]])
    assert max(Counter(r["lang"] for r in got).values()) <= 3
    assert Counter(r["lang"] for r in language_id.sample_passages(docs, 5, 3, 6).collect()) == dict.fromkeys(ALPHABETS, 2)


def test_held_out_languages_are_found(spark):
    rows = _labelled(size=300)
    odd = [(5000, None, "aa"), (5001, "", "aa"), (5002, "12 ²½ !?", "aa"), (None, "αβγ δεα", None), (5003, "αβγ" * 200_000, None), (5000, None, "aa")]
    docs = spark.createDataFrame(rows + odd, LANG_SCHEMA).repartition(4).withColumn("letters", F.lit(1)).withColumn("score", F.lit("s"))
    got = [tuple(r) for r in language_id.predict(docs).collect()]
    assert len(got) == len(rows) + len(odd)
    by_id = {r[0]: r for r in got}
    for doc_id, _, lang in rows:
        assert by_id[doc_id][1] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
    held = [(by_id[i][2], lang) for i, _, lang in rows if by_id[i][1]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(by_id[i][2:] == ("und", 0.0) for i in (5000, 5001, 5002))
    assert by_id[None][1:3] == (True, "cc") and by_id[5003][2] == "cc"
    assert all(0 <= r[3] <= 1 for r in got)


def test_driver_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98 * n


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None)], LANG_SCHEMA)
    assert [tuple(r)[2:] for r in language_id.predict(docs).collect()] == [("und", 0.0)]
    assert language_id.predict(docs.filter("false")).collect() == []
