from __future__ import annotations

import hashlib
import html.parser
import math
import random
import sys
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import texts
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm import chat_format, decontaminate, exchange, html_extract, lm_score, mixing, quality_rules, token_counts
from tracelode.llm.oracle import QUALITY_RULES
from tracelode.llm.queries import END_OF_DOCUMENT, RANK_FILE
from tracelode.llm.recurrent import Layout, Model
from tracelode.llm.wordcodes import WordTable, window_codes

TURNS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))])


def test_word_tables():
    table = WordTable(["añb  c\t".encode(), b"", "\x0bx y ".encode()])
    assert [bytes(table.data[a:b]).decode() for a, b in zip(table.starts, table.ends)] == ["añb", "c", "x y"]
    assert table.first.tolist() == [0, 2, 2, 3] and table.text_of.tolist() == [0, 0, 2]
    long = ["w%d" % (i % 700) for i in range(900_000)]
    codes = WordTable([" ".join(long).encode()]).codes()
    assert len(np.unique(codes)) == 700 and (codes[:700] == codes[700:1400]).all()
    windows = window_codes(codes, 13)
    assert len(windows) == len(codes) - 12 and (windows[:100] == windows[700:800]).all() and windows[0] != windows[1]


def test_quality_rules_match_sql(spark):
    rows = texts.corpus(5) + [(900 + i, t) for i, t in enumerate((
        "Home | About | Contact\nReal text of a page, with enough words to be kept in the end.",
        "BUY NOW!! VERY CHEAP!! ONLY TODAY!! COME IN!! GO!! NOW!! YES!! YES!! OK!! DO!!",
        "All rights reserved.\nOne two three four five six seven eight nine ten eleven.",
        "a%%% b### c$$$ d&&& e*** f%%% g### h$$$ i&&& j*** k",
        "x y z\nx y z\nx y z\nnot a copy of the lines before it, but enough words for all.",
        "   ", "ä" * 5000, "w " * 30000, "\n" * 100,
    ))]
    docs = texts.frame(spark, rows)
    connection = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("int64")
    connection.register("documents", documents)
    want = connection.sql(QUALITY_RULES)
    got = quality_rules.verdict_digest(docs).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(int(v) if not isinstance(v, bool) else v for v in r) for r in want.fetchall())


def test_quality_keeps_columns(spark):
    text = "Home | About | Us\n" + "One sentence of ten words is what this line has, see."
    docs = spark.createDataFrame([(1, text, 99, "a"), (1, text, 99, "a"), (None, None, None, "b")], "doc_id long, text string, n_chars long, quality string")
    got = quality_rules.clean(docs)
    assert got.columns == docs.columns
    left = text.split("\n")[1]
    assert [tuple(r) for r in got.collect()] == [(1, left, len(left), "a")] * 2
    assert quality_rules.clean(docs.limit(0)).collect() == []


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn|>user\nhi", "<|next|>", "\\b\\l|", "<", "|x", "\\", "", None, "é\n\n", "<<||>>", "\\n"]
    rows = []
    for c in range(40):
        for k in range(c % 7 + 1):
            rows.append((c, k, ["user", "assistant", "sys<|end|>\n\\tem", None][(c * 7 + k * k) % 4], nasty[(c * 5 + k) % len(nasty)]))
    rows += [(77, None, "assistant", "first"), (77, 1, "assistant", "b"), (77, 1, "assistant", "b"), (77, 1, "assistant", "a"), (None, 0, "user", "no id")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("segments", F.lit(1)).repartition(3)
    want = {}
    for row in rows:
        want.setdefault(row[0], []).append((row[1] is not None, row[1], row[2] or "", row[3] or ""))
    got = {r.conv_id: r for r in chat_format.format_conversations(turns).select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("back")).collect()}
    digest = {r.conv_id: r for r in chat_format.format_digest(turns).collect()}
    assert set(got) == set(want)
    for key, listed in want.items():
        listed = [(r, t) for _, _, r, t in sorted(listed, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))]
        assert [tuple(t) for t in got[key].back] == listed
        assert digest[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in listed).encode()).hexdigest()
        said = "".join(t for r, t in listed if r == "assistant")
        assert (digest[key].loss_chars, digest[key].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert digest[key].formatted_chars == len(got[key].formatted)
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(listed, listed[1:]))
        assert got[key].formatted.count("<|turn|>") == blocks
    assert chat_format.format_digest(turns.limit(0)).collect() == []


@pytest.mark.parametrize("block_bytes", [1 << 23, 400])
def test_leaks_match_brute_force(spark, monkeypatch, block_bytes):
    rows = texts.corpus(5)
    items = {7: rows[0][1], 8: " ".join((rows[5][1] or "x").split()[:12]).upper(), 9: "ONE, two!", 10: None, 11: "...", 12: "same " * 25, 13: "zz yy"}
    items |= {20 + k: " ".join(texts.ALNUM.findall((rows[k][1] or "").lower())[3:30]) for k in range(6)}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    docs = texts.frame(spark, [*rows, (-3, None)]).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([*items.items(), (None, "one two three")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leak_digest(docs, bench).collect()}
    found = {r.doc_id: r.matches for r in decontaminate.find_matches(docs, bench).collect()}
    clean = []
    for k, text in [*rows, (-3, None)]:
        n, hit, ids = texts.leaks(text, items)
        listed = ",".join(sorted(map(str, ids)))
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].contaminated) == (n, hit, len(ids), hit > 0)
        assert got[k].items_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        own = texts.ALNUM.findall((text or "").translate(texts.LOWER))
        for m in found[k]:
            theirs = texts.ALNUM.findall((items[m.item_id] or "").translate(texts.LOWER))
            assert own[m.doc_start : m.doc_start + m.n_words] == theirs[m.item_start : m.item_start + m.n_words]
        if not hit:
            clean.append(k)
    left = decontaminate.clean_documents(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(clean)
    assert decontaminate.leak_digest(docs.limit(0), bench).collect() == []
    assert all(not r.contaminated for r in decontaminate.leak_digest(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("block_bytes", [1 << 23, 300, 40])
def test_leaks_are_judged_row_by_row(spark, monkeypatch, block_bytes):
    """Ids repeat and lack, texts differ: the blocks of the benchmark make no difference."""
    passage = " ".join(f"w{i}" for i in range(14))
    items = {1: passage, 2: "other words here " * 6, 3: passage + " and more " + passage, 4: "a b c"}
    rows = [(5, f"x {passage} y"), (5, "clean words"), (None, f"{passage} {passage}"), (None, "clean"), (None, None), (6, "a b c a b c"), (6, f"x {passage} y")]
    rows += [(6, "other words here " * 7 + passage)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    docs = texts.frame(spark, rows).withColumn("row", F.lit("r"))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = []
    for k, text in rows:
        n, hit, ids = texts.leaks(text, items)
        want.append((k, n, hit, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), hit > 0))
    got = [tuple(r) for r in decontaminate.leak_digest(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = decontaminate.clean_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted((r for r, w in zip(rows, want) if not w[-1]), key=repr)


def test_suffix_array_orders_suffixes():
    draw = np.random.default_rng(3)
    symbols = draw.integers(1, 4, 300).astype(np.uint64)
    order = decontaminate.suffix_array(symbols, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: symbols[i:].tolist())
    assert decontaminate.suffix_array(symbols[:0], 4).tolist() == []


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_tokens_counted_from_files(spark, monkeypatch, tmp_path, block_bytes):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(token_counts, "_GROUP", 3)
    rows = [*texts.corpus(5, 40), (None, "no id <|endoftext|>"), (3, "twice"), (3, "twice")]
    with open(RANK_FILE, "rb") as source:
        encoder = token_counts._encoder(source.read())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.document_tokens(texts.frame(spark, rows), RANK_FILE, END_OF_DOCUMENT).collect())
    assert got == sorted((k is None, k or 0, len(encoder.encode_ordinary(t or ""))) for k, t in rows)
    assert token_counts.document_tokens(texts.frame(spark, []), RANK_FILE, END_OF_DOCUMENT).collect() == []
    # Flat files: documents of 3, 0, 70 tokens, then 5 without a separator; and a file of separators alone.
    for name, ids in (("a.bin", [1, 2, 3, 9, 9, *[4] * 70, 9, *[5] * 5]), ("b.bin", [9] * 40), ("c.bin", [7] * 100)):
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u4").tobytes())
    counted = token_counts.count_tokens(token_counts.flat_file_blocks(spark, str(tmp_path)), 9, 4).collect()
    by_file: dict[str, list] = {}
    for r in sorted(counted, key=lambda r: r.ordinal):
        by_file.setdefault(r.file_id[-5:], []).append((r.ordinal, r.n_tokens))
    assert by_file == {"a.bin": [(0, 3), (1, 0), (2, 70), (3, 5)], "b.bin": [(k, 0) for k in range(40)], "c.bin": [(0, 100)]}


def test_pages(spark):
    article = "<article><h1>Head &amp; line</h1><p>First  paragraph,\n with <a href=x>a link</a>.<p>Second &lt;p&gt; one.<br>Next.<div class='ad'>Buy</div></article>"
    pages = [
        (1, "u", f"<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a>Home</a></nav>{article}<footer>(c)</footer></body></html>"),
        (2, None, None), (3, "u", ""), (4, "u", "just text"), (None, "u", "<p>x</p>" * 3),
        (5, "u", "<body><div id=top><a href=1>One</a> <a href=2>Two</a></div><div class=post><h2>Name</h2><p>Long text here, with commas, and more of it.</p>"
                 "<p>And a second part, which goes on.</p></div><div id='comments'><p>Nice, thanks, I like it very much indeed.</p></div></body>"),
        (6, "u", "<div" + " x" * 5000 + ">" + "<div>" * 3000 + "deep, deep." + "</div>" * 10),
        (7, "u", "<body class='has-sidebar'><main><p>Kept.</p><form>Name</form><section class='reader-comments'>no</section></main></body>"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(frame).collect()}
    assert got[1].text == "Head & line\n\nFirst paragraph, with a link.\n\nSecond <p> one. Next."
    assert (got[2].text, got[2].url, got[3].text, got[4].text, got[None].text) == ("", None, "", "just text", "x\n\nx\n\nx")
    assert got[5].text == "Name\n\nLong text here, with commas, and more of it.\n\nAnd a second part, which goes on."
    assert (got[6].text, got[7].text) == ("deep, deep.", "Kept.")
    assert html_extract.extract(frame.limit(0)).collect() == []


def test_inline_parts_put_aside_end_with_their_tag():
    read = html_extract.main_text
    assert read('<p>One <span class="notice">x</span> two.</p>') == "One two."
    assert read('<article><span class="ad">x</span><p>First.</p><p>Second.</p></article>') == "First.\n\nSecond."
    assert read('<p>One <label hidden>x <label>y</label> z</label> two.</p>') == "One two."
    assert read('<p>One <span class="ad">x <span>y</span> z</span> two <span>three</span>.</p>') == "One two three."
    # Without its own end tag it ends with its parent, and so does one inside of it.
    assert read('<article><p>One <span aria-hidden="true">x</p><p>Two</span>, three.</p></article>') == "One\n\nTwo, three."
    assert read('<article>One <span class="ad"><div><span>x</div> y</span> two.</article>') == "One two."
    assert read('<article>One <span style="display:none">x') == "One"
    assert read('<article><nav><span>x</nav>One</span> two.</article>') == "One two."
    linked = html_extract.read_blocks('<p><a href=u>one <span class="ad">x</span> two</a></p>')
    assert [(b.text, b.links) for b in linked] == [("one two", 6)]


def test_inline_parts_of_any_tag_are_put_aside():
    read = html_extract.main_text
    assert read("<article><p>One <em hidden>x</em> two.</p></article>") == "One two."
    assert read('<article><p>One <a class="share">Share</a> <a href=u>two</a>.</p></article>') == "One two."
    # A link ends with the next one, whatever became of it.
    assert read('<article><p>One <a class="share">Share <a href=u>two</a>, three.</p></article>') == "One two, three."
    assert read('<p>One <code class="lang-menu">x</code> two.</p>') == "One x two."
    assert read('<p>One <b class="ad">x <i>y</b> z</i> two.</p>') == "One z two."


class _SlowPaths(html.parser.HTMLParser):
    """Blocks of a well-formed page as (path, text, link characters)."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found, self.text, self.linked, self.link = [], [], "", 0, False
        self.feed(page)
        self.close()

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.found.append(("/".join(self.open), text, self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        else:
            self.cut()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.cut()
            self.open.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += len(data.strip()) if self.link else 0


def _slow_scores(page):
    """Blocks and the score of each path from the description, every path's figures counted anew for every block."""
    blocks = _SlowPaths(page).found

    def mean(path, of):
        values = [of(b) for b in blocks if b[0] == path]
        return sum(values) / len(values)

    def smoothed(k, of):
        near = [blocks[min(max(j, 0), len(blocks) - 1)][0] for j in (k - 1, k, k, k + 1)]
        return sum(mean(path, of) for path in near) / 4

    def marks(b):
        return sum(c in ".,;:!?\u2026\u3002\uff0c\u3001\uff01\uff1f" for c in b[1])

    def plain(path):
        return 1 - sum(b[2] for b in blocks if b[0] == path) / sum(len(b[1]) for b in blocks if b[0] == path)

    ratio = {}
    for path in {b[0] for b in blocks}:
        at = [k for k, b in enumerate(blocks) if b[0] == path]
        ratio[path] = plain(path) * sum(smoothed(k, lambda b: len(b[1])) * (1 + smoothed(k, marks)) for k in at) / len(at)
    best = max(ratio.values(), default=0)
    named = {path: bool({"article", "main"} & set(path.split("/"))) for path in ratio}
    score = {}
    for path in ratio:
        score[path] = ratio[path] / best if best else 1.0
        score[path] += 0.5 * plain(path) if named[path] else -0.85 if any(named.values()) else 0
    return blocks, score


def test_path_ratios_against_brute_force():
    draw = random.Random(4)
    dropped = 0
    for _ in range(150):
        def part(depth):
            if depth == 0 or draw.random() < 0.35:
                words = " ".join(draw.choice(["one", "two,", "three.", "four"]) for _ in range(draw.choice([1, 3, 9, 40])))
                words = f"<a href=u>{words}</a>" if draw.random() < 0.3 else words
                return f"<{(t := draw.choice(['p', 'h2', 'blockquote']))}>{words}</{t}>"
            tag = draw.choice(["div", "section", "article", "div"])
            return f"<{tag}>{''.join(part(depth - 1) for _ in range(draw.randint(1, 3)))}</{tag}>"

        page = "<body>" + "".join(part(3) for _ in range(4)) + "</body>"
        blocks, expected = _slow_scores(page)
        read = html_extract.read_blocks(page)
        assert [(b.text, b.links) for b in read] == [b[1:] for b in blocks]
        got = html_extract.path_scores(read)
        for block, (path, _, _) in zip(read, blocks):
            assert abs(got[block.element.path] - expected[path]) < 1e-9
        text = html_extract.main_text(page).split("\n\n")
        sure = [t for path, t, _ in blocks if expected[path] >= 0.15 + 1e-9]
        assert [t for path, t, _ in blocks if t in text] and all(t in text for t in sure)
        heads = [t for path, t, _ in blocks if expected[path] < 0.15 - 1e-9 and path.endswith("h2")]
        assert len(text) <= len(blocks) and len(sure) <= len(text) <= len(sure) + len(heads) + sum(abs(expected[p] - 0.15) < 1e-9 for p, _, _ in blocks)
        dropped += len(blocks) - len(text)
    assert dropped > 100


def test_ratios_decide_in_and_beside_an_article():
    long = "A long part of the text, with commas, of the page. " * 5
    links = "".join(f"<li><a href=/{k}>Place {k}</a></li>" for k in range(9))
    read = html_extract.main_text
    assert read(f"<article><h1><a href=x>Head</a></h1><p>{long}</p><ul>{links}</ul><p>End.</p></article>") == f"Head\n\n{long.strip()}\n\nEnd."
    assert read(f"<article><p>{long}</p><ul><li>One</li><li>Two</li></ul></article><div>Beside.</div>") == f"{long.strip()}\n\nOne\n\nTwo"
    # A short article beside the page's real text does not hide it.
    assert read(f"<article><p>Teaser</p></article><div><p>x</p><section>{long}</section><section>{long}</section></div>").count("A long part") == 10


def test_pages_take_linear_time():
    def seconds(page):
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    def shapes(n):
        yield "<div>" * n + "deep, deep." + "</div>" * n
        yield "<ul>" * n + "<p>x</p>" * n
        yield "<div>" * n + "<li>x" * n
        yield "<div>" * n + "<p>one, two</p>" * n + "</div>" * n
        yield "<div>" * n + "</b></x>" * n
        for bad in ("<a ", '<a "', '<a ">"', "<p>x</p><i '", "<!--", "<! ", "<span class=ad>", "<a class=ad>"):
            yield bad * (n + 1)

    # Four times the page in far less than sixteen times the time.
    for small, large in zip(shapes(5_000), shapes(20_000)):
        assert seconds(large) < 9 * seconds(small) + 0.3


def test_content_is_whole():
    read = html_extract.main_text
    first, second = ["A long first part, with commas, of the page."] * 4, ["Another part, shorter, but content as well."] * 2

    def paragraphs(listed: list[str]) -> str:
        return "".join(f"<p>{t}</p>" for t in listed)

    page = f"<body><div id=top><a href=1>One</a></div><section>{paragraphs(first)}</section><section>{paragraphs(second)}</section></body>"
    assert read(page) == "\n\n".join(first + second)
    page = f"<main><h1>Head</h1><article>{paragraphs(first)}</article><p>Between.</p><article><p>Short.</p></article><aside>no</aside></main><p>Outside.</p>"
    assert read(page) == "\n\n".join(["Head", *first, "Between.", "Short."])
    page = f"<article>{paragraphs(first)}</article><div>x</div><article class=related><p>No.</p></article><article><p>Two.</p></article>"
    assert read(page) == "\n\n".join([*first, "Two."])


def test_language_model_scores(spark):
    draw = np.random.default_rng(1)
    names = [[f"{kind}{i}" for i in range(40)] for kind in "ab"]
    rows = [(k, " ".join(draw.choice(names[k % 2], 60))) for k in range(600)] + [(1000, None), (None, "a1 a2"), (1001, "new words only"), (5, "a1")]
    got = lm_score.score_documents(texts.frame(spark, rows), vocabulary=50, classes=6, hidden=8).collect()
    assert len(got) == len(rows)
    counts: Counter = Counter()
    ends = 0
    for k, text in rows:
        if not lm_score.held_out(k):
            counts.update(texts.words(text))
            ends += 1
    total, size = sum(counts.values()) + ends, len(counts) + 1
    base = {}
    for k, text in rows:
        found = [counts[w] for w in texts.words(text)] + [ends]
        base.setdefault(k, []).append((len(found), sum(c > 0 for c in found), sum(math.log10((c + 0.1) / (total + 0.1 * (size + 1))) for c in found)))
    for r in got:
        assert r.train_tokens == total and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert any(r.n_tokens == n and r.n_known == known and abs(r.base_score - b) < 1e-9 * max(1, -b) for n, known, b in base[r.doc_id])
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    # The state tells which half of the words a text uses: 0.3 in log10 for each word at best.
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.1
    assert lm_score.score_documents(texts.frame(spark, [])).collect() == []


def test_vocabulary_grows_and_rare_words_have_context(spark, monkeypatch):
    draw = np.random.default_rng(4)
    names = [[f"{kind}{i}" for i in range(60)] for kind in "ab"]
    rows = [(k, " ".join(draw.choice(names[k % 2], 60))) for k in range(600)] + [(700, "once more")]
    trained: Counter = Counter()
    for k, text in rows:
        if not lm_score.held_out(k):
            trained.update(texts.words(text))
    seen: dict = {}

    class Kept(lm_score._Vocabulary):
        def __init__(self, *given):
            super().__init__(*given)
            seen["words"] = self

    monkeypatch.setattr(lm_score, "_Vocabulary", Kept)
    docs = texts.frame(spark, rows)
    lm_score.score_documents(docs, vocabulary=5, classes=6, hidden=8, rounds=0).count()
    found = seen["words"]
    assert len(found.codes) == int(4 * len(trained) ** 0.5)
    assert found.masses.sum() == found.rest == sum(trained.values()) - sum(sorted(trained.values())[-len(found.codes) :])
    # Each known word has a token of its own or a share of a group's; the shares of a group add up to one.
    names_of = sorted(trained)
    table = WordTable([" ".join(names_of).encode()], lower=True)
    token, share = found.encode(table.codes(), np.array([trained[w] for w in names_of]))
    token = found.scored(token)
    assert token.max() < found.size and len(np.unique(token)) == found.size - 1
    assert np.allclose(np.bincount(token, 10.0**share, found.size)[np.arange(found.size) != found.end], 1)
    monkeypatch.setattr(lm_score, "_GROWTH", 0)
    # All but five words are outside the vocabulary, and still tell which half of the words a text uses.
    got = lm_score.score_documents(docs, vocabulary=5, classes=6, hidden=8).filter("held_out").collect()
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.05


def test_only_frequent_words_become_rows(spark, monkeypatch):
    """Words by the hundred in each of 16 buckets, of which as good as only those of the vocabulary leave the notes."""
    draw = np.random.default_rng(6)
    held: list = []
    notes = []
    for _ in range(16):
        codes, counts = draw.integers(1, 2**62, 400).astype(np.uint64), draw.zipf(1.5, 400).clip(1, 5000).astype(np.uint64)
        held += zip(counts.tolist(), codes.tolist())
        notes.append((lm_score._note(50, 64, 16)([lm_score.to_planes(codes)], [lm_score.to_planes(counts)]),))
    replies = spark.createDataFrame([*notes, (None,)], "note binary").repartition(3)
    rows: list = []
    limit = type(replies).limit
    monkeypatch.setattr(type(replies), "limit", lambda frame, n: rows.append(frame.count()) or limit(frame, n))
    top, distinct, tokens, masses = lm_score._frequent(replies, 50, 64)
    assert (distinct, tokens, masses.sum()) == (len(held), sum(n for n, _ in held), tokens)
    wanted = sorted(held, key=lambda x: (-x[0], x[1]))[: int(4 * distinct**0.5)]
    assert top == [(code, n) for n, code in wanted]
    assert rows[0] < len(wanted) * 4 < len(held)


def test_model_is_a_distribution_and_keeps_state():
    counts = np.array([50, 30, 10, 5, 1], dtype=float)
    model = Model(Layout(counts, 3), 4, counts, (7.0, 2.0))
    memory: dict = {}
    for _ in range(5):
        model.train([np.array([0, 1, 2, 3, 4, 5, 6] * 30)], 0, 0.05, memory)
    start = [3, 1, 5]
    whole = model.score([np.array([*start, t]) for t in range(7)], 0) - model.score([np.array(start)], 0)
    assert abs(np.exp(whole).sum() - 1) < 1e-5
    long = np.arange(500) % 7
    alone, together = model.score([long], 0), model.score([long[:3], long, long[:100], np.zeros(0, dtype=int)], 0)
    assert abs(alone[0] - together[1]) < 1e-3 and together[3] == 0


@pytest.mark.parametrize("length", [1, 2, 31, 767, 768, 3001, 5000])
def test_training_learns_every_token(length):
    counts = np.ones(6000)
    model = Model(Layout(counts, 3), 2, counts, (0.0, 2.0))
    learned: list = []

    def learn(grid, fresh, state, rate, memory):
        inside = ~fresh[1:]
        learned.extend(zip(grid[:-1][inside].tolist(), grid[1:][inside].tolist()))
        return state

    model._learn = learn
    cut = length // 3
    parts = [p for p in (np.arange(1, cut + 1), np.arange(cut + 1, length + 1)) if len(p)]
    model.train(parts, 0, 0.0, {})
    assert sorted(learned) == sorted((int(a), int(b)) for p in parts for a, b in zip([0, *p[:-1]], p))


def test_gradient_of_the_model():
    """The step's direction agrees with finite differences."""
    counts = np.array([9, 5, 4, 2], dtype=float)
    model = Model(Layout(counts, 2), 3, counts, (3.0, 2.0))
    text = np.array([1, 0, 3, 2, 5, 4, 1, 1])
    grid = np.concatenate([[0], text])[:, None]
    fresh = np.zeros_like(grid, dtype=bool)
    fresh[0] = True
    seen: dict = {}
    model._step = lambda grad, rate, memory: seen.setdefault("grad", grad.copy())
    model._learn(grid, fresh, np.zeros((1, 3), dtype=np.float32), 0.0, {})
    flat = model.flat.copy()
    draw = np.random.default_rng(0)
    for i in draw.choice(len(flat), 25, replace=False):
        values = []
        for step in (1e-2, -1e-2):
            model.flat[...] = flat
            model.flat[i] += step
            values.append(model.score([text], 0)[0] / len(text))
        assert abs((values[0] - values[1]) / 2e-2 - seen["grad"][i]) < 2e-3


def test_mixing_reaches_targets(spark):
    draw = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(900):
        kind = "xyz"[k % 3]
        rows.append((k, " ".join(f"{kind if draw.random() < 0.8 else 'c'}{draw.integers(30)}" for _ in range(int(draw.integers(5, 60))))))
        if k % 2:
            labels.append((k, kind))
    rows += [(2000, None), (2001, ""), (None, "x1 x2 x3"), (7, "x1 x1"), (7, "x1 x1")]
    docs = texts.frame(spark, rows).withColumn("rate", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (5000, "x"), (3, None)], "doc_id long, domain string")
    targets = {"x": 0.6, "y": 0.3, "z": 0.1}
    got = mixing.mix(docs, marks, targets).collect()
    assert sum(r.n_rows for r in got) == len(rows)
    total = sum(r.n_rows * r.n_tokens for r in got)
    for k, share in targets.items():
        assert abs(sum(r.rate * r.n_rows * r.n_tokens * r[f"p_{k}"] for r in got) / total - share) < 1e-4
    assert all(r.rate >= 0 and abs(r.p_x + r.p_y + r.p_z - 1) < 1e-9 for r in got)
    right = sum(max("xyz", key=lambda k: r[f"p_{k}"]) == "xyz"[r.doc_id % 3] for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2 == 0)
    assert right > 0.95 * 450
    twice = [r for r in got if r.doc_id == 7 and r.n_tokens == 2]
    assert len(twice) == 1 and twice[0].n_rows == 2
    assert all(r.converged and r.max_gap <= 1e-6 for r in got)
    # Without labels, or with labels of unknown documents only, the targets are all that is known.
    for none in (marks.limit(0), marks.filter("doc_id = 5000")):
        plain = mixing.mix(docs, none, targets).collect()
        assert sum(r.n_rows for r in plain) == len(rows)
        assert all((round(r.p_x, 9), round(r.p_y, 9), round(r.p_z, 9), r.rate, r.converged) == (0.6, 0.3, 0.1, 1.0, True) for r in plain)
    for known in (marks, marks.limit(0)):
        assert mixing.mix(docs.limit(0), known, targets).collect() == []


def test_mixing_against_brute_force(spark):
    draw = np.random.default_rng(6)
    rows, marks, bits = [], [], 9
    for k in range(240):
        kind = "xyz"[k % 3]
        rows.append((k, " ".join(f"{kind if draw.random() < 0.7 else 'c'}{draw.integers(9)}" for _ in range(int(draw.integers(0, 40))))))
        if k % 2:
            marks.append((k, kind))
    rows += [(900, None), (901, "New words")]
    targets = {"x": 0.5, "y": 0.45, "z": 0.05}
    docs, labels = texts.frame(spark, rows), spark.createDataFrame(marks, "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(docs, labels, targets, feature_bits=bits, min_z=1.0).collect()}

    def features(text):
        found = []
        for word in texts.words(text):
            for kind, value in (("word", word.lower()), ("end", word[-2:])):
                code = xxhash.xxh64_intdigest(value.encode(), seed=42)
                found.append((kind, (code - (1 << 64) if code >> 63 else code) % (1 << bits)))
        return found

    known, counts, mass = dict(marks), Counter(), Counter()
    for k, text in rows:
        for feature in features(text):
            if k in known:
                counts[known[k], feature] += 1
                mass[known[k], feature[0]] += 1
    weights = {}
    for feature in {f for _, f in counts}:
        whole, both = sum(mass[d, feature[0]] for d in "xyz"), sum(counts[d, feature] for d in "xyz")
        expected = {d: both * mass[d, feature[0]] / whole for d in "xyz"}
        if any(abs(counts[d, feature] - expected[d]) >= math.sqrt(expected[d] + 1) for d in "xyz"):
            weights[feature] = {
                d: math.log((counts[d, feature] + 0.5 * mass[d, feature[0]] / whole) / (mass[d, feature[0]] + 0.5) / (both / whole)) for d in "xyz"
            }
    assert 0 < len(weights) < len({f for _, f in counts})
    posterior, size = [], []
    for _, text in rows:
        logit = [math.log(sum(v == d for v in known.values()) / len(known)) + sum(weights[f][d] for f in features(text) if f in weights) for d in "xyz"]
        power = [math.exp(v - max(logit)) for v in logit]
        posterior.append([v / sum(power) for v in power])
        size.append(len(texts.words(text)))
    posterior, size = np.array(posterior), np.array(size, float)
    for (k, text), p, n in zip(rows, posterior, size):
        assert np.abs(np.array([got[k].p_x, got[k].p_y, got[k].p_z]) - p).max() < 1e-9 and got[k].n_tokens == n
    # Least squares of rates that are not negative: no step down the gradient makes the sum of squares smaller.
    rate = np.array([got[k].rate for k, _ in rows])
    off = (size * rate) @ posterior / size.sum() - np.array([targets[d] for d in "xyz"])
    slope = posterior @ off
    assert (rate >= 0).all() and np.abs(np.where(rate > 0, slope, np.minimum(slope, 0))).max() < 1e-5
    assert got[0].converged and abs(got[0].max_gap - np.abs(off).max()) < 1e-9


def test_rates_say_whether_they_are_fitted(spark):
    members = spark.createDataFrame(
        [(k, k, 1, 10 + k, [k / 40, 1 - k / 40]) for k in range(41)], "doc_id long, text_code long, n_rows long, n_tokens long, posterior array<double>"
    )
    early = mixing.fit_rates(members, [0.9, 0.1], rounds=1).first()
    assert not early.converged and early.max_gap > 1e-6
    # A domain that no document has cannot be reached: the least squares are, and the gap is told.
    pure = members.withColumn("posterior", F.array(F.lit(1.0), F.lit(0.0)))
    missed = mixing.fit_rates(pure, [0.5, 0.5]).collect()
    assert all(r.converged and abs(r.max_gap - 0.5) < 1e-9 and abs(r.rate - 0.5) < 1e-6 for r in missed)


def test_rates_hit_the_bound_of_zero(spark):
    """A domain with a target of nothing: its pure documents get a rate of zero."""
    rows = [(1, 0, 1, 10, [1.0, 0.0]), (2, 0, 1, 10, [0.0, 1.0]), (3, 0, 1, 5, [0.9, 0.1])]
    members = spark.createDataFrame(rows, "doc_id long, text_code long, n_rows long, n_tokens long, posterior array<double>")
    got = {r.doc_id: r.rate for r in mixing.fit_rates(members, [1.0, 0.0]).collect()}
    assert got[2] < 1e-4 and got[3] >= 0 and got[1] > 1


def test_a_scoring_window_stays_small_however_many_texts_run_together(monkeypatch):
    sizes, run = [], Model._run

    def kept(self, entry, tokens, state):
        sizes.append(tokens.size)
        return run(self, entry, tokens, state)

    monkeypatch.setattr(Model, "_run", kept)
    counts = np.arange(40, 0, -1).astype(float)
    model = Model(Layout(counts, 4), 5, counts, (0.0, 1.0))
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 40, n) for n in [*draw.integers(0, 90, 700), 3000]]
    together = model.score(texts, 3)
    assert max(sizes) <= 1 << 12
    some = range(0, 701, 50)
    assert np.allclose(together[some], [model.score([texts[i]], 3)[0] for i in some], rtol=1e-5)


def test_scoring_takes_no_call_for_each_text_and_window():
    counts = np.arange(40, 0, -1).astype(float)
    model = Model(Layout(counts, 4), 5, counts, (0.0, 1.0))
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 40, n) for n in draw.integers(90, 110, 2000)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        model.score(texts, 3)
    finally:
        sys.setprofile(None)
    # A token took half a call while each text's part of a window was laid in by itself.
    assert calls < sum(map(len, texts)) / 8


def test_a_training_step_works_in_the_room_of_the_one_before():
    counts = np.arange(900, 0, -1).astype(float)
    model = Model(Layout(counts, 30), 16, counts, (0.0, 1.0))
    grid = np.random.default_rng(9).integers(0, 900, (33, 512))
    state, memory = np.zeros((512, 16), dtype=np.float32), {}
    model._learn(grid, np.zeros(grid.shape, dtype=bool), state, 0.01, memory)
    tracemalloc.start()
    try:
        model._learn(grid, np.zeros(grid.shape, dtype=bool), state, 0.01, memory)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # What the gates of all tokens bring and give, forth and back, is four times this much.
    assert most < 2 * grid.size * 48 * 4


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """Chunks are written as words: no later step has the texts to read them again."""
    tables, make = [], exchange.chunk_table
    monkeypatch.setattr(exchange, "chunk_table", lambda *given, **named: tables.append(make(*given, **named)) or tables[-1])
    rows = [(k, f"One two\tw{k} TWO") for k in range(40)] + [(50, None), (None, " "), (51, "one")]
    assert lm_score.score_documents(texts.frame(spark, rows), vocabulary=20, classes=6, hidden=4, rounds=0).count() == len(rows)
    assert "data" not in tables[0].columns
    found = []
    for row in tables[0].collect():
        chunk = exchange.Chunk(row.asDict())
        distinct = lm_score._Distinct(chunk)
        assert (np.diff(distinct.codes.astype(object)) > 0).all() and len(distinct.text_of) == len(distinct.place)
        codes = distinct.codes[distinct.place].tolist()
        found += [(i, codes[a:b]) for i, a, b in zip(chunk.ids, distinct.first, distinct.first[1:])]
    wanted = [(k, WordTable([(t or "").encode()], lower=True).codes().tolist()) for k, t in rows]
    assert sorted(found, key=str) == sorted(wanted, key=str)
