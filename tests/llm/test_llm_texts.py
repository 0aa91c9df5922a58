import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.llm import markup, mixing, packing, page_wrapper, site_lines, tokens, truncation

MARKED = [
    "# Title", "a\n## Sub", "Title\n=====", "Title\n-----", "**bold** word", "an _emph_ word", "an *emph* word", "~~gone~~", "`code` here", "```\nx\n```", "- item", "* item", "+ item", "1. item", "> quote",
    "[a](b)", "![a](b.png)", "note[^1]", "| a | b |\n|---|---|\n| 1 | 2 |", "<p>x", "x<br/>y", "<!-- c -->", "a &amp; b", "&#8212;", "&#x2019;", "<https://a.example>", "'''bold'''", "''it''", "[[link]]",
    "[[a|b]]", "[https://a.example x]", "{{cite|x}}", "{|\n|-\n|}", "== Head ==", "x<ref name=\"a\" />", r"\section{A}", r"\emph{a}", "\\begin{itemize}\n\\item a\n\\end{itemize}", r"x~\cite{a}", "$x^2$", "$$\nx\n$$",
    r"\(a+b\)", r"\[ a \]", r"\alpha beyond",
]
PLAIN = [
    "He wrote 2 * 3 * 4 on the board", "Tickets cost $5 to $10 at the door.", "{calm, slow, late}", "b > a by a margin", "room #12 (or ~20 minutes)", "as found [sic] in", "Supply & demand", "in C# and left",
    "notes_final_v2 was lost", "4^2 percent", "We <3 long walks", "3 < 5 for most", "x=y; z=w", r"\harbor\notes holds", "Terms | Privacy | Notice", "AT&T; too", "a - b - c", "— Name", "2024", "snake_case_name and other_name",
    "don't 'quote' it", "cost: 5$", "", None, "3.5 apples", "it's 'fine' here", "a\n\nb",
]


@pytest.mark.parametrize("text", MARKED)
def test_constructs_are_found(text):
    assert markup.has_markup("Before it.\n\n" + text + "\n\nAfter it.")


@pytest.mark.parametrize("text", PLAIN)
def test_signs_of_prose_are_not(text):
    assert not markup.has_markup(text)
    assert markup.clean_text(text) == text


def test_conversion_keeps_structure():
    text = (
        "<h2 class=a>Head</h2>\n<p>A &lt; B<!-- no --> <b>bold</b></p><script>x</script>\n<ul><li>one</li><li>two</li></ul>\n== Wiki ==\n'''b''' [[a|c]]{{x}}\n* item\n\\section{Tex}\n\\begin{itemize}\n\\item first\n\\end{itemize}\n"
        "\\emph{so}~\\cite{k}\n\n$$\nx^2\n$$\n\nin $y_1$ line, `k` and\n```py\n# not a [head](x)\n```\n~~old~~ new[^1]\n| a | b |\n|---|---|\n| 1 | 2 |\n> said\n<pre><code>q &amp;&amp; r</code></pre>"
    )
    clean = markup.clean_text(text)
    for part in ("## Head", "A < B bold", "- one\n- two", "## Wiki", "b c", "- item", "## Tex", "- first", "so\n", "$$\nx^2\n$$", "in $y_1$ line, `k` and", "```\n# not a [head](x)\n```", "new\n", "a | b\n1 | 2", "> said", "```\nq && r\n```"):
        assert part in clean, part
    for part in ("<", "~~", "script", "[[", "\\section", "cite", "|---", "[^1]"):
        assert part not in clean.replace("A < B", ""), part


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from([*MARKED, *[p for p in PLAIN if p]]), max_size=8))
def test_any_mixture_converts(parts):
    clean = markup.clean_text("\n\n".join(parts))
    assert clean is not None and "\ue000" not in clean


def test_long_formulas():
    formula = "$" + " + ".join(f"x_{i} * y_{i}" for i in range(40)) + "$"
    assert len(formula) > 302 and markup.has_markup(f"so {formula} holds") and formula in markup.clean_text(f"so {formula} holds, *not* less")


def test_markup_records(spark):
    rows = spark.createDataFrame([("chunk", "1", "**a**", "x"), ("chunk", "2", None, "x"), ("issue", "1", "", "x"), ("issue", "2", "x" * 300_000, "x"), ("chunk", "1", "**a**", "x")], "record_kind string, record_id string, text string, found string")
    assert [(r.record_kind, r.record_id) for r in markup.records_with_markup(rows).collect()] == [("chunk", "1")] * 2
    assert markup.records_with_markup(rows.where("false")).count() == 0
    assert [r.c for r in rows.select(markup.cleaned(F.col("text")).alias("c")).collect()][:3] == ["a", None, ""]


# Lines of one site

SITE = "id string, url string, body string, host string, line_no long"


def _site(n=20):
    rows = [(f"d{i}", f"HTTP://u@A.example:80/p/{i}" if i % 2 else f"https://a.EXAMPLE/{i}", f"Unique text number {'abcdefghijklmnopqrstuvwxyz'[i]}\nShared  No {i} \n\n\tshared no 7", "h", 1) for i in range(n)]
    return [*rows, ("n", None, "shared no 1", "h", 1), ("e", "https://b.example/", None, "h", 1), ("f", "https://b.example/", "", "h", 1), ("long", "https://c.example", "x " * 100_000, "h", 1)]


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_recurring_lines(spark, hot_rows):
    rows = spark.createDataFrame(_site(), SITE)
    found = sorted((r.doc_id, r.line_no) for r in site_lines.recurring_lines(rows, "id", "url", "body", hot_rows=hot_rows).collect())
    assert found == sorted((f"d{i}", n) for i in range(20) for n in (2, 4))
    clean = {r.id: r.body for r in site_lines.without_recurring_lines(rows, "id", "url", "body").collect()}
    assert clean["d0"] == "Unique text number a\n" and clean["e"] is None and clean["n"] == "shared no 1" and len(clean) == 24
    assert site_lines.recurring_lines(rows.where("false"), "id", "url", "body").count() == 0


def test_limits_are_exact(spark):
    rows = [(f"d{i}", "https://a.example/", "often" if i < 5 else "rare" if i < 9 else f"{'xyz'[i % 3] * (i + 1)}", "", 1) for i in range(50)]
    frame = spark.createDataFrame(rows, SITE)
    assert {r.doc_id for r in site_lines.recurring_lines(frame, "id", "url", "body").collect()} == {f"d{i}" for i in range(5)}
    more = spark.createDataFrame([*rows, ("d50", "https://a.example/", "other", "", 1)], SITE)
    assert site_lines.recurring_lines(more, "id", "url", "body").count() == 0  # 5 of 51 are less than a tenth


def test_templates_merge():
    tree = site_lines.TemplateTree()
    for name in ("ann", "bob", "cid"):
        tokens_ = f"written by the editor {name}".split()
        assert tree.add("h", site_lines.leaf_of(tokens_), tokens_, 2, []) is None
    ((_, _, entry),) = tree.empty()
    assert entry[0] == ["written", "by", "the", "editor", site_lines.WILD] and entry[1] == 6
    full = site_lines.TemplateTree(open_templates=2)
    closed = [full.add("h", "leaf", [w] * 4, n, []) for w, n in (("a", 5), ("b", 1), ("c", 7))]
    assert closed[:2] == [None, None] and closed[2][0] == ["b"] * 4


# Pages

FURNITURE = "Menu\n[Home](/home) [Shop](/shop)\n\nWe use cookies to measure visits.\nAccept all\n\n"
FOOTER = "\n\nMost read\n- [Other {0}](/p/{0})\nOne more {0} ({0} likes)\n\nTags: x{0}, y{0}\n\n© 20{0} The Site. All rights reserved."


def test_articles(spark):
    pages = []
    for i in range(12, 32):
        word = "abcdefghijklmnopqrstuvwxyzabcdefghijklm"[i - 12 : i - 6]
        article = f"# A title about {word}\n\nIt rained.\n\nReaders asked whether cookies of {word} still serve them.\n\nWorth a look this week:\n- [{word}](https://{word}.example/x): a sentence."
        pages.append(("page", f"p{i}", "the-site.example", FURNITURE + article + FOOTER.format(i)))
    pages += [("page", "other", "x.example", "No furniture here.\n\nNone at all."), ("page", "only", "the-site.example", FURNITURE.strip())]
    frame = spark.createDataFrame(pages, "record_kind string, record_id string, host string, text string")
    found = {}
    for r in page_wrapper.lines_outside(frame, hot_rows=10).collect():
        found.setdefault(r.record_id, []).append(r.line_no)
    assert sorted(found["p12"]) == [1, 2, 4, 5, 16, 17, 18, 20, 22]
    assert sorted(found["only"]) == [1, 2, 4, 5] and "other" not in found
    texts = {r.record_id: r.article for r in page_wrapper.articles(frame).collect()}
    assert texts["only"] == "" and texts["p12"].startswith("# A title") and texts["p12"].endswith("a sentence.") and "Menu" not in texts["p12"]
    assert page_wrapper.lines_outside(frame.where("false")).count() == 0


PAGES = "record_kind string, record_id string, host string, text string"


def _own(i):
    word = "".join("abcdefghij"[int(x)] for x in f"{i:05d}")
    return f"Rain fell on {word} and nobody there thought of going home before the evening, as the council of {word} had asked for."


RECURRING = [
    "We use cookies and small files on your device " + "to measure visits and to remember what you chose " * 5 + "as told.",
    " | ".join(f"[Part {c}](https://the-site.example/{c})" for c in "abcdefgh") * 2,
    '<div class="cookie">We set small files on your device</div>',
    "![Subscribe](https://the-site.example/banner.png)",
    "This site is run by volunteers in their spare time.",
    "> Read by many",
]


def test_any_recurring_line_may_be_furniture(spark):
    """Lines of any length, of markup and of any words, before and after the article."""
    pages = []
    for n, line in enumerate(RECURRING):
        for place, blocks in (("start", [line, "{}", "{}"]), ("end", ["{}", "{}", line])):
            pages += [("page", f"{place} {n} {i}", f"www.{place}-{n}.example", "\n\n".join(_own(i + 200 * k + 1000 * (2 * n + len(place))) if b == "{}" else b for k, b in enumerate(blocks))) for i in range(60)]
    found = sorted((r.record_id, r.line_no) for r in page_wrapper.lines_outside(spark.createDataFrame(pages, PAGES)).collect())
    assert found == sorted((p[1], 1 if p[1].startswith("start") else 5) for p in pages)


def test_the_same_line_in_menu_and_article(spark):
    """Alignment goes by position: a set of labels would take the line out of both places."""
    pages = [("page", f"p{i}", "the-site.example", f"Menu\nAbout\nShop\nJobs\n\n{_own(i)}\n\nAbout\n\n{_own(i + 60)}\n\n- {_own(i)[:30]}\n- About\n- {_own(i)[30:60]}\n\nShop\nJobs") for i in range(0, 60, 12)]
    pages += [("page", f"q{i}", "the-site.example", f"Menu\nAbout\nShop\nJobs\n\n{_own(i)}") for i in range(60)]
    found = {}
    for r in page_wrapper.lines_outside(spark.createDataFrame(pages, PAGES)).collect():
        found.setdefault(r.record_id, []).append(r.line_no)
    assert sorted(found["q7"]) == [1, 2, 3, 4] and sorted(found["p12"]) == [1, 2, 3, 4, 16, 17]


def test_what_writers_repeat_stays(spark):
    lines = [f"Title {'abcdefghij'[i % 10]}\n\n{_own(i)}\n\nIt rained.\n\n{_own(i + 60)}\n\nWorth a look this week:\n- {_own(i)[:40]}\n- {_own(i)[40:]}\n\n\\begin{{itemize}}\n\\item {_own(i)}\n\\end{{itemize}}" for i in range(60)]
    assert page_wrapper.lines_outside(spark.createDataFrame([("page", f"p{i}", "h.example", x) for i, x in enumerate(lines)], PAGES)).count() == 0


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_a_hot_host_and_odd_rows(spark, hot_rows):
    rows = [("page", f"p{i}", "the-site.example", f"Menu\nShop\n\n{_own(i)}", 1, "x") for i in range(60)]
    rows += [rows[0], ("page", "long", "the-site.example", "word " * 100_000, 1, "x"), ("issue", None, "", "Menu\nShop", 1, "x"), ("page", "code", "the-site.example", "```\nMenu\n\nShop\n```", 1, "x")]
    frame = spark.createDataFrame(rows, PAGES + ", line_no int, tree string")
    found = sorted((r.record_id, r.line_no) for r in page_wrapper.lines_outside(frame, hot_rows=hot_rows).collect())
    assert found == sorted([(f"p{i}", n) for i in range(60) for n in (1, 2)] + [("p0", 1), ("p0", 2)])


def test_page_rows(spark):
    rows = spark.createDataFrame([("u1", None, "x"), ("u2", "", "y"), ("https://H.example:1/a", "t", "z"), ("u3", "t", "w")], "url string, markdown string, text string")
    got = page_wrapper.page_rows(rows, "page", "url", "url", "markdown").collect()
    assert [(r.record_id, r.host) for r in got] == [("https://H.example:1/a", "h.example"), ("u3", "")]


def test_simple_tree_matching():
    leaf = lambda x: (x, ())
    a = ("r", (leaf("x"), ("b", (leaf("c"), leaf("d"))), leaf("y")))
    b = ("r", (("b", (leaf("d"),)), leaf("z"), leaf("y"), leaf("x")))
    assert page_wrapper.simple_tree_matching(a, b) == (4, [(1, 0), (2, 2)])
    assert page_wrapper.simple_tree_matching(("r", ()), ("s", ())) == (0, [])


def _most_matched(a, b):
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for xs in itertools.combinations(a[1], n):
            for ys in itertools.combinations(b[1], n):
                each = [_most_matched(x, y) for x, y in zip(xs, ys)]
                if all(each):
                    best = max(best, sum(each))
    return best + 1


TREES = st.recursive(st.tuples(st.sampled_from("ab"), st.just(())), lambda kids: st.tuples(st.sampled_from("ab"), st.lists(kids, max_size=3).map(tuple)), max_leaves=6)


@settings(max_examples=150, deadline=None, derandomize=True)
@given(TREES, TREES)
def test_matching_against_brute_force(a, b):
    size, pairs = page_wrapper.simple_tree_matching(a, b)
    assert size == _most_matched(a, b)
    assert all(x < y and u < v for (x, u), (y, v) in itertools.pairwise(pairs))
    assert size == (a[0] == b[0]) + sum(_most_matched(a[1][x], b[1][u]) for x, u in pairs)


def test_alignment_with_a_wrapper():
    wrapper = [(t, page_wrapper.as_tree(t.split(" "))) for t in ("t= e~+", "s= t=", "t=", "l=")]
    assert page_wrapper.outside("t= e~+", wrapper) == [0, 1]
    assert page_wrapper.outside("c t= e~", wrapper) == [1, 2]  # text, then a list of the site
    assert page_wrapper.outside("s= c+", wrapper) == []  # a line before text introduces it
    assert page_wrapper.outside("l= s= t= l=", wrapper) == [0, 1, 2, 3]
    assert page_wrapper.outside("e~ c", wrapper) == [] and page_wrapper.outside("m=", wrapper) == []


# Packing and mixing


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.integers(0, 700), max_size=200), st.integers(1, 8))
def test_packer(sizes, windows):
    packer, fill = packing.Packer(256, windows), {}
    for size in sizes:
        parts = packing.pieces(size, 256)
        assert sum(n for _, n in parts) == size and len(parts) == max(1, -(-size // 256))
        for _, n in parts:
            window = packer.place(n)
            fill[window] = fill.get(window, 0) + n
            assert len(packer.open) <= windows
    assert all(n <= 256 for n in fill.values())


def test_packing(spark):
    words = ["", None, "word", "a few words here", "long " * 700, "longer text " * 100, "x" * 5000]
    rows = spark.createDataFrame([(i, words[i % len(words)], "s", 1) for i in range(140)] + [(None, "no id", "s", 1), (1, "again", "s", 1)], "doc_id long, text string, container_id string, piece int").repartition(20)
    packed = packing.pack(rows, "doc_id", "text", [(1, 64), (2, 512)], windows=3).collect()
    for spec, capacity in ((1, 64), (2, 512)):
        mine = [r for r in packed if r.spec_id == spec]
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert all(n <= capacity for n in fill.values())
        assert sum(r.n_tokens for r in mine) == sum(tokens.count_tokens(words[i % len(words)]) for i in range(140)) + tokens.count_tokens("no id") + tokens.count_tokens("again")
        assert {r.doc_id for r in mine} == {*range(140), None}
        whole = [r for r in mine if r.doc_id is not None and r.doc_id % 7 == 3]
        assert len(whole) == 20  # what fits is never split
        assert sum(fill.values()) / (len(fill) * capacity) > 0.85
    assert packing.pack(rows.where("false"), "doc_id", "text", [(1, 64)]).count() == 0


def test_merging_is_bounded(spark):
    """4,096 partitions with 64 open windows each: no group of any round holds more than FAN_IN * windows."""
    windows, capacities = 64, {1: 1000}
    left = spark.range(4096 * windows).selectExpr("1 AS spec_id", "CAST(id DIV 64 AS int) AS part", "id % 64 AS window", "1 + pmod(xxhash64(id), 900) AS n_tokens", "CAST(id DIV 64 AS int) AS grp")
    total, done, rounds = left.agg(F.sum("n_tokens")).first()[0], 0, 0
    containers = 0
    while left is not None:
        most = left.groupBy(F.floor(F.col("grp") / packing.FAN_IN)).count().agg(F.max("count")).first()[0]
        assert most <= packing.FAN_IN * windows
        moves = packing.merging_round(left, capacities, windows).cache()
        last = moves.agg(F.max("grp")).first()[0] == 0
        ended = moves.where("part = to_part AND window = to_window" + ("" if last else " AND NOT passed_on")).agg(F.sum("n_tokens"), F.count(F.lit(1)), F.max("n_tokens")).first()
        done, containers, rounds = done + (ended[0] or 0), containers + ended[1], rounds + 1
        assert (ended[2] or 0) <= 1000
        left = None if last else packing.passed_on(moves)
    assert done == total and rounds == 3 and total / (containers * 1000) > 0.97


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 5), st.integers(1, 99)), max_size=40), st.integers(1, 5))
def test_merged_windows(sizes, windows):
    rows = [(spec, part, n, size) for n, (spec, part, size) in enumerate(sizes)]
    moves = packing.merge_windows(rows, {1: 100, 2: 130}, windows)
    assert sorted(m[:3] for m in moves) == sorted(r[:3] for r in rows)
    fill = {}
    for spec, part, window, size in rows:
        to = next(m for m in moves if m[:3] == (spec, part, window))
        fill.setdefault((spec, *to[3:5]), [0, to[5], to[6]])[0] += size
    assert all(total == told <= {1: 100, 2: 130}[key[0]] for key, (total, told, _) in fill.items())
    for spec in (1, 2):
        assert sum(on for key, (_, _, on) in fill.items() if key[0] == spec) <= windows


def test_token_counts():
    text = "Some words, numbers 123 and more. " * 20_000
    assert tokens.count_tokens(text) == len(tokens.tokenizer().encode_ordinary(text))
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0


def test_mixing(spark):
    dice = random.Random(5)
    rows = [(i, "big" if i % 3 else "mid", dice.randint(50, 900)) for i in range(3000)] + [(9000 + i, "small", dice.randint(50, 900)) for i in range(40)] + [(1, "zero", 0), (None, "big", 100), (5, None, 3), (6, "stranger", 10)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = [("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("zero", 0.05, 3), ("absent", 0.05, 9)]
    chosen, plans = mixing.mixture(sized, targets, seed=1)
    report = {r.source: r for r in mixing.share_report(chosen, plans).collect()}
    for source, share, repeats in targets[:3]:
        assert report[source].actual_share == pytest.approx(share / 0.9, abs=0.02)
        assert report[source].most_copies <= repeats
    assert report["zero"].tokens == report["absent"].tokens == 0 and len(report) == 5
    assert report["small"].uses == 160
    larger, plans = mixing.mixture(sized, targets, total_tokens=10**9, seed=1)
    assert larger.where("source = 'big'").count() == sized.where("source = 'big'").count()
    again, _ = mixing.mixture(sized, targets, seed=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, chosen.collect()))
    nothing, plans = mixing.mixture(sized.where("false"), targets)
    assert nothing.count() == 0 and all(r.tokens == 0 for r in mixing.share_report(nothing, plans).collect())
    with pytest.raises(ValueError):
        mixing.mixture(sized, [*targets, ("big", 0.1, 1)])


# Endings


def test_endings(spark):
    dice = random.Random(11)
    nouns = "harbor ledger compass market bridge garden memo ritual season toolkit".split()
    sentence = lambda: f"The {dice.choice(nouns)} reshapes the {dice.choice(nouns)} long before the {dice.choice(nouns)} can name it."
    endings = ["", "", "", "\n\n— Ann Bell", "\n\n- slow memo\n- quiet map", "\n\nhttps://a.example/x/12", "\n\n```\nx = 1\n```", "\n\nAnd so we wait…", "\n\nNext issue: On maps"]
    rows, cut = [], set()
    for i in range(3000):
        text = " ".join(sentence() for _ in range(dice.randint(5, 20))) + dice.choice(endings)
        if i % 10 == 0:
            at = 400 if i % 20 and len(text) > 400 else dice.randint(60, 300)
            short = text[:at]
            if short.rstrip()[-1] not in ".…`":
                text = short + dice.choice(["", "", "…", " [...]"])
                cut.add(i)
        rows.append((i, text, f"s{i % 3}", 0.5))
    rows += [(9001, None, "s1", 0.5), (9002, "", None, 0.5), (9003, "  \n ", "s1", 0.5), (9004, "```\nopen code", "s2", 0.5), (9005, "A sentence of its own.", None, 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, probability double")
    scored = truncation.truncated_texts(frame, "doc_id", "text", "source").cache()
    found = {r.doc_id for r in scored.where("truncated").collect()}
    assert scored.count() == len(rows)
    assert found & {9001, 9002, 9003, 9005} == set() and 9004 in found
    hits = len(found & cut)
    assert hits / len(cut) > 0.97 and hits / (len(found) - 1) > 0.97
    shares = {r.source: r for r in truncation.truncation_shares(scored).collect()}
    assert shares["s0"].documents == 1000 and 0.03 < shares["s0"].share < 0.2
    assert truncation.truncated_texts(frame.where("false"), "doc_id", "text", "source").count() == 0


def test_logistic_regression_is_deterministic():
    dice = np.random.default_rng(0)
    slots = dice.integers(0, 64, (400, 5))
    labels = (slots[:, 0] < 32).astype(float)
    slots[:, 0] += 64
    w, b = truncation.fit_logistic(slots, labels, bits=8)
    assert ((w[slots].sum(1) + b > 0) == (labels > 0)).mean() > 0.9
    assert np.array_equal(w, truncation.fit_logistic(slots, labels, bits=8)[0])


def test_limits(spark):
    lengths = [("a", 500)] * 40 + [("a", n) for n in range(400, 600)] + [("b", n) for n in range(100, 400, 3)]
    rows = spark.createDataFrame(lengths, "source string, length long")
    counts = rows.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    found = {(r.source, r.length) for r in truncation.length_limits(counts, "source", "length", "n").collect()}
    assert ("a", 500) in found and all(abs(n - 500) <= 3 and s == "a" for s, n in found)
