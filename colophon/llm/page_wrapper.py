"""The article of a page without the furniture around it: wrapper induction by aligning the trees of one host's pages.

A page is a tree: its blocks (apart by blank lines), their lines, and the links or separated parts of a line.  A text that
many pages of the host share at a node of the same kind is constant, all others vary.  Block trees that recur on the host's
pages make its wrapper.  Every distinct block tree is aligned with the wrapper's trees by simple tree matching: lines at
constant nodes, and at slots that the template fills with links of the same site or with records, are template.  Slots of
text are the article's.  Blocks of furniture come in any order, so blocks are aligned one by one, lines in their order.  No
list of words takes part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.web import host_of
from colophon.operators.skew import HOT_ROWS, MAX_HOT, skew_join
from colophon.session import cut

#: Characters from which a sentence counts as a paragraph when its neighbours are judged.
PARAGRAPH = 100
#: Share of a text's pages from which it counts as the writers' own if it stands there between two paragraphs.
FLOATING = 0.15
#: Words of a label before a colon and a list of values.
LABEL_WORDS = 3

_LINK = re.compile(r"!?\[([^\]\[]*)\]\(([^()\s]*)\)")
_BULLET = re.compile(r"^(?:[-*+•]|\d{1,3}[.)])\s+")
_HEADING = re.compile(r"^#{1,6}\s+")
_PARTS = re.compile(r"\s+[|/·∙›»•]\s+|\s{2,}|\t+")
_BETWEEN = " |/·∙›»•\t-"
_FENCE = re.compile(r"^(```|~~~)")
_OPEN_CODE = re.compile(r"\\begin\{(?:verbatim|lstlisting)\}|<(?:pre|syntaxhighlight|source)\b", re.I)
_CLOSE_CODE = re.compile(r"\\end\{(?:verbatim|lstlisting)\}|</(?:pre|syntaxhighlight|source)>", re.I)
_NAME = re.compile(r"(?<=\s)[A-Z][\w’'-]*")
_DIGITS = re.compile(r"\d+")
#: A count in brackets that ends a record of a list.
_SUFFIX = re.compile(r"\(\d[^()]*\)$")
_WORD = re.compile(r"[^\W\d_]")
_MARKUP = re.compile(r"<[^<>]*>|\\[A-Za-z]+\*?|\{\|.*|&#?\w+;")
_MARKED = "\\|{}<$=`!>:;"
_STOPS = ".?!:…\"”’)"


class Line:
    """A node of a page: its kind, the texts of its leaves, and whether all its links stay on the site.

    Kinds: ``t`` words, ``s`` a sentence, ``h`` a heading, ``m`` a line of markup, ``l`` links, ``p`` parts, ``d`` a label
    before values, ``r`` a record that ends in a count, ``c`` code, ``x`` a line without words."""

    __slots__ = ("kind", "labels", "near", "size")

    def __init__(self, kind: str, labels: Sequence[str] = (), near: bool = False, size: int = 0):
        self.kind, self.labels, self.near, self.size = kind, labels, near, size


_CODE, _RULE = Line("c"), Line("x")


def label_hash(label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "replace")) - (1 << 63)


def host_names(host: str | None) -> re.Pattern | None:
    """Matches the host and the name of the publication that stands in it."""
    parts = [p for p in (host or "").split(".") if p]
    if len(parts) < 2:
        return None
    name = re.escape(parts[-2]).replace(r"\-", "[ -]")
    return re.compile(rf"{re.escape(host)}|{name}", re.I)


def _masked(text: str, names: re.Pattern | None) -> str:
    if names is not None:
        text = names.sub("@", text)
    return _DIGITS.sub("0", _NAME.sub("*", text)).lower()


def parse_line(line: str, host: str | None, names: re.Pattern | None) -> Line:
    """The node of a stripped line outside code."""
    if line[0] in _MARKED and not _LINK.match(line):
        return Line("m", [_masked(line, names)]) if _WORD.search(_MARKUP.sub("", line)) else _RULE
    if not _WORD.search(line):
        return _RULE
    bare = _BULLET.sub("", line)
    heading = bool(_HEADING.match(bare))
    bare = _HEADING.sub("", bare).strip("*_ ") if heading or bare[:2] in ("**", "__") else bare
    if heading or not bare:
        return Line("h", [_masked(bare, names)])
    links = _LINK.findall(bare)
    if links:
        if not _LINK.sub("", bare).strip(_BETWEEN):
            near = all(to[:1] in ("/", "#", "") or bool(host) and host in to for _, to in links)
            return Line("l", [_masked(t.strip(), names) for t, _ in links], near)
        bare = _LINK.sub(r"\1", bare)
    parts = [p for p in _PARTS.split(bare) if p]
    if len(parts) > 1:
        return Line("p", [_masked(p, names) for p in parts])
    if (count := _SUFFIX.search(bare)) and count.start():
        return Line("r", [_masked(bare, names), _masked(count[0], None)])
    head, colon, rest = bare.partition(": ")
    if colon and rest and rest[-1] not in _STOPS and len(head.split(" ")) <= LABEL_WORDS and (", " in rest or len(rest.split(" ")) <= LABEL_WORDS):
        return Line("d", [_masked(bare, names), head.lower() + ":"])
    return Line("s" if bare[-1] in _STOPS else "t", [_masked(bare, names)], size=len(bare))


def parse_blocks(text: str, host: str | None, names: re.Pattern | None, known: dict[str, Line]) -> list[list[tuple[int, Line]]]:
    """The blocks of a page as lists of (line number from 1, node).  ``known`` keeps the nodes of short lines of the host."""
    blocks: list[list[tuple[int, Line]]] = []
    fence, verbatim, fresh = "", False, True
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if fence or verbatim:
            if fence and line.startswith(fence):
                fence = ""
            if verbatim and _CLOSE_CODE.search(line):
                verbatim = False
            node = _CODE
        elif not line:
            fresh = True
            continue
        elif (m := _FENCE.match(line)) and line.count(m[1]) == 1:
            fence, node = m[1], _CODE
        elif (line[0] in "\\<" or "<" in line or "\\" in line) and _OPEN_CODE.search(line):
            verbatim, node = not _CLOSE_CODE.search(line), _CODE
        else:
            node = known.get(line)
            if node is None:
                node = parse_line(line, host, names)
                if len(line) <= PARAGRAPH and len(known) < 20_000:
                    known[line] = node
        if fresh or not blocks:
            blocks.append([])
            fresh = False
        blocks[-1].append((number, node))
    return blocks


def _paragraph(block: list[tuple[int, Line]]) -> bool:
    return block[0][1].kind == "s" and block[0][1].size >= PARAGRAPH


def _count_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with each text of each host, combined per batch, and those where it stands alone between paragraphs; label
    null: the host's pages."""
    names: dict = {}
    known: dict = {}
    for batch in batches:
        pages: Counter = Counter()
        floating: Counter = Counter()
        for host, text in zip(batch["host"], batch["text"]):
            if host not in names:
                names[host] = host_names(host)
            pages[host, None] += 1
            blocks = parse_blocks(text, host, names[host], known.setdefault(host, {}))
            alone = {
                b[0][1].labels[0]
                for i, b in enumerate(blocks)
                if len(b) == 1 and b[0][1].kind in "tsm" and 0 < i < len(blocks) - 1 and _paragraph(blocks[i - 1]) and _paragraph(blocks[i + 1])
            }
            for label in {x for b in blocks for _, node in b for x in node.labels}:
                pages[host, label] += 1
                if label in alone:
                    floating[host, label] += 1
        if len(known) > 500:
            known.clear()
        rows = [(h, None if x is None else label_hash(x), n, floating[h, x]) for (h, x), n in pages.items()]
        frame = pd.DataFrame(rows, columns=["host", "label", "pages", "floating"])
        yield frame.assign(label=pd.array([r[1] for r in rows], dtype="Int64"))


def host_constants(pages: DataFrame, least_pages: int = 5, host_share: float = 0.02, all_share: float = 0.002) -> DataFrame:
    """(host, host_pages, constants): hashes of the texts that are constant on the host.

    A text is constant on a host if it is on at least twice ``least_pages`` of its pages and ``host_share`` of them, so that
    an article read a few times is no template; what is on at least ``least_pages`` pages, ``least_pages`` hosts and
    ``all_share`` of all pages counts on every host that has it.  A text that stands between two paragraphs on ``FLOATING``
    of its pages is no node of a wrapper: there the aligned pages hold varying paragraphs, so it fills their slot.  The
    shares bound the constants of a host by the average number of texts of a page over the share.
    """
    counts = pages.select("host", "text").mapInPandas(_count_labels, "host string, label long, pages long, floating long")
    counts = cut(counts.groupBy("host", "label").agg(F.sum("pages").alias("pages"), F.sum("floating").alias("floating")))
    per_host = counts.where(F.col("label").isNull()).select("host", F.col("pages").alias("host_pages"))
    labels = counts.where(F.col("label").isNotNull())
    overall = labels.groupBy("label").agg(F.sum("pages").alias("all_pages"), F.count(F.lit(1)).alias("hosts"), F.sum("floating").alias("all_floating"))
    total = per_host.agg(F.sum("host_pages")).first()[0] or 0
    frequent = overall.where(F.col("all_pages") >= max(least_pages, all_share * total))
    frequent = frequent.select("label", (F.col("hosts") >= least_pages).alias("common"), (F.col("all_floating") >= FLOATING * F.col("all_pages")).alias("adrift"))
    known = skew_join(labels, per_host, ["host"], "inner", ["label"]).join(F.broadcast(frequent), "label", "left")
    own = (F.col("pages") >= 2 * least_pages) & (F.col("pages") >= F.col("host_pages") * F.lit(host_share))
    adrift = F.coalesce("adrift", F.col("floating") >= FLOATING * F.col("pages"))
    constant = known.where((own | F.coalesce("common", F.lit(False))) & ~adrift).groupBy("host").agg(F.collect_list("label").alias("constants"))
    return per_host.join(constant, "host", "left").select("host", "host_pages", F.coalesce("constants", F.array().cast("array<long>")).alias("constants"))


def node_token(node: Line, constants: set[int], hashes: dict[str, int]) -> str:
    """A line as a node of a block tree: its kind and its leaves, ``=`` constant, ``~`` varying, repeats once; ``e~`` for
    a varying link of the site or a record, ``c`` for a slot of text, ``x`` for a line without words."""
    if node.kind in "cx":
        return node.kind
    leaves = []
    for label in node.labels:
        h = hashes.get(label)
        if h is None:
            h = hashes[label] = label_hash(label)
        leaves.append("=" if h in constants else "~")
    if node.kind in "rd":  # the whole text may be constant; else what it ends or begins with
        return "t=" if leaves[0] == "=" else "c" if leaves[1] == "~" else "e~" if node.kind == "r" else "d=~"
    if "=" not in leaves:
        return "e~" if node.kind == "l" and node.near else "c"
    if node.kind in "lp" and "~" in leaves:
        fixed = leaves.count("=")
        if node.kind == "p" and leaves[:-1].count("=") == len(leaves) - 1 > 1 or node.kind == "l" and 2 * fixed > len(leaves):
            return f"{node.kind}=~"
        return "c"
    return f"{node.kind}="


def block_trees(blocks: list[list[tuple[int, Line]]], constants: set[int], hashes: dict[str, int]) -> Iterator[tuple[str, list[int], list[int]]]:
    """(tree, lines, nodes) of the blocks with a constant: the kinds of its lines, runs of equal ones as one node with
    ``+``, the lines' numbers and the node of each.  A block of one text between two blocks of text lies in the article."""
    tokens = [[node_token(node, constants, hashes) for _, node in b] for b in blocks]
    text = ["c" in t for t in tokens]
    for i, (block, kinds) in enumerate(zip(blocks, tokens)):
        if not any("=" in k for k in kinds):
            continue
        if len(kinds) == 1 and (kinds[0] == "h=" or kinds[0] in ("t=", "s=", "m=") and 0 < i < len(blocks) - 1 and text[i - 1] and text[i + 1]):
            continue
        tree: list[str] = []
        nodes: list[int] = []
        for k in kinds:
            if not tree or tree[-1].rstrip("+") != k:
                tree.append(k)
            else:
                tree[-1] = k + "+"
            nodes.append(len(tree) - 1)
        yield " ".join(tree), [n for n, _ in block], nodes


def as_tree(nodes: Sequence[str]) -> tuple:
    """A block tree of (label, children) tuples: root, lines by kind, leaves."""
    return ("block", tuple((n.rstrip("+")[0], tuple((leaf, ()) for leaf in n.rstrip("+")[1:])) for n in nodes))


def simple_tree_matching(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """Largest order-preserving match of two trees of (label, children): matched nodes, and the places of the root's matched
    children in both trees."""
    if a[0] != b[0]:
        return 0, []
    xs, ys = a[1], b[1]
    m, n = len(xs), len(ys)
    size = [[0] * (n + 1) for _ in range(m + 1)]
    pair = {}
    for i in range(1, m + 1):
        above, row, x = size[i - 1], size[i], xs[i - 1]
        for j in range(1, n + 1):
            best = above[j] if above[j] >= row[j - 1] else row[j - 1]
            if x[0] == ys[j - 1][0]:
                w = pair[i, j] = simple_tree_matching(x, ys[j - 1])[0]
                best = max(best, above[j - 1] + w)
            row[j] = best
    matched, i, j = [], m, n
    while i and j:
        if (i, j) in pair and size[i][j] == size[i - 1][j - 1] + pair[i, j]:
            matched.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return size[m][n] + 1, matched[::-1]


def is_template(tree: Column) -> Column:
    """Whether a recurring block tree belongs to a wrapper: it begins with a constant, has no slot of text, and is more than
    headings."""
    return tree.rlike(r"^[^ ]+=") & ~tree.rlike(r"(^| )c\+?( |$)") & ~tree.rlike(r"^(h=\+?( |$))+$")


def outside(tree: str, wrapper: Sequence[tuple[str, tuple]]) -> list[int]:
    """The nodes of a block tree that a wrapper's trees cover.

    Between slots of text the tree is aligned with the wrapper's tree that matches the most nodes, a constant among
    them and at least half of the wrapper's; what is left is aligned again.  A single line beside a slot of text stays: it introduces what follows or closes it."""
    nodes = tree.split(" ")
    found: list[int] = []
    run: list[int] = []
    for i in range(len(nodes) + 1):
        if i < len(nodes) and nodes[i].rstrip("+") != "c":
            run.append(i)
            continue
        alone = len(run) == 1 and not nodes[run[0]].endswith("+") and len(nodes) > 1
        rest = [] if alone and nodes[run[0]][0] in "tshm" else run
        while rest:
            own = as_tree([nodes[k] for k in rest])
            best, least, hit = 0, 0, []
            for name, template in wrapper:
                n, pairs = simple_tree_matching(own, template)
                weight = n - 1
                size = sum(1 + len(x[1]) for x in template[1])
                if any("=" in nodes[rest[x]] for x, _ in pairs) and 2 * weight >= size and (weight > best or weight == best and size < least):
                    best, least, hit = weight, size, [rest[x] for x, _ in pairs]
            if not hit:
                break
            found += hit
            rest = [k for k in rest if k not in hit]
        run = []
    return sorted(k for k in found if "=" in nodes[k] or nodes[k][0] == "e")


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names: dict = {}
    known: dict = {}
    for batch in batches:
        rows = []
        wrappers: dict = {}
        for kind, key, host, text, constants in zip(*(batch[c] for c in ("record_kind", "record_id", "host", "text", "constants"))):
            if host not in names:
                names[host] = host_names(host)
            if host not in wrappers:
                wrappers[host] = (set() if constants is None else set(map(int, constants)), {})
            blocks = parse_blocks(text, host, names[host], known.setdefault(host, {}))
            rows += [(kind, key, host, *found) for found in block_trees(blocks, *wrappers[host])]
        if len(known) > 500:
            known.clear()
        yield pd.DataFrame(rows, columns=["record_kind", "record_id", "host", "tree", "lines", "nodes"])


def _aligned(common: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = {t: as_tree(t.split(" ")) for t in common}
        done: dict = {}
        for batch in batches:
            found = []
            for tree, own in zip(batch["tree"], batch["own"]):
                names = tuple(sorted({*common, *(own if own is not None else ())}))
                if (tree, names) not in done:
                    for t in names:
                        if t not in parsed:
                            parsed[t] = as_tree(t.split(" "))
                    done[tree, names] = outside(tree, [(t, parsed[t]) for t in names])
                found.append(done[tree, names])
            if len(done) > 100_000:
                done.clear()
            yield pd.DataFrame({"host": batch["host"], "tree": batch["tree"], "found": found})

    return run


def page_rows(documents: DataFrame, kind: str, key: str, url: str, text: str) -> DataFrame:
    """(record_kind, record_id, host, text) of the rows with a text; rows without a host form a host of their own, ''."""
    host = F.coalesce(host_of(F.col(url)), F.lit(""))
    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), host.alias("host"), F.col(text).alias("text"))


def lines_outside(pages: DataFrame, hot_rows: int = HOT_ROWS, least_pages: int = 5, host_share: float = 0.02, all_share: float = 0.002) -> DataFrame:
    """(record_kind, record_id, line_no from 1) of each line outside the article, of :func:`page_rows`.

    Pages meet their host's constants in a join that salts hosts of many pages.  Block trees are counted per host, and each
    distinct one is aligned once, with those that recur on its host (``host_share`` of its pages, two at least: what is
    constant in them has its support already) or on many (``all_share`` of all pages): shares bound both sets.  Null and empty texts have no lines.  Repeated rows repeat their lines.
    """
    constants = cut(host_constants(pages, least_pages, host_share, all_share))
    hot = constants.where(F.col("host_pages") >= hot_rows).orderBy(F.desc("host_pages"), "host").limit(MAX_HOT).select("host")
    joined = skew_join(pages, constants.select("host", "constants"), ["host"], "left", ["record_id"], hot)
    schema = "record_kind string, record_id string, host string, tree string, lines array<long>, nodes array<int>"
    blocks = cut(joined.select("record_kind", "record_id", "host", "text", "constants").mapInPandas(_trees, schema))
    trees = cut(blocks.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("blocks")))
    total = constants.agg(F.sum("host_pages")).first()[0] or 0
    overall = trees.groupBy("tree").agg(F.sum("blocks").alias("all_blocks"), F.count(F.lit(1)).alias("hosts"))
    often = overall.where((F.col("all_blocks") >= max(least_pages, all_share * total)) & (F.col("hosts") >= least_pages))
    common = sorted(r[0] for r in often.where(is_template(F.col("tree"))).select("tree").collect())
    recurring = (F.col("blocks") >= 2) & (F.col("blocks") >= F.col("host_pages") * F.lit(host_share))
    own = skew_join(trees, constants.select("host", "host_pages"), ["host"], "inner", ["tree"]).where(recurring & is_template(F.col("tree")))
    own = own.groupBy("host").agg(F.sort_array(F.collect_list("tree")).alias("own"))
    pairs = skew_join(trees.select("host", "tree"), own, ["host"], "left", ["tree"])
    verdicts = cut(pairs.mapInPandas(_aligned(common), "host string, tree string, found array<int>")).where(F.size("found") > 0)
    busy = trees.where(F.col("blocks") >= hot_rows).orderBy(F.desc("blocks"), "host", "tree").limit(MAX_HOT).select("host", "tree")
    judged = skew_join(blocks, verdicts, ["host", "tree"], "inner", ["record_id", "lines"], busy)
    each = judged.select("record_kind", "record_id", "found", F.explode(F.arrays_zip("lines", "nodes")).alias("x"))
    return each.where(F.array_contains("found", F.col("x.nodes"))).select("record_kind", "record_id", F.col("x.lines").alias("line_no"))


def articles(pages: DataFrame, **limits) -> DataFrame:
    """``pages`` with ``text`` reduced to the article; texts that are furniture throughout become empty."""
    gone = lines_outside(pages, **limits).groupBy("record_kind", "record_id").agg(F.collect_set("line_no").alias("_gone"))
    marked = pages.join(gone, ["record_kind", "record_id"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("long")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    return marked.select("record_kind", "record_id", text.alias("article"))
