"""HTML extraction by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching; nodes whose
text stays constant over the host's pages become template, varying slots become content.

1. Each page is parsed into a small tree of labels with a hash of each node's own text; copies within a host count once.
2. Every tree of a host is aligned with the host's reference tree (one of its pages whose size is nearest to the middle one),
   and for each reference node the pages with each text are counted, in each task before they are shuffled.
3. A node with the same text on nearly all of at least LEAST pages is template; all others with text are varying slots.
   The host's content is the deepest element that holds most of the text of varying slots, links apart.
4. Each page is aligned again and the text in its content element is written out block by block, without template nodes.
   What tags, classes and roles mark as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
   comments is left out too. An article element decides where the content element holds more than it, and on pages that
   have no wrapper.

Templates of the HEAD hosts with most pages, among those with references of at most NODES nodes, are joined by broadcast
(which bounds it), those of all other hosts by a shuffle of just their pages.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adatlas.llm.common import mapped, stash

#: Hosts whose templates are broadcast; nodes of a reference tree there at most; pages before a node can be template; part of them that agree.
HEAD, NODES, LEAST, AGREE = 5000, 400, 5, 0.9
#: Part of the varying text that an element must hold for the content to be within it; parts into which the pages of a host are dealt.
MOSTLY, SALTS = 0.7, 16
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Fixed values of HTML: elements without content, with raw content, inside a line of text, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
#: Elements that hold text rather than other blocks: the content is never sought inside of one.
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption caption #root".split())
SCOPE = frozenset("ul ol dl table select article section div nav aside footer header main body html form".split())
#: Elements, roles and class or id words that mark what isn't the article.
ASIDE_TAGS = frozenset("nav aside footer form head button select menu dialog object canvas audio video map input".split()) | RAW
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies share sharing social related recommended "
    "newsletter subscribe subscription popup modal overlay widget toolbar pagination pager login signup search masthead topbar copyright legal disclaimer tracking skip".split()
)
WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """The tree of a page: labels, parents and children of nodes, whether each is set aside or in the article, and its runs of text by block."""

    def __init__(self, source: str):
        self.labels, self.children = ["#root"], [[]]
        self.apart, self.within, self.linked = [False], [False], [False]
        self.runs: list[tuple[int, int, str]] = []  # node, block, raw text
        self.tags = ["#root"]
        stack, block, at = [0], 0, 0
        end, low = len(source), None
        tag = TAG.search(source, 0)
        while True:
            text = source[at : tag.start() if tag else end]
            if text and not text.isspace():
                self.runs.append((stack[-1], block, text))
            elif text:
                self.runs.append((stack[-1], block, " "))
            if tag is None:
                break
            at = tag.end()
            name = tag[2]
            if name is None:
                tag = TAG.search(source, at)
                continue
            name = name.lower()
            if tag[1]:
                if name in self.tags and name != "#root":
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] == name:
                            del stack[k:]
                            break
                        if name in INLINE and self.tags[stack[k]] not in INLINE:
                            break
                block += name not in INLINE
                tag = TAG.search(source, at)
                continue
            if name == "br":
                self.runs.append((stack[-1], block, " "))
                tag = TAG.search(source, at)
                continue
            if name in CLOSES_P or name in SAME:
                shut = {"p"} if name in CLOSES_P else SAME[name]
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] in shut:
                        del stack[k:]
                        break
                    if self.tags[stack[k]] in SCOPE:
                        break
            block += name not in INLINE
            node = self._open(stack[-1], name, tag[3])
            if name in RAW:  # up to its end tag, or to the end
                low = source.lower() if low is None else low
                if len(low) != end:
                    low = re.sub("[A-Z]", lambda m: m[0].lower(), source)
                close = low.find(f"</{name}", at)
                at = end if close < 0 else close
                tag = TAG.search(source, at) if close >= 0 else None
                if tag is None:
                    break
                at = tag.end()
                block += name not in INLINE
            elif name not in VOID and not tag[3].endswith("/"):
                stack.append(node)
            tag = TAG.search(source, at)

    def _open(self, parent: int, name: str, attributes: str) -> int:
        node, label = len(self.labels), name
        apart, within = self.apart[parent], self.within[parent] or name in ("article", "main")
        if name in ASIDE_TAGS or name == "header" and not within:
            apart = True
        if attributes and not attributes.isspace():
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            marks = f"{found.get('class', '')} {found.get('id', '')}".strip()
            if marks:
                label = f"{name}.{found.get('class', '')}"
                words = {w.lower() for w in WORDS.split(marks)}
                if name not in ("body", "html", "article", "main") and (words & ASIDE_WORDS or "header" in words and not within):
                    apart = True
                elif name == "article" and words & {"comment", "comments", "reply"}:
                    apart = True
            if found.get("role", "").lower() in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                apart = True
        self.labels.append(label)
        self.tags.append(name)
        self.children.append([])
        self.children[parent].append(node)
        self.apart.append(apart)
        self.within.append(within)
        self.linked.append(self.linked[parent] or name == "a")
        return node

    def own_texts(self) -> tuple[list[int], list[int]]:
        """A hash of each node's own text, 0 where it has none; and its characters, but for links and what is set aside."""
        own: dict[int, list[str]] = {}
        for node, _, text in self.runs:
            own.setdefault(node, []).append(text)
        hashes, sizes = [0] * len(self.labels), [0] * len(self.labels)
        for node, parts in own.items():
            if text := " ".join("".join(parts).split()):
                hashes[node] = zlib.crc32(text.encode()) | 1
                sizes[node] = 0 if self.apart[node] or self.linked[node] else len(text)
        return hashes, sizes

    def inside(self, root: int) -> list[bool]:
        """Whether each node is root or below it."""
        out = [k == root for k in range(len(self.labels))]
        for k, below in enumerate(self.children):  # nodes come before their children
            if out[k]:
                for c in below:
                    out[c] = True
        return out

    def text(self, template: frozenset[int], root: int = 0) -> str:
        """The kept blocks in the content element joined by one space: those in article or main elements where some of these has text, else all others that stay."""
        held = self.inside(root) if root else [True] * len(self.labels)
        article = any(held[n] and self.within[n] and not self.apart[n] and not t.isspace() for n, _, t in self.runs)
        blocks, last = [], -1
        for node, block, text in self.runs:
            if self.apart[node] or node in template or not held[node] or article and not self.within[node]:
                continue
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
        out = []
        for parts in blocks:
            text = "".join(parts)
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                out.append(text)
        return " ".join(out)


class Tree:
    """A tree of labels given in preorder, with the shape of every subtree."""

    def __init__(self, labels: list[str], children: list[list[int]]):
        self.labels, self.children = labels, children
        self.shape, self.size = [0] * len(labels), [1] * len(labels)
        for k in range(len(labels) - 1, -1, -1):
            self.shape[k] = hash((labels[k], *[self.shape[c] for c in children[k]]))
            self.size[k] += sum(self.size[c] for c in children[k])


def matched(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest top-down, order-keeping alignment of equal labels, as nodes of a by nodes of b.

    Children that agree in whole shape at the beginning and end of two child lists are matched at once, which never
    loses a match; what lies between is matched by dynamic programming.
    """
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), min(len(a.labels), len(b.labels)) + 2000))  # a call for each level

    def same(x: int, y: int, out: list[tuple[int, int]]) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            todo += zip(a.children[x], b.children[y])

    def match(x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        if a.labels[x] != b.labels[y]:
            return 0, []
        if (x, y) in known:
            return known[x, y]
        out: list[tuple[int, int]] = [(x, y)]
        p, q = a.children[x], b.children[y]
        i = 0
        while i < (min(len(p), len(q)) + 1) // 2 and a.shape[p[i]] == b.shape[q[i]]:  # the rest from the end, as lists differ in their middle
            same(p[i], q[i], out)
            i += 1
        tail = 0
        while tail < min(len(p), len(q)) - i and a.shape[p[-1 - tail]] == b.shape[q[-1 - tail]]:
            same(p[-1 - tail], q[-1 - tail], out)
            tail += 1
        p, q = p[i : len(p) - tail], q[i : len(q) - tail]
        if p and q:
            best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for r, u in enumerate(p):
                for s, v in enumerate(q):
                    best[r + 1][s + 1] = max(best[r][s + 1], best[r + 1][s], best[r][s] + match(u, v)[0])
            r, s = len(p), len(q)
            while r and s:
                if best[r][s] == best[r - 1][s]:
                    r -= 1
                elif best[r][s] == best[r][s - 1]:
                    s -= 1
                else:
                    out += match(p[r - 1], q[s - 1])[1]
                    r, s = r - 1, s - 1
        known[x, y] = len(out), out
        return known[x, y]

    return {y: x for x, y in match(0, 0)[1]}


def packed_tree(page: Page) -> str:
    """Labels and depths of a page's tree in one string."""
    depth = [0] * len(page.labels)
    order, todo = [], [0]
    while todo:
        k = todo.pop()
        order.append(k)
        for c in reversed(page.children[k]):
            depth[c] = depth[k] + 1
            todo.append(c)
    return "\n".join(f"{depth[k]} {page.labels[k]}".replace("\n", " ") for k in order)


def unpacked(text: str) -> Tree:
    labels, children, path = [], [], []
    for k, line in enumerate(text.split("\n")):
        depth, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(k)
        path.append(k)
    return Tree(labels, children)


class Wrapper:
    """A host's reference tree, the texts of its template nodes, and its content element (0: the whole page)."""

    def __init__(self, reference: str, slots: list[dict]):
        self.tree = unpacked(reference)
        self.fixed = {s["node"]: s["hash"] for s in slots if s["constant"]}
        self.root = content_root(self.tree, {s["node"]: s["mass"] for s in slots if not s["constant"]})


def content_root(tree: Tree, mass: dict[int, float]) -> int:
    """The deepest element that holds MOSTLY of the varying text of the one around it, all the way down."""
    total = [mass.get(k, 0.0) for k in range(len(tree.labels))]
    for k in range(len(total) - 1, -1, -1):
        total[k] += sum(total[c] for c in tree.children[k])
    at = 0
    while below := [c for c in tree.children[at] if tree.labels[c].partition(".")[0] not in TEXTUAL]:
        best = max(below, key=total.__getitem__)
        if total[best] < MOSTLY * total[at] or not total[at]:
            break
        at = best
    return at


class Aligner:
    """Alignments with reference trees, kept by the two trees' shapes; and wrappers, kept by their reference."""

    def __init__(self, most: int = 20_000):
        self.trees: dict[str, Tree] = {}
        self.wrappers: dict[str, Wrapper] = {}
        self.known: dict[tuple[int, str], dict[int, int]] = {}
        self.most = most

    def __call__(self, reference: str, tree: Tree, shape: str) -> dict[int, int]:
        key = (hash(shape), reference)
        if key not in self.known:
            if len(self.known) > self.most:
                self.known.clear()
                self.trees.clear()
            if reference not in self.trees:
                self.trees[reference] = unpacked(reference)
            self.known[key] = matched(self.trees[reference], tree)
        return self.known[key]

    def wrapper(self, host: str, reference: str, slots: list[dict]) -> Wrapper:
        if host not in self.wrappers:
            if len(self.wrappers) > self.most:
                self.wrappers.clear()
            self.wrappers[host] = Wrapper(reference, slots)
        return self.wrappers[host]


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds `text`, the main text of each page, and `n_chars`, its code points; other columns are kept, these two replaced.

    A null or empty page has an empty text. Pages without a host (null or odd urls) are read without a template. Pages of
    any length are read whole; broken markup never fails: unclosed elements end with the page. Rows may repeat.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    source = pages.select(F.struct(*kept).alias("row"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, hashes, sizes, marks = [], [], [], []
            for text in batch.column("html").to_pylist():
                page = Page(text)
                trees.append(packed_tree(page))
                own, long = page.own_texts()
                hashes.append(own)
                sizes.append(long)
                marks.append(zlib.crc32(repr(own).encode()))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(marks, pa.int64())], ["host", "tree", "hashes", "sizes", "mark"])

    trees = mapped(source.where("host <> ''").select("host", "html"), shapes, "host string, tree string, hashes array<long>, sizes array<int>, mark long")
    trees = stash(trees.groupBy("host", "mark").agg(*[F.first(c).alias(c) for c in ("tree", "hashes", "sizes")]), "trees")
    usual = trees.groupBy("host").agg(F.percentile_approx(F.size("hashes"), 0.5).alias("usual"), F.count("*").alias("n")).where(f"n >= {LEAST}")
    # salted, as a host may have many of all pages
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    trees = trees.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int"))
    order = F.struct(F.abs(F.size("hashes") - F.col("usual")).alias("off"), F.xxhash64("mark").alias("h"), "mark")
    sized = trees.select("host", "salt", "tree", "hashes", "mark").join(usual.withColumn("salt", salts), ["host", "salt"])
    best = sized.groupBy("host", "n").agg(F.min_by(F.struct("tree", F.size("hashes").alias("nodes")), order).alias("best"))
    references = stash(best.select("host", "n", F.col("best.nodes").alias("nodes"), F.col("best.tree").alias("reference")), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Aligner()
        for batch in batches:
            counts: Counter = Counter()
            mass: Counter = Counter()
            for at, reference, tree, hashes, sizes in zip(*(batch.column(c).to_pylist() for c in ("host", "reference", "tree", "hashes", "sizes"))):
                for mine, theirs in aligned(reference, unpacked(tree), tree).items():
                    counts[key := (at, theirs, hashes[mine])] += 1
                    mass[key] += sizes[mine]
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, v, mass[k]) for k, v in counts.items())), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["host", "node", "hash", "n", "mass"])

    paired = trees.join(references.select("host", "reference").withColumn("salt", salts), ["host", "salt"])
    seen = mapped(paired.select("host", "reference", "tree", "hashes", "sizes"), align, "host string, node int, hash long, n long, mass long")
    texts = seen.groupBy("host", "node", "hash").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    nodes = texts.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.max_by("hash", "n").alias("hash"), F.max("n").alias("most"), F.sum("mass").cast("double").alias("mass"))
    nodes = nodes.withColumn("constant", F.expr(f"pages >= {LEAST} and most >= {AGREE} * pages and hash <> 0")).where("constant or mass > 0")
    slots = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "hash", "constant", "mass")).alias("slots"))  # at most a node each of a reference
    templates = stash(references.join(slots, "host").select("host", "n", "nodes", "reference", "slots"), "templates")

    schema = T.StructType([*source.select("row").schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Aligner()
        for batch in batches:
            out = []
            for at, text, reference, slots in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference", "slots"))):
                page = Page(text)
                template, root = set(), 0
                if reference is not None:
                    wrapper = aligned.wrapper(at, reference, slots)
                    hashes, _ = page.own_texts()
                    for mine, theirs in aligned(reference, Tree(page.labels, page.children), packed_tree(page)).items():
                        if theirs == wrapper.root:
                            root = mine
                        if hashes[mine] and wrapper.fixed.get(theirs) == hashes[mine]:
                            template.add(mine)
                out.append(page.text(frozenset(template), root))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["row", "text", "n_chars"])

    head = templates.where(f"nodes <= {NODES}").orderBy(F.desc("n"), "host").limit(HEAD).select("host", "reference", "slots", F.lit(True).alias("is_head"))
    near = source.join(F.broadcast(head), "host", "left")
    if templates.count() > head.count():
        rest = templates.join(F.broadcast(head.select("host")), "host", "left_anti").select("host", "reference", "slots").withColumn("salt", salts)
        far = near.where("is_head is null").drop("reference", "slots", "is_head").withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        far = far.join(rest, ["host", "salt"], "left")
        near = near.where("is_head").drop("is_head").unionByName(far.select("host", "row", "html", "reference", "slots"))
    done = mapped(near.select("host", "row", "html", "reference", "slots"), write, schema)
    return done.select("row.*", "text", "n_chars")


def op5(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


#: The given pages hold their text in one article of headings and paragraphs, so that SQL can state what is expected of them.
#: A reference cut short before its semicolon (&amp) is decoded as well, as HTML has it.
OP5_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS a FROM pages
), c AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM a
)
SELECT page_id, url, t AS text, length(t)::BIGINT AS n_chars FROM c
"""
