"""Main text of web pages by wrapper induction over the pages of a host.

Each page's DOM becomes a tree in which neighbouring siblings of one kind are one repeated slot. One
page of a host, that with the smallest hash, is its pivot; every page of the host is aligned to the
pivot by simple tree matching, and every block of text is counted at the slot it falls on. Over the
host's different contents this decides, slot by slot:

* A block that stands at its slot in nearly all contents is constant, so template.
* A slot whose text is mostly links is a menu, so template, however its words vary.
* A slot that element, role or class name marks as menu, header, footer, side bar, notice, advert, form
  or comment is template unless it holds most of the host's varying text.

What varies in the other slots is content, and the page's main part is found in it: from the root on, the
child that holds MAIN_SHARE of the varying text that the host has at these slots, as long as there is one
with blocks of its own; or article and main elements, where they hold most of it.

Hosts of few different contents share a wrapper with hosts whose pages have the same shape.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import batch, map_arrow, stored, table

#: A block is constant when so large a share of a host's different contents hold it, and two at least.
TEMPLATE_SHARE = 0.8
#: Hosts of fewer pages share wrappers by the shape of their pages.
OWN_PAGES = 8
#: Share of links in a menu's text, and of the varying text in the main part and in a marked slot that is none.
LINK_SHARE, MAIN_SHARE, MOST = 0.6, 0.75, 0.5
#: A parent with more runs of children than this has one slot for each kind of child; with more kinds, for each element.
RUNS = 48
#: Deeper elements are not nested further.
DEPTH = 150
#: In place of a slot: the whole page.
_PAGE = -2
#: Templates of all hosts are broadcast up to this size, joined by host beyond it.
BROADCAST_BYTES = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
DROPPED = frozenset("head script style noscript template textarea title iframe noembed noframes button select option input svg canvas object audio video xmp".split())
#: Weak evidence: elements, roles and words of class names and ids that mark what is not the article, and elements that mark it.
MARKED = frozenset("nav footer aside form header dialog menu".split())
MAIN = frozenset("article main".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation sidebar footer header masthead comment comments disqus cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social related breadcrumb breadcrumbs widget login signup pagination pager toolbar".split())
PLAIN_NAMES = MARKED_NAMES | frozenset(["", *"site global top bottom left right container wrapper box area block section list inner outer".split()])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_WORKER: dict = {}


class Node:
    """An element; mark is -1 where it is marked as no part of the article, 1 for article and main."""

    __slots__ = ("children", "dropped", "mark", "sig", "slot", "tag", "weight")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.slot, self.weight = tag, [], -1, 0.0
        self.dropped = tag in DROPPED
        self.mark = -1 if tag in MARKED else int(tag in MAIN)
        self.sig = tag
        if attributes and not attributes.isspace():
            own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = [set(_NAME.split(n)) for k in ("class", "id") for n in own.get(k, "").lower().split()]
            self.dropped |= "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
            if not self.mark and (own.get("role", "").lower() in MARKED_ROLES or any(n & MARKED_NAMES and n <= PLAIN_NAMES for n in names)):
                self.mark = -1
            self.sig = f"{tag}.{own['class'].split()[0].lower()}" if own.get("class", "").split() else tag

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(page: str) -> Node:
    """A forgiving parse: unclosed elements end with their parents, p and li where the next one begins."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            _close(stack, "p", BLOCK - {"p"})
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            for own in ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,):
                _close(stack, own, frozenset(("ul", "ol", "dl", "table", "select", "menu")) | ({"tr"} if tag in ("td", "th") else set()))
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str, walls: frozenset) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in walls:
            return


def runs_of(nodes: list[Node]) -> list[list[Node]]:
    """The children of one slot's nodes by slot: runs of one kind; with too many of them all of a kind, or of an element, together."""
    children = [c for node in nodes for c in node.children if isinstance(c, Node)]
    runs: list[list[Node]] = []
    for c in children:
        if runs and runs[-1][0].sig == c.sig:
            runs[-1].append(c)
        else:
            runs.append([c])
    if len(runs) > RUNS:
        kinds: dict[str, list[Node]] = {}
        for c in children:
            kinds.setdefault(c.sig, []).append(c)
        if len(kinds) > RUNS:
            kinds = {}
            for c in children:
                kinds.setdefault(c.tag, []).append(c)
        runs = list(kinds.values())
    return runs


def skeleton(nodes: list[Node]) -> tuple:
    """(sig, children, mark) of one slot, the nodes of which are merged."""
    marks = {node.mark for node in nodes}
    sig = nodes[0].sig if len({n.sig for n in nodes}) == 1 else nodes[0].tag
    return (sig, tuple(skeleton(r) for r in runs_of(nodes)), marks.pop() if len(marks) == 1 else 0)


def numbered(tree: tuple, counter: list[int] | None = None) -> tuple:
    """The same with a slot number in preorder in place of the mark: (sig, children, slot)."""
    counter = counter if counter is not None else [0]
    own = counter[0]
    counter[0] += 1
    return (tree[0], tuple(numbered(c, counter) for c in tree[1]), own)


def marks(tree: tuple) -> list[int]:
    """The marks of all slots in preorder."""
    return [tree[2], *(m for c in tree[1] for m in marks(c))]


def match(a: tuple, b: tuple) -> tuple[int, list]:
    """Simple tree matching: (matched nodes, [(child index of a, of b, their own matching)])."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[1], b[1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    pairs = {}
    for i, u in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            got = max(best[i - 1][j], best[i][j - 1])
            if u[0] == v[0]:
                pairs[i, j] = match(u, v)
                got = max(got, best[i - 1][j - 1] + pairs[i, j][0])
            best[i][j] = got
    links, i, j = [], len(x), len(y)
    while i and j:
        if (i, j) in pairs and best[i][j] == best[i - 1][j - 1] + pairs[i, j][0]:
            links.append((i - 1, j - 1, pairs[i, j][1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[len(x)][len(y)], links


def slots(tree: tuple, pivot: tuple) -> tuple:
    """The page's skeleton as nested (slot of the pivot or -1, children)."""

    def build(t, p, links):
        to = {i: (j, inner) for i, j, inner in links}
        return (p[2] if p else -1, tuple(build(c, p[1][to[i][0]], to[i][1]) if i in to else build(c, None, ()) for i, c in enumerate(t[1])))

    size, links = match(tree, pivot)
    return build(tree, pivot if size else None, links)


def place(nodes: list[Node], mapping: tuple) -> None:
    """Writes the slots into the nodes."""
    for node in nodes:
        node.slot = mapping[0]
    for run, inner in zip(runs_of(nodes), mapping[1], strict=True):
        place(run, inner)


class Block:
    """A block of text, the innermost element that holds all of it, and its characters inside of links."""

    __slots__ = ("links", "node", "text")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links


def blocks(root: Node) -> list[Block]:
    """The page's blocks outside of dropped elements, in page order."""
    out: list[Block] = []
    buffer: list[str] = []
    linked = [0]

    def flush(node):
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append(Block(node, text, min(len(text), linked[0])))
        linked[0] = 0

    def walk(node, link):
        for child in node.children:
            if isinstance(child, str):
                buffer.append(child)
                if link:
                    linked[0] += len(child)
            elif child.dropped:
                continue
            elif child.tag in BLOCK:
                flush(node if node.tag in BLOCK or node.tag == "#root" else owner[-1])
                owner.append(child)
                walk(child, link)
                flush(child)
                owner.pop()
            elif child.tag in ("br", "img"):
                buffer.append(" ")
            else:
                walk(child, link or child.tag == "a")

    owner = [root]
    walk(root, False)
    flush(root)
    return out


class Wrapper:
    """A host's pivot and what its pages say of the slots; aligns pages to it, alignments cached by structure."""

    def __init__(self, pivot: str | None, template: list[str] | None = None, slots_: list[tuple] | None = None):
        tree = _tuples(json.loads(pivot)) if pivot else None
        self.pivot = numbered(tree) if tree else None
        self.template = set(template or ())
        self.known: dict = {}
        self.out: set[int] = set()
        self.weight: dict[int, float] = {}
        if tree and slots_ is not None:
            self._decide(marks(tree), {slot: (varying, links, chars) for slot, varying, links, chars in slots_})

    def _decide(self, mark: list[int], own: dict[int, tuple]) -> None:
        total: dict[int, tuple] = {}

        def add(tree):
            parts = [own.get(tree[2], (0, 0, 0)), *(add(c) for c in tree[1])]
            total[tree[2]] = tuple(map(sum, zip(*parts, strict=True)))
            return total[tree[2]]

        most = MOST * add(self.pivot)[0]

        def judge(tree):
            varying, links, chars = total[tree[2]]
            if varying <= most and (mark[tree[2]] < 0 or (chars and links >= LINK_SHARE * chars)):
                self.out.add(tree[2])
                return 0.0
            self.weight[tree[2]] = own.get(tree[2], (0,))[0] + sum(judge(c) for c in tree[1])
            return self.weight[tree[2]]

        judge(self.pivot)

    def aligned(self, page: str) -> Node:
        root = parse(page)
        if self.pivot:
            tree = skeleton([root])
            if tree not in self.known:
                if len(self.known) > 2_000:
                    self.known.clear()
                self.known[tree] = slots(tree, self.pivot)
            place([root], self.known[tree])
        return root

    def text(self, page: str) -> str:
        root = self.aligned(page)
        found = [b for b in blocks(root) if key_of(b) not in self.template]
        return "\n\n".join(b.text for b in main_part(root, found, self.out, self.weight))


def key_of(block: Block) -> str:
    return f"{block.node.slot}:{digest(block.text)}"


def main_part(root: Node, found: list[Block], out: set[int], weight: dict[int, float]) -> list[Block]:
    """The blocks of the article among the varying blocks of an aligned page."""
    own: dict[int, list[Block]] = {}
    for b in found:
        own.setdefault(id(b.node), []).append(b)

    def local(node) -> float:
        node.weight = sum(len(b.text) - b.links for b in own.get(id(node), ())) + sum(local(c) for c in node.elements())
        return node.weight

    most = MOST * local(root)
    gone: set[int] = set()

    def judge(node) -> float:
        """Takes out what the host's slots say; for elements that have none, their own marks and links."""
        chars = sum(len(b.text) for b in own.get(id(node), ()))
        if node.slot in out or (node.slot < 0 and node.mark < 0 and node.weight <= most):
            gone.add(id(node))
            node.weight = 0.0
            return 0.0
        left = chars - sum(b.links for b in own.get(id(node), ()))
        node.weight = left + sum(judge(c) for c in node.elements())
        return node.weight

    judge(root)

    def shares(node) -> list[tuple[float, Node]]:
        """What each child holds: the host's mean at its slot, dealt among the slot's elements on this page."""
        children = [c for c in node.elements() if id(c) not in gone]
        here: dict[int, float] = {}
        for c in children:
            here[c.slot] = here.get(c.slot, 0.0) + c.weight
        return [(weight[c.slot] * c.weight / here[c.slot] if c.slot in weight and here[c.slot] else c.weight if c.slot < 0 else 0.0, c) for c in children]

    def articles(node) -> list[Node]:
        if id(node) in gone:
            return []
        return [node] if node.mark > 0 else [a for c in node.elements() for a in articles(c)]

    tops = articles(root)
    if not tops or sum(t.weight for t in tops) < MOST * root.weight:
        node = root
        while True:
            held = shares(node)
            total = sum(w for w, _ in held) + sum(len(b.text) - b.links for b in own.get(id(node), ()))
            best = max(held, key=lambda x: x[0], default=(0.0, None))
            if best[1] is None or best[0] < MAIN_SHARE * total or not any(c.tag in BLOCK and c.weight for c in best[1].elements()):
                break
            node = best[1]
        tops = [node]
    inside: set[int] = set()

    def enter(node):
        if id(node) not in gone:
            inside.add(id(node))
            for c in node.elements():
                enter(c)

    for t in tops:
        enter(t)
    return [b for b in found if id(b.node) in inside]


def _tuples(x: list) -> tuple:
    return (x[0], tuple(_tuples(c) for c in x[1]), x[2])


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) & 0x7FFF_FFFF_FFFF_FFFF


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host.alias("host"))


def _small(df: DataFrame, bytes_: int) -> DataFrame:
    """Marked for broadcast where its measured size is within the bound."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= bytes_ else df


def grouped(pages: DataFrame) -> DataFrame:
    """pages with `host` replaced by the page's shape, the elements it is made of, where the host has fewer than OWN_PAGES pages."""
    few = stored(pages.groupBy("host").count().where(F.col("count") < OWN_PAGES).select("host", F.lit(True).alias("few")), "few")
    marked = pages.join(_small(few, BROADCAST_BYTES), "host", "left")
    names = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)))
    return marked.withColumn("host", F.when(F.col("few"), F.concat(F.lit("#"), F.array_join(names, " "))).otherwise(F.col("host"))).drop("few")


def induce(pages: DataFrame) -> DataFrame:
    """host, pivot (JSON skeleton), template (slot:digest of constant blocks) and slots (slot, varying, links, chars),
    for columns of with_host()."""
    rank = F.struct(F.xxhash64("id"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = pages.select("host", rank.alias("rank")).groupBy("host").agg(F.min("rank").alias("rank"))
    first = stored(chosen, "pivot-ids")
    rows = pages.withColumn("rank", rank).join(_small(first, BROADCAST_BYTES), ["host", "rank"]).select("host", "html")

    def trees(batches):
        for b in batches:
            yield batch({"host": b.column(0), "pivot": pa.array([json.dumps(skeleton([parse(h)])) for h in b.column(1).to_pylist()], pa.string())})

    pivots = stored(map_arrow(rows, trees, "host string, pivot string").groupBy("host").agg(F.min("pivot").alias("pivot")), "pivots")
    both = pages.select("host", "html").join(_small(pivots, BROADCAST_BYTES), "host", "left")

    def counted(batches):
        for b in batches:
            out = ([], [], [], [], [], [])
            for h, page, pivot in zip(*(b.column(c).to_pylist() for c in ("host", "html", "pivot")), strict=True):
                found = blocks(_wrapper(h, pivot, None, None).aligned(page))
                own = {(x.node.slot, digest(x.text)): (len(x.text), x.links) for x in found} | {(_PAGE, 0): (0, 0)}
                whole = digest("\n".join(x.text for x in found))
                for (slot, text), (chars, links) in own.items():
                    for column, value in zip(out, (h, slot, text, whole, chars, links), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield batch({n: pa.array(x, k) for n, x, k in zip(("host", "slot", "block", "content", "chars", "links"), out, kinds, strict=True)})

    seen = map_arrow(both, counted, "host string, slot int, block long, content long, chars int, links int")
    once = seen.groupBy("host", "slot", "block", "content").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    # Blocks of one text have one length and, but for odd pages, one part in links.
    counts = stored(once.groupBy("host", "slot", "block").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links")), "blocks")
    total = counts.where(F.col("slot") == _PAGE).select("host", F.col("n").alias("total"))
    known = counts.where(F.col("slot") != _PAGE).join(_small(total, BROADCAST_BYTES), "host").withColumn("constant", (F.col("n") >= 2) & (F.col("n") >= TEMPLATE_SHARE * F.col("total")))
    # At most blocks-per-page / TEMPLATE_SHARE blocks pass for a host, and slots are those of one page.
    template = known.where("constant").groupBy("host").agg(F.sort_array(F.collect_list(F.concat_ws(":", "slot", "block"))).alias("template"))
    varying = F.when(F.col("constant"), 0).otherwise(F.col("n") * (F.col("chars") - F.col("links")))
    sums = known.where("slot >= 0").groupBy("host", "slot").agg(F.sum(varying).alias("varying"), F.sum(F.col("n") * F.col("links")).alias("links"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    per_host = sums.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "varying", "links", "chars"))).alias("slots"))
    return pivots.join(template, "host", "left").join(per_host, "host", "left")


def _wrapper(host: str, pivot: str | None, template: list[str] | None, slots_: list[dict] | None) -> Wrapper:
    rows = None if slots_ is None else tuple(tuple(x.values()) for x in slots_)
    key = (host, pivot, None if template is None else tuple(template), rows)
    if key not in _WORKER:
        if len(_WORKER) > 500:
            _WORKER.clear()
        _WORKER[key] = Wrapper(pivot, template, list(rows or ()))
    return _WORKER[key]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars (code points). A null page is empty; no text gives "" and 0.

    A page of which nothing varies has no text. Pages without a host of their own (null or relative urls)
    share the empty host. Where a wrapper knows one content only, all of it counts as varying. Repeated
    rows stay apart; an empty table gives no rows; other columns are not read.
    """
    rows = grouped(with_host(pages, id_col, url_col, html_col))
    wrappers = stored(induce(rows), "wrappers")
    both = rows.join(_small(wrappers, BROADCAST_BYTES), "host", "left")

    def run(batches):
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("host", "html", "pivot", "template", "slots"))
            out = [_wrapper(h, p, t, s).text(page) for h, page, p, t, s in zip(*columns, strict=True)]
            yield batch({id_col: b.column("id"), url_col: b.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    kind = pages.schema[id_col].dataType.simpleString()
    return map_arrow(both, run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text and n_chars, as extract() says."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
