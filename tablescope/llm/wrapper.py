"""Main text of web pages by wrapper induction over the pages of a host.

1. Each page becomes a DOM tree, and a skeleton of it: block elements only, menus, headers and footers included, equal
   siblings as one node.
2. The commonest skeleton of a host is its reference. Every other skeleton is aligned with it by simple tree matching,
   which gives the nodes of all pages common places (slots). As siblings differ in their labels, a match of two lists
   of children is an increasing sequence, and aligning takes time in proportion to the trees (but for a logarithm).
3. What most pages of a host hold alike in a slot is constant and becomes template; a slot that holds mostly link text
   is a menu. Both are counted over all pages.
4. The text of a page is what varies. Slots that the wrapper leaves open are looked at once more: an element whose name
   says that it is, say, an advert or a form goes, unless it holds most of the text that is left on the host's pages.

Counts are combined in each task, and a host's wrapper is one row of bounded size, so a host may hold any share of the
pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import materialize, ship_by_value

#: Share of a host's pages that makes a block template, and pages a host must have for that.
TEMPLATE_SHARE = 0.5
LEAST_PAGES = 5
#: Share of a slot's texts that must be such blocks: else the slot varies and all of it is content.
CONSTANT_SHARE = 0.8
#: Share of link text that makes a slot a menu.
LINK_SHARE = 0.5
#: Counts that a task holds back to combine equal ones.
COMBINED_ROWS = 1 << 19

# fixed values of the HTML standard: elements without an end, elements whose content is not markup, elements inside text
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main nav ol p pre section table ul".split()
)
# an element that ends an open one of the same set by itself
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_BARRIER = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("select",), "p": ()}
#: Elements without text of their own, elements that are seldom content, and words in names that say so.
_SILENT = frozenset("script style noscript iframe button select input textarea head template svg math object title".split())
_ROLES = frozenset("header form dialog menu".split())
_ASIDE = frozenset("nav footer aside".split())
_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside widget ad ads advert advertisement adverts "
    "banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe signup login share sharing social breadcrumb breadcrumbs pagination pager related recommended "
    "toolbar skip contentinfo complementary search copyright legal disclaimer".split()
)
_REMARKS = frozenset("comment comments reply replies respond discussion disqus disqus_thread".split())
#: Words beside which one of the above means something else, as in "no-sidebar" or "ad-free".
_NOT = frozenset("no non not has with without free less".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = ("article", "main")
#: Share of the open text from which an element stays whatever its name, and that makes an article the main text.
MOST_TEXT = 0.5
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")

#: What a name says: nothing, that the element is seldom content, that it never is.
_NONE, _SELDOM, _NEVER = 0, 1, 2


def _role_of(word: str) -> int:
    """What a whole name or a part of it says."""
    if word in _REMARKS:
        return _NEVER
    return _SELDOM if word in _WORDS else _NONE


def _role_of_class(name: str) -> int:
    if whole := _role_of(name):
        return whole
    parts = [p for p in _SPLIT.split(name) if p]
    if not parts or _NOT & set(parts):
        return _NONE
    return max(_role_of(parts[0]), _role_of(parts[-1]))


class Node:
    """An element: its name, the label that alignment compares, what its names say, and what it holds."""

    __slots__ = ("children", "label", "link", "main", "parent", "role", "silent", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.main = tag in _MAIN or (parent is not None and parent.main)
        self.silent = tag in _SILENT
        self.role = _NEVER if tag in _ASIDE else _SELDOM if tag in _ROLES else _NONE
        first = ""
        # an article is content even if its class says, e.g., "article-header"; a body class describes the page
        named = tag not in ("html", "body", *_MAIN, *_HEADINGS)
        for name, *values in _NAMED.findall(attributes) if attributes else ():
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "hidden":
                self.silent = True
            elif name == "style":
                self.silent = self.silent or bool(_UNSEEN.search(value))
            elif name == "class" and value.split():
                first = first or _DIGITS.sub("", value.split()[0])
                if named:
                    self.role = max([self.role, *map(_role_of_class, value.split())])
            elif named and name == "role":
                self.role = max(self.role, _role_of(value))
            elif named and name == "id" and tag != "section" and not self.main:
                # ids name what an article's parts are about; outside they name parts of the page
                self.role = max(self.role, _role_of(value))
            elif named and name == "id" and _role_of(value) == _NEVER:
                self.role = _NEVER
        self.label = f"{tag}.{first}" if first else tag
        self.link = tag == "a" or (parent is not None and parent.link)


def parse(page: str) -> Node:
    """The tree of a page. Elements that the page does not close end where the standard ends them."""
    root = Node("html", None)
    at, position = root, 0
    while True:
        found = _TAG.search(page, position)
        if found is None:
            if position < len(page):
                at.children.append(page[position:])
            return root
        if found.start() > position:
            at.children.append(page[position : found.start()])
        position = found.end()
        tag = found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(2):
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
            continue
        if tag in ("html", "body"):
            if tag == "html":
                continue
            while at is not root:
                at = at.parent
        if tag in _ENDS_P or tag in _SIBLINGS:
            ends = _SIBLINGS.get(tag, ("p",)) if tag in _SIBLINGS else ("p",)
            barrier = _BARRIER.get(tag, ())
            node = at
            while node is not root and node.tag not in barrier:
                if node.tag in ends:
                    at = node.parent
                elif tag in _ENDS_P and node.tag not in _INLINE:
                    break
                node = node.parent
        child = Node(tag, at, found.group(4))
        at.children.append(child)
        if tag in _VOID or found.group(4).endswith("/") and tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, position)
            position = end.end() if end else len(page)
            continue
        at = child


class Block:
    """A block of text: its node in the skeleton, characters of links, whether an article holds it, and the named
    elements around it."""

    __slots__ = ("links", "main", "named", "node", "slot", "text")

    def __init__(self, node: int, text: str, links: int, main: bool, named: tuple[int, ...]):
        self.node, self.text, self.links, self.main, self.named = node, text, links, main, named
        self.slot: int | None = None


class Page:
    """Blocks of text of a page, each with the number of its node in the skeleton, and the skeleton as a string.

    ``roles``: what the names of elements say that are seldom content, by their number.
    """

    def __init__(self, page: str):
        self.skeleton: list = ["html", {}, 0]
        self.count = 1
        self.blocks: list[Block] = []
        self.roles: list[int] = []
        self._open: list[str] = []
        self._links = 0
        self._walk(parse(page))
        # nodes are numbered from the front once siblings are merged
        numbers: dict[int, int] = {}
        self.text = self._name(numbers)
        for block in self.blocks:
            block.node = numbers[block.node]

    def _end(self, place: list, main: bool, named: tuple[int, ...]) -> None:
        text = " ".join(html.unescape("".join(self._open)).split())
        if text:
            self.blocks.append(Block(place[2], text, self._links, main, named))
        self._open, self._links = [], 0

    def _walk(self, root: Node) -> None:
        # open elements, the innermost last: children to come, the element, its place, and the named ones around it
        under = [(iter(root.children), root, self.skeleton, ())]
        while under:
            children, node, place, named = under[-1]
            for child in children:
                if isinstance(child, str):
                    self._open.append(child)
                    if node.link:
                        self._links += len(child)
                elif child.silent:
                    if child.tag not in _INLINE:
                        self._end(place, node.main, named)
                elif child.tag in _INLINE and not child.role:
                    if child.tag in ("br", "img"):
                        self._open.append(" ")
                    under.append((iter(child.children), child, place, named))
                    break
                else:
                    self._end(place, node.main, named)
                    inside = place[1].get(child.label)
                    if inside is None:
                        inside = place[1][child.label] = [child.label, {}, self.count]
                        self.count += 1
                    around = named
                    if child.role:
                        around = (*named, len(self.roles))
                        self.roles.append(child.role)
                    under.append((iter(child.children), child, inside, around))
                    break
            else:
                under.pop()
                if node.tag not in _INLINE or node.role:
                    self._end(place, node.main, named)

    def _name(self, numbers: dict[int, int]) -> str:
        parts, rest = [], [self.skeleton]
        while rest:
            place = rest.pop()
            if place is None:
                parts.append(")")
                continue
            numbers[place[2]] = len(numbers)
            parts.append(f"{place[0].replace('(', '').replace(')', '')}(")
            rest.append(None)
            rest.extend(reversed(place[1].values()))
        return "".join(parts)


def _tree(skeleton: str) -> list:
    """[label, children, number] from a skeleton's string."""
    stack: list[list] = [["", []]]
    number = 0
    for label, mark in re.findall(r"([^()]*)([()])", skeleton):
        if mark == "(":
            node = [label, [], number]
            number += 1
            stack[-1][1].append(node)
            stack.append(node)
        else:
            stack.pop()
    return stack[0][1][0]


def _best_chain(pairs: list[tuple[int, int, int]]) -> list[int]:
    """Of pairs (place in one list, place in the other, weight), ordered by the first place, the heaviest choice in which
    both places ascend; each place occurs once."""
    most = max((j for _, j, _ in pairs), default=0) + 2
    tree: list[tuple[int, int]] = [(0, -1)] * (most + 1)  # a Fenwick tree of the best chain that ends before a place
    before = []
    for k, (_, j, weight) in enumerate(pairs):
        best, at = (0, -1), j
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        before.append(best[1])
        chain, at = (best[0] + weight, k), j + 1
        while at <= most:
            if chain > tree[at]:
                tree[at] = chain
            at += at & -at
    best, at = (0, -1), most
    while at > 0:
        best = max(best, tree[at])
        at -= at & -at
    chosen, k = [], best[1]
    while k >= 0:
        chosen.append(k)
        k = before[k]
    return chosen[::-1]


def _match(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching: the pairs of the largest order-keeping match of two trees with equal roots."""
    if a[0] != b[0]:
        return []
    # pairs of nodes with equal labels and matched parents, parents first; their children's pairs are weighed behind them
    pairs, below = [(a, b)], []
    for x, y in pairs:
        places = {child[0]: j for j, child in enumerate(y[1])}
        own = []
        for i, child in enumerate(x[1]):
            j = places.get(child[0])
            if j is not None:
                own.append((i, j, len(pairs)))
                pairs.append((child, y[1][j]))
        below.append(own)
    weight, chains = [1] * len(pairs), [[]] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        if below[k]:
            chosen = _best_chain([(i, j, weight[n]) for i, j, n in below[k]])
            chains[k] = [below[k][c][2] for c in chosen]
            weight[k] += sum(weight[n] for n in chains[k])
    found, rest = [], [0]
    while rest:
        k = rest.pop()
        found.append((pairs[k][0][2], pairs[k][1][2]))
        rest += chains[k]
    return found


def align(skeleton: str, reference: str) -> dict[int, int]:
    """The reference's node for each node of a skeleton that has one."""
    if skeleton == reference:
        return {k: k for k in range(skeleton.count("("))}
    return dict(_match(_tree(skeleton), _tree(reference)))


class Aligner:
    """``align`` with a memory of the last skeletons, for one task."""

    def __init__(self, most: int = 10_000):
        self.most, self.known = most, {}

    def __call__(self, skeleton: str, reference: str) -> dict[int, int]:
        key = skeleton, reference
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = align(skeleton, reference)
        return self.known[key]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _counts(pages: DataFrame) -> DataFrame:
    """``host, kind, node, hash, n, chars, links, skeleton``: per host, kind (hash of the skeleton), node and text the
    pages that hold it; a row of node -1 counts the pages of a skeleton and alone has it as a string, which is as long
    as a page is deep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict) -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["host", "kind", "node", "hash", "skeleton", "n", "chars", "links"],
            )

        held: dict = {}
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(text or "")
                seen, kind = {}, _hash(page.text)
                for block in page.blocks:
                    key = (host, kind, block.node, _hash(block.text), None)
                    n, chars, linked = seen.get(key, (1, 0, 0))
                    seen[key] = (1, chars + len(block.text), linked + min(block.links, len(block.text)))
                seen[host, kind, -1, 0, page.text] = (1, 0, 0)
                for key, new in seen.items():
                    old = held.get(key, (0, 0, 0))
                    held[key] = tuple(a + b for a, b in zip(old, new, strict=True))
            if len(held) > COMBINED_ROWS:
                yield out(held)
                held = {}
        yield out(held)

    found = pages.select("host", "html").mapInArrow(
        run, "host string, kind long, node int, hash long, skeleton string, n long, chars long, links long"
    )
    return found.groupBy("host", "kind", "node", "hash", "skeleton").agg(
        *[F.sum(c).alias(c) for c in ("n", "chars", "links")]
    )


def induce(pages: DataFrame) -> DataFrame:
    """``host, reference, template, menus, weights`` of every host: its reference skeleton, the template as (slot, hash of
    the text), the slots of menus, and the characters of all pages in each other slot, template left out (null for a
    host of few pages). ``pages`` has ``host, html``."""
    ship_by_value()
    counts = materialize(_counts(pages))
    skeletons = counts.where(F.col("node") == -1).select("host", "kind", "skeleton", "n")
    references = materialize(
        skeletons.groupBy("host").agg(
            F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference"), F.sum("n").alias("pages")
        )
    )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, kind, node, slot = [], [], [], []
            for h, k, s, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in align(s, r).items():
                    host.append(h)
                    kind.append(k)
                    node.append(a)
                    slot.append(b)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((host, kind, node, slot), kinds, strict=True)],
                ["host", "kind", "node", "slot"],
            )

    slots = materialize(
        skeletons.join(references, "host")
        .select("host", "kind", "skeleton", "reference")
        .mapInArrow(aligned, "host string, kind long, node int, slot int")
    )
    blocks = counts.where(F.col("node") >= 0).join(slots, ["host", "kind", "node"])
    by_text = blocks.groupBy("host", "slot", "hash").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])
    by_text = materialize(by_text.join(references.select("host", "pages"), "host"))
    # a slot has few constant texts: each takes its share of the host's pages
    constant = (F.col("pages") >= LEAST_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    per_slot = by_text.groupBy("host", "slot").agg(
        *[F.sum(c).alias(c) for c in ("n", "chars", "links")],
        F.sum(F.when(constant, F.col("n"))).alias("constant"),
        F.sum(F.when(constant, F.col("chars"))).alias("constant_chars"),
        F.max("pages").alias("pages"),
        F.collect_set(F.when(constant, F.struct("slot", "hash"))).alias("texts"),
    )
    # a common text in a slot that otherwise varies is content
    is_fixed = F.coalesce(F.col("constant") >= CONSTANT_SHARE * F.col("n"), F.lit(False))
    fixed = F.when(is_fixed, F.col("texts"))
    is_menu = F.col("links") > LINK_SHARE * F.col("chars")
    menu = F.when(is_menu, F.col("slot"))
    left = F.col("chars") - F.when(is_fixed, F.col("constant_chars")).otherwise(0)
    weight = F.when(~is_menu & (F.col("pages") >= LEAST_PAGES), F.struct("slot", left.alias("chars")))
    found = per_slot.groupBy("host").agg(
        F.flatten(F.collect_list(fixed)).alias("template"),
        F.collect_set(menu).alias("menus"),
        F.collect_list(weight).alias("weights"),
    )
    return references.select("host", "reference").join(found, "host", "left")


def open_blocks(
    page: Page, reference: str | None, template: set[tuple[int, int]], menus: set[int], aligned=align
) -> list[Block]:
    """The blocks that the host's wrapper leaves: neither template nor in a menu."""
    slots = aligned(page.text, reference) if reference else {}
    kept = []
    for block in page.blocks:
        block.slot = slots.get(block.node)
        if block.slot is None or not (block.slot in menus or (block.slot, _hash(block.text)) in template):
            kept.append(block)
    return kept


def named_out(page: Page, blocks: list[Block], weights: dict[int, int] | None = None) -> list[Block]:
    """The blocks without those of elements that are named as seldom content.

    Such an element stays if it holds most of the open text: by ``weights``, the open characters of the slots of all
    pages of the host, if there are any, else on this page.  What is never content (readers' comments, footers, asides)
    goes if there is any other text.
    """
    other = any(all(page.roles[k] != _NEVER for k in b.named) for b in blocks)
    size: list[dict] = [{} for _ in page.roles]  # of each named element: its slots, or blocks without one, by size
    every: dict = {}
    for n, block in enumerate(blocks):
        if weights is None or block.slot not in weights:
            key, chars = -1 - n, len(block.text) if weights is None else 0
        else:
            key, chars = block.slot, weights[block.slot]
        every[key] = chars
        for k in block.named:
            size[k][key] = chars
    total = sum(every.values()) if weights is None else sum(weights.values())
    gone = [
        other if role == _NEVER else sum(held.values()) < MOST_TEXT * total
        for role, held in zip(page.roles, size, strict=True)
    ]
    return [b for b in blocks if not any(gone[k] for k in b.named)]


def main_text(
    page: str, reference: str | None, template: set[tuple[int, int]], menus: set[int], weights=None, aligned=align
) -> str:
    """The blocks of a page that are content, joined by line ends.

    If articles or main elements hold most of what is left, that is all.
    """
    made = Page(page)
    kept = named_out(made, open_blocks(made, reference, template, menus, aligned), weights)
    inside = [b for b in kept if b.main]
    if sum(len(b.text) for b in inside) >= MOST_TEXT * sum(len(b.text) for b in kept):
        kept = inside
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null html counts as empty and gives the empty text. Pages whose url is null or has no host form a host of their own.
    A host with fewer than ``LEAST_PAGES`` pages has no template; roles and menus still hold. Repeated rows repeat.
    """
    ship_by_value()
    chosen = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host().alias("host"))
    wrappers = materialize(induce(chosen.select("host", "html")))
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            texts = []
            names = ("html", "reference", "template", "menus", "weights")
            rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            for page, reference, template, menus, weights in rows:
                known = {(t["slot"], t["hash"]) for t in template or ()}
                sizes = {w["slot"]: w["chars"] for w in weights} if weights else None
                texts.append(main_text(page or "", reference, known, set(menus or ()), sizes, aligner))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = chosen.join(wrappers, "host", "left").select("page_id", "url", "html", "reference", "template", "menus", "weights")
    return joined.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
