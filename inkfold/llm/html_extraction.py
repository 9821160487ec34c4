"""HTML extraction by wrapper inference.

A page is a stream of block tags and text slots. Runs of like siblings are folded into repeated groups. The distinct
streams of a host are then aligned one after another into its wrapper, a union-free regular expression: what both have is
merged, what only one has becomes optional, and texts become slots that are constant or vary. A page's stream is aligned
with its host's wrapper once more to tell which of its slots are the article's.

Only streams and wrappers meet by host. They are small, and wrappers are made by merging streams as they come: first of
each of `PARTS` parts of a host's streams, then of the parts, so that no task reads all streams of a host. The texts are
dealt out by host and stream, and a large host's rows can be split. All walks over trees are loops: depth has no limit.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, partitions, slices, texts_of, tune

# The elements of HTML that begin a block, that have no end tag, and whose content isn't markup.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose content is dropped without ending a block: scripts' stand-ins and controls of forms. Without an end tag they hold nothing.
SKIPPED = frozenset("noscript template button select".split())
# Choices: the blocks, roles and names whose content isn't article text.
OUTSIDE = frozenset("nav header footer aside form head dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing social related recommended "
    "widget pagination pager toolbar login search".split()
)
#: Words that a name may have beside those: `site-footer` and `ad-box` name what `footer` and `ad` do; `related-work` doesn't.
HOLDERS = frozenset("site page main global top bottom left right inner outer primary secondary box bar block wrap wrapper container content area section list item items link links button buttons icons panel row col column unit slot zone form policy post posts articles stories media js".split())
#: Names that an article's own head may have.
HEADS = frozenset({"header", "banner", "masthead"})
#: What an open element of the first kind is closed by, up to the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Parts of a host's streams that are merged apart before they meet.
PARTS = 64
#: Lists of siblings with more pairs than this are halved to be aligned; both ways find a longest common subsequence.
COMPARED = 40_000
#: Percent of a host's pages that have a slot with one text, from which it is the host's, and from how many different pages.
NEARLY_ALL = 90
EVIDENCE = 5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(>?)")
#: The end of a tag, or its next attribute. A quote that never closes isn't one; only a page's last can be such.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=>)))?+)""")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = frozenset({"class", "id", "role", "itemprop", "hidden"})
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element, a group of elements or, without children, a text slot `#`."""

    __slots__ = ("label", "children", "repeated", "optional", "into", "low", "high", "pages")

    def __init__(self, label: str, children: list[Node] | None = None, low: int = 0, high: int = 0):
        self.label, self.children, self.low, self.high = label, children if children is not None else [], low, high
        self.repeated = self.optional = False
        self.into: Node | None = None
        self.pages = 0

    def found(self) -> Node:
        node = self
        while node.into:
            node = node.into
        return node


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that matter of a tag whose name ends at `at`, and where the tag ends; -1: nowhere. Each place is read once."""
    values: dict[str, str] = {}
    while m := _ATTRIBUTE.match(text, at):
        at = m.end()
        if m[1]:
            return values, at
        name = m[2].lower()
        if name in _NAMED:
            values.setdefault(name, m[3] or m[4] or m[5] or "")
    return values, -1


def _names(values: dict[str, str]) -> set[str]:
    """The words of those classes and ids that are names as a whole, or names with words that say where or in what."""
    found: set[str] = set()
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts <= NAMES | HOLDERS:
            found |= parts & NAMES
    return found


def _label(tag: str, values: dict[str, str]) -> str:
    """A block's tag and class; `!` marks what isn't article text, `?` what isn't unless it's in an article, `*` an article's body."""
    if not values and tag not in OUTSIDE:
        return tag
    named = _names(values)
    role = values.get("role", "").lower()
    mark = ""
    if tag in ("header",) or role == "banner" or named & HEADS:
        mark = "?"
    if tag in OUTSIDE - {"header"} or role in ROLES - {"banner"} or named & (NAMES - HEADS) or "hidden" in values:
        mark = "!"
    if tag in ("article", "main", "body", "html"):
        mark = "!" if tag == "article" and named & {"comment", "comments", "reply"} else ""
    if not mark and (role in ("main", "article") or values.get("itemprop") == "articleBody"):
        mark = "*"
    return f"{tag}.{re.sub(r'\\d+', '0', values.get('class', '').strip())}{mark}" if values.get("class") or mark else tag


_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW | SKIPPED}


class _Open:
    """The open elements of a page, with the places of each name, so that finding one takes no walk."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("", root)]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: Node) -> None:
        self.stack[-1][1].children.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node))

    def _nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names, until=()) -> None:
        """Close the nearest element of one of the names, and all in it, unless one of `until` is nearer."""
        at = self._nearest(names)
        if at and at > self._nearest(until):
            for tag, _ in self.stack[at:]:
                self.places[tag].pop()
            del self.stack[at:]

    def close_paragraph(self) -> None:
        """A paragraph that no other block is in ends before a block. Blocks alone are held, so it's the last."""
        if self.stack[-1][0] == "p":
            self.close({"p"})


def parse(text: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page's blocks, and its texts in order, each with its slot. Time is in proportion to the page."""
    root = Node("")
    opened = _Open(root)
    texts: list[tuple[Node, str]] = []
    held: list[str] = []
    endless: set[str] = set()

    def flush() -> None:
        words = "".join(held).split()
        held.clear()
        if words:
            block = " ".join(words)
            hashed = xxhash.xxh64_intdigest(block) >> 1
            slot = Node("#", None, hashed, hashed)
            opened.stack[-1][1].children.append(slot)
            texts.append((slot, block))

    at, size = 0, len(text)
    while at < size:
        begin = text.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            held.append(html.unescape(text[at:begin]))
        if begin == size:
            break
        m = _TAG.match(text, begin)
        if m is None:
            if text.startswith("<!--", begin):
                # An empty comment may be cut short.
                short = next((len(x) for x in ("<!-->", "<!--->") if text.startswith(x, begin)), 0)
                over = _COMMENT_END.search(text, begin + 4)
                at = begin + short if short else over.end() if over else size
            elif text[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = text.find(">", begin) + 1 or size
            else:
                held.append("<")
                at = begin + 1
            continue
        values: dict[str, str] = {}
        at = m.end()
        if not m[3]:
            values, at = _attributes(text, at)
            if at < 0:
                break  # a tag that never ends
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or opened.places.get(tag):
                flush()
                opened.close({tag}, {"article", "main"} if tag == "p" else ())
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            over = _RAW_END[tag].search(text, at)
            closing = text.find(">", over.start()) if over else -1
            at = size if closing < 0 else closing + 1
            continue
        if tag in SKIPPED:
            over = None if tag in endless else _RAW_END[tag].search(text, at)
            closing = text.find(">", over.start()) if over else -1
            if closing < 0:
                endless.add(tag)  # nor will a later one end
            else:
                at = closing + 1
            continue
        if tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            opened.close_paragraph()
            if tag in ENDS:
                opened.close(*ENDS[tag])
            opened.push(tag, Node(_label(tag, values)))
    flush()
    fold(root)
    return root, texts


def merge(a: Node, b: Node) -> None:
    """b's pages, too, now match a."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        b.into = a
        a.repeated |= b.repeated
        a.optional |= b.optional
        a.low, a.high = min(a.low, b.low), max(a.high, b.high)
        a.pages += b.pages
        if b.children:
            a.children, pairs = align(a.children, b.children)
            todo += pairs
        elif a.label != "#":
            for x in a.children:
                x.optional = True


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of a and each prefix of b; a bit of one number for each place of b."""
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    places: dict[str, int] = {}
    for x in set(a) & at.keys():
        bits = np.zeros(len(b), np.uint8)
        bits[at[x]] = 1
        places[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every = row = (1 << len(b)) - 1
    for x in a:
        if x in places:
            hit = row & places[x]
            row = ((row + hit) | (row - hit)) & every
    size = (len(b) + 7) // 8
    ones = np.unpackbits(np.frombuffer(row.to_bytes(size, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - ones.astype(np.int64))])


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Long lists are halved where the lengths of both halves add up to the most."""
    if len(a) * len(b) > COMPARED:
        if len(a) == 1:
            return [(0, b.index(a[0]))] if a[0] in b else []
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _common(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _common(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[Node], b: list[Node]) -> tuple[list[Node], list[tuple[Node, Node]]]:
    """Siblings of two streams, and the pairs of them to merge: what both have; what one has is optional."""
    out: list[Node] = []
    pairs: list[tuple[Node, Node]] = []
    i = j = 0
    for x, y in [*_common([n.label for n in a], [n.label for n in b]), (len(a), len(b))]:
        for node in [*a[i:x], *b[j:y]]:
            node.optional = True
            out.append(node)
        if x < len(a):
            pairs.append((a[x], b[y]))
            out.append(a[x])
        i, j = x + 1, y + 1
    return out, pairs


def fold(root: Node) -> None:
    """Fold siblings that repeat with a period of one, two or three into a repeated element or group, from the leaves up."""
    order = [root]
    for node in order:
        order += [x for x in node.children if x.children]
    for node in reversed(order):
        _fold(node)


def _fold(node: Node) -> None:
    for period in (1, 2, 3):
        out: list[Node] = []
        rest, at = node.children, 0
        while at < len(rest):
            own = rest[at : at + period]
            names = [n.label for n in own]
            to = at + period
            while len(own) == period and [n.label for n in rest[to : to + period]] == names and (period > 1 or names != ["#"]):
                for a, b in zip(own, rest[to : to + period], strict=True):
                    merge(a, b)
                to += period
            if to == at + period:
                out.append(rest[at])
                at += 1
                continue
            first = own[0] if period == 1 else Node(f"({','.join(names)})", own)
            first.repeated = True
            out.append(first)
            at = to
        node.children = out


def _walk(node: Node, into: Callable[[Node], bool] = lambda _: True) -> Iterator[Node]:
    """The nodes below, in page order, but for those below a node that isn't to be gone into."""
    todo = node.children[::-1]
    while todo:
        node = todo.pop()
        yield node
        if node.children and into(node):
            todo += reversed(node.children)


def slots(node: Node) -> list[Node]:
    return [node] if node.label == "#" else [x for x in _walk(node) if x.label == "#"]


def _dump(node: Node) -> list:
    """Label, marks and number of children of each node, parents before children."""
    return [x for n in (node, *_walk(node)) for x in (n.label, int(n.repeated) | int(n.optional) << 1, len(n.children))]


def _load(data: list) -> Node:
    root, todo = Node(""), []
    for at in range(0, len(data), 3):
        node = root if at == 0 else Node("")
        node.label, node.repeated, node.optional = data[at], bool(data[at + 1] & 1), bool(data[at + 1] & 2)
        if at:
            todo[-1][0].children.append(node)
            todo[-1][1] -= 1
        if data[at + 2]:
            todo.append([node, data[at + 2]])
        while todo and not todo[-1][1]:
            todo.pop()
    return root


def dump(node: Node) -> str:
    return json.dumps(_dump(node), ensure_ascii=False, separators=(",", ":"))


def load(text: str, low: list[int], high: list[int], pages: list[int] | None = None) -> Node:
    """pages: how many pages have each slot; without it, none that aren't counted elsewhere."""
    root = _load(json.loads(text))
    own = slots(root)
    for slot, a, b, n in zip(own, low, high, pages or [0] * len(own), strict=True):
        slot.low, slot.high, slot.pages = a, b, n
    return root


def _is_main(node: Node) -> bool:
    return node.label[-1:] not in ("!", "?") and (node.label.split(".")[0].rstrip("*") in ("article", "main") or node.label.endswith("*"))


def _mains(node: Node) -> Iterator[Node]:
    """The outermost articles, or else bodies of text, that nothing marks as something else."""
    return (x for x in _walk(node, lambda x: x.label[-1:] not in ("!", "?") and not _is_main(x)) if _is_main(x))


def _texts(node: Node, inside: bool) -> Iterator[Node]:
    return (x for x in _walk(node, lambda x: x.label[-1] != "!" and (inside or x.label[-1] != "?")) if x.label == "#")


def article_slots(stream: Node, wrapper: Node, pages: int) -> list[int]:
    """Numbers of the stream's slots that are article text, after it's aligned with its host's wrapper.

    That is an article's text or, where a page marks none, what is in no part marked as something else. Aligned nodes have
    equal labels, so these are the same parts of the wrapper. Of them, slots go whose place in the wrapper has one text on
    nearly all of the host's pages, of which five or more differ; a page of which that leaves nothing keeps all. pages are
    those with texts, equal ones counted once.
    """
    own = slots(stream)
    merge(wrapper, stream)
    mains = list(_mains(stream))
    if any(m.label.split(".")[0] == "article" for m in mains):
        mains = [m for m in mains if m.label.split(".")[0] == "article"]
    some = [x for m in mains for x in _texts(m, True)] if mains else list(_texts(stream, False))
    left = [x for x in some if not _constant(x.found(), pages)]
    kept = {id(x) for x in left or some}
    return [i for i, x in enumerate(own) if id(x) in kept]


def _constant(slot: Node, pages: int) -> bool:
    return pages >= EVIDENCE and slot.low == slot.high and 100 * slot.pages >= NEARLY_ALL * pages


_STREAM = "host string, stream bigint, said bigint, tree string, texts array<bigint>"
_STREAM_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))


def _key(tree: str) -> int:
    return xxhash.xxh64_intdigest(tree) - (1 << 63)


def _rows(out: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pages of a batch by host: stream, a hash of all texts, and the least and greatest hash of each slot's texts."""
    for batch in slices(batches, "html"):
        found: dict[tuple[str, int, int], list] = {}
        for host, text in zip(batch.column("host").to_pylist(), texts_of(batch, "html").to_pylist(), strict=True):
            root, texts = parse(text)
            tree = dump(root)
            said = xxhash.xxh64_intdigest("\0".join(block for _, block in texts)) - (1 << 63)
            found.setdefault((host, _key(tree), said), [tree, [x for slot in slots(root) for x in (slot.low, slot.high)]])
        yield _rows([(*k, *v) for k, v in found.items()], ["host", "stream", "said", "tree", "texts"], _STREAM_TYPES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages come by host, part, stream and texts; equal ones are counted once. A row for each stream of each batch."""
    last = None
    for batch in batches:
        found: dict[tuple, list] = {}
        for row in batch.to_pylist():
            page = (row["host"], row["part"], row["stream"], row["said"])
            if page == last:
                continue
            last, low, high = page, np.array(row["texts"][::2], np.int64), np.array(row["texts"][1::2], np.int64)
            held = found.setdefault(page[:3], [row["tree"], low, high, 0])
            held[1:] = [np.minimum(held[1], low), np.maximum(held[2], high), held[3] + 1]
        out = [(host, part, tree, low, high, [n] * len(low), n if len(low) else 0) for (host, part, _), (tree, low, high, n) in found.items()]
        yield _rows(out, ["host", "part", "wrapper", "w_low", "w_high", "w_count", "w_pages"], (pa.string(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64()))


_WRAPPER = "host string, wrapper string, w_low array<bigint>, w_high array<bigint>, w_count array<bigint>, w_pages bigint"


def _merged(key: tuple[str, ...]):
    """Rows come sorted by the key; a key's trees are merged into one as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, host, wrapper, pages = None, None, None, 0

        def done() -> list[tuple]:
            if wrapper is None:
                return []
            own = slots(wrapper)
            return [(host, dump(wrapper), [x.low for x in own], [x.high for x in own], [x.pages for x in own], pages)]

        names, kinds = ["host", "wrapper", "w_low", "w_high", "w_count", "w_pages"], (pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                root, now = load(row["wrapper"], row["w_low"], row["w_high"], row["w_count"]), tuple(row[k] for k in key)
                if now != last or wrapper is None:
                    out += done()
                    last, host, wrapper, pages = now, row["host"], root, row["w_pages"]
                else:
                    merge(wrapper, root)
                    pages += row["w_pages"]
            yield _rows(out, names, kinds)
        yield _rows(done(), names, kinds)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            stream, wrapper = load(x["tree"], x["texts"][::2], x["texts"][1::2]), load(x["wrapper"], x["w_low"], x["w_high"], x["w_count"])
            out.append((x["host"], x["stream"], article_slots(stream, wrapper, x["w_pages"])))
        yield _rows(out, ["host", "stream", "kept"], (pa.string(), pa.int64(), pa.list_(pa.int64())))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        streams, blocks = [], []
        for text in texts_of(batch, "html").to_pylist():
            root, texts = parse(text)
            number = {id(x): i for i, x in enumerate(slots(root))}
            streams.append(_key(dump(root)))
            blocks.append([{"slot": number[id(slot.found())], "text": block} for slot, block in texts])
        kind = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(streams, pa.int64()), pa.array(blocks, kind)], names=["page_id", "url", "host", "stream", "blocks"])


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(streams, wrappers): the distinct pages of each host and the host's wrapper, a union-free expression as JSON."""
    n = partitions(pages.sparkSession)
    # Few rows, used twice: written, so that the pages aren't parsed again for them.
    streams = materialize(_hosted(pages).select("host", "html").mapInArrow(_streams, _STREAM))
    # Equal pages are of one part, so that each is counted once.
    dealt = streams.withColumn("part", F.pmod("said", F.lit(PARTS))).repartition(n, "host", "part").sortWithinPartitions("host", "part", "stream", "said")
    parts = dealt.mapInArrow(_counted, _WRAPPER.replace("host string", "host string, part bigint")).mapInArrow(_merged(("host", "part")), _WRAPPER)
    whole = parts.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merged(("host",)), _WRAPPER)
    return streams, whole


def _hosted(pages: DataFrame) -> DataFrame:
    tune(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars (code points).

    The article's blocks in page order, joined by two line ends; character references are decoded and white space inside
    a block is one space. Null html is an empty page with an empty text. Pages without a host in their url are aligned
    with each other. Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """
    streams, found = wrappers(pages)
    once = streams.dropDuplicates(["host", "stream"])  # texts don't matter for a stream's own alignment
    told = once.join(found, "host").mapInArrow(_told, "host string, stream bigint, kept array<bigint>")
    rows = _hosted(pages).mapInArrow(_blocks, "page_id bigint, url string, host string, stream bigint, blocks array<struct<slot:bigint,text:string>>")
    kept = F.filter("blocks", lambda b: F.array_contains("kept", b["slot"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.join(told, ["host", "stream"]).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
