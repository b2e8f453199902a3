"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a small tree of block elements. Some pages of each host are merged into one skeleton: simple tree matching, a
dynamic program over the children of equal nodes, aligns each with what is there, and unmatched nodes join it. All pages are
aligned with their host's skeleton, which gives each block of text a slot; how many different pages of the host hold the same
text in the same slot, and how many have the slot at all, is counted over the whole table. Slots with constant text are the
template, the varying ones content. A marked article is a hint only: in it, more of the pages must agree.
"""

import hashlib
import html as references
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import find_package, map_batches, written

#: Pages that a host's skeleton is merged from; slots are counted over all pages.
SKELETON_PAGES = 6
#: Different pages from which on a text is template, and its share of the host's pages that have the slot: outside and inside a
#: marked article.
CONSTANT = {False: (3, 0.5), True: (3, 0.9)}
#: Characters of skeletons or of template keys that are broadcast at most.
BROADCAST_CHARS = 16_000_000

# Elements and words of class and id attributes that never are main text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "dialog", "object", "audio", "video", "canvas", "menu", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var",
}
HINTS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies share sharing social related recommended newsletter subscribe "
    "subscription signup cookie cookies consent gdpr notice notices alert banner sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager widget widgets popup modal toolbar "
    "login search skip".split()
)
OUTSIDE_HINTS = {"header", "footer", "masthead", "topbar", "copyright"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
#: An opening tag of the first kind ends an open element of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}

Batches = Iterator[pa.RecordBatch]


class Node:
    __slots__ = ("article", "children", "dropped", "label", "parent", "tag", "texts")

    def __init__(self, tag: str, label: str, parent: "Node | None", dropped: bool, article: bool) -> None:
        self.tag, self.label, self.parent, self.dropped, self.article = tag, label, parent, dropped, article
        self.children: list[Node] = []
        self.texts: list[tuple[int, list[str]]] = []  # runs of text, and how many children come before each


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _unwanted(tag: str, attributes: dict[str, str], article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not article):
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    # An article's classes often name its subjects (tag-social): only the first word of each says what it is.
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    words = set(re.findall(r"(?<!\S)[a-z]+" if tag == "article" else r"[a-z]+", names))
    return bool(words & HINTS or (not article and words & OUTSIDE_HINTS) or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true")


def parse(page: str) -> Node:
    """The page's block elements; inline elements are text, scripts and the like are left out."""
    root = Node("", "", None, False, False)
    here = root

    def text(raw: str) -> None:
        if raw:
            if not here.texts or here.texts[-1][0] != len(here.children):
                here.texts.append((len(here.children), []))
            here.texts[-1][1].append(raw)

    position = 0
    while match := _TAG.search(page, position):
        text(page[position : match.start()])
        position = match.end()
        name = match[2]
        if not name:
            continue
        name = name.lower()
        if match[1]:
            if name in INLINE:
                if name in ("td", "th"):
                    text(" ")
                continue
            node = here
            while node.parent is not None and node.tag != name:
                node = node.parent
            if node.parent is not None:
                here = node.parent
            continue
        if name in RAW:
            end = _ENDS[name].search(page, position)
            position = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                text(" " if name != "wbr" else "")
            continue
        attributes = _attributes(match[3]) if match[3].strip(" /") else {}
        if name in INLINE:
            if name in ("td", "th"):
                text(" ")
            if attributes and _unwanted(name, attributes, here.article) and match[3][-1:] != "/":
                # An unwanted inline element goes with its content, up to its own end tag.
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, position)
                position = end.end() if end else position
            continue
        while here.tag == "p" or here.tag in _CLOSES.get(name, ()):
            here = here.parent
        article = here.article or name == "article" or attributes.get("itemprop") == "articleBody"
        words = " ".join(sorted(set(re.findall(r"[a-z]+", attributes.get("class", "").lower()))))
        node = Node(name, f"{name}.{words}" if words else name, here, here.dropped or _unwanted(name, attributes, here.article), article)
        here.children.append(node)
        here = node
    # A tag that the page's end cuts off is no text.
    text(re.sub(r"<[a-zA-Z/!][^<]*\Z", "", page[position:]))
    return root


# A skeleton is nested lists [label, children, number].
def _known(a: list, b: Node, known: dict[tuple[int, int], int]) -> int | None:
    """The matching of a and b, None if their children have not been matched yet."""
    if a[0] != b.label:
        return 0
    return known.get((id(a), id(b))) if a[1] and b.children else 1


def _ends(a: list, b: Node) -> tuple[int, int]:
    """How many first and last children pair off at once: equal nodes without children, which no other matching can better."""

    def run(ours, theirs) -> int:
        count = 0
        for x, y in zip(ours, theirs):
            if x[0] != y.label or x[1] or y.children:
                break
            count += 1
        return count

    first = run(a[1], b.children)
    rest = min(len(a[1]), len(b.children)) - first
    return first, min(rest, run(reversed(a[1]), reversed(b.children)))


def _score(a: list, b: Node, known: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the most pairs of equal nodes in order, parents with parents. Pages may be nested to any depth."""
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if _known(x, y, known) is not None:
            stack.pop()
            continue
        first, last = _ends(x, y)
        left, right = x[1][first : len(x[1]) - last], y.children[first : len(y.children) - last]
        scores = [[_known(c, d, known) for d in right] for c in left]
        missing = [(c, d) for c, own in zip(left, scores) for d, score in zip(right, own) if score is None]
        if missing:
            stack += missing
            continue
        row = [0] * (len(right) + 1)
        for own in scores:
            new = [0]
            for j, score in enumerate(own):
                new.append(max(row[j] + score, row[j + 1], new[j]))
            row = new
        known[(id(x), id(y))] = row[-1] + first + last + 1
        stack.pop()
    return _known(a, b, known)


def _pairs(a: list, b: Node, known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Children of a and b that a best matching pairs."""
    first, last = _ends(a, b)
    left, right = a[1][first : len(a[1]) - last], b.children[first : len(b.children) - last]
    n, m = len(left), len(right)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    scores = [[_score(x, y, known) for y in right] for x in left]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            table[i][j] = max(table[i + 1][j + 1] + scores[i][j], table[i + 1][j], table[i][j + 1])
    out, i, j = [(k, k) for k in range(first)], 0, 0
    while i < n and j < m:
        if scores[i][j] and table[i][j] == table[i + 1][j + 1] + scores[i][j]:
            out.append((first + i, first + j))
            i, j = i + 1, j + 1
        elif table[i][j] == table[i + 1][j]:
            i += 1
        else:
            j += 1
    return out + [(len(a[1]) - k, len(b.children) - k) for k in range(last, 0, -1)]


def align(skeleton: list, node: Node, known: dict | None = None) -> dict[int, int]:
    """Numbers of skeleton nodes by ``id`` of the page's nodes."""
    known = {} if known is None else known
    out, stack = {id(node): skeleton[2]}, [(skeleton, node)]
    while stack:
        a, b = stack.pop()
        for i, j in _pairs(a, b, known) if a[1] and b.children else ():
            out[id(b.children[j])] = a[1][i][2]
            stack.append((a[1][i], b.children[j]))
    return out


def _copy(node: Node) -> list:
    out = [node.label, [], 0]
    stack = [(node, out)]
    while stack:
        source, copy = stack.pop()
        copy[1] = [[c.label, [], 0] for c in source.children]
        stack += zip(source.children, copy[1])
    return out


def merge(skeleton: list, node: Node) -> None:
    """Put the page's unmatched nodes into the skeleton, in their order."""
    known: dict[tuple[int, int], int] = {}
    stack = [(skeleton, node)]
    while stack:
        a, b = stack.pop()
        pairs = dict((j, i) for i, j in _pairs(a, b, known))
        stack += [(a[1][i], b.children[j]) for j, i in pairs.items()]
        merged, taken = [], 0
        for j, child in enumerate(b.children):
            if j in pairs:
                merged += a[1][taken : pairs[j] + 1]
                taken = pairs[j] + 1
            else:
                merged.append(_copy(child))
        a[1] = merged + a[1][taken:]


def number(skeleton: list) -> list:
    stack, n = [skeleton], 0
    while stack:
        node = stack.pop()
        node[2], n = n, n + 1
        stack += reversed(node[1])
    return skeleton


def flat(skeleton: list) -> str:
    """The skeleton's nodes in the order of their numbers, as depths and labels."""
    out, stack = [], [(skeleton, 0)]
    while stack:
        node, depth = stack.pop()
        out.append([depth, node[0]])
        stack += ((child, depth + 1) for child in reversed(node[1]))
    return json.dumps(out, separators=(",", ":"))


def unflat(text: str) -> list:
    path: list[list] = []
    for number_, (depth, label) in enumerate(json.loads(text)):
        node = [label, [], number_]
        del path[depth:]
        if path:
            path[-1][1].append(node)
        path.append(node)
    return path[0]


def blocks(root: Node, slots: dict[int, int]) -> list[tuple[str, str, bool]]:
    """``(slot, text, in article)`` of the blocks that may be content, in page order."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[Node, str, dict[int, list[str]], int]] = [(root, "0", dict(root.texts), 0)]
    while stack:
        node, slot, runs, k = stack.pop()
        if k in runs:
            words = " ".join(references.unescape("".join(runs[k])).split())
            if words:
                out.append((f"{slot}:{k}", words, node.article))
        if k == len(node.children):
            continue
        stack.append((node, slot, runs, k + 1))
        child = node.children[k]
        if not child.dropped:
            own = str(slots[id(child)]) if id(child) in slots else f"{slot}/{child.label}"
            # Far from the skeleton a path's digest stands for it, so that deep pages stay small.
            own = own if len(own) <= 200 else "#" + hashlib.blake2b(own.encode(), digest_size=16).hexdigest()
            stack.append((child, own, dict(child.texts), 0))
    return out


def _skeletons(pages: pd.DataFrame) -> pd.DataFrame:
    trees = [parse(page) for page in pages.sort_values("page_id")["html"]]
    skeleton = ["", [], 0]
    for tree in trees:
        merge(skeleton, tree)
    return pd.DataFrame({"host": [pages["host"].iloc[0]], "skeleton": [flat(number(skeleton))]})


def _slot(slot: str) -> int:
    return int.from_bytes(hashlib.blake2b(slot.encode(), digest_size=4).digest(), "little", signed=True)


def _key(slot: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{slot}|{text}".encode(), digest_size=8).digest(), "little", signed=True)


def _blocked(batches: Batches) -> Batches:
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("key", pa.int64()), ("text", pa.string()), ("article", pa.bool_())]))
    held: dict[str, list] = {}
    for batch in batches:
        found, digests = [], []
        for page, skeleton in zip(batch.column("html"), batch.column("skeleton").to_pylist()):
            root = parse(page.as_py() or "")
            if skeleton is not None and skeleton not in held:
                if len(held) > 500:
                    held.clear()
                held[skeleton] = unflat(skeleton)
            slots = align(held[skeleton], root) if skeleton is not None else {}
            own = blocks(root, slots)
            found.append([{"slot": _slot(slot), "key": _key(slot, text), "text": text, "article": article} for slot, text, article in own])
            digests.append(_key("", "\n".join(b[1] for b in own)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(found, kind), pa.array(digests, pa.int64())], ["page_id", "url", "host", "blocks", "digest"])


def _joined(pages: DataFrame, facts: DataFrame, chars: int) -> DataFrame:
    return pages.join(F.broadcast(facts) if chars <= BROADCAST_CHARS else facts, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``, a row for each row of ``pages (page_id, url, html, ...)``; an empty text where there is none.

    Hosts are those of the urls; pages without a url are one host. A host with few pages has no template, and its pages' marks
    alone decide. Equal pages count once, so copies of a page make no template.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    some = rows.where("html IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("page_id"), "page_id"))).where(F.col("k") <= SKELETON_PAGES)
    find_package(pages.sparkSession)
    skeletons = written(some.groupBy("host").applyInPandas(_skeletons, "host string, skeleton string"), "skeletons")
    chars = skeletons.agg(F.sum(F.length("skeleton"))).first()[0] or 0
    kind = "page_id long, url string, host string, blocks array<struct<slot: int, key: long, text: string, article: boolean>>, digest long"
    cut = written(map_batches(_joined(rows, skeletons, chars), _blocked, kind), "blocks")
    held = cut.select("host", "digest", F.explode("blocks").alias("b")).select("host", "digest", "b.slot", "b.key", "b.article").distinct()
    (least, share), (least_in, share_in) = CONSTANT[False], CONSTANT[True]
    counts = held.groupBy("host", "slot", "key", "article").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("article"), least_in).otherwise(least))
    totals = held.select("host", "slot", "digest").distinct().groupBy("host", "slot").agg(F.count("*").alias("total"))
    constant = F.col("n") >= F.when(F.col("article"), share_in).otherwise(share) * F.col("total")
    template = counts.join(totals, ["host", "slot"]).where(constant).groupBy("host").agg(F.collect_set("key").alias("template"))
    template = written(template, "template")
    chars = 8 * (template.agg(F.sum(F.size("template"))).first()[0] or 0)
    kept = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.array_contains("template", b["key"]))
    return _joined(cut, template, chars).select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
