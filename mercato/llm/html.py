"""Main text of pages by wrapper induction.

Pages of a host are made from few templates. One page per host, and one per
layout of a host that has several, is the reference; every other page's DOM
tree is aligned with it by simple tree matching. Reference nodes whose text comes back on nearly all pages are
template, the rest are slots whose varying text is content. What a page says
about itself (menus, forms, adverts, comments by tag, role or class) is left
out first.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys
from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored
from mercato.llm.urls import split_url

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that do not break a block, that hold no tree, and that have no end tag.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select menu dialog head object audio video canvas map datalist".split())
MAIN = frozenset(["article", "main"])
ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert alertdialog".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
# Words of a class or id that name something beside the article.
ASIDE = frozenset(
    "ad ads adv advert advertisement adbox adslot adsense sponsor sponsored banner promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended recommendations comment comments disqus replies respond pagination pager toolbar "
    "widget hidden skip".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORDS = re.compile(r"[a-z0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")
# Within the article a class may say a lot about its content ("social-science"), so only these words count there, where a name begins with them.
WITHIN = frozenset(
    "ad ads adv advert advertisement adbox adslot adsense sponsor sponsored promo promotion breadcrumb breadcrumbs sidebar cookie cookies "
    "consent gdpr newsletter subscribe signup login share sharing related recommended recommendations comment comments disqus replies "
    "respond pagination pager toolbar".split())
# Elements nested deeper than this have no node of their own.
DEPTH = 150


class Node:
    __slots__ = ("label", "tag", "kids", "text", "aside", "main", "shape")

    def __init__(self, tag: str, label: str = "", text: str = "", aside: bool = False, main: bool = False):
        self.tag, self.label, self.text, self.aside, self.main, self.kids = tag, label or tag, text, aside, main, []
        self.shape = None


def named(attributes: str) -> dict[str, str]:
    found = {}
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        found.setdefault((name or hidden).lower(), a or b or c)
    return found


def beside(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether an element stands beside the article; a header within the article belongs to it.

    Within the article a class or id counts if it is one of the words of
    ``ASIDE`` itself, or begins with one of ``WITHIN``.
    """
    if tag in DROPPED or (tag == "header" and not in_main) or "hidden" in attributes:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag in MAIN or tag in ("body", "html"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    if in_main:
        return any(n in ASIDE or (w := WORDS.match(n)) and w[0] in WITHIN for n in names.split())
    return not ASIDE.isdisjoint(WORDS.findall(names))


def parse(page: str) -> Node:
    """The tree of block elements; runs of text between them are ``#text`` leaves, with white space settled.

    Elements nested deeper than ``DEPTH`` belong to the one at that depth; those
    that stand beside the article are left out there as well.
    """
    root = Node("#root")
    stack, pending, at, size = [root], [], 0, len(page)
    # Deeper elements that are open, by tag; and one that is left out: its tag, and how many of them are open.
    deeper: Counter = Counter()
    left_out, open_ = "", 0

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                stack[-1].kids.append(Node("#text", text=text))
            pending.clear()

    def close(wanted: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in wanted:
                flush()
                del stack[i:]
                return close(wanted, until)
            if stack[i].tag in until or stack[i].tag not in INLINE and stack[i].tag not in ("p", *wanted) and not until:
                return None
        return None

    while at < size:
        token = TOKEN.search(page, at)
        if not token:
            pending.append(page[at:])
            break
        if token.start() > at:
            pending.append(page[at : token.start()])
        at = token.end()
        if token[0].startswith("<![CDATA["):
            pending.append(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        ends, rest = token[1] or token[4], token[3] or token[6] or ""
        if open_:
            pending.clear()
            if tag == left_out and not rest.rstrip().endswith("/"):
                open_ += -1 if ends else 1
            continue
        if ends and deeper[tag]:
            deeper[tag] -= 1
            flush()
            continue
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    del stack[i:]
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            pending.append(" ")
            continue
        attributes = named(rest) if rest.strip("/ \n") else {}
        if tag in MAIN:
            # An unclosed advert or menu does not take the article with it.
            for i in range(1, len(stack)):
                if stack[i].aside and stack[i].tag not in DROPPED:
                    flush()
                    del stack[i:]
                    break
        aside = beside(tag, attributes, any(n.main for n in stack))
        if tag in INLINE and not aside and not any(n.aside for n in stack):
            continue
        if tag not in INLINE:
            close({"p"}, set())
            if tag in CLOSES:
                close(*CLOSES[tag])
            flush()
        elif aside:
            flush()
        main = tag in MAIN or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        node = Node(tag, f"{tag}.{attributes.get('class', '')}", aside=aside, main=main and not aside)
        if tag in VOID:
            stack[-1].kids.append(node)
        elif len(stack) < DEPTH:
            stack[-1].kids.append(node)
            stack.append(node)
        elif aside:
            left_out, open_ = tag, 1
        else:
            deeper[tag] += 1
    flush()
    return root


# ---------------------------------------------------------------- simple tree matching

def shape(node: Node) -> int:
    """A number that trees share when they differ in their texts only."""
    if node.shape is None:
        node.shape = hash((node.label, *map(shape, node.kids)))
    return node.shape


def pair_up(a: Node, b: Node, pairs: list) -> int:
    """Match two trees of one shape, node by node."""
    pairs.append((a, b))
    return 1 + sum(pair_up(x, y, pairs) for x, y in zip(a.kids, b.kids))


def match(a: Node, b: Node, pairs: list | None = None) -> int:
    """Size of the largest matching of two trees that keeps order and ancestors; the matched nodes go to ``pairs``."""
    if a.label != b.label:
        return 0
    found: list = [(a, b)]
    total = 1 + match_lists(a.kids, b.kids, found)
    if pairs is not None:
        pairs.extend(found)
    return total


def match_lists(left: list[Node], right: list[Node], pairs: list) -> int:
    """Order-keeping matching of two lists of trees by dynamic programming.

    Leading and trailing trees of one shape are matched right away: no matching
    is larger for leaving them out.
    """
    total, lo, a, b = 0, 0, len(left), len(right)
    while lo < a and lo < b and shape(left[lo]) == shape(right[lo]):
        total += pair_up(left[lo], right[lo], pairs)
        lo += 1
    while lo < a and lo < b and shape(left[a - 1]) == shape(right[b - 1]):
        a, b = a - 1, b - 1
        total += pair_up(left[a], right[b], pairs)
    left, right = left[lo:a], right[lo:b]
    if not left or not right:
        return total
    inner: dict[tuple[int, int], tuple[int, list]] = {}
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            here = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if x.label == y.label:
                kept: list = []
                weight = match(x, y, kept)
                inner[i, j] = weight, kept
                if above[j] + weight > here:
                    here = above[j] + weight
            row[j + 1] = here
    i, j = len(left), len(right)
    while i and j:
        weight, kept = inner.get((i - 1, j - 1), (0, []))
        if weight and best[i][j] == best[i - 1][j - 1] + weight:
            pairs.extend(kept)
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + best[len(left)][len(right)]


# ---------------------------------------------------------------- content

def leaves(node: Node, only: bool = False) -> Iterator[Node]:
    """Text leaves in page order that do not stand beside the article; with ``only``, those of the article."""
    todo = [(node, not only)]
    while todo:
        node, inside = todo.pop()
        if node.aside:
            continue
        inside = inside or node.main
        if node.tag == "#text":
            if inside:
                yield node
        else:
            todo.extend((kid, inside) for kid in reversed(node.kids))


def body(root: Node) -> list[Node]:
    """The article's leaves, or those of the whole page where it names no article."""
    return list(leaves(root, only=True)) or list(leaves(root))


class Reference:
    """A parsed page whose article's text leaves are named by their places."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.texts = [n.text for n in body(self.root)]
        self.numbers = {id(n): i for i, n in enumerate(body(self.root))}

    def aligned(self, page: Node) -> list[tuple[int, Node]]:
        """``(number of the own leaf, the page's leaf)`` for matched leaves."""
        pairs: list = []
        match(self.root, page, pairs)
        return [(self.numbers[id(x)], y) for x, y in pairs if id(x) in self.numbers]


class References:
    """Parsed reference pages of the last hosts seen."""

    def __init__(self, size: int = 64):
        self.size, self.kept = size, OrderedDict()

    def get(self, host: str, page: str) -> Reference:
        if host not in self.kept:
            self.kept[host] = Reference(page)
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        self.kept.move_to_end(host)
        return self.kept[host]


def alike(a: str, b: str) -> bool:
    """Whether half of the words of two texts are the same; numbers are no words."""
    x, y = Counter(LETTERS.findall(a)), Counter(LETTERS.findall(b))
    return 2 * (x & y).total() >= max(x.total(), y.total())


def copied(reference: Reference, found: list[tuple[int, Node]], page: Node) -> bool:
    """Whether a page says nothing of its own: all its leaves are matched with alike ones, and all of the reference's."""
    if not all(n.text == reference.texts[i] or alike(n.text, reference.texts[i]) for i, n in found):
        return False
    own, other = {i for i, _ in found}, {id(n) for _, n in found}
    rest = [t for i, t in enumerate(reference.texts) if i not in own] + [n.text for n in body(page) if id(n) not in other]
    return not any(map(LETTERS.search, rest))


def words_mark(root: Node) -> int:
    """A number that pages with equal words share; numbers are no words."""
    words = " ".join(LETTERS.findall(" ".join(n.text for n in body(root))))
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def constant_counter(least: int):
    """``(host, leaf, pages, same, marks)``: pages with that slot, those with the reference's text in it, marks of the former.

    Copies of the reference tell nothing about the template. They are known by
    what differs, never by how much is equal. The least ``least`` marks tell
    whether there are so many pages that are no copies of each other.
    """

    def count_constant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        for batch in batches:
            pages, same, marks = Counter(), Counter(), {}
            for host, page, model in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference"))):
                reference, root = references.get(host, model), parse(page)
                found = reference.aligned(root)
                if copied(reference, found, root):
                    continue
                pages.update((host, i) for i, _ in found)
                same.update((host, i) for i, n in found if n.text == reference.texts[i])
                mark = words_mark(root)
                for i, _ in found:
                    marks[host, i] = sorted({mark, *marks.get((host, i), ())})[:least]
            keys = list(pages)
            yield pa.RecordBatch.from_arrays([
                pa.array([h for h, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int32()),
                pa.array([pages[k] for k in keys], pa.int64()), pa.array([same[k] for k in keys], pa.int64()),
                pa.array([marks[k] for k in keys], pa.list_(pa.int64())),
            ], ["host", "leaf", "pages", "same", "marks"])

    return count_constant


def main_text(page: str | None, *known: tuple[Reference, frozenset[int]]) -> str:
    """Text of a page; leaves that match a template of its host or layout go, unless nothing would be left."""
    root = parse(page or "")
    kept = body(root)
    gone = {id(n) for reference, template in known for i, n in reference.aligned(root) if i in template and n.text == reference.texts[i]}
    return " ".join(n.text for n in [n for n in kept if id(n) not in gone] or kept)


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    references = {kind: References() for kind in KINDS}
    for batch in batches:
        texts = []
        models = [batch.column(c).to_pylist() for kind in KINDS for c in (kind, f"{kind}_reference", f"{kind}_template")]
        for page, *row in zip(batch.column("html").to_pylist(), *models):
            parts = zip(KINDS, row[::3], row[1::3], row[2::3])
            known = [(references[kind].get(name, model), frozenset(template)) for kind, name, model, template in parts if model is not None]
            texts.append(main_text(page, *known))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["id", "url", "text", "n_chars"])


def layout(root: Node) -> int | None:
    """A number that pages of one layout share; None for a page without text.

    It names the elements around the text, as far as they have a class or stand
    at the top of the page: those of an article rarely do.
    """
    wanted, paths = {id(n) for n in body(root)}, set()

    def walk(node: Node, path: tuple[str, ...], top: bool) -> bool:
        if node.tag == "#text":
            return id(node) in wanted
        telling = top or not node.label.endswith(".")
        inner = (*path, node.label) if telling else path
        found = [walk(kid, inner, top and node.tag in ("#root", "html", "body")) for kid in node.kids if not node.aside]
        if any(found) and telling:
            paths.add(inner)
        return any(found)

    if not walk(root, (), True):
        return None
    return int.from_bytes(hashlib.blake2b(repr(sorted(paths)).encode(), digest_size=8).digest(), "big", signed=True)


def add_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = [None if page is None else layout(parse(page)) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "number"])


def laid_out(pages: DataFrame) -> DataFrame:
    """``pages`` with the name of each page's ``layout`` within its host, NULL for pages without text or host."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    numbered = pages.mapInArrow(add_layout, f"{kinds}, number long")
    name = F.when((F.col("host") != "") & F.col("number").isNotNull(), F.concat_ws(" ", "number", "host"))
    return numbered.withColumn("layout", name).drop("number")


KINDS = ("host", "layout")
# So many different pages beside the reference make a template; three pages in all may be one text and its versions.
LEAST_PAGES, LEAST_SHARE = 3, 0.8
# References this long are taken only where a host has no shorter page.
REFERENCE_CHARS = 65_536


def wrappers(pages: DataFrame, chosen: DataFrame, models: DataFrame, kind: str, least_pages: int, least_share: float) -> DataFrame:
    """``(kind, kind_reference, kind_template)`` of hosts or layouts that have a template: its leaves by number. One row each.

    ``pages`` has ``html`` and the column named ``kind``. All pages of a host
    or layout count. Counts are summed in the tasks, so a host with a third of
    all pages is a few rows each.
    """
    references = stored(chosen.join(models, ["home", "mark"]).select(F.col("name").alias("host"), "reference"), f"references-{kind}")
    asked = pages.select(F.col(kind).alias("host"), "html")
    counts = asked.join(references, "host").mapInArrow(constant_counter(least_pages), "host string, leaf int, pages long, same long, marks array<long>")
    different = F.size(F.array_distinct(F.flatten(F.collect_list("marks"))))
    total = counts.groupBy("host", "leaf").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), different.alias("different"))
    constant = total.where((F.col("different") >= least_pages) & (F.col("same") >= F.col("pages") * least_share))
    lists = stored(constant.groupBy("host").agg(F.collect_list("leaf").alias("template")), f"templates-{kind}")
    found = references.join(lists, "host").select(
        F.col("host").alias(kind), F.col("reference").alias(f"{kind}_reference"), F.col("template").alias(f"{kind}_template"))
    return stored(found, f"wrappers-{kind}")


def choose(seen: DataFrame, kind: str, least_pages: int) -> DataFrame:
    """``(home, name, mark)``: the reference of each host or layout that has more than ``least_pages`` different pages."""
    groups = seen.groupBy("home", F.col(kind).alias("name")).agg(F.min(F.struct("long", "mark")).alias("best"), F.count(F.lit(1)).alias("n"))
    return groups.where(F.col("n") > least_pages).select("home", "name", F.col("best.mark").alias("mark"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per page: ``(page_id, url, text, n_chars)``.

    Blocks are in page order, joined by one space. NULL and empty html give an
    empty text. Pages without a host, and hosts with too few pages to tell, are
    read without a template. On a host with several layouts, each layout of
    enough pages has a wrapper of its own besides the host's. Equal and
    repeated pages have equal texts, one row each. Other columns are ignored;
    an empty table gives an empty table.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host, _ = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").alias("id"), "url", host.alias("host"), "html")
    marked = rows.where("host <> '' AND html IS NOT NULL").select("host", "html", F.xxhash64("html").alias("mark"))
    named = laid_out(marked.withColumn("long", F.length("html") > REFERENCE_CHARS)).where("layout IS NOT NULL")
    seen = stored(named.select(F.col("host").alias("home"), "host", "layout", "mark", "long").distinct(), "seen")
    several = seen.select("home", "layout").distinct().groupBy("home").count().where("count > 1").select("home")
    by_host = stored(choose(seen, "host", least_pages), "chosen")
    by_layout = stored(choose(seen.join(several, "home", "left_semi"), "layout", least_pages), "chosen-layouts")
    wanted = by_host.select("home", "mark").unionByName(by_layout.select("home", "mark"))
    models = marked.withColumnRenamed("host", "home").join(wanted, ["home", "mark"], "left_semi").dropDuplicates(["home", "mark"])
    models = stored(models.select("home", "mark", F.col("html").alias("reference")), "models")
    rows = rows.join(wrappers(marked, by_host, models, "host", least_pages, least_share), "host", "left")
    if by_layout.isEmpty():
        missing = {"layout": "string", "layout_reference": "string", "layout_template": "array<int>"}
        rows = rows.withColumns({name: F.lit(None).cast(t) for name, t in missing.items()})
    else:
        # Only hosts with several layouts are read again.
        again = laid_out(marked.join(by_layout.select(F.col("home").alias("host")).distinct(), "host", "left_semi"))
        known = wrappers(again, by_layout, models, "layout", least_pages, least_share)
        rows = laid_out(rows).join(known, "layout", "left")
    read = rows.mapInArrow(extractor, f"id {kind}, url string, text string, n_chars long")
    return stored(read, "texts").withColumnRenamed("id", "page_id")
