"""HTML main-text extraction by union-free wrapper inference.

A page is read as a balanced stream of tags and texts. The wrapper of a host is
inferred by aligning the streams of a few of its pages one after the other: on
each level a tag that comes again closes a repeated group, with all that stands
between; a tag that one side lacks becomes optional; texts that differ become
slots, and texts that all pages share stay constants. Every tag thus stands
once a level, so that an alignment takes time linear in the streams, and the
wrapper is a regular expression without unions.

The wrapper decides what the main text is. Its slots are weighed by their text;
where article or main elements hold some of it, they are the content region, as
pages mark their main text so. Elsewhere the region is the deepest container
that keeps most of the slots' text, with the headings and paragraphs beside the
path to it. A page is then matched with the wrapper: outside the region all
goes, and inside it what the wrapper holds as a constant (inside an article: as
a constant element with a class or id of its own). What varies from page to
page and yet isn't main text, as menus and adverts, is known by its tag, role
or, for plain containers, its name.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, table

#: Pages of a host that its wrapper is inferred from.
SAMPLE = 8
#: Pages that must share a text before it is a constant.
SUPPORT = 3
#: Share of the slots' text that a container must keep to be the content region.
KEEP = 0.8
#: Share of it that articles must hold to be the region.
MARKED = 0.1
#: Nesting beyond which elements become siblings; nothing is lost.
DEPTH = 200

ATTRS = r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)(?=[\s/>]){ATTRS}(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRS})>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
BARRIERS = frozenset("article aside blockquote body div footer form header main nav section table td th".split())
CHROME = frozenset("nav header footer aside form button input select textarea dialog menu noscript object canvas audio video head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = HEADINGS | {"p", "blockquote", "pre"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

# Names of containers that aren't main text. A class or id counts if all its parts are known and one of them is furniture.
ALONE = frozenset("ads advert adverts advertisement adsense adslot cookie cookies gdpr disqus breadcrumb breadcrumbs navbar newsletter commentlist".split())
STRONG = ALONE | frozenset("ad adbox banner sponsor sponsored promo promotion consent popup modal overlay subscribe signup login comment comments reply replies respond paywall notice notices".split())
WEAK = frozenset("sidebar side menu menus nav navigation header masthead footer share sharing social related recommended toolbar pagination pager widget widgets hidden search".split())
NEUTRAL = frozenset(
    "box block wrap wrapper container area section list bar top bottom left right inner outer slot unit site page global main primary secondary sticky fixed"
    " link links post posts article articles entry item items icon icons button buttons form module group panel content message text js col row first last # #x#".split()
)
#: A container with such a class of its own is a part of the layout, whatever else it is called.
LAYOUT = frozenset("content main main-content maincontent entry-content post-content article article-body story layout container wrapper page site".split())
SITE_HEADER = frozenset("header site-header page-header global-header top-header main-header masthead".split())
NAMED = frozenset("div section ul ol dl table".split())
SMALL = frozenset("p li span a b i em strong article".split())


def _furniture(tag: str, names: list[str]) -> bool:
    """Whether class names and ids say that an element isn't main text."""
    if tag not in NAMED and tag not in SMALL:
        return False
    words = STRONG if tag in SMALL else STRONG | WEAK
    weak = words is not STRONG and LAYOUT.isdisjoint(names)
    for name in names:
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if not ALONE.isdisjoint(parts):
            return True
        if "header" in parts and name not in SITE_HEADER:
            continue
        if all(p in words or p in NEUTRAL for p in parts) and not (words if weak else STRONG).isdisjoint(parts):
            return True
    return False


class Node:
    """An element: its tag, name in the wrapper, children (elements or texts), whether it is page furniture."""

    __slots__ = ("tag", "name", "children", "chrome", "named", "depth")

    def __init__(self, tag: str, attrs: str, depth: int):
        found = {a.lower(): html.unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(attrs)} if attrs else {}
        own = " ".join(filter(None, (found.get("class"), found.get("id"))))
        names = sorted(DIGITS.sub("#", own).lower().split()) if own else []
        self.tag = "main" if found.get("role") == "main" else tag
        self.children, self.depth = [], depth
        self.name = self.tag if self.tag in ("article", "main", "body", "html") else tag + ("." + ".".join(names) if names else "")
        self.named = bool(names) and _furniture(self.tag, names)
        self.chrome = self.named or (
            tag in CHROME
            or "hidden" in found
            or found.get("aria-hidden") == "true"
            or found.get("role", "").lower() in ROLES
            or (bool(found.get("style")) and "display:none" in found["style"].replace(" ", "").lower())
        )


def parse(page: str) -> Node:
    """The tree of a page; scripts, styles and comments are not in it, character
    references are decoded. A form around an article, a main or an h1 is no furniture."""
    root = Node("#root", "", 0)
    stack, at = [root], 0

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value))

    def close(tags: tuple[str, ...], barriers) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in barriers:
                return

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "td", "th") and tag in ("p", "b", "i", "span", "a", "em", "strong", "div", "li"):
                    break
            continue
        if tag in BLOCKS:
            close(("p",), BARRIERS)
        if tag in CLOSES:
            tags, barriers = CLOSES[tag]
            close(tuple(tags.split()), barriers)
        node = Node(tag, m["attrs"], stack[-1].depth + 1)
        stack[-1].children.append(node)
        if node.tag in ("article", "main", "h1"):
            for above in stack:
                above.chrome = above.chrome and above.tag != "form"
        if tag not in VOID and not m["attrs"].endswith("/") and node.depth < DEPTH:
            stack.append(node)
    tail = page[at:]
    text(tail if not re.match(r"<[a-zA-Z/!]", tail[tail.rfind("<") :] or " ") else tail[: tail.rfind("<")])
    return root


def clean(text: str) -> str:
    return SPACES.sub(" ", text).strip()


def blocks(node: Node, drop: frozenset | set = frozenset()) -> list[str]:
    """Texts of the blocks below a node in page order, without page furniture and
    without what is in `drop` (ids of elements, places of texts). A single line
    break is a space, two in a row end the block; of a header only headings stay."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if t := clean("".join(parts)):
                out.append(t)
            parts.clear()

    def walk(n: Node, headings_only: bool) -> None:
        breaks = 0
        for k, child in enumerate(n.children):
            if isinstance(child, str):
                if not headings_only and not (drop and (id(n), k) in drop):
                    parts.append(child)
                breaks = breaks if child.isspace() else 0
            elif child.tag == "br":
                breaks += 1
                flush() if breaks > 1 else parts.append(" ")
            elif child.chrome:
                if child.tag == "header" or (child.named and "header" in child.name):
                    flush()
                    walk(child, True)
                    flush()
            elif drop and id(child) in drop:
                flush() if child.tag in BLOCKS else parts.append(" ")
            elif child.tag in BLOCKS:
                flush()
                walk(child, headings_only and child.tag not in HEADINGS)
                flush()
                breaks = 0
            else:
                walk(child, headings_only)
                breaks = 0

    walk(node, False)
    flush()
    return out


Part = Node | list  # an element, or a run of text as its places


def level(node: Node) -> Iterator[tuple[str, Part]]:
    """The stream directly below a node: elements by name, runs of text as #. Page furniture isn't in it."""
    run: list[tuple[Node, int]] = []
    for k, child in enumerate(node.children):
        if isinstance(child, str):
            if not child.isspace():
                run.append((node, k))
        elif not child.chrome and child.tag != "br":
            if run:
                yield "#", run
                run = []
            yield child.name, child
    if run:
        yield "#", run


def text_of(part: Part) -> str:
    if isinstance(part, list):
        return clean(" ".join(n.children[k] for n, k in part))
    found: list[str] = []
    stack: list = [part]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            found.append(n)
        elif not n.chrome:
            stack.extend(reversed(n.children))
    return clean(" ".join(found))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class Group:
    """A place of the wrapper: how often it was seen, in how many of its parent's
    occurrences and pages, the texts all pages have there, and its level below.
    `loops` holds pairs of names between which the level repeats."""

    __slots__ = ("name", "seen", "inside", "pages", "many", "fixed", "text", "items", "loops", "mass", "links")

    def __init__(self, name: str):
        self.name, self.seen, self.inside, self.pages, self.many = name, 1, 1, 1, False
        self.fixed, self.text, self.items, self.loops, self.mass, self.links = set(), None, {}, [], 0, 0


def wrapper_of(node: Node) -> Group:
    """The wrapper of one page: what recurs on a level is a repeated group."""
    out = Group(node.name)
    order: list[str] = []
    for name, part in level(node):
        if isinstance(part, list):
            child = Group("#")
            child.text = text_of(part)
            child.fixed = {digest(child.text)}
        else:
            child = wrapper_of(part)
            child.fixed = {digest(text_of(part))}
        if name in out.items:
            held = out.items[name]
            held.many = True
            align(held, child, False)
            out.loops.append((name, order[-1]))
        else:
            out.items[name] = child
            order.append(name)
    return out


def align(a: Group, b: Group, across: bool = True) -> Group:
    """a, widened so that it covers b, too: `across` pages or within one. Both
    levels are walked once; names in another order than before are one repeated group."""
    a.seen, a.many = a.seen + b.seen, a.many or b.many
    a.pages = a.pages + b.pages if across else 1
    a.fixed = a.fixed & b.fixed if across else a.fixed | b.fixed
    a.text = a.text if a.text == b.text else None
    at = {name: k for k, name in enumerate(a.items)}
    new: dict[str | None, list[str]] = {}
    last, furthest = None, None
    for name, item in b.items.items():
        if (held := a.items.get(name)) is None:
            new.setdefault(last, []).append(name)
            continue
        if furthest is not None and at[name] < at[furthest]:
            a.loops.append((name, furthest))
        else:
            furthest = name
        inside = held.inside + item.inside
        align(held, item, across).inside = inside
        last = name
    if new:
        merged = {n: b.items[n] for n in new.get(None, ())}
        for name, item in a.items.items():
            merged[name] = item
            merged.update((n, b.items[n]) for n in new.get(name, ()))
        a.items = merged
    a.loops += b.loops
    return a


def expression(w: Group, whole: int | None = None) -> str:
    """The wrapper as text: # is a slot, other texts are constants, quantifiers follow groups."""
    if w.name == "#":
        body = "#" if w.text is None else json.dumps(w.text, ensure_ascii=False)
    else:
        at = {name: k for k, name in enumerate(w.items)}
        end = list(range(len(at)))
        for x, y in w.loops:
            first, last = sorted((at[x], at[y]))
            end[first] = max(end[first], last)
        items, parts, k = list(w.items.values()), [], 0
        while k < len(items):
            stop, j = end[k], k
            while j < stop:
                j += 1
                stop = max(stop, end[j])
            inner = "".join(expression(x, w.seen) for x in items[k : stop + 1])
            parts.append(f"({inner})+" if stop > k else inner)
            k = stop + 1
        body = f"<{w.name}>{''.join(parts)}</>"
    optional = whole is not None and w.inside < whole
    mark = ("*" if optional else "+") if w.many else "?" if optional else ""
    return f"({body}){mark}" if mark else body


def _constant(x: Group, pages: int, part: Part) -> bool:
    return pages >= SUPPORT and x.pages == pages and bool(x.fixed) and digest(text_of(part)) in x.fixed


def _weigh(node: Node, w: Group, pages: int, link: bool = False) -> tuple[int, int]:
    """Adds a page's variable text to the places of the wrapper: characters outside and inside links."""
    plain = linked = 0
    for name, part in level(node):
        x = w.items[name]
        if _constant(x, pages, part):
            continue
        if isinstance(part, list):
            n = len(text_of(part))
            found = (0, n) if link else (n, 0)
        else:
            found = _weigh(part, x, pages, link or part.tag == "a")
        x.mass, x.links = x.mass + found[0], x.links + found[1]
        plain, linked = plain + found[0], linked + found[1]
    return plain, linked


def _outermost(w: Group, name: str) -> list[Group]:
    return [g for x in w.items.values() for g in ([x] if x.name == name else _outermost(x, name))]


def _constants(w: Group, pages: int, every: bool) -> dict:
    """The constants below a place: name -> [digests, the same below it]; empty places are left out."""
    out = {}
    for name, x in w.items.items():
        held = sorted(x.fixed) if pages >= SUPPORT and x.pages == pages and (every or "." in name) else []
        below = _constants(x, pages, every)
        if held or below:
            out[name] = [held, below]
    return out


def _joined(a: dict, b: dict) -> dict:
    return {n: [sorted({*a.get(n, [[], {}])[0], *b.get(n, [[], {}])[0]}), _joined(a.get(n, [[], {}])[1], b.get(n, [[], {}])[1])] for n in {**a, **b}}


def _distinct(trees: list[Node]) -> list[Node]:
    """Pages that don't share most of their text with an earlier one: of copies, equal texts say nothing."""
    kept: list[tuple[Node, dict[int, int]]] = []
    for tree in trees:
        long_ = {digest(t): len(t) for t in blocks(tree) if len(t) >= 40}
        if all(2 * sum(n for d, n in long_.items() if d in seen) < max(1, min(sum(long_.values()), sum(seen.values()))) for _, seen in kept):
            kept.append((tree, long_))
    return [t for t, _ in kept]


def infer_trees(trees: list[Node]) -> dict:
    total = len(trees)
    trees = _distinct(trees)
    pages = len(trees)
    wrapper = wrapper_of(trees[0])
    for t in trees[1:]:
        align(wrapper, wrapper_of(t))
    mass = sum(_weigh(t, wrapper, pages)[0] for t in trees)
    found = {"expression": expression(wrapper), "pages": total, "mark": None, "path": [], "beside": [], "own": [], "inside": {}}
    for tag in ("article", "main"):
        groups = _outermost(wrapper, tag)
        held = sum(g.mass for g in groups)
        if held and (pages < SUPPORT or held >= MARKED * mass):
            found["mark"] = tag
            found["own"] = sorted({d for g in groups if pages >= SUPPORT and g.pages == pages for d in g.fixed})
            for g in groups:
                found["inside"] = _joined(found["inside"], _constants(g, pages, False))
            break
    else:
        at = wrapper
        while good := [x for x in at.items.values() if x.name.split(".")[0] in CONTAINERS and mass and x.mass >= KEEP * mass]:
            new = max(good, key=lambda x: (x.mass, x.name))
            found["beside"].append(sorted(n for n, x in at.items.items() if x is not new and n.split(".")[0] in BESIDE and x.mass > x.links))
            found["path"].append(new.name)
            at = new
        found["inside"] = _constants(at, pages, True)
    found["region"] = found["mark"] or " > ".join(found["path"])
    if found["inside"] or found["own"]:  # of pages that share most of their main text, that text is no furniture
        plain = {**found, "inside": {}, "own": []}
        if any(2 * len(_extract(t, found) or "") < len(_extract(t, plain) or "") for t in trees):
            found = plain
    return found


def infer(pages: list[str]) -> dict:
    """The wrapper of a host's sample: expression, region and what of it is constant."""
    return infer_trees([parse(p) for p in pages])


def _regions(node: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag in page order, without page furniture."""
    out: list[Node] = []
    for child in node.children:
        if not isinstance(child, str) and not child.chrome:
            out += [child] if child.tag == tag else _regions(child, tag)
    return out


def _along(node: Node, wrapper: dict, k: int) -> Iterator[tuple[Node, bool]]:
    """The elements at the end of the wrapper's path and those beside it, in page order; whether they are the region."""
    if k == len(wrapper["path"]):
        yield node, True
        return
    for name, part in level(node):
        if name == wrapper["path"][k]:
            yield from _along(part, wrapper, k + 1)
        elif name in wrapper["beside"][k]:
            yield part, False


def _match(node: Node, inside: dict, drop: set) -> None:
    """Matches a page's level with the wrapper's and marks what is constant."""
    for name, part in level(node):
        if (held := inside.get(name)) is None:
            continue
        if held[0] and digest(text_of(part)) in held[0]:
            drop.update([(id(n), k) for n, k in part] if isinstance(part, list) else [id(part)])
        elif held[1] and not isinstance(part, list):
            _match(part, held[1], drop)


def _extract(tree: Node, wrapper: dict) -> str | None:
    """The main text of a tree by a wrapper; None if it doesn't have the wrapper's region."""
    if wrapper["mark"]:
        found = [(n, True) for n in _regions(tree, wrapper["mark"])]
        if wrapper["own"]:
            own = set(wrapper["own"])
            found = [x for x in found if digest(text_of(x[0])) not in own] or found
    else:
        found = list(_along(tree, wrapper, 0))
    if not any(region for _, region in found):
        return None
    drop: set = set()
    if wrapper["inside"]:
        for node, region in found:
            if region:
                _match(node, wrapper["inside"], drop)
    return "\n".join(filter(None, ("\n".join(blocks(n, drop)) for n, _ in found)))


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text of a page by its host's wrapper; a page that lacks the
    wrapper's region, or has no text there, is its own sample."""
    if not page or not page.strip():
        return ""
    tree = parse(page)
    return (_extract(tree, wrapper) if wrapper else None) or _extract(tree, infer_trees([tree])) or ""


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


WRAPPER = "host string, expression string, region string, wrapper string, pages int"
#: What extraction needs of a wrapper.
MATCHED = ("mark", "path", "beside", "own", "inside")


def infer_wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """host, expression, region, wrapper (JSON) and pages from at most `sample` pages
    of each host: the smallest page_id of each of as many classes of page_ids,
    found by a partial aggregation, so that a host of any size costs a few rows."""
    hosted = _hosted(pages).filter("page_id IS NOT NULL AND html IS NOT NULL")
    chosen = hosted.groupBy("host", F.pmod(F.xxhash64("page_id"), F.lit(sample)).alias("salt")).agg(F.min("page_id").alias("page_id"))
    # written, so that Spark knows its size when it decides whether the pages must be shuffled
    chosen = materialise(chosen.select("page_id").distinct(), "sampled-pages")
    rows = hosted.join(chosen, "page_id", "left_semi").select("host", "page_id", "html")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = infer(group.sort_values(["page_id", "html"])["html"].tolist()[:sample])
        return pd.DataFrame(
            [{"host": key[0], "expression": found["expression"], "region": found["region"], "wrapper": json.dumps({k: found[k] for k in MATCHED}), "pages": found["pages"]}]
        )

    return rows.groupBy("host").applyInPandas(run, WRAPPER)


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A null or blank html gives an empty text; pages without a url share the
    empty host; rows without a page_id are extracted but not sampled; repeated
    rows stay. Other columns are not read. An empty table gives an empty result.
    """
    wrappers = materialise(infer_wrappers(pages, sample).select(F.col("host").alias("_host"), "wrapper"), "wrappers")
    hosted = _hosted(pages)
    joined = hosted.join(wrappers, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for page, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if w not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[w] = json.loads(w)
                texts.append(extract(page, known[w]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
