"""HTML main-text extraction by wrapper induction.

The block trees of a host's pages are added up into one wrapper tree per host, a slot for each path of labels that enough of them have. All
pages are then aligned with that tree by simple tree matching (Yang, 1991), and a Spark aggregate counts each text of each slot over the host's different pages: texts that
nearly all pages repeat are template, the varying slots are content. Slots that serve another end by their element or name (menus, adverts, comments and so on) are
left out too; that rule alone decides on hosts with too few pages to align."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .dom import Node, parse

#: Elements and names (words of class, id and role) that hold no main text.
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset".split())
ASIDE_NAMES = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar sidebars aside rail widget widgets
    ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr
    notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related
    recommended recommendations trending comment comments disqus discussion replies respond pager pagination toolbar search searchbox copyright disclaimer
    contentinfo complementary form feedback""".split()
)
#: Inside an article: names that content has as well, and names that go with those above without saying more.
_UNSURE = frozenset("discussion form feedback head header related".split())
_KINDS = frozenset("box block area section list item items top bottom left right inline unit slot links posts articles stories bar icons buttons here in post article".split())
_FRAME_NAMES = frozenset("with has no wrapper wrap container layout page site".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Slot:
    """A wrapper node: its label, the pages that have it, the sum of its places among its siblings (in thousandths), its number in the tree. A
    parent has one slot a label, so a tree doesn't depend on the order in which pages were added."""

    __slots__ = ("label", "pages", "place", "children", "nth")

    def __init__(self, label: str, pages: int = 1, place: int = 0):
        self.label, self.pages, self.place, self.children, self.nth = label, pages, place, {}, 0

    def ordered(self) -> list[Slot]:
        """Children by their mean place."""
        return sorted(self.children.values(), key=lambda c: (Fraction(c.place, c.pages), c.label))

    def state(self):
        return self.label, self.pages, self.place, [c.state() for c in self.ordered()]

    @classmethod
    def load(cls, state) -> Slot:
        out = cls(*state[:3])
        out.children = {c[0]: cls.load(c) for c in state[3]}
        return out

    def number(self, nth: int = 0) -> int:
        """Numbers the slots from the root on; the first number after them."""
        self.nth = nth
        for c in self.ordered():
            nth = c.number(nth + 1)
        return nth


def text_key(text: str) -> int:
    """A signed 64-bit hash."""
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) ^ 1 << 63) - (1 << 63)


def groups(nodes: list[Node]) -> dict[str, list[Node]]:
    """The children of some nodes of one slot by label, in order of their first: repeated blocks, next to each other or taking turns, are one."""
    out: dict[str, list[Node]] = {}
    for n in nodes:
        for c in n.children:
            out.setdefault(c.label, []).append(c)
    return out


def below(path: int, label: str) -> int:
    """The signed hash of a path of labels from the root, from that of its parent."""
    return (xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=path & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)


def paths(root: Node) -> list[int]:
    """Every path of labels in the page, once."""
    out, stack = [], [([root], below(0, root.label))]
    while stack:
        nodes, path = stack.pop()
        out.append(path)
        stack += [(own, below(path, label)) for label, own in groups(nodes).items()]
    return out


def as_slots(root: Node, keep: frozenset | None = None) -> Slot:
    """A page's tree as a wrapper of one page; keep: the paths that count (all, if None)."""

    def build(nodes: list[Node], path: int, place: int) -> Slot:
        slot, under = Slot(nodes[0].label, 1, place), groups(nodes)
        for k, (label, own) in enumerate(under.items()):
            if keep is None or (p := below(path, label)) in keep:
                slot.children[label] = build(own, below(path, label) if keep is None else p, 1000 * k // len(under))
        return slot

    return build([root], below(0, root.label), 0)


def merge(into: Slot, other: Slot) -> Slot:
    """Adds another wrapper of the same root; what only one of them has is an optional slot."""
    into.pages += other.pages
    into.place += other.place
    for label, c in other.children.items():
        if label in into.children:
            merge(into.children[label], c)
        else:
            into.children[label] = c
    return into


def heaviest_chain(places: list[int], weights: list[int]) -> list[int]:
    """Which items make the heaviest selection whose places increase; places differ. By a tree of prefix maxima."""
    if all(a < b for a, b in zip(places, places[1:])):
        return list(range(len(places)))
    rank = {p: k + 1 for k, p in enumerate(sorted(places))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)
    before = []
    for k, (p, w) in enumerate(zip(places, weights)):
        i, top = rank[p] - 1, (0, -1)
        while i:
            top, i = max(top, best[i]), i & (i - 1)
        before.append(top[1])
        i, own = rank[p], (top[0] + w, k)
        while i <= len(places):
            best[i] = max(best[i], own)
            i += i & -i
    i, top = len(places), (0, -1)
    while i:
        top, i = max(top, best[i]), i & (i - 1)
    out, k = [], top[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def matching(nodes: list[Node], slot: Slot) -> tuple[int, list[tuple[list[Node], Slot]]]:
    """Simple tree matching of a page's nodes with the slot of their label: the size of the largest matching of the trees that keeps the order
    of siblings and puts only equal labels together, roots matched, and its pairs. A label stands once on either side, so a child has one partner
    to choose or leave, and the table of the general method is a heaviest increasing chain: n log n in the number of siblings."""
    size, pairs, found = 1, [(nodes, slot)], []
    at = {c.label: k for k, c in enumerate(slot.ordered())}
    for label, own in groups(nodes).items():
        if label in at:
            found.append((at[label], *matching(own, slot.children[label])))
    for k in heaviest_chain([f[0] for f in found], [f[1] for f in found]):
        size += found[k][1]
        pairs += found[k][2]
    return size, pairs


def serves_another_end(node: Node, inside: bool) -> bool:
    """Whether the element is no part of the main text by its tag or names; inside: of an article."""
    if node.hidden:
        return True
    if node.tag in ASIDE_TAGS:
        return not (inside and node.tag == "header")
    if node.tag in ("html", "body", "main"):
        return False
    named = node.names & ASIDE_NAMES
    if inside:  # names of which some say something else (related-methods, discussion) leave it to the counts
        return bool(named - _UNSURE) and node.names <= ASIDE_NAMES | _FRAME_NAMES | _KINDS
    return bool(named) and not (node.names & _FRAME_NAMES and named <= {"sidebar", "sidebars", "header", "nav", "banner", "ad", "ads", "footer", "menu"})


def _holds(node: Node, tags: frozenset) -> bool:
    return any(c.tag in tags or _holds(c, tags) for c in node.children)


def regions(root: Node) -> list[Node]:
    """The page's articles that serve no other end; else its main elements; else the whole."""
    found: dict[str, list[Node]] = {"article": [], "main": []}

    def walk(node: Node, inside_main: bool) -> None:
        for c in node.children:
            if c.tag == "#text" or (serves_another_end(c, False) and not _holds(c, frozenset(["article", "main"]))):
                continue
            if c.tag == "article":
                found["article"].append(c)
                continue
            if c.tag == "main" or "main" in c.names and "content" in c.names:
                if not inside_main:
                    found["main"].append(c)
                walk(c, True)
                continue
            walk(c, inside_main)

    walk(root, False)
    return found["article"] or found["main"] or [root]


def slots_of(root: Node, wrapper: Slot) -> dict[int, int]:
    """The number of the wrapper's slot for each node (by id) that the alignment gives one."""
    if wrapper.label != root.label:
        return {}
    return {id(n): slot.nth for nodes, slot in matching([root], wrapper)[1] for n in nodes}


def slot_texts(root: Node, wrapper: Slot) -> set[tuple[int, int]]:
    """(slot, text hash) of the page's texts."""
    at, out, stack = slots_of(root, wrapper), set(), [root]
    while stack:
        node = stack.pop()
        stack += node.children
        if node.tag == "#text" and id(node) in at:
            out.add((at[id(node)], text_key(node.text)))
    return out


def extract(root: Node, wrapper: Slot | None = None, template: frozenset = frozenset()) -> str:
    """The page's main text. template: (slot, text hash) that go. A page whose every text is template, as on a host that shows one
    article again and again, has no varying slot, and keeps them all."""
    at = slots_of(root, wrapper) if wrapper is not None and template else {}
    picked: list[tuple[str, bool]] = []

    def walk(node: Node, inside: bool, whole: bool) -> None:
        for c in node.children:
            if c.tag == "#text":
                if whole and 5 * c.link_chars > 4 * len(c.text) and node.tag not in ("p", "blockquote", *_HEADINGS):
                    continue
                picked.append((c.text, bool(template) and (at.get(id(c)), text_key(c.text)) in template))
            elif not serves_another_end(c, inside) or (whole and _holds(c, frozenset(["article", "main"]))):
                walk(c, inside, whole)

    for region in regions(root):
        walk(region, region.tag in ("article", "main"), region is root)
    return " ".join([t for t, x in picked if not x] or [t for t, _ in picked])


def host_of(url):
    """The host of a url column, lower case; null and urls without one count as the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


WRAPPERS = "host string, part int, wrapper binary"


def frequent_paths(pages: DataFrame, share: float, least_pages: int) -> DataFrame:
    """host, paths: the paths of labels that `share` or more of the host's different pages have, of hosts with `least_pages` such pages. A
    text that so many pages show stands in a slot whose path they have, so no other slot can hold template; a host has at most a page's
    mean number of paths over `share` of them, whatever its odd pages hold and in whatever order they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, text_key(p), paths(parse(p))) for h, p in zip(b["host"], b["html"]) if p]
            if rows:
                yield pd.DataFrame(rows, columns=["host", "page", "paths"])

    seen = pages.select("host", "html").mapInPandas(run, "host string, page long, paths array<long>").dropDuplicates(["host", "page"])
    root = below(0, "html")  # each page has it
    counts = materialize(seen.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")), "paths")
    size = counts.filter(F.col("path") == root).select("host", F.col("n").alias("pages")).filter(F.col("pages") >= least_pages)
    often = materialize(counts.join(size, "host").filter(F.col("n") >= F.lit(share) * F.col("pages")).select("host", "path"), "frequent-paths")
    return often.groupBy("host").agg(F.collect_list("path").alias("paths"))


def induce(pages: DataFrame, often: DataFrame, broadcast_bytes: int, hosts_at_once: int = 2000) -> DataFrame:
    """host, wrapper (a pickled tree) of every host in `often` (host, paths), from all its pages, of its frequent paths alone.

    A task folds the pages it reads into a wrapper per host, and hands those on when it holds `hosts_at_once`. The tasks' wrappers of a host are
    then merged in two steps, first in up to 64 parts by task, so a host with a third of all pages is not read by one task. Wrappers add up, in
    any order to the same tree."""
    rows, results = _with_host(pages.select("host", "html"), often, ["paths"], F.size("paths") * 8, lambda row: frozenset(int(x) for x in row[0]), broadcast_bytes)

    def fold(page: str | None, keep: frozenset | None) -> Slot | None:
        return as_slots(parse(page), keep) if page and keep is not None else None

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Slot] = {}
        part = TaskContext.get().partitionId() % 64

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([(h, part, pickle.dumps(w.state())) for h, w in held.items()], columns=["host", "part", "wrapper"])
            held.clear()
            return out

        for b, trees in results(batches, fold):
            for host, tree in zip(b["host"], trees):
                if tree is not None:
                    held[host] = merge(held[host], tree) if host in held else tree
            if len(held) >= hosts_at_once:
                yield hand_on()
        if held:
            yield hand_on()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for w in pdf["wrapper"]:
            tree = Slot.load(pickle.loads(w))
            out = tree if out is None else merge(out, tree)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [0], "wrapper": [pickle.dumps(out.state())]})

    parts = rows.mapInPandas(partial, WRAPPERS)
    some = parts.groupBy("host", "part").applyInPandas(merged, WRAPPERS)
    return some.groupBy("host").applyInPandas(merged, WRAPPERS).select("host", "wrapper")


def templates(pages: DataFrame, wrappers: DataFrame, share: float, least_pages: int, broadcast_bytes: int) -> DataFrame:
    """host, wrapper, slots, texts: the (slot, text hash) that `share` or more of the host's different pages show, of hosts with
    `least_pages` different pages and such a text. A host has at most its texts a page over `share` of them."""

    def count(page: str, loaded: tuple | None) -> list[tuple[int, int]]:
        return [(-1, 0), *(slot_texts(parse(page), loaded[0]) if loaded else ())] if page else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in results(batches, count):
            rows = [(h, text_key(p), s, t) for h, p, x in zip(b["host"], b["html"], found) for s, t in x]
            yield pd.DataFrame(rows, columns=["host", "page", "slot", "text"])

    rows, results = _with_wrapper(pages.select("host", "html"), wrappers, broadcast_bytes)
    seen = rows.mapInPandas(run, "host string, page long, slot int, text long").distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n"))
    seen = materialize(seen, "slot-texts")
    size = seen.filter("slot = -1").select("host", F.col("n").alias("pages")).filter(F.col("pages") >= least_pages)
    # written, so that the join may split a large host; what is left of a host is small
    often = materialize(seen.filter("slot >= 0").join(size, "host").filter(F.col("n") >= F.lit(share) * F.col("pages")).select("host", "slot", "text"), "template-texts")
    return often.groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("text").alias("texts")).join(wrappers, "host")


def _with_wrapper(rows: DataFrame, wrappers: DataFrame, broadcast_bytes: int):
    """rows, and a function for their tasks: (batch, results of f(html, (wrapper, template) or None))."""
    columns = [c for c in ("wrapper", "slots", "texts") if c in wrappers.columns]

    def load(row: tuple) -> tuple:
        wrapper = Slot.load(pickle.loads(row[0]))
        wrapper.number()
        return wrapper, frozenset(zip(*([int(x) for x in c] for c in row[1:]))) if len(row) > 1 else frozenset()

    return _with_host(rows, wrappers, columns, F.octet_length("wrapper") + (12 * F.size("slots") if "slots" in columns else 0), load, broadcast_bytes)


def _with_host(rows: DataFrame, hosts: DataFrame, columns: list[str], size, load, broadcast_bytes: int):
    """rows, and a function for their tasks: (batch, results of f(html, what `load` makes of the host's columns, or None)). The hosts' columns
    go to the tasks as a whole while they are at most broadcast_bytes together, else by a join on the host, whose large hosts AQE splits."""
    total = hosts.agg(F.sum(size)).first()[0] or 0
    shared = None
    if total <= broadcast_bytes:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: tuple(r[c] for c in columns) for r in hosts.collect()})
    else:
        rows = rows.join(hosts, "host", "left")

    def results(batches: Iterator[pd.DataFrame], f) -> Iterator[tuple[pd.DataFrame, list]]:
        loaded: dict = {}
        for b in batches:
            found = []
            for k, (host, page) in enumerate(zip(b["host"], b["html"])):
                if host not in loaded:
                    if len(loaded) > 2000:
                        loaded.clear()
                    row = shared.value.get(host) if shared is not None else tuple(b[c].iloc[k] for c in columns)
                    loaded[host] = load(row) if row and row[0] is not None else None
                found.append(f(page, loaded[host]))
            yield b, found

    return rows, results


def extract_pages(pages: DataFrame, share: float = 0.6, least_pages: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text (empty if none) of every row of pages.

    A null html counts as empty, a null url or one without a host as of the host ''. Repeated rows are all returned, and count once for
    what is template. Pages of any length and depth are read whole. Columns other than page_id, url and html, whatever their names, are not read.
    share: the part of a host's different pages that show a template text; least_pages: what a host needs for that."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of("url").alias("host"), "html")
    often = materialize(frequent_paths(named, share, least_pages), "host-paths")
    wrappers = materialize(induce(named, often, broadcast_bytes), "wrappers")
    known = materialize(templates(named, wrappers, share, least_pages, broadcast_bytes), "templates")

    def text(page: str, loaded: tuple | None) -> str:
        return extract(parse(page), *(loaded or ()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in results(batches, text):
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": found})

    rows, results = _with_wrapper(named, known, broadcast_bytes)
    return rows.mapInPandas(run, "page_id long, url string, text string")
