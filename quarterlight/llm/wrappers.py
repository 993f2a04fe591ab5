"""HTML main text by wrapper induction.

Pages of one host share a template.  Every page's block tree is reduced to a
skeleton (equal siblings folded into one node) and merged into its host's
template by simple tree matching: the alignment of two trees with the most
matched nodes that keeps order and ancestry (Yang, 1991).  A template node counts
the pages that have it, its characters, and the texts that stand there again and
again (a Misra-Gries summary of TEXTS counters, which never loses a text on
more than a 1 / TEXTS share of its node's).  Nodes whose texts stay the same are
template, nodes whose texts vary are slots.

A page is aligned to its host's template.  Its content is all its slots: every block but
those whose text is constant in the aligned template node.  A node whose texts are nearly all constant is
template.  A node with varying texts is a slot, and a constant text goes from it only if
nearly all pages have it and such texts are the lesser part: pages that are near copies have
most of their text in common, too, and keep it.  Where <article> or <main>
slots hold at least PLACED of a host's varying characters (any, if the host has fewer than CONSTANT_PAGES
pages), the content is what is in them, but for places with much less text than the largest, as teasers have;
headings in an article are never constant, nor is any text of articles whose greater part would be.
Menus, footers, sidebars, forms, scripts and styles go by their element or role.  Notices, adverts, headers and the like known only by
class or id go, too, where they stand outside an article, unless such a node is a paragraph that varies, or holds more varying
characters than all the rest of the template: then the name lies, and the slot is content.  Reader comments
go by the usual names of their lists.
A host with few pages has no constant text; all its nodes are slots.

Templates are learned from all pages, per task first, then merged FAN at a time,
so no task holds more than FAN templates of a host.  A template keeps at most NODES nodes, the best
supported ones; a block without a template node is a slot.  Templates of up to SHIPPED bytes in
all go to the tasks as a broadcast, so that pages stay where they are; beyond that, pages are
dealt by host and a salt, and each host's template goes to SALTS places.

Elements nested deeper than html.DEPTH are read as if they stood one after another.

Character references are decoded; white space inside a block becomes one space;
blocks are joined by an empty line.  Null html: empty text; null or odd url: the
empty host.  Repeated rows each get their text.  Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .html import BLOCKS, DROPPED, Node, parse
from .texts import sliced

TEXTS = 64
FAN = 64
NODES = 400
#: Hosts that a task holds before it hands their templates on.
HOSTS = 2000
#: A text is constant if it stands on this share of the pages (in a slot or an article, of its pages), of CONSTANT_PAGES at least.
CONSTANT, CONSTANT_INSIDE, CONSTANT_PAGES = 0.5, 0.95, 4
#: A node is a slot if it has so many varying texts a page; constant texts go from slots and articles if they are at most this share of the characters.
VARYING, LESSER = 0.3, 0.5
#: Articles are the content if they hold this share of a host's varying characters; of them, those with this share of the largest's text.
PLACED, LARGE = 0.2, 0.3
#: Bytes of templates that are broadcast; places that a host's pages are dealt to beyond that.
SHIPPED, SALTS = 32 << 20, 64

ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar side widget nav navbar navigation menu breadcrumb breadcrumbs footer header masthead share sharing social related recommended newsletter "
    "subscribe subscription signup login pagination pager tags toolbar".split()
)
#: What may stand beside such a word in a name without giving it another sense.
BESIDE = frozenset("area articles bar block bottom box buttons container content first group icons inner last left links list main media outer page popular posts right section site slot stories top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments comment-list commentlist comments-list comments-area comment-area comment-section comments-section comment-thread user-comments reader-comments replies respond disqus disqus_thread".split())
#: Elements that hold a text of their own; their varying texts are content whatever they are called.
PARAGRAPHS = ("p", "blockquote", "pre", "dd")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def dropped(node: Node, inside: bool) -> bool:
    """Whether a node is no part of the main text by its element, role or style, or holds readers' comments."""
    a = node.attrs
    if node.tag in DROPPED or node.tag == "header" and not inside or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    return node.tag not in (*PLACES, *PARAGRAPHS) and bool(COMMENTS & set(names_of(node)))


PLACES = ("html", "body", "article", "main", "#root")


def names_of(node: Node) -> list[str]:
    return (node.attrs.get("class") or "").lower().split() + [(node.attrs.get("id") or "").lower()]


def doubtful(node: Node, inside: bool) -> bool:
    """Whether a node's class or id alone says that it is no part of the main text."""
    if inside or node.tag in PLACES:
        return False
    words = [[w for w in re.split(r"[_-]+|[0-9]+", name) if w] for name in names_of(node)]
    return any(NAMED.intersection(ws) and NAMED.union(BESIDE).issuperset(ws) for ws in words)


def signature(node: Node, inside: bool) -> str:
    """Element and first class (else id) without digits; doubtful nodes start with "!"."""
    names = (node.attrs.get("class", "").split() or [node.attrs.get("id", "")])[0]
    s = f"{node.tag}.{re.sub('[0-9]+', '', names)}" if names else node.tag
    return f"!{s}" if doubtful(node, inside) else s


def mark(text: str) -> str:
    """A digest of a text, with its length."""
    return f"{zlib.crc32(text.encode('utf-8', 'replace')):08x}{len(text):x}"


def mass(t: list, marks: set[str]) -> int:
    """Characters of these texts of a node, on all pages."""
    return sum(int(k[8:], 16) * t[4][k] for k in marks)


# A template node: [signature, pages, characters, texts, {text mark: count}, children].


def summed(a: dict, b: dict) -> dict:
    """Misra-Gries summaries merge: add, then take away the first count that is too many."""
    out = dict(a)
    for k, n in b.items():
        out[k] = out.get(k, 0) + n
    if len(out) > TEXTS:
        cut = sorted(out.values(), reverse=True)[TEXTS]
        out = {k: n - cut for k, n in out.items() if n > cut}
    return out


def skeleton(node: Node, inside: bool = False) -> list:
    """The template of one page's subtree: blocks only, inline text with its block."""
    own = signature(node, inside)
    inside = inside or node.tag in ("article", "main")
    texts: dict[str, int] = {}
    chars = 0
    children: list[list] = []
    pending: list[str] = []

    def flush():
        nonlocal chars
        if t := " ".join("".join(pending).split()):
            chars += len(t)
            texts[mark(t)] = 1  # a page counts once
        pending.clear()

    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if c.tag == "#":
            pending.append(c.text)
        elif c.tag == "br":
            pending.append(" ")
        elif c.tag in BLOCKS or c.tag in DROPPED:
            flush()
            if not dropped(c, inside):
                children.append(skeleton(c, inside))
        elif not dropped(c, inside) and not doubtful(c, inside):
            todo += reversed(c.children)
    flush()
    folded: dict[str, list] = {}
    for c in children:
        folded[c[0]] = merged(folded[c[0]], c, 0) if c[0] in folded else c
    return [own, 1, chars, len(texts), texts, list(folded.values())]


def matched(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes of two trees that match, and the pairs of children."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[5], b[5]
    if [c[0] for c in x] == [c[0] for c in y]:
        return 1 + sum(matched(p, q)[0] for p, q in zip(x, y, strict=True)), [(i, i) for i in range(len(x))]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + matched(p, q)[0])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[len(x)][len(y)], pairs[::-1]


def merged(a: list, b: list, pages: int = 1) -> list:
    """Two aligned trees as one; ``pages`` 0 folds siblings of one page, which count once."""
    _, pairs = matched(a, b)
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[5]), len(b[5]))]:
        children += a[5][i:p] + b[5][j:q]
        if p < len(a[5]) and q < len(b[5]):
            children.append(merged(a[5][p], b[5][q], pages))
        i, j = p + 1, q + 1
    if not pages:
        texts = a[4] | b[4]
        return [a[0], 1, a[2] + b[2], len(texts), texts, children]
    return [a[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], summed(a[4], b[4]), children]


def size(t: list) -> int:
    return 1 + sum(map(size, t[5]))


def pruned(t: list) -> list:
    """Without the least supported nodes, if there are too many, and with bounded summaries."""
    least = 2
    bounded = lambda n: [*n[:4], summed({}, n[4]), [bounded(c) for c in n[5]]]
    t = bounded(t)
    while size(t) > NODES:
        cut = lambda n, k: [*n[:5], [cut(c, k) for c in n[5] if c[1] >= k]]
        t, least = cut(t, least), least * 2
    return t


def tag_of(t: list) -> str:
    return t[0].lstrip("!").split(".")[0]


def constants(t: list, pages: int, inside: bool) -> set[str]:
    """Texts of a node that are the template's."""
    if pages < CONSTANT_PAGES or inside and tag_of(t) in HEADINGS:
        return set()

    def on(share: float) -> set[str]:
        least = max(CONSTANT_PAGES, share * pages)
        return {k for k, n in t[4].items() if n + t[3] / (TEXTS + 1) * (len(t[4]) >= TEXTS) >= least}

    usual = on(CONSTANT)
    if not inside and t[3] - sum(t[4][k] for k in usual) < VARYING * t[1]:
        return usual
    always = on(CONSTANT_INSIDE)
    return always if inside or mass(t, always) <= LESSER * t[2] else set()


def is_place(t: list) -> bool:
    return tag_of(t) in ("article", "main")


def whole_mass(t: list) -> int:
    return t[2] + sum(map(whole_mass, t[5]))


class Wrapper:
    """What a template says: its constant texts, its content nodes and the doubtful nodes that are content."""

    def __init__(self, template: list):
        self.root, pages = template, template[1]
        self.fixed: dict[int, set[str]] = {}
        self.slots: dict[int, float] = {}
        self.opened: set[int] = set()
        places: list[list] = []
        closed: list[list] = []

        def look(t: list, inside: bool, within: int, shut: bool) -> float:
            """Varying characters of a subtree, without those of doubtful nodes."""
            if is_place(t) and not inside and not shut:
                places.append(t)
                inside, within = True, t[1]
                if self.constant_mass(t, within) > LESSER * whole_mass(t):
                    within = 0  # copies of one article, not a template
            fixed = self.fixed[id(t)] = constants(t, within, inside)
            own = t[2] * (1 - sum(t[4][k] for k in fixed) / max(t[3], 1))
            below = 0.0
            for c in t[5]:
                v = look(c, inside, within, shut or c[0][0] == "!")
                if c[0][0] == "!" and not shut:
                    closed.append(c)
                else:
                    below += v
            self.slots[id(t)] = own + below
            return own + below

        everything = look(template, False, pages, False)
        least = PLACED * everything if pages >= CONSTANT_PAGES else 0
        self.places: set[int] = set()
        if (share := sum(self.slots[id(t)] for t in places)) > 0 and share >= least:
            each = {id(t): whole_mass(t) / t[1] for t in places}
            self.places = {i for i, n in each.items() if n >= LARGE * max(each.values())}
        elif pages >= CONSTANT_PAGES:
            whole = everything + sum(self.slots[id(c)] for c in closed)
            self.opened = {id(c) for c in closed if self.slots[id(c)] > 0.5 * whole or tag_of(c) in PARAGRAPHS and self.slots[id(c)] > 0.5 * whole_mass(c)}

    def constant_mass(self, t: list, within: int) -> int:
        return mass(t, constants(t, within, True)) + sum(self.constant_mass(c, within) for c in t[5])

    def blocks(self, root: Node) -> list[str]:
        """The texts of a page's content blocks, in page order."""
        out: list[str] = []

        def walk(node: Node, inside: bool, aligned: list[list], taken: bool) -> None:
            inside = inside or node.tag in ("article", "main")
            taken = taken or any(id(t) in self.places for t in aligned)
            fixed = set().union(*(self.fixed[id(t)] for t in aligned))
            pending: list[str] = []

            def flush():
                t = " ".join("".join(pending).split())
                if taken and t and mark(t) not in fixed:
                    out.append(t)
                pending.clear()

            todo = list(reversed(node.children))
            while todo:
                c = todo.pop()
                if c.tag == "#":
                    pending.append(c.text)
                elif c.tag == "br":
                    pending.append(" ")
                elif c.tag in BLOCKS or c.tag in DROPPED:
                    flush()
                    if not dropped(c, inside):
                        s = signature(c, inside)
                        found = [x for t in aligned for x in t[5] if x[0] == s]
                        if s[0] != "!" or any(id(t) in self.opened for t in found):
                            walk(c, inside, found, taken)
                elif not dropped(c, inside) and not doubtful(c, inside):
                    todo += reversed(c.children)
            flush()

        walk(root, False, [self.root], not self.places)
        return out


def extracted(html: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page by its host's wrapper, or by its own where that finds nothing."""
    root = parse(html)
    if wrapper and (got := wrapper.blocks(root)):
        return "\n\n".join(got)
    return "\n\n".join(Wrapper(skeleton(root)).blocks(root))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


TEMPLATE = "host string, part int, template string"


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the hosts' templates over all pages."""

    def out(part, found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([json.dumps(pruned(t)) for t in found.values()], pa.string())], names=["host", "part", "template"])

    def learn(batches):
        part, found = TaskContext.get().partitionId(), {}
        for batch in sliced(batches, "html"):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                t = skeleton(parse(html))
                found[host] = merged(found[host], t) if host in found else t
                if size(found[host]) > 2 * NODES:
                    found[host] = pruned(found[host])
            if len(found) > HOSTS:
                yield out(part, found)
                found = {}
        yield out(part, found)

    def merge(group: pa.Table) -> pa.Table:
        total = None
        for t in map(json.loads, group.column("template").to_pylist()):
            total = merged(total, t) if total else t
        return pa.Table.from_batches([out(group.column("part")[0].as_py() // FAN, {group.column("host")[0].as_py(): total})])

    found, parts = saved(pages.select("host", "html").mapInArrow(learn, TEMPLATE)), pages.rdd.getNumPartitions()
    while parts > 1:
        found, parts = found.groupBy("host", F.floor(F.col("part") / FAN)).applyInArrow(merge, TEMPLATE), -(-parts // FAN)
    return found.select("host", "template")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of(F.col("url")))
    known = saved(templates(rows))
    size = known.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    shared = None
    if size <= SHIPPED:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in known.toLocalIterator()})
        rows = rows.withColumn("template", F.lit(None).cast("string"))
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        wrappers: dict[str, Wrapper] = {}
        for batch in sliced(batches, "html"):
            texts = []
            for host, html, t in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "template")), strict=True):
                if host not in wrappers:
                    t = shared.value.get(host) if shared else t
                    if len(wrappers) >= 256:
                        wrappers.clear()
                    wrappers[host] = Wrapper(json.loads(t)) if t else None
                texts.append(extracted(html, wrappers[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "host", "html", "template").mapInArrow(run, "page_id long, url string, text string")


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
