"""Main text of web pages by wrapper induction.

Pages are parsed into trees of blocks. What all pages of a host have is counted first: in how many a text stands at a path
of kinds, and how many characters stand there. Every such text that at least half of the pages have, and every path that
holds a share of one in ``SHARES`` of the host's characters, names the page of least digest that has it; these pages are
aligned by simple tree matching and merged into one tree of slots. A template slot has one text in at least half of the
pages, so the tree has a slot for each that any page could show; as each page drawn is likely to have a text that half of
them have, there are few. Then every page of the host is aligned with this tree, and what is counted of each slot (pages
that have it, characters there, those of slots inside that the tree lacks, least and greatest digest of its text) is
summed over all pages. Which pages are merged, their order, and the sums depend on the pages alone, so a wrapper is the
same however rows are dealt. A page is then aligned
with its host's wrapper: slots that most pages have and that never vary are template, and the slot in which most of the
varying text lies holds the content. Inside it, elements whose tag, role or class says menu, notice, advert, form or
comment are left out; where articles or mains are marked, all of them are the content.

Defined results: a null or empty page gives empty text. A host seen in fewer than ``LEAST_PAGES`` pages, or whose pages
are all alike, has no template slots. A page without address is a host of its own name ''. Repeated rows give theirs
each, and count as pages. Tags that never close, nesting of any depth and pages of any length are read as far as they
go; over ``REPEATS`` neighbouring elements of one kind, or turns of up to ``TURNS`` kinds, are a list, which is one slot. Of slots with equally much varying
text the first is taken. An empty table gives none. Input columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_module
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, HOT_KEYS, beside_groups, kept, slices, small_enough, unpacked, written
from .language import host_of

LEAST_PAGES = 3
#: A node's share of its parent's varying text above which the content slot is looked for inside it.
MAIN_SHARE = 0.6
#: A path of kinds that holds one in so many of a host's characters, or more, is in its wrapper.
SHARES = 64
#: Neighbouring elements of one kind above which they are a list.
REPEATS = 32
#: Pages that a wrapper is sent with at least, where it is sent to pages.
GROUP_PAGES = 2000
#: How many kinds may take turns in a list.
TURNS = 6
#: Cells of an alignment that are held, a bit for each of two steps; larger ones are halved first.
CELLS = 1 << 27
#: Slots at which a worker hands on the counts it holds and starts anew.
OPEN_SLOTS = 300_000

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")

# fixed values of HTML: kinds of elements
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br math maction menclose merror mfenced mfrac mglyph mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: What is never the article: by tag, and by names in class, id and role. A name puts out if each of its words does or only says where or how;
#: what the words of ``OF_ARTICLES`` name may be of an article, unless the name speaks of its heading, foot or body ("entry-header", "post-form").
OUT_TAGS = frozenset("nav header footer aside form head select button menu dialog fieldset input object canvas audio video map".split()) | RAW
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus footer form gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget alert dialog".split()
)
PLACE_WORDS = frozenset("area bar block bottom box btn button buttons center col column container desktop fixed floating global group holder icon icons inner item items js layer left link links list main mobile module outer page pane panel primary rail region right row secondary section site slot sticky sub thread tile top unit wide wrap wrapper".split())
OF_ARTICLES = frozenset("article articles content entry news post posts reader readers story stories user users".split())
PARTS = frozenset("alert footer form header legal notice search".split())
MAIN_TAGS = frozenset(("article", "main"))
#: What no class puts out: their classes speak of the page.
WHOLE = frozenset(("html", "body", "main"))


def _flat(f):
    """A recursive function, written as a generator that yields its inner calls, without the limit of the call stack."""

    @functools.wraps(f)
    def run(*args):
        open_, value = [f(*args)], None
        while open_:
            try:
                inner = open_[-1].send(value)
            except StopIteration as end:
                open_.pop()
                value = end.value
            else:
                open_.append(inner)
                value = None
        return value

    run.step = f
    return run


class Node:
    """An element that makes a block: kids are nodes and the texts of blocks, in order."""

    __slots__ = ("key", "kids", "out", "tag")

    def __init__(self, tag: str, names: str = "", out: bool = False):
        self.tag, self.kids, self.out = tag, [], out
        self.key = f"{tag}.{names}" if names else tag


@functools.lru_cache(20_000)
def _names(attributes: str) -> tuple[str, bool, bool]:
    """Words of class, id and role without numbers; whether they put the element out; whether they make it the main part."""
    words, out, main = [], False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() in ("hidden", "aria-hidden"):
            out |= name.lower() == "hidden" or value.lower() == "true"
            continue
        for token in value.split():
            found = [x.lower() for x in _WORDS.findall(token)]
            words += found
            says = OUT_WORDS.intersection(found)
            out |= bool(says) and OUT_WORDS.union(PLACE_WORDS, () if says <= PARTS else OF_ARTICLES).issuperset(found)
        main |= name.lower() == "role" and value.lower() == "main"
    return " ".join(words), out and not main, main


class _Tags:
    """Where tags end, in one pass over a page: what was once looked for in vain isn't looked for again."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.vain: set[int] = set()  # opening quotes after which no tag ends
        self.open: dict[str, int] = {}  # by quote, the place after which there is none

    def _end(self, at: int) -> int:
        """The place of the first > outside quotes from here on, or -1."""
        path = []
        while m := _STOP.search(self.source, at):
            quote, i = m[0], m.start()
            if quote == ">":
                return i
            path.append(i)
            if i in self.vain or i >= self.open.get(quote, len(self.source)):
                break
            close = self.source.find(quote, i + 1)
            if close < 0:
                self.open[quote] = i
                break
            at = close + 1
        self.vain.update(path)
        return -1

    def at(self, start: int) -> tuple[int, str, str, str] | None:
        """Of what begins here: the place after it, a slash if it closes, its name (empty for comments and the like) and its attributes; None for a plain sign. A quote that never closes is a sign like others."""
        if start > self.last and not self.source.startswith("<!--", start):
            return None
        if m := _MARK.match(self.source, start):
            return m.end(), "", "", ""
        if not (m := _NAME.match(self.source, start)):
            return None
        end = self._end(m.end())
        end = self.source.find(">", m.end()) if end < 0 else end
        return (end + 1, m[1], m[2], self.source[m.end() : end]) if end >= 0 else None


def parse(source: str) -> Node:
    root = Node("#root")
    tags = _Tags(source)
    stack: list[Node] = [root]
    open_: dict[str, int] = {}
    inline: list[str] = []
    low = None
    at, n = 0, len(source)

    def flush() -> None:
        if inline:
            text = " ".join(html_module.unescape("".join(inline)).split())
            if text:
                stack[-1].kids.append(text)
            inline.clear()

    def close(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        if not any(open_.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                for x in stack[i:]:
                    open_[x.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while at < n:
        start = source.find("<", at)
        if start < 0:
            inline.append(source[at:])
            break
        if start > at:
            inline.append(source[at:start])
        m = tags.at(start)
        if m is None:
            inline.append("<")
            at = start + 1
            continue
        at, closes, name, attributes = m
        if not name:
            continue
        tag = name.lower()
        if closes:
            if tag in INLINE:
                continue
            close((tag,))
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                low = source.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == n else -1
                if end < 0 and len(low) != n:
                    found = re.compile(f"</{tag}", re.I).search(source, at)
                    end = found.start() if found else -1
                if end < 0:
                    break
                at = source.find(">", end) + 1 or n
            continue
        if tag in INLINE:
            if tag == "br":
                inline.append(" ")
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        if tag in SIBLINGS:
            close(SIBLINGS[tag], STOPS[tag])
        if tag in VOID:
            continue
        names, out, main = _names(attributes) if attributes else ("", False, False)
        node = Node("main" if main else tag, names, (out and tag not in WHOLE) or tag in OUT_TAGS)
        stack[-1].kids.append(node)
        stack.append(node)
        open_[node.tag] = open_.get(node.tag, 0) + 1
    flush()
    return root


class Slot:
    """A node of a wrapper: pages that have it, text if it never varied (None if it did), characters of text in all, slots inside. ``nodes``: of a single page, the nodes or texts it stands for. ``at``: its place in a wrapper that was read. ``shape`` tells its kind and those inside, ``size`` how many slots there are."""

    __slots__ = ("at", "chars", "key", "kids", "n", "nodes", "shape", "size", "text", "varying")

    def __init__(self, key, n, text, chars, kids, nodes=None):
        self.key, self.n, self.text, self.chars, self.kids, self.nodes, self.varying, self.at = key, n, text, chars, kids, nodes, None, None
        self.shape, self.size = hash((key, *[k.shape for k in kids])), 1 + sum(k.size for k in kids)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


@_flat
def slots(node: Node) -> Slot:
    """The wrapper of a single page. Neighbouring leaves of one kind are one repeated slot, whatever their number; so are long lists, of one kind or of a few kinds in turn."""
    kids: list[Slot] = []
    groups: list[tuple[str, list]] = []
    for k in node.kids:
        leaf = isinstance(k, str) or all(isinstance(x, str) for x in k.kids)
        key = "#" if isinstance(k, str) else k.key + "+" * leaf
        if groups and groups[-1][0] == key:
            groups[-1][1].append(k)
        else:
            groups.append((key, [k]))
    for key, nodes in _in_turn(groups):
        if key.endswith(")*"):
            text = "\n".join(_strings(nodes))
            kids.append(Slot(key, 1, _digest(text), len(text), [], nodes))
        elif key == "#" or key.endswith("+"):
            text = "\n".join(x if isinstance(x, str) else "\n".join(x.kids) for x in nodes)
            kids.append(Slot(key, 1, _digest(text), len(text), [], nodes))
        elif len(nodes) > REPEATS:
            text = "\n".join(_strings(nodes))
            kids.append(Slot(key + "*", 1, _digest(text), len(text), [], nodes))
        else:
            for k in nodes:
                kids.append((yield slots.step(k)))
    return Slot(node.key, 1, "", 0, kids, [node])


def _in_turn(groups: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """Groups of kinds that take turns (up to TURNS of them) more than REPEATS times as one."""
    if len(groups) <= 2 * REPEATS:
        return groups
    out, at = [], 0
    keys = [k for k, _ in groups]
    # by period, how far from each place on the keys repeat with it
    runs = []
    for turn in range(2, TURNS + 1):
        run = [0] * (len(keys) + 1)
        for i in range(len(keys) - turn - 1, -1, -1):
            run[i] = run[i + 1] + 1 if keys[i] == keys[i + turn] else 0
        runs.append(run)
    while at < len(groups):
        for turn, run in enumerate(runs, 2):
            times = run[at] // turn + 1
            if times > REPEATS:
                part = groups[at : at + times * turn]
                out.append((f"({','.join(keys[at : at + turn])})*", [n for _, nodes in part for n in nodes]))
                at += len(part)
                break
        else:
            out.append(groups[at])
            at += 1
    return out


def _strings(nodes: list) -> list[str]:
    """All texts inside, in order."""
    out, left = [], nodes[::-1]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += reversed(x.kids)
    return out


@_flat
def matching(a: Slot, b: Slot) -> tuple[float, list]:
    """Simple tree matching of two slots of one key: its weight, and the matched pairs of their kids with pairs inside."""
    x, y = a.kids, b.kids
    if len(x) == len(y) and all(p.key == q.key for p, q in zip(x, y, strict=True)):
        pairs, weight = [], 1.0
        for p, q in zip(x, y, strict=True):
            w, inner = (yield matching.step(p, q)) if p.kids and q.kids else (1.0, [])
            weight += w
            pairs.append((p, q, inner))
        return weight, pairs
    pairs = [(p, q) for p, q in (yield _aligned.step(x, y))]
    whole, out = 1.0, []
    for p, q in pairs:
        w, inner = (yield matching.step(p, q)) if p.kids and q.kids else (1.0, [])
        whole += w + _alike(p, q)
        out.append((p, q, inner))
    return whole, out


def _alike(p: Slot, q: Slot) -> float:
    return 0.5 * (not p.kids and p.text is not None and p.text == q.text)


@_flat
def _row(p: Slot, y: list[Slot], keys: np.ndarray, texts: np.ndarray, shapes: np.ndarray, numbers: dict) -> np.ndarray:
    """What pairs of p with each of y weigh; 0 where kinds differ. Those of one shape match slot by slot; of the others only those that both have kids are matched inside."""
    same = keys == numbers["key", p.key]
    w = same.astype(float)
    if not p.kids:
        if p.text is not None:
            w += 0.5 * (same & (texts == numbers["text", p.text]))
        return w
    alike = shapes == p.shape
    w[alike] = p.size
    for j in np.flatnonzero(same & ~alike):
        if y[j].kids:
            w[j] = (yield matching.step(p, y[j]))[0]
    return w


@_flat
def _aligned(x: list[Slot], y: list[Slot]) -> list[tuple[Slot, Slot]]:
    """The pairs, in order, that weigh most together. Rows of the table are made one after another; of each two bits a cell are
    held. A table of more than CELLS is halved where the best way crosses its middle, until its parts are smaller."""
    if not x or not y:
        return []
    numbers: dict = {}
    for s in (*x, *y):
        numbers.setdefault(("key", s.key), len(numbers))
        numbers.setdefault(("text", s.text), len(numbers))
    keys = np.array([numbers["key", q.key] for q in y])
    texts = np.array([numbers["text", q.text] if not q.kids and q.text is not None else -1 for q in y])
    shapes = np.array([q.shape for q in y])
    n = len(y)
    if len(x) * n > CELLS and len(x) > 1:
        half = len(x) // 2
        down = np.zeros(n + 1)
        for p in x[:half]:
            down = _next(down, (yield _row.step(p, y, keys, texts, shapes, numbers)))
        up = np.zeros(n + 1)
        for p in x[:half - 1 : -1]:
            up = _next(up, (yield _row.step(p, y, keys, texts, shapes, numbers))[::-1])
        cut = int(np.argmax(down + up[::-1]))
        return (yield _aligned.step(x[:half], y[:cut])) + (yield _aligned.step(x[half:], y[cut:]))
    ups, lefts = [], []
    row = np.zeros(n + 1)
    for p in x:
        above = row
        row = _next(above, (yield _row.step(p, y, keys, texts, shapes, numbers)))
        ups.append(np.packbits(row[1:] == above[1:]))
        lefts.append(np.packbits(row[1:] == row[:-1]))
    pairs, i, j = [], len(x), n
    while i and j:
        at, bit = (j - 1) >> 3, 128 >> ((j - 1) & 7)
        if ups[i - 1][at] & bit:
            i -= 1
        elif lefts[i - 1][at] & bit:
            j -= 1
        else:
            pairs.append((x[i - 1], y[j - 1]))
            i, j = i - 1, j - 1
    return pairs[::-1]


def _next(above: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The row below: each cell the best of the cell above, the one before, and a pair added to the one between."""
    row = above.copy()
    row[1:] = np.maximum(row[1:], np.where(w > 0, above[:-1] + w, 0.0))
    return np.maximum.accumulate(row)


@_flat
def merged(a: Slot, b: Slot, pairs: list | None = None) -> Slot:
    """The wrapper of the pages of both: matched slots once, the others kept where they stand."""
    pairs = matching(a, b)[1] if pairs is None else pairs
    kids: list[Slot] = []
    i = j = 0
    for p, q, inner in pairs:
        while a.kids[i] is not p:
            kids.append(a.kids[i])
            i += 1
        while b.kids[j] is not q:
            kids.append(b.kids[j])
            j += 1
        kids.append((yield merged.step(p, q, inner)))
        i, j = i + 1, j + 1
    kids += a.kids[i:] + b.kids[j:]
    return Slot(a.key, a.n + b.n, a.text if a.text == b.text else None, a.chars + b.chars, kids)


def count(s: Slot) -> int:
    n, left = 0, [s]
    while left:
        x = left.pop()
        n += 1
        left += x.kids
    return n


def dump(s: Slot) -> str:
    """A row a slot, each before those inside it, with the number of these."""
    rows, left = [], [s]
    while left:
        x = left.pop()
        rows.append([x.key, x.n, x.text, x.chars, len(x.kids)])
        left += reversed(x.kids)
    return json.dumps(rows, separators=(",", ":"))


def load(text: str) -> Slot:
    done: list[Slot] = []
    for key, n, own, chars, inside in reversed(json.loads(text)):
        kids = done[len(done) - inside :][::-1]
        del done[len(done) - inside :]
        done.append(Slot(key, n, own, chars, kids))
    left, at = [done[0]], 0
    while left:
        x = left.pop()
        x.at, at = at, at + 1
        left += reversed(x.kids)
    return done[0]


@_flat
def _varying(s: Slot) -> int:
    if s.varying is None:
        total = s.chars if s.text is None or s.kids else 0
        for k in s.kids:
            total += yield _varying.step(k)
        s.varying = total
    return s.varying


@_flat
def _texts(node, gone: set[int], inside: bool = False) -> list[str]:
    """Block texts in page order; ``inside``: within an article, where a header with a heading is its title."""
    if isinstance(node, str):
        return [node]
    if id(node) in gone:
        return []
    out, title = [], inside and node.tag == "header" and any(not isinstance(k, str) and k.tag in ("h1", "h2") for k in node.kids)
    if node.out and not title:
        return out
    inside = inside or node.tag in MAIN_TAGS
    for k in node.kids:
        out += yield _texts.step(k, gone, inside)
    return out


@_flat
def _mains(node: Node) -> list[Node]:
    out = []
    for k in node.kids:
        if not isinstance(k, str) and not k.out:
            out += [k] if k.tag in MAIN_TAGS else (yield _mains.step(k))
    return out


def main_text(source: str | None, wrapper: Slot | None = None) -> str:
    """Main text of a page, by its host's wrapper or else by itself."""
    if not source:
        return ""
    page = parse(source)
    top, gone = page, set()
    own = slots(page)
    use = wrapper if wrapper is not None and wrapper.n >= LEAST_PAGES and _varying(wrapper) else None
    if use is not None:
        pairs = matching(own, use)[1]

        left = [pairs]
        while left:
            for p, q, inner in left.pop():
                if not p.kids and q.n >= LEAST_PAGES and 2 * q.n >= use.n and q.text is not None and q.text == p.text:
                    gone.update(id(x) for x in p.nodes if not isinstance(x, str))
                left.append(inner)
        here = pairs
        while here:  # down to the slot that holds most of the varying text
            open_ = [(p, q, inner, _varying(q)) for p, q, inner in here if not p.nodes or isinstance(p.nodes[0], str) or not p.nodes[0].out]
            whole = sum(v for *_, v in open_)
            best = max(open_, key=lambda x: x[3], default=None)
            if best is None or not whole or best[3] < MAIN_SHARE * whole or not best[0].kids:
                break
            top, here = best[0].nodes[0], best[2]
    parts = [top]
    if top.tag not in MAIN_TAGS:
        mains = _mains(top)
        if mains and top is not page and 2 * _size(mains, gone) < _size([top], gone):
            mains = []  # marked articles that are but a small part of the content slot are others' teasers
        parts = mains or ([] if top is page else _mains(page)) or parts
    found = "\n".join(x for k in parts for x in _texts(k, gone, True))
    return found if found or not gone else "\n".join(x for k in parts for x in _texts(k, set(), True))


def _size(nodes: list[Node], gone: set[int]) -> int:
    return sum(len(x) for k in nodes for x in _texts(k, gone, True))


@functools.lru_cache(500)
def _loaded(text: str) -> Slot:
    return load(text)


class _Wrappers:
    """The wrapper of a row's host: from what all workers have, if that is small, or from a row that comes before those of
    its group. Hosts are groups, the largest of them (fewer than HOT_KEYS) several, so that each task has few; a wrapper is
    sent once a group. ``rows`` has host__ and html__ (not null), and other columns before these."""

    def __init__(self, rows: DataFrame, wrappers: DataFrame):
        size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 32)).first()[0] or 0
        self.shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()}) if size <= BROADCAST_BYTES else None
        others = [c for c in rows.columns if c not in ("host__", "html__")]
        if self.shared:
            self.rows = rows.select(*others, "host__", F.lit(None).cast("string").alias("wrapper__"), "html__")
            return
        counts = rows.groupBy("host__").agg(F.count("*").alias("n__"))
        total = counts.agg(F.coalesce(F.sum("n__"), F.lit(0))).first()[0]
        part = max(GROUP_PAGES, total // HOT_KEYS)
        hot = F.broadcast(counts.filter(F.col("n__") > part).select("host__", F.ceil(F.col("n__") / part).cast("int").alias("parts__")))
        salt = F.pmod(F.xxhash64("html__"), F.coalesce("parts__", F.lit(1))).cast("int")
        pages = rows.join(hot, "host__", "left").select(*others, "host__", salt.alias("salt__"), F.lit(1).alias("order__"), F.lit(None).cast("string").alias("wrapper__"), "html__")
        named = wrappers.select(F.col("host").alias("host__"), F.col("wrapper").alias("wrapper__")).join(hot, "host__", "left")
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("parts__", F.lit(1)) - 1))
        first = named.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others], "host__", salts.alias("salt__"), F.lit(0).alias("order__"), "wrapper__", F.lit(None).cast("string").alias("html__"))
        dealt = pages.union(first).repartition("host__", "salt__").sortWithinPartitions("host__", "salt__", "order__")
        self.rows = dealt.select(*others, "host__", "wrapper__", "html__")

    def of(self):
        """A function that makes of each batch (host__, wrapper__ and html__ last) its page rows, with each one's wrapper."""
        shared = self.shared

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Slot | None]]]:
            now: tuple[str | None, Slot | None] = (None, None)
            for b in batches:
                hosts, texts, pages = (c.to_pylist() for c in b.columns[-3:])
                if shared is not None:
                    known = (shared.value.get(h) for h in hosts)
                    yield b, [_loaded(t) if t else None for t in known]
                    continue
                found, is_page = [], []
                for host, text, page in zip(hosts, texts, pages, strict=True):
                    is_page.append(page is not None)
                    if page is None:
                        now = (host, _loaded(text))
                    else:
                        found.append(now[1] if host == now[0] else None)
                yield b.filter(pa.array(is_page, pa.bool_())), found

        return find


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def marks(page: Slot) -> tuple[set[int], dict[int, int]]:
    """Numbers of the texts of a page with the kinds they stand in, and characters by path of kinds."""
    texts, paths, left = set(), {}, [(page, b"")]
    inside: dict[tuple[bytes, str], bytes] = {}
    while left:
        s, above = left.pop()
        if (path := inside.get((above, s.key))) is None:
            path = inside[above, s.key] = hashlib.blake2b(above + b"\0" + s.key.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if s.kids:
            left += [(k, path) for k in s.kids]
        elif s.chars:
            texts.add(_number(path, s.text.encode()))
            at = _number(path)
            paths[at] = paths.get(at, 0) + s.chars
    return texts, paths


def _marked(batches):
    """host, mark, n, chars, digest of pages (host, digest, html): summed by mark as far as a worker holds them; mark 0 stands for the host."""
    held: dict[tuple[str, int], list[int]] = {}

    def add(key: tuple[str, int], n: int, chars: int, digest: int) -> None:
        if (x := held.get(key)) is None:
            held[key] = [n, chars, digest]
        else:
            x[0], x[1], x[2] = x[0] + n, x[1] + chars, min(x[2], digest)

    def out():
        hosts, numbers = zip(*held, strict=True)
        n, chars, digests = zip(*held.values(), strict=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (numbers, n, chars, digests)]], names=["host", "mark", "n", "chars", "digest"])

    for b in slices(batches, "html", holder=__name__):
        for host, digest, source in zip(*[c.to_pylist() for c in b.columns], strict=True):
            texts, paths = marks(slots(parse(source)))
            add((host, 0), 1, sum(paths.values()), digest)
            for x in texts:
                add((host, x), 1, 0, digest)
            for x, chars in paths.items():
                add((host, x), 0, chars, digest)
            if len(held) > OPEN_SLOTS:
                yield out()
    if held:
        yield out()


def _named(rows: DataFrame) -> DataFrame:
    """host, digest of the pages whose slots make the wrappers, by what all ``rows`` (host, digest, html) have."""
    found = rows.mapInArrow(_marked, "host string, mark long, n long, chars long, digest long")
    sums = written(found.groupBy("host", "mark").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("digest").alias("digest")), "marks")
    hosts = written(sums.groupBy("host").agg(F.max(F.when(F.col("mark") == 0, F.col("n"))).alias("pages"), F.max(F.when(F.col("mark") == 0, F.col("chars"))).alias("all"), F.count("*").alias("marks")), "hosts")
    half = (F.col("n") >= LEAST_PAGES) & (2 * F.col("n") >= F.col("pages"))
    share = (F.col("chars") > 0) & (SHARES * F.col("chars") >= F.col("all"))
    return beside_groups(sums, hosts, ["host"], "marks").filter((F.col("mark") == 0) | half | share).select("host", "digest").distinct()


def _chosen(rows: DataFrame) -> DataFrame:
    """host, digest, html of the named pages of ``rows`` (host, digest, html): a page once, however many copies there are."""
    named = written(_named(rows), "named")
    found = rows.join(F.broadcast(named) if small_enough(named, 96) else named, ["host", "digest"]).select("host", "digest", "html")

    def once(batches):
        seen = set()
        for b in batches:
            keep = []
            for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keep.append(k not in seen)
                seen.add(k)
            yield b.filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(once, "host string, digest long, html string").dropDuplicates(["host", "digest"])


def _merged(batches):
    """Of pages sorted by host and digest: one tree of slots a host; only one is held at a time."""
    host = held = None
    for b in batches:
        done = []
        for name, source in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = slots(parse(source))
            if name != host:
                if held is not None:
                    done.append((host, dump(held)))
                host, held = name, own
            else:
                held = merged(held, own)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["host", "wrapper"])
    if held is not None:
        yield pa.RecordBatch.from_pydict({"host": [host], "wrapper": [dump(held)]})


def aligned(own: Slot, wrapper: Slot) -> Iterator[tuple[Slot, Slot, int]]:
    """Pairs of a page's slots and the wrapper's that simple tree matching gives, and the characters of the page's slot that belong to no pair further inside."""
    left = [(own, wrapper, matching(own, wrapper)[1])]
    while left:
        p, q, inner = left.pop()
        matched = {id(x) for x, _, _ in inner}
        yield p, q, p.chars + sum(_chars(k) for k in p.kids if id(k) not in matched)
        left += inner


def _chars(s: Slot) -> int:
    n, left = 0, [s]
    while left:
        x = left.pop()
        n += x.chars
        left += x.kids
    return n


def _counted(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, at, n, chars, low, high of each slot over all ``rows`` (host, html)."""
    held = _Wrappers(rows.select(F.col("host").alias("host__"), F.col("html").alias("html__")), wrappers)
    find = held.of()

    def run(batches):
        counts: dict[str, tuple[list, list, list, list]] = {}
        size = 0

        def out():
            cols = [[], [], [], [], [], []]
            for host, (n, chars, low, high) in counts.items():
                for col, x in zip(cols, ([host] * len(n), range(len(n)), n, chars, low, high), strict=True):
                    col += x
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["host", "at", "n", "chars", "low", "high"])

        for b, wrappers in find(slices(batches, "html__", holder=__name__)):
            for host, source, wrapper in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), wrappers, strict=True):
                if wrapper is None:
                    continue
                if host not in counts:
                    k = count(wrapper)
                    counts[host] = ([0] * k, [0] * k, [None] * k, [None] * k)
                    size += k
                n, chars, low, high = counts[host]
                for p, q, here in aligned(slots(parse(source)), wrapper):
                    i = q.at
                    n[i] += 1
                    chars[i] += here
                    if low[i] is None or p.text < low[i]:
                        low[i] = p.text
                    if high[i] is None or p.text > high[i]:
                        high[i] = p.text
            if size > OPEN_SLOTS:
                yield out()
                size = 0
        if counts:
            yield out()

    parts = held.rows.mapInArrow(run, "host string, at int, n long, chars long, low string, high string")
    return parts.groupBy("host", "at").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high"))


def _filled(batches):
    """host, wrapper of host, wrapper and counts by place."""
    for b in batches:
        done = []
        for host, text, counts in zip(*[c.to_pylist() for c in b.columns], strict=True):
            rows = json.loads(text)
            for c in counts:
                rows[c["at"]][1:4] = c["n"], c["low"] if c["low"] == c["high"] and c["n"] else None, c["chars"]
            done.append((host, json.dumps(rows, separators=(",", ":"))))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["host", "wrapper"])


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper for each host: slots by what all its pages have in common, counts by all."""
    rows = pages.select(F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.col(html).cast("string").alias("html")).filter("html <> ''")
    chosen = _chosen(rows.select("host", F.xxhash64("html").alias("digest"), "html"))
    trees = written(chosen.repartition("host").sortWithinPartitions("host", "digest").mapInArrow(_merged, "host string, wrapper string"), "trees")
    counts = _counted(rows, trees).groupBy("host").agg(F.collect_list(F.struct("at", "n", "chars", "low", "high")).alias("counts"))
    return trees.join(counts, "host").select("host", "wrapper", "counts").mapInArrow(_filled, "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but ``html`` by default), text and n_chars of every page.

    Wrappers are sent to all workers if their measured size is at most ``BROADCAST_BYTES``; beyond that pages come to
    their wrapper in groups of a host's, of which the largest hosts have several.
    """
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    names = [c for c in keep if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*kept(names), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html__"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host__"))
    held = _Wrappers(rows, written(induce(pages, url, html), "wrappers"))
    find = held.of()
    frame = held.rows
    out = frame.select(*["kept__"] * bool(names)).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b, wrappers in find(slices(batches, "html__", holder=__name__)):
            texts = [main_text(h, w) for h, w in zip(b.column(b.num_columns - 1).to_pylist(), wrappers, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=out.names)

    return unpacked(frame.mapInArrow(run, out), names, ["text", "n_chars"])
