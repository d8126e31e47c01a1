"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector: hashed names of
the tags (with class, id and role words) on its path, hashed words of its text, and a few
measures. A bidirectional LSTM in numpy reads the whole sequence, so every block is
classified in the context of the page, and the blocks labelled as content are joined.

The labeller is trained here, on a bounded sample of the pages: a weak teacher reads the
sample's containers (what stands in nav, footer, aside, ad and such is boilerplate), and
further boilerplate of other kinds, with borrowed text, is planted into the training
pages, so that paths, words and context all have to carry the decision.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.common import arrow_map

PATH_SLOTS, WORD_SLOTS, MEASURES = 512, 256, 6
HIDDEN = 16
SAMPLE, SAMPLE_CHARS = 200, 40_000
EPOCHS = 10
FITTED = 200  # pages in other shells that the labeller is fitted on, at least
ENTRIES = 1 << 17  # set slots that are summed at once
TOGETHER = 50_000  # blocks, padded, that the labeller reads at once; a longer page is read alone

# Comments, CDATA, declarations, tags. Nothing is read twice: a tag whose quotes or bracket never close
# matches with an empty last group, and the page is read on by :func:`careful_tokens`.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?", re.S)
QUOTED = re.compile(r"[\"'>]")
NEAR = 64  # tokens after a raw element's start that are searched before all ends are matched at once
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
# Fixed values of HTML: elements whose content is no text (those of TO_END go to the page's end if nothing ends
# them, the others count only with their own end tag), elements without content, inline elements.
TO_END = frozenset("script style".split())
RAW = TO_END | frozenset("noscript template textarea select iframe svg canvas title annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img "
    "object math semantics mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = frozenset("li dt dd tr td th option".split())
# What the weak teacher takes for boilerplate containers.
BAD_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside "
    "cookie cookies consent notice gdpr newsletter subscribe signup login share social related recommended comment comments reply disqus widget popup modal".split()
)


class Node:
    """An open element: its names and, for the path down to it, hashed names and counts. What a path
    has in hashes is shared with the parent where the element adds none, so deep pages stay small."""

    __slots__ = ("parent", "tag", "names", "count", "slots", "last", "bad", "article")

    def __init__(self, parent: Node | None, tag: str, found: list[str]) -> None:
        self.parent, self.tag, self.names = parent, tag, found
        self.count = len(found) + (parent.count if parent else 0)
        self.article = parent is not None and parent.article
        self.bad = parent is not None and parent.bad
        for n in found:
            self.article = self.article or n in ("article", "main")
            if (n in BAD_TAGS or n in BAD_WORDS) and not (n == "header" and self.article):  # an article's header holds its headline
                self.bad = True
        self.slots, self.last = (parent.slots, parent.last) if parent else (frozenset(), "")
        new = set()
        for n in found:
            if n not in ("html", "body"):
                new.add(slot(n, PATH_SLOTS))
                if self.last:
                    new.add(slot(f"{self.last}>{n}", PATH_SLOTS))
                self.last = n
        if not new <= self.slots:
            self.slots = self.slots | new

    def nearest(self, most: int) -> list[str]:
        """The last ``most`` names of the path."""
        out: list[list[str]] = []
        held, node = 0, self
        while node is not None and held < most:
            out.append(node.names)
            held += len(node.names)
            node = node.parent
        return [n for found in reversed(out) for n in found][-most:]


class Block:
    """A text block: its path as a list of names, or as the innermost open element."""

    __slots__ = ("node", "text", "linked", "bad")

    def __init__(self, path: list[str] | Node | None, text: str, linked: int = 0, bad: bool = False) -> None:
        self.node = Node(None, "", path) if isinstance(path, list) else path
        self.text, self.linked, self.bad = text, linked, bad

    @property
    def path(self) -> list[str]:
        return self.node.nearest(self.node.count) if self.node else []


def names(tag: str, attributes: str) -> list[str]:
    out = [tag]
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            out += NAME_WORD.findall((m[2] or m[3] or m[4] or "").lower())
    return out


def tokens(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of each token; tag is empty for all but tags, and the
    attributes of CDATA are its text."""
    out = []
    for m in TOKEN.finditer(page):
        tag = m[2]
        if tag:
            if not m[4]:
                return out + careful_tokens(page, m.start())
            out.append((m.start(), m.end(), m[1] == "/", tag.lower(), m[3]))
        else:
            out.append(other(m))
    return out


def other(m: re.Match) -> tuple[int, int, bool, str, str]:
    return (m.start(), m.end(), False, "", m[0][9:-3] if m[0].startswith("<![CDATA[") else "")


def careful_tokens(page: str, at: int) -> list[tuple[int, int, bool, str, str]]:
    """The same from ``at`` on, for pages with brackets or quotes that never close: where a tag ends is
    looked up in a table made once, from the last quote or bracket to the first. A tag without an
    end is text."""
    places = [m.start() for m in QUOTED.finditer(page, at)]
    plain, double, single = -1, -1, -1  # where a tag ends that is outside quotes, in double, in single ones
    ends = [-1] * (len(places) + 1)
    for k in range(len(places) - 1, -1, -1):
        c = page[places[k]]
        if c == ">":
            plain = places[k] + 1
        elif c == '"':
            plain, double = double, plain
        else:
            plain, single = single, plain
        ends[k] = plain
    out = []
    at = page.find("<", at)
    while at >= 0:
        tag, found = TAG.match(page, at), None
        if tag:
            end = ends[bisect_left(places, tag.end())]
            if end >= 0:
                found = (at, end, tag[1] == "/", tag[2].lower(), page[tag.end() : end - 1])
        elif page.startswith(("<!", "<?"), at):
            found = other(OTHER.match(page, at))
        if found:
            out.append(found)
        at = page.find("<", found[1] if found else at + 1)
    return out


class RawEnds:
    """Where elements without text end: with their own end tag, unless something around them ends
    first. Script and style go to their end tag, or to the page's end."""

    def __init__(self, page: str, found: list[tuple[int, int, bool, str, str]]) -> None:
        self.page, self.found = page, found
        self.ends: dict[int, int] | None = None
        self.to_end: dict[str, list[tuple[int, int]]] = {}

    def end_of_script(self, tag: str, start: int) -> int:
        if tag not in self.to_end:
            self.to_end[tag] = [(m.start(), m.end()) for m in re.finditer(rf"</{tag}\b[^>]*>?", self.page, re.I)]
        k = bisect_left(self.to_end[tag], (start, start))
        return self.to_end[tag][k][1] if k < len(self.to_end[tag]) else len(self.page)

    def end(self, k: int, opened: Counter) -> int | None:
        """Where the raw element of token k ends, None if it has no end of its own."""
        tag = self.found[k][3]
        if tag in TO_END:
            return self.end_of_script(tag, self.found[k][1])
        if self.ends is None:
            inside: list[str] = []
            skip = 0
            for start, end, closing, name, attributes in self.found[k + 1 : k + NEAR]:
                if not name or start < skip:
                    continue
                if closing:
                    if name in inside:
                        while inside.pop() != name:
                            pass
                    elif name == tag:
                        return end
                    elif opened[name]:
                        return None
                elif name in TO_END and not attributes.endswith("/"):
                    skip = self.end_of_script(name, end)
                elif name not in VOID and not attributes.endswith("/"):
                    inside.append(name)
            self.ends = self.all_ends()
        return self.ends.get(k)

    def all_ends(self) -> dict[int, int]:
        """Ends of all elements that have their own, in one pass."""
        ends: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        held: Counter = Counter()
        skip = 0
        for k, (start, end, closing, name, attributes) in enumerate(self.found):
            if not name or start < skip:
                continue
            if closing:
                while held[name]:
                    top, at = stack.pop()
                    held[top] -= 1
                    if top == name:
                        ends[at] = end
                        break
            elif name in TO_END and not attributes.endswith("/"):
                skip = self.end_of_script(name, end)
            elif name not in VOID and not attributes.endswith("/"):
                stack.append((name, k))
                held[name] += 1
        return ends


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order, in time linear in the page. Unclosed and misnested tags close as
    browsers close them: an end tag closes everything above its start tag, one without a start tag
    is ignored."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter = Counter()
    text: list[str] = []
    linked = 0
    at = 0
    found = tokens(page)
    raw_ends = RawEnds(page, found)

    def end_block() -> None:
        nonlocal linked
        if text:
            joined = SPACES.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(Block(stack[-1] if stack else None, joined, linked))
            text.clear()
        linked = 0

    def close_until(tag: str) -> None:
        while stack:
            top = stack.pop().tag
            opened[top] -= 1
            if top == tag:
                return

    for k, (start, end, closing, tag, attributes) in enumerate(found):
        if start < at:
            continue
        if start > at:
            text.append(page[at:start])
            if opened["a"]:
                linked += start - at
        at = end
        if not tag:
            if attributes:
                text.append(attributes)
            continue
        if tag not in INLINE and (not closing or opened[tag] or tag in ("p", "br")):  # other stray end tags are ignored
            end_block()
        if closing:
            if opened[tag]:
                close_until(tag)
            continue
        empty = tag in VOID or attributes.endswith("/")
        if tag in RAW and not empty:
            past = raw_ends.end(k, opened)
            if past is not None:
                at = past
                continue
        if opened["p"] and tag in CLOSES_P:
            close_until("p")
        if tag in SAME_CLOSES and stack and stack[-1].tag == tag:
            close_until(tag)
        if not empty:
            stack.append(Node(stack[-1] if stack else None, tag, names(tag, attributes)))
            opened[tag] += 1
    if at < len(page):
        text.append(page[at:])
        if opened["a"]:
            linked += len(page) - at
    end_block()
    return out


def slot(name: str, slots: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % slots


def encode_block(b: Block) -> tuple[list[int], list[float]]:
    """(slots that are set, measures) of a block."""
    found = set(b.node.slots) if b.node else set()
    words = b.text.lower().split(" ")
    found |= {PATH_SLOTS + slot(w, WORD_SLOTS) for w in set(words)}
    n = len(b.text)
    measures = [
        min(1.0, np.log1p(n) / 8),
        min(1.0, np.log1p(len(words)) / 6),
        min(1.0, b.linked / n),
        1.0 if b.text[-1] in ".!?:" else 0.0,
        min(1.0, (b.node.count if b.node else 0) / 12),
        sum(c.isdigit() for c in b.text) / n,
    ]
    return sorted(found), measures


def weighted(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots laid end to end, weights, counts): path and word slots of a block weigh the same in
    sum of squares, so that many words do not drown the path."""
    counts = np.array([len(f) for f in found])
    flat = np.concatenate([np.array(f, dtype=np.int64) for f in found])
    on_path = flat < PATH_SLOTS
    paths = np.add.reduceat(on_path.astype(np.int64), np.cumsum(counts) - counts)
    sizes = np.where(on_path, np.repeat(paths, counts), np.repeat(counts - paths, counts))
    return flat, 1 / np.sqrt(sizes), counts


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        wide, h = PATH_SLOTS + WORD_SLOTS + MEASURES, HIDDEN
        self.p = {}
        for d in ("f", "b"):
            self.p[f"x{d}"] = rng.standard_normal((wide, 4 * h)) * 0.1
            self.p[f"h{d}"] = rng.standard_normal((h, 4 * h)) * 0.2
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0  # forget gates start open
            self.p[f"c{d}"] = bias
        self.p["o"] = rng.standard_normal(2 * h) * 0.2
        self.p["ob"] = np.zeros(1)

    def inputs(self, found: list[list[int]], measures: np.ndarray, d: str) -> np.ndarray:
        """Gate inputs (blocks, 4 * HIDDEN): the rows of the set slots summed, and the measures."""
        sizes = np.array([len(f) for f in found])
        rows = np.empty((len(found), self.p[f"x{d}"].shape[1]))
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), ENTRIES), side="left").tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(found)], strict=True):
            if lo < hi:
                flat, weights, n = weighted(found[lo:hi])
                rows[lo:hi] = np.add.reduceat(self.p[f"x{d}"][flat] * weights[:, None], np.cumsum(n) - n, axis=0)
        return rows + measures @ self.p[f"x{d}"][PATH_SLOTS + WORD_SLOTS :] + self.p[f"c{d}"]

    def run(self, gates: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(pages, steps, HIDDEN) from gate inputs (pages, steps, 4 * HIDDEN)."""
        pages, steps, _ = gates.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out = np.empty((pages, steps, HIDDEN))
        for t in range(steps):
            z = gates[:, t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            last_h, last_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((i, f, o, g, last_h, last_c, tc))
        return out

    def back(self, d_out: np.ndarray, keep: list, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gate inputs and of the recurrent weights."""
        pages, steps, _ = d_out.shape
        dz_all = np.empty((pages, steps, 4 * HIDDEN))
        dw = np.zeros_like(self.p[f"h{d}"])
        dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        for t in range(steps - 1, -1, -1):
            i, f, o, g, last_h, last_c, tc = keep[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * last_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            dw += last_h.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        return dz_all, dw

    @staticmethod
    def padded(rows: np.ndarray, sizes: list[int], reverse: bool) -> np.ndarray:
        out = np.zeros((len(sizes), max(sizes), rows.shape[1]))
        at = 0
        for k, n in enumerate(sizes):
            out[k, :n] = rows[at : at + n][::-1] if reverse else rows[at : at + n]
            at += n
        return out

    @staticmethod
    def flat(padded: np.ndarray, sizes: list[int], reverse: bool) -> np.ndarray:
        return np.concatenate([padded[k, :n][::-1] if reverse else padded[k, :n] for k, n in enumerate(sizes)])

    def scores(self, found: list[list[int]], measures: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Log-odds of content for the blocks of several pages laid end to end."""
        states = [
            self.flat(self.run(self.padded(self.inputs(found, measures, d), sizes, d == "b"), d), sizes, d == "b") for d in ("f", "b")
        ]
        return np.concatenate(states, axis=1) @ self.p["o"] + self.p["ob"]

    def gradients(self, found: list[list[int]], measures: np.ndarray, sizes: list[int], gold: np.ndarray) -> dict[str, np.ndarray]:
        keeps: dict[str, list] = {"f": [], "b": []}
        states = {}
        for d in ("f", "b"):
            states[d] = self.flat(self.run(self.padded(self.inputs(found, measures, d), sizes, d == "b"), d, keeps[d]), sizes, d == "b")
        both = np.concatenate([states["f"], states["b"]], axis=1)
        off = (1 / (1 + np.exp(-(both @ self.p["o"] + self.p["ob"]))) - gold) / len(gold)
        grads = {"o": both.T @ off, "ob": off.sum(keepdims=True)}
        d_both = off[:, None] * self.p["o"][None, :]
        flat, weights, counts = weighted(found)
        for k, d in enumerate(("f", "b")):
            dz, grads[f"h{d}"] = self.back(self.padded(d_both[:, k * HIDDEN : (k + 1) * HIDDEN], sizes, d == "b"), keeps[d], d)
            dz = self.flat(dz, sizes, d == "b")
            grads[f"c{d}"] = dz.sum(axis=0)
            gx = np.zeros_like(self.p[f"x{d}"])
            np.add.at(gx, flat, np.repeat(dz, counts, axis=0) * weights[:, None])
            gx[PATH_SLOTS + WORD_SLOTS :] += measures.T @ dz
            grads[f"x{d}"] = gx
        return grads


def teach(b: Block) -> bool:
    """The weak teacher: content unless a boilerplate container is on the path."""
    return b.node is None or not b.node.bad


PLANTED = [
    (["nav", "ul", "li", "a"], "link"), (["div", "menu", "ul", "li", "a"], "link"), (["div", "sidebar", "ul", "li", "a"], "link"),
    (["aside", "p"], "text"), (["div", "sidebar", "p"], "text"), (["div", "widget", "p"], "text"), (["header", "div"], "text"),
    (["div", "header", "p"], "text"), (["footer", "p"], "text"), (["div", "footer", "p"], "text"), (["div", "ad"], "text"),
    (["div", "advert", "p"], "text"), (["div", "banner"], "text"), (["div", "sponsored", "p"], "text"), (["div", "cookie", "notice", "p"], "notice"),
    (["div", "consent"], "notice"), (["form", "label"], "link"), (["form", "button"], "link"), (["div", "newsletter", "form", "p"], "notice"),
    (["section", "comments", "div", "comment", "p"], "text"), (["div", "comments", "ul", "li", "comment", "p"], "text"), (["ol", "comment", "list", "li", "p"], "text"),
    (["div", "related", "ul", "li", "a"], "link"), (["div", "share", "social", "a"], "link"), (["div", "breadcrumbs", "a"], "link"), (["div", "popup", "p"], "notice"),
]
GOOD_SHELLS = [["article"], ["main"], ["main", "article"], ["div", "content"], ["div", "article", "body"], ["div", "post"], ["section"], ["div", "entry"], []]


GOOD_ENDS = [["p"], ["ul", "li"], ["ol", "li"], ["h2"], ["h3"], ["blockquote", "p"], ["div", "p"], ["table", "tr", "td"], ["dl", "dd"], ["pre"], ["figure", "figcaption"]]


def inner(b: Block, rng: np.random.Generator) -> list[str]:
    """A content block's path inside its shell: its own, or now and then another kind of element."""
    if rng.random() < 0.3:
        return GOOD_ENDS[rng.integers(len(GOOD_ENDS))]
    near = b.node.nearest(40) if b.node else []
    return [n for n in near if n not in ("html", "body", "article", "main", "head")]


def training_pages(pages: list[list[Block]], rng: np.random.Generator) -> list[list[Block]]:
    """Each page as it is, and again in other shells with planted boilerplate: once, or more often
    where there are few pages."""
    texts = [b.text for page in pages for b in page if b.text]
    out = []
    for page in pages:
        for b in page:
            b.bad = not teach(b)
        out.append(page)
    for page in pages * -(-FITTED // max(1, len(pages))):
        content = [b for b in page if not b.bad]
        shell = GOOD_SHELLS[rng.integers(len(GOOD_SHELLS))]
        moved = [Block(["html", "body", *shell, *inner(b, rng)], b.text, b.linked) for b in content]
        if moved and shell and rng.random() < 0.4:
            moved[0] = Block(["html", "body", *shell, "header", *(["h1"], ["h2"], ["div", "h1"])[rng.integers(3)]], moved[0].text)

        def plant() -> list[Block]:
            path, kind = PLANTED[rng.integers(len(PLANTED))]
            made = []
            for _ in range(int(rng.integers(1, 6))):
                text = texts[rng.integers(len(texts))]
                if kind == "link":
                    text = " ".join(text.split(" ")[: int(rng.integers(1, 4))])
                made.append(Block(["html", "body", *path], text, len(text) if path[-1] == "a" else 0, True))
            return made

        before = [b for _ in range(int(rng.integers(1, 4))) for b in plant()]
        after = [b for _ in range(int(rng.integers(1, 4))) for b in plant()]
        middle = int(rng.integers(0, len(moved) + 1))
        planted = [Block(["html", "body", *shell, *b.path[2:]], b.text, b.linked, True) for _ in range(int(rng.integers(0, 3))) for b in plant()]
        late = int(rng.integers(0, len(planted) + 1))
        out.append([*before, *moved[:middle], *planted[:late], *moved[middle:], *planted[late:], *after])
    return [p for p in out if p]


def fit(pages: list[list[Block]], seed: int = 3) -> Labeller:
    """Log loss by Adam over pages grouped by length."""
    rng = np.random.default_rng(seed)
    model = Labeller(seed)
    data = training_pages(pages, rng)
    if not data:
        return model
    encoded = [([encode_block(b) for b in page], np.array([0.0 if b.bad else 1.0 for b in page])) for page in data]
    encoded = [(page[:400], gold[:400]) for page, gold in sorted(encoded, key=lambda x: len(x[0]))]  # training chains only
    batches = [encoded[i : i + 16] for i in range(0, len(encoded), 16)]
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            sizes = [len(page) for page, _ in batches[k]]
            found = [f for page, _ in batches[k] for f, _ in page]
            measures = np.array([m for page, _ in batches[k] for _, m in page])
            grads = model.gradients(found, measures, sizes, np.concatenate([g for _, g in batches[k]]))
            step += 1
            for name, g in grads.items():
                m, v = first[name], second[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[name] -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train(pages: DataFrame, sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> Labeller:
    """A labeller fitted on at most ``sample`` pages of at most ``max_chars`` characters: those with the
    smallest hashes of their html, equal ones once, whatever their ids."""
    usable = pages.where(F.length("html").between(1, max_chars)).select(F.xxhash64("html").alias("h"), "html")
    drawn = [r["h"] for r in usable.select("h").distinct().orderBy("h").limit(sample).collect()]  # hashes alone go to the driver first
    rows = usable.where(F.col("h").isin(drawn)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return fit([blocks_of(r["html"]) for r in rows])


def extract_pages(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the content blocks of the whole page joined by spaces.

    Null and empty html and pages without content blocks give an empty text. Character
    references are decoded, white space inside a block becomes one space. Broken markup is
    read as far as it goes. Repeated rows each give a row; extra columns are not read. The
    model, when not given, is fitted on a bounded sample of these pages.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))  # fixed size

    def make():
        labeller = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [blocks_of(h) if h else [] for h in batch.column("html").to_pylist()]
            texts = [""] * len(found)
            order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
            groups: list[list[int]] = []
            for k in order:  # short pages first, so the last one of a group is its longest
                if not groups or len(groups[-1]) == 32 or (len(groups[-1]) + 1) * len(found[k]) > TOGETHER:
                    groups.append([])
                groups[-1].append(k)
            for some in groups:
                encoded = [encode_block(b) for k in some for b in found[k]]
                sizes = [len(found[k]) for k in some]
                content = labeller.scores([f for f, _ in encoded], np.array([m for _, m in encoded]), sizes) > 0
                at = 0
                for k, n in zip(some, sizes, strict=True):
                    texts[k] = " ".join(b.text for b, yes in zip(found[k], content[at : at + n], strict=True) if yes)
                    at += n
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        return work

    return arrow_map(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long", rows=256)
