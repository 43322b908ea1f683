"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the path of open tags (and
their class, id and role words). A bidirectional LSTM in numpy reads, for each block, hashed vectors of the path and of
the words, and a few numbers about the text, and labels every block with the whole page as context. Blocks labelled main
are joined by line feeds.

There are no labelled pages, so the labeller is trained on a bounded sample of pages (`SAMPLE_PAGES`, by hash): their own
markup gives labels where it tells (article, nav, footer, ...), and their paragraphs are set anew into made-up layouts
with menus, notices, adverts, forms, sidebars and comments, whose labels are known.

Defined cases: null or empty html, and pages without main blocks, give empty text; unclosed and stray tags are closed as
browsers do; a button, list of choices or svg left open ends at the next paragraph, heading, list or the like; the whole
path and all words of a block count, however long; columns of other names are kept, and added ones renamed where they clash; scripts, styles, comments, hidden templates and what an object or canvas shows where it can't be drawn are never
text; text in a head outside its title ends the head; with no page to learn from, blocks are kept
unless their own tags say otherwise; repeated rows each get a row; page ids may be null.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import fresh, slices

SAMPLE_PAGES, SAMPLE_CHARS = 240, 200_000
PATH_DIM, WORD_DIM, NUMBERS = 96, 32, 8
HIDDEN = 20
EPOCHS = 8
SEED = 11
#: A page of more blocks is labelled in stretches of so many.
LONG_PAGE = 20_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head title iframe object canvas select option textarea button".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: These end a button or a list of choices that was left open, and these an svg, as browsers and people read it.
ENDS_CONTROL = frozenset("p h1 h2 h3 h4 h5 h6 article main section ul ol dl table blockquote pre".split())
ENDS_SVG = ENDS_CONTROL | frozenset("body br center dd div dt hr img li menu nav header footer aside".split())
CONTROLS = frozenset("button select option optgroup".split())
HEAD_TAGS = frozenset("base basefont link meta noscript script style template title".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOILER = frozenset("nav header footer aside form menu ad ads advert advertisement banner promo sponsored cookie cookies notice consent sidebar comment comments reply replies related share social newsletter subscribe breadcrumb breadcrumbs pagination widget login search copyright".split())
TELLING = BOILER | {"article", "main"}
_WORD = re.compile(r"\w+")


def _bucket(token: str, dim: int) -> int:
    return zlib.crc32(token.encode()) % dim


class Path:
    """The open tags around a block; vec: their hashed words, the nearest of each weighing most; telling: those of their
    words that tell whether a block is main text."""

    __slots__ = ("telling", "up", "vec", "words")

    def __init__(self, up: Path | None, words: tuple[str, ...]):
        self.up, self.words = up, words
        self.vec = np.zeros(PATH_DIM, np.float32) if up is None else up.vec * np.float32(0.9)
        for w in words:
            self.vec[_bucket(w, PATH_DIM)] = 1
        self.telling = frozenset() if up is None else up.telling
        if not self.telling.issuperset(here := TELLING.intersection(words)):
            self.telling |= here

    def __iter__(self):
        """Each tag's words, from the outermost tag in."""
        steps, at = [], self
        while at is not None:
            steps.append(at.words)
            at = at.up
        return reversed(steps)

    @classmethod
    def of(cls, steps) -> Path:
        at = cls(None, ())
        for words in steps:
            at = cls(at, tuple(words))
        return at


class Blocks(HTMLParser):
    """Leaf blocks of a page: text, path words, and how much of the text is in links. Each tag costs the same, however many are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Path(None, ())
        self.stack: list[tuple[str, Path]] = []
        self.found: list[tuple[str, Path, float]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0
        self.places: dict[str, list[int]] = defaultdict(list)  # where each open tag stands in the stack
        self.walls: list[int] = []  # where those stand that aren't inline

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = self.stack[-1][1] if self.stack else self.root
            self.found.append((text, path, min(1.0, self.linked / len(text))))
        self.parts, self.linked = [], 0

    def _push(self, tag: str, path: Path) -> None:
        self.places[tag].append(len(self.stack))
        if tag not in INLINE:
            self.walls.append(len(self.stack))
        self.silent += tag in SILENT
        self.stack.append((tag, path))

    def _pop(self, k: int) -> None:
        """Close the open tags from the k-th on."""
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.silent -= tag in SILENT
            self.places[tag].pop()
            if tag not in INLINE:
                self.walls.pop()

    def _end(self, tags) -> None:
        """Close the outermost open tag among tags, and all inside it."""
        outermost = [self.places[tag][0] for tag in tags if self.places[tag]]
        if outermost:
            self._pop(min(outermost))

    def handle_starttag(self, tag, attrs):
        if self.silent > 0:
            if tag not in HEAD_TAGS and tag != "head":
                self._end({"head"})
            if tag in ENDS_CONTROL:
                self._end(CONTROLS)
            if tag in ENDS_SVG:
                self._end({"svg"})
        if tag not in INLINE:
            if self.silent <= 0 and (tag not in SILENT or tag in ("title", "head")):
                self.flush()
            if self.walls:
                name = self.stack[self.walls[-1]][0]
                if name == "p" and tag in CLOSES_P or name in SAME.get(tag, ()):
                    self._pop(self.walls[-1])
        elif tag in ("br", "img", "wbr"):
            self.parts.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        words = [tag]
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop") and v:
                words += [w.lower() for w in re.split(r"[^A-Za-z]+", v) if w]
        up = self.stack[-1][1] if self.stack else self.root
        self._push(tag, up if tag in INLINE else Path(up, tuple(words)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE and tag not in SILENT and self.silent <= 0:
            self.flush()
        if not self.places[tag]:
            return
        k = self.places[tag][-1]
        if tag in INLINE and self.walls and self.walls[-1] > k:
            return
        if self.silent > 0:  # a tag inside it was left open
            self._pop(k + 1)
            if tag not in INLINE and self.silent <= 0:
                self.flush()
        self._pop(k)

    def handle_data(self, data):
        if self.silent > 0 and self.stack[-1][0] == "head" and data.strip():
            self._end({"head"})
        if self.silent <= 0:
            self.parts.append(data)
            if self.places["a"]:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple[str, Path, float]]:
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.found


def vectors(page, first: int = 0, end: int | None = None) -> np.ndarray:
    """One row per block (from first to before end): hashed words of its whole path and whole text, and numbers about the text."""
    part = page[first:end]
    out = np.zeros((len(part), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    for k, (text, path, linked) in enumerate(part):
        out[k, :PATH_DIM] = path.vec if isinstance(path, Path) else Path.of(path).vec
        words = _WORD.findall(text.lower())
        if words:
            hashed = np.bincount([_bucket("w" + w, WORD_DIM) for w in words], minlength=WORD_DIM)
            out[k, PATH_DIM : PATH_DIM + WORD_DIM] = hashed / len(words)
        n = len(text)
        out[k, -NUMBERS:] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, linked, sum(text.count(c) for c in ".,;:!?") / n * 10, sum(map(str.isdigit, text)) / n, (first + k) / len(page), text[-1:] in ".!?…\"'", "©" in text)
    return out


# The network ----------------------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(dim: int, rng) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w["W" + d] = (rng.standard_normal((dim + HIDDEN, 4 * HIDDEN)) / np.sqrt(dim / 4 + HIDDEN)).astype(np.float32)
        w["c" + d] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)
    w["o"] = (rng.standard_normal((2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
    w["p"] = np.zeros(1, np.float32)
    return w


def _run(x, mask, W, c, keep, start=None):
    """States (T x B x H) of one LSTM, from the state start on, and its last state; x is T x B x D. keep: what the backward pass needs."""
    t, b, d = x.shape
    pre = (x.reshape(t * b, d) @ W[:d]).reshape(t, b, -1) + c
    h, s = start or (np.zeros((b, HIDDEN), np.float32),) * 2
    states, tape = np.zeros((t, b, HIDDEN), np.float32), []
    for k in range(t):
        g = pre[k] + h @ W[d:]
        i, f, o = (_sigmoid(g[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
        n = np.tanh(g[:, 3 * HIDDEN :])
        new = f * s + i * n
        out = o * np.tanh(new)
        m = mask[k][:, None]
        if keep:
            tape.append((h, s, i, f, o, n, new))
        s, h = m * new + (1 - m) * s, m * out + (1 - m) * h
        states[k] = h
    return states, tape, (h, s)


def forward(w, x, mask, keep=False):
    """Chance of main for each block (T x B)."""
    f, tf, _ = _run(x, mask, w["Wf"], w["cf"], keep)
    b, tb, _ = _run(x[::-1], mask[::-1], w["Wb"], w["cb"], keep)
    both = np.concatenate([f, b[::-1]], axis=2)
    return _sigmoid(both @ w["o"] + w["p"])[..., 0], both, tf, tb


def _back(x, mask, W, tape, dstates):
    t, b, d = x.shape
    dW, dc = np.zeros_like(W), np.zeros(4 * HIDDEN, np.float32)
    dh, ds = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        h, s, i, f, o, n, new = tape[k]
        m = mask[k][:, None]
        dh = dh + dstates[k]
        th = np.tanh(new)
        dout, dnew = m * dh, m * ds
        dnew = dnew + dout * o * (1 - th * th)
        g = np.concatenate([dnew * n * i * (1 - i), dnew * s * f * (1 - f), dout * th * o * (1 - o), dnew * i * (1 - n * n)], axis=1)
        dW[:d] += x[k].T @ g
        dW[d:] += h.T @ g
        dc += g.sum(axis=0)
        dh, ds = (1 - m) * dh + g @ W[d:].T, (1 - m) * ds + dnew * f
    return dW, dc


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights from (block vectors, labels) of pages, by Adam on batches of pages of like length."""
    rng = np.random.default_rng(SEED)
    w = start_weights(pages[0][0].shape[1], rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order, step = sorted(range(len(pages)), key=lambda k: len(pages[k][0])), 0
    groups = [order[k : k + 24] for k in range(0, len(order), 24)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask, y = _padded([pages[k] for k in groups[g]])
            p, both, tf, tb = forward(w, x, mask, keep=True)
            d = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
            dboth = d @ w["o"].T
            grads = {"o": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "p": d.sum(axis=(0, 1))}
            grads["Wf"], grads["cf"] = _back(x, mask, w["Wf"], tf, dboth[..., :HIDDEN])
            grads["Wb"], grads["cb"] = _back(x[::-1], mask[::-1], w["Wb"], tb, dboth[::-1, :, HIDDEN:])
            step += 1
            for k, grad in grads.items():
                grad = np.clip(grad, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                w[k] = (w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _padded(pages):
    t, b = max(len(x) for x, _ in pages), len(pages)
    x, mask, y = np.zeros((t, b, pages[0][0].shape[1]), np.float32), np.zeros((t, b), np.float32), np.zeros((t, b), np.float32)
    for k, (vec, lab) in enumerate(pages):
        x[: len(vec), k], mask[: len(vec), k] = vec, 1
        if lab is not None:
            y[: len(vec), k] = lab
    return x, mask, y


def label(w, pages: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
    """Which blocks of each page are main; pages of like length share a pass of bounded size."""
    out: list[np.ndarray] = [np.zeros(0, np.bool_)] * len(pages)
    order, k = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])], 0
    while k < len(order):
        n = 1
        while k + n < len(order) and n < 256 and (n + 1) * len(pages[order[k + n]]) <= cells:
            n += 1
        some = order[k : k + n]
        x, mask, _ = _padded([(pages[i], None) for i in some])
        p = forward(w, x, mask)[0]
        for j, i in enumerate(some):
            out[i] = p[: len(pages[i]), j] >= 0.5
        k += n
    return out


def label_long(w, page, step: int = LONG_PAGE) -> np.ndarray:
    """Which blocks of one page are main, the page being read in stretches that hand on their states; of a stretch only its
    share of the blocks' scores is kept."""
    score = np.full(len(page), w["p"][0], np.float32)
    starts = list(range(0, len(page), step))
    for d, order, half in (("f", starts, w["o"][:HIDDEN]), ("b", starts[::-1], w["o"][HIDDEN:])):
        state, turn = None, 1 if d == "f" else -1
        for first in order:
            x = vectors(page, first, first + step)[::turn, None]
            states, _, state = _run(x, np.ones(x.shape[:2], np.float32), w["W" + d], w["c" + d], False, state)
            score[first : first + step] += (states[:, 0] @ half)[::turn, 0]
    return _sigmoid(score) >= 0.5


# Training pages -------------------------------------------------------------------------------------------------------


def told(path) -> bool | None:
    """What a block's own tags say: False inside boilerplate, True in an article, None if they don't tell."""
    words = (path if isinstance(path, Path) else Path.of(path)).telling
    if any(w in BOILER for w in words if not (w == "header" and "article" in words)):
        return False
    return True if words else None


_MENU = "Home News About Contact Login Register Search Sports Business World Politics Culture Videos Photos Help Careers Privacy Terms Sitemap Archive Topics Shop Store Account Cart Blog Events Services Products Company Team Press".split()
_SAYINGS = {
    "notice": ["We use cookies to give you the best experience.", "By continuing you accept our privacy policy.", "This site uses cookies. Accept all", "Please enable JavaScript to view this page.", "You have read 3 of 5 free articles."],
    "ad": ["Advertisement", "Sponsored content", "Buy now and save 50%", "Limited offer: order today!", "Get the best deals in your inbox"],
    "form": ["Your e-mail address", "Subscribe to our newsletter", "Sign up", "Name", "Message", "Send", "Search"],
    "footer": ["All rights reserved.", "© 2024 Example Media Group", "Terms of use", "Privacy policy", "Imprint"],
    "comment": ["Great article, thanks!", "I do not agree with this at all.", "Reply", "Posted 3 hours ago by guest42", "5 comments", "Leave a comment"],
}


def _layout(rng, title: str, paragraphs: list[str], spare: list[str]) -> list[tuple[str, list[tuple[str, ...]], float, int]]:
    """A made-up page around paragraphs: blocks with paths, link shares and labels."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    root = [("html",), ("body",)] + [("div", *w) for w in ([], ["wrapper"], ["page", "container"]) if rng.random() < 0.4]
    page: list = []
    text = lambda kind: pick(_SAYINGS[kind]) if rng.random() < 0.6 else pick(spare)[: int(rng.integers(20, 200))]

    def boiler(steps, kind, n, linked=0.0):
        for _ in range(n):
            page.append((text(kind), root + steps, linked, 0))

    def menu(steps):
        for _ in range(int(rng.integers(3, 10))):
            page.append((pick(_MENU) if rng.random() < 0.5 else pick(spare).split(" ")[0], root + steps, 1.0, 0))

    plain = rng.random() < 0.15  # few class names: context has to tell
    if rng.random() < 0.5:
        boiler([("div", *([] if plain else [pick(["cookie", "notice", "banner", "consent", "alert"])]))], "notice", int(rng.integers(1, 3)))
    if rng.random() < 0.6:
        boiler([("header",) if rng.random() < 0.6 else ("div", "header")], "notice", int(rng.integers(1, 3)), 0.5)
    if rng.random() < 0.9:
        menu([("nav",) if rng.random() < 0.6 else ("div", pick(["menu", "nav", "navigation"])), ("ul",), ("li",)])
    if rng.random() < 0.5:
        boiler([("div", pick(["ad", "ads", "advert", "sponsored", "promo"]))], "ad", 1)
    side = rng.random()
    aside = [("aside",) if rng.random() < 0.5 else ("div", pick(["sidebar", "side", "widget", "related"]))]
    if side < 0.25:
        boiler(aside + [("ul",), ("li",)], "ad", int(rng.integers(2, 6)), float(rng.random() < 0.6))
    body = pick([[("article",)], [("main",)], [("main",), ("article",)], [("div", "content")], [("div", "post", "body")], [("section", "entry", "content")], [("div", "article", "text")], [("div",)]])
    body = body + [("div",)] * int(rng.integers(1, 14) * (rng.random() < 0.25))
    if rng.random() < 0.8:
        page.append((title, root + body + ([("header",)] if rng.random() < 0.15 else []) + [("h1",)], 0.0, 1))
    for k, p in enumerate(paragraphs):
        page.append((p, root + body + [(pick(["p", "p", "p", "p", "div", "li", "blockquote", "h2", "td"]),)], float(rng.random() < 0.1) * 0.2, 1))
        if rng.random() < 0.06:
            boiler(body + [("div", pick(["ad", "advert", "promo", "share", "newsletter", "related"]))] + ([("p",)] if rng.random() < 0.5 else []), "ad", 1, float(rng.random() < 0.3))
        if rng.random() < 0.03:
            boiler(body + [("form",)], "form", int(rng.integers(1, 4)))
    if rng.random() < 0.5:
        steps = (body if rng.random() < 0.4 else []) + [(pick(["section", "div", "ul", "ol"]), pick(["comments", "comment", "replies", "responses", "discussion"]))]
        for _ in range(int(rng.integers(1, 7))):
            boiler(steps + [(pick(["div", "li", "p"]), *(["comment"] if rng.random() < 0.5 else []))] + ([("p",)] if rng.random() < 0.5 else []), "comment", 1)
    if side > 0.7:
        boiler(aside + [("p",) if rng.random() < 0.5 else ("li",)], "ad", int(rng.integers(2, 6)), float(rng.random() < 0.6))
    if rng.random() < 0.4:
        boiler([("form", *([] if plain else [pick(["newsletter", "search", "contact"])]))], "form", int(rng.integers(1, 4)))
    if rng.random() < 0.9:
        boiler([("footer",) if rng.random() < 0.6 else ("div", "footer")] + ([("p",)] if rng.random() < 0.5 else []), "footer", int(rng.integers(1, 5)), float(rng.random() < 0.4))
    return page


def training_pages(sample: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(SEED)
    parsed = [p for p in map(blocks, sample) if p]
    spare = [t for p in parsed for t, _, _ in p if len(t) > 20] or ["Text without a page."]
    out = []
    for p in parsed:
        says = [told(path) for _, path, _ in p]
        if any(s is True for s in says):
            out.append((vectors(p), np.array([s is True for s in says], np.float32)))
        main = [t for (t, _, _), s in zip(p, says, strict=True) if s is not False and len(t) > 20] or [spare[rng.integers(len(spare))]]
        for _ in range(2):
            at = int(rng.integers(len(main)))
            own = main[at : at + int(rng.integers(1, 25))]
            made = _layout(rng, main[0][:80], own, spare)
            out.append((vectors([b[:3] for b in made]), np.array([b[3] for b in made], np.float32)))
    return out


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None

    def texts(self, htmls) -> list[str]:
        pages = [blocks(h) for h in htmls]
        if self.weights is None:
            chosen = [[told(path) is not False for _, path, _ in p] for p in pages]
        else:
            chosen = label(self.weights, [vectors(p) if len(p) <= LONG_PAGE else vectors([]) for p in pages])
            chosen = [label_long(self.weights, p) if len(p) > LONG_PAGE else c for p, c in zip(pages, chosen, strict=True)]
        return ["\n".join(t for (t, _, _), ok in zip(p, keep, strict=True) if ok) for p, keep in zip(pages, chosen, strict=True)]


def fit(pages: DataFrame, html_col: str = "html", most: int = SAMPLE_PAGES) -> Model:
    """A labeller trained on at most `most` different pages of at most `SAMPLE_CHARS` characters, those with the smallest
    hashes. Pages are first thinned out by hash where they are, so that few more than these reach the driver."""
    html = F.col(html_col).cast("string")
    rows = pages.where(html.isNotNull() & (F.length(html) <= SAMPLE_CHARS)).select(html.alias("html"), F.xxhash64(html).alias("turn"))
    n = rows.agg(F.approx_count_distinct("turn").alias("n")).first()["n"]
    if n > 4 * most:
        rows = rows.where(F.pmod("turn", F.lit(1_000_000)) < int(1_000_000 * 3 * most / n) + 1)
    sample = [r["html"] for r in rows.groupBy("turn").agg(F.min("html").alias("html")).orderBy("turn").limit(most).collect()]
    made = training_pages(sample)
    return Model(train(made) if made else None)


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """pages, without the html, with text and n_chars."""
    rest = [c for c in pages.columns if c != html_col]
    names = fresh(pages.drop(html_col), "text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(names[0], T.StringType(), False), T.StructField(names[1], T.LongType(), False)])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html_col):
                got = shared.value.texts(batch.column(html_col).to_pylist())
                cols = [pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *cols], [*rest, *names])

    return pages.withColumn(html_col, F.col(html_col).cast("string")).mapInArrow(run, schema)
