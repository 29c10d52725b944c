"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each block becomes one vector: hashed tag path, hashed words and a few
ratios. A bidirectional LSTM in numpy reads the whole sequence, so a block is judged by the document around it, and the
blocks it calls main text are joined.

The labeller is trained here on a bounded sample of pages whose own markup tells where the article is; each sampled
page is also shown in rewritten markup (neutral tags, foreign class names, added notices, forms, side bars and
comments), so that the answer does not hang on one tag.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from itertools import chain
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bounds of the training sample.
TRAIN_PAGES = 240
TRAIN_HTML_CHARS = 40_000
EPOCHS = 8
HIDDEN = 16
PATH_DIMS = 96
WORD_DIMS = 32
RATIOS = 8
DIMS = PATH_DIMS + WORD_DIMS + RATIOS
#: Blocks that go through the network together.
STEP_BLOCKS = 16_384

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag of the left kind ends when one of the right kinds opens.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"br", "button", "option", "select"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "head": frozenset({"body"}),
}
#: The same the other way round: what the opening of a tag ends.
CLOSES = {tag: tuple(k for k, ends in CLOSED_BY.items() if tag in ends) for tag in set().union(*CLOSED_BY.values())}
#: An implied end does not reach beyond these.
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|template|iframe|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)"  # a quote opens a value after = alone
    r"|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Text in these is not shown as such; markup that is shown again inside of them ends that, and so do blocks, as in browsers.
UNSEEN, SEEN = frozenset({"svg", "annotation", "annotation-xml"}), frozenset({"foreignobject"})
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")


class Level:
    """An open tag: what holds below it is worked out once from the level above, however deep the page is nested."""

    __slots__ = ("above", "items", "length", "linked", "tag", "unseen", "_vector")

    def __init__(self, above: "Level | None", tag: str, names: tuple[str, ...]):
        self.above, self.tag = above, tag
        self.items = () if tag == "a" else (tag, *names)
        self.length = len(self.items) + (above.length if above else 0)
        self.linked = tag == "a" or (above is not None and above.linked)
        self.unseen = tag in UNSEEN or (tag not in SEEN and above is not None and above.unseen)
        self._vector: np.ndarray | None = None

    def vector(self) -> np.ndarray:
        """The hashed path, from that of the nearest level above that has one."""
        todo, level = [], self
        while level is not None and level._vector is None:
            todo.append(level)
            level = level.above
        held = np.zeros(PATH_DIMS, np.float32) if level is None else level._vector
        for level in reversed(todo):
            if level.items:
                held = held.copy()
                for x in level.items:
                    h = crc32(x.encode())
                    held[h % PATH_DIMS] += 1.0 if h & 0x10000 else -1.0
            level._vector = held
        return held


@dataclass
class Block:
    level: Level | None
    text: str
    link_share: float

    @property
    def path(self) -> tuple[str, ...]:
        out, level = [], self.level
        while level is not None:
            out.append(level.items)
            level = level.above
        return tuple(x for items in reversed(out) for x in items)


def level_of(path: tuple[str, ...]) -> Level | None:
    """A level whose path is ``path``."""
    return Level(None, path[0], path[1:]) if path else None


class Open:
    """The open tags of a page. Every question about them costs the same at any depth."""

    def __init__(self):
        self.levels: list[Level] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def last(self) -> Level | None:
        return self.levels[-1] if self.levels else None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.levels))
        if tag in SCOPES:
            self.scopes.append(len(self.levels))
        self.levels.append(Level(self.last, tag, names))

    def cut(self, place: int) -> None:
        """End the tag at ``place`` and all within it."""
        while len(self.levels) > place:
            tag = self.levels.pop().tag
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def end(self, tags: tuple[str, ...], beyond_scopes: bool) -> None:
        """End the innermost tag of ``tags``, unless it stands outside of the innermost scope."""
        place = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if place >= 0 and (beyond_scopes or not self.scopes or place >= self.scopes[-1]):
            self.cut(place)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between block-level tags, decoded, white space folded, never empty.

    Pages nested to any depth, and tags that are never closed, cost their length.
    """
    found: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                found.append(Block(stack.last, text, min(1.0, linked / max(1, len(raw)))))
            parts.clear()
            linked = 0

    def unseen() -> bool:
        return stack.last is not None and stack.last.unseen

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not unseen():
            parts.append(piece)
            if stack.last is not None and stack.last.linked:
                linked += len(piece)

    at = 0
    for m in MARKUP.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        closing, tag, rest = m[2], m[3], m[4]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS and unseen():
            if tag == "title":  # of a drawing
                continue
            # A block ends a drawing that was left open.
            while unseen():
                stack.cut(len(stack.levels) - 1)
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            stack.end((tag,), beyond_scopes=tag in SCOPES)
            continue
        if tag in CLOSES:
            stack.end(CLOSES[tag], beyond_scopes=False)
        if tag not in VOID_TAGS and not rest.endswith("/"):
            names = tuple(w for g in NAMES.findall(rest) for w in NAME_WORD.findall("".join(g).lower())) if "=" in rest else ()
            stack.push(tag, names)
    take(page[at:])
    flush()
    return found


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block: tag path, words, ratios. ``found`` may be several pages; the place in the page is left at 0."""
    if not found:
        return np.zeros((0, DIMS), np.float32)
    nowhere = np.zeros(PATH_DIMS, np.float32)
    tokens = [b.text.encode().split() for b in found]
    counts = np.array([len(t) for t in tokens])
    hashes = np.fromiter(map(crc32, chain.from_iterable(tokens)), np.uint32, counts.sum())
    cells = np.repeat(np.arange(len(found)) * WORD_DIMS, counts) + hashes % WORD_DIMS
    sums = np.bincount(cells, np.where(hashes & 0x10000, 1.0, -1.0), len(found) * WORD_DIMS)
    n = np.array([len(b.text) for b in found])
    ends = np.array([sum(map(b.text.count, ".!?")) for b in found])
    marks = np.array([sum(map(b.text.count, "|©·»")) for b in found])
    ratios = [
        np.log1p(n) / 5,
        np.log1p(counts) / 3,
        [b.link_share for b in found],
        ends / np.maximum(counts, 1),
        marks / np.maximum(counts, 1),
        [float(b.text[-1] in ".!?:") for b in found],
        [(b.level.length if b.level else 0) / 8 for b in found],
    ]
    return np.concatenate(
        [
            np.array([b.level.vector() if b.level else nowhere for b in found]),
            sums.reshape(len(found), WORD_DIMS) / np.sqrt(np.maximum(counts, 1))[:, None],
            np.array(ratios).T,
            np.zeros((len(found), 1)),
        ],
        axis=1,
    ).astype(np.float32)


def page_vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """The vectors of each page, with the place in the page as last number."""
    rows = vectors([b for found in pages for b in found])
    out, at = [], 0
    for found in pages:
        out.append(rows[at : at + len(found)])
        out[-1][:, -1] = np.arange(len(found)) / max(1, len(found) - 1)
        at += len(found)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block; weights are plain arrays."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for side in "fb":
            self.w[f"{side}x"] = rng.normal(0, 0.15, (DIMS, 4 * hidden)).astype(np.float32)
            self.w[f"{side}h"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.w[f"{side}b"] = bias
        self.w["o"] = rng.normal(0, 0.15, (2 * hidden, 1)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: blocks first, then pages. Padding leaves the state as it is."""
        steps, pages, _ = x.shape
        n = self.hidden
        h = np.zeros((pages, n), np.float32)
        c = np.zeros((pages, n), np.float32)
        out = np.zeros((steps, pages, n), np.float32)
        kept: list = [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = x[t] @ self.w[f"{side}x"] + h @ self.w[f"{side}h"] + self.w[f"{side}b"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep:
                kept[t] = (h, c, i, f, o, g, tanh_c, m)
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, side, False)[0] for side in "fb"], axis=2)
        return (both @ self.w["o"] + self.w["ob"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {side: self._run(x, mask, side, True) for side in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid((both @ self.w["o"] + self.w["ob"])[:, :, 0])
        d_logit = ((p - y) * mask / max(1, mask.sum()))[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["o"] = np.einsum("tpn,tpk->nk", both, d_logit)
        grads["ob"] = d_logit.sum((0, 1))
        d_both = d_logit @ self.w["o"].T
        n, steps = self.hidden, x.shape[0]
        for s, side in enumerate("fb"):
            d_out, kept = d_both[:, :, s * n : (s + 1) * n], runs[side][1]
            d_h = np.zeros_like(d_out[0])
            d_c = np.zeros_like(d_out[0])
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                h, c, i, f, o, g, tanh_c, m = kept[t]
                d_h = d_h + d_out[t]
                live, rest_h, rest_c = d_h * m, d_h * (1 - m), d_c * (1 - m)
                d_new = d_c * m + live * o * (1 - tanh_c**2)
                d_z = np.concatenate(
                    [d_new * g * i * (1 - i), d_new * c * f * (1 - f), live * tanh_c * o * (1 - o), d_new * i * (1 - g**2)],
                    axis=1,
                )
                grads[f"{side}x"] += x[t].T @ d_z
                grads[f"{side}h"] += h.T @ d_z
                grads[f"{side}b"] += d_z.sum(0)
                d_h = d_z @ self.w[f"{side}h"].T + rest_h
                d_c = d_new * f + rest_c
        return grads


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in seqs)
    x = np.zeros((steps, len(seqs), DIMS), np.float32)
    mask = np.zeros((steps, len(seqs)), np.float32)
    for p, s in enumerate(seqs):
        x[: len(s), p] = s
        mask[: len(s), p] = 1
    return x, mask


def main_blocks(model: Labeller, pages: list[list[Block]]) -> list[list[Block]]:
    """The blocks of each page that the labeller calls main text."""
    order = sorted((k for k, found in enumerate(pages) if found), key=lambda k: len(pages[k]))
    out: list[list[Block]] = [[] for _ in pages]
    while order:
        group: list[int] = []
        while order and (not group or len(pages[order[0]]) * (len(group) + 1) <= STEP_BLOCKS):
            group.append(order.pop(0))
        x, mask = _padded(page_vectors([pages[k] for k in group]))
        logits = model.logits(x, mask)
        for p, k in enumerate(group):
            out[k] = [b for b, v in zip(pages[k], logits[:, p]) if v > 0]
    return out


#: Names of containers that say what they hold, for labels of the training sample.
MAIN_NAMES = frozenset("article main".split())
OTHER_NAMES = frozenset(
    "ad ads advert aside banner breadcrumb button comment comments consent cookie dialog footer form head header legal "
    "menu nav newsletter notice option promo related select share sidebar social sponsor sponsored subscribe toolbar "
    "widget".split()
)
#: Names that rewritten markup gives to the article and to everything around it.
MAIN_ALIASES = ["content", "post", "entry", "story", "main", "text", "article body", "post content", "entry content"]
AROUND_ALIASES = {
    "nav": ["menu", "navigation", "topnav", "links", "navbar"],
    "footer": ["bottom", "footer", "copyright", "site footer"],
    "ad": ["advert", "banner", "sponsored", "promo", "ads"],
}
EXTRA_ALIASES = {
    "header": ("before", ["header", "site header", "masthead", "topbar"]),
    "notice": ("before", ["cookie notice", "consent", "notice", "alert banner"]),
    "aside": ("either", ["sidebar", "aside widget", "related", "recommended"]),
    "form": ("after", ["newsletter", "signup form", "subscribe", "search form"]),
    "comments": ("after", ["comments", "comment list", "replies", "discussion"]),
}
#: What stands within an article but is none of it.
INSIDE_ALIASES = ["advert", "banner", "sponsored", "promo", "ad", "related", "recommended", "share social", "newsletter", "comments", "aside"]


def own_labels(found: list[Block]) -> list[int] | None:
    """1 for blocks that the page's own markup puts into the article; None if it names no article."""
    if not any(MAIN_NAMES & set(b.path) for b in found):
        return None
    return [int(bool(MAIN_NAMES & set(b.path)) and not OTHER_NAMES & set(b.path)) for b in found]


def rewritten(found: list[Block], labels: list[int], others: list[Block], rng: Random) -> tuple[list[Block], list[int]]:
    """The page in other markup: containers renamed, other parts added around the article."""
    main = rng.choice(MAIN_ALIASES).split()
    renamed = {kind: rng.choice(names).split() for kind, names in AROUND_ALIASES.items()}
    neutral = rng.random() < 0.7

    def path(b: Block) -> tuple[str, ...]:
        out: list[str] = []
        for x in b.path:
            if x in MAIN_NAMES:
                out += ["div", *main] if neutral else [x]
            elif x in renamed and rng.random() < 0.8:
                out += ["div", *renamed[x]]
            elif x != "ad":
                out.append(x)
        return tuple(out)

    page = [(Block(level_of(path(b)), b.text, b.link_share), y) for b, y in zip(found, labels)]
    first = next((k for k, (_, y) in enumerate(page) if y), 0)
    last = max((k for k, (_, y) in enumerate(page) if y), default=-1) + 1
    before: list[tuple[Block, int]] = []
    after: list[tuple[Block, int]] = []
    for kind, (side, names) in EXTRA_ALIASES.items():
        if rng.random() < 0.5:
            tag = kind if rng.random() < 0.4 and kind != "comments" and kind != "notice" else rng.choice(["div", "section", "ul"])
            base = ("html", "body", tag, *rng.choice(names).split())
            extra = []
            for _ in range(rng.randint(1, 4)):
                tokens = rng.choice(others).text.split()
                start = rng.randrange(len(tokens))
                size = rng.randint(8, 60) if kind == "comments" else rng.randint(1, 14)
                text = " ".join(tokens[start : start + size])
                leaf = rng.choice([("p",), ("div",), ("li",), ()])
                extra.append((Block(level_of((*base, *leaf)), text, float(rng.random() < 0.4 and kind != "comments")), 0))
            (before if side == "before" or side == "either" and rng.random() < 0.5 else after).extend(extra)
    middle = page[first:last]
    if middle and rng.random() < 0.4:
        holder = middle[0][0].path
        for _ in range(rng.randint(1, 2)):
            tokens = rng.choice(others).text.split()
            start = rng.randrange(len(tokens))
            base = (*holder[: max(1, len(holder) - 1)], rng.choice(["div", "aside", "section"]), *rng.choice(INSIDE_ALIASES).split())
            extra = Block(level_of((*base, *rng.choice([("p",), ()]))), " ".join(tokens[start : start + rng.randint(2, 20)]), float(rng.random() < 0.3))
            middle.insert(rng.randint(1, len(middle)), (extra, 0))
    page = page[:first] + before + middle + after + page[last:]
    return [b for b, _ in page], [y for _, y in page]


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Train on at most ``train_pages`` pages of at most TRAIN_HTML_CHARS characters, chosen by hash.

    With no usable page (empty table, no page that names its article) the labeller stays untrained on the given
    pages and learns from a few built-in ones instead.
    """
    # A share of the hashes that holds half as many again; copies are one page, and few rows reach the driver.
    share = 1.5 * train_pages / max(1, pages.count())
    drawn = pages.select("html", F.xxhash64("html").alias("h")).filter((F.length("html") <= TRAIN_HTML_CHARS) & (F.length("html") > 0))
    if share < 1:
        drawn = drawn.filter(F.col("h") < int(share * 2**64) - 2**63)
    rows = drawn.distinct().limit(2 * train_pages).collect()
    sample = sorted(rows, key=lambda r: (r["h"], r["html"]))[:train_pages]
    return fit_texts([r["html"] for r in sample], epochs, seed)


#: Pages to learn from where the table has none.
SPARE_PAGES = [
    f"<html><body><nav><ul><li><a>{a}</a></li><li><a>{b}</a></li></ul></nav><div class='ad'>{b} {a}.</div><article>"
    f"<h1>{a} {b}</h1><p>{(a + ' ' + b + ' ') * 9}.</p><p>{(b + ' of the ' + a + ' ') * 12}.</p></article>"
    f"<footer>&copy; {a} &middot; {b}</footer></body></html>"
    for a, b in [("river", "stone"), ("market", "harbour"), ("winter", "garden"), ("music", "letter"), ("road", "history")]
]


def fit_texts(texts: list[str], epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    rng = Random(seed)
    known = [(found, y) for found in map(blocks, texts) if found and (y := own_labels(found))]
    if not known:
        known = [(found, own_labels(found)) for found in map(blocks, SPARE_PAGES)]
    others = [b for found, _ in known for b in found]
    shown = list(known)
    for found, y in known:
        shown += [rewritten(found, y, others, rng) for _ in range(max(3, 120 // len(known)))]
    data = sorted(zip(page_vectors([found for found, _ in shown]), [np.array(y, np.float32) for _, y in shown]), key=lambda d: len(d[1]))
    groups: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for d in data:
        if not groups or len(groups[-1]) == 24 or len(groups[-1]) * len(d[1]) > STEP_BLOCKS:
            groups.append([])
        groups[-1].append(d)
    model = Labeller(seed)
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(groups)
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for group in groups:
            x, mask = _padded([v for v, _ in group])
            y = np.zeros(mask.shape, np.float32)
            for p, (_, labels) in enumerate(group):
                y[: len(labels), p] = labels
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                model.w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, read from the whole html.

    A null, empty or text-free page gives an empty text; null ids and urls stay null; repeated rows each give a row;
    an empty table gives none. Other columns are not read. Text outside any tag counts as a block like any other.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    weights = (model or fit(pages)).w

    def run(batches):
        net = Labeller()
        net.w = weights
        for batch in batches:
            found = [blocks(x or "") for x in batch.column(2).to_pylist()]
            texts = [" ".join(b.text for b in kept) for kept in main_blocks(net, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
