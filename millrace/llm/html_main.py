"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks (htmlblocks). A block is read as a vector: its tag path hashed into PATHS
places, its words hashed into WORDS places, and a few plain numbers (length, link share, place in the page). A
bidirectional LSTM in numpy goes over the sequence in both directions, so that each block is judged with the whole page
in view, and a logistic output says whether it belongs to the main text.

The labeller is trained on the driver, in a few seconds and always with the same outcome, on pages that this module
makes up: articles of invented words in various containers, among menus, headers, footers, sidebars, notices, adverts,
forms and reader comments. TRAIN_PAGES bounds it. The weights (some tens of kB) go to the tasks with the function.

Edge cases: null, empty and textless pages give the empty text and 0 characters; cut-off pages are read as far as they
go; white space in a block is one space, and blocks are joined by one line break; equal rows give equal results, and ids
may be null or repeated; pages of any number of blocks are read in bounded stretches; an empty table gives an empty
result; only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.htmlblocks import Path, blocks
from millrace.llm.wordbytes import text_bytes, word_hashes, words

PATHS = 96
WORDS = 32
NUMBERS = 6
HIDDEN = 16
TRAIN_PAGES = 600
EPOCHS = 6
#: Blocks that go through the network together: of several pages, or a stretch of a longer page.
TOGETHER = 16_384

Weights = dict[str, np.ndarray]


@lru_cache(maxsize=20_000)
def _path_places(path: Path) -> tuple[int, ...]:
    """Where a path sets its vector: each name, and each name with its depth from the leaf for the last three."""
    places = {zlib.crc32(n.encode()) % PATHS for n in path}
    places |= {zlib.crc32(f"{k}:{n}".encode()) % PATHS for k, n in enumerate(path[: -4 : -1])}
    return tuple(places)


def vectors(found: list[tuple[str, Path, float]], lengths: list[int], first: int = 0, whole: int = 0) -> np.ndarray:
    """A row for each block; lengths: number of blocks of each page. first, whole: found is a stretch of one page of `whole` blocks, from that block on."""
    n = len(found)
    out = np.zeros((n, PATHS + WORDS + NUMBERS), np.float32)
    for i, (_, path, _) in enumerate(found):
        out[i, list(_path_places(path))] = 1
    raw, offsets = text_bytes(pa.array([t for t, _, _ in found], pa.string()))
    starts, ends, counts = words(raw, offsets)
    if len(starts):
        bucket = (word_hashes(raw, offsets, starts, ends) % np.uint64(WORDS)).astype(np.int64)
        hashed = np.bincount(np.repeat(np.arange(n), counts) * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
        out[:, PATHS : PATHS + WORDS] = hashed / np.sqrt(np.maximum((hashed**2).sum(1, keepdims=True), 1)) * 0.5
    chars = np.array([len(t) for t, _, _ in found], float)
    size = np.repeat([whole] if whole else lengths, lengths)
    place = first + np.concatenate([np.arange(k) for k in lengths]) if lengths else np.zeros(0)
    numbers = [np.log1p(chars) / 6, np.log1p(counts) / 5, np.array([s for _, _, s in found], float), place / np.maximum(size - 1, 1), np.array([t[-1:] in ".!?:;\"')" for t, _, _ in found], float), np.ones(n)]
    out[:, PATHS + WORDS :] = np.stack(numbers, 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: Weights, side: str, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, learn: bool = False) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
    """Hidden states (steps, pages, HIDDEN) of one direction over x (steps, pages, width) from a state on, what the backward pass needs (when learning), and the last state."""
    steps, pages, _ = x.shape
    into = x @ w[f"{side}x"] + w[f"{side}b"]
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    hs, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        gates = into[t] + h @ w[f"{side}h"]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        tanh_c = np.tanh(new_c)
        if learn:
            kept.append((t, h, c, i, f, o, g, tanh_c, m))
        h, c = np.where(m, o * tanh_c, h).astype(np.float32), np.where(m, new_c, c).astype(np.float32)
        hs[t] = h
    return hs, kept, (h, c)


def _backward(w: Weights, side: str, x: np.ndarray, kept: list, dhs: np.ndarray, grads: Weights) -> None:
    pages = x.shape[1]
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t, h, c, i, f, o, g, tanh_c, m in reversed(kept):
        dh_t = dh + dhs[t]
        live, rest = dh_t * m, dh_t * ~m
        dct = dc * m + live * o * (1 - tanh_c**2)
        d = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tanh_c * o * (1 - o), dct * i * (1 - g**2)], 1)
        grads[f"{side}x"] += x[t].T @ d
        grads[f"{side}h"] += h.T @ d
        grads[f"{side}b"] += d.sum(0)
        dh, dc = rest + d @ w[f"{side}h"].T, dct * f + dc * ~m


def _padded(rows: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(lengths)
    x = np.zeros((steps, len(lengths), rows.shape[1]), np.float32)
    mask = np.zeros((steps, len(lengths)), bool)
    at = 0
    for p, n in enumerate(lengths):
        x[:n, p], mask[:n, p] = rows[at : at + n], True
        at += n
    return x, mask


def _scores(w: Weights, found: list[tuple[str, Path, float]], lengths: list[int]) -> np.ndarray:
    """Chances (steps, pages). One page may be longer than TOGETHER: it goes through in stretches that hand their state on, so memory is bounded by a stretch."""
    steps = max(lengths)
    out = np.zeros((steps, len(lengths)), np.float32)
    if steps <= TOGETHER or len(lengths) > 1:
        x, mask = _padded(vectors(found, lengths), lengths)
        for side, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            out += _forward(w, side, x, mask)[0] @ w["o"][half]
        return _sigmoid(out + w["ob"])
    begins = range(0, steps, TOGETHER)
    for side, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        state = None
        for a in begins if side == "f" else reversed(begins):
            part = found[a : a + TOGETHER]
            x, mask = _padded(vectors(part, [len(part)], a, steps), [len(part)])
            hs, _, state = _forward(w, side, x, mask, state)
            out[a : a + len(part)] += hs @ w["o"][half]
    return _sigmoid(out + w["ob"])


def chances(w: Weights, found: list[tuple[str, Path, float]], lengths: list[int]) -> np.ndarray:
    """The chance of each block to be main text."""
    out = np.zeros(len(found), np.float32)
    begins = np.cumsum([0, *lengths])
    order = sorted((p for p, n in enumerate(lengths) if n), key=lambda p: lengths[p])
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and lengths[order[b]] * (b + 1 - a) <= TOGETHER:
            b += 1
        part = order[a:b]
        p_all = _scores(w, [found[i] for p in part for i in range(begins[p], begins[p + 1])], [lengths[p] for p in part])
        for k, p in enumerate(part):
            out[begins[p] : begins[p + 1]] = p_all[: lengths[p], k]
        a = b
    return out


# Names of containers and of their classes in the training pages: plain facts of common page layouts, by kind.
_KINDS: dict[str, tuple[list[str], list[str]]] = {
    "menu": (["nav", "div", "ul", "header"], ["menu", "nav", "navbar", "main-menu", "breadcrumb", "topnav", ""]),
    "header": (["header", "div"], ["header", "masthead", "site-header", "top", "banner", ""]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright", ""]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "related", "widget", "popular", "teaser", "recommended"]),
    "notice": (["div", "section", "dialog"], ["cookie", "notice", "consent", "banner", "alert", "popup", "newsletter", "subscribe"]),
    "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "banner-ad"]),
    "form": (["form", "div"], ["form", "login", "search", "contact", "signup"]),
    "comments": (["div", "section", "ol"], ["comments", "comment", "replies", "discussion", "responses", "comment-list"]),
}
_MAIN = (["article", "main", "div", "section", "td"], ["content", "article", "post", "entry-content", "main", "story", "article-body", ""])


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A made-up page, and for each of its blocks whether it is main text."""
    syllables = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouéäñ") for _ in range(rng.randint(1, 2))) for _ in range(30)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    sentence = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""])
    labels: list[bool] = []
    html: list[str] = []

    def block(tag: str, text: str, main: bool, end: bool = True) -> None:
        labels.append(main)
        html.append(f"<{tag}>{text}" + f"</{tag}>" * end)

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def opened(tags: list[str], names: list[str]) -> str:
        tag, name = rng.choice(tags), rng.choice(names)
        html.append(f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">' if name and (tag in ("div", "section", "td") or rng.random() < 0.4) else f"<{tag}>")
        return tag

    def boiler(kind: str) -> None:
        tag = opened(*_KINDS[kind])
        if kind == "menu":
            html.append("<ul>" * (tag != "ul"))
            for _ in range(rng.randint(3, 9)):
                block("li", link(word().capitalize()), False)
            html.append("</ul>" * (tag != "ul"))
        elif kind == "comments":
            for _ in range(rng.randint(1, 6)):
                block(rng.choice(["p", "li", "div"]), " ".join(sentence(3, 25) for _ in range(rng.randint(1, 3))), False)
        elif kind == "form":
            block("label", sentence(1, 4), False)
            block("button", word().capitalize(), False)
        elif kind == "sidebar":
            block("h3", sentence(1, 4), False)
            for _ in range(rng.randint(1, 6)):
                block(rng.choice(["li", "p"]), link(sentence(3, 9)) if rng.random() < 0.7 else sentence(5, 30), False)
        else:
            text = " ".join(sentence(2, 14) for _ in range(rng.randint(1, 3)))
            if kind == "footer" and rng.random() < 0.7:
                text = "&copy; " + text
            if rng.random() < 0.5:
                labels.append(False)
                html.append(text)
            else:
                block("p", text, False)
        html.append(f"</{tag}>")

    html.append(f"<html><head><title>{sentence(2, 8)}</title><style>p{{}}</style></head><body>")
    for kind in rng.sample(["menu", "header", "notice", "advert", "form"], rng.randint(1, 3)) + ["menu"] * (rng.random() < 0.5):
        boiler(kind)
    if rng.random() < 0.3:
        boiler("sidebar")
    outer = rng.random() < 0.4 and opened(["div", "section", "main"], ["wrap", "container", "page", "row", ""])
    main = opened(*_MAIN)
    if rng.random() < 0.85:
        block(rng.choice(["h1", "h1", "h2"]), sentence(2, 12), True)
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 30])):
        roll = rng.random()
        text = " ".join(sentence(1, 30) for _ in range(rng.choice([1, 1, 2, 4, 8])))
        if roll < 0.06:
            block(rng.choice(["h2", "h3", "h4"]), sentence(1, 7), True)
        elif roll < 0.12:
            html.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                block("li", sentence(2, 15), True)
            html.append("</ul>")
        elif roll < 0.2:
            block("p", f"<b>{text}<br>", True, end=False)
        elif roll < 0.25:
            block("blockquote", text, True)
        elif roll < 0.3:
            block("p", sentence(2, 8) + " " + link(word()) + " " + text, True)
        elif roll < 0.34:
            boiler("advert")
        else:
            block("p", text, True)
    html.append(f"</{main}>" + (f"</{outer}>" if outer else ""))
    for kind in [k for k in ("comments", "sidebar", "form", "notice", "advert") if rng.random() < 0.25] + ["footer"] * (rng.random() < 0.9):
        boiler(kind)
    html.append("</body></html>")
    return "".join(html), labels


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after Adam steps over made-up pages; the same every time."""
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        page, labels = training_page(rng)
        found = blocks(page)
        assert len(found) == len(labels), "a made-up page has other blocks than it was made of"
        made.append((found, labels))
    width = PATHS + WORDS + NUMBERS
    w: Weights = {}
    for side in "fb":
        w[f"{side}x"] = draw.normal(0, 0.15, (width, 4 * HIDDEN)).astype(np.float32)
        w[f"{side}h"] = draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"{side}b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    w["o"], w["ob"] = draw.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    first, second = ({k: np.zeros_like(v, dtype=float) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        rng.shuffle(made)
        for a in range(0, len(made), 24):
            part = sorted(made[a : a + 24], key=lambda x: len(x[0]))
            lengths = [len(f) for f, _ in part]
            x, mask = _padded(vectors([b for f, _ in part for b in f], lengths), lengths)
            y, _ = _padded(np.array([[v] for _, ls in part for v in ls], float), lengths)
            (forth, fa, _), (back, ba, _) = (_forward(w, side, x, mask, learn=True) for side in "fb")
            both = np.concatenate([forth, back], 2)
            p = _sigmoid(both @ w["o"] + w["ob"])
            d = np.where(mask, p - y[:, :, 0], 0) / mask.sum()
            grads = {k: np.zeros_like(v, dtype=float) for k, v in w.items()}
            grads["o"], grads["ob"] = np.tensordot(both, d, ([0, 1], [0, 1])), np.array([d.sum()])
            dboth = d[:, :, None] * w["o"]
            _backward(w, "f", x, fa, dboth[:, :, :HIDDEN], grads)
            _backward(w, "b", x, ba, dboth[:, :, HIDDEN:], grads)
            step += 1
            for k in w:
                g = np.clip(grads[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _extracted(w: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                per_page = [blocks(h) if h else [] for h in part.column(2).to_pylist()]
                lengths = [len(b) for b in per_page]
                keep = chances(w, [b for page in per_page for b in page], lengths) >= 0.5
                at, texts = 0, []
                for page in per_page:
                    texts.append("\n".join(t for (t, _, _), k in zip(page, keep[at : at + len(page)]) if k))
                    at += len(page)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(trained()), "page_id long, url string, text string, n_chars long")
