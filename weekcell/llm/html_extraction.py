"""Main text of HTML pages by a recurrent block labeller.

A bidirectional LSTM (NumPy only) reads a page's blocks in order. Of each block it sees the hashed signs of the tag path, the hashed
words and a few counts; its state carries what stands before and behind, so each block is judged in the context of the whole page.

It is trained here: on a bounded sample of the pages, labelled by what their own tags say, and on the same sample's texts set anew in many
made-up layouts, whose labels are known. Only training uses these rules; pages are labelled by the network alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcell.llm.html_blocks import Block, blocks
from weekcell.llm.memo import Memo
from weekcell.llm.registry import query, table

#: Pages that training sees, and the longest of them in characters. Labelling has no such limits.
FIT_PAGES = 300
FIT_CHARS = 200_000
MADE_UP_PAGES = 900
HIDDEN = 24
STEPS = 450
_PATH, _OWN, _WORDS, _COUNTS = 160, 64, 48, 6
INPUT = _PATH + _OWN + _WORDS + _COUNTS

#: Signs of content and of what is around it, for the labels of training pages; and names for the made-up layouts.
CONTENT_SIGNS = frozenset(["article", "main"])
AROUND_SIGNS = frozenset("nav header footer aside form ad ads advert sidebar comments comment menu cookie banner".split())
CONTENT_NAMES = ("content", "post-content", "entry-content", "article-body", "story-body", "post", "entry", "text", "main-content", "article", "body-copy", "page-content")
MENU_NAMES = ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "pagination", "toc-links", "site-nav", "main-menu")
HEADER_NAMES = ("header", "site-header", "masthead", "page-header", "branding", "logo", "top", "hero-bar")
FOOTER_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal", "foot", "colophon")
SIDE_NAMES = ("sidebar", "widget", "related", "related-posts", "recommended", "side", "rail", "more-stories", "popular", "trending", "tags", "author-box")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adsense", "promotion", "sponsor")
NOTICE_NAMES = ("notice", "cookie-banner", "cookie-notice", "consent", "alert", "gdpr", "newsletter", "subscribe", "popup", "modal", "warning", "paywall")
SHARE_NAMES = ("share", "social", "share-buttons", "follow-us", "social-links")
COMMENT_NAMES = ("comments", "comment-list", "reader-comments", "discussion", "responses", "disqus", "replies", "comment-section")
PLAIN_NAMES = ("container", "wrapper", "row", "col", "page", "inner", "block", "section", "box", "grid")


def _slot(sign: str, n: int) -> int:
    return xxhash.xxh32_intdigest(sign) % n


_PATHS = Memo(lambda path: (sorted({_slot(s, _PATH) for e in path for s in e}),
                            sorted({_slot(s, _OWN) for s in path[-1]}) if path else []), limit=16 << 20, longest=40)
_WORD = Memo(lambda w: (_slot(w, _WORDS), 1.0 if xxhash.xxh32_intdigest(w, 1) & 1 else -1.0), limit=8 << 20)


def features(page: list[Block]) -> np.ndarray:
    """(blocks, INPUT) numbers of a page."""
    out = np.zeros((len(page), INPUT), dtype=np.float32)
    for k, b in enumerate(page):
        signs, own = _PATHS[b.path]
        out[k, signs] = 1.0
        out[k, [_PATH + s for s in own]] = 1.0
        words = b.text.lower().split()
        size = 1.0 / len(words) ** 0.5
        for w in words:
            place, sign = _WORD[w]
            out[k, _PATH + _OWN + place] += sign * size
        n = len(b.text)
        marks = sum(map(b.text.count, ".,;:!?"))
        out[k, -_COUNTS:] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, min(1.0, b.linked / n), min(1.0, 8 * marks / n),
                             1.0 if b.text[-1] in ".!?" else 0.0, 1.0)
    return out


@dataclass
class Labeller:
    """Weights by direction (input and state to the four gates), and those of the output."""
    gates: list[np.ndarray]
    out: np.ndarray


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _run(gates: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, pages, HIDDEN) of one direction over x (time, pages, INPUT); a page's state rests where mask is 0."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    ahead = (x.reshape(-1, INPUT) @ gates[:INPUT]).reshape(steps, pages, -1)
    back = gates[INPUT:]
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = ahead[t] + h @ back
        i, f, o = np.split(_sigmoid(z[:, :3 * HIDDEN]), 3, axis=1)
        g = np.tanh(z[:, 3 * HIDDEN:])
        new = f * c + i * g
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, new))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[t] = h
    return out


def _learn(gates: np.ndarray, x: np.ndarray, mask: np.ndarray, kept: list, slope: np.ndarray) -> np.ndarray:
    """Gradient of the gates given that of the states."""
    grad = np.zeros_like(gates)
    back = gates[INPUT:]
    dh, dc = np.zeros_like(slope[0]), np.zeros_like(slope[0])
    dz_all = np.zeros((*slope.shape[:2], 4 * HIDDEN), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, new = kept[t]
        m = mask[t][:, None]
        dh = dh + slope[t]
        tanh = np.tanh(new)
        d_new = np.where(m, dc + dh * o * (1 - tanh ** 2), 0)
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(m, dh * tanh, 0) * o * (1 - o), d_new * i * (1 - g ** 2)], axis=1)
        dz_all[t] = dz
        grad[INPUT:] += h.T @ dz
        dc = np.where(m, d_new * f, dc)
        dh = np.where(m, 0, dh) + dz @ back.T
    grad[:INPUT] = x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN)
    return grad


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


def probabilities(model: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Per page, each block's chance of being content."""
    x, mask = _batch(pages)
    # a page that has ended rests, so reading from behind starts at its last block
    ahead, behind = _run(model.gates[0], x, mask), _run(model.gates[1], x[::-1], mask[::-1])[::-1]
    z = np.concatenate([ahead, behind], axis=2) @ model.out[:-1] + model.out[-1]
    p = _sigmoid(z)
    return [p[:len(page), k] for k, page in enumerate(pages)]


def fit(pages: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Labeller:
    draw = np.random.default_rng(seed)
    scale = (6.0 / (INPUT + HIDDEN)) ** 0.5
    weights = [draw.uniform(-scale, scale, (INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
    for w in weights:
        w[INPUT - 1, HIDDEN:2 * HIDDEN] = 1.0  # the constant input opens the forget gates
    weights.append(draw.uniform(-0.3, 0.3, 2 * HIDDEN + 1).astype(np.float32))
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        pick = draw.choice(len(pages), min(batch, len(pages)), replace=False)
        x, mask = _batch([pages[k] for k in pick])
        x = x * (draw.random(x.shape) > 0.1)  # signs are missing now and then, so none is relied on alone
        y = np.zeros(mask.shape, np.float32)
        for j, k in enumerate(pick):
            y[:len(labels[k]), j] = labels[k]
        kept = [[], []]
        ahead = _run(weights[0], x, mask, kept[0])
        behind = _run(weights[1], x[::-1], mask[::-1], kept[1])
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        slope = np.where(mask, _sigmoid(both @ weights[2][:-1] + weights[2][-1]) - y, 0).astype(np.float32) / max(1, mask.sum())
        out = np.append((both * slope[..., None]).sum(axis=(0, 1)), slope.sum()).astype(np.float32)
        d = slope[..., None] * weights[2][:-1]
        grads = [_learn(weights[0], x, mask, kept[0], d[..., :HIDDEN]), _learn(weights[1], x[::-1], mask[::-1], kept[1], d[::-1, :, HIDDEN:]), out]
        norm = sum(float((g ** 2).sum()) for g in grads) ** 0.5
        for k, g in enumerate(grads):
            g = g * min(1.0, 1.0 / max(norm, 1e-6))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g ** 2
            weights[k] = weights[k] - (rate * (1 - 0.8 * t / steps) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return Labeller(weights[:2], weights[2])


def own_labels(page: list[Block]) -> np.ndarray | None:
    """1 inside an article or main element and outside of what its signs call otherwise; None if the page has no such element."""
    out = []
    for b in page:
        inside = [k for k, e in enumerate(b.path) if CONTENT_SIGNS & set(e)]
        out.append(float(bool(inside) and not any(AROUND_SIGNS & set(e) for e in b.path[inside[0]:])))
    return np.array(out, np.float32) if any(out) else None


def _made_up(draw: random.Random, texts: list[str]) -> tuple[str, list[float]]:
    """A page in a made-up layout, and the labels of its blocks."""
    parts: list[str] = []
    labels: list[float] = []

    def words(low: int, high: int) -> str:
        w = draw.choice(texts).split()
        n = draw.randint(low, high)
        at = draw.randrange(max(1, len(w) - n))
        return html_safe(" ".join(w[at:at + n])) or "more"

    def put(tag: str, text: str, label: float) -> None:
        parts.append(f"<{tag}>{text}</{tag}>")
        labels.append(label)

    def attribute(names) -> str:
        name = draw.choice(names)
        return draw.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {draw.choice(PLAIN_NAMES)}"'])

    def boxed(tag: str, names, inner) -> None:
        named = tag in ("div", "section", "ul") or draw.random() < 0.4
        parts.append(f"<{tag}{attribute(names) if named else ''}>")
        inner()
        parts.append(f"</{tag}>")

    def links(n_low=2, n_high=8) -> None:
        parts.append("<ul>")
        for _ in range(draw.randint(n_low, n_high)):
            parts.append("<li>")
            put("a href='/x'", words(1, 4), 0.0)
            parts[-1] = parts[-1].replace("</a href='/x'>", "</a>")
            parts.append("</li>")
        parts.append("</ul>")

    def prose(label: float, low=1, high=3) -> None:
        for _ in range(draw.randint(low, high)):
            put(draw.choice(["p", "p", "div", "span><br" if False else "p"]), words(3, 40), label)

    def menu():
        boxed(draw.choice(["nav", "nav", "div"]), MENU_NAMES, links)

    def header():
        boxed(draw.choice(["header", "div"]), HEADER_NAMES, lambda: (put(draw.choice(["h1", "h2", "p", "div"]), words(1, 6), 0.0), draw.random() < 0.5 and menu()))

    def footer():
        boxed(draw.choice(["footer", "footer", "div"]), FOOTER_NAMES, lambda: (put(draw.choice(["p", "div"]), "&copy; " + words(2, 16), 0.0), draw.random() < 0.4 and links(1, 4)))

    def side():
        boxed(draw.choice(["aside", "div", "section"]), SIDE_NAMES, lambda: (put(draw.choice(["h2", "h3", "h4"]), words(1, 4), 0.0), draw.choice([links, lambda: prose(0.0)])()))

    def advert():
        boxed(draw.choice(["div", "div", "aside", "section"]), AD_NAMES, lambda: prose(0.0, 1, 2))

    def notice():
        boxed(draw.choice(["div", "div", "section"]), NOTICE_NAMES, lambda: (prose(0.0, 1, 2), draw.random() < 0.5 and put("button", words(1, 2), 0.0)))

    def share():
        boxed("div", SHARE_NAMES, lambda: draw.choice([lambda: links(1, 3), lambda: prose(0.0, 1, 1)])())

    def form():
        parts.append("<form>")
        for _ in range(draw.randint(1, 3)):
            put("label", words(1, 4), 0.0)
        draw.random() < 0.5 and prose(0.0, 1, 1)
        put("button", words(1, 2), 0.0)
        parts.append("</form>")

    def comments():
        def inner():
            put(draw.choice(["h2", "h3"]), words(1, 3), 0.0)
            for _ in range(draw.randint(1, 5)):
                boxed(draw.choice(["div", "article", "li"]), ("comment", "reply", "response", "comment-body"), lambda: prose(0.0, 1, 2))
        boxed(draw.choice(["section", "div"]), COMMENT_NAMES, inner)

    def content():
        def inner():
            if draw.random() < 0.8:
                put(draw.choice(["h1", "h1", "h2"]), words(3, 14), 1.0)
            for _ in range(draw.choice([1, 2, 3, 5, 8, 12])):
                kind = draw.random()
                if kind < 0.75:
                    put("p", words(1, 90), 1.0)
                elif kind < 0.82:
                    put(draw.choice(["h2", "h3"]), words(1, 8), 1.0)
                elif kind < 0.88:
                    put(draw.choice(["blockquote", "pre", "div"]), words(3, 40), 1.0)
                elif kind < 0.93:
                    parts.append("<ul>")
                    for _ in range(draw.randint(1, 4)):
                        put("li", words(2, 15), 1.0)
                    parts.append("</ul>")
                else:
                    draw.choice([advert, advert, share, notice, side, form])()
        tag = draw.choice(["article", "article", "main", "div", "div", "section"])
        boxed(tag, CONTENT_NAMES, inner) if tag != "main" or draw.random() < 0.5 else boxed("main", CONTENT_NAMES, lambda: boxed("article", CONTENT_NAMES, inner))

    before = [draw.choice([menu, header, advert, notice, form, share, menu, header]) for _ in range(draw.randint(0, 4))]
    after = [draw.choice([side, advert, comments, share, notice, form, side, comments]) for _ in range(draw.randint(0, 4))]
    wrappers = [draw.choice(PLAIN_NAMES) for _ in range(draw.randint(0, 2))]
    parts.append("<html><head><title>x</title></head><body>" + "".join(f'<div class="{w}">' for w in wrappers))
    for make in before:
        make()
    content()
    for make in after:
        make()
    if draw.random() < 0.8:
        footer()
    return "".join(parts), labels


def html_safe(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def fit_labeller(pages: DataFrame) -> Labeller | None:
    """A labeller from FIT_PAGES pages (those with the smallest hash of page_id); None if no page has a text."""
    sample = [r.html for r in pages.filter(F.length("html") <= FIT_CHARS).select("page_id", "html")
              .orderBy(F.xxhash64("page_id"), "page_id", "html").limit(FIT_PAGES).select("html").collect()]
    parsed = [p for p in (blocks(h or "") for h in sample) if p]
    xs, ys = [], []
    for page in parsed:
        own = own_labels(page)
        if own is not None:
            xs.append(features(page[:400]))
            ys.append(own[:400])
    texts = [b.text for page in parsed for b in page]
    if not texts:
        return None
    draw = random.Random(17)
    while len(xs) < len(parsed) + MADE_UP_PAGES:
        page, labels = _made_up(draw, texts)
        found = blocks(page)
        if len(found) == len(labels):
            xs.append(features(found))
            ys.append(np.array(labels, np.float32))
    return fit(xs, ys)


def _extract(model: Labeller, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts = batch.column("__html"), [""] * batch.num_rows
            for low in range(0, batch.num_rows, 128):
                parsed = {k: blocks(column[k].as_py() or "") for k in range(low, min(low + 128, batch.num_rows))}
                order = sorted((k for k in parsed if parsed[k]), key=lambda k: len(parsed[k]))
                while order:
                    # pages of like length together, so that little of a batch is filling
                    longest = len(parsed[order[-1]])
                    n = max(1, min(len(order), 20_000 // longest))
                    group, order = order[-n:], order[:-n]
                    for k, p in zip(group, probabilities(model, [features(parsed[k]) for k in group])):
                        texts[k] = "\n\n".join(b.text for b, x in zip(parsed[k], p) if x >= 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "main_text"])
    return run


def extract(pages: DataFrame, model: Labeller | None, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` (a column of that name is replaced): blocks judged content, joined by blank lines.

    A null or empty page, a page without content, and every page when there is no model have an empty text.
    """
    pages = pages.drop("main_text")
    if model is None:
        return pages.withColumn("main_text", F.lit(""))
    return pages.withColumn("__html", F.col(html).cast("string")).mapInArrow(
        _extract(model, pages.columns), T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    out = extract(pages.select("page_id", "url", "html"), fit_labeller(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
