"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each block is labelled main or other from its ancestor tags, the hints in their attributes, its
text, and the label of the block before it. The weights are learnt by gradient ascent on the
likelihood (forward and backward sums) of labelled pages, and pages are decoded by Viterbi.

The labelled pages are made here, ``TRAINING_PAGES`` of them: layouts with known parts (menus,
headers, sidebars, notices, adverts, forms, reader comments, footers; with and without semantic
tags) are filled with random words of random alphabets, so nothing is learnt about any language
or about the pages to be read.

Null and empty html give an empty text. Repeated rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.html_blocks import Block, blocks
from scrubline.llm.text import small_batches

TRAINING_PAGES = 500
EPOCHS = 12
SEED = 5

# ---- features -------------------------------------------------------------------


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        density = b.link_chars / max(1, len(b.text))
        f = [
            "bias", f"tag:{b.tag}", f"words:{min(int(math.log2(n)), 6)}", f"links:{min(int(density * 4), 4)}",
            f"stop:{b.text[-1] in '.!?…:;。'}",
        ]
        f += [f"in:{t}" for t in b.ancestors]
        f += [f"hint:{h}" for h in b.hints]
        if "©" in b.text:
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        out.append(f)
    return out


# ---- the model ------------------------------------------------------------------


class Chain:
    """Two labels (0 other, 1 main); weights by feature name, and one for each pair of neighbours."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def emissions(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for names in features(page):
            a = b = 0.0
            for name in names:
                w = self.weights.get(name)
                if w:
                    a += w[0]
                    b += w[1]
            out.append((a, b))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The most probable labels (Viterbi); ties go to main."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves
        rows = self.emissions(page)
        s0, s1 = rows[0]
        back = []
        for e0, e1 in rows[1:]:
            from0 = s1 + m10 >= s0 + m00
            from1 = s1 + m11 >= s0 + m01
            s0, s1 = (s1 + m10 if from0 else s0 + m00) + e0, (s1 + m11 if from1 else s0 + m01) + e1
            back.append((int(from0), int(from1)))
        label = int(s1 >= s0)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """Gradient ascent page by page with step sizes that adapt to each weight."""
    names: dict[str, int] = {}
    data = []
    for page, labels in pages:
        if page:
            data.append(([np.array([names.setdefault(x, len(names)) for x in f]) for f in features(page)], np.array(labels)))
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gm = np.full(w.shape, 1e-6), np.full(m.shape, 1e-6)
    rng = random.Random(SEED)
    for _ in range(epochs):
        rng.shuffle(data)
        for rows, labels in data:
            n = len(rows)
            e = np.array([w[r].sum(axis=0) for r in rows])
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = e[0]
            for i in range(1, n):
                alpha[i] = e[i] + _log_sum(alpha[i - 1][:, None] + m, 0)
            for i in range(n - 2, -1, -1):
                beta[i] = _log_sum(m + (e[i + 1] + beta[i + 1])[None, :], 1)
            total = _log_sum(alpha[-1], 0)
            p = np.exp(alpha + beta - total)
            g = -p
            g[np.arange(n), labels] += 1
            pair = np.zeros((2, 2))
            for i in range(1, n):
                pair -= np.exp(alpha[i - 1][:, None] + m + (e[i] + beta[i])[None, :] - total)
                pair[labels[i - 1], labels[i]] += 1
            dw = np.zeros_like(w)
            np.add.at(dw, np.concatenate(rows), np.repeat(g, [len(r) for r in rows], axis=0))
            dw -= decay * w
            dm = pair - decay * m
            gw += dw * dw
            gm += dm * dm
            w += rate * dw / np.sqrt(gw)
            m += rate * dm / np.sqrt(gm)
    return Chain({name: (float(w[i, 0]), float(w[i, 1])) for name, i in names.items()}, m.tolist())


# ---- labelled pages -------------------------------------------------------------

SYLLABLES = "ka lo mi ren tas vol qui dur es an or it um bel fra schu ñe ö łan дом ми ра 山 水".split()
# class names for each part, used in layouts without semantic tags
STYLES = {
    "menu": ["menu", "main-nav", "navbar", "top-links", "breadcrumbs", "pagination"],
    "header": ["site-header", "masthead", "topbar", "branding"],
    "footer": ["site-footer", "footer-bottom", "copyright"],
    "sidebar": ["sidebar", "widget-area", "right-rail", "widget"],
    "ad": ["ad", "ads-box", "sponsored", "advertisement", "promo"],
    "notice": ["cookie-notice", "consent", "gdpr-popup", "alert"],
    "comments": ["comments", "comment-list", "discussion", "replies"],
    "form": ["newsletter", "login-form", "search", "subscribe"],
    "social": ["share", "social", "related", "recommended"],
    "content": ["content", "post-body", "entry-content", "article-text", "story", "main", ""],
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "content": "article", "form": "form"}


class _Maker:
    """One random page; ``marks`` gets (text, label) of each block in page order."""

    def __init__(self, rng: random.Random):
        self.rng, self.semantic, self.closed = rng, rng.random() < 0.6, rng.random() < 0.6
        self.alphabet = rng.sample(SYLLABLES, 8)

    def words(self, low: int, high: int, stop: bool) -> str:
        r = self.rng
        out = " ".join("".join(r.choices(self.alphabet, k=r.randint(1, 3))) for _ in range(r.randint(low, high)))
        return out.capitalize() + (r.choice(".…!?.") if stop else "")

    def wrap(self, part: str, inner: str) -> str:
        r = self.rng
        name = r.choice(STYLES[part])
        attribute = f' {r.choice(["class", "id"])}="{name}"' if name else ""
        if part in SEMANTIC and (self.semantic or part == "form"):
            return f"<{SEMANTIC[part]}{attribute if r.random() < 0.4 else ''}>{inner}</{SEMANTIC[part]}>"
        return f"<div{attribute}>{inner}</div>"

    def block(self, tag: str, text: str, label: int) -> str:
        return f"<{tag}>{'@1@' if label else '@0@'}{text}" + (f"</{tag}>" if self.closed or tag not in ("p", "li") else "")

    def links(self, n: int, label: int = 0) -> str:
        return "<ul>" + "".join(self.block("li", f'<a href="/x">{self.words(1, 3, False)}</a>', label) for _ in range(n)) + "</ul>"

    def boilerplate(self, part: str) -> str:
        r = self.rng
        if part in ("menu", "social"):
            return self.wrap(part, self.links(r.randint(2, 9)))
        if part == "footer":
            mark = r.choice(["© ", "© 2020 ", "", "Copyright "])
            inner = f"@0@{mark}{self.words(1, 12, r.random() < 0.7)}" + (self.links(r.randint(1, 4)) if r.random() < 0.4 else "")
            return self.wrap(part, inner)
        if part == "header":
            return self.wrap(part, self.block(r.choice(["p", "div", "h1", "h2"]), self.words(1, 6, False), 0))
        if part == "form":
            return self.wrap(part, f"@0@<label>{self.words(1, 6, False)}</label><input name=q><button>{self.words(1, 2, False)}</button>")
        if part == "comments":
            inner = "".join(self.block(r.choice(["p", "li", "div"]), self.words(3, 60, True), 0) for _ in range(r.randint(1, 6)))
            return self.wrap(part, self.block("h3", self.words(1, 3, False), 0) + inner)
        kinds = {"sidebar": (2, 40), "ad": (3, 40), "notice": (5, 40)}
        if r.random() < 0.5:
            return self.wrap(part, f"@0@{self.words(*kinds[part], r.random() < 0.7)}")
        return self.wrap(part, "".join(self.block("p", self.words(*kinds[part], r.random() < 0.7), 0) for _ in range(r.randint(1, 3))))

    def article(self) -> str:
        r = self.rng
        parts = [self.block("h1", self.words(2, 12, r.random() < 0.3), 1)] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15])):
            kind = r.random()
            if kind < 0.75:
                text = self.words(1, r.choice([3, 8, 30, 120]), r.random() < 0.85)
                if r.random() < 0.25:
                    text += f' <a href="/y">{self.words(1, 4, False)}</a> {self.words(1, 6, True)}'
                if r.random() < 0.3:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f"<b>{text}</b>"
                parts.append(self.block("p", text, 1))
            elif kind < 0.82:
                parts.append("<ul>" + "".join(self.block("li", self.words(1, 20, r.random() < 0.5), 1) for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(self.block(r.choice(["h2", "h3"]), self.words(1, 8, False), 1))
            elif kind < 0.91:
                parts.append("<blockquote>" + self.block("p", self.words(3, 30, True), 1) + "</blockquote>")
            elif kind < 0.94:
                row = "".join(self.block("td", self.words(1, 3, False), 1) for _ in range(r.randint(2, 3)))
                parts.append(f"<table><tr>{row}</tr></table>")
            else:
                parts.append(self.boilerplate(r.choice(["ad", "ad", "social", "form", "notice", "sidebar"])))
        if r.random() < 0.15:
            parts.append(self.boilerplate("comments"))
        return self.wrap("content", "".join(parts))

    def page(self) -> str:
        r = self.rng
        before = [p for p in ("notice", "header", "menu", "ad", "form") if r.random() < 0.45]
        after = [p for p in ("comments", "sidebar", "social", "ad", "form", "notice", "footer") if r.random() < 0.4]
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        side = self.boilerplate("sidebar") if r.random() < 0.2 else ""
        middle = side + self.article() if r.random() < 0.9 else self.boilerplate("header")
        if r.random() < 0.3:
            middle = f"<main>{middle}</main>"
        inner = "".join(map(self.boilerplate, before)) + middle + "".join(map(self.boilerplate, after))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8, False)}</title><script>x=1</script></head><body>{inner}"


def labelled_page(seed: int) -> tuple[str, list[str], list[int]]:
    """(html, block texts, labels) of a made page."""
    marked = _Maker(random.Random(seed)).page()
    found = blocks(marked)
    html = marked.replace("@0@", "").replace("@1@", "")
    texts = [b.text.replace("@0@", "").replace("@1@", "").strip() for b in found]
    return html, texts, [int("@1@" in b.text) for b in found]


def trained(pages: int = TRAINING_PAGES) -> Chain:
    data = []
    for seed in range(pages):
        html, texts, labels = labelled_page(seed)
        found = blocks(html)
        if [b.text for b in found] == texts:
            data.append((found, labels))
    return train(data)


# ---- extraction -----------------------------------------------------------------


def main_text(html: str, chain: Chain) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, label in zip(page, chain.decode(page), strict=True) if label)


def extract(
    pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    chain = chain or trained()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h.as_py() or "", chain) for h in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.arrow_udf(run, "string")(F.col(html_col))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
