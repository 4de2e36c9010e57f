"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Every block element gets features of its subtree (text, density of links and
tags, share of the page), of its attribute tokens, of its depth and of its
siblings. Boosted trees give the log odds that it belongs to the article. They
are trained on a bounded sample of ``SAMPLE`` pages, where element names and
attribute tokens with a fixed meaning mark article and surroundings; copies of
these pages with other element names, attribute tokens and added notices,
comments, forms and sidebars teach the trees what does not depend on names.

Decoding gives every node one of three states: around the article, in it, or
apart from it. An article has no container around it below itself, and nothing
below what stands apart is in the article; a dynamic programme over the tree
finds the best sum of log odds under these rules, so an ancestor and a
descendant never contradict each other.

A null or empty page, or one without an article, has an empty text. Repeated
pages are extracted alike.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm import boosting
from hearth.llm.common import append_columns
from hearth.llm.dom import Page, read

SAMPLE = 400
BATCH_NODES = 20_000

# fixed meanings of element names and attribute tokens
APART_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option textarea label fieldset menu dialog svg head search canvas object".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd table tr td th tbody thead".split())
APART_NAMES = (
    "ad ads adv advert adverts advertisement banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail "
    "footer foot header masthead comment comments reply replies disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended trending widget toolbar pagination pager copyright legal tags search form"
).split()
MAIN_NAMES = "article content main post entry story text body".split()
APART_SET, MAIN_SET = frozenset(APART_NAMES), frozenset(MAIN_NAMES)
N_FEATURES = 25


def node_features(page: Page) -> np.ndarray:
    n = len(page.tags)
    own, linked, words, stops, blocks = (np.zeros(n) for _ in range(5))
    for node, text, link in page.segments:
        own[node] += len(text)
        linked[node] += link
        words[node] += text.count(" ") + 1
        stops[node] += text.count(".") + text.count(",")
        blocks[node] += 1
    parents = page.parents
    tags_in = 1.0 + np.array(page.inline, float)
    depth, kin, place = [0] * n, [0] * n, [0] * n
    flags = np.zeros((n, 4))  # apart / main by tag or name, here and above
    for i in range(n):
        tag, names = page.tags[i], page.names[i]
        flags[i, 0] = sum(w in APART_SET for w in names)
        flags[i, 1] = sum(w in MAIN_SET for w in names)
        if i:
            up = parents[i]
            depth[i] = depth[up] + 1
            place[i] = kin[up]
            kin[up] += 1
            flags[i, 2] = flags[up, 2] + (flags[up, 0] > 0) + (page.tags[up] in APART_TAGS)
            flags[i, 3] = flags[up, 3] + (flags[up, 1] > 0) + (page.tags[up] in MAIN_TAGS)
    sums = np.stack([own, linked, words, stops, blocks, tags_in], axis=1)
    for i in range(n - 1, 0, -1):
        sums[parents[i]] += sums[i]
    text, link, word, stop, block, tags = sums.T
    before, after = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    for i in range(1, n):
        if parents[i] in last:
            before[i], after[last[parents[i]]] = text[last[parents[i]]], text[i]
        last[parents[i]] = i
    siblings = np.array([kin[p] if p >= 0 else 1 for p in parents], float)
    kinds = np.array([[t in APART_TAGS, t in MAIN_TAGS, t in HEADINGS, t in LISTS, t == "p", t == "header", t in ("div", "section")] for t in page.tags], float)
    some = np.maximum(text, 1)
    return np.column_stack([
        kinds, np.log1p(text), link / some, tags / (some + 20), depth, np.array(place) / np.maximum(siblings, 1), np.log(siblings), text / max(text[0], 1),
        stop / np.maximum(word, 1), word / np.maximum(block, 1), flags, np.log1p(before), np.log1p(after), np.log1p(own), np.log1p(block), kin,
    ])


def taught_labels(page: Page) -> list[int | None]:
    """1 in the article, 0 apart from it, None around it, by marks, element names and attribute tokens."""
    labels: list[int | None] = [None] * len(page.tags)
    for i in range(1, len(page.tags)):
        tag, names, up = page.tags[i], page.names[i], labels[page.parents[i]]
        if page.labels[i] is not None:
            own = page.labels[i]
        elif tag in APART_TAGS or (tag == "header" and up is None) or any(w in APART_SET for w in names):
            own = 0
        elif tag in MAIN_TAGS or (up is None and any(w in MAIN_SET for w in names)):
            own = 1
        else:
            own = None
        labels[i] = 0 if up == 0 else own if own is not None else up
    return labels


def variants(source: str, seed: int) -> list[str]:
    """The page, and copies of it with other element names and surroundings; marks say what is what."""
    rng = random.Random(seed)
    page = read(source)
    texts = [t for _, t, _ in page.segments] or ["text"]

    def some() -> str:
        return rng.choice(texts)[: rng.randrange(20, 400)]

    def apart() -> str:
        name = rng.choice(APART_NAMES + [""] * 4)
        attribute = f' class="{name}"' if name else ""
        tag = rng.choice(["div", "section", "ul", "aside", "form"])
        links = rng.random() < (0.4 if name or tag in ("aside", "form") else 1.0)
        inner = "".join(f"<li><a href=#>{t}</a></li>" for t in (some()[:25] for _ in range(rng.randrange(2, 9)))) if links else f"<p>{some()}</p>"
        return f"<{tag}{attribute} data-label=0>{inner}</{tag}>"

    out = [source]
    for _ in range(2):
        name = rng.choice(MAIN_NAMES + ["", "", "", "x"])
        open_tag = f'<{rng.choice(["div", "section", "td"])} {f"class={name}" if name else ""} data-label=1>'
        inner = open_tag + "".join(f"<{t}>{s}</{t}>" for t, s in ((rng.choice(["h2", "p", "p", "p", "p"]), s) for n, s, _ in page.segments if taught_keep(page, n))) + (apart() if rng.random() < 0.5 else "")
        out.append("<html><body>" + "".join(apart() for _ in range(rng.randrange(1, 4))) + "<div>" + inner + "</" + open_tag[1:].split()[0] + ">" + (apart() if rng.random() < 0.5 else "") + "</div>" + apart() + "</body></html>")
    return out


def taught_keep(page: Page, node: int) -> bool:
    labels = page.__dict__.setdefault("_taught", taught_labels(page))
    return labels[node] == 1


def fit(pages: DataFrame, html_col: str = "html") -> boosting.Boosted:
    """Trees from about SAMPLE pages, chosen by a hash of the page; only their node features reach the driver."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("html", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.where(draw < SAMPLE / max(1, total)).distinct()

    def expand(sources: list[bytes]) -> list[pa.Array]:
        found = []
        for source in sources:
            parts = []
            for variant in variants(source.decode("utf-8", "replace"), len(source)):
                page = read(variant)
                labels = taught_labels(page)
                keep = [i for i, v in enumerate(labels) if v is not None]
                parts.append(np.column_stack([node_features(page)[keep], [labels[i] for i in keep]]))
            found.append(np.concatenate(parts).astype("<f4").tobytes())
        return [pa.array(found, pa.binary())]

    got = append_columns(chosen, "html", expand, [("nodes", T.BinaryType())]).select("nodes").orderBy(F.xxhash64("nodes")).limit(2 * SAMPLE)
    data = np.concatenate([np.zeros((0, N_FEATURES + 1), "<f4"), *(np.frombuffer(r.nodes, "<f4").reshape(-1, N_FEATURES + 1) for r in got.toLocalIterator())])
    x, y = data[:, :-1].astype(float), data[:, -1].astype(float)
    share = np.array([max(1, len(y) - y.sum()), max(1, y.sum())])
    return boosting.train(x, y, (len(y) / 2 / share)[y.astype(int)])


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each node is in the article, by the best consistent assignment of states."""
    n = len(page.tags)
    within, apart, around = odds.copy(), -odds, np.zeros(n)
    weigh_in, weigh_around = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        within[i] += weigh_in[i]
        around[i] += weigh_around[i]
        up = page.parents[i]
        if up >= 0:
            apart[up] += apart[i]
            weigh_in[up] += max(within[i], apart[i])
            weigh_around[up] += max(around[i], within[i], apart[i])
    states = [0] * n  # 0 around, 1 in the article, 2 apart
    for i in range(n):
        up = states[page.parents[i]] if i else 0
        options = {0: (around[i], within[i], apart[i]), 1: (-np.inf, within[i], apart[i]), 2: (-np.inf, -np.inf, apart[i])}[up]
        states[i] = int(np.argmax(options))
    return [s == 1 for s in states]


def main_texts(sources: list[str], model: boosting.Boosted) -> list[str]:
    pages = [read(s) for s in sources]
    out: list[str] = []
    low = 0
    while low < len(pages):
        high, nodes = low, 0
        while high < len(pages) and nodes < BATCH_NODES:
            nodes += len(pages[high].tags)
            high += 1
        odds = model.log_odds(np.concatenate([node_features(p) for p in pages[low:high]]))
        at = 0
        for page in pages[low:high]:
            kept = decode(page, odds[at : at + len(page.tags)])
            at += len(page.tags)
            out.append("\n".join(t for node, t, _ in page.segments if kept[node]))
        low = high
    return out


def extract(pages: DataFrame, model: boosting.Boosted, html_col: str = "html") -> DataFrame:
    """``pages`` and text, the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few trees, whatever the input

    def compute(sources: list[bytes]) -> list[pa.Array]:
        return [pa.array(main_texts([s.decode("utf-8", "replace") for s in sources], shared.value), pa.string())]

    return append_columns(pages, html_col, compute, [("text", T.StringType())])
