"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block
has features of its ancestors (tags, class and id words), its parent and its text
(length, closing marks, links, digits, ...). A two-label chain (kept or not) is
trained on labelled pages by gradient steps on the exact likelihood
(forward-backward in log space) and decoded by Viterbi. Blocks labelled as main
text are joined in page order.

Training pages are made by `labelled_pages`, which lays out articles among
menus, headers, footers, sidebars, notices, adverts, forms, comments and link
lists in many ways; callers may pass pages of their own. Contents of scripts,
styles, templates and the page's head are never text. Character references are
decoded; white space inside a block becomes one space; inline tags join, `<br>`
counts as white space.

Defined results: a null or empty html gives the empty text. Quotes in a tag count
after ``=`` only; a quote that is never closed is a plain character, so its tag
ends at the next ``>``, as does a comment that is never closed; a tag with no
``>`` after it is no text. A script or style that is never closed hides the rest.
The ``hidden`` attribute and styles are not looked at. A page of any length is
read whole, in time that grows with its length; only features are bounded (an
element knows `KNOWN` words of its ancestors). Ties between labels go to "not
kept"; repeated rows get equal results; an empty table gives an empty table.
Other columns are passed through by `extract`, except ones named as its outputs.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomgraph.ship import ship

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the left ends an open one of the right, within the nearest container.
ENDS = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CONTAINERS = frozenset("article aside body div dl fieldset footer form header main menu nav ol section table td th ul".split())
#: Elements that set a part of the page apart; the nearest one tells most of what a block is.
SECTIONS = frozenset("article aside dialog div footer form header main nav section".split())
CLOSES_P = BLOCK_TAGS - {"html", "body"}

#: Words of its ancestors that an element knows at most.
KNOWN = 400

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_QUOTE = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    around: frozenset[str]
    parent: str
    near: tuple[str, ...]
    linked: int


@dataclass
class _Node:
    """An open element; `block` and `near` are the tag of the nearest block and the words of the nearest section, itself included."""

    tag: str
    around: frozenset[str]
    hidden: bool
    block: str
    near: tuple[str, ...]


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at `at` ends: at its first ``>`` outside of quoted values. There is a ``>`` after `at`."""
    look = at
    while m := _QUOTE.search(page, look):
        if not m[1]:
            return m.start()
        if (look := page.find(m[1], m.end()) + 1) == 0:
            break
    return page.find(">", m.end() if m and page.find(">", m.end()) >= 0 else at)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in page order, without those that hold no text."""
    out: list[Block] = []
    stack = [_Node("", frozenset(), False, "", ())]
    count: dict[str, int] = {}
    sets: dict[tuple[frozenset[str], str], frozenset[str]] = {}
    held: list[str] = []
    linked, anchors, hidden = 0, 0, 0
    owner = stack[0]

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(text, owner.around, stack[-1].block, stack[-1].near, linked))
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked, owner
        if text and not hidden:
            if not held and text.strip():
                owner = stack[-1]
            held.append(text)
            if anchors:
                linked += len(text.strip())

    def pop(k: int) -> None:
        nonlocal anchors, hidden
        for n in stack[k:]:
            anchors -= n.tag == "a"
            hidden -= n.hidden
            count[n.tag] -= 1
        del stack[k:]

    at, last = 0, page.rfind(">")
    missing: set[str] = set()
    find = _START.search
    while (m := find(page, at)) and m.start() < last:
        say(page[at : m.start()])
        if not m[2]:
            at = 0
            if m[0] == "<!--" and "-->" not in missing:
                at = page.find("-->", m.end() - 2) + 3
                if at < 3:
                    missing.add("-->")
            if at < 3:
                at = page.find(">", m.end()) + 1 or m.end()
            continue
        end = _tag_end(page, m.end())
        own = page[m.end() : end]
        at = end + 1
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            if count.get(tag):
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P and count.get("p"):
                k = _open(stack, ("p",))
                if k:
                    pop(k)
            if tag in ENDS and any(count.get(t) for t in ENDS[tag].split()) and (k := _open(stack, tuple(ENDS[tag].split()))):
                pop(k)
        if tag in VOID:
            continue
        words = [tag]
        if own:
            for a in _ATTR.finditer(own):
                words += [f"={w}" for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())]
        above = stack[-1]
        key = (above.around, " ".join(words))
        if key not in sets:
            sets[key] = key[0].union(words) if len(key[0]) < KNOWN else key[0]
        stack.append(_Node(tag, sets[key], tag in HIDDEN, tag if tag in BLOCK_TAGS else above.block, tuple(words) if tag in SECTIONS else above.near))
        count[tag] = count.get(tag, 0) + 1
        anchors += tag == "a"
        hidden += tag in HIDDEN
        if tag in RAW:
            closing = None if tag in missing else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if closing:
                at = closing.end()
            else:
                # none further on either
                missing.add(tag)
                at = page.find("<", at) if tag in ("textarea", "title") else -1
                at = len(page) if at < 0 else at
            pop(len(stack) - 1)
        elif own.rstrip().endswith("/") and tag not in BLOCK_TAGS and tag in HIDDEN:
            pop(len(stack) - 1)
    tail = page[at:]
    cut = re.search(r"<(?:[a-zA-Z/!?]|\Z)", tail)
    say(tail[: cut.start()] if cut else tail)
    flush()
    return out


def _open(stack: list[_Node], tags: tuple[str, ...]) -> int:
    """Index of the open element among `tags` that a new one ends, 0 if none; containers shield what is outside of them."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            return i
        if stack[i].tag in CONTAINERS:
            return 0
    return 0


def text_features(b: Block) -> list[str]:
    t = b.text
    size = len(t)
    words = t.count(" ") + 1
    out = [
        f"len{min(9, size.bit_length())}",
        f"words{min(7, words.bit_length())}",
        "ends" if t[-1] in ".!?…:;\"'”»)" else "open",
        f"stops{min(4, t.count('. ') + t.count('? ') + t.count('! '))}",
        f"commas{min(3, t.count(','))}",
        f"links{0 if not b.linked else 1 + min(3, 4 * b.linked // max(1, size))}",
        f"parent_{b.parent}",
    ]
    out += [f"near_{w}" for w in b.near]
    if any(c in t for c in "©®™"):
        out.append("rights")
    if "|" in t or "·" in t or "»" in t:
        out.append("bars")
    if any(c.isdigit() for c in t):
        out.append("digits")
    if t == t.upper() and t != t.lower():
        out.append("capitals")
    return out


@dataclass
class ChainModel:
    """Weights of the chain: `unary[f]` adds to the score of "kept", `step[a, b]` to going from label a to b, `first[a]` to beginning with a."""

    unary: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels by Viterbi."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.first[0], self.first[1] + scores[0]
        back: list[tuple[int, int]] = []
        for s in scores[1:]:
            pa, pb = (0, 0) if a + s00 >= b + s10 else (1, 0), (0, 1) if a + s01 >= b + s11 else (1, 1)
            na = a + s00 if pa[0] == 0 else b + s10
            nb = (a + s01 if pb[0] == 0 else b + s11) + s
            back.append((pa[0], pb[0]))
            a, b = na, nb
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def reader(self):
        """A function from html to the main text. Scores of ancestor sets are remembered, within bounds."""
        around: dict[frozenset[str], float] = {}
        get = self.unary.get

        def read(page: str | None) -> str:
            found = blocks(page) if page else []
            if not found:
                return ""
            scores = []
            for b in found:
                s = around.get(b.around)
                if s is None:
                    if len(around) > 20_000:
                        around.clear()
                    s = around[b.around] = sum(get(f"in_{w}", 0.0) for w in b.around)
                scores.append(self.bias + s + sum(get(f, 0.0) for f in text_features(b)))
            return " ".join(b.text for b, y in zip(found, self.decode(scores), strict=True) if y)

        return read


def train(pages: list[tuple[str, list[int]]], rounds: int = 250, ridge: float = 0.01) -> ChainModel:
    """Fit on pages with a label for each of their blocks, by Nesterov steps on the penalised log likelihood."""
    rows, number = [], {}
    seqs = []
    for page, labels in pages:
        found = blocks(page)
        assert len(found) == len(labels), (len(found), len(labels))
        if not found:
            continue
        seqs.append(labels)
        for b in found:
            rows.append([number.setdefault(f, len(number)) for f in [*(f"in_{w}" for w in b.around), *text_features(b)]])
    n, d, top = len(seqs), len(number), max(map(len, seqs))
    col = np.array([c for r in rows for c in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = np.array([len(s) for s in seqs])
    y = np.zeros((n, top), np.int64)
    mask = np.arange(top)[None, :] < size[:, None]
    y[mask] = np.concatenate(seqs)
    pair = mask[:, 1:]
    gold_step = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    gold_first = np.array([(y[:, 0] == a).sum() for a in (0, 1)], float)
    w = np.zeros(d + 1 + 4 + 2)
    v, past, t = w.copy(), w.copy(), 1.0
    squares = np.bincount(row, minlength=len(rows)).max() + 4
    rate = 1.0 / (0.25 * squares + ridge)
    for _ in range(rounds):
        s = np.zeros((n, top, 2))
        s[..., 1][mask] = np.bincount(row, v[col], len(rows)) + v[d]
        step, first = v[d + 1 : d + 5].reshape(2, 2), v[d + 5 :]
        alpha, beta = np.zeros((n, top, 2)), np.zeros((n, top, 2))
        alpha[:, 0] = s[:, 0] + first
        for k in range(1, top):
            alpha[:, k] = np.where(mask[:, k, None], np.logaddexp.reduce(alpha[:, k - 1, :, None] + step, axis=1) + s[:, k], alpha[:, k - 1])
        for k in range(top - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None], np.logaddexp.reduce(step + (s[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None])
        joint = np.exp(alpha[:, :-1, :, None] + step + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        miss = (y - p[..., 1])[mask]
        g = np.concatenate([np.bincount(col, miss[row], d), [miss.sum()], (gold_step - joint.sum((0, 1))).ravel(), gold_first - p[:, 0].sum(0)]) / len(rows)
        new = v + rate * 4 * (g - ridge / 50 * v)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nt * (new - past)
        past, t = new, nt
    w = past
    return ChainModel({f: float(w[k]) for f, k in number.items()}, float(w[d]), w[d + 1 : d + 5].reshape(2, 2).copy(), w[d + 5 :].copy())


SYLLABLES = "an ber che da en fo gri ha in jo ka lu mo na or pe qui ra so ter un ve wi xa yo zu".split()
NOISE_NAMES = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topnav links tabs".split(),
    "header": "header masthead banner branding logo top site".split(),
    "footer": "footer bottom copyright legal colophon imprint".split(),
    "aside": "sidebar side related widget rail recommended popular trending more".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner".split(),
    "notice": "cookie consent notice gdpr popup modal overlay alert banner privacy".split(),
    "form": "form newsletter signup subscribe search login contact".split(),
    "comments": "comments comment replies reply discussion respond responses thread".split(),
    "share": "share sharing social follow buttons tools tags meta".split(),
}
MAIN_NAMES = "content main article post entry story body text page single".split()


def _phrase(rnd: random.Random, lo: int, hi: int, end: bool) -> str:
    words = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(lo, hi))]
    for i in range(len(words)):
        if end and i and rnd.random() < 0.12:
            words[i - 1] += rnd.choice([",", ".", ".", ","])
    text = " ".join(words).capitalize()
    return text + (rnd.choice(["."] * 8 + ["?", "!"]) if end else "")


def labelled_pages(count: int = 700, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Made-up pages with a label for each block: 1 for the article, 0 for everything around it."""
    rnd = random.Random(seed)
    return [_page(rnd) for _ in range(count)]


def _page(rnd: random.Random) -> tuple[str, list[int]]:
    out: list[str] = ["<!DOCTYPE html><html><head><title>", _phrase(rnd, 2, 8, False), "</title><style>p{margin:0}</style></head><body>"]
    labels: list[int] = []

    def block(tag: str, inner: str, label: int, close: bool = True) -> None:
        out.append(f"<{tag}>{inner}" + (f"</{tag.split()[0]}>" if close else ""))
        labels.append(label)

    def name(kind: str) -> str:
        word = rnd.choice(NOISE_NAMES[kind])
        shape = rnd.choice(['class="{}"', 'id="{}"', "class='{} box'", 'class="c-{}"', "class={}"])
        return shape.format(word)

    def noise(kind: str) -> None:
        tags = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = tags.get(kind, rnd.choice(["div", "section", "aside"] if kind != "comments" else ["div", "section"]))
        bare = tag == kind and rnd.random() < 0.6
        opened = tag if bare else f"{tag if rnd.random() < 0.7 else 'div'} {name(kind)}"
        close = opened.split()[0]
        out.append(f"<{opened}>")
        if kind in ("nav", "share") or (kind == "aside" and rnd.random() < 0.5):
            out.append("<ul>")
            for _ in range(rnd.randint(2, 7)):
                block("li", f'<a href="/x">{_phrase(rnd, 1, 4, False)}</a>', 0)
            out.append("</ul>")
        elif kind == "comments":
            if rnd.random() < 0.6:
                block("h3", rnd.choice(["Comments", "Replies", "Discussion"]), 0)
            for _ in range(rnd.randint(1, 4)):
                inner = rnd.choice(["div class=comment", "li", "p", "article class=comment"])
                block(inner, _phrase(rnd, 4, 50, True), 0)
        elif kind == "form":
            block("p", _phrase(rnd, 2, 10, False), 0)
            if rnd.random() < 0.5:
                out.append('<input type="text" name="q"><p><button>')
                out.append(_phrase(rnd, 1, 2, False))
                out.append("</button></p>")
                labels.append(0)
        else:
            for _ in range(rnd.randint(1, 3)):
                text = _phrase(rnd, 2, 30, rnd.random() < 0.7)
                if kind == "footer" and rnd.random() < 0.7:
                    text = "&copy; " + text + " &middot; " + _phrase(rnd, 2, 12, True)
                if kind == "notice" and rnd.random() < 0.5:
                    text += f' <a href="/ok">{_phrase(rnd, 1, 2, False)}</a>'
                if rnd.random() < 0.4:
                    out.append(text)
                    labels.append(0)
                    out.append("<hr>")
                else:
                    block("p", text, 0)
        out.append(f"</{close}>")

    def article() -> None:
        shape = rnd.random()
        if shape < 0.55:
            opened = "article" if rnd.random() < 0.6 else f'article class="{rnd.choice(MAIN_NAMES)}"'
        elif shape < 0.75:
            opened = "main"
        else:
            opened = f'{rnd.choice(["div", "section"])} {rnd.choice(["class", "id"])}="{rnd.choice(MAIN_NAMES)}"'
        out.append(f"<{opened}>")
        if rnd.random() < 0.85:
            block("h1", _phrase(rnd, 1, 14, rnd.random() < 0.4), 1)
        for k in range(rnd.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            kind = rnd.random()
            if kind < 0.72:
                text = _phrase(rnd, 1, rnd.choice([4, 12, 40, 120]), rnd.random() < 0.9)
                if rnd.random() < 0.2:
                    text = f"<b>{text}" + rnd.choice(["</b>", "", "<br>"])
                elif rnd.random() < 0.2:
                    text += f' <a href="/y">{_phrase(rnd, 1, 4, False)}</a> ' + _phrase(rnd, 2, 10, True)
                odd = rnd.random()
                if odd < 0.1:
                    text = text.replace(" ", " | ")
                elif odd < 0.15:
                    text = text.replace(" ", rnd.choice(["*** ", "### ", "&amp;&amp;&amp; ", "$$$ "]))
                elif odd < 0.2:
                    text = text.upper().replace(" ", "!! ")
                elif odd < 0.25:
                    text = f"{text} {rnd.randint(0, 10**6)} {rnd.choice(['&copy;', '&middot;', '&raquo;', ''])} {text}"
                block("p", text, 1, rnd.random() < 0.85)
            elif kind < 0.8:
                block(rnd.choice(["h2", "h3"]), _phrase(rnd, 1, 8, False), 1)
            elif kind < 0.86:
                block("blockquote", _phrase(rnd, 5, 30, True), 1)
            elif kind < 0.9:
                block("pre", _phrase(rnd, 3, 20, False), 1)
            elif kind < 0.95:
                out.append("<ul>")
                for _ in range(rnd.randint(1, 4)):
                    block("li", _phrase(rnd, 2, 15, rnd.random() < 0.5), 1)
                out.append("</ul>")
            elif k:
                noise(rnd.choice(["ad", "ad", "share", "aside", "form", "notice"]))
        if rnd.random() < 0.1:
            noise("comments")
        out.append(f"</{opened.split()[0]}>")

    before = [k for k in ("header", "nav", "ad", "notice") if rnd.random() < 0.55]
    after = [k for k in ("share", "comments", "aside", "ad", "form", "notice") if rnd.random() < 0.35]
    rnd.shuffle(before)
    for k in before:
        noise(k)
    if rnd.random() < 0.25:
        noise("aside")
    wrapped = rnd.random() < 0.3
    if wrapped:
        out.append(f'<div class="{rnd.choice(["wrapper", "container", "row", "layout"])}">')
    article()
    for k in after:
        noise(k)
    if wrapped:
        out.append("</div>")
    if rnd.random() < 0.8:
        noise("footer")
    out.append("</body></html>")
    return "".join(out), labels


def extract(pages: DataFrame, model: ChainModel, html_col: str = "html") -> DataFrame:
    """`pages` with ``text`` and ``n_chars``."""
    ship(pages.sparkSession)

    @pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = model.reader()
        for part in parts:
            yield pd.Series([read(x) for x in part], dtype=object)

    return pages.withColumn("text", text(F.col(html_col))).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(labelled_pages())).select("page_id", "url", "text", "n_chars")
