"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page is read into leaf blocks, each a stretch of text between block-level tags, with
the tags and name tokens (class, id, role) of its ancestors. Every block is labelled main
or not; scores come from ancestor and text features and from the label before, and
Viterbi finds the best sequence. The weights are fitted to labelled pages by gradient
ascent on the conditional likelihood.

Labelled pages are a bounded sample of the table's pages that mark their article (the
blocks in it are main), half of them with the mark replaced by other containers, and
pages laid out from the sample's own paragraphs with menus, notices, adverts, forms, sidebars
and reader comments around and inside the article.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 200  # pages of the table that the model is fitted to
LAID_OUT_PAGES = 400  # pages laid out from their paragraphs
LONGEST_SAMPLED = 200_000  # characters; longer pages are left out of the fit, never of the extraction
WEIGHTS = 8192  # hashed features

# fixed values: tags of the markup language by how they bear on blocks
HIDDEN = frozenset("script style noscript template svg iframe head title select option textarea".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# a formula, and what a player or drawing shows in its place, belong to the sentence around them
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img input ins kbd label mark math object q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var video wbr "
    "annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable "
    "mtd mtext mtr munder munderover semantics".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)(?=[\s/>])")
# what follows a tag's name: a value is quoted from `=` to the same quote, or runs to the next blank; any other quote is data
_REST_OF_TAG = re.compile(r"""((?:=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+)|[^>=]++)*+)>""")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD = re.compile("[a-z]+")


def markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or none, closing, attributes) of every piece that is not text, in one forward pass.

    Comments, declarations and raw elements with their content have no tag. Where the quotes of a tag leave it
    without an end, it and all later tags end at the next `>`; a `<` that begins no tag is text.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        if start > last:  # nothing ends a tag any more
            at = start + 1
            continue
        name = _NAME.match(page, start + 1)
        if name is None:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):
                at = page.find(">", at) + 1
                yield start, at, None, False, ""
            continue
        rest = _REST_OF_TAG.match(page, name.end()) if quoted else None
        if rest is None:
            quoted = False
            at = page.find(">", name.end()) + 1
            attributes = page[name.end() : at - 1]
        else:
            at, attributes = rest.end(), rest[1]
        tag = name[2].lower()
        if tag in RAW and not name[1] and not (tag == "svg" and attributes.endswith("/")):
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            yield start, at, None, False, ""
        else:
            empty = tag == "svg" and attributes.endswith("/")
            yield start, at, None if empty else tag, bool(name[1]), attributes


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, name tokens) of the ancestors, outermost first
    linked: int = 0  # characters inside links


def leaf_blocks(page: str) -> list[Block]:
    """The page's visible stretches of text in order, decoded, white space as one space."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links, linked, hidden, at = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            parts.append(piece)
            if links:
                linked += len(piece)

    def leave(tag: str) -> None:
        nonlocal hidden
        while stack:
            top = stack.pop()[0]
            hidden -= top in HIDDEN
            if top == tag:
                return

    for start, end, tag, closing, attributes in markup(page):
        take(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "img", "input") and parts:
                parts.append(" ")
            continue
        close()
        if closing:
            if any(t == tag for t, _ in stack):
                leave(tag)
        elif tag not in VOID:
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                stack.pop()
            elif tag == "li" and any(t == "li" for t, _ in stack[-1:]):
                stack.pop()
            names = " ".join(_WORD.findall(" ".join(_NAMES.findall(attributes)).lower())) if "=" in attributes else ""
            stack.append((tag, names))
            hidden += tag in HIDDEN
        links = 0
    take(page[at:])
    close()
    return out


def _code(name: str) -> int:
    return zlib.crc32(name.encode()) % WEIGHTS


def _path_features(path: tuple[tuple[str, str], ...]) -> list[int]:
    names = {f"in {tag}" for tag, _ in path} | {f"name {w}" for _, tokens in path for w in tokens.split()}
    tags = [tag for tag, _ in path]
    names.add("parent " + (tags[-1] if tags else "none"))
    names.add("parents " + " ".join(tags[-2:]))
    return [_code(n) for n in sorted(names)]


def _text_features(block: Block, before: Block | None) -> list[int]:
    text = block.text
    n, words = len(text), text.count(" ") + 1
    links = min(4, int(4 * block.linked / n + 0.5))
    names = (
        "always",
        f"size {min(7, n.bit_length() // 2 * 2)}",
        f"words {min(5, words.bit_length() // 2)}",
        f"linked {links}",
        f"end {text[-1] if text[-1] in '.!?:' else 'other'}",
        "mark" if "©" in text or "®" in text else "no mark",
        f"stops {min(3, text.count('. ') + text.count(', '))}",
        "first" if before is None else "same path" if before.path == block.path else "other path",
    )
    return [_code(n) for n in names]


def features(blocks: list[Block], known: dict | None = None) -> list[list[int]]:
    known = {} if known is None else known
    out = []
    for k, block in enumerate(blocks):
        own = known.get(block.path)
        if own is None:
            if len(known) > 20_000:
                known.clear()
            own = known[block.path] = _path_features(block.path)
        out.append(own + _text_features(block, blocks[k - 1] if k else None))
    return out


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS))  # of the label main
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # label before, label

    def labels(self, rows: list[list[int]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        own = [float(self.weights[r].sum()) for r in rows]
        (aa, ab), (ba, bb) = self.steps.tolist()
        no, yes = 0.0, own[0]
        back = []
        for score in own[1:]:
            from_no, from_yes = no + aa >= yes + ba, no + ab >= yes + bb
            back.append((0 if from_no else 1, 0 if from_yes else 1))
            no, yes = (no + aa if from_no else yes + ba), (no + ab if from_yes else yes + bb) + score
        label = int(yes > no)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Weights that make the labels likely: full-batch gradient (Adam) with forward and backward sums."""
    pages = [p for p in pages if p[0]]
    model = Model()
    if not pages:
        return model
    size, long = len(pages), max(len(y) for _, y in pages)
    wide = max(len(f) for x, _ in pages for f in x)
    index, known = np.zeros((size, long, wide), np.int64), np.zeros((size, long, wide), bool)
    label, there = np.zeros((size, long), np.int64), np.zeros((size, long), bool)
    for p, (x, y) in enumerate(pages):
        for t, f in enumerate(x):
            index[p, t, : len(f)], known[p, t, : len(f)] = f, True
        label[p, : len(y)], there[p, : len(y)] = y, True
    theta = np.zeros(WEIGHTS + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = there.sum()
    for step in range(1, rounds + 1):
        w, t = theta[:WEIGHTS], theta[WEIGHTS:].reshape(2, 2)
        own = np.zeros((size, long, 2))
        own[..., 1] = (w[index] * known).sum(axis=2)
        forward, backward = np.zeros((size, long, 2)), np.zeros((size, long, 2))
        forward[:, 0] = own[:, 0]
        for k in range(1, long):
            into = np.logaddexp(forward[:, k - 1, :1] + t[0], forward[:, k - 1, 1:] + t[1]) + own[:, k]
            forward[:, k] = np.where(there[:, k, None], into, forward[:, k - 1])
        for k in range(long - 2, -1, -1):
            ahead = own[:, k + 1] + backward[:, k + 1]
            out = np.stack([np.logaddexp(t[a, 0] + ahead[:, 0], t[a, 1] + ahead[:, 1]) for a in (0, 1)], axis=1)
            backward[:, k] = np.where(there[:, k + 1, None], out, 0)
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        node = np.exp(forward + backward - norm[:, None, None])
        gap = np.where(there, label - node[..., 1], 0)
        gradient = np.zeros_like(theta)
        gradient[:WEIGHTS] = np.bincount(index[known], weights=np.broadcast_to(gap[..., None], known.shape)[known], minlength=WEIGHTS)
        both = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                chance = np.exp(forward[:, :-1, a] + t[a, b] + own[:, 1:, b] + backward[:, 1:, b] - norm[:, None])
                seen = (label[:, :-1] == a) & (label[:, 1:] == b)
                gradient[WEIGHTS + 2 * a + b] = np.where(both, seen - chance, 0).sum()
        gradient = gradient / total - penalty * theta / 100
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.steps = theta[:WEIGHTS], theta[WEIGHTS:].reshape(2, 2)
    return model


# layouts: (opening tag, closing tag) of places where the article stands, and of the rest by kind
_ARTICLE = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class='content'>", "</div>"),
    ("<div id='main-content'>", "</div>"), ("<div class='post-body'>", "</div>"), ("<div class='entry-content'>", "</div>"),
    ("<section class='story'>", "</section>"), ("<div class='article-body'>", "</div>"), ("<table><tr><td class='text'>", "</td></tr></table>"), ("<div>", "</div>"),
]
_REST = {
    "menu": ["nav", "div class=menu", "ul class=navbar", "div id=navigation", "div class=breadcrumbs", "div class=pagination", "nav class=topnav", "ul class=tabs", "div role=navigation"],
    "header": ["header", "div class=header", "div id=masthead", "div class=topbar", "header class=site-header", "div class=logo", "div role=banner"],
    "footer": ["footer", "div class=footer", "div id=site-footer", "div class=copyright", "footer class=legal", "div class=colophon", "div role=contentinfo"],
    "sidebar": ["aside", "div class=sidebar", "div id=right-column", "div class=widget", "aside class=related", "div class=recommended", "section class=most-popular", "div class=trending", "div class=author-bio", "div role=complementary"],
    "notice": ["div class=cookie-notice", "div class=notice", "div id=consent", "div class=alert", "div class=banner", "section class=newsletter", "div class=paywall", "div class=subscribe", "p class=notice", "div class=popup", "div role=alert", "div class=disclaimer", "div class=gdpr-modal"],
    "advert": ["div class=ad", "div class=advert", "div class=advertisement", "aside class=sponsored", "div id=ads-top", "div class=promo", "section class=sponsor", "ins class=adsbygoogle", "div class=ad-slot"],
    "form": ["form", "form class=search", "form id=login", "div class=contact-form", "form class=signup", "fieldset", "div class=search-box"],
    "comments": ["section class=comments", "div id=comments", "div class=comment", "ol class=comment-list", "section id=discussion", "div class=replies", "div class=reader-comments", "ul class=responses", "div id=disqus-thread", "article class=comment", "div class=user-comments"],
    "share": ["div class=share", "ul class=social", "div class=tags", "div class=toolbar", "div class=post-meta"],
}
_MARK = "\ue000"  # private use: marks main text while a page is laid out


def _laid_out(rng: random.Random, texts: list[str]) -> str:
    """One page: an article of the given texts with other kinds of blocks around and inside it."""

    def some(least: int, most: int) -> str:
        words = rng.choice(texts).split()
        k, n = rng.randrange(max(1, len(words))), rng.randint(least, most)
        return entities.escape(" ".join((words * 2)[k : k + n]))

    def rest(kind: str) -> str:
        opened = rng.choice(_REST[kind])
        tag = opened.split()[0]
        link = lambda: f"<a href='/{rng.randrange(99)}'>{some(1, 3)}</a>"
        wrap = rng.choice(["p", "div", "span", "li"])
        prose = lambda n: "".join(f"<{wrap}>{some(3, 40)}</{wrap}>" for _ in range(rng.randint(1, n)))
        if kind in ("menu", "share"):
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>" if rng.random() < 0.7 else " ".join(link() for _ in range(4))
        elif kind == "header":
            inner = f"<h1>{some(1, 4)}</h1><p>{some(3, 10)}</p>" if rng.random() < 0.6 else link() + some(1, 5)
        elif kind == "footer":
            inner = f"&copy; {some(1, 5)} &middot; {some(3, 20)}" if rng.random() < 0.6 else prose(2) + link()
        elif kind == "sidebar":
            inner = f"<h3>{some(1, 4)}</h3>" + (prose(3) if rng.random() < 0.5 else "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>")
        elif kind == "form":
            inner = f"<label>{some(1, 3)}</label><input name=q>" + (f"<p>{some(2, 15)}</p>" if rng.random() < 0.5 else "") + f"<button>{some(1, 2)}</button>"
        elif kind == "comments":
            inner = (f"<h3>{some(1, 3)}</h3>" if rng.random() < 0.5 else "") + "".join(f"<{wrap}>{some(2, 60)}</{wrap}>" for _ in range(rng.randint(1, 5)))
        else:
            inner = some(2, 30) if rng.random() < 0.6 else prose(2)
        quoted = re.sub(r"=(\S+)", r'="\1"', opened)
        return f"<{quoted}>{inner}</{tag}>"

    def main(tag: str, text: str) -> str:
        return f"<{tag}>{_MARK}{text}</{tag}>"

    body = [main("h1", some(2, 10))] if rng.random() < 0.8 else []
    for _ in range(rng.choice([1, 2, 3, 5, 8, 15])):
        r = rng.random()
        if r < 0.75:
            body.append(main("p", some(1, 120)))
        elif r < 0.83:
            body.append(main(rng.choice(["h2", "h3"]), some(1, 6)))
        elif r < 0.9:
            body.append("<ul>" + "".join(main("li", some(1, 15)) for _ in range(3)) + "</ul>")
        else:
            body.append(main(rng.choice(["blockquote", "pre", "figcaption", "div"]), some(3, 30)))
    kinds = [k for k in _REST if k not in ("menu", "footer", "header")]
    for _ in range(rng.choice([0, 0, 1, 2])):
        body.insert(rng.randrange(1, len(body) + 1) if body else 0, rest(rng.choice(kinds)))
    if rng.random() < 0.3:
        body.append(rest("comments"))
    opened, closed = rng.choice(_ARTICLE)
    head = [rest(k) for k in ("header", "menu", "notice", "advert") if rng.random() < 0.55]
    tail = [rest(k) for k in ("share", "comments", "sidebar", "form", "advert", "notice", "footer") if rng.random() < 0.45]
    rng.shuffle(head)
    return "<html><body>" + "".join(head) + opened + "".join(body) + closed + "".join(tail) + "</body></html>"


def labelled_pages(sample: list[str], laid_out: int = LAID_OUT_PAGES, seed: int = 5) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the training pages, see the head of this module."""
    rng = random.Random(seed)
    out, texts = [], []
    for page in sample:
        blocks = leaf_blocks(page)
        inside = [int(any(tag == "article" for tag, _ in b.path)) for b in blocks]
        texts += [b.text for b in blocks if len(b.text) > 20]
        if not any(inside):
            continue
        out.append((features(blocks), inside))
        opened, closed = rng.choice(_ARTICLE)
        other = leaf_blocks(re.sub("</article>", closed, re.sub(r"<article\b[^>]*>", opened, page)))
        if len(other) == len(inside):
            out.append((features(other), inside))
    texts = texts or ["Plain words for pages without any text of their own."]
    for _ in range(laid_out):
        blocks = leaf_blocks(_laid_out(rng, texts))
        labels = [int(_MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_MARK, "").strip() or "-"
        out.append((features(blocks), labels))
    return out


def fit(pages: DataFrame, html_column: str = "html", sample: int = SAMPLE_PAGES, longest: int = LONGEST_SAMPLED) -> Model:
    """Model from at most `sample` different pages of fewer than `longest` characters, those with the smallest hashes of their html.

    The hashes are chosen first and equal pages combine before the shuffle, so neither the
    number of tasks nor a page that is repeated for a third of the table brings more rows to the driver.
    """
    rows = pages.select(F.col(html_column).cast("string").alias("html")).where(F.col("html").isNotNull() & (F.length("html") < longest))
    rows = rows.withColumn("hash", F.xxhash64("html"))
    hashes = [r.hash for r in rows.select("hash").distinct().orderBy("hash").limit(sample).collect()]
    if not hashes:
        return train(labelled_pages([]))
    chosen = rows.where(F.col("hash") <= hashes[-1]).groupBy("hash").agg(F.min("html").alias("html"))
    return train(labelled_pages([r.html for r in chosen.orderBy("hash").collect()]))


def main_text(page: str | None, model: Model, known: dict | None = None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, label in zip(blocks, model.labels(features(blocks, known)), strict=True) if label)


def extract(pages: DataFrame, model: Model | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have the empty text, as have pages without visible text. Only the three named
    columns are read; repeated rows give repeated rows. Without a model one is fitted first.
    """
    model = model or fit(pages, html_column)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # its size is set by WEIGHTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            texts = [main_text(page, shared.value, known) for page in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html")
    )
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
