"""Main text of web pages, by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements and runs of text (inline elements belong to the run around them).  Every node is
content or not; unary potentials come from its tag, its class and id words, and the length, links and punctuation of a
run; a potential on each edge between parent and child depends on the kind of the child.  Sum-product messages, up to the
root and down again, give exact marginals; a run is kept if its probability of being content is at least one half.

The potentials are learned from labelled pages by gradient ascent on the exact conditional likelihood.  The labelled pages
are generated: articles amid menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in many
layouts with and without telling tags and class names (``labelled_page``); or they are the caller's own.

Messages are passed level by level for a batch of pages at once, in numpy.

Defined cases: a null or empty page has an empty text; so has a page without content; a very long page is read whole; text
outside of any element counts as text of the page's root; equal rows and null ids are handled row by row; an empty table
gives an empty result; other columns are ignored.  No tag needs to be closed: an element that hides its text (a template, an
option) and is never closed inside its block hides none.  Text of formulas, drawings and buttons belongs to its block.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<()([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page: scripts, styles, parts of forms, and what is shown only in place of others.
SKIPPED = frozenset("script style noscript template textarea select option iframe head title datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody
    td tfoot th thead tr ul""".split()
)
#: Starting one of the first ends an open one of the second, unless one of the third is open inside that.
IMPLIED = [
    (frozenset(BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary", "html", "body"}), frozenset({"p"}), frozenset("table td th button object".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    (frozenset({"dd", "dt"}), frozenset({"dd", "dt"}), frozenset("dl table".split())),
    (frozenset({"tr", "tbody", "thead", "tfoot"}), frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), frozenset({"td", "th"}), frozenset({"table"})),
    (frozenset({"tbody", "thead", "tfoot"}), frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})),
    (frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(BLOCK - frozenset("h1 h2 h3 h4 h5 h6".split()))),
]

#: Inline elements whose text counts as that of links.
LINKS = frozenset(("a", "button"))
END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in SKIPPED}
#: A block's end tag, and any tag of a block.
BLOCK_END = re.compile(rf"</(?:{'|'.join(sorted(BLOCK))})\s*>", re.I)
BLOCK_TAG = re.compile(rf"<(/?)({'|'.join(sorted(BLOCK))})\b", re.I)


def _outside(page: str, at: int, upto: int) -> bool:
    """Whether the block's end at ``upto`` is that of a block opened before ``at``."""
    tag = BLOCK_TAG.match(page, upto)[2].lower()
    return sum(-1 if m[1] else 1 for m in BLOCK_TAG.finditer(page, at, upto) if m[2].lower() == tag) <= 0


#: Groups of tags, and of words in class, id and role.
TAGS = [
    "body html", "article", "main", "section", "div center", "nav menu", "header hgroup", "footer", "aside", "form fieldset legend search dialog",
    "p", "h1 h2 h3", "h4 h5 h6", "ul ol dl dir", "li dt dd", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption details summary address",
]
WORDS = [
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager crumbs toc skip",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad adsense",
    "comment comments reply replies respond discussion disqus commentlist reader readers",
    "sidebar side aside related widget widgets recommended recommendations trending popular more complementary rail",
    "cookie cookies notice consent gdpr alert banner popup modal newsletter subscribe signup overlay announcement paywall",
    "header masthead logo branding top topbar site-header brand",
    "footer copyright legal bottom colophon contentinfo imprint",
    "content article post entry story text articlebody article-body post-content entry-content story-body page-content",
    "share sharing social tags meta byline author bio toolbar tools rating",
    "login search form contact register",
]
_TAG = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
_WORD = {w: i for i, ws in enumerate(WORDS) for w in ws.split()}
N_TEXT = 12
N_FEATURES = 2 + len(TAGS) + len(WORDS) + 1 + N_TEXT
#: Kinds of child that edge potentials depend on: those of TAGS, any other element, a run of text.
N_KINDS = len(TAGS) + 2
RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children."""

    parent: list[int]
    depth: list[int]
    kind: list[int]
    features: list[list[tuple[int, float]]]
    runs: list[tuple[int, str]]  # (node, text)
    marks: list[str | None]  # the label attribute of labelled pages, by node


def _element_features(tag: str, attributes: str) -> tuple[list[tuple[int, float]], str | None]:
    kind = _TAG.get(tag, len(TAGS))
    out = [(0, 1.0)]
    if kind < len(TAGS):
        out.append((2 + kind, 1.0))
    mark = None
    if attributes:
        found = set()
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                for w in value.split():
                    for part in (w, *re.split(r"[-_:]|(?<=[a-z])(?=\d)", w)):
                        if part in _WORD:
                            found.add(_WORD[part])
            elif name == "style" and "display:none" in value.replace(" ", ""):
                found.add(len(WORDS))
            elif name == "data-label":
                mark = value
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
            found.add(len(WORDS))
        out += [(2 + len(TAGS) + f, 1.0) for f in found]
    return out, mark


def _text_features(text: str, linked: int, parent_tag: str) -> list[tuple[int, float]]:
    n = len(text)
    words = text.count(" ") + 1
    stops = text.count(".") + text.count("!") + text.count("?") + text.count("。")
    at = 2 + len(TAGS) + len(WORDS) + 1
    density = min(1.0, linked / n)
    out = [(1, 1.0), (at, min(1.0, np.log1p(n) / 7)), (at + 1, density), (at + 2, min(1.0, 5 * stops / words))]
    flags = (n < 25, n >= 100, n >= 300, density > 0.6, words <= 3, text[-1] in ".!?…。\"'”»)", parent_tag in ("h1", "h2", "h3"), bool(n < 300 and RIGHTS.search(text)), parent_tag == "p")
    return out + [(at + 3 + k, 1.0) for k, f in enumerate(flags) if f]


def parse(page: str) -> Tree:
    tree = Tree([-1], [0], [0], [[(0, 1.0)]], [], [None])
    open_: list[tuple[str, int]] = [("html", 0)]  # (tag, node); inline elements have their block's node
    pieces: list[str] = []
    linked = at = 0
    links = 0  # open links and buttons

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                tag, node = next(((t, n) for t, n in reversed(open_) if t in BLOCK), open_[0])
                add(node, len(TAGS) + 1, _text_features(text, linked, tag), None)
                tree.runs.append((len(tree.parent) - 1, text))
        linked = 0

    def add(parent: int, kind: int, features, mark) -> None:
        tree.parent.append(parent)
        tree.depth.append(tree.depth[parent] + 1)
        tree.kind.append(kind)
        tree.features.append(features)
        tree.marks.append(mark)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    def close(to: int) -> None:
        nonlocal links
        if any(t in BLOCK for t, _ in open_[to:]):
            flush()
        links -= sum(t in LINKS for t, _ in open_[to:])
        del open_[to:]

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag in ("html", "body", "br") or tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and open_[k][0] in BLOCK:
                    break  # an inline element doesn't end across a block
            continue
        if tag in SKIPPED:
            pieces.append(" ")
            if not (m[0].endswith("/>") and tag not in RAW):
                end = END[tag].search(page, at)
                # what is not raw text, and so can hold elements, doesn't reach beyond the block that it is in
                if end and tag not in RAW and tag != "head" and (wall := BLOCK_END.search(page, at, end.start())):
                    end = None if _outside(page, at, wall.start()) else end
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK:
            if tag in ("html", "body"):
                flush()
                more, mark = _element_features(tag, attributes)
                if tag == "body":
                    tree.features[0] = more
                continue
            for starts, ended, walls in IMPLIED:
                if tag in starts:
                    for k in range(len(open_) - 1, 0, -1):
                        if open_[k][0] in ended:
                            close(k)
                            break
                        if open_[k][0] in walls:
                            break
            flush()
            features, mark = _element_features(tag, attributes)
            add(open_[-1][1], _TAG.get(tag, len(TAGS)), features, mark)
            open_.append((tag, len(tree.parent) - 1))
        elif not m[0].endswith("/>"):
            links += tag in LINKS
            open_.append((tag, open_[-1][1]))
    flush()
    return tree


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    unary: np.ndarray  # N_FEATURES: what speaks for content
    edges: np.ndarray  # N_KINDS x 2 x 2: by kind of child, label of parent, label of child


class Forest:
    """Trees laid out in arrays."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        base = np.repeat(self.offsets[:-1], sizes)
        parent = np.array([p for t in trees for p in t.parent], dtype=np.int64)
        self.parent = np.where(parent < 0, -1, parent + base)
        self.kind = np.array([k for t in trees for k in t.kind], dtype=np.int64)
        depth = np.array([d for t in trees for d in t.depth], dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = np.split(order, cuts[:-1])
        n = [len(f) for t in trees for f in t.features]
        self.node = np.repeat(np.arange(len(n)), n)
        self.feature = np.array([i for t in trees for f in t.features for i, _ in f], dtype=np.int64)
        self.value = np.array([v for t in trees for f in t.features for _, v in f])

    def unary(self, model: Model) -> np.ndarray:
        score = np.zeros((len(self.parent), 2))
        score[:, 1] = np.bincount(self.node, weights=self.value * model.unary[self.feature], minlength=len(self.parent))
        return score


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product on all trees: P(content) of each node, the joint of each node and its parent, sum of log partitions."""
    local = forest.unary(model)
    psi = model.edges[forest.kind]
    up = np.zeros_like(local)  # messages to parents
    for level in reversed(forest.levels[1:]):
        up[level] = np.logaddexp.reduce(psi[level] + local[level][:, None, :], axis=2)
        np.add.at(local, forest.parent[level], up[level])
    # local now holds each node's own potential with its children's messages
    total = local.copy()
    joint = np.zeros((len(local), 2, 2))
    for level in forest.levels[1:]:
        cavity = total[forest.parent[level]] - up[level]
        both = psi[level] + cavity[:, :, None] + local[level][:, None, :]
        joint[level] = both
        total[level] = np.logaddexp.reduce(both, axis=1)
    z = np.logaddexp.reduce(total, axis=1)
    joint = np.exp(joint - z[:, None, None])
    roots = forest.levels[0]
    joint[roots] = 0
    return np.exp(total[:, 1] - z), joint, float(z[roots].sum())


def train(trees: list[Tree], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.1, l2: float = 0.002) -> Model:
    """Potentials that maximise the likelihood of the labels, by Adam; gradients are observed less expected counts."""
    forest, y = Forest(trees), np.concatenate(labels).astype(np.int64)
    model = Model(np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2)))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros_like(model.edges)
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1.0)
    observed = np.bincount(forest.feature, weights=forest.value * y[forest.node], minlength=N_FEATURES)
    params, state = [model.unary, model.edges], [[np.zeros_like(p), np.zeros_like(p)] for p in (model.unary, model.edges)]
    for t in range(1, rounds + 1):
        p, joint, _ = marginals(forest, model)
        expected = np.bincount(forest.feature, weights=forest.value * p[forest.node], minlength=N_FEATURES)
        pairs = np.zeros_like(model.edges)
        np.add.at(pairs, forest.kind, joint)
        for w, g, (a, b) in zip(params, ((observed - expected) / len(trees) - l2 * model.unary, (seen - pairs) / len(trees) - l2 * model.edges), state):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return model


# --- labelled pages ---------------------------------------------------------------------------------------------------

SYLLABLES = "an be co der el fin ga hu in jo ka lor men no os pra qui ra sto tu un vel wa xi yo ze th er ion que sch ó é ü".split()


def labelled_page(rng: random.Random) -> str:
    """A page in which the attribute data-label="1" marks elements that are content and "0" others; children inherit it."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    sentence = lambda: phrase(1, 14) + rng.choice([".", ".", ".", "!", "?", ",", " |", "&amp;&amp;", "***"])
    sentences = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda text: f'<a href="/{word()}">{text}</a>'
    named = rng.random() < 0.8  # whether class names tell anything

    def attrs(*names: str) -> str:
        if not names or not named and rng.random() < 0.8:
            return rng.choice(["", f' class="{word()}"', f' class="col-{rng.randint(1, 12)}"', f' id="{word()}"'])
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}{rng.choice(["", "", " " + word(), "-" + word()])}"'

    def menu() -> str:
        items = [link(phrase(1, 3)) for _ in range(rng.randint(3, 12))]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" ", " | ", ""]).join(items)

    def paragraph(inline: bool = True) -> str:
        text = sentences(1, 8)
        if rng.random() < 0.25:
            text = sentences(1, 1)
        if inline and rng.random() < 0.3:
            text += rng.choice([f" {link(phrase(1, 3))} {sentence()}", f" <b>{phrase(1, 4)}</b> {sentence()}", f"<br>{sentence()}", f" <em>{word()}</em>."])
        return text

    def article() -> str:
        out = []
        if rng.random() < 0.9:
            out.append(f"<h{(h := rng.choice([1, 1, 1, 2]))}>{phrase(1, 10)}{rng.choice(['', '.'])}</h{h}>")
        if rng.random() < 0.3:
            out.append(f"<p><b>{phrase(2, 9)}.<br>")  # never closed
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                out.append(f"<p>{paragraph()}" + ("</p>" if rng.random() < 0.85 else ""))
            elif kind < 0.82:
                out.append(f"<h2>{phrase(1, 6)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{sentences(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<div>{sentences(1, 4)}</div>")
            elif kind < 0.97:
                out.append("<table><tr>" + "".join(f"<td>{phrase(1, 3)}</td>" for _ in range(4)) + "</tr></table>")
            else:
                out.append(f'<div data-label="0"{attrs("ad", "advert", "promo", "related", "share")}>{rng.choice([sentences(1, 2), menu()])}</div>')
        body = "".join(out)
        how = rng.random()
        if how < 0.6:
            return f'<article data-label="1"{attrs() if rng.random() < 0.5 else ""}>{body}</article>'
        if how < 0.75:
            return f'<main data-label="1">{body}</main>'
        return f'<div data-label="1"{attrs("content", "article", "post", "entry-content", "story", "main-content", "text")}>{body}</div>'

    def comment() -> str:
        return f'<div{attrs("comment", "reply")}><h4>{phrase(1, 2)}</h4><p>{sentences(1, 4)}</p>{link("reply")}</div>'

    def block(kind: str) -> str:
        some = lambda: rng.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p>", sentence()])
        if kind == "nav":
            t = rng.choice(["nav", "nav", "div", "ul"])
            return f'<{t} data-label="0"{attrs("nav", "menu", "navbar", "breadcrumb")}>{menu()}</{t}>'
        if kind == "header":
            t = rng.choice(["header", "header", "div"])
            return f'<{t} data-label="0"{attrs("header", "masthead", "topbar")}>{rng.choice(["", f"<h1>{phrase(1, 3)}</h1>", f"<p>{sentence()}</p>"])}{menu() if rng.random() < 0.5 else phrase(1, 4)}</{t}>'
        if kind == "footer":
            t = rng.choice(["footer", "footer", "div"])
            return f'<{t} data-label="0"{attrs("footer", "copyright", "legal")}>{rng.choice(["&copy; " + word() + ".com", "", "Copyright " + word()])} {rng.choice([some(), menu(), "&middot; " + sentences(1, 3)])}</{t}>'
        if kind == "aside":
            t = rng.choice(["aside", "aside", "div", "section"])
            return f'<{t} data-label="0"{attrs("sidebar", "related", "widget", "popular")}><h3>{phrase(1, 3)}</h3>{rng.choice([menu(), some(), some()])}</{t}>'
        if kind == "ad":
            return f'<div data-label="0"{attrs("ad", "ads", "advert", "sponsored", "promo", "ad")}>{rng.choice([some(), link(phrase(2, 6)), some()])}</div>'
        if kind == "notice":
            return f'<div data-label="0"{attrs("cookie", "notice", "consent", "banner", "newsletter", "popup")}>{some()}<button>OK</button></div>'
        if kind == "form":
            return f'<form data-label="0"{attrs("search", "login", "subscribe")}><label>{phrase(1, 3)}</label><input name="q">{rng.choice(["", f"<p>{sentence()}</p>"])}<button>{word()}</button></form>'
        t = rng.choice(["section", "div", "section", "ol"])
        return f'<{t} data-label="0"{attrs("comments", "discussion", "commentlist", "disqus")}><h3>{phrase(1, 3)}</h3>' + "".join(comment() for _ in range(rng.randint(1, 5))) + f"</{t}>"

    before = [block(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
    after = [block(k) for k in ("ad", "comments", "aside", "form", "nav", "footer", "notice") if rng.random() < 0.45]
    if rng.random() < 0.3:
        rng.shuffle(before)
    inner = "".join(before) + f"<!-- {word()} -->" + article() + "".join(after)
    if rng.random() < 0.3:
        inner = f'<div{attrs("wrapper", "page", "container")}>{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{inner}" + rng.choice(["</body></html>", "</body></html>", ""])


def labels_of(tree: Tree) -> np.ndarray:
    """1 for each node whose nearest marked element, itself included, is content."""
    out = np.zeros(len(tree.parent), dtype=np.int64)
    for i, (p, mark) in enumerate(zip(tree.parent, tree.marks)):
        out[i] = int(mark) if mark is not None else out[p] if p >= 0 else 0
    return out


@functools.lru_cache(maxsize=4)
def default_model(pages: int = 600, seed: int = 2) -> Model:
    """A model learned from generated labelled pages."""
    rng = random.Random(seed)
    trees = [parse(labelled_page(rng)) for _ in range(pages)]
    return train(trees, [labels_of(t) for t in trees])


# --- the operator -----------------------------------------------------------------------------------------------------


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page: its blocks, trimmed and with single spaces, joined by an empty line."""
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _, _ = marginals(forest, model)
    return ["\n\n".join(text for node, text in t.runs if p[at + node] >= 0.5) for t, at in zip(trees, forest.offsets)]


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", id: str = "page_id") -> DataFrame:
    """(page_id, text) of every row."""
    kind = pages.schema[id].dataType.simpleString()
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(main_texts(some.column(2).to_pylist(), sent.value), pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(id).alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string")


def op2_extract(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long pages, repeated rows and an empty table: as the module states."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
