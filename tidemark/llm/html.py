"""Main text of web pages: a tree-structured graphical model over DOM nodes with sum-product marginals."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

#: Elements without an end tag, and those that stand inside a block. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open p. Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Tags that an opening tag of the key ends, and those beyond which it ends none. Fixed values of HTML.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
HOLDERS = ("ul", "ol", "dl", "table", "select", "body", "menu")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|math|xmp)(?=[\s/>])(?P<rawattrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")

STATES = 2


#: Elements that say nothing of what they hold. Fixed values.
PLAIN = frozenset("root html body div section".split())
#: Kinds of nodes, each with a parent-child potential of its own. Fixed values.
KINDS = ("text", "li dd dt", "ul ol dl menu", "table thead tbody tfoot tr td th caption", "p h1 h2 h3 h4 h5 h6 pre blockquote figcaption", "")
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}


class Tree:
    """Nodes of a page in page order: elements and, as leaves, text blocks."""

    def __init__(self):
        self.parent, self.names, self.text, self.linked, self.kind = [-1], [()], [None], [0], [len(KINDS) - 1]

    def add(self, parent: int, names: tuple[str, ...], kind: int, text: str | None = None, linked: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.names, names), (self.text, text), (self.linked, linked), (self.kind, kind)):
            column.append(value)
        return len(self.parent) - 1

    def compact(self) -> Tree:
        """Without elements that hold no text; an element whose only child is an element is one node with it, names united.

        So a wrapper adds no step to the tree, however many stand around a block. Elements know the share of their text
        that is linked.
        """
        n = len(self.parent)
        size, linked, children = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if self.text[i] is not None:
                size[i], linked[i] = len(self.text[i]), self.linked[i]
            if i and size[i]:
                up = self.parent[i]
                size[up] += size[i]
                linked[up] += linked[i]
                children[up] += 1
        out, place, held = Tree(), [0] * n, {}
        for i in range(n):
            if not size[i]:
                continue
            up = self.parent[i]
            names = dict.fromkeys(held.pop(up, ()))
            if up >= 0 and place[up] < 0:  # the parent is one with this node, which hangs where the parent would
                above = -1 - place[up]
            else:
                above = place[up] if up >= 0 else -1
            if self.text[i] is None:
                names |= dict.fromkeys(self.names[i])
                if i and children[i] == 1 and any(self.text[j] is None for j in self._only(i, size)):
                    held[i], place[i] = names, -1 - above
                    continue
                names[f"link={4 * linked[i] // size[i]}|{self.kind[i]}"] = None
            else:
                names |= dict.fromkeys(self.names[i])
            if i:
                place[i] = out.add(above, tuple(names), self.kind[i], self.text[i], self.linked[i])
        return out

    def _only(self, i: int, size: list[int]) -> list[int]:
        j = i + 1
        while self.parent[j] != i or not size[j]:
            j += 1
        return [j]


def parse(page: str) -> Tree:
    """Tolerant one-pass parser: unknown end tags are ignored, p, li and the like end where HTML ends them."""
    tree, open_at, open_tags = Tree(), [0], ["root"]
    places: dict[str, list[int]] = {}  # of each tag among the open ones
    piece: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(piece)).split())
        if text:
            tree.add(open_at[-1], ("t=#text",) if open_tags[-1] in PLAIN else ("t=#text", f"in={open_tags[-1]}"), 0, text, min(linked, len(text)))
        piece.clear()
        linked = 0

    def close(stop: int) -> None:
        while len(open_tags) > stop:
            places[open_tags.pop()].pop()
            open_at.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
            linked += (m.start() - at) * bool(links)
        at = m.end()
        if raw := m["raw"]:
            if raw.lower() not in INLINE and raw.lower() not in ("script", "style", "noscript", "template"):
                flush()
            continue
        if not (tag := (m["tag"] or m["tag2"] or "").lower()):
            continue
        ends = m["end"] or m["end2"]
        if tag in INLINE:
            links = (max(0, links - 1) if ends else links + 1) if tag == "a" else links
            if tag == "br":
                piece.append(" ")
            continue
        flush()
        links = 0
        if ends:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in BLOCKS and open_tags[-1] == "p":
            close(len(open_tags) - 1)
        elif tag in ENDED and (back := last(ENDED[tag])) > last(HOLDERS):
            close(back)
        words = {w for a in NAME.findall(m["attrs"] or "") for w in WORD.findall(" ".join(a).lower())}
        node = tree.add(open_at[-1], (*(() if tag in PLAIN else (f"t={tag}",)), *(f"c={w}" for w in sorted(words))), KIND.get(tag, len(KINDS) - 1))
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            places.setdefault(tag, []).append(len(open_tags))
            open_at.append(node)
            open_tags.append(tag)
    if at < len(page):
        piece.append(page[at:])
    flush()
    return tree


def named(tree: Tree, known: dict[str, int] | None) -> list[tuple[str, ...]]:
    """Names of the features of every node: its own, and for a block also those of the elements around it that known holds."""
    out, around = [], []
    for i, names in enumerate(tree.names):
        path = around[tree.parent[i]] if i else frozenset()
        if tree.text[i] is None:
            around.append(path.union(new) if (new := [x for x in names if x[1] == "=" and x not in path and (known is None or f"a={x}" in known)]) else path)
        else:
            around.append(path)
            n = len(tree.text[i])
            names = (*names, f"len={min(6, n.bit_length() // 2)}", f"link={4 * tree.linked[i] // n}", f"stop={tree.text[i][-1] in '.!?'}", *(f"a={x}" for x in path))
        out.append(names)
    return out


def forest(pages: list[str], known: dict[str, int] | None = None) -> dict:
    """Flat arrays of the trees of many pages: parent, kind, page, levels by depth, features of each node, leaf texts.

    known: number of each feature of the labelled pages; others say nothing. Without it, all features are numbered.
    """
    parent, kind, page, rows, feats, text, depth = [], [], [], [], [], [], []
    number = {} if known is None else known
    for k, source in enumerate(pages):
        t = parse(source).compact()
        base = len(parent)
        for p in t.parent:
            depth.append(depth[p + base] + 1 if p >= 0 else 0)
            parent.append(p + base if p >= 0 else -1)
        kind += t.kind
        page += [k] * len(t.parent)
        text += t.text
        for i, names in enumerate(named(t, known)):
            found = [number.setdefault(x, len(number)) for x in names] if known is None else [number[x] for x in names if x in number]
            feats += found
            rows += [base + i] * len(found)
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    return {"parent": np.array(parent, np.int64), "kind": np.array(kind, np.int64), "page": np.array(page, np.int64), "levels": levels, "rows": np.array(rows, np.int64), "feats": np.array(feats, np.int64), "text": text, "known": number}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by at."""
    flat = values.reshape(len(values), int(np.prod(values.shape[1:])))
    return np.stack([np.bincount(at, flat[:, k], n) for k in range(flat.shape[1])], 1).reshape(n, *values.shape[1:])


class TreeModel:
    """Binary field over each page's tree: node potentials from features, a parent-child potential for each kind of child, exact inference."""

    def __init__(self, weights: np.ndarray, edge: np.ndarray, known: dict[str, int]):
        self.weights, self.edge, self.known = weights, edge, known

    def marginals(self, f: dict) -> tuple[np.ndarray, np.ndarray]:
        """(P(state) of each node, P(parent state, state) of each node but the roots): messages up, then down."""
        n, levels = len(f["parent"]), f["levels"]
        unary = _summed(f["rows"], self.weights[f["feats"]], n)
        up, up_edge = unary.copy(), np.zeros((n, STATES))
        for level in levels[:0:-1]:
            up_edge[level] = _lse(self.edge[f["kind"][level]] + up[level][:, None, :], 2)
            np.add.at(up, f["parent"][level], up_edge[level])
        belief, pair = up.copy(), np.zeros((n, STATES, STATES))
        for level in levels[1:]:
            outside = belief[f["parent"][level]] - up_edge[level]
            joint = outside[:, :, None] + self.edge[f["kind"][level]] + up[level][:, None, :]
            belief[level] = _lse(joint, 1)
            pair[level] = np.exp(joint - _lse(joint.reshape(len(level), -1), 1)[:, None, None])
        return np.exp(belief - _lse(belief, 1)[:, None]), pair

    @classmethod
    def fit(cls, pages: list[tuple[str, list[bool]]], steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> TreeModel:
        """Likelihood of labelled pages (html, whether each text block is content), by Adam; an element is content if a block below is."""
        f = forest([p for p, _ in pages])
        gold = np.zeros(len(f["parent"]), np.int64)
        gold[[i for i, t in enumerate(f["text"]) if t is not None]] = [x for _, labels in pages for x in labels]
        for level in f["levels"][:0:-1]:
            np.maximum.at(gold, f["parent"][level], gold[level])
        child = np.flatnonzero(f["parent"] >= 0)
        kinds = len(KINDS)
        model, hot = cls(np.zeros((len(f["known"]), STATES)), np.zeros((kinds, STATES, STATES)), f["known"]), np.eye(STATES)[gold]
        seen = np.zeros((kinds, STATES, STATES))
        np.add.at(seen, (f["kind"][child], gold[f["parent"][child]], gold[child]), 1)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.edge)]
        for step in range(1, steps + 1):
            single, pair = model.marginals(f)
            g = _summed(f["feats"], (single - hot)[f["rows"]], len(model.weights))
            for s, p, x in zip(state, (model.weights, model.edge), (g / len(pages), (_summed(f["kind"][child], pair[child], kinds) - seen) / len(pages))):
                x = x + ridge * p
                s[0], s[1] = 0.9 * s[0] + 0.1 * x, 0.99 * s[1] + 0.01 * x * x
                p -= rate * (1 - step / (steps + 1)) * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
        return model

    def extract(self, pages: list[str]) -> list[str]:
        f = forest(pages, self.known)
        content = self.marginals(f)[0][:, 1] > 0.5
        out: list[list[str]] = [[] for _ in pages]
        for i in np.flatnonzero(content):
            if f["text"][i] is not None:
                out[f["page"][i]].append(f["text"][i])
        return ["\n\n".join(x) for x in out]


def labelled_pages(n: int = 420, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of common layouts by templates, with the label of every text block; drawn by a fixed seed."""
    rnd, out = random.Random(seed), []
    words = lambda a, b: " ".join("".join(rnd.choice("aeiounrstlmdk") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(a, b)))
    said = lambda a, b: words(a, b).capitalize() + rnd.choice([".", ".", ".", "", "?"])
    pick = lambda text: rnd.choice(text.split())
    named = lambda text: f'{rnd.choice(["class", "class", "id"])}="{pick(text)}"'

    def wrapped(inner: str, p: float, most: int = 4) -> str:
        """inner within wrappers that say nothing."""
        for _ in range(rnd.randint(1, most) if rnd.random() < p else 0):
            tag = pick("div div div section")
            name = f' {named("wrapper inner container row col block box group part section layout page outer content-wrap wrap site body unit")}' if rnd.random() < 0.4 else ""
            inner = f"<{tag}{name}>{inner}</{tag}>"
        return inner

    for _ in range(n):
        parts: list[tuple[str, bool]] = []
        mark = lambda text, good: parts.append((text, good)) or text
        no = lambda a, b: mark(said(a, b), False)
        short = lambda: mark(words(1, 3), False)
        links = lambda a, b: "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rnd.randint(a, b)))
        comment = lambda: f'<{(u := pick("div li article"))} class="{pick("comment reply response comment-body")}">{wrapped(f"<p>{no(3, 60)}</p>", 0.3, 2)}</{u}>'
        junk = {
            "nav": lambda: f"<nav>{wrapped(f'<ul>{links(1, 8)}</ul>' if rnd.random() < 0.8 else ' '.join(f'<a href=/>{mark(words(1, 2), False)}</a>' for _ in range(1)), 0.3)}</nav>",
            "menu": lambda: f'<div {named("menu navbar navigation main-menu breadcrumb breadcrumbs topnav toc pagination")}><ul>{links(3, 8)}</ul></div>',
            "list": lambda: f"<div><ul>{links(4, 9)}</ul></div>",
            "header": lambda: f'<header><{(t := pick("div h1 p h2"))} class="{pick("logo site-title brand tagline")}">{short()}</{t}></header>',
            "top": lambda: f'<div {named("header masthead site-header topbar")}><p>{mark(words(1, 4), False)}</p></div>',
            "ad": lambda: f'<div {named("ad ads advert advertisement banner promo sponsored sponsor ad-slot adsense")}>{wrapped(no(3, 30), 0.3, 2)}</div>',
            "notice": lambda: f'<{(t := pick("div section aside"))} {named("cookie notice consent cookie-banner gdpr alert newsletter subscribe popup paywall")}>{wrapped(f"<p>{no(4, 25)}</p>", 0.3, 2)}</{t}>',
            "aside": lambda: f"<aside><h3>{short()}</h3><p>{no(4, 40)}</p><ul>{links(2, 5)}</ul></aside>",
            "plain aside": lambda: f"<aside>{wrapped(f'<p>{no(4, 40)}</p>', 0.3)}</aside>",
            "sidebar": lambda: f'<div {named("sidebar side-bar rail widget widgets")}><h3>{short()}</h3><p>{no(4, 40)}</p></div>',
            "form": lambda: f"<form>{wrapped(f'<label>{mark(words(1, 4), False)}</label><input name=q><p>{no(2, 12)}</p><button>{mark(words(1, 2), False)}</button>', 0.2)}</form>",
            "share": lambda: f'<div {named("share social sharing social-links")}><a href="/s">{mark(words(1, 2), False)}</a></div>',
            "related": lambda: f'<div {named("related recommended more-stories trending popular")}><h3>{short()}</h3><ul>{links(2, 6)}</ul></div>',
            "comments": lambda: f'<{(t := pick("section div ol"))} {named("comments comment-list commentlist discussion responses replies reader-comments")}><h3>{mark(words(1, 2), False)}</h3>' + "".join(comment() for _ in range(rnd.randint(1, 4))) + f"</{t}>",
            "footer": lambda: f"<footer>{wrapped(no(3, 24), 0.2)}</footer>",
            "foot": lambda: f'<div {named("footer site-footer copyright legal")}><p>{no(3, 24)}</p></div>',
        }
        some = lambda kinds, p: "".join(junk[k]() for k in kinds if rnd.random() < p)
        yes = lambda a, b: mark(said(a, b), True)
        head = lambda: mark(words(1, 6), True)
        many = lambda make, a, b: "".join(make() for _ in range(rnd.randint(a, b)))
        good = {
            "p": lambda: f"<p>{yes(1, 90)}</p>",
            "linked": lambda: f'<p><a href="/l">{yes(2, 20)}</a></p>',
            "mixed": lambda: f'<p>{mark((x := said(3, 30)) + " " + (y := words(1, 4)), True) and x} <a href="/l">{y}</a></p>',
            "part": lambda: f"<h{(k := rnd.randint(2, 4))}>{head()}</h{k}><p>{yes(5, 60)}</p>",
            "list": lambda: f"<{(t := pick('ul ol'))}>{many(lambda: f'<li>{yes(1, 14)}</li>', 1, 5)}</{t}>",
            "links": lambda: f"<p>{yes(3, 20)}</p><ul>{many(lambda: f'<li><a href=/l>{mark(words(1, 9), True)}</a></li>', 1, 5)}</ul><p>{yes(3, 20)}</p>",
            "quote": lambda: f"<blockquote>{wrapped(f'<p>{yes(4, 30)}</p>', 0.2, 2)}</blockquote>",
            "terms": lambda: f"<dl>{many(lambda: f'<dt>{head()}</dt><dd>{yes(3, 20)}</dd>', 1, 4)}</dl>",
            "table": lambda: "<table>" + (f"<caption>{head()}</caption>" if rnd.random() < 0.3 else "") + many(lambda: f"<tr>{many(lambda: f'<td>{mark(words(1, 4), True)}</td>', 1, 4)}</tr>", 1, 4) + "</table>",
            "figure": lambda: f"<figure><img src=x><figcaption>{yes(2, 20)}</figcaption></figure>",
            "pre": lambda: f"<pre>{mark(words(3, 30), True)}</pre>",
            "bare": lambda: f"<div>{yes(5, 40)}</div>",
            "alone": lambda: f"<div><p>{yes(1, 12)}</p></div>",
            "steps": lambda: "".join(f"<div><p>{yes(1, 9)}</p>" for _ in range(4)) + "</div>" * 4,
            "section": lambda: f'<section {named("summary intro lead abstract chapter part details body-text highlights conclusion")}><h2>{head()}</h2><p>{yes(5, 40)}</p></section>',
        }
        kinds = [*["p"] * 14, "part", "part", *good]
        block = lambda: wrapped(many(good[rnd.choice(kinds)], 1, 1) if rnd.random() < 0.7 else many(good[rnd.choice(kinds)], 2, 3), 0.25, 6)
        before = some(["header", "top", "nav", "menu", "list", "notice", "ad", "sidebar"], 0.4)
        body = f"<h1>{mark(words(2, 9), True)}</h1>" if rnd.random() < 0.9 else ""
        for _ in range(rnd.randint(1, 9)):
            body += block()
            body += some(["ad", "share", "form", "notice", "menu", "plain aside"], 0.03)
        body += some(["share", "related", "comments"], 0.2)
        body = wrapped(body, 0.3, 8)
        layout = rnd.choice(["<article>{}</article>"] * 6 + ["{}", "{}", "<main>{}</main>", "<main><article>{}</article></main>", "<article><section>{}</section></article>", "<div " + named("content article post story entry main entry-content post-body article-body") + ">{}</div>", '<div id="main"><div class="post">{}</div></div>'])
        main = wrapped(layout.format(body), 0.3, 3)
        page = wrapped(f"{before}{main}{some(['comments', 'aside', 'related', 'ad', 'form', 'list'], 0.3)}{some(['footer'] if rnd.random() < 0.8 else ['foot'], 0.95)}", 0.2, 3)
        page = f"<html><head><title>x</title></head><body>{page}</body></html>"
        if rnd.random() < 0.04:  # text without markup, or with little
            parts.clear()
            page = yes(1, 60) if rnd.random() < 0.5 else f"<p>{yes(1, 60)}</p><p>{yes(1, 60)}</p>"
        order = {text: good for text, good in parts}
        out.append((page, [order[t] for t in parse(page).text if t is not None]))
    return out


def main_text(pages: DataFrame, labelled: list[tuple[str, list[bool]]] | None = None, rows: int = 128) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page: text blocks whose content marginal is over one half.

    Null and empty pages have an empty text; a page without markup is one block; broken markup never fails; a word or text
    of any length is kept whole; repeated rows stay; other columns are dropped; an empty table gives an empty result.
    Inference runs over rows pages at once.
    """
    model = TreeModel.fit(labelled or labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                found = model.extract(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return d.transform(map_arrow, run, "page_id long, url string, text string, n_chars long")
