"""Main text of web pages by a tree-structured graphical model.

Every block of a page's tree is content or not. Blocks have potentials from their tag, the words of
their class, id and role, and how much text, link text and punctuation they hold; a block and its
parent share a potential that depends on both their states. Sum-product messages go up the tree
and down again and leave each block's exact probability of being content; the runs of text whose
block has at least one half are the main text, in page order.

The potentials are fitted by gradient ascent on the exact likelihood, with the gradient from the
same messages. The labelled pages are of two kinds: pages written here from marked templates
(:func:`template_pages`), and at most ``sample`` pages of the table itself (the first by a hash
of id and address, of ``longest`` characters at most, as long as they hold ``BLOCKS`` blocks in all;
these bounds are the driver's) that name one article or main element: blocks in it are content, but
for those whose tag or names tell of a menu, a form, an advert and so on. Every other of these pages
is used a second time with its telling tags replaced by plain ones, so that the model learns from
names, text and links as well.

Null and empty pages, and pages without content, give the empty text; very long pages are read
whole; broken markup is read as far as it goes. Rows are independent, so repeated rows, null ids
and empty tables need no special care; columns other than id, address and html aren't looked at.
"""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import map_batches
from rillframe.llm.html_tree import Node, parse

SAMPLE, LONGEST, BLOCKS = 200, 100_000, 100_000
FEATURES = 1 << 14
#: Words that tell what a block is for, in class, id, role or tag.
BOILERPLATE = frozenset(
    """ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu
    breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside rail widget cookie cookies consent notice
    gdpr popup modal overlay form login signup search subscribe newsletter comment comments discussion disqus reply replies
    respond share sharing social related recommended pagination pager tags toolbar copyright legal""".split()
)
_PLAIN = {"article": "div", "main": "div", "nav": "div", "aside": "div", "footer": "div", "header": "div", "section": "div"}
_NEVER = frozenset("nav aside footer form button select option fieldset dialog menu head".split())

Model = tuple[dict[int, float], list[list[float]]]


def _feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _level(x: int) -> int:
    return min(12, x.bit_length())


def features(node: Node, tag: str | None = None) -> list[int]:
    tag = tag or node.tag
    share = 4 * node.all_linked // node.all_chars if node.all_chars else 5
    names = ["bias", f"t:{tag}", f"l:{share}", f"c:{_level(node.all_chars)}", f"o:{_level(node.chars)}", f"s:{min(5, 40 * node.stops // max(1, node.chars))}", f"d:{min(node.depth, 6)}"]
    if node.names or tag in _NEVER:
        known = any(x in BOILERPLATE for x in node.names) or tag in _NEVER
        names += [f"n:{x}" for x in node.names] + (["telling"] if known else ["named"])
    return [_feature(x) for x in names]


def marginals(nodes: list[Node], scores: list[float], coupling: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Each block's probability of content and, for each but the root, the joint probabilities
    with its parent, as [parent 0 child 0, 0 1, 1 0, 1 1]. ``scores`` are log-odds of content;
    ``coupling[p][c]`` is the log potential of a parent's and its child's states."""
    n = len(nodes)
    e = [[math.exp(x) for x in row] for row in coupling]
    up0, up1 = [1.0] * n, [0.0] * n  # own potential times the children's messages
    for i, s in enumerate(scores):
        s = max(-30.0, min(30.0, s))
        up0[i], up1[i] = 1 / (1 + math.exp(s)), 1 / (1 + math.exp(-s))
    message = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        a, b = up0[i], up1[i]
        m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
        total = m0 + m1
        message[i] = (m0 / total, m1 / total)
        p = nodes[i].parent
        x, y = up0[p] * message[i][0], up1[p] * message[i][1]
        up0[p], up1[p] = x / (x + y), y / (x + y)
    content = [0.0] * n
    joint = [[0.0] * 4 for _ in range(n)]
    content[0] = up1[0] / (up0[0] + up1[0])
    for i in range(1, n):
        p = nodes[i].parent
        out0, out1 = (1 - content[p]) / message[i][0], content[p] / message[i][1]  # the parent without this child
        four = [out0 * e[0][0] * up0[i], out0 * e[0][1] * up1[i], out1 * e[1][0] * up0[i], out1 * e[1][1] * up1[i]]
        total = sum(four) or 1.0
        joint[i] = [x / total for x in four]
        content[i] = joint[i][1] + joint[i][3]
    return content, joint


def fit(pages: list[tuple[list[Node], list[list[int]], list[int]]], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Stochastic gradient ascent on the likelihood of the labels, page by page, in an order that is
    drawn from a fixed seed."""
    weights: dict[int, float] = {}
    squares: dict[int, float] = {}
    coupling, coupled = [[1.0, -1.0], [-1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]
    order, draw = list(range(len(pages))), random.Random(11)
    for _ in range(epochs):
        draw.shuffle(order)
        for k in order:
            nodes, rows, labels = pages[k]
            content, joint = marginals(nodes, [sum(weights.get(f, 0.0) for f in r) for r in rows], coupling)
            gradient: dict[int, float] = {}
            for r, y, q in zip(rows, labels, content, strict=True):
                if abs(y - q) > 1e-3:
                    for f in r:
                        gradient[f] = gradient.get(f, 0.0) + y - q
            for f, g in gradient.items():
                g -= ridge * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(1e-6 + squares[f])
            for a, b in itertools.product((0, 1), repeat=2):
                g = sum((labels[nodes[i].parent] == a and labels[i] == b) - joint[i][2 * a + b] for i in range(1, len(nodes)))
                coupled[a][b] += g * g
                coupling[a][b] = max(-8.0, min(8.0, coupling[a][b] + rate * g / math.sqrt(coupled[a][b])))
    return weights, coupling


def weak_labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that names its one article or main element, else None."""
    for tag in ("article", "main"):
        tops = [i for i, x in enumerate(nodes) if x.tag == tag]
        if len(tops) == 1:
            break
    else:
        return None
    labels, barred = [0] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes):
        inside = i == tops[0] or (x.parent >= 0 and labels[x.parent] == 1)
        barred[i] = x.parent >= 0 and barred[x.parent] or inside and i != tops[0] and (x.tag in _NEVER or any(n in BOILERPLATE for n in x.names))
        labels[i] = int(inside and not barred[i])
    return labels


def template_pages() -> Iterable[str]:
    """Pages of many shapes with marks: content is ``data-mark="1"``, what it holds too unless
    marked 0."""
    draw = random.Random(5)
    syllables = "ka lo mi ten ra su vel dor in an es tu pa nor qui".split()

    def words(n: int) -> str:
        out = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n)]
        return " ".join(w + draw.choice(["", "", "", "", "", ",", "."]) for w in out).capitalize() + "."

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1)}</a></li>' for _ in range(n)) + "</ul>"

    def short() -> str:
        return words(draw.randint(3, 12))

    boxes: list[Callable[[], str]] = [
        lambda: f"<nav>{links(6)}</nav>",
        lambda: f'<div class="{draw.choice(["menu", "nav", "navbar", "main-menu", "breadcrumbs"])}">{links(5)}</div>',
        lambda: f"<header><h2>{short()}</h2>{links(3)}</header>",
        lambda: f'<div id="{draw.choice(["header", "masthead", "topbar"])}"><p>{short()}</p></div>',
        lambda: f'<aside class="{draw.choice(["sidebar", "rail", "widget"])}"><h3>{short()}</h3><p>{words(20)}</p>{links(4)}</aside>',
        lambda: f'<div class="{draw.choice(["sidebar", "side-bar", "widget"])}"><p>{words(25)}</p>{links(3)}</div>',
        lambda: f'<div class="{draw.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"])}">{words(draw.randint(4, 25))}</div>',
        lambda: f'<div class="{draw.choice(["cookie", "cookie-notice", "notice", "consent", "popup"])}"><p>{words(15)}</p><button>{words(1)}</button></div>',
        lambda: f"<form><p>{short()}</p><label>{words(1)}</label><input></form>",
        lambda: f'<div class="{draw.choice(["newsletter", "subscribe", "login", "search-form"])}"><p>{short()}</p></div>',
        lambda: f'<section class="{draw.choice(["comments", "comment-list", "discussion"])}"><h3>{short()}</h3>' + "".join(f'<div class="comment"><p>{words(draw.randint(5, 60))}</p></div>' for _ in range(3)) + "</section>",
        lambda: f'<div id="comments">' + "".join(f"<p>{words(draw.randint(5, 60))}</p>" for _ in range(3)) + "</div>",
        lambda: f'<div class="{draw.choice(["related", "share", "social", "recommended"])}"><p>{short()}</p>{links(4)}</div>',
        lambda: f"<footer>&copy; {short()}</footer>",
        lambda: f'<div class="{draw.choice(["footer", "copyright", "legal"])}"><p>{short()}</p></div>',
    ]
    holders = ["article", "main", 'div class="content"', 'div class="post"', 'div id="article-body"', 'section class="entry"', 'div class="text"', "div", 'div class="story"', 'div role="main"']
    for k in range(120):
        parts = [f"<h1>{short()}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.randint(2, 9)):
            kind = draw.random()
            size = draw.choice([1, 2, 5, 20, 60, 120])
            inner = words(size) + (f' <a href="#">{words(2)}</a> {words(6)}' if draw.random() < 0.2 else "")
            parts.append(f"<h2>{short()}</h2>" if kind < 0.1 else f"<ul><li>{words(8)}</li><li>{words(9)}</li></ul>" if kind < 0.16 else f"<blockquote><p>{inner}</p></blockquote>" if kind < 0.2 else f"<p>{inner}</p>")
            if draw.random() < 0.08:
                parts.append(draw.choice(boxes[6:13])().replace(">", ' data-mark="0">', 1))
        before = "".join(draw.choice(boxes[:10])() for _ in range(draw.randint(1, 3)))
        after = "".join(draw.choice(boxes[4:])() for _ in range(draw.randint(1, 4)))
        holder = holders[k % len(holders)]
        body = f'<{holder} data-mark="1">{"".join(parts)}</{holder.split()[0]}>'
        if draw.random() < 0.3:
            body = f'<div class="{draw.choice(["wrap", "page", "container", "row"])}">{body}</div>'
        yield f"<html><body>{before}{body}{after}</body></html>"


def _marked(nodes: list[Node]) -> list[int]:
    labels = [0] * len(nodes)
    for i, x in enumerate(nodes):
        labels[i] = int(x.mark) if x.mark else (labels[x.parent] if x.parent >= 0 else 0)
    return labels


def train(sample: Iterable[str | None]) -> Model:
    """The model from the template pages and those of the sampled pages that tell their labels."""
    pages = []
    for source in template_pages():
        nodes, _ = parse(source)
        pages.append((nodes, [features(x) for x in nodes], _marked(nodes)))
    left = BLOCKS
    for k, source in enumerate(sample):
        nodes, _ = parse(source or "")
        labels = weak_labels(nodes) if len(nodes) <= left else None
        if labels is not None:
            left -= len(nodes)
            pages.append((nodes, [features(x) for x in nodes], labels))
            if k % 2:
                pages.append((nodes, [features(x, _PLAIN.get(x.tag)) for x in nodes], labels))
    return fit(pages)


def extract(source: str | None, model: Model) -> str:
    """The main text of one page."""
    nodes, texts = parse(source or "")
    if not texts:
        return ""
    weights, coupling = model
    content, _ = marginals(nodes, [sum(weights.get(f, 0.0) for f in features(x)) for x in nodes], coupling)
    return " ".join(text for at, text in texts if content[at] >= 0.5)


def main_texts(df: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """One row per page: the id, the address, ``text`` and ``n_chars``."""
    rows = df.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    # The bound of what the driver learns from; the places are found without the pages themselves.
    fit_to_learn = F.length("html") <= longest
    drawn = rows.where(fit_to_learn).select(F.xxhash64("id", "url").alias("draw")).orderBy("draw").limit(sample).distinct()
    sampled = rows.where(fit_to_learn).select("html", F.xxhash64("id", "url").alias("draw")).join(F.broadcast(drawn), "draw").orderBy("draw", "html").limit(sample)
    model = train([r["html"] for r in sampled.select("html").collect()])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x, model) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = map_batches(rows, run, f"id {kind['id']}, url {kind['url']}, text string", 256)
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the main text of every row of ``pages``."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
