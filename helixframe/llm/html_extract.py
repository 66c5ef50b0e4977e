"""Main text of web pages: gradient-boosted trees over features of tree nodes, decoded from the root down.

Each block element and each text block is a node.  The trees give the odds that a node holds main text, from its subtree's density of text
and of links, words in its attributes and its ancestors', depth, place and share among its siblings.  Decoding takes the likeliest labels
in which a node holds main text only if its parent does, and an element only if one of its children does.

The model is fitted on generated pages (html_samples), where it is known what the article is; it takes a few seconds on the driver and no
page of the input.  Every page is read whole.

Cases: null and empty html has an empty text; so has a page without an article.  Broken markup never fails.  Repeated rows are extracted
each by itself; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.boosting import Boosted
from helixframe.llm.common import columns_of, prepare
from helixframe.llm.html_tree import Node, parse

# Words in attributes, by what they tell.
ATTRIBUTE_WORDS = {
    "main": "article content post entry main story body text page blog news".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager topbar toolbar links skip".split(),
    "header": "header head masthead logo branding hero".split(),
    "footer": "footer foot copyright legal colophon bottom".split(),
    "side": "sidebar side aside related widget recommended recommend popular trending rail secondary more".split(),
    "notice": "cookie cookies consent banner notice alert modal popup gdpr subscribe newsletter signup overlay warning privacy".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp banner".split(),
    "comment": "comment comments reply replies disqus discussion respond thread reader responses feedback".split(),
    "form": "form search login contact input field submit".split(),
    "share": "share social sharing follow facebook twitter tools".split(),
    "meta": "byline author date meta tags tag category categories published caption credit".split(),
}
_GROUP = {}
for _i, _ws in enumerate(ATTRIBUTE_WORDS.values()):
    for _w in _ws:
        _GROUP.setdefault(_w, []).append(_i)
_GROUPS = len(ATTRIBUTE_WORDS)
_TAGS = [("article",), ("main",), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre"), ("figure", "figcaption"), ("body",), ("#",)]
_TAG = {t: i for i, ts in enumerate(_TAGS) for t in ts}
_CARRIED = [_TAG[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "li", "table", "figure")]


_CARRIED_AT = {t: i for i, t in enumerate(_CARRIED)}


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first, in page order, numbered; without the head."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.i = len(out)
        out.append(node)
        todo.extend([k for k in reversed(node.kids) if k.tag != "head"])
    return out


def _bits(flags: list[int], width: int) -> np.ndarray:
    return (np.array(flags, np.int64)[:, None] >> np.arange(width)) & 1


def node_features(pages: list[list[Node]]) -> np.ndarray:
    """One row for each node of all pages, in the order of nodes_of()."""
    up, total, tags, words, above = [], [], [], [], []
    chars, links, blocks, size, marks = [], [], [], [], []
    depth, index, kin, same, before, after, start = [], [], [], [], [], [], []
    for nodes in pages:
        base, n, seen = len(up), len(nodes), 0
        c, li, bl, sz, mk = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
        for x in nodes:
            i = x.i
            flag = 0
            for w in x.words:
                for g in _GROUP.get(w, ()):
                    flag |= 1 << g
            tag = _TAG.get(x.tag, -1)
            parent = x.parent
            if parent is None:
                up.append(base)
                depth.append(0)
                above.append(0)
            else:
                p = base + parent.i
                up.append(p)
                depth.append(depth[p] + 1)
                carried = _CARRIED_AT.get(tags[p])
                above.append(above[p] | words[p] | (0 if carried is None else 1 << (_GROUPS + carried)))
            tags.append(tag)
            words.append(flag)
            start.append(seen)
            if x.text:
                c[i], li[i], bl[i] = len(x.text), x.linked, 1
                mk[i] = x.text.count(".") + x.text.count(",")
                seen += c[i]
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent.i
            c[p] += c[i]
            li[p] += li[i]
            bl[p] += bl[i]
            sz[p] += sz[i]
            mk[p] += mk[i]
        place, many, alike, left, right = [0] * n, [1] * n, [0.0] * n, [0] * n, [0] * n
        for x in nodes:
            kids = x.kids
            if kids:
                k = len(kids)
                count = {}
                for y in kids:
                    count[y.tag] = count.get(y.tag, 0) + 1
                last = None
                for j, y in enumerate(kids):
                    if y.tag == "head":
                        continue
                    q = y.i
                    place[q], many[q], alike[q] = j, k, count[y.tag] / k
                    if last is not None:
                        left[q], right[last] = c[last], c[q]
                    last = q
        chars += c
        links += li
        blocks += bl
        size += sz
        marks += mk
        index += place
        kin += many
        same += alike
        before += left
        after += right
        total += [max(c[0], 1)] * n
    up = np.array(up, np.int64)
    chars, links, blocks, size, marks, depth, index, kin, same, before, after, start, total = (np.array(x, np.float64) for x in (chars, links, blocks, size, marks, depth, index, kin, same, before, after, start, total))
    tag = (np.array(tags, np.int64)[:, None] == np.arange(len(_TAGS))).astype(np.float64)
    some, log = np.maximum(chars, 1), np.log1p
    cols = [log(chars), log(size), chars / size, links / some, chars / np.maximum(blocks, 1), log(blocks), marks / some * 100, depth, index, index / kin, log(kin), same, log(before), log(after), chars / some[up], chars / total, start / total, chars[up] / total, links[up] / some[up], tag[up, _TAG["li"]]]
    return np.concatenate([np.stack(cols, 1), tag, _bits(words, _GROUPS), _bits(above, _GROUPS + len(_CARRIED))], 1)


def decode(nodes: list[Node], logit: np.ndarray) -> list[str]:
    """The text blocks that the likeliest consistent labels keep."""
    best_yes, best_no = (-np.logaddexp(0, -logit)).tolist(), (-np.logaddexp(0, logit)).tolist()
    forced = {}
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag == "#":
            continue
        yes, no, most, which = 0.0, 0.0, None, None
        for k in nodes[i].kids:
            if k.tag != "head":
                a, b = best_yes[k.i], best_no[k.i]
                yes += a if a > b else b
                no += b
                if most is None or a - b > most:
                    most, which = a - b, k.i
        best_no[i] += no
        if most is None:
            best_yes[i] = -1e300
        else:
            best_yes[i] += yes
            if most < 0:
                forced[i] = which
                best_yes[i] += most
    out, state = [], [False] * len(nodes)
    state[0] = best_yes[0] > best_no[0]
    for i, x in enumerate(nodes):
        if state[i]:
            if x.tag == "#":
                out.append(x.text)
            for k in x.kids:
                if k.tag != "head":
                    state[k.i] = best_yes[k.i] > best_no[k.i] or forced.get(i) == k.i
    return out


@lru_cache(maxsize=2)
def model(pages: int = 500, seed: int = 7) -> Boosted:
    """Trees fitted on generated pages."""
    from helixframe.llm.html_samples import MARK, sample

    xs, ys = [], []
    for i in range(pages):
        html = sample(seed * 1_000_003 + i)
        nodes, truth = nodes_of(parse(html.replace(MARK, ""))), nodes_of(parse(html))
        good = [0.0] * len(truth)
        for x in reversed(truth):
            if x.text and MARK in x.text:
                good[x.i] = 1.0
            if good[x.i] and x.parent is not None:
                good[x.parent.i] = 1.0
        xs.append(node_features([nodes]))
        ys.append(np.array(good))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract_text(html: str | None, trees: Boosted) -> str:
    if not html:
        return ""
    nodes = nodes_of(parse(html))
    return "\n\n".join(decode(nodes, trees.logit(node_features([nodes]))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns id_col, url_col, text and n_chars (code points), one row for each input row."""
    spark = prepare(pages.sparkSession)
    trees = spark.sparkContext.broadcast(model())

    def work(batches):
        for b in batches:
            texts = []
            rows = b.column("html").to_pylist()
            for a in range(0, len(rows), 100):
                trees_ = [nodes_of(parse(x)) if x else [] for x in rows[a : a + 100]]
                known = [x for x in trees_ if x]
                logit = trees.value.logit(node_features(known)) if known else np.zeros(0)
                at = 0
                for x in trees_:
                    texts.append("\n\n".join(decode(x, logit[at : at + len(x)])) if x else "")
                    at += len(x)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    rows = columns_of(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long"), "url", "html")
    return rows.mapInArrow(work, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
