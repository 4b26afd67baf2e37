"""Operator 5 — main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of blocks (text between block-level tags).  A block's features
are its word count and link density, those of the blocks before and after it, and whether
the tags it lies in mark an article or page furniture.  A decision tree (Spark ML), trained
on the small labelled table below, says which blocks are main text.  Pages are
independent: one Arrow pass, no shuffle; the tree has at most 2**DEPTH leaves.

Cases: null or empty html and pages without main text give the empty string; broken or
unclosed markup is read as far as it goes (a quote that never closes ends at the next
``>``); an unclosed button, select, text area, frame or picture ends with its parent, and an
inline element that is hidden or hinted as furniture gives no text; ties in the tree go to "not text"; repeated rows each give a row; an empty table
gives no rows; only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.llm.shared import texts_of
from suasion.llm.trees import root, share

DEPTH = 7
FEATURES = ("has_article", "in_article", "in_furniture", "words", "links", "words_before", "links_before",
            "words_after", "links_after")
# Labelled blocks: the features in the order above, then 1 for main text.
LABELLED = [tuple(map(float, row.split())) for row in """
1 1 0 12 0 0 0 80 0 1;1 1 0 80 0 12 0 40 0 1;1 1 0 1 0 60 0 90 0 1;1 1 0 2 0 1 0 1 0 1;1 1 0 9 0 120 0 10 0 1
1 1 0 150 .02 40 0 30 0 1;1 1 0 35 .1 150 .02 60 0 1;1 1 0 6 0 35 .1 0 0 1;1 1 0 45 .3 20 0 70 .1 1;1 1 0 20 .45 45 .3 30 0 1
1 1 0 10 0 3 1 9 0 1;1 1 0 8 0 9 0 10 0 1;1 1 0 300 0 8 0 8 0 1;1 1 0 3 0 8 0 300 0 1;1 1 0 25 0 8 1 200 0 1
1 1 0 7 1 60 0 50 0 1;1 1 0 12 1 90 0 110 0 1;1 1 0 1 0 1 1 20 0 1;1 1 0 5 .2 20 0 10 0 1;1 1 0 70 0 5 .2 4 1 1
1 1 0 3 1 4 1 3 1 0;1 1 0 4 1 3 1 5 1 0;1 1 0 2 1 2 1 2 1 0;1 1 0 5 1 4 1 4 1 0;1 1 0 6 1 3 1 2 1 0
1 1 1 1 1 50 0 1 1 0;1 1 1 20 0 80 0 30 0 0;1 1 1 60 0 20 0 60 0 0;1 1 1 9 0 100 0 0 0 0;1 1 1 120 0 40 0 200 0 0
1 1 1 3 0 60 0 80 0 0;1 1 1 40 .2 30 0 90 0 0;1 1 1 15 0 12 0 14 0 0;1 1 1 2 0 2 0 2 0 0;1 1 1 250 0 250 0 250 0 0
1 0 1 1 1 0 0 1 1 0;1 0 1 1 1 1 1 1 1 0;1 0 1 9 0 1 1 12 0 0;1 0 1 11 0 50 0 0 0 0;1 0 1 30 .5 11 0 60 0 0
1 0 1 60 0 30 .5 100 0 0;1 0 1 5 0 9 0 5 0 0;1 0 1 18 .1 200 0 9 0 0;1 0 1 2 0 0 0 90 0 0;1 0 1 140 0 90 0 80 0 0
1 0 0 4 0 0 0 12 0 0;1 0 0 9 0 1 1 12 0 0;1 0 0 14 0 90 0 3 0 0;1 0 0 45 0 70 0 6 0 0;1 0 0 100 0 12 0 30 0 0
1 0 0 2 1 2 1 40 0 0;1 0 0 7 0 120 0 0 0 0;1 0 0 26 .4 8 0 8 0 0;1 0 0 1 0 1 0 1 0 0;1 0 0 70 .1 60 0 60 0 0
0 0 0 120 0 0 0 80 0 1;0 0 0 80 .05 120 0 60 0 1;0 0 0 45 .1 80 0 10 0 1;0 0 0 18 0 45 0 60 0 1;0 0 0 10 0 60 0 70 0 1
0 0 0 6 0 90 0 110 0 1;0 0 0 25 0 12 0 30 0 1;0 0 0 30 .2 25 0 40 0 1;0 0 0 60 .25 30 0 20 0 1;0 0 0 22 0 60 0 18 0 1
0 0 0 12 0 3 1 80 0 1;0 0 0 9 0 0 0 120 0 1;0 0 0 200 0 2 1 3 1 1;0 0 0 35 0 5 1 35 0 1;0 0 0 17 .1 100 0 35 0 1
0 0 0 1 1 0 0 1 1 0;0 0 0 1 1 1 1 1 1 0;0 0 0 2 1 1 1 2 1 0;0 0 0 3 1 2 1 90 0 0;0 0 0 4 .8 3 1 3 1 0
0 0 0 5 0 60 0 4 0 0;0 0 0 4 0 5 0 3 0 0;0 0 0 8 0 100 0 0 0 0;0 0 0 7 .3 8 .5 3 0 0;0 0 0 12 .6 60 0 10 .7 0
0 0 0 30 .8 10 .5 9 .8 0;0 0 0 20 1 20 1 20 1 0;0 0 0 45 .7 30 .6 20 .6 0;0 0 0 9 0 2 1 3 0 0;0 0 0 3 0 0 0 2 1 0
0 0 1 120 0 80 0 80 0 0;0 0 1 40 0 100 0 10 0 0;0 0 1 20 .2 40 0 60 0 0;0 0 1 6 0 20 0 90 0 0;0 0 1 1 1 1 1 1 1 0
0 0 1 12 0 1 1 90 0 0;0 0 1 200 0 10 0 10 0 0;0 0 1 60 .1 200 0 40 0 0;0 0 1 35 0 35 0 35 0 0;0 0 1 9 .4 9 0 120 0 0
0 1 0 12 0 0 0 80 0 1;0 1 0 2 0 60 0 90 0 1;0 1 0 90 0 2 0 12 0 1;0 1 0 9 1 60 0 90 0 1;0 1 1 60 0 90 0 30 0 0
""".replace("\n", ";").split(";") if row.strip()]
# The end of a page without an article tag: a paragraph as long as a sentence is text, a short line isn't.
LABELLED += [(0.0, 0.0, 0.0, float(words), links, float(before), 0.0, after, links_after, float(words >= 12 and links < 0.3))
             for words in (5, 12, 16, 40) for links in (0.0, 0.6) for before in (30, 80) for after, links_after in ((0.0, 0.0), (3.0, 1.0))]
# Inside an article, outside furniture, a block is text whatever its length and its neighbours'.
LABELLED += [(1.0, 1.0, 0.0, float(words), links, float(before), 0.0, float(after), 0.0, 1.0)
             for words in (3, 15, 60) for links in (0.0, 0.15, 0.5) for before in (2, 40) for after in (2, 40)]

# Names of HTML elements by their use.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr picture q s "
                   "samp small source span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style")  # code: to the next end tag, or to the end of the page
RAW_TEXT = ("title", "noscript", "textarea", "iframe")  # to the end tag, if it has one of its own
SKIPPED = frozenset(RAW_TEXT + ("template", "svg", "select", "button", "object", "canvas"))  # no text; end with their parent at the latest
EMPTY = frozenset(("svg", "iframe", "object", "canvas"))  # nothing in them when the start tag ends in "/>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE = frozenset(("article", "main"))
_HINT = re.compile(r"(?:^|[\s_-])(?<!has-)(?<!has_)(?<!no-)(?<!no_)(?<!with-)(?<!with_)(?<!without-)(?:nav|navbar|navigation|menu|masthead|topbar|header|footer|foot|sidebar|side|aside|rail|widgets?|"
                   r"ads?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookies?|consent|"
                   r"gdpr|notices?|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
                   r"breadcrumbs?|pagination|pager|comments?|commentlist|respond|replies|reply|disqus|popup|modal|overlay|"
                   r"toolbar|search|hidden)(?=$|[\s_-]|\d)", re.I)
_REPLY = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|card|promo|ads?|advert|sponsored)(?=$|[\s_-]|\d)", re.I)
_MAIN_HINT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content)(?=$|[\s_-]|\d)", re.I)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|\s|=|/)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>" + "|".join(RAW) + r""")\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|$)"""
    r"|<(?P<own>" + "|".join(RAW_TEXT) + r""")\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<!/)>(?:(?!<(?P=own)\b).)*?</(?P=own)\s*>"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|$)|<[!?/][^>]*+(?:>|$)""", re.S | re.I)
_SPACE = re.compile(r"\s+")


def _kind(name: str, attrs: str) -> int:
    """1: article, -1: page furniture, 0: neither."""
    if name in ("body", "html"):
        return 0
    if attrs and _HIDDEN.search(attrs):
        return -1
    named = " ".join(next(filter(None, m), "") for m in _NAMED.findall(attrs)) if attrs else ""
    if name in ARTICLE and not (named and _REPLY.search(named)):
        return 1  # other hints of an article are about the page around it
    if name in FURNITURE or (named and _HINT.search(named)):
        return -1
    if name == "header":
        return -2  # furniture outside an article only
    return 1 if named and _MAIN_HINT.search(named) else 0


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, linked words, in article, in furniture) of every block with text."""
    out, parts, linked = [], [], []
    forms: list[int] = []  # per block: the number of the form that alone makes it furniture, 0 for none
    words_in: Counter = Counter()  # words by form
    form = n_forms = 0
    open_tags: list[tuple[str, int, bool]] = []  # name, kind, text skipped
    named: Counter = Counter()  # open tags by name
    in_article = in_furniture = in_skipped = in_link = at = 0

    def push(name: str, kind: int, skipped: bool):
        nonlocal in_article, in_furniture, in_skipped
        open_tags.append((name, kind, skipped))
        named[name] += 1
        in_article += kind > 0
        in_furniture += kind < 0
        in_skipped += skipped

    def pop(name: str):
        """Ends the last open ``name`` and all that is open in it."""
        nonlocal in_article, in_furniture, in_skipped
        while named[name]:
            last, kind, skipped = open_tags.pop()
            named[last] -= 1
            in_article -= kind > 0
            in_furniture -= kind < 0
            in_skipped -= skipped
            if last == name:
                break

    def text_to(stop: int):
        if stop > at and not in_skipped:
            t = html.unescape(page[at:stop])
            parts.append(t)
            if in_link:
                linked.append(t)

    def close():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            words = text.count(" ") + 1
            out.append((text, words, min(words, len(" ".join(linked).split())), in_article > 0, in_furniture > 0))
            forms.append(form if in_furniture == 1 and named["form"] else 0)
            words_in[form if named["form"] else 0] += words
        parts.clear()
        linked.clear()

    for m in _TOKEN.finditer(page):
        text_to(m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ending = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in SKIPPED:
            if ending:
                pop(name)
            elif not (name in EMPTY and attrs.endswith("/")):
                push(name, 0, True)
            continue
        if name in INLINE:
            if ending and named[name]:
                pop(name)
            elif not ending and name not in VOID:
                hinted = _kind(name, attrs) == -1 if attrs else False
                if hinted or named[name]:
                    push(name, 0, hinted)
            if in_skipped:
                continue
            if name == "a":
                in_link = not ending
            elif name == "br":
                parts.append(" ")
            continue
        if in_skipped:  # a block inside an element without text; an end tag of its parent ends that element first
            if not ending:
                if name not in VOID:
                    push(name, 0, False)
                continue
            if not named[name]:
                continue
            inside = next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name)
            if any(skipped for _, _, skipped in open_tags[:inside]):
                pop(name)
                continue
        close()
        in_link = 0
        if name in VOID:
            continue
        if ending:
            pop(name)
            continue
        if named["p"]:
            pop("p")
        kind = _kind(name, attrs)
        if kind == -2:
            kind = 0 if in_article else -1
        if name == "form" and not named["form"]:
            n_forms += 1
            form = n_forms
        if kind > 0 and name in ARTICLE and in_furniture:  # an article in a menu or form: the menu wasn't closed, the form is the page's
            for k, (outer, outer_kind, skipped) in enumerate(open_tags):
                if outer in ("nav", "form") and outer_kind < 0:
                    open_tags[k] = (outer, 0, skipped)
                    in_furniture -= 1
        push(name, min(kind, 0) if name == "p" else kind, False)
    text_to(len(page))
    close()
    total = sum(words_in.values())
    # a form round most of the page's words is no furniture
    return [(*b[:4], b[4] and not (f and 2 * words_in[f] > total)) for b, f in zip(out, forms, strict=True)]


def main_text(page: str, tree) -> str:
    found = blocks(page)
    has_article = float(any(b[3] for b in found))
    size = [(float(n), k / n) for _, n, k, _, _ in found]
    kept = []
    for i, (text, _, _, article, furniture) in enumerate(found):
        before = size[i - 1] if i else (0.0, 0.0)
        after = size[i + 1] if i + 1 < len(found) else (0.0, 0.0)
        if share(tree, (has_article, float(article), float(furniture), *size[i], *before, *after)) > 0.5:
            kept.append(text)
    return "\n\n".join(kept)


def fit(spark: SparkSession, labelled: list[tuple] = LABELLED, depth: int = DEPTH):
    """The decision tree, from rows of FEATURES and a label."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense(r[:-1]), float(r[-1])) for r in labelled]
    table = spark.createDataFrame(rows, ["features", "label"])
    return root(DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInfoGain=0.0, seed=1).fit(table))


def extract(pages: DataFrame, tree, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    def run(batches):
        for b in batches:
            texts = [main_text(p, tree) if p else "" for p in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
