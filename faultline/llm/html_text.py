"""HTML extraction: flat text blocks, classified by a decision tree over shallow features.

A page is cut into flat blocks at block-level tags. A block's features are its
words and link density, those of the blocks before and after it, and what the
markup says: whether it stands in the page's article, whether an element around
it is named as page furniture, and whether it is a heading. A small decision
tree, trained on the labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import map_texts

# Element names by role, and words that name page furniture in class, id and role.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "canvas", "audio", "video", "select", "button")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset head".split())
NAMED = frozenset("""ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promotions banner cookie cookies
consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin menu nav navbar navigation
breadcrumb breadcrumbs masthead footer sidebar widget widgets related recommended recommendations share sharing social comment comments
disqus respond reply replies discussion pagination pager search toolbar copyright legal disclaimer skip skiplink hidden teaser outbrain taboola""".split())
TOP = frozenset("header topbar site".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END_OF = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "has_article", "furniture", "heading")

#: The labelled table: features in the order above (links as a share of words), then 1 for main text.
LABELLED = """
8 0.0 6 1.0 60 0.0 1 1 0 1 1
60 0.0 8 0.0 45 0.0 1 1 0 0 1
45 0.1 60 0.0 3 0.0 1 1 0 0 1
3 0.0 45 0.1 50 0.0 1 1 0 0 1
1 0.0 30 0.0 12 0.0 1 1 0 0 1
12 0.0 1 0.0 10 0.2 1 1 0 0 1
2 0.0 1 0.0 1 0.0 1 1 0 0 1
25 0.4 50 0.0 40 0.0 1 1 0 0 1
10 0.0 4 1.0 8 0.0 1 1 0 1 1
5 0.0 90 0.0 10 0.1 1 1 0 0 1
120 0.0 9 0.0 0 0.0 1 1 0 0 1
4 1.0 50 0.0 4 1.0 1 1 0 0 0
5 1.0 4 1.0 5 1.0 1 1 0 0 0
3 1.0 80 0.0 6 0.0 1 1 0 0 0
2 1.0 2 1.0 40 0.0 1 1 0 0 0
6 0.9 70 0.1 3 0.8 1 1 0 0 0
1 1.0 0 0.0 1 1.0 0 1 0 0 0
4 0.0 1 1.0 10 0.0 0 1 0 0 0
12 0.0 120 0.0 5 0.3 0 1 0 0 0
30 0.0 3 1.0 8 0.0 0 1 0 0 0
9 0.2 60 0.0 0 0.0 0 1 0 0 0
45 0.0 50 0.0 4 1.0 0 1 0 0 0
6 0.0 40 0.0 3 1.0 0 1 0 1 0
18 0.0 6 1.0 9 0.0 1 1 1 0 0
50 0.0 60 0.0 20 0.1 1 1 1 0 0
3 0.0 20 0.0 30 0.0 1 1 1 1 0
2 1.0 30 0.0 2 1.0 1 1 1 0 0
25 0.1 4 1.0 70 0.0 0 1 1 0 0
1 1.0 1 1.0 1 1.0 0 1 1 0 0
70 0.0 10 0.0 40 0.0 0 0 0 0 1
40 0.1 70 0.0 2 0.0 0 0 0 0 1
2 0.0 40 0.1 55 0.0 0 0 0 0 1
55 0.2 2 0.0 1 1.0 0 0 0 0 1
9 0.0 3 1.0 70 0.0 0 0 0 1 1
5 0.0 60 0.0 30 0.0 0 0 0 1 1
18 0.0 40 0.0 25 0.0 0 0 0 0 1
14 0.0 8 0.0 33 0.1 0 0 0 0 1
24 0.0 30 0.0 3 1.0 0 0 0 0 1
6 0.0 35 0.0 28 0.0 0 0 0 0 1
11 0.0 22 0.0 4 0.0 0 0 0 0 1
1 1.0 1 1.0 1 1.0 0 0 0 0 0
2 1.0 1 1.0 9 0.0 0 0 0 0 0
3 0.0 1 1.0 2 1.0 0 0 0 0 0
5 0.0 2 1.0 3 0.5 0 0 0 0 0
6 0.0 4 0.0 2 1.0 0 0 0 0 0
8 0.8 40 0.0 6 0.9 0 0 0 0 0
12 1.0 3 1.0 14 1.0 0 0 0 0 0
20 0.7 9 1.0 5 1.0 0 0 0 0 0
4 0.0 50 0.0 2 1.0 0 0 0 0 0
7 0.3 50 0.1 0 0.0 0 0 0 0 0
3 0.0 4 0.0 3 0.0 0 0 0 1 0
15 0.0 2 1.0 60 0.0 0 0 1 0 0
40 0.0 50 0.0 35 0.0 0 0 1 0 0
60 0.1 5 0.0 10 0.0 0 0 1 0 0
3 1.0 3 1.0 3 1.0 0 0 1 0 0
2 0.0 25 0.0 30 0.0 0 0 1 1 0
"""


def _split(x: np.ndarray, y: np.ndarray):
    """Best (feature, threshold) by Gini impurity, the first of equals; None if nothing helps."""
    def gini(v):
        return len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best, best_loss = None, gini(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < t
            loss = gini(y[left]) + gini(y[~left])
            if loss < best_loss - 1e-9:
                best, best_loss = (f, float(t)), loss
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree as nested (feature, threshold, below, from there on); a leaf is its label."""
    found = _split(x, y) if depth else None
    if found is None:
        return int(y.mean() >= 0.5)
    left = x[:, found[0]] < found[1]
    return (*found, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


@lru_cache(maxsize=1)
def tree():
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    return grow(rows[:, :-1], rows[:, -1])


def decide(node, row) -> int:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node


def _role(name: str, rest: str, in_article: bool) -> str:
    """What an element says about its text: article, furniture, header or nothing."""
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(rest) if rest.strip(" /") else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            words.update(w.lower() for w in NAME_PART.findall(value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "furniture"
    if name in FURNITURE or words & NAMED:
        return "furniture"
    if name == "header" or (words & TOP and "header" in words):
        return "" if in_article or words & {"article", "entry", "post", "content"} else "furniture"
    if name in ("article", "main") or "main" in words and name != "body" or {"article", "body"} <= words:
        return "article"
    return ""


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat blocks of a page: (text, words, words in links, in article, in furniture, heading)."""
    out = []
    stack: list[tuple[str, str]] = []  # open elements and their roles
    parts: list[str] = []
    linked: list[str] = []
    state = [False, False, False]  # in article, in furniture, in heading
    in_link = 0

    def close_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                k = min(n, len(html.unescape(" ".join(linked)).split())) if linked else 0
                out.append((text, n, k, *state))
            parts.clear()
            linked.clear()

    def settle():
        state[0] = any(r == "article" for _, r in stack)
        state[1] = any(r == "furniture" for _, r in stack)

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in INLINE:
                continue
            close_block()
            if name[0] == "h" and name[1:].isdigit():
                state[2] = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    settle()
                    break
            continue
        if name in END_OF:
            if name in ("select", "button", "textarea", "title"):
                close_block()
            if not m[3].endswith("/"):
                end = END_OF[name].search(page, at)
                at = end.end() if end else size
            continue
        if name == "a":
            in_link += 1
        if name == "br":
            parts.append(" ")
        if name in INLINE or name in VOID:
            if name not in INLINE and name != "br":
                close_block()
            continue
        close_block()
        in_link = 0
        if name[0] == "h" and name[1:].isdigit():
            state[2] = True
            continue
        state[2] = False
        if name == "p":
            if not m[3]:
                continue  # paragraphs end where the next block starts
        role = _role(name, m[3], state[0])
        if role == "article" and name in ("article", "main"):  # what was not closed before it does not hold it
            if not any(r == "furniture" and n not in ("div", "p", "span") for n, r in stack) and not _is_comment(stack):
                stack[:] = [(n, "" if r == "furniture" else r) for n, r in stack]
        if not m[3].endswith("/"):
            stack.append((name, role if not (role == "article" and _is_comment(stack)) else "furniture"))
            settle()
    close_block()
    return out


def _is_comment(stack: list[tuple[str, str]]) -> bool:
    """Whether an article already stands open: one inside it is a comment or a teaser, and takes nothing out of furniture."""
    return any(r == "article" for _, r in stack) and any(r == "furniture" for _, r in stack)


def main_text(page: bytes | None) -> str:
    """Main text of a page, its blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    found = blocks(bytes(page).decode())
    if not found:
        return ""
    node = tree()
    has_article = any(b[3] for b in found)
    share = [k / n for _, n, k, *_ in found]
    kept = []
    for i, (text, n, _, article, furniture, heading) in enumerate(found):
        before, after = (found[i - 1][1], share[i - 1]) if i else (0, 0.0), (found[i + 1][1], share[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if decide(node, (n, share[i], *before, *after, article, has_article, furniture, heading)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """The ``carry`` columns of every page and ``text``, its main text.

    Null, empty and textless pages have an empty text; broken markup is read as
    far as it goes; repeated rows each keep theirs; other columns are ignored;
    no rows give none.
    """
    def start():
        return lambda pages: [[main_text(p) for p in pages]]

    return map_texts(pages, html_col, carry, [T.StructField("text", T.StringType())], start)


def report(pages: DataFrame) -> DataFrame:
    """op6: main text and its length for each page."""
    return extract(pages, ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
