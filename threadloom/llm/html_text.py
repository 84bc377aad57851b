"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a flat list of text blocks, cut where block elements begin or end.  Each has
its word count and link density, those of its neighbours, and whether it stands in the
article and in a container that marks itself as something else.  A decision tree, grown at
run time from the labelled table below, says which blocks are main text.

Defined results: a null or empty page has no text; what is unclosed lasts to the end of its
parent; scripts, styles, titles, comments of the markup and form controls are never text;
character references are decoded once; white space in a block becomes one space; very long pages are read
whole; repeated rows and ids, and null ids, keep their rows; a leaf of the tree that ties counts as text;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadloom.workspace import small_batches

# HTML's own element names, by how they are treated.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Never text: those that hold characters only, to their end tag whatever stands between, and those with markup inside.
RAW = "script|style|title|textarea|iframe|xmp"
UNREAD = frozenset("noscript template select button object svg math canvas audio video datalist".split())
#: Elements that leave a head open whose end tag is missing; any other, or text, begins the body.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end, without an end tag, where one of these begins.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}}
ASIDE = frozenset("aside dialog fieldset footer form header menu nav".split())
KINDS = {"p": 1, "blockquote": 1, "pre": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4}
# Words in class, id or role that name what isn't the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo "
    "cookie cookies copyright dialog disqus discussion feedback foot footer form gdpr header legal links login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond response responses search share sharing sidebar signup "
    "site-footer site-header skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
PREFIXES = ("advert", "breadcrumb", "comment", "cookie", "footer", "navig", "newsletter", "sidebar", "sponsor")

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|(?P<open><(?P<raw>{RAW})(?=[\s/>])[^>]*>).*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Words, link density, the same of the block before and after, marked container, in article, kind of element.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "marked", "article", "kind")

# The labelled table: blocks judged by hand, features as above, then 1 for main text.
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 3 0
1 1.0 1 1.0 1 1.0 1 0 3 0
1 1.0 1 1.0 8 0.0 1 0 3 0
2 1.0 2 1.0 2 1.0 0 0 3 0
3 1.0 1 1.0 2 1.0 0 0 3 0
1 1.0 0 0.0 1 1.0 0 0 3 0
4 1.0 3 1.0 60 0.0 0 0 3 0
6 0.0 1 1.0 10 0.0 1 0 0 0
8 0.0 1 1.0 9 0.0 1 0 0 0
14 0.0 1 1.0 12 0.0 1 0 0 0
40 0.0 1 1.0 11 0.0 1 0 0 0
12 0.1 80 0.0 9 0.0 1 1 0 0
25 0.0 90 0.0 70 0.0 1 1 1 0
60 0.0 90 0.0 30 0.0 1 1 1 0
120 0.0 30 0.0 80 0.0 1 1 1 0
9 0.0 40 0.0 0 0.0 1 0 0 0
11 0.0 60 0.0 0 0.0 1 0 1 0
30 0.0 70 0.0 0 0.0 1 0 1 0
55 0.0 12 0.0 20 0.0 1 0 1 0
90 0.0 12 0.0 20 0.0 1 0 1 0
150 0.0 120 0.0 10 0.0 1 0 1 0
3 0.0 100 0.0 45 0.0 1 0 2 0
2 0.0 45 0.0 5 0.5 1 0 2 0
5 0.6 2 0.0 40 0.0 1 0 0 0
20 0.9 20 0.9 15 1.0 0 0 0 0
12 0.8 50 0.0 10 1.0 0 0 1 0
7 1.0 45 0.0 6 1.0 0 0 1 0
5 0.0 3 1.0 4 1.0 0 0 2 0
2 0.0 4 1.0 3 1.0 0 0 0 0
4 0.0 3 1.0 3 1.0 0 0 0 0
6 0.5 3 1.0 2 0.0 0 0 0 0
3 0.0 2 1.0 0 0.0 0 0 0 0
6 0.0 4 1.0 0 0.0 0 0 1 0
4 1.0 60 0.0 5 1.0 0 1 3 0
5 1.0 5 1.0 5 1.0 0 1 3 0
8 1.0 90 0.0 7 1.0 0 1 3 0
9 0.0 12 0.0 70 0.0 0 1 2 1
1 0.0 8 0.0 20 0.0 0 1 2 1
4 0.0 40 0.0 35 0.0 0 1 2 1
12 0.0 1 1.0 1 0.0 0 1 2 1
1 0.0 30 0.0 25 0.0 0 1 1 1
1 0.0 1 0.0 1 0.0 0 1 1 1
1 0.0 9 0.0 8 0.0 0 1 1 1
3 0.0 12 0.0 9 0.0 0 1 1 1
10 0.0 9 0.0 60 0.0 0 1 1 1
45 0.0 10 0.0 50 0.0 0 1 1 1
80 0.1 45 0.0 6 0.0 0 1 1 1
200 0.0 80 0.1 11 0.0 0 1 1 1
30 0.3 80 0.0 60 0.0 0 1 1 1
6 1.0 70 0.0 80 0.0 0 1 1 1
5 0.0 20 0.0 9 0.0 0 1 0 1
60 0.0 2 1.0 40 0.0 0 1 0 1
15 0.0 20 0.0 18 0.0 0 1 3 1
6 0.2 30 0.0 7 0.0 0 1 3 1
2 0.0 7 0.0 7 0.0 0 1 3 1
5 0.0 6 0.0 6 0.0 0 1 4 1
1 0.0 5 0.0 5 0.0 0 1 4 1
70 0.0 6 0.0 80 0.0 0 0 1 1
45 0.0 70 0.0 60 0.0 0 0 1 1
25 0.1 60 0.0 70 0.0 0 0 1 1
12 0.0 70 0.0 55 0.0 0 0 1 1
18 0.0 20 0.0 30 0.0 0 0 1 1
3 0.0 60 0.0 50 0.0 0 0 1 1
8 0.0 3 1.0 60 0.0 0 0 2 1
5 0.0 60 0.0 55 0.0 0 0 2 1
90 0.0 5 0.0 70 0.0 0 0 0 1
40 0.0 80 0.0 45 0.0 0 0 0 1
14 0.0 60 0.0 15 0.0 0 0 3 1
40 0.0 30 0.0 4 1.0 0 1 1 1
5 0.0 40 0.0 1 1.0 0 1 3 1
1 0.0 20 0.0 1 1.0 0 1 1 1
8 0.0 1 1.0 30 0.0 0 1 2 1
2 0.0 1 1.0 1 1.0 0 1 2 1
7 0.0 1 1.0 1 1.0 0 1 1 1
55 0.0 0 0.0 0 0.0 0 1 1 1
3 0.0 0 0.0 0 0.0 0 1 0 1
90 0.0 1 1.0 1 1.0 0 0 1 1
65 0.0 1 1.0 1 1.0 0 0 0 1
70 0.0 0 0.0 0 0.0 0 0 1 1
30 0.0 6 1.0 5 1.0 0 0 1 1
2 0.4 30 0.0 40 0.0 0 1 1 1
12 0.5 30 0.0 1 1.0 0 1 3 1
4 0.0 30 0.0 1 1.0 0 1 4 1
1 1.0 60 0.0 60 0.0 0 1 1 1
3 1.0 9 0.0 1 0.0 0 1 2 1
2 0.0 60 0.0 1 1.0 0 0 0 0
3 0.0 70 0.0 0 0.0 0 0 0 0
4 0.0 0 0.0 0 0.0 0 0 0 0
6 0.0 20 0.0 9 0.0 0 0 0 0
1 0.0 80 0.0 30 0.0 0 0 0 0
3 0.0 0 0.0 70 0.0 0 0 0 0
8 0.0 9 0.0 7 0.0 0 0 0 0
50 0.7 20 0.0 30 0.0 0 0 1 0
30 1.0 60 0.0 60 0.0 0 0 0 0
3 1.0 3 1.0 3 1.0 0 1 3 0
6 1.0 4 1.0 70 0.0 0 1 3 0
60 0.0 60 0.0 60 0.0 1 1 1 0
20 0.0 0 0.0 0 0.0 1 1 1 0
20 0.0 0 0.0 0 0.0 1 0 0 0
70 0.0 0 0.0 0 0.0 1 0 1 0
9 0.0 1 1.0 60 0.0 1 1 2 0
7 0.0 50 0.0 1 1.0 1 1 3 0
30 0.0 50 0.0 1 1.0 1 0 3 0
80 0.0 80 0.0 1 1.0 1 1 0 0
5 0.0 1 1.0 40 0.0 0 1 2 1
4 0.0 1 1.0 20 0.0 0 1 2 1
6 0.0 1 1.0 60 0.0 0 1 1 1
5 0.0 2 1.0 9 0.0 0 1 1 1
4 0.0 3 1.0 5 0.0 0 1 3 1
6 0.0 4 1.0 6 0.0 0 1 4 1
5 0.0 1 1.0 1 1.0 0 1 2 1
9 0.0 10 0.0 60 0.0 0 1 0 1
2 0.0 50 0.0 40 0.0 0 1 0 1
20 0.0 0 0.0 0 0.0 0 1 0 1
4 0.0 30 0.0 60 0.0 0 0 1 1
6 0.0 70 0.0 20 0.0 0 0 1 1
6 0.0 2 0.0 1 1.0 0 1 3 1
9 0.0 4 0.0 0 0.0 0 1 3 1
16 0.0 16 0.0 5 1.0 0 1 3 1
1 0.0 1 1.0 1 1.0 0 1 3 1
25 0.0 1 1.0 9 0.0 0 1 3 1
3 0.0 3 0.0 3 0.0 0 1 4 1
12 0.0 3 0.0 1 1.0 0 1 4 1
35 0.0 3 1.0 2 0.0 0 1 4 1
2 0.0 0 0.0 0 0.0 0 1 0 1
7 0.0 1 1.0 1 1.0 0 1 0 1
18 0.0 1 1.0 90 0.0 0 1 0 1
33 0.0 60 0.0 2 1.0 0 1 0 1
4 0.5 9 0.0 9 0.0 0 1 1 1
2 0.5 0 0.0 0 0.0 0 1 0 1
22 0.6 30 0.0 30 0.0 0 1 1 1
9 0.0 5 1.0 4 1.0 0 0 3 0
4 0.0 5 1.0 4 1.0 0 0 4 0
2 0.0 1 0.0 1 0.0 0 0 4 0
5 0.0 1 0.0 1 0.0 0 0 3 0
3 0.0 1 1.0 1 1.0 0 0 1 0
7 0.0 2 1.0 4 1.0 0 0 1 0
6 0.0 2 1.0 3 1.0 0 0 2 0
"""


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8):
    """A CART tree by Gini impurity: (feature, threshold, below, above), or the share of ones at a leaf."""
    share = y.mean()
    if depth == 0 or share in (0, 1) or len(y) < 2 * least:
        return float(share)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero((v[1:] != v[:-1]) & (n[:-1] >= least) & (len(y) - n[:-1] >= least))
        if not len(cut):
            continue
        a, na = ones[cut], n[cut]
        b, nb = ones[-1] - a, len(y) - na
        cost = a * (na - a) / na + b * (nb - b) / nb
        i = int(cost.argmin())
        if best is None or cost[i] < best[0] - 1e-12:
            best = (cost[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return float(share)
    _, f, at = best
    low = x[:, f] <= at
    return f, float(at), grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return rows[:, :-1], rows[:, -1]


def judge(tree, row) -> float:
    while isinstance(tree, tuple):
        f, at, low, high = tree
        tree = low if row[f] <= at else high
    return tree


def marked(attrs: str, parts: bool = True) -> bool:
    """Whether class, id or role name something else; an article's own tags (``tag-search``) don't, so there only whole names count."""
    for found in ATTR.finditer(attrs):
        for token in (found[1] or found[2] or found[3] or "").lower().split():
            if token in MARKS or token.startswith(PREFIXES) or (parts and any(part in MARKS for part in re.split(r"[-_:]+", token))):
                return True
    return False


def tokens(page: str) -> tuple[list[tuple[int, int, str, bool, str]], dict[int, tuple[int, int]]]:
    """(start, end, name, is an end tag, attributes) of a page's markup, and for each unread element the token and place after it.

    Comments, raw text and the like have no name.  An unread element without an end tag ends
    with its parent: at the parent's end tag, or where a tag begins that ends the parent.
    """
    found: list[tuple[int, int, str, bool, str]] = []
    after: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int]] = []  # open elements; the token of an unread one, else -1
    count: dict[str, int] = {}
    outer, parent_ends, at = -1, -1, 0  # place in the stack of the outermost unread element; the token that ends its parent
    while m := TAG.search(page, at):
        i, at, name, attrs = len(found), m.end(), (m["name"] or "").lower(), m["attrs"] or ""
        foreign = count.get("svg", 0) + count.get("math", 0)
        if m["raw"] and foreign and m["open"].endswith("/>"):
            at = m.end("open")
        found.append((m.start(), at, name, bool(m["end"]), attrs))
        if not name:
            continue
        if m["end"]:
            while count.get(name):
                gone, token = stack.pop()
                count[gone] -= 1
                if token >= 0:
                    closed = gone == name
                    after[token] = (i + 1, at) if closed else (i, m.start())
                    if len(stack) == outer:
                        if parent_ends >= 0 and not closed:
                            after[token] = (parent_ends, found[parent_ends][0])
                        outer = parent_ends = -1
                if gone == name:
                    break
            continue
        if outer < 0:
            while stack and name in ENDED_BY.get(stack[-1][0], ()):
                count[stack.pop()[0]] -= 1
        elif parent_ends < 0:
            ends = outer and name in ENDED_BY.get(stack[outer - 1][0], ()) and not any(x in CONTAINERS for x, _ in stack[outer + 1 :])
            if ends or (stack[outer][0] in FOREIGN and name in BLOCKS and not count.get("foreignobject")):
                parent_ends = i
        if name in VOID or ((foreign or name in FOREIGN) and attrs.rstrip().endswith("/")):
            if name in UNREAD:
                after[i] = (i + 1, at)
            continue
        if name in UNREAD and outer < 0:
            outer = len(stack)
        stack.append((name, i if name in UNREAD else -1))
        count[name] = count.get(name, 0) + 1
    for k, (_, token) in enumerate(stack):
        if token >= 0:
            after[token] = (parent_ends, found[parent_ends][0]) if k == outer and parent_ends >= 0 else (len(found), len(page))
    return found, after


def text_blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, marked, article, kind) of a page's blocks."""
    out: list[tuple[str, int, float, int, int, int]] = []
    stack: list[tuple[str, bool]] = []
    parts: list[str] = []
    linked, links, kind, own, inside, off, head = 0, 0, 0, False, 0, 0, False
    at = 0

    def flush():
        nonlocal parts, linked, own, kind
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            out.append((text, words, min(1.0, linked / words), int(off > 0 or own), int(inside > 0), kind))
        parts, linked = [], 0

    found, after = tokens(page)
    resume = 0
    for i, (start, end, name, closes, attrs) in enumerate(found):
        if i < resume:
            continue
        if start > at and head and page[at:start].strip():
            head = False
        if start > at and not head:
            piece = page[at:start]
            parts.append(piece)
            if links:
                linked += len(piece.split())
        at = end
        if i in after:
            resume, at = after[i]
            parts.append(" ")
            continue
        if name == "head":
            head = not closes
            continue
        if head and name and not closes:
            head = name in HEAD
        if not name or name in ("br", "wbr"):
            parts.append("" if name == "wbr" else " ")
            continue
        if name == "a":
            links = 0 if closes else 1
            continue
        if name not in BLOCKS:
            continue
        flush()
        kind, own, links = 0, False, 0
        if name not in CONTAINERS:
            if not closes:
                kind, own = KINDS.get(name, 0), "=" in attrs and marked(attrs)
            continue
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for gone, was in stack[i:]:
                        off -= was
                        inside -= gone in ("article", "main")
                    del stack[i:]
                    break
        else:
            away = name in ASIDE or (name != "body" and name != "main" and "=" in attrs and marked(attrs, parts=name != "article"))
            stack.append((name, away))
            off += away
            inside += name in ("article", "main")
            kind = KINDS.get(name, 0)
    if at < len(page):  # text at the end of an unclosed head is the body's
        parts.append(page[at:])
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    blocks = text_blocks(page or "")
    around = [(0, 0.0), *((b[1], b[2]) for b in blocks), (0, 0.0)]
    kept = []
    for i, (text, words, links, mark, article, kind) in enumerate(blocks):
        if judge(tree, (words, links, *around[i], *around[i + 2], mark, article, kind)) >= 0.5:
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    tree = grow(*labelled_table())

    @F.pandas_udf("string")
    def read(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, tree) for x in htmls], dtype=object)

    made = pages.select("page_id", "url", read(F.col("html").cast("string")).alias("text"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
