"""Operator 9: main text of HTML pages from flat text blocks.

A page is cut at block-level tags into flat text blocks. Each block is described by its word count and link density,
those of its two neighbours, and whether it lies in an element that names its role (an article, or a menu, form,
advert and the like). A decision tree, trained on the small labelled table below (information gain, no pruning),
decides which blocks belong to the article. Their texts, white space collapsed, are joined in page order.

Defined results: null or empty pages and pages without article text give an empty text; unclosed comments, scripts and
elements end with the page, and a tag that no ">" follows is text but for a last one, which is cut off; any length is
read whole, in one pass; character references are decoded; repeated rows get equal results;
an empty table gives an empty table; an input column with an output's name is replaced, other columns are kept.
"""

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common

common.ship(__name__)

#: Elements whose tags do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   # formulas read as running text
                   "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover semantics mstyle mpadded mphantom".split())
#: Elements whose content is no text of the page.
HIDDEN = ("script", "style", "noscript", "template", "title", "textarea", "select", "iframe", "object", "svg", "button")
#: Elements, and words of class, id or role, that name a role other than the article.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
WHOLE = frozenset(("html", "body", "main", "article"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

NAME = re.compile("[a-zA-Z][a-zA-Z0-9:-]*")
SPECIAL = re.compile("[>\"']")
CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

FEATURES = ("words", "link", "before_words", "before_link", "after_words", "after_link", "in_article", "aside")
#: The labelled table: features in the order above (words, links' share of them, the same of the blocks before and
#: after, 1 inside article or main, 1 inside an element of another role), then 1 for article text.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (3, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0), (8, 0.0, 2, 1.0, 9, 0.0, 0, 1, 0),
    (12, 0.0, 1, 1.0, 5, 0.0, 0, 1, 0), (9, 0.0, 120, 0.0, 0, 0.0, 0, 1, 0), (14, 0.1, 60, 0.0, 0, 0.0, 0, 1, 0),
    (25, 0.1, 80, 0.0, 30, 0.0, 0, 1, 0), (40, 0.0, 70, 0.0, 35, 0.0, 1, 1, 0), (22, 0.0, 90, 0.0, 18, 0.0, 1, 1, 0),
    (3, 0.0, 50, 0.0, 2, 0.0, 1, 1, 0), (6, 0.5, 45, 0.0, 4, 1.0, 1, 1, 0), (60, 0.0, 3, 1.0, 2, 0.0, 0, 1, 0),
    (9, 0.0, 8, 0.0, 70, 0.0, 1, 0, 1), (8, 0.0, 5, 0.0, 2, 0.0, 1, 0, 1), (2, 0.0, 2, 0.0, 14, 0.0, 1, 0, 1),
    (70, 0.0, 9, 0.0, 55, 0.0, 1, 0, 1), (55, 0.1, 70, 0.0, 8, 0.0, 1, 0, 1), (5, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1),
    (1, 0.0, 30, 0.0, 12, 0.0, 1, 0, 1), (18, 0.3, 25, 0.0, 33, 0.0, 1, 0, 1), (120, 0.0, 10, 0.0, 9, 0.0, 1, 0, 1),
    (12, 0.5, 40, 0.0, 20, 0.0, 1, 0, 1), (3, 1.0, 30, 0.0, 40, 0.0, 1, 0, 1), (2, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0),
    (4, 1.0, 90, 0.0, 3, 1.0, 1, 0, 0), (5, 0.9, 3, 1.0, 60, 0.0, 1, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (4, 0.8, 3, 1.0, 6, 0.0, 0, 0, 0), (6, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0),
    (15, 0.9, 4, 1.0, 60, 0.0, 0, 0, 0), (8, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (7, 0.4, 80, 0.0, 0, 0.0, 0, 0, 0),
    (9, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0), (5, 0.2, 3, 0.0, 2, 1.0, 0, 0, 0), (6, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0),
    (45, 0.0, 8, 0.0, 60, 0.0, 0, 0, 1), (80, 0.1, 45, 0.0, 30, 0.0, 0, 0, 1), (30, 0.0, 80, 0.0, 5, 0.0, 0, 0, 1),
    (22, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1), (12, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1), (60, 0.0, 2, 1.0, 6, 0.0, 0, 0, 1),
    (18, 0.0, 22, 0.0, 4, 1.0, 0, 0, 1), (150, 0.05, 0, 0.0, 0, 0.0, 0, 0, 1), (28, 0.2, 9, 0.0, 11, 0.0, 0, 0, 1),
    (40, 0.9, 10, 1.0, 9, 1.0, 0, 0, 0), (30, 0.7, 50, 0.0, 3, 1.0, 0, 0, 0), (7, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1),
    (5, 0.0, 90, 0.0, 70, 0.0, 0, 0, 1), (3, 0.0, 60, 0.0, 80, 0.0, 0, 0, 1),
)


def train(rows=LABELLED):
    """A tree as nested tuples (feature, bound, at most, above); leaves are 0 or 1. Ties go to the first split."""
    import math

    def entropy(part):
        p = sum(r[-1] for r in part) / len(part)
        return 0.0 if p in (0, 1) else -p * math.log2(p) - (1 - p) * math.log2(1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            left, right = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            gain = entropy(rows) - (len(left) * entropy(left) + len(right) * entropy(right)) / len(rows)
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, bound, left, right)
    if best is None:
        return int(2 * sum(r[-1] for r in rows) >= len(rows))
    return best[1], best[2], train(best[3]), train(best[4])


def decide(tree, x) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def tags(page: str):
    """(start, end, name, whether it closes, attributes) of each piece of markup, the name None where it has no role here.

    One pass: every piece is found by searches that start where the last one ended. Where an attribute's quotation is left
    open, the tag ends at the next ">"; whether a quotation leads to a tag's end is worked out once for each quotation
    mark, however many tags begin before it. A tag that no ">" follows is no tag.
    """
    ends: dict[int, int] = {}  # opening quotation mark -> end of the tag around it, -1 if there is none
    last = page.rfind(">")

    def tag_end(at: int) -> int:
        m = SPECIAL.search(page, at)
        way = []
        while True:
            if m is None:
                end = -1
            elif m[0] == ">":
                end = m.end()
            elif m.start() in ends:
                end = ends[m.start()]
            else:
                way.append(m.start())
                closing = page.find(m[0], m.end())
                m = SPECIAL.search(page, closing + 1) if closing >= 0 else None
                continue
            for x in way:
                ends[x] = end
            return end if end >= 0 else page.find(">", at) + 1

    at = page.find("<")
    while at >= 0:
        following = page[at + 1 : at + 2]
        if following in ("!", "?"):
            opened, closer = ("<!--", "-->") if page.startswith("<!--", at) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", at) else (following, ">")
            end = page.find(closer, at + len(opened))
            end = len(page) if end < 0 else end + len(closer)
            yield at, end, None, False, ""
        else:
            closes = following == "/"
            m = NAME.match(page, at + 1 + closes)
            if m is None or at > last:
                at = page.find("<", at + 1)
                continue
            end = tag_end(m.end())
            name, attributes = m[0].lower(), page[m.end() : end - 1]
            if name in CLOSERS and not closes:
                if name != "svg" or not attributes.rstrip().endswith("/"):
                    found = CLOSERS[name].search(page, end)
                    end = found.end() if found else len(page)
                yield at, end, None, False, ""
            else:
                yield at, end, name, closes, attributes
        at = page.find("<", end)


def blocks(page: str) -> list[list]:
    """[text, words, words in links, in article, aside] of each text block, in page order."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, int, int]] = []  # tag, article elements around, elements of other roles around
    article = aside = link = at = 0

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            n = text.count(" ") + 1
            out.append([text, n, min(linked, n), int(article > 0), int(aside > 0)])
        parts, linked = [], 0

    def text(piece):
        nonlocal linked
        parts.append(piece)
        if link:
            linked += len(html.unescape(piece).split())

    for start, end, name, ends, attributes in tags(page):
        if start > at:
            text(page[at:start])
        at = end
        if name is None:
            continue  # a comment, declaration or hidden element
        if name in INLINE:
            if name == "a":
                link = 0 if ends else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        link = 0
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, article, aside = stack[k]
                    del stack[k:]
                    break
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or re.fullmatch("h[1-6]", name):
                continue  # often left open; they only bound blocks
            stack.append((name, article, aside))
            if name in ("article", "main"):
                article += 1
            if name in ASIDE_TAGS:
                aside += 1
            elif attributes and name not in WHOLE:
                role = " ".join(filter(None, (x for r in ROLE.finditer(attributes) for x in r.groups())))
                if role and ASIDE_WORDS.intersection(re.split("[^a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", role).lower())):
                    aside += 1
    if at < len(page):
        rest = page[at:]
        text(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^<>]*\Z", rest) else rest)  # a cut-off tag is no text
    flush()
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    size = [(b[1], b[2] / b[1]) for b in found]
    edge = (0, 0.0)
    keep = []
    for i, b in enumerate(found):
        x = (*size[i], *(size[i - 1] if i else edge), *(size[i + 1] if i + 1 < len(found) else edge), b[3], b[4])
        if decide(tree, x):
            keep.append(b[0])
    return " ".join(keep)


def extract(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of each page (empty if there is none, never null)."""
    import pyarrow as pa

    tree = train()

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py() or "", tree) for x in pages], pa.string())

    return df.withColumn(out, text.asNondeterministic()(F.col(html_col).cast("string")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; results of nulls, empty pages and repeated rows as in the module."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
