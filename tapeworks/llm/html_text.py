"""Main text of HTML pages from flat text blocks.

A page is cut at block-level tags into flat blocks. Each gets its number of words and link density, those of the blocks before
and after it, its kind (paragraph, heading, item, other), whether a heading came before it, and a hint of the markup around it
(-2 to 2: an element for navigation, a class for such, nothing, a class for content, an article or main element) with the share
of the page's text under hints for content. A decision tree trained on the small labelled table ``PAGES`` tells text from
boilerplate; the kept blocks are joined in page order. Scripts, styles, titles, comments and form controls have no blocks.

Hints are weak where they contradict the text: a page whose hinted content is a small part of it is judged by words, density
and neighbours, and so are long paragraphs inside a wrapper that only a class calls boilerplate.

Every page is handled in its own row, whole, in time linear in its length; nothing is shuffled.

Defined results: null or empty html gives an empty text. Truncated pages and tags that are never closed are read to the
end; an unclosed comment, script or style hides the rest, as in browsers. White space inside a block becomes one space.
Repeated pages are handled one by one. Other columns pass through; one called ``_tw_main`` makes place for the result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROW, from_row, with_row

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>?")
#: After so many tags with an unclosed quote, each of which is read to the end in vain, quotes are not looked at any more.
_LOOSE_AFTER = 16
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(^|\s)hidden(\s|$|=)")
# Elements without text of the page; without an end tag the first hide all that follows, the others only themselves.
_RAW_TO_END = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "template", "xmp"}
_RAW = _RAW_TO_END | {"select", "svg", "math", "button"}
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_VOID = {"br", "img", "input", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
_MAIN_TAGS = {"article", "main"}
_BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_MAIN_WORDS = {"article", "articlebody", "content", "post", "entry", "story", "main"}
_BAD_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar side nav navbar navigation menu breadcrumb "
    "breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond responses discussion feedback widget toolbar pagination pager copyright login "
    "search alert disclaimer legal tags toc trending popular".split()
)
#: Class names that say what a wrapper has or lacks, not what it is.
_MODIFIER = re.compile(r"(?:^|\s)(?:has|with|no|is|without)[-_]\S*|\S*[-_](?:open|closed|layout|enabled|disabled)(?=\s|$)", re.I)
_KIND = {"p": 1, "pre": 1, "blockquote": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dt": 3, "dd": 3, "td": 3, "th": 3}

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "kind", "hint", "hinted_share", "after_heading")

# Labelled blocks, a page in a line: t (text) or b (boilerplate), the hint, the kind (o other, p paragraph, h heading, l item), words / words
# in links, * how many such blocks. Every page is used COPIES times, with each block longer or shorter by one of FACTORS.
COPIES, FACTORS = 32, (0.3, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 1.9, 2.4, 3.0, 0.6)
PAGES = """
b-2l1/1*6 b-1o9 t2h8 t2p60 t2p25/3 t2p4 t2p2 b-2o9
b-2l1/1*6 b-1o12 t2h8 t2o300 b-2o11
b-2l1/1*6 b-1o12 t2h8 t2o30 b-2o11
b-2l1/1*6 b-1o5 t2h3 t2p1 b-2o5
b-2l1/1*5 t2p3 t2p1 t2p90 t2p2 b-2o14
b0l1/1*6 b0o9 t0h8 t0p60 t0p25/3 t0p4 t0p2 b0o9
b0l1/1*6 b-1o9 t0h8 t0p60 t0p25 t0p4 t0p12 b0o9
b0l1/1*6 b-1o14 t0h8 t0o300 b0o11
b0l1/1*6 b-1o14 t0h9 t0p12 b0o12
b0l1/1*6 b-1o10 t0h9 t0p5 t0p9 t0p40 t0p7 t0p14 b0o14
b0l2/2*5 t1h6 t1p45 t1p3 t1o30 t1p55/5 b-1l3/3*4 b0o6
b0l1/1*7 t0h9 t1o3 t0p70 t0p40 t0p8 t0p90 b0l4/4*5 b0o12
b0o1/1*4 t0h7 t1o4 t0o80 t0o60 t0o12 t0o95 b0o3/3*4 b0o9
b-1l1/1*6 t-1h8 t-1p80 t-1p35 t-1p6 t-1p50 b-1l2/2*6 b-1o10
b-1o2/2*4 t-1h8 t-1o90 t-1o45 t-1o30 b-1o2/2*6
b-2l1/1*4 t2h7 t2p90 t2p60 b-1h2 b-1p40 b-1p35 b-1p12 b-2o8
b0l1/1*4 t1h7 t1p90 t1p60 b-1h2 b-1p40 b-1p35 b-1p12 b-1o6/2 b0o8
b0l1/1*4 t0h7 t0p90 t0p60 t0p70 b-1h2 b-1p30 b-1p25 b-1p12 b0o8
t2h5 t2p12 b-2l1/1*4
b-2l1/1*4 t2h6 t2p40 t2l8*5 t2l6/1*3 t2p20 b-2o7
b0l1/1*4 t0h6 t0p40 t0l8*5 t0l6/1*3 t0p20 b0o7
b-2l1/1*4 t2h6 t2p50 t2p30 b2l4/4*5 b-2o5
b-2l1/1*4 t2h5 t2p40 t2p4/4 t2p35 t2p2/2 t2p60/20 t2p14/7 b-2o6
b0o2/2*5 t0h5 t0o150 t0o200 t0o18/3 t0o60 b0o8/6 b0o10/9
b0o2*6 t0h5 t0o150 t0o60 b0o3*4
b-1o30 b0l1/1*5 t2h6 t2p80 t2p20 b-1o25 b-2o8
b-1o30 b0l1/1*5 t0h6 t0p80 t0p20 t0p44 b-1o25 b0o8
b-2l1/1*4 t2h6 t2p80 t2p30 b-2p30 b-2p22 b-2h3 b-2l3/3*4
b0o9 t2h8 t2p60 t2p40 b0o20 b0p15 b0l3/3*4
b0p30 b0h2 b0l3/3*4 t2h8 t2p160 t2p140 t2p9 b0h3 b0p25 b0p40
b0p20 t1h8 t1p160 t1p140 b0h3 b0p25 b0p30
t0p16
t0o40
t0h4 t0p9
t0p30 t0p40
t2p1
t2o2
t2h3
t2h3 t2p2 t2p3
b-2o4 b-2l2/2*3
b0l1/1*5 b0o4 b0o2/2
b0o12/11*4 b0o8/8 b0o30/26
b0l2/2*6 t0h7 t0p22/2 t0p18 t0p3 t0p28/8 b0o7/4 b0l2/2*3
"""
_BLOCKS = re.compile(r"([tb])(-?\d)([ophl])(\d+)(?:/(\d+))?(?:\*(\d+))?")


def features(found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """(words, words in links, kind, hint) of a page's blocks to rows of FEATURES."""
    if not found:
        return np.empty((0, len(FEATURES)))
    x = np.array(found, float)
    words, density, kind, hint = x[:, 0], x[:, 1] / np.maximum(x[:, 0], 1), x[:, 2], x[:, 3]
    plain = words * (1 - density)
    share = plain[hint > 0].sum() / max(1.0, plain[hint > -2].sum())
    shift = lambda a: (np.r_[0, a[:-1]], np.r_[a[1:], 0])
    (words_before, words_after), (density_before, density_after) = shift(words), shift(density)
    headed = np.maximum.accumulate(kind == 2)
    return np.column_stack([words, density, words_before, density_before, words_after, density_after, kind, hint, np.full(len(x), share), headed])


def labelled(pages: str = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The table as feature rows and labels (1 for text)."""
    x, y = [], []
    for line in filter(None, pages.split("\n")):
        for copy in range(COPIES):
            found, labels = [], []
            for label, hint, kind, n, linked, times in _BLOCKS.findall(line):
                for _ in range(int(times or 1)):
                    factor = FACTORS[(copy * (3 + len(found)) + 7 * len(found)) % len(FACTORS)] if copy else 1.0
                    words = max(1, round(int(n) * factor))
                    found.append((words, round(int(linked or 0) * words / int(n)), "ophl".index(kind), int(hint)))
                    labels.append(label == "t")
            x.append(features(found))
            y += labels
    return np.concatenate(x), np.array(y, float)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 14):
    """A CART tree by Gini impurity: (feature, threshold, low, high) nodes and 0/1 leaves; ties take the first feature."""

    def grow(at: np.ndarray, left: int):
        ones, n = y[at].sum(), len(at)
        if left == 0 or ones in (0, n):
            return int(2 * ones >= n)
        best = None
        for f in range(x.shape[1]):
            order = at[np.argsort(x[at, f], kind="stable")]
            value, low = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(value[1:] != value[:-1])
            if not len(cut):
                continue
            k, a = cut + 1.0, low[cut]
            gini = a * (1 - a / k) + (ones - a) * (1 - (ones - a) / (n - k))
            c = int(gini.argmin())
            if best is None or gini[c] < best[0] - 1e-9:
                best = float(gini[c]), f, float(value[cut[c]] + value[cut[c] + 1]) / 2
        if best is None:
            return int(2 * ones >= n)
        _, f, t = best
        low = x[at, f] <= t
        return f, t, grow(at[low], left - 1), grow(at[~low], left - 1)

    return grow(np.arange(len(y)), depth)


@lru_cache(1)
def default_tree():
    return train_tree(*labelled())


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def _hint(name: str, attributes: str, outer: int) -> int:
    """The hint inside an element, given the one around it."""
    if outer == -2:
        return -2
    bad, main, words = name in _BAD_TAGS or name == "header" and outer < 2, name in _MAIN_TAGS, set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                words |= set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", _MODIFIER.sub(" ", value)).lower()))
            elif key == "role":
                bad, main = bad or value.lower() in _BAD_ROLES, main or value.lower() in ("main", "article")
            elif key == "itemprop":
                main = main or value == "articleBody"
            elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return -2
        if "hidden" in attributes and _HIDDEN.search(re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "=", attributes)):
            return -2
    if bad or main:
        return -2 if bad else 2
    if name in ("html", "body") or not words:
        return outer
    if words & _BAD_WORDS:
        return -1
    return max(outer, 1) if words & _MAIN_WORDS and outer >= 0 else outer


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, kind, hint) of every flat block that has words."""
    out, parts, stack, is_open = [], [], [], Counter()
    link, hint, failed, no_end = False, 0, 0, set()

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                n = text.count(" ") + 1
                linked = sum(len(t.split()) for t, in_link in parts if in_link)
                kind = next((k for name, _ in reversed(stack[-2:]) if (k := _KIND.get(name, 0))), 0)
                out.append((text, n, min(n, linked), kind, hint))
            parts.clear()

    def pop() -> int:
        name, before = stack.pop()
        is_open[name] -= 1
        return before

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at and (raw := page[at : lt if lt >= 0 else n]):
            parts.append((html.unescape(raw), link))
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) if failed < _LOOSE_AFTER else None
        if m is None and (m := _LOOSE_TAG.match(page, lt)) is not None:
            failed += 1
        if m is None:
            parts.append(("<", link))
            at = lt + 1
            continue
        at, ending, name = m.end(), bool(m[1]), m[2].lower()
        if not ending and name in _RAW and not m[3].endswith("/"):
            end = None if name in no_end else _END_OF[name].search(page, at)
            if end is not None:
                close_at = page.find(">", end.end())
                at = n if close_at < 0 else close_at + 1
            elif name in _RAW_TO_END:
                break
            else:
                no_end.add(name)
            continue
        if name == "a":
            link = not ending
            continue
        if name == "br":
            parts.append((" ", link))
            continue
        if name not in _BLOCK:
            continue
        flush()
        if name in _VOID:
            continue
        if ending:
            while is_open[name]:
                last = stack[-1][0]
                hint = pop()
                if last == name:
                    break
            continue
        if stack and (stack[-1][0] == "p" or name in _SAME and stack[-1][0] == name):
            hint = pop()
        if not m[3].endswith("/"):
            stack.append((name, hint))
            is_open[name] += 1
            hint = _hint(name, m[3], hint)
    flush()
    return out


def main_text(page: str, tree=None) -> str:
    tree = default_tree() if tree is None else tree
    found = blocks(page)
    rows = features([b[1:] for b in found]).tolist()
    return "\n".join(b[0] for b, row in zip(found, rows) if classify(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "", tree) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), pa.array(texts, pa.string())], schema=schema)


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages without the html column, plus ``_tw_main``."""
    rows = with_row(pages, (html_column,), _tw_html=F.col(html_column).cast("string"))
    schema = T.StructType([rows.schema[ROW], T.StructField("_tw_main", T.StringType())])
    arrow, tree = to_arrow_schema(schema), default_tree()
    out = rows.mapInArrow(lambda it: _extract(it, tree, arrow), schema)
    return from_row(out, [c for c in pages.columns if c != html_column], _tw_main="_tw_main")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_tw_main").alias("text"), F.length("_tw_main").cast("long").alias("n_chars"))
