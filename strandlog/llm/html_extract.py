"""HTML extraction: a page is cut into flat text blocks, and a decision tree keeps the article's.

A block is the text between two block-level tags. Its features are its word count and link
density, those of the blocks before and after it, whether it stands between the page's first and last long block, and what its
open elements say: article, or furniture such as menus, adverts and forms. The tree (CART, Gini) is trained when first
needed, on a small labelled table: blocks of pages composed by rule from a seeded generator, where the words of a block tell
its label. In half of those pages elements say nothing (plain divs, class names without meaning), so there counts and link density decide.

A class, id or role counts by its whole name: all of its parts must be words of FURNITURE_WORDS (or of ARTICLE_WORDS), or neutral
ones; `has-sidebar` or `comment-open` say nothing. If all that an article's element holds would be furniture, or no element is an article's, then an
element with WRAPS of the page's text outside links is a wrapper of the article, and its hint doesn't count.

Scripts, styles, comments, forms' controls and other elements whose content isn't text are
skipped, as is what stands in for an object or a script that a browser runs. Without an end tag, script,
style, textarea and title go on to the end of the page; of the others the tag alone is
dropped. Formulas are text, but for their annotations; character references are decoded; white space within a block becomes one blank;
blocks are joined by one line break, in page order. `br` is white space.

A null or empty page, or one without an article, has the text ''. A tag cut off by the end
of the page is dropped; what is open then counts as closed. Very long pages are parsed
whole. Pages are judged alone, so repeated rows don't matter; an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import table
from .textvec import slices

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|</?[a-zA-Z].*\Z"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title".split())
SKIPPED = RAW | frozenset("noscript template svg annotation annotation-xml iframe object select button canvas audio video".split())
MENU_TAGS = frozenset("nav footer aside dialog menu".split())
FURNITURE_TAGS = MENU_TAGS | {"form"}
ARTICLE_TAGS = frozenset(("article", "main"))
# Words of class names, ids and roles.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup login comment comments disqus reply "
    "replies respond related recommended share sharing social widget toolbar pagination pager search masthead topbar disclaimer complementary "
    "contentinfo dialog alert teaser".split()
)
ARTICLE_WORDS = frozenset("article content story entry post body text main articlebody".split())
NEUTRAL_WORDS = frozenset(
    "site page left right top bottom upper lower inner outer list item items box block wrap wrapper container holder area section group row col column "
    "global primary secondary links link buttons button bar form posts stories articles news text title heading message policy by".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a page's text outside links from which an element wraps the article.
WRAPS = 0.8
#: Words of a long block, and the greatest link density it may have.
LONG, LINKED = 15, 0.3


def _named(value: str) -> int:
    """What whole names say: 2 for furniture, 3 for a header, 1 for an article, 0 else."""
    found = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words:
            continue
        if any(w in FURNITURE_WORDS for w in words) and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS or w in ARTICLE_WORDS or w == "header" for w in words):
            if "main" in words and "content" in words:
                continue
            return 2
        if "header" in words and all(w == "header" or w in NEUTRAL_WORDS or w in ARTICLE_WORDS for w in words):
            found = found or 3
        elif any(w in ARTICLE_WORDS for w in words) and all(w in ARTICLE_WORDS or w in NEUTRAL_WORDS for w in words):
            found = 1
    return found


def _hints(name: str, attrs: str) -> int:
    """1 for an element of an article, 2 for furniture, 3 for a header that may be either's, 4 for what is furniture whatever it holds, 0 else."""
    if name in MENU_TAGS:
        return 4
    found = 2 if name in FURNITURE_TAGS else 1 if name in ARTICLE_TAGS else 3 if name == "header" else 0
    if name in ("html", "body") or not attrs:
        return found
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return 4
        if key in ("class", "id", "role"):
            said = _named(value)
            if said == 2:
                found = 2
            elif found != 2 and said:
                found = (found or 3) if said == 3 else 1
    return found


def _raw_end(page: str, name: str, at: int) -> int:
    done = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return done.end() if done else len(page)


def _pairs(page: str, at: int) -> dict[int, int]:
    """Of every skipped element after at that has an end tag, the end of its start tag and that of its end tag."""
    out: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m["name"] or "").lower()
        if name not in SKIPPED:
            continue
        if m["close"]:
            if open_at.get(name):
                out[open_at[name].pop()] = at
        elif not (m["attrs"] or "").rstrip().endswith("/"):
            if name in RAW:
                at = _raw_end(page, name, at)
            else:
                open_at.setdefault(name, []).append(at)
    return out


def _flags(elements: list[tuple[int, int]], found: list[list]) -> list[tuple[int, int]]:
    """(in article, in furniture) of every element (parent, hint), parents first; found: blocks with words, words in links and element."""

    def run(hints: list[int]) -> list[tuple[int, int]]:
        out = [(0, 0)]
        for (parent, _), hint in zip(elements[1:], hints[1:], strict=True):
            inside, furniture = out[parent]
            if hint == 3:
                hint = 0 if inside else 2
            out.append((int(inside or hint == 1), int(furniture or hint in (2, 4))))
        return out

    hints = [h for _, h in elements]
    flags = run(hints)
    if any(flags[e] == (1, 0) for *_, e in found):
        return flags
    held, always = [0] * len(elements), [False] * len(elements)
    for i, (parent, hint) in enumerate(elements):
        always[i] = i > 0 and (hint == 4 or always[parent])
    for _, n, linked, e in found:
        held[e] += 0 if always[e] else n - linked
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i][0]] += held[i]
    if not any(h in (2, 3) and n and n >= WRAPS * held[0] for h, n in zip(hints, held, strict=True)):
        return flags
    return run([0 if h in (2, 3) and n >= WRAPS * held[0] else h for h, n in zip(hints, held, strict=True)])


def blocks(page: str) -> list[tuple[str, int, int, int, int, str]]:
    """(text, words, words in links, in article, in furniture, tag) of every block with a word."""
    out: list[list] = []  # text, words, words in links, element
    tags: list[str] = []
    parts: list[str] = []
    linked: list[str] = []
    elements: list[tuple[int, int]] = [(0, 0)]  # parent and hint
    open_elements: list[tuple[str, int]] = [("", 0)]  # name and place in elements
    anchors, tag = 0, ""
    pairs: dict[int, int] | None = None
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                out.append([" ".join(words), len(words), min(len(words), len(unescape(" ".join(linked)).split())), open_elements[-1][1]])
                tags.append(tag)
            parts, linked = [], []

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            parts.append(text)
            if anchors:
                linked.append(text)
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == "a":
                anchors = 0
            elif name in BLOCK:
                flush()
                for i in range(len(open_elements) - 1, 0, -1):
                    if open_elements[i][0] == name:
                        del open_elements[i:]
                        break
                anchors = 0
            continue
        attrs = m["attrs"] or ""
        if name in SKIPPED:
            if not attrs.rstrip().endswith("/"):
                if name in RAW:
                    at = _raw_end(page, name, at)
                else:
                    pairs = _pairs(page, m.start()) if pairs is None else pairs
                    at = pairs.get(at, at)
            parts.append(" ")
        elif name == "a":
            anchors = 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            tag, anchors = name, 0
            if name in ("p", "hr") or name in HEADINGS:
                if not attrs:
                    continue
            if name in ("p", "hr") or name in HEADINGS or name in ("li", "td", "th", "tr", "dd", "dt"):
                if open_elements[-1][0] == name:
                    open_elements.pop()
                if name == "hr":
                    continue
            elements.append((open_elements[-1][1], _hints(name, attrs)))
            open_elements.append((name, len(elements) - 1))
    flush()
    flags = _flags(elements, out)
    return [(text, n, linked, *flags[e], tag) for (text, n, linked, e), tag in zip(out, tags, strict=True)]


FEATURES = "words link words_before link_before words_after link_after article furniture heading item before_article after_article page_has_article after_long before_long".split()


def features(found: list[tuple[str, int, int, int, int, str]]) -> np.ndarray:
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b[1] for b in found], float)
        link = np.array([b[2] for b in found]) / words
        inside, furniture = (np.array([b[i] for b in found], float) for i in (3, 4))
        out[:, 0], out[:, 1] = words, link
        out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], link[:-1], words[1:], link[1:]
        out[:, 6], out[:, 7] = inside, furniture
        out[:, 8] = [b[5] in HEADINGS for b in found]
        out[:, 9] = [b[5] in ("li", "td", "th", "option", "dt", "dd") for b in found]
        out[:, 12] = inside.any()
        out[:, 10], out[:, 11] = np.cumsum(inside) > 0, np.cumsum(inside[::-1])[::-1] > 0
        long = (words >= LONG) & (link <= LINKED) & (furniture == 0)
        out[:, 13], out[:, 14] = np.cumsum(long) > 0, np.cumsum(long[::-1])[::-1] > 0
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4):
    """A decision tree: a label, or (feature, threshold, tree at or below it, tree above it)."""
    share = y.mean() if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if len(cut):
            a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
            impurity = a * (1 - a / cut) + b * (1 - b / (len(y) - cut))
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (impurity[i], f, (v[cut[i]] + v[cut[i] - 1]) / 2)
    _, f, t = best
    if f < 0:
        return int(share >= 0.5)
    low = x[:, f] <= t
    return (f, float(t), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree, row: np.ndarray) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def training_pages(n: int = 500, seed: int = 3, told: float = 0.5) -> list[str]:
    """Pages whose article words begin with c and whose other words begin with b. A share told of them has elements that say what they hold."""
    r = random.Random(seed)

    def words(letter: str, low: int, high: int) -> str:
        return " ".join(letter + "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def links(k: int, low: int = 1, high: int = 3) -> str:
        return "".join(f'<li><a href="/x{i}">{words("b", low, high)}</a></li>' for i in range(k))

    def paragraphs(letter: str, low: int, high: int, k: int) -> str:
        return "".join(f"<p>{words(letter, low, high)}</p>" for _ in range(k))

    def told_furniture(place: str) -> str:
        kind = r.choice(
            ("nav", "header", "ad", "cookie", "form", "aside")
            if place == "top"
            else ("footer", "comments", "related", "ad", "form", "aside", "share") if place == "end" else ("ad", "share", "newsletter")
        )
        long = words("b", 5, 45)
        return {
            "nav": f"<nav><ul>{links(r.randint(3, 8))}</ul></nav>",
            "header": f'<header class="site"><a href="/">{words("b", 1, 4)}</a><p>{words("b", 2, 8)}</p></header>',
            "ad": f'<div class="{r.choice(["ad", "ads top", "ad-banner", "sponsored"])}">{words("b", 3, 30)}</div>',
            "cookie": f'<div id="cookie-notice"><p>{long}</p><a href="#">{words("b", 1, 2)}</a></div>',
            "form": f'<form action="/s"><label>{words("b", 1, 4)}</label><input name=q><p>{words("b", 2, 25)}</p></form>',
            "aside": f'<aside class="sidebar"><h3>{words("b", 1, 3)}</h3><ul>{links(4, 3, 9)}</ul><p>{long}</p></aside>',
            "footer": f"<footer>&copy; {words('b', 2, 25)} <a href='/t'>{words('b', 1, 2)}</a></footer>",
            "comments": f'<section class="comments"><h3>{words("b", 1, 2)}</h3>' + "".join(f"<article><p>{words('b', 4, 40)}</p></article>" for _ in range(3)) + "</section>",
            "related": f'<div class="related"><ul>{links(5, 4, 10)}</ul></div>',
            "share": f'<div class="share"><a href="#">{words("b", 1, 1)}</a> <a href="#">{words("b", 1, 2)}</a></div>',
            "newsletter": f'<div class="newsletter"><p>{words("b", 5, 20)}</p></div>',
        }[kind]

    def plain_furniture(place: str) -> str:
        """Menus, teasers, link lines and short notes in elements that say nothing."""
        kind = r.choice(("menu", "bar", "teasers", "note", "line") if place != "middle" else ("teasers", "bar"))
        return {
            "menu": f"<ul>{links(r.randint(3, 9))}</ul>",
            "bar": "<div>" + " ".join(f'<a href="/m{i}">{words("b", 1, 2)}</a>' for i in range(r.randint(3, 8))) + "</div>",
            "teasers": f"<div><h3>{words('b', 1, 3)}</h3><ul>{links(r.randint(3, 6), 4, 14)}</ul></div>",
            "note": f"<div>{'&copy; ' if place == 'end' else ''}{words('b', 1, 9)}</div>",
            "line": f'<p><a href="/z">{words("b", 2, 12)}</a> {words("b", 1, 3)}</p>',
        }[kind]

    def body(furniture) -> str:
        out = [f"<h1>{words('c', 2, 12)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 8)):
            kind = r.random()
            if kind < 0.7:
                text = words("c", 1, 90) if r.random() < 0.75 else words("c", *r.choice([(0, 5), (8, 40)])) + f' <a href="/y">{words("c", 1, 6)}</a> ' + words("c", 0, 20)
                out.append(f"<p>{text}</p>")
            elif kind < 0.78:
                out.append(f"<h2>{words('c', 1, 8)}</h2>" if r.random() < 0.7 else f'<h2><a href="#h">{words("c", 1, 8)}</a></h2>')
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{words('c', 1, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{words('c', 3, 40)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{words('c', 1, 5)}</td><td>{words('c', 1, 5)}</td></tr></table>")
            else:
                out.append(furniture("middle"))
        return "".join(out)

    def empty_name() -> str:
        return r.choice(["", ' class="' + "".join(r.choice("qwxzjkv") for _ in range(4)) + '"'])

    pages = []
    for _ in range(n):
        if r.random() < told:
            furniture = lambda place: told_furniture(place) if r.random() < 0.85 else plain_furniture(place)
            name = r.choice(["article", "article", "main", "div"])
            marked = f' class="{r.choice(["content", "post-body", "entry-content", "article-text"])}"' if name == "div" else ""
            inner = f"<{name}{marked}>{body(furniture)}</{name}>"
        else:  # nothing says what is what: the article has the long text, the rest links and short notes
            furniture = plain_furniture
            inner = f"<div{empty_name()}>{'<h1>' + words('c', 2, 12) + '</h1>' if r.random() < 0.9 else ''}{paragraphs('c', 20, 90, 1)}{body(lambda _: '')}{paragraphs('c', 20, 90, 1)}</div>"
        top = "".join(furniture("top") for _ in range(r.randint(0, 3)))
        end = "".join(furniture("end") for _ in range(r.randint(0, 3)))
        pages.append(f"<html><head><title>{words('c', 2, 6)}</title></head><body>{top}{inner}{end}</body></html>")
    return pages


def labelled_table(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of the blocks of training pages."""
    x, y = [], []
    for page in pages or training_pages():
        found = blocks(page)
        x.append(features(found))
        y += [int(b[0].lstrip("©").strip().startswith("c")) for b in found]
    return np.concatenate(x), np.array(y)


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled_table())


def main_text(page: str | None, model=None) -> str:
    if not page:
        return ""
    model = tree() if model is None else model
    found = blocks(page)
    rows = features(found)
    return "\n".join(b[0] for b, row in zip(found, rows, strict=True) if classify(model, row))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep with text and n_chars of every page."""
    model = tree()
    fields = ", ".join(f"`_k{i}` {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = [main_text(x, model) for x in part.column("_html").to_pylist()]
                columns = [*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    own = pages.select(*[pages[c].alias(k) for c, k in zip(keep, names, strict=True)], pages[html].alias("_html"))
    return own.mapInArrow(run, f"{fields}, text string, n_chars long").withColumnsRenamed(dict(zip(names, keep, strict=True)))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
