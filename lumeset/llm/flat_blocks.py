"""Main text of web pages from flat text blocks.

A page is read once as a flat run of blocks: block-level tags end a block, inline tags do not. Each block
has its word count and link density, those of the blocks before and after, and what encloses it. A
decision tree, grown from a small labelled table of pages (``labelled_pages``), says which blocks belong to the article.
A page in which nothing does is read again with less trust in what encloses its text: of a form only the controls are left out, and a name counts
only if all its words tell of something around an article (``social-links`` does, ``social-issues`` does not).
Pages are independent, so there is no shuffle at all.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.llm.labelled_pages import labelled_pages

#: Fixed values of HTML: elements that end a text block, those whose content is not text, and those without an end tag
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = frozenset("head script style noscript template svg math iframe object canvas audio video select option textarea button form fieldset dialog title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME_TAGS = frozenset("nav footer header aside menu".split())
BODY_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW_TAGS = "script|style|textarea|title|noscript|template|iframe"
#: Words in class, id and role values that name what stands around an article
AROUND = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disqus dialog disclaimer foot footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget complementary contentinfo".split()
)
MARKUP = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(?P<raw>{RAW_TAGS})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPLIT_NAMES = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Elements that hold the article or the page itself; their names do not say what stands around it
WHOLE_TAGS = frozenset("html body main article".split())
#: Controls of a form, and words that say nothing about what an element holds
CONTROLS = frozenset("label legend input".split())
GENERIC = frozenset("area bar body bottom box btn button buttons center col column container content group header inner item items left link links list main nav outer page panel right row section site top wrap wrapper".split())
#: Words in a compound name (has-sidebar, no-comments) after which it tells of something else on the page, or of its absence
ABOUT_OTHERS = frozenset("has have with without no not non hide hides".split())

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "around", "inside", "heading")
DEPTH, LEAST_LEAF = 8, 6


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH):
    """A tree as nested (feature, threshold, at most, above) with 0 or 1 at the leaves; splits lower the Gini impurity most."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share > 0.5)
    best = (0.0, None, None)
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        v, ones = rows[order, f], np.cumsum(labels[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        n = cut + 1
        cut, n = cut[(n >= LEAST_LEAF) & (len(v) - n >= LEAST_LEAF)], n[(n >= LEAST_LEAF) & (len(v) - n >= LEAST_LEAF)]
        if not len(cut):
            continue
        low, high = ones[cut] / n, (ones[-1] - ones[cut]) / (len(v) - n)
        gain = share * (1 - share) - (n * low * (1 - low) + (len(v) - n) * high * (1 - high)) / len(v)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[1] is None:
        return int(share > 0.5)
    low = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(rows[low], labels[low], depth - 1), grow_tree(rows[~low], labels[~low], depth - 1)


def labelled_blocks(pages: list[tuple[str, list[tuple[str, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of the blocks of labelled pages (html, [(text, label)]); raises if a page's blocks are not those labelled."""
    rows, labels = [], []
    for html, blocks in pages:
        found = blocks_of(html)
        if [b[0] for b in found] != [text for text, _ in blocks]:
            raise ValueError("labels that are not of the page's blocks")
        rows += features_of(found)
        labels += [label for _, label in blocks]
    return np.asarray(rows, float), np.asarray(labels)


def trained_tree(pages: list[tuple[str, list[tuple[str, int]]]] | None = None, depth: int = DEPTH):
    """The tree of labelled pages, those of ``labelled_pages`` if none are given."""
    return grow_tree(*labelled_blocks(labelled_pages() if pages is None else pages), depth)


def is_text(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def attributes_of(rest: str) -> dict[str, str]:
    """Attributes of a start tag by name in lower case, without a value empty; of one that stands twice the first holds."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), entities.unescape("".join(values)))
    return found


def is_unseen(attributes: dict[str, str]) -> bool:
    """Whether an element is not shown: a ``hidden`` attribute, aria-hidden of true, or display none in its style."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(UNSHOWN.search(attributes.get("style", "")))


def is_around(tag: str, attributes: dict[str, str], again: bool = False) -> bool:
    """Whether the class, id or role of an element names something around an article; ``again``, by all words of a name."""
    if tag in WHOLE_TAGS:
        return False
    if again:
        names = ([w.lower() for w in SPLIT_NAMES.split(x) if w and not w.isdigit()] for x in " ".join(attributes.get(x, "") for x in ("class", "id", "role")).split())
        return any(AROUND & set(words) and set(words) <= AROUND | GENERIC for words in names)
    for name in " ".join(attributes.get(x, "") for x in ("class", "id", "role")).split():
        for word in SPLIT_NAMES.split(name):
            if word.lower() in ABOUT_OTHERS:
                break
            if word.lower() in AROUND:
                return True
    return False


def blocks_of(page: str, again: bool = False) -> list[tuple]:
    """(text, words, link density, around, inside, heading) of each block that has text, in page order; ``again``, with forms open and names read strictly."""
    hidden = (HIDDEN_TAGS - {"form", "fieldset"}) | CONTROLS if again else HIDDEN_TAGS
    found: list[tuple] = []
    stack: list[tuple] = []  # open elements: (tag, counts before it)
    state = [0, 0, 0, 0, 0]  # depth in hidden, around, inside, heading, a
    parts: list[str] = []
    linked: list[bool] = []

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = len(text.split())
                of_links = sum(len(p.split()) for p, link in zip(parts, linked, strict=True) if link)
                found.append((text, n, min(1.0, of_links / n), int(state[1] > 0), int(state[2] > 0), int(state[3] > 0)))
            parts.clear()
            linked.clear()

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not state[0]:
            parts.append(entities.unescape(page[at : m.start()]))
            linked.append(state[4] > 0)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            close()
        if tag in VOID_TAGS:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    state[:] = stack[k][1]
                    del stack[k:]
                    break
            continue
        if m["rest"].endswith("/") and tag not in BLOCK_TAGS and tag != "a":
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            state[:] = stack.pop()[1]
        elif tag in BLOCK_TAGS:  # a paragraph and its inline elements end where the next block starts
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    state[:] = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        stack.append((tag, tuple(state)))
        attributes = attributes_of(m["rest"]) if m["rest"] else {}
        state[0] += tag in hidden or is_unseen(attributes)
        state[1] += (tag in FRAME_TAGS and not (tag == "header" and state[2])) or is_around(tag, attributes, again)
        state[2] += tag in BODY_TAGS
        state[3] += tag in HEADINGS
        state[4] += tag == "a"
    if at < len(page) and not state[0]:
        parts.append(entities.unescape(page[at:]))
        linked.append(state[4] > 0)
    close()
    return found


def features_of(blocks: list[tuple]) -> list[tuple]:
    """FEATURES of each block of a page."""
    none = ("", 0, 0.0, 0, 0, 0)
    padded = [none, *blocks, none]
    return [(b[1], b[2], before[1], before[2], after[1], after[2], *b[3:]) for before, b, after in zip(padded, blocks, padded[2:], strict=False)]


def main_text(page: str, tree) -> str:
    """Article blocks of a page, joined by one newline; empty if there is none, read as it is and read again."""
    for again in (False, True):
        blocks = blocks_of(page, again)
        found = [b[0] for b, row in zip(blocks, features_of(blocks), strict=True) if is_text(tree, row)]
        if found:
            return "\n".join(found)
    return ""


def extract_text(pages: DataFrame, labelled: list[tuple[str, list[tuple[str, int]]]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html).

    Null and empty html give an empty text; repeated rows are extracted each; the whole page is read whatever its length; other columns
    of pages are ignored, so names cannot clash.
    """
    tree = trained_tree(labelled)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["page_id", "url"]].assign(text=[main_text(h or "", tree) for h in b["html"]])

    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
