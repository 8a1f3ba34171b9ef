"""HTML extraction by tag-path ratios.

A page becomes a run of text blocks, each with its path of block-level tags
(with their class, where the tag alone says little) from the root. Per path,
text length and punctuation are summed and divided by the number of blocks,
which gives two ratios. Both are smoothed over the blocks in page order with a
Gaussian and fused by their product; a threshold of a standard deviation
selects paths. The innermost element path that holds most of the selected text
is the content; all blocks within it are main text, however short. Elements
whose tag or role is never main text take no part. Class and id words of
adverts, notices, comments and the like lower the score of the paths below
them, article and main elements raise it, and nothing else: the ratios decide.
A name that says nothing but comments, adverts, notices, menus or the like, and
an article within an article, which is a reader's comment, set an element apart:
that leaves a thousandth of its paths' scores, and such paths below the
threshold are no main text even within the content. Where nearly all text of a
page is in such elements, their names are disregarded.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm.common import read_table

#: Tags that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text, not markup, up to their end tag.
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
#: Elements that are never main text.
OUTSIDE_TAGS = frozenset("head nav footer aside form menu button select option dialog search fieldset noscript".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that mark what is not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments disqus reply replies respond discussion widget pager pagination toolbar "
    "disclaimer copyright legal skip".split()
)
#: Words that set an element apart by a name made of them (and of words that say nothing), whatever is around it.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments disqus reply replies respond widget pager pagination toolbar".split()
)
FILLER_WORDS = frozenset(
    "list box block wrapper wrap container section area thread form inner outer left right top bottom bar group row col column count unit slot zone links items item "
    "posts articles stories text message site page main content body meta author reader user the of and".split()
)
#: A name that begins so tells of something else ("has-sidebar").
MODIFIERS = frozenset("has no with without is not".split())
#: Share of the text that names leave at least; where they would leave less, they are wrong about the page.
LEFT = 0.02
#: A start tag of a key closes open elements of the values, up to the nearest stop.
_P_CLOSERS = BLOCK_TAGS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "frameset", "legend", "summary"}
_SELF_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table article section div main body html nav aside footer header form blockquote".split())

# A quoted value ends at its quote if a space, a slash or the tag's end follows; a stray quote is a character.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
#: Block tags that hold one block, so no container.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote".split())
#: What a name that does not go with main text leaves of a path's score, what being set apart does, and what an article or main element adds to it.
NAMED, APART, ARTICLE = 0.05, 0.001, 4.0


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _outside(tag: str, attrs: dict[str, str], within_article: bool) -> bool:
    """The element and all in it are not main text."""
    if tag in OUTSIDE_TAGS or tag == "header" and not within_article:
        return True
    if tag in ("html", "body"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in OUTSIDE_ROLES


def _named(attrs: dict[str, str]) -> bool:
    return any(not OUTSIDE_WORDS.isdisjoint(re.split(r"[^a-z]+", attrs.get(k, ""))) for k in ("class", "id"))


def _apart(attrs: dict[str, str]) -> bool:
    """A class or the id consists of words that set an element apart."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words == ["footer"] or words and words[0] not in MODIFIERS and not APART_WORDS.isdisjoint(words) and all(w in APART_WORDS or w in FILLER_WORDS for w in words):
            return True
    return False


class Element:
    """An open element: its label in paths, whether it is outside main text or set apart by name, and what names leave of a score."""

    __slots__ = ("tag", "label", "outside", "factor", "inline", "apart")

    def __init__(self, tag: str, label: str, outside: bool, factor: float, inline: bool, apart: bool):
        self.tag, self.label, self.outside, self.factor, self.inline, self.apart = tag, label, outside, factor, inline, apart


#: Ends the label of an element that is set apart.
MARK = "!"
Block = tuple[tuple[str, ...], float, str]


def blocks(page: str) -> list[Block]:
    """(path of labels, what names leave of its score, text) of each block that may be main text, in page order.

    Unclosed and stray tags are tolerated; texts are decoded, white space
    within a block is one space, and blank blocks are left out.
    """
    out: list[Block] = []
    stack: list[Element] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text and not (stack and stack[-1].outside):
                shown = [e for e in stack if not e.inline]
                out.append((tuple(e.label for e in shown), shown[-1].factor if shown else 1.0, text))

    def close(k: int) -> None:
        # An inline element that is outside has no block of its own: what it holds is not held at all.
        if not stack[k].inline:
            flush()
        del stack[k:]

    def close_one_of(tags: set[str]) -> None:
        """Close the innermost open element of ``tags``, and what is open in it, short of a stop."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in _STOPS:
                return

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        muted = bool(stack) and stack[-1].inline
        text = page[at : m.start()] if m else page[at:]
        if text and not muted:
            held.append(text)
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in _STOPS and tag not in _STOPS and tag not in OUTSIDE_TAGS:
                    break
            else:
                if tag in BLOCK_TAGS:
                    flush()
            continue
        raw = m["attrs"] or ""
        if tag in RAW_TAGS:
            if not raw.rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID_TAGS:
            if tag in ("br", "hr"):
                held.append(" ")
                if tag == "hr":
                    flush()
            continue
        attrs = _attributes(raw) if raw else {}
        if tag in BLOCK_TAGS or tag in OUTSIDE_TAGS:
            flush()
            if tag in _P_CLOSERS:
                close_one_of({"p"})
            if tag in _SELF_CLOSE:
                close_one_of(_SELF_CLOSE[tag])
            if tag == "body":
                close_one_of({"head"})
            within = any(e.tag in ("article", "main") for e in stack)
            outside = bool(stack) and stack[-1].outside or _outside(tag, attrs, within)
            factor = stack[-1].factor if stack else 1.0
            if tag in ("article", "main"):
                factor = ARTICLE
            elif not within and tag not in ("html", "body") and _named(attrs):
                factor *= NAMED
            label = tag if tag in LEAF_TAGS or not attrs.get("class") else f"{tag}.{' '.join(sorted(set(attrs['class'].split())))}"
            apart = bool(stack) and stack[-1].apart
            if not apart and tag not in ("html", "body") and (_apart(attrs) or tag == "article" and any(e.tag == "article" for e in stack)):
                apart, label = True, label + MARK
            stack.append(Element(tag, label, outside, factor, False, apart))
        elif (stack and stack[-1].inline or attrs and (_outside(tag, attrs, True) or _named(attrs))) and not raw.rstrip().endswith("/"):
            # An inline advert or the like, to its end or that of the block around it. A name needs a block's text
            # beside it to be wrong about, so a word of a sentence stays.
            if stack and stack[-1].inline or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in OUTSIDE_ROLES or not "".join(held).strip():
                stack.append(Element(tag, tag, bool(stack) and stack[-1].outside, stack[-1].factor if stack else 1.0, True, bool(stack) and stack[-1].apart))
    flush()
    return out


def apart(path: tuple[str, ...]) -> bool:
    """An element of the path is set apart."""
    return any(label.endswith(MARK) for label in path)


def names_hold(found: list[Block]) -> bool:
    """What is not set apart is enough of the text for the names to be right."""
    return sum(len(x) for p, _, x in found if not apart(p)) >= LEFT * sum(len(x) for _, _, x in found)


def path_scores(found: list[Block]) -> dict[tuple[str, ...], float]:
    """Fused ratio of each path: text and punctuation per block, smoothed in page order, times what names leave of it."""
    if not found:
        return {}
    chars: dict[tuple[str, ...], float] = defaultdict(float)
    marks: dict[tuple[str, ...], float] = defaultdict(float)
    times = Counter(p for p, _, _ in found)
    factor = dict.fromkeys(times, 0.0)
    trusted = names_hold(found)
    for path, named, text in found:
        if trusted and apart(path):
            named = APART
        chars[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        factor[path] = max(factor[path], named)
    radius = 1
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / 2.0)
    kernel /= kernel.sum()

    def smoothed(total: dict) -> np.ndarray:
        ratio = np.array([total[p] / times[p] for p, _, _ in found])
        return np.convolve(np.pad(ratio, radius, mode="edge"), kernel, mode="valid")

    fused = smoothed(chars) * (1.0 + smoothed(marks))
    sums: dict[tuple[str, ...], float] = defaultdict(float)
    for (path, _, _), v in zip(found, fused, strict=True):
        sums[path] += float(v)
    return {p: factor[p] * s / times[p] for p, s in sums.items()}


#: Share of the selected text that the content holds at least.
HELD = 0.85


def threshold_of(scores: dict[tuple[str, ...], float]) -> float:
    """Score from which a path is selected: a standard deviation of all."""
    values = np.array(list(scores.values()))
    return float(min(values.max(), values.std())) if len(values) > 1 else 0.0


def content_path(found: list[Block], scores: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    """Path of the element that holds the selected paths' text."""
    threshold = threshold_of(scores)
    tag = lambda label: label.rstrip(MARK).split(".", 1)[0]
    share: dict[tuple[str, ...], int] = defaultdict(int)
    size: dict[tuple[str, ...], int] = defaultdict(int)
    direct: dict[tuple[str, ...], int] = defaultdict(int)
    total = 0
    for path, _, text in found:
        depth = len(path)
        while depth and tag(path[depth - 1]) in LEAF_TAGS:
            depth -= 1
        direct[path[:depth]] += len(text)
        chosen = len(text) if scores[path] >= threshold else 0
        total += chosen
        for k in range(len(path) + 1):
            if not k or tag(path[k - 1]) not in LEAF_TAGS:
                share[path[:k]] += chosen
                size[path[:k]] += len(text)
    # An article or main element with most of the text is the content; else the deepest path that has all of it.
    told = [p for p, n in share.items() if p and n and n >= HELD * total and tag(p[-1]) in ("article", "main")]
    best = max(told or [p for p, n in share.items() if n == total], key=len)
    if not told:
        # Headings and paragraphs right beside the content belong to it, where they are little against its text.
        while len(best) > 1 and tag(best[-2]) not in ("html", "body"):
            up = best[:-1]
            if size[best] < HELD * size[up] or size[up] - size[best] != (direct[up] if up in direct else 0):
                break
            best = up
    return best


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by line feeds; empty if there is none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    scores = path_scores(found)
    best, threshold, trusted = content_path(found, scores), threshold_of(scores), names_hold(found)
    return "\n".join(text for path, _, text in found if path[: len(best)] == best and (scores[path] >= threshold or not (trusted and apart(path))))


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of their whole html; a column of that name is replaced.

    Null or empty html and pages without text give an empty text. Repeated
    rows and other columns pass through; an empty table stays empty.
    """
    from lexigrove.llm.common import with_fields

    kept = pages.drop(text) if text != source else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                made = pa.array([main_text(x) for x in part.column(part.schema.get_field_index(source)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, text])

    return kept.mapInArrow(run, with_fields(kept, f"`{text}` string"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from pyspark.sql import functions as F

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
