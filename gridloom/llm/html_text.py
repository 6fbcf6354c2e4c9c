"""Main text of web pages: structure first, a host-wide suffix sort where structure doesn't decide.

A page's markup is read into blocks of text. Blocks in menus, page headers, footers, sidebars, notices,
adverts, forms, comments and hidden parts, told by their elements, roles and class or id words, are
dropped; so are paragraphs, headings, items and cells whose own class or role says so (their ids are
often words of the text and don't count, nor do inline elements). A page with an article (else a main part) has that as its text, whole: an article's words are kept
even where other pages have them too.

For pages that mark neither, all remaining blocks are undecided and the token streams of a host's pages are
compared: of the suffixes that start at every token, those are grouped that agree in ``RUN`` tokens; tokens
covered by a run that at least ``LEAST_PAGES`` distinct pages of the host have are boilerplate and removed,
however large the host is; other runs stay. Blocks of fewer tokens are compared whole in the same way. A
passage on two pages stays: a page under two addresses would lose its text. Repeated rows are one page.
Coverage by longer repeats is the union of coverage by their runs of ``RUN`` tokens, so suffixes need no
sorting beyond that depth. Runs are counted with a partial aggregation by host and leading tokens: a large
host is never gathered in one task.

Within a block white space becomes one space; character references are decoded; line breaks are white
space; blocks are joined by a line feed. Markup is read in one forward scan whose time is in proportion to the
page, however long and broken it is: a quote that is never closed is an ordinary character, a tag, comment
or script that is never closed ends with the page. Null or empty pages and pages without text give the empty text.
The cells of a table's row are one block, with a space between them. Only the columns named are read. Null URLs share the empty host. Repeated rows each give their row; an empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import WORDS, materialize, run_hashes

RUN, LEAST_PAGES = 8, 3

# Fixed values of HTML: elements by their role in a page.
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "noembed", "noframes")
_DROPPED = frozenset("head nav footer aside form button select option dialog menu object canvas audio video math datalist fieldset".split())
_CONTAINERS = frozenset("html body head article main nav header footer aside form div section ul ol dl table details dialog menu figure blockquote button select fieldset object canvas audio video math datalist center address".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption pre hr figcaption summary legend option thead tbody tfoot".split())
# elements that end a block of the first kind that is still open
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr", "thead", "tbody", "tfoot"), "th": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tr": ("tr", "thead", "tbody", "tfoot"), "thead": ("tbody", "tfoot"), "tbody": ("tbody", "tfoot"), "tfoot": ("tbody", "tfoot")}
_INLINE_DROPPED = frozenset("button select object canvas audio video math datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar alert".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe subscription signup login share sharing related recommended recommendations comment comments commentlist reply replies respond disqus widget"
    " toolbar skip paywall pagination pager".split()
)
_OUTER_WORDS = _WORDS | frozenset("header topbar copyright legal disclaimer social".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_LONG_NUMBER = re.compile(r"&#(\d{8,})")


def _decoded(text: str) -> str:
    """Character references decoded; numbers too long for a character stand for one that is out of range."""
    return html.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'}", text)) if "&" in text else text


class Scan:
    """The pieces of a page in order: (text before a tag, name or None, whether it closes, attributes)."""

    def __init__(self, page: str):
        self.page, self.open_quotes = page, {'"': False, "'": False}

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``, or -1."""
        while True:
            m = _STOP.search(self.page, at)
            if m is None:
                return -1
            if m[0] == ">":
                return m.start()
            at = _SPACE.match(self.page, m.end()).end()
            quote = self.page[at : at + 1]
            if quote in self.open_quotes and not self.open_quotes[quote]:
                end = self.page.find(quote, at + 1)
                # none follows: nor will one for the next tags
                self.open_quotes[quote] = end < 0
                at = max(at, end) + 1

    def __iter__(self) -> Iterator[tuple[str, str | None, bool, str]]:
        page, size, at, text_from = self.page, len(self.page), 0, 0
        while True:
            start = page.find("<", at)
            if start < 0:
                yield page[text_from:], None, False, ""
                return
            mark = page[start + 1 : start + 2]
            closes = mark == "/"
            name = _NAME.match(page, start + 1 + closes)
            if name is None and (mark not in ("!", "?", "/") or not mark):
                at = start + 1  # a sign of the text
                continue
            if name is not None:
                end = self._tag_end(name.end())
            elif page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                end = end + 2 if end >= 0 else -1
            else:
                end = page.find(">", start)
            before = page[text_from:start]
            if end < 0:
                yield before, None, False, ""
                return
            at = text_from = end + 1
            if name is None:
                yield before, None, False, ""
                continue
            kind, rest = name[0].lower(), page[name.end() : end]
            yield before, kind, closes, rest
            if kind in _ENDS and not closes and not rest.rstrip().endswith("/"):
                m = _ENDS[kind].search(page, at)
                at = text_from = m.start() if m else size


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): _decoded(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _is_dropped(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Does an element open a part that isn't main text? ``inside``: within the article."""
    if name in _DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    return not _class_words(attributes, ("class", "id")).isdisjoint(_WORDS if inside else _OUTER_WORDS)


def _is_dropped_block(attributes: dict[str, str], inside: bool) -> bool:
    """Does a paragraph, heading, item or cell say that it isn't main text?"""
    return attributes.get("role", "").lower() in _ROLES or not _class_words(attributes, ("class",)).isdisjoint(_WORDS if inside else _OUTER_WORDS)


def _class_words(attributes: dict[str, str], names: tuple[str, ...]) -> set[str]:
    return {w for n in names if n in attributes for w in _SPLIT.split(attributes[n].lower())}


def page_blocks(page: str) -> tuple[list[str], bool]:
    """The blocks that may be main text, in order, and whether the page itself marks them as such."""
    out: dict[str, list[str]] = {"article": [], "main": [], "": []}
    # open containers and dropped blocks; whether each opens a dropped part, is a main part
    stack: list[tuple[str, bool, bool]] = []
    is_open: Counter[str] = Counter()
    dropped, mains = 0, 0
    held: list[str] = []

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out["article" if is_open["article"] else "main" if mains else ""].append(text)

    def push(name: str, drops: bool, is_main: bool) -> None:
        nonlocal dropped, mains
        stack.append((name, drops, is_main))
        is_open[name] += 1
        dropped += drops
        mains += is_main

    def pop() -> None:
        nonlocal dropped, mains
        name, drops, is_main = stack.pop()
        is_open[name] -= 1
        dropped -= drops
        mains -= is_main

    for text, name, closes, rest in Scan(page):
        if text and not dropped:
            held.append(_decoded(text))
        if name is None or name in _RAW:
            continue
        if name == "br":
            held.append(" ")
            continue
        is_block, is_container = name in _BLOCKS, name in _CONTAINERS
        if not is_block and name not in ("td", "th"):
            continue
        if not is_block and not dropped:
            held.append(" ")  # a cell's words aren't its neighbour's
        if closes:
            if is_block and not dropped:
                close()
            if is_container and is_open[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif not is_container and stack and stack[-1][0] == name:
                pop()  # a dropped block
            continue
        while stack and stack[-1][0] not in _CONTAINERS and (name in _ENDED_BY[stack[-1][0]] if stack[-1][0] in _ENDED_BY else is_block):
            pop()
        if is_block and not dropped:
            if name in _INLINE_DROPPED:
                held.append(" ")
            else:
                close()
        inside = is_open["article"] > 0
        if not is_container:
            if not dropped and name != "hr" and rest and _is_dropped_block(_attributes(rest), inside):
                push(name, True, False)
            continue
        if name in ("body", "article", "main") and dropped and not inside:
            while dropped:  # a part that was never closed ends where the page's content begins
                pop()
        attributes = _attributes(rest)
        push(name, not dropped and _is_dropped(name, attributes, inside), name == "main" or attributes.get("role", "").lower() == "main")
    if not dropped:
        close()
    if out["article"]:
        return out["article"], True
    if out["main"]:
        return out["main"], True
    return out[""], False


PAGE_SCHEMA = "page_id long, url string, text string, host string, blocks array<string>, row string"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            texts, blocks, names = [], [], []
            for page in rows.column("html").to_pylist():
                found, decided = page_blocks(page or "")
                texts.append("\n".join(found) if decided or not found else None)
                blocks.append(None if decided or not found else found)
                names.append(f"{part}-{n}")
                n += 1
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), rows.column("host"), pa.array(blocks, pa.list_(pa.string())), pa.array(names)], ["page_id", "url", "text", "host", "blocks", "row"])


def block_key(words: list[str]) -> int:
    """The key of a whole block of fewer than RUN tokens."""
    return int(run_hashes(WORDS(words), len(words)).view(np.int64)[0])


def _suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, row and the keys of the RUN tokens at each suffix and of each short block, once for each page."""
    for batch in batches:
        for host, row, blocks in zip(batch.column("host").to_pylist(), batch.column("row").to_pylist(), batch.column("blocks").to_pylist()):
            short = [block_key(w) for b in blocks if 0 < len(w := b.split()) < RUN]
            keys = np.unique(np.concatenate([run_hashes(WORDS(" ".join(blocks).split()), RUN).view(np.int64), np.array(short, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array([row] * len(keys), pa.string()), pa.array(keys)], ["host", "row", "suffix"])


def unique_runs(blocks: list[str], repeated: set[int]) -> str:
    """Blocks without the tokens that a repeated run covers, and without short blocks that are repeated."""
    words = [b.split() for b in blocks]
    flat = [w for b in words for w in b]
    keys = run_hashes(WORDS(flat), RUN).view(np.int64).tolist()
    covered = np.zeros(len(flat) + 1, np.int64)
    for i, k in enumerate(keys):
        if k in repeated:
            covered[i] += 1
            covered[i + RUN] -= 1
    covered = np.cumsum(covered)
    out, at = [], 0
    for b in words:
        kept = [w for i, w in enumerate(b) if not covered[at + i]]
        at += len(b)
        if kept and (len(b) >= RUN or block_key(b) not in repeated):
            out.append(" ".join(kept))
    return "\n".join(out)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [unique_runs(b, set(r or ())) for b, r in zip(batch.column("blocks").to_pylist(), batch.column("repeated").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    parsed = materialize(rows.mapInArrow(_parse_batches, PAGE_SCHEMA), "page-blocks")
    decided = parsed.where(F.col("text").isNotNull()).select("page_id", "url", "text")
    open_ = parsed.where(F.col("text").isNull()).select("page_id", "url", "host", "blocks", "row")
    if open_.isEmpty():
        return decided
    keyed = lambda rows: rows.select("host", "row", "blocks").mapInArrow(_suffix_batches, "host string, row string, suffix long")
    pages_once = open_.groupBy("page_id", "url", F.xxhash64("blocks")).agg(F.min("row").alias("row"))
    counted = keyed(open_.join(pages_once, "row", "left_semi")).groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("pages"))
    repeated = counted.where(F.col("pages") >= LEAST_PAGES).select("host", "suffix")
    of_page = keyed(open_).join(repeated, ["host", "suffix"]).groupBy("row").agg(F.collect_list("suffix").alias("repeated"))  # at most a page's tokens
    cut = open_.join(of_page, "row", "left").select("page_id", "url", "blocks", "repeated").mapInArrow(_cut_batches, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))
    return decided.unionAll(cut)
