"""Main-text extraction from HTML by two-pass block rules (op 9).

A page is cut into blocks at block-level tags. Elements that are never main text
(menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag, role
or class word) mark their blocks. First pass: stop-word density, length and link
density decide the other blocks as good or bad; short blocks and those between the
thresholds stay ambiguous. Second pass: an ambiguous block takes the label of the
nearest decided block of its region (the article, or the page outside it); a tie is
good. Good blocks, white space collapsed, are joined by an empty line.

Every page is read whole. Null and empty html, and pages without main text, give the
empty text. Broken markup is read as browsers do: unclosed elements end with their
parent, an unclosed comment or script runs to the end. Repeated rows and null ids or
urls pass through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words.
STOP_WORDS = frozenset("""
the of and to in is that it was for on are with as at be this have from or by not but which an were their has had they you we he she his her will would can
der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war
le la les de des et est un une du en que qui dans pour pas sur au par il elle ce avec plus ne se son sont ou mais nous vous été aux cette
el los las y una por con no para es al lo como más pero sus este ha si sobre entre cuando ser son dos también fue había era muy hasta desde está
""".split())
SKIPPED = frozenset("script style textarea title noscript iframe template svg math select button object canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset("""
ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe
nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar pagination pager share sharing social related recommended widget
login signup search skip hidden
""".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus".split())
CONTENT_WORDS = frozenset("content main article post entry story body text".split())
BLOCKS = frozenset("""
address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main
menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
#: Block elements that a sibling of the same name ends, or (p) any block; kept on the stack only if they are boilerplate.
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li tr td th tbody thead tfoot pre".split())
#: Elements kept on the stack.
CONTAINERS = BLOCKS - LOOSE - frozenset("hr html body".split()) | SKIPPED - RAW | frozenset(["span"])

LONG = 70
STOP_LOW = 0.05
LINKS_LOW, LINKS_HIGH = 0.33, 0.5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?][^>]*(?:>|\Z)|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z0-9]+")


def _marks(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element with these attributes is boilerplate."""
    if tag in BOILERPLATE or (tag == "header" and not in_main):
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return False
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "role" and value in BOILERPLATE_ROLES:
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id"):
            names.update(NAME.findall(value))
    if names & COMMENT_WORDS:
        return True
    return tag not in MAIN and bool(names & BOILERPLATE_WORDS) and not names & CONTENT_WORDS


def blocks(html: str) -> list[tuple[str, int, str, int]]:
    """(text, characters in links, kind, region) in page order; kind is bad, main or page."""
    out: list[tuple[str, int, str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # (tag, kind inside it)
    linked = links = region = 0
    breaks = 0
    kind = "page"
    pos, end = 0, len(html)

    def close_block() -> None:
        nonlocal linked, breaks
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, linked, kind, region))
        parts.clear()
        linked = breaks = 0

    while pos < end:
        m = TOKEN.match(html, pos)
        pos = m.end()
        data = m[4]
        if data is not None:
            if kind != "skip":
                parts.append(data)
                if links:
                    linked += len(data.strip())
                if breaks and not data.isspace():
                    breaks = 0
            continue
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(html, pos)
                pos = html.find(">", close.end()) + 1 if close else end
                pos = pos or end
                continue
            if tag == "a":
                links = 1
            elif tag == "br":
                parts.append(" ")
                breaks += 1
                if breaks > 1:
                    close_block()
            elif tag in BLOCKS:
                close_block()
                if stack and stack[-1][0] in LOOSE and stack[-1][0] in ("p", tag):
                    kind = stack.pop()[1]
                    region += 1
            if tag in CONTAINERS and not m[3].endswith("/"):
                inner = kind
                if kind != "skip" and tag in SKIPPED or tag == "head":
                    inner = "skip"
                elif kind not in ("skip", "bad"):
                    if _marks(tag, m[3], kind == "main"):
                        inner = "bad"
                    elif tag in MAIN:
                        inner = "main"
                if inner != kind:
                    close_block()
                    region += 1
                stack.append((tag, kind))
                kind = inner
            elif tag == "body" and kind == "skip":
                stack.clear()
                kind = "page"
            elif tag in LOOSE and kind not in ("skip", "bad") and m[3] and _marks(tag, m[3], kind == "main"):
                stack.append((tag, kind))
                kind, region = "bad", region + 1
        else:
            if tag == "a":
                links = 0
            if tag in BLOCKS:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if kind != stack[i][1]:
                        close_block()
                        region += 1
                    kind = stack[i][1]
                    del stack[i:]
                    break
    close_block()
    return out


def _decide(text: str, linked: int, kind: str) -> bool | None:
    """First pass: good, bad, or None (ambiguous)."""
    if kind == "bad":
        return False
    n = len(text)
    link_density = min(1.0, linked / n)
    if link_density >= LINKS_HIGH or n < LONG and link_density >= LINKS_LOW:
        return False
    if n < LONG or link_density >= LINKS_LOW:
        return None
    words = text.lower().split()
    return True if sum(w in STOP_WORDS for w in words) >= STOP_LOW * len(words) else None


def _inherit(labels: list[bool | None], regions: list[int], kinds: list[str]) -> list[bool]:
    """Second pass: ambiguous blocks take the nearest decided label of their region, else (outside an article) of the page; a tie is good.

    Blocks of boilerplate elements are decided by their element and pass nothing on.
    """
    n = len(labels)
    out: list[bool | None] = list(labels)

    def nearest(same_region: bool) -> list[tuple[int, bool] | None]:
        best: list[tuple[int, bool] | None] = [None] * n
        for order in (range(n), range(n - 1, -1, -1)):
            seen = None
            for i in order:
                if same_region and seen and regions[seen[0]] != regions[i]:
                    seen = None
                if labels[i] is not None:
                    seen = (i, labels[i]) if kinds[i] != "bad" else seen
                elif seen:
                    d = (abs(i - seen[0]), not seen[1])
                    if best[i] is None or d < (best[i][0], not best[i][1]):
                        best[i] = (d[0], seen[1])
        return best

    if any(x is None for x in labels):
        own, page = nearest(True), nearest(False)
        for i in range(n):
            if out[i] is None:
                found = own[i] or (page[i] if kinds[i] == "page" else None)
                out[i] = found[1] if found else True
    return out


def extract(html: str | None) -> str:
    """Main text of one page."""
    found = blocks(html or "")
    labels = _inherit([_decide(t, k, kind) for t, k, kind, _ in found], [r for *_, r in found], [kind for _, _, kind, _ in found])
    return "\n\n".join(b[0] for b, good in zip(found, labels, strict=True) if good)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text (empty if none), n_chars (its code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
