"""Main text of web pages by sums of text lengths over windows of lines.

1. Markup is stripped: scripts, styles and comments go, block elements end a line, character references
   are decoded, white space in a line becomes one blank.  A line remembers whether it is in an article and how
   much of it is link text.
2. Lines of navigation, footers and buttons, and lines that are mostly links outside an article, count as empty lines.
   So do lines of headers, sidebars, notices, adverts, forms and reader comments (by element, role, class or id), unless
   such an element holds over half of the page's text: then it is a container like any other.
3. Text lengths are summed over windows of WINDOW lines.  Where the sum rises from nothing is a surge point, where it is
   nothing again a dive point.  The lines between are text if one of their windows holds SURGE characters; on a page
   without such a window, if one holds as many as any.
4. Where lines of article and main elements hold half of that text or are half of its lines, only these stay.

Short lines between long ones are kept, as a window is only empty where WINDOW lines in a row are.

Nulls and ties: a null or empty page has an empty text; so has one without lines.  Rows are judged one by one, repeated ones alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from llm import words

WINDOW = 3  # lines whose text lengths are summed
SURGE = 86  # characters of a window from which the lines around it are text
LINKED = 0.6  # share of link text from which a line outside an article is a menu line

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HELD = frozenset("article main section div body aside nav header footer form fieldset dialog menu button".split())
NEVER = frozenset("nav footer button".split())
ASIDE = frozenset("aside form fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN = frozenset(("article", "main"))
TERMS = ("ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|banners|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disclaimer|"
         "disqus|footer|foot|gdpr|header|login|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|pager|pagination|popup|"
         "promo|promoted|promotion|recommended|related|replies|reply|search|share|sharing|sidebar|sidebars|signup|social|sponsor|sponsored|sponsors|"
         "subscribe|subscription|teaser|toolbar|topbar|widget|widgets|warning")
HINT = re.compile(rf"(?:^|[-_])(?:{TERMS})(?:[-_]?\d+)?$|^(?:{TERMS})(?:[-_]|$)", re.IGNORECASE)
WITHOUT = re.compile(r"^(?:has|no|with|without|is|js)[-_]", re.IGNORECASE)


def _hinted(name: str, rest: str) -> bool:
    """Whether an element's role, class or id hints that it is no part of the article."""
    if not rest or name in ("html", "body", "main"):
        return False
    for key, a, b, c in NAMED.findall(rest):
        value = a or b or c
        if key.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        elif any(HINT.search(part) and not WITHOUT.match(part) for part in value.split()):
            return True
    return False


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, float]], list[int]]:
    """(text, innermost hinted element, in an article, share of link text) of every line; and the hinted element around each.

    Element 0 is the page.  Lines of elements that never hold text are empty.
    """
    out: list[tuple[str, int, bool, float]] = []
    around = [0]
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # element, hinted element, never text, in an article
    text: list[str] = []
    links: list[int] = []
    in_link, at = False, 0

    def end_line() -> None:
        nonlocal text, links
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                _, hinted, never, article = stack[-1]
                out.append(("" if never else line, hinted, article, min(1.0, sum(links) / len(line))))
            text, links = [], []

    def hint() -> int:
        around.append(stack[-1][1])
        return len(around) - 1

    for found in MARKUP.finditer(page):
        if found.start() > at:
            piece = page[at:found.start()]
            text.append(piece)
            if in_link:
                links.append(len(piece.strip()))
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            if (found["raw"] or "").lower() == "title":
                end_line()
            continue
        closing = bool(found["end"])
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = not closing
        if name not in BLOCK and name != "button":
            if not closing and name not in VOID and name not in ("a", "p") and found["rest"] and _hinted(name, found["rest"]) and not found["rest"].rstrip().endswith("/"):
                end_line()
                top = stack[-1]
                stack.append((name, hint(), *top[2:]))
            elif closing and stack[-1][0] == name:
                end_line()
                stack.pop()
            continue
        end_line()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in HELD or _hinted(name, found["rest"]):
            if name in VOID or found["rest"].rstrip().endswith("/"):
                continue
            top = stack[-1]
            hinted = name in ASIDE or (name == "header" and not top[3]) or _hinted(name, found["rest"])
            stack.append((name, hint() if hinted else top[1], top[2] or name in NEVER, top[3] or name in MAIN))
    if at < len(page):
        text.append(page[at:])
    end_line()
    return out, around


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(surge, dive) of the stretches of lines that are text; `lengths` are those of the lines' texts."""
    sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
    least, out, i = min(surge, max(sums, default=0)), [], 0
    while i < len(lengths):
        if not lengths[i]:
            i += 1
            continue
        start = i
        while i < len(lengths) and sums[i]:
            i += 1
        if max(sums[start:i]) >= least:
            out.append((start, i))
    return out


def left_out(lines: list[tuple[str, int, bool, float]], around: list[int]) -> list[bool]:
    """Whether each hinted element is left out with what it holds: unless it and all around it hold over half of the page's text."""
    held = [0] * len(around)
    for text, hinted, _, _ in lines:
        held[hinted] += len(text)
    for e in range(len(around) - 1, 0, -1):  # an element comes after the one around it
        held[around[e]] += held[e]
    out = [False] * len(around)
    for e in range(1, len(around)):
        out[e] = out[around[e]] or 2 * held[e] <= held[0]
    return out


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text, in page order."""
    lines, around = lines_of(page)
    out = left_out(lines, around)
    lengths = [0 if out[hinted] or share >= LINKED and not article else len(text) for text, hinted, article, share in lines]
    kept = [i for low, high in stretches(lengths) for i in range(low, high) if lengths[i]]
    main = [i for i in kept if lines[i][2]]
    if 2 * len(main) >= len(kept) or 2 * sum(lengths[i] for i in main) >= sum(lengths[i] for i in kept):
        kept = main
    return [lines[i][0] for i in kept]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns with the main text of html, its code points and its number of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches, column="html"):
            names = batch.schema.names
            found = [main_blocks(page) if page else [] for page in batch.column(names.index("html")).to_pylist()]
            texts = ["\n\n".join(f) for f in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([len(f) for f in found], pa.int64())], names=[*keep, "text", "n_chars", "n_blocks"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*dict.fromkeys([*keep, "html"])).mapInArrow(run, f"{kinds}, text string, n_chars long, n_blocks long")
