"""HTML extraction by tag-path ratios.

Every run of text in a page has a path of tags from the root to its leaf.  Per path, the amount of text and of
punctuation over the number of its nodes is aggregated, text of links left out of the amount; both ratios are smoothed over the order in which the paths'
nodes come in the page, fused by their geometric mean, weighted, and paths whose mean reaches a share of the page's are content.
So a short path apart from the text falls, whatever it is called: an advert in a plain ``div``, a teaser in an article of its own.

Weights: where a page has an article or main part, a block outside of it counts a third.  A block below a class or id that
names adverts, notices or reader comments counts a tenth, one below a name that may mean such (``related``, ``search``) half, in a
main part in full.  The page's mean comes from the blocks without such a name, if there are any.  Only elements and roles by
which HTML itself says menu, header, footer, sidebar, form or dialogue take no part at all, nor do those whose content is no text.

Pages are independent: the operator is a map over rows, in one pass over each whole page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is no text, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object canvas audio video select".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: An open element of the first kind ends when one of the second begins.
IMPLIED_END = {"p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option", "optgroup"})}
#: Elements and roles that are page furniture.
FURNITURE = frozenset("nav header footer aside form button dialog menu head label input".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class or id that name furniture, and words that may.
FURNITURE_WORD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo\w*|sponsor\w*|banner\w*|cookie\w*|consent|notice|gdpr|popup|modal|newsletter|subscribe|sidebar\w*|widget\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|pagination|pager|footer|masthead|comments?|comment-\w+|reply|replies|disqus|respond|share|sharing|social|login|signup|toolbar)(?:$|[\s_-])", re.I)
DOUBTFUL_WORD = re.compile(r"(?:^|[\s_-])(?:side|nav\w*|related|recommend\w*|search|tags?)(?:$|[\s_-])", re.I)
#: The text's own frame: inside it a header belongs to the article.
MAIN = ("article", "main")
#: Blogs name an article's tags and options in its class, so there a name must begin with the word and say a comment, teaser or advert.
MAIN_FURNITURE_WORD = re.compile(r"(?:^|\s)(?:ads?|advert\w*|promo\w*|sponsor\w*|comments?|reply|replies|disqus|respond|related|recommend\w*|teasers?|widget\w*|newsletter|sidebar)(?:$|\s|[_-]+(?:\d+|body|box|card|content|entry|item|list|posts?|text)(?:$|\s))", re.I)
#: What the ratios of a block are multiplied with: outside of the page's main parts, below a doubtful name, below a name of furniture.
OUTSIDE, DOUBTFUL, NAMED = 1 / 3, 0.5, 0.1

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: White space inside a block becomes one space; so do no-break spaces.
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


def _weight(tag: str, attributes: str, inside_main: bool) -> float:
    """What an element's tag, role, class and id say of it: 0 for furniture, 1 for nothing."""
    if tag in FURNITURE and not (tag == "header" and inside_main):
        return 0.0
    if not attributes or "=" not in attributes:
        return float("hidden" not in attributes.lower().split()) if attributes else 1.0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in FURNITURE_ROLES or found.get("aria-hidden") == "true" or "hidden" in found:
        return 0.0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in ("html", "body") or names == " ":
        return 1.0
    if (MAIN_FURNITURE_WORD if tag in MAIN else FURNITURE_WORD).search(names):
        return NAMED
    return DOUBTFUL if tag not in MAIN and not inside_main and DOUBTFUL_WORD.search(names) else 1.0


def _blocks(page: str) -> list[tuple[str, str, int, float, int]]:
    """(path, text, number of the main part that it is in or 0, weight by names, characters outside of links) of each block that is no furniture, in page order."""
    out: list[tuple[str, str, int, float, int]] = []
    stack: list[tuple[str, float]] = []  # tag, least weight here and above
    parts: list[str] = []
    mains, main, at, path, weight, linked = 0, 0, 0, "", 1.0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((path, text, main if mains else 0, weight, max(len(text) - linked, 0)))
            linked = 0

    size = len(page)
    lower = None
    while at < size:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            if not stack or stack[-1][1]:
                if not parts:
                    path, weight = "/".join(t for t, _ in stack if t in BLOCKS), stack[-1][1] if stack else 1.0
                parts.append(page[at : m.start() if m else size])
                if any(t == "a" for t, _ in stack):
                    linked += len(" ".join(html.unescape(parts[-1]).split()))
            if m is None:
                break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            close()
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack:
                    t, _ = stack.pop()
                    mains -= t in MAIN
                    if t == tag:
                        break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", at)
                end = size if end < 0 else end
                at = page.find(">", end) + 1 or size
            continue
        while tag in BLOCKS and (k := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), -1)) >= 0 and tag in IMPLIED_END.get(stack[k][0], ()):
            del stack[k:]
        if tag in VOID or m[3].endswith("/"):
            continue
        stack.append((tag, min(stack[-1][1] if stack else 1.0, _weight(tag, m[3], mains > 0))))
        if tag in MAIN:
            main += not mains
            mains += 1
    close()
    return out


def _smoothed(ratio: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    padded = np.pad(ratio, ((len(kernel) // 2,) * 2, (0, 0)), mode="edge")
    return sum(w * padded[k : k + len(ratio)] for k, w in enumerate(kernel))


def _content_paths(blocks: list[tuple[str, str, int, float, int]], spread: float, share: float) -> set[tuple]:
    """The (path, main part, weight) whose mean weighted ratio reaches ``share`` of the mean of the plain ones.

    Nothing is smoothed across the edge of a main part, or between blocks of different weights.
    """
    text: dict[tuple, int] = {}
    marks: dict[tuple, int] = {}
    nodes: dict[tuple, int] = {}
    keys = [(path, main, weight) for path, _, main, weight, _ in blocks]
    for key, (_, body, *_, own) in zip(keys, blocks):
        text[key] = text.get(key, 0) + own
        marks[key] = marks.get(key, 0) + len(PUNCTUATION.findall(body))
        nodes[key] = nodes.get(key, 0) + 1
    ratio = np.array([[text[k] / nodes[k], (1 + marks[k]) / nodes[k]] for k in keys])
    width = int(np.ceil(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-width, width + 1) / spread) ** 2)
    kernel /= kernel.sum()
    inside, weight = np.array([m for _, m, _ in keys]), np.array([w for _, _, w in keys])
    edges = np.flatnonzero((inside[1:] != inside[:-1]) | (weight[1:] != weight[:-1])) + 1
    smooth = np.concatenate([_smoothed(run, kernel) for run in np.split(ratio, edges)])
    fused = np.sqrt(smooth[:, 0] * smooth[:, 1])
    bound = share * (fused[weight == 1.0] if (weight == 1.0).any() else fused * weight).mean()
    fused = fused * weight * np.where((inside > 0) | ~inside.any(), 1.0, OUTSIDE)
    by_path: dict[tuple, list[float]] = {}
    for k, f in zip(keys, fused):
        by_path.setdefault(k, []).append(f)
    return {k for k, f in by_path.items() if sum(f) / len(f) >= bound}


def main_text(page: str | None, spread: float = 1.0, share: float = 0.3) -> str:
    """The article of a page: its content blocks in page order, joined by one space."""
    blocks = _blocks(page) if page else []
    keep = _content_paths(blocks, spread, share) if blocks else set()
    return " ".join(body for path, body, main, weight, _ in blocks if (path, main, weight) in keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", spread: float = 1.0, share: float = 0.3) -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text (empty if none), n_chars (its code points).

    A null or empty page has an empty text.  Character references are decoded; white space inside a block becomes one
    space.  Repeated rows are read each.  An empty table gives an empty result; other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, spread, share) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = dict(pages.dtypes)
    return pages.select(id_col, url_col, F.col(html_col)).mapInArrow(read, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long")
