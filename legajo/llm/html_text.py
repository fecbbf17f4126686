"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read as a sequence of tags and words.  Words score positive and tags
negative on the whole; the weight of each, by the element that holds it, is the
log-odds of lying inside the content region, learned from labelled pages.  One
linear scan finds the contiguous run with the highest sum.  Elements that are
never main text (scripts, menus, headers, footers, sidebars, forms, adverts,
notices, comments of readers) weigh next to nothing and are left out of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import decode, slices, text_bytes

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set(
    "head title script style noscript template svg math iframe object canvas nav header footer "
    "aside form button select option textarea input dialog menu".split()
)
BLOCKS = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = set("div h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg|math"
#: Elements of the main text's own frame: what their class, id or role says does not hide them.
FRAME = set("html body main article".split())
#: A whole name in class, id or role that marks what is not main text: a word, or
#: words of which one is of the first list and all others of either.
MARKING = (
    "ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|"
    "sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|comments?|disqus|repl(?:y|ies)|respond|"
    "cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|share|sharing|social|related|"
    "recommend(?:ed|ations)?|footer|header|masthead|widget|pagination|pager|toolbar|"
    "contentinfo|complementary|search|login|signup|alert"
)
NEUTRAL = (
    "site|page|global|main|primary|secondary|top|bottom|left|right|box|bar|list|links?|buttons?|"
    "slot|unit|form|items?|icons?|thread|posts|articles|stories|inner|outer|[0-9]+"
)
SIDE = re.compile(
    rf"(?:(?:{NEUTRAL})[_-]+)*(?:{MARKING})(?:[_-]+(?:{MARKING}|{NEUTRAL}))*", re.I
)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<void>svg|math)(?=[\s/>])(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?P<rawattrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Weights without labelled pages: words by the block that holds them, tags by name.
WORDS = {"p": 1.0, "h1": 1.0, "h2": 1.0, "h3": 1.0, "li": 0.5, "a": -1.0}
TAGS = {"p": -0.2, "h1": -0.2, "a": -1.5, "li": -0.5}
OTHER_WORD, OTHER_TAG = 0.5, -0.5
#: Side elements are left out in any case; they weigh little, so that an advert or a
#: form in the middle of an article does not cut it in two.
SIDE_WEIGHT = -0.02


class Piece:
    """A tag or a stretch of text with the element it lies in."""

    __slots__ = ("text", "kind", "breaks", "side")

    def __init__(self, text: str, kind: str, breaks: bool, side: bool):
        self.text, self.kind, self.breaks, self.side = text, kind, breaks, side


def is_side(name: str, attrs: str) -> bool:
    if name in HIDDEN:
        return True
    if not attrs or name in FRAME:
        return False
    names = (n for a, b, c in MARKS.findall(attrs) for n in (a or b or c).split())
    return any(map(SIDE.fullmatch, names))


def pieces(page: str) -> list[Piece]:
    """The page as tags (empty text) and texts, in page order."""
    out: list[Piece] = []
    stack: list[tuple[str, bool, str]] = []  # open element, lies in a side element, block that holds text
    open_: Counter[str] = Counter()  # open elements by name: no step searches the stack in vain
    at = 0

    def text(raw: str) -> None:
        if raw:
            _, side, holder = stack[-1] if stack else ("", False, "")
            out.append(Piece(html.unescape(raw), holder, False, side))

    def pop() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    def close(name: str) -> None:
        while pop() != name:
            pass

    for m in MARKUP.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or m["raw"] or m["void"] or "").lower()
        if not name:
            continue
        if m["raw"] or m["void"]:
            out.append(Piece("", name, name == "title", True))
            continue
        closing = bool(m["close"] or m["close2"])
        blocks = name in BLOCKS
        if closing:
            if open_[name]:
                out.append(Piece("", name, blocks, stack[-1][1]))
                close(name)
            continue
        if blocks and stack and stack[-1][0] == "p":
            pop()  # a block ends an open paragraph
        elif name in ENDS_PARAGRAPH and open_["p"]:
            close("p")
        if name == "li" and stack and stack[-1][0] == "li":
            pop()
        side = (stack[-1][1] if stack else False) or is_side(name, m["attrs"] or "")
        out.append(Piece("", name, blocks, side))
        if name not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            holder = name if blocks or name == "a" else stack[-1][2] if stack else ""
            stack.append((name, side, holder))
            open_[name] += 1
    text(page[at:])
    return out


def weigh(piece: Piece, weights: tuple[dict[str, float], dict[str, float]]) -> float:
    words, tags = weights
    if piece.side:
        return SIDE_WEIGHT * (len(piece.text.split()) or 1)
    if not piece.text:
        return tags.get(piece.kind, OTHER_TAG)
    return words.get(piece.kind, OTHER_WORD) * len(piece.text.split())


def content_region(found: list[Piece], weights) -> tuple[int, int]:
    """First and behind-last piece of the run with the highest sum (the first of equal ones)."""
    best, best_run, total, start = 0.0, (0, 0), 0.0, 0
    for i, piece in enumerate(found):
        if total <= 0:
            total, start = 0.0, i
        total += weigh(piece, weights)
        if total > best:
            best, best_run = total, (start, i + 1)
    return best_run


def main_text(page: str, weights=(WORDS, TAGS)) -> str:
    """Blocks of the content region, white space folded, joined by line feeds."""
    found = pieces(page)
    first, end = content_region(found, weights)
    blocks, block = [], []
    for piece in found[first:end]:
        if piece.breaks:
            blocks.append("".join(block))
            block = []
        elif piece.text:
            if not piece.side:
                block.append(piece.text)
        elif piece.kind == "br":
            block.append(" ")
    blocks.append("".join(block))
    folded = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in folded if b)


def fit(
    pages: DataFrame, max_pages: int = 2_000, id_col: str = "page_id", html_col: str = "html"
) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and tags from at most ``max_pages`` labelled pages.

    A page is labelled where its content region is known: the text of exactly one
    ``article`` element.  The pages are those with the smallest hash of the id.
    The article tags themselves get no weight, so pages without them score the
    same way.  Without labelled pages the fixed weights are returned.
    """
    sample = (
        pages.select(id_col, text_bytes(html_col).alias("html"), F.col(html_col).alias("page"))
        .filter(F.size(F.regexp_extract_all("page", F.lit(r"(?i)<article\b"), F.lit(0))) == 1)
        .select(F.xxhash64(id_col).alias("hash"), F.col(id_col).alias("id"), "html")
    )
    chosen = sample.select("hash", "id").orderBy("hash", "id").limit(max_pages)
    sample = sample.join(F.broadcast(chosen), ["hash", "id"], "left_semi").select("html")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for data in batch.column("html").to_pylist():
                inside = 0
                for piece in pieces(decode(data)):
                    if piece.kind == "article" and not piece.text:
                        inside = 1 - inside
                        continue
                    if piece.side:
                        continue
                    kind = "word" if piece.text else "tag"
                    counts[kind, piece.kind, inside] += len(piece.text.split()) or 1
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([k[0] for k in counts], pa.string()),
                    "name": pa.array([k[1] for k in counts], pa.string()),
                    "inside": pa.array([k[2] for k in counts], pa.int32()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                }
            )

    rows = (
        sample.mapInArrow(counted, "kind string, name string, inside int, n bigint")
        .groupBy("kind", "name")
        .agg(
            F.sum(F.when(F.col("inside") == 1, F.col("n")).otherwise(0)).alias("content"),
            F.sum(F.when(F.col("inside") == 0, F.col("n")).otherwise(0)).alias("rest"),
        )
        .orderBy(F.desc(F.col("content") + F.col("rest")), "kind", "name")
        .limit(500)
        .collect()
    )
    if not rows:
        return WORDS, TAGS
    words, tags = dict(WORDS), dict(TAGS)
    for r in rows:
        odds = math.log((r["content"] + 1) / (r["rest"] + 1))
        if r["kind"] == "word":
            # words of a kind that mostly is content score positive, else negative
            words[r["name"]] = max(-2.0, min(2.0, odds))
        else:
            # tags never score positive: they cost least where content uses them
            tags[r["name"]] = max(-6.0, min(-0.1, odds - 2.0))
    tags.pop("article", None)
    return words, tags


def extract(
    pages: DataFrame, weights=(WORDS, TAGS), id_col: str = "page_id", html_col: str = "html"
) -> DataFrame:
    """All columns of pages but the html, with ``text`` and ``n_chars`` (code points).

    The whole html is read.  A null or empty page, or one without content, gives
    an empty text.  Null and repeated ids are kept row by row.  Columns named like
    the results are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, text_bytes(html_col).alias("_html"))
    place = len(kept)
    ddl = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(decode(h), weights) for h in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:place],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=[*kept, "text", "n_chars"],
            )

    return rows.mapInArrow(extracted, ", ".join(filter(None, [ddl, "text string, n_chars bigint"])))
