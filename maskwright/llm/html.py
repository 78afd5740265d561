"""Main text of web pages: host suffix arrays, and page structure where markup says what a block is.

A page is cut into blocks. Markup settles a block that lies in an article or main element (it stays) or in a menu,
header, footer, sidebar, form, notice, advert, comment list and the like (it goes). All other blocks are open, and
so are blocks of an article with a mark that may be its own (``legal``, or a class such as ``legal-analysis`` that merely
contains a telling word): these are judged by repetition. The token streams of a batch of whole pages, articles behind all else, are
concatenated and their suffixes sorted by prefix doubling up to ``RUN`` tokens; neighbours of equal rank share at
least so many tokens. A token lies in a repeated run of ``RUN`` or more tokens just if a window of ``RUN`` tokens
around it is repeated, so classes of equal ranks say all about runs of any length. Each batch gives one row for each
class with the pages it occurs on, and Spark counts the distinct pages of a class over all batches, so that no host,
however large, meets in one task. Open blocks lose the tokens covered by runs that at least ``LEAST`` distinct pages
and the share ``SHARE`` of their host's pages hold; all else stays. Pages of equal text count as one, so copies of an
article do not make it boilerplate.

Defined results: a null html counts as empty and gives the empty text; a null or odd url counts as a host of its
own spelling; rows that repeat a page_id, or have none, are each judged by their own text; a page's repeated rows
count as one page for repetition; very long pages are read whole, nothing is cut short.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, take

#: Tokens that a repeated run must have.
RUN = 16
#: Pages whose streams make up one array.
BATCH = 2048
#: Distinct pages that must hold a run, and their share of the host's distinct pages.
LEAST, SHARE = 3, 0.5
MAIN, OPEN, BOILERPLATE = 0, 1, 2
RAW = "script|style|noscript|template|textarea|title|iframe|svg|annotation|annotation-xml|object|select|canvas|audio|video"
#: Of these, what takes the rest of the page where its end tag is missing; all others are then skipped tag by tag.
UNENDED = {"script", "style"}
DROPPED = set("nav header footer aside form button label fieldset legend dialog menu head".split())
KEPT = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = DROPPED | KEPT | set(
    "html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center hr".split()
)
HEADINGS = {f"h{k}" for k in range(1, 7)}
PARAGRAPHS = {"p", "li", *HEADINGS}
#: Parts of class, id and role names that mark what is not the article.
NAMES = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner sidebar menu nav navbar navigation "
    "footer header masthead breadcrumb breadcrumbs comment comments reply replies respond disqus newsletter subscribe subscription popup modal overlay share sharing "
    "social related recommended widget login signup search pagination pager toolbar copyright legal disclaimer contentinfo complementary alert".split()
)
#: Of these, names that may well be part of an article when they stand in one: repetition decides there.
SOFT = set("header masthead search notice notices banner footer copyright legal disclaimer alert contentinfo complementary promotion".split())
#: Names of readers' comments, which often are article elements themselves.
COMMENTS = set("comment comments reply replies respond disqus".split())
#: Elements whose end tag may be left out: what a new one closes, and how far out it looks.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), **{n: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for n in ("thead", "tbody", "tfoot")},
}
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
ENDS = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW.split("|")}
COMMENT_END = re.compile(r"--!?>")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
PARTS = re.compile(r"[a-z0-9]+")
SURE, DOUBTFUL, SURE_SOFT, COMMENT = 3, 1, 2, 4


def _mark(attributes: str) -> int:
    """The most telling of the names of class, id and role: of readers' comments, SURE, SURE_SOFT (one of ``SOFT``), or
    DOUBTFUL (it only contains such a word)."""
    found = 0
    # names like data-id, and what stands in another attribute's value, tell nothing
    for own, a, b, c in ATTRIBUTE.findall(attributes) if MARKS.search(attributes) else ():
        if own.lower() not in ("class", "id", "role"):
            continue
        for name in (a or b or c).lower().split():
            whole = name if name in NAMES else name.replace("_", "-")
            if whole in NAMES:
                found = max(found, COMMENT if whole in COMMENTS else SURE_SOFT if whole in SOFT else SURE)
            elif not NAMES.isdisjoint(PARTS.findall(name)):
                found = max(found, DOUBTFUL)
    return found


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; without a name what is skipped whole: comments, declarations,
    scripts and the like. Each character is looked at a bounded number of times, also in broken pages."""
    last = page.rfind(">")
    gone: dict[str, int] = {}  # quote, or name of an end tag: no further one from here on
    at = page.find("<")
    while at >= 0:
        end, name, attributes = -1, "", ""
        m = NAME.match(page, at)
        if page.startswith(("<!-->", "<!--->"), at):
            end = page.find(">", at) + 1
        elif page.startswith("<!--", at):
            close = COMMENT_END.search(page, at + 4)
            end = close.end() if close else len(page)
        elif at > last:
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
        elif m:
            name, closing = m[1].lower(), page[at + 1] == "/"
            if name in ENDS and not closing:
                first = page.find(">", m.end())
                alone = name == "svg" and page[first - 1] == "/"
                close = None if alone or name in gone else ENDS[name].search(page, first + 1)
                if not close and not alone:
                    gone[name] = at
                end = close.end() if close else len(page) if name in UNENDED else _tag_end(page, m.end(), gone)
                name = ""
            else:
                end = _tag_end(page, m.end(), gone)
                attributes = page[m.end() : end - 1]
        if end > 0:
            yield at, end, name, page[at + 1] == "/", attributes
            at = page.find("<", end)
        else:
            at = page.find("<", at + 1)


def _tag_end(page: str, at: int, gone: dict[str, int]) -> int:
    """Behind the first > outside quotes; where a quote stays open, behind the first one at all."""
    first = page.find(">", at)
    end, begin = first, at
    while True:
        quotes = [q for q in (page.find('"', begin, end), page.find("'", begin, end)) if q >= 0]
        if not quotes:
            return end + 1
        quote = page[min(quotes)]
        after = -1 if min(quotes) + 1 >= gone.get(quote, len(page) + 1) else page.find(quote, min(quotes) + 1)
        if after < 0:
            gone[quote] = min(gone.get(quote, len(page) + 1), min(quotes) + 1)
            return first + 1
        begin = after + 1
        if begin > end:
            end = page.find(">", begin)
            if end < 0:
                return first + 1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each non-empty block in page order, entities decoded and white space collapsed."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    depth, own = 0, OPEN  # of the block's outermost text: a marked inline element says nothing about the text around it
    paragraph = -1  # open elements outside the paragraph or heading at hand
    stack: list[tuple[str, int, bool]] = []  # open elements that matter: name, kind inside, readers' comments
    count: Counter[str] = Counter()
    kind, at, page = OPEN, 0, page or ""
    heading = False

    def add(part: str) -> None:
        nonlocal depth, own
        if len(stack) < depth or (not text and not part.isspace()):
            depth, own = len(stack), kind
        if text or not part.isspace():
            text.append(part)

    def close_block() -> None:
        nonlocal depth, own
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            own = kind if len(stack) <= depth else own
            if whole:
                out.append((own if not (own == -1) else (MAIN if heading else BOILERPLATE), whole))
            text.clear()

    def pop() -> str:
        nonlocal paragraph
        name = stack.pop()[0]
        count[name] -= 1
        paragraph = paragraph if paragraph <= len(stack) else -1
        return name

    for start, end, name, closing, attributes in tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if name in VOID:
            if name == "hr":
                close_block()
            else:
                if name == "br":
                    add(" ")
            continue
        marked = _mark(attributes) if not closing and attributes and name not in ("html", "body") else 0
        if name in BLOCKS:
            close_block()
            if name in HEADINGS:
                heading = not closing
            if not closing and stack and stack[-1][0] == "head":  # its end tag may be left out
                pop()
                kind = stack[-1][1] if stack else OPEN
            if name in PARAGRAPHS:
                # inline elements left open end with their paragraph
                while 0 <= paragraph < len(stack) and stack[-1][0] not in BLOCKS:
                    pop()
                    kind = stack[-1][1] if stack else OPEN
                paragraph = -1 if closing else len(stack)
            elif not closing:
                paragraph = -1
        elif not marked and not count[name]:
            continue
        if closing:
            if count[name]:
                while pop() != name:
                    pass
                kind = stack[-1][1] if stack else OPEN
        else:
            if stack and stack[-1][0] == "p" and name in BLOCKS:  # a paragraph ends where the next block starts
                pop()
            closes, bounds = CLOSES.get(name, ((), ()))
            if any(count[n] for n in closes):
                outermost = len(stack)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in bounds:
                        break
                    if stack[k][0] in closes:
                        outermost = k
                while len(stack) > outermost:
                    pop()
            kind = stack[-1][1] if stack else OPEN
            comments = marked == COMMENT or bool(stack and stack[-1][2])
            within = any(count[n] for n in KEPT)
            inside = kind
            if name in KEPT and kind == BOILERPLATE:
                # a wrapper's class, or a form around the page, says nothing about the article in it; articles inside an article's
                # marked parts, and those of readers, stay out
                if not comments and not within and not any(count[n] for n in DROPPED - {"form"}):
                    inside = MAIN
            elif kind != BOILERPLATE:
                if name == "header" and kind in (MAIN, -1):
                    inside = -1  # of an article's header the headings stay
                elif marked in (DOUBTFUL, SURE_SOFT) and (kind == MAIN or within) and name not in DROPPED:
                    inside = OPEN  # repetition decides
                elif name in KEPT:
                    inside = BOILERPLATE if comments else OPEN if marked in (SURE, SURE_SOFT) else MAIN
                elif name in DROPPED or marked:
                    inside = BOILERPLATE
            if name not in PARAGRAPHS or inside != kind or comments:
                stack.append((name, inside, comments))
                count[name] += 1
                kind = inside
    if at < len(page):
        add(page[at:])
    close_block()
    return out


def _codes(tokens: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seen: dict[str, int] = {}
    return np.fromiter((seen[t] if t in seen else seen.setdefault(t, xxh64_intdigest(t)) for t in tokens), np.uint64, len(tokens))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of RUN tokens."""
    n = len(codes) - RUN + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(RUN if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        h ^= h >> np.uint64(29)
    return h


def suffix_classes(codes: np.ndarray) -> np.ndarray:
    """Rank of each position's suffix by its first RUN tokens; equal ranks share them. Prefix doubling; a stream's
    end is filled with codes that match nothing."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < RUN:
        step = min(width, RUN - width)
        ahead = np.concatenate([rank[step:], -1 - np.arange(step, dtype=np.int64)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + step) + ahead + step, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


def _streams(page: str | None) -> tuple[list[tuple[int, str]], list[str], list[bool], list[str]]:
    """Blocks of a page, the tokens outside its article, which of them lie in open blocks, and the tokens of the article."""
    found = blocks(page)
    tokens, still, article = [], [], []
    for kind, text in found:
        own = text.split(" ")
        if kind == MAIN:
            article += own
        else:
            tokens += own
            still += [kind == OPEN] * len(own)
    return found, tokens, still, article


def _host(column: str):
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(column, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit("")), F.col(column), F.lit("")))


def runs(pages: DataFrame, articles: bool = False) -> DataFrame:
    """(host, run, pages, page, at, print): a row for each class of equal suffixes of a batch (pages: id and print), for
    each window of open blocks (page, at, print), and for each page (page, print: a hash of its text).

    Suffixes are those of whole pages, first what lies outside the article and then the article. Classes that lie in articles
    alone are many, and count only on hosts with open blocks: with ``articles`` just these are given.
    """
    pair = pa.struct([("page", pa.int64()), ("print", pa.int64())])
    names = ["host", "run", "pages", "page", "at", "print"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in parts:
            for first in range(0, whole.num_rows, BATCH):
                b = whole.slice(first, BATCH)
                hosts, numbers = b.column(1).to_pylist(), b.column(0).to_pylist()
                codes, piece, still, prints = [], [], [], []
                for k, text in enumerate(b.column(2).to_pylist()):
                    found, tokens, own, article = _streams(text)
                    prints.append(xxh64_intdigest("\n".join(t for _, t in found).encode("utf-8", "surrogatepass")))  # as _print
                    for i, part in enumerate((tokens, article)):
                        if len(part) >= RUN:
                            codes += [_codes(part), np.array([2 * k + i], np.uint64)]
                            piece.append(np.full(len(part) + 1, 2 * k + i))
                            still.append(np.zeros(len(part) + 1, bool) if i else np.array([*own, False]))
                prints = np.array(prints, np.uint64).view(np.int64)
                k = len(prints)
                if not articles:
                    yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pair)), pa.array(numbers, pa.int64()), pa.nulls(k, pa.int32()), pa.array(prints)], names=names)
                if not codes:
                    continue
                stream, piece_of, open_of = map(np.concatenate, (codes, piece, still))
                window = _hashes(stream)
                n = len(window)
                if not n:
                    continue
                page_of = piece_of // 2
                inside = piece_of[:n] == piece_of[RUN - 1 :][:n]
                ends = np.flatnonzero(np.append(np.diff(piece_of) != 0, True))  # the separator of each page and each article
                inside &= ends[np.searchsorted(ends, np.arange(n))] >= np.arange(n) + RUN
                rank = suffix_classes(stream)[:n]
                host_id = np.unique(np.array([h or "" for h in hosts], object), return_inverse=True)[1][page_of[:n]]
                at = np.flatnonzero(inside)
                order = at[np.lexsort((rank[at], host_id[at]))]
                if not len(order):
                    continue
                new = np.append(True, (np.diff(rank[order]) != 0) | (np.diff(host_id[order]) != 0))
                within = np.minimum.reduceat(piece_of[order] % 2, np.flatnonzero(new)) == 1  # classes in articles alone
                own = (within == articles)[np.cumsum(new) - 1]
                order, new = order[own], new[own]
                starts = np.flatnonzero(new)
                if not len(order):
                    continue
                lead = order[starts]
                of = page_of[order]
                once = np.unique(np.stack([np.cumsum(new) - 1, of], axis=1), axis=0)  # (class, page), each once
                offsets = np.searchsorted(once[:, 0], np.arange(len(starts) + 1)).astype(np.int32)
                both = pa.StructArray.from_arrays([pa.array(np.array(numbers, np.int64)[once[:, 1]]), pa.array(prints[once[:, 1]])], fields=list(pair))
                k = len(lead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hosts[k] for k in page_of[lead]]), pa.array(window[lead].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), both, type=pa.list_(pair)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())],
                    names=names,
                )
                begin = np.searchsorted(page_of, np.arange(len(hosts)))
                opens = np.append(0, np.cumsum(open_of))
                want = at[opens[at + RUN] > opens[at]]
                if len(want) and not articles:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([hosts[k] for k in page_of[want]]), pa.array(window[want].view(np.int64)), pa.nulls(len(want), pa.list_(pair)),
                         pa.array(np.array(numbers, np.int64)[page_of[want]]), pa.array((want - begin[page_of[want]]).astype(np.int32)), pa.array(prints[page_of[want]])],
                        names=names,
                    )

    rows = pages.select("page", "host", "html")
    return rows.mapInArrow(run, "host string, run long, pages array<struct<page:long,print:long>>, page long, at int, print long")


def assemble(page: str | None, covered: list[int] | None) -> str:
    """Main blocks, and of open blocks the tokens outside covered windows, joined by newlines."""
    found, tokens, still, _ = _streams(page)
    if not any(still):
        return "\n".join([t for kind, t in found if kind == MAIN])
    gone = np.zeros(len(tokens), bool)
    for at in covered or ():
        gone[at : at + RUN] = True
    out, at = [], 0
    for kind, text in found:
        if kind == MAIN:
            out.append(text)
            continue
        own = text.split(" ")
        if kind == OPEN:
            left = [t for t, g in zip(own, gone[at : at + len(own)]) if not g]
            if left:
                out.append(" ".join(left))
        at += len(own)
    return "\n".join(out)


def _print(page: str | None) -> int:
    """A hash of a page's text, as a signed number."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest("\n".join(t for _, t in blocks(page)).encode("utf-8", "surrogatepass"))).view(np.int64))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    pages = take(df, page_id=id_col, url=url_col, html=html_col).withColumn("host", _host("url"))
    pages = pages.withColumn("page", F.coalesce(F.col("page_id").cast("long"), F.xxhash64("page_id", "url", "html")))
    found = stored(runs(pages), "runs")
    wanted = found.where(F.col("at").isNotNull()).select("host", "run", "page", "at", "print")
    distinct = F.least(F.count_distinct("page"), F.count_distinct("print"))
    sizes = found.where(F.col("print").isNotNull() & F.col("at").isNull()).groupBy("host").agg(distinct.alias("all"))
    held = found.where(F.col("pages").isNotNull()).select("host", "run", "pages").join(wanted.select("host", "run").distinct(), ["host", "run"], "left_semi")
    if not wanted.isEmpty():
        opened = pages.join(wanted.select("host").distinct(), "host", "left_semi")
        more = runs(opened, articles=True).select("host", "run", "pages")
        held = held.unionByName(more.join(wanted.select("host", "run").distinct(), ["host", "run"], "left_semi"))
    held = held.select("host", "run", F.inline("pages")).groupBy("host", "run").agg(distinct.alias("held")).where(F.col("held") >= LEAST)
    repeated = held.join(sizes, "host").where(F.col("held") >= SHARE * F.col("all"))
    covered = wanted.join(repeated, ["host", "run"], "left_semi").groupBy(F.col("page").alias("p"), F.col("host").alias("h")).agg(
        F.collect_set(F.struct("print", "at")).alias("covered")
    )
    if wanted.isEmpty():
        pages = pages.withColumn("covered", F.lit(None).cast("array<struct<print:long,at:int>>"))
    else:
        pages = pages.join(covered, (pages["page"] == F.col("p")) & (pages["host"] == F.col("h")), "left")
    pages = pages.select("page_id", "url", "html", "covered")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = []
            for page, covered in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = _print(page) if covered else 0  # rows that share a page_id have each their own runs
                texts.append(assemble(page, [c["at"] for c in covered or () if c["print"] == own]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, text string")
