"""Main text of web pages by templates deduced from token occurrence vectors of each host."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import attach, map_arrow, slices, texts_of, written
from .urls import host_and_path

#: A class of tokens is part of a template if it is on at least this share of the pages of a host, and on so many.
SHARE, LEAST_PAGES = 0.5, 3
#: Text inside an article counts as template only on hosts with so many pages, nearly all of which have it.
FIXED_SHARE, FIXED_PAGES = 0.9, 20
#: Templates up to this size in all are broadcast; beyond that pages meet theirs in a join.
MOST_TEMPLATE_BYTES = 32 << 20

# fixed values: names of HTML elements and of page parts
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | INLINE | frozenset("p li dt dd td th tr ul ol dl blockquote pre".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
    "section table ul".split()
)
CONTENT = frozenset("article main".split())
OTHER_PARTS = frozenset(
    "head nav header footer aside form button select option label menu dialog svg canvas object audio video map".split()
) | RAW
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar "
    "navigation breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments "
    "commentlist disqus reply replies discussion respond footer header masthead topbar toolbar search pagination pager "
    "copyright legal disclaimer hidden skip".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry post story main maincontent".split())


@lru_cache(maxsize=50_000)
def label(name: str, attributes: str) -> str:
    """An element with its classes, id and role: tokens that differ in these differ in their part of a page."""
    found = {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = sorted({*found.get("class", "").split(), *found.get("id", "").split(), *found.get("role", "").split(), *found.get("itemprop", "").split()})
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""))
    return ".".join([name, *names, *(["hidden"] if hidden else [])])


@lru_cache(maxsize=50_000)
def part(of: str) -> str:
    """What an element is by its names: ``other`` parts of a page, ``content``, or nothing special."""
    name, *names = of.split(".")
    words = {word for one in names for word in re.split(r"[-_\d]+|(?<=[a-z])(?=[A-Z])", one)}
    words = {word.lower() for word in words} | {one.lower() for one in names}
    if name in OTHER_PARTS or (words & OTHER_NAMES and name not in {"html", "body"} and name not in CONTENT):
        return "other"
    return "content" if name in CONTENT or words & CONTENT_NAMES else ""


@dataclass
class Page:
    """Tokens of a page with their counts, and its blocks of text with the elements around them."""

    tokens: Counter = field(default_factory=Counter)
    blocks: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Tags as tokens; text as blocks. Missing and stray end tags are put up with."""
    page, stack, at = Page(), [], 0
    pieces: list[str] = []
    where: tuple[str, ...] = ()
    begun = False

    def flush() -> None:
        nonlocal pieces, begun
        text = " ".join("".join(pieces).split())
        if text:
            page.blocks.append((text, where))
        pieces, begun = [], False

    def close(down_to: int) -> None:
        for of in reversed(stack[down_to:]):
            page.tokens["/" + of] += 1
        del stack[down_to:]

    def text(piece: str) -> None:
        nonlocal where, begun
        if piece:
            piece = html.unescape(piece)
            if not begun and piece.strip():
                where, begun = tuple(stack), True
            pieces.append(piece)

    names = lambda: [of.split(".", 1)[0] for of in stack]
    while True:
        met = TAG.search(source, at)
        text(source[at : met.start() if met else len(source)])
        if not met:
            break
        at = met.end()
        ends, name, rest = met.group(1), met.group(2), met.group(3)
        if name is None:
            ends, name, rest = met.group(4), met.group(5), met.group(6)
        if name is None:
            if met.group().startswith("<![CDATA["):
                text(html.escape(met.group()[9:-3]))
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name in ("br", "wbr"):
            text(" " if name == "br" else "")
        if ends:
            open_ = names()
            if name in open_:
                close(len(open_) - 1 - open_[::-1].index(name))
            continue
        if name in CLOSES or name in ENDS_PARAGRAPH:
            open_ = names()
            closed = CLOSES.get(name, {"p"}) | ({"p"} if name in ENDS_PARAGRAPH else set())
            last = next((i for i in range(len(open_) - 1, -1, -1) if open_[i] not in INLINE), None)
            while last is not None and open_[last] in closed:
                close(last)
                open_ = names()
                last = next((i for i in range(len(open_) - 1, -1, -1) if open_[i] not in INLINE), None)
        of = label(name, rest.rstrip("/"))
        page.tokens[of] += 1
        if name in RAW:
            end = re.compile(f"</{name}[^>]*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            page.tokens["/" + of] += 1
        elif name not in VOID and not (rest.endswith("/") and name not in INLINE | ENDS_PARAGRAPH):
            stack.append(of)
    flush()
    return page


def text_token(text: str) -> str:
    """A text as a token: a long one is the hash of all of it, after a line feed, which no block of text has."""
    return "=" + (text if len(text) <= 80 else "\n" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest())


@dataclass(frozen=True)
class Template:
    """Template of a host: classes of tokens, by token, and texts that its pages share."""

    classes: dict[str, str]
    shared: frozenset[str]
    fixed: frozenset[str]

    def holds(self, of: str) -> bool:
        """Start and end of an element that can hold blocks are tokens of one class: what is between them is a slot."""
        if of.split(".", 1)[0] in LEAVES:
            return False
        return of in self.classes and self.classes.get("/" + of) == self.classes[of]


NO_TEMPLATE = Template({}, frozenset(), frozenset())


def extract(page: Page, template: Template) -> str:
    """Blocks of the main slots, joined by line feeds.

    Blocks nest in the innermost template element around them. Blocks in other parts of the page, and texts that belong
    to the template, go. If any block is inside a content element, only such blocks stay; else those of the template
    element that holds most text.
    """
    kept: list[tuple[str, bool, tuple[str, ...]]] = []
    for text, around in page.blocks:
        inner = [at for at, of in enumerate(around) if of.split(".", 1)[0] in CONTENT]
        parts = [part(of) for of in around[inner[0] :]] if inner else [part(of) for of in around]
        content = "content" in parts
        if inner and around[-1].split(".", 1)[0] in HEADINGS:  # an article may have its heading in a header
            parts = [p for p, of in zip(parts, around[inner[0] :]) if not of.startswith("header")]
        token = text_token(text)
        if "other" in parts or token in template.fixed or (not content and token in template.shared):
            continue
        holder = next((around[: at + 1] for at in range(len(around) - 1, -1, -1) if template.holds(around[at])), ())
        kept.append((text, content, holder))
    if any(content for _, content, _ in kept):
        return "\n".join(text for text, content, _ in kept if content)
    sizes: dict[tuple[str, ...], int] = defaultdict(int)
    for text, _, holder in kept:
        sizes[holder] += len(text)
    main = max(sizes, key=lambda holder: sizes[holder], default=())
    return "\n".join(text for text, _, holder in kept if holder[: len(main)] == main)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, tokens) of each page, with how often it has each token; the empty token stands for the page itself."""
    for rows in slices(batches, "html"):
        tokens: list[str] = []
        counts: list[int] = []
        ends = [0]
        for source in texts_of(rows, "html"):
            page = parse(source)
            found = page.tokens + Counter(text_token(text) for text, _ in page.blocks)
            tokens.extend(["", *found])
            counts.extend([1, *found.values()])
            ends.append(len(tokens))
        pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int32())], ["token", "n"])
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([rows.column("host"), rows.column("page"), held], ["host", "page", "tokens"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, tokens) from (host, page, html): tokens of valid classes, each with class, pages and kind.

    Rows of a host with the same `page` count once: only their tokens meet, not their HTML.
    The vector of a token over the pages of its host is held as two sums of hashes of page and count, so vectors of any
    length are compared as two numbers and are built up before the shuffle. Tokens with equal vectors form a class. A
    class is valid if it is on enough pages and has two tokens or more; texts need no partner.
    """
    kinds = "host string, page long, tokens array<struct<token string, n int>>"
    tokens = map_arrow(pages.select("host", "page", "html"), _tokens, kinds)
    tokens = tokens.groupBy("host", "page").agg(F.first("tokens").alias("tokens")).select("host", "page", F.inline("tokens"))
    vectors = tokens.groupBy("host", "token").agg(
        F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("x"),
        F.sum(F.xxhash64("n", "page").cast("decimal(38,0)")).alias("y"),
    )
    vectors = vectors.filter((F.col("on") >= LEAST_PAGES) | (F.col("token") == ""))
    hosts = vectors.filter("token = ''").select(F.col("host").alias("_host"), F.col("on").alias("pages"))
    vectors = vectors.filter("token != ''").join(hosts, F.col("host") == F.col("_host")).filter(F.col("on") >= SHARE * F.col("pages"))
    vector = F.concat_ws("/", "x", "y")
    return vectors.groupBy("host", "pages").agg(F.collect_list(F.struct("token", vector.alias("vector"), "on")).alias("tokens"))


def template_of(pages: int, tokens: list) -> Template:
    by_vector = defaultdict(list)
    for token, vector, _ in tokens:
        if not token.startswith("="):
            by_vector[vector].append(token)
    classes = {token: vector for vector, held in by_vector.items() if len(held) > 1 for token in held}
    shared = frozenset(token for token, _, _ in tokens if token.startswith("="))
    fixed = frozenset(
        token for token, _, on in tokens if token.startswith("=") and pages >= FIXED_PAGES and on >= FIXED_SHARE * pages
    )
    return Template(classes, shared, fixed)


def _extracted(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = {host: template_of(pages, tokens) for host, pages, tokens in shared.value} if shared else {}
    for rows in slices(batches, "_html"):
        if shared:
            chosen = [known.get(host, NO_TEMPLATE) for host in rows.column("_host").to_pylist()]
        else:
            held = zip(rows.column("_pages").to_pylist(), rows.column("_tokens").to_pylist())
            chosen = [template_of(n, [tuple(t.values()) for t in tokens]) if tokens else NO_TEMPLATE for n, tokens in held]
        texts = [extract(parse(source), template) for source, template in zip(texts_of(rows, "_html"), chosen)]
        passed = [c for c in rows.schema.names if not c.startswith("_")]
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in passed), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*passed, "text", "n_chars"],
        )


def main_texts(
    df: DataFrame, url_column: str = "url", html_column: str = "html", most_bytes: int = MOST_TEMPLATE_BYTES
) -> DataFrame:
    """Every page with `text`, the main text of its whole HTML, and `n_chars`, its code points.

    Templates are deduced per host in one aggregation. Their size is measured: up to `most_bytes` they are broadcast,
    beyond that each page meets its template in a join in which pages of large hosts are spread.

    Missing and empty HTML give an empty text. Pages without a host (a missing URL) share the template of the empty
    host. Rows of a host with equal HTML, also under different URLs, count as one page. A host with fewer than three
    different pages has no template; its pages are read by their elements alone. Very long pages need no special care; an empty table gives an empty table.
    Columns `text` and `n_chars` of the input are replaced.
    """
    added = ("text", "n_chars")
    passed = [c for c in df.columns if c not in added]
    host, _ = host_and_path(F.col(url_column))
    source = F.col(f"`{html_column}`")
    pages = df.select(host.alias("host"), F.xxhash64(F.coalesce(source, F.lit(""))).alias("page"), source.alias("html"))
    found = templates(pages)
    frame = df.select(*(F.col(f"`{c}`") for c in passed), host.alias("_host"), source.alias("_html"))
    schema = T.StructType([
        *frame.drop("_host", "_html").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())
    ])
    found = written(found, "templates")
    size = found.select(F.sum(F.octet_length(F.to_json("tokens")) + F.octet_length("host"))).first()[0] or 0
    if size <= most_bytes:
        rows = [(r["host"], r["pages"], [tuple(t) for t in r["tokens"]]) for r in found.collect()]
        return map_arrow(frame, partial(_extracted, df.sparkSession.sparkContext.broadcast(rows)), schema)
    table = found.select(F.col("host").alias("_host"), F.col("pages").alias("_pages"), F.col("tokens").alias("_tokens"))
    met = attach(frame, table, "_host", "_pages", max(1, df.count()), "_html")
    return map_arrow(met, partial(_extracted, None), schema)
