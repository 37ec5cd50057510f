"""Main text of web pages with a suffix array per host.

A page is cut into blocks of text with their place in the page: inside an article (or
main) element, inside something that is never article text by its element or class
(navigation, header, footer, sidebar, form, advert, comments), or open. A form around the
whole page marks nothing. Marks by class are of two kinds. A class that is such a word
("sidebar") marks what it encloses; one that only has it as a part ("with-sidebar",
"page-header-wrap") may as well name the frame of a whole page, so what it encloses counts as
marked only where the page has other text to show, and is open otherwise, for the suffix array
to decide. An article or main element inside either kind of frame is the article; only
inside navigation, headers, footers and the like, or in a reader's comment, it is not. In an
article a part of a class name marks no paragraph, heading, figure or quotation, and the
headings of a header stay.

The blocks outside the article go, as token streams, into one suffix array per host:
streams are concatenated with separators of their own, suffixes are sorted by prefix
doubling up to the least run length, and equal neighbours that come from two distinct
pages or more make repeated runs. Tokens under such runs inside a block are boilerplate and
are removed, and so are blocks that repeated runs across blocks cover as a whole (menus of
short entries); of an open block the unique runs stay.

What is left decides where the main text is. A page without an article has its open unique
runs. A page with one has the article alone, unless the open unique runs have more words
than the article: then it is a teaser, and both stay in page order.

Articles repeat too: as copies, and by passages that many of them share, or that stand in
an advert or footer elsewhere. So a run inside an article is no boilerplate for being
repeated, and an article's own text stays whole.

A host is dealt by a hash of page_id into shards of a bounded number of pages and
characters, each with a suffix array of its own, so a host with a third of all pages is
many small arrays. Runs that repeat across shards are found over the whole host: hashes
of all windows of the least run length are aggregated to the least and the greatest
page, and the repeated ones go to the shards whose pages ask for them. Only hosts of more
than one shard that have open blocks do so, since nothing else depends on runs. Each page
moves once, as extracted blocks, so its text depends on the host's pages and not on how they
are dealt.

Defined results: a null or empty html gives the empty text; a null url counts as one
host, and its shards are bounded too; repeated rows give repeated results and do not make each other's
text boilerplate (pages are distinct by page_id), nor do copies, pages whose open blocks and article
are equal; a page cut off inside a tag or a comment ends there, and a quote that
is never closed ends with its tag; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, read_table

#: Tokens that a repeated run has at least.
MIN_RUN = 5
SHARD_PAGES, SHARD_CHARS = 256, 8_000_000
#: Hosts with more than one shard go to the executors as a list while there are no more than these.
MOST_HOSTS = 200_000

SCHEMA = "page_id long, url string, text string, n_chars long"

OPEN, ARTICLE, MARKED = 0, 1, 2
#: While a page is read: a form; what a part of a class name marks; what a whole class does; the header of an article.
FORM, WEAK, STRONG, HEADER = 3, 4, 5, 6

# HTML elements by how they bear on text.
RAW = frozenset("script style noscript template iframe object svg math textarea select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("nav header footer aside dialog menu button".split())
MAIN = frozenset("article main".split())
# Words in class or id that mark what is no article text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo banner cookie cookies consent notice notices"
    " alert nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related"
    " share sharing social newsletter subscribe subscription popup modal comment comments disqus reply replies"
    " form login signup search pagination pager toolbar skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of an article that a part of a class name does not mark.
CONTENT = HEADINGS | frozenset("p blockquote figure figcaption pre table ul ol li dl".split())
#: Elements that an end tag or the start of a sibling closes without an end tag of their own.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre section table ul".split()
)

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
#: What marks an article element as a reader's comment.
COMMENT = re.compile(r"(?:^|\s)(?:(?:comment|reply)(?:[-_]\S*)?|comments|replies|disqus)(?=\s|$)", re.IGNORECASE)
QUOTE = re.compile(r"[\"'>]")


def mark_of(attributes: str) -> int:
    """STRONG if a class, id or role is a word for what is no article text, WEAK if one has such a word as a part, else OPEN."""
    out = OPEN
    for m in MARKS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if name in HINTS:
                return STRONG
            if out == OPEN and any(w in HINTS for w in WORD.findall(name)):
                out = WEAK
    return out


def a_comment(attributes: str) -> bool:
    """Whether class or id names a reader's comment."""
    return any(COMMENT.search(m[1] or m[2] or m[3] or "") for m in MARKS.finditer(attributes))


class TagEnds:
    """Where tags end in one page: at the first ">" outside quotes, or the first of all after a quote that is never closed."""

    def __init__(self, page: str):
        self.page, self.open = page, {}

    def after(self, at: int) -> int:
        """The position of the tag's ">" from at on; -1 if there is none."""
        page, start = self.page, at
        while m := QUOTE.search(page, at):
            if m[0] == ">":
                return m.start()
            if m.start() >= self.open.get(m[0], len(page)):
                break  # such a quote is never closed from here on
            close = page.find(m[0], m.end())
            if close < 0:
                self.open[m[0]] = m.start()
                break
            at = close + 1
        return page.find(">", start)


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block with text, in page order; white space inside is one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    # Open elements with the place of their content, and how many there are of each name.
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    place, ends = OPEN, TagEnds(page)

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((place, text))
            parts.clear()

    def close(k: int) -> int:
        for name, _ in stack[k:]:
            held[name] -= 1
        del stack[k:]
        return stack[-1][1] if stack else OPEN

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        name = m[2]
        if not name:
            stop = page.find("-->" if m[0] == "<!--" else ">", m.end())
            if stop < 0:
                break
            at = stop + (3 if m[0] == "<!--" else 1)
            continue
        stop = ends.after(m.end())
        if stop < 0:  # the page ends inside a tag
            break
        at, name, attributes = stop + 1, name.lower(), page[m.end() : stop]
        if m[1]:
            if name not in INLINE:
                flush()
            if held[name]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                place = close(k)
            continue
        if name in RAW:
            if name == "head":
                # Its elements are raw or void; what is left of it has no text.
                continue
            flush()
            if attributes.rstrip().endswith("/") and name in ("svg", "math"):
                continue
            found = RAW_ENDS[name].search(page, at)
            at = found.end() if found else end
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            own = "p" if name in CLOSES_P else name
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == own:
                    place = close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        inner = place
        if place != MARKED:
            mark = mark_of(attributes) if attributes and name not in ("html", "body", "form") else OPEN
            if name in MAIN:
                inner = MARKED if attributes and a_comment(attributes) else ARTICLE
            elif attributes and a_comment(attributes):
                inner = MARKED
            elif name == "header" and place == ARTICLE and mark != STRONG:
                inner = HEADER
            elif name in NEVER:
                inner = MARKED
            elif name in HEADINGS and place == HEADER:
                inner = ARTICLE
            elif mark == STRONG or mark == WEAK and place == ARTICLE and name not in CONTENT:
                inner = STRONG
            elif mark == WEAK and place in (OPEN, FORM):
                inner = WEAK
            elif name == "form":
                inner = FORM if place in (OPEN, FORM, WEAK) else STRONG
        if name not in INLINE or inner != place:
            if inner != place:
                flush()
            stack.append((name, inner))
            held[name] += 1
            place = inner
    flush()
    # A page whose text is all inside a form is open; other forms are marked. The same holds for frames that a part of a class name marks.
    found = {p for p, _ in out}
    as_open = {k for k, others in ((FORM, {OPEN, ARTICLE, WEAK}), (WEAK, {OPEN, ARTICLE})) if not found & others}
    return [(p if p in (OPEN, ARTICLE) else OPEN if p in as_open else MARKED, t) for p, t in out]


RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


# ---- suffix array ----


def suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first depth' >= depth tokens, depth' a power of two, by prefix doubling."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, length, n = rank.astype(np.int64), 1, len(tokens)
    while length < depth:
        later = np.full(n, -1, dtype=np.int64)
        step = min(length, depth - length)
        later[: n - step] = rank[step:]
        _, rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)
        rank, length = rank.astype(np.int64), length + step
    return np.argsort(rank, kind="stable"), rank


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, least: int = MIN_RUN, content: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of at least so many tokens that stands on two distinct pages.

    tokens holds a separator, equal to no other token, after each stream; page is
    the page of each position. content: a number of each position's page that equal
    pages share, if pages with one content count as one.
    """
    n = len(tokens)
    out = np.zeros(n, dtype=bool)
    if n < least:
        return out
    order, rank = suffix_ranks(tokens, least)
    sorted_rank = rank[order]
    starts = np.flatnonzero(np.diff(sorted_rank, prepend=-1))
    low = np.minimum.reduceat(page[order], starts)
    high = np.maximum.reduceat(page[order], starts)
    group = np.cumsum(np.diff(sorted_rank, prepend=-1) != 0) - 1
    apart = low != high
    if content is not None:
        apart &= np.minimum.reduceat(content[order], starts) != np.maximum.reduceat(content[order], starts)
    hits = order[apart[group]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, np.minimum(hits + least, n), -1)
    return np.cumsum(cover[:n]) > 0


def windows_of(blocks: list[tuple[int, str]], host: str, least: int) -> tuple[list[list[int]], list[int]]:
    """Signed hashes of all runs of so many tokens outside the article: those inside each such block, and those of the blocks run together."""

    def runs(kind: bytes, words: list[bytes]) -> list[int]:
        head = kind + host.encode() + b"\0"
        return [xxhash.xxh64_intdigest(head + b" ".join(words[i : i + least])) - (1 << 63) for i in range(len(words) - least + 1)]

    cut = [text.encode().split(b" ") for place, text in blocks if place != ARTICLE]
    return [runs(b"w", x) for x in cut], runs(b"a", [w for x in cut for w in x])


def asks(blocks: list[tuple[int, str]]) -> bool:
    """Whether repeated runs bear on the page's text."""
    return any(place == OPEN for place, _ in blocks)


def content_of(blocks: list[tuple[int, str]]) -> int:
    """A signed number that pages with equal open blocks and article share."""
    text = "\n".join(f"{place}{t}" for place, t in blocks if place != MARKED)
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def n_words(block: tuple[int, str]) -> int:
    return block[1].count(" ") + 1 if block[1] else 0


def covered(starts: list[bool], n: int, least: int) -> np.ndarray:
    """Which of n tokens lie in a run that begins at one of the starts."""
    out = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(starts):
        out[i : i + least] = True
    return out


def shard_texts(pages: list[list[tuple[int, str]]], ids: list, least: int = MIN_RUN, known: frozenset[int] = frozenset(), host: str = "") -> list[str]:
    """The main text of each page of one shard of a host, from the pages' blocks; known: hashes of runs that repeat on the host."""
    number: dict[str, int] = {}
    tokens: list[int] = []
    owner: list[int] = []
    sizes: list[int] = []
    spans: list[tuple[int, int, int, int]] = []  # page, block, first token, one past the last
    distinct = {x: i for i, x in enumerate(dict.fromkeys(ids))}

    def separate() -> None:
        tokens.append(-1 - len(tokens))
        owner.append(distinct[ids[p]])

    for p, blocks in enumerate(pages):
        before = len(tokens)
        for b, (place, text) in enumerate(blocks):
            if place != ARTICLE:
                first = len(tokens)
                tokens += [number.setdefault(w, len(number)) for w in text.split(" ")]
                owner += [distinct[ids[p]]] * (len(tokens) - first)
                spans.append((p, b, first, len(tokens)))
                separate()
        separate()
        sizes.append(len(tokens) - before)
    content = np.repeat(np.array([content_of(x) for x in pages], dtype=np.int64), sizes)
    stream, page = np.array(tokens, dtype=np.int64), np.array(owner, dtype=np.int64)
    within = repeated_tokens(stream, page, least, content)
    # Once more with the blocks of a page run together: short blocks that repeat in a row go as wholes.
    held = np.ones(len(stream), dtype=bool)
    held[[last for *_, last in spans]] = False
    across = np.zeros(len(stream), dtype=bool)
    across[held] = repeated_tokens(stream[held], page[held], least, content[held])
    if known:
        at = 0
        for p, blocks in enumerate(pages):
            own = []
            while at < len(spans) and spans[at][0] == p:
                own.append(spans[at])
                at += 1
            if not asks(blocks):
                continue
            inside, together = windows_of(blocks, host, least)
            for (*_, first, last), hashes in zip(own, inside, strict=True):
                within[first:last] |= covered([h in known for h in hashes], last - first, least)
            whole = np.concatenate([np.arange(first, last) for *_, first, last in own])
            across[whole] |= covered([h in known for h in together], len(whole), least)
    unique: dict[tuple[int, int], str] = {}
    for p, b, first, last in spans:
        text = pages[p][b][1]
        if across[first:last].all():
            text = ""
        elif within[first:last].any():
            text = " ".join([w for w, d in zip(text.split(" "), within[first:last].tolist(), strict=True) if not d])
        unique[p, b] = text
    out = []
    for p, blocks in enumerate(pages):
        article = {b for b, (place, _) in enumerate(blocks) if place == ARTICLE}
        open_ = {b: unique[p, b] for b, (place, _) in enumerate(blocks) if place == OPEN and unique[p, b]}
        # The open part is the main text where it outweighs the article.
        if article and sum(map(n_words, open_.items())) <= sum(n_words(blocks[b]) for b in article):
            open_ = {}
        kept = [text if b in article else open_[b] for b, (_, text) in enumerate(blocks) if b in article or b in open_]
        out.append(" ".join(kept))
    return out


def extract_text(pages: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.withColumn("host", host)
    need = F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0))) / SHARD_CHARS)).cast("int")
    large = pages.groupBy("host").agg(need.alias("shards")).filter("shards > 1")
    spark = pages.sparkSession
    some = large.limit(MOST_HOSTS + 1).collect()  # some 30 bytes each
    few = len(some) <= MOST_HOSTS
    held = F.broadcast(spark.createDataFrame([tuple(r) for r in some], "host string, shards int")) if few else large
    dealt = pages.join(held, "host", "left").select(
        "page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard"), F.coalesce("shards", F.lit(1)).alias("shards")
    )

    def cut(batch: pa.RecordBatch) -> dict:
        found = [blocks_of(x or "") for x in batch.column(2).to_pylist()]
        return {
            "page_id": batch.column(0),
            "url": batch.column(1),
            "host": batch.column(3),
            "shard": batch.column(4),
            "places": [bytes(p for p, _ in x) for x in found],
            "blocks": [[t for _, t in x] for x in found],
        }

    shape = "page_id long, url string, host string, shard int, places binary, blocks array<string>"
    streams = map_batches(dealt, ["page_id", "url", "html", "host", "shard"], cut, shape)

    def texts(table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())})
        blocks = [list(zip(p, b, strict=True)) for p, b in zip(table.column("places").to_pylist(), table.column("blocks").to_pylist(), strict=True)]
        got = shard_texts(blocks, table.column("page_id").to_pylist(), least, frozenset(runs.column("run").to_pylist()), table.column("host")[0].as_py())
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(got, pa.string()), "n_chars": pa.array(map(len, got), pa.int64())})

    # Hosts of one shard need no runs from elsewhere.
    known = host_runs(dealt.join(held.select("host"), "host", "left_semi"), least)
    return streams.groupBy("host", "shard").cogroup(known.groupBy("host", "shard")).applyInArrow(texts, SCHEMA)


def host_runs(dealt: DataFrame, least: int) -> DataFrame:
    """(host, shard, run): the hashes of runs on two pages of a host or more, for each shard that asks for them."""

    def asking(batch: pa.RecordBatch) -> dict:
        return {"host": batch.column(0).filter(pa.array([asks(blocks_of(x or "")) for x in batch.column(1).to_pylist()], pa.bool_()))}

    hosts = map_batches(dealt, ["host", "html"], asking, "host string").distinct()
    some = hosts.limit(MOST_HOSTS + 1).collect()
    few = len(some) <= MOST_HOSTS
    spark = dealt.sparkSession
    if not some:
        return spark.createDataFrame([], "host string, shard int, run long")
    hosts = F.broadcast(spark.createDataFrame([tuple(r) for r in some], "host string")) if few else hosts

    def cut(batch: pa.RecordBatch) -> dict:
        out = {x: [] for x in ("host", "shard", "page", "content", "ask", "run")}
        for host, shard, page, html in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            blocks = blocks_of(html or "")
            inside, together = windows_of(blocks, host, least)
            found = {*together, *(h for x in inside for h in x)}
            out["run"] += found
            for name, x in (("host", host), ("shard", shard), ("page", page), ("content", content_of(blocks)), ("ask", asks(blocks))):
                out[name] += [x] * len(found)
        return out

    # A null page_id is one page, as in a shard.
    source = dealt.join(hosts, "host", "left_semi").select("host", "shard", F.xxhash64("page_id").alias("page"), "html")
    runs = map_batches(source, source.columns, cut, "host string, shard int, page long, content long, ask boolean, run long")
    twice = runs.groupBy("run").agg(
        (F.min("page") != F.max("page")).alias("pages"), (F.min("content") != F.max("content")).alias("contents"), F.max("ask").alias("ask")
    )
    twice = twice.filter("pages AND contents AND ask").select("run")
    return runs.filter("ask").select("host", "shard", "run").distinct().join(twice, "run").select("host", "shard", "run")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
