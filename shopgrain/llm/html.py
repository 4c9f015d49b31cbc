"""Main text of web pages by host suffix arrays.

A page is read into blocks with a standing: content (inside ``article`` or ``main``), boilerplate (inside menus, footers, adverts, forms and the like), or open.
The token streams of a host's pages, content included, are concatenated; a suffix array over them finds substrings of at least ``LONG`` tokens that occur on
distinct pages. Covered tokens of open blocks are removed as boilerplate, such as teasers of another page's article; unique runs stay. Content itself is not
removed for being repeated: copies of an article and passages it quotes are text. A host with more than ``CHUNK`` pages or ``TOKENS`` tokens is dealt into chunks
by page, each with its own array. Substrings that lie on one page of their chunk are then looked up, by a hash, among those of the host's other chunks, so the
text of a page does not depend on how its host is dealt.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as X
from .common import id_back, LAST_ID, materialized, table

LONG = 6
CHUNK = 2048
TOKENS = 1 << 21

# Element names of HTML, and the words that name parts of a page.
CONTENT = frozenset("article main".split())
NEVER = frozenset("head title script style noscript template iframe object svg canvas audio video select option textarea button input datalist dialog".split())
BOILERPLATE = frozenset("nav footer aside form menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe"
MARKED = frozenset(
    "ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words beside those above that leave a class name a mark (comment-list, site-header), words before them that undo it (has-sidebar), and elements inside an article that no class name takes away.
NEUTRAL = frozenset("area bar block body bottom box container content footer form inner item left list main page post reader right section site thread top user wrap wrapper".split())
NEGATED = frozenset("has is no not with without".split())
PROSE = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Headings over reader comments.
_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|visitor)s?'? )?(?:comments?|responses?|replies)(?: \(?\d+\)?)?:?|leave a (?:reply|comment)|join the (?:discussion|conversation)", re.I)

#: SOFT: dropped, but an article or main part inside counts.
OPEN, TEXT, DROP, SOFT = 0, 1, 2, 3
Block = tuple[int, list[str]]


def _mark(value: str, key: str, in_content: bool) -> int:
    """What the class names (or the id) of an element say: DROP if one is made of marking words, SOFT if it has one among others, else OPEN. In an article only the former counts, and of ids only whole ones."""
    out = OPEN
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not any(p in MARKED for p in parts) or parts[0] in NEGATED:
            continue
        if all(p in MARKED or p in NEUTRAL for p in parts) and not (in_content and key == "id" and len(parts) > 1):
            return DROP
        out = OPEN if in_content else SOFT
    return out


def _boilerplate(name: str, attributes: str, in_content: bool) -> int:
    """DROP or SOFT for what is no text of the page, else OPEN."""
    if name in NEVER or name in BOILERPLATE and name != "form" and not (name == "aside" and in_content) or (name == "header" and not in_content):
        return DROP
    out = SOFT if name == "form" else OPEN
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return out
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), entities.unescape(a or b or c)
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return DROP
        if key == "role" and value.lower() in ROLES:
            return DROP
        if key in ("class", "id") and name not in ("body", "html") and not (in_content and name in PROSE):
            out = max(out, _mark(value, key, in_content), key=(OPEN, SOFT, DROP).index)
    return out


def blocks(page: str) -> list[Block]:
    """Standing and words of each block of a page, in order; broken and cut-off markup is taken as far as it goes."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements and the standing inside
    words: list[str] = []
    standing, at = OPEN, 0
    heading, comments = 0, (0, 0)  # level of the open heading; level of a heading over comments and the number of elements around it

    def flush() -> None:
        nonlocal words, comments
        text = "".join(words).split()
        if text:
            if heading and standing < DROP:
                if comments[0] and heading <= comments[0]:
                    comments = (0, 0)
                if _COMMENTS.fullmatch(" ".join(text)):
                    comments = (heading, len(stack) - 1)
            out.append((DROP if standing >= DROP or comments[0] else standing, text))
        words = []

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            words.append(" ")
        if m[2] or m[5]:  # an end tag closes what is open inside; one without a start is nothing
            if any(n == name for n, _ in stack):
                if name not in BLOCK and any(s >= DROP for n, s in stack):
                    flush()
                while stack:
                    n, _ = stack.pop()
                    if n == name:
                        break
                after = stack[-1][1] if stack else OPEN
                if after != standing:
                    flush()
                standing = after
                if name in HEADINGS:
                    heading = 0
                if comments[0] and len(stack) < comments[1]:
                    flush()
                    comments = (0, 0)
            continue
        if name in VOID or (m[4] or m[7] or "").rstrip().endswith("/") and name not in BLOCK:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph ends where the next begins
        inside = standing
        if standing != DROP:
            mark = _boilerplate(name, m[4] or m[7] or "", standing == TEXT)
            if mark == DROP or mark == SOFT and name not in CONTENT:
                inside = mark
            elif name in CONTENT:
                inside = TEXT
        if inside != standing:
            flush()
        stack.append((name, inside))
        standing = inside
        if name in HEADINGS:
            heading = int(name[1])
    if at < len(page):
        words.append(entities.unescape(page[at:]))
    flush()
    return out



def _tokens(page: list[Block]) -> tuple[list[str], list[bool]]:
    """Words of all blocks, content after the others, each block after a border; whether each is open."""
    words: list[str] = []
    is_open: list[bool] = []
    for standing, text in sorted(page, key=lambda b: b[0] == TEXT):
        words += ["\n", *text]
        is_open += [False] + [standing == OPEN] * len(text)
    return words, is_open


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page, parted by spaces and compressed, how many they are, and whether one is open."""
    pack = zstandard.ZstdCompressor(level=6, write_checksum=False)
    for batch in batches:
        tokens, size, flags = [], [], []
        for page in batch.column("html"):
            words, is_open = _tokens(blocks(page.as_py() or ""))
            tokens.append(pack.compress(" ".join(words).encode("utf-8", "surrogatepass")))
            size.append(len(words))
            flags.append(any(is_open))
        cols = [pa.array(tokens, pa.binary()), pa.array(size, pa.int32()), pa.array(flags, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pid", "hh", "host")), *cols], ["pid", "hh", "host", "tokens", "n_tokens", "any_open"])


def _streams(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Hashes of the tokens of each page."""
    unpack, known, out = zstandard.ZstdDecompressor(), {}, []
    for row in column:
        words = unpack.decompress(row.as_py()).split(b" ")
        if words == [b""]:
            words = []
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out.append(np.array([known[w] for w in words], np.uint64).view(np.int64))
    return out


def prefix_ranks(values: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` symbols, by doubling; suffixes with equal ranks share those symbols."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    have, n = 1, len(values)
    while have < length and n:
        step = min(have, length - have)
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def _runs(text: np.ndarray, first: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes with at least ``length`` tokens in the order of these, and where runs of equal ones begin."""
    rank = prefix_ranks(text, length)
    order = np.argsort(rank, kind="stable")  # the suffix array, as far as substrings of this length need it
    whole = (first + size - length)[owner] >= np.arange(len(text))
    order = order[whole[order]]
    return order, np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1])) if len(order) else np.zeros(0, np.int64)


def _covered(starts: np.ndarray, total: int, length: int) -> np.ndarray:
    hit = np.zeros(total + 1, np.int32)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + length, -1)
    return np.cumsum(hit[:-1]) > 0


def _shape(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in streams], np.int64)
    text = np.concatenate(streams) if streams else np.zeros(0, np.int64)
    return text, np.cumsum(size) - size, size, np.repeat(np.arange(len(streams)), size)


def repeated(streams: list[np.ndarray], pages: np.ndarray, length: int = LONG) -> list[np.ndarray]:
    """For each stream, which of its tokens lie in a substring of ``length`` tokens that also occurs on another page."""
    text, first, size, owner = _shape(streams)
    starts, _, _ = _judged_runs(text, first, size, owner, pages, length)
    covered = _covered(starts, len(text), length)
    return [covered[a : a + n] for a, n in zip(first, size)]


def _judged_runs(text, first, size, owner, pages: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the substrings that lie on several pages, one start of each of these, and starts of those that lie on one page."""
    order, cut = _runs(text, first, size, owner, length)
    if not len(order):
        return order, order, order
    page = pages[owner[order]]
    several = np.minimum.reduceat(page, cut) < np.maximum.reduceat(page, cut)
    of_run = np.repeat(several, np.diff(np.append(cut, len(order))))
    return order[of_run], order[cut[several]], order[~of_run]


def _window_hash(text: np.ndarray, starts: np.ndarray, length: int = LONG) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for j in range(length):
        h = X.mix(h ^ X.mix(text[starts + j].view(np.uint64) + np.uint64(j)))
    return h.view(np.int64)


def _chunk(t: pa.Table) -> pa.Table:
    """Per page of a chunk: its covered tokens; if the host has other chunks also starts and hashes of the substrings that lie on no other page here, and
    hashes of some that lie on several, each once in a chunk."""
    text, first, size, owner = _shape(_streams(t.column("tokens")))
    several, each, single = _judged_runs(text, first, size, owner, t.column("pid").to_numpy(), LONG)
    covered = np.flatnonzero(_covered(several, len(text), LONG))
    if t.column("chunks")[0].as_py() == 1:
        each = single = np.zeros(0, np.int64)
    each, single = np.sort(each), np.sort(single)

    def by_page(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.append(first, len(text))).astype(np.int32)), pa.array(values, kind))

    return pa.table({
        "pid": t.column("pid"), "hh": t.column("hh"), "host": t.column("host"), "any_open": t.column("any_open"),
        "covered": by_page(covered, covered - first[owner[covered]], pa.int32()), "starts": by_page(single, single - first[owner[single]], pa.int32()),
        "single": by_page(single, _window_hash(text, single), pa.int64()), "several": by_page(each, _window_hash(text, each), pa.int64()),
    })


def _across(chunks: DataFrame) -> DataFrame:
    """(pid, hh, further): starts, on pages with open blocks, of substrings that lie on one page of their chunk and also in another chunk of the host."""
    named = F.xxhash64("host", "w").alias("w")
    alone = chunks.select("pid", "host", F.explode("single").alias("w")).select("pid", named)
    lo, hi = F.lit(-LAST_ID - 1), F.lit(LAST_ID)
    often = chunks.select("host", F.explode("several").alias("w")).select(named)
    seen = alone.select("w", F.col("pid").alias("lo"), F.col("pid").alias("hi")).unionByName(often.select("w", lo.alias("lo"), hi.alias("hi")))
    seen = seen.groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("w")
    asked = chunks.where("any_open").select("pid", "hh", "host", F.explode(F.arrays_zip("starts", "single")).alias("x")).select("pid", "hh", "host", F.col("x.starts").alias("start"), F.col("x.single").alias("w"))
    asked = asked.select("pid", "hh", "start", named)
    return asked.join(seen, "w").groupBy("pid", "hh").agg(F.collect_set("start").alias("further"))


def _unique(text: list[str], covered: list[bool]) -> list[str]:
    """Words of an open block outside covered runs; a run counts if it is the whole block or has ``LONG`` words, not if it only reaches in from next door."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and covered[j] == covered[i]:
            j += 1
        if not covered[i] or j - i < min(LONG, len(text)):
            out += text[i:j]
        i = j
    return out


def _joined(page: list[Block], covered: set[int]) -> str:
    out, at = [], 0
    for standing, text in page:
        if standing == TEXT:
            out.append(" ".join(text))
            continue
        at += 1
        if standing == OPEN:
            kept = _unique(text, [i in covered for i in range(at, at + len(text))])
            if kept:
                out.append(" ".join(kept))
        at += len(text)
    return "\n\n".join(out)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages without open blocks."""
    for batch in batches:
        rows = [(i, b) for i, p in enumerate(batch.column("html")) for b in [blocks(p.as_py() or "")] if all(s != OPEN for s, _ in b)]
        at = pa.array([i for i, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("pid", "url")] + [pa.array([_joined(b, set()) for _, b in rows], pa.string())], ["pid", "url", "text"])


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that have open blocks, unchanged."""
    for batch in batches:
        yield batch.filter(pa.array([any(s == OPEN for s, _ in blocks(p.as_py() or "")) for p in batch.column("html")], pa.bool_()))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for p, c, f in zip(batch.column("html"), batch.column("covered"), batch.column("further")):
            text.append(_joined(blocks(p.as_py() or ""), {*(c.as_py() or ()), *(a + j for a in f.as_py() or () for j in range(LONG))}))
        yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("url"), pa.array(text, pa.string())], ["pid", "url", "text"])


def main_texts(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, text): blocks in page order, joined by an empty line; an empty text if there is none.

    A null html is an empty page, a null url a host of its own. Rows that share a page_id are one page: what they repeat of each other is not boilerplate.
    Null ids are one page. An empty table gives no rows.
    """
    pages = pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(LAST_ID)).alias("pid"), F.xxhash64(F.coalesce("html", F.lit("")), "url").alias("hh"), "url", "html",
        F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))).alias("host"),
    )
    evidence = pages.select("pid", "hh", "host", "html").mapInArrow(_evidence, "pid bigint, hh bigint, host string, tokens binary, n_tokens int, any_open boolean")
    evidence = materialized(evidence)
    sizes = evidence.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n_tokens") / TOKENS)).alias("chunks"), F.max("any_open").alias("ask")).where("ask").select("host", "chunks")
    streams = evidence.join(sizes, "host").withColumn("chunk", F.pmod(F.xxhash64("pid"), F.col("chunks")))
    chunks = materialized(streams.groupBy("host", "chunk").applyInArrow(_chunk, "pid bigint, hh bigint, host string, any_open boolean, covered array<int>, starts array<int>, single array<bigint>, several array<bigint>"))
    covered = chunks.where("any_open").groupBy("pid", "hh").agg(F.first("covered").alias("covered"))  # equal rows have equal tokens
    covered = covered.join(_across(chunks), ["pid", "hh"], "left").select("pid", "hh", "covered", "further")
    read = pages.select("pid", "hh", "url", "html")
    done = read.mapInArrow(_settled, "pid bigint, url string, text string")
    rest = read.mapInArrow(_undecided, read.schema).join(covered, ["pid", "hh"], "left").mapInArrow(_judged, "pid bigint, url string, text string")
    return done.unionByName(rest).select(id_back(F.col("pid")).alias("page_id"), "url", "text")


def op6_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
