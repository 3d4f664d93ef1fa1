"""Operator 6: main text of web pages, with a suffix array per host."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, saved
from .quality import covered, suffix_order

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = lambda text: frozenset(text.split())
#: Element names of the HTML standard by how they are treated.
RAW = NAMES("script style textarea title noscript template iframe svg math object xmp noembed noframes")
VOID = NAMES("area base br col embed hr img input link meta param source track wbr")
INLINE = NAMES("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img")
CHROME = NAMES("nav footer aside form menu button select dialog header")
NO_PARAGRAPH = NAMES("p div article section ul ol li dl dd dt table h1 h2 h3 h4 h5 h6 blockquote pre nav footer header aside main form hr figure address")
#: Words of class, id and role that name what isn't the article.
BOILERPLATE = NAMES(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert advertisement adsense banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal"
    " overlay comments comment commentlist disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs subscribe subscription newsletter signup login search toolbar pagination pager"
    " contentinfo complementary dialog skip widget copyright"
)
MAIN = NAMES("article articlebody story entry post content main")
#: Tokens that a repeated string has at least; a power of two.
LONG = 8
#: Share of a host's distinct pages, and number of them, that hold a boilerplate string:
#: outside marked articles, and inside them, where licences and quotations recur too.
LOOSE, INSIDE = (0.2, 2), (0.5, 4)
#: Bytes of a host's streams that one array holds, unless PAGES pages have more.
GROUP, PAGES = 4 << 20, 8
#: Strings that may be broadcast, 16 bytes each.
FEW = 500_000


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def chrome(name: str, own: dict[str, str], in_article: bool) -> bool:
    """Whether an element is page furniture by its name or its attributes."""
    words = set(re.split(r"[^a-z]+", " ".join(own.get(k, "") for k in ("class", "id", "role")).lower())) if own else set()
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return True
    if name in ("html", "body", "main"):
        return False
    if name in CHROME and not (name == "header" and in_article):
        return True
    if words & {"comment", "comments"}:
        return True
    return bool(words & BOILERPLATE) and name != "article" and not words & MAIN


def blocks(html: str) -> list[tuple[str, str]]:
    """Blocks of text in page order, each with where it stands: "article" (main elements
    included), "chrome" for page furniture, or "loose"."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, where its text belongs
    parts: list[str] = []
    where, at = "loose", 0

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((where, text))
        parts.clear()

    def enter(new: str) -> None:
        nonlocal where
        if new != where:
            flush()
            where = new

    while at < len(html):
        m = TAG.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        parts.append(html[at : m.start()])
        at = m.end()
        closing, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if closing:
            names = [x for x, _ in stack]
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                if name in INLINE:
                    del stack[k]
                else:
                    del stack[k:]
                enter(stack[-1][1] if stack else "loose")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or raw.rstrip().endswith("/") and name in VOID:
            continue
        if name in NO_PARAGRAPH:  # these end an open paragraph
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
            if k >= 0 and all(x in INLINE for x, _ in stack[k + 1 :]):
                del stack[k]
        own = attributes(raw) if raw.strip() else {}
        outer = stack[-1][1] if stack else "loose"
        if outer == "chrome" or chrome(name, own, outer == "article"):
            new = "chrome"
        elif name in ("article", "main") or outer == "article" or own.get("role") == "main" or own.get("itemprop", "").lower() == "articlebody":
            new = "article"
        else:
            new = outer
        if name not in INLINE or new != outer:
            stack.append((name, new))
        enter(new)
    flush()
    return found


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html -> page_id, url, host, u (a digest of the stream), stream: a line
    per block, led by the first letter of where it stands."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            hosts, streams = [], []
            for url, html in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
                hosts.append(m[1].lower() if m else "")
                streams.append("\n".join(where[0] + text for where, text in blocks(html or "")))
            u = np.array([xxhash.xxh3_64_intdigest(s.encode()) for s in streams], np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(u), pa.array(streams, pa.string())], names=["page_id", "url", "host", "u", "stream"])


def tokens(stream: str) -> tuple[list[str], list[str]]:
    """The tokens of a stream, and for each where its block stands."""
    words, where = [], []
    for line in stream.split("\n"):
        own = line[1:].split(" ") if line else []
        words += own
        where += line[:1] * len(own)
    return words, where


def digest(words: list[str], at: int) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words[at : at + LONG]).encode())


def page_counts(streams: list[str]) -> dict[bytes, int]:
    """Strings of LONG tokens that begin longer or equal repeats, with the number of
    pages that hold them, for those on two pages or more.

    The pages' token streams are concatenated, each ended by a code found nowhere else,
    and their suffixes sorted; an interval of the array with common prefixes of LONG
    tokens or more is one such string, and its distinct pages are counted.
    """
    names: defaultdict[str, int] = defaultdict()
    names.default_factory = names.__len__
    words = [tokens(s)[0] for s in streams]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes)
    codes = np.fromiter((c for k, w in enumerate(words) for c in (*map(names.__getitem__, w), -1 - k)), np.int64, int(sizes.sum()))
    order, levels = suffix_order(codes)
    depth = LONG.bit_length() - 1
    if len(levels) <= depth:
        return {}
    rank = levels[depth][order]  # equal for prefixes of LONG tokens
    page = np.searchsorted(ends, order, "right")
    first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    by = np.lexsort((page, rank))
    new = np.r_[True, (rank[by][1:] != rank[by][:-1]) | (page[by][1:] != page[by][:-1])]
    pages = np.add.reduceat(new, first, dtype=np.int64)
    some = pages > 1
    at, own = order[first[some]], page[first[some]]
    begins = ends - sizes
    return {digest(words[p], int(a - begins[p])): int(n) for a, p, n in zip(at, own, pages[some], strict=True)}


def need(pages: int, rule: tuple[float, int]) -> float:
    """Pages that must hold a string for it to be boilerplate on a host of `pages`."""
    return max(rule[0] * pages, rule[1])


def local_strings(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """host, part, parts, streams -> host, part, parts, pages, strings (structs of w, n).

    Of a host in one part, strings on two pages or more. Of a host in several, those on at
    least its share of the part's pages: a string on that share of all pages is on as
    large a share of some part's, so none is missed.
    """
    for batch in batches:
        for host, part, parts, streams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = page_counts(streams)
            if parts > 1:
                least = share * len(streams)
                if least <= 1:  # a single page suffices
                    found |= {digest(w, i): 1 for s in streams for w in [tokens(s)[0]] for i in range(len(w) - LONG + 1) if digest(w, i) not in found}
                found = {w: n for w, n in found.items() if n >= least}
            strings = pa.array([[{"w": w, "n": n} for w, n in found.items()]], pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))
            yield pa.record_batch([pa.array([host]), pa.array([part], pa.int64()), pa.array([parts], pa.int64()), pa.array([len(streams)], pa.int64()), strings], names=["host", "part", "parts", "pages", "strings"])


def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, streams, wanted -> host, w, n: pages of this part that hold each wanted one."""
    for batch in batches:
        for host, streams, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            count = dict.fromkeys(wanted, 0)
            for s in streams:
                words = tokens(s)[0]
                for w in {digest(words, i) for i in range(len(words) - LONG + 1)} & count.keys():
                    count[w] += 1
            yield pa.record_batch([pa.array([host] * len(count), pa.string()), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["host", "w", "n"])


def unique_runs(stream: str, known: dict[bytes, bool]) -> str:
    """The page's main text: its marked article, or without one its loose blocks, less
    what boilerplate covers. known: strings, and whether they are so inside articles too.

    An article of which boilerplate would cover over half is a copy of another page's,
    not framed by it, and stays whole."""
    words, where = tokens(stream)
    n, main = len(words), "a" if "a" in where else "l"
    if not known or n < LONG:
        return " ".join(w for w, k in zip(words, where, strict=True) if k == main)
    hits = [(i, known[d]) for i in range(n - LONG + 1) if (d := digest(words, i)) in known]
    starts = np.array([i for i, inside in hits if main == "l" or inside], np.int64)
    gone = covered(starts, np.full(len(starts), LONG), n) if len(starts) else np.zeros(n, bool)
    own = np.array([k == main for k in where])
    if main == "a" and 2 * (gone & own).sum() > own.sum():
        gone[:] = False
    return " ".join(words[i] for i in np.flatnonzero(own & ~gone))


def boilerplate(done: DataFrame) -> DataFrame:
    """done: host, u, stream -> host, w, inside: each host's boilerplate strings.

    A host's distinct streams are dealt into parts of about GROUP bytes by their digest;
    each part has a suffix array of its own. Hosts in one part are counted by it; of
    others the parts' strings are counted again over all parts. Pages are parsed again for
    each pass, which costs less than to keep their text: a pass holds one copy on disk.
    """
    share = min(LOOSE[0], INSIDE[0])
    spark = done.sparkSession
    once = done.groupBy("host", "u").agg(F.max(F.octet_length("stream")).alias("size"))
    large = once.groupBy("host").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter(F.col("size") > GROUP)
    large = saved(large.select("host", F.greatest(F.ceil(F.least(F.col("size") / GROUP, F.col("n") / PAGES)), F.lit(1)).cast("long").alias("parts")))
    if large.count() <= FEW:  # hosts of over GROUP bytes, a short row each
        large = F.broadcast(large)
    rows = done.join(large, "host", "left").select("host", "stream", F.coalesce("parts", F.lit(1)).alias("parts"), F.pmod("u", F.coalesce("parts", F.lit(1))).alias("part"))
    groups = rows.groupBy("host", "part", "parts").agg(F.collect_set("stream").alias("streams"))
    freed(spark)
    local = saved(groups.select("host", "part", "parts", "streams").mapInArrow(lambda it: local_strings(it, share), "host string, part long, parts long, pages long, strings array<struct<w:binary,n:long>>"))
    freed(spark)
    pages = local.groupBy("host").agg(F.sum("pages").alias("pages"))
    each = local.select("host", "parts", F.explode("strings").alias("s")).select("host", "parts", "s.w", "s.n")
    found = each.filter("parts = 1").select("host", "w", "n")
    wanted = saved(each.filter("parts > 1").groupBy("host").agg(F.collect_set("w").alias("wanted")))
    if wanted.take(1):
        more = groups.filter("parts > 1").join(wanted, "host").select("host", "streams", "wanted").mapInArrow(recount, "host string, w binary, n long")
        found = found.unionByName(more.groupBy("host", "w").agg(F.sum("n").alias("n")))
    least = lambda rule: F.greatest(F.col("pages") * rule[0], F.lit(float(rule[1])))
    out = saved(found.join(pages, "host").filter(F.col("n") >= F.least(least(LOOSE), least(INSIDE))).select("host", "w", (F.col("n") >= least(INSIDE)).alias("inside")))
    for x in (local, wanted):
        dropped(x)
    freed(spark)
    return out


def strip(known_of: Callable[[str], dict[bytes, bool]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [unique_runs(s, known_of(h)) for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return run


def strip_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, stream, strings, sorted so that a host's strings come before
    its pages."""
    host, known = None, {}
    for batch in batches:
        rows = []
        for page, url, h, stream, strings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != host:
                host, known = h, {}
            if strings is not None:
                known = {s["w"]: s["inside"] for s in strings}
            else:
                rows.append((page, url, unique_runs(stream, known)))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, *, few: int = FEW) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Every page goes through the suffix array of its host. Its blocks of text, bounded by
    tags, form a token stream; a host's distinct streams are concatenated and their
    suffixes sorted, and a string of LONG tokens or more on enough distinct pages is
    boilerplate: on a fifth of them, and two, or inside a marked article on half of them,
    and four, since licences, quotations and copies recur there. Boilerplate is removed
    and the unique runs of the main text stay. Text that differs from page to page can't
    be told by repetition: menus, adverts, comments and the like are left out by the
    elements and names that mark them, and where a page marks an article (or main), only
    that is its text.

    Null and empty html gives an empty text. Null ids and urls are kept; pages without a
    host form one host. Repeated rows are extracted alike and count as one page, and ties
    can't occur. An empty table gives no rows; other columns are ignored. Memory: a page,
    and the array of GROUP bytes or of PAGES pages, whichever is more.

    Up to `few` strings of all hosts are broadcast; beyond that a host's strings are
    sorted before its pages, which are dealt out over parts.
    """
    spark = pages.sparkSession
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    done = slim.mapInArrow(parse, "page_id long, url string, host string, u long, stream string")
    strings = boilerplate(done)
    schema = "page_id long, url string, text string"
    if strings.count() <= few:
        known: dict[str, dict[bytes, bool]] = defaultdict(dict)
        for r in strings.collect():
            known[r.host][bytes(r.w)] = r.inside
        shared = spark.sparkContext.broadcast(dict(known))
        out = done.select("page_id", "url", "host", "stream").mapInArrow(strip(lambda h: shared.value.get(h, {})), schema)
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lists = strings.groupBy("host").agg(F.collect_list(F.struct("w", "inside")).alias("strings"))
        lists = lists.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", F.lit(None).cast("string").alias("stream"), "strings", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        own = done.select("page_id", "url", "host", "stream", F.lit(None).cast("array<struct<w:binary,inside:boolean>>").alias("strings"), F.pmod("u", F.lit(parts)).cast("int").alias("part"))
        both = own.unionByName(lists).repartition("host", "part").sortWithinPartitions("host", "part", F.col("strings").isNull())
        out = both.select("page_id", "url", "host", "stream", "strings").mapInArrow(strip_sorted, schema)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
