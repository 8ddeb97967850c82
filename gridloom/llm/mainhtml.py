"""Main text of web pages: markup first, then what a host repeats.

A page is read into blocks of words.  Elements that name themselves (``nav``,
``footer``, a class such as ``sidebar`` or ``comments``) are left out, and a page
with an ``article`` or ``main`` element keeps only what stands inside it.  What
markup leaves open is settled by the host's suffix array: the token streams of
all its pages, cut to the least length that counts as long.  Places whose
suffixes agree to that depth form one interval of the array; an interval of
enough distinct pages is boilerplate, and the union of such stretches is removed,
so that only unique runs stay.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Collection
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.durable import durable
from gridloom.plans.session import bounded_batches

#: Elements whose content is never shown, or isn't prose.
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas audio video select option textarea button datalist title".split())
#: Elements that are no part of an article.
CHROME = frozenset("nav aside form dialog menu footer".split())
#: Landmark roles that are no part of an article.
ROLES = frozenset("navigation complementary contentinfo search form dialog alertdialog alert menu menubar toolbar banner".split())
#: Words of class names and ids that name what is no part of an article.
MARKS = frozenset((
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination toc skip footer masthead topbar toolbar sidebar aside widget widgets rail ad ads advert "
    "adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices notification alert "
    "disclaimer newsletter subscribe subscription signup login social share sharing related recommended recommendations trending comment comments commentlist disqus "
    "respond replies discussion form search"
).split())
#: Words beside which a mark says what a wrapper also holds or lacks.
CANCELLED = frozenset("no has with without is wrap".split())
#: Elements that neither end a block nor part words.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a sibling closes, within its list or table.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
LISTS = {"ul", "ol", "dl", "table"}

_RAW = "script|style|textarea|title|iframe|noscript|template|svg|math|select|object|canvas|audio|video"
#: Comments, declarations, elements whose content isn't parsed, tags cut off by the page's end; then tags (slash, name, attributes) and text.
_PIECE = re.compile(
    rf"<!--[\s\S]*?(?:-->|\Z)|<[!?][^>]*>?|(?i:<({_RAW})(?=[\s/>])[^>]*(?:(?<=/)>|>[\s\S]*?(?:</\1(?=[\s/>])[^>]*>?|\Z)))|</?[A-Za-z][^<>]*\Z"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)"
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Words in a stretch that may count as repeated.
LEAST = 6
#: A stretch is boilerplate where it stands on so many distinct pages of its host at least ...
PAGES = 3
#: ... and on this share of them; within a marked article whole blocks alone, on over half of at least eight pages.
SHARE = 0.25
ARTICLE_PAGES = 8
BREAK = "\n"
#: Stretches to remove are sent to all tasks up to so many bytes, and joined beyond.
BROADCAST_BYTES = 16 << 20


@dataclass
class Block:
    """Words of one block, whether an article holds them, and how many stand in links."""

    words: list[str]
    main: bool
    linked: int


@lru_cache(maxsize=4096)
def _marked(name: str, rest: str, inside: bool) -> bool:
    """Whether an element names itself as no part of an article; headers within an article are its own."""
    if name in CHROME or (name == "header" and not inside):
        return True
    if name in ("html", "body", "main") or not rest:
        return False
    for kind, *values in _ATTRIBUTE.findall(rest):
        value = next((v for v in values if v), "").lower()
        if kind.lower() == "role":
            if any(v in ROLES for v in value.split()):
                return True
            continue
        for one in value.split():
            words = re.split(r"[^a-z]+", one)
            if not CANCELLED.isdisjoint(words):
                continue
            if any(w in MARKS for w in words) or ("header" in words and not inside):
                return True
    return False


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page that markup doesn't rule out, in page order.

    An element left open ends with its parent; ``p``, list items and table cells
    also end where the next begins.  A tag or comment that the page's end cuts
    off is left out.  Where no article is marked, blocks that are mostly links go.
    """
    if not page:
        return []
    out: list[Block] = []
    text: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, ruled out, inside an article
    hidden = main = in_link = has_main = False

    def words_of(pieces: list[str]) -> list[str]:
        whole = "".join(pieces)
        return (entities.unescape(whole) if "&" in whole else whole).split()

    def end_block() -> None:
        words = words_of(text)
        if words:
            out.append(Block(words, main, len(words_of(links)) if links else 0))
        text.clear()
        links.clear()

    def close(names: Collection[str], within: Collection[str] = ()) -> None:
        """Leave the innermost open element of these names, unless one of ``within`` holds it."""
        nonlocal hidden, main
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                hidden, main = stack[-1][1:] if stack else (False, False)
                return
            if stack[k][0] in within:
                return

    for _, closing, name, rest, piece in _PIECE.findall(page):
        if piece:
            if not hidden:
                text.append(piece)
                if in_link:
                    links.append(piece + " ")
            continue
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not closing
            continue
        if name in INLINE:
            named = closing and any(s[0] == name for s in stack) or not closing and rest and _marked(name, rest, main)
            if not named:
                continue
        elif name == "br":
            if not hidden:
                text.append(" ")
            continue
        if text:
            end_block()
        if closing:
            in_link = False
            close((name,))
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == "p" and name not in INLINE:
            close(("p",))
        if name in CLOSED_BY:
            close(CLOSED_BY[name], LISTS)
        hidden = name != "main" and (hidden or name in UNSEEN or _marked(name, rest, main))
        main = main or (not hidden and (name in ("article", "main") or 'role="main"' in rest))
        has_main = has_main or main
        stack.append((name, hidden, main))
    end_block()
    return [b for b in out if b.main] if has_main else [b for b in out if 2 * b.linked <= len(b.words)]


def _digest(tokens: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def suffixes_of(page: str | None, least: int = LEAST) -> list[tuple[bytes, int, int, bool]]:
    """Beginnings of a page's suffixes that may be repeated: digest, first token, length, whole block of an article.

    The stream is the words of all blocks with a break after each.  In open
    blocks a suffix starts at every token; in an article only whole blocks are
    asked about.  Each beginning is given once a page, at its first place.
    """
    seen: dict[tuple[bytes, bool], tuple[int, int]] = {}
    stream: list[str] = []
    blocks = blocks_of(page)
    for b in blocks:
        if b.main:
            seen.setdefault((_digest([*b.words, BREAK]), True), (len(stream), len(b.words) + 1))
        stream += [*b.words, BREAK]
    if blocks and not blocks[0].main:
        for at in range(len(stream) - least + 1):
            seen.setdefault((_digest(stream[at : at + least]), False), (at, least))
    return [(d, at, n, whole) for (d, whole), (at, n) in seen.items()]


def text_of(page: str | None, bad: set[tuple[bytes, bool]], least: int = LEAST) -> str:
    """The page's blocks without the stretches in ``bad``, joined by one space."""
    blocks = blocks_of(page)
    if not bad:
        return " ".join(" ".join(b.words) for b in blocks)
    stream = [t for b in blocks for t in (*b.words, BREAK)]
    gone = bytearray(len(stream))
    at = 0
    for b in blocks:
        n = len(b.words) + 1
        if b.main and (_digest([*b.words, BREAK]), True) in bad:
            gone[at : at + n] = b"\1" * n
        at += n
    if blocks and not blocks[0].main:
        for at in range(len(stream) - least + 1):
            if (_digest(stream[at : at + least]), False) in bad:
                gone[at : at + least] = b"\1" * least
    return " ".join(t for t, g in zip(stream, gone) if not g and t != BREAK)


SUFFIX = T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("whole", T.BooleanType())]))


@F.pandas_udf(SUFFIX)
def _suffixes(page: pd.Series) -> pd.Series:
    return pd.Series([[{"digest": d, "whole": w} for d, _, _, w in suffixes_of(p)] for p in page], dtype=object)


@F.pandas_udf(T.StringType())
def _text(page: pd.Series, bad: pd.Series) -> pd.Series:
    return pd.Series([text_of(p, {(bytes(x["digest"]), bool(x["whole"])) for x in b} if b is not None else set()) for p, b in zip(page, bad)], dtype=object)


def _page_key(url: Column, page: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(url, F.lit("")), F.coalesce(page, F.lit("")))))


def _salted(few: DataFrame, n: int) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def repeated(pages: DataFrame, url: str = "url", html: str = "html", salts: int = 32) -> DataFrame:
    """``page, bad``: the stretches of each page that its host repeats; pages without any are absent.

    ``page`` is a digest of url and markup, so that copies of a row count as one
    page.  A host or a stretch may hold a third of all rows: counts are added up
    before they are shuffled, and rows meet them over salted keys.
    """
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = bounded_batches(pages).select(F.xxhash64(host).alias("host"), _page_key(F.col(url), F.col(html)).alias("page"), F.explode(_suffixes(F.col(html))).alias("s"))
    rows = durable(rows.select("host", "page", "s.digest", "s.whole"), "html-suffixes").distinct()
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    shared = rows.groupBy("host", "digest", "whole").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))
    enough = F.when(F.col("whole"), (F.col("host_pages") >= ARTICLE_PAGES) & (2 * F.col("n") > F.col("host_pages"))).otherwise(F.col("n") >= F.lit(SHARE) * F.col("host_pages"))
    bad = shared.join(_salted(sizes, salts), ["host", "salt"]).filter(enough).select("host", "digest", "whole")
    hit = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int")).join(_salted(bad, salts), ["host", "digest", "whole", "salt"])
    return hit.groupBy("page").agg(F.collect_list(F.struct("digest", "whole")).alias("bad"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds ``text``, the page's main text, and ``n_chars``, its code points.

    Null and empty pages have an empty text; a page whose blocks are all
    boilerplate too.  Pages without a url share one host.  Copies of a page
    count once, so they neither protect nor condemn what they hold.  Repeated
    rows stay; columns of these names are replaced.  Character references are
    decoded before white space is turned into single spaces.
    """
    stretches = durable(repeated(pages, url, html), "html-repeats")
    weight = stretches.agg(F.coalesce(F.sum(F.size("bad") * 64 + 64), F.lit(0))).first()[0]
    few = F.broadcast(stretches) if weight <= BROADCAST_BYTES else stretches
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "__page")]
    keyed = bounded_batches(pages).withColumn("__page", _page_key(F.col(url), F.col(html)))
    joined = keyed.join(few.select(F.col("page").alias("__page"), F.col("bad").alias("__bad")), "__page", "left")
    return joined.select(*kept, _text(F.col(html), F.col("__bad")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


#: Holds for pages whose markup names all that isn't the article, as that of the given tables does.
SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^<>]*>', ' ', 'g') AS t FROM a
), c AS (
  SELECT page_id, url, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g')) AS text FROM b
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
