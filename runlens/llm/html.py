"""Main text of web pages by consensus paths per host.

Each page's containers are scored by the paragraph text they hold, as a share of the page. The shares are
votes for generalised tag-class paths (positions dropped, digits in class names replaced), summed per host in
Spark. Every page is then read again with its host's winning path; a page without that path falls back to
its own best container, so no page loses its text to the vote.

The densest container need not be the whole article: a headline or a section may stand beside it. Everything in the
outermost article or main element around the winner is kept, but for what is furniture by element, role or name. Where
there is no such element, containers within body with mostly unlinked text of their own are kept beside the winner,
unless a host has the same text there on each of at least five different pages, or has that many and the container on
one of them only.
"""

import re
import zlib
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import checkpoint

# The elements of HTML by their role in the layout.
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "html address aside blockquote dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr li menu nav ol p pre summary table tbody tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
DROPPED = RAW | frozenset("head nav header footer aside form dialog menu button select svg canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu".split())
# Words of class and id that mark menus, adverts, notices and reader comments.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply replies share sharing"
    " social related recommended recommendations widget toolbar pagination pager".split())
# A class such as post-header names a part of the article, other than post-comments.
ARTICLE_WORDS = frozenset("article post entry content story".split())
HEADING_WORDS = frozenset("header masthead banner".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
CLOSING_STOPS = frozenset("ul ol dl table body div article section main".split())

_HANDFUL = 5  # different pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(source: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(source)}


def _names_furniture(name: str) -> bool:
    """Whether a class or id marks furniture: one of its parts does, or for the heading of an article one that is no heading."""
    parts = re.findall(r"[a-z]+", name.lower())
    found = DROPPED_WORDS.intersection(parts)
    return bool(found - HEADING_WORDS if parts and parts[0] in ARTICLE_WORDS else found)


def _is_dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """An article's own header belongs to it."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if tag in ("main", "article"):
        return False
    return any(map(_names_furniture, f"{attributes.get('class', '')} {attributes.get('id', '')}".split()))


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def blocks(html: str) -> Iterator[tuple[str, int, tuple[str, ...]]]:
    """Text blocks in page order: text, characters inside links, paths of the containers around it."""
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, container
    paths: list[str] = ["page"]
    words: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        chars, linked = linked, 0
        return (text, chars, tuple(paths)) if text else None

    def pop():
        nonlocal in_link
        tag, _, container = stack.pop()
        if container:
            paths.pop()
        in_link -= tag == "a"

    def close(tags, stops):
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                while len(stack) > depth:
                    pop()
                return
            if stack[depth][0] in stops:
                return

    at, lower = 0, None
    while at < len(html):
        token = _TOKEN.search(html, at)
        begin = token.start() if token else len(html)
        if begin > at and not (stack and stack[-1][1]):
            words.append(html[at:begin])
            linked += (begin - at) * (in_link > 0)
        if not token:
            break
        at = token.end()
        end, start = token[1], token[2]
        if end:
            tag = end.lower()
            if tag in BLOCKS and (block := flush()):
                yield block
            close((tag,), ())
        elif start:
            tag = start.lower()
            attributes = _attributes(token[3]) if token[3].strip(" /\t\r\n") else {}
            if tag == "br":
                words.append(" ")
                continue
            if tag in BLOCKS:
                if block := flush():
                    yield block
                close(("p",), CONTAINERS)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], CLOSING_STOPS)
            if tag in RAW:
                lower = html.lower() if lower is None else lower
                found = lower.find(f"</{tag}", at) if len(lower) == len(html) else html.find(f"</{start}", at)
                at = len(html) if found < 0 else found
                continue
            if tag in VOID:
                continue
            container = tag in CONTAINERS
            if container:
                paths.append(f"{paths[-1]}>{_label(tag, attributes)}")
            dropped = bool(stack and stack[-1][1]) or _is_dropped(tag, attributes, any(outer[0] == "article" for outer in stack))
            stack.append((tag, dropped, container))
            in_link += tag == "a"
    if block := flush():
        yield block


def _scores(found: list[tuple[str, int, tuple[str, ...]]]) -> dict[str, int]:
    """Thousandths of the page's text per container: whole for the nearest, half for the one around it."""
    total, scores = 0, {}
    for text, linked, paths in found:
        weight = max(len(text) - linked, 0)
        total += weight
        scores[paths[-1]] = scores.get(paths[-1], 0) + 2 * weight
        if len(paths) > 1:
            scores[paths[-2]] = scores.get(paths[-2], 0) + weight
    return {path: score * 500 // total for path, score in scores.items()} if total else {}


def _best(scores: dict[str, int]) -> str | None:
    return max(scores, key=lambda path: (scores[path], path), default=None)


def _scope(path: str) -> str | None:
    """The outermost article or main element of a path, if any."""
    parts = path.split(">")
    at = next((n for n, part in enumerate(parts) if part.split(".")[0] in ("article", "main")), None)
    return None if at is None else ">".join(parts[: at + 1])


def _own(found: list[tuple[str, int, tuple[str, ...]]]) -> dict[str, tuple[int, int, int]]:
    """Per container with text of its own: characters outside and inside links, and a hash of the text."""
    own: dict[str, tuple[int, int, int]] = {}
    for text, linked, paths in found:
        plain, links, h = own.get(paths[-1], (0, 0, 0))
        own[paths[-1]] = plain + max(len(text) - linked, 0), links + min(linked, len(text)), zlib.crc32(text.encode("utf-8", "surrogatepass"), h)
    return own


def _text(html: str | None, winner: str | None, sections: Iterable[str] | None) -> tuple[str, str | None]:
    found = list(blocks(html or ""))
    path = winner
    if not any(winner in paths for _, _, paths in found):
        path = _best(_scores(found)) or "page"
        sections = [p for p, (plain, linked, _) in _own(found).items() if plain > linked]
    kept, beside = _scope(path), frozenset(() if sections is None else sections)
    if kept is not None:
        beside = frozenset()
    return "\n".join(text for text, _, paths in found if (kept or path) in paths or paths[-1] in beside), path if found else None


def votes(pages: DataFrame) -> DataFrame:
    """Per host and generalised path, over the pages of the host: ``votes``, shares of page text, and of the path's own text
    the characters outside (``plain``) and inside links (``linked``), the least and greatest hash (``low``, ``high``) and
    ``seen``, a bit of 64 for each different page."""

    def run(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch["host"], batch["html"]):
                found = list(blocks(html or ""))
                scores, own = _scores(found), _own(found)
                bit = 1 << zlib.crc32((html or "").encode("utf-8", "surrogatepass")) % 63
                for path in scores.keys() | own.keys():
                    plain, linked, h = own.get(path, (0, 0, None))
                    rows.append((host, path, scores.get(path, 0), plain, linked, h, h, bit))
            counted = pd.DataFrame(rows, columns=["host", "path", "votes", "plain", "linked", "low", "high", "seen"])
            counted = counted.astype({"low": "Int64", "high": "Int64"})
            bits = lambda s: np.bitwise_or.reduce(s.to_numpy(np.int64))
            yield counted.groupby(["host", "path"], as_index=False).agg(
                {"votes": "sum", "plain": "sum", "linked": "sum", "low": "min", "high": "max", "seen": bits})

    single = pages.select("host", "html").mapInPandas(
        run, "host string, path string, votes bigint, plain bigint, linked bigint, low bigint, high bigint, seen bigint")
    return single.groupBy("host", "path").agg(
        *[F.sum(c).alias(c) for c in ("votes", "plain", "linked")], F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("seen").alias("seen"))


def _layouts(counted: DataFrame) -> DataFrame:
    """(host, path, sections): the winning path of a host, and the paths beside it whose text belongs to the article."""
    best = checkpoint(counted.filter("votes > 0").groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best"), F.bit_or("seen").alias("all"))
                      .select("host", F.col("best.path").alias("winner"), F.bit_count("all").alias("pages")))
    # Text that is the same on each of several pages belongs to the layout.
    beside = counted.join(best, "host").filter(
        f"NOT startswith(path || '>', winner || '>') AND plain > linked"
        f" AND (low != high OR bit_count(seen) < {_HANDFUL}) AND (bit_count(seen) > 1 OR pages < {_HANDFUL})")
    sections = beside.groupBy("host").agg(F.collect_set("path").alias("sections"))
    return best.join(sections, "host", "left").select("host", F.col("winner").alias("path"), "sections")


def main_text(pages: DataFrame, *, most_hosts: int = 100_000) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, path.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a
    line feed in page order. Null or empty html gives an empty text and a null path; pages without a host
    vote together. Every row gives one row; other columns are ignored. Hosts' paths are broadcast up to
    ``most_hosts`` of them and joined by shuffle beyond.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    winners = checkpoint(_layouts(checkpoint(votes(rows))))
    if winners.count() <= most_hosts:
        winners = F.broadcast(winners)

    @F.pandas_udf("text string, path string")
    def extract(html: pd.Series, path: pd.Series, sections: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_text(*row) for row in zip(html, path, sections)], columns=["text", "path"])

    found = rows.join(winners, "host", "left").withColumn("found", extract("html", "path", "sections"))
    return found.select("page_id", "url", F.col("found.text").alias("text"),
                        F.length("found.text").cast("bigint").alias("n_chars"), F.col("found.path").alias("path"))
