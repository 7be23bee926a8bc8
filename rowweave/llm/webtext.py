"""HTML extraction with removal of site templates.

A page is parsed into a flat list of elements and texts. Every element subtree has a hash of its tags and words; Spark
counts on how many different pages of a host each hash is, and subtrees that recur on many of the host's pages are deleted.
Inside an article only containers (lists, tables, divisions) can be such a template: paragraphs and headings of an article are
its own, also if other pages repeat them. Nothing that holds more than half of a page's words is one. Menus, adverts and the
like that are on few pages go by their element, role or class; a class counts only if all its words are such.
"""

from __future__ import annotations

import hashlib
import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A subtree is a template from so many different pages of a host on, and from this part of them on, and if it has at most
#: this part of a page's words.
MIN_PAGES, MIN_SHARE, MOST_OF_PAGE = 5, 0.02, 0.5

_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_HIDDEN = frozenset("head nav footer aside form script style noscript template svg math button select option textarea title iframe object canvas audio video dialog menu xmp noembed noframes datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends, up to the element that holds it.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_CONTAINER = frozenset("div section ul ol table dl aside figure details header footer nav form menu".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert menu nav navbar navigation breadcrumb breadcrumbs "
    "footer sidebar aside comment comments disqus replies respond share sharing social related newsletter subscribe subscription popup modal overlay widget widgets pagination pager login signup search toolbar skip masthead copyright".split()
)
#: What may stand beside such words in a class or id.
_NEUTRAL = frozenset("area bar block body bottom box container content header inner item items left link links list main outer page pages panel post posts right section site slot text title top unit wrap wrapper".split())
_NOISE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar form".split())


@dataclass
class Page:
    """events: (kind, index or text): o opens an element, c closes it, t is text, b a break between blocks."""

    events: list[tuple[str, object]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)  # in an article
    hashes: list[bytes] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # words of the subtree
    size: int = 0  # words of what is shown


def _noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _HIDDEN or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            for tokens in ({t for t in re.split(r"[^a-z]+", own) if t} for own in value.split()):
                if tokens & _NOISE and tokens <= _NOISE | _NEUTRAL or "header" in tokens and tokens <= _NEUTRAL and not in_article and tag != "article":
                    return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _NOISE_ROLES or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(source: str) -> Page:
    """Never fails: what isn't closed ends with what holds it, what can't be read as a tag is text or nothing."""
    page, stack, at, n = Page(), [], 0, len(source)
    parts: list[list[bytes]] = []  # what each open element's hash is made of

    def close(upto: int) -> None:
        while len(stack) > upto:
            i = stack.pop()
            own = parts.pop()
            page.hashes[i] = hashlib.blake2b(b"\0".join(own), digest_size=8).digest()
            if parts:
                parts[-1].append(page.hashes[i])
                page.sizes[stack[-1]] += page.sizes[i]
            page.events.append(("c", i))

    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                text = html_.unescape(m[0]) if "&" in m[0] else m[0]
                page.events.append(("t", text))
                if words := text.split():
                    page.size += 0 if stack and page.hidden[stack[-1]] else len(words)
                    if parts:
                        parts[-1].append(" ".join(words).encode("utf-8", "surrogatepass"))
                        page.sizes[stack[-1]] += len(words)
            continue
        tag, ends, attrs = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if page.tags[stack[k]] == tag:
                    close(k)
                    break
                if tag not in _BLOCK and page.tags[stack[k]] in _BLOCK and page.tags[stack[k]] != "p":
                    break  # a stray end of an inline element doesn't end blocks
            continue
        if tag in _BLOCK and tag not in ("html", "body"):
            for k in range(len(stack) - 1, -1, -1):
                if page.tags[stack[k]] == "p":
                    close(k)
                    break
                if page.tags[stack[k]] in _BLOCK:
                    break
        if tag in _ENDS:
            ended, limit = _ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if page.tags[stack[k]] in ended:
                    close(k)
                    if tag != "tr":
                        break
                elif page.tags[stack[k]] in limit:
                    break
        if tag == "body":
            for k, i in enumerate(stack):
                if page.tags[i] == "head":
                    close(k)
                    break
        if tag in _VOID:
            page.events.append(("b", None) if tag == "hr" else ("t", " " if tag in ("br", "wbr") else ""))
            continue
        above = stack[-1] if stack else None
        in_article = above is not None and page.inside[above]
        i = len(page.tags)
        page.tags.append(tag)
        page.hidden.append(above is not None and page.hidden[above] or _noise(tag, attrs, in_article))
        page.inside.append(in_article or tag == "article" and not page.hidden[i])
        page.hashes.append(b"")
        page.sizes.append(0)
        page.events.append(("o", i))
        stack.append(i)
        parts.append([tag.encode()])
        if tag in _RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            parts[-1].append(body.encode("utf-8", "surrogatepass"))
            at = end.end() if end else n
            close(len(stack) - 1)
    close(0)
    return page


def main_text(page: Page, templates: frozenset[bytes] | set[bytes] = frozenset()) -> str:
    """The blocks of the article (of main, of the whole body where there is none), joined by newlines."""
    shown = [not h for h in page.hidden]
    for tag in ("article", "main"):
        if any(t == tag and s for t, s in zip(page.tags, shown, strict=True)):
            break
    else:
        tag = None
    blocks, now, depth, gone = [], [], 0, 0

    def end() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    for kind, what in page.events:
        if kind == "t":
            if not gone and (depth or tag is None):
                now.append(what)
        elif kind == "b":
            end()
        else:
            name = page.tags[what]
            if name in _BLOCK:
                end()
            step = 1 if kind == "o" else -1
            depth += step * (name == tag)
            gone += step * (page.hidden[what] or page.hashes[what] in templates and deletable(page, what))
    end()
    return "\n".join(blocks)


def deletable(page: Page, i: int) -> bool:
    """Whether an element goes if it recurs: not the page's frame, nor most of it, and of an article only containers in it."""
    tag = page.tags[i]
    return page.sizes[i] <= MOST_OF_PAGE * page.size and tag not in ("html", "body", "head", "main", "article") and (tag in _CONTAINER or tag in _BLOCK and not page.inside[i])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _in_runs(step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield step(batch.slice(i, 256))

    return run


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page (a hash of the html), hash: for each shown element that could be a template."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, of, found = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(source or "")
            own = sorted({page.hashes[i] for i in range(len(page.tags)) if not page.hidden[i] and page.sizes[i] and deletable(page, i)})
            hosts += [host] * len(own)
            of += [int.from_bytes(hashlib.blake2b((source or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)] * len(own)
            found += own
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(of, pa.int64()), pa.array(found, pa.binary())], ["host", "page", "hash"])

    return pages.select("host", "html").mapInArrow(_in_runs(step), "host string, page long, hash binary")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, templates: hashes of subtrees on so many of the host's different pages (at most 1 / min_share times a page's elements).

    Pages that are the same in all count once; pages without a host have no templates.
    """
    pages = pages.where("host <> ''")
    n = pages.groupBy("host").agg(F.count_distinct(F.xxhash64(F.coalesce("html", F.lit("")))).alias("pages")).where(F.col("pages") >= min_pages)
    counts = subtrees(pages).distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(n, "host").where(F.col("n") >= min_share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html); null html is an empty page, a null url no host."""
    pages = common.pick(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    found = common.store(templates(pages, min_pages, min_share), "templates")
    joined = pages.join(found, "host", "left").select("page_id", "url", "html", "templates")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for source, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            texts.append(main_text(parse(source or ""), frozenset(gone or ())))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = pages.select("page_id", "url").schema.add("text", "string")
    out = joined.mapInArrow(_in_runs(step), schema)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page. Null and empty pages have an empty text; repeated rows are rows of their own, but one page when
    the host's templates are counted; null urls have no host and so no templates; pages of any length are parsed whole."""
    return extract(common.table(spark, sf_dir, "pages"))
