"""Main text of web pages by template deduction: equivalence classes of tokens that share their occurrences on a host's pages.

Tokens are tags, told apart by the path of elements that they stand in, and blocks of text. Each page shrinks to the
numbers of its tokens in their order. A token's occurrence vector (how often it is on each page) is a digest combined by
exclusive or, so it is never gathered; tokens of one host with equal vectors are an equivalence class. A class is valid
if its tokens are on enough pages and come in the same order, again and again, on every page. The valid classes nest by
their paths: they are the host's template, which is bounded by twice the tokens of a mean page, whatever the number of
pages. It says three things:

* where the article lies: the innermost element of the template, once a page, that holds most words of the host's pages;
* which blocks of text belong to the template itself, being on nearly all pages;
* which lists and groups are menus, more than half of their words being links.

What is left in the slots of that element, save what its tags and names call something else (fixed values below), is the
text. Hosts with fewer than LEAST_PAGES pages are read together, as one host's pages would be.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_heavy, lookup, pick, stage
from .url_filter import host_and_path

#: Pages that a host needs for a template of its own; share of its pages that a tag, or a text (on TEXT_PAGES at least), is in.
LEAST_PAGES, TAG_SHARE, TEXT_SHARE, TEXT_PAGES = 4, 0.5, 0.9, 8
#: Share of the words that the article's element holds; share of link words from which a list is a menu; most that the
#: template's own texts may hold of all words (pages that are copies of one another have no template of text).
MAIN_SHARE, LINK_SHARE, FIXED_SHARE = 0.6, 0.5, 0.5

#: Elements without an end tag; elements inside a line; elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
#: Elements, words of classes and ids, and roles that are no article; headers are none outside of an article.
OTHER_TAGS = frozenset("head nav footer aside form button select menu dialog noscript template svg object canvas audio video".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe paywall "
    "signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer comment comments commentlist respond disqus share sharing social related "
    "recommended toolbar pagination pager skip masthead".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Elements that group blocks, elements that list them, what may stand in a head, what an element's start ends.
GROUPS, LISTS = frozenset("div section article main center td".split()), frozenset("ul ol li dl table tr".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

#: Each alternative ends by the next "<" or is taken once, so that reading is linear in the page.
PIECE = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?[a-zA-Z](?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?[a-zA-Z][^<>]*)>?|<[!?][^>]*>?|([^<]+|<)""", re.S | re.I)
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: The last three bits of a token's number: text, group, list, the page's own elements, anything else.
OTHER, TEXT, GROUP, LIST, PAGE = range(5)


@lru_cache(1 << 16)
def number(path: str, kind: int) -> int:
    return (xxhash.xxh64_intdigest(path) >> 1 & ~7) | kind


@lru_cache(1 << 12)
def tag_of(source: str) -> tuple[str, str, bool, bool]:
    """Name of a start tag, its name with class and id (digits are alike), whether it is no article, whether it is a header."""
    name = NAME.match(source)[1].lower()
    values = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(source[len(name) :])}
    key = ".".join([name, *sorted(values.get("class", "").split()), *([f"#{values['id']}"] if values.get("id") else [])])
    said = {w.lower() for k in ("class", "id") for w in PART.findall(values.get(k, ""))}
    other = name in OTHER_TAGS or bool(said & OTHER_WORDS) or values.get("role", "").lower() in OTHER_ROLES
    other = other or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", "")) is not None
    if name in ("html", "body"):
        other = "hidden" in values
    return name, re.sub(r"\d+", "0", key), other, name == "header" or "header" in said


class Element:
    __slots__ = ("chain", "inline", "inside", "link", "name", "other", "path")

    def __init__(self, source: str, above: Element | None):
        self.name, key, other, header = tag_of(source)
        self.inline = self.name in INLINE
        self.inside = bool(above and above.inside) or self.name in ("article", "main")
        self.link = bool(above and above.link) or self.name == "a"
        self.other = bool(above and above.other) or other or (header and not self.inside)
        self.path = (above.path if above else "") if self.inline else f"{above.path if above else ''}/{key}"
        kind = GROUP if self.name in GROUPS else LIST if self.name in LISTS else PAGE if self.name in ("html", "body") else OTHER
        if (self.name in GROUPS and above and above.inside) or self.inline:  # what lies in an article is no narrower article
            kind = OTHER
        self.chain = (above.chain if above else ()) + (() if self.inline else (number(self.path + ">", kind),))


class Block:
    __slots__ = ("chain", "heading", "inside", "links", "text", "token", "words")

    def __init__(self, at: Element | None, text: str, links: int):
        self.text, self.words, self.links = text, text.count(" ") + 1, links
        self.chain, self.inside, self.heading = (at.chain, at.inside, at.name == "h1") if at else ((), False, False)
        self.token = (xxhash.xxh64_intdigest(f"{at.path if at else ''}#{text}") >> 1 & ~7) | TEXT


def parsed(page: str) -> tuple[list[int], list[Block]]:
    """The tokens of a page in their order, and its blocks of text, without those in elements that are no article.

    Elements without end tags end where the element around them does, or where a tag of their kind starts; a paragraph
    ends where any block starts. End tags without a start are passed over.
    """
    stack: list[Element] = []
    tokens, blocks, runs, links = [], [], [], [0]

    def block():
        text = " ".join("".join(runs).split())
        if text:
            at = next((e for e in reversed(stack) if not e.inline), None)
            blocks.append(Block(at, text, min(links[0], text.count(" ") + 1)))
            tokens.append(blocks[-1].token)
        runs.clear()
        links[0] = 0

    def cut(to: int):
        block()
        del stack[to:]

    for m in PIECE.finditer(page):
        if m[4]:
            if not (stack and stack[-1].other):
                run = html.unescape(m[4])
                runs.append(run)
                if stack and stack[-1].link:
                    links[0] += len(run.split())
            continue
        source = m[2] or m[3]
        if not source:
            continue
        name = NAME.match(source)[1].lower()
        inline = name in INLINE
        if source[0] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if at is None:
                continue
            if inline:  # what has been opened inside stays open
                stack.pop(at)
                while at < len(stack):
                    stack[at].link = name != "a" and stack[at].link
                    at += 1
            else:
                block()
                tokens.append(number(stack[at].path + "<", OTHER))
                cut(at)
            continue
        if inline:
            if name == "br":
                runs.append(" ")
            if name not in VOID:
                stack.append(Element(source, stack[-1] if stack else None))
            continue
        block()
        if stack and stack[-1].name == "head" and name not in IN_HEAD:
            cut(len(stack) - 1)
        top = next((i for i in range(len(stack) - 1, -1, -1) if not stack[i].inline), None)
        if top is not None and stack[top].name == "p":
            cut(top)
        if name in ENDS:
            same, around = ENDS[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in same:
                    cut(i)
                if i < len(stack) and stack[i].name in around:
                    break
        if name not in VOID and source[-1:] != "/":
            stack.append(Element(source, stack[-1] if stack else None))
            tokens.append(stack[-1].chain[-1])
    block()
    return tokens, blocks


def tokens_of(pages: DataFrame) -> DataFrame:
    """(host, ids, counts, words, links, ranks, depths, at): each page's different tokens, and `ranks`, their places in its order."""
    names = ["host", "ids", "counts", "words", "links", "depths", "ranks"]
    kinds = [pa.string(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tokens, blocks = parsed(page)
                counts, words, links, depths = Counter(tokens), Counter(), Counter(), {}
                for b in blocks:
                    words[b.token] += b.words
                    for d, t in enumerate(b.chain):
                        words[t] += b.words
                        links[t] += b.links
                        depths[t] = d
                place = {t: i for i, t in enumerate(counts)}
                out.append((host, list(counts), list(counts.values()), [words[t] for t in counts], [links[t] for t in counts], [depths.get(t, 0) for t in counts], [place[t] for t in tokens]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    lists = "ids array<long>, counts array<long>, words array<long>, links array<long>, depths array<long>, ranks array<int>"
    return stage(pages.select("host", "html").mapInArrow(run, f"host string, {lists}").withColumn("at", F.monotonically_increasing_id()), "page-tokens")


def same_order(placed: DataFrame) -> DataFrame:
    """(site, class, order, ok) of placed(site, ids, ranks, tokens, classes), for each batch of pages the least and the greatest
    order of each class's tokens, and whether pages repeat it without a gap."""
    def run(batches):
        for batch in batches:
            least, most, ok = {}, {}, {}
            for r in batch.to_pylist():
                class_of, seen = dict(zip(r["tokens"], r["classes"], strict=True)), {}
                for rank in r["ranks"]:
                    token = r["ids"][rank]
                    if token in class_of:
                        seen.setdefault(class_of[token], []).append(token)
                for c, found in seen.items():
                    period = len(set(found))
                    order = xxhash.xxh64_intdigest(",".join(map(str, found[:period]))) >> 1
                    key = (r["site"], c)
                    ok[key] = ok.get(key, True) and all(found[i] == found[i - period] for i in range(period, len(found)))
                    least[key], most[key] = min(order, least.get(key, order)), max(order, most.get(key, order))
            out = [(*k, o, ok[k]) for k in ok for o in {least[k], most[k]}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["site", "class", "order", "ok"])

    return placed.select("site", "ids", "ranks", "tokens", "classes").mapInArrow(run, "site string, class long, order long, ok boolean")


def templates(tokens: DataFrame) -> DataFrame:
    """(host, n, main, fixed, menus) for each host of tokens: its pages, the article's element (or null), texts and menus of the template."""
    total = tokens.count()
    hosts = tokens.groupBy("host").agg(F.count("*").alias("n")).withColumn("site", F.when(F.col("n") >= LEAST_PAGES, F.concat(F.lit("="), "host")).otherwise(F.lit("")))
    hosts = stage(hosts, "hosts")
    each = tokens.select("host", "at", F.explode(F.arrays_zip("ids", "counts", "words", "links", "depths")).alias("t")).select("host", "at", F.col("t.ids").alias("token"), F.col("t.counts").alias("count"), "t.words", "t.links", "t.depths")

    def combined(df: DataFrame, n, a, b, key: str) -> DataFrame:
        return df.groupBy(key, "token").agg(n.alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"), F.max("count").alias("count"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.max("depths").alias("depths"))

    by_host = combined(each, F.count("*"), F.xxhash64("at", "count"), F.xxhash64("count", "at", F.lit(1)), "host")
    sites = hosts.groupBy("site").agg(F.sum("n").alias("pages"), F.count("*").alias("hosts"))
    vectors = combined(by_host.join(hosts.select("host", "site"), "host"), F.sum("n"), F.col("a"), F.col("b"), "site").join(sites, "site")
    text = F.col("token") % 8 == TEXT
    common = vectors.where(F.when(text, (F.col("n") >= TEXT_PAGES) & (F.col("n") >= F.col("pages") * TEXT_SHARE)).otherwise(F.col("n") >= F.greatest(F.lit(2), F.col("pages") * TAG_SHARE)))
    common = stage(common.withColumn("class", F.xxhash64("a", "b", "n")), "vectors")
    lists = common.groupBy("site").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes"))  # at most 2 x a mean page's tokens
    per_host = lookup(hosts, lists.join(sites, "site"), ["site"], "hosts", hosts.count(), F.xxhash64("host")).select("host", "n", "site", "tokens", "classes")
    placed = lookup(tokens.select("host", "ids", "ranks", "at"), per_host.where("tokens is not null"), ["host"], "n", total, F.xxhash64("at")).where("tokens is not null")
    orders = same_order(placed).groupBy("site", "class").agg(F.min("order").alias("low"), F.max("order").alias("high"), F.min("ok").alias("ok"))
    valid = stage(common.join(orders.where("ok and low = high").select("site", "class"), ["site", "class"]), "classes")
    kind = F.col("token") % 8
    mass = F.col("words") - F.col("links")
    whole = each.where(kind == TEXT).groupBy("host").agg(F.sum("words").alias("words")).join(hosts.select("host", "site"), "host").groupBy("site").agg(F.sum("words").alias("all"))
    own = valid.where((kind == GROUP) & (F.col("count") == 1)).join(whole, "site").where(mass > F.col("all") * MAIN_SHARE).groupBy("site").agg(F.max_by("token", F.struct(-mass, "depths", "token")).alias("main"))
    texts = valid.where(kind == TEXT).join(whole, "site").groupBy("site", "all").agg(F.sum("words").alias("held"), F.collect_list("token").alias("fixed")).where(F.col("held") <= F.col("all") * FIXED_SHARE).select("site", "fixed")
    menus = valid.where(kind.isin(GROUP, LIST) & (F.col("words") > 0) & (F.col("links") > F.col("words") * LINK_SHARE)).groupBy("site").agg(F.collect_list("token").alias("menus"))
    found = sites.join(own, "site", "left").join(texts, "site", "left").join(menus, "site", "left").drop("pages")
    return stage(lookup(hosts, found, ["site"], "hosts", hosts.count(), F.xxhash64("host")).select("host", "n", "main", "fixed", "menus"), "templates")


def extracted(page: str, main: int | None, fixed: set, menus: set) -> str:
    blocks = parsed(page)[1]
    inner = [b for b in blocks if main in b.chain]
    if inner:  # a title may stand before the article's element
        first = next(i for i, b in enumerate(blocks) if main in b.chain)
        inner = [b for b in blocks[:first] if b.heading] + inner
    else:
        inner = [b for b in blocks if b.inside] or blocks
    return "\n".join(b.text for b in inner if b.token not in fixed and not menus.intersection(b.chain))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages(page_id, url, html): its main text, "" if it has none.

    Blocks are joined by one line feed, white space in a block (any that Unicode calls so) is one space. Pages without the
    template's main element give what lies in their articles, or else all that no tag or name calls something else.
    Odd cases: a null html is empty, a page without a host (null url, no "://") is of the host ""; repeated rows and null ids
    are pages like any; an empty table gives an empty result; other columns are ignored. A host's pages may be any share
    of the table: hosts with more than a thousandth of it are broadcast with their templates, the others' pages are shuffled.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit(""))).withColumn("host", host_and_path(F.col("url").cast("string"))[0])
    tokens = tokens_of(rows)
    total = tokens.count()
    found = templates(tokens)
    parts = ["main", "fixed", "menus"]
    big, small = found.where(is_heavy("n", total)).drop("n"), found.where(~is_heavy("n", total)).drop("n")
    near = rows.join(F.broadcast(big), "host")
    far = rows.join(F.broadcast(big.select("host")), "host", "left_anti").join(small, "host")
    names, kinds = [f for f in ("page_id", "url")], rows.schema

    def run(batches):
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("html", *parts)]
            texts = [extracted(page, main, set(fixed or ()), set(menus or ())) for page, main, fixed, menus in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in names) + ", text string"
    out = near.unionByName(far).select("page_id", "url", "html", *parts).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
