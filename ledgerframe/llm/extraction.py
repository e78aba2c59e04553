"""HTML extraction: a host's template from equivalence classes of tokens, and the article from what it leaves.

Every page becomes a sequence of tokens: element starts with their path,
and text blocks with path and text. Over the pages of a host a token has
an occurrence vector (how often it stands in each page). Vectors are never
gathered: each is summed up as two additive fingerprints, its support and
its total, so a hot host only adds numbers. Tokens of one host with equal
vectors form a class, which must be large and frequent enough. Classes nest
by support: those on all pages are the root, rarer ones lie in the slots
between. Order and nesting are checked on each page: members out of their
class's order, or alone in a slot of the outer classes, are no template there. Text that is
itself a template token is the template's, inside article elements too; the
remaining slots hold data, and the article is read from them: from all
article elements or main if the page has one, else from all data slots, without elements
that name themselves as page furniture by a whole class name, id or role
(never those that hold most of the main text).
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, sql_type, stored, utf8

#: pages of a host below which nothing is deduced, share of them a class must stand on, tokens a class needs
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.5, 2
#: distinct tokens a task counts before it hands them on
FLUSH_TOKENS = 200_000

#: element names with fixed roles in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
FURNITURE = frozenset("head nav header footer aside script style noscript template iframe object svg canvas button "
                      "select menu dialog textarea audio video".split())
RAW = frozenset("script style noscript template iframe textarea svg title".split())
#: elements that end where one of the named elements starts
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: class, id and role words by which page furniture names itself
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations widget pagination pager skip login search complementary "
    "contentinfo teaser outbrain taboola".split())
#: words of NAMED that name furniture beside any other word, unless one says that something merely has or lacks it
TELLING = frozenset("ads advert adverts advertisement sponsored cookie cookies newsletter breadcrumb breadcrumbs sidebar comment comments "
                    "disqus related recommended recommendations sharing".split())
STATES = frozenset("has with without no not open closed enabled disabled on off".split())
READERS, SAYINGS = frozenset("user users reader readers customer customers visitor visitors".split()), frozenset("review reviews rating ratings".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements within a line of text that have none of their own
SILENT = frozenset("img wbr picture source track area map".split())
#: share of an article's text that must be its own before the template's blocks in it go, and of a card's text in links
OWN_SHARE, LINK_SHARE = 0.25, 0.5
#: hosts with this share of all pages are hot; there are fewer of them than this number
HOT_SHARE = 256
#: words that say nothing beside those
FILLER = frozenset("site page box list section wrap wrapper container area links block top bottom left right bar global form "
                   "buttons icons item items".split())
#: class, id and role words by which an article names itself where no article element does
BODY_NAMED = frozenset("article post entry story content main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    token: int
    furniture: bool
    article: int  # number of the article element it stands in, 0: none
    main: bool
    named: tuple[int, ...]  # numbers of the elements around it that name themselves furniture
    heading: bool
    linked: int  # characters inside links


def _attributes(raw: str) -> tuple[list[set[str]], bool, str]:
    """Words of each name in class, id and role; whether the element is hidden; class as written."""
    names: list[set[str]] = []
    hidden, shown = False, ""
    if raw.strip():
        for name, a, b, c in _NAMES.findall(raw):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id", "role"):
                names += [{x for x in _SPLIT.split(n) if x} for n in value.lower().split()]
                shown = value if name == "class" else shown
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    return names, hidden, shown


def _names_furniture(n: set[str], inside: bool) -> bool:
    """Whether the words of one class, id or role name page furniture."""
    if n & STATES:
        return False
    return bool(n & NAMED and n <= NAMED | FILLER or n & TELLING or n & READERS and n & SAYINGS
                or "header" in n and n <= FILLER | {"header"} and not inside)


def _token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def parse(page: str) -> tuple[list[int], list[Block]]:
    """Tokens of a page in order, and its text blocks."""
    found: list[int] = []
    blocks: list[Block] = []
    # open elements: name, path, furniture, article number, main or named like an article body, named like furniture
    stack: list[tuple[str, str, bool, int, bool, tuple[int, ...]]] = [("", "", False, 0, False, ())]
    piece: list[str] = []
    articles = named_so_far = linked = 0
    has_main = in_link = False

    def flush():
        nonlocal linked
        if piece:
            text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
            piece.clear()
            if text:
                name, path, furniture, article, main, named = stack[-1]
                found.append(_token(path, "#", text))
                blocks.append(Block(text, found[-1], furniture, article, main, named, name in HEADINGS, min(linked, len(text))))
        linked = 0

    at, lower = 0, None
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece.append(page[at:m.start()])
            linked += m.start() - at if in_link else 0
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end = name.lower(), bool(m[1] or m[4])
        if name in SILENT:
            continue
        if name == "a":
            in_link = not end
        if name in INLINE:
            hidden = not end and _attributes(m[3] or m[6] or "")[1]
            if not hidden and not (end and stack[-1][0] == name):
                continue
        if name == "br":
            piece.append(" ")
            continue
        if name in RAW:  # what it holds is no text; the line around it goes on
            if end:
                continue
            lower = page.lower() if lower is None else lower
            close = lower.find(f"</{name}", at)
            at = len(page) if close < 0 else close
            continue
        flush()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID or (m[3] or m[6] or "").endswith("/") and name not in FURNITURE:
            continue
        names, hidden, shown = _attributes(m[3] or m[6] or "")
        if stack[-1][0] == "p" and name not in INLINE:
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in ("ul", "ol", "table", "dl", "select", "div", "article"):
                break
        _, path, furniture, article, main, named = stack[-1]
        path = f"{path}/{name}" + (f".{shown}" if shown else "")
        inside = article or main
        furniture = furniture or hidden or (name in FURNITURE and not (name == "header" and inside))
        if name == "form" or name not in ("html", "body", "main") and any(_names_furniture(n, inside) for n in names):
            named_so_far += 1
            named += (named_so_far,)
        if name == "article":
            articles += 1
            article = article or articles
        has_main = has_main or name == "main"
        main = main or name == "main" or name not in ("html", "body") and any(n & BODY_NAMED and not n & NAMED for n in names)
        found.append(_token(path))
        stack.append((name, path, furniture, article, main, named))
    if at < len(page):
        piece.append(page[at:])
    flush()
    _judge_names(blocks, articles > 0, has_main)
    return found, blocks


def _judge_names(blocks: list[Block], has_article: bool, has_main: bool) -> None:
    """Blocks in elements named as furniture are furniture, unless the element holds most of the main text."""
    shown = [b for b in blocks if not b.furniture]
    if has_article:
        size: dict[int, int] = {}
        for b in shown:
            size[b.article] = size.get(b.article, 0) + len(b.text) if b.article else 0
        best = max(size, key=lambda a: (size[a], -a), default=0)
        core = [b for b in shown if b.article and b.article == best]
    else:
        core = [b for b in shown if b.main] or ([] if has_main else shown)
    held: dict[int, list[int]] = {}
    for b in core:
        for e in b.named:
            held.setdefault(e, []).append(len(b.text))
    total = sum(len(b.text) for b in core)
    # on a page that names no main text, one long notice does not make an element of it
    least = 1 if has_article or has_main or any(b.main for b in core) else 2
    spared = {e for e, sizes in held.items() if 2 * sum(sizes) > total and len(sizes) >= least}
    for b in shown:
        b.furniture = not spared.issuperset(b.named)


def standing(found: list[int], classes: list[tuple[int, list[int]]]) -> set[int]:
    """Tokens of ``classes`` (pages, members in order), outer classes first, that stand on a page in order and nested.

    A class counts apart in each slot of the classes on more pages than its
    own, and there only members that follow one another in its order, if
    they are enough.
    """
    place: dict[int, int] = {}
    for i, t in enumerate(found):
        place.setdefault(t, i)
    out: set[int] = set()
    edges: list[int] = []
    last = None
    for n, members in classes:
        if n != last:
            edges, last = sorted(place[t] for t in out), n
        parts: dict[int, list[int]] = {}
        for t in members:
            if t in place:
                parts.setdefault(bisect_left(edges, place[t]), []).append(t)
        for part in parts.values():
            # longest run of members in order
            ends: list[int] = []  # least place at which a run of each length ends, and the member that ends it
            who: list[int] = []
            before: list[int] = []
            for j, t in enumerate(part):
                k = bisect_left(ends, place[t])
                ends[k:k + 1], who[k:k + 1] = [place[t]], [j]
                before.append(who[k - 1] if k else -1)
            if len(ends) >= MIN_TOKENS:
                j = who[-1]
                while j >= 0:
                    out.add(part[j])
                    j = before[j]
    return out


def article_text(page: str, classes: list[tuple[int, list[int]]] | set) -> str:
    """The main text of a page beside its host's template; blocks joined by one newline.

    Where elements tell the main text (articles, else main or what is named
    like an article body), the template's blocks in it go, but for headings over
    data; if too little were left, as on copies of one article, it stays
    whole. Elsewhere every data slot counts. Articles beside the largest that
    are mostly links are cards of other pages.
    """
    found, blocks = parse(page)
    template = standing(found, list(classes))
    shown = [b for b in blocks if not b.furniture]
    inside = [b for b in shown if b.article]
    if inside:
        size: dict[int, int] = {}
        links: dict[int, int] = {}
        for b in inside:
            size[b.article] = size.get(b.article, 0) + len(b.text)
            links[b.article] = links.get(b.article, 0) + b.linked
        most = max(size, key=lambda a: (size[a] - links[a], -a))
        inside = [b for b in inside if b.article == most or links[b.article] <= LINK_SHARE * size[b.article]]
    inside = inside or [b for b in shown if b.main]
    own = sum(len(b.text) for b in inside if b.token not in template)
    if inside and own < OWN_SHARE * sum(len(b.text) for b in inside):
        return "\n".join(b.text for b in inside)
    left, over_data = [], False
    for b in reversed(inside or shown):
        own_text = b.token not in template
        if own_text or b.heading and over_data:
            left.append(b.text)
        over_data = (over_data or own_text) and not b.heading
    if not left:
        left = [b.text for b in reversed(shown)]  # all text is the template's: copies of one page, which tell nothing apart
    return "\n".join(reversed(left))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def occurrence_vectors(pages: DataFrame, url: str, html: str, key: str) -> DataFrame:
    """(host, token) with support, total and two additive fingerprints of the occurrence vector; token 0 counts pages.

    A page adds (31 random bits of its identity) x (its count), so sums stay exact
    in 64 bits for 2^31 token occurrences a host.
    """
    source = pages.select(
        host_of(pages[url]).alias("host"),
        F.xxhash64(pages[key].cast("string"), pages[url].cast("string"), F.monotonically_increasing_id()).alias("__page"),
        pages[html].cast("string").alias("__html")).where("host != ''")

    def run(batches):
        counts: dict[tuple[str, int], list[int]] = {}

        def flush():
            keys = list(counts)
            rows = list(counts.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
                + [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                names=["host", "token", "pages", "total", "f1", "f2", "place"])
            counts.clear()

        for batch in batches:
            hosts, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))
            for host, page_id, text in zip(hosts, ids, texts):
                found, _ = parse(text.decode())
                here: dict[int, int] = {0: 1}
                first: dict[int, int] = {}
                for i, t in enumerate(found):
                    here[t] = here.get(t, 0) + 1
                    first.setdefault(t, i)
                a, b = page_id & 0x7FFFFFFF, (page_id >> 32) & 0x7FFFFFFF
                for t, n in here.items():
                    old = counts.get((host, t))
                    if old is None:
                        counts[host, t] = [1, n, a * n, b * n, first.get(t, 0)]
                    else:
                        old[0] += 1
                        old[1] += n
                        old[2] += a * n
                        old[3] += b * n
                        old[4] += first.get(t, 0)
                if len(counts) >= FLUSH_TOKENS:
                    yield from flush()
        if counts:
            yield from flush()

    names = ("pages", "total", "f1", "f2", "place")
    partial = source.mapInArrow(run, "host string, token bigint, " + ", ".join(f"{n} bigint" for n in names))
    return partial.groupBy("host", "token").agg(*[F.sum(n).alias(n) for n in names])


def templates(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id",
              min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per host: its frequent classes (pages, tokens in their mean order), outer classes first.

    Tokens on at least ``min_share`` of a host's pages number at most
    1/min_share times the tokens of a mean page, so a row is bounded by
    the size of pages and not by their number.
    """
    vectors = occurrence_vectors(pages, url, html, key)
    is_host = F.col("token") == 0
    # the page count of a host reaches its tokens by a join with one row per host
    hosts = vectors.where(is_host).select(F.col("host").alias("__host"), F.col("pages").alias("__pages"))
    frequent = (vectors.where(~is_host & (F.col("pages") >= min_pages))
                .join(hosts, F.col("host") == F.col("__host"))
                .where(F.col("pages") >= min_share * F.col("__pages")))
    classes = (frequent.groupBy("host", "pages", "total", "f1", "f2")
               .agg(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "token")).alias("members"))
               .where(F.size("members") >= min_tokens))
    nested = classes.groupBy("host").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("pages")).alias("outer"), F.sort_array("members").alias("members")))).alias("classes"))
    nested = nested.join(hosts, F.col("host") == F.col("__host"))
    return nested.select("host", F.col("__pages").alias("host_pages"), F.transform("classes", lambda c: F.struct(
        (-c["outer"]).alias("pages"), F.transform(c["members"], lambda m: m["token"]).alias("tokens"))).alias("classes"))


def extracted(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` of the article of every page.

    Null or empty html: empty text. Pages without a host, or on a host
    with too few pages, are read by their elements alone. Equal pages
    give equal texts. The templates of hot hosts (fewer than ``HOT_SHARE``,
    each bounded by the size of a page) are broadcast, so that no task gets
    all pages of a host; the others are joined by host.
    """
    deduced = stored(templates(pages, url, html, key), "templates")
    all_pages = deduced.agg(F.sum("host_pages")).first()[0] or 0
    hot = deduced.where(F.col("host_pages") * HOT_SHARE > all_pages).select(F.col("host").alias("__hot"), F.col("classes").alias("__hot_classes"))
    cold = deduced.where(F.col("host_pages") * HOT_SHARE <= all_pages).select("host", F.col("classes").alias("__classes"))
    kept = [pages[c].alias(f"__k{i}") for i, c in enumerate(keep)]
    source = pages.select(*kept, host_of(pages[url]).alias("__host"), pages[html].cast("string").alias("__html"))
    met = source.join(F.broadcast(hot), F.col("__host") == F.col("__hot"), "left")
    columns = [f"__k{i}" for i in range(len(keep))]
    joined = met.where("__hot IS NOT NULL").select(*columns, F.col("__hot_classes").alias("__classes"), "__html").unionAll(
        met.where("__hot IS NULL").join(cold, F.col("__host") == F.col("host"), "left").select(*columns, "__classes", "__html"))
    n_keep = len(keep)
    ddl = ", ".join(f"__k{i} {sql_type(pages, c)}" for i, c in enumerate(keep))

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(n_keep + 1))
            for a, b in slices([len(t) for t in texts]):
                out = []
                for classes, text in zip(batch.column(n_keep).slice(a, b - a).to_pylist(), texts[a:b]):
                    out.append(article_text(text.decode(), [(c["pages"], c["tokens"]) for c in classes or ()]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(n_keep)]
                    + [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    names=[f"__k{i}" for i in range(n_keep)] + ["text", "n_chars"])

    result = joined.mapInArrow(run, f"{ddl}, text string, n_chars bigint")
    return result.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
