"""Main text of web pages, with wrappers inferred per host as union-free regular expressions.

Inference: a page becomes a token stream of block tags and texts. Runs of any length that repeat at once
fold into `( ... )+` groups. The streams of one host are aligned pairwise, again and again: texts that
differ become slots (`#`), tokens that only one side has become optional (`( ... )?`), and a group on one
side absorbs its single occurrences on the other. Every item of the wrapper knows whether its text is the
same wherever it stands, and whether two differing pages have it. Streams with equal skeletons are merged
where they are read; what is left is merged in rounds of bounded groups of one host, so a host with a
third of all pages gathers in no task.

Extraction: a page is matched with its host's wrapper, so that every text has a place in it, and the place
decides. The content regions are the elements in which texts vary: articles that hold varying texts, else
main elements that do, else the innermost containers of varying texts. Texts outside of them are template
or belong to another part of the page; texts inside stay, the same on all pages or not. Names of elements
and words in class, id or role label the nodes: menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments go wherever they stand; words that an article may use for its own
parts, such as `share` or `related`, only where the wrapper too says that the text is the same on all pages.
A text that is on one page only varies, so copies of one page make no template, and a host with a single
page is decided by its labels alone.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import durable
from quotemill.llm.url_filter import host_of

#: Streams that one task aligns at once.
FAN_IN = 32
#: Wrappers are broadcast up to this many bytes; beyond it, pages and wrappers are shuffled by host.
MAX_BROADCAST_BYTES = 16 << 20

#: Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math select".split())
BOILERPLATE = frozenset("nav footer aside form head button dialog menu".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_SAME = frozenset("li dt dd td th tr option thead tbody tfoot".split())
#: Elements that hold a piece of text and aren't a part of the page of their own.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot caption figcaption pre blockquote summary legend address".split())
#: Words in class, id or role that name what is not the article; the second ones may also name a part of an article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navigation navbar breadcrumb breadcrumbs "
    "footer comment comments respond cookie cookies consent notice notices newsletter subscribe signup pagination pager".split()
)
UNSURE_WORDS = frozenset("masthead discussion alert popup modal overlay share sharing social related recommended widget toolbar disclaimer complementary contentinfo search".split())
FOREIGN_WORDS = frozenset("ad ads advert advertisement comment comments sponsored".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
NAMED = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes or text): kind is open, close or text. Comments and raw elements' bodies go."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if not m[0].startswith(("<!", "<?")) or m[0] == "<":
                yield "text", "", m[0]
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        attributes = m[3] or m[6] or ""
        yield "open", name, attributes
        if name in RAW and not attributes.rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            yield "close", name, ""


def _noise(name: str, attributes: str, in_article: bool) -> int:
    """2: none of the article; 1: only if the wrapper says so too; 0: may be the article."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return 2
    if "=" not in attributes or name in ("html", "body"):
        return 0
    names = [n for m in NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    words = {w for n in names for w in re.split(r"[^a-z]+", n)}
    if name in ("article", "main"):
        return 2 if words & FOREIGN_WORDS else 0
    if in_article and not words & FOREIGN_WORDS:  # there a word that is but a part of a name (menu-card) needs the wrapper's consent
        whole = any(set(re.split(r"[^a-z]+", n)) - {""} <= NOISE_WORDS for n in names if re.search("[a-z]", n))
        return 2 if whole else 1 if words & (NOISE_WORDS | UNSURE_WORDS) else 0
    return 2 if words & NOISE_WORDS else (1 if in_article else 2) if words & UNSURE_WORDS else 0


# A block is (text, noise, node); a node is (tag token, parent node). A tag token is the element's name and
# first class, then ! or ? for noise 2 or 1 and * for a main role: <div.side!>, </div>.


def parse(page: str | None) -> tuple[list[str], list[tuple]]:
    """The token stream, with # for every block of text, and the blocks."""
    stream: list[str] = []
    blocks: list[tuple] = []
    stack: list[tuple] = [("", False, 0, None)]  # name, in an article, noise, node: all but the name inherited
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                stream.append("#")
                blocks.append((text, *stack[-1][2:]))

    def close(name: str, barrier: frozenset[str] = frozenset()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == name:
                del stack[depth:]
                return
            if stack[depth][0] in barrier:
                return

    for kind, name, value in tokens(page or ""):
        if kind == "text":
            parts.append(html.unescape(value) if "&" in value else value)
            continue
        block = name in BLOCK or name in RAW
        if block:
            flush()
        if kind == "close":
            if block:
                stream.append(f"</{name}>")
            close(name)
            continue
        if name == "br":
            parts.append("\n")
        if name in VOID:
            if block:
                stream.append(f"<{name}>")
            continue
        if name in BLOCK:
            close("p", frozenset(("td", "th", "table", "button")))
        if name in CLOSED_BY_SAME:
            close(name, frozenset(("ul", "ol", "dl", "table", "select")))
        _, article, noise, node = stack[-1]
        own = _noise(name, value, article)
        if block:
            shown = re.search(r"class\s*=\s*[\"']?([\w-]+)", value) if value else None
            main = name == "main" or (value and re.search(r"role\s*=\s*[\"']?main\b", value))
            token = f"<{name}{'.' + shown[1].lower() if shown else ''}{('', '?', '!')[own]}{'*' if main else ''}>"
            stream.append(token)
            node = (token, node)
        stack.append((name, article or name == "article", max(noise, own), node))
    flush()
    return stream, blocks


# A wrapper item is [token, optional, text, least page, greatest page]; the token of a text is "#", that of a
# repeated group "(a b c)+". The text is that of all pages which have the item (the parts of a group joined),
# None where they differ; the pages are the smallest and largest hash of those that have it.


@lru_cache(512)
def _again(size: int) -> re.Pattern:
    """Finds a run of `size` characters that starts again at once."""
    return re.compile(rf"(?=(.{{{size}}})\1)", re.S)


@lru_cache(4096)
def _open(token: str, names: frozenset[str] | None = None) -> int:
    """Elements that a token opens less those that it closes; names: only these, else all but LEAF."""
    found = [(slash, name) for slash, name in re.findall(r"<(/?)(\w+)", token) if name not in VOID]
    return sum(-1 if slash else 1 for slash, name in found if (name in names if names else name not in LEAF))


def _closed(run: list[str]) -> bool:
    """Whether a run opens what it closes and leaves nothing open but what HTML lets a follower close."""
    stack: list[str] = []
    for slash, name in re.findall(r"<(/?)(\w+)", " ".join(run)):
        if not slash:
            stack += [name] if name not in VOID else []
        elif name in stack:
            while stack.pop() != name:
                pass
        else:
            return False
    return LEAF.issuperset(stack)


def fold(stream: list[str]) -> list[tuple[str, int]]:
    """(token, number of texts): closed runs that repeat at once become groups, the shortest runs first.

    Tokens are numbered, and a pattern tells whether a run of a length starts again anywhere. Such runs have
    equal tokens at the distance of their length, as many in a row as they are long; sums of opened elements
    tell most of those that aren't closed.
    """
    known: dict[str, int] = {}
    opens: list[tuple[int, int]] = []  # per known token: containers and leaves that it opens

    def numbered(names: list[str]) -> list[int]:
        for t in names:
            if t not in known:
                known[t] = len(known)
                opens.append((_open(t), _open(t, LEAF)))
        return [known[t] for t in names]

    names, counts = list(stream), [int(t == "#") for t in stream]
    numbers = numbered(names)
    coded = "".join(map(chr, numbers))
    size = 1
    while 2 * size <= len(names):
        if not _again(size).search(coded):
            size += 1
            continue
        ids = np.array(numbers)
        depth = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(np.array(opens)[ids], axis=0)))
        gaps = np.concatenate((np.flatnonzero(ids[size:] != ids[:-size]), [len(ids) - size]))
        at = np.arange(len(ids) - 2 * size + 1)
        likely = (gaps[np.searchsorted(gaps, at)] >= at + size) & (depth[at + size, 0] == depth[at, 0]) & (depth[at + size, 1] >= depth[at, 1])
        found, done = [], 0
        for start in np.flatnonzero(likely).tolist():
            if start >= done and _closed(names[start : start + size]):
                gap = int(gaps[np.searchsorted(gaps, start)])
                done = start + (gap - start) // size * size + size
                found.append((start, done))
        for start, stop in reversed(found):
            run = names[start : start + size]
            names[start:stop] = [run[0] if size == 1 and run[0].endswith(")+") else "(" + " ".join(run) + ")+"]
            counts[start:stop] = [sum(counts[start:stop])]
        if found:
            numbers = numbered(names)
            coded = "".join(map(chr, numbers))
        size = 1 if found else size + 1  # a group may stand in a shorter run
    return list(zip(names, counts, strict=True))


def _short(text: str) -> str:
    return text if len(text) <= 40 else xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def page_items(page: str | None) -> tuple[list[list], list[int], list[tuple]]:
    """The folded stream of one page as wrapper items, the number of texts of each, and the blocks."""
    stream, blocks = parse(page)
    own = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1
    items, counts, at = [], [], 0
    for token, n in fold(stream):
        items.append([token, False, "\x1f".join(_short(b[0]) for b in blocks[at : at + n]), own, own])
        counts.append(n)
        at += n
    return items, counts, blocks


def _absorb(items: list[list], groups: Iterable[str]) -> tuple[list[list], list[int]]:
    """Turn single occurrences of `groups` into groups; also how many items each one was."""
    spans = [1] * len(items)
    names = [x[0] for x in items]
    for group in sorted(groups, key=lambda g: (-len(g), g)):
        body = group[1:-2].split(" ")
        if "(" in group[1:] or body[0] not in names:
            continue
        at = 0
        while at + len(body) <= len(items):
            stop = at + len(body)
            if names[at] == body[0] and names[at:stop] == body:
                part = items[at:stop]
                texts = [x[2] for x in part if "#" in x[0]]
                one = [group, any(x[1] for x in part), None if None in texts else "\x1f".join(texts), min(x[3] for x in part), max(x[4] for x in part)]
                items, spans = items[:at] + [one] + items[stop:], spans[:at] + [sum(spans[at:stop])] + spans[stop:]
                names = names[:at] + [group] + names[stop:]
            at += 1
    return items, spans


def _groups(items: list[list]) -> set[str]:
    return {x[0] for x in items if x[0].endswith(")+")}


def _opcodes(left: list[str], right: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Opcodes that turn left into right; what both begin and end with is compared directly."""
    most = min(len(left), len(right))
    a = next((k for k in range(most) if left[k] != right[k]), most)
    b = next((k for k in range(most - a) if left[-1 - k] != right[-1 - k]), most - a)
    middle = SequenceMatcher(None, left[a : len(left) - b], right[a : len(right) - b], autojunk=False).get_opcodes()
    inner = [(op, i + a, j + a, k + a, m + a) for op, i, j, k, m in middle]
    return [("equal", 0, a, 0, a), *inner, ("equal", len(left) - b, len(left), len(right) - b, len(right))]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper that generalises both."""
    groups = _groups(a) | _groups(b)
    a, b = _absorb(a, groups)[0], _absorb(b, groups)[0]
    out: list[list] = []
    for op, i, j, k, m in _opcodes([x[0] for x in a], [x[0] for x in b]):
        if op == "equal":
            out += [[x[0], x[1] or y[1], x[2] if x[2] == y[2] else None, min(x[3], y[3]), max(x[4], y[4])] for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[x[0], True, *x[2:]] for x in a[i:j] + b[k:m]]
    return out


class Wrapper:
    """A host's wrapper, ready to be matched: which of its items are content and which are template.

    inside: per item True or False, None if the item's texts differ in that. template: the text is the
    same on all pages that have it, and two differing pages do. A tie between equally long matches goes
    to the first one in the page.
    """

    def __init__(self, items: list[list]) -> None:
        self.names, self.groups, self.matched = [x[0] for x in items], _groups(items), {}
        self.template = [x[2] is not None and x[3] != x[4] for x in items]
        texts = []  # item, its open elements
        stack: list[tuple[int, str]] = []  # number and token
        opened = 0
        for at, name in enumerate(self.names):
            for token in re.findall(r"<[^>]*>|#", name):
                element = re.match(r"</?(\w*)", token)
                if token == "#":
                    texts.append((at, list(stack)))
                elif token[1] == "/":
                    depth = next((d for d in range(len(stack) - 1, -1, -1) if re.match(r"<(\w*)", stack[d][1])[1] == element[1]), None)
                    if depth is not None:
                        del stack[depth:]
                elif element[1] not in VOID:
                    opened += 1
                    stack.append((opened, token))
        varying = [(at, path) for at, path in texts if not self.template[at] and not any("!" in t for _, t in path)]
        regions: set[tuple] = {e for _, path in varying for e in path if e[1].startswith("<article")}
        regions = regions or {e for _, path in varying for e in path if e[1].endswith("*>")}
        alone = set()
        if not regions:
            for at, path in varying:
                held = next((e for e in reversed(path) if re.match(r"<(\w*)", e[1])[1] not in LEAF), None)
                if held is None or held[1].startswith(("<body", "<html")):
                    alone.add(at)
                else:
                    regions.add(held)
        self.regions = {t for _, t in regions}
        found: dict[int, set[bool]] = {}
        for at, path in texts:
            found.setdefault(at, set()).add(at in alone or not regions.isdisjoint(path))
        self.inside = [next(iter(found[at])) if len(found.get(at, ())) == 1 else None for at in range(len(items))]

    def places(self, items: list[list], counts: list[int]) -> list[int]:
        """The wrapper's item for each text of a page, -1 where none fits."""
        key = " ".join(x[0] for x in items)
        if key not in self.matched:
            if len(self.matched) > 500:
                self.matched.clear()
            whole, spans = _absorb(items, self.groups)
            at = [-1] * len(whole)
            for op, i, j, k, _ in _opcodes([x[0] for x in whole], self.names):
                if op == "equal":
                    at[i:j] = range(k, k + j - i)
            self.matched[key] = [place for place, span in zip(at, spans, strict=True) for _ in range(span)]
        return [place for place, n in zip(self.matched[key], counts, strict=True) for _ in range(n)]


def _in_article(node: tuple | None) -> int:
    """2: in an article; 1: in an element with the main role; 0: in neither."""
    found = 0
    while node:
        token, node = node
        if token.startswith("<article"):
            return 2
        found = max(found, int(token.endswith("*>")))
    return found


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The content blocks of a page joined by line feeds; without a wrapper the page's own is taken.

    Content is what stands in the wrapper's content regions. A page's articles are so even if the wrapper takes them for
    template, as where a host has a story twice, unless the regions hold more text than these articles do: then
    they are teasers. If nothing is left, all blocks without noise that aren't template are given, and if there is none, those that are.
    """
    items, counts, blocks = page_items(page)
    wrapper = wrapper or Wrapper(items)
    kept, own, other, template = [], [], [], []  # kept and own: (block number, text)
    for k, (place, (text, noise, node)) in enumerate(zip(wrapper.places(items, counts), blocks, strict=True)):
        same = place >= 0 and wrapper.template[place]
        if noise == 2 or (noise == 1 and same):
            continue
        role = _in_article(node)
        inside = wrapper.inside[place] if place >= 0 else None
        if inside is None:
            inside = not wrapper.regions
            while node and not inside:
                inside, node = node[0] in wrapper.regions, node[1]
        if inside:
            kept.append((k, text, role))
        elif role:
            own.append((k, text, role))
        (template if same else other).append(text)
    most = max((role for _, _, role in kept + own), default=0)  # an element with the main role counts where no article is
    missed = [x for x in own if x[2] == most]
    if missed and sum(len(x[1]) for x in missed) >= sum(len(x[1]) for x in kept):
        kept = sorted(missed + [x for x in kept if x[2] == most])
    return "\n".join([text for _, text, _ in kept] or other or template)


def as_pattern(items: list[list]) -> str:
    """The wrapper as a union-free regular expression."""
    shown = [(json.dumps(x[2], ensure_ascii=False) if x[0] == "#" and x[2] is not None else x[0], x[1]) for x in items]
    return " ".join(f"({t})?" if optional else t for t, optional in shown)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """(host, n_pages, wrapper): the wrapper of every host as a JSON list of items.

    A null or odd url belongs to the host ''. A null page is an empty stream. Alignment order is fixed
    by the streams' text, so the result doesn't depend on partitions once skeletons are merged.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple[str, str], list] = {}

        def out() -> pa.RecordBatch:
            hosts = [h for h, _ in merged]
            wrappers = [json.dumps(m[1]) for m in merged.values()]
            counts = [m[0] for m in merged.values()]
            merged.clear()
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(counts, pa.int64()), pa.array(wrappers, pa.string())], ["host", "n_pages", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                items = page_items(page.as_py())[0]
                key = (host, " ".join(x[0] for x in items))
                if key not in merged:
                    merged[key] = [1, items]
                    continue
                held = merged[key]
                held[0] += 1
                for x, y in zip(held[1], items, strict=True):
                    x[2] = x[2] if x[2] == y[2] else None
                    x[3], x[4] = min(x[3], y[3]), max(x[4], y[4])
            if len(merged) > 1000:
                yield out()
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("wrapper").to_pylist(), table.column("n_pages").to_pylist(), strict=True))
        items = json.loads(found[0][0])
        for text, _ in found[1:]:
            items = align(items, json.loads(text))
        return pa.table({"host": [table.column("host")[0].as_py()], "n_pages": [sum(n for _, n in found)], "wrapper": [json.dumps(items)]})

    schema = "host string, n_pages long, wrapper string"
    current = durable(rows.mapInArrow(scan, schema))
    while True:
        most = current.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return current
        sizes = current.groupBy("host").agg(F.ceil(F.count("*") / fan_in).alias("groups"))
        dealt = current.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper", "n_pages"), F.col("groups")))
        current = durable(dealt.groupBy("host", "part").applyInArrow(merge, schema))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`, by its host's wrapper.

    A null or empty page, or one without content, has an empty text. Repeated rows are read each on
    their own. Cut-off pages end all their elements at their end. Whole pages are read. White space is
    what Unicode says it is, so a decoded &nbsp; is. Pages whose url names no host have nothing in common
    and are read each by its own wrapper. An empty table gives an empty result. Other columns aren't read.
    """
    wrappers = durable(infer_wrappers(pages, url_col, html_col).where(F.col("host") != ""))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    wrappers = wrappers.select("host", "wrapper")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(wrappers) if size <= MAX_BROADCAST_BYTES else wrappers, "host", "left").select("page_id", "url", "html", "wrapper")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper | None] = {None: None}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html"), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[wrapper] = Wrapper(json.loads(wrapper)) if wrapper is not None else None
                texts.append(main_text(page.as_py(), known[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
