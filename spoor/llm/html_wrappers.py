"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page's token stream is its tags, with each text as a slot; runs of equal groups fold into one repeated group,
so a page becomes a short shape. The different shapes of a host are aligned one after another: what one
of two streams lacks becomes an optional group. Slots in menus, headers, footers, asides, forms, scripts, and
elements whose class, id or role says advert, comment, notice, sidebar and the like are not main. A page with an article, or
else a main element, prints that element's other slots: there the wrapper decides nothing. Every other page is parsed by its
host's wrapper, by the optional and repeated groups, and each position's label decides: a slot that holds one text on at
least SAME_PAGES different pages, and stands on at least half of the host's pages of this kind, is template; all others
are main. The paragraphs or list items of a repeated group have one label together, so a sentence that stories share stays
among others. A page whose slots would all be template keeps them. Copies of a page count once. An article whose class says comment, reply, card, teaser, related or advert is
another story's or a reader's, unless the page has no other; elements that are hidden or not displayed are not main.

Shapes are counted in Spark, with one row per (host, shape) and batch, so a host that holds a third of
all pages is a few rows. Shapes are merged MERGED at a time in rounds; shapes whose wrapper would pass LONGEST_WRAPPER items stay in several
wrappers, and a page is parsed by the first that matches. Wrappers are broadcast when they are small, else joined. Reading is linear
in a page's length, whatever it holds; a tag or quote that is not closed runs to the page's end. An empty table gives an empty one. Null html has an empty text; a
null URL has the empty host. Repeated pages are extracted each. Extra columns are dropped by extract().
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import html as entities
import json
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scope, small
from .url_filters import host_of

MERGED, LONGEST_WRAPPER, SAME_PAGES = 32, 1000, 3
#: Fixed lists of elements and words.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "button", "nav", "header", "footer", "aside", "form", "menu", "dialog"}
RAW = {"script", "style", "noscript", "template", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: These show nothing of their own within a line.
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "input"}
NOISE = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|comments?|disqus|replies|cookies?|consent|notice|gdpr|side-?bar|breadcrumbs?|share|social|related|newsletter|subscribe|popup|modal|menu|nav(?:bar|igation)?|footer|header|masthead|pagination|widget|navigation|complementary|contentinfo)(?:$|[\s_-])")
#: Of an article or a main element, what says that it is another story or a reader's.
APART = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|comments?|disqus|reply|replies|cards?|teasers?|related|widget)(?:$|[\s_-])")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>]++)")
_HIDDEN = re.compile(r"(?i)(?<![\w-])hidden(?![\w-])")
_UNDISPLAYED = re.compile(r"(?i)(?<![\w-])style\s*=\s*[\"']?[^\"'>]*?display\s*:\s*none")
#: A quote opens a value after = only. What is not closed goes on to the end of the page, as in browsers; every character is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?i)(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
#: Elements whose start ends an open p, and those whose start ends an open one of their kind (up to a bound).
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SPACE = re.compile(r"\s+")
#: Repeated groups of these have one label.
_PROSE = re.compile(r"^\(.*\|(?:p|li|dt|dd|h[1-6]|blockquote|pre)[ )].*\)\+$")
_SLOTS = "array<struct<item:int,part:int,value:string,pages:bigint,contents:array<string>>>"


def _is_noise(name: str, marks: str) -> bool:
    """Whether an element's class, id or role, its words also where capitals join them, names what is not main, or it is not shown."""
    words = NOISE if name not in ("article", "main") else APART
    if any(words.search(_HUMP.sub("-", a or b or c)) for what, a, b, c in _MARK.findall(marks) if what.lower() != "id" or name not in HEADINGS):
        return True
    return bool(_HIDDEN.search(_VALUE.sub("=", marks)) or _UNDISPLAYED.search(marks))


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, name or text, noise) of a page: kind is open, close or text."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], False
            return
        if m.start() > at:
            yield "text", page[at : m.start()], False
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), False
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, False
            continue
        yield "open", name, _is_noise(name, m[3]) if m[3] else False
        if name in RAW:  # nothing in it is markup
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = end.start() if end else n


def stream(page: str) -> tuple[list[str], list[str]]:
    """The page's tokens for alignment, and the texts of its slots. A slot token says where it lies: #a in an article,
    #m in a main element, #b elsewhere, #x in what is skipped. A block tag is |. An article or main element that only its own or an
    ancestor's class, id or role skips counts, where the page has no other and it holds more text than all that's not skipped."""
    out, texts, held = _stream(page, False)
    if held and not any(t in ("#a", "#m") and not x.isspace() for t, x in zip((t for t in out if t[0] == "#"), texts)):
        full, same, _ = _stream(page, True)
        sizes = {r: sum(len(x.strip()) for t, x in zip((t for t in o if t[0] == "#"), texts) if t in r) for o, r in ((out, ("#b",)), (full, ("#a", "#m")))}
        if sizes["#a", "#m"] > sizes["#b",]:
            return full, same
    return out, texts


def _stream(page: str, reset: bool) -> tuple[list[str], list[str], bool]:
    """stream() with or without the skip that class words set on an article's ancestors; and whether there is such an article."""
    out: list[str] = []
    texts: list[str] = []
    stack: list[tuple[str, bool, bool, str]] = []  # name, skipped, by a fixed element, region
    places: dict[str, list[int]] = {}  # where in the stack elements of a name are open
    blocks: list[int] = []  # where those are that are not inline
    skip, fixed, region, held = False, False, "b", False
    line: int | None = None  # the last shown slot of this line

    def pop_to(i: int) -> None:
        nonlocal skip, fixed, region
        while len(stack) > i:  # each element is popped once
            name, skip, fixed, region = stack.pop()
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    last = lambda names: max((places[n][-1] for n in names if places.get(n)), default=-1)
    for kind, value, noise in tokens(page):
        if kind == "text":
            if value.isspace():  # between inline elements it is a space
                if line is not None and not skip:
                    texts[line] += " "
                continue
            line = line if skip else len(texts)
            out.append("#x" if skip else f"#{region}")
            texts.append(value)
            continue
        inline = value in INLINE or value in UNSEEN
        line = line if inline else None
        if kind == "open":
            if value in ENDS:
                names, bounds = ENDS[value]
                if (i := last(names)) > last(bounds):
                    pop_to(i)
            elif value in ENDS_P and blocks and stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            out.append(f"<{value}>" if inline else f"|{value}")
            if value in VOID:
                continue
            places.setdefault(value, []).append(len(stack))
            if value not in INLINE:
                blocks.append(len(stack))
            stack.append((value, skip, fixed, region))
            if value in ("article", "main") and not fixed and (skip and region == "b" or noise):
                held = True
                skip = not reset
            fixed = fixed or value in SKIPPED
            skip = skip or value in SKIPPED or noise and value not in ("html", "body", "article", "main")
            region = "a" if value == "article" else "m" if value == "main" and region == "b" else region
        else:
            out.append(f"</{value}>" if inline else f"|/{value}")
            if places.get(value):
                pop_to(places[value][-1])
    return out, texts, held


def fold(items: list[str], longest: int = 12) -> list[str]:
    """Equal neighbouring groups become one repeated group, shortest groups first."""
    return _folded(items, longest)[0]


def _folded(items: list[str], longest: int = 12) -> tuple[list[str], list[int]]:
    """The folded items, and at which token each begins, with the end last."""
    starts = list(range(len(items) + 1))
    for size in range(1, longest + 1):
        if sum(map(operator.eq, items, items[size:])) < size:
            continue
        out: list[str] = []
        begins: list[int] = []
        i = 0
        while i < len(items):
            group = items[i : i + size]
            j = i + size
            while len(group) == size and items[j : j + size] == group:
                j += size
            begins.append(starts[i])
            if j > i + size:
                out.append("(" + " ".join(group) + ")+")
                i = j
            else:
                out.append(items[i])
                i += 1
        items, starts = out, [*begins, starts[-1]]
    return items, starts


def _bare(t: str) -> str:
    return t[1:-2] if t.endswith((")+", ")?")) else t


def align(wrapper: list[str], shape: list[str]) -> list[str]:
    """The wrapper that matches both: what one lacks is optional, and a group that only one repeats is repeated."""
    a, b = [_bare(t) for t in wrapper], [_bare(t) for t in shape]
    out: list[str] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(wrapper[i:j], shape[k:m]):
                marks = {x[-1], y[-1]} & {"?", "+"} if x[-2:] in (")?", ")+") or y[-2:] in (")?", ")+") else set()
                out.append(f"({_bare(x)})?" if "?" in marks else f"({_bare(x)})+" if marks else x)
        else:
            out += [t if t.endswith(")?") else f"({_bare(t)})?" for t in [*wrapper[i:j], *shape[k:m]]]
    return out


@functools.lru_cache(4096)
def _automaton(wrapper: str) -> tuple[dict[str, int], int, int]:
    """The wrapper's positions by item, its optional positions (as bits) and its length."""
    places: dict[str, int] = {}
    optional, parts = 0, wrapper.split("\x1f")
    for j, t in enumerate(parts):
        places[_bare(t)] = places.get(_bare(t), 0) | 1 << j
        optional |= t.endswith(")?") << j
    return places, optional, len(parts)


def parse(wrapper: str, shape: list[str]) -> list[int] | None:
    """The position in the wrapper (items joined by \\x1f) of each of the shape's items, or None where it doesn't match."""
    places, optional, size = _automaton(wrapper)
    state, taken = 1, []
    for x in shape:
        state |= (optional + (state & optional)) ^ optional  # a carry runs through neighbouring optional items
        taken.append(state & places.get(_bare(x), 0))
        state = taken[-1] << 1
    state |= (optional + (state & optional)) ^ optional
    if not state >> size & 1:
        return None
    at, out = size, []
    for reach in reversed(taken):  # the last place from which only optional items lie between
        at = (reach & ((1 << at) - 1)).bit_length() - 1
        out.append(at)
    return out[::-1]


def _slots(wrapper: list[str]) -> set[str]:
    return set(re.findall(r"#[abmx]", " ".join(wrapper)))


def main_region(wrapper: list[str]) -> str:
    """Which slots of a page's shape can be main: those of articles, else of main elements, else of the body."""
    have = _slots(wrapper)
    return next((r for r in ("#a", "#m") if r in have), "#b")


def render(items: list[str], texts: list[str], region: str, template: set[int]) -> str:
    """The region's slots' texts in page order without those of the template (numbers of slots), one line a block. A page
    without the region gives its own best one."""
    have = {t for t in items if t[0] == "#"}
    if region not in have:
        region = next((r for r in ("#a", "#m", "#b") if r in have), region)
    blocks, own, n = [], [], 0
    for t in items:
        if t[0] == "#":
            if t == region and n not in template:
                own.append(texts[n])
            n += 1
        elif t[0] == "|":
            blocks.append(own)
            own = []
    blocks.append(own)
    lines = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def _digest(text: str) -> str:
    return hashlib.blake2b(_SPACE.sub(" ", text).strip().encode(errors="replace"), digest_size=8).hexdigest()


def _parts(items: list[str], folded: list[str], starts: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(folded item, part, body slots) of a page: a part is a slot, or all of a repeated group of paragraphs or list items."""
    n = 0
    for i, t in enumerate(folded):
        own = []
        for x in items[starts[i] : starts[i + 1]]:
            if x[0] == "#":
                if x == "#b":
                    own.append(n)
                n += 1
        if own and _PROSE.search(t):
            yield i, 0, own
        else:
            yield from ((i, k, [slot]) for k, slot in enumerate(own))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, pages, slots): a batch's different shapes by host. slots, for pages without article and main: each part's
    text as a digest, or * where pages differ, with the number of pages and up to SAME_PAGES digests of different ones."""
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        parts: dict[tuple[str, str], dict[tuple[int, int], list]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            items, texts = stream(page.as_py())
            folded, starts = _folded(items)
            key = (host, "\x1f".join(folded))
            found[key] = found.get(key, 0) + 1
            if main_region(folded) == "#b":
                content, own = _digest("\x1f".join([key[1], *texts])), parts.setdefault(key, {})
                for i, k, slots in _parts(items, folded, starts):
                    value = _digest("\x1f".join(texts[n] for n in slots))
                    have = own.setdefault((i, k), [value, 0, {content}])
                    if have[0] != value:
                        have[0] = "*"
                    have[1] += 1
                    if len(have[2]) < SAME_PAGES:
                        have[2].add(content)
        rows = [(h, s, c, [(*at, v, n, sorted(x)) for at, (v, n, x) in parts[h, s].items()] if (h, s) in parts else None) for (h, s), c in found.items()]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("item", pa.int32()), ("part", pa.int32()), ("value", pa.string()), ("pages", pa.int64()), ("contents", pa.list_(pa.string()))]))]
        columns[3:] = [[x and [dict(zip(("item", "part", "value", "pages", "contents"), y)) for y in x] for x in columns[3]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "shape", "pages", "slots"])


def _merge(pdf):
    """A group's shapes as one wrapper, or several of at most LONGEST_WRAPPER items where they have little in common."""
    import pandas as pd

    done: list[list[str]] = []
    for shape in sorted(pdf["shape"]):
        one = shape.split("\x1f")
        both = align(done[-1], one) if done and max(len(done[-1]), len(one)) <= LONGEST_WRAPPER else None
        if both is not None and len(both) <= max(LONGEST_WRAPPER, len(done[-1]), len(one)):
            done[-1] = both
        else:
            done.append(one)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]] * len(done), "shape": ["\x1f".join(w) for w in done]})


def _merged(shapes: DataFrame) -> DataFrame:
    """(host, shape) of the hosts' wrappers: groups of about MERGED shapes are merged, then groups of those wrappers, until a
    host has one, or those left can't be merged. No task holds more than a group."""
    left = materialize(shapes, "host-wrappers")
    count, before = left.count(), None
    hosts = left.select("host").distinct().count()
    while count > hosts and count != before:
        n = left.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / MERGED).alias("groups"))
        dealt = left.join(n, "host").withColumn("group", F.pmod(F.xxhash64("shape"), "groups"))
        left = materialize(dealt.groupBy("host", "group").applyInPandas(lambda p: _merge(p), "host string, shape string"), "host-wrappers")
        count, before = left.count(), count
    return left


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper, item, part, value, pages, content) of (host, wrapper, shape, slots): items are the wrapper's positions."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for host, wrapper, shape, slots in zip(*(c.to_pylist() for c in batch.columns)):
            at = parse(wrapper, shape.split("\x1f"))
            if at is None:
                continue
            for x in slots:
                rows += [(host, wrapper, at[x["item"]], x["part"], x["value"], 0 if i else x["pages"], c) for i, c in enumerate(x["contents"])]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "wrapper", "item", "part", "value", "pages", "content"])


def infer(pages: DataFrame) -> DataFrame:
    """(host, shape, template): each host's wrapper, and which of its (item, part) are template."""
    rows = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = materialize(rows.mapInArrow(_shapes, f"host string, shape string, pages long, slots {_SLOTS}"), "shapes")
    wrappers = _merged(found.select("host", "shape").distinct())
    bodies = found.where("slots is not null")
    total = bodies.groupBy("host").agg(F.sum("pages").alias("all"))
    given = bodies.join(wrappers.withColumnRenamed("shape", "wrapper"), "host").select("host", "wrapper", "shape", "slots")
    labels = given.mapInArrow(_labels, "host string, wrapper string, item int, part int, value string, pages long, content string")
    labels = labels.groupBy("host", "wrapper", "item", "part").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("pages").alias("pages"), F.countDistinct("content").alias("contents"))
    same = (F.col("lo") == F.col("hi")) & (F.col("lo") != "*") & (F.col("contents") >= SAME_PAGES)
    fixed = labels.where(same).join(total, "host").where(2 * F.col("pages") >= F.col("all")).groupBy("host", F.col("wrapper").alias("shape")).agg(F.sort_array(F.collect_set(F.struct("item", "part"))).alias("template"))
    return wrappers.join(fixed, ["host", "shape"], "left").select("host", "shape", F.coalesce("template", F.array().cast("array<struct<item:int,part:int>>")).alias("template"))


def main_text(page: str, wrappers: list[tuple[str, set[tuple[int, int]]]]) -> str:
    """A page's main slots by the first of its host's wrappers that matches it."""
    items, texts = stream(page)
    region, gone = main_region(items), set()
    if region == "#b" and wrappers:
        folded, starts = _folded(items)
        at, template = next(((at, t) for at, t in ((parse(w, folded), t) for w, t in wrappers) if at), (None, set()))
        parts = list(_parts(items, folded, starts)) if at and template else []
        gone = {n for i, k, slots in parts if (at[i], k) in template for n in slots}
        if not any(texts[n].strip() for _, _, slots in parts for n in slots if n not in gone):
            gone = set()
    return render(items, texts, region, gone)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages(page_id, url, html)."""
    with scope(pages.sparkSession):
        use = infer(pages).where(F.size("template") > 0).groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("shape", "template")))).alias("use"))
        use = materialize(use, "wrappers", keep=True)
    rows = pages.select("page_id", "url", host_of(F.coalesce("url", F.lit(""))).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.join(small(use), "host", "left").select("page_id", "url", "html", "use")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[str | None, list[tuple[str, set[tuple[int, int]]]]] = {None: []}
            out = []
            for page, given in zip(batch.column(2), batch.column(3).to_pylist()):
                if given not in memo:
                    memo[given] = [(x["shape"], {(t["item"], t["part"]) for t in x["template"]}) for x in json.loads(given)]
                out.append(main_text(page.as_py(), memo[given]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
