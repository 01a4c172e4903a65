"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of structural tags and texts. Runs that repeat fold into repeated groups.
Streams of one host are aligned one after another: what only one of two has becomes
optional, a group that one has once and the other repeats becomes repeated, and a text that
differs between them becomes a slot, while a text that all pages have alike stays fixed.
The result is the host's wrapper, an expression that every page of the host matches.

The wrapper chooses the content. Slots carry the containers around them and the characters
that pages had there. The region of a host's content is a container that stands once on a
page and holds most of the characters of its slots: the article or main element if one of
these does, else one that is named as content, else the innermost that holds nearly all.
Texts that the wrapper holds fixed are not content, in the region too, unless most of the
region is fixed, as on a host of one page or of equal pages. Menus, footers, sidebars and
forms are known by their elements. Names of classes and ids are a hint only: an element that
is named as an advert, a notice or comments is left out unless it holds most of the page.

Wrappers are inferred in a tree, so that no host's pages gather in one task: each partition
aligns its own pages, and partial wrappers of a host are aligned ``FAN_IN`` at a time until
one is left. Only wrappers are joined back to the pages.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import small_batches

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|textarea|iframe)\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>|</?([a-zA-Z][a-zA-Z0-9-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|</?([a-zA-Z][a-zA-Z0-9-]*+)([^>]*+)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: HTML elements that end the block before them, and which of them stay open until closed.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul button".split())
VOID = frozenset(["hr"])
#: Inline elements that have no content and no closing tag.
EMPTY = frozenset("area base basefont bgsound col embed frame img input keygen link meta param source track wbr".split())
#: Opening one of these ends an open one of those.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
#: Elements that are not main text.
BAD_TAGS = frozenset("nav footer aside form select button menu dialog head title".split())
#: Elements whose names say nothing about what is in them.
WHOLE = frozenset("html body article main".split())
#: Elements that can be a region.
CONTAINERS = frozenset("html body article main section div center table tbody tr td dl ul ol blockquote details".split())
#: Words in classes, ids or roles that hint at what is not main text, and at what is.
BAD_WORDS = frozenset("""
    ad ads adsbygoogle advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo
    complementary cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notices notification alert pager pagination popup promo promoted promotion recommended related replies respond search
    share sharing sidebar signup social sponsor sponsored subscribe tagcloud toolbar widget widgets
""".split())
GOOD_WORDS = frozenset("article main content post entry story".split())
#: Longest group that is folded when it repeats.
GROUP = 12
#: Partial wrappers of a host that one task aligns.
FAN_IN = 64
#: Shares of characters: a region holds most of all, nearly all; fixed texts are a small part of a region.
MOST, NEARLY, SMALL = 0.5, 0.95, 1 / 3


def _attributes(text: str) -> list[str]:
    return [w for m in _NAMES.finditer(text) for w in re.split(r"[\s]+", next(filter(None, m.groups()), "").lower()) if w]


def _hint(atom: str, words: frozenset) -> bool:
    """Whether a class, id or role of the element, or a part of it, is one of the words."""
    tag, *names = atom.split(".")
    return tag not in WHOLE and any(part in words for n in names for part in [n, *re.split(r"[-_]+", n)])


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...], bool, str]]:
    """(event, path, excluded, text): "open" and "close" of containers and each "text" block, in page order.

    ``path`` holds the containers around, as tag and names; ``excluded`` tells that one of
    them is not main text by its tag.
    """
    stack: list[tuple[str, str, bool]] = []
    pending: list[str] = []
    at = 0

    def path() -> tuple[str, ...]:
        return tuple(a for _, a, _ in stack)

    def flush() -> Iterator[tuple]:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                yield "text", path(), any(b for *_, b in stack), text

    for m in _TAG.finditer(page):
        if m.start() > at:
            pending.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if not tag:  # a comment, a declaration, or an element whose text is not prose
            continue
        closing = m[0][1] == "/"
        attributes = m[3] or m[5] or ""
        if tag not in BLOCKS:
            if tag == "br":
                pending.append(" ")
            elif closing:
                if stack and stack[-1][0] == tag:
                    yield from flush()
                    stack.pop()
            elif tag not in EMPTY and "=" in attributes and not attributes.endswith("/") and _hint(atom := ".".join([tag, *_attributes(attributes)]), BAD_WORDS):
                yield from flush()
                stack.append((tag, atom, False))
            continue
        yield from flush()
        if closing:
            if any(t == tag for t, *_ in stack):
                while stack:
                    t, a, _ = stack.pop()
                    yield "close", (), False, a
                    if t == tag:
                        break
            continue
        for t in (*ENDS.get(tag, ()), "p"):  # an open paragraph ends at any block
            if stack and stack[-1][0] == t:
                yield "close", (), False, stack.pop()[1]
        while tag in ENDS and stack and stack[-1][0] in ENDS[tag]:
            yield "close", (), False, stack.pop()[1]
        if tag in VOID:
            continue
        names = [re.sub(r"\d+", "0", n) for n in _attributes(attributes)] if "=" in attributes else []
        atom = ".".join([tag, *names])
        stack.append((tag, atom, tag in BAD_TAGS or tag == "header" and not any(t == "article" for t, *_ in stack)))
        yield "open", (), False, atom
    if at < len(page):
        pending.append(html.unescape(page[at:]))
    yield from flush()


class Slot:
    """A text of a wrapper: its containers, its value (None: differs), characters, pages, how many containers stand once on a page."""

    __slots__ = ("excluded", "key", "mass", "pages", "path", "single", "value")

    def __init__(self, path: list[str], excluded: bool, value: str | None, mass: int, pages: int, single: int):
        self.path, self.excluded, self.value, self.mass, self.pages, self.single = path, excluded, value, mass, pages, single
        self.key = "#" + "/".join(path) + "!" * excluded

    def also(self, other: Slot) -> Slot:
        """With the same slot of other pages."""
        return Slot(self.path, self.excluded, self.value if self.value == other.value else None, self.mass + other.mass, self.pages + other.pages, min(self.single, other.single))

    def then(self, other: Slot) -> Slot:
        """With the next text of a repeated group of one page."""
        both = None if self.value is None or other.value is None else xxhash.xxh64_hexdigest(self.value + other.value)
        return Slot(self.path, self.excluded, both, self.mass + other.mass, self.pages, min(self.single, other.single))


# A wrapper is a list of items: tags ("<p", ">p"), slots, and groups [mark, items], mark ""
# (once), "+" (repeated), "?" (optional) or "*" (both). Optional are single items only.


def _key(item: object) -> str:
    """Items that align: equal tags, slots in the same containers, groups of such items whatever their marks."""
    if isinstance(item, Slot):
        return item.key
    while isinstance(item, list):
        if len(item[1]) > 1:
            return "(" + " ".join(map(_key, item[1])) + ")"
        item = item[1][0]
        if isinstance(item, Slot):
            return item.key
    return item


def _meet(a: object, b: object, join: Callable[[Slot, Slot], Slot]) -> object:
    """One item for two that align: its mark admits both, ``join`` makes one slot of two."""
    if isinstance(a, Slot) and isinstance(b, Slot):
        return join(a, b)
    if not isinstance(a, list) and not isinstance(b, list):
        return a
    (m, x), (n, y) = (v if isinstance(v, list) else ["", [v]] for v in (a, b))
    while len(x) != len(y) or any(_key(i) != _key(j) for i, j in zip(x, y, strict=True)):  # a group of one group
        if len(x) == 1 and isinstance(x[0], list):
            m, x = _mark(m, x[0][0]), x[0][1]
        else:
            n, y = _mark(n, y[0][0]), y[0][1]
    return _group(_mark(m, n), [_meet(i, j, join) for i, j in zip(x, y, strict=True)])


def _mark(m: str, n: str) -> str:
    repeated, optional = {"+", "*"} & {m, n}, {"?", "*"} & {m, n}
    return "*" if repeated and optional else "+" if repeated else "?" if optional else ""


def _group(mark: str, items: list) -> object:
    """A group, if it needs to be one."""
    if len(items) == 1 and (not mark or isinstance(items[0], list)):
        return items[0] if not mark else [_mark(mark, items[0][0]), items[0][1]]
    return [mark, items]


def fold(items: list) -> list:
    """Repeats of up to GROUP items in a row become repeated groups, short ones first."""
    for size in range(1, GROUP + 1):
        out: list = []
        keys: list[str] = []
        for item in items:
            out.append(item)
            keys.append(_key(item))
            if len(out) >= 2 * size and keys[-size:] == keys[-2 * size : -size]:
                pair = list(zip(out[-2 * size : -size], out[-size:], strict=True))
                del out[-2 * size :], keys[-2 * size :]
                out.append(_group("+", [_meet(x, y, Slot.then) for x, y in pair]))
                keys.append(_key(out[-1]))
            if size > 1 and len(out) > size and isinstance(out[-size - 1], list) and out[-size - 1][0] == "+" and len(out[-size - 1][1]) == size and [_key(x) for x in out[-size - 1][1]] == keys[-size:]:
                more = [_meet(x, y, Slot.then) for x, y in zip(out[-size - 1][1], out[-size:], strict=True)]
                del out[-size:], keys[-size:]
                out[-1] = ["+", more]
        items = out
    return items


def tokens(page: str) -> tuple[list, list[tuple[Slot, str]]]:
    """The page's stream before folding, and its slots with their texts."""
    events = list(blocks(page))
    opened: Counter = Counter()
    around: list[str] = []
    for event, _, _, text in events:
        if event == "open":
            around.append(text)
            opened[tuple(around)] += 1
        elif event == "close" and text in around:
            del around[len(around) - 1 - around[::-1].index(text) :]
    items: list = []
    found: list[tuple[Slot, str]] = []
    for event, path, excluded, text in events:
        if event == "text":
            single = next((d for d in range(len(path)) if opened[path[: d + 1]] > 1), len(path))
            slot = Slot(list(path), excluded, xxhash.xxh64_hexdigest(text), len(text), 1, single)
            items.append(slot)
            found.append((slot, text))
        else:
            items.append(("<" if event == "open" else ">") + text)
    return items, found


def stream(page: str) -> list:
    """The wrapper of one page."""
    return fold(tokens(page)[0])


def _once(items: list, other: list) -> list:
    """Runs of the items that the other wrapper has as a group become a group too, of one turn."""
    for pattern in {tuple(map(_key, x[1])) for x in other if isinstance(x, list) and len(x[1]) > 1}:
        keys = [_key(x) for x in items]
        out, i = [], 0
        while i < len(items):
            if tuple(keys[i : i + len(pattern)]) == pattern:
                out.append(["", items[i : i + len(pattern)]])
                i += len(pattern)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _optional(items: list) -> list:
    return [[_mark(x[0], "?"), x[1]] if isinstance(x, list) else ["?", [x]] for x in items]


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers: what both have stays, what one of them has becomes optional."""
    a, b = _once(a, b), _once(b, a)
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], False).get_opcodes():
        if op == "equal":
            out += (_meet(x, y, Slot.also) for x, y in zip(a[i:j], b[k:m], strict=True))
        else:
            out += _optional(a[i:j]) + _optional(b[k:m])
    return out


def shape(wrapper: list) -> str:
    """What two wrappers have in common that differ in their texts only."""
    return " ".join(x[0] + shape(x[1]) + ")" if isinstance(x, list) else _key(x) for x in wrapper)


def slots(wrapper: list) -> list[Slot]:
    return [y for x in wrapper for y in (slots(x[1]) if isinstance(x, list) else [x] if isinstance(x, Slot) else [])]


def packed(wrapper: list) -> str:
    """As JSON."""
    plain = lambda x: [x[0], [plain(y) for y in x[1]]] if isinstance(x, list) else {"p": x.path, "x": x.excluded, "v": x.value, "m": x.mass, "n": x.pages, "s": x.single} if isinstance(x, Slot) else x
    return json.dumps([plain(x) for x in wrapper])


def unpacked(text: str) -> list:
    real = lambda x: [x[0], [real(y) for y in x[1]]] if isinstance(x, list) else Slot(x["p"], x["x"], x["v"], x["m"], x["n"], x["s"]) if isinstance(x, dict) else x
    return [real(x) for x in json.loads(text)]


def _small(part: float, whole: float) -> bool:
    return part <= SMALL * whole


def choice(wrapper: list) -> dict:
    """What the wrapper says of its host's pages: ``region`` (path), ``whole`` (containers whose names don't count), ``fixed`` (slot keys and their values)."""
    open_slots = [s for s in slots(wrapper) if not s.excluded]
    differ = [s for s in open_slots if s.value is None]
    # Of a host whose pages are alike, or one page, all texts count.
    counted = differ if differ and not _small(sum(s.mass for s in differ), sum(s.mass for s in open_slots)) else open_slots

    def masses(some: list[Slot]) -> Counter:
        out: Counter = Counter()
        for s in some:
            for d in range(1, len(s.path) + 1):
                out[tuple(s.path[:d])] += s.mass
        return out

    held, total = masses(counted), sum(s.mass for s in counted)
    whole = sorted(p for p, m in held.items() if m >= MOST * total)
    named = lambda s: any(tuple(s.path[: d + 1]) not in whole and _hint(atom, BAD_WORDS) for d, atom in enumerate(s.path))
    counted = [s for s in counted if not named(s)]
    held, total = masses(counted), sum(s.mass for s in counted)
    once = {tuple(s.path[:d]) for s in counted for d in range(1, s.single + 1)} - {tuple(s.path[:d]) for s in counted for d in range(s.single + 1, len(s.path) + 1)}
    chain = sorted((p for p, m in held.items() if p in once and m >= MOST * total and p[-1].split(".")[0] in CONTAINERS), key=len)
    region: tuple[str, ...] = ()
    tests = (lambda p: p[-1].split(".")[0] == "article", lambda p: p[-1].split(".")[0] == "main" or "main" in p[-1].split(".")[1:], lambda p: _hint(p[-1], GOOD_WORDS))
    for test in tests:
        if region := next(filter(test, chain), ()):
            break
    else:
        region = next((p for p in reversed(chain) if held[p] >= NEARLY * total), ())
    inside = [s for s in open_slots if tuple(s.path[: len(region)]) == region and not named(s)]
    pages = max((s.pages for s in inside), default=0)
    fixed = [s for s in inside if s.value is not None and s.pages > 1 and s.pages == pages and (s.path or [""])[-1].split(".")[0] != "h1"] if pages > 1 else []
    if not _small(sum(s.mass for s in fixed), sum(s.mass for s in inside)):
        fixed = []
    return {"region": list(region), "whole": [list(p) for p in whole], "fixed": [[s.key, s.value] for s in fixed]}


def extract(page: str, chosen: dict | None) -> str:
    """The page's main text by what its host's wrapper says; a page without the host's region by its own wrapper."""
    items, texts = tokens(page)
    if not texts:
        return ""
    for wanted in (chosen, None):
        wanted = wanted or choice(fold(items))
        region, whole = tuple(wanted["region"]), {tuple(p) for p in wanted["whole"]}
        inside = [(s, t) for s, t in texts if not s.excluded and tuple(s.path[: len(region)]) == region]
        inside = [(s, t) for s, t in inside if not any(tuple(s.path[: d + 1]) not in whole and _hint(atom, BAD_WORDS) for d, atom in enumerate(s.path))]
        if wanted["fixed"]:
            same = {(k, v) for k, v in wanted["fixed"]}
            gone = {s.key for s in slots(fold(items)) if (s.key, s.value) in same}
            inside = [(s, t) for s, t in inside if s.key not in gone]
        if inside:
            return "\n".join(t for _, t in inside)
    return ""


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"//([^/?#:]*)", 1)), F.lit(""))


def _merge(texts: list[str]) -> list:
    """One wrapper from many, in an order that their text fixes; those of one shape differ in texts only."""
    shapes: dict[str, list] = {}
    for text in sorted(texts, key=lambda w: (len(w), w)):
        w = unpacked(text)
        k = shape(w)
        shapes[k] = [_meet(x, y, Slot.also) for x, y in zip(shapes[k], w, strict=True)] if k in shapes else w
    out, *rest = (shapes[k] for k in sorted(shapes, key=lambda k: (len(k), k)))
    for w in rest:
        out = align(out, w)
    return out


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper, wanted): each host's wrapper and what it says of the content, both as JSON."""
    small_batches(pages.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, dict[str, list]] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, packed(_merge([packed(w) for w in shapes.values()]))) for h, shapes in made.items()]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["host", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = stream(page or "")
                shapes, k = made.setdefault(host, {}), shape(w)
                shapes[k] = [_meet(x, y, Slot.also) for x, y in zip(shapes[k], w, strict=True)] if k in shapes else w
            if sum(map(len, made.values())) > 2000:
                yield out()
        if made:
            yield out()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [packed(_merge(list(frame["wrapper"])))]})

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        w = _merge(list(frame["wrapper"]))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [packed(w)], "wanted": [json.dumps(choice(w))]})

    parts = scratch.save(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(partial, "host string, wrapper string"))
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        dealt = F.pmod(F.xxhash64("wrapper"), F.lit(most))
        parts = scratch.save(parts.groupBy("host", dealt).applyInPandas(merged, "host string, wrapper string"))
    return parts.groupBy("host").applyInPandas(final, "host string, wrapper string, wanted string")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``_main``, the main text.

    Blocks are joined by a line feed; inside a block white space is one space and character
    references are decoded. Defined results: null or empty html has an empty text; a page
    whose url is null or has no host is of the host ''; a page without its host's
    content region is taken by a wrapper of its own; rows and their other columns pass
    through, repeated rows too.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    table = scratch.save(wrappers(pages, scratch)).select(F.col("host").alias("_host"), F.col("wanted").alias("_wanted"))
    names = pages.columns
    at = len(names)
    joined = pages.toDF(*(f"c{i}" for i in range(at))).withColumn("_html", F.col(f"c{names.index('html')}").cast("string"))
    joined = joined.join(table, host_of(F.col(f"c{names.index('url')}")) == F.col("_host"), "left").select(*(f"c{i}" for i in range(at)), "_html", "_wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict | None] = {}
        for b in batches:
            texts = []
            for page, wanted in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True):
                if wanted not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wanted] = json.loads(wanted) if wanted else None
                texts.append(extract(page or "", known[wanted]))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string())], [*(f"c{i}" for i in range(at)), "_main"])

    schema = ", ".join([*(f"`c{i}` {t}" for i, (_, t) in enumerate(pages.dtypes)), "`_main` string"])
    return joined.mapInArrow(run, schema).toDF(*names, "_main")
