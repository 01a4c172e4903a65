"""Benchmark decontamination by template canonicalisation.

Texts become template words: numbers, units and names turn into typed placeholders, other
words are lower-cased without punctuation at their ends. Number words in a row are one
number; a capitalised word at a sentence's start is a name if the text has it as one
elsewhere. Windows of ``WIDTH`` template words are hashed, those with names a second time
with the names as plain words, so that copies in lower or upper case are found too. A
document's windows are hash-joined with the benchmark's, and what the join finds is checked
for slot consistency: along an alignment of document and item, and along neighbouring
alignments together, each value of the item must stand for one value of the document.

Two filters keep the join small and lose nothing. Only windows that pass a Bloom filter of
the benchmark's windows leave a document's task; it has a fixed size (1 MB). And documents
are sought by an item's rarest windows only: one that holds the share ``coverage`` of an
item's n windows holds at least one of any n - coverage * n + 1 of them, so a phrase that
many items share brings no pairs. The other windows are joined for the pairs found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import small_batches

WIDTH = 5
COVERAGE = 0.8
#: An alignment needs a window with so many literal words or with the item's own values, and
#: so many literal words in all or the item's own values throughout.
ANCHOR, LITERALS = 2, 3
FILTER_BITS = 1 << 23

#: Words that are units, and number words.
UNITS = set("""
    mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ounce ounces pound pounds ton tons
    l ml litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
    s ms h kmh mph dollar dollars cent cents euro euros percent degree degrees watt watts volt volts joule joules byte bytes kb mb gb
    km/h m/s usd eur
""".split())
NUMBERS = set("""
    zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGES = ".,!?;:'\"()[]{}#$%&*|<>«»“”‘’-–—_"
_NUM, _UNIT, _NAME = 1, 2, 3
_CAP, _END, _LINE, _SPELLED = 1, 2, 4, 8


#: Stands for a line's end among the words.
_BREAK = b"\0"


class _Codes(dict):
    """UTF-8 of a word to its code: 60 bits of its template word's hash, then flags. Emptied when it grows too large."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        word = raw.decode()
        bare = word.strip(_EDGES)
        low = bare.lower()
        flags = _END if word[-1] in ".!?:" or word.rstrip("\"')»”")[-1:] in (".", "!", "?") else 0
        if raw == _BREAK:
            code, flags = 0, _LINE
        elif _NUMBER.fullmatch(word.strip(".,!?;:'\"()")) or low in NUMBERS:
            code = _NUM
            flags |= _SPELLED * (low in NUMBERS)
        elif low in UNITS:
            code = _UNIT
        else:
            code = max(8, xxhash.xxh64_intdigest(low or word) >> 4)
            if bare[:1].isupper() and not bare.isupper():
                flags |= _CAP
        self[raw] = value = code << 4 | flags
        return value


def _hashes(code: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` template words."""
    n = max(0, len(code) - width + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def template(text: str, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], str]]:
    """(codes with names as placeholders, codes with names as words, sentence starts, sentence ends, value of a word) of a text."""
    tokens = text.replace("\n", " \0 ").encode().split()
    raw = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    flags, plain = (raw & np.uint64(15)).astype(np.uint8), raw >> np.uint64(4)
    line, cap = (flags & _LINE) > 0, (flags & _CAP) > 0
    ends = (flags & (_END | _LINE)) > 0
    starts = np.ones(len(raw), bool)
    starts[1:] = ends[:-1]
    names = cap & ~starts
    if names.any():
        first = np.flatnonzero(cap & starts)
        if len(first):
            names[first[np.isin(plain[first], np.unique(plain[names]))]] = True
        code = np.where(names, np.uint64(_NAME), plain)
    else:
        code = plain
    ends[:-1] |= line[1:]
    ends[-1:] = True
    keep = ~line
    spelled = (flags & _SPELLED) > 0
    joined = np.zeros(len(raw), bool)  # number words after others
    joined[1:] = (spelled & ~starts)[1:] & spelled[:-1]
    if joined.any():
        head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(raw))))
        np.logical_or.at(ends, head[joined], ends[joined])  # a number's end is its last word's
        keep &= ~joined
    at = np.flatnonzero(keep)

    def value(i: int) -> str:
        j = int(at[i])
        k = j + 1
        while k < len(joined) and joined[k]:
            k += 1
        return b" ".join(tokens[j:k]).decode().strip(_EDGES).lower()

    return code[at], plain[at], starts[at], ends[at], value


def _rows(texts: DataFrame, key: str, passes: np.ndarray | None, widths: list[int]) -> DataFrame:
    """(key, pos, n, width, h, lits, slots): windows of the texts, with a filter only those that pass it.

    Without a filter a text of fewer than WIDTH words is one window; with one, windows of
    ``widths`` that are whole sentences are given too. Bits of ``lits`` tell which words are
    literal, ``slots`` are the values of the others in lower case.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            out: list[tuple] = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text or k is None:
                    continue
                code, plain, starts, ends, value = template(text, codes)
                if not len(code):
                    continue
                short = [len(code)] if passes is None and len(code) < WIDTH else [] if passes is None else widths
                named = code is not plain and bool((code == _NAME).any())
                for width in [WIDTH, *short]:
                    n = len(code) - width + 1
                    if n <= 0:
                        continue
                    first = _hashes(code, width)
                    variants = [(first, code, np.ones(n, bool))]
                    if named:
                        second = _hashes(plain, width)
                        variants.append((second, plain, second != first))
                    for h, form, use in variants:
                        if width < WIDTH:
                            use = use & starts[:n] & ends[width - 1 :]
                        hit = np.flatnonzero(use if passes is None else use & _passes(h, passes))
                        for i in hit.tolist():
                            literal = (form[i : i + width] >= 8).tolist()
                            out.append((k, i, n, width, int(h[i].view(np.int64)), sum(1 << j for j, x in enumerate(literal) if x), [value(i + j) for j, x in enumerate(literal) if not x]))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "pos", "n", "width", "h", "lits", "slots"])

    return texts.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, "key long, pos int, n int, width int, h long, lits int, slots array<string>")


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(FILTER_BITS - 1)
    return h & m, (h >> np.uint64(32)) & m


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    test = lambda x: (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
    return (test(a) & test(b)).astype(bool)


def bloom(found: DataFrame) -> np.ndarray:
    """The filter of the hashes ``h``: bits are joined in Spark; at most FILTER_BITS / 32 words reach the driver."""
    places = F.array(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.expr(f"shiftrightunsigned(h, 32) & {FILTER_BITS - 1}"))
    words = found.select(F.explode(places).alias("p")).groupBy(F.expr("p div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 32, "<u4")
    for w, bits in words.toLocalIterator():
        out[w] = bits
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, reparameterised): documents that hold an item.

    An item is held if neighbouring consistent alignments match ``coverage`` of its windows
    or more; ``reparameterised`` tells whether some slot has another value than the item's.
    Defined results: null or empty texts and null ids match nothing; an item of fewer than
    WIDTH words is one window and is held by a text that has it, with its own values, as
    whole sentences; an item without literal words is known by its own values only; of
    items that share an id the text of the least hash counts; rows of documents that share
    an id count as one text; repeated items each get their rows; empty tables give no rows;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    text = F.col("text").cast("string")
    items = benchmark.select("item_id", text.alias("text")).where("item_id is not null").groupBy("item_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    items = scratch.save(_rows(items, "item_id", None, []).select(F.col("key").alias("item_id"), F.col("pos").alias("ipos"), "n", "width", "h", "lits", F.col("slots").alias("islots")))
    widths = sorted(r.width for r in items.where(f"width < {WIDTH}").select("width").distinct().collect())
    seen = scratch.save(_rows(docs, "doc_id", bloom(items), widths).select(F.col("key").alias("doc_id"), "pos", "h", "lits", "width", "slots"))

    # Windows of few literal words or words in all bring documents only by their own values.
    strong = (F.expr("bit_count(lits)") >= ANCHOR) & (F.col("width") == WIDTH)
    value = lambda slots: F.when(strong, F.lit(0)).otherwise(F.xxhash64(slots)).alias("value")
    sharing = items.groupBy("h").agg(F.count_distinct("item_id").alias("sharing"))
    places = items.join(sharing, "h").groupBy("item_id", "ipos").agg(F.first("n").alias("n"), F.max("sharing").alias("sharing"), F.max(strong).alias("strong"))
    ranked = places.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("strong"), "sharing", "ipos"))).withColumn("n_strong", F.sum(F.col("strong").cast("int")).over(Window.partitionBy("item_id")))
    needed = F.col("n") - F.ceil(F.col("n") * F.lit(coverage) - 1e-9) + 1
    probes = items.join(ranked.where((F.col("r") <= needed) | (F.col("n_strong") < needed)).select("item_id", "ipos"), ["item_id", "ipos"])
    pairs = seen.select("doc_id", "h", value("slots")).join(probes.select("item_id", "h", value("islots")).distinct(), ["h", "value"]).select("doc_id", "item_id").distinct()

    expected = pairs.join(items, "item_id").withColumn("strong", strong)
    found = expected.join(seen.select("doc_id", "h", "pos", "slots"), ["doc_id", "h"]).where((F.col("width") == WIDTH) | (F.col("slots") == F.col("islots")))
    found = found.withColumn("same", F.col("slots") == F.col("islots"))
    slots = F.transform(F.arrays_zip("islots", "slots"), lambda z: F.struct(z["islots"].alias("iv"), z["slots"].alias("dv")))
    literal = F.expr("transform(filter(sequence(0, width - 1), j -> shiftright(lits, j) & 1 = 1), j -> ipos + j)")
    # A group is one alignment of one item: it has at most two rows for each window of the item and text with the id.
    aligned = found.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).agg(
        F.max("n").alias("n"), F.collect_set("ipos").alias("found"), F.max(F.col("strong") | F.col("same")).alias("anchored"), F.size(F.array_distinct(F.flatten(F.collect_set(literal)))).alias("literals"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("map")
    )
    function = "size(map) = size(array_distinct(transform(map, z -> z.iv)))"
    aligned = aligned.where("anchored").where(function).where((F.col("literals") >= LITERALS) | F.expr("forall(map, z -> z.iv = z.dv)"))
    # Neighbours, as a word more or less shifts what follows, are taken together as far as they agree, large ones first.
    order = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    far = F.coalesce(F.col("shift") - F.lag("shift").over(order) > F.col("n"), F.lit(True)).cast("int")
    near = aligned.withColumn("far", far).withColumn("place", F.sum("far").over(order)).groupBy("doc_id", "item_id", "place").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.size("found")).alias("size"), "shift", "found", "map"))).alias("all"))
    agreed = F.expr("""
        aggregate(all, struct(cast(array() as array<int>) as found, cast(array() as array<struct<iv: string, dv: string>>) as map),
                  (acc, x) -> if(size(array_union(acc.map, x.map)) = size(array_union(transform(acc.map, z -> z.iv), transform(x.map, z -> z.iv))),
                                 struct(array_union(acc.found, x.found) as found, array_union(acc.map, x.map) as map), acc))""")
    held = near.select("doc_id", "item_id", "n", agreed.alias("a")).select("doc_id", "item_id", "n", F.size("a.found").alias("k"), F.exists("a.map", lambda z: z["iv"] != z["dv"]).alias("other"))
    best = held.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.max(F.struct("k", (~F.col("other")).alias("own"))).alias("b"))
    share = F.col("b.k") / F.col("n_windows")
    return best.where(share >= coverage - 1e-9).select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("b.k").cast("long").alias("n_matched"), F.round(share, 6).alias("coverage"), (~F.col("b.own")).alias("reparameterised"))
