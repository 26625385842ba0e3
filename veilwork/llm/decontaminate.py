"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts are canonicalised to tokens: lower case, punctuation around words left out, and a placeholder for numbers, for words
with a capital inside a sentence (names), and for units after a number. Windows of ``width`` tokens of the benchmark and of
the documents meet in a hash join; a document's windows are held against a bitmap of fixed size of the benchmark's before,
so only windows that may meet are shuffled. An item is found in a document when an alignment of the two holds at least
``coverage`` of the item's windows and its slots are consistent: each value of an item's slots stands for one value in the
document, for at least ``consistent`` of the values. So an item is found word for word and with other numbers and names.

An alignment is what meets at about the same distance (document position minus item position): at exactly one distance, at
distances in bins of 4, 16 and so on below the item's length (as names of more or fewer words shift what follows; each
width has two grids, so no alignment is cut by a bin's edge), or anywhere in the document.

Whether a word with a capital is a name depends on its place, so texts have several forms, and a window meets by any of
them: sentences begin after a stop; they also begin with a line (after its list mark); every word with a capital is a name;
no word is one. The last finds copies in any case and place. The third is not used for items of a single window, where an
item that asks and a sentence that answers would be the same.

Defined cases: null and empty texts hold nothing. Items of fewer than ``width`` tokens are one window of their own length.
An item without a literal token is no item, and windows with fewer than ``literals`` literal tokens don't count, unless the
item has no others. Items of equal text count as the one with the smallest item_id; null item_ids are left out. A null
doc_id gets a row with its own result. Repeated rows get the same result each. Empty tables find nothing. Extra columns are
left alone.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import bitmap, fresh, in_bitmap, mapped, stage

# Units, and what numbers and punctuation look like.
UNITS = set("% ‰ ° °c °f $ € £ ¥ c f k g kg mg t lb lbs oz m km cm mm nm ft in inch inches mi mile miles yd yard yards l ml "
            "cl dl gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
            "hz khz mhz ghz w kw mw v kv a ma ah wh kwh j kj cal kcal n pa kpa bar b kb mb gb tb usd eur gbp dollar dollars "
            "euro euros cent cents pound pounds percent degree degrees meter meters metre metres kilometer kilometers liter "
            "liters litre litres gram grams kilogram kilograms mph kmh rpm".split())
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
EDGES = ".,;:!?\"'“”„«»‘’()[]{}<>*_|…-–—"
STOPS = ".!?:"
MARK = re.compile(r"[(\[]?(?:\d{1,4}|[A-Za-z])[.)\]:]+|[^\w]+")  # before a line's first word
LITERAL, NUM, NAME, UNIT = 0, 1, 2, 3
_MARKS = {NUM: 0x51A9D1E5, NAME: 0x7B1C3D2F, UNIT: 0x2E8F4A6B}
_STEP = np.uint64(0x9E3779B97F4A7C15)
KNOWN = 500_000


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))


class Canon:
    """Tokens of texts by a worker's memory: a raw word's kinds don't depend on the text, only their use does."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        # of each word: hash, kind, may be a name, ends a sentence, is a list mark; new rows wait in a list
        self.table = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, bool, bool, bool))
        self.new: list[tuple] = []

    def _row(self, raw: str) -> int:
        core = raw.strip(EDGES)
        stop = core != raw and raw.rstrip("\"'”“«»’)]}")[-1:] in STOPS
        plain = len(core) > 1 and core.isalpha()  # neither a number nor a list mark
        if not core:
            row, word = (0, -1, False, stop, True), ""  # punctuation alone: no token, but it may end a sentence
        elif not plain and NUMBER.fullmatch(core):
            row, word = (_MARKS[NUM], NUM, False, stop, MARK.fullmatch(raw) is not None), core
        else:
            word = core.lower()
            name = core[:1] != word[:1] and len(core) > 1 and core[1:] == core[1:].lower()
            row = (_hash(word), UNIT if word in UNITS else LITERAL, name, stop, not plain and MARK.fullmatch(raw) is not None)
        self.known[raw] = at = len(self.words)
        self.words.append(word)
        self.new.append(row)
        return at

    def _rows(self, words: list[str]) -> np.ndarray:
        """The words' rows in the table, which has them all from then on."""
        at = list(map(self.known.get, words))
        if None in at:
            at = [k if k is not None else self.known[w] if w in self.known else self._row(w) for k, w in zip(at, words)]
            if len(self.words) > len(self.table[0]):  # room for as many again
                self.table = tuple(np.concatenate([t, np.zeros(max(1 << 12, len(self.words)), t.dtype)]) for t in self.table)
            first = len(self.words) - len(self.new)
            for column, values in zip(self.table, zip(*self.new)):
                column[first:len(self.words)] = values
            self.new = []
        return np.array(at, np.int64)

    def tokens(self, text: str):
        """(hashes, kinds, words) of a text's first form."""
        (h, kind), *_, at = self.forms(text)
        return h, kind, at

    def forms(self, text: str):
        """(hashes, kinds) of each form that differs from the first, None for others, and the words."""
        if len(self.known) > KNOWN:
            self.__init__()
        lines = [line.split() for line in text.splitlines()]
        at = self._rows([*chain.from_iterable(lines)])
        h, kind, name, stop, mark = (column[at] for column in self.table)
        if not len(at):
            return (h, kind), None, None, None, at
        start = np.concatenate([[True], stop[:-1]])
        begin = np.zeros(len(at) + 1, bool)
        begin[np.cumsum([0, *map(len, lines)])] = True  # an empty line's start is the next one's
        begin = begin[:-1]
        for _ in range(2):
            begin[1:] |= begin[:-1] & mark[:-1]
        real = kind >= 0
        h, kind, name, start, begin, at = h[real], kind[real].copy(), name[real], start[real], begin[real], at[real]
        after_number = np.concatenate([[False], kind[:-1] == NUM])[:len(kind)]
        kind[(kind == UNIT) & ~after_number] = LITERAL
        name &= kind == LITERAL

        def form(names):
            k = np.where(names, NAME, kind)
            return np.where(k == NAME, np.uint64(_MARKS[NAME]), np.where(k == UNIT, np.uint64(_MARKS[UNIT]), h)), k

        first = name & ~start
        others = (first & ~begin, name, np.zeros(len(name), bool))
        return form(first), *(None if (x == first).all() else form(x) for x in others), at

    def word(self, at: int) -> str:
        return self.words[at]


_CANON = Canon()


def _canon() -> Canon:
    """A worker keeps its words from task to task."""
    return _CANON


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    out = np.full(max(n, 0), np.uint64(width))
    for k in range(width if n > 0 else 0):
        out = (out ^ h[k:k + n]) * _STEP
        out ^= out >> np.uint64(32)
    return out * _STEP


WINDOW = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()), ("w", pa.int64()),
                    ("slots", pa.list_(pa.string()))])
WINDOW_DDL = "id bigint, rid bigint, pos int, w bigint, slots array<string>"
#: The bins of a distance d for an item of n windows: the whole document, d itself, and two grids of each width below.
BINS = """concat(array(named_struct('width', 0, 'bin', 0L), named_struct('width', 1, 'bin', cast(d as bigint))),
    flatten(transform(filter(array(4, 16, 64, 256, 1024, 4096, 16384, 65536, 262144, 1048576), x -> x < n + width),
        x -> array(named_struct('width', x, 'bin', floor(d / x)), named_struct('width', -x, 'bin', floor(d / x + 0.5D))))))"""


def _differing(forms: list, width: int):
    """(hashes, positions, kinds) by form; of the later ones the positions where they differ from the first."""
    first = None
    for form in forms:
        if form is not None:
            w = window_hashes(form[0], width)
            yield w, np.arange(len(w)) if first is None else np.flatnonzero(w != first), form[1]
            first = w if first is None else first


def item_windows(benchmark: DataFrame, width: int, literals: int) -> DataFrame:
    """``(id, pos, w, slots, n)``: windows of the items, n of them an item."""
    items = (benchmark.where("item_id is not null and text is not null").groupBy(F.col("text").cast("string").alias("text"))
             .agg(F.min(F.col("item_id").cast("bigint")).alias("id")))

    def rows(of):
        canon = _canon()
        for item, text in of:
            *forms, at = canon.forms(text)
            kind = forms[0][1]
            if not (kind == LITERAL).any():
                continue
            size = min(width, len(at))
            count = np.concatenate([[0], np.cumsum(kind == LITERAL)])
            good = np.flatnonzero(count[size:] - count[:-size] >= literals)
            good = good if len(good) else np.flatnonzero(count[size:] - count[:-size] > 0)
            if len(at) <= width:
                forms[2] = None
            for w, p, kind in _differing(forms, size):
                n = np.concatenate([[0], np.cumsum(kind == LITERAL)])
                for p in good[np.isin(good, p) & ((kind is forms[0][1]) | (n[size:] - n[:-size] >= literals)[good])].tolist():
                    yield (item, size, p, int(w[p].view(np.int64)),
                           [canon.word(at[q]) for q in range(p, p + size) if kind[q] != LITERAL])

    # rid holds the window's width here
    windows = mapped(items.select("id", "text"), rows, WINDOW, WINDOW_DDL).withColumnRenamed("rid", "width")
    n = windows.groupBy("id").agg(F.countDistinct("pos").alias("n"))
    return windows.join(n, "id")


def doc_windows(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """``(id, rid, pos, w, slots)`` of the documents' windows that may be the benchmark's."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def rows(of):
        canon = _canon()
        for doc_id, rid, text in of:
            *forms, at = canon.forms(text)
            for width in widths:
                for w, found, kind in _differing(forms, width):
                    for p in found[in_bitmap(held.value, w[found])].tolist() if len(found) else ():
                        yield (doc_id, rid, p, int(w[p].view(np.int64)),
                               [canon.word(at[q]) for q in range(p, p + width) if kind[q] != LITERAL])

    src = docs.where("text is not null").select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.col("text").cast("string"))
    return mapped(src, rows, WINDOW, WINDOW_DDL)


def found_items(docs: DataFrame, benchmark: DataFrame, width: int = 6, literals: int = 3, coverage: float = 0.4,
                consistent: float = 0.7) -> DataFrame:
    """``(doc_id, rid, item_id, share)`` of items found in documents; rid is xxhash64 of the text."""
    items = stage(item_windows(benchmark, width, literals), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most ``width`` of them
    found = stage(doc_windows(docs, bitmap(items.select("w"), "w", 22), widths), "windows")
    i = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("w").alias("item_w"), "n", "width",
                     F.col("slots").alias("item_slots"))
    met = stage(found.join(i, found["w"] == i["item_w"]).select(
        F.coalesce("id", F.lit(-2**63)).alias("id"), "rid", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("d"),
        "n", "width", "slots", "item_slots"), "met")
    binned = met.select("id", "rid", "item_id", "item_pos", "n", "slots", "item_slots", F.explode(F.expr(BINS)).alias("at"))
    key = ["id", "rid", "item_id", "at"]
    share = (binned.groupBy(*key).agg((F.countDistinct("item_pos") / F.first("n")).alias("share"))
             .where(F.col("share") >= coverage))
    pair = binned.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).groupBy(
        *key, F.col("s.item_slots").alias("was")).agg(F.countDistinct("s.slots").alias("values"))
    slots = pair.groupBy(*key).agg(F.avg(F.when(F.col("values") == 1, 1.0).otherwise(0.0)).alias("fit"))
    return (share.join(slots, key, "left").where(F.coalesce("fit", F.lit(1.0)) >= consistent)
            .groupBy("id", "rid", "item_id").agg(F.max("share").alias("share"))
            .select(F.expr("nullif(id, -9223372036854775808)").alias("doc_id"), "rid", "item_id", "share"))


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``(doc_id, contaminated, item_ids, share)`` per row; share is the largest of the items found."""
    hits = found_items(docs, benchmark, **settings).groupBy("doc_id", "rid").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    hits = stage(hits.select(F.col("doc_id").alias("hit_id"), F.col("rid").alias("hit_rid"), "item_ids", "share"), "hits")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("rid"))
    return rows.join(hits, rows["doc_id"].eqNullSafe(hits["hit_id"]) & (rows["rid"] == hits["hit_rid"]), "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    hit_id, hit_rid = fresh(docs, "hit_id"), fresh(docs, "hit_rid")
    hits = stage(found_items(docs, benchmark, **settings).select(F.col("doc_id").alias(hit_id), F.col("rid").alias(hit_rid))
                 .distinct(), "hits")
    return docs.join(hits, docs["doc_id"].cast("bigint").eqNullSafe(hits[hit_id]) & (F.xxhash64(docs["text"]) == hits[hit_rid]),
                     "left_anti")
