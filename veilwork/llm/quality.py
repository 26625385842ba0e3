"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is held against the reference of its language by
the Jensen-Shannon distance (base 2, so 0 to 1). The references are sums over all documents of the language. Guards:
a document with fewer than ``min_chars`` characters isn't judged by its characters, one with fewer than ``min_words``
words isn't judged by its words, and a language with fewer than ``min_docs`` documents, or a smaller part of all documents
than ``LANGUAGE_SHARE``, gives no reference. Words are compared without case and without
signs at their ends.

Defined cases: a null text has no words. A document without a language, or in one without a reference, is held against
all references and judged by the nearest; without any reference only the base rules hold. Repeated rows each get a row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import mapped, stage

#: Classes of characters of any script; other: letters without case, and marks.
CLASSES = ["lower", "upper", "digit", "stop", "symbol", "other"]
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: A document fails by its characters or by its words beyond these distances.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.47
#: A common word has this share of its language's words.
COMMON_SHARE = 0.002
#: A language with a reference has this share of all documents.
LANGUAGE_SHARE = 0.0005
FLUSH = 200_000


def _class_of(c: str) -> str:
    """A character's class as a digit; 8 for white space."""
    if c.isascii():
        return ("0" if c.islower() else "1" if c.isupper() else "2" if c.isdigit() else
                "8" if c.isspace() else "3" if c in ".,;:'-" else "4")
    kind = unicodedata.category(c)
    return ("0" if kind == "Ll" else "1" if kind in ("Lu", "Lt") else "2" if kind[0] == "N" else "8" if kind[0] == "Z" else
            "3" if kind[0] == "P" else "4" if kind[0] in "SC" else "5")


#: For bytes.translate: the class of each ASCII character.
TABLE = "".join(_class_of(chr(b)) for b in range(128)).encode() + b"9" * 128
#: Signs that are taken off a word's ends.
SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum()) + "«»“”„‘’‚…–—¿¡"
ASCII_SIGNS = SIGNS.encode("ascii", "ignore")


@cache
def _all_classes() -> np.ndarray:
    """Each code point's class, made once in a worker that meets texts beyond ASCII."""
    return np.frombuffer("".join(_class_of(chr(c)) for c in range(0x110000)).encode(), np.uint8) - ord("0")


def char_classes(text: bytes) -> list[int]:
    """Counts of the classes over code points that aren't white space."""
    if text.isascii():
        kinds = text.translate(TABLE)
        return [kinds.count(b"%d" % k) for k in range(len(CLASSES))]
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.bincount(_all_classes()[codes], minlength=len(CLASSES))[:len(CLASSES)].tolist()


def folded_words(text: bytes) -> list[bytes]:
    """Words in lower case without signs at their ends, so that `The`, `the` and `the,` are one; signs alone stay words."""
    if text.isascii():
        return [w.strip(ASCII_SIGNS) or w for w in text.lower().split()]
    return [(w.strip(SIGNS) or w).encode() for w in text.decode("utf-8", "replace").lower().split()]


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = code_points(joined)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeat = 0
    if n > 5:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
        base = len(ids) + 1
        if base < 7000:  # five ids fit 64 bits, so keys are exact
            key = w[:-4].copy()
            for k in range(1, 5):
                key = key * np.uint64(base) + w[k:n - 4 + k]
        else:  # number the pairs, then the fours, then the fives
            def numbered(a, b):
                return np.unique(a * np.uint64(n + 1) + b, return_inverse=True)[1].astype(np.uint64)
            two = numbered(w[:-1], w[1:])
            key = numbered(numbered(two[:-2], two[2:])[:-1], w[4:])
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        if same.any():
            again = np.zeros(len(s), bool)
            again[1:] |= same
            again[:-1] |= same
            covered = np.zeros(n + 1, np.int64)
            at = order[again]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + 5, -1)
            repeat = int((np.cumsum(covered[:n]) > 0).sum())
    return chars, len(SYMBOLS.findall(joined)), len(lines) - len(set(lines)), repeat


def code_points(joined: bytes) -> int:
    """Bytes that don't continue a character."""
    return len(joined) if joined.isascii() else int((np.frombuffer(joined, np.uint8) & 0xC0 != 0x80).sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms with a positive sum."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def references(docs: DataFrame, min_docs: int = 20, share: float = COMMON_SHARE, part: float = LANGUAGE_SHARE) -> dict:
    """Per language: character-class counts and common words with their counts, over all documents.

    Words are counted within a task first and summed by Spark. A language has at most 1 / share common words, and a
    reference if it has min_docs documents and this part of all, so the result's size is bounded whatever ``lang`` holds.
    """
    def rows(of):
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        held = 0

        def flush():
            for lang, c in words.items():
                for w, n in c.items():
                    yield lang, w, n
            for lang, c in chars.items():
                for k, n in enumerate(c.tolist()):
                    yield lang, b" %d" % k, n  # no word starts with a blank
            words.clear()
            chars.clear()

        for lang, text in of:
            own, c = folded_words(text), words.setdefault(lang, Counter())
            held -= len(c) - 1
            c.update(own)
            held += len(c)
            chars[lang] = chars.get(lang, 0) + np.array([1, len(own), *char_classes(text)])
            if held > FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    src = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("binary"))
    counts = mapped(src, rows, pa.schema([("lang", pa.string()), ("w", pa.binary()), ("n", pa.int64())]),
                    "lang string, w binary, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    sums = counts.where(F.substring("w", 1, 1) == b" ").groupBy("lang").agg(
        *(F.max(F.when(F.col("w").cast("string") == f" {k}", F.col("n"))).alias(f"n{k}") for k in range(2 + len(CLASSES))))
    every = sums.agg(F.sum("n0")).first()[0] or 0
    totals = {r[0]: [n or 0 for n in r[1:]] for r in sums.where(F.col("n0") >= max(min_docs, part * every)).collect()}
    spark = docs.sparkSession
    known = [(lang, int(c[1] * share)) for lang, c in totals.items()]
    if not known:
        return {}
    least = spark.createDataFrame(known, "lang string, least bigint")
    common = counts.join(F.broadcast(least), "lang").where(
        (F.col("n") >= F.greatest("least", F.lit(1))) & (F.substring("w", 1, 1) != b" "))
    found: dict = {lang: {"words": {}, "chars": totals[lang][2:],
                          "total": totals[lang][1]} for lang, _ in known}
    for r in common.collect():
        found[r["lang"]]["words"][bytes(r["w"])] = r["n"]
    return found


def _prepared(found: dict) -> dict:
    out = {}
    for lang, r in found.items():
        words = sorted(r["words"])
        n = np.array([r["words"][w] for w in words], float)
        out[lang] = (np.array(r["chars"], float), {w: k for k, w in enumerate(words)},
                     np.append(n, max(0.0, r["total"] - n.sum())))
    return out


def _distances(chars: np.ndarray, words: list[bytes], ref: tuple) -> tuple[float | None, float | None]:
    ref_chars, index, ref_words = ref
    by_char = distance(chars, ref_chars) if chars.sum() and ref_chars.sum() else None
    if not words or not ref_words.sum():
        return by_char, None
    at = [index.get(w, len(index)) for w in words]
    return by_char, distance(np.bincount(at, minlength=len(index) + 1).astype(float), ref_words)


class Rules:
    """The verdict on one text; see the module for the guards."""

    def __init__(self, found: dict, min_chars: int = 200, min_words: int = 80, max_char: float = MAX_CHAR_DISTANCE,
                 max_word: float = MAX_WORD_DISTANCE):
        self.found, self.min_chars, self.min_words = found, min_chars, min_words
        self.max_char, self.max_word = max_char, max_word
        self.refs: dict | None = None

    def verdict(self, lang: str | None, text: bytes | None) -> tuple:
        if self.refs is None:  # built in the task
            self.refs = _prepared(self.found)
        refs, text = self.refs, text or b""
        words = text.split()
        n = len(words)
        chars, symbols, dup, repeat = base_counts(text, words)
        failed = n < 10 or 100 * repeat > 20 * n
        counts = np.array(char_classes(text), float)
        judged = folded_words(text)
        near = [_distances(counts, judged, r) for r in ([refs[lang]] if lang in refs else refs.values())]
        by_char = min((c for c, _ in near if c is not None), default=None)
        by_word = min((w for _, w in near if w is not None), default=None)
        bad = (by_char is not None and counts.sum() >= self.min_chars and by_char > self.max_char
               or by_word is not None and len(judged) >= self.min_words and by_word > self.max_word)
        return n, chars, symbols, dup, repeat, by_char, by_word, failed, not failed and not bad


def judge(docs: DataFrame, min_docs: int = 20, **limits) -> DataFrame:
    """Per row: doc_id, n_words, the base counts, both distances, base_failed and kept."""
    rules = Rules(references(docs, min_docs), **limits)

    def rows(of):
        for doc_id, lang, text in of:
            yield doc_id, *rules.verdict(lang, text)

    src = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("binary"))
    long, real, flag = pa.int64(), pa.float64(), pa.bool_()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return mapped(src, rows, pa.schema([*((c, long) for c in names), ("char_distance", real), ("word_distance", real),
                                        ("base_failed", flag), ("kept", flag)]),
                  ", ".join(f"{c} bigint" for c in names)
                  + ", char_distance double, word_distance double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, min_docs: int = 20, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns; a map over the rows once the references are known."""
    rules = Rules(references(docs, min_docs), **limits)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                good = [rules.verdict(x, None if t is None else t.encode("utf-8", "surrogatepass"))[-1]
                        for x, t in zip(part.column(lang).to_pylist(), part.column(at).to_pylist())]
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
