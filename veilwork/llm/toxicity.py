"""Toxicity by a learned lexicon: a Levenshtein automaton intersected with its trie, and scores of context windows.

Words and word stems that mark toxic documents are learned from labelled rows. A word is held against all of them at once
by the states (trie node, edits) that it can reach; sets of such states are the states of a deterministic automaton that
is built as words need it, so a word costs a table look-up a character and most die after a few. A hit's window decides
what it counts: near quotation marks or words of reporting it is taken as quotation, near a second person as abuse.
Letters hidden by symbols (id*ot) are met as any letter, words spelled out (s.c.u.m) by their letters. A logistic model over
a document's sums of window scores, quoted ones apart, gives the score.

A term is met within one edit or, if longer, two, as far as the sample's clean documents don't hold words so near to it.

Fitting takes at most ``fit_rows`` labelled documents (by hash of doc_id), a documented bound; scoring covers every text.

Defined cases: null and empty texts have no hits and get the score of a document without any. Without toxic or without
clean labelled rows all scores are 0. Several labels of a document count as toxic if one is; null labels and null doc_ids
are no labels. A null doc_id is scored and not held out. Repeated rows each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import mapped, stage

WORD = re.compile(r"\w+")
# Words of reporting and of the second person in the languages of the tables.
REPORTING = set("said says say saying quote quoted quotes wrote writes called calls term word phrase insult insults slur "
                "sagte sagt schrieb zitat zitiert nannte wort dit disait écrit citation cité mot terme dijo dice "
                "escribió cita palabra término".split())
SECOND = set("you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos tú ti "
             "usted ustedes".split())
QUOTES = "\"“”„«»‘’'"
#: Hits' windows reach so many characters to both sides.
WINDOW = 48
MIN_STEM, MAX_STEM = 4, 12
#: Terms from these lengths on are met within one edit, and within two.
ONE_EDIT, TWO_EDITS = 4, 8
NONE = 3
#: So many words' edits are kept at hand, none of them longer than LONG.
KNOWN, LONG = 500_000, 48
#: Letters hidden by symbols, and words spelled letter by letter; the first pattern of each tells whether to look at all.
MASK = re.compile(r"[*#@$!]")
MASKED_HINT, MASKED = re.compile(r"[*#@$!][^\W\d_]"), re.compile(r"(?<!\w)[^\W\d_]+(?:[*#@$!]+[^\W\d_]+)+(?!\w)")
SPELLED_HINT = re.compile(r"[.\-_*·][^\W\d_][.\-_*·][^\W\d_]")
SPELLED = re.compile(r"(?<!\w)[^\W\d_](?:[.\-_*·][^\W\d_]){3,}(?!\w)")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# --- the automaton

class Lexicon:
    """Trie of stems (any ending fits) and whole words, each with the number of edits within which it is met.

    An edit is a character too many, left out or exchanged, or two neighbours in each other's place. A state is a set of
    (node, edits, character that must come next to end an exchange of neighbours).
    """

    def __init__(self, stems: dict[str, int], words: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.stem: list[int] = [-1]  # edits allowed, -1: no term
        self.word: list[int] = [-1]
        self.deep: list[int] = [-1]  # the most edits that a term below the node allows
        for terms, mark in ((stems, self.stem), (words, self.word)):
            for t, edits in terms.items():
                node = 0
                for c in t:
                    self.deep[node] = max(self.deep[node], edits)
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        for marks in (self.stem, self.word, self.deep):
                            marks.append(-1)
                    node = self.children[node][c]
                self.deep[node] = max(self.deep[node], edits)
                mark[node] = max(mark[node], int(edits))
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int]] = []  # least edits to a stem, and to a word's end
        self.start = self._state({(0, 0, "")})
        self.known: dict[str, int] = {}

    def _state(self, places: set[tuple[int, int, str]]) -> int:
        least: dict[tuple[int, str], int] = {}
        todo = list(places)
        while todo:
            node, e, wait = todo.pop()
            if e > self.deep[node] or least.get((node, wait), NONE) <= e:
                continue
            least[node, wait] = e
            if not wait:  # a character of the term left out
                todo += [(n, e + 1, "") for n in self.children[node].values()]
        whole = frozenset((n, e, w) for (n, w), e in least.items())
        if whole not in self.ids:
            self.ids[whole] = len(self.sets)
            self.sets.append(whole)
            self.steps.append({})
            self.found.append(tuple(min((e for n, e, w in whole if not w and e <= mark[n]), default=NONE)
                                    for mark in (self.stem, self.word)))
        return self.ids[whole]

    def _next(self, state: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if wait:
                if wait == c:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))  # a character too many
            for k, n in self.children[node].items():
                out.add((n, e + (k != c), ""))  # the character, or another one
                if k != c and c in self.children[n]:
                    out.add((self.children[n][c], e + 1, k))  # neighbours in each other's place
        out = {x for x in out if x[1] <= self.deep[x[0]]}
        self.steps[state][c] = to = self._state(out) if out else -1
        return to

    def match(self, word: str) -> int:
        """Edits to the nearest term that allows as many; ``NONE`` if there is none."""
        got = self.known.get(word)
        if got is not None:
            return got
        state, best = self.start, NONE
        for c in word:
            to = self.steps[state].get(c)
            state = self._next(state, c) if to is None else to
            if state < 0:
                break
            if self.found[state][0] < best:
                best = self.found[state][0]
                if not best:
                    break
        else:
            best = min(best, self.found[state][1])
        if len(word) <= LONG:
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[word] = best
        return best

    def masked(self, word: str) -> bool:
        """Whether a word with characters hidden by symbols is a term; at least half of its characters must be readable."""
        if 2 * len(MASK.findall(word)) > len(word):
            return False
        nodes = {0}
        for c in word:
            nodes = {n for at in nodes for k, n in self.children[at].items() if k == c or MASK.match(c)}
            if any(self.stem[n] >= 0 for n in nodes):
                return True
            if not nodes:
                return False
        return any(self.word[n] >= 0 for n in nodes)


# --- documents

def _window(text: str, begin: int, end: int) -> tuple[bool, set[str]]:
    """Whether a hit is quoted or reported, and the words near it."""
    left, right = text[max(0, begin - WINDOW):begin], text[end:end + WINDOW]
    near = set(WORD.findall(left)[-4:]) | set(WORD.findall(right)[:4])
    opened = sum(left.count(q) for q in QUOTES[:-1])
    closed = sum(right.count(q) for q in QUOTES[:-1])
    quoted = opened and closed and left.rstrip()[-1:] not in ".!?" or (left[-1:] in QUOTES and right[:1] in QUOTES
                                                                      and bool(left) and bool(right))
    return bool(quoted or near & REPORTING), near


def window_score(text: str, begin: int, end: int) -> float:
    """1 for a plain hit, 0.25 for a quoted or reported one, half as much again before a second person."""
    return _weight(*_window(text, begin, end))


def _weight(quoted: bool, near: set[str]) -> float:
    return (0.25 if quoted else 1.0) * (1.5 if near & SECOND else 1.0)


def disguised(text: str, lex: Lexicon):
    """``(begin, end)`` of terms with hidden letters (id*ot) or spelled out (s.c.u.m), in a text in lower case."""
    if SPELLED_HINT.search(text):
        for m in SPELLED.finditer(text):
            if lex.match(m[0][::2]) == 0:
                yield m.span()
    if MASKED_HINT.search(text):
        for m in MASKED.finditer(text):
            if all(lex.match(w) == NONE for w in WORD.findall(m[0])) and lex.masked(m[0]):
                yield m.span()


def features(text: str, lex: Lexicon) -> tuple[float, float, float]:
    """Sums of window scores, in quarters: of plain terms, of misspelled or disguised ones, and of quoted ones of both kinds."""
    text = text.lower()
    match = lex.match
    kinds = {w: k for w in set(WORD.findall(text)) if (k := match(w)) < NONE}
    hits = [(*m.span(), kinds[m[0]] > 0) for m in WORD.finditer(text) if m[0] in kinds] if kinds else []
    hits += [(*at, True) for at in disguised(text, lex)]
    sums = [0.0, 0.0, 0.0]
    for begin, end, odd in hits:
        quoted, near = _window(text, begin, end)
        sums[2 if quoted else odd] += _weight(quoted, near)
    return tuple(round(4 * x) / 4 for x in sums)


# --- fitting

def sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """``(toxic, text)`` of at most fit_rows labelled documents that aren't held out; doc_ids in order of their hash."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id is not null and toxic is not null"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # so its size is bounded
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return stage(texts.join(F.broadcast(some), "id").select("toxic", F.coalesce("text", F.lit("")).alias("text")), "fit")


def _terms(text: str) -> set[str]:
    """A document's words with an end mark, and their stems."""
    words = set(WORD.findall(text.lower()))
    return {w[:k] for w in words for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} | {f"{w}$" for w in words if len(w) > 2}


def _plain_terms(text: str) -> set[str]:
    """The terms of a document that it holds outside quotations and reports."""
    text = text.lower()
    if not any(q in text for q in QUOTES) and REPORTING.isdisjoint(WORD.findall(text)):
        return _terms(text)
    plain: set[str] = set()
    for m in WORD.finditer(text):
        if m[0] not in plain and not _window(text, m.start(), m.end())[0]:
            plain.add(m[0])
    return _terms(" ".join(plain))


def _counts(fit: DataFrame, toxic: int, only: frozenset | None, terms=_terms) -> DataFrame:
    def rows(of):
        c: Counter = Counter()
        for (text,) in of:
            c.update(terms(text) if only is None else terms(text) & only)
            if len(c) > 500_000:
                yield from c.items()
                c.clear()
        yield from c.items()

    return mapped(fit.where(F.col("toxic") == toxic).select("text"), rows,
                  pa.schema([("term", pa.string()), ("n", pa.int64())]), "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n"))


def _followers(fit: DataFrame) -> DataFrame:
    """``(term, n)``: by how many different words a term is followed in toxic documents."""
    def rows(of):
        for (text,) in of:
            words = WORD.findall(text.lower())
            for w, after in set(zip(words, [*words[1:], ""])):
                for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1):
                    yield w[:k], after
                if len(w) > 2:
                    yield f"{w}$", after

    return mapped(fit.where("toxic = 1").select("text"), rows,
                  pa.schema([("term", pa.string()), ("after", pa.string())]), "term string, after string").groupBy(
        "term").agg(F.countDistinct("after").alias("n"))


def choose(bad: dict[str, int], places: dict[str, int], good: dict[str, int], n_bad: int, n_good: int,
           plain_bad: dict[str, int] | None = None, plain_good: dict[str, int] | None = None) -> tuple[list[str], list[str]]:
    """Stems and whole words that mark toxic documents beyond chance.

    A term's support must be less likely than 1e-6 if it fell on documents at random, and at least 95 % of the documents
    it is in must be toxic, of all documents or of those that hold it outside quotations and reports (the plain counts). So
    a term that clean documents only quote is one, and windows and the model tell its uses apart. Support counts documents, but no more than the words that follow the term, as copies of one
    document are no evidence. Of nested stems the longest that loses less than a twentieth of the support stays.
    """
    rate = -math.log10(n_bad / (n_bad + n_good))

    def marks(t, b, g):
        return min(b, places.get(t, 0)) * rate - 2 * g >= 6 and b >= max(3, 0.95 * (b + g))

    fine = {t for t in bad if marks(t, bad[t], good.get(t, 0))}
    fine |= {t for t, b in (plain_bad or {}).items() if t in bad and marks(t, b, (plain_good or {}).get(t, 0))}
    stems: list[str] = []
    roots = [t for t in fine if not t.endswith("$") and not any(t[:k] in fine for k in range(MIN_STEM, len(t)))]
    kids: dict[str, list[str]] = {}
    for t in fine:
        if not t.endswith("$") and t[:-1] in fine:
            kids.setdefault(t[:-1], []).append(t)
    for root in roots:
        t = root
        while (longer := [k for k in kids.get(t, ()) if bad[k] >= 0.95 * bad[root]]):
            t = max(longer, key=lambda k: (bad[k], k))
        stems.append(t)
    words = [t[:-1] for t in fine if t.endswith("$") and not any(t[:-1].startswith(s) for s in stems)]
    return sorted(stems), sorted(words)


def logistic(table: list[tuple[float, float, float, int, int]], ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Newton's method on (sum, misspelled sum, quoted sum, label, documents) rows; at most a row for each fitted document."""
    x = np.array([_vector(a, b, q) for a, b, q, _, _ in table])
    y = np.array([t for *_, t, _ in table], float)
    n = np.array([c for *_, c in table], float)
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (n * (p - y)) + keep @ w
        bend = x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + keep
        w = w - np.clip(np.linalg.solve(bend, slope), -3, 3)
    return w


def _vector(a: float, b: float, q: float) -> list[float]:
    """Misspelled terms count nine tenths of exact ones, unless the sample's documents tell otherwise; quoted ones, however
    many, have a feature of their own and are never taken for plain ones."""
    any_b, log_b = float(b > 0), math.log1p(b)
    return [1.0, float(a > 0) + 0.9 * any_b, math.log1p(a) + 0.9 * log_b, any_b, log_b, math.log1p(q)]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> tuple[Lexicon, np.ndarray] | None:
    """The lexicon and the model's weights; None if one kind of label is missing."""
    rows = sample(docs, labels, fit_rows)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    if not n_bad or not n_good:
        return None
    least = 6 / -math.log10(n_bad / (n_bad + n_good))
    bad = {r["term"]: r["n"] for r in _counts(rows, 1, None).where(F.col("n") >= max(3, least)).collect()}
    good = {r["term"]: r["n"] for r in _counts(rows, 0, frozenset(bad)).collect()}
    places = {r["term"]: r["n"] for r in _followers(rows).where(F.col("n") >= least).collect()}
    # only terms with clean documents and support enough can be judged otherwise by their plain uses
    quoted = frozenset(t for t in bad if good.get(t) and places.get(t, 0) >= least)
    plain_bad, plain_good = ({r["term"]: r["n"] for r in _counts(rows, k, quoted, _plain_terms).collect()} for k in (1, 0))
    stems, words = choose(bad, places, good, n_bad, n_good, plain_bad, plain_good)
    edits = {t: 2 if len(t) >= TWO_EDITS else 1 for t in (*stems, *words) if len(t) >= ONE_EDIT}

    def misspelled(of):  # terms that are met by edits in clean documents, and by how many
        alone = [(t, Lexicon({t: e} if t in stems else {}, {t: e} if t in words else {})) for t, e in edits.items()]
        both = Lexicon({t: edits.get(t, 0) for t in stems}, {t: edits.get(t, 0) for t in words})
        c: Counter = Counter()
        for (text,) in of:
            near = [w for w in set(WORD.findall(text.lower())) if 0 < both.match(w) < NONE]
            met = Counter()
            for w in near:
                met.update({(t, e) for t, one in alone if 0 < (e := one.match(w)) < NONE})
            c.update(met.keys())
        yield from ((t, e, n) for (t, e), n in c.items())

    loose = {(r["term"], r["e"]) for r in mapped(
        rows.where("toxic = 0").select("text"), misspelled,
        pa.schema([("term", pa.string()), ("e", pa.int32()), ("n", pa.int64())]), "term string, e int, n bigint")
        .groupBy("term", "e").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, 0.0005 * n_good)).collect()}
    edits = {t: 0 if (t, 1) in loose else 1 if (t, 2) in loose else e for t, e in edits.items()}
    lex = Lexicon({t: edits.get(t, 0) for t in stems}, {t: edits.get(t, 0) for t in words})

    def scored(of):
        for toxic, text in of:
            yield (*features(text, lex), toxic)

    table = (mapped(rows.select("toxic", "text"), scored,
                    pa.schema([("a", pa.float64()), ("b", pa.float64()), ("q", pa.float64()), ("toxic", pa.int32())]),
                    "a double, b double, q double, toxic int").groupBy("a", "b", "q", "toxic").count().collect())
    return lex, logistic([(r["a"], r["b"], r["q"], r["toxic"], r["count"]) for r in table])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, limit: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted, hits, misspelled, quoted)`` per row; the last three are sums of window scores."""
    model = fit(docs, labels, fit_rows)

    def rows(of):
        for doc_id, out, text in of:
            sums = features(text, model[0]) if model and text else (0.0, 0.0, 0.0)
            p = float(1 / (1 + math.exp(-max(-40.0, min(40.0, float(np.dot(model[1], _vector(*sums)))))))) if model else 0.0
            yield doc_id, out, p, int(p >= limit), *sums

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(src.select("doc_id", held_out(F.col("doc_id")), "text"), rows,
                  pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                             ("predicted", pa.int32()), ("hits", pa.float64()), ("misspelled", pa.float64()),
                             ("quoted", pa.float64())]),
                  "doc_id bigint, held_out boolean, score double, predicted int, hits double, misspelled double, "
                  "quoted double")
