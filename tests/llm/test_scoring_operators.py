"""Resampling, source audit and the n-gram classifier on small tables, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilwork.llm import byte_words, nb_svm, resampling, source_audit

from .conftest import ODD

RNG = np.random.default_rng(11)
SYLLABLES = ["an", "or", "the", "ing", "ed", "ka", "mi", "ro", "ü", "ñe"]


def prose(n, rng=RNG, names=SYLLABLES):
    return " ".join("".join(rng.choice(names, rng.integers(1, 4))) for _ in range(n))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- words

@pytest.mark.parametrize("digits", [False, True])
def test_words_of_bytes(digits):
    keep = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    table = byte_words.letters_table(digits)
    for text in ["", "A bÇ-d9\x85e\xa0f g h\x1ci", "x" * 50, " lead  trail ", "Ünï 12ab3 " * 30, "no_blank.at,all"]:
        want = [w.encode() for w in re.findall(keep, lowered(text))]
        for size in (3, 10, 1 << 20):
            assert [w for ws in byte_words.word_pieces(text.encode(), table, size) for w in ws] == want


# --- resampling

def plain_resample(docs, target, most, buckets, percent, min_words):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        grams = [" ".join(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]

    raw, aim = Counter(), Counter()
    for _, text in docs:
        raw.update(runs(text)[1])
    for text in target:
        aim.update(runs(text)[1])
    S, T = sum(raw.values()), sum(aim.values())
    rows = []
    for doc_id, text in docs:
        n, ids = runs(text)
        g = [math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets)))) for b in ids]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(ids), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        ranks[tuple(r)].append(k)
    return Counter((*r[:4], ranks[tuple(r)].pop() if ranks[tuple(r)] else None) for r in rows)


@pytest.mark.parametrize("most, percent", [(1, 10), (2, 35), (3, 100)])
def test_resample(make, spark, most, percent, monkeypatch):
    monkeypatch.setattr(byte_words, "PIECE", 200)
    docs = [(i, prose(RNG.integers(1, 90))) for i in range(150)] + ODD
    docs += [(7, docs[3][1])] * 4 + [(None, docs[5][1])] * 2 + [(1000 + i, docs[8][1]) for i in range(40)]
    target = [prose(30), None, "", prose(10)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(make(docs, clash=True), items, percent=percent, min_words=20, most=most, buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(docs, target, most, 97, percent, 20)


def test_resample_without_rows(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(make([]), none).count() == 0
    got = resampling.resample(make([(1, None), (2, "a few words")]), none).collect()
    assert {r.doc_id: (r.n_features, r.rank) for r in got} == {1: (0, None), 2: (3, None)}


def test_equal_rows_at_the_cutoff(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(make([(1, prose(30, np.random.default_rng(0)))] * 50), none, percent=30).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 16)) and len(got) == 50


def test_bracket_is_validated_and_widened(spark):
    able = spark.range(5000).selectExpr("id * id as score", "id as doc_id", "id as row")
    for k in (1, 7, 2500, 4999, 5000):
        for steps in (resampling.STEPS, (0.0,), (-0.2,), (-0.2, 0.01)):  # some miss the cutoff and must be widened
            low, high, above = resampling.bracket(able, 5000, k, steps)
            within = [i for i in range(5000) if low <= i * i <= high]
            assert above == sum(i * i > high for i in range(5000)) and above < k <= above + len(within)
        assert resampling.cutoff(able, k, 5000)["doc_id"] == 5000 - k
    narrow = resampling.bracket(able, 5000, 2500)
    assert sum(narrow[0] <= i * i <= narrow[1] for i in range(5000)) < 100


def test_numbered_over_partitions(spark):
    df = spark.range(1000).selectExpr("pmod(id * 37, 11) as score", "pmod(id * 7, 50) as doc_id", "id as row").repartition(7)
    got = {r["row"]: r["rank"] for r in resampling.numbered(df, "t").collect()}
    rows = sorted(range(1000), key=lambda i: (-(i * 37 % 11), i * 7 % 50, i))
    assert got == {i: k for k, i in enumerate(rows, 1)}


# --- source audit

def plain_audit(rows, min_docs, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for text, lang, source in rows]
    spread = Counter((lang, w) for lang, _, ws in words for w in set(ws))
    out = set()
    for lang in {x[0] for x in words}:
        kept = {w for (x, w), n in spread.items() if x == lang and n >= min_docs}
        counts = {s: Counter() for x, s, _ in words if x == lang}
        for x, s, ws in words:
            if x == lang:
                counts[s].update(w for w in ws if w in kept)

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for a in counts:
            pair = [(sum(abs(p[a][w] - p[b][w]) for w in kept), b) for b in counts if b != a]
            term = [(p[a][w] - q[w], w) for w in kept if counts[a][w] and p[a][w] > q[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, a, part, item, f, k) for k, (f, item) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize("cells, pairs", [(1, 1), (40, 9), (100_000, 4_000_000)])
def test_audit(spark, cells, pairs, monkeypatch):
    monkeypatch.setattr(source_audit, "ENTRIES", 50)
    monkeypatch.setattr(source_audit, "BATCH", 7)
    rng = np.random.default_rng(3)
    rows = [(prose(rng.integers(0, 60), rng, SYLLABLES[:rng.integers(3, 11)]), ["en", "de", None][rng.integers(3)],
             ["a", "b", "Ç", "z", "", None][rng.integers(6)]) for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("?! 12", "yy", "s"), ("rare words", "yy", "t"), (None, None, None)]
    rows += [rows[0]] * 3
    schema = "text string, lang string, source string, term string, n string, zero string, value string"
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    got = source_audit.audit(docs, min_docs=8, top=5, cells=cells, pairs=pairs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    want = plain_audit(rows, 8, 5)
    assert len(got) == len(want) and set(got) == want
    assert any(r[0] == "yy" and r[4] == 0 for r in got)


def test_audit_of_nothing(make):
    assert source_audit.audit(make([])).count() == 0
    assert source_audit.audit(make([(1, None)])).count() == 0


def test_shares_are_exact(spark):
    n, total = 5_000_000_000_001, 7_000_000_000_000_000
    got = spark.createDataFrame([(n, total, 11)], "n long, t long, v long").select(source_audit.share("n", "t")).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 55)


# --- naive Bayes support vectors

def plain_bins(text):
    b, out = text.encode(), set()
    for k in range(1, 5):
        for i in range(len(b) - k + 1):
            g = (int.from_bytes(b[i:i + k], "big") ^ (k * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1 % 2**32
            g ^= g >> 15
            out.add(g * 0x85EBCA77 % 2**32 >> 16)
    words, kinds = b.split(), []
    for i, w in enumerate(words):
        before = [i - j for j in range(i) if words[j] == w]
        kinds.append(0 if not before else 1 + sum(min(before) > d for d in nb_svm.BACK))
    first = 1 << 16
    for k in range(1, 4):
        for i in range(len(kinds) - k + 1):
            out.add(first + sum(x * 6 ** (k - 1 - j) for j, x in enumerate(kinds[i:i + k])))
        first += 6 ** k
    return sorted(out)


def test_indicators():
    for text in ["", "a", "ab", "one two one one two three " * 20, "Übergröße 🙂 naïve", prose(300), "x" * 5000]:
        assert nb_svm.indicators(text.encode()).tolist() == plain_bins(text)
    assert nb_svm.indicators(None).tolist() == []


def test_pieces_hold_the_same_byte_ngrams(monkeypatch):
    text = prose(400).encode()
    whole = [x for x in nb_svm.indicators(text) if x < 1 << nb_svm.BYTE_BITS]
    monkeypatch.setattr(nb_svm, "PIECE", 100)
    assert [x for x in nb_svm.indicators(text) if x < 1 << nb_svm.BYTE_BITS] == whole


def test_log_ratios():
    rows, good = [np.array([0, 3]), np.array([3]), np.array([5])], np.array([True, True, False])
    r = nb_svm.log_ratios(rows, good)
    d = 1 << nb_svm.BITS
    assert r[3] == pytest.approx(math.log((3 / (d + 3)) / (1 / (d + 1))))
    assert r[5] == pytest.approx(math.log((1 / (d + 3)) / (2 / (d + 1))))


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    good = rng.random(60) < 0.5
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 7)) + 6 * int(y)) for y in good]
    ratio = np.zeros(1 << nb_svm.BITS)
    ratio[:20] = rng.normal(size=20)
    cost = 0.7
    w = nb_svm.dual_descent(rows, good, ratio, cost, 3000)
    x = np.zeros((60, 21))
    for k, b in enumerate(rows):
        x[k, b] = ratio[b] / np.linalg.norm(ratio[b])
        x[k, 20] = 1
    y = np.where(good, 1.0, -1.0)
    own = np.append(w[:20], w[-1])

    def loss(v):
        return v @ v / 2 + cost * np.maximum(0, 1 - y * (x @ v)).sum()

    dual, gram = np.zeros(60), (x * y[:, None]) @ (x * y[:, None]).T  # the dual by projected gradient
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        dual = np.clip(dual + step * (1 - gram @ dual), 0, cost)
    assert loss(own) == pytest.approx(dual.sum() - dual @ gram @ dual / 2, rel=1e-3)


def quality_tables(spark, make, n=260):
    rng = np.random.default_rng(8)

    def bad(k):
        words = prose(rng.integers(30, 90), rng).split()
        return [" ".join(f"{w}%%%" for w in words), " ".join(w for w in words[:6] for _ in range(9)), " | ".join(words)][k % 3]
    docs = [(i, bad(i) if i % 4 == 0 else prose(rng.integers(30, 90), rng)) for i in range(n)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(n)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_scores(spark, make):
    docs, labels = quality_tables(spark, make)
    more = labels.unionByName(spark.createDataFrame([(3, None, 0), (None, 1, 1), (4, 1, 0), (9999, 0, 0)], labels.schema))
    got = nb_svm.score(make(docs + ODD, clash=True), more).collect()
    assert len(got) == len(docs) + len(ODD)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    ours = [r for r in got if r.doc_id is not None and r.doc_id >= 20 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in ours]) > 0.95


def test_quality_learns_only_from_its_own_fold(spark, make):
    docs, labels = quality_tables(spark, make, 120)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in nb_svm.score(make(docs), x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_without_both_classes(spark, make):
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {r.score for r in nb_svm.score(make([(i, prose(20)) for i in range(10)]), one).collect()} == {0.5}
    assert nb_svm.score(make([]), one).count() == 0
    assert nb_svm.score(make([(1, "a b"), (2, None)]), one.limit(0)).count() == 2


def test_fit_rows_bound_the_sample(spark, make):
    docs, labels = quality_tables(spark, make, 120)
    assert nb_svm.fit(make(docs), labels, fit_rows=1) is None and nb_svm.fit(make(docs), labels, fit_rows=60) is not None
