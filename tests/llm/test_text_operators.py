"""Quality rules, line dedup, toxicity, decontamination, pieces and packing on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilwork.llm import decontaminate, line_dedup, quality, sentence_pieces, token_packing, toxicity

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def as_bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- quality

def plain_base(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_base(make):
    got = quality.judge(make(ODD, clash=True)).collect()
    assert len(got) == len(ODD)
    want = Counter((i, *plain_base(t)) for i, t in ODD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repeat_words_with_many_words():
    words = [b"w%d" % (i % 9000) for i in range(20_000)]
    text = b" ".join(words)
    assert quality.base_counts(text, words)[3] == plain_base(text.decode())[4]


def test_quality_divergence(make):
    rng = np.random.default_rng(1)
    names = ["the", "of", "and", "to", "house", "river", "stone", "green", "walks", "over"]
    good = [(i, " ".join(rng.choice(names, 120))) for i in range(60)]
    bad = [(100, " ".join("#%$&*" for _ in range(120)) + " " + " ".join(f"a{i}" for i in range(9))),
           (101, " ".join(f"zz{i}q" for i in range(300)))]
    got = {r.doc_id: r for r in quality.judge(make(good + bad)).collect()}
    assert all(got[i].kept for i, _ in good) and not got[101].kept and not got[100].kept
    assert {r.doc_id for r in quality.keep(make(good + bad, clash=True)).collect()} == {i for i, _ in good}
    assert quality.judge(make([])).count() == 0 and quality.keep(make([])).count() == 0


def test_classes_of_any_script():
    import unicodedata
    assert quality.char_classes("Ab1 ,#".encode()) == [1, 1, 1, 1, 1, 0]
    assert quality.char_classes("Привет, МИР №5 «да»".encode()) == [7, 4, 1, 3, 1, 0]
    assert quality.char_classes("漢字\u3000かな。é".encode()) == [1, 0, 0, 1, 0, 4]
    assert sum(quality.char_classes("x\u0301 ".encode() + b"\xff")) == 3
    for text in ("The the, THE", "ÉTÉ été, «été»"):
        words = quality.folded_words(text.encode())
        assert len(set(words)) == 1 and len(words) == 3
    assert quality.folded_words(b"A | b.\xff |") == ["a".encode(), b"|", "b.\ufffd".encode(), b"|"]
    some = [chr(c) for c in range(0x20, 0x3000, 7)]
    for c in some:
        if unicodedata.category(c) in ("Ll", "Lu"):
            assert quality.char_classes(f"é{c}".encode())[unicodedata.category(c) == "Lu"] >= 1


def test_shouted_and_littered_text_of_another_script(make):
    rng = np.random.default_rng(2)
    names = ["дом", "река", "камень", "идёт", "через", "над", "лес", "и", "на", "не"]
    good = [(i, " ".join(rng.choice(names, 120))) for i in range(60)]
    bad = [(100, good[0][1].upper()), (101, " ".join("№§¤ " + w for w in rng.choice(names, 120)))]
    got = {r.doc_id: r for r in quality.judge(make(good + bad)).collect()}
    assert all(got[i].kept for i, _ in good)
    assert got[100].char_distance > quality.MAX_CHAR_DISTANCE and not got[100].kept and not got[101].kept


def test_many_languages_give_few_references(spark):
    rows = [(i, "".join(f"{c}" for c in f"l{i}") if i >= 300 else "en", "one two three four five six seven") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert set(quality.references(docs)) == {"en"} and quality.judge(docs).count() == 600


def test_distance():
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.distance(np.array([2.0, 1]), np.array([4.0, 2])) == pytest.approx(0)


# --- line dedup

def plain_lines(rows, min_chars=10):
    keys = defaultdict(set)

    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                keys[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < min_chars or min(keys[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def test_line_dedup(make, spark):
    rows = ODD + [(100 + i, f"own line number {i}\nthe most common line\n{'shared by some' if i % 7 == 0 else 'é' * 9}") for i in range(300)]
    assert as_bag(line_dedup.dedup_report(make(rows, clash=True)).collect()) == as_bag(plain_lines(rows))
    kept = line_dedup.dedup_text(make(ODD, clash=True))
    assert kept.columns == make(ODD, clash=True).columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] is None and texts[10] == "other words here\nsame same" and texts[6] == ""
    assert line_dedup.dedup_report(make([])).count() == 0


def test_runs_meet_at_partition_borders(make, spark):
    """A hash that starts a partition may be a later part of the list before; only its own first document stays open."""
    lines = [(b"a", d, 0, 0) for d in range(5)]
    first, second = list(line_dedup._runs(iter(lines[:3]))), list(line_dedup._runs(iter(lines[3:] + [(b"b", 9, 0, 1)])))
    assert [r[2] for r in first if r[0] == line_dedup.DROP] == [1, 2]
    assert [r[2] for r in second if r[0] == line_dedup.OPEN] == [3] and [r[2] for r in second if r[0] == line_dedup.DROP] == [4]
    assert [(r[1], r[2]) for r in second if r[0] == line_dedup.EDGE] == [(b"a", 3), (b"b", 9)]


# --- toxicity

def plain_edits(a, b):
    """Least edits, neighbours in each other's place being one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    rng = np.random.default_rng(3)
    stems, words = {"abcde": 1, "ccab": 0, "dcbadcba": 2}, {"baddab": 2, "eee": 0, "abba": 1}
    lex, seen = toxicity.Lexicon(stems, words), Counter()
    some = ["".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(3000)]
    for t in (*stems, *words):  # near the terms as well
        for _ in range(300):
            w = list(t)
            for _ in range(rng.integers(1, 4)):
                k = int(rng.integers(len(w)))
                how = rng.integers(4)
                w[k:k + 2] = (w[k:k + 2][::-1], w[k + 1:k + 2], [*"x", *w[k + 1:k + 2]], [w[k], "a", *w[k + 1:k + 2]])[how]
                w = w or ["a"]
            some.append("".join(w))
    for w in some:
        best = toxicity.NONE
        for t, most in stems.items():
            d = min(plain_edits(t, w[:k]) for k in range(len(w) + 1))
            best = min(best, d if d <= most else toxicity.NONE)
        for t, most in words.items():
            d = plain_edits(t, w)
            best = min(best, d if d <= most else toxicity.NONE)
        assert lex.match(w) == best, w
        seen[best] += 1
    assert min(seen[k] for k in range(4)) > 20


def test_disguised_terms():
    lex = toxicity.Lexicon({"idiot": 1, "scum": 1, "blockhead": 2}, {"stupid": 1})
    for text in ("what an idoit", "stuipd thing", "scun here", "an id*ot, really", "s.c.u.m", "S-T-U-P-I-D!", "st@p!d", "blokchaed"):
        assert toxicity.features(text, lex) == (0, 1, 0), text
    for text in ("1.2.3.4 and a-b-c-d", "u.s.s.r", "i****", "mail me@home.org", "a*b*c*d*e", "", "*.*", "i*t"):
        assert toxicity.features(text, lex) == (0, 0, 0), text
    assert toxicity.features("idiot*s", lex) == (1, 0, 0)
    assert toxicity.features("x" * 200_000, lex) == (0, 0, 0)


def test_quotations_never_add_up_to_abuse():
    lex = toxicity.Lexicon({"idiot": 1}, {})
    text = " and then some more of it. ".join(['they wrote "idiot" there'] * 40)
    a, b, q = toxicity.features(text, lex)
    assert (a, b) == (0, 0) and q == 10
    assert toxicity.features("idiot " * 40, lex)[0] == 40
    assert toxicity._vector(a, b, q)[1:5] == [0, 0, 0, 0]


def test_windows():
    plain = "what a fool this is"
    assert toxicity.window_score(plain, 7, 11) == 1
    assert toxicity.window_score('he said "fool" then', 9, 13) == 0.25
    assert toxicity.window_score("you fool of a man", 4, 8) == 1.5


def test_toxic_documents(make, spark):
    rng = np.random.default_rng(5)
    names = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(names, 40))
        if i % 6 == 0:
            words.insert(int(rng.integers(40)), "nastyword")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000, " ".join(rng.choice(names, 20)) + " nastywrod nastywood " + " ".join(rng.choice(names, 20))), (1001, None), (1002, "")]
    labels += [(None, 1, 1), (7, 1, None), (9999, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(make(rows, clash=True), lab).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in out) and sum(r.held_out for r in got.values() if r.doc_id < 600) == len(out)
    assert all(got[i].predicted == (i % 6 == 0) for i in range(600))
    assert got[1000].predicted == 1 and got[1001].score == got[1002].score < 0.7
    none = toxicity.score(make(ODD), lab.where("toxic = 0")).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.0}
    assert toxicity.score(make([]), lab).count() == 0


def test_quoted_terms_are_learned(make, spark):
    rng = np.random.default_rng(6)
    names = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(names, 40))
        words.insert(int(rng.integers(5, 35)), "nastyword" if i % 6 == 0 else '"nastyword"' if i % 6 == 1 else "fine")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(make(rows), lab).collect()}
    assert all(got[i].predicted == (i % 6 == 0) for i in range(900))
    many = (5000, " ".join([*rng.choice(names, 20), *(f'said "nastyword" {w}' for w in rng.choice(names, 10))]))
    assert toxicity.score(make([*rows, many]), lab).where("doc_id = 5000").first().predicted == 0


# --- decontamination

def test_templates(make, spark):
    bench = spark.createDataFrame([
        (1, "Anna Smith buys 12 apples at 3 dollars each and 5 pears. How much does Anna pay in total for all of it today?"),
        (2, "A train leaves the old station at 9 and travels 60 km per hour. How far is it after 3 hours?"), (3, None), (None, "a b c d e f g h"),
        (4, "12 13 14"), (5, "A train leaves the old station at 9 and travels 60 km per hour. How far is it after 3 hours?")],
        "item_id long, text string")
    rows = [(1, "Look: Anna Smith buys 12 apples at 3 dollars each and 5 pears. How much does Anna pay in total for all of it today? Yes."),
            (2, "So Mary Jones buys 40 apples at 7 dollars each and 9 pears. How much does Mary pay in total for all of it today?"),
            (3, "So Mary Jones buys 40 apples at 7 dollars each and 9 pears."), (4, "12 13 14 15"), (5, "a b c d e f g h"),
            (None, "Well, a train leaves the old station at 7 and travels 80 km per hour. How far is it after 4 hours?"), *((100 + (i or 0), t) for i, t in ODD)]
    got = {r.doc_id: r for r in decontaminate.contamination(make(rows, clash=True), bench).collect()}
    assert [i for i in got if got[i].contaminated] and {i for i in got if got[i].contaminated} == {1, 2, None}
    assert got[1].item_ids == [1] and got[2].item_ids == [1] and got[None].item_ids == [2]
    left = decontaminate.clean(make(rows, clash=True), bench)
    assert left.columns == make(rows, clash=True).columns and left.count() == len(rows) - 3
    assert decontaminate.contamination(make([]), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(make(rows), bench.limit(0)).collect())


def test_inconsistent_slots(make, spark):
    bench = spark.createDataFrame([(1, "then 7 and 7 and 7 over the wall 7 go 7 down the lane 7")], "item_id long, text string")
    rows = [(1, "then 5 and 5 and 5 over the wall 5 go 5 down the lane 5"), (2, "then 1 and 2 and 3 over the wall 4 go 5 down the lane 6")]
    got = {r.doc_id: r.contaminated for r in decontaminate.contamination(make(rows), bench, width=5, literals=2).collect()}
    assert got == {1: True, 2: False}


def test_each_alignment_counts(make, spark):
    train = "A train leaves the old station at {} and travels {} km per hour. How far is it after {} hours?"
    again = "then take {} red balls out of it and then take {} red balls out of it and then take {} red balls out of it at last"
    bench = spark.createDataFrame([(1, train.format(9, 60, 3)), (2, again.format(2, 5, 8)), (3, train.format(7, 80, 4))],
                                  "item_id long, text string")
    filler = " ".join(f"word{k} goes on" for k in range(40))
    rows = [(1, f"{train.format(9, 60, 3)} {train.format(5, 90, 4)}"), (2, f"{train.format(9, 60, 3)}\n{train.format(7, 80, 4)}"),
            (3, again.format(2, 5, 8)), (4, f"{again.format(1, 6, 9)} {filler} so take 77 red balls out of it and stop"),
            (5, f"{filler} travels 5 km per hour. How long?"),
            (6, f"{train.format(9, 60, 3)} {filler} {' '.join(train.format(k, k + 1, k + 2) for k in range(20, 60))}")]
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(make(rows), bench).collect()}
    assert got == {1: [1, 3], 2: [1, 3], 3: [2], 4: [2], 5: [], 6: [1, 3]}


def test_place_and_case_of_names(make, spark):
    bench = spark.createDataFrame([
        (1, "What is the capital of France?"), (2, "Anna met Bob near Paris and then Carl told Dora that Emil went on to Rome with Fred"),
        (3, "Anna has some red apples. Bob has some green pears. Carl has some blue plums. Dora has some old nuts.")],
        "item_id long, text string")
    rows = [(1, "A heading\nWhat is the capital of France?\nParis"), (2, "Questions 1) What is the capital of France?"),
            (3, "A heading\n1) What is the capital of Spain?"), (4, "WHAT IS THE CAPITAL OF FRANCE"), (5, "Madrid is the capital of Spain."),
            (6, "anna met bob near paris and then carl told dora that emil went on to rome with fred"),
            (7, "Mary has some red apples. John has some green pears. Otto has some blue plums. Ruth has some old nuts."),
            (8, "what is the\ncapital of france"), (9, "it is what the capital of france is"),
            (10, "Mary met John near\nOslo and then Otto told\nRuth that Hans went on to\nBern with Karl")]
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(make(rows), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [1], 4: [1], 5: [], 6: [2], 7: [3], 8: [1], 9: [], 10: [2]}


# --- pieces

def test_pieces_equal_the_library(make):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    rng = np.random.default_rng(2)
    rows = ODD + [(100 + k, "".join(rng.choice(list("abethe  \n▁é🙂9"), rng.integers(1, 150)))) for k in range(150)]
    rows += [(300, "ab" * 200 + " " * 50 + "x" * 70), (301, "日本語のテキスト")]
    got = sentence_pieces.pieces_of(make(rows, clash=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.piece_ids is None and r.n_pieces == 0 and r.round_trip is None
        else:
            assert r.piece_ids == sp.encode(r.text) and r.n_pieces == len(r.piece_ids)
            assert r.round_trip == (sp.decode(r.piece_ids) == r.text) or "▁" in r.text
    assert sentence_pieces.piece_report(make([])).count() == 0


def test_occurrences_by_search():
    v = sentence_pieces.Vocabulary()
    enc = sentence_pieces.Encoder(v)
    text = "▁the▁there▁▁▁▁other\x00▁tionally"
    codes = enc.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)].copy()
    codes[text.index("\x00")] = 0
    table = enc.edges(codes)
    for i in range(len(text)):
        for n in range(1, enc.depth + 1):
            piece = text[i:i + n]
            known = len(piece) == n and "\x00" not in piece and piece in {v.pieces[k] for k in v.normal}
            assert (table[i, n - 1] < len(v.pieces)) == known
            if known:
                assert v.pieces[table[i, n - 1]] == piece


# --- packing

def test_best_fit_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(30):
        length = int(rng.integers(5, 60))
        sizes = rng.integers(1, length + 1, 80)
        rows = token_packing.best_fit(sizes, length)
        assert sorted(p for r in rows for p in r) == list(range(80))
        free: list[int] = []
        for p in np.argsort(-sizes, kind="stable"):
            fits = [f for f in free if f >= sizes[p]]
            if fits:
                free[free.index(min(fits))] -= int(sizes[p])
            else:
                free.append(length - int(sizes[p]))
        assert sorted(length - sum(int(sizes[p]) for p in r) for r in rows) == sorted(free)


def test_packing_is_lossless(make):
    import base64

    import tiktoken
    with open(token_packing.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    enc = tiktoken.Encoding("t", pat_str=token_packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t) for k, (_, t) in enumerate(ODD)] + [(50, "tabs\t\tand \n\n  blanks  \x1c!\x1c!  "), (51, None)]
    packed = token_packing.packed(make(rows, clash=True), length=64, block=500)
    for r in packed.collect():
        assert len(r.ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.position_resets)
    back = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_packing.unpacked(packed).collect()}
    assert back == {k: [*enc.encode_ordinary(t), token_packing.END] for k, t in rows if t is not None}
    assert token_packing.packed(make([])).count() == 0


# --- decontamination by brute force

def plain_windows(text, width, canon):
    """{(position, window, slots)} over all forms; a window is written out, token by token."""
    *forms, at = canon.forms(text)
    size = min(width, len(at))
    out = set()
    for k, form in enumerate(forms):
        if form is not None:
            h, kind = form
            for p in range(len(at) - size + 1):
                slots = tuple(canon.word(at[q]) for q in range(p, p + size) if kind[q] != decontaminate.LITERAL)
                out.add((k, p, tuple(h[p:p + size].tolist()), slots, int((kind[p:p + size] == decontaminate.LITERAL).sum())))
    return out, size, len(at)


def plain_found(doc, item, canon, width=6, literals=3, coverage=0.4, consistent=0.7):
    rows, size, n_tokens = plain_windows(item, width, canon)
    first = {p: lit for k, p, _, _, lit in rows if k == 0}
    good = {p for p, lit in first.items() if lit >= literals} or {p for p, lit in first.items() if lit}
    rows = {r for r in rows if r[1] in good and not (n_tokens <= width and r[0] == 2) and (r[0] == 0 or r[4] >= literals)}
    if not any(first.values()) or not rows:
        return None
    n = len({p for _, p, *_ in rows})
    *forms, at = canon.forms(doc)
    mine = set()
    for form in forms:
        if form is not None:
            for p in range(len(at) - size + 1):
                mine.add((p, tuple(form[0][p:p + size].tolist()), tuple(
                    canon.word(at[q]) for q in range(p, p + size) if form[1][q] != decontaminate.LITERAL)))
    met = [(dp - p, p, s, ds) for _, p, w, s, _ in rows for dp, dw, ds in mine if dw == w]
    bins = defaultdict(list)
    for d, p, s, ds in met:
        for key in [(0, 0), (1, d)] + [x for b in range(1, 11) if 4 ** b < n + size for x in (
                (4 ** b, d // 4 ** b), (-4 ** b, int(np.floor(d / 4 ** b + 0.5))))]:
            bins[key].append((p, s, ds))
    best = None
    for group in bins.values():
        share = len({p for p, _, _ in group}) / n
        values = defaultdict(set)
        for _, s, ds in group:
            for a, b in zip(s, ds):
                values[a].add(b)
        fit = np.mean([len(v) == 1 for v in values.values()]) if values else 1.0
        if share >= coverage and fit >= consistent:
            best = max(best or 0, share)
    return best


def test_decontamination_by_brute_force(make, spark):
    rng = np.random.default_rng(5)
    names, units = ["Anna", "Bob", "Carla Diaz", "Dev"], ["kg", "km", "hours"]
    frames = ["{} buys {} {} of rice and {} sells {} {} of it on the market. How much does {} keep?",
              "A train with {} wagons leaves at {} and stops after {} {}. Where is {} then, if the way takes {} {}?",
              "What is the capital of France?", "{} + {} = ?"]

    def filled(frame):
        parts = frame.split("{}")
        fill = [rng.choice(names) if rng.random() < 0.4 else str(rng.integers(2, 99)) if rng.random() < 0.6 else rng.choice(units)
                for _ in parts[1:]]
        return parts[0] + "".join(f + p for f, p in zip(fill, parts[1:]))

    items = [(k, filled(frames[k % 4])) for k in range(16)] + [(50, None), (51, ""), (52, "12 34 Anna")]
    filler = ["the rain fell on the old town all day long", "Nobody knew where it went. Then Anna came", "3 kg of it"]
    docs = []
    for k in range(60):
        parts = list(rng.choice(filler, rng.integers(0, 3)))
        if rng.random() < 0.7:
            parts.insert(rng.integers(0, len(parts) + 1), filled(frames[k % 4]) if rng.random() < 0.5 else items[k % 16][1])
        text = ["\n", " ", ". "][k % 3].join(parts)
        docs.append((k, text.lower() if rng.random() < 0.2 else text))
    docs += ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(dict)
    for r in decontaminate.found_items(make(docs), bench).collect():
        got[r.doc_id][r.item_id] = round(r.share, 6)
    canon, least = decontaminate.Canon(), {}
    for i, t in items:
        if t is not None:
            least[t] = min(i, least.get(t, i))
    for i, text in docs:
        if i is not None and sum(x == i for x, _ in docs) == 1:
            want = {j: plain_found(text, t, canon) for t, j in least.items()} if text is not None and len(text) < 9000 else {}
            assert got[i] == {j: round(s, 6) for j, s in want.items() if s is not None}, (i, text)
    assert sum(map(len, got.values())) > 30
