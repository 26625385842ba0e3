"""Span extraction and overlap resolution against plain Python on small inputs."""

import random
import re

from pyspark.sql import functions as F

from veilwork.functions import spans as sp
from veilwork.functions.rules import DIGIT_RULES, OTHER_RULES

PLAIN = {  # single-type patterns without labels, as plain Python expressions
    401: r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 501: r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b",
    502: r"\b[0-9]{2,4}[/-][0-9]{1,2}[/-][0-9]{1,2}\b", 701: r"\b[0-9]{5}(?:-[0-9]{4})?\b",
    601: r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b",
    1501: r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 903: r"\b[A-Z]{2,4}-[0-9]{6,10}\b",
    1701: r"\bNCT[0-9]{8}\b", 201: r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    1401: r"https?://[^\s]+",
    301: r"(?:\+1[-.\s]?|\b1[-.\s]?|\b)[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
}
BITS = ["12", "345", "6789", "-", "-", "/", ".", " ", "\n", "é", "A", "NCT", "NCT12345678", "@", "x.org",
        "123-45-6789", "10.0.0.1", "ABC-123456", "1", "+1", "555-123-4567", "12345", "https://a b", "\xa0", "_"]


def test_rules_match_plain_expressions(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    rules = [r for r in DIGIT_RULES + OTHER_RULES if r.ord in PLAIN]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: sorted((s.ord, s.begin, s.end, s.original) for s in r.s)
           for r in df.select("id", sp.detect("text", rules).alias("s")).collect()}
    for i, text in enumerate(texts):
        want = sorted((o, m.start(), m.end(), m.group()) for o, p in PLAIN.items()
                      for m in re.finditer(p, text))
        assert got[i] == want, text


def greedy(spans):
    best = sorted(spans, key=lambda s: (-s[4], -s[6], -(s[1] - s[0]), s[5], s[0]))
    kept = []
    for s in best:
        if all(s[0] >= k[1] or s[1] <= k[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_resolution_matches_brute_force(spark):
    rng = random.Random(7)
    cases = []
    for i in range(300):
        spans = set()
        for _ in range(rng.randint(0, 14)):
            b = rng.randint(0, 40)
            e = b + rng.randint(1, 12)
            spans.add((b, e, "T", "x", rng.choice([0.85, 0.9, 0.95]), rng.randint(1, 4), e - b))
        cases.append((i, list(spans)))
    df = spark.createDataFrame(cases, f"id int, s {sp.SPANS_TYPE}")
    out = df.select("id", sp.resolve(F.col("s")).alias("r"), F.transform(
        sp.overlapping(F.col("s")), lambda p: F.struct(p["left"], p["right"])).alias("o")).collect()
    for row in out:
        spans = cases[row.id][1]
        assert [tuple(s) for s in row.r] == greedy(spans)
        pairs = {frozenset((tuple(p[0]), tuple(p[1]))) for p in row.o}
        want = {frozenset((a, b)) for a in spans for b in spans if a != b and a[0] < b[1] and a[1] > b[0]}
        assert pairs == want and len(row.o) == len(want)


def test_detection_is_planned_once(spark, texts):
    from veilwork.operators.anonymize import anonymize
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = anonymize(texts("a@b.example.org"), "k").select(
        "anonymized", "entities_detected", "entities")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("++@[A-Za-z0-9.-]+") == 1
    assert "Exchange" not in plan and "Join" not in plan


def test_a_bound_value_is_not_copied(spark):
    """``let`` binds by the last step of an aggregate; a transform would copy its result, once for each level."""
    from pyspark.sql import functions as F
    from veilwork.functions import spans as sp
    df = spark.range(1).select(sp.let(F.array(F.col("id")), lambda v: F.concat(v, v)).alias("x"),
                               sp.let(F.lit(None).cast("string"), lambda v: F.coalesce(v, F.lit("none"))).alias("y"))
    assert "transform(" not in df._jdf.queryExecution().analyzed().toString()
    assert tuple(df.first()) == ([0, 0], "none")


def test_few_and_many_spans_settle_alike(spark):
    """Touching and lonely spans, few (compared at once) and many (by runs), give what a greedy choice over all gives."""
    import random
    from pyspark.sql import functions as F
    from veilwork.functions import spans as sp
    rng, rows = random.Random(3), []
    for n in (0, 1, 2, 5, sp.FEW, sp.FEW + 1, 200):
        for width in (2, 8, 60):
            begins = [rng.randrange(0, 10 * n + 1) for _ in range(n)]
            rows.append((len(rows), [(b, b + rng.randrange(1, width), "T", str(i), rng.choice([0.9, 0.95]), i, 1)
                                     for i, b in enumerate(begins)]))

    def greedy(spans):
        kept = []
        for s in sorted(spans, key=lambda s: (-s[4], -s[6], s[0] - s[1], s[5], s[0])):
            if not any(s[0] < k[1] and s[1] > k[0] for k in kept):
                kept.append(s)
        return sorted(kept)

    df = spark.createDataFrame(rows, f"id long, spans {sp.SPANS_TYPE}").select("id", sp.resolve(F.col("spans")).alias("r"))
    assert {r.id: [tuple(s) for s in r.r] for r in df.collect()} == {i: greedy(s) for i, s in rows}


def test_offsets_of_few_and_many_matches(spark):
    """Places count characters in texts with and without other scripts, whatever the number of matches."""
    from veilwork.functions import spans as sp
    from veilwork.functions.rules import rules_for
    texts_ = [f"{pad} ".join(f"MRN: A{i}-{i:04d}, 123-45-{i:04d}" for i in range(n)) for pad in ("x", "é\U00010400")
              for n in (1, 2, 15, 16, 17, 140)]
    df = spark.createDataFrame([(t,) for t in texts_], "text string").withColumn("s", sp.detect("text", rules_for("MRN", "SSN")))
    for row in df.collect():
        assert row.s and all(row.text[s.begin:s.end] == s.original for s in row.s)
        assert {s.weight for s in row.s if s.ord == 901} == {len(s.original) + 5 for s in row.s if s.ord == 901}


def test_types_by_halves(spark):
    """Every type has its replacement, and the choice among them is not one long CASE."""
    import re
    from veilwork.functions import pseudonyms as ps
    types = [t for t in ps.FAKE_SHAPES if t != "OTHER"] + ["PASSPORT", "A", "ZZZ"]
    df = spark.createDataFrame([(t, {"DATE": "03/15/1975", "DOB": "03/15/1975", "ZIP": "02101"}.get(t, "1 Main St, Boston, MA 02101"))
                                for t in types], "pii_type string, original string")
    for r in df.selectExpr("*", "'u' AS uuid").withColumn("fake", ps.fake("k")).collect():
        assert re.fullmatch(ps.FAKE_SHAPES.get(r.pii_type, ps.FAKE_SHAPES["OTHER"]), r.fake), r
    assert "WHEN 'ZIP'" not in ps.fake_from_digest_sql("t", "v")


def test_shapes_begin_as_they_are_looked_for():
    """No shape begins with a character that the search for replacements passes over."""
    import re
    from veilwork.functions import pseudonyms as ps
    from veilwork.operators import restore
    others = [c for c in map(chr, range(32, 0x250)) if not re.match(restore._FIRST, c)]
    tails = [" Abcdefgh", "000 Oak St, Salem, MA 00000", "ser0123456789ab@example.com", "ttps://example.org/0123456789", "X/XX/1999"]
    assert not [c for c in others for t in [*tails, "55-123-4567", "0.1.2.3", "0123456789012345", "SN-0123456789"]
                if any(re.match(s, c + t) for s in ps.FAKE_SHAPES.values())]


def test_furthest_ends_come_from_one_sort(spark):
    """No array is cut for each span to learn whether all before it have ended; nested and empty spans settle the same."""
    rng = random.Random(9)
    rows = [(i, [(b := rng.randint(0, 40), b + rng.choice([0, 1, 3, 30]), "T", "x", rng.choice([0.9, 0.95]), k, k)
                 for k in range(rng.choice([0, 1, 4, 40]))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, s {sp.SPANS_TYPE}")
    found = df.select("s", sp.resolve(F.col("s")).alias("kept"), sp.runs(F.col("s")).alias("runs"))
    assert "slice(" not in found._jdf.queryExecution().analyzed().toString()
    assert "slice(" not in sp.runs_sql("s")
    for row in found.collect():
        assert [tuple(s) for s in row.kept] == sorted(greedy([tuple(s) for s in row.s]))
        assert [tuple(s) for run in row.runs for s in run] == sorted(tuple(s) for s in row.s)
        assert all(a.end <= b.begin for left, right in zip(row.runs, row.runs[1:]) for a in left for b in right)
