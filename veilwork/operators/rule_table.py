"""Detector rules as rows of a table: read, checked, and compiled to the detector's expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import ALL_RULES, Rule

SCHEMA = ("type string, ord int, pattern string, score double, labelled boolean, label_counts boolean, "
          "guard array<string>")
#: A rule table becomes literals of the plan, so it must stay small; a larger one is refused.
MOST_RULES = 1000


def problems(spark: SparkSession, rule: Rule) -> list[str]:
    """What is wrong with a rule; patterns are tried by the expression engine that will run them."""
    found = []
    if not rule.type:
        found.append("no type")
    if rule.score is None or not 0 < rule.score <= 1:
        found.append("score is not above 0 and at most 1")
    try:
        empty = spark._jvm.java.util.regex.Pattern.compile(rule.pattern or "").matcher("")
    except IllegalArgumentException as e:
        return [*found, f"pattern: {str(e).splitlines()[0]}"]
    if rule.labelled and empty.groupCount() != 3:
        found.append(f"a labelled pattern has the groups (label)(value)(tail), not {empty.groupCount()} groups")
    if empty.find():
        found.append("pattern matches the empty text")
    if any(g != g.lower() for g in rule.guard):
        found.append("guards are lower-case")
    return found


def rules_from(table: DataFrame, known: Sequence[Rule] = ()) -> list[Rule]:
    """The rules of a table with the columns of ``SCHEMA``, in order, after those in ``known`` (such as ``ALL_RULES``).

    ``ord`` settles ties between overlapping matches and names a rule, so it must be given once. Raises ValueError with
    all that is wrong, before any text is read.
    """
    rows = table.select("type", "ord", "pattern", "score", "labelled", "label_counts", "guard").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    new = [Rule(r.type, r.ord, (r.pattern or "").replace("'", r"\x27"), r.score, bool(r.labelled), bool(r.label_counts),
                tuple(r.guard or ())) for r in rows]
    seen = {r.ord: r.type for r in (*ALL_RULES, *known)}
    wrong = []
    for rule in new:
        issues = problems(table.sparkSession, rule)
        if rule.ord is None or rule.ord in seen:
            issues.append(f"ord {rule.ord} is missing or taken")
        seen[rule.ord] = rule.type
        wrong += [f"{rule.type} {rule.ord}: {issue}" for issue in issues]
    if wrong:
        raise ValueError("; ".join(wrong))
    return [*known, *sorted(new, key=lambda r: r.ord)]
