"""Span extraction: one text column in, one array of typed spans out, without Python workers.

Matches are wrapped in a control character by ``regexp_replace``, ``split`` cuts the text there,
and one ``aggregate`` adds up the lengths of the pieces, which gives exact character offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .rules import CAPITAL, DIGIT_RULES, MONTH_WORDS, NAME_RULES, PROVIDER_RULES, Rule

SPAN_TYPE = ("struct<begin:int,end:int,type:string,original:string,score:double,ord:int,"
             "weight:int>")
SPANS_TYPE = f"array<{SPAN_TYPE}>"

_CUT = "\x01"      # stands before and after an identifier
_LABEL = "\x02"    # stands before a label

_DIGIT_ORDS = {r.ord for r in DIGIT_RULES}
_NAME_ORDS = {r.ord for r in NAME_RULES}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it.

    Also needed where a lambda uses a computed column just once: the optimizer would move the
    column's expression into the lambda, and so compute it for every element. It is the last step of an
    ``aggregate`` over nothing: that of a ``transform`` would copy the whole result at each ``let``.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def _let(name: str, value: str, body: str) -> str:
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, _) -> {name}, {name} -> {body})"


# ``aggregate`` copies its whole state at every step, so a state that gathers an array makes long texts quadratic. Arrays
# are therefore built by ``transform``; what goes on from element to element (sums, maxima) is taken within groups of GROUP
# elements, and from group to group. The expressions are kept flat, as the analyzer takes a round for each level.
# A few elements are summed anew for each of them, which costs less than a state.
GROUP = 128
FEW = 32


def _running_sql(size: str, element: str, step: str) -> str:
    """The results of ``step`` (of ``a`` and ``b``) over the first elements, for each of ``size`` ints; ``element`` is
    the SQL of the one numbered ``j``."""
    own = (f"aggregate(sequence(cast(g * {GROUP} as int), cast(least(g * {GROUP} + {GROUP}, {size}) - 1 as int)), "
           f"cast(array() as array<int>), (own, j) -> concat(own, array(CASE WHEN size(own) = 0 THEN {element} ELSE "
           f"{step.format(a='element_at(own, -1)', b=element)} END)))")
    before = "element_at(element_at(whole, -1), -1)"
    return (f"flatten(aggregate(transform(sequence(0, ({size} - 1) div {GROUP}), g -> {own}), "
            f"cast(array() as array<array<int>>), (whole, g) -> concat(whole, array(CASE WHEN size(whole) = 0 THEN g ELSE "
            f"transform(g, b -> {step.format(a=before, b='b')}) END))))")


def _running(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    def whole(nums: Column) -> Column:
        last = F.size(nums) - 1
        groups = F.transform(F.sequence(F.lit(0), F.floor(last / GROUP).cast("int")), lambda g: F.aggregate(
            F.sequence(g * GROUP, F.least(g * GROUP + GROUP - 1, last)), F.array().cast("array<int>"),
            lambda own, j: F.concat(own, F.array(F.when(F.size(own) == 0, F.get(nums, j)).otherwise(
                step(F.element_at(own, -1), F.get(nums, j)))))))
        return F.flatten(F.aggregate(groups, F.array().cast("array<array<int>>"), lambda done, g: F.concat(done, F.array(
            F.when(F.size(done) == 0, g).otherwise(F.transform(g, lambda b: step(
                F.element_at(F.element_at(done, -1), -1), b)))))))

    def small(nums: Column) -> Column:
        return F.transform(nums, lambda x, i: F.aggregate(F.slice(nums, 1, i), x, lambda a, b: step(a, b)))

    return let(numbers, lambda nums: F.when(F.size(nums) > FEW, whole(nums)).when(nums.isNotNull(), small(nums)))


def running_sum(numbers: Column) -> Column:
    """The sums of the first elements of an int array, for each element."""
    return _running(numbers, lambda a, b: a + b)


# The detectors are put together as SQL text: a rule set is one expression of a thousand nodes,
# which the parser builds in one call.

_NONE = f"cast(array() as {SPANS_TYPE})"
_NON_NAME = "|".join(t.lower() for t in vocab.NON_NAME_TERMS)


def _text(value: str) -> str:
    """A raw SQL string literal."""
    if "'" in value:
        raise ValueError("patterns and words must not contain a quote")
    return f"r'{value}'"


def _any_of(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_text(w)})" for w in words) + ")"


def clean_sql(text: str) -> str:
    """The text with the two marker characters blanked; the length does not change."""
    return f"replace(replace({text}, '{_CUT}', ' '), '{_LABEL}', ' ')"


def _marked(rule: Rule) -> str:
    """The text with the rule's matches marked; null when a guard rules a match out.

    Refers to the lambda variables ``body`` and ``t`` (``t.low``, ``t.month``).
    """
    mark = f"{_LABEL}$1{_CUT}$2{_CUT}$3" if rule.labelled else f"{_CUT}$0{_CUT}"
    marked = f"regexp_replace(body, {_text(rule.pattern)}, {_text(mark)})"
    tests = []
    if rule.guard:
        tests.append("t.month" if rule.guard == MONTH_WORDS else _any_of("t.low", rule.guard))
    if rule.guard_regex:
        tests.append(f"body rlike {_text(rule.guard_regex)}")
    return f"if({' AND '.join(tests)}, {marked}, null)" if tests else marked


def _facts(rule: Rule) -> str:
    return (f"named_struct('type', '{rule.type}', 'score', {rule.score}D, 'ord', {rule.ord}, "
            f"'labels', {int(rule.labelled)}, 'label_counts', {str(rule.label_counts).lower()})")


# The spans of one marked text ``m`` of a rule ``r``, in text order: every other piece is one. Each match of a rule with
# labels has one label's mark, which is no part of the text.
def _piece_length(i: str) -> str:
    return f"({_length(f'get(ps, {i})')} - if(contains(get(ps, {i}), '{_LABEL}'), 1, 0))"


def _length(piece: str) -> str:
    """The characters of a long piece; counting them takes long, and a text of as many bytes as characters is common."""
    return f"if(t.ascii, octet_length({piece}), length({piece}))"


def _span(begin: str, i: str) -> str:
    label = f"if(r.label_counts, length(substring_index(get(ps, {i} - 1), '{_LABEL}', -1)), 0)"
    return _let("b", begin, (
        f"named_struct('begin', b, 'end', b + length(get(ps, {i})), 'type', r.type, 'original', get(ps, {i}), "
        f"'score', r.score, 'ord', r.ord, 'weight', length(get(ps, {i})) + {label})"))


# One match needs no sums. Of a few matches, each counts what stands before it; many need a running sum.
_BEFORE = f"{_length(f"substring_index(m, '{_CUT}', i)")} - i + 1 - r.labels * ((i + 1) div 2)"
_MATCHES = "sequence(1, size(ps) - 2, 2)"
_CUT_UP = _let("ps", f"split(m, '{_CUT}', -1)", (
    f"CASE WHEN size(ps) = 3 THEN array({_span(f"{_length('get(ps, 0)')} - r.labels", '1')}) WHEN size(ps) <= {FEW} THEN "
    f"transform({_MATCHES}, i -> {_span(f'cast({_BEFORE} as int)', 'i')}) ELSE "
    + _let("ends", _running_sql("size(ps)", _piece_length("j"), "{a} + {b}"),
           f"transform({_MATCHES}, i -> {_span('get(ends, i - 1)', 'i')})") + " END"))


def _find(rules: Sequence[Rule]) -> str:
    """The spans of several rules; only texts that a rule marked, which are longer then, are cut up."""
    marked, facts = ", ".join(_marked(r) for r in rules), ", ".join(_facts(r) for r in rules)
    spans = (f"flatten(transform(array({marked}), (m, k) -> if(octet_length(m) > octet_length(body), "
             + _let("r", f"get(array({facts}), k)", _CUT_UP) + f", {_NONE})))")
    near = [str(r.ord) for r in rules if r.check == "insurance_context"]
    if near:
        reach = vocab.INSURANCE_CONTEXT_CHARS
        left = f"greatest(s.begin - {reach}, 0)"
        context = f"lower(substring(body, {left} + 1, s.end + {reach} - {left}))"
        spans = (f"filter({spans}, s -> s.ord NOT IN ({', '.join(near)}) "
                 f"OR {_let('c', context, _any_of('c', vocab.INSURANCE_CONTEXT_WORDS))})")
    return spans


def runs_sql(spans: str) -> str:
    """``runs`` as SQL text."""
    return _let("ss", f"sort_array({spans})", f"CASE WHEN size(ss) = 0 THEN cast(array() as array<{SPANS_TYPE}>) ELSE " + _let(
        "ends", "sort_array(transform(ss, s -> greatest(s.end, s.begin + 1)))", _let(
            "starts", "filter(sequence(0, size(ss) - 1), i -> i = 0 OR get(ss, i).begin >= get(ends, i - 1))",
            "transform(starts, (i, k) -> transform(sequence(i, coalesce(get(starts, k + 1), size(ss)) - 1), j -> get(ss, j)))"))
        + " END")


def _keep_names(candidates: str) -> str:
    """Drop candidates that are medical terms, lie in a provider's name, or repeat an earlier one.

    Providers are only looked for in texts that have a candidate left.
    """
    terms_out = f"filter({candidates}, s -> NOT {non_name_sql('s.original')})"
    # Only spans of one run can lie in each other, so names and providers are compared by runs.
    inside = "k.begin <= s.begin AND k.end >= s.end"
    ordered = (f"transform(sort_array(transform(filter(run, s -> s.type = 'NAME' AND NOT exists(run, "
               f"k -> k.type = 'PROVIDER' AND {inside})), "
               "s -> named_struct('o', s.ord, 'b', s.begin, 's', s))), o -> o.s)")
    kept = (f"aggregate({ordered}, {_NONE}, (acc, s) -> CASE WHEN exists(acc, k -> {inside}) THEN acc "
            "ELSE flatten(array(acc, array(s))) END)")
    both = f"flatten(array(named, {_find(PROVIDER_RULES)}))"
    once = f"flatten(transform({runs_sql(both)}, run -> {kept}))"
    return _let("named", terms_out, f"CASE WHEN size(named) = 0 THEN named ELSE {once} END")


def non_name_sql(phrase: str) -> str:
    """True when a word of the phrase is a medical or calendar term, or the phrase is a label."""
    return (rf"(lower({phrase}) rlike r'\b(?:{_NON_NAME})\b' OR {phrase} IN "
            f"({', '.join(_text(w) for w in vocab.LABEL_WORDS)}))")


def _with_text(text: str, body: str) -> str:
    # What several rules ask of a text is computed once, where a rule asks for it: has it a digit, a
    # capitalised word, a month's name.
    facts = {"low": "low", "ascii": "octet_length(body) = length(body)", "digit": "body rlike '[0-9]'", "capital": f"body rlike {_text(CAPITAL)}",
             "month": _any_of("low", MONTH_WORDS)}
    asked = [n for n in facts if f"t.{n}" in body]
    if asked:
        struct = f"named_struct({', '.join(f'{_text(n)}, {facts[n]}' for n in asked)})"
        body = _let("t", _let("low", "lower(body)", struct) if {"low", "month"} & set(asked) else struct, body)
    return f"CASE WHEN {text} IS NOT NULL THEN " + _let("body", clean_sql(text), body) + " END"


@lru_cache(maxsize=None)
def detect_sql(text: str, rules: tuple[Rule, ...]) -> str:
    """All spans the rules find in a text expression, overlaps included; null for a null text."""
    names = [r for r in rules if r.ord in _NAME_ORDS]
    digits = [r for r in rules if r.ord in _DIGIT_ORDS]
    others = [r for r in rules if r.ord not in _NAME_ORDS and r.ord not in _DIGIT_ORDS]
    parts = []
    if names:       # every name rule needs a capitalised word
        parts.append(f"CASE WHEN t.capital THEN {_keep_names(_find(names))} ELSE {_NONE} END")
    if digits:
        parts.append(f"CASE WHEN t.digit THEN {_find(digits)} ELSE {_NONE} END")
    if others:
        parts.append(_find(others))
    return _with_text(text, parts[0] if len(parts) == 1 else f"flatten(array({', '.join(parts)}))")


def detect(text: str, rules: Sequence[Rule]) -> Column:
    return F.expr(detect_sql(text, tuple(rules)))


def raw_matches(text: str, rules: Sequence[Rule]) -> Column:
    """Matches of the rules before the name filters, for inspection and for the filters' queries."""
    return F.expr(_with_text(text, _find(rules)))


def provider_spans(text: str) -> Column:
    """Where care providers are named."""
    return raw_matches(text, PROVIDER_RULES)


# ---- overlap resolution -----------------------------------------------------------------------

def _rank(s: Column) -> Column:
    """Sort key: better score, longer match, longer identifier, earlier rule, earlier place."""
    return F.struct((-s["score"]).alias("a"), (-s["weight"]).alias("b"),
                    (s["begin"] - s["end"]).alias("c"), s["ord"].alias("d"),
                    s["begin"].alias("e"), s.alias("span"))


def _greedy(run: Column) -> Column:
    """Keep a span when it touches no better span already kept."""
    return F.aggregate(
        F.sort_array(F.transform(run, _rank)), no_spans(),
        lambda acc, r: F.when(
            F.exists(acc, lambda k: (r["span"]["begin"] < k["end"])
                     & (r["span"]["end"] > k["begin"])), acc)
        .otherwise(F.flatten(F.array(acc, F.array(r["span"])))))


def _ends(ss: Column) -> Column:
    """The ends of ordered spans, ordered themselves.

    All spans before the i-th (from 0) have ended where it begins if and only if i ends lie there or before, as its own
    and those after it lie further on. So one sort stands for the furthest end so far. An empty span counts as one character.
    """
    return F.sort_array(F.transform(ss, lambda s: F.greatest(s["end"], s["begin"] + 1)))


def runs(spans: Column) -> Column:
    """Group spans into runs that touch; spans of different runs never overlap.

    A span that starts where all before it have ended begins a run. Comparing within runs keeps the quadratic part of
    the work to the run, not to the text.
    """
    def cut(ss: Column) -> Column:
        starts = let(_ends(ss), lambda ends: F.filter(F.sequence(F.lit(0), F.size(ss) - 1), lambda i: (i == 0) | (
            F.get(ss, i)["begin"] >= F.get(ends, i - 1))))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.transform(
            F.sequence(i, F.coalesce(F.get(at, k + 1), F.size(ss)) - 1), lambda j: F.get(ss, j))))

    return let(F.sort_array(spans), lambda ss: F.when(F.size(ss) > 0, cut(ss)).when(
        ss.isNotNull(), F.array().cast(f"array<{SPANS_TYPE}>")))


def resolve(spans: Column) -> Column:
    """Greedy selection of non-overlapping spans, in text order. Spans that touch no other stay as they are."""
    def best(run: Column) -> Column:
        return F.when(F.size(run) <= FEW, _greedy(run)).otherwise(
            F.flatten(F.transform(runs(run), lambda r: F.when(F.size(r) == 1, r).otherwise(_greedy(r)))))

    def settled(ss: Column, ends: Column) -> Column:
        heads = F.transform(ss, lambda s, i: F.coalesce(s["begin"] >= F.get(ends, i - 1), F.lit(True)))

        def alone(h: Column, i: Column) -> Column:
            return F.get(h, i) & F.coalesce(F.get(h, i + 1), F.lit(True))

        return let(heads, lambda h: let(F.filter(ss, lambda s, i: ~alone(h, i)), lambda touching: F.when(
            F.size(touching) == 0, ss).otherwise(F.sort_array(F.flatten(F.array(
                F.filter(ss, lambda s, i: alone(h, i)), best(touching)))))))

    return let(spans, lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(
        let(F.sort_array(all_), lambda ss: let(_ends(ss), lambda ends: settled(ss, ends)))))


def overlapping(spans: Column) -> Column:
    """Pairs of overlapping spans, each pair once, in text order."""
    def pairs(run: Column) -> Column:
        return F.flatten(F.transform(
            run, lambda a, i: F.transform(
                F.filter(F.slice(run, i + 2, F.size(run)),
                         lambda b: (a["begin"] < b["end"]) & (a["end"] > b["begin"])),
                lambda b: F.struct(a.alias("left"), b.alias("right")))))

    return F.flatten(F.transform(runs(spans), pairs))
