"""Putting replacements into a text, and taking them out again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

#: Spans are taken in groups of so many, each with its own part of the text.
GROUP = 128


def _pieces(text: Column, spans: Column, from_: Column, begin: str, end: str, value: str) -> Column:
    """The new text of a part that starts at the place ``from_`` of the whole text."""
    def after(i: Column) -> Column:
        return F.coalesce(F.get(spans, i)[end].cast("int") - from_, F.lit(0))

    new = F.transform(spans, lambda s, i: let(after(i - 1), lambda at: F.concat(
        F.substring(text, at + 1, s[begin].cast("int") - from_ - at), s[value])))
    return F.concat(F.array_join(new, ""), F.substring(text, after(F.size(spans) - 1) + 1, F.length(text)))


def splice(text: Column, spans: Column, begin: str = "begin", end: str = "end",
           value: str = "fake") -> Column:
    """Replace each ``[begin, end)`` of ordered, disjoint spans by a field of the span.

    ``substring`` walks to its place from the text's start, so many spans are taken in groups, each on its own part of the
    text.
    """
    def group(all_: Column, n: Column) -> Column:
        first, last = n * GROUP, F.least((n + 1) * GROUP, F.size(all_)) - 1
        own = F.transform(F.sequence(first, last), lambda j: F.get(all_, j))
        left = F.when(n == 0, 0).otherwise(F.get(all_, first)[begin]).cast("int")
        right = F.coalesce(F.get(all_, last + 1)[begin], F.length(text)).cast("int")
        return let(left, lambda at: let(F.substring(text, at + 1, right - at),
                                        lambda part: let(
                                            own, lambda mine: _pieces(part, mine, at, begin, end, value))))

    many = let(spans, lambda all_: F.array_join(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda n: group(all_, n)), ""))
    return F.when(F.size(spans) > GROUP, many).when(
        F.size(spans) > 0, _pieces(text, spans, F.lit(0), begin, end, value)).otherwise(text)


def whole_word(value: Column) -> Column:
    """Pattern of a value that isn't part of a longer word or number."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.when(value.rlike("^[A-Za-z0-9]"), "(?<![A-Za-z0-9])").otherwise(""), quoted,
                    F.when(value.rlike("[A-Za-z0-9]$"), "(?![A-Za-z0-9])").otherwise(""))


def by_place(hits: Column, place: str) -> Column:
    """The hits (ordered by a whole-number field, one for each) as an array with each at its own place; null in between."""
    return let(hits, lambda hs: F.flatten(F.transform(hs, lambda h, k: F.concat(
        F.array_repeat(F.when(F.lit(False), h), (h[place] - F.coalesce(
            F.get(hs, k - 1)[place], F.lit(-1)) - 1).cast("int")), F.array(h)))))
