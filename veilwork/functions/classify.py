"""Key and term rules: which fields and phrases hold identifiers, and of which type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _any_word(value: Column, words: Sequence[str]) -> Column:
    """A word occurs as a substring; the words hold no special characters but '.' and '-'."""
    return value.rlike("|".join(w.replace(".", r"\.") for w in words))


def is_provider_key(key: Column) -> Column:
    return _any_word(F.lower(key), vocab.PROVIDER_KEY_WORDS)


def is_identifier_key(key: Column) -> Column:
    """A field name that may hold an identifier; provider fields never do."""
    return ~is_provider_key(key) & _any_word(F.lower(key), vocab.IDENTIFIER_KEY_WORDS)


def _typed(low: Column, first: Column, table: list[tuple[str, list[str]]]) -> Column:
    out = F.when(first, F.lit("NAME")).when(low.rlike(vocab.IP_KEY_PATTERN), F.lit("IP_ADDRESS"))
    for type_, words in table:
        out = out.when(_any_word(low, words), F.lit(type_))
    return out


def key_type(key: Column) -> Column:
    """Identifier type of a field name, or OTHER."""
    low = F.lower(key)
    name = low.contains("name") & ~_any_word(low, ["provider", "doctor", "physician"])
    return _typed(low, name, vocab.KEY_TYPES).otherwise(F.lit("OTHER"))


def field_type(key: Column, value: Column) -> Column:
    """Identifier type of a field name and its value; falls back to the name alone."""
    low = F.lower(key)
    name = low.contains("name") & ~_any_word(low, ["provider", "doctor"])
    trial = low.contains("trial") & _any_word(F.lower(F.coalesce(value, F.lit(""))),
                                              vocab.TRIAL_VALUE_WORDS)
    return _typed(low, name, vocab.FIELD_TYPES).when(trial, F.lit("CLINICAL_TRIAL_ID")).otherwise(
        key_type(key))


def is_medical(text: Column) -> Column:
    """A medical keyword occurs anywhere in the text."""
    return _any_word(F.lower(text), vocab.MEDICAL_KEYWORDS)


def is_provider(text: Column) -> Column:
    """A provider title occurs anywhere in the text."""
    return _any_word(text, vocab.PROVIDER_TITLES)


def should_preserve(text: Column, keep_medical: bool = True, keep_providers: bool = True) -> Column:
    out = F.lit(False)
    if keep_medical:
        out = out | is_medical(text)
    if keep_providers:
        out = out | is_provider(text)
    return out


def long_enough(type_: Column, value: Column) -> Column:
    """Names and record numbers below a minimum length do not count."""
    return (F.when(type_ == "NAME", F.length(value) >= vocab.MIN_NAME_LENGTH)
            .when(type_ == "MRN", F.length(value) >= vocab.MIN_MRN_LENGTH).otherwise(True))
