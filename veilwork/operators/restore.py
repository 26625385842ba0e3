"""Taking replacements out again: by place, or by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pseudonyms as ps
from ..functions import spans as sp
from ..functions.spans import let, running_sum
from ..functions.splice import splice

_MARK = "\x01"
#: A replacement of a known shape is at most so long; a longer one counts as of another shape.
REACH = 200
# What a shape can begin with; tried first, as most places of a text have something else.
_FIRST = r"(?=[A-Z0-9uh\[])"
# A replacement is a whole word: no letter or digit goes on before or after one of its own.
_STARTS = r"(?:(?<![A-Za-z0-9])|(?=\[))"
_ENDS = r"(?:(?<=[^A-Za-z0-9])|(?![A-Za-z0-9]))"
_ANY = "|".join(f"(?:{s})" for s in ps.FAKE_SHAPES.values())
_UNIT = r"(?s)[A-Za-z0-9]+|[^A-Za-z0-9]"


def _ends(pieces: Column) -> Column:
    """Where each piece of a text ends."""
    return running_sum(F.transform(pieces, lambda p: F.length(p)))


# A place where any shape stands: those that can begin with its character are tried, each as a group in a lookahead, so that
# nothing is consumed; one of them must be found.
_BY_FIRST = [
    ("[0-9]", ["ADDRESS", "PHONE_NUMBER", "SSN", "CREDIT_DEBIT_NUMBER", "IP_ADDRESS", "VEHICLE_ID", "ZIP", "AGE"]),
    ("[A-Z]", ["NAME", "MRN", "INSURANCE_ID", "LICENSE_NUMBER", "VEHICLE_ID", "DEVICE_ID", "BIOMETRIC_ID", "CLINICAL_TRIAL_ID",
               "EMPLOYEE_ID", "DATE", "DOB"]),
    ("u", ["EMAIL"]), ("h", ["URL"]), (r"\[", ["OTHER"])]
_GROUPS = sum(len(names) for _, names in _BY_FIRST)
if {n for _, names in _BY_FIRST for n in names} != set(ps.FAKE_SHAPES):
    raise ValueError("every shape needs its first character")
_PLACE = (_FIRST + _STARTS + "(?:" + "|".join(
    f"(?={first}){''.join(f'(?=({ps.FAKE_SHAPES[n]}){_ENDS}|)' for n in names)}" for first, names in _BY_FIRST)
    + f")(?={'|'.join(rf'\{i + 1}' for i in range(_GROUPS))})")


def candidates(text: Column) -> Column:
    """``(begin, fake)`` of every piece of a text that has the shape of a keyed or masked replacement.

    One pass marks the places where any shape begins and writes out what each shape would take there. Pieces may overlap.
    """
    width = _GROUPS + 1     # parts from a place to the next: the groups and the text up to there
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), F.lit(_PLACE), F.lit(
        _MARK + "".join(f"${i + 1}{_MARK}" for i in range(_GROUPS))))

    def at_place(parts: Column, j: Column) -> Column:
        found = F.array_distinct(F.array_remove(F.slice(parts, j * width + 2, _GROUPS), ""))
        return F.filter(found, lambda x: F.length(x) <= REACH)

    def found(parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / width).cast("int") - 1)
        return let(running_sum(F.transform(places, lambda j: F.length(F.get(parts, j * width)))), lambda begins: F.flatten(
            F.transform(begins, lambda at, j: F.transform(at_place(parts, j), lambda x: F.struct(
                at.alias("begin"), x.alias("fake"))))))

    none = F.array().cast("array<struct<begin:int,fake:string>>")
    return let(F.split(marked, _MARK, -1), lambda parts: F.when(F.size(parts) > 1, found(parts)).otherwise(none))


#: Replacements of a shape of their own are told by their number of units and so many hash values, before they are looked up.
CODES = 1024


def _code(units: Column, fake: Column) -> Column:
    return (units * CODES + F.pmod(F.hash(fake), F.lit(CODES))).cast("int")


def runs_of_units(text: Column, codes: Column) -> Column:
    """``(begin, fake)`` of every run of units of a text that has one of the codes; a unit is a word or a single other character.

    A replacement is a whole word, so it is a run of units.
    """
    counts = F.array_distinct(F.transform(codes, lambda c: F.floor(c / CODES).cast("int")))
    units = F.regexp_extract_all(text, F.lit(_UNIT), 0)
    return let(codes, lambda known: let(counts, lambda ns: let(units, lambda us: let(_ends(us), lambda ends: F.filter(
        F.flatten(F.transform(us, lambda u, i: F.transform(F.filter(ns, lambda n: i + n <= F.size(us)), lambda n: let(
            F.array_join(F.slice(us, i + 1, n), ""), lambda run: F.when(F.array_contains(known, _code(n, run)), F.struct(
                (F.get(ends, i) - F.length(u)).alias("begin"), run.alias("fake"))))))),
        lambda found: found.isNotNull())))))


def by_fake(mappings: DataFrame) -> DataFrame:
    """One row per identity and replacement. Where it stands for several originals it is ambiguous and has none."""
    return mappings.groupBy("uuid", "fake").agg(
        F.min("original").alias("original"), (F.min("original") != F.max("original")).alias("ambiguous")
    ).withColumn("original", F.when(~F.col("ambiguous"), F.col("original")))


def _known_shape(fake: Column) -> Column:
    return fake.rlike(f"^(?:{_ANY})$") & (F.length(fake) <= REACH)


def codes_of(mappings: DataFrame) -> DataFrame:
    """``_codes`` of the identities that have stored replacements of shapes of their own: at most CODES for each number of
    units."""
    other = by_fake(mappings).filter(~_known_shape(F.col("fake")) & (F.col("fake") != ""))
    return other.groupBy("uuid").agg(F.collect_set(_code(F.regexp_count("fake", F.lit(_UNIT)), F.col("fake"))).alias("_codes"))


def _exploded(df: DataFrame, keys: Sequence[str], found: Column) -> DataFrame:
    rows = df.select(*keys, "uuid", F.explode_outer(found).alias("c")).filter(F.col("c").isNotNull())
    return rows.select(*keys, "uuid", "c.begin", "c.fake")


def found_pieces(values: DataFrame, mappings: DataFrame, keys: Sequence[str], column: str = "value",
                 whole: Column | None = None, shapes: bool = True, coded: DataFrame | None = None) -> DataFrame:
    """The stored replacements in each value of ``(keys, uuid, column)``, a row for each place.

    A join of (text, place, piece) with (uuid, replacement): what an identity has stored is never gathered, however much
    it is, and a text costs one pass, however many replacements it holds. Pieces of keyed and masked shapes are looked up
    as such. Replacements of any other shape (tables taken over from elsewhere) are looked up as runs of units, in the
    texts of identities that have any, where number of units and hash fit one of them. Those texts are joined with
    ``codes_of`` here, or by a caller (``coded``) that can do so before it takes rows apart into many values.
    With ``whole``, values for which it holds are looked up as they are, too.
    """
    none = F.array().cast("array<struct<begin:int,fake:string>>")
    itself = none if whole is None else F.when(
        whole, F.array(F.struct(F.lit(0).alias("begin"), F.col(column).alias("fake")))).otherwise(none)
    if shapes:
        if coded is None:
            coded = values.join(codes_of(mappings), "uuid")
        pieces = _exploded(values, keys, F.array_distinct(F.concat(F.coalesce(candidates(F.col(column)), none), itself))).unionByName(
            _exploded(coded, keys, runs_of_units(F.col(column), F.col("_codes"))))
    else:
        pieces = _exploded(values, keys, itself)
    return pieces.join(by_fake(mappings).drop("ambiguous"), ["uuid", "fake"])


def _places(found: Column) -> Column:
    """Found pieces of one text as places, ordered and disjoint: of overlapping ones the longest is taken.

    Each place has the replacement as ``type`` and what it stands for as ``original`` (null if that is ambiguous).
    """
    return sp.resolve(F.transform(found, lambda p: F.struct(
        p["begin"].alias("begin"), (p["begin"] + F.length(p["fake"])).alias("end"), p["fake"].alias("type"),
        p["original"].alias("original"), F.length(p["fake"]).cast("double").alias("score"), F.lit(0).alias("ord"),
        F.lit(0).alias("weight"))))


def _same(keys: Sequence[str]) -> Column:
    """The keys of a row, null or not, as one that can be grouped and joined by without another shuffle."""
    return F.struct(*keys).alias("_same")


def found_places(values: DataFrame, mappings: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """The stored replacements in each text, ordered and disjoint (``places``), by its ``_same`` (keys and uuid)."""
    # rows that are equal in their keys are equal texts, so their places are the same
    pieces = found_pieces(values, mappings, keys, column)
    gathered = pieces.select(_same([*keys, "uuid"]), F.struct("begin", "fake", "original").alias("p")).groupBy("_same").agg(
        F.collect_set("p").alias("places"))
    return gathered.withColumn("places", _places(F.col("places")))


def found_in_leaves(values: DataFrame, mappings: DataFrame, keys: Sequence[str], whole: Column | None = None,
                    shapes: bool = True, coded: DataFrame | None = None) -> DataFrame:
    """The same for rows of several values, each with its number ``leaf``: ``hits``, the places of each leaf that has any."""
    pieces = found_pieces(values, mappings, [*keys, "leaf"], whole=whole, shapes=shapes, coded=coded)
    gathered = pieces.select(_same([*keys, "uuid"]), F.struct("leaf", "begin", "fake", "original").alias("p")).groupBy("_same").agg(
        F.array_sort(F.collect_set("p")).alias("hits"))
    return gathered.withColumn("hits", F.transform(places_by_leaf(F.col("hits")), lambda h: F.struct(
        h["leaf"].alias("leaf"), _places(h["places"]).alias("places"))))


def places_by_leaf(places: Column) -> Column:
    """Places in order as one entry for each leaf: where each leaf's first and last place stand, then those between."""
    firsts = F.filter(F.transform(places, lambda s, i: F.when(
        F.coalesce(F.get(places, i - 1)["leaf"] != s["leaf"], F.lit(True)), i)), lambda i: i.isNotNull())
    return let(places, lambda all_: let(firsts, lambda at: F.transform(at, lambda i, k: F.struct(
        F.get(all_, i)["leaf"].alias("leaf"),
        F.transform(F.sequence(i, F.coalesce(F.get(at, k + 1), F.size(all_)) - 1), lambda j: F.get(all_, j)).alias("places")))))


def put_back(value: Column, places: Column) -> Column:
    """A value with its places replaced by what they stand for; ambiguous ones stay."""
    known = F.filter(places, lambda s: s["original"].isNotNull())
    return F.coalesce(let(known, lambda ks: splice(value, ks, value="original")), value)


def counted(places: Column, ambiguous: bool) -> Column:
    return F.coalesce(F.size(F.filter(places, lambda s: s["original"].isNull() if ambiguous else s["original"].isNotNull())),
                      F.lit(0))


def joined_back(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with what was found for its rows (``_same``), by keys that may be null."""
    right = found.withColumnRenamed("_same", "_found_same")
    return df.withColumn("_same", _same(keys)).join(right, F.col("_same") == F.col("_found_same"), "left").drop("_same", "_found_same")


def restore_by_value(df: DataFrame, mappings: DataFrame, text: str = "anonymized",
                     key: str = "doc_id") -> DataFrame:
    """Add ``restored``, ``entities_restored`` and ``ambiguous`` to ``(key, uuid, text)``.

    Replacements are found as whole words; what is put back is never looked at again. One that stands for several
    originals of the identity stays and is counted as ambiguous; the ledger has no such limit. Rows may share a key.
    """
    rows = df.withColumn("_hash", F.xxhash64(text))
    found = found_places(rows.select(key, "_hash", "uuid", F.col(text).alias("value")), mappings, [key, "_hash"])
    out = joined_back(rows, found, [key, "_hash", "uuid"])
    return out.withColumn("restored", put_back(F.col(text), F.col("places"))).withColumn(
        "entities_restored", counted(F.col("places"), False)).withColumn(
        "ambiguous", counted(F.col("places"), True)).drop("places", "_hash")


def ledger_places(ledger: DataFrame, key: str, *fields: str) -> DataFrame:
    """The places of each text, and whether two rows disagree on what stood at one of them.

    Texts are told apart by key and hash, so rows that share a key never get each other's originals. Where even the new
    texts are equal and the originals are not, nobody can tell them apart: ``unclear``.
    """
    span = F.struct(*fields, "original")
    rows = ledger.select(_same([key, "text_hash"]), span.alias("s")).groupBy("_same").agg(
        F.array_sort(F.collect_set("s")).alias("places"))
    spots = F.transform("places", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return rows.withColumn("unclear", F.size(F.array_distinct(spots)) < F.size("places"))


def restore_by_ledger(df: DataFrame, ledger: DataFrame, text: str = "anonymized",
                      key: str = "doc_id") -> DataFrame:
    """Restore exactly, by place; adds ``restored`` and ``unclear``. The ledger rows gathered per text are bounded by the text.

    A text that isn't the one that the ledger knows, or whose rows in it disagree (``unclear``), stays as it is.
    """
    rows = df.withColumn("text_hash", F.xxhash64(text))
    out = joined_back(rows, ledger_places(ledger, key, "out_begin", "out_end"), [key, "text_hash"])
    good = F.col("places").isNotNull() & ~F.col("unclear")
    return out.withColumn("restored", F.when(good, splice(
        F.col(text), F.col("places"), "out_begin", "out_end", "original")).otherwise(F.col(text))).withColumn(
        "unclear", F.coalesce("unclear", F.lit(False))).drop("places", "text_hash")
