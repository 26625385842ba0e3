"""Keyed pseudonyms: the same identity, type and value always give the same replacement.

A replacement is a function of a SHA-256 digest over a secret, the identity's uuid, the type and
the lower-cased value. No task has to ask another which value was handed out, so anonymising needs
no shuffle. Without the secret the values cannot be recomputed. Comparing lower-cased values gives
``JOHN`` and ``John`` one replacement.

The expressions are SQL text, so that they can stand inside a lambda over spans; ``h`` is always
the digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .masks import mask_date_sql, mask_dob_sql, mask_zip_sql

_HEX = "0123456789abcdef"
_CONSONANTS = "bcdfghjklmnprstv"
_VOWELS = "aeiouaeiouaeioua"
_CAPITALS = "ABCDEFGHJKLMNPRS"

KEYED, MASKED, REDACTED = "keyed", "safe_harbor", "redacted"
MASKED_TYPES = ["DATE", "DOB", "ZIP", "AGE"]



def _one_of(words: list[str]) -> str:
    """Pattern of any of the words, told apart by their first letter first."""
    rests: dict[str, list[str]] = {}
    for w in words:
        rests.setdefault(w[0], []).append(w[1:])
    return f"(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in rests.items())})"


# The shapes of the keyed replacements below, for finding them again in anonymised text.
FAKE_SHAPES = {
    "NAME": rf"{_one_of(vocab.FIRST_NAMES)} [A-Z][a-z]{{7}}",
    "ADDRESS": (rf"[1-9][0-9]{{3}} (?:{'|'.join(vocab.STREETS)}), (?:{'|'.join(vocab.CITIES)}), "
                r"[A-Z]{2} (?:00000|[0-9]{3}\*\*)"),
    "PHONE_NUMBER": r"555-[0-9]{3}-[0-9]{4}",
    "EMAIL": r"user[0-9a-f]{12}@example\.com",
    "SSN": r"9[0-9]{2}-[0-9]{2}-[0-9]{4}",
    "CREDIT_DEBIT_NUMBER": r"[0-9]{16}",
    "URL": r"https://example\.org/[0-9a-f]{10}",
    "IP_ADDRESS": r"10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "MRN": r"MRN-[0-9]{8}",
    "INSURANCE_ID": r"(?:POL|MEM|GRP)[0-9]{9}",
    "LICENSE_NUMBER": r"[A-Z]{3}-[0-9]{4}",
    "VEHICLE_ID": r"[0-9A-F]{17}",
    "DEVICE_ID": r"SN-[0-9]{10}",
    "BIOMETRIC_ID": r"BIO-[0-9]{12}",
    "CLINICAL_TRIAL_ID": r"NCT[0-9]{8}",
    "EMPLOYEE_ID": r"EMP[0-9]{6}",
    "DATE": r"XX/XX/(?:[0-9]{4}|XXXX)",
    "DOB": r"XX/XX/[0-9]{2,4}",
    "ZIP": r"(?:00000|[0-9]{3}\*\*)",
    "AGE": r"90 or above",
    "OTHER": r"\[REDACTED-[A-Z_]+\]",
}


def secret_sql(secret: str) -> str:
    """The secret as a SQL literal."""
    return "'" + secret.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sized(part: str) -> str:
    return f"concat(cast(length({part}) as string), ':', {part}, '|')"


def identity_uuid_sql(secret: str, identity: str, identity_type: str) -> str:
    """A uuid that depends only on the identity, so that it needs no lookup; null if a part of the identity is.

    The parts are hashed with their lengths, so that no two identities read the same.
    """
    return (f"regexp_replace(sha2(concat({secret}, '|identity|', {_sized(identity_type)}, {identity}), 256), "
            "'^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '$1-$2-$3-$4-$5')")


def identity_uuid(secret: str, identity: str = "identity",
                  identity_type: str = "identity_type") -> Column:
    return F.expr(identity_uuid_sql(secret_sql(secret), identity, identity_type))


def digest_sql(secret: str, uuid: str, type_: str, original: str) -> str:
    return f"sha2(concat({secret}, '|', {_sized(uuid)}, {_sized(type_)}, lower({original})), 256)"


def _number(at: int, modulus: int, h: str = "h") -> str:
    return f"(cast(conv(substring({h}, {at}, 14), 16, 10) as bigint) % {modulus})"


def _digits(at: int, n: int) -> str:
    return f"lpad(cast({_number(at, 10 ** n)} as string), {n}, '0')"


def _pick(at: int, values: list[str]) -> str:
    array = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({array}), cast({_number(at, len(values))} + 1 as int))"


def _concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


FIRST_NAME_SQL = _pick(1, vocab.FIRST_NAMES)
# Eight letters, consonants and vowels in turn.
_LETTERS = [f"translate(substring(h, {at + i}, 1), '{_HEX}', '{table}')"
            for i in range(4) for at, table in ((20, _CONSONANTS), (30, _VOWELS))]
LAST_NAME_SQL = _concat(f"upper({_LETTERS[0]})", *_LETTERS[1:])


def _address(v: str) -> str:
    """Another street and city; the state stays and the ZIP code follows the three-digit rule."""
    tail = r"([A-Z]{2})\s+([0-9]{5})(?:-[0-9]{4})?$"
    state, zip_ = (f"regexp_extract({v}, r'{tail}', {g})" for g in (1, 2))
    return _concat(
        f"cast({_number(1, 9000)} + 1000 as string)", "' '", _pick(15, vocab.STREETS), "', '",
        _pick(29, vocab.CITIES), "', '", f"coalesce(nullif({state}, ''), 'XX')", "' '",
        f"CASE WHEN {zip_} <> '' THEN {mask_zip_sql(zip_)} ELSE '00000' END")


def fake_from_digest_sql(type_: str, v: str) -> str:
    """The replacement for value ``v`` of a type, given the digest ``h``."""
    by_type = {
        "NAME": _concat(FIRST_NAME_SQL, "' '", LAST_NAME_SQL),
        "ADDRESS": _address(v),
        "PHONE_NUMBER": _concat("'555-'", _digits(1, 3), "'-'", _digits(15, 4)),
        "EMAIL": _concat("'user'", "substring(h, 1, 12)", "'@example.com'"),
        # Numbers that start with 9 are never issued.
        "SSN": _concat("'9'", _digits(1, 2), "'-'", _digits(15, 2), "'-'", _digits(29, 4)),
        "DATE": mask_date_sql(v),
        "CREDIT_DEBIT_NUMBER": _concat(_digits(1, 8), _digits(15, 8)),
        "ZIP": mask_zip_sql(v),
        "URL": _concat("'https://example.org/'", "substring(h, 1, 10)"),
        "IP_ADDRESS": "concat_ws('.', '10', " + ", ".join(
            f"cast({_number(at, 256)} as string)" for at in (1, 15, 29)) + ")",
        "MRN": _concat("'MRN-'", _digits(1, 8)),
        "INSURANCE_ID": _concat(_pick(1, ["POL", "MEM", "GRP"]), _digits(15, 9)),
        "LICENSE_NUMBER": _concat(f"translate(substring(h, 1, 3), '{_HEX}', '{_CAPITALS}')", "'-'",
                                  _digits(15, 4)),
        "VEHICLE_ID": "upper(substring(h, 1, 17))",
        "DEVICE_ID": _concat("'SN-'", _digits(1, 10)),
        "BIOMETRIC_ID": _concat("'BIO-'", _digits(1, 12)),
        "CLINICAL_TRIAL_ID": _concat("'NCT'", _digits(1, 8)),
        "EMPLOYEE_ID": _concat("'EMP'", _digits(1, 6)),
        "DOB": mask_dob_sql(v),
        "AGE": f"'{vocab.AGE_GROUP}'",
    }
    return _of_type(type_, sorted(by_type.items()), f"concat('[REDACTED-', {type_}, ']')")


def _of_type(type_: str, cases: list[tuple[str, str]], otherwise: str) -> str:
    """The case of a type, found by halves: a CASE of so many branches would compare with each of those before."""
    if len(cases) == 1:
        return f"if({type_} = '{cases[0][0]}', {cases[0][1]}, {otherwise})"
    half = len(cases) // 2
    return (f"if({type_} < '{cases[half][0]}', {_of_type(type_, cases[:half], otherwise)}, "
            f"{_of_type(type_, cases[half:], otherwise)})")


def fake_sql(secret: str, uuid: str, type_: str, original: str) -> str:
    """The replacement for a value; all arguments are SQL text. The digest is computed once."""
    return (f"aggregate(cast(array() as array<int>), {digest_sql(secret, uuid, type_, original)}, (h, _) -> h, "
            f"h -> {fake_from_digest_sql(type_, original)})")


def fake(secret: str, uuid: str = "uuid", type_: str = "pii_type",
         original: str = "original") -> Column:
    """The replacement for a column of values; ``secret`` is the secret itself."""
    return F.expr(fake_sql(secret_sql(secret), uuid, type_, original))


def fake_kind(type_: Column) -> Column:
    """How the replacement was made: keyed, Safe-Harbor mask, or plain redaction."""
    known = [t for t in FAKE_SHAPES if t != "OTHER"]
    return F.when(type_.isin(MASKED_TYPES), F.lit(MASKED)).when(
        type_.isin(known), F.lit(KEYED)).otherwise(F.lit(REDACTED))
