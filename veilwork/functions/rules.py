"""Detector rules as data.

A rule is one regular expression for one identifier type. Adding a detector means adding a row
here (or passing extra rows to the detect operators); no code changes.

Two shapes of pattern:

* whole match: the match is the identifier;
* labelled: three groups ``(label)(value)(tail)``; only the value is the identifier, the label
  stays in the text. ``label_counts`` says that the label still counts towards the length that
  decides between overlapping candidates.

The patterns use Java syntax. Key words may be folded with ``(?i:...)``. Identifiers after a key word
may be in any case and must hold a digit, so that ordinary words survive; names after one may be capitals.
``guard`` lists lower-case substrings one of which must occur in the lower-cased text for the
pattern to match. It is implied by the pattern: it saves work and never changes results.
"""

from __future__ import annotations

from dataclasses import dataclass

from .vocab import CREDENTIALS, INSURANCE_CONTEXT_WORDS, PROVIDER_TITLES


@dataclass(frozen=True)
class Rule:
    """One row of the rule table."""

    type: str
    ord: int
    pattern: str
    score: float
    labelled: bool = False
    label_counts: bool = False
    guard: tuple[str, ...] = ()       # one of these must occur in the lower-cased text
    guard_regex: str | None = None    # this expression must match
    check: str | None = None          # name of an extra per-span test


# --- fixed values: detector patterns -------------------------------------------------------------
S = r"\s\x0B\x1C-\x1F\x85\p{Z}"            # white space in the Unicode sense, for use in a class
WS = rf"[{S}]"
NOT_WS = rf"[^{S}]"
GAP = r"[ \t]+"                          # white space inside one name
# Letters of any script. A quote is written by its number, as patterns stand in SQL literals.
UP, LOW, QUOTE = r"\p{Lu}", r"[\p{Ll}\p{M}]+", r"[\x27\x{2019}]"
PART = rf"{UP}(?:{QUOTE}{UP})?{LOW}"
CAP = rf"{PART}(?:(?:{QUOTE}|-)?{PART})*+"   # a capitalised word: Ann, Mary-Ann, O'Neil, McCoy, García
STARTS = r"(?=\p{Lu})(?<![\p{L}\p{M}\p{N}_])"   # the letter first, as most places have none
NO_LETTER = r"(?![\p{L}\p{M}\p{N}_])"    # a name isn't cut
# Possessive, so that a long run of capitalised words is matched without recursion.
FULL = rf"{CAP}(?:{GAP}{CAP})*+"
ANY_ID = r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*"  # an identifier body with at least one digit
NAMED = rf"(?:{CAP}|{UP}(?:(?:{QUOTE}|-)?{UP})++{NO_LETTER})"   # a capitalised word, or one wholly in capitals
FULL_NAMED = rf"{NAMED}(?:{GAP}{NAMED})*+"
MON = r"(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December")
MRN_LABELS = ("MRN", "mrn", "Medical Record Number")
PATIENT_LABELS = ("Patient ID", "patient id")
BIOMETRICS = ("Fingerprint", "Retinal", "Voiceprint", "Facial Recognition")
HONORIFIC = r"(?:r\.?|rs\.?|s\.?|iss)"   # Mr, Mrs, Ms, Miss after the M
JOINED = rf"(?:{QUOTE}|-){UP}[\p{{L}}\p{{M}}]*+"
ANY_CAP = rf"{UP}(?:[\p{{L}}\p{{M}}]++(?:{JOINED})*+|(?:{JOINED})++)"

CAPITAL = rf"{UP}(?:[\p{{L}}\p{{M}}]|{QUOTE}|-)"   # every name has one

BOUND = r"\b"
D = r"[0-9](?<=\b[0-9])"                 # first digit of a word; quicker to reject than \b[0-9]
MONTH_WORDS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
RELATIVES = ("mother", "father", "sister", "brother", "spouse", "wife", "husband", "son",
             "daughter", "parent")
HONORIFICS = ("mr", "ms", "miss")


def _word(first: str, words: str, after: str, boundary: str = "") -> str:
    """One of the words, followed by ``after``, which is not consumed.

    Only places with a fitting first letter are looked at closely.
    """
    return rf"[{first}](?<=(?={boundary}(?:{words}){after}).)[A-Za-z]*"


def _start(words: str | tuple[str, ...], fold: bool = True) -> str:
    """One of the words at a word boundary, found by its first letter. Nothing beyond is consumed.

    The same as ``\\b(?i:word|...)``, but the letter is tried first.
    """
    words = (words,) if isinstance(words, str) else words
    first = [w[0].upper() + w[0].lower() if fold else w[0] for w in words]
    firsts = "".join(sorted(set("".join(first))))
    flag = "?i:" if fold else "?:"
    rests = "|".join(rf"(?<=[{f}]){w[1:]}" for f, w in zip(first, words))
    return rf"[{firsts}](?<=\b.)({flag}{rests})"


NAME_RULES = [
    Rule("NAME", 101, rf"(Name:{WS}*)({ANY_CAP}(?:{GAP}{ANY_CAP})*+)()", 0.95, True,
         guard=("name:",)),
    Rule("NAME", 102, rf"(Patient:{WS}*)({ANY_CAP}(?:{GAP}{ANY_CAP})*+)()", 0.95, True,
         guard=("patient:",)),
    Rule("NAME", 103, rf"M(?<=\bM){HONORIFIC}{GAP}{CAP}(?:{GAP}{CAP})?{NO_LETTER}", 0.95,
         guard=HONORIFICS),
    Rule("NAME", 104,
         rf"({_word('MmFfSsBbWwHhDdPp', '(?i:' + '|'.join(RELATIVES) + ')', WS, BOUND)}{WS}+)"
         rf"({FULL_NAMED})()", 0.95, True, guard=RELATIVES),
    Rule("NAME", 105,
         rf"{STARTS}{CAP}{GAP}{CAP}(?={WS}*(?:DOB|Phone|Address|,|\n|\z|works|lives|employed|called"
         r"|contacted|visited))", 0.95),
    Rule("NAME", 106, rf"({_word('HhDd', '(?i:Hello|Hi|Dear|Hey)', WS)}{WS}+)({NAMED})()", 0.95, True,
         guard=("hello", "hi", "dear", "hey")),
    Rule("NAME", 107, rf"(M{HONORIFIC}{WS}+)({CAP})({WS}|,|\.)", 0.95, True, guard=HONORIFICS),
    Rule("NAME", 108, rf"({_word('CcNn', '(?i:called|named|contacted)', WS)}{WS}+)({FULL_NAMED})()", 0.95,
         True, guard=("called", "named", "contacted")),
    Rule("NAME", 109,
         rf"(\.{WS}+)({CAP})({WS}*[:,]|{WS}+(?:how|are|is|was|has|had|will|would|can|could"
         r"|should))", 0.95, True, guard=(".",)),
    Rule("NAME", 110,
         rf"(\A)({CAP})({WS}*[:,]|{WS}+(?:how|are|is|was|has|had|will|would|can|could|should))",
         0.95, True),
    Rule("NAME", 111, rf"(\A)({CAP}{GAP}{CAP}(?:{GAP}{CAP})?)(\n?\z)", 0.95, True),
]

# These all need a digit somewhere in the text.
DIGIT_RULES = [
    Rule("PHONE_NUMBER", 301,
         rf"[+0-9](?:(?<=\+)1[-.{S}]?[0-9]{{3}}|(?<=\b[0-9])(?:(?<=1)[-.{S}]?[0-9]{{3}}|[0-9]{{2}}))[-.{S}]?[0-9]{{3}}"
         rf"[-.{S}]?[0-9]{{4}}\b", 0.95),
    Rule("PHONE_NUMBER", 302,
         rf"(?=[+1(])(?:\+1[-.{S}]?|1(?<=\b1)[-.{S}]?)?\([0-9]{{3}}\)(?:{WS}*|[-.])[0-9]{{3}}[-.{S}]?[0-9]{{4}}\b",
         0.95, guard=("(",)),
    Rule("SSN", 401, rf"{D}[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}\b", 0.98, guard=("-",)),
    Rule("DATE", 501, rf"{D}[0-9]?[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}\b", 0.9, guard=("/", "-")),
    Rule("DATE", 502, rf"{D}[0-9]{{1,3}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}\b", 0.9, guard=("/", "-")),
    Rule("DATE", 503, rf"{D}[0-9]?{WS}+{MON}(?i:[a-z]*){WS}+[0-9]{{2,4}}\b", 0.9,
         guard=MONTH_WORDS),
    Rule("DATE", 504,
         rf"{_start(MONTH_WORDS)}(?i:[a-z]*){WS}+[0-9]{{1,2}}(?:st|nd|rd|th)?,?{WS}+[0-9]{{2,4}}\b", 0.9,
         guard=MONTH_WORDS),
    Rule("DATE", 505, rf"{D}[0-9]?/{MON}/[0-9]{{4}}\b", 0.9, guard=MONTH_WORDS),
    Rule("DATE", 506, rf"{_start(MONTHS, fold=False)}{GAP}[0-9]{{1,2}}(?:st|nd|rd|th)?\b", 0.9,
         guard=MONTH_WORDS),
    Rule("CREDIT_DEBIT_NUMBER", 601,
         rf"{D}[0-9]{{3}}[{S}-]?[0-9]{{4}}[{S}-]?[0-9]{{4}}[{S}-]?[0-9]{{4}}\b", 0.95),
    Rule("ZIP", 701, rf"{D}[0-9]{{4}}(?:-[0-9]{{4}})?\b", 0.85),
    Rule("ADDRESS", 801,
         rf"{D}[0-9]*{WS}+[A-Za-z{S}]+(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd"
         rf"|Boulevard|Way|Court|Ct|Plaza|Place|Pl)\.?{WS}*,?{WS}*[A-Za-z{S}]+,?{WS}*[A-Z]{{2}}{WS}+"
         r"[0-9]{5}(?:-[0-9]{4})?", 0.9, guard_regex=rf"[A-Z]{{2}}{WS}+[0-9]{{5}}"),
    Rule("MRN", 901, rf"({_start(MRN_LABELS, fold=False)}[{S}:#-]*)({ANY_ID})(\b)", 0.95, True, True,
         guard=("mrn", "medical record number")),
    Rule("MRN", 902, rf"({_start(PATIENT_LABELS, fold=False)}[{S}:#-]*)({ANY_ID})(\b)", 0.95, True, True,
         guard=("patient id",)),
    Rule("MRN", 903, r"[A-Z](?<=\b.)[A-Z]{1,3}-[0-9]{6,10}\b", 0.95, guard=("-",)),
    Rule("INSURANCE_ID", 1001, rf"({_start("Insurance ID")}:{WS}*)([A-Za-z0-9]*[0-9][A-Za-z0-9]*)()", 0.95, True,
         guard=("insurance id:",)),
    Rule("INSURANCE_ID", 1002, rf"({_start(("Member ID", "Policy Number"))}[{S}:#-]*)({ANY_ID})(\b)", 0.95, True,
         guard=("member id", "policy number")),
    Rule("INSURANCE_ID", 1003, r"\b[A-Za-z]{1,3}[0-9]{6,12}\b", 0.85, check="insurance_context",
         guard=tuple(INSURANCE_CONTEXT_WORDS)),
    Rule("LICENSE_NUMBER", 1101, rf"({_start(("License", "Certificate"))}[{S}#:]*)({ANY_ID})(\b)", 0.9, True, True,
         guard=("license", "certificate")),
    Rule("VEHICLE_ID", 1201, rf"({_start(("License Plate", "Plate"))}[{S}:#]*)({ANY_ID})(\b)", 0.95, True, True,
         guard=("plate",)),
    Rule("VEHICLE_ID", 1202, rf"({_start("VIN")}[{S}:#]*)([A-Za-z0-9]{{17}})(\b)", 0.95, True, True,
         guard=("vin",)),
    Rule("DEVICE_ID", 1301, rf"({_start(("Serial Number", "Serial", "SN"))}[{S}:#]*)({ANY_ID})(\b)", 0.95, True, True,
         guard=("serial", "sn")),
    Rule("DEVICE_ID", 1302, rf"({_start(("Device ID", "Device"))}[{S}:#]*)({ANY_ID})(\b)", 0.95, True, True,
         guard=("device",)),
    Rule("DEVICE_ID", 1303,
         rf"({_start(("Pacemaker", "Pump", "Implant"))}{WS}+(?i:ID|Serial)[{S}:#]*)({ANY_ID})(\b)", 0.95, True, True,
         guard=("pacemaker", "pump", "implant")),
    Rule("IP_ADDRESS", 1501, rf"{D}[0-9]{{0,2}}\.(?:[0-9]{{1,3}}\.){{2}}[0-9]{{1,3}}\b", 0.95,
         guard=(".",)),
    Rule("BIOMETRIC_ID", 1601,
         rf"({_start(BIOMETRICS)}[{S}:]*(?i:ID)?[{S}:#]*)"
         rf"({ANY_ID})(\b)", 0.95, True, True,
         guard=tuple(b.lower() for b in BIOMETRICS)),
    Rule("CLINICAL_TRIAL_ID", 1701, r"N(?<=\bN)CT[0-9]{8}\b", 0.95, guard=("nct",)),
    Rule("EMPLOYEE_ID", 1801, rf"({_start(("Employee ID", "EID"))}[{S}:#]*)({ANY_ID})(\b)", 0.9, True, True,
         guard=("employee id", "eid")),
    Rule("AGE", 1901, r"(?=[19])()([19](?<=\b.)(?:(?<=9)[0-9]|(?<=1)[0-9]{2}))([- ]?(?i:years?|yrs?|yo|y/o)(?i:[- ]old)?\b)",
         0.9, True, guard=("year", "yr", "yo", "y/o")),
    Rule("AGE", 1902, rf"({_start(("age", "aged"))}[: \t]*)(9[0-9]|1[0-9]{{2}})(\b)", 0.9, True,
         guard=("age",)),
]

OTHER_RULES = [
    # A possessive local part keeps long dotted runs linear; '@' is not in the class, so the
    # matches are the same.
    Rule("EMAIL", 201, r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.99, guard=("@",)),
    Rule("URL", 1401, rf"https?://{NOT_WS}+", 0.99, guard=("://",)),
]

# Care providers, whose names stay: title + names, or names + credential.
_AFTER_TITLE = r"[.:]?[ \t]"
_TITLE = "|".join(t.replace(".", r"\.?") for t in PROVIDER_TITLES)
_CREDENTIAL = rf",[ \t]*(?:{'|'.join(CREDENTIALS)})\b"
PROVIDER_RULES = [
    Rule("PROVIDER", 1,
         rf"{_word('CDMNOPRST', _TITLE, _AFTER_TITLE, BOUND)}\.?[.:]?{GAP}{FULL}", 1.0),
    Rule("PROVIDER", 2, rf"{STARTS}{FULL}{_CREDENTIAL}", 1.0, guard=(",",), guard_regex=_CREDENTIAL),
]
# ---------------------------------------------------------------------------------------------------

ALL_RULES = sorted(NAME_RULES + DIGIT_RULES + OTHER_RULES, key=lambda r: r.ord)


def rules_for(*types: str) -> list[Rule]:
    """The rules of the given identifier types, in order."""
    return [r for r in ALL_RULES if r.type in types]
