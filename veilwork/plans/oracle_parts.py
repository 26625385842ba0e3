"""SQL building blocks for the check queries: the same results by another road.

Where the operators work within a row on arrays, these unnest everything into rows and use window
functions, self-joins and aggregates. Patterns are in RE2 syntax, which has no look-around.
"""

from __future__ import annotations

from ..functions import vocab
from . import derive as d

# --- fixed values: detector patterns in RE2 syntax ------------------------------------------------
# (type, ord, score, labelled, label counts, pattern)
_S = r"\s\x0B\x1C-\x1F\x85\p{Z}"
_W = rf"[{_S}]"
_G = r"[ \t]+"
_U, _L, _Q = r"\p{Lu}", r"[\p{Ll}\p{M}]+", r"[\x27\x{2019}]"
_H1 = rf"{_U}(?:{_Q}{_U})?{_L}"
_C = rf"{_H1}(?:(?:{_Q}|-)?{_H1})*"
_F = rf"{_C}(?:{_G}{_C})*"
_T = rf"(?:{_Q}|-){_U}[\p{{L}}\p{{M}}]*"
_A = rf"{_U}(?:[\p{{L}}\p{{M}}]+(?:{_T})*|(?:{_T})+)"
_J = r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*"
_N = rf"(?:{_C}|{_U}(?:(?:{_Q}|-)?{_U})+)"
_M = rf"{_N}(?:{_G}{_N})*"
_MON = r"(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_MONTH = ("(?:January|February|March|April|May|June|July|August|September|October|November"
          "|December)")
_H = r"(?:Mr\.?|Mrs\.?|Ms\.?|Miss)"
_VERB = "(?:how|are|is|was|has|had|will|would|can|could|should)"
RULES = [
    ("NAME", 101, 0.95, 1, 0, rf"(Name:{_W}*)({_A}(?:{_G}{_A})*)()"),
    ("NAME", 102, 0.95, 1, 0, rf"(Patient:{_W}*)({_A}(?:{_G}{_A})*)()"),
    ("NAME", 103, 0.95, 0, 0, rf"\b{_H}{_G}{_C}(?:{_G}{_C})?"),
    ("NAME", 104, 0.95, 1, 0, r"(\b(?i:mother|father|sister|brother|spouse|wife|husband|son"
                              rf"|daughter|parent){_W}+)({_M})()"),
    ("NAME", 105, 0.95, 1, 0, rf"(\b)({_C}{_G}{_C})({_W}*(?:DOB|Phone|Address|,|\n|\z|works|lives"
                              "|employed|called|contacted|visited))"),
    ("NAME", 106, 0.95, 1, 0, rf"((?i:Hello|Hi|Dear|Hey){_W}+)({_N})()"),
    ("NAME", 107, 0.95, 1, 0, rf"({_H}{_W}+)({_C})({_W}|,|\.)"),
    ("NAME", 108, 0.95, 1, 0, rf"((?i:called|named|contacted){_W}+)({_M})()"),
    ("NAME", 109, 0.95, 1, 0, rf"(\.{_W}+)({_C})({_W}*[:,]|{_W}+{_VERB})"),
    ("NAME", 110, 0.95, 1, 0, rf"(\A)({_C})({_W}*[:,]|{_W}+{_VERB})"),
    ("NAME", 111, 0.95, 1, 0, rf"(\A)({_C}{_G}{_C}(?:{_G}{_C})?)(\n?\z)"),
    ("EMAIL", 201, 0.99, 0, 0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE_NUMBER", 301, 0.95, 0, 0,
     rf"(?:\+1[-.{_S}]?|\b1[-.{_S}]?|\b)[0-9]{{3}}[-.{_S}]?[0-9]{{3}}[-.{_S}]?[0-9]{{4}}\b"),
    ("PHONE_NUMBER", 302, 0.95, 0, 0,
     rf"(?:\+1[-.{_S}]?|\b1[-.{_S}]?)?\([0-9]{{3}}\)(?:{_W}*|[-.])[0-9]{{3}}[-.{_S}]?[0-9]{{4}}\b"),
    ("SSN", 401, 0.98, 0, 0, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("DATE", 501, 0.9, 0, 0, r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b"),
    ("DATE", 502, 0.9, 0, 0, r"\b[0-9]{2,4}[/-][0-9]{1,2}[/-][0-9]{1,2}\b"),
    ("DATE", 503, 0.9, 0, 0, rf"\b[0-9]{{1,2}}{_W}+{_MON}(?i:[a-z]*){_W}+[0-9]{{2,4}}\b"),
    ("DATE", 504, 0.9, 0, 0,
     rf"\b{_MON}(?i:[a-z]*){_W}+[0-9]{{1,2}}(?:st|nd|rd|th)?,?{_W}+[0-9]{{2,4}}\b"),
    ("DATE", 505, 0.9, 0, 0, rf"\b[0-9]{{1,2}}/{_MON}/[0-9]{{4}}\b"),
    ("DATE", 506, 0.9, 0, 0, rf"\b{_MONTH}{_G}[0-9]{{1,2}}(?:st|nd|rd|th)?\b"),
    ("CREDIT_DEBIT_NUMBER", 601, 0.95, 0, 0,
     rf"\b[0-9]{{4}}[{_S}-]?[0-9]{{4}}[{_S}-]?[0-9]{{4}}[{_S}-]?[0-9]{{4}}\b"),
    ("ZIP", 701, 0.85, 0, 0, r"\b[0-9]{5}(?:-[0-9]{4})?\b"),
    ("ADDRESS", 801, 0.9, 0, 0,
     rf"\b[0-9]+{_W}+[A-Za-z{_S}]+(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard|Way"
     rf"|Court|Ct|Plaza|Place|Pl)\.?{_W}*,?{_W}*[A-Za-z{_S}]+,?{_W}*[A-Z]{{2}}{_W}+[0-9]{{5}}"
     r"(?:-[0-9]{4})?"),
    ("MRN", 901, 0.95, 1, 1, rf"(\b(?:MRN|mrn|Medical Record Number)[{_S}:#-]*)({_J})(\b)"),
    ("MRN", 902, 0.95, 1, 1, rf"(\b(?:Patient ID|patient id)[{_S}:#-]*)({_J})(\b)"),
    ("MRN", 903, 0.95, 0, 0, r"\b[A-Z]{2,4}-[0-9]{6,10}\b"),
    ("INSURANCE_ID", 1001, 0.95, 1, 0, rf"(\b(?i:Insurance ID):{_W}*)([A-Za-z0-9]*[0-9][A-Za-z0-9]*)()"),
    ("INSURANCE_ID", 1002, 0.95, 1, 0, rf"(\b(?i:Member ID|Policy Number)[{_S}:#-]*)({_J})(\b)"),
    ("INSURANCE_ID", 1003, 0.85, 0, 0, r"\b[A-Za-z]{1,3}[0-9]{6,12}\b"),
    ("LICENSE_NUMBER", 1101, 0.9, 1, 1, rf"(\b(?i:License|Certificate)[{_S}#:]*)({_J})(\b)"),
    ("VEHICLE_ID", 1201, 0.95, 1, 1, rf"(\b(?i:License Plate|Plate)[{_S}:#]*)({_J})(\b)"),
    ("VEHICLE_ID", 1202, 0.95, 1, 1, rf"(\b(?i:VIN)[{_S}:#]*)([A-Za-z0-9]{{17}})(\b)"),
    ("DEVICE_ID", 1301, 0.95, 1, 1, rf"(\b(?i:Serial Number|Serial|SN)[{_S}:#]*)({_J})(\b)"),
    ("DEVICE_ID", 1302, 0.95, 1, 1, rf"(\b(?i:Device ID|Device)[{_S}:#]*)({_J})(\b)"),
    ("DEVICE_ID", 1303, 0.95, 1, 1,
     rf"(\b(?i:Pacemaker|Pump|Implant){_W}+(?i:ID|Serial)[{_S}:#]*)({_J})(\b)"),
    ("URL", 1401, 0.99, 0, 0, rf"https?://[^{_S}]+"),
    ("IP_ADDRESS", 1501, 0.95, 0, 0, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("BIOMETRIC_ID", 1601, 0.95, 1, 1,
     rf"(\b(?i:Fingerprint|Retinal|Voiceprint|Facial Recognition)[{_S}:]*(?i:ID)?[{_S}:#]*)({_J})(\b)"),
    ("CLINICAL_TRIAL_ID", 1701, 0.95, 0, 0, r"\bNCT[0-9]{8}\b"),
    ("EMPLOYEE_ID", 1801, 0.9, 1, 1, rf"(\b(?i:Employee ID|EID)[{_S}:#]*)({_J})(\b)"),
    ("AGE", 1901, 0.9, 1, 0,
     r"(\b)(9[0-9]|1[0-9]{2})([- ]?(?i:years?|yrs?|yo|y/o)(?i:[- ]old)?\b)"),
    ("AGE", 1902, 0.9, 1, 0, r"(\b(?i:age|aged)[: \t]*)(9[0-9]|1[0-9]{2})(\b)"),
]
_TITLES = "|".join(t.replace(".", r"\.?") for t in vocab.PROVIDER_TITLES)
PROVIDERS = [
    ("PROVIDER", 1, 1.0, 0, 0, rf"\b(?:{_TITLES})[.:]?{_G}{_F}"),
    ("PROVIDER", 2, 1.0, 0, 0, rf"\b{_F},[ \t]*(?:{'|'.join(vocab.CREDENTIALS)})\b"),
]
# ----------------------------------------------------------------------------------------------------
SPAN_COLUMNS = 'doc_id, type, ord, score, "begin", "end", original, weight'

DOCS = "SELECT doc_id, source AS identity, 'SOURCE' AS identity_type, text FROM documents"
NOTES = (f"SELECT o_orderkey AS doc_id, {d.IDENTITY} AS identity, 'CUSTOMER' AS identity_type, "
         f"{d.NOTE} AS text FROM orders")
RECORDS = (f"SELECT o_orderkey AS doc_id, {d.IDENTITY} AS identity, 'CUSTOMER' AS identity_type, "
           f"{d.RECORD} AS record FROM orders")


def rules_of(*types: str) -> list[tuple]:
    return [r for r in RULES if r[0] in types]


def sized(part: str) -> str:
    return f"CAST(length({part}) AS VARCHAR) || ':' || {part} || '|'"


def uuid(identity: str = "identity", identity_type: str = "identity_type") -> str:
    h = f"sha256('{d.SECRET}|identity|' || {sized(identity_type)} || {identity})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})"
                              for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def digest(uuid_: str, type_: str, original: str, secret: str = d.SECRET) -> str:
    return f"sha256('{secret}|' || {sized(uuid_)} || {sized(type_)} || lower({original}))"


def num(h: str, at: int, mod: int) -> str:
    return f"(CAST('0x' || substr({h}, {at}, 14) AS BIGINT) % {mod})"


def digits(h: str, at: int, n: int) -> str:
    return f"lpad(CAST({num(h, at, 10 ** n)} AS VARCHAR), {n}, '0')"


def pick(h: str, at: int, values: list[str]) -> str:
    return f"split_part('{'|'.join(values)}', '|', CAST({num(h, at, len(values))} AS INT) + 1)"


def first_name(h: str) -> str:
    return pick(h, 1, vocab.FIRST_NAMES)


def last_name(h: str) -> str:
    def letter(at: int, table: str) -> str:
        return f"translate(substr({h}, {at}, 1), '0123456789abcdef', '{table}')"
    pairs = [(letter(20 + i, "bcdfghjklmnprstv"), letter(30 + i, "aeiouaeiouaeioua"))
             for i in range(4)]
    flat = [x for p in pairs for x in p]
    return " || ".join([f"upper({flat[0]})", *flat[1:]])


def zip_mask(z: str) -> str:
    areas = ", ".join(f"'{a}'" for a in vocab.RESTRICTED_ZIP3)
    return (f"CASE WHEN substr({z}, 1, 3) IN ({areas}) THEN '00000' ELSE substr({z}, 1, 3) || '**' END")


def date_mask(v: str) -> str:
    strict = r"^([0-9]{1,2}/([0-9]{1,2}|[A-Za-z]{3})/[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$"
    formats = ", ".join(f"try_strptime({v}, '{f}')" for f in ("%d/%b/%Y", "%d/%m/%Y", "%Y-%m-%d",
                                                             "%m/%d/%Y"))
    loose = rf"regexp_extract({v}, '(?:^|[^0-9])([0-9]{{4}})(?:[^0-9]|$)', 1)"
    return (f"'XX/XX/' || coalesce(CASE WHEN regexp_matches({v}, '{strict}') THEN "
            f"CAST(year(coalesce({formats})) AS VARCHAR) WHEN {loose} <> '' THEN {loose} END, 'XXXX')")


def dob_mask(v: str) -> str:
    return (f"CASE WHEN regexp_matches({v}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}$') "
            f"THEN 'XX/XX/' || split_part({v}, '/', 3) ELSE {date_mask(v)} END")


def address(h: str, v: str) -> str:
    tail = r"([A-Z]{2})\s+([0-9]{5})(?:-[0-9]{4})?$"
    st, z = f"regexp_extract({v}, '{tail}', 1)", f"regexp_extract({v}, '{tail}', 2)"
    return (f"CAST({num(h, 1, 9000)} + 1000 AS VARCHAR) || ' ' || {pick(h, 15, vocab.STREETS)} || ', ' || "
            f"{pick(h, 29, vocab.CITIES)} || ', ' || CASE WHEN {st} <> '' THEN {st} ELSE 'XX' END || ' ' "
            f"|| CASE WHEN {z} <> '' THEN {zip_mask(z)} ELSE '00000' END")


def fake(type_: str, h: str, v: str) -> str:
    """A CASE over all types, given the digest column ``h`` and the value column ``v``."""
    by = {
        "NAME": f"{first_name(h)} || ' ' || {last_name(h)}", "ADDRESS": address(h, v),
        "PHONE_NUMBER": f"'555-' || {digits(h, 1, 3)} || '-' || {digits(h, 15, 4)}",
        "EMAIL": f"'user' || substr({h}, 1, 12) || '@example.com'",
        "SSN": f"'9' || {digits(h, 1, 2)} || '-' || {digits(h, 15, 2)} || '-' || {digits(h, 29, 4)}",
        "DATE": date_mask(v), "CREDIT_DEBIT_NUMBER": f"{digits(h, 1, 8)} || {digits(h, 15, 8)}",
        "ZIP": zip_mask(v), "URL": f"'https://example.org/' || substr({h}, 1, 10)",
        "IP_ADDRESS": "'10.' || " + " || '.' || ".join(
            f"CAST({num(h, at, 256)} AS VARCHAR)" for at in (1, 15, 29)),
        "MRN": f"'MRN-' || {digits(h, 1, 8)}",
        "INSURANCE_ID": f"{pick(h, 1, ['POL', 'MEM', 'GRP'])} || {digits(h, 15, 9)}",
        "LICENSE_NUMBER": (f"translate(substr({h}, 1, 3), '0123456789abcdef', 'ABCDEFGHJKLMNPRS') "
                           f"|| '-' || {digits(h, 15, 4)}"),
        "VEHICLE_ID": f"upper(substr({h}, 1, 17))", "DEVICE_ID": f"'SN-' || {digits(h, 1, 10)}",
        "BIOMETRIC_ID": f"'BIO-' || {digits(h, 1, 12)}",
        "CLINICAL_TRIAL_ID": f"'NCT' || {digits(h, 1, 8)}",
        "EMPLOYEE_ID": f"'EMP' || {digits(h, 1, 6)}", "DOB": dob_mask(v), "AGE": "'90 or above'",
    }
    whens = " ".join(f"WHEN '{k}' THEN {e}" for k, e in by.items())
    return f"CASE {type_} {whens} ELSE '[REDACTED-' || {type_} || ']' END"


def matches(source: str, rules: list[tuple], text: str = "text") -> str:
    """Matches of the rules over ``source(doc_id, text)``, one row each."""
    parts = []
    for type_, ord_, score, labelled, counts, pattern in rules:
        mark = ("chr(2) || '\\1' || chr(1) || '\\2' || chr(1) || '\\3'" if labelled
                else "chr(1) || '\\0' || chr(1)")
        label = ("length(string_split(lag(piece) OVER w, chr(2))[-1])" if counts else "0")
        parts.append(f"""SELECT doc_id, '{type_}' AS type, {ord_} AS ord, CAST({score} AS DOUBLE) AS score,
  CAST(coalesce(sum(length(replace(piece, chr(2), ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1
  PRECEDING), 0) AS INT) AS "begin", piece AS original, idx, CAST(length(piece) + {label} AS INT) AS weight
  FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS idx FROM (
    SELECT doc_id, string_split(regexp_replace({text}, '{pattern}', {mark}, 'g'), chr(1)) AS p
    FROM {source}) WHERE len(p) > 1) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
    return ("SELECT doc_id, type, ord, score, \"begin\", CAST(\"begin\" + length(original) AS INT) AS \"end\", "
            "original, weight FROM (" + " UNION ALL ".join(parts) + ") WHERE idx % 2 = 0")


def _term_words() -> str:
    return "|".join(t.lower() for t in vocab.NON_NAME_TERMS)


def is_term(v: str) -> str:
    labels = ", ".join(f"'{w}'" for w in vocab.LABEL_WORDS)
    return rf"(regexp_matches(lower({v}), '\b(?:{_term_words()})\b') OR {v} IN ({labels}))"


def candidate_ctes(source: str, text: str = "text", types: tuple[str, ...] | None = None) -> str:
    """CTEs ending in ``cand``: all candidates over ``source``, after the name and context filters."""
    rules = [r for r in RULES if types is None or r[0] in types]
    near = " OR ".join(f"contains(near, '{w}')" for w in vocab.INSURANCE_CONTEXT_WORDS)
    reach = vocab.INSURANCE_CONTEXT_CHARS
    return f"""raw AS ({matches(source, rules, text)}),
fence AS ({matches(source, PROVIDERS, text)}),
named AS (SELECT * FROM raw r WHERE type = 'NAME' AND NOT {is_term('original')} AND NOT EXISTS (
  SELECT 1 FROM fence f WHERE f.doc_id = r.doc_id AND r."begin" >= f."begin" AND r."end" <= f."end")),
once AS (SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM named o WHERE o.doc_id = n.doc_id
  AND (o.ord, o."begin") < (n.ord, n."begin") AND o."begin" <= n."begin" AND o."end" >= n."end")),
cand AS (SELECT {SPAN_COLUMNS} FROM once UNION ALL SELECT {SPAN_COLUMNS} FROM (
  SELECT r.*, lower(substr(s.{text}, greatest(r."begin" - {reach}, 0) + 1,
    r."end" + {reach} - greatest(r."begin" - {reach}, 0))) AS near
  FROM raw r JOIN {source} s USING (doc_id) WHERE type <> 'NAME') WHERE ord <> 1003 OR {near})"""


def resolved_ctes(cand: str = "cand") -> str:
    """CTE ``kept``: greedy selection, best first."""
    return f"""best AS (SELECT doc_id, list_reduce(list([{{'type': type, 'b': "begin", 'e': "end",
  'original': original, 'score': score, 'ord': ord}}] ORDER BY score DESC, weight DESC, "end" - "begin" DESC,
  ord, "begin"),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: x[1].b < k.e AND x[1].e > k.b)) = 0
    THEN list_concat(acc, x) ELSE acc END) AS spans FROM {cand} GROUP BY doc_id),
kept AS (SELECT doc_id, s.type AS type, s.b AS "begin", s.e AS "end", s.original AS original,
  s.score AS score, s.ord AS ord FROM (SELECT doc_id, unnest(spans) AS s FROM best))"""


def faked_ctes(source: str) -> str:
    """CTEs ``who`` (uuid per text) and ``faked`` (spans with replacement and rank)."""
    return f"""who AS (SELECT doc_id, {uuid()} AS uuid FROM {source}),
hashed AS (SELECT k.*, w.uuid, {digest('w.uuid', 'k.type', 'k.original')} AS h
  FROM kept k JOIN who w USING (doc_id)),
faked AS (SELECT *, {fake('type', 'h', 'original')} AS fake FROM hashed)"""


def spliced_ctes(source: str, text: str = "text", value: str = "fake", spans: str = "faked") -> str:
    """CTE ``done``: (doc_id, text, anonymized, n) with each span replaced by ``value``."""
    return f"""cuts AS (SELECT f.*, s.{text} AS t, coalesce(lag("end") OVER (PARTITION BY f.doc_id
  ORDER BY "begin"), 0) AS prev FROM {spans} f JOIN {source} s USING (doc_id)),
built AS (SELECT doc_id, string_agg(substr(t, prev + 1, "begin" - prev) || {value}, '' ORDER BY "begin")
  AS head, max("end") AS last, count(*) AS n FROM cuts GROUP BY doc_id),
done AS (SELECT s.doc_id, s.{text} AS text, CASE WHEN b.n IS NULL THEN s.{text}
  ELSE b.head || substr(s.{text}, b.last + 1) END AS anonymized,
  CAST(coalesce(b.n, 0) AS INT) AS entities_detected FROM {source} s LEFT JOIN built b USING (doc_id))"""
