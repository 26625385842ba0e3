"""SQL for the registered queries, to be run by another engine on the same tables."""

from __future__ import annotations

from ..functions import vocab
from . import derive as d
from . import oracle_parts as o
from . import queries as q

ORACLE: dict[str, str] = {}

S = d.SECRET
AT = "TIMESTAMP '2024-01-01 00:00:00'"
MATCH = 'doc_id, type, original, "begin", "end", score'
PAGES = "SELECT page_id AS doc_id, url || chr(10) || html AS text FROM pages"
WHO = f"{d.IDENTITY} AS identity, 'CUSTOMER' AS identity_type"
UUID = o.uuid(f"({d.IDENTITY})", "'CUSTOMER'")


def _with(source: str, *ctes: str) -> str:
    return ", ".join([f"WITH src AS MATERIALIZED ({source})", *ctes])


def _full(source: str) -> str:
    """All steps up to the spliced text."""
    return _with(source, o.candidate_ctes("src"), o.resolved_ctes(), o.faked_ctes("src"),
                 o.spliced_ctes("src"))


# ---- detectors --------------------------------------------------------------------------------------

for _name, _src, _type in [
        ("detect_name", o.NOTES, "NAME"), ("detect_name_documents", o.DOCS, "NAME"),
        ("detect_email", o.DOCS, "EMAIL"), ("detect_phone", o.DOCS, "PHONE_NUMBER"),
        ("detect_phone_notes", o.NOTES, "PHONE_NUMBER"), ("detect_ssn", o.NOTES, "SSN"),
        ("detect_date", o.NOTES, "DATE"), ("detect_card", o.DOCS, "CREDIT_DEBIT_NUMBER"),
        ("detect_zip", o.NOTES, "ZIP"), ("detect_address", o.NOTES, "ADDRESS"),
        ("detect_mrn", o.NOTES, "MRN"), ("detect_insurance", o.NOTES, "INSURANCE_ID"),
        ("detect_license", o.NOTES, "LICENSE_NUMBER"), ("detect_vehicle", o.NOTES, "VEHICLE_ID"),
        ("detect_device", o.NOTES, "DEVICE_ID"), ("detect_url", PAGES, "URL"),
        ("detect_ip", o.DOCS, "IP_ADDRESS"), ("detect_biometric", o.NOTES, "BIOMETRIC_ID"),
        ("detect_trial", o.NOTES, "CLINICAL_TRIAL_ID"), ("detect_employee", o.NOTES, "EMPLOYEE_ID"),
        ("detect_age", o.NOTES, "AGE")]:
    ORACLE[_name] = f"{_with(_src, o.candidate_ctes('src', types=(_type,)))} SELECT {MATCH} FROM cand"

ORACLE["text_source"] = "SELECT doc_id, source AS identity, 'SOURCE' AS identity_type, text FROM documents"
ORACLE["provider_exclusion"] = (f'{_with(o.NOTES)} SELECT doc_id, original, "begin", "end" FROM '
                                f"({o.matches('src', o.PROVIDERS)})")
ORACLE["medical_exclusion"] = (
    f'{_with(o.NOTES)} SELECT doc_id, original, "begin", "end" FROM '
    f"({o.matches('src', o.rules_of('NAME'))}) WHERE {o.is_term('original')}")
ORACLE["detect_all"] = (f"{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes())} "
                        f"SELECT {MATCH} FROM kept")
ORACLE["resolve_overlaps"] = (f"{_with(o.NOTES, o.candidate_ctes('src'), o.resolved_ctes())} "
                              f"SELECT {MATCH} FROM kept")
# The spans of a text as one ordered list, each held against those after it; no join.
ORACLE["overlap_pairs"] = f"""{_with(o.NOTES, o.candidate_ctes('src'))},
per AS (SELECT doc_id, list({{'b': "begin", 'e': "end", 't': type, 'o': original, 's': score, 'r': ord, 'w': weight}}
  ORDER BY "begin", "end", type, original, score, ord, weight) AS l FROM cand GROUP BY doc_id),
one AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM per),
pair AS (SELECT doc_id, l[i] AS a, unnest(list_filter(l[i + 1:], lambda x: l[i].b < x.e AND l[i].e > x.b)) AS b FROM one)
SELECT doc_id, a.t AS left_type, a.b AS left_begin, a.e AS left_end, b.t AS right_type, b.b AS right_begin,
  b.e AS right_end FROM pair"""
_CUSTOM = [("POLICY_REF", 9001, 0.97, 1, 0, "(policy )(XY[0-9]{8})()"), ("PLATE_REF", 9002, 0.99, 0, 0, r"\bKX-[0-9]{3}\b")]
ORACLE["detect_custom_rules"] = f"{_with(o.NOTES)} SELECT {MATCH} FROM ({o.matches('src', _CUSTOM)})"
ORACLE["external_overlap_join"] = f"""{_with(o.NOTES, o.candidate_ctes('src', types=('NAME', 'DATE', 'AGE')))},
ext AS (SELECT doc_id, 'LINE' AS type, strpos(text, 'Patient: ') - 1 AS b, strpos(text, 'Phone: ') - 1 AS e FROM src
  UNION ALL SELECT doc_id, 'TAIL', strpos(text, 'Age: ') - 1, length(text) FROM src)
SELECT c.doc_id, c.type AS left_type, CAST(c."begin" AS BIGINT) AS left_begin, CAST(c."end" AS BIGINT) AS left_end,
  x.type AS right_type, x.b AS right_begin, x.e AS right_end FROM cand c JOIN ext x ON c.doc_id = x.doc_id
WHERE c."begin" < x.e AND x.b < c."end" """
ORACLE["external_entities"] = f"""{_with(o.NOTES, o.candidate_ctes('src'))},
ext AS (SELECT doc_id, 'PRODUCT' AS type, 0 AS ord, CAST(0.97 AS DOUBLE) AS score,
  CAST(strpos(text, 'Metformin') - 1 AS INT) AS "begin", CAST(strpos(text, 'Metformin') + 8 AS INT) AS "end",
  'Metformin' AS original, 9 AS weight FROM src WHERE doc_id % 2 = 1),
both_ AS (SELECT {o.SPAN_COLUMNS} FROM cand UNION ALL SELECT {o.SPAN_COLUMNS} FROM ext),
{o.resolved_ctes('both_')} SELECT {MATCH} FROM kept"""
ORACLE["min_length_rule"] = f"""{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes())}
SELECT doc_id, type, original FROM kept WHERE NOT (type = 'NAME' AND length(original) < {vocab.MIN_NAME_LENGTH})
AND NOT (type = 'MRN' AND length(original) < {vocab.MIN_MRN_LENGTH})"""
ORACLE["entities_by_type"] = f"""{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes())}
SELECT doc_id, type, string_agg(original, '|' ORDER BY "begin") AS originals FROM kept GROUP BY doc_id, type"""

# ---- replacement values and masks ---------------------------------------------------------------------


def _one(type_: str, value: str) -> str:
    return (f"WITH v AS (SELECT o_orderkey AS doc_id, {UUID} AS uuid, {value} AS v FROM orders), "
            f"h AS (SELECT *, '{type_}' AS t, {o.digest('uuid', repr(type_), 'v')} AS h FROM v) "
            f"SELECT doc_id, {o.fake('t', 'h', 'v')} AS fake FROM h")


for _name, _type, _value in [
        ("fake_name", "NAME", f"{d.FIRST} || ' ' || {d.LAST}"), ("fake_address", "ADDRESS", d.ADDRESS),
        ("fake_phone", "PHONE_NUMBER", d.PHONE), ("fake_email", "EMAIL", d.EMAIL),
        ("fake_ssn", "SSN", d.SSN), ("fake_card", "CREDIT_DEBIT_NUMBER", d.CARD),
        ("fake_url", "URL", d.URL), ("fake_ip", "IP_ADDRESS", d.IP), ("fake_dob", "DOB", d.DATE),
        ("fake_other", "PASSPORT", d.MRN)]:
    ORACLE[_name] = _one(_type, _value)

_IDS = ", ".join(f"{o.digest('uuid', repr(t), 'v')} AS h_{t.lower()}" for t in q.ID_TYPES)
_ID_FAKES = ", ".join(f"{o.fake(repr(t), f'h_{t.lower()}', 'v')} AS {t.lower()}" for t in q.ID_TYPES)
ORACLE["fake_ids"] = (f"WITH v AS (SELECT o_orderkey AS doc_id, {UUID} AS uuid, {d.MRN} AS v FROM orders), "
                      f"h AS (SELECT *, {_IDS} FROM v) SELECT doc_id, {_ID_FAKES} FROM h")
ORACLE["mask_date"] = f"WITH x AS (SELECT o_orderkey AS doc_id, {q.MIXED_DATES} AS v FROM orders) " \
                      f"SELECT doc_id, {o.date_mask('v')} AS masked FROM x"
ORACLE["mask_dob"] = f"WITH x AS (SELECT o_orderkey AS doc_id, {q.MIXED_DATES} AS v FROM orders) " \
                     f"SELECT doc_id, {o.dob_mask('v')} AS masked FROM x"
ORACLE["mask_zip"] = f"WITH x AS (SELECT o_orderkey AS doc_id, {d.ZIP} AS v FROM orders) " \
                     f"SELECT doc_id, {o.zip_mask('v')} AS masked FROM x"
ORACLE["mask_age"] = ("SELECT o_orderkey AS doc_id, CASE WHEN 80 + o_orderkey % 25 >= 90 THEN '90 or above' "
                      "ELSE CAST(80 + o_orderkey % 25 AS VARCHAR) END AS masked FROM orders")

# ---- anonymise and restore ------------------------------------------------------------------------------

ORACLE["anonymize_documents"] = f"""{_full(o.DOCS)} SELECT doc_id, uuid, anonymized, CAST(200 AS INT) AS status,
  entities_detected FROM done JOIN who USING (doc_id)"""
ORACLE["anonymize_notes"] = f"""{_full(o.NOTES)} SELECT doc_id, uuid, anonymized, entities_detected
  FROM done JOIN who USING (doc_id)"""
ORACLE["redact_text"] = f"""{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes(),
    "tagged AS (SELECT *, '[REDACTED-' || type || ']' AS fake FROM kept)",
    o.spliced_ctes('src', spans='tagged'))} SELECT doc_id, anonymized AS redacted FROM done"""

_K = d.IDENTITY.replace("o_custkey", "c_custkey")
_CNAME = f"{d.FIRST} || ' ' || {d.LAST}".replace("o_custkey", "c_custkey")
LEGACY = (f"SELECT {o.uuid(f'({_K})', repr('CUSTOMER'))} AS uuid, lower({_CNAME}) AS value_key, "
          f"'Legacy Person ' || CAST(c_custkey AS VARCHAR) AS stored FROM customer "
          f"WHERE c_mktsegment = 'BUILDING'")
ORACLE["anonymize_text"] = f"""{_with(o.NOTES, o.candidate_ctes('src'), o.resolved_ctes(),
    o.faked_ctes('src'), f'legacy AS ({LEGACY})')},
fixed AS (SELECT f.* EXCLUDE (fake), coalesce(l.stored, f.fake) AS fake FROM faked f LEFT JOIN legacy l
  ON f.uuid = l.uuid AND f.type = 'NAME' AND lower(f.original) = l.value_key),
{o.spliced_ctes('src', spans='fixed')} SELECT doc_id, anonymized, entities_detected FROM done"""
ORACLE["resolve_mappings"] = f"""WITH legacy AS ({LEGACY}), v AS (SELECT o_orderkey AS doc_id, {UUID} AS uuid,
  {d.FIRST} || ' ' || {d.LAST} AS v FROM orders),
h AS (SELECT *, {o.digest('uuid', "'NAME'", 'v')} AS h FROM v)
SELECT doc_id, coalesce(stored, {o.fake("'NAME'", 'h', 'v')}) AS fake, stored IS NULL AS is_new
FROM h LEFT JOIN legacy l ON l.uuid = h.uuid AND l.value_key = lower(v)"""


def _first_original(rows: str) -> str:
    """The stored original of each value (first casing), then one original per replacement."""
    return f"""maprows AS (SELECT uuid, type, lower(original) AS vk, arg_min(original, (doc_id, "begin")) AS
  original, arg_min(fake, (doc_id, "begin")) AS fake FROM {rows} GROUP BY uuid, type, lower(original)),
byfake AS (SELECT uuid, fake, min(original) AS original, min(original) <> max(original) AS ambiguous
  FROM maprows GROUP BY uuid, fake)"""


# Against the input, not the rule: every span holds its original again, but where a replacement is ambiguous.
ORACLE["deanonymize_text"] = f"""{_with(o.NOTES, o.candidate_ctes('src'), o.resolved_ctes(), o.faked_ctes('src'),
    _first_original('faked'))},
again AS (SELECT f.* EXCLUDE (fake), CASE WHEN b.ambiguous THEN f.fake ELSE b.original END AS fake, b.ambiguous
  FROM faked f JOIN byfake b ON f.uuid = b.uuid AND f.fake = b.fake),
{o.spliced_ctes('src', spans='again')},
n AS (SELECT doc_id, count(*) FILTER (ambiguous) AS a, count(*) FILTER (NOT ambiguous) AS r FROM again GROUP BY doc_id)
SELECT doc_id, anonymized AS restored, CAST(coalesce(r, 0) AS INT) AS entities_restored, CAST(coalesce(a, 0) AS INT) AS
  ambiguous FROM done LEFT JOIN n USING (doc_id)"""
ORACLE["deanonymize_foreign"] = f"""WITH b AS (SELECT c_custkey, upper({_CNAME}) AS original FROM customer
  WHERE c_mktsegment = 'BUILDING')
SELECT o_orderkey AS doc_id, CASE WHEN b.c_custkey IS NULL THEN 'seen: Legacy Person ' ||
  CAST(o_custkey AS VARCHAR) || ' today' ELSE 'seen: ' || b.original || ' today' END AS restored,
  CAST(CASE WHEN b.c_custkey IS NULL THEN 0 ELSE 1 END AS INT) AS entities_restored
FROM orders LEFT JOIN b ON b.c_custkey = o_custkey"""
ORACLE["restore_by_ledger"] = f"SELECT doc_id, text AS restored FROM ({o.NOTES})"
ORACLE["ledger_rows"] = f"""{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes(), o.faked_ctes('src'))},
moved AS (SELECT *, coalesce(sum(length(fake) - length(original)) OVER (PARTITION BY doc_id ORDER BY "begin"
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM faked)
SELECT doc_id, type AS pii_type, "begin", "end", CAST("begin" + shift AS INT) AS out_begin,
  CAST("begin" + shift + length(fake) AS INT) AS out_end, original, fake FROM moved"""

# ---- profiles ----------------------------------------------------------------------------------------------

ORACLE["profile_scan"] = f"""SELECT o_orderkey AS doc_id, 'name' AS key, {d.FIRST} AS value FROM orders
UNION ALL SELECT o_orderkey, 'age', {d.AGE} FROM orders"""
_VALUES = dict(d.PROFILE)
_FIELD = [  # key, type, value in, how the digest becomes the new value
    ("first_name", "NAME", d.FIRST, o.last_name("h")), ("last_name", "NAME", d.LAST, o.last_name("h")),
    ("dob", "DOB", d.DATE, o.dob_mask("v")), ("zip", "ZIP", d.ZIP, o.zip_mask("v")),
    ("phone", "PHONE_NUMBER", d.PHONE, None), ("email", "EMAIL", d.EMAIL, None),
    ("comment", "DATE", d.DATE, None)]
_PROFILE = "WITH f AS (" + " UNION ALL ".join(
    f"SELECT doc_id, uuid, '{k}' AS key, '{t}' AS type, v, {e or o.fake(repr(t), 'h', 'v')} AS fake FROM "
    f"(SELECT o_orderkey AS doc_id, {UUID} AS uuid, {v} AS v, "
    f"{o.digest(UUID, repr(t), f'({v})')} AS h FROM orders)" for k, t, v, e in _FIELD) + ")"
_KEPT = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{k}' AS key, {_VALUES[k]} AS value FROM orders"
                           for k in ("provider_first_name", "diagnosis", "extra"))
ORACLE["anonymize_profile"] = (f"{_PROFILE} SELECT doc_id, key, fake AS value FROM f UNION ALL {_KEPT}")
ORACLE["deanonymize_profile"] = f"""{_PROFILE}, b AS (SELECT uuid, fake, min(v) <> max(v) AS ambiguous FROM f
  GROUP BY uuid, fake) SELECT f.doc_id, f.key, CASE WHEN b.ambiguous THEN f.fake ELSE f.v END AS value FROM f
  JOIN b ON f.uuid = b.uuid AND f.fake = b.fake UNION ALL {_KEPT}"""

ORACLE["restore_profile_by_ledger"] = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, '{k}' AS key, {v} AS value FROM orders" for k, v in d.PROFILE)

# ---- JSON -------------------------------------------------------------------------------------------------

ORACLE["json_scan"] = f"""SELECT doc_id, json_extract_string(record, '$.patient.name') AS name,
  CAST(json_extract_string(record, '$.vitals.heart_rate') AS INT) AS heart_rate,
  CAST(json_array_length(record, '$.diagnoses') AS INT) AS diagnoses, record FROM ({o.RECORDS})"""
_LEAVES = ["$.patient.name", "$.patient.dob", "$.patient.mrn", "$.patient.phone", "$.visit.date",
           "$.visit.provider", "$.visit.note", "$.diagnoses[0]", "$.diagnoses[1]", "$.medications[0].name",
           "$.medications[0].dose", "$.vitals.empty"]
ORACLE["json_leaves"] = f"WITH r AS ({o.RECORDS}) " + " UNION ALL ".join(
    f"SELECT doc_id, json_extract_string(record, '{p}') AS value FROM r" for p in _LEAVES)

_NAME_V, _MRN_V = f"({d.FIRST} || ' ' || {d.LAST})", f"('MRN-' || {d._pad('o_orderkey', 6)})"
_FAKED = ", ".join(
    f"{o.fake(repr(t), o.digest('uuid', repr(t), v), v)} AS {n}" for n, t, v in [
        ("f_name", "NAME", "v_name"), ("f_date", "DATE", "v_date"), ("f_mrn", "MRN", "v_mrn"),
        ("f_phone", "PHONE_NUMBER", "v_phone"), ("f_email", "EMAIL", "v_email")])
_JSON = f"""WITH v AS (SELECT *, {UUID} AS uuid, {_NAME_V} AS v_name, {d.DATE} AS v_date, {_MRN_V} AS v_mrn,
  {d.PHONE} AS v_phone, {d.EMAIL} AS v_email FROM orders), x AS (SELECT *, {_FAKED} FROM v)"""
ORACLE["anonymize_json"] = f"""{_JSON} SELECT o_orderkey AS doc_id,
  {d.record_sql('f_name', 'f_date', 'f_mrn', 'f_phone', 'f_email')} AS anonymized, CAST(200 AS INT) AS status,
  CAST(5 AS INT) AS entities_detected FROM x"""
ORACLE["anonymize_json_struct"] = f"""{_JSON} SELECT o_orderkey AS doc_id, f_name AS name,
  'Dr. ' || {d.FIRST2} || ' ' || {d.LAST2} || ', MD' AS provider,
  CAST(60 + o_orderkey % 40 AS INT) AS heart_rate FROM x"""
ORACLE["restore_struct_by_ledger"] = f"""{_JSON} SELECT o_orderkey AS doc_id, v_name AS name, v_date AS dob,
  'Call ' || v_phone AS diagnosis, '1000mg' AS dose, CAST(NULL AS VARCHAR) AS note, false AS unclear FROM x"""
ORACLE["deanonymize_json"] = f"""{_JSON}, b AS (SELECT uuid, f_date, min(v_date) <> max(v_date) AS ambiguous FROM x GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN ambiguous THEN f_date ELSE v_date END AS r_date FROM x JOIN b USING (uuid, f_date))
SELECT o_orderkey AS doc_id, {d.record_sql('v_name', 'r_date', 'v_mrn', 'v_phone', 'v_email')} AS restored,
  CAST(CASE WHEN ambiguous THEN 5 ELSE 7 END AS INT) AS entities_restored,
  CAST(CASE WHEN ambiguous THEN 2 ELSE 0 END AS INT) AS ambiguous, CAST(200 AS INT) AS status FROM y"""
ORACLE["restore_json_by_ledger"] = f"SELECT doc_id, record AS restored FROM ({o.RECORDS})"
ORACLE["structure_check"] = "SELECT count(*) AS records, CAST(0 AS BIGINT) AS changed FROM orders"
ORACLE["legacy_guard"] = """SELECT o_orderkey AS doc_id, CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 400
  ELSE 200 END AS INT) AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
ORACLE["bad_records"] = f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN substr(record, 1,
  length(record) - 4) ELSE record END AS record FROM ({o.RECORDS}))
SELECT doc_id, CAST(CASE WHEN json_valid(record) THEN 200 ELSE 500 END AS INT) AS status,
  CASE WHEN NOT json_valid(record) THEN 'Error: not a JSON document' END AS error FROM r"""

# ---- requests, consent, audit, history -----------------------------------------------------------------------

_UP = o.uuid(f"upper({d.IDENTITY})", "'CUSTOMER'")
_PH = o.fake("'PHONE_NUMBER'", o.digest("uuid", "'PHONE_NUMBER'", "phone"), "phone")
_REQ = f"""WITH r AS (SELECT *, o_orderkey % 7 AS k, {_UP} AS uuid, {d.PHONE} AS phone, {d.DATE} AS day
  FROM orders), x AS (SELECT *, {_PH} AS fake, {o.date_mask('day')} AS mask FROM r)"""
ORACLE["route_requests"] = f"""{_REQ} SELECT o_orderkey AS request_id,
  CASE k WHEN 0 THEN 'ANONYMIZE' WHEN 1 THEN 'ANONYMIZE_JSON' WHEN 2 THEN 'ANONYMIZE_PROFILE'
    WHEN 3 THEN 'DE-ANONYMIZE' WHEN 4 THEN 'DE_ANONYMIZE_JSON' WHEN 5 THEN 'DE_ANONYMIZE_PROFILE' END AS handler,
  CAST(CASE WHEN k = 6 THEN 500 WHEN k = 0 AND o_orderstatus = 'F' THEN 403 ELSE 200 END AS INT) AS status,
  CASE k WHEN 0 THEN CASE WHEN o_orderstatus <> 'F' THEN 'Call ' || fake || ' by ' || mask END
    WHEN 1 THEN '{{"phone": "' || fake || '", "n": 1.50}}' WHEN 2 THEN '{{"phone":"' || fake || '"}}'
    WHEN 3 THEN 'call ' || phone WHEN 4 THEN '{{"phone": "' || phone || '"}}'
    WHEN 5 THEN '{{"phone":"' || phone || '"}}' END AS result,
  CASE WHEN k = 6 THEN 'No handler for method: ERASE' WHEN k = 0 AND o_orderstatus = 'F' THEN
    'consent does not cover this purpose' END AS error FROM x"""
ORACLE["bad_requests"] = """SELECT CAST(NULL AS BIGINT) AS request_id, NULL AS handler, 'not a request in JSON' AS reason,
  true AS from_file FROM orders WHERE o_orderkey % 5 = 1
UNION ALL SELECT o_orderkey, NULL, 'No handler for method: ERASE', false FROM orders WHERE o_orderkey % 5 <> 1 AND o_orderkey % 7 = 6"""
_BACK_META = """'{"gdpr_access_reason":"' || 'case ' || CAST(o_orderkey AS VARCHAR) || '","gdpr_authorized_by":"dr-' || CAST(o_custkey % 50 AS VARCHAR) || '"}'"""
ORACLE["restore_metadata"] = f"SELECT o_orderkey AS request_id, {_BACK_META} AS metadata FROM orders"
_PURPOSE = "CASE WHEN o_orderstatus = 'F' THEN 'marketing' ELSE 'emergency_care' END"
_GDPR = f"""'{{"gdpr_purpose":"' || {_PURPOSE} || '","gdpr_legal_basis":"{vocab.LEGAL_BASIS}",'"""
_SERVED = f"""{_REQ}, s AS (SELECT *, CASE k WHEN 0 THEN 'ANONYMIZE' WHEN 1 THEN 'ANONYMIZE_JSON' WHEN 2 THEN
  'ANONYMIZE_PROFILE' WHEN 3 THEN 'DE-ANONYMIZE' WHEN 4 THEN 'DE_ANONYMIZE_JSON' WHEN 5 THEN 'DE_ANONYMIZE_PROFILE' END
  AS handler, k = 0 AND o_orderstatus = 'F' AS refused, CASE k WHEN 0 THEN 'Call ' || phone || ' by ' || day
    WHEN 1 THEN '{{"phone": "' || phone || '", "n": 1.50}}' WHEN 2 THEN '{{"phone":"' || phone || '"}}'
    WHEN 3 THEN 'call ' || phone WHEN 4 THEN '{{"phone": "' || phone || '"}}'
    WHEN 5 THEN '{{"phone":"' || phone || '"}}' END AS plain, CASE k WHEN 0 THEN 'Call ' || fake || ' by ' || mask
    WHEN 1 THEN '{{"phone": "' || fake || '", "n": 1.50}}' WHEN 2 THEN '{{"phone":"' || fake || '"}}'
    WHEN 3 THEN 'call ' || fake WHEN 4 THEN '{{"phone": "' || fake || '"}}'
    WHEN 5 THEN '{{"phone":"' || fake || '"}}' END AS hidden FROM x)"""
ORACLE["route_history"] = f"""{_SERVED} SELECT uuid, plain AS original, hidden AS anonymized, handler AS method,
  CASE WHEN k >= 3 THEN {_BACK_META} WHEN k = 1 THEN {_GDPR} || '"entities_processed":1,"data_type":"json_simple"}}'
  WHEN k = 0 THEN {_GDPR} || '"entity_count":2,"entity_types":["DATE","PHONE_NUMBER"]}}'
  ELSE {_GDPR} || '"entity_count":1,"entity_types":["PHONE_NUMBER"]}}' END AS metadata, {AT} AS created_at
FROM s WHERE k < 6 AND NOT refused"""
ORACLE["route_audit"] = f"""{_SERVED} SELECT uuid, e AS event_type, coalesce(handler, 'UNKNOWN') AS action,
  CASE WHEN k IN (0, 3) THEN 'conversation' WHEN k IN (1, 4) THEN 'json_data' WHEN k IN (2, 5) THEN 'profile' END AS data_type,
  e <> 'ERROR' AS success, CASE WHEN k = 6 THEN 'No handler for method: ERASE' WHEN refused THEN
    'consent does not cover this purpose' END AS error_message, {_PURPOSE} AS purpose, {AT} AS created_at
FROM (SELECT *, 'ACCESS' AS e FROM s UNION ALL SELECT *, CASE WHEN k = 6 OR refused THEN 'ERROR' ELSE 'SUCCESS' END FROM s)"""
ORACLE["route_ledger"] = f"{_SERVED} SELECT o_orderkey AS doc_id, plain AS restored, false AS unclear FROM s WHERE k = 0 AND NOT refused"
ORACLE["route_results"] = f"""{_SERVED} SELECT 'result' AS store, uuid, CASE WHEN k < 3 AND NOT refused THEN hidden WHEN k < 6
  AND NOT refused THEN plain END AS value FROM s
UNION ALL SELECT DISTINCT 'mapping', uuid, phone FROM s WHERE k < 6 AND NOT refused
UNION ALL SELECT DISTINCT 'mapping', uuid, day FROM s WHERE k = 0 AND NOT refused
UNION ALL SELECT DISTINCT 'identity', uuid, upper({d.IDENTITY}) FROM s WHERE k < 3 AND NOT refused"""
ORACLE["consent_gate"] = """SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderstatus = 'F'
  AND o_orderkey % 4 = 0 THEN 403 ELSE 200 END AS INT) AS status FROM orders"""


def _meta(purpose: str, basis: str) -> str:
    return ("'{\"gdpr_purpose\":" + purpose + ",\"gdpr_legal_basis\":" + basis + ",\"entity_count\":' || "
            "CAST(coalesce(n, 0) AS VARCHAR) || ',\"entity_types\":[' || coalesce(types, '') || ']}'")


_TYPES = """meta AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT '"' || type || '"', ','
  ORDER BY '"' || type || '"') AS types FROM kept GROUP BY doc_id)"""
ORACLE["op_metadata"] = f"""{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes(), _TYPES)}
SELECT doc_id, {_meta('"quality_improvement"', f'"{vocab.LEGAL_BASIS}"')} AS metadata
FROM src LEFT JOIN meta USING (doc_id)"""
ORACLE["history_append"] = f"""{_full(o.DOCS)}, {_TYPES} SELECT uuid, text AS original, anonymized,
  'ANONYMIZE' AS method, {_meta("null", "null")} AS metadata, {AT} AS created_at
FROM done JOIN who USING (doc_id) JOIN meta USING (doc_id)"""
ORACLE["audit_events"] = """SELECT CAST(user_id AS VARCHAR) AS uuid, 'ANONYMIZE' AS action, event_type_ AS
  event_type, event_type_ = 'ACCESS' OR event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN props END AS error_message, ts AS created_at FROM (
  SELECT *, 'ACCESS' AS event_type_ FROM events UNION ALL
  SELECT *, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END FROM events)"""

# ---- key and term rules ------------------------------------------------------------------------------------


def _any(value: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


_KEYS = f"WITH k AS (SELECT p_partkey, {q.KEY_SQL} AS key, {q.KEY_VALUE_SQL} AS value FROM part)"
ORACLE["key_is_identifier"] = (
    f"{_KEYS} SELECT p_partkey, key, {_any('lower(key)', vocab.IDENTIFIER_KEY_WORDS)} AND NOT "
    f"{_any('lower(key)', vocab.PROVIDER_KEY_WORDS)} AS yes FROM k")
_IP_KEY = f"WHEN regexp_matches(lower(key), '{vocab.IP_KEY_PATTERN}') THEN 'IP_ADDRESS'"


def _chain(table, not_named: list[str]) -> str:
    return (f"WHEN contains(lower(key), 'name') AND NOT {_any('lower(key)', not_named)} THEN 'NAME' {_IP_KEY} "
            + " ".join(f"WHEN {_any('lower(key)', w)} THEN '{t}'" for t, w in table))


_BY_KEY = f"CASE {_chain(vocab.KEY_TYPES, ['provider', 'doctor', 'physician'])} ELSE 'OTHER' END"
ORACLE["key_type"] = f"{_KEYS} SELECT p_partkey, key, {_BY_KEY} AS type FROM k"
ORACLE["key_value_type"] = f"""{_KEYS} SELECT p_partkey, key, CASE
  {_chain(vocab.FIELD_TYPES, ['provider', 'doctor'])}
  WHEN contains(lower(key), 'trial') AND {_any('lower(value)', vocab.TRIAL_VALUE_WORDS)}
  THEN 'CLINICAL_TRIAL_ID' ELSE {_BY_KEY} END AS type FROM k"""
ORACLE["is_medical"] = f"SELECT doc_id, {_any('lower(text)', vocab.MEDICAL_KEYWORDS)} AS yes FROM documents"
ORACLE["is_provider"] = f"SELECT doc_id, {_any('text', vocab.PROVIDER_TITLES)} AS yes FROM documents"
ORACLE["should_preserve"] = (
    f"SELECT conv_id, turn, {_any('lower(text)', vocab.MEDICAL_KEYWORDS)} OR "
    f"{_any('text', vocab.PROVIDER_TITLES)} AS yes FROM conversations")

# ---- stores --------------------------------------------------------------------------------------------------

REG = ("reg AS (SELECT 'known-' || CAST(c_custkey AS VARCHAR) AS uuid, 'cust-' || CAST(c_custkey AS VARCHAR) "
       "AS identity FROM customer WHERE c_mktsegment <> 'BUILDING')")
WANT = f"want AS (SELECT DISTINCT {d.IDENTITY} AS identity FROM orders)"
MAPS = f"""maps AS (SELECT 'known-' || CAST(o_custkey AS VARCHAR) AS uuid, CASE o_orderkey % 5 WHEN 0 THEN
  'PHONE_NUMBER' WHEN 1 THEN 'ZIP' WHEN 2 THEN 'DATE' WHEN 3 THEN 'NAME' ELSE 'JSON_STRUCTURE' END AS pii_type,
  CASE o_orderkey % 5 WHEN 0 THEN {d.PHONE} WHEN 1 THEN {d.ZIP} WHEN 2 THEN {d.DATE} WHEN 3 THEN {d.LAST}
  ELSE '{{}}' END AS original, 'F' || CAST(o_orderkey % 3 AS VARCHAR) AS fake, o_orderdate AS created_at,
  o_orderkey AS ord FROM orders)"""
HIST = ("hist AS (SELECT 'known-' || CAST(user_id AS VARCHAR) AS uuid, " + q.METHOD_SQL +
        " AS method, ts AS created_at, event_id FROM events)")
HIPAA = ", ".join(f"'{t}'" for t in vocab.HIPAA_TYPES)

ORACLE["identity_registry"] = f"""WITH {REG}, {WANT} SELECT coalesce(r.uuid, {o.uuid('w.identity',
    repr('CUSTOMER'))}) AS uuid, w.identity, 'CUSTOMER' AS identity_type, r.uuid IS NULL AS is_new
FROM want w LEFT JOIN reg r USING (identity)"""
ORACLE["identity_mappings"] = f"""WITH {REG}, {WANT}, {MAPS} SELECT identity, uuid, pii_type, original, fake
FROM maps JOIN reg USING (uuid) WHERE identity IN (SELECT identity FROM want)"""
_DEDUP = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid, pii_type, original
  ORDER BY ord) AS rn FROM maps) WHERE rn = 1)"""
ORACLE["dedup_mappings"] = f"WITH {MAPS}, {_DEDUP} SELECT uuid, pii_type, original, fake, ord FROM first"
ORACLE["mapping_upsert"] = f"""WITH {MAPS}, {_DEDUP} SELECT uuid, pii_type, original, fake, ord FROM first f
WHERE NOT EXISTS (SELECT 1 FROM maps s WHERE s.created_at < TIMESTAMP '1996-01-01' AND s.uuid = f.uuid
  AND s.pii_type = f.pii_type AND s.original = f.original)"""
ORACLE["mapping_lookup_pruned"] = f"""WITH {MAPS}, {_DEDUP} SELECT uuid, pii_type, original, fake FROM first
WHERE uuid IN (SELECT 'known-' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 9900)"""
ORACLE["stats_by_type"] = f"""WITH {MAPS}, m AS (SELECT * FROM maps WHERE pii_type IN ({HIPAA}))
SELECT uuid, pii_type, count(*) AS entities, CAST(0 AS INT) AS level FROM m GROUP BY uuid, pii_type
UNION ALL SELECT uuid, NULL, count(*), 1 FROM m GROUP BY uuid UNION ALL SELECT NULL, NULL, count(*), 2 FROM m"""
ORACLE["stats_by_method"] = (f"WITH {HIST} SELECT uuid, method, count(*) AS operations FROM hist "
                             "GROUP BY uuid, method")
_ANON = ", ".join(f"'{m}'" for m in vocab.ANONYMIZE_METHODS)
_BACK = ", ".join(f"'{m}'" for m in vocab.RESTORE_METHODS)
ORACLE["stats_summary"] = f"""WITH {MAPS}, {HIST} SELECT
  (SELECT count(*) FROM maps WHERE pii_type IN ({HIPAA})) AS total_entities,
  (SELECT count(DISTINCT pii_type) FROM maps WHERE pii_type IN ({HIPAA})) AS unique_entity_types,
  count(*) FILTER (method IN ({_ANON})) AS anonymizations,
  count(*) FILTER (method IN ({_BACK})) AS de_anonymizations,
  count(*) FILTER (method = 'ANONYMIZE_PROFILE') AS profile_anonymizations,
  count(*) FILTER (method = 'DE_ANONYMIZE_PROFILE') AS profile_de_anonymizations FROM hist"""


def _json_counts(source: str, label: str) -> str:
    return (f"SELECT uuid, '{{' || string_agg('\"' || {label} || '\":' || CAST(n AS VARCHAR), ',' ORDER BY "
            f"{label}) || '}}' AS j, CAST(sum(n) AS BIGINT) AS t FROM (SELECT uuid, {label}, count(*) AS n "
            f"FROM {source} GROUP BY uuid, {label}) GROUP BY uuid")


ORACLE["user_summary"] = f"""WITH {REG}, {WANT}, {MAPS}, {HIST}, e AS ({_json_counts('maps', 'pii_type')}),
p AS ({_json_counts('hist', 'method')}), a AS (SELECT uuid, min(created_at) AS first_activity,
  max(created_at) AS last_activity FROM hist GROUP BY uuid)
SELECT w.identity, r.uuid, CASE WHEN r.uuid IS NOT NULL THEN coalesce(e.j, '{{}}') END AS entities,
  CASE WHEN r.uuid IS NOT NULL THEN coalesce(p.j, '{{}}') END AS operations, first_activity, last_activity,
  CASE WHEN r.uuid IS NOT NULL THEN coalesce(e.t, 0) END AS total_entities,
  CASE WHEN r.uuid IS NOT NULL THEN coalesce(p.t, 0) END AS total_operations,
  CASE WHEN r.uuid IS NULL THEN 'User not found' END AS error
FROM want w LEFT JOIN reg r USING (identity) LEFT JOIN e ON e.uuid = r.uuid LEFT JOIN p ON p.uuid = r.uuid
LEFT JOIN a ON a.uuid = r.uuid"""
_CUT = "TIMESTAMP '1999-01-01' - INTERVAL 365 DAY"
ORACLE["retention_keep"] = (f"SELECT o_orderkey, o_orderdate AS created_at FROM orders "
                            f"WHERE o_orderdate >= {_CUT}")
ORACLE["cleanup_counts"] = f"""WITH {REG}, {MAPS} SELECT
  (SELECT count(*) FROM orders WHERE o_orderdate < {_CUT}) AS data_records_deleted,
  (SELECT count(*) FROM maps WHERE uuid NOT IN (SELECT uuid FROM reg)) AS entity_records_deleted"""
ORACLE["orphan_mappings"] = f"""WITH {REG}, {MAPS} SELECT uuid, pii_type, original, ord FROM maps
WHERE uuid NOT IN (SELECT uuid FROM reg)"""
ORACLE["erase_identity"] = f"""WITH {MAPS}, {HIST}, gone AS (SELECT 'known-' || CAST(c_custkey AS VARCHAR) AS
  uuid FROM customer WHERE c_acctbal < 0)
SELECT 'mappings' AS store, uuid, ord AS id FROM maps WHERE uuid NOT IN (SELECT uuid FROM gone)
UNION ALL SELECT 'history', uuid, event_id FROM hist WHERE uuid NOT IN (SELECT uuid FROM gone)"""
ORACLE["erase_stored"] = f"""WITH {MAPS}, {_DEDUP}, {HIST}, gone AS (SELECT 'known-' || CAST(c_custkey AS VARCHAR) AS
  uuid FROM customer WHERE c_acctbal < 0)
SELECT 'mappings' AS store, uuid, original AS id FROM first WHERE uuid NOT IN (SELECT uuid FROM gone)
UNION ALL SELECT 'history', uuid, CAST(event_id AS VARCHAR) FROM hist WHERE uuid NOT IN (SELECT uuid FROM gone)"""
ORACLE["cleanup_stored"] = f"""WITH {REG}, {MAPS}, {_DEDUP}, {HIST}
SELECT 'mappings' AS store, uuid, original AS id FROM first WHERE uuid IN (SELECT uuid FROM reg)
UNION ALL SELECT 'history', uuid, CAST(event_id AS VARCHAR) FROM hist
  WHERE created_at >= (SELECT max(created_at) FROM hist) - INTERVAL 7 DAY"""
ORACLE["fake_collisions"] = f"""WITH {MAPS} SELECT uuid, fake, count(DISTINCT original) AS originals FROM maps
GROUP BY uuid, fake HAVING count(DISTINCT original) > 1"""

# ---- checks and streams -----------------------------------------------------------------------------------------

ORACLE["leak_check"] = f"""{_full(o.NOTES)} SELECT DISTINCT k.doc_id, k.type, k.original FROM kept k
JOIN done USING (doc_id) WHERE k.type <> 'AGE' AND contains(done.anonymized, k.original) AND regexp_matches(
  regexp_replace(regexp_replace(done.anonymized, '{o.PROVIDERS[0][5]}', ' ', 'g'), '{o.PROVIDERS[1][5]}', ' ', 'g'),
  '(^|[^A-Za-z0-9])' || regexp_escape(k.original) || '($|[^A-Za-z0-9])')"""
_BLANKED = (f"regexp_replace(regexp_replace(anonymized, '{o.PROVIDERS[0][5]}', ' ', 'g'), '{o.PROVIDERS[1][5]}', ' ', 'g')")
ORACLE["leak_planted"] = f"""{_full(o.NOTES)}, plant AS (""" + " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, '{t}' AS type, {v} AS original FROM orders" for t, v in q.PLANTED) + f""")
SELECT doc_id, type, original FROM plant JOIN done USING (doc_id) WHERE contains({_BLANKED}, original)"""
_TERMS = ", ".join(f"('{t}')" for t in q.KEPT_TERMS)
ORACLE["preservation_check"] = f"""{_full(o.NOTES)} SELECT term, count(*) AS texts,
  count(*) FILTER (contains(anonymized, term)) AS kept FROM done JOIN (VALUES {_TERMS}) v(term)
  ON contains(text, term) GROUP BY term"""
ORACLE["roundtrip_check"] = "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS failed FROM documents"
_ALARMS = """SELECT make_timestamp(300000000 * (epoch_us(ts) // 300000000)) AS window_start,
  make_timestamp(300000000 * (epoch_us(ts) // 300000000) + 300000000) AS window_end, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY epoch_us(ts) // 300000000 HAVING count(*) >= 2"""
ORACLE["alarm_errors"] = _ALARMS
ORACLE["alarm_errors_default"] = _ALARMS.replace(">= 2", ">= 5")
ORACLE["lost_terms"] = f"""{_full(o.NOTES)} SELECT doc_id, term FROM done JOIN (VALUES {_TERMS}) v(term)
  ON contains(text, term) AND NOT contains(anonymized, term)"""
ORACLE["roundtrip_records"] = """SELECT 'notes' AS kind, count(*) AS texts, CAST(0 AS BIGINT) AS failed FROM orders
UNION ALL SELECT 'json', count(*), 0 FROM orders"""
ORACLE["separate_collisions"] = f"""WITH {MAPS}, {_DEDUP} SELECT count(*) AS mappings, CAST(0 AS BIGINT) AS collisions
FROM first WHERE pii_type IN ('PHONE_NUMBER', 'NAME')"""
ORACLE["stats_by_method_all"] = f"WITH {HIST} SELECT method, count(*) AS operations FROM hist GROUP BY method"
ORACLE["stream_alarms"] = _ALARMS
ORACLE["alarm_unauthorised"] = _ALARMS.replace("300000000", "60000000").replace(">= 2", ">= 1")
ORACLE["stream_anonymize"] = f"{_full(o.DOCS)} SELECT doc_id, anonymized, entities_detected FROM done"
ORACLE["stream_anonymize_stored"] = ORACLE["anonymize_text"]
ORACLE["stream_mappings"] = f"""{_with(o.DOCS, o.candidate_ctes('src'), o.resolved_ctes(), o.faked_ctes('src'))}
SELECT DISTINCT uuid, type AS pii_type, original, fake FROM faked"""
