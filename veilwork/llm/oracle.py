"""SQL for the queries that it can express; DuckDB's dialect."""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP7 = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
pos AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM rows_),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), {_LOWER}) AS k FROM pos),
first_ AS (SELECT k, min(doc_id) AS d FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT q.*, f.d IS NOT NULL AND q.doc_id > f.d AS gone FROM keyed q LEFT JOIN first_ f USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

_NIBBLE = " ".join(f"WHEN '{k:x}' THEN '{k:04b}'" for k in range(16))
_FIVE = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))
OP8 = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, replace(url, ' ', '%20') AS url, coalesce(html, '') AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(string_split(sha1(h), ''), lambda c: CASE c {_NIBBLE} END), 'string_agg', '')
  AS bits, max(page_id) OVER (PARTITION BY h) AS most FROM p)
SELECT page_id, url, octet_length(encode(h)) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < most THEN most END AS refers_to FROM b
"""

#: CRC-32 of a word's bytes by the byte-wise table of its polynomial.
_CRC_TABLE = ("list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 "
              "THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k))")
OP11 = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
doc AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), {_LOWER}) AS x FROM documents),
goal AS (SELECT translate(coalesce(text, ''), {_LOWER}) AS x FROM benchmark),
dw AS (SELECT r, unnest(regexp_extract_all(x, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM doc),
gw AS (SELECT unnest(regexp_extract_all(x, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM goal),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
bucketed AS (SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS b FROM hexed, tab),
raw AS (SELECT b, count(*) AS n FROM dw JOIN bucketed USING (w) GROUP BY b),
aim AS (SELECT b, count(*) AS n FROM gw JOIN bucketed USING (w) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(n) FROM raw), 0) AS s, coalesce((SELECT sum(n) FROM aim), 0) AS t),
gain AS (SELECT raw.b, CAST(floor(1000 * ln(CAST((coalesce(aim.n, 0) + 1) * (s + 10000) AS DOUBLE)
  / CAST((raw.n + 1) * (t + 10000) AS DOUBLE))) AS BIGINT) AS g FROM raw LEFT JOIN aim USING (b), total),
weighed AS (SELECT r, count(*) AS n, sum(g) AS g FROM dw JOIN bucketed USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(g AS DOUBLE) / n), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
    / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS e FROM doc LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY weight + e DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + e AS score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

_SHARE = "1 + (1000000000::HUGEINT * ({0} + 5)) // ({1} + 5 * v)"
OP12 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), {_LOWER}) AS x FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS lang_n FROM (SELECT DISTINCT lang FROM doc) LEFT JOIN kept USING (lang) GROUP BY lang),
cell AS (SELECT lang, source, term, count(*) AS c FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN cell USING (lang, source) GROUP BY lang, source),
dense AS (SELECT lang, source, term, coalesce(cell.c, 0) AS c, {_SHARE.format("coalesce(cell.c, 0)", "n")} AS p,
  {_SHARE.format("kept.c", "lang_n")} AS q
  FROM grp JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cell USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM dense a JOIN dense b USING (lang, term)
  WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f FROM grp a JOIN grp b USING (lang)
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source WHERE a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS f FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS k
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(k AS INT) AS rank FROM ranked WHERE part = 'pair' OR k <= 50
"""

ORACLE = {"op11_importance_resampling": OP11, "op12_source_divergence": OP12, "op7_line_dedup": OP7, "op8_warc_archive": OP8}
