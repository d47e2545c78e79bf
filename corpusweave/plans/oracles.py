"""The same results in DuckDB SQL over the given tables, written independently.

Only the fixed prompt wording and slot values are shared with the operators:
units, links, numerals, chunks and reports are worked out from the raw columns.
"""

from __future__ import annotations

import textwrap

from corpusweave.dimensions import ORACH_CHAYIM, YOREH_DEAH
from corpusweave.functions import templates

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_WS = _WS.replace("[", "[^", 1)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lit(text: str) -> str:
    """SQL expression for a text that may hold newlines."""
    return " || chr(10) || ".join(_q(t) for t in text.split("\n"))


def _clean(x: str) -> str:
    """Mark-up removal; covers the entities that occur in the given pages."""
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _letters(n: str) -> str:
    """Numeral without marks, by list lookup."""
    return f"""(CASE WHEN {n} BETWEEN 1 AND 999 THEN
        ['', 'ק', 'ר', 'ש', 'ת', 'תק', 'תר', 'תש', 'תת', 'תתק'][{n} // 100 + 1] ||
        CASE {n} % 100 WHEN 15 THEN 'טו' WHEN 16 THEN 'טז' ELSE
          ['', 'י', 'כ', 'ל', 'מ', 'נ', 'ס', 'ע', 'פ', 'צ'][({n} % 100) // 10 + 1] ||
          ['', 'א', 'ב', 'ג', 'ד', 'ה', 'ו', 'ז', 'ח', 'ט'][{n} % 10 + 1] END END)"""


def _numeral(n: str) -> str:
    g = _letters(n)
    return f"""(CASE WHEN length({g}) = 1 THEN {g} || chr(39)
        ELSE left({g}, length({g}) - 1) || '"' || right({g}, 1) END)"""


_YD, _OC = _q(YOREH_DEAH.key), _q(ORACH_CHAYIM.key)
_CORPUS = f"CASE WHEN lang IN ('en', 'fr') THEN {_YD} ELSE {_OC} END"

# --- sections and links of the audit ----------------------------------------

_SECTIONS = f"""
  docs AS (
    SELECT doc_id AS unit, {_CORPUS} AS corpus, source,
           list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines
    FROM documents),
  sections AS (
    SELECT unit, corpus, source, unnest(range(1, len(lines) + 1)) AS section,
           unnest(lines) AS line
    FROM docs)"""

_LINK_ROWS = f"""
  link_rows AS (
    SELECT o_orderkey, o_custkey AS unit, CAST(month(o_orderdate) AS INT) AS section,
           o_orderstatus AS status,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {_YD} ELSE {_OC} END AS corpus,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Shach' WHEN '2-HIGH' THEN 'Taz'
             WHEN '3-MEDIUM' THEN 'Magen Avraham' WHEN '4-NOT SPECIFIED' THEN 'Mishna Berura'
             ELSE 'Taz' END AS authority,
           CASE o_orderpriority
             WHEN '1-URGENT' THEN 'Siftei Kohen on Shulchan Arukh, Yoreh De''ah'
             WHEN '2-HIGH' THEN 'Turei Zahav on Shulchan Arukh, Yoreh De''ah'
             WHEN '3-MEDIUM' THEN 'Magen Avraham'
             WHEN '4-NOT SPECIFIED' THEN 'Mishnah Berurah'
             ELSE 'Turei Zahav on Shulchan Arukh, Orach Chayim' END AS title
    FROM orders)"""

_REQUIRED = """
  required AS (
    SELECT corpus, unit, section, 'Mechaber' AS authority FROM sections
    UNION
    SELECT corpus, unit, section, 'Rema' FROM sections WHERE contains(line, 'en')
    UNION
    SELECT l.corpus, l.unit, l.section, l.authority
    FROM link_rows l JOIN sections s USING (corpus, unit, section)
    WHERE l.status IN ('F', 'O'))"""

_COUNTED = """
  counted AS (
    SELECT r.corpus, r.unit, r.section, r.authority, left(md5(s.line), 1) > '3' AS has_block,
           len(regexp_extract_all(s.line, '(?i)' || CASE r.authority
             WHEN 'Mechaber' THEN '(tion|ing|ung)' WHEN 'Rema' THEN '(ou|and|die)'
             WHEN 'Shach' THEN '(wh|pa)' WHEN 'Taz' THEN '(er the|lle|lich)'
             WHEN 'Magen Avraham' THEN '(sch|os)' ELSE '(keit|ent)' END)) AS n
    FROM required r JOIN sections s USING (corpus, unit, section)),
  per_section AS (
    SELECT corpus, unit, section, has_block,
           CASE WHEN has_block THEN count(*) FILTER (WHERE n = 0) ELSE 1 END AS flags,
           string_agg(authority, ', ' ORDER BY authority) AS names,
           string_agg('    - ' || rpad(authority, CAST(greatest(12, length(authority)) AS INT), ' ') || ': '
             || rpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), ' ')
             || ' mentions ' || CASE WHEN n > 0 THEN '[PASS]' ELSE '[WARN] (Missing!)' END,
             chr(10) ORDER BY authority) AS mentions
    FROM counted GROUP BY corpus, unit, section, has_block),
  whole AS (
    SELECT d.corpus, d.unit,
           coalesce(sum(len(regexp_extract_all(s.line, '(?i)(with|avec|mit)'))), 0) AS tur,
           coalesce(sum(len(regexp_extract_all(s.line, '(?i)(from|pour|von|para)'))), 0) AS beit
    FROM docs d LEFT JOIN sections s ON s.unit = d.unit AND left(md5(s.line), 1) > '3'
    GROUP BY d.corpus, d.unit),
  audited AS (
    SELECT w.corpus, w.unit, count(p.section) AS n_sections,
           coalesce(sum(p.flags), 0) AS local_flags,
           (CASE WHEN any_value(w.tur) > 0 THEN 0 ELSE 1 END)
             + (CASE WHEN any_value(w.beit) > 0 THEN 0 ELSE 1 END) AS general_flags,
           any_value(w.tur) AS tur, any_value(w.beit) AS beit,
           list(p.section ORDER BY p.section) FILTER (WHERE NOT p.has_block) AS missing
    FROM whole w LEFT JOIN per_section p USING (corpus, unit)
    GROUP BY corpus, unit)"""

_AUDIT = f"WITH {_SECTIONS},{_LINK_ROWS},{_REQUIRED},{_COUNTED}"

_MENTION = (
    "'  - ' || rpad('{name}', 12, ' ') || ': ' || rpad(CAST({col} AS VARCHAR),"
    " CAST(greatest(3, length(CAST({col} AS VARCHAR))) AS INT), ' ') || ' mentions ' ||"
    " CASE WHEN {col} > 0 THEN '[PASS]' ELSE '[WARN] (Missing from entire draft!)' END"
)

_REPORT = f"""{_AUDIT},
  bodies AS (
    SELECT corpus, unit, string_agg(
      chr(10) || '[סעיף ' || {_letters('section')} || '] (Se''if ' || section || ')' || chr(10) ||
      CASE WHEN has_block
        THEN '  Commentators active in the library source: ' || names || chr(10) || mentions
        ELSE '  ⚠️ Draft has no section block for this Se''if!' END,
      chr(10) ORDER BY section) AS body
    FROM per_section GROUP BY ALL),
  n_links AS (SELECT corpus, unit, count(*) AS n FROM link_rows GROUP BY ALL)
SELECT unit, CASE WHEN n_sections = 0
    THEN 'Error: Shulchan Arukh text was not found for this Siman in the library.'
  ELSE concat_ws(chr(10),
    repeat('=', 60), '      LOCALIZED HEURISTIC EVALUATION FOR SIMAN ' || unit,
    repeat('=', 60) || chr(10), 'Fetching raw Hebrew sources from the library API...',
    'Fetched ' || coalesce(n, 0) || ' cross-reference links from the library.',
    'Fetch complete.' || chr(10),
    '--- SE''IF-BY-SE''IF LOCALIZED COMMENTATOR COVERAGE CHECK ---', body,
    chr(10) || '--- GENERAL DRAFT COVERAGE CHECK ---',
    {_MENTION.format(name="Tur", col="tur")}, {_MENTION.format(name="Beit Yosef", col="beit")},
    chr(10) || repeat('=', 60), '--- FINAL SUMMARY REPORT ---',
    'Total Localized Omission Flags: ' || local_flags,
    'Total General Omission Flags:   ' || general_flags,
    CASE WHEN len(missing) > 0 THEN
      'Missing Se''ifim blocks:        [' || array_to_string(missing, ', ') || ']' END,
    CASE WHEN local_flags + general_flags = 0
      THEN 'Status: EXCELLENT (100% Localized Heuristic Coverage Pass)'
      ELSE 'Status: WARNING (' || (local_flags + general_flags) || ' issues identified)' || chr(10)
        || 'Action: Please review the flagged items where active commentators were not mentioned '
        || 'in their corresponding Se''if draft block or globally.' END,
    repeat('=', 60)) END AS report
FROM audited LEFT JOIN bodies USING (corpus, unit) LEFT JOIN n_links USING (corpus, unit)"""

# --- conversations as segments ----------------------------------------------

_SEGMENTS = f"""
  segs AS (
    SELECT conv_id AS unit, turn, text,
           CASE role WHEN 'user' THEN 'Shulchan Arukh' WHEN 'system' THEN 'Tur' ELSE 'Taz' END
             AS work,
           CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 3 ELSE 5 END AS work_ord
    FROM conversations),
  convs AS (
    SELECT conv_id AS unit, conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_target,
           CASE WHEN conv_id % 2 = 0 THEN {_YD} ELSE {_OC} END AS corpus
    FROM (SELECT DISTINCT conv_id FROM conversations))"""

_CONTEXT = f"""{_SEGMENTS},
  numbered AS (
    SELECT unit, work, work_ord,
           row_number() OVER (PARTITION BY unit, work ORDER BY turn) AS i, text
    FROM segs JOIN convs USING (unit)
    WHERE text <> '' AND (is_target OR work <> 'Taz')),
  contexts AS (
    SELECT c.unit, any_value(c.is_target) AS is_target,
      repeat(chr(10), 2) || repeat('=', 41) || chr(10) || '=== סימן ' || c.unit || ' ===' ||
      chr(10) || repeat('=', 41) || repeat(chr(10), 2) || coalesce(string_agg(
        CASE WHEN i = 1 THEN '--- ' || work || ' (סימן ' || c.unit || ') ---' ||
          repeat(chr(10), 2) ELSE '' END || '[' || i || '] ' || text || repeat(chr(10), 2),
        '' ORDER BY work_ord, i), '') AS text
    FROM convs c LEFT JOIN numbered n ON n.unit = c.unit GROUP BY c.unit)"""


_CONTEXT_PARTS = f"""{_CONTEXT},
  pieces AS (
    SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY work_ord, i) AS n, text,
      CASE WHEN i = 1 THEN '--- ' || work || ' (סימן ' || unit || ') ---' || repeat(chr(10), 2) ELSE '' END
        || '[' || i || '] ' || text || repeat(chr(10), 2) AS piece
    FROM numbered),
  stretched AS (
    SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY unit ORDER BY n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1500 AS stretch FROM pieces),
  dealt AS (
    SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY stretch) AS part FROM stretched),
  bodies AS (
    SELECT unit, part, string_agg(piece, '' ORDER BY n) AS body,
      max(part) OVER (PARTITION BY unit) AS parts
    FROM dealt GROUP BY unit, part),
  parts AS (
    SELECT c.unit, CAST(coalesce(part, 1) AS INT) AS part_no, CAST(coalesce(parts, 1) AS INT) AS n_parts,
      CASE WHEN coalesce(part, 1) = 1 THEN repeat(chr(10), 2) || repeat('=', 41) || chr(10) || '=== סימן '
        || c.unit || ' ===' || chr(10) || repeat('=', 41) || repeat(chr(10), 2) ELSE '' END
        || coalesce(body, '') AS text
    FROM convs c LEFT JOIN bodies b ON b.unit = c.unit)"""


def _opening(unit: str) -> str:
    first, rest = templates.DRAFT_REQUIREMENTS.split("{authorities}")
    head, tail = rest.split("{numeral}")
    names = [_q(c.slots["prompt_commentators_desc"]) for c in (YOREH_DEAH, ORACH_CHAYIM)]
    authorities = f"CASE WHEN {unit} % 2 = 0 THEN {names[0]} ELSE {names[1]} END"
    return f"{_lit(first)} || {authorities} || {_lit(head)} || {_numeral(unit)} || {_lit(tail)}"


def _closing(unit: str) -> str:
    head, tail = templates.DRAFT_CLOSING.split("{numeral}")
    return f"{_lit(head)} || {_numeral(unit)} || {_lit(tail)}"


def _prompt(unit: str, context: str) -> str:
    return f"{_opening(unit)} || {context} || {_closing(unit)}"


# --- requests ---------------------------------------------------------------

_ORDER_UNITS = """
  specs AS (
    SELECT o_orderkey, o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders),
  targets AS (
    SELECT o_orderkey, s, k, CASE p WHEN '1-URGENT' THEN [k]
      WHEN '2-HIGH' THEN range(k, k + 10)
      WHEN '3-MEDIUM' THEN [k, k + 7] ELSE [k, k + 1, k + 2] END AS targets
    FROM specs WHERE p <> '4-NOT SPECIFIED' AND k > 0)"""

# units unit by unit and back to intervals
_LONG_REQUESTS = """WHERE o_orderkey % 5000 <> 3
    UNION ALL
    SELECT o_orderkey, o_orderstatus, o_custkey, unnest(list_concat([5], range(7, 10000007)))
    FROM orders WHERE o_orderkey % 5000 = 3"""


def _units_of(more: str) -> str:
    return f"""{_ORDER_UNITS},
  asked AS (
    SELECT o_orderkey, s, k, unnest(targets) AS u FROM targets {more}),
  extra AS (
    SELECT DISTINCT o_orderkey, unnest(CASE s WHEN 'O' THEN range(k + 1, k + 5)
      WHEN 'P' THEN [k + 2, k + 20, k + 21, k + 22] ELSE [] END) AS u FROM asked),
  whole AS (SELECT o_orderkey, u FROM asked UNION SELECT o_orderkey, u FROM extra),
  placed AS (
    SELECT o_orderkey, s, u, row_number() OVER (PARTITION BY o_orderkey ORDER BY u) AS n FROM asked),
  limited AS (
    SELECT o_orderkey, u FROM placed
    WHERE s NOT IN ('O', 'P') OR n <= CASE s WHEN 'O' THEN 1 ELSE 2 END)"""


_REQUEST_UNITS = _units_of(_LONG_REQUESTS)


def _islands(table: str) -> str:
    return f"""
  islands AS (
    SELECT o_orderkey, min(u) AS lo, max(u) AS hi, count(*) AS n FROM (
      SELECT o_orderkey, u, u - row_number() OVER (PARTITION BY o_orderkey ORDER BY u) AS g
      FROM {table}) GROUP BY o_orderkey, g),
  shown AS (
    SELECT *, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END AS part
    FROM islands)"""


_CUSTOMER_RELATIONS = """
  relations AS (
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS relations
    FROM customer WHERE c_mktsegment <> 'BUILDING'),
  requests AS (
    SELECT c_custkey, c_mktsegment, c_custkey AS lo, c_custkey % 5000 = 7 AS long,
      CASE WHEN c_custkey % 5000 = 7 THEN c_custkey + 9999999 ELSE c_custkey END AS target_hi,
      CASE WHEN c_custkey % 5000 = 7 THEN c_custkey + 9999999 ELSE c_custkey + 2 END AS context_hi
    FROM customer WHERE c_custkey > 0)"""

# --- chunks -----------------------------------------------------------------


def _chunks(limit: int) -> str:
    """Greedy packing as a fold over the pieces of a document."""
    acc = "STRUCT(d VARCHAR[], o VARCHAR, n BIGINT, t VARCHAR, c BIGINT, f BOOLEAN)"
    return f"""
  paragraphs AS (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
      lambda p: regexp_replace(p, '^{_WS}+|{_WS}+$', '', 'g')), lambda p: p <> '') AS ps, text
    FROM documents),
  pieces AS (
    SELECT doc_id, text, flatten(list_transform(ps, lambda p:
      CASE WHEN length(p) <= {limit} THEN [{{'t': p, 'c': 2, 'f': false}}]
      ELSE list_transform(flatten(list_transform(
          string_split(regexp_replace(p, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)),
          lambda s: CASE WHEN length(s) > {limit} THEN string_split(s, ' ') ELSE [s] END)),
        lambda b, i: {{'t': b, 'c': 1, 'f': i = 1}}) END)) AS ps
    FROM paragraphs),
  packed AS (
    SELECT doc_id, text, list_reduce(
      list_transform(ps, lambda x: CAST({{'d': []::VARCHAR[], 'o': NULL, 'n': 0,
        't': x.t, 'c': x.c, 'f': x.f}} AS {acc})),
      lambda a, x: CASE
        WHEN x.f AND a.o IS NOT NULL THEN CASE
          WHEN length(x.t) + x.c > {limit} THEN {{'d': list_concat(a.d, [a.o, '']), 'o': x.t,
            'n': length(x.t), 't': '', 'c': 0, 'f': false}}
          ELSE {{'d': list_append(a.d, a.o), 'o': x.t, 'n': length(x.t) + x.c,
            't': '', 'c': 0, 'f': false}} END
        WHEN a.n + length(x.t) + x.c > {limit} THEN {{'d': list_append(a.d, coalesce(a.o, '')),
          'o': x.t, 'n': length(x.t), 't': '', 'c': 0, 'f': false}}
        ELSE {{'d': a.d, 'o': CASE WHEN a.o IS NULL THEN x.t
            ELSE a.o || chr(10) || chr(10) || x.t END,
          'n': a.n + length(x.t) + x.c, 't': '', 'c': 0, 'f': false}} END,
      CAST({{'d': []::VARCHAR[], 'o': NULL, 'n': 0, 't': '', 'c': 0, 'f': false}} AS {acc})) AS r
    FROM pieces),
  chunk_lists AS (
    SELECT doc_id, CASE WHEN length(text) <= {limit} THEN [text]
      WHEN r.o IS NULL THEN r.d ELSE list_append(r.d, r.o) END AS chunks
    FROM packed)"""


# --- batch results ----------------------------------------------------------

_FIRST_RESULT = """
  usable AS (
    SELECT 'siman_' || conv_id || '_generation' AS custom_id, turn, text
    FROM conversations WHERE length(text) >= 40 AND role <> 'system' AND turn % 5 <> 3),
  first_results AS (
    SELECT custom_id, arg_min(text, turn) AS content FROM usable GROUP BY 1)"""

_ERRORS = """
  errors AS (
    SELECT conv_id, turn, CASE WHEN length(text) < 40 THEN 'broken line'
      WHEN role = 'system' THEN 'no content' WHEN turn % 5 = 3 THEN 'no custom id' END AS error
    FROM conversations)"""

_EVENT_NAME = "'Yoreh_Deah_Siman_' || user_id || '_gpt-5_2_' || event_type"

ORACLES = {
    "assemble_context": f"""WITH {_CONTEXT_PARTS}
SELECT unit, part_no, n_parts, text FROM parts""",
    "html_clean": f"""SELECT page_id, {_clean('html')} AS text,
  CAST(length({_clean('html')}) AS INT) AS n_chars FROM pages""",
    "nested_flatten": f"""
WITH bits AS (
  SELECT doc_id, flatten(list_transform(string_split(text, chr(10)),
    lambda l: string_split(l, '. '))) AS b FROM documents),
cleaned AS (
  SELECT doc_id, list_filter(list_transform(b, lambda x: {_clean('x')}),
    lambda x: x <> '') AS b FROM bits)
SELECT doc_id, CAST(unnest(range(1, len(b) + 1)) AS INT) AS seg_no, unnest(b) AS text
FROM cleaned""",
    "pick_version": """
SELECT doc_id, CAST(len(s) AS INT) AS n_segments, array_to_string(s, '|') AS text FROM (
  SELECT doc_id, CASE WHEN lang = 'en'
    THEN list_filter(string_split(text, chr(10)), lambda x: x <> '') ELSE [source] END AS s
  FROM documents)""",
    "first_user_turn": """
SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user'
GROUP BY conv_id HAVING arg_min(text, turn) <> ''""",
    "source_fallback": f"""
WITH p AS (SELECT page_id AS id, {_clean('html')} AS t FROM pages),
d AS (SELECT doc_id AS id, text AS t FROM documents),
c AS (SELECT conv_id * 97 AS id, text AS t FROM conversations WHERE turn = 0)
SELECT id,
  CASE WHEN coalesce(p.t, '') <> '' THEN 'primary' WHEN coalesce(d.t, '') <> '' THEN 'legacy'
    WHEN coalesce(c.t, '') <> '' THEN 'archive' ELSE 'none' END AS origin,
  coalesce(nullif(p.t, ''), nullif(d.t, ''), c.t, '') AS text
FROM p FULL JOIN d USING (id) FULL JOIN c USING (id)""",
    "fetch_sources": f"""
WITH w AS (
  SELECT doc_id, lang, source, {_CORPUS} AS corpus,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
works AS (
  SELECT {_YD} AS corpus, unnest(['Tur', 'Beit Yosef', 'Shulchan Arukh', 'Shach', 'Taz']) AS work
  UNION ALL
  SELECT {_OC}, unnest(['Tur', 'Beit Yosef', 'Shulchan Arukh', 'Magen Avraham', 'Taz',
    'Mishna Berura'])),
found AS (
  SELECT corpus, doc_id AS unit, work, CASE
    WHEN work = 'Tur' THEN [source, lang]
    WHEN work <> 'Shulchan Arukh' THEN []
    WHEN lang = 'en' AND len(lines) > 0 THEN list_transform(lines, lambda x: {_clean('x')})
    WHEN lang = 'en' THEN [source, lang]
    ELSE [source] END AS s
  FROM w JOIN works USING (corpus))
SELECT corpus, unit, work, CAST(len(s) AS INT) AS n_segments,
  coalesce(array_to_string(s, '|'), '') AS text FROM found""",
    "link_scan": f"""WITH {_LINK_ROWS},
ends AS (
  SELECT corpus, unit, status, 'Shulchan Arukh, ' || corpus || ' ' || unit || ':' || section AS b,
    title || ' ' || unit || ':' || section || ':1' AS o FROM link_rows WHERE status <> 'P')
SELECT corpus, unit, CASE status WHEN 'O' THEN o ELSE b END AS ref,
  CASE status WHEN 'O' THEN b ELSE o END AS anchor_ref, count(*) AS n FROM ends GROUP BY ALL""",
    "unit_sources": f"""WITH {_SEGMENTS},
works AS (
  SELECT {_YD} AS corpus, unnest(['Tur', 'Beit Yosef', 'Shulchan Arukh', 'Shach', 'Taz']) AS work
  UNION ALL
  SELECT {_OC}, unnest(['Tur', 'Beit Yosef', 'Shulchan Arukh', 'Magen Avraham', 'Taz',
    'Mishna Berura']))
SELECT c.unit, w.work, count(s.turn) AS n_segments, count(s.turn) = 0 AS is_missing
FROM convs c JOIN works w USING (corpus)
LEFT JOIN segs s ON s.unit = c.unit AND s.work = w.work AND s.text <> '' GROUP BY ALL""",
    "work_dim_join": f"""WITH {_SEGMENTS}
SELECT unit, turn AS position, work, CAST(work_ord AS BIGINT) AS work_ord,
  work IN ('Tur', 'Shulchan Arukh') AS is_core FROM segs""",
    "role_pruned_sources": f"""WITH {_SEGMENTS}
SELECT unit, work, turn AS position, is_target FROM segs JOIN convs USING (unit)
WHERE is_target OR work IN ('Tur', 'Shulchan Arukh')""",
    "segment_numbers": f"""WITH {_SEGMENTS}
SELECT unit, work, turn * 1000003000 AS position,
  row_number() OVER (PARTITION BY unit, work ORDER BY turn) AS seg_no
FROM segs WHERE text <> ''""",
    "segment_paths": f"""WITH {_SEGMENTS}
SELECT corpus, unit || '.' || turn // 4 || '.' || (turn // 2) % 2 AS path,
  row_number() OVER (PARTITION BY corpus ORDER BY unit, turn) AS seg_no
FROM segs JOIN convs USING (unit) WHERE text <> ''""",
    "artefact_scan": """
SELECT doc_id, 'Yoreh_Deah' AS slug, 'gpt-5_2' AS model, 'draft' AS kind, CAST(NULL AS VARCHAR) AS saved, text
FROM documents
UNION ALL
SELECT doc_id, 'Yoreh_Deah', 'gpt-5_2', 'draft',
  '2024-05-01 00:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), text
FROM documents WHERE lang = 'en'""",
    "relations_scan": f"""WITH {_units_of('')},{_islands('whole')},
keys AS (SELECT o_orderkey, string_agg(part, '_' ORDER BY lo) AS range_key FROM shown GROUP BY 1)
SELECT 'Yoreh_Deah' AS slug, range_key, 'o1_x' AS model, 'of ' || min(o_orderkey) AS text
FROM keys GROUP BY range_key""",
    "context_files": f"""WITH {_CONTEXT_PARTS} SELECT unit, part_no, text FROM parts""",
    "request_files": f"""WITH {_CONTEXT}
SELECT 'siman_' || unit || '_generation' AS custom_id, 'POST' AS method, 'gpt-5.2' AS model,
  {_prompt('unit', 'text')} AS prompt
FROM contexts WHERE unit BETWEEN 1 AND 999""",
    "ranges_expand": f"""WITH {_ORDER_UNITS}
SELECT o_orderkey, unnest(targets) AS unit,
  CAST(unnest(range(1, len(targets) + 1)) AS BIGINT) AS unit_no FROM targets""",
    "range_errors": """
SELECT o_orderkey, CASE WHEN o_custkey = 0 AND o_orderpriority <> '4-NOT SPECIFIED'
    THEN 'not positive' WHEN o_custkey = 0 THEN 'not positive'
    ELSE 'start after end' END AS error
FROM orders WHERE o_custkey = 0 OR o_orderpriority = '4-NOT SPECIFIED'""",
    "numeral_table": f"""
SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 999 THEN {_numeral('p_partkey')} END AS numeral,
  {_letters('p_partkey')} AS plain,
  CASE WHEN p_partkey NOT BETWEEN 1 AND 999 THEN 'outside 1..999' END AS error FROM part""",
    "ref_parse": """
SELECT o_orderkey,
  CASE WHEN o_orderstatus <> 'O' OR o_orderpriority IN ('1-URGENT', '2-HIGH')
      OR o_orderpriority = '5-LOW' THEN CAST(month(o_orderdate) AS INT) END AS ref_section,
  CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'F'
      AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))
    THEN CAST(month(o_orderdate) AS INT) END AS anchor_section,
  CAST(NULL AS INT) AS other_unit_section
FROM orders""",
    "ref_build": f"""
WITH d AS (SELECT doc_id, {_CORPUS} AS corpus FROM documents),
w AS (
  SELECT * FROM (VALUES
    ({_YD}, 'Tur', 'Tur,_Yoreh_De''ah'), ({_YD}, 'Beit Yosef', 'Beit_Yosef,_Yoreh_De''ah'),
    ({_YD}, 'Shulchan Arukh', 'Shulchan_Arukh,_Yoreh_De''ah'),
    ({_YD}, 'Shach', 'Siftei_Kohen_on_Shulchan_Arukh,_Yoreh_De''ah'),
    ({_YD}, 'Taz', 'Turei_Zahav_on_Shulchan_Arukh,_Yoreh_De''ah'),
    ({_OC}, 'Tur', 'Tur,_Orach_Chayim'), ({_OC}, 'Beit Yosef', 'Beit_Yosef,_Orach_Chayim'),
    ({_OC}, 'Shulchan Arukh', 'Shulchan_Arukh,_Orach_Chayim'),
    ({_OC}, 'Magen Avraham', 'Magen_Avraham'),
    ({_OC}, 'Taz', 'Turei_Zahav_on_Shulchan_Arukh,_Orach_Chayim'),
    ({_OC}, 'Mishna Berura', 'Mishnah_Berurah')) t(corpus, work, prefix))
SELECT doc_id, work, prefix || '.' || doc_id AS ref FROM d JOIN w USING (corpus)""",
    "link_orient": f"""WITH {_LINK_ROWS}
SELECT o_orderkey, corpus, unit, section,
  'Shulchan Arukh, ' || corpus || ' ' || unit || ':' || section AS base_ref,
  title || ' ' || unit || ':' || section || ':1' AS other_ref
FROM link_rows WHERE status IN ('F', 'O')""",
    "contain_join": f"""WITH {_LINK_ROWS}
SELECT o_orderkey, authority FROM link_rows WHERE status IN ('F', 'O')""",
    "contain_texts": """
SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
WHERE b.text <> ''""",
    "required_set": f"""WITH {_SECTIONS},{_LINK_ROWS},{_REQUIRED}
SELECT corpus, unit, CAST(section AS INT) AS section,
  string_agg(authority, ', ' ORDER BY authority) AS required FROM required GROUP BY ALL""",
    "block_split": f"""WITH {_SECTIONS},
kept AS (SELECT *, max(section) OVER (PARTITION BY unit) AS last FROM sections
  WHERE left(md5(line), 1) > '3')
SELECT corpus, unit, CAST(section AS INT) AS section,
  chr(10) || line || CASE WHEN section < last THEN chr(10) ELSE '' END AS text FROM kept""",
    "coverage_audit": f"""{_AUDIT}
SELECT corpus, unit, n_sections > 0 AND local_flags + general_flags = 0 AS success,
  CASE WHEN n_sections > 0 THEN CAST(local_flags AS BIGINT) ELSE 0 END AS local_flags,
  CASE WHEN n_sections > 0 THEN CAST(general_flags AS BIGINT) ELSE 0 END AS general_flags,
  CAST(coalesce(len(missing), 0) AS BIGINT) AS n_missing
FROM audited""",
    "missing_sections": f"""{_AUDIT}
SELECT unit, coalesce(array_to_string(missing, ','), '') AS missing FROM audited""",
    "audit_report": _REPORT,
    "context_union": f"""WITH {_REQUEST_UNITS},{_islands('whole')}
SELECT o_orderkey, CAST(sum(n) AS BIGINT) AS n_units, string_agg(part, ',' ORDER BY lo) AS context
FROM shown GROUP BY 1""",
    "limit_targets": f"""WITH {_REQUEST_UNITS},{_islands('limited')}
SELECT o_orderkey, string_agg(part, ',' ORDER BY lo) AS limited, max(hi) AS last_unit
FROM shown GROUP BY 1""",
    "range_key": f"""WITH {_REQUEST_UNITS},{_islands('whole')},
names AS (
  SELECT o_orderkey, string_agg(u, '_' ORDER BY u) AS name FROM whole
  WHERE o_orderkey % 5000 <> 3 GROUP BY 1)
SELECT o_orderkey, string_agg(part, '_' ORDER BY lo) AS range_key,
  CASE WHEN length(any_value(name)) <= 255 THEN any_value(name) END AS range_name,
  (SELECT min(u) FROM asked a WHERE a.o_orderkey = s.o_orderkey) AS first_unit
FROM shown s LEFT JOIN names USING (o_orderkey) GROUP BY o_orderkey""",
    "drafts_needed": f"""WITH {_CUSTOMER_RELATIONS}
SELECT c_custkey AS request_id, lo, CASE WHEN coalesce(relations, '') <> ''
  THEN target_hi ELSE context_hi END AS hi
FROM requests LEFT JOIN relations USING (c_custkey)""",
    "cached_needed": """
SELECT doc_id, lang FROM documents d WHERE EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0 AND quality IS NOT NULL)""",
    "missing_needed": """
SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0 AND quality IS NOT NULL)""",
    "template_fill": f"""
SELECT doc_id, CASE WHEN lang IN ('en', 'fr')
  THEN 'יורה דעה (' || source || '): ' || {_q(YOREH_DEAH.slots["commentators_list_short"])}
    || ' - ' || {_q(YOREH_DEAH.slots["prompt_commentators_desc"])}
  ELSE 'אורח חיים (' || source || '): ' || {_q(ORACH_CHAYIM.slots["commentators_list_short"])}
    || ' - ' || {_q(ORACH_CHAYIM.slots["prompt_commentators_desc"])} END AS text
FROM documents""",
    "prompt_draft": f"""WITH {_CONTEXT_PARTS}
SELECT unit, part_no, n_parts,
  CASE WHEN unit BETWEEN 1 AND 999 THEN
    CASE WHEN part_no = 1 THEN {_opening('unit')} ELSE '' END || text ||
    CASE WHEN part_no = n_parts THEN {_closing('unit')} ELSE '' END END AS text,
  CASE WHEN unit NOT BETWEEN 1 AND 999 THEN 'unit has no numeral' END AS error
FROM parts""",
    "prompt_relations": f"""WITH {_CUSTOMER_RELATIONS},
entries AS (
  SELECT c_custkey, doc_id,
    '=== סימן ' || doc_id || ' ===' || chr(10) || text || repeat(chr(10), 2) AS entry
  FROM requests JOIN documents ON doc_id BETWEEN lo AND context_hi),
placed AS (
  SELECT *, coalesce(sum(strlen(entry)) OVER (PARTITION BY c_custkey ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS stretch
  FROM entries),
numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY c_custkey ORDER BY stretch) AS part FROM placed),
bodies AS (
  SELECT c_custkey, part, string_agg(entry, '' ORDER BY doc_id) AS body,
    max(part) OVER (PARTITION BY c_custkey) AS parts
  FROM numbered GROUP BY c_custkey, part)
SELECT c_custkey AS request_id, CAST(coalesce(part, 1) AS INT) AS part_no,
  CAST(coalesce(parts, 1) AS INT) AS n_parts,
  CASE WHEN coalesce(part, 1) = 1 THEN {_lit(templates.RELATIONS_PREAMBLE)} ELSE '' END ||
  coalesce(body, '') ||
  CASE WHEN coalesce(part, 1) = coalesce(parts, 1) THEN {_lit(templates.RELATIONS_CLOSING)} ELSE '' END AS text
FROM requests LEFT JOIN bodies USING (c_custkey)""",
    "prompt_polish": f"""WITH {_CUSTOMER_RELATIONS}
SELECT c.c_custkey AS request_id, doc_id AS unit,
  CASE WHEN coalesce(relations, '') <> '' THEN
    {_lit(templates.POLISH.split("{relations}")[0])} || relations ||
    {_lit(templates.POLISH.split("{relations}")[1].split("{draft}")[0])} || text
  ELSE text END AS text
FROM requests c JOIN documents ON doc_id BETWEEN lo AND target_hi
LEFT JOIN relations USING (c_custkey)""",
    "polish_missing": f"""WITH {_CUSTOMER_RELATIONS},
marks AS (
  SELECT c_custkey, doc_id AS u FROM requests JOIN documents ON doc_id BETWEEN lo AND target_hi
  UNION ALL SELECT c_custkey, lo - 1 FROM requests UNION ALL SELECT c_custkey, target_hi + 1 FROM requests),
gaps AS (
  SELECT c_custkey, u + 1 AS lo, lead(u) OVER (PARTITION BY c_custkey ORDER BY u) - 1 AS hi FROM marks)
SELECT c_custkey AS request_id, lo, hi, hi - lo + 1 AS n_units FROM gaps WHERE lo <= hi""",
    "polish_requests": f"""WITH {_CUSTOMER_RELATIONS}
SELECT c.c_custkey AS request_id, doc_id AS unit,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'o3' ELSE 'gpt-5.2' END AS model,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'developer' ELSE 'system' END AS first_role,
  CASE WHEN coalesce(relations, '') <> '' THEN
    {_lit(templates.POLISH.split("{relations}")[0])} || relations ||
    {_lit(templates.POLISH.split("{relations}")[1].split("{draft}")[0])} || text
  ELSE text END AS prompt,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(0.1 AS DOUBLE) END AS temperature,
  CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN 'flex' END AS service_tier
FROM requests c JOIN documents ON doc_id BETWEEN lo AND target_hi
LEFT JOIN relations USING (c_custkey)""",
    "relations_pick": f"""WITH {_CUSTOMER_RELATIONS}
SELECT c.c_custkey AS request_id,
  CASE WHEN c_nationkey = 3 THEN 'given' WHEN relations IS NOT NULL THEN 'cached' ELSE 'none' END
    AS relations_origin,
  CASE WHEN c_nationkey = 3 THEN CASE WHEN c_acctbal >= 1000 THEN c_name || ' by hand' ELSE '' END
    ELSE coalesce(relations, '') END AS relations
FROM requests r JOIN customer c ON c.c_custkey = r.c_custkey
LEFT JOIN relations ON relations.c_custkey = r.c_custkey""",
    "relations_requests": f"""WITH {_CUSTOMER_RELATIONS},
bodies AS (
  SELECT c_custkey, string_agg('=== סימן ' || doc_id || ' ===' || chr(10) || text
    || repeat(chr(10), 2), '' ORDER BY doc_id) AS body
  FROM requests JOIN documents ON doc_id BETWEEN lo AND context_hi GROUP BY 1)
SELECT c_custkey AS request_id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'o3' ELSE 'gpt-5.2' END AS model,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'developer' ELSE 'system' END AS first_role,
  {_lit(templates.RELATIONS_PREAMBLE)} || coalesce(body, '') || {_lit(templates.RELATIONS_CLOSING)} AS prompt,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(0.3 AS DOUBLE) END AS temperature,
  CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN 'flex' END AS service_tier
FROM requests LEFT JOIN bodies USING (c_custkey)""",
    "batch_requests": f"""WITH {_CONTEXT}
SELECT unit, CASE WHEN NOT ok THEN 'unit has no numeral' END AS error,
  CASE WHEN ok THEN 'siman_' || unit || '_generation' END AS custom_id,
  CASE WHEN ok THEN 'POST' END AS method,
  CASE WHEN ok THEN '/v1/chat/completions' END AS url,
  CASE WHEN ok THEN CASE WHEN is_target THEN 'o1-mini' ELSE 'gpt-5.2' END END AS model,
  CASE WHEN ok THEN CASE WHEN is_target THEN 'developer' ELSE 'system' END END AS first_role,
  CASE WHEN ok THEN 'user' END AS second_role,
  CASE WHEN ok THEN {_prompt('unit', 'text')} END AS prompt,
  CASE WHEN ok AND NOT is_target THEN CAST(0.3 AS DOUBLE) END AS temperature
FROM (SELECT *, unit BETWEEN 1 AND 999 AS ok FROM contexts)""",
    "batch_results": f"WITH {_FIRST_RESULT} SELECT custom_id, content FROM first_results",
    "result_files": f"WITH {_FIRST_RESULT} SELECT custom_id, content FROM first_results",
    "result_errors": f"""WITH {_ERRORS}
SELECT conv_id, turn, error,
  CASE WHEN error = 'no content' THEN 'siman_' || conv_id || '_generation' END AS custom_id
FROM errors WHERE error IS NOT NULL""",
    "stream_results": f"""WITH {_FIRST_RESULT}, {_ERRORS},
jobs(job, told) AS (VALUES ('Yoreh_Deah', ''), ('Orach_Chayim', 'Orach_Chayim ')),
asked AS (SELECT 'siman_' || doc_id || '_generation' AS custom_id FROM labels),
counted AS (SELECT custom_id, count(*) AS n FROM usable GROUP BY 1),
failed AS (
  SELECT 'siman_' || conv_id || '_generation' AS custom_id, count(*) AS n FROM errors
  WHERE error = 'no content' GROUP BY 1),
keys AS (SELECT * FROM asked UNION SELECT custom_id FROM counted UNION SELECT custom_id FROM failed)
SELECT job, custom_id, told || content AS content,
  CASE WHEN c.n > 0 AND a.custom_id IS NOT NULL THEN 'complete' WHEN c.n > 0 THEN 'orphan'
    WHEN a.custom_id IS NOT NULL THEN 'pending' ELSE 'failed' END AS state,
  CASE WHEN c.n > 0 THEN 2 * c.n - 1 ELSE 0 END AS n_duplicates,
  CAST(2 * coalesce(f.n, 0) AS BIGINT) AS n_failed
FROM keys LEFT JOIN asked a USING (custom_id) LEFT JOIN counted c USING (custom_id)
LEFT JOIN failed f USING (custom_id) LEFT JOIN first_results USING (custom_id), jobs""",
    "stream_errors": f"""WITH {_ERRORS},
lines AS (  -- a broken text may be several lines of a file
  SELECT error, CASE WHEN error = 'broken line' THEN len(list_filter(
    string_split('{{"custom_id": ' || text, chr(10)), lambda x: trim(x, ' ') <> '')) ELSE 1 END AS n
  FROM errors JOIN conversations USING (conv_id, turn) WHERE error IS NOT NULL)
SELECT error, CAST(4 * sum(n) AS BIGINT) AS n, CAST(4 * sum(n) AS BIGINT) AS n_observed
FROM lines GROUP BY 1""",
    "batch_join": f"""WITH {_FIRST_RESULT}, jobs(job) AS (VALUES ({_YD}), ({_OC}))
SELECT coalesce(a.job, r.job) AS job, coalesce(a.custom_id, r.custom_id) AS custom_id, quality, content,
  CASE WHEN a.custom_id IS NULL THEN 'orphan' WHEN r.custom_id IS NULL THEN 'pending'
    ELSE 'complete' END AS state,
  CAST(regexp_extract(coalesce(a.custom_id, r.custom_id), '[0-9]+') AS BIGINT) AS unit
FROM (SELECT job, 'siman_' || doc_id || '_generation' AS custom_id, quality FROM labels, jobs) a
FULL JOIN (SELECT *, CASE WHEN CAST(regexp_extract(custom_id, '[0-9]+') AS BIGINT) % 2 = 0
    THEN {_YD} ELSE {_OC} END AS job FROM first_results) r
  ON a.custom_id = r.custom_id AND a.job = r.job""",
    "status_route": """
SELECT event_id, CASE WHEN event_type = 'click' AND value >= 5 THEN 'keep'
  WHEN event_type IN ('view', 'signup') THEN 'pending' ELSE 'failed' END AS route FROM events""",
    "chunk_text": f"""WITH {_chunks(2000)}
SELECT doc_id, CAST(unnest(range(1, len(chunks) + 1)) AS INT) AS chunk_no,
  unnest(chunks) AS chunk FROM chunk_lists""",
    "chunk_stats": f"""WITH {_chunks(4000)}
SELECT doc_id, CAST(len(chunks) AS BIGINT) AS n_chunks,
  CAST(list_sum(list_transform(chunks, lambda c: length(c))) AS BIGINT) AS total_chars,
  CAST(list_max(list_transform(chunks, lambda c: length(c))) AS INT) AS max_chars
FROM chunk_lists""",
    "reassemble_chunks": f"""WITH {_chunks(2000)},
  listed AS (
    SELECT doc_id, unnest(range(1, len(chunks) + 1)) AS n, unnest(chunks) AS chunk FROM chunk_lists),
  stretched AS (
    SELECT *, coalesce(sum(strlen(chunk)) OVER (PARTITION BY doc_id ORDER BY n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8192 AS stretch FROM listed),
  dealt AS (
    SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY stretch) AS part FROM stretched)
SELECT doc_id, CAST(part AS INT) AS part_no,
  CAST(max(part) OVER (PARTITION BY doc_id) AS INT) AS n_parts,
  string_agg(chunk, '' ORDER BY n) AS payload
FROM dealt GROUP BY doc_id, part""",
    "version_history": f"""
SELECT event_id, {_EVENT_NAME} || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.txt' AS history_name,
  {_EVENT_NAME} || '.txt' AS latest_name
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('second', ts)
  ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "latest_version": """
SELECT user_id, event_type, event_id, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "artefact_store": f"""
SELECT event_type AS kind, CASE WHEN user_id % 2 = 0 THEN {_YD} ELSE {_OC} END AS corpus,
  CAST(user_id AS VARCHAR) AS unit_key, event_id AS version_id, props AS text
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "artefact_name": f"""
SELECT event_id, {_EVENT_NAME} || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.txt' AS history_name,
  'Yoreh_Deah_Relations_' || user_id || '_' || event_id || '_o1_x' AS relations_name
FROM events""",
    "corpus_stats": f"""
SELECT lang, CAST(grouping(lang) AS INT) AS is_total, count(*) AS segments,
  CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(w) AS BIGINT) AS words,
  CAST(floor(sum(w) * 1.8) AS BIGINT) AS tokens
FROM (SELECT lang, text, len(regexp_extract_all(text, '{_NOT_WS}+')) AS w FROM documents)
GROUP BY ROLLUP (lang)""",
    "cost_estimate": f"""
SELECT doc_id, CAST(length(text) AS INT) AS chars,
  CAST(len(regexp_extract_all(text, '{_NOT_WS}+')) AS INT) AS words,
  CAST(length(text) AS DOUBLE) / 1000 * CAST(0.18 AS DOUBLE) AS cost FROM documents""",
    "payload_size": """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
  CAST(strlen(text) AS DOUBLE) / 1024 / 1024 AS mb, CAST(strlen(text) AS DOUBLE) / 48000 AS seconds
FROM documents""",
    "fence_extract": f"""
SELECT doc_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS script FROM documents""",
}

ORACLES = {name: textwrap.dedent(sql).strip() for name, sql in ORACLES.items()}
