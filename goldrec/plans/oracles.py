"""The queries' results as SQL for DuckDB."""

from __future__ import annotations

from goldrec.operators.resume import EMAIL, PHONE
from goldrec.plans import record_queries
from goldrec.plans.queries import SOURCES_SQL

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

def _first(c: str, order: str = "rank") -> str:
    return f"arg_min({c}, {order}) FILTER (WHERE {c} IS NOT NULL)"


def _conflict(c: str) -> str:
    return f"count(DISTINCT {c}) > 1"


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^{SPACE}|{SPACE}$', '', 'g'), '{SPACE}', ' ', 'g')"


_names = ("first_name", "last_name", "external_id", "email", "location")
_key = "trim(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
#: Facts of every merged entity: conflicts, agreements, scores; doubles throughout.
_facts = f"""WITH {SOURCES_SQL}, m AS (
  SELECT entity_key, CAST(entity_key AS BIGINT) AS k, max(CASE source WHEN 'ATS' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END) AS w, min(rank) AS first_rank, count(*) > 1 AS two, bool_or(source = 'ATS') AS ats, bool_or(source = 'RESUME') AS res,
    {_conflict("first_name")} AS c_first, {_conflict("last_name")} AS c_last, {_conflict("email")} OR {_conflict("phone")} AS c_contact
  FROM sources GROUP BY entity_key
), l AS (
  SELECT *, ats AND k % 3 <> 0 AS exp_a, res AND k % 2 = 0 AS exp_r, ats AND k % 2 = 0 AS edu_a, res AND k % 5 = 0 AS edu_r, ats AND k % 4 <> 0 AS skill_a, res AS skill_r FROM m
), d AS (
  SELECT *, CASE WHEN two AND NOT c_first THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS a_first, CASE WHEN two AND NOT c_last THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS a_last, CASE WHEN two AND NOT c_contact THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS a_contact,
    CASE WHEN c_first THEN -0.2::DOUBLE ELSE 0::DOUBLE END AS p_first, CASE WHEN c_last THEN -0.2::DOUBLE ELSE 0::DOUBLE END AS p_last, CASE WHEN c_contact THEN -0.2::DOUBLE ELSE 0::DOUBLE END AS p_contact,
    {", ".join(f"{x}_a OR {x}_r AS has_{x}, CASE WHEN {x}_a AND {x}_r THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS a_{x}" for x in ("exp", "edu", "skill"))}
  FROM l
), f AS (
  SELECT *, w + a_first + p_first AS first, w + a_last + p_last AS last, w + a_contact + p_contact AS contact, {", ".join(f"CASE WHEN has_{x} THEN w + a_{x} ELSE 0::DOUBLE END AS {x}" for x in ("exp", "edu", "skill"))} FROM d
), s AS (
  SELECT *, (first + last + contact * 1.5::DOUBLE + exp * 2.0::DOUBLE + edu + skill * 0.5::DOUBLE) / (3.5::DOUBLE + CASE WHEN has_exp THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN has_edu THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN has_skill THEN 0.5::DOUBLE ELSE 0 END) AS overall FROM f
)"""
_norm_facts = _facts.replace("count(DISTINCT phone) > 1", "count(DISTINCT e164) > 1")
#: The merged lists of an entity, as texts, from the facts.
_lists = """CASE WHEN skill_r THEN 'sql|JavaScript' || CASE WHEN skill_a THEN '|Go' ELSE '' END WHEN skill_a THEN 'Go|SQL' ELSE '' END AS skills,
  CASE WHEN ats AND k % 5 = 0 THEN 'French|Irish' WHEN res THEN 'irish' ELSE '' END AS languages,
  CASE WHEN exp_a AND exp_r THEN 'Firm ' || k % 10 || '/Clerk/2012-01-01/did ' || k || '/SQL|Own/Owner/' WHEN exp_a THEN 'Firm ' || k % 10 || '/Clerk/SQL' WHEN exp_r THEN 'firm ' || k % 10 || './CLERK/2012-01-01/did ' || k || '/|Own/Owner/' ELSE '' END AS experiences,
  CASE WHEN edu_a THEN 'School ' || k % 7 || '/BSc' || CASE WHEN edu_r THEN '/Trade/3.5' ELSE '' END WHEN edu_r THEN 'school ' || k % 7 || '/bsc/Trade/3.5' ELSE '' END AS education,
  CASE WHEN ats AND k % 6 = 0 THEN 'Cert ' || k % 4 || '/Board' WHEN res THEN 'CERT ' || k % 4 ELSE '' END AS certifications"""
_provenance = """concat_ws(',', CASE WHEN ats THEN 'first_name:ATS' || {0} ELSE 'first_name:RESUME' || {1} END, CASE WHEN ats AND k % 7 <> 0 THEN 'email:ATS' || {2} WHEN res THEN 'email:RESUME' || {3} END, CASE WHEN res THEN 'linkedin_url:RESUME' || {4} END)"""
_n_provenance = "1 + CASE WHEN ats AND k % 7 <> 0 OR res THEN 1 ELSE 0 END + CASE WHEN res THEN 1 ELSE 0 END"
_id = "concat_ws('-', md5(entity_key)[1:8], md5(entity_key)[9:12], md5(entity_key)[13:16], md5(entity_key)[17:20], md5(entity_key)[21:32])"
_pass = "'PASS: 0 error(s), 0 warning(s) across 14 rule(s)'"
_issues = """WITH c AS (SELECT c_custkey AS k, c_name FROM customer), i AS (
      SELECT k, 1 AS r, 'required_fields' AS rule_name, 'ERROR' AS severity, 'first_name' AS field, ' ' AS value FROM c WHERE k % 5 = 0
      UNION ALL SELECT k, 2, 'schema_version', 'ERROR', 'schema_version', '2.0' FROM c WHERE k % 10 = 3
      UNION ALL SELECT k, 3, 'confidence_values', 'CRITICAL', 'confidence.score', '2.0' FROM c WHERE k % 8 = 1
      UNION ALL SELECT k, 3.5, 'confidence_values', 'CRITICAL', 'confidence.fields.skills', '-1.0' FROM c WHERE k % 9 = 6
      UNION ALL SELECT k, 4, 'string_length', 'ERROR', 'first_name', '10001' FROM c WHERE k % 11 = 0 AND k % 5 <> 0
      UNION ALL SELECT k, 4.5, 'string_length', 'ERROR', 'experiences[0].description', '10001' FROM c WHERE k % 7 = 5
      UNION ALL SELECT k, 5, 'unicode_confusables', 'WARNING', 'last_name', 'P' || chr(1072) || 'ul' FROM c WHERE k % 13 = 0
      UNION ALL SELECT k, 6, 'id_uuid', 'CRITICAL', 'id', 'x' FROM c WHERE k % 6 = 0
      UNION ALL SELECT k, 7, 'email_format', 'ERROR', 'contact.email', 'nobody' FROM c WHERE k % 3 = 0
      UNION ALL SELECT k, 8, 'phone_format', 'WARNING', 'contact.phone', '12' FROM c WHERE k % 2 = 1
      UNION ALL SELECT k, 9, 'url_format', 'WARNING', 'contact.linkedin_url', 'ftp://x' FROM c WHERE k % 9 = 0
      UNION ALL SELECT k, 10, 'external_id_format', 'ERROR', 'external_id', c_name FROM c WHERE k % 4 = 0
      UNION ALL SELECT k, 11, 'duplicate_experience', 'WARNING', 'experiences[1]', concat_ws(chr(31), 'a', 't', '2010-01-01') FROM c WHERE k % 7 = 2
      UNION ALL SELECT k, 12, 'duplicate_education', 'WARNING', 'education[1]', concat_ws(chr(31), 's', 'd') FROM c WHERE k % 7 = 3
      UNION ALL SELECT k, 13, 'date_order', 'ERROR', 'experiences[1].end_date', '2009-01-01' FROM c WHERE k % 7 = 4
      UNION ALL SELECT k, 13, 'date_order', 'ERROR', 'education[0].end_date', '2009-01-01' FROM c WHERE k % 7 = 6
      UNION ALL SELECT k, 14, 'confidence_field_consistency', 'WARNING', 'confidence.fields.odd', 'odd' FROM c WHERE k % 9 = 5)"""
_wrong = """CASE k % 8 WHEN 2 THEN 'experiences: starts in the future' WHEN 3 THEN 'experiences: has a value that is not a text' WHEN 4 THEN 'experiences: ends before it starts; experiences: description is blank' WHEN 5 THEN 'education: gpa is outside 0 to 4'
      WHEN 6 THEN 'contact.phone: is blank; contact.github_url: is not an http address' WHEN 7 THEN 'certifications: issued_date or expiry_date is not a date' END"""
_trace = [("first_name", "a_first", "p_first", "first", None), ("last_name", "a_last", "p_last", "last", None), ("contact", "a_contact", "p_contact", "contact", None), ("experiences", "a_exp", "0::DOUBLE", "exp", "has_exp"), ("education", "a_edu", "0::DOUBLE", "edu", "has_edu"), ("skills", "a_skill", "0::DOUBLE", "skill", "has_skill")]
_per_order = "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos"
_month = "CAST(date_trunc('month', o_orderdate) AS DATE)"

ORACLE_SQL = {
    "golden_scalar_merge": f"""WITH {SOURCES_SQL} SELECT entity_key, {", ".join(f"{_first(c)} AS {c}, {_conflict(c)} AS {c}_conflict" for c in _names)},
      arg_min(source, rank) FILTER (WHERE email IS NOT NULL) AS email_winner, coalesce(string_agg(source, ',' ORDER BY rank) FILTER (WHERE email IS NOT NULL), '') AS email_sources FROM sources GROUP BY entity_key""",
    "merge_first_non_empty_reversed": f"""WITH {SOURCES_SQL} SELECT entity_key, {_first("linkedin_url", "-rank")} AS url, {_first("location", "-rank")} AS location, arg_min(source, -rank) AS winner, false AS conflict FROM sources GROUP BY entity_key""",
    "merge_highest_confidence": f"""WITH {SOURCES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY balance DESC, rank) AS k, count(DISTINCT location) OVER (PARTITION BY entity_key) > 1 AS conflict FROM sources)
      SELECT entity_key, location, source AS winner, conflict FROM r WHERE k = 1""",
    "merge_flat_union": """WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS entity_key, p_brand AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
      r AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS entity_key, 0 AS part, lower(p_type) AS item FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT CAST(l_suppkey AS VARCHAR), 1, lower(p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey),
      i AS (SELECT entity_key, 0 AS src, part, item FROM r UNION ALL SELECT entity_key, 1, 0, item FROM a),
      k AS (SELECT *, row_number() OVER (PARTITION BY entity_key, lower(item) ORDER BY src, part, item) AS n FROM i)
      SELECT entity_key, count(*) AS n, string_agg(item, '|' ORDER BY src, part, item) AS skills FROM k WHERE n = 1 GROUP BY entity_key""",
    "merge_structured_union_gapfill": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_key, o_orderpriority AS company, o_orderstatus AS title, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, o_orderkey FROM orders),
      g AS (SELECT entity_key, company, title, d, min(o_orderkey) AS first_order FROM o GROUP BY ALL)
      SELECT entity_key, count(*) AS n, string_agg(company || '/' || title || '/' || CAST(d AS VARCHAR) || '/order ' || first_order, '|' ORDER BY first_order) AS items FROM g GROUP BY entity_key""",
    "merge_conflict_report": f"""WITH {SOURCES_SQL}, f AS ({" UNION ALL ".join(f"SELECT entity_key, '{name}' AS field, {_first(c)} AS chosen FROM sources GROUP BY entity_key HAVING {_conflict(c)}" for name, c in (("first_name", "first_name"), ("last_name", "last_name"), ("external_id", "external_id"), ("contact.email", "email"), ("contact.phone", "phone")))})
      SELECT *, 'sources disagree on ' || field || '; kept ' || chosen AS message FROM f""",
    "confidence_merged": f"""{_facts} SELECT entity_key, round(overall, 6) AS score, round(first, 6) AS first_name, round(last, 6) AS last_name, round(contact, 6) AS contact, round(skill, 6) AS skills, round(exp, 6) AS experiences, round(edu, 6) AS education,
      CASE first_rank WHEN 0 THEN 'ATS' ELSE 'RESUME' END AS source FROM s""",
    "confidence_trace": f"""{_facts}, t AS (
      {" UNION ALL ".join(f"SELECT '{name}' AS field, 'source_weight' AS step, w AS delta, w AS new_score FROM s UNION ALL SELECT '{name}', 'agreement', {a}, w + {a} FROM s UNION ALL SELECT '{name}', 'conflict_penalty', {p}, w + {a} + {p} FROM s UNION ALL SELECT '{name}', 'missing_field', {f'CASE WHEN {has} THEN 0::DOUBLE ELSE -w END' if has else '0::DOUBLE'}, {x} FROM s" for name, a, p, x, has in _trace)})
      SELECT field, step, count(*) AS n, round(sum(delta), 4) AS delta, round(sum(new_score), 4) AS new_score FROM t GROUP BY field, step""",
    "confidence_notes": f"""{_facts}, t AS (
      {" UNION ALL ".join(f"SELECT '{name}: base weight of the source (+' || CASE WHEN w > 0.65 THEN '0.700' ELSE '0.600' END || ')' AS note FROM s UNION ALL SELECT '{name}: sources agree (+0.100)' FROM s WHERE {a} > 0 UNION ALL SELECT '{name}: sources disagree (-0.200)' FROM s WHERE {p} < 0" + (f" UNION ALL SELECT '{name}: value is missing' FROM s WHERE NOT {has}" if has else "") for name, a, p, x, has in _trace)})
      SELECT note, count(*) AS n FROM t GROUP BY note""",
    "confidence_single_source": f"""WITH {SOURCES_SQL} SELECT entity_key, source, CASE source WHEN 'ATS' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS score, CASE source WHEN 'ATS' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS contact FROM sources""",
    "transform_end_to_end": f"""{_norm_facts}, g AS (SELECT entity_key, {_first("first_name")} AS first_name, {_first("last_name")} AS last_name, {_first("e164")} AS phone, {_first("location")} AS location FROM sources GROUP BY entity_key)
      SELECT g.*, round(overall, 6) AS score, true AS is_valid, {_pass} AS summary, 0 AS exit_code, {_lists} FROM g JOIN s USING (entity_key)""",
    "result_envelope": f"""WITH {SOURCES_SQL} SELECT entity_key, 'true' AS success, '0' AS exit_code, {_pass} AS summary, CAST(14 AS BIGINT) AS n_rules, {_first("first_name")} AS first_name, CAST(NULL AS VARCHAR) AS error_type FROM sources GROUP BY entity_key""",
    "merge_provenance": f"""{_facts} SELECT entity_key, {_provenance.format("':Customer'", "':f'", "':e'", "':s'", "':l'")} AS provenance,
      concat_ws(',', CASE WHEN ats THEN 'ATS=Customer' END, CASE WHEN res THEN 'RESUME=f' END) AS first_name, concat_ws(',', CASE WHEN ats AND k % 7 <> 0 THEN 'ATS=e' END, CASE WHEN res THEN 'RESUME=s' END) AS email FROM s""",
    "merge_report_accessors": f"""WITH {SOURCES_SQL} SELECT entity_key, CAST(13 AS BIGINT) AS n, concat_ws(',', {", ".join(f"CASE WHEN {_conflict(c)} THEN '{name}' END" for name, c in (("external_id", "external_id"), ("first_name", "first_name"), ("last_name", "last_name"), ("contact.email", "email"), ("contact.phone", "phone")))}) AS conflicting,
      {_first("last_name")} AS last_name, 'union' AS skills FROM sources GROUP BY entity_key""",
    "merge_policy_confidence": f"""WITH {SOURCES_SQL}, r AS (SELECT *, CASE source WHEN 'ATS' THEN CAST(entity_key AS DOUBLE) % 10 / 10 ELSE 0.45::DOUBLE END AS score FROM sources)
      SELECT entity_key, arg_max(location, score) AS location, 'highest_confidence' AS strategy, count(DISTINCT location) > 1 AS conflict FROM r GROUP BY entity_key""",
    "merge_n_sources": f"""WITH {SOURCES_SQL}, r AS (SELECT entity_key, source, rank, first_name, external_id FROM sources UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'OTHER', 2, 'Part', 'P-' || p_partkey FROM part)
      SELECT entity_key, {_first("first_name")} AS first_name, {_first("external_id")} AS external_id, arg_min(source, rank) FILTER (WHERE external_id IS NOT NULL) AS winner, string_agg(source, ',' ORDER BY rank) AS contributing, string_agg(source, ',' ORDER BY rank) AS considered FROM r GROUP BY entity_key""",
    "project_assignment": f"""{_norm_facts}, g AS (SELECT entity_key, {_first("first_name")} AS f, {_first("last_name")} AS l, {_first("email")} AS e, {_first("e164")} AS t, {_first("location")} AS p, {_first("linkedin_url")} AS u FROM sources GROUP BY entity_key), x AS (SELECT *, {_lists} FROM s),
      y AS (SELECT *, ':' || CASE WHEN skill > 0.75 THEN '0.8' WHEN skill > 0.65 THEN '0.7' ELSE '0.6' END || ':' || CASE WHEN ats THEN 'ATS' ELSE 'RESUME' END AS told FROM x)
      SELECT entity_key, {_id} AS candidate_id, f || ' ' || l AS full_name, coalesce(e, '') AS emails, coalesce(t, '') AS phones, trim(split_part(p, ',', 1)) AS city, trim(split_part(p, ',', 2)) AS region, '' AS country, coalesce(u, '') AS linkedin, CAST(NULL AS VARCHAR) AS headline, CAST(NULL AS DOUBLE) AS years_experience,
        CASE WHEN skills = '' THEN '' ELSE replace(skills, '|', told || ',') || told END AS skills, CAST(CASE WHEN exp_r THEN 2 WHEN exp_a THEN 1 ELSE 0 END AS BIGINT) AS n_experience, CAST(CASE WHEN has_edu THEN 1 ELSE 0 END AS BIGINT) AS n_education,
        {_provenance.format(*["':Extracted'"] * 5)} AS provenance, round(overall, 6) AS overall_confidence FROM g JOIN y USING (entity_key)""",
    "project_canonical": f"""{_norm_facts}, g AS (SELECT entity_key, {_first("first_name")} AS first_name, {_first("external_id")} AS external_id, {_first("email")} AS email FROM sources GROUP BY entity_key)
      SELECT entity_key, {_id} AS id, first_name, external_id, email, CAST(CASE WHEN ats AND k % 6 = 0 OR res THEN 1 ELSE 0 END AS BIGINT) AS n_certifications, CASE WHEN ats THEN 'ATS' ELSE 'RESUME' END AS first_name_source, CAST({_n_provenance} AS BIGINT) AS n_provenance, '1.0' AS schema_version FROM g JOIN s USING (entity_key)""",
    "project_rules": f"""{_facts}, g AS (SELECT entity_key, {_first("last_name")} AS l, {_first("external_id")} AS e, {_first("linkedin_url")} AS u FROM sources GROUP BY entity_key)
      SELECT entity_key, '{{' || concat_ws(',', '"externalId":"' || e || '"', '"family":"' || l || '"', '"link":"' || u || '"', '"languages":' || CASE WHEN ats AND k % 5 = 0 THEN '["French","Irish"]' WHEN res THEN '["irish"]' ELSE '[]' END) || '}}' AS json,
        CAST(2 + CASE WHEN e IS NULL THEN 0 ELSE 1 END + CASE WHEN u IS NULL THEN 0 ELSE 1 END AS INTEGER) AS field_count FROM g JOIN s USING (entity_key)""",
    "projection_report": f"""WITH {SOURCES_SQL} SELECT DISTINCT entity_key, 'assignment' AS projection_type, 13 AS field_count, CAST(0 AS BIGINT) AS n_warnings FROM sources""",
    "validation_issues": f"""{_issues} SELECT CAST(k AS VARCHAR) AS entity_key, CAST(row_number() OVER (PARTITION BY k ORDER BY r) - 1 AS INTEGER) AS issue_no, rule_name, severity, field, value FROM i""",
    "validation_summary": f"""{_issues}, n AS (SELECT c.k, count(*) FILTER (WHERE severity IN ('ERROR', 'CRITICAL')) AS bad, count(*) FILTER (WHERE severity = 'WARNING') AS warned FROM c LEFT JOIN i USING (k) GROUP BY c.k)
      SELECT CAST(k AS VARCHAR) AS entity_key, bad = 0 AS is_valid, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END || ': ' || bad || ' error(s), ' || warned || ' warning(s) across 14 rule(s)' AS summary, CASE WHEN bad = 0 THEN 0 ELSE 1 END AS exit_code FROM n""",
    "clean_text": f"SELECT doc_id, md5({_clean('text')}) AS cleaned, length({_clean('text')}) AS n FROM documents",
    "title_case": f"""WITH t AS (SELECT *, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS parts FROM part)
      SELECT p_partkey, array_to_string(parts, ' ') AS name, upper(p_type[1]) || lower(p_type[2:]) AS kind, {_key % "p_brand || ' - ' || p_name"} AS key FROM t""",
    "extract_emails": rf"""SELECT doc_id, nullif(regexp_extract(text, '{EMAIL}'), '') AS email,
      CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(regexp_extract_all(text, '{EMAIL}'), lambda x, i: list_position(regexp_extract_all(text, '{EMAIL}'), x) = i), ',') END AS emails FROM documents""",
    "extract_phone": rf"""SELECT doc_id, regexp_replace(list_filter(regexp_extract_all(regexp_replace(text, '{EMAIL}', ' ', 'g'), '{PHONE}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7)[1], '^{SPACE}|{SPACE}$', '', 'g') AS phone FROM documents""",
    "phone_e164": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '+1' ELSE '' END || '(415) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 5, '0') ELSE '+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone FROM customer""",
    "skill_aliases": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'JavaScript' ELSE 'Go|JavaScript' END || '|' || lower(p_brand) AS skills FROM part""",
    "loose_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS day FROM orders""",
    "location_parse": "SELECT n_nationkey, n_name AS city, r_name AS region, '' AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "section_detect": """WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CASE role WHEN 'user' THEN 'skills' ELSE 'experience' END AS section, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')
      SELECT doc_id, section, md5(text) AS body FROM f WHERE n = 1""",
    "resume_entries": """SELECT CAST(o_custkey AS VARCHAR) AS entity_key, 'Jane Doe' AS name, 'Paris, France' AS location, 'Python,SQL' AS skills, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, 'Company ' || o_orderkey AS company, 'Role ' || o_orderstatus AS title,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, 'handled ' || o_orderpriority || chr(10) || 'and more' AS description FROM orders""",
    "ats_schema_gate": """SELECT CAST(c_custkey AS VARCHAR) AS entity_key, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 3 THEN 'InvalidJSONError' WHEN 4 THEN 'MappingError' ELSE 'SchemaValidationError' END AS error_type,
      CASE c_custkey % 6 WHEN 0 THEN c_name END AS last_name, CASE c_custkey % 6 WHEN 0 THEN 'a' END AS skills, CASE c_custkey % 6 WHEN 3 THEN NULL WHEN 5 THEN 'odd' ELSE '' END AS unknown FROM customer""",
    "nfkc_text": "SELECT p_partkey, p_name || ' fix2' AS composed, p_brand FROM part",
    "list_items": "SELECT p_partkey, p_brand || '#Fit (Box ' || p_partkey || ', ' || p_type || ') x#' || p_name || '#y#z' AS items FROM part",
    "nested_lists": "SELECT p_partkey, p_brand || ' ' || repeat('(a, ', p_partkey % 7) || p_name || repeat(')', p_partkey % 7) || ' b#' || p_type AS items FROM part",
    "opening_bullets": f"""SELECT CAST(o_custkey AS VARCHAR) AS entity_key, {_per_order}, CASE WHEN o_orderkey % 2 = 0 THEN '• ' ELSE '' END || 'Firm ' || o_orderkey AS company, 'Clerk ' || o_orderstatus AS title, {_month} AS start_date, DATE '2030-01-01' AS end_date,
      CASE WHEN o_orderkey % 2 = 0 THEN 'saw ' || o_orderpriority ELSE 'Other | Thing | 2011 - 2012' END AS description FROM orders""",
    "languages_extract": "SELECT n_nationkey, n_name || '|Irish|Dutch' AS languages FROM nation",
    "experience_flow": f"""SELECT CAST(o_custkey AS VARCHAR) AS entity_key, {_per_order}, 'Firm ' || o_orderkey AS company, 'Clerk ' || o_orderstatus AS title, CASE WHEN o_orderkey % 3 = 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) ELSE {_month} END AS start_date,
      CASE WHEN o_orderkey % 3 = 1 THEN DATE '2030-01-01' END AS end_date, CASE WHEN o_orderkey % 3 = 1 THEN 'saw ' || o_orderpriority END AS description FROM orders""",
    "education_entries": f"""SELECT CAST(o_custkey AS VARCHAR) AS entity_key, {_per_order}, 'College ' || o_orderkey AS institution, 'Master of Arts' AS degree, 'Topic ' || o_orderstatus AS field_of_study, {_month} AS start_date, DATE '2030-01-01' AS end_date, CASE WHEN o_orderkey % 4 = 0 THEN 3.2::DOUBLE END AS gpa FROM orders WHERE o_orderkey % 4 < 2""",
    "resume_heads": """SELECT CAST(o_custkey AS VARCHAR) AS entity_key, 'Orla' AS first_name, 'Byrne' AS last_name, 'orla' || o_custkey || '@h.test' AS email, '+353 861-234-5678' AS phone, 'Cork, Ireland' AS location, 'https://linkedin.com/in/orla' || o_custkey AS linkedin_url, 'https://github.com/o' || o_custkey AS github_url,
      count(*) FILTER (WHERE o_orderkey % 2 = 1) AS n, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 'experience:no usable start_date' ELSE '' END AS skipped,
      'first_name,last_name,email,phone,location,linkedin_url,github_url' || CASE WHEN bool_or(o_orderkey % 2 = 1) THEN ',experiences' ELSE '' END AS provenance FROM orders GROUP BY o_custkey""",
    "date_ranges": """SELECT o_orderkey, strftime(o_orderdate, '%b %Y') || '>Present|' || month(o_orderdate) || '/' || year(o_orderdate) || '>' || (year(o_orderdate) + 1) AS ranges, make_date(year(o_orderdate) + 1, 1, 1) AS last FROM orders""",
    "gpa_scale": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN round((l_linenumber + 0.5::DOUBLE) * 0.4::DOUBLE, 2) WHEN l_linenumber = 1 THEN 1.25::DOUBLE END AS gpa FROM lineitem""",
    "ats_map": f"""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT CAST(k AS VARCHAR) AS entity_key, CASE WHEN k % 8 > 1 THEN 'MappingError' END AS error_type, {_wrong} AS error_message, CASE WHEN k % 8 = 0 THEN 'Q' || k END AS external_id, CASE WHEN k % 8 = 0 THEN 'c' || k || '@x.test' END AS email,
      CASE WHEN k % 8 = 0 THEN 'https://l.test/' END AS linkedin_url, CASE k % 8 WHEN 0 THEN 'Go,js' WHEN 1 THEN '' END AS skills, CAST(CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS BIGINT) AS n_certifications, CASE WHEN k % 8 = 1 THEN 'Firm ' || k || '/Clerk/2010-01-01/2012-01-01/a' END AS experience,
      CASE k % 8 WHEN 0 THEN 'first_name,last_name,external_id,email,linkedin_url,skills,languages,certifications' WHEN 1 THEN 'first_name,last_name,experiences' END AS provenance FROM c""",
    "error_messages": f"""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT CAST(k AS VARCHAR) AS entity_key, 'The record breaks a constraint: ' || {_wrong} AS told FROM c""",
    "parse_end_to_end": f"""SELECT CAST(c_custkey AS VARCHAR) AS entity_key, 'Ann' AS first_name, CASE WHEN c_custkey % 8 = 0 THEN 'Go,JavaScript' ELSE '' END AS skills, 0.7::DOUBLE AS score, CASE WHEN c_custkey % 8 = 0 THEN 0::DOUBLE ELSE 0.7::DOUBLE END AS experiences, true AS is_valid, {_pass} AS summary, 0 AS exit_code FROM customer WHERE c_custkey % 8 < 2""",
    "records_reload": f"""{_norm_facts}, g AS (SELECT entity_key, {_first("last_name")} AS l FROM sources GROUP BY entity_key)
      SELECT entity_key, CASE WHEN k % 3 = 2 THEN 'SchemaValidationError' END AS error_type, CASE WHEN k % 3 <> 2 THEN l END AS last_name, CASE WHEN k % 3 <> 2 THEN CAST({_n_provenance} AS BIGINT) END AS n_provenance FROM g JOIN s USING (entity_key)""",
} | record_queries.ORACLE_SQL
