"""Queries over the star-schema tables, each an operator at work, and the same results as SQL.

Applicants are derived from the tables: customers are the structured source (ATS), suppliers the resumes (RESUME); an
entity is a key that either has. Nested results are returned as scalars or joined texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec.functions import dates, phones, text
from goldrec.functions.rows import spread
from goldrec.operators import confidence, merge as merging, normalize, projection, resume, validation
from goldrec.plans import engine, errors, record_queries
from goldrec.plans.config import SKILL_ALIASES, Policy, Rule
from goldrec.schema import PROVENANCE
from goldrec.sources import records
from goldrec.sources.ats import from_json_text
from goldrec.sources.documents import lines_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EMPTY = {"experiences": "array<struct<company:string,title:string,start_date:date,end_date:date,description:string,skills:array<string>>>", "education": "array<struct<institution:string,degree:string,field_of_study:string,start_date:date,end_date:date,gpa:double>>", "certifications": "array<struct<name:string,issuer:string,issued_date:date,expiry_date:date>>"}


def scalar_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources with scalar fields only: entity_key, source, input_ord, names, external_id, contact, balance."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    placed = nation.join(region, nation.n_regionkey == region.r_regionkey)
    # Countries are few; Spark guesses the two tables of them to be larger than they are, and would shuffle people by country.
    ats = spread(_table(spark, sf_dir, "customer")).join(F.broadcast(placed), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "string(c_custkey) AS entity_key", "'ATS' AS source", "0 AS input_ord", "'Customer' AS first_name", "substring_index(c_name, '#', -1) AS last_name", "concat('ATS-', c_custkey) AS external_id",
        "named_struct('email', if(c_custkey % 7 = 0, NULL, concat(lower(replace(c_name, '#', '.')), '@example.com')), 'phone', concat('(415) 555-', lpad(string(c_custkey % 10000), 4, '0')), 'location', concat(n_name, ', ', r_name), 'linkedin_url', string(NULL), 'github_url', string(NULL)) AS contact",
        "c_acctbal AS balance",
    )
    res = spread(_table(spark, sf_dir, "supplier")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "string(s_suppkey) AS entity_key", "'RESUME' AS source", "1 AS input_ord", "if(s_suppkey % 3 = 0, 'Customer', 'Supplier') AS first_name", "substring_index(s_name, '#', -1) AS last_name", "string(NULL) AS external_id",
        "named_struct('email', concat('s', s_suppkey, '@mail.example.com'), 'phone', concat('+1415555', lpad(string(s_suppkey % 10000), 4, '0')), 'location', n_name, 'linkedin_url', concat('https://linkedin.com/in/s', s_suppkey), 'github_url', string(NULL)) AS contact",
        "s_acctbal AS balance",
    )
    return ats.unionByName(res)


SOURCES_SQL = """sources AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_key, 'ATS' AS source, 0 AS rank, 'Customer' AS first_name, split_part(c_name, '#', 2) AS last_name, 'ATS-' || c_custkey AS external_id,
    CASE WHEN c_custkey % 7 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email, '(415) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
    '+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS e164, n_name || ', ' || r_name AS location, CAST(NULL AS VARCHAR) AS linkedin_url, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT CAST(s_suppkey AS VARCHAR), 'RESUME', 1, CASE WHEN s_suppkey % 3 = 0 THEN 'Customer' ELSE 'Supplier' END, split_part(s_name, '#', 2), NULL,
    's' || s_suppkey || '@mail.example.com', '+1415555' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0'), '+1415555' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0'), n_name, 'https://linkedin.com/in/s' || s_suppkey, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills: the kinds of part that a customer has bought (ATS) or a supplier has sold, in lower case (RESUME)."""
    bought = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ats = bought.groupBy(F.col("o_custkey").cast("string").alias("entity_key")).agg(F.sort_array(F.collect_set("p_brand")).alias("skills")).selectExpr("entity_key", "'ATS' AS source", "0 AS input_ord", "skills")
    sold = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    res = sold.groupBy(F.col("l_suppkey").cast("string").alias("entity_key")).agg(F.sort_array(F.collect_set(F.lower("p_type"))).alias("t"), F.sort_array(F.collect_set(F.lower("p_brand"))).alias("b")).selectExpr("entity_key", "'RESUME' AS source", "1 AS input_ord", "concat(t, b) AS skills")
    return ats.unionByName(res)


def record_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiences: a customer's orders (ATS, without a text) and, spelled otherwise and with one, the same (RESUME)."""
    orders = _table(spark, sf_dir, "orders")
    item = "named_struct('company', %s, 'title', o_orderstatus, 'start_date', date(date_trunc('YEAR', o_orderdate)), 'end_date', date(NULL), 'description', %s, 'skills', array())"
    make = lambda source, ord_, company, told: orders.groupBy(F.col("o_custkey").cast("string").alias("entity_key")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(item % (company, told)).alias("x")))).alias("_l")).select("entity_key", F.lit(source).alias("source"), F.lit(ord_).alias("input_ord"), F.transform("_l", lambda z: z.x).cast(EMPTY["experiences"]).alias("experiences"))
    return make("ATS", 0, "o_orderpriority", "string(NULL)").unionByName(make("RESUME", 1, "concat(' ', lower(o_orderpriority), '.')", "concat('order ', o_orderkey)"))


def golden_scalar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: (F.col(c), Rule()) for c in ("first_name", "last_name", "external_id")} | {"email": (F.col("contact.email"), Rule()), "location": (F.col("contact.location"), Rule())}
    out = merging.merge_scalars(scalar_sources(spark, sf_dir), fields)
    return out.select("entity_key", *(F.col(f"{c}.value").alias(c) for c in fields), *(F.col(f"{c}.conflict").alias(f"{c}_conflict") for c in fields), F.col("email.winner").alias("email_winner"), F.array_join("email.contributing", ",").alias("email_sources"))


def merge_first_non_empty_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("first_non_empty", ("RESUME", "ATS"))
    out = merging.merge_scalars(scalar_sources(spark, sf_dir), {"url": (F.col("contact.linkedin_url"), rule), "location": (F.col("contact.location"), rule)})
    return out.select("entity_key", F.col("url.value").alias("url"), F.col("location.value").alias("location"), F.col("location.winner").alias("winner"), F.col("location.conflict").alias("conflict"))


def merge_highest_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merging.merge_scalars(scalar_sources(spark, sf_dir), {"location": (F.col("contact.location"), Rule("highest_confidence"))}, {"location": F.col("balance")})
    return out.select("entity_key", F.col("location.value").alias("location"), F.col("location.winner").alias("winner"), F.col("location.conflict").alias("conflict"))


def merge_flat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merging.union_flat(list_sources(spark, sf_dir), "skills", Rule("union", ("RESUME", "ATS")))
    return out.select("entity_key", F.size("skills").cast("long").alias("n"), F.array_join("skills", "|").alias("skills"))


def merge_structured_union_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merging.union_records(record_sources(spark, sf_dir), "experiences", Rule("union", identity=("company", "title", "start_date")))
    return out.select("entity_key", F.size("experiences").cast("long").alias("n"), F.array_join(F.transform("experiences", lambda x: F.concat_ws("/", x.company, x.title, x.start_date.cast("string"), x.description)), "|").alias("items"))


#: The lists of a source's record, from its key k: which it has, and what is in them. Provenance tells of three fields.
LISTS_OF = {
    "ATS": {
        "skills": "if(k % 4 <> 0, array('Go', 'SQL'), array())", "languages": "if(k % 5 = 0, array('French', 'Irish'), array())",
        "experiences": "if(k % 3 <> 0, array(named_struct('company', concat('Firm ', k % 10), 'title', 'Clerk', 'start_date', date '2010-01-01', 'end_date', date(null), 'description', string(null), 'skills', array('SQL'))), array())",
        "education": "if(k % 2 = 0, array(named_struct('institution', concat('School ', k % 7), 'degree', 'BSc', 'field_of_study', string(null), 'start_date', date(null), 'end_date', date(null), 'gpa', double(null))), array())",
        "certifications": "if(k % 6 = 0, array(named_struct('name', concat('Cert ', k % 4), 'issuer', 'Board', 'issued_date', date(null), 'expiry_date', date(null))), array())",
        "provenance": "array_compact(array(named_struct('field', 'first_name', 'source', 'ATS', 'raw_value', 'Customer'), if(k % 7 = 0, null, named_struct('field', 'email', 'source', 'ATS', 'raw_value', 'e'))))",
    },
    "RESUME": {
        "skills": "array('sql', 'js')", "languages": "array('irish')",
        "experiences": "if(k % 2 = 0, array(named_struct('company', concat('firm ', k % 10, '.'), 'title', 'CLERK', 'start_date', date '2010-01-01', 'end_date', date '2012-01-01', 'description', concat('did ', k), 'skills', array()), named_struct('company', 'Own', 'title', 'Owner', 'start_date', date '2013-01-01', 'end_date', date(null), 'description', string(null), 'skills', array())), array())",
        "education": "if(k % 5 = 0, array(named_struct('institution', concat('school ', k % 7), 'degree', 'bsc', 'field_of_study', 'Trade', 'start_date', date(null), 'end_date', date(null), 'gpa', 3.5D)), array())",
        "certifications": "array(named_struct('name', concat('CERT ', k % 4), 'issuer', string(null), 'issued_date', date(null), 'expiry_date', date(null)))",
        "provenance": "array(named_struct('field', 'first_name', 'source', 'RESUME', 'raw_value', 'f'), named_struct('field', 'email', 'source', 'RESUME', 'raw_value', 's'), named_struct('field', 'linkedin_url', 'source', 'RESUME', 'raw_value', 'l'))",
    },
}


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of both sources, lists included."""
    sources = scalar_sources(spark, sf_dir).drop("balance").withColumn("k", F.col("entity_key").cast("long"))
    types = EMPTY | {"skills": "array<string>", "languages": "array<string>", "provenance": f"array<{PROVENANCE}>"}
    pick = lambda c: F.when(F.col("source") == "ATS", F.expr(_cast(LISTS_OF["ATS"][c], c, types[c]))).otherwise(F.expr(_cast(LISTS_OF["RESUME"][c], c, types[c])))
    return sources.withColumns({c: pick(c) for c in types}).drop("k")


def _cast(sql: str, name: str, kind: str) -> str:
    if name == "provenance":
        return f"cast(transform({sql}, p -> named_struct('field', p.field, 'source', p.source, 'raw_value', p.raw_value, 'extracted_at', timestamp(null))) as {kind})"
    return f"cast({sql} as {kind})"


def merge_conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.disagreements(_merged(spark, sf_dir))


def confidence_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.score(merging.merge(_merged(spark, sf_dir)))
    return out.select("entity_key", F.round("confidence.score", 6).alias("score"), *(F.round(F.col("confidence.fields")[c].score, 6).alias(c) for c in ("first_name", "last_name", "contact", "skills", "experiences", "education")), F.col("confidence.fields")["contact"].source.alias("source"))


def confidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.score(merging.merge(_merged(spark, sf_dir)))
    rows = out.select("entity_key", F.inline("confidence_trace")).groupBy("field", "step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("delta"), 4).alias("delta"), F.round(F.sum("new_score"), 4).alias("new_score"))
    return rows


def confidence_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.score(_merged(spark, sf_dir), single=True)
    return out.select("entity_key", "source", F.round("confidence.score", 6).alias("score"), F.round(F.col("confidence.fields")["contact"].score, 6).alias("contact"))


def transform_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.transform(_merged(spark, sf_dir))
    items = lambda name, part: F.array_join(F.transform(name, part), "|")
    return out.select(
        "entity_key", "first_name", "last_name", "contact.phone", "contact.location", F.round("confidence.score", 6).alias("score"), "is_valid", "summary", "exit_code",
        F.array_join("skills", "|").alias("skills"), F.array_join("languages", "|").alias("languages"), items("experiences", lambda x: F.concat_ws("/", x.company, x.title, x.end_date.cast("string"), x.description, F.array_join(x.skills, ","))).alias("experiences"),
        items("education", lambda x: F.concat_ws("/", x.institution, x.degree, x.field_of_study, x.gpa.cast("string"))).alias("education"), items("certifications", lambda x: F.concat_ws("/", x["name"], x.issuer)).alias("certifications"),
    )


def merge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of the golden records, and the audit record of two fields."""
    out = merging.merge(_merged(spark, sf_dir))
    audit = lambda name: F.array_join(F.sort_array(F.transform(F.get(F.filter("merge_report", lambda r: r.field == name), F.lit(0)).provenance, lambda p: F.concat_ws("=", p.source, p.raw_value))), ",")
    return out.select("entity_key", F.array_join(F.transform("provenance", lambda p: F.concat_ws(":", p.field, p.source, p.raw_value)), ",").alias("provenance"), audit("first_name").alias("first_name"), audit("contact.email").alias("email"))


def merge_report_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = merging.accessors(merging.merge(_merged(spark, sf_dir)))
    return told.select("entity_key", F.size("merged_fields").cast("long").alias("n"), F.array_join("conflicting", ",").alias("conflicting"), F.col("chosen")["last_name"].alias("last_name"), F.col("strategies")["skills"].alias("skills"))


def merge_policy_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy by which the location of the better scored source wins: scores are carried by the records."""
    sources = scalar_sources(spark, sf_dir).drop("balance").withColumns({c: F.array().cast("array<string>") for c in ("skills", "languages")} | {c: F.array().cast(t) for c, t in EMPTY.items()})
    score = "if(source = 'ATS', double(entity_key) % 10 / 10, 0.45D)"
    held = F.expr(f"named_struct('score', 0.5D, 'fields', map('location', named_struct('score', {score}, 'source', source)))")
    policy = Policy(Policy().rules | {"contact.location": Rule("highest_confidence")})
    out = merging.merge(sources.withColumn("confidence", held), policy)
    told = F.get(F.filter("merge_report", lambda r: r.field == "contact.location"), F.lit(0))
    return out.select("entity_key", "contact.location", told.strategy.alias("strategy"), told.conflict.alias("conflict"))


def merge_n_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third source, unknown to the priority, comes last."""
    part = _table(spark, sf_dir, "part").selectExpr("string(p_partkey) AS entity_key", "'OTHER' AS source", "2 AS input_ord", "'Part' AS first_name", "p_brand AS last_name", "concat('P-', p_partkey) AS external_id")
    three = scalar_sources(spark, sf_dir).select("entity_key", "source", "input_ord", "first_name", "last_name", "external_id").unionByName(part)
    out = merging.merge_scalars(three, {c: (F.col(c), Rule()) for c in ("first_name", "external_id")})
    return out.select("entity_key", F.col("first_name.value").alias("first_name"), F.col("external_id.value").alias("external_id"), F.col("external_id.winner").alias("winner"), F.array_join("first_name.contributing", ",").alias("contributing"), F.array_join("considered", ",").alias("considered"))


def project_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.project(engine.transform(_merged(spark, sf_dir)), "assignment")
    return out.select(
        "entity_key", "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "location.city", "location.region", "location.country", F.col("links.linkedin").alias("linkedin"), "headline", "years_experience",
        F.array_join(F.transform("skills", lambda x: F.concat_ws(":", x["name"], x.confidence.cast("string"), F.array_join(x.sources, "+"))), ",").alias("skills"), F.size("experience").cast("long").alias("n_experience"), F.size("education").cast("long").alias("n_education"),
        F.array_join(F.transform("provenance", lambda x: F.concat_ws(":", x.field, x.source, x.method)), ",").alias("provenance"), F.round("overall_confidence", 6).alias("overall_confidence"),
    )


def project_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.project(engine.transform(_merged(spark, sf_dir)), "canonical")
    return out.select("entity_key", "id", "first_name", "external_id", "contact.email", F.size("certifications").cast("long").alias("n_certifications"), F.col("provenance")["first_name"].source.alias("first_name_source"), F.coalesce(F.size("provenance"), F.lit(0)).cast("long").alias("n_provenance"), "schema_version")


def project_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included and renamed by dotted path; what is null or not there is left out."""
    rules = {"external_id": {"output": "externalId"}, "last_name": {"output": "family"}, "contact.linkedin_url": {"output": "link"}, "contact.fax": {"output": "fax"}, "languages": {"output": "languages"}}
    return projection.by_rules(merging.merge(_merged(spark, sf_dir)), rules)


def projection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = engine.transform(_merged(spark, sf_dir))
    return projection.report(golden, "assignment").select("entity_key", "projection_type", "field_count", F.size("warnings").cast("long").alias("n_warnings"))


def confidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonuses, penalties = confidence.notes()
    out = confidence.score(merging.merge(_merged(spark, sf_dir))).select("entity_key", F.explode(F.concat(bonuses, penalties)).alias("note"))
    return out.groupBy("note").agg(F.count(F.lit(1)).alias("n"))


def faulty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with faults by their keys, at least one for every rule; scored, some of the scores spoilt."""
    k = "c_custkey"
    job = "named_struct('company', '%s', 'title', 'T', 'start_date', date '2010-01-01', 'end_date', %s, 'description', %s, 'skills', array())"
    plain = job % ("A", "date(null)", "string(null)")
    jobs = f"CASE {k} % 7 WHEN 2 THEN array({plain}, {job % (' a', 'date(null)', 'string(null)')}) WHEN 4 THEN array({plain}, {job % ('B', 'date ' + repr('2009-01-01'), 'string(null)')}) WHEN 5 THEN array({job % ('A', 'date(null)', 'repeat(' + repr('x') + ', 10001)')}) ELSE array() END"
    school = "named_struct('institution', '%s', 'degree', 'D', 'field_of_study', string(null), 'start_date', date '2010-01-01', 'end_date', %s, 'gpa', double(null))"
    schools = f"CASE {k} % 7 WHEN 3 THEN array({school % ('S', 'date(null)')}, {school % ('s ', 'date(null)')}) WHEN 6 THEN array({school % ('S', 'date ' + repr('2009-01-01'))}) ELSE array() END"
    rows = spread(_table(spark, sf_dir, "customer")).selectExpr(
        f"string({k}) AS entity_key", f"if({k} % 5 = 0, ' ', if({k} % 11 = 0, repeat('x', 10001), 'Ann')) AS first_name", f"if({k} % 13 = 0, 'P\u0430ul', c_name) AS last_name", f"if({k} % 4 = 0, c_name, concat('c-', {k})) AS external_id",
        f"if({k} % 6 = 0, 'x', '12345678-1234-1234-1234-123456789012') AS id", "if(c_custkey % 10 = 3, '2.0', '1.0') AS schema_version", f"cast({jobs} AS {EMPTY['experiences']}) AS experiences", f"cast({schools} AS {EMPTY['education']}) AS education",
        f"named_struct('email', if({k} % 3 = 0, 'nobody', concat('c', {k}, '@x.com')), 'phone', if({k} % 2 = 0, '4155552671', '12'), 'location', string(NULL), 'linkedin_url', if({k} % 9 = 0, 'ftp://x', 'https://x.com/'), 'github_url', string(NULL)) AS contact", k,
    ).withColumns({c: F.array().cast("array<string>") for c in ("skills", "languages")} | {"certifications": F.array().cast(EMPTY["certifications"]), "source": F.lit("ATS")})
    spoilt = F.expr(f"named_struct('score', if({k} % 8 = 1, 2.0D, confidence.score), 'fields', if({k} % 9 = 5, map_concat(confidence.fields, map('odd', named_struct('score', 0.5D, 'source', 'ATS'))), if({k} % 9 = 6, map('skills', named_struct('score', -1.0D, 'source', 'ATS')), confidence.fields)))")
    return confidence.score(rows, single=True).withColumn("confidence", spoilt)


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.issue_rows(validation.validate(faulty_records(spark, sf_dir)))
    return found.select("entity_key", "issue_no", "rule_name", "severity", "field", "value")


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.validate(faulty_records(spark, sf_dir)).select("entity_key", "is_valid", "summary", "exit_code")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean(F.col("text")).cast("binary")).alias("cleaned"), F.length(text.clean(F.col("text"))).cast("long").alias("n"))


def nfkc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written in full width, with a ligature and a superscript, and what they are composed to."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain) + "\u3000"
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", plain + " ", wide), F.lit(" \ufb01x\u00b2")).alias("wide"), "p_brand")
    return normalize.compose(parts, ("wide", "p_brand")).select("p_partkey", F.col("wide").alias("composed"), "p_brand")


def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("name"), text.title_case(F.col("p_type")).alias("kind"), text.key_norm(F.concat_ws(" - ", "p_brand", "p_name")).alias("key"))


def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", resume.first_email(c).alias("email"), F.array_join(resume.all_emails(c), ",").alias("emails"))


def extract_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", resume.first_phone(F.col("text")).alias("phone"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written from parts: separators of all kinds, a category, a lone number, a parenthesis over two lines."""
    body = F.expr("concat(p_brand, ', Fit (Box ', p_partkey, ',\n', p_size, '\n', p_type, ') x; ', lower(p_brand), '\nTools & Kit: - ', p_name, ' | y\u2022z')")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(resume.list_items(body), "#").alias("items"))


def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with parentheses up to six deep, separators at every depth."""
    body = F.expr("concat(p_brand, ' ', repeat('(a, ', p_partkey % 7), p_name, repeat(')', p_partkey % 7), ' b; ', p_type)")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(resume.list_items(body), "#").alias("items"))


def languages_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("concat(n_name, ' (Native), Irish - Fluent\nDutch, ', lower(n_name), ' (B2)')")
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(resume.language_items(body), "|").alias("languages"))


def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", phones.normal_phone(F.expr("concat(if(c_custkey % 3 = 0, '+1', ''), '(415) 555-', lpad(string(c_custkey % 10000), if(c_custkey % 5 = 0, 5, 4), '0'))")).alias("phone"))


def skill_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.expr("if(p_partkey % 2 = 0, 'js', 'golang')"), F.lit("JavaScript "), F.lower("p_brand"), F.col("p_brand"), F.lit(" "))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.normal_skills(raw, SKILL_ALIASES), "|").alias("skills"))


def loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'MMM yyyy') WHEN 1 THEN date_format(o_orderdate, 'MMMM-yyyy') WHEN 2 THEN date_format(o_orderdate, 'M/yyyy') ELSE 'Present' END")
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.loose_date(written).alias("day"))


def location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldrec.operators.projection import place

    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", place(F.concat_ws(" , ", "n_name", "r_name")).alias("p")).select("n_nationkey", "p.city", "p.region", "p.country")


def section_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as sections: its role opens one, its text is the body."""
    turns = _table(spark, sf_dir, "conversations")
    header = F.expr("CASE role WHEN 'user' THEN 'Tech Stack:' WHEN 'assistant' THEN 'Work Experience' ELSE 'Summary' END")
    parts = turns.select(F.col("conv_id").cast("string").alias("doc_id"), "turn", F.explode(F.array(F.struct(F.lit(0).alias("half"), header.alias("text")), F.struct(F.lit(1).alias("half"), F.col("text").alias("text")))).alias("x"))
    blocks = parts.select("doc_id", F.lit(0).alias("page_index"), (F.col("turn") * 2 + F.col("x.half")).cast("int").alias("ord"), "x.text", F.lit(False).alias("is_isolated"))
    return resume.sections(blocks).select("doc_id", "section", F.md5(F.col("body").cast("binary")).alias("body"))


def resume_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes written from customers and their orders, read again: a row per experience entry."""
    orders = _table(spark, sf_dir, "orders")
    line = F.expr("concat('Company ', o_orderkey, ' | Role ', o_orderstatus, ' | ', date_format(o_orderdate, 'MMM yyyy'), ' - Present\n• handled ', o_orderpriority, '\n• and more')")
    body = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x.l), "\n").alias("b"))
    written = body.select(F.col("o_custkey").alias("id"), F.concat(F.lit("Jane Doe\njane@example.com | Paris, France\n\nExperience\n"), "b", F.lit("\nSkills\nPython, SQL, python")).alias("text"))
    found = resume.to_records(resume.extract(lines_of(written, "id", "text")))
    each = found.select("entity_key", F.concat_ws(" ", "first_name", "last_name").alias("name"), "contact.location", F.array_join("skills", ",").alias("skills"), F.posexplode("experiences").alias("pos", "x"))
    return each.select("entity_key", "name", "location", "skills", "pos", "x.company", "x.title", "x.start_date", "x.end_date", "x.description")


def ats_schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written from customers, some of them faulty, through the gate and the mapping."""
    body = F.expr("""CASE c_custkey % 6 WHEN 0 THEN concat('{"first_name": "Ann", "last_name": "', c_name, '", "skills": ["a", "a "]}') WHEN 1 THEN '{"first_name": "Ann"}'
      WHEN 2 THEN '{"first_name": "Ann", "last_name": 7}' WHEN 3 THEN '{"first_name": ' WHEN 4 THEN '{"first_name": "Ann", "last_name": "B", "email": "nobody"}'
      ELSE '{"first_name": "Ann", "last_name": "B", "odd": 1, "languages": "x"}' END""")
    rows = spread(_table(spark, sf_dir, "customer")).select(F.col("c_custkey").cast("string").alias("entity_key"), body.alias("json"))
    return from_json_text(rows).select("entity_key", "error_type", F.when(F.col("error_type").isNull(), F.col("last_name")).alias("last_name"), F.when(F.col("error_type").isNull(), F.array_join("skills", ",")).alias("skills"), F.array_join("unknown_fields", ",").alias("unknown"))


def _resumes(spark: SparkSession, sf_dir: str, body: str, title: str) -> DataFrame:
    """What is found in resumes written from orders, of which each is an entry of one section."""
    orders = _table(spark, sf_dir, "orders")
    entries = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(body).alias("l")))), lambda x: x.l), "\n").alias("b"))
    head = F.concat(F.lit("Orla Byrne\norla"), "o_custkey", F.lit("@h.test | +353 861-234-5678\nCork, Ireland | linkedin.com/in/orla"), "o_custkey", F.lit(" | https://github.com/o"), "o_custkey")
    written = entries.select(F.col("o_custkey").alias("id"), F.concat(head, F.lit(f"\n\n{title}\n"), "b", F.lit("\nAwards\nGolden Anchor")).alias("text"))
    return resume.extract(lines_of(written, "id", "text"))


def experience_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries over several lines: company, title, dates, bullets; the first without bullets, some on one line."""
    line = "CASE o_orderkey % 3 WHEN 0 THEN concat('Firm ', o_orderkey, '\nClerk ', o_orderstatus, '\n', date_format(o_orderdate, 'MMM yyyy'), ' - Present') WHEN 1 THEN concat('Clerk ', o_orderstatus, ', Firm ', o_orderkey, ' ', date_format(o_orderdate, 'MM/yyyy'), ' to 2030\n- saw ', o_orderpriority) ELSE concat('Firm ', o_orderkey, ' | Clerk ', o_orderstatus, ' | ', year(o_orderdate), ' - current') END"
    found = resume.to_records(_resumes(spark, sf_dir, line, "Employment History"))
    each = found.select("entity_key", F.posexplode("experiences").alias("pos", "x"))
    return each.select("entity_key", "pos", "x.company", "x.title", "x.start_date", "x.end_date", "x.description")


def opening_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bullet with bars and dates opens an entry after a plain line, and describes an entry that comes right before it."""
    line = "concat(if(o_orderkey % 2 = 0, concat('Head ', o_orderkey, '\n• '), ''), 'Firm ', o_orderkey, ' | Clerk ', o_orderstatus, ' | ', date_format(o_orderdate, 'MM/yyyy'), ' - 2030\n', if(o_orderkey % 2 = 0, concat('- saw ', o_orderpriority), '• Other | Thing | 2011 - 2012'))"
    found = resume.to_records(_resumes(spark, sf_dir, line, "Employment History"))
    each = found.select("entity_key", F.posexplode("experiences").alias("pos", "x"))
    return each.select("entity_key", "pos", "x.company", "x.title", "x.start_date", "x.end_date", "x.description")


def education_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions with degree, field, dates and grade, a school that is left out, and one whose degree is missing."""
    line = "CASE o_orderkey % 4 WHEN 3 THEN concat('Old High School ', o_orderkey, '\nDiploma in Sums') WHEN 2 THEN concat('Nowhere ', o_orderkey) ELSE concat('College ', o_orderkey, '\nMaster of Arts in Topic ', o_orderstatus, ' (Long Track)\n', date_format(o_orderdate, 'MMM yyyy'), ' - 2030', if(o_orderkey % 4 = 0, '\nCGPA: 8.0 / 10', '\nGPA 9.9')) END"
    found = resume.to_records(_resumes(spark, sf_dir, line, "Academic Background"))
    each = found.select("entity_key", F.posexplode("education").alias("pos", "x"))
    return each.select("entity_key", "pos", "x.institution", "x.degree", "x.field_of_study", "x.start_date", "x.end_date", "x.gpa")


def resume_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, address, phone, place and links of the same resumes, their provenance and what was skipped."""
    line = "concat('Firm ', o_orderkey, ' | Clerk | ', if(o_orderkey % 2 = 0, 'Foo 2001', date_format(o_orderdate, 'MMM yyyy')), ' - Present')"
    out = resume.to_records(_resumes(spark, sf_dir, line, "Experience"))
    skipped = F.array_distinct(F.transform("skipped_entries", lambda x: F.concat_ws(":", x.entry_kind, x.reason)))
    return out.select("entity_key", "first_name", "last_name", "contact.email", "contact.phone", "contact.location", "contact.linkedin_url", "contact.github_url", F.size("experiences").cast("long").alias("n"), F.array_join(skipped, ",").alias("skipped"), F.array_join(F.transform("provenance", lambda p: p.field), ",").alias("provenance"))


def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr("concat('from ', date_format(o_orderdate, 'MMM yyyy'), ' to Present; ', date_format(o_orderdate, 'M/yyyy'), ' - ', year(o_orderdate) + 1)")
    found = dates.date_ranges(written)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda x: F.concat_ws(">", x.start, x.end)), "|").alias("ranges"), dates.loose_date(F.get(found, F.lit(1)).end).alias("last"))


def gpa_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat('CGPA: ', l_linenumber, '.5 / 10') WHEN 1 THEN concat('GPA ', l_linenumber, '.25') ELSE 'grade A' END")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", resume.gpa(written).alias("gpa"))


def _documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured documents written from customers, by key: whole ones, and one for each constraint that can be broken."""
    faults = [
        "\"email\": \"c' || c_custkey || '@x.test\", \"candidate_id\": \"Q' || c_custkey || '\", \"skills\": [\"Go\", \"js\"], \"languages\": [\"Irish\"], \"linkedin_url\": \"HTTPS://L.test\", \"certifications\": [{\"name\": \"X\"}, {\"name\": \"x\"}]",
        "\"experience\": [{\"company\": \"Firm ' || c_custkey || '\", \"title\": \"Clerk\", \"start_date\": \"2010-01-01\", \"end_date\": \"2012-01-01\", \"skills\": [\"a\", \"a\"]}]",
        "\"experience\": [{\"company\": \"F\", \"title\": \"T\", \"start_date\": \"2999-01-01\"}]", "\"experience\": [{\"company\": 5, \"title\": \"T\", \"start_date\": \"2010-01-01\"}]",
        "\"experience\": [{\"company\": \"F\", \"title\": \"T\", \"start_date\": \"2010-01-01\", \"end_date\": \"2009-01-01\", \"description\": \" \"}]", "\"education\": [{\"institution\": \"S\", \"degree\": \"D\", \"gpa\": 4.5}]",
        "\"phone\": \" \", \"github_url\": \"nowhere\"", "\"certifications\": [{\"name\": \"n\", \"issued_date\": \"soon\"}]",
    ]
    body = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(faults)) + " END"
    return spread(_table(spark, sf_dir, "customer")).selectExpr("string(c_custkey) AS entity_key", "'{\"first_name\": \"Ann\", \"last_name\": \"' || c_name || '\", ' || " + body + " || '}' AS json")


def ats_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping with its constraints: what is wrong and why, and what is found where nothing is."""
    out, good = from_json_text(_documents_of(spark, sf_dir)), F.col("error_type").isNull()
    return out.select(
        "entity_key", "error_type", "error_message", *(F.when(good, c).alias(n) for n, c in {
            "external_id": F.col("external_id"), "email": F.col("contact.email"), "linkedin_url": F.col("contact.linkedin_url"), "skills": F.array_join("skills", ","), "n_certifications": F.size("certifications").cast("long"),
            "experience": F.get(F.transform("experiences", lambda x: F.concat_ws("/", x.company, x.title, x.start_date.cast("string"), x.end_date.cast("string"), F.array_join(x.skills, ","))), F.lit(0)),
            "provenance": F.array_join(F.transform("provenance", lambda p: p.field), ","),
        }.items()),
    )


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = from_json_text(_documents_of(spark, sf_dir))
    return out.select("entity_key", errors.message(F.col("error_type"), F.col("error_message")).alias("told"))


def parse_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source each: gate, mapping, normalization, confidence, validation."""
    fine = from_json_text(_documents_of(spark, sf_dir)).where("error_type IS NULL")
    out = engine.parse(fine)
    return out.select("entity_key", "first_name", F.array_join("skills", ",").alias("skills"), F.round("confidence.score", 6).alias("score"), F.round(F.col("confidence.fields")["experiences"].score, 6).alias("experiences"), "is_valid", "summary", "exit_code")


def records_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden records written as JSON, bare or in an envelope or with an unknown key, and read again."""
    golden = engine.project(engine.transform(_merged(spark, sf_dir)), "canonical")
    text_of = records.to_json_text(golden).select(F.get_json_object("value", "$.entity_key").alias("entity_key"), F.col("value").alias("json"))
    k = F.col("entity_key").cast("long") % 3
    odd = F.when(k == 1, F.concat(F.lit('{"candidate":'), "json", F.lit("}"))).when(k == 2, F.concat(F.lit('{"odd":1,'), F.expr("substring(json, 2, length(json))"))).otherwise(F.col("json"))
    back = records.from_json_text(text_of.withColumn("json", odd))
    return back.select("entity_key", "error_type", F.when(F.col("error_type").isNull(), F.col("last_name")).alias("last_name"), F.when(F.col("error_type").isNull(), F.size("provenance").cast("long")).alias("n_provenance"))


QUERIES = {
    q.__name__: q
    for q in (
        golden_scalar_merge, merge_first_non_empty_reversed, merge_highest_confidence, merge_flat_union, merge_structured_union_gapfill, merge_conflict_report, merge_provenance, merge_report_accessors, merge_policy_confidence, merge_n_sources,
        confidence_merged, confidence_trace, confidence_notes, confidence_single_source, transform_end_to_end, project_assignment, project_canonical, project_rules, projection_report, validation_issues, validation_summary,
        clean_text, nfkc_text, title_case, extract_emails, extract_phone, list_items, nested_lists, languages_extract, phone_e164, skill_aliases, loose_dates, date_ranges, gpa_scale, location_parse,
        section_detect, resume_entries, experience_flow, opening_bullets, education_entries, resume_heads, ats_schema_gate, ats_map, error_messages, parse_end_to_end, records_reload,
    )
} | record_queries.QUERIES
