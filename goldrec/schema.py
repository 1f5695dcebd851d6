"""The canonical record and the shapes on its way there."""

CONTACT_FIELDS = ("email", "phone", "location", "linkedin_url", "github_url")
SCALARS = ("external_id", "first_name", "last_name")
EXPERIENCE = "STRUCT<company:STRING,title:STRING,start_date:DATE,end_date:DATE,description:STRING,skills:ARRAY<STRING>>"
EDUCATION = "STRUCT<institution:STRING,degree:STRING,field_of_study:STRING,start_date:DATE,end_date:DATE,gpa:DOUBLE>"
CERTIFICATION = "STRUCT<name:STRING,issuer:STRING,issued_date:DATE,expiry_date:DATE>"
#: Where a field's value comes from: the record's field, its source, the value as it was read, when (a run's parameter).
PROVENANCE = "struct<field:string,source:string,raw_value:string,extracted_at:timestamp>"

CANDIDATE_DDL = f"""entity_key STRING, source STRING, input_ord INT, id STRING, first_name STRING, last_name STRING, external_id STRING,
 contact STRUCT<{",".join(f"{c}:STRING" for c in CONTACT_FIELDS)}>, experiences ARRAY<{EXPERIENCE}>, education ARRAY<{EDUCATION}>,
 skills ARRAY<STRING>, certifications ARRAY<{CERTIFICATION}>, languages ARRAY<STRING>, provenance ARRAY<{PROVENANCE}>, schema_version STRING"""

#: Text of a document in reading order, a row per line or block.
BLOCKS_DDL = "doc_id STRING, page_index INT, ord INT, text STRING, is_isolated BOOLEAN"

#: The raw structured document; nested keys that aren't named here are ignored.
ATS_DDL = """candidate_id STRING, first_name STRING, last_name STRING, email STRING, phone STRING, location STRING, linkedin_url STRING,
 github_url STRING, skills ARRAY<STRING>, languages ARRAY<STRING>,
 experience ARRAY<STRUCT<company:STRING,title:STRING,start_date:STRING,end_date:STRING,description:STRING,skills:ARRAY<STRING>>>,
 education ARRAY<STRUCT<institution:STRING,degree:STRING,field_of_study:STRING,start_date:STRING,end_date:STRING,gpa:DOUBLE>>,
 certifications ARRAY<STRUCT<name:STRING,issuer:STRING,issued_date:STRING,expiry_date:STRING>>"""
