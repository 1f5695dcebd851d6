import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from goldrec.functions.strict_json import one_document

from goldrec.plans.engine import parse
from goldrec.sources import records
from goldrec.sources.ats import from_json_text, read_ats
from goldrec.sources.documents import read_documents
from goldrec.streaming.ingest import stream_ats

NAME = {"first_name": "Orla", "last_name": "Byrne"}
JOB = {"company": "Quay Ltd", "title": "Welder", "start_date": "2020-01-01"}
CASES = [
    (NAME, None),
    (NAME | {"candidate_id": "Q-17", "email": "o@h.test", "skills": ["Go", "Go "], "experience": [JOB], "certifications": [{"name": "X"}, {"name": "x"}]}, None),
    (NAME | {"skills": None, "extra": 1}, None),
    ({"first_name": "A"}, "SchemaValidationError"),
    (NAME | {"last_name": None}, "SchemaValidationError"),
    (NAME | {"last_name": " "}, "SchemaValidationError"),
    (NAME | {"last_name": 123}, "SchemaValidationError"),
    (NAME | {"last_name": "x" * 10_001}, "SchemaValidationError"),
    (NAME | {"skills": "x"}, "SchemaValidationError"),
    (NAME | {"skills": [1]}, "SchemaValidationError"),
    (NAME | {"experience": ["x"]}, "SchemaValidationError"),
    ([NAME], "SchemaValidationError"),
    (NAME | {"email": "nope"}, "MappingError"),
    (NAME | {"linkedin_url": "nope"}, "MappingError"),
    (NAME | {"experience": [JOB | {"start_date": "soon"}]}, "MappingError"),
    (NAME | {"experience": [{"company": "Quay Ltd", "start_date": "2020-01-01"}]}, "MappingError"),
    (NAME | {"education": [{"institution": "M", "degree": "B", "gpa": 5}]}, "MappingError"),
    (NAME | {"experience": [JOB | {"start_date": "2999-01-01"}]}, "MappingError"),
    (NAME | {"experience": [JOB | {"company": 5}]}, "MappingError"),
    (NAME | {"experience": [JOB | {"description": " "}]}, "MappingError"),
    (NAME | {"experience": [JOB | {"title": " "}]}, "MappingError"),
    (NAME | {"experience": [JOB] * 201}, "MappingError"),
    (NAME | {"experience": [JOB] * 200}, None),
    (NAME | {"experience": [JOB | {"skills": [f"s{i}" for i in range(501)]}]}, "MappingError"),
    (NAME | {"skills": [f"s{i}" for i in range(501)]}, "MappingError"),
    (NAME | {"skills": ["s"] * 600}, None),
    (NAME | {"languages": [f"s{i}" for i in range(51)]}, "MappingError"),
    (NAME | {"education": [{"institution": "M", "degree": "B"}] * 51}, "MappingError"),
    (NAME | {"education": [{"institution": "M", "degree": 3}]}, "MappingError"),
    (NAME | {"education": [{"institution": "M", "degree": "B", "field_of_study": ""}]}, "MappingError"),
    (NAME | {"education": [{"institution": "M", "degree": "B", "gpa": 4, "start_date": None}]}, None),
    (NAME | {"certifications": [{"name": f"n{i}"} for i in range(101)]}, "MappingError"),
    (NAME | {"certifications": [{"issuer": "x"}]}, "MappingError"),
    (NAME | {"certifications": [{"name": "n", "issuer": " "}]}, "MappingError"),
    (NAME | {"phone": 5}, "MappingError"),
    (NAME | {"phone": " "}, "MappingError"),
    (NAME | {"candidate_id": 7}, "MappingError"),
    (NAME | {"candidate_id": " "}, "MappingError"),
    ('\ufeff{"first_name": "Orla", "last_name": "Byrne"}', None),
    ('{"first_name": Orla}', "InvalidJSONError"),
    ('{"a": }', "InvalidJSONError"),
    ('{"first_name": "A", "last_name": "B"} trailing', "InvalidJSONError"),
    ('{"first_name": "A", "last_name": "B"}{"first_name": "A"}', "InvalidJSONError"),
    ('{"first_name": "A", "last_name": "B"}, {"first_name": "A", "last_name": "B"}', "InvalidJSONError"),
    ('{"first_name": "A", "last_name": "B"}], [{"first_name": "A"}', "InvalidJSONError"),
    ('"last_name": "B"', "InvalidJSONError"),
    ("", "InvalidJSONError"),
    ('\t {"first_name": "A", "last_name": "B", "x": [NaN, -Infinity]}\r\n ', None),
    ('{"first_name": 5, "last_name": "B", "first_name": "A"}', None),
    ('{"first_name": "A", "last_name": "B", "experience": [{"company": 5, "company": "C", "title": "T", "start_date": "2010-01-01"}]}', None),
    ('{"first_name": "A", "last_name": "B", "education": [{"institution": "I", "degree": "D", "gpa": NaN}]}', "MappingError"),
    (None, "InvalidJSONError"),
]


def test_gate(spark):
    rows = [(str(i), c if isinstance(c, str) or c is None else json.dumps(c)) for i, (c, _) in enumerate(CASES)]
    got = {int(r["entity_key"]): r for r in from_json_text(spark.createDataFrame(rows, "entity_key string, json string")).collect()}
    assert [got[i]["error_type"] for i in range(len(CASES))] == [want for _, want in CASES]
    assert got[1]["skills"] == ["Go"] and len(got[1]["certifications"]) == 1 and got[1]["contact"]["email"] == "o@h.test"
    at = {json.dumps(c): got[i]["error_message"] for i, (c, _) in enumerate(CASES)}
    assert at[json.dumps(NAME | {"experience": [JOB | {"start_date": "2999-01-01"}]})] == "experiences: starts in the future"
    assert at[json.dumps(NAME | {"candidate_id": 7})] == "external_id: is not a text"
    both = from_json_text(spark.createDataFrame([("k", json.dumps(NAME | {"email": "nope", "phone": " "}))], "entity_key string, json string")).first()
    assert both["error_message"] == "contact.email: is not an e-mail address; contact.phone: is blank"
    assert [(p["field"], p["source"], p["raw_value"]) for p in got[1]["provenance"]][:4] == [("first_name", "ATS", "Orla"), ("last_name", "ATS", "Byrne"), ("external_id", "ATS", "Q-17"), ("email", "ATS", "o@h.test")]
    assert [p["field"] for p in got[1]["provenance"]][4:] == ["skills", "experiences", "certifications"] and [p["field"] for p in got[2]["provenance"]] == ["first_name", "last_name"]
    assert got[2]["unknown_fields"] == ["extra"] and got[0]["contact"] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes("﻿".encode() + json.dumps(NAME).encode())
    (tmp_path / "b.json").write_bytes(b'{"first_name": "\xff"}')
    (tmp_path / "c.txt").write_text("{}")
    (tmp_path / "d.json").write_text(" " * (5 * 1024 * 1024 + 1))
    got = {r["entity_key"][-6:]: r["error_type"] for r in read_ats(spark, str(tmp_path)).collect()}
    assert got == {"a.json": None, "b.json": "InvalidJSONError", "/c.txt": "FileReadError", "d.json": "FileReadError"}


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    """A checksum beside a file that doesn't fit it: reading fails, the others go on."""
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.json").write_text(json.dumps(NAME))
    (tmp_path / ".b.json.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x12\x34\x56\x78")
    got = {r["entity_key"][-6:]: (r["error_type"], r["error_message"]) for r in read_ats(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (None, None), "b.json": ("FileReadError", "cannot be read"), "c.json": (None, None)}


@pytest.fixture
def docx(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, props="": f"<w:p>{props}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Orla Byrne") + p("Rust", "<w:pPr><w:numPr/></w:pPr>") + f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('top')}</w:hdr>")
    (tmp_path / "cv.docx").write_bytes(raw.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"x")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body></w:body></w:document>")
    (tmp_path / "empty.docx").write_bytes(raw.getvalue())
    (tmp_path / "cv.pdf").write_bytes(b"x")
    return tmp_path


def test_documents(spark, docx):
    blocks, rejects = read_documents(spark, str(docx))
    assert [(r["text"], r["is_isolated"]) for r in blocks.orderBy("ord").collect()] == [("Orla Byrne", True), ("• Rust", True), ("cell", False), ("top", False)]
    assert sorted(r["doc_id"].rsplit("/", 1)[1] for r in rejects.collect()) == ["broken.docx", "cv.pdf", "empty.docx"]


def test_reload(spark):
    rows = [("a", json.dumps(NAME)), ("b", json.dumps({"candidate": NAME})), ("c", json.dumps(NAME | {"odd": 1})), ("d", "{")]
    got = {r["entity_key"]: r["error_type"] for r in records.from_json_text(spark.createDataFrame(rows, "entity_key string, json string")).collect()}
    assert got == {"a": None, "b": None, "c": "SchemaValidationError", "d": "InvalidJSONError"}
    out = records.to_json_text(spark.createDataFrame([("é", None)], "a string, b string")).first()["value"]
    assert out == '{"a":"é","b":null}'


def test_one_document_is_what_json_takes(spark):
    """Random joins of pieces of JSON, against the standard parser."""
    rng, texts = random.Random(2), []
    for _ in range(600):
        texts.append("".join(rng.choice(["{", "}", "[", "]", '"a"', ":", ",", "1", " ", "null", '{"a":1}', '"a":1', "NaN", '"\\u00e9"', "\n", "x"]) for _ in range(rng.randint(0, 7))))
    texts += ['{"a":1}' + t for t in ("", " ", "]", "}", ",", '{"a":2}', "x", "\n\n", "]]", "}}", '],[{"b":2}', '},{"v":{}')]

    def takes(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "json string").withColumn("raw", F.col("json"))
    for r in one_document(rows).collect():
        assert (r["json"] is not None) == takes(r["raw"]), r["raw"]
        if r["json"] is not None and "NaN" not in r["raw"]:
            assert json.loads(r["json"]) == json.loads(r["raw"])


def test_reload_names_every_fault(spark):
    faulty = NAME | {"first_name": 5, "skills": "x", "odd": 1, "contact": {"email": 7, "fax": 1}, "experiences": [JOB, JOB | {"pay": 1, "end_date": "soon"}, "x", None], "provenance": {"email": {"source": "ATS", "at": 1}}, "confidence": {"score": 0.5, "fields": {"skills": {"score": "x"}}}}
    rows = [("a", json.dumps(faulty)), ("b", json.dumps(NAME | {"languages": [f"l{i}" for i in range(51)], "education": [{"institution": "I", "degree": "D", "start_date": "2012-01-01", "end_date": "2011-01-01"}]})), ("c", json.dumps(NAME) + " x"), ("d", "[]"), ("e", json.dumps({"candidate": NAME | {"experiences": [JOB], "provenance": {"email": {"source": "ATS", "raw_value": "x"}}}}))]
    got = {r["entity_key"]: r for r in records.from_json_text(spark.createDataFrame(rows, "entity_key string, json string")).collect()}
    assert set(got["a"]["error_message"].split("; ")) == {
        "odd: is unknown", "first_name: is not a text", "skills: is not a list", "contact.fax: is unknown", "contact.email: is not a text", "experiences[1].pay: is unknown", "experiences[1].end_date: is not a date",
        "experiences[2]: is not an object", "experiences[3]: is null", "provenance.email.at: is unknown", "confidence.fields.skills.score: is not a number",
    }
    assert got["b"]["error_message"] == "languages: has more than 50 items; education: ends before it starts"
    assert (got["c"]["error_type"], got["d"]["error_type"], got["e"]["error_type"]) == ("InvalidJSONError", "SchemaValidationError", None)
    assert got["e"]["experiences"][0]["company"] == "Quay Ltd" and [p["field"] for p in got["e"]["provenance"]] == ["email"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(NAME))
    (tmp_path / "in/b.json").write_text("{")
    (tmp_path / "in/marked.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(NAME).encode())
    (tmp_path / "in/notes.txt").write_text(json.dumps(NAME))
    run = lambda: stream_ats(spark, f"{tmp_path}/in", f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    run()
    (tmp_path / "in/c.json").write_text(json.dumps(NAME))
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 3
    bad = {r["entity_key"].rsplit("/", 1)[1]: r["error_type"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()}
    assert bad == {"b.json": "InvalidJSONError", "notes.txt": "FileReadError"}


def test_parse(spark):
    rows = spark.createDataFrame([("a", json.dumps(NAME | {"phone": "4155552671"}))], "entity_key string, json string")
    row = parse(from_json_text(rows)).first()
    assert row["success"] and row["exit_code"] == 0 and row["contact"]["phone"] == "+14155552671"


def test_command_line(spark, docx, capsys):
    from goldrec import cli

    (docx / "orla_ats.json").write_text(json.dumps(NAME | {"email": "o@h.test", "skills": ["js"]}))
    (docx / "bad.json").write_text("{")
    (docx / "rules.yaml").write_text('version: "1.0"\nfields:\n  first_name: {output: f}\n  contact.fax: {output: x}\n')

    def run(*args):
        code = cli.main([str(a) for a in args])
        out = capsys.readouterr()
        return code, [json.loads(line) for line in out.out.splitlines()], out.err

    code, rows, told = run("parse", docx / "orla_ats.json")
    assert code == 0 and rows[0]["skills"] == ["JavaScript"] and not told
    code, rows, told = run("parse", docx / "bad.json")
    assert code == 1 and not rows and "not valid JSON" in told
    code, rows, told = run("parse", docx / "missing.json")
    assert code == 1 and "No such file" in told
    code, rows, told = run("parse", docx / "rules.yaml")
    assert code == 1 and "no known format" in told
    code, rows, told = run("transform", docx, "--format", "assignment")  # a folder of both kinds
    names = {r["full_name"] for r in rows}
    assert code == 1 and names == {"Orla Byrne"} and "broken.docx" in told and "cv.pdf" in told and "empty.docx" in told
    code, rows, told = run("transform", docx / "orla_ats.json", "--rules", docx / "rules.yaml")
    assert code == 0 and rows[0]["json"] == '{"f":"Orla"}'
    code, rows, told = run("project", docx / "orla_ats.json", "--format", "odd")
    assert code == 1 and "odd" in told
    code, rows, told = run("transform", docx / "orla_ats.json", "--policy", docx / "none.yaml")
    assert code == 1 and "configuration" in told
    code, rows, told = run("merge", docx / "orla_ats.json", "--region", "GB", "-o", docx / "out")
    assert code == 0 and not rows and (docx / "out").exists()
    record = {"first_name": "Orla", "last_name": "Byrne", "id": "not an id", "schema_version": "1.0", "source": "ATS"}
    (docx / "orla.record.json").write_text(json.dumps(record))
    code, rows, told = run("validate", docx / "orla.record.json")
    assert code == 1 and rows[0]["is_valid"] is False and rows[0]["issues"]
    code, rows, told = run("project", docx / "orla.record.json")
    assert code == 0 and rows[0]["first_name"] == "Orla"
