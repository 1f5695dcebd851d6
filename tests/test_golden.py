import datetime
import json

import pytest
from pyspark.sql import functions as F

from goldrec.operators import confidence, merge, normalize, projection, validation
from goldrec.operators.merge import conflicts
from goldrec.plans import engine
from goldrec.plans.config import FIELDS, Config, ConfigError, Policy, Rule, load_config, load_projection
from goldrec.plans.reports import Reports
from goldrec.schema import CANDIDATE_DDL
from goldrec.sources import records

D = datetime.date


def record(key, source, first="Jane", last="Doe", ord_=None, ext=None, contact=None, exp=(), edu=(), skills=(), certs=(), langs=(), prov=()):
    return (key, source, {"ATS": 0, "RESUME": 1}[source] if ord_ is None else ord_, None, first, last, ext, contact, list(exp), list(edu), list(skills), list(certs), list(langs), list(prov), "1.0")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CANDIDATE_DDL.replace("\n", " "))


def exp(company, title="Eng", start=D(2020, 1, 1), end=None, text=None):
    return (company, title, start, end, text, [])


def test_merge_fields(spark):
    out = merge.merge(
        frame(
            spark,
            record("a", "ATS", ext="ATS-1", contact=("a@x.com", None, "Paris", "https://l/ats", None), skills=["Python", "Go"], exp=[exp("Acme")], edu=[("MIT", "BSc", None, None, None, None)]),
            record("a", "RESUME", first="Janet", contact=("a@x.com", "1", "", "https://l/res", None), skills=["python", "Rust"], exp=[exp("ACME!", "eng", text="t"), exp("B")], edu=[("mit", "bsc", "CS", None, None, 3.5)]),
            record("b", "RESUME", skills=["Go"]), record("b", "RESUME", skills=["Rust"], ord_=2), record("b", "ATS", skills=["Python"]),
            record("c", "ATS", first=None),
        )
    )
    got = {r["entity_key"]: r for r in out.collect()}
    a = got["a"]
    assert (a["first_name"], a["external_id"], a["contact"]["linkedin_url"], a["contact"]["location"]) == ("Jane", "ATS-1", "https://l/res", "Paris")
    assert a["skills"] == ["python", "Rust", "Go"]
    assert [(x["company"], x["description"]) for x in a["experiences"]] == [("Acme", "t"), ("B", None)]
    assert [(x["institution"], x["degree"], x["field_of_study"], x["gpa"]) for x in a["education"]] == [("MIT", "BSc", "CS", 3.5)]
    assert got["b"]["skills"] == ["Go", "Rust", "Python"]
    assert got["c"]["error_type"] == "MergeError" and a["error_type"] is None
    assert [(r["entity_key"], r["field"], r["chosen"]) for r in conflicts(out).collect()] == [("a", "first_name", "Jane")]


def test_limits_of_golden_records(spark):
    """400 skills from each source are too many together; a list beyond what may be gathered is counted only."""
    many = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = frame(
        spark,
        record("a", "ATS", skills=many("x", 400)), record("a", "RESUME", skills=many("y", 400)), record("b", "ATS", skills=many("x", 250)), record("b", "RESUME", skills=many("y", 250)),
        record("c", "ATS", skills=many("x", 900)), record("c", "RESUME", first=None, exp=[exp(f"F{i}") for i in range(201)]), record("d", "ATS", skills=many("x", 400)), record("d", "RESUME", skills=many("X", 400)),
    )
    got = {r["entity_key"]: r for r in merge.merge(rows, gather=600).collect()}
    assert {k: r["error_message"] for k, r in got.items()} == {"a": "skills: has more than 500 items", "b": None, "c": "experiences: has more than 200 items; skills: has more than 500 items", "d": None}
    assert len(got["c"]["skills"]) == 1 and len(got["b"]["skills"]) == 500 and len(got["d"]["skills"]) == 400
    assert {r["error_type"] for r in got.values()} == {None, "MergeError"}


def test_disagreements_are_conflicts(spark):
    rows = frame(spark, record("a", "ATS", ext="1", contact=("a@x.com", None, "Paris", None, None)), record("a", "RESUME", first="Janet", ext="2", contact=("b@x.com", "1", "", None, None)), record("b", "ATS"), record("b", "RESUME"))
    want = conflicts(merge.merge(rows)).collect()
    assert len(want) == 3 and sorted(map(str, merge.disagreements(rows).collect())) == sorted(map(str, want))


def test_policy():
    with pytest.raises(ConfigError):
        Policy({"skills": Rule("source_priority")})
    with pytest.raises(ConfigError):
        Policy({"experiences": Rule("union")})
    with pytest.raises(ConfigError):
        Policy({"first_name": Rule("newest")})


def scores(spark, *rows, single=False):
    data = frame(spark, *rows)
    out = confidence.score(data if single else merge.merge(data), single=single).first()
    return out["confidence"]["score"], {k: v["score"] for k, v in out["confidence"]["fields"].items()}, out["confidence_trace"]


def test_confidence(spark):
    full = {"contact": ("a@x.com", None, None, None, None), "exp": [exp("A")], "edu": [("M", "B", None, None, None, None)], "skills": ["x"]}
    overall, fields, trace = scores(spark, record("a", "ATS", **full), single=True)
    assert overall == pytest.approx(0.7) and set(fields.values()) == {0.7} and len(trace) == 24
    overall, fields, trace = scores(spark, record("a", "ATS", contact=("a@x.com", None, None, None, None), exp=[exp("A")]), record("a", "RESUME", contact=("b@x.com", None, None, None, None)))
    assert fields["first_name"] == 0.7 + 0.1 and fields["contact"] == 0.7 - 0.2 and fields["skills"] == 0 and fields["experiences"] == 0.7
    assert overall == pytest.approx(3.75 / 5.5)


def test_validation(spark):
    good = confidence.score(engine._with_id(frame(spark, record("a", "ATS", contact=("a@x.com", "+14155552671", None, "https://x.com/", None)))), single=True)
    row = validation.validate(good).first()
    assert row["is_valid"] and row["summary"] == "PASS: 0 error(s), 0 warning(s) across 14 rule(s)", row["issues"]
    bad = frame(
        spark,
        record("b", "ATS", first=" ", last="Pаvel", ext="no spaces here", contact=("nope", "12", None, "ftp://x", None), exp=[exp("Acme"), exp("ACME", "eng"), exp("Z", end=D(2019, 1, 1))]),
    )
    row = validation.validate(confidence.score(bad, single=True)).first()
    assert [i["rule_name"] for i in row["issues"]] == ["required_fields", "unicode_confusables", "id_uuid", "email_format", "phone_format", "url_format", "external_id_format", "duplicate_experience", "date_order"]
    assert [i["field"] for i in row["issues"]][-2:] == ["experiences[1]", "experiences[2].end_date"] and not row["is_valid"]
    with pytest.raises(ConfigError):
        validation.validate(bad, rules=[validation.RULES[0]] * 2)


def test_projection(spark):
    golden = engine.transform(frame(spark, record("a", "ATS", contact=("a@x.com", None, "Paris, IDF, France, EU", None, None), skills=["py"]), record("a", "RESUME")))
    row = engine.project(golden, "assignment").first().asDict(True)
    assert row["full_name"] == "Jane Doe" and row["emails"] == ["a@x.com"] and row["phones"] == [] and row["location"] == {"city": "Paris", "region": "IDF", "country": "France"}
    assert row["skills"] == [{"name": "Python", "confidence": 0.7, "sources": ["ATS"]}] and row["links"] == {"linkedin": "", "github": ""}
    assert projection.by_rules(golden, {"first_name": {"output": "firstName"}, "contact.phone": {"output": "phone"}}).first()["json"] == '{"firstName":"Jane"}'
    assert projection.by_rules(golden, {"contact.phone": {"output": "phone"}}, "null").first()["json"] == '{"phone":null}'
    paths = {"last_name": {"output": "l"}, "contact.fax": {"output": "fax"}, "nothing.at.all": {"output": "n"}, "skills": {"output": "s"}}
    row = projection.by_rules(golden, paths).first()
    assert row["json"] == '{"l":"Doe","s":["Python"]}' and row["field_count"] == 2
    assert projection.by_rules(golden, paths, "null").first()["field_count"] == 4
    row = projection.report(golden, "assignment").first()
    assert (row["projection_type"], row["field_count"], row["warnings"]) == ("assignment", 13, [])
    with pytest.raises(projection.ProjectionError):
        engine.project(golden, "nothing")
    with pytest.raises(projection.ProjectionError):
        projection.by_rules(golden, {"first_name": {}})
    assert engine.parse(frame(spark, record("a", "ATS", contact=("A@X.com ", "(415) 555-2671", None, None, None))), Config()).first()["contact"][:2] == ("a@x.com", "+14155552671")


def test_ties_are_stable(spark):
    """Two records of one entity with the same source and input_ord: whatever their order, the same golden record."""
    rows = [record("t", "ATS", first=f"N{i}", skills=[f"s{i}", "both"], exp=[exp("Acme", text=f"t{i}")], ord_=0) for i in range(6)]
    a, b = (merge.merge(frame(spark, *r).repartition(n)).drop("merge_report").first() for r, n in ((rows, 1), (rows[::-1], 5)))
    assert a == b


def test_highest_confidence_in_a_policy(spark):
    rows = frame(spark, record("a", "ATS", first="Ann"), record("a", "RESUME", first="Anna"), record("b", "ATS", first="Bo"), record("b", "RESUME", first="Bob"))
    held = "named_struct('score', 0.5D, 'fields', map('first_name', named_struct('score', if(source = 'ATS' AND entity_key = 'a', 0.1D, 0.6D), 'source', source)))"
    policy = Policy(Policy().rules | {"first_name": Rule("highest_confidence")})
    names = lambda rows: {r["entity_key"]: r["first_name"] for r in merge.merge(rows, policy).collect()}
    assert names(rows.withColumn("confidence", F.expr(held))) == {"a": "Anna", "b": "Bo"}
    assert names(rows) == {"a": "Ann", "b": "Bo"}


def test_provenance_follows_the_winner(spark):
    told = lambda source, **raw: [(f, source, v, None) for f, v in raw.items()]
    rows = frame(
        spark,
        record("a", "ATS", contact=("a@x.com", None, None, None, None), skills=["Go"], prov=told("ATS", first_name="Jane", email="a@x.com", skills="[Go]")),
        record("a", "RESUME", first="Janet", contact=(None, "1", "Paris", "https://l/", None), skills=["Ada"], prov=told("RESUME", first_name="Janet", phone="1", linkedin_url="l", skills="[Ada]")),
        record("a", "RESUME", first="Jan", ord_=5, prov=told("RESUME", first_name="Jan")),
    )
    row = merge.merge(rows).first()
    assert [(p["field"], p["source"], p["raw_value"]) for p in row["provenance"]] == [("first_name", "ATS", "Jane"), ("skills", "RESUME", "[Ada]"), ("email", "ATS", "a@x.com"), ("phone", "RESUME", "1"), ("linkedin_url", "RESUME", "l")]
    report = {r["field"]: r for r in row["merge_report"]}
    assert {(p["source"], p["raw_value"]) for p in report["first_name"]["provenance"]} == {("ATS", "Jane"), ("RESUME", "Jan")}
    assert list(report) == list(FIELDS)
    golden = engine.transform(rows)
    assert [(p["field"], p["source"], p["method"]) for p in engine.project(golden, "assignment").first()["provenance"]][:2] == [("first_name", "ATS", "Extracted"), ("skills", "RESUME", "Extracted")]
    assert engine.project(golden, "canonical").first()["provenance"]["email"]["raw_value"] == "a@x.com"
    back = records.from_json_text(records.to_json_text(engine.project(golden, "canonical")).select(F.lit("k").alias("entity_key"), F.col("value").alias("json"))).first()
    assert back["error_type"] is None and len(back["provenance"]) == 5
    told = merge.accessors(golden).first()
    assert told["conflicting"] == ["first_name"] and told["chosen"]["contact.email"] == "a@x.com" and told["strategies"]["skills"] == "union" and told["merged_fields"] == list(FIELDS)


def test_certifications_repeat_by_name_only_once(spark):
    row = merge.merge(frame(spark, record("a", "ATS", certs=[("Diver", "X", None, None)]), record("a", "RESUME", certs=[("DIVER", "Y", None, None), ("Welder", None, None, None)]))).first()
    assert [(c["name"], c["issuer"]) for c in row["certifications"]] == [("Diver", "X"), ("Welder", None)]


def test_normalize_composes_every_text(spark):
    wide, narrow = "Ａｃｍｅ ﬁrm", "Acme firm"
    row = record("a", "ATS", first="ＪＡＮＥ", last="doe", contact=(" A@B.com", None, f" {wide} ", None, None), exp=[(wide, "T", D(2020, 1, 1), None, f"{wide}\n two", ["js", "ＪＳ", "JavaScript"]), ("B", "T", D(2020, 1, 1), None, None, None)], edu=[(wide, "B", wide, None, None, None)], skills=["ｐｙ", "Python", wide], certs=[(wide, None, None, None)], langs=[f" {wide}"])
    once = normalize.normalize(frame(spark, row, record("b", "ATS", first="ann", skills=["js"])))
    out = {r["entity_key"]: r for r in once.collect()}
    a = out["a"]
    assert (a["first_name"], a["last_name"], a["contact"]["location"], a["contact"]["email"]) == ("Jane", "Doe", narrow, "a@b.com")
    assert a["skills"] == ["Python", narrow] and a["languages"] == [narrow] and a["education"][0][:3] == (narrow, "B", narrow) and a["certifications"][0]["name"] == narrow
    assert a["experiences"][0] == (narrow, "T", D(2020, 1, 1), None, f"{narrow} two", ["JavaScript"]) and a["experiences"][1]["skills"] is None
    assert out["b"]["first_name"] == "Ann" and out["b"]["skills"] == ["JavaScript"] and out["b"]["contact"] is None
    again = spark.createDataFrame(once.collect(), once.schema)
    assert sorted(map(str, normalize.normalize(again).collect())) == sorted(map(str, once.collect()))


def test_confidence_picks_its_facts_and_tells_why(spark):
    rows = frame(spark, record("a", "ATS"), record("a", "RESUME", first="X"))
    with pytest.raises(ConfigError):
        confidence.score(rows.drop("source"))
    assert confidence.score(rows).first()["confidence"]["score"] == pytest.approx(0.7)
    bonuses, penalties = confidence.notes()
    row = confidence.score(merge.merge(rows)).select(bonuses.alias("b"), penalties.alias("p")).first()
    assert "last_name: sources agree (+0.100)" in row["b"] and "first_name: sources disagree (-0.200)" in row["p"] and "skills: value is missing" in row["p"]


def test_configuration_files(tmp_path):
    for name, text in {
        "merge_policy": 'version: "1.0"\ndefault_priority: [RESUME, ATS]\nfields:\n  first_name: {strategy: highest_confidence}\n  education: {strategy: union, identity_keys: [institution]}\n',
        "confidence_rules": 'version: "1.0"\nstrategy_order: [source_weight, missing_field]\nsource_weights: {ATS: 0.9}\nscored_fields: [skills, contact]\nfield_weights: {skills: 2}\n',
        "validation_rules": 'version: "1.0"\nmax_string_length: 5\ndefault_phone_region: GB\n', "skill_aliases": 'version: "1.0"\naliases: {RS: Rust}\n', "rules": 'version: "1.0"\nfields:\n  first_name: {output: f}\n',
    }.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    c = load_config(str(tmp_path))
    assert c.policy.rule("first_name") == Rule("highest_confidence", ("RESUME", "ATS")) and c.policy.rule("education").identity == ("institution",)
    assert c.scoring.fields == {"skills": 2.0, "contact": 1.0} and c.scoring.sources == {"ATS": 0.9} and c.scoring.steps == ("source_weight", "missing_field")
    assert (c.longest, c.region, c.aliases) == (5, "GB", {"rs": "Rust"})
    assert load_projection(str(tmp_path / "rules.yaml")) == {"first_name": {"output": "f"}}
    for text in ('version: "9.0"', "version: 1.0", "- x", "a: [", 'version: "1.0"\nstrategy_order: [luck]\nsource_weights: {}\nscored_fields: []\nfield_weights: {}\n'):
        (tmp_path / "confidence_rules.yaml").write_text(text)
        with pytest.raises(ConfigError):
            load_config(str(tmp_path))


def test_reports_of_a_run(spark):
    """Metrics of the stages and rules come from the one job that writes the records."""
    rows = frame(spark, record("a", "ATS", ext="A 1", contact=("nobody", None, "Paris", None, None)), record("a", "RESUME", first="Janet"), record("b", "ATS"), record("c", "ATS", first=None))
    seen = Reports()
    judged = engine.transform(rows, reports=seen)
    out = {r["entity_key"]: r for r in judged.collect()}
    got = seen.get()
    assert list(got) == ["merge", "confidence", "validation"] and {s["rows"] for s in got.values()} == {3}
    assert (got["merge"]["errors"], got["merge"]["conflicts"]) == (1, 1)
    assert got["confidence"]["mean_score"] == pytest.approx(sum(r["confidence"]["score"] for r in out.values()) / 3)
    for rule in validation.RULES:
        assert got["validation"][f"failed_{rule.name}"] == sum(any(i["rule_name"] == rule.name for i in r["issues"]) for r in out.values()), rule.name
    assert got["validation"]["invalid"] == sum(not r["is_valid"] for r in out.values()) and got["validation"]["failed_email_format"] == 1
    told = {r["entity_key"]: r for r in validation.report(judged).collect()}
    assert told["a"]["rules_failed"] == ["email_format", "external_id_format"] and told["a"]["rules_executed"] == [r.name for r in validation.RULES] and told["b"]["rules_failed"] == []


def test_envelope(spark):
    judged = engine.transform(frame(spark, record("a", "ATS", contact=("a@x.com", None, "Paris", None, None)), record("a", "RESUME", first="Janet", contact=(None, "12", None, None, None))))
    text = engine.envelope(judged).select(F.to_json("result").alias("json")).first()["json"]
    result = json.loads(text)
    assert set(result) == {"candidate", "reports", "warnings", "success", "exit_code"} and result["success"] is True and result["exit_code"] == 0
    assert len(result["reports"]["validation"]["rules_executed"]) == 14 and result["reports"]["validation"]["rules_failed"] == ["phone_format"]
    assert result["warnings"] == ["sources disagree on first_name", "contact.phone is not a valid number"]
    back = records.from_json_text(spark.createDataFrame([("k", text)], "entity_key string, json string")).first()
    assert (back["entity_key"], back["error_message"], back["first_name"]) == ("a", None, "Jane")
