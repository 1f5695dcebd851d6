"""Work on rows is spread over tasks, and what is read many times is made once."""

import contextlib
import io

from pyspark.sql import functions as F

from goldrec.functions.rows import made_once, spread
from goldrec.functions.text import bind
from goldrec.plans import queries

SF = "/root/testdata/sf0.1"


def plan(frame):
    spark, told = frame.sparkSession, io.StringIO()
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    with contextlib.redirect_stdout(told):
        frame.explain("cost")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    return told.getvalue().split("== Physical Plan ==")[0]


def test_made_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    made = made_once(rows, {"x": F.md5(F.col("v").cast("binary")), "v": F.upper("v")})
    used = made.where("x > '1' AND x < 'f'").select("k", "v", "x", F.length("x"))
    assert plan(used).count("md5(") == 1
    assert [(r.k, r.v, r.x is None) for r in made.orderBy("k").collect()] == [(1, "A", False), (2, "B", False), (3, None, True)]


def test_bind_of_nulls_and_nested(spark):
    rows = spark.createDataFrame([(1, [2, 3]), (None, None)], "a int, l array<int>")
    got = rows.select(bind(F.col("a"), lambda x: F.coalesce(x, F.lit(0)) + x.isNull().cast("int")).alias("a"), bind(F.col("l"), lambda l: F.transform(l, lambda y: bind(y, lambda z: z + F.size(l)))).alias("l")).collect()  # noqa: E741
    assert [tuple(r) for r in got] == [(1, [4, 5]), (1, None)]


def test_spread_keeps_rows(spark):
    rows = spark.range(0, 2500, 1, 1)
    out = spread(rows, most=100)
    assert out.rdd.getNumPartitions() == 25 and max(out.rdd.glom().map(len).collect()) <= 110
    assert out.agg(F.count("id"), F.sum("id")).first() == rows.agg(F.count("id"), F.sum("id")).first()
    assert spread(spark.range(0), most=100).count() == 0


def test_validation_issues_makes_each_step_once(spark):
    found = queries.validation_issues(spark, SF)
    assert len(plan(found)) < 150_000  # 780,000 before: scores and issues were made anew wherever they were read
    assert found.rdd.getNumPartitions() > 1  # one before


def test_sources_are_dealt_over_tasks(spark):
    sizes = queries.scalar_sources(spark, SF).rdd.glom().map(len).collect()
    assert len(sizes) > 3 and max(sizes) < 6000  # two tasks before, one with all customers


def test_an_items_row_holds_no_record_and_few_entities_are_counted(spark):
    told = plan(queries.confidence_notes(spark, SF))
    assert "ArraySort" not in told and "array_sort(" not in told  # a comparator that makes an ordering for each comparison
    assert "LeftSemi" in told  # all items were taken apart a second time to count them


def test_strip_and_collapse_of_all_white_space(spark):
    import re

    from goldrec.functions.text import SPACE, SPACES, collapse, strip

    chars = [chr(i) for i in range(1, 0x3100)]
    rows = spark.createDataFrame([(c, f"{c}a {c}{c} b{c}") for c in chars] + [(None, None), ("", "")], "c string, v string").select("c", strip(F.col("v")).alias("s"), collapse(F.col("v")).alias("k"), F.regexp_replace("v", rf"^[{SPACE}]+|[{SPACE}]+\z", "").alias("was_s"), F.regexp_replace("v", rf"[{SPACE}]+", " ").alias("was_k"))
    assert not rows.where("NOT (s <=> was_s) OR NOT (k <=> was_k)").head(3)
    assert rows.where("s = 'a b' OR k = ' a b '").count() and len(SPACES) == len(set(SPACES))
    # No pattern is tried at every character of a text for what stands at its ends.
    assert "regexp_replace" not in plan(spark.range(1).select(strip(F.col("id").cast("string")))) and re.fullmatch(r"\s+", " ")


def test_documents_are_dealt_over_tasks(spark):
    assert queries._documents_of(spark, SF).rdd.getNumPartitions() > 1  # one before


def _records(spark, n, keys):
    from goldrec.schema import CANDIDATE_DDL

    name = "if(id % 2 = 0, 'Ann', 'Bo')"
    rows = spark.range(n).selectExpr(f"string(id % {keys}) AS entity_key", "if(id % 3 = 0, 'ATS', 'RESUME') AS source", "int(id) AS input_ord", f"{name} AS first_name", "'L' AS last_name", "array(concat('s', id % 4), 'S1') AS skills", "named_struct('email', concat('e', id % 5), 'phone', string(null), 'location', string(null), 'linkedin_url', string(null), 'github_url', string(null)) AS contact")
    given = spark.createDataFrame([], CANDIDATE_DDL).schema
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in given if f.name not in rows.columns})


def test_merge_has_tasks_by_the_number_of_records(spark):
    from goldrec.operators.merge import merge

    told = merge(_records(spark, 45_000, 40_000))
    assert "RepartitionByExpression [entity_key" in plan(told) and told.count() == 40_000
    few = plan(told).split("RepartitionByExpression [entity_key")[1]
    assert few.split("], ")[1].startswith("5")  # as many as spark.sql.shuffle.partitions before, however many records


def test_entities_of_many_records_merge_as_others_do(spark):
    from goldrec.operators.merge import merge

    rows = _records(spark, 300, 1).unionByName(_records(spark, 20, 10).withColumn("entity_key", F.concat(F.lit("k"), "entity_key")))
    text = lambda gather: sorted(merge(rows, gather=gather).select(F.to_json(F.struct("*")).alias("j")).toPandas().j)
    alike = text(50)  # the first entity is of too many records to be dealt whole
    assert len(alike) == 11 and alike == text(10_000)


def test_a_filter_on_errors_has_documents_parsed_once(spark):
    told = plan(queries.parse_end_to_end(spark, "/root/testdata/sf0.01"))
    assert told.count("from_json(") == 1  # in the filter too before, for every field that a constraint reads


def test_reloaded_records_are_judged_once(spark):
    from goldrec.sources import records

    rows = spark.range(3).selectExpr("string(id) AS entity_key", "'{}' || id AS json").withColumn("json", F.concat(F.lit('{"first_name": "Ann", "last_name": "'), "entity_key", F.lit('"}')))
    back = records.from_json_text(rows)
    assert plan(back.select("entity_key", "error_type", "error_message")).count("contact.location: is blank") == 1  # anew for each of them before
    assert not back.where("error_type IS NOT NULL").count()


def test_an_envelope_is_written_and_read_in_one_pass(spark):
    from goldrec.plans import record_queries

    told = plan(record_queries.result_envelope(spark, "/root/testdata/sf0.01"))
    assert told.count("RepartitionByExpression [entity_key") == 1  # two before: what was read was joined to what was written


def test_a_text_is_parsed_once_to_tell_that_it_is_one_document(spark):
    import hashlib

    from goldrec.functions.strict_json import _faults, one_document
    from goldrec.sources.records import record_type

    good = ["{}", ' {"a": [1, null]} \n', "null", "3", '"x"', "[]", '{"a": 1, "a": 2}', '{"a": NaN}']
    bad = ["", " ", "{} {}", "{},{}", "{}]", "{}]}", '{}] "', "1,", ",1", "1]", "1}", '{}, "end"]', '"a', '{"v": 1}}', "1 // c", f'1, "{hashlib.md5(b"1").hexdigest()}"]']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(99, None)], "i int, json string")
    assert sorted(r.i for r in one_document(rows).where("json IS NOT NULL").collect()) == list(range(len(good)))
    assert plan(one_document(rows)).count("parseJson(") == 1  # two before: as a list and as an object
    assert "schema_of_variant(v)" not in _faults("v", record_type(), "''", True, 0)  # the type of all of it, before


def test_plain_records_are_handed_to_python_without_null_lists(spark, monkeypatch):
    from goldrec.operators import normalize

    wide = "CASE WHEN id % 3 = 0 THEN 'Ａｎｎ' WHEN id % 3 = 1 THEN 'Ann' END"
    rows = _records(spark, 9, 9).withColumn("id", F.col("input_ord")).withColumns({"first_name": F.expr(wide), "skills": F.expr(f"CASE WHEN id % 2 = 0 THEN array({wide}, 'x') END"), "languages": F.lit(None).cast("array<string>")})
    out = normalize.normalize(rows)
    assert out.columns == rows.columns
    got = {r.input_ord: r for r in out.collect()}
    assert [got[i].first_name for i in range(9)] == ["Ann", "Ann", None] * 3 and {got[i].languages for i in range(9)} == {None}
    assert all((got[i].skills is None) == (i % 2 == 1) for i in range(9)) and got[0].skills == got[4].skills == ["Ann", "x"]
    # Null before: Spark fills the offsets of null lists from the start of the batch, after each of its rows.
    monkeypatch.setattr(normalize, "nfkc_within", lambda c, shape: F.when(c.isNull(), F.raise_error(F.lit("null handed over"))).otherwise(c))
    assert len(normalize.normalize(rows).collect()) == 9
