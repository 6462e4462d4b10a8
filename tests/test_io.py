import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally import ColumnConfig, lineage
from codetally.operators import selection
from codetally.operators.validation import observe_cells, schema_problems, validation_report
from codetally.plans.reports import share_access_codes
from codetally.sources import readers, writers


def test_text_csv(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("﻿unique_id,code,other\nt1,01110,NA\nt2,4+,\nt3,-9,n/a\nt4,663xx,NaN\n", encoding="utf-8")
    found = [tuple(r) for r in readers.read_text_csv(spark, str(path)).collect()]
    assert found == [("t1", "01110", None), ("t2", "4+", None), ("t3", "-9", None), ("t4", "663xx", None)]
    assert readers.read_text_csv(spark, str(path), null_tokens=False).first().other == "NA"
    with pytest.raises(Exception, match="this cell is not: 4\\+"):
        readers.read_typed_csv(spark, str(path), {"code": "int"}).collect()
    typed = readers.read_typed_csv(spark, str(path), {"code": "int"}, strict=False).collect()
    assert [r.code for r in typed] == [1110, None, -9, None]


def test_pipe_delimited(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text('title|description|place\ncook|cooks "well"|cafe\n')
    bad.write_text("title|description|place\ncook|cooks\n")
    assert tuple(readers.read_pipe_delimited(spark, str(good)).first()) == ("cook", 'cooks "well"', "cafe")
    with pytest.raises(Exception):
        readers.read_pipe_delimited(spark, str(bad)).collect()


def test_companion(spark, tmp_path):
    main = tmp_path / "clerical.csv"
    assert readers.companion_path("gs://b/clerical.csv") == "gs://b/Codes_for_4_plus_clerical.csv"
    assert readers.read_companion(spark, str(main)) is None
    (tmp_path / "Codes_for_4_plus_clerical.csv").write_text("unique_id,sic_ind_occ\nA,66210;66220\n")
    assert readers.read_companion(spark, str(main)).first().sic_ind_occ == "66210;66220"


def test_csv_keeps_arrays_as_json(spark, tmp_path):
    df = spark.createDataFrame([("a", ["1", None])], "id string, codes array<string>")
    path = writers.write_csv(df, str(tmp_path / "out"))
    assert readers.read_text_csv(spark, path).first().codes == '["1",null]'


def test_evaluation_run(spark, tmp_path):
    table = spark.createDataFrame([(0.5, None)], "threshold double, accuracy double")
    when = datetime(2025, 3, 4, 5, 6, 7)
    folder = writers.write_evaluation_run(spark, {"evaluation_type": "demo"}, {"points": table}, str(tmp_path), when)
    assert folder.endswith("outputs/20250304_050607_demo")
    assert json.loads(spark.read.text(f"{folder}/metadata").first().value) == {"evaluation_type": "demo"}
    assert json.loads(spark.read.text(f"{folder}/evaluation_result/points").first().value) == {"threshold": 0.5, "accuracy": None}
    with pytest.raises(ValueError):
        writers.write_evaluation_run(spark, {}, {}, str(tmp_path))
    assert writers.metrics_path("x/run.parquet", 3) == "x/run_metrics_3d.json"


def test_append_checks_the_schema(spark, tmp_path):
    fields = {f.name: F.lit(1).cast(f.dataType) for f in writers.LATENCY_SCHEMA if f.name != "test_timestamp"}
    row = spark.range(1).select(*[c.alias(n) for n, c in fields.items()], F.lit("2025-01-01").cast("timestamp").alias("test_timestamp"))
    path = str(tmp_path / "results")
    writers.append_results(row, path)
    writers.append_results(row, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        writers.append_results(row.drop("code"), path)
    with pytest.raises(ValueError):
        writers.append_results(row.withColumn("step", F.lit("one")), path)
    with pytest.raises(Exception):
        writers.append_results(row.withColumn("code", F.lit(None).cast("string")), path)
    assert spark.read.parquet(path).count() == 2
    assert schema_problems(row, writers.LATENCY_SCHEMA) == []


def test_access_code_split(spark, tmp_path):
    rows = spark.createDataFrame([(f"STP{i:04d}", f"ab-cd-{i}") for i in range(6)], "survey_access_id string, one_time_passcode string")
    target = str(tmp_path / "codes.csv")
    kept, given = share_access_codes(rows.repartition(3), 2, target)
    assert {r.participant_id for r in readers.read_text_csv(spark, given).collect()} == {"STP0001", "STP0002"}
    retained = readers.read_text_csv(spark, kept).collect()
    assert {r.participant_id for r in retained} == {"STP0000", "STP0003", "STP0004", "STP0005"}
    assert {r.passcode for r in retained} >= {"ab cd 0"}
    with pytest.raises(FileExistsError):
        share_access_codes(rows, 2, target)
    share_access_codes(rows, 3, target, overwrite=True)
    for n in (6, 7, 0):
        with pytest.raises(ValueError):
            share_access_codes(rows, n, target, overwrite=True)


def test_requests_and_responses(spark):
    rows = spark.createDataFrame([("u1", "cook", None)], "id string, job string, industry string")
    built = selection.build_requests(rows, "id", {"job_title": "job", "industry_descr": "industry"}, {"type": "sic"}).first()
    assert json.loads(built.request_payload) == {"type": "sic", "job_title": "cook", "industry_descr": None}
    bodies = [
        '{"results":[{"classified":true,"followup":"why","code":"01110"},{"code":"2"}]}', '{"results":[]}', '{"error":"503"}', "not json", None,
        '{"results":[{"classified":1,"code":5}]}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    found = [tuple(r)[1:] for r in selection.flatten_responses(df, "body", ["i"]).orderBy("i").collect()]
    assert found == [(1, "why", "01110", None), (0, "", "", None), (0, "", "", "503"), (0, "", "", None), (0, "", "", None), (1, "", "5", None)]


def test_free_text_survives_a_csv(spark, tmp_path):
    texts = [" lead", "tail ", "two\nlines", 'say "so"', "a,b", "back\\slash", '"', " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    path = writers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_text_csv(spark, path, ["i", "text"], null_tokens=False)
    assert [r.text for r in back.orderBy(F.col("i").cast("int")).collect()] == texts


def test_writers_never_write_where_they_read(spark, tmp_path):
    data = str(tmp_path / "modeldir")
    spark.range(5).write.parquet(data)
    written = writers.write_metrics(spark.range(1), data, 5)
    assert written == data + "_metrics_5d.json"
    assert spark.read.parquet(data).count() == 5
    halves = spark.range(3), spark.range(3, 5)
    paths = writers.write_split(*halves, str(tmp_path / "codes"), overwrite=True)
    assert [spark.read.option("header", True).csv(p).count() for p in paths] == [3, 2]
    with pytest.raises(ValueError):
        writers.write_split(*halves, str(tmp_path / "codes"), suffixes=("_a", "_a"))


def test_no_row_is_lost_in_a_split(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e"), (None, "f"), (None, "f")], "k int, v string").repartition(3)
    retained, distributed = selection.split_retained(df, "k", 2)
    assert sorted(r.v for r in distributed.collect()) == ["b", "c"]
    assert sorted(r.v for r in retained.collect()) == ["a", "d", "e", "f", "f"]
    assert sorted(r.v for r in selection.take_window(df, ["k"], skip=1).collect()) == ["b", "c", "d", "e", "f", "f"]
    assert [r.v for r in selection.take_window(df, ["k"], skip=5, take=1).collect()] == ["f"]
    with pytest.raises(ValueError):
        selection.split_retained(df, "k", 5)


def test_windows_and_samples(spark):
    df = spark.range(100).repartition(4)
    assert [r.id for r in selection.take_window(df, ["id"], 90, 5).collect()] == [90, 91, 92, 93, 94]
    assert {r.id for r in selection.take_window(df, ["id"], 97).collect()} == {97, 98, 99}
    assert selection.take_window(df, ["id"], 200).count() == 0
    once, again = (selection.seeded_sample(df.repartition(n), "id", 20, 1) for n in (2, 7))
    assert {r.id for r in once.collect()} == {r.id for r in again.collect()}
    assert once.count() == 20 and selection.seeded_sample(df, "id", 500).count() == 100


def test_totals_before_many_ranges(spark):
    ranges = spark.range(100_000).selectExpr("id as _range", "id % 7 as _size")
    wrong = lineage.totals_before(ranges).filter("_before != int(_range / 7) * 21 + (_range % 7) * (_range % 7 - 1) / 2")
    assert wrong.count() == 0


@pytest.mark.parametrize(("skip", "take"), [(0, 1), (5, 40), (0, 500), (499, 1), (250, None), (700, 5), (0, 0)])
def test_windows_by_rank_and_by_limit_agree(spark, skip, take):
    rows = [(i % 40 if i % 9 else None, f"v{i % 13}") for i in range(500)]  # many equal keys, and equal rows
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = sorted(map(str, order[skip:] if take is None else order[skip : skip + take]))
    inside, outside = lineage.split_by_rank(df, ["k"], skip, None if take is None else skip + take)
    assert sorted(str(tuple(r)) for r in inside.collect()) == want
    assert inside.count() + outside.count() == 500
    assert sorted(str(tuple(r)) for r in selection.take_window(df, ["k"], skip, take).collect()) == want


def test_a_small_window_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr(lineage, "written", lambda df: pytest.fail("a table was written"))
    assert [r.id for r in selection.take_window(spark.range(50_000).repartition(7), ["id"], 20, 3).collect()] == [20, 21, 22]


def test_equal_rows_are_dealt_over_ranges(spark):
    same = spark.range(20_000).selectExpr("1 as k", "'x' as v")
    placed = lineage.in_order(same, ["k"])
    assert placed.agg({"_position": "max"}).first()[0] == 19_999
    assert placed.select("_position").distinct().count() == 20_000


def test_a_batch_appended_twice_is_there_once(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.LongType(), False)])
    path = str(tmp_path / "ledger")
    
    def batch(name, values):
        return spark.createDataFrame([("r", name, v) for v in values], "run_id string, batch_id string, v long")

    writers.append_batches(batch("a", [1, 2, 2]), path, schema)
    writers.append_batches(batch("a", [1, 2, 2]).union(batch("b", [3])), path, schema)
    writers.append_batches(batch("b", [3]), path, schema)
    assert sorted((r.batch_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        writers.append_batches(spark.range(3), path, schema)


def test_responses_of_any_shape(spark):
    cases = {
        None: (None, 0, False), "": (None, 0, True), "{": (None, 0, True), "[1, 2]": (None, 0, False), '{"results": 5}': (None, 0, False),
        '{"results": [{"classified": true}, 1]}': ("boolean", 2, False), '{"results": [{"classified": "true"}]}': ("text", 1, False),
        '{"results": [{"classified": 1.5}]}': ("number", 1, False), '{"results": [{"classified": null}]}': ("null", 1, False),
        '{"results": [{"classified": {"a": 1}}]}': ("object", 1, False), '{"results": [{"classified": [1]}]}': ("array", 1, False),
        '{"results": [7]}': (None, 1, False),
    }
    rows = selection.response_shapes(spark.createDataFrame([(k,) for k in cases], "body string"), "body", ["body"]).collect()
    assert {r.body: (r.classified_type, r.n_results, r.malformed) for r in rows} == cases


def test_validation_outcomes(spark):
    config = ColumnConfig(["m", "gone"], ["s"], ["c"], id_col="id", filter_unambiguous=True)
    df = spark.createDataFrame([(1, "01", "x", 5, "TRUE"), (None, None, "0.5", 6, "maybe"), (2, "nan", None, None, None)], "id int, m string, s string, c int, Unambiguous string")
    assert sorted((r.check, r.subject, r.rows) for r in validation_report(df, config).collect()) == [
        ("label read as text", "c", None), ("missing column", "gone", None), ("missing label", "c", 1), ("missing label", "m", 2), ("null id", "id", 1),
        ("rows", "table", 3), ("score read as number", "s", None), ("unpaired columns", "2 labels, 1 scores", None),
        ("unreadable flag", "Unambiguous", 1), ("unreadable score", "s", 1),
    ]
    watched, cells = observe_cells(df, config)
    assert watched.count() == 3
    assert cells.get["unreadable score: s"] == 1 and cells.get["rows"] == 3
    assert all(r.rows in (0, None) for r in validation_report(df.limit(0), config).collect())
