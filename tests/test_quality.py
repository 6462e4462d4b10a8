from codetally import add_quality_flags
from codetally.operators.quality import (
    division_share,
    flag_counts,
    frequency_table,
    group_membership,
    single_answer_share,
)

CODES = "unique_id string, sic_ind_occ1 string, sic_ind_occ2 string, sic_ind_occ3 string"
ROWS = [
    ("t1", "-9", None, None), ("t2", "86101", None, None), ("t3", "91040", "94990", None), ("t4", "86xxx", "87xxx", "47730"),
    ("t5", "86101", "86102", "87100"), ("t6", "4+", None, None),
]


def flagged(spark):
    return add_quality_flags(spark.createDataFrame(ROWS, CODES))


def test_flags(spark):
    found = {r.unique_id: r for r in flagged(spark).collect()}
    assert [found[f"t{i}"].num_answers for i in range(1, 7)] == [0, 1, 2, 3, 3, 4]
    assert [found[f"t{i}"].Match_5_digits for i in range(1, 7)] == [False, True, True, False, True, False]
    assert [i for i in range(1, 7) if found[f"t{i}"].Unambiguous] == [2]
    assert [i for i in range(1, 7) if found[f"t{i}"].Match_2_digits] == [4]
    assert [found[f"t{i}"].SIC_Division for i in range(1, 7)] == ["", "86", "91", "86", "86", ""]
    assert found["t1"].Not_Codeable and found["t6"].Four_Or_More
    assert found["t3"].All_Clerical_codes == ["91040", "94990", None]


def test_answers_that_do_not_count(spark):
    rows = spark.createDataFrame([("a", "na", " ", "-9"), ("b", " NA ", None, ""), ("c", None, "4+", "1")], CODES)
    found = {r.unique_id: r.num_answers for r in add_quality_flags(rows).collect()}
    assert found == {"a": 1, "b": 1, "c": 2}


def test_missing_columns_leave_the_table_alone(spark):
    rows = spark.createDataFrame(ROWS, CODES).drop("sic_ind_occ3")
    assert add_quality_flags(rows).columns == rows.columns


def test_profile_tables(spark):
    table = flagged(spark)
    groups = {r.category: (r["count"], r.percentage) for r in group_membership(table).collect()}
    assert {k: v[0] for k, v in groups.items()} == {
        "Uncodeable": 1, "4+ Codes": 1, "Codeable to 2 digits only": 1, "Codeable to 3 digits only": 0,
        "Codeable unambiguously to 5 digits": 1, "Codeable ambiguously to 5 digits": 2, "Other": 0, "Total": 6,
    }
    assert groups["Total"][1] == 100.0
    counts = {(r.flag, r.value): r["count"] for r in flag_counts(table).collect()}
    assert counts[("Unambiguous", True)] == 1 and counts[("Match_5_digits", False)] == 3
    assert division_share(table, ["86", "87"]).first().percent == 50.0
    assert round(single_answer_share(table).first().percent, 4) == 16.6667


def test_frequency_table(spark):
    table = flagged(spark)
    top = frequency_table(table, "SIC_Division", top_n=1, show_percent=True).orderBy("position").collect()
    assert [(r.value, r.amount) for r in top] == [("86", 50.0), ("Others", 50.0)] and top[0].top_percent == 50.0
    counts = frequency_table(table, "sic_ind_occ2", top_n=5).orderBy("position").collect()
    assert [(r.value, r.amount) for r in counts] == [("86102", 1.0), ("87xxx", 1.0), ("94990", 1.0), ("Others", 0.0)]
    shown = frequency_table(table, "num_answers", labels={"4": "4+"}).collect()
    assert "4+" in {r.value for r in shown}
    assert frequency_table(table, "nothing").count() == 0
    assert frequency_table(table.filter("false"), "sic_ind_occ1").count() == 0
