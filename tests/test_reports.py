from codetally.plans.reports import section_report

CLERICAL = "unique_id bigint, sic_ind_occ1 string, sic_ind_occ2 string, sic_ind_occ3 string, sic_section string"
MODEL = "unique_id bigint, initial_code string, alt_sic_candidates array<struct<code:string,likelihood:double>>"


def test_section_report_with_unique_and_with_any_ids(spark, hierarchy):
    clerical = spark.createDataFrame([(1, "86101", None, None, "Q"), (2, "01110", "05100", None, "A"), (3, "66xxx", None, None, "K")], CLERICAL)
    model = spark.createDataFrame([(1, "86210", None), (2, None, [("01420", 0.4)]), (3, None, [("85100", 0.4), ("86101", 0.3)])], MODEL)
    want = {("Q", "Admin labels"): 1, ("A", "Admin labels"): 1, ("K", "Admin labels"): 1, ("Q", "Clerical codes"): 1, ("K", "Clerical codes"): 1, ("Q", "Model codes"): 1, ("A", "Model codes"): 1}
    for unique_ids in (True, False):
        found = section_report(clerical, model, hierarchy, unique_ids=unique_ids).collect()
        assert {(r.sic_section, r.source): r["count"] for r in found} == want
