from pyspark.sql import functions as F

from codetally import Hierarchy
from codetally.operators.hierarchy import text_side
from codetally.operators.prepare import rows_per_level
from tests.conftest import HEALTH, PAIRS

DIVISIONS = sorted({code[:2] for _, code in PAIRS})


def single(spark, hierarchy, cases, digits):
    rows = spark.createDataFrame([(c,) for c in cases], "c string")
    return {r.c: r.codes for r in hierarchy.clean_one_code(rows, "c", digits).collect()}


def brute(code, digits):
    """What a code means, by looking at every pair."""
    stem = code.rstrip("xX")
    if not (stem.isascii() and stem.isdigit()):
        return []
    width = digits or 2
    tops = {(s, c[:width]) for s, c in PAIRS}
    hits = {(s, c) for s, c in tops if (c == stem[:width] if len(stem) >= width else c.startswith(stem))}
    return sorted({s if digits == 0 else c for s, c in hits})


def test_clean_one_code_matches_brute_force(spark, hierarchy):
    cases = ["861012", "86101", "86xxx", "86", "2xxxx", "xxxxx", "", "9", "99999", "8610x", "86X", "abc", "86101 ", "0142", "8x101", "866"]
    for digits in (0, 1, 2, 3, 4, 5):
        assert single(spark, hierarchy, cases, digits) == {c: brute(c, digits) for c in cases}
    assert single(spark, hierarchy, ["86xxx", None], 5) == {"86xxx": HEALTH, None: []}


def test_levels_beyond_the_broadcast_bound(spark):
    deep = Hierarchy(spark.createDataFrame([("A", "0111001"), ("A", "0111002"), ("A", "0111")], "section string, code string"))
    assert single(spark, deep, ["0111", "011100", "01110029"], 7) == {
        "0111": ["0111001", "0111002"], "011100": ["0111001", "0111002"], "01110029": ["0111002"],
    }


def test_code_sets_give_every_row_back(spark, hierarchy):
    texts = ["86101;86210;85xxx"] * 3 + ["", None, None, "2xxxx", "86101;86101", "99999"]
    rows = spark.createDataFrame([(1, t) for t in texts], "id int, t string")
    for shaped in (rows, rows.repartition(5), rows.coalesce(1)):
        found = rows_per_level(hierarchy.clean_code_sets(shaped, ["id", "t"], [text_side("t", "codes")], [5, 0]), [5, 0])
        got = sorted((r.t or "", r.digits, tuple(r.codes)) for r in found.collect())
        want = sorted(
            (t or "", d, tuple(sorted({x for part in (t or "").split(";") if part for x in brute(part, d)}))) for t in texts for d in (5, 0)
        )
        assert got == want


def test_sets_are_made_once_a_row(spark, hierarchy):
    """Levels laid out by an inner inline had the optimizer filter rows by their sets, so that all sets were made twice."""
    rows = spark.createDataFrame([(1, "86101;2xxxx")], "id int, t string")
    for digits in (5, [5, 0]):
        found = rows_per_level(hierarchy.clean_code_sets(rows, ["id"], [text_side("t", "codes")], digits if isinstance(digits, list) else [digits]), digits)
        assert "Filter" not in [node.nodeName() for node in nodes(found._jdf.queryExecution().optimizedPlan())]


def nodes(plan):
    children = plan.children()
    return [plan, *[node for i in range(children.length()) for node in nodes(children.apply(i))]]


def test_wide_codes_are_spelled_over_several_lists(spark):
    codes = [str(number) for number in range(10000, 11000)]
    wide = Hierarchy(spark.createDataFrame([("A", code) for code in codes], "section string, code string"))
    texts = ["1xxxx", "100xx", "102xx", "10255", "10256", "1025x", "10999", "109xx", "102xx;10250;1051x", "2xxxx", "1x1xx", "102"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows_per_level(wide.clean_code_sets(rows, ["t"], [text_side("t", "codes", lambda text: F.split(text, ";"))], [5]), 5)
    stems = {t: [part.rstrip("x") for part in t.split(";")] for t in texts}
    want = {t: [c for c in codes if any(stem.isdigit() and c.startswith(stem) for stem in stems[t])] for t in texts}
    assert {r.t: list(r.codes) for r in found.collect()} == want


def test_valid_codes_and_sections(spark, hierarchy):
    valid = {r.code for r in hierarchy.valid_codes().collect()}
    assert valid == {s for s, _ in PAIRS} | {c[:k] for _, c in PAIRS for k in range(1, 6)}
    assert {r.division: r.section for r in hierarchy.section_lookup().collect()} == {c[:2]: s for s, c in PAIRS}
    kept = hierarchy.keep_valid(spark.createDataFrame([("01110",), ("99999",), ("A",)], "x string"), "x")
    assert {r.x for r in kept.collect()} == {"01110", "A"}
    assert Hierarchy(spark.createDataFrame([], "section string, code string")).valid_codes().count() == 0


def test_last_section_of_a_division_wins(spark):
    table = spark.createDataFrame([("A", "01100", 1), ("B", "01200", 2), ("C", "02100", 0)], "section string, code string, n int")
    found = Hierarchy(table, order_col="n").section_lookup().collect()
    assert {r.division: r.section for r in found} == {"01": "B", "02": "C"}
