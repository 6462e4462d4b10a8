"""Row-level operators: cleaning, flags, sets, selection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import sql, views
from catalogue.registry import register
from codetally.config import ColumnConfig
from codetally.fixed_values import CODE_LENGTH
from codetally.functions import codes as C
from codetally.functions import sets as S
from codetally.functions import stats
from codetally.operators import selection
from codetally.operators.alignment import LabelAlignment, exclude_patterns, top_values
from codetally.lineage import alike_together, written
from codetally.operators.hierarchy import text_side
from codetally.operators.prepare import clean_wide_table, keep_unambiguous, rows_per_level
from codetally.operators.quality import add_quality_flags
from codetally.operators.validation import observe_cells, validation_report

WIDE_CONFIG = ColumnConfig(
    model_label_cols=["m1", "m2", "m3"], model_score_cols=["s1", "s2", "s3"],
    clerical_label_cols=["sic_ind_occ1", "sic_ind_occ2", "sic_ind_occ3"], id_col="unique_id",
)
REPEATED_CONFIG = ColumnConfig(
    model_label_cols=["SA_1", "SA_2"], model_score_cols=["SA_score_1", "SA_score_2"], clerical_label_cols=["CC_1", "CC_2"], id_col="unique_id"
)
STRING = T.StringType()


def aligned(spark, sf_dir):
    return LabelAlignment(views.wide(spark, sf_dir), WIDE_CONFIG, unique_ids=True)


# --- selection -------------------------------------------------------------------------------------


@register("keep_unambiguous", "select unique_id, m1, unamb as \"Unambiguous\" from padded where lower(unamb)='true'")
def keep_unambiguous_rows(spark, sf_dir):
    return keep_unambiguous(views.wide(spark, sf_dir)).select("unique_id", "m1", "Unambiguous")


@register("take_window", "select o_orderkey, o_custkey from orders order by o_orderkey limit 175 offset 100")
def take_window(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return selection.take_window(orders, ["o_orderkey"], skip=100, take=175)


@register("skip_rows", "select o_orderkey, o_custkey from (select * from orders order by o_orderkey offset 1000)")
def skip_rows(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return selection.take_window(orders, ["o_orderkey"], skip=1000)


def keyed_events(spark, sf_dir):
    """Events by user, some without one; a user has many events."""
    e = views.table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("user"), "event_id")


KEYED_EVENTS = "(select case when event_type<>'error' then user_id end as usr, event_id from events)"
PLACED_EVENTS = f"(select *, row_number() over (order by usr nulls last, event_id) as rn from {KEYED_EVENTS})"


@register("skip_repeated_keys", f"select usr as \"user\", event_id from {PLACED_EVENTS} where rn>(select count(*)//3 from events)")
def skip_repeated_keys(spark, sf_dir):
    """Skip a third of the table, in an order of keys that repeat and may be null."""
    events = keyed_events(spark, sf_dir)
    return selection.take_window(events, ["user"], skip=events.count() // 3)


@register(
    "split_repeated_keys",
    f"""select usr as "user", event_id, case when usr is not null and rn between 2 and 1+(select count(*)//2 from {KEYED_EVENTS} where usr is not null)
    then 'distributed' else 'retained' end as part from {PLACED_EVENTS}""",
)
def split_repeated_keys(spark, sf_dir):
    """Distribute half of the rows that have a key; keys repeat."""
    events = keyed_events(spark, sf_dir)
    return halves(*selection.split_retained(events, "user", events.filter("user is not null").count() // 2))


@register(
    "split_half_of_orders",
    """select o_orderkey, case when rn between 2 and 1+(select count(*)//2 from orders) then 'distributed' else 'retained' end as part
    from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders)""",
)
def split_half_of_orders(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return halves(*selection.split_retained(orders, "o_orderkey", orders.count() // 2))


def halves(retained, distributed):
    return retained.withColumn("part", F.lit("retained")).unionByName(distributed.withColumn("part", F.lit("distributed")))


@register("threshold_filter", "select unique_id, max_score from aligned where max_score>=5e-1")
def threshold_filter(spark, sf_dir):
    return aligned(spark, sf_dir).df.filter(F.col("max_score") >= 0.5).select("unique_id", "max_score")


@register(
    "exclude_patterns",
    "select unique_id, sic_ind_occ1 from coded where not coalesce(regexp_matches(sic_ind_occ1,'x') or regexp_matches(sic_ind_occ1,'-9'),false)",
)
def exclude_by_patterns(spark, sf_dir):
    return exclude_patterns(views.coded(spark, sf_dir).select("unique_id", "sic_ind_occ1"), "sic_ind_occ1", ["x", "-9"])


@register(
    "keep_top_members",
    """select unique_id, sic_ind_occ1, m1 from coded
    where sic_ind_occ1 in (select sic_ind_occ1 from coded where sic_ind_occ1 is not null group by 1 order by count(*) desc, 1 limit 10)""",
)
def keep_top_members(spark, sf_dir):
    rows = views.coded(spark, sf_dir).select("unique_id", "sic_ind_occ1", "m1")
    top = top_values(rows.groupBy("sic_ind_occ1").count(), "sic_ind_occ1", 10)
    return selection.keep_members(rows, "sic_ind_occ1", F.broadcast(top.select("sic_ind_occ1"))).select("unique_id", "sic_ind_occ1", "m1")


@register(
    "reformat_access_codes",
    "select c_custkey as participant_id, concat(substr(c_name,1,8),' ',substr(c_name,10)) as passcode from customer",
)
def reformat_access_codes(spark, sf_dir):
    return selection.reformat_access_codes(views.access_codes(spark, sf_dir))


@register(
    "split_retained",
    """select c_custkey, case when rn between 2 and 101 then 'distributed' else 'retained' end as part
    from (select c_custkey, row_number() over (order by c_custkey) as rn from customer)""",
)
def split_retained(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer").select("c_custkey")
    return halves(*selection.split_retained(customers, "c_custkey", 100))


@register(
    "build_requests",
    """select p_partkey as unique_id, cast(json_object('llm','model-1','type','sic','job_title',p_name,'job_description',p_type,
    'industry_descr',case when p_size>25 then p_brand end) as varchar) as request_payload from part""",
)
def build_requests(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").withColumn("industry", F.when(F.col("p_size") > 25, F.col("p_brand")))
    return selection.build_requests(
        part, "p_partkey", {"job_title": "p_name", "job_description": "p_type", "industry_descr": "industry"}, views.REQUEST_CONSTANTS
    )


@register(
    "flatten_responses",
    """select event_id, case when event_type='purchase' then 1 else 0 end as classified,
    case when event_type='purchase' then concat('why ',user_id) else '' end as followup,
    case when event_type in ('purchase','view') then lpad(cast(event_id%90000 as varchar),5,'0') else '' end as code,
    case when event_type='click' then 'not found' end as error from events""",
)
def flatten_responses(spark, sf_dir):
    return selection.flatten_responses(views.stored_responses(spark, sf_dir), "body", ["event_id"])


@register("seeded_sample", "select o_orderkey, o_orderstatus from orders order by md5(concat('1:',o_orderkey)), o_orderkey limit 20")
def seeded_sample(spark, sf_dir):
    return selection.seeded_sample(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 20)


@register(
    "sampled_questions",
    """select unique_id, method, followup_question from (select unique_id, 'm_a' as method, 'which ' || m1 as followup_question from coded
    union all select unique_id, 'm_b', 'which ' || m2 from coded)
    where unique_id in (select unique_id from coded order by md5(concat('1:',unique_id)), unique_id limit 20)""",
)
def sampled_questions(spark, sf_dir):
    from codetally.plans.reports import question_sample

    rows = views.coded(spark, sf_dir)
    asked = {
        name: rows.select("unique_id", F.when(F.col(c).isNotNull(), F.concat(F.lit("which "), F.col(c))).alias("followup_question"))
        for name, c in {"m_a": "m1", "m_b": "m2"}.items()
    }
    return question_sample(rows, asked)


@register("narrow_projection", "select o_orderkey, o_orderstatus from orders where o_totalprice>=250000")
def narrow_projection(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").filter(F.col("o_totalprice") >= 250000).select("o_orderkey", "o_orderstatus")


# --- single codes ----------------------------------------------------------------------------------

KEYS = "l_orderkey, l_partkey, l_linenumber"
NUMBER = r"'\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*'"
PADDED_TEXT = f"""case when text in ('4+','-9') then text when regexp_full_match(text,{NUMBER}) then
    (case when w<0 then concat('-',lpad(cast(-w as varchar),4,'0')) when w>99999 then cast(w as varchar) else lpad(cast(w as varchar),5,'0') end)
    else text end"""
MESSY_WHOLE = f"(select *, case when regexp_full_match(text,{NUMBER}) then cast(trunc(try_cast(text as double)) as bigint) end as w from messy)"


def messy(spark, sf_dir):
    return views.messy(spark, sf_dir)


def keyed(df, **columns):
    return df.select("l_orderkey", "l_partkey", "l_linenumber", *[c.alias(n) for n, c in columns.items()])


@register("pad_numeric_label", f"select {KEYS}, {PADDED_TEXT} as label from {MESSY_WHOLE}")
def pad_numeric_label(spark, sf_dir):
    return keyed(messy(spark, sf_dir), label=C.pad_numeric_label(F.col("text")))


@register("null_missing_label", f"select {KEYS}, case when text not in ('',' ','nan','None','Null','<NA>') then text end as label from messy")
def null_missing_label(spark, sf_dir):
    return keyed(messy(spark, sf_dir), label=C.null_missing_label(F.col("text")))


@register(
    "remove_invalid_tokens",
    f"""select {KEYS}, array_to_string(list_sort(list_distinct(list_filter([text, substr(cast(l_partkey as varchar),1,1)],
    lambda x: x not in ('-9','4+','','.',' ','NAN','NaN','nan','None','Null','<NA>')))),';') as codes from messy""",
)
def remove_invalid_tokens(spark, sf_dir):
    texts = F.array(F.col("text"), F.substring(F.col("l_partkey").cast("string"), 1, 1), F.lit(None).cast("string"))
    return keyed(messy(spark, sf_dir), codes=S.set_text(S.code_set(texts, T.ArrayType(STRING))))


@register("parse_codes", f"select {KEYS}, array_to_string(list_sort({sql.parse('text')}),';') as codes from messy")
def parse_codes(spark, sf_dir):
    return keyed(messy(spark, sf_dir), codes=S.set_text(C.parse_codes(F.col("text"))))


def one_code_sql(digits: int) -> str:
    """Each line's text taken as one single code."""
    per_text = sql.cleaned("select text, text as token from messy group by 1", "text")
    return f"""select {KEYS}, coalesce(c.codes,'') as codes from messy left join
        (select text as t, string_agg(distinct value,';' order by value) as codes from ({per_text}) where digits={digits} group by 1) c on c.t=text"""


def one_code(digits: int):
    def run(spark, sf_dir):
        found = views.hierarchy(spark, sf_dir).clean_one_code(messy(spark, sf_dir), "text", digits)
        return keyed(found, codes=S.set_text(F.col("codes")))

    return run


register("expand_to_five_digits", one_code_sql(5))(one_code(5))
register("cut_to_two_digits", one_code_sql(2))(one_code(2))
register("section_of_code", one_code_sql(0))(one_code(0))


def code_sets_sql(digits: int) -> str:
    per_text = sql.cleaned(f"select text, unnest({sql.parse('text')}) as token from (select text from messy group by 1)", "text")
    return f"""select {KEYS}, coalesce(c.codes,'') as codes from messy left join
        (select text as t, string_agg(distinct value,';' order by value) as codes from ({per_text}) where digits={digits} group by 1) c on c.t=text"""


def code_sets(digits: int):
    def run(spark, sf_dir):
        rows = ["l_orderkey", "l_partkey", "l_linenumber", "text"]
        # One-digit codes mean up to ten thousand five-digit ones, which are long to write for every line.
        lines = alike_together(messy(spark, sf_dir), rows, "text") if digits == CODE_LENGTH else messy(spark, sf_dir)
        cleaned = views.hierarchy(spark, sf_dir).clean_code_sets(lines, rows, [text_side("text", "codes")], [digits])
        found = rows_per_level(cleaned, digits)
        return keyed(found, codes=S.set_text(F.col("codes")))

    return run


register("clean_code_sets_five_digits", code_sets_sql(5))(code_sets(5))
register("clean_code_sets_three_digits", code_sets_sql(3))(code_sets(3))
register("clean_code_sets_sections", code_sets_sql(0))(code_sets(0))


@register("keep_valid_codes", f"select {KEYS}, text from messy where text in (select code from valid)")
def keep_valid_codes(spark, sf_dir):
    return keyed(views.hierarchy(spark, sf_dir).keep_valid(messy(spark, sf_dir), "text"), text=F.col("text"))


@register("valid_codes", "select code from valid")
def valid_codes(spark, sf_dir):
    return views.hierarchy(spark, sf_dir).valid_codes()


@register("section_lookup", "select distinct substr(code,1,2) as division, section from hierarchy")
def section_lookup(spark, sf_dir):
    return views.hierarchy(spark, sf_dir).section_lookup()


@register("hierarchy_lookup", "select cast(digits as bigint) as level, prefix, string_agg(distinct value,';' order by value) as codes from lookup group by all")
def hierarchy_lookup(spark, sf_dir):
    found = views.hierarchy(spark, sf_dir).lookup([0, 1, 2, 3, 4, 5])
    return found.select(F.col("level").cast("bigint").alias("level"), "prefix", S.set_text(F.col("codes")).alias("codes"))


@register("label_division", "select unique_id, substr(m1,1,2) as division from coded")
def label_division(spark, sf_dir):
    return views.coded(spark, sf_dir).select("unique_id", C.division(F.col("m1")).alias("division"))


def flags(spark, sf_dir):
    return add_quality_flags(views.clerical(spark, sf_dir))


@register("special_code_flags", 'select unique_id, not_codeable as "Not_Codeable", four_or_more as "Four_Or_More" from flagged')
def special_code_flags(spark, sf_dir):
    return flags(spark, sf_dir).select("unique_id", "Not_Codeable", "Four_Or_More")


@register("leading_division", 'select unique_id, division as "SIC_Division" from flagged')
def leading_division(spark, sf_dir):
    return flags(spark, sf_dir).select("unique_id", "SIC_Division")


@register("answer_count", "select unique_id, cast(num_answers as bigint) as num_answers from flagged")
def answer_count(spark, sf_dir):
    return flags(spark, sf_dir).select("unique_id", F.col("num_answers").cast("bigint").alias("num_answers"))


@register("digit_match_flags", 'select unique_id, match5 as "Match_5_digits", match3 as "Match_3_digits", match2 as "Match_2_digits" from flagged')
def digit_match_flags(spark, sf_dir):
    return flags(spark, sf_dir).select("unique_id", "Match_5_digits", "Match_3_digits", "Match_2_digits")


@register("unambiguous_flag", 'select unique_id, num_answers=1 and match5 as "Unambiguous" from flagged')
def unambiguous_flag(spark, sf_dir):
    return flags(spark, sf_dir).select("unique_id", "Unambiguous")


@register(
    "clerical_code_array",
    """select unique_id, array_to_string(list_transform([sic_ind_occ1,sic_ind_occ2,sic_ind_occ3], lambda x: coalesce(x,'?')),';') as codes from coded""",
)
def clerical_code_array(spark, sf_dir):
    return flags(spark, sf_dir).select("unique_id", F.array_join("All_Clerical_codes", ";", "?").alias("codes"))


@register(
    "quality_flags",
    """select unique_id, not_codeable as "Not_Codeable", four_or_more as "Four_Or_More", division as "SIC_Division",
    cast(num_answers as bigint) as num_answers, match5 as "Match_5_digits", match3 as "Match_3_digits", match2 as "Match_2_digits",
    num_answers=1 and match5 as "Unambiguous" from flagged""",
)
def quality_flags(spark, sf_dir):
    return flags(spark, sf_dir).drop("All_Clerical_codes", "sic_ind_occ1", "sic_ind_occ2", "sic_ind_occ3").withColumn(
        "num_answers", F.col("num_answers").cast("bigint")
    )


@register("score_as_number", 'select unique_id, "SA_score_1" as first_score, "SA_score_2" as second_score from repeated')
def score_as_number(spark, sf_dir):
    rows = views.repeated_wide(spark, sf_dir)
    return rows.select(
        "unique_id", C.to_number(F.col("SA_score_1"), STRING).alias("first_score"), C.to_number(F.col("SA_score_2"), STRING).alias("second_score")
    )


@register("row_max_score", "select unique_id, greatest(s1,s2,s3) as max_score from coded")
def row_max_score(spark, sf_dir):
    return views.coded(spark, sf_dir).select("unique_id", C.row_max([F.col(c) for c in ("s1", "s2", "s3")]).alias("max_score"))


@register("join_code_columns", "select unique_id, sic_ind_occ as codes from clerical_text")
def join_code_columns(spark, sf_dir):
    return views.clerical(spark, sf_dir).select("unique_id", C.join_codes("sic_ind_occ1", "sic_ind_occ2", "sic_ind_occ3").alias("codes"))


@register(
    "ratios_and_rounding",
    f"""select o_custkey, {sql.share('f','n')} as share, case when n=0 then 0.0::double else 100*cast(f as double)/n end as percentage,
    round_even((case when n=0 then 0.0::double else 100*cast(f as double)/n end)*10,0)/10 as rounded,
    {sql.share('f','n-n')} as nothing from (select o_custkey, count(*) filter (where o_orderstatus='F') as f, count(*) as n from orders group by 1)""",
)
def ratios_and_rounding(spark, sf_dir):
    counts = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count(F.lit(1)).alias("n")
    )
    f, n = F.col("f"), F.col("n")
    return counts.select(
        "o_custkey", stats.ratio(f, n).alias("share"), stats.percent(f, n).alias("percentage"),
        stats.round_half_even(stats.percent(f, n), 1).alias("rounded"), stats.ratio(f, n - n).alias("nothing"),
    )


@register(
    "digit_level_label",
    "select case when l_linenumber=1 then 'S' else cast(l_linenumber-1 as varchar) end as digits, cast(count(*) as bigint) as n from lineitem group by 1",
)
def digit_level_label(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return lines.groupBy(C.digits_label(F.col("l_linenumber") - 1).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "relabel_answer_count",
    "select case when num_answers=4 then '4+' else cast(num_answers as varchar) end as answers, cast(count(*) as bigint) as n from flagged group by 1",
)
def relabel_answer_count(spark, sf_dir):
    shown = C.relabel(F.col("num_answers"), {"4": "4+"})
    return flags(spark, sf_dir).groupBy(shown.alias("answers")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "wald_interval",
    """select o_custkey, 196e-2*sqrt(p*(1-p)/n) as ci from (select o_custkey, cast(count(*) filter (where o_orderstatus='F') as double)/count(*) as p,
    cast(count(*) as double) as n from orders group by 1)""",
)
def wald_interval(spark, sf_dir):
    counts = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count(F.lit(1)).alias("n")
    )
    return counts.select("o_custkey", stats.wald_half_width(stats.ratio(F.col("f"), F.col("n")), F.col("n")).alias("ci"))


@register("text_flag", "select unique_id, case lower(unamb) when 'true' then true when 'false' then false end as flag from padded")
def text_flag(spark, sf_dir):
    return views.wide(spark, sf_dir).select("unique_id", C.text_flag(F.col("Unambiguous")).alias("flag"))


@register(
    "clean_wide_table",
    "select unique_id, c1 as sic_ind_occ1, c2 as sic_ind_occ2, c3 as sic_ind_occ3, m1, m2, m3 from padded where lower(unamb)='true'",
)
def clean_wide(spark, sf_dir):
    config = ColumnConfig(**{**WIDE_CONFIG.__dict__, "filter_unambiguous": True})
    cleaned = clean_wide_table(views.wide(spark, sf_dir), config)
    return cleaned.select("unique_id", *config.clerical_label_cols, *config.model_label_cols)


def outcomes(case: str, checks: dict[tuple[str, str], str | None]) -> str:
    """One row per outcome: the number of the rows named, null for an outcome about columns."""
    rows = [
        f"select '{case}' as case, '{check}' as check, '{subject}' as subject, "
        + (f"(select cast(count(*) as bigint) from {found}) as rows" if found else "cast(null as bigint) as rows")
        for (check, subject), found in checks.items()
    ]
    return " union all ".join(rows)


VALIDATIONS = {
    # As it should be, but for texts where scores belong.
    "texts": (REPEATED_CONFIG, {
        ("score read as number", "SA_score_1"): None, ("score read as number", "SA_score_2"): None,
        ("rows", "table"): "repeated", ("null id", "unique_id"): "repeated where unique_id is null",
        ("unreadable score", "SA_score_1"): "events where isnan(value)", ("unreadable score", "SA_score_2"): "events where event_type = 'error'",
        **{("missing label", c): f'repeated where "{c}" is null' for c in ("SA_1", "SA_2", "CC_1", "CC_2")},
    }),
    # Columns that stop an analysis, numbers where labels belong, and a flag that is no flag.
    "columns": (ColumnConfig(["user_id", "kind"], ["value"], ["event_id"], id_col="event_id", filter_unambiguous=True), {
        ("missing column", "kind"): None, ("unpaired columns", "2 labels, 1 scores"): None,
        ("label read as text", "user_id"): None, ("label read as text", "event_id"): None,
        ("rows", "table"): "events", ("null id", "event_id"): "events where event_id is null", ("unreadable score", "value"): "events where isnan(value)",
        ("missing label", "user_id"): "events where user_id is null", ("missing label", "event_id"): "events where event_id is null",
        ("unreadable flag", "Unambiguous"): "events where event_type not in ('true', 'false')",
    }),
}


def validated(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return {"texts": views.repeated_wide(spark, sf_dir), "columns": events.withColumn("Unambiguous", F.col("event_type"))}


@register("validation_report", " union all ".join(outcomes(case, checks) for case, (_, checks) in VALIDATIONS.items()))
def validation_outcomes(spark, sf_dir):
    reports = [
        validation_report(df, VALIDATIONS[case][0]).select(F.lit(case).alias("case"), "check", "subject", "rows")
        for case, df in validated(spark, sf_dir).items()
    ]
    return reports[0].unionByName(reports[1])


@register(
    "observed_cells",
    " union all ".join(
        f"select '{check if subject == 'table' else check + ': ' + subject}' as cells, (select cast(count(*) as bigint) from {found}) as rows"
        for (check, subject), found in VALIDATIONS["texts"][1].items() if found
    ),
)
def observed_cells(spark, sf_dir):
    """Counts of unusable cells, gathered while the table is cleaned and written."""
    watched, cells = observe_cells(views.repeated_wide(spark, sf_dir), REPEATED_CONFIG)
    written(clean_wide_table(watched, REPEATED_CONFIG))
    return spark.createDataFrame(sorted(cells.get.items()), "cells string, rows bigint")


@register(
    "response_shapes",
    """with bodies as (select event_id, case when event_type='purchase' then '{"results":[{"classified":true}]}' when event_type='view'
    then '{"results":[{"classified":0},{}]}' when event_type='signup' then '{"results":[]}' when event_type='click' then '{"error":"not found"}' else '{"results":[' end as body from events)
    select event_id, case json_type(b, '$.results[0].classified') when 'BOOLEAN' then 'boolean' when 'UBIGINT' then 'number' end as classified_type,
    cast(coalesce(json_array_length(b, '$.results'), 0) as bigint) as n_results, b is null as malformed
    from (select event_id, case when json_valid(body) then body end as b from bodies)""",
)
def response_shapes(spark, sf_dir):
    return selection.response_shapes(views.stored_responses(spark, sf_dir), "body", ["event_id"])
