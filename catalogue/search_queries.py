"""Semantic search results, cumulative curves and the profile reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import sql, views
from catalogue.agreement_queries import ALL_LEVELS, LEVELS, LEVEL_NAME, pair, pairs_sql, unpivoted
from catalogue.column_queries import WIDE_CONFIG, flags
from catalogue.registry import register
from codetally.functions import sets as S
from codetally.operators import metrics as M
from codetally.operators import quality, semantic
from codetally.operators.prepare import prepare_clerical_codes, stack_methods
from codetally.plans import reports
from codetally.plans.evaluation import accuracy_table
from codetally.plans.search import nearest_candidate_curves, nearest_candidates, shortlist_codes, shortlist_sweep


def confidences(levels: str) -> str:
    """Ranked candidates with likelihood, per method, record and level."""
    return f"""select method, unique_id, digits, case when raw=1 then full_code else prefix end as code, distance,
        case when raw=1 then 1.0::double else greatest(0.0::double, 1 - distance/two - distance*4e-1 - rk*1e-1) end as likelihood, rk from (
        select *, sum(case when rk<2 then distance else 0.0::double end) over (partition by method, unique_id, digits) + 1e-5 as two from (
        select *, row_number() over (partition by method, unique_id, digits order by distance, prefix) - 1 as rk from (
        select method, unique_id, digits, prefix, min(distance) as distance, any_value(raw) as raw, any_value(code) as full_code from (
        select *, substr(code,1,case when digits=0 then 2 else digits end) as prefix, count(*) over (partition by method, unique_id, digits) as raw
        from search, (select unnest([{levels}]) as digits)) group by 1,2,3,4)))"""


def stacked(spark, sf_dir):
    return stack_methods(views.searches(spark, sf_dir))


def ranked(spark, sf_dir, digits):
    results = semantic.distance_to_confidence(F.col("semantic_search_results"), F.lit(digits))
    return stacked(spark, sf_dir).select("method", "unique_id", results.alias("candidates"))


@register(
    "distance_to_confidence",
    f"select method, unique_id, cast(rk as bigint) as rank, code, distance, round(likelihood,9) as likelihood from ({confidences('3')})",
)
def distance_to_confidence(spark, sf_dir):
    rows = ranked(spark, sf_dir, 3).select("method", "unique_id", F.posexplode("candidates").alias("rank", "c"))
    return rows.select(
        "method", "unique_id", F.col("rank").cast("bigint").alias("rank"), "c.code", "c.distance", F.round("c.likelihood", 9).alias("likelihood")
    )


@register("shortlist", f"select method, unique_id, code, distance from ({confidences('2')}) where rk<3")
def shortlist(spark, sf_dir):
    return ranked(spark, sf_dir, 2).select("method", "unique_id", F.inline(S.shortlist(F.col("candidates"), 3))).drop("likelihood")


@register("rank_in_list", f"select method, unique_id, code, cast(rk as bigint) as rank from ({confidences('5')})")
def rank_in_list(spark, sf_dir):
    """Zero-based place of each candidate, the basis of the rank penalty."""
    rows = ranked(spark, sf_dir, 5).select("method", "unique_id", F.posexplode("candidates").alias("rank", "c"))
    return rows.select("method", "unique_id", "c.code", F.col("rank").cast("bigint").alias("rank"))


NEAREST = """select method, unique_id, distance as top_distance, code as top_code from (
    select *, row_number() over (partition by method, unique_id order by distance, code) as rn from search) where rn=1"""


@register(
    "top_candidate",
    f"""select n.method, n.unique_id, top_distance, l.value as top_candidate from ({NEAREST}) n join lookup l on l.digits=0 and l.prefix=substr(top_code,1,2)""",
)
def top_candidate(spark, sf_dir):
    found = semantic.top_candidate(stacked(spark, sf_dir), views.hierarchy(spark, sf_dir), "semantic_search_results", 0)
    return found.select("method", "unique_id", "top_distance", S.set_text(F.col("top_candidate")).alias("top_candidate"))


def nearest_sql(levels: str) -> str:
    return f"""select n.method, n.unique_id, t.digits, n.top_distance, t.codes as t,
        coalesce(list_contains(t.codes, case when t.digits=0 then l.value else substr(top_code,1,t.digits) end), false) as top_in_truth
        from ({NEAREST}) n join ({sql.human_sets(levels=levels)}) t on t.unique_id=n.unique_id
        left join (select distinct prefix, value from lookup where digits=0 and length(prefix)=2) l on l.prefix=substr(top_code,1,2)"""


def nearest(spark, sf_dir):
    return nearest_candidates(
        views.searches(spark, sf_dir), views.clerical(spark, sf_dir, alone=True), views.hierarchy(spark, sf_dir), [5, 0], unique_ids=True
    ).withColumn("digits", F.col("digits").cast("bigint"))


@register("top_in_truth", f"select method, unique_id, cast(digits as bigint) as digits, top_distance, top_in_truth from ({nearest_sql('5,0')})")
def top_in_truth(spark, sf_dir):
    return nearest(spark, sf_dir).select("method", "unique_id", "digits", "top_distance", "top_in_truth")


@register(
    "top_in_truth_counts",
    f"""select method, cast(digits as bigint) as digits, top_distance, top_in_truth, count(*) as records
    from ({nearest_sql('5,0')}) group by all""",
)
def top_in_truth_counts(spark, sf_dir):
    return nearest(spark, sf_dir).groupBy("method", "digits", "top_distance", "top_in_truth").agg(F.sum("records").alias("records"))


def curve_sql(source: str, series: str) -> str:
    return f"""select {series}, distance as distance_threshold, cast(n as bigint) as subset_total, cast(m as bigint) as match_count,
        cast(n as double)/total as codability, cast(m as double)/n as accuracy from (
        select {series}, distance, sum(n) over w as n, sum(m) over w as m, sum(n) over (partition by {series}) as total from (
        select {series}, distance, count(*) as n, count(*) filter (where hit) as m from ({source}) group by all)
        window w as (partition by {series} order by distance rows unbounded preceding))"""


CURVES = curve_sql(
    f"""select digits, method, 'MO' as match_type, top_distance as distance, top_in_truth as hit from ({nearest_sql('5,0')})
    union all select digits, method, 'OO', top_distance, top_in_truth from ({nearest_sql('5,0')}) where len(t)=1""",
    "digits, method, match_type",
)
SHOWN = "case when digits=0 then 'S' else cast(digits as varchar) end as digits, * exclude (digits)"


@register("cumulative_curves", f"select {SHOWN} from ({CURVES})")
def cumulative_curves(spark, sf_dir):
    return nearest_candidate_curves(
        views.searches(spark, sf_dir), views.clerical(spark, sf_dir, alone=True), views.hierarchy(spark, sf_dir), [5, 0], unique_ids=True
    )


@register("curves_without_small_samples", f"select {SHOWN} from ({CURVES}) where codability>1e-1")
def curves_without_small_samples(spark, sf_dir):
    return semantic.drop_small_samples(cumulative_curves(spark, sf_dir))


@register(
    "cumulative_curve_of_lines",
    curve_sql("select l_returnflag as method, l_extendedprice/100000 as distance, l_discount>5e-2 as hit from lineitem", "method"),
)
def cumulative_curve_of_lines(spark, sf_dir):
    """A few long series with nearly as many points as rows."""
    points = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("method"), (F.col("l_extendedprice") / 100000).alias("top_distance"),
        (F.col("l_discount") > 0.05).alias("top_in_truth"),
    )
    return semantic.cumulative_curve(points, ["method"])


@register(
    "cumulative_curve_of_prices",
    "select * from (" + curve_sql(
        "select l_returnflag as method, case when l_linenumber<6 then l_extendedprice end as distance, l_discount>5e-2 as hit from lineitem", "method"
    ) + ") where distance_threshold is not null",
)
def cumulative_curve_of_prices(spark, sf_dir):
    """Distances in the thousands, some missing, some not a number."""
    distance = F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice").cast("double")).when(F.col("l_linenumber") == 6, F.lit(float("nan")))
    points = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("method"), distance.alias("top_distance"), (F.col("l_discount") > 0.05).alias("top_in_truth")
    )
    return semantic.cumulative_curve(points, ["method"])


@register(
    "last_point_per_distance",
    "select l_quantity as distance_threshold, cast(sum(count(*)) over (order by l_quantity rows unbounded preceding) as bigint) as subset_total from lineitem group by 1",
)
def last_point_per_distance(spark, sf_dir):
    """Rows at the same distance become the one point a keep-last de-duplication would leave."""
    points = views.table(spark, sf_dir, "lineitem").select(
        F.lit("all").alias("series"), F.col("l_quantity").alias("top_distance"), F.lit(True).alias("top_in_truth")
    )
    return semantic.cumulative_curve(points, ["series"]).select("distance_threshold", "subset_total")


SHORTLISTED = f"""select method, unique_id, digits, size, list(distinct value) as codes from (
    select c.method, c.unique_id, c.digits, s.size, l.value from ({confidences(ALL_LEVELS)}) c
    join (select unnest(['5','10','All']) as size, unnest([5,10,1000000]) as length) s on c.rk<s.length
    join lookup l on l.digits=c.digits and l.prefix=substr(c.code,1,case when c.digits=0 then 2 else c.digits end)) group by 1,2,3,4"""
SHORTLIST_SETS = f"""select b.method, b.unique_id, b.digits, b.size, coalesce(s.codes,{sql.EMPTY}) as m from
    (select distinct method, unique_id, digits, size from search, (select unnest([{ALL_LEVELS}]) as digits), (select unnest(['5','10','All']) as size)) b
    left join ({SHORTLISTED}) s on s.method=b.method and s.unique_id=b.unique_id and s.digits=b.digits and s.size=b.size"""
SHORTLIST_JOINED = f"""select s.method, s.digits, s.size as shortlist_size, s.m, t.codes as t from ({SHORTLIST_SETS}) s
    join ({sql.human_sets(levels=ALL_LEVELS)}) t on t.unique_id=s.unique_id and t.digits=s.digits"""


@register(
    "shortlist_codes",
    f"select method, unique_id, cast(digits as bigint) as digits, size as shortlist_size, array_to_string(list_sort(m),';') as initial_codes from ({SHORTLIST_SETS}) where digits=3",
)
def shortlisted_codes(spark, sf_dir):
    codes = shortlist_codes(stacked(spark, sf_dir), views.hierarchy(spark, sf_dir), [3])
    return codes.select("method", "unique_id", F.col("digits").cast("bigint").alias("digits"), "shortlist_size", S.set_text(F.col("initial_codes")).alias("initial_codes"))


def search_sweep(spark, sf_dir):
    return shortlist_sweep(
        views.searches(spark, sf_dir), views.clerical(spark, sf_dir, alone=True), views.hierarchy(spark, sf_dir), LEVELS, unique_ids=True
    )


SHORTLIST_METRICS = sql.metrics_over(SHORTLIST_JOINED, "digits, method, shortlist_size")


@register("shortlist_sweep", SHORTLIST_METRICS)
def shortlist_sweep_metrics(spark, sf_dir):
    by = ["digits", "method", "shortlist_size"]
    return M.flatten_metrics(search_sweep(spark, sf_dir), by)


@register(
    "shortlist_accuracy_table",
    unpivoted(
        SHORTLIST_METRICS, f"{LEVEL_NAME} as digits, method, shortlist_size",
        {"OM Accuracy": "initial_accuracy_om_unambiguous", "MM Accuracy": "initial_accuracy_mm_total"},
    ),
)
def shortlist_accuracy_table(spark, sf_dir):
    return accuracy_table(search_sweep(spark, sf_dir), ["method", "shortlist_size"], ("OM", "MM"))


@register(
    "clerical_codability",
    f"""select {LEVEL_NAME} as digits, cast(clear as double)/total as codability from (select t.digits, count(*) filter (where len(t.codes)=1 and c.initial_code is not null) as clear,
    count(*) as total from ({sql.human_sets(levels='5,0')}) t join coded c on c.unique_id=t.unique_id group by 1)""",
)
def clerical_codability(spark, sf_dir):
    """Clearly coded records among those a model coded, over all coded records."""
    truth = prepare_clerical_codes(views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir), digits=[5, 0], unique_ids=True)
    modelled = views.model_output(spark, sf_dir).filter(F.col("initial_code").isNotNull()).select("unique_id")
    return semantic.clerical_codability(truth.join(modelled, "unique_id", "left_semi"), truth)


# --- profile reports -------------------------------------------------------------------------------

GROUPS = [
    ("Uncodeable", "num_answers=0"), ("4+ Codes", "num_answers=4"), ("Codeable to 2 digits only", "match2"), ("Codeable to 3 digits only", "match3"),
    ("Codeable unambiguously to 5 digits", "num_answers=1 and match5"),
    ("Codeable ambiguously to 5 digits", "match5 and not (num_answers=1 and match5)"),
]
KNOWN = "+".join(f"count(*) filter (where {c})" for _, c in GROUPS)
MEMBERSHIP = " union all ".join(
    [f"select {i}::bigint as position, '{name}' as category, count(*) filter (where {c}) as n, count(*) as total from flagged" for i, (name, c) in enumerate(GROUPS)]
    + [f"select 6, 'Other', count(*)-({KNOWN}), count(*) from flagged", "select 7, 'Total', count(*), count(*) from flagged"]
)


@register("group_membership", f"select position, category, cast(n as bigint) as count, cast(n as double)/total*100 as percentage from ({MEMBERSHIP})")
def group_membership(spark, sf_dir):
    table = quality.group_membership(flags(spark, sf_dir))
    return table.withColumn("position", F.col("position").cast("bigint"))


def frequency_sql(value: str, source: str, amount: str, n: int = 10, shown: str = "value") -> str:
    counts = f"select cast({value} as varchar) as value, count(*) as n from {source} where {value} is not null group by 1"
    return f"""select position, {shown} as value, {amount} as amount, cast(listed as double)/total*100 as top_percent from (
        select position, value, n, total, listed from (select *, row_number() over (order by n desc, value) as position, sum(n) over () as total,
        (select sum(n) from (select n from ({counts}) order by n desc limit {n})) as listed from ({counts})) where position<={n}
        union all select least({n}, (select count(*) from ({counts})))+1, 'Others', (select sum(n) from ({counts}))-(select sum(n) from (select n from ({counts}) order by n desc limit {n})),
        (select sum(n) from ({counts})), (select sum(n) from (select n from ({counts}) order by n desc limit {n})))"""


SHARE = "cast(n as double)/total*100"


@register("division_frequencies", frequency_sql("division", "flagged", SHARE))
def division_frequencies(spark, sf_dir):
    return positioned(quality.frequency_table(flags(spark, sf_dir), "SIC_Division", show_percent=True))


@register("code_frequencies", frequency_sql("m1", "coded", "cast(n as double)"))
def code_frequencies(spark, sf_dir):
    return positioned(quality.frequency_table(views.coded(spark, sf_dir), "m1"))


@register("answer_frequencies", frequency_sql("num_answers", "flagged", SHARE, shown="case when value='4' then '4+' else value end"))
def answer_frequencies(spark, sf_dir):
    return positioned(quality.frequency_table(flags(spark, sf_dir), "num_answers", show_percent=True, labels={"4": "4+"}))


def positioned(table):
    return table.withColumn("position", F.col("position").cast("bigint"))


@register("division_share", "select 100*cast(count(*) filter (where division in ('86','87','10')) as double)/count(*) as percent from flagged")
def division_share(spark, sf_dir):
    return quality.division_share(flags(spark, sf_dir), ["86", "87", "10"])


@register("single_answer_share", "select 100*cast(count(*) filter (where num_answers=1) as double)/count(*) as percent from flagged")
def single_answer_share(spark, sf_dir):
    return quality.single_answer_share(flags(spark, sf_dir))


@register(
    "flag_counts",
    " union all ".join(
        f"select '{name}' as flag, {expr} as value, cast(count(*) as bigint) as count from flagged group by 1,2"
        for name, expr in {"Match_5_digits": "match5", "Match_3_digits": "match3", "Match_2_digits": "match2", "Unambiguous": "num_answers=1 and match5"}.items()
    ),
)
def flag_counts(spark, sf_dir):
    return quality.flag_counts(flags(spark, sf_dir))


@register(
    "data_profile",
    f"select 'groups' as report, category as value, cast(n as double)/total*100 as amount from ({MEMBERSHIP}) "
    f"union all select 'divisions', value, amount from ({frequency_sql('division', 'flagged', SHARE)}) "
    f"union all select 'codes', value, amount from ({frequency_sql('sic_ind_occ1', '(select * from flagged where num_answers=1 and match5)', SHARE)}) "
    f"union all select 'answers', value, amount from ({frequency_sql('num_answers', 'flagged', SHARE, shown='''case when value='4' then '4+' else value end''')})",
)
def data_profile(spark, sf_dir):
    """The profile's tables under each other."""
    tables = reports.data_profile(flags(spark, sf_dir), ["86", "87"])
    parts = {
        "groups": tables["group_membership"].select(F.col("category").alias("value"), F.col("percentage").alias("amount")),
        "divisions": tables["divisions"].select("value", "amount"),
        "codes": tables["unambiguous_codes"].select("value", "amount"),
        "answers": tables["num_answers"].select("value", "amount"),
    }
    return stack_methods(parts, "report")


@register(
    "alignment_report",
    """select 'full' as report, cast(count(*) filter (where is_correct and max_score>=0) as double) as amount from aligned
    union all select '2-digit', cast(count(*) filter (where is_correct_2_digit and max_score>=0) as double) from aligned
    union all select 'm3', cast(count(m3) as double) from aligned""",
)
def alignment_report(spark, sf_dir):
    """Matches from three tables of the label report."""
    tables = reports.alignment_report(views.wide(spark, sf_dir), WIDE_CONFIG, unique_ids=True)
    parts = {
        "full": tables["full_accuracy"].select(F.col("matches").cast("double").alias("amount")),
        "2-digit": tables["two_digit_accuracy"].select(F.col("matches").cast("double").alias("amount")),
        "m3": tables["contribution_m3"].select(F.col("total_predictions_made").cast("double").alias("amount")),
    }
    return stack_methods(parts, "report").select("report", "amount")


@register("confusion_report", f"select clerical_codes, initial_codes, cast(count(*) as bigint) as count from ({pairs_sql(0, 'len(t)=1 and len(m)=1')}) group by 1,2")
def confusion_report(spark, sf_dir):
    return reports.confusion_report(pair(spark, sf_dir, digits=0), digits=0)["single"]


@register(
    "request_batch",
    """select o_orderkey as unique_id, cast(json_object('llm','model-1','type','sic','job_title',o_orderstatus,'job_description',o_orderpriority) as varchar) as request_payload
    from orders order by o_orderkey limit 50 offset 25""",
)
def request_batch(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return reports.request_batch(
        orders, "o_orderkey", {"job_title": "o_orderstatus", "job_description": "o_orderpriority"}, ["o_orderkey"], views.REQUEST_CONSTANTS,
        skip=25, take=50,
    )
