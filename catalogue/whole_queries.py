"""Repeated and null ids under the oracle, and reports shown whole."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue import sql, views
from catalogue.agreement_queries import (
    FEW, LEVEL_NAME, METHOD_SETS, SECTIONS, SWEEP_METRICS, accuracy_sql, contribution_sql, counted, frequent_sql, pair, pairs_sql,
    summary_sql, swept,
)
from catalogue.column_queries import WIDE_CONFIG
from catalogue.registry import register
from catalogue.search_queries import NEAREST, SHORTLIST_SETS, SHOWN, curve_sql
from catalogue.source_queries import THRESHOLDS
from codetally.lineage import scratch
from codetally.operators import metrics as M
from codetally.plans import reports
from codetally.plans.evaluation import evaluate, model_points, sweep
from codetally.plans.search import curves_beside_model, nearest_candidate_curves, shortlist_sweep
from codetally.sources import writers

# --- ids that repeat, one of them often, and null ids ------------------------------------------------

USER_KEYS = "(select unique_id, case when unique_id%40=0 then null when unique_id%20=1 then 1 else 2+unique_id%3000 end as usr from coded)"


def by_user(df: DataFrame) -> DataFrame:
    """The same records under ids that repeat: one id on every twentieth record, none on every fortieth."""
    order = F.col("unique_id")
    user = F.when(order % 40 == 0, None).when(order % 20 == 1, 1).otherwise(2 + order % 3000)
    return df.withColumn("unique_id", user.cast("bigint"))


def pairs_of(model: str, truth: str, columns: str) -> str:
    """Every model row beside every human row of its user, at the same level."""
    return f"""select m.digits, {columns} from ({model}) m join {USER_KEYS} km on km.unique_id=m.unique_id
        join {USER_KEYS} kt on kt.usr is not distinct from km.usr join ({truth}) t on t.unique_id=kt.unique_id and t.digits=m.digits"""


@register("evaluate_repeated_ids", sql.metrics_over(pairs_of(sql.model_sets(levels="3"), sql.human_sets(levels="3"), "t.codes as t, m.codes as m")))
def evaluate_repeated_ids(spark, sf_dir):
    metrics = evaluate(
        by_user(views.model_output(spark, sf_dir)), by_user(views.clerical(spark, sf_dir)), views.hierarchy(spark, sf_dir), digits=3
    )
    return M.flatten_metrics(metrics)


@register(
    "sweep_repeated_ids",
    sql.metrics_over(
        pairs_of(f"select * from ({METHOD_SETS}) where method='m_b' and digits in (0,5)", sql.human_sets(levels="0,5"), "method, t.codes as t, m"),
        "digits, method",
    ),
)
def sweep_repeated_ids(spark, sf_dir):
    models = {"m_b": by_user(views.models(spark, sf_dir)["m_b"])}
    metrics = sweep(models, by_user(views.clerical(spark, sf_dir)), views.hierarchy(spark, sf_dir), [0, 5])
    return M.flatten_metrics(metrics, ["digits", "method"])


@register(
    "shortlist_sweep_repeated_ids",
    sql.metrics_over(
        pairs_of(
            f"select * from ({SHORTLIST_SETS}) where digits=3 and method='price'", sql.human_sets(levels="3"),
            "method, size as shortlist_size, t.codes as t, m",
        ),
        "digits, method, shortlist_size",
    ),
)
def shortlist_sweep_repeated_ids(spark, sf_dir):
    searches = {"price": by_user(views.searches(spark, sf_dir)["price"])}
    metrics = shortlist_sweep(searches, by_user(views.clerical(spark, sf_dir)), views.hierarchy(spark, sf_dir), [3])
    return M.flatten_metrics(metrics, ["digits", "method", "shortlist_size"])


REPEATED_HITS = f"""select n.method, '5' as digits, n.top_distance as distance, len(t.codes)=1 as clear,
    coalesce(list_contains(t.codes, substr(top_code,1,5)), false) as hit from ({NEAREST}) n join {USER_KEYS} km on km.unique_id=n.unique_id
    join {USER_KEYS} kt on kt.usr is not distinct from km.usr join ({sql.human_sets(levels='5')}) t on t.unique_id=kt.unique_id
    where n.method='price'"""
REPEATED_CURVES = curve_sql(
    f"select method, digits, 'MO' as match_type, distance, hit from ({REPEATED_HITS}) union all "
    f"select method, digits, 'OO', distance, hit from ({REPEATED_HITS}) where clear",
    "method, digits, match_type",
)


@register("curves_repeated_ids", f"select {SHOWN} from ({REPEATED_CURVES})")
def curves_repeated_ids(spark, sf_dir):
    searches = {"price": by_user(views.searches(spark, sf_dir)["price"])}
    return nearest_candidate_curves(searches, by_user(views.clerical(spark, sf_dir)), views.hierarchy(spark, sf_dir), [5])


# --- whole reports -----------------------------------------------------------------------------------


def long_form(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """All number columns of several tables as ``(report, at, metric, value)``."""
    parts = []
    for name, (table, key) in tables.items():
        numbers = [f.name for f in table.schema if f.name != key and f.dataType.simpleString() in ("bigint", "int", "double")]
        at = F.col(key).cast("double") if key else F.lit(None).cast("double")
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers])
        parts.append(table.select(F.lit(name).alias("report"), F.round(at, 6).alias("at"), F.inline(cells)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("value", F.round("value", 9))


def long_sql(tables: dict[str, tuple[str, str | None, list[str]]]) -> str:
    return " union all ".join(
        f"""select '{name}' as report, {f'round(cast({key} as double),6)' if key else 'null::double'} as at, '{c}' as metric,
        round(cast("{c}" as double),9) as value from ({source})"""
        for name, (source, key, columns) in tables.items()
        for c in columns
    )


ACCURACY = ["accuracy_percent", "matches", "non_matches", "total_considered"]
CONTRIBUTION = ["total_predictions_made", "primary_match_percent", "primary_match_count", "any_clerical_match_percent", "any_clerical_match_count"]
SUMMARY = ["total_samples", "overall_accuracy", *[f"{k}_above_0.{t}0" for k in ("accuracy", "coverage") for t in (5, 6, 7, 8)]]
JACCARD = """select avg(case when u=0 then 1.0::double else cast(i as double)/u end) as jaccard_similarity from (select
    len(list_distinct(list_filter([m1,m2,m3,c1,c2,c3], lambda x: x is not null))) as u,
    len(list_intersect(list_distinct(list_filter([m1,m2,m3], lambda x: x is not null)), list_filter([c1,c2,c3], lambda x: x is not null))) as i from padded)"""


@register(
    "alignment_report_whole",
    long_sql({
        "full_accuracy": (accuracy_sql("is_correct", "0"), None, ACCURACY),
        "two_digit_accuracy": (accuracy_sql("is_correct_2_digit", "0"), None, ACCURACY),
        "jaccard_similarity": (JACCARD, None, ["jaccard_similarity"]),
        "summary_statistics": (summary_sql(), None, SUMMARY),
        "threshold_statistics": (THRESHOLDS, "threshold", ["accuracy", "coverage"]),
        **{f"contribution_{m}": (contribution_sql("padded", m, ["c1", "c2", "c3"], m), None, CONTRIBUTION) for m in ("m1", "m2", "m3")},
    }),
)
def alignment_report_whole(spark, sf_dir):
    tables = reports.alignment_report(views.wide(spark, sf_dir), WIDE_CONFIG, unique_ids=True)
    return long_form({name: (table, "threshold" if name == "threshold_statistics" else None) for name, table in tables.items()})


def among_sql(pairs: str) -> str:
    frequent = f"select unnest([clerical_codes,initial_codes]) from ({frequent_sql(pairs)})"
    return f"select * from ({counted(pairs)}) where clerical_codes in ({frequent}) and initial_codes in ({frequent})"


SINGLE = "len(t)=1 and len(m)=1"


@register(
    "confusion_report_whole",
    f"""select '0 single' as report, * from ({counted(pairs_sql(0, SINGLE))}) union all select '0 few', * from ({counted(pairs_sql(0, FEW))})
    union all select '0 labels', label, null, null from (select distinct unnest(t) as label from ({sql.joined('0')}))
    union all select '3 single', * from ({among_sql(pairs_sql(3, SINGLE))}) union all select '3 few', * from ({among_sql(pairs_sql(3, FEW))})
    union all select '3 labels', label, null, null from (select distinct unnest(t) as label from ({sql.joined('3')}))""",
)
def confusion_report_whole(spark, sf_dir):
    """Both subsets and the labels, for sections and for three digits."""
    parts = []
    for digits in (0, 3):
        tables = reports.confusion_report(pair(spark, sf_dir, digits=digits), digits)
        labels = tables.pop("labels").select(F.col("label").alias("clerical_codes"))
        for name, table in {**tables, "labels": labels}.items():
            parts.append(table.withColumn("report", F.lit(f"{digits} {name}")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


@register(
    "section_report",
    f"""select *, 196e-2*sqrt(frequency*(1-frequency)/sample_size) as ci from (select *, cast(count as double)/sample_size as frequency from (
    select sic_section, source, cast(count(*) as bigint) as count, cast(sum(count(*)) over (partition by source) as bigint) as sample_size
    from ({SECTIONS.replace("chr(65 + cast(substr(o_orderpriority,1,1) as int)) as sic_section, 'Admin labels' as source from orders",
    "chr(65 + cast(unique_id%7 as int)) as sic_section, 'Admin labels' as source from coded")}) group by 1,2))""",
)
def section_report(spark, sf_dir):
    clerical = views.clerical(spark, sf_dir).withColumn("sic_section", F.chr(65 + F.col("unique_id") % 7))
    return reports.section_report(clerical, views.model_output(spark, sf_dir), views.hierarchy(spark, sf_dir), unique_ids=True)


POINTS = f"""select {LEVEL_NAME} as digits, method, codability_initial_codable_prop as codability, 'OO' as match_type,
    initial_accuracy_oo_unambiguous as accuracy from ({SWEEP_METRICS})
    union all select {LEVEL_NAME}, method, codability_initial_codable_prop, 'MO', initial_accuracy_mo_unambiguous from ({SWEEP_METRICS})"""


@register("model_points", POINTS)
def points_of_models(spark, sf_dir):
    """Codability and accuracy of every model, the points shown beside the curves."""
    return model_points(swept(spark, sf_dir))


@register(
    "curves_beside_model",
    f"""select digits, method, match_type, distance_threshold, subset_total, match_count, codability, accuracy from ({REPEATED_CURVES})
    union all select '5', 'one model', kind, null, null, null, codability, accuracy from (
    select 'OO' as kind, codability_initial_codable_prop as codability, initial_accuracy_oo_unambiguous as accuracy from (
    {sql.metrics_over(sql.joined('5', '7e-1'), 'digits')}) union all
    select 'MO', codability_initial_codable_prop, initial_accuracy_mo_unambiguous from ({sql.metrics_over(sql.joined('5', '7e-1'), 'digits')}))""",
)
def one_model_beside_curves(spark, sf_dir):
    metrics = sweep({"one model": views.model_output(spark, sf_dir)}, views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir), [5], unique_ids=True)
    return curves_beside_model(curves_repeated_ids(spark, sf_dir), metrics)


@register(
    "evaluation_run_whole",
    f"""select 'metadata' as part, 'evaluation_type' as name, 'thresholds' as text, null::double as value union all
    select 'metadata', 'records', cast(count(*) as varchar), null from coded union all
    select 'jaccard', 'jaccard_similarity', null, round(jaccard_similarity,9) from ({JACCARD}) union all
    select 'threshold_statistics', cast(cast(round(threshold*100) as bigint) as varchar), null, round(accuracy,9) from ({THRESHOLDS})""",
)
def evaluation_run_whole(spark, sf_dir):
    """Everything an evaluation run writes, metadata included, read back from its folder."""
    wide = views.wide(spark, sf_dir)
    tables = reports.alignment_report(wide, WIDE_CONFIG, unique_ids=True)
    shown = {"threshold_statistics": tables["threshold_statistics"], "jaccard": tables["jaccard_similarity"]}
    metadata = {"evaluation_type": "thresholds", "records": str(wide.count())}
    folder = writers.write_evaluation_run(spark, metadata, shown, scratch(spark), datetime(2025, 1, 1))
    stored = spark.read.text(f"{folder}/metadata").select(F.from_json("value", "map<string,string>").alias("m"))
    read = {name: spark.read.schema(t.schema).json(f"{folder}/evaluation_result/{name}") for name, t in shown.items()}
    none = F.lit(None)
    step = F.round(F.col("threshold") * 100).cast("bigint").cast("string")
    return (
        stored.select(F.lit("metadata").alias("part"), F.explode("m").alias("name", "text")).withColumn("value", none.cast("double"))
        .unionByName(read["jaccard"].select(F.lit("jaccard").alias("part"), F.lit("jaccard_similarity").alias("name"), none.cast("string").alias("text"), F.round("jaccard_similarity", 9).alias("value")))
        .unionByName(read["threshold_statistics"].select(F.lit("threshold_statistics").alias("part"), step.alias("name"), none.cast("string").alias("text"), F.round("accuracy", 9).alias("value")))
    )
