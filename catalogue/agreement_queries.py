"""Code sets, joins and agreement metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import sql, views
from catalogue.column_queries import REPEATED_CONFIG, aligned
from catalogue.registry import register
from codetally.config import ConfusionConfig
from codetally.fixed_values import MATCH_METHODS
from codetally.lineage import written
from codetally.functions import codes as C
from codetally.functions import sets as S
from codetally.operators import metrics as M
from codetally.operators import pairs as P
from codetally.operators import prepare
from codetally.operators.alignment import LabelAlignment, melt_labels, matches_on_key, spread_matrix, top_values
from codetally.operators.joins import attach_final_codes, compare_coder_rounds
from codetally.plans.evaluation import accuracy_table, ambiguity_table, evaluate, joined_codes, sweep

STRINGS = T.ArrayType(T.StringType())
SINGLE = "len(t)=1 and len(m)=1"
FEW = "len(t)<3 and len(m)<3 and not (len(t)=1 and len(m)=1)"


def text_of(codes: str, name: str) -> str:
    return f"array_to_string(list_sort({codes}),';') as {name}"


def pair(spark, sf_dir, digits=3, **options):
    """Human and model sets of each record."""
    return joined_codes(
        views.model_output(spark, sf_dir), views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir), digits=digits, unique_ids=True, **options
    )


def shown(df, *set_cols, keep=("unique_id",)):
    return df.select(*keep, *[S.set_text(F.col(c)).alias(c) for c in set_cols])


# --- sets ------------------------------------------------------------------------------------------


@register(
    "cast_to_code_set",
    """select unique_id, case when sic_ind_occ1 in ('-9','4+') or sic_ind_occ1 is null then '' else sic_ind_occ1 end as scalar_set,
    array_to_string(list_sort(list_distinct(list_filter([sic_ind_occ1,sic_ind_occ2,m1], lambda x: x is not null and x not in ('-9','4+')))),';') as list_set,
    cast(unique_id as varchar) as number_set from coded""",
)
def cast_to_code_set(spark, sf_dir):
    rows = views.coded(spark, sf_dir)
    return rows.select(
        "unique_id",
        S.set_text(S.code_set(F.col("sic_ind_occ1"), T.StringType())).alias("scalar_set"),
        S.set_text(S.code_set(F.array("sic_ind_occ1", "sic_ind_occ2", "m1"), STRINGS)).alias("list_set"),
        S.set_text(S.code_set(F.col("unique_id"), T.LongType())).alias("number_set"),
    )


@register(
    "compare_code_sets",
    f"""select unique_id, len(t)=1 and len(m)=1 and list_has_any(t,m) as "OO", len(t)=1 and list_has_any(t,m) as "OM",
    len(m)=1 and list_has_any(t,m) as "MO", list_has_any(t,m) as "MM" from ({sql.joined('3')})""",
)
def compare_code_sets(spark, sf_dir):
    both = pair(spark, sf_dir)
    return both.select(
        "unique_id", *[S.codes_match(F.col("clerical_codes"), F.col("initial_codes"), m).alias(m) for m in MATCH_METHODS]
    )


@register(
    "row_jaccard",
    """select unique_id, case when u=0 then 1.0::double else cast(i as double)/u end as jaccard from (select unique_id,
    len(list_distinct(list_filter([m1,m2,m3,c1,c2,c3], lambda x: x is not null))) as u,
    len(list_intersect(list_distinct(list_filter([m1,m2,m3], lambda x: x is not null)), list_filter([c1,c2,c3], lambda x: x is not null))) as i from padded)""",
)
def row_jaccard(spark, sf_dir):
    return aligned(spark, sf_dir).row_jaccard().select("unique_id", "jaccard")


@register("ambiguity_test", f"select unique_id, len(t)<>1 as clerical_ambiguous, len(m)<>1 as initial_ambiguous from ({sql.joined('3')})")
def ambiguity_test(spark, sf_dir):
    both = pair(spark, sf_dir)
    return both.select(
        "unique_id",
        S.is_ambiguous(F.col("clerical_codes")).alias("clerical_ambiguous"),
        S.is_ambiguous(F.col("initial_codes")).alias("initial_ambiguous"),
    )


def alternatives_only(spark, sf_dir, threshold):
    return prepare.prepare_model_codes(
        views.model_output(spark, sf_dir), views.hierarchy(spark, sf_dir), codes_col=None, threshold=threshold, digits=3
    )


@register(
    "pruned_candidate_sets",
    f"""select c.unique_id, {text_of(f'coalesce(p.codes,{sql.EMPTY})', 'model_codes')} from coded c
    left join (select * from ({sql.pruned_sets('scored_codes', '7e-1')}) where digits=3) p on p.unique_id=c.unique_id""",
)
def pruned_candidate_sets(spark, sf_dir):
    return shown(alternatives_only(spark, sf_dir, 0.7), "model_codes")


@register(
    "candidate_text_sets",
    f"select unique_id, {text_of('codes', 'model_codes')} from ({sql.human_sets('final_codes')}) where digits=4",
)
def candidate_text_sets(spark, sf_dir):
    """Alternatives given as text instead of an array."""
    codes = prepare.prepare_model_codes(
        views.model_output(spark, sf_dir, with_final=True), views.hierarchy(spark, sf_dir), codes_col=None, alt_codes_col="final_sic", digits=4
    )
    return shown(codes, "model_codes")


@register("only_member", f"select unique_id, case when len(t)=1 then t[1] end as code from ({sql.joined('3')})")
def only_member(spark, sf_dir):
    return pair(spark, sf_dir).select("unique_id", S.only_member(F.col("clerical_codes")).alias("code"))


@register("fill_empty_set", f"select unique_id, {text_of('case when len(t)=0 then m else t end', 'codes')} from ({sql.joined('3')})")
def fill_empty_set(spark, sf_dir):
    filled = pair(spark, sf_dir).withColumn("codes", S.fill_empty(F.col("clerical_codes"), F.col("initial_codes")))
    return shown(filled, "codes")


@register("prepare_model_codes", f"select unique_id, {text_of('codes', 'model_codes')} from ({sql.model_sets('7e-1')}) where digits=5")
def prepare_model_codes(spark, sf_dir):
    codes = prepare.prepare_model_codes(views.model_output(spark, sf_dir), views.hierarchy(spark, sf_dir), threshold=0.7)
    return shown(codes, "model_codes")


@register(
    "code_set_algebra",
    f"""select unique_id, array_to_string(list_sort(list_distinct(list_concat(t,m))),';') as either,
    array_to_string(list_sort(list_intersect(t,m)),';') as shared, array_to_string(list_sort(list_filter(t, lambda x: not list_contains(m,x))),';') as only_human
    from ({sql.joined('2')})""",
)
def code_set_algebra(spark, sf_dir):
    t, m = F.col("clerical_codes"), F.col("initial_codes")
    return pair(spark, sf_dir, digits=2).select(
        "unique_id",
        S.set_text(F.array_union(t, m)).alias("either"),
        S.set_text(F.array_intersect(t, m)).alias("shared"),
        S.set_text(F.array_except(t, m)).alias("only_human"),
    )


# --- joins -----------------------------------------------------------------------------------------


@register("override_from_side_table", "select unique_id, sic_ind_occ from overridden_text")
def override_from_side_table(spark, sf_dir):
    return prepare.clerical_text(views.clerical(spark, sf_dir), views.four_plus(spark, sf_dir))


OVERRIDDEN = sql.human_sets("overridden_codes", "select unique_id from overridden_text")


@register("prepare_clerical_codes", f"select unique_id, {text_of('codes', 'clerical_codes')} from ({OVERRIDDEN}) where digits=3")
def prepare_clerical_codes(spark, sf_dir):
    codes = prepare.prepare_clerical_codes(
        views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir), views.four_plus(spark, sf_dir), digits=3
    )
    return shown(codes, "clerical_codes")


@register(
    "prepare_clerical_codes_by_level",
    f"select unique_id, cast(digits as bigint) as digits, {text_of('codes', 'clerical_codes')} from ({sql.human_sets()}) where digits in (0,2,3,4,5)",
)
def prepare_clerical_codes_by_level(spark, sf_dir):
    codes = prepare.prepare_clerical_codes(
        views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir), digits=[0, 2, 3, 4, 5], unique_ids=True
    )
    return shown(codes.withColumn("digits", F.col("digits").cast("bigint")), "clerical_codes", keep=("unique_id", "digits"))


@register(
    "join_model_and_human",
    f"select unique_id, {text_of('t', 'clerical_codes')}, {text_of('m', 'initial_codes')} from ({sql.joined('3', truth=OVERRIDDEN)})",
)
def join_model_and_human(spark, sf_dir):
    """The join that assumes nothing about ids."""
    h = views.hierarchy(spark, sf_dir)
    both = joined_codes(views.model_output(spark, sf_dir), views.clerical(spark, sf_dir), h, views.four_plus(spark, sf_dir), digits=3)
    return shown(both, "clerical_codes", "initial_codes")


@register(
    "attach_final_codes",
    f"""select j.unique_id, {text_of('j.t', 'clerical_codes')}, {text_of(f'coalesce(f.codes,{sql.EMPTY})', 'final_codes')}
    from ({sql.joined('3')}) j left join (select unique_id, list(value) as codes from final_codes where digits=3 group by 1) f
    on f.unique_id=j.unique_id""",
)
def attach_final(spark, sf_dir):
    """Final codes only for the records that have any; the others get the empty set."""
    h = views.hierarchy(spark, sf_dir)
    outputs = views.model_output(spark, sf_dir, with_final=True)
    final = prepare.prepare_model_codes(outputs, h, codes_col=None, alt_codes_col="final_sic", out_col="final_codes", digits=3)
    return shown(attach_final_codes(pair(spark, sf_dir), final.filter(F.size("final_codes") > 0), "final_codes"), "clerical_codes", "final_codes")


@register(
    "compare_coder_rounds",
    f"""select a.unique_id, {text_of('a.codes', 'initial_codes')}, {text_of('b.codes', 'clerical_codes')}
    from ({sql.human_sets('first_round_codes')}) a join ({sql.human_sets()}) b on a.unique_id=b.unique_id and a.digits=b.digits where a.digits=2""",
)
def coder_rounds(spark, sf_dir):
    h = views.hierarchy(spark, sf_dir)
    first = prepare.prepare_clerical_codes(views.first_round(spark, sf_dir), h, digits=2, unique_ids=True)
    second = prepare.prepare_clerical_codes(views.clerical(spark, sf_dir), h, digits=2, unique_ids=True)
    return shown(compare_coder_rounds(first, second), "initial_codes", "clerical_codes")


MELTED = """select unique_id, k from (select unique_id, "SA_1" as k from repeated union all select unique_id, "SA_2" from repeated) where k is not null"""
MELTED_HUMAN = """select unique_id, k from (select unique_id, "CC_1" as k from repeated union all select unique_id, "CC_2" from repeated) where k is not null"""


def matched_ids(key: str) -> str:
    return f"""select distinct a.unique_id from (select distinct unique_id, {key} as k from ({MELTED})) a
        join (select distinct unique_id, {key} as k from ({MELTED_HUMAN})) b on a.unique_id=b.unique_id and a.k=b.k"""


@register("full_match_ids", matched_ids("k"))
def full_match_ids(spark, sf_dir):
    return matches_on_key(prepare.clean_labels(views.repeated_wide(spark, sf_dir), REPEATED_CONFIG.label_cols), REPEATED_CONFIG)


@register("two_digit_match_ids", matched_ids("substr(k,1,2)"))
def two_digit_match_ids(spark, sf_dir):
    rows = prepare.clean_labels(views.repeated_wide(spark, sf_dir), REPEATED_CONFIG.label_cols)
    return matches_on_key(rows, REPEATED_CONFIG, C.division)


@register(
    "match_flags_by_id",
    f"""select unique_id, "SA_1", "SA_2", unique_id in ({matched_ids('k')}) as is_correct,
    unique_id in ({matched_ids('substr(k,1,2)')}) as is_correct_2_digit, greatest("SA_score_1","SA_score_2") as max_score from repeated""",
)
def match_flags_by_id(spark, sf_dir):
    """Ids repeat here: one agreeing record makes all records of its id agree."""
    df = LabelAlignment(views.repeated_wide(spark, sf_dir), REPEATED_CONFIG).df
    return df.select("unique_id", "SA_1", "SA_2", "is_correct", "is_correct_2_digit", "max_score")


@register("match_flags_by_row", "select unique_id, is_correct, is_correct_2_digit from aligned")
def match_flags_by_row(spark, sf_dir):
    return aligned(spark, sf_dir).df.select("unique_id", "is_correct", "is_correct_2_digit")


@register(
    "hierarchy_join",
    "select p_partkey, code, section from (select p_partkey, lpad(cast((p_partkey*37)%100000 as varchar),5,'0') as code from part) "
    "join (select distinct substr(code,1,2) as division, section from hierarchy) on division=substr(code,1,2)",
)
def hierarchy_join(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select("p_partkey", views.code_of(F.col("p_partkey")).alias("code"))
    found = views.hierarchy(spark, sf_dir).clean_one_code(parts, "code", 0)
    return found.select("p_partkey", "code", S.only_member(F.col("codes")).alias("section"))


# --- reshaping -------------------------------------------------------------------------------------


@register(
    "melt_labels",
    "select unique_id, variable, label from (select unique_id, 'm1' as variable, m1 as label from coded union all select unique_id, 'm2', m2 from coded "
    "union all select unique_id, 'm3', m3 from coded) where label is not null",
)
def melt(spark, sf_dir):
    return melt_labels(views.coded(spark, sf_dir), "unique_id", ["m1", "m2", "m3"])


EXPLODED = f"""select unique_id, unnest(case when len(t)=0 then [null] else t end) as clerical_codes, m from ({sql.joined('2')}) where {FEW}"""


@register(
    "explode_both_sets",
    f"select unique_id, clerical_codes, unnest(case when len(m)=0 then [null] else m end) as initial_codes from ({EXPLODED})",
)
def explode_both_sets(spark, sf_dir):
    return P.explode_both(pair(spark, sf_dir, digits=2), "few").select("unique_id", "clerical_codes", "initial_codes")


def pairs_sql(digits: int, where: str = "true", threshold: str = "0.0::double") -> str:
    return f"""select clerical_codes, unnest(m) as initial_codes from (select unnest(t) as clerical_codes, m from ({sql.joined(str(digits), threshold)}) where {where})"""


LETTERS = [chr(65 + i) for i in range(21)]


@register(
    "spread_section_matrix",
    "select clerical_codes, " + ", ".join(f"cast(count(*) filter (where initial_codes='{x}') as bigint) as \"{x}\"" for x in LETTERS)
    + f" from ({pairs_sql(0, SINGLE)}) group by 1",
)
def spread_section_matrix(spark, sf_dir):
    counts = P.pair_counts(pair(spark, sf_dir, digits=0), "single")
    return spread_matrix(counts, "clerical_codes", "initial_codes", LETTERS)


@register("code_labels", f"select distinct label from (select unnest(list_concat(t,m)) as label from ({sql.joined('2')}))")
def code_labels(spark, sf_dir):
    return P.code_labels(pair(spark, sf_dir, digits=2), "clerical_codes", "initial_codes")


# --- metrics ---------------------------------------------------------------------------------------


def one_group(columns, source: str) -> str:
    counts, metrics = columns
    return f"select {', '.join(metrics)} from (select {', '.join(counts)}, cast(count(*) as bigint) as total from ({source}))"


@register("ambiguity_metrics", one_group(sql.ambiguity_columns(p=""), sql.joined("3")))
def ambiguity_metrics(spark, sf_dir):
    return M.ambiguity_metrics(ambiguity_test(spark, sf_dir))


@register("codability_metrics", one_group(sql.codability_columns("len(m)<>1", "len(t)<>1", p=""), sql.joined("3")))
def codability_metrics(spark, sf_dir):
    return M.codability_metrics(ambiguity_test(spark, sf_dir), "initial_ambiguous", "clerical_ambiguous")


@register("accuracy_metrics", one_group(sql.accuracy_columns(""), sql.joined("3")))
def accuracy_metrics(spark, sf_dir):
    return M.accuracy_metrics(pair(spark, sf_dir))


@register("evaluation_metrics", sql.metrics_over(sql.joined("3")))
def evaluation_metrics(spark, sf_dir):
    return M.flatten_metrics(M.evaluation_metrics(pair(spark, sf_dir)))


@register("evaluate_model", sql.metrics_over(sql.joined("5", truth=OVERRIDDEN, final=True), final=True))
def evaluate_model(spark, sf_dir):
    """The whole evaluation: side table, candidates, final codes, all metrics."""
    metrics = evaluate(
        views.model_output(spark, sf_dir, with_final=True), views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir),
        four_plus=views.four_plus(spark, sf_dir), digits=5, unique_ids=True,
    )
    return M.flatten_metrics(metrics)


@register("evaluate_model_any_ids", sql.metrics_over(sql.joined("3", truth=OVERRIDDEN, final=True), final=True))
def evaluate_model_any_ids(spark, sf_dir):
    """The same without the promise that ids are unique."""
    metrics = evaluate(
        views.model_output(spark, sf_dir, with_final=True), views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir),
        four_plus=views.four_plus(spark, sf_dir), digits=3,
    )
    return M.flatten_metrics(metrics)


def accuracy_sql(column: str, threshold: str) -> str:
    value = "case when n=0 then 0.0::double else 100*cast(hit as double)/n end"
    return f"""select round_even(({value})*10,0)/10 as accuracy_percent, hit as matches, n-hit as non_matches, n as total_considered from (
        select {sql.bigcount(f'max_score>={threshold} and {column}')} as hit, {sql.bigcount(f'max_score>={threshold}')} as n from aligned)"""


@register("accuracy_full", accuracy_sql("is_correct", "5e-1"))
def accuracy_full(spark, sf_dir):
    return aligned(spark, sf_dir).accuracy(0.5, "full", extended=True)


@register("accuracy_two_digit", accuracy_sql("is_correct_2_digit", "0"))
def accuracy_two_digit(spark, sf_dir):
    return aligned(spark, sf_dir).accuracy(0.0, "2-digit", extended=True)


@register("coverage", "select 100*(cast(count(*) filter (where max_score>=6e-1) as double)/count(*)) as coverage_percent from aligned")
def coverage(spark, sf_dir):
    return aligned(spark, sf_dir).coverage(0.6)


@register(
    "threshold_stats",
    """select t as threshold, case when considered=0 then 0.0::double else 100*cast(matches as double)/considered end as accuracy,
    100*(cast(considered as double)/total) as coverage from (
    select t, count(*) filter (where max_score>=t) as considered, count(*) filter (where max_score>=t and is_correct) as matches, count(*) as total
    from aligned, (select i*5e-2 as t from (select unnest(range(21)) as i)) group by t)""",
)
def threshold_stats(spark, sf_dir):
    return aligned(spark, sf_dir).threshold_stats()


def summary_sql() -> str:
    grid = {"0.50": "5e-1", "0.60": "6e-1", "0.70": "7e-1", "0.80": "8e-1"}
    acc = lambda t: (
        f"case when count(*) filter (where max_score>={t})=0 then 0.0::double else "
        f"100*cast(count(*) filter (where max_score>={t} and is_correct) as double)/count(*) filter (where max_score>={t}) end"
    )
    cols = [f"{acc('0')} as overall_accuracy", *[f'{acc(t)} as "accuracy_above_{n}"' for n, t in grid.items()]]
    cols += [f'100*(cast(count(*) filter (where max_score>={t}) as double)/count(*)) as "coverage_above_{n}"' for n, t in grid.items()]
    return f"select cast(count(*) as bigint) as total_samples, {', '.join(cols)} from aligned"


@register("summary_stats", summary_sql())
def summary_stats(spark, sf_dir):
    return aligned(spark, sf_dir).summary_stats()


def contribution_sql(source: str, candidate: str, humans: list[str], hit: str) -> str:
    match = " or ".join(f"coalesce({candidate}={h},false)" for h in humans)
    pct = lambda c: f"round_even(100*cast({c} as double)/n*100,0)/100"
    return f"""select '{hit}' as candidate_column, n as total_predictions_made, {pct('a')} as primary_match_percent, a as primary_match_count,
        {pct('b')} as any_clerical_match_percent, b as any_clerical_match_count from (select cast(count(*) as bigint) as n,
        {sql.bigcount(f'{candidate}={humans[0]}')} as a, cast(count(distinct case when {match} then unique_id end) as bigint) as b
        from {source} where {candidate} is not null)"""


@register("candidate_contribution", contribution_sql("padded", "m2", ["c1", "c2", "c3"], "m2"))
def candidate_contribution(spark, sf_dir):
    return aligned(spark, sf_dir).candidate_contribution("m2")


@register("candidate_contribution_repeated_ids", contribution_sql("repeated", '"SA_1"', ['"CC_1"', '"CC_2"'], "SA_1"))
def candidate_contribution_repeated_ids(spark, sf_dir):
    return LabelAlignment(views.repeated_wide(spark, sf_dir), REPEATED_CONFIG).candidate_contribution("SA_1")


@register(
    "mean_jaccard",
    """select round(avg(case when u=0 then 1.0::double else cast(i as double)/u end),9) as jaccard_similarity from (select
    len(list_distinct(list_filter([m1,m2,m3,c1,c2,c3], lambda x: x is not null))) as u,
    len(list_intersect(list_distinct(list_filter([m1,m2,m3], lambda x: x is not null)), list_filter([c1,c2,c3], lambda x: x is not null))) as i from padded)""",
)
def mean_jaccard(spark, sf_dir):
    return aligned(spark, sf_dir).jaccard_similarity().select(F.round("jaccard_similarity", 9).alias("jaccard_similarity"))


@register(
    "confusion_matrix",
    f"""select c1 as human, d1 as model, cast(count(*) as bigint) as count from (select substr(c1,1,2) as c1, substr(m1,1,2) as d1 from padded
    where not coalesce(regexp_matches(c1,'x'),false)) k
    where c1 in (select substr(c1,1,2) from padded where not coalesce(regexp_matches(c1,'x'),false) and c1 is not null group by 1 order by count(*) desc, 1 limit 8)
    and d1 in (select substr(m1,1,2) from padded where not coalesce(regexp_matches(c1,'x'),false) and m1 is not null group by 1 order by count(*) desc, 1 limit 8)
    group by 1,2""",
)
def confusion_matrix(spark, sf_dir):
    labelled = aligned(spark, sf_dir)
    labelled.df = labelled.df.select(
        F.when(F.col("sic_ind_occ1").contains("x"), "x").otherwise(F.substring("sic_ind_occ1", 1, 2)).alias("human"),
        F.substring("m1", 1, 2).alias("model"),
    )
    return labelled.confusion_matrix(ConfusionConfig("human", "model", top_n=8, exclude_patterns=["x"]))


# --- sweeps ----------------------------------------------------------------------------------------

LEVELS = [0, 2, 3, 4, 5]
ALL_LEVELS = "0,2,3,4,5"

METHOD_SETS = f"""select b.method, b.unique_id, b.digits, case when len(i.codes)>0 then i.codes else coalesce(a.codes,{sql.EMPTY}) end as m
    from (select unique_id, method, digits from coded, (select unnest(['m_a','m_b','m_c']) as method), (select unnest([{ALL_LEVELS}]) as digits)) b
    join ({sql.human_sets('initial_codes')}) i on i.unique_id=b.unique_id and i.digits=b.digits
    left join ({sql.pruned_sets('method_scored_codes', '7e-1', 'method, unique_id')}) a
    on a.unique_id=b.unique_id and a.digits=b.digits and a.method=b.method
    union all select 'coder_round_1', unique_id, digits, codes from ({sql.human_sets('first_round_codes', levels=ALL_LEVELS)})"""
SWEPT = f"""select s.method, s.unique_id, s.digits, s.m, t.codes as t from ({METHOD_SETS}) s
    join ({OVERRIDDEN}) t on t.unique_id=s.unique_id and t.digits=s.digits"""


def swept(spark, sf_dir):
    return sweep(
        views.models(spark, sf_dir), views.clerical(spark, sf_dir), views.hierarchy(spark, sf_dir), LEVELS,
        four_plus=views.four_plus(spark, sf_dir), first_round=views.first_round(spark, sf_dir), unique_ids=True,
    )


@register("evaluation_sweep", sql.metrics_over(SWEPT, "digits, method"))
def evaluation_sweep(spark, sf_dir):
    return M.flatten_metrics(swept(spark, sf_dir), ["digits", "method"])


SWEEP_METRICS = sql.metrics_over(SWEPT, "digits, method")
LEVEL_NAME = "case when digits=0 then 'S' else cast(digits as varchar) end"


@register(
    "true_codability",
    f"""select distinct {LEVEL_NAME} as digits, 'truth' as method, {sql.share('"ambiguity_TN"+"ambiguity_FP"', 'initial_total_records')} as codability
    from ({SWEEP_METRICS})""",
)
def true_codability(spark, sf_dir):
    return M.true_codability(swept(spark, sf_dir))


def unpivoted(source: str, keys: str, columns: dict[str, str]) -> str:
    return " union all ".join(f"select {keys}, '{name}' as metrics, {expr} as value from ({source})" for name, expr in columns.items())


@register(
    "accuracy_table",
    unpivoted(
        SWEEP_METRICS, f"{LEVEL_NAME} as digits, method",
        {"OO Accuracy": "initial_accuracy_oo_unambiguous", "OM Accuracy": "initial_accuracy_om_unambiguous",
         "MO Accuracy": "initial_accuracy_mo_unambiguous", "MM Accuracy": "initial_accuracy_mm_total"},
    ),
)
def sweep_accuracy_table(spark, sf_dir):
    return accuracy_table(swept(spark, sf_dir))


AMBIGUITY_LONG = unpivoted(
    SWEEP_METRICS, f"{LEVEL_NAME} as digits, method",
    {"codability": "codability_initial_codable_prop", "precision": "ambiguity_precision", "recall": "ambiguity_recall",
     "f1": "ambiguity_f1", "accuracy": "ambiguity_accuracy"},
)
TRUE_LONG = f"""select distinct {LEVEL_NAME} as digits, 'truth' as method, 'codability' as metrics,
    {sql.share('"ambiguity_TN"+"ambiguity_FP"', 'initial_total_records')} as value from ({SWEEP_METRICS})
    union all select {LEVEL_NAME}, 'truth', name, null from (select unnest([{ALL_LEVELS}]) as digits), (select unnest(['precision','recall','f1','accuracy']) as name)"""


@register(
    "ambiguity_table",
    f"""select *, case when metrics in ('codability','accuracy') then 196e-2*sqrt(value*(1-value)/(select cast(count(*) as double) from coded)) end as ci
    from ({AMBIGUITY_LONG} union all {TRUE_LONG})""",
)
def sweep_ambiguity_table(spark, sf_dir):
    metrics = written(swept(spark, sf_dir))  # a few rows, used twice
    records = views.clerical(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return ambiguity_table(metrics, M.true_codability(metrics), records)


@register(
    "melt_metrics",
    unpivoted(
        "select o_orderpriority, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1", "o_orderpriority",
        {"low": "low", "high": "high"},
    ),
)
def melt_metrics(spark, sf_dir):
    prices = views.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )
    return P.melt_metrics(prices, ["o_orderpriority"], ["low", "high"])


# --- code pairs and distributions ------------------------------------------------------------------



@register(
    "ambiguity_subsets",
    f"select unique_id, 'single' as subset from ({sql.joined('3')}) where {SINGLE} union all select unique_id, 'few' from ({sql.joined('3')}) where {FEW}",
)
def ambiguity_subsets(spark, sf_dir):
    both = pair(spark, sf_dir)
    return P.ambiguity_subset(both, "single").select("unique_id", F.lit("single").alias("subset")).unionByName(
        P.ambiguity_subset(both, "few").select("unique_id", F.lit("few").alias("subset"))
    )


def counted(pairs: str) -> str:
    return f"select clerical_codes, initial_codes, cast(count(*) as bigint) as count from ({pairs}) group by 1,2"


register("section_confusion_single", counted(pairs_sql(0, SINGLE)))(
    lambda spark, sf_dir: P.pair_counts(pair(spark, sf_dir, digits=0), "single")
)
register("section_confusion_few", counted(pairs_sql(0, FEW)))(
    lambda spark, sf_dir: P.pair_counts(pair(spark, sf_dir, digits=0), "few")
)
register("code_pair_counts", counted(pairs_sql(3, FEW)))(
    lambda spark, sf_dir: P.pair_counts(pair(spark, sf_dir), "few")
)


def frequent_sql(pairs: str) -> str:
    off = f"select * from ({counted(pairs)}) where clerical_codes<>initial_codes"
    return f"select * from ({off}) where count>(select min(count) from (select count from ({off}) order by count desc limit 11))"


@register("frequent_confusions", frequent_sql(pairs_sql(2, SINGLE)))
def frequent_confusions(spark, sf_dir):
    return P.frequent_confusions(P.pair_counts(pair(spark, sf_dir, digits=2), "single"))


@register(
    "counts_among_confused",
    f"""select * from ({counted(pairs_sql(2, FEW))}) where clerical_codes in (select unnest([clerical_codes,initial_codes]) from ({frequent_sql(pairs_sql(2, FEW))}))
    and initial_codes in (select unnest([clerical_codes,initial_codes]) from ({frequent_sql(pairs_sql(2, FEW))}))""",
)
def counts_among_confused(spark, sf_dir):
    return P.counts_among_confused(P.pair_counts(pair(spark, sf_dir, digits=2), "few"))


SECTIONS = f"""select chr(65 + cast(substr(o_orderpriority,1,1) as int)) as sic_section, 'Admin labels' as source from orders
    union all select codes[1], 'Clerical codes' from ({sql.human_sets()}) where digits=0 and len(codes)=1
    union all select codes[1], 'Model codes' from ({sql.model_sets()}) where digits=0 and len(codes)=1"""


@register(
    "section_distribution",
    f"""select *, 196e-2*sqrt(frequency*(1-frequency)/sample_size) as ci from (select *, cast(count as double)/sample_size as frequency from (
    select sic_section, source, cast(count(*) as bigint) as count, cast(sum(count(*)) over (partition by source) as bigint) as sample_size
    from ({SECTIONS}) group by 1,2))""",
)
def section_distribution(spark, sf_dir):
    h = views.hierarchy(spark, sf_dir)
    letter = F.chr(65 + F.substring("o_orderpriority", 1, 1).cast("int"))
    admin = views.table(spark, sf_dir, "orders").select(letter.alias("sic_section"), F.lit("Admin labels").alias("source"))
    human = prepare.prepare_clerical_codes(views.clerical(spark, sf_dir), h, digits=0)
    model = prepare.prepare_model_codes(views.model_output(spark, sf_dir), h, digits=0)
    stacked = admin.unionByName(P.single_section(human, "clerical_codes", "Clerical codes")).unionByName(
        P.single_section(model, "model_codes", "Model codes")
    )
    return P.section_distribution(stacked)


@register(
    "group_share",
    """select o_orderpriority, o_orderstatus, count, sample_size, cast(count as double)/sample_size as frequency from (select o_orderpriority, o_orderstatus,
    cast(count(*) as bigint) as count, cast(sum(count(*)) over (partition by o_orderpriority) as bigint) as sample_size from orders group by 1,2)""",
)
def group_share(spark, sf_dir):
    counts = views.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").count()
    return P.with_group_share(counts, "o_orderpriority")


@register(
    "stack_methods",
    "select unique_id, 'm_a' as method, m1 as code from coded union all select unique_id, 'm_b', m2 from coded",
)
def stack_methods(spark, sf_dir):
    rows = views.coded(spark, sf_dir)
    return prepare.stack_methods({n: rows.select("unique_id", F.col(c).alias("code")) for n, c in {"m_a": "m1", "m_b": "m2"}.items()})


@register("distinct_ids", "select distinct user_id from events")
def distinct_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("user_id").distinct()


@register("top_values", "select m1, cast(count(*) as bigint) as count from coded where m1 is not null group by 1 order by 2 desc, 1 limit 10")
def most_frequent(spark, sf_dir):
    return top_values(views.coded(spark, sf_dir).groupBy("m1").count(), "m1", 10)
