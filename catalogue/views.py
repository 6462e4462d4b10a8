"""Code tables derived from the given tables, so that every query runs over all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.functions.codes import join_codes
from codetally.lineage import written
from codetally.operators.hierarchy import Hierarchy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: Column) -> Column:
    return F.lpad(((key * 37) % 100000).cast("string"), 5, "0")


def hierarchy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "part").select(code_of(F.col("p_partkey")).alias("code"), F.col("p_partkey").alias("position"))
    return codes.select(F.chr(65 + F.substring("code", 1, 2).cast("int") % 21).alias("section"), "code", "position")


def hierarchy(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return Hierarchy(hierarchy_table(spark, sf_dir))


#: What the query that is being built has derived so far; each query derives its own.
_derived: dict[tuple[str, str, str], DataFrame] = {}


def new_query() -> None:
    _derived.clear()


def once_per_query(derive):
    """Derive a table once for all its uses in a query, written so that the given tables are read once."""

    def table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, derive.__name__, sf_dir)
        if key not in _derived:
            _derived[key] = written(derive(spark, sf_dir))
        return _derived[key]

    return table_of


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: human codes, first model choice, scored model candidates of several models.

    All lines of an order are reduced in one aggregation, before the shuffle as far as possible.
    """
    code = "lpad(cast(({0} * 37) % 100000 as string), 5, '0')"
    lines = range(1, 8)
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unique_id")).agg(
        *[F.expr(f"{code.format(f'max(l_partkey) filter (where l_linenumber = {n})')} as h{n}") for n in lines],
        *[F.expr(f"{code.format(f'min(l_partkey) filter (where l_linenumber = {n})')} as l{n}") for n in lines],
        *[F.expr(f"max(l_discount) filter (where l_linenumber = {n}) as d{n}") for n in lines],
        F.expr("max(l_quantity) filter (where l_linenumber = 1) as qty"),
    )
    return wide.selectExpr(
        "unique_id",
        "case when qty >= 49 then '-9' when qty <= 2 then '4+' when d1 < 2e-2 then concat(substr(h1, 1, 3), 'xx') "
        "when d1 < 4e-2 then cast(cast(h1 as int) as string) else h1 end as sic_ind_occ1",
        "h2 as sic_ind_occ2", "h3 as sic_ind_occ3",
        "case when d1 >= 5e-2 then l1 end as initial_code",
        "l1 as m1", "l2 as m2", "l5 as m3", "l3", "l4", "l6", "l7",
        "d1 * 10 as s1", "d2 * 10 as s2", "d5 * 10 as s3",
        "d3 * 10 as t3", "d4 * 10 as t4", "d6 * 10 as t6", "d7 * 10 as t7",
    )


@once_per_query
def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir)


REQUEST_CONSTANTS = {"llm": "model-1", "type": "sic"}
CLERICAL = ["unique_id", "sic_ind_occ1", "sic_ind_occ2", "sic_ind_occ3"]


def clerical(spark: SparkSession, sf_dir: str, alone: bool = False) -> DataFrame:
    """The human codes; ``alone`` where a query uses nothing else of the records and reads them once, so that only what
    they need is derived and nothing is written."""
    return (records if alone else coded)(spark, sf_dir).select(*CLERICAL)


def candidate_array(codes: list[str], scores: list[str]) -> Column:
    entries = [
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("code"), F.col(s).alias("likelihood"))) for c, s in zip(codes, scores)
    ]
    return F.array_compact(F.array(*entries))


def model_output(spark: SparkSession, sf_dir: str, with_final: bool = False) -> DataFrame:
    """First choice, scored candidates and, on request, a final code text."""
    rows = coded(spark, sf_dir)
    final = [join_codes("m1", "m2").alias("final_sic")] if with_final else []
    return rows.select(
        "unique_id", "initial_code", candidate_array(["m1", "m2", "m3"], ["s1", "s2", "s3"]).alias("alt_sic_candidates"), *final
    )


def models(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three models over the same records, from different lines of each order."""
    # Kept apart as users have them, one table per model; all are narrow reads of the one derived table.
    rows = coded(spark, sf_dir)
    lines = {
        "m_a": (["m1", "m2", "m3"], ["s1", "s2", "s3"]),
        "m_b": (["m2", "l4", "l6"], ["s2", "t4", "t6"]),
        "m_c": (["l3", "m3", "l7"], ["t3", "s3", "t7"]),
    }
    return {
        name: rows.select("unique_id", "initial_code", candidate_array(codes, scores).alias("alt_sic_candidates"))
        for name, (codes, scores) in lines.items()
    }


def four_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table: codes of the records marked ``4+``, and of records the clerical table does not have.

    The extra ids are the negated ids of the records marked ``-9``.
    """
    rows = coded(spark, sf_dir)
    text = join_codes("m1", "m2", "m3", F.lit("99x")).alias("sic_ind_occ")
    uncoded = F.col("sic_ind_occ1") == "-9"
    named = F.when(uncoded, -F.col("unique_id") - 1).otherwise(F.col("unique_id")).alias("unique_id")
    return rows.filter(F.col("sic_ind_occ1").isin("4+", "-9")).select(named, text)


def first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier round of human coding of the same records."""
    return coded(spark, sf_dir).select(
        "unique_id", F.col("m1").alias("sic_ind_occ1"), F.col("sic_ind_occ2"), F.col("l4").alias("sic_ind_occ3")
    )


@once_per_query
def search_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results per order: each code of its lines with its nearest distance, by two methods.

    A code occurs once per order, so a list has at most as many entries as there are codes. Lines are dealt out by order
    once for both groupings, and collected once for both lists.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("unique_id"), "l_partkey",
        (F.col("l_extendedprice") / 100000).alias("price"), (F.col("l_quantity") / 50 + F.col("l_tax")).alias("quantity"),
    )
    by_code = lines.repartition("unique_id").groupBy("unique_id", code_of(F.col("l_partkey")).alias("code"))
    nearest = by_code.agg(F.min("price").alias("price"), F.min("quantity").alias("quantity"))
    found = nearest.groupBy("unique_id").agg(F.collect_list(F.struct("price", "quantity", "code")).alias("found"))

    def ranked(distance: str) -> Column:
        listed = F.transform("found", lambda c: F.struct(c[distance].alias("distance"), c["code"].alias("code")))
        return F.sort_array(listed).alias(distance)

    return found.select("unique_id", ranked("price"), ranked("quantity"))


def searches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lists = search_lists(spark, sf_dir)
    return {name: lists.select("unique_id", F.col(name).alias("semantic_search_results")) for name in ("price", "quantity")}


def repeated_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table in which ids repeat: one row per event, id = user."""
    e = table(spark, sf_dir, "events")
    spread = lambda n: code_of(n * 101)
    user, event, value = F.col("user_id"), F.col("event_id"), F.col("value")
    return e.select(
        user.alias("unique_id"),
        spread(user % 12).alias("CC_1"),
        F.when(value < 20, spread(event % 3 + 40)).alias("CC_2"),
        spread(user % 7 + event % 2 + 5).alias("SA_1"),
        F.when(value > 250, spread(event % 3 + 40)).alias("SA_2"),
        value.cast("string").alias("SA_score_1"),
        F.when(F.col("event_type") == "error", "n/a").otherwise((value / 7).cast("string")).alias("SA_score_2"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table with unique ids: human codes against scored model codes."""
    return coded(spark, sf_dir).select(
        "unique_id", "sic_ind_occ1", "sic_ind_occ2", "sic_ind_occ3", "m1", "m2", "m3", "s1", "s2", "s3",
        F.when(F.col("s1") > 0.5, "TRUE").when(F.col("s1") > 0.2, "False").alias("Unambiguous"),
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table read in fewer parts than there are cores, dealt out over all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One messy code text per order line, covering the ways a code can be written."""
    kind = F.col("l_linenumber")
    code = code_of(F.col("l_partkey"))
    text = (
        F.when(F.col("l_quantity") >= 49, "-9")
        .when(F.col("l_quantity") <= 2, "4+")
        .when(F.col("l_quantity") == 3, "nan")
        .when(F.col("l_quantity") == 4, "")
        .when(F.col("l_quantity") == 5, F.concat(F.lit("1"), F.lit("4+")))
        .when(F.col("l_quantity") == 6, F.concat(F.lit("["), code, F.lit(", "), F.substring(code, 1, 2), F.lit("xXx]")))
        .when(kind == 1, F.concat(F.substring(code, 1, 3), F.lit("xx")))
        .when(kind == 2, code.cast("int").cast("string"))
        .when(kind == 3, F.concat(code.cast("int").cast("string"), F.lit(".0")))
        .when(kind == 4, F.concat(code, F.lit("7")))
        .when(kind == 5, F.concat(code, F.lit(";"), F.substring(code, 1, 1), F.lit("xxxx")))
        .when(kind == 6, F.concat(F.lit("-"), F.substring(code, 4, 2)))
        .otherwise(code)
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return spread(lines, "l_orderkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", text.alias("text"))


def access_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access codes with hyphens in the passcode."""
    name = F.col("c_name")
    passcode = F.concat_ws("-", F.substring(name, 1, 8), F.substring(name, 10, 100))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("survey_access_id"), passcode.alias("one_time_passcode"))


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as stored text: answered, empty, failed and cut off."""
    kind, code = F.col("event_type"), F.lpad((F.col("event_id") % 90000).cast("string"), 5, "0")
    body = (
        F.when(kind == "purchase", F.format_string('{"results":[{"classified":true,"followup":"why %s","code":"%s"}]}', "user_id", code))
        .when(kind == "view", F.format_string('{"results":[{"classified":0,"followup":null,"code":"%s"},{"code":"99999"}]}', code))
        .when(kind == "signup", F.lit('{"results":[]}'))
        .when(kind == "click", F.lit('{"error":"not found"}'))
        .otherwise(F.lit('{"results":['))
    )
    payload = F.format_string('{"user":%s}', "user_id")
    return table(spark, sf_dir, "events").select("event_id", payload.alias("payload"), body.alias("body"))
