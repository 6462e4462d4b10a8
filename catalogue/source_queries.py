"""Readers and writers: each query writes a whole derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import sql, views
from catalogue.registry import register
from codetally.lineage import scratch
from codetally.operators.metrics import flatten_metrics
from codetally.operators.prepare import clerical_text
from codetally.operators.quality import add_quality_flags
from codetally.operators.alignment import LabelAlignment
from codetally.operators.selection import reformat_access_codes, response_records, split_retained
from codetally.plans.evaluation import evaluate, evaluate_files
from codetally.plans.reports import flag_file
from codetally.sources import readers, writers
from codetally.streaming.responses import append_responses
from catalogue.column_queries import WIDE_CONFIG


@register("read_text_csv", "select cast(unique_id as varchar) as unique_id, sic_ind_occ1, sic_ind_occ2, sic_ind_occ3 from coded")
def read_text_csv(spark, sf_dir):
    """Missing codes are written as the text NA and as empty cells; both come back as null."""
    rows = views.clerical(spark, sf_dir).withColumn("sic_ind_occ2", F.coalesce("sic_ind_occ2", F.lit("NA")))
    path = writers.write_csv(rows, scratch(spark) + "/codes.csv")
    return readers.read_text_csv(spark, path, views.CLERICAL)


@register("read_typed_csv", "select unique_id, m1, s1 from coded")
def read_typed_csv(spark, sf_dir):
    rows = views.coded(spark, sf_dir).select("unique_id", "m1", "s1")
    path = writers.write_csv(rows, scratch(spark) + "/typed.csv")
    return readers.read_typed_csv(spark, path, {"unique_id": "bigint", "s1": "double"}, ["unique_id", "m1", "s1"])


@register("read_free_text", "select cast(doc_id as varchar) as doc_id, concat(' ', text, ' ') as text, lang from documents")
def read_free_text(spark, sf_dir):
    """Whole texts with line breaks, quotes and blanks at both ends, written and read back."""
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), "lang")
    path = writers.write_csv(rows, scratch(spark) + "/texts.csv")
    return readers.read_text_csv(spark, path, ["doc_id", "text", "lang"], null_tokens=False)


@register("read_model_output", "select unique_id, code, likelihood from candidates")
def read_model_output(spark, sf_dir):
    path = scratch(spark) + "/model.parquet"
    views.model_output(spark, sf_dir).write.parquet(path)
    return readers.read_model_output(spark, path).select("unique_id", F.inline("alt_sic_candidates"))


@register("read_pipe_delimited", "select p_name as job_title, p_type as job_description, p_brand as org_description from part")
def read_pipe_delimited(spark, sf_dir):
    path = scratch(spark) + "/requests.txt"
    views.table(spark, sf_dir, "part").select("p_name", "p_type", "p_brand").write.option("sep", "|").option("header", True).csv(path)
    return readers.read_pipe_delimited(spark, path)


@register("read_companion_file", "select cast(unique_id as varchar) as unique_id, sic_ind_occ from overridden_text")
def read_companion_file(spark, sf_dir):
    folder = scratch(spark)
    main = writers.write_csv(views.clerical(spark, sf_dir), f"{folder}/clerical.csv")
    writers.write_csv(views.four_plus(spark, sf_dir), readers.companion_path(main))
    clerical = readers.read_text_csv(spark, main, views.CLERICAL)
    companion = readers.read_companion(spark, main, ["unique_id", "sic_ind_occ"])
    return clerical_text(clerical, companion)


@register(
    "write_flagged_csv",
    """select cast(unique_id as varchar) as unique_id, cast(num_answers as varchar) as num_answers,
    cast(num_answers=1 and match5 as varchar) as "Unambiguous",
    cast(to_json([sic_ind_occ1,sic_ind_occ2,sic_ind_occ3]) as varchar) as "All_Clerical_codes" from flagged""",
)
def write_flagged_csv(spark, sf_dir):
    flagged = add_quality_flags(views.clerical(spark, sf_dir))
    path = writers.write_csv(flagged, scratch(spark) + "/flagged.csv")
    return readers.read_text_csv(spark, path).select("unique_id", "num_answers", "Unambiguous", "All_Clerical_codes")


FLAGGED_FILE = """select cast(unique_id as varchar) as unique_id, sic_ind_occ1, sic_ind_occ2, sic_ind_occ3, cast(not_codeable as varchar) as "Not_Codeable",
    cast(four_or_more as varchar) as "Four_Or_More", division as "SIC_Division", cast(num_answers as varchar) as num_answers,
    cast(to_json([sic_ind_occ1,sic_ind_occ2,sic_ind_occ3]) as varchar) as "All_Clerical_codes", cast(match5 as varchar) as "Match_5_digits",
    cast(match3 as varchar) as "Match_3_digits", cast(match2 as varchar) as "Match_2_digits", cast(num_answers=1 and match5 as varchar) as "Unambiguous"
    from flagged"""


def flagged_files(spark, sf_dir):
    """A clerical CSV written, then flagged from file to file."""
    folder = scratch(spark)
    path = writers.write_csv(views.clerical(spark, sf_dir), folder + "/clerical.csv")
    return folder + "/flagged.csv", flag_file(spark, path, folder + "/flagged.csv")


@register("flag_file", FLAGGED_FILE)
def flag_file_rows(spark, sf_dir):
    """Every row and column of the file that was written."""
    path, _ = flagged_files(spark, sf_dir)
    return readers.read_text_csv(spark, path).withColumn("SIC_Division", F.coalesce("SIC_Division", F.lit("")))


FLAGS = {"Match_5_digits": "match5", "Match_3_digits": "match3", "Match_2_digits": "match2", "Unambiguous": "num_answers=1 and match5"}


@register(
    "flag_file_counts",
    " union all ".join(f"select '{name}' as flag, {expr} as value, cast(count(*) as bigint) as count from flagged group by 1,2" for name, expr in FLAGS.items()),
)
def flag_file_counts(spark, sf_dir):
    return flagged_files(spark, sf_dir)[1]["flag_counts"]


@register("write_metrics_json", sql.metrics_over(sql.joined("3", final=True), final=True))
def write_metrics_json(spark, sf_dir):
    metrics = evaluate(
        views.model_output(spark, sf_dir, with_final=True), views.clerical(spark, sf_dir),
        views.hierarchy(spark, sf_dir), digits=3, unique_ids=True,
    )
    path = writers.write_metrics(metrics, scratch(spark) + "/run.parquet", 3)
    return flatten_metrics(spark.read.schema(metrics.schema).json(path))


THRESHOLDS = """select t as threshold, case when considered=0 then 0.0::double else 100*cast(matches as double)/considered end as accuracy,
    100*(cast(considered as double)/total) as coverage from (
    select t, count(*) filter (where max_score>=t) as considered, count(*) filter (where max_score>=t and is_correct) as matches, count(*) as total
    from aligned, (select i*5e-2 as t from (select unnest(range(21)) as i)) group by t)"""


@register("write_evaluation_run", THRESHOLDS)
def write_evaluation_run(spark, sf_dir):
    aligned = LabelAlignment(views.wide(spark, sf_dir), WIDE_CONFIG, unique_ids=True)
    table = aligned.threshold_stats()
    folder = writers.write_evaluation_run(
        spark, {"evaluation_type": "thresholds"}, {"threshold_statistics": table, "jaccard": aligned.jaccard_similarity()}, scratch(spark)
    )
    return spark.read.schema(table.schema).json(f"{folder}/evaluation_result/threshold_statistics")


RESPONSES = """select event_id as unique_id, concat('{"user":',user_id,'}') as request_payload,
    case when event_type='purchase' then 1 else 0 end as classified,
    case when event_type='purchase' then concat('why ',user_id) else '' end as followup,
    case when event_type in ('purchase','view') then lpad(cast(event_id%90000 as varchar),5,'0') else '' end as code,
    case when event_type='click' then 'not found' end as error from events"""


@register("write_response_records", RESPONSES)
def write_response_records(spark, sf_dir):
    records = response_records(views.stored_responses(spark, sf_dir), "body", "event_id", "payload")
    path = writers.write_response_records(records, scratch(spark) + "/responses")
    return spark.read.schema(records.schema).json(path)


@register("append_response_stream", RESPONSES)
def append_response_stream(spark, sf_dir):
    """The same records, appended by a stream that reads the stored responses as files arrive."""
    folder = scratch(spark)
    stored = views.stored_responses(spark, sf_dir)
    stored.write.parquet(f"{folder}/stored")
    arriving = spark.readStream.schema(stored.schema).parquet(f"{folder}/stored")
    append_responses(arriving, "body", "event_id", "payload", f"{folder}/records", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/records")


def latency_rows(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("test_id"), F.col("event_type").alias("test_description"),
        F.col("ts").cast("timestamp").alias("test_timestamp"),
        F.lit(1).cast("bigint").alias("step"), F.col("value").alias("total_latency"), (F.col("value") / 2).alias("response_time"),
        F.when(failed, "500").otherwise("200").alias("status_code"),
        *[F.lit("text").alias(c) for c in ("job_title", "job_description", "org_description")],
        F.when(failed, 0).otherwise(1).cast("bigint").alias("classified"), F.lit("").alias("followup"), F.lit("").alias("code"),
    )


def latency_table(spark, path, schema=writers.LATENCY_SCHEMA):
    return spark.read.schema(schema).parquet(path).withColumn("test_timestamp", F.col("test_timestamp").cast("timestamp_ntz"))


LATENCY_SQL = """select event_id as test_id, event_type as test_description, ts as test_timestamp, 1::bigint as step, value as total_latency,
    value/2 as response_time, case when event_type='error' then '500' else '200' end as status_code, 'text' as job_title,
    'text' as job_description, 'text' as org_description, cast(case when event_type='error' then 0 else 1 end as bigint) as classified,
    '' as followup, '' as code from events"""


@register("append_latency_results", LATENCY_SQL)
def append_latency_results(spark, sf_dir):
    """Failed and successful calls are appended one after the other to one table with a declared schema."""
    rows, failed = latency_rows(spark, sf_dir), F.col("status_code") == "500"
    path = scratch(spark) + "/latency"
    writers.append_results(rows.filter(failed), path)
    writers.append_results(rows.filter(~failed), path)
    return latency_table(spark, path)


@register("append_latency_batches", f"select 'run 1' as run_id, cast(test_id % 4 as varchar) as batch_id, * from ({LATENCY_SQL})")
def append_latency_batches(spark, sf_dir):
    """Batches appended in two overlapping goes: each is there once."""
    rows = latency_rows(spark, sf_dir).select(F.lit("run 1").alias("run_id"), (F.col("test_id") % 4).cast("string").alias("batch_id"), "*")
    path = scratch(spark) + "/latency"
    writers.append_batches(rows.filter("batch_id < '3'"), path)
    writers.append_batches(rows, path)
    writers.append_batches(rows.filter("batch_id = '1'"), path)
    return latency_table(spark, path, T.StructType([*writers.BATCH_SCHEMA, *writers.LATENCY_SCHEMA]))


@register(
    "write_access_code_split",
    """select case when rn between 2 and 101 then 'distributed' else 'retained' end as part, cast(c_custkey as varchar) as participant_id,
    concat(substr(c_name,1,8),' ',substr(c_name,10)) as passcode from (select *, row_number() over (order by c_custkey) as rn from customer)""",
)
def write_access_code_split(spark, sf_dir):
    codes = views.access_codes(spark, sf_dir)
    retained, distributed = split_retained(reformat_access_codes(codes), "participant_id", 100)
    paths = writers.write_split(retained, distributed, scratch(spark) + "/codes.csv")
    names = ["participant_id", "passcode"]
    parts = [readers.read_text_csv(spark, p, names).withColumn("part", F.lit(part)) for p, part in zip(paths, ("retained", "distributed"))]
    return parts[0].unionByName(parts[1])


@register("evaluate_files", sql.metrics_over(sql.joined("3", truth=sql.human_sets("overridden_codes", "select unique_id from overridden_text"))))
def evaluate_from_files(spark, sf_dir):
    """The whole evaluation from files: model output, human codes and their companion."""
    folder = scratch(spark)
    views.model_output(spark, sf_dir).write.parquet(f"{folder}/model.parquet")
    main = writers.write_csv(views.clerical(spark, sf_dir), f"{folder}/clerical.csv")
    writers.write_csv(views.four_plus(spark, sf_dir), readers.companion_path(main))
    metrics = evaluate_files(
        spark, views.hierarchy(spark, sf_dir), f"{folder}/model.parquet", main, digits=3, write_output=True, unique_ids=True
    )
    return flatten_metrics(spark.read.schema(metrics.schema).json(writers.metrics_path(f"{folder}/model.parquet", 3)))
