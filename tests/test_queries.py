import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = "agg_comment_report agg_draft_report budget_status cache_modes eval_report guard_draft_tail guard_fact_check guard_outcomes judge_seam pipe_baseline pipeline_preprocess run_answers seam_outcomes selfjoin_jaccard txt_injection_sentence due_accuracy_by_style ext_due_date ext_form_questions ext_qualifications pipe_rules agg_confusion topk_keywords txt_normalize txt_mask_contacts guard_claims guard_comments join_left_labels rank_auc rank_r_precision agg_upper_median budget_admission cost_per_call sample_stratified stream_daily_spend".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, tmp_path):
    from bulletin.streaming.ledger import daily_spend

    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("ts", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = daily_spend(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("spend").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("spend").collect()) == sorted(daily_spend(events).collect())
