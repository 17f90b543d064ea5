import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows

SF = "/root/testdata/sf0.001"
QUICK = [
    "p6_gates", "a8_leak_counts", "a12_reason_buckets", "w5_numbered_pick", "k2_capped_lines", "j5_import_decisions", "j7_effective_access", "j16_project_of",
    "s6_dotenv_lines", "u4_refreshed_rules", "t2_session_replay", "t11_activity_sessions", "w6_as_of_state", "d12_classifier_branches", "c6_policy_decisions",
]


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 110
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["source", "texts", "likely_count", "possible_count", "strict_high", "strict_paranoid"]


def test_other_queries_without_the_training_package(monkeypatch):
    """Whatever is missing there, a module of its own or a library that it needs."""
    import sys

    for missing in ("exposure.llm.queries", "corpus_pipeline", "public_tokenizers", "tokenizers"):
        with monkeypatch.context() as m:
            for loaded in [k for k in sys.modules if k.startswith("exposure.llm") or k == "corpus_pipeline"]:
                m.delitem(sys.modules, loaded)
            m.setitem(sys.modules, missing, None)
            left = entry.queries()
            assert "source_exposure" in left and set(entry.oracle_sql()) <= set(left)
            assert not any(n.startswith("op") or n == "pipeline" for n in left) or missing == "tokenizers"


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns) and got == rows(cur.fetchall(), columns)


def test_one_pass_over_texts(spark):
    """Findings read the text table once, and nothing but equi-joins is planned."""
    from exposure.plans.detection_queries import documents
    from exposure.plans.scan import scan_texts

    plan = scan_texts(documents(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan


def same_as_sql(spark, folder, name, **tables):
    """A query over small tables of the test's own gives the rows of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows(cur.fetchall(), [d[0] for d in cur.description])
    return got


def test_values_that_run_on_into_a_keyword(spark, tmp_path):
    texts = [(1, "password=token=abcdefgh12345 then api_key: 'Zk9pL2xQ7vB8w'"), (2, "token=abc"), (3, None)]
    assert len(same_as_sql(spark, tmp_path, "d4_assignment_hits_pages", pages=spark.createDataFrame(texts, "page_id long, html string"))) == 2
    assert len(same_as_sql(spark, tmp_path, "d4_assignment_hits", documents=spark.createDataFrame(texts, "doc_id long, text string"))) == 2


@pytest.mark.parametrize("n", [0, 50, 2500])
def test_scopes_without_findings_are_counted(spark, tmp_path, n):
    """From 2,100 customers on every path is in the project."""
    assert len(same_as_sql(spark, tmp_path, "u1_first_per_path", customer=spark.range(n).withColumnRenamed("id", "c_custkey"))) == 2


def test_command_secrets_of_any_event_id(spark, tmp_path):
    """Ids of one digit over and over make values of little entropy."""
    ids = [0, 7, 2222222, 9999999, 88888888, 2222222222, 10**15, 9 * 10**18]
    events = spark.createDataFrame([(i, u) for i in ids for u in (0, 1, 2)], "event_id long, user_id long")
    assert len(same_as_sql(spark, tmp_path, "c7_command_secrets", events=events)) == 16


def test_findings_of_texts_with_many_lines(spark, tmp_path):
    """Names of one text in several spellings and tiers, many lines to a text."""
    orders = spark.createDataFrame([(i, i % 3, f"{i % 5}-P") for i in range(0, 20000, 7)], "o_orderkey long, o_custkey long, o_orderpriority string")
    assert len(same_as_sql(spark, tmp_path, "a4_content_findings", orders=orders)) > 10
