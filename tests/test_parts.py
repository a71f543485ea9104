from datetime import datetime, timezone

import pytest

from tablediff import TableDiff
from tablediff.cli import main
from tablediff.functions import names, types
from tablediff.functions.hashing import key_hash
from tablediff.history import History
from tablediff.metrics import Recorder, connection_statistics, method_comparison, query_statistics, top_errors
from tablediff.operators.sample import percentage, sampling_sql
from tablediff.operators.schema import check_schema, compare_schemas, mark_primary_keys, primary_keys
from tablediff.sources.config import Config, bigquery_credentials, from_environment, reader_options, snowflake_account
from tablediff.sources.registry import Sources, open_source
from tablediff.sources.source import columns_from_catalog


def test_names():
    assert names.quote_identifier("a.b", "upper") == "`A`.`B`"
    for bad in ("a b", "1a", "a;drop", "", "a..b"):
        with pytest.raises(ValueError):
            names.check_identifier(bad)
    assert [names.sql_literal(x) for x in (None, True, 3, "o'k")] == ["NULL", "TRUE", "3", "'o''k'"]
    assert names.split_name('"c"."s"."t"') == ("s", "t") and names.split_name("t") == (None, "t")


@pytest.mark.parametrize(("system", "native", "common"), [("snowflake", "VARCHAR", "string"), ("snowflake", "NUMBER", "decimal"), ("snowflake", "VARIANT", "json"), ("snowflake", "varchar(255)", "string"), ("postgresql", "numeric(10,2)", "decimal"), ("mysql", "nonesuch", "string"), ("databricks", "ARRAY<INT>", "array")])
def test_type_map(system, native, common):
    assert types.map_type(system, native) == common


def test_types():
    with pytest.raises(ValueError):
        types.map_type("oracle9", "INT")
    assert len(types.common_types()) == 23
    assert types.to_spark("decimal").simpleString() == "decimal(38,18)" and types.to_spark("decimal", 10, 2).simpleString() == "decimal(10,2)"
    assert all(types.to_spark(c) is not None for c in types.common_types())


def test_key_hash():
    assert key_hash({"b": 1, "a": 2}) == key_hash({"a": 2, "b": 1})


def test_sampling():
    assert "TABLESAMPLE" not in sampling_sql("t", 10, "snowflake") and sampling_sql("t", 10, "snowflake").endswith("LIMIT 10")
    assert "TABLESAMPLE" in sampling_sql("t", 5000, "snowflake") and percentage(5000) == 5.0
    assert "LIMIT 10000" in sampling_sql("t", 50_000, "mysql")


def test_config():
    assert Config("postgres", "localhost", 5432, "d", username="u", password="p").validate().system == "postgresql"
    for bad in ({"port": 0}, {"host": "a b"}, {"username": " "}):
        with pytest.raises(ValueError):
            Config("postgresql", **({"host": "h", "database": "d", "username": "u", "password": "p"} | bad)).validate()
    with pytest.raises(ValueError):
        Config("nonesuch")
    assert "secret" not in repr(Config("mysql", "h", database="d", username="u", password="secret"))
    assert snowflake_account("https://ab12.eu-west-1.snowflakecomputing.com:443") == "ab12.eu-west-1" and snowflake_account("ab12") == "ab12"
    for bad in ("", "a.b", "a b", ".snowflakecomputing.com"):
        with pytest.raises(ValueError):
            snowflake_account(bad)
    env = {"POSTGRES_HOST": "h", "POSTGRES_USER": "u", "POSTGRES_PASSWORD": "p", "POSTGRES_DATABASE": "d", "TARGET_POSTGRES_HOST": "h2"}
    form, options = reader_options(from_environment("postgresql", env, "TARGET_"), "t")
    assert form == "jdbc" and options["url"].startswith("jdbc:postgresql://h2:5432/d?") and options["dbtable"] == "t"
    assert bigquery_credentials({"credentials_path": "/k"}, {"GOOGLE_APPLICATION_CREDENTIALS": "/e"}) == {"credentialsFile": "/k"}
    assert bigquery_credentials({}, {}) == {}


def attempts(spark):
    r = Recorder()
    for source, method, d, ok, e in (("snowflake", "arrow", 1.0, True, None), ("snowflake", "arrow", 2.0, True, None), ("snowflake", "arrow", 0.5, False, "Auth error: no"), ("postgresql", "native", 1.5, True, None)):
        r.record_attempt(source, method, d, ok, e)
    return r


def test_metrics(spark):
    found = {r.source_type: r for r in connection_statistics(attempts(spark).attempts_frame(spark)).collect()}
    s = found["snowflake"]
    assert s.total_attempts == 3 and s.success_rate == pytest.approx(2 / 3) and s.avg_duration == pytest.approx(3.5 / 3)
    m = {r.method: r for r in method_comparison(attempts(spark).attempts_frame(spark)).collect()}
    assert m["arrow"].error_types == ["Auth error"] and m["arrow"].usage == 0.75
    r = Recorder()
    for i in range(1, 11):
        r.record_attempt("s", "m", float(i), True)
    row = connection_statistics(r.attempts_frame(spark)).first()
    assert (row.median_duration, row.p95_duration) == (5.5, 9.0)
    small = Recorder(5)
    for i in range(10):
        small.record_attempt("s", "m", float(i), True)
    assert [a[3] for a in small.attempts] == [5.0, 6.0, 7.0, 8.0, 9.0]
    errors = Recorder()
    for e in ("Auth failed", "Auth failed ", "Auth failed", "Network timeout"):
        errors.record_attempt("s", "m", 1.0, False, e)
    assert [tuple(x) for x in top_errors(errors.attempts_frame(spark)).collect()] == [("Auth failed", 3), ("Network timeout", 1)]
    q = Recorder()
    for d, n, size, ok in ((0.1, 1, 100, True), (0.2, 2, 200, True), (0.3, 3, 300, False)):
        q.record_query("select 1", d, n, size - 0 if ok else 0, ok)
    s = query_statistics(q.queries_frame(spark)).first()
    assert s.success_rate == pytest.approx(2 / 3) and s.avg_execution_time == pytest.approx(0.15) and s.total_bytes == 300
    assert set(q.export()) == {"connection_attempts", "query_executions"} and q.export("json").startswith("{") and "query_execution" in q.export("csv")
    with pytest.raises(ValueError):
        q.export("xml")


def test_schema(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "x")], "ID long, v string")
    assert check_schema(a, b) and not check_schema(a, b, strict=True) and not check_schema(a, b.drop("v"))
    assert [d["column"] for d in compare_schemas(a, b)["different"]] == ["id"]
    assert primary_keys(mark_primary_keys(a, ["ID"])) == ["id"]


def test_catalog_rows(spark):
    cols = columns_from_catalog("snowflake", [{"COLUMN_NAME": "ID", "DATA_TYPE": "NUMBER(38,0)", "IS_NULLABLE": "NO"}])
    assert (cols[0].data_type, cols[0].nullable) == ("decimal", False)
    cols = columns_from_catalog("postgresql", [{"column_name": "id", "data_type": "integer", "is_nullable": "NO"}], {"id"})
    assert (cols[0].data_type, cols[0].is_primary_key) == ("int32", True)


def test_files(spark, tmp_path):
    folder = tmp_path / "data"
    spark.createDataFrame([(1, "x")], "k int, v string").coalesce(1).write.parquet(str(folder / "p.parquet"))
    (folder / "people.csv").write_text('id;name;d\n1;"a;b";2024-01-02\n2;NA;2024-01-03\n3;"two\nlines";2024-01-04\n')
    (folder / "more.tsv").write_text("id\tname\n9\tz\n")
    with open_source(spark, Config("csv", path=str(folder))) as source:
        assert source.list_tables() == ["more", "people"]
        df = source.table("people")
        assert [t for _, t in df.dtypes] == ["bigint", "string", "date"] and df.count() == 3 and df.where("name is null").count() == 1
        assert source.table("more").first().name == "z"
        assert source.metadata("people").row_count == 3
    with pytest.raises(FileNotFoundError):
        open_source(spark, Config("parquet", path=str(tmp_path / "none"))).table()
    with pytest.raises(ValueError):
        open_source(spark, Config("parquet", path=str(folder / "people.csv"))).table()
    kept = Sources(spark)
    kept.create("one", Config("csv", path=str(folder)))
    assert kept.list() == ["one"] and kept.test("one") and kept.remove("one") and not kept.remove("one")


def test_leading_zeros_stay(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("id,n,m\n007,7,0.5\n12,0,-3\n")
    df = open_source(spark, Config("csv", path=str(tmp_path / "ids.csv"))).table()
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double"] and df.first().id == "007"


def test_files_are_split_unless_values_span_lines(spark, tmp_path):
    (tmp_path / "flat.csv").write_text('a,b\n1,"x ""y"""\n2,z\n')
    (tmp_path / "tall.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    source = open_source(spark, Config("csv", path=str(tmp_path)))
    for name, spans in (("flat", False), ("tall", True)):
        assert source.spans_lines(source.dialect(str(tmp_path / f"{name}.csv")), source.chosen(name)) == spans
        assert source.table(name).count() == 2
    assert source.query("select count(*) as n from {flat} where a >= :low", {"low": 2}).first().n == 1


def test_remote_sql(spark, monkeypatch):
    asked = []
    source = open_source(spark, Config("postgresql", "h", database="d", schema="s", username="u", password="p", extra={"parts": 4, "primary_keys": {"t": ["id"]}}))

    def answer(sql):
        asked.append(sql)
        rows = {"key_column_usage": ([("id",)], "column_name string"), "pg_index": ([("t_pkey", 1, "id"), ("t_ix", 2, "b"), ("t_ix", 1, "a")], "index_name string, seq_in_index long, column_name string"), "pg_total": ([(90, 8192)], "row_estimate long, size_bytes long"), "information_schema.columns": ([("id", "integer", "NO", None, 32, 0, None), ("a", "character varying", "YES", 20, None, None, None)], "column_name string, data_type string, is_nullable string, character_maximum_length int, numeric_precision int, numeric_scale int, column_default string"), "count(*)": ([(88,)], "n long"), "min(": ([(1, 88)], "low long, high long")}
        found = next((v for k, v in rows.items() if k in sql), ([("x",)], "v string"))
        return spark.createDataFrame(*found)

    monkeypatch.setattr(source, "remote_query", answer)
    info = source.metadata("t")
    assert (info.row_count, info.size_bytes, info.primary_keys, info.indexes) == (88, 8192, ["id"], {"t_pkey": ["id"], "t_ix": ["a", "b"]})
    assert source.metadata("t", count=False).row_count == 90 and info.columns[1].max_length == 20 and "'s'" in asked[0]
    assert source._split("t", ["id"]) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "88", "numPartitions": "4"}
    source.sample("t", 5000)
    assert "TABLESAMPLE BERNOULLI (5) LIMIT 5000" in asked[-1] and '"t"' in asked[-1]
    source.hashes("t", ["id"], ["id", "a"])
    assert asked[-1].startswith('select "id", md5(coalesce(') and asked[-1].endswith('as row_hash from "t"')
    for bad in ("t; drop", "t'"):
        with pytest.raises(ValueError):
            source.hashes(bad, ["id"], ["id"])
    source.list_tables("x' or '1'='1")
    assert "'x'' or ''1''=''1'" in asked[-1]


def test_first_way_that_works(spark):
    source = open_source(spark, Config("snowflake", "ab12", database="d", username="u", password="p", url="jdbc:derby:memory:ways;create=true", extra={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}), retries=0)
    spark.createDataFrame([(1,)], "k int").write.format("jdbc").options(url=source.config.url, dbtable="W1", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    assert source.table("APP.W1").count() == 1
    with pytest.raises(ConnectionError, match="snowflake: .*jdbc: "):
        source.table("NOT_THERE")


def test_history_reads_runs_from_before_a_column_was_added(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"))
    spark.createDataFrame([("r", "j", "success")], "run_id string, job_id string, status string").write.parquet(str(tmp_path / "h" / "diff_run" / "j" / "r"))
    row = history.list_runs("j").first()
    assert (row.run_id, row.status, row.metadata) == ("r", "success", None)


def test_jdbc(spark):
    url, driver = "jdbc:derby:memory:diff;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string").write.format("jdbc").options(url=url, dbtable="T1", driver=driver).mode("overwrite").save()
    source = open_source(spark, Config("jdbc", url=url, extra={"driver": driver, "primary_keys": {"T1": ["k"]}}))
    df = source.table("T1")
    assert primary_keys(df) == ["k"] or primary_keys(df) == ["K"]
    assert TableDiff(df, spark.createDataFrame([(1, "x"), (3, "z")], "k int, v string"), "k").compare().summary.total_differences == 2


def test_history(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"))
    assert History(spark, str(tmp_path / "h")).read("project").count() == 1
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    run = TableDiff(a, b, "k").compare()
    job = history.job("a", "b", ["k"])
    assert history.job("a", "b", ["k"]) == job and history.read("diff_job").count() == 1
    ids = [history.save(job, run, i == 0, datetime(2024, 1, i + 1, tzinfo=timezone.utc)) for i in range(3)]
    rows = history.read("diff_row").where(f"run_id = '{ids[0]}'").collect()
    assert sorted(r.status for r in rows) == ["added", "deleted", "modified"] and all(r.source_values or r.target_values for r in rows)
    assert history.read("diff_row").where(f"run_id = '{ids[1]}' and source_values is not null").count() == 0
    assert [r.run_id for r in history.list_runs(job).collect()] == ids[::-1]
    assert history.delete_old_runs(job, 1) == 2 and history.read("diff_row").select("run_id").distinct().count() == 1


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string").write.parquet(str(tmp_path / "b.parquet"))
    args = ["--source", f"parquet:{tmp_path}/a.parquet", "--target", f"parquet:{tmp_path}/b.parquet", "--keys", "k"]
    assert main([*args, "--save", str(tmp_path / "h")], spark) == 1
    assert "modified 1" in capsys.readouterr().out
    assert main([*args[:2], "--target", args[1], "--keys", "k"], spark) == 0
    assert main(args[:4], spark) == 2
