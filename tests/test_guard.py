from __future__ import annotations

import pytest

from tidemark.engine import Database
from tidemark.model import Rejected
from tidemark.plans.guard import FORBIDDEN, by_name_parts, check_query, is_call, parse_call, spark_text, tokens, translated


def text_of(sql, relations=()):
    return spark_text(translated(check_query(sql), set(relations)))


@pytest.mark.parametrize("sql", ["SELECT 1;", "with a as (select 1) select * from a", "EXPLAIN SELECT 'drop; table'", 'SELECT "update" FROM t -- delete', "SELECT /* a /* b */ drop */ 1"])
def test_allowed(sql):
    assert check_query(sql)


@pytest.mark.parametrize("sql", ["", "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE x", "SELECT 'x", "SELECT /* x", "SELECT replace('a', 'b', 'c')", "VALUES (1)", "SELECT " + "1," * 40_000 + "1", "SELECT '\0'"])
def test_refused(sql):
    with pytest.raises(Rejected):
        check_query(sql)


@pytest.mark.parametrize("word", sorted(FORBIDDEN))
def test_forbidden_words(word):
    with pytest.raises(Rejected):
        check_query(f"SELECT {word.lower()} FROM t")


def test_calls():
    assert is_call(" /* x */ call f()") and not is_call("SELECT 1")
    assert parse_call("CALL F('it''s', -5, TRUE, null);") == ("f", ["it's", -5, True, None])
    for bad in ("CALL f(1 2)", "CALL f(lower('x'))", "CALL f(1,)", "CALL f(1); SELECT 1", "CALL f(1.5)", "CALL f"):
        with pytest.raises(Rejected):
            parse_call(bad)


def test_catalog_relations_by_name():
    sql = "SELECT 'ts_tables()' AS a, \"ts_tables()\" FROM TS_TABLES() t -- ts_tables()"
    assert text_of(sql, {"ts_tables"}) == "SELECT 'ts_tables()' AS a , `ts_tables()` FROM ts_tables t"


def test_strings_have_no_escapes():
    assert list(tokens(r"SELECT '\' , DROP , '\'"))[3] == ("word", "DROP")
    with pytest.raises(Rejected):
        check_query(r"SELECT '\' , DROP , '\'")
    assert text_of(r"""SELECT 'a\b''c', "x""`y" """) == r"""SELECT 'a\\b\'c' , `x"``y`"""


def test_names_of_the_dialect():
    assert text_of("SELECT strftime(t, '%Y-%m-%dT%H') FROM x") == r"SELECT date_format ( t , 'yyyy-MM-dd\'T\'HH' ) FROM x"
    assert text_of("SELECT * EXCLUDE (a), date_diff('day', a, b), to_timestamp(1), current_setting('TimeZone')") == "SELECT * EXCEPT ( a ) , ts_date_diff ( 'day' , a , b ) , timestamp_seconds ( 1 ) , 'UTC'"
    with pytest.raises(Rejected):
        text_of("SELECT current_setting('home')")
    left, every, right = by_name_parts(check_query("SELECT 1 AS a UNION ALL BY NAME SELECT 2 AS b"))
    assert every and spark_text(left) == "SELECT 1 AS a" and spark_text(right) == "SELECT 2 AS b"


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, str(tmp_path_factory.mktemp("guard") / "db"))
    db.create_table("metrics", {"rollup_widths_us": [10]})
    db.write("metrics", "a", [{"timestamp_us": t, "tenant": f"t{t % 2}", "series": r"a\b", "value": float(t)} for t in range(6)], 0)
    return db


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT TRANSFORM(tenant) USING 'cat' AS (x) FROM metrics",
        "FROM metrics SELECT TRANSFORM(tenant) USING 'cat'",
        "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT (SELECT try_reflect('java.lang.System', 'getenv', 'HOME'))",
        "SELECT x FROM (SELECT java_method('java.lang.Runtime', 'getRuntime') AS x)",
        "SELECT 1 FROM metrics WHERE EXISTS (SELECT reflect('a', 'b'))",
        r"SELECT '\'' , DROP , '\''",
        "SELECT * FROM parquet.`/etc/passwd`",
        "SELECT * FROM text.\"/etc/passwd\"",
        "SELECT * FROM read_text('/etc/passwd')",
        "SELECT * FROM read_csv('https://example.invalid/secret.csv')",
        "SELECT * FROM read_parquet('x')",
        "SELECT getenv('HOME')",
        "SELECT input_file_name() FROM metrics",
        "SELECT current_user()",
        "SELECT from_protobuf(tenant, 'a', '/etc/passwd') FROM metrics",
        "SELECT * FROM other",
        "SELECT * FROM default.metrics",
        "SELECT * FROM global_temp.metrics",
        "SELECT * FROM sql_keywords()",
        "EXPLAIN SELECT java_method('a', 'b')",
        "SELECT 1 UNION ALL BY NAME SELECT reflect('a', 'b')",
    ],
)
def test_nothing_but_reading(db, sql):
    with pytest.raises(Rejected):
        db.query(sql).collect()


def test_a_table_of_the_session_is_out_of_reach(spark, db):
    spark.sql("CREATE TABLE IF NOT EXISTS guarded_secret USING parquet AS SELECT 1 AS a")
    try:
        for sql in ("SELECT * FROM guarded_secret", "SELECT * FROM (WITH guarded_secret AS (SELECT 1 AS a) SELECT a FROM guarded_secret) JOIN guarded_secret USING (a)"):
            with pytest.raises(Rejected):
                db.query(sql)
    finally:
        spark.sql("DROP TABLE guarded_secret")


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        (r"SELECT count(*) AS n FROM metrics WHERE series = 'a\b'", [(6,)]),
        ("SELECT first(value) AS f, last(value) AS l FROM (SELECT value FROM metrics ORDER BY timestamp_us)", [(0.0, 5.0)]),
        ("SELECT epoch_us(to_timestamp(2)) AS a, epoch_us(time_bucket(INTERVAL '5' MINUTE, to_timestamp(946857600 + 400))) AS b", [(2_000_000, 946857900_000_000)]),
        ("SELECT date_diff('day', to_timestamp(86399), to_timestamp(86400)) AS d, date_diff('hour', to_timestamp(0), to_timestamp(7199)) AS h", [(1, 1)]),
        ("SELECT strftime(to_timestamp(0), '%Y/%m/%d %H:%M') AS t, current_setting('lock_configuration') AS c", [("1970/01/01 00:00", True)]),
        ("SELECT map_from_arrays(list_sort(list(DISTINCT tenant)), array(1, 2))['t1'] AS m, approx_count_distinct(tenant) AS a, mode(tenant) IS NOT NULL AS o FROM metrics", [(2, 2, True)]),
        ("SELECT list_transform(array(1, 2), x -> x + 1) AS a, list_filter(array(1, 2), x -> x > 1) AS b, list_reduce(array(1, 2), 0, (a, x) -> a + x) AS c", [([2, 3], [2], 3)]),
        ("SELECT 1 AS a, 2 AS b UNION BY NAME SELECT 2 AS b, 1 AS a", [(1, 2)]),
        ("SELECT 1 AS n UNION ALL BY NAME SELECT 5 AS n, 6 AS m", [(1, None), (5, 6)]),
        ("SELECT random() < 1 AS r, CAST(value AS INT)::STRING AS s FROM metrics WHERE timestamp_us = 3", [(True, "3")]),
        ("SELECT * EXCLUDE (tags, sequence, ordinal, series, tenant) FROM metrics WHERE value = 4", [(4, 4.0)]),
    ],
)
def test_what_users_type(db, sql, expected):
    assert [tuple(r) for r in db.query(sql).collect()] == expected


def test_explained(db):
    assert "Aggregate" in db.query("EXPLAIN SELECT count(*) FROM metrics").first().plan
    assert db.query("EXPLAIN (FORMAT JSON) SELECT count(*) FROM metrics").first().plan.startswith("[")


def test_limits(db):
    assert db.fetch("SELECT count(*) AS n FROM metrics") == [{"n": 6}]
    with pytest.raises(Rejected):
        db.fetch("SELECT * FROM metrics", max_rows=5)
    with pytest.raises(Rejected):
        db.fetch("SELECT repeat('x', 1000) AS x", max_bytes=100)
    with pytest.raises(Rejected, match="too long"):
        db.fetch("SELECT max(hash(id)) AS n FROM range(1000000000000)", timeout_s=1.0)
