"""Statements of ordinary SQL over measurements and the shared tables: projections, joins, groups, windows, sets."""

from __future__ import annotations

from tidemark.queries import statement

D = 86_400_000_000

# -- projection, predicates, functions
statement("project_computed", "SELECT timestamp_us, upper(tenant) AS tenant_up, value * 2 AS twice, -value AS neg, value - 1 AS less FROM {ev}")
statement("filter_between", "SELECT timestamp_us, value FROM {ev} WHERE value BETWEEN 10 AND 20 AND value NOT BETWEEN 14 AND 15")
statement("filter_in_list", "SELECT timestamp_us, tenant FROM {ev} WHERE tenant IN ('click', 'view') AND series NOT IN ('user_1', 'user_2')")
statement("filter_like", "SELECT DISTINCT series FROM {ev} WHERE series LIKE 'user!_1%' ESCAPE '!' AND series NOT LIKE '%9'")
statement("filter_nocase", "SELECT count(*) AS n FROM {ev} WHERE tenant COLLATE UTF8_LCASE = 'CLICK'", "SELECT count(*) AS n FROM {ev} WHERE tenant COLLATE NOCASE = 'CLICK'")
statement("filter_binary", "SELECT count(*) AS n FROM {ev} WHERE tenant = 'Click'")
statement("filter_distinct_from", "SELECT count(*) AS n FROM {ev} WHERE nullif(tenant, 'click') IS DISTINCT FROM 'view' AND (value > 5) IS TRUE AND nullif(tenant, 'x') IS NOT NULL")
statement("filter_time_range", f"SELECT timestamp_us FROM {{ev}} WHERE timestamp_us >= 1704931200000000 AND timestamp_us < 1704931200000000 + 10 * {D}")
statement("case_cast", "SELECT timestamp_us, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, CAST(round(value) AS BIGINT) AS whole, CAST(timestamp_us AS STRING) AS text FROM {ev}", "SELECT timestamp_us, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, CAST(round(value) AS BIGINT) AS whole, CAST(timestamp_us AS VARCHAR) AS text FROM {ev}")
statement("scalar_functions", "SELECT timestamp_us, abs(-value) AS a, coalesce(nullif(tenant, 'click'), 'none') AS c, round(sin(value), 6) AS s, repeat(tenant, 2) AS r, lower(upper(tenant)) AS l, CAST(length(series) AS BIGINT) AS n, CAST(floor(value) AS DOUBLE) AS f, CAST(ceil(value) AS DOUBLE) AS ce, round(value, 1) AS ro, md5(series) AS m, startswith(series, 'user_1') AS st FROM {ev}", "SELECT timestamp_us, abs(-value) AS a, coalesce(nullif(tenant, 'click'), 'none') AS c, round(sin(value), 6) AS s, repeat(tenant, 2) AS r, lower(upper(tenant)) AS l, CAST(length(series) AS BIGINT) AS n, CAST(floor(value) AS DOUBLE) AS f, CAST(ceil(value) AS DOUBLE) AS ce, round(value, 1) AS ro, md5(series) AS m, starts_with(series, 'user_1') AS st FROM {ev}")
statement("string_functions", "SELECT DISTINCT series, substr(series, 6) AS id, trim('  ' || tenant || ' ') AS t, CAST(position('_' IN series) AS BIGINT) AS p, split(series, '_')[1] AS part, regexp_replace(series, '[0-9]+', '#') AS masked FROM {ev}", "SELECT DISTINCT series, substr(series, 6) AS id, trim('  ' || tenant || ' ') AS t, CAST(position('_' IN series) AS BIGINT) AS p, split_part(series, '_', 2) AS part, regexp_replace(series, '[0-9]+', '#', 'g') AS masked FROM {ev}")
statement("date_functions", "SELECT timestamp_us, unix_micros(date_trunc('minute', timestamp_micros(timestamp_us))) AS minute_us, unix_micros(date_trunc('month', timestamp_micros(timestamp_us))) AS month_us, CAST(extract(HOUR FROM timestamp_micros(timestamp_us)) AS BIGINT) AS h FROM {ev}", "SELECT timestamp_us, epoch_us(date_trunc('minute', make_timestamp(timestamp_us))) AS minute_us, epoch_us(date_trunc('month', make_timestamp(timestamp_us))) AS month_us, CAST(extract('hour' FROM make_timestamp(timestamp_us)) AS BIGINT) AS h FROM {ev}")
statement("json_tags", "SELECT timestamp_us, CAST(get_json_object(tags, '$.k') AS BIGINT) AS k FROM {ev}", "SELECT timestamp_us, CAST(json_extract_string(tags, '$.k') AS BIGINT) AS k FROM {ev}")
statement("arrays", "SELECT tenant, CAST(size(s) AS BIGINT) AS n, s[0] AS first_series, exists(s, x -> x = 'user_3') AS has_3 FROM (SELECT tenant, array_sort(collect_set(series)) AS s FROM {ev} GROUP BY tenant)", "SELECT tenant, CAST(len(s) AS BIGINT) AS n, s[1] AS first_series, list_contains(s, 'user_3') AS has_3 FROM (SELECT tenant, list_sort(list(DISTINCT series)) AS s FROM {ev} GROUP BY tenant)")
statement("unnest", "SELECT tenant, explode(array(1, 2, 3)) AS i FROM (SELECT DISTINCT tenant FROM {ev})", "SELECT tenant, unnest([1, 2, 3]) AS i FROM (SELECT DISTINCT tenant FROM {ev})")
statement("struct_fields", "SELECT tenant, p.lo AS lo, p.hi AS hi FROM (SELECT tenant, named_struct('lo', min(value), 'hi', max(value)) AS p FROM {ev} GROUP BY tenant)", "SELECT tenant, p.lo AS lo, p.hi AS hi FROM (SELECT tenant, struct_pack(lo := min(value), hi := max(value)) AS p FROM {ev} GROUP BY tenant)")
statement("numeric_edges", "SELECT CAST(7 % 3 AS BIGINT) AS m, CAST(-7 % 3 AS BIGINT) AS mn, 5 / 2 AS half, try_divide(1, 0) AS none, typeof(1.5D) AS kind", "SELECT CAST(7 % 3 AS BIGINT) AS m, CAST(-7 % 3 AS BIGINT) AS mn, 5 / 2 AS half, CAST(NULL AS DOUBLE) AS none, lower(typeof(1.5::DOUBLE)) AS kind")
statement("range_rows", "SELECT CAST(id AS BIGINT) AS i FROM range(100) WHERE id % 7 = 0", "SELECT range AS i FROM range(100) WHERE range % 7 = 0")

# -- joins
statement("join_inner_using", "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", tables="orders customer")
statement("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey", tables="orders customer")
statement("join_right", "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey", tables="supplier nation")
statement("join_full", "SELECT c_custkey, s_suppkey, s_name FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey * 200", tables="customer supplier")
statement("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)", tables="orders customer")
statement("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)", tables="orders customer")
statement("join_cross_single_rows", "SELECT a.n AS events, b.n AS orders FROM (SELECT count(*) AS n FROM {events}) a CROSS JOIN (SELECT count(*) AS n FROM {orders}) b", tables="events orders")
statement("join_self", "SELECT a.timestamp_us, a.series, b.tenant AS other FROM {ev} a JOIN {ev} b ON a.sequence = b.sequence AND a.ordinal + 1 = b.ordinal")
statement("join_star", "SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name", tables="lineitem supplier nation region")
statement("join_theta", "SELECT a.n_name AS one, b.n_name AS two FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", tables="nation")
statement("join_lateral", "SELECT n_name, x.top FROM {nation}, LATERAL (SELECT max(s_acctbal) AS top FROM {supplier} WHERE s_nationkey = n_nationkey) x", tables="nation supplier")

# -- groups
statement("group_having", "SELECT series, count(*) AS n FROM {ev} GROUP BY series HAVING count(*) > 5")
statement("group_distinct", "SELECT tenant, count(DISTINCT series) AS users, count(DISTINCT sequence) AS commits FROM {ev} GROUP BY tenant")
statement("group_filter", "SELECT tenant, count(*) FILTER (WHERE value > 50) AS high, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE value <= 50) AS DOUBLE) AS low_sum FROM {ev} GROUP BY tenant")
statement("group_string_agg", "SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ',') WITHIN GROUP (ORDER BY l_returnflag || l_linenumber) AS parts FROM {lineitem} GROUP BY l_orderkey", "SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag || l_linenumber) AS parts FROM {lineitem} GROUP BY l_orderkey", tables="lineitem")
statement("group_all", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM {lineitem} GROUP BY ALL", tables="lineitem")
statement("grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", tables="lineitem")
statement("group_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", tables="lineitem")
statement("group_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", tables="lineitem")
statement("group_statistics", "SELECT tenant, round(avg(value), 6) AS mean, round(stddev(value), 6) AS sd, round(var_pop(value), 4) AS vp, round(median(value), 6) AS med, bool_and(value >= 0) AS all_pos, round(corr(value, ordinal), 6) AS c FROM {ev} GROUP BY tenant")
statement("group_arg_min", "SELECT series, min_by(value, timestamp_us) AS first_value, max_by(value, timestamp_us) AS last_value FROM {ev} GROUP BY series", "SELECT series, arg_min(value, timestamp_us) AS first_value, arg_max(value, timestamp_us) AS last_value FROM {ev} GROUP BY series")
statement("group_percentile", "SELECT tenant, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM {ev} GROUP BY tenant", "SELECT tenant, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS p90 FROM {ev} GROUP BY tenant")

# -- windows
ORDER = "PARTITION BY tenant, series ORDER BY timestamp_us, sequence, ordinal"
statement("window_ranks", "SELECT timestamp_us, CAST(row_number() OVER (PARTITION BY tenant ORDER BY value, timestamp_us) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY tenant ORDER BY round(value)) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY tenant ORDER BY round(value)) AS BIGINT) AS dr FROM {ev}")
statement("window_lag_lead", f"SELECT timestamp_us, lag(value) OVER ({ORDER}) AS before, lead(value, 2, -1.0D) OVER ({ORDER}) AS after FROM {{ev}}", f"SELECT timestamp_us, lag(value) OVER ({ORDER}) AS before, lead(value, 2, -1.0) OVER ({ORDER}) AS after FROM {{ev}}")
statement("window_first_last", f"SELECT timestamp_us, first_value(value) OVER ({ORDER}) AS f, last_value(value) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {{ev}}")
statement("window_running", f"SELECT timestamp_us, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER ({ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS three, count(*) OVER ({ORDER} RANGE BETWEEN {7 * D} PRECEDING AND CURRENT ROW) AS week FROM {{ev}}".replace("timestamp_us, sequence, ordinal RANGE", "timestamp_us RANGE"))
statement("window_more", f"SELECT timestamp_us, CAST(ntile(4) OVER (PARTITION BY tenant ORDER BY timestamp_us) AS BIGINT) AS quarter, round(percent_rank() OVER (PARTITION BY tenant ORDER BY timestamp_us), 9) AS pr, round(cume_dist() OVER (PARTITION BY tenant ORDER BY timestamp_us), 9) AS cd, nth_value(value, 2) OVER (PARTITION BY tenant ORDER BY timestamp_us) AS second FROM {{ev}}")
statement("window_ignore_nulls", f"SELECT timestamp_us, last_value(v) IGNORE NULLS OVER (PARTITION BY tenant ORDER BY timestamp_us) AS seen FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM {{ev}})", "SELECT timestamp_us, last_value(v IGNORE NULLS) OVER (PARTITION BY tenant ORDER BY timestamp_us) AS seen FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM {ev})")
statement("window_qualify", "SELECT * FROM (SELECT tenant, series, value, CAST(row_number() OVER (PARTITION BY tenant ORDER BY value DESC, timestamp_us) AS BIGINT) AS rn FROM {ev}) WHERE rn = 1", "SELECT tenant, series, value, row_number() OVER (PARTITION BY tenant ORDER BY value DESC, timestamp_us) AS rn FROM {ev} QUALIFY rn = 1")

# -- order, limits, sets, subqueries
statement("top_k", "SELECT timestamp_us, value FROM {ev} ORDER BY value DESC NULLS LAST, timestamp_us LIMIT 20")
statement("limit_offset", "SELECT timestamp_us FROM {ev} ORDER BY 1 LIMIT 10 OFFSET 35")
statement("limit_in_derived_table", "SELECT tenant, count(*) AS n FROM (SELECT * FROM {ev} ORDER BY timestamp_us LIMIT 100) WHERE value > 10 GROUP BY tenant")
statement("filter_over_window", "SELECT timestamp_us, rn FROM (SELECT timestamp_us, CAST(row_number() OVER (ORDER BY timestamp_us) AS BIGINT) AS rn FROM (SELECT * FROM {ev} WHERE tenant = 'click' AND series = 'user_7')) WHERE timestamp_us >= 1704931200000000")
statement("distinct_rows", "SELECT DISTINCT tenant, series FROM {ev}")
statement("union_all", "SELECT series FROM {ev} WHERE value > 90 UNION ALL SELECT series FROM {ev} WHERE value < 5")
statement("union_distinct", "SELECT n_name AS name FROM {nation} UNION SELECT r_name FROM {region}", tables="nation region")
statement("intersect_all", "SELECT series FROM {ev} WHERE tenant = 'click' INTERSECT ALL SELECT series FROM {ev} WHERE tenant = 'view'")
statement("intersect_distinct", "SELECT series FROM {ev} WHERE tenant = 'click' INTERSECT SELECT series FROM {ev} WHERE tenant = 'view'")
statement("except_all", "SELECT series FROM {ev} WHERE tenant = 'click' EXCEPT ALL SELECT series FROM {ev} WHERE tenant = 'view'")
statement("except_distinct", "SELECT series, tenant FROM {ev} WHERE value > 5 EXCEPT SELECT series, tenant FROM {ev} WHERE value > 80")
statement("cte_chain", "WITH a AS (SELECT tenant, series, count(*) AS n FROM {ev} GROUP BY tenant, series), b AS (SELECT tenant, max(n) AS n FROM a GROUP BY tenant) SELECT a.* FROM a JOIN b USING (tenant, n)", "WITH a AS (SELECT tenant, series, count(*) AS n FROM {ev} GROUP BY tenant, series), b AS (SELECT tenant, max(n) AS n FROM a GROUP BY tenant) SELECT a.* FROM a JOIN b USING (tenant, n)")
statement("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT CAST(n AS BIGINT) AS n FROM t")
statement("scalar_subquery", "SELECT timestamp_us, value FROM {ev} WHERE value = (SELECT max(value) FROM {ev})")
statement("in_subquery", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)", tables="orders customer")
statement("correlated_subquery", "SELECT s_suppkey FROM {supplier} s WHERE s_acctbal > (SELECT avg(t.s_acctbal) FROM {supplier} t WHERE t.s_nationkey = s.s_nationkey)", tables="supplier")
statement("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem}) PIVOT (sum(l_quantity) FOR l_linestatus IN ('F' AS open_f, 'O' AS open_o))", "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS open_f, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_o FROM {lineitem} GROUP BY l_returnflag", tables="lineitem")
statement("star_except", "SELECT * EXCEPT (tags, sequence) FROM {ev}", "SELECT * EXCLUDE (tags, sequence) FROM {ev}")
statement("explain_text", "EXPLAIN SELECT count(*) FROM {ev}", "")
statement("sampled", "SELECT * FROM {nation} TABLESAMPLE (50 PERCENT) REPEATABLE (7)", "", tables="nation")
statement("join_using", "SELECT o_custkey, o_orderkey, c_name FROM {orders} JOIN (SELECT c_custkey AS o_custkey, c_name FROM {customer}) USING (o_custkey)", tables="orders customer")
statement("join_theta_only", "SELECT a.r_name AS one, b.n_name AS two FROM {region} a JOIN {nation} b ON a.r_name < b.n_name", tables="region nation")
statement("group_first_last", "SELECT tenant, min_by(value, struct(timestamp_us, ordinal)) AS f, max_by(value, struct(timestamp_us, ordinal)) AS l, mode(tenant) AS m, approx_count_distinct(tenant) AS a FROM {ev} GROUP BY tenant", "SELECT tenant, arg_min(value, (timestamp_us, ordinal)) AS f, arg_max(value, (timestamp_us, ordinal)) AS l, mode(tenant) AS m, approx_count_distinct(tenant) AS a FROM {ev} GROUP BY tenant")
statement("array_lambdas", "SELECT tenant, transform(sequence(1, 3), x -> x * 2) AS t, filter(sequence(1, 5), x -> x % 2 = 1) AS f, aggregate(sequence(1, 4), 0, (a, x) -> a + x) AS s, CAST(size(array_distinct(array_agg(series))) AS BIGINT) AS n FROM {ev} GROUP BY tenant", "SELECT tenant, list_transform([1, 2, 3], lambda x: x * 2) AS t, list_filter([1, 2, 3, 4, 5], lambda x: x % 2 = 1) AS f, CAST(list_sum([1, 2, 3, 4]) AS INT) AS s, CAST(len(list_distinct(array_agg(series))) AS BIGINT) AS n FROM {ev} GROUP BY tenant")
statement("maps", "SELECT DISTINCT tenant, map(tenant, 1, 'x', 2)['x'] AS x, map(tenant, 1, 'x', 2)[tenant] AS own, CAST(size(map_keys(map(tenant, 1, 'x', 2))) AS BIGINT) AS n FROM {ev}", "SELECT DISTINCT tenant, map([tenant, 'x'], [1, 2])['x'] AS x, map([tenant, 'x'], [1, 2])[tenant] AS own, CAST(len(map_keys(map([tenant, 'x'], [1, 2]))) AS BIGINT) AS n FROM {ev}")
statement("intervals", "SELECT timestamp_us, unix_micros(timestamp_micros(timestamp_us) + INTERVAL 36 HOURS) AS later_us, CAST(datediff(DATE '2024-02-01', CAST(timestamp_micros(timestamp_us) AS DATE)) AS BIGINT) AS days, date_format(timestamp_micros(timestamp_us), 'yyyy-MM-dd HH:mm') AS text FROM {ev}", "SELECT timestamp_us, epoch_us(make_timestamp(timestamp_us) + INTERVAL 36 HOURS) AS later_us, date_diff('day', CAST(make_timestamp(timestamp_us) AS DATE), DATE '2024-02-01') AS days, strftime(make_timestamp(timestamp_us), '%Y-%m-%d %H:%M') AS text FROM {ev}")
