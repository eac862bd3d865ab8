"""DuckDB SQL with the same answer as each catalogue query (same column names, same types after casts).

The tables are the driver's views: region nation customer supplier part orders lineitem events embeddings.
Job-fleet queries derive their jobs from lineitem with the same rules as :mod:`sparkwright.functions.jobs`.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["scan_filter"] = """
SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'
"""

SQL["preview"] = """
SELECT * FROM orders ORDER BY o_orderkey LIMIT 20
"""

SQL["project_case"] = """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS price_band,
       upper(o_orderstatus) AS status_upper,
       CAST(year(o_orderdate) AS INTEGER) AS order_year
FROM orders
"""

SQL["add_columns"] = """
SELECT *, l_extendedprice * (1 - l_discount) AS net,
       (l_extendedprice * (1 - l_discount)) * (1 + l_tax) AS gross
FROM lineitem
"""

SQL["scalar_string"] = """
SELECT p_partkey, upper(p_name) AS name_upper, CAST(length(p_name) AS INTEGER) AS name_len,
       substr(p_brand, 1, 5) AS brand_head, concat(p_brand, '-', p_type) AS label,
       replace(p_name, ' ', '_') AS name_snake, lpad(CAST(p_size AS VARCHAR), 3, '0') AS size_padded,
       split_part(p_name, ' ', 1) AS first_word
FROM part WHERE p_name LIKE '%widget%'
"""

SQL["scalar_date"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
       CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(month(o_orderdate) AS INTEGER) AS order_month,
       CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due_date,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days_to_2000,
       strftime(o_orderdate, '%Y-%m') AS year_month
FROM orders
"""

SQL["scalar_math"] = """
SELECT s_suppkey, abs(s_acctbal) AS abs_bal, CAST(floor(s_acctbal) AS BIGINT) AS floor_bal,
       CAST(ceil(s_acctbal) AS BIGINT) AS ceil_bal, sqrt(abs(s_acctbal)) AS sqrt_bal,
       s_suppkey % 7 AS key_mod_7, CAST(sign(s_acctbal) AS INTEGER) AS sign_bal,
       least(greatest(s_acctbal, 0.0), 5000.0) AS capped_bal
FROM supplier
"""

SQL["scalar_json"] = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.k') IS NOT NULL AS has_k
FROM events
"""

SQL["scalar_array"] = """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(embedding[1] AS DOUBLE) AS first_item,
       CAST(list_max(embedding) AS DOUBLE) AS max_item, CAST(list_min(embedding) AS DOUBLE) AS min_item, label
FROM embeddings
"""

SQL["inner_join"] = """
SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment = 'BUILDING'
"""
SQL["broadcast_join"] = SQL["inner_join"]

SQL["left_join"] = """
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey
"""
SQL["right_join"] = """
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice
FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey
"""

SQL["full_join"] = """
SELECT s.s_suppkey, s.s_nationkey, c.c_custkey, c.c_nationkey
FROM (SELECT * FROM supplier WHERE s_nationkey < 15) s
FULL JOIN (SELECT * FROM customer WHERE c_nationkey >= 10 AND c_acctbal > 9000) c ON s.s_nationkey = c.c_nationkey
"""

SQL["self_join"] = """
SELECT l.s_suppkey AS left_key, r.s_suppkey AS right_key, l.s_nationkey = r.s_nationkey AS same_nation
FROM supplier l JOIN supplier r ON r.s_suppkey = l.s_suppkey + 1
"""

SQL["subquery_join"] = """
SELECT c.c_custkey, c.c_name, oc.n_orders
FROM customer c JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) oc
  ON c.c_custkey = oc.o_custkey
"""

SQL["subquery_union"] = """
SELECT c.c_custkey, c.c_name, u.o_orderkey
FROM customer c JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000
                      UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') u
  ON c.c_custkey = u.o_custkey
"""

SQL["subquery_rollup"] = """
SELECT n.n_name, r.seg, r.nat, r.n
FROM nation n JOIN (SELECT c_mktsegment AS seg, c_nationkey AS nat, count(*) AS n
                    FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)) r
  ON n.n_nationkey = r.nat
"""

SQL["subquery_topk"] = """
SELECT c.c_name, t.o_orderkey, t.o_totalprice
FROM customer c JOIN (SELECT o_orderkey, o_custkey, o_totalprice FROM orders
                      ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) t
  ON c.c_custkey = t.o_custkey
"""

SQL["subquery_setops"] = """
SELECT c.c_custkey, c.c_name
FROM customer c JOIN ((SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
                       INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
                      EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') s
  ON c.c_custkey = s.o_custkey
"""

_JOIN_CHAIN_FROM = """
FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c
JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey
WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 100000
"""

SQL["join_chain"] = "SELECT c.*, o.*, l.* " + _JOIN_CHAIN_FROM
SQL["join_chain_hot"] = SQL["join_chain"]

SQL["semi_join"] = """
SELECT c.* FROM customer c SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o
  ON c.c_custkey = o.o_custkey
"""
SQL["anti_join"] = """
SELECT c.* FROM customer c ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o
  ON c.c_custkey = o.o_custkey
"""

SQL["cross_join"] = "SELECT r.*, n.* FROM region r CROSS JOIN nation n"

SQL["theta_join"] = """
SELECT p.p_partkey, s.s_suppkey, p.p_retailprice, s.s_acctbal
FROM (SELECT * FROM part WHERE p_size > 45) p
JOIN supplier s ON s.s_acctbal BETWEEN p.p_retailprice AND p.p_retailprice + 100
"""

SQL["salted_join"] = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, p.p_retailprice
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

SQL["salted_left_join"] = """
SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_name
FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 8000) c ON o.o_custkey = c.c_custkey
"""

SQL["salted_full_join"] = """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_custkey, c.c_name
FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o
FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 8000) c ON o.o_custkey = c.c_custkey
"""

SQL["salted_right_join"] = """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_custkey, c.c_name
FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o
RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 8000) c ON o.o_custkey = c.c_custkey
"""

SQL["group_agg"] = """
SELECT l_returnflag,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty,
       avg(l_quantity) AS avg_qty,
       count(*) AS n_lines, max(l_discount) AS max_disc, min(l_shipdate) AS min_ship
FROM lineitem GROUP BY l_returnflag
"""

SQL["group_multi"] = """
SELECT n.n_name, c.c_mktsegment, count(*) AS n_customers,
       CAST(sum(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_bal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, c.c_mktsegment
"""

SQL["count_distinct"] = """
SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_nations, count(c_custkey) AS n_customers
FROM customer GROUP BY c_mktsegment
"""

SQL["conditional_agg"] = """
SELECT c_mktsegment,
       CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS n_rich,
       CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rich_share,
       CAST(sum(CASE WHEN c_acctbal < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS neg_bal
FROM customer GROUP BY c_mktsegment
"""

SQL["global_agg"] = """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price, count(*) AS n_lines
FROM lineitem
"""

SQL["window_rank"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER)
       AS price_rank
FROM orders
"""

SQL["window_sum"] = """
SELECT *, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate, o_orderkey) AS DECIMAL(38,2)) AS running_total
FROM orders
"""

SQL["window_frame"] = """
SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
       CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_last3
FROM events
"""

SQL["window_rank_hot"] = SQL["window_rank"]
SQL["window_sum_hot"] = SQL["window_sum"]
SQL["window_frame_hot"] = SQL["window_frame"]

SQL["window_analytics"] = """
SELECT *,
       CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS date_rank,
       CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS date_dense_rank,
       lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS last3_total
FROM orders
"""

SQL["spec_agg"] = """
SELECT c.c_nationkey, o.o_orderpriority, count(*) AS n_rows, count(l.l_orderkey) AS n_returned,
       CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty, max(o.o_totalprice) AS max_price
""" + _JOIN_CHAIN_FROM + """
GROUP BY c.c_nationkey, o.o_orderpriority
"""

SQL["spec_select"] = """
SELECT c.c_name, o.o_orderkey, l.l_linenumber, l.l_extendedprice * (1 - l.l_discount) AS revenue,
       o.o_orderpriority = '1-URGENT' AS is_urgent
""" + _JOIN_CHAIN_FROM

SQL["theta_grid"] = """
SELECT u.o_orderkey AS urgent_key, p.o_orderkey AS low_key, u.o_totalprice AS urgent_price, p.o_totalprice AS low_price
FROM orders u JOIN orders p ON u.o_totalprice + 450000 < p.o_totalprice
  AND date_diff('day', DATE '1970-01-01', CAST(u.o_orderdate AS DATE)) >= date_diff('day', DATE '1970-01-01', CAST(p.o_orderdate AS DATE)) + 2200
WHERE u.o_orderpriority = '1-URGENT' AND p.o_orderpriority = '5-LOW'
"""

SQL["overlap_join"] = """
SELECT o_orderkey, l_orderkey, l_linenumber, o_orderdate, l_shipdate
FROM (SELECT *, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 7 AS b FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000) o
JOIN (SELECT *, CAST(l_shipdate AS DATE) AS c, CAST(l_shipdate AS DATE) + CASE WHEN l_linenumber = 7 THEN 90 ELSE l_linenumber END AS d
      FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 AND l_discount >= 0.08) l ON a <= d AND c <= b
"""

SQL["scalar_variant"] = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text,
  CAST(json_extract_string(props, '$.nothing') AS INTEGER) AS nothing, json_type(props) = 'OBJECT' AS is_object,
  CAST(json(props) AS VARCHAR) AS compact, f.key AS field, CAST(f.id - f.id AS INTEGER) AS field_pos, CAST(json_extract_string(props, '$.' || f.key) AS INTEGER) AS field_value
FROM events, json_each(props) AS f
"""

SQL["scalar_map"] = """
WITH m AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS v, CAST(event_id % 100 AS INTEGER) AS e FROM events)
SELECT event_id,
  CAST((coalesce(k, 0) > 50)::INTEGER + (v > 50)::INTEGER + (e > 50)::INTEGER AS INTEGER) AS n_big,
  concat_ws(',', CASE WHEN e > 50 THEN 'e' END, CASE WHEN coalesce(k, 0) > 50 THEN 'k' END, CASE WHEN v > 50 THEN 'v' END) AS big_names,
  k * 2 AS k_doubled, CASE WHEN k IS NOT NULL THEN 'k_old' ELSE '' END AS renamed,
  coalesce(k, 0) + coalesce(k, 0) AS zipped, CAST(2 + (k IS NOT NULL)::INTEGER AS INTEGER) AS n_joined, k IS NOT NULL AS has_k,
  CAST(coalesce(k, 0) + v + e AS INTEGER) AS sum_items
FROM m
"""

SQL["scalar_conditional"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_tax, 0.0) AS no_zero_tax,
  coalesce(nullif(l_tax, 0.0), nullif(l_discount, 0.0), CAST(-1.0 AS DOUBLE)) AS tax_or_discount,
  CASE WHEN nullif(l_tax, 0.0) IS NOT NULL THEN 'taxed' ELSE 'free' END AS has_tax,
  greatest(l_tax, l_discount) AS larger_rate, least(l_tax, l_discount) AS smaller_rate,
  CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'open' END AS flag_name,
  CASE WHEN l_quantity >= 25 THEN 'large' WHEN l_quantity >= 10 THEN 'middle' ELSE 'small' END AS size_class,
  CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS price_per_rate,
  l_tax IS NOT DISTINCT FROM l_discount AS same_rates
FROM lineitem
"""
