"""DuckDB oracle statements (one self-contained statement per query).

Each statement rebuilds the ``online_retail`` view from the pre-registered
TPC-H-style tables as a CTE, then expresses the report in plain SQL.
"""

from __future__ import annotations

RETAIL_CTE = """
online_retail AS (
  SELECT
    CASE WHEN l.l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l.l_orderkey AS VARCHAR) AS invoice,
    CAST(l.l_partkey AS VARCHAR) AS stock_code,
    CASE WHEN l.l_partkey % 50 = 0 THEN NULL ELSE p.p_name END AS description,
    CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS INTEGER) AS quantity,
    CAST(o.o_orderdate AS TIMESTAMP) + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)) AS invoice_date,
    CAST(CASE WHEN l.l_partkey % 97 = 0 THEN 0 ELSE l.l_extendedprice END AS DECIMAL(12,2)) AS price,
    CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
    n.n_name AS country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

CLEAN_CTE = """
clean AS (
  SELECT *, quantity * price AS amount FROM online_retail
  WHERE customer_id IS NOT NULL
    AND NOT starts_with(coalesce(invoice, ''), 'C')
    AND quantity > 0 AND price > 0
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()
