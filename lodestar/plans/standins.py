"""The reference roles on the driver's tables.

Each role is one SELECT that both Spark and other SQL engines read; tables are written
in braces.  Roles cover whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROLES = {
    # Probe events: base name and scope, error, operation, mark, duration, trace, frame, file.
    "probes": """
SELECT concat(event_type, CASE event_id % 3 WHEN 0 THEN '.enter' WHEN 1 THEN '.exit' ELSE '.catch' END) AS probe,
  event_type AS base, ts AS time, event_id AS seq,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('E', cast(event_id % 7 AS varchar(9))) WHEN event_id % 11 = 0 THEN '' END AS err,
  CASE event_id % 4 WHEN 0 THEN 'writefile' WHEN 1 THEN 'remove' WHEN 2 THEN 'cleanup' END AS op,
  event_id % 5 = 0 AS benign, cast(floor(value * 1000) AS bigint) AS dur_us, user_id AS trace_id, event_id AS frame_id,
  concat('src/', event_type, '.ts') AS file
FROM {events}""",
    # Symbols: one for each part.
    "nodes": """
SELECT concat('src/', lower(p_type), '/', lower(replace(p_brand, '#', '')), '.ts#', replace(p_name, ' ', '_'), '_', cast(p_partkey AS varchar(20))) AS id, p_partkey AS key,
  CASE WHEN p_size >= 48 THEN 'file' WHEN p_size % 3 = 0 THEN 'method' ELSE 'function' END AS kind,
  replace(p_name, ' ', '_') AS name, concat(lower(p_type), '.', replace(p_name, ' ', '_')) AS qualified_name,
  concat('src/', lower(p_type), '/', lower(replace(p_brand, '#', '')), '.ts') AS file_path,
  cast(p_partkey % 997 AS int) AS start_line, cast(p_partkey % 997 + p_size AS int) AS end_line,
  concat(p_name, '(', p_type, ')') AS signature, CASE WHEN p_size % 4 = 0 THEN concat('makes ', p_name) END AS docstring,
  concat('h', cast(p_size AS varchar(9))) AS sym_hash, CASE p_size % 10 WHEN 0 THEN true WHEN 1 THEN CAST(NULL AS boolean) ELSE false END AS is_closure, p_size AS size, p_retailprice AS price
FROM {part}""",
    # Calls between symbols: the part of each line item, and the part that its supplier stands for.
    "calls": "SELECT 'call' AS kind, l_partkey AS source, l_suppkey AS target FROM {lineitem}",
    # Trade between nations, the customer's first, with its weight.
    "flows": """
SELECT cn.n_name AS source, sn.n_name AS target, count(*) AS weight
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey
GROUP BY cn.n_name, sn.n_name""",
    # Source texts: documents under a path.
    "sources": "SELECT doc_id, concat(lang, '/', source, '/', cast(doc_id AS varchar(20)), '.txt') AS path, coalesce(text, '') AS content FROM {documents}",
    # Impact ledger: one entry for each order.
    "ledger": """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'violated' ELSE 'resolved' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE cast(o_orderdate AS varchar(30)) END AS consumed_at, o_custkey AS declared, o_orderpriority AS unexpected
FROM {orders}""",
    # Tool usage: one call for each order.
    "usage": "SELECT o_orderstatus AS tool, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS action, o_totalprice < 400000 AS ok, cast(floor(o_totalprice) AS bigint) AS ms FROM {orders}",
    # Memory samples of users.
    "samples": "SELECT user_id AS series, event_id AS t, value * 4 AS rss, value AS heap, value / 2 AS external, value / 4 AS buffers FROM {events}",
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the tables of ``sf_dir``."""
    tables = set(re.findall(r"\{(\w+)\}", ROLES[name]))
    return spark.sql(ROLES[name], **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_roles(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL with the named roles as common table expressions."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', ROLES[n])})" for n in names]
    head, body = ("WITH RECURSIVE " if recursive else "WITH "), sql.strip()
    if body.upper().startswith("WITH "):
        return head + ",\n".join([*parts, body[5:]])
    return head + ",\n".join(parts) + "\n" + body


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, *roles: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query and the SQL that gives its rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_roles(sql, *roles, recursive=recursive) if roles else sql
        return f

    return add
