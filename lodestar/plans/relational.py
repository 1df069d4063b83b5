"""Queries: filters, joins, aggregations, sorts and sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import aggregates as A
from lodestar.operators import diffs as D
from lodestar.operators import filters as P
from lodestar.operators import joins as J
from lodestar.operators import windows as W
from lodestar.plans.standins import query, role, table


@query("agg6_probe_profile", """
SELECT base AS probe, count(*) AS events, count(*) FILTER (length(coalesce(err, '')) > 0) AS errs, count(*) FILTER (benign) AS benigns,
  (SELECT string_agg(q.op, ',' ORDER BY q.first_seq) FROM (SELECT base, op, min(seq) AS first_seq FROM probes WHERE op IS NOT NULL GROUP BY base, op) q WHERE q.base = p.base) AS ops
FROM probes p GROUP BY base""", "probes")
def agg6_probe_profile(spark, sf) -> DataFrame:
    e = role(spark, sf, "probes").drop("probe").withColumnRenamed("base", "probe")
    return A.probe_profile(e).withColumn("ops", F.array_join("ops", ","))


# -- filters -----------------------------------------------------------------

@query("flt1_list_nodes", "SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'main') AS layer FROM customer WHERE coalesce(nullif(c_mktsegment, 'BUILDING'), 'main') = 'main' AND c_nationkey = 3")
def flt1(spark, sf):
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("layer"), F.col("c_nationkey").cast("string").alias("type"))
    return P.list_nodes(n, "main", "3").select("id", "layer")


@query("flt2_list_edges", """
SELECT l_orderkey, l_partkey, l_suppkey, coalesce(CASE WHEN l_returnflag = 'R' THEN 'curved' END, 'straight') AS type, 'forward' AS arrow, coalesce(CASE WHEN l_linestatus = 'O' THEN 'open' END, 'main') AS layer
FROM lineitem WHERE coalesce(CASE WHEN l_linestatus = 'O' THEN 'open' END, 'main') = 'main'""")
def flt2(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "curved").alias("type"), F.lit(None).cast("string").alias("arrow"), F.when(F.col("l_linestatus") == "O", "open").alias("layer"))
    return P.list_edges(e, "main")


@query("flt3_semantic_files", "SELECT o_orderkey AS path FROM orders WHERE nullif(o_orderpriority, '5-LOW') = '2-HIGH' AND o_orderstatus = 'P'")
def flt3(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("layer"), F.col("o_orderstatus").alias("status"))
    return P.semantic_files(f, "2-HIGH", "P").select("path")


@query("flt4_annotations", "SELECT o_orderkey AS id, o_custkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def flt4(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("severity"), (F.col("o_orderstatus") == "F").alias("resolved"))
    return P.list_annotations(a, severity="1-URGENT", unresolved_only=True).select("id", "node")


@query("flt4_approvals", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def flt4b(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("assignee"))
    return P.list_approvals(a, "O", "2-HIGH").select("id")


@query("flt5_path_predicate", r"SELECT page_id, url FROM pages WHERE contains(replace(url, '\', '/'), 'example.com/en') OR contains(replace(url, '\', '/'), '/fr/')")
def flt5(spark, sf):
    return table(spark, sf, "pages").where(P.matches_files(F.col("url"), ["example.com\\en", "/fr/"])).select("page_id", "url")


@query("flt6_log_shown", "SELECT seq, base FROM probes WHERE length(coalesce(err, '')) > 0 AND NOT (coalesce(op IN ('remove', 'remove-tmp', 'cleanup'), false) AND benign)", "probes")
def flt6(spark, sf):
    from lodestar.operators.observe import silent_error

    return P.log_pool(role(spark, sf, "probes"), silent_error())[0].select("seq", "base")


@query("flt6_log_counts", "SELECT count(*) AS total, count(*) FILTER (length(coalesce(err, '')) > 0 AND NOT (coalesce(op IN ('remove', 'remove-tmp', 'cleanup'), false) AND benign)) AS anomalies FROM probes WHERE contains(file, 'src/error.ts') OR contains(file, 'view')", "probes")
def flt6b(spark, sf):
    from lodestar.operators.observe import silent_error

    return P.log_pool(role(spark, sf, "probes"), silent_error(), ["src\\error.ts", "view"])[1]


@query("flt7_brick_facets", "SELECT p_partkey AS name FROM part WHERE p_brand = 'Brand#3' AND p_size > 25 AND NOT (p_type = 'PROMO' OR p_size % 2 = 1)")
def flt7(spark, sf):
    ext = F.array(F.struct(F.when((F.col("p_type") == "PROMO") | (F.col("p_size") % 2 == 1), "third_party").otherwise("internal").alias("class"), F.col("p_name").alias("source")))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("language"), (F.col("p_size") > 25).alias("verified"), F.array("p_name").alias("invariants"), ext.alias("external"))
    return P.brick_facets(b, "Brand#3", True, True, True).select("name")


@query("flt8_directory", "SELECT id FROM nodes WHERE starts_with(file_path, 'src/promo/')", "nodes")
def flt8(spark, sf):
    return role(spark, sf, "nodes").where(P.in_directory(F.col("file_path"), "src/promo")).select("id")


@query("flt9_no_closures", "SELECT id FROM nodes WHERE NOT coalesce(is_closure, false)", "nodes")
def flt9(spark, sf):
    return P.without_closures(role(spark, sf, "nodes")).select("id")


@query("flt11_condition", "SELECT id FROM nodes WHERE (size >= 10 AND kind = 'method') OR price < 950", "nodes")
def flt11(spark, sf):
    return P.where_condition(role(spark, sf, "nodes"), "size >= 10 && kind == 'method' || price < 950").select("id")


@query("src10_lookups", "SELECT id, name FROM nodes WHERE name IN ('red_widget', 'small_ring') AND id LIKE 'src/economy/%'", "nodes")
def src10(spark, sf):
    return role(spark, sf, "nodes").where(F.col("name").isin("red_widget", "small_ring") & F.startswith("id", F.lit("src/economy/"))).select("id", "name")


# -- joins -------------------------------------------------------------------

CALLS = """calls2 AS (SELECT a.file_path AS source_file, a.name AS source_name, b.file_path AS target_file, b.name AS target_name
FROM calls c JOIN nodes a ON c.source = a.key JOIN nodes b ON c.target = b.key WHERE c.kind = 'call' AND a.file_path <> b.file_path)"""


def _calls(spark, sf):
    n = role(spark, sf, "nodes").drop("id").withColumnRenamed("key", "id")
    return J.cross_file_calls(role(spark, sf, "calls"), n)


@query("join1_cross_file_calls", f"WITH {CALLS} SELECT source_file, target_file, count(*) AS n FROM calls2 GROUP BY source_file, target_file", "nodes", "calls")
def join1(spark, sf):
    return _calls(spark, sf).groupBy("source_file", "target_file").agg(F.count("*").alias("n"))


@query("join3_edges_touching", "SELECT source, target FROM calls WHERE source IN (SELECT key FROM nodes WHERE kind = 'method' AND size >= 45) OR target IN (SELECT key FROM nodes WHERE kind = 'method' AND size >= 45)", "nodes", "calls")
def join3(spark, sf):
    ids = role(spark, sf, "nodes").where("kind = 'method' and size >= 45").select(F.col("key").alias("id"))
    return J.edges_touching(role(spark, sf, "calls"), ids).select("source", "target")


@query("join4_stale_refs", "SELECT o_orderkey AS ref_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def join4(spark, sf):
    refs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("reference_name"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("pending").alias("status"))
    names = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("name"))
    return J.stale_refs(refs, names).select("ref_id")


@query("join5_first_match", """
WITH refs AS (SELECT o_orderkey AS ref_id, o_orderkey AS file_path, CASE WHEN o_orderpriority = '5-LOW' THEN 'fs.read' WHEN o_orderpriority = '3-MEDIUM' THEN 'print' ELSE 'Brand#3' END AS name FROM orders),
imports AS (SELECT l_orderkey AS file_path, l_partkey AS target_file, min(l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2),
hit AS (SELECT r.ref_id, first(p.p_partkey ORDER BY i.ordinal, i.target_file) AS target FROM refs r JOIN imports i ON r.file_path = i.file_path JOIN part p ON p.p_partkey = i.target_file AND p.p_brand = r.name WHERE r.name NOT IN ('fs.read', 'print') GROUP BY r.ref_id)
SELECT r.ref_id, h.target, CASE WHEN r.name IN ('fs.read', 'print') THEN 'external' WHEN h.target IS NOT NULL THEN 'resolved' ELSE 'failed' END AS status FROM refs r LEFT JOIN hit h ON r.ref_id = h.ref_id""")
def join5(spark, sf):
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderpriority") == "5-LOW", "fs.read").when(F.col("o_orderpriority") == "3-MEDIUM", "print").otherwise("Brand#3")
    refs = o.select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderkey").alias("file_path"), name.alias("name"), F.lit("call").alias("kind"))
    imports = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("target_file"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("file_path"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"))
    return J.resolve_in_order(refs, imports, nodes, ["print"]).select("ref_id", "target", "status")


@query("join6_unique_binding", """
WITH d AS (SELECT name, file_path, min(id) AS id, count(*) AS n FROM nodes GROUP BY name, file_path),
c AS (SELECT key AS call_id, file_path, name FROM nodes),
one AS (SELECT c.call_id, sum(d.n) AS n, min(d.id) AS target FROM c JOIN d ON c.name = d.name AND c.file_path <> d.file_path GROUP BY c.call_id)
SELECT c.call_id, CASE WHEN one.n = 1 THEN one.target END AS target FROM c LEFT JOIN one ON c.call_id = one.call_id""", "nodes")
def join6(spark, sf):
    n = role(spark, sf, "nodes")
    empty = spark.createDataFrame([], "file_path string, prefix string, provider string")
    return J.resolve_unique(n.select(F.col("key").alias("call_id"), "file_path", "name"), empty.withColumn("provider", F.col("provider")), n.select("name", "file_path", "id"))


@query("join7_versions", """
WITH a AS (SELECT p_name AS name, max(p_type) AS version FROM part WHERE p_size < 12 GROUP BY p_name), b AS (SELECT p_name AS name, max(p_type) AS version FROM part WHERE p_size > 38 GROUP BY p_name)
SELECT coalesce(a.name, b.name) AS name, a.version AS va, b.version AS vb, CASE WHEN b.name IS NULL THEN 'a_only' WHEN a.name IS NULL THEN 'b_only' WHEN a.version = b.version THEN 'shared' ELSE 'conflict' END AS state
FROM a FULL OUTER JOIN b ON a.name = b.name""")
def join7(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda c: p.where(c).groupBy(F.col("p_name").alias("name")).agg(F.max("p_type").alias("version"))
    return J.compare_versions(pick("p_size < 12"), pick("p_size > 38"))


@query("join8_symbol_sets", """
WITH a AS (SELECT name, string_agg(kind || ':' || sym_hash, '|' ORDER BY kind || ':' || sym_hash) AS f FROM nodes WHERE starts_with(file_path, 'src/promo') GROUP BY name),
b AS (SELECT name, string_agg(kind || ':' || sym_hash, '|' ORDER BY kind || ':' || sym_hash) AS f FROM nodes WHERE starts_with(file_path, 'src/small') GROUP BY name)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.f IS NULL THEN 'a_only' WHEN a.f IS NULL THEN 'b_only' WHEN a.f = b.f THEN 'duplicate' ELSE 'conflict' END AS state FROM a FULL OUTER JOIN b ON a.name = b.name""", "nodes")
def join8(spark, sf):
    n = role(spark, sf, "nodes").select("file_path", "name", "kind", F.col("sym_hash").alias("signature"))
    return J.compare_symbols(n.where(F.startswith("file_path", F.lit("src/promo"))), n.where(F.startswith("file_path", F.lit("src/small"))))


@query("join10_file_edges", """
SELECT a.file_path = 'src/promo/brand3.ts' AS out_edge, b.file_path = 'src/promo/brand3.ts' AS in_edge, count(*) AS n FROM calls c JOIN nodes a ON c.source = a.key JOIN nodes b ON c.target = b.key
WHERE a.file_path = 'src/promo/brand3.ts' OR b.file_path = 'src/promo/brand3.ts' GROUP BY 1, 2""", "nodes", "calls")
def join10(spark, sf):
    n = role(spark, sf, "nodes").select("key", "id")
    c = role(spark, sf, "calls").join(n.toDF("source", "s"), "source").join(n.toDF("target", "t"), "target")
    e = J.edges_of_file(c.select(F.col("s").alias("source"), F.col("t").alias("target")), "src/promo/brand3.ts")
    return e.groupBy(F.col("direction").isin("out", "inside").alias("out_edge"), F.col("direction").isin("in", "inside").alias("in_edge")).agg(F.count("*").alias("n"))


@query("join11_candidate_paths", """
WITH f AS (SELECT DISTINCT source AS path FROM documents), w AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN './' || source WHEN doc_id % 3 = 1 THEN 'lib/' || source ELSE lang END AS path FROM documents)
SELECT w.path, CASE WHEN w.path IN (SELECT path FROM f) THEN w.path WHEN starts_with(w.path, './') AND substr(w.path, 3) IN (SELECT path FROM f) THEN substr(w.path, 3)
  WHEN regexp_replace(w.path, '^.*/', '') IN (SELECT path FROM f) THEN regexp_replace(w.path, '^.*/', '') END AS found FROM w""")
def join11(spark, sf):
    d = table(spark, sf, "documents")
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("./"), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("lib/"), "source")).otherwise(F.col("lang"))
    return J.first_path(d.select(form.alias("path")).distinct(), d.select(F.col("source").alias("path")).distinct())


@query("join12_effects", """
WITH seen AS (SELECT DISTINCT file, coalesce(op, 'none') AS kind, CASE WHEN seq % 2 = 0 THEN 'listen' ELSE base END AS target FROM probes),
said AS (SELECT DISTINCT file, coalesce(op, 'none') AS kind, CASE WHEN benign THEN 'listen' ELSE 'db-pool' END AS target FROM probes WHERE base <> 'view')
SELECT coalesce(s.file, d.file) AS file, coalesce(s.kind, d.kind) AS kind, coalesce(s.target, d.target) AS target, CASE WHEN d.file IS NULL THEN 'newly_observed' WHEN s.file IS NULL THEN 'unobserved' ELSE 'confirmed' END AS state
FROM seen s FULL OUTER JOIN said d ON s.file = d.file AND s.kind = d.kind AND s.target = d.target""", "probes")
def join12(spark, sf):
    e = role(spark, sf, "probes").withColumn("kind", F.coalesce("op", F.lit("none")))
    seen = e.select("file", "kind", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("listen:"), F.col("seq") % 9)).otherwise(F.col("base")).alias("target"))
    said = e.where("base <> 'view'").select("file", "kind", F.when(F.col("benign"), "listen").otherwise("db-pool-main").alias("target"))
    return J.reconcile_effects(seen, said)


@query("srch8_enclosing_symbol", """
WITH s AS (SELECT file_path AS file, start_line AS start, max(name) AS name FROM nodes GROUP BY 1, 2), p AS (SELECT key, file_path AS file, start_line + size AS line FROM nodes)
SELECT p.key, p.file, p.line, s.start, s.name FROM p LEFT JOIN s ON s.file = p.file AND s.start = (SELECT max(start) FROM s t WHERE t.file = p.file AND t.start <= p.line)""", "nodes")
def srch8(spark, sf):
    n = role(spark, sf, "nodes")
    points = n.select(F.col("key"), F.col("file_path").alias("file"), (F.col("start_line") + F.col("size")).alias("line"))
    spans = n.select(F.col("file_path").alias("file"), F.col("start_line").alias("start"), "name")
    return J.enclosing(points, spans).withColumn("key", F.col("key").cast("long"))


# -- aggregations ------------------------------------------------------------

@query("agg1_index_stats", "SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges, count(*) AS files, max(o_orderdate) AS indexed_at FROM orders")
def agg1(spark, sf):
    return A.index_stats(table(spark, sf, "orders").withColumnRenamed("o_orderdate", "indexed_at"), table(spark, sf, "part"), table(spark, sf, "lineitem"))


@query("agg2_in_degree", "SELECT target, count(*) AS n FROM calls WHERE kind = 'call' GROUP BY target", "calls")
def agg2(spark, sf):
    return A.in_degree(role(spark, sf, "calls"))


@query("agg3_heaviest_edges", f"""WITH {CALLS}, w AS (SELECT *, count(*) AS weight FROM calls2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY least(source_file, target_file), greatest(source_file, target_file) ORDER BY weight DESC, source_file, source_name, target_file, target_name) AS r FROM w)
SELECT source_file, source_name, target_file, target_name, weight FROM r WHERE r <= 2 ORDER BY weight DESC, source_file, source_name, target_file, target_name LIMIT 40""", "nodes", "calls")
def agg3(spark, sf):
    return A.weighted_file_edges(_calls(spark, sf))


@query("agg4_file_heat", f"WITH {CALLS} SELECT file, count(*) AS heat FROM (SELECT source_file AS file FROM calls2 UNION ALL SELECT target_file FROM calls2) GROUP BY file", "nodes", "calls")
def agg4(spark, sf):
    return A.file_heat(_calls(spark, sf))


OWN = "own AS (SELECT n_nationkey AS file, min(r_name) AS feature FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1)"


@query("agg5_feature_deps", f"""WITH {OWN} SELECT a.feature AS source_feature, b.feature AS target_feature, count(*) AS weight
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN own a ON a.file = c.c_nationkey JOIN own b ON b.file = s.s_nationkey WHERE a.feature <> b.feature GROUP BY 1, 2""")
def agg5(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    edges = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"))
    return A.feature_deps(edges, _features(spark, sf))


def _features(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("feature"), F.col("r_regionkey").alias("ordinal"), F.col("n_nationkey").alias("file"))


@query("agg5_ownership", "SELECT c_nationkey AS file, min(c_mktsegment) AS owner, count(DISTINCT c_mktsegment) AS features, count(DISTINCT c_mktsegment) > 1 AS shared FROM customer GROUP BY 1")
def agg5b(spark, sf):
    return A.feature_ownership(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("feature"), F.lit(0).alias("ordinal"), F.col("c_nationkey").alias("file")))


HIST = "h AS (SELECT base AS probe, least(19, length(to_binary(greatest(dur_us, 1))) - 1) AS bucket, count(*) AS n FROM probes GROUP BY 1, 2)"
HIST = HIST.replace("length(to_binary(greatest(dur_us, 1))) - 1", "length(bin(greatest(dur_us, 1))) - 1")


def _base(spark, sf):
    return role(spark, sf, "probes").drop("probe").withColumnRenamed("base", "probe")


@query("agg7_histogram", f"WITH {HIST} SELECT probe, cast(bucket AS int) AS bucket, n FROM h", "probes")
def agg7(spark, sf):
    return A.latency_histogram(_base(spark, sf))


PCT = """t AS (SELECT probe, bucket, n, sum(n) OVER (PARTITION BY probe ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY probe) AS total FROM h),
g AS (SELECT *, greatest(1, floor(total * {p} + 0.5)) AS target FROM t), f AS (SELECT probe, min(bucket) AS bucket FROM g WHERE cum >= target GROUP BY probe)
SELECT g.probe, cast(total AS bigint) AS total, cast(floor((CASE WHEN g.bucket = 0 THEN 0 ELSE pow(2, g.bucket) END) + (target - (cum - n)) / n * (pow(2, g.bucket + 1) - (CASE WHEN g.bucket = 0 THEN 0 ELSE pow(2, g.bucket) END))) AS bigint) AS value_us FROM g JOIN f ON g.probe = f.probe AND g.bucket = f.bucket"""


@query("agg8_p50", f"WITH {HIST}, " + PCT.replace("{p}", "0.5"), "probes")
def agg8(spark, sf):
    return A.histogram_percentile(A.latency_histogram(_base(spark, sf)), 0.5)


@query("agg8_p99", f"WITH {HIST}, " + PCT.replace("{p}", "0.99"), "probes")
def agg8b(spark, sf):
    return A.histogram_percentile(A.latency_histogram(_base(spark, sf)), 0.99)


@query("agg9_counters", "SELECT probe, count(*) AS hits, count(*) FILTER (probe LIKE '%.catch') AS errs FROM probes GROUP BY probe", "probes")
def agg9(spark, sf):
    return A.probe_counters(role(spark, sf, "probes"))


@query("agg10_ledger", "SELECT count(*) AS total, count(*) FILTER (consumed_at <> '') AS consumed, count(*) FILTER (status IN ('violated', 'resolved')) AS violated, round(count(*) FILTER (status IN ('violated', 'resolved')) / count(*) FILTER (consumed_at <> ''), 6) AS rate FROM ledger", "ledger")
def agg10(spark, sf):
    return A.ledger_summary(role(spark, sf, "ledger")).withColumn("rate", F.round("rate", 6))


@query("agg10_repeats", "SELECT declared AS source, count(*) AS violations, string_agg(DISTINCT unexpected, ',' ORDER BY unexpected) AS files FROM ledger WHERE status IN ('violated', 'resolved') GROUP BY declared HAVING count(*) >= 2", "ledger")
def agg10b(spark, sf):
    e = role(spark, sf, "ledger").select("id", "status", F.array("declared").alias("declared_files"), F.array("unexpected").alias("unexpected_files"))
    return A.ledger_repeats(e).withColumn("files", F.array_join("files", ","))


@query("agg11_usage_rollup", """
SELECT tool, action, cast(grouping(action) AS int) AS is_total, count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM (SELECT tool, coalesce(action, '—') AS action, ok FROM usage) GROUP BY GROUPING SETS ((tool), (tool, action))""", "usage")
def agg11(spark, sf):
    return A.usage_rollup(role(spark, sf, "usage"))


@query("agg12_gateway", "SELECT count(*) AS requests, count(*) FILTER (NOT ok) AS failed, cast(sum(ms) AS bigint) AS ms FROM usage", "usage")
def agg12(spark, sf):
    return A.gateway_totals(role(spark, sf, "usage"))


@query("agg13_directories", "SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir, count(*) AS functions, count(DISTINCT file_path) AS files FROM nodes GROUP BY 1", "nodes")
def agg13(spark, sf):
    return A.directory_functions(role(spark, sf, "nodes"))


@query("agg14_layer_matrix", """SELECT ln.r_name AS source_layer, rn.r_name AS target_layer, count(*) AS n FROM flows f JOIN nation a ON a.n_name = f.source JOIN nation b ON b.n_name = f.target JOIN region ln ON ln.r_regionkey = a.n_regionkey JOIN region rn ON rn.r_regionkey = b.n_regionkey WHERE ln.r_name <> rn.r_name GROUP BY 1, 2""", "flows")
def agg14(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return A.layer_matrix(role(spark, sf, "flows"), n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name"))


@query("agg15_health", """
WITH i AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'layer' WHEN '2-HIGH' THEN 'cycle' WHEN '3-MEDIUM' THEN 'complexity' WHEN '5-LOW' THEN 'orphan' END AS kind FROM orders WHERE o_totalprice > 490000),
c AS (SELECT count(*) FILTER (kind = 'layer') AS layer, count(*) FILTER (kind = 'cycle') AS cycle, count(*) FILTER (kind = 'complexity') AS complexity, count(*) FILTER (kind = 'orphan') AS orphan, 0::BIGINT AS unused_export, 0::BIGINT AS unused_import FROM i),
f AS (SELECT count(*) AS files FROM orders),
s AS (SELECT files, c.*, cast(greatest(0, floor(100 - (30 * least(1, layer * 100.0 / files / 15) + 30 * least(1, cycle * 100.0 / files / 10) + 25 * least(1, complexity * 100.0 / files / 30) + 20 * least(1, orphan * 100.0 / files / 10)) + 0.5)) AS bigint) AS score FROM f, c)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s""")
def agg15(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "layer").when(p == "2-HIGH", "cycle").when(p == "3-MEDIUM", "complexity").when(p == "5-LOW", "orphan")
    return A.health_score(o.where("o_totalprice > 490000").select(kind.alias("kind")), o)


@query("agg16_integrity", """
WITH i AS (SELECT c_custkey AS path, c_mktsegment AS h FROM customer WHERE c_acctbal < 8000), d AS (SELECT c_custkey AS path, CASE WHEN c_nationkey = 3 THEN 'new' ELSE c_mktsegment END AS h FROM customer WHERE c_acctbal > 0)
SELECT 'ref:' || o_orderstatus AS what, count(*) AS n FROM orders GROUP BY 1 UNION ALL
SELECT CASE WHEN d.path IS NULL THEN 'ghost' WHEN i.path IS NULL THEN 'not_indexed' WHEN i.h <> d.h THEN 'not_fresh' ELSE 'fresh' END, count(*) FROM i FULL OUTER JOIN d ON i.path = d.path GROUP BY 1""")
def agg16(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "path")
    seg = F.col("c_mktsegment")
    i = c.where("c_acctbal < 8000").select("path", seg.alias("hash"))
    d = c.where("c_acctbal > 0").select("path", F.when(F.col("c_nationkey") == 3, "new").otherwise(seg).alias("hash"))
    return A.integrity_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), i, d)


@query("agg17_majority", """SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def agg17(spark, sf):
    return A.majority(table(spark, sf, "documents"), "source", "lang", "doc_id")


@query("agg18_decisions", """SELECT coalesce(nullif(p_brand, 'Brand#7'), '(uncategorised)') AS thread, count(*) AS n, string_agg(p_name, ',' ORDER BY p_name) AS titles FROM part GROUP BY 1""")
def agg18(spark, sf):
    d = table(spark, sf, "part").select(F.nullif("p_brand", F.lit("Brand#7")).alias("thread"), F.col("p_name").alias("title"))
    return A.decision_catalogue(d).withColumn("titles", F.array_join("titles", ","))


@query("agg19_contracts", """
SELECT p_type AS side, p_name AS name, first(p_brand ORDER BY p_partkey) AS kind FROM part GROUP BY 1, 2 UNION ALL
SELECT DISTINCT 'irreversible', base, CASE WHEN seq % 2 = 0 THEN 'hold' ELSE 'write' END FROM probes WHERE NOT benign""", "probes")
def agg19(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_type").alias("side"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("ordinal"))
    effects = role(spark, sf, "probes").select(F.col("base").alias("name"), (F.col("seq") % 2 == 0).alias("holds"), F.col("benign").alias("reversible"))
    return A.merge_contracts(items, effects)


@query("agg20_effects", "SELECT file, op AS kind, err AS target, count(*) AS n, count(DISTINCT probe) AS probes, max(time) AS latest FROM probes GROUP BY 1, 2, 3", "probes")
def agg20(spark, sf):
    return A.effect_observations(role(spark, sf, "probes").withColumnsRenamed({"op": "kind", "err": "target"}))


@query("agg21_distinct", "SELECT DISTINCT name FROM nodes", "nodes")
def agg21(spark, sf):
    return A.distinct_values(role(spark, sf, "nodes"), "name")


@query("fn_scope_profile", "SELECT regexp_replace(probe, '[.](enter|exit|catch)$', '') AS base, count(*) AS n, count(*) FILTER (length(coalesce(err, '')) > 0) AS errs, round(count(*) FILTER (length(coalesce(err, '')) > 0) / count(*), 6) AS rate FROM probes GROUP BY 1", "probes")
def fn_scope(spark, sf):
    return A.scope_profile(role(spark, sf, "probes"))


@query("fn_scalars", r"""
SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '.' END AS dir, regexp_replace(url, '^.*/', '') AS base, sha256(url) AS cache_key, sha1(html) AS content_hash,
  1 + len(regexp_extract_all(html, '\b(?:if|for|while|case|catch)\b|&&|\|\||\?')) AS complexity, length(string_split(html, chr(10))[1]) AS head, regexp_replace(url, '[0-9]+$', '') AS no_digits,
  CASE WHEN len(string_split(html, chr(10))) >= 1000 THEN 'large' WHEN len(string_split(html, chr(10))) >= 500 THEN 'warn' ELSE 'ok' END AS status, md5(trim(regexp_replace(html, '[\s\x0B]+', ' ', 'g'))) AS folded, round(least(1.0, ln(1 + length(url)) / ln(1 + 64)), 6) AS weight FROM pages""")
def fn_scalars(spark, sf):
    u, h = F.col("url"), F.col("html")
    rows = F.split(h, "\n", -1)
    return table(spark, sf, "pages").select(
        "page_id", S.dirname(u).alias("dir"), S.basename(u).alias("base"), F.sha2(u, 256).alias("cache_key"), F.sha1(h.cast("binary")).alias("content_hash"),
        S.regex_complexity(h).cast("long").alias("complexity"), F.length(F.get(rows, 0)).cast("long").alias("head"), S.strip_digits(u).alias("no_digits"),
        S.size_status(F.size(rows)).alias("status"), F.md5(S.fold_blanks(h).cast("binary")).alias("folded"), F.round(S.usage_weight(F.length(u), F.lit(64)), 6).alias("weight"),
    )


# -- windows, sorts, top-k ---------------------------------------------------

@query("win1_diversity", """
WITH s AS (SELECT p_partkey AS id, p_name AS symbol, p_brand AS file, p_size >= 40 AS focus, p_retailprice AS score FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY file, symbol ORDER BY focus DESC, score DESC, id) AS r FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY focus DESC, score DESC, id) AS q FROM a WHERE r <= 3)
SELECT id, symbol, file, focus, score FROM b WHERE q <= 8""")
def win1(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("file"), (F.col("p_size") >= 40).alias("focus"), F.col("p_retailprice").alias("score"))
    return W.diversity_quota(s)


SEQ = "s AS (SELECT trace_id, string_agg(base, '>' ORDER BY time, seq) AS sequence, count(*) AS events, count(*) FILTER (length(coalesce(err, '')) > 0) AS errs, min(time) AS first FROM probes GROUP BY trace_id)"


@query("win2_traces", f"WITH {SEQ} SELECT trace_id, sequence, events, errs FROM s", "probes")
def win2(spark, sf):
    t = W.trace_sequences(role(spark, sf, "probes"))
    return t.select("trace_id", F.array_join("sequence", ">").alias("sequence"), "events", "errs")


@query("win3_chain_budget", f"""WITH {SEQ}, o AS (SELECT *, row_number() OVER (ORDER BY first, trace_id) AS r, coalesce(sum(events) OVER (ORDER BY first, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)
SELECT trace_id, events, least(events, 128) AS kept FROM o WHERE r <= 512 AND used < 4096""", "probes")
def win3(spark, sf):
    t = W.chain_budget(W.trace_sequences(role(spark, sf, "probes")), F.col("events"))
    return t.select("trace_id", "events", F.size("sequence").cast("long").alias("kept"))


@query("win4_leaks", """
WITH b AS (SELECT series, count(*) AS n, first(rss ORDER BY t DESC) - first(rss ORDER BY t) AS d_rss, first(heap ORDER BY t DESC) - first(heap ORDER BY t) AS d_heap, first(external + buffers ORDER BY t DESC) - first(external + buffers ORDER BY t) AS d_nat, list(heap ORDER BY t DESC)[1:3] AS h FROM samples GROUP BY series)
SELECT series, n, round(d_rss, 6) AS d_rss, round(d_heap, 6) AS d_heap, CASE WHEN n < 2 THEN 'ok' WHEN d_heap > 64 AND len(h) >= 3 AND h[3] < h[2] AND h[2] < h[1] THEN 'leak' WHEN d_rss >= 1024 THEN 'grow' WHEN d_rss > 64 AND d_heap <= 16 AND d_nat > 16 THEN 'suspicious-native' ELSE 'ok' END AS verdict FROM b""", "samples")
def win4(spark, sf):
    return W.leak_verdict(role(spark, sf, "samples"))


def quota_sql(key: str, most: int, span: int) -> str:
    """SQL for accepted_quota over the probes: a fold over each key's events in order."""
    state = "{'t': 0::BIGINT, 'seq': 0::BIGINT, 'taken': []::BIGINT[], 'ok': []::BIGINT[]}"
    left = f"list_filter(a.taken, lambda y: y > x.t - {span})"
    return f"""
WITH e AS (SELECT {key}, epoch_us(time) // 1000 AS t, seq FROM probes), f AS (SELECT {key}, list_reduce(list({{'t': t, 'seq': seq, 'taken': []::BIGINT[], 'ok': []::BIGINT[]}} ORDER BY t, seq),
 lambda a, x: {{'t': x.t, 'seq': x.seq, 'taken': CASE WHEN len({left}) < {most} THEN list_append({left}, x.t) ELSE {left} END, 'ok': CASE WHEN len({left}) < {most} THEN list_append(a.ok, x.seq) ELSE a.ok END}}, {state}).ok AS ok FROM e GROUP BY {key}),
k AS (SELECT {key}, unnest(ok) AS seq FROM f)
SELECT e.{key}, t AS time_ms, e.seq, k.seq IS NOT NULL AS accepted FROM e LEFT JOIN k ON e.{key} = k.{key} AND e.seq = k.seq"""


@query("win5_quota", quota_sql("probe", 10, 6 * 3_600_000), "probes")
def win5(spark, sf):
    e = role(spark, sf, "probes").select("probe", "seq", (F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long").alias("time_ms"))
    return W.accepted_quota(e.select("probe", "time_ms", "seq"), "probe", "time_ms", 10, 6 * 3_600_000)


@query("win6_ambient", "SELECT seq, trace_id, ambient, since FROM (SELECT probe, seq, trace_id, count(*) OVER w AS ambient, min(time) OVER w AS since FROM probes WINDOW w AS (PARTITION BY trace_id ORDER BY time, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE probe LIKE '%.catch'", "probes")
def win6(spark, sf):
    return W.before_catch(role(spark, sf, "probes")).select("seq", "trace_id", "ambient", "since")


@query("win7_debounce", quota_sql("file", 1, 300_000), "probes")
def win7(spark, sf):
    e = role(spark, sf, "probes").select("file", "seq", (F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long").alias("time_ms"))
    return W.accepted_quota(e.select("file", "time_ms", "seq"), "file", "time_ms", 1, 300_000)


@query("win8_claims", "SELECT base AS probe, max(dur_us) AS most, CASE base WHEN 'view' THEN 400000.0 ELSE 600000.0 END::DOUBLE AS claim, max(dur_us) > CASE base WHEN 'view' THEN 400000.0 ELSE 600000.0 END AS holds FROM probes WHERE base IN ('view', 'click') GROUP BY base", "probes")
def win8(spark, sf):
    return W.claims_hold(_base(spark, sf), {"view": 400_000, "click": 600_000})


@query("sort1_keys", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem")
def sort1(spark, sf):
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(by).cast("long").alias("place"))


@query("sort2_risk_order", "SELECT source AS file, n AS dep_count, CASE WHEN n >= 8 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT source, count(DISTINCT target) AS n FROM calls GROUP BY source)", "calls")
def sort2(spark, sf):
    n = role(spark, sf, "calls").groupBy(F.col("source").alias("file")).agg(F.count_distinct("target").alias("dep_count"))
    return W.sort_impact(n.withColumns({"risk": S.risk_by_degree(F.col("dep_count")), "depth": F.lit(1)})).drop("depth")


@query("sort3_deviations", "SELECT seq, CASE op WHEN 'remove' THEN 0 WHEN 'writefile' THEN 1 WHEN 'cleanup' THEN 2 ELSE 3 END AS place FROM probes", "probes")
def sort3(spark, sf):
    op = F.col("op")
    kind = F.when(op == "remove", "unobserved").when(op == "writefile", "violated").when(op == "cleanup", "undesigned").otherwise("other")
    return W.sort_deviations(role(spark, sf, "probes").select("seq", kind.alias("kind"), F.col("seq").alias("ordinal"))).select("seq", "place")


@query("topk1_hubs", "SELECT node, dependents, dependencies FROM (SELECT coalesce(i.node, o.node) AS node, coalesce(dependents, 0) AS dependents, coalesce(dependencies, 0) AS dependencies FROM (SELECT target AS node, count(DISTINCT source) AS dependents FROM calls GROUP BY 1) i FULL OUTER JOIN (SELECT source AS node, count(DISTINCT target) AS dependencies FROM calls GROUP BY 1) o ON i.node = o.node) ORDER BY dependents DESC, dependencies DESC, node LIMIT 20", "calls")
def topk1(spark, sf):
    from lodestar.operators.graph import hubs

    return hubs(role(spark, sf, "calls"), 20).select("node", "dependents", "dependencies")


@query("topk2_lookups", "SELECT key, name FROM nodes WHERE kind = 'method' ORDER BY start_line, key LIMIT 5", "nodes")
def topk2(spark, sf):
    return role(spark, sf, "nodes").where("kind = 'method'").orderBy("start_line", "key").limit(5).select("key", "name")


@query("topk3_complexity", "SELECT doc_id, len(regexp_extract_all(content, '[A-Za-z]+')) AS words FROM sources ORDER BY words DESC, doc_id LIMIT 20", "sources")
def topk3(spark, sf):
    n = F.size(F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0))).cast("long")
    return role(spark, sf, "sources").select("doc_id", n.alias("words")).orderBy(F.desc("words"), "doc_id").limit(20)


# -- sets and diffs ----------------------------------------------------------

@query("set1_names", "SELECT name, CASE WHEN bool_or(a) AND bool_or(NOT a) THEN 'both' WHEN bool_or(a) THEN 'a' ELSE 'b' END AS side FROM (SELECT p_name || p_brand AS name, p_size < 20 AS a FROM part WHERE p_size < 20 OR p_size > 40) GROUP BY name")
def set1(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_name", "p_brand").alias("name"), "p_size")
    return D.set_split(p.where("p_size < 20"), p.where("p_size > 40"), "name")


@query("set2_disk_index", "SELECT c_custkey AS path, CASE WHEN c_acctbal > 0 AND c_acctbal < 8000 THEN 'both' WHEN c_acctbal > 0 THEN 'a' ELSE 'b' END AS side FROM customer")
def set2(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "path")
    return D.set_split(c.where("c_acctbal > 0"), c.where("c_acctbal < 8000"), "path")


@query("set3_unplanned", "SELECT l_orderkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_returnflag <> 'N'), '') AS unexpected FROM lineitem GROUP BY l_orderkey")
def set3(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("actual"))
    return a.select("l_orderkey", F.array_join(D.unplanned(F.col("actual"), F.array(F.lit("N"))), ",").alias("unexpected"))


@query("diff1_documents", """
WITH a AS (SELECT * FROM part WHERE p_size <= 40), b AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size = 30 THEN 'OTHER' ELSE p_type END AS p_type FROM part WHERE p_size >= 10)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN concat_ws(',', CASE WHEN a.p_name <> b.p_name THEN 'p_name' END, CASE WHEN a.p_type <> b.p_type THEN 'p_type' END) END AS columns
FROM a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name <> b.p_name OR a.p_type <> b.p_type""")
def diff1(spark, sf):
    p = table(spark, sf, "part")
    b = p.where("p_size >= 10").select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_size") == 30, "OTHER").otherwise(F.col("p_type")).alias("p_type"))
    return D.keyed_diff(p.where("p_size <= 40"), b, "p_partkey", ["p_name", "p_type"]).withColumn("columns", F.array_join("columns", ","))


CDC = """a AS (SELECT file_path, qualified_name, string_agg(DISTINCT sym_hash, ',' ORDER BY sym_hash) AS h FROM nodes WHERE size < 42 GROUP BY 1, 2), b AS (SELECT file_path, qualified_name, string_agg(DISTINCT sym_hash, ',' ORDER BY sym_hash) AS h FROM nodes WHERE size > 8 GROUP BY 1, 2),
c AS (SELECT file_path, qualified_name, string_agg(DISTINCT sym_hash, ',' ORDER BY sym_hash) AS h FROM nodes WHERE size < 30 GROUP BY 1, 2),
d1 AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.qualified_name, b.qualified_name) AS qualified_name, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL OUTER JOIN b ON a.file_path = b.file_path AND a.qualified_name = b.qualified_name WHERE a.h IS DISTINCT FROM b.h),
d2 AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.qualified_name, b.qualified_name) AS qualified_name, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS state FROM b a FULL OUTER JOIN c b ON a.file_path = b.file_path AND a.qualified_name = b.qualified_name WHERE a.h IS DISTINCT FROM b.h)"""


def _versions(spark, sf):
    n = role(spark, sf, "nodes")
    return n.where("size < 42"), n.where("size > 8"), n.where("size < 30")


@query("diff2_symbol_cdc", f"WITH {CDC} SELECT * FROM d1", "nodes")
def diff2(spark, sf):
    a, b, _ = _versions(spark, sf)
    return D.symbol_cdc(a, b)


@query("diff3_chain", f"""WITH {CDC}, j AS (SELECT coalesce(x.file_path, y.file_path) AS file_path, coalesce(x.qualified_name, y.qualified_name) AS qualified_name, x.state AS s0, y.state AS s1 FROM d1 x FULL OUTER JOIN d2 y ON x.file_path = y.file_path AND x.qualified_name = y.qualified_name)
SELECT file_path, qualified_name, CASE WHEN s0 = 'added' AND s1 = 'changed' THEN 'added' WHEN s0 = 'removed' AND s1 = 'added' THEN 'changed' ELSE coalesce(s1, s0) END AS state FROM j WHERE NOT (s0 IS NOT DISTINCT FROM 'added' AND s1 IS NOT DISTINCT FROM 'removed')""", "nodes")
def diff3(spark, sf):
    a, b, c = _versions(spark, sf)
    return D.chain_diffs(D.symbol_cdc(a, b), D.symbol_cdc(b, c))


@query("diff4_three_way", """
WITH b AS (SELECT p_partkey AS id, p_type AS value FROM part WHERE p_size <= 42), d AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'NEW' ELSE p_type END AS value FROM part WHERE p_size > 5 AND p_size <= 46), v AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'NEW' WHEN p_size % 10 = 0 THEN 'OTHER' ELSE p_type END AS value FROM part WHERE p_size > 8)
SELECT p_partkey AS id, CASE WHEN b.id IS NULL AND d.id IS NOT NULL AND v.id IS NOT NULL THEN CASE WHEN d.value = v.value THEN 'implemented' ELSE 'conflict' END WHEN b.id IS NULL AND d.id IS NOT NULL THEN 'added' WHEN b.id IS NULL THEN 'live_only' WHEN d.id IS NULL THEN 'removed' WHEN v.id IS NULL THEN 'deleted_from_live'
 WHEN d.value = v.value THEN CASE WHEN b.value = d.value THEN 'unchanged' ELSE 'converged' END WHEN b.value = v.value THEN 'design_only' WHEN b.value = d.value THEN 'live_only' ELSE 'conflict' END AS state
FROM part LEFT JOIN b ON p_partkey = b.id LEFT JOIN d ON p_partkey = d.id LEFT JOIN v ON p_partkey = v.id""")
def diff4(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    t, s = F.col("p_type"), F.col("p_size")
    b = p.where("p_size <= 42").select("id", t.alias("value"))
    d = p.where("p_size > 5 and p_size <= 46").select("id", F.when(s % 5 == 0, "NEW").otherwise(t).alias("value"))
    v = p.where("p_size > 8").select("id", F.when(s % 3 == 0, "NEW").when(s % 10 == 0, "OTHER").otherwise(t).alias("value"))
    return D.three_way(b, d, v)


API = """e AS (SELECT p_brand AS file, p_name AS name, max(p_type) AS s FROM part WHERE p_size < 35 GROUP BY 1, 2), a AS (SELECT p_brand AS file, p_name AS name, max(p_type) AS s FROM part WHERE p_size > 15 GROUP BY 1, 2),
k AS (SELECT coalesce(e.file, a.file) AS file, coalesce(e.name, a.name) AS name, CASE WHEN a.s IS NULL THEN 'missing' WHEN e.s IS NULL THEN 'unexpected' WHEN e.s = a.s THEN 'matched' ELSE 'mismatched' END AS state FROM e FULL OUTER JOIN a ON e.file = a.file AND e.name = a.name)"""


def _api(spark, sf):
    p = table(spark, sf, "part")
    side = lambda c: p.where(c).groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("name")).agg(F.max("p_type").alias("signature"))
    return D.api_consistency(side("p_size < 35"), side("p_size > 15"))


@query("diff5_api", f"WITH {API} SELECT * FROM k")
def diff5(spark, sf):
    return _api(spark, sf)


@query("diff5_drift", f"WITH {API}, n AS (SELECT file, count(*) FILTER (state IN ('unexpected', 'mismatched')) AS s, count(*) FILTER (state = 'missing') AS m FROM k GROUP BY file) SELECT file, CASE WHEN s > 0 AND m > 0 THEN 'both' WHEN s > 0 THEN 'stale' WHEN m > 0 THEN 'missing_impl' ELSE 'clean' END AS drift FROM n")
def diff5b(spark, sf):
    return D.drift(_api(spark, sf))


@query("diff6_contract", "SELECT l_orderkey AS file, l_linenumber AS line, l_partkey AS ident FROM lineitem WHERE l_quantity > 25 AND (l_orderkey, l_linenumber, l_partkey) NOT IN (SELECT (l_orderkey, l_linenumber, l_partkey) FROM lineitem WHERE l_returnflag = 'R')")
def diff6(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("ident"), "l_quantity", "l_returnflag")
    return D.contract_diff(r.where("l_returnflag = 'R'"), r.where("l_quantity > 25")).select("file", "line", "ident")


@query("diff6_gate", "SELECT count(*) FILTER (l_quantity > 49) AS undefined, count(*) FILTER (l_tax = 0) AS skipped, count(*) FILTER (l_quantity > 49) = 0 AS ok FROM lineitem")
def diff6b(spark, sf):
    r = table(spark, sf, "lineitem")
    return D.contract_gate(r.where("l_quantity > 49"), r.where("l_tax = 0"))


@query("diff7_behavior", 'SELECT coalesce(a.k, b.k) AS "case", CASE WHEN a.k IS NULL THEN \'new\' WHEN b.k IS NULL THEN \'gone\' WHEN a.v = b.v THEN \'same\' ELSE \'changed\' END AS state FROM (SELECT o_custkey AS k, max(o_orderstatus) AS v FROM orders WHERE o_totalprice < 250000 GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey AS k, max(o_orderstatus) AS v FROM orders WHERE o_totalprice > 200000 GROUP BY 1) b ON a.k = b.k')
def diff7(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("case")).agg(F.max("o_orderstatus").alias("outcome"))
    return D.behavior_diff(side("o_totalprice < 250000"), side("o_totalprice > 200000"))


@query("diff8_reanchor", """
WITH an AS (SELECT p_partkey AS id, p_partkey + (CASE WHEN p_size > 30 THEN 100000 ELSE 0 END) AS path, p_partkey AS node_id, p_name || p_brand AS signature, p_size = 7 AS orphaned FROM part),
sy AS (SELECT p_partkey AS node_id, p_partkey AS path, CASE WHEN p_size % 4 = 0 THEN 'x' ELSE p_name || p_brand END AS signature FROM part WHERE p_size <> 12), g AS (SELECT signature, min(node_id) AS s FROM sy GROUP BY 1),
j AS (SELECT an.*, sy.node_id AS pn, sy.signature AS ps, g.s, coalesce(sy.node_id, g.s) AS node FROM an LEFT JOIN sy ON an.path = sy.path LEFT JOIN g ON an.signature = g.signature),
k AS (SELECT id, node, CASE WHEN orphaned OR node IS NULL THEN 'orphaned' WHEN node <> node_id THEN 'migrated' WHEN ps IS NOT NULL AND ps <> signature THEN 'stale' ELSE 'retained' END AS state FROM j)
SELECT id, CASE WHEN state = 'orphaned' THEN NULL ELSE node END AS node_id, state FROM k""")
def diff8(spark, sf):
    p = table(spark, sf, "part")
    sig, key = F.concat("p_name", "p_brand"), F.col("p_partkey")
    an = p.select(key.alias("id"), (key + F.when(F.col("p_size") > 30, 100000).otherwise(0)).alias("path"), key.alias("node_id"), sig.alias("signature"), (F.col("p_size") == 7).alias("orphaned"))
    sy = p.where("p_size <> 12").select(key.alias("node_id"), key.alias("path"), F.when(F.col("p_size") % 4 == 0, "x").otherwise(sig).alias("signature"))
    return D.reanchor(an, sy)
