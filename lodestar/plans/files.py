"""Queries on files: each writes a small fixture to the shared folder and reads it back.

The fixtures are made from the tables of regions and nations, which do not grow, but
for the event logs, which Spark writes from the whole table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import flows
from lodestar.plans.standins import query, role, table
from lodestar.sources import events as EV
from lodestar.sources import store
from lodestar.sources import tree as T
from lodestar.streaming import events as V


def _work(spark: SparkSession, name: str) -> str:
    path = f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    fs, root, _ = store._files(spark, path)
    fs.mkdirs(root)
    fs.deleteOnExit(root)
    return path


def _nations(spark: SparkSession, sf: str) -> list[tuple[int, str, int]]:
    """(key, name, region) of the 25 nations."""
    return [tuple(r) for r in table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query("src1_walk", "SELECT 'r' || n_regionkey || '/' || lower(n_name) || CASE n_nationkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS path, length(n_name)::BIGINT AS size FROM nation WHERE n_regionkey <> 4 AND n_nationkey % 7 <> 0")
def src1(spark, sf) -> DataFrame:
    """A file for each nation; one region and every seventh nation are ignored; tests, noise and others lie between."""
    root, skipped = _work(spark, "tree"), []
    for key, name, region in _nations(spark, sf):
        stem = f"r{region}/{name.lower()}"
        store.put_text(spark, f"{root}/{stem}{('.py', '.ts', '.go')[key % 3]}", name)
        for other in (f"{stem}.test.ts", f"{stem}.min.js", f"node_modules/{stem}.ts", f"{stem}.txt", f"{stem}.ts~"):
            store.put_text(spark, f"{root}/{other}", "x")
        skipped += [f"{name.lower()}.*"] if key % 7 == 0 else []
    store.put_text(spark, f"{root}/.gitignore", "\n".join(["# regions", "/r4/", *skipped]))
    return T.walk(spark, root).select("path", "size")


#: Source texts by language, made for a document: its number, its source and its text.
SOURCES = {
    "ts": """import { helper%1$s } from './%2$s' // class Not { no() {} }
export class C%1$s extends Base {
  private re = /['"{]/g
  async run(x: number) { return this.s.helper%1$s(`${pick(x / 2 / 3)} { ' " %3$s`) }
  field = (y) => { seen(y) }
}
const api = { go() { a().b() } }
""",
    "rs": """use crate::%2$s::x;
/* outer /* inner { */ %3$s */
impl<'a> C%1$s<'a> { fn run(&self) { let c = '{'; baz::helper%1$s(self.x.go::<u8>(1)) } }
""",
    "go": """package m
import "%2$s"
type C%1$s[T any] struct { n int }
func (s *C%1$s[T]) run() { s.mu.Lock(); helper%1$s[T](raw) }
var raw = `} " %3$s`
""",
    "java": """import a.%2$s;
public class C%1$s extends Base<T> { C%1$s() { this(1); } void run() throws E { helper%1$s(new X(() -> work()) { void in() { deep(); } }); } }
// %3$s
""",
}


@query("src2_braces", r"""
WITH d AS (SELECT doc_id, doc_id % 4 AS k, source FROM documents)
SELECT doc_id || '.' || ['ts', 'rs', 'go', 'java'][k + 1] AS path, 'C' || doc_id || '.run' AS method, ([4, 1, 2, 4][k + 1])::BIGINT AS symbols,
  CASE k WHEN 0 THEN './' || source WHEN 1 THEN 'crate::' || source || '::x' WHEN 2 THEN source ELSE 'a.' || source END AS imported,
  CASE k WHEN 0 THEN '().b,a,pick,seen,this.s.helper' || doc_id WHEN 1 THEN 'baz.helper' || doc_id || ',self.x.go' WHEN 2 THEN 'helper' || doc_id || ',s.mu.Lock' ELSE 'X,deep,helper' || doc_id || ',work' END AS called,
  ([1, 0, 0, 1][k + 1])::BIGINT AS bases
FROM d""")
def src2_braces(spark, sf):
    """A file for each document, in four languages; its text stands in a template, a nested comment, a raw string or a comment."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[`*\\$\n\r  \x0B\x0C\x85/]", " ").alias("text"))
    text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (ending, form) in enumerate(SOURCES.items()):
        mine = F.col("doc_id") % 4 == k
        text = F.when(mine, F.format_string(form, F.col("doc_id").cast("string"), "source", "text")).otherwise(text)
        name = F.when(mine, F.concat(F.col("doc_id").cast("string"), F.lit("." + ending))).otherwise(name)
    rows, is_ = T.parse(docs.select(name.alias("path"), text.alias("content"))), lambda r: F.col("row") == r
    return rows.groupBy("path").agg(
        F.max(F.when(F.col("qualified_name").rlike(r"^C\d+\.run$") & is_("symbol"), F.col("qualified_name"))).alias("method"), F.count_if(is_("symbol")).alias("symbols"),
        F.max(F.when(is_("import"), F.col("name"))).alias("imported"), F.array_join(F.sort_array(F.collect_list(F.when(is_("call"), F.col("name")))), ",").alias("called"),
        F.count_if(is_("type_ref")).alias("bases"),
    )


@query("src4_event_files", "SELECT 'r' || r_regionkey AS folder, 'events.jsonl' AS name FROM region UNION ALL SELECT 'r' || r_regionkey, 'events-1.jsonl' FROM region WHERE r_regionkey % 2 = 0")
def src4(spark, sf):
    root, regions = _work(spark, "logs"), table(spark, sf, "region").count()
    for k in range(regions):
        for name in ("events.jsonl", "other.jsonl", *(["events-1.jsonl"] if k % 2 == 0 else [])):
            store.put_text(spark, f"{root}/r{k}/{name}", "{}")
    found = EV.event_files(spark, [f"{root}/r{k}" for k in range(regions + 2)])
    return spark.createDataFrame([tuple(p.rsplit("/", 2)[1:]) for p in found], "folder string, name string")


@query("src5_documents", "SELECT n_name AS feature, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT n_name, 'saved', -1 FROM nation WHERE n_nationkey % 4 = 1")
def src5(spark, sf):
    """A design of each nation, another view beside it, and some saved over."""
    root = _work(spark, "documents")
    nations = table(spark, sf, "nation")
    saved = nations.select(F.col("n_name").alias("feature"), F.lit("design").alias("view"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    EV.save_documents(saved.union(saved.withColumn("view", F.lit("live"))), root)
    EV.save_documents(saved.join(nations.where("n_nationkey % 4 = 1").select(F.col("n_name").alias("feature")), "feature", "left_semi").select("feature", "view", F.lit("saved").alias("name"), F.lit(-1).alias("region")), root)
    return EV.read_documents(spark, root, "name string, region int").where("view = 'design'").select("feature", "name", "region")


@query("src6_manifests", "SELECT n_name AS name, n_nationkey % 2 = 0 AS verified, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS corrupt FROM nation WHERE n_nationkey % 5 <> 0")
def src6(spark, sf):
    root = _work(spark, "bricks")
    for key, name, _ in _nations(spark, sf):
        text = json.dumps({"name": name, "schema_version": "1", "verified": key % 2 == 0, "seed_files": ["a.ts"]})
        store.put_text(spark, f"{root}/b{key}/manifest.json", text[: len(text) // 2] if key % 5 == 0 else text)
    good, bad = EV.load_manifests(spark, root)
    return good.select("name", "verified", F.lit(bad.first()["corrupt"]).cast("long").alias("corrupt"))


@query("src7_dependencies", """
WITH p AS (SELECT l_orderkey, l_partkey, max(l_linenumber) AS v, bool_or(l_returnflag = 'R') AS dev FROM lineitem WHERE l_orderkey % 7 <> 3 GROUP BY 1, 2)
SELECT 'o' || l_orderkey || '/package.json' AS path, 'p' || l_partkey AS package, '^' || v AS version, CASE WHEN dev THEN 'devDependencies' ELSE 'dependencies' END AS grp FROM p""")
def src7(spark, sf):
    """A manifest for each order, its parts as packages; those of every seventh order are cut off."""
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("v"), F.bool_or(F.col("l_returnflag") == "R").alias("dev"))
    entry = F.struct(F.concat(F.lit("p"), "l_partkey").alias("key"), F.concat(F.lit("^"), "v").alias("value"))
    group = lambda dev: F.map_from_entries(F.collect_list(F.when(F.col("dev") == dev, entry)))
    doc = parts.groupBy("l_orderkey").agg(F.to_json(F.struct(group(False).alias("dependencies"), group(True).alias("devDependencies"))).alias("doc"))
    cut = F.when(F.col("l_orderkey") % 7 == 3, F.expr("left(doc, length(doc) - 1)")).otherwise(F.col("doc"))
    manifests = doc.select(F.concat(F.lit("o"), "l_orderkey", F.lit("/package.json")).alias("path"), cut.alias("content"))
    return T.dependencies(manifests.union(manifests.select(F.replace("path", F.lit("package.json"), F.lit("readme.md")), "content")))


@query("src8_ledger", "SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'violated' ELSE 'ok' END AS status, n_nationkey::BIGINT AS matched_seq, 'r' || n_regionkey AS file FROM nation WHERE n_regionkey <> 2")
def src8(spark, sf):
    """A ledger for each region, one of them cut off."""
    root, nations = _work(spark, "ledger"), _nations(spark, sf)
    for region in sorted({r for _, _, r in nations}):
        text = json.dumps({"entries": [{"id": n, "status": "ok" if k % 2 else "violated", "matched_seq": k, "declared_files": [f"r{r}"]} for k, n, r in nations if r == region]})
        store.put_text(spark, f"{root}/ledger-{region}.json", text[:-9] if region == 2 else text)
    return EV.load_ledger(spark, f"{root}/*.json").select("id", "status", "matched_seq", F.get("declared_files", 0).alias("file"))


@query("snk5_ring", "SELECT 'deviations' AS part, count(*) FILTER (event_id % 8 < 5 AND event_type = 'error') AS n FROM events UNION ALL SELECT 'slots', count(*) FILTER (event_id % 8 >= 5) FROM events")
def snk5(spark, sf):
    """Eight appends to a ring of three slots: the first five slots leave only their errors."""
    log = f"{_work(spark, 'ring')}/log"
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("probe"))
    schema = "event_id long, probe string"
    for k in range(8):
        store.append_ring(e.where(F.col("event_id") % 8 == k), log, F.col("probe") == "error", slot_bytes=1, keep=3)
    count = lambda part, name: store.read_ring(spark, log, schema, name).agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count("deviations", "deviations").union(count("slots", "slot=*")).select(F.col("part"), F.col("n"))


@query("snk6_usage", "SELECT tool, count(*) AS calls, count(*) FILTER (ok) AS good FROM usage GROUP BY tool", "usage")
def snk6(spark, sf):
    """Usage rows appended in two parts and read back."""
    path, rows = f"{_work(spark, 'usage')}/log", role(spark, sf, "usage")
    for half in ("ms % 2 = 0", "ms % 2 <> 0"):
        store.append_usage(rows.where(half), path)
    back = spark.read.schema("tool string, action string, ok boolean, ms long").json(path)
    return back.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("ok").alias("good"))


@query("src9_changed_paths", """
SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 1 THEN 'deleted' WHEN doc_id % 10 = 2 THEN 'added' ELSE 'modified' END AS change FROM documents WHERE doc_id % 10 IN (1, 2) OR (doc_id % 10 = 3 AND coalesce(text, '') <> '')""")
def src9(spark, sf):
    """Paths that differ between two states of the documents, by the hash of their content."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    after = docs.where("doc_id % 10 <> 1").withColumn("content", F.when(F.col("doc_id") % 10 == 3, F.concat("content", "content")).otherwise(F.col("content")))
    return T.tree_diff(docs.where("doc_id % 10 <> 2"), after)


@query("str1_flushes", """
WITH c AS (SELECT event_type AS project, epoch_us(ts) // 1000 AS t, 'f' || user_id % 10 AS path FROM events), d AS (SELECT DISTINCT project, t FROM c),
f AS (SELECT project, list_reduce(list({'t': t, 'due': NULL::BIGINT, 'last': NULL::BIGINT, 'flushes': []::BIGINT[]} ORDER BY t),
 lambda a, x: {'t': x.t, 'due': CASE WHEN (CASE WHEN a.due < x.t THEN a.due ELSE a.last END) IS NOT NULL AND x.t - (CASE WHEN a.due < x.t THEN a.due ELSE a.last END) >= 3600000 THEN x.t ELSE x.t + 600000 END,
  'last': CASE WHEN a.due < x.t THEN a.due ELSE a.last END, 'flushes': CASE WHEN a.due < x.t THEN list_append(a.flushes, a.due) ELSE a.flushes END},
 {'t': 0, 'due': NULL::BIGINT, 'last': NULL::BIGINT, 'flushes': []::BIGINT[]}) AS s FROM d GROUP BY project),
u AS (SELECT project, unnest(list_append(s.flushes, s.due)) AS flush_ms FROM f)
SELECT project, flush_ms, path, 'changed' AS change, count(*) AS n FROM (SELECT c.*, (SELECT min(flush_ms) FROM u WHERE u.project = c.project AND flush_ms >= c.t) AS flush_ms FROM c) GROUP BY 1, 2, 3""")
def str1_flushes(spark, sf):
    """Events as changes of ten files, flushed after ten quiet minutes and at least once an hour."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("project"), F.concat(F.lit("f"), F.col("user_id") % 10).alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"), F.lit("changed").alias("change"))
    return V.flush_changes(e, 600_000, 3_600_000)


@query("str7_backfill", "SELECT n_regionkey AS region, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation GROUP BY 1")
def str7(spark, sf):
    """Nations as files, backfilled two files at a time by one flight; a second finds nothing to do."""
    root = _work(spark, "backfill")
    table(spark, sf, "nation").repartition(6, "n_nationkey").write.parquet(f"{root}/in")
    files = lambda: V.stream_files(spark, f"{root}/in", "n_nationkey int, n_name string, n_regionkey int", files_per_batch=2)
    for _ in range(2):
        V.backfill(files(), lambda df, k: df.write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("str9_ring", "SELECT event_type AS probe, least(20, count(*)) AS held, max(event_id) AS newest, min(event_id) FILTER (r <= 20) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) GROUP BY 1")
def str9(spark, sf):
    """The last 20 events of each probe, kept while they stream."""
    root = _work(spark, "recent")
    e = table(spark, sf, "events").select(F.col("event_type").alias("probe"), F.col("event_id").alias("seq"))
    e.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{root}/in")
    seen = V.recent_ring(V.stream_files(spark, f"{root}/in", "probe string, seq long"), 20)
    V.run_to_end(seen, lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint", "update")
    out = spark.read.parquet(f"{root}/out")
    last = out.groupBy("probe").agg(F.max_by(F.struct("held", "newest", "oldest"), F.struct("batch", "held", "newest")).alias("x"))
    return last.select("probe", "x.*")


@query("graph18_control_flow", "SELECT 'n' || doc_id || '.py' AS path, (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 6 END)::BIGINT AS edges, (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END)::BIGINT AS exits FROM documents")
def graph18(spark, sf):
    """One function for each document, with its words as a comment: a branch with a return, a step, a return; every fifth does not parse."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\w ]", " ").alias("text"))
    files = docs.select(
        F.concat(F.lit("n"), "doc_id", F.lit(".py")).alias("path"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "def (").otherwise("def f(x):"), F.lit("\n    # "), "text", F.lit("\n    if x > "), "doc_id", F.lit(":\n        return 1\n    x += 1\n    return x\n")).alias("content"),
    )
    found = flows.control_flows(files).groupBy("path").agg(F.count("*").alias("edges"), F.count_if(F.col("target") == "exit").alias("exits"))
    return files.select("path").join(found, "path", "left").na.fill(0, ["edges", "exits"])


@query("graph19_data_trace", """
WITH n AS (SELECT l_orderkey AS g, row_number() OVER w AS k, row_number() OVER w AS step, CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR END AS given FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
o AS (SELECT *, coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY g ORDER BY k), 'start') AS out_value FROM n)
SELECT g::VARCHAR AS graph, step, CASE WHEN step = 1 THEN 'entry' ELSE 'k' || k END AS node, coalesce(lag(out_value) OVER (PARTITION BY g ORDER BY k), 'start') AS in_value, out_value FROM o""")
def graph19(spark, sf):
    """Each order's lines as a chain from the first on; those of even parts give their own value."""
    from pyspark.sql import Window

    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    name = lambda k: F.when(k == 1, "entry").otherwise(F.concat(F.lit("k"), k))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("graph"), F.row_number().over(along).alias("k"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey").cast("string")).alias("out"))
    lines = lines.withColumn("node", name(F.col("k")))
    edges = lines.where("k > 1").select("graph", F.concat(F.lit("e"), "k").alias("edge"), name(F.col("k") - 1).alias("source"), F.col("node").alias("target"), F.lit("chain").alias("kind"))
    return flows.data_traces(lines.select("graph", "node", "out"), edges, "entry", "start").drop("note")
