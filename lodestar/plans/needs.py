"""Queries: indexed search, typed closures, observe points, rules on tokens and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import closure as C
from lodestar.operators import graph as G
from lodestar.operators import members as M
from lodestar.operators import monolith as O
from lodestar.operators import points as P
from lodestar.operators import rules as U
from lodestar.operators import search as R
from lodestar.plans.advanced import RARE, _rare_calls, bm25
from lodestar.plans.files import _work
from lodestar.plans.standins import query, role, table
from lodestar.sources.text_index import TextIndex

PHRASES = ["red", "widget", "promo", "small_ring"]


@query("srch1_index", " UNION ALL ".join(f"SELECT {k} AS query, id, rank FROM (SELECT id, rank FROM ({bm25(p)}) WHERE kind <> 'file' ORDER BY rank, id LIMIT 20)" for k, p in enumerate(PHRASES)), "nodes")
def srch1_index(spark, sf) -> DataFrame:
    """Four phrases in one job on stored postings; a third of the files are indexed first and then indexed anew."""
    nodes = role(spark, sf, "nodes")
    index = TextIndex(spark, f"{_work(spark, 'index')}/symbols")
    early = nodes.where("key % 3 = 0")
    index.update(early.withColumn("name", F.concat("name", F.lit(" widget"))))
    index.update(nodes, early.select(F.col("file_path").alias("path")))
    return index.search(PHRASES, 20).select("query", "id", "rank")


WORDS = ["red_widget", "promo", "small"]


@query("srch7_words", f"""WITH hits AS ({' UNION ALL '.join(f"SELECT '{w}' AS w, id FROM (SELECT id, rank FROM ({bm25(w)}) WHERE kind <> 'file' ORDER BY rank, id LIMIT 5)" for w in WORDS)}),
c AS (SELECT qualified_name, file_path AS file, start_line AS line, 1.0 AS score, 'exact' AS source, 0 AS p FROM nodes WHERE name IN ('red_widget', 'promo', 'small')
 UNION ALL SELECT qualified_name, file_path, start_line, CASE WHEN lower(name) = w THEN 0.8 ELSE 0.5 END, 'text', 1 FROM nodes JOIN hits ON nodes.id = hits.id)
SELECT qualified_name, file, line, max(score)::DOUBLE AS score, arg_max(source, score * 10 - p) AS source FROM c GROUP BY 1, 2, 3""", "nodes")
def srch7_words(spark, sf) -> DataFrame:
    """Candidates of several words by one search of the index."""
    nodes = role(spark, sf, "nodes")
    index = TextIndex(spark, f"{_work(spark, 'index')}/symbols")
    index.update(nodes)
    return R.best_candidates(R.symbol_candidates(nodes, WORDS, index=index))


# -- closures -----------------------------------------------------------------

FILES = "SELECT doc_id, 'd' || doc_id % 50 || '/f' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.go' ELSE '.ts' END AS path, 'd' || doc_id % 50 AS dir, doc_id % 5 = 0 AS go FROM documents"
REACH = """UNION SELECT u.path, u.doc_id, u.dir, u.go, r.depth + 1 FROM {r} r JOIN f u ON (u.doc_id = r.doc_id // 2 {value}) OR (u.go AND r.go AND u.dir = r.dir) WHERE r.depth < 4"""


@query("graph1_typed_closure", f"""
WITH RECURSIVE f AS ({FILES}), s AS (SELECT path, doc_id, dir, go, 0 AS depth FROM f WHERE doc_id % 97 = 96),
w AS (SELECT * FROM s {REACH.format(r='w', value='')}), v AS (SELECT * FROM s {REACH.format(r='v', value='AND r.doc_id % 3 <> 0')})
SELECT path AS file, min(depth) AS depth, path IN (SELECT path FROM v) AS runtime FROM w GROUP BY path""")
def graph1_typed(spark, sf) -> DataFrame:
    """Documents as files in fifty folders; each imports the one of half its number, every third a type only."""
    path = lambda c: F.concat(F.lit("d"), c % 50, F.lit("/f"), c, F.when(c % 5 == 0, ".go").otherwise(".ts"))
    docs = table(spark, sf, "documents").select("doc_id", path(F.col("doc_id")).alias("path"))
    half = docs.select(F.col("doc_id").alias("half"), F.col("path").alias("target"))
    imports = docs.join(half, F.expr("half = doc_id div 2")).select(F.col("path").alias("source"), "target", (F.col("doc_id") % 3 == 0).alias("type_only"))
    return C.import_closure(imports, docs.select("path"), docs.where("doc_id % 97 = 96").select("path"), max_depth=4).select("file", "depth", "runtime")


@query("graph6_scc_rounds", f"WITH RECURSIVE e AS ({RARE}), k AS (SELECT source, target FROM e WHERE source IN (SELECT target FROM e)), r AS (SELECT source, target FROM k UNION SELECT r.source, k.target FROM r JOIN k ON r.target = k.source), m AS (SELECT a.source AS node, a.target AS peer FROM r a JOIN r b ON a.source = b.target AND a.target = b.source), s AS (SELECT node, min(peer) AS scc FROM m GROUP BY node) SELECT node, scc, count(*) OVER (PARTITION BY scc) AS size FROM s")
def graph6_rounds(spark, sf) -> DataFrame:
    """Strong components by rounds alone, as of graphs that no task holds."""
    return G.scc(_rare_calls(spark, sf), local_edges=0)


# -- observe points -----------------------------------------------------------

TAIL = "CASE doc_id % 4 WHEN 0 THEN 'writeFile(x)' WHEN 1 THEN 'try { a() } catch (e) { }' WHEN 2 THEN 'try { a() } catch (e) { throw e }' ELSE '' END"


@query("obs_points", f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || {TAIL}, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, 'A' AS part, array_to_string(ls[1:len(ls) - 1], chr(10)) AS body, len(ls) - 1 AS lines FROM t UNION ALL SELECT doc_id, 'B', ls[len(ls)], 1 FROM t UNION ALL SELECT doc_id, 'C', array_to_string(ls, chr(10)), len(ls) FROM t),
g AS (SELECT s.*, coalesce(c.n, 0) AS called, s.part = 'B' AND s.doc_id % 6 = 0 AS changed, s.doc_id % 5 = 0 AS hot, regexp_matches(body, '\\b(writeFileSync|writeFile|appendFileSync|appendFile|mkdirSync|mkdir|copyFileSync|copyFile|renameSync|rename|unlinkSync|unlink|rmSync|rm|spawn|execSync|execFileSync)\\s*\\(') AS io,
 len(list_filter(regexp_extract_all(body, 'catch\\s*(?:\\([^)]*\\))?\\s*\\{{([^{{}}]*)\\}}', 1), lambda x: NOT regexp_matches(x, '(?i)\\bthrow\\b|\\bconsole\\.|\\breject\\b|report|logger|log\\('))) > 0 AS silent
 FROM s LEFT JOIN (SELECT doc_id // 10 AS doc_id, 'C' AS part, count(*) AS n FROM documents GROUP BY 1) c ON s.doc_id = c.doc_id AND s.part = c.part)
SELECT doc_id || part AS id, part = 'B' AS focus, least(1.0, round((CASE WHEN called > 0 THEN 0.3 * least(1.0, ln(1 + called) / ln(13)) ELSE 0 END) + (CASE WHEN changed THEN 0.2 ELSE 0 END) + (CASE WHEN lines >= 40 THEN 0.1 ELSE 0 END) + (CASE WHEN hot THEN 0.05 ELSE 0 END) + (CASE WHEN io THEN 0.2 ELSE 0 END) + (CASE WHEN silent THEN 0.15 ELSE 0 END) + (CASE WHEN part = 'B' THEN 0.25 ELSE 0 END), 3))::DOUBLE AS score,
 concat_ws(',', CASE WHEN called > 0 THEN 'called' END, CASE WHEN changed THEN 'changed' END, CASE WHEN lines >= 40 THEN 'size' END, CASE WHEN hot THEN 'hot_file' END, CASE WHEN io THEN 'io' END, CASE WHEN silent THEN 'silent_catch' END) AS signals
FROM g WHERE called > 0 OR changed OR lines >= 40 OR hot OR io OR silent""")
def obs_points(spark, sf) -> DataFrame:
    """Three symbols for each document, its text, a line of code after it, and both; focus on the line of code."""
    tail = F.expr(TAIL)
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail).alias("content"), F.when(F.col("doc_id") % 5 == 0, 2 * P.HOT_MS).otherwise(1).cast("long").alias("modified_at"))
    n = F.size(F.split("content", "\n"))
    parts = F.array(F.struct(F.lit("A").alias("part"), F.lit(1).alias("a"), (n - 1).alias("b")), F.struct(F.lit("B").alias("part"), n.alias("a"), n.alias("b")), F.struct(F.lit("C").alias("part"), F.lit(1).alias("a"), n.alias("b")))
    spans = docs.select("doc_id", "path", F.inline(parts))
    own = F.concat("doc_id", "part")
    nodes = spans.select(own.alias("id"), F.lit("function").alias("kind"), F.col("part").alias("name"), own.alias("qualified_name"), F.col("path").alias("file_path"), F.col("a").alias("start_line"), F.col("b").alias("end_line"), F.lit(False).alias("is_closure"))
    calls = docs.select(F.concat("doc_id", F.lit("A")).alias("source"), F.concat(F.expr("doc_id div 10"), F.lit("C")).alias("target"), F.lit("call").alias("kind"))
    changed = docs.where("doc_id % 6 = 0").select(F.concat("doc_id", F.lit("B")).alias("qualified_name"))
    found = P.observe_points(nodes, calls, docs, changed, 2 * P.HOT_MS, focus=" B$")
    return found.select("id", "focus", "score", F.array_join(F.transform("evidence", lambda e: e["signal"]), ",").alias("signals"))


# -- rules and dictionaries ---------------------------------------------------

PLAIN = "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' '{g})"


@query("srch16_tokens", f"""
WITH d AS (SELECT doc_id::VARCHAR AS path, doc_id, n_chars FROM documents WHERE length({PLAIN.format(g=", 'g'")}) >= 0)
SELECT 'one' AS rule, path, 2 AS line, 3 AS end_line, 'e' || doc_id || ', {{' || chr(10) || ' a: [' || n_chars || '] }}' AS x FROM d
UNION ALL SELECT 'one', path, 4, 4, 'z' FROM d UNION ALL SELECT 'two', path, 2, 3, 'e' || doc_id FROM d UNION ALL SELECT 'same', path, 5, 5, 'k' || doc_id FROM d""")
def srch16_tokens(spark, sf) -> DataFrame:
    """Calls over two lines, with brackets in a hole, before the text of each document."""
    code = F.format_string("x\nlog(e%s, {\n a: [%s] })\nlog ( z )\nk%s = k%s + 1; k = j + 1\n%s", "doc_id", "n_chars", "doc_id", "doc_id", F.expr(PLAIN.format(g="")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), code.alias("content"))
    found = U.match_rules(docs, {"one": "log($x)", "two": "log($x, $y)", "same": "$x = $x + 1"})
    return found.select("rule", "path", "line", "end_line", F.col("holes")["x"].alias("x"))


FORMS = [("license", "licensed"), ("license", "license"), ("cc", "cc by"), ("by", "by-nc"), ("insult", "idiot"), ("insult", "idiots")]


@query("srch18_splits", f"""
WITH f(term, form) AS (VALUES {', '.join(map(str, FORMS))}), sp AS (SELECT doc_id, term, form, string_split(lower(text), form) AS p FROM documents, f WHERE contains(lower(text), form)),
h AS (SELECT doc_id, term, length(form) AS n, unnest(range(1, len(p))) AS k, p, form FROM sp),
s AS (SELECT doc_id, term, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * n AS start, list_sum(list_transform(p[1:k], lambda x: length(x))) + k * n AS e FROM h),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start, e DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
q AS (SELECT *, sum(CASE WHEN start < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, e DESC, term ROWS UNBOUNDED PRECEDING) AS piece FROM o)
SELECT doc_id AS id, min(start)::INTEGER AS start, max(e)::INTEGER AS "end", first(term ORDER BY start, e DESC, term) AS term FROM q GROUP BY doc_id, piece""")
def srch18_splits(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return U.dictionary_splits(docs, spark.createDataFrame(FORMS, "term string, form string"))


# -- fields and features ------------------------------------------------------

FIELDS = """interface T%1$s { name: string; size?: number
  run(x: number): void }
const a = { name: `%2$s`, size: 2, other: 3 }
const { name, size: s } = a
function f({ size }: T%1$s) { return size / a.size + a?.name }
"""


@query("srch20_fields", """SELECT doc_id || '.ts' AS path, line, kind FROM documents, (VALUES (1, 'decl'), (3, 'key'), (4, 'destructure'), (5, 'destructure'), (5, 'read')) AS v(line, kind)""")
def srch20_fields(spark, sf) -> DataFrame:
    """Where a field is declared, set, taken apart and read; a file for each document, its text in a template."""
    return M.field_references(M.members(_field_files(spark, sf)), "size")


def _field_files(spark, sf) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[`\\$\s\x0B\x85\u2028\u2029]", " ")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    return docs.select(F.concat("id", F.lit(".ts")).alias("path"), F.format_string(FIELDS, "id", "text").alias("content"))


@query("srch20_types", """SELECT doc_id || '.ts' AS path, 3 AS line, 2::BIGINT AS hits, 'name,size' AS keys FROM documents""")
def srch20_types(spark, sf) -> DataFrame:
    """Literals in all files that could be of the type that the first one declares."""
    fields = M.members(_field_files(spark, sf))
    first = table(spark, sf, "documents").agg(F.min("doc_id").cast("string").alias("id")).first()["id"]
    return M.constructions(fields, f"{first}.ts", f"T{first}")


@query("graph20_feature_tree", """
WITH p AS (SELECT CASE WHEN doc_id % 9 = 0 THEN lang || '/' || doc_id ELSE lang || '/x/' || source || '/' || doc_id % 7 || '/' || doc_id END || '.ts' AS path FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
u AS (SELECT path, string_split(path, '/') AS s, k FROM p, UNNEST(range(0, len(string_split(path, '/')))) AS r(k)), d AS (SELECT path, k, s, array_to_string(s[1:k], '/') AS dir, k = len(s) - 1 AS direct, CASE WHEN k < len(s) - 1 THEN s[k + 1] END AS child FROM u),
g AS (SELECT dir, k, count(*) AS files, count(*) FILTER (direct) AS own, count(DISTINCT child) AS kids FROM d GROUP BY dir, k), kept AS (SELECT dir, k, files FROM g WHERE dir = '' OR (files >= 6 AND NOT (own = 0 AND kids = 1))),
near AS (SELECT path, arg_max(d.dir, d.k) AS dir FROM d JOIN kept USING (dir) GROUP BY path)
SELECT dir AS feature, (SELECT arg_max(o.dir, o.k) FROM kept o WHERE o.k < t.k AND (o.dir = '' OR starts_with(t.dir, o.dir || '/'))) AS parent, files, (SELECT count(*) FROM near n WHERE n.dir = t.dir) AS own FROM kept t""")
def graph20_feature_tree(spark, sf) -> DataFrame:
    """Documents as files below language and source; every ninth lies beside them."""
    id_ = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 9 == 0, F.concat_ws("/", "lang", id_)).otherwise(F.concat_ws("/", "lang", F.lit("x"), "source", (F.col("doc_id") % 7).cast("string"), id_))
    docs = table(spark, sf, "documents").where("lang is not null and source is not null")
    return M.feature_tree(docs.select(F.concat(path, F.lit(".ts")).alias("path")), 6)


# -- monoliths ----------------------------------------------------------------

ROLED = "CASE key % 7 WHEN 0 THEN name || 'Service' WHEN 1 THEN 'get' || name || 'Store' WHEN 2 THEN 'a.' || name || 'client' ELSE name END"
GOES = "CASE key % 3 WHEN 0 THEN replace(file_path, '.ts', '.go') WHEN 1 THEN replace(file_path, '.ts', '.py') ELSE file_path END"


@query("graph8_anchors", f"""
WITH f AS (SELECT key AS node, CASE WHEN key % 2 = 0 THEN upper(n) ELSE n END AS name, file FROM (SELECT key, kind, {ROLED} AS n, {GOES} AS file FROM nodes) WHERE kind IN ('function', 'method')),
d AS (SELECT target AS node, count(*) AS n FROM calls WHERE source <> target AND source IN (SELECT node FROM f) AND target IN (SELECT node FROM f) GROUP BY 1), m AS (SELECT greatest(1, max(n)) AS most FROM d),
s AS (SELECT node, name, coalesce(n, 0) AS in_degree, most, regexp_matches(name, '(?i)(service|store|client)$') AS role, regexp_matches(name, '(?i)^(get|set)\\w*$') AS getter, contains(name, '.') AS dotted, ends_with(file, '.go') AS go, ends_with(file, '.py') AS py FROM f LEFT JOIN d USING (node), m)
SELECT node, in_degree, round(in_degree / most + role::INTEGER + CASE WHEN go THEN (CASE WHEN regexp_matches(name, '^[A-Z]') THEN 1.0 ELSE 0 END) WHEN py THEN (CASE WHEN starts_with(name, '_') THEN 0 ELSE 0.5 END) ELSE 0.3 END, 9)::DOUBLE AS score,
 (((role AND NOT getter AND NOT dotted) OR (go AND regexp_matches(name, '^[A-Z]'))) AND NOT dotted) OR (in_degree = most AND most >= 3 AND role AND NOT getter AND NOT dotted) AS anchor FROM s""", "nodes", "calls")
def graph8_anchors(spark, sf) -> DataFrame:
    """Parts as functions of three languages, some named for a role; line items as calls."""
    n = role(spark, sf, "nodes").select("key", "kind", F.expr(ROLED).alias("n"), F.expr(GOES).alias("file_path"))
    n = n.select(F.col("key").alias("id"), "kind", F.when(F.col("key") % 2 == 0, F.upper("n")).otherwise(F.col("n")).alias("name"), "file_path")
    return O.anchor_scores(n, role(spark, sf, "calls").select("source", "target"))


@query("graph11_sub_splits", """
WITH o AS (SELECT p_partkey AS node, p_type AS community, CASE WHEN p_size % 4 > 0 THEN 'T' || p_size % 4 END AS owner FROM part),
g AS (SELECT community, owner FROM o WHERE owner IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT o.* FROM o JOIN g ON o.community = g.community AND o.owner = g.owner),
e AS (SELECT row_number() OVER () AS e, source, target FROM calls WHERE source IN (SELECT node FROM o) AND target IN (SELECT node FROM o)),
s AS (SELECT community, e, count(DISTINCT owner) AS k FROM (SELECT e, community, owner FROM e JOIN h ON h.node = source UNION ALL SELECT e, community, owner FROM e JOIN h ON h.node = target) GROUP BY ALL),
c AS (SELECT community, count(*) AS calls, count(*) FILTER (k = 2) AS crossing FROM s GROUP BY 1), n AS (SELECT community, count(*) AS groups FROM g GROUP BY 1)
SELECT community, coalesce(groups, 0) AS groups, coalesce(calls, 0) AS calls, coalesce(crossing, 0) AS crossing, CASE WHEN coalesce(groups, 0) >= 2 AND coalesce(calls, 0) > 0 THEN round(crossing / calls, 9) ELSE 0 END::DOUBLE AS ratio,
 coalesce(groups, 0) >= 2 AND (coalesce(calls, 0) = 0 OR crossing / calls <= 0.4) AS splittable FROM (SELECT DISTINCT community FROM o) LEFT JOIN n USING (community) LEFT JOIN c USING (community)""", "calls")
def graph11_sub_splits(spark, sf) -> DataFrame:
    """Part types as communities, of parts that three owners hold."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("community"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("T"), F.col("p_size") % 4)).alias("owner"))
    return O.sub_splits(parts.select("node", "community"), parts.select("node", "owner"), role(spark, sf, "calls").select("source", "target"))
