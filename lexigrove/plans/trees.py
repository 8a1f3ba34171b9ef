"""Node store, tree and text queries over the star schema's hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import graph, nodes as N
from lexigrove.plans.registry import Tables, query

# The hierarchy region, nation, customer as nodes with prefixed ids.
_TREE = """tree AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS title, 'Region ' || r_name AS definition FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'Nation ' || n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'Customer of ' || c_mktsegment FROM customer)"""


def tree(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = t.region.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), F.concat(F.lit("Region "), "r_name").alias("definition"))
    n = t.nation.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), F.concat(F.lit("Nation "), "n_name").alias("definition"))
    c = t.customer.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("title"), F.concat(F.lit("Customer of "), "c_mktsegment").alias("definition"))
    return graph.union_all([r, n, c])


@query("a04_get_node", "SELECT doc_id, source FROM documents WHERE doc_id = 7")
def a04(t: Tables) -> DataFrame:
    return t.documents.filter("doc_id = 7").select("doc_id", "source")


@query("a05_upsert", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def a05(t: Tables) -> DataFrame:
    return N.upsert(t.customer.selectExpr("c_custkey AS id", "c_name AS name"), t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"))


@query("a06_delete", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def a06(t: Tables) -> DataFrame:
    return N.delete(t.customer.selectExpr("c_custkey AS id", "c_name AS name"), t.supplier.selectExpr("s_suppkey AS id"))


@query("a07_list_all", "SELECT id, title FROM (WITH " + _TREE + " SELECT * FROM tree) ORDER BY id")
def a07(t: Tables) -> DataFrame:
    return tree(t).select("id", "title").orderBy("id")


@query("a09_metadata_filter", "SELECT doc_id FROM documents WHERE source = 'src3' AND n_chars >= 500 AND n_chars <= 5000")
def a09(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", (F.col("n_chars") / 10_000).alias("confidence"), F.lit(None).cast("string").alias("last_verified"))
    return N.filter_by_metadata(rows, source="src3", confidence_min=0.05, confidence_max=0.5, colour="ignored").select("doc_id")


@query("a12_resume", "SELECT b.item_id, l.lang FROM benchmark b CROSS JOIN (SELECT DISTINCT lang FROM documents) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id AND d.lang = l.lang)")
def a12(t: Tables) -> DataFrame:
    todo = t.benchmark.select("item_id").crossJoin(F.broadcast(t.documents.select("lang").distinct()))  # conditions: a few languages
    done = t.documents.select(F.col("doc_id").alias("item_id"), "lang")
    return N.remaining(todo, done, ["item_id", "lang"])


@query("a21_node_validity", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'definition' WHEN NOT (n_chars / 10000.0 BETWEEN 0 AND 1) THEN 'confidence' END AS reason FROM documents")
def a21(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("definition"), (F.col("n_chars") / 10_000).alias("confidence"))
    return rows.select("doc_id", N.invalid_reason().alias("reason"))


@query("a23_index_text", "SELECT p_partkey, concat_ws(chr(10), nullif(p_name, ''), nullif(p_type, ''), p_brand, CASE WHEN p_size > 25 THEN 'large' END) AS index_text FROM part")
def a23(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("definition"), F.array("p_brand").alias("key_facts"), F.array(F.when(F.col("p_size") > 25, "large"), F.lit("")).alias("related_concepts"))
    return rows.select("p_partkey", N.index_text().alias("index_text"))


@query("a25_listing", "SELECT doc_id, '- ' || doc_id || ': **' || source || '** — ' || CASE WHEN length(string_split(text, chr(10))[1]) > 150 THEN substr(string_split(text, chr(10))[1], 1, 147) || '...' ELSE string_split(text, chr(10))[1] END AS line FROM documents")
def a25(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.listing_line(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("line"))


@query("a28_normalize_id", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS id FROM part")
def a28(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.normalize_id(F.concat_ws(" / ", "p_brand", "p_name")).alias("id"))


@query("a29_collision_ids", "SELECT p_partkey, b || CASE row_number() OVER (PARTITION BY b ORDER BY p_partkey) WHEN 1 THEN '' ELSE '_l' || p_partkey END AS id FROM (SELECT p_partkey, replace(lower(p_name), ' ', '_') AS b FROM part)")
def a29(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("base"), F.col("p_partkey").alias("line"))
    return N.unique_ids(rows, "base", "line", ["p_partkey"]).select("p_partkey", "id")


@query("a33_inject_budget", "SELECT lang, doc_id FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 20000")
def a33(t: Tables) -> DataFrame:
    return N.within_budget(t.documents.select("lang", "doc_id", "n_chars"), "lang", ["doc_id"], "n_chars", 20_000).select("lang", "doc_id")


@query("a42_children", f"WITH {_TREE} SELECT parent_id AS parent, row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS pos, id AS child FROM tree WHERE parent_id IS NOT NULL")
def a42(t: Tables) -> DataFrame:
    rows = tree(t)
    listed = rows.filter("parent_id is not null").groupBy(F.col("parent_id").alias("parent")).agg(F.array_append(F.array_sort(F.collect_list("id")), F.lit("ghost")).alias("kids"))
    return graph.children(listed.select("parent", F.posexplode("kids").alias("pos", "child")), rows).withColumn("pos", F.col("pos").cast("long"))


@query("a43_parent", f"WITH {_TREE} SELECT id, parent_id AS parent FROM tree")
def a43(t: Tables) -> DataFrame:
    return graph.parents(tree(t))


@query("a44_roots", f"WITH {_TREE} SELECT id FROM tree WHERE parent_id IS NULL")
def a44(t: Tables) -> DataFrame:
    return graph.roots(tree(t)).orderBy("id")


#: Below each nation hangs a chain: its customers by key, each the child of the one before.
_DEEP = """deep AS (
  SELECT 'n' || n_nationkey AS id, NULL::VARCHAR AS parent_id, n_name AS title, 'Nation' AS definition FROM nation
  UNION ALL SELECT 'c' || c_custkey, coalesce('c' || lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 'n' || c_nationkey), c_name, 'Customer' FROM customer)"""


def deep_tree(t: Tables) -> DataFrame:
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("n_name").alias("title"), F.lit("Nation").alias("definition"))
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    up = F.coalesce(F.concat(F.lit("c"), before.cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return n.unionByName(t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), up.alias("parent_id"), F.col("c_name").alias("title"), F.lit("Customer").alias("definition")))


@query(
    "a45_descendants",
    f"WITH RECURSIVE {_DEEP}, below AS (SELECT p.id AS start, c.id, 1 AS depth FROM deep p JOIN deep c ON c.parent_id = p.id WHERE p.parent_id IS NULL UNION ALL SELECT b.start, t.id, b.depth + 1 FROM below b JOIN deep t ON t.parent_id = b.id) SELECT start, id, depth FROM below",
)
def a45(t: Tables) -> DataFrame:
    rows = deep_tree(t)
    edges = rows.filter("parent_id is not null").select(F.col("parent_id").alias("parent"), F.lit(0).alias("pos"), F.col("id").alias("child"))
    return graph.descendants(graph.children(edges, rows), graph.roots(rows))


_FAULTY = f"""{_TREE}, faulty AS (
  SELECT id, CASE WHEN id LIKE 'c%0' THEN 'ghost' ELSE parent_id END AS parent_id FROM tree UNION ALL SELECT 'x1', 'x2' UNION ALL SELECT 'x2', 'x1'),
listed AS (SELECT parent_id AS parent, id AS child FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT 'r1', 'n0' UNION ALL SELECT 'r2', 'nowhere')"""


@query(
    "a46_validate",
    f"""WITH {_FAULTY}
SELECT 'missing_child' AS kind, parent AS id, child AS other FROM listed WHERE child NOT IN (SELECT id FROM faulty)
UNION ALL SELECT 'missing_parent', id, parent_id FROM faulty WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM faulty)
UNION ALL SELECT 'not_mutual', l.parent, l.child FROM listed l JOIN faulty f ON f.id = l.child WHERE f.parent_id IS DISTINCT FROM l.parent
UNION ALL SELECT 'cycle', x, x FROM (VALUES ('x1'), ('x2')) v(x)
UNION ALL SELECT 'many_parents', child, count(DISTINCT parent)::VARCHAR FROM listed GROUP BY child HAVING count(DISTINCT parent) > 1""",
)
def a46(t: Tables) -> DataFrame:
    rows = tree(t).select("id", "parent_id")
    listed = rows.filter("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    more = t.spark.createDataFrame([("r1", "n0"), ("r2", "nowhere")], "parent string, child string")
    loop = t.spark.createDataFrame([("x1", "x2"), ("x2", "x1")], "id string, parent_id string")
    faulty = rows.withColumn("parent_id", F.when(F.col("id").rlike("^c.*0$"), "ghost").otherwise(F.col("parent_id"))).unionByName(loop)
    return graph.validate(faulty, listed.unionByName(more))


@query("a47_stats", "SELECT count(*) AS n_nodes, count(*) FILTER (WHERE l.quality = 1) AS n_with_examples, round(coalesce(avg(coalesce(l.quality, 0)), 0), 6) AS examples_per_node FROM documents d LEFT JOIN labels l USING (doc_id)")
def a47(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(F.coalesce("quality", F.lit(0)).alias("n_examples"))
    return rows.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("n_examples") == 1).alias("n_with_examples"), F.round(F.coalesce(F.avg("n_examples"), F.lit(0.0)), 6).alias("examples_per_node"))


@query("a47_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a47_sources(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


@query("a50_rebuild_children", f"WITH {_TREE} SELECT p.id, array_to_string(list_sort(list_distinct(list_filter(list(c.id) || ['n0'], lambda x: x IS NOT NULL))), ',') AS children FROM tree p LEFT JOIN tree c ON c.parent_id = p.id WHERE NOT p.id LIKE 'c%' GROUP BY p.id")
def a50(t: Tables) -> DataFrame:
    rows = tree(t)
    listed = rows.filter("not id like 'c%'").select("id", F.array(F.lit("n0")).alias("children"))
    return graph.rebuild_children(rows, listed).select("id", F.array_join("children", ",").alias("children"))


@query(
    "a52_tree_render",
    f"WITH RECURSIVE {_DEEP}, walk AS (SELECT id, title, definition, 0 AS depth FROM deep WHERE parent_id IS NULL UNION ALL SELECT d.id, d.title, d.definition, w.depth + 1 FROM walk w JOIN deep d ON d.parent_id = w.id) SELECT id, repeat('  ', depth) || '- ' || id || ': **' || title || '** — ' || definition AS line FROM walk",
)
def a52(t: Tables) -> DataFrame:
    return graph.tree_lines(deep_tree(t)).orderBy(F.col("root").asc_nulls_last(), "pre", "id").select("id", "line")


@query("a66_whitelist", "SELECT doc_id, array_to_string(list_filter(w, lambda x: x IN ('the', 'and', 'der', 'les')), ' ') AS kept, len(list_distinct(list_filter(w, lambda x: x NOT IN ('the', 'and', 'der', 'les'))))::INT AS n_rejected FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)")
def a66(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.split(F.lower("text"), r"\Q \E", -1).alias("w"))
    kept, rejected = graph.whitelist(F.col("w"), F.array(*map(F.lit, ("the", "and", "der", "les"))), F.lit(""))
    return words.select("doc_id", F.array_join(kept, " ").alias("kept"), F.size(rejected).alias("n_rejected"))


@query("a71_pattern_check", "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AND NOT contains(lower(text), '###') AS ok FROM documents")
def a71(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.pattern_check(F.col("text"), ("the", "AND"), ("###",))[2].alias("ok"))


@query("a72_json_ids", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def a72(t: Tables) -> DataFrame:
    answer = F.concat(F.lit('Sure: {"selected_ids": ["'), F.get_json_object("props", "$.k"), F.lit('"]} done'))
    return t.events.select("event_id", F.element_at(T.selected_ids(answer), 1).alias("k"))


@query("a75_yes_no", "SELECT doc_id, coalesce(nullif(regexp_extract(upper(coalesce(text, '')), '\\b(YES|NO)\\b', 1), ''), 'NO') AS answer FROM documents")
def a75(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.yes_no(F.col("text")).alias("answer"))


@query("a53_hierarchy_merge", "SELECT coalesce(a.source, b.source) AS topic, coalesce(a.n, 0) AS n_english, coalesce(b.n, 0) AS n_german FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) b ON a.source = b.source")
def a53(t: Tables) -> DataFrame:
    side = lambda lang, name: t.documents.filter(F.col("lang") == lang).groupBy(F.col("source").alias("topic")).agg(F.count("*").alias(name))
    return side("en", "n_english").join(side("de", "n_german"), "topic", "full").na.fill(0)


@query("a54_uncovered", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a54(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("a76_ordered_distinct", "SELECT conv_id, count(DISTINCT role) AS n_roles, (array_agg(role ORDER BY turn))[1] AS first_role FROM conversations GROUP BY conv_id")
def a76(t: Tables) -> DataFrame:
    first = F.first("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("first_role", first).groupBy("conv_id", "first_role").agg(F.count_distinct("role").alias("n_roles"))
