"""Node stores, node texts and hierarchy builds: suppliers, parts and customers stand for nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import builds, nodes as N
from lexigrove.plans.registry import Tables, query
from lexigrove.plans.trees import _FAULTY, tree
from lexigrove.sources import store
from lexigrove.sources.scratch import scratch_path


def _nodes(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows with (id, title, definition) as nodes; what is not given is empty."""
    from pyspark.sql.types import StructType

    out = rows
    for f in StructType.fromDDL(N.NODE_SCHEMA).fields:
        if f.name not in out.columns:
            blank = F.array() if f.dataType.typeName() == "array" else F.lit(0.5) if f.name == "confidence" else F.lit(None)
            out = out.withColumn(f.name, blank.cast(f.dataType))
    return out.select(*StructType.fromDDL(N.NODE_SCHEMA).names)


def suppliers(t: Tables) -> DataFrame:
    return _nodes(t, t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.lit("A supplier").alias("definition")))


@query("a01_load_store", "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN s_name ELSE 'draft' END AS title, (SELECT count(*) FROM supplier WHERE s_suppkey % 6 = 0) AS n_rejected FROM supplier")
def a01(t: Tables) -> DataFrame:
    """JSON documents of some hundred nodes each, with later nodes of the same id and with invalid ones."""
    node = lambda pos, title, definition: F.struct(pos.alias("pos"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), title.alias("title"), definition.alias("definition"))
    first = t.supplier.select(node(F.col("s_suppkey"), F.lit("draft"), F.lit("x")).alias("n"))
    later = t.supplier.filter("s_suppkey % 3 = 0").select(node(F.col("s_suppkey") + 1_000_000_000, F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("x")).alias("n"))
    path = scratch_path(t.spark, "store")
    listed = first.unionByName(later).groupBy(F.floor(F.col("n.pos") / 500).alias("part")).agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    documents = listed.repartitionByRange("part").sortWithinPartitions("part").select(F.to_json(F.struct(F.lit("1").alias("version"), F.col("nodes"))).alias("value"))
    documents.write.option("maxRecordsPerFile", 1).text(path)
    valid, rejected = store.load_nodes(t.spark, path)
    return valid.select("id", "title").crossJoin(F.broadcast(rejected.agg(F.count("*").alias("n_rejected"))))


@query("a02_open_store", "SELECT 'created' AS how, 0 AS n UNION ALL SELECT 'opened', count(*) FROM supplier UNION ALL SELECT 'refused', 0")
def a02(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "store")
    try:
        store.Store(t.spark, path, create_if_missing=False)
        how = "wrong"
    except FileNotFoundError:
        how = "refused"
    empty = store.Store(t.spark, path)
    n = len(empty)
    empty.put(suppliers(t))
    empty.flush()
    opened = store.Store(t.spark, path, create_if_missing=False)
    return t.spark.createDataFrame([("created", n), ("opened", len(opened)), (how, 0)], "how string, n long")


@query("a03_flush", "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'new' ELSE s_name END AS title FROM supplier WHERE s_suppkey % 7 <> 0")
def a03(t: Tables) -> DataFrame:
    """Written, changed, written again; a flush without changes does nothing."""
    s = store.Store(t.spark, scratch_path(t.spark, "store"))
    s.put(suppliers(t))
    s.flush()
    s.put(suppliers(t).filter("id like '%0'").withColumn("title", F.lit("new")))
    s.remove(t.supplier.filter("s_suppkey % 7 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))
    if not s.flush() or s.flush():
        raise RuntimeError("a flush writes what has changed, once")
    return s.nodes.select("id", "title")


@query("a08_count", "SELECT count(*) AS n FROM supplier")
def a08(t: Tables) -> DataFrame:
    s = store.Store(t.spark, scratch_path(t.spark, "store"), autosave=True)
    s.put(suppliers(t))
    return t.spark.createDataFrame([(len(s),)], "n long")


@query("a10_context", "SELECT 's' || s_suppkey AS id FROM supplier")
def a10(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "store")
    with store.Store(t.spark, path) as s:
        s.put(suppliers(t))
    return store.Store(t.spark, path, create_if_missing=False).nodes.select("id")


@query("a11_records", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def a11(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "records")
    store.append_records(t.supplier.selectExpr("s_suppkey AS k", "s_name AS name"), path)
    store.append_records(t.customer.selectExpr("c_custkey AS k", "c_name AS name"), path)
    return store.read_records(t.spark, path, "k long, name string")


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"


def _hierarchy(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("topic")).agg(F.array_sort(F.collect_set("p_name")).alias("concepts"))


@query(
    "a13_not_built",
    f"""WITH each AS (SELECT DISTINCT p_brand AS topic, p_name AS concept FROM part), built AS (SELECT DISTINCT {_NORM.format('p_name')} AS id FROM part WHERE p_size > 25)
SELECT topic, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (WHERE b.id IS NULL), '') AS concepts, count(b.id) AS skipped FROM each LEFT JOIN built b ON b.id = {_NORM.format('concept')} GROUP BY topic""",
)
def a13(t: Tables) -> DataFrame:
    stored = t.part.filter("p_size > 25").select(T.normalize_id(F.col("p_name")).alias("id"))
    return builds.not_built(_hierarchy(t), stored).select("topic", F.array_join("concepts", ",").alias("concepts"), "skipped")


@query("a14_predictions", "SELECT n_nationkey::INT AS task_id, CASE n_nationkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' ELSE 'present' END AS status, CASE n_nationkey % 3 WHEN 2 THEN n_name END AS patch FROM nation")
def a14(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "patches")
    t.nation.filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("task_id"), F.when(F.col("n_nationkey") % 3 == 1, " ").otherwise(F.col("n_name")).alias("value")).write.partitionBy("task_id").text(root)
    found = store.predictions(t.nation.select(F.col("n_nationkey").alias("task_id")), root)
    return found.select("task_id", "status", F.when(F.col("status") == "present", F.trim(F.regexp_replace("patch", "\n", ""))).alias("patch"))


@query("a20_valid_examples", "SELECT doc_id, n_chars % 3 <> 0 AND n_chars % 5 <> 0 AS valid FROM documents")
def a20(t: Tables) -> DataFrame:
    steps = F.when(F.col("n_chars") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    example = F.struct(F.col("lang").alias("problem"), steps.alias("solution_steps"), F.when(F.col("n_chars") % 5 == 0, " ").otherwise(F.col("source")).alias("final_answer"), F.lit("").alias("key_insight"))
    return t.documents.select("doc_id", N.valid_examples(F.array(example.cast(N.EXAMPLE))).alias("valid"))


@query("a22_round_trip", "SELECT p_partkey, p_name AS title, p_brand || ',' || p_type AS facts, p_retailprice AS confidence FROM part")
def a22(t: Tables) -> DataFrame:
    node = F.struct(F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("key_facts"), F.col("p_retailprice").alias("confidence"))
    back = F.from_json(F.to_json(node), "title string, key_facts array<string>, confidence double")
    return t.part.select("p_partkey", back.alias("n")).select("p_partkey", "n.title", F.array_join("n.key_facts", ",").alias("facts"), "n.confidence")



def part_nodes(t: Tables) -> DataFrame:
    """Parts with two key facts, one worked example, and code for every third."""
    key = F.col("p_partkey").cast("string")
    example = F.struct(F.concat(F.lit("Size of "), "p_name").alias("problem"), F.array("p_brand", "p_type").alias("solution_steps"), F.col("p_size").cast("string").alias("final_answer"), F.when(F.col("p_size") > 25, "large").otherwise("").alias("key_insight"))
    rows = t.part.select(
        F.concat(F.lit("p"), key).alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("A part of type "), "p_type", F.lit("\nand brand "), "p_brand").alias("definition"),
        F.array("p_brand", "p_type", F.lit("x")).alias("key_facts"), F.array(example.cast(N.EXAMPLE)).alias("worked_examples"), F.array(F.lit("Mind the size.")).alias("common_pitfalls"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("x = 1")).alias("source_code"),
    )
    return _nodes(t, rows)


_INJECT = """'## ' || p_name || chr(10) || chr(10) || 'A part of type ' || p_type || chr(10) || 'and brand ' || p_brand || chr(10) || '### Key Facts' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type || chr(10) || '- x' || chr(10)
|| '### Worked Examples' || chr(10) || '**Example 1:** Size of ' || p_name || chr(10) || chr(10) || 'Solution:' || chr(10) || '1. ' || p_brand || chr(10) || '2. ' || p_type || chr(10) || 'Answer: ' || p_size || CASE WHEN p_size > 25 THEN chr(10) || '_Key insight: large_' ELSE '' END || chr(10)
|| chr(10) || '### Common Pitfalls' || chr(10) || '- Mind the size.' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '### Source Code' || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END"""


@query("a24_inject_text", f"SELECT 'p' || p_partkey AS id, {_INJECT} AS text FROM part")
def a24(t: Tables) -> DataFrame:
    return part_nodes(t).select("id", N.inject_text().alias("text"))


@query("a32_oversized", f"SELECT id, n FROM (SELECT 'p' || p_partkey AS id, length({_INJECT})::INT AS n FROM part) WHERE n > 260")
def a32(t: Tables) -> DataFrame:
    return part_nodes(t).select("id", F.length(N.inject_text()).alias("n")).filter("n > 260")


@query("a26_rerank_line", "SELECT 'p' || p_partkey AS id, '- p' || p_partkey || ': **' || p_name || '** — A part of type ' || p_type || ' | ' || p_brand || '; ' || p_type AS line FROM part")
def a26(t: Tables) -> DataFrame:
    return part_nodes(t).select("id", N.rerank_line().alias("line"))


@query("a27_localize_line", "SELECT doc_id, concat_ws(' | ', 'ID=' || doc_id, source || '.f', lang, substr(text, 1, 200), substr(string_split(text, chr(10))[1], 1, 120)) AS line FROM documents")
def a27(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit(".f")).alias("qualified_name"), F.col("lang").alias("file"), F.col("text").alias("signature"), F.col("text").alias("definition"))
    return rows.select("doc_id", N.localize_line().alias("line"))


@query("a40_add", "SELECT 'refused' AS what, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'added', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)")
def a40(t: Tables) -> DataFrame:
    """A second node of an id is refused and changes nothing; new ones are added."""
    s = store.Store(t.spark, scratch_path(t.spark, "store"))
    s.put(suppliers(t))
    s.flush()
    try:
        s.add(suppliers(t))
        said = "wrong"
    except ValueError:
        said = "refused"
    before = len(s)
    s.add(_nodes(t, t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.lit("x").alias("definition"))))
    return t.spark.createDataFrame([(said, before), ("added", len(s))], "what string, n long")


@query("a41_membership", "SELECT 's' || c_custkey AS id FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def a41(t: Tables) -> DataFrame:
    s = store.Store(t.spark, scratch_path(t.spark, "store"), autosave=True)
    s.put(suppliers(t))
    return s.known(t.customer.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id")))


@query(
    "a48_tree_from_store",
    f"""WITH {_FAULTY}, issues AS (SELECT 'cycle' AS kind, x AS id, x AS other FROM (VALUES ('x1'), ('x2')) v(x) UNION ALL SELECT 'missing_parent', id, parent_id FROM faulty WHERE parent_id NOT IN (SELECT id FROM faulty))
SELECT 'node' AS kind, id, parent_id AS other FROM faulty UNION ALL (SELECT * FROM issues ORDER BY kind, id LIMIT 5)""",
)
def a48(t: Tables) -> DataFrame:
    """All nodes, and the first five issues in order: building is not strict."""
    loop = t.spark.createDataFrame([("x1", "x2"), ("x2", "x1")], "id string, parent_id string")
    rows = tree(t).select("id", F.when(F.col("id").rlike("^c.*0$"), "ghost").otherwise(F.col("parent_id")).alias("parent_id")).unionByName(loop)
    nodes, issues = builds.tree_of(rows, t.spark.createDataFrame([], "parent string, child string"))
    return nodes.select(F.lit("node").alias("kind"), "id", F.col("parent_id").alias("other")).unionByName(issues)


@query(
    "a49_build_hierarchy",
    """WITH kids AS (SELECT n_regionkey AS r, array_to_string(list('nation_' || n_nationkey ORDER BY n_nationkey), ',') AS new FROM nation GROUP BY 1)
SELECT 'region_' || r_regionkey AS id, NULL::VARCHAR AS parent_id, CASE WHEN r_regionkey % 2 = 0 THEN 'old_' || r_regionkey || ',' ELSE '' END || new AS children FROM region JOIN kids ON r = r_regionkey
UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, '' FROM nation""",
)
def a49(t: Tables) -> DataFrame:
    concepts = t.nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("Nation "), k.cast("string"))).alias("concepts"))
    hierarchy = t.region.join(concepts, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("pos"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("topic"), "concepts")
    key = F.col("r_regionkey").cast("string")
    stored = t.region.filter("r_regionkey % 2 = 0").select(F.concat(F.lit("region_"), key).alias("id"), F.array(F.concat(F.lit("old_"), key)).alias("children_ids"))
    return builds.build_hierarchy(hierarchy, stored).select("id", "parent_id", F.array_join("children_ids", ",").alias("children"))


@query(
    "a51_linked",
    """WITH n AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT n.id, coalesce((SELECT string_agg(c.id, ',' ORDER BY c.id) FROM n c WHERE c.parent_id = n.id), '') AS children, 'n1,r1' AS related FROM n""",
)
def a51(t: Tables) -> DataFrame:
    rows = tree(t).filter("id not like 'c%'").select("id", "parent_id", F.array().cast("array<string>").alias("children_ids"), F.array(F.lit("n1"), F.lit("gone"), F.lit("r1")).alias("related"))
    return builds.linked(rows).select("id", F.array_join("children_ids", ",").alias("children"), F.array_join("related", ",").alias("related"))


@query("a175_hierarchy_ids", f"SELECT DISTINCT {_NORM.format('name')} AS id FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_name FROM part)")
def a175(t: Tables) -> DataFrame:
    return builds.hierarchy_ids(_hierarchy(t))


@query("a176_required_keys", "SELECT 'hierarchy' AS what, count(DISTINCT p_brand)::BIGINT AS n FROM part UNION ALL SELECT 'missing: version', 0")
def a176(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "hierarchy")
    _hierarchy(t).write.json(path)
    rows = builds.require_keys(t.spark.read.json(path), "topic", "concepts")
    try:
        builds.require_keys(rows, "version")
        said = "wrong"
    except KeyError as e:
        said = e.args[0]
    return rows.agg(F.lit("hierarchy").alias("what"), F.count("*").alias("n")).unionByName(t.spark.createDataFrame([(said, 0)], "what string, n long"))


@query("a177_grounded_concepts", "SELECT p_partkey, 'p' || p_partkey AS problem, p_brand || ',' || p_type AS concepts, p_name AS new_name FROM part")
def a177(t: Tables) -> DataFrame:
    """Concepts by problem, and new ones, of responses with text around their JSON."""
    told = F.to_json(F.struct(F.create_map(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.array("p_brand", "p_type")).alias("problem_to_concepts"), F.array(F.struct(F.col("p_name").alias("name"), F.lit("t").alias("topic"), F.lit("{r}").alias("rationale"))).alias("new_concepts_needed")))
    by_problem, new = builds.concept_rows(T.balanced_json(F.concat(F.lit("Here it is:\n"), told, F.lit("\nThat is {all}."))))
    rows = t.part.select("p_partkey", F.explode(by_problem).alias("problem", "concepts"), new.alias("new"))
    return rows.select("p_partkey", "problem", F.array_join("concepts", ",").alias("concepts"), F.element_at("new", 1)["name"].alias("new_name"))


@query("a177_problem_listing", "SELECT doc_id, '### Problem ' || doc_id || ' (gt=' || lang || '):' || chr(10) || substr(text, 1, 500) AS line FROM documents")
def a177_listing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", builds.problem_listing(F.col("doc_id").cast("string"), F.col("lang"), F.col("text")).alias("line"))


@query(
    "a183_whitelist_rows",
    "WITH r AS (SELECT a.n_name AS own, b.n_name AS id, row_number() OVER (PARTITION BY a.n_name ORDER BY b.n_name) - 1 AS place FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name) SELECT own, (place // 4)::INT AS line_no, string_agg(id, ', ' ORDER BY id) AS ids FROM r GROUP BY ALL",
)
def a183(t: Tables) -> DataFrame:
    pairs = t.nation.select(F.col("n_name").alias("own"), "n_regionkey").join(t.nation.select(F.col("n_name").alias("id"), "n_regionkey"), "n_regionkey").select("own", "id")
    return builds.whitelist_rows(pairs, "own").withColumnRenamed("row", "line_no")


@query("a119_enriched", "SELECT 'p' || p_partkey AS id, CASE WHEN p_size > 25 THEN p_type WHEN p_partkey % 2 = 0 THEN 'told ' || p_brand END AS summary FROM part")
def a119(t: Tables) -> DataFrame:
    """Empty summaries of functions are filled; others, and those of classes, stay."""
    rows = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("class").alias("type"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("summary"), F.col("p_name").alias("source_code"))
    answers = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("told "), "p_brand").alias("answer"))
    return builds.enriched(rows, answers, "summary", ("function", "method")).select("id", "summary")


@query("a120_checked_nodes", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'definition' WHEN 2 THEN 'key_facts' WHEN 3 THEN 'worked_examples' END AS fault FROM part")
def a120(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    answer = F.to_json(F.struct(
        F.when(k != 0, F.col("p_name")).alias("title"), F.when(k != 1, F.col("p_type")).otherwise(" ").alias("definition"), F.when(k != 2, F.array("p_brand", "p_type")).otherwise(F.array("p_brand")).alias("key_facts"),
        F.when(k != 3, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("worked_examples"),
    ))
    return t.part.select("p_partkey", builds.checked_node(answer)[1].alias("fault"))


@query("a121_replaced_examples", "SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_type ELSE p_name END AS example, CASE p_partkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'replaced' WHEN 2 THEN 'rejected' ELSE 'failed' END AS status FROM part")
def a121(t: Tables) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")
    answers = t.part.filter("p_partkey % 4 > 0").select(key, F.when(F.col("p_partkey") % 4 < 3, F.col("p_type")).alias("example"), (F.col("p_partkey") % 4 == 1).alias("agrees"))
    return builds.replaced_examples(t.part.select(key, F.col("p_name").alias("example")), answers)


@query("a184_call_outcomes", "SELECT event_id, CASE WHEN s IS NULL OR s IN (429, 529) OR s BETWEEN 500 AND 599 THEN again WHEN s <> 200 THEN 'fail' WHEN user_id % 2 = 0 THEN again ELSE 'done' END AS outcome FROM (SELECT *, [200, 429, 500, 404, 529, NULL, 401][event_id % 7 + 1] AS s, CASE WHEN event_id % 5 < 3 THEN 'retry' ELSE 'fail' END AS again FROM events)")
def a184(t: Tables) -> DataFrame:
    codes = F.array(*(F.lit(x).cast("int") for x in (200, 429, 500, 404, 529, None, 401)))
    status = F.element_at(codes, (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", builds.call_outcome(status, F.when(F.col("user_id") % 2 == 0, " ").otherwise("text"), F.col("event_id") % 5).alias("outcome"))
