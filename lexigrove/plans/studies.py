"""Retrieval conditions and their study: passages are queries, documents the nodes, sources their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import bm25, conditions, evaluation as E, fusion, graph, similarity
from lexigrove.plans import code
from lexigrove.plans.registry import Tables, query
from lexigrove.plans.retrieval import _LISTS, _TOP, _grams, _index, _lists, _queries, bm25_sql
from lexigrove.sources import source_code as S
from lexigrove.sources.scratch import cut


@query("a61_word_ngrams", f"SELECT doc_id, coalesce(len(g), 0)::INT AS n, list_min(g) AS first FROM ({_grams('documents', 'doc_id')})")
def a61(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", T.word_ngrams(F.col("text")).alias("g"))
    return rows.select("doc_id", F.size("g").alias("n"), F.array_min("g").alias("first"))


@query(
    "a63_leakage_report",
    f"""WITH d AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')}),
du AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM d), bu AS (SELECT item_id, len(g) AS n, unnest(g) AS x FROM b)
SELECT doc_id, item_id, round(count(*) / (any_value(du.n) + any_value(bu.n) - count(*)), 3) AS jaccard FROM du JOIN bu USING (x) GROUP BY doc_id, item_id
HAVING count(*) / (any_value(du.n) + any_value(bu.n) - count(*)) >= 0.01""",
)
def a63(t: Tables) -> DataFrame:
    return similarity.leakage(t.documents, t.benchmark, "doc_id", "item_id", 0.01)


_ENDS = "(SELECT min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM supplier)"


@query(
    "a65_repaired_references",
    f"""SELECT 's' || s_suppkey AS id, concat_ws(',', CASE WHEN s_suppkey <> lo THEN 's' || lo END, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey <> hi THEN 's' || hi END) AS related,
'zzzz' || s_suppkey AS broken, CASE WHEN s_suppkey % 2 = 0 THEN 'zzzz' || s_suppkey ELSE '' END AS by_judge FROM supplier, {_ENDS}""",
)
def a65(t: Tables) -> DataFrame:
    """Each supplier refers to itself, to the first one, and to something that only a judge may know."""
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    ends = t.supplier.agg(F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))
    rows = t.supplier.crossJoin(F.broadcast(ends))
    broken = F.concat(F.lit("zzzz"), F.col("s_suppkey").cast("string"))
    refs = rows.select(key.alias("id"), F.posexplode(F.array(key, F.concat(F.lit("s"), F.col("lo").cast("string")), broken)).alias("pos", "ref"))
    judged = rows.select(broken.alias("ref"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s"), F.col("hi").cast("string"))).otherwise("nowhere").alias("answer"))
    out = similarity.repair_references(refs, rows.select(key.alias("id")), judged)
    return out.select("id", *(F.array_join(c, ",").alias(c) for c in ("related", "broken", "by_judge")))


@query("a174_judged", "SELECT 'r' || s_suppkey AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey END AS answer FROM supplier")
def a174(t: Tables) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    mapping = F.to_json(F.create_map(F.concat(F.lit("r"), key), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "s").otherwise("x"), key)))
    return fusion.judged(t.supplier.select(mapping.alias("mapping")), t.supplier.select(F.concat(F.lit("s"), key).alias("id")))


_TOP5 = f"WITH {bm25_sql()}, top AS ({_TOP.format(5)})"


@query("a74_localized_ids", f"{_TOP5}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top) SELECT query_id, id::VARCHAR AS id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 2 THEN CASE rank WHEN 3 THEN 0 WHEN 1 THEN 1 END ELSE rank END)::INT AS rank FROM n WHERE n <= 2 OR rank IN (1, 3)")
def a74(t: Tables) -> DataFrame:
    """Answers in prose name one candidate by its place and one by its id; an id that does not exist is passed over."""
    top = bm25.retrieve(_index(t), _queries(t), 5)
    best = top.filter("rank = 1").select("query_id", F.concat(F.lit('Well: ```json\n{"reasoning": "{x}", "selected_ids": ["ID #3", "none", "'), F.col("id").cast("string"), F.lit('"]}\n```')).alias("answer"))
    return fusion.localized(top, best.select("query_id", fusion.greedy_ids("answer").alias("ids")), 2).select("query_id", "id", "rank")


@query("a89_ranked_scores", f"WITH {bm25_sql()} SELECT query_id, id, score FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20")
def a89(t: Tables) -> DataFrame:
    return bm25.retrieve(_index(t), _queries(t), 20).select("query_id", "id", "score")


def _chosen(t: Tables, step: int) -> DataFrame:
    """A model's selection for each passage: multiples of ``step`` times its id, one of which is no document."""
    k = F.col("query_id")
    return _queries(t).select("query_id", F.array(*((k * step * i + i).cast("string") for i in (3, 1)), F.lit("-5"), (k + 2).cast("string")).alias("ids"))


def _chosen_sql(step: int, n: int) -> str:
    items = ", ".join((f"(0, q.query_id * {3 * step} + 3)", f"(1, q.query_id * {step} + 1)", "(2, -5)", "(3, q.query_id + 2)")[:n])
    return f"SELECT q.query_id, v.id, v.pos + 1 AS rank FROM queries q, LATERAL (VALUES {items}) v(pos, id) WHERE v.id IN (SELECT id FROM corpus)"


@query("a93_tree_selection", f"WITH {bm25_sql()} SELECT query_id, id::VARCHAR AS id, rank::INT AS rank FROM ({_chosen_sql(7, 3)})")
def a93(t: Tables) -> DataFrame:
    answer = F.concat(F.lit('{"selected_ids": ["'), F.array_join("ids", '", "'), F.lit('"]}'))
    told = _chosen(t, 7).select("query_id", T.selected_ids(answer).alias("ids"))
    every = t.documents.select(F.col("doc_id").cast("string").alias("id"))
    # The candidates of every passage are all nodes: existence is one semi join, not a list a query.
    each = told.select("query_id", F.posexplode(F.slice("ids", 1, 3)).alias("pos", "id"))
    return each.join(every, "id", "left_semi").select("query_id", "id", (F.col("pos") + 1).alias("rank"))


@query("a96_relation_index", f"WITH {code._DEFS} SELECT 'class' AS kind, CASE WHEN kind = 'method' THEN 'C' || p_partkey END AS key, count(*) AS n FROM defs GROUP BY 1, 2 UNION ALL SELECT 'callee', c, count(*) FROM (SELECT unnest(string_split(calls, ',')) AS c FROM defs WHERE calls <> '') GROUP BY 1, 2")
def a96(t: Tables) -> DataFrame:
    nodes = S.assembled(S.extract(code.files(t)))
    by_class, callers = graph.relation_index(nodes)
    size = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return size(by_class, "class", "class").unionByName(size(callers, "callee", "callee"))


@query(
    "a100_conditions",
    f"""WITH {bm25_sql()}, every AS (SELECT q.query_id, c.id, coalesce(s.score, 0.0) AS score FROM queries q CROSS JOIN corpus c LEFT JOIN scores s ON s.query_id = q.query_id AND s.id = c.id),
lists AS (SELECT query_id, id, rank, 0 AS list_no FROM ({_TOP.format(8)}) UNION ALL SELECT query_id, id, rank, 1 FROM ({_chosen_sql(7, 4)})),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY query_id, id),
merged AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, id::VARCHAR) AS rank FROM fused QUALIFY rank <= 8),
told AS (SELECT query_id, id, min(rank) AS pos FROM ({_chosen_sql(5, 4)}) GROUP BY ALL)
SELECT 'hybrid' AS condition, query_id, id::VARCHAR AS id, new::INT AS rank FROM (SELECT m.query_id, m.id, row_number() OVER (PARTITION BY m.query_id ORDER BY CASE WHEN n > 3 THEN pos END NULLS LAST, m.rank) AS new FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM merged) m LEFT JOIN told USING (query_id, id)) WHERE new <= 3
UNION ALL SELECT 'bm25', query_id, id::VARCHAR, rank FROM ({_TOP.format(3)})
UNION ALL SELECT 'flat_selection', query_id, id::VARCHAR, rank FROM ({_chosen_sql(3, 3)})
UNION ALL SELECT 'tree_selection', query_id, id::VARCHAR, rank FROM ({_chosen_sql(7, 3)})
UNION ALL SELECT 'irrelevant', query_id, id::VARCHAR, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM every QUALIFY rank <= 3)""",
)
def a100(t: Tables) -> DataFrame:
    made = conditions.all_conditions(_index(t), _queries(t), _chosen(t, 3), _chosen(t, 7), _chosen(t, 5))
    return graph.union_all([df.select(F.lit(name).alias("condition"), "query_id", "id", "rank") for name, df in made.items()])


@query(
    "a103_hybrid_unknown",
    f"""{_LISTS}, picks AS (SELECT query_id, id, rank AS pos FROM merged WHERE id % 3 = 0),
five AS (SELECT m.query_id, m.id, row_number() OVER (PARTITION BY m.query_id ORDER BY CASE WHEN n > 5 THEN p.pos END DESC NULLS LAST, m.rank) AS place FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM merged) m LEFT JOIN picks p USING (query_id, id) QUALIFY place <= 5),
told AS (SELECT *, id % 2 = 0 AS known FROM five), counted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY known, place) AS n FROM told)
SELECT query_id, id, n::INT AS rank FROM counted WHERE (NOT known OR n <= 1) AND n <= 3""",
)
def a103(t: Tables) -> DataFrame:
    merged = cut(fusion.rrf(_lists(t)), "merged")
    held = merged.filter("id % 3 = 0").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id")), False).alias("x")).select("query_id", F.col("x.id").alias("ids"))
    answers = merged.select("query_id", "id", F.when(F.col("id") % 2 == 0, "YES").otherwise("NO").alias("answer"))
    return fusion.hybrid_unknown(merged, held, answers)


def _filed(t: Tables) -> DataFrame:
    """The top ten of each passage with its source as file and its language as name."""
    top = bm25.retrieve(_index(t), _queries(t), 10).select("query_id", "id", "rank")
    return top.join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("name")), "id")


def _oracle(t: Tables) -> DataFrame:
    k = F.col("query_id")
    return _queries(t).select("query_id", F.array(F.concat(F.lit("src"), (k % 20).cast("string")), F.concat(F.lit("src"), (k % 7).cast("string"))).alias("files"), F.array(F.lit("en"), F.lit("fr")).alias("names"))


_FILED = f"WITH {bm25_sql()}, filed AS (SELECT s.query_id, s.rank, d.source AS file, d.lang AS name FROM ({_TOP.format(10)}) s JOIN documents d ON d.doc_id = s.id), oracle AS (SELECT query_id, 'src' || (query_id % 20) AS f1, 'src' || (query_id % 7) AS f2 FROM queries)"


@query("a106_file_hits", f"{_FILED} SELECT o.query_id, count(*) FILTER (WHERE contains(file, f1) OR contains(file, f2)) AS n_hits FROM oracle o LEFT JOIN filed f ON f.query_id = o.query_id AND rank <= 3 GROUP BY 1")
def a106(t: Tables) -> DataFrame:
    return E.file_hits(_filed(t), _oracle(t))


@query(
    "a154_strict_hit",
    f"""{_FILED}, told AS (SELECT o.query_id, rank, name, coalesce(contains(file, f1) OR contains(f1, file) OR contains(file, f2) OR contains(f2, file), false) AS hit FROM oracle o LEFT JOIN filed USING (query_id)),
r AS (SELECT query_id, min(rank) FILTER (WHERE hit AND name IN ('en', 'fr')) AS func_rank, min(rank) FILTER (WHERE hit) AS file_rank FROM told GROUP BY 1)
SELECT *, CASE WHEN func_rank IS NOT NULL THEN 'func_hit' WHEN file_rank IS NOT NULL THEN 'file_only' ELSE 'miss' END AS hit FROM r""",
)
def a154(t: Tables) -> DataFrame:
    return E.strict_hit(_filed(t), _oracle(t))


_TWO = """SELECT o_custkey AS query_id, min(o_orderkey % 50) FILTER (WHERE o_orderstatus = 'F') AS base_rank, min(o_orderkey % 40) FILTER (WHERE o_orderstatus = 'O') AS treated_rank FROM orders GROUP BY 1"""


@query(
    "a157_rank_delta",
    f"""SELECT *, base_rank - treated_rank AS delta, CASE WHEN base_rank IS NULL THEN 'found' WHEN treated_rank IS NULL THEN 'lost' WHEN base_rank > treated_rank THEN 'up' WHEN base_rank < treated_rank THEN 'down' ELSE 'same' END AS change,
coalesce(base_rank <= 3, false) AS base_top, coalesce(treated_rank <= 3, false) AS treated_top FROM ({_TWO}) WHERE base_rank IS NOT NULL OR treated_rank IS NOT NULL""",
)
def a157(t: Tables) -> DataFrame:
    ranks = lambda status, n: t.orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("query_id")).agg(F.min(F.col("o_orderkey") % n).alias("rank"))
    return E.rank_delta(ranks("F", 50), ranks("O", 40))


@query(
    "a158_oracle_relations",
    """WITH nodes AS (SELECT p_partkey AS id, p_brand AS class, 'f' || (p_partkey % 300) AS name, p_partkey AS pos, ['f' || (p_partkey * 7 % 300), 'f' || (p_partkey * 11 % 300)] AS calls FROM part),
oracle AS (SELECT p_partkey AS query_id, p_partkey AS id FROM part), retrieved AS (SELECT p_partkey AS query_id, (p_partkey * i * 13) % (SELECT count(*) FROM part) + 1 AS id, i AS rank FROM part, (VALUES (1), (2), (3)) v(i)),
mids AS (SELECT name, arg_min(calls, pos) AS next FROM nodes GROUP BY 1),
r AS (SELECT r.query_id, r.id, r.rank, n.class = o.class AS same_class, list_contains(n.calls, o.name) AS calls_oracle, list_contains(o.calls, n.name) AS called_by_oracle, n.calls, o.name AS oname FROM retrieved r JOIN nodes n ON n.id = r.id JOIN oracle q USING (query_id) JOIN nodes o ON o.id = q.id)
SELECT query_id, id, rank, same_class, calls_oracle, called_by_oracle, NOT calls_oracle AND EXISTS (SELECT 1 FROM mids m WHERE list_contains(r.calls, m.name) AND list_contains(m.next, r.oname)) AS two_hops FROM r""",
)
def a158(t: Tables) -> DataFrame:
    f = lambda c: F.concat(F.lit("f"), (c % 300).cast("string"))
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("id"), F.col("p_brand").alias("class"), f(k).alias("name"), k.alias("pos"), F.array(f(k * 7), f(k * 11)).alias("calls"))
    n = t.part.count()
    ids = t.part.select(k.alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank")).withColumn("id", F.col("query_id") * F.col("rank") * 13 % n + 1)
    return graph.oracle_relations(ids, nodes, t.part.select(k.alias("query_id"), k.alias("id")))


@query("a150_lengths", "SELECT doc_id, length(text)::INT AS n_text, coalesce(json_array_length(CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN '[]' ELSE '[1, \"a\", {}]' END), 0)::INT AS n_tests FROM documents")
def a150(t: Tables) -> DataFrame:
    listed = F.when(F.col("n_chars") % 3 == 1, "[]").when(F.col("n_chars") % 3 == 2, '[1, "a", {}]')
    return t.documents.select("doc_id", F.length("text").alias("n_text"), F.coalesce(F.json_array_length(listed), F.lit(0)).alias("n_tests"))


@query("a163_normalized_dataset", "SELECT item_id::VARCHAR AS sample_id, text AS question, a AS answer, CASE WHEN try_cast(a AS BIGINT) IS NULL THEN 'not_integer' WHEN NOT try_cast(a AS BIGINT) BETWEEN 0 AND 999 THEN 'out_of_range' END AS fault FROM (SELECT *, CASE WHEN item_id % 5 = 0 THEN 'x' || item_id ELSE (item_id * 97)::VARCHAR END AS a FROM benchmark)")
def a163(t: Tables) -> DataFrame:
    """Half of the items in the one naming of columns, half in the other."""
    answer = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("x"), F.col("item_id").cast("string"))).otherwise(F.concat(F.lit(" "), (F.col("item_id") * 97).cast("string")))
    one = t.benchmark.filter("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.col("text").alias("problem"), answer.alias("answer"))
    two = t.benchmark.filter("item_id % 2 = 1").select(F.col("item_id").alias("ID"), F.col("text").alias("Problem"), answer.alias("Answer"))
    return E.normalized_dataset(one).unionByName(E.normalized_dataset(two))


@query("a164_confusion", "SELECT CASE WHEN (quality = 1) = (toxic = 0) THEN 'agree' WHEN quality = 1 THEN 'false_negative' ELSE 'false_positive' END AS label, count(*) AS n FROM labels GROUP BY 1")
def a164(t: Tables) -> DataFrame:
    return E.confusion(t.labels.select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("got"))).groupBy("label").agg(F.count("*").alias("n"))


@query("a165_rescue_targets", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND contains(o_orderpriority, 'HIGH')")
def a165(t: Tables) -> DataFrame:
    """Unresolved ones among the candidates, of those that a part of a name selects."""
    unresolved = t.orders.filter("o_orderstatus = 'O'").filter(F.contains("o_orderpriority", F.lit("HIGH"))).select("o_orderkey")
    return unresolved.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("a170_loaded_retrieval", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'lib/x.py' ELSE p_brand END AS file, CASE WHEN p_partkey % 3 = 0 THEN 'run_' || p_partkey ELSE p_name END AS name FROM part")
def a170(t: Tables) -> DataFrame:
    """Retrieved entries with the store's data; every third is not in the store and is read from its text."""
    inject = F.concat(F.lit("## method: C.run_"), F.col("p_partkey").cast("string"), F.lit("(self)\n- Location: lib/x.py:1-9\n- Type: method"))
    known = t.part.filter("p_partkey % 3 > 0").select("p_partkey", F.col("p_brand").alias("file"), F.col("p_name").alias("name"))
    told = t.part.select("p_partkey", T.inject_fields(inject).alias("f")).join(known, "p_partkey", "left")
    return told.select("p_partkey", F.coalesce("file", "f.file").alias("file"), F.coalesce("name", "f.name").alias("name"))


@query("a172_in_order", "SELECT o_orderkey - 1 AS pos, o_orderkey * 3 AS id, o_orderkey * 3 IN (SELECT p_partkey FROM part) AS known, (SELECT p_name FROM part WHERE p_partkey = o_orderkey * 3) AS name FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)")
def a172(t: Tables) -> DataFrame:
    wanted = t.orders.join(t.customer, F.col("o_orderkey") == F.col("c_custkey"), "left_semi").select((F.col("o_orderkey") - 1).alias("pos"), (F.col("o_orderkey") * 3).alias("id"))
    return E.in_order(wanted, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("a173_minimal_tasks", "SELECT conv_id AS task_id, coalesce(max(text) FILTER (WHERE turn = 0), '') AS question, coalesce(max(role) FILTER (WHERE turn = 1), 'none') AS answered_by FROM conversations GROUP BY 1")
def a173(t: Tables) -> DataFrame:
    first = lambda n, c, other: F.coalesce(F.max(F.when(F.col("turn") == n, F.col(c))), F.lit(other))
    return t.conversations.groupBy(F.col("conv_id").alias("task_id")).agg(first(0, "text", "").alias("question"), first(1, "role", "none").alias("answered_by"))


@query("a179_dispatched", "SELECT 'document' AS kind, doc_id AS sample_id, text AS question FROM documents UNION ALL SELECT 'passage', item_id, text FROM benchmark UNION ALL SELECT 'page', page_id, html FROM pages")
def a179(t: Tables) -> DataFrame:
    keys = {"document": (t.documents, "doc_id", "text"), "passage": (t.benchmark, "item_id", "text"), "page": (t.pages, "page_id", "html")}
    return graph.union_all([df.select(F.lit(kind).alias("kind"), F.col(k).alias("sample_id"), F.col(q).alias("question")) for kind, (df, k, q) in keys.items()])


_CACHE = f"""WITH {bm25_sql()}, every AS (SELECT 'bm25' AS condition, query_id, id, rank FROM ({_TOP.format(3)}) UNION ALL SELECT 'selected', query_id, id, rank FROM ({_chosen_sql(3, 4)})),
tasks AS (SELECT query_id, c AS condition FROM queries, (VALUES ('bm25'), ('selected'), ('null')) v(c))"""


def _cache(t: Tables) -> DataFrame:
    nodes = t.documents.select(F.col("doc_id").cast("string").alias("id"))
    each = _chosen(t, 3).select("query_id", F.posexplode("ids").alias("pos", "id")).join(nodes, "id", "left_semi").select("query_id", "id", (F.col("pos") + 1).alias("rank"))
    return E.cached_retrieval(_queries(t), {"bm25": bm25.retrieve(_index(t), _queries(t), 3), "selected": each, "null": bm25.retrieve_nothing(_queries(t))})


@query("a180_cached_retrieval", f"{_CACHE} SELECT t.query_id, t.condition, coalesce(string_agg(e.id::VARCHAR, ',' ORDER BY rank), '') AS ids FROM tasks t LEFT JOIN every e ON e.query_id = t.query_id AND e.condition = t.condition GROUP BY 1, 2")
def a180(t: Tables) -> DataFrame:
    return _cache(t).select("query_id", "condition", F.array_join("ids", ",").alias("ids"))


@query(
    "a181_prompts",
    f"""{_CACHE}, used AS (SELECT e.query_id, e.condition, e.rank, d.text FROM every e JOIN documents d ON d.doc_id = e.id WHERE d.doc_id % 5 > 0)
SELECT t.query_id, t.condition, count(u.rank) AS n_used, concat_ws(chr(10) || chr(10), string_agg(u.text, chr(10) || chr(10) ORDER BY u.rank), any_value(q.text)) AS prompt FROM tasks t JOIN queries q USING (query_id) LEFT JOIN used u ON u.query_id = t.query_id AND u.condition = t.condition GROUP BY 1, 2""",
)
def a181(t: Tables) -> DataFrame:
    """Every fifth document is no longer a node: its id is passed over."""
    nodes = t.documents.filter("doc_id % 5 > 0").select(F.col("doc_id").alias("id"), "text")
    return E.prompts(_cache(t), _queries(t).withColumnRenamed("text", "question"), nodes)


@query(
    "a155_grid_sweep",
    """WITH r AS (SELECT o_custkey % 100 AS query_id, o_orderpriority AS setting, o_orderstatus AS repo, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 40 END AS rank FROM orders), e AS (SELECT r.*, k FROM r, (VALUES (1), (3), (10), (30)) g(k)),
out AS (SELECT setting, k, NULL AS repo, count(*) FILTER (WHERE rank <= k) AS n_hit, count(*) AS n, true AS every FROM e GROUP BY 1, 2 UNION ALL SELECT setting, k, repo, count(*) FILTER (WHERE rank <= k), count(*), false FROM e GROUP BY 1, 2, 3)
SELECT setting, k, repo, n_hit, n, round(n_hit / n, 3) AS hit_rate, every AND round(n_hit / n, 3) = (SELECT max(round(n_hit / n, 3)) FROM out WHERE every) AS best FROM out""",
)
def a155_grid(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("setting"), F.col("o_orderstatus").alias("repo"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey") % 40).alias("rank"))
    return E.grid_sweep(rows, [1, 3, 10, 30], "repo")
