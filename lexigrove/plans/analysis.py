"""Evaluation queries: labels stand for experiment records, orders for samples under conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import bm25, evaluation as E
from lexigrove.plans.registry import Tables, query
from lexigrove.plans.retrieval import _index, _queries, bm25_sql
from lexigrove.sources.scratch import cut

_PAIRS = "pairs AS (SELECT doc_id AS sample_id, quality AS base, toxic AS treated, toxic - quality AS delta FROM labels)"


def records(t: Tables) -> DataFrame:
    """Two conditions a sample: right by quality, right by toxicity."""
    one = lambda name, c: t.labels.select(F.col("doc_id").alias("sample_id"), F.lit(name).alias("condition"), (F.col(c) == 1).alias("is_correct"))
    return one("base", "quality").unionByName(one("rag", "toxic"))


@query("a140_pair_pivot", f"WITH {_PAIRS} SELECT sample_id, base, treated, delta FROM pairs")
def a140(t: Tables) -> DataFrame:
    return E.paired(records(t), "base", "rag")


@query(
    "a141_paired",
    f"WITH {_PAIRS} SELECT count(*) AS n_pairs, round(avg(base), 9) AS base_accuracy, round(avg(treated), 9) AS treated_accuracy, round(avg(delta), 9) AS mean_delta, count(*) FILTER (WHERE delta = 1) AS n_saved, count(*) FILTER (WHERE delta = -1) AS n_degraded FROM pairs",
)
def a141(t: Tables) -> DataFrame:
    s = E.paired_summary(E.paired(records(t), "base", "rag"))
    return s.select("n_pairs", *(F.round(c, 9).alias(c) for c in ("base_accuracy", "treated_accuracy", "mean_delta")), "n_saved", "n_degraded")


@query("a142_bootstrap")
def a142(t: Tables) -> DataFrame:
    return E.bootstrap(E.paired(records(t), "base", "rag"))


@query(
    "a142_bootstrap_normal",
    """WITH pairs AS (SELECT toxic - quality AS delta FROM labels), m AS (SELECT count(*) AS n, stddev_pop(delta) AS sd FROM pairs)
SELECT 10000::BIGINT AS draws, true AS low_near, true AS high_near FROM m WHERE n > 0 AND sd > 0""",
)
def a142_normal(t: Tables) -> DataFrame:
    """The drawn interval against the normal one, of which it may stray by a fifth of a standard error."""
    pairs = E.paired(records(t), "base", "rag")
    told = pairs.agg(F.avg("delta").alias("mean"), (F.stddev_pop("delta") / F.sqrt(F.count("*"))).alias("se")).filter("se > 0")
    near = lambda end, z: F.abs(F.col(end) - (F.col("mean") + z * F.col("se"))) <= F.col("se") / 5
    return E.bootstrap(pairs).crossJoin(F.broadcast(told)).select("draws", near("low", -1.959964).alias("low_near"), near("high", 1.959964).alias("high_near"))


@query(
    "a143_sign_flip",
    """WITH pairs AS (SELECT toxic - quality AS delta FROM labels), m AS (SELECT sum(abs(delta))::BIGINT AS m, sum(delta)::BIGINT AS net FROM pairs),
terms AS (SELECT i, m, net, lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2) AS l FROM (SELECT m, net, unnest(range(0, m + 1)) AS i FROM m))
SELECT any_value(m) AS m, any_value(net) AS net, least(1.0, round(sum(CASE WHEN abs(2 * i - m) >= abs(net) THEN exp(l) ELSE 0 END), 6)) AS p_value FROM terms""",
)
def a143(t: Tables) -> DataFrame:
    return E.sign_flip(E.paired(records(t), "base", "rag")).withColumn("p_value", F.round("p_value", 6))


_RUNS = """runs AS (SELECT o_custkey AS sample_id, o_orderpriority AS condition, o_orderstatus = 'F' AS is_correct, CASE WHEN o_totalprice > 300000 THEN 'inside_truncated' ELSE 'ok' END AS status,
  trunc(o_totalprice / 10)::BIGINT AS token_count, CAST(o_orderkey % 7 AS VARCHAR) AS pred_answer, o_orderkey FROM orders),
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY sample_id, condition ORDER BY o_orderkey DESC) = 1)"""


def runs(t: Tables) -> DataFrame:
    """Orders as runs: customers are samples, priorities are conditions."""
    rows = t.orders.select(
        F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("condition"), (F.col("o_orderstatus") == "F").alias("is_correct"),
        F.when(F.col("o_totalprice") > 300_000, "inside_truncated").otherwise("ok").alias("status"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("token_count"),
        (F.col("o_orderkey") % 7).cast("string").alias("pred_answer"), "o_orderkey",
    )
    return E.last_records(rows, "o_orderkey")


@query("a144_truncation", f"WITH {_RUNS} SELECT condition, count(*) FILTER (WHERE status = 'inside_truncated' OR token_count >= 16384) AS n_truncated, count(*) AS n, round(count(*) FILTER (WHERE status = 'inside_truncated' OR token_count >= 16384) / count(*), 9) AS rate FROM last GROUP BY condition")
def a144(t: Tables) -> DataFrame:
    return E.truncation_rates(runs(t)).withColumn("rate", F.round("rate", 9))


@query("a145_token_stats", f"WITH {_RUNS} SELECT condition, is_correct, count(*) AS n, round(avg(token_count), 4) AS avg_tokens, list_sort(list(token_count))[len(list(token_count)) // 2 + 1] AS median_tokens FROM last GROUP BY ALL")
def a145(t: Tables) -> DataFrame:
    return E.token_stats(runs(t)).withColumn("avg_tokens", F.round("avg_tokens", 4))


@query(
    "a146_triage",
    f"""WITH {_RUNS}, by_sample AS (SELECT sample_id, max(is_correct::INT) FILTER (WHERE condition = '1-URGENT') AS base, coalesce(sum(is_correct::INT) FILTER (WHERE condition <> '1-URGENT'), 0) AS n_right,
  count(*) FILTER (WHERE condition <> '1-URGENT') AS n_other, count(*) AS n, count(DISTINCT pred_answer) AS n_answers, count(*) FILTER (WHERE status = 'inside_truncated') AS n_cut FROM last GROUP BY sample_id)
SELECT sample_id, category FROM (SELECT sample_id, CASE WHEN base = 1 THEN CASE WHEN n_right = n_other THEN NULL WHEN n_right = 0 THEN 'baseline_correct_only' ELSE 'baseline_correct_some_degraded' END
  ELSE CASE WHEN n_right > 0 THEN 'rag_saved' WHEN n_cut * 2 >= n THEN 'mostly_truncated' WHEN n_answers = 1 THEN 'consistent_wrong' WHEN n_answers >= 4 THEN 'divergent' ELSE 'mixed_wrong' END END AS category
  FROM by_sample WHERE base IS NOT NULL) WHERE category IS NOT NULL""",
)
def a146(t: Tables) -> DataFrame:
    return E.triage(runs(t), "1-URGENT")


@query("a147_accuracy", f"WITH {_RUNS} SELECT condition, count(*) AS n, round(avg(is_correct::INT), 9) AS accuracy, round(avg(token_count), 4) AS avg_tokens FROM last GROUP BY condition")
def a147(t: Tables) -> DataFrame:
    return runs(t).groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_correct").cast("int")), 9).alias("accuracy"), F.round(F.avg("token_count"), 4).alias("avg_tokens"))


@query(
    "a148_saved_degraded",
    f"WITH {_RUNS}, base AS (SELECT sample_id, is_correct AS b FROM last WHERE condition = '1-URGENT') SELECT condition, count(*) FILTER (WHERE is_correct AND NOT b) AS saved, count(*) FILTER (WHERE b AND NOT is_correct) AS degraded, count(*) FILTER (WHERE is_correct AND NOT b) - count(*) FILTER (WHERE b AND NOT is_correct) AS net FROM last JOIN base USING (sample_id) WHERE condition <> '1-URGENT' GROUP BY condition",
)
def a148(t: Tables) -> DataFrame:
    rows = runs(t)
    base = rows.filter("condition = '1-URGENT'").select("sample_id", F.col("is_correct").alias("b"))
    both = rows.filter("condition <> '1-URGENT'").join(base, "sample_id")
    out = both.groupBy("condition").agg(F.count_if(F.col("is_correct") & ~F.col("b")).alias("saved"), F.count_if(F.col("b") & ~F.col("is_correct")).alias("degraded"))
    return out.withColumn("net", F.col("saved") - F.col("degraded"))


@query("a149_difficulty", "SELECT doc_id, CASE WHEN n_chars <= 500 AND length(text) <= 2000 AND doc_id % 5 BETWEEN 1 AND 2 THEN 'easy' WHEN n_chars > 500 AND n_chars <= 1500 AND length(text) BETWEEN 1500 AND 3000 AND doc_id % 5 BETWEEN 1 AND 3 THEN 'medium' WHEN n_chars > 1500 AND length(text) > 2000 AND doc_id % 5 >= 2 THEN 'hard' ELSE 'other' END AS level FROM documents")
def a149(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", E.difficulty(F.col("n_chars"), F.length("text"), F.col("doc_id") % 5).alias("level"))


@query("a151_top_per_stratum", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 5")
def a151(t: Tables) -> DataFrame:
    return E.top_per_stratum(t.documents, "lang", [F.col("n_chars").desc(), F.col("doc_id")], 5).select("lang", "doc_id", "rank")


@query(
    "a152_balanced_sample",
    """WITH rows AS (SELECT doc_id, source, CASE WHEN n_chars <= 500 THEN 'easy' WHEN n_chars <= 3000 THEN 'medium' ELSE 'hard' END AS level FROM documents),
quota AS (SELECT source, 50 // count(*) OVER () + (row_number() OVER (ORDER BY source) - 1 < 50 % count(*) OVER ())::INT AS quota FROM (SELECT DISTINCT source FROM rows)),
turns AS (SELECT *, row_number() OVER (PARTITION BY source, level ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS turn, list_position(['easy', 'medium', 'hard'], level) AS place FROM rows),
picks AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, place)::INT AS pick FROM turns)
SELECT source, level, doc_id, pick FROM picks JOIN quota USING (source) WHERE pick <= quota""",
)
def a152(t: Tables) -> DataFrame:
    level = F.when(F.col("n_chars") <= 500, "easy").when(F.col("n_chars") <= 3000, "medium").otherwise("hard")
    rows = t.documents.select("doc_id", "source", level.alias("level"))
    return E.balanced_sample(rows, "source", "level", "doc_id", 50, ("easy", "medium", "hard")).select("source", "level", "doc_id", "pick")


_RANKED = f"WITH {bm25_sql()}, ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scores WHERE score > 0), oracle AS (SELECT item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _oracle_ranks(t: Tables) -> DataFrame:
    """(query_id, id, rank) of the documents that hold a passage, in the passage's own retrieval."""
    return bm25.rank_of(cut(bm25.scores(_index(t), _queries(t)), "scores"), _containing(t))


def _containing(t: Tables) -> DataFrame:
    """(query_id, id) of documents that hold a whole benchmark passage: joined on three of its words, then compared."""
    items = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("key"))
    words = t.documents.select(F.col("doc_id").alias("id"), "text", F.split("text", r"[ ]", -1).alias("w"))
    keyed = words.select("id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.array_join(F.slice("w", i, 3), " ")))).alias("key"))
    return items.join(keyed, "key").filter(F.contains("text", "passage")).select("query_id", "id").distinct()


@query("a153_hit_type", f"{_RANKED} SELECT q.query_id, min(r.rank) AS first_rank, CASE WHEN min(r.rank) <= 3 THEN 'func_hit' WHEN min(r.rank) <= 30 THEN 'file_only' ELSE 'miss' END AS hit FROM queries q LEFT JOIN oracle o USING (query_id) LEFT JOIN ranked r ON r.query_id = o.query_id AND r.id = o.id GROUP BY q.query_id")
def a153(t: Tables) -> DataFrame:
    first = t.benchmark.select(F.col("item_id").alias("query_id")).join(_oracle_ranks(t), "query_id", "left").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return first.withColumn("hit", F.when(F.col("first_rank") <= 3, "func_hit").when(F.col("first_rank") <= 30, "file_only").otherwise("miss"))


@query("a156_full_rank", f"{_RANKED} SELECT query_id, min(rank) AS oracle_rank, count(*) AS n_found FROM oracle JOIN ranked USING (query_id, id) GROUP BY query_id")
def a156(t: Tables) -> DataFrame:
    return _oracle_ranks(t).groupBy("query_id").agg(F.min("rank").alias("oracle_rank"), F.count("*").alias("n_found"))


@query("a159_histogram", f"{_RANKED}, first AS (SELECT query_id, min(rank) AS rank FROM oracle JOIN ranked USING (query_id, id) GROUP BY query_id) SELECT CASE WHEN rank <= 3 THEN '1-3' WHEN rank <= 10 THEN '4-10' WHEN rank <= 30 THEN '11-30' WHEN rank <= 100 THEN '31-100' ELSE '100+' END AS bucket, count(*) AS n FROM first GROUP BY 1")
def a159(t: Tables) -> DataFrame:
    first = _oracle_ranks(t).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return first.groupBy(E.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count("*").alias("n"))


@query("a155_sweep", f"{_RANKED}, first AS (SELECT q.query_id, min(r.rank) AS rank FROM queries q LEFT JOIN oracle o USING (query_id) LEFT JOIN ranked r ON r.query_id = o.query_id AND r.id = o.id GROUP BY 1), out AS (SELECT k, count(*) FILTER (WHERE rank <= k) AS n_hit, count(*) AS n, round(count(*) FILTER (WHERE rank <= k) / count(*), 3) AS hit_rate FROM first, (VALUES (1), (3), (5), (10), (30)) g(k) GROUP BY k) SELECT *, hit_rate = max(hit_rate) OVER () AS best FROM out")
def a155(t: Tables) -> DataFrame:
    first = t.benchmark.select(F.col("item_id").alias("query_id")).join(_oracle_ranks(t), "query_id", "left").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return E.sweep(first, [1, 3, 5, 10, 30])


@query(
    "a160_mislocalized",
    "SELECT o.o_orderkey, CASE WHEN count(l.l_suppkey) = 0 THEN NULL ELSE NOT bool_or(s.s_nationkey = c.c_nationkey) END AS mislocalized FROM orders o JOIN customer c ON c_custkey = o_custkey "
    "LEFT JOIN lineitem l ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN supplier s ON s_suppkey = l_suppkey GROUP BY o.o_orderkey",
)
def a160(t: Tables) -> DataFrame:
    """Targets are the nations of an order's returned lines, the oracle is its customer's nation; unknown without targets."""
    targets = t.lineitem.filter("l_returnflag = 'R'").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_set("s_nationkey").alias("targets"))
    oracle = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.array("c_nationkey").alias("oracle"))
    return oracle.join(targets, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", E.mislocalized(F.col("targets"), F.col("oracle")).alias("mislocalized"))


@query("a161_pipeline_summary", "SELECT o_orderpriority AS difficulty, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a161(t: Tables) -> DataFrame:
    out = t.orders.groupBy(F.col("o_orderpriority").alias("difficulty")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("difficulty", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@query("a162_ceiling", "SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0")
def a162(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.filter("quality = 0"), "doc_id", "left_semi").select("doc_id", "source")


_COST = "usage AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'large' ELSE 'small' END AS model, length(text) AS tokens_in, length(text) * 2 AS tokens_out FROM conversations), prices AS (SELECT * FROM (VALUES ('large', 3.0, 15.0), ('small', 1.0, 5.0)) p(model, price_in, price_out))"


@query("a168_cost", f"WITH {_COST} SELECT model, round(sum(tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6), 6) AS cost FROM usage JOIN prices USING (model) GROUP BY model")
def a168(t: Tables) -> DataFrame:
    return _costs(t).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


def _costs(t: Tables) -> DataFrame:
    usage = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "assistant", "large").otherwise("small").alias("model"), F.length("text").alias("tokens_in"), (F.length("text") * 2).alias("tokens_out"))
    prices = t.spark.createDataFrame([("large", 3.0, 15.0), ("small", 1.0, 5.0)], "model string, price_in double, price_out double")
    return E.api_cost(usage, prices)


@query("a168_budget", f"WITH {_COST} SELECT conv_id, turn, sum(tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 0.02 AS allowed FROM usage JOIN prices USING (model)")
def a168_budget(t: Tables) -> DataFrame:
    return E.within_budget(_costs(t), "conv_id", ["turn"], 0.02).select("conv_id", "turn", "allowed")


@query("a69_code_blocks", "SELECT doc_id, text AS code FROM documents")
def a69(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("First ```python\nno\n``` then ```python\n"), "text", F.lit("``` done"))
    return t.documents.select("doc_id", T.last_code_block(answer).alias("code"))


@query("a70_clean_response", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM documents")
def a70(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clean_response(F.concat(F.lit("<think>hm</think>  "), "text")).alias("answer"))
