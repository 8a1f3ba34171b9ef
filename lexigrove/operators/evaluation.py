"""Evaluation of experiments: pairing, triage, statistics, sampling, hits, costs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.frames import over
from lexigrove.operators.scans import Parts, numbered


def last_records(records: DataFrame, order: str) -> DataFrame:
    """One record a (sample_id, condition): the last by ``order``."""
    w = Window.partitionBy("sample_id", "condition").orderBy(F.col(order).desc())
    return records.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def paired(records: DataFrame, baseline: str, treatment: str) -> DataFrame:
    """(sample_id, base, treated, delta) of samples that have both conditions."""
    by = records.groupBy("sample_id").agg(
        F.max(F.when(F.col("condition") == baseline, F.col("is_correct").cast("int"))).alias("base"),
        F.max(F.when(F.col("condition") == treatment, F.col("is_correct").cast("int"))).alias("treated"),
    )
    return by.filter("base is not null and treated is not null").withColumn("delta", F.col("treated") - F.col("base"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """Counts and accuracies of a paired comparison."""
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.avg("base").alias("base_accuracy"), F.avg("treated").alias("treated_accuracy"), F.avg("delta").alias("mean_delta"),
        F.coalesce(F.sum((F.col("delta") == 1).cast("long")), F.lit(0)).alias("n_saved"), F.coalesce(F.sum((F.col("delta") == -1).cast("long")), F.lit(0)).alias("n_degraded"),
    )


def sign_flip(pairs: DataFrame) -> DataFrame:
    """Exact two-sided sign-flip p-value over the non-zero deltas: (m, net, p_value).

    Flipping signs of m deltas of size 1 is a binomial walk, so the value is
    twice a binomial tail. Its largest term comes from log factorials, the
    others from the ratio of neighbours, so the work is linear in m.
    """
    counted = pairs.agg(F.coalesce(F.sum(F.abs("delta")), F.lit(0)).cast("long").alias("m"), F.coalesce(F.sum("delta"), F.lit(0)).cast("long").alias("net"))

    def tail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from math import exp, lgamma, log

        for frame in frames:
            found = []
            for m, net in zip(frame["m"].tolist(), frame["net"].tolist(), strict=True):
                i = (m - abs(net)) // 2
                term = exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * log(2))
                total = 0.0
                while i >= 0 and term > 0:
                    total += term
                    term *= i / (m - i + 1)
                    i -= 1
                found.append(min(1.0, round(2 * total, 9)) if net else 1.0)
            yield frame.assign(p_value=found)

    return counted.mapInPandas(tail, "m long, net long, p_value double")


def bootstrap(pairs: DataFrame, draws: int = 10_000, alpha: float = 0.025, seed: int = 42, tasks: int = 8) -> DataFrame:
    """Percentile interval of the mean delta: (mean_delta, low, high).

    Draws resample counts: the three outcomes (-1, 0, 1) of n pairs are a
    multinomial, so only their counts leave the executors' aggregation.
    """
    counts = pairs.agg(*(F.coalesce(F.sum((F.col("delta") == d).cast("long")), F.lit(0)).alias(f"n{i}") for i, d in enumerate((-1, 0, 1))))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for row in frame.itertuples(index=False):
                n = row.n0 + row.n1 + row.n2
                if not n:
                    continue
                rng = np.random.Generator(np.random.PCG64([seed, int(row.part)]))
                found = rng.multinomial(n, [row.n0 / n, row.n1 / n, row.n2 / n], -(-draws // tasks))
                yield pd.DataFrame({"mean": (found[:, 2] - found[:, 0]) / n})

    parts = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))
    means = parts.mapInPandas(draw, "mean double")
    ordered = F.array_sort(F.collect_list("mean"))
    held = means.agg(ordered.alias("x"), F.count("*").alias("n"))
    at = lambda share: F.element_at("x", F.least(F.floor(F.lit(share) * F.col("n")).cast("int"), (F.col("n") - 1).cast("int")) + 1)
    return held.filter("n > 0").select(at(alpha).alias("low"), at(1 - alpha).alias("high"), F.col("n").alias("draws"))


def truncation_rates(records: DataFrame, limit: int = 16_384) -> DataFrame:
    """(condition, n_truncated, n, rate)."""
    cut = (F.coalesce(F.col("status") == "inside_truncated", F.lit(False)) | (F.coalesce("token_count", F.lit(0)) >= limit)).cast("long")
    return records.groupBy("condition").agg(F.sum(cut).alias("n_truncated"), F.count("*").alias("n"), F.avg(cut).alias("rate"))


def token_stats(records: DataFrame) -> DataFrame:
    """(condition, is_correct, n, avg_tokens, median_tokens), the upper median.

    Records are counted by value, and the counts summed in the order of the
    values; no group, however large, is put in order or collected.
    """
    by, value = ["condition", "is_correct"], "token_count"
    counts = records.groupBy(*by, value).agg(F.count("*").alias("c"))
    sums = Parts(counts, by, [value]).running(upto=("sum", F.col("c")))
    whole = over(sums, by, n=F.sum("c"))
    middle = F.max(F.when((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2)), F.col(value)))
    return whole.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), F.col("c")))).alias("avg_tokens"), middle.alias("median_tokens"))


def triage(records: DataFrame, baseline: str) -> DataFrame:
    """(sample_id, category) of samples with a baseline record; samples that all conditions solve have none.

    Baseline right: baseline_correct_only if all others fail, else
    baseline_correct_some_degraded. Baseline wrong, first that holds:
    rag_saved, mostly_truncated (half or more), consistent_wrong (one distinct
    answer), divergent (four or more), mixed_wrong.
    """
    base, right = F.col("condition") == baseline, F.col("is_correct").cast("int")
    answer = F.when(F.col("pred_answer") != "", F.col("pred_answer"))
    by = records.groupBy("sample_id").agg(
        F.max(F.when(base, right)).alias("base"), F.coalesce(F.sum(F.when(~base, right)), F.lit(0)).alias("n_right"), F.count(F.when(~base, 1)).alias("n_other"),
        F.count("*").alias("n"), F.count_distinct(answer).alias("n_answers"), F.sum((F.coalesce("status", F.lit("")) == "inside_truncated").cast("long")).alias("n_cut"),
    )
    solved = F.when(F.col("n_right") == F.col("n_other"), None).when(F.col("n_right") == 0, "baseline_correct_only").otherwise("baseline_correct_some_degraded")
    failed = (
        F.when(F.col("n_right") > 0, "rag_saved").when(F.col("n_cut") * 2 >= F.col("n"), "mostly_truncated")
        .when(F.col("n_answers") == 1, "consistent_wrong").when(F.col("n_answers") >= 4, "divergent").otherwise("mixed_wrong")
    )
    return by.filter("base is not null").select("sample_id", F.when(F.col("base") == 1, solved).otherwise(failed).alias("category")).filter("category is not null")


def difficulty(patch_size: Column, problem_size: Column, n_fail: Column) -> Column:
    """easy, medium, hard or other, by sizes and the number of failing tests."""
    return (
        F.when((patch_size <= 500) & (problem_size <= 2000) & n_fail.between(1, 2), "easy")
        .when((patch_size > 500) & (patch_size <= 1500) & problem_size.between(1500, 3000) & n_fail.between(1, 3), "medium")
        .when((patch_size > 1500) & (problem_size > 2000) & (n_fail >= 2), "hard").otherwise("other")
    )


def top_per_stratum(rows: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def shuffle_key(key: Column, factor: int = 2_654_435_761) -> Column:
    """A fixed pseudo-random order of integer keys that any engine can compute."""
    return (key * F.lit(factor)) % F.lit(2**32)


def balanced_sample(rows: DataFrame, group: str, level: str, key: str, total: int, levels: tuple[str, ...]) -> DataFrame:
    """A quota a group (the first groups by name get one more), dealt level by level in turn: rows with ``pick``."""
    groups = numbered(rows.select(group).distinct(), [group], "g")
    n = groups.agg(F.count("*").alias("n_groups"))
    quota = groups.crossJoin(F.broadcast(n)).select(group, (F.floor(F.lit(total) / F.col("n_groups")) + (F.col("g") < F.lit(total) % F.col("n_groups")).cast("int")).alias("quota"))
    place = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    turn = F.row_number().over(Window.partitionBy(group, level).orderBy(shuffle_key(F.col(key)), F.col(key)))
    # A pick is no sooner than its turn, so later turns than the total are cut where the rows are.
    ranked = rows.filter(F.col(level).isin(*levels)).withColumn("turn", turn).filter(F.col("turn") <= total)
    pick = F.row_number().over(Window.partitionBy(group).orderBy("turn", place))
    return ranked.withColumn("pick", pick).join(quota, group).filter(F.col("pick") <= F.col("quota")).drop("turn", "quota")


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 3, "1-3").when(rank <= 10, "4-10").when(rank <= 30, "11-30").when(rank <= 100, "31-100").otherwise("100+")


def hit_type(ranked: DataFrame, file_hit: Column, func_hit: Column) -> DataFrame:
    """(query_id, file_rank, func_rank, hit): func_hit before file_only before miss."""
    found = ranked.groupBy("query_id").agg(F.min(F.when(file_hit, F.col("rank"))).alias("file_rank"), F.min(F.when(func_hit, F.col("rank"))).alias("func_rank"))
    return found.withColumn("hit", F.when(F.col("func_rank").isNotNull(), "func_hit").when(F.col("file_rank").isNotNull(), "file_only").otherwise("miss"))


def sweep(first_ranks: DataFrame, grid: list[int]) -> DataFrame:
    """(k, n_hit, n, hit_rate, best) for each cut-off of a grid over (query_id, first_rank)."""
    ks = F.explode(F.array(*map(F.lit, grid)))
    out = first_ranks.select("first_rank", ks.alias("k")).groupBy("k").agg(
        F.sum(F.coalesce((F.col("first_rank") <= F.col("k")).cast("long"), F.lit(0))).alias("n_hit"), F.count("*").alias("n"))
    out = out.withColumn("hit_rate", F.round(F.col("n_hit") / F.col("n"), 3))
    return out.withColumn("best", F.col("hit_rate") == F.max("hit_rate").over(Window.partitionBy()))


def api_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, tokens_in, tokens_out) with the cost by (model, price_in, price_out) a million tokens.

    The price list is small by nature; its broadcast is left to its size.
    """
    return usage.join(prices, "model", "left").withColumn("cost", F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6)


def within_budget(costs: DataFrame, group: str, order: list[str], budget: float) -> DataFrame:
    """Running cost of each group and whether the row is still within the budget."""
    running = F.sum("cost").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("running", running).withColumn("allowed", F.col("running") <= budget)


def mislocalized(targets: Column, oracle: Column) -> Column:
    """No target is among the oracle; null where either is unknown."""
    return F.when(targets.isNotNull() & oracle.isNotNull(), ~F.arrays_overlap(targets, oracle))


def strict_hit(retrieved: DataFrame, oracle: DataFrame) -> DataFrame:
    """(query_id, func_rank, file_rank, hit): a function counts only in a file of the oracle.

    ``retrieved`` gives (query_id, rank, name, file), ``oracle`` (query_id,
    names, files); a file matches if one of the two paths holds the other.
    """
    same = lambda f: F.contains(F.col("file"), f) | F.contains(f, F.col("file"))
    in_file = (F.coalesce(F.col("file"), F.lit("")) != "") & F.exists("files", same)
    found = oracle.join(retrieved, "query_id", "left").withColumn("in_file", F.coalesce(in_file, F.lit(False)))
    ranks = found.groupBy("query_id").agg(F.min(F.when(F.col("in_file") & F.array_contains("names", F.col("name")), F.col("rank"))).alias("func_rank"), F.min(F.when(F.col("in_file"), F.col("rank"))).alias("file_rank"))
    return ranks.withColumn("hit", F.when(F.col("func_rank").isNotNull(), "func_hit").when(F.col("file_rank").isNotNull(), "file_only").otherwise("miss"))


def file_hits(retrieved: DataFrame, oracle: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, n_hits) of the top ``k`` whose file holds the name of an oracle file."""
    hit = F.exists("files", lambda f: F.contains(F.col("file"), f))
    top = retrieved.filter(F.col("rank") <= k)
    return oracle.join(top, "query_id", "left").groupBy("query_id").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("n_hits"))


def rank_delta(base: DataFrame, treated: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, base_rank, treated_rank, delta, change): how far the oracle moves between two retrievals of (query_id, rank)."""
    both = base.select("query_id", F.col("rank").alias("base_rank")).join(treated.select("query_id", F.col("rank").alias("treated_rank")), "query_id", "full")
    delta = F.col("base_rank") - F.col("treated_rank")
    change = F.when(F.col("base_rank").isNull(), "found").when(F.col("treated_rank").isNull(), "lost").when(delta > 0, "up").when(delta < 0, "down").otherwise("same")
    return both.withColumns({"delta": delta, "change": change, "base_top": F.coalesce(F.col("base_rank") <= top, F.lit(False)), "treated_top": F.coalesce(F.col("treated_rank") <= top, F.lit(False))})


def normalized_dataset(rows: DataFrame, low: int = 0, high: int = 999) -> DataFrame:
    """(sample_id, question, answer, fault) of rows in either of two namings: (id, problem, answer) or (ID, Problem, Answer).

    ``fault`` says that an answer is no integer or is out of range; the row stays.
    """
    named = {c.lower(): c for c in rows.columns}
    missing = [c for c in ("id", "problem", "answer") if c not in named]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(rows.columns)}")
    answer = F.trim(F.col(named["answer"]).cast("string"))
    number = F.expr(f"try_cast(trim(cast(`{named['answer']}` as string)) as bigint)")
    fault = F.when(number.isNull(), "not_integer").when(~number.between(low, high), "out_of_range")
    return rows.select(F.col(named["id"]).cast("string").alias("sample_id"), F.col(named["problem"]).alias("question"), answer.alias("answer"), fault.alias("fault"))


def confusion(rows: DataFrame) -> DataFrame:
    """Rows (expected, got) of an evaluator's trial with their label: agree, false_negative or false_positive."""
    return rows.withColumn("label", F.when(F.col("expected") == F.col("got"), "agree").when(F.col("expected"), "false_negative").otherwise("false_positive"))


def in_order(wanted: DataFrame, tasks: DataFrame, key: str = "id") -> DataFrame:
    """(pos, key, known, ...) of the tasks of a list of ids, in its order; ids without a task stay, with ``known`` false."""
    return wanted.join(tasks.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def cached_retrieval(tasks: DataFrame, by_condition: dict[str, DataFrame]) -> DataFrame:
    """(query_id, condition, ids) of every task under every condition: the ids in rank order, empty where nothing is found."""
    rows = [df.select("query_id", F.lit(name).alias("condition"), F.col("id").cast("string").alias("id"), "rank") for name, df in by_condition.items()]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    lists = found.groupBy("query_id", "condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    every = tasks.select("query_id", F.explode(F.array(*map(F.lit, by_condition))).alias("condition"))
    return every.join(lists, ["query_id", "condition"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def prompts(cache: DataFrame, tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, condition, n_used, prompt): the texts of the cached ids in order, those without a node left out, then the task's question."""
    each = cache.select("query_id", "condition", F.posexplode("ids").alias("pos", "id")).join(nodes.select(F.col("id").cast("string").alias("id"), "text"), "id")
    texts = each.groupBy("query_id", "condition").agg(F.count("*").alias("n_used"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("given"))
    joined = cache.select("query_id", "condition").join(texts, ["query_id", "condition"], "left").join(tasks.select("query_id", "question"), "query_id")
    return joined.select("query_id", "condition", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.concat_ws("\n\n", "given", "question").alias("prompt"))


def grid_sweep(ranks: DataFrame, cut_offs: list[int], group: str) -> DataFrame:
    """Hits of every setting and cut-off: (setting, k, group, n_hit, n, hit_rate, best), a null group for all.

    ``ranks`` gives (setting, query_id, group, rank): the oracle's rank under
    each setting of a grid, null where it is not found.
    """
    each = ranks.select("setting", F.col(group), "rank", F.explode(F.array(*map(F.lit, cut_offs))).alias("k"))
    out = each.rollup("setting", "k", group).agg(F.count_if(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))).alias("n_hit"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    out = out.filter("g in (0, 1)").withColumn("hit_rate", F.round(F.col("n_hit") / F.col("n"), 3))
    return out.withColumn("best", (F.col("g") == 1) & (F.col("hit_rate") == F.max(F.when(F.col("g") == 1, F.col("hit_rate"))).over(Window.partitionBy()))).drop("g")
