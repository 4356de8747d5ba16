"""Gold matching, per-question outcomes, metrics per cell, ranking and chunk health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from ..functions import text as T
from ..functions.shipping import ship
from ..functions.similarity import partial_ratio_column
from ..storage import stored, to_all

CELL = ("strategy", "retriever")
Chunks = DataFrame | Callable[[DataFrame], DataFrame]


def gold_rows(questions: DataFrame) -> DataFrame:
    """question_id, gold_index, gold, norm, gold_tokens from questions with gold_snippets."""
    rows = questions.select("question_id", F.posexplode("gold_snippets").alias("gold_index", "gold"))
    return rows.withColumn("norm", T.normalize(F.col("gold"))).withColumn("gold_tokens", T.token_count(F.col("gold")))


def _contained(pairs: DataFrame, keys: list[str], fuzzy: float | None) -> DataFrame:
    """Rows of pairs(norm, haystack) that match: exactly, or for the rest by partial ratio."""
    usable = pairs.where((F.col("norm") != "") & (F.col("haystack") != ""))
    exact = usable.where(F.expr("contains(haystack, norm)"))
    if fuzzy is None:
        return exact
    ship(pairs.sparkSession)
    rest = usable.where(~F.expr("contains(haystack, norm)"))
    return exact.unionByName(rest.where(partial_ratio_column(F.col("norm"), F.col("haystack"), fuzzy - 1e-9) >= fuzzy))


def held(ranked: DataFrame, chunks: Chunks) -> DataFrame:
    """Ranked rows with their chunks' text, tokens and span: at most k rows a question and cell, whatever the corpus.

    chunks: a table, or a function from doc_ids to the chunks of these documents, which cuts them again."""
    if "text" in ranked.columns:
        return ranked
    ranked = stored(ranked)
    named = stored(ranked.select("doc_id").distinct())
    own = (chunks(named) if callable(chunks) else chunks.join(to_all(named), "doc_id", "left_semi")).select("strategy", "chunk_id", "text", "token_count", "start", "end")
    return own.join(to_all(ranked), ["strategy", "chunk_id"]).select(*ranked.columns, "text", "token_count", "start", "end")


def hits(ranked: DataFrame, chunks: Chunks, gold: DataFrame, fuzzy: float | None = 0.90, cell: tuple[str, ...] = CELL) -> DataFrame:
    """cell.., question_id, gold_index, rank of every gold snippet that a retrieved chunk holds."""
    texts = held(ranked, chunks).withColumn("haystack", T.normalize(F.col("text")))
    pairs = texts.join(gold.select("question_id", "gold_index", "norm"), "question_id")
    return _contained(pairs.select(*cell, "question_id", "gold_index", "rank", "norm", "haystack"), [*cell], fuzzy).select(*cell, "question_id", "gold_index", "rank")


def splits(ranked: DataFrame, chunks: Chunks, gold: DataFrame, found: DataFrame, fuzzy: float | None = 0.90, cell: tuple[str, ...] = CELL) -> DataFrame:
    """cell.., question_id where a snippet that no chunk holds is in two retrieved chunks that touch or overlap."""
    rows = held(ranked, chunks)
    a = rows.select(*cell, "question_id", "doc_id", *[F.col(c).alias(f"a_{c}") for c in ("rank", "text", "start", "end")])
    b = rows.select(*cell, "question_id", "doc_id", *[F.col(c).alias(f"b_{c}") for c in ("rank", "text", "start", "end")])
    first = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_rank") < F.col("b_rank")))
    pairs = a.join(b, [*cell, "question_id", "doc_id"]).where(first & (F.col("b_start") <= F.col("a_end") + 1))
    missing = ranked.select(*cell, "question_id").distinct().join(gold.select("question_id", "gold_index", "norm"), "question_id").join(found, [*cell, "question_id", "gold_index"], "left_anti")
    both = T.normalize(F.concat_ws(" ", "a_text", "b_text")).alias("haystack")
    return _contained(missing.join(pairs, [*cell, "question_id"]).select(*cell, "question_id", "norm", both), [*cell], fuzzy).select(*cell, "question_id").distinct()


def per_question(ranked: DataFrame, chunks: Chunks, questions: DataFrame, fuzzy: float | None = 0.90, cell: tuple[str, ...] = CELL) -> DataFrame:
    """One row per cell and scored question."""
    gold = gold_rows(questions)
    # at most k rows a question and cell, which several steps read
    ranked = stored(held(ranked, chunks))
    found = stored(hits(ranked, chunks, gold, fuzzy, cell))
    total = gold.groupBy("question_id").agg(F.count("*").alias("gold_total"))
    context = ranked.groupBy(*cell, "question_id").agg(F.sum("token_count").alias("retrieved_tokens"))
    counts = found.groupBy(*cell, "question_id").agg(F.min("rank").alias("first_hit_rank"), F.count_distinct("rank").alias("hit_chunks"), F.count_distinct("gold_index").alias("gold_found"), F.array_sort(F.collect_set("gold_index")).alias("found_gold"))
    tokens = found.select(*cell, "question_id", "gold_index").distinct().join(gold.select("question_id", "gold_index", "gold_tokens"), ["question_id", "gold_index"]).groupBy(*cell, "question_id").agg(F.sum("gold_tokens").alias("found_tokens"))
    split = splits(ranked, chunks, gold, found, fuzzy, cell).withColumn("split_across", F.lit(True))
    by = [*cell, "question_id"]
    rows = context.join(total, "question_id").join(counts, by, "left").join(tokens, by, "left").join(split, by, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("hit_chunks", "gold_found", "found_tokens")}
    return rows.withColumns({**zero, "found_gold": F.coalesce("found_gold", F.array().cast("array<int>")), "split_across": F.coalesce("split_across", F.lit(False))})


def retrieved_texts(ranked: DataFrame, chunks: Chunks, most: int = 3, cell: tuple[str, ...] = CELL) -> DataFrame:
    """cell.., question_id, retrieved: the texts of the first chunks, in order."""
    rows = held(ranked, chunks).where(F.col("rank") <= most)
    return rows.groupBy(*cell, "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("retrieved"))


def efficiency() -> Column:
    return F.when(F.col("retrieved_tokens") > 0, F.least(F.col("found_tokens") / F.col("retrieved_tokens"), F.lit(1.0))).otherwise(0.0)


def metrics(results: DataFrame, top_k: int, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Per cell: recall, hit rate, MRR, precision at k, tokens, context efficiency, split questions."""
    return results.groupBy(*cell).agg(
        F.count("*").alias("questions"), F.avg(F.when(F.col("gold_total") > 0, F.col("gold_found") / F.col("gold_total"))).alias("recall_at_k"),
        F.avg((F.col("gold_found") > 0).cast("int")).alias("hit_rate_at_k"), F.avg(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.col("hit_chunks") / F.lit(top_k) if top_k > 0 else F.lit(0.0)).alias("precision_at_k"), F.avg("retrieved_tokens").alias("retrieved_tokens_at_k"),
        F.avg(efficiency()).alias("context_efficiency"), F.sum(F.col("split_across").cast("int")).alias("split_questions"),
    )


def balanced(cells: DataFrame, weight: float = 0.05) -> DataFrame:
    """Adds balanced_score: recall less weight for every multiple of the least positive context beyond the first."""
    least = F.min(F.when(F.col("retrieved_tokens_at_k") > 0, F.col("retrieved_tokens_at_k"))).over(W.partitionBy())
    tokens = F.greatest(F.col("retrieved_tokens_at_k"), least)
    return cells.withColumn("balanced_score", F.col("recall_at_k") - F.coalesce(F.lit(weight) * (tokens / least - 1), F.lit(0.0)))


def rank_cells(cells: DataFrame, metric: str = "balanced_score", order: tuple[str, ...] = ("cell_order",)) -> DataFrame:
    """Adds position: metric, MRR and hit rate descending, tiny chunks ascending, then the configured order. One row per cell."""
    keys = [F.desc(metric), F.desc("mrr"), F.desc("hit_rate_at_k"), *([F.asc("pct_tiny")] if "pct_tiny" in cells.columns else []), *order]
    return cells.withColumn("position", F.row_number().over(W.partitionBy().orderBy(*keys)))


# health ---------------------------------------------------------------------------------------------------------------


def sizes(chunks: DataFrame, floor: int = 200, ceiling: int = 10_000) -> DataFrame:
    return chunks.groupBy("strategy").agg(
        F.count("*").alias("num_chunks"), F.min("token_count").alias("tokens_min"), F.median("token_count").alias("tokens_median"), F.avg("token_count").alias("tokens_mean"),
        F.max("token_count").alias("tokens_max"), F.avg((F.col("token_count") < floor).cast("int")).alias("pct_tiny"), F.avg((F.col("token_count") > ceiling).cast("int")).alias("pct_oversized"),
    )


def histogram(chunks: DataFrame, bucket: int = 100) -> DataFrame:
    return chunks.groupBy("strategy", (F.floor(F.col("token_count") / bucket) * bucket).cast("int").alias("bucket")).agg(F.count("*").alias("chunks"))


def boundary_health(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """strategy, boundary_health: the share of chunks neither of whose ends falls inside a sentence.

    Ends of chunks and sentences are narrow rows that meet in the order of their places within a document: an end falls inside
    the last sentence that begins before it, or in none, as sentences don't overlap. One shuffle by doc_id serves all steps.
    """
    spans = docs.select("doc_id", F.explode(T.sentence_spans(F.col("text"))).alias("s"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("strategy", "string"), ("chunk_index", "int"))]
    sentences = spans.select("doc_id", F.col("s.start").alias("at"), F.lit(1).alias("kind"), F.col("s.end").alias("stop"), *blank)
    ends = chunks.select("doc_id", F.explode(F.array("start", "end")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("stop"), "strategy", F.col("chunk_index").cast("int").alias("chunk_index"))
    before = W.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sentences.unionByName(ends).withColumn("stop", F.last("stop", ignorenulls=True).over(before)).where("kind = 0")
    cut = placed.groupBy("doc_id", "strategy", "chunk_index").agg(F.max(F.coalesce(F.col("at") < F.col("stop"), F.lit(False))).alias("cut"))
    return cut.groupBy("strategy").agg(F.avg((~F.col("cut")).cast("int")).alias("boundary_health"))


def table_integrity(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """strategy, table_integrity: the share of tables (doc_id, start, end, type) that lie in one chunk; null without tables."""
    tables = elements.where("type = 'table'").select("doc_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    strategies = chunks.select("strategy").distinct()
    held = chunks.join(tables, "doc_id").where("start <= t_start AND end >= t_end").select("strategy", "doc_id", "t_start").distinct().groupBy("strategy").agg(F.count("*").alias("held"))
    total = tables.agg(F.count("*").alias("total"))
    rows = strategies.join(held, "strategy", "left").join(F.broadcast(total), how="cross")
    return rows.select("strategy", F.when(F.col("total") > 0, F.coalesce("held", F.lit(0)) / F.col("total")).alias("table_integrity"))


def chunk_health(chunks: DataFrame, docs: DataFrame, elements: DataFrame | None = None, floor: int = 200, ceiling: int = 10_000) -> DataFrame:
    """One row per strategy with all statistics and the histogram as array<struct<bucket, chunks>>."""
    bars = histogram(chunks).groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("bucket", "chunks"))).alias("token_histogram"))
    rows = sizes(chunks, floor, ceiling).join(boundary_health(chunks, docs), "strategy").join(bars, "strategy")
    if elements is None:
        return rows.withColumn("table_integrity", F.lit(None).cast("double"))
    return rows.join(table_integrity(chunks, elements), "strategy")


# intervals ------------------------------------------------------------------------------------------------------------


def recall_intervals(results: DataFrame, resamples: int = 10_000, seed: int = 0, cell: tuple[str, ...] = CELL) -> DataFrame:
    """cell.., ci_low, ci_high of mean recall; a cell's recalls, one number per question, are one group."""
    ship(results.sparkSession)
    rows = results.where("gold_total > 0").select(*cell, F.col("question_id").cast("string"), (F.col("gold_found") / F.col("gold_total")).alias("recall"))
    kinds = {f.name: f.dataType.simpleString() for f in results.schema}

    def interval(key, part):
        import pandas as pd

        low, high = stats.mean_interval(part.sort_values("question_id")["recall"], resamples, seed)
        return pd.DataFrame([(*key, low, high)], columns=[*cell, "ci_low", "ci_high"])

    return rows.groupBy(*cell).applyInPandas(interval, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", ci_low double, ci_high double")


def hash_interval(values: DataFrame, keys: list[str], order: str, value: str, resamples: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """A bootstrap interval without random numbers: slot s of resample r takes the value at md5(seed:r:s) modulo n. Native."""
    ordered = values.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("vs"))
    rows = ordered.select(*keys, "vs", F.size("vs").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))

    def pick(s: Column) -> Column:
        name = F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), s.cast("string"))
        return F.get("vs", F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int"))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("n") - 1), pick), F.lit(0.0), lambda a, x: a + x)
    means = rows.select(*keys, (total / F.col("n")).alias("mean"))
    return means.groupBy(*keys).agg(F.percentile("mean", alpha / 2).alias("ci_low"), F.percentile("mean", 1 - alpha / 2).alias("ci_high"))
