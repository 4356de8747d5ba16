"""Regression check between two runs, fingerprints, language audit, gold markers, embedding cache, benchmark conversion."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions import stats
from ..functions import text as T
from ..functions.shipping import ship


@dataclass
class Outcome:
    strategy: str
    retriever: str
    baseline_recall: float
    current_recall: float
    difference: float
    interval: tuple[float, float] | None = None
    comparable: bool = False
    failures: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failures


def paired(baseline: DataFrame, current: DataFrame, on: list[str] | None = None) -> DataFrame:
    """question_id, before, now of the questions that both runs have."""
    on = on or ["question_id"]
    recall = F.col("gold_found") / F.col("gold_total")
    a = baseline.where("gold_total > 0").select(*on, recall.alias("before"))
    return a.join(current.where("gold_total > 0").select(*on, recall.alias("now")), on)


def check(baseline: DataFrame, current: DataFrame, strategy: str, retriever: str, same_questions: bool = True, max_drop: float | None = None, resamples: int = 10_000, seed: int = 0) -> Outcome:
    """Compares one cell's per-question rows; a drop fails only if the paired interval lies below zero, or beyond max_drop."""
    cell = (F.col("strategy") == strategy) & (F.col("retriever") == retriever)
    a, b = baseline.where(cell), current.where(cell)
    means = [x.where("gold_total > 0").agg(F.avg(F.col("gold_found") / F.col("gold_total")), F.count("*")).first() for x in (a, b)]
    if not means[0][1] or not means[1][1]:
        raise ValueError(f"no cell {strategy} + {retriever} in both runs")
    out = Outcome(strategy, retriever, means[0][0], means[1][0], means[1][0] - means[0][0])
    if not same_questions:
        out.notes.append("the questions differ between the runs, so these are not paired and only the raw difference counts")
    else:
        rows = paired(a, b).orderBy("question_id").toPandas()
        if len(rows) and len(rows) == means[0][1] == means[1][1]:
            out.comparable = True
            out.interval = stats.paired_interval(rows.now, rows.before, resamples=resamples, seed=seed)
    return _judged(out, max_drop)


SCHEMA = "1.0"


def check_reports(baseline: dict, current: dict, strategy: str | None = None, retriever: str | None = None, max_drop: float | None = None, resamples: int = 10_000, seed: int = 0) -> Outcome:
    """Two reports of `evaluate`, as read from JSON: the baseline's winner, or the cell that is named, must not have lost recall.

    Pairs need the same questions, told by their digest; else only max_drop can fail. Reports of another major version, without
    per-question rows or without the cell are errors.
    """
    for name, report in (("baseline", baseline), ("current", current)):
        if str(report.get("schema_version", "")).split(".")[0] != SCHEMA.split(".")[0]:
            raise ValueError(f"the {name} report has schema version {report.get('schema_version')!r}, not {SCHEMA}")
        if not report.get("cells") or "per_question" not in report:
            raise ValueError(f"the {name} report has no per-question rows")
    first = next((c for c in baseline["cells"] if strategy in (None, c["strategy"]) and retriever in (None, c["retriever"])), None)
    if first is None:
        raise ValueError(f"the baseline has no cell {strategy} + {retriever}")
    cell = first["strategy"], first["retriever"]
    recalls = [{q["question_id"]: q["gold_found"] / q["gold_total"] for q in r["per_question"] if (q["strategy"], q["retriever"]) == cell and q["gold_total"]} for r in (baseline, current)]
    if not all(recalls):
        raise ValueError(f"no cell {cell[0]} + {cell[1]} in both reports")
    means = [sum(r.values()) / len(r) for r in recalls]
    out = Outcome(*cell, means[0], means[1], means[1] - means[0])
    digests = [r.get("summary", {}).get("questions_sha256") for r in (baseline, current)]
    if None in digests or digests[0] != digests[1]:
        out.notes.append("the questions differ between the runs, so these are not paired and only the raw difference counts")
    elif set(recalls[0]) == set(recalls[1]):
        ids = sorted(recalls[0])
        out.comparable = True
        out.interval = stats.paired_interval([recalls[1][i] for i in ids], [recalls[0][i] for i in ids], resamples=resamples, seed=seed)
    return _judged(out, max_drop)


def _judged(out: Outcome, max_drop: float | None) -> Outcome:
    if out.interval and out.interval[1] < 0:
        out.failures.append(f"recall of {out.strategy} + {out.retriever} fell by {-out.difference:.3f}; its interval [{out.interval[0]:+.3f}, {out.interval[1]:+.3f}] lies below zero")
    if max_drop is not None and out.difference < -abs(max_drop):
        out.failures.append(f"recall fell by {-out.difference:.3f}, more than the {abs(max_drop):.3f} allowed")
    if not out.comparable and not out.failures:
        out.notes.append("no interval could be computed; max_drop sets a plain limit")
    return out


def fingerprint(rows: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """sha256 of a table whatever its order: digests of the rows, digested once more by their first four hex digits, then by
    their first two, and then all together, so that no task holds more than its 65,536th of the digests."""
    text = F.concat(*[x for c in (id_column, *columns) for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\x00"))])
    parts = rows.select(F.sha2(text, 256).alias("d")).select("d", F.col("d").alias("p"))
    below = F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])
    digest = F.sha2(F.concat_ws("", below), 256)
    for digits in (4, 2):
        parts = parts.groupBy(F.substring("p", 1, digits).alias("q")).agg(digest.alias("d")).select("d", F.col("q").alias("p"))
    return parts.agg(digest.alias("sha256"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, script, language, label: the script where it isn't Latin, else the language; null where undecided."""
    rows = docs.select("doc_id", T.dominant_script(F.col("text")).alias("script"), T.detect_language(F.col("text")).alias("language"))
    return rows.withColumn("label", F.when(F.col("script") != "latin", F.col("script")).otherwise(F.col("language")))


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def _loosely(gold: pd.Series, whole: pd.Series) -> pd.DataFrame:
    """Where a snippet stands but for case and white space; -1 where it doesn't."""
    from .questions import normalize_with_map

    rows = []
    for g, w in zip(gold, whole):
        text, places = normalize_with_map(w or "")
        wanted, _ = normalize_with_map(g or "")
        at = text.find(wanted) if wanted else -1
        rows.append((places[at], places[at + len(wanted) - 1] + 1) if at >= 0 else (-1, -1))
    return pd.DataFrame(rows, columns=["start", "end"])


def gold_markers(docs: DataFrame, gold: DataFrame, chunks: DataFrame, found: DataFrame, verbatim: bool = False) -> DataFrame:
    """strategy, doc_id, question_id, gold_index, start, end, status: where snippets stand, verbatim or else but for case and
    white space; clean if one chunk holds them.

    found: question_id, gold_index, doc_id pairs worth looking at, so each is one equi-join. With verbatim, snippets that stand
    in another case or spacing have no marker.
    """
    if not verbatim:
        ship(docs.sparkSession)
    rows = found.join(gold.select("question_id", "gold_index", "gold"), ["question_id", "gold_index"]).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    exact = F.expr("locate(gold, whole)")
    loose = F.lit(None).cast("struct<start:int,end:int>") if verbatim else F.when(exact == 0, _loosely("gold", "whole"))
    rows = rows.select("doc_id", "question_id", "gold_index", exact.alias("at"), F.length("gold").alias("n"), loose.alias("loose"))
    rows = rows.select("doc_id", "question_id", "gold_index", F.coalesce("loose.start", F.col("at") - 1).alias("g_start"), F.coalesce("loose.end", F.col("at") - 1 + F.col("n")).alias("g_end")).where("g_start >= 0")
    joined = rows.join(chunks.select("strategy", "doc_id", "start", "end"), "doc_id")
    inside = F.max(((F.col("start") <= F.col("g_start")) & (F.col("end") >= F.col("g_end"))).cast("int"))
    return joined.groupBy("strategy", "doc_id", "question_id", "gold_index", F.col("g_start").alias("start"), F.col("g_end").alias("end")).agg(F.when(inside == 1, "clean").otherwise("split").alias("status"))


def boundaries(chunks: DataFrame) -> DataFrame:
    """strategy, doc_id, boundaries: chunk starts in order, and the end of the last."""
    last = F.max_by("end", F.struct("start", "end"))
    return chunks.groupBy("strategy", "doc_id").agg(F.concat(F.array_sort(F.collect_list("start")), F.array(last)).alias("boundaries"))


def _key(text: Column, model: str, signature: str = "", role: str = "passage", revision: str = "unknown", version: str = "1") -> Column:
    return F.sha2(F.concat_ws("\x00", *[F.lit(x) for x in (version, model, revision or "unknown", signature, role)], text), 256)


def cache_keys(texts: DataFrame, model: str, signature: str = "", role: str = "passage", revision: str = "unknown", version: str = "1") -> DataFrame:
    """Distinct texts with the key of their vector in the cache."""
    return texts.select("text", _key(F.col("text"), model, signature, role, revision, version).alias("key")).dropDuplicates(["key"])


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def cached_embed(keyed: DataFrame, path: str, embed) -> DataFrame:
    """key, vector of all keyed texts: only misses are embedded, and appended to the Parquet cache at `path`.

    Only a path where nothing is counts as an empty cache; one that can't be read is an error.
    """
    spark = keyed.sparkSession
    ship(spark)
    schema = "key string, vector array<double>"
    cache = spark.read.schema(schema).parquet(path) if cache_exists(spark, path) else spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch.key, "vector": list(embed(batch.text.tolist()))})

    width = cache.select(F.size("vector").alias("n")).distinct().limit(2).collect()
    cache_misses(keyed, cache).mapInPandas(run, schema).write.mode("append").parquet(path)
    whole = spark.read.schema(schema).parquet(path)
    if width and whole.select(F.size("vector").alias("n")).distinct().count() > 1:
        raise ValueError("the cache has vectors of several lengths; clear it or use another path")
    return whole.join(keyed.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cache_exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def with_vectors(chunks: DataFrame, path: str, embed, model: str, signature: str = "", prefix: str = "") -> DataFrame:
    """The chunks with the vectors of their texts, from the cache where it has them: an equi-join on the key."""
    keyed = chunks.withColumn("_embedded", F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))))
    keys = cache_keys(keyed.select(F.col("_embedded").alias("text")), model, signature)
    vectors = cached_embed(keys, path, embed).withColumnRenamed("key", "_key")
    named = keyed.withColumn("_key", _key(F.col("_embedded"), model, signature))
    return named.join(vectors, "_key").drop("_key", "_embedded")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("vectors"), F.count_distinct("key").alias("keys"), F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)).alias("bytes"))


def cache_clear(spark: SparkSession, path: str) -> bool:
    """Deletes the cache; False if there was none. A folder that holds anything but Parquet files isn't taken for a cache."""
    files, at = _place(spark, path)
    if not files.exists(at):
        return False
    names = [f.getPath().getName() for f in files.listStatus(at)]
    if any(not (n.endswith(".parquet") or n.startswith(("_", "."))) for n in names):
        raise ValueError(f"{path} doesn't look like a cache of vectors")
    return files.delete(at, True)


def swing(results: DataFrame) -> DataFrame:
    """Per source tag: the best and worst strategy's recall, their difference, and the winner."""
    rows = results.select("strategy", "source", (F.col("gold_found") / F.col("gold_total")).alias("recall"))
    means = rows.groupBy("source", "strategy").agg(F.avg("recall").alias("recall"))
    return means.groupBy("source").agg(F.max("recall").alias("best"), F.min("recall").alias("worst"), (F.max("recall") - F.min("recall")).alias("swing"), F.max_by("strategy", F.struct("recall", "strategy")).alias("winner"))


def pooled(cells: DataFrame, keys: tuple[str, ...] = ("strategy", "retriever")) -> DataFrame:
    """Means over cases, weighted with their numbers of questions."""
    n = F.sum("questions")
    return cells.groupBy(*keys).agg(n.alias("questions"), *[(F.sum(F.col(c) * F.col("questions")) / n).alias(c) for c in ("recall_at_k", "mrr", "retrieved_tokens_at_k")])


# conversion of public question-answering sets ---------------------------------------------------------------------------


def convert_papers(papers: DataFrame, least_tokens: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers (paper_id, title, abstract, full_text, qas) to documents, questions and dropped(reason, n)."""
    safe = F.regexp_replace("paper_id", r"[^A-Za-z0-9_.-]", "_")

    def section(s):
        name = F.trim(F.coalesce(s["section_name"], F.lit("")))
        body = F.filter(F.transform(s["paragraphs"], lambda p: F.trim(p)), lambda p: p != "")
        return F.concat(F.when(name != "", F.array(F.lit(""), F.concat(F.lit("## "), name))).otherwise(F.array().cast("array<string>")), F.flatten(F.transform(body, lambda p: F.array(F.lit(""), p))))

    head = F.array(F.concat(F.lit("# "), F.trim("title")), F.lit(""), F.lit("## Abstract"), F.lit(""), F.trim("abstract"))
    text = F.concat(F.array_join(F.concat(head, F.flatten(F.transform("full_text", section))), "\n"), F.lit("\n"))
    docs = papers.select(safe.alias("doc_id"), text.alias("text"), "qas")
    qas = docs.select("doc_id", "text", F.posexplode("qas").alias("i", "qa"))
    spans = F.transform(
        F.filter("qa.answers", lambda a: ~F.coalesce(a["answer"]["unanswerable"], F.lit(False))),
        lambda a: F.filter(F.transform(a["answer"]["evidence"], lambda e: F.trim(e)), lambda e: (e != "") & ~e.startswith("FLOAT SELECTED")),
    )
    rows = qas.select("doc_id", "text", "i", "qa.question", F.coalesce(F.get(F.filter(spans, lambda s: F.size(s) > 0), F.lit(0)), F.array().cast("array<string>")).alias("evidence"))
    rows = rows.withColumn("verbatim", F.filter("evidence", lambda e: F.expr("1 = 1") & F.col("text").contains(e))).withColumn("kept", F.filter("verbatim", lambda e: T.token_count(e) >= least_tokens))
    flat = F.trim(F.regexp_replace("question", r"(?U)\s+", " "))
    questions = rows.where(F.size("kept") > 0).select(F.format_string("%s_q%02d", "doc_id", "i").alias("question_id"), flat.alias("query"), F.col("kept").alias("gold_snippets"), F.array(F.concat(F.lit("src:"), "doc_id"), F.lit("qasper")).alias("tags"))
    e, v, k = F.size("evidence"), F.size("verbatim"), F.size("kept")
    reasons = F.filter(F.array(*[F.struct(F.lit(r).alias("reason"), n.cast("long").alias("n")) for r, n in (("no usable evidence", (e == 0).cast("int")), ("not verbatim", e - v), ("too short", v - k), ("nothing left", ((e > 0) & (k == 0)).cast("int")))]), lambda x: x["n"] > 0)
    dropped = rows.select(F.explode(reasons).alias("x")).groupBy("x.reason").agg(F.sum("x.n").alias("n"))
    return docs.select("doc_id", "text"), questions, dropped


def convert_contracts(contracts: DataFrame, least_tokens: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts (title, paragraphs) to one document each, questions with spans that stand at their offsets, dropped(reason, n)."""
    first = F.get("paragraphs", F.lit(0))
    safe = F.regexp_replace("title", r"[^A-Za-z0-9_.-]", "_")
    # a title that is cut or changed keeps its whole digest's beginning, so no two contracts get one id
    name = F.when((F.length(safe) <= 80) & (safe == F.col("title")), safe).otherwise(F.concat(F.substring(safe, 1, 71), F.lit("_"), F.substring(F.sha2("title", 256), 1, 8)))
    docs = contracts.select(name.alias("doc_id"), first["context"].alias("text"), first["qas"].alias("qas"))
    further = contracts.agg(F.coalesce(F.sum(F.greatest(F.size("paragraphs") - 1, F.lit(0))), F.lit(0)).alias("n")).where("n > 0").select(F.lit("further paragraph").alias("reason"), F.col("n").cast("long").alias("n"))
    qas = docs.select("doc_id", "text", F.posexplode("qas").alias("i", "qa"))
    usable = F.when(F.coalesce(F.col("qa.is_impossible"), F.lit(False)), F.array_except("qa.answers", "qa.answers")).otherwise(F.col("qa.answers"))
    rows = qas.select("doc_id", "text", "i", "qa.question", usable.alias("answers"))
    rows = rows.withColumn("right", F.filter("answers", lambda a: F.substring(F.col("text"), a["answer_start"].cast("int") + 1, F.length(a["text"])) == a["text"]))
    rows = rows.withColumn("long", F.filter("right", lambda a: T.token_count(a["text"]) >= least_tokens)).withColumn("kept", F.array_distinct(F.transform("long", lambda a: a["text"])))
    flat = F.trim(F.regexp_replace("question", r"(?U)\s+", " "))
    questions = rows.where(F.size("kept") > 0).select("doc_id", F.format_string("q%02d", "i").alias("question_id"), flat.alias("query"), F.col("kept").alias("gold_snippets"), F.array(F.lit("cuad")).alias("tags"))
    a, r, n = F.size("answers"), F.size("right"), F.size("long")
    reasons = F.filter(F.array(*[F.struct(F.lit(x).alias("reason"), c.cast("long").alias("n")) for x, c in (("absent", (a == 0).cast("int")), ("offset wrong", a - r), ("too short", r - n), ("nothing left", ((a > 0) & (n == 0)).cast("int")))]), lambda x: x["n"] > 0)
    dropped = rows.select(F.explode(reasons).alias("x")).groupBy("x.reason").agg(F.sum("x.n").alias("n")).unionByName(further)
    return docs.join(questions, "doc_id", "left_semi").select("doc_id", "text"), questions, dropped


def sample_ids(ids: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """n ids, chosen by a seeded hash: the same whatever the partitioning."""
    chosen = ids.select(column).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(column)), column).limit(n)
    return chosen.orderBy(column)


def with_order(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("cell_order", F.row_number().over(W.partitionBy().orderBy(*by)))
