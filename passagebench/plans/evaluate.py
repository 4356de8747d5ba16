"""The evaluation: documents and questions to ranked cells, per-question rows, a recommendation and warnings."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import chunking, comparison, retrieval, scoring
from ..operators.questions import containing
from ..storage import stored

DEFAULTS = [
    ("fixed", {"chunk_size": 512, "overlap": 64}), ("recursive", {"chunk_size": 512, "overlap": 64}), ("semantic", {"breakpoint_percentile": 95, "min_tokens": 200, "max_tokens": 1000}),
    ("semantic_no_floor", {"breakpoint_percentile": 95, "max_tokens": 1000}), ("structure", {"max_tokens": 800}),
]
METRICS = {"balanced": "balanced_score", "recall_at_k": "recall_at_k", "mrr": "mrr", "hit_rate_at_k": "hit_rate_at_k"}


#: Rows of questions and cells that a report shows, and tracks of boundaries.
SHOWN, TRACKS = 20_000, 200


@dataclass
class Config:
    strategies: list[tuple[str, dict]] = field(default_factory=lambda: [(n, dict(p)) for n, p in DEFAULTS])
    mode: str = "dense"
    compare: list[str] = field(default_factory=list)
    top_k: int = 5
    fuzzy: float | None = 0.90
    metric: str = "balanced"
    floor: int = 200
    weight: float = 0.05
    resamples: int = 10_000
    seed: int = 0
    model: str = "BAAI/bge-small-en-v1.5"
    max_sequence: int | None = None
    cache: str | None = None
    query_prefix: str | None = None
    passage_prefix: str | None = None
    json_path: str | None = None
    html_path: str | None = None

    def __post_init__(self) -> None:
        known = {*chunking.strategies(), *chunking.HIDDEN}
        unknown = [n for n, p in self.strategies if p.get("kind", n) not in known]
        if unknown:
            raise ValueError(f"unknown strategies: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
        if len({n for n, _ in self.strategies}) != len(self.strategies):
            raise ValueError("a strategy is named twice")
        if self.top_k < 1 or self.resamples < 100:
            raise ValueError("top_k must be 1 and resamples 100 at least")
        if self.metric not in METRICS:
            raise ValueError(f"metric is one of {', '.join(METRICS)}")
        if len(set(self.modes)) != len(self.modes):
            raise ValueError("a retriever is named twice")
        self.strategies = self.strategies or [(n, dict(p)) for n, p in DEFAULTS]

    @property
    def prefixes(self) -> tuple[str, str]:
        """What stands before queries and passages: as given, else as the model was trained with."""
        own = T.prefix_scheme(self.model)
        return own[0] if self.query_prefix is None else self.query_prefix, own[1] if self.passage_prefix is None else self.passage_prefix

    @property
    def modes(self) -> list[str]:
        return [self.mode, *self.compare]


def load_config(path: str | None) -> Config:
    if path is None:
        return Config()
    from pathlib import Path

    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    r, e, m, o = (data.get(k) or {} for k in ("retrieval", "eval", "embedding", "output"))
    given = {
        "strategies": [(s["name"], s.get("params") or {}) for s in data.get("strategies") or []], "mode": r.get("mode"), "compare": r.get("compare"), "top_k": r.get("top_k"), "fuzzy": e.get("fuzzy_threshold"),
        "metric": e.get("ranking_metric"), "floor": e.get("min_floor_tokens"), "weight": e.get("lambda"), "resamples": e.get("bootstrap_resamples"), "seed": e.get("seed"), "model": m.get("model"),
        "cache": m.get("cache"), "query_prefix": m.get("query_prefix"), "passage_prefix": m.get("passage_prefix"), "json_path": o.get("json"), "html_path": o.get("html"),
    }
    return Config(**{k: v for k, v in given.items() if v is not None})


def warnings_for(docs: DataFrame, questions: DataFrame, config: Config) -> tuple[list[str], dict]:
    out = []
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == ""
    n, empty = docs.agg(F.count("*"), F.count_if(blank)).first()
    if n == empty:
        raise ValueError("all documents are empty")
    if empty:
        out.append(f"{empty} of {n} documents are empty")
    total, scored, drafts = questions.agg(F.count("*"), F.count_if(F.size("gold_snippets") > 0), F.count_if((F.size("gold_snippets") > 0) & ~F.coalesce("reviewed", F.lit(True)) if "reviewed" in questions.columns else F.lit(False))).first()
    if not scored:
        raise ValueError("no question has gold snippets")
    if scored < 15:
        out.append(f"only {scored} scored questions: differences will hardly be significant")
    if drafts:
        out.append(f"{drafts} questions are drafts that nobody reviewed")
    if "elements" in docs.columns and any(name == "structure" or p.get("kind") == "structure" for name, p in config.strategies):
        flat = docs.where(~F.exists(F.coalesce("elements", F.array().cast(chunking.ELEMENTS)), lambda e: e["type"] == "heading")).count()
        if flat:
            out.append(f"{flat} documents have no headings, so structure splits them by size alone")
    if "metadata" in docs.columns:
        odd = docs.where(~F.coalesce(F.col("metadata")["encoding"], F.lit("utf-8")).isin("utf-8", "utf-8-bom")).count()
        if odd:
            out.append(f"{odd} documents weren't valid UTF-8")
    if T.model_scope(config.model) == "english":
        foreign = comparison.languages(docs).where("label IS NOT NULL AND label <> 'en'").groupBy("label").count().orderBy(F.desc("count"), "label").collect()  # as many as there are languages
        if foreign:
            out.append(f"{config.model} is for English, but there are documents in {', '.join(f'{r.label} ({r["count"]})' for r in foreign)}")
    return out, {"documents": n, "questions": total, "scored": scored, "tokenizer": "lexical"}


def recommend(cells: list[dict], recalls: dict[tuple[str, str], dict], splits: dict, config: Config, scored: int) -> str:
    """Names a winner only if the first two cells' paired interval excludes zero."""
    if not cells:
        return "Nothing was evaluated."
    matrix = len({c["retriever"] for c in cells}) > 1

    def label(c: dict) -> str:
        return f"{c['strategy']} + {c['retriever']}" if matrix else c["strategy"]

    metric = METRICS[config.metric]
    best, worst = cells[0], cells[-1]
    if len(cells) > 1:
        a, b = (recalls.get((c["strategy"], c["retriever"]), {}) for c in cells[:2])
        ids = sorted(set(a) & set(b))
        if ids and len(ids) == len(a) == len(b):
            x, y = [a[i] for i in ids], [b[i] for i in ids]
            gap = sum(x) / len(x) - sum(y) / len(y)
            low, high = stats.paired_interval(x, y, resamples=config.resamples, seed=config.seed)
            if low <= 0 <= high:
                needed = stats.questions_to_separate(len(ids), gap, (low, high))
                cheap, dear = sorted(cells[:2], key=lambda c: c["retrieved_tokens_at_k"])
                if needed:
                    tail = f"About {needed} scored questions might tell them apart."
                elif round(cheap["retrieved_tokens_at_k"]) < round(dear["retrieved_tokens_at_k"]):
                    tail = f"No feasible number of questions would tell them apart; {label(cheap)} costs less, {cheap['retrieved_tokens_at_k']:.0f} tokens a question to {dear['retrieved_tokens_at_k']:.0f}."
                else:
                    tail = "They cost the same too, so this corpus and these questions can't tell them apart."
                return f"No winner: {label(cells[0])} and {label(cells[1])} can't be told apart on {scored} questions (recall difference {gap:+.3f}, interval [{low:+.3f}, {high:+.3f}]). {tail}"
    params = ", ".join(f"{k}={v}" for k, v in dict(config.strategies).get(best["strategy"], {}).items())
    out = [f"Use {label(best)}{f' ({params})' if params else ''}: its {config.metric} of {best[metric]:.2f} is the best here."]
    if worst["pct_tiny"] >= 0.30 and worst["strategy"] != best["strategy"]:
        out.append(f"{worst['strategy']} came last; {worst['pct_tiny']:.0%} of its chunks have fewer than {config.floor} tokens.")
        floored = next((c for c in cells if c["strategy"] == "semantic"), None)
        if worst["strategy"] == "semantic_no_floor" and floored and floored[metric] > worst[metric]:
            out.append(f"With the floor semantic gains {100 * (floored[metric] - worst[metric]):.0f} points.")
    split = next((c for c in cells if splits.get((c["strategy"], c["retriever"]), 0)), None)
    if split:
        out.append(f"{splits[split['strategy'], split['retriever']]} of {scored} answers were cut in two under {split['strategy']}; more overlap or cuts at headings would help.")
    if best["pct_oversized"] > 0:
        out.append(f"{best['pct_oversized']:.0%} of {best['strategy']}'s chunks are longer than the embedding model reads.")
    return " ".join(out)


def evaluate(docs: DataFrame, questions: DataFrame, config: Config | None = None, embed=None, progress=None) -> dict:
    """The report as a dict; `results` in it is the per-question DataFrame. Only cells, tens of rows, come to the driver."""
    config = config or Config()
    say = progress or (lambda _: None)
    warnings, summary = warnings_for(docs, questions, config)
    say("chunk")
    docs = stored(docs) if docs.isStreaming is False and "elements" in docs.columns else docs
    chunks = stored(chunking.chunk_all(docs, config.strategies, embed))
    prefixes = config.prefixes if embed else ("", "")  # words of a prefix would only blur hashed words
    if config.cache and embed and {"dense", "hybrid"} & set(config.modes):
        chunks = stored(comparison.with_vectors(chunks, config.cache, embed, config.model, prefix=prefixes[1]))
    scored = questions.where(F.size("gold_snippets") > 0)
    say("retrieve")
    ranked_chunks = stored(scoring.held(retrieval.retrieve(chunks, scored, config.modes, config.top_k, embed=embed, prefixes=prefixes), chunks))
    results = stored(scoring.per_question(ranked_chunks, chunks, scored, config.fuzzy))
    ceiling = min([config.max_sequence or 10_000, *([p["max_tokens"] for _, p in config.strategies if "max_tokens" in p] or [10_000])])
    elements = docs.select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*") if "elements" in docs.columns else None
    health = scoring.chunk_health(chunks, docs, elements, config.floor, ceiling)
    cells = scoring.balanced(scoring.metrics(results, config.top_k), config.weight).join(health, "strategy").join(scoring.recall_intervals(results, config.resamples, config.seed), ["strategy", "retriever"])
    order = {s: i for i, (s, _) in enumerate(config.strategies)}
    modes = {m: i for i, m in enumerate(config.modes)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("strategy")) * 100 + F.element_at(F.create_map(*[F.lit(x) for kv in modes.items() for x in kv]), F.col("retriever"))
    say("rank")
    ranked = [r.asDict(True) for r in scoring.rank_cells(cells.withColumn("cell_order", place), METRICS[config.metric]).orderBy("position").collect()]
    for name, _ in config.strategies:
        if name not in {c["strategy"] for c in ranked}:
            warnings.append(f"{name} made no chunks and is left out")
    first_two = [(c["strategy"], c["retriever"]) for c in ranked[:2]]
    recalls: dict = {k: {} for k in first_two}
    # one number per question and cell, for two cells
    for s, m in first_two:
        for r in results.where((F.col("strategy") == s) & (F.col("retriever") == m) & (F.col("gold_total") > 0)).select("question_id", (F.col("gold_found") / F.col("gold_total")).alias("r")).toLocalIterator():
            recalls[s, m][r.question_id] = r.r
    per_question, tracks = [], []
    if results.count() <= SHOWN:
        texts = scoring.retrieved_texts(ranked_chunks, chunks)
        per_question = [r.asDict(True) for r in results.join(texts, ["strategy", "retriever", "question_id"]).orderBy("strategy", "retriever", "question_id").collect()]
        gold = scoring.gold_rows(scored)
        marks = comparison.gold_markers(docs, gold, chunks, containing(docs, gold))
        ends = comparison.boundaries(chunks.join(marks.select("doc_id").distinct(), "doc_id", "left_semi"))
        rows = ends.join(marks.groupBy("strategy", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "status", "question_id"))).alias("gold")), ["strategy", "doc_id"])
        tracks = [r.asDict(True) for r in rows.orderBy("doc_id", "strategy").limit(TRACKS).collect()]
    else:
        warnings.append(f"the report leaves per-question rows out, as there are more than {SHOWN}; `results` has them")
    splits = {(c["strategy"], c["retriever"]): c["split_questions"] for c in ranked}
    return {
        "schema_version": comparison.SCHEMA, "metric": METRICS[config.metric], "summary": summary | {"questions_sha256": comparison.fingerprint(scored.withColumn("gold", F.to_json("gold_snippets")), "question_id", "query", "gold").first()[0], "corpus_sha256": comparison.fingerprint(docs, "doc_id", "text").first()[0]},
        "cells": ranked, "recommendation": recommend(ranked, recalls, splits, config, summary["scored"]), "warnings": warnings, "per_question": per_question, "tracks": tracks, "model": config.model if embed else "hash-256", "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "results": results,
    }
