"""Chunkers: documents (doc_id, text, optional elements) to chunks.

chunks: strategy, chunk_id, doc_id, chunk_index, text, token_count, start, end. All are narrow: one document's chunks depend on
that document alone, so nothing is shuffled. Null texts have no chunks.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain
from ..functions import text as T
from ..functions.shipping import ship

#: Sentences that are embedded at once.
EMBED_BLOCK = 4096
#: Distances are rounded, so that the order of additions can't move a break between equal ones.
DIGITS = 9
ELEMENTS = "array<struct<type:string,text:string,start:int,end:int,level:int>>"


def _finish(rows: DataFrame, strategy: str) -> DataFrame:
    return rows.select(
        F.lit(strategy).alias("strategy"),
        F.concat(F.col("doc_id").cast("string"), F.lit(f":{strategy}:"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "chunk_index", "text", T.token_count(F.col("text")).alias("token_count"), "start", "end",
    )


def fixed(docs: DataFrame, chunk_size: int = 512, overlap: int = 64, strategy: str = "fixed") -> DataFrame:
    """Windows of chunk_size tokens every chunk_size - overlap; the last may be short."""
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be at least 0 and below chunk_size")
    step = chunk_size - overlap

    # everything is one expression over names bound once: a lambda computes again whatever it is given as an expression
    def windows(p: Column) -> Column:
        n = F.size(p)
        last = F.when(n <= chunk_size, F.lit(0)).otherwise(F.ceil((n - chunk_size) / step)).cast("int")

        def window(i: Column) -> Column:
            kept = F.array_join(F.slice(p, (i + 1) * step + 1, F.lit(overlap)), "") if overlap else F.lit("")
            return T.let(F.array_join(F.slice(p, i * step + 1, F.lit(step)), ""), lambda new: F.struct(F.length(new).alias("size"), F.concat(new, kept).alias("text")))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window))

    def placed(w: Column) -> Column:
        """A document has few windows: their sizes are a short array, summed up to each."""
        def before(sizes: Column) -> Column:
            return F.transform(w, lambda x, i: F.struct(F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b).alias("before"), x["text"].alias("text")))

        return T.let(F.transform(w, lambda x: x["size"]), before)

    made = T.let(T.token_pieces(F.col("text")), lambda p: T.let(windows(p), placed))
    rows = docs.select("doc_id", (F.regexp_instr("text", F.lit(T.WORD)) - 1).alias("lead"), F.posexplode(made).alias("chunk_index", "w"))
    rows = rows.select("doc_id", "chunk_index", F.col("w.text").alias("text"), (F.col("lead") + F.col("w.before")).alias("start"))
    return _finish(rows.withColumn("end", F.col("start") + F.length("text")), strategy)


def whole_document(docs: DataFrame, strategy: str = "whole_document") -> DataFrame:
    """One chunk for each document that isn't blank."""
    rows = docs.where(F.regexp_replace("text", r"(?U)\s+", "") != "").select("doc_id", F.lit(0).alias("chunk_index"), "text", F.lit(0).alias("start"), F.length("text").alias("end"))
    return _finish(rows, strategy)


def _by_document(docs: DataFrame, strategy: str, spans: Callable[[str, list], list[tuple[int, int]]], prepare: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Chunks from a function of text and elements to spans, over Arrow batches.

    prepare makes of the texts of a batch what `spans` gets instead of the elements, so that models see many texts at once.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    has = "elements" in docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            batch = batch[batch.text.notna()]
            for doc, text, own in zip(batch.doc_id, batch.text, prepare(batch.text.tolist()) if prepare else batch.elements if has else [[]] * len(batch)):
                if not prepare:
                    own = [] if own is None else [e if isinstance(e, dict) else e.asDict() for e in own]
                rows += [(doc, i, text[a:b], a, b) for i, (a, b) in enumerate(spans(text, own))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "start", "end"])

    columns = ["doc_id", F.col("text").cast("string").alias("text"), *(["elements"] if has else [])]
    return _finish(docs.select(*columns).mapInPandas(run, f"doc_id {kind}, chunk_index int, text string, start int, end int"), strategy)


def recursive(docs: DataFrame, chunk_size: int = 512, overlap: int = 64, strategy: str = "recursive") -> DataFrame:
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be at least 0 and below chunk_size")
    return _by_document(docs, strategy, lambda text, _: plain.locate(text, plain.split_recursively(text, chunk_size, overlap)))


def break_groups(distances, threshold: float) -> list[tuple[int, int]]:
    """First and last sentence of the groups between distances above the threshold."""
    cuts = [i + 1 for i, d in enumerate(distances) if d > threshold]
    return list(zip([0, *cuts], [c - 1 for c in cuts] + [len(distances)]))


def merge_small(groups: list[tuple[int, int]], tokens: list[int], least: int) -> list[tuple[int, int]]:
    """While a group has fewer tokens than `least`, the first such joins its smaller neighbour, the left one among equals."""
    groups = list(groups)
    sizes = [sum(tokens[a : b + 1]) for a, b in groups]
    i = 0  # those before it are large enough
    while least > 0 and len(groups) > 1:
        while i < len(sizes) and sizes[i] >= least:
            i += 1
        if i == len(sizes):
            break
        i = j = i if i == 0 or (i + 1 < len(groups) and sizes[i + 1] < sizes[i - 1]) else i - 1
        groups[j : j + 2] = [(groups[j][0], groups[j + 1][1])]
        sizes[j : j + 2] = [sizes[j] + sizes[j + 1]]
    return groups


def split_large(groups: list[tuple[int, int]], tokens: list[int], size_of: Callable[[int, int], int], most: int) -> list[tuple[int, int]]:
    """Groups of several sentences above `most` are halved after the sentence that reaches half their tokens."""
    done: list[tuple[int, int]] = []
    todo = groups[::-1]
    while todo:
        a, b = todo.pop()
        total = size_of(a, b)
        if a == b or total <= most:
            done.append((a, b))
            continue
        sums, cut = 0, a
        for cut in range(a, b):
            sums += tokens[cut]
            if 2 * sums >= total:
                break
        todo += [(cut + 1, b), (a, cut)]
    return done


def semantic(docs: DataFrame, breakpoint_percentile: float = 95, min_tokens: int = 200, max_tokens: int = 1000, embed=None, strategy: str = "semantic") -> DataFrame:
    """Sentences, broken where neighbours are further apart than the document's percentile, then floor and ceiling."""
    import numpy as np

    embed = embed or plain.hash_vectors

    def distances_of(texts: list[str]) -> list[tuple]:
        """Sentence spans of each text, and the distances of neighbours; sentences are embedded in blocks over all texts."""
        found = [plain.sentence_spans(t) for t in texts]
        flat = [t[a:b] for t, own in zip(texts, found) for a, b in own]
        distances, last = [], None
        for k in range(0, len(flat), EMBED_BLOCK):
            v = np.asarray(embed(flat[k : k + EMBED_BLOCK]))
            v = v if last is None else np.vstack([last, v])
            distances.append(np.round(1 - (v[:-1] * v[1:]).sum(1), DIGITS))
            last = v[-1:]
        distances = np.concatenate([np.zeros(0), *distances])
        at = np.cumsum([0, *map(len, found)])
        return [(own, distances[a : max(a, b - 1)]) for own, a, b in zip(found, at, at[1:])]

    def spans(text: str, prepared: tuple) -> list[tuple[int, int]]:
        own, distances = prepared
        if not own:
            return []
        counts = plain.TokenCounts(text)
        tokens = counts.of(*np.array(own).T).tolist()
        groups = break_groups(distances, float(np.percentile(distances, breakpoint_percentile))) if len(own) > 1 else [(0, 0)]
        groups = merge_small(groups, tokens, min_tokens)
        groups = split_large(groups, tokens, lambda a, b: int(counts.of(own[a][0], own[b][1])), max_tokens)
        return [(own[a][0], own[b][1]) for a, b in groups]

    return _by_document(docs, strategy, spans, distances_of)


def semantic_no_floor(docs: DataFrame, strategy: str = "semantic_no_floor", **options) -> DataFrame:
    return semantic(docs, **{**options, "min_tokens": 0}, strategy=strategy)


def section_spans(text: str, elements: list[dict]) -> list[tuple[int, int]]:
    """Sections at headings up to the depth where most headings are, three at least; heading-only ones join the next."""
    headings = [e for e in elements if e["type"] == "heading" and e["level"] is not None]
    levels = [e["level"] or 1 for e in headings]
    depth = max([3, *([min(x for x in set(levels) if levels.count(x) == max(map(levels.count, levels)))] if levels else [])])
    starts = [e["start"] for e, level in zip(headings, levels) if level <= depth]
    if not starts:
        return [(0, len(text))]
    if starts[0]:
        starts.insert(0, 0)
    out, held = [], None
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
        if b <= a:
            continue
        a = held if held is not None else a
        held = None
        if "\n" not in text[a:b].strip() and i + 1 < len(starts):
            held = a
        else:
            out.append((a, b))
    return out


def structure(docs: DataFrame, max_tokens: int = 800, strategy: str = "structure") -> DataFrame:
    """One chunk per section; sections that are too large are split recursively without overlap."""

    def spans(text: str, elements: list[dict]) -> list[tuple[int, int]]:
        out = []
        for a, b in section_spans(text, elements):
            part = text[a:b]
            if not part.strip():
                continue
            if plain.count_tokens(part) <= max_tokens:
                out.append((a, b))
            else:
                out += [(a + x, a + y) for x, y in plain.locate(part, plain.split_recursively(part, max_tokens, 0))]
        return out

    return _by_document(docs, strategy, spans)


# elements -------------------------------------------------------------------------------------------------------------


def markdown_elements(text: Column) -> Column:
    """Headings and tables of a markdown text as an array of elements in order; native."""
    lines = F.split(text, "\n")
    state = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("from"), F.lit(0).alias("rows"), F.array().cast(ELEMENTS).alias("out"))

    def element(kind: str, body: Column, start: Column, end: Column, level: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("type"), body.alias("text"), start.alias("start"), end.cast("int").alias("end"), level.cast("int").alias("level")))

    def closed(acc: Column) -> Column:
        """The elements with the table that ends here, if it has two rows or more."""
        body = F.substring(text, acc["from"] + 1, acc["at"] - acc["from"])
        return F.when(acc["rows"] >= 2, F.concat(acc["out"], element("table", F.regexp_replace(body, r"\n$", ""), acc["from"], F.least(acc["at"], F.length(text)), F.lit(None)))).otherwise(acc["out"])

    def step(acc: Column, line: Column) -> Column:
        row = line.rlike(r"^[ \t]*\|.*\|[ \t]*$")
        hashes = F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1))
        heading = element("heading", F.regexp_extract(line, r"^#{1,6}[ \t]+(.*?)[ \t]*$", 1), acc["at"], acc["at"] + F.length(line), hashes)
        out = F.when(row, acc["out"]).otherwise(F.when(hashes > 0, F.concat(closed(acc), heading)).otherwise(closed(acc)))
        return F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"), F.when(row, F.when(acc["rows"] > 0, acc["from"]).otherwise(acc["at"])).otherwise(F.lit(-1)).alias("from"),
            F.when(row, acc["rows"] + 1).otherwise(F.lit(0)).alias("rows"), out.alias("out"),
        )

    # the end of the text closes a table that it ends with; its offset is one beyond, as if another line began
    folded = T.blocked_fold(lines, state, step, "out")
    return T.let(folded, lambda f: F.concat(F.flatten(f["blocks"]), closed(f["state"].withField("out", F.array().cast(ELEMENTS)))))


def heading_trails(elements: Column) -> Column:
    """array<struct<start, trail>>: at each heading, the headings that are open there, outermost first."""
    entry = "struct<level:int,text:string>"
    state = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast("array<struct<start:int,trail:array<string>>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        level = F.coalesce(h["level"], F.lit(1))
        now = F.concat(F.filter(acc["open"], lambda x: x["level"] < level), F.array(F.struct(level.alias("level"), h["text"].alias("text"))))
        return F.struct(now.alias("open"), F.concat(acc["out"], F.array(F.struct(h["start"].alias("start"), F.transform(now, lambda x: x["text"]).alias("trail")))).alias("out"))

    return F.aggregate(F.filter(elements, lambda e: e["type"] == "heading"), state, step, lambda acc: acc["out"])


def annotate(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds contains_table and section_path from the documents' elements; one equi-join on doc_id."""
    elements = F.coalesce(F.col("elements"), F.array().cast(ELEMENTS))
    side = docs.select("doc_id", F.filter(elements, lambda e: e["type"] == "table").alias("_tables"), heading_trails(elements).alias("_trails"))
    joined = chunks.join(side, "doc_id", "left")
    overlap = F.exists("_tables", lambda t: (t["start"] < F.col("end")) & (t["end"] > F.col("start")))
    here = F.filter("_trails", lambda t: t["start"] <= F.col("start"))
    path = F.when(F.size(here) > 0, F.element_at(here, -1)["trail"]).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("contains_table", F.coalesce(overlap, F.lit(False))).withColumn("section_path", path).drop("_tables", "_trails")


# registry -------------------------------------------------------------------------------------------------------------

BUILT_IN: dict[str, Callable[..., DataFrame]] = {
    "fixed": fixed, "recursive": recursive, "semantic": semantic, "semantic_no_floor": semantic_no_floor, "structure": structure,
}
HIDDEN: dict[str, Callable[..., DataFrame]] = {"whole_document": whole_document}
_plugins: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def register_chunker(name: str, factory: Callable[..., object], description: str = "", replace: bool = False) -> None:
    """factory(**params) gives an object with chunk(docs) -> rows (doc_id, chunk_index, text, start, end), or with
    spans(text, elements) -> [(start, end)], which is run over Arrow batches."""
    if not name or not callable(factory):
        raise TypeError("a chunker needs a name and a callable")
    if name in BUILT_IN or name in HIDDEN:
        raise ValueError(f"{name!r} is a built-in chunker")
    if name in _plugins and not replace:
        raise ValueError(f"{name!r} is registered already")
    _plugins[name] = (factory, description)


def unregister_chunker(name: str) -> None:
    _plugins.pop(name, None)


def discover(group: str = "passagebench.chunkers") -> None:
    """Registers the chunkers that installed packages name as entry points; a broken one is skipped with a warning."""
    import warnings
    from importlib.metadata import entry_points

    for point in entry_points(group=group):
        try:
            if point.name not in _plugins:  # what was registered by hand stays
                register_chunker(point.name, point.load())
        except Exception as error:  # a plugin may fail in any way
            warnings.warn(f"chunker {point.name!r} is skipped: {error}", RuntimeWarning, stacklevel=2)


_discovered = False


def _discover_once() -> None:
    global _discovered
    if not _discovered:
        _discovered = True
        discover()


def strategies() -> list[str]:
    _discover_once()
    return [*BUILT_IN, *_plugins]


def chunk(docs: DataFrame, name: str, kind: str | None = None, embed=None, **params) -> DataFrame:
    """Chunks under one strategy; `kind` is the chunker's name where the strategy has another."""
    kind = kind or name
    maker = BUILT_IN.get(kind) or HIDDEN.get(kind)
    if maker:
        if embed is not None and "embed" in inspect.signature(maker).parameters:
            params["embed"] = embed
        return maker(docs, strategy=name, **params)
    if kind not in _plugins:
        _discover_once()
    if kind not in _plugins:
        raise ValueError(f"unknown chunker {kind!r}; known: {', '.join(strategies())}")
    factory = _plugins[kind][0]
    wanted = inspect.signature(factory).parameters
    if "embedder" in wanted or any(p.kind is p.VAR_KEYWORD for p in wanted.values()):
        params["embedder"] = embed or plain.hash_vectors
    made = factory(**params)
    if hasattr(made, "chunk"):
        return _finish(made.chunk(docs), name)
    if hasattr(made, "spans"):
        return _by_document(docs, name, made.spans)
    raise TypeError(f"what {kind!r} makes has neither chunk nor spans")


def chunk_all(docs: DataFrame, plan: list[tuple[str, dict]], embed=None) -> DataFrame:
    """Chunks of several strategies in one DataFrame, so later steps run once for all."""
    return reduce(DataFrame.unionByName, [chunk(docs, name, embed=embed, **params) for name, params in plan])
