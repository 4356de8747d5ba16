"""Sinks: console text, JSON and a standalone HTML page of an evaluation, and drafted questions as YAML."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

COLUMNS = ("recall_at_k", "mrr", "hit_rate_at_k", "precision_at_k", "retrieved_tokens_at_k", "num_chunks", "tokens_median", "pct_tiny", "boundary_health")


#: What the columns mean, under every console table.
LEGEND = (
    "recall, hit rate, precision: of gold snippets, questions and chunks among the first k; mrr: reciprocal rank of the first hit; tokens: retrieved per question;",
    "pct_tiny: chunks below the floor; boundary_health: chunks that cut no sentence; balanced: recall less a price for tokens",
)


def to_json(report: dict, path: str) -> None:
    """Everything but the DataFrame of results."""
    plain = {k: v for k, v in report.items() if k != "results"}
    Path(path).write_text(json.dumps(plain, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def _shown(cell: dict, name: str) -> str:
    v = cell.get(name)
    if v is None:
        return "-"
    return f"{v:.0%}" if name in ("pct_tiny", "boundary_health") else f"{v:.0f}" if name in ("retrieved_tokens_at_k", "num_chunks", "tokens_median") else f"{v:.3f}"


def to_console(report: dict) -> str:
    cells, metric = report["cells"], report["metric"]
    several = len({c["retriever"] for c in cells}) > 1
    names = [*(["balanced_score"] if metric == "balanced_score" else []), *COLUMNS]
    head = ["strategy", *(["retriever"] if several else []), *names]
    rows = [[c["strategy"], *([c["retriever"]] if several else []), *(_shown(c, n) for n in names)] for c in cells]
    model = report.get("model")
    caveat = [f"dense scores are of {model}" + ("; it hashes words and knows no meaning, so rank with a real model before deciding" if model.startswith("hash") else "; another model may rank otherwise")] if model else []
    widths = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in [head, *rows]]
    return "\n".join([f"{report['summary']['documents']} documents, {report['summary']['scored']} scored questions, tokens: {report['summary']['tokenizer']}", "", *lines, "", *LEGEND, *caveat, "", report["recommendation"], *(f"warning: {w}" for w in report["warnings"])])


def to_html(report: dict, path: str) -> None:
    cells = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in (c["strategy"], c["retriever"], _shown(c, "balanced_score"), *(_shown(c, n) for n in COLUMNS))) + "</tr>" for c in report["cells"])
    bars = []
    for c in report["cells"]:
        histogram = c.get("token_histogram") or []
        most = max([b["chunks"] for b in histogram], default=1)
        bars.append(f"<h3>{escape(c['strategy'])} / {escape(c['retriever'])}</h3>" + "".join(f"<div>{b['bucket']} <span style='display:inline-block;background:#789;height:.7em;width:{300 * b['chunks'] // most}px'></span> {b['chunks']}</div>" for b in histogram))
    found = []
    for q in report.get("per_question", []):  # by cell, so that no retriever's list covers another's
        texts = "".join(f"<li>{escape(t[:600])}</li>" for t in q.get("retrieved", [])[:3])
        found.append(f"<details><summary>{escape(q['strategy'])} / {escape(q['retriever'])}: {escape(str(q['question_id']))}, {q['gold_found']} of {q['gold_total']}</summary><ol>{texts}</ol></details>")
    tracks = []
    for t in report.get("tracks", []):
        ends = t["boundaries"]
        size = max([*ends, *(g["end"] for g in t["gold"]), 1])
        ticks = "".join(f"<i style='left:{100 * b / size:.2f}%'></i>" for b in ends)
        gold = "".join(f"<b class={g['status']} title='{escape(str(g['question_id']))}' style='left:{100 * g['start'] / size:.2f}%;width:{max(0.2, 100 * (g['end'] - g['start']) / size):.2f}%'></b>" for g in t["gold"])
        tracks.append(f"<div>{escape(str(t['doc_id']))} / {escape(t['strategy'])}<div class=track>{ticks}{gold}</div></div>")
    style = "<style>.track{position:relative;height:14px;background:#eee}.track i{position:absolute;width:1px;height:14px;background:#333}.track b{position:absolute;top:3px;height:8px}.clean{background:#2a7}.split{background:#c33}</style>"
    head = "".join(f"<th>{escape(h)}</th>" for h in ("strategy", "retriever", "balanced", *COLUMNS))
    warnings = "".join(f"<p>{escape(w)}</p>" for w in report["warnings"])
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>Chunking report</title><h1>Chunking report</h1><p>{escape(report['recommendation'])}</p>{warnings}<table border=1><tr>{head}</tr>{cells}</table>{''.join(bars)}{style}{''.join(tracks)}{''.join(found)}", encoding="utf-8")


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def drafts_to_yaml(rows: list[dict], path: str) -> None:
    lines = ["# Drafted questions: read each one, mend it, and set reviewed to true.", "questions:"]
    for r in rows:
        lines += [f"  # from {r['tags'][0]}", f"  - id: {r['question_id']}", f"    query: {_quoted(r['query'])}", "    gold_snippets:", *(f"      - {_quoted(s)}" for s in r["gold_snippets"]), f"    tags: [{', '.join(map(_quoted, r['tags']))}]", "    reviewed: false"]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
