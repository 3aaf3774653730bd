"""Reports as text and JSON, from small aggregates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from prosewright.operators import metrics


def evaluation(df: DataFrame, truth: str, pred: str) -> dict:
    """Accuracy, per-category metrics and confusion of predictions."""
    return {
        **metrics.accuracy(df, truth, pred).first().asDict(),
        "per_category": {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.per_category(df, truth, pred).collect()},
        "confusion": [r.asDict() for r in metrics.confusion(df, truth, pred).collect()],
    }


def sliced(df: DataFrame, fields: list[str], truth: str, pred: str) -> dict:
    """The evaluation, and accuracy by each value of each field."""
    slices: dict[str, dict] = {f: {} for f in fields}
    for r in metrics.slice_report(df, fields, truth, pred).collect():  # a row for each value
        slices[r["field"]][r["value"]] = {k: r[k] for k in ("total", "correct", "accuracy")}
    return {**evaluation(df, truth, pred), "slices": slices}


def audit(votes: DataFrame, key: str, label: str = "label", flag: str = "flag") -> dict:
    """Annotator agreement, recall of injected rows and the gate, per label, and whether all labels pass. votes: as injected_recall takes them."""
    agreement, recall = metrics.annotator_agreement(votes, key, label, flag), metrics.injected_recall(votes, key)
    out = {r["label"]: {k: r[k] for k in ("mean_agreement", "unanimous_rate", "split_rate")} for r in agreement.collect()}
    for r in recall.collect():
        out.setdefault(r["label"], {})["recall"] = r["recall"]
    for r in metrics.gate(agreement, recall).collect():
        out[r["label"]]["passes"] = r["passes"]
    return {"labels": out, "passes": all(x.get("passes", False) for x in out.values())}


def as_text(report: dict, title: str = "") -> str:
    lines = [title] if title else []
    lines.append(f"accuracy {report['accuracy']:.4f} ({report['correct']} of {report['total']})")
    lines.append(f"{'label':<14}{'precision':>10}{'recall':>10}{'f1':>8}{'n':>8}")
    for label, m in sorted(report["per_category"].items()):
        lines.append(f"{label:<14}{m['precision']:>10.3f}{m['recall']:>10.3f}{m['f1']:>8.3f}{m['support']:>8}")
    lines += [f"{r['actual']} -> {r['predicted']}: {r['n']}" for r in report["confusion"] if r["actual"] != r["predicted"]]
    return "\n".join(lines)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True)


def table(df: DataFrame, limit: int = 200) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])
