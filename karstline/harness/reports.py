"""Drift reports: a Markdown text and the same as JSON."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

from karstline.harness.cases import CASES
from karstline.harness.outcomes import Outcome, as_json, compare

STATUSES = ("match", "drift", "unsupported")


def drift_report(slice_id: str, left: dict[str, Outcome], right: dict[str, Outcome], names: tuple[str, str]) -> dict:
    cases = [c for c in CASES if c.slice_id == slice_id]
    return {"slice_id": slice_id, "engines": list(names), "cases": [compare(c.case_id, left[c.case_id], right[c.case_id], names, c.mode) for c in cases]}


def summary(report: dict) -> dict[str, int]:
    found = Counter(c["status"] for c in report["cases"])
    return {s: found[s] for s in STATUSES}


def markdown(report: dict) -> str:
    a, b = report["engines"]
    lines = [f"# {report['slice_id']}: {a} and {b}", "", "## Summary", "", *[f"- `{s}`: {n}" for s, n in summary(report).items()], "", "## Cases", ""]
    for c in report["cases"]:
        dims = ", ".join(f"`{d}`" for d in c["comparison_dimensions"]) or "none"
        lines += [f"### `{c['case_id']}`", "", f"- status: `{c['status']}`", f"- comparison_dimensions: {dims}", f"- summary: {c['summary']}", ""]
    return "\n".join(lines)


def write(folder: str | Path, report: dict, results: dict[str, dict[str, Outcome]]) -> list[Path]:
    """Case results of each engine, and the report in both forms."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    stem, names = report["slice_id"], report["engines"]
    files = {f"{stem}-{n}-case-results.json": json.dumps({"slice_id": stem, "engine": n, "cases": [as_json(k, v) for k, v in results[n].items()]}, indent=2) for n in names}
    files[f"{stem}-{names[0]}-vs-{names[1]}-drift-report.md"] = markdown(report)
    files[f"{stem}-{names[0]}-vs-{names[1]}-drift-report.json"] = json.dumps(report, indent=2)
    out = []
    for name, text in files.items():
        out.append(folder / name)
        out[-1].write_text(text + "\n")
    return out
