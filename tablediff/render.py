"""A comparison as text."""

from __future__ import annotations

import json

from .operators.model import DiffRun

SHOWN = 5


def render(run: DiffRun, shown: int = SHOWN) -> str:
    lines = [f"{run.source_asset} against {run.target_asset} by {', '.join(run.keys)} ({run.algorithm.value})"]
    if run.error:
        return "\n".join([*lines, f"error: {run.error}"])
    s = run.summary
    lines += ["MATCH" if run.match else "DIFFERENT", f"source rows {s.source_rows:,}, target rows {s.target_rows:,}", f"added {s.added:,}, deleted {s.deleted:,}, modified {s.modified:,}, matched {s.matched:,}"]
    d = run.schema_differences
    for label, key in (("only in source", "columns_only_in_a"), ("only in target", "columns_only_in_b")):
        if d.get(key):
            lines.append(f"columns {label}: {', '.join(d[key])}")
    lines += [f"column {x['column']}: {x['type_a']} (nullable {x['nullable_a']}) in source, {x['type_b']} (nullable {x['nullable_b']}) in target" for x in d.get("different", [])]
    if run.metadata:
        lines.append("segments: " + json.dumps(run.metadata))
    if s.modified and shown:
        lines.append(f"first {min(shown, s.modified)} modified rows:")
        for r in run.modified_rows.orderBy("key").limit(shown).collect():
            wrong = [f"{c}: {r.source_values[c]!r} -> {r.target_values[c]!r}" for c in r.mismatched_columns]
            lines.append(f"  {r.key.asDict()} {'; '.join(wrong)}")
    if run.execution_time_seconds is not None:
        lines.append(f"planned in {run.execution_time_seconds:.2f} s")
    return "\n".join(lines)
