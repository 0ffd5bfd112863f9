"""Answers as text and JSON: a bounded number of rows, within a number of bytes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

LEAST_BYTES = 128
SECTIONS = (8, 5, 3)
SIGNS = {"added": "+", "removed": "-", "renamed": "~", "moved": ">", "signature_changed": "*", "body_changed": "."}
COLORS = {"+": "32", "-": "31", "~": "33", ">": "35", "*": "36", ".": "34"}
Row = Mapping[str, object]


def cut_text(text: str, budget: int, mark: str = "…") -> str:
    """The text within ``budget`` bytes, cut after a whole line if there is one, with a mark if something is gone."""
    data = text.encode()
    if len(data) <= budget:
        return text
    kept = data[: max(0, budget - len(mark.encode()))].decode(errors="ignore")
    at = kept.rfind("\n")
    return (kept[: at + 1] if at > 0 else kept) + mark


def ranked_budgets(n: int, budget: int) -> list[int]:
    """Shares of ``budget`` that fall with the rank, none below 128 bytes."""
    whole = n * (n + 1) // 2
    return [max(LEAST_BYTES, budget * (n - i) // whole) for i in range(n)] if n else []


def fit(rows: Sequence[Row], budget: int) -> list[Row]:
    """The first rows whose JSON fits into ``budget`` bytes together; the first one always stays."""
    kept: list[Row] = []
    used = 0
    for row in rows:
        used += len(json.dumps(dict(row), default=str).encode()) + 1
        if kept and used > budget:
            break
        kept.append(row)
    return kept


def as_json(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, default=str, ensure_ascii=False)


def as_lines(rows: Iterable[Row]) -> str:
    return "".join(json.dumps(dict(r), sort_keys=True, default=str, ensure_ascii=False) + "\n" for r in rows)


def search_text(rows: Sequence[Row], whole: int = 2) -> str:
    """The first two results with their snippets, the others as one line each."""
    out = []
    for r in rows:
        head = f"{r['rank']}. {r['path']}:{r['start_line']}-{r['end_line']} ({r['score']}, {r['signal']})"
        out.append(f"{head}\n{r['snippet']}\n" if r["rank"] <= whole else head)
    return "\n".join(out) + "\n" if out else "nothing found\n"


def search_agent(rows: Sequence[Row], budget: int = 16 * 1024) -> str:
    """Results within a byte budget, the first with the largest shares."""
    return "".join(cut_text(f"{r['path']}:{r['start_line']}-{r['end_line']}\n{r['snippet']}\n", share) + "\n" for r, share in zip(rows, ranked_budgets(len(rows), budget)))


def neighbors_text(focus: str, rows: Sequence[Row], budget: int = 16 * 1024) -> str:
    """Edges of a focus by direction, with totals where some are left out."""
    out = [f"{focus}\n"]
    for direction in ("in", "out"):
        own = [r for r in rows if r["direction"] == direction]
        total = own[0]["total"] if own else 0
        out.append(f"{direction}: {total}" + (f" (first {len(own)})" if total > len(own) else "") + "\n")
        out += [f"  {r['relation']} {r['other_id']} {r.get('confidence') or 0:.2f}\n" for r in own]
    return cut_text("".join(out), budget)


def ambiguous_text(name: str, rows: Sequence[Row]) -> str:
    """What is shown for a name that several endpoints have: the definitions alone."""
    return f"{name} has {len(rows)} definitions; name one:\n" + "".join(f"  {r['file_path']}:{r['start_line']} {r['endpoint_kind']} {r['endpoint_id']}\n" for r in rows)


def impact_text(sections: Mapping[str, Sequence[Row]], budget: int = 4 * 1024) -> str:
    """Sections of callers; if they don't fit, 8, then 5, then 3 of each, then cut at a line."""
    for most in (None, *SECTIONS):
        text = ""
        for title, rows in sections.items():
            text += f"{title}: {len(rows)}\n" + "".join(f"  {r['depth']} {r['caller_id']}" + (f" via {r['via']}" if r.get("via") else "") + "\n" for r in rows[:most])
            if most is not None and len(rows) > most:
                text += f"  and {len(rows) - most} more\n"
        if len(text.encode()) <= budget:
            return text
    return cut_text(text, budget)


def diff_text(rows: Sequence[Row], color: bool = False) -> str:
    """Changes by file, one line each."""
    out, path = [], None
    for r in rows:
        if r["file_path"] != path:
            path = r["file_path"]
            out.append(f"{path}\n")
        sign = SIGNS[r["change_kind"]]
        name = f"{r['old_name']} -> {r['name']}" if r["change_kind"] in ("renamed", "moved") and r.get("old_name") != r["name"] else r["name"]
        line = f"  {sign} {r['kind']} {name}" + (f" (from {r['old_path']})" if r.get("old_path") else "")
        out.append((f"\x1b[{COLORS[sign]}m{line}\x1b[0m" if color else line) + "\n")
    return "".join(out) or "no changes\n"


def coverage_banner(files: int, parsed: int, level: str) -> str | None:
    """A warning if an answer rests on a part of the files, else None."""
    return None if level == "ok" else f"partial coverage ({level}): {parsed} of {files} files were read"
