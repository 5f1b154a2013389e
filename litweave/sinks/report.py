"""Reports rendered on the driver from small aggregates: Markdown tables, a text flow, an SVG flow."""

from __future__ import annotations

import time
from html import escape

from pyspark.sql import DataFrame


def markdown_table(rows: list[list], head: list[str]) -> str:
    """Columns padded to their widest cell; numbers to the right."""
    cells = [[f"{x:,}" if isinstance(x, int) else "" if x is None else str(x) for x in r] for r in rows]
    wide = [max(map(len, c)) for c in zip(head, *cells)]
    right = [all(isinstance(r[i], (int, float)) for r in rows) and bool(rows) for i in range(len(head))]
    line = lambda r: "| " + " | ".join(x.rjust(w) if q else x.ljust(w) for x, w, q in zip(r, wide, right)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 1) + (":" if q else "-") for w, q in zip(wide, right)) + "|", *map(line, cells)])


def frame_table(df: DataFrame, most: int = 200) -> str:
    rows = df.limit(most + 1).collect()
    more = f"\n\n({most} rows shown)" if len(rows) > most else ""
    return markdown_table([list(r) for r in rows[:most]], df.columns) + more


def text_flow(stages: list[tuple[str, str | None]]) -> str:
    """Boxes from top to bottom, each with what leaves the flow beside it."""
    wide = max(len(x) for s, _ in stages for x in s.split("\n"))
    out = []
    for k, (stage, leaves) in enumerate(stages):
        body = [f"| {x.ljust(wide)} |" for x in stage.split("\n")]
        if leaves:
            body[len(body) // 2] += f" ---> {leaves}"
        out += ["+" + "-" * (wide + 2) + "+", *body, "+" + "-" * (wide + 2) + "+"]
        if k < len(stages) - 1:
            out += [" " * (wide // 2 + 1) + c for c in "|v"]
    return "\n".join(out)


def svg_flow(stages: list[tuple[str, str | None]], wide: int = 260, high: int = 64, gap: int = 34) -> str:
    """The same flow as a drawing."""
    parts, y = [], 10

    def box(x: int, text: str) -> str:
        lines = text.split("\n")
        spans = "".join(f'<tspan x="{x + wide // 2}" dy="{0 if i == 0 else 16}">{escape(t)}</tspan>' for i, t in enumerate(lines))
        return f'<rect x="{x}" y="{y}" width="{wide}" height="{high}" fill="none" stroke="black"/><text y="{y + high // 2 - 8 * (len(lines) - 1) + 4}" text-anchor="middle" font-size="13">{spans}</text>'

    for k, (stage, leaves) in enumerate(stages):
        parts.append(box(10, stage))
        if leaves:
            parts += [f'<path d="M{10 + wide} {y + high // 2} h40" stroke="black" marker-end="url(#a)"/>', box(wide + 52, leaves)]
        if k < len(stages) - 1:
            parts.append(f'<path d="M{10 + wide // 2} {y + high} v{gap - 2}" stroke="black" marker-end="url(#a)"/>')
        y += high + gap
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{2 * wide + 70}" height="{y}"><defs><marker id="a" markerWidth="8" markerHeight="8" refX="7" refY="3" orient="auto"><path d="M0 0L7 3L0 6z"/></marker></defs>{"".join(parts)}</svg>'


def _section(title: str, df: DataFrame | None) -> list[str]:
    return [] if df is None else [f"## {title}", "", frame_table(df), ""]


def screening_report(date: str, screened: int, included: int, by_reviewer: DataFrame, reasons: DataFrame | None = None, types: DataFrame | None = None, years: DataFrame | None = None, sources: DataFrame | None = None) -> str:
    """The report on title and abstract screening, from counts: what was read, by whom, why records left, what stays."""
    head = [f"# Screening report ({date})", "", f"- Records screened: **{screened:,}**", f"- Records excluded: **{screened - included:,}**", f"- Reports sought for retrieval: **{included:,}**", ""]
    return "\n".join(head + _section("Files read", sources) + _section("By reviewer", by_reviewer) + _section("Reasons", reasons) + _section("Included, by type", types) + _section("Included, by year", years))


def fulltext_report(date: str, flow: dict[str, int], reasons: DataFrame, by_screener: DataFrame | None = None) -> str:
    """The report on full texts, from one row of ``reconcile.flow`` and the reasons in the order of the checks."""
    left = flow.get("undecided", 0)
    head = [f"# Full-text report ({date})", "", f"Status: {'complete' if not left else f'interim, {left:,} undecided'}", ""]
    head += [f"- {name}: **{flow[k]:,}**" for k, name in (("sought", "Reports sought"), ("not_retrieved", "Not retrieved"), ("assessed", "Assessed"), ("excluded", "Excluded"), ("included", "Studies included"))]
    return "\n".join([*head, "", *_section("Reasons of exclusion", reasons), *_section("By screener", by_screener)])


def merge_report(date: str, reviewed: int, merges: DataFrame) -> str:
    """The report on duplicates judged by hand: (kept, dropped, why) of those merged, and the ids not used again."""
    n = merges.count()
    gone = ", ".join(f"`C{r[0]:04d}`" for r in merges.select("absorbed").distinct().orderBy("absorbed").collect())
    head = [f"# Duplicates judged by hand ({date})", "", f"- Pairs reviewed: **{reviewed:,}**", f"- Pairs merged: **{n:,}**", f"- Pairs kept apart: **{reviewed - n:,}**", ""]
    return "\n".join([*head, *_section("Merged", merges), f"Identifiers not used again: {gone or 'none'}."])


def corpus_report(date: str, records: int, unique: int, **sections: DataFrame) -> str:
    """The report on the corpus: how many records came in and stayed, and any counts (by database, year, type, ...)."""
    head = [f"# Corpus report ({date})", "", f"- Records identified: **{records:,}**", f"- Duplicates removed: **{records - unique:,}**", f"- Unique records: **{unique:,}**", ""]
    return "\n".join(head + [line for name, df in sections.items() for line in _section(name.replace("_", " ").capitalize(), df)])


class Tee:
    """Writes a report to the screen, lists cut after ``most`` lines, and whole to a file. ``{at}`` in its path is the time
    of the run."""

    def __init__(self, path: str, most: int = 40):
        self.path = path.replace("{at}", time.strftime("%Y%m%d_%H%M%S"))
        self.file, self.most = open(self.path, "w", encoding="utf-8"), most

    def write(self, lines: list[str]) -> None:
        self.file.write("\n".join(lines) + "\n")
        print("\n".join(lines[: self.most] + ([f"... {len(lines) - self.most} more"] if len(lines) > self.most else [])))

    def close(self) -> None:
        self.file.close()
