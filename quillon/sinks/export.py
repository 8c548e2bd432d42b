"""Exports of views and reports."""

from __future__ import annotations

import csv
import datetime as dt
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.views import ViewResult, provenance, summary_json

MARKER = "# quillon-generated v=0.1"  # fixed value: first line of files that a scan must skip


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text joined by "; ", structs and maps as JSON: every column fits a CSV cell."""
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            return F.concat_ws("; ", c).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return c

    return df.select(*map(one, df.schema.fields))


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """A folder of CSV files with headers; ``files`` bounds how many."""
    out = flat(df)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).csv(path)


def write_report_csv(df: DataFrame, path: Path) -> int:
    """One CSV file of a report's rows, streamed to the driver partition by partition."""
    out = flat(df)
    n = 0
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(out.columns)
        for row in out.toLocalIterator():
            w.writerow(["" if v is None else v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v for v in row])
            n += 1
    return n


def write_xlsx(results: list[ViewResult], path: Path) -> bool:
    """A workbook with contents, a sheet for each view and the provenance; False if no writer is installed."""
    try:
        from openpyxl import Workbook
    except ImportError:
        return False
    book = Workbook()
    toc = book.active
    toc.title = "contents"
    toc.append(["view", "title", "rows"])
    origin = book.create_sheet("__provenance__")
    origin.append(["column_name", "definition", "sql_view"])
    for r in results:
        toc.append([r.view.name, r.view.title, r.row_count])
        for row in r.view.columns.items():
            origin.append([*row, r.view.name])
        if r.df is None:
            continue
        sheet = book.create_sheet(r.view.name[:31])
        out = flat(r.df)
        sheet.append(out.columns)
        for row in out.toLocalIterator():
            sheet.append(["" if v is None else v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v for v in row])
        for column in sheet.columns:
            sheet.column_dimensions[column[0].column_letter].width = min(60, max(len(str(c.value or "")) for c in column) + 2)
    book.save(path)
    return True


def export_views(results: list[ViewResult], folder: str | Path) -> Path:
    """CSV of each view, its provenance, and the summary of the run."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    for r in results:
        if r.df is not None:
            write_report_csv(r.df, at / f"{r.view.name}.csv")
            write_report_csv(provenance(r.df.sparkSession, r.view), at / f"{r.view.name}.provenance.csv")
    (at / "run_summary.json").write_text(summary_json(results))
    return at


def write_json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON lines: the form for bundles of any size."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def bundle(panels: dict[str, DataFrame], path: Path) -> None:
    """One JSON object with a list for each panel: for the page, whose panels are small."""
    with path.open("w", encoding="utf-8") as f:
        f.write("{")
        for i, (name, df) in enumerate(panels.items()):
            f.write(("," if i else "") + json.dumps(name) + ":[")
            for k, line in enumerate(df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()):
                f.write(("," if k else "") + line[0])
            f.write("]")
        f.write("}")


def page(bundle_path: Path, path: Path, title: str = "Corpus report") -> None:
    """A self-contained page: the bundle and a small script that shows each panel as a sortable, filterable table."""
    data = bundle_path.read_text(encoding="utf-8").replace("</", "<\\/")
    path.write_text(
        f"""<!-- {MARKER} -->
<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse;margin:.5em 0 2em}}td,th{{border:1px solid #ccc;padding:.2em .6em;text-align:left}}th{{cursor:pointer}}</style>
<h1>{html.escape(title)}</h1><main></main><script>const D={data};
for(const [name,rows] of Object.entries(D)){{const h=document.createElement('h2');h.textContent=name;const q=document.createElement('input');q.placeholder='filter';const t=document.createElement('table');
let shown=rows,by=null,up=1;const cols=rows.length?[...new Set(rows.flatMap(Object.keys))]:[];
const draw=()=>{{t.replaceChildren();const tr=t.insertRow();for(const c of cols){{const th=document.createElement('th');th.textContent=c;th.onclick=()=>{{up=by===c?-up:1;by=c;shown=[...shown].sort((a,b)=>up*((typeof a[c]==='number'&&typeof b[c]==='number')?a[c]-b[c]:String(a[c]??'').localeCompare(String(b[c]??''))));draw()}};tr.append(th)}}
for(const r of shown.slice(0,500)){{const x=t.insertRow();for(const c of cols)x.insertCell().textContent=Array.isArray(r[c])?r[c].map(v=>typeof v==='object'?JSON.stringify(v):v).join('; '):(r[c]??'')}}}};
q.oninput=()=>{{const s=q.value.toLowerCase();shown=rows.filter(r=>JSON.stringify(r).toLowerCase().includes(s));draw()}};draw();document.querySelector('main').append(h,q,t)}}</script>""",
        encoding="utf-8",
    )


def drift_markdown(rolled: DataFrame, round_number: int, generated_at: str, new_projects: list[str]) -> str:
    """The review sheet of the drift roll-up, with boxes to tick; the roll-up is what a person reads."""
    lines = [f"{MARKER} round={round_number}", "", f"# Drift Review — round {round_number:03d}", "", f"**Generated:** {generated_at}", f"**New projects ingested this round:** {len(new_projects)}"]
    lines += [f"- `{p}`" for p in new_projects[:20]]
    kind = None
    for r in rolled.orderBy("entity_kind", F.desc("occurrence_count"), "norm").toLocalIterator():
        if r.entity_kind != kind:
            kind = r.entity_kind
            lines += ["", f"## {kind}"]
        lines += ["", f"### {r.surface_form}", f"- seen {r.occurrence_count} times in {r.project_count} projects: {', '.join(r.sample_projects)}", f"- proposed: {r.llm_proposed_canonical or '—'}", "- [ ] accept  - [ ] alias of …  - [ ] reject"]
    return "\n".join(lines) + "\n"


def manifest(run_id: str, tables: dict[str, int], files: list[str], checks: dict[str, bool]) -> str:
    return json.dumps({"run_id": run_id, "tables": tables, "files": sorted(files), "self_test": checks, "passed": all(checks.values())}, indent=2)
