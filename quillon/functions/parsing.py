"""Parsers of project documents: one document in, rows out. Plain functions, used by the sources as
Arrow batch operators. Positions count code points."""

from __future__ import annotations

import json
import re
from typing import Any

import yaml

# fixed values: names and patterns of the document format
CANONICAL_DOCS = {"README.md": "README", "RESEARCH_PLAN.md": "RESEARCH_PLAN", "REPORT.md": "REPORT", "REVIEW.md": "REVIEW", "references.md": "references_md"}
FRONT_MATTER, PREAMBLE = "__frontmatter__", "__preamble__"
SKIPPED_TITLES = ["Reproduction", "Quick Links", "Code Quality", "Review Metadata", "Project Structure", "Dependencies", "Acknowledgments", "Data Availability"]
#: how the first line of this engine's own files begins
MARKER = re.compile(r"^(?:<!-- )?# quillon-generated v=")
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.DOTALL)
_TITLE = re.compile(r"^#\s+(.+?)\s*$", re.MULTILINE)
_HEADING = re.compile(r"^##\s+(.+?)\s*$", re.MULTILINE)
_REVISION = re.compile(r"^[-*]\s*\*\*(v\d+(?:\.\d+)?)\*\*\s*\((\d{4}-\d{2}(?:-\d{2})?)\)\s*:\s*(.*?)$", re.MULTILINE)
_IDENTIFIER = re.compile(r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]")
_DASH = re.compile(r"\s+[—–-]\s+")
_PREFIX = re.compile(r"^(\d{1,3})([a-zA-Z]?)[_-]")
_GOAL = re.compile(r"\*\*Goal\*\*:\s*(.+?)(?:\n\n|\n\*\*|\Z)", re.DOTALL)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)


def front_matter(text: str) -> tuple[dict | None, int]:
    """The leading YAML mapping and where the body begins; None and 0 if there is none."""
    found = _FRONT.match(text)
    if not found:
        return None, 0
    try:
        data = yaml.safe_load(found.group(1))
    except yaml.YAMLError:
        return None, 0
    return (data, found.end()) if isinstance(data, dict) else (None, 0)


def sections(text: str) -> list[dict[str, Any]]:
    """Rows (h1_text, h2_text, content, start_offset, end_offset): front matter, preamble, and a row for
    each second-level heading; deeper headings stay in the content, which is stripped at its right end."""
    data, body = front_matter(text)
    title = _TITLE.search(text, body)
    h1 = title.group(1).strip() if title else None
    rows = []
    if data is not None:
        rows.append((None, FRONT_MATTER, yaml.safe_dump(data, default_flow_style=False, sort_keys=False).strip(), 0, body))
    heads = list(_HEADING.finditer(text, body))
    stops = [h.start() for h in heads] + [len(text)]
    lead = text[body : stops[0]].rstrip()
    if lead.strip():
        rows.append((h1, PREAMBLE, lead, body, stops[0]))
    for head, stop in zip(heads, stops[1:]):
        line = text.find("\n", head.end())
        start = len(text) + 1 if line < 0 else line + 1
        rows.append((h1, head.group(1).strip(), text[start:stop].rstrip(), start, stop))
    return [dict(zip(("h1_text", "h2_text", "content", "start_offset", "end_offset"), r)) for r in rows]


def revisions(content: str) -> list[dict[str, Any]]:
    """Rows (version_label, version_date, date_precision, change_description, source_quote) of a revision
    history; a date without a day is its first, with precision ``month``. The date stays text: what is no
    date of the calendar is for the caller to reject."""
    found = list(_REVISION.finditer(content))
    rows = []
    for m, stop in zip(found, [f.start() for f in found[1:]] + [len(content)]):
        label, day, first = m.group(1), m.group(2), m.group(3).rstrip()
        rest = content[m.end() : stop].rstrip()
        text = f"{first}\n{rest.lstrip(chr(10))}".strip() if rest.strip() else first
        rows.append({"version_label": label, "version_date": day if len(day) > 7 else day + "-01", "date_precision": "day" if len(day) > 7 else "month", "change_description": text, "source_quote": content[m.start() : stop].rstrip()})
    return rows


def author(bullet: str) -> dict[str, Any] | None:
    """(name, orcid_id, affiliation, source_quote) of one bullet, or None if it names nobody."""
    found = _IDENTIFIER.search(bullet)
    body = bullet
    if found:
        # every way in which an iD is decorated: a link, an address, a label, brackets
        one = re.escape(found.group())
        for pattern in (rf"\[[^\]]*{one}[^\]]*\]\(https?://[^)]*\)", rf"https?://\S*?{one}", rf"\b{one}\b", r"\(\s*(?:ORCID:)?\s*[,;]?\s*\)", r"\[\s*\]\(\s*\)", r"ORCID:\s*"):
            body = re.sub(pattern, "", body)
    body = body.strip()
    if "," in body:
        name, _, place = body.partition(",")
    else:
        name, *more = _DASH.split(body, maxsplit=1)
        place = more[0] if more else ""
    name = re.sub(r"\*{1,2}([^*]+)\*{1,2}", r"\1", name).strip().strip(",;")
    if len(name) < 2 or "://" in name:
        return None
    return {"name": name, "orcid_id": found.group() if found else None, "affiliation": place.strip() or None, "source_quote": bullet.strip()}


def authors(content: str) -> list[dict[str, Any]]:
    return [a for line in re.findall(r"^[-*]\s+(.+?)$", content, re.MULTILINE) if (a := author(line))]


class References:
    """Finds other projects' ids in backticks; the pattern is built once."""

    def __init__(self, ids: set[str]):
        self.pattern = re.compile("`(" + "|".join(map(re.escape, sorted(ids))) + ")`") if ids else None

    def find(self, project: str, content: str) -> list[dict[str, Any]]:
        """One row for each other project named: its id, how often, and the words around the first place."""
        rows: dict[str, dict[str, Any]] = {}
        for m in self.pattern.finditer(content) if self.pattern else ():
            if m.group(1) == project:
                continue
            row = rows.setdefault(m.group(1), {"dst_project_id": m.group(1), "occurrence_count": 0, "source_quote": content[max(0, m.start() - 50) : m.end() + 50].strip().replace("\n", " ")})
            row["occurrence_count"] += 1
        return list(rows.values())


def notebook(name: str, raw: str) -> dict[str, Any] | None:
    """Inventory of a notebook's JSON; None if it isn't one."""
    try:
        cells = json.loads(raw)["cells"]
        assert isinstance(cells, list)
    except (ValueError, KeyError, TypeError, AssertionError):
        return None
    kinds = [c.get("cell_type") for c in cells if isinstance(c, dict)]
    text = next(("".join(s) if isinstance(s := c.get("source", ""), list) else str(s) for c in cells if isinstance(c, dict) and c.get("cell_type") == "markdown"), "")
    title, goal, number = _TITLE.search(text), _GOAL.search(text), _PREFIX.match(name)
    phrase = goal.group(1).strip() if goal else None
    return {
        "notebook_number": int(number.group(1)) if number else None, "notebook_suffix": (number.group(2) or None) if number else None, "title_from_first_md_cell": title.group(1).strip() if title else None,
        "goal_phrase": phrase if phrase is None or len(phrase) <= 200 else phrase[:200].rstrip() + "…", "total_cells": len(cells), "markdown_cells": kinds.count("markdown"), "code_cells": kinds.count("code"), "raw_cells": kinds.count("raw"),
        "has_outputs": any(isinstance(c, dict) and c.get("cell_type") == "code" and bool(c.get("outputs")) for c in cells),
    }


CHUNK_LIMIT = 12_000


def chunks(content: str, limit: int = CHUNK_LIMIT) -> list[str]:
    """Pieces of at most ``limit`` characters whose concatenation is the content: packed from units that
    end before a sub-heading, else at a blank line, else at white space near the limit, else anywhere."""
    def units(text: str, level: int) -> list[str]:
        if len(text) <= limit:
            return [text]
        if level < 2:
            pattern = r"(?m)(?=^#{3,4}\s)" if level == 0 else r"(?<=\n\n)(?=[^\n])"
            return [u for part in re.split(pattern, text) if part for u in units(part, level + 1)]
        out = []
        while len(text) > limit:
            near = max(text.rfind(c, limit - limit // 20, limit) for c in " \n\t")
            cut = near + 1 if near >= 0 else limit
            out.append(text[:cut])
            text = text[cut:]
        return [*out, text] if text else out

    packed = [""]
    for unit in units(content, 0):
        if packed[-1] and len(packed[-1]) + len(unit) > limit:
            packed.append("")
        packed[-1] += unit
    return packed


_LOOSE = re.compile(r"""("(?:[^"\\]|\\.)*")|'((?:[^'\\]|\\.)*)'|(//[^\n]*|/\*.*?\*/)|,(?=\s*[}\]])|([A-Za-z_$][\w$]*)(?=\s*:)""", re.DOTALL)


def strict_json(text: str) -> str:
    """Looser JSON made strict: comments and trailing commas go, single quotes become double ones and bare keys are
    quoted; nothing inside a string is touched."""

    def one(m: re.Match) -> str:
        if m.group(1) is not None:
            return m.group(1)
        if m.group(2) is not None:
            return '"' + re.sub(r'(?<!\\)"', r'\"', m.group(2).replace("\\'", "'")) + '"'
        return f'"{m.group(4)}"' if m.group(4) else ""

    return _LOOSE.sub(one, text)


def salvage_json(text: str) -> Any:
    """JSON out of a model's answer: as it is, in a fence, between the outermost brackets, and at last
    read loosely. Raises ValueError if nothing parses."""
    text = text.strip()
    tries = [text, *(m.strip() for m in _FENCE.findall(text))]
    for a, b in ("{}", "[]"):
        if 0 <= text.find(a) < text.rfind(b):
            tries.append(text[text.find(a) : text.rfind(b) + 1])
    for loose in (False, True):
        for t in tries:
            try:
                return json.loads(strict_json(t) if loose else t)
            except ValueError:
                continue
    raise ValueError(f"no JSON in {text[:200]!r}")


def extractable(doc: str | None, title: str | None, content: str | None) -> bool:
    """Sections worth reading by a model: of canonical documents, no pseudo-section, no administrative title, not a stub."""
    return doc in CANONICAL_DOCS.values() and title not in (FRONT_MATTER, PREAMBLE, None, *SKIPPED_TITLES) and len((content or "").strip()) >= 80
