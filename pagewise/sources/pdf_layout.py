"""What the lines of a PDF page make: headings, paragraphs, lists and tables, with their boxes, and what there is to say of the page."""

from __future__ import annotations

import re
from dataclasses import replace

from ..operators.markdown import Node, Parser
from .pdf import Item, Line, lines_of, paragraphs_of

#: A width below this is none: the font said nothing.
MEASURED = 0.5
#: Letters that a table's cell has on average at most, and rows that make a table.
CELL_CHARS, LEAST_ROWS = 30, 2
#: Lines that stand on either side of a page of columns.
COLUMN_LINES = 3
_ITEM = re.compile(r"(?:[•‣▪◦·*–-]|(\d{1,3})[.)])\s+(?=\S)")


def with_widths(items: list[Item]) -> tuple[list[Item], bool]:
    """Items from the top and the left, each with a width, and whether one had to be estimated: from the next item on its line, else half a letter's size for each letter."""
    ordered = sorted(items, key=lambda i: (-i.y, i.x))
    out, estimated = [], False
    for k, i in enumerate(ordered):
        if i.width < MEASURED:
            after = ordered[k + 1] if k + 1 < len(ordered) else None
            beside = after is not None and abs(after.y - i.y) < 1 and after.x > i.x
            i, estimated = replace(i, width=after.x - i.x if beside else 0.5 * i.size * len(i.text)), True
        out.append(i)
    return out, estimated


def _rows(lines: list[Line]) -> list[list[Line]]:
    """Lines that stand beside each other, from the top."""
    out: list[list[Line]] = []
    for line in lines:
        if out and abs(out[-1][0].y - line.y) <= 0.3 * max(line.size, 1.0):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def tables_of(lines: list[Line]) -> list[list[list[Line]]]:
    """Tables as rows of lines: rows one below the other with two or more short texts that start at the same places."""
    out: list[list[list[Line]]] = []
    open_: list[list[Line]] = []

    def close() -> None:
        nonlocal open_
        cells = [c for row in open_ for c in row]
        if len(open_) >= LEAST_ROWS and sum(len(c.text) for c in cells) <= CELL_CHARS * len(cells) and (len(open_[0]) > 2 or not _flows(open_)):
            out.append(open_)
        open_ = []

    for row in _rows(lines):
        size = max(row[0].size, 1.0)
        goes_on = open_ and len(row) == len(open_[0]) and all(abs(a.x0 - b.x0) <= size for a, b in zip(row, open_[0])) and 0 < open_[-1][0].y - row[0].y <= 2.5 * size
        if not goes_on:
            close()
        if goes_on or len(row) > 1:
            open_.append(row)
    close()
    return out


def _flows(rows: list[list[Line]]) -> bool:
    """Whether two texts beside each other are columns of prose: most lines reach nearly as far as the longest beside them."""
    wide = [max(row[c].x1 - row[c].x0 for row in rows) for c in (0, 1)]
    full = sum(row[c].x1 - row[c].x0 >= 0.75 * wide[c] for row in rows for c in (0, 1))
    return len(rows) >= COLUMN_LINES and full >= 1.5 * len(rows) and all(len(line.text) > 12 for row in rows[:-1] for line in row)


def _box(lines: list[Line]) -> dict | None:
    x0, x1 = min(x.x0 for x in lines), max(x.x1 for x in lines)
    low, top = min(x.y - 0.2 * x.size for x in lines), max(x.y + 0.8 * x.size for x in lines)
    return {"x": round(x0, 3), "y": round(low, 3), "width": round(x1 - x0, 3), "height": round(top - low, 3)} if x1 > x0 and top > low else None


def _lists(lines: list[Line]) -> list[list[list[Line]]]:
    """Lists as items of lines: a line with a mark, and the lines below it that stand further in. One number alone begins no list."""
    out: list[list[list[Line]]] = []
    for line in lines:
        last = out[-1] if out else None
        below = last is not None and 0 < last[-1][-1].y - line.y <= 2 * max(line.size, 1.0)
        if mark := _ITEM.match(line.text):
            same = below and abs(last[0][0].x0 - line.x0) <= max(line.size, 1.0) and (_ITEM.match(last[0][0].text)[1] is None) == (mark[1] is None)
            if same:
                last.append([line])
            else:
                out.append([[line]])
        elif below and line.x0 > last[0][0].x0 + 0.3 * line.size and line.y > last[-1][-1].y - 1.6 * max(line.size, 1.0) and abs(line.size - last[0][0].size) <= 0.5:
            last[-1].append(line)
    return [x for x in out if len(x) > 1 or _ITEM.match(x[0][0].text)[1] is None]


def _in_columns(groups: list[tuple[float, float, float, float]]) -> bool:
    """Whether two boxes of prose stand beside each other."""
    return any(min(a[3], b[3]) - max(a[1], b[1]) > 0.5 * min(a[3] - a[1], b[3] - b[1]) and (a[2] <= b[0] or b[2] <= a[0]) for k, a in enumerate(groups) for b in groups[:k])


def page_nodes(items: list[Item]) -> tuple[list[Node], list[str]]:
    """The nodes of a page in reading order, and the reasons that its layout gives."""
    measured, estimated = with_widths([i for i in items if i.text])
    lines, parser = lines_of(measured), Parser()
    tables = tables_of(lines)
    used = {id(c) for t in tables for row in t for c in row}
    lists = _lists([x for x in lines if id(x) not in used])
    used |= {id(x) for own in lists for item in own for x in item}
    prose = [x for x in lines if id(x) not in used]
    found: list[tuple[float, float, Node]] = []
    boxes = []
    for text, level, (x0, y0, x1, y1) in paragraphs_of(prose):
        box = {"x": round(x0, 3), "y": round(y0, 3), "width": round(x1 - x0, 3), "height": round(y1 - y0, 3)} if x1 > x0 and y1 > y0 else None
        found.append((-y1, x0, parser.node("heading" if level else "paragraph", text=text, level=level, bbox=box)))
        size = max((x.size for x in prose if y0 <= x.y <= y1 and x0 <= x.x0 <= x1), default=1.0)
        if level is None and y1 - y0 >= (COLUMN_LINES - 0.5) * size:
            boxes.append((x0, y0, x1, y1))
    for rows in tables:
        node = parser.node("table", header_rows=0, table_kind="data")
        node.grid = [[[parser.node("paragraph", text=c.text, bbox=_box([c]))] for c in row] for row in rows]
        found.append((-rows[0][0].y - 0.8 * rows[0][0].size, rows[0][0].x0, node))
    for own in lists:
        first = _ITEM.match(own[0][0].text)
        start = int(first[1]) if first[1] else 1
        node = parser.node("list", ordered=first[1] is not None, marker="decimal" if first[1] else "bullet", start=start if start != 1 else None)
        node.items = [(None, [parser.node("paragraph", text=_ITEM.sub("", " ".join(x.text for x in item), count=1), bbox=_box(item))]) for item in own]
        found.append((-own[0][0].y - 0.8 * own[0][0].size, own[0][0].x0, node))
    found.sort(key=lambda f: f[:2])
    columns = _in_columns(boxes)
    reasons = ["estimated_glyph_widths"] * estimated + ["has_tables"] * bool(tables) + ["multi_column"] * columns
    # Of a page of columns, paragraphs stay in the order in which their lines were read: column after column.
    nodes = [n for _, _, n in (sorted(found, key=lambda f: (f[1] > min(b[2] for b in boxes), *f[:2])) if columns else found)]
    return nodes, reasons
