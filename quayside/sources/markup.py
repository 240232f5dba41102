"""Structure of web pages: the cells of all tables and the options of all lists, from a stack of open elements.

Pages are dealt over tasks by the caller, and read in Arrow batches. Tags are told apart by one pattern; end tags that authors leave out are implied where the next tag of a table or list asks for it. Cells
get their place in the grid, with the rows and columns that spans cover; a nested table is a table of its own that knows its parent. Text of a nested table is not text of the cell around
it. Null pages have nothing; unknown entities stay as they are.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no markup.
RAW = ("script", "style", "textarea", "title")
_REST = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
_RAW = "|".join(rf"(?i:<{n}(?:(?=[\s/>])|(?=[\"'])(?![^\s/>]+{_REST}>)){_REST}(?<!/)>.*?(?:</{n}\s*>|\Z))" for n in RAW)
#: A comment, CDATA, a declaration, a raw element with all that is in it, or a tag.
TAG = re.compile(rf"(<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|{_RAW}|</?[a-zA-Z][^\s/>]*{_REST}>)", re.S)
#: Slash, name and the rest of a tag.
ONE = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({_REST})>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SECTIONS = ("thead", "tbody", "tfoot")
_PARTS = frozenset(("tr", "td", "th", "caption", *SECTIONS))
#: What a start tag closes if it is open, up to the element that bounds the search.
CLOSES = {
    "tr": (frozenset(("tr", "td", "th", "caption")), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), **{s: (_PARTS, ("table",)) for s in SECTIONS},
    "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
}
#: Tags that a page's structure is made of; all others only part texts.
KNOWN = frozenset(("table", "tr", "td", "th", "caption", "select", "optgroup", "option", *SECTIONS))
WITH_ATTRIBUTES = ("td", "th", "select", "optgroup", "option")
SPAN = re.compile(r"\s*(\d+)")

_short = lru_cache(1 << 14)(html.unescape)


def plain(text: str) -> str:
    """Entities resolved; short texts come again and again."""
    return text if "&" not in text else _short(text) if len(text) < 64 else html.unescape(text)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), plain(a or b or c))
    return out


def tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _span(value: str | None) -> int:
    m = SPAN.match(value or "")
    return min(1000, max(1, int(m[1]))) if m else 1


@lru_cache(1 << 12)
def _tag(raw: str) -> tuple[str | None, str, str]:
    """Name, where it is one of structure, slash and the rest of a tag."""
    m = ONE.fullmatch(raw)
    return (name, m[1], m[3]) if m and (name := m[2].lower()) in KNOWN else (None, "", "")


class Layout:
    """What the tags of a page make: `cells` and `options` fill up in order of the document; their parts are texts of CDATA, or places of texts: text n stands before tag n."""

    def __init__(self, tags: tuple[str, ...]) -> None:
        #: Name, what is known of the element, and the parts of the cell or option that a text here belongs to.
        self.open: list[tuple[str, dict, list | None]] = []
        self.tables: list[dict] = []
        self.cells: list[dict] = []
        self.selects: list[dict] = []
        self.options: list[dict] = []
        self.n_tables = self.n_selects = 0
        self.parts: list[int | str] | None = None
        for n, tag in enumerate(tags, 1):
            name, slash, raw = _tag(tag)
            if name:
                if slash:
                    self._end(name)
                else:
                    self._start(name, attributes(raw) if raw and name in WITH_ATTRIBUTES else {}, raw.endswith("/"))
            elif self.parts is not None and tag.startswith("<![CDATA[") and tag.endswith("]]>"):
                self.parts.append(tag[9:-3])
            if self.parts is not None:
                self.parts.append(n)

    def _close(self) -> None:
        name = self.open.pop()[0]
        self.parts = self.open[-1][2] if self.open else None
        if name == "table":
            self.tables.pop()
        elif name == "select":
            self.selects.pop()

    def _end(self, name: str) -> None:
        """The nearest open element of the name, and all that is open in it; a cell's end tag never ends the table around it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k][0] == "table" and name in ("td", "th", "tr", "caption", *SECTIONS) or self.open[k][0] == "select" and name in ("option", "optgroup"):
                return

    def _start(self, name: str, attrs: dict[str, str], alone: bool) -> None:
        if name in CLOSES:
            closed, until = CLOSES[name]
            k = last = len(self.open)
            while k and self.open[k - 1][0] not in until:
                k -= 1
                if self.open[k][0] in closed:
                    last = k
            while len(self.open) > last:
                self._close()
        held: dict = {}
        if name in ("td", "th"):
            if self.tables:
                held = self._cell(self.tables[-1], name, attrs)
        elif name == "table":
            held = {"no": self.n_tables, "parent": self.tables[-1]["no"] if self.tables else None, "row": -1, "col": 0, "taken": {}}
            self.n_tables += 1
            self.tables.append(held)
        elif name == "tr" and self.tables:
            t = self.tables[-1]
            t["row"], t["col"] = t["row"] + 1, 0
        elif name == "select":
            held = {"no": self.n_selects, "name": attrs.get("name") or attrs.get("id"), "group": None, "nth": 0}
            self.n_selects += 1
            self.selects.append(held)
        elif name == "optgroup" and self.selects:
            held = {"label": attrs.get("label")}
        elif name == "option" and self.selects:
            s = self.selects[-1]
            group = next((h.get("label") for k, h, _ in reversed(self.open) if k == "optgroup"), None)
            held = {"select_no": s["no"], "select_name": s["name"], "option_no": s["nth"], "value": attrs.get("value"), "group": group, "selected": "selected" in attrs, "disabled": "disabled" in attrs, "attributes": {k: v for k, v in attrs.items() if k[:5] == "data-"}, "parts": []}
            s["nth"] += 1
            self.options.append(held)
        stray = name in ("td", "th", "option", "optgroup") and not held
        if not stray and not (alone and name not in ("td", "th")):
            if name in ("td", "th", "option"):
                self.parts = held["parts"]
            elif name in ("table", "select"):
                self.parts = None
            self.open.append((name, held, self.parts))

    def _cell(self, t: dict, name: str, attrs: dict[str, str]) -> dict:
        """taken: for each column that a cell of an earlier row covers, the last row that it does."""
        row, col, taken = max(t["row"], 0), t["col"], t["taken"]
        while taken and taken.get(col, -1) >= row:
            col += 1
        down, across = (_span(attrs.get("rowspan")), _span(attrs.get("colspan"))) if attrs else (1, 1)
        if down > 1:
            for c in range(col, col + across):
                taken[c] = max(taken.get(c, -1), row + down - 1)
        cell = {"table_no": t["no"], "parent_table": t["parent"], "row_no": row, "col_no": col, "row_span": down, "col_span": across, "is_header": name == "th", "parts": []}
        t["row"], t["col"] = row, col + across
        self.cells.append(cell)
        return cell


#: Pages of a site share their tags, and so their layout; only those of up to MOST tags are kept.
MOST = 1024
_layout = lru_cache(64)(Layout)


class Page:
    """Reads one page: its layout, and the texts between its tags."""

    def __init__(self, text: str) -> None:
        bits = TAG.split(text)
        tags = tuple(bits[1::2])
        self.layout, self.texts = (_layout if len(tags) <= MOST else Layout)(tags), bits[::2]

    def read(self, parts: list[int | str]) -> list[str]:
        return [plain(self.texts[p]) if isinstance(p, int) else p for p in parts]

    @property
    def cells(self) -> list[dict]:
        return [{**c, "parts": self.read(c["parts"])} for c in self.layout.cells]

    @property
    def options(self) -> list[dict]:
        return [{**o, "parts": self.read(o["parts"])} for o in self.layout.options]


CELLS = "table_no int, parent_table int, row_no int, col_no int, row_span int, col_span int, is_header boolean, cell string"
OPTIONS = "select_no int, select_name string, option_no int, option_group string, value string, label string, selected boolean, disabled boolean, attributes string"


#: Rows of a batch that is given back.
ROWS = 1 << 15


def _read(df: DataFrame, key: str, page: str, schema: str, rows_of) -> DataFrame:
    names = [key, *[c.split(" ")[0] for c in schema.split(", ")]]
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []

            def out(b=b, ids=ids, rows=rows) -> pa.RecordBatch:
                columns = zip(*rows, strict=True) if rows else [()] * len(types)
                made = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)
                ids.clear(), rows.clear()
                return made

            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    rows += rows_of(Page(text))
                    ids += [i] * (len(rows) - len(ids))
                    if len(rows) >= ROWS:
                        yield out()
            yield out()

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(page).cast("string")).mapInArrow(run, f"{key} {kind}, {schema}")


PLACE = itemgetter("table_no", "parent_table", "row_no", "col_no", "row_span", "col_span", "is_header")


def table_cells(df: DataFrame, key: str, page: str) -> DataFrame:
    """A row for each cell of every table of every page."""
    return _read(df, key, page, CELLS, lambda p: [(*PLACE(c), tidy(p.read(c["parts"]))) for c in p.layout.cells])


SORTED = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _option(o: dict, label: str) -> tuple:
    data = o["attributes"]
    return (o["select_no"], o["select_name"], o["option_no"], o["group"], label if o["value"] is None else o["value"], label, o["selected"], o["disabled"], SORTED.encode(data) if data else "{}")


def select_options(df: DataFrame, key: str, page: str) -> DataFrame:
    """A row for each option of every list of every page; attributes: data-* as a JSON object in order of name. Without a value the label is the value."""
    return _read(df, key, page, OPTIONS, lambda p: [_option(o, tidy(p.read(o["parts"]))) for o in p.layout.options])
