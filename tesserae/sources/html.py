"""HTML documents to segments and table grids, by the standard library's parser, run over Arrow batches."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

# A paragraph has this many characters at least; a longer one than the second goes on in a further segment.
LEAST, MOST = 50, 10_000
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "body", "blockquote", "pre", "td", "th", "tr", "table", "ul", "ol", "br"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def decode(data: bytes) -> str:
    """By byte-order mark, then UTF-8, then Windows-1252."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


# Tags with attributes in their plainest forms; elements whose content the parser reads in another way.
TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z-]+(?:="[^"<>]*"|=[a-zA-Z0-9_.-]+)?)*)>')
ATTRIBUTE = re.compile(r'([a-zA-Z-]+)(?:="([^"]*)"|=([a-zA-Z0-9_.-]+))?')
UNLIKE = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp", "svg", "math"}


def read(parser: HTMLParser, html: str) -> None:
    """``parser.feed`` and ``close``. Markup of nothing but plain tags and text is cut by one pattern, which calls the same
    handlers in the same order and is some ten times as fast; all other markup goes to the parser."""
    parts = TAG.split(html)
    if html.count("<") * 4 != len(parts) - 1 or not UNLIKE.isdisjoint(x.lower() for x in set(parts[2::4])):
        parser.feed(html)
        parser.close()
        return
    plain = "&" not in html
    text = parts[0]
    for k in range(1, len(parts) + 1, 4):
        if text:
            parser.handle_data(text if plain else unescape(text))
        if k == len(parts):
            break
        close, tag, attributes, text = parts[k : k + 4]
        if not close:
            found = ATTRIBUTE.findall(attributes) if attributes else ()
            # A name without a value has None, one with an empty value the empty text.
            parser.handle_starttag(tag.lower(), [(n.lower(), (q if plain else unescape(q)) or v or ("" if f'{n}=""' in attributes else None)) for n, q, v in found])
        else:
            parser.handle_endtag(tag.lower())


class _Segments(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.kind, self.skip, self.table, self.cells = [], [], "paragraph", 0, 0, []

    def flush(self):
        if not self.text:
            self.kind = "paragraph"
            return
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and (self.kind != "paragraph" or len(text) >= LEAST):
            self.out += [(self.kind, text[k : k + MOST]) for k in range(0, len(text), MOST)]
        self.kind = "paragraph"

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            if not self.table:
                self.flush()
                self.cells = []
            self.table += 1
        elif self.table:
            if tag == "tr":
                self.cells.append("[ROW]")
            elif tag in ("td", "th"):
                self.cells.append("[CELL]")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(("image", f"{a.get('src') or ''}|{a.get('alt') or ''}"))
        elif tag in BLOCKS:
            self.flush()
            if tag in HEADINGS:
                self.kind = "heading"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.table:
            self.table -= 1
            if not self.table:
                text = " ".join(" ".join(self.cells).split())
                if text:
                    self.out.append(("table", text))
        elif tag in BLOCKS and not self.table:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.cells if self.table else self.text).append(data)


def segments_of(html: str) -> list[tuple[str, str]]:
    """(kind, text) of headings, paragraphs, tables with [ROW] and [CELL] marks, and images, in order."""
    p = _Segments()
    read(p, html or "")
    p.flush()
    return p.out


def segments(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, seq, kind and text of every segment. Null and broken markup yields what can be read."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            found = [segments_of(h) for h in batch.column(1).to_pylist()]
            page, seq = [k for k, s in enumerate(found) for _ in s], [i for s in found for i in range(len(s))]
            kinds, texts = [x for s in found for x, _ in s], [x for s in found for _, x in s]
            columns = [batch.column(0).take(pa.array(page, pa.int64())), pa.array(seq, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "seq", "kind", "text"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, seq long, kind string, text string")


class _Images(HTMLParser):
    """Images and headings in order, and the document's text, in which each image has a place."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.length, self.skip, self.heading = [], [], 0, 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "img":
            a = dict(attrs)
            pixels = lambda n: int(m[0]) if (m := re.match(r"\d{1,9}", (a.get(n) or "").strip())) else 0
            self.found.append(("image", self.length, (a.get("src") or "").split("?")[0].rsplit("/", 1)[-1], a.get("alt") or "", pixels("width"), pixels("height")))
        elif tag in HEADINGS:
            self.heading = []
        if tag in BLOCKS:
            self.say(" ")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in HEADINGS and self.heading is not None:
            self.found.append(("heading", self.length, " ".join("".join(self.heading).split()), "", 0, 0))
            self.heading = None
        if tag in BLOCKS:
            self.say(" ")

    def handle_data(self, data):
        if not self.skip:
            self.say(data)
            if self.heading is not None:
                self.heading.append(data)

    def say(self, data):
        self.text.append(data)
        self.length += len(data)


NEARBY = 500  # fixed value: characters on either side of an image


def images_of(html: str) -> list[tuple]:
    """kind (image or heading), text (file name or heading), nearby (alternative text and the text around it), width and height (0: not
    said) in document order, and the document's characters."""
    p = _Images()
    read(p, html or "")
    text = "".join(p.text)
    near = lambda at, alt: " ".join(f"{alt} {text[max(0, at - NEARBY) : at + NEARBY]}".split())
    chars = len(" ".join(text.split()))
    return [(kind, name, near(at, alt) if kind == "image" else "", width, height, chars) for kind, at, name, alt, width, height in p.found]


def images(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, seq, kind, text, nearby, width, height and chars of every image and heading."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def run(batches):
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            found = [images_of(h) for h in batch.column(1).to_pylist()]
            page, seq = [k for k, s in enumerate(found) for _ in s], [i for s in found for i in range(len(s))]
            rows = [pa.array(x, t) for x, t in zip(list(zip(*[x for s in found for x in s], strict=True)) or [()] * len(types), types, strict=True)]
            columns = [batch.column(0).take(pa.array(page, pa.int64())), pa.array(seq, pa.int64()), *rows]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "seq", "kind", "text", "nearby", "width", "height", "chars"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, seq long, kind string, text string, nearby string, width long, height long, chars long")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            down, across = (_span(a.get("rowspan")), _span(a.get("colspan"))) if attrs and (a := dict(attrs)) else (1, 1)
            self.cell = [tag == "th", down, across, []]
            self.open[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[3].append(data)


def _span(said: str | None) -> int:
    return max(1, min(1000, int(said))) if (said or "").isdigit() else 1


def _grid(rows) -> list[list[tuple[str, bool]]]:
    """Text and kind (header) of every place of a table, row by row, spans resolved; none where no cell is."""
    said = [[(" ".join("".join(text).split()), head) for head, _, _, text in row] for row in rows]
    if all(down == across == 1 for row in rows for _, down, across, _ in row):
        while said and not said[-1]:
            said.pop()
        width = max(map(len, said), default=0)
        return [row + [("", False)] * (width - len(row)) for row in said]
    grid: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(rows):
        c = 0
        for (_, down, across, _), cell in zip(row, said[r], strict=True):
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(across):
                    grid.setdefault((r + i, c + j), cell)
            c += across
    height, width = (max((place[k] for place in grid), default=-1) + 1 for k in (0, 1))
    return [[grid.get((r, c), ("", False)) for c in range(width)] for r in range(height)]


def _numeric(text: str) -> bool:
    return any(map(str.isdigit, text)) and sum(map(str.isalpha, text)) <= 2


def _path(texts) -> list[str]:
    return list(dict.fromkeys(t for t in texts if t))


# What is known of every cell: its place, text and kind, the texts of headers above and of stubs to the left, the texts beside it (null at the
# edges), and the number of its table's header rows.
CELL = {
    "row": pa.int64(), "col": pa.int64(), "text": pa.string(), "is_header": pa.bool_(), "is_stub": pa.bool_(), "header_path": pa.list_(pa.string()), "stub_path": pa.list_(pa.string()),
    "left": pa.string(), "right": pa.string(), "heads": pa.int64(),
}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}


def _columns(rows, out: dict[str, list], empty: bool = True) -> int:
    """Adds those of CELL that ``out`` asks for, for all cells of a table (or those with a text), and gives their number. Header rows are those of more than half
    header cells or, without any, leading rows without numbers among the first eight. Stub columns are leading columns of more
    than half words (more than three quarters in tables of eight columns or more)."""
    grid = _grid(rows)
    if not grid:
        return 0
    height, width = len(grid), len(grid[0])
    said = [[t for t, _ in row] for row in grid]
    heads = [r for r, row in enumerate(grid) if sum(h for _, h in row) * 2 > width]
    if not heads:
        for r in range(min(8, height - 1)):
            if any(map(_numeric, said[r])) or not any(said[r]):
                break
            heads.append(r)
    is_head = set(heads)
    body = [r for r in range(height) if r not in is_head]
    n, share = 0, 0.75 if width >= 8 else 0.5  # n: stub columns
    while body and n < width - 1 and sum(bool(said[r][n]) and not _numeric(said[r][n]) for r in body) > share * len(body):
        n += 1
    # Stubs are the leading columns. A column's path changes at its headers only, a row's at its stubs only.
    above, stubs, known, whole = [[] for _ in range(width)], [True] * n + [False] * (width - n), 0, range(width)
    for r, texts in enumerate(said):
        head = r in is_head
        kept = whole if empty or all(texts) else [c for c in whole if texts[c]]
        known += len(kept)
        pick = (lambda x: x) if len(kept) == width else (lambda x: [x[c] for c in kept])  # noqa: B023, E731
        for name, to in out.items():
            match name:
                case "row":
                    to += [r] * len(kept)
                case "col":
                    to += kept
                case "text":
                    to += pick(texts)
                case "is_header":
                    to += [head] * len(kept)
                case "is_stub":
                    to += [False] * len(kept) if head else pick(stubs)
                case "header_path":
                    to += pick(above)
                case "stub_path":
                    before = [_path(texts[:c]) for c in range(n + 1)]
                    to += pick(before[:-1] + before[-1:] * (width - n))
                case "left":
                    to += pick([None, *texts[:-1]])
                case "right":
                    to += pick([*texts[1:], None])
                case "heads":
                    to += [len(heads)] * len(kept)
        if head:
            above = [_path([*above[c], texts[c]]) for c in range(width)]
    return known


def tables_of(html: str) -> list[list[dict]]:
    """Cells of each table after spans are resolved: row, col, text, is_header, is_stub, and the texts of headers above
    and stubs to the left."""
    p = _Tables()
    read(p, html or "")
    out = []
    for rows in p.tables:
        cells = {c: [] for c in list(CELL)[:7]}
        if _columns(rows, cells):
            out.append([dict(zip(cells, x, strict=True)) for x in zip(*cells.values(), strict=True)])
    return out


def table_grid(pages: DataFrame, key: str, html: str = "html", columns=tuple(CELL), empty: bool = True) -> DataFrame:
    """key, table, and the cells of every table as rows, with these columns of CELL; on demand without those that have no text."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            page, table, cells = [], [], {c: [] for c in columns}
            for k, h in enumerate(batch.column(1).to_pylist()):
                p = _Tables()
                read(p, h or "")
                for t, rows in enumerate(x for x in p.tables if any(x)):
                    n = _columns(rows, cells, empty)
                    page += [k] * n
                    table += [t] * n
            found = [batch.column(0).take(pa.array(page, pa.int64())), pa.array(table, pa.int64()), *[pa.array(x, CELL[c]) for c, x in cells.items()]]
            yield pa.RecordBatch.from_arrays(found, names=[key, "table", *columns])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, table long, " + ", ".join(f"`{c}` {_SQL[CELL[c]]}" for c in columns))
