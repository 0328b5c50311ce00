"""Rows from pages: items under the headings of their sections, and records of scripts that hold escaped JSON."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements without content; those whose content isn't text; which open ones a new one ends, and what it looks no further than.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {name: re.compile(f"</{name}[^>]*>", re.IGNORECASE) for name in ("script", "style")}
ENDS = {"li": (("li",), ("ul", "ol")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ENDS |= {block: (("p",), ("div", "article", "section", "li", "td", "body")) for block in "p ul ol dl table div section article aside nav header footer form h1 h2 h3 h4 h5 h6".split()}
#: Table rows without attributes, whose cells hold text and at most these elements, side by side. Up to 1000 are read at once, to what the fold gives.
PLAIN = frozenset("a b em i small span strong sub sup u".split())
ROWS = re.compile(rf"(?:<tr>[^<]*+(?:<td>[^<]*+(?:<({'|'.join(sorted(PLAIN))})>[^<]*+</\1>[^<]*+)*+</td>[^<]*+)*+</tr>[^<]*+){{1,1000}}+")
SCHEMA = "n long, tag string, path array<string>, within string, class string, title string, refs array<string>, text string"


def tokens(page: str, rows: Callable[[], bool] | None = None) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}) in order; ("fault", "", {}) last where a tag, comment or script doesn't end.

    Where rows() holds, plain table rows that follow come as one ("rows", ROWS' match, {}).
    """
    at, fault = 0, ("fault", "", {})
    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : lt if lt >= 0 else len(page)], {}
        if lt < 0:
            return
        if found := TAG.match(page, lt):
            closing, name, told = found.groups()
            at, name = found.end(), name.lower()
            if closing:
                yield "close", name, {}
            elif name in RAW:
                end = RAW[name].search(page, at)
                if not end:
                    yield fault
                    return
                at = end.end()
            elif rows and name == "tr" and rows() and (run := ROWS.match(page, lt)):
                yield "rows", run[0], {}
                at = run.end()
            else:
                yield "open", name, {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(told)} if told else {}
        elif page.startswith("<!", lt):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 2 + 2 * comment)
            if end < 0:
                yield fault
                return
            at = end + (3 if comment else 1)
        elif page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":
            yield fault
            return
        else:
            yield "text", "<", {}
            at = lt + 1


@dataclass(slots=True)
class Element:
    name: str
    attributes: dict[str, str]
    level: int | None
    item: bool
    text: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    headings: dict[int, str] = field(default_factory=dict)


def _words(text: str) -> str:
    """Text with its character references undone, a blank between words."""
    return " ".join(html.unescape(text).split())


def _cell(rest: str) -> str:
    """The text of a plain cell, from its start on."""
    return _words(TAG.sub(" ", rest.partition("</td>")[0]))


_known_cell = lru_cache(4096)(_cell)


def _cells(rows: str) -> list[str]:
    """The texts of plain rows' cells, of which most are short and recur."""
    return [_known_cell(x) if len(x) < 100 else _cell(x) for x in rows.split("<td>")[1:]]


def items(page: str, wanted: Sequence[str], headings: Mapping[str, int]) -> Iterator[tuple]:
    """Rows of SCHEMA: the elements of `wanted` tags as they end, each with the headings above it, outermost first.

    headings gives tags, or classes with a point before them, their level. A heading holds within the element that it stands in, until one of its
    level or above it there. A tag's end that nothing has begun, and what tokens() calls a fault, end the page: what ended before that stays.
    """
    n = 0
    for *told, texts in _fold(page, wanted, headings):
        for text in texts:
            yield n, *told, text
            n += 1


def cells(page: str) -> Iterator[str]:
    """The texts of a page's table cells as they end, as items() has them."""
    return chain.from_iterable(x[-1] for x in _fold(page, ("td",), {}))


def _fold(page: str, wanted: Sequence[str], headings: Mapping[str, int]) -> Iterator[tuple]:
    """What items() gives, unnumbered, with a list of texts: one, or those of plain rows' cells, which have the rest in common."""
    stack, taking = [Element("", {}, None, False)], []

    def around() -> tuple[list[str], str | None]:
        """The headings above, and the nearest class."""
        path = [s.headings[k] for s in stack if s.headings for k in sorted(s.headings)]
        return path, next((s.attributes["class"] for s in reversed(stack) if s.attributes.get("class")), None)

    def closed(upto: int) -> Iterator[tuple]:
        while len(stack) > upto:
            e = stack.pop()
            if not (e.item or e.level is not None):
                continue
            taking.pop()
            text = _words("".join(e.text))
            if e.level is not None:
                held = stack[-1].headings
                for k in [k for k in held if k >= e.level]:
                    del held[k]
                held[e.level] = text
            if e.item:
                yield e.name, *around(), e.attributes.get("class"), e.attributes.get("title"), e.refs, [text]

    def place(names: Sequence[str], bounds: Sequence[str] = ()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].name
            if name in names:
                return k
            if name in bounds:
                break
        return 0

    # plain rows are read at once where no open element takes their text and their start ends no other row
    plain = "td" in wanted and "td" not in headings and not any(x in PLAIN or x == "tr" for x in (*wanted, *headings))
    for kind, value, attributes in tokens(page, (lambda: not taking and not place(*ENDS["tr"])) if plain else None):
        if kind == "fault":
            return
        if kind == "rows":
            yield "td", *around(), None, None, [], _cells(value)
            continue
        if kind == "text":
            for e in taking:
                e.text.append(value)
        elif kind == "open":
            for e in taking:
                e.text.append(" ")
                e.refs += [attributes[k] for k in ("src", "href") if attributes.get(k)]
            if value in VOID:
                continue
            if value in ENDS and (k := place(*ENDS[value])):
                yield from closed(k)
            level = headings.get(value)
            if level is None and "class" in attributes:
                level = next((headings[k] for c in attributes["class"].split() if (k := f".{c}") in headings), None)
            item = value in wanted and level is None
            stack.append(Element(value, attributes, level, item))
            if item or level is not None:
                taking.append(stack[-1])
                stack[-1].refs += [attributes[k] for k in ("src", "href") if attributes.get(k)]
        elif k := place((value,)):
            for e in taking:
                e.text.append(" ")
            yield from closed(k)
        elif value not in VOID and value != "p":
            return
    yield from closed(1)


def _batches(batches: Iterator[pa.RecordBatch], kinds: Sequence[tuple[str, pa.DataType]], rows: Callable[[str], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches (key, *kinds) of up to 5000 rows, of many pages or of a part of one, from batches (key, page)."""
    for batch in batches:
        schema = pa.schema([(batch.schema.names[0], batch.column(0).type), *kinds])
        found = ((key, *row) for key, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for row in rows(page.as_py() or ""))
        while part := list(islice(found, 5000)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def item_batches(batches: Iterator[pa.RecordBatch], wanted: Sequence[str], headings: Mapping[str, int]) -> Iterator[pa.RecordBatch]:
    """Batches (key, and the columns of SCHEMA) of up to 5000 items, of many pages or of a part of one, from batches (key, page)."""
    kinds = [("n", pa.int64()), ("tag", pa.string()), ("path", pa.list_(pa.string())), ("within", pa.string()), ("class", pa.string()), ("title", pa.string()), ("refs", pa.list_(pa.string())), ("text", pa.string())]
    return _batches(batches, kinds, lambda page: items(page, wanted, headings))


def page_items(pages: DataFrame, key: str, page: str, wanted: Sequence[str] = ("li", "td", "p"), headings: Mapping[str, int] | None = None) -> DataFrame:
    """(key, and the columns of SCHEMA): the items of each page in order, see items(). A null page has none; pages are read a row at a time, each in time linear in its length times its depth."""
    levels = {f"h{k}": k for k in range(1, 7)} if headings is None else dict(headings)
    rows = pages.select(F.col(key).alias("key"), F.col(page).alias("page"))
    return rows.mapInArrow(lambda batches: item_batches(batches, wanted, levels), f"key {rows.schema['key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)


def table_rows(pages: DataFrame, key: str, page: str, names: Sequence[str | None]) -> DataFrame:
    """(key, *names): the texts of each page's table cells, a row each len(names) of them in order, without a shuffle; cells that a page's last row lacks are null, those named None are left out.

    Cells are counted within a page as they end, so a table with rows of another length has to be split before.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(page).alias("page"))
    told, keep = [x for x in names if x], [k for k, x in enumerate(names) if x]
    found = lambda text: ([row[k] for k in keep] for row in zip_longest(*[cells(text)] * len(names)))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{x} string" for x in told)
    return rows.mapInArrow(lambda batches: _batches(batches, [(x, pa.string()) for x in told], found), schema).withColumnRenamed("key", key)


def lineups(items_: DataFrame, key: str, slots: Mapping[str, str]) -> DataFrame:
    """(key, club, slot, name, code) of list items: the club is the outermost heading, the slot what `slots` has for the innermost other heading or for the list's class.

    The name is the item's title, "Surname (Forename)" turned round, or else its text without percentages; the code is the number of a picture
    named by it. Items without a club, a slot or both name and code are left out.
    """
    known = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])
    heads = F.when(F.size("path") > 1, F.try_element_at(known, F.lower(F.element_at("path", -1))))
    lists = F.get(F.filter(F.transform(F.split(F.coalesce("within", F.lit("")), " "), lambda c: F.try_element_at(known, F.concat(F.lit("."), c))), lambda s: s.isNotNull()), F.lit(0))
    turned = F.trim(F.regexp_replace("title", r"^(.*?)\s*\(([^)]*)\)\s*$", "$2 $1"))
    said = F.trim(F.regexp_replace("text", r"\s*\d+\s*%", ""))
    code = F.nullif(F.regexp_extract(F.array_join("refs", " "), r"/(\d+)\.(?:png|jpg)", 1), F.lit("")).cast("bigint")
    rows = items_.where("tag = 'li' and size(path) > 0").select(key, "n", F.element_at("path", 1).alias("club"), F.coalesce(heads, lists).alias("slot"), F.nullif(F.coalesce(turned, said), F.lit("")).alias("name"), code.alias("code"))
    return rows.where("club <> '' and slot is not null and (name is not null or code is not null)").select(key, "n", "club", "slot", "name", "code")


def spells(items_: DataFrame, key: str, columns: int = 6) -> DataFrame:
    """(key, season, injury, days, games) of table cells, `columns` a row: rows without a readable duration ("12 days") in their fifth cell are left out, so is a row of headings; unreadable games are 0.

    Cells are numbered within a page, so a row of the table is `columns` of them in order; a table with other rows has to be split before.
    """
    cells = items_.where("tag = 'td'").select(key, F.floor(F.col("n") / columns).alias("row"), (F.col("n") % columns).cast("int").alias("k"), "text")
    named = {0: "season", 1: "injury", 4: "days", 5: "games"}
    return _spells(cells.groupBy(key, "row").agg(*[F.max(F.when(F.col("k") == k, F.col("text"))).alias(c) for k, c in named.items()]), key)


def page_spells(pages: DataFrame, key: str, page: str) -> DataFrame:
    """spells() of the pages' table cells, six a row. A row's cells stay together, so none is shuffled."""
    return _spells(table_rows(pages, key, page, ["season", "injury", None, None, "days", "games"]), key)


def _spells(rows: DataFrame, key: str) -> DataFrame:
    read = rows.where(F.lower("season") != "season").where(F.col("days").rlike(r"\d\s*day"))
    games = F.coalesce(F.regexp_replace("games", "[^0-9]+", "").try_cast("double"), F.lit(0.0))
    return read.select(key, "season", F.lower("injury").alias("injury"), F.regexp_extract("days", r"(\d+)\s*day", 1).cast("double").alias("days"), games.alias("games"))


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x worked out once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def unescaped(text: Column) -> Column:
    """HTML character references undone: numbers of up to six digits, and amp, lt, gt, quot, apos, nbsp (as a blank)."""
    named = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
    parts = F.split(F.regexp_replace(text, rf"(&#x?[0-9a-fA-F]{{1,6}};|&(?:{'|'.join(named)});)", "\x01$1\x01"), "\x01")
    known = F.create_map(*[F.lit(v) for k, c in named.items() for v in (f"&{k};", c)])

    def char(point: Column, x: Column) -> Column:
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        far = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(point.between(1, 127), F.char(point.cast("bigint"))).when(valid, far).otherwise(x)

    def one(x: Column) -> Column:
        # a branch is worked out only where those before it don't hold, so most parts cost a comparison or two
        number = lambda skip: F.substring(x, F.lit(skip + 1), F.length(x) - skip - 1)
        point = F.when(x.startswith("&#x"), F.conv(number(3), 16, 10)).otherwise(number(2)).try_cast("int")
        numeric = x.startswith("&#") & x.rlike("^&#x?[0-9a-fA-F]{1,6};$")
        return F.when(~x.startswith("&"), x).when(numeric, _once(point, lambda p: char(p, x))).otherwise(F.coalesce(F.try_element_at(known, x), x))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def embedded_json(page: Column, variable: str, schema: str) -> Column:
    """What a script gives to `variable` by JSON.parse('...'), read under a schema; null where the page, the script or the JSON is broken.

    The argument is a JavaScript string: its hexadecimal escapes become JSON's, quotes and raw tabs are escaped, and JSON's own reader undoes them.
    """
    found = F.regexp_extract(page, rf"\b{variable}\s*=\s*JSON\.parse\(\s*'([^'\\]*+(?:\\.[^'\\]*+)*+)'\s*\)", 1)
    # patterns are left to what plain replacement wouldn't get right: an x after an escaped backslash that is no number, and raw quotes
    escapes = lambda x: F.when(x.contains(r"\\x") & x.rlike(r"\\\\x(?![0-9a-fA-F]{2})"), F.regexp_replace(x, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")).otherwise(F.replace(x, F.lit(r"\x"), F.lit(r"\u00")))
    quotes = lambda x: F.when(x.contains('"'), F.regexp_replace(x, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')).otherwise(x)
    quoted = F.replace(_once(F.replace(_once(found, escapes), F.lit(r"\'"), F.lit("'")), quotes), F.lit("\t"), F.lit("\\t"))
    text = F.get(F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>"), F.lit(0))
    return F.from_json(_once(text, lambda x: F.nullif(x, F.lit(""))), schema, {"mode": "PERMISSIVE"})
