"""Page parts by selector paths on the page's own structure.

A page is read once as a stream of tags with a stack of open elements, so parts may be nested, attributes
quoted or not, and end tags missing: a new paragraph, list item, table row or cell ends the one
before it, an end tag ends everything opened since its start tag, and one without a start tag is
ignored. The result is a flat table of elements (parent, tag, attributes, range of texts) on which paths
are evaluated step by step, each in one pass. Script and style texts are no text.

A path is a row of steps ``/tag`` (child) or ``//tag`` (descendant), ``*`` for any tag, each with conditions
``[n]`` (n-th such child of its parent), ``[@name]``, ``[@name="value"]``, ``[contains(@name, "value")]``;
a last step ``/@name`` asks for an attribute instead of the text.

NULL pages have no fields and no items; an element without text, or with an empty attribute, is no hit.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements without an end tag, block elements that end a paragraph, elements that end
# earlier ones (ended tags, tags that shield them), and elements that an end tag does not reach across.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
CELLS = {"td", "th", "caption"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
PARAGRAPH = ({"p"}, CELLS | {"table", "button", "object"})
TABLE_TAGS = CELLS | {"table", "tbody", "thead", "tfoot", "tr", "html", "body"}

ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]*);", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>
                       |<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
STEP = re.compile(r"""(//?)(?:@([\w:-]+)\Z|([\w:-]+|\*)((?:\[(?:[^\]"]|"[^"]*")*\])*))""")
CONDITION = re.compile(r"""\[(?:(\d+)|@([\w:-]+)(?:="([^"]*)")?|contains\(@([\w:-]+),\s*"([^"]*)"\))\]""")


class Element(NamedTuple):
    parent: int
    tag: str
    attributes: str
    first: int       # texts[first:ends[i]] are the element's own and its descendants'


def unescape(text: str) -> str:
    """Entities that end in a semicolon as their characters, so ``?a=1&copy=2`` stays as it is."""
    return ENTITY.sub(lambda m: entities.unescape(m[0]), text)


def attribute(element: Element, name: str) -> str | None:
    for found, double, single, bare in ATTRIBUTE.findall(element.attributes):
        if found.lower() == name:
            return unescape(double or single or bare)
    return None


class Page:
    """Elements of one page in document order and the texts between its tags."""

    def __init__(self, text: str):
        self.elements: list[Element] = []
        self.ends: list[int] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._count: Counter[str] = Counter()
        at = 0
        for token in TOKEN.finditer(text):
            self._text(text[at:token.start()])
            at = token.end()
            if token[3]:
                (self._end if token[2] else self._start)(token[3].lower(), token[4])
        self._text(text[at:])
        self._close(0)

    def _text(self, piece: str) -> None:
        if piece:
            self.texts.append(unescape(piece))

    def _close(self, depth: int) -> None:
        for i in self._open[depth:]:
            self.ends[i] = len(self.texts)
            self._count[self.elements[i].tag] -= 1
        del self._open[depth:]

    def _depth_of(self, tags: set[str], shields: set[str]) -> int | None:
        """Where the innermost open element of ``tags`` stands on the stack, unless shielded."""
        if not any(self._count[t] for t in tags):
            return None
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.elements[self._open[depth]].tag
            if tag in tags:
                return depth
            if tag in shields:
                return None
        return None

    def _start(self, tag: str, rest: str) -> None:
        rule = PARAGRAPH if tag in ENDS_PARAGRAPH else IMPLIED.get(tag)
        if rule and (depth := self._depth_of(*rule)) is not None:
            self._close(depth)
        i = len(self.elements)
        self.elements.append(Element(self._open[-1] if self._open else -1, tag, rest, len(self.texts)))
        self.ends.append(len(self.texts))
        if tag not in VOID:
            self._open.append(i)
            self._count[tag] += 1

    def _end(self, tag: str, _: str) -> None:
        depth = self._depth_of({tag}, set() if tag in TABLE_TAGS else CELLS)
        if depth is not None:
            self._close(depth)

    def text(self, i: int) -> str:
        return "".join(self.texts[self.elements[i].first:self.ends[i]]).strip(" ")

    def select(self, path: str, start: int = -1) -> list[int]:
        """Elements that ``path`` leads to from element ``start`` (-1: the page), in document order."""
        reached = {start}
        for step in parse(path)[0]:
            inside, found, seen = [False] * len(self.elements), set(), Counter()
            for i in range(start + 1, len(self.elements)):
                e = self.elements[i]
                if e.parent < start:
                    break                               # behind the last descendant of ``start``
                inside[i] = e.parent in reached or (step.deep and e.parent > start and inside[e.parent])
                if inside[i] and step.tag in ("*", e.tag) and self._holds(i, step.conditions, seen):
                    found.add(i)
            reached = found
        return sorted(reached - {-1})

    def _holds(self, i: int, conditions: list[tuple], seen: Counter) -> bool:
        e = self.elements[i]
        for n, (place, name, value, part) in enumerate(conditions):
            if place:
                seen[e.parent, n] += 1
                if seen[e.parent, n] != place:
                    return False
                continue
            held = attribute(e, name)
            if held is None or (value is not None and held != value) or (part is not None and part not in held):
                return False
        return True

    def first(self, paths: list[str], start: int = -1) -> str | None:
        """Text or attribute of the first element with one, by the first path that has any."""
        for path in paths:
            name = parse(path)[1]
            for i in self.select(path, start):
                value = attribute(self.elements[i], name) if name else self.text(i)
                if value:
                    return value
        return None


class Step(NamedTuple):
    deep: bool
    tag: str
    conditions: list[tuple]


@cache
def parse(path: str) -> tuple[list[Step], str | None]:
    """Steps of a path and the attribute that it asks for; a path that is not one raises."""
    steps, name, at = [], None, 0
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"not a selector path: {path!r} from {path[at:]!r}")
        at = m.end()
        if m[2]:
            name = m[2].lower()
            continue
        conditions, rest = [], m[4]
        while rest:
            c = CONDITION.match(rest)
            if not c:
                raise ValueError(f"not a condition: {rest!r}")
            conditions.append((int(c[1]) if c[1] else None, (c[2] or c[4] or "").lower(), c[3], c[5]))
            rest = rest[c.end():]
        steps.append(Step(m[1] == "//", m[3].lower(), conditions))
    return steps, name


def _check(spec: dict[str, list[str]]) -> None:
    for paths in spec.values():
        for path in paths:
            parse(path)


def fields_by_path(pages: DataFrame, spec: dict[str, list[str]], html: str = "html", key: str = "page_id") -> DataFrame:
    """One column per field of ``spec``: its first path with a non-empty result, NULL if none has one."""
    _check(spec)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [None if t is None else Page(t) for t in batch.column(1).to_pylist()]
            fields = [pa.array([page and page.first(paths) for page in read], pa.string()) for paths in spec.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fields], names=[key, *spec])

    return _mapped(pages, rows, html, key, [], spec)


def items_by_path(pages: DataFrame, item: str, spec: dict[str, list[str]], html: str = "html",
                  key: str = "page_id") -> DataFrame:
    """One row per element at ``item``, with its 0-based ``position`` and the fields of ``spec``, whose paths
    start at the element (A04). Items inside items are items of their own if the path leads to them."""
    _check({"item": [item], **spec})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, places, fields = [], [], [[] for _ in spec]
            for row, text in enumerate(batch.column(1).to_pylist()):
                page = Page(text or "")
                for n, i in enumerate(page.select(item)):
                    of.append(row)
                    places.append(n)
                    for values, paths in zip(fields, spec.values()):
                        values.append(page.first(paths, i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(places, pa.int32()),
                 *[pa.array(values, pa.string()) for values in fields]], names=[key, "position", *spec])

    return _mapped(pages, rows, html, key, [T.StructField("position", T.IntegerType())], spec)


def _mapped(pages: DataFrame, rows, html: str, key: str, more: list[T.StructField], spec) -> DataFrame:
    asked = pages.select(key, html)
    fields = [T.StructField(name, T.StringType()) for name in spec]
    return asked.mapInArrow(rows, T.StructType([asked.schema[key], *more, *fields]))
