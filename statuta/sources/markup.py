"""HTML pages as trees of elements, read page by page inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Characters of pages whose rows are handed on together.
SLICE_CHARS = 1 << 20
#: Elements that have no content, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "template"))


class Element:
    """A tag with its attributes, and its content in order: elements and stretches of text."""

    __slots__ = ("tag", "attributes", "parent", "place", "content")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.content = tag, attributes, parent, []
        self.place = len(parent.content) if parent else 0

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def inside(self) -> Iterator[Element | str]:
        """All elements and texts within, in the order of the page; without recursion, since pages may nest deeply."""
        todo = self.content[::-1]
        while todo:
            part = todo.pop()
            yield part
            if isinstance(part, Element):
                todo.extend(reversed(part.content))

    def all(self, tag: str = "", class_: str = "", **attributes: str) -> Iterator[Element]:
        """Elements within of a tag, with a class and with attributes of given values; each may be left out."""
        for part in self.inside():
            if isinstance(part, Element) and tag in ("", part.tag) and (not class_ or class_ in part.classes) and all(part.attributes.get(k) == v for k, v in attributes.items()):
                yield part

    def first(self, tag: str = "", class_: str = "", **attributes: str) -> Element | None:
        return next(self.all(tag, class_, **attributes), None)

    def following(self) -> Iterator[Element]:
        """The elements behind this one within its parent."""
        if self.parent is not None:
            for k in range(self.place + 1, len(self.parent.content)):
                if isinstance(found := self.parent.content[k], Element):
                    yield found

    def above(self, tag: str) -> Element | None:
        """The nearest element of a tag that this one is in."""
        at = self.parent
        while at is not None and at.tag != tag:
            at = at.parent
        return at

    def text(self, joint: str = " ") -> str:
        """Stretches of text without the white space around them, blank ones left out, joined."""
        return joint.join(filter(None, (x.strip() for x in self.inside() if isinstance(x, str))))

    def release(self) -> None:
        """Part all elements within from each other. A tree is a cycle, and many would wait for the collector together."""
        todo = [self]
        while todo:
            at = todo.pop()
            todo.extend(x for x in at.content if isinstance(x, Element))
            at.parent, at.content = None, []

    def whole_text(self) -> str:
        """All text as it stands, without the white space around it."""
        return "".join(x for x in self.inside() if isinstance(x, str)).strip()


class _Builder(HTMLParser):
    """An end tag closes the nearest open element of its kind and all within it; without one it counts for nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held and self.at.tag not in UNSEEN:
            self.at.content.append("".join(self.held))
        self.held = []

    def handle_starttag(self, tag, attributes):
        self.flush()
        self.at.content.append(new := Element(tag, {k: v or "" for k, v in attributes}, self.at))
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self.flush()
        found = self.at
        while found is not None and found.tag != tag:
            found = found.parent
        if found is not None and found.parent is not None:
            self.at = found.parent

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self.flush()


def tree(html: str | None) -> Element:
    """The root of a page's elements; any quoting of attributes, all character references, however deep the nesting."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    return builder.root


def read(pages: DataFrame, rows_of: Callable[[Element], list[dict]], schema: str, html: str = "html") -> DataFrame:
    """(page_id, the columns of ``schema``): what ``rows_of`` finds in each page's tree, in Arrow batches, without a shuffle.

    One tree at a time is held, and the rows of SLICE_CHARS characters of pages, however many pages a batch has.
    """
    fields = pages.sparkSession.createDataFrame([], schema).schema
    whole = StructType([StructField("page_id", pages.schema["page_id"].dataType), *fields])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, chars = [], 0
            for page, text in zip(*batch.columns):
                text = text.as_py() or ""
                root = tree(text)
                found += [{"page_id": page.as_py(), **row} for row in rows_of(root)]
                root.release()
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)
                    found, chars = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return pages.select("page_id", html).mapInArrow(run, whole)
