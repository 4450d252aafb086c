"""Web pages as blocks, statute pages as articles with versions, and listings."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.korean import IN_FORCE, dates_in
from statuta.functions.lineage import cut
from statuta.functions.text import strip
from statuta.sources import markup
from statuta.sources.markup import Element

NAV = r'<a href="([^"]*)">([^<]*)</a>'
#: What is no text, where a heading or paragraph begins, and where one ends.
UNSEEN = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BEGINS, ENDS = r"<(h1|p)(?: [^>]*)?>", r"</?(?:h1|p|div|article|nav|ul|table|body|html|head)(?: [^>]*)?>"
TAG = r"<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Fixed values of statute pages: anchors of articles (number, branch), the addenda's part and anchors in it that are
#: none, class names of groups, text and titles, and the note of an upcoming version.
ARTICLE_ANCHOR = re.compile(r"J(\d+):(\d+)")
ADDENDA_AREA, NO_ADDENDUM = "arDivArea", "arArea"
GROUP, UPCOMING_GROUP, CONTENT, TITLE, ADDENDUM_HEAD, ADDENDUM_LINE = "pgroup", "babl", "lawcon", "bl", "pty3", "pty3_dep"
UPCOMING_NOTE = re.compile(r"\[시행일:\s*(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.\]")
#: Fixed values of listing pages: the first header of the table that counts, and the icon of an upcoming row.
FIRST_HEADER, UPCOMING_ICON = "번호", "앞으로 시행될 법령"
#: Fixed values of the list beside a page: its part, its rows, a row's dates, and the note of the day in force.
LEFT_LIST, LEFT_ROW, LEFT_DATES = "listDiv", re.compile(r"liBgcolor\d+"), "tx2"
IN_FORCE_NOTE = re.compile(r"\[시행\s*(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.\]")


def unescaped(text: Column) -> Column:
    """The common character references as characters."""
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def inner_text(html: Column, joint: str = " ") -> Column:
    """The pieces of text between tags, trimmed, blank ones left out, joined."""
    pieces = F.filter(F.transform(F.split(html, TAG), lambda x: strip(unescaped(x))), lambda x: x != "")
    return F.array_join(pieces, joint)


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, tag, text): headings and paragraphs in order.

    A block holds all text up to the next tag that opens or closes a block, whatever inline tags it has.
    """
    seen = F.regexp_replace("html", UNSEEN, "")
    marked = F.regexp_replace(F.regexp_replace(seen, BEGINS, "\u0001$1\u0002"), ENDS, "\u0003")
    parts = F.slice(F.split(marked, "\u0001"), 2, F.size(F.split(marked, "\u0001")))
    rows = pages.select("page_id", F.posexplode(parts).alias("block_no", "part"))
    text = F.substring_index(F.substring_index("part", "\u0002", -1), "\u0003", 1)
    return rows.select("page_id", "block_no", F.substring_index("part", "\u0002", 1).alias("tag"), inner_text(text).alias("text"))


STATUTE = (
    "law_id string, law_name string, revision_seq string, promulgation_no string, promulgation_date date, effective_date date,"
    " articles array<struct<jo_no string, jo_br_no string, title string, body string, upcoming boolean, upcoming_title string, upcoming_body string, upcoming_date date>>,"
    " addenda array<struct<id string, body string>>"
)


def _date(*parts: str) -> dt.date | None:
    try:
        return dt.date(*map(int, parts))
    except ValueError:
        return None


def _noted(text: str, note: re.Pattern) -> dt.date | None:
    found = note.search(text)
    return _date(*found.groups()) if found else None


def _lines(paragraphs: Iterable[Element]) -> str:
    return "\n".join(filter(None, (p.text() for p in paragraphs)))


def _version(group: Element) -> tuple[str, str]:
    """Title and body of an article's group: all its paragraphs, however they are nested."""
    root = group.first("div", CONTENT) or group
    title = root.first(class_=TITLE)
    return title.text("") if title else "", _lines(root.all("p"))


def _group_behind(anchor: Element) -> Element | None:
    return next((x for x in anchor.following() if x.tag == "div" and GROUP in x.classes), None)


def _article(anchor: Element, group: Element) -> dict:
    title, body = _version(group)
    row = dict(zip(("jo_no", "jo_br_no"), ARTICLE_ANCHOR.fullmatch(anchor.get("name")).groups()), title=title, body=body, upcoming=False)
    behind = next(group.following(), None)
    if behind is not None and UPCOMING_GROUP in behind.classes:
        coming_title, coming = _version(behind)
        row |= {"upcoming": True, "upcoming_title": coming_title or title, "upcoming_body": coming, "upcoming_date": _noted(coming, UPCOMING_NOTE)}
    return row


def _addendum(anchor: Element, group: Element) -> dict:
    head = group.first("p", ADDENDUM_HEAD)
    more = (p for p in group.all("p") if any(c.startswith(ADDENDUM_LINE) for c in p.classes))
    return {"id": anchor.get("name")[1:], "body": _lines([*([head] if head else []), *more])}


def _statute(page: Element) -> list[dict]:
    def value(name: str) -> str:
        found = page.first("input", id=name)
        return found.get("value") if found else ""

    def date(name: str) -> dt.date | None:
        digits = value(name)
        return _date(digits[:4], digits[4:6], digits[6:]) if re.fullmatch("[0-9]{8}", digits) else None

    area = page.first("div", id=ADDENDA_AREA)
    addenda = [a for a in (area.all("a") if area else ()) if a.get("name").startswith("J") and ":" not in a.get("name") and a.get("name") != NO_ADDENDUM]
    later = set(map(id, area.all("a"))) if area else ()
    articles = [a for a in page.all("a") if ARTICLE_ANCHOR.fullmatch(a.get("name")) and id(a) not in later]
    pairs = lambda anchors: ((a, g) for a in anchors if (g := _group_behind(a)) is not None)
    return [
        {
            **dict(zip(("law_id", "law_name", "revision_seq", "promulgation_no"), map(value, ("lsId", "lsNm", "lsiSeq", "ancNo")))),
            "promulgation_date": date("ancYd"),
            "effective_date": date("efYd"),
            "articles": [_article(a, g) for a, g in pairs(articles)],
            "addenda": [_addendum(a, g) for a, g in pairs(addenda)],
        }
    ]


def statutes(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, law_id, law_name, revision_seq, promulgation_no, promulgation_date, effective_date, articles, addenda).

    Pages are read as trees, so quoting, nesting and character references do not matter. An article is an anchor and
    the next group beside it, with its number, branch, title and body; a group of the upcoming kind directly behind
    that one is its upcoming version, dated by its note (null where it gives none or no date that exists). Addenda are
    the anchors without a branch in their own part of the page, which holds no articles. Pages without a law id have
    empty fields; null pages are empty ones.
    """
    return markup.read(pages, _statute, STATUTE, html)


#: Items are of this kind, whatever they come from.
ITEM = "struct<id:string,title:string,body:string,effective_date:date,superseded_date:date,supersedes:string>"


def statute_items(found: DataFrame) -> DataFrame:
    """Items (id, title, body, effective_date, superseded_date, supersedes) of parsed statute pages: articles, upcoming versions, addenda.

    Pages are gone through once, since reading them is most of the work.
    """
    articles = F.transform("articles", lambda a: _versions(F.col("law_id"), F.col("law_name"), F.col("effective_date"), a.__getitem__))
    addenda = F.transform("addenda", lambda a: F.array(_addendum_item(F.col("law_id"), F.col("law_name"), a["id"], a["body"])))
    either = lambda items: F.coalesce(items, F.array().cast(f"array<array<{ITEM}>>"))
    return found.select(F.inline(F.flatten(F.concat(either(articles), either(addenda)))))


def statute_documents(items: DataFrame, origin: str = "law") -> tuple[DataFrame, DataFrame]:
    """Items as documents (the columns of entities, and origin) and relations (src, type, dst), as a sync takes them."""
    items = cut(items)  # a sync reads both tables more than once
    own = F.concat(F.lit("law:"), F.col("id"))
    documents = items.select(own.alias("entity_id"), F.lit("law").alias("type"), "title", "body", "effective_date", "superseded_date", F.array(F.lit("ALL")).alias("allowed_depts"), F.lit("").alias("source"), F.lit(origin).alias("origin"))
    return documents, items.where("supersedes is not null").select(own.alias("src"), F.lit("supersedes").alias("type"), F.col("supersedes").alias("dst"))


def _item(*values: Column) -> Column:
    names = [part.split(":")[0] for part in ITEM.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[value.alias(name) for value, name in zip(values, names)]).cast(ITEM)


def _versions(law_id: Column, law_name: Column, effective_date: Column, of: Callable[[str], Column]) -> Column:
    """Array of an article's items; ``of`` gives its fields."""
    base = F.concat_ws("-", law_id, of("jo_no").cast("string"), of("jo_br_no").cast("string"))
    item = lambda at: F.concat(base, F.lit("@"), at.cast("string"))
    named = lambda title: strip(F.concat_ws(" ", law_name, title))
    none, until = F.lit(None), of("upcoming_date")
    current = _item(item(effective_date), named(of("title")), of("body"), effective_date, F.when(of("upcoming"), until), none)
    coming = _item(item(until), named(of("upcoming_title")), of("upcoming_body"), until, none, F.concat(F.lit("law:"), item(effective_date)))
    return F.when(of("upcoming") & until.isNotNull(), F.array(current, coming)).otherwise(F.array(current))


def _addendum_item(law_id: Column, law_name: Column, addendum_id: Column, body: Column) -> Column:
    none = F.lit(None)
    return _item(F.concat_ws("-", law_id, F.lit("ar"), addendum_id), F.concat(law_name, F.lit(" 부칙")), body, none, none, none)


def versioned_items(articles: DataFrame) -> DataFrame:
    """Items of articles (law_id, law_name, jo_no, jo_br_no, title, body, effective_date, upcoming, upcoming_title, upcoming_body, upcoming_date).

    Each article has its current version, closed by the upcoming one's date, and the upcoming one, which
    supersedes it; an upcoming version without a date is left out.
    """
    return articles.select(F.inline(_versions(F.col("law_id"), F.col("law_name"), F.col("effective_date"), F.col)))


def addenda_items(addenda: DataFrame) -> DataFrame:
    """Items of addenda (law_id, law_name, addendum_id, body)."""
    return addenda.select(_addendum_item(F.col("law_id"), F.col("law_name"), F.col("addendum_id"), F.col("body")).alias("a")).select("a.id", "a.title", "a.body")


def _own(table: Element, tag: str, **attributes: str) -> list[Element]:
    """Elements of a table that are not in a table within it."""
    return [x for x in table.all(tag, **attributes) if x.above("table") is table]


def _listing(page: Element) -> list[dict]:
    for table in page.all("table"):
        headers = [h.whole_text() for h in _own(table, "th", scope="col")]
        if headers and headers[0] == FIRST_HEADER:
            break
    else:
        return []
    names, found = [h for h in headers if h], []
    for number, row in enumerate(_own(table, "tr")):
        cells = [c.whole_text() for c in row.all("td") if c.above("tr") is row]
        held = {name: text for name, text in zip(names, cells) if text}
        if held:
            found.append({"row_no": number, "cells": list(held.items()), "upcoming": row.first("img", alt=UPCOMING_ICON) is not None})
    return found


def listing_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, row_no, cells map<string,string>, upcoming): rows of the table whose first column header is FIRST_HEADER.

    Other tables before it, such as a filter's or one that holds it, do not count, nor do rows and cells of tables
    within a cell; pages without it give nothing. Cells go to the headers in order, blank ones are left out, and a
    row without any is no row.
    """
    return markup.read(pages, _listing, "row_no int, cells map<string,string>, upcoming boolean", html)


def _left_listing(page: Element) -> list[dict]:
    area, found = page.first(id=LEFT_LIST), []
    for number, row in enumerate(x for x in (area.all("li") if area else ()) if LEFT_ROW.fullmatch(x.get("id"))):
        link = next((x for x in row.content if isinstance(x, Element) and x.tag == "a"), None)
        if link is not None and link.get("title"):
            dates = link.first("span", LEFT_DATES)
            found.append({"no": number + 1, "row_id": row.get("id"), "name": link.get("title").split("\n")[0].strip(), "effective_date": _noted(dates.text(""), IN_FORCE_NOTE) if dates else None})
    return found


def left_listing(pages: DataFrame, today: Column, html: str = "html") -> DataFrame:
    """(page_id, no, row_id, name, effective_date, upcoming): rows of the list beside a page.

    A name is the first line of its link's title; the day in force stands in a note of its own, other dates beside it
    do not count. Rows without a title are left out, though they are counted; one after ``today`` is upcoming.
    """
    rows = markup.read(pages, _left_listing, "no int, row_id string, name string, effective_date date", html)
    return rows.withColumn("upcoming", F.coalesce(F.col("effective_date") > today, F.lit(False)))


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, no, name, target): rows of a page's link list."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(NAV), F.lit(0))).alias("no", "hit"))
    return rows.select("page_id", (F.col("no") + 1).alias("no"), F.regexp_extract("hit", NAV, 2).alias("name"), F.regexp_extract("hit", NAV, 1).alias("target"))


def dated_names(rows: DataFrame, text: Column, today: Column) -> DataFrame:
    """Add name, effective_date and upcoming from texts such as ``name [시행 2024. 1. 2.]``."""
    found = F.get(dates_in(text, IN_FORCE), 0)
    name = strip(F.regexp_replace(text, r"\[시행[^\]]*\]", ""))
    return rows.select("*", name.alias("listed_name"), found.alias("effective_date"), F.coalesce(found > today, F.lit(False)).alias("upcoming"))


def fresh_pages(pages: DataFrame, cutoff: Column | None = None, oldest_year: int = 2000) -> DataFrame:
    """Pages (site, page, newest) of a listing up to the first whose newest date is before ``cutoff``.

    Without a cutoff, up to the first whose newest date is before ``oldest_year``. Pages without a date end nothing.
    """
    running = F.min("newest").over(W.partitionBy("site").orderBy("page").rowsBetween(W.unboundedPreceding, 0))
    fresh = F.col("running") >= cutoff if cutoff is not None else F.year("running") >= oldest_year
    return pages.withColumn("running", running).where(F.coalesce(fresh, F.lit(True))).drop("running")


def current_listing(rows: DataFrame, name: str, no: str) -> DataFrame:
    """One row a name: those in force before upcoming ones, then the highest number."""
    order = W.partitionBy(name).orderBy("upcoming", F.desc(no))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def watch_dates(names: DataFrame, listings: DataFrame) -> DataFrame:
    """(name, date): the latest date of each name, from the first site (lowest site_no) that lists it; names are compared by ``norm``."""
    found = names.join(listings.where("date is not null"), "norm").groupBy("name", "site_no").agg(F.max("date").alias("date"))
    first = F.row_number().over(W.partitionBy("name").orderBy("site_no"))
    return found.withColumn("n", first).where("n = 1").select("name", "date")


def crawl_plan(names: DataFrame, state: DataFrame, current: DataFrame, failed: DataFrame) -> DataFrame:
    """(name, action): reuse unchanged items, recrawl others; where that fails the cached ones stand in, or the name drops."""
    rows = names.select("name").join(state.select("name", F.col("date").alias("cached")), "name", "left").join(current.select("name", "date"), "name", "left").join(failed.select("name", F.lit(True).alias("failed")), "name", "left")
    same = F.col("cached").isNotNull() & F.col("date").isNotNull() & (F.col("cached") == F.col("date"))
    action = F.when(same, "reuse").when(F.col("failed").isNull(), "recrawl").when(F.col("cached").isNotNull(), "fallback").otherwise("drop")
    return rows.select("name", action.alias("action"))
