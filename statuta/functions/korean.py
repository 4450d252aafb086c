"""Expressions for Korean legal texts: citations, articles, titles, dates and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.text import DIGIT, LINE_END, SPACE, SPACES, ascii_digits, bound, strip

#: A law's name (bracketed, bare, or "the same law"), then its article and branch number.
CITATION = rf"(?:「([^」]{{2,40}})」|([가-힣]{{2,30}}(?:법률|시행령|시행규칙|법|규정|준칙))|(동법|같은{SPACE}*법)){SPACE}*제{SPACE}*({DIGIT}+){SPACE}*조(?:{SPACE}*의{SPACE}*({DIGIT}+))?"
#: Heading of an article, start of the addenda, revision date, leading number, lines without words.
HEADING = rf"제{SPACE}*({DIGIT}+){SPACE}*조(?:{SPACE}*의{SPACE}*({DIGIT}+))?{SPACE}*\(([^)]{{0,60}})\)"
ADDENDUM = rf"(?md)^부{SPACE}*칙"
REVISION = rf"(?:제정|개정){SPACE}*({DIGIT}{{4}})[.\-]({DIGIT}{{1,2}})[.\-]({DIGIT}{{1,2}})"
LEADING_NUMBER = rf"^({DIGIT}+)\."
DECORATION = rf"^[{SPACES}\-=_*~+#]+\z"
NO_TITLE = "제목 없음"
IN_FORCE = rf"\[시행일?:?{SPACE}*({DIGIT}{{4}})\.{SPACE}*({DIGIT}{{1,2}})\.{SPACE}*({DIGIT}{{1,2}})\.\]"


def law_citations(docs: DataFrame, text: Column, id_col: str) -> DataFrame:
    """(id, pos, law_name, jo, jo_br, explicit) in the order of the text; "the same law" takes the last explicit name.

    Hits without any explicit name before them are left out.
    """
    hits = docs.select(F.col(id_col), F.posexplode(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))).alias("pos", "hit"))
    part = lambda k: F.nullif(F.regexp_extract("hit", CITATION, k), F.lit(""))
    named = hits.select(id_col, "pos", F.coalesce(part(1), part(2)).alias("own"), part(4).alias("jo"), part(5).alias("jo_br"))
    carried = F.last("own", ignorenulls=True).over(W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return named.withColumn("law_name", carried).where("law_name is not null").select(id_col, "pos", "law_name", "jo", "jo_br", F.col("own").isNotNull().alias("explicit"))


def citation_needle() -> Column:
    return F.concat("law_name", F.lit(" 제"), "jo", F.lit("조"), F.when(F.col("jo_br").isNotNull(), F.concat(F.lit("의"), "jo_br")).otherwise(F.lit("")))


def article_label(segment: Column) -> Column:
    heading = strip(F.regexp_extract(segment, HEADING, 3))
    branch = F.regexp_extract(segment, HEADING, 2)
    return F.concat(
        F.lit("제"),
        F.regexp_extract(segment, HEADING, 1),
        F.lit("조"),
        F.when(branch != "", F.concat(F.lit("의"), branch)).otherwise(F.lit("")),
        F.when(heading != "", F.concat(F.lit("("), heading, F.lit(")"))).otherwise(F.lit("")),
    )


def split_articles(text: Column) -> Column:
    """Array of struct(label, body); empty where the text has no article heading.

    What stands before the first heading is left out, addenda go to the last article. The text is cut once:
    the array of its parts is bound to a name before it is used several times.
    """
    at = F.regexp_instr(text, F.lit(ADDENDUM))

    def articles(cut: Column) -> Column:
        n = F.size(cut["parts"])
        body = lambda p, i: F.when((i == n - 1) & (cut["addenda"] != ""), F.concat(strip(p), F.lit("\n\n"), cut["addenda"])).otherwise(strip(p))
        head = lambda p: F.regexp_extract(p, f"^{HEADING}", 0)
        return F.transform(cut["parts"], lambda p, i: F.struct(article_label(head(p)).alias("label"), body(p, i).alias("body")))

    def halves(spot: Column) -> Column:
        main = F.when(spot > 0, F.substring(text, F.lit(1), spot - 1)).otherwise(text)
        addenda = F.when(spot > 0, strip(F.substring(text, spot, F.length(text)))).otherwise(F.lit(""))
        marked = F.split(F.regexp_replace(main, f"(?md)^({HEADING})", "\u0001$1"), "\u0001")
        return bound(F.struct(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))).alias("parts"), addenda.alias("addenda")), articles)

    return bound(at, halves)


def doc_title(text: Column) -> Column:
    """First line with more than decoration."""
    lines = F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: (x != "") & ~x.rlike(DECORATION))
    return F.coalesce(F.get(lines, 0), F.lit(NO_TITLE))


def date_of(parts: list[Column]) -> Column:
    """Date from year, month and day in digits; null for one that does not exist."""
    year, month, day = parts
    return F.try_to_date(ascii_digits(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))))


def dates_in(text: Column, pattern: str) -> Column:
    """All existing dates that a pattern of three groups finds."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(hits, lambda h: date_of([F.regexp_extract(h, pattern, k) for k in (1, 2, 3)])), lambda x: x.isNotNull())


def latest_revision(text: Column) -> Column:
    return F.array_max(dates_in(text, REVISION))


def compact_date(text: Column) -> Column:
    """``yyyymmdd`` as a date."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def coerce_date(text: Column) -> Column:
    """ISO date, with or without a time; blank and impossible ones are null."""
    return F.try_to_date(F.substring(F.nullif(strip(text), F.lit("")), 1, 10))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def external_id(stem: Column) -> Column:
    """Leading number of a file's name, else its words joined by hyphens, in lower case."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w]+", "-"), "^-+|-+$", ""))
    number = F.regexp_extract(stem, LEADING_NUMBER, 1)
    return F.when(number != "", number).otherwise(slug)


def dept_from_path(path: Column, default: str = "ALL") -> Column:
    """The first folder of a relative path as the only department."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array(F.get(parts, 0))).otherwise(F.array(F.lit(default)))


def hangul_only(name: Column) -> Column:
    return F.regexp_replace(name, "[^가-힣]", "")
