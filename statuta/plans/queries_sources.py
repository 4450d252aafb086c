"""Queries of scans, pages, listings and crawls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.functions import korean
from statuta.functions.lineage import shared_folder
from statuta.operators import state, versions
from statuta.operators.knowledge import KnowledgeTables
from statuta.plans import sql as S
from statuta.plans.queries_text import FDOC, FILES
from statuta.plans.register import Registry
from statuta.sources import adapter, crawl, files, pages

REGISTRY = Registry()
query = REGISTRY.query


@query(S.with_(FILES) + "SELECT CASE WHEN contains(path,'/') THEN split_part(path,'/',1) ELSE '' END AS folder, CAST(sum(strlen(text)+1) AS BIGINT) AS bytes FROM files GROUP BY 1")
def scan_staged(spark, d):
    """The rule files, written to a folder for each department, and found again by a scan; contents are not read."""
    staged = files.staged(spark, d).select("text", F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("")).alias("folder"))
    root = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    staged.write.partitionBy("folder").text(root)
    found = files.scan(spark, root, ("txt",))
    folder = F.regexp_replace(F.regexp_extract("path", "/folder=([^/]*)/", 1), "^__HIVE_DEFAULT_PARTITION__$", "")
    return found.groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"))


@query(
    S.with_(FILES, FDOC)
    + "SELECT entity_id, count(*) AS files, max(path) AS kept_path, arg_max(dept, path) AS dept FROM fdoc GROUP BY 1 HAVING count(*)>1"
)
def duplicate_ids(spark, d):
    """Files whose names give the same id: how many, and which one stays, being the last in the order of paths."""
    found = files.file_documents(files.staged(spark, d), "regulation").select("entity_id", "source", "allowed_depts")  # texts stay behind
    return state.duplicates(found, "entity_id", "source").select("entity_id", F.col("n").alias("files"), F.col("kept").alias("kept_path"), F.array_join("row.allowed_depts", ",").alias("dept"))


@query(S.with_(FILES, FDOC) + "SELECT entity_id, path, dept FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY path DESC) AS n FROM fdoc) WHERE n=1")
def file_upsert(spark, d):
    """Of files with equal ids the last in the order of paths is loaded, with its departments."""
    found = files.file_documents(files.staged(spark, d), "regulation")
    return state.latest(found, "entity_id", "source").select("entity_id", F.col("source").alias("path"), F.array_join("allowed_depts", ",").alias("dept"))


@query(S.with_(S.ENT, FILES, FDOC) + "SELECT type, count(*) AS n, min(entity_id) AS first_id FROM (SELECT 'regulation' AS type, entity_id FROM fdoc UNION ALL SELECT 'review', replace(entity_id,'regulation:','review:') FROM fdoc WHERE doc_id%2=0 UNION ALL SELECT type, entity_id FROM ent) GROUP BY 1")
def source_union(spark, d):
    """Documents of several sources with different columns in one table."""
    staged = files.staged(spark, d)
    parts = [files.file_documents(staged, "regulation"), files.file_documents(staged.where("doc_id % 2 = 0"), "review"), adapter.entities(spark, d).drop("doc_id", "t", "version")]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return every.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_id"))


def unescaped(x: str) -> str:
    for name, character in pages.ENTITIES:
        x = f"replace({x},'{name}','{character.replace(chr(39), chr(39) * 2)}')"
    return x


STRIPPED = r"regexp_replace(%s,'^\s+|\s+$','','g')"
PIECES = f"array_to_string(list_filter(list_transform(regexp_split_to_array(%s,'<[^>]*>'), lambda y: {STRIPPED % unescaped('y')}), lambda y: y<>''),' ')"
BLOCKS = f"""bl0 AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html,'{pages.UNSEEN}','','g'),'{pages.BEGINS}',chr(1)||'\\1'||chr(2),'g'),'{pages.ENDS}',chr(3),'g'),chr(1))[2:] AS parts FROM pages),
bl1 AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS block_no FROM bl0),
bl AS (SELECT page_id, block_no, split_part(part,chr(2),1) AS tag, {PIECES % "split_part(split_part(part,chr(2),2),chr(3),1)"} AS text FROM bl1)"""


@query(S.with_(BLOCKS) + "SELECT page_id, CAST(block_no AS BIGINT) AS block_no, tag, text FROM bl")
def page_blocks(spark, d):
    return pages.blocks(adapter.read(spark, d, "pages")).withColumn("block_no", F.col("block_no").cast("bigint"))


BASE = "'L'||page_id||'-'||block_no||'-0'"
EFF = "DATE '2020-01-01'+CAST(page_id%900 AS INTEGER)"
NEXT = "DATE '2023-01-01'+CAST(block_no AS INTEGER)"


@query(
    S.with_(BLOCKS)
    + f"SELECT {BASE}||'@'||{EFF} AS id, trim('Law'||page_id||' '||text) AS title, text AS body, {EFF} AS effective_date, CASE WHEN block_no%3=0 AND block_no%9<>0 THEN {NEXT} END AS superseded_date, NULL AS supersedes FROM bl WHERE tag='p'"
    f" UNION ALL SELECT {BASE}||'@'||{NEXT}, trim('Law'||page_id||' '||text||' new'), text||' new', {NEXT}, NULL, 'law:'||{BASE}||'@'||{EFF} FROM bl WHERE tag='p' AND block_no%3=0 AND block_no%9<>0"
)
def bitemporal_items(spark, d):
    """Paragraphs of pages as articles; every third has an upcoming version, of these every third without a date."""
    rows = pages.blocks(adapter.read(spark, d, "pages")).where("tag = 'p'")
    upcoming = F.col("block_no") % 3 == 0
    articles = rows.select(
        F.concat(F.lit("L"), F.col("page_id").cast("string")).alias("law_id"),
        F.concat(F.lit("Law"), F.col("page_id").cast("string")).alias("law_name"),
        F.col("block_no").alias("jo_no"),
        F.lit(0).alias("jo_br_no"),
        F.col("text").alias("title"),
        F.col("text").alias("body"),
        F.expr("date_add(date'2020-01-01', cast(page_id % 900 as int))").alias("effective_date"),
        upcoming.alias("upcoming"),
        F.concat("text", F.lit(" new")).alias("upcoming_title"),
        F.concat("text", F.lit(" new")).alias("upcoming_body"),
        F.when(F.col("block_no") % 9 != 0, F.expr("date_add(date'2023-01-01', block_no)")).alias("upcoming_date"),
    )
    return pages.versioned_items(articles)


def quoted(text):
    """Text that may stand in a page whose quotes are changed."""
    return F.replace(F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def in_forms(html):
    """Pages by turns with double quotes, single ones, and none where a value needs none."""
    return F.when(F.col("page_id") % 3 == 1, F.translate(html, '"', "'")).when(F.col("page_id") % 3 == 2, F.regexp_replace(html, '="([A-Za-z0-9_:]+)"', "=$1")).otherwise(html)


def statute_pages(spark, d):
    """(page_id, html): statute pages made of the paragraphs of pages, addenda from headings.

    Their form varies: quotes, a table within every fourth article and text behind it, character references; every
    third article has an upcoming version, of these every third has no note of its date but another one; every
    article after one of these is followed by a group that is not directly behind it.
    """
    rows = pages.blocks(adapter.read(spark, d, "pages")).withColumn("no", F.col("block_no").cast("string"))
    safe = quoted(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#x3E;")))
    day = F.expr("date_add(date'2023-01-01', block_no)")
    note = F.concat(F.lit("<p class=\"pty1\">[시행일: "), F.year(day).cast("string"), F.lit(". "), F.month(day).cast("string"), F.lit(". "), F.dayofmonth(day).cast("string"), F.lit(".] 제"), "no", F.lit("조</p>"))
    table = F.when(F.col("block_no") % 4 == 1, F.concat(F.lit("<div><div><table><tr><td><p>표 "), "no", F.lit("</p></td></tr></table></div></div><p>뒤&middot;"), "no", F.lit("&hellip;</p>"))).otherwise(F.lit(""))
    current = F.concat(F.lit('<a class="x" name="J'), "no", F.lit(':0"></a><div class="pgroup"><div class="lawcon"><p class="pty1_p4"><span class="bl"><label>제'), "no", F.lit("조</label></span> "), safe, F.lit("</p>"), table, F.lit("<p> </p></div></div>"))
    title = F.when(F.col("block_no") % 2 == 0, F.concat(F.lit('<span class="bl">개정 <b>제'), "no", F.lit("조</b></span>"))).otherwise(F.lit(""))
    coming = F.concat(F.lit('<div class="pgroup babl"><div class="lawcon"><p>'), title, safe, F.lit(' <span style="color: rgb(255, 0, 0)">new</span></p>'), F.when(F.col("block_no") % 9 != 0, note).otherwise(F.lit("<p>[시행 2030. 1. 1.]</p>")), F.lit("</div></div>"))
    apart = F.lit('<br/><div class="pgroup babl"><p>[시행일: 2031. 1. 1.]</p></div>')
    article = F.concat(current, F.when(F.col("block_no") % 3 == 0, coming).when(F.col("block_no") % 3 == 1, apart).otherwise(F.lit("")), F.lit('<p class="gtit">장</p>'))
    addendum = F.concat(F.lit('<a name="J'), "no", F.lit('"></a><div class="pgroup"><p class="pty3_dep1">'), safe, F.lit('</p><div><p class="x pty3">부칙 '), "no", F.lit('</p></div><p class="other">x</p></div>'))
    both = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.when(F.col("tag") == "p", F.struct("block_no", article.alias("h"))))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("tag") == "h1", F.struct("block_no", addendum.alias("h"))))).alias("b"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["h"]), "")
    page = F.col("page_id").cast("string")
    field = lambda name, value: F.concat(F.lit(f'<input type="hidden" id="{name}" value="'), value, F.lit('" />'))
    head = F.concat(field("lsId", F.concat(F.lit("L"), page)), F.lit('<input value="Law &amp; '), page, F.lit('" type="hidden" id="lsNm" />'), field("lsiSeq", page), field("ancNo", F.concat(F.lit("제"), page, F.lit("호"))), field("ancYd", F.when(F.col("page_id") % 4 == 0, "2019").otherwise(F.lit("20191231"))), field("efYd", F.date_format(F.expr("date_add(date'2020-01-01', cast(page_id % 900 as int))"), "yyyyMMdd")))
    return both.select("page_id", in_forms(F.concat(head, joined("a"), F.lit('<div id="arDivArea"><a name="arArea"></a>'), joined("b"), F.lit("</div>"))).alias("html"))


ARTICLES = f"""st AS (SELECT *, 'Law & '||page_id AS law_name, CASE WHEN text='' THEN '제'||block_no||'조' ELSE '제'||block_no||'조 '||text END||CASE WHEN block_no%4=1 THEN chr(10)||'표 '||block_no||chr(10)||'뒤·'||block_no||'…' ELSE '' END AS body, tag='p' AND block_no%3=0 AS upcoming,
 CASE WHEN block_no%2=0 THEN '개정제'||block_no||'조' ELSE '제'||block_no||'조' END AS next_title, CASE WHEN block_no%9<>0 THEN {NEXT} END AS next_date,
 trim(CASE WHEN block_no%2=0 THEN '개정 제'||block_no||'조 ' ELSE '' END||text)||CASE WHEN block_no%2=0 OR text<>'' THEN ' ' ELSE '' END||'new'||CASE WHEN block_no%9<>0 THEN chr(10)||'[시행일: '||year({NEXT})||'. '||month({NEXT})||'. '||day({NEXT})||'.] 제'||block_no||'조' ELSE chr(10)||'[시행 2030. 1. 1.]' END AS next_body FROM bl)"""


@query(S.with_(BLOCKS, ARTICLES) + f"SELECT 'L'||page_id AS law_id, law_name, CAST(page_id AS VARCHAR) AS revision_seq, '제'||page_id||'호' AS promulgation_no, CASE WHEN page_id%4<>0 THEN DATE '2019-12-31' END AS promulgation_date, {EFF} AS effective_date, CAST(block_no AS VARCHAR) AS jo_no, '0' AS jo_br_no, '제'||block_no||'조' AS title, body, upcoming, CASE WHEN upcoming THEN next_title END AS upcoming_title, CASE WHEN upcoming THEN next_body END AS upcoming_body, CASE WHEN upcoming THEN next_date END AS upcoming_date FROM st WHERE tag='p'")
def statute_articles(spark, d):
    """Statute pages taken apart: fields of the page, and each article with its upcoming version."""
    found = pages.statutes(statute_pages(spark, d))
    rows = found.select("law_id", "law_name", "revision_seq", "promulgation_no", "promulgation_date", "effective_date", F.explode("articles").alias("a"))
    return rows.select(*[c for c in rows.columns if c != "a"], "a.*")


@query(S.with_(BLOCKS) + "SELECT 'L'||page_id AS law_id, CAST(block_no AS VARCHAR) AS id, '부칙 '||block_no||CASE WHEN text<>'' THEN chr(10)||text ELSE '' END AS body FROM bl WHERE tag='h1'")
def statute_addenda(spark, d):
    found = pages.statutes(statute_pages(spark, d))
    return found.select("law_id", F.explode("addenda").alias("a")).select("law_id", "a.id", "a.body")


@query(
    S.with_(BLOCKS, ARTICLES)
    + f"SELECT {BASE}||'@'||{EFF} AS id, law_name||' 제'||block_no||'조' AS title, body, {EFF} AS effective_date, CASE WHEN upcoming THEN next_date END AS superseded_date, NULL AS supersedes FROM st WHERE tag='p'"
    f" UNION ALL SELECT {BASE}||'@'||next_date, law_name||' '||next_title, next_body, next_date, NULL, 'law:'||{BASE}||'@'||{EFF} FROM st WHERE upcoming AND next_date IS NOT NULL"
    " UNION ALL SELECT 'L'||page_id||'-ar-'||block_no, law_name||' 부칙', '부칙 '||block_no||CASE WHEN text<>'' THEN chr(10)||text ELSE '' END, NULL, NULL, NULL FROM st WHERE tag='h1'"
)
def statute_items(spark, d):
    """From pages to items: articles in force, upcoming ones that supersede them, addenda."""
    return pages.statute_items(pages.statutes(statute_pages(spark, d)))


AS_OF = "DATE '2022-07-01'+CAST(page_id%3*400 AS INTEGER)"


@query(
    S.with_(BLOCKS, ARTICLES)
    + f", q AS (SELECT *, {EFF} AS eff, {AS_OF} AS as_of FROM st WHERE tag='p') SELECT 'law:'||{BASE}||'@'||eff AS entity_id, as_of, CASE WHEN upcoming AND next_date<=as_of THEN 'law:'||{BASE}||'@'||next_date ELSE 'law:'||{BASE}||'@'||eff END AS resolved_id FROM q WHERE eff<=as_of OR (upcoming AND next_date<=as_of)"
)
def statute_versions(spark, d):
    """Statute pages loaded end to end into stored tables, and each article's version in force on a day of its page."""
    documents, relations = pages.statute_documents(pages.statute_items(pages.statutes(statute_pages(spark, d))))
    held = KnowledgeTables(spark, f"{shared_folder(spark)}/statutes-{uuid.uuid4().hex}")
    held.sync(documents, relations)
    at = held.store.snapshot().number
    current = held.edges(at).select(F.col("src").alias("entity_id"))
    page = F.regexp_extract("entity_id", "^law:L([0-9]+)-[0-9]+-0@", 1)
    asked = held.entities(at).join(current, "entity_id", "left_anti").where(page != "").select("entity_id", F.expr(f"date_add(date'2022-07-01', cast(cast(regexp_extract(entity_id, '^law:L([0-9]+)-', 1) as bigint) % 3 * 400 as int))").alias("as_of"))
    return versions.resolve(asked, held.entities(at), versions.chains(held.entities(at), held.edges(at))).select("entity_id", "as_of", "resolved_id")


NAV = r'<a href="([^"]*)">([^<]*)</a>'
LISTED = f"""li0 AS (SELECT page_id, unnest(regexp_extract_all(html,'{NAV}')) AS hit, unnest(range(1,len(regexp_extract_all(html,'{NAV}'))+1)) AS no FROM pages),
li AS (SELECT page_id, no, regexp_extract(hit,'{NAV}',2) AS name, regexp_extract(hit,'{NAV}',1) AS target FROM li0)"""


@query(S.with_(LISTED) + "SELECT page_id, CAST(no AS BIGINT) AS no, name, target FROM li")
def listing_rows(spark, d):
    return pages.listing_rows(adapter.read(spark, d, "pages")).withColumn("no", F.col("no").cast("bigint"))


@query(S.with_(LISTED) + f"SELECT page_id, CAST(no AS VARCHAR) AS no, nullif({STRIPPED % unescaped('name')},'') AS name, CASE WHEN no%5<>0 THEN '2024. '||(no%12+1)||'. 1.' END AS day, no%4=0 AS upcoming FROM li")
def listing_table(spark, d):
    """Listing pages made of link lists: another table before the one that counts or around it, tables within cells, quotes of all forms."""
    rows = pages.listing_rows(adapter.read(spark, d, "pages")).withColumn("no", F.col("no").cast("string"))
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    icon = F.when(F.col("no") % 4 == 0, '<img src="x" alt="앞으로 시행될 법령" />').otherwise(F.lit(""))
    day = F.when(F.col("no") % 5 != 0, F.concat(F.lit("2024. "), (F.col("no") % 12 + 1).cast("int").cast("string"), F.lit(". 1."))).otherwise(F.lit(""))
    more = F.when(F.col("no") % 3 == 0, "<td><table><tr><td>77</td><td>no row</td></tr></table></td>").otherwise(F.lit(""))
    row = F.concat(F.lit("<tr>"), cell(F.col("no")), cell(F.concat(F.lit("<a>"), quoted(F.col("name")), F.lit("</a>"), icon)), cell(day), more, F.lit("</tr>"))
    head = lambda *names: "<tr>" + "".join(f'<th scope="col"><span>{x}</span></th>' for x in names) + "</tr>"
    before = "<table>" + head("부처/청/위원회", "기타") + "<tr><td>1</td><td>x</td></tr></table>"
    body = rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("no").cast("int"), row.alias("h")))), lambda x: x["h"]), "").alias("rows"))
    own = F.concat(F.lit("<table>" + head("번호", "법령명", "공포일자")), "rows", F.lit("</table>"))
    around = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<table><tr><td>"), own, F.lit("</td></tr></table>"))).otherwise(F.concat(F.lit(before), own))
    found = pages.listing_tables(body.select("page_id", in_forms(around).alias("html")))
    cell_of = lambda name: F.try_element_at("cells", F.lit(name))
    return found.select("page_id", cell_of("번호").alias("no"), cell_of("법령명").alias("name"), cell_of("공포일자").alias("day"), "upcoming")


@query(S.with_(LISTED) + "SELECT page_id, CAST(no AS BIGINT) AS no, trim(name) AS listed_name, DATE '2023-01-01'+CAST((page_id*7+no)%700 AS INTEGER) AS effective_date, DATE '2023-01-01'+CAST((page_id*7+no)%700 AS INTEGER)>DATE '2024-01-01' AS upcoming FROM li")
def left_listing_rows(spark, d):
    """Lists beside a page, made of link lists: names with the day in force beside another one; those after the given day are upcoming."""
    rows = pages.listing_rows(adapter.read(spark, d, "pages")).withColumn("day", F.expr("date_add(date'2023-01-01', cast((page_id * 7 + no) % 700 as int))"))
    note = F.concat(F.lit("[시행 "), F.year("day").cast("string"), F.lit(". "), F.month("day").cast("string"), F.lit(". "), F.dayofmonth("day").cast("string"), F.lit(".] [법률 제9호, 1999. 9. 9., 일부개정]"))
    name = quoted(F.col("name"))
    row = F.concat(F.lit('<li id="liBgcolor'), F.col("no").cast("string"), F.lit('"><a title="'), name, F.lit("\n"), note, F.lit('"><span class="tx">'), name, F.lit('</span><span class="tx2">'), note, F.lit("</span></a><ul><li><a>본문</a></li></ul></li>"))
    body = rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", row.alias("h")))), lambda x: x["h"]), "").alias("rows"))
    found = pages.left_listing(body.select("page_id", in_forms(F.concat(F.lit('<div id="listDiv"><ul>'), "rows", F.lit("</ul></div>"))).alias("html")), F.lit("2024-01-01").cast("date"))
    return found.select("page_id", F.col("no").cast("bigint").alias("no"), F.col("name").alias("listed_name"), "effective_date", "upcoming")


@query("WITH p AS (SELECT page_id%5 AS site, page_id//5 AS page, DATE '2024-06-01'-CAST(page_id//5+(page_id%3)*20 AS INTEGER) AS newest FROM pages) SELECT site, page, newest FROM (SELECT *, min(newest) OVER (PARTITION BY site ORDER BY page ROWS UNBOUNDED PRECEDING) AS low FROM p) WHERE low>=DATE '2024-04-15'")
def listing_increment(spark, d):
    rows = adapter.read(spark, d, "pages").selectExpr("page_id % 5 as site", "page_id div 5 as page", "date_sub(date'2024-06-01', cast(page_id div 5 + (page_id % 3) * 20 as int)) as newest")
    return pages.fresh_pages(rows, F.lit("2024-04-15").cast("date"))


@query("WITH p AS (SELECT page_id%5 AS site, page_id//5 AS page, DATE '2030-06-01'-CAST(page_id//5*300+(page_id%3)*20 AS INTEGER) AS newest FROM pages) SELECT site, page, newest FROM (SELECT *, min(newest) OVER (PARTITION BY site ORDER BY page ROWS UNBOUNDED PRECEDING) AS low FROM p) WHERE year(low)>=2000")
def listing_years(spark, d):
    """A first crawl has no last date; it ends at the first page older than the oldest year."""
    rows = adapter.read(spark, d, "pages").selectExpr("page_id % 5 as site", "page_id div 5 as page", "date_sub(date'2030-06-01', cast((page_id div 5) * 300 + (page_id % 3) * 20 as int)) as newest")
    return pages.fresh_pages(rows)


@query(S.with_(LISTED) + "SELECT DISTINCT name, target FROM li")
def listing_dedupe(spark, d):
    """Rows of all pages, whole duplicates once, without the page number."""
    rows = pages.listing_rows(adapter.read(spark, d, "pages")).drop("page_id", "no")
    return rows.dropDuplicates()


@query(S.with_(S.ENT) + "SELECT entity_id, regexp_replace(title,'[^가-힣]','','g') AS norm FROM ent")
def norm_name(spark, d):
    return adapter.entities(spark, d).select("entity_id", korean.hangul_only(F.col("title")).alias("norm"))


@query("SELECT o_custkey, o_orderkey, upcoming FROM (SELECT o_custkey, o_orderkey, o_orderdate>=TIMESTAMP '1997-01-01' AS upcoming, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate>=TIMESTAMP '1997-01-01', o_orderkey DESC) AS n FROM orders) WHERE n=1")
def pick_current_listing(spark, d):
    """One order a customer: those before a day first, then the highest number."""
    rows = adapter.read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).alias("upcoming"))
    return pages.current_listing(rows, "o_custkey", "o_orderkey")


@query(
    "WITH l AS (SELECT o_custkey%3 AS site_no, o_custkey AS norm, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey%4<>0), g AS (SELECT c_custkey AS name, site_no, max(date) AS date FROM customer JOIN l ON norm=c_custkey GROUP BY 1,2)"
    " SELECT name, date FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY site_no) AS n FROM g) WHERE n=1"
)
def watch_dates(spark, d):
    names = adapter.read(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_custkey").alias("norm"))
    rows = adapter.read(spark, d, "orders").where("o_orderkey % 4 <> 0").select((F.col("o_custkey") % 3).alias("site_no"), F.col("o_custkey").alias("norm"), F.col("o_orderdate").cast("date").alias("date"))
    return pages.watch_dates(names, rows)


@query(
    "WITH o AS (SELECT o_custkey AS name, max(CAST(o_orderdate AS DATE)) FILTER (o_orderkey%3<>0) AS cached, max(CAST(o_orderdate AS DATE)) FILTER (o_orderkey%5<>0) AS now FROM orders GROUP BY 1)"
    " SELECT c_custkey AS name, CASE WHEN cached IS NOT NULL AND now IS NOT NULL AND cached=now THEN 'reuse' WHEN c_custkey%4<>0 THEN 'recrawl' WHEN cached IS NOT NULL THEN 'fallback' ELSE 'drop' END AS action FROM customer LEFT JOIN o ON name=c_custkey"
)
def crawl_plan(spark, d):
    orders = adapter.read(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    names = adapter.read(spark, d, "customer").select(F.col("c_custkey").alias("name"))
    latest = lambda n: orders.where(F.col("o_orderkey") % n != 0).groupBy("name").agg(F.max("day").alias("date"))
    return pages.crawl_plan(names, latest(3), latest(5), names.where("name % 4 = 0"))


def items(spark, d):
    """Crawled items as JSON texts; some lack a title, have a bad date or an unknown relation."""
    rows = adapter.read(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    day = F.when(F.col("doc_id") % 13 == 0, "2024-99-01").when(F.col("doc_id") % 3 == 0, "").otherwise(F.date_format(F.expr("date_add(date'2020-01-01', cast(doc_id % 900 as int))"), "yyyy-MM-dd"))
    item = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("title"),
        F.col("text").alias("body"),
        day.alias("effective_date"),
        F.array(F.array(F.when(F.col("doc_id") % 17 == 0, "knows").otherwise(F.lit("cites")), F.concat(F.lit("law:"), (F.col("doc_id") % 100).cast("string")))).alias("relations"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("law:"), F.col("doc_id").cast("string"), F.lit("-old"))).alias("supersedes"),
    )
    many = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("Title").alias("title"), F.lit("b").alias("body"), F.array(F.lit("law:a"), F.concat(F.lit("law:"), F.col("doc_id").cast("string"))).alias("supersedes"))
    return rows.select("doc_id", F.when(F.col("doc_id") % 19 == 0, "not json").when(F.col("doc_id") % 7 == 0, F.to_json(many)).otherwise(F.to_json(item)).alias("value"))


REASON = "CASE WHEN doc_id%19=0 THEN 'missing id' WHEN doc_id%7=0 THEN NULL WHEN doc_id%11=0 THEN 'missing title' WHEN doc_id%13=0 THEN 'bad date' WHEN doc_id%17=0 THEN 'unknown relation' END"
ITEMS = f"it AS (SELECT doc_id, coalesce(text,'') AS text, {REASON} AS reason FROM documents WHERE doc_id IS NOT NULL)"


@query(S.with_(ITEMS) + "SELECT 'law:'||doc_id AS entity_id, CASE WHEN doc_id%7=0 THEN 'Title' ELSE 'Title '||doc_id END AS title, CASE WHEN doc_id%7=0 THEN 'b' ELSE text END AS body, CASE WHEN doc_id%7<>0 AND doc_id%3<>0 THEN DATE '2020-01-01'+CAST(doc_id%900 AS INTEGER) END AS effective_date FROM it WHERE reason IS NULL")
def crawl_items(spark, d):
    return crawl.documents(crawl.parse(items(spark, d)), "law").select("entity_id", "title", "body", "effective_date")


@query(S.with_(ITEMS) + "SELECT doc_id, reason FROM it WHERE reason IS NOT NULL")
def crawl_quarantine(spark, d):
    return crawl.parse(items(spark, d)).where("reason is not null").select("doc_id", "reason")


@query(
    S.with_(ITEMS)
    + "SELECT 'law:'||doc_id AS src, 'cites' AS type, 'law:'||(doc_id%100) AS dst FROM it WHERE reason IS NULL AND doc_id%7<>0 UNION ALL SELECT 'law:'||doc_id, 'supersedes', 'law:'||doc_id||'-old' FROM it WHERE reason IS NULL AND doc_id%7<>0 AND doc_id%2=0"
    " UNION ALL SELECT 'law:'||doc_id, 'supersedes', unnest(['law:a','law:'||doc_id]) FROM it WHERE reason IS NULL AND doc_id%7=0"
)
def convenience_edges(spark, d):
    return crawl.convenience_edges(crawl.parse(items(spark, d)), "law")
