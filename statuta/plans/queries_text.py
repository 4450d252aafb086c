"""Queries of text functions, citations, contracts and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.functions import korean
from statuta.functions.lineage import shared_folder
from statuta.functions.predicates import parse_source_types, parse_top_k
from statuta.functions.text import DIGIT, LINE_END, SPACE, gram_counts, mask_pii, strip, tokens
from statuta.operators import contracts, guard
from statuta.plans import ingest
from statuta.plans import sql as S
from statuta.plans.register import Registry
from statuta.plans.retrieve import Retrieval
from statuta.sources import adapter, files

REGISTRY = Registry()
query = REGISTRY.query

TOPICS = "['목적','손해배상','계약해지','관할법원','비밀유지','면책','업무위탁','정의']"
#: Rule files: titles between odd spaces, lines of other kinds, articles and dates with digits and spaces of other scripts.
FILES = f"""f0 AS (SELECT doc_id, coalesce(text,'') AS text, split_part(split_part(coalesce(text,''),' ',1),chr(10),1) AS word FROM documents WHERE doc_id IS NOT NULL),
files AS (SELECT doc_id, ['IB/','RETAIL/','','WM/sub/'][doc_id%4+1]||CASE WHEN doc_id%3=0 THEN (doc_id%50+1)||'. '||replace(word,'/','') ELSE '규정 '||replace(word,'/','')||' '||doc_id END||'.docx' AS path,
 CASE WHEN doc_id%2=0 THEN '\u3000-----\u2003'||chr(10) ELSE '' END||'\u00a0규정 '||doc_id||' '||word||CASE WHEN doc_id%5=1 THEN '\u2028둘째 줄' ELSE '\u3000' END||chr(10)||'제정 '||(doc_id%20+2000)||'.'||(doc_id%13+1)||'.'||(doc_id%28+1)||' 개정\u00a0２０２1-'||(doc_id%12+1)||'-'||(doc_id%9+1)||chr(10)
 ||array_to_string(CASE WHEN doc_id%7=3 THEN string_split(text,chr(10)) ELSE list_transform(string_split(text,chr(10)), lambda x, i: '제'||CASE WHEN i%4=1 THEN '\u00a0' ELSE '' END||i||'조'||CASE WHEN i%5=0 THEN '의\u2003２' ELSE '' END||CASE WHEN i%3=1 THEN '\u3000' ELSE '' END||'('||{TOPICS}[(i-1)%8+1]||'\u00a0) '||x) END, chr(10))
 ||CASE WHEN doc_id%3=1 THEN chr(10)||CASE WHEN doc_id%2=0 THEN '부\u00a0칙' ELSE '부칙' END||chr(10)||'이 규정은 공포한 날부터 시행한다.' ELSE '' END AS text FROM f0)"""
STRIP = S.STRIP
HEAD = korean.HEADING
FDOC = f"""fd0 AS (SELECT *, regexp_replace(regexp_extract(path,'([^/]*)$',1),'\\.[^.]*$','') AS stem FROM files),
fdoc AS (SELECT doc_id, path, text, 'regulation:'||CASE WHEN regexp_matches(stem,'{korean.LEADING_NUMBER}') THEN regexp_extract(stem,'{korean.LEADING_NUMBER}',1) ELSE lower(regexp_replace(regexp_replace(stem,'[^\\p{{L}}\\p{{N}}_]+','-','g'),'^-+|-+$','','g')) END AS entity_id,
 coalesce(list_filter(list_transform(string_split_regex(text,'{LINE_END}'), lambda x: {STRIP % 'x'}), lambda x: x<>'' AND NOT regexp_matches(x,'{korean.DECORATION}'))[1],'제목 없음') AS title,
 list_max(list_transform(regexp_extract_all(text,'{korean.REVISION}'), lambda h: TRY_CAST(regexp_replace({S.ascii_digits(f"regexp_extract(h,'{DIGIT}{{4}}[.-]{DIGIT}{{1,2}}[.-]{DIGIT}{{1,2}}')")},'\\.','-','g') AS DATE))) AS effective_date,
 CASE WHEN contains(path,'/') THEN split_part(path,'/',1) ELSE 'ALL' END AS dept FROM fd0)"""
ARTS = f"""ar0 AS (SELECT *, regexp_extract(text,'(?m)^부{SPACE}*칙') AS mark FROM fdoc),
ar1 AS (SELECT *, CASE WHEN mark<>'' THEN strpos(chr(10)||text, chr(10)||mark) ELSE 0 END AS spot FROM ar0),
ar2 AS (SELECT *, CASE WHEN spot>0 THEN substr(text,1,spot-1) ELSE text END AS main, CASE WHEN spot>0 THEN {STRIP % "substr(text,spot)"} ELSE '' END AS addenda FROM ar1),
ar3 AS (SELECT *, string_split(regexp_replace(main,'(?m)^({HEAD})',chr(1)||'\\1','g'),chr(1))[2:] AS parts FROM ar2),
ar4 AS (SELECT *, unnest(CASE WHEN len(parts)=0 THEN [NULL] ELSE parts END) AS part, unnest(CASE WHEN len(parts)=0 THEN [NULL] ELSE range(1,len(parts)+1) END) AS n FROM ar3),
arts AS (SELECT *, '제'||regexp_extract(part,'{HEAD}',1)||'조'||CASE WHEN regexp_extract(part,'{HEAD}',2)<>'' THEN '의'||regexp_extract(part,'{HEAD}',2) ELSE '' END||CASE WHEN {STRIP % f"regexp_extract(part,'{HEAD}',3)"}<>'' THEN '('||{STRIP % f"regexp_extract(part,'{HEAD}',3)"}||')' ELSE '' END AS label,
 {STRIP % "part"}||CASE WHEN n=len(parts) AND addenda<>'' THEN chr(10)||chr(10)||addenda ELSE '' END AS body FROM ar4)"""


@query(f"SELECT doc_id, array_to_string({S.tokens('text')},' ') AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize(spark, d):
    return adapter.read(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("WITH c AS (SELECT doc_id, text, string_split(lower(text),'') AS c FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(CASE WHEN length(text)<2 THEN [lower(text)] ELSE list_concat(list_transform(range(1,len(c)), lambda i: c[i]||c[i+1]), list_transform(range(1,len(c)-1), lambda i: c[i]||c[i+1]||c[i+2])) END) AS gram FROM c) SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1", name="char_ngrams")
def char_ngrams_(spark, d):
    return gram_counts(adapter.read(spark, d, "documents"), F.col("text"))

MASKED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s,'[0-9A-Za-z_\p{L}.+\-]+@[0-9A-Za-z_\p{L}\-]+\.[0-9A-Za-z_\p{L}.\-]+','[이메일 마스킹]','g'),'\d{6}-\d{7}','[주민번호 마스킹]','g'),'01[0-9]-\d{3,4}-\d{4}','[전화번호 마스킹]','g'),'\d{2,6}-\d{2,6}-\d{2,6}','[계좌번호 마스킹]','g')"
#: Numbers put after each text, so that every rule has something to do.
PERSONAL_SQL = "coalesce(text,'')||' 010-'||(1000+doc_id%9000)||'-5678 900101-1'||(100000+doc_id%900000)||' 110-'||(100+doc_id%900)||'-123456 홍길동@회사.kr'"


def personal():
    n = lambda base, size: (F.lit(base) + F.col("doc_id") % size).cast("string")
    return F.concat(F.coalesce("text", F.lit("")), F.lit(" 010-"), n(1000, 9000), F.lit("-5678 900101-1"), n(100000, 900000), F.lit(" 110-"), n(100, 900), F.lit("-123456 홍길동@회사.kr"))


@query(f"SELECT doc_id, {MASKED % f'({PERSONAL_SQL})'} AS masked FROM documents WHERE doc_id IS NOT NULL", name="mask_pii")
def mask_pii_(spark, d):
    return adapter.read(spark, d, "documents").where("doc_id is not null").select("doc_id", mask_pii(personal()).alias("masked"))

CITE = korean.CITATION
CITED_TEXT = "CASE WHEN doc_id%5=0 THEN '' ELSE body END||' 동법 제3조 및 은행법\u00a0제\u30003\u2003조\u00a0의\u00a0２, 같은\u3000법\u00a0제５조, 및 같은 법 제4조의2, 자본시장법 제'||(doc_id%30+1)||'조, 동법 제7조'"
CITED = f"""lc0 AS (SELECT entity_id, unnest(regexp_extract_all(x,'{CITE}')) AS hit, unnest(range(len(regexp_extract_all(x,'{CITE}')))) AS pos FROM (SELECT entity_id, {CITED_TEXT} AS x FROM ent)),
lc1 AS (SELECT entity_id, pos, coalesce(nullif(regexp_extract(hit,'{CITE}',1),''), nullif(regexp_extract(hit,'{CITE}',2),'')) AS own, regexp_extract(hit,'{CITE}',4) AS jo, nullif(regexp_extract(hit,'{CITE}',5),'') AS jo_br FROM lc0),
lc AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS law_name FROM lc1)"""


def cited_texts(spark, d):
    rows = adapter.entities(spark, d)
    return rows.withColumn("x", F.concat(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("body")), F.lit(" 동법 제3조 및 은행법\u00a0제\u30003\u2003조\u00a0의\u00a0２, 같은\u3000법\u00a0제５조, 및 같은 법 제4조의2, 자본시장법 제"), (F.col("doc_id") % 30 + 1).cast("string"), F.lit("조, 동법 제7조")))


@query(S.with_(S.ENT, CITED) + "SELECT entity_id, CAST(pos AS BIGINT) AS pos, law_name, jo, jo_br FROM lc WHERE law_name IS NOT NULL")
def law_citations(spark, d):
    return korean.law_citations(cited_texts(spark, d), F.col("x"), "entity_id").select("entity_id", F.col("pos").cast("bigint").alias("pos"), "law_name", "jo", "jo_br")


@query(S.with_(S.ENT, CITED) + "SELECT entity_id, CAST(pos AS BIGINT) AS pos, law_name FROM lc WHERE law_name IS NOT NULL AND own IS NULL")
def same_law_ffill(spark, d):
    return korean.law_citations(cited_texts(spark, d), F.col("x"), "entity_id").where("not explicit").select("entity_id", F.col("pos").cast("bigint").alias("pos"), "law_name")


AUTO = f"""au0 AS (SELECT entity_id AS src, unnest(regexp_extract_all(title||chr(10)||body,'{CITE}')) AS hit, unnest(range(len(regexp_extract_all(title||chr(10)||body,'{CITE}')))) AS pos FROM ent WHERE type<>'law'),
au1 AS (SELECT src, pos, coalesce(nullif(regexp_extract(hit,'{CITE}',1),''), nullif(regexp_extract(hit,'{CITE}',2),'')) AS own, regexp_extract(hit,'{CITE}',4) AS jo, nullif(regexp_extract(hit,'{CITE}',5),'') AS jo_br FROM au0),
au2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY src ORDER BY pos ROWS UNBOUNDED PRECEDING) AS law_name FROM au1),
auto AS (SELECT DISTINCT src, 'cites' AS type, e.entity_id AS dst FROM au2 JOIN ent e ON contains(e.title, law_name||' 제'||jo||'조'||coalesce('의'||jo_br,'')) WHERE e.type IN ('law','regulation'))"""


@query(S.with_(S.ENT, AUTO) + "SELECT * FROM auto")
def auto_citations(spark, d):
    return ingest.auto_citations(adapter.entities(spark, d))


@query(S.with_(S.ENT, S.EDGE, AUTO) + "SELECT DISTINCT * FROM (SELECT * FROM edge UNION ALL SELECT * FROM auto)")
def ingest_edges(spark, d):
    return ingest.ingest_edges(adapter.entities(spark, d), adapter.edges(spark, d))


@query(S.with_(S.ENT) + f"SELECT entity_id, CASE WHEN type IN ('review','precedent') THEN {MASKED % 'x'} ELSE x END AS body FROM (SELECT entity_id, type, {PERSONAL_SQL.replace('coalesce(text,' + chr(39) * 2 + ')', 'body')} AS x FROM ent)")
def ingest_entities(spark, d):
    rows = adapter.entities(spark, d).withColumn("text", F.col("body"))
    return ingest.ingest_entities(rows.withColumn("body", personal())).select("entity_id", "body")


@query(S.with_(S.ENT, S.EDGE, AUTO) + "SELECT dst, title, count(*) AS citing, min(src) AS first_src FROM (SELECT DISTINCT src, dst FROM (SELECT * FROM edge UNION ALL SELECT * FROM auto) WHERE type='cites') JOIN ent ON entity_id=dst GROUP BY ALL")
def impact_analysis(spark, d):
    """Which documents cite a law or rule, over explicit and found citations."""
    rows = adapter.entities(spark, d)
    cites = ingest.ingest_edges(rows, adapter.edges(spark, d)).where("type = 'cites'").groupBy("dst").agg(F.count(F.lit(1)).alias("citing"), F.min("src").alias("first_src"))
    return cites.join(rows.select(F.col("entity_id").alias("dst"), "title"), "dst").select("dst", "title", "citing", "first_src")


@query(S.with_(FILES, FDOC) + "SELECT path, entity_id, title, text AS body, effective_date, dept FROM fdoc")
def file_documents(spark, d):
    found = files.file_documents(files.staged(spark, d), "regulation")
    return found.select(F.col("source").alias("path"), "entity_id", "title", "body", "effective_date", F.array_join("allowed_depts", ",").alias("dept"))


@query(S.with_(FILES, FDOC) + "SELECT path, title FROM fdoc")
def doc_title(spark, d):
    return files.staged(spark, d).select("path", korean.doc_title(F.col("text")).alias("title"))


@query(S.with_(FILES, FDOC) + "SELECT path, effective_date FROM fdoc")
def latest_revision(spark, d):
    return files.staged(spark, d).select("path", korean.latest_revision(F.col("text")).alias("effective_date"))


@query(S.with_(FILES, FDOC) + "SELECT path, substr(entity_id,12) AS external_id FROM fdoc")
def external_id(spark, d):
    return files.staged(spark, d).select("path", korean.external_id(korean.file_stem(F.col("path"))).alias("external_id"))


@query(S.with_(FILES, FDOC) + "SELECT path, dept FROM fdoc")
def dept_from_path(spark, d):
    return files.staged(spark, d).select("path", F.array_join(korean.dept_from_path(F.col("path")), ",").alias("dept"))


@query(S.with_(FILES, FDOC, ARTS) + "SELECT path, CAST(n AS BIGINT) AS n, label, body FROM arts WHERE n IS NOT NULL")
def split_articles(spark, d):
    rows = files.staged(spark, d).select("path", F.posexplode(korean.split_articles(F.col("text"))).alias("n", "a"))
    return rows.select("path", (F.col("n") + 1).cast("bigint").alias("n"), "a.label", "a.body")


@query(S.with_(FILES, FDOC, ARTS) + "SELECT path, entity_id||coalesce('-'||n,'') AS entity_id, CASE WHEN n IS NULL THEN title ELSE title||' '||label END AS title, coalesce(body,text) AS body FROM arts")
def article_documents(spark, d):
    return files.article_documents(files.staged(spark, d)).select(F.col("source").alias("path"), "entity_id", "title", "body")


CHECKLIST = "CASE WHEN regexp_matches(h,'손해배상|위약금|위약벌|지연손해|배상액') THEN 'damages' WHEN regexp_matches(h,'해지|해제|계약기간|갱신|존속기간') THEN 'termination' WHEN regexp_matches(h,'관할|준거법|분쟁해결|중재') THEN 'jurisdiction' WHEN regexp_matches(h,'비밀유지|기밀|보안') THEN 'confidentiality' WHEN regexp_matches(h,'면책|책임제한|불가항력') THEN 'liability' WHEN regexp_matches(h,'위탁|수탁|재위탁') THEN 'outsourcing' ELSE 'default' END"


@query(S.with_(FILES, FDOC, ARTS) + f"SELECT path, label, {CHECKLIST} AS checklist FROM (SELECT path, coalesce(label,'전체 본문') AS label, regexp_extract(coalesce(label,''),'\\(([^)]*)\\){SPACE}*\\z',1) AS h FROM arts)")
def clause_checklist(spark, d):
    found = contracts.clauses(files.staged(spark, d), "path")
    return found.select(F.col("contract_id").alias("path"), "label", contracts.checklist(F.col("label")).alias("checklist"))


@query(S.with_(FILES, FDOC, ARTS) + f"SELECT path, pos, '['||label||']'||chr(10)||body||chr(10)||'('||{CHECKLIST}||')' AS query FROM (SELECT path, CAST(coalesce(n-1,0) AS BIGINT) AS pos, coalesce(label,'전체 본문') AS label, coalesce(body,text) AS body, regexp_extract(coalesce(label,''),'\\(([^)]*)\\){SPACE}*\\z',1) AS h FROM arts)")
def clause_queries(spark, d):
    found = contracts.clauses(files.staged(spark, d), "path")
    text = contracts.clause_query(F.col("label"), F.col("text"), contracts.checklist(F.col("label")))
    return found.select(F.col("contract_id").alias("path"), F.col("pos").cast("bigint").alias("pos"), text.alias("query"))


CLAUSE_REQ = f"""cl0 AS (SELECT item_id, unnest(string_split(coalesce(text,''),chr(10))) AS x, unnest(range(1,len(string_split(coalesce(text,''),chr(10)))+1)) AS i FROM benchmark),
cl AS (SELECT item_id, i, {TOPICS}[(i-1)%8+1] AS h, '제'||i||'조('||{TOPICS}[(i-1)%8+1]||')' AS label, {STRIP % f"'제'||i||'조('||{TOPICS}[(i-1)%8+1]||') '||x"} AS body FROM cl0),
req AS (SELECT item_id||'/'||(i-1) AS query_id, '['||label||']'||chr(10)||body||chr(10)||'('||{CHECKLIST}||')' AS query, 'IB' AS dept, DATE '2022-06-01' AS as_of, 6 AS top_k FROM cl)"""


@query(S.with_(*(CLAUSE_REQ if x is S.REQ else x for x in S.HYBRID)) + "SELECT * FROM fin")
def clause_evidence(spark, d):
    """Evidence for every clause of contracts made of the benchmark items, all clauses in one run."""
    items = adapter.read(spark, d, "benchmark").select("item_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("제"), (i + 1).cast("string"), F.lit("조("), F.element_at(F.array(*map(F.lit, files.TOPICS)), i % len(files.TOPICS) + 1), F.lit(") "), x)), "\n").alias("text"))
    found = contracts.clauses(items, "item_id")
    asked = found.select(F.concat_ws("/", F.col("contract_id").cast("string"), F.col("pos").cast("string")).alias("query_id"), contracts.clause_query(F.col("label"), F.col("text"), contracts.checklist(F.col("label"))).alias("query"), F.lit("IB").alias("dept"), F.lit("2022-06-01").cast("date").alias("as_of"), F.lit(6).alias("top_k"), F.lit(None).cast("array<string>").alias("source_types"))
    return Retrieval(asked, adapter.entities(spark, d), adapter.edges(spark, d)).result


ANSWER = "'위험도: '||['상','중','하'][turn%3+1]||chr(10)||chr(10)||'문제 조항: 제'||(turn+1)||'조'||chr(10)||coalesce(text,'')||chr(10)||'근거: '||conv_id||chr(10)||'---'||chr(10)||'수정 제안: 수정 불요'||chr(10)||'**참고 문서**'||chr(10)||'[1] x'"
TURNS = "conversations WHERE role='assistant' AND conv_id IS NOT NULL"


def answers(spark, d):
    text = F.concat(F.lit("위험도: "), F.element_at(F.array(*map(F.lit, ("상", "중", "하"))), (F.col("turn") % 3 + 1).cast("int")), F.lit("\n\n문제 조항: 제"), (F.col("turn") + 1).cast("string"), F.lit("조\n"), F.coalesce("text", F.lit("")), F.lit("\n근거: "), F.col("conv_id").cast("string"), F.lit("\n---\n수정 제안: 수정 불요\n**참고 문서**\n[1] x"))
    rows = adapter.read(spark, d, "conversations").where("role = 'assistant' and conv_id is not null")
    return rows.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), text.alias("text"))


LINES = f"""an AS (SELECT conv_id||'/'||turn AS answer_id, {ANSWER} AS text FROM {TURNS}),
ln0 AS (SELECT answer_id, unnest(string_split(text,chr(10))) AS line, unnest(range(len(string_split(text,chr(10))))) AS pos FROM an),
ln1 AS (SELECT *, {STRIP % 'line'} AS bare FROM ln0),
ln2 AS (SELECT *, CASE WHEN bare='**참고 문서**' THEN '참고 문서' WHEN starts_with(bare,'위험도:') THEN '위험도:' WHEN starts_with(bare,'문제 조항:') THEN '문제 조항:' WHEN starts_with(bare,'근거:') THEN '근거:' WHEN starts_with(bare,'수정 제안:') THEN '수정 제안:' END AS field FROM ln1 WHERE bare<>'' AND bare<>'---'),
lines AS (SELECT answer_id, pos, field, CASE WHEN field='참고 문서' THEN '' WHEN field IS NOT NULL THEN substr(bare,length(field)+1) ELSE line END AS content FROM ln2)"""


@query(S.with_(LINES) + "SELECT answer_id, CAST(pos AS BIGINT) AS pos, field, content FROM lines")
def report_lines(spark, d):
    return contracts.report_lines(answers(spark, d), "answer_id", "text").select("answer_id", F.col("pos").cast("bigint").alias("pos"), "field", "content")


@query(S.with_(LINES) + f"SELECT answer_id, max({STRIP % 'content'}) FILTER (field='위험도:') AS risk, max({STRIP % 'content'}) FILTER (field='문제 조항:') AS problem, max({STRIP % 'content'}) FILTER (field='근거:') AS grounds, max({STRIP % 'content'}) FILTER (field='수정 제안:') AS proposal FROM lines GROUP BY 1")
def review_fields(spark, d):
    return contracts.review_fields(answers(spark, d), "answer_id", "text")


NDOC = "(SELECT count(*) FROM ent)"
MARKS = f"""ids AS (SELECT entity_id, row_number() OVER (ORDER BY doc_id)-1 AS k FROM ent),
cv AS (SELECT conv_id||'/'||turn AS answer_id, conv_id, turn, coalesce(text,'') AS t FROM {TURNS}),
nd AS (SELECT max(doc_id)+1 AS nd FROM ent),
gd AS (SELECT answer_id, conv_id, turn, cv.t||' [[CITE:'||a.entity_id||']] 및 [[CITE:ghost:'||turn||']] [[CITE:'||b.entity_id||']] [[CITE:'||a.entity_id||']]' AS text, a.entity_id AS ida, b.entity_id AS idb FROM cv CROSS JOIN nd JOIN ent a ON a.doc_id=conv_id*37%nd JOIN ent b ON b.doc_id=(conv_id*37+turn)%nd)"""


def marked(spark, d):
    """Answers that cite two documents each, over the whole range of ids, and one that is not there."""
    ids = adapter.entities(spark, d).select("doc_id", "entity_id", "title")
    rows = adapter.read(spark, d, "conversations").where("role = 'assistant' and conv_id is not null")
    rows = rows.join(F.broadcast(ids.agg((F.max("doc_id") + 1).alias("nd"))))  # one row
    rows = rows.withColumn("a", F.col("conv_id") * 37 % F.col("nd")).withColumn("b", (F.col("conv_id") * 37 + F.col("turn")) % F.col("nd"))
    both = rows.join(ids.select(F.col("doc_id").alias("a"), F.col("entity_id").alias("ida")), "a").join(ids.select(F.col("doc_id").alias("b"), F.col("entity_id").alias("idb")), "b")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [[CITE:"), "ida", F.lit("]] 및 [[CITE:ghost:"), F.col("turn").cast("string"), F.lit("]] [[CITE:"), "idb", F.lit("]] [[CITE:"), "ida", F.lit("]]"))
    return both.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), "conv_id", "turn", text.alias("text"), "ida", "idb"), ids


#: The second id was retrieved on even turns only.
GUARD = """SELECT answer_id, replace(replace(replace(text,'[[CITE:'||ida||']]','[1]'),'[[CITE:'||idb||']]', CASE WHEN idb=ida THEN '[1]' WHEN turn%2=0 THEN '[2]' ELSE '[출처 미확인]' END),'[[CITE:ghost:'||turn||']]','[출처 미확인]')
 ||chr(10)||chr(10)||'---'||chr(10)||'**참고 문서**'||chr(10)||'[1] '||ea.title||' ('||ida||')'||CASE WHEN turn%2=0 AND ida<>idb THEN chr(10)||'[2] '||eb.title||' ('||idb||')' ELSE '' END AS text,
 ida||CASE WHEN turn%2=0 AND ida<>idb THEN ','||idb ELSE '' END AS verified, 'ghost:'||turn||CASE WHEN turn%2<>0 AND ida<>idb THEN ','||idb ELSE '' END AS rejected FROM gd JOIN ent ea ON ea.entity_id=ida JOIN ent eb ON eb.entity_id=idb"""


@query(S.with_(S.ENT, MARKS) + GUARD)
def citation_guard(spark, d):
    rows, ids = marked(spark, d)
    had = rows.select("answer_id", F.explode(F.when(F.col("turn") % 2 == 0, F.array("ida", "idb")).otherwise(F.array("ida"))).alias("entity_id"))
    return guard.verify(rows.select("answer_id", "text"), had, ids).select("answer_id", "text", F.array_join("verified", ",").alias("verified"), F.array_join("rejected", ",").alias("rejected"))


@query(S.with_(S.ENT, MARKS) + "SELECT conv_id, string_agg(x,',' ORDER BY x) AS ids FROM (SELECT DISTINCT conv_id, unnest([ida,idb]) AS x FROM gd) GROUP BY 1")
def turn_retrieved_ids(spark, d):
    """All ids that the searches of a conversation brought, each once."""
    rows, _ = marked(spark, d)
    each = rows.select("conv_id", F.explode(F.array("ida", "idb")).alias("x")).distinct()
    return each.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("ids"))


@query(f"SELECT dept, count(*) AS records, CAST(sum(1+turn%2) AS BIGINT) AS calls, CAST(sum(2+turn%2) AS BIGINT) AS ids, CAST(sum(turn%3) AS BIGINT) AS verified, count(*) AS rejected FROM (SELECT ['IB','RETAIL','WM'][conv_id%3+1] AS dept, turn FROM {TURNS}) GROUP BY 1")
def audit_rollup(spark, d):
    """Records are appended to a log of JSON lines in two writes, as two sessions do, and read back."""
    rows = adapter.read(spark, d, "conversations").where("role = 'assistant' and conv_id is not null")
    call = lambda n: F.struct(F.lit("search").alias("name"), F.array_repeat(F.lit("law:1"), n).alias("result_ids"))
    records = rows.select(
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.col("conv_id").cast("string").alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("IB", "RETAIL", "WM"))), (F.col("conv_id") % 3 + 1).cast("int")).alias("dept"),
        F.col("text").alias("user_message"),
        F.when(F.col("turn") % 2 == 1, F.array(call(2), call(1))).otherwise(F.array(call(2))).alias("tool_calls"),
        F.array_repeat(F.lit("law:1"), (F.col("turn") % 3).cast("int")).alias("verified_citations"),
        F.array(F.lit("ghost:1")).alias("rejected_citations"),
        F.col("text").alias("answer"),
    )
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    for part in (records.where("user_id % 2 = 0"), records.where("user_id % 2 = 1")):
        guard.append_audit(part, folder)
    return guard.audit_rollup(guard.read_audit(spark, folder))


@query(f"SELECT item_id, {S.STRIP % 'q'} AS query, CAST(CASE WHEN item_id%3=0 THEN 6 ELSE item_id%3 END AS BIGINT) AS top_k, CASE WHEN item_id%4=0 THEN NULL ELSE DATE '2024-01-01'+CAST(item_id%28 AS INTEGER) END AS as_of, CASE WHEN item_id%2=0 THEN 'law,faq' END AS source_types FROM (SELECT item_id, chr(9)||'\u00a0\u3000 '||text||' \u2003'||chr(10) AS q FROM benchmark WHERE text IS NOT NULL)")
def parse_requests(spark, d):
    """Loosely written requests: padded texts, zero for the default count, blank dates, unknown types."""
    rows = adapter.read(spark, d, "benchmark").where("text is not null")
    raw = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("\u3000Law\u00a0"), F.lit("faq"), F.lit("nothing"), F.lit("LAW"))).otherwise(F.array(F.lit("nothing")))
    day = F.when(F.col("item_id") % 4 == 0, "\u3000 ").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("item_id") % 28 + 1).cast("string"), 2, "0")))
    return rows.select("item_id", strip(F.concat(F.lit("\t\u00a0\u3000 "), "text", F.lit(" \u2003\n"))).alias("query"), parse_top_k((F.col("item_id") % 3).cast("int")).cast("bigint").alias("top_k"), korean.coerce_date(day).alias("as_of"), F.array_join(parse_source_types(raw), ",").alias("source_types"))


@query("SELECT event_id, CASE WHEN event_id%3=0 THEN CAST(ts AS DATE) WHEN event_id%3=1 THEN NULL END AS day FROM events")
def coerce_date(spark, d):
    """Timestamps in ISO form, blank texts and impossible dates."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\u3000\u00a0"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).when(F.col("event_id") % 3 == 1, " \u2003\u00a0").otherwise(F.lit("2024-13-45"))
    return adapter.read(spark, d, "events").select("event_id", korean.coerce_date(text).alias("day"))


@query("SELECT event_id, CAST(ts AS DATE) AS compact, CAST(ts AS DATE) AS dotted, CASE WHEN event_id%2=0 THEN CAST(ts AS DATE) END AS noted FROM events")
def kr_dates(spark, d):
    """``yyyymmdd``, ``[시행 Y. M. D.]`` and ``[시행일: Y. M. D.]``."""
    dotted = F.concat(F.year("ts").cast("string"), F.lit(". "), F.month("ts").cast("string"), F.lit(". "), F.dayofmonth("ts").cast("string"), F.lit(".]"))
    noted = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x [시행일: "), dotted)).otherwise(F.lit("x"))
    day = lambda t: F.get(korean.dates_in(t, korean.IN_FORCE), 0)
    return adapter.read(spark, d, "events").select("event_id", korean.compact_date(F.date_format("ts", "yyyyMMdd")).alias("compact"), day(F.concat(F.lit("[시행 "), dotted)).alias("dotted"), day(noted).alias("noted"))
