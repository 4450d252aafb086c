"""SQL (DuckDB) building blocks with the same rows as the engine's DataFrames."""

from __future__ import annotations

import re

from statuta.functions.predicates import AUTHORITY
from statuta.functions.text import ASCII_DIGITS, DIGIT, DIGITS, SPACE, STRIPPED

TYPES = "['law','regulation','interpretation','case','review','faq','precedent']"
DEPTS = "['IB','RETAIL','WM']"

ENT = f"""ent0 AS (SELECT doc_id, coalesce(text,'') AS text, source, doc_id%7 AS t, (doc_id//21)*7+doc_id%7 AS family, (doc_id//7)%3 AS version FROM documents WHERE doc_id IS NOT NULL),
ent AS (SELECT doc_id, t, version, source, {TYPES}[t+1] AS type, {TYPES}[t+1]||':'||doc_id AS entity_id,
 'Code'||(family//14)||'법 제'||(family%14+1)||'조('||split_part(text,' ',1)||')' AS title,
 CASE WHEN t>=2 THEN text||' 「Code'||((family-t)//14)||'법」 제'||((family-t)%14+1)||'조' ELSE text END AS body,
 DATE '2020-01-01'+CAST(family%200+400*version AS INTEGER) AS effective_date,
 CASE WHEN version<2 THEN DATE '2020-01-01'+CAST(family%200+400*version+CASE WHEN family%5=0 THEN 300 ELSE 400 END AS INTEGER) END AS superseded_date,
 CASE WHEN t IN (4,6) THEN [{DEPTS}[doc_id%3+1]] ELSE ['ALL'] END AS allowed_depts FROM ent0)"""

EDGE = f"""edge AS (SELECT entity_id AS src, 'supersedes' AS type, {TYPES}[(doc_id-7)%7+1]||':'||(doc_id-7) AS dst FROM ent WHERE version>0
 UNION ALL SELECT entity_id, ['interprets','violates','cites','answered_by','cites'][t-1], {TYPES}[(doc_id-[2,3,3,4,6][t-1])%7+1]||':'||(doc_id-[2,3,3,4,6][t-1]) FROM ent WHERE t>=2)"""

REQ = f"""req AS (SELECT item_id AS query_id, coalesce(text,'')||CASE WHEN item_id%2=0 THEN ' 제'||(item_id%14+1)||'조' ELSE '' END AS query,
 {DEPTS}[item_id%3+1] AS dept, DATE '2020-06-01'+CAST(45*item_id AS INTEGER) AS as_of, 6 AS top_k FROM benchmark)"""


STRIP = f"regexp_replace(%s,'{STRIPPED}','','g')"


def ascii_digits(text: str) -> str:
    return f"translate({text},'{DIGITS}','{ASCII_DIGITS}')"


def tokens(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower({text}),'[가-힣]+|[0-9a-zA-Z]+'), lambda w: CASE WHEN regexp_full_match(w,'[가-힣]+') AND length(w)>1 THEN list_concat([w], list_transform(range(1,length(w)), lambda i: substr(w,i,2))) ELSE [w] END))"


def ngrams(text: str) -> str:
    low = f"string_split(lower({text}),'')"
    return f"CASE WHEN length({text})<2 THEN [lower({text})] ELSE list_concat(list_transform(range(1,len({low})), lambda i: c[i]||c[i+1]), list_transform(range(1,len({low})-1), lambda i: c[i]||c[i+1]||c[i+2])) END"


CHAIN = """ids AS (SELECT DISTINCT entity_id FROM ent),
sup AS (SELECT src a,dst b FROM edge WHERE type='supersedes' AND dst IN (SELECT entity_id FROM ids) UNION SELECT dst,src FROM edge WHERE type='supersedes' AND dst IN (SELECT entity_id FROM ids)),
reach AS (SELECT entity_id, entity_id AS other FROM ids UNION SELECT r.entity_id, s.b FROM reach r JOIN sup s ON r.other=s.a),
chain AS (SELECT entity_id, min(other) AS chain_id FROM reach GROUP BY 1)"""

POSTINGS = f"""tok AS (SELECT entity_id, unnest({tokens("concat_ws(chr(10),title,body)")}) AS term FROM ent),
post AS (SELECT term, entity_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT entity_id, count(*) AS doc_len FROM tok GROUP BY 1),
cs AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM dl)"""


def bm25(width: str | None = "top_k*5") -> str:
    return f"""qt AS (SELECT query_id, unnest(list_distinct({tokens("query")})) AS term FROM req),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
lx0 AS (SELECT query_id, post.entity_id, round(sum(ln(1+(n_docs-df+0.5)/(df+0.5))*tf*2.5/(tf+1.5*(0.25+0.75*doc_len/avg_len))),6) AS score FROM qt JOIN post USING(term) JOIN df USING(term) JOIN dl USING(entity_id), cs GROUP BY 1,2),
lx AS (SELECT query_id, entity_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM lx0) JOIN req USING(query_id) WHERE {upto(width)})"""


def upto(width: str | None) -> str:
    return "true" if width is None else f"rank<={width}"


def embed(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}c AS (SELECT {key}, {text} AS x, string_split(lower({text}),'') AS c FROM {source}),
{name}g AS (SELECT {key}, unnest(CASE WHEN length(x)<2 THEN [lower(x)] ELSE list_concat(list_transform(range(1,len(c)), lambda i: c[i]||c[i+1]), list_transform(range(1,len(c)-1), lambda i: c[i]||c[i+1]||c[i+2])) END) AS gram FROM {name}c),
{name}n AS (SELECT {key}, gram, count(*) AS n FROM {name}g GROUP BY ALL),
{name}h AS (SELECT gram, CAST('0x'||substr(sha256(gram),63,2) AS INTEGER) AS idx, CASE WHEN CAST('0x'||substr(sha256(gram),61,2) AS INTEGER)%2=0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT gram FROM {name}n)),
{name}s AS (SELECT {key}, idx, CAST(sum(n*sign) AS DOUBLE) AS w FROM {name}n JOIN {name}h USING(gram) GROUP BY ALL HAVING sum(n*sign)<>0),
{name} AS (SELECT {key}, idx, w/sqrt(sum(w*w) OVER (PARTITION BY {key})) AS w FROM {name}s)"""


def vector(width: str | None = "top_k*5", both: str | None = None) -> str:
    both = both or embed("ev", "ent", "entity_id", "concat_ws(chr(10),title,body)") + ",\n" + embed("qv", "req", "query_id", "query")
    return both + f""",
vx0 AS (SELECT query_id, entity_id, round(sum(ev.w*qv.w),6) AS score FROM qv JOIN ev USING(idx) GROUP BY 1,2),
vx1 AS (SELECT vx0.*, top_k FROM vx0 JOIN ent USING(entity_id) JOIN req USING(query_id) WHERE score>=0.05 AND {open_to('ent', 'req')} AND {in_force('ent', 'req')}),
vx AS (SELECT query_id, entity_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM vx1) WHERE {upto(width)})"""


def open_to(e: str, r: str) -> str:
    return f"(list_contains({e}.allowed_depts,'ALL') OR list_contains({e}.allowed_depts,{r}.dept))"


def in_force(e: str, r: str) -> str:
    return f"({e}.effective_date IS NULL OR {e}.effective_date<={r}.as_of) AND ({e}.superseded_date IS NULL OR {r}.as_of<{e}.superseded_date)"


RANK = "coalesce(map {" + ",".join(f"'{k}':{v}" for k, (v, _) in AUTHORITY.items()) + "}[%s],8)"
LABEL = "coalesce(map {" + ",".join(f"'{k}':'{v}'" for k, (_, v) in AUTHORITY.items()) + "}[%s],%s)"

RESOLVED = """asked AS (SELECT DISTINCT chain_id, as_of FROM chain, (SELECT DISTINCT as_of FROM req)),
cand AS (SELECT a.chain_id, a.as_of, e.entity_id, e.effective_date AS eff, (e.effective_date<=a.as_of AND (e.superseded_date IS NULL OR a.as_of<e.superseded_date)) AS valid FROM asked a JOIN chain c USING(chain_id) JOIN ent e ON e.entity_id=c.entity_id WHERE e.effective_date<=a.as_of),
res0 AS (SELECT *, row_number() OVER (PARTITION BY chain_id,as_of ORDER BY valid DESC, CASE WHEN valid THEN epoch(eff) ELSE -epoch(eff) END, entity_id) AS n FROM cand),
res AS (SELECT c.entity_id, r.as_of, r.entity_id AS resolved_id FROM res0 r JOIN chain c USING(chain_id) WHERE n=1)"""

ARTICLE = f"제{SPACE}*{DIGIT}+{SPACE}*조(?:{SPACE}*의{SPACE}*{DIGIT}+)?"
NEEDLES = f"""nd0 AS (SELECT query_id, dept, as_of, list_transform(regexp_extract_all(query,'{ARTICLE}'), lambda h: regexp_replace(h,'{SPACE}','','g')) AS l FROM req),
nd AS (SELECT DISTINCT query_id, dept, as_of, unnest(l) AS needle, list_position(l, unnest(l)) AS needle_no FROM nd0)"""

CITED = NEEDLES + f""",
ct0 AS (SELECT nd.*, e.entity_id, row_number() OVER (PARTITION BY query_id,needle_no ORDER BY e.entity_id) AS n FROM nd JOIN ent e ON contains(e.title, needle)),
ct1 AS (SELECT query_id, resolved_id, min(needle_no*1000+n) AS first FROM ct0 JOIN res ON res.entity_id=ct0.entity_id AND res.as_of=ct0.as_of JOIN ent e ON e.entity_id=resolved_id WHERE n<=10 AND {open_to('e', 'ct0')} GROUP BY 1,2),
cited AS (SELECT query_id, resolved_id AS entity_id, 1.0::DOUBLE AS score, 'citation_match' AS reason, 0 AS phase, row_number() OVER (PARTITION BY query_id ORDER BY first, resolved_id) AS seq FROM ct1)"""

POOL = f"""hits AS (SELECT query_id, entity_id, rank, 0 AS channel FROM lx UNION ALL SELECT query_id, entity_id, rank, 1 FROM vx),
hr AS (SELECT h.query_id, resolved_id, e.type, rank, channel FROM hits h JOIN req USING(query_id) JOIN res ON res.entity_id=h.entity_id AND res.as_of=req.as_of JOIN ent e ON e.entity_id=resolved_id WHERE {open_to('e', 'req')} AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.query_id=h.query_id AND c.entity_id=resolved_id)),
fused AS (SELECT query_id, resolved_id AS entity_id, type, round(sum(1.0::DOUBLE/(60+rank)),9) AS fused, min(channel*1000000+rank) AS first FROM hr GROUP BY ALL),
pool AS (SELECT query_id, entity_id, type, fused, CASE WHEN first<1000000 THEN 'lexical_match' ELSE 'vector_match' END AS reason, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, entity_id) AS pool_rank FROM fused)"""

SELECTED = """sel0 AS (SELECT *, row_number() OVER (PARTITION BY query_id,type ORDER BY pool_rank) AS type_rank FROM pool),
sel AS (SELECT sel0.* FROM sel0 JOIN req USING(query_id) WHERE pool_rank<=top_k OR type_rank<=5),
rr AS (SELECT *, CAST(count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY pool_rank) + 1 AS DOUBLE) AS rerank_score FROM sel)"""

BASE = """base AS (SELECT * FROM cited UNION ALL SELECT query_id, entity_id, rerank_score, reason, 1, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pool_rank) FROM rr)"""

NEAR = """both0 AS (SELECT src AS entity_id, 0 AS direction, type, dst AS neighbour FROM edge UNION ALL SELECT dst, 1, type, src FROM edge),
near0 AS (SELECT entity_id, neighbour, min(direction) AS direction FROM both0 WHERE type IN ('interprets','violates','cites','related_to','answered_by') AND entity_id<>neighbour AND neighbour IN (SELECT entity_id FROM ent) GROUP BY 1,2),
near AS (SELECT entity_id, neighbour, row_number() OVER (PARTITION BY entity_id ORDER BY direction, neighbour) AS position FROM near0)"""

EXPANDED = f"""ex0 AS (SELECT query_id, neighbour, min(phase*100000000+seq*100+position) AS first FROM base JOIN near USING(entity_id) WHERE position<=3 GROUP BY 1,2),
ex AS (SELECT ex0.query_id, neighbour AS entity_id, 0.0::DOUBLE AS score, '1hop_expansion' AS reason, 2 AS phase, row_number() OVER (PARTITION BY ex0.query_id ORDER BY first, neighbour) AS seq FROM ex0 JOIN ent e ON e.entity_id=neighbour JOIN req ON req.query_id=ex0.query_id WHERE {open_to('e', 'req')} AND {in_force('e', 'req')} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.query_id=ex0.query_id AND b.entity_id=neighbour))"""

FINAL = f"""fin AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {RANK % 'type'}, score DESC, phase, seq) AS BIGINT) AS position, entity_id, type, score, reason FROM (SELECT * FROM base UNION ALL SELECT * FROM ex) x JOIN ent USING(entity_id))"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


HYBRID = (ENT, EDGE, REQ, CHAIN, RESOLVED, CITED, POSTINGS, bm25(), vector(), POOL, SELECTED, BASE, NEAR, EXPANDED, FINAL)


def renamed(part: str, prefix: str = "wide_") -> str:
    """A part whose steps (hits, channels, pool) have names of their own, so that it can stand beside the first."""
    steps = ("qt", "df", "lx0", "lx", "evc", "evg", "evn", "evh", "evs", "ev", "qvc", "qvg", "qvn", "qvh", "qvs", "qv", "vx0", "vx1", "vx", "hits", "hr", "fused", "pool")
    table = "|".join(steps)
    part = re.sub(rf"(?m)(^|,\s*)({table})(?= AS \()", rf"\g<1>{prefix}\g<2>", part)
    part = re.sub(rf"\b(FROM|JOIN) ({table})\b", rf"\g<1> {prefix}\g<2>", part)
    return re.sub(rf"\b({table})\.", rf"{prefix}\g<1>.", part)
