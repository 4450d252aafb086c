"""The registered queries of the training-data operators and their SQL.

Each query reads the whole table of ``sf_dir`` with production parameters and derives the digest columns
from its operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import bpe, conversations, embedding_dedup, filter_audit, langid, packing, quality, ranking, secrets, simhash, substring_dedup, toxicity, url_filter
from statuta.llm.common import crc_fold

QUERIES = {}
ORACLE_SQL = {
    "op3_embedding_dedup": """WITH RECURSIVE s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding)>0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(embedding, lambda x: x<>0))>0 AS sound FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label=b.label AND a.vec_id<>b.vec_id AND a.sound AND b.sound AND len(a.e)=len(b.e) WHERE list_cosine_similarity(a.e,b.e)>=0.98),
r AS (SELECT vec_id, vec_id AS other FROM s UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other=l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n,0) AS n_links, component_id, vec_id=component_id AS kept FROM s JOIN c USING(vec_id) LEFT JOIN n USING(vec_id)""",
    "op6_quality_rules": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang,'') AS reference, coalesce(text,'') AS text, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') AS w FROM documents),
df AS (SELECT reference, word, count(*) AS n FROM (SELECT reference, unnest(list_distinct(w)) AS word FROM d) GROUP BY ALL),
top AS (SELECT reference, word FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY n DESC, word) AS k FROM df) WHERE k<=8),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS times FROM (SELECT rid, unnest(range(1,len(w)-6)) AS i, unnest(list_transform(range(1,len(w)-6), lambda i: array_to_string(w[i:i+7],' '))) AS s FROM d WHERE len(w)>=9)),
rep AS (SELECT rid, count(DISTINCT i+k) AS n FROM win, (SELECT unnest(range(8)) AS k) WHERE times>1 GROUP BY 1),
b AS (SELECT rid, doc_id, reference, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w,'')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text,'[^#*$%&|<>]+','','g')) AS BIGINT) AS n_symbols,
 CAST(len(list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')))-len(list_distinct(list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n,0) AS BIGINT) AS n_repeat_words,
 length(regexp_replace(text,'[^\p{Lu}]+','','g')) AS c1, length(regexp_replace(text,'[^0-9]+','','g')) AS c2, length(regexp_replace(text,'[^.,;:!?''"()\-]+','','g')) AS c3 FROM d LEFT JOIN rep USING(rid)),
cls AS (SELECT rid, reference, unnest([c1,c2,c3,n_symbols,greatest(0,word_chars-n_symbols-c1-c2-c3)]) AS c, unnest(range(5)) AS k FROM b),
com AS (SELECT d.rid, d.reference, t.word AS k, coalesce(n,0) AS c FROM d JOIN top t USING(reference) LEFT JOIN (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL) o ON o.rid=d.rid AND o.word=t.word),
js1 AS (SELECT rid, sqrt(greatest(0,sum(CASE WHEN p>0 THEN p*log2(2*p/(p+q)) ELSE 0 END+CASE WHEN q>0 THEN q*log2(2*q/(p+q)) ELSE 0 END)/2)) AS dist FROM (SELECT rid, CASE WHEN sum(c) OVER (PARTITION BY rid)>0 THEN c::DOUBLE/sum(c) OVER (PARTITION BY rid) ELSE 0 END AS p, CASE WHEN sum(c) OVER (PARTITION BY reference)>0 THEN (sum(c) OVER (PARTITION BY reference,k))::DOUBLE/sum(c) OVER (PARTITION BY reference) ELSE 0 END AS q FROM cls) GROUP BY 1),
js2 AS (SELECT rid, sqrt(greatest(0,sum(CASE WHEN p>0 THEN p*log2(2*p/(p+q)) ELSE 0 END+CASE WHEN q>0 THEN q*log2(2*q/(p+q)) ELSE 0 END)/2)) AS dist FROM (SELECT rid, c::DOUBLE/sum(c) OVER (PARTITION BY rid) AS p, (sum(c) OVER (PARTITION BY reference,k))::DOUBLE/sum(c) OVER (PARTITION BY reference) AS q, sum(c) OVER (PARTITION BY rid) AS own FROM com) WHERE own>=20 GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<20 OR 100*n_repeat_words>30*n_words AS base_failed, NOT (n_words<20 OR 100*n_repeat_words>30*n_words) AND NOT (n_words>=50 AND (js1.dist>0.33 OR coalesce(js2.dist>0.55,false))) AS kept FROM b LEFT JOIN js1 USING(rid) LEFT JOIN js2 USING(rid)""",
    "op7_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1,len(w)-11)) AS i, unnest(list_transform(range(1,len(w)-11), lambda i: array_to_string(w[i:i+12],' '))) AS s FROM d WHERE len(w)>=13),
low AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i+k AS pos FROM win JOIN low USING(s), (SELECT unnest(range(0,13)) AS k) WHERE first_id<doc_id),
ws AS (SELECT doc_id, unnest(w) AS word, unnest(range(1,len(w)+1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word,' ' ORDER BY pos) AS t, count(*) AS n FROM ws ANTI JOIN gone USING(doc_id,pos) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w)-coalesce(n,0) AS BIGINT) AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM d LEFT JOIN kept USING(doc_id)""",
    "op12_conversation_repair": r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c>>1, (c&1)*3988292384), i)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, coalesce(CAST(conv_id AS VARCHAR),' ')||':'||coalesce(CAST(turn AS VARCHAR),' ') AS id FROM conversations),
crc AS (SELECT raw.*, xor(list_reduce(list_transform(string_split(id,''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c>>8, t[(xor(c,b)&255)+1]), 4294967295), 4294967295)%20 AS h FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN h=4 THEN 'user' ELSE role END AS role, CASE WHEN h=1 THEN '' WHEN h=2 THEN regexp_replace(text,'[.!?]','','g') ELSE text END AS text FROM crc, range(2) AS c(k) WHERE h<>0 AND (k=0 OR h=3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)||':'||role||text)) AS p FROM dam),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p)>1 AS seen, CASE WHEN left(role,1) IN ('s','u','a') THEN left(role,1) ELSE 'o' END AS i FROM o),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text,'[^\x20\x09-\x0D]') THEN 'b' WHEN seen THEN 'd' WHEN right(regexp_replace(text,'[\x20\x09-\x0D]+$',''),1) NOT IN ('.','!','?') THEN 't' ELSE '-' END AS f, lag(i) OVER (PARTITION BY conv_id ORDER BY p)||i AS pair FROM n),
s AS (SELECT conv_id, count(*) AS len, string_agg(CASE WHEN f IN ('b','d') THEN 'X' WHEN f='t' THEN upper(i) ELSE i END,'' ORDER BY p) AS sig, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0) AS gaps, count(*) FILTER (f='b') AS blank, count(*) FILTER (f='d') AS duplicate, count(*) FILTER (f='t') AS truncated, count(*) FILTER (pair NOT IN ('su','ua','au')) AS illegal FROM g GROUP BY 1),
dp AS (SELECT conv_id, sig, len AS k, '00000000' AS b0, '00000010II' AS bs, '00000005I' AS bu, '00000000' AS ba FROM s UNION ALL
 SELECT conv_id, sig, k-1, least(c0, printf('%08d',CAST(left(vu,8) AS INTEGER)+5)||'I'||substr(vu,9)), least(cs, printf('%08d',CAST(left(vu,8) AS INTEGER)+5)||'I'||substr(vu,9)), vu, va FROM (SELECT *, least(cu, printf('%08d',CAST(left(ca,8) AS INTEGER)+5)||'I'||substr(ca,9)) AS vu, least(ca, printf('%08d',CAST(left(cu,8) AS INTEGER)+5)||'I'||substr(cu,9)) AS va FROM (SELECT conv_id, sig, k,
  least(d0, ru, CASE WHEN y='s' THEN ks WHEN y='u' THEN ku END) AS c0, least(ds, ru, CASE WHEN y='u' THEN ku END) AS cs, least(du, ra, CASE WHEN y='a' THEN ka END) AS cu, least(da, ru, CASE WHEN y='u' THEN ku END) AS ca FROM (SELECT conv_id, sig, k, lower(y) AS y,
   printf('%08d',CAST(left(b0,8) AS INTEGER)+2)||'D'||substr(b0,9) AS d0, printf('%08d',CAST(left(bs,8) AS INTEGER)+2)||'D'||substr(bs,9) AS ds, printf('%08d',CAST(left(bu,8) AS INTEGER)+2)||'D'||substr(bu,9) AS du, printf('%08d',CAST(left(ba,8) AS INTEGER)+2)||'D'||substr(ba,9) AS da,
   CASE WHEN y<>'X' THEN printf('%08d',CAST(left(bu,8) AS INTEGER)+1+m)||'R'||substr(bu,9) END AS ru, CASE WHEN y<>'X' THEN printf('%08d',CAST(left(ba,8) AS INTEGER)+1+m)||'R'||substr(ba,9) END AS ra,
   printf('%08d',CAST(left(bs,8) AS INTEGER)+m)||'K'||substr(bs,9) AS ks, printf('%08d',CAST(left(bu,8) AS INTEGER)+m)||'K'||substr(bu,9) AS ku, printf('%08d',CAST(left(ba,8) AS INTEGER)+m)||'K'||substr(ba,9) AS ka
   FROM (SELECT *, substr(sig,k,1) AS y, CASE WHEN substr(sig,k,1) IN ('S','U','A','O') THEN 5 ELSE 0 END AS m FROM dp WHERE k>0))))),
best AS (SELECT conv_id, CAST(left(b0,8) AS BIGINT) AS cost, substr(b0,9) AS audit FROM dp WHERE k=0),
e AS (SELECT conv_id, audit, j, substr(audit,j,1) AS e, length(replace(left(audit,j),'I','')) AS p, length(replace(left(audit,j),'D','')) AS q FROM best, LATERAL (SELECT unnest(range(1,length(audit)+1)) AS j)),
m AS (SELECT e.conv_id, q, e, i, CASE WHEN e='I' THEN '' ELSE text END AS text, role, max(CASE WHEN q=1 AND e='K' AND i='s' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS z FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.p=e.p AND e<>'I' WHERE e<>'D'),
w AS (SELECT conv_id, string_agg((CASE WHEN e='K' THEN role WHEN (q-z)%2=1 THEN 'user' ELSE 'assistant' END)||':'||text, chr(10) ORDER BY q) AS t FROM m GROUP BY 1)
SELECT a.conv_id, CAST(coalesce(gaps,0) AS BIGINT) AS gaps, CAST(coalesce(blank,0) AS BIGINT) AS blank, CAST(coalesce(duplicate,0) AS BIGINT) AS duplicate, CAST(coalesce(truncated,0) AS BIGINT) AS truncated, CAST(coalesce(illegal,0) AS BIGINT) AS illegal, CAST(coalesce(cost,0) AS BIGINT) AS cost, coalesce(audit,'') AS audit, sha256(coalesce(t,'')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang,'') AS part, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text,'')) AS first_id FROM documents),
l AS (SELECT doc_id, bool_or(quality=1) AS good, bool_or(toxic=1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, concat(CASE WHEN len(w)<200 THEN 'A' ELSE '' END, CASE WHEN 100*len(list_distinct(w))<50*len(w) THEN 'B' ELSE '' END, CASE WHEN 100*length(regexp_replace(t,'[^A-Z]+','','g'))>3*length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t,'[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id>first_id THEN 'E' ELSE '' END) AS mask, coalesce(good,false) AS good, coalesce(toxic,false) AS toxic FROM d LEFT JOIN l USING(doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
f AS (SELECT unnest(['A','B','C','D','E']) AS f),
o AS (SELECT a.f||b.f||c.f||d.f||e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f,b.f,c.f,d.f,e.f]))=5),
r AS (SELECT part, filter_order, mask, n, g, x, CASE WHEN mask='' THEN 6 ELSE list_min(list_transform(string_split(mask,''), lambda k: instr(filter_order,k))) END AS gone FROM c, o),
s AS (SELECT part, filter_order, step, substr(filter_order,step,1) AS k, sum(CASE WHEN gone>step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone=step THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone<step AND contains(mask,substr(filter_order,step,1)) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask=substr(filter_order,step,1) THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone=step THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN gone=step THEN x ELSE 0 END) AS toxic_lost FROM r, (SELECT CAST(unnest(range(1,6)) AS INTEGER) AS step) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM s""",
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the url filter: action, and host with the start of a path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(secrets.samples(spark, docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, with_decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 3)
    found = langid.predict(docs, langid.fit(docs, fold != 1))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    described, fold = ranking.describe(table(spark, sf_dir, "documents")), crc_fold(F.col("doc_id"), 4)
    model = ranking.fit(described, table(spark, sf_dir, "labels"), fold != 2)
    return ranking.score(described, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
