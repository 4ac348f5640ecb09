"""The subpackage's queries: production parameters over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import table

# The rules of the url query.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.suffix_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality_classifier import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.url_filter import url_filter

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.near_dedup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.license_scan import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def license_sql() -> str:
    """Every piece against every block of its width, and every place of every phrase."""
    from lodestrata.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, Pieces

    rows = Pieces(TEMPLATES, PHRASES, THRESHOLD).rows
    listed = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"
    values = ",".join(f"('{r['label']}',{listed(r['words'])},{r['width']},{r['need']},{str(r['phrase']).lower()})" for r in rows)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(label, ws, width, need, phrase) AS (VALUES {values}),
blocks AS (SELECT doc_id, width, list_distinct(w[s+1:s+width]) AS held FROM (SELECT doc_id, w, width, unnest(range(0, len(w), width//4)) AS s FROM d, (SELECT DISTINCT width FROM t WHERE NOT phrase))),
places AS (SELECT doc_id, label, list_filter(range(0, len(w)), lambda i: w[i+1:i+len(ws)]=ws) AS places FROM d, t WHERE phrase),
met AS (SELECT doc_id, label, len(list_intersect(held, list_distinct(ws))) AS shared, need, len(list_distinct(ws)) AS size FROM blocks JOIN t ON t.width=blocks.width AND NOT phrase),
h AS (SELECT doc_id, label, true AS phrase, places, 1.0::DOUBLE AS score FROM places WHERE len(places)>0 UNION ALL SELECT doc_id, label, false, []::BIGINT[], max(shared::DOUBLE/size) FROM met WHERE shared>=need GROUP BY doc_id, label),
g AS (SELECT doc_id, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word, string_agg(DISTINCT CASE WHEN phrase THEN label END, ',' ORDER BY CASE WHEN phrase THEN label END) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base,0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels,'') AS base_labels, coalesce(labels,'') AS labels, coalesce(score,0.0)::DOUBLE AS score
FROM d LEFT JOIN g ON g.doc_id=d.doc_id"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_url_filter": """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),('example.net','/de/8','block'),('org','/es/','block')),
cut AS (SELECT page_id, CASE WHEN instr(url,'://')>0 THEN substr(url, instr(url,'://')+3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest,'^[^/?#]*',0),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) AS path FROM cut),
fit AS (SELECT p.page_id, rhost||rpath AS rule, rverdict AS verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost||rpath) DESC, length(rhost) DESC) AS rn
  FROM p JOIN rules ON (p.host=rhost OR ends_with(p.host,'.'||rhost)) AND starts_with(p.path,rpath))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict,'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id=p.page_id AND fit.rn=1""",
        "op11_license_scan": license_sql(),
        "op12_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source,'') AS part, coalesce(text,'') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, length(regexp_replace(text,'[^A-Z]','','g')) AS capitals FROM d),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
f AS (SELECT w.doc_id, part, CASE WHEN len(words)<200 THEN 1 ELSE 0 END + CASE WHEN 100*len(list_distinct(words))<50*len(words) THEN 2 ELSE 0 END + CASE WHEN 100*capitals>2*length(w.text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(w.text,'[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id IS DISTINCT FROM first_id THEN 16 ELSE 0 END AS mask FROM w JOIN firsts ON firsts.text=w.text),
l AS (SELECT doc_id, max(CASE WHEN quality=1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic=1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(coalesce(good,0)) AS good, sum(coalesce(toxic,0)) AS toxic FROM f LEFT JOIN l ON l.doc_id=f.doc_id GROUP BY part, mask),
c(letter, bit) AS (VALUES ('A',1),('B',2),('C',4),('D',8),('E',16)),
o AS (SELECT a.letter||b.letter||c1.letter||d1.letter||e.letter AS filter_order FROM c a, c b, c c1, c d1, c e WHERE a.bit+b.bit+c1.bit+d1.bit+e.bit=31 AND len(list_distinct([a.bit,b.bit,c1.bit,d1.bit,e.bit]))=5),
s AS (SELECT filter_order, step, substr(filter_order,step,1) AS letter, (SELECT bit FROM c WHERE letter=substr(filter_order,step,1)) AS bit,
  (SELECT coalesce(sum(bit),0) FROM c WHERE contains(substr(filter_order,1,step-1), letter)) AS before FROM o, range(1,6) t(step)),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (before+bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, (SELECT filter_order, step, letter, bit::INT AS bit, before::INT AS before FROM s) GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r""",
        "op13_prefix_trie": """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,''))-1 AS k, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c-c%5 AS donor FROM t),
crc AS (SELECT c, donor, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR,''), lambda x: ord(x)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r,b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM ids),
r AS (SELECT crc.c, k, role, text FROM crc JOIN t ON t.c=donor WHERE k<h UNION ALL SELECT crc.c, k, role, text FROM crc JOIN t ON t.c=crc.c WHERE k>=h),
u AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, strlen(text) AS b, md5(concat(strlen(role)::VARCHAR, ':', role, text)) AS tid FROM r),
p AS (SELECT c, d, b, string_agg(tid, '') OVER (PARTITION BY c ORDER BY d) AS path FROM u UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS bytes, sha256(coalesce(string_agg(CASE WHEN d=last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM p) GROUP BY path, d),
m AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth=n.depth+1 AND substr(k.path,1,length(n.path))=n.path) AS n_children FROM n LEFT JOIN n u ON u.depth=n.depth-1 AND u.path=substr(n.path,1,length(n.path)-32)),
up AS (SELECT m.*, unnest(range(0, depth+1)) AS top FROM m),
s AS (SELECT substr(path,1,32*top) AS path, sum(CASE WHEN n_children=0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs-1)*bytes) AS saved FROM up GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM m JOIN s ON s.path=m.path""",
    }
