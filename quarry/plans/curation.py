"""Curation queries over documents, embeddings and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import table
from quarry.operators import aggregates as A, curation as C
from quarry.plans.aggregates import _TREND, trends
from quarry.plans.registry import query

_SH = r"""w AS (SELECT doc_id, n_chars, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, n_chars, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) END AS g FROM w WHERE len(w) > 0)"""
_LINKS = _SH + """, c AS (SELECT g, min(doc_id) AS cls FROM s GROUP BY g), x AS (SELECT cls, len(g) AS n, unnest(g) AS h FROM c),
p AS (SELECT a.cls AS a, b.cls AS b, count(*) / (a.n + b.n - count(*)) AS j FROM x a JOIN x b ON a.h = b.h AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.85)"""


def english(spark, d):
    return table(spark, d, "documents").where("lang = 'en'")


@query("CUR_01", f"WITH {_SH} SELECT doc_id, len(list_distinct(list_transform(g, lambda x: substr(md5(x), 1, 8)))) AS n, list_min(list_transform(g, lambda x: substr(md5(x), 1, 8))) AS least FROM s")
def shingles(spark, d):
    x = english(spark, d).select("doc_id", C.shingle_hashes(F.col("text")).alias("h")).where("size(h) > 0")
    return x.select("doc_id", F.size("h").alias("n"), F.lower(F.lpad(F.hex(F.array_min("h")), 8, "0")).alias("least"))


@query("CUR_03", f"WITH {_LINKS} SELECT a, b, round(j, 6) AS jaccard FROM p")
def near_duplicates(spark, d):
    return C.duplicate_links(english(spark, d), "doc_id", "text")[1]


@query("CUR_03_classes", f"WITH {_SH}, c AS (SELECT g, min(doc_id) AS cls, count(*) AS n FROM s GROUP BY g) SELECT doc_id, cls, n FROM s JOIN c USING (g)")
def duplicate_classes(spark, d):
    return C.duplicate_links(english(spark, d), "doc_id", "text")[0]


@query("CUR_03_kept", f"""WITH RECURSIVE {_LINKS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), k AS (SELECT node, min(c) AS c FROM r GROUP BY 1),
m AS (SELECT s.doc_id, s.n_chars, coalesce(k.c, c.cls) AS comp FROM s JOIN c ON c.g = s.g LEFT JOIN k ON k.node = c.cls) SELECT min_by(doc_id, (-n_chars, doc_id)) AS doc_id FROM m GROUP BY comp""")
def kept(spark, d):
    rows = english(spark, d)
    classes, links = C.duplicate_links(rows, "doc_id", "text")
    return C.survivors(classes, links, rows, "doc_id", "n_chars")


# The queries above and their SQL take documents labelled 'en' alone; those below take the whole table.
# Their SQL would be too slow, so tests compare them with brute force.


@query("CUR_01_all")
def shingles_all(spark, d):
    x = table(spark, d, "documents").select("doc_id", C.shingle_hashes(F.col("text")).alias("h")).where("size(h) > 0")
    return x.select("doc_id", F.size("h").alias("n"), F.lower(F.lpad(F.hex(F.array_min("h")), 8, "0")).alias("least"))


@query("CUR_03_all")
def near_duplicates_all(spark, d):
    return C.duplicate_links(table(spark, d, "documents"), "doc_id", "text")[1]


@query("CUR_03_classes_all")
def duplicate_classes_all(spark, d):
    return C.duplicate_links(table(spark, d, "documents"), "doc_id", "text")[0]


@query("CUR_03_kept_all")
def kept_all(spark, d):
    rows = table(spark, d, "documents")
    classes, links = C.duplicate_links(rows, "doc_id", "text")
    return C.survivors(classes, links, rows, "doc_id", "n_chars")


@query("TOP_01", """SELECT a.vec_id AS query, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) <= 10""")
def vector_search(spark, d):
    e = table(spark, d, "embeddings")
    return C.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@query("CUR_05")
def coreset(spark, d):
    return C.coreset(table(spark, d, "embeddings"), "vec_id", "embedding", 40)


_U = "('0x' || substr(md5(record_no || '|42'), 1, 8))::BIGINT / 4294967296.0"


@query("CUR_07", f"SELECT record_no, CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM sft_records")
def splits(spark, d):
    return C.split(table(spark, d, "sft_records").drop("split"), "record_no").select("record_no", "split")


@query("CUR_09", f"WITH {_TREND}, c AS (SELECT guid, avg(prob) AS m, stddev_pop(prob) AS s FROM e GROUP BY 1) SELECT guid, CASE WHEN round(s, 12) >= 0.15 THEN 'ambiguous' WHEN round(m, 12) >= 0.7 THEN 'easy' ELSE 'hard' END AS region FROM c")
def regions(spark, d):
    return A.coordinates(trends(spark, d), "guid", ["epoch"], "prob", "correct").select("guid", "region")


@query("CUR_10", f"""WITH {_TREND}, c AS (SELECT guid, avg(prob) AS m, stddev_pop(prob) AS s FROM e GROUP BY 1), g AS (SELECT guid, CASE WHEN round(s, 12) >= 0.15 THEN 'ambiguous' WHEN round(m, 12) >= 0.7 THEN 'easy' ELSE 'hard' END AS region FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5(guid || '|42'), guid) AS i, count(*) OVER (PARTITION BY region) AS n FROM g) SELECT guid, region FROM r WHERE region = 'ambiguous' OR (region = 'easy' AND i <= greatest(1, round(n * 0.2)))""")
def active(spark, d):
    return C.active_subset(A.coordinates(trends(spark, d), "guid", ["epoch"], "prob", "correct").select("guid", "region"), "guid")


@query("CUR_14", """WITH r AS (SELECT record_no, metadata.task_type AS task, count(*) OVER (PARTITION BY metadata.task_type) AS n, row_number() OVER (PARTITION BY metadata.task_type ORDER BY md5(record_no || '|42'), record_no) AS i FROM sft_records)
SELECT record_no, task, unnest(range(0, CASE WHEN n < 200 THEN floor((200 - i) / n)::INT + 1 ELSE 1 END))::INT AS copy FROM r WHERE i <= 250""")
def balance(spark, d):
    x = table(spark, d, "sft_records").select("record_no", F.col("metadata.task_type").alias("task"))
    return C.balanced(x, "record_no", "task", 250, 200)


@query("CUR_19", """SELECT sample_id, record_no, CASE WHEN metadata.task_type LIKE 'EXTRACT%' THEN 'structure' WHEN metadata.is_hard_negative THEN 'negative' WHEN metadata.task_type = 'SUPPLY_QA' THEN 'answer' ELSE 'prose' END AS bucket FROM dpo_records
WHERE chosen IS NOT NULL AND rejected IS NOT NULL AND trim(chosen) <> '' AND chosen <> rejected AND sample_id NOT IN (SELECT sample_id FROM sft_records WHERE split = 'test') QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY record_no) = 1""")
def preferences(spark, d):
    held = table(spark, d, "sft_records").where("split = 'test'")
    return C.preference_pairs(table(spark, d, "dpo_records"), held).select("sample_id", "record_no", "bucket")


@query("CUR_11", r"SELECT id, kind FROM (SELECT id, unnest([CASE WHEN regexp_matches(raw_text, '(?i)\bsettlement\b') THEN 'LEGAL' END, CASE WHEN regexp_matches(raw_text, '(?i)\bransomware\b') THEN 'CYBER' END, CASE WHEN regexp_matches(raw_text, '(?i)\bpatents?\b') THEN 'LICENSE' END]) AS kind FROM financial_news_queue) WHERE kind IS NOT NULL")
def rare_classes(spark, d):
    pats = (("LEGAL", r"(?i)\bsettlement\b"), ("CYBER", r"(?i)\bransomware\b"), ("LICENSE", r"(?i)\bpatents?\b"))
    t = F.col("raw_text")
    return table(spark, d, "financial_news_queue").select("id", F.explode(F.array(*[F.when(t.rlike(p), n) for n, p in pats])).alias("kind")).where("kind is not null")
