"""Queries that build training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import cut, table
from quarry.operators import aggregates as A, curation as C, training as R
from quarry.plans.aggregates import _TREND, trends
from quarry.plans.registry import query

# Written out for the SQL: relations of the ontology, noise and aliases.
_CANON = "('SUBSIDIARY_OF', 'PARENT_OF', 'SUPPLIES_TO', 'CUSTOMER_OF', 'SOLE_SOURCE_DEPENDENT_ON', 'COMPETES_WITH', 'PARTNERED_WITH', 'CEO_OF', 'EXECUTIVE_OF', 'DIRECTOR_OF', 'INSIDER_OF', 'EXPOSED_TO_RISK', 'LICENSES_FROM', 'LICENSES_TO', 'ACQUIRED_BY', 'DEFAULTED_ON', 'SPUN_OFF_FROM', 'OWNS', 'INVESTS_IN', 'PRODUCES', 'IMPACTS', 'REPORTS', 'FILED', 'CO_INVESTS_WITH', 'PEER_OF', 'COLLABORATES_WITH')"
_PRED = "CASE triple_id % 9 WHEN 0 THEN 'TRADES_WITH' WHEN 1 THEN 'HAS_SUBSIDIARY' WHEN 2 THEN 'ODD_' || (triple_id % 700) ELSE rel_type END"


@query("AGG_13", f"""WITH x AS (SELECT triple_id, {_PRED} AS predicate, CASE WHEN triple_id % 9 = 3 THEN 'OWNS' END AS canonical, CASE WHEN triple_id % 11 = 0 THEN 'GENERIC_PLACEHOLDER_NODE' ELSE 'DOMAIN' END AS reason, source_name FROM annotated_triples),
d AS (SELECT predicate, count(DISTINCT source_name) AS df FROM x GROUP BY 1)
SELECT triple_id, CASE WHEN reason = 'GENERIC_PLACEHOLDER_NODE' THEN 'PLACEHOLDER_NOISE' WHEN predicate = 'TRADES_WITH' THEN 'KNOWN_NOISE' WHEN predicate IN {_CANON} OR canonical = 'OWNS' THEN 'TYPING_ERROR' WHEN predicate IN ('HAS_SUBSIDIARY', 'EXPOSED_TO') THEN 'ALIASED' WHEN df < 3 THEN 'LOW_SUPPORT' ELSE 'CANDIDATE_FOR_REVIEW' END AS bucket FROM x JOIN d USING (predicate)""")
def triage(spark, d):
    k = F.col("triple_id")
    pred = F.when(k % 9 == 0, "TRADES_WITH").when(k % 9 == 1, "HAS_SUBSIDIARY").when(k % 9 == 2, F.concat(F.lit("ODD_"), (k % 700).cast("string"))).otherwise(F.col("rel_type"))
    x = table(spark, d, "annotated_triples").select("triple_id", pred.alias("predicate"), F.when(k % 9 == 3, "OWNS").alias("canonical"), F.when(k % 11 == 0, "GENERIC_PLACEHOLDER_NODE").otherwise("DOMAIN").alias("reason"), "source_name")
    df = x.groupBy("predicate").agg(F.countDistinct("source_name").alias("df"))
    return x.join(df, "predicate").select("triple_id", R.triage(F.col("predicate"), F.col("canonical"), F.col("reason"), F.col("df")).alias("bucket"))


@query("CUR_08", f"WITH {_TREND} SELECT guid, round(avg(prob), 4) AS confidence, round(stddev_pop(prob), 4) AS variability FROM e GROUP BY 1")
def coordinates(spark, d):
    x = A.coordinates(trends(spark, d), "guid", ["epoch"], "prob", "correct")
    return x.select("guid", "confidence", "variability")


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
_PAIRS = f"s AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.35)"


@query("JOI_12", f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM s")
def vector_pairs(spark, d):
    """All pairs of vectors at 0.35 or more."""
    x = C.similar_vectors(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vec_id", "embedding", 0.35)
    return x.select("a", "b", F.round("similarity", 6).alias("similarity"))


_GROUPS = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1),
u AS (SELECT vec_id, component, unnest(list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda w: w * w))))) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings JOIN c ON node = vec_id),
m AS (SELECT component, i, avg(v) AS v FROM u GROUP BY 1, 2), n AS (SELECT component, sqrt(sum(v * v)) AS n FROM m GROUP BY 1),
t AS (SELECT vec_id, u.component, round(sum(u.v * m.v) / any_value(n.n), 9) AS to_centre FROM u JOIN m ON m.component = u.component AND m.i = u.i JOIN n ON n.component = u.component GROUP BY 1, 2)"""


@query("CUR_04", _GROUPS + " SELECT vec_id, component, row_number() OVER (PARTITION BY component ORDER BY to_centre DESC, vec_id) = 1 AS kept FROM t")
def semantic_dedup(spark, d):
    """Groups at 0.35, where these vectors have some; the usual threshold is 0.88."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return C.semantic_groups(e, "vec_id", "embedding", 0.35).select("vec_id", "component", "kept")


@query("WIN_06", _GROUPS + " SELECT component, min_by(vec_id, (-to_centre, vec_id)) AS exemplar FROM t GROUP BY 1")
def exemplars(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return C.semantic_groups(e, "vec_id", "embedding", 0.35).where("kept").select("component", F.col("vec_id").alias("exemplar"))


@query("CUR_06")
def cold_start(spark, d):
    """Copies and near copies of texts go, then similar vectors, then a fifth is picked to cover the rest."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    classes, links = C.duplicate_links(docs, "doc_id", "text")
    kept = cut(C.survivors(classes, links, docs, "doc_id", "n_chars"))
    v = cut(kept.join(e.select(F.col("vec_id").cast("long").alias("doc_id"), "embedding"), "doc_id"))
    unlike = cut(C.semantic_groups(v, "doc_id", "embedding").where("kept").select("doc_id"))
    return C.coreset(v.join(unlike, "doc_id"), "doc_id", "embedding", max(1, unlike.count() // 5))


@query("CUR_12", r"""WITH n AS (SELECT DISTINCT cik AS entity, array_to_string(list_filter(string_split_regex(lower(company_name), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') AS nm FROM sp500_constituents), t AS (SELECT id, list_filter(string_split_regex(lower(raw_text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM financial_news_queue),
h AS (SELECT DISTINCT id, entity FROM t JOIN n ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || nm || ' ') WHERE len(ws) >= 30), s AS (SELECT id, list_sort(list(entity))[1:4] AS entities FROM h GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT DISTINCT least(source_cik, target_cik) AS a, greatest(source_cik, target_cik) AS b FROM annotated_triples WHERE source_cik IS NOT NULL AND target_cik IS NOT NULL),
p AS (SELECT id, x.e AS a, y.e AS b FROM (SELECT id, unnest(entities) AS e FROM s) x JOIN (SELECT id, unnest(entities) AS e FROM s) y USING (id) WHERE x.e < y.e)
SELECT id, entities FROM s WHERE id NOT IN (SELECT id FROM p JOIN k USING (a, b))""")
def hard_negatives(spark, d):
    t = table(spark, d, "annotated_triples").where("source_cik is not null and target_cik is not null").select(F.col("source_cik").alias("a"), F.col("target_cik").alias("b"))
    names = table(spark, d, "sp500_constituents").select(F.col("company_name").alias("name"), F.col("cik").alias("entity"))
    return R.hard_negatives(table(spark, d, "financial_news_queue").select("id", F.col("raw_text").alias("text")), names, t)


@query("CUR_13")
def template_negatives(spark, d):
    e = table(spark, d, "sp500_constituents").select(F.col("company_name").alias("entity"))
    known = table(spark, d, "annotated_triples").select(F.col("source_name").alias("a"), F.col("target_name").alias("b"))
    return R.template_negatives(e, known, "{a} and {b} both reported results this week.", 500)


@query("CUR_15", "SELECT task, CASE WHEN n < 150 THEN 300 ELSE 200 END AS floor FROM (SELECT metadata.task_type AS task, count(*) AS n FROM sft_records GROUP BY 1)")
def floors(spark, d):
    n = table(spark, d, "sft_records").groupBy(F.col("metadata.task_type").alias("task")).agg(F.count("*").alias("n"))
    short = {r["task"]: r["n"] < 150 for r in n.collect()}  # one row a task
    return spark.createDataFrame(list(R.steered({}, short).items()), "task string, floor int")


@query("CUR_16")
def augmented(spark, d):
    t = table(spark, d, "annotated_triples")
    rows = t.select("triple_id", F.concat("source_name", F.lit(" "), F.lower("rel_type"), F.lit(" "), "target_name").alias("text"), F.col("source_name").alias("name"), F.col("source_type").alias("kind"))
    return R.swapped(rows, "triple_id", "text", "name", t.select(F.col("source_name").alias("entity"), F.col("source_type").alias("kind")), "kind", 2)


_U = "('0x' || substr(md5(g || '|42'), 1, 8))::BIGINT / 4294967296.0"


@query("CUR_17", f"SELECT record_no, CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT record_no, coalesce(sample_id, record_no::VARCHAR) AS g FROM sft_records)")
def leak_free(spark, d):
    return R.checked_splits(table(spark, d, "sft_records").drop("split"), "record_no", "sample_id").select("record_no", "split")


@query("CUR_18", "WITH x AS (SELECT user_id, avg(CASE WHEN event_id % 3 = 0 THEN value / 100 END) AS a, avg(CASE WHEN event_id % 3 = 1 THEN value / 100 END) AS b FROM events GROUP BY 1) SELECT user_id, round(a, 6) AS first, round(b, 6) AS second, coalesce(a, 0) < 0.7 AND coalesce(b, 0) < 0.7 AS slow FROM x")
def slow_cohort(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, 50).when(F.col("event_id") % 3 == 1, 100).otherwise(150).alias("step"), (F.col("value") / 100).alias("p"))
    x = R.slow_learners(e, "user_id", "step", "p")
    return x.select("user_id", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), "slow")


@query("CUR_20", "SELECT record_no FROM sft_records WHERE record_no NOT IN (SELECT record_no FROM sft_records WHERE metadata.is_hard_negative) AND record_no % 3 <> 0")
def active_filter(spark, d):
    s = table(spark, d, "sft_records")
    return R.filtered_samples(s, s.where("metadata.is_hard_negative"), s.where("record_no % 3 <> 0"), "record_no").select("record_no")


@query("CUR_21")
def dataset(spark, d):
    """Records without hard negatives, balanced by task, without copies of prompts, split by sample without leak."""
    s = table(spark, d, "sft_records")
    x = R.filtered_samples(s, s.where("metadata.is_hard_negative"), s.limit(0), "record_no").select("record_no", "sample_id", "prompt", F.col("metadata.task_type").alias("task"))
    b = C.balanced(x, "record_no", "task", 10_000, 200)
    one = b.groupBy("prompt").agg(F.min("record_no").alias("record_no"))
    y = b.join(one.select("record_no"), "record_no", "left_semi")
    return R.checked_splits(y, "record_no", "sample_id").groupBy("task", "split").agg(F.count("*").alias("n"))


@query("CUR_22", """SELECT record_no, CASE record_no % 4 WHEN 0 THEN '(none) // REFUSED: properties [''mood'', ''age''] do not exist in graph schema' WHEN 1 THEN '(none) // REFUSED: malformed Cypher syntax' ELSE '(none)' END AS chosen, rejected FROM dpo_records""")
def rejection_pairs(spark, d):
    k = F.col("record_no") % 4
    stage = F.when(k == 0, "SCHEMA_AST_VIOLATION").when(k == 1, "SYNTAX_MALFORMED").otherwise("ONTOLOGY_PRUNING")
    return table(spark, d, "dpo_records").select("record_no", R.preference_target(stage, F.array(F.lit("mood"), F.lit("age"))).alias("chosen"), "rejected")


@query("CUR_23", "SELECT record_no, CASE WHEN record_no % 5 = 0 THEN 'start of it a b' || record_no || ' c d' ELSE 'plain text ' || record_no END AS text FROM dpo_records")
def runaway(spark, d):
    k = F.col("record_no").cast("string")
    unit = F.concat(F.lit("a b"), k, F.lit(" c d"))
    t = F.when(F.col("record_no") % 5 == 0, F.concat(F.lit("start of it "), F.array_join(F.array_repeat(unit, 5), " "))).otherwise(F.concat(F.lit("plain text "), k))
    return table(spark, d, "dpo_records").select("record_no", R.truncated_runaway(t).alias("text"))


@query("SCA_29", "SELECT s_suppkey, trim(s_name) || ' Holdings' AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Delaware' ELSE 'Unknown' END AS jurisdiction FROM supplier")
def subsidiary_list(spark, d):
    name = F.concat(F.trim("s_name"), F.lit(" Holdings"))
    t = F.concat(F.lit("EXHIBIT 21\nSubsidiaries of the registrant\nName\tJurisdiction\n"), name, F.when(F.col("s_suppkey") % 2 == 0, "\tDelaware").otherwise(" -"), F.lit("\nItem 9\n"))
    return R.subsidiary_lines(table(spark, d, "supplier").select("s_suppkey", t.alias("t")), "s_suppkey", "t")
