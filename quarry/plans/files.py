"""Sources and sinks as round trips: tables go out to the shared folder and come back in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import scratch, table
from quarry.plans.registry import query
from quarry.sources import files as S, sinks as K
from quarry.sources.tasks import embedded, ingest_task, run_tasks
from quarry.streaming import events as E

_TICK = "(SELECT source_name AS id, min(upper(nullif(trim(source_ticker), ''))) AS tick FROM annotated_triples GROUP BY 1)"


def triples(spark, d):
    return table(spark, d, "annotated_triples")


def graph_tables(spark, d):
    """Nodes and edges as a snapshot holds them; some values stand in the bag of properties alone."""
    t = triples(spark, d)
    nodes = t.groupBy(F.col("source_name").alias("id")).agg(F.min("source_type").alias("label"), F.min(F.nullif(F.trim("source_ticker"), F.lit(""))).alias("ticker"))
    nodes = nodes.select("id", "label", "ticker", F.lit(None).cast("string").alias("source_hash"), F.lit("{}").alias("properties_json"))
    k = F.col("triple_id")
    bag = F.to_json(F.struct(F.when(k % 4 == 0, F.col("source_name")).alias("source"), F.when(k % 5 == 0, F.col("rel_type")).alias("rel_type"), F.when(k % 3 == 0, F.concat(F.lit("bag"), k)).alias("source_hash"), F.col("confidence")))
    edges = t.select(
        F.when(k % 4 != 0, F.col("source_name")).alias("source_id"), F.col("target_name").alias("target_id"), F.when((k % 5 != 0) & (k % 10 != 1), F.col("rel_type")).alias("rel_type"),
        F.concat(F.lit("col"), k).alias("source_hash"), F.when(k % 7 == 0, F.lit("{broken")).otherwise(bag).alias("properties_json"),
    )
    return nodes, edges


@query("SRC_01", f"""WITH e AS (SELECT triple_id AS k, CASE WHEN triple_id % 4 <> 0 THEN source_name WHEN triple_id % 7 <> 0 THEN source_name END AS s, target_name AS t,
CASE WHEN triple_id % 5 <> 0 AND triple_id % 10 <> 1 THEN rel_type WHEN triple_id % 5 = 0 AND triple_id % 7 <> 0 THEN rel_type ELSE 'SUPPLIES_TO' END AS rel_type,
CASE WHEN triple_id % 3 = 0 AND triple_id % 7 <> 0 THEN 'bag' ELSE 'col' END || triple_id AS source_hash FROM annotated_triples)
SELECT coalesce(a.tick, upper(e.s)) AS source, coalesce(b.tick, upper(e.t)) AS target, rel_type, source_hash FROM e LEFT JOIN {_TICK} a ON a.id = e.s LEFT JOIN {_TICK} b ON b.id = e.t""")
def snapshot_scan(spark, d):
    folder = scratch(spark, "snapshot")
    K.write_snapshot(*graph_tables(spark, d), folder)
    return S.snapshot(spark, folder).select("source", "target", "rel_type", "source_hash")


@query("SRC_02", "SELECT kind, source_name AS source, target_name AS target, rel_type, confidence AS share FROM annotated_triples, (SELECT unnest(['jsonl', 'array', 'object']) AS kind)")
def manifests(spark, d):
    """The same edges as JSON lines, as one array and as an object with edges."""
    root = scratch(spark, "manifest")
    e = triples(spark, d).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type", F.col("confidence").alias("share"))
    e.write.json(f"{root}/a.jsonl")
    body = e.select(F.to_json(F.struct(*e.columns)).alias("j")).repartition(4).mapInPandas(lambda it: (x.assign(j="[" + ",".join(x.j) + "]")[:1] for x in it if len(x)), "j string")
    body.write.option("wholetext", True).text(f"{root}/b.json")
    body.select(F.concat(F.lit('{"edges": '), "j", F.lit("}"))).write.text(f"{root}/c.json")
    out = None
    for kind, path in (("jsonl", "a.jsonl"), ("array", "b.json"), ("object", "c.json")):
        x = S.edge_manifest(spark, f"{root}/{path}").select(F.lit(kind).alias("kind"), "source", "target", "rel_type", "share")
        out = x if out is None else out.unionByName(x)
    return out


@query("SRC_03", "SELECT 'g' || event_id AS guid, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id % 10 END, 0)::INT AS epoch, coalesce(CASE WHEN event_id % 4 <> 0 THEN value END, 0.0) AS seq_prob, coalesce(CASE WHEN event_id % 5 <> 0 THEN value > 50 END, false) AS is_correct FROM events WHERE event_id % 7 <> 0")
def dynamics(spark, d):
    k, path = F.col("event_id"), scratch(spark, "dynamics")
    guid = F.concat(F.lit("g"), k)
    table(spark, d, "events").select(
        F.when((k % 2 == 0) & (k % 7 != 0), guid).alias("guid"), F.when((k % 2 == 1) & (k % 7 != 0), guid).alias("sample_id"), F.when(k % 3 != 0, (k % 10).cast("int")).alias("epoch"),
        F.when(k % 4 != 0, F.col("value")).alias("seq_prob"), F.when(k % 5 != 0, F.col("value") > 50).alias("is_correct"),
    ).write.json(path)
    return S.dynamics(spark, path)


def _log(spark, d):
    """The events as a daily log, every fiftieth line corrupt."""
    path = scratch(spark, "log")
    e = table(spark, d, "events").withColumn("timestamp", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    body = F.to_json(F.struct("event_id", "event_type", "timestamp"))
    e.select(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(body).alias("value"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("dt")).write.partitionBy("dt").text(path)
    return path


@query("SRC_04", "SELECT event_id, event_type FROM events WHERE event_id % 50 <> 0 AND strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10T12:30:00'")
def rejection_log(spark, d):
    return S.daily_logs(spark, _log(spark, d), "event_id long, event_type string, timestamp string", "2024-01-10T12:30:00").select("event_id", "event_type")


@query("SRC_05", "SELECT DISTINCT 'dt=' || strftime(ts, '%Y%m%d') AS name FROM events WHERE strftime(ts, '%Y%m%d') >= '20240110'")
def log_listing(spark, d):
    return spark.createDataFrame([(n,) for n in S.log_days(spark, _log(spark, d), "2024-01-10") if n.startswith("dt=")], "name string")


@query("SRC_06", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 9 <> 0")
def transcript_stream(spark, d):
    path = scratch(spark, "transcripts")
    x = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    x.select(F.when(F.col("doc_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct("doc_id", "n"))).alias("value")).write.text(path)
    return E.run_available(S.transcripts(spark, path, "doc_id long, n long"))


@query("SRC_07", "SELECT doc_type, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def discovered(spark, d):
    path = scratch(spark, "docs")
    table(spark, d, "documents").select("text", "doc_type").write.partitionBy("doc_type").json(path)
    lines = S.documents(spark, path).select(F.regexp_extract("path", "doc_type=([^/]+)/", 1).alias("doc_type"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("doc_type").agg(F.count("*").alias("docs"), F.sum(F.length(F.get_json_object("line", "$.text"))).cast("long").alias("chars"))


@query("SRC_08", """SELECT 'SEC Form 8-K Disclosure (' || coalesce(metadata.ticker, '') || ') - ' || array_to_string(string_split(section_name, ' '), ', ') AS title, metadata.filing_date AS date,
'https://www.sec.gov/edgar/data/' || coalesce(metadata.ticker, '') || '/' || chunk_id AS url, length(repeat('SEC Form 8-K Material Event filing for ' || coalesce(metadata.ticker, '') || ' disclosing items: ' || coalesce(array_to_string(string_split(section_name, ' '), ', '), '') || '. Full corporate disclosure filed on ' || coalesce(metadata.filing_date, '') || '.', 3)) AS n FROM filing_chunks WHERE section_name IS NOT NULL""")
def filing_events(spark, d):
    root = scratch(spark, "events")
    x = table(spark, d, "filing_chunks").where("section_name is not null").select(F.col("metadata.ticker").alias("ticker"), F.col("metadata.filing_date").alias("filing_date"), F.split("section_name", " ").alias("items_present"), F.col("chunk_id").alias("accession_number"))
    for part, rest in (("a", 0), ("b", 1)):
        x.where(F.pmod(F.xxhash64("accession_number"), F.lit(2)) == rest).write.json(f"{root}/{part}/form8k_events.json")
    return S.filing_events(spark, root).select("title", "date", "url", F.length("text").cast("long").alias("n"))


@query("SRC_09", """SELECT replace(ticker, '.', '-') AS ticker, CASE WHEN length(trim(cik)) < 10 THEN lpad(trim(cik), 10, '0') ELSE trim(cik) END AS cik, trim(company_name) AS company_name, coalesce(nullif(regexp_extract(date_added, '(\\d{4}-\\d{2}-\\d{2})', 1), ''), CASE WHEN length(trim(date_added)) = 10 THEN trim(date_added) END, '1957-03-04') AS date_added FROM sp500_constituents""")
def html_table(spark, d):
    path = scratch(spark, "page")
    cols = ("ticker", "company_name", "gics_sector", "gics_sub_industry", "headquarters_location", "date_added", "cik")
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), safe(c), F.lit(" </td>")) for c in cols], F.lit("</tr>"))
    body = table(spark, d, "sp500_constituents").select(row.alias("r")).agg(F.array_join(F.collect_list("r"), "").alias("r"))  # the table of members is fixed, some 600 rows
    body.select(F.concat(F.lit("<html><table><tr><td>x</td></tr></table><table class='w' id=\"constituents\"><tr><th>Symbol</th></tr>"), "r", F.lit("</table></html>"))).write.text(path)
    return S.html_constituents(spark.read.text(path, wholetext=True)).select("ticker", "cik", "company_name", "date_added")


@query("SRC_10", "SELECT ticker, company_name, is_current FROM sp500_constituents")
def universe_cache(spark, d):
    path, schema = scratch(spark, "universe"), "ticker string, company_name string, is_current boolean"
    seed = table(spark, d, "sp500_constituents").select("ticker", "company_name", "is_current")
    S.cached(spark, path, schema, seed)
    return S.cached(spark, path, schema, seed.limit(0))


@query("SRC_14", "SELECT id, provider FROM financial_news_queue WHERE epoch(fetched_at) BETWEEN 1672531200 AND 1688169600")
def news_window(spark, d):
    n = table(spark, d, "financial_news_queue").withColumn("at", F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1e6)
    return S.in_window(n, "at", 1672531200, 1688169600).select("id", "provider")


@query("SRC_15", "SELECT upper(replace(c_name, '#', '-')) AS ticker, '1995-01-01' AS date, round(c_acctbal / 3, 4) AS close FROM customer")
def price_source(spark, d):
    x = table(spark, d, "customer").select(F.replace("c_name", F.lit("#"), F.lit(".")).alias("ticker"), F.lit("1995-01-01 00:00:00").alias("date"), *[(F.col("c_acctbal") / 3).alias(c) for c in ("open", "high", "low", "close")], F.lit(0).alias("volume"))
    return S.prices(x).select("ticker", "date", "close")


@query("SRC_16", "SELECT chunk_id, length(CASE metadata.form_type WHEN '8-K' THEN substr(text, 1, 10000) WHEN '10-Q' THEN substr(text, 1, 15000) ELSE text END) AS n FROM filing_chunks WHERE substr(metadata.filing_date, 1, 4) = '2023'")
def filing_source(spark, d):
    x = table(spark, d, "filing_chunks").select("chunk_id", "text", F.col("metadata.form_type").alias("form_type"), F.col("metadata.filing_date").alias("filing_date"))
    return S.filings(x, 2023).select("chunk_id", F.length("text").cast("long").alias("n"))


@query("SRC_17", "SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS cik, upper('t' || s_suppkey) AS ticker, s_name AS company_name, s_suppkey % 3 = 0 AS known FROM supplier")
def registry(spark, d):
    path = scratch(spark, "registry")
    x = table(spark, d, "supplier").select(F.concat(F.lit('"'), "s_suppkey", F.lit('": '), F.to_json(F.struct(F.col("s_suppkey").cast("long").alias("cik_str"), F.concat(F.lit("t"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title")))).alias("e"))
    x.repartition(4).mapInPandas(lambda it: (p.assign(e="{" + ",".join(p.e) + "}")[:1] for p in it if len(p)), "e string").write.text(path)
    known = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.lit(True).alias("known"))
    return S.registry(spark, path).join(known, "cik", "left").select("cik", "ticker", "company_name", F.coalesce("known", F.lit(False)).alias("known"))


@query("SRC_18", "SELECT name, min(label) AS label FROM (SELECT source_name AS name, source_type AS label FROM annotated_triples UNION ALL SELECT target_name, target_type FROM annotated_triples) GROUP BY 1")
def live_nodes(spark, d):
    t = triples(spark, d)
    ends = t.select(F.col("source_name").alias("name"), F.col("source_type").alias("label")).unionByName(t.select(F.col("target_name").alias("name"), F.col("target_type").alias("label")))
    x = ends.groupBy("name").agg(F.min("label").alias("label")).withColumn("labels", F.array(F.lit("Entity"), "label"))
    return x.select("name", S.primary_label(F.col("labels")).alias("label"))


@query("SRC_19", "SELECT 'one' AS name, 'snapshot' AS kind, (SELECT count(DISTINCT source_name) FROM annotated_triples) AS rows UNION ALL SELECT 'cohort.jsonl', 'cohort', (SELECT count(*) FROM sft_records)")
def catalog(spark, d):
    root = scratch(spark, "workspace")
    K.write_snapshot(*graph_tables(spark, d), f"{root}/one")
    table(spark, d, "sft_records").select("record_no").write.json(f"{root}/cohort.jsonl")
    table(spark, d, "region").select("r_name").write.text(f"{root}/other.txt")
    return S.workspace(spark, root, (root,))


@query("SRC_20", "SELECT sample_id, split FROM sft_records")
def cohort(spark, d):
    path = scratch(spark, "cohort")
    table(spark, d, "sft_records").select("sample_id", "split").write.json(path)
    return spark.read.schema("sample_id string, split string").option("mode", "FAILFAST").json(path)


@query("SRC_21", "SELECT 'raw_one' AS snapshot_id, 'raw' AS tag, (SELECT count(DISTINCT source_name) FROM annotated_triples) AS node_count, (SELECT count(*) FROM annotated_triples) AS edge_count")
def registry_fallback(spark, d):
    root = scratch(spark, "snapshots")
    K.write_snapshot(*graph_tables(spark, d), f"{root}/raw_one")
    return S.snapshot_registry(spark, None, root)


@query("SNK_01", "SELECT source_name AS id, min(source_type) AS label FROM annotated_triples GROUP BY 1")
def snapshot_write(spark, d):
    folder = scratch(spark, "snapshot")
    for _ in range(2):
        K.write_snapshot(*graph_tables(spark, d), folder)
    return spark.read.parquet(f"{folder}/nodes.parquet").select("id", "label")


@query("SNK_02", "SELECT id, source_hash, len(ticker_symbols)::INT AS tickers FROM financial_news_queue")
def staging(spark, d):
    path = scratch(spark, "staging")
    table(spark, d, "financial_news_queue").select("id", "source_hash", "ticker_symbols").write.option("compression", "snappy").parquet(path)
    return spark.read.parquet(path).select("id", "source_hash", F.when(F.col("ticker_symbols").isNotNull(), F.size("ticker_symbols")).alias("tickers"))


@query("SNK_03", "SELECT source_hash, min(id) AS id FROM financial_news_queue GROUP BY 1")
def insert_or_ignore(spark, d):
    path = scratch(spark, "queue")
    n = table(spark, d, "financial_news_queue").select("source_hash", "id")
    for part in (n, n):
        K.insert_or_ignore(part, path, "source_hash", ["id"])
    return spark.read.parquet(path)


@query("SNK_04", "SELECT source_hash, max_by(status, id) AS status, max(id) AS id FROM financial_news_queue GROUP BY 1")
def upsert(spark, d):
    n = table(spark, d, "financial_news_queue").select("source_hash", "status", "id")
    return K.upserted(n.where("id % 2 = 0"), n.where("id % 2 = 1"), "source_hash", "id")


@query("SNK_05", """WITH a AS (SELECT source_name AS id, min(source_type) AS kind FROM annotated_triples GROUP BY 1), b AS (SELECT target_name AS id, min(target_type) AS kind, count(*)::VARCHAR AS seen FROM annotated_triples GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.kind, a.kind) AS kind, b.seen FROM a FULL JOIN b ON a.id = b.id""")
def merged_nodes(spark, d):
    t = triples(spark, d)
    old = t.groupBy(F.col("source_name").alias("id")).agg(F.create_map(F.lit("kind"), F.min("source_type")).alias("props"))
    new = t.groupBy(F.col("target_name").alias("id")).agg(F.create_map(F.lit("kind"), F.min("target_type"), F.lit("seen"), F.count("*").cast("string")).alias("props"))
    return K.overlaid(old, new, "id", "props").select("id", F.col("props")["kind"].alias("kind"), F.col("props")["seen"].alias("seen"))


@query("SNK_06", "SELECT min_type AS label, count(*) AS n FROM (SELECT source_name, min(source_type) AS min_type FROM annotated_triples GROUP BY 1) GROUP BY 1")
def restored(spark, d):
    folder = scratch(spark, "snapshot")
    K.write_snapshot(*graph_tables(spark, d), folder)
    return K.restore_snapshot(spark, folder, scratch(spark, "graph"))[0].groupBy("label").agg(F.count("*").alias("n"))


@query("SNK_07", "SELECT split, count(*) AS n FROM sft_records GROUP BY 1")
def jsonl_export(spark, d):
    path = scratch(spark, "export")
    table(spark, d, "sft_records").select("split", "prompt", "target_completion").write.partitionBy("split").json(path)
    return spark.read.schema("prompt string, target_completion string, split string").json(path).groupBy("split").agg(F.count("*").alias("n"))


@query("SNK_08", "SELECT strftime(ts, '%Y%m%d') AS dt, count(*) AS n FROM events GROUP BY 1")
def daily_append(spark, d):
    path = scratch(spark, "daily")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        K.append_daily(e.where(part), path, "at")
    return spark.read.schema("event_id long, dt string").json(path).groupBy("dt").agg(F.count("*").alias("n"))


@query("SNK_09", "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS since FROM events")
def cursor(spark, d):
    path = scratch(spark, "cursor")
    last = table(spark, d, "events").agg(F.date_format(F.max(F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    for value in ("2000-01-01", last):
        K.save_cursor(spark, path, value)
    return spark.createDataFrame([(K.load_cursor(spark, path),)], "since string")


@query("SNK_10", "SELECT event_id::VARCHAR AS key, event_type FROM events")
def published(spark, d):
    folder = scratch(spark, "topics")
    K.publish(table(spark, d, "events").select("event_id", "event_type"), "event_id", "events", folder=folder)
    return spark.read.schema("key string, value string").json(f"{folder}/events").select("key", F.get_json_object("value", "$.event_type").alias("event_type"))


@query("SNK_12", "SELECT node, degree FROM (SELECT node, count(*) AS degree FROM (SELECT source_name AS node FROM annotated_triples UNION ALL SELECT target_name FROM annotated_triples) GROUP BY 1) WHERE degree >= 25")
def quarantine_queue(spark, d):
    from quarry.operators.graph import quarantine

    path = scratch(spark, "quarantine")
    e = triples(spark, d).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"))
    quarantine(e)[1].write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SNK_13", """WITH x AS (SELECT gics_sector AS sector, count(*)::VARCHAR AS n FROM sp500_constituents GROUP BY 1) SELECT 1 AS line_no, '| sector           | n      |' AS line UNION ALL SELECT 2, '|------------------|--------|'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY sector), '| ' || rpad(substr(sector, 1, 16), 16, ' ') || ' | ' || rpad(substr(n, 1, 6), 6, ' ') || ' |' FROM x""")
def text_table(spark, d):
    x = table(spark, d, "sp500_constituents").groupBy(F.col("gics_sector").alias("sector")).agg(F.count("*").alias("n"))
    return K.rendered(x, {"sector": 16, "n": 6}, ["sector"]).select(F.col("line_no").cast("long").alias("line_no"), "line")


@query("SNK_14", "SELECT doc_id, vec_id IS NOT NULL AS has_vector FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id")
def embedding_attach(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(None).cast("array<float>").alias("v"))
    vec = table(spark, d, "embeddings")
    column = next(f.name for f in vec.schema if f.dataType.simpleString().startswith("array"))
    x = K.attached(docs, vec.select(F.col("vec_id").cast("long").alias("doc_id"), F.col(column).cast("array<float>").alias("v")), "doc_id", "v")
    return x.select("doc_id", F.col("v").isNotNull().alias("has_vector"))


@ingest_task("news")
def _news_task(spark, d):
    return table(spark, d, "financial_news_queue").count()


@ingest_task("filings")
def _filings_task(spark, d):
    return table(spark, d, "filing_chunks").count()


@query("UDF_01", "SELECT 'news' AS task, count(*) AS rows, NULL::VARCHAR AS error FROM financial_news_queue UNION ALL SELECT 'filings', count(*), NULL FROM filing_chunks")
def task_registry(spark, d):
    return spark.createDataFrame(run_tasks(spark, d), "task string, rows long, error string")


@query("UDF_02", "SELECT record_no, upper(substr(prompt, 1, 20)) AS answer FROM sft_records")
def injected_transport(spark, d):
    """Any callable from a batch of prompts to answers may stand for the model."""
    from quarry.sources.tasks import answered

    def transport(prompts):
        return [p[:20].upper() for p in prompts]

    return answered(table(spark, d, "sft_records").select("record_no", "prompt"), "prompt", "answer", transport).select("record_no", "answer")


@query("UDF_03", "SELECT rel_type, count(*) AS n FROM annotated_triples GROUP BY 1")
def injected_driver(spark, d):
    """Any callable from a statement to a DataFrame may stand for the graph database."""
    views = {"edges": triples(spark, d)}
    driver = lambda statement: spark.sql(statement, **views)
    return driver("SELECT rel_type, count(*) AS n FROM {edges} GROUP BY 1")


@query("UDF_04", "SELECT doc_id, 768 AS dims, CASE WHEN text = '' THEN 0.0 ELSE 1.0 END AS norm FROM documents")
def embedding_function(spark, d):
    x = embedded(table(spark, d, "documents").select("doc_id", "text"), "text", "v")
    return x.select("doc_id", F.size("v").alias("dims"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)), 4).alias("norm"))


@query("UDF_06", "SELECT cik, ticker FROM (SELECT s_suppkey AS k, lpad(s_suppkey::VARCHAR, 10, '0') AS cik, CASE WHEN s_suppkey % 4 = 0 THEN 'X' || s_suppkey ELSE 'T' || s_suppkey END AS ticker FROM supplier)")
def explicit_registry(spark, d):
    """An explicit registry wins over the stored one, key by key."""
    s = table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.col("s_suppkey").alias("k"))
    stored = s.select("cik", F.concat(F.lit("T"), "k").alias("ticker"))
    explicit = s.where("k % 4 = 0").select("cik", F.concat(F.lit("X"), "k").alias("_t"))
    return stored.join(explicit, "cik", "left").select("cik", F.coalesce("_t", "ticker").alias("ticker"))
