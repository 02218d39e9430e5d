"""Files in: graph snapshots, edge manifests, JSON lines strict and lenient, daily logs, constituents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODES = "id string, label string, ticker string, source_hash string, properties_json string"
EDGES = "source_id string, target_id string, rel_type string, source_hash string, properties_json string"
MANIFEST = "source string, target string, rel_type string, nature string, input_group string, share double, exposure_pct double, buffer_days double, status string, valid_from string, valid_to string"
DYNAMICS = "guid string, sample_id string, epoch int, seq_prob double, is_correct boolean"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of a snapshot with tickers for ids (upper-case id without one).

    Edge columns win over the JSON bag for the ends, the column, then the bag, then
    ``SUPPLIES_TO`` gives the relation, and the bag wins for the hash.  Malformed bags count
    as empty.  Nodes may be missing; missing edges are an error.
    """
    if not exists(spark, f"{folder}/edges.parquet"):
        raise FileNotFoundError(f"{folder}/edges.parquet")
    e = spark.read.schema(EDGES).parquet(f"{folder}/edges.parquet")
    bag = lambda k: F.get_json_object("properties_json", f"$.{k}")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    x = e.select(
        F.coalesce(some(F.col("source_id")), bag("source")).alias("_s"), F.coalesce(some(F.col("target_id")), bag("target")).alias("_t"),
        F.coalesce(some(F.col("rel_type")), bag("rel_type"), F.lit("SUPPLIES_TO")).alias("rel_type"), F.coalesce(bag("source_hash"), F.col("source_hash")).alias("source_hash"),
        *[bag(k).alias(k) for k in ("nature", "status", "valid_from", "valid_to", "input_group")], *[bag(k).try_cast("double").alias(k) for k in ("share", "exposure_pct", "buffer_days", "confidence")],
    )
    names = spark.createDataFrame([], "id string, tick string")
    if exists(spark, f"{folder}/nodes.parquet"):
        n = spark.read.schema(NODES).parquet(f"{folder}/nodes.parquet")
        names = n.groupBy("id").agg(F.min(F.upper(some(F.col("ticker")))).alias("tick"))
    for end, out in (("_s", "source"), ("_t", "target")):
        x = x.join(names.withColumnRenamed("id", end), end, "left").withColumn(out, F.coalesce("tick", F.upper(end))).drop("tick", end)
    return x


def edge_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a ``.jsonl`` file, or of a ``.json`` file holding an array or ``{"edges": [...]}``."""
    if path.endswith(".jsonl"):
        return spark.read.schema(MANIFEST).json(path)
    if not path.endswith(".json"):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    x = spark.read.schema(f"{MANIFEST}, edges array<struct<{', '.join(c.replace(' ', ':') for c in MANIFEST.split(', '))}>>").option("multiLine", True).json(path)
    return x.where("edges is null").drop("edges").unionByName(x.where("edges is not null").select(F.inline("edges")))


def dynamics(spark: SparkSession, path: str) -> DataFrame:
    """Training dynamics, one JSON a line; a malformed line is an error.  Rows without guid (or sample_id) go."""
    x = spark.read.schema(DYNAMICS).option("mode", "FAILFAST").json(path)
    guid = F.coalesce("guid", "sample_id")
    return x.select(guid.alias("guid"), F.coalesce("epoch", F.lit(0)).alias("epoch"), F.coalesce("seq_prob", F.lit(0.0)).alias("seq_prob"), F.coalesce("is_correct", F.lit(False)).alias("is_correct")).where("guid is not null")


def daily_logs(spark: SparkSession, folder: str, schema: str, since: str | None = None) -> DataFrame:
    """Rows of a daily log of JSON lines, corrupt lines left out; what belongs to earlier days is not opened.

    A day is a folder ``dt=YYYYMMDD`` or a file ``<stem>_YYYYMMDD.jsonl``; files with other
    names are kept.  ``since``: a date, or a date and time, which then also filters the
    column ``timestamp``.
    """
    names = log_days(spark, folder, since)
    files = [f"{folder}/{n}" for n in names if n.endswith(".jsonl")]
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if files:
        x = reader.json(files)
    elif any(n.startswith("dt=") for n in names):
        x = reader.schema(f"{schema}, dt string").json(folder).where(F.col("dt") >= (since[:10].replace("-", "") if since else "")).drop("dt")
    else:
        return spark.createDataFrame([], schema)
    return x.where(F.col("timestamp") >= since) if since and "T" in since else x


def log_days(spark: SparkSession, folder: str, since: str | None = None) -> list[str]:
    """Names of the log's days from ``since`` on, in order; names that are no day are kept."""
    day_of = re.compile(r"(?:^dt=|_)(\d{8})(?:\.jsonl)?$")
    day = since[:10].replace("-", "") if since else ""
    names = sorted(s.getPath().getName() for s in _listed(spark, folder))
    return [n for n in names if not ((m := day_of.search(n)) and m[1] < day)]


def _listed(spark: SparkSession, folder: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(p)) if fs.exists(p) else []


def transcripts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Stream of transcripts, one JSON a line; malformed lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def filing_events(spark: SparkSession, root: str) -> DataFrame:
    """News records of all ``form8k_events.json`` below ``root``."""
    x = spark.read.schema("ticker string, filing_date string, items_present array<string>, accession_number string").json(f"{root}/*/form8k_events.json")
    tick, items = F.coalesce("ticker", F.lit("")), F.coalesce(F.array_join("items_present", ", "), F.lit(""))
    text = F.concat(F.lit("SEC Form 8-K Material Event filing for "), tick, F.lit(" disclosing items: "), items, F.lit(". Full corporate disclosure filed on "), F.coalesce("filing_date", F.lit("")), F.lit("."))
    url = F.concat(F.lit("https://www.sec.gov/edgar/data/"), tick, F.lit("/"), F.coalesce("accession_number", F.lit("")))
    return x.select(
        F.concat(F.lit("SEC Form 8-K Disclosure ("), tick, F.lit(") - "), items).alias("title"), F.repeat(text, 3).alias("text"),
        F.col("filing_date").alias("date"), tick.alias("ticker"), F.lit("SEC_EDGAR_8K").alias("provider"), url.alias("url"),
    )


def html_constituents(pages: DataFrame, html: str = "value") -> DataFrame:
    """Members from the table with id ``constituents`` of pages: rows of seven cells or more, without the header."""
    body = F.regexp_extract(html, r"(?is)<table\b[^>]*\bid=[\"']constituents[\"'][^>]*>(.*?)</table>", 1)
    rows = pages.select(F.explode(F.slice(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1), 2, 2**31 - 1)).alias("r"))

    def plain(c: Column) -> Column:
        c = F.regexp_replace(c, r"<[^>]+>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(sign))
        return F.trim(c)

    cells = rows.select(F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), plain).alias("c"))
    x = cells.select(*[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(("ticker", "company_name", "gics_sector", "gics_sub_industry", "headquarters_location", "added", "cik"))])
    day = F.regexp_extract("added", r"(\d{4}-\d{2}-\d{2})", 1)
    return x.where("cik is not null").select(
        F.trim(F.replace("ticker", F.lit("."), F.lit("-"))).alias("ticker"), F.when(F.length("cik") < 10, F.lpad("cik", 10, "0")).otherwise(F.col("cik")).alias("cik"), "company_name", "gics_sector", "gics_sub_industry",
        "headquarters_location", F.when(day != "", day).when(F.length("added") == 10, F.col("added")).otherwise("1957-03-04").alias("date_added"),
    )


def cached(spark: SparkSession, path: str, schema: str, seed: DataFrame) -> DataFrame:
    """Rows of a JSON cache; where there is none, ``seed`` is written there first."""
    if not exists(spark, path):
        seed.write.mode("overwrite").json(path)
    return spark.read.schema(schema).json(path)


def in_window(rows: DataFrame, at: str, start: float | None, end: float | None) -> DataFrame:
    """Rows whose epoch seconds lie within the bounds, both inclusive; without bounds all rows.  A missing time counts as 0."""
    t = F.coalesce(F.col(at), F.lit(0))
    return rows if start is None and end is None else rows.where((t >= (start or 0)) & (t <= (end if end is not None else float("inf"))))


def prices(rows: DataFrame) -> DataFrame:
    """Daily bars: upper-case tickers with dashes for periods, prices to four digits."""
    tick = F.replace(F.upper(F.trim("ticker")), F.lit("."), F.lit("-"))
    return rows.select(tick.alias("ticker"), F.substring(F.col("date").cast("string"), 1, 10).alias("date"), *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("double").alias("volume"))


#: Characters kept of a filing's text by form.
FORM_LENGTH = {"8-K": 10_000, "10-Q": 15_000}


def filings(rows: DataFrame, year: int | None = None) -> DataFrame:
    """Filings of a year (by the start of the filing date), their text cut to the length of their form."""
    if year is not None:
        rows = rows.where(F.substring("filing_date", 1, 4) == str(year))
    text = F.col("text")
    for form, n in FORM_LENGTH.items():
        text = F.when(F.col("form_type") == form, F.substring("text", 1, n)).otherwise(text)
    return rows.withColumn("text", text)


def primary_label(labels: Column) -> Column:
    """First label that is not ``Entity``; ``Entity`` where there is no other."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x != "Entity"), F.lit(0)), F.lit("Entity"))


def workspace(spark: SparkSession, root: str, allowed: tuple[str, ...]) -> DataFrame:
    """``(name, kind, rows)`` of the snapshots (folders with nodes and edges) and cohorts (JSON lines) under ``root``.

    Entries that cannot be read are left out; a root outside ``allowed`` is an error.
    """
    if not any(root == a or root.startswith(a.rstrip("/") + "/") for a in allowed):
        raise PermissionError(f"not in the workspace: {root}")
    found = []
    for s in _listed(spark, root):
        path, name = str(s.getPath()), s.getPath().getName()
        try:
            if exists(spark, f"{path}/nodes.parquet"):
                found.append((name, "snapshot", spark.read.parquet(f"{path}/nodes.parquet").count()))
            elif name.endswith(".jsonl"):
                found.append((name, "cohort", spark.read.text(path).count()))
        except Exception:  # noqa: BLE001  an entry that cannot be read is no entry
            continue
    return spark.createDataFrame(found, "name string, kind string, rows long")


def snapshot_registry(spark: SparkSession, table_path: str | None, root: str) -> DataFrame:
    """Registered snapshots, newest first; where none is registered those found under ``root``."""
    if table_path and exists(spark, table_path):
        x = spark.read.parquet(table_path)
        if not x.isEmpty():
            return x.orderBy(F.desc("created_at"))
    found = []
    for s in _listed(spark, root):
        path, name = str(s.getPath()), s.getPath().getName()
        if exists(spark, f"{path}/nodes.parquet"):
            edges = spark.read.parquet(f"{path}/edges.parquet").count() if exists(spark, f"{path}/edges.parquet") else 0
            found.append((name, "raw" if "raw" in name.lower() else "custom", spark.read.parquet(f"{path}/nodes.parquet").count(), edges))
    return spark.createDataFrame(found, "snapshot_id string, tag string, node_count long, edge_count long").orderBy("snapshot_id")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text, Markdown and JSON files below a folder, with their paths in order."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,json,jsonl}").load(folder)
    return x.select("path", F.col("content").cast("string").alias("text")).orderBy("path")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a JSON map from ordinal to ``{cik_str, ticker, title}``, padded and normalised."""
    from quarry.functions.text import company_key, padded_cik

    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<cik_str: long, ticker: string, title: string>>").alias("m"))
    v = m.select(F.explode(F.map_values("m")).alias("v")).select("v.*")
    return v.select(padded_cik(F.col("cik_str").cast("string")).alias("cik"), F.upper("ticker").alias("ticker"), F.col("title").alias("company_name"), company_key(F.col("title")).alias("normalized_name"))
