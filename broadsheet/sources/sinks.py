"""Writers of a run's tables: CSV and Parquet, manifest, visualisation payload, article exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = ("pages", "blocks", "inferred_page_columns", "block_ocr", "candidate_block_pairs", "pairwise_ocr_features", "pair_predictions", "block_clusters")


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, as CSV has no place for them."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_tables(tables: dict[str, DataFrame], folder: str, csv: bool = True) -> dict[str, str]:
    """Each table as Parquet and, on request, as CSV; the paths by name."""
    paths = {}
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table: {name}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        paths[name] = f"{folder}/{name}.parquet"
        if csv:
            flat(df).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
            paths[f"{name}_csv"] = f"{folder}/{name}.csv"
    return paths


def manifest(counts: DataFrame, config: dict, paths: dict[str, str]) -> DataFrame:
    """One row: when, with what, how many, where."""
    def table(values: dict):
        return F.create_map(*(F.lit(str(x)) for kv in values.items() for x in kv)) if values else F.lit(None).cast("map<string,string>")

    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return counts.select(now.alias("created_at"), table(config).alias("config"), F.struct(*counts.columns).alias("counts"), table(paths).alias("paths"))


def payload(tables: dict[str, DataFrame], key: str = "newspaper_id") -> DataFrame:
    """(document, payload): each document's rows of each table as one JSON object."""
    out = None
    for name, df in tables.items():
        own = df.groupBy(key).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = own if out is None else out.join(own, key, "full")
    return out.select(key, F.to_json(F.struct(*(c for c in out.columns if c != key))).alias("payload"))


def export_articles(articles: DataFrame, path: str, form: str = "json") -> None:
    """Articles as JSON lines, CSV with joined lists, or XML with attributes."""
    if form not in ("json", "csv", "xml"):
        raise ValueError("supported formats: json, csv, xml")
    out = articles.select("article_id", "confidence", "detection_ids", "page_ids")
    if form == "json":
        out.write.mode("overwrite").json(path)
    elif form == "csv":
        csv_rows(out).write.mode("overwrite").csv(path, header=True)
    else:
        xml_rows(out).write.mode("overwrite").format("xml").option("rootTag", "articles").option("rowTag", "article").save(path)


def csv_rows(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", "confidence", F.array_join("detection_ids", "|").alias("detection_ids"), F.array_join("page_ids", "|").alias("page_ids"))


def xml_rows(articles: DataFrame) -> DataFrame:
    def ids(column: str, tag: str):
        return F.struct(F.transform(column, lambda x: F.struct(x.alias("_id"))).alias(tag)).alias(column.replace("_ids", "s"))

    return articles.select(F.col("article_id").alias("_id"), F.col("confidence").alias("_confidence"), ids("detection_ids", "detection"), ids("page_ids", "page"))
