"""Reading catalogs, stored pages and vendor answers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonempty

CATALOG_COLUMNS = {"ISBN": "isbn", "SS_code": "ss_code"}


def tag_catalog(df: DataFrame, source: str) -> DataFrame:
    """Common column names plus the ``source`` tag."""
    return df.withColumnsRenamed({k: v for k, v in CATALOG_COLUMNS.items() if k in df.columns}).withColumn(
        "source", F.lit(source)
    )


def read_catalog(spark: SparkSession, paths: dict[str, str], format: str = "parquet", **options) -> DataFrame:
    """All readable catalogs, tagged and concatenated in the given order; unreadable ones are skipped."""
    parts = []
    for source, path in paths.items():
        try:
            parts.append(tag_catalog(spark.read.format(format).options(**options).load(path), source))
        except AnalysisException:  # path missing or without a schema
            continue
    if not parts:
        raise ValueError("no readable catalog")
    return union_catalogs(*parts)


def union_catalogs(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages as (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


VENDOR_ITEM = (
    "array<struct<id:string,title:string,author:string,isbn:string,publisher:string,year:string,"
    "language:string,extension:string,format:string,filesize:string,size:string,md5:string,"
    "hash:string,book_hash:string>>"
)


def vendor_items(c: Column) -> Column:
    """The result list of a vendor answer (JSON) as an array of item structs."""

    def held(name: str) -> Column:
        raw = F.get_json_object(c, f"$.{name}")
        return F.when(~raw.isin("", "[]", "{}", "null", "0", "false"), raw)

    raw = F.coalesce(held("books"), held("results"), held("data"))
    nested = F.coalesce(F.get_json_object(raw, "$.books"), F.get_json_object(raw, "$.results"))
    return F.from_json(F.when(raw.startswith("{"), nested).otherwise(raw), VENDOR_ITEM)


def parse_vendor_results(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """One row per titled item of each vendor answer, with ``rank`` its position in the answer."""
    items = df.select(*keep, F.posexplode(vendor_items(F.col(json_col))).alias("rank", "item"))
    i = F.col("item")
    return items.filter(nonempty(i["title"]).isNotNull()).select(
        *keep,
        F.col("rank").cast("bigint").alias("rank"),
        i["id"].alias("book_id"),
        F.coalesce(nonempty(i["hash"]), nonempty(i["book_hash"])).alias("hash"),
        *[i[n].alias(n) for n in ("title", "author", "isbn", "publisher", "year", "language")],
        F.lower(F.coalesce(i["extension"], i["format"], F.lit(""))).alias("format"),
        F.coalesce(i["filesize"], i["size"]).alias("size"),
        i["md5"].alias("md5"),
    )
