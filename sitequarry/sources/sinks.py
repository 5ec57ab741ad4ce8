"""Writers: exports of listings, and atomic replacement of a table's slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Columns of each export.
EXPORTS = {
    "pages": ("page_id", "url", "title", "status_code", "depth", "words", "section", "indexable"),
    "issues": ("rule_id", "category", "severity", "page_id", "url", "evidence"),
    "links": ("source", "target", "anchor", "type", "rel", "nofollow"),
    "images": ("url", "src", "alt", "width", "height", "format"),
    "redirects": ("url", "final_url", "hops", "kind"),
    "failures": ("url", "reason", "status_code", "attempts", "error"),
    "sitemap": ("loc", "lastmod", "source_sitemap"),
}


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)}
    return df.withColumns(nested) if nested else df


def csv_value(value: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line a row."""
    flat = _flat(df)
    return flat.select(F.concat_ws(",", *[csv_value(F.col(c)) for c in flat.columns]).alias("line"))


def export(df: DataFrame, path: str, form: str = "csv", dataset: str | None = None) -> None:
    """df (the columns of a dataset) as csv, json (one array a file is not written: a line a row) or ndjson."""
    if dataset is not None:
        df = df.select(*EXPORTS[dataset])
    if form == "csv":
        _flat(df).write.option("header", True).option("escape", '"').option("quote", '"').csv(path)
    elif form in ("json", "ndjson"):
        df.write.json(path)
    else:
        raise ValueError(f"unknown format: {form}")


def replace_slice(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Writes df over the partitions that it has rows of; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A table of a run (pages, failures, graph, raw HTML, ...) at a path, in place of what is there: Parquet, or JSON lines."""
    df.write.mode("overwrite").format(form).save(path)


def save_raw(pages: DataFrame, path: str, html: str = "html", files: int | None = None) -> None:
    """Raw HTML by page: (page_id, url, sha256, html), compressed; pages without HTML are left out. files: into so many, by page."""
    rows = pages.where(F.col(html).isNotNull()).select("page_id", "url", F.sha2(html, 256).alias("sha256"), F.col(html).alias("html"))
    rows = rows.repartition(files, "page_id") if files else rows
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
