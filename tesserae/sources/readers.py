"""Readers: keyed documents, gold CSV, JSON, YAML dimensions, the pipe-delimited filing index, transcripts, and a
connector for sources that list and fetch."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship
from ..functions.text import collapse, escape_html, speaker_role


def gold_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; a byte-order mark before the first name does no harm, as the schema names columns."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def yaml_dimension(spark: SparkSession, text: str) -> DataFrame:
    """metric_id, kind and pattern from a mapping of metrics to lists of patterns by kind. The file is a configuration."""
    import yaml

    rows = [(m, kind, p) for m, kinds in (yaml.safe_load(text) or {}).items() for kind, patterns in kinds.items() for p in patterns or []]
    return spark.createDataFrame(rows, "metric_id string, kind string, pattern string")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path and decoded html of each file."""
    from .html import decode

    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(lambda frames: (f.assign(html=f["content"].map(decode))[["path", "html"]] for f in frames), "path string, html string")


def filing_index(lines: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """Rows of an index whose lines are cik|company|form|date|file; other lines are no rows."""
    part = F.split("value", r"\|")
    rows = lines.where(F.size(part) == 5).select(
        F.lpad(F.trim(part[0]), 10, "0").alias("cik"), F.trim(part[1]).alias("company_name"), F.trim(part[2]).alias("form_type"),
        F.try_to_date(F.trim(part[3]), "yyyy-MM-dd").alias("filing_date"), F.trim(part[4]).alias("file_name"),
    ).where(F.col("filing_date").isNotNull() & F.col("cik").rlike("^[0-9]{10}$"))
    return rows.where(F.col("form_type").isin(forms)) if forms else rows


def transcript_turns(turns: DataFrame, speaker: str, text: str) -> DataFrame:
    """role and semantic html of each speaker's turn."""
    name, body = F.col(speaker), F.col(text)
    html = F.concat(F.lit('<section data-role="'), speaker_role(name), F.lit('"><h3>'), escape_html(name), F.lit("</h3><p>"), escape_html(collapse(body)), F.lit("</p></section>"))
    return turns.withColumns({"role": speaker_role(name), "html": html})


def valid_content(docs: DataFrame, html: str, company: str | None = None, least: int = 500) -> DataFrame:
    """``docs`` with reject_reason: too short, an error page, or another company's; null for good ones."""
    t = F.lower(html)
    reason = F.when(F.coalesce(F.length(html), F.lit(0)) < least, "too_small").when(t.rlike("access denied|404 not found|request rate threshold exceeded"), "error_page")
    if company:
        reason = reason.when(~F.contains(t, F.lower(F.col(company))), "wrong_company")
    return docs.withColumn("reject_reason", reason)


def slide_title(text: str) -> bool:
    """Whether a line looks like a slide's title: short, capitalised, without a full stop."""
    words = (text or "").split()
    return 0 < len(words) <= 12 and not text.rstrip().endswith(".") and sum(w[:1].isupper() or w[:1].isdigit() for w in words) * 2 >= len(words)


class DocumentSource(Protocol):
    """What a connector offers: keys in stable order, and the document of a key."""

    def list_available(self) -> list[str]: ...

    def fetch(self, key: str) -> str: ...


class _Partition(InputPartition):
    def __init__(self, keys):
        super().__init__(keys)
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, source, slices):
        self.source, self.slices = source, slices

    def partitions(self):
        keys = self.source.list_available()
        n = max(1, min(self.slices, len(keys)))
        return [_Partition(keys[k::n]) for k in range(n)]

    def read(self, partition):
        for key in partition.keys:
            yield key, self.source.fetch(key)


def connector(name: str, source: DocumentSource, slices: int = 64) -> type[DataSource]:
    """A Spark data source of key and text; register it with spark.dataSource.register."""

    class Connector(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "key string, text string"

        def reader(self, schema):
            return _Reader(source, int(self.options.get("slices", slices)))

    return Connector


def cached_responses(requests: DataFrame, cache: DataFrame, keys: list[str], version: str, as_of: str, days: int = 30) -> DataFrame:
    """``requests`` with cache_key and, where the cache (cache_key, response, created_at) has a fresh one, response."""
    key = F.sha2(F.concat_ws("|", F.lit(version), *keys), 256)
    fresh = cache.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    return requests.withColumn("cache_key", key).join(fresh.select("cache_key", "response"), "cache_key", "left")
