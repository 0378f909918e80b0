"""The entry points of a service over tables: extraction, jobs, history, audit, metrics, exports. All return DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html_ops
from .functions.html_dom import parse
from .operators import extract as _extract
from .operators import history as _history
from .operators import jobs as _jobs
from .operators import profile as _profile
from .operators import tables
from .plans import pipeline
from .sources import sinks


def extract(pages: DataFrame, options: Iterable[str], css: str = "", xpath: str = "") -> DataFrame:
    """The fields ``options`` of pages(url, html), and the matches of a selector and an expression."""
    return _extract.extract(pages, options, css, xpath)


def run_pipeline(pages: DataFrame, strategies: tuple[str, ...] = pipeline.STRATEGIES) -> DataFrame:
    """Merged and annotated documents of pages(url, html)."""
    return pipeline.run_pipeline(pages, strategies)


def register_strategy(name: str, record: Callable[[], dict[str, Column]], rank: int | None = None) -> None:
    """A strategy of one's own: ``record`` gives columns over the parsed page's fields, named as in a document."""
    pipeline.register(name, record, rank)


def jobs(table: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest jobs(job_id, status, created, ...)."""
    return _jobs.listing(table, status, limit, offset)


def tracked_urls(table: DataFrame, key: str = "url", version: str = "version") -> DataFrame:
    return _history.tracked(table, key, version)


def history(table: DataFrame, url: str, limit: int = 20, offset: int = 0, key: str = "url", version: str = "version") -> DataFrame:
    """Versions of one address, the newest first."""
    return _history.page(table, key, url, version, limit, offset)


def history_table(spark: SparkSession, path: str) -> tables.LogTable:
    """The stored history of addresses: append_versions() adds to it, page() and of() read one address's own files."""
    return tables.LogTable(spark, path, "url", ["version"])


def audit_table(spark: SparkSession, path: str) -> tables.LogTable:
    """The stored decisions of jobs: append() adds them, of() reads those of some jobs."""
    return tables.LogTable(spark, path, "job_id", ["field"])


def profile_table(spark: SparkSession, path: str) -> tables.KeyedTable:
    """The stored profiles of domains, kept by upserts."""
    return tables.KeyedTable(spark, path, ["domain"])


def job_audit(table: tables.LogTable, job_id: str, conflicts: bool = False) -> DataFrame:
    """A job's decisions in the order of their fields, or its conflicts alone."""
    rows = table.of(job_id)
    return (rows.where("conflict") if conflicts else rows).orderBy("field")


def diff(table: DataFrame, url: str, first: int, second: int, key: str = "url", version: str = "version", text: str = "main_content") -> DataFrame:
    """(url, first, second, diff): the unified difference of two versions of an address."""
    rows = table.where((F.col(key) == url) & F.col(version).isin(first, second))
    side = lambda v: F.max(F.when(F.col(version) == v, F.col(text)))
    both = rows.groupBy(key).agg(side(first).alias("a"), side(second).alias("b"))
    return both.select(F.col(key).alias("url"), F.lit(first).alias("first"), F.lit(second).alias("second"), _history.text_diff(F.col("a"), F.col("b")).alias("diff"))


def audit(merged: DataFrame, url: str | None = None) -> DataFrame:
    """Decisions on the fields of documents, of one address if given."""
    return pipeline.decisions(merged if url is None else merged.where(F.col("url") == url))


def metrics(outcomes: DataFrame, seconds: str = "elapsed_s") -> DataFrame:
    """(name, labels, value) of outcomes(engine_id, ok, elapsed_s): runs, failures and cumulative latency counts."""
    label = lambda k, c: F.concat(F.lit(f'{k}="'), c.cast("string"), F.lit('"'))
    runs = outcomes.groupBy("engine_id").agg(F.count("*").alias("engine_runs_total"), F.count_if(~F.col("ok")).alias("engine_failures_total"))
    counts = runs.unpivot("engine_id", ["engine_runs_total", "engine_failures_total"], "name", "value").select("name", label("engine", F.col("engine_id")).alias("labels"), "value")
    latency = _profile.latency_histogram(outcomes, seconds)
    buckets = latency.select(F.lit("engine_latency_seconds_bucket").alias("name"), F.concat_ws(",", label("engine", F.col("engine_id")), label("le", F.col("le"))).alias("labels"), F.col("n").alias("value"))
    return counts.unionByName(buckets)


def filter_findings(findings: DataFrame, severity: str | None = None, page: str | None = None) -> DataFrame:
    """Findings of one severity, of one page, or both."""
    rows = findings if severity is None else findings.where(F.col("severity") == severity)
    return rows if page is None else rows.where(F.col("source_url") == page)


def export_html(merged: DataFrame) -> DataFrame:
    return sinks.html_reports(merged)


def export_csv(merged: DataFrame, path: str) -> None:
    sinks.write_csv(merged, path)


def export_sheets(merged: DataFrame, path: str) -> None:
    sinks.write_sheets(merged, path)


def export_graphml(edges: DataFrame) -> DataFrame:
    return sinks.graphml_lines(edges)


def export_all(merged: DataFrame, path: str) -> dict[str, str]:
    return sinks.write_all(merged, path)


# ---------------------------------------------------------------- one page, outside Spark
def extract_title(html: str) -> str:
    return html_ops.title(parse(html or ""))


def extract_main_content(html: str) -> str:
    return html_ops.main_content(parse(html or ""))


def extract_meta_tags(html: str) -> list[dict]:
    return html_ops.meta(parse(html or ""))
