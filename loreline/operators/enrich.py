"""DOI and journal of items by a waterfall of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions.identifiers import (
    doi_from_url,
    journal_by_doi_prefix,
    journal_by_domain,
    journal_by_resolved_domain,
)
from loreline.functions.text import strip


def _filled(c: Column) -> Column:
    return F.nullif(F.coalesce(strip(c), F.lit("")), F.lit(""))


def journal_by_doi(
    items: DataFrame, doi_dim: DataFrame, item_id: str, doi: str = "doi", wanted: Column | None = None
) -> DataFrame:
    """C4: first container title of the DOI from a dimension table, as `journal_lookup`.

    `doi_dim` has doi and container_titles. Rows that need no lookup get a key of
    their own, which matches nothing: in an outer join all null keys would meet in
    one task. AQE splits a DOI that many rows share.
    """
    titles = doi_dim.groupBy("doi").agg(F.min(F.get("container_titles", F.lit(0))).alias("journal_lookup"))
    need = F.col(doi) != ""
    if wanted is not None:
        need = need & wanted
    apart = F.concat(F.lit("#"), F.col(item_id).cast("string"))
    keyed = items.withColumn("_doi", F.when(need, F.col(doi)).otherwise(apart))
    return keyed.join(titles.withColumnRenamed("doi", "_doi"), "_doi", "left").drop("_doi")


def address_by_doi(items: DataFrame, resolved: DataFrame, item_id: str, wanted: Column) -> DataFrame:
    """The address that a DOI leads to, as `_address`, for the rows that want one; keys as in `journal_by_doi`."""
    known = resolved.groupBy(F.col("doi").alias("_doi")).agg(F.min("resolved_url").alias("_address"))
    apart = F.concat(F.lit("#"), F.col(item_id).cast("string"))
    return items.withColumn("_doi", F.when(wanted, F.col("doi")).otherwise(apart)).join(known, "_doi", "left").drop("_doi")


def enrich(
    items: DataFrame,
    doi_dim: DataFrame,
    item_id: str,
    resolved: str | DataFrame | None = "resolved_url",
    own_hosts=(),
) -> DataFrame:
    """Doi kept or extracted; journal kept, looked up, or by host, prefix, address.

    Adds `source`: kept, lookup, domain, prefix, resolved or none. `resolved` is the column with the address
    that a row's DOI leads to, or a dimension table (doi, resolved_url); without it that step is left out.
    """
    url = strip(F.coalesce("url", F.lit("")))
    kept_doi = _filled(F.col("doi")) if "doi" in items.columns else F.lit(None).cast("string")
    kept = _filled(F.col("journal")) if "journal" in items.columns else F.lit(None).cast("string")
    rows = (
        items.withColumn("_url", url)
        .withColumn("_kept", kept)
        .withColumn("doi", F.coalesce(kept_doi, doi_from_url(F.col("_url")), F.lit("")))
    )
    rows = journal_by_doi(rows, doi_dim, item_id, wanted=F.col("_kept").isNull())
    has_doi = F.col("doi") != ""
    by_host = F.when(F.startswith("_url", F.lit("http")), journal_by_domain(F.col("_url"), own_hosts))
    by_prefix = F.when(has_doi, journal_by_doi_prefix(F.col("doi")))
    led = has_doi & F.startswith("_url", F.lit("https://doi.org/"))
    by_address = F.lit(None).cast("string")
    if isinstance(resolved, DataFrame):
        # Only rows that no step before has named ask for an address.
        open_ = led & F.coalesce(F.col("_kept"), _filled(F.col("journal_lookup")), by_host, by_prefix).isNull()
        rows = address_by_doi(rows, resolved, item_id, open_)
        by_address = F.when(led, journal_by_resolved_domain(F.col("_address"), own_hosts))
    elif resolved is not None:
        by_address = F.when(led, journal_by_resolved_domain(F.col(resolved), own_hosts))
    steps = [
        ("kept", F.col("_kept")),
        ("lookup", _filled(F.col("journal_lookup"))),
        ("domain", by_host),
        ("prefix", by_prefix),
        ("resolved", by_address),
    ]
    # One struct per step: the first that has a journal also names the source.
    found = F.coalesce(
        *[
            F.when(value.isNotNull(), F.struct(value.alias("journal"), F.lit(name).alias("source")))
            for name, value in steps
        ],
        F.struct(F.lit("").alias("journal"), F.lit("none").alias("source")),
    )
    return (
        rows.withColumn("_found", found)
        .withColumn("journal", F.col("_found.journal"))
        .withColumn("source", F.col("_found.source"))
        .drop("_url", "_kept", "_found", "journal_lookup", "_address")
    )


def counters() -> list[Column]:
    """The counters of enriched rows. Items with a journal from before count as DOIs only."""
    s = F.col("source")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("doi") != "").alias("doi_found"),
        F.count_if(s == "lookup").alias("journal_lookup"),
        F.count_if(s.isin("domain", "prefix", "resolved")).alias("journal_domain"),
        F.count_if(s == "none").alias("no_journal"),
    ]


def run_counters(enriched: DataFrame) -> DataFrame:
    """What a run found, one row. A job that writes the rows anyway observes `counters()` as it does."""
    return enriched.agg(*counters())
