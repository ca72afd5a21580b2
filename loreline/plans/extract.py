"""The collecting job: archives to deduplicated, merged and enriched items."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loreline.functions.mail import BOUNDARY_WINDOW
from loreline.operators.enrich import counters, enrich
from loreline.operators.items import (
    carry_enrichment,
    dedupe_first,
    parse_messages,
    with_title_and_comment,
)
from loreline.schemas import ITEM_COLUMNS
from loreline.sources.sinks import write_items_parquet


class Watches(NamedTuple):
    """What one pass over the archives counts on its way: tagged lines, items made of them, enriched rows."""

    scan: Observation
    items: Observation
    rows: Observation

    def row(self) -> dict[str, int]:
        """The counters of the run, once its rows were written."""
        found = {**self.scan.get, **self.items.get, **self.rows.get}
        return {
            "tagged": found["tagged"], "extracted": found["extracted"], "final": found["total"], "skipped": found["tagged"] - found["extracted"],
            "duplicates": found["extracted"] - found["total"], **{k: v for k, v in found.items() if k not in ("tagged", "extracted", "total")},
        }


def watches() -> Watches:
    return Watches(Observation("scan"), Observation("items"), Observation("rows"))


def extract_items(
    messages: DataFrame, old: DataFrame | None = None, dom: bool = True, window: int | None = BOUNDARY_WINDOW, watch: Watches | None = None
) -> DataFrame:
    """Messages (folder_rank, ord, raw) to one item per title, earlier enrichment carried over.

    One lazy plan. Copies are removed by final title, after remarks and broken subjects
    are resolved; `subject_title` keeps the title of the subject.
    """
    parsed = parse_messages(messages, window, watch.scan if watch else None).withColumn("subject_title", F.col("title"))
    if watch:
        parsed = parsed.observe(watch.items, F.coalesce(F.sum("hits"), F.lit(0)).alias("extracted"))
    items = dedupe_first(with_title_and_comment(parsed, dom).drop("body"), F.col("ord"))
    if old is None:
        return items.withColumn("doi", F.lit("")).withColumn("journal", F.lit(""))
    return carry_enrichment(items, old)


def collect_items(
    messages: DataFrame,
    doi_dim: DataFrame,
    path: str,
    old: DataFrame | None = None,
    own_hosts=(),
    resolved: DataFrame | None = None,
    dom: bool = True,
    window: int | None = BOUNDARY_WINDOW,
    watch: Watches | None = None,
) -> DataFrame:
    """Extraction and enrichment, written in the fixed column order; returns the enriched rows.

    The key of a row is its title, unique after extraction. `resolved` (doi, resolved_url) names the addresses that DOIs
    resolve to, for the last step of the enrichment. `watch` is filled by the pass that writes, so counting
    costs no scan of its own; a stage that runs again after a loss may be counted twice.
    """
    items = extract_items(messages, old, dom, window, watch)
    enriched = enrich(items, doi_dim, "title", resolved=resolved, own_hosts=own_hosts)
    written = enriched.withColumnRenamed("sender", "from")
    if watch:
        written = written.observe(watch.rows, *counters())
    write_items_parquet(written, path, ITEM_COLUMNS)
    return enriched
