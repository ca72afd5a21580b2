"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local threads. Each query
runs twice and the faster run counts, so that compiling is not timed; results go to
the noop sink, so that they are computed whole and not moved to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyarrow.parquet import ParquetFile

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loreline.plans import catalog  # noqa: E402
from loreline.session import build_session  # noqa: E402

HEADLINE = [
    "topic_growth",
    "monthly_counts",
    "weekly_counts",
    "rolling_mean_weekly",
    "hour_histogram",
    "asof_locate",
    "latest_by_key",
    "group_by_year",
    "latest",
    "dedupe_first",
    "carry_enrichment",
    "with_sender_name",
    "doi_from_url",
    "journal_by_domain",
    "enrich",
    "match_first_rule",
    "select_body",
    "resolve_title_comment",
    "best_url",
    "strip_style_script",
    "html_to_text",
    "term_statistics",
    "tfidf",
    "label_topics_papers",
    "assign_topics",
    "dense_centroids",
    "topic_report",
    "corpus_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__driver__host="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in only:
        runs = []
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "spark": spark.version,
        # A scan has no more tasks with rows than its table has row groups.
        "row_groups": {p.stem: ParquetFile(p).metadata.num_row_groups for p in sorted(Path(sf_dir).glob("*.parquet")) if p.is_file()},
    }))


if __name__ == "__main__":
    main()
