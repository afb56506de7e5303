"""Headline timings: prints one JSON line.

Every query runs once untimed (code generation, file listing) and then ``BENCH_RUNS`` times; the
fastest run counts. ``etl_events`` is the whole request-to-event pipeline over all columns; the
rollups read the written events, as the reports do. Reports that other reports store are computed from
the events in every run. ``etl_distinct_bodies`` makes every body another one, ``etl_10kb_bodies`` also
adds some 10 kB of terms, over a tenth of the log.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from seekledger.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = (
    "b_usage_events",
    "e01_groups_by_count",
    "e02_operations_over_time",
    "e05_top_filtered_fields",
    "e04_e13_field_tables_one_scan",
    "e16_templates_over_time",
    "e17_costliest_templates",
    "e18_template_variety",
    "e20_client_addresses",
    "e22_client_fields",
    "e31_group_breakdown",
    "e37_field_templates",
    "e43_traffic_counters",
    "f02_field_usage",
    "g01_g10_recommendations",
    "h01_usage_stats",
    "h02_shard_stats",
    "h08_index_profile",
    "h25_index_recommendations",
    "i03_stress_share_by_template",
    "i04_stress_over_time_by_target",
    "j04_change_impact",
    "j06_template_percentiles",
    "k08_revenue_by_country",
    "k14_partial_update",
    "l01_stream_ingest",
)


#: Tables that some reports store for others.
STORED = ("mapping_diff", "tenant_profile", "tenant_findings")


def _distinct(requests, padding: int = 0):
    """The same log with another body in every request."""
    from pyspark.sql import functions as F

    terms = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(padding)), lambda k: F.concat(F.lit('"v'), k + F.col("request_id"), F.lit('"'))), ",")
    extra = F.concat(F.lit('{"own": {"terms": {"own_id": ['), terms, F.lit("]}}, "))
    is_object = F.startswith("body", F.lit('{"')) & ~F.contains("body", F.lit("\n"))
    return requests.withColumn("body", F.when(is_object, F.concat(extra, F.expr("substring(body, 2)"))).otherwise(F.col("body")))


def _run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from catalogue import registered
    from seekledger.operators.tables import forget, written_once
    from seekledger.plans.events import build_usage_events
    from seekledger.samples import catalog

    spark = local_session(CPUS, "bench")
    queries = registered()
    requests, groups = catalog.requests(spark, SF_DIR), catalog.group_map(spark, SF_DIR)
    bodies = requests.count()
    times = {}
    events = build_usage_events(requests, groups)
    _run(events)
    times["etl_events"] = min(_run(events) for _ in range(RUNS))
    for name, padding in (("etl_distinct_bodies", 0), ("etl_10kb_bodies", 900)):
        share = requests.filter("request_id % 10 = 0") if padding else requests
        log = written_once(spark, f"{name} {SF_DIR}", lambda r=share, p=padding: _distinct(r, p))
        other = build_usage_events(log, groups)
        times[name] = min(_run(other) for _ in range(RUNS))
    for name in HEADLINE:
        if name == "b_usage_events":
            continue
        runs = []
        for _ in range(RUNS + 1):
            forget(spark, *STORED)
            start = time.perf_counter()
            _run(queries[name].run(spark, SF_DIR))
            runs.append(time.perf_counter() - start)
        times[name] = min(runs[1:])
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in times.items()},
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "bodies": bodies,
        "bodies_per_second": round(bodies / times["etl_events"]),
        "core_ms_per_body": round(1000 * CPUS * times["etl_events"] / bodies, 4),
        "core_ms_per_distinct_body": round(1000 * CPUS * times["etl_distinct_bodies"] / bodies, 4),
        "core_ms_per_10kb_body": round(10_000 * CPUS * times["etl_10kb_bodies"] / bodies, 4),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
