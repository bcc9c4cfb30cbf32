"""Regenerate PLANS.md: the physical plans of the headline queries."""

import re
import sys

from bench import HEADLINE, bench_queries
from hirelake.plans.registry import QUERIES, load_all
from hirelake.session import build_session

NOTES = """# Physical plans of the headline queries (sf0.1, local[8])

From `df.explain("formatted")`, expressions included, long lines cut. Notes:
- `list_newest` takes the top-k on the orders scan and joins only that page;
- struct-valued `min_by`/`max_by` run as partial `SortAggregate` (map side, then final);
- `MapInArrow` appears once per HTML plan (one parse per page, links resolved in it); `job_links` filters rows
  and shuffles accepted links once, by page (the first exchange deals the small scan over the cores);
- `health_timeline` has its windows inside (user, range); one row per user and range is handed on;
- `health_fold` scans the events once, dealt by key and hour; only hour rows meet by key;
- `search` reads a written index: its scan has `PartitionFilters` on the token prefix, and its page is
  sorted from the written hits;
- other broadcast joins were chosen by Catalyst/AQE from measured sizes.
"""


def main(sf: str) -> None:
    load_all()
    spark = build_session("local[8]", 16)
    out = [NOTES]
    found = bench_queries(QUERIES)
    for name in [*HEADLINE, "health_timeline", "proxy_assign"]:
        plan = found[name](spark, sf)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        lines = [x if len(x) <= 220 else x[:217] + "..." for x in re.sub(r"\n{2,}", "\n", plan).rstrip().split("\n")]
        out.append(f"\n## {name}\n\n```\n" + "\n".join(lines) + "\n```\n")
    open("PLANS.md", "w").write("".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
