"""Facts in buckets: the plan over them shuffles no events."""

import re

from plantlens.plans import catalog


def test_no_event_is_shuffled_over_the_layout(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.over_layout(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        plain = catalog.grid(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def shuffled_scans(text):
        """Exchanges whose rows come from a scan without being summed up on the way."""
        depth = lambda line: re.search(r"[A-Za-z*]", line).start()
        lines, found = [x for x in text.splitlines() if x.strip()], 0
        for k, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                for below in lines[k + 1 :]:
                    if depth(below) <= depth(line) or "Aggregate" in below:
                        break
                    if "FileScan" in below:
                        found += 1
                        break
        return found

    assert "Bucketed: true" in plan and shuffled_scans(plan) == 0 < shuffled_scans(plain)


def test_bucket_files_are_one_for_each(spark, tmp_path):
    from plantlens.sources.layout import laid_out

    table = laid_out(catalog.events(spark, "/root/testdata/sf0.01"), "plantlens_test_layout", str(tmp_path / "facts"), 4)
    assert table.count() == 10_000 and len(list((tmp_path / "facts").glob("part-*.parquet"))) <= 4
    spark.sql("drop table plantlens_test_layout")
