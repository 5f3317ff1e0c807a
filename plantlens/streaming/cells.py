"""The machine x shift grid kept up to date as facts come in, late ones too.

A cell (machine, k) holds its measures, and what lies nearest to it outside: the last
observation and the last state before it, and the first ones behind it. With these a cell
is worked out from its own facts alone. A batch changes the cells that its facts fall into
and the cells from there to the nearest older facts on either side, whose gaps and
segments it splits; the outside facts kept in the cells that it falls into say how
far that is. Just these cells are read, worked out again, and written. So a batch
reads and writes what it touches, however long the history.

Facts lie in folders by shift and batch, cells in folders by shift; a folder is
replaced as one. A batch that was interrupted is given again under its number,
and comes to the same. Two more cells of each machine, -1 and the number of shifts,
hold what lies outside the table of shifts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.coverage import edges_and_gaps
from plantlens.operators.grid import MICRO, base_us, shift_index
from plantlens.operators.metrics import ratios
from plantlens.operators.segments import by_state
from plantlens.schema import Shifts
from plantlens.sources.scratch import saved, scratch
from plantlens.streaming.files import exists

KEY = ["machine", "k"]
FACT = "machine string, us long, type string, state string, reason_code string, good_delta int, reject_delta int, log_id long, k int, batch_id long"
STATE = "struct<us:long,log_id:long,state:string,reason_code:string>"
OUTSIDE = f"before_us long, after_us long, before_state {STATE}, after_state_us long"
MEASURES = "run_us long, down_us long, idle_us long, good long, reject long, state_seen boolean, start_ok boolean, end_ok boolean, gaps_ok boolean, max_gap_us long, gap_from_us long, gap_to_us long, n_observations long"
CELL = f"machine string, k int, {OUTSIDE}, {MEASURES}"


def names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


class Cells:
    def __init__(self, spark: SparkSession, path: str, shifts: Shifts, gap_s: int):
        self.spark, self.path, self.shifts, self.gap_s = spark, path.rstrip("/"), shifts, gap_s

    def of_shifts(self, table: str, schema: str, ks: list[int]) -> DataFrame:
        """A table's rows in these shifts; no other folder is looked into."""
        paths = [p for p in (f"{self.path}/{table}/k={k}" for k in ks) if exists(self.spark, p)]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.select(*names(schema.replace(STATE, "struct")))

    def put(self, rows: DataFrame, table: str, *folders: str) -> None:
        """Replace the folders that rows fall into; a shift with most of the rows is written by several tasks."""
        rows.hint("rebalance", "k").write.partitionBy(*folders).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{table}")

    def place(self, us):
        """The cell of a time, null for none."""
        return F.when(us.isNotNull(), F.greatest(F.lit(-1), F.least(F.lit(self.shifts.count), shift_index(us, self.shifts))))

    def changed(self, fresh: DataFrame) -> DataFrame:
        """The cells that facts summed up by cell can change."""
        ks = [r.k for r in fresh.select("k").distinct().collect()]  # at most as many as there are shifts
        old = self.of_shifts("cells", CELL, ks).select(*KEY, *names(OUTSIDE.replace(STATE, "struct")))
        rows = fresh.join(old, KEY, "left")
        has_state = F.col("last_state").isNotNull()
        first, last = F.lit(-1), F.lit(self.shifts.count)
        low = F.least(F.coalesce(self.place(F.col("before_us")), first), F.when(has_state, F.coalesce(self.place(F.col("before_state.us")), first)))
        high = F.greatest(F.coalesce(self.place(F.col("after_us")), last), F.when(has_state, F.coalesce(self.place(F.col("after_state_us")), last)))
        # a machine that is new has no cells yet and gets all of them
        return rows.select("machine", F.explode(F.sequence(low, high)).alias("k")).distinct()

    def outside(self, touched: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
        """What lies nearest to each touched cell: the nearer of what was known and the batch's own facts."""
        rows = touched.join(old.select(*KEY, *names(OUTSIDE.replace(STATE, "struct"))), KEY, "left").join(fresh, KEY, "left")
        before = Window.partitionBy("machine").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy("machine").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
        nearer = F.max("last_state").over(before)
        state = F.when(F.col("before_state").isNull() | (nearer > F.col("before_state")), F.coalesce(nearer, "before_state")).otherwise(F.col("before_state"))
        return rows.select(*KEY, F.greatest("before_us", F.max("last_us").over(before)).alias("before_us"), F.least("after_us", F.min("first_us").over(after)).alias("after_us"), state.alias("before_state"), F.least("after_state_us", F.min("first_state_us").over(after)).alias("after_state_us"))

    def measured(self, cells: DataFrame, facts: DataFrame) -> DataFrame:
        """The measures of cells (with what lies outside) from their own facts."""
        length = self.shifts.seconds * MICRO
        start = base_us(self.shifts) + F.col("k").cast("long") * length
        bounded = cells.withColumns({"s_start_us": start, "s_end_us": start + length})
        edges = bounded.select(*KEY, F.explode(F.array_compact(F.array("before_us", "after_us"))).alias("at"))
        seen = facts.select(*KEY, F.col("us").alias("at")).union(edges).distinct()
        seen = seen.withColumn("next", F.lead("at").over(Window.partitionBy(*KEY).orderBy("at")))
        covered = edges_and_gaps(bounded.select(*KEY, "s_start_us", "s_end_us").join(seen, KEY, "left"), KEY, self.gap_s * MICRO).drop("s_start_us")
        states = facts.where("type = 'STATE'").select(*KEY, F.struct("us", "log_id", "state", "reason_code").alias("s"))
        states = states.union(cells.where("before_state is not null").select(*KEY, F.col("before_state").alias("s"))).select(*KEY, "s.*")
        following = F.lead("us").over(Window.partitionBy(*KEY).orderBy("us", "log_id"))
        states = states.withColumn("next_us", following).join(bounded.select(*KEY, "s_start_us", "s_end_us"), KEY)
        us = F.least(F.coalesce("next_us", "s_end_us"), "s_end_us") - F.greatest("us", "s_start_us")
        seconds = by_state(states.withColumn("us", us), *KEY).join(states.groupBy(*KEY).agg(F.bool_or(F.col("us") <= F.col("s_start_us")).alias("state_seen")), KEY)
        counts = facts.where("type = 'COUNT'").groupBy(*KEY).agg(F.sum(F.col("good_delta").cast("long")).alias("good"), F.sum(F.col("reject_delta").cast("long")).alias("reject"))
        rows = cells.join(covered, KEY).join(seconds, KEY, "left").join(counts, KEY, "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("run_us", "down_us", "idle_us", "good", "reject")}
        return rows.withColumns(zero | {"state_seen": F.coalesce("state_seen", F.lit(False))})

    def update(self, facts: DataFrame, batch_id: int) -> None:
        """Take in accepted facts (machine, ts, type, state, reason_code, good_delta, reject_delta, log_id) as a batch."""
        with scratch(self.spark):
            rows = facts.withColumn("us", microseconds("ts")).withColumns({"k": self.place(F.col("us")), "batch_id": F.lit(batch_id).cast("long")})
            new = saved(rows.select(*names(FACT)))
            is_state = F.col("type") == "STATE"
            fresh = saved(new.groupBy(*KEY).agg(
                F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min(F.when(is_state, F.col("us"))).alias("first_state_us"),
                F.max(F.when(is_state, F.struct("us", "log_id", "state", "reason_code"))).alias("last_state"),
            ))
            touched = saved(self.changed(fresh))
            ks = [r.k for r in touched.select("k").distinct().collect()]
            old = self.of_shifts("cells", CELL, ks)
            own = self.of_shifts("facts", FACT, ks).where(F.col("batch_id") != batch_id).join(touched, KEY, "left_semi")
            cells = saved(self.outside(touched, old, fresh))
            found = self.measured(cells, saved(own.unionByName(new)))
            columns = names(CELL.replace(STATE, "struct"))
            done = saved(found.select(*columns).unionByName(old.join(touched, KEY, "left_anti").select(*columns)))
            self.put(new, "facts", "k", "batch_id")
            self.put(done, "cells", "k")

    def read(self) -> DataFrame:
        """All cells of the table of shifts with ``complete``; no facts are read."""
        rows = self.of_shifts("cells", CELL, list(range(self.shifts.count)))
        start = base_us(self.shifts) + F.col("k").cast("long") * self.shifts.seconds * MICRO
        tiled = F.abs(F.col("run_us") + F.col("down_us") + F.col("idle_us") - self.shifts.seconds * MICRO) < MICRO
        rows = rows.withColumns({"s_start_us": start, "state_ok": F.col("state_seen") & tiled})
        return rows.withColumn("complete", F.col("start_ok") & F.col("end_ok") & F.col("gaps_ok") & F.col("state_ok"))

    def grid(self, machines: DataFrame) -> DataFrame:
        """The cells with seconds and the four ratios."""
        return ratios(self.read(), machines, self.shifts)
