"""The ledger: one row per message, in batches that are there wholly or not at all.

A batch is a folder ``batch_id=n``. What a batch has to know of earlier ones lies
beside it: the seqs seen, in a table with folders by seq and batch, and the state
after a batch, which is a watermark for each tag, the last accepted alarm of each
key, and the totals by category. There are two places for the state, used in
turn, and writing it commits the batch: rows and seqs of a batch that no state
tells of are not read. A batch that was interrupted is given again under its
number and takes the same places. Facts are views of the ledger and need no second
write. A folder without our owner's mark is never written to.

A batch reads the folders of seqs that its own seqs fall into, and one state. It
asks the store for a number of things that does not grow with the batches before.
Totals are observed while the rows are written, not counted afterwards.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.classify import Carry, carry_of, classify, parsed_messages
from plantlens.schema import CATEGORIES, LEDGER, Policy
from plantlens.sources.scratch import scratch
from plantlens.streaming.files import children, exists, touch

OWNER, SEEN, STATE = "_plantlens_ledger", "_seen", "_state"
#: Seqs next to each other in one folder, and folders, which are used in a circle.
RUN, FOLDERS = 1 << 16, 4096
SEEN_ROWS = "seq long, seen_hash string, folder int, batch_id long"
STATE_ROWS = "batch_id long, tag string, alarm_code string, phase string, us long, category string, n long"


def folder_of(seq):
    return F.pmod(F.floor(F.col(seq) / RUN), F.lit(FOLDERS)).cast("int")


class Ledger:
    def __init__(self, spark: SparkSession, path: str, policy: Policy = Policy()):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy
        if not exists(spark, f"{self.path}/{OWNER}"):
            if children(spark, self.path):
                raise ValueError(f"{path} is not empty and no ledger of ours")
            touch(spark, f"{self.path}/{OWNER}")

    def state(self, place: int) -> DataFrame:
        return self.spark.read.schema(STATE_ROWS).parquet(f"{self.path}/{STATE}/{place}")

    def places(self) -> dict[int, int]:
        """Where the states after the last batch or two lie, by number of the batch."""
        whole = [p for p in (0, 1) if exists(self.spark, f"{self.path}/{STATE}/{p}/_SUCCESS")]
        return {self.state(p).agg(F.max("batch_id")).first()[0]: p for p in whole}

    def folders(self) -> list[int]:
        """Numbers of all batches that have been begun."""
        found = [re.fullmatch(r"batch_id=(\d+)", n) for n in children(self.spark, self.path)]
        return sorted(int(m[1]) for m in found if m)

    def batches(self, before: int | None = None) -> list[int]:
        """Numbers of the committed batches."""
        last = max(self.places(), default=-1)
        # the last one may be about to be replaced
        if last >= 0 and not exists(self.spark, f"{self.path}/batch_id={last}/_SUCCESS"):
            last -= 1
        return [n for n in self.folders() if n <= last and (before is None or n < before)]

    def read(self, before: int | None = None) -> DataFrame:
        """All rows of committed batches: a fixed list of folders, whatever is written meanwhile."""
        return self.read_batches(self.batches(before))

    def read_batches(self, numbers: list[int]) -> DataFrame:
        paths = [f"{self.path}/batch_id={n}" for n in numbers]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def seen(self, rows: DataFrame, upto: int) -> DataFrame:
        """Seqs and hashes seen up to a batch, of the folders that parsed rows fall into."""
        near = [r.folder for r in rows.where("reason is null").select(folder_of("seq").alias("folder")).distinct().collect()]  # at most FOLDERS
        paths = [p for p in (f"{self.path}/{SEEN}/folder={k}" for k in near) if exists(self.spark, p)]
        found = self.spark.read.schema(SEEN_ROWS).option("basePath", f"{self.path}/{SEEN}").parquet(*paths) if paths else self.spark.createDataFrame([], SEEN_ROWS)
        return found.where(F.col("batch_id") <= upto).select("seq", "seen_hash")

    def carried(self, rows: DataFrame, prior: int | None, place: int) -> Carry | None:
        """What the batches up to a number have decided of the seqs, tags and alarms of parsed rows."""
        if prior is None:
            return None
        state = self.state(place)
        marks = state.where("tag is not null and alarm_code is null").select("tag", F.col("us").alias("mark_us"))
        return Carry(self.seen(rows, prior), marks, state.where("alarm_code is not null").select("tag", "alarm_code", "phase", F.col("us").alias("ts_us")))

    def append(self, messages: DataFrame, batch_id: int) -> dict[str, int]:
        """Classify messages (arrival_id, raw_payload, maybe file and block) against all earlier batches and commit them as one; returns its totals.

        A batch may be written again until a later one has begun.
        """
        places = self.places()
        if any(n > batch_id for n in places):
            raise ValueError(f"later batches rest on batch {batch_id}")
        prior = max((n for n in places if n < batch_id), default=None)
        lost = [n for n in self.folders() if (-1 if prior is None else prior) < n < batch_id]
        if lost:
            raise ValueError(f"batch {lost[0]} was begun and not committed; it has to be given again")
        with scratch(self.spark):
            rows = parsed_messages(messages)
            old = self.carried(rows, prior, places.get(prior, 0))
            totals = self.write(classify(rows, self.policy, old, ready=True), batch_id)
        self.commit(old, totals, prior, batch_id, 1 - places[prior] if prior is not None else 0)
        return totals

    def write(self, rows: DataFrame, batch_id: int) -> dict[str, int]:
        """Write a batch's rows; their totals come out of the same pass."""
        told = Observation()
        rows = rows.observe(told, *(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        return {c: n for c, n in told.get.items() if n}

    def commit(self, old: Carry | None, totals: dict[str, int], prior: int | None, batch_id: int, place: int) -> None:
        """Put down what a written batch has decided: its seqs, then the state after it."""
        own = carry_of(self.read_batches([batch_id]))
        seen = own.seen.select("seq", "seen_hash", folder_of("seq").alias("folder"), F.lit(batch_id).cast("long").alias("batch_id"))
        seen.hint("rebalance", "folder").write.partitionBy("folder", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{SEEN}")
        marks, alarms, before = own.marks, own.alarms, {}
        if old is not None:
            # later batches decide alarms; watermarks only rise
            marks = marks.union(old.marks).groupBy("tag").agg(F.max("mark_us").alias("mark_us"))
            alarms = alarms.union(old.alarms.join(alarms, ["tag", "alarm_code"], "left_anti"))
            before = self.totals_at(1 - place)
        number, none = F.lit(batch_id).cast("long").alias("batch_id"), lambda kind, name: F.lit(None).cast(kind).alias(name)
        state = marks.select(number, "tag", none("string", "alarm_code"), none("string", "phase"), F.col("mark_us").alias("us"), none("string", "category"), none("long", "n"))
        state = state.unionByName(alarms.select(number, "tag", "alarm_code", "phase", F.col("ts_us").alias("us")), allowMissingColumns=True)
        sums = [(batch_id, None, None, None, None, c, before.get(c, 0) + totals.get(c, 0)) for c in CATEGORIES]
        state = state.union(self.spark.createDataFrame(sums, STATE_ROWS))
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{STATE}/{place}")

    def totals_at(self, place: int) -> dict[str, int]:
        return {r.category: r.n for r in self.state(place).where("category is not null").collect()}

    def totals(self) -> dict[str, int]:
        """Messages by category of all committed batches, as observed while they were written."""
        places = self.places()
        return {c: n for c, n in self.totals_at(places[max(places)]).items() if n} if places else {}
