"""Text parts read in batches of rows, with a state by which a job that stopped goes on where it was.

Rows are the lines of part files in natural order of the files' names. A batch is a range of row numbers of the whole; the
plan, a row for each part, is made once and kept beside the state. After a batch has been worked through, the state is
replaced in one step; it names epoch, batch, part and offset in the part, and the parts that are done. A batch that a
failure breaks off comes again with its number, so that a sink that overwrites by number sees each row once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..sources.files import listing, numbered_lines
from .storage import file_system, read_text, write_text


@dataclass(frozen=True)
class Batch:
    """One batch: its number over all epochs, its epoch, and its rows (line, file, line_number, row)."""

    number: int
    epoch: int
    rows: DataFrame


class PartReader:
    def __init__(self, spark: SparkSession, folder: str, state: str, size: int, pattern: str = "*.txt", anew: bool = False) -> None:
        """Batches of ``size`` rows of the files of ``folder``; ``state`` names a folder for plan and state.

        Other files, sizes or times than the state's, or another ``size``, are an error; with ``anew`` they start anew.
        """
        if size < 1:
            raise ValueError("a batch has a row at least")
        self.spark, self.folder, self.size, self.pattern, self.at = spark, folder, size, pattern, f"{state.rstrip('/')}/state.json"
        # A row for each part, as in a directory's listing.
        parts = listing(spark, folder, pattern).withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy(natural_key(F.col("name")), "path")
        found = [(r["path"], r["length"], str(r["modified"])) for r in parts.collect()]
        mark = sha256(json.dumps([size, found]).encode()).hexdigest()
        self.state = self._load()
        if self.state is not None and self.state["fingerprint"] != mark:
            if not anew:
                raise ValueError(f"the parts of {folder} or the size of batches have changed since {self.at} was written")
            self.state = None
        self.plan_path = f"{state.rstrip('/')}/plan-{mark[:16]}"
        where, system = file_system(spark, f"{self.plan_path}/_SUCCESS")
        if not system.exists(where):
            self._plan([p for p, _, _ in found])
        plan = spark.read.parquet(self.plan_path).orderBy("part").collect()
        self.parts = [(r["path"], r["first"], r["lines"]) for r in plan]
        self.total = sum(n for _, _, n in self.parts)
        if self.state is None:
            now = time.time()
            self.state = {"fingerprint": mark, "created_at": now, "updated_at": now, "progress": {}, "metrics": {}}
            self._moved(0)
            self._save()

    def _plan(self, paths: list[str]) -> None:
        """Number of lines and of the first row of each part."""
        spark = self.spark
        order = spark.createDataFrame(list(enumerate(paths)), "part int, path string")
        if paths:
            lines = numbered_lines(spark, self.folder, self.pattern).groupBy("file").agg(F.count("*").alias("lines"))
            plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
            joined = order.join(lines, plain(F.col("path")) == plain(F.col("file")), "left")
        else:
            joined = order.withColumn("lines", F.lit(0))
        counted = joined.select("part", "path", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))
        before = F.sum("lines").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        counted.withColumn("first", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(self.plan_path)

    def _load(self) -> dict | None:
        """The state, or the one before where the last isn't whole."""
        for path in (self.at, f"{self.at}.bak"):
            try:
                if said := (read_text(self.spark, path) or "").strip():
                    return json.loads(said)
            except ValueError:
                continue
        return None

    def _save(self) -> None:
        self.state["updated_at"] = time.time()
        write_text(self.spark, self.at, json.dumps(self.state, indent=2) + "\n", backup=True)

    @property
    def batches_per_epoch(self) -> int:
        return -(-self.total // self.size)

    def _moved(self, number: int) -> None:
        """The progress when ``number`` batches of all epochs are done."""
        per = self.batches_per_epoch
        epoch, batch = divmod(number, per) if per else (0, 0)
        row = batch * self.size
        at = next((k for k, (_, first, n) in enumerate(self.parts) if first <= row < first + n), len(self.parts))
        self.state["progress"] = {
            "epoch": epoch, "global_step": number, "rows_seen": epoch * self.total + row, "current_part_index": at,
            "current_part": self.parts[at][0] if at < len(self.parts) else None, "part_offset": row - self.parts[at][1] if at < len(self.parts) else 0,
            "completed_parts": [p for p, first, n in self.parts if first + n <= row],
        }

    def rows(self, low: int, high: int) -> DataFrame:
        """(line, file, line_number, row) of the rows numbered ``low`` to ``high`` - 1; other parts aren't opened."""
        some = [(p, first) for p, first, n in self.parts if n and first < high and first + n > low]
        if not some:
            return self.spark.createDataFrame([], "line string, file string, line_number bigint, row bigint")
        lines = numbered_lines(self.spark, [p for p, _ in some])
        plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
        begins = self.spark.createDataFrame(some, "part string, first bigint").withColumn("part", plain("part"))
        numbered = lines.join(begins, plain(F.col("file")) == F.col("part"))
        row = F.col("first") + F.col("line_number") - 1
        return numbered.select("line", "file", "line_number", row.alias("row")).where(row.between(low, high - 1))

    def batches(self, epochs: int = 1) -> Iterator[Batch]:
        """The batches that are left of so many epochs. Asking for the next one says that the last is done."""
        per = self.batches_per_epoch
        for number in range(self.state["progress"]["global_step"], epochs * per):
            epoch, batch = divmod(number, per)
            yield Batch(number, epoch, self.rows(batch * self.size, (batch + 1) * self.size))
            self._moved(number + 1)
            self._save()

    def note(self, **metrics: float) -> None:
        """Metrics that are saved with the state; each is a history, and ``best_loss`` the least loss so far."""
        for name, value in metrics.items():
            self.state["metrics"].setdefault(name, []).append(value)
            if name == "loss":
                best = self.state["metrics"].get("best_loss")
                self.state["metrics"]["best_loss"] = value if best is None else min(best, value)
