"""A store of named datasets with a history, a catalog and a trash, as Parquet folders under one root."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import free_name
from .clean import best_of_each
from .storage import renamed

CATALOG = "source string, dataset string, snapshot string, records long, storage string, merge string, saved_at long"


def catalog_upserted(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """``catalog`` with ``rows`` in place of those of the same source and dataset."""
    return catalog.join(rows.select("source", "dataset"), ["source", "dataset"], "left_anti").unionByName(rows)


def catalog_removed(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """``catalog`` without the (source, dataset) rows of ``keys``."""
    return catalog.join(keys.select("source", "dataset"), ["source", "dataset"], "left_anti")


def catalog_listed(catalog: DataFrame, source: str | None = None) -> DataFrame:
    """The rows of a source, or all; a blank number of records is 0."""
    rows = catalog if source is None else catalog.where(F.col("source") == source)
    return rows.withColumn("records", F.coalesce(F.col("records").try_cast("long"), F.lit(0).cast("long")))


def catalog_csv(catalog: DataFrame):
    """Each row's CSV line, in the catalog's fixed order of columns."""
    names = [x.split()[0] for x in CATALOG.split(", ")]
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.concat_ws(",", *[quoted(cell(n)) for n in names])


def last_at_first_place(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row for each key: its last values, at the place of its first row."""
    place = free_name(rows, "_first")
    firsts = rows.groupBy(key).agg(F.min(pos).alias(place))
    last = best_of_each(rows, [key], F.col(pos))
    return last.join(firsts, key).withColumn(pos, F.col(place)).drop(place).select(rows.columns)


def digest(rows: DataFrame) -> str:
    """A digest of a table's schema and rows, whatever their order: counts and sums of two hashes of each row."""
    # Maps don't hash: a row goes in by its JSON. A null's key is there, as fields are kept.
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), body).cast("decimal(38,0)"))
    found = rows.agg(F.count("*"), wide(1), wide(2), F.bit_xor(F.xxhash64(F.lit(3), body))).first()
    return sha256(repr([rows.schema.simpleString(), *map(str, found)]).encode()).hexdigest()


class DatasetStore:
    """Datasets under ``root``: each save is a new snapshot, to which the catalog points; catalogs are versions, too.

    Nothing is overwritten, so that readers of an earlier catalog go on; the last catalog counts. A new one is written
    aside and then renamed to the next number, which fails if another writer has taken it: then the change is made again
    to that writer's catalog, so that neither's is lost. That needs a file system whose rename of a folder is atomic.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, below: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")

    def _system(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _catalogs(self) -> list[str]:
        """The versions of the catalog in order."""
        system, folder = self._system(), self._path("catalog")
        made = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(name for name in made if system.exists(self._path(f"catalog/{name}/_SUCCESS")))

    def _version(self, name: str | None) -> DataFrame:
        return self.spark.read.schema(CATALOG).parquet(f"{self.root}/catalog/{name}") if name else self.spark.createDataFrame([], CATALOG)

    def catalog(self) -> DataFrame:
        found = self._catalogs()
        return self._version(found[-1] if found else None)

    def _publish(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Make ``change`` to the last catalog, whichever that is when it's taken over."""
        self._system().mkdirs(self._path("catalog"))
        while True:
            found = self._catalogs()
            last = found[-1] if found else None
            aside = f"staged/{uuid.uuid4().hex}"
            # A row for each dataset: small, so one file.
            change(self._version(last)).coalesce(1).write.parquet(f"{self.root}/{aside}")
            number = int(last.split("-")[0]) + 1 if last else 0
            if renamed(self.spark, f"{self.root}/{aside}", f"{self.root}/catalog/{number:08d}"):
                return
            self._system().delete(self._path(aside), True)

    def _point(self, source: str, dataset: str, snapshot: str, n: int) -> None:
        row = self.spark.createDataFrame([(source, dataset, snapshot, n, "parquet", "replace", int(time.time()))], CATALOG)
        self._publish(lambda catalog: catalog_upserted(catalog, row))

    def path(self, source: str, dataset: str, snapshot: str) -> str:
        return f"{self.root}/data/{source}/{dataset}/{snapshot}"

    def _new_snapshot(self) -> str:
        return f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"

    def save(self, rows: DataFrame, source: str, dataset: str, key: str | None = None, pos: str | None = None) -> str:
        """Write a snapshot and point the catalog to it; with ``key`` and ``pos`` one row of each key stays."""
        snapshot = self._new_snapshot()
        chosen = last_at_first_place(rows, key, pos) if key and pos else rows
        chosen.write.parquet(self.path(source, dataset, snapshot))
        self._point(source, dataset, snapshot, self.spark.read.parquet(self.path(source, dataset, snapshot)).count())
        return snapshot

    def save_if_changed(self, rows: DataFrame, source: str, dataset: str) -> str | None:
        """The name of the new snapshot, or None if the dataset has the same rows already.

        Rows are written once; what was written is compared by its digest, and then published or dropped.
        """
        snapshot, now = self._new_snapshot(), self._row(source, dataset)
        path = self.path(source, dataset, snapshot)
        rows.write.parquet(path)
        made = self.spark.read.parquet(path)
        if now is not None and digest(made) == digest(self.spark.read.parquet(self.path(source, dataset, now["snapshot"]))):
            self._system().delete(self._path(f"data/{source}/{dataset}/{snapshot}"), True)
            return None
        self._point(source, dataset, snapshot, made.count())
        return snapshot

    def adopt(self, folder: str, source: str, dataset: str) -> str:
        """Take a folder of Parquet files that a job has built into the store, without writing its rows again."""
        snapshot = self._new_snapshot()
        n = self.spark.read.parquet(folder).count()
        to = self._path(f"data/{source}/{dataset}/{snapshot}")
        self._system().mkdirs(to.getParent())
        if not self._system().rename(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), to):
            raise OSError(f"{folder} can't be moved into the store")
        self._point(source, dataset, snapshot, n)
        return snapshot

    def history(self, source: str, dataset: str) -> list[str]:
        """The snapshots of a dataset that the catalogs have pointed to, the latest last."""
        mine = (F.col("source") == source) & (F.col("dataset") == dataset)
        found = [r["snapshot"] for name in self._catalogs() for r in self._version(name).where(mine).select("snapshot").collect()]
        return [s for k, s in enumerate(found) if s not in found[k + 1 :]]

    def restore(self, source: str, dataset: str, snapshot: str) -> None:
        """Point the catalog to an earlier snapshot of a dataset."""
        if snapshot not in self.history(source, dataset) or not self._system().exists(self._path(f"data/{source}/{dataset}/{snapshot}")):
            raise KeyError(f"{source}/{dataset}/{snapshot}")
        self._point(source, dataset, snapshot, self.spark.read.parquet(self.path(source, dataset, snapshot)).count())

    def _row(self, source: str, dataset: str):
        return self.catalog().where((F.col("source") == source) & (F.col("dataset") == dataset)).first()

    def read(self, source: str, dataset: str) -> DataFrame:
        row = self._row(source, dataset)
        if row is None:
            raise KeyError(f"{source}/{dataset}")
        return self.spark.read.parquet(self.path(source, dataset, row["snapshot"]))

    def delete(self, source: str, dataset: str, permanent: bool = False) -> None:
        """Take a dataset out of the catalog; its snapshots go to the trash, or for good."""
        keys = self.spark.createDataFrame([(source, dataset)], "source string, dataset string")
        self._publish(lambda catalog: catalog_removed(catalog, keys))
        system, at = self._system(), self._path(f"data/{source}/{dataset}")
        if permanent:
            system.delete(at, True)
        else:
            to = self._path(f"trash/{int(time.time() * 1000)}/{source}/{dataset}")
            system.mkdirs(to.getParent())
            system.rename(at, to)
