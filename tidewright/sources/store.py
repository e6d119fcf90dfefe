"""A store of fits: Parquet tables partitioned by tile, with a provenance row, label tables and completion rows.

The data of some tiles is written before their completion rows, and a tile is overwritten as a whole, so a run that was
lost or stopped goes on with the tiles that are not complete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.grid import outstanding, tiled
from tidewright.operators.linear import line_report
from tidewright.operators.models import parameter_table, resume_differences
from tidewright.operators.selection import check_invariant, points, rank, recompute
from tidewright.sources.inputs import describe_mismatch

SCHEMA_VERSION = 3
TILED = ("fits", "selection", "points")
COMMITS = "at long, unit long, n_tiles long, n_series long, n_read long, n_samples long, seconds double"


class ResumeError(ValueError):
    """A store that does not belong to the run."""


class Store:
    """The tables of one run below ``path``; every file access is Spark's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, name: str) -> bool:
        files, at = self._folder(name)
        return files.exists(at)

    def remove(self, name: str) -> None:
        files, at = self._folder(name)
        files.delete(at, True)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def tiled_tables(self) -> list[str]:
        """The tables that are there and have a part for each tile."""
        return [name for name in TILED if self.exists(name)]

    def provenance(self) -> dict | None:
        """What the store was made for; None if there is no store."""
        return json.loads(self.spark.read.text(f"{self.path}/provenance").first()[0]) if self.exists("provenance") else None

    def create(self, attrs: dict) -> None:
        """Writes provenance, labels and an empty table of completions; a store that is there, or attributes that lack something, are refused."""
        if self.provenance() is not None:
            raise ResumeError(f"{self.path} is a store already")
        if missing := [k for k in ("fit_hash", "compat_hash", "run_hash", "geometry_hash", "candidates", "labels", "criteria", "objective", "engine", "tile_side") if k not in attrs]:
            raise ResumeError(f"a store needs {missing[0]} among its attributes")
        text = json.dumps({"schema_version": SCHEMA_VERSION, **attrs}, sort_keys=True)
        write = lambda df, name: df.coalesce(1).write.parquet(f"{self.path}/{name}")
        write(self.spark.createDataFrame([(m, c, h) for m, (c, h) in enumerate(zip(attrs["labels"], attrs["candidates"], strict=True))], "m int, label string, hash string"), "dim_model")
        write(parameter_table(self.spark, attrs["labels"]), "dim_noise_param")
        write(self.spark.createDataFrame([(i, c) for i, c in enumerate(attrs["criteria"])], "place int, criterion string"), "dim_criterion")
        self.spark.createDataFrame([], "ty bigint, tx bigint").write.parquet(f"{self.path}/completion")
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/provenance")

    def write_places(self, places: DataFrame) -> None:
        """The values along y and x, and which series is where: as many rows as there are series."""
        for c in ("y", "x"):
            places.select(c).distinct().write.mode("overwrite").parquet(f"{self.path}/dim_{c}")
        places.select("series_id", "y", "x").write.mode("overwrite").parquet(f"{self.path}/dim_series")

    def check(self, attrs: dict) -> None:
        """Refuses to resume unless schema, fit, candidates and criteria are those of the store, in this order."""
        stored = self.provenance()
        if stored["schema_version"] == SCHEMA_VERSION and "geometry" in stored and "geometry" in attrs and (told := describe_mismatch(stored["geometry"], attrs["geometry"])):
            raise ResumeError(f"fit_hash of the store is of other data: {told}")
        for key in ("schema_version", "fit_hash", "candidates", "criteria", "compat_hash"):
            wanted = SCHEMA_VERSION if key == "schema_version" else attrs[key]
            if stored[key] != wanted:
                hint = "; new criteria need no fit: reuse the stored fits" if key == "criteria" else self.differing(attrs) if key == "candidates" else ""
                raise ResumeError(f"{key} of the store is {stored[key]!r}, of the run {wanted!r}{hint}")

    def differing(self, attrs: dict) -> str:
        """At which places the candidates of the store and of a run differ, in words."""
        stored = self.table("dim_model").select("m", "hash", "label")
        asked = self.spark.createDataFrame([(m, h, c) for m, (h, c) in enumerate(zip(attrs["candidates"], attrs["labels"], strict=True))], "m int, hash string, label string")
        odd = resume_differences(stored, asked).select("m").join(stored.select("m", F.col("label").alias("was")), "m", "left_outer").join(asked.select("m", F.col("label").alias("now")), "m", "left_outer")
        return "; " + ", ".join(f"candidate {r.m} was {r.was or 'none'} and is {r.now or 'none'}" for r in odd.orderBy("m").collect())

    def tile_side(self, asked: int) -> int:
        """The side of the store's tiles, which a run may enlarge no more than it may cut them."""
        stored = self.provenance()["tile_side"]
        if stored > asked:
            raise ResumeError(f"the store has tiles of side {stored}, above the {asked} of this run; its completions describe no others")
        return stored

    def write(self, fits: DataFrame, criteria: tuple[str, ...]) -> None:
        """Writes fits (with ty and tx), what is selected from them, and last the completion of their tiles.

        The fits are executed once, by the first write; all else is read back from the tiles without a completion.
        """
        overwrite = lambda df, name: df.write.partitionBy("ty", "tx").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")
        overwrite(fits, "fits")
        done = self.table("completion")
        stored = self.table("fits").join(done.select("ty", "tx"), ["ty", "tx"], "left_anti")
        self.finish(stored, criteria, overwrite)

    def write_tiles(self, fits: DataFrame, tiles: list[tuple[int, int]], criteria: tuple[str, ...]) -> None:
        """The same for a few tiles that are named, which Spark then reads back by their folders alone."""
        overwrite = lambda df, name: df.write.partitionBy("ty", "tx").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")
        overwrite(fits, "fits")
        self.finish(in_tiles(self.table("fits"), tiles), criteria, overwrite)

    def series_in(self, tiles: list[tuple[int, int]]) -> int:
        """How many series of some tiles are fitted, from their folders."""
        return in_tiles(self.table("fits"), tiles).where("m = 0").count()

    def record_commit(self, unit: int, n_tiles: int, n_series: int, n_read: int, n_samples: int, seconds: float) -> None:
        """One more row of the table of commits, numbered on."""
        at = self.table("commits").count() if self.exists("commits") else 0
        row = self.spark.createDataFrame([(at, unit, n_tiles, n_series, n_read, n_samples, seconds)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def accumulation(self, value: str = "seconds", per: str = "n_series") -> DataFrame:
        """Whether commits get dearer as a run goes on: a line through ``value`` over ``per`` by the number of the commit, and the later half less the earlier."""
        rows = self.table("commits").where(F.col(per) > 0).select(F.lit(0).alias("run"), F.col("at").cast("double").alias("at"), (F.col(value) / F.col(per)).alias("cost"))
        return line_report(rows, "run", "at", "cost").drop("run")

    def finish(self, stored: DataFrame, criteria: tuple[str, ...], overwrite) -> None:
        place = stored.select("series_id", "ty", "tx").distinct()
        scores = check_invariant(scores_of(stored))
        overwrite(rank(scores, criteria).join(place, "series_id"), "selection")
        overwrite(points(scores).join(place, "series_id"), "points")
        stored.select(F.col("ty").cast("bigint").alias("ty"), F.col("tx").cast("bigint").alias("tx")).distinct().coalesce(1).write.mode("append").parquet(f"{self.path}/completion")

    def reuse(self, source: Store, criteria: tuple[str, ...]) -> None:
        """Fills this store from the complete fits of another one, ranked by other criteria."""
        fits = source.table("fits")
        left = outstanding(fits.select("ty", "tx").distinct(), source.table("completion"))
        if not left.isEmpty():
            raise ResumeError(f"{source.path} is not complete")
        self.write(fits, criteria)


class Packed:
    """Packed series below a store while a run is on, in folders by unit: ``tiles_per_commit`` tiles in row-major order.

    Files are as large as a unit, however small its tiles are, and a unit is read by its folder, without a look at any other.
    ``extent`` holds the least and largest y and x.
    """

    NAME = "packed"

    def __init__(self, store: Store, side: int, tiles_per_commit: int, extent: dict):
        self.store, self.side, self.per, self.extent = store, side, tiles_per_commit, extent

    def unit(self) -> Column:
        first, last = self.extent["min_x"] // self.side, self.extent["max_x"] // self.side
        number = (F.col("ty") - self.extent["min_y"] // self.side) * (last - first + 1) + F.col("tx") - first
        return F.floor(number / self.per).cast("long")

    def write(self, series: DataFrame) -> None:
        """Deals the series by unit and tile, and writes each unit's folder; a unit of many rows may have several files."""
        placed = tiled(series, self.side).withColumns({"ty": F.col("ty").cast("long"), "tx": F.col("tx").cast("long")}).withColumn("unit", self.unit())
        dealt = placed.repartitionByRange("unit", "ty", "tx", "series_id").sortWithinPartitions("unit", "ty", "tx")
        dealt.write.partitionBy("unit").mode("overwrite").parquet(f"{self.store.path}/{self.NAME}")

    def places(self) -> DataFrame:
        """Everything but the samples."""
        return self.store.table(self.NAME).drop("samples")

    def outstanding(self) -> DataFrame:
        """(unit, ty, tx) of the tiles that are not complete."""
        return outstanding(self.places().select("unit", "ty", "tx").distinct(), self.store.table("completion"))

    def units(self, tiles: DataFrame) -> Iterator[int]:
        """The units of the tiles in order; there are as many as commits."""
        for row in tiles.select("unit").distinct().orderBy("unit").toLocalIterator():
            yield row.unit

    def read(self, unit: int, tiles: list[tuple[int, int]]) -> DataFrame:
        """The series of a unit's tiles."""
        return in_tiles(self.store.spark.read.parquet(f"{self.store.path}/{self.NAME}/unit={unit}"), tiles)

    def remove(self) -> None:
        if self.store.exists(self.NAME):
            self.store.remove(self.NAME)


def in_tiles(df: DataFrame, tiles: list[tuple[int, int]]) -> DataFrame:
    """The rows of some tiles; the predicate is on the folders, so nothing else is read."""
    by_row: dict[int, list[int]] = {}
    for ty, tx in tiles:
        by_row.setdefault(ty, []).append(tx)
    if not by_row:
        return df.where("false")
    found = F.lit(False)
    for ty, some in by_row.items():
        found = found | ((F.col("ty") == ty) & F.col("tx").isin(some))
    return df.where(found)


def scores_of(fits: DataFrame) -> DataFrame:
    """Fits in the form that the selection takes."""
    return fits.select("series_id", "m", "loglik", "k", "n", F.col("n_eff_bic").alias("n_eff"), "outcome", "engine", "objective")


__all__ = ["ResumeError", "Store", "in_tiles", "recompute", "scores_of"]
