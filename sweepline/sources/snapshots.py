"""A keyed table on shared storage: snapshots by version, data dealt to cells, a pointer that moves last.

Layout under the root::

    data/<write>/_cell=<cell>/part-*.parquet    rows of one write, never changed afterwards
    versions/00000007.json                      a snapshot: schema and, for each cell, the folder that holds it

A cell is a value of the ``layout`` columns and a bucket, the hash of the ``spread`` columns modulo ``buckets``. A write

1. stages its own rows by cell (what they are is then fixed, however often tasks run again),
2. merges the cells it touches with the rows they held and writes those cells anew,
3. creates the next version's file, which fails if another writer has created it first.

Nothing is changed in place: a write that fails in 1 or 2 leaves the table as it was, a reader keeps the snapshot it has opened, cells
that a write doesn't touch keep their files. ``vacuum`` removes folders that no kept version names.

The driver holds a snapshot's cells, (values of ``layout``) x ``buckets`` of them, never rows. Rows of a cell are sorted by ``order`` and split over
tasks by range, so a key or series with a third of all rows is several files. Null key parts are equal to each other; a column that an older
snapshot lacks is null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CELL = "_cell"


class LostRace(RuntimeError):
    """Another writer made the next version first; its rows are in the table, this write's aren't."""


class SharedFiles:
    """The few file operations that a table's driver needs, on any storage that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a whole new file; False if there is one by that name already."""
        part, fs = self._at(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        place, _ = self._at(path)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self._gateway_array(self._jvm.org.apache.hadoop.fs.Options.Rename)
        try:
            context.rename(fs.makeQualified(part), fs.makeQualified(place), options)
        except Exception as error:
            fs.delete(part, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def _gateway_array(self, kind):
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(kind, 0)

    def remove(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


class SnapshotTable:
    """See the module's text.

    ``keys`` tell rows apart (``upsert``) or name groups of rows that are replaced as one (``replace``). ``spread``, a part of ``keys``, is what is
    hashed to buckets; ``order`` sorts the rows of a cell; ``bloom`` columns get Parquet Bloom filters.
    ``lenient`` readers pass over files that can't be read.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], layout: tuple[str, ...] = (), spread: list[str] | None = None, order: list[str] | None = None, buckets: int = 64, bloom: tuple[str, ...] = (), lenient: bool = False):
        self.spark, self.root, self.keys, self.layout = spark, root.rstrip("/"), keys, layout
        self.spread, self.order, self.buckets, self.bloom = spread or keys, order or keys, buckets, bloom
        self.lenient, self.files = lenient, SharedFiles(spark)

    # --- snapshots ---------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit()]

    def snapshot(self, version: int | None = None) -> dict:
        """The version's file; without a version the newest, or an empty one before the first write."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "buckets": self.buckets, "cells": {}}
        if version is not None and version not in known:
            raise ValueError(f"No version {version} at {self.root}")
        found = json.loads(self.files.read(self._version_file(max(known) if version is None else version)))
        if found["buckets"] != self.buckets or found["layout"] != list(self.layout):
            raise ValueError(f"{self.root} has {found['buckets']} buckets laid out by {found['layout']}")
        return found

    def _version_file(self, version: int) -> str:
        return f"{self.root}/versions/{version:08d}.json"

    def bucket(self, *columns: Column) -> Column:
        """The bucket of a row; without columns, by those of ``spread``."""
        return F.pmod(F.xxhash64(*(columns or map(F.col, self.spread))), F.lit(self.buckets)).cast("int")

    def _cell(self) -> Column:
        place = F.md5(F.to_json(F.struct(*self.layout), {"ignoreNullFields": "false"})) if self.layout else F.lit("all")
        return F.concat_ws("-", place, F.lpad(self.bucket().cast("string"), 5, "0"))

    # --- reading -----------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None, where: dict[str, object] | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a snapshot. ``where`` (values of layout columns) and ``buckets`` choose the cells that are opened at all."""
        snapshot = self.snapshot(version)
        if snapshot["schema"] is None:
            raise ValueError(f"Nothing is stored at {self.root}")
        cells = snapshot["cells"].values()
        if where:
            cells = [c for c in cells if all(c["at"][k] == _plain(v) for k, v in where.items())]
        if buckets is not None:
            cells = [c for c in cells if c["bucket"] in buckets]
        return self._open(snapshot, cells)

    def _open(self, snapshot: dict, cells) -> DataFrame:
        schema = StructType.fromJson(snapshot["schema"])
        folders = sorted(f"{self.root}/{c['folder']}" for c in cells)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(self.lenient).lower()).parquet(*folders)

    def lookup(self, candidates: DataFrame, value: str, version: int | None = None) -> DataFrame:
        """Candidates with ``stored_value`` and ``hit``; only buckets that hold a candidate's key are opened."""
        snapshot = self.snapshot(version)
        if snapshot["schema"] is None:
            kind = dict(candidates.dtypes).get(value, "double")
            return candidates.withColumns({"stored_value": F.lit(None).cast(kind), "hit": F.lit(False)})
        wanted = {r[0] for r in candidates.select(self.bucket()).distinct().collect()}  # at most ``buckets`` rows
        stored = self.read(snapshot["version"], buckets=wanted).select(*(F.col(k).alias(f"_s_{k}") for k in self.keys), F.col(value).alias("stored_value"), F.lit(True).alias("hit"))
        same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in self.keys]
        joined = candidates.join(stored, same, "left").drop(*(f"_s_{k}" for k in self.keys))
        return joined.withColumn("hit", F.coalesce("hit", F.lit(False)))

    # --- writing -----------------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, version: str) -> int:
        """Insert rows or replace those of equal keys; of equal keys in ``rows`` the highest ``version`` counts (ties: the highest hash)."""
        columns = [F.col(c) for c in rows.columns]
        newest = F.max_by(F.struct(*columns), F.struct(version, F.xxhash64(*columns)))
        once = rows.groupBy(*self.keys).agg(newest.alias("row")).select("row.*")  # combined before the shuffle, so a hot key is one row
        return self._write(once, self.keys)

    def replace(self, rows: DataFrame) -> int:
        """Put in place of the stored rows of each key that ``rows`` has; other keys stay."""
        return self._write(rows, self.keys)

    def _write(self, rows: DataFrame, keys: list[str]) -> int:
        before = self.snapshot()
        schema = rows.schema
        stage = f"data/{uuid.uuid4().hex}"
        self._put(rows, stage)
        staged = self._cells_in(stage)
        held = {c: before["cells"][c] for c in staged if c in before["cells"]}
        if held:
            fresh = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/{stage}/{CELL}={c}" for c in sorted(held)))
            old = self._open(before, held.values())
            missing = [f for f in StructType.fromJson(before["schema"]).fields if f.name not in schema.names]
            fresh = fresh.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
            gone = fresh.select(*(F.col(k).alias(f"_n_{k}") for k in keys)).distinct()
            kept = old.join(gone, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys], "left_anti")
            merged = fresh.unionByName(kept, allowMissingColumns=True)
            schema, place = merged.schema, f"data/{uuid.uuid4().hex}"
            self._put(merged, place)
        elif before["schema"] is not None:
            extra = [f for f in StructType.fromJson(before["schema"]).fields if f.name not in schema.names]
            schema = StructType(schema.fields + extra)
        cells = dict(before["cells"])
        at = self._layout_of(stage, staged)
        for c in staged:
            cells[c] = {"folder": f"{place if c in held else stage}/{CELL}={c}", "bucket": int(c.rsplit("-", 1)[1]), "at": at[c]}
        return self._publish({"version": before["version"] + 1, "schema": json.loads(schema.json()), "buckets": self.buckets, "layout": list(self.layout), "cells": cells})

    def _publish(self, snapshot: dict) -> int:
        """Move the pointer: from here on readers see the new version."""
        if not self.files.create(self._version_file(snapshot["version"]), json.dumps(snapshot)):
            raise LostRace(f"version {snapshot['version']} of {self.root}")
        return snapshot["version"]

    def _put(self, rows: DataFrame, place: str) -> None:
        sort = [CELL, *(c for c in self.order if c in rows.columns)]
        dealt = rows.withColumn(CELL, self._cell()).repartitionByRange(*sort).sortWithinPartitions(*sort)
        writer = dealt.write.partitionBy(CELL).option("compression", "zstd")
        for c in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{place}")

    def _cells_in(self, place: str) -> list[str]:
        return [n.split("=", 1)[1] for n in self.files.names(f"{self.root}/{place}") if n.startswith(f"{CELL}=")]

    def _layout_of(self, place: str, cells: list[str]) -> dict[str, dict]:
        if not self.layout or not cells:
            return {c: {} for c in cells}
        rows = self.spark.read.parquet(f"{self.root}/{place}").groupBy(CELL).agg(*(F.first(c).cast("string").alias(c) for c in self.layout)).collect()  # a row for each cell
        return {r[CELL]: {c: r[c] for c in self.layout} for r in rows}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Keep the newest ``keep`` versions; remove other versions' files and data folders that no kept one names. No write may be under way."""
        known = self.versions()
        kept, old = known[-keep:], known[:-keep]
        named = {c["folder"].split("/")[1] for v in kept for c in self.snapshot(v)["cells"].values()}
        for v in old:
            self.files.remove(self._version_file(v))
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in named]
        for n in gone:
            self.files.remove(f"{self.root}/data/{n}")
        return gone


def _plain(value: object) -> str | None:
    return None if value is None else str(value)
