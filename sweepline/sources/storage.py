"""Tables on storage: bars, results, summaries, run files, retention; the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import SnapshotTable

RESULTS_CSV = "collection string, symbol string, timeframe string, strategy string, metric string, metric_value string, params string, sharpe string, sortino string, omega string, tail_ratio string, profit string, pain_index string, trades string, max_drawdown string"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it isn't set, a local session gets a new folder and a cluster an error, as its
    executors see no folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_folder(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new place in the shared folder; unless it is to be kept, it is removed when the session's driver ends."""
    top = f"{shared_root(spark)}/sweepline-{tag}-{uuid.uuid4().hex}"
    if not keep:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{top}/data"


def open_folder(uri: str):
    """(file system, path) of a shared folder's address, for tasks that read or write files of their own."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def bars_store(spark: SparkSession, path: str, buckets: int = 16) -> SnapshotTable:
    """The stored bars: a cell for each source, timeframe and bucket of symbols, rows by symbol and time, a Bloom filter on the symbol."""
    return SnapshotTable(spark, path, ["source", "timeframe", "symbol"], layout=("source", "timeframe"), spread=["symbol"], order=["symbol", "ts"], buckets=buckets, bloom=("symbol",), lenient=True)


def bars_parquet_sink(bars: DataFrame, path: str, buckets: int = 16) -> int:
    """Each (source, timeframe, symbol) in ``bars`` takes the place of what was stored for it; all other series stay. Returns the version.

    The symbol is a value, not a file name, so A/B and A-B don't meet.
    """
    return bars_store(bars.sparkSession, path, buckets).replace(bars)


def bars_parquet_scan(spark: SparkSession, path: str, source: str, timeframe: str, symbols: list[str] | None = None, buckets: int = 16) -> DataFrame:
    """Bars of one source and timeframe: only their cells are opened, of given symbols only those symbols' buckets; within a file
    row groups are skipped by the symbol. Unreadable files count as missing."""
    store = bars_store(spark, path, buckets)
    of = None
    if symbols is not None:
        found = spark.createDataFrame([(s,) for s in symbols], "symbol string").select(store.bucket()).distinct().collect()
        of = {r[0] for r in found}
    rows = store.read(where={"source": source, "timeframe": timeframe}, buckets=of)
    rows = rows.filter((F.col("source") == source) & (F.col("timeframe") == timeframe))
    return rows.filter(F.col("symbol").isin(*symbols)) if symbols is not None else rows


def results_csv_sink(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def results_csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """Numbers that don't parse are null, NaN stays, params stay text; cagr and calmar aren't in the file."""
    rows = spark.read.schema(RESULTS_CSV).option("header", True).option("escape", '"').csv(path)
    numbers = ("metric_value", "sharpe", "sortino", "omega", "tail_ratio", "profit", "pain_index", "max_drawdown")
    parsed = rows.withColumns({c: F.col(c).try_cast("double") for c in numbers}).drop("trades")
    return parsed.withColumn("cagr", F.lit(None).cast("double")).withColumn("calmar", F.lit(None).cast("double"))


def json_lines_sink(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def retention_scan(spark: SparkSession, path: str, days: int, now) -> DataFrame:
    """(path, size, age_days) of files at least ``days`` old; only their metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    age = F.timestamp_diff("DAY", F.col("modificationTime"), F.lit(now).cast("timestamp"))
    return files.select("path", F.col("length").alias("size"), age.alias("age_days")).filter(F.col("age_days") >= days)


def retention_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
