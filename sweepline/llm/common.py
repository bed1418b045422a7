"""Helpers shared by the corpus operators: tables, shared storage, Arrow maps, distinct words of a batch."""

from __future__ import annotations

import ctypes
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import open_folder, shared_folder

#: A word: a run of characters that are not ASCII white space.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new place in the folder that driver and executors share; removed with the session unless it is to be kept."""
    return shared_folder(spark, tag, keep)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


open_fs = open_folder


def freeing(outs: Iterator) -> Iterator:
    """The same; after the last one a task's freed memory goes back to the system. Else idle Python workers hold on to what their largest
    task took, beside the JVM, through all later stages."""
    yield from outs
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over plain Python columns; ``fn`` gets and gives dicts of column lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for out in freeing(fn(columns)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def in_slices(batches: Iterator[dict[str, list]], text: str = "text", chars: int = 8_000_000) -> Iterator[dict[str, list]]:
    """Cut batches so that a slice holds about ``chars`` characters: memory then doesn't depend on the longest texts."""
    for batch in batches:
        names, start, size = list(batch), 0, 0
        for i, value in enumerate(batch[text]):
            size += len(value or "")
            if size >= chars:
                yield {n: batch[n][start : i + 1] for n in names}
                start, size = i + 1, 0
        if start < len(batch[text]):
            yield {n: batch[n][start:] for n in names}


def arrow_slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < len(batch):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def distinct_words(texts: pa.Array, pattern: str | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in turn, first word of each text and the end) of a batch of texts.

    Words stand between runs of ``pattern`` (RE2), or of ASCII white space without one. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts) if pattern is None else pc.split_pattern_regex(texts, pattern=pattern)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:  # at the ends of a text
        seen = codes != blank
        offsets = np.concatenate([[0], np.cumsum(seen)])[offsets]
        codes = codes[seen]
        codes = codes - (codes > blank)
        words = pc.filter(words, pc.not_equal(words, ""))
    return words, codes, offsets


class _Numbered(dict):
    """Value -> its number in order of appearance."""

    def __missing__(self, value):
        self[value] = found = len(self)
        return found


def numbered(lists: list[list[str]]) -> tuple[list[str], np.ndarray, list[int]]:
    """(distinct values, number of each value in turn, first value of each list and the end)."""
    ends = [0, *itertools.accumulate(map(len, lists))]
    numbers = _Numbered()
    codes = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(lists)), np.int32, ends[-1])
    return list(numbers), codes, ends


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``values``; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches ``which`` of ``flat`` in a row, and their ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function gives dicts of columns (lists or arrays)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in freeing(fn(batches)):
            columns = (out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow_schema)
            yield pa.RecordBatch.from_arrays(list(columns), schema=arrow_schema)

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(rows: DataFrame, table_: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table_`` (one row a key) on ``key``; column ``n`` of it says how many rows a key has.

    Keys with over 1 / ``share`` of the ``total`` rows, of which there are fewer than ``share``, are joined by broadcast and their rows
    stay where they are, so no task gets all rows of a key; the others are joined by a shuffle.
    """
    is_hot = F.col(n) * share > total
    hot, cool = table_.filter(is_hot), table_.filter(~is_hot)
    often = F.broadcast(hot)  # fewer than ``share`` rows
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(cool, key))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0 (null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
