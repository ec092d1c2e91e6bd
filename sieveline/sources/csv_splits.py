"""Large CSV files whose quoted cells span lines, read by many tasks.

A byte range alone does not tell whether it starts inside a quoted cell, but the number of quotes
before it does: an odd number means inside. Each task counts the quotes of its ranges, one running
sum over the ranges of a file gives the state at their starts, and lines then join into records.

Tasks go through their lines as the scan gives them and hold one batch and one record. Records that
begin and end in a range are put together where they are read; only what crosses a range is shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.session import shared_folder

OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}
RANGE = ["_file", "_range"]
# Where a line ends; what stands before it belongs to the line.
BREAK = "\n"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of the scan, with their file, the start of the byte range they begin in and their quotes."""
    lines = spark.read.text(path, lineSep=BREAK).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.col("value").alias("_text")
    )
    quotes = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit('"'), F.lit("")))
    return lines.withColumns({"_quotes": quotes, "_empty": F.col("_text").isin("", "\r")})


def _spans(*columns: pa.Array) -> list[tuple[int, int]]:
    """Stretches of rows in which no column changes."""
    n = len(columns[0])
    if n == 0:
        return []
    edges = {i + 1 for c in columns for i in np.flatnonzero(pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)).tolist()}
    cuts = [0, *sorted(edges), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: its quotes, whether its first line ends in a carriage return, and the records that
    begin in it if it starts outside and inside a cell. A range is read by one task, line after line."""
    held = None
    for batch in batches:
        files, starts = batch.column("_file"), batch.column("_range")
        quotes, full = batch.column("_quotes").to_numpy(), ~batch.column("_empty").to_numpy(zero_copy_only=False)
        for a, b in _spans(files, starts):
            key = (files[a].as_py(), starts[a].as_py())
            if held is None or held[0] != key:
                if held is not None:
                    yield _count_row(held)
                held = [key, batch.column("_return")[a].as_py(), 0, 0, 0]
            outside = (held[2] + np.cumsum(quotes[a:b]) - quotes[a:b]) % 2 == 0
            held[2] += int(quotes[a:b].sum())
            held[3] += int((full[a:b] & outside).sum())
            held[4] += int((full[a:b] & ~outside).sum())
    if held is not None:
        yield _count_row(held)


def _count_row(held: list) -> pa.RecordBatch:
    (file, start), *rest = held
    columns = dict(zip(["_file", "_range", "_returns", "_quotes", "_if_outside", "_if_inside"], ([v] for v in (file, start, *rest))))
    return pa.RecordBatch.from_pydict(columns, COUNTED)


COUNTED = pa.schema([("_file", "string"), ("_range", "int64"), ("_returns", "bool"), ("_quotes", "int64"), ("_if_outside", "int64"), ("_if_inside", "int64")])


def _pieces(whole: bool):
    """``_id, _nth, _text``: the records of each range, numbered by their beginnings in it.

    ``whole`` gives those that begin in a range and are followed by another there; otherwise what
    stands before the first beginning of a range (number 0) and its last record, which may go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, inside, nth, open_lines = None, 0, 0, []
        for batch in batches:
            ids, texts = batch.column("_id"), batch.column("_text")
            quotes, empty = batch.column("_quotes").to_numpy(), batch.column("_empty").to_numpy(zero_copy_only=False)
            out = []
            for a, b in _spans(ids):
                if ids[a].as_py() != ranges:
                    if open_lines and not whole:
                        out.append((ranges, nth, BREAK.join(open_lines)))
                    ranges, inside, nth, open_lines = ids[a].as_py(), int(batch.column("_inside")[a].as_py()), 0, []
                outside = (inside + np.cumsum(quotes[a:b]) - quotes[a:b]) % 2 == 0
                inside += int(quotes[a:b].sum())
                begins = outside & ~empty[a:b]
                kept = np.flatnonzero(begins | ~outside)
                for i, text in zip(kept.tolist(), texts.slice(a, b - a).take(pa.array(kept))):
                    if begins[i]:
                        # Lines before the first beginning belong to the last record that began in an earlier range.
                        if open_lines and (nth > 0) == whole:
                            out.append((ranges, nth, BREAK.join(open_lines)))
                        nth, open_lines = nth + 1, []
                    open_lines.append(text.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ("int64", "int64", "string"))], ["_id", "_nth", "_text"])
        if open_lines and not whole:
            yield pa.RecordBatch.from_pydict({"_id": [ranges], "_nth": [nth], "_text": [BREAK.join(open_lines)]})

    return run


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range: the quotes and the records before it in its file, the rows of earlier files, the file's line end."""
    counts = lines.select(*RANGE, "_quotes", "_empty", F.endswith("_text", F.lit("\r")).alias("_return")).mapInArrow(
        _counted, "_file string, _range long, _returns boolean, _quotes long, _if_outside long, _if_inside long"
    )
    earlier = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    state = counts.withColumn("_file_quotes", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)))
    begun = state.withColumn("_records", F.when(F.col("_file_quotes") % 2 == 0, F.col("_if_outside")).otherwise(F.col("_if_inside")))
    placed = begun.drop("_returns").withColumn("_in_file", F.coalesce(F.sum("_records").over(earlier), F.lit(0)))
    # The first record of a file is its header and has no number.
    # A file whose first line ends in a carriage return and a line feed has that as its line end, in cells too.
    files = begun.groupBy("_file").agg(
        F.greatest(F.sum("_records") - 1, F.lit(0)).alias("_n"), F.min_by("_returns", "_range").alias("_returns")
    )
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", "_returns", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    numbered = placed.withColumn("_id", F.row_number().over(Window.orderBy(*RANGE)).cast("long"))
    return numbered.join(files, "_file").select("_id", *RANGE, (F.col("_file_quotes") % 2 == 1).alias("_inside"), "_in_file", "_earlier", "_returns")


def csv_records(spark: SparkSession, path: str, number: str = "_number") -> DataFrame:
    """Rows of CSV files with a header, all columns as text, and their 0-based number in file order.

    Rows equal those of the one-task reader for files as RFC 4180 has them, a quote inside a cell
    standing in a quoted cell and doubled. All files have the columns of the first. Empty lines
    between records are no rows. A record is put together in one task; nothing larger is. The table of
    ranges, a row for as many bytes as a scan task reads at once, is written and goes to all tasks.
    """
    lines = _lines(spark, path)
    ranges, folder = _ranges(lines), shared_folder(spark, "csv-ranges")
    ranges.write.parquet(folder)
    ranges = spark.read.schema(ranges.schema).parquet(folder)
    # The order of the scan stays: lines meet a broadcast table only.
    told = lines.join(F.broadcast(ranges.select("_id", *RANGE, "_inside")), RANGE).select("_id", "_inside", "_quotes", "_empty", "_text")
    place = (F.col("_in_file") + F.col("_nth")).alias("_place")

    def placed(whole: bool) -> DataFrame:
        pieces = told.mapInArrow(_pieces(whole), "_id long, _nth long, _text string")
        return pieces.join(F.broadcast(ranges.drop("_inside")), "_id").select("_file", "_range", "_earlier", "_returns", place, "_text")

    same = [F.first(c).alias(c) for c in ("_earlier", "_returns")]
    met = placed(False).groupBy("_file", "_place").agg(*same, F.sort_array(F.collect_list(F.struct("_range", "_text"))).alias("_pieces"))
    met = met.withColumn("_text", F.array_join(F.transform("_pieces", lambda p: p["_text"]), BREAK))
    records = placed(True).drop("_file", "_range").unionByName(met.drop("_file", "_pieces"))
    joined = F.regexp_replace("_text", r"\r\z", "")
    whole = F.when(F.col("_returns"), F.replace(joined, F.lit("\r\n"), F.lit("\n"))).otherwise(joined)
    columns = spark.read.options(header=True, **OPTIONS).csv(path).columns
    cells = F.from_csv(whole, ", ".join(f"`{c.replace('`', '``')}` string" for c in columns), OPTIONS)
    rows = records.where("_place > 1").select((F.col("_earlier") + F.col("_place") - 2).alias(number), cells.alias("_row"))
    return rows.select(number, "_row.*")
