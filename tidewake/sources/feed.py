"""Daily position files: plain CSV with true line numbers, and zip archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import FEED_COLUMNS


def read_lines(spark: SparkSession, path: str, source_file: str | Column | None = None) -> DataFrame:
    """source_file, source_line (the header is line 1), raw_text and fields of every data row.

    Files are read as text, so they stay splittable. A line's number is its place in its split plus the lines of the
    splits before it, from one count per split; only those counts meet. source_file is the last part of the path unless a
    name, or a Column over `path`, is given.
    """
    text = spark.read.text(path).select(F.col("value").alias("raw_text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = text.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    lines = text.join(starts, ["path", "block"]).withColumn("source_line", F.col("id") - F.col("first") + F.col("before") + 1)
    if source_file is None:
        source_file = F.element_at(F.split("path", "/"), -1)
    name = F.lit(source_file) if isinstance(source_file, str) else source_file
    return with_fields(lines.where("source_line > 1 AND raw_text <> ''").select(name.alias("source_file"), "source_line", "raw_text"))


def with_fields(lines: DataFrame) -> DataFrame:
    """Adds fields: the line's values, quoted commas honoured. The number of fields is the line's own, not the header's."""
    found = F.regexp_extract_all(F.concat("raw_text", F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    plain = F.split("raw_text", ",", -1)
    unquoted = F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return lines.withColumn("fields", F.when(F.contains("raw_text", F.lit('"')), unquoted).otherwise(plain))


def unpack_zips(spark: SparkSession, path: str, staging: str) -> DataFrame:
    """Writes the first CSV entry of each archive as text rows to staging, and returns their lines; rows carry the entry's name, runs the archive's.

    Only names and lengths of the archives pass through Spark. A task opens its archive where it lies as a stream that can
    be sought in, so it holds a buffer of the archive and a block of lines, however long either is. In a store that
    only Spark's readers reach, archives come as cells instead, of 2 GB at most. A packed entry can't be split, so one
    task reads it; what it has written is split as any table.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("archive")
    first = files.select("path").first()
    streams = first is not None and _reachable(first["path"])
    parts = files.select(name, F.col("path").alias("place")) if streams else files.select(name, F.col("content").alias("place"))
    parts.repartition("archive").mapInArrow(_unpack, "archive string, source_file string, source_line long, raw_text string").write.mode("overwrite").parquet(staging)
    return with_fields(spark.read.parquet(staging))


def _open(uri: str):
    """A file of a store that pyarrow knows, to be read from any place in it."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    return store.open_input_file(place)


def _reachable(uri: str) -> bool:
    try:
        _open(uri).close()
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _unpack(batches: Iterator[pa.RecordBatch], block: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Lines of the first CSV entry of each archive, by its place or its content."""
    for batch in batches:
        for archive, place in zip(batch.column(0).to_pylist(), batch.column(1)):
            with _open(place.as_py()) if pa.types.is_string(place.type) else BytesIO(place.as_py()) as raw, zipfile.ZipFile(raw) as z:
                entry = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                if entry is None:
                    continue
                with z.open(entry) as f:
                    numbers: list[int] = []
                    texts: list[str] = []
                    for no, line in enumerate(f, 1):
                        text = line.decode("utf-8-sig" if no == 1 else "utf-8", "replace").rstrip("\r\n")
                        if no > 1 and text:
                            numbers.append(no)
                            texts.append(text)
                        if len(texts) == block:
                            yield _rows(archive, entry, numbers, texts)
                            numbers, texts = [], []
                    if texts:
                        yield _rows(archive, entry, numbers, texts)


def _rows(archive: str, entry: str, numbers: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive] * len(texts)), pa.array([entry] * len(texts)), pa.array(numbers, pa.int64()), pa.array(texts)], names=["archive", "source_file", "source_line", "raw_text"])


def write_zips(lines: DataFrame, folder: str) -> int:
    """One archive for each source_file of (source_file, source_line, raw_text), with a header; the number of archives. Lines stream into the archive, in order.

    The folder must be one that pyarrow can write to.
    """
    header = "# " + ",".join(FEED_COLUMNS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place)
        current, out, z, f = None, None, None, None

        def close() -> None:
            if f is not None:
                f.close()
                z.close()
                out.close()

        names = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != current:
                    close()
                    current, out = name, store.open_output_stream(f"{place}/{name.rsplit('.', 1)[0]}.zip")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    f = z.open(name, "w", force_zip64=True)
                    f.write(header.encode() + b"\n")
                    names.append(name)
                f.write(text.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    sorted_lines = lines.select("source_file", "source_line", "raw_text").repartition("source_file").sortWithinPartitions("source_file", "source_line")
    return sorted_lines.select("source_file", "raw_text").mapInArrow(pack, "name string").count()


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """The feed by column name, all strings, with rows that do not fit in _corrupt; for looks at a file where line numbers play no part."""
    schema = ", ".join(f"`{'# ' if i == 0 else ''}{c}` string" for i, c in enumerate(FEED_COLUMNS)) + ", _corrupt string"
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
