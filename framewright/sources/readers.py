"""Readers: images with metadata, CSV and JSON tables with declared schemas, and tolerant or strict record logs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.exif import metadata
from framewright.operators.ordered import ranged, with_running_sums
from framewright.staging import stage

# File endings that count as images.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")

INDEX_BUCKETS = 64  # of a key-value index


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative_path, size_bytes, modified of the images under folder; sidecar files (._*) are skipped.

    Only listings are read: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.substring_index("path", "/", -1)
    ok = F.lower(F.substring_index(name, ".", -1)).isin(*IMAGE_ENDINGS) & name.contains(".") & ~name.startswith("._")
    root = folder.rstrip("/").split("://")[-1]
    after = F.substring_index("path", root + "/", -1)
    return files.where(ok).select("path", after.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def file_system(uri: str) -> tuple:
    """The file system of a URI or path, of those that Arrow knows, and the path in it."""
    from pyarrow import fs

    plain = "file://" + uri.removeprefix("file:").removeprefix("//") if uri.startswith(("file:", "/")) else uri
    return fs.FileSystem.from_uri(quote(plain, safe=":/%"))


def file_bytes(uri: str) -> bytes:
    """A file's bytes, read where this is called, from any file system that Arrow knows."""
    where, path = file_system(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def image_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, width, height, orientation, timestamp, metadata_error of every image under folder.

    A file that can't be understood has its error and no timestamp.
    """
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    ok = F.lower(F.substring_index(name, ".", -1)).isin(*IMAGE_ENDINGS) & ~name.startswith("._")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([metadata(bytes(c)) for c in pdf.content], columns=["width", "height", "orientation", "timestamp", "metadata_error"])
            yield pd.concat([pdf[["path", "sha256"]].reset_index(drop=True), found.astype({"width": "Int64", "height": "Int64", "orientation": "Int64"})], axis=1)

    rows = images.where(ok).select("path", F.sha2("content", 256).alias("sha256"), "content")
    out = rows.mapInPandas(run, "path string, sha256 string, width int, height int, orientation int, timestamp string, metadata_error string")
    return out.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is an array of rows; such a document is one task's work, so it suits lists, not corpora."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, also gzipped, empty meaning NULL. The schema goes by place, so a byte order mark can't matter."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("nullValue", "").csv(path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log with line__, which rises along a file and from file to file in the order of their times of change.

    A log is a file, or a folder to which each append adds files; those of one append don't hold a key twice.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    return lines.where(F.trim("value") != "").select("value", F.struct("at", "file", "n").alias("line__"))


def record_log(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, tail) of an append-only JSON log: the last record per key before the first broken line, and the lines from there on.

    The tail is what an interrupted writer left, for a backup before the log is cut.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken__"}
    parsed = _numbered(spark, path).select("value", "line__", F.from_json("value", f"{schema}, broken__ string", options).alias("r"))
    broken = parsed.where("r is null or r.broken__ is not null")
    first = broken.agg(F.min("line__").alias("stop"))
    marked = parsed.crossJoin(F.broadcast(first))  # one row
    good = marked.where("stop is null or line__ < stop").select("r.*", "line__").drop("broken__")
    last = good.groupBy(key).agg(F.max_by(F.struct(*[c for c in good.columns if c != "line__"]), "line__").alias("x")).select("x.*")
    tail = marked.where("line__ >= stop").select("value", "line__")
    return last, tail


def broken_bytes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, offset: for each file of a log that has a broken line, the byte at which the first such line begins.

    A line's byte is what all earlier lines of its file take up, with their line ends; lines are ordered by the place of
    their split in the file, in ranges, so that a long file isn't one task.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken__"}
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    r = F.from_json("value", f"{schema}, broken__ string", options)
    broken = (F.trim("value") != "") & (r.isNull() | r["broken__"].isNotNull())
    rows = ranged(lines.select("file", "split", "n", (F.octet_length("value") + 1).cast("long").alias("bytes"), broken.alias("broken")), ["file"], ["split", "n"])
    placed = with_running_sums(rows, ["file"], ["split", "n"], {"through": F.col("bytes")})
    return placed.where("broken").groupBy("file").agg(F.min(F.col("through") - F.col("bytes")).alias("offset"))


def recover_log(spark: SparkSession, path: str, schema: str, backup: str) -> list:
    """Cuts each file of a log at its first broken byte, after its tail was copied to backup; (file, offset, bytes) of the cuts.

    What an interrupted writer left can't be read, and records after it would be read out of order, so both go aside: the
    frames of the tail have no record and are worked on again. Each file is cut by a task; a cut is repeated safely, as
    the tail's copy is there before the file is replaced.
    """
    found = broken_bytes(spark, path, schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, offset in zip(pdf.file, pdf.offset, strict=True):
                where, name = file_system(file)
                out, aside = file_system(f"{backup}/{name.rsplit('/', 1)[-1]}.tail")
                out.create_dir(aside.rsplit("/", 1)[0], recursive=True)
                size = 0
                with where.open_input_file(name) as f, out.open_output_stream(aside) as tail:
                    f.seek(int(offset))
                    while part := f.read(1 << 20):
                        tail.write(part)
                        size += len(part)
                with where.open_input_file(name) as f, where.open_output_stream(name + ".cut") as head:
                    left = int(offset)
                    while left > 0 and (part := f.read(min(left, 1 << 20))):
                        head.write(part)
                        left -= len(part)
                folder, base = name.rsplit("/", 1)
                where.move(name + ".cut", name)
                sums = f"{folder}/.{base}.crc"  # a checksum of the whole file, as local writers leave
                if where.get_file_info(sums).is_file:
                    where.delete_file(sums)
                rows.append((file, int(offset), size))
            yield pd.DataFrame(rows, columns=["file", "offset", "bytes"])

    return stage(found).mapInPandas(cut, "file string, offset long, bytes long").collect()  # the torn files


def strict_log(spark: SparkSession, path: str, schema: str, key: str, known: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """The records of a log, or an error: for a broken line, a repeated key, or a key that known doesn't hold.

    Where completeness isn't asked for, one broken last line is passed over. The log is parsed once, and staged.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken__"}
    parsed = stage(_numbered(spark, path).select("line__", F.from_json("value", f"{schema}, broken__ string", options).alias("r")))
    broken = F.col("r").isNull() | F.col("r.broken__").isNotNull()
    state = parsed.agg(F.count_if(broken).alias("broken"), F.max(F.when(broken, F.col("line__"))).alias("at"), F.max("line__").alias("last")).first()
    if state.broken and (complete or state.broken > 1 or state["at"] != state.last):
        raise ValueError(f"{state.broken} broken lines in the record log; keep the file and find the damage first")
    records = parsed.where(~broken).select("r.*").drop("broken__")
    if (twice := records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()):
        raise ValueError(f"record {twice[0][key]} is repeated")
    if known is not None and (odd := records.join(known.select(key), key, "left_anti").limit(1).collect()):
        raise ValueError(f"record {odd[0][key]} is unknown")
    return records


def bucket_of(key: Column | str, buckets: int = INDEX_BUCKETS) -> Column:
    """The bucket of a key in a key-value index."""
    return F.pmod(F.xxhash64(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(buckets)).cast("int")


def index_lookup(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key of an index that writers.upsert wrote: only its bucket's files are read."""
    return spark.read.parquet(path).where((F.col("bucket__") == bucket_of(F.lit(value))) & (F.col(key) == value)).drop("bucket__")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: the filter reaches the Parquet scan."""
    return table.where(F.col(key) == value)


def first_rows(df: DataFrame, number: int, *order: str) -> DataFrame:
    """The first rows by an explicit order."""
    return df.orderBy(*order).limit(number)


def places(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with place: the number within the group, from 0, for groups of listing size."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
