"""Writers: tables as CSV, gzip, Parquet and JSON lines, manifests, and the sheets and curves of a report as tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.integrity import table_differences
from framewright.sources.readers import bucket_of
from framewright.staging import discard, stage

ONE_CSV_ROWS = 100_000
# File endings that a delivery manifest lists.
DELIVERED = ("csv", "gz", "json", "jsonl", "md", "parquet", "pdf", "png", "svg", "xlsx")


def to_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """CSV with a header and NULL as nothing; written by all tasks, one file each."""
    df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def to_one_csv(df: DataFrame, path: str) -> None:
    """A small report table as one UTF-8 CSV with a byte order mark, for spreadsheets; more than ONE_CSV_ROWS are an error."""
    rows = df.limit(ONE_CSV_ROWS + 1).toPandas()
    if len(rows) > ONE_CSV_ROWS:
        raise ValueError(f"{path} would have more than {ONE_CSV_ROWS} rows; write it with to_csv")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def upsert(df: DataFrame, path: str, key: str, order: str) -> None:
    """A key-value index as Parquet in buckets of the key's hash: the last record of each key, by order.

    Only the buckets that df touches are read, merged and replaced, each as a whole when the job commits; all others stay.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    new = df.withColumn("bucket__", bucket_of(key))
    everything = new
    if there:
        touched = new.select("bucket__").distinct()  # INDEX_BUCKETS numbers at most
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(touched), "bucket__", "left_semi")
        everything = old.unionByName(new)
    rest = [c for c in df.columns if c not in (key, order)]
    last = everything.groupBy("bucket__", key).agg(F.max_by(F.struct(order, *rest), order).alias("r")).select(key, "r.*", "bucket__")
    merged = stage(last)  # read to its end before anything is replaced
    merged.repartition("bucket__").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket__").parquet(path)
    discard(merged)


def append_records(df: DataFrame, path: str) -> None:
    """JSON lines added to a log."""
    df.write.mode("append").json(path)


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def manifest(spark: SparkSession, folder: str, exclude: str = "manifest.json") -> DataFrame:
    """path, bytes and sha256 of the deliverable files under folder, without the manifest itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    wanted = files.where(F.lower(F.substring_index(name, ".", -1)).isin(*DELIVERED) & (name != exclude))
    root = folder.rstrip("/").split("://")[-1] + "/"
    return wanted.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def labelled(df: DataFrame, names: dict[str, str], values: dict[str, dict[str, str]] | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """A table for readers: long numbers as text, values relabelled, columns renamed."""
    for c in texts:
        df = df.withColumn(c, F.col(c).cast("string"))
    for c, mapping in (values or {}).items():
        df = df.replace(mapping, subset=[c])
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def spreadsheet(df: DataFrame) -> DataFrame:
    """A table as a sheet can hold it: what is neither a number, a text nor a truth value becomes text."""
    simple = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string"}
    return df.select(*[F.col(f"`{c}`") if kind in simple else F.col(f"`{c}`").cast("string").alias(c) for c, kind in df.dtypes])


def delivery_sheets(primary: dict[str, DataFrame], candidate: dict[str, DataFrame], others: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sheets of a delivery's workbook, one table each: both sets of statistics, the others, and the fields of all."""
    out = dict(others)
    for status, own in (("primary", primary), ("candidate", candidate)):
        out |= {f"{status} {name}": df for name, df in sheets(own["bins"], own["splices"], own["totals"], own["gaps"]).items()}
    some = next(iter(out.values()))
    return out | {"fields": some.sparkSession.createDataFrame(fields(out), "sheet string, field string, kind string")}


def sheets(bins: DataFrame, splices: DataFrame, totals: DataFrame, gaps: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a statistics workbook, one table each: bins by step and axis, splices, gaps and totals."""
    out = {"totals": totals, "splices": splices, "gaps": gaps}
    for axis in ("effective", "actual"):
        for step in (300, 3600):
            out[f"bins {step} s {axis}"] = bins.where((F.col("axis") == axis) & (F.col("window_seconds") == step))
    return out


def curve(bins: DataFrame, axis: str, step: int) -> DataFrame:
    """What a curve plots: the middle hour and both means of the bins with observed time."""
    own = bins.where((F.col("axis") == axis) & (F.col("window_seconds") == step) & (F.col("observed_seconds") > 0))
    return own.select("grp", ((F.col("start_hour") + F.col("end_hour")) / 2).alias("hour"), "left_mean", "right_mean")


def curve_limit(bins: DataFrame) -> DataFrame:
    """The upper end of a curve's scale per group: the larger of both sides' largest means, NULLs skipped."""
    return bins.groupBy("grp").agg(F.greatest(F.max("left_mean"), F.max("right_mean")).alias("highest"))


def heatmap(bins: DataFrame) -> DataFrame:
    """Hourly shares in percent per group and side on the effective axis."""
    own = bins.where("axis = 'effective' and window_seconds = 3600")
    cells = F.array(*[F.struct(F.lit(s).alias("side"), (F.col(f"{s}_share") * 100).alias("percent")) for s in ("left", "right")])
    return own.select("grp", "start_hour", "end_hour", F.explode(cells).alias("c")).select("grp", "start_hour", "end_hour", "c.*")


def fields(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, kind) of every column: the dictionary of a delivery."""
    return [(name, c, kind) for name, df in tables.items() for c, kind in df.dtypes]


def sheet_differences(written: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """What a sheet, read back from its CSV, has other than the table that it shows; missing values must stay missing."""
    again = df.sparkSession.read.schema(df.schema).option("header", "true").option("enforceSchema", "true").option("nullValue", "").csv(written)
    return table_differences(again, df, keys)


def markdown(rows: list[dict], columns: dict[str, str]) -> str:
    """A Markdown table of a few rows; columns maps names to formats."""
    show = lambda v, pattern: "-" if v is None else format(v, pattern)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(show(r[c], f) for c, f in columns.items()) + " |" for r in rows]])


def delivery_report(summary: list[dict], metrics: list[dict], totals: list[dict], accepted: list[str]) -> str:
    """The report of a delivery: scope, validation, rules of time, totals and files."""
    scope = {"grp": "", "n": ",", "elapsed_hours": ".3f", "potentially_observed_hours": ".3f", "timestamp_duplicates": ",", "metadata_errors": ","}
    checks = {"grp": "", "side": "", "usable_reference_sides": ",", "mae": ".2f", "within_two_fraction": ".1%"}
    sums = {"grp": "", "n_images": ",", "effective_hours": ".2f", "left_mean": ".3f", "right_mean": ".3f", "left_share": ".1%"}
    return "\n\n".join(
        [
            "# Occupancy report",
            f"Accepted groups: {', '.join(accepted) or 'none'}. Counts of all others are published as candidates only, and their primary counts are missing, not 0.",
            "## Scope", markdown(summary, scope),
            "## Validation", markdown(metrics, checks) if metrics else "No reference counts were given, so nothing is validated.",
            "## Time", "Only steps between two adjacent usable images that are positive and short enough are integrated, by trapezoids. Gaps have no value and no integral crosses them.",
            "## Totals of accepted groups", markdown(totals, sums),
            "## Files", "`data/frames`: a row an image. `data/coordinates`: a row a detection. `data/primary`, `data/candidate`: statistics of accepted groups and of all. `data/sheets`: the tables of a workbook. `manifest.csv`: size and hash of every file.",
        ]
    ) + "\n"


READ_FIRST = """# Read first

Groups that haven't passed validation have candidates only: look at `data/candidate` for where counts change and what to
review, and don't draw conclusions from it. A count that is missing is unknown; it is never 0 and never copied from
another image. `report.md` says which groups were accepted. Original images are never changed.
"""
REPRODUCE = """# To reproduce

    python -m framewright.plans.workflow run --workspace DIR --scenes SCENES.npz
    python -m framewright.plans.workflow verify --workspace DIR
    python -m framewright.plans.workflow export --workspace DIR --accepted A,B

`run` counts what has no record yet and may be stopped at any time. All commands check the recorded hashes of the
detector's files; other files are another detector and need a new workspace and a new validation. Statistics of stored
counts alone: `replot --frames TABLE --output DIR`.
"""


def report(totals: list[dict]) -> str:
    """A Markdown report of the totals, a few rows."""
    lines = ["# Occupancy report", "", "| group | images | hours | left mean | right mean | left share |", "|---|---:|---:|---:|---:|---:|"]
    show = lambda v, pattern: "-" if v is None else format(v, pattern)
    for r in totals:
        lines.append(f"| {r['grp']} | {r['n_images']:,} | {show(r['effective_hours'], '.2f')} | {show(r['left_mean'], '.3f')} | {show(r['right_mean'], '.3f')} | {show(r['left_share'], '.1%')} |")
    return "\n".join(lines) + "\n"
