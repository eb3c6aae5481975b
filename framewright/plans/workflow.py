"""The command line: a study from images to counts to statistics, with guards around what may be written where.

    python -m framewright.plans.workflow doctor
    ... init-new --config study.json --output DIR      a new study: configuration and reference template only
    ... prepare --images DIR --output DIR              inventory of images with groups by folder, and samples
    ... scenes --workspace DIR --places FILE --output FILE.npz   what the calibration images of each group show
    ... train --workspace DIR --points FILE --scenes FILE.npz    the machine of windows, from annotated samples
    ... run --workspace DIR                            counts images that have no record yet
    ... smoke --workspace DIR --limit N                counts the first N only
    ... verify --workspace DIR [--baseline TABLE]      completeness and agreement of the records
    ... export --workspace DIR                         gated frames, coordinates, statistics, manifest
    ... replot --frames TABLE --output DIR             statistics of stored counts
    ... review --workspace DIR --port N                a local page's server, corrections appended to a log

Expected failures are printed and end with status 1.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib.metadata
import importlib.util
import json
import logging
import platform
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import gates, integrity, inventory, occupancy, review, validation
from framewright.schemas import CHECKPOINT, SECOND, Settings
from framewright.sources import figures, readers, workbook, writers
from framewright.staging import discard, stage

TOOL = Path(__file__).resolve().parents[2]
MARKER = "study.json"
LOG = logging.getLogger(__name__)
CODE = [TOOL / "framewright" / f for f in ("functions/vision.py", "operators/counting.py", "operators/detections.py")]  # what a count depends on


def create_output(output: str, mode: str, sources: list[str] = ()) -> Path:
    """A fresh output folder with its mode's marker; never inside the tool or a source, never in a foreign folder that has files."""
    path = Path(output).resolve()
    for forbidden in [TOOL, *[Path(s).resolve() for s in sources]]:
        if path == forbidden or forbidden in path.parents:
            raise ValueError(f"{path} lies inside {forbidden}")
    marker = path / MARKER
    if path.exists() and any(path.iterdir()) and not (marker.exists() and json.loads(marker.read_text())["mode"] == mode):
        raise ValueError(f"{path} holds files of something else")
    path.mkdir(parents=True, exist_ok=True)
    if not marker.exists():
        writers.write_json({"mode": mode, "created_at": datetime.now(UTC).isoformat()}, str(marker))
    return path


def project(workspace: str, mode: str) -> dict:
    """The marker of a workspace, or an error if it is of another mode: a new study has no accepted detector to run."""
    marker = Path(workspace) / MARKER
    found = json.loads(marker.read_text()) if marker.exists() else {}
    if found.get("mode") != mode:
        raise ValueError(f"{workspace} isn't a {mode} workspace")
    return found


def doctor() -> dict:
    """What is installed, and whether that suffices for tables and for images."""
    has = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy", "cv2")}
    return {"python": platform.python_version(), "modules": has, "tables": all(has[m] for m in ("pyspark", "pyarrow", "pandas", "numpy")), "jpeg_images": has["cv2"], "png_images": has["numpy"]}


def init_new(config: str, output: str) -> Path:
    """A new study's specification. Whatever the configuration claims, nothing is accepted yet."""
    study = json.loads(Path(config).read_text())
    groups = study.get("groups", [])
    if study.get("profile") != "new-study":
        raise ValueError("the configuration's profile must be new-study")
    if not groups or len({g["id"] for g in groups}) != len(groups):
        raise ValueError("groups are missing or repeated")
    path = create_output(output, "new-study", [g["source_folder"] for g in groups])
    study |= {"validation_status": "pending", "historical_acceptance_inherited": False}
    writers.write_json(study, str(path / "data/new_study_config.json"))
    columns = "sample_id,frame_id,source_path,group,split,left_count,right_count,other_count,uncertain_count,reviewer,review_time,viewed_predictions_before_reference,countable,reason,coordinates_file"
    (path / "data/reference_template.csv").write_text("﻿" + columns + "\n", encoding="utf-8")
    return path


def prepare(spark: SparkSession, images: str, output: str, settings: Settings | None = None) -> Path:
    """Inventory of images: the folder below images is the group. Written as Parquet with its gaps and summary."""
    settings = settings or Settings()
    path = create_output(output, "replay", [images])
    files = readers.list_images(spark, images).join(readers.image_metadata(spark, images), "path")
    rows = files.select(
        F.col("relative_path").alias("frame_id"), F.substring_index("relative_path", "/", 1).alias("grp"), F.col("path").alias("source_path"), "relative_path", "size_bytes", "modified",
        "width", "height", "orientation", "timestamp", "metadata_error", F.col("sha256").alias("source_sha256"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"),
    )
    rows.write.mode("overwrite").parquet(f"{path}/data/inventory_plain")
    plain = spark.read.parquet(f"{path}/data/inventory_plain")
    timed = plain.where("t is not null")
    rows = plain.join(inventory.ranks(timed).select("frame_id", "rank"), "frame_id", "left")
    rows.write.mode("overwrite").parquet(f"{path}/data/inventory")
    inventory.samples(timed, settings).write.mode("overwrite").parquet(f"{path}/data/samples")
    marker = json.loads((path / MARKER).read_text())
    writers.write_json(marker | {"images": str(Path(images).resolve())}, str(path / MARKER))
    rows = spark.read.parquet(f"{path}/data/inventory")
    if integrity.not_unique(rows, ["frame_id"]).limit(1).count():
        raise ValueError("frame identifiers repeat")
    review.write_pages(rows.select("grp", "t", "frame_id", "source_path", "source_sha256", "rank"), f"{path}/data/pages")
    writers.upsert(rows.select("frame_id", "grp", "source_path", "source_sha256", "modified"), f"{path}/data/frames_index", "frame_id", "modified")
    contact_sheets(spark, str(path))
    writers.to_one_csv(inventory.summary(rows, settings), f"{path}/data/inventory_summary.csv")
    writers.to_csv(inventory.acquisition_gaps(rows.where("t is not null"), settings), f"{path}/data/acquisition_gaps")
    return path


def contact_sheets(spark: SparkSession, workspace: str, size: tuple[int, int] = (180, 320), columns: int = 5) -> None:
    """An overview of each group's samples as evidence/contact_<group>.png, in the order of their names.

    Every image is read and shrunk by its own task; a group's samples, a few dozen, then make one sheet. Images that can't
    be read are left out.
    """
    from framewright.functions import vision

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for group, sample, source in zip(pdf.grp, pdf.sample_id, pdf.source_path, strict=True):
                try:
                    rows.append((group, sample, vision.contact_sheet([vision.decode(readers.file_bytes(source))], 1, size).tobytes()))
                except Exception as e:  # noqa: BLE001  whatever an image does to a decoder, the overview goes on without it
                    LOG.warning("%s isn't in the overview: %s", source, e)
            yield pd.DataFrame(rows, columns=["grp", "sample_id", "small"])

    def sheet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        images = [np.frombuffer(b, np.uint8).reshape(*size, 3) for b in pdf.small]
        where, path = readers.file_system(f"{workspace}/evidence/contact_{pdf.grp.iloc[0]}.png")
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(path) as f:
            f.write(vision.png_bytes(vision.contact_sheet(images, columns, size)))
        return pd.DataFrame({"grp": [pdf.grp.iloc[0]]})

    sources = spark.read.parquet(f"{workspace}/data/inventory").select("frame_id", "source_path")
    chosen = spark.read.parquet(f"{workspace}/data/samples").select("grp", "sample_id", "frame_id").join(sources, "frame_id")
    chosen = chosen.repartition(16 * spark.sparkContext.defaultParallelism)
    chosen.mapInPandas(shrink, "grp string, sample_id string, small binary").groupBy("grp").applyInPandas(sheet, "grp string").collect()  # a row a group


def make_scenes(spark: SparkSession, workspace: str, places: str, output: str) -> str:
    """The scenes file of a workspace's calibration samples; places is a JSON file of each group's floor, divider and bounds."""
    from framewright.operators import scenes

    project(workspace, "replay")
    chosen = spark.read.parquet(f"{workspace}/data/samples").where("split = 'calibration'").select("frame_id").distinct()
    images = spark.read.parquet(f"{workspace}/data/inventory").join(chosen, "frame_id", "left_semi").select(F.col("grp").alias("group"), "source_path")
    scenes.save(scenes.prepare(images, json.loads(Path(places).read_text())), output)
    return output


def train(spark: SparkSession, workspace: str, points: str, boxes: str | None, scenes_file: str) -> str:
    """Trains the window machine from annotated samples and adds it to a scenes file.

    points is {"samples": {sample: {"width": pixels, "points": [[x, y]]}}}, boxes an array of {"sample_id", "bbox"}.
    """
    from framewright.operators import counting, detections, scenes, training

    project(workspace, "replay")
    notes = [(k, float(v["width"]), [[float(c) for c in p] for p in v["points"]]) for k, v in json.loads(Path(points).read_text())["samples"].items()]
    found = annotation_paths(spark, workspace, spark.createDataFrame(notes, "sample_id string, preview double, points array<array<double>>"))
    width = spark.read.parquet(f"{workspace}/data/inventory").select("frame_id", F.col("width").alias("full"))
    found = found.join(width, "frame_id").withColumn("points", detections.rescale(F.col("points"), F.col("preview"), F.col("full")))
    kind = "sample_id string, bbox array<double>"
    reviewed = readers.json_array(spark, boxes, kind) if boxes else spark.createDataFrame([], kind)
    weights, bias = training.train(training.annotated(found, reviewed))
    own, _ = counting.load_scenes(scenes_file)
    scenes.save(own | {"machine": {"weights": weights, "bias": bias}}, scenes_file)
    return scenes_file


def assets(spark: SparkSession, workspace: str, scenes: str | None = None) -> dict:
    """The detector's recorded assets: hashes of its files and the software's versions. Written by the first run.

    Every later command checks them: a changed or missing file is an error, other software versions are reported in
    qa/runtime.json and don't stop anything.
    """
    kept = Path(workspace) / "data/detector.json"
    now = {m: importlib.metadata.version(m) for m in ("pyspark", "pyarrow", "numpy", "pandas")} | {"python": platform.python_version()}
    if not kept.exists():
        if scenes is None:
            return {}
        files = {str(Path(f).resolve()): hashlib.sha256(Path(f).read_bytes()).hexdigest() for f in (scenes, *CODE)}
        recorded = spark.createDataFrame(list(files.items()), "path string, sha256 string")
        writers.write_json({"files": files, "fingerprint": integrity.fingerprint(recorded).first().fingerprint, "runtime": now}, str(kept))
    found = json.loads(kept.read_text())
    have = [(f, hashlib.sha256(Path(f).read_bytes()).hexdigest()) for f in found["files"] if Path(f).exists()]
    kind = "path string, sha256 string"
    wrong = integrity.manifest_check(spark.createDataFrame(list(found["files"].items()), kind), spark.createDataFrame(have, kind)).orderBy("path").collect()  # a few files
    if scenes is not None and str(Path(scenes).resolve()) not in found["files"]:
        raise ValueError(f"{scenes} isn't the recorded scenes file")
    if wrong:
        raise ValueError("assets differ from those recorded: " + "; ".join(f"{r.path} {r.problem}" for r in wrong))
    drift = {m: [v, now.get(m)] for m, v in found["runtime"].items() if now.get(m) != v}
    writers.write_json({"drift": drift}, f"{workspace}/qa/runtime.json")
    return found


def run(spark: SparkSession, workspace: str, scenes: dict[str, dict], machine=None, limit: int | None = None, strategies=None) -> int:
    """Counts images without a record and appends their records; an error record counts as done. Returns how many.

    Only paths and sizes are joined; each task reads the images of its rows itself. A log that an interrupted run left torn
    is cut before its first broken byte, with a copy of the rest, and what has no record any longer is counted again.
    """
    from framewright.operators.counting import count_images

    project(workspace, "replay")
    assets(spark, workspace)
    log = Path(workspace) / "data/records"
    rows = spark.read.parquet(f"{workspace}/data/inventory")
    if log.exists():
        for file, offset, size in readers.recover_log(spark, str(log), CHECKPOINT, f"{workspace}/data/records_torn"):
            LOG.warning("%s was cut at byte %d; its last %d bytes are in data/records_torn", file, offset, size)
        rows = integrity.remaining(rows, readers.strict_log(spark, str(log), CHECKPOINT, "frame_id"), "frame_id")
    if limit is not None:
        rows = readers.first_rows(rows, limit, "grp", "t", "frame_id")
    n = rows.count()
    if not n:
        return 0
    listed = readers.list_images(spark, project(workspace, "replay")["images"]).select(F.col("path").alias("source_path"), F.col("size_bytes").alias("size_now"), F.col("modified").alias("modified_now"))
    of_sample = spark.read.parquet(f"{workspace}/data/samples").groupBy("frame_id").agg(F.min("sample_id").alias("sample_id"))
    todo = rows.join(listed, "source_path", "left").join(of_sample, "frame_id", "left")
    same = F.coalesce((F.col("size_now") == F.col("size_bytes")) & (F.col("modified_now") == F.col("modified")), F.lit(False))
    images = todo.select("frame_id", F.col("grp").alias("group"), "source_path", F.col("rank").cast("int").alias("sequence_index"), "sample_id", same.alias("source_unchanged"))
    images = images.repartition(min(n, 16 * spark.sparkContext.defaultParallelism), "frame_id")  # some seconds an image: many small tasks
    counted = stage(count_images(images, scenes, strategies, machine))
    writers.append_records(counted, str(log))
    annotate(counted.where("sample_id is not null and status = 'processed'"), {g: int(s["floor"]) for g, s in scenes.items()}, f"{workspace}/evidence")
    discard(counted)
    return n


def annotate(records_: DataFrame, floors: dict[str, int], folder: str) -> None:
    """The samples' images with their detections drawn, as folder/<sample>.png, each by the task that reads the image."""
    from framewright.functions import vision

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sample, group, source, found in zip(pdf.sample_id, pdf.group, pdf.source_path, pdf.detections, strict=True):
                image = vision.overlay(vision.decode(readers.file_bytes(source)), [dict(d) if isinstance(d, dict) else d.asDict() for d in found], floors[group])
                where, path = readers.file_system(f"{folder}/{sample}.png")
                where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(path) as f:
                    f.write(vision.png_bytes(image))
            yield pd.DataFrame({"sample_id": pdf.sample_id})

    rows = records_.select("sample_id", "group", "source_path", F.transform("detections", lambda d: F.struct(d["bbox"].alias("bbox"), d["side"].alias("side"))).alias("detections"))
    rows.mapInPandas(run, "sample_id string").agg(F.count("*")).collect()


def annotation_paths(spark: SparkSession, workspace: str, annotations: DataFrame) -> DataFrame:
    """annotations, which have sample_id, with the source_path of their samples' frames; an unknown sample is an error."""
    inventory_ = spark.read.parquet(f"{workspace}/data/inventory").select("frame_id", "source_path")
    known = spark.read.parquet(f"{workspace}/data/samples").select("sample_id", "frame_id").join(inventory_, "frame_id")
    if odd := annotations.join(known, "sample_id", "left_anti").limit(1).collect():
        raise ValueError(f"sample {odd[0].sample_id} is unknown")
    return annotations.join(known, "sample_id")


def audit(frames: DataFrame, coordinates: DataFrame) -> dict:
    """Scalars of an export: frames by group, coordinates, published and unpublished frames, duplicates."""
    by_group = {r.grp: r.n for r in frames.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row a group
    one = frames.agg(F.count_if(F.col("left_count").isNotNull()).alias("published"), F.count_if("valid_candidate_summary").alias("usable"), F.count_distinct("source_sha256").alias("contents")).first()
    return {"images": sum(by_group.values()), "groups": by_group, "coordinates": coordinates.count(), "published": one.published, "usable": one.usable, "distinct_contents": one.contents}


def records(spark: SparkSession, workspace: str) -> DataFrame:
    """The record log, read strictly: a broken line or a repeated frame is an error."""
    return readers.strict_log(spark, f"{workspace}/data/records", CHECKPOINT, "frame_id")


def verify(spark: SparkSession, workspace: str, baseline: DataFrame | None = None, complete: bool = True) -> dict:
    """Whether records are unique, known, complete and in agreement with a baseline; the result is saved before an error is raised."""
    project(workspace, "replay")
    assets(spark, workspace)
    got, rows = records(spark, workspace), spark.read.parquet(f"{workspace}/data/inventory")
    sets = integrity.completeness(rows, got, "frame_id").first()
    if sets.extra:
        raise ValueError(f"{sets.extra} records are of unknown frames")
    found = []
    if baseline is not None:
        cols = ["source_unchanged", "quality_ok", "auto_left_count", "auto_right_count", "auto_other_count", "suspect_count"]
        found = [r.asDict() for r in integrity.mismatches(got, baseline, "frame_id", ["status", "sha256"], cols).orderBy("frame_id", "reason").limit(100).collect()]
    result = {"records": sets.common, "missing": sets.missing, "first_mismatches": found}
    writers.write_json(result, f"{workspace}/qa/records.json")
    if found or (complete and sets.missing):
        raise ValueError("records are incomplete or differ from the baseline; the differences are saved")
    return result


def statistics(frames: DataFrame, settings: Settings, steps: tuple[int, ...] = (300, 3600), iv: DataFrame | None = None) -> dict[str, DataFrame]:
    """bins, splices, totals, gaps and segment bins of frames with grp, frame_id, t, left_count, right_count, valid, and perhaps their intervals."""
    iv = occupancy.intervals(frames, settings) if iv is None else iv
    return {
        "bins": occupancy.rebin(iv, frames, list(steps)),
        "splices": occupancy.splice_map(iv, frames),
        "totals": occupancy.overall(frames, iv),
        "gaps": occupancy.gaps(frames, settings),
        "segment_bins": occupancy.rebin_segments(iv, frames, steps[0]),
    }


def save_statistics(tables: dict[str, DataFrame], folder: str, status: str) -> None:
    for name, df in tables.items():
        writers.to_csv(df.withColumn("data_status", F.lit(status)), f"{folder}/{name}")
    for name, df in writers.sheets(tables["bins"], tables["splices"], tables["totals"], tables["gaps"]).items():
        writers.to_csv(df, f"{folder}/sheets/{name.replace(' ', '_')}")
    for axis in ("effective", "actual"):
        writers.to_csv(writers.curve(tables["bins"], axis, 300), f"{folder}/curves/{axis}")
    writers.to_csv(writers.heatmap(tables["bins"]), f"{folder}/curves/heatmap")
    draw(tables, f"{folder}/figures", status)
    Path(f"{folder}/report.md").write_text(writers.report([r.asDict() for r in tables["totals"].orderBy("grp").collect()]), encoding="utf-8")


def draw(tables: dict[str, DataFrame], folder: str, note: str) -> None:
    """The three figures of each group as SVG, read back and inspected; what is wrong with one is an error."""
    if tables["totals"].isEmpty():  # no group has frames with a time
        return
    groups, spans = tables["totals"].select("grp"), tables["totals"].select("grp", F.col("effective_hours").alias("hours"))
    labels = stage(review.splice_labels(tables["splices"], spans))
    bins = stage(tables["bins"].where("axis = 'effective'"))
    drawn = figures.curves(bins.where("window_seconds = 300"), groups, note, "effective", labels).unionByName(figures.heatmap(bins.where("window_seconds = 3600"), groups, note, labels))
    figures.write_figures(drawn.unionByName(figures.curves(tables["segment_bins"], groups, note, "actual")), folder)
    if wrong := figures.problems(figures.inspected(figures.read_figures(groups.sparkSession, folder))).orderBy("figure", "grp").limit(20).collect():
        raise ValueError("figures: " + "; ".join(f"{r.figure} of {r.grp}: {r.problem}" for r in wrong))


def replot(spark: SparkSession, table: str, output: str, settings: Settings | None = None) -> Path:
    """Statistics of stored counts, and whether bins hold what the intervals do."""
    settings = settings or Settings()
    path = create_output(output, "replot")
    frames = spark.read.parquet(table)
    if integrity.not_unique(frames, ["frame_id"]).limit(1).count():
        raise ValueError("frame identifiers repeat")
    tables = statistics(frames, settings)
    save_statistics(tables, f"{path}/data", "stored counts")
    kept = integrity_of_bins(tables)
    writers.write_json({"conserved": kept}, f"{path}/qa/statistics.json")
    writers.to_one_csv(writers.manifest(spark, str(path)), f"{path}/manifest.csv")
    if not kept:
        raise ValueError("bins don't add up to the overall integral")
    return path


def integrity_of_bins(tables: dict[str, DataFrame]) -> bool:
    return not occupancy.conservation(tables["bins"], tables["totals"]).where("not conserved").limit(1).count()


def validated(spark: SparkSession, frames: DataFrame, workspace: str, settings: Settings) -> DataFrame | None:
    """Metrics by group and side of data/reference.csv (sample_id, left_count, right_count), if there is one."""
    if not (Path(workspace) / "data/reference.csv").exists():
        return None
    reference = readers.csv_table(spark, f"{workspace}/data/reference.csv", "sample_id string, left_count int, right_count int")
    held = spark.read.parquet(f"{workspace}/data/samples").where("split = 'holdout'").join(frames.select("frame_id", "auto_left_count", "auto_right_count"), "frame_id")
    return validation.metrics(validation.long_form(held.select("grp", "sample_id", "auto_left_count", "auto_right_count"), reference, "v1"), settings, "v1")


def export(spark: SparkSession, workspace: str, accepted: list[str], settings: Settings | None = None) -> Path:
    """Gated frames, coordinates, duplicates, priorities, both sets of statistics, sheets and the report of a workspace whose
    records are complete. What the frames' sheet holds is read back and compared."""
    from framewright.operators.detections import coordinates, within

    settings = settings or Settings()
    assets(spark, workspace)
    verify(spark, workspace)
    got = records(spark, workspace)
    rows = spark.read.parquet(f"{workspace}/data/inventory").select("frame_id", "grp", "t", "source_sha256").join(got.drop("group", "source_path"), "frame_id")
    usable = (F.size(F.coalesce("quality_reasons", F.array())) == 0) & ~gates.group_failure(settings, F.col("grp"), F.col("sharpness"))
    counts = {"left_count": "auto_left_count", "right_count": "auto_right_count"}
    rows = gates.published(rows.withColumn("valid_candidate_summary", usable), usable, F.col("grp").isin(*accepted) if accepted else F.lit(False), counts)
    rows.drop("detections", "candidates").write.mode("overwrite").parquet(f"{workspace}/data/frames")
    frames = spark.read.parquet(f"{workspace}/data/frames")
    points = coordinates(got)
    size = spark.read.parquet(f"{workspace}/data/inventory").select("frame_id", F.col("width").alias("w"), F.col("height").alias("h"))
    box = [F.col(f"bbox_{c}") for c in ("x", "y", "width", "height")]
    outside = points.join(size, "frame_id").where(~F.coalesce(within(*box, F.col("w"), F.col("h")), F.lit(False)))
    if bad := outside.limit(1).collect():
        raise ValueError(f"a detection of {bad[0].frame_id} lies outside its image")
    writers.to_csv(points, f"{workspace}/data/coordinates", gzip=True)
    writers.write_json(audit(frames, points), f"{workspace}/qa/audit.json")
    copies, first = integrity.exact_duplicates(frames, "frame_id", F.col("source_sha256")), review.priority(frames, settings)
    writers.to_csv(copies, f"{workspace}/data/duplicates")
    writers.to_csv(first, f"{workspace}/data/priority")
    candidate = gates.candidate_view(frames, counts).withColumn("valid", F.col("valid_primary"))
    iv = occupancy.intervals(candidate, settings)  # those of accepted groups are the primary ones, too
    primary = statistics(frames.withColumn("valid", F.col("valid_primary")), settings, iv=iv.where(F.col("grp").isin(*accepted) if accepted else F.lit(False)))
    save_statistics(primary, f"{workspace}/data/primary", "accepted groups only")
    others = statistics(candidate, settings, iv=iv)
    save_statistics(others, f"{workspace}/data/candidate", "automatic candidate, to be reviewed")
    plain = frames.select("frame_id", "grp", "t", "auto_left_count", "auto_right_count", "left_count", "right_count", "primary_missing_reason")
    listed = spark.read.parquet(f"{workspace}/data/inventory")
    checks = validated(spark, frames, workspace, settings)
    own = {"frames": plain, "inventory": listed.select("frame_id", "grp", "relative_path", "t", "width", "height", "metadata_error"), "samples": spark.read.parquet(f"{workspace}/data/samples"), "duplicates": copies, "priority": first}
    own |= {"validation": checks} if checks is not None else {}
    tables = {name: stage(df) for name, df in writers.delivery_sheets(primary, others, own).items()}
    for name, df in tables.items():
        writers.to_csv(df, f"{workspace}/data/sheets/{name.replace(' ', '_')}")
    book = {name: (writers.spreadsheet(df), df.columns[:3]) for name, df in tables.items()}
    workbook.write_workbook(spark, book, f"{workspace}/report.xlsx")
    cells = stage(workbook.read_sheets(spark, f"{workspace}/report.xlsx"))
    for name, (df, _) in book.items():  # every sheet, read back; rows are compared by their content and number
        if workbook.unequal(cells, name, df).limit(1).count():
            raise ValueError(f"the sheet {name}, read back, differs from its table")
    discard(cells, *tables.values())
    writers.upsert(got, f"{workspace}/data/index", "frame_id", "processed_at")
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()] if df is not None else []  # noqa: E731  a row a group, or a group and side
    text = writers.delivery_report(rows(inventory.summary(listed.select("grp", "frame_id", "t"), settings), "grp"), rows(checks, "grp", "side"), rows(primary["totals"], "grp"), accepted)
    for name, body in {"report.md": text, "read_first.md": writers.READ_FIRST, "reproduce.md": writers.REPRODUCE}.items():
        (Path(workspace) / name).write_text(body, encoding="utf-8")
    writers.to_one_csv(writers.manifest(spark, workspace), f"{workspace}/manifest.csv")
    return Path(workspace)


def session() -> SparkSession:
    return SparkSession.builder.appName("framewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    for name, needed in {"init-new": ("config", "output"), "prepare": ("images", "output"), "scenes": ("workspace", "places", "output"), "train": ("workspace", "points", "scenes"), "replot": ("frames", "output"), "run": ("workspace",), "smoke": ("workspace",), "verify": ("workspace",), "export": ("workspace",), "review": ("workspace",)}.items():
        p = sub.add_parser(name)
        for option in needed:
            p.add_argument(f"--{option}", required=True)
        if name in ("run", "smoke"):
            p.add_argument("--scenes", required=True, help="npz file: for each group, group/calm, group/plant, group/floor, group/divider; for windows, machine/weights and machine/bias")
            p.add_argument("--limit", type=int, default=7 if name == "smoke" else None)
        if name == "train":
            p.add_argument("--boxes", help="JSON array of reviewed boxes without an insect")
        if name == "verify":
            p.add_argument("--baseline")
        if name in ("prepare", "replot", "export"):
            p.add_argument("--max-gap", type=float, default=15.0, help="seconds")
        if name == "export":
            p.add_argument("--accepted", default="", help="groups, separated by commas")
        if name == "review":
            p.add_argument("--port", type=int, default=8768)
    a = parser.parse_args(args)
    try:
        settings = Settings(max_gap=int(getattr(a, "max_gap", 15.0) * SECOND))
        if a.command == "doctor":
            print(json.dumps(doctor(), indent=2))
        elif a.command == "init-new":
            print(init_new(a.config, a.output))
        elif a.command == "prepare":
            print(prepare(session(), a.images, a.output, settings))
        elif a.command == "scenes":
            print(make_scenes(session(), a.workspace, a.places, a.output))
        elif a.command == "train":
            print(train(session(), a.workspace, a.points, a.boxes, a.scenes))
        elif a.command == "replot":
            print(replot(session(), a.frames, a.output, settings))
        elif a.command in ("run", "smoke"):
            from framewright.operators.counting import load_scenes

            assets(session(), a.workspace, a.scenes)
            print(run(session(), a.workspace, *load_scenes(a.scenes), a.limit))
        elif a.command == "verify":
            spark = session()
            print(json.dumps(verify(spark, a.workspace, spark.read.parquet(a.baseline) if a.baseline else None)))
        elif a.command == "export":
            print(export(session(), a.workspace, [g for g in a.accepted.split(",") if g], settings))
        else:
            from framewright.plans.review_server import serve

            serve(session(), a.workspace, a.port)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
