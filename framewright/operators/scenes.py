"""Scenes of calibration images by tiles: what most images of a group show, pixel by pixel.

Each image is read once, by the task that takes its contrast and colour, and goes out as tiles; the tiles of one place
meet, and their quantile is exact. So no task holds more than one image or one tile's stack, however many images there
are or how large they are. A group's scene is then put together from its tiles, one layer after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import vision
from framewright.sources.readers import file_bytes
from framewright.staging import stage

TILE = 256  # pixels a side
#: Each layer, the share of its values that lie below what is kept, and its number of channels.
LAYERS = {"calm": (0.15, 1), "colour": (0.15, 1), "median": (0.5, 3)}
TILED = "group string, layer string, row int, column int, height int, width int, data binary"


def _layers(image: np.ndarray) -> dict[str, np.ndarray]:
    return {"calm": vision.contrast(image), "colour": vision.chromatic(image)[0], "median": image}


def tiles(images: DataFrame) -> DataFrame:
    """group, layer, row, column, height, width, data: every layer of every image, cut into tiles; images has group, source_path.

    height and width are the image's. An image that can't be read is an error: calibration images are chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.to_pylist():
                found = vision.decode(file_bytes(image["source_path"]))
                h, w = found.shape[:2]
                for layer, values in _layers(found).items():
                    values = values if layer == "median" else values.astype(np.float32)
                    rows = [
                        {"group": image["group"], "layer": layer, "row": y, "column": x, "height": h, "width": w, "data": np.ascontiguousarray(values[y : y + TILE, x : x + TILE]).tobytes()}
                        for y in range(0, h, TILE) for x in range(0, w, TILE)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("group", pa.string()), ("layer", pa.string()), *[(c, pa.int32()) for c in ("row", "column", "height", "width")], ("data", pa.binary())]))

    spread = images.select("group", "source_path").repartition(16 * images.sparkSession.sparkContext.defaultParallelism)  # an image is some seconds of work
    return spread.mapInArrow(run, TILED)


def tile_quantiles(cut: DataFrame) -> DataFrame:
    """group, layer, row, column, height, width, data: the exact quantile of each tile's stack, pixel by pixel.

    A group whose images differ in size is an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        if pdf[["height", "width"]].drop_duplicates().shape[0] > 1:
            raise ValueError(f"images of group {first.group} differ in size")
        share, channels = LAYERS[first.layer]
        kind = np.uint8 if channels > 1 else np.float32
        stack = np.stack([np.frombuffer(d, kind) for d in pdf.data])
        found = np.median(stack, axis=0).astype(np.uint8) if channels > 1 else vision.background(stack, share).astype(np.float32)
        return pd.DataFrame([{**first.drop("data"), "data": found.tobytes()}])

    return cut.groupBy("group", "layer", "row", "column").applyInPandas(run, TILED)


def assembled(quantiles: DataFrame, group: str, layer: str) -> np.ndarray:
    """One layer of one group as an image, its tiles taken one by one."""
    out, channels = None, LAYERS[layer][1]
    for r in quantiles.where((F.col("group") == group) & (F.col("layer") == layer)).toLocalIterator():
        if out is None:
            out = np.zeros((r.height, r.width, channels), np.uint8 if channels > 1 else np.float32)
        part = np.frombuffer(bytes(r.data), out.dtype)
        h, w = min(TILE, r.height - r.row), min(TILE, r.width - r.column)
        out[r.row : r.row + h, r.column : r.column + w] = part.reshape(h, w, channels)
    return out if out is None or channels > 1 else out[:, :, 0]


def prepare(images: DataFrame, places: dict[str, dict]) -> dict[str, dict]:
    """The scene of each group of images (group, source_path): calm contrast and colour, plant, distance, floor and divider.

    places gives each group's floor, divider and bounds of the plant, and perhaps least, its smallest size. A scene is as
    large as one image, and workers hold it as a whole; what is made from all images is made by tiles.
    """
    quantiles = stage(tile_quantiles(tiles(images.where(F.col("group").isin(*places)))))
    out = {}
    for group, own in places.items():
        median = assembled(quantiles, group, "median")
        if median is None:
            raise ValueError(f"group {group} has no calibration images")
        plant = vision.plant_mask(median, own["floor"], [tuple(b) for b in own["bounds"]], own.get("least", 12000))
        out[group] = {
            "calm": assembled(quantiles, group, "calm"), "colour": assembled(quantiles, group, "colour"),
            "plant": plant, "distance": vision.distance(plant), "floor": own["floor"], "divider": own["divider"],
        }
    return out


def save(scenes: dict[str, dict], path: str) -> None:
    """The scenes file that counting.load_scenes reads."""
    np.savez_compressed(path, **{f"{group}/{part}": value for group, own in scenes.items() for part, value in own.items()})
