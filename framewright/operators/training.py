"""Training of the window machine over many images: examples by image, hard negatives by scene, gradients by aggregation.

Every annotated image is read by the task that cuts its windows. In each round all images are searched for windows that
the machine takes for insects but that hold none, at most a given number an image, so that no scene drowns the others and
no task holds more than one image. A step of the fit is one aggregation over the examples to as many numbers as a window
has features; the examples themselves stay where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import vision
from framewright.sources.readers import file_bytes
from framewright.staging import discard, stage

# A window, how far from a point one is no negative, and the contrast from which on it may hold an insect.
WINDOW = (64, 128)
APART = (110.0, 160.0)
SUSPECT = (0.98, 0.12)  # quantile and contrast
EXAMPLE = "label int, features array<float>"
IMAGE = "sample_id string, source_path string, points array<array<double>>, boxes array<array<double>>"


def _window(g: np.ndarray, x: float, y: float, w: float, h: float, size: tuple[int, int]) -> np.ndarray:
    """The part of a grey image around (x, y), w by h, sampled to a window's size; beyond the border its edge goes on."""
    ys = np.clip(np.round(y - h / 2 + (np.arange(size[1]) + 0.5) * h / size[1] - 0.5).astype(int), 0, g.shape[0] - 1)
    xs = np.clip(np.round(x - w / 2 + (np.arange(size[0]) + 0.5) * w / size[0] - 0.5).astype(int), 0, g.shape[1] - 1)
    return g[np.ix_(ys, xs)]


def _examples(g: np.ndarray, contrast: np.ndarray, points: list, boxes: list, rng: np.random.Generator, copies: int, plain: int, size: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Windows of the points, moved, scaled and mirrored; reviewed boxes and windows away from anything as negatives."""
    w, h = size
    for label, places in ((1, [(x, y, 1.2 * w, 1.125 * h) for x, y in points]), (0, [(x + bw / 2, y + bh / 2, bw, bh) for x, y, bw, bh in boxes])):
        for x, y, pw, ph in places:
            for k in range(copies):
                f = rng.uniform(0.85, 1.15)
                part = _window(g, x + rng.uniform(-0.1, 0.1) * w, y + rng.uniform(-0.07, 0.07) * h, pw * f, ph * f, size)
                yield label, vision.hog(part[:: -1 if k % 4 >= 2 else 1, :: -1 if k % 2 else 1])
    for _ in range(plain):
        x, y = rng.uniform(w / 2, max(g.shape[1] - w / 2, w)), rng.uniform(h / 2, max(g.shape[0] - h / 2, h))
        near = any(abs(x - a) < APART[0] and abs(y - b) < APART[1] for a, b in points)
        if not near and np.quantile(_window(contrast, x, y, w, h, size), SUSPECT[0]) <= SUSPECT[1]:
            yield 0, vision.hog(_window(g, x, y, w, h, size))


def _hard(g: np.ndarray, contrast: np.ndarray, points: list, weights: np.ndarray, bias: float, number: int, size: tuple[int, int], least: float = -0.1, cell: int = 8) -> list[np.ndarray]:
    """The features of the number highest windows of all scales, of at least least, that hold no point and no dark spot."""
    rows, columns = size[1] // cell - 1, size[0] // cell - 1
    best: list[tuple[float, int, np.ndarray]] = []
    n = 0
    for factor, small in vision.scales(g, size, 1.06):
        blocks = vision.hog_blocks(small, cell)
        scores = vision.window_scores(blocks, weights, bias, rows, columns)
        bar = best[number - 1][0] if len(best) >= number else least
        found = 0
        for i in np.argsort(-scores, axis=None, kind="stable").tolist():
            y, x = np.unravel_index(i, scores.shape)
            if scores[y, x] < bar or found == number:
                break
            cx, cy, bw, bh = (x * cell + size[0] / 2) * factor, (y * cell + size[1] / 2) * factor, size[0] * factor, size[1] * factor
            if any(abs(cx - a) < APART[0] and abs(cy - b) < APART[1] for a, b in points):
                continue
            if np.quantile(_window(contrast, cx, cy, bw, bh, size), SUSPECT[0]) > SUSPECT[1]:
                continue
            best.append((float(scores[y, x]), n, blocks[y : y + rows, x : x + columns].ravel().astype(np.float32)))
            found, n = found + 1, n + 1
        best = sorted(best, key=lambda b: (-b[0], b[1]))[:number]
    return [features for _, _, features in best]


def _by_image(images: DataFrame, cut: Callable[[np.ndarray, np.ndarray, dict], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """The examples (label, features) that cut makes of each image: its grey values, its contrast, its row."""
    schema = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = vision.decode(file_bytes(row["source_path"]))
                held = []
                for label, features in cut(vision.grey(image), vision.contrast(image), row):
                    held.append({"label": label, "features": features.astype(np.float32)})
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    spread = images.select("sample_id", "source_path", "points", "boxes").repartition(16 * images.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, EXAMPLE)


def _summed(examples: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all examples of what part gives for a batch's (features with a closing 1, labels as -1 and 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                own = part(np.hstack((x, np.ones((len(x), 1)))), np.where(batch.column("label").to_numpy() > 0, 1.0, -1.0))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    return np.sum([np.frombuffer(r.total) for r in examples.mapInArrow(run, "total binary").collect()], axis=0)  # a row a task


def fit(examples: DataFrame, c: float = 0.015, steps: int = 500, least: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the machine of vision.linear_machine, by the same steps, each one aggregation over the examples.

    The steps' length comes from the largest eigenvalue of the weighted examples, found by power iteration. Steps end
    after steps, or once the weights move by less than least of their length.
    """
    n = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}  # two rows
    total = sum(n.values())
    weight = {s: c * total / (2 * max(n.get(label, 0), 1)) for s, label in ((1.0, 1), (-1.0, 0))}
    of = lambda s: np.where(s > 0, weight[1.0], weight[-1.0])
    d = len(examples.select("features").first().features) + 1
    v, top = np.ones(d) / np.sqrt(d), 0.0
    for _ in range(100):
        u = _summed(examples, lambda z, s, v=v: z.T @ (of(s) * (z @ v)))
        before, top = top, float(np.linalg.norm(u))
        v = u / max(top, 1e-300)
        if abs(top - before) <= 1e-4 * top:
            break
    limit = 1 + 2 * 1.001 * top
    w = old = np.zeros(d)
    for k in range(steps):
        at = w + k / (k + 3) * (w - old)
        pull = _summed(examples, lambda z, s, at=at: z.T @ (of(s) * s * np.maximum(0, 1 - s * (z @ at))))
        old, w = w, at - (at - 2 * pull) / limit
        if k and np.linalg.norm(w - old) < least * np.linalg.norm(w):
            break
    return w[:-1], float(w[-1])


def train(images: DataFrame, rounds: int = 3, number: int = 600, copies: int = 16, plain: int = 600, size: tuple[int, int] = WINDOW, steps: int = 500) -> tuple[np.ndarray, float]:
    """A machine from annotated images (IMAGE): points of insects and reviewed boxes without one, in image pixels.

    In each round the number highest false windows of each image are added. What an image gives depends on the image and
    its name only, so a lost task's work is repeated alike.
    """

    def first(g: np.ndarray, contrast: np.ndarray, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        rng = np.random.default_rng(zlib.crc32(row["sample_id"].encode()))
        return _examples(g, contrast, row["points"] or [], row["boxes"] or [], rng, copies, plain, size)

    examples = stage(_by_image(images, first))
    machine = fit(examples, steps=steps)
    for _ in range(rounds):
        weights, bias = machine

        def again(g: np.ndarray, contrast: np.ndarray, row: dict, weights: np.ndarray = weights, bias: float = bias) -> Iterator[tuple[int, np.ndarray]]:
            return ((0, f) for f in _hard(g, contrast, row["points"] or [], weights, bias, number, size))

        hard = stage(_by_image(images, again))
        if hard.isEmpty():
            discard(hard)
            break
        more = stage(examples.unionByName(hard))
        discard(examples, hard)
        examples = more
        machine = fit(examples, steps=steps)
    discard(examples)
    return machine


def annotated(notes: DataFrame, boxes: DataFrame) -> DataFrame:
    """IMAGE rows from notes (sample_id, source_path, points in image pixels) and reviewed boxes (sample_id, bbox)."""
    own = boxes.groupBy("sample_id").agg(F.collect_list(F.col("bbox").cast("array<double>")).alias("boxes"))  # one image's
    none = F.array().cast("array<array<double>>")
    return notes.join(own, "sample_id", "left").select("sample_id", "source_path", F.coalesce("points", none).alias("points"), F.coalesce("boxes", none).alias("boxes"))
