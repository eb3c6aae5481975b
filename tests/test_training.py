import json

import numpy as np
import pytest

from framewright.functions import vision
from framewright.operators import counting, scenes, training
from framewright.plans import workflow


def picture(rng, spots, size=(260, 340)):
    """A wall with soft noise and dark upright spots (x, y)."""
    im = np.clip(rng.normal(150, 3, (*size, 3)), 0, 255)
    for x, y in spots:
        im[y - 18 : y + 18, x - 6 : x + 6] = 40
    return im.astype(np.uint8)


def test_steps_equal_the_local_machine(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 12)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0.6).astype(int)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], training.EXAMPLE).repartition(3)
    w, b = training.fit(df, steps=40, least=0)
    want, bias = vision.linear_machine(x.astype(float), y, steps=40)
    assert np.allclose(w, want, rtol=2e-2, atol=2e-3) and abs(b - bias) < 2e-3


def test_machine_from_annotated_images(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3):
        spots = [(70, 80), (200, 150)] if i < 2 else []
        (tmp_path / f"{i}.png").write_bytes(vision.png_bytes(picture(rng, spots)))
        rows.append((f"s{i}", str(tmp_path / f"{i}.png"), [[float(x), float(y)] for x, y in spots], [[250.0, 20.0, 32.0, 64.0]] if i == 2 else None))
    images = spark.createDataFrame(rows, training.IMAGE)
    w, b = training.train(images, rounds=1, number=20, copies=4, plain=20, size=(32, 64), steps=60)
    assert np.allclose(w, training.train(images.repartition(2), rounds=1, number=20, copies=4, plain=20, size=(32, 64), steps=60)[0], atol=1e-6)
    own = vision.grey(picture(rng, [(120, 100)]))
    hits = sorted(vision.windows(own, w, b, -10.0, (32, 64)), key=lambda h: -h[1])
    (x, y, bw, bh), score = hits[0]
    assert abs(x + bw / 2 - 120) < 24 and abs(y + bh / 2 - 100) < 40 and score > 0
    g = vision.grey(vision.decode((tmp_path / "0.png").read_bytes()))
    hard = training._hard(g, np.zeros(g.shape), [(70, 80), (200, 150)], w, b, 5, (32, 64), -10.0)
    assert len(hard) == 5 and all(len(h) == 7 * 3 * 36 for h in hard)


def test_command_adds_the_machine(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "train", lambda images: (np.arange(4.0), float(sum(len(r.points) + 10 * len(r.boxes) + r.points[0][0] for r in images.collect()))))
    workspace = tmp_path / "work"
    (workspace / "data").mkdir(parents=True)
    (workspace / workflow.MARKER).write_text(json.dumps({"mode": "replay"}))
    spark.createDataFrame([("a", "file:/x", 400), ("b", "file:/y", 400)], "frame_id string, source_path string, width int").write.parquet(f"{workspace}/data/inventory")
    spark.createDataFrame([("A_cal_01", "b")], "sample_id string, frame_id string").write.parquet(f"{workspace}/data/samples")
    (tmp_path / "points.json").write_text(json.dumps({"samples": {"A_cal_01": {"width": 200, "points": [[3, 4], [5, 6]]}}}))
    (tmp_path / "boxes.json").write_text(json.dumps([{"sample_id": "A_cal_01", "bbox": [1, 2, 3, 4]}]))
    plant = np.ones((4, 4), bool)
    scenes.save({"A": {"calm": np.zeros((4, 4)), "plant": plant, "floor": 3, "divider": 2}}, str(tmp_path / "s.npz"))
    workflow.train(spark, str(workspace), str(tmp_path / "points.json"), str(tmp_path / "boxes.json"), str(tmp_path / "s.npz"))
    own, machine = counting.load_scenes(str(tmp_path / "s.npz"))
    assert machine[0].tolist() == [0, 1, 2, 3] and machine[1] == 2 + 10 + 6 and own["A"]["floor"] == 3  # 3 pixels of 200 are 6 of 400
    (tmp_path / "points.json").write_text(json.dumps({"samples": {"A_cal_09": {"width": 200, "points": [[3, 4]]}}}))
    with pytest.raises(ValueError, match="unknown"):
        workflow.train(spark, str(workspace), str(tmp_path / "points.json"), None, str(tmp_path / "s.npz"))
