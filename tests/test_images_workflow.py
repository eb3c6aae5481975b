import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import vision
from framewright.operators import counting, review
from framewright.plans import review_server, workflow
from framewright.schemas import CANDIDATE, SECOND, Settings
from framewright.sources import workbook, writers

NAMES = [f.split(":")[0] for f in CANDIDATE.split(", ")]


def scene(spots=((60, 40), (60, 150)), size=(240, 300)):
    """A grey wall with a green stem on each side and dark spots (y, x)."""
    im = np.full((*size, 3), 150, np.uint8)
    im[20:200, 20:80] = im[20:200, 120:180] = (60, 150, 60)
    for y, x in spots:
        im[y - 20 : y + 20, x - 9 : x + 9] = (20, 40, 30)
    return im


def scenes():
    empty = scene(())
    plant = vision.plant_mask(empty, 210, [(0, 300)], 500)
    return {"A": {"calm": vision.contrast(empty, 12), "colour": None, "plant": plant, "distance": vision.distance(plant), "floor": 210, "divider": 100}}


SMALL = vision.Params(min_area=200, blur=12)
PLANS = {"A": counting.Strategy(False, "all", SMALL)}


def pictures(spark, *images):
    rows = [(f"f{i}", "A", None, i, None, True, bytearray(vision.png_bytes(im))) for i, im in enumerate(images)]
    return spark.createDataFrame(rows, "frame_id string, group string, source_path string, sequence_index int, sample_id string, source_unchanged boolean, content binary")


def test_kernels():
    rng = np.random.default_rng(1)
    mask = rng.random((40, 50)) < 0.35
    labels, n = vision.components(mask)
    seen = set()
    for y, x in np.argwhere(mask):
        for b, a in np.argwhere(mask[y : y + 2, max(0, x - 1) : x + 2]):
            assert labels[y, x] == labels[y + b, max(0, x - 1) + a]
        seen.add(labels[y, x])
    assert seen == set(range(1, n + 1)) and (labels > 0).sum() == mask.sum()
    points = np.argwhere(mask)
    want = np.sqrt(((np.argwhere(np.ones_like(mask))[:, None] - points[None]) ** 2).sum(axis=2)).min(axis=1).reshape(mask.shape)
    assert np.allclose(vision.distance(mask), want)
    flat = np.full((30, 30), 7.0)
    assert np.allclose(vision.blurred(flat, 3), 7) and vision.opened(np.zeros((5, 5), bool)).sum() == 0
    im = rng.integers(0, 256, (17, 23, 3), dtype=np.uint8)
    assert (vision.decode(vision.png_bytes(im)) == im).all()
    with pytest.raises(ValueError):
        vision.decode(vision.png_bytes(im), (1, 1))
    assert vision.image_quality(scene())["sharpness"] > vision.image_quality(np.full((240, 300, 3), 150, np.uint8))["sharpness"] == 0


def test_gradient_machine_separates():
    rng = np.random.default_rng(2)
    window = lambda dark: np.clip(rng.normal(128, 8, (32, 32)) - (80 * ((np.abs(np.mgrid[:32, :32][1] - 16) < 5)) if dark else 0), 0, 255)
    w, b = vision.train([window(True) for _ in range(6)], [window(False) for _ in range(12)], [np.clip(rng.normal(128, 8, (48, 48)), 0, 255)], rounds=1, copies=4)
    assert all(vision.hog(window(True)) @ w + b > vision.hog(window(False)) @ w + b for _ in range(10))


def test_windows_are_scored_on_one_grid_a_scale():
    rng = np.random.default_rng(4)
    g, w, b = rng.uniform(0, 255, (150, 131)), rng.normal(size=3 * 7 * 36), 0.2
    passes, real = [], vision.hog_blocks
    vision.hog_blocks = lambda image, *a: passes.append(image.shape) or real(image, *a)
    try:
        found = dict((tuple(box), score) for box, score in vision.windows(g, w, b, -1e9, (32, 64)))
    finally:
        vision.hog_blocks = real
    factors = list(vision.scales(g, (32, 64), 1.06))
    assert len(passes) == len(factors) > 10
    for factor, small in factors[::4]:
        blocks = vision.hog_blocks(small)
        for y in range(0, small.shape[0] - 63, 8):
            for x in range(0, small.shape[1] - 31, 8):
                score = blocks[y // 8 : y // 8 + 7, x // 8 : x // 8 + 3].ravel() @ w + b
                assert abs(found[tuple(round(v * factor) for v in (x, y, 32, 64))] - score) < 1e-9
    alone = vision.hog_blocks(g[16:80, 16:64])  # away from its border a window alone has the grid's blocks
    assert np.allclose(alone[1:-1, 1:-1], vision.hog_blocks(g)[3:8, 3:6])
    hard = vision.hardest_windows(g, w, b, 5, (64, 32), -1e9)
    top = sorted((s for k, s in found.items() if k[2:] == (32, 64)), reverse=True)[:5]
    assert np.allclose([h @ w + b for h in hard], top)


def test_regions_equal_sums_over_each():
    rng = np.random.default_rng(5)
    labels, n = vision.components(rng.random((60, 70)) < 0.3)
    value = rng.random((60, 70))
    m = vision.regions(labels, n, value)
    for k in range(n):
        ys, xs = np.nonzero(labels == k + 1)
        w = np.maximum(value[ys, xs], 1e-3)
        spread = np.linalg.eigvalsh(np.cov(np.stack((xs, ys)))) if len(xs) > 1 else np.zeros(2)
        want = [len(xs), value[ys, xs].max(), (xs * w).sum() / w.sum(), (ys * w).sum() / w.sum(), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs) / ((np.ptp(xs) + 1) * (np.ptp(ys) + 1)), np.sqrt((spread[1] + 1) / (spread[0] + 1))]
        assert np.allclose([m[c][k] for c in ("area", "peak", "x", "y", "left", "top", "width", "height", "extent", "elongation")], want)
    assert all(len(v) == 0 for v in vision.regions(np.zeros((4, 4), np.int32), 0, np.zeros((4, 4))).values())


def test_large_regions_are_divided_among_their_peaks():
    y, x = np.mgrid[:60, :140]
    value = np.exp(-((x - 30) ** 2 + (y - 30) ** 2) / 300) + np.exp(-((x - 100) ** 2 + (y - 30) ** 2) / 300)
    labels, n = vision.components(value > 0.01)
    parts, origin = vision.divided(labels, n, value, vision.Params(min_area=20, split_area=100, split_smooth=2, peak_distance=20))
    assert n == 1 and origin.tolist() == [0, 0] and ((parts > 0) == (labels > 0)).all() and parts[30, 30] != parts[30, 100]
    assert vision.divided(labels, n, value, vision.Params(min_area=10**6))[1].size == 0


def test_components_count_spots_by_side(spark):
    rec = counting.count_images(pictures(spark, scene()), scenes(), PLANS).first()
    assert sorted(d.side for d in rec.detections) == ["left", "right"] and [d.detection_id for d in rec.detections] == [1, 2]
    assert (rec.auto_left_count, rec.auto_right_count, rec.status) == (1, 1, "processed") and rec.scene_overlap > 0.9
    found = [d.asDict() for d in rec.detections]
    assert vision.overlay(scene(), found, 210).shape == scene().shape and vision.contact_sheet([scene()] * 3, 2, (20, 30)).shape == (40, 60, 3)


def test_prepare_run_verify_export(spark, tmp_path):
    (tmp_path / "images/A").mkdir(parents=True)
    for i in range(3):
        (tmp_path / f"images/A/{i}.png").write_bytes(vision.png_bytes(scene(((60, 40), (60, 150))[: i + 1])))
    (tmp_path / "images/A/9.png").write_bytes(b"broken")
    out = tmp_path / "work"
    workflow.prepare(spark, str(tmp_path / "images"), str(out))
    own = {f"A/{k}": v for k, v in scenes()["A"].items() if v is not None}
    np.savez(tmp_path / "scenes.npz", **own)
    read, machine = counting.load_scenes(str(tmp_path / "scenes.npz"))
    assert machine is None and read["A"]["floor"] == 210 and (read["A"]["calm"] == own["A/calm"]).all()
    plan = (scenes(), None)
    assert workflow.assets(spark, str(out), str(tmp_path / "scenes.npz"))["fingerprint"]
    assert workflow.run(spark, str(out), *plan, 1, PLANS) == 1
    with pytest.raises(ValueError):
        workflow.verify(spark, str(out))
    torn = next((out / "data/records").glob("*.json"))
    torn.write_bytes(torn.read_bytes() + b'{"frame_id":"A/2.png","sta')
    (torn.parent / f".{torn.name}.crc").unlink(missing_ok=True)
    assert workflow.run(spark, str(out), *plan, None, PLANS) == 3 and workflow.run(spark, str(out), *plan, None, PLANS) == 0
    assert len(list((out / "data/records_torn").iterdir())) == 1
    got = {r.frame_id: r for r in workflow.records(spark, str(out)).collect()}
    assert [got[f"A/{i}.png"].auto_left_count for i in range(3)] == [1, 1, 1] and got["A/9.png"].status == "error"
    assert all(r.source_unchanged for k, r in got.items() if k != "A/9.png")
    assert workflow.verify(spark, str(out))["missing"] == 0
    with pytest.raises(ValueError):
        workflow.verify(spark, str(out), workflow.records(spark, str(out)).withColumn("sha256", F.lit("0" * 64)))
    workflow.export(spark, str(out), ["A"])
    frames = {r.frame_id: r for r in spark.read.parquet(f"{out}/data/frames").collect()}
    assert frames["A/9.png"].left_count is None and frames["A/9.png"].primary_missing_reason == "image not usable"
    assert (out / "data/primary/report.md").exists() and (out / "manifest.csv").exists()
    sheets = {p.name for p in (out / "data/sheets").iterdir()}
    assert len(sheets) == 20 and {"frames", "inventory", "samples", "primary_totals", "candidate_gaps", "fields"} <= sheets
    assert len(workbook.sheet_names(f"{out}/report.xlsx")) == 20 and (out / "data/index").exists()
    report = (out / "report.md").read_text()
    assert "Accepted groups: A." in report and "| A | 4 |" in report and "No reference counts" in report and (out / "reproduce.md").exists() and (out / "read_first.md").exists()
    audit = json.loads((out / "qa/audit.json").read_text())
    assert audit["images"] == 4 and audit["groups"] == {"A": 4} and audit["coordinates"] == sum(r.auto_left_count + r.auto_right_count for k, r in got.items() if k != "A/9.png")
    (tmp_path / "scenes.npz").write_bytes(b"other")
    with pytest.raises(ValueError, match="scenes.npz changed"):
        workflow.verify(spark, str(out))


def test_scenes_by_tiles_equal_whole_stacks(spark, tmp_path):
    from framewright.operators import scenes as tiled

    rng = np.random.default_rng(7)
    images = [np.clip(scene(((60, 40 + 20 * i),), (300, 520)).astype(int) + rng.integers(-9, 9, (300, 520, 3)), 0, 255).astype(np.uint8) for i in range(4)]
    for i, im in enumerate(images):
        (tmp_path / f"{i}.png").write_bytes(vision.png_bytes(im))
    rows = [(g, str(tmp_path / f"{i}.png")) for i in range(4) for g in ("A", "B") if g == "A" or i < 3]
    cut = tiled.tiles(spark.createDataFrame(rows, "group string, source_path string"))
    assert cut.where("layer = 'calm'").count() == 7 * 6 and cut.groupBy("group", "layer", "row", "column").count().agg(F.max("count")).first()[0] == 4
    got = tiled.prepare(spark.createDataFrame(rows, "group string, source_path string"), {g: {"floor": 210, "divider": 100, "bounds": [[0, 520]], "least": 500} for g in ("A", "B")})
    for g, own in (("A", images), ("B", images[:3])):
        calm = np.quantile(np.stack([vision.contrast(i) for i in own]).astype(np.float32), 0.15, axis=0)
        colour = np.quantile(np.stack([vision.chromatic(i)[0] for i in own]).astype(np.float32), 0.15, axis=0)
        plant = vision.plant_mask(np.median(np.stack(own), axis=0).astype(np.uint8), 210, [(0, 520)], 500)
        assert np.allclose(got[g]["calm"], calm, atol=1e-6) and np.allclose(got[g]["colour"], colour, atol=1e-6) and (got[g]["plant"] == plant).all() and plant.any()
    tiled.save(got, str(tmp_path / "scenes.npz"))
    read, _ = counting.load_scenes(str(tmp_path / "scenes.npz"))
    assert read["B"]["floor"] == 210 and (read["A"]["calm"] == got["A"]["calm"]).all()
    with pytest.raises(ValueError, match="no calibration"):
        tiled.prepare(spark.createDataFrame(rows, "group string, source_path string"), {"C": {"floor": 1, "divider": 1, "bounds": []}})


def test_contact_sheets(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(vision.png_bytes(scene()))
    (tmp_path / "3.png").write_bytes(b"broken")
    spark.createDataFrame([(str(i), str(tmp_path / f"{i}.png")) for i in range(4)], "frame_id string, source_path string").write.parquet(str(tmp_path / "data/inventory"))
    spark.createDataFrame([("A" if i else "B", f"s{i}", str(i)) for i in range(4)], "grp string, sample_id string, frame_id string").write.parquet(str(tmp_path / "data/samples"))
    workflow.contact_sheets(spark, str(tmp_path), (20, 30), 2)
    shapes = {p.name: vision.decode(p.read_bytes()).shape for p in (tmp_path / "evidence").iterdir()}
    assert shapes == {"contact_A.png": vision.contact_sheet([scene()] * 2, 2, (20, 30)).shape, "contact_B.png": vision.contact_sheet([scene()], 2, (20, 30)).shape}


def test_annotations_find_their_images(spark, tmp_path):
    spark.createDataFrame([("a", "file:/x"), ("b", "file:/y")], "frame_id string, source_path string").write.parquet(str(tmp_path / "data/inventory"))
    spark.createDataFrame([("A_cal_01", "b")], "sample_id string, frame_id string").write.parquet(str(tmp_path / "data/samples"))
    notes = spark.createDataFrame([("A_cal_01", 3)], "sample_id string, n int")
    assert [(r.source_path, r.n) for r in workflow.annotation_paths(spark, str(tmp_path), notes).collect()] == [("file:/y", 3)]
    with pytest.raises(ValueError, match="unknown"):
        workflow.annotation_paths(spark, str(tmp_path), spark.createDataFrame([("A_cal_09", 3)], "sample_id string, n int"))


def test_guards(tmp_path):
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign/x").write_text("x")
    for bad in (tmp_path / "foreign", workflow.TOOL / "out", tmp_path / "src/out"):
        with pytest.raises(ValueError):
            workflow.create_output(str(bad), "replay", [str(tmp_path / "src")])
    assert (tmp_path / "foreign/x").read_text() == "x"
    config = {"profile": "new-study", "validation_status": "passed", "historical_acceptance_inherited": True, "groups": [{"id": "A", "source_folder": str(tmp_path / "src")}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    out = workflow.init_new(str(tmp_path / "c.json"), str(tmp_path / "new"))
    got = json.loads((out / "data/new_study_config.json").read_text())
    assert got["validation_status"] == "pending" and got["historical_acceptance_inherited"] is False
    with pytest.raises(ValueError):
        workflow.project(str(out), "replay")
    assert workflow.main(["init-new", "--config", str(tmp_path / "none.json"), "--output", str(tmp_path / "o")]) == 1
    assert workflow.main(["doctor"]) == 0 and workflow.doctor()["tables"]


def test_replot(spark, tmp_path):
    rows = [("A", f"f{i}", i * 10 * SECOND, i % 4, i % 3, i % 7 != 0) for i in range(200)]
    spark.createDataFrame(rows, "grp string, frame_id string, t long, left_count int, right_count int, valid boolean").write.parquet(str(tmp_path / "frames"))
    out = workflow.replot(spark, str(tmp_path / "frames"), str(tmp_path / "out"), Settings())
    assert json.loads((out / "qa/statistics.json").read_text()) == {"conserved": True} and "| A |" in (out / "data/report.md").read_text()
    assert sorted(p.name for p in (out / "data/figures").glob("*.svg")) == ["curve_actual_A.svg", "curve_effective_A.svg", "heatmap_A.svg"]


def test_review_records_and_server(spark, tmp_path):
    known = spark.createDataFrame([("a",), ("b",)], "frame_id string")
    box = lambda kind="left", b=(0, 0, 5, 5): {"kind": kind, "bbox": [float(v) for v in b]}
    rows = [("a", "me", True, [box(), box("right")]), ("z", "me", True, []), ("a", " ", True, []), ("a", "me", False, []), ("a", "me", True, None), ("a", "me", True, [box("wing")]), ("b", "me", True, [box(b=(4410, 0, 10, 5))])]
    df = spark.createDataFrame(rows, "frame_id string, reviewer string, confirmed boolean, boxes array<struct<kind: string, bbox: array<double>>>")
    got = [r.problem for r in review.checked(df, known).collect()]
    assert sorted(got, key=str) == sorted([None, "unknown frame", "no reviewer", "not confirmed", "no valid boxes", "unknown kind", "box outside the image"], key=str)
    for (f, who, ok, boxes), want in zip(rows, [None, "unknown frame", "no reviewer", "not confirmed", "no valid boxes", "unknown kind", "box outside the image"], strict=True):
        assert review_server.accepted(spark, json.dumps({"frame_id": f, "reviewer": who, "confirmed": ok, "boxes": boxes}), known)[0] == want
    for odd in ("[1]", '{"frame_id": "a", "reviewer": "me", "confirmed": true, "boxes": 7}', '{"frame_id": "a", "reviewer": "me", "confirmed": true, "boxes": [{"kind": "left", "bbox": ["x", 0, 1, 1]}]}'):
        assert review_server.accepted(spark, odd, known)[0]
    inventory_ = spark.createDataFrame([("a", "A", "file:/x", "00", 1), ("b", "A", "file:/y", "11", 2)], "frame_id string, grp string, source_path string, source_sha256 string, t long")
    review.write_pages(inventory_, str(tmp_path / "data/pages"))
    writers.upsert(inventory_, str(tmp_path / "data/frames_index"), "frame_id", "t")
    server = review_server.serve(spark, str(tmp_path), 0, forever=False)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(record, origin=None):
        request = urllib.request.Request(f"{base}/api/review", json.dumps(record).encode(), {"Origin": origin} if origin else {})
        try:
            return urllib.request.urlopen(request).status
        except urllib.error.HTTPError as e:
            return e.code

    record = {"frame_id": "b", "reviewer": "me", "confirmed": True, "boxes": [box(), box("other")]}
    assert [post(record), post(record | {"confirmed": False}), post(record, "http://elsewhere")] == [200, 400, 403]
    seen = json.load(urllib.request.urlopen(f"{base}/api/frame?group=A&index=99"))
    assert (seen["index"], seen["total"], seen["review"]["left_count"], seen["review"]["other_count"]) == (1, 2, 1, 1)
    server.shutdown()
    assert len((tmp_path / "review/corrections.jsonl").read_text().splitlines()) == 1


def test_hybrid_detector(spark):
    rng = np.random.default_rng(3)
    base = scene(((60, 40), (60, 150), (165, 40)))
    patch = lambda y, x: vision.grey(base)[y - 32 : y + 32, x - 16 : x + 16]
    w, b = vision.train([patch(60, 40), patch(60, 150), patch(165, 40)], [np.clip(rng.normal(150, 3, (64, 32)), 0, 255) for _ in range(10)] + [patch(200, 250)], [vision.grey(scene(()))], rounds=1, copies=4)
    # the machine's windows are small here, so they are measured by hand
    sc, hits = scenes()["A"], vision.windows(vision.grey(base), w, b, 0.3, (32, 64), 8, 3.0)
    sure = vision.measured_windows.__globals__
    real = sure["windows"]
    sure["windows"] = lambda g, weights, bias, least: hits
    try:
        _, found = counting.measurer(scenes(), {"A": counting.Strategy(True, "supplement", SMALL)}, (w, b))(base, "A")
    finally:
        sure["windows"] = real
    assert {"window", "blob"} <= {d["kind"] for d in found} and all(d["gray_q95"] is not None for d in found if d["kind"] == "window")
    # the patches whose colour counts are larger than these spots, and would be as green as the stem
    rows = [("f", i, "A", *[(d | {"chroma_median": 0.0}).get(c) for c in NAMES]) for i, d in enumerate(found)]
    got = counting.decided(spark.createDataFrame(rows, f"frame string, id int, group string, {CANDIDATE.replace(':', '')}"), {"A": sc}, {"A": counting.Strategy(True, "supplement", SMALL)})
    got = sorted((r for r in got.collect() if r.accepted), key=lambda r: r.detection_id)
    assert {r.side for r in got} >= {"left", "right"} and [r.detection_id for r in got] == list(range(1, len(got) + 1))
    for y, x in ((60, 40), (60, 150), (165, 40)):
        assert any(abs(r.x - x) < 25 and abs(r.y - y) < 25 for r in got)


def candidates(spark, rows):
    base = {"kind": "window", "x": 0.0, "y": 0.0, "bbox": [0, 0, 60, 100], "score": 2.0, "gray_q95": 0.2, "chroma_median": 0.0, "area": 2000, "peak": 0.5, "elongation": 2.0, "extent": 0.5, "plant_distance": 5.0, "divided": False, "whole_top": 100}
    full = [base | r for r in rows]
    return spark.createDataFrame([("f", i, r.get("group", "B"), *[r[c] for c in NAMES]) for i, r in enumerate(full)], f"frame string, id int, group string, {CANDIDATE.replace(':', '')}")


def judged(spark, *rows, group="B"):
    place = {g: {"floor": 2000, "divider": 1000} for g in "ABC"}
    got = counting.decided(candidates(spark, [r | {"group": group} for r in rows]), place).collect()
    return {r.id: r for r in got}


def test_windows_hide_weaker_ones_even_if_rejected(spark):
    got = judged(spark, {"x": 500.0, "y": 500.0, "score": 3.0, "gray_q95": 0.01}, {"x": 520.0, "y": 540.0, "score": 2.0}, {"x": 700.0, "y": 500.0, "score": 0.9}, {"x": 1500.0, "y": 1990.0, "plant_distance": 60.0}, {"x": 1500.0, "y": 2100.0})
    assert set(got) == {0, 2, 3, 4} and not got[0].accepted and got[0].detection_id is None
    assert (got[2].side, got[2].review_reasons) == ("left", ["low shape score"])
    assert (got[3].zone, got[3].side, got[4].zone) == ("bottom", "", "reflection_or_bottom")
    assert [got[i].detection_id for i in (2, 3, 4)] == [1, 2, 3]


def test_top_edge_and_supplements_keep_clear_of_what_is_accepted(spark):
    edge = {"kind": "edge", "bbox": [100, 0, 40, 30], "area": 500, "score": None, "gray_q95": None}
    blob = {"kind": "blob", "bbox": [900, 600, 60, 100], "score": None, "gray_q95": None}
    got = judged(
        spark, {"x": 120.0, "y": 80.0}, edge | {"x": 130.0, "y": 15.0}, edge | {"x": 400.0, "y": 15.0}, edge | {"x": 450.0, "y": 15.0}, edge | {"x": 800.0, "y": 15.0, "chroma_median": -0.03}, edge | {"x": 1200.0, "y": 15.0, "bbox": [1200, 1, 40, 30]},
        blob | {"x": 930.0, "y": 650.0}, blob | {"x": 960.0, "y": 700.0, "bbox": [930, 650, 60, 100]}, blob | {"x": 130.0, "y": 120.0}, blob | {"x": 1500.0, "y": 650.0, "chroma_median": -0.06, "bbox": [1470, 600, 60, 100]},
    )
    assert set(got) == {0, 2, 6} and [got[i].origin for i in (0, 2, 6)] == ["gradients", "top_edge", "contrast_supplement"]
    assert got[2].review_reasons == ["cut off at the top"] and got[6].review_reasons == ["seen by contrast only"]


def test_strategies_by_group(spark):
    blob = {"kind": "blob", "x": 500.0, "y": 500.0, "score": None, "gray_q95": None}
    only = judged(spark, blob, blob | {"x": 580.0, "y": 600.0, "bbox": [90, 90, 60, 100], "peak": 0.1}, blob | {"extent": 0.1}, group="A")
    assert set(only) == {0, 1} and only[0].review_reasons == ["adjacent or overlapping"] and only[1].review_reasons == ["shape or edge", "adjacent or overlapping"] and only[0].suspect
    assert judged(spark, blob, group="C") == {}
    assert {g: (s.windows, s.components, s.params.threshold) for g, s in counting.STRATEGIES.items()} == {"A": (False, "all", 0.09), "B": (True, "supplement", 0.075)}
    assert counting.Strategy().hit == 0.3


def test_batch_metrics(spark):
    rows = spark.createDataFrame([("A", "error", 1.0), ("A", "processed", 3.0), ("B", "processed", 0.0)], "group string, status string, processing_seconds double")
    got = {r.group: r for r in counting.batch_metrics(rows).collect()}
    assert (got["A"].errors, got["A"].images_per_second, got["B"].images_per_second) == (1, 0.5, None)
