import json
import math

import numpy as np
import pytest
from conftest import scene
from pyspark.sql import functions as F

from gaugeworks.operators import stats as st
from gaugeworks.sources.coco import Dataset, from_tables, read_coco, split_marks
from gaugeworks.sources.images import decode_rgb, decoded

ANN = "ann_id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int, ord long"
IMG = "image_id long, file_name string, width long, height long, ord long"
CAT = "category_id long, name string, supercategory string, ord long"


def dataset(spark, images, categories, annotations):
    return Dataset(
        spark.createDataFrame([(i, f"{i}.jpg", w, h, n) for n, (i, w, h) in enumerate(images)], IMG),
        spark.createDataFrame([(c, name, None, n) for n, (c, name) in enumerate(categories)], CAT),
        spark.createDataFrame([(n, i, c, b, None, 0, n) for n, (i, c, b) in enumerate(annotations)], ANN),
    )


@pytest.fixture(scope="module")
def small(spark):
    box = [0.0, 0.0, 10.0, 20.0]
    return dataset(spark, [(1, 100, 50), (2, None, 0), (3, 640, 480)], [(1, "a"), (2, "b"), (3, "unused")], [(1, 1, box), (1, 1, [1.0, 1.0, 4.0, 4.0]), (1, 2, None), (2, 1, [0.0, 0.0, 2.0, 0.0]), (9, 2, box), (1, 77, box), (None, 1, box)])


def test_read(spark, coco_file):
    doc, data = scene(), read_coco(spark, coco_file)
    anns, ids = doc["annotations"], {i["id"] for i in doc["images"]}
    assert data.counts().first().asDict() == {"num_images": 13, "num_categories": 5, "num_annotations": len(anns)}
    assert data.describe() == f"Dataset(images=13, categories=5, annotations={len(anns)})"
    assert [r["name"] for r in data.category_names().collect()] == [c["name"] for c in doc["categories"][1:]]
    assert {r["image_id"]: (r["width"], r["height"]) for r in data.images.collect()} == {i["id"]: (i["width"], i["height"]) for i in doc["images"]}
    for i in (37, 47, 7):
        own = [a for a in anns if a["image_id"] == i]
        assert [tuple(r) for r in data.boxes_of_image(i).collect()] == [tuple(a["bbox"]) for a in own]
        assert [r["category_id"] for r in data.labels_of_image(i).collect()] == [a["category_id"] for a in own] and data.of_image(i).count() == len(own)
    assert {r["image_id"] for r in data.image_ids_of_category(3).collect()} == {a["image_id"] for a in anns if a["category_id"] == 3}
    assert data.of_category(6).count() == 0
    listed = {r["image_id"]: [a["ann_id"] for a in r["annotations"]] for r in data.with_annotations().collect()}
    assert listed == {i: [a["id"] for a in anns if a["image_id"] == i] for i in ids}
    pairs = list(data.iter_images(with_annotations=True))
    assert {image["image_id"]: [a["ann_id"] for a in own] for image, own in pairs} == listed and [i["image_id"] for i, _ in pairs] == [i["id"] for i in doc["images"][1:]]
    assert [(i["image_id"], own) for i, own in data.iter_images()] == [(i["id"], None) for i in doc["images"][1:]]


def png(pixels, colour, filters=(0, 1, 2, 3, 4), palette=None):
    """A PNG file of 8-bit samples; lines use the given filters in turn."""
    import struct
    import zlib

    h, w, c = pixels.shape
    flat, lines = pixels.reshape(h, w * c).astype(int), []
    for y in range(h):
        kind, up = filters[y % len(filters)], flat[y - 1] if y else np.zeros(w * c, int)
        left, corner = (np.concatenate([np.zeros(c, int), v[:-c]]) for v in (flat[y], up))
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(w * c, int), left, up, (left + up) // 2, near][kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) % 256).astype("uint8").tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    extra = chunk(b"PLTE", palette.astype("uint8").tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def bitmap(pixels, upwards=True):
    import struct

    h, w, _ = pixels.shape
    rows = pixels[::-1] if upwards else pixels
    body = b"".join(r[:, ::-1].tobytes() + bytes(-3 * w % 4) for r in rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h if upwards else -h, 1, 24, 0, 0, 0, 0, 0, 0) + body


def test_pixels_are_decoded():
    rng = np.random.default_rng(1)
    rgb, grey, alpha = rng.integers(0, 256, (11, 7, 3)), rng.integers(0, 256, (11, 7, 1)), rng.integers(0, 256, (11, 7, 4))
    assert (decode_rgb(png(rgb, 2)) == rgb).all() and (decode_rgb(png(alpha, 6)) == alpha[:, :, :3]).all()
    assert (decode_rgb(png(grey, 0)) == np.repeat(grey, 3, axis=2)).all() and (decode_rgb(png(alpha[:, :, :2], 4)) == np.repeat(alpha[:, :, :1], 3, axis=2)).all()
    colours = rng.integers(0, 256, (5, 3))
    assert (decode_rgb(png(grey % 5, 3, palette=colours)) == colours[grey[:, :, 0] % 5]).all()
    for upwards in (True, False):
        assert (decode_rgb(bitmap(rgb.astype("uint8"), upwards)) == rgb).all()
    for broken in (b"", b"GIF89a", png(rgb, 2)[:60], bitmap(rgb.astype("uint8"))[:70]):
        with pytest.raises(ValueError):
            decode_rgb(broken)


def test_images_are_found_by_their_path(spark, coco_file, tmp_path):
    doc, shade = scene(), {}
    for n, image in enumerate(doc["images"][1:]):
        (tmp_path / image["file_name"]).parent.mkdir(exist_ok=True)
        shade[image["id"]] = np.full((2, 3, 3), n * 9)
        (tmp_path / image["file_name"]).write_bytes(png(shade[image["id"]], 2))
    # the same base name in another folder is another image
    (tmp_path / "part1" / "0.png").write_bytes(b"other")
    data = read_coco(spark, coco_file, str(tmp_path))
    assert data.image_files().count() == 13 and (data.load_image(7) == shade[7]).all()
    rows = {r["image_id"]: r for r in decoded(data.image_files()).collect()}
    assert all((np.frombuffer(r["rgb"], "uint8").reshape(r["height"], r["width"], 3) == shade[i]).all() for i, r in rows.items()) and len(rows) == 13
    (tmp_path / "part0" / "0.png").write_bytes(b"broken")
    assert decoded(data.image_files()).where("error is not null and rgb is null").select("image_id").collect()[0][0] == 7
    (tmp_path / "part0" / "0.png").unlink()
    with pytest.raises(FileNotFoundError):
        data.load_image(7)
    with pytest.raises(KeyError):
        data.load_image(8)
    with pytest.raises(RuntimeError):
        read_coco(spark, coco_file).load_image(7)


def test_read_duplicates_odd_boxes_and_errors(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 1}, {"id": 1, "width": 2}], "categories": [], "annotations": [{"image_id": 1, "category_id": 1}, {"image_id": 1, "category_id": 1, "bbox": []}, {"image_id": 1, "category_id": 1, "bbox": [1, 2, 3]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    data = read_coco(spark, str(tmp_path / "a.json"))
    assert [r["width"] for r in data.images.collect()] == [2]
    assert [r["bbox"] for r in data.annotations.orderBy("ord").collect()] == [None, [], [1.0, 2.0, 3.0]]
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception):
        read_coco(spark, str(tmp_path / "bad.json"))
    with pytest.raises(Exception):
        read_coco(spark, str(tmp_path / "none.json"))
    with pytest.raises(RuntimeError):
        data.image_files()


@pytest.mark.parametrize("ratio", [0.0, 0.33, 0.8, 1.0])
def test_split_is_exact_disjoint_and_repeatable(spark, coco_file, ratio):
    data = read_coco(spark, coco_file)
    a, b = data.split(ratio, 1)
    left, right = ({r["image_id"] for r in d.images.collect()} for d in (a, b))
    assert len(left) == int(13 * ratio) and not left & right and len(left | right) == 13
    assert left == {r["image_id"] for r in data.split(ratio, 1)[0].images.collect()}
    assert a.annotations.count() == sum(x["image_id"] in left for x in scene()["annotations"]) and a.categories.count() == 5
    ids = spark.range(5000).select(F.col("id").alias("image_id"))
    assert split_marks(ids, ratio, 3).where("is_train").count() == int(5000 * ratio)


def test_counts_distribution_and_tail(small):
    counts = st.class_counts(small)
    assert {(r["name"], r["n"]) for r in counts.collect()} == {("a", 4), ("b", 2)}
    assert [(r["name"], r["fraction"]) for r in st.class_distribution(counts).collect()] == [("a", 4 / 6), ("b", 2 / 6)]
    assert [r["name"] for r in st.tail_categories(counts).collect()] == ["b"]
    with pytest.raises(KeyError):
        st.class_counts_strict(small)


def test_imbalance_values(spark):
    def metrics(ns):
        df = spark.createDataFrame([(i, str(i), n, i) for i, n in enumerate(ns)], "category_id long, name string, n long, first_ord long")
        return st.class_imbalance(df).collect()

    balanced = metrics([5, 5, 5, 5])[0]
    assert (balanced["gini"], balanced["entropy_bits"], balanced["max_entropy_bits"], balanced["imbalance_ratio"], balanced["effective_classes"]) == (0.0, 2.0, 2.0, 1.0, 4.0)
    rng = np.random.default_rng(0)
    for _ in range(4):
        n = rng.integers(1, 500, 10)
        r, p = metrics([int(x) for x in n])[0], np.sort(n / n.sum())
        assert r["gini"] == pytest.approx(2 * (np.arange(1, 11) * p).sum() / 10 - 11 / 10, abs=1e-6) and 0 <= r["gini"] < 1
        assert r["entropy_bits"] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-6) and r["entropy_bits"] <= r["max_entropy_bits"]
    assert metrics([7])[0]["max_entropy_bits"] == 0.0 and metrics([]) == []


def test_geometry(small):
    boxes = {r["measure"]: r for r in st.bbox_statistics(small).collect()}
    assert {m: r["n"] for m, r in boxes.items()} == dict.fromkeys(("area", "width", "height", "aspect_ratio", "relative_area"), 4)
    areas = [200.0, 16.0, 0.0, 200.0]
    assert boxes["area"]["median"] == np.median(areas) and boxes["area"]["p95"] == pytest.approx(np.percentile(areas, 95)) and boxes["area"]["mean"] == np.mean(areas)
    assert boxes["aspect_ratio"]["min"] == 0.0
    assert boxes["relative_area"]["max"] == pytest.approx(200 / np.mean([5000, 1, 640 * 480]))
    sizes = {r["measure"]: r for r in st.image_size_statistics(small).collect()}
    assert (sizes["width"]["n"], sizes["width"]["median"], sizes["width"]["unique_sizes"]) == (2, 370.0, 2)
    per = st.annotations_per_image(small).first()
    assert (per["mean"], per["max"], per["min"]) == (pytest.approx(5 / 3), 4, 0) and per["std"] == pytest.approx(np.std([4, 1, 0]))


def test_density_and_co_occurrence(small):
    density = {r["name"]: r["density"] for r in st.annotation_density(small).collect()}
    assert density == {"a": 2.5, "b": 2.5, "unused": 0.0}
    grid = {(r["category_i"], r["category_j"]): r["n"] for r in st.co_occurrence(small).collect()}
    assert grid == {(1, 1): 2, (2, 2): 1, (1, 2): 1, (2, 1): 1, (3, 3): 0}


def test_plans(small):
    counts = st.class_counts(small)
    assert {r["name"]: r["weight"] for r in st.resampling_weights(counts).collect()} == {"a": 0.75, "b": 1.5}
    assert {r["name"]: r["extra"] for r in st.oversampling_plan(counts).collect()} == {"a": 0, "b": 2}
    assert {r["name"]: r["extra"] for r in st.oversampling_plan(counts, 3).collect()} == {"a": 0, "b": 1}
    tail = st.long_tail(counts).first()
    assert (tail["classes"], tail["tail_count"], tail["head_count"]) == (2, 1, 1)


def test_empty(spark):
    data = dataset(spark, [], [], [])
    assert st.summary(data)["num_images"] == 0 and st.summary(data)["class_imbalance"] == {}
    for f in (st.bbox_statistics, st.image_size_statistics, st.annotation_density, st.co_occurrence):
        assert f(data).count() == 0
    counts = st.class_counts(data)
    assert st.tail_categories(counts).count() == 0 and st.oversampling_plan(counts).count() == 0


def test_tables_keep_one_row_per_id(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    images = spark.createDataFrame([(1, "x", 5, 5, t), (1, "y", 6, 6, t + dt.timedelta(1)), (None, "z", 1, 1, t)], "id long, file_name string, width long, height long, added_at timestamp")
    categories = spark.createDataFrame([(1, "a", None, t), (1, "a", None, t)], "id long, name string, supercategory string, added_at timestamp")
    annotations = spark.createDataFrame([(4, 1, 1, [1.0], 1.0, 0)] * 3, "id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int")
    data = from_tables(images, categories, annotations)
    assert data.counts().first().asDict() == {"num_images": 1, "num_categories": 1, "num_annotations": 1}
    assert data.images.first()["file_name"] == "y"
    assert math.isfinite(st.annotations_per_image(data).first()["mean"])


def test_document_is_cut_by_many_tasks(spark, tmp_path):
    # nested elements, braces and quotes inside strings, other arrays and objects, in any form
    images = [{"id": n, "file_name": f'a}}{{[{n}]\\"}}.png' * (1 + n % 3), "width": n} for n in range(300)]
    annotations = [{"id": n, "image_id": n // 2, "category_id": 1, "segmentation": {"counts": [1, {"x": "}"}], "size": [2, 3]} if n % 4 == 0 else [[1.0, 2.0]], "bbox": [0.5, 1, 2, n]} for n in range(700)]
    doc = {"info": {"images": [{"id": -1}], "by": {"name": "x}"}}, "licenses": [{"id": 5, "annotations": [{"id": -2}]}], "annotations": annotations, "images": images, "categories": [{"id": 1, "name": "é"}]}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("3000", "20000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            for name, text in (("flat", json.dumps(doc)), ("wide", json.dumps(doc, indent=2) + "\n")):
                if size == "3000" and name == "wide":
                    continue
                (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
                data = read_coco(spark, str(tmp_path / f"{name}.json"))
                assert [tuple(r) for r in data.annotations.orderBy("ord").select("ord", "ann_id", "image_id", "bbox").collect()] == [(a["id"], a["id"], a["image_id"], a["bbox"]) for a in annotations]
                assert [tuple(r) for r in data.images.orderBy("ord").select("ord", "image_id", "file_name").collect()] == [(i["id"], i["id"], i["file_name"]) for i in images]
                assert [r["name"] for r in data.categories.collect()] == ["é"]
                assert size == "1000000" or data.annotations.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_box_percentiles_sort_few_of_the_values(spark, monkeypatch):
    from gaugeworks.operators import hot_keys

    sorted_rows, slices = [], hot_keys.value_slices
    monkeypatch.setattr(hot_keys, "value_slices", lambda df, *rest: sorted_rows.append(df.count()) or slices(df, *rest))
    sides = np.random.default_rng(1).uniform(0.5, 900, (1500, 2))
    # image 1 is crowded, image 9 has no row
    boxes = [(i, 9 if i % 10 == 0 else 1 + i % 40 if i % 3 == 0 else 1, 1, [0.0, 0.0, float(w), float(h)], i) for i, (w, h) in enumerate(sides)]
    images = spark.createDataFrame([(i, "f", 100, 100, i) for i in range(1, 41) if i != 9], "image_id long, file_name string, width long, height long, ord long")
    annotations = spark.createDataFrame(boxes, "ann_id long, image_id long, category_id long, bbox array<double>, ord long")
    got = {r["measure"]: r for r in st.bbox_statistics(Dataset(images, images, annotations)).collect()}
    kept = np.array([b[3][2:] for b in boxes if b[1] != 9])
    for name, values in (("width", kept[:, 0]), ("height", kept[:, 1]), ("area", kept.prod(axis=1)), ("aspect_ratio", kept[:, 0] / kept[:, 1])):
        assert got[name]["n"] == len(kept) and got[name]["mean"] == pytest.approx(values.mean())
        assert [got[name][p] for p in ("min", "p25", "median", "p75", "p95", "max")] == pytest.approx(np.percentile(values, [0, 25, 50, 75, 95, 100]))
    assert sorted_rows and sorted_rows[0] < 4 * len(kept) / 2  # of four measures
