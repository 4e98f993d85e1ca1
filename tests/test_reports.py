import json

import numpy as np
import pytest

from gaugeworks import cli
from gaugeworks.plans import recipes
from gaugeworks.sources import folders
from gaugeworks.sources.coco import read_coco
from gaugeworks.sources.report import Report, escape, plain, render


def test_escape_and_render():
    assert escape("<a b=\"c\">&'") == "&lt;a b=&quot;c&quot;&gt;&amp;'"
    assert "<th>a</th><td>1</td>" in render({"a": 1})
    assert render(list(range(80))).count("<li>") == 50 and "50 of 80" in render(list(range(80)))
    assert render([{"a": i} for i in range(300)]).count("<tr>") == 201
    assert render([[1], [2]] * 20).count("<li>1") + render([[1], [2]] * 20).count("<li>2") == 10


def test_report_files(tmp_path):
    r = Report("d<x>").add("one", {"n": np.int64(3), "f": np.float32(0.5), "a": np.arange(2)}).add("one", {"n": np.int64(4)})
    path = r.save_json(tmp_path / "deep" / "r.json")
    assert json.loads(path.read_text())["sections"] == {"one": {"n": 4}}
    assert "d&lt;x&gt;" in r.save_html(tmp_path / "r.html").read_text()
    with pytest.raises(TypeError):
        plain(object())


def tree(tmp_path):
    for c in ("dog", "cat", "bird"):
        (tmp_path / c).mkdir()
    for i in range(5):
        (tmp_path / "dog" / f"{i}.JPG").write_bytes(b"x")
    for name in ("_a.png", ".b.webp", "c.tiff", "d.tif", "e.gif", "zero.bmp"):
        (tmp_path / "cat" / name).write_bytes(b"")
    (tmp_path / "cat" / "deep").mkdir()
    (tmp_path / "cat" / "deep" / "f.png").write_bytes(b"x")
    return str(tmp_path)


def test_folders(spark, tmp_path):
    listing = folders.list_folders(spark, tree(tmp_path))
    assert [(r["class_name"], r["label"]) for r in folders.class_labels(listing).orderBy("label").collect()] == [("bird", 0), ("cat", 1), ("dog", 2)]
    files = folders.labelled_files(listing)
    assert {r["class_name"]: r["count"] for r in files.groupBy("class_name").count().collect()} == {"cat": 4, "dog": 5}
    assert folders.labelled_files(listing, 2).count() == 4
    data = folders.to_dataset(files, folders.class_labels(listing))
    assert data.counts().first().asDict() == {"num_images": 9, "num_categories": 3, "num_annotations": 9}
    order = [r["file_name"] for r in data.images.orderBy("image_id").collect()]
    assert order == sorted(order) and [r["image_id"] for r in data.images.orderBy("image_id").collect()] == list(range(9))
    with pytest.raises(FileNotFoundError):
        folders.list_folders(spark, str(tmp_path / "none"))


def test_recipes_and_commands(spark, coco_file, tmp_path, capsys):
    rng = np.random.default_rng(0)
    p, x = rng.dirichlet(np.ones(3), 30), rng.normal(size=(30, 4))
    probs = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(p)], "id long, label int, probs array<double>")
    vectors = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(x)], "id long, label int, embedding array<double>")
    out = recipes.audit(read_coco(spark, coco_file), "d", probabilities=probs, embeddings=vectors, report_dir=tmp_path / "out")
    assert list(out["sections"]) == ["dataset_statistics", "annotation_checks", "label_quality", "mislabel_detection"]
    assert json.loads((tmp_path / "out" / "d_report.json").read_text())["dataset"] == "d" and (tmp_path / "out" / "d_report.html").exists()
    (tmp_path / "tree").mkdir()
    root = tree(tmp_path / "tree")
    assert recipes.folder_imbalance(spark, root)["class_imbalance"]["classes"] == 2
    assert cli.main(["stats", coco_file, "-o", str(tmp_path / "s.json")], spark) == 0 and json.loads((tmp_path / "s.json").read_text())["num_images"] == 13
    assert cli.main(["check", coco_file], spark) == 0 and cli.main(["folders", root, "-o", str(tmp_path / "f")], spark) == 0
    assert cli.main(["report", coco_file, "-o", str(tmp_path / "r"), "-n", "x"], spark) == 0 and (tmp_path / "r" / "x_report.html").exists()
    assert "Most frequent classes" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_section_counts_classes_once(spark, coco_file, monkeypatch):
    from gaugeworks.operators import stats
    from gaugeworks.plans.recipes import dataset_section
    from gaugeworks.sources.coco import read_coco

    calls, count = [], stats.class_counts
    monkeypatch.setattr(stats, "class_counts", lambda data: calls.append(1) or count(data))
    out = dataset_section(read_coco(spark, coco_file), 10.0)
    assert len(calls) == 1 and sum(r["n"] for r in out["class_distribution"]) == out["num_annotations"]
