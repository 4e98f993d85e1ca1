import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gaugeworks.session import local_session

    # tiny inputs: compiling plans costs more than interpreting them
    quick = {"spark__sql__codegen__wholeStage": "false", "spark__sql__codegen__factoryMode": "NO_CODEGEN", "spark__driver__extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:+UseSerialGC", "spark__sql__adaptive__enabled": "true"}
    session = local_session(4, "tests", shuffle_partitions=2, memory="2g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def scene():
    """An annotation document without defects: images of three sizes, one of them crowded, boxes on a lattice; two ids come twice."""
    sizes = [(320, 200), (1024, 768), (90, 400)]
    names = ["kite", "barge", "lantern", "anvil", "never used"]
    images = [{"id": 10 * n + 7, "file_name": f"part{n % 2}/{n}.png", "width": w, "height": h} for n in range(13) for w, h in [sizes[n % 3]]]
    annotations = []
    for n, image in enumerate(images):
        for b in range(48 if n == 4 else n % 4):
            x, y = 30 * (b % (image["width"] // 30 - 1)), 24 * (b // (image["width"] // 30 - 1))
            annotations.append({"id": 1000 + len(annotations), "image_id": image["id"], "category_id": 2 + (b * b + n) % 4, "bbox": [x, y, 12 + b % 9, 10 + n], "area": float((12 + b % 9) * (10 + n)), "iscrowd": 0})
    categories = [{"id": c + 2, "name": name, "supercategory": "object"} for c, name in enumerate(names)]
    return {"images": [{**images[3], "width": 5, "height": 5}, *images], "categories": [{**categories[1], "name": "old name"}, *categories], "annotations": annotations}


@pytest.fixture(scope="session")
def coco_file(tmp_path_factory):
    import json

    path = tmp_path_factory.mktemp("coco") / "annotations.json"
    path.write_text(json.dumps(scene()))
    return str(path)
