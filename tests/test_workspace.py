import numpy as np
import pytest
from strandloom.plans import pipelines as P
from strandloom.plans.workspace import Loaded, Settings
from strandloom.sources import scene_files as S

from .test_sources import model_files


def test_settings_and_paths():
    own = Settings("hdfs://x/w/", "town")
    assert own.path("sparse_model") == "hdfs://x/w/town/Colmap/sparse" and own.clusters("maximum").endswith("town/intermediate_outputs/lines3d_clusters_maximum")
    assert own.line_masks.endswith("all_line3d_to_mask") and own.neighbours == 10
    for wrong in ({"method": "none"}, {"neighbours": 0}):
        with pytest.raises(ValueError):
            Settings("w", "s", **wrong)
    with pytest.raises(ValueError, match="no part"):
        own.path("nothing")


def test_a_scene_from_files_to_clusters(spark, tmp_path):
    own = Settings(f"file://{tmp_path}", "town", method="maximum")
    for part in ("sparse_model", "lines3d", "single_masks"):
        (tmp_path / own.path(part).split(f"{tmp_path}/")[1]).mkdir(parents=True)
    model_files(tmp_path / "town/Colmap/sparse")
    (tmp_path / "town/Line3D++/segments_L3D++_0_10x8.bin").write_text("<r><item><x>1</x><y>2</y><z>5</z><w>2</w></item><item><x>1</x><y>6</y><z>5</z><w>6</w></item></r>")
    (tmp_path / "town/Line3D++/Line3D++a.txt").write_text("1 0 0 0 1 0 0 1 0 0 0 0 1 1\n1 0 0 0 0 1 0 1 0 1 0 0 1 1\n")
    (tmp_path / "town/SAM_Mask/Single_Mask/one").mkdir()
    image = np.zeros((8, 10), int)
    image[2] = 255
    (tmp_path / "town/SAM_Mask/Single_Mask/one/3.png").write_bytes(S.gray_png(image, 8))
    scene = Loaded(spark, own)
    assert [tuple(r) for r in scene.segment_masks(8, 10).select("cam_id", "seg_id", "mask_id").collect()] == [(0, 0, 3)]
    assert [tuple(r) for r in scene.clusters(8, 10).collect()] == [(0, 0)]
    assert [tuple(r) for r in Loaded(spark, own).line_masks(8, 10).select("cam_id", "line3d_id", "mask_id").collect()] == [(0, 0, 3)]


def test_labels_and_plane(spark, tmp_path):
    np.save(tmp_path / "l.npy", np.array([4, -1, 4]))
    lines = spark.createDataFrame([(0,), (1,), (2,)], "line3d_id long")
    assert sorted(map(tuple, S.read_labels(spark, f"file://{tmp_path}/l.npy", lines).collect())) == [(0, 4), (1, -1), (2, 4)]
    with pytest.raises(ValueError, match="belong together"):
        S.read_labels(spark, f"file://{tmp_path}/l.npy", lines.where("line3d_id < 2"))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) * [1, 5, 1, 1, 9, 1] + 3
    out = np.array([[r.u, r.v] for r in P.plane_of_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")).orderBy("id").collect()])
    _, _, ways = np.linalg.svd(x - x.mean(0), full_matrices=False)
    ways = np.array([w * np.sign(w[abs(w).argmax()]) for w in ways[:2]])
    assert np.allclose(out, (x - x.mean(0)) @ ways.T)
    flat = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0), (1, 0.0, 0.0, 1.0, 1.0)], "line3d_id long, x1 double, y1 double, x2 double, y2 double")
    rows = {r.line3d_id: r for r in P.projected_clusters(flat, spark.createDataFrame([(7, 0)], "cluster_id long, member_id long")).collect()}
    assert rows[0].cluster_id == 7 and rows[0].alpha == 0.7 and (rows[1].cluster_id, rows[1].red, rows[1].blue, rows[1].alpha) == (-1, 128, 128, 0.3)
