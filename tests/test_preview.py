"""Previews: fewer faces, and a file that is read back."""

import json
import struct

import numpy as np

from cartoloom.operators import decimate, mesh
from cartoloom.sources.glb import write_glb


def solid(spark, rows=24, columns=30):
    cells = spark.createDataFrame([(0, r, c, float(c), float(rows - 1 - r), 3.0 + np.sin(r / 4.0).item() + c / 9.0) for r in range(rows) for c in range(columns)], "grid_id int, row int, col int, x double, y double, h_mm double")
    return mesh.terrain_solid(cells, rows, columns, 1.0, "base")


def test_faces_fit_their_budget(spark):
    v, f = solid(spark)
    v2, f2 = mesh.base_plate(spark, 4.0, 4.0)
    v2, f2 = (t.selectExpr("'small' AS layer", *[c for c in t.columns if c != "layer"]) for t in (v2, f2))
    v, f = v.unionByName(v2), f.unionByName(f2)
    points, faces = decimate.decimated(v, f, spark.createDataFrame([("base", 500), ("small", 12)], "layer string, budget long"))
    counts = {r["layer"]: r["count"] for r in faces.groupBy("layer").count().collect()}
    assert 100 < counts["base"] <= 500 and counts["small"] == f2.count()
    assert faces.where("a = b OR b = c OR c = a").count() == 0
    assert mesh.corners(points, faces).count() == faces.count()
    box = lambda t: t.where("layer = 'base'").selectExpr("min(x)", "max(x)", "min(z)", "max(z)").first()
    assert max(abs(a - b) for a, b in zip(box(v), box(points), strict=True)) < 3.0
    same = decimate.collapsed(v, f, spark.createDataFrame([], "layer string, cell double"))
    assert same[1].count() == f.count() and same[0].count() == v.count()


def test_glb_is_read_back(spark, tmp_path):
    v, f = solid(spark, 8, 9)
    write_glb(v, f, str(tmp_path / "m.glb"))
    raw = (tmp_path / "m.glb").read_bytes()
    mark, version, size, length, kind = struct.unpack_from("<5I", raw)
    assert (mark, version, size, kind) == (0x46546C67, 2, len(raw), 0x4E4F534A) and length % 4 == 0
    doc = json.loads(raw[20 : 20 + length])
    data = raw[20 + length + 8 :]
    assert struct.unpack_from("<2I", raw, 20 + length) == (len(data), 0x004E4942) and doc["buffers"][0]["byteLength"] == len(data)
    view = lambda n: data[(b := doc["bufferViews"][doc["accessors"][n]["bufferView"]])["byteOffset"] :][: b["byteLength"]]
    part = doc["meshes"][0]["primitives"][0]
    at = np.frombuffer(view(part["attributes"]["POSITION"]), "<f4").reshape(-1, 3)
    index = np.frombuffer(view(part["indices"]), "<u4").reshape(-1, 3)
    assert len(at) == v.count() and len(index) == f.count() and doc["accessors"][part["indices"]]["count"] == index.size
    volume = float(np.einsum("ij,ij->i", at[index[:, 0]], np.cross(at[index[:, 1]], at[index[:, 2]])).sum() / 6)
    assert abs(volume - mesh.volumes(mesh.corners(v, f)).first()["volume_mm3"]) < 1e-3 * volume
    write_glb(v, f, str(tmp_path / "s.glb"), most_faces=60)
    doc = json.loads(open(tmp_path / "s.glb", "rb").read()[20:].split(b"BIN\0")[0][:-4].decode("utf-8", "ignore").rstrip())
    assert doc["accessors"][1]["count"] <= 180
