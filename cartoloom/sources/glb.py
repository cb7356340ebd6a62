"""Binary glTF of a preview: one file of a bounded number of faces, a mesh and a material a layer."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decimate import decimated
from ..operators.mesh import face_budget
from .settings import palette

#: Numbers of the format: file mark and version, chunk kinds, component types, buffer targets.
MARK, VERSION, JSON_CHUNK, DATA_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
FLOAT, WHOLE, CORNERS, INDICES = 5126, 5125, 34962, 34963


def write_glb(vertices: DataFrame, faces: DataFrame, path: str, style: str = "urban", preset: str | None = None, most_faces: int = 750_000) -> None:
    """Write all layers, thinned out to ``most_faces`` faces together (four a layer at least).

    Layers are fetched one after another, and each within its budget, so what the driver holds is bounded by that number. The file appears under its
    name only when it is complete. Heights point up in the model (z), which glTF calls y.
    """
    budgets = face_budget(faces.groupBy("layer").agg(F.count("*").alias("faces")), most_faces).select("layer", "budget")
    vertices, faces = decimated(vertices, faces, budgets)
    colours = palette(style, preset)
    doc: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}], **{k: [] for k in ("nodes", "meshes", "materials", "accessors", "bufferViews")}}
    data: list[bytes] = []
    size = 0

    def view(values: np.ndarray, target: int, **about) -> int:
        nonlocal size
        raw = values.tobytes()
        doc["bufferViews"].append({"buffer": 0, "byteOffset": size, "byteLength": len(raw), "target": target})
        doc["accessors"].append({"bufferView": len(doc["bufferViews"]) - 1, "byteOffset": 0, **about})
        data.append(raw)
        size += len(raw)
        return len(doc["accessors"]) - 1

    for n, layer in enumerate(sorted(r[0] for r in faces.select("layer").distinct().collect())):
        points = vertices.where(F.col("layer") == layer).orderBy("vid").select("vid", "x", "y", "z").toArrow()
        corners = faces.where(F.col("layer") == layer).orderBy("fid").select("a", "b", "c").toArrow()
        ids, x, y, z = (points.column(k).to_numpy() for k in range(4))
        at = np.stack([x, z, -y], 1).astype("<f4")
        index = np.searchsorted(ids, np.stack([corners.column(k).to_numpy() for k in range(3)], 1)).astype("<u4")
        where = view(at, CORNERS, componentType=FLOAT, count=len(at), type="VEC3", min=at.min(axis=0).tolist(), max=at.max(axis=0).tolist())
        which = view(index.ravel(), INDICES, componentType=WHOLE, count=index.size, type="SCALAR")
        rgb = colours.get(layer, "#808080").lstrip("#")
        # Materials are linear; colours of the palette are not.
        linear = [((c / 255 + 0.055) / 1.055) ** 2.4 if c > 10 else c / 255 / 12.92 for c in bytes.fromhex(rgb)]
        doc["materials"].append({"name": layer, "pbrMetallicRoughness": {"baseColorFactor": [*linear, 1.0], "metallicFactor": 0.0}})
        doc["meshes"].append({"name": layer, "primitives": [{"attributes": {"POSITION": where}, "indices": which, "material": n}]})
        doc["nodes"].append({"name": layer, "mesh": n})
        doc["scenes"][0]["nodes"].append(n)
    doc["buffers"] = [{"byteLength": size}]
    head = json.dumps(doc, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 4)
    part = f"{path}.part"
    with open(part, "wb") as out:
        out.write(struct.pack("<5I", MARK, VERSION, 12 + 8 + len(head) + 8 + size, len(head), JSON_CHUNK) + head + struct.pack("<2I", size, DATA_CHUNK))
        out.writelines(data)
    os.replace(part, path)
