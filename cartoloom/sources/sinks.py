"""Writers of mesh tables: Parquet for any size, 3MF for one model, a JSON report."""

from __future__ import annotations

import json
import os
import zipfile
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mesh import audit, centred, mesh_stats, without_floaters
from .settings import palette

CORE = "http://schemas.microsoft.com/3dmanufacturing/core/2015/02"
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>'


def write_meshes(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    vertices.write.partitionBy("layer").mode("overwrite").parquet(f"{path}/vertices")
    faces.write.partitionBy("layer").mode("overwrite").parquet(f"{path}/faces")


def write_3mf(vertices: DataFrame, faces: DataFrame, path: str, style: str = "urban", preset: str | None = None, plate: tuple[float, float] | None = None, most_faces: int = 4_000_000) -> None:
    """One printable model: an object a layer with its colour, all in one assembly.

    A model is a file of a bounded number of faces (checked before anything is fetched); rows are
    streamed to it. The file appears under its name only when it is complete. Beside a ``base``, tiny shells that nothing carries are
    left out first. Audit issues are errors, larger floating shells among them.
    """
    if faces.limit(most_faces + 1).count() > most_faces:
        raise ValueError(f"a model holds at most {most_faces} faces")
    held, floating = {r[0] for r in faces.select("layer").distinct().collect()}, None
    if "base" in held and len(held) > 1:
        vertices, faces, floating = without_floaters(vertices, faces)
    issues = audit(vertices, faces, floating).collect()
    if issues:
        raise ValueError("printability validation failed: " + "; ".join(r["message"] for r in issues))
    if plate:
        vertices = centred(vertices, *plate)
    colours = palette(style, preset)
    layers = sorted(r[0] for r in faces.select("layer").distinct().collect())
    part = f"{path}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", TYPES)
        archive.writestr("_rels/.rels", RELS)
        with archive.open("3D/3dmodel.model", "w", force_zip64=True) as out:
            put = lambda text: out.write(text.encode())
            put(f'<?xml version="1.0" encoding="UTF-8"?><model unit="millimeter" xmlns="{CORE}"><resources><basematerials id="1">')
            for layer in layers:
                put(f'<base name={quoteattr(layer)} displaycolor="{colours.get(layer, "#808080")}FF"/>')
            put("</basematerials>")
            for n, layer in enumerate(layers):
                put(f'<object id="{n + 2}" type="model" name={quoteattr(layer)} pid="1" pindex="{n}"><mesh><vertices>')
                place = {}
                for k, r in enumerate(vertices.where(F.col("layer") == layer).orderBy("vid").toLocalIterator()):
                    place[r["vid"]] = k
                    put(f'<vertex x="{r["x"]:.6f}" y="{r["y"]:.6f}" z="{r["z"]:.6f}"/>')
                put("</vertices><triangles>")
                for r in faces.where(F.col("layer") == layer).orderBy("fid").toLocalIterator():
                    put(f'<triangle v1="{place[r["a"]]}" v2="{place[r["b"]]}" v3="{place[r["c"]]}"/>')
                put("</triangles></mesh></object>")
            top = len(layers) + 2
            put(f'<object id="{top}" type="model"><components>' + "".join(f'<component objectid="{n + 2}"/>' for n in range(len(layers))) + f'</components></object></resources><build><item objectid="{top}"/></build></model>')
    os.replace(part, path)


def report(vertices: DataFrame, faces: DataFrame, extra: dict | None = None) -> dict:
    """Vertices and faces of each layer, with any further figures."""
    layers = {r["layer"]: {"vertices": r["vertices"], "faces": r["faces"]} for r in mesh_stats(vertices, faces).collect()}
    return {"layers": layers, **(extra or {})}


def write_report(path: str, document: dict) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as out:
        json.dump(document, out, indent=2, sort_keys=True)
    os.replace(part, path)
