"""Triangles as STL files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORNERS = [p + a for p in "abc" for a in "xyz"]
FACET = "facet normal 0 0 0\nouter loop\nvertex {} {} {}\nvertex {} {} {}\nvertex {} {} {}\nendloop\nendfacet"


def write_text(mesh: DataFrame, path: str) -> None:
    """One folder of text parts per arbor, each part a run of facets; written by the executors."""
    line = F.format_string(FACET.replace("{}", "%.9g"), *[F.col(c) for c in CORNERS])
    mesh.select("arbor_id", line.alias("value")).write.mode("errorifexists").partitionBy("arbor_id").text(path)


def write_file(mesh: DataFrame, path: str) -> int:
    """One binary STL file, streamed through the driver partition by partition; returns the facets."""
    n = 0
    with open(path, "wb") as f:
        f.write(b"\0" * 84)
        for r in mesh.select(*CORNERS).toLocalIterator():
            p = np.array(r).reshape(3, 3)
            normal = np.cross(p[1] - p[0], p[2] - p[0])
            size = np.linalg.norm(normal)
            f.write(struct.pack("<12fH", *(normal / size if size else normal), *p.ravel(), 0))
            n += 1
        f.seek(80)
        f.write(struct.pack("<I", n))
    return n


def read_file(spark: SparkSession, path: str, arbor_id: int = 0) -> DataFrame:
    """A binary STL file as triangles."""

    def parse(batches):
        import pyarrow as pa

        kind = np.dtype([("normal", "<f4", 3), ("p", "<f4", 9), ("extra", "<u2")])
        for batch in batches:
            for raw in batch.column(0):
                data = raw.as_py()
                (n,) = struct.unpack_from("<I", data, 80)
                p = np.frombuffer(data, kind, n, 84)["p"].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, arbor_id)), *[pa.array(p[:, k]) for k in range(9)]], names=["arbor_id", *CORNERS])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "arbor_id bigint, " + ", ".join(f"{c} double" for c in CORNERS))
