"""Geometries of ESRI shapefiles as text."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.flow import Flow
from millrace.session import child

# The format's shape codes and their names.
NAMES = {0: "", 1: "POINT", 3: "MULTILINESTRING", 5: "MULTIPOLYGON", 8: "MULTIPOINT", 11: "POINTZ", 13: "POLYLINEZ", 15: "POLYGONZ", 18: "MULTIPOINTZ", 21: "POINTM", 23: "POLYLINEM", 25: "POLYGONM", 28: "MULTIPOINTM", 31: "MULTIPATCH"}


def geometries(data: bytes) -> Iterator[str]:
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("no shapefile")
    at = 100
    while at + 8 <= len(data):
        words = struct.unpack_from(">ii", data, at)[1]
        body = data[at + 8 : at + 8 + 2 * words]
        if len(body) < 2 * words or len(body) < 4:
            raise ValueError("a record is incomplete")
        at += 8 + 2 * words
        kind = struct.unpack_from("<i", body)[0]
        if kind == 1:
            yield "POINT (%f %f)" % struct.unpack_from("<2d", body, 4)
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
            xy = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
            parts = ("(" + ",".join("%f %f" % xy[2 * k : 2 * k + 2] for k in range(a, b)) + ")" for a, b in zip(starts, starts[1:]))
            yield f"{NAMES[kind]}({','.join(parts)})"
        else:
            yield NAMES.get(kind, "UNKNOWN")


def read(spark: SparkSession, path: str) -> Flow:
    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                found = list(geometries(bytes(content)))
                yield pd.DataFrame({"_geom": found, "__o0": range(len(found))})

    spark = child(spark)
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "_geom string, __o0 long")
    if not path:
        raise PipelineError("a path is missing", "rel.from_shapefile")
    return Flow(rows.select(F.col("_geom"), F.col("__o0")), {"_geom": "string"}, (("__o0", True),))
