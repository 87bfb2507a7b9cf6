"""Readers and writers of observation tables and graphs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquant.session import reachable

# Schemas of the example tables.
SCHEMAS = {
    "meuse_zinc": "zinc double, dist double, elev double, ffreq string, x double, y double",
    "nc_sids": "county string, births double, sid double, nwbirths double, east double, north double, sids_rate double, log_sids double, pnw double",
    "columbus_crime": "id int, crime double, income double, hoval double, x double, y double",
    "lucas_house": "price double, tla double, age double, rooms double, x double, y double",
    "edges": "i string, j string, w double",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_graph(edges: DataFrame, path: str) -> None:
    edges.write.parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(unit, ring) of polygons stored as parquet, one row a closed ring (array<struct<x double, y double>>).

    The table has unit and one of ring, rings (array of rings: parts and holes), or wkb (binary well-known polygons and
    multipolygons). Rings of fewer than four points, null and empty geometries give no row.
    """
    df = spark.read.parquet(path)
    if "ring" in df.columns:
        rings = df.select("unit", "ring")
    elif "rings" in df.columns:
        rings = df.select("unit", F.explode("rings").alias("ring"))
    else:
        reachable(spark)
        rings = df.select("unit", "wkb").where("wkb IS NOT NULL").mapInArrow(_wkb_rings, f"unit {df.schema['unit'].dataType.simpleString()}, ring array<struct<x:double,y:double>>")
    return rings.where(F.size("ring") >= 4)


def _wkb_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    for b in batches:
        units, rings = [], []
        for unit, data in zip(b.column(0), b.column(1).to_pylist()):
            for ring in wkb_rings(data):
                units.append(unit.as_py())
                rings.append([{"x": x, "y": y} for x, y in ring])
        yield pa.RecordBatch.from_arrays([pa.array(units, b.schema.field(0).type), pa.array(rings, kind)], ["unit", "ring"])


def wkb_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a well-known binary polygon or multipolygon, in two dimensions."""

    def polygon(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind, n = struct.unpack_from(order + "II", data, at + 1)
        at += 9
        out = []
        if kind == 6:
            for _ in range(n):
                part, at = polygon(at)
                out += part
            return out, at
        if kind != 3:
            raise ValueError("only polygons and multipolygons of two dimensions are read")
        for _ in range(n):
            (size,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{2 * size}d", data, at + 4)
            out.append(list(zip(flat[::2], flat[1::2])))
            at += 4 + 16 * size
        return out, at

    return polygon(0)[0]


def with_rates(df: DataFrame, cases: str, base: str, part: str, name: str = "rate", scale: float = 1000.0) -> DataFrame:
    """Smoothed rate per scale, its logarithm, and the share of part in the base."""
    rate = F.lit(scale) * (F.col(cases) + 0.5) / (F.col(base) + 1)
    return df.withColumn(name, rate).withColumn(f"log_{name}", F.log(rate)).withColumn(f"share_{part}", F.col(part) / (F.col(base) + 1))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows by a seeded hash of key: the same rows on every run and any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)
