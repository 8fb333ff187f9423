"""Clustered layout, refreshed parts, weights by distance."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from blockreach.operators import overlay as ov
from blockreach.sources import layers, sinks

SCHEMA = "id bigint, y double, city string"


def boxes(spark, side):
    """Unit boxes of a square layout in an order that has nothing to do with place."""
    n = F.pmod(F.col("id") * 7919, F.lit(side * side))
    x, y = (n % side).cast("double"), F.floor(n / side).cast("double")
    return spark.range(side * side).select("id", x.alias("minx"), y.alias("miny"), (x + 1).alias("maxx"), (y + 1).alias("maxy"))


def groups_read(path, minx, miny, maxx, maxy):
    """Row groups whose statistics meet a box, and all of them."""
    read = total = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            read += stats["minx"].min <= maxx and stats["maxx"].max >= minx and stats["miny"].min <= maxy and stats["maxy"].max >= miny
    return read, total


def test_a_box_reads_a_share_of_row_groups_near_its_own(spark, tmp_path):
    side, box = 400, (100.0, 100.0, 199.5, 199.5)
    df = boxes(spark, side)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_clustered(df, str(tmp_path / "near"))
        df.repartition(64).write.parquet(str(tmp_path / "plain"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read, total = groups_read(tmp_path / "near", *box)
    assert total >= 64 and read <= total * 3 / 16  # the box is a sixteenth
    assert groups_read(tmp_path / "plain", *box)[0] == 64
    near = spark.read.parquet(str(tmp_path / "near"))
    assert near.where(ov.in_box(*box)).count() == df.where(ov.in_box(*box)).count() == 101 * 101
    assert near.count() == side * side


def test_curve_takes_bits_in_turn(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (65535.0, 0.0), (0.0, 65535.0), (65535.0, 65535.0), (5.0, 3.0), (-9.0, 1e9)], "x double, y double")
    place = sinks.curve_position(F.col("x"), F.col("y"), (0.0, 0.0, 65535.0, 65535.0))
    assert [r[0] for r in rows.select(place).collect()] == [0, 0x55555555, 0xAAAAAAAA, 0xFFFFFFFF, 0b011011, 0xAAAAAAAA]


def test_odd_tables_are_written_clustered(spark, tmp_path):
    schema = "id bigint, minx double, miny double, maxx double, maxy double"
    for name, rows in {"none": [], "same": [(1, 2.0, 2.0, 2.0, 2.0)] * 3, "null": [(1, None, None, None, None), (2, 0.0, 0.0, 1.0, 1.0)]}.items():
        path = str(tmp_path / name)
        sinks.write_clustered(spark.createDataFrame(rows, schema), path)
        assert sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()), key=str) == sorted(rows, key=str)


def test_refresh_replaces_its_cities_only(spark, tmp_path):
    path = str(tmp_path)

    def table(*rows):
        return spark.createDataFrame(list(rows), SCHEMA)

    def stored():
        return sorted(tuple(r) for r in sinks.read_parts(spark, path, SCHEMA).select("id", "y", "city").collect())

    def unsettled():
        return [r[0] for r in sinks.unsettled_parts(spark, path, SCHEMA).collect()]

    sinks.refresh_parts(table((1, 1.0, "a"), (2, 2.0, "a"), (3, None, "b")), path)
    for _ in range(2):
        sinks.refresh_parts(table((1, 9.0, "a"), (1, 9.0, "a")), path)
        assert stored() == [(1, 9.0, "a"), (1, 9.0, "a"), (3, None, "b")] and unsettled() == []
    # A write that fails half way leaves both the old rows and the manifest.
    failing = table((1, 5.0, "a"), (7, 7.0, "b")).repartition(2, "id").withColumn("y", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("y")))
    with pytest.raises(Exception, match="lost"):
        sinks.refresh_parts(failing, path)
    assert len(stored()) == 3 and unsettled() == []
    # Rows that arrived without their manifest are named.
    table((4, 4.0, "b")).write.mode("append").partitionBy("city").parquet(f"{path}/data")
    assert unsettled() == ["b"]


def test_weights_have_to_agree(spark):
    def stored(*rows):
        return layers.distance_weights(spark.createDataFrame(list(rows), "city string, radius int, weight double"), [1, 2])

    assert {tuple(r) for r in stored(("a", 1, 0.7), ("b", 1, 0.7)).collect()} == {(1, 0.7), (2, 0.5)}
    with pytest.raises(ValueError, match="differ"):
        stored(("a", 1, 0.7), ("b", 1, 0.6))
