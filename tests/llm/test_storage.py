"""Shards and archives: SQL on the driver's tables, hot and odd rows, damaged files."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from blockreach.llm import sharding, warc
from blockreach.llm.common import open_folder, shared_folder, written
from blockreach.llm.queries import ORACLES, op7, op8


@pytest.mark.parametrize("name, query, table", [("op7_shards", op7, "documents"), ("op8_warc_audit", op8, "pages")])
def test_queries_equal_sql(spark, name, query, table):
    folder = "/root/testdata/sf0.01"
    df = query(spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    assert len(want) > 200


def test_shards_fit_and_are_shortest_prefixes(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(800)] + [(None, "null id"), (900, None), (901, "y" * 9000)]
    rows += [(5000, f"same key {i} " + "z" * 60) for i in range(400)] + [(6000, "identical rows")] * 900 + [(None, "null id")] * 500
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, shard string").repartition(5)
    got = sharding.shard_rows(df, limit=2000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    sizes, members = defaultdict(int), Counter()
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
        members[r["shard"]] += 1
    assert all(size <= 2000 or members[shard] == 1 for shard, size in sizes.items())
    assert all(sizes[r["shard"]] == r["shard_bytes"] for r in got)
    # Bits of the key: the prefix above every shard is over the limit.
    keyed = [tuple(map(int, r["shard"].split(":"))) for r in got if r["shard"].count(":") == 1]
    above = defaultdict(int)
    for r in got:
        parts = list(map(int, r["shard"].split(":")))
        depth, at = (parts[0], parts[1])
        for d in range(depth):
            above[d, at >> depth - d] += r["n_bytes"]
    assert all(above[d - 1, at >> 1] > 2000 for d, at in keyed if d)
    assert sharding.shard_rows(df.limit(0)).count() == 0


def pages(spark, n=300):
    rng = random.Random(9)
    rows = [(i, f"http://h/{i}", "é" * rng.randint(0, 2000)) for i in range(n)] + [(n, None, None), (None, "u", "no id"), (3, "again", "again"), (3, "again", "again")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_files_read_back(spark):
    stored = written(warc.archived(pages(spark), with_record=True), "test-archive")
    folder = shared_folder(spark, "test-warc")
    warc.write_warc(stored, folder)
    read = written(warc.read_warc(spark, folder), "test-read")
    columns = ["file", "start", "end", "page_id", "digest"]
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, stored.select(columns).collect()))
    assert warc.audit(stored, read).count() == 0
    # One byte inside a record's body, and a file cut short.
    fs, path = open_folder(folder)
    hit = stored.where("page_id = 42").first()
    with fs.open_input_stream(f"{path}/{hit['file']:06d}.warc") as file:
        content = bytearray(file.read())
    last = max(r["start"] for r in stored.where(f"file = {hit['file']}").collect())
    content[hit["end"] - 5] ^= 1
    with fs.open_output_stream(f"{path}/{hit['file']:06d}.warc") as file:
        file.write(bytes(content[:last + 20]))
    damaged = written(warc.read_warc(spark, folder), "test-damaged")
    assert {(r["start"], r["status"]) for r in warc.audit(stored, damaged).collect()} == {(hit["start"], "corrupt"), (last, "missing")}
    assert {(r["start"], r["status"]) for r in warc.audit(damaged, stored).collect()} == {(hit["start"], "corrupt"), (last, "extra")}


def test_empty_archives(spark):
    empty = written(warc.archived(pages(spark).limit(0)), "test-empty")
    full = written(warc.archived(pages(spark, 5)), "test-full")
    assert warc.audit(empty, empty).count() == 0
    assert {r["status"] for r in warc.audit(full, empty).collect()} == {"missing"}


def test_audit_of_odd_pages_follows_its_sql(spark, tmp_path):
    """Pages that are empty, null, repeated or end beyond ASCII: every record has the status of the damage rule."""
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", rng.choice(["café", "", None, "plain#", "日本", "WARC/1.0 in a page\r\n\r\n"]) if i % 3 else "x" * rng.randint(0, 3000)) for i in range(700)]
    rows += [(None, None, None), (5, "again", "again"), (5, "again", "again")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op8(spark, str(tmp_path))
    columns = sorted(got.columns)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES['op8_warc_audit']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(columns).collect())
    assert {r["status"] for r in got.collect()} == {"same", "corrupt", "missing"}


def test_audit_without_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op8(spark, str(tmp_path)).count() == 0


def test_damaged_files_read_back_like_the_query(spark):
    """Files of records damaged by the query's rule: reading goes on after an unreadable record, and the audit finds each."""
    bits = sharding.leading_bits(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    stored = written(warc.archived(pages(spark, 600), with_record=True), "test-stored")
    folder = shared_folder(spark, "test-damage")
    content = warc.damaged(F.col("record"), bits % 40 == 0, bits % 60 == 1)
    warc.write_warc(stored.select("file", "start", content.alias("record")), folder)
    read = written(warc.read_warc(spark, folder), "test-damage-read")
    found = {(r["file"], r["start"]): r["status"] for r in warc.audit(stored, read).collect()}
    rule = F.when(bits % 60 == 1, "missing").when(bits % 40 == 0, "corrupt")
    want = {(r["file"], r["start"]): r["status"] for r in stored.select("file", "start", rule.alias("status")).where("status is not null").collect()}
    assert found == want and set(want.values()) == {"missing", "corrupt"}
