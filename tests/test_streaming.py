import json
import os
import re

import pytest
from pyspark.sql import functions as F

from presswork.operators import selection
from presswork.session import discarding, remove, scratch_path, settled, shared_dir
from presswork.sources import snapshots
from presswork.streaming import jobs, keys


def land(folder, name, sector, date, urls):
    body = {"query": sector, "date": date, "articles": [
        {"source": "s", "title": u, "url": u, "publishedAt": date + "Z", "content": f"The body of {u} will launch. Second sentence. Third one."} for u in urls]}
    (folder / name).write_text(json.dumps(body, indent=1), encoding="utf-8")


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    assert shared_dir(spark) == shared_dir(spark)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_dir(spark).rstrip("/") + "/x-")


def test_snapshot_files_are_read_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    land(src, "a.json", "A", "2025-06-26T10:00:00", ["u1", "u2"])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for extra in (None, "b.json", None):
        if extra:
            land(src, extra, "A", "2025-06-27T10:00:00", ["u2", "u3"])
        rows = snapshots.stream_snapshots(spark, str(src)).drop("snapshot_file")
        jobs.run_to_table(rows, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.url for r in got.collect()) == ["u1", "u2", "u2", "u3"]
    batch = snapshots.read_snapshots(spark, str(src))
    assert got.count() == batch.count()


def test_stream_dedup_equals_batch_and_expires(spark, tmp_path):
    src = str(tmp_path / "in")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "sector string, url string, published_ts timestamp, n int"

    def feed(rows):
        spark.createDataFrame(rows, "sector string, url string, t string, n int").select("sector", "url", F.col("t").cast("timestamp").alias("published_ts"), "n").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.run_to_table(jobs.stream_dedup(stream, salts=4), out, ck).awaitTermination()
        return sorted((r.sector, r.url) for r in spark.read.parquet(out).collect())

    first = [("A", "hot", f"2025-01-01 10:00:{i:02d}", i) for i in range(50)] + [("B", "hot", "2025-01-01 10:00:00", 1), ("A", "x", "2025-01-01 10:00:00", 1), ("A", None, "2025-01-01 10:00:00", 1)]
    batch = sorted({(s, u) for s, u, _, _ in first if u})
    assert feed(first) == batch
    assert feed([("A", "hot", "2025-01-01 20:00:00", 99)]) == batch  # inside the retention period
    feed([("A", "later", "2025-01-05 00:00:00", 1)])  # moves the watermark past it
    assert feed([("A", "hot", "2025-01-05 01:00:00", 100)]).count(("A", "hot")) == 2


def test_category_counts_drop_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def feed(rows):
        spark.createDataFrame(rows, "t string, categories array<string>").select(F.col("t").cast("timestamp").alias("published_ts"), "categories").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("published_ts timestamp, categories array<string>").parquet(src)
        jobs.run_to_table(jobs.stream_category_counts(stream), out, ck).awaitTermination()

    feed([("2025-01-01 01:00:00", ["a", "b"]), ("2025-01-01 02:00:00", None), ("2025-01-02 00:00:00", ["a"]), ("2025-01-05 00:00:00", ["z"])])
    feed([("2025-01-01 03:00:00", ["late"]), ("2025-01-09 00:00:00", [])])
    got = sorted((str(r.day_start)[:10], r.category, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("2025-01-01", "Other", 1), ("2025-01-01", "a", 1), ("2025-01-01", "b", 1), ("2025-01-02", "a", 1), ("2025-01-05", "z", 1)]


def test_enrichment_merges_and_survives_a_repeat(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    land(src, "a.json", "A", "2025-06-26T10:00:00", ["u1", "u2"])
    run = lambda: jobs.stream_enrich(snapshots.stream_snapshots(spark, str(src)), out, ck).awaitTermination()
    run()
    land(src, "b.json", "A", "2025-06-27T10:00:00", ["u2", "u3"])
    run()
    state = lambda: sorted((r.url, r.batch_id, str(r.snapshot_date)) for r in spark.read.parquet(out).collect())
    want = [("u1", 0, "2025-06-26"), ("u2", 0, "2025-06-26"), ("u3", 1, "2025-06-27")]
    assert state() == want
    # the second batch delivered again, as after a lost driver
    again = snapshots.read_snapshots(spark, str(src / "b.json"))
    jobs.merge_batch(again, 1, out)
    assert state() == want
    assert spark.read.parquet(out).filter("insights.primary_category = 'product'").count() == 3


def test_stream_equals_batch_dedup(spark, tmp_path, docs):
    src = str(tmp_path / "docs")
    docs.write.parquet(src)
    stream = spark.readStream.schema(docs.schema).parquet(src)
    got = jobs.drain(spark, jobs.stream_dedup(stream), "t").select("sector", "url")
    want = selection.dedup_by_url(docs).select("sector", "url")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_counts_with_open_windows_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("published_ts"), F.array(F.concat(F.lit("c"), F.col("id") % 3)).alias("categories"))
    rows.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.drain_all(spark, jobs.stream_category_counts(stream), "all").collect()
    want = jobs.stream_category_counts(spark.read.parquet(src)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.n for r in got) == 100


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda names: spark.createDataFrame([("S", n, 1) for n in names], "sector string, url string, v int")
    assert keys.known(rows(["a"]), path, 0, jobs.KEYS) is None
    keys.add(rows([f"u{i}" for i in range(500)]), path, 0, jobs.KEYS)
    keys.add(rows(["x", "y", "y"]), path, 1, jobs.KEYS)
    few = rows(["u7", "x", "new"])
    found = keys.known(few, path, 2, jobs.KEYS)
    assert {r.url for r in found.collect()} == {"u7", "x"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*IN", plan)
    # a repeated batch does not know its own keys, and replaces them
    assert {r.url for r in keys.known(few, path, 1, jobs.KEYS).collect()} == {"u7"}
    keys.add(rows(["z"]), path, 1, jobs.KEYS)
    assert {r.url for r in keys.known(rows(["x", "z"]), path, 2, jobs.KEYS).collect()} == {"z"}


def test_compacted_keys_are_the_same_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda names: spark.createDataFrame([("S", n) for n in names], "sector string, url string")
    for b in range(4):
        keys.add(rows([f"u{b}", "again"]), path, b, jobs.KEYS)
    everything = rows(["u0", "u1", "u2", "u3", "u4", "again"])
    want = {"u0", "u1", "u2", "u3", "again"}
    assert {r.url for r in keys.known(everything, path, 4, jobs.KEYS).collect()} == want
    keys.compact(everything, path, 2, jobs.KEYS)
    keys.compact(everything, path, 1, jobs.KEYS)
    assert {r.url for r in keys.known(everything, path, 4, jobs.KEYS).collect()} == want
    # a base without its mark, as after a lost driver, does not count
    rows(["ghost"]).write.parquet(path + "/base/upto=3/bucket=5")
    assert "ghost" not in {r.url for r in keys.known(rows(["ghost"]), path, 4, jobs.KEYS).collect()}
    keys.add(rows(["u4"]), path, 4, jobs.KEYS)
    assert {r.url for r in keys.known(everything, path, 5, jobs.KEYS).collect()} == want | {"u4"}


def test_enrichment_of_a_table_without_a_key_store(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    out = str(tmp_path / "out")
    land(src, "a.json", "A", "2025-06-26T10:00:00", ["u1", "u2"])
    land(src, "b.json", "A", "2025-06-27T10:00:00", ["u2", "u3"])
    read = lambda name: snapshots.read_snapshots(spark, str(src / name))
    jobs.merge_batch(read("a.json"), 0, out)
    spark.read.parquet(out).write.partitionBy("batch_id", "snapshot_date").parquet(str(tmp_path / "old"))
    jobs.merge_batch(read("b.json"), 1, str(tmp_path / "old"))
    assert sorted((r.url, r.batch_id) for r in spark.read.parquet(str(tmp_path / "old")).collect()) == [("u1", 0), ("u2", 0), ("u3", 1)]
    # with a base made of earlier batches
    monkeypatch.setattr(keys, "COMPACT_AFTER", 2)
    jobs.merge_batch(read("b.json"), 1, out)
    land(src, "c.json", "A", "2025-06-28T10:00:00", ["u1", "u3", "u4"])
    jobs.merge_batch(read("c.json"), 2, out)
    assert sorted((r.url, r.batch_id) for r in spark.read.parquet(out).collect()) == [("u1", 0), ("u2", 0), ("u3", 1), ("u4", 2)]


def test_tables_made_on_the_way_are_removed(spark, tmp_path):
    made = []

    def make():
        made.append(scratch_path(spark, "on-the-way"))
        spark.range(5).write.parquet(made[0])
        return spark.read.parquet(made[0]).filter("id > 2")

    rows, path = settled(spark, make, "kept")
    assert sorted(r.id for r in rows.collect()) == [3, 4]
    assert os.path.isdir(path) and not os.path.exists(made[0])
    with pytest.raises(RuntimeError), discarding(spark):
        lost = scratch_path(spark, "lost")
        spark.range(1).write.parquet(lost)
        raise RuntimeError
    assert not os.path.exists(lost)
    remove(spark, path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("name", ["stream_category_counts_all", "stream_enrich", "stream_enrich_records"])
def test_stream_reads_a_table_of_part_files(spark, tmp_path, name):
    from catalog.queries import REGISTRY

    docs = spark.createDataFrame([(i, f"The number {i} of the house. It is {'big' if i % 2 else 'small'}.", "en", "web", 30) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    folder, single = tmp_path / "folder", tmp_path / "single"
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(single / "made"))
    os.link(next((single / "made").glob("part-*.parquet")), single / "documents.parquet")
    got, want = (sorted(map(str, REGISTRY[name](spark, str(sf)).collect())) for sf in (folder, single))
    assert got == want and got


def test_all_windows_of_a_stream_without_rows(spark, tmp_path):
    kind = "published_ts timestamp, categories array<string>"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema(kind).parquet(str(tmp_path / "rows"))
    assert jobs.drain_all(spark, jobs.stream_category_counts(rows), "no-rows").collect() == []
