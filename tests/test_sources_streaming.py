import hashlib
import json

import pytest

from ledgerlake.operators.rules import compile_ignore_rules
from ledgerlake.sources.files import scan_files, walk_tree
from ledgerlake.sources.journals import read_journals
from ledgerlake.sources.tables import append_records, current_etag, insert_absent, replace_if_match, upserted, write_version
from ledgerlake.streaming.replay import record_stream, replay, replayed


def test_scan_of_a_tree(spark, tmp_path):
    for name, data in {"a.txt": b"x" * 10, "d/e/b.bin": b"y" * 5000, "d/c.log": b"", "d/é f.txt": b"z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r for r in scan_files(spark, str(tmp_path), compile_ignore_rules(["*.log"])).collect()}
    assert set(rows) == {"a.txt", "d/e/b.bin", "d/é f.txt"}
    r = rows["d/e/b.bin"]
    assert (r.length, r.full_hash, r.tail_hash) == (5000, hashlib.md5(b"y" * 5000).hexdigest(), hashlib.md5(b"y" * 4096).hexdigest())
    assert rows["a.txt"].head_hash == rows["a.txt"].full_hash


def test_walk_of_a_tree(spark, tmp_path):
    for name in ("a.txt", ".hidden", "_x/b.bin", "d/e/f.log", "d/g/h.txt", "skip/deep/er.txt", "out/in/k.txt", "out/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "bare/only").mkdir(parents=True)
    (tmp_path / "link").symlink_to("d/e")
    (tmp_path / "a.txt").chmod(0o640)
    scope = spark.createDataFrame([("out", False), ("out/in", True)], "prefix string, included boolean")
    rows = {r.path: r for r in walk_tree(spark, str(tmp_path), compile_ignore_rules(["skip/", "*.log"]), scope, symlinks=True).collect()}
    assert {p: r.kind for p, r in rows.items()} == {"a.txt": "file", ".hidden": "file", "_x/b.bin": "file", "d/g/h.txt": "file", "out/in/k.txt": "file", "link": "symlink", "d/e": "empty", "bare/only": "empty"}
    assert (rows["a.txt"].length, rows["a.txt"].permissions, rows["link"].target) == (5, "0640", "d/e")
    assert rows["a.txt"].mtime_ticks == (tmp_path / "a.txt").stat().st_mtime_ns // 100
    assert "link" not in {r.path for r in walk_tree(spark, str(tmp_path)).collect()}
    missing = walk_tree(spark, f"{tmp_path}/none").collect()
    assert [(r.path, r.kind, r.is_directory, r.reason) for r in missing] == [("", "unreadable", True, "No such file or directory")]


def test_journals_with_bad_lines(spark, tmp_path):
    head = json.dumps({"run_id": "r1", "config_id": 1, "started_at": "2024-01-01T00:00:00Z", "baseline_version": 3})
    record = json.dumps({"kind": "blob", "ref": "data/h", "path": "p", "length": 5})
    (tmp_path / "good.jsonl").write_text(f"{head}\n{record}\nnot json\n\n{record[:20]}")
    (tmp_path / "void.jsonl").write_text(f"oops\n{record}\n")
    (tmp_path / "empty.jsonl").write_text("")
    rows = read_journals(spark, str(tmp_path)).collect()
    assert [(r.run_id, r.line_no, r.ref, r.length, r.mtime_utc_ticks) for r in rows] == [("r1", 1, "data/h", 5, None)]


def test_journals_longer_than_a_split(spark, tmp_path):
    """Lines keep their numbers and their file's header over splits, and no row holds a whole journal."""
    (tmp_path / "in").mkdir()
    for run in ("r1", "r2"):
        lines = [json.dumps({"kind": "blob", "ref": f"{run}-{i}", "path": "p" * (i % 50), "length": i}) for i in range(3000)]
        lines[1000:1000] = ["", "  ", "broken"]
        (tmp_path / f"in/{run}.jsonl").write_text("\n".join(["", json.dumps({"run_id": run}), *lines]))
    (tmp_path / "in/void.jsonl").write_text("\n".join(["oops", json.dumps({"run_id": "r3"}), *lines]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = read_journals(spark, f"{tmp_path}/in")
        assert "explode" not in rows._jdf.queryExecution().toString()
        got = sorted((r.run_id, r.line_no, r.ref) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == sorted((run, i + 1 + (i >= 1000), f"{run}-{i}") for run in ("r1", "r2") for i in range(3000))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "path string, length long")
    assert write_version(rows, f"{tmp_path}/v", 1) == 2 and write_version(rows.limit(1), f"{tmp_path}/v", 2) == 1
    with pytest.raises(ValueError, match="already"):
        write_version(rows, f"{tmp_path}/v", 1)
    assert write_version(rows.limit(0), f"{tmp_path}/v", 3) == 0 and spark.read.parquet(f"{tmp_path}/v").groupBy("version").count().count() == 2
    first = replace_if_match(rows, f"{tmp_path}/i", None)
    second = replace_if_match(rows.limit(1), f"{tmp_path}/i", first)
    for old in (None, first):
        with pytest.raises(ValueError, match="changed"):
            replace_if_match(rows, f"{tmp_path}/i", old)
    assert current_etag(spark, f"{tmp_path}/i") == second and spark.read.parquet(f"{tmp_path}/i/etag={second}").count() == 1
    journal = spark.createDataFrame([("r1", "p"), ("r2", "q")], "ref string, path string")
    append_records(journal, f"{tmp_path}/j", spark.createDataFrame([("r2",)], "ref string"))
    assert [r.path for r in spark.read.json(f"{tmp_path}/j").collect()] == ["q"]
    insert_absent(rows, f"{tmp_path}/k", ["path"])
    insert_absent(spark.createDataFrame([("b", 9), ("c", 3), (None, 4)], rows.schema), f"{tmp_path}/k", ["path"])
    kept = spark.read.parquet(f"{tmp_path}/k")
    assert sorted((r.path, r.length) for r in kept.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted((r.path, r.length) for r in upserted(kept, spark.createDataFrame([("b", 9)], rows.schema), ["path"]).collect()) == [("a", 1), ("b", 9), ("c", 3)]


def test_replayed_stream_keeps_the_newest(spark, tmp_path):
    record = lambda run, at, line, ref: json.dumps({"run_id": run, "started_at": at, "line_no": line, "kind": "blob", "path": "p", "ref": ref}) + "\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(record("r2", "2024-01-02T00:00:00Z", 1, "newest") + record("r2", "2024-01-02T00:00:00Z", 2, "later line"))
    args = f"{tmp_path}/out", f"{tmp_path}/ck"
    replay(record_stream(spark, f"{tmp_path}/in"), *args).awaitTermination()
    (tmp_path / "in/2.json").write_text(record("r1", "2024-01-01T00:00:00Z", 1, "older"))
    replay(record_stream(spark, f"{tmp_path}/in"), *args).awaitTermination()
    assert [(r.path, r.ref) for r in replayed(spark, args[0]).collect()] == [("p", "newest")]
