"""Sources, sinks and streams."""

from __future__ import annotations

import pytest

from codeloom.sources import manifest, workspace
from codeloom.streaming import snapshots


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "big.py").write_text("y" * 100)
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "node_modules" / "c.js").write_text("no")
    (tmp_path / "package.json").write_text("{}")
    files = workspace.scan_workspace(spark, str(tmp_path), size_cap=50)
    got = files.collect()
    assert [(r["path"].rsplit("/", 1)[1], r["language"], r["content"]) for r in got] == [("a.py", "python", "x = 1")]
    overlay = spark.createDataFrame([(got[0]["path"], "x = 2")], "path string, content string")
    assert workspace.with_overlay(files, overlay).first()["content"] == "x = 2"
    roots = workspace.package_roots(spark, str(tmp_path)).first()
    assert (list(roots["ecosystems"]), list(roots["manifests"])) == (["npm"], ["package.json"])
    one, other = (workspace.fingerprint(f).first()[0] for f in (files, files.repartition(3)))
    assert one == other != workspace.fingerprint(files, "config").first()[0]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "function")], "id string, kind string")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source_id string, target_id string")
    workspace.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = workspace.read_graph(spark, str(tmp_path / "g"), "id string, kind string", "id string, source_id string, target_id string")
    assert n.collect() == nodes.collect() and e.collect() == edges.collect()


def test_manifest(spark, tmp_path):
    files = [("/b.py", "python", "z" * 90), ("/a.tsx", "typescriptreact", "é" * 3)]
    data = manifest.encode_manifest(files)
    assert data.startswith(f"{manifest.VERSION}\n2\n6\n10\n6\n/a.tsxtypescript".encode())
    assert [r[0] for r in manifest.decode_manifest(data, 50)] == ["/a.tsx"]
    for bad, why in ((data + b"\x00", "trailing"), (data[:-1], "inside a record"), (data.replace(b"-v1", b"-v9"), "version"), (b"", "no line end"), (f"{manifest.VERSION}\n10001\n".encode(), "over 10000"), (f"{manifest.VERSION}\n1\n0\n1\n0\nx".encode(), "empty path")):
        with pytest.raises(ValueError, match=why):
            list(manifest.decode_manifest(bad, 500))
    (tmp_path / "m.bin").write_bytes(data)
    spark.dataSource.register(manifest.ManifestDataSource)
    want = [("/a.tsx", 6, "ééé"), ("/b.py", 90, "z" * 90)]
    for got in (spark.read.format("code_manifest").option("path", str(tmp_path / "*.bin")).load(), manifest.read_manifests(spark, str(tmp_path / "*.bin"))):
        assert [(r["path"], r["size"], r["content"]) for r in got.collect()] == want
    frame = spark.createDataFrame([(p, manifest.WRITTEN_AS.get(x, x), c) for p, x, c in files], "path string, language string, content string")
    assert manifest.size_in_bytes(frame).first()[0] == len(data)
    manifest.write_manifest(frame, str(tmp_path / "written"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "written").glob("part-*"))
    assert written.removesuffix(b"\x00") == data


def test_globs(spark):
    paths = ["a.py", "src/b.ts", "src/deep/c.py", "node_modules/d.py", "src/e.txt"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = lambda *a, **k: [r["path"] for r in workspace.find_source_files(files, *a, **k).collect()]
    assert found("**/*.{py,ts}", "node_modules/**") == ["a.py", "src/b.ts", "src/deep/c.py"]
    assert found("*.py") == ["a.py"] and found("src/?.*") == ["src/b.ts", "src/e.txt"]
    assert found("**/*.py", limit=2) == ["a.py", "node_modules/d.py"]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "view", 1.0, "/a", "h"), (1, "2024-01-01 00:10:00", "view", 2.0, "/a", "h"), (2, "2024-01-01 03:00:00", "buy", 3.0, "/b", "h")]
    spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double, path string, content_hash string").selectExpr("user_id", "CAST(ts AS timestamp) AS ts", "event_type", "value", "path", "content_hash").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double, path string, content_hash string").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("latest", snapshots.latest_snapshots(stream), "append", 2), ("activity", snapshots.activity(stream), "complete", 2), ("sessions", snapshots.sessions(stream), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_scan_below_excluded_names(spark, tmp_path):
    """A workspace below folders named like excluded ones is scanned; such folders inside it, and its cache, are not."""
    root = tmp_path / "target" / "build" / "ws"
    for folder in ("src", "out", "tool-cache", "pkg/dist"):
        (root / folder).mkdir(parents=True)
        (root / folder / "a.py").write_text("x = 1")
        (root / folder / "package.json").write_text("{}")
    for form in (str(root), f"{root}/", f"file:{root}", f"file://{root}"):
        got = [r["path"].split("/ws/")[1] for r in workspace.scan_workspace(spark, form, cache_folder="tool-cache").collect()]
        assert got == ["src/a.py"]
        assert [r["root"].split("/ws/")[1] for r in workspace.package_roots(spark, form, "tool-cache").collect()] == ["src"]
    assert {r["path"].split("/ws/")[1] for r in workspace.scan_workspace(spark, str(root)).collect()} == {"src/a.py", "tool-cache/a.py"}


def test_newest_snapshots_in_keyed_state(spark, tmp_path):
    """Late, repeated and out-of-order batches leave what the whole table says; every change tells what it retires."""
    import random

    rnd = random.Random(4)
    rows = [(f"/p{rnd.randint(0, 9)}", rnd.randint(0, 30), f"h{rnd.randint(0, 3)}") for _ in range(120)]
    batches = [rows[:40], rows[40:80], rows[:40], [], rows[80:], rows[20:60]]
    schema = "path string, version long, content_hash string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{source}/b{n}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/b*")
        query = snapshots.follow_snapshots(stream, out, checkpoint)  # each time from where the last one ended
        query.awaitTermination()
        seen = [r for b in batches[: n + 1] for r in b]
        want = snapshots.newest(spark.createDataFrame(seen, schema)).collect()
        assert sorted(snapshots.current(spark, out).collect()) == sorted(want)
    changes = spark.read.parquet(f"{out}/batch=*").collect()
    made = {(r["path"], r["version"], r["content_hash"]) for r in changes}
    assert len(made) == len(changes)
    for r in changes:
        assert r["retired_version"] is None or ((r["path"], r["retired_version"], r["retired_hash"]) in made and (r["retired_version"], r["retired_hash"]) < (r["version"], r["content_hash"]))
