"""Streams of looks, run to their end."""

from symgrid.streaming import watch as W


def test_new_versions_and_windows(spark, tmp_path):
    rows = [("a/x", 1, 1, "2024-01-01 00:00:00"), ("a/x", 1, 1, "2024-01-01 00:00:30"), ("a/x", 2, 1, "2024-01-01 00:01:10"), ("b/y", 1, 5, "2024-01-01 00:00:10"), ("z", 1, 1, "2024-01-01 00:00:20")]
    df = spark.createDataFrame(rows, "path string, mtime long, size long, seen string").selectExpr("path", "mtime", "size", "cast(seen as timestamp) seen")
    df.repartition(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(W.LOOKS).json(f"{tmp_path}/in")

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run(W.new_versions(stream), "versions", "append")
    assert sorted((r["path"], r["mtime"]) for r in got) == [("a/x", 1), ("a/x", 2), ("b/y", 1), ("z", 1)]
    counts = run(W.changes_by_window(stream), "windows", "complete")
    assert sorted((r["folder"], r["start"].minute, r["versions"]) for r in counts) == [("", 0, 1), ("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]


def test_rebuild_only_on_change(spark):
    look = lambda t, rows: spark.createDataFrame([(p, m, 1, t) for p, m in rows], "path string, mtime long, size long, seen string").selectExpr("path", "mtime", "size", "cast(seen as timestamp) seen")
    last, built = {}, []
    build = lambda x: built.append(x.count())
    assert W.rebuild_on_change(look("2024-01-01", [("a", 1), ("b", 1)]), last, build).count() == 2
    assert W.rebuild_on_change(look("2024-01-02", [("a", 1), ("b", 1)]), last, build).count() == 0
    d = W.rebuild_on_change(look("2024-01-03", [("a", 2), ("c", 1)]), last, build)
    assert sorted((r["path"], r["change"]) for r in d.collect()) == [("a", "changed"), ("b", "removed"), ("c", "added")]
    assert built == [2, 2]
