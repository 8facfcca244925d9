import os

from flowsentry.sources import tail


def test_lines_arrive_once_and_whole(spark, tmp_path):
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_bytes(b"one\ntwo\nthr")

    def start():
        stream = tail.tail_auth_log(spark, str(logs), range_bytes=5)
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()

    def rows():
        return sorted((os.path.basename(r.file), r.line) for r in spark.read.parquet(out).collect())

    q = start()
    q.processAllAvailable()
    assert rows() == [("a.log", "one"), ("a.log", "two")]
    with a.open("ab") as f:
        f.write(b"ee\n\nfour\n")
    b.write_bytes(b"first \xff\n")
    q.processAllAvailable()
    want = [("a.log", "four"), ("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "first �")]
    assert rows() == want
    q.stop()
    with a.open("ab") as f:
        f.write(b"five\nsi")
    q = start()  # goes on from its checkpoint
    q.processAllAvailable()
    assert rows() == sorted([*want, ("a.log", "five")])
    a.write_bytes(b"new\n")  # written anew
    q.processAllAvailable()
    q.stop()
    assert rows() == sorted([*want, ("a.log", "five"), ("a.log", "new")])


def test_only_what_is_written_from_now_on(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"old\n" * 5)
    reader = tail.TailReader({"path": str(tmp_path), "fromend": "true", "range": "6"})
    begin = reader.initialOffset()
    with (tmp_path / "a.log").open("ab") as f:
        f.write(b"x" * 200_000 + b"\nnew\nunfinished" + b"y" * 100_000)
    pieces = reader.partitions(begin, reader.latestOffset())
    lines = [t for p in pieces[:2] + pieces[-3:] for batch in reader.read(p) for t in batch.column(2).to_pylist()]
    assert lines == ["x" * 200_000, "new"] and reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
