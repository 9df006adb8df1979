"""The tailing source: growing logs, cut lines, restarts, pieces."""

import json
import os

import pytest

from quillon.sources import tail

KIND = "id long, t string"


def drain(spark, root, which=0):
    rows = tail.tail_jsonl(spark, f"{root}/log", KIND)[which]
    rows.writeStream.format("parquet").option("path", f"{root}/out{which}").option("checkpointLocation", f"{root}/c{which}").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{root}/out{which}").collect()))


def test_a_growing_log(spark, tmp_path):
    os.mkdir(tmp_path / "log")
    line = lambda i: json.dumps({"id": i, "t": "é" * (i % 5)}, ensure_ascii=False).encode() + b"\n"
    a, b = tmp_path / "log/a.jsonl", tmp_path / "log/b.jsonl"
    (tmp_path / "log/_skip").write_bytes(line(99))
    half = line(3)
    a.write_bytes(line(1) + b"\n  \n" + line(2) + half[:9])
    want = [(1, "é"), (2, "éé")]
    assert drain(spark, tmp_path) == want
    with open(a, "ab") as f:  # the cut line comes once it is whole; another file begins
        f.write(half[9:] + b'{"id": oops}\n' + line(4)[:-1])
    b.write_bytes(line(5))
    want += [(3, "ééé"), (5, "")]
    assert drain(spark, tmp_path) == want
    with open(a, "ab") as f:
        f.write(b"\n")
    want += [(4, "éééé")]
    assert drain(spark, tmp_path) == sorted(want)
    assert drain(spark, tmp_path) == sorted(want)  # nothing new
    broken = drain(spark, tmp_path, 1)
    assert [(o, t) for _, o, t in broken] == [(len(line(1) + b"\n  \n" + line(2) + half), '{"id": oops}')]
    a.write_bytes(line(1))
    with pytest.raises(Exception, match="may only grow"):
        drain(spark, tmp_path)


@pytest.mark.parametrize("part", [1, 7, 64, 1000])
def test_pieces_are_cut_between_lines(tmp_path, monkeypatch, part):
    monkeypatch.setattr(tail, "PART", part)
    monkeypatch.setattr(tail, "BLOCK", 5)
    os.mkdir(tmp_path / "log")
    lines = ["x" * (i * 7 % 23) or "-" for i in range(60)] + ["long" * 50]
    (tmp_path / "log/a").write_text("\n".join(lines) + "\ncut")
    reader = tail._Reader({"path": f"{tmp_path}/log"})
    end = reader.latestOffset()
    rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["line"] for r in rows] == lines and [r["offset"] for r in rows] == [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    assert reader.partitions(end, end) == []
