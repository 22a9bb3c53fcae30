from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.sources import tail


def test_tail_takes_whole_lines_and_starts_anew(spark, tmp_path):
    """A cut line, growth, a restart, a shrunken file, a file replaced by a longer one, one that can't be read for a while."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    file = lambda name: str(folder / name)

    def put(name, text, how="ab"):
        with open(file(name), how) as f:
            f.write(text.encode())

    seen = set()

    def fresh():
        rows = tail.tailed(spark, str(folder), cursor=str(tmp_path / "cursor")).select(F.element_at(F.split("path", "/"), -1).alias("file"), "position", F.get_json_object("line", "$.t").cast("int").alias("t"))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(60)
        rows = [tuple(r) for r in spark.read.parquet(out).collect()]
        new = sorted(set(rows) - seen)
        assert len(rows) == len(set(rows))
        seen.update(rows)
        return new

    line = lambda n: json.dumps({"t": n}) + "\n"
    put("a.jsonl", line(1) + line(2) + '{"t": ')
    put("b.jsonl", "\n" + line(7).replace("\n", "\r\n"))
    put("c.txt", line(99))
    assert fresh() == [("a.jsonl", 0, 1), ("a.jsonl", 9, 2), ("b.jsonl", 1, 7)]
    put("a.jsonl", "3}\n")
    assert fresh() == [("a.jsonl", 18, 3)]
    assert fresh() == []
    put("a.jsonl", line(40), "wb")
    assert fresh() == [("a.jsonl", 0, 40)]
    put("b.jsonl", line(50) + line(51) + line(52), "wb")
    put("a.jsonl", line(41))
    assert fresh() == [("a.jsonl", 10, 41), ("b.jsonl", 0, 50), ("b.jsonl", 10, 51), ("b.jsonl", 20, 52)]
    os.rename(file("b.jsonl"), file("b.gone"))
    assert fresh() == []
    os.rename(file("b.gone"), file("b.jsonl"))
    put("b.jsonl", line(53))
    assert fresh() == [("b.jsonl", 30, 53)]


@pytest.mark.parametrize("part", [7, 10, 1000])
def test_parts_of_a_file_give_every_line_once(tmp_path, monkeypatch, part):
    monkeypatch.setattr(tail, "PART", part)
    path = tmp_path / "x.jsonl"
    lines = ["a", "", "bcdefghijklmnop", "é", "q" * 40, "z"]
    path.write_text("\n".join(lines) + "\nrest")
    reader = tail.TailReader(str(tmp_path), ".jsonl")
    end = reader.latestOffset()
    got = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["line"] for r in got] == [x for x in lines if x]
    raw = path.read_bytes()
    assert all(raw[r["position"] :].startswith(r["line"].encode()) for r in got)


def test_a_file_that_cannot_be_read_is_held(tmp_path, monkeypatch):
    (tmp_path / "x.jsonl").write_text("1\n2\n")
    reader = tail.TailReader(str(tmp_path), ".jsonl")
    first = reader.latestOffset()
    (tmp_path / "x.jsonl").write_text("1\n2\n3\n")
    real = os.path.getsize
    monkeypatch.setattr(tail.os.path, "getsize", lambda p: (_ for _ in ()).throw(OSError("busy")))
    assert reader.latestOffset() == first
    monkeypatch.setattr(tail.os.path, "getsize", real)
    assert [r["line"] for p in reader.partitions(first, reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()] == ["3"]
