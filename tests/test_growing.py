"""Files read by byte range, whole and while they grow."""

import random

import pytest

from millrace.sources import files, ranges
from millrace.streaming import core, growing


def lines_of(data: bytes):
    out, at = [], 0
    for part in data.split(b"\n"):
        out.append((at, part.decode("utf-8", "replace")))
        at += len(part) + 1
    return out[:-1] if data.endswith(b"\n") or not data else out


def records_of(data: bytes):
    """Lines of which none ends inside quotes, character by character."""
    out, begin, odd = [], 0, False
    for at, c in enumerate(data):
        odd ^= c == 34
        if c == 10 and not odd:
            out.append((begin, data[begin:at].decode()))
            begin = at + 1
    return out + [(begin, data[begin:].decode())] * (begin < len(data))


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_lines_by_range(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "TASKS", 3)
    rng = random.Random(size)
    given = {}
    for i, end in enumerate((b"\n", b"", b"x")):
        data = b"\n".join(bytes(rng.choice(b"ab,\"\r") for _ in range(rng.choice((0, 1, 2, 9, 60)))) for _ in range(12)) + end
        (tmp_path / f"f{i}.txt").write_bytes(data)
        given[str(tmp_path / f"f{i}.txt")] = data
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    got = [("/" + r["file"].removeprefix("file:").lstrip("/"), *r[1:]) for r in ranges.read_lines(spark, str(tmp_path), size=size).collect()]
    want = [(f, i + 1, at, text) for f, data in given.items() for i, (at, text) in enumerate(lines_of(data))]
    assert sorted(got) == sorted(want)
    got = [("/" + r["file"].removeprefix("file:").lstrip("/"), *r[1:]) for r in ranges.read_lines(spark, str(tmp_path), quotes=True, size=size).collect()]
    want = [(f, i + 1, at, text) for f, data in given.items() for i, (at, text) in enumerate(records_of(data))]
    assert sorted(got) == sorted(want)


def test_quoted_line_ends_over_range_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "TASKS", 4)
    rows = [(i, f'line "{i}"\nand, more\r\n' * (i % 4) or None, "é") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, said string, c string")
    files.write_csv(df.coalesce(2), str(tmp_path / "csv"))
    for size in (5, 33, 1 << 20):
        assert sorted(map(tuple, ranges.read_csv(spark, str(tmp_path / "csv"), df.schema, size=size).collect())) == rows


def test_last_lines(tmp_path):
    (tmp_path / "f").write_bytes(b"a\nbb\nccc\nd")
    fs, path = ranges.file_system(str(tmp_path / "f"))
    assert [ranges.line_start(fs, path, 10, n) for n in range(5)] == [9, 5, 2, 0, 0]
    (tmp_path / "long").write_bytes(b"x" * 200_000 + b"\n" + b"y" * 70_000)
    assert ranges.line_start(fs, str(tmp_path / "long"), 270_001) == 200_001


def test_growing_files(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    a, b = folder / "a.txt", folder / "b.txt"
    run = lambda: sorted((r["path"][-5:], r["position"], r["value"]) for r in core.run_available(growing.follow_lines(spark, f"file://{folder}", range_bytes=4), base).collect())
    a.write_bytes("one\nzwölf\nhal".encode())
    want = [("a.txt", 0, "one"), ("a.txt", 4, "zwölf")]
    assert run() == want
    assert run() == want  # nothing new
    with open(a, "ab") as f:
        f.write(b"f line\n\nend\nopen")
    b.write_bytes(b"other\n")
    want += [("a.txt", 11, "half line"), ("a.txt", 21, ""), ("a.txt", 22, "end"), ("b.txt", 0, "other")]
    assert run() == want
    b.write_bytes(b"new\n")  # replaced by a shorter file
    assert run() == sorted([*want, ("b.txt", 0, "new")])


def test_growing_file_from_its_last_lines(spark, tmp_path):
    f = tmp_path / "log"
    f.write_bytes(b"1\n2\n3\n4")
    run = lambda: [r["value"] for r in core.run_available(growing.follow_lines(spark, str(f), last_lines=2), str(tmp_path / "o")).orderBy("position").collect()]
    run()
    with open(f, "ab") as out:
        out.write(b"4\n5\n")
    assert run() == ["2", "3", "44", "5"]


def test_encodings_are_read_from_the_head(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a,é\r\n".encode())
    (tmp_path / "b.csv").write_bytes(b"x" * 200_000 + b"\xff")  # what is wrong stands behind the head
    (tmp_path / "c.csv").write_bytes("日本\n".encode("cp932"))
    got = {r["path"][-5:]: (r["encoding"], r["newline"]) for r in files.detect_encoding(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("utf-8", "CRLF"), "b.csv": ("utf-8", "LF"), "c.csv": ("cp932", "LF")}
