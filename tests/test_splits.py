import random

import pytest

from exposure.sources import tree as T
from exposure.sources.tree import list_tree, read_lines


def whole(path):
    with open(path, encoding="utf-8", errors="replace", newline=None) as f:
        return [line.removesuffix("\n") for line in f]


def noise(seed, n):
    r = random.Random(seed)
    parts = ["\n", "\r", "\r\n", "\n\n", "a", "é日", "word ", "x" * 40]
    return "".join(r.choice(parts) for _ in range(n)).encode() + r.choice([b"", b"\n", b"\r", b"\r\n", b"end", b"\xe2\x82"])


@pytest.mark.parametrize("read", [1, 3, 1 << 20])
def test_ranges_share_out_the_lines_of_a_file(tmp_path, monkeypatch, read):
    monkeypatch.setattr(T, "READ_BYTES", read)
    for seed in range(40):
        path = tmp_path / f"f{seed}"
        path.write_bytes(noise(seed, 60))
        size = path.stat().st_size
        for step in (1, 2, 5, 17, 100, 10_000):
            found = []
            for start in range(0, size, step):
                raw = b"".join(T._pieces(str(path), start, start + step if start + step < size else 1 << 62))
                found += raw.removesuffix(b"\n").split(b"\n") if raw else []
            assert [x.decode("utf-8", "replace") for x in found] == whole(path), (seed, step, read)


def test_numbers_of_lines_over_ranges(spark, tmp_path):
    """A file in many ranges beside short, empty and binary ones: numbers and texts are those of a plain read."""
    (tmp_path / "d").mkdir()
    for seed, n in ((1, 3000), (2, 10), (3, 0)):
        (tmp_path / "d" / f"f{seed}.jsonl").write_bytes(noise(seed, n))
    (tmp_path / "d" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "d" / "binary.jsonl").write_bytes(b"a\0b\n" * 9)
    listing = list_tree(spark, [str(tmp_path / "d")])
    for step in (97, 1 << 20):
        got = {}
        for r in read_lines(listing, step).collect():
            got.setdefault(r.path, {})[r.line_no] = r.raw
        want = {str(p): dict(enumerate(whole(p), 1)) for p in (tmp_path / "d").iterdir() if p.name != "binary.jsonl"}
        assert got == {p: lines for p, lines in want.items() if lines}
    assert read_lines(listing, 97).rdd.getNumPartitions() >= 8


def test_gone_and_grown_files(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_bytes(b"one\ntwo\n" * 20)
    listing = list_tree(spark, [str(tmp_path)]).cache()
    assert listing.count() == 1
    path.write_bytes(b"one\ntwo\n" * 20 + b"three")
    assert [r.raw for r in read_lines(listing, 50).orderBy("line_no").collect()] == ["one", "two"] * 20 + ["three"]
    gone = spark.createDataFrame([(str(tmp_path / "none"), 10)], "path string, length long")
    assert read_lines(gone).collect() == []
