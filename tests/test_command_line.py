"""The command line on a small folder of files."""

from types import SimpleNamespace

import pytest

from sigloom.__main__ import run

NAMES = ["drf_properties.h5", *(f"2020-01-01T00-00-00/rf@{1577836800 + k}.000.h5" for k in range(5)), "2020-01-01T00-00-00/tmp.rf@1577836805.000.h5"]


@pytest.fixture
def root(tmp_path):
    for name in NAMES:
        path = tmp_path / "a" / "ch0" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    return tmp_path / "a"


def _names(lines):
    return [x.rpartition("/")[2] for x in lines]


def test_list(spark, root):
    want = [x.rpartition("/")[2] for x in NAMES[:6]]
    assert _names(run(spark, ["ls", str(root)])) == want
    assert _names(run(spark, ["ls", str(root), "--no-properties", "--reverse"])) == want[:0:-1]
    assert _names(run(spark, ["ls", str(root), "--start", "2020-01-01T00:00:01", "--end", "1577836802", "--no-properties"])) == want[2:4]


def test_copy_and_mirror(spark, root, tmp_path):
    to = tmp_path / "b"
    assert run(spark, ["mirror", str(root), str(to)]) == ["6 files"]
    assert run(spark, ["mirror", str(root), str(to)]) == ["0 files"]
    (to / "ch0" / NAMES[2]).write_bytes(b"")
    assert run(spark, ["mirror", str(root), str(to)]) == ["1 files"]
    assert (to / "ch0" / NAMES[2]).read_bytes() == NAMES[2].encode()
    assert run(spark, ["mv", str(root), str(tmp_path / "c"), "--no-properties"]) == ["5 files"]
    assert sorted(p.name for p in root.rglob("*.h5")) == ["drf_properties.h5", "tmp.rf@1577836805.000.h5"]
    assert (tmp_path / "c" / "ch0" / NAMES[3]).read_bytes() == NAMES[3].encode()


def test_ring_buffer(spark, root):
    assert _names(run(spark, ["ringbuffer", str(root), "--count", "3", "--dry-run"])) == [x.rpartition("/")[2] for x in NAMES[1:3]]
    assert run(spark, ["ringbuffer", str(root), "--count", "3"]) == ["2 files"]
    assert (root / "ch0" / NAMES[0]).exists() and not (root / "ch0" / NAMES[1]).exists() and (root / "ch0" / NAMES[3]).exists()
    assert run(spark, ["ringbuffer", str(root), "--count", "3"]) == ["0 files"]


def test_watch(spark, root, tmp_path, monkeypatch):
    from sigloom import __main__ as cli

    def change(_):
        (root / "ch0" / NAMES[1]).unlink()
        (root / "ch0" / NAMES[2]).write_bytes(b"longer than it was before, by some bytes")
        (root / "ch0" / "2020-01-01T00-00-00" / "rf@1577836809.000.h5").write_bytes(b"new")

    monkeypatch.setattr(cli, "time", SimpleNamespace(sleep=change))
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    lines = run(spark, ["watch", str(root), "--rounds", "1"])
    assert [x.split()[0] + " " + x.rpartition("/")[2] for x in lines] == ["deleted rf@1577836800.000.h5", "modified rf@1577836801.000.h5", "created rf@1577836809.000.h5"]
