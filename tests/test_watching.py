"""Listings, moves, handlers, rounds that go on after a restart, and mirrors, on small folders."""

import os

import pytest

from sigloom.__main__ import run
from sigloom.operators import catalog, watching

DAY = "2020-01-01T00-00-00"


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "a"
    for channel in ("x/ch0", "y/ch0"):
        for k in range(3):
            _put(at / channel / DAY / f"rf@{1577836800 + k}.000.h5", f"{channel} {k}")
            _put(at / channel / "metadata" / DAY / f"md@{1577836800 + k}.h5", f"md {channel} {k}")
        _put(at / channel / "drf_properties.h5", channel)
    _put(at / "x/ch0" / DAY / "rf@1577836809.000.h5", "")
    _put(at / "x/ch0" / DAY / "tmp.rf@1577836810.000.h5", "half")
    return at


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def _held(at):
    return {str(p.relative_to(at)): p.read_text() for p in at.rglob("*") if p.is_file()}


def test_walk(spark, root, tmp_path):
    got = watching.walk(spark, str(root), str(tmp_path / "s")).collect()
    assert {r["path"]: r["size"] for r in got} == {f"file:{root}/{k}": len(v) for k, v in _held(root).items()}
    assert {r["kind"] for r in got} == {"data", "metadata", "properties", None}
    assert watching.walk(spark, str(root / "none"), str(tmp_path / "t")).count() == 0


def _listing(spark, rows):
    return spark.createDataFrame([(p, s, 0 if len(x) < 1 else x[0], m) for p, s, m, *x in rows], "path string, size long, mtime long, mark string")


def _told(df):
    return sorted(((r["event"], r["path"], r["dest"]) for r in df.collect()), key=str)


def test_moves(spark):
    old = [("a/1", 5, "m"), ("a/2", 5, "m"), ("a/3", 5, "m"), ("a/4", 7, "m"), ("a/5", 1, None), ("a/6", 9, "k"), ("a/7", 9, "q")]
    new = [("b/2", 5, "m"), ("b/9", 5, "m"), ("a/6", 9, "k", 1), ("b/5", 1, None), ("a/7", 9, "q"), ("b/0", 2, "q")]
    want = [("moved", "a/2", "b/2"), ("moved", "a/1", "b/9"), ("deleted", "a/3", None), ("deleted", "a/4", None), ("deleted", "a/5", None), ("created", "b/5", None), ("created", "b/0", None), ("modified", "a/6", None)]
    got = _told(watching.events(_listing(spark, old), _listing(spark, new)))
    # a/1 and a/3 are alike, either may be the one that moved: by their hashes' order
    assert [e for e in got if e[1] not in ("a/1", "a/3")] == sorted((e for e in want if e[1] not in ("a/1", "a/3")), key=str)
    assert {(e, d) for e, p, d in got if p in ("a/1", "a/3")} == {("moved", "b/9"), ("deleted", None)}


def test_many_of_one_mark(spark):
    old, new = ([(f"{x}/{k:04d}{x}", 0, "empty") for k in range(n)] for x, n in (("a", 700), ("b", 500)))
    got = _told(watching.events(_listing(spark, old), _listing(spark, new)))
    moved = [e for e in got if e[0] == "moved"]
    assert len(moved) == 500 == len({e[1] for e in moved}) == len({e[2] for e in moved})
    assert len(got) == 700 and sum(e[0] == "deleted" for e in got) == 200


def test_wanted(spark):
    name = "rf@{}.000.h5".format
    told = spark.createDataFrame([("moved", f"c/{name(5)}", f"c/{name(50)}"), ("moved", f"c/{name(50)}", f"c/{name(5)}"), ("moved", f"c/tmp.{name(7)}", f"c/{name(7)}"), ("moved", f"c/{name(1)}", f"c/{name(2)}"), ("created", "c/md@3.h5", None), ("deleted", "c/drf_properties.h5", None), ("created", "c/else", None)], "event string, path string, dest string")
    got = _told(watching.wanted(told, None, 10_000, metadata=False))
    assert got == sorted([("deleted", f"c/{name(5)}", None), ("created", f"c/{name(5)}", None), ("created", f"c/{name(7)}", None), ("moved", f"c/{name(1)}", f"c/{name(2)}"), ("deleted", "c/drf_properties.h5", None)], key=str)


def test_rounds(spark, root, tmp_path):
    state, lists = str(tmp_path / "state"), iter(range(100))
    files = lambda: watching.walk(spark, str(root), str(tmp_path / f"w{next(lists)}"))
    heard = []
    hear = lambda told: heard.append(_told(told))
    assert watching.Watcher(spark, state).poll(files(), hear) == 0
    assert {e[0] for e in heard[-1]} == {"created"} and len(heard[-1]) == len(_held(root))
    os.rename(root / "x/ch0" / DAY / "rf@1577836800.000.h5", root / "x/ch0" / DAY / "rf@1577836899.000.h5")
    _put(root / "x/ch0" / DAY / "rf@1577836801.000.h5", "longer than before")
    (root / "y/ch0/drf_properties.h5").unlink()

    def fail(told):
        raise RuntimeError("handler")

    with pytest.raises(RuntimeError, match="handler"):
        watching.Watcher(spark, state).poll(files(), fail)
    # what comes after the listing of a round that was not heard is a later round's
    _put(root / "y/ch0" / DAY / "rf@1577836899.000.h5", "new")
    base = f"file:{root}/x/ch0/{DAY}"
    again = watching.Watcher(spark, state)
    assert again.poll(files(), hear) == 1
    assert heard[-1] == sorted([("moved", f"{base}/rf@1577836800.000.h5", f"{base}/rf@1577836899.000.h5"), ("modified", f"{base}/rf@1577836801.000.h5", None), ("deleted", f"file:{root}/y/ch0/drf_properties.h5", None)], key=str)
    assert again.poll(files(), hear) == 2 and heard[-1] == [("created", f"file:{root}/y/ch0/{DAY}/rf@1577836899.000.h5", None)]
    assert again.poll(files(), hear) == 3 and heard[-1] == []
    counts = {}
    watching.dispatch(_events(spark), {e: lambda df, e=e: counts.update({e: df.count()}) for e in ("created", "moved")})
    assert counts == {"created": 2, "moved": 1}
    with pytest.raises(ValueError):
        watching.dispatch(_events(spark), {"renamed": print})


def _events(spark):
    return spark.createDataFrame([("created", "a", None), ("created", "b", None), ("moved", "c", "d"), ("deleted", "e", None)], "event string, path string, dest string")


def test_mirror_move(spark, root, tmp_path):
    before, to = _held(root), tmp_path / "b"
    want = {k: v for k, v in before.items() if "tmp." not in k}
    # a file of the same size and other bytes is sent, one of the same bytes is not
    _put(to / "x/ch0" / DAY / "rf@1577836800.000.h5", before[f"x/ch0/{DAY}/rf@1577836800.000.h5"])
    _put(to / "x/ch0" / DAY / "rf@1577836801.000.h5", "X/ch0 1")
    assert run(spark, ["mirror", str(root), str(to), "--method", "move"]) == [f"{len(want) - 1} files"]
    assert _held(to) == want
    # of each channel the newest metadata, properties, names in progress and what the target had stay
    left = set(_held(root))
    assert left == {"x/ch0/drf_properties.h5", "y/ch0/drf_properties.h5", f"x/ch0/{DAY}/tmp.rf@1577836810.000.h5", f"x/ch0/{DAY}/rf@1577836800.000.h5", f"x/ch0/metadata/{DAY}/md@1577836802.h5", f"y/ch0/metadata/{DAY}/md@1577836802.h5"}
    assert not (root / "y/ch0" / DAY).exists()


def test_link_and_applying(spark, root, tmp_path):
    to = tmp_path / "b"
    assert run(spark, ["mirror", str(root), str(to), "--ignore-existing"]) == ["4 files"]
    assert set(_held(to)) == {f"{c}/ch0/{n}" for c in "xy" for n in ("drf_properties.h5", f"metadata/{DAY}/md@1577836802.h5")}
    run(spark, ["ln", str(root), str(to)])
    one = f"x/ch0/{DAY}/rf@1577836801.000.h5"
    assert os.path.samefile(root / one, to / one) and not list(to.rglob("tmp.*"))
    n = len(_held(to))
    assert run(spark, ["ln", str(root), str(to)]) == [f"{n} files"] and len(_held(to)) == n
    assert catalog.transfer(spark.createDataFrame([(str(root / one),)], "path string"), str(root), str(tmp_path / "c")) == 1


def test_ring_buffer_of_one_name(spark, root):
    assert run(spark, ["ringbuffer", str(root), "--count", "1", "--no-metadata"]) == ["5 files"]
    assert sorted(k for k in _held(root) if "/rf@" in k) == [f"x/ch0/{DAY}/rf@1577836809.000.h5", f"y/ch0/{DAY}/rf@1577836802.000.h5"]
