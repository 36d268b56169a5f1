"""Retention by thresholds against a ring buffer that drops one file after the other."""

import random

import pytest

from sigloom.operators import catalog

DAY = 86_400_000


def _drop_one_by_one(files, size, trigger):
    """What goes of files (grp, key_ms, size, path): the oldest, the trigger's first of equal times, no other group's last."""
    left, gone = sorted(files, key=lambda f: (f[1], f[0] != trigger, f[3])), []
    while sum(f[2] for f in left) > size:
        count = {}
        for f in left:
            count[f[0]] = count.get(f[0], 0) + 1
        may = [f for f in left if f[0] == trigger or count[f[0]] > 1]
        if not may:
            break
        left.remove(may[0])
        gone.append(may[0][3])
    return sorted(gone)


def _files(seed):
    rng = random.Random(seed)
    files = []
    for g in range(6):
        for k in range(1 if g == 0 else 40):
            # times that groups share, minutes with several files, empty files
            at = rng.choice([0, DAY - 1, DAY, 3 * DAY]) + rng.choice([0, 400, 60_000, 7_000_000])
            files.append((f"g{g}", at, rng.choice([0, 1, 5, 90]), f"g{g}/{k:03d}"))
    return files


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("trigger", [None, "g0", "g3"])
@pytest.mark.parametrize("size", [0, 300, 1500])
def test_size(spark, seed, trigger, size):
    files = _files(seed)
    df = spark.createDataFrame(files, "grp string, key_ms long, size long, path string")
    assert sorted(r["path"] for r in catalog.expired_by_size(df, size, trigger).collect()) == _drop_one_by_one(files, size, trigger)


@pytest.mark.parametrize("count", [0, 7, 40])
def test_count(spark, count):
    files = _files(5)
    want = []
    for g in {f[0] for f in files}:
        own = sorted((f for f in files if f[0] == g), key=lambda f: (f[1], f[3]))
        want += [f[3] for f in own[: max(0, len(own) - count)]]
    df = spark.createDataFrame(files, "grp string, key_ms long, size long, path string")
    assert sorted(r["path"] for r in catalog.expired_by_count(df, count).collect()) == sorted(want)


def test_nothing(spark):
    none = spark.createDataFrame([], "grp string, key_ms long, size long, path string")
    assert catalog.expired_by_size(none, 0, "g").count() == 0 and catalog.expired_by_count(none, 0).count() == 0
    untimed = spark.createDataFrame([("g", None, 9, "g/properties")], "grp string, key_ms long, size long, path string")
    assert catalog.expired_by_size(untimed, 0).count() == 0 and catalog.expired_by_count(untimed, 0).count() == 0
