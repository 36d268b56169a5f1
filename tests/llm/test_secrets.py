"""Entropy secrets of few digits, and the benign forms that are left alone."""

import random
import string

import pytest

from sigloom.llm import secrets


def found(spark, words):
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in secrets.report(df).collect()}


def draw(rng, n, digits, letters):
    out = rng.choices(letters, k=n)
    for k in rng.sample(range(n), digits):
        out[k] = rng.choice(string.digits)
    return "".join(out)


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_secrets_of_few_digits(spark, digits):
    rng = random.Random(digits)
    words = [draw(rng, n, digits, letters) for n in (24, 32, 40) for letters in (string.ascii_letters, string.ascii_letters + "+/", string.ascii_letters + "-_") for _ in range(40)]
    words += [draw(rng, 20, digits, string.ascii_letters) for _ in range(40)]
    got = found(spark, words)
    missed = [w for k, w in enumerate(words) if got[k] != f"entropy:0:{len(w)}"]
    assert len(missed) <= len(words) // 50, missed
    masked = secrets.redact(spark.createDataFrame([("key aBqdEwgHrjKzmNvpQxsT end",), ("key aBqdEwgHrjKzmNvpQxsTuWy/x end",)], "text string")).collect()
    assert [r.text for r in masked] == ["key [SECRET] end"] * 2


def test_benign_forms(spark):
    words = [
        "getUserNameFromDatabase", "some_long_identifier_name", "state-of-the-art-language-models", "/usr/lib/x86_64-linux-gnu/libraries", "SOME_CONSTANT_NAME_HERE_TODAY", "com/en/2024/01/some-title-about-things",
        "python3/dist-packages/foo", "123e4567-e89b-12d3-a456-426614174000", "2024-01-31T12-30-59-123", "z" * 40, "internationalization", "-" * 60, "word-" * 2000,
    ]
    assert not any(found(spark, words).values())


def test_short_candidates_with_joins(spark):
    """Candidates of 20 to 23 characters with - _ + / are judged by a window that fits them."""
    rng = random.Random(3)
    words = ["aB3dE6-gH9jK2_mN5pQ8s"]
    for n in (20, 21, 22, 23):
        for join in "-_+/":
            for _ in range(5):
                w = draw(rng, n, 3, string.ascii_letters)
                at = rng.randrange(1, n - 1)
                words.append(w[:at] + join + w[at + 1 :])
    got = found(spark, words)
    assert [w for k, w in enumerate(words) if got[k] != f"entropy:0:{len(w)}"] == []
    assert not any(found(spark, ["state-of-the-art-way", "src/main/java/com/org", "=" * 22, "ab-ab-ab-ab-ab-ab-ab-"]).values())
