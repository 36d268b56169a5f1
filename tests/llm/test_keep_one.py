"""Rows without an id, and one id on two texts, in the Jaccard join and the stage that keeps one of each component."""

from collections import Counter

from sigloom.llm import exact, jaccard

WORDS = [f"w{k}" for k in range(400)]


def text(first, n=60):
    return " ".join(WORDS[first : first + n])


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter((r.doc_id, r.text) for r in jaccard.keep_one(df).collect())


def test_copy_without_id_takes_no_other_row(spark):
    rows = [(1, text(0)), (None, text(0).upper()), (None, text(100)), (None, text(200)), (None, ""), (None, None), (None, "")]
    assert kept(spark, rows) == Counter([(1, text(0)), (None, text(100)), (None, text(200)), (None, ""), (None, None), (None, "")])


def test_copies_without_ids(spark):
    near = text(0) + " tail"
    got = kept(spark, [(None, text(0)), (None, text(0)), (None, near), (None, text(100))])
    assert got[(None, text(100))] == 1 and got[(None, text(0))] + got[(None, near)] == 1 and got.total() == 2


def test_one_id_on_two_texts(spark):
    assert kept(spark, [(3, text(0)), (7, text(0).upper()), (7, text(100)), (7, text(100)), (8, "")]) == Counter([(3, text(0)), (7, text(100)), (8, "")])
    got = kept(spark, [(7, text(0)), (7, text(0).upper()), (9, text(200))])
    assert got[(9, text(200))] == 1 and got.total() == 2


def test_bridge_without_id(spark):
    a, b, c = text(0), text(6), text(12)  # 56 shingles each, 50 of them shared by neighbours, 44 by a and c
    assert len(jaccard.shingles(a)) == 56 and not jaccard.linked(44, 56, 56) and jaccard.linked(50, 56, 56)
    df = spark.createDataFrame([(1, a), (None, b), (2, c)], "doc_id long, text string")
    assert sorted((r.component_id for r in jaccard.near_duplicates(df).collect())) == [1, 1, 1]
    assert kept(spark, [(1, a), (None, b), (2, c)]) == Counter([(1, a)])


def test_texts_without_words_of_one_id(spark):
    """Null, empty and blank texts of an id are one row of the empty set; those of no id stay. Exact copies are one, null as empty."""
    rows = [(1, None), (1, ""), (1, " "), (2, ""), (2, text(0)), (None, None), (None, ""), (3, text(100)), (3, text(100))]
    got = kept(spark, rows)
    assert sum(n for (i, _), n in got.items() if i == 1) == 1
    assert got[(2, "")] == got[(2, text(0))] == got[(None, None)] == got[(None, "")] == got[(3, text(100))] == 1 and got.total() == 6
    df = spark.createDataFrame([(*r, 0) for r in [(1, None), (1, ""), (2, "a"), (2, "a"), (3, "b")]], "doc_id long, text string, _SAME int").repartition(2)
    out = exact.drop_copies(df)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3] and out.columns == df.columns
