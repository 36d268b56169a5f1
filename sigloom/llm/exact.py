"""Exact dedup by content-defined chunk recipes; DataFrame functions only.

A text is cut where its own content says so, so equal texts have equal chunks. A chunk becomes an identifier (SHA-256,
checked against its length and a second, unrelated hash), a document the ordered list of its identifiers. Later
steps move and compare those short lists; the long texts are read once and never shuffled. Of 10^13 different chunks two
share a SHA-256 with a probability of 10^26 / 2^257, under 10^-50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import SPACE, forget, keep, one_each, sent, text_or_empty

#: Characters of a chunk, least and most.
LEAST, MOST = 64, 4096
#: Beyond LEAST a chunk ends where one of some letters or digits starts a sentence, after an East Asian sentence, or, in text without either,
#: within one of a few pairs of letters and digits; at MOST it ends anyway. The places are sparse, so that shifted texts soon cut alike again.
CUT = r"(?<=[.!?।۔] )(?=[A-FÀ-Éa-c15Α-ΖА-Жא-הا-حअ-क])|(?<=[。！？；…])|(?<=[QZqz79])(?=[A-Fa-f0-4])"
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:{CUT}|\z)|.{{1,{MOST}}}"


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_or_empty(text_col), SPACE + "+", " ")


def recipes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _mark, row, recipe, text_sha256): _mark is a hash of the text as it is, row tells repeated rows apart."""
    text = F.col("_text")
    chunks = F.transform(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("id"), F.length(c).alias("chars"), F.xxhash64(c).alias("other")))
    rows = df.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_text"), F.xxhash64(text_or_empty(text_col)).alias("_mark"))
    return rows.select("_id", "_mark", F.monotonically_increasing_id().alias("row"), chunks.alias("recipe"), F.sha2(text, 256).alias("text_sha256"))


def verify(recipe_rows: DataFrame) -> None:
    """Deduplicate the chunks and hold each identifier against what it stands for; two contents under one identifier end the job."""
    chunk = recipe_rows.select(F.explode("recipe").alias("c")).select("c.id", "c.chars", "c.other")
    seen = chunk.groupBy("id").agg(F.min("chars").alias("a"), F.max("chars").alias("b"), F.min("other").alias("c"), F.max("other").alias("d"))
    if seen.where((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).limit(1).count():
        raise RuntimeError("two chunks share an identifier")


def _flags(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _mark, keep_id, group_size, kept, text_sha256 of every row."""
    rows, _ = keep(df.sparkSession, recipes(df, id_col, text_col), "recipes")
    verify(rows)
    ids = F.transform("recipe", lambda c: c["id"])
    name = F.unhex(F.sha2(F.array_join(F.transform("recipe", lambda c: F.hex(c["id"])), ""), 256))
    rows = rows.select("_id", "_mark", "row", ids.alias("recipe"), name.alias("name"), "text_sha256")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("row").alias("row"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("first"), F.min("name").alias("r"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # lists are compared whole, above; their rows learn of it by a short name, where they are while few groups have copies
    groups, _ = keep(df.sparkSession, groups.select("r", "first", "size"), "groups")
    both = rows.join(sent(groups), F.col("name") == F.col("r"), "left")
    single = F.col("size").isNull()
    return both.select(
        "_id",
        "_mark",
        F.when(single, F.col("_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space has become one blank; null counts as empty. The row with
    the smallest id stays; null ids come last; of repeated rows with one id the first stays (kept is true once a group).
    Other columns are not read. Groups are pre-aggregated in each task; up to a counted bound, groups with copies then go to the rows,
    so a hot one meets in no task.
    """
    return _flags(df, id_col, text_col).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns. An empty table stays empty.

    Only ids and marks of copies meet the texts again; up to a counted bound they go to the texts, which then stay where they are.
    """
    flags, _ = keep(df.sparkSession, _flags(df, id_col, text_col).select("_id", "_mark", "kept"), "copies")
    rows = flags.groupBy("_id", "_mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = sent(rows.where("not kept").select(F.col("_id").alias("_gone"), F.col("_mark").alias("_of")))
    mark = F.xxhash64(text_or_empty(text_col))
    out = df.join(gone, df[id_col].eqNullSafe(gone["_gone"]) & (mark == gone["_of"]), "left_anti")
    # rows that repeat an id and a text, null as empty: one of them
    return one_each(out, id_col, text_or_empty(text_col)) if rows.where("n > 1").limit(1).count() else out


ORACLE = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""

__all__ = ["ORACLE", "drop_copies", "exact_dedup", "forget", "normalised", "recipes", "verify"]
