"""Line dedup, native: DataFrame functions only.

Method: the hashes of lines are range-partitioned with a secondary sort by document and position, so one pass over the
sorted rows meets the occurrences of a line in order. What comes back for a document is a compressed keep bitmap (the
runs of kept positions), not text; apply_keep() turns runs and text into the cleaned text.

Skew: the range key is (hash, document), so a line that a third of all documents hold is cut into many ranges. What is
known about a line (documents, largest document) is aggregated within each range before it is shuffled, and the join
that brings it back is a plain equi-join with one row a line on one side, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import SPACES, lower_ascii

KEEP = "array<struct<first:int,n:int>>"


def line_array(text: Column) -> Column:
    """The lines of a text; null counts as empty, and an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row for each document that loses lines: id, t1 and t2 (hashes of its text) and keep, the runs of kept positions.

    A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of at least min_chars code points
    in at least min_docs documents lose all their lines except in the largest id holding them.
    Rows that share an id are one document to the counts; each keeps a bitmap of its own text. A null id is smaller than
    any other. Null text is empty. Repeated lines in a document count once. Extra columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("_d", F.xxhash64("_t").alias("t1"), F.xxhash64(F.lit(1), "_t").alias("t2"), F.posexplode(F.transform(line_array(F.col("_t")), line_key)).alias("pos", "key"))
    d = d.where(F.length("key") >= min_chars).select("_d", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    d = durable(d)  # texts are split once; both passes below read these narrow rows
    # Ranges of (line, document); within each, one pass over the rows sorted by line, document and position streams the
    # first occurrence of a line in each document. The window needs no shuffle of its own: the ranges hold whole keys.
    ranged = d.select("h1", "h2", "_d", "pos").repartitionByRange("h1", "h2", "_d")
    first = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("h1", "h2", "_d").orderBy("pos"))).where("_rn = 1")
    heads = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("_d").alias("keeper")).where(F.col("docs") >= min_docs)
    heads = durable(heads)  # a plain table on this side: a line in very many documents is then split by the join
    dropped = d.join(heads, ["h1", "h2"]).where(~F.col("_d").eqNullSafe(F.col("keeper")))
    per_doc = dropped.groupBy("_d", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return per_doc.select(F.col("_d").alias(id_col), "t1", "t2", runs_kept(F.col("gone")).alias("keep"))


def runs_kept(gone: Column) -> Column:
    """Sorted dropped positions to the compressed bitmap: the runs of kept ones. The last run has no length, it goes on to
    the end of the text, which is not at hand where bitmaps are made."""
    left = F.concat(F.array(F.lit(-1)), gone)
    right = F.concat(gone, F.array(F.lit(None).cast("int")))
    runs = F.zip_with(left, right, lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")))
    return F.filter(runs, lambda r: r["n"].isNull() | (r["n"] > 0)).cast(KEEP)


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _lines (array), _keep (runs) and _kept (the text that stays, or null where no line stays)."""
    b = bitmaps.select(F.col(id_col).alias("_bd"), F.col("t1").alias("_b1"), F.col("t2").alias("_b2"), F.col("keep").alias("_runs"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})
    j = d.join(b, (d["_t1"] == b["_b1"]) & (d["_t2"] == b["_b2"]) & d[id_col].eqNullSafe(b["_bd"]), "left")
    j = j.withColumn("_lines", line_array(F.col(text_col)))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(None).cast("int").alias("n"))).cast(KEEP)
    n_lines = F.size("_lines")
    closed = F.transform(F.coalesce(F.col("_runs"), whole), lambda r: F.struct(r["first"].alias("first"), F.coalesce(r["n"], n_lines - r["first"]).alias("n")))
    j = j.withColumn("_keep", F.filter(closed, lambda r: r["n"] > 0).cast(KEEP))
    j = j.withColumn("_n_gone", n_lines - F.aggregate("_keep", F.lit(0), lambda a, r: a + r["n"]))
    kept = F.flatten(F.transform("_keep", lambda r: F.slice("_lines", r["first"] + 1, r["n"])))
    return j.withColumn("_kept_lines", kept).drop("_bd", "_b1", "_b2", "_runs", "_t1", "_t2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with cleaned text, and the columns n_lines, n_dropped and keep (runs of kept positions).

    Every input row comes back once, whatever its id; empty tables give empty results. Input columns named like an
    output column are replaced by it.
    """
    j = apply_keep(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    out = [F.array_join("_kept_lines", "\n").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "keep")]
    return j.select(*out, F.size("_lines").cast("long").alias("n_lines"), F.col("_n_gone").cast("long").alias("n_dropped"), F.col("_keep").alias("keep"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
