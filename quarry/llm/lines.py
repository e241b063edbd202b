"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bloom_flag, discard, lower_ascii, materialize, read

MIN_CHARS = 40
MIN_DOCS = 5
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line):
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(_BLANK)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` less the repeated lines, and columns n_lines and n_dropped (long).

    Lines end at \\n; a null or empty text is one empty line, and its text becomes ''. A line whose key
    has at least ``min_chars`` code points and is found in at least ``min_docs`` different doc_id is
    dropped from every document but those of the largest doc_id that holds it. Several such lines in one
    document count once and go or stay together. Rows of equal doc_id are one document; rows without a
    doc_id are one more, smaller than all others. Columns n_lines and n_dropped of ``docs`` are replaced,
    all others kept.

    Only hashes and positions are exploded and shuffled: keys stand for 128 bits of hash. A key in very
    many documents is summed before the exchange, and its rows meet the few keys that are over the
    limit in a join that is broadcast if they are small, and split where it is skewed if not.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    mark = F.xxhash64(F.lit("row"), text)
    keyed = docs.select("doc_id", mark.alias("mark"), F.posexplode(lines).alias("pos", "line"))
    keyed = keyed.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    # texts are split once; what is kept of a line is a few numbers
    keyed = materialize(keyed.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g")), "keyed")
    # one row for each document and key first, so that a hot key is counted in parts
    holders = keyed.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
    over = holders.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    over = materialize(over.select("h", "g", "keeper"), "lines")
    gone = keyed.join(over, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("_q_id"), F.col("mark").alias("_q_mark"), F.col("gone").alias("_q_gone")), "gone")
    for old in (keyed, over):
        discard(old)
    # texts that lose nothing are told by a filter of fixed size and aren't shuffled; the join decides on the rest
    flagged = bloom_flag(docs.withColumn("_q_row", mark), F.xxhash64("doc_id", "_q_row"), gone, F.xxhash64("_q_id", "_q_mark"))
    names = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    out = lambda d, t, n: d.select(*names, t.alias("text"), F.size("_q_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"))
    whole = out(flagged.where("not _q_maybe").withColumn("_q_lines", lines), text, F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("_q_id")) & (F.col("_q_row") == F.col("_q_mark"))
    joined = flagged.where("_q_maybe").join(gone, same, "left").withColumn("_q_lines", lines)
    # the array is a column of its own: within the lambda it would be split again for every line
    kept = F.array_except(F.sequence(F.lit(0), F.size("_q_lines") - 1), F.col("_q_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("_q_lines"), i + 1)), "\n")
    cut = out(joined, F.when(F.col("_q_gone").isNull(), text).otherwise(rest), F.coalesce(F.size("_q_gone"), F.lit(0)))
    return whole.unionByName(cut).select(*[f"`{c}`" for c in docs.columns], "n_lines", "n_dropped")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), bad AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, pos, line, (b.key IS NOT NULL AND k.doc_id <> b.keeper) AS gone
  FROM k LEFT JOIN bad b ON k.key = b.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
