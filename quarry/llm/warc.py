"""WARC records, and a Merkle audit of their fixity.

Every file has a tree: records are hashed with their headers, which hold the digest of their block; runs of
records are hashed with the ordered offset ranges that they take up; runs of those, and the root, likewise.
Runs end where a hash says so, not at fixed numbers, so a record that is lost or added changes the run that
holds it and no other. Replicas are compared by their roots; only branches that differ are descended into, and
the records below them are matched by id.
"""

from __future__ import annotations

import gzip
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import end_to_end, materialize, read, ship, tasks

FILE_BYTES = 16_000_000  # of records in a file, about
DATE = "1970-01-01T00:00:00Z"  # of records whose capture time nothing tells
RUN = "0"  # a run ends with a hash that begins with this: one in sixteen
_GAP = "\r\n\r\n"
_NO_ID = "00000000-0000-0000-0000-000000000000"


def header(page: Column, url: Column, record_id: Column, length: Column, block: Column, date: str = DATE) -> Column:
    """All lines of the header but the last, empty one. ``block``: SHA-256 of the block in hex."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(url, "[\\r\\n]", "")),
        line("Page-ID", F.coalesce(page.cast("string"), F.lit("none"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), block)),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", length.cast("string")),
    )


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def laid_out(pages: DataFrame, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, length and block (SHA-256) of
    the html in UTF-8, file_no, record_no, start_at and end_at in the file, record_id and digest (SHA-256 of the
    header, which holds that of the block).

    Records lie in order of page_id, block and url (nulls first), repeated rows next to each other; a file ends
    with the record that fills it. Record ids are made of the block and the place of the record in all files,
    so no two are equal. Null urls and texts count as empty. Other columns are ignored. Only digests, lengths
    and urls are shuffled, and a page_id that very many rows share is dealt out like any other.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(html).cast("long").alias("length"), F.sha2(html.cast("binary"), 256).alias("block"))
    head = lambda i: header(F.col("page_id"), F.col("url"), i, F.col("length"), F.col("block"), date)
    rows = materialize(rows.withColumn("size", (F.octet_length(head(F.lit(_NO_ID))) + 8 + F.col("length")).cast("long")), "records")
    rows = end_to_end(rows, ["page_id", "block", "url"], "size").withColumn("first", F.col("end_at") - F.col("size"))
    rows = rows.withColumn("file_no", F.floor(F.col("first") / file_bytes).cast("long"))
    whole = Window.partitionBy("file_no")  # a file has a bounded number of records
    rows = rows.withColumn("base", F.min("first").over(whole)).withColumn("record_no", F.row_number().over(whole.orderBy("first")).cast("long") - 1)
    rows = rows.withColumn("record_id", _uuid(F.concat_ws(":", "block", "first")))
    place = [(F.col("first") - F.col("base")).alias("start_at"), (F.col("end_at") - F.col("base")).alias("end_at")]
    return rows.select("page_id", "url", "length", "block", "file_no", "record_no", *place, "record_id", F.sha2(head(F.col("record_id")).cast("binary"), 256).alias("digest"))


def write_warc(pages: DataFrame, layout: DataFrame, path: str, date: str = DATE) -> None:
    """Write the records into one folder for each file number, in the order of their offsets."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").alias("_q_page"), F.sha2(html.cast("binary"), 256).alias("_q_block"), html.alias("_q_html")).dropDuplicates(["_q_page", "_q_block"])
    rows = layout.join(own, F.col("page_id").eqNullSafe(F.col("_q_page")) & (F.col("block") == F.col("_q_block")))
    head = header(F.col("page_id"), F.col("url"), F.col("record_id"), F.col("length"), F.col("block"), date)
    rows = rows.select(F.concat(head, F.lit(_GAP), "_q_html", F.lit("\r\n")).alias("value"), "file_no", "record_no")  # the last line end is the writer's
    rows = rows.repartition(tasks(pages.sparkSession), "file_no").sortWithinPartitions("file_no", "record_no")
    rows.select("value", "file_no").write.partitionBy("file_no").option("lineSep", "\r\n").text(path)


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(start, end, fields, header, block) of the records of a file, by their Content-Length; a file may be
    compressed, whole or record by record, and offsets are then those of what it holds."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        head = data[at:cut]
        if cut < 0 or not head.startswith(b"WARC/"):
            at = data.find(b"WARC/1.", at + 1)  # a damaged header: go on with the next record
            if at < 0:
                return
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        end = min(len(data), cut + 4 + length + 4)
        yield at, end, fields, head, data[cut + 4 : cut + 4 + length]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record below ``path``: page_id, url, html, file_no (of its folder), record_no,
    start_at, end_at, record_id, and digest as in :func:`laid_out`, with the block's digest computed anew from
    its bytes. Files are read whole, so they should have a bounded size."""
    ship(spark)
    names = ["page_id", "url", "html", "file_no", "record_no", "start_at", "end_at", "record_id", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for file, data in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                out: list[list] = [[] for _ in names]
                for n, (start, end, fields, head, block) in enumerate(parsed(data.as_py())):
                    told = fields.get("warc-block-digest", "")
                    true = "sha256:" + hashlib.sha256(block).hexdigest()
                    digest = hashlib.sha256(head.replace(told.encode(), true.encode()) if told else head + true.encode()).hexdigest()
                    page = fields.get("page-id", "none")
                    row = (int(page) if page.lstrip("-").isdigit() else None, fields.get("warc-target-uri", ""), block.decode("utf-8", "replace"), file, n, start, end, fields.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">"), digest)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in ("page_id", "file_no", "record_no", "start_at", "end_at") else pa.string()) for k, c in zip(names, out, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    number = F.coalesce(F.regexp_extract("path", r"file_no=([0-9]+)/", 1).try_cast("long"), F.pmod(F.xxhash64("path"), F.lit(1 << 40)))
    return files.select(number.alias("file_no"), "content").mapInArrow(run, "page_id bigint, url string, html string, file_no bigint, record_no bigint, start_at bigint, end_at bigint, record_id string, digest string")


@dataclass
class Trees:
    """A tree a file: records (with ``run``), runs of them (with ``branch``), runs of those, and roots. All
    have file_no, no, start_at, end_at and hash."""

    records: DataFrame
    runs: DataFrame
    branches: DataFrame
    roots: DataFrame


def _numbered(nodes: DataFrame, name: str) -> DataFrame:
    """With the number of the run that each node of a file belongs to."""
    before = Window.partitionBy("file_no").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn(name, F.coalesce(F.sum(F.col("hash").startswith(RUN).cast("long")).over(before), F.lit(0)))


def _hashed(nodes: DataFrame, name: str) -> DataFrame:
    """One node for each run: it hashes the ordered hashes of its children and the ranges they take up,
    counted from where the run begins."""
    below = F.sort_array(F.collect_list(F.struct("no", "start_at", "end_at", "hash")))
    up = nodes.groupBy("file_no", name).agg(below.alias("below"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))
    text = F.array_join(F.transform("below", lambda c: F.concat_ws(":", c["start_at"] - F.col("start_at"), c["end_at"] - F.col("start_at"), c["hash"])), ",")
    return up.select("file_no", F.col(name).alias("no"), "start_at", "end_at", F.sha2(text.cast("binary"), 256).alias("hash"))


def trees(layout: DataFrame) -> Trees:
    """The trees of a replica from its records: file_no, record_no, start_at, end_at, record_id, digest."""
    leaves = layout.select("file_no", F.col("record_no").alias("no"), "start_at", "end_at", "record_id", F.col("digest").alias("hash"))
    leaves = materialize(_numbered(leaves, "run"), "leaves")
    runs = materialize(_numbered(_hashed(leaves, "run"), "branch"), "runs")
    branches = materialize(_hashed(runs, "branch"), "branches")
    roots = _hashed(branches.withColumn("root", F.lit(0).cast("long")), "root")
    return Trees(leaves, runs, branches, materialize(roots, "roots"))


def _differing(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of either side that the same file of the other lacks; the same hash counts as often as it occurs."""
    nth = F.row_number().over(Window.partitionBy("file_no", "hash").orderBy("no"))
    a, b = (t.select("file_no", "no", "hash", nth.alias("nth")) for t in (one, two))
    own = ["file_no", "hash", "nth"]
    return a.join(b, own, "left_anti").select("file_no", "no"), b.join(a, own, "left_anti").select("file_no", "no")


def audit(one: Trees, two: Trees) -> DataFrame:
    """Records in which the second replica differs from the first: record_id, status, and file_no, no, start_at
    and end_at in the replica that has it (the first, if both).

    damaged: its header or block is another. missing, extra: only the first or the second has it. moved: it is
    the same, but in another file or out of order among the records of its file. Records that are only
    shifted because one before them was lost, added or moved are the same. Ids should be unique; if one
    occurs several times, its occurrences are matched in order. Only children of nodes that differ are
    compared. Empty replicas are equal.
    """
    ship(one.records.sparkSession)
    roots = one.roots.select("file_no", F.col("hash").alias("a")).join(two.roots.select("file_no", F.col("hash").alias("b")), "file_no", "full")
    files = materialize(roots.where(~F.col("a").eqNullSafe(F.col("b"))).select("file_no"), "files")
    under = lambda t, bad, name: t.join(bad.withColumnRenamed("no", name), ["file_no", name], "left_semi")
    bad = [materialize(x, "bad") for x in _differing(*(t.branches.join(files, "file_no", "left_semi") for t in (one, two)))]
    bad = [materialize(x, "bad") for x in _differing(*(under(t.runs, x, "branch") for t, x in zip((one, two), bad, strict=True)))]
    nth = F.row_number().over(Window.partitionBy("record_id").orderBy("file_no", "no"))
    names = ["file_no", "no", "start_at", "end_at", "hash"]
    a, b = (under(t.records, x, "run").select("record_id", nth.alias("nth"), F.struct(*names).alias(s)) for t, x, s in zip((one, two), bad, "ab", strict=True))
    both = materialize(a.join(b, ["record_id", "nth"], "full"), "matched")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a.hash") != F.col("b.hash"), "damaged").when(F.col("a.file_no") != F.col("b.file_no"), "moved")
    told = both.withColumn("status", status)
    here = F.coalesce("a", "b")
    found = told.where("status is not null").select("record_id", "status", *[here[c].alias(c) for c in names[:4]])
    return found.unionByName(_out_of_order(told.where("status is null")))


def _out_of_order(same: DataFrame) -> DataFrame:
    """Of the records that both replicas hold unchanged in a file: the fewest that must have moved, which are
    those outside a longest run that is in order in both. A file has a bounded number of records."""
    rows = same.select(F.col("a.file_no").alias("file_no"), F.col("a.no").alias("no"), F.col("b.no").alias("other"), F.col("a.start_at").alias("start_at"), F.col("a.end_at").alias("end_at"), "record_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("other")
        ends, tails, back = [], [], []
        for i, no in enumerate(table.column("no").to_pylist()):
            k = bisect_left(ends, no)
            ends[k : k + 1], tails[k : k + 1] = [no], [i]
            back.append(tails[k - 1] if k else None)
        kept, i = set(), tails[-1]
        while i is not None:
            kept.add(i)
            i = back[i]
        moved = table.take(pa.array([i for i in range(table.num_rows) if i not in kept], pa.int64()))
        columns = {"record_id": moved.column("record_id"), "status": pa.array(["moved"] * moved.num_rows, pa.string())}
        return pa.table(columns | {c: moved.column(c) for c in ("file_no", "no", "start_at", "end_at")})

    return rows.groupBy("file_no").applyInArrow(run, "record_id string, status string, file_no bigint, no bigint, start_at bigint, end_at bigint")


def damaged_copy(layout: DataFrame) -> DataFrame:
    """The records of a replica that has suffered, as chosen by the first two digits of their block's digest:
    00 is damaged, 01 is lost, 02 is followed by a record that doesn't belong there. Offsets are counted anew."""
    pick = F.substring("block", 1, 2)
    own = layout.withColumn("digest", F.when(pick == "00", F.sha2(F.concat(F.lit("rot:"), "digest").cast("binary"), 256)).otherwise(F.col("digest"))).withColumn("sub", F.lit(0))
    more = layout.where(pick == "02").withColumn("record_id", _uuid(F.concat(F.lit("extra:"), "record_id"))).withColumn("digest", F.sha2(F.concat(F.lit("extra:"), "digest").cast("binary"), 256)).withColumn("sub", F.lit(1))
    rows = own.where(pick != "01").unionByName(more).withColumn("n", F.col("end_at") - F.col("start_at"))
    by = Window.partitionBy("file_no").orderBy("record_no", "sub")
    end = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    number = F.row_number().over(by).cast("long") - 1
    return rows.select("file_no", number.alias("record_no"), (end - F.col("n")).alias("start_at"), end.alias("end_at"), "record_id", "digest")


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the first replica with its place, digest and what the audit says of it (same, damaged,
    missing), and the extra records of the second, with a null page_id and digest.

    Pages have no second copy to compare with, so the replica is made by :func:`damaged_copy`. Null urls and
    texts are empty, null page_ids come first, repeated rows are records of their own, an empty table gives no
    row, and other columns are ignored.
    """
    layout = materialize(laid_out(read(spark, sf_dir, "pages").select("page_id", "url", "html")), "layout")
    found = materialize(audit(trees(layout), trees(damaged_copy(layout))), "audit")
    own = layout.join(found.where("status <> 'extra'").select("record_id", "status"), "record_id", "left")
    own = own.select("page_id", "file_no", "record_no", "start_at", "end_at", "record_id", "digest", F.coalesce("status", F.lit("same")).alias("status"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    page = none(layout.schema["page_id"].dataType, "page_id")
    return own.unionByName(found.where("status = 'extra'").select(page, "file_no", F.col("no").alias("record_no"), "start_at", "end_at", "record_id", none("string", "digest"), "status"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS length, sha256(coalesce(html, '')) AS block FROM pages
), h AS (
  SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' AS h1,
    '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(url, chr(13), ''), chr(10), '')
    || chr(13) || chr(10) || 'Page-ID: ' || coalesce(CAST(page_id AS VARCHAR), 'none') || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || block
    || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || length AS h2 FROM p
), s AS (SELECT *, strlen(h1) + 36 + strlen(h2) + 8 + length AS size FROM h),
o AS (SELECT *, CAST(sum(size) OVER (ORDER BY page_id NULLS FIRST, block, url ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS first FROM s),
f AS (SELECT *, first // 16000000 AS file_no, md5(block || ':' || first) AS m FROM o),
l AS (
  SELECT *, first - min(first) OVER (PARTITION BY file_no) AS start_at, row_number() OVER (PARTITION BY file_no ORDER BY first) - 1 AS record_no,
    m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS record_id, block[1:2] AS pick FROM f
), t AS (
  SELECT file_no, record_no, 0 AS sub, size, record_id, pick FROM l WHERE pick <> '01' UNION ALL SELECT file_no, record_no, 1, size, record_id, pick FROM l WHERE pick = '02'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY record_no, sub) - 1 AS no,
    CAST(sum(size) OVER (PARTITION BY file_no ORDER BY record_no, sub ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e_end, md5('extra:' || record_id) AS m FROM t
)
SELECT page_id, file_no, record_no, start_at, start_at + size AS end_at, record_id, sha256(h1 || record_id || h2) AS digest,
  CASE pick WHEN '00' THEN 'damaged' WHEN '01' THEN 'missing' ELSE 'same' END AS status FROM l
UNION ALL
SELECT NULL, file_no, no, e_end - size, e_end, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32], NULL, 'extra' FROM e WHERE sub = 1
"""
