"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 10 consecutive words of the benchmark items, held as numbers of words. A
table gives, for each block of words, how far the search may move on; blocks that no pattern holds skip the
most. Where the block may end a pattern, its bucket's windows are compared with the words directly.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bloom_flag, materialize, read, ship, texts_of
from quarry.llm.words import word_blocks

WINDOW = 10
BLOCK = 3  # words of a block
PART_BYTES = 4_000_000  # of benchmark text searched for at once; more takes more passes

#: Bytes as word characters (A-Z lower-cased; 0-9, a-z and all of non-ASCII stay) or blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


_TIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
TABLE_BITS = 22  # of a shift table, at most


class WuManber:
    """Search for windows that all have ``m`` words, as rows of word numbers; ``stands`` gives each row's items.

    The shift table has a byte for each hash of a block of words: the least shift of all blocks with that
    hash, so a collision costs time and no occurrence. The windows are sorted by the hash of their last block;
    those of a bucket are compared word by word.
    """

    def __init__(self, vocabulary: dict[bytes, int], windows: np.ndarray, stands: list[frozenset]):
        self.get, self.m = vocabulary.get, windows.shape[1]
        self.block = min(BLOCK, self.m)
        self.far = self.m - self.block + 1
        bits = min(TABLE_BITS, max(8, (4 * len(windows) * self.far).bit_length()))
        self.mask = (1 << bits) - 1
        table = np.full(1 << bits, self.far, dtype=np.uint8)
        for end in range(self.block, self.m + 1):  # the smaller shift is written later
            table[self._hashes(windows[:, end - self.block : end])] = self.m - end
        self.shift = table.tobytes()
        last = self._hashes(windows[:, self.m - self.block :])
        order = np.argsort(last, kind="stable")
        self.last, self.windows, self.stands = last[order], np.ascontiguousarray(windows[order]), [stands[i] for i in order.tolist()]

    def _hashes(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), dtype=np.uint64)
        for i in range(blocks.shape[1]):
            out += blocks[:, i].astype(np.uint64) * np.uint64(_TIMES[i])
        return (out & np.uint64(self.mask)).astype(np.int64)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, frozenset]]:
        """(end, what the window stands for) of each occurrence, by end."""
        get, m, block, far, shift, mask, i, n = self.get, self.m, self.block, self.far, self.shift, self.mask, self.m, len(words)
        while i <= n:
            key = 0
            for k in range(1, block + 1):
                number = get(words[i - k])
                if number is None:
                    break
                key += number * _TIMES[block - k]
            if number is None:  # no window holds this block
                i += far
                continue
            step = shift[key & mask]
            if step:
                i += step
                continue
            own = [get(w) for w in words[i - m : i]]
            if None not in own:
                low, high = np.searchsorted(self.last, [key & mask, (key & mask) + 1])
                for j in low + np.flatnonzero((self.windows[low:high] == own).all(axis=1)):
                    yield i, self.stands[j]
            i += 1


def matchers(items: list[tuple[int, str]], window: int = WINDOW) -> list[WuManber]:
    """A matcher for whole windows, and one for each length of shorter items. Equal windows are one row."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for item, text in items:
        words = text.encode().translate(_TABLE).split()
        if words:
            numbers = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))
            m = min(window, len(words))
            by_length[m].append((item, sliding_window_view(numbers, m)))
    out = []
    for _, own in sorted(by_length.items()):
        windows, which = np.unique(np.concatenate([w for _, w in own]), axis=0, return_inverse=True)
        stands: list[frozenset] = [frozenset()] * len(windows)
        which, at = which.ravel(), 0
        for item, rows in own:
            alone = frozenset([item])  # one object for all windows that only this item has
            for j in which[at : at + len(rows)].tolist():
                stands[j] = stands[j] | alone if stands[j] else alone
            at += len(rows)
        out.append(WuManber(vocabulary, windows, stands))
    return out


def search(text: bytes, found: list[WuManber]) -> tuple[int, list[list[int]], set]:
    """Number of words, merged spans of hit words (start, end), and the items found."""
    spans: list[tuple[int, int]] = []
    items: set = set()
    base, tail, longest = 0, [], max((w.m for w in found), default=1)
    for fresh in word_blocks(text.translate(_TABLE)):
        words, seen = tail + fresh, len(tail)
        for w in found:
            skip = max(0, seen - w.m + 1)  # what ended in the last block isn't found again
            for end, stands in w.find(words[skip:] if skip else words):
                spans.append((base - seen + skip + end - w.m, base - seen + skip + end))
                items |= stands
        base += len(fresh)
        tail = words[max(0, len(words) - longest + 1) :] if longest > 1 else []
    return base, merge(spans), items


def merge(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_HITS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:bigint,end:bigint>>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with a column ``hits``: struct<n_words, n_hit, items, spans> of each whole text.

    A word inside any occurrence of a window is hit; spans count words, ends exclusive, and are merged
    where they touch. Items are benchmark ids, sorted, each once. Null and empty texts have no words.
    Benchmark rows with a null id or text are ignored, repeated ones count once. A column ``hits`` of
    ``docs`` is replaced; all others are kept as they are, whatever their names. Repeated rows each give one.

    The patterns go to every task, so their size is checked first: a benchmark of more than ``part_bytes``
    of text is searched for part by part. Each pass but the last keeps only the hits of the texts that have
    any, under 128 bits of hash of the text, and its broadcast is destroyed before the next; the last pass
    merges them. A single item is never split, so a part is as large as its largest item at least.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("hits")
    bench = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    pull = lambda k: spark.sparkContext.broadcast([(r["i"], r["t"]) for r in bench.where(part == k).toLocalIterator()])
    none = F.lit(None).cast(_HITS)
    if parts == 1:
        return docs.withColumn("hits", _pass(pull(0), window)(F.col("text"), none))
    mark = [F.xxhash64("text").alias("_q_a"), F.xxhash64(F.lit("again"), "text").alias("_q_b")]
    marked, before = docs.select("*", *mark), None
    texts = docs.where(F.length("text") > 0).select("text", *mark)
    for k in range(parts - 1):
        items = pull(k)
        own = texts.select("_q_a", "_q_b", _pass(items, window)(F.col("text"), none).alias("hits")).where("hits.n_hit > 0")
        own = materialize(own.dropDuplicates(["_q_a", "_q_b"]), "hits")
        items.destroy()
        before = own if before is None else before.unionByName(own)
    spans = F.flatten(F.collect_list("hits.spans")).alias("spans")
    found = before.groupBy("_q_a", "_q_b").agg(F.array_distinct(F.flatten(F.collect_list("hits.items"))).alias("items"), spans)
    zero = F.lit(0).cast("long")
    found = materialize(found.select("_q_a", "_q_b", F.struct(zero.alias("n_words"), zero.alias("n_hit"), "items", "spans").alias("_q_hits")), "found")
    # texts without earlier hits are told by a filter of fixed size and aren't shuffled
    flagged = bloom_flag(marked, F.xxhash64("_q_a", "_q_b"), found, F.xxhash64("_q_a", "_q_b"))
    some = flagged.where("_q_maybe").join(found, ["_q_a", "_q_b"], "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    both = flagged.where("not _q_maybe").select(*names, none.alias("_q_hits")).unionByName(some.select(*names, "_q_hits"))
    return both.select(*names, _pass(pull(parts - 1), window)(F.col("text"), F.col("_q_hits")).alias("hits"))


_BUILT: dict[str, list[WuManber]] = {}  # of the last pass that this worker ran


def _pass(items, window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    token = uuid.uuid4().hex

    @F.arrow_udf(_HITS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found = built(token, items, window)
        for texts, before in batches:
            out = []
            for text, old in zip((t for part in texts_of(texts) for t in part), before.to_pylist(), strict=True):
                n, spans, ids = search(text or b"", found)
                if old:
                    spans, ids = merge([*((s["start"], s["end"]) for s in old["spans"]), *spans]), ids | set(old["items"])
                out.append({"n_words": n, "n_hit": sum(e - s for s, e in spans), "items": sorted(ids), "spans": [{"start": s, "end": e} for s, e in spans]})
            yield pa.array(out, kind)

    return run


def built(token: str, items, window: int) -> list[WuManber]:
    """The matchers of a pass, made once in each worker."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = matchers(items.value, window)
    return _BUILT[token]


def op2_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of documents.

    Null and empty texts have no words and no items, and the digest of the empty text. Whole texts are
    searched, however long; repeated rows each give a row; an empty table gives none, an empty benchmark no
    hit; other columns are ignored.
    """
    out = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hits.items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, ws, least(10, len(ws)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
  WHERE len(ws) > 0
), g AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM b)
), x AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g))
), h AS (SELECT x.doc_id, x.i, x.m, g.item_id FROM x JOIN g ON x.m = g.m AND x.s = g.s),
n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
