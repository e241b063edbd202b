"""Byte-pair encoding and decoding by tree concatenation.

A text is split as the tokenizer splits it. Text that stays unsplit for long is cut into leaves; the
leaves are encoded in parallel, and neighbours are joined pair by pair up a tree. At each join a window
of tokens around it is encoded again, and grown until its outermost tokens agree on both sides with
what was there. A sequence of tokens is the encoding of its bytes exactly if every two neighbours are
the encoding of theirs, so agreement on the outer tokens proves the join.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, ship

#: Fixed value: how byte-level vocabularies of this kind split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 1024  # characters of a leaf; text unsplit for longer is encoded as a tree
THREADS = 2  # leaves encoded at once
WINDOW = 8  # tokens on each side of a join at first
AGREE = 2  # outermost tokens that must agree


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary file: exact encoding and decoding."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, self.leaf = _byte_alphabet(), leaf
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.ranks = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        merged = [self.ranks[as_bytes("".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary don't follow its merges")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.split = tiktoken.Encoding("split", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.unsplit = tiktoken.Encoding("unsplit", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        table = [b""] * (max([*self.ranks.values(), *self.added.values()]) + 1)
        for k, v in self.ranks.items():
            table[v] = k
        for k, v in self.added.items():
            table[v] = k.encode()
        self.table, self.lengths = table, np.array([len(x) for x in table], dtype=np.int64)
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(table), dtype=np.uint8)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of unsplit bytes: always the merge of lowest rank, the leftmost first."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if part[i] else n
            if j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := ranks.get(pair := part[left] + part[right])) is not None:
                    heapq.heappush(queue, (r, left, pair))
        return [ranks[p] for p in part if p]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of ``a`` followed by those of ``b``."""
        left = right = WINDOW
        while a and b:
            x, y = min(left, len(a)), min(right, len(b))
            mid = self.merge(b"".join(map(self.table.__getitem__, a[len(a) - x :] + b[:y])))
            fits_left = x == len(a) or mid[:AGREE] == a[len(a) - x :][:AGREE]
            fits_right = y == len(b) or mid[-AGREE:] == b[:y][-AGREE:]
            if fits_left and fits_right:
                return a[: len(a) - x] + mid + b[y:]
            left, right = left * (1 if fits_left else 2), right * (1 if fits_right else 2)
        return a + b

    def tree(self, text: str) -> list[int]:
        """The encoding of text that nothing splits."""
        leaves = [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]
        level = self.unsplit.encode_ordinary_batch(leaves, num_threads=THREADS)
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _plain(self, text: str) -> np.ndarray:
        words = text.split()
        long = max(map(len, words), default=0)
        blank = len(text) - sum(map(len, words)) - len(words)
        if max(long, blank) <= self.leaf:
            return np.asarray(self.split.encode_to_numpy(text), dtype=np.uint32)
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            piece = m.group()
            ids += self.tree(piece) if len(piece) > self.leaf else self.unsplit.encode_ordinary(piece)
        return np.array(ids, dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; the strings of added tokens become their ids."""
        if not self.split_added or not any(t in text for t in self.added):
            return self._plain(text) if text else np.empty(0, np.uint32)
        parts = [np.array([self.added[p]], dtype=np.uint32) if p in self.added else self._plain(p) for p in self.split_added.split(text) if p]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become replacement characters."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        data = self.flat[at].tobytes()
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """One codec for each vocabulary and Python worker."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, digests: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Encode every whole ``text``, and decode it again.

    Returns for each row the id column, n_tokens (long), ids (binary: little-endian unsigned 32-bit)
    and exact (boolean: the decoded text equals the text). With ``digests``: doc_id, n_tokens,
    ids_sha256 and decoded_sha256 instead of the tokens.

    A null text counts as empty: no tokens. Repeated rows, null ids and ties each give a row; other
    columns are ignored. ``path`` is a vocabulary file that every worker can read; without it each
    worker takes the public 50k byte-level file of its own installation.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column), "text")
    kind = source.schema[id_column].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path or default_path())
        for rb in batches:
            for s in range(0, rb.num_rows, 500):
                part = rb.slice(s, 500)
                n, first, second = [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    data, decoded = ids.astype("<u4").tobytes(), bpe.decode(ids)
                    n.append(len(ids))
                    first.append(hashlib.sha256(data).hexdigest() if digests else data)
                    second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded == (text or "").encode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.binary()), pa.array(second, pa.string() if digests else pa.bool_())],
                    [id_column, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "exact"))],
                )

    return source.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, {tail}")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents.

    Null and empty texts have no tokens; whole texts are encoded, however long; repeated rows each give a row,
    an empty table gives none, and other columns are ignored.
    """
    return encode(read(spark, sf_dir, "documents"), digests=True)
