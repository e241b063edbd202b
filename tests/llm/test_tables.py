"""Operators that compare rows of a table: against brute force, with awkward rows."""

import collections
import gzip
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import embeddings, jaccard, lines, neardup, parity, sharding, simhash, warc
from quarry.llm import words as words_module
from quarry.llm.components import components
from quarry.llm.words import fingerprint

CLASH = "doc_id bigint, text string, key string, line string, gone string, mark string, h string, words string, node string, root string, least string, cell string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghijk") for r in rows], CLASH)


def closure(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((30, 15), (30, 28), (60, 59)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n < 60 else [(i, i + 1) for i in range(59)]
        label = closure(n, lambda i, j: (i, j) in links or (j, i) in links)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint")).collect()}
        size = collections.Counter(label)
        assert got == {i: label[i] for i in range(n) if size[label[i]] > 1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# lines
def brute_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rank = lambda i: -1 if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held[key(s)].add(rank(i))
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [s for s in ls if len(held.get(key(s), ())) < 5 or max(held[key(s)]) == rank(i)]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(2)
    common = ["This Line is long enough to be counted as a common one " + str(i) for i in range(4)] + ["é" * 39 + "x", "short line", "", "   "]
    dress = lambda s: rng.choice(["", " ", "\t"]) + rng.choice([s, s.upper(), s]) + rng.choice(["", "\r", "  "])
    rows = [(i, "\n".join(dress(rng.choice(common)) for _ in range(rng.randint(1, 6))) + rng.choice(["", "\n"])) for i in range(60)]
    rows += [rows[0], rows[1], (None, common[0]), (None, None), (3, "other text\n" + common[1]), (100, ""), (101, None), (102, "\n".join([common[2], "own"] * 5000))]
    got = lines.dedup_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped", "key").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((*r, "a") for r in brute_lines(rows)), key=str)
    assert lines.dedup_lines(frame(spark, [])).count() == 0


# shards
def spark_hash(*values):
    """XXH64 of several values as the engine chains it: each is hashed with the hash so far; nulls are skipped."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def plain_ring(rows, shards, virtual, cells):
    """The shard of each document in the order of its cell, placed one by one: who belongs to a shard comes
    first, in order of cells; then what found no room walks on clockwise, in order of cells."""
    nodes = {}
    for i in range(shards * virtual):
        c = spark_hash("node", i % shards, i // shards) % cells
        nodes[c] = min(i % shards, nodes.get(c, shards))
    at = sorted(nodes)
    after = lambda c: next((n for n in at if n >= c), at[0])
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    keyed = sorted((spark_hash("key", r[0]) % cells, r[0] is not None, r[0] or 0, r[1], r[2]) for r in rows)
    placed, left = collections.Counter(), []
    for cell, some, i, size, crc in keyed:
        s = nodes[after(cell)]
        if room[s]:
            room[s] -= 1
            placed[i if some else None, size, crc, s] += 1
        else:
            left.append((cell, some, i, size, crc))
    for cell, some, i, size, crc in left:
        c = after(cell)
        while not room[nodes[c]]:
            c = after(c + 1)
        room[nodes[c]] -= 1
        placed[i if some else None, size, crc, nodes[c]] += 1
    return placed


@pytest.mark.parametrize("n, block", [(0, 9), (1, 9), (23, 9), (24, 9), (1000, 65536), (1000, 7)])
def test_shards_match_a_plain_ring(spark, n, block):
    rows = [(i, "x" * (i % 50) + "é") for i in range(n)]
    if n > 24:  # a hot id, a hot missing id, and one row very many times
        rows += [(None, None), (0, ""), (5, "x" * 5), (5, "x" * 5)] + [(7, "t" * k) for k in range(120)] + [(None, "u" * k) for k in range(150)] + [(77, "same")] * 300
    got = sharding.shard(frame(spark, rows), cells=256, virtual=16, block=block).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    plain = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(plain)
    if block > n:  # in one piece the order in a cell is that of the values
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == plain_ring(plain, 24, 16, 256)


def test_few_rows_move_to_one_more_shard(spark):
    docs = spark.range(100000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = sharding.shard(docs, 24), sharding.shard(docs, 25).withColumnRenamed("shard", "later")
    moved = a.join(b.select("doc_id", "later"), "doc_id").where("shard <> later").count()
    assert moved < 0.08 * 100000  # 4 % at best; by a plain remainder 96 in 100 would move


# fingerprints
def check_groups(spark, rows, **how):
    got = simhash.near_duplicates(frame(spark, rows), **how).collect()
    assert len(got) == len(rows)
    prints = [fingerprint((t or "").encode(), how.get("words", 3), 42, how.get("lanes", 1)) for _, t in rows]
    near = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= how.get("radius", 2)
    label = closure(len(rows), near)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = collections.Counter((i, least.get(c)) for (i, _), c in zip(rows, label, strict=True))
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(6)
    text = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "one"), (5, "One\t"), (6, "x y z " * 2000)]
    for i in range(60):
        own = list(text) if i % 2 else [f"v{rng.randrange(900)}" for _ in range(80)]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((10 + i, " ".join(own)))
    rows += [rows[8], rows[8]]
    check_groups(spark, rows)
    check_groups(spark, rows, radius=20)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def plain_fingerprint(text):
    """Straight from the definition, shingle by shingle and bit by bit."""
    words = [w for w in re.split("[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_definition(spark):
    rng = random.Random(5)
    words = ["a", "Bee", "CEE", "É", "x\u00a0y", "漢字", "1", "q" * 300, "-"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t\x0b", "\r\n  "]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", " \x0c ", "a b", "a b " * 5000]
    got = simhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["words"][0] % (1 << 64) for r in got} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("tile", [None, 7, 40])
def test_tiles_lose_nothing(spark, tile):
    rng = np.random.default_rng(1)
    seed = rng.integers(0, 2**62, 6)
    prints = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seed for a, b in rng.integers(0, 20, (40, 2))}
    nodes = sorted(prints)
    df = spark.createDataFrame([(n, [n]) for n in nodes], "node bigint, words array<bigint>")
    for radius in (0, 1, 2, 3, 5):
        label = closure(len(nodes), lambda i, j, radius=radius: bin(nodes[i] ^ nodes[j]).count("1") <= radius)
        want = {n: nodes[c] for n, c in zip(nodes, label, strict=True)}
        got = {r["node"]: r["root"] for r in components(simhash.near_links(df, radius, tile=tile)).collect()}
        assert {n: got.get(n, n) for n in nodes} == want


def test_a_row_is_sent_only_to_tiles_within_the_radius(spark):
    """Half the fingerprints have few bits and half many: no tile pair across them is compared."""
    rng = np.random.default_rng(2)
    values = [int(sum(1 << int(b) for b in rng.choice(64, n, replace=False)) - (1 << 63)) for n in [4] * 60 + [50] * 60]
    rows = spark.createDataFrame([(0, v, bin(v % (1 << 64)).count("1"), 10, [v]) for v in sorted(set(values))], "bucket bigint, node bigint, place int, tile_rows int, words array<bigint>")
    seen = spark.sparkContext.accumulator(0)

    def test(a, b):
        seen.add(a.shape[0] * b.shape[0])
        return np.zeros((len(a), len(b)), bool)

    assert simhash.tile_links(rows, 2, test).count() == 0
    n = rows.count()
    assert 0 < seen.value < 0.75 * n * n / 2


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, families = [], 12
    for f in range(families):
        text = words(300)
        for c in range(4):
            own = list(text)
            if c:
                own[rng.randrange(300)] = "new"
            rows.append((f * 10 + c, " ".join(own)))
    rows += [(1000 + i, " ".join(words(50))) for i in range(30)] + [(0, rows[0][1]), (None, "alone with words of its own here"), (2000, None)]
    got = neardup.one_of_each(frame(spark, rows)).select("doc_id", "key").collect()
    want = [f * 10 for f in range(families)] + [1000 + i for i in range(30)] + [2000]
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == want and len(got) == len(want) + 1


def test_short_and_repetitive_near_copies_are_all_found(spark):
    rng = random.Random(11)
    rows = []
    for f in range(150):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 12, 14, 20, 30, 60, 110, 300, 530]))]
        slogan = " ".join(text[-7:])
        for c in range(3):
            own = list(text)
            if c == 1:
                own[0] = "new"
            rows.append((f * 10 + c, " ".join(own) + (" " + slogan) * (rng.choice([1, 4, 40]) if c == 2 else 0)))
    sets = [set(jaccard.shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    label = closure(len(rows), lambda i, j: rows[i][0] // 10 == rows[j][0] // 10 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 - 1e-12)
    got = neardup.one_of_each(frame(spark, rows)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == [rows[i][0] for i in sorted(set(label))]


@pytest.mark.parametrize("tile", [128, 7])
def test_sketches_lose_no_similar_pair(spark, tile):
    rng = np.random.default_rng(12)
    sets = []
    for n in [1, 2, 4, 5, 8, 9, 40, 90, 205, 250, 256, 257, 300, 500, 513, 700, 2100]:
        for share in (1.0, 0.95, 0.89, 0.85, 0.8):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            sets += [np.unique(base), np.unique(base[: round(n * share)]), np.unique(np.concatenate([base[: round(n * (1 + share) / 2)], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))]
    df = spark.createDataFrame([(i % 1, i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "grp bigint, node bigint, shingles binary")
    similar = jaccard.similar(sets, sets, 0.8)
    root = {r["node"]: r["root"] for r in components(parity.candidate_links(df, 0.8, tile)).collect()}
    assert all(root.get(i, i) == root.get(j, j) for i, j in zip(*map(list, np.nonzero(similar)), strict=True))


def test_lanes_hold_similar_pairs_together():
    """Of sets of a given similarity, how many pairs agree on a lane."""
    rng = np.random.default_rng(3)

    def share(similarity, pairs, n):
        common = round(2 * n * similarity / (1 + similarity))
        held = 0
        for _ in range(pairs):
            x = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            held += bool((neardup.lane_keys(x[:n]) == neardup.lane_keys(x[n - common :])).any())
        return held / pairs

    assert share(0.8, 1500, 90) == share(0.8, 500, 9) == share(0.9, 500, 300) == 1
    assert share(0.3, 500, 200) < 0.2 and share(0.1, 500, 200) < 0.02
    assert len(neardup.lane_keys(np.empty(0, np.uint64))) == 0


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    """The fingerprints of the sets decide what is compared: without their links all different texts stay."""
    rng, calls, links = random.Random(21), [], neardup.near_links
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*text[:190], f"end{i}"])) for i in range(5)] + [(9, " ".join(reversed(text)))]

    def seen(prints, *how):
        calls.append((prints.collect(), how))
        return links(prints, *how)

    monkeypatch.setattr(neardup, "near_links", seen)
    assert sorted(r["doc_id"] for r in neardup.one_of_each(frame(spark, rows)).collect()) == [0, 9]
    prints, how = calls[0]
    plain = {tuple(words_module.signs([jaccard.shingle_set(t.encode(), 5)], neardup.PRINT_WORDS).view(np.int64).tolist()) for _, t in rows[:5]}
    assert {tuple(r["words"]) for r in prints} == plain and how[0] == neardup.radius(0.8, 64 * neardup.PRINT_WORDS)
    monkeypatch.setattr(neardup, "near_links", lambda prints, *how: links(prints, *how).limit(0))
    assert neardup.one_of_each(frame(spark, rows)).count() == len(rows)


def test_the_radius_holds_similar_sets_of_any_size():
    """Sets of just the similarity lie within the radius, whatever their size; others seldom do."""
    rng = np.random.default_rng(31)
    most, first = neardup.radius(0.8, 64 * neardup.PRINT_WORDS), neardup.radius(0.8, 64)

    def apart(common, own, other):
        x = rng.integers(0, 2**64, common + own + other, dtype=np.uint64)
        a, b = (words_module.signs([s], neardup.PRINT_WORDS) for s in (x[: common + own], np.concatenate([x[:common], x[common + own :]])))
        n = np.bitwise_count(a ^ b)
        return n.sum(), n[0]

    for common, own, other in [(4, 1, 0), (8, 2, 0), (8, 1, 1), (9, 1, 1), (16, 2, 2), (80, 20, 0), (80, 10, 10), (400, 50, 50)]:
        got = np.array([apart(common, own, other) for _ in range(400)])
        assert (got <= (most, first)).all() and got[:, 0].mean() < 1.01 * 64 * neardup.PRINT_WORDS * neardup.bit_differs(0.8)
    assert all(apart(0, 100, 100)[0] > most for _ in range(400)) and neardup.radius(1.0, 64) == 0


@pytest.mark.parametrize("tile", [7, 64])
def test_fingerprints_are_compared_within_a_grid_alone(spark, tile):
    rng = np.random.default_rng(32)
    base = rng.integers(-(2**63), 2**63, (3, 2))
    rows = []
    for n in range(90):
        words = base[rng.integers(3)].copy()
        for bit in rng.integers(0, 128, 4):
            words[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).view(np.int64))
        rows.append((int(rng.integers(2)), n, words.tolist()))
    near = lambda i, j: rows[i][0] == rows[j][0] and sum(bin((a ^ b) % (1 << 64)).count("1") for a, b in zip(rows[i][2], rows[j][2], strict=True)) <= 5
    label = closure(len(rows), near)
    df = spark.createDataFrame(rows, "grid bigint, node bigint, words array<bigint>")
    got = {r["node"]: r["root"] for r in components(simhash.near_links(df, 5, tile=tile, within="grid")).collect()}
    assert [got.get(n, n) for n in range(len(rows))] == label and 6 < len(set(label)) < 90


def test_runs_of_words_across_blocks(monkeypatch):
    text = b" ".join(b"w%d" % (i % 37) for i in range(5000))
    whole = np.concatenate(list(words_module.run_codes(text, 5)))
    assert len(whole) == 4996 and len(np.unique(whole)) == 37 and whole[0] == whole[37]
    blocks = words_module.word_blocks
    monkeypatch.setattr(words_module, "word_blocks", lambda t: blocks(t, 50))
    assert (np.concatenate(list(words_module.run_codes(text, 5))) == whole).all()
    assert [len(x) for x in words_module.run_codes(b"A b", 5)] == [1] and not list(words_module.run_codes(b" \n", 5))


def test_odd_columns_and_repeated_rows_of_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "x", 1.5), (1, text, "x", 1.5), (2, text + " end", "y", None), (3, None, None, 0.0), (3, "", "z", 0.0), (None, text, "n", 1.0), (4, "quite another text with words of its own", "k", 2.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string, best double")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns and sorted((r["doc_id"], r["a.b"]) for r in got.collect() if r["doc_id"] != 3) == [(1, "x"), (4, "k")]
    assert [r["doc_id"] for r in got.collect()].count(3) == 1 and neardup.one_of_each(df.limit(0)).count() == 0


def test_similar_links_match_brute_force(spark):
    rng = random.Random(9)
    groups = {}
    for g in range(3):
        seed = [rng.randrange(10**9) for _ in range(60)]
        for n in range(40 if g else 2):
            own = set(seed)
            for _ in range(rng.randrange(12)):
                own.discard(rng.choice(seed))
                own.add(rng.randrange(10**9))
            groups[g * 100 + n] = (g, own)
    data = lambda s: np.array(sorted(s), np.uint64).tobytes()
    df = spark.createDataFrame([(g, n, bytearray(data(s))) for n, (g, s) in groups.items()], "grp bigint, node bigint, shingles binary")
    nodes = sorted(groups)
    like = lambda a, b: groups[a][0] == groups[b][0] and len(groups[a][1] & groups[b][1]) / len(groups[a][1] | groups[b][1]) >= 0.8
    label = closure(len(nodes), lambda i, j: like(nodes[i], nodes[j]))
    for rows in (256, 7):
        got = {r["node"]: r["root"] for r in components(jaccard.similar_links(df, 0.8, rows)).collect()}
        assert {n: got.get(n, n) for n in nodes} == {n: nodes[c] for n, c in zip(nodes, label, strict=True)}


# vectors
def brute_vectors(rows, least=0.95):
    good = {i: np.array(v, dtype=float) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    n = len(rows)
    linked = [[i != j and i in good and j in good and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= least for j in range(n)] for i in range(n)]
    label = closure(n, lambda i, j: linked[i][j])
    low = {}
    for (v, _), c in zip(rows, label, strict=True):
        if v is not None:
            low[c] = min(v, low.get(c, v))
    return collections.Counter((v, sum(linked[i]), low.get(label[i])) for i, (v, _) in enumerate(rows))


@pytest.mark.parametrize("cell", [1, 8, 4096])
def test_vectors_match_brute_force(spark, cell):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(size=12) * rng.choice([0.05, 0.3, 2.0])).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 12), (203, [float("nan")] * 12), (204, [None] * 12), (205, [float("inf")] * 12), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, rows[0][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, node int, v string")
    got = embeddings.near_vectors(df, cell=cell).collect()
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


# fixity
def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>\r\n\r\nWARC/1.1\r\n" * (i % 7)) for i in range(400)]
    return rows + [(None, None, None), (None, "u\r\nv", "é漢"), (3, "http://x/3", rows[3][2]), (3, "http://x/3", rows[3][2]), (500, "long", "<br>" * 50_000)]


def test_files_come_back_and_headers_are_whole(spark, place):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 0, "b", 1) for r in rows], "page_id bigint, url string, html string, digest int, block string, size int")
    layout = warc.laid_out(pages, 20_000).cache()
    own = layout.collect()
    assert len(own) == len(rows) and len({r["record_id"] for r in own}) == len(rows)
    files = collections.defaultdict(list)
    for r in own:
        files[r["file_no"]].append((r["record_no"], r["start_at"], r["end_at"]))
    for records in files.values():
        records.sort()
        assert [n for n, _, _ in records] == list(range(len(records))) and records[0][1] == 0
        assert all(a[2] == b[1] for a, b in zip(records, records[1:]))
    warc.write_warc(pages, layout, f"{place}/warc")
    back = warc.read_warc(spark, f"{place}/warc").collect()
    assert collections.Counter((r["page_id"], r["html"]) for r in back) == collections.Counter((i, h or "") for i, _, h in rows)
    place_of = lambda r: (r["file_no"], r["record_no"], r["start_at"], r["end_at"], r["record_id"], r["digest"])
    assert sorted(map(place_of, back)) == sorted(map(place_of, own))
    data = b"".join(p.read_bytes() for p in Path(f"{place}/warc/file_no=0".removeprefix("file://")).glob("part*"))
    first = next(warc.parsed(data))
    assert {"warc-record-id", "warc-date", "warc-type", "content-length", "warc-block-digest"} <= set(first[2])
    assert [x[:3] for x in warc.parsed(gzip.compress(data[:500]) + gzip.compress(data[500:]))] == [x[:3] for x in warc.parsed(data)]


def test_audit_tells_lost_extra_damaged_and_moved_records(spark):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    own = [r.asDict() for r in warc.laid_out(pages, 20_000).select("file_no", "record_no", "start_at", "end_at", "record_id", "digest").collect()]
    schema = "file_no bigint, record_no bigint, start_at bigint, end_at bigint, record_id string, digest string"

    def replica(files):
        out = []
        for f, records in files.items():
            at = 0
            for n, r in enumerate(records):
                size = r["end_at"] - r["start_at"]
                out.append((f, n, at, at + size, r["record_id"], r["digest"]))
                at += size
        return warc.trees(spark.createDataFrame(out, schema))

    files = collections.defaultdict(list)
    for r in sorted(own, key=lambda r: (r["file_no"], r["record_no"])):
        files[r["file_no"]].append(r)
    one, f = replica(files), max(files, key=lambda f: len(files[f]))
    g = next(x for x in files if x != f and len(files[x]) > 3)
    assert warc.audit(one, replica(files)).count() == 0
    told = lambda changed: {(r["record_id"], r["status"]) for r in warc.audit(one, replica(changed)).collect()}
    ids = [r["record_id"] for r in files[f]]
    middle = len(ids) // 2
    alien = {"record_id": "alien", "digest": "ff", "start_at": 0, "end_at": 77}
    rotten = files[f][5] | {"digest": "00" + files[f][5]["digest"][2:]}
    assert told(files | {f: files[f][:middle] + files[f][middle + 1 :]}) == {(ids[middle], "missing")}
    assert told(files | {f: [*files[f][:middle], alien, *files[f][middle:]]}) == {("alien", "extra")}
    assert told(files | {f: [*files[f][:2], *files[f][3:], files[f][2]]}) == {(ids[2], "moved")}
    assert told(files | {f: [*files[f][:2], *files[f][3:]], g: [*files[g][:1], files[f][2], *files[g][1:]]}) == {(ids[2], "moved")}
    everything = [*files[f][:5], rotten, *files[f][6:middle], alien, *files[f][middle + 1 :]]
    assert told(files | {f: everything}) == {(ids[5], "damaged"), (ids[middle], "missing"), ("alien", "extra")}
    assert told(files | {f: [*files[f][:8], files[f][7], *files[f][8:]]}) == {(ids[7], "extra")}
    assert told({k: v for k, v in files.items() if k != g}) == {(r["record_id"], "missing") for r in files[g]}
    nothing = warc.trees(warc.laid_out(pages.limit(0)))
    assert warc.audit(nothing, nothing).count() == 0
