"""The pipeline against a plain version of each stage, and what it does with awkward rows."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import bpe, quality
from quarry.llm.jaccard import shingle_set
from tests.llm.test_tables import brute_lines, closure

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    prose = lambda n=8: "\n".join(" ".join(word() for _ in range(14)) + "." for _ in range(n))
    junk = lambda: " ".join(word() + rng.choice(["###", "%%%"]) for _ in range(80))
    common = "Released under a licence that is repeated in very many documents"
    bench = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts = [junk() if i % 6 == 0 else prose() for i in range(180)]
    for i in range(1, 180, 9):
        if i % 6:
            texts[i] += "\n" + common
    for i in range(120, 140):
        if i % 6 and (i - 100) % 6:
            own = texts[i - 100].split(" ")
            own[rng.randrange(len(own))] = "changed"
            texts[i] = " ".join(own)
    texts[25] += " " + bench[1][1]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s", 0), (None, prose(), None, None, None)]
    rows += [rows[1], rows[1]]
    labels = [(i, int(i % 6 > 0), 0) for i in range(180)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, bench


def test_run_equals_plain_stages(spark, tables):
    d, rows, bench = tables
    got = sorted(((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, d).collect()), key=str)
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    docs = [(i, t) for i, t, *_ in rows if model(quality.features((t or "").encode())[None])[0] >= quality.THRESHOLD]
    assert 0 < len(docs) < len(rows)
    docs = [(i, t) for i, t, *_ in brute_lines(docs)]
    sets = [set(shingle_set(t.encode(), 5).tolist()) for _, t in docs]
    like = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8
    label, groups = closure(len(docs), like), {}
    for k, c in enumerate(label):
        groups.setdefault(c, []).append(k)
    docs = [min((docs[k] for k in g), key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[i : i + 10]) for _, b in bench for w in [words(b)] for i in range(len(w) - 9)}
    docs = [(i, t) for i, t in docs if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))]
    own = bpe.codec(bpe.default_path())
    assert got == sorted(((i, own.encode(t).astype("<u4").tobytes()) for i, t in docs), key=str)
    assert 25 not in {i for i, _ in got} and 121 not in {i for i, _ in got} and np.frombuffer(got[0][1], "<u4").size


def test_stages_keep_the_columns_and_empty_tables(spark, tables):
    d, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == 0


def test_stages_keep_clashing_and_odd_columns(spark, tables):
    """Columns named like those that the operators make, or with dots and blanks, come out as they went in."""
    d, rows, _ = tables
    odd = ["score", "hits", "n_lines", "n_dropped", "a.b", "a b", "key", "grp", "node", "best", "positive", "mark", "_q_a", "TEXT2"]
    docs = spark.createDataFrame([(*r[:2], *[f"{c} {k}" for c in odd], k) for k, r in enumerate(rows)], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in odd) + ", n_chars int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c].startswith(c + " ") and r[c].removeprefix(c + " ") == r["a.b"].removeprefix("a.b ") for r in got for c in odd), name
        docs = spark.createDataFrame(got, out.schema)
    assert docs.count() < len(rows)


def test_stages_do_not_need_other_columns(spark, tables):
    d, rows, _ = tables
    docs = spark.createDataFrame([r[:2] for r in rows], "text_id bigint, text string").withColumnRenamed("text_id", "doc_id")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, d)
        assert out.columns == ["doc_id", "text"] and 0 < out.count() <= len(rows)
