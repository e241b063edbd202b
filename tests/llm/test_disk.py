"""What the operators leave in the shared folder."""

import os
import random

import pytest

from quarry.llm import common, lines, neardup


@pytest.fixture
def left(spark, tmp_path, monkeypatch):
    """The names of the tables that are in the shared folder, which is empty at first."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    return lambda: {n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)}


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(n))


def test_near_duplicates_leave_no_texts_or_sets(spark, left):
    rng = random.Random(3)
    rows = [(i, prose(rng, 120)) for i in range(20)]
    rows += [(100 + i, t + " changed") for i, t in rows[:10]] + [(200, rows[11][1]), rows[12], rows[12], (101, rows[1][1] + " changed"), (101, rows[1][1] + " changed")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert not left() & {"prints", "nodes", "candidates", "picked", "sets", "fingerprints", "near", "drawn", "alike", "rooted", "stay"}
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))


def test_lines_leave_no_exploded_lines(spark, left):
    rng = random.Random(4)
    common_line = "a line of more than forty characters that every document holds"
    rows = [(i, f"{prose(rng, 10)}\n{common_line}") for i in range(8)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert not left() & {"keyed", "lines"}
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()} == {i: int(i < 7) for i in range(8)}
