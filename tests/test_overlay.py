import random

from pyspark.sql import functions as F

from quarry.operators.overlay import conflicts, merge

EDITS = "seq bigint, op string, old struct<k:int>, row struct<k:int, v:string>"


def test_random_edits_match_a_dictionary(spark):
    for seed in range(6):
        rng = random.Random(seed)
        model = {k: f"b{k}" for k in range(6)}
        base = spark.createDataFrame(list(model.items()), "k int, v string")
        log = []
        for seq in range(14):
            free = [k for k in range(10) if k not in model]
            op = rng.choice(["insert", "update", "move", "delete"])
            if op == "insert" and free:
                k = rng.choice(free)
                model[k] = f"i{seq}"
                log.append((seq, "insert", None, (k, f"i{seq}")))
            elif op == "update" and model:
                k = rng.choice(sorted(model))
                model[k] = f"u{seq}"
                log.append((seq, "update", (k,), (k, f"u{seq}")))
            elif op == "move" and model and free:
                k, to = rng.choice(sorted(model)), rng.choice(free)
                del model[k]
                model[to] = f"m{seq}"
                log.append((seq, "update", (k,), (to, f"m{seq}")))
            elif op == "delete" and model:
                k = rng.choice(sorted(model))
                del model[k]
                log.append((seq, "delete", (k,), None))
        got = merge(base, spark.createDataFrame(log, EDITS), ["k"]).collect()
        assert {r["k"]: r["v"] for r in got} == model and len(got) == len(model)


def test_conflicts_are_changed_or_missing_rows(spark):
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    now = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    assert sorted(r["k"] for r in conflicts(now, seen, ["k"]).collect()) == [2, 3]


def test_no_edits(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    assert merge(base, spark.createDataFrame([], EDITS), ["k"]).agg(F.count("*")).first()[0] == 1
