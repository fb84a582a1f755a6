"""The first value of a key at any depth of a JSON text, against a plain search."""

import json
import random

from inkwell.functions import text as T
from pyspark.sql import functions as F


def plain(value, key):
    if isinstance(value, list):
        for item in value:
            found = plain(item, key)
            if found is not None:
                return found
    elif isinstance(value, dict):
        for k, v in value.items():
            if k == key:
                return v
            found = plain(v, key)
            if found is not None:
                return found
    return None


def some(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.35:
        return r.choice([None, True, 1, -2.5, "k", "a\"b\\", "{[:,]}", "", "é\n"])
    if kind < 0.6:
        return [some(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["k", "a", "b\"", "K", "c d"]) + ("" if r.random() < 0.7 else str(i)): some(r, depth - 1) for i in range(r.randint(0, 4))}


def test_against_a_plain_search(spark):
    r = random.Random(9)
    values = [some(r, 5) for _ in range(400)] + [{"b\"": {"k": None, "z": {"k": 1}}, "c": [{"k": [1, {"k": 2}]}]}]
    rows = [(i, json.dumps(v, indent=i % 3 or None, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)] + [(1000, None), (1001, ""), (1002, "no json"), (1003, '{"k":')]
    df = spark.createDataFrame(rows, "i long, j string")
    for key in ("k", 'b"'):
        got = {x.i: x.v for x in df.select("i", T.json_find(F.col("j"), key).alias("v")).collect()}
        for i, v in enumerate(values):
            want = plain(v, key)
            assert (json.loads(got[i]) if got[i] is not None else None) == want, rows[i]
        assert got[1000] is got[1001] is got[1002] is None
