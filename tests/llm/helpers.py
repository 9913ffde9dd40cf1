"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import os
import random

import pytest

SYLLABLES = "the an re ti on le der ein ch é ño ga 12 x".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text) rows."""
    rng = random.Random(seed)
    line = "All rights reserved. Licensed line"
    base = words(rng, 80)
    rows = [(i, words(rng, rng.randint(0, 120)) + ("\n" + line if i % 3 == 0 else "")) for i in range(n)]
    near = base.split()
    for i in range(8):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"changed{i}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, base) for i in range(12)]  # copies, as many documents as the line limit
    rows += [(3000, None), (3001, ""), (3002, " \n\t\n "), (3003, "one"), (3003, "one"), (None, "null id"), (None, None),
             (3004, words(rng, 9000)), (3005, "a" * 30_000), (3006, "\x1c odd\x85 blanks\xa0  here \x00 zero"),
             (3007, "日本語 テキスト Größe ÉCOLE I'll don't <|endoftext|> end")]
    return rows


def with_clashes(spark, rows):
    """The rows as a table whose other columns have names that operators use inside."""
    data = [(i, t, f"s{n}", n, n % 2 == 0, float(n)) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, row string, block long, held_out boolean, score double"
                                 ).repartition(3)


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


def vocabulary(name):
    public = pytest.importorskip("public_tokenizers")
    path = public.path(name)
    if not os.path.exists(path):
        pytest.skip(f"{name} is not here")
    return path
