from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, grp string"


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    """Small documents of a small vocabulary: copies, near copies, shared passages, nulls, empty, long and repeated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "çé", "10", "3.5", "#tag", "a|b", "été."]
    make = lambda k: rng.choices(words, k=k)
    passage, rows = make(30), []
    for i in range(n):
        text = make(rng.choice([0, 1, 2, 5, 12, 13, 14, 40, 90]))
        if i % 5 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[rng.randrange(5) :]
        if i % 7 == 3:
            text = list(rows[-1][1].split()) if rows[-1][1] else text
            if len(text) > 30 and i % 2:
                text[rng.randrange(len(text))] = "changed"
        joined = "".join(w + rng.choice([" ", " ", "\n", "\t ", " "]) for w in text)
        rows.append((i * 3, joined, rng.choice(["en", "fr"]), rng.choice(["a", "a", "b"]), len(joined), "x", "y"))
    rows += [(1000, None, None, None, None, None, None), (1001, "", "en", "", 0, "", ""), (1002, " \n\t", "en", "a", 3, "", ""), (None, "no id " * 20, "en", "b", 120, "", ""), (1004, "no id " * 20, "en", "b", 120, "", ""), (1005, "no id " * 20, "en", "b", 120, "", "")]
    rows += [rows[5], rows[5], (1003, "long " + " ".join(make(9000)), "fr", "a", 1, "", "")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
