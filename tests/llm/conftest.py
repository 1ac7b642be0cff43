"""Documents that are odd in every way an operator must bear, and helpers."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, fp long, votes long, start long"


def words(rng, n, size=6):
    return [("".join(rng.choice("abcdeghimnoprstuéß") for _ in range(rng.randint(1, size)))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, repeated rows, shared passages, one long text."""
    rng = random.Random(4)
    passage, other = " ".join(words(rng, 60)), " ".join(words(rng, 45))
    base = [" ".join(words(rng, rng.randint(20, 160))) for _ in range(25)]
    near = base[0].split(" ")
    near[3] = "changed"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[0]), (102, " ".join(near)), (102, " ".join(near)), (103, base[1]), (103, base[1])]
    rows += [(104, f"{base[2]} {passage} {base[3]}"), (105, f"{passage}\n{base[4]}"), (106, f"{base[5]}\t{passage}"), (107, f"{other} x {other}"), (108, f"{other[:200]}"), (109, passage)]
    rows += [(110, None), (111, ""), (112, " \n\t "), (113, "one"), (None, base[6]), (None, None), (None, base[0]), (114, "a"), (115, "é"), (116, " ".join(["same"] * 300)), (117, "😀 " * 120)]
    rows += [(118, " ".join(words(rng, 9000))), (119, "x" * 30000), (120, "ab" * 400 + "\n" + "ab" * 300)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame([(d, t, None, "s", len(t or ""), "p", 1, 2, None) for d, t in odd_texts], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    """All rows as sorted tuples."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
