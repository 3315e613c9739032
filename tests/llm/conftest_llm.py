import random

import pytest

WORDS = "alder birch cedar dogwood elm fir gum hazel iris juniper kapok larch maple nutmeg oak pine quince rowan spruce teak upas viburnum willow yew".split()


def prose(seed, n):
    """n words in sentences of a few words each."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        s = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(4, 9))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


#: doc_id, text, lang, source, n_chars and columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _a int, size string, rank int, n_removed string, hash string, content string, x string"


def rows():
    a, b = prose(1, 120), prose(2, 200)
    near = a.replace(a.split()[60], "changed", 1)
    passage = prose(3, 60)
    texts = [
        (1, a), (2, a), (3, near), (4, b), (4, b), (5, None), (6, ""), (7, " \n\t "), (8, "Only four words here"), (9, "Only four words here"),
        (None, prose(4, 50)), (None, None), (10, passage + " " + prose(5, 80)), (11, prose(6, 40) + " " + passage), (12, "é " * 30000), (13, "x" * 200000),
        (14, "!!! ??? ..."), (15, "word " * 5000), (16, prose(7, 90).upper()), (17, "<|im_end|> \\ <| ́ ß Σ"),
    ]
    return [(d, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if i % 4 == 0 else len(t or ""), "r", i, "s", i, "n", "h", "c", "x") for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward value."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    labels = [(1, 1, 0), (3, 1, 0), (4, 0, 1), (4, 1, 1), (8, None, None), (None, 1, 1), (10, 0, 0), (11, 1, 1), (16, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
