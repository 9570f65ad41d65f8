import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, length long, bucket long, salt string, `rank` long, score double, label int, h1 long, word string"


def table(spark, rows):
    """Documents with extra columns whose names clash with what operators use inside."""
    full = [(i, t, "en", "src0", len(t or ""), 7, 7, "x", 7, 0.5, 1, 7, "w") for i, t in rows]
    return spark.createDataFrame(full, NAMES)


def odd_rows(seed=3):
    """Nulls, empties, ties, repeats, spaces of all kinds, unicode and a very long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", " ", "\n\t ", "a", "A  b\n\nc", "é" * 40, "İΣσ q z w", say(50), say(5000), "it's  'll <|endoftext|> 12345 ,.;!", "x" * 3000]
    same = say(80)
    texts += [same, same, same.upper(), same + " tail", f"{say(30)}\n{same}\n{say(25)}"]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    return rows + [(rows[4][0], "a"), (None, "a null id")]


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
