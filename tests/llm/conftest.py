import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def base_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(40):
        rows.append([i, " ".join(word() for _ in range(rng.randint(60, 120))) + rng.choice(["", ".\nA line that many texts share, in two words\nend", "\n\tshort\n"])])
    rows[7][1] = rows[3][1]  # a copy
    rows[9][1] = rows[3][1].upper()
    w = rows[4][1].split(" ")
    rows[11][1] = " ".join([*w[:-2], "changed", w[-1]])  # a near copy
    rows[12][1] = " ".join([*w[:20], *rows[12][1].split(" ")])  # a shared passage
    rows[13][1] = "the same words again " * 40
    rows[14][1] = "\x0bodd\x0c white\r\nspace\t and a \x1f control char " + rows[14][1]
    rows[15][1] = "### %%% $$$ " * 60 + "x"
    rows += [[50, None], [51, ""], [52, " \n\t "], [53, "one"], [54, "one"], [55, "few words only here"], [56, rows[5][1] * 60], [57, rows[5][1] * 60], [None, rows[6][1]], [None, None]]
    rows += [[20, rows[20][1]], [60, "tie " * 30], [61, "tie " * 30]]
    return [(i, t, "en", [None, "a", "b", "c"][(k * k) % 4], len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return base_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
