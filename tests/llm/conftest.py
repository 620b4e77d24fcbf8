"""Small tables that hold every odd case at once."""

import random

import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ta", "ro", "mi", "qu", "Ze", "é", "陷") for b in ("n", "lo", "rd", "x", "ph")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(60) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (20, base[0])]  # copies, one of them a repeated row
    rows += [(22, base[1] + " tail"), (23, "  " + base[2].upper() + "\t\n"), (24, base[3].replace("tan", "ton", 1))]
    rows += [(30, None), (31, ""), (32, " \t "), (33, "one"), (34, "one two"), (35, "ONE"), (36, LONG), (None, base[4]), (None, None), (-5, base[5] + "\n" + base[6])]
    rows += [(40, base[7] + "\n\n" + base[7]), (41, "a\x00b c"), (42, text(200))]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else f"s{(i or 0) % 4}", len(t or ""), 1, "k", 2) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, key string, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
