import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, hash string"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, empties, ties, repeated rows, copies, near copies, a long text and odd characters."""
    r = random.Random(5)
    out = []
    for i in range(60):
        w = words(r, r.choice([1, 2, 3, 20, 80, 200]))
        out.append([i, " ".join(w) + r.choice([".", "", "\n\n"]), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), 1])
    passage = " ".join(words(r, 70))
    for i in (3, 17, 40):
        out[i][1] = f"{' '.join(words(r, 9))} {passage}\t{' '.join(words(r, 5))}"
    out[50][1] = out[41][1] = out[20][1]
    near = words(r, 150)
    for k in range(5):
        near[k * 7] = "x" * (k + 1)
        out.append([100 + k, " ".join(near), "en", "a", 1])
    out += [[200, None, None, None, None], [201, "", "en", "b", 0], [202, " \t\n ", "en", "b", 4], [None, "null id text", "de", "c", 12], [203, "Ünïcode ſ ﬁ ​ 漢字 🎉 mixed. text!", "de", "c", 9]]
    out += [out[5], out[5], [5, "another text of the same id", "en", "a", 3]]
    out.append([300, " ".join(words(r, 6000)), "en", "a", 1])
    return [tuple(x) + ("clash", "clash", "clash") for x in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
