import random

import pytest


def make_rows(seed=1, n=60):
    """Texts with copies, near copies, shared passages, periodic runs, nulls, empty texts, repeated rows and ids."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = prose(70)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0 or not rows:
            text = "\n".join(prose(rng.randint(3, 30)) for _ in range(rng.randint(1, 8)))
        elif kind in (1, 2):
            text = rng.choice(rows)[1]
        elif kind in (3, 4):
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            text = " ".join(w)
        elif kind == 5:
            text = prose(rng.randint(0, 40)) + " " + passage + "\n" + prose(rng.randint(0, 40))
        elif kind == 6:
            text = (rng.choice(words) + " ") * rng.randint(1, 300) + passage[: rng.randint(0, 300)]
        elif kind == 7:
            text = "\t  " + passage[:60].upper() + " \r\n" + prose(3) + "\n\n" + passage[:60]
        elif kind == 8:
            text = prose(rng.randint(0, 6))
        else:
            text = "Mail a.b@c.de, a@b, 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 tel +1 (269) 555-3296 4524132264652876 iban GB82 WEST 1234 5698 7654 32 x@y.z_q@r.s 1.2.3.4.5"
        rows.append((rng.choice([i, i, i * 7]), text))
    rows += [(None, None), (None, rows[0][1]), (5, None), (6, ""), (7, "   \n\t"), (8, "\n"), (9, "日本語   text 語" * 40), rows[3], rows[3], (10, "one"), (11, "ONE"), (12, "one two")]
    rows.append((13, " ".join(rng.choice(words) for _ in range(9000))))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names operators might use themselves."""
    sources = ["a", "b", None, "Ä", ""]
    full = [(d, t, sources[i % 5], i, "x", -i) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, source string, size int, key string, id int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
