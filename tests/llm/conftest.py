import random

import pytest


def invented(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def hard_docs():
    """(doc_id, text) with nulls, empty, odd and long texts, copies, near copies, runs and shared passages."""
    rng = random.Random(5)
    passage = " ".join(invented(rng, 60, 5000))
    base = invented(rng, 300, 5000)
    docs = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Two words"), (5, "same same same same same same"),
        (6, "ÀÉ naïve straße 漢字 x y \u0085 z"), (7, passage), (8, "before " + passage + " after"), (9, passage),
        (10, "x " * 70 + "y"), (11, "z " + "x " * 90), (12, " ".join(base)), (13, " ".join(base)),
        (14, " ".join([*base[:150], "changed", *base[151:]])), (15, "\n".join(["a b c d e f g h i j k"] * 4)),
        (16, " ".join(invented(rng, 9000, 3000))), (17, "A,b;C " * 40), (18, passage.upper()), (19, "\n\n a  b \r\n c "),
    ]
    for i in range(20, 70):
        words = invented(rng, rng.randrange(1, 400), 2500)
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()[rng.randrange(20) : rng.randrange(30, 60)]
        docs.append((i, " ".join(words)))
    docs += [(70 + i, " ".join([*base[: 10 * i], f"v{i}", *base[10 * i + 1 :]])) for i in range(12)]
    docs.append((90, docs[12][1]))
    return docs


@pytest.fixture(scope="session")
def docs_frame(spark, hard_docs):
    rows = [(i, t, "row", i, i) for i, t in hard_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, out long, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs_frame):
    return docs_frame.filter("false")
