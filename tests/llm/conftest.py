import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, null, empty, very short and long texts."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5))) for _ in range(400)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(20, 120))) for _ in range(40)]
    for i in range(12):
        w = out[i % 5].split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += [out[7], out[7].upper(), "", None, "one two", "one two", " ".join(r.choice(words) for _ in range(6000)), "Straße\nÉté – naïve Å"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids from 0, and columns whose names could clash."""
    rows = [(i, t, "en" if i % 2 else None, None, len(t) if t else 0, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
