import random

import pytest

#: Names that operators use inside; tables may have them too.
EXTRA = ["fp", "h", "component", "block", "slot", "place", "at", "key", "words", "_w", "_s", "bucket", "guest", "score", "predicted", "near", "id"]


def prose(r, n, vocabulary=400):
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): prose, copies, near copies, nulls, empty and long texts, repeated rows."""
    r = random.Random(5)
    out = [(i, prose(r, r.randint(30, 120)), "en" if i % 2 else "de", f"src{i % 3}") for i in range(60)]
    out += [(100 + i, out[7][1], "en", "src0") for i in range(5)]  # exact copies
    near = out[9][1].split()
    for i in range(4):
        changed = list(near)
        changed[i * 3] = "changed"
        out.append((110 + i, " ".join(changed), "de", "src1"))
    out += [(120, None, "en", "src1"), (121, "", None, None), (122, " \n\t ", "en", "src2"), (123, "one", "de", None), (124, "ONE", "de", "src0"), (125, "é ß 日本語 ✓ ẞ", "en", "src0"), (126, prose(r, 6000), "en", "src0")]
    out += [out[3], out[3], (None, "a row without an id", "en", "src1"), (None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in EXTRA}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id = -1")
