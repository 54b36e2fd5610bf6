import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, source="s", extra=False):
        """Rows of documents; a dict gives ids, a list counts from 0. ``extra`` adds columns whose names operators use inside."""
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        df = spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "w", "u", "kept", "words", "spans", "anchor", "piece", "n", "_id", "length", "start", "row", "count", "host"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random prose with copies, near copies, shared passages, odd white space, nulls and empty texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts: dict = {}
    passage, base = prose(70), prose(150)
    for i in range(60):
        w = prose(rng.randint(0, 160))
        if i % 6 == 1:
            k = rng.randint(0, len(w))
            w[k:k] = passage[: rng.randint(45, 70)]
        elif i % 6 == 2:
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif i % 6 == 3:
            w = base[10:90] + w
        text = rng.choice([" ", "\n", "  ", "\t"]).join(w)
        texts[i * 3 % 61] = text.upper() if i % 20 == 5 else text
    texts |= {100: None, 101: "", 102: " \n\t ", 103: "one", 104: "Dup dup dup", 105: "dup DUP dup", 106: " ".join(["again"] * 500)}
    return texts
