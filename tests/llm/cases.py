"""Small tables with the awkward rows that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def awkward(seed=1, n=60):
    """Copies, near copies, shared runs of lines, nulls in any column, empty and long texts, repeated rows."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(k))
    shared = [sentence(r.randrange(3, 30)) for _ in range(8)]
    rows = []
    for i in range(n):
        lines = [sentence(r.randrange(1, 25)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.6:
            at, k = r.randrange(len(lines) + 1), r.randrange(0, 5)
            lines[at:at] = shared[k : k + r.randrange(1, 4)]
        rows.append(doc(i * 3 + 1, "\n".join(lines), r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None])))
    rows += [doc(1000 + i, rows[i][1]) for i in range(0, 12)]
    rows += [doc(2000 + i, rows[0][1].upper()) for i in range(3)]
    rows += [doc(3000, None), doc(3001, ""), doc(3002, " \n\t "), doc(3003, "É é ﬁ"), doc(3004, "é É fi"), doc(3005, "x"), doc(3006, "😀 y\n\n\n")]
    rows += [doc(None, "no id"), doc(None, "no id"), doc(None, None), (3100, "only", None, None, None)]
    rows += [rows[5], rows[5], rows[7]]  # repeated rows
    rows.append(doc(3200, "\n".join(sentence(12) for _ in range(800))))
    r.shuffle(rows)
    return rows


def table(spark, rows, clash=True, partitions=3):
    """The rows, with further columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    if clash:
        for name in ("row", "key", "kept", "digest", "block", "size", "next", "k1", "start", "print", "label", "score", "part"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
