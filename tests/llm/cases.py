"""Small documents with the cases that every operator must handle."""

import random

DOCS = "doc_id long, text string, source string, kept string, `size` string, row_in string"


def corpus(seed=5, n=60):
    """(doc_id, text, source) with copies, near copies, shared passages, blanks, nulls and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvwyzäé", k=rng.randint(2, 9))) for _ in range(800)]
    vocabulary += ["the", "and", "of", "to", "la", "de"] * 10

    def prose(k):
        out = []
        while k > 0:
            m = min(k, rng.randint(4, 14))
            out.append(" ".join(rng.choices(vocabulary, k=m)).capitalize() + ".")
            k -= m
        return "\n".join(out)

    passage = prose(70)
    docs = []
    for i in range(n):
        docs.append(prose(rng.randint(60, 300)))
    for i in range(0, 24, 2):
        docs[i + 1] = docs[i]  # exact copies
    for i in range(24, 36, 3):
        words = docs[i].split(" ")
        words[len(words) // 2] = "changed"
        docs[i + 1] = " ".join(words)
        docs[i + 2] = docs[i] + " Tail added."
    for i in range(40, 50):
        docs[i] = docs[i] + "\n" + passage + "\n" + prose(20)
    docs[50] = "\n".join(["Same line of six words here"] * 40)
    docs[51] = "ab" * 400 + " " + "x" * 900
    docs[52] = "\t \x0b\f\r\n "
    docs[53], docs[54], docs[55] = "", None, "one two"
    docs[56] = " ".join(w + "###" for w in prose(80).split())
    docs[57] = prose(9000) + " <|endoftext|> <|STARTOFTEXT|> İI\u0307 A\u030a 12.5's"
    docs[58] = docs[57][30_000:38_000]
    docs[59] = "wait...\n" * 60
    return [(i * 7 % 61, d, None if i % 11 == 0 else f"s{i % 4}") for i, d in enumerate(docs)]


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "k", "s", "r") for r in rows], DOCS)


def odd_rows():
    """Null ids, repeated rows and one id with two texts."""
    base = corpus(9, 60)[:12]
    return base + [base[0], base[0], (None, base[1][1], None), (None, base[1][1], None), (base[2][0], base[5][1], "x"), (None, None, None)]
