"""Messy documents: nulls, empty and long texts, ties, repeated rows, copies, an extra column of a clashing name."""

import random

WORDS = [a + b for a in ("ba", "ko", "ti", "re", "mu", "za", "lin", "por") for b in ("ne", "sta", "vi", "quo", "ra", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n_removed long, id string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=0, n=60):
    rng = random.Random(seed)
    line = "This site uses cookies. Read more here."
    out = []
    for k in range(n):
        text = "\n".join(sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))
        if k % 4 == 0:
            text += "\n" + line
        out.append((k, text))
    base = sentence(rng, 120)
    for k in range(n, n + 12):
        words = base.split(" ")
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "edit" + str(rng.random())
        out.append((k, " ".join(words)))
    out += [(n + 20, out[0][1]), (n + 21, out[0][1]), (n + 22, ""), (n + 23, None), (n + 24, "   \n\t "), (n + 25, "one"), (n + 26, "One"), (n + 27, "a b c d e"), (n + 28, "é ü Straße ÇA"), (n + 29, sentence(rng, 4000))]
    out += [(5, out[5][1]), (None, out[3][1]), (None, None), (7, "another text for a known id " + sentence(rng, 30)), (n + 30, "x" * 300), (n + 31, "x" * 300 + "y"), (n + 32, "it's <|endoftext|> <turn:user> &amp; 1.2.3")]
    return [(i, t, "en", None if k % 17 == 3 else f"src{k % 12}", len(t or ""), 1, 2, "z") for k, (i, t) in enumerate(out)]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
