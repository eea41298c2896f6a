"""Small documents tables for the operators' tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    # columns of other tables' names, which no operator may trip over
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("digest", "token", "rep", "pos", "n", "key", "size", "word")} | more)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    """Families of near copies, exact copies, shared passages, edge cases."""
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "One", "one two three", "ONE two\tthree", "a b c d", "a b c d e", "same " * 120, "same " * 90]
    passage = prose(rng, 70, 10**6)
    for _ in range(6):
        base = prose(rng, rng.randrange(60, 160), 10**6)
        out += [base, base, base.replace(" ", "  ")]
        out += [edited(rng, base, rng.randrange(1, 8)) for _ in range(8)]
    for _ in range(25):
        out.append(prose(rng, rng.randrange(20, 200), 10**6) + "\n" + passage + " " + prose(rng, 30, 10**6))
    out += [prose(rng, rng.randrange(1, 40), 6) for _ in range(60)]
    out.append("é" * 3000 + " " + "x" * 5000 + " " + prose(rng, 3000))
    rng.shuffle(out)
    return out
