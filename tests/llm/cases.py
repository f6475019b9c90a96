"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, row long, spans string"


def words(rnd, n, letters="abcdefghij"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def texts(seed=1):
    rnd = random.Random(seed)
    base = words(rnd, 120)
    near = base.copy()
    near[60] = "changed"
    far = words(rnd, 120)
    passage = " ".join(words(rnd, 60))
    return [
        None, "", "   \n\t ", "one", "One", "two words", " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), "x" * 5000, " ".join(words(rnd, 3000)),
        f"head {passage} tail", f"other start {passage} other end", "ÀÉ ünïcode 日本語 😀 " * 30, "line one.\nline one.\nline two.\n\n| a | b | c | d | e |", "abc " * 200, "<|endoftext|> a <|endoftext|>",
    ]


def rows(seed=1):
    made = [(i, t, "en" if i % 2 else None, "src0", len(t or ""), 0.5, True, 1, 2, "x") for i, t in enumerate(texts(seed))]
    made.append(made[6])  # a repeated row
    made.append((None, "a null id", "de", None, None, None, None, None, None, None))
    made.append((None, None, None, None, None, None, None, None, None, None))
    return made


def table(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
