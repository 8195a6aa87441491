"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

WORDS = [f"wort{k}" for k in range(400)] + ["der", "und", "the", "of", "Ähre", "naïve", "don't", "x"]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)) + "."


def documents(spark, seed=5):
    rnd = random.Random(seed)
    passage = sentence(rnd, 60)
    rows = []
    for k in range(24):
        lines = [sentence(rnd, rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))]
        if k % 5 == 0:
            lines.insert(0, passage)
        rows.append((k, "\n".join(lines), ["en", "de", None][k % 3], ["a", "b", None][k % 3], 0))
    rows += [(100, rows[3][1], "en", "a", 0), (101, rows[3][1].replace("wort1", "wort2"), "en", "a", 0)]
    rows += [(102, None, "de", "b", None), (103, "", None, None, 0), (104, " \n\t ", "en", "a", 3), (105, "12 34 !!", "en", "c", 8), (None, rows[4][1], "de", "c", 0)]
    rows += [rows[6], rows[6], (106, sentence(rnd, 4000), "de", "long", 0), (107, "a b\x1cc  d e <|endoftext|> 日本語テキスト", "ja", "a", 0), (108, "w " * 40, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3)
