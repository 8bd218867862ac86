"""Small document tables with the awkward cases: nulls, empty and long texts, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, copy int, _group string, fp string, key string, train string, kind string, row_id string, hits string"
N_EXTRA = 9


def prose(seed: int, n: int, vocabulary: int = 60) -> str:
    rng = random.Random(seed)
    parts = []
    for i in range(n):
        parts.append(rng.choice("abcdefgh") + rng.choice(["ing", "ed", "tion", "la", "der"]) + str(rng.randrange(vocabulary) or ""))
        parts.append(rng.choice([" ", " ", " ", "  ", "\n", "\t", ", "]))
    return "".join(parts[:-1])


def rows():
    shared = prose(900, 40)
    texts = [prose(i, 30 + i) for i in range(12)]
    texts += [texts[0], texts[0], texts[1].replace("ing", "ING"), texts[2] + " more", "x " + texts[3]]
    texts += [f"{prose(50, 25)} {shared} {prose(51, 25)}", f"{prose(52, 25)}\n{shared}", shared, shared + " " + shared]
    texts += [None, "", "   \n\t", "one", "two words", "   ", "Ünïcödé 你好 😀\x00 end", "a" * 3000, "word " * 2000, "no break\x1fhere\x85now"]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3 + 1, t, ["en", "fr", None][i % 3], ["big", "big", "small", None][i % 4], len(t or "")))
    out += [out[5], (None, texts[1], "en", "big", 1), (None, None, None, None, None), (-7, texts[7], "fr", "small", 2)]
    return [r + (None,) * N_EXTRA for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
