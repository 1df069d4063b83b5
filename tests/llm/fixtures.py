"""Small tables with every awkward case: nulls, blanks, long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row_key long, `_part` int, n long, w string, media string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))


def lines(seed: int, n: int, width: int = 12) -> str:
    return "\n".join(words(seed * 1000 + i, width) for i in range(n))


def awkward(spark):
    base = words(1, 120)
    part = base.split(" ")
    near = " ".join([*part[:60], "changed", *part[61:]])
    passage = lines(7, 4)
    texts = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "two words"), (9, "TWO  words"),
        (10, words(2, 30_000)), (11, words(3, 50) + "\n" + passage + "\nend"), (12, passage), (13, passage + "\n" + words(4, 30)),
        (14, "a\na\na\na\na"), (15, "héllo wörld 😀 ﬁn"), (None, words(5, 40)), (None, None), (1, base), (16, words(6, 200)), (17, "\n\n\n\n"),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, k, k, k, "w", "m") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
