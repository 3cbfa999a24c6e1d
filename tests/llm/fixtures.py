"""Small documents that hold every awkward case, and helpers for brute-force twins."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, doc string, h long, n int, "
          "words string, spans string, component long, copies int")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(r, n, vocabulary=4000):
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def awkward_texts(seed=1):
    """(doc_id, text): NULLs, empties, repeats, ties, copies, a long text, NULL ids."""
    r = random.Random(seed)
    base = prose(r, 200)
    swapped = base.split()
    swapped[100] = "changed"
    long = "\n".join(prose(r, 12) for _ in range(900))
    passage = prose(r, 70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, base), (7, base),
            (8, " ".join(swapped)), (9, long), (10, prose(r, 60) + " " + passage + " " + prose(r, 40)),
            (11, prose(r, 30) + "\n" + passage), (12, "a b c " * 60), (13, "é ß 日本 \U0001F600 ñ " * 20), (14, "!!! ... ???"),
            (None, base), (None, None), (15, prose(r, 90)), (15, prose(r, 90)), (6, base), (6, base)]
    rows += [(100 + i, prose(r, 80)) for i in range(12)]
    return rows


def frame(spark, rows, sources=("a", "b", None)):
    data = [(i, t, None if k % 7 == 3 else ("en", "fr")[k % 2], sources[k % len(sources)], len(t) if t else None,
             "key", "doc", 5, 6, "w", "s", 7, 8) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)
