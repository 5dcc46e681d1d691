"""Small documents with every awkward case, and plain readings of them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sentence(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def documents(seed=0, n=60):
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, a long
    text, nulls in every column, empty and blank texts, repeated rows."""
    draw = random.Random(seed)
    texts = [sentence(draw, draw.randrange(1, 120)) for _ in range(n)]
    texts[3] = texts[2]
    texts[4] = texts[2].upper() + "\n"
    base = sentence(draw, 80)
    for k in range(5, 12):
        w = base.split(" ")
        w[draw.randrange(80)] = "changed"
        texts[k] = " ".join(w)
    texts[12] = sentence(draw, 6000)
    texts[13:17] = ["", None, " \t\n", "one"]
    sources = [draw.choice(["a", "b", "c", "é", None]) if k % 3 else "hot" for k in range(n)]
    rows = [
        (k, t, draw.choice(["xx", "yy", None]), s, None if t is None else len(t))
        for k, (t, s) in enumerate(zip(texts, sources))
    ]
    rows += [(2**62 + 1, texts[21], "xx", "a", 2**53 + 1)]
    rows += [rows[2], rows[2], (None, texts[2], None, None, None), (None, None, None, None, None), (1, texts[20], "xx", "a", 5)]
    return rows


def frame(spark, rows, schema=DOCUMENTS):
    return spark.createDataFrame(rows, schema).repartition(3)
