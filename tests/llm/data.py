"""Small hostile tables: nulls, empties, ties, repeats, long texts and clashing names."""

import random

WORDS = "the of and lorem dolor haus straße été niño über tion ing ed re con der die les que por".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", "x", "ab", str(rnd.randrange(50))]) for _ in range(n))


def texts(seed=1, n=60):
    """Texts with copies, near copies, shared passages and odd ones."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randrange(1, 120)) for _ in range(n)]
    passage = prose(rnd, 70)
    out = list(base)
    for t in base[:n // 2]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out += [" ".join(w), t.upper() if rnd.random() < 0.3 else t, t + " " + passage, passage[5:] + " | " + t]
    out += [None, None, "", "", " \t\n", "one", "One", "a b c d", "A b  c\td", "ab" * 4000, "x y " * 3000, "naïve \x00 nul", "\U0001f600 " * 30, passage]
    rnd.shuffle(out)
    return out


def documents(spark, rows=None, extra=True):
    """doc_id, text, lang, source, n_chars, with repeated rows, a null id and columns named like results."""
    if rows is None:
        rows = [(k * 3 % 1009, t) for k, t in enumerate(texts())]
        rows += rows[:3] + [(None, "null id the of and"), (None, None), (5000, rows[0][1])]
    langs = ["en", "de", None, "fr"]
    full = [(i, t, langs[k % 4], f"s{k % 2}", len(t or ""), 0.5, "z", k) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_words int").repartition(3)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark, like):
    return spark.createDataFrame([], like.schema)
