"""Small tables of texts with all that is awkward."""

import random

AWKWARD = [None, "", " \t\n\x0b\x0c\r", "\n\n", "a", "é", "one\ntwo\n\nthree", "x" * 5000, "word " * 4000, "Zoë ߷ 😀 end", " nbsp line", "last\n"]


def texts(n, seed=0, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]


def table(spark, texts_, ids=None, extra=True):
    """(doc_id, text, lang, source, n_chars) and columns whose names operators may use themselves."""
    rows = []
    for i, t in enumerate(texts_):
        rows.append((i if ids is None else ids[i], t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), "k", 1, 2.0, True, [1]))
    columns = "doc_id long, text string, lang string, source string, n_chars int" + (", key string, id int, score double, kept boolean, node array<int>" if extra else "")
    return spark.createDataFrame(rows if extra else [r[:5] for r in rows], columns)


def near_copies(n, seed=1, edits=(0, 1, 2, 4, 9)):
    """Texts of 60 words, some of them edits of others."""
    r = random.Random(seed)
    base = [t.split() for t in texts(n, seed, 90)]
    out = [" ".join(b) for b in base]
    for i in range(n):
        words = list(base[r.randrange(n // 3)])
        for _ in range(r.choice(edits)):
            words[r.randrange(len(words))] = f"edit{r.randrange(9999)}"
        out.append(" ".join(words))
    return out
