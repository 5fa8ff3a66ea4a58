"""Small documents with everything that can be odd about them, and plain Python versions to compare with."""

import random
import re

WORDS = "river stone market garden window letter engine harbour cotton silver winter travel music doctor bridge forest kitchen paper village morning".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, h long, tokens long, p double, again boolean, row string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1):
    """Rows of (doc_id, text, lang, source, n_chars) and more columns whose names operators might use themselves."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(8, 60)) for _ in range(30)]
    texts = list(base)
    texts += [base[3]] * 4  # exact copies
    for k in range(12):  # near copies of one long text, each with a word of its own
        words = sentence(random.Random(9), 80).split()
        words[5 * k] = f"x{k}"
        texts.append(" ".join(words))
    texts += ["", None, "   \n\t ", "one two", "one two", "One TWO", "word " * 3000, sentence(rng, 6000), "émigré naïve café œuvre space été", "a\x0bb\x0cc d e f"]
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "cold"][i % 7 == 0], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base[1], None, None, None), (None, None, None, None, None)]  # a repeated row, null ids
    return [(*r, "x", 1, 2, 0.5, True, "y") for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_components(texts):
    """For each index the smallest index that links reach."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]
