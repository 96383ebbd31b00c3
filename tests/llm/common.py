"""Small tables and brute-force helpers for the training-data operators."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) if r.random() < 0.3
            else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [(i, " ".join(words(5 + 13 * i % 160, i)), "en" if i % 3 else "de", f"s{i % 4}", i) for i in range(60)]
    rows += [(100, "same text here", "en", "s1", 1), (90, "same  text\there", "en", "s1", 1),
             (95, "same text\n\nhere", None, None, None), (100, "same text here", "en", "s1", 1),
             (101, None, "en", "s1", 0), (102, "", "en", None, 0), (None, "lonely", "en", "s2", 1),
             (None, "same text here", "en", "s2", 1), (103, " \n\t ", "de", "s1", 4), (104, "12345 !!! ???", "de", "s1", 1),
             (105, " ".join(words(60000, 9007)), "en", "s0", 1), (106, "tie", "en", "s0", 1), (106, "tie2", "en", "s0", 1),
             (107, "Straße ÀÉ ǅ naïve    x", "de", "s1", 1), (108, "to " * 3000, "en", "s1", 1)]
    return rows


def union_find(n, pairs):
    low = list(range(n))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
