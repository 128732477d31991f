"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names the operators use themselves."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row bigint, first string, size int, taken string, v string, label string"


def messy_rows(seed: int = 5, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "d", "Eta's", "été", "zeta.", " odd", "x" * 90, "1,000", "<|endoftext|>", "İz"]
    passage = " ".join(rng.choice(words) + str(k) for k in range(60))
    rows: list[tuple] = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 6, 80])))
        if i % 5 == 0:
            text = text + rng.choice(["\n", "  ", " \t"]) + passage + " tail" * (i % 3)
        if i % 8 == 7:
            text = rows[i - 2][1] or ""
        rows.append((i, text, "en", rng.choice(["b", "a", "é", None]), len(text), 0, "f", 1, "t", "v", "l"))
    rows += [(n, None, None, None, None, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, 0, "", 0, "", "", ""), (n + 2, " \t\n ", "en", "b", 4, 0, "", 0, "", "", "")]
    rows += [(None, "no id " * 12, "en", "a", 72, 0, "", 0, "", "", ""), rows[3], rows[3], (n + 3, ("long text " + passage + "\n") * 40, "en", "b", 0, 0, "", 0, "", "", "")]
    return rows


def messy_docs(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


class Groups:
    """Union-find over hashable names."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)
