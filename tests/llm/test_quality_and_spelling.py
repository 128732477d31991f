"""Weak supervision of quality rules and spelling variants, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmesh.llm import spelling
from trialmesh.llm.quality_rules import MEASURES, RULES, Rule, fit_votes, measured, quality_rules, repeated_words
from trialmesh.llm.spelling import near_in_tile, spelling_groups, spelling_variants, without_drawn_letter

from .helpers import distance, empty_docs, messy_docs, messy_rows


def base_measures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_and_verdicts(spark):
    long = ("word%d other more. " * 9000) % tuple(range(9000)) + "the end of it all is near now " * 3000
    lines = "same line here\n \x0b\nsame line here\nsame line here \n\n" + " ".join("abcdefg")
    extra = [(100, long), (101, lines), (102, "a b c d e f g h " * 2 + "<|>#"), (103, " x y z" * 30), (104, "a b c d e f g h i a b c d e f g h")]
    rows = [(r[0], r[1]) for r in messy_rows()] + extra
    docs = messy_docs(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    docs = docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "_id", "_body", "vote_length", "p_good")})
    got = quality_rules(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", *BASE).collect()) == Counter((i, *base_measures(t)) for i, t in rows)
    assert got.filter("kept AND base_failed").count() == 0
    assert got.filter("kept IS NULL OR p_good IS NULL OR isnan(p_good)").count() == 0
    assert got.groupBy("n_words", "word_chars", "n_symbols", "n_letters").agg(F.count_distinct("kept").alias("k")).filter("k > 1").count() == 0
    assert quality_rules(empty_docs(spark)).count() == 0


def test_repeats_stay_inside_their_text():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("ab"), 30)) for _ in range(40)] + ["a b c d e f g h"] * 2 + ["a b c d e f g h a b c d e f g h", "", None]
    got = measured([None if t is None else t.encode() for t in texts])
    assert [tuple(r[:5]) for r in got] == [base_measures(t)[:5] for t in texts]
    assert repeated_words(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(9)
    n = 200_000
    good = rng.random(n) < 0.8
    says_bad = np.array([[0.5, 0.02], [0.4, 0.01], [0.6, 0.03], [0.5, 0.05], [0.3, 0.3]])
    votes = np.where(rng.random((n, 5)) < np.where(good[:, None], says_bad[:, 1], says_bad[:, 0]), -1, 1)
    votes[rng.random((n, 5)) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit_votes(patterns, counts.astype(float))
    assert abs(model.good_share - 0.8) < 0.03
    assert np.abs(model.votes[:, :, 0] - says_bad).max() < 0.06
    prior, added = model.log_odds()
    odds = prior + sum(added[k, votes[:, k] + 1] for k in range(5))
    # As good as the verdicts of one who knows the true rates.
    true = np.log(np.stack([says_bad, np.ones((5, 2)), 1 - says_bad], axis=2))
    best = np.log(4) + sum((true[k, 1] - true[k, 0])[votes[:, k] + 1] for k in range(5))
    assert ((odds > 0) == good).mean() > ((best > 0) == good).mean() - 0.005
    # The rule that tells nothing has no say.
    assert np.abs(added[4]).max() < 0.15
    assert np.allclose(fit_votes(patterns, counts * 50.0).votes, model.votes, atol=1e-3)


def test_verdicts_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    n = {(r.quality, r.kept): r["count"] for r in judged.filter("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) > 100 and n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, False), 0) >= 9 * n.get((0, True), 0) and n.get((0, False), 0) > 5


def test_rules_vote_and_abstain(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (25.0,), (None,)], "m double")
    up, down = Rule("a", "m", 20, 10), Rule("b", "m", 10, 20)
    assert [tuple(r) for r in df.select(up.vote(), down.vote()).collect()] == [(-1, 1), (0, 0), (1, -1), (0, 0)]
    assert len({r.name for r in RULES}) == len(RULES) and len(set(MEASURES)) == len(MEASURES)


def expected_variants(counts: dict[str, int]) -> set[tuple]:
    near = {w: [x for x in counts if x != w and abs(len(x) - len(w)) < 2 and distance(x, w) == 1] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def similar_words(seed: int, n: int, letters: str = "abé\U0001f600") -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([2, 5, 6, 7]))): rng.choice([1, 2, 3, 6, 12, 30]) for _ in range(n)}
    for w in list(words)[:60]:
        at = rng.randrange(len(w))
        words[w[:at] + rng.choice(letters) + w[at + rng.choice([0, 1]) :]] = rng.choice([1, 2, 9])
    words.update({"aaaaa": 4, "aaaaaa": 8, "aaaaaaa": 16, "aaaaaaaa": 40, "z" * 3000: 7, "z" * 3001: 2, "y": 3, "": 5})
    return words


@pytest.mark.parametrize("block", [2048, 20])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    """Also with many blocks per key, as a frequent prefix has."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "TILE_WORDS", 16 if block == 20 else 256)
    words = similar_words(4, 150)
    short = {w: n for w, n in words.items() if len(w) > 1 and len(w) < 100}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x"), ("nulln", None, "x")], "word string, n bigint, form string").repartition(3)
    got = {tuple(r) for r in spelling_variants(df).collect()}
    assert {g for g in got if g[0] in short} == expected_variants(short)
    assert len(got) == len(words)
    by_word = {g[0]: g for g in got}
    assert by_word["z" * 3001][1] == "z" * 3000 and by_word["z" * 3000][4] == 1
    assert by_word["y"][1:] == (None, "y", 3, 0, None)
    assert by_word["aaaaa"][2] == "aaaaaaaa" or by_word["aaaaa"][1] is None


def test_every_edit_position_is_found():
    word = "abcdefgh"
    others = [word[:i] + "x" + word[i + 1 :] for i in range(8)] + [word[:i] + "x" + word[i:] for i in range(9)] + [word[:i] + word[i + 1 :] for i in range(8)]
    for other in others:
        m = max(len(word), len(other))
        hits = sum(len(near_in_tile([word, other], m, side, np.ones(2, bool), False)[0]) for side in (0, 1))
        assert hits == 1, other


def test_groups_of_whole_texts(spark):
    rng = random.Random(8)
    stems = ["receive", "separate", "définir", "MÜLLERIN", "straße", "occured"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(stems) for _ in range(rng.choice([3, 40]))) + rng.choice([" recieve", " seperate", "1separate2", " définira", ""])
        rows.append((i, text))
    rows += [(None, "separate " * 4), (60, None), (61, ""), (62, "separte separte separte " * 200), (63, "12 --- \n"), rows[3], rows[3]]
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    assert {tuple(r) for r in spelling_groups(df, spelled=without_drawn_letter).collect()} == expected_variants(counts)
    assert spelling_groups(empty_docs(spark)).count() == 0
    assert without_drawn_letter(1, "abcdef", every=1) != "abcdef"
