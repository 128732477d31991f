"""Operators on texts against brute force on messy rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialmesh.llm.exact_dedup import exact_dedup, misra_gries
from trialmesh.llm.files import new_file
from trialmesh.llm.line_dedup import banded_distance, character_counts, edit_links, line_dedup, may_be_near
from trialmesh.llm.line_dedup import distance as edit_distance
from trialmesh.llm.mixing import mix, mixed_rows, slim_documents, source_targets
from trialmesh.llm.ngram_join import SignatureTree, bitmap, dual_traversal, needed, ngram_join, shingle_set, shingle_sets, similar_candidates, small_candidates
from trialmesh.llm.packing import closest_fill, pack, pack_lengths
from trialmesh.llm.queries import op6_line_dedup
from trialmesh.llm.rows import numbered
from trialmesh.llm.substring_dedup import LONGEST, ROUNDS, WINDOW, parse, substring_dedup
from trialmesh.llm.token_files import TokenFile, pack_block, read_token_files, unpack_block, write_token_files
from trialmesh.llm.tokens import encoder, tokenizer_path
from trialmesh.runtime import Scratch

from .helpers import Groups, distance, empty_docs, messy_docs, messy_rows


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_exact_dedup(spark):
    got = exact_dedup(messy_docs(spark)).collect()
    groups = defaultdict(list)
    for r in messy_rows():
        groups[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    expected = Counter()
    for text, own in groups.items():
        for k, x in enumerate(sorted(own)):
            expected[(x[3], min(own)[3], len(own), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected
    assert exact_dedup(empty_docs(spark)).count() == 0


def test_exact_dedup_with_few_counters(spark):
    """The result doesn't depend on which digests the summaries find."""
    one, many = (Counter(map(tuple, exact_dedup(messy_docs(spark), counters=k).drop("_row").collect())) for k in (1, 1000))
    assert one == many


def test_misra_gries_keeps_frequent_keys():
    keys = ["a"] * 50 + [f"r{i}" for i in range(60)] + ["b"] * 40
    counts = {}
    for at in range(0, len(keys), 7):
        counts = misra_gries(counts, Counter(keys[at : at + 7]), 4)
    assert len(counts) <= 4 and counts["a"] >= 50 - len(keys) / 5 and "b" in counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_those_of_the_whole_text(name):
    own = encoder(tokenizer_path(name))
    plain = Tokenizer.from_file(tokenizer_path(name))
    texts = [r[1] for r in messy_rows()] + ["a  b", "don't 'them", " \n x\t\ty ", "áb ć", "AİB", "x²3", "​ a", "\x85", "it's  ", "café́!", "a<|endoftext|>b", "x <|startoftext|> y<|ENDOFTEXT|>", "<|endoftext|>", "<|endoftext| >"]
    for _ in range(3):
        for text, ids in zip(texts, own.encode(texts, 7)):
            assert np.frombuffer(ids, "<u2").tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7]


def test_token_blocks_and_random_access(tmp_path):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(9), [7], [0, 2**32 - 1], rng.integers(0, 50_000, 8192), [*rng.integers(0, 9, 500), 2**31, 70_000]):
        ids = np.array(ids, np.uint32)
        assert (unpack_block(pack_block(ids)) == ids).all()
    block = bytearray(pack_block(np.arange(100, dtype=np.uint32)))
    block[20] ^= 1
    with pytest.raises(ValueError):
        unpack_block(bytes(block))


def test_token_files(spark):
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    scratch = Scratch(spark)
    manifest = write_token_files(messy_docs(spark), scratch.path("files"), tokenizer_path("byte_bpe_50k.json"), scratch=scratch)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert [r.doc_id for r in got] == sorted((r[0] for r in messy_rows()), key=lambda x: (x is not None, x))
    expected = Counter((r[0], np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in messy_rows())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == expected
    with open(manifest.first()["path"].removeprefix("file:"), "rb") as f:
        file = TokenFile(f)
        whole = file.ids(0, file.n_ids)
        assert (file.ids(5, 40) == whole[5:40]).all() and len(file.ids(3, 3)) == 0
    empty = write_token_files(empty_docs(spark), scratch.path("none"), tokenizer_path("byte_bpe_50k.json"), scratch=scratch)
    assert read_token_files(empty).count() == 0


def test_a_failed_attempt_leaves_no_file(tmp_path):
    with pytest.raises(RuntimeError), new_file(f"{tmp_path}/x/f") as out:
        out.write(b"half")
        raise RuntimeError
    assert not (tmp_path / "x" / "f").exists()


def test_closest_fill_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        items = rng.integers(1, 40, rng.integers(0, 9)).tolist()
        capacity = int(rng.integers(0, 90))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= capacity}
        taken = closest_fill(dict(Counter(items)), capacity)
        assert sum(n * k for n, k in taken.items()) == max(sums)
        assert all(k <= Counter(items)[n] for n, k in taken.items())


def test_packing_has_no_padding_and_loses_nothing(spark):
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.choice([1, 2, 5, 683, 700, 2047, 2048, 2049, 9001], rng.integers(0, 14)).tolist()
        pieces = defaultdict(list)
        for sequence in pack_lengths(lengths):
            total = sum(n for _, _, n in sequence)
            assert total <= 2048 and total & (total - 1) == 0
            for item, start, n in sequence:
                pieces[item].append((start, n))
        for item, n in enumerate(lengths):
            at = 0
            for start, m in sorted(pieces[item]):
                assert start == at
                at += m
            assert at == n

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = pack(messy_docs(spark), tokenizer_path("word_bpe_49k.json"), end=1).collect()
    ids = {(r[0], len(i)): i for r in messy_rows() for i in [[*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]]}
    for r in rows:
        own = np.array(ids[(r.doc_id, r.doc_tokens)], "<u4")
        assert zlib.crc32(r.ids) == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in messy_rows())
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    assert pack(empty_docs(spark), tokenizer_path("word_bpe_49k.json"), end=1).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = numbered(messy_docs(spark), Scratch(spark))
    slim = slim_documents(rows.select("_row", "doc.doc_id", "doc.source", "doc.text"), row_col="_row")
    taken = mix(slim)
    got = taken.collect()
    by = defaultdict(list)
    sources = {r[0]: r[3] for r in messy_rows()}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[sources[r.doc_id]].append(r)
    total = sum(r.size for r in got)
    assert total == sum(len(words(r[1])) for r in messy_rows())
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 3 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6
    again = Counter((r.doc_id, r.size, r.taken) for r in mix(slim).collect())
    assert again == Counter((r.doc_id, r.size, r.taken) for r in got)
    mixed = mixed_rows(rows, taken)
    assert mixed.columns == messy_docs(spark).columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mix(slim_documents(empty_docs(spark))).count() == 0


@pytest.mark.parametrize("sizes", [[10, 10, 1000], [1, 1, 1], [0, 5, 0], [0, 0], [1, 0, 3, 500, 2, 2], [7]])
def test_source_targets(spark, sizes):
    names = [None, "z", "b", "a", "c", "\U0001f600"][: len(sizes)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint")).collect()}
    order = sorted(names, key=lambda x: (x is None, (x or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    cap = {s: 3.0 * n for s, n in zip(names, sizes)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes) - sum(cap[s] for s in capped)
        target = {s: cap[s] if s in capped else left * weight[s] / sum(weight[t] for t in free) for s in names}
        over = {s for s in free if target[s] > cap[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(target)


def _components(docs):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ([x.encode().lower() for x in words(r[1])] for r in docs)]
    groups = Groups()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                groups.join(i, j)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[groups.root(i)].append(i)
    least = {root: min(((docs[i][0] is None, docs[i][0] or 0, docs[i][0]) for i in own))[2] for root, own in members.items()}
    return Counter((docs[i][0], len(sets[i]), least[groups.root(i)]) for i in range(len(docs)))


def test_ngram_join(spark):
    rng = np.random.default_rng(4)
    rows = messy_rows()
    base = [f"w{k}" for k in range(120)]
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            own[at] = f"e{rng.integers(0, 9)}"
        rows.append((1000 + k, " ".join(own[: 120 - k % 9]), "en", "a", 0, 0, "", 0, "", "", ""))
    docs = spark.createDataFrame(rows, messy_docs(spark).schema).repartition(4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs).collect()) == _components(rows)
    assert ngram_join(empty_docs(spark)).count() == 0


def test_signature_trees_lose_no_similar_pair():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 48, rng.integers(20, 60)).astype(np.uint64)
        for _ in range(4):
            keep = rng.random(len(base)) > 0.08
            sets.append(np.unique(base[keep]))
    width = max(len(bitmap(s)) for s in sets)
    own = [i for i, s in enumerate(sets) if len(bitmap(s)) == width]
    tree = SignatureTree(np.stack([bitmap(sets[i]) for i in own]), np.array([len(sets[i]) for i in own]))
    found = {(own[x], own[y]) for a, b in dual_traversal(tree, tree) for x, y in zip(a, b)}
    similar = {(i, j) for i in own for j in own if len(np.intersect1d(sets[i], sets[j])) >= needed(len(sets[i]), len(sets[j]))}
    assert similar <= found and len(found) < len(own) ** 2 / 4


def test_small_buckets_together_equal_their_trees():
    rng = np.random.default_rng(16)
    sets, bucket = [], []
    for b in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(3, 1500)).astype(np.uint64)
        for _ in range(rng.integers(1, 9)):
            sets.append(np.unique(base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.12])]))
            bucket.append(b)
    maps, sizes = [bitmap(s) for s in sets], np.array([len(s) for s in sets])
    bucket, group = np.array(bucket), rng.integers(0, 400, len(sets))
    together = {frozenset((int(x), int(y))) for a, b in small_candidates(maps, sizes, group, bucket) for x, y in zip(a, b)}
    alone = set()
    for b in range(60):
        own = np.flatnonzero(bucket == b)
        for x, y in similar_candidates([maps[i] for i in own], sizes[own], group[own]):
            alone |= {frozenset((int(own[i]), int(own[j]))) for i, j in zip(x, y)}
    similar = {
        frozenset((i, j))
        for i in range(len(sets))
        for j in range(i)
        if bucket[i] == bucket[j] and group[i] != group[j] and len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= needed(len(sets[i]), len(sets[j]))
    }
    assert similar <= alone and similar <= together and len(similar) > 50
    assert len(together) < 1.5 * len(similar)


def test_texts_together_have_the_sets_of_each_alone():
    class Words(dict):
        def __missing__(self, w):
            return hash(w) & (2**64 - 1)

    texts = [row[1] for row in messy_rows()] + ["a", "", None, "a b c d", "a b c d e", "A B C D E f", "a b c d e a b c d e"]
    for text, own in zip(texts, shingle_sets(texts, Words())):
        assert own.tolist() == shingle_set(text, Words()).tolist()
        w = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
        assert len(own) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())


def test_short_texts_are_one_shingle():
    class Words(dict):
        def __missing__(self, w):
            return hash(w) & (2**64 - 1)

    assert len(shingle_set("a b", Words())) == 1 and len(shingle_set(None, Words())) == 0
    assert shingle_set("A b C", Words()) == shingle_set("a B c", Words()) != shingle_set("a b", Words())


def test_recompression_agrees_inside_equal_windows():
    rng = np.random.default_rng(8)
    assert sum(limit for _, limit in ROUNDS) < WINDOW // 2
    for kinds in (3, 50, 10_000):
        window = rng.integers(0, kinds, WINDOW).astype(np.uint64)
        middles = set()
        for _ in range(20):
            left, right = (rng.integers(0, kinds, n).astype(np.uint64) for n in rng.integers(20, 90, 2))
            start, size = parse(np.concatenate([left, window, right]))
            assert size.max() <= LONGEST
            at = np.searchsorted(start, len(left) + WINDOW // 2, "right") - 1
            middles.add((int(start[at]) - len(left), int(size[at])))
        assert len(middles) == 1


def test_substring_dedup(spark):
    got = Counter(map(tuple, substring_dedup(messy_docs(spark)).collect()))
    counts = Counter(tuple(w[i : i + 35]) for w in (words(r[1]) for r in messy_rows()) for i in range(len(w) - 34))
    expected = Counter()
    for r in messy_rows():
        w = words(r[1])
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected[(r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert got == expected
    assert substring_dedup(empty_docs(spark)).count() == 0


def test_banded_distance(spark):
    rng = np.random.default_rng(9)
    rows = [("", ""), ("a", ""), ("", "ab"), ("", "abc"), ("abab", "baba"), ("\U0001f600x", "x")]
    for _ in range(400):
        a = "".join(rng.choice(list("ab"), rng.integers(0, 16)))
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + rng.integers(0, 2)] = rng.choice(list("abé"), rng.integers(0, 2)).tolist()
        rows.append((a, "".join(b)))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d"), banded_distance(F.col("a"), F.col("b")).alias("e")).collect():
        expected = distance(r.a, r.b) if distance(r.a, r.b) <= 2 else None
        assert (r.d, r.e) == (expected, expected)


def test_line_dedup(spark):
    rng = np.random.default_rng(10)
    base = ["".join(rng.choice(list("abcdef "), rng.integers(15, 50))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for k in rng.integers(0, 25, rng.integers(0, 5)):
            line = list(base[k])
            for _ in range(rng.integers(0, 4)):
                line[int(rng.integers(0, len(line)))] = "z"
            own.append("".join(line))
        rows.append((i, "\n".join([*own, ["", "short", " " * 30, "q" * 41][i % 4]]) if i % 13 else None, *messy_rows()[0][2:]))
    rows.append((None, base[0] + "\n" + base[0], *messy_rows()[0][2:]))
    docs = spark.createDataFrame(rows, messy_docs(spark).schema).repartition(3)
    lines = [(r[0] is None, r[0] or 0, p, line) for r in rows for p, line in enumerate((r[1] or "").split("\n")) if len(line) >= 20 and line.strip(" \t")]
    groups, names = Groups(), sorted({x[3] for x in lines})
    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                groups.join(a, b)
    first = {}
    for x in sorted(lines):
        first.setdefault(groups.root(x[3]), x)
    stay = set(first.values())
    expected = Counter()
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for p, x in enumerate(own) if (r[0] is None, r[0] or 0, p, x) in stay or len(x) < 20 or not x.strip(" \t")]
        expected[(r[0], len(own), len(own) - len(kept), "\n".join(kept))] += 1
    assert Counter(map(tuple, line_dedup(docs).collect())) == expected
    assert line_dedup(empty_docs(spark)).count() == 0
    messy = line_dedup(messy_docs(spark)).collect()
    assert len(messy) == len(messy_rows())


def test_lines_that_differ_by_words_make_no_pairs(spark):
    """A crowd of lines that share two segments of three meets in the index; only pairs whose characters allow it become rows."""

    class Counted(Scratch):
        def table(self, df, name="table"):
            written = super().table(df, name)
            sizes[name] = written.count()
            return written

    sizes: dict = {}
    rest = "of a line that is the same in a whole crowd of documents and goes on for a while"
    crowd = [f"the {'abcdeghilmnoprstuwx0'[i] * 4} words {rest}" for i in range(20)] + [f"the aaaa wordz {rest}", f"the aaa words {rest}"]
    rows = spark.createDataFrame([(x,) for x in crowd], "line string").select("line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h"))
    links = edit_links(rows, Counted(spark))
    of = {r.h: r.line for r in rows.collect()}
    assert {frozenset((of[r.a], of[r.b])) for r in links.collect()} == {frozenset(x) for x in itertools.combinations((crowd[0], crowd[20], crowd[21]), 2)}
    assert sizes["pairs"] == 3 and sizes["meeting"] > 40


def test_character_counts_lose_no_near_line(spark):
    rng = np.random.default_rng(12)
    letters = list("etaoinsrhldgbwv01289 é\U0001f600")
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(letters, rng.integers(20, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 9)):
            at = int(rng.integers(0, len(b)))
            b[at : at + rng.integers(0, 2)] = rng.choice(letters, rng.integers(0, 2)).tolist()
        rows.append((a, "".join(b)))
    rows.append(("e" * 200, "e" * 198 + "tt"))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", may_be_near(character_counts(F.col("a")), character_counts(F.col("b"))).alias("near")).collect()
    assert all(r.near for r in got if distance(r.a, r.b) <= 2)
    assert sum(not r.near for r in got) > 10


def test_short_lines_go_with_their_exact_copies(spark, tmp_path):
    """The registered query keeps the first of equal short lines; one edit tells short lines apart, and blank lines stay."""
    long = "a line of more than twenty characters"
    texts = ["menu\nshare\n\n" + long, "menu\nmenv\n \t\n\nshare", None, "", long + "!\nmenu\n" + "x" * 19 + "\n" + "x" * 20, "menu\n" + "x" * 19]
    kept = ["menu\nshare\n\n" + long, "menv\n \t\n", "", "", "x" * 19 + "\n" + "x" * 20, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (len((t or "").split("\n")), gone, hashlib.sha256(k.encode()).hexdigest()) for i, (t, gone, k) in enumerate(zip(texts, [0, 2, 0, 0, 2, 2], kept))}
