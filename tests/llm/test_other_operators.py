"""Archives, vectors, the classifier chain, components and the pipeline."""

from __future__ import annotations

import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialmesh.llm.components import components
from trialmesh.llm.embedding_dedup import embedding_dedup, visited_lists
from trialmesh.llm.toxicity import chain_labels, fit_chain, score_chain, without_toxic
from trialmesh.llm.warc import archived_pages, encode_record, page_record, payload_of, read_archives, read_records, write_archives
from trialmesh.runtime import Scratch

from .helpers import Groups, empty_docs, messy_docs

PAGES = "page_id bigint, url string, html string, digest string, payload string, response_id int"


def page_rows():
    big, other = "<p>é" * 400, "y" * 999
    rows = [(1, "http://a/ é?x=1\r\ny", big), (2, None, big), (9, "http://b", big), (3, "u", other), (4, "u", other), (5, None, None), (6, "", ""), (None, "n", big), (7, "c", "z" * 1000), (8, "c", "z" * 1000), (8, "c", "z" * 1000)]
    # One id with two long payloads, each the response of a group, and a very long address.
    rows += [(20, "d", "v" * 1500), (20, "d", "w" * 1600), (11, "d", "v" * 1500), (12, "d", "w" * 1600), (13, "http://e/" + "q" * 3_000_000, "short")]
    return [(*r, "d", "p", 3) for r in rows]


def test_archives(spark):
    got = Counter(map(tuple, archived_pages(spark, spark.createDataFrame(page_rows(), PAGES).repartition(2)).collect()))
    expected = Counter()
    best = {}
    for page, _, html, *_ in page_rows():
        if html and len(html.encode()) >= 1000 and page is not None:
            best[html] = max(best.get(html, page), page)
    for page, _, html, *_ in page_rows():
        data = (html or "").encode()
        first = best.get(html, page)
        revisit = first != page
        expected[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == expected
    assert archived_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_archives_give_payloads_back(spark):
    scratch = Scratch(spark)
    manifest = write_archives(spark.createDataFrame(page_rows(), PAGES), scratch.path("archives"), scratch=scratch)
    records = read_archives(manifest).collect()
    assert len(records) == len(page_rows())
    assert {(r.page_id, bytes(r.payload).decode()) for r in records if r.record_type == "response"} >= {(9, "<p>é" * 400), (5, ""), (8, "z" * 1000)}
    assert all(r.payload is None for r in records if r.record_type == "revisit")


def test_damaged_archives_fail():
    payload = b"x" * 5000
    record = page_record(1, "http://a", payload, hashlib.sha1(payload).hexdigest())
    (headers, block), (again, _) = read_records(io.BytesIO(record + record))
    assert payload_of(block) == payload and headers == again
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(record[:-20])))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(page_record(1, None, payload, "0" * 40))))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(encode_record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:00")], b"abc"))))


def vector_rows(n=160, dim=16, seed=11):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centers[i % 12] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, (v * rng.choice([1.0, 50.0])).tolist(), int(i % 3) if i % 19 else None))
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [], 1), (n + 5, [1.0, 0.0], 1), (n + 6, [2.0, 0.1], 1)]
    rows += [rows[4], rows[4], (n + 7, rows[7][1], rows[7][2]), (n + 8, [1e300] * dim, 2), (n + 9, [1e-300] * dim, 2)]
    return [(*r, 1, "x") for r in rows]


VECTORS = "vec_id bigint, embedding array<double>, label int, class int, near string"


def test_embedding_dedup_against_brute_force(spark):
    rows = vector_rows()
    unit = []
    for _, v, label, *_ in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v) / np.abs(v).max() if ok else None
        unit.append(u / np.linalg.norm(u) if ok else None)
    links, groups = Counter(), Groups()
    for i, a in enumerate(unit):
        for j in range(i):
            if a is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(a) == len(unit[j]) and a @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    least = {}
    for i in range(len(rows)):
        least[groups.root(i)] = min(least.get(groups.root(i), rows[i][0]), rows[i][0])
    expected = Counter((rows[i][0], links[i], least[groups.root(i)], rows[i][0] == least[groups.root(i)]) for i in range(len(rows)))
    got = Counter(map(tuple, embedding_dedup(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()))
    assert Counter(x[0] for x in got.elements()) == Counter(x[0] for x in expected.elements())
    # No link that isn't one, and nine in ten found.
    by_id = lambda rows: [(x[0], x[1]) for x in sorted(rows.elements())]
    assert all(a[1] <= b[1] for a, b in zip(by_id(got), by_id(expected)))
    assert sum(x[1] for x in got.elements()) >= 0.9 * sum(links.values())
    assert all(x in got for x in expected if x[0] >= 160 and x[1] == 0)
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_index_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    links = ((v @ v.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup(table).collect()}
    found = sum(got[r.vec_id] for r in rows)
    assert found <= links.sum() and found >= 0.9 * links.sum()


def crowd(n, dim=64, seed=21):
    """A third of the vectors are distinct near copies of one, a few are near copies of others, the rest is alone."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[: n // 3] = v[0] + rng.normal(size=(n // 3, dim)) * 0.28
    v[-n // 10 :] = v[n // 3 : n // 3 + n // 10] + rng.normal(size=(n // 10, dim)) * 0.2
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("n", [700, 5000, 12_000])
def test_every_link_of_a_crowd_is_found(spark, n):
    v = crowd(n)
    close = np.vstack([v[at : at + 1000] @ v.T >= 0.93 for at in range(0, n, 1000)])
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>, label int").repartition(4)).collect()}
    assert [got[i].n_links for i in range(n)] == (close.sum(axis=1) - 1).tolist()
    assert all(got[i].component_id <= min(np.flatnonzero(row)) for i, row in enumerate(close))
    assert all(got[int(j)].component_id == got[i].component_id for i, row in enumerate(close) for j in np.flatnonzero(row)[:3])


@pytest.mark.parametrize("cosine", [0.93, 0.5, -0.1])
def test_linked_vectors_meet_in_one_list(cosine):
    v = crowd(900, dim=12)
    lists = visited_lists(v, v[::9], cosine)
    for i, j in zip(*np.nonzero(np.tril(v @ v.T >= cosine, -1))):
        a, b = lists[i], lists[j]
        assert min(a[0], b[0]) in a and min(a[0], b[0]) in b


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 40)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5), (3, 2), (2, 3), (None, 4)]
    groups = Groups()
    for a, b in edges:
        if a is not None and a != b:
            groups.join(a, b)
    least = defaultdict(list)
    for x in list(groups.up):
        least[groups.root(x)].append(x)
    expected = {x: min(least[groups.root(x)]) for x in groups.up}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()
    assert len(got) == len(expected) and {r.node: r.component for r in got} == expected


def toxic_rows(n=400, seed=13):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic, low = i % 4 == 0, i % 5 == 0
        if toxic:
            text[rng.randrange(len(text))] = "zorq" + rng.choice(vocabulary)
            text.append(rng.choice(["Vile!", "vile"]))
        if low:
            text = [x.upper() + "!!" for x in text]
        rows.append((i, " ".join(text), "en", "a", 0, 0, "", 0, "", "", ""))
        if i % 10:
            marks.append((i, int(not low), int(toxic)))
    return rows, marks


LABELS = "doc_id bigint, quality int, toxic int"


def test_classifier_chain_on_held_out_rows(spark):
    rows, marks = toxic_rows()
    docs, labels = spark.createDataFrame(rows, messy_docs(spark).schema), spark.createDataFrame([*marks, (None, 1, 1), (7, 1, None)], LABELS)
    chain = fit_chain(docs, chain_labels(labels), ("low_quality", "toxic"))
    assert [m["category"] for m in chain] == ["low_quality", "toxic"] and len(chain[1]["earlier"]) == 1
    assert chain[1]["recall"] > 0.9 and chain[1]["false_alarms"] < 0.1
    scored = {r.doc_id: r for r in score_chain(docs, chain).collect()}
    held_out = [i for i in range(400) if i % 10 == 0]
    assert sum((scored[i].p_toxic >= 0.5) == (i % 4 == 0) for i in held_out) >= 0.9 * len(held_out)
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    again = fit_chain(docs, chain_labels(labels), ("low_quality", "toxic"))
    assert [(m["weights"], m["intercept"]) for m in again] == [(m["weights"], m["intercept"]) for m in chain]


def test_classifier_chain_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert without_toxic(messy_docs(spark), none).count() == messy_docs(spark).count()
    assert without_toxic(empty_docs(spark), none).count() == 0
    clean = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    assert without_toxic(messy_docs(spark), clean).count() == messy_docs(spark).count()


def test_pipeline_stages(spark, tmp_path):
    rows, marks = toxic_rows(120)
    rows += [(1000 + i, rows[i][1] + (" " if i % 2 else " more"), *rows[i][2:]) for i in range(0, 120, 3)]
    rows += [(2000, None, *rows[0][2:]), (2001, "", *rows[0][2:])]
    schema = messy_docs(spark).schema
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs, scratch, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        following = scratch.table(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert following.columns == docs.columns
            texts.append([r.text for r in following.collect()])
        docs = following
    toxic, exact, near, mixed = texts
    squeezed = ["".join((t or "").split()) for t in exact]
    assert len(squeezed) == len(set(squeezed)) == len({"".join((t or "").split()) for t in toxic})
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").lower().split() for t in near)]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    total = sum(len((t or "").split()) for t in near)
    assert abs(sum(len(t.split()) for t in mixed) - total) <= len(corpus_pipeline.STAGES)
    assert docs.agg(F.countDistinct("sequence_id")).first()[0] > 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    empty_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scores_replace_columns_of_their_names(spark):
    """One brute-force sum per text; long, empty and null texts, and columns named like the results."""
    from trialmesh.llm.toxicity import word_features

    weights = {x: 0.5 for w in (b"vile", b"Words") for x in word_features(w)}
    chain = [{"category": "low_quality", "weights": {next(iter(weights)): 1.0}, "earlier": [], "intercept": -1.0}, {"category": "toxic", "weights": weights, "earlier": [2.0], "intercept": -2.0}]
    texts = ["vile words, vile!", None, "", "fine " * 200_000 + "vile", "Words words"]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id int, text string, p_toxic string, c0 int")
    got = {r["doc_id"]: r for r in score_chain(df, chain).collect()}
    for i, text in enumerate(texts):
        own = {x for w in (text or "").encode().split() for x in word_features(w)}
        first = 1 / (1 + np.exp(-(sum(chain[0]["weights"].get(x, 0) for x in own) - 1.0)))
        second = 1 / (1 + np.exp(-(sum(weights.get(x, 0) for x in own) + 2 * first - 2.0)))
        assert abs(got[i]["p_low_quality"] - first) < 1e-9 and abs(got[i]["p_toxic"] - second) < 1e-9
        assert got[i]["c0"] == 3 and got[i]["text"] == text
    assert score_chain(df.limit(0), chain).count() == 0


def test_fits_hold_numbers_of_the_features_that_can_count(spark):
    """Four bytes per feature and row, none for features that too few rows have."""
    from collections import Counter

    from trialmesh.llm import toxicity
    from trialmesh.llm.text import words_of

    rows, marks = toxic_rows(80)
    docs, labels, scratch = spark.createDataFrame(rows, messy_docs(spark).schema), chain_labels(spark.createDataFrame(marks, LABELS)), Scratch(spark)
    sample = toxicity.training_sample(docs, labels, toxicity.CATEGORIES, "doc_id", "text", 1000, scratch)
    vocabulary = toxicity.frequent_features(sample)
    own = {r[0]: {x for w in words_of(r[1]) for x in toxicity.word_features(w)} for r in rows}
    sampled = [r.doc_id for r in sample.collect()]
    counts = Counter(x for i in sampled for x in own[i])
    assert vocabulary.tolist() == sorted(x for x, n in counts.items() if n >= toxicity.MIN_ROWS)
    for r in toxicity.numbered_features(sample, vocabulary, scratch).collect():
        places = np.frombuffer(bytes(r.features), "<i4")
        assert vocabulary[places].tolist() == sorted(x for x in own[r.doc_id] if counts[x] >= toxicity.MIN_ROWS)


def test_no_copy_of_the_table_is_written_to_drop_toxic_rows(spark):
    """Rows equal in id and text but not otherwise are kept or dropped together."""
    rows, marks = toxic_rows(120)
    rows += [(*rows[i][:2], "xx", *rows[i][3:]) for i in range(0, 40)]
    docs, labels, written = spark.createDataFrame(rows, messy_docs(spark).schema), spark.createDataFrame(marks, LABELS), Scratch(spark)
    kept = without_toxic(docs, labels, written)
    assert all("text" not in table.columns and "doc" not in table.columns for table, _ in written._paths.values())
    got = sorted(map(str, kept.collect()))
    plain = {(r.doc_id, r.text) for r in kept.collect()}
    assert got == sorted(str(r) for r in docs.collect() if (r.doc_id, r.text) in plain) and 0 < len(got) < len(rows)


def test_cached_words_share_the_models_numbers():
    from trialmesh.llm.toxicity import _Features, word_features

    only = {x: x for x in word_features(b"sharing")[2:]}
    known = _Features(only)
    assert all(x is only[x] for x in known[b"sharing"]) and set(known[b"sharing"]) == set(only)
    assert set(known[b"shared"]) == set(word_features(b"shared")) & set(only)
