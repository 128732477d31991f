"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by sparse logistic models; each later model also sees the probabilities of
the earlier categories. In training those are out-of-fold predictions, so a later model meets earlier probabilities
of the quality it will meet when documents are scored. Models are fitted inside Spark tasks, one per fold and one on
everything, on a bounded sample of the labelled rows; every document is scored with its whole text.

A document's features are its distinct words without outer punctuation, their prefixes (which carry over to unseen
inflections), and the shapes of words. Features are identified by 64-bit hashes. Those of the sampled rows that can get a
weight at all are counted first and numbered in the order of their hashes, so a fit holds four bytes per feature of a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, fits_broadcast, session_setting
from .text import words_of
from .tokens import slices

# Labelled rows that a fit may use, per value of the last category.
SAMPLE_PER_CLASS = 4_000
FOLDS = 3
# A feature must occur in this many sampled rows, and a model keeps at most this many weights.
MIN_ROWS = 4
MAX_WEIGHTS = 50_000
# Passes over the rows; small samples get more, so that the weights settle.
EPOCHS = (5, 60)
ROWS_SEEN = 40_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
_CACHE_WORDS = 300_000


def word_features(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace")
    bare = text.strip("\"'()[]{}<>.,;:!?|*-_#/\\")
    lower = bare.lower()
    found = [f"shape:{text[text.rfind(bare) + len(bare):][:3]}", f"upper:{len(bare) > 1 and bare.isupper()}"]
    if lower:
        found.append(f"word:{lower}")
        found += [f"prefix:{lower[:n]}" for n in PREFIXES if len(lower) >= n]
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in found)


class _Features(dict):
    """Features of a word, computed once per worker; ``only`` keeps those a model knows, as the very numbers it holds, so words share them."""

    def __init__(self, only: dict | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = word_features(word)
        if self.only is not None:
            found = tuple(self.only[x] for x in found if x in self.only)
        if len(self) < _CACHE_WORDS:
            self[word] = found
        return found


class _PackedFeatures(dict):
    """Features of a word as the bytes of its hashes, which take a fraction of the memory of Python numbers."""

    def __missing__(self, word: bytes) -> bytes:
        found = np.array(word_features(word), "<u8").tobytes()
        if len(self) < _CACHE_WORDS:
            self[word] = found
        return found


def packed_features(text: str | None, known: _PackedFeatures) -> np.ndarray:
    """``features_of`` as a sorted array."""
    return np.unique(np.frombuffer(b"".join(map(known.__getitem__, set(words_of(text)))), "<u8"))


def features_of(text: str | None, known: _Features) -> set[int]:
    return set().union(*map(known.__getitem__, set(words_of(text))))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class FeatureRows:
    """Rows of feature numbers as one flat array with bounds."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        self.flat, self.bounds = flat, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i] : self.bounds[i + 1]]

    @classmethod
    def of(cls, rows: Sequence[np.ndarray]) -> FeatureRows:
        flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
        return cls(flat, np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64))

    def renumbered(self, kept: np.ndarray) -> FeatureRows:
        """Only the features marked in ``kept``, numbered anew in their order."""
        inside = kept[self.flat]
        before = np.concatenate([[0], np.cumsum(inside)])
        return FeatureRows((np.cumsum(kept, dtype=np.int32) - 1)[self.flat[inside]], before[self.bounds])


def fit_sparse_logistic(rows: FeatureRows, known: int, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float = 8.0, l2: float = 0.1, rate: float = 1.0, batch: int = 32) -> tuple[np.ndarray, np.ndarray, float]:
    """Follow-the-regularized-leader with L1: weights of the ``known`` features, weights of earlier probabilities, intercept.

    Where only one class is present there are no weights and the intercept says so.
    """
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(known), np.zeros(earlier.shape[1]), 20.0 if len(y) and y[0] == 1 else -20.0
    counts = np.bincount(rows.flat, minlength=known)
    used = (counts >= MIN_ROWS) & (counts < len(rows))
    columns, names = rows.renumbered(used), np.flatnonzero(used)
    width = len(names) + earlier.shape[1] + 1
    z, n, w = np.zeros(width), np.zeros(width), np.zeros(width)
    dense = np.arange(len(names), width)
    order = np.random.default_rng(7)
    for _ in range(min(EPOCHS[1], max(EPOCHS[0], ROWS_SEEN // len(y)))):
        shuffled = order.permutation(len(y))
        for start in range(0, len(y), batch):
            take = shuffled[start : start + batch]
            own_columns = [columns[i] for i in take]
            flat = np.concatenate(own_columns)
            row = np.repeat(np.arange(len(take)), [len(x) for x in own_columns])
            extra = np.column_stack([earlier[take], np.ones(len(take))])
            p = _logistic(np.bincount(row, weights=w[flat], minlength=len(take)) + extra @ w[dense])
            error = (p - y[take]) * weight[take]
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.concatenate([np.bincount(inverse, weights=error[row], minlength=len(touched)), extra.T @ error])
            own = np.concatenate([touched, dense])
            step = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / rate
            z[own] += g - step * w[own]
            n[own] += g * g
            # The dense part is not shrunk to zero.
            cut = np.where(own >= len(names), 0.0, l1)
            w[own] = np.where(np.abs(z[own]) <= cut, 0.0, -(z[own] - np.sign(z[own]) * cut) / ((1.0 + np.sqrt(n[own])) / rate + l2))
    sparse = w[: len(names)]
    keep = np.flatnonzero(sparse)
    if len(keep) > MAX_WEIGHTS:
        keep = keep[np.argsort(-np.abs(sparse[keep]), kind="stable")[:MAX_WEIGHTS]]
    weights = np.zeros(known)
    weights[names[keep]] = sparse[keep]
    return weights, w[dense[:-1]], float(w[-1])


def _score(rows: Sequence[np.ndarray], earlier: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    weights, dense, intercept = model
    sums = np.array([sum(weights[own].tolist()) for own in rows], float)
    return _logistic(sums + earlier @ dense + intercept)


def training_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str, per_class: int, scratch: Scratch) -> DataFrame:
    """Labelled rows with features (sorted hashes), class weight and fold. At most about ``per_class`` rows per value of the last category, chosen by the hash of their id."""
    last = categories[-1]
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories]).dropna()
    sizes = {r[last]: r["n"] for r in marks.groupBy(last).agg(F.count(F.lit(1)).alias("n")).collect()} if not marks.isEmpty() else {}
    share = F.lit(1.0)
    for value, n in sizes.items():
        share = F.when(F.col(last) == value, min(1.0, per_class / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = scratch.table(marks.withColumn("_share", share).filter(draw < F.col("_share")), "chosen")
    # Bounded by ``per_class``, so the texts need not move; checked all the same.
    chosen = F.broadcast(chosen) if fits_broadcast(chosen) else chosen
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FOLDS)).cast("int")
    taken = docs.select(id_col, F.col(text_col).alias("_text")).join(chosen, id_col).select(id_col, fold.alias("fold"), (1.0 / F.col("_share")).alias("weight"), *categories, "_text").dropDuplicates([id_col])
    names = [id_col, "fold", "weight", *categories]
    schema = taken.select(*names).withColumn("features", F.lit(b"")).schema

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _PackedFeatures()
        for batch in batches:
            for part in slices(batch, len(names)):
                found = [packed_features(t, known).tobytes() for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.binary())], names=[*names, "features"])

    return scratch.table(taken.mapInArrow(extract, schema), "sample")


def frequent_features(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the features that at least ``MIN_ROWS`` rows of the bounded sample have; no fit can use others."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8"), return_counts=True)
            yield pa.RecordBatch.from_pydict({"feature": found.view("i8"), "n": times.astype(np.int64)})

    counts = sample.select("features").mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    return np.sort(counts.filter(F.col("n") >= MIN_ROWS).select("feature").toArrow()["feature"].to_numpy().view("u8"))


def numbered_features(sample: DataFrame, vocabulary: np.ndarray, scratch: Scratch) -> DataFrame:
    """The sample with the places of its features in ``vocabulary`` as 32-bit numbers; the other features go."""
    held = sample.sparkSession.sparkContext.broadcast(vocabulary)
    at = sample.columns.index("features")

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        for batch in batches:
            found = []
            for hashes in batch.column(at):
                own = np.frombuffer(hashes.as_buffer(), "<u8")
                places = np.searchsorted(names, own)
                inside = places < len(names)
                inside[inside] = names[places[inside]] == own[inside]
                found.append(places[inside].astype("<i4").tobytes())
            yield batch.set_column(at, "features", pa.array(found, pa.binary()))

    return scratch.table(sample.mapInArrow(number, sample.schema), "numbered_sample")


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> list[dict]:
    """Fit the chain; one dict per category: ``category, weights, earlier, intercept`` and the out-of-fold figures ``recall, false_alarms``.

    Rows without a label in some category are not used; of several labels for an id the largest counts. Without any
    labelled row every probability is practically 0. The chain is all that is left: the sample's tables are removed at the end.
    """
    scratch = Scratch(docs.sparkSession)
    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="1000"):
        sample = training_sample(docs, labels, categories, id_col, text_col, per_class, scratch)
        vocabulary = frequent_features(sample)
        sample = numbered_features(sample, vocabulary, scratch)
    n_features = len(vocabulary)
    chain: list[dict] = []
    held = sample.select(id_col, "fold", "weight", "features", *categories)
    for k, category in enumerate(categories):
        before = [f"p_{c}" for c in categories[:k]]
        runs = held.select(id_col, "fold", "weight", "features", F.col(category).alias("y"), *before, F.explode(F.array(*[F.lit(r) for r in range(FOLDS + 1)])).alias("run"))
        id_type = sample.schema[id_col].dataType.simpleString()

        def fit(table: pa.Table) -> pa.Table:
            run = table["run"][0].as_py()
            order = pc.sort_indices(table[id_col]).to_numpy()
            values = {c: table[c].to_numpy().astype(float)[order] for c in ("fold", "weight", "y", *before)}
            codes = [np.frombuffer(x.as_buffer(), "<i4") for chunk in table["features"].chunks for x in chunk]
            earlier = np.column_stack([np.empty((len(order), 0)), *[values[c] for c in before]])
            picked, out = np.flatnonzero(values["fold"] != run), np.flatnonzero(values["fold"] == run)
            model = fit_sparse_logistic(FeatureRows.of([codes[i] for i in order[picked]]), n_features, earlier[picked], values["y"][picked], values["weight"][picked])
            ids = table[id_col].take(pa.array(order[out])).combine_chunks()
            p, feature, marks = _score([codes[i] for i in order[out]], earlier[out], model), np.full(len(out), -1), np.full(len(out), run)
            if run == FOLDS:
                weights, dense, intercept = model
                used = np.flatnonzero(weights)
                ids = pa.concat_arrays([ids, pa.nulls(len(dense) + 1 + len(used), ids.type)])
                p = np.concatenate([p, dense, [intercept], weights[used]])
                feature = np.concatenate([feature, np.arange(len(dense) + 1), used])
                marks = np.concatenate([marks, np.full(len(dense) + 1, -1), np.full(len(used), run)])
            return pa.table({id_col: ids, "p": p, "feature": pa.array(feature, pa.int64(), mask=feature < 0), "run": pa.array(marks, pa.int32())})

        fitted = scratch.table(runs.groupBy("run").applyInArrow(fit, f"{id_col} {id_type}, p double, feature bigint, run int"), "fits")
        # The model's own weights, at most MAX_WEIGHTS rows.
        model = fitted.filter(F.col("feature").isNotNull()).collect()
        dense = [r["p"] for r in sorted((r for r in model if r["run"] == -1), key=lambda r: r["feature"])] or [0.0] * k + [-20.0]
        weights = {int(vocabulary[r["feature"]]): r["p"] for r in model if r["run"] != -1}
        outside = fitted.filter(F.col("feature").isNull()).select(id_col, F.col("p").alias(f"p_{category}"))
        held = scratch.table(held.join(outside, id_col), "held")
        hit, wrong = (F.avg(F.when(F.col(category) == v, (F.col(f"p_{category}") >= THRESHOLD).cast("double"))) for v in (1, 0))
        figures = held.agg(hit.alias("recall"), wrong.alias("false_alarms")).first()
        chain.append({"category": category, "weights": weights, "earlier": dense[:-1], "intercept": dense[-1], "recall": figures["recall"], "false_alarms": figures["false_alarms"]})
    scratch.close()
    return chain


def score_chain(docs: DataFrame, chain: list[dict], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``p_<category>`` per category, which replace columns of these names.

    Null and empty texts have no features and get the intercepts' probabilities. Texts are scored whole, one at a time, so
    the memory a task needs doesn't grow with their number; repeated rows are scored each. An empty table gives an empty result.
    """
    names = [f"p_{m['category']}" for m in chain]
    docs = docs.drop(*names)
    columns = docs.columns
    schema = docs.withColumns({n: F.lit(0.0) for n in names}).schema
    at = columns.index(text_col)
    only = {x: x for m in chain for x in m["weights"]}
    models = [(m["weights"], np.array(m["earlier"], float), m["intercept"]) for m in chain]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features(only)
        for batch in batches:
            for part in slices(batch, at, limit=1 << 20):
                sums = np.zeros((part.num_rows, len(models)))
                for i, text in enumerate(part.column(at)):
                    own = features_of(text.as_py(), known)
                    sums[i] = [sum(weights.get(x, 0.0) for x in own) for weights, _, _ in models]
                earlier = np.empty((part.num_rows, 0))
                for k, (_, dense, intercept) in enumerate(models):
                    earlier = np.column_stack([earlier, _logistic(sums[:, k] + earlier @ dense + intercept)])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(earlier[:, k]) for k in range(len(names))]], names=[*columns, *names])

    return docs.mapInArrow(score, schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The chain's categories from the table of labels."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


CATEGORIES = ("low_quality", "toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and any others) that the chain doesn't find toxic, with their columns as they are.

    Only hashes of id and text and the text itself go to the classifier and the hashes of toxic rows come back, so columns of any
    name and kind are carried by Spark alone and no copy of the table is written. Rows with a null id or text are scored like
    all others; repeated rows are decided alike.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    chain = fit_chain(docs.select("doc_id", "text"), chain_labels(labels), CATEGORIES)
    key, tie = F.xxhash64(docs["doc_id"], docs["text"]), F.hash(docs["doc_id"], docs["text"])
    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="200"):
        scored = score_chain(docs.select(key.alias("_key"), tie.alias("_tie"), "text"), chain).filter(F.col("p_toxic") >= THRESHOLD)
        found = scratch.table(scored.select("_key", "_tie").distinct(), "toxic")
    side = F.broadcast(found) if fits_broadcast(found, max_rows=1_000_000) else found
    return docs.join(side, (key == found["_key"]) & (tie == found["_tie"]), "left_anti")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``p_low_quality, p_toxic, toxic`` from a chain fitted on the labelled ones among them; see ``score_chain``."""
    chain = fit_chain(docs, chain_labels(labels), CATEGORIES)
    return score_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
