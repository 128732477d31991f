"""Quality by weak supervision: rules vote good or bad or abstain, and their accuracies are estimated without labels.

A text is measured once. Each rule compares one measure with two bounds: on one side it votes good, on the other bad,
between them (or where it has nothing to judge) it abstains. The votes of all documents are counted by pattern, at most
3 ** len(rules) of them, and expectation-maximisation on these counts estimates how often good and bad documents get
each vote of each rule. A document is kept when the posterior probability of being good reaches a threshold, so
one weak rule alone can't reject it and a rule that contradicts the others loses its say.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch, session_setting

# Fixed values of the base measures.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

KEEP_FROM = 0.5
# Texts are measured together until they have this many words.
SLICE_WORDS = 400_000

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended_lines", "n_letter_words", "n_letters", "n_capitals", "n_digits", "n_same_as_before", "n_odd_words",
)

_ASCII = bytes(range(128))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_NOT_LETTER = bytes(c for c in _ASCII if not chr(c).isalpha())
_NOT_LETTER_OR_SPACE = bytes(c for c in _NOT_LETTER if c not in SPACE)
# A word is odd if something is left of it without letters, digits and the punctuation of prose.
_USUAL = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c) in ".,;:!?'\"()-")
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b";", b")", "…".encode(), "”".encode(), "。".encode())


@dataclass(frozen=True)
class Rule:
    """Votes by a measure (an SQL expression, null: abstains): good up to ``good``, bad beyond ``bad``; reversed if ``good > bad``."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.measure)
        good, bad = (value >= self.good, value < self.bad) if self.good > self.bad else (value <= self.good, value > self.bad)
        return F.when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    Rule("length", "n_words", 50, MIN_WORDS),
    Rule("long_words", "word_chars / nullif(n_words, 0)", 10, 14),
    Rule("short_words", "word_chars / nullif(n_words, 0)", 3, 2.5),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", 0.02, 0.1),
    Rule("odd_words", "n_odd_words / nullif(n_words, 0)", 0.05, 0.3),
    Rule("repeated_lines", "CASE WHEN n_lines >= 4 THEN n_dup_lines / n_lines END", 0.1, 0.3),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", 0.1, 0.3),
    Rule("words_in_a_row", "CASE WHEN n_words >= 2 THEN n_same_as_before / (n_words - 1) END", 0.02, 0.1),
    Rule("letters", "n_letter_words / nullif(n_words, 0)", 0.9, 0.8),
    Rule("capitals", "CASE WHEN n_letters >= 20 THEN n_capitals / n_letters END", 0.2, 0.5),
    Rule("line_ends", "CASE WHEN n_lines >= 4 THEN n_ended_lines / n_lines END", 0.5, 0.1),
    Rule("digits", "n_digits / nullif(word_chars, 0)", 0.05, 0.2),
)


def _lines(data: bytes) -> tuple[int, int, int]:
    """Lines with a word: all of them, those equal to an earlier one, those that end like a sentence."""
    n = ended = 0
    seen = set()
    for line in data.split(b"\n"):
        body = line.rstrip(SPACE)
        if body:
            n += 1
            ended += body.endswith(_ENDS)
            seen.add(line)
    return n, n - len(seen), ended


def repeated_words(names: np.ndarray, ends: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """For each word whether it lies in a window of ``size`` (a power of two) words that its text holds at least twice.

    ``names`` numbers the words so that equal words of one text, and no others, have one number; ``ends`` is the end
    of the text of each word. Windows of one, two, four words are named in turn by their halves' names, so equality
    is exact; a window goes as soon as a part of it occurs once only.
    """
    n = len(names)
    starts = np.arange(n)
    name = np.full(n, -1)
    if n:
        several = np.bincount(names)[names] > 1
        starts, name[several] = starts[several], names[several]
    width = 1
    while width < size and len(starts):
        second = starts + width
        ok = second + width <= ends[starts]
        starts, second = starts[ok], second[ok]
        ok = name[second] >= 0
        starts, second = starts[ok], second[ok]
        _, named, count = np.unique(name[starts] * n + name[second], return_inverse=True, return_counts=True)
        several = count[named] > 1
        name = np.full(n, -1)
        starts = starts[several]
        name[starts] = named[several]
        width *= 2
    depth = np.zeros(n + 1, int)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + size, -1)
    return depth[:n].cumsum() > 0


def measured(texts: Sequence[bytes | None]) -> np.ndarray:
    """One row of ``MEASURES`` per text in UTF-8; null counts as empty."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    waiting = base = 0

    def flush() -> None:
        if held:
            lengths = np.array([len(x) for x in held])
            names, stops = np.concatenate(held), lengths.cumsum()
            found = np.concatenate([[0], repeated_words(names, np.repeat(stops, lengths)).cumsum()])
            out[rows, 4] = found[stops] - found[stops - lengths]
        held.clear()
        rows.clear()

    for i, data in enumerate(texts):
        words = data.split() if data else []
        if not words:
            continue
        table: dict[bytes, int] = {}
        names = np.array([table.setdefault(w, len(table)) for w in words])
        same = int((names[1:] == names[:-1]).sum())
        if len(words) > REPEAT_WINDOW and len(table) < len(words):
            held.append(names + base)
            rows.append(i)
            base += len(table)
            waiting += len(words)
        spaces = len(data) - len(data.translate(None, SPACE))
        later_bytes = len(data) - len(data.translate(None, bytes(range(0x80, 0xC0))))
        n_lines, n_dup, n_ended = _lines(data)
        capitals = len(data) - len(data.translate(None, _UPPER))
        letters = len(data.translate(None, _NOT_LETTER)) - later_bytes
        with_letter = len(data.translate(None, _NOT_LETTER_OR_SPACE).split())
        out[i] = (
            len(words), len(data) - later_bytes - spaces, len(data) - len(data.translate(None, SYMBOLS)), n_dup, 0,
            n_lines, n_ended, with_letter, letters, capitals, len(data) - len(data.translate(None, _DIGITS)), same,
            len(data.translate(None, _USUAL).split()),
        )
        if waiting >= SLICE_WORDS:
            flush()
            waiting = base = 0
    flush()
    return out


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``MEASURES``, one row per row of ``docs``, from the whole text."""
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in MEASURES]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = measured([x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(values[:, k]) for k in range(len(MEASURES))]], names=[id_col, *MEASURES])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


@dataclass
class VoteModel:
    """Estimated share of good documents and, by rule, class (bad, good) and vote (bad, none, good), probabilities of votes."""

    good_share: float
    votes: np.ndarray

    def log_odds(self) -> tuple[float, np.ndarray]:
        """The prior's log odds of good and what each rule's vote adds to it."""
        added = np.log(self.votes[:, 1]) - np.log(self.votes[:, 0])
        return float(np.log(self.good_share) - np.log1p(-self.good_share)), added


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation on counted vote patterns (rows of -1, 0, 1).

    It starts from the majority of the votes, one bad vote weighing as much as two good ones, since most rules have nothing
    to say against most bad documents. Abstaining is taken as uninformative: a rule that abstains adds no evidence, and its
    accuracies come from the documents on which it votes. A weak prior (one document in a hundred of those voted on) draws
    a rule's rates of bad votes towards 1 % among good and 30 % among bad documents, so both classes keep their meaning and no
    probability is zero; being relative, it has the same strength at every size of the table.
    """
    n_rules = patterns.shape[1]
    total = float(counts.sum())
    prior = np.array([0.3, 0.01])
    bad, good = (patterns == -1).astype(float), (patterns == 1).astype(float)
    said = bad + good
    voted = counts @ said if len(counts) else np.zeros(n_rules)
    posterior = np.where(bad.sum(axis=1) == 0, 0.99, np.where(2 * bad.sum(axis=1) > good.sum(axis=1), 0.01, 0.2)) if len(counts) else np.zeros(0)
    share, rate, before = 0.9, np.tile(prior, (n_rules, 1)), -np.inf
    for _ in range(rounds if total else 0):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        strength = 0.01 * voted + 1.0
        rate = np.stack([(weight[c] @ bad + strength * prior[c]) / (weight[c] @ said + strength) for c in (0, 1)], axis=1)
        share = float(np.clip((weight[1].sum() + 0.009 * total + 0.9) / (total * 1.01 + 1.0), 1e-6, 1 - 1e-6))
        joint = np.stack([np.log(p) + bad @ np.log(rate[:, c]) + good @ np.log1p(-rate[:, c]) for c, p in ((0, 1 - share), (1, share))])
        top = joint.max(axis=0)
        mass = np.log(np.exp(joint - top).sum(axis=0)) + top
        posterior = np.exp(joint[1] - mass)
        likelihood = float(counts @ mass) / total
        if abs(likelihood - before) < tolerance:
            break
        before = likelihood
    return VoteModel(share, np.stack([rate, np.ones_like(rate), 1 - rate], axis=2))


def vote_patterns(voted: DataFrame, rules: Sequence[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vote patterns, at most 3 ** len(rules), and how many documents have each.

    A pattern travels as one number, so even all patterns of 12 rules are 8 MB.
    """
    code = F.lit(0).cast("bigint")
    for rule in rules:
        code = code * 3 + F.col(f"vote_{rule.name}") + 1
    found = voted.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    codes, places = found["code"].to_numpy(), 3 ** np.arange(len(rules) - 1, -1, -1)
    return codes[:, None] // places % 3 - 1, found["n"].to_numpy().astype(float)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
    keep_from: float = KEEP_FROM, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, ``MEASURES``, a ``vote_`` per rule, ``p_good``, ``base_failed``, ``kept``.

    Words are runs of anything but ASCII white space; a null text counts as empty. ``base_failed``: fewer than
    ``MIN_WORDS`` words, or over ``MAX_REPEATED_PERCENT`` of the words in repeated windows; such documents are never kept, the
    others from a posterior probability of ``keep_from``. Texts are measured whole, however long. Repeated rows, repeated and
    null ids are documents of their own; equal texts get equal verdicts. Other columns of ``docs``, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    if len(rules) > 12:
        raise ValueError("at most 12 rules, so that the number of vote patterns stays small")
    scratch = scratch or Scratch(docs.sparkSession)
    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="500"):
        measures = scratch.table(text_measures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), "_id", "_body"), "measures")
    voted = measures.select("*", *[r.vote().cast("tinyint").alias(f"vote_{r.name}") for r in rules])
    prior, added = fit_votes(*vote_patterns(voted, rules)).log_odds()
    odds = F.lit(prior)
    for rule, (bad, none, good) in zip(rules, added):
        vote = F.col(f"vote_{rule.name}")
        odds = odds + F.when(vote < 0, float(bad)).when(vote > 0, float(good)).otherwise(float(none))
    scored = voted.withColumn("p_good", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= keep_from))
    return judged.select(F.col("_id").alias(id_col), *[c for c in judged.columns if c != "_id"])
