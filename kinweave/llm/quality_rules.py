"""Quality rules: a learned decision list over text statistics.

Sequential covering learns rules for low quality one at a time: a rule grows by the threshold condition with the best
information gain (FOIL) on two thirds of the examples and is pruned from its end on the other third; it is kept while
it is precise there, and the examples that it covers are taken away. The ordered rules become one Spark conditional
expression, so judging is plain column arithmetic over the statistics.

The rules are fitted on at most ``most_rows`` labelled rows, those with the smallest hash of their id; statistics cover
the whole texts of all rows.

Contract: words are runs of non-space ASCII bytes. A text fails the base rules with fewer than 20 words or with more
than 30 % of its words in repeated 8-word windows; null and empty texts have no words and fail. Without usable labels
no rule is learned and the base rules decide alone. An id with both labels counts as low; null labels and labels of
unknown documents are ignored. Rows of one id are measured each by its own text, and of those only one is learned from.
Of conditions with equal gain the first feature, then "at most", then the smallest threshold wins. Texts of any length
are counted whole. Repeated rows and extra columns stay as they are; columns named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, map_arrow, materialize, quoted
from kinweave.llm._text import NON_SPACE, Words, code_points, slices, window_starts, windows

# The characters counted as symbols.
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARKS = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: What rules test: ratios of the counts, as Spark expressions.
FEATURES = {
    "words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_a_char": "n_upper / greatest(word_chars, 1)",
    "digits_a_char": "n_digits / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def _repeated(words: Words, hashes: np.ndarray, width: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in the text."""
    starts = window_starts(words.first, words.count, width)
    cover = np.zeros(len(hashes) + 1, np.int64)
    if len(starts):
        grams = windows(hashes, width)[starts]
        edges = np.concatenate([[0], np.cumsum(np.maximum(words.count - width + 1, 0))])
        for i in np.flatnonzero(words.count > width).tolist():
            own = grams[edges[i] : edges[i + 1]]
            order = np.argsort(own)
            same = own[order][1:] == own[order][:-1]
            if same.any():
                twice = np.zeros(len(own), dtype=bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                at = starts[edges[i] : edges[i + 1]][twice]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return sums[words.first[1:]] - sums[words.first[:-1]]


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines)."""
    lines = text.split(b"\n")
    wordy = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
    return len(wordy) - len(set(wordy)), len(lines)


def _statistics(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, data, offsets in slices(texts):
        words = Words(data, offsets, NON_SPACE)
        hashes = words.hashes()

        def count(table: np.ndarray, data: np.ndarray = data, offsets: np.ndarray = offsets) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[data])])
            return np.diff(sums[offsets])

        lines = np.array([_duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]).reshape(-1, 2)
        white = count(~NON_SPACE)
        distinct = [len(np.unique(hashes[a:b])) for a, b in zip(words.first, words.first[1:], strict=False)]
        yield np.stack([words.count, code_points(data, offsets) - white, count(_SYMBOLS), lines[:, 0], _repeated(words, hashes, width), lines[:, 1], count(_UPPER), count(_DIGIT), count(_MARKS), np.array(distinct)], 1)


def statistics(docs: DataFrame, width: int = 8) -> DataFrame:
    """The columns of ``docs`` but text, with the counts of COUNTS."""
    other = [c for c in docs.columns if c != "text" and c not in COUNTS]
    docs = columns(docs, *other, "text")
    schema = docs.drop("text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_statistics(batch.column(batch.num_columns - 1), width))
            rows = np.concatenate(found).astype(np.int64) if found else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(rows[:, k].copy()) for k in range(len(COUNTS))]], names=schema.names)

    return map_arrow(docs, measure, schema)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of conditions that leave p low and n good examples of p0 and n0."""
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))


def grow(x: np.ndarray, low: np.ndarray, most: int = 4) -> list[tuple[int, bool, float]]:
    """Conditions (feature, above, threshold) of one rule, best gain first."""
    rule: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and (~low[inside]).any():
        rows, y = x[inside], low[inside]
        p0, n0 = float(y.sum()), float((~y).sum())
        best = (1e-6, None)
        for f in range(x.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            values, label = rows[order, f], y[order]
            cut = np.flatnonzero(values[1:] > values[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(label)[cut], np.cumsum(~label)[cut]
            middle = (values[cut] + values[cut + 1]) / 2
            for above, gain in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, above, float(middle[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covered([best[1]], x)
    return rule


def covered(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), dtype=bool)
    for f, above, threshold in rule:
        inside &= x[:, f] > threshold if above else x[:, f] <= threshold
    return inside


def prune(rule: list, x: np.ndarray, low: np.ndarray) -> list:
    """The beginning of the rule that is worth most on examples it was not grown on: (p - n) / (p + n)."""

    def worth(own: list) -> float:
        inside = covered(own, x)
        p, n = (low & inside).sum(), (~low & inside).sum()
        return (p - n) / max(p + n, 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth) if rule else rule


def decision_list(x: np.ndarray, low: np.ndarray, precision: float = 0.8, most: int = 24) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules for low quality; rows must come in an order that has nothing to do with their labels."""
    rules: list[list[tuple[int, bool, float]]] = []
    while len(rules) < most and low.sum() >= 3:
        held = np.arange(len(x)) % 3 == 2
        if not low[held].any() or not low[~held].any() or low.all():
            break
        rule = prune(grow(x[~held], low[~held]), x[held], low[held])
        inside = covered(rule, x)
        outside = covered(rule, x[held])
        p, n = low[inside].sum(), (~low[inside]).sum()
        good = low[held][outside].sum() / max(outside.sum(), 1)
        if not rule or p < 3 or p / (p + n) < precision or good < precision - 0.1:
            break
        rules.append(rule)
        x, low = x[~inside], low[~inside]
    return rules


def train(stats: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> list[list[tuple[int, bool, float]]]:
    """Rules from the labelled rows of ``stats`` (doc_id and COUNTS)."""
    known = columns(labels, "doc_id", "quality").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    near = F.xxhash64(F.col("doc_id"), F.lit(29))
    measured = columns(stats, "doc_id", *COUNTS)
    rows = measured.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("own")).select("doc_id", "quality", "own.*")
    rows = rows.select("doc_id", "quality", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]).orderBy(near, "doc_id").limit(most_rows).toPandas()
    return decision_list(rows[list(FEATURES)].to_numpy(float), (rows["quality"] == 0).to_numpy()) if len(rows) else []


def verdict(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """Whether a row of statistics is kept: the first rule that holds rejects it."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for f, above, threshold in rule:
            feature = F.expr(list(FEATURES.values())[f]).cast("double")
            holds = holds & (feature > threshold if above else feature <= threshold)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[list[tuple[int, bool, float]]]) -> list[str]:
    """The rules in words."""
    names = list(FEATURES)
    return ["low if " + " and ".join(f"{names[f]} {'>' if above else '<='} {t:.4g}" for f, above, t in rule) for rule in rules]


def judge(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """The columns of ``docs`` but text, with the counts, base_failed and kept."""
    stats = materialize(statistics(docs.select(*[F.col(quoted(c)) for c in docs.columns if c not in ("base_failed", "kept")])))
    rules = train(stats, labels, most_rows)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
