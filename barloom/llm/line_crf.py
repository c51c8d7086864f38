"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate,
Viterbi decoding finds the best label sequence of a text, and the share of word characters in content lines decides.

The field has two labels, node weights over line features and a 2 x 2 table of transition weights. It is fitted
piecewise on a bounded sample of labelled documents: node weights by logistic regression on line labels, transitions
from the labels of neighbouring lines. Lines of good documents count as content; lines of bad documents start as
boilerplate and are labelled again by Viterbi between the `ROUNDS` fits, since a bad document has content lines too.

Texts are read whole, one at a time, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import packed, slices, utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
MIN_CONTENT = 0.5
SAMPLE_DOCS = 4000
ROUNDS = 3
#: Classes of bytes that features count.
OTHER, LETTER, CAPITAL, DIGIT, SYMBOL, PIPE, SHOUT, SPACE = range(8)
FEATURES = ("bias", "log_length", "capitals", "digits", "symbols", "pipes", "shouts", "word_length", "ends_sentence", "repeated")


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[ord("a") : ord("z") + 1] = LETTER
    table[0x80:] = LETTER
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[ord("0") : ord("9") + 1] = DIGIT
    table[list(SYMBOLS)] = SYMBOL
    table[ord("|")] = PIPE
    table[ord("!")] = SHOUT
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    return table


CLASS = _classes()


@dataclass(frozen=True)
class LineField:
    """Weights of boilerplate against content; a model of zeros calls every line content."""

    node: tuple[float, ...] = (0.0,) * len(FEATURES)
    #: step[a][b]: weight of label b after label a; 0 is content.
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def labels(self, features: np.ndarray) -> np.ndarray:
        """Best label sequence; ties go to content."""
        node = features @ np.array(self.node)
        if not len(node):
            return np.empty(0, np.int8)
        (cc, cb), (bc, bb) = self.step
        content, boiler = 0.0, float(node[0])
        back = []
        for score in node[1:].tolist():
            from_c, from_b = content + cc, boiler + bc
            to_c, to_b = content + cb, boiler + bb
            back.append((from_b > from_c, to_b > to_c))
            content, boiler = max(from_c, from_b), max(to_c, to_b) + score
        out = [int(boiler > content)]
        for came in reversed(back):
            out.append(int(came[out[-1]]))
        return np.array(out[::-1], np.int8)


@dataclass(frozen=True)
class Text:
    """What one pass over a text finds: base counts, and the features and word characters of its lines with words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_number: np.ndarray
    features: np.ndarray
    line_chars: np.ndarray


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    base = np.int64(len(number))
    if len(number) < 2_000_000:
        windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        windows = pair[:-1] * base + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def read_text(data: bytes) -> Text:
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    kinds = CLASS[raw]
    line_of = np.cumsum(raw == 10) - (raw == 10)
    lines = data.split(b"\n")
    table = np.bincount(line_of * 8 + kinds, minlength=len(lines) * 8).reshape(-1, 8)[: len(lines)].astype(float)
    inner = (raw & 0xC0) != 0x80
    chars = np.bincount(line_of[inner & (kinds != SPACE)], minlength=len(lines))[: len(lines)] if len(raw) else np.zeros(len(lines), int)
    used, ends, seen, repeated, n_words = [], [], set(), [], []
    for i, line in enumerate(lines):
        bare = line.strip()
        if bare:
            used.append(i)
            ends.append(bare[-1:] in b".?!:;\"'")
            repeated.append(line in seen)
            seen.add(line)
            n_words.append(len(bare.split()))
    rows = table[used]
    length = np.maximum(rows.sum(axis=1) - rows[:, SPACE], 1.0)
    counts = np.array(n_words, float)
    features = np.column_stack([
        np.ones(len(used)), np.log1p(length), rows[:, CAPITAL] / length, rows[:, DIGIT] / length,
        rows[:, SYMBOL] / np.maximum(counts, 1), rows[:, PIPE] / np.maximum(counts, 1), rows[:, SHOUT] / np.maximum(counts, 1),
        np.log1p(length / np.maximum(counts, 1)), np.array(ends, float), np.array(repeated, float),
    ]) if used else np.empty((0, len(FEATURES)))
    total = table.sum(axis=0)
    return Text(len(words), int(chars.sum()), int(total[SYMBOL] + total[PIPE]), int(sum(repeated)), _repeat_words(words), np.array(used, int), features, chars[used] if used else np.empty(0, int))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or n_repeat_words > MAX_REPEATED * n_words


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    weight = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (p - y) + ridge * weight
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        change = np.linalg.solve(curve, slope)
        weight -= change
        if np.abs(change).max() < 1e-8:
            break
    return weight


def fit_lines(texts: list[tuple[np.ndarray, int]], rounds: int = ROUNDS) -> LineField:
    """A field from (features of a text's lines, quality of the text: 1 good, 0 bad)."""
    texts = [(f, q) for f, q in texts if len(f)]
    if len({q for _, q in texts}) < 2:
        return LineField()
    x = np.vstack([f for f, _ in texts])
    labels = [np.full(len(f), 1 - q) for f, q in texts]
    field = LineField()
    for _ in range(rounds):
        node = _logistic(x, np.concatenate(labels).astype(float))
        pairs = np.ones((2, 2))
        for row in labels:
            np.add.at(pairs, (row[:-1], row[1:]), 1)
        # log of how much more often labels follow each other than their frequencies say
        lift = np.log(pairs / pairs.sum(axis=1, keepdims=True)) - np.log(pairs.sum(axis=0) / pairs.sum())
        field = LineField(tuple(node.tolist()), tuple(map(tuple, lift.tolist())))
        labels = [row if q else field.labels(f).astype(int) for row, (f, q) in zip(labels, texts, strict=True)]
    return field


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample_docs: int = SAMPLE_DOCS) -> LineField:
    """A field fitted on about `sample_docs` labelled documents, chosen by a hash of their key. Several labels of one
    document count as good if one is, and of several rows with its key one text is read. Without labels of both kinds
    the field calls every line content."""
    marks = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(quality).cast("int").alias("quality"))
    n = marks.count()
    chance = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < int(1e6 * min(1.0, sample_docs / max(n, 1)))
    rows = df.select(F.col(f"`{key}`").alias("key"), utf8(f"`{text}`").alias("bytes")).where(chance(F.col("key")))
    # a key that many rows share is one row before it is joined or read
    first = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("bytes").alias("hash"), "bytes")).alias("text"))
    chosen = first.join(marks.where(chance(F.col("key"))), "key").select("text.bytes", "quality")

    def seen(batches):
        for batch in batches:
            found = [read_text(t).features.astype("<f4").tobytes() for t in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("quality")], names=["features", "quality"])

    sample = chosen.mapInArrow(seen, "features binary, quality int").collect()  # bounded by sample_docs
    return fit_lines([(np.frombuffer(r["features"], "<f4").reshape(-1, len(FEATURES)).astype(float), int(r["quality"] > 0)) for r in sorted(sample)])


FINDINGS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("content_share", T.DoubleType()),
    ("boilerplate_lines", T.ArrayType(T.IntegerType())), ("kept", T.BooleanType()),
)


def judged(df: DataFrame, field: LineField, text: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """(`row`, FINDINGS) for every row of `df`, whose columns are in `row`.

    `boilerplate_lines` are 0-based numbers of \\n-split lines; lines without a word are not labelled. A text whose
    content share equals `min_content` is kept. NULL, empty and blank texts have no words and fail the base rules.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            for data in batch.column("bytes").to_pylist():
                t = read_text(data)
                labels = field.labels(t.features)
                share = float(t.line_chars[labels == 0].sum() / t.word_chars) if t.word_chars else 0.0
                failed = base_failed(t.n_words, t.n_repeat_words)
                kept = not failed and share >= min_content
                found.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, share, t.line_number[labels == 1].tolist(), kept))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.bool_())
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *(n for n, _ in FINDINGS)])

    rows = packed(df, bytes=utf8(f"`{text}`"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in FINDINGS)])
    return rows.mapInArrow(run, schema)
