"""Fill-in-the-middle examples by piece tables.

A piece table is a row of descriptors (buffer, start, stop) over buffers that never change: the document's UTF-8 bytes
and one buffer of sentinels. Cutting splits descriptors, arranging permutes them, restoring permutes them back, and a
hash reads them in order; no step copies text. The training text is only put together by a caller who asks for it.

The example of a document depends on its key and text alone, so reruns and any layout give the same one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import packed, slices, utf8

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Where the parts prefix (0), middle (1) and suffix (2) stand, each behind its sentinel.
ARRANGEMENTS = {PSM: (0, 2, 1), SPM: (2, 0, 1)}


@dataclass(frozen=True)
class Recipe:
    """How documents become examples: sentinels before prefix, middle and suffix, and shares in percent."""

    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"
    seed: int = 7
    plain_percent: int = 0
    spm_percent: int = 50

    def __post_init__(self):
        for mark in (self.prefix, self.middle, self.suffix):
            # a mark that ends as it begins could also be found one part too early
            if not mark or any(mark.startswith(mark[-k:]) for k in range(1, len(mark))):
                raise ValueError(f"sentinel {mark!r}: must not be empty or end as it begins")

    @property
    def sentinels(self) -> tuple[bytes, bytes, bytes]:
        return tuple(s.encode() for s in (self.prefix, self.middle, self.suffix))


@dataclass(frozen=True)
class Pieces:
    """Descriptors over immutable buffers."""

    buffers: tuple[memoryview, ...]
    table: tuple[tuple[int, int, int], ...] = field(default=())

    @classmethod
    def of(cls, data: bytes) -> Pieces:
        return cls((memoryview(data),), ((0, 0, len(data)),))

    def cut(self, *places: int) -> Pieces:
        """Descriptors split at ascending offsets of the whole: each place is then the start of one."""
        out, at, places = [], 0, list(places)
        for buffer, start, stop in self.table:
            while places and places[0] <= at + stop - start:
                middle = start + places.pop(0) - at
                out.append((buffer, start, middle))
                at, start = at + middle - start, middle
            out.append((buffer, start, stop))
            at += stop - start
        return Pieces(self.buffers, tuple(out))

    def permuted(self, order: tuple[int, ...]) -> Pieces:
        return Pieces(self.buffers, tuple(self.table[i] for i in order))

    def inverse(self, order: tuple[int, ...]) -> Pieces:
        """What `permuted(order)` was made from."""
        return self.permuted(tuple(int(i) for i in np.argsort(order)))

    def behind(self, heads: tuple[bytes, ...]) -> Pieces:
        """Each piece behind its head; the heads are one buffer more."""
        ends = np.cumsum([len(h) for h in heads]).tolist()
        number = len(self.buffers)
        marks = [(number, end - len(h), end) for h, end in zip(heads, ends, strict=True)]
        return Pieces((*self.buffers, memoryview(b"".join(heads))), tuple(d for pair in zip(marks, self.table, strict=True) for d in pair))

    def __iter__(self):
        for buffer, start, stop in self.table:
            yield self.buffers[buffer][start:stop]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self:
            digest.update(piece)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self)


def arranged(text: bytes, first: int, second: int, form: str, recipe: Recipe) -> Pieces:
    """The example of a text cut at two byte offsets."""
    whole = Pieces.of(text)
    if form == PLAIN:
        return whole
    order = ARRANGEMENTS[form]
    return whole.cut(first, second).permuted(order).behind(tuple(recipe.sentinels[i] for i in order))


def restored(example: bytes, form: str, recipe: Recipe) -> Pieces:
    """The text an example was made from, found from the example and its form alone.

    A text that holds a sentinel is never arranged, so each sentinel's first occurrence after the one before is it.
    """
    whole = Pieces.of(example)
    if form == PLAIN:
        return whole
    order, places, at = ARRANGEMENTS[form], [], 0
    for i in order:
        at = example.index(recipe.sentinels[i], at)
        places += [at, at + len(recipe.sentinels[i])]
        at = places[-1]
    parts = whole.cut(*places).table[2::2]  # what follows each sentinel
    return Pieces(whole.buffers, parts).inverse(order)


def draws(key, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the key in decimal; a NULL key counts as no digits."""
    head = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16]
    return [int.from_bytes(head[i : i + 4], "big") for i in (0, 4, 8, 12)]


class Lines:
    """Where the lines of many texts end: a line runs up to and with its newline, or to the end of the text."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.breaks = np.flatnonzero(data == 10)
        self.first = np.searchsorted(self.breaks, self.starts)
        past = np.searchsorted(self.breaks, self.starts + lengths)
        full = past - self.first
        open_end = np.array([bool(t) and not t.endswith(b"\n") for t in texts], bool)
        self.counts = full + open_end

    def offset(self, row: int, lines: int) -> int:
        """Bytes in the first `lines` lines of a text."""
        if lines == 0:
            return 0
        if lines == self.counts[row]:
            return int(self.lengths[row])
        return int(self.breaks[self.first[row] + lines - 1] - self.starts[row] + 1)


@dataclass(frozen=True)
class Example:
    lines: int
    form: str
    text: bytes
    first: int
    second: int
    pieces: Pieces


def examples(keys: list, column: pa.Array, recipe: Recipe):
    """Yields the example of each (key, text) of an Arrow column of UTF-8 bytes."""
    texts = column.to_pylist()
    lines = Lines(texts)
    held = np.zeros(len(texts), bool)
    for sentinel in recipe.sentinels:
        held |= pc.match_substring(column, sentinel).to_numpy(zero_copy_only=False)
    for row, (key, text) in enumerate(zip(keys, texts, strict=True)):
        n = int(lines.counts[row])
        one, two, plain, spm = draws(key, recipe.seed)
        if not text or held[row] or plain % 100 >= 100 - recipe.plain_percent:
            yield Example(n, PLAIN, text, 0, 0, arranged(text, 0, 0, PLAIN, recipe))
            continue
        form = SPM if spm % 100 < recipe.spm_percent else PSM
        first, second = (lines.offset(row, k) for k in sorted((one % (n + 1), two % (n + 1))))
        yield Example(n, form, text, first, second, arranged(text, first, second, form, recipe))


def _chars(text: bytes, start: int, stop: int) -> int:
    """Code points; cuts lie behind newlines, never inside one."""
    return len(text[start:stop].decode("utf-8", "replace"))


FINDINGS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
]


def _found(example: Example):
    if example.form == PLAIN:
        return example.lines, PLAIN, None, None
    return example.lines, example.form, _chars(example.text, 0, example.first), _chars(example.text, example.first, example.second)


def _run(df: DataFrame, key: str, text: str, recipe: Recipe, more: list[T.StructField], make) -> DataFrame:
    rows = packed(df, key=F.col(f"`{key}`").cast("string"), bytes=utf8(f"`{text}`"))
    fields = [*FINDINGS, *more]
    names = ["row", *(f.name for f in fields)]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *({T.StringType(): pa.string(), T.BinaryType(): pa.binary()}[f.dataType] for f in more)]

    def made(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            out = [(*_found(e), *make(e)) for e in examples(batch.column("key").to_pylist(), batch.column("bytes"), recipe)]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(made, T.StructType([rows.schema["row"], *fields]))


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text", recipe: Recipe = Recipe()) -> DataFrame:
    """(`row`, n, form, prefix_chars, middle_chars, example): `row` holds all columns of `df`, `example` the training text.

    A text is n lines; two line borders drawn from the key part it into prefix, middle and suffix, any of which may be
    empty. Empty texts, texts that hold a sentinel and the recipe's plain share stay as they are (form `plain`, no
    counts). NULL is an empty text, a NULL key is drawn for like a key without digits. Repeated rows give repeated
    examples; whole texts are used however long they are; an empty table gives an empty one.
    """
    return _run(df, key, text, recipe, [T.StructField("example", T.BinaryType())], lambda e: (e.pieces.bytes(),)).withColumn("example", F.col("example").cast("string"))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", recipe: Recipe = Recipe()) -> DataFrame:
    """`transformed` with output_sha256 and restored_sha256 in place of the example: its hash, and the hash of the text
    that is rebuilt from the example's bytes and form."""

    def hashed(e: Example):
        return e.pieces.sha256(), restored(e.pieces.bytes(), e.form, recipe).sha256()

    return _run(df, key, text, recipe, [T.StructField(n, T.StringType()) for n in ("output_sha256", "restored_sha256")], hashed)


def originals(df: DataFrame, example: str = "example", form: str = "form", recipe: Recipe = Recipe()) -> DataFrame:
    """(`row`, `original`): the text of each example. A NULL example or form has a NULL original."""
    rows = packed(df, bytes=F.col(f"`{example}`").cast("binary"), form=F.col(f"`{form}`"))

    def rebuilt(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            both = zip(batch.column("bytes").to_pylist(), batch.column("form").to_pylist(), strict=True)
            out = [None if data is None or kind is None else restored(data, kind, recipe).bytes() for data, kind in both]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], names=["row", "original"])

    made = rows.mapInArrow(rebuilt, T.StructType([rows.schema["row"], T.StructField("original", T.BinaryType())]))
    return made.withColumn("original", F.col("original").cast("string"))
