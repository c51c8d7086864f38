"""Interpolated modified Kneser-Ney model of order two or three: counted in Spark, kept as sorted arrays, memory-mapped by workers.

Files in a folder that all executors share (below `spark.checkpoint.dir`, which must be a mounted path):

- `words-*`: sorted 64-bit hashes of the training tokens and their counts, split by the hashes' top bits. A word's
  number is its place over all shards, so numbers are dense.
- `pairs-*`: sorted keys (number of the history * wide + number of the word) with counts, split by the key's low bits:
  a frequent history spreads over all shards, and so does a frequent word, as `wide` (the types, made odd) shares no
  factor with their number. A pair's number is its place over all shards.
- `triples-*` (order three): sorted keys (number of the pair * wide + number of the word) with counts, split alike.
  The further counts of a pair are the distinct words before it, and those after it that come once, twice and more often.
- `*-n` holds the counts of each of these tables, `pairs-*-rest` the four further counts of a pair side by side.
- `stats-*`: arrays indexed by word number: count as history, distinct successors seen once, twice, and more often,
  distinct predecessors. Each file holds the 2^20 numbers of one part.

Every table is built by a grouped Arrow function over blobs: each map task sends its distinct keys, sorted, packed
and pre-counted, so what is shuffled is distinct keys per task rather than tokens, and grows with the corpus. Files
are written under another name and renamed: a repeated task writes the same file again, and a lost executor costs
its running tasks only. Scoring reads texts once more and shuffles nothing; a worker maps the shards it touches and keeps
up to `MAPS` files mapped, without holding them open.

Keys are counted and looked up in their shards' order: they are turned so that the bits that tell the shard stand on top,
and plain sorts of 64-bit numbers do the rest (`_counted`, `_grouped`). Words are hashed eight bytes at a time, all words of
a few megabytes at once.

Of the keys of pairs and triples every 16th is stored whole, the others by their distance from it without the bits that
tell their shard: four and a half bytes a key instead of eight. Counts are bytes, with a list of those that do not fit. A pair that comes once has one word before and one after it,
so only pairs that come more often have these counted. Pairs that begin a text have no word before them and keep
their plain counts; the first word of a text is scored with them.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import accumulate
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import utf8
from barloom.plans.settle import settle, shared_folder

#: Hash that stands for the end of a text.
END = np.uint64(0)
PART_BITS = 20
#: Keys from one that is stored whole to the next.
RUN = 16
#: Tokens that a worker counts, and scores, at once; scoring holds about twenty arrays per token.
TOKENS_AT_ONCE, TOKENS_SCORED = 1 << 21, 1 << 19
#: Bytes of text that are cut into words at once.
BYTES_AT_ONCE = 2 << 20
SHARD_BYTES = 16 << 20
#: From 3.13 on a map need not hold its file open.
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: Files that a worker keeps mapped: a shard has up to thirteen, and each chunk of texts touches all of them. Linux maps
#: 65,530 in a process unless told otherwise.
MAPS = 56_000 if UNTRACKED else 1 << 12
STATS = {"count": np.uint64, "once": np.uint32, "twice": np.uint32, "more": np.uint32, "before": np.uint32}


_PRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray) -> bytes:
    """Compressed; sorted 64-bit keys as gaps, byte planes apart."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return _PRESS.compress(planes)


def _unpack(data: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(_EXPAND.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=np.uint64) if dtype == np.uint64 else values


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _summed(keys: np.ndarray, *columns: np.ndarray):
    """Equal ones of sorted keys added up: the keys, then the columns' sums."""
    starts = _runs(keys)
    return keys[starts], *(np.add.reduceat(c, starts) if len(keys) else c for c in columns)


def _counted(keys: np.ndarray):
    """(sorted distinct keys, how often each comes); sorts `keys` in place."""
    keys.sort()
    starts = _runs(keys)
    return keys[starts], np.diff(starts, append=len(keys))


def _grouped(keys: np.ndarray, bits: int = 64):
    """(groups, group of each key) for keys below 2^bits: equal keys share a group, nearly always a single one.

    Groups come sorted by the keys' upper bits. What is sorted are the upper bits with each key's place below them.
    """
    below = len(keys).bit_length()
    packed = (keys >> np.uint64(max(0, bits + below - 64))) << np.uint64(below)
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << below) - 1)
    order = packed.view(np.int64)
    groups = keys[order]
    starts = _runs(groups)
    groups = groups[starts]
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
    return groups, back


def _save(folder: str, name: str, values: np.ndarray) -> None:
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(temporary, values)
    os.replace(temporary, f"{folder}/{name}.npy")


def _save_counts(folder: str, name: str, values: np.ndarray) -> None:
    """One byte each; 255 stands for the counts listed apart, behind their places."""
    large = np.flatnonzero(values >= 255)
    _save(folder, f"{name}-large", np.concatenate([large, values[large].astype(np.int64)]))
    _save(folder, name, np.minimum(values, 255).astype(np.uint8))


def _save_keys(folder: str, name: str, keys: np.ndarray, bits: int = 0) -> None:
    """Sorted keys that share their lowest `bits`: every 16th whole, and how far each lies behind the one before it of these."""
    first = keys[::RUN]
    behind = (keys - np.repeat(first, RUN)[: len(keys)]) >> np.uint64(bits)
    kind = np.uint32 if not len(keys) or int(behind.max()) < 1 << 32 else np.uint64
    _save(folder, f"{name}-behind", behind.astype(kind))
    _save(folder, name, first)


class Keys:
    """The keys of `_save_keys`, mapped."""

    def __init__(self, path: str, bits: int = 0) -> None:
        self.first, self.behind, self.bits = _mapped(f"{path}.npy"), _mapped(f"{path}-behind.npy"), np.uint64(bits)

    def __len__(self) -> int:
        return len(self.behind)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The keys at these places."""
        return self.first[places // RUN] + (self.behind[places].astype(np.uint64) << self.bits)

    def all(self) -> np.ndarray:
        return np.repeat(self.first, RUN)[: len(self)] + (self.behind.astype(np.uint64) << self.bits)

    def find(self, keys: np.ndarray):
        """(place, whether it is the key's), for keys with the same lowest bits: the run, then binary steps inside it."""
        run = np.searchsorted(self.first, keys, "right") - 1
        inside = run >= 0
        run[~inside] = 0
        want = (keys - self.first[run]) >> self.bits
        place, last = run * RUN, len(self) - 1
        for step in (8, 4, 2, 1):
            ahead = np.minimum(place + step, last)
            np.copyto(place, ahead, where=self.behind[ahead] <= want)
        return place, inside & (self.behind[place] == want)


def _counts(folder: str, name: str, at: np.ndarray, width: int = 1) -> np.ndarray:
    """Counts at these places, `width` columns if they lie side by side."""
    values = _mapped(f"{folder}/{name}.npy")
    out = (values[at] if width == 1 else values.reshape(-1, width)[at].ravel()).astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        places, counts = _mapped(f"{folder}/{name}-large.npy").reshape(2, -1)
        out[large] = counts[np.searchsorted(places, at[large // width] * width + large % width)]
    return out if width == 1 else out.reshape(-1, width)


@dataclass(frozen=True)
class Shards:
    """Where sorted arrays lie; `starts` is the number of keys before each shard, `held` the shards that have keys.

    A shard in `held` whose file is gone is an error, not a shard without the key.
    """

    folder: str
    kind: str
    bits: int
    starts: tuple[int, ...]
    held: frozenset[int] = frozenset()

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Shard of each key: by its own top bits for words, which are hashes, by the low bits for others."""
        if self.kind == "words":
            return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        return (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def short(self, keys: np.ndarray) -> np.ndarray:
        """Keys of one shard without the bits that tell it."""
        return keys if self.kind == "words" else keys >> np.uint64(self.bits)

    def whole(self, shard: int, short: np.ndarray) -> np.ndarray:
        return short if self.kind == "words" else short << np.uint64(self.bits) | np.uint64(shard)

    def turned(self, keys: np.ndarray):
        """(keys with the bits that tell the shard on top, the bits that they take): sorted, they are in shard order."""
        if self.kind == "words":
            return keys, 64
        most = max(self.bits + 1, int(keys.max()).bit_length() if len(keys) else 0)
        turned = keys >> np.uint64(self.bits)
        turned |= keys << np.uint64(64 - self.bits) >> np.uint64(64 - most)
        return turned, most

    def turned_back(self, turned: np.ndarray, most: int) -> np.ndarray:
        if self.kind == "words":
            return turned
        return (turned & np.uint64((1 << (most - self.bits)) - 1)) << np.uint64(self.bits) | turned >> np.uint64(most - self.bits)

    def grouped(self, keys: np.ndarray):
        """(groups, group of each key) as by `_grouped`, in shard order."""
        turned, most = self.turned(keys)
        groups, back = _grouped(turned, most)
        return self.turned_back(groups, most), back

    def find(self, keys: np.ndarray, *columns: tuple[str, int]):
        """(place, the columns named with their widths, else the count) of each key, -1 and 0 if it is absent.

        Keys in shard order are not dealt out first; sorted ones touch each page of a shard once.
        """
        columns = columns or (("n", 1),)
        place, found = np.full(len(keys), -1, np.int64), [np.zeros((len(keys), w)[: 1 + (w > 1)], np.int64) for _, w in columns]
        shard = self.of(keys)
        order = None if (shard[1:] >= shard[:-1]).all() else np.argsort(shard.astype(np.uint16) if self.bits <= 16 else shard, kind="stable")
        cuts = np.searchsorted(shard if order is None else shard[order], np.arange(len(self.starts) + 1)).tolist()
        for s, start in enumerate(self.starts):
            if cuts[s] == cuts[s + 1] or s not in self.held:
                continue
            rows = np.arange(cuts[s], cuts[s + 1]) if order is None else order[cuts[s] : cuts[s + 1]]
            own = keys[rows]
            if self.kind == "words":
                known = _mapped(f"{self.folder}/{self.kind}-{s}.npy")
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[at] == own
            else:
                at, hit = Keys(f"{self.folder}/{self.kind}-{s}", self.bits).find(own)
            if not hit.all():
                rows, at = rows[hit], at[hit]
            place[rows] = at + start
            for out, (name, width) in zip(found, columns, strict=True):
                out[rows] = _counts(self.folder, f"{self.kind}-{s}-{name}", at, width)
        return place, *found

    def parts(self, places: np.ndarray):
        """(shard, rows, offsets): the rows of sorted `places` that lie in a shard, and where."""
        if not len(places):
            return
        shard = np.searchsorted(np.array(self.starts), places, "right") - 1
        cuts = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(places)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(shard[a]), slice(a, b), places[a:b] - self.starts[shard[a]]

    def keys(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for s, rows, at in self.parts(places):
            out[rows] = Keys(f"{self.folder}/{self.kind}-{s}", self.bits).at(at)
        return out

    def counts(self, places: np.ndarray, column: str) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for s, rows, at in self.parts(places):
            out[rows] = _counts(self.folder, f"{self.kind}-{s}-{column}", at)
        return out


@lru_cache(maxsize=MAPS)
def _mapped(path: str) -> np.ndarray:
    """A saved array of one dimension, mapped."""
    with open(path, "rb") as file:
        np.lib.format.read_magic(file)
        (size,), _, dtype = np.lib.format.read_array_header_1_0(file)
        if not size:
            return np.empty(0, dtype)
        try:
            held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
        except OSError:  # fewer maps, or open files, are allowed here
            _mapped.cache_clear()
            held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
        return np.frombuffer(held, dtype, size, file.tell())


@dataclass(frozen=True)
class Model:
    words: Shards
    pairs: Shards
    tokens: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Words with one, two, and more distinct predecessors, and the number of distinct pairs.
    word_classes: tuple[int, int, int, int]
    #: Of order three.
    triples: Shards | None = None
    triple_discounts: tuple[float, float, float] | None = None
    #: Parts of the number range that have statistics.
    parts: frozenset[int] = frozenset()

    def stats(self, numbers: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of STATS for sorted word numbers (the number `types` is the start of a text)."""
        out = {k: np.zeros(len(numbers), np.float64) for k in STATS}
        parts = numbers >> PART_BITS
        cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(numbers)]]) if len(numbers) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            inside = numbers[a:b] & ((1 << PART_BITS) - 1)
            for k, values in out.items() if int(parts[a]) in self.parts else ():
                values[a:b] = _mapped(f"{self.words.folder}/stats-{parts[a]}-{k}.npy")[inside]
        return out


def mounted(folder: str) -> str:
    """The path under which tasks open files of `folder`."""
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{folder}: workers map the model's files, so this folder must be a path mounted on every executor")
    return os.path.abspath(unquote(parsed.path))


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a word's last eight bytes, those that are its own.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number changed to another one, each of whose bits depends on all (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each word by its size and bytes; behind the last word `data` has eight bytes more.

    Words of one size of up to eight bytes never share a hash.
    """
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = _mixed(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = _mixed(out ^ (eight[starts] & _OWN[np.minimum(sizes, 8)]))
    left = np.flatnonzero(sizes > 8)
    for at in range(8, int(sizes.max(initial=0)), 8):
        left = left[sizes[left] > at] if at > 8 else left
        out[left] = _mixed(out[left] ^ (eight[starts[left] + at] & _OWN[np.minimum(sizes[left] - at, 8)]))
    return out


def _hashed(data: np.ndarray, cuts: np.ndarray):
    """(hashes, number of tokens of each text): words, ASCII lower-cased, and END; text i is data[cuts[i]:cuts[i + 1]]."""
    if len(cuts) == 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data, cuts = data[cuts[0] : cuts[-1]], cuts - cuts[0]
    word = ~_SPACE[data]
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[edges], last[edges - 1] = word[edges], word[edges - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    held = np.diff(np.searchsorted(starts, cuts))
    hashes = np.full(len(starts) + len(held), END)
    hashes[np.arange(len(starts)) + np.repeat(np.arange(len(held)), held)] = _word_hashes(np.append(_LOWER[data], np.zeros(8, np.uint8)), starts, sizes)
    return hashes, held + 1


def _pieces(texts: pa.Array):
    """Yields (hashes, number of tokens of each text) for about BYTES_AT_ONCE bytes of whole texts."""
    texts = texts.cast(pa.large_binary())
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BYTES_AT_ONCE, "right")) - 1)
        yield _hashed(data, cuts[at : to + 1])
        at = to


def _chunks(arrays, most: int = TOKENS_AT_ONCE):
    """Yields (hashes, number of tokens of each text) for about `most` tokens of whole texts."""
    hashes, sizes, total = [], [], 0
    for piece in (piece for texts in arrays for piece in _pieces(texts)):
        hashes.append(piece[0])
        sizes.append(piece[1])
        total += len(piece[0])
        del piece
        if total >= most:
            hashes, sizes, total = [np.concatenate(hashes)], [np.concatenate(sizes)], 0
            yield hashes.pop(), sizes.pop()
    if hashes:
        hashes, sizes = [np.concatenate(hashes)], [np.concatenate(sizes)]
        yield hashes.pop(), sizes.pop()


def _texts(batches):
    return (batch.column(0) for batch in batches)


def _blobs(shards: Shards, keys: np.ndarray):
    """One record batch: the short keys of each shard, sorted, with their counts."""
    turned, most = shards.turned(keys)
    turned, counts = _counted(turned)
    every = range(1 << shards.bits)
    cuts = [*np.searchsorted(turned, np.array([s << (most - shards.bits) for s in every], np.uint64)).tolist(), len(turned)]
    short = turned if shards.kind == "words" else turned & np.uint64((1 << (most - shards.bits)) - 1)
    counts = counts.astype(np.uint32)
    rows = [(s, slice(cuts[s], cuts[s + 1])) for s in every if cuts[s + 1] > cuts[s]]
    columns = [
        pa.array([s for s, _ in rows], pa.int32()),
        pa.array([_pack(short[r]) for _, r in rows], pa.binary()),
        pa.array([_pack(counts[r]) for _, r in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts"])


def _merged(table: pa.Table):
    """Sorted keys and the sums of their counts: equal keys are counted, and what counts have above one is added."""
    keys = np.concatenate([_unpack(x.as_py(), np.uint64) for x in table.column("keys")])
    counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in table.column("counts")])
    more = np.flatnonzero(counts > 1)
    often, above = keys[more], counts[more].astype(np.int64) - 1
    keys, total = _counted(keys)
    np.add.at(total, np.searchsorted(keys, often), above)
    return keys, total


def _of_counts(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from the numbers of keys seen once to four times, kept between 0 and the count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))


def fit(df: DataFrame, text: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES, order: int = 2) -> Model:
    """A model of the texts in `df`. NULL is an empty text: one END token. Repeated rows count as often as they come.

    With order three, a word's chance depends on the two words before it. Of an empty table the model knows no word:
    every token then has the share of an unseen one.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 and 3 are built")
    spark: SparkSession = df.sparkSession
    place = mounted(folder or shared_folder(spark)) + f"/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(place)
    _forget_at_exit(spark, place)
    texts = df.select(utf8(f"`{text}`").alias("bytes"))
    size = texts.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    bits = max(2, (max(1, size // shard_bytes) - 1).bit_length())
    words, found = _fit_words(texts, place, bits)
    types, tokens = sum(r["types"] for r in found), sum(r["tokens"] for r in found)
    if types >= (1 << 32) - 1:
        raise ValueError("word numbers take 32 bits; split the corpus")
    pairs, sent = _fit_pairs(texts, place, bits, words, types, order)
    triples = None
    if order == 3:
        if (pairs.starts[-1] + (1 << 32)) * (types + 1) >= 1 << 64:
            raise ValueError("triple keys take 64 bits; split the corpus")
        triples = Shards(place, "triples", bits, (0,) * (1 << bits))
        sent = _fit_triples(texts, words, pairs, triples, types)
        written = (s for s in range(1 << bits) if os.path.exists(f"{place}/triples-{s}.npy"))
        triples = replace(triples, held=frozenset(written))
    totals = np.zeros((2, 4), np.int64)
    for row in sent.where("kind >= 2").select("kind", F.col("columns")[0].alias("n")).toLocalIterator():
        totals[row["kind"] - 2] += np.frombuffer(bytes(row["n"]), np.uint64).astype(np.int64)
    word_counts, classes, parts = _fit_stats(sent.where("kind < 2"), place)
    of_triples = _discounts(totals[1].tolist()) if triples else None
    return Model(words, pairs, tokens, types, _discounts(totals[0].tolist()), _discounts(word_counts), classes, triples, of_triples, parts)


def _forget_at_exit(spark: SparkSession, place: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"file://{place}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def _fit_words(texts: DataFrame, place: str, bits: int):
    blank = Shards(place, "words", bits, ())

    def counted(batches):
        for hashes, _ in _chunks(_texts(batches)):
            yield _blobs(blank, hashes)

    def kept(key, table):
        shard = key[0].as_py()
        keys, counts = _merged(table)
        _save(place, f"words-{shard}", keys)
        _save_counts(place, f"words-{shard}-n", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())]})

    blobs = texts.mapInArrow(counted, "shard int, keys binary, counts binary")
    found = settle(blobs.groupBy("shard").applyInArrow(kept, "shard int, types long, tokens long")).collect()  # a row per shard
    sizes = {r["shard"]: r["types"] for r in found}
    starts = list(accumulate((sizes.get(s, 0) for s in range(1 << bits)), initial=0))[:-1]
    return Shards(place, "words", bits, tuple(starts), frozenset(sizes)), found


def _numbered(words: Shards, types: int, hashes: np.ndarray, sizes: np.ndarray):
    """Numbers of known words, and keys of the pairs that end in them."""
    known, where = words.grouped(hashes)
    numbers = words.find(known)[0].astype(np.uint64)[where]
    history = np.concatenate([[np.uint64(types)], numbers[:-1]])
    history[np.cumsum(sizes)[:-1]] = types
    return numbers, history * _wide(types) + numbers


def _wide(types: int) -> np.uint64:
    """Odd, so that the low bits of keys with the same word differ."""
    return np.uint64(types | 1)


SENT = "part int, kind int, numbers binary, columns array<binary>"


def _sent(rows) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
    names = ("part", "kind", "numbers", "columns")
    columns = [*zip(*rows, strict=True)] or [()] * 4
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _total(kind: int, counts: np.ndarray):
    return -1, kind, b"", [np.array(_of_counts(counts), np.uint64).tobytes()]


def _pair_rows(keys: np.ndarray, counts: np.ndarray, types: int):
    """Rows of SENT that sum up sorted pairs by history (kind 0) and by word (1), and the counts of counts (2)."""
    classes = [(counts == 1), (counts == 2), (counts >= 3)]
    history = keys // _wide(types)
    before = _counted(keys - history * _wide(types))
    history = _summed(history, counts, *(c.astype(np.uint64) for c in classes))
    return [*_by_part(0, *history), *_by_part(1, *before), _total(2, counts)]


def _fit_pairs(texts: DataFrame, place: str, bits: int, words: Shards, types: int, order: int):
    """Pairs, and for order two the rows of SENT."""
    blank = Shards(place, "pairs", bits, ())

    def counted(batches):
        for hashes, sizes in _chunks(_texts(batches)):
            yield _blobs(blank, _numbered(words, types, hashes, sizes)[1])

    def kept(key, table):
        shard = key[0].as_py()
        keys, counts = _merged(table)
        keys = blank.whole(shard, keys)
        _save_keys(place, f"pairs-{shard}", keys, bits)
        _save_counts(place, f"pairs-{shard}-n", counts)
        size = np.array([len(keys)], np.uint64).tobytes()
        return _sent([(shard, 4, b"", [size]), *(_pair_rows(keys, counts, types) if order == 2 else ())])

    blobs = texts.mapInArrow(counted, "shard int, keys binary, counts binary")
    sent = settle(blobs.groupBy("shard").applyInArrow(kept, SENT))
    sizes = {r["part"]: int.from_bytes(bytes(r["n"]), "little") for r in sent.where("kind = 4").select("part", F.col("columns")[0].alias("n")).toLocalIterator()}
    starts = list(accumulate((sizes.get(s, 0) for s in range(1 << bits)), initial=0))[:-1]
    return Shards(place, "pairs", bits, tuple(starts), frozenset(sizes)), sent.where("kind < 4")


def _fit_triples(texts: DataFrame, words: Shards, pairs: Shards, triples: Shards, types: int) -> DataFrame:
    """Writes triples, and the words before and after each pair; rows of SENT, kind 3 with the triples' counts of counts."""
    place, wide = pairs.folder, _wide(types)

    def counted(batches):
        for hashes, sizes in _chunks(_texts(batches)):
            numbers, keys = _numbered(words, types, hashes, sizes)
            del hashes
            distinct, back = pairs.grouped(keys)
            del keys
            history = pairs.find(distinct)[0].astype(np.uint64)[back]
            del distinct, back
            inner = np.ones(len(numbers), bool)
            inner[np.cumsum(sizes) - sizes] = False
            history, numbers = history[:-1][inner[1:]], numbers[inner]
            history *= wide
            history += numbers
            del numbers
            yield _blobs(triples, history)

    def kept(key, table):
        shard = key[0].as_py()
        keys, counts = _merged(table)
        keys = triples.whole(shard, keys)
        _save_keys(place, f"triples-{shard}", keys, triples.bits)
        _save_counts(place, f"triples-{shard}-n", counts)
        history = keys // wide
        word = keys - history * wide
        classes = [c.astype(np.uint32) for c in (counts == 1, counts == 2, counts >= 3)]
        starts = _runs(history)
        sums = [np.add.reduceat(c, starts) if len(keys) else c for c in classes]
        history, come = history[starts].astype(np.int64), np.diff(starts, append=len(keys))
        last = np.repeat(pairs.keys(history) % wide, come)
        often = pairs.counts(history, "n") > 1
        after = history[often], *(c[often] for c in sums)
        ends, most = pairs.turned(last * wide + word)
        ends, before = _counted(ends)
        found, n = pairs.find(pairs.turned_back(ends, most))  # their places rise, as they are in shard order
        often = np.flatnonzero(n > 1)
        rows = [_total(3, counts)]
        for kind, places, columns in ((0, after[0], after[1:]), (1, found[often], [before[often]])):
            rows += [(s, kind, _pack(at.astype(np.uint64)), [_pack(c[r].astype(np.uint32)) for c in columns]) for s, r, at in pairs.parts(places)]
        return _sent(rows)

    def told(key, table):
        shard = key[0].as_py()
        if shard < 0:  # the triples' counts of counts
            return table
        if shard not in pairs.held:
            return _sent([])
        keys = Keys(f"{place}/pairs-{shard}", pairs.bits).all()
        counts = _counts(place, f"pairs-{shard}-n", np.arange(len(keys)))
        once, history = counts == 1, keys // wide
        before = np.where(history == types, counts, once).astype(np.uint64)
        after = [(once & (keys - history * wide != end)).astype(np.uint64), *np.zeros((2, len(keys)), np.uint64)]
        for kind, numbers, columns in zip(*(table.column(c).to_pylist() for c in ("kind", "numbers", "columns")), strict=True):
            if kind == 4:
                continue
            at = _unpack(numbers, np.uint64).astype(np.int64)
            for sums, data in zip(after if kind == 0 else [before], columns, strict=True):
                sums[at] += _unpack(data, np.uint32)
        _save_counts(place, f"pairs-{shard}-rest", np.stack([before, *after], axis=1).ravel())
        return _sent(_pair_rows(keys, before, types))

    end = np.uint64(max(int(words.find(np.array([END]))[0][0]), 0))
    blobs = texts.mapInArrow(counted, "shard int, keys binary, counts binary")
    # written before the next step: the triples' shuffle, the largest, is gone by then
    found = settle(blobs.groupBy("shard").applyInArrow(kept, SENT))
    every = texts.sparkSession.range(1 << pairs.bits).selectExpr("cast(id AS int) AS part", "4 AS kind", "X'' AS numbers", "array(X'') AS columns")
    return settle(found.union(every).groupBy("part").applyInArrow(told, SENT))


def _by_part(kind: int, numbers: np.ndarray, *columns: np.ndarray):
    """Rows of sorted numbers and their columns, one for each part of the number range."""
    parts = (numbers >> np.uint64(PART_BITS)).astype(np.int64)
    cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(numbers)]]) if len(numbers) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        packed = [_pack((c[a:b]).astype(np.uint32) if k or kind else _gaps(c[a:b])) for k, c in enumerate(columns)]
        yield int(parts[a]), kind, _pack(numbers[a:b]), packed


def _gaps(counts: np.ndarray) -> np.ndarray:
    """Running totals: their gaps, which `_pack` stores, are the counts."""
    return np.cumsum(counts, dtype=np.uint64)


def _fit_stats(sent: DataFrame, place: str):
    def kept(key, table):
        part = key[0].as_py()
        dense = {k: np.zeros(1 << PART_BITS, np.uint64) for k in STATS}
        for row in table.to_pylist():
            inside = (_unpack(row["numbers"], np.uint64) & np.uint64((1 << PART_BITS) - 1)).astype(np.int64)
            if row["kind"] == 0:
                dense["count"][inside] += np.diff(_unpack(row["columns"][0], np.uint64), prepend=np.uint64(0))
                for name, data in zip(("once", "twice", "more"), row["columns"][1:], strict=True):
                    dense[name][inside] += _unpack(data, np.uint32)
            else:
                dense["before"][inside] += _unpack(row["columns"][0], np.uint32)
        for name, dtype in STATS.items():
            _save(place, f"stats-{part}-{name}", dense[name].astype(dtype))
        before = dense["before"]
        classes = [int((before == 1).sum()), int((before == 2).sum()), int((before >= 3).sum())]
        return pa.table({"part": pa.array([part], pa.int32()), "n": [_of_counts(before)], "classes": [classes], "total": [int(before.sum())]})

    kinds = "part int, n array<long>, classes array<long>, total long"
    found = settle(sent.groupBy("part").applyInArrow(kept, kinds)).collect()  # a row per 2^20 words
    counts = [sum(r["n"][k] for r in found) for k in range(4)]
    classes = tuple(sum(r["classes"][k] for r in found) for k in range(3))
    return counts, (*classes, sum(r["total"] for r in found)), frozenset(r["part"] for r in found)


def _discounted(counts: np.ndarray, discounts) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def _score_chunk(model: Model, hashes: np.ndarray, sizes: np.ndarray):
    """(known tokens, base score, score) of each text of a chunk."""
    known, where = model.words.grouped(hashes)
    number, count = model.words.find(known)
    begins = np.cumsum(sizes) - sizes
    add = lambda x: np.add.reduceat(x, begins)  # noqa: E731  every text has a token
    n_known = add((number >= 0).astype(np.int64)[where])
    base = add(np.log10((count + 1.0) / (model.tokens + model.types + 1.0))[where])
    # unigram level: from distinct predecessors, interpolated with a uniform share that unseen words have too
    own = {k: np.zeros(len(known)) for k in STATS}
    rows = np.flatnonzero(number >= 0)
    rows = rows[np.argsort(number[rows], kind="stable")]
    for k, values in model.stats(number[rows]).items():
        own[k][rows] = values
    total = float(model.word_classes[3])
    spare = sum(d * n for d, n in zip(model.word_discounts, model.word_classes[:3], strict=True)) / total if total else 1.0
    lower = _discounted(own["before"], model.word_discounts) / (total or 1.0) + spare / (model.types + 1.0)
    # bigram level: of each word as history (the last is the start of a text), its count and the share left for the unigram
    start = model.stats(np.array([model.types]))
    table = {k: np.append(own[k], start[k]) for k in STATS}
    some = table["count"] > 0
    divide = np.where(some, table["count"], 1.0)
    left = np.where(some, sum(d * table[k] for d, k in zip(model.pair_discounts, ("once", "twice", "more"), strict=True)) / divide, 1.0)
    history = np.empty(len(hashes), np.int64)
    history[1:] = where[:-1]
    history[begins] = len(known)
    word, probability = number[where], lower[where]
    del where  # arrays of a chunk's tokens go as soon as they can: a few of them are the worker's memory
    probability *= left[history]
    full = np.append(number, model.types)[history]
    keys = full.astype(np.uint64)
    full = (full >= 0) & (word >= 0)
    every = bool(full.all())
    if not every:
        keys, history = keys[full], history[full]
    keys *= _wide(model.types)
    keys += (word if every else word[full]).astype(np.uint64)
    distinct, back = model.pairs.grouped(keys)
    del keys
    of_triples = (("n", 1), ("rest", 4)) if model.triples else ()
    place, plain, *rest = model.pairs.find(distinct, *of_triples)
    together = _discounted(rest[0][:, 0] if rest else plain, model.pair_discounts)[back]
    together /= divide[history]
    probability[full] += together
    del together, history
    if model.triples and len(distinct):
        # trigram level: the pair that ends one word before is the history
        counted = np.maximum(plain, 1)
        left = sum(d * rest[0][:, k] for k, d in enumerate(model.triple_discounts, 1)) / counted
        del rest, plain, distinct
        row = np.full(len(hashes), -1)
        row[full] = np.where(place >= 0, np.arange(len(place)), -1)[back]
        row[begins[1:] - 1] = row[-1] = -1  # the last token of a text is nobody's history
        del back, full
        at = np.flatnonzero(row[:-1] >= 0) + 1
        pair, word = row[at - 1], word[at]
        del row
        probability[at] *= left[pair]
        if (word < 0).any():  # nothing is added for unknown words
            at, pair, word = (x[word >= 0] for x in (at, pair, word))
        keys, back = model.triples.grouped(place[pair].astype(np.uint64) * _wide(model.types) + word.astype(np.uint64))
        del word
        together = _discounted(model.triples.find(keys)[1], model.triple_discounts)[back]
        del keys, back
        together /= counted[pair]
        probability[at] += together
    np.log10(probability, out=probability)
    return n_known, base, add(probability)


def scored(df: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, n_tokens, n_known, base_score, score) of every row; scores are log10 probabilities of the whole text.

    NULL and empty texts consist of the END token. Unknown words have the share of an unseen word. Perplexity is
    10 ** (-score / n_tokens). Repeated rows are scored alike, equal counts or scores need no rule. A very long text is
    one chunk by itself. Key columns named like an output are refused, other columns of `df` may have any name.
    """
    outputs = ("n_tokens", "n_known", "base_score", "score")
    if {*keys} & {*outputs}:
        raise ValueError(f"key columns {sorted({*keys} & {*outputs})} are named like outputs")
    if len({*keys}) < len(keys):
        raise ValueError("a key column is named twice")

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            parts, done = [], 0
            for hashes, sizes in _chunks([batch.column(len(keys))], TOKENS_SCORED):
                parts.append((sizes, *_score_chunk(model, hashes, sizes)))
                done += len(sizes)
            assert done == rows
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0)] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.array(c.astype(np.int64) if k == pa.int64() else c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *arrays], names=schema.names)

    rows = df.select(*[F.col(f"`{k}`") for k in keys], utf8(f"`{text}`").alias("bytes of the text"))
    kinds = (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in kinds)])
    return rows.mapInArrow(run, schema)
