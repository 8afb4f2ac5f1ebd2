"""Held-out passages inside a large corpus: size-partitioned MinHash containment search, verified exactly.

The held-out texts are the query set, all documents are searched. A short text lies in one stretch of a document, so every
window of a document is a domain of the search. Queries are partitioned by size; a partition's windows are as long as its
largest query, which turns containment in a document into similarity to a window. For each hash function the minima of all
windows come from one doubling pass over the tokens, so the sketch of every window costs a few vector operations.

Two kinds of queries are searched:
- runs of RUN words of each text, which must be equal to a window: one band of all ROWS minima, which never misses an equal run;
- whole texts, which may be edited: at least AGREE of HASHES minima must occur among the windows of the partition's size.
Candidates are verified on the words themselves: an equal run by its exact shingles, an edited text by the exact containment
of its word pairs and then by the least number of words changed, added or dropped.

Scripts without spaces are read character by character, WORD_CHARS characters counting as one word: a query written mostly
in them is searched in runs of RUN * WORD_CHARS characters, its sketch is one of character shingles.

Nothing is shuffled: the query set is bounded (blocks of QUERY_BLOCK items or QUERY_CHARS characters, one pass over the
documents each) and every document is read once, whole. A worker builds the index of a block once and keeps it for its tasks.

Defined cases: NULL or empty documents and queries match nothing; a text of fewer than RUN words can only match as a whole;
repeated documents are each reported; items with equal texts are all reported; very long documents are searched whole; empty
tables give an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Equal words in a row that make a leak, and the share of words of a whole text that may differ ("about one in six").
RUN, MAX_EDITS = 12, 0.19
#: Minima of the band that finds equal runs; hash functions for whole texts, and how many of them must agree.
ROWS, HASHES, AGREE = 4, 24, 4
#: Ratio of the largest to the smallest query of a size partition.
PARTITION_RATIO = 1.2
#: Items, and characters of items, searched in one pass over the documents.
QUERY_BLOCK, QUERY_CHARS = 20_000, 32_000_000
#: Characters of scripts without spaces that count as one word.
WORD_CHARS = 2
#: Documents sketched at once, and words a worker remembers the hash of.
BATCH_DOCS, WORD_CACHE = 256, 400_000

#: What is taken out without leaving a gap: tags, link targets, marks, combining and invisible characters.
_TAGS = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|\]\([^()\s]*\)", re.S)
_BREAKS = re.compile(r"<(?:br|hr)\b[^<>]*>|</?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote)\b[^<>]*>", re.I)
_CITATION = re.compile(r"\[\^?[0-9]{1,4}\]")
_HIDDEN = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff]")
#: Dashes and slashes part words; other signs are dropped where they stand.
_PARTING = re.compile("[\u2012-\u2015\u2212/|\u2026]|--+|\\.\\.\\.+")
_SIGNS = re.compile(r"[^\w\s]|_")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_BROKEN_WORD = re.compile(r"(?<=\w)[-\u2010\u2011]\s*\n\s*(?=[a-z\u00df-\u00ff])")


def words(text: str) -> list[str]:
    """The words of a text, whatever its case, accents, punctuation, marks, invisible characters and layout.

    Each character of a script without spaces is a word.
    """
    if "<" in text or "](" in text:
        text = _TAGS.sub("", _BREAKS.sub(" ", text))
    if "[" in text:
        text = _CITATION.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    if "\n" in text:
        text = _BROKEN_WORD.sub("", text)
    text = _SIGNS.sub("", _PARTING.sub(" ", text)).casefold()
    return (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()


def run_length(tokens: Sequence[str], run: int = RUN) -> int:
    """Words in a row of a query that make a leak: more where most of them are single characters of a script without spaces."""
    return run * WORD_CHARS if 2 * sum(_UNSPACED.match(w) is not None for w in tokens) > len(tokens) else run


_known: dict[str, int] = {}


def _word_hashes(tokens: Sequence[str]) -> list[int]:
    if len(_known) > WORD_CACHE:
        _known.clear()
    out = []
    for w in tokens:
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


_MIX = np.random.default_rng(20240607).integers(1, 2**63, size=(HASHES + ROWS, 2), dtype=np.uint64) | np.uint64(1)
_LAST = np.uint32(0xFFFFFFFF)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def _values(pairs: np.ndarray, function: int) -> np.ndarray:
    return ((pairs * _MIX[function, 0] + _MIX[function, 1]) >> np.uint64(32)).astype(np.uint32)


def _window_minima(values: np.ndarray, sizes: Sequence[int]) -> dict[int, np.ndarray]:
    """For each window size the minimum of the window that starts at each position."""
    out, power, current = {}, 1, values
    for size in sorted(sizes):
        while power * 2 <= size:
            current = np.minimum(current[:-power], current[power:])
            power *= 2
        # two windows of a power of two cover one of any size
        out[size] = np.minimum(current[: len(values) - size + 1], current[size - power : size - power + len(values) - size + 1])
    return out


def edits(item: Sequence[str], doc: Sequence[str]) -> int:
    """The least number of words changed, added or dropped that makes `item` a stretch of `doc`."""
    number: dict[str, int] = {}
    a = [number.setdefault(w, len(number)) for w in item]
    b = np.array([number.get(w, -1) for w in doc])
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for i, x in enumerate(a, 1):
        following = np.empty_like(row)
        following[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (b != x), out=following[1:])
        row = np.minimum.accumulate(following - steps) + steps
    return int(row.min())


class QueryIndex:
    """Sketches of a block of texts, and the words to verify them by."""

    def __init__(self, texts: Sequence[str], run: int = RUN, max_edits: float = MAX_EDITS):
        self.run, self.max_edits = run, max_edits
        self.words = [words(t) for t in texts]
        self.pairs = [set(zip(w, w[1:], strict=False)) for w in self.words]
        self.runs = [{tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for w in self.words]
        singles: dict[int, set[int]] = {}
        probes: dict[int, set[int]] = {}
        classes: dict[int, list[int]] = {}
        sketches = []
        for t, w in enumerate(self.words):
            hashes = np.array(_word_hashes(w), dtype=np.uint64)
            sketches.append(None)
            if len(w) == 1:
                singles.setdefault(int(hashes[0]), set()).add(t)
            if len(w) < 2:
                continue
            pairs = _pairs(hashes)
            sketches[-1] = [int(_values(pairs, f).min()) for f in range(HASHES)]
            classes.setdefault(math.ceil(math.log(len(pairs)) / math.log(PARTITION_RATIO)), []).append(t)
            if len(w) >= run:
                for key in self._band(pairs).tolist():
                    probes.setdefault(key, set()).add(t)
        self.singles, self.probes = self._lookup(singles), self._lookup(probes)
        #: (window size in pairs, one lookup per hash function) of each size partition
        self.partitions = []
        for members in classes.values():
            tables = []
            for f in range(HASHES):
                table: dict[int, set[int]] = {}
                for t in members:
                    table.setdefault(sketches[t][f], set()).add(t)
                tables.append(self._lookup(table, np.uint32))
            self.partitions.append((max(len(self.words[t]) - 1 for t in members), tables))
        self.widest = max([1, run - 1, *(size for size, _ in self.partitions)])

    def _band(self, pairs: np.ndarray) -> np.ndarray:
        size = self.run - 1
        key = np.zeros(len(pairs) - size + 1, dtype=np.uint64)
        for f in range(HASHES, HASHES + ROWS):
            key = (key ^ _window_minima(_values(pairs, f), [size])[size]) * np.uint64(0x9E3779B97F4A7C15)
        return key

    @staticmethod
    def _lookup(table: dict[int, set[int]], kind: type = np.uint64) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = sorted(table)
        return np.array(keys, dtype=kind), [np.array(sorted(table[k])) for k in keys]

    @staticmethod
    def _hits(found: np.ndarray, table: tuple[np.ndarray, list[np.ndarray]], doc_of: np.ndarray, texts: int) -> np.ndarray:
        """doc * texts + text, each once, of the window values that are in the table; equal neighbours are looked up once."""
        keys, members = table
        if not len(keys) or not len(found):
            return np.empty(0, dtype=np.int64)
        at = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (doc_of[1 : len(found)] != doc_of[: len(found) - 1]))))
        slot = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
        ok = keys[slot] == found[at]
        if not ok.any():
            return np.empty(0, dtype=np.int64)
        return np.unique(np.concatenate([doc_of[p] * texts + members[s] for p, s in zip(at[ok].tolist(), slot[ok].tolist(), strict=True)]))

    def candidates(self, docs: Sequence[Sequence[str]]) -> list[tuple[int, int]]:
        """(document, text) pairs of a batch whose sketches agree."""
        n = len(self.words)
        parts, owners = [], []
        for d, w in enumerate(docs):
            gap = max(1, self.widest + 1 - len(w))  # a short document's windows must not reach into the next one
            parts += [np.array(_word_hashes(w), dtype=np.uint64), np.zeros(gap, dtype=np.uint64)]
            owners.append((d, len(w), gap))
        hashes = np.concatenate([*parts, np.zeros(self.widest + 1, dtype=np.uint64)])
        lengths = np.array([size + gap for _, size, gap in owners])
        doc_of = np.repeat(np.arange(len(owners)), lengths)
        doc_of = np.concatenate((doc_of, np.full(self.widest + 1, len(owners) - 1)))
        ends = np.cumsum(lengths)
        void = np.ones(len(hashes), dtype=bool)  # positions where no pair of one document begins
        for (_, size, gap), end in zip(owners, ends.tolist(), strict=True):
            start = end - size - gap
            void[start : start + max(0, size - 1)] = False
        pairs = _pairs(hashes)
        void = void[:-1]
        found = [self._hits(hashes, self.singles, doc_of, n)] if len(self.singles[0]) else []
        if len(self.probes[0]):
            key = np.zeros(len(pairs) - self.run + 2, dtype=np.uint64)
            for f in range(HASHES, HASHES + ROWS):
                values = _values(pairs, f)
                values[void] = _LAST
                key = (key ^ _window_minima(values, [self.run - 1])[self.run - 1]) * np.uint64(0x9E3779B97F4A7C15)
            found.append(self._hits(key, self.probes, doc_of, n))
        agreeing = []
        for f in range(HASHES):
            if not self.partitions:
                break
            values = _values(pairs, f)
            values[void] = _LAST
            minima = _window_minima(values, sorted({size for size, _ in self.partitions}))
            agreeing += [self._hits(minima[size], tables[f], doc_of, n) for size, tables in self.partitions]
        if agreeing:
            keys, counts = np.unique(np.concatenate(agreeing), return_counts=True)
            found.append(keys[counts >= AGREE])
        merged = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        return [divmod(k, n) for k in merged.tolist()]

    def verify(self, doc: Sequence[str], texts: Sequence[int]) -> list[tuple[int, bool, float, int]]:
        """(text, has an equal run, containment of word pairs, edits or -1) of the texts that leaked into the document."""
        out = []
        runs = {tuple(doc[i : i + self.run]) for i in range(len(doc) - self.run + 1)}
        pairs = set(zip(doc, doc[1:], strict=False))
        for t in texts:
            w = self.words[t]
            allowed = int(self.max_edits * len(w))
            equal = not self.runs[t].isdisjoint(runs)
            contained = len(self.pairs[t] & pairs) / len(self.pairs[t]) if self.pairs[t] else 1.0
            # an edit breaks at most two of a text's word pairs, so fewer missing pairs are necessary
            could = len(self.pairs[t] - pairs) <= 2 * allowed
            n = edits(w, doc) if could else -1
            whole = 0 <= n <= allowed
            if equal or whole:
                out.append((t, equal, contained, n if whole else -1))
        return out


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, parts: Sequence[str], run: int = RUN, max_edits: float = MAX_EDITS
) -> DataFrame:
    """doc_id, item_id, part, equal_run, containment, edits (-1: only a run leaked): every item text found in a document."""
    spark = docs.sparkSession
    # the query set is a stated, small table; it comes in blocks so that no block outgrows the driver or a worker
    queries = (r for r in items.select(item_id, *parts).where(F.col(item_id).isNotNull()).toLocalIterator())
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc {doc_type}, item {item_type}, part string, equal_run boolean, containment double, edits int"
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where("text <> ''")
    results: list[DataFrame] = []
    for block in _blocks(queries, parts):
        owners: dict[str, list[tuple]] = {}
        for r in block:
            for part in parts:
                if r[part]:
                    owners.setdefault(r[part], []).append((r[item_id], part))
        texts = sorted(owners)
        shared = spark.sparkContext.broadcast((texts, [owners[t] for t in texts]))
        results.append(source.mapInArrow(_searcher(shared, run, max_edits), schema))
    found = reduce(DataFrame.unionAll, results) if results else spark.createDataFrame([], schema)
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "part", "equal_run", "containment", "edits")


def _blocks(queries: Iterator, parts: Sequence[str]) -> Iterator[list]:
    """The items in blocks bounded in number and in characters; one item may be larger than a block by itself."""
    block, chars = [], 0
    for r in queries:
        size = sum(len(r[p] or "") for p in parts)
        if block and (len(block) >= QUERY_BLOCK or chars + size > QUERY_CHARS):
            yield block
            block, chars = [], 0
        block.append(r)
        chars += size
    if block:
        yield block


#: The index a worker built last, by block.
_built: dict[tuple, list[tuple[QueryIndex, list]]] = {}


def _indexes(shared, run: int, max_edits: float) -> list[tuple[QueryIndex, list]]:
    """(index, its texts' owners) of the block, one for each length of runs; built once in a worker."""
    texts, owners = shared.value
    digest = xxhash.xxh3_128_hexdigest("\0".join(texts) + repr(owners))
    if (digest, run, max_edits) not in _built:
        _built.clear()
        by_run: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_run.setdefault(run_length(words(t), run), []).append(i)
        _built[digest, run, max_edits] = [(QueryIndex([texts[i] for i in own], length, max_edits), [owners[i] for i in own]) for length, own in sorted(by_run.items())]
    return _built[digest, run, max_edits]


def _searcher(shared, run: int, max_edits: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(shared, run, max_edits)
        item_kind = pa.array([o[0] for own in shared.value[1] for o in own]).type if shared.value[1] else pa.int64()
        for batch in batches:
            rows, lines = [], []
            for start in range(0, batch.num_rows, BATCH_DOCS):
                docs = [words(t) for t in batch.column(1).slice(start, BATCH_DOCS).to_pylist()]
                for index, owners in indexes:
                    by_doc: dict[int, list[int]] = {}
                    for d, t in index.candidates(docs):
                        by_doc.setdefault(d, []).append(t)
                    for d, mine in by_doc.items():
                        for t, equal, contained, n in index.verify(docs[d], mine):
                            for item, part in owners[t]:
                                rows.append(start + d)
                                lines.append((item, part, equal, contained, n))
            columns = list(zip(*lines, strict=True)) if lines else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], item_kind), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int32())],
                ["doc", "item", "part", "equal_run", "containment", "edits"],
            )

    return search
