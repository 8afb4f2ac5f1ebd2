"""Cutting long texts at natural boundaries.

A text is read once into tokens whose sizes are summed up; every kind of boundary is a sorted array of token offsets. A
piece takes the last boundary of the strongest kind below the limit by binary search; where none lies in the piece's second
half a weaker kind is tried, and where a single token exceeds the limit the cut is hard, inside a grapheme only if the
grapheme alone exceeds half the limit. The next piece starts at the sentence or word boundary nearest to `overlap` units
before the cut; where the next token would not fit behind that much overlap, it repeats less. No piece exceeds the limit.

Defined cases: NULL or empty text gives no pieces; a text within the limit is one piece; a text without any boundary is cut
hard at the limit; the pieces of one text, without their overlaps, join to exactly the text. Repeated rows are each cut.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token is a word, a run of white space, or one other character.
TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
#: Ends of boundaries, strongest first: paragraphs, lines, sentences, clauses, words.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (r"\n[ \t]*\n\s*", r"\n+", r"(?:[.!?…]['\"”’)\]]*\s+)|(?:[。！？]['\"”’」』）]*)", r"(?:[;:,—–]\s+)|[、；：，]", r"\s+")
)
#: Share of the limit that a piece must reach for a boundary to be taken.
LEAST_FILL = 0.5
#: Kinds of boundaries a piece may start at after stepping back, best first, and how far from `overlap` they may lie.
RESTARTS = ((2, 0.34), (4, 0.2))


def _joins(ch: str) -> bool:
    return unicodedata.category(ch) in ("Mn", "Me", "Mc") or ch in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= ch <= "\U0001f3ff"


def grapheme_start(text: str, at: int, low: int) -> int:
    """The last offset in (low, at] that doesn't split a base character from its marks; `at` if there is none."""
    i = at
    while i > low + 1 and i < len(text) and (_joins(text[i]) or text[i - 1] == "\u200d" or (text[i] == "\n" and text[i - 1] == "\r")):
        i -= 1
    return i if i > low and not (i < len(text) and _joins(text[i])) else at


def cut_points(text: str, limit: int, overlap: int, sizes: Callable[[str], int] = len) -> list[tuple[int, int]]:
    """(start, end) of the pieces in characters; `sizes` gives a token's size in the unit of `limit` and `overlap`."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if not text:
        return []
    offsets, parts = [0], []
    step = max(1, limit // 2)
    for m in TOKEN.finditer(text):
        word = m.group()
        n = sizes(word)
        if word[0] > "\u02ff" and parts and parts[-1] + n <= step and _joins(word[0]):  # marks stay with what they stand on
            parts[-1] += n
            offsets[-1] = m.end()
            continue
        if n <= step:
            parts.append(n)
            offsets.append(m.end())
            continue
        # a token that can't fit well is offered in graphemes, one that is a huge grapheme in characters
        last = m.start()
        for i in range(m.start() + 1, m.end() + 1):
            if i == m.end() or grapheme_start(text, i, last) == i:
                huge = sizes(text[last:i]) > step
                for a, b in pairwise(range(last, i + 1)) if huge else [(last, i)]:
                    parts.append(sizes(text[a:b]))
                    offsets.append(b)
                last = i
    total = list(accumulate(parts, initial=0))
    if total[-1] <= limit:
        return [(0, len(text))]
    place = dict(zip(offsets, range(len(offsets)), strict=True))
    kinds = [sorted({place[m.end()] for m in p.finditer(text) if m.end() in place}) for p in BOUNDARIES]
    pieces: list[tuple[int, int]] = []
    start = covered = 0
    while True:
        while total[covered + 1] - total[start] > limit:  # the overlap leaves no room for the next token
            if start == covered:
                raise ValueError(f"one character is larger than the limit of {limit}")
            start += 1
        if total[-1] - total[start] <= limit:
            pieces.append((offsets[start], len(text)))
            return pieces
        far = bisect_right(total, total[start] + limit) - 1
        least = max(bisect_left(total, total[start] + int(limit * LEAST_FILL)), covered + 1)
        end = far
        for kind in kinds:
            k = bisect_right(kind, far) - 1
            if k >= 0 and kind[k] >= least:
                end = kind[k]
                break
        else:
            cut = grapheme_start(text, offsets[far], offsets[covered])
            k = bisect_left(offsets, cut)
            if k > covered and offsets[k] == cut:
                end = k
        pieces.append((offsets[start], offsets[end]))
        covered = end
        start = _restart(kinds, total, start, end, overlap)


def _restart(kinds: Sequence[list[int]], total: list[int], start: int, end: int, overlap: int) -> int:
    if not overlap:
        return end
    want = total[end] - overlap
    for kind, slack in RESTARTS:
        k = bisect_left(kinds[kind], bisect_left(total, want))
        near = [b for b in kinds[kind][max(0, k - 1) : k + 1] if start < b < end and abs(total[b] - want) <= slack * overlap]
        if near:
            return min(near, key=lambda b: abs(total[b] - want))
    back = bisect_left(total, want)
    return back if start < back < end else end


def split_oversized(df: DataFrame, keys: Sequence[str], text: str, limit: int = 1800, overlap: int = 150) -> DataFrame:
    """keys, piece_no (from 1), n_pieces, piece_start, piece_end (code points, end excluded), repeated, piece.

    Only texts above the limit reach Python, as one column of an otherwise native plan; the input is read once and not
    shuffled. Keys must not be named like the result's columns; all other columns of the input are ignored.
    """
    piece = "struct<a:int,b:int,repeated:int,piece:string>"

    @F.arrow_udf(f"array<{piece}>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lists, none, starts, ends, repeats, pieces = [0], [], [], [], [], []
            for t in texts.to_pylist():
                last = 0
                for a, b in cut_points(t, limit, overlap) if t else []:
                    starts.append(a)
                    ends.append(b)
                    repeats.append(max(0, last - a))
                    pieces.append(t[a:b])
                    last = b
                lists.append(len(starts))
                none.append(t is None)
            items = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (starts, ends, repeats)] + [pa.array(pieces, pa.string())], ["a", "b", "repeated", "piece"])
            yield pa.ListArray.from_arrays(pa.array(lists, pa.int32()), items, mask=pa.array(none, pa.bool_()))

    rows = df.select(*keys, F.col(text).cast("string").alias("__text")).where("__text <> ''")
    rows = rows.withColumn("__pieces", cut(F.when(F.char_length("__text") > limit, F.col("__text"))))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.char_length("__text").alias("b"), F.lit(0).alias("repeated"), F.col("__text").alias("piece")))
    rows = rows.select(*keys, F.coalesce("__pieces", whole.cast(f"array<{piece}>")).alias("__pieces"))
    n = F.size("__pieces").alias("n_pieces")
    rows = rows.select(*keys, n, F.posexplode("__pieces").alias("at", "p"))
    return rows.select(*keys, (F.col("at") + 1).alias("piece_no"), "n_pieces", F.col("p.a").alias("piece_start"), F.col("p.b").alias("piece_end"), F.col("p.repeated").alias("repeated"), F.col("p.piece").alias("piece"))
