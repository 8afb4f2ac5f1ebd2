"""Languages of documents and of their segments, whatever their labels say.

A linear-chain conditional random field labels every word. Emissions are sums of learned weights of hashed features: the
word itself (lexicon), its affixes, its character n-grams and its script. There are two learned transition matrices, one
within sentences and one across their ends, where most switches happen. Posteriors come from the forward-backward algorithm
over whole documents. Words are pooled by sentence, neighbouring sentences of one language form a segment, and a document
has every language that holds a whole sentence of it.

Text in none of the languages is turned away: a segment whose words consist, to a larger part than almost any sentence of the
language does, of character shingles the language was never seen with gets the language `und`. So does text that holds no
whole sentence and whose words the field is unsure of.

The field is fitted on the driver on a bounded sample: about SAMPLE_DOCS documents in the proportions of their labels, but
LEAST_DOCS of each label at least (documented parameters), and the first SAMPLE_WORDS words of each. Labels may be wrong, but
wrong ones are rare against a frequent language, so the sample keeps natural proportions: a first fit gives every sentence
the language it is sure of, and the second is fitted on these. Applying it reads every document whole, in one pass without a shuffle.

Defined cases: NULL and empty texts have no language and give no segments; a text without letters gets the language `und`
with confidence 0; repeated rows are each labelled; labels are read in any code or spelling of LABELS, others are missing;
without any labelled document every text is `und`; columns other than the named ones are ignored.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.text import strip
from sievewright.session import shared_folder

# Codes and names of the languages, by two-letter code.
LABELS = {
    "en": "eng english englisch anglais",
    "de": "deu ger german deutsch allemand",
    "fr": "fra fre french francais français französisch",
    "es": "spa spanish espanol español castellano spanisch",
    "it": "ita italian italiano italienisch",
    "pt": "por portuguese portugues português portugiesisch",
    "nl": "nld dut dutch nederlands niederländisch flemish",
    "sv": "swe swedish svenska schwedisch",
    "ru": "rus russian русский russisch",
    "ja": "jpn japanese 日本語 japanisch",
}

#: Bounds of the sample that the field is fitted on.
SAMPLE_DOCS, LEAST_DOCS, SAMPLE_WORDS = 2500, 150, 200
#: Posterior at which the first fit's language of a sentence counts more than its document's label.
SURE = 0.9
#: Scripts a sentence must hold a word of, where its language isn't written in Latin script.
SCRIPTS, LATIN = {"ru": {"cyrillic"}, "ja": {"kana", "han"}}, {"latin", "other"}
#: Size of the hashed feature space, rounds over the sample of the first and the second fit, words per training sentence,
#: sequences per step, and the step size.
FEATURES, FIRST_ROUNDS, ROUNDS, SEQUENCE, SEQUENCES, STEP = 1 << 16, 3, 3, 48, 160, 0.6
#: What is in none of the languages: its name, the size of the space of hashed shingles, the quantile and the margin of the
#: share of known shingles, and the posterior that text without a whole sentence must have.
UNKNOWN, SHINGLES, STRANGE, MARGIN, LEAST_SURE = "und", 1 << 18, 0.05, 0.6, 0.6
#: Words (Latin or Cyrillic script) or characters (scripts without spaces) of a whole sentence, the posterior its words must
#: have on average, and the words in a row that make one where punctuation is missing.
SENTENCE_WORDS, SENTENCE_CHARS, SENTENCE_SURE, RUN_WORDS = 4, 8, 0.85, 9
#: Raised whenever the fit changes, so that no field of an earlier one is loaded.
FIELD_VERSION = 1
#: Words whose scores a worker keeps, and words, padding included, per pass of the forward-backward algorithm.
CACHE_WORDS, PASS_WORDS = 200_000, 60_000

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_NO_SPACE = "\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
#: Scripts without spaces are read in runs of one script.
_WORD = re.compile(
    r"[\u3041-\u309f]+|[\u30a0-\u30ff\u31f0-\u31ff\uff66-\uff9f]+|[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3005]+|"
    rf"(?:(?![{_NO_SPACE}\u3005])[^\W\d_])+(?:['\u2019-](?:(?![{_NO_SPACE}\u3005])[^\W\d_])+)*"
)
#: Ends of sentences: marks before white space or a closing sign, ideographic marks, line breaks.
_END = re.compile("[.!?\u2026]+[\"'\u201d\u2019\u00bb)\\]]*(?=\\s|$)|[\u3002\uff01\uff1f]+[\u300d\u300f\uff09\"]*|\\n+")
_QUOTED = re.compile("\"[^\"\n]{1,80}\"|\u201c[^\u201c\u201d\n]{1,80}\u201d|\u201e[^\u201e\u201c\u201d\n]{1,80}[\u201c\u201d]|\u00ab[^\u00ab\u00bb\n]{1,80}\u00bb|\u300c[^\u300c\u300d\n]{1,40}\u300d")


def label_code(label: Column) -> Column:
    """The two-letter code a label names in any known code or spelling, NULL where it names none."""
    base = F.lower(strip(label.cast("string")))
    base = F.coalesce(F.nullif(F.regexp_extract(base, r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", 1), F.lit("")), base)
    pairs = [(x, code) for code, names in LABELS.items() for x in (code, *names.split())]
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])[base]


@dataclass
class Words:
    """A document's words with their places, and the number of the sentence each stands in."""

    words: list[str]
    spans: list[tuple[int, int]]
    sentence: np.ndarray
    quoted: np.ndarray


def read_words(text: str) -> Words:
    hidden = _HIDDEN.search(text) is not None
    found = _seen_through(text) if hidden else [m.span() for m in _WORD.finditer(text)]
    ends = np.array([m.end() for m in _END.finditer(text)], dtype=np.int64)
    starts = np.array([a for a, _ in found], dtype=np.int64)
    quoted = np.zeros(len(found), dtype=bool)
    for m in _QUOTED.finditer(text):
        quoted[np.searchsorted(starts, m.start()) : np.searchsorted(starts, m.end())] = True
    words = [_HIDDEN.sub("", text[a:b]) if hidden else text[a:b] for a, b in found]
    return Words(words, found, np.searchsorted(ends, starts, side="right"), quoted)


def _seen_through(text: str) -> list[tuple[int, int]]:
    """Spans of words in the text whose invisible characters don't part words."""
    kept = [i for i, ch in enumerate(text) if not _HIDDEN.match(ch)]
    bare = "".join(text[i] for i in kept)
    return [(kept[m.start()], kept[m.end() - 1] + 1) for m in _WORD.finditer(bare)]


def _script(ch: str) -> str:
    if "\u0400" <= ch <= "\u04ff":
        return "cyrillic"
    if "\u3040" <= ch <= "\u30ff":
        return "kana"
    if "\u4e00" <= ch <= "\u9fff":
        return "han"
    return "latin" if ch < "\u0250" else "other"


@lru_cache(maxsize=100_000)
def features(word: str) -> np.ndarray:
    """Hashed features of a word: itself, affixes, character n-grams, scripts."""
    low = unicodedata.normalize("NFC", word.lower())
    framed = f"^{low}$"
    names = [f"w{low}", *(f"p{low[:n]}" for n in (1, 2, 3)), *(f"s{low[-n:]}" for n in (1, 2, 3, 4))]
    names += [framed[i : i + n] for n in (2, 3, 4) for i in range(len(framed) - n + 1)]
    # a script that few languages write weighs more than one n-gram
    names += [f"c{k}{s}" for s in {_script(ch) for ch in low} for k in range(2 if s == "latin" else 8)]
    names += [f"a{ch}" for ch in low if ch > "\x7f" and _script(ch) == "latin"]
    return np.array(sorted({zlib.crc32(n.encode()) % FEATURES for n in names}), dtype=np.int32)


def shingles(word: str) -> np.ndarray:
    """Hashed pieces by which a language knows a word: its trigrams, single characters in scripts without spaces."""
    low = unicodedata.normalize("NFC", word.lower())
    framed = f"^{low}$"
    names = low if _script(low[:1]) in ("kana", "han") else [framed[i : i + 3] for i in range(len(framed) - 2)]
    return np.array([zlib.crc32(n.encode()) % SHINGLES for n in names], dtype=np.int32)


class Field:
    """Weights of the conditional random field, its two passes, and what its languages were seen to consist of."""

    def __init__(
        self, languages: Sequence[str], weights: np.ndarray | None = None, inside: np.ndarray | None = None, across: np.ndarray | None = None,
        known: np.ndarray | None = None, least: np.ndarray | None = None,
    ):
        n = len(languages)
        self.languages = list(languages)
        self.weights = np.zeros((FEATURES, n), dtype=np.float32) if weights is None else weights
        self.inside = 2.0 * np.eye(n) if inside is None else inside
        self.across = np.eye(n) if across is None else across
        #: shingles each language was seen with, and the share of known ones below which a segment isn't in the language
        self.known = np.ones((SHINGLES, n), dtype=bool) if known is None else known
        self.least = np.zeros(n) if least is None else least
        self._number: dict[str, int] = {}
        self._lines = np.empty((0, 2 * n), dtype=np.float32)

    def parts(self) -> tuple:
        return (self.languages, self.weights, self.inside, self.across, self.known, self.least)

    def lines(self, words: Sequence[str]) -> np.ndarray:
        """For each word the emission scores of the languages and the share of its shingles each of them knows.

        A word's features share one unit of norm, so long words don't drown short ones.
        """
        if len(self._number) > CACHE_WORDS:
            self._number.clear()
        before = len(self._number)
        at = [self._number.setdefault(w, len(self._number)) for w in words]
        if len(self._number) > before:
            n = len(self.languages)
            new = list(islice(self._number, before, None))
            fresh = np.empty((len(new), 2 * n), dtype=np.float32)
            for i in range(0, len(new), 4096):
                fs, ss = [features(w) for w in new[i : i + 4096]], [shingles(w) for w in new[i : i + 4096]]
                sizes = np.array([len(f) for f in fs])
                fresh[i : i + len(fs), :n] = np.add.reduceat(self.weights[np.concatenate(fs)], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
                sizes = np.array([len(f) for f in ss])
                fresh[i : i + len(ss), n:] = np.add.reduceat(self.known[np.concatenate(ss)].astype(np.float32), np.cumsum(sizes) - sizes) / sizes[:, None]
            self._lines = np.concatenate((self._lines[:before], fresh))
        return self._lines[at]

    def posteriors(self, emissions: np.ndarray, crossing: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Forward-backward over a batch: emissions (B, T, L), crossing (B, T) true where a sentence begins.

        Returns posteriors (B, T, L), log normalisers (B) and, with `pairs`, expected transitions inside and across.
        """
        size, steps, n = emissions.shape
        top = emissions.max(axis=2, keepdims=True)
        local = np.exp(emissions - top)
        inside, across = np.exp(self.inside), np.exp(self.across)
        forward, scale = np.empty((steps, size, n)), np.empty((steps, size))
        here = local[:, 0]
        for t in range(steps):
            if t:
                moved = np.where(crossing[:, t, None], forward[t - 1] @ across, forward[t - 1] @ inside)
                here = moved * local[:, t]
            scale[t] = here.sum(axis=1)
            forward[t] = here / scale[t][:, None]
        alive = np.arange(steps)[None, :] < lengths[:, None]
        backward = np.ones((steps, size, n))
        seen_in, seen_across = np.zeros((n, n)), np.zeros((n, n))
        for t in range(steps - 2, -1, -1):
            ahead = local[:, t + 1] * backward[t + 1]
            went = np.where(crossing[:, t + 1, None], ahead @ across.T, ahead @ inside.T)
            went = went / scale[t + 1][:, None]
            backward[t] = np.where(alive[:, t + 1, None], went, 1.0)
            if pairs:
                for mask, matrix, seen in ((alive[:, t + 1] & ~crossing[:, t + 1], inside, seen_in), (alive[:, t + 1] & crossing[:, t + 1], across, seen_across)):
                    if mask.any():
                        seen += matrix * (forward[t][mask].T @ (ahead[mask] / scale[t + 1][mask][:, None]))
        post = (forward * backward).transpose(1, 0, 2)
        post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
        norm = np.where(alive.T, np.log(scale) + top[:, :, 0].T, 0).sum(axis=0)
        return post, norm, seen_in, seen_across


def sentences_of(doc: Words, limit: int = SEQUENCE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words of the document's sentences without what is quoted, the first `limit` words of each."""
    for s in np.unique(doc.sentence):
        at = np.flatnonzero((doc.sentence == s) & ~doc.quoted)[:limit]
        if len(at) > 1:
            yield at, [doc.words[i] for i in at]


def fit_field(samples: Sequence[tuple[str, list[str]]], seed: int = 0, rounds: int = ROUNDS) -> Field | None:
    """Maximum likelihood by adaptive gradient steps on (language, words of a sentence), joined to switching sequences."""
    rng = np.random.default_rng(seed)
    languages = sorted({code for code, _ in samples})
    if not languages:
        return None
    number: dict[str, int] = {}
    sentences = [(languages.index(code), np.array([number.setdefault(w, len(number)) for w in words])) for code, words in samples]
    each = [features(w) for w in number]
    width = np.array([len(f) for f in each])
    every, begins = np.concatenate(each), np.concatenate(([0], np.cumsum(width)[:-1]))
    field = Field(languages)
    n = len(languages)
    # a row per language, so that sums over features run along the memory
    weights, gw, gi, ga = np.zeros((n, FEATURES)), np.full((n, FEATURES), 1e-3), np.full((n, n), 1.0), np.full((n, n), 1.0)
    total, inside, across, batches = np.zeros((n, FEATURES)), np.zeros((n, n)), np.zeros((n, n)), 0
    for lap in range(rounds):
        # natural proportions: where labels are wrong, a balanced sample would be wrong more often
        pool = [sentences[i] for i in rng.permutation(len(sentences))]
        sequences: list[list[tuple[int, np.ndarray]]] = []
        while pool:
            sequence = [pool.pop()]
            if pool and rng.random() < 0.3:
                sequence.append(pool.pop())
            sequences.append(sequence)
        for at in range(0, len(sequences), SEQUENCES):
            chunk = sequences[at : at + SEQUENCES]
            lengths = np.array([sum(len(s) for _, s in seq) for seq in chunk])
            steps = int(lengths.max())
            ids = np.zeros((len(chunk), steps), dtype=np.int64)
            gold = np.zeros((len(chunk), steps), dtype=np.int64)
            crossing = np.zeros((len(chunk), steps), dtype=bool)
            for b, seq in enumerate(chunk):
                t = 0
                for i, s in seq:
                    ids[b, t : t + len(s)], gold[b, t : t + len(s)], crossing[b, t] = s, i, t > 0
                    t += len(s)
            alive = np.arange(steps)[None, :] < lengths[:, None]
            used, of_word = np.unique(ids[alive], return_inverse=True)
            sizes = width[used]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            index = every[np.repeat(begins[used] - starts, sizes) + np.arange(int(sizes.sum()))]
            root = np.sqrt(sizes)
            emissions = np.zeros((len(chunk), steps, n))
            emissions[alive] = np.stack([np.add.reduceat(weights[i][index], starts) for i in range(n)], axis=1)[of_word] / root[of_word][:, None]
            post, _, seen_in, seen_across = field.posteriors(emissions, crossing, lengths, pairs=True)
            delta = -post[alive]
            delta[np.arange(len(delta)), gold[alive]] += 1.0
            for i in range(n):
                by_word = np.bincount(of_word, delta[:, i], len(used)) / root
                grad = np.bincount(index, np.repeat(by_word, sizes), FEATURES)
                gw[i] += grad * grad
                weights[i] += STEP * grad / np.sqrt(gw[i])
            gold_in, gold_across = np.zeros((n, n)), np.zeros((n, n))
            both = alive[:, 1:]
            np.add.at(gold_in, (gold[:, :-1][both & ~crossing[:, 1:]], gold[:, 1:][both & ~crossing[:, 1:]]), 1)
            np.add.at(gold_across, (gold[:, :-1][both & crossing[:, 1:]], gold[:, 1:][both & crossing[:, 1:]]), 1)
            for matrix, g, gold_seen, seen in ((field.inside, gi, gold_in, seen_in), (field.across, ga, gold_across, seen_across)):
                step = gold_seen - seen
                g += step**2
                matrix += 0.1 * step / np.sqrt(g)
            if lap:  # the mean of the later laps' weights is steadier than the last ones
                total += weights
                inside += field.inside
                across += field.across
                batches += 1
    if not batches:
        return Field(languages, np.ascontiguousarray(weights.T, dtype=np.float32), field.inside, field.across)
    return Field(languages, np.ascontiguousarray((total / batches).T, dtype=np.float32), inside / batches, across / batches)


def learn_shingles(field: Field, samples: Sequence[tuple[int, str, list[str]]]) -> None:
    """What each language is made of, from (document, language, words of a sentence), and how much of it a sentence holds at least.

    The least share is that of the sentences of one half of the documents by the shingles of the other half, at the quantile
    STRANGE, less a margin; a language of few sentences knows little of its other half, so it turns less away.
    """
    halves = np.zeros((2, SHINGLES, len(field.languages)), dtype=bool)
    seen = {w: shingles(w) for w in {w for _, _, own in samples for w in own}}
    for doc, code, own in samples:
        for w in own:
            halves[doc % 2, seen[w], field.languages.index(code)] = True
    other = [{w: half[s].mean(axis=0) for w, s in seen.items()} for half in halves[::-1]]
    shares: list[list[float]] = [[] for _ in field.languages]
    for doc, code, own in samples:
        if len(own) >= SENTENCE_WORDS:
            i = field.languages.index(code)
            shares[i].append(sum(float(other[doc % 2][w][i]) for w in own) / len(own))
    field.known = halves.any(axis=0)
    field.least = np.array([np.quantile(x, STRANGE) * MARGIN if x else 0.0 for x in shares])


def label_batch(field: Field, docs: Sequence[Words]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(posteriors of every word, shares of its shingles that are known) of each document; those of similar length share a pass.

    A pass holds at most PASS_WORDS words, padding included, or one document.
    """
    n = len(field.languages)
    out = [(np.zeros((0, n)), np.zeros((0, n)))] * len(docs)
    order = sorted((i for i, d in enumerate(docs) if d.words), key=lambda i: len(docs[i].words))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(docs[order[end]].words) <= PASS_WORDS:
            end += 1
        mine, at = order[at:end], end
        lengths = np.array([len(docs[i].words) for i in mine])
        lines = field.lines([w for i in mine for w in docs[i].words])
        alive = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
        emissions = np.zeros((*alive.shape, n))
        emissions[alive] = lines[:, :n]
        crossing = np.zeros(alive.shape, dtype=bool)
        for b, i in enumerate(mine):
            crossing[b, 1 : lengths[b]] = docs[i].sentence[1:] != docs[i].sentence[:-1]
        post = field.posteriors(emissions, crossing, lengths)[0]
        ends = np.cumsum(lengths)
        for b, i in enumerate(mine):
            out[i] = (post[b, : lengths[b]], lines[ends[b] - lengths[b] : ends[b], n:])
    return out


def segments(field: Field, doc: Words, post: np.ndarray, known: np.ndarray) -> list[tuple[int, int, str, float, int, bool]]:
    """(start, end, language, confidence, words, holds a whole sentence) of the document's segments, in order."""
    if not len(post):
        return []
    best = post.argmax(axis=1)
    edges = np.flatnonzero(np.concatenate(([True], doc.sentence[1:] != doc.sentence[:-1]))).tolist()
    starts: list[int] = []
    for a, b in zip(edges, [*edges[1:], len(post)], strict=True):
        starts.append(a)
        if b - a >= 2 * RUN_WORDS and (best[a:b] != best[a]).any():
            # sentences run together without punctuation: cut where one long run gives way to another
            cuts = [a, *(np.flatnonzero(best[a + 1 : b] != best[a : b - 1]) + a + 1).tolist(), b]
            long = [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= RUN_WORDS and not doc.quoted[x:y].all()]
            starts += [y[0] for x, y in zip(long, long[1:], strict=False) if best[x[0]] != best[y[0]]]
    weigh = (~doc.quoted).astype(np.float64)
    free = np.add.reduceat(weigh, starts) > 0  # units that aren't one quotation
    stops = [*starts[1:], len(post)]
    if not free.all():
        for a, b, ok in zip(starts, stops, free, strict=True):
            if not ok:
                weigh[a:b] = 1.0
    counts = np.add.reduceat(weigh, starts)
    means = np.add.reduceat(post * weigh[:, None], starts, axis=0) / counts[:, None]
    shares = np.add.reduceat(known * weigh[:, None], starts, axis=0)
    scripts = [_script(w[0]) for w in doc.words]
    fitting = {}
    found: list[list] = []
    for u, (a, b) in enumerate(zip(starts, stops, strict=True)):
        written = frozenset(scripts[a:b])
        fits = fitting.get(written)
        if fits is None:
            fits = fitting[written] = np.array([bool(SCRIPTS.get(x, LATIN) & written) for x in field.languages])
        mean = means[u]
        if fits.any():
            mean = np.where(fits, mean, 0.0) / max(1e-9, float(mean[fits].sum()))
        i = int(mean.argmax())
        words, sure = int(counts[u]), float(mean[i])
        chars = sum(len(w) for w, s in zip(doc.words[a:b], scripts[a:b], strict=True) if s in ("kana", "han")) if {"kana", "han"} & written else 0
        whole = bool(free[u]) and sure >= SENTENCE_SURE and (words >= SENTENCE_WORDS or chars >= SENTENCE_CHARS)
        found.append([doc.spans[a][0], doc.spans[b - 1][1], i, sure * words, words, whole, float(shares[u][i])])
    # what is too short to stand for itself goes with its neighbour
    merged: list[list] = []
    for f in found:
        if merged and (merged[-1][2] == f[2] or not f[5] or not merged[-1][5]):
            last = merged[-1]
            if not last[5] and f[5]:
                last[2] = f[2]
            last[1], last[3], last[4], last[5], last[6] = f[1], last[3] + f[3], last[4] + f[4], last[5] or f[5], last[6] + f[6]
        else:
            merged.append(f)
    # a segment made of what its language was not seen with is in none of the languages
    out = []
    for a, b, i, s, n, whole, share in merged:
        strange = share / n < field.least[i] or (not whole and s / n < LEAST_SURE)
        out.append((a, b, UNKNOWN if strange else field.languages[i], s / n, n, whole and not strange))
    return out


def fit_on_labels(samples: Sequence[tuple[str, str]], seed: int = 0) -> Field | None:
    """Fits on (label, text) pairs, gives every sentence the language the first fit is sure of, and fits again on these."""
    docs = [read_words(t) for _, t in samples]
    parts = [(code, list(sentences_of(d))) for (code, _), d in zip(samples, docs, strict=True)]
    first = fit_field([(code, words) for code, own in parts for _, words in own], seed, FIRST_ROUNDS)
    if first is None:
        return None
    clean = []
    for d, ((code, own), (post, _)) in enumerate(zip(parts, label_batch(first, docs), strict=True)):
        for at, words in own:
            mean = post[at].mean(axis=0)
            i = int(mean.argmax())
            if mean[i] >= SURE or first.languages[i] == code:
                clean.append((d, first.languages[i], words))
    field = first
    if len({code for _, code, _ in clean}) == len(first.languages):
        field = fit_field([(code, words) for _, code, words in clean], seed + 1)
    learn_shingles(field, clean)
    return field


def draw_sample(df: DataFrame, text: str, label: str, doc_id: str, docs: int = SAMPLE_DOCS, least: int = LEAST_DOCS, seed: int = 0) -> list[tuple[str, str]]:
    """(label, text) of about `docs` labelled documents, drawn by a hash of their id, at least `least` of each label."""
    rows = df.select(F.col(text).cast("string").alias("text"), label_code(F.col(label)).alias("code"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("draw"))
    rows = rows.where("code is not null and char_length(text) > 0")
    counts = dict(rows.groupBy("code").count().collect())  # one row per language
    if not counts:
        return []
    total = sum(counts.values())
    share = {code: min(1.0, max(docs / total, least / n)) for code, n in counts.items()}
    drawn = rows.where((F.col("draw") / F.lit(2.0**64) + F.lit(0.5)) < F.create_map(*[F.lit(v) for kv in share.items() for v in kv])[F.col("code")])
    # only the sample's opening is fitted on; the bound is part of the sample, never of what is labelled
    drawn = drawn.select("code", F.substring("text", 1, SAMPLE_WORDS * 12).alias("text"), "draw")
    sample = sorted(drawn.limit(2 * (docs + least * len(LABELS))).collect(), key=lambda r: (r["draw"], r["code"], r["text"]))
    return [(r["code"], r["text"]) for r in sample]


def fit_on(df: DataFrame, text: str, label: str, doc_id: str, docs: int = SAMPLE_DOCS, least: int = LEAST_DOCS, seed: int = 0) -> Field | None:
    """Fits the field on a bounded sample of labelled documents; see draw_sample."""
    return fit_on_labels(draw_sample(df, text, label, doc_id, docs, least, seed), seed)


def save_field(spark: SparkSession, field: Field, path: str) -> None:
    languages, weights, inside, across, known, least = field.parts()
    blob = io.BytesIO()
    np.savez_compressed(blob, languages=np.array(languages), weights=weights, inside=inside, across=across, known=np.packbits(known), least=least)
    spark.createDataFrame([(bytearray(blob.getvalue()),)], "field binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_field(spark: SparkSession, path: str) -> Field | None:
    """The field saved at `path`; None where there is none."""
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    if row is None:
        return None
    with np.load(io.BytesIO(row["field"])) as part:
        languages = part["languages"].tolist()
        known = np.unpackbits(part["known"])[: SHINGLES * len(languages)].reshape(SHINGLES, -1).astype(bool)
        return Field(languages, part["weights"], part["inside"], part["across"], known, part["least"])


def fitted_once(df: DataFrame, text: str, label: str, doc_id: str, seed: int = 0) -> Field | None:
    """fit_on, saved in the shared folder under a digest of its sample: another query on the same documents loads it."""
    spark = df.sparkSession
    sample = draw_sample(df, text, label, doc_id, seed=seed)
    digest = xxhash.xxh3_128()
    bounds = (FIELD_VERSION, FEATURES, FIRST_ROUNDS, ROUNDS, SEQUENCE, SEQUENCES, STEP, SURE, SHINGLES, STRANGE, MARGIN, SENTENCE_WORDS, seed)
    for part in (repr(bounds), *(x for pair in sample for x in pair)):
        digest.update(part.encode("utf-8", "replace") + b"\0")
    path = f"{shared_folder(spark)}/language-field-{digest.hexdigest()}"
    field = load_field(spark, path)
    if field is None and (field := fit_on_labels(sample, seed)) is not None:
        save_field(spark, field, path)
    return field


def language_segments(df: DataFrame, doc_id: str, text: str, field: Field | None) -> DataFrame:
    """doc_id, segment_no, seg_start, seg_end (code points), lang, confidence, n_words, whole_sentence."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(None if field is None else field.parts())
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where("text <> ''")
    schema = f"doc {df.schema[doc_id].dataType.simpleString()}, segment_no int, seg_start int, seg_end int, lang string, confidence double, n_words int, whole_sentence boolean"
    names = ["doc", "segment_no", "seg_start", "seg_end", "lang", "confidence", "n_words", "whole_sentence"]

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(*shared.value) if shared.value else None
        for frame in frames:
            out = []
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                docs = [read_words(t) for t in part["text"]]
                posts = label_batch(own, docs) if own else [()] * len(docs)
                for key, t, doc, post in zip(part["doc"], part["text"], docs, posts, strict=True):
                    found = segments(own, doc, *post) if own else []
                    for i, s in enumerate(found or [(0, len(t), UNKNOWN, 0.0, 0, False)], 1):
                        out.append((key, i, *s))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(label, schema).withColumnRenamed("doc", doc_id)


def document_languages(found: DataFrame, doc_id: str) -> DataFrame:
    """doc_id, langs (those with a whole sentence, else the longest segment's), lang, confidence, mixed.

    A document's segments leave the labelling pass together, so grouping them costs one small row each.
    """
    by_lang = found.groupBy(doc_id, "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.greatest("n_words", F.lit(1))).alias("s"), F.sum(F.greatest("n_words", F.lit(1))).alias("m"), F.max("whole_sentence").alias("whole"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("whole"), F.col("n"), F.col("lang"), (F.col("s") / F.col("m")).alias("confidence"))), asc=False)
    grouped = by_lang.groupBy(doc_id).agg(parts.alias("parts"))
    whole = F.filter("parts", lambda p: p["whole"])
    chosen = F.when(F.size(whole) > 0, whole).otherwise(F.slice("parts", 1, 1))
    grouped = grouped.withColumn("parts", chosen)
    first = F.col("parts")[0]
    return grouped.select(doc_id, F.transform("parts", lambda p: p["lang"]).alias("langs"), first["lang"].alias("lang"), first["confidence"].alias("confidence"), (F.size("parts") > 1).alias("mixed"))
