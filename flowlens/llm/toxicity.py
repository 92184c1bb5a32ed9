"""Toxicity of deobfuscated text: a noisy channel and a scorer behind it.

Writers hide words by look-alike symbols, by spaces or dots between letters
and by repeated letters.  Every suspicious stretch of a text becomes a lattice
of what each symbol may stand for; Viterbi decoding under a character trigram
model of the whole corpus restores the likeliest reading.  The restored text
is scored by its words and word beginnings: how much more frequent they are in
toxic documents, with a margin for doubt, summed up by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import (
    ALNUM, Words, byte_set, free_name, mix64, raw_bytes, slices, sum_ranges, text_column, word_hashes,
)
from flowlens.operators._small import materialize

# Letters that a symbol may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e",
}
#: What may stand between letters: every other ASCII character; inside broken
#: words ("st.up.id") a single mark.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in LOOK_ALIKES)
MARKS = ".-_*/"
#: Channel costs (natural logarithms): a doubled letter meant single, a
#: separator dropped, a run of three and more letters meant as it stands.
SINGLE, JOIN, STRETCH = -6.0, -0.2, -4.0
#: A digit, @ or $ that stands for a letter, or for itself (at the head of a
#: number and inside it).
SUBSTITUTE, KEEP, KEEP_MORE = -1.0, -9.0, -1.0
#: The same for other marks, which stand for themselves more often, and one dropped.
MARK_SUBSTITUTE, MARK_KEEP, MARK_DROP = -4.0, -3.0, -14.0
#: A reading must be likelier than the stretch as written by this much.
MARGIN = 3.0
#: Characters of a stretch (one fewer is enough with two digits, an @ or a $), and
#: letters of the longest word in a spaced-out one, below which it stays.
LEAST, LEAST_SPACED = 4, 4
#: Hash bins of the character model: trigrams, bigrams, single characters.
TRIGRAMS, BIGRAMS, CHARACTERS = 1 << 18, 1 << 16, 1 << 12
#: Hash bins of word features.
FEATURES = 1 << 22
#: Lengths of word beginnings used as features.
BEGINNINGS = (3, 4, 5, 6)
#: Labelled rows learned from at most; beyond it a hash of the id chooses.
LABEL_ROWS = 200_000
#: A feature needs this many toxic documents, and must be this many times as
#: frequent in them after taking off DOUBT standard errors.
SUPPORT, RATIO, DOUBT = 4, 3.0, 2.0
#: One labelled row in CALIBRATE fits the final curve instead of the features.
CALIBRATE = 5
MEMO = 200_000

_LEET = re.escape("".join(LOOK_ALIKES))
_SEP = re.escape(SEPARATORS)
_SPACED = rf"(?<![^{_SEP}])[^{_SEP}](?:[{_SEP}]+[^{_SEP}](?![^{_SEP}])){{2,}}"
_BROKEN = rf"(?<![^{_SEP}])[^\W\d_]{{1,3}}(?:[{re.escape(MARKS)}][^\W\d_]{{1,3}}(?![^{_SEP}])){{2,}}"
_TRIGGER = re.compile(
    rf"(?P<spaced>{_SPACED}|{_BROKEN})|[{_LEET}](?=[^\W\d_])|(?<=[^\W\d_])(?:\d{{1,2}}|[@$][@$\d]*)(?!\w)"
    r"|(?P<run>[^\W\d_])(?P=run){2}|(?:(?P<pair>[a-z])(?P=pair)){3}")
_TAIL = re.compile(rf"[\w{_LEET}]*")
_HEAD = re.compile(rf"[\w{_LEET}]")

_LETTER = byte_set((0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF))
_DIGIT = byte_set((0x30, 0x39))
_SYMBOL = byte_set(*((b, b) for c in LOOK_ALIKES for b in c.encode()))
_GAP = byte_set(*((ord(c), ord(c)) for c in SEPARATORS))
_MARK = byte_set(*((ord(c), ord(c)) for c in MARKS))
_CLOSING = byte_set(*((ord(c), ord(c)) for c in "@$"))


def _char_bins(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each character with its two, one and no predecessors (boundaries
    in front of the first)."""
    c = codes.astype(np.uint64)
    b = np.concatenate([[np.uint64(32)], c[:-1]])
    a = np.concatenate([[np.uint64(32)], b[:-1]])
    a = np.where(b == 32, np.uint64(32), a)  # nothing reaches over a boundary
    return (mix64(a << np.uint64(42) ^ b << np.uint64(21) ^ c) % np.uint64(TRIGRAMS),
            mix64(b << np.uint64(21) ^ c) % np.uint64(BIGRAMS), mix64(c) % np.uint64(CHARACTERS))


_SIZES = (TRIGRAMS, BIGRAMS, CHARACTERS)


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = [np.zeros(n) for n in _SIZES]
    for batch in batches:
        texts = text_column(batch, "t")
        for lo, hi in slices(texts):
            coded = Words(texts.slice(lo, hi - lo), ALNUM).words.dictionary_encode()
            if not len(coded):
                continue
            times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            joined = (" ".join(coded.dictionary.to_pylist()) + " ").lower()
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            which = np.cumsum(codes == 32) - (codes == 32)
            weight = times[np.minimum(which, len(times) - 1)]
            for acc, bins in zip(total, _char_bins(codes), strict=True):
                acc += np.bincount(bins.astype(np.int64), weights=weight, minlength=len(acc))
    for kind, acc in enumerate(total):
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()),
                                          pa.array(acc[at], pa.float64())], names=["kind", "bin", "n"])


class CharModel:
    """Interpolated character trigram model over hashed counts."""

    def __init__(self, counts: list[np.ndarray]) -> None:
        self.tri, self.bi, self.one = counts
        self.total = self.one.sum() + 1.0
        self.known: dict[str, float] = {}

    def logp(self, context: str, char: str) -> float:
        key = context + char
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = math.log(self._share(context, char))
            if len(self.known) > MEMO:
                self.known.clear()
        return found

    def _share(self, context: str, char: str) -> float:
        a, b = context
        if b == " ":
            a = " "
        t, d, s = (int(x[-1]) for x in _char_bins(np.array([ord(x) for x in a + b + char], np.uint32)))
        p = (self.one[s] + 0.5) / (self.total + 0.5 * CHARACTERS)
        before = _char_bins(np.array([32, ord(a), ord(b)], np.uint32))
        p = (self.bi[d] + 2.0 * p) / (self.one[int(before[2][-1])] + 2.0)
        return min(1.0, (self.tri[t] + 2.0 * p) / (self.bi[int(before[1][-1])] + 2.0))


def fit_characters(docs: DataFrame, text_col: str) -> CharModel:
    """Character counts of all texts; a fixed number of bins reaches the driver."""
    counted = docs.select(F.col(text_col).cast("string").alias("t")) \
        .mapInArrow(_count_characters, "kind int, bin int, n double") \
        .groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (counted[c].to_numpy() for c in ("kind", "bin", "n"))
    counts = [np.zeros(size) for size in _SIZES]
    for k, acc in enumerate(counts):
        acc[at[kind == k]] = n[kind == k]
    return CharModel(counts)


def lattice(stretch: str) -> list[list[tuple[str, str, float]]]:
    """What every run of equal symbols may stand for: (reading, what the
    character model sees of it, channel cost).  The first reading is the run as
    written, where a mark or digit that is kept ends a word."""
    out = []
    for m in re.finditer(r"(.)\1*", stretch, re.S):
        run, c, n = m.group(), m.group(1), len(m.group())
        if c.isalpha() and n == 1:
            out.append([(c, c, 0.0)])
        elif c.isalpha() and n == 2:
            out.append([(run, run, 0.0), (c, c, SINGLE)])
        elif c.isalpha():
            out.append([(run, c * 3, STRETCH), (c + c, c + c, SUBSTITUTE), (c, c, 0.0)])
        elif c.isdigit() and c in LOOK_ALIKES:
            kept = KEEP_MORE if m.start() and stretch[m.start() - 1].isdigit() else KEEP
            out.append([(run, " ", kept * n), *_alike(c, n, SUBSTITUTE)])
        elif c in LOOK_ALIKES:
            often = c in "@$"
            out.append([(run, " ", (KEEP if often else MARK_KEEP) * n),
                        *_alike(c, n, SUBSTITUTE if often else MARK_SUBSTITUTE), ("", "", MARK_DROP * n)])
        elif c in SEPARATORS:
            out.append([(run, " ", 0.0), ("", "", JOIN)])
        else:
            out.append([(run, " ", 0.0)])
    return out


def _alike(c: str, n: int, cost: float) -> list[tuple[str, str, float]]:
    return [(x * min(n, 2), x * min(n, 2), cost) for x in LOOK_ALIKES[c]]


def _read(total: float, context: str, seen: str, model: CharModel) -> tuple[float, str]:
    """Total and context after the model has seen some more characters."""
    for char in seen:
        if not (char == " " and context[1] == " "):
            total += model.logp(context, char)
            context = context[1] + char
    return total, context


def as_written(nodes: list[list[tuple[str, str, float]]], model: CharModel) -> float:
    """Score of the reading that changes nothing."""
    total, context = 0.0, "  "
    for (_, seen, cost), *_ in nodes:
        total, context = _read(total + cost, context, seen, model)
    return total


def decode(stretch: str, model: CharModel) -> str:
    """The likeliest reading of a lattice (Viterbi over the last two
    characters), or the stretch itself if no reading is likelier by MARGIN.

    Readings are kept as linked steps, so a long stretch costs its length."""
    nodes = [*lattice(stretch), [("", " ", 0.0)]]
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for options in nodes:
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, back) in states.items():
            for emitted, seen, cost in options:
                total, context = _read(score + cost, state, seen, model)
                if context not in after or total > after[context][0]:
                    after[context] = (total, (back, emitted))
        states = after
    best, back = max(states.values(), key=lambda s: s[0])
    if best < as_written(nodes, model) + MARGIN:
        return stretch
    parts = []
    while back is not None:
        back, emitted = back
        parts.append(emitted)
    return "".join(reversed(parts)).strip()


class Restorer:
    """Restores texts; decoded stretches are remembered up to a bound."""

    def __init__(self, model: CharModel) -> None:
        self.model = model
        self.memo: dict[str, str] = {}

    def stretch(self, s: str, spaced: bool = False) -> str:
        """A stretch's reading, or the stretch where too little speaks for one."""
        if not spaced and len(s) < LEAST - (sum(c.isdigit() for c in s) > 1 or "@" in s or "$" in s):
            return s
        found = self._decoded(s)
        return s if spaced and max(map(len, found.split()), default=0) < LEAST_SPACED else found

    def _decoded(self, s: str) -> str:
        found = self.memo.get(s)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = decode(s, self.model)
            if len(s) <= 64:
                self.memo[s] = found
        return found

    def text(self, text: str) -> str:
        return self.slice(pa.array([text], pa.string()))[0].as_py()

    def _restored(self, text: str, starts: list[int]) -> str:
        """The text with the stretches that begin at some of the starts restored."""
        out, last, done = [], 0, 0
        for at in starts:
            m = _TRIGGER.match(text, at) if at >= done else None
            if m is None:
                continue
            done = m.end()
            start, end = m.span()
            if start < last:
                continue
            if m.lastgroup != "spaced":
                while start > last and _HEAD.match(text[start - 1]):
                    start -= 1
                end = _TAIL.match(text, m.start()).end()
            out += [text[last:start], self.stretch(text[start:end], m.lastgroup == "spaced")]
            last = end
        return "".join([*out, text[last:]])

    def slice(self, texts: pa.StringArray) -> pa.StringArray:
        """Lower-case texts with suspicious stretches restored; only texts that
        may hold one leave the array."""
        texts = pc.utf8_lower(texts)
        row, at = suspicious(texts)
        if not len(row):
            return texts
        suspects, first = np.unique(row, return_index=True)
        starts = np.split(at, first[1:])
        held = texts.take(pa.array(suspects)).to_pylist()
        restored = pa.array([self._restored(t, s.tolist()) for t, s in zip(held, starts, strict=True)], pa.string())
        mask = np.zeros(len(texts), bool)
        mask[suspects] = True
        return pc.replace_with_mask(texts, pa.array(mask), restored)


def may_hide(texts: pa.StringArray) -> np.ndarray:
    """Texts with a place where a stretch may begin."""
    out = np.zeros(len(texts), bool)
    out[suspicious(pc.utf8_lower(texts))[0]] = True
    return out


def suspicious(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, character) of every place in lower-case texts where a stretch may
    begin, in order: a symbol in front of a letter, a digit, @ or $ behind one,
    three equal letters, three pairs of letters, three single characters in a
    row or three short pieces between marks (a superset, from the bytes)."""
    body, at = raw_bytes(texts)
    n = len(body)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    letter = _LETTER[body]
    flag = np.zeros(n, bool)
    flag[:-1] |= _SYMBOL[body[:-1]] & letter[1:]
    flag[1:] |= letter[:-1] & (_DIGIT | _CLOSING)[body[1:]]
    same = body[1:] == body[:-1]
    flag[:n - 2] |= same[:-1] & same[1:] & letter[:n - 2]
    if n >= 6:
        pair = same & letter[1:]
        flag[:n - 5] |= pair[:n - 5] & pair[2:n - 3] & pair[4:]
    for width, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):  # three equal characters of several bytes
        many = np.flatnonzero((body >= lead) & (body < lead + (0x100 - lead) // 2))
        many = many[many + 3 * width <= n]
        for k in range(2 * width):
            many = many[body[many + k] == body[many + width + k]]
        flag[many] = True
    word = ~_GAP[body]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]  # a word ends with its text
    opens[edges] = word[edges]
    closes[edges - 1] = word[edges - 1]
    chars = np.cumsum((body & 0xC0) != 0x80, dtype=np.int32)  # characters: one lead byte each
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    if len(first) > 2:
        size = chars[last] - chars[first]
        tight = (first[1:] - last[:-1] == 2) & _MARK[body[np.minimum(last[:-1] + 1, n - 1)]]
        single, short = size == 0, size <= 2
        spaced = single[:-2] & single[1:-1] & single[2:]
        spaced |= short[:-2] & short[1:-1] & short[2:] & tight[:-1] & tight[1:]
        flag[first[:-2][spaced]] = True
    places = np.flatnonzero(flag)
    row = np.searchsorted(at, places, side="right") - 1
    return row, chars[places] - (chars[at[row]] if len(places) else 0)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature bins of each distinct word, distinct word of each word): the
    word itself and its beginnings; a short word's beginnings are the word."""
    coded = words.words.dictionary_encode()
    distinct = coded.dictionary
    if not len(distinct):
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int64), np.zeros(0, np.int64)
    kinds = [word_hashes(distinct)]
    for k in BEGINNINGS:
        kinds.append(word_hashes(pc.utf8_slice_codeunits(distinct, 0, k)) + np.uint64(k))
    bins = np.stack([(mix64(h) % np.uint64(FEATURES)).astype(np.int64) for h in kinds], 1)
    return bins, coded.indices.to_numpy(zero_copy_only=False)


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, family): a fingerprint of the whole set of a text's words, which
    is all that the features see of it; copies share it."""
    for batch in batches:
        texts = text_column(batch, "t")
        for lo, hi in slices(texts):
            words = Words(texts.slice(lo, hi - lo), ALNUM)
            coded = words.words.dictionary_encode()
            code = mix64(word_hashes(coded.dictionary) + np.uint64(77))
            n = max(1, len(code))
            text = np.repeat(np.arange(hi - lo), words.per_text())
            pair = np.unique(text * n + coded.indices.to_numpy(zero_copy_only=False))  # a word of a text once
            first = np.searchsorted(pair // n, np.arange(hi - lo))
            full = np.flatnonzero(words.per_text())
            mark = np.zeros(hi - lo, np.uint64)
            if len(full):
                mark[full] = np.add.reduceat(code[pair % n], first[full])
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(mark.view(np.int64))], names=["id", "y", "family"])


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature bins of the slice's distinct words; and text and word of every
    distinct word of every text, by text).  A word repeated in a text counts
    once, so repeated lines weigh no more than one."""
    bins, word = word_features(words)
    text = np.repeat(np.arange(len(words.first) - 1), words.per_text())
    pair = np.unique(text * max(1, len(bins)) + word)
    return bins, pair // max(1, len(bins)), pair % max(1, len(bins))


def _count_features(characters, chosen):
    """(bin, distinct words, texts) of a part, only of the chosen bins if
    given; bin -1 counts all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters.value)
        for batch in batches:
            texts = text_column(batch, "t")
            for lo, hi in slices(texts):
                bins, text, word = distinct_words(Words(restorer.slice(texts.slice(lo, hi - lo)), ALNUM))
                flat = (text[:, None] * FEATURES + bins[word]).ravel()
                if chosen is not None:
                    flat = flat[np.isin(flat % FEATURES, chosen.value)]
                flat, times = np.unique(flat, return_counts=True)
                at, where = np.unique(flat % FEATURES, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(at, -1), pa.int32()),
                     pa.array(np.append(np.bincount(where, times, len(at)), len(word)), pa.float64()),
                     pa.array(np.append(np.bincount(where, minlength=len(at)), hi - lo), pa.float64())],
                    names=["bin", "n", "docs"])
    return run


@dataclass
class Model:
    characters: CharModel
    bins: np.ndarray  # sorted
    weight: np.ndarray  # log-ratio of frequencies, doubt taken off
    curve: np.ndarray  # of the logistic curve over summary()


def summary(bins: np.ndarray, weight: np.ndarray, texts: pa.StringArray, restorer: Restorer) -> np.ndarray:
    """What the final curve sees of each text: a constant, the strongest weight,
    the weights' sum and density on log scales, and the length, all over distinct
    words."""
    found, text, word = distinct_words(Words(restorer.slice(texts), ALNUM))
    own = np.zeros(found.shape)
    if len(bins) and len(found):
        at = np.minimum(np.searchsorted(bins, found), len(bins) - 1)
        own = np.where(bins[at] == found, weight[at], 0.0)
    held = own.max(1, initial=0.0)[word] if len(word) else np.zeros(0)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    n = np.diff(first)
    total = sum_ranges(held, first)
    most = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        most[full] = np.maximum.reduceat(held, first[full])
    return np.stack([np.ones(len(n)), most, np.log1p(total), np.log1p(1000 * total / (n + 20)), np.log1p(n)], 1)


def _summaries(characters, bins, weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters.value)
        for batch in batches:
            texts = text_column(batch, "t")
            for lo, hi in slices(texts):
                part = summary(bins.value, weight, texts.slice(lo, hi - lo), restorer)
                y = batch.column(batch.schema.get_field_index("y")).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [y, *(pa.array(part[:, k]) for k in range(1, part.shape[1]))], names=["y", "a", "b", "c", "d"])
    return run


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression (Newton steps)."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str,
        label_rows: int = LABEL_ROWS) -> Model:
    """Character model from all texts; features and curve from at most
    ``label_rows`` labelled rows, one of each label of copies (texts of the
    same set of words).

    The labelled ids are at most about ``label_rows`` (a hash of the id keeps
    that share of more) and travel to the documents by broadcast, so no text is
    shuffled.  Null labels and ids are left out; of several labels of an id the
    largest counts."""
    spark = docs.sparkSession
    characters = fit_characters(docs, text_col)
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = labels.count()
    if n > label_rows:
        labels = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * label_rows / n))
    labels = materialize(labels, "labelled")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    family_schema = rows.select("id", F.lit(0).alias("y"), F.lit(0).cast("bigint").alias("family")).schema
    families = rows.join(F.broadcast(labels), "id").select("id", "y", "t").mapInArrow(_family, family_schema)
    one = families.groupBy("family", "y").agg(F.min("id").alias("id")).select("id").distinct()
    labels = materialize(labels.join(one, "id"), "labelled")
    labelled = rows.join(F.broadcast(labels), "id")
    curve_part = F.pmod(F.hash("id"), F.lit(CALIBRATE)) == 0
    shared = spark.sparkContext.broadcast(characters)

    def count(toxic: int, chosen) -> pa.Table:
        part = labelled.where((F.col("y") == toxic) & ~curve_part).select("t")
        return part.mapInArrow(_count_features(shared, chosen), "bin int, n double, docs double") \
            .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")) \
            .where((F.col("docs") >= (SUPPORT if toxic else 0)) | (F.col("bin") < 0)).orderBy("bin").toArrow()

    toxic = count(1, None)
    bins = toxic["bin"].to_numpy().astype(np.int64)
    share, support = toxic["n"].to_numpy(), toxic["docs"].to_numpy()
    clean = count(0, spark.sparkContext.broadcast(bins))
    against = np.zeros(len(bins))
    there = np.searchsorted(bins, clean["bin"].to_numpy())
    known = there < len(bins)
    against[there[known]] = clean["n"].to_numpy()[known]
    weight = np.zeros(len(bins))
    if len(bins) and against[0]:
        weight = np.log((share + 0.5) / share[0]) - np.log((against + 0.5) / against[0]) \
            - DOUBT * np.sqrt(1 / support + 1 / (against + 1))
    strong = (weight > math.log(RATIO)) & (bins >= 0)
    bins, weight = bins[strong], weight[strong]
    seen = labelled.where(curve_part).select("y", "t").mapInArrow(
        _summaries(shared, spark.sparkContext.broadcast(bins), weight),
        "y int, a double, b double, c double, d double").toArrow()
    x = np.stack([np.ones(len(seen)), *(seen[c].to_numpy() for c in "abcd")], 1)
    return Model(characters, bins, weight, logistic_curve(x, seen["y"].to_numpy().astype(float)))


def score(model: Model, texts: pa.StringArray, restorer: Restorer) -> np.ndarray:
    x = summary(model.bins, model.weight, texts, restorer)
    return 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text",
                   keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Documents with a toxicity score from 0 to 1 of their restored texts.

    Returns the frame (columns ``keep``, all by default, plus one) and the
    name of the one.  Null and empty texts get the curve's value for no words;
    a model without labelled rows scores every text 0.5.  Repeated rows each
    get a row; an empty table gives an empty table.
    """
    keep = docs.columns if keep is None else keep
    name = free_name(docs, "toxicity")
    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = Restorer(model.characters)
        for batch in batches:
            texts = text_column(batch, text_col)
            for lo, hi in slices(texts):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(f.name)) for f in fields),
                     pa.array(score(model, texts.slice(lo, hi - lo), restorer), pa.float64())],
                    names=schema.fieldNames())

    return docs.mapInArrow(run, schema), name
