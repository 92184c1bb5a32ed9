"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits.  For each bit a binary classifier
over hashed byte n-grams of the words tells the languages with +1 from those
with -1; its weights are log-ratios of n-gram shares, which one aggregation
over all training documents gives.  A document's bit evidences are decoded to
the codeword of least weighted loss; the runner-up's loss says how ambiguous
the choice is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import ALNUM, Words, free_name, mix64, slices, sum_ranges, text_column

#: n-gram lengths in bytes, word boundaries included.
ORDERS = (1, 2, 3, 4)
#: Hash bins of n-grams.
BINS = 1 << 15
#: Added to every count.
SMOOTHING = 0.5
#: Up to this many languages every possible bit is used.
EXHAUSTIVE = 5
#: A choice is ambiguous when the runner-up has this share of its probability.
AMBIGUOUS = 0.9
UNDETERMINED = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1/-1.  Few languages: every distinct split into two
    non-empty sides.  More: the best separated of several seeded random codes,
    ten bits for each doubling of the languages."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits >> np.arange(n)[:, None] & 1, -1, 1).astype(np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), size=(n, bits))
        one_sided = np.abs(code.sum(0)) == n
        code[0, one_sided] *= -1
        gram = code.astype(np.int32) @ code.T
        np.fill_diagonal(gram, -bits)
        least = (bits - gram.max()) // 2
        if least > apart:
            best, apart = code, least
    return best


class WordGrams:
    """n-gram bins of the distinct words of a slice; word w owns
    ``bins[first[w]:first[w + 1]]``."""

    def __init__(self, words: Words) -> None:
        coded = words.words.dictionary_encode()
        self.word = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary
        n = len(distinct)
        size = np.diff(np.frombuffer(distinct.buffers()[1], np.int32)[:n + 1]) if n else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(size + 2)])  # a boundary byte on both sides
        text = np.full(at[-1], 0x20, np.uint64)
        inside = np.ones(at[-1], bool)
        inside[at[:-1]] = inside[at[1:] - 1] = False
        body = distinct.buffers()[2]
        text[inside] = np.frombuffer(body, np.uint8)[:inside.sum()] if n and body is not None else 0
        owner = np.repeat(np.arange(n), size + 2)
        room = at[1:][owner] - np.arange(at[-1])
        bins, holder = [], []
        code = np.zeros(at[-1], np.uint64)
        for k in range(max(ORDERS)):
            code = code << np.uint64(8)
            code[:len(code) - k] |= text[k:]
            if k + 1 in ORDERS:
                fits = room > k
                bins.append((mix64(code[fits] + (np.uint64(k + 1) << np.uint64(56))) % np.uint64(BINS)).astype(np.int64))
                holder.append(owner[fits])
        bins, holder = np.concatenate(bins), np.concatenate(holder)
        order = np.argsort(holder, kind="stable")
        self.bins = bins[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=n))])

    def spread(self, per_word: np.ndarray) -> np.ndarray:
        """A value per word, repeated for each of its n-grams."""
        return np.repeat(per_word, np.diff(self.first))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bins x bits
    trust: np.ndarray  # bits

    def losses(self, evidence: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword: texts x languages."""
        out = np.zeros((len(evidence), len(self.languages)))
        for l, word in enumerate(self.code):
            out[:, l] = np.logaddexp(0, -evidence * word) @ self.trust
        return out


def _count(languages: list[str], text_col: str, lang_col: str):
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BINS))
        for batch in batches:
            texts = text_column(batch, text_col)
            langs = np.array([place[x] for x in batch.column(batch.schema.get_field_index(lang_col)).to_pylist()])
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), ALNUM)
                grams = WordGrams(words)
                lang = np.repeat(langs[lo:hi], words.per_text())
                n = len(grams.first) - 1
                pair, times = np.unique(lang * n + grams.word, return_counts=True)
                for l in np.unique(pair // n) if n else []:
                    own = pair // n == l
                    per_word = np.zeros(n)
                    per_word[pair[own] % n] = times[own]
                    total[l] += np.bincount(grams.bins, weights=grams.spread(per_word), minlength=BINS)
        l, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(l, pa.int32()), pa.array(b, pa.int32()), pa.array(total[l, b], pa.float64())],
            names=["lang", "bin", "n"])
    return run


def fit(docs: DataFrame, text_col: str, lang_col: str) -> Model:
    """Fit from all rows with a language.  What reaches the driver is the list
    of languages and one count per language and n-gram bin."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    languages = sorted(r[0] for r in rows.select("l").distinct().collect())
    counted = rows.mapInArrow(_count(languages, "t", "l"), "lang int, bin int, n double") \
        .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BINS))
    counts[counted["lang"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
    share = counts + SMOOTHING
    share /= share.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BINS, code.shape[1]), np.float32)
    trust = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        plus, minus = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        ratio = np.log(plus / minus)
        weights[:, b] = ratio
        trust[b] = (plus - minus) @ ratio  # how far apart the two sides are
    if len(trust):
        trust /= trust.mean() or 1.0
    return Model(languages, code, weights, trust)


def predict(model: Model, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, its probability, the runner-up's) for each text."""
    n = len(texts)
    if len(model.languages) < 2:
        return np.zeros(n, int), np.full(n, float(len(model.languages))), np.zeros(n)
    words = Words(texts, ALNUM)
    grams = WordGrams(words)
    bits = model.weights.shape[1]
    per_word = np.zeros((len(grams.first) - 1, bits))
    for lo in range(0, len(per_word), 1 << 15):  # bounded gathers
        hi = min(lo + (1 << 15), len(per_word))
        part = grams.first[lo:hi + 1]
        per_word[lo:hi] = sum_ranges(model.weights[grams.bins[part[0]:part[-1]]].astype(np.float64), part - part[0])
    evidence = sum_ranges(per_word[grams.word], words.first)
    # neighbouring n-grams repeat each other's evidence
    losses = model.losses(evidence / len(ORDERS)) / max(1.0, model.code.shape[1] / 2)
    weight = np.exp(losses.min(1, keepdims=True) - losses)
    weight /= weight.sum(1, keepdims=True)
    best = np.argmin(losses, 1)
    top = weight[np.arange(n), best]
    weight[np.arange(n), best] = -1
    return best, top, weight.max(1)


def identify(docs: DataFrame, model: Model, text_col: str = "text",
             keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Documents with their language.

    Returns the frame (columns ``keep``, all by default, plus three) and the
    names of the three: ``lang_pred``, ``score`` (the chosen codeword's
    probability) and ``ambiguous``.  A null text, a text without a letter, or
    a model without a language gives ``und`` with score 0, not ambiguous.  Ties
    go to the first language by name.  Repeated rows each get a row; an empty
    table gives an empty table.
    """
    keep = docs.columns if keep is None else keep
    names = {k: free_name(docs, k) for k in ("lang_pred", "score", "ambiguous")}
    lettered = free_name(docs, "lettered")
    docs = docs.select(*dict.fromkeys([*keep, text_col])).withColumn(
        lettered, F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField(names["lang_pred"], T.StringType()),
                           T.StructField(names["score"], T.DoubleType()),
                           T.StructField(names["ambiguous"], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names_of = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = text_column(batch, text_col)
            has_letter = batch.column(batch.schema.get_field_index(lettered)).to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                best, top, second = predict(model, texts.slice(lo, hi - lo))
                known = has_letter[lo:hi].astype(bool) & (len(model.languages) > 0)
                best = np.where(known, best, len(model.languages))
                top = np.where(known, top, 0.0)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(f.name)) for f in fields),
                     pa.array(names_of[best].tolist(), pa.string()), pa.array(top, pa.float64()),
                     pa.array(known & (second >= AMBIGUOUS * top), pa.bool_())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names
