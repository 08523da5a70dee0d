"""Language identification as inference of a mixture of languages.

Each language has a smoothed character trigram model of words. A text is a mixture: each of its words comes from one
of its languages. Expectation maximisation estimates the languages' proportions from the words' likelihoods; then the
smallest language is dropped, and the rest estimated again, for as long as the penalised likelihood (BIC) gains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import hash60, lean, slices

#: Training rows a language: a larger number of labelled rows is sampled by the hash of the id to about this many.
TRAIN_ROWS = 20_000
#: Strength of the smoothing toward the shorter context; iterations of the first estimate and of those after a drop.
SMOOTH, FIRST, NEXT = 4.0, 10, 4
#: Text handled at a time, in bytes.
SLICE = 1_000_000
EDGES = ".,;:!?\"'()[]{}<>|/\\-_*#%&+=~`$^@0123456789«»„“”’‘…–—¿¡"


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


class _Words:
    """The words of some texts: ``token`` has each token's word number, ``size`` the tokens of each text, ``words`` the words."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        flat, size = [], []
        for t in texts:
            words = t.lower().split()
            for w in words:
                if w not in number:
                    number[w] = len(number)
            flat.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            size.append(len(words))
        bare = [w.strip(EDGES) for w in number]
        real = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in bare], bool)
        index = np.cumsum(real) - 1
        token = np.concatenate([*flat, np.zeros(0, np.int64)])
        text = np.repeat(np.arange(len(texts)), size)
        keep = real[token] if len(token) else np.zeros(0, bool)
        self.words = [w for w, r in zip(bare, real, strict=True) if r]
        self.token, self.text = index[token[keep]], text[keep]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of all words, 21 bits a character, that end in each character and in the word's end; the word of each."""
        chars = np.frombuffer((" " + " ".join(self.words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
        before = chars[:-1]
        before2 = np.where(before == 32, 32, np.concatenate([[32], chars[:-2]]))
        word = np.cumsum(chars == 32)[:-1] - 1
        return (before2 << 42) | (before << 21) | chars[1:], word


def _counts(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n`` of the texts in ``labelled`` (``lang, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, part in slices(pa.array(texts, pa.string()), SLICE):
                    w = _Words(part)
                    if w.words:
                        grams, word = w.trigrams()
                        uses = np.bincount(w.token, minlength=len(w.words))
                        keys, inverse = np.unique(grams, return_inverse=True)
                        n = np.bincount(inverse, weights=uses[word]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    return labelled.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Trigram counts by language, and those of the shorter contexts; keys are sorted, counts have a column a language."""

    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]  # of grams of 1, 2, 3 characters
    contexts: list[tuple[np.ndarray, np.ndarray]]  # of contexts of 0, 1, 2 characters

    @staticmethod
    def of(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
        def table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            uniq, inverse = np.unique(keys, return_inverse=True)
            out = np.zeros((len(uniq), len(languages)))
            np.add.at(out, (inverse, lang), n)
            return uniq, out

        low = [gram & (1 << 21) - 1, gram & (1 << 42) - 1, gram]
        return Model(languages, [table(k) for k in low], [table(k >> 21) for k in low])

    def log_likelihood(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each trigram's last character after the others, by language."""

        def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
            sorted_keys, values = table
            at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
            return np.where((sorted_keys[at] == keys)[:, None], values[at], 0.0)

        p = np.full((len(grams), len(self.languages)), 1e-6)
        for k, bits in enumerate((21, 42, 63)):
            keys = grams & (1 << bits) - 1
            p = (find(self.tables[k], keys) + SMOOTH * p) / (find(self.contexts[k], keys >> 21) + SMOOTH)
        return np.log(p)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows with text and language that are not held out, about ``rows`` of each language."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hash60(F.concat(F.lit("train/"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"), held_out(F.col(id_col)).alias("out"))
    labelled = labelled.where("not out and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    many = {k: int(2**60 * rows / n) for k, n in sizes.items() if n > rows}
    for lang, limit in many.items():
        labelled = labelled.where((F.col("lang") != lang) | (F.col("h") < limit))
    found = _counts(labelled.select("lang", "text")).toArrow()  # bounded by the sample's size
    languages = sorted(set(found["lang"].to_pylist()), key=lambda x: x.encode())
    number = {x: k for k, x in enumerate(languages)}
    lang = np.fromiter((number[x] for x in found["lang"].to_pylist()), np.int64, found.num_rows)
    return Model.of(languages, lang, found["gram"].to_numpy(), found["n"].to_numpy().astype(float))


def proportions(model: Model, texts: list[str]) -> np.ndarray:
    """Each text's share of each language, zero for those dropped; all zero for a text without letters."""
    n_langs, w = len(model.languages), _Words(texts)
    share = np.zeros((len(texts), n_langs))
    if not n_langs or not w.words:
        return share
    grams, word = w.trigrams()
    keys, inverse = np.unique(grams, return_inverse=True)
    each = model.log_likelihood(keys)[inverse]
    of_word = np.add.reduceat(each, np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1]), axis=0)
    of_word = np.exp(np.maximum(of_word - of_word.max(axis=1, keepdims=True), -60))
    # one row for each text and word, weighted by its occurrences
    pair, weight = np.unique(w.text * len(w.words) + w.token, return_counts=True)
    text, like = pair // len(w.words), of_word[pair % len(w.words)]
    texts_with, starts = np.unique(text, return_index=True)
    row = np.searchsorted(texts_with, text)
    n = np.add.reduceat(weight, starts)

    def estimate(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            joint = like * pi[row]
            pi = np.add.reduceat(joint * (weight / joint.sum(axis=1))[:, None], starts, axis=0) / n[:, None]
        return pi, np.add.reduceat(weight * np.log((like * pi[row]).sum(axis=1)), starts)

    pi, _ = estimate(np.full((len(texts_with), n_langs), 1 / n_langs), FIRST)
    pi = np.where(pi < np.minimum(0.5 / n, pi.max(axis=1))[:, None], 0, pi)
    pi, fit = estimate(pi / pi.sum(axis=1, keepdims=True), 1)
    open_ = (pi > 0).sum(axis=1) > 1
    while open_.any():
        least = n_langs - 1 - np.where(pi > 0, pi, 2)[:, ::-1].argmin(axis=1)  # of equal ones the last goes first
        fewer = pi.copy()
        fewer[open_, least[open_]] = 0
        fewer, fit2 = estimate(fewer / fewer.sum(axis=1, keepdims=True), NEXT)
        better = open_ & (fit2 + 0.5 * np.log(n) >= fit)
        pi[better], fit[better] = fewer[better], fit2[better]
        open_ = better & ((pi > 0).sum(axis=1) > 1)
    share[texts_with] = pi
    return share


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row, lang_pred, score, languages, shares`` of every row; ``row`` has the columns ``carry`` (all by default).

    ``lang_pred`` is the language of the largest share, ``score``; of equal shares the first language by code point.
    Texts that are null or have no letter, and all texts if the model has no language, get ``und`` and score 0.
    Repeated rows get equal answers. Names of other columns do not matter.
    """
    names = docs.columns if carry is None else carry
    row = F.struct(*[docs[c] for c in names]).alias("row")
    inside = names.index(text_col) if text_col in names else None  # the text goes to the workers once
    rows = docs.select(row) if inside is not None else docs.select(row, docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1) if inside is None else pc.struct_field(batch.column(0), [inside])
            for at, part in slices(texts, SLICE):
                share = proportions(model, part)
                best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(part), int)
                score = share[np.arange(len(part)), best] if share.shape[1] else np.zeros(len(part))
                ranks = [np.flatnonzero(s)[np.argsort(-s[s > 0], kind="stable")] for s in share]
                columns = [
                    batch.column(0)[at : at + len(part)],
                    pa.array([model.languages[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)], pa.string()),
                    pa.array(np.minimum(score, 1.0)),
                    pa.array([[model.languages[k] for k in r] for r in ranks], pa.list_(pa.string())),
                    pa.array([s[r].tolist() for s, r in zip(share, ranks, strict=True)], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "languages", "shares"])

    return rows.mapInArrow(lean(run), f"row {kind}, lang_pred string, score double, languages array<string>, shares array<double>")
