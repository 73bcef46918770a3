"""Language identification by mixture inference.

Model: for each language, smoothed likelihoods of the character trigrams (word
ends marked) of its training words. A word's likelihood in a language is
its n-grams' product. A document is a mixture: expectation-maximisation
estimates the share of its words that each language wrote. The set of languages
grows one at a time, while the log-likelihood gains more than ``penalty`` times
half the log of the number of words (a Bayesian information criterion for one
more free share). The prediction is the language with the largest share, and
the score is its share times the certainty that this language, rather than
another alone, explains the words given to it.

Training reads at most ``max_docs`` labelled texts of each language: those of at
most ``max_chars`` characters first, in the order of a hash of their id, each
whole; if there are too few, the first ``max_chars`` characters of longer ones,
so a language of long texts alone is learned too. Prediction reads whole texts and never lang, source or id. The model
is n-grams x languages, cut to the ``max_grams`` most frequent n-grams, so its
broadcast has a fixed bound for each language.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows
are judged each on its own. Without labelled rows every text is ``und``. Ties
go to the language that sorts first. Columns besides id, text and lang play no
part.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

LETTER = regex.compile(r"\p{L}")
EDGE = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")
#: Entries of one worker's cache of words.
CACHE = 300_000
#: Distinct words of one step of inference, which bounds memory with very long texts.
WORDS = 1 << 16


def grams(word: str) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[k : k + 3] for k in range(len(marked) - 2)]


def core(word: str) -> str:
    """The word in lower case from its first letter to its last; empty if it has none."""
    return word if word.isalpha() and word.islower() else EDGE.sub("", word).lower()


class Model:
    """Log-likelihoods of n-grams by language; the last row is that of unseen n-grams."""

    def __init__(self, langs: list[str], table: dict[str, int], logp: np.ndarray):
        self.langs, self.table, self.logp = langs, table, logp

    def start(self) -> None:
        #: Word to its row of ``store``; row 0 is that of words without a letter.
        self.known: dict[str, int] = {}
        self.store = np.zeros((CACHE + WORDS + 1, len(self.langs)))
        self.used = 1

    def __getstate__(self):
        return self.langs, self.table, self.logp

    def __setstate__(self, state):
        self.langs, self.table, self.logp = state
        self.start()

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Rows of ``words`` (at most ``WORDS``); zero rows for those without a letter."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if self.used + len(new) > len(self.store):
                known.clear()
                self.used, new = 1, words
            get, flat, starts, own = self.table.get, [], [], []
            for raw in new:
                word = core(raw)
                if word:
                    marked = f"\x02{word}\x03"
                    starts.append(len(flat))
                    flat += [get(marked[k : k + 3], -1) for k in range(len(word))]
                    own.append(raw)
                else:
                    known[raw] = 0
            if own:
                self.store[self.used : self.used + len(own)] = np.add.reduceat(self.logp[flat], starts, axis=0)
                known.update(zip(own, range(self.used, self.used + len(own)), strict=True))
                self.used += len(own)
        return self.store[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def train(texts: dict[str, list[str]], max_grams: int = 60_000) -> Model | None:
    """A model of each language's texts."""
    langs = sorted(texts)
    if not langs:
        return None
    counts = []
    for lang in langs:
        words: Counter = Counter()
        for text in texts[lang]:
            words.update(w for w in map(core, text.split()) if w)
        own: Counter = Counter()
        for word, n in words.items():
            for g in grams(word):
                own[g] += n
        counts.append(own)
    total: Counter = Counter()
    for own in counts:
        total.update(own)
    kept = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_grams]]
    table = {g: k for k, g in enumerate(kept)}
    sums = np.array([sum(own.values()) for own in counts], np.float64)
    seen = np.array([[own[g] for own in counts] for g in kept], np.float64).reshape(len(kept), len(langs))
    smooth = 0.5
    model = Model(langs, table, np.log((np.vstack([seen, np.zeros(len(langs))]) + smooth) / (sums + smooth * (len(kept) + 1))))
    model.start()
    return model


def mixture(like: np.ndarray, counts: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``like`` (log-likelihoods by word) and the log-likelihood."""
    top = like.max(axis=1, keepdims=True)
    p = np.exp(like - top)
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        mix = p * share
        share = (mix * (counts / mix.sum(axis=1))[:, None]).sum(axis=0) / counts.sum()
    return share, float((counts * (np.log((p * share).sum(axis=1)) + top[:, 0])).sum())


def infer(like: np.ndarray, counts: np.ndarray, penalty: float = 2.0) -> tuple[int, float, dict[int, float]]:
    """Best language, score and the shares of the chosen set."""
    n_langs = like.shape[1]
    alone = (like * counts[:, None]).sum(axis=0)
    chosen = [int(np.argmax(alone))]
    share, best = np.ones(1), float(alone[chosen[0]])
    price = penalty * 0.5 * np.log(counts.sum() + 1) + np.log(n_langs)
    while len(chosen) < n_langs:
        # The most that language k can add: each word takes the better of it and the set.
        now = like[:, chosen].max(axis=1)
        bound = (np.maximum(like - now[:, None], 0) * counts[:, None]).sum(axis=0)
        found = None
        for k in range(n_langs):
            if k in chosen or bound[k] <= price:
                continue
            new, value = mixture(like[:, [*chosen, k]], counts)
            if value - best > price and (found is None or value > found[2]):
                found = (k, new, value)
        if found is None:
            break
        chosen.append(found[0])
        share, best = found[1], found[2]
    top = max(range(len(chosen)), key=lambda i: (share[i], -chosen[i]))
    rest = np.delete(alone, chosen[top])
    certainty = 1.0 if not len(rest) else 1 / (1 + np.exp(-np.clip(abs(alone[chosen[top]] - rest.max()), 0, 50)))
    return chosen[top], float(min(1.0, share[top] * certainty)), {chosen[i]: float(share[i]) for i in range(len(chosen))}


def predict(model: Model | None, text: str | None) -> tuple[str, float, dict[str, float]]:
    if model is None or not text:
        return "und", 0.0, {}
    words = Counter(text.split())
    names = [*words]
    like = np.concatenate([model.likelihoods(names[k : k + WORDS]) for k in range(0, len(names), WORDS)]) if names else np.zeros((0, 1))
    counts = np.fromiter(words.values(), np.float64, len(words))
    lettered = like[:, 0] < 0
    if not lettered.any():
        return "und", 0.0, {}
    best, score, shares = infer(like[lettered], counts[lettered])
    return model.langs[best], score, {model.langs[k]: s for k, s in shares.items()}


def _predict(batches, shipped):
    model = shipped.value
    for batch in batches:
        out = [predict(model, t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([[*x[2].items()] for x in out], pa.map_(pa.string(), pa.float64()))],
            names=["id", "lang_pred", "score", "shares"],
        )


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string")) % 4 == 2).alias("held_out")


def fit(docs: DataFrame, max_docs: int = 250, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the labelled documents that are not held out.

    The sample is bounded: ``max_docs`` x ``max_chars`` characters a language.
    Longer texts are taken last, and only their first ``max_chars`` characters.
    """
    from pyspark.sql import Window

    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False)))
    order = Window.partitionBy(lang_col).orderBy("__long", F.xxhash64(id_col), id_col)
    # Ids first, so that texts of the chosen rows alone are moved.
    ids = usable.select(lang_col, id_col, (F.length(text_col) > max_chars).alias("__long")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_docs).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    chosen = usable.join(F.broadcast(ids), (F.col(id_col) == F.col("__id")) & (F.col(lang_col) == F.col("__lang")))
    rows = chosen.select("__lang", F.substring(text_col, 1, max_chars).alias("text")).orderBy("__lang", F.xxhash64("text"))
    texts: dict[str, list[str]] = {}
    for row in rows.toLocalIterator():
        if len(own := texts.setdefault(row[0], [])) < max_docs:
            own.append(row[1])
    return train(texts)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares) of every document. Narrow: no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_predict, shipped=shipped), f"id {kind}, lang_pred string, score double, shares map<string,double>")
    return out.withColumnRenamed("id", id_col)
