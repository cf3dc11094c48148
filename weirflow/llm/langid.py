"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the embeddings of its words' subwords (all runs of 3 to 5 bytes of whole words, with word ends marked), hashed
into a fixed number of rows. As the classifier is linear, a subword's share of the logits is a table row, a word's a cached
sum of rows, and scoring a text is one table lookup per word. A temperature fitted on the calibration part of the sample
turns logits into probabilities; texts below the confidence at which that part reaches the wanted precision are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .sampling import held_out, per_class_sample

#: The bound of the sample: documents of each language, and about so many in all (with many languages fewer of each, but all languages).
#: Of each document all words count, as often as they occur.
SAMPLE_DOCS, SAMPLE_ALL = 1_000, 10_000
#: Lengths of subwords in bytes.
SUBWORDS = (3, 4, 5)
#: Bytes of words that are hashed at once; words of over so many characters aren't kept in the cache.
BLOCK, LONG = 1 << 18, 64
ROWS, DIM, EPOCHS, BATCH, RATE = 1 << 16, 16, 4, 32, 0.5
#: Steps of a training at least.
LEAST_STEPS = 300
PRECISION = 0.98
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_MULTIPLIERS = (np.arange(1, 9, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)


def blocks(words: list[str], most: int | None = None) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Marked words in blocks of about ``most`` bytes: pieces, how many subwords of each length may start in a piece, and the word
    it is of. A longer word is in several pieces that overlap, so each of its subwords starts in one of them."""
    most, over = most or BLOCK, max(SUBWORDS) - 1
    pieces, own, of, held = [], [], [], 0
    for k, w in enumerate(words):
        marked = f"<{w}>".encode()
        for a in range(0, len(marked), most):
            pieces.append(marked[a : a + most + over])
            own.append(min(most, len(marked) - a))
            of.append(k)
            held += own[-1]
            if held >= most:
                yield pieces, own, of
                pieces, own, of, held = [], [], [], 0
    if pieces:
        yield pieces, own, of


def subwords(pieces: list[bytes], own: list[int], of_word: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all subwords of a block, and which word each is of."""
    sizes = np.asarray([len(m) for m in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    end = np.cumsum(sizes)
    word, last, end = np.repeat(np.asarray(of_word), sizes), np.repeat(end - sizes + own, sizes), np.repeat(end, sizes)
    place = np.arange(len(text))
    rows, of = [], []
    for n in SUBWORDS:
        at = np.flatnonzero((place < last) & (place + n <= end))
        h = np.full(len(at), n, np.uint32)
        for j in range(n):
            h = (h ^ text[at + j]) * _MULTIPLIERS[j]
            h ^= h >> np.uint32(15)
        rows.append((h & np.uint32(ROWS - 1)).astype(np.int64))
        of.append(word[at])
    return np.concatenate(rows), np.concatenate(of)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.langs, self.table, self.bias, self.temperature, self.reject_below = langs, table, bias, temperature, reject_below

    def logits(self, total: np.ndarray, n: float) -> np.ndarray:
        return (total / max(n, 1) + self.bias) / self.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bag(text: str) -> tuple[bytes, bytes]:
    """The rows of a text's subwords, and how often each occurs."""
    counts = np.zeros(ROWS, np.int64)
    for block in blocks(text.lower().split()):
        counts += np.bincount(subwords(*block)[0], minlength=ROWS)
    rows = np.flatnonzero(counts)
    return rows.astype(np.uint16).tobytes(), counts[rows].astype(np.uint32).tobytes()


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 17) -> Model | None:
    """bags: the subword rows of each text and their counts. A quarter of the texts calibrates, the others train. None without texts."""
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    order = rng.permutation(len(bags))
    n_cal = len(bags) // 4 if len(bags) >= 40 else 0
    cal, fit = order[:n_cal], order[n_cal:]
    # a language with few texts trains on all of them, if chance leaves it none
    missing = ~np.isin(y[cal], y[fit])
    cal, fit = cal[~missing], np.concatenate((fit, cal[missing]))
    n_cal = len(cal)
    emb = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    shares = [(n / n.sum(dtype=np.float64)).astype(np.float32) for _, n in bags]
    # small samples are gone through more often
    per_epoch = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), BATCH):
            own = fit[k : k + BATCH]
            mean = np.stack([shares[i] @ emb[bags[i][0]] for i in own])
            grad = _softmax(mean @ weight + bias)
            grad[np.arange(len(own)), y[own]] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            back = (grad @ weight.T).astype(np.float32)
            weight -= rate / len(own) * mean.T @ grad
            bias -= rate / len(own) * grad.sum(axis=0)
            for i, change in zip(own, rate * 10 * back, strict=True):
                emb[bags[i][0]] -= shares[i][:, None] * change
            step += 1
    table = (emb @ weight).astype(np.float32)
    model = Model(langs, table, bias.astype(np.float32), 1.0, 0.0)
    if n_cal:
        z = np.stack([model.logits(n @ table[rows], n.sum(dtype=np.float64)) for rows, n in (bags[i] for i in cal)])
        losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(n_cal), y[cal]], 1e-9)).mean() for t in np.geomspace(0.05, 10, 40)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == y[cal]
        down = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, n_cal + 1) >= PRECISION)
        model.reject_below = float(best[down[good[-1]]]) if len(good) else 1.0
    return model


class WordSums(dict):
    """word -> row of ``sums``: its subwords' share of the logits, and their number. Emptied when full."""

    def __init__(self, table: np.ndarray, most: int = 300_000):
        super().__init__()
        # with many languages fewer words, so that the sums take at most 256 MB
        self.table, self.most = table, max(1_000, min(most, (1 << 26) // (table.shape[1] + 1)))
        self.sums = np.zeros((self.most, table.shape[1] + 1), np.float32)

    def add(self, words: list[str], out: np.ndarray) -> None:
        """Adds each word's share to its row of ``out``."""
        for block in blocks(words):
            rows, of = subwords(*block)
            a, b = block[2][0], block[2][-1] + 1
            for c in range(self.table.shape[1]):
                out[a:b, c] += np.bincount(of - a, self.table[rows, c], b - a)
            out[a:b, -1] += np.bincount(of - a, minlength=b - a)

    def learn(self, words: list[str]) -> None:
        k, n = len(self), len(words)
        self.sums[k : k + n] = 0
        self.add(words, self.sums[k : k + n])
        self.update(zip(words, range(k, k + n), strict=True))

    def of(self, words: list[str]) -> np.ndarray:
        """The sum over all words, in parts, so that a long text can't overfill the table."""
        total = np.zeros(self.sums.shape[1])
        size = min(50_000, self.most)
        for k in range(0, len(words), size):
            part = words[k : k + size]
            if long := [w for w in part if len(w) > LONG]:
                part = [w for w in part if len(w) <= LONG]
                for w in long:
                    own = np.zeros((1, len(total)))
                    self.add([w], own)
                    total += own[0]
            if len(self) + len(part) > self.most:
                self.clear()
            if new := [w for w in dict.fromkeys(part) if w not in self]:
                self.learn(new)
            total += self.sums[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        return total


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """The model of docs(doc_id, text, lang) outside the held-out fold; null texts, langs and ids teach nothing."""

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(lang, *bag(t)) for lang, t in zip(b["lang"], b["text"], strict=True)]
            yield pd.DataFrame(out, columns=["lang", "rows", "counts"])

    rows = per_class_sample(docs.filter(~held_out(F.col("doc_id"))).filter("text is not null").select("doc_id", "text", "lang"), "lang", sample_docs, SAMPLE_ALL)
    got = sorted(tuple(r) for r in rows.mapInPandas(bags, "lang string, rows binary, counts binary").toLocalIterator() if r[1])
    return train([(np.frombuffer(r, np.uint16), np.frombuffer(n, np.uint32)) for _, r, n in got], [lang for lang, _, _ in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score and rejected, by the text alone. A null text or one without a letter is ``und`` with score 0; without
    a model so is every text. Columns of those names in the input are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        sums = WordSums(m.table) if m else None
        for b in batches:
            out = []
            for text in b["text"]:
                if m is None or not has_letter(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                s = sums.of(text.lower().split())
                p = _softmax(m.logits(s[:-1], s[-1]))
                k = int(p.argmax())
                out.append((m.langs[k], float(p[k]), bool(p[k] < m.reject_below)))
            yield pd.concat((b.drop(columns="text").reset_index(drop=True), pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])), axis=1)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(rows, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))
