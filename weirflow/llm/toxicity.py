"""Toxicity: class-conditional Kneser-Ney models of word pairs, toxic and ordinary.

Each class has interpolated Kneser-Ney estimates: word pairs by the documents that hold them, words by their continuation counts (how
many different words they follow), then word stems, whose lowest order is shared: the words of both classes together that have a stem,
so an expression that is rare says little about either class. A text's evidence is the difference of the two log-likelihoods, normalised
by length: over the whole text, and over its few most toxic words, so that insults in a long text aren't averaged away. As the largest
of many words are larger by chance, the length counts too. A logistic curve fitted on documents that the counts haven't seen maps
these to a probability.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, stored
from .sampling import held_out, per_class_sample

#: The bound of the calibration: about so many labelled documents of each class, at most a third. All others count.
CALIBRATION_DOCS = 1_700
#: What is taken from events of 0, 1, 2, and 3 or more documents; single documents say little. Pairs of fewer
#: documents, counted over all of them, are discounted in full: they take the word's value (see REPLY_r01.md).
DISCOUNTS, PAIR_DOCS = (0, 0.9, 1.5, 2.0), 3
#: Words and word pairs that a task adds up before it hands them on.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 1_000_000
#: Labels are broadcast up to this number, 24 MB; beyond it they and the texts are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Answers that a ``Table`` keeps at hand.
RECENT = 100_000
#: The mean evidence of so many of a text's most toxic words, for each of these numbers.
TOP = (1, 2, 4, 8)
THRESHOLD = 0.3
RIDGE = 1.0
_PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>"


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(_PUNCTUATION))]


def stems(word: str) -> tuple[str, str]:
    """What a rare word backs off to, nearest first: its first six characters, then its first four."""
    return "6" + word[:6], "4" + word[:4]


class _Recent(dict):
    """The latest answers of a table, ``absent`` for keys that it hasn't. Emptied when full."""

    def __init__(self, table: Table):
        super().__init__()
        self.table = table

    def __missing__(self, key: str) -> float | None:
        if len(self) >= RECENT:
            self.clear()
        at = self.table.find(key)
        self[key] = found = self.table.absent if at is None else self.table.values[at].item()
        return found


class Table(Mapping):
    """Text -> number in a few arrays, about 30 bytes a key, not the 200 of a dict: the keys' UTF-8 in one buffer, found by their sorted
    hashes, then compared. ``values`` are in the order of ``keys``, which differ; ``absent`` stands for other keys in ``of`` and ``get``."""

    def __init__(self, keys: Iterable[str], values: np.ndarray | None = None, absent: float | None = None):
        self.text, ends, hashes = bytearray(), array("q", [0]), array("Q")
        for key in keys:
            self.text += (raw := key.encode())
            ends.append(len(self.text))
            hashes.append(xxhash.xxh64_intdigest(raw))
        self.ends, hashes = np.asarray(ends, np.int64), np.asarray(hashes, np.uint64)
        self.order = np.argsort(hashes).astype(np.uint32)
        self.hashes = hashes[self.order]
        self.values, self.absent, self.recent = values, absent, _Recent(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "recent"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, recent=_Recent(self))

    def key(self, at: int) -> bytes:
        return bytes(self.text[self.ends[at] : self.ends[at + 1]])

    def find(self, key: str) -> int | None:
        """The place of a key."""
        raw = key.encode()
        h = np.uint64(xxhash.xxh64_intdigest(raw))
        k = int(self.hashes.searchsorted(h))
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.key(at := int(self.order[k])) == raw:
                return at
            k += 1
        return None

    def _look_up(self, keys: list[str]) -> None:
        """Puts keys at hand, all with one search."""
        raws = [key.encode() for key in keys]
        h = np.fromiter(map(xxhash.xxh64_intdigest, raws), np.uint64, len(raws))
        at = np.minimum(self.hashes.searchsorted(h), len(self) - 1)
        place = self.order[at].astype(np.int64)
        for key, raw, known, start, end, value in zip(keys, raws, (self.hashes[at] == h).tolist(), self.ends[place].tolist(), self.ends[place + 1].tolist(), self.values[place].tolist(), strict=True):
            if not known:
                self.recent[key] = self.absent
            elif self.text[start:end] == raw:
                self.recent[key] = value
            else:
                self.recent[key]  # another key has its hash: compares all that have

    def of(self, keys: list[str]) -> np.ndarray:
        if len(self):
            new = {key for key in keys if key not in self.recent}
            if len(self.recent) + len(new) > RECENT:
                self.recent.clear()
                new = set(keys)
            self._look_up(list(new))
        return np.fromiter(map(self.recent.__getitem__, keys), self.values.dtype, len(keys))

    def get(self, key: str, default: float | None = None) -> float | None:
        found = self.recent[key]
        return default if found is self.absent else found

    def __getitem__(self, key: str) -> float:
        if (at := self.find(key)) is None:
            raise KeyError(key)
        return self.values[at].item()

    def __iter__(self) -> Iterator[str]:
        return (self.key(k).decode() for k in range(len(self)))

    def __len__(self) -> int:
        return len(self.hashes)


def _table(d: Mapping, dtype: type, absent: float | None) -> Table:
    return d if isinstance(d, Table) else Table(d, np.fromiter(d.values(), dtype, len(d)), absent)


class Model:
    """Log-likelihood differences of known pairs (``keys``, ``values``), words and stems."""

    def __init__(self, words: Mapping[str, int], word_values: np.ndarray, stem_values: Mapping[str, float], keys: np.ndarray, values: np.ndarray):
        self.words, self.stem_values = _table(words, np.int64, 0), _table(stem_values, np.float64, None)
        self.word_values, self.keys, self.values = word_values, keys, values
        k = 2 + len(TOP)
        self.weights, self.center, self.scale = np.zeros(k + 1), np.zeros(k), np.ones(k)

    def unseen(self, word: str) -> float:
        for s in stems(word):
            if (v := self.stem_values.get(s)) is not None:
                return v
        return 0.0

    def evidence(self, words: list[str]) -> np.ndarray:
        """Each word's log P(word | word before, toxic) - log P(word | word before, ordinary)."""
        ids = self.words.of(words)
        out = self.word_values[ids]
        for k in np.flatnonzero(ids == 0).tolist():
            out[k] = self.unseen(words[k])
        if len(ids) > 1 and len(self.keys):
            pair = ids[:-1] * len(self.word_values) + ids[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == pair
            out[1:][known] = self.values[at[known]]
        return out

    def features(self, words: list[str]) -> np.ndarray:
        """The mean evidence, that of the ``TOP`` most toxic words (those that a shorter text lacks have none), and the logarithm of the
        length; zeros for a text without words."""
        e = self.evidence(words)
        if not len(e):
            return np.zeros(2 + len(TOP))
        most = np.sort(np.partition(e, -TOP[-1])[-TOP[-1] :] if len(e) > TOP[-1] else e)[::-1]
        return np.asarray([e.mean(), *(most[:k].sum() / k for k in TOP), math.log(len(e))])

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _level(n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both classes' probabilities of one order's events, from counts (events, 2) discounted in favour of a lower order, and the share
    that each class gives to it."""
    less = np.minimum(n, np.asarray(DISCOUNTS)[np.minimum(n, 3)])
    total = np.maximum(1, n.sum(axis=0))
    spare = np.where(n.any(axis=0), less.sum(axis=0) / total, 1.0)
    return (n - less) / total + spare * lower, spare


def _summed(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of the rows of ``n`` that have the same code."""
    return np.column_stack([np.bincount(codes, n[:, c]).astype(np.int64) for c in (0, 1)])


@dataclass
class Events:
    """``ids``: each word's number, from 1, those of most texts first (0: no word of these); ``n``: in how many ordinary and toxic texts they occur, by number;
    ``pairs``(v, w, n0, n1): in how many word w follows word v, by their numbers, a stored table."""

    ids: Table
    n: np.ndarray
    pairs: DataFrame


def _numbers(df: DataFrame, dtype: type) -> Iterator[np.ndarray]:
    """The rows of a DataFrame of numbers, packed by the tasks, as arrays."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rows": [b.to_numpy(dtype).tobytes()]})

    for r in df.mapInPandas(packed, "rows binary").toLocalIterator():
        yield np.frombuffer(r[0], dtype).reshape(-1, len(df.columns))


def counted(docs: DataFrame) -> Events:
    """The events of docs(text, toxic).

    Events count once a document, and a text that is repeated counts once, so copies aren't evidence."""

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [" ".join(words_of(t)) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "same": [xxhash.xxh3_128_digest(t) for t in texts], "words": texts})

    def word_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pd.DataFrame:
            rows = [(w, held[0][w], held[1][w]) for w in held[0].keys() | held[1].keys()]
            for c in held:
                c.clear()
            return pd.DataFrame(rows, columns=["w", "n0", "n1"])

        for b in batches:
            for toxic, text in zip(b["toxic"], b["words"], strict=True):
                held[toxic].update(set(text.split()))
                if len(held[0]) + len(held[1]) > WORDS_AT_ONCE:
                    yield out()
        yield out()

    def pair_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = shared.value
        held: tuple[list, list] = ([], [])

        def out() -> pd.DataFrame:
            found = [np.unique(np.concatenate(c), return_counts=True) if c else (np.empty(0, np.int64),) * 2 for c in held]
            for c in held:
                c.clear()
            return pd.DataFrame({"pair": np.concatenate([k for k, _ in found]), "n": np.concatenate([found[0][1], found[1][1] << 32])})

        size = 0
        for b in batches:
            for toxic, text in zip(b["toxic"], b["words"], strict=True):
                words = text.split()
                at = ids.of(words)
                held[toxic].append(np.unique(at[:-1] << 32 | at[1:]))
                size += len(held[toxic][-1])
                if size > PAIRS_AT_ONCE:
                    yield out()
                    size = 0
        yield out()

    texts = stored(docs.select("toxic", "text").mapInPandas(tokenised, "toxic int, same binary, words string").dropDuplicates(["toxic", "same"]).select("toxic", "words"), "toxicity-texts")
    words = stored(texts.mapInPandas(word_events, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-words")
    found = array("i")

    def known() -> Iterator[str]:
        for w, *n in words.toLocalIterator():
            found.extend(n)
            yield w

    ids = Table(known(), absent=0)
    n = np.asarray(found, np.int32).reshape(-1, 2)
    order = np.argsort(-n.sum(axis=1), kind="stable")
    ids.values = np.empty(len(ids), np.int64)
    ids.values[order] = np.arange(1, len(ids) + 1)
    # pairs move as numbers: those of two words, and both classes' counts in one long
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    high = lambda c: F.shiftright(c, 32).cast("int")
    pairs = texts.mapInPandas(pair_events, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.select(high("pair").alias("v"), low("pair").alias("w"), low("n").alias("n0"), high("n").alias("n1")), "toxicity-pairs")
    discard(texts, words)
    shared.destroy()
    return Events(ids, n[order], pairs)


def kneser_ney(events: Events) -> Model | None:
    """The models of ``counted`` events, without calibration: pair -> word (continuation counts) -> stems -> words of both classes by
    stem. Pairs come to the driver as packed numbers. None without words of both classes."""
    ids, pairs = events.ids, events.pairs
    if not events.n.any(axis=0).all():
        return None
    # how many different words a word follows; the start of a text counts only for words found nowhere else
    word_n = np.minimum(events.n, 1).astype(np.int64)
    follows = pairs.groupBy("w").agg(*[F.sum((F.col(c) > 0).cast("int")).alias(c) for c in ("n0", "n1")])
    for own in _numbers(follows, np.int32):
        at = own[:, 0] - 1
        word_n[at] = np.maximum(word_n[at], own[:, 1:])
    codes: dict[str, int] = {}
    of6 = np.empty(len(ids), np.int32)
    of6[ids.values - 1] = np.fromiter((codes.setdefault(stems(w)[0], len(codes)) for w in ids), np.int32, len(ids))
    names6, codes = list(codes), {}
    of4 = np.fromiter((codes.setdefault(stems(s[1:])[1], len(codes)) for s in names6), np.int32, len(names6))
    names4 = list(codes)
    kinds6 = np.bincount(of6)  # the words of both classes that have a stem
    kinds4 = np.bincount(of4, kinds6)
    stem6_n = _summed(of6, word_n)
    p4, _ = _level(_summed(of4, stem6_n), (kinds4 / len(ids))[:, None])
    p6, spare6 = _level(stem6_n, p4[of4] * (kinds6 / kinds4[of4])[:, None])
    word_p, spare = _level(word_n, (p6 / kinds6[:, None])[of6])
    ratio = lambda p: np.log(p[..., 1] / p[..., 0])
    stem_values = Table([*names6, *names4], np.concatenate((ratio(p6) + ratio(spare), ratio(p4) + ratio(spare) + ratio(spare6))))
    word_p = np.concatenate((np.ones((1, 2)), word_p))
    values = ratio(word_p)
    del codes, of6, of4, names6, names4, word_n
    # every pair counts for its context; only those that have a value of their own come here
    less = {c: F.least(F.col(c).cast("double"), F.when(F.col(c) >= 3, DISCOUNTS[3]).when(F.col(c) == 2, DISCOUNTS[2]).when(F.col(c) == 1, DISCOUNTS[1]).otherwise(0.0)) for c in ("n0", "n1")}
    of = pairs.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.sum(less["n0"]).alias("s0"), F.sum(less["n1"]).alias("s1"))
    n = len(values)
    sums = np.zeros((n, 4))
    for own in _numbers(of, np.float64):
        sums[own[:, 0].astype(np.int64)] = own[:, 1:]
    taken = np.asarray(DISCOUNTS)
    keys, pair_values = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    for rows in _numbers(pairs.filter(F.col("n0") + F.col("n1") >= PAIR_DOCS), np.int32):
        v, w, *own = rows.T
        p = []
        for c in (0, 1):
            less_own = np.minimum(own[c], taken[np.minimum(own[c], 3)])
            context, spared = sums[v, c], sums[v, 2 + c]
            p.append(np.where(context > 0, (own[c] - less_own + spared * word_p[w, c]) / np.maximum(context, 1), word_p[w, c]))
        keys.append(v.astype(np.int64) * n + w)
        pair_values.append(np.log(p[1] / p[0]).astype(np.float32))
    del sums, word_p
    keys, pair_values = np.concatenate(keys), np.concatenate(pair_values)
    order = np.argsort(keys)
    return Model(ids, values, stem_values, keys[order], pair_values[order])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, prior: float) -> None:
    """Logistic regression on the features of texts that the counts haven't seen, weighted to the share ``prior`` of toxic documents. The
    ``TOP`` features go together, so the ridge is wide enough to share the weight between them."""
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack(((x - model.center) / model.scale, np.ones(len(x))))
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + RIDGE * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
        change = np.linalg.solve(h, g)
        w -= change
        if np.abs(change).max() < 1e-6:
            break
    model.weights = w


def learn(docs: DataFrame, labels: DataFrame, calibration_docs: int = CALIBRATION_DOCS) -> Model | None:
    """The model of labelled documents outside the held-out fold: a bounded sample, at most a third, calibrates, and all others count.
    A document with both labels counts as toxic. None without documents of both classes in both parts."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).filter("toxic in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    third = known.filter(F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(3)) == 2)
    chosen = stored(per_class_sample(third, "toxic", calibration_docs), "calibration")
    texts = docs.filter("text is not null").select("doc_id", "text")
    rest = stored(known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti"), "toxicity-labels")
    events = counted(texts.join(F.broadcast(rest) if rest.count() <= BROADCAST_LABELS else rest, "doc_id"))
    discard(rest)
    model = kneser_ney(events)
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [shared.value.features(words_of(t)).tolist() for t in b["text"]]})

    rows = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInPandas(features, "toxic int, x array<double>").collect()
    shared.destroy()
    discard(events.pairs, chosen)
    if {r[0] for r in rows} != {0, 1}:
        return None
    rows = sorted((r[0], r[1]) for r in rows)
    calibrate(model, np.asarray([x for _, x in rows]), np.asarray([y for y, _ in rows], float), prior=counts[1] / sum(counts.values()))
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, by the text alone. Null and empty texts have no evidence and get the score of
    a text with none; without a model every score is 0. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            if not len(b):
                continue
            p = m.probability(np.stack([m.features(words_of(t or "")) for t in b["text"]])) if m else np.zeros(len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(rows, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
