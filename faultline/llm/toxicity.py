"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The model is fitted on a bounded, hash-chosen sample of ``EXAMPLES`` labelled rows. Every word of their texts is a feature,
however rare; document frequencies are counted over all documents, and a word weighs (1 + log count) * idf * (1 + chi-square
of its presence against the label in the sample). The texts become unit vectors, equal vectors are one example with its
counts of labels, and all are indexed: postings by word, in blocks of ``BLOCK`` examples, with the largest weight of each
block. A query adds the block maxima into bounds, scores the blocks of highest bound, and then every other block whose bound
reaches the k-th best cosine found, so its neighbours are exact. Their votes, weighted by squared cosine and shrunk
towards the rate of training rows, give the score; the neighbours are the evidence. Only texts without any word of an
example have no neighbours; they get the rate of training rows without words.

Null and empty texts have no word. Ties in cosine go to the earlier example (examples are ordered by their heaviest words).
Labels with a null id or class, and null texts, are not learned from; repeated rows are counted as often as they stand. Without
training rows every score is 0. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from faultline.llm import lexing
from faultline.session import settle

#: Documented bound of the model, in labelled rows; everything else covers all rows.
EXAMPLES = 4096
NEIGHBOURS = 15
BLOCK = 64
#: Blocks scored before the k-th cosine bounds the others.
FIRST_BLOCKS = 4
SHRINKAGE = 0.25
CACHED = 4096

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    """Counts of the words of a text: letters only, lower case."""
    return Counter(_WORDS.findall((text or "").lower()))


class Finder:
    """The known words of texts, by number; each distinct word is looked up once."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.lexicon = lexing.Lexicon(self._numbers)

    def _numbers(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = np.array([self.terms.get(name, -1) for name in names], np.int64)
        return found[found >= 0], (found >= 0).astype(np.int64)

    def counts(self, texts: list[str | None]):
        """For each text its known words in ascending order, and how often each stands in it."""
        lowered = pa.array([(t or "").lower() for t in texts], pa.large_string())
        width = max(1, len(self.terms))
        for lo, hi, data, offsets in lexing.blocks(lowered):
            points, own = lexing.code_points(data, offsets)
            starts, ends, first = lexing.letter_runs(points, own)
            numbers, lengths = self.lexicon.values(self.lexicon.look_up(points, starts, ends))
            at = np.concatenate([[0], np.cumsum(lengths)])[first]
            keys, n = np.unique(np.repeat(np.arange(hi - lo), np.diff(at)) * width + numbers, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(hi - lo + 1) * width)
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield keys[x:y] % width, n[x:y]


@dataclass
class Model:
    """Words with their factors (idf and chi-square), and the index of examples."""

    terms: dict[str, int]
    factor: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]  # (words, weights) of each example
    toxic: np.ndarray
    total: np.ndarray
    ids: np.ndarray  # the smallest document id of each example
    empty_rate: float
    rate: float

    def __post_init__(self):
        n, n_terms = len(self.vectors), len(self.terms)
        self.n_blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(n), np.array([len(v[0]) for v in self.vectors], np.int64))
        term = np.concatenate([v[0] for v in self.vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in self.vectors]) if n else np.zeros(0)
        # the inverted index: cells (word, block) in order, with their postings and the largest weight of each
        order = np.lexsort((owner, term))
        self.example, self.weight = owner[order], weight[order]
        cells, first = np.unique(term[order] * max(self.n_blocks, 1) + self.example // BLOCK, return_index=True)
        self.cell_at = np.append(first, len(order))
        self.block_of = cells % max(self.n_blocks, 1)
        self.block_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.word_at = np.searchsorted(cells // max(self.n_blocks, 1), np.arange(n_terms + 1))
        self.vectors, self.finder, self.cache = [], Finder(self.terms), {}

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and their unit weights (1 + log count) * factor."""
        weights = (1 + np.log(counts)) * self.factor[terms]
        norm = np.sqrt((weights ** 2).sum())
        return terms, weights / norm if norm > 0 else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine above 0, exactly; ties by example number."""
        lengths = self.word_at[terms + 1] - self.word_at[terms]
        cells, heavy = lexing.ragged(self.word_at[terms], lengths), np.repeat(weights, lengths)
        blocks = self.block_of[cells]
        bounds = np.bincount(blocks, heavy * self.block_most[cells], self.n_blocks)
        n_examples = self.n_blocks * BLOCK

        def score(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = chosen[blocks]
            at, size = self.cell_at[cells[own]], self.cell_at[cells[own] + 1] - self.cell_at[cells[own]]
            where = lexing.ragged(at, size)
            total = np.bincount(self.example[where], self.weight[where] * np.repeat(heavy[own], size), n_examples)
            hit = np.flatnonzero(total > 0)
            return hit, np.minimum(total[hit], 1.0)

        def best(found: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((found, -np.round(cosines, 12)))[:k]
            return found[order], cosines[order]

        chosen = np.zeros(self.n_blocks, bool)
        chosen[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        found, cosines = best(*score(chosen))
        # a bound equal to the k-th cosine may still hold an earlier example
        rest = ~chosen & (bounds > 0) & (bounds >= (cosines[k - 1] - 1e-9 if len(found) >= k else 0.0))
        if rest.any():
            more = score(rest)
            found, cosines = best(np.append(found, more[0]), np.append(cosines, more[1]))
        return found, cosines

    def scores(self, texts: list[str | None]):
        """For each text its score and the evidence: the neighbours with cosine and labels."""
        for terms, counts in self.finder.counts(texts):
            if not len(terms):
                yield self.empty_rate, []
                continue
            key = hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest()
            known = self.cache.get(key)
            if known is None:
                found, cosines = self.nearest(*self.unit(terms, counts))
                vote = cosines ** 2
                share = (self.toxic[found] + SHRINKAGE * self.rate) / (self.total[found] + SHRINKAGE)
                score = float(((vote * share).sum() + SHRINKAGE * self.rate) / (vote.sum() + SHRINKAGE))
                known = (score, [{"doc_id": int(self.ids[i]), "cosine": float(c), "toxic": int(self.toxic[i]), "rows": int(self.total[i])} for i, c in zip(found, cosines, strict=True)])
                if len(self.cache) < CACHED:
                    self.cache[key] = known
            yield known


def _class_counts(labelled: DataFrame) -> DataFrame:
    """Documents and toxic documents of each word; tasks add up runs of their rows first."""

    def run(batches):
        n, toxic = Counter(), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[t] for t in n], pa.int64())],
                                             names=["term", "n", "toxic"])
            n.clear()
            toxic.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                names = words(text.as_py()).keys()
                n.update(names)
                if label:
                    toxic.update(names)
                if len(n) > 300_000:
                    yield flush()
        yield flush()

    return labelled.select("text", "toxic").mapInArrow(run, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _frequencies(docs: DataFrame, terms: dict[str, int]) -> np.ndarray:
    """Over all documents, how many hold each known word; a task sends one row per word it met."""

    def run(batches):
        finder, total = Finder(terms), np.zeros(len(terms), np.int64)
        for batch in batches:
            for terms_, _ in finder.counts(batch.column("text").to_pylist()):
                total[terms_] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, seed: int = 11) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of the ``examples`` labels with the smallest hashes.

    So few rows by construction, they are sent to the documents instead of moving the texts.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = settle(usable.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "toxic").limit(examples), "labels")
    return docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, seed: int = 11) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of ``docs``; document frequencies come from all of ``docs``.

    The words and vectors of the ``examples`` chosen rows come to the driver.
    """
    labelled = settle(sample(docs, labels, examples, seed), "labelled", compression="zstd")
    sizes = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, toxic = int(sizes["n"]), int(sizes["toxic"])
    none = np.zeros(0, np.int64)
    if not n:
        return Model({}, np.zeros(0), [], none, none, none, 0.0, 0.0)
    met = _class_counts(labelled).orderBy("term").toArrow()
    terms = {t: i for i, t in enumerate(met["term"].to_pylist())}
    # chi-square of presence against the label, from the four counts
    a, both = met["toxic"].to_numpy().astype(float), met["n"].to_numpy().astype(float)
    b, c, d = both - a, toxic - a, (n - toxic) - (both - a)
    low = both * (n - both) * (a + c) * (b + d)
    chi = np.where(low > 0, n * (a * d - b * c) ** 2 / np.where(low > 0, low, 1.0), 0.0)
    idf = np.log((1 + docs.count()) / (1 + _frequencies(docs, terms))) + 1
    model = Model(terms, idf * (1 + chi), [], none, none, none, 0.0, toxic / n)

    def vectors(batches):
        for batch in batches:
            found = [model.unit(*x) for x in model.finder.counts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "terms", "weights"])

    source = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"), "text")
    groups = settle(source.mapInArrow(vectors, "doc_id long, toxic long, terms array<long>, weights array<double>")
                    .groupBy("terms", "weights").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "examples")
    empty = groups.filter(F.size("terms") == 0).agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).first()
    empty_rate = (float(empty["toxic"] or 0) + 0.5 * toxic / n) / (float(empty["n"] or 0) + 0.5)
    rows = groups.filter(F.size("terms") > 0).toArrow()
    vectors_ = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(rows["terms"], rows["weights"], strict=True)]
    # like examples share blocks, so that block maxima are tight
    order = sorted(range(len(vectors_)), key=lambda i: (vectors_[i][0][np.argsort(-vectors_[i][1], kind="stable")[:4]].tolist(), rows["doc_id"][i].as_py()))
    toxic_, total, ids = (rows[c].to_numpy()[order] for c in ("toxic", "n", "doc_id"))
    return Model(terms, model.factor, [vectors_[i] for i in order], toxic_, total, ids, empty_rate, toxic / n)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``evidence`` of each text."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the examples
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int64()), ("rows", pa.int64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            found = list(own.scores(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], evidence)],
                                             names=["key", "score", "evidence"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.LongType()), T.StructField("rows", T.LongType())])))])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)
