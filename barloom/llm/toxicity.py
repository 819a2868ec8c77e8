"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled documents gives the examples; all their words are terms. How many documents hold a term,
for IDF, is counted over the whole corpus. A term's IDF is multiplied by its relevance: 1 less the share of its
chi-square with the label that chance explains, at least FLOOR; so words that go with a label (toxic or clean) weigh
most, and all others still count. The examples' unit vectors go to a block-max inverted index: postings by term, in
blocks of example numbers. A common term's postings are an array of all examples, multiplied for many texts at once;
those of a term with fewer postings than blocks are added up as they are; of any other term the largest weight in each
block is kept. A document's weights times these give every block's bound; blocks are scored in falling order of bound
until none can reach the k-th best cosine, so the k nearest examples are exact. They vote with their cosine as weight;
isotonic regression on votes that leave the example itself out turns a vote into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice, repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, rows_of, text_batches, thrifty

#: Labelled documents learned from, the only bound on what is learned: of each label those with the least hashed ids. Neighbours that vote.
EXAMPLES, NEIGHBOURS = 4000, 25
#: Chi-square that chance explains. Relevance of a term that goes with no label.
CHANCE, FLOOR = 15.0, 0.05
#: Examples in a block. A term in more than one of so many examples has its postings as an array with every example.
BLOCK, COMMON = 128, 16
#: Texts whose common terms are multiplied at once. Always so many rows, so that a text's figures do not depend on how many come with it.
TOGETHER = 64
#: Weight of the prior in a vote.
PRIOR_WEIGHT = 0.25
#: Each label gets this part of the examples at least, if it has as many rows.
LEAST_PART = 0.1
THRESHOLD = 0.7
TINY = np.nextafter(0.0, 1.0)
_WORDS = re.compile(r"\w+").findall
#: Of ASCII characters: those of words in lower case, a space for any other.
_ASCII = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in map(chr, range(128)))


@cache
def _units() -> np.ndarray:
    """Of UTF-16 units: those of words as they are, a space for any other."""
    return np.array([c if chr(c).isalnum() or chr(c) == "_" else 32 for c in range(1 << 16)], np.uint16)


def words_of(text: str | None) -> list[str]:
    """Runs of word characters in lower case; only texts beyond Unicode's first plane need the pattern for that."""
    if not text:
        return []
    if text.isascii():
        return text.translate(_ASCII).split()
    text = text.lower()
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return _units()[units].astype("<u2", copy=False).tobytes().decode("utf-16-le").split() if len(units) == len(text) else _WORDS(text)


def word_counts(text: str | None) -> Counter:
    return Counter(words_of(text))


class Vocabulary(dict):
    """Number of each term; counts those of a text."""

    def __init__(self, terms=()):
        super().__init__((t, i) for i, t in enumerate(terms))

    def __reduce__(self):
        return Vocabulary, (list(self),)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, how often each occurs in the whole text, how often each word that is no term does)."""
        found = word_counts(text)
        terms = np.fromiter(map(self.get, found, repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), float, len(found))
        known = terms >= 0
        return terms[known], counts[known], counts[~known]


def _listed(batches):
    """(term, toxic documents that hold it, others) of a task's share of the bounded sample."""
    import pyarrow as pa

    held: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for toxic, text in rows_of(batch, "toxic", "text"):
            held[toxic > 0].update(set(words_of(text)))
    terms = list(held[0] | held[1])
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], ["term", "a", "b"])


def _holding(shared):
    """(term, documents that hold it) for the documents of a task; -1 counts them all."""

    def run(batches):
        import pyarrow as pa

        wanted = shared.value
        held, n = np.zeros(len(wanted) + 1, np.int64), 0  # the last one: words that are no term
        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                n += 1
                words = set(words_of(text))
                held[np.fromiter(map(wanted.get, words, repeat(-1)), np.int64, len(words))] += 1
        found = np.flatnonzero(held[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, found), pa.int32()), pa.array(np.append(n, held[found]), pa.int64())], ["term", "n"])

    return run


def shares(positives: int, negatives: int, examples: int) -> tuple[int, int]:
    """How many examples of either label are drawn: in proportion, but LEAST_PART of the rarer at least."""
    if positives + negatives <= examples:
        return positives, negatives
    least = int(LEAST_PART * examples)
    drawn = round(examples * positives / (positives + negatives))
    drawn = min(positives, max(drawn, min(least, positives), examples - negatives))
    drawn = max(examples - negatives, min(drawn, examples - min(least, negatives)))
    return drawn, min(negatives, examples - drawn)


def relevance(a: np.ndarray, b: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """FLOOR to 1 for terms that ``a`` of the positive and ``b`` of the negative examples hold."""
    p, q = float(positives), float(negatives)
    diff = a * (q - b) - b * (p - a)
    below = (a + b) * (p + q - a - b) * p * q
    chi = np.divide(diff * diff * (p + q), below, out=np.zeros(len(a)), where=below > 0)
    return FLOOR + (1 - FLOOR) * np.maximum(0.0, 1 - np.divide(CHANCE, chi, out=np.full(len(a), np.inf), where=chi > 0))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + size[i] - 1, for one i after another."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - before, size)


@dataclass
class Neighbours:
    """Block-max inverted index of the examples' unit vectors."""

    weight_of: np.ndarray  # of terms: IDF times relevance
    unknown: float  # of a word that is no term
    labels: np.ndarray
    row: np.ndarray  # [term]: of a common one its number among those, else -1
    common: np.ndarray  # [common term, example]: weights, up to whole blocks
    bounded: np.ndarray  # [term]: of one that is not common and has a posting for each block at least its number among those, else -1
    most: np.ndarray  # [bounded term, block]: largest weight
    cut: np.ndarray  # [bounded term, block]: where its postings begin; at the end where they end
    begin: np.ndarray  # [term]: where its postings begin
    examples: np.ndarray  # of postings, by term, then example
    weights: np.ndarray
    prior: float
    lift: tuple[float, float] = (1.0, 1.0)  # labelled rows that an example of label 0, of label 1 stands for
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    @classmethod
    def build(cls, vectors: list[tuple[list[int], list[int]]], labels: list[int], weight_of: np.ndarray, unknown: float, prior: float, lift: tuple[float, float] = (1.0, 1.0)) -> Neighbours:
        term, example, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, (terms, counts) in enumerate(vectors):
            term.append(np.array(terms, np.int64))
            example.append(np.full(len(terms), k))
            weight.append(unit(term[-1], counts, weight_of))
        term, example, weight = map(np.concatenate, (term, example, weight))
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        blocks = max(1, -(-len(vectors) // BLOCK))
        row = np.full(len(weight_of), -1)
        often = np.flatnonzero(np.bincount(term, minlength=len(weight_of)) * COMMON > len(vectors))
        row[often] = np.arange(len(often))
        common = np.zeros((len(often), blocks * BLOCK))
        here = row[term] >= 0
        common[row[term[here]], example[here]] = weight[here]
        term, example, weight = term[~here], example[~here], weight[~here]
        begin = np.searchsorted(term, np.arange(len(weight_of) + 1))
        many = np.flatnonzero(np.diff(begin) >= blocks)
        bounded = np.full(len(weight_of), -1)
        bounded[many] = np.arange(len(many))
        cut = np.searchsorted(term * blocks + example // BLOCK, many[:, None] * blocks + np.arange(blocks + 1))
        most = np.zeros((len(many), blocks))
        here = bounded[term] >= 0
        np.maximum.at(most, (bounded[term[here]], example[here] // BLOCK), weight[here])
        return cls(weight_of, unknown, np.array(labels, float), row, common, bounded, most, cut, begin, example.astype(np.int32), weight, prior, lift)

    def nearest(self, terms, counts, others=(), k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, ties to the smaller number.

        Words that are no term (``others``: their counts) count in the document's length only.
        """
        return next(self.each_nearest([(terms, counts, others)], k, [without]))

    def each_nearest(self, texts: Iterable[tuple], k: int = NEIGHBOURS, without: Iterable[int] = repeat(-1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``nearest`` gives for each (terms, counts, others), TOGETHER of them at a time."""
        texts, without = iter(texts), iter(without)
        while True:
            rare, weight = [], np.zeros((TOGETHER, len(self.common)))
            for n, (terms, counts, others) in enumerate(islice(texts, TOGETHER)):
                t = np.asarray(terms, np.int64)
                q = unit(t, counts, self.weight_of, others, self.unknown)
                row = self.row[t]
                often = row >= 0
                weight[n, row[often]] = q[often]
                rare.append((t[~often], q[~often]))
            if not rare:
                return
            for part, (t, q) in zip(weight @ self.common, rare):  # noqa: B905
                yield self._best(part, t, q, k, next(without))

    def _best(self, part: np.ndarray, t: np.ndarray, q: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """``part``: every example's share of the cosine from common terms; t, q: the other terms and their weights."""
        # terms of few postings: exact at once, too; the others: bounded by what they weigh most in a block
        row = self.bounded[t]
        few = row < 0
        begin = self.begin[t[few]]
        part = (part + self._sum(begin, self.begin[t[few] + 1] - begin, q[few], len(part))).reshape(-1, BLOCK)
        row, q = row[~few], q[~few]
        bound = part.max(1) + q @ self.most[row]
        cut = self.cut[row]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score = np.zeros(part.shape)
        flat = score.reshape(-1)
        done, step, least = 0, max(1, len(bound) // 4), 0.0
        hit = order[:0]
        while True:
            # the next blocks that may still reach the k-th best, four times as many each time; neighbours in one go
            some = order[done : done + step]
            some = some[bound[some] >= least - 1e-11]
            if not len(some):
                break
            chosen = np.zeros(len(bound) + 2, np.int8)
            chosen[some + 1] = 1
            edge = np.flatnonzero(np.diff(chosen))
            begin = cut[:, edge[::2]]
            score[some] = part[some]
            flat += self._sum(begin.ravel(), (cut[:, edge[1::2]] - begin).ravel(), np.repeat(q, len(edge) // 2), len(flat))
            done, step = done + step, 4 * step
            if without >= 0:
                flat[without] = 0
            hit = np.flatnonzero(flat >= max(least - 1e-11, TINY))
            if len(hit) > k:
                least = np.partition(flat[hit], len(hit) - k)[len(hit) - k]
        hit = hit[flat[hit] >= least - 1e-11]
        best = hit[np.lexsort((hit, -np.round(flat[hit], 12)))[:k]]
        return best, np.minimum(flat[best], 1.0)

    def _sum(self, begin: np.ndarray, size: np.ndarray, weight: np.ndarray, examples: int) -> np.ndarray:
        """By example: weights of the postings begin[i] .. begin[i] + size[i] - 1, times weight[i], added up."""
        at = _spread(begin, size)
        return np.bincount(self.examples[at], np.repeat(weight, size) * self.weights[at], examples)

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines * np.where(self.labels[ids] > 0, self.lift[1], self.lift[0])
        return float((w @ self.labels[ids] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic regression of labels on the examples' votes without themselves, by pooling adjacent violators."""
        pools: list[list[float]] = []  # vote sum, label sum, size
        for v, y in sorted(zip(votes.tolist(), self.labels.tolist(), strict=True)):
            n = self.lift[int(y > 0)]
            pools.append([v * n, y * n, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.knots = np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def calibrated(vote: float, knots: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability that a vote stands for: between the means of two pools it rises in a line."""
    return float(np.interp(vote, *knots)) if len(knots[0]) else vote


def unit(terms: np.ndarray, counts, weight_of: np.ndarray, others=(), unknown: float = 0.0) -> np.ndarray:
    w = (1 + np.log(np.asarray(counts, float))) * weight_of[terms]
    length = (w**2).sum()
    if len(others):
        length += (((1 + np.log(np.asarray(others, float))) * unknown) ** 2).sum()
    return w / np.sqrt(length) if length else w


def _company(terms, name: np.ndarray, telling: np.ndarray, holders: np.ndarray) -> tuple[int, int]:
    """Examples in this order stand near their like: by their most telling term, then by their most common one.

    ``name``: of terms, their place in alphabetical order.
    """
    t = np.asarray(terms, np.int64)
    if not len(t):
        return -1, -1
    t = t[np.argsort(name[t])]
    best = int(t[np.argmax(telling[t])])
    return int(name[best]) if telling[best] > 2 * FLOOR else -1, int(name[t[np.argmax(holders[t])]])


@dataclass
class Model:
    wanted: Vocabulary
    ids: list
    index: Neighbours
    #: (wanted, index without calibration) on all executors; None where nothing was learned
    shared: Broadcast | None = None

    def judge(self):
        """A function of (texts, neighbours) for tasks: (score, nearest examples) of each. It takes only the calibration along."""
        knots, shared = self.index.knots, self.shared
        if shared is None:
            plain = self.index
            return lambda texts, neighbours: ((plain.prior, np.zeros(0, np.int64)) for _ in texts)

        def run(texts: Iterable[str | None], neighbours: int) -> Iterator[tuple[float, np.ndarray]]:
            wanted, index = shared.value
            for near, cosines in index.each_nearest(map(wanted.counts, texts), neighbours):
                yield calibrated(index.vote(near, cosines), knots), near

        return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Model:
    """Learns from the rows of ``labels``; pass only those that may be learned from.

    The driver gets the words of at most ``examples`` texts. Null labels and ids are left out; of an id with several
    labels the largest counts, of one with several texts the least. Without labels of both kinds, or in an empty
    table, every score is the prior.
    """
    spark = docs.sparkSession
    text_batches(spark)
    work = Scratch(spark, "toxicity")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    # labels without a document teach nothing: they are neither drawn nor counted
    known = known.join(slim.select("id"), "id", "left_semi")
    sizes = dict(known.groupBy((F.col("toxic") > 0).alias("t")).count().collect())
    drawn = shares(sizes.get(True, 0), sizes.get(False, 0), examples)
    nearest = lambda toxic, n: known.where((F.col("toxic") > 0) == toxic).orderBy(F.xxhash64("id"), "id").limit(n).collect()
    picked = nearest(True, drawn[0]) + nearest(False, drawn[1])
    chosen = spark.createDataFrame([(r["id"], r["toxic"]) for r in picked], T.StructType([slim.schema["id"], T.StructField("toxic", T.IntegerType())]))
    # bounded by ``examples``
    sample = work.save(slim.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")), "sample")
    toxic = {r["id"]: int(r["toxic"] > 0) for r in picked}
    positives, negatives = sum(toxic.values()), len(toxic) - sum(toxic.values())
    prior = (sizes.get(True, 0) + 1) / (sum(sizes.values()) + 2)
    # a label drawn beyond its share counts less in votes and calibration; relative to the mean, 1 in proportion
    mean = sum(sizes.values()) / max(1, len(toxic))
    lift = tuple(sizes.get(t, 0) / n / mean if n else 1.0 for t, n in ((False, drawn[1]), (True, drawn[0])))

    if not (positives and negatives):
        return Model(Vocabulary(), [], Neighbours.build([], [], np.zeros(0), 0.0, prior))
    listed = sample.select("toxic", "text").mapInArrow(thrifty(_listed), "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow().sort_by("term")
    a, b = (listed.column(c).to_numpy().astype(float) for c in ("a", "b"))
    # terms that many examples hold come first, so that what is looked up most lies together in memory
    name = np.argsort(-(a + b), kind="stable")
    wanted, a, b = Vocabulary(listed.column("term").take(name).to_pylist()), a[name], b[name]
    del listed
    vocabulary = spark.sparkContext.broadcast(wanted)
    held = slim.select("text").mapInArrow(thrifty(_holding(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    vocabulary.destroy()
    count = np.zeros(len(wanted) + 1)  # the last one: all documents
    count[held.column("term").to_numpy()] = held.column("n").to_numpy()
    del held
    idf = np.log((1 + count[-1]) / (1 + count[:-1])) + 1
    telling = relevance(a, b, positives, negatives)

    rows = [(r["id"], *wanted.counts(r["text"])[:2]) for r in sample.select("id", "text").toLocalIterator()]
    rows = sorted(rows, key=lambda r: (_company(r[1], name, telling, a + b), r[0]))
    ids = [r[0] for r in rows]
    index = Neighbours.build([r[1:] for r in rows], [toxic[i] for i in ids], idf * telling, float(np.log(1 + count[-1]) + 1) * FLOOR, prior, lift)
    del rows
    shared = spark.sparkContext.broadcast((wanted, index))
    numbers = {key: k for k, key in enumerate(ids)}

    def left_out(batches):
        import pyarrow as pa

        terms, examples = shared.value
        for batch in batches:
            at = [numbers[key] for key in batch.column(0).to_pylist()]
            texts = (terms.counts(text) for (text,) in rows_of(batch, "text"))
            votes = [examples.vote(*found) for found in examples.each_nearest(texts, neighbours, at)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(votes, pa.float64())], ["k", "vote"])

    spread = sample.select("id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "id")
    found = dict(spread.mapInArrow(thrifty(left_out), "k int, vote double").collect())
    index.calibrate(np.array([found[k] for k in range(len(ids))]))
    work.drop("sample")
    return Model(wanted, ids, index, shared)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD, evidence: int = 3) -> DataFrame:
    """One row for each row of docs: id, score, predicted, evidence (ids of its nearest examples, nearest first).

    A null or empty text holds no term and scores what texts without evidence do. Texts are read whole. Shuffles
    nothing; the model, bounded by its parameters, travels with the tasks. Repeated rows, and rows of one id with
    different texts, get each its own result; other columns are not read.
    """
    text_batches(docs.sparkSession)
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(id_type))])
    judge, names = model.judge(), model.ids

    def run(batches):
        for batch in batches:
            scores, near = [], []
            for found, ids in judge((text for (text,) in rows_of(batch, text_col)), neighbours):
                scores.append(found)
                near.append([names[i] for i in ids[:evidence]])
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(near, pa.list_(kind))], [id_col, "score", "predicted", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)


def clean(docs: DataFrame, model: Model, text_col: str = "text", neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; nothing is joined or shuffled."""
    text_batches(docs.sparkSession)
    import pyarrow as pa

    judge = model.judge()

    def run(batches):
        for batch in batches:
            texts = (text for (text,) in rows_of(batch, text_col))
            yield batch.filter(pa.array([found < threshold for found, _ in judge(texts, neighbours)], pa.bool_()))

    return docs.mapInArrow(thrifty(run), docs.schema)


def may_learn(doc_id):
    """Rows of the training folds: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
