"""Language-model scores from a log-bilinear neural model, trained with noise-contrastive estimation.

A context is the three tokens before a token: their vectors, weighted by position number by number, add up to one
vector, and a token's score is its product with the token's own vector plus an offset. The softmax has two levels:
classes of tokens that end alike, then the tokens of a class. Tokens with enough counts have vectors of their own,
as contexts and as targets; the count asked for grows with the square root of the corpus, so the vocabulary grows
with it. The tail falls into classes by its endings, inside which a token has its smoothed share of the counts.

Map tasks train: each runs stochastic gradient steps in numpy over every position of its own texts, with noise drawn from
the unigram, and the tasks' changes are averaged row by row, for a fixed number of rounds that share the texts out. Scores are normalised on both levels
by batched matrix products. Token counts cover all training texts; those of frequent tokens are broadcast in a
table of bounded size, those of the rest are joined. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, id_and_text, materialize, pieces, raw_bytes
from .language_id import held_out
from .pretokens import LOWER, Grown, Places, hashes, spans, words

#: The end of a text as a token, by a key of its own.
END = np.uint64(1)
#: Tokens whose counts are broadcast, of these tokens with vectors at most, and numbers in a vector.
FREQUENT, VECTORS, WIDTH = 300_000, 131_072, 16
#: Context positions, and classes of tail tokens.
POSITIONS, TAILS = 3, 64
#: A token has a vector from this many counts, and from the square root of all counts divided by that.
LEAST, ROOT_SHARE = 5, 25
#: Rounds (every position of every training text is learned from in one of them), positions in a step, learning rate.
ROUNDS, STEP, RATE = 2, 2048, 0.1
#: Noise classes for a step, noise tokens for a position.
NOISE_CLASSES, NOISE_TOKENS = 32, 3
#: Distinct tokens that a map task counts before it hands them on.
HELD = 500_000
ALPHA = 0.1
#: Texts, and bytes of them, that are scored together; tokens whose scores are worked out together.
ROWS, SIZE = 512, 1 << 20
BLOCK = 512


@dataclass
class Tokens:
    """The tokens of some texts, one after the other, each text's end included."""

    keys: np.ndarray
    endings: np.ndarray
    owner: np.ndarray
    #: Where each token's text begins.
    begin: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    """Words in lower case (A-Z), parted by ASCII white space, and an end; endings are the last four bytes, the last one first."""
    keys, endings, owners = [], [], []
    for numbers, raw, begins in spans(texts):
        a, starts, ends = words(raw.translate(LOWER))
        keys.append(hashes(a, starts, ends))
        owners.append(numbers[np.searchsorted(begins, starts, "right") - 1])
        last = np.zeros(len(starts), np.int64)
        for k in range(1, 5):
            last = last << 8 | np.where(ends - k >= starts, a[np.maximum(ends - k, 0)], 0)
        endings.append(last)
    owner = np.concatenate([*owners, np.empty(0, np.int64)]).astype(np.int64)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    upto = np.cumsum(sizes)
    out = Tokens(np.full(upto[-1] if len(upto) else 0, END, np.uint64), np.zeros(upto[-1] if len(upto) else 0, np.int64), np.repeat(np.arange(len(texts)), sizes), np.repeat(upto - sizes, sizes))
    at = np.arange(len(owner)) + owner  # every text before a token's adds an end
    out.keys[at] = np.concatenate([*keys, np.empty(0, np.uint64)])
    out.endings[at] = np.concatenate([*endings, np.empty(0, np.int64)])
    return out


def tail_class(endings):
    """A class of tail tokens by their last two bytes."""
    return ((endings >> 16) * 40503 >> 5) % TAILS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("counts")

    def fresh():
        return Places(), Grown(np.uint64), Grown(np.int64), Grown(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[:].view(np.int64)), pa.array(endings[:]), pa.array(counts[:])], names=["key", "ending", "c"])

    places, keys, endings, counts = fresh()
    for part in pieces(batches, ROWS, SIZE):
        t = tokens_of(raw_bytes(part.column(1)))
        found, first, c = np.unique(t.keys, return_index=True, return_counts=True)
        at = places.find(found)
        new = at < 0
        counts.held[at[~new]] += c[~new]
        places.add(found[new])
        keys.extend(found[new])
        endings.extend(t.endings[first[new]])
        counts.extend(c[new])
        if places.n > HELD:
            yield out()
            places, keys, endings, counts = fresh()
    if places.n:
        yield out()


def token_counts(training: DataFrame) -> DataFrame:
    """key, ending, c over all training texts; c includes one end for each text."""
    return training.mapInArrow(_count, "key long, ending long, c long").groupBy("key").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


class Vocabulary:
    """Frequent tokens and their counts; the first ones have vectors, in order of their endings, cut into classes of like size."""

    def __init__(self, keys: np.ndarray, endings: np.ndarray, c: np.ndarray, vectors: int, tail_mass: np.ndarray, total: float, distinct: int):
        order = np.lexsort((keys[:vectors], endings[:vectors]))
        self.keys = np.concatenate([keys[:vectors][order], keys[vectors:]])
        self.c = np.concatenate([c[:vectors][order], c[vectors:]]).astype(np.float64)
        self.n, self.tail_mass = vectors, tail_mass
        self.base = np.log10(total + ALPHA * (distinct + 1))
        classes = int(np.ceil(np.sqrt(vectors)))
        self.bounds = np.linspace(0, vectors, classes + 1).astype(np.int64)
        self.cls = np.repeat(np.arange(classes), np.diff(self.bounds))
        self.upto = np.concatenate([[0.0], np.cumsum(self.c[:vectors])])
        mass = np.concatenate([np.diff(self.upto[self.bounds]), tail_mass])
        self.share = mass / mass.sum()
        self.own_share = self.c[:vectors] / np.maximum(mass[self.cls], 1e-300)
        #: Where contexts, classes, tokens and positions begin in the table of parameters.
        self.at_class = vectors + TAILS
        self.at_token = self.at_class + classes + TAILS
        self.at_position = self.at_token + vectors
        self.rows = self.at_position + POSITIONS

    def start(self, seed: int = 5) -> np.ndarray:
        """Parameters whose model is the unigram: no target has a direction yet, offsets are the shares' logarithms."""
        p = np.zeros((self.rows, WIDTH + 1), np.float32)
        p[: self.at_class, :WIDTH] = np.random.default_rng(seed).normal(0, 0.3, (self.at_class, WIDTH))
        p[self.at_class : self.at_token, WIDTH] = np.log(self.share)
        p[self.at_token : self.at_position, WIDTH] = np.log(self.own_share)
        p[self.at_position :, :WIDTH] = 1 / np.arange(1, POSITIONS + 1)[:, None]
        return p

    def numbers(self, places: Places, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, targets, contexts) of tokens: place among the frequent or -1, number with a vector or -1, and the rows of the three tokens before."""
        place = places.find(t.keys)
        target = np.where(place < self.n, place, -1)
        row = np.where(target >= 0, target, self.n + tail_class(t.endings))
        end = places.find(np.array([END]))[0]
        start = end if 0 <= end < self.n else self.n + tail_class(0)
        at = np.arange(len(row))
        context = [np.where(at - k >= t.begin, row[np.maximum(at - k, 0)], start) for k in range(1, POSITIONS + 1)]
        return place, target, np.stack(context, 1) if len(row) else np.empty((0, POSITIONS), np.int64)

    def classes_of(self, target: np.ndarray, endings: np.ndarray) -> np.ndarray:
        tail = len(self.bounds) - 1 + tail_class(endings)
        return np.where(target >= 0, self.cls[np.maximum(target, 0)], tail) if self.n else tail


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of x."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Stochastic gradient ascent of the noise-contrastive objective, steps scaled by each row's gradients so far.

    A step's rows are turned to columns, so that every operation runs along all its positions."""

    def __init__(self, p: np.ndarray, v: Vocabulary, seed: list[int]):
        self.p, self.v, self.rng = p.copy(), v, np.random.default_rng(seed)
        self.squares, self.touched, self.place = np.full(len(p), 1.0, np.float32), np.zeros(len(p), np.float32), np.zeros(len(p), np.int64)
        self.class_upto, self.class_log, self.token_log = np.cumsum(v.share), np.log(NOISE_CLASSES * v.share).astype(np.float32), np.log(NOISE_TOKENS * np.maximum(v.own_share, 1e-300)).astype(np.float32)

    def add(self, ids: np.ndarray, grads: np.ndarray) -> None:
        """Move rows along the sums of their gradients, which are given by column."""
        times = np.bincount(ids)
        rows = np.flatnonzero(times > 0)
        self.place[rows] = np.arange(len(rows))
        at = self.place[ids]
        total = np.empty((len(grads), len(rows)), np.float32)
        for out, g in zip(total, grads, strict=True):
            out[:] = np.bincount(at, g, len(rows))
        squares = self.squares[rows] + np.einsum("ij,ij->j", total, total) / (WIDTH + 1)
        self.squares[rows] = squares
        total *= RATE / np.sqrt(squares)
        self.p[rows] += total.T
        self.touched[rows] += times[rows]

    def step(self, context: np.ndarray, cls: np.ndarray, target: np.ndarray) -> None:
        """One step; positions in order of their classes, so that those with a target come first."""
        v, n, m = self.v, len(cls), int(np.count_nonzero(target >= 0))
        noise = np.minimum(np.searchsorted(self.class_upto, self.rng.random(NOISE_CLASSES)), len(v.share) - 1)
        parts = [v.at_class + cls, v.at_class + noise, v.at_position + np.arange(POSITIONS), np.ascontiguousarray(context.T).ravel()]
        if m:
            low, high = v.bounds[cls[:m]], v.bounds[cls[:m] + 1]
            from_, to = v.upto[low], v.upto[high]
            drawn = np.searchsorted(v.upto, from_ + self.rng.random((NOISE_TOKENS, m)) * (to - from_), "right") - 1
            tokens = np.concatenate([target[None, :m], np.clip(drawn, low, high - 1)])
            parts.append(v.at_token + tokens.ravel())
        ids, cuts = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        rows = np.ascontiguousarray(np.take(self.p, ids, axis=0, mode="clip").T)  # no id is out of bounds; other modes are slower
        moves = np.zeros_like(rows)
        own, other, weights = rows[:, :n], rows[:, n : cuts[1]], rows[:WIDTH, cuts[1] : cuts[2], None]
        near = rows[:WIDTH, cuts[2] : cuts[3]].reshape(WIDTH, POSITIONS, n)
        h = near[:, 0] * weights[:, 0]
        for k in range(1, POSITIONS):
            h += near[:, k] * weights[:, k]
        g = moves[:, :n]
        g[WIDTH] = _sigmoid(self.class_log[cls] - (h * own[:WIDTH]).sum(0) - own[WIDTH])
        scores = other[:WIDTH].T @ h
        scores += (other[WIDTH] - self.class_log[noise])[:, None]
        g_other = _sigmoid(scores)
        dh = g[WIDTH] * own[:WIDTH] - other[:WIDTH] @ g_other
        np.multiply(g[WIDTH], h, out=g[:WIDTH])
        moves[:WIDTH, n : cuts[1]], moves[WIDTH, n : cuts[1]] = -(h @ g_other.T), -g_other.sum(1)
        if m:
            vectors, out, hr = rows[:, cuts[3] :].reshape(WIDTH + 1, -1, m), moves[:, cuts[3] :].reshape(WIDTH + 1, -1, m), h[:, None, :m]
            slopes = (vectors[:WIDTH] * hr).sum(0)
            slopes += vectors[WIDTH] - self.token_log[tokens]
            slopes = -_sigmoid(slopes)
            slopes[0] += 1
            dh[:, :m] += (vectors[:WIDTH] * slopes).sum(1)
            np.multiply(hr, slopes, out=out[:WIDTH])
            out[WIDTH] = slopes
        moves[:WIDTH, cuts[1] : cuts[2]] = np.einsum("db,dkb->dk", dh, near)
        np.multiply(dh[:, None], weights, out=moves[:WIDTH, cuts[2] : cuts[3]].reshape(WIDTH, POSITIONS, n))
        self.add(ids, moves)

    def learn(self, texts: list[bytes], places: Places) -> None:
        """Learn from every position of the texts."""
        t = tokens_of(texts)
        _, target, context = self.v.numbers(places, t)
        cls = self.v.classes_of(target, t.endings)
        mixed = self.rng.permutation(len(target))
        for at in range(0, len(mixed), STEP):
            part = mixed[at : at + STEP]
            part = part[np.argsort(cls[part])]
            self.step(context[part], cls[part], target[part])


def taught(texts: list[bytes], turn: int) -> list[bytes]:
    """The texts that a round learns from: each text in one of the rounds, by its own bytes."""
    return [x for x in texts if zlib.crc32(x) % ROUNDS == turn]


def _places(key: str, v: Vocabulary) -> Places:
    def make() -> Places:
        places = Places()
        places.add(v.keys)
        return places

    return hold(f"token numbers {key}", "places", make)


def train(training: DataFrame, vocabulary, key: str) -> np.ndarray:
    """The trained parameters. A round's tasks, as many as some cores take, start from the last round's mean; the table has a row for each
    vector, at most 2 * VECTORS and a few hundred, and every task hands on the rows that it changed."""
    session, v = training.sparkSession, vocabulary.value
    tasks = training.coalesce(2 * session.sparkContext.defaultParallelism)
    names = [f"d{i}" for i in range(WIDTH + 1)]
    p = v.start()
    for turn in range(ROUNDS):
        shared = session.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            v, places = vocabulary.value, _places(key, vocabulary.value)
            trainer = Trainer(shared.value, v, [turn, TaskContext.get().partitionId()])
            for part in pieces(batches, ROWS, SIZE):
                trainer.learn(taught(raw_bytes(part.column(1)), turn), places)
            rows = np.flatnonzero(trainer.touched)
            change = (trainer.p[rows] - shared.value[rows]) * trainer.touched[rows, None]
            for at in range(0, len(rows), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(rows[part].astype(np.int32)), pa.array(trainer.touched[rows][part]), *(pa.array(x) for x in change[part].T)], names=["row", "n", *names])

        sums = tasks.mapInArrow(run, f"row int, n float, {', '.join(f'{x} float' for x in names)}").groupBy("row").agg(*[(F.sum(x) / F.sum("n")).cast("float").alias(x) for x in names]).toArrow()
        p = p.copy()
        if sums.num_rows:
            p[sums.column("row").to_numpy()] += np.column_stack([sums.column(x).to_numpy() for x in names])
        shared.unpersist()
    return p


def log_probabilities(p: np.ndarray, v: Vocabulary, context: np.ndarray, cls: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithms of each token's probability: its class's after the context, and, if it has a vector, its own in the class."""
    out = np.empty(len(cls))

    # Contexts times their positions' weights, and a 1 for the offset: their sums are rows of h.
    near = [p[: v.at_class] * p[v.at_position + k] for k in range(POSITIONS)]
    for k, a in enumerate(near):
        a[:, WIDTH] = k == 0
    h, lengths = np.empty((len(cls), WIDTH + 1), np.float32), 0.0
    for at in range(0, len(cls), BLOCK):
        part = slice(at, at + BLOCK)
        some = np.take(near[0], context[part, 0], axis=0, out=h[part], mode="clip")
        for k in range(1, POSITIONS):
            some += np.take(near[k], context[part, k], axis=0, mode="clip")
        lengths = max(lengths, float(np.einsum("ij,ij->i", some, some).max()))
    lengths = np.sqrt(lengths)

    def columns(low: int, high: int) -> tuple[np.ndarray, float]:
        """Rows as columns, their offsets last, and the greatest length of one."""
        a = np.ascontiguousarray(p[low:high].T)
        return a, float(np.sqrt(np.einsum("ij,ij->j", a, a).max(initial=0)))

    def picked(h: np.ndarray, a: np.ndarray, longest: float, at: np.ndarray) -> np.ndarray:
        scores = h @ a
        own = scores[np.arange(len(at)), at].astype(np.float64)
        if longest * lengths > 80:  # no product is beyond that of the lengths
            np.minimum(scores, 80, out=scores)  # far beyond what training reaches, within what exp can hold
        return own - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))

    # Blocks small enough for a core's cache.
    a, longest = columns(v.at_class, v.at_token)
    for at in range(0, len(cls), BLOCK):
        part = slice(at, at + BLOCK)
        out[part] = picked(h[part], a, longest, cls[part])
    real = np.flatnonzero(target >= 0)
    real = real[np.argsort(cls[real], kind="stable")]
    h = np.take(h, real, axis=0)
    cuts = np.searchsorted(cls[real], np.arange(len(v.bounds)))
    for c in range(len(v.bounds) - 1):
        if cuts[c] == cuts[c + 1]:
            continue
        own, longest = columns(v.at_token + v.bounds[c], v.at_token + v.bounds[c + 1])
        for at in range(cuts[c], cuts[c + 1], BLOCK):
            part = slice(at, min(at + BLOCK, cuts[c + 1]))
            out[real[part]] += picked(h[part], own, longest, target[real[part]] - v.bounds[c])
    return out


def frequent_tokens(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, endings and counts of tokens by falling count, of equal ones by key: all from the least count at which they are FREQUENT at most.

    That count comes from the number of tokens of each count, so no task sorts or merges the tokens."""
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= FREQUENT).agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    keys, endings, c = top.column("key").to_numpy().view(np.uint64), top.column("ending").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((keys, -c))
    return keys[order], endings[order], c[order]


def fit(training: DataFrame) -> dict:
    """Everything that scoring needs: the counts' table, their sums, the vocabulary and the trained parameters."""
    counts = materialize(token_counts(training), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    keys, endings, c = frequent_tokens(counts)
    vectors = min(int((c >= max(LEAST, np.sqrt(total) / ROOT_SHARE)).sum()), VECTORS)
    mass = np.full(TAILS, ALPHA)  # each tail class holds one unknown token
    for r in counts.groupBy((F.pmod(F.shiftright(F.shiftright("ending", 16) * 40503, 5), F.lit(TAILS))).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r.k] += r.c + ALPHA * r.n
    np.add.at(mass, tail_class(endings[:vectors]), -(c[:vectors] + ALPHA))
    shared = training.sparkSession.sparkContext.broadcast(Vocabulary(keys, endings, c, vectors, np.maximum(mass, ALPHA), total, distinct))
    key = uuid.uuid4().hex
    return {"counts": counts, "vocabulary": shared, "key": key, "parameters": train(training, shared, key), "total": total}


def _rows(fitted: dict, parameters):
    vocabulary, key = fitted["vocabulary"], fitted["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p, places = vocabulary.value, parameters.value, _places(key, vocabulary.value)
        logs = np.append(np.log10(v.c + ALPHA), 0.0)
        tail_log = np.log10(v.tail_mass)
        for batch in pieces(batches, ROWS, SIZE):
            t = tokens_of(raw_bytes(batch.column(1)))
            n = batch.num_rows
            place, target, context = v.numbers(places, t)
            cls = v.classes_of(target, t.endings)
            own = logs[place]
            score = log_probabilities(p, v, context, cls, target) / np.log(10)
            tail = target < 0
            score[tail] += own[tail] - tail_log[tail_class(t.endings[tail])]
            length = np.bincount(t.owner, minlength=n)
            base = np.bincount(t.owner, own, n) - length * v.base
            # Tokens beyond the broadcast counts are left to the join.
            left = np.flatnonzero(place < 0)
            order = left[np.lexsort((t.keys[left], t.owner[left]))]
            k, o = t.keys[order], t.owner[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])) if len(order) else np.empty(0, np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=n))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cuts), pa.array(k[first].view(np.int64)))
            times = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.diff(np.append(first, len(order))).astype(np.int32)))
            columns = [length, np.bincount(t.owner, place >= 0, n).astype(np.int64), base, np.bincount(t.owner, score, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in columns), rare, times], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    return run


def score(docs: DataFrame, fitted: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null and empty texts are their end alone; null ids stay; ids that aren't whole numbers raise; repeated rows are scored each;
    very long texts are a group of their own; tokens of equal counts are ordered by their hash; other columns, of whatever
    name, are not read; an empty table gives no rows, and without training texts every token is unknown."""
    parameters = docs.sparkSession.sparkContext.broadcast(fitted["parameters"])
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_rows(fitted, parameters), "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    looked = rare.join(fitted["counts"].select("key", "c"), "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("logs")
    )
    both = rows.drop("rare", "times").join(looked, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(fitted["total"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out (crc32 of the id mod 10 is 0) and score all."""
    found = score(docs, fit(id_and_text(docs, "doc_id", "text").where(~held_out(parts=10, part=0))))
    return found.select("doc_id", held_out(parts=10, part=0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
