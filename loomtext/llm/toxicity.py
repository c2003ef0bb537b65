"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is its white-space-separated words in lower case without marks at their ends; a word of over
LONGEST characters is successive parts of that many, each a word. A word enters
the network twice: as a word (its embedding if enough training documents hold it, else one for rare
words) and as characters (the mean of its hashed character trigrams' embeddings). Two gated
recurrent layers read a window of WINDOW words, one in each direction; attention pools their states
into the window's logit. Windows start every STRIDE words over the whole text, so each word is in
two of them; a document's score is that of its most toxic window.

Only documents have labels, so windows are learnt as instances of a bag: each round trains on the
windows that score highest in toxic documents, and on the highest and some others in clean ones.
Word embeddings start from the words' log-odds in the training documents.

The training sample is bounded by `most_documents` labelled ids for each label (smallest hashes of
their ids, and whole texts of them) and by `most_chars` characters in all. All texts are scored whole.

Defined results: null and empty texts are one window of a blank; without labels of both kinds the
score is the smoothed share of label 1; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import extended, fold, sliced, texts_of

WINDOW, STRIDE = 32, 16
HIDDEN, WORD, CHAR, GRAMS = 8, 8, 8, 4096
#: Characters of a word; a longer one is several.
LONGEST = 64
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that a worker remembers, and windows that go through the network at once.
REMEMBERED, AT_ONCE = 300_000, 4096


def words_of(text: str) -> list[str]:
    """The words of a text; one of over LONGEST characters gives successive parts."""
    out = []
    for word in text.lower().split():
        if len(word) <= LONGEST:
            out.append(word)
        else:
            word = word.strip(MARKS)
            out += [word[i : i + LONGEST] for i in range(0, max(1, len(word)), LONGEST)]
    return out


def bare(word: str) -> str:
    return word.strip(MARKS)


def grams_of(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + 3].encode()) % GRAMS for i in range(max(1, len(marked) - 2))]


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n words; the last one reaches the end."""
    return list(range(0, max(1, n - STRIDE), STRIDE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Parameters, and the vocabulary of words that have an embedding; or only a constant score."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    constant: float | None = None

    def inputs(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions, words x 6 HIDDEN."""
        ids = np.asarray([self.vocabulary.get(x, 0) for x in words])
        grams = [grams_of(x) for x in words]
        sizes = np.asarray([len(x) for x in grams])
        flat = np.asarray([y for x in grams for y in x])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        chars = np.add.reduceat(self.p["chars"][flat], starts, axis=0) / sizes[:, None]
        return (np.concatenate([self.p["words"][ids], chars], axis=1) @ self.p["in"] + self.p["in_b"]).astype(np.float32)


def _pass(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction. x: time x windows x 3 HIDDEN; mask: time x windows x 1."""
    steps, n = x.shape[:2]
    h = np.zeros((n, HIDDEN), np.float32)
    states, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        g = h @ u
        zr = 1 / (1 + np.exp(-(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if keep:
            kept.append((h, z, r, c, g[:, 2 * HIDDEN :]))
        h = np.where(mask[t], new, h) if mask is not None else new
        states[t] = h
    return states, kept


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):  # noqa: ANN201
    """Logits of windows. x: time x windows x 6 HIDDEN, mask: time x windows (words that are there, from the start)."""
    full = bool(mask.all())
    m = None if full else mask[:, :, None]
    ahead, kept_a = _pass(x[:, :, : 3 * HIDDEN], m, p["u_ahead"], keep)
    back, kept_b = _pass(x[::-1, :, 3 * HIDDEN :], None if full else m[::-1], p["u_back"], keep)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    a = np.tanh(states @ p["attend"])
    s = a @ p["attend_v"]
    if not full:
        s = np.where(mask, s, -1e9)
    e = np.exp(s - s.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", alpha, states)
    logit = pooled @ p["out"] + p["out_b"][0]
    return (logit, (x, mask, states, a, alpha, pooled, kept_a, kept_b)) if keep else logit


def _pass_back(d: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, n = d.shape[:2]
    dx, du, carry = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        h, z, r, c, gc = kept[t]
        total = d[t] + carry
        now = total * mask[t]
        da_c = now * (1 - z) * (1 - c * c)
        da_z = now * (h - c) * z * (1 - z)
        da_r = da_c * gc * r * (1 - r)
        dg = np.concatenate([da_z, da_r, da_c * r], axis=1)
        dx[t] = np.concatenate([da_z, da_r, da_c], axis=1)
        du += h.T @ dg
        carry = total * (1 - mask[t]) + now * z + dg @ u.T
    return dx, du


def backward(p: dict[str, np.ndarray], tape: tuple, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters above the inputs, and of the inputs."""
    x, mask, states, a, alpha, pooled, kept_a, kept_b = tape
    g = {"out": pooled.T @ d_logit, "out_b": np.asarray([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["out"]
    d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
    d_states = alpha[:, :, None] * d_pooled
    d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["attend_v"] = np.einsum("tnk,tn->k", a, d_s)
    d_a = d_s[:, :, None] * p["attend_v"] * (1 - a * a)
    g["attend"] = np.einsum("tnh,tnk->hk", states, d_a)
    d_states = d_states + d_a @ p["attend"].T
    m = mask[:, :, None].astype(np.float32)
    dx_a, g["u_ahead"] = _pass_back(d_states[:, :, :HIDDEN], kept_a, m, p["u_ahead"])
    dx_b, g["u_back"] = _pass_back(d_states[::-1, :, HIDDEN:], kept_b, m[::-1], p["u_back"])
    return g, np.concatenate([dx_a, dx_b[::-1]], axis=2)


def train(texts: list[str], labels: list[int], rounds: int = 14, seed: int = 11, least_documents: int = 5) -> Model:
    """A model of labelled texts (label 1: toxic)."""
    labels = np.asarray(labels, np.int64)
    positive = int(labels.sum())
    if not 0 < positive < len(labels):
        return Model({}, {}, (positive + 1) / (len(labels) + 2))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {"": 0}
    bodies = []
    for text in texts:
        bodies.append(np.asarray([index.setdefault(bare(x), len(index)) for x in words_of(text)] or [0], np.int64))
    words = list(index)
    seen = np.zeros((len(words), 2))
    for body, label in zip(bodies, labels.tolist(), strict=True):
        seen[np.unique(body), label] += 1
    share = np.log((seen[:, 1] + 0.5) / (positive + 1)) - np.log((seen[:, 0] + 0.5) / (len(labels) - positive + 1))
    known = np.flatnonzero(seen.sum(axis=1) >= least_documents)
    vocabulary = {words[k]: i + 1 for i, k in enumerate(known.tolist())}
    word_id = np.zeros(len(words), np.int64)
    word_id[known] = np.arange(len(known)) + 1

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"words": 0.1 * start(len(known) + 1, WORD) * np.sqrt(len(known) + 1), "chars": 0.1 * rng.standard_normal((GRAMS, CHAR)).astype(np.float32), "in": start(WORD + CHAR, 6 * HIDDEN), "in_b": np.zeros(6 * HIDDEN, np.float32), "u_ahead": start(HIDDEN, 3 * HIDDEN), "u_back": start(HIDDEN, 3 * HIDDEN), "attend": start(2 * HIDDEN, HIDDEN), "attend_v": start(HIDDEN), "out": start(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["words"][1:, 0] = np.clip(share[known], -4, 4) / 2
    grams = [grams_of(x) for x in words]
    gram_size = np.asarray([len(x) for x in grams])
    gram_start = np.concatenate([[0], np.cumsum(gram_size)[:-1]])
    gram_flat = np.asarray([y for x in grams for y in x])

    starts = [windows_of(len(x)) for x in bodies]
    owner = np.repeat(np.arange(len(bodies)), [len(x) for x in starts])
    grid = np.zeros((len(owner), WINDOW), np.int64)
    length = np.empty(len(owner), np.int64)
    prior = np.empty(len(owner))
    strength = np.where(word_id > 0, share, 0)
    for k, (doc, at) in enumerate(zip(owner.tolist(), (y for x in starts for y in x), strict=True)):
        part = bodies[doc][at : at + WINDOW]
        grid[k, : len(part)], length[k], prior[k] = part, len(part), strength[part].max()

    def read(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows' distinct words, their place, their input before and after the first layer."""
        distinct, place = np.unique(grid[own], return_inverse=True)
        sizes = gram_size[distinct]
        flat = np.concatenate([gram_flat[s : s + n] for s, n in zip(gram_start[distinct], sizes, strict=True)])
        cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        chars = np.add.reduceat(p["chars"][flat], cuts, axis=0) / sizes[:, None]
        x = np.concatenate([p["words"][word_id[distinct]], chars], axis=1).astype(np.float32)
        return distinct, place.reshape(len(own), WINDOW), x, flat

    order = np.arange(WINDOW)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, score = 0, prior
    for round_ in range(rounds):
        # The most toxic windows of each document, and for clean ones some others.
        rank = np.lexsort((-score, owner))
        place_in = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(np.bincount(owner))[:-1]])[owner[rank]]
        top = rank[place_in < np.where(labels[owner[rank]] == 1, 1, 2)]
        other = rng.choice(len(owner), min(len(owner), len(bodies)), replace=False)
        chosen = np.unique(np.concatenate([top, other[labels[owner[other]] == 0]]))
        rng.shuffle(chosen)
        rate = 0.02 * (0.8**round_) + 0.001
        for at in range(0, len(chosen), 256):
            own = chosen[at : at + 256]
            distinct, place, x, flat = read(own)
            mask = (order[:, None] < length[own]).astype(bool)
            y = labels[owner[own]].astype(np.float32)
            logit, tape = forward(p, (x @ p["in"] + p["in_b"])[place.T], mask, keep=True)
            weight = np.where(y == 1, 0.5 / max(1e-3, y.mean()), 0.5 / max(1e-3, 1 - y.mean())).clip(0.2, 5)
            g, dx = backward(p, tape, ((sigmoid(logit) - y) * weight / len(own)).astype(np.float32))
            d_in = np.zeros((len(distinct), 6 * HIDDEN), np.float32)
            np.add.at(d_in, place.T.ravel(), (dx * mask[:, :, None]).reshape(-1, 6 * HIDDEN))
            g["in"], g["in_b"] = x.T @ d_in, d_in.sum(axis=0)
            d_x = d_in @ p["in"].T
            g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
            np.add.at(g["words"], word_id[distinct], d_x[:, :WORD])
            np.add.at(g["chars"], flat, np.repeat(d_x[:, WORD:] / gram_size[distinct][:, None], gram_size[distinct], axis=0))
            step += 1
            for k, v in g.items():
                first, second = moments[k]
                first += 0.1 * (v - first)
                second += 0.001 * (v * v - second)
                p[k] -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if round_ % 3 == 0:
            score = np.empty(len(owner))
            for at in range(0, len(owner), AT_ONCE):
                own = np.arange(at, min(len(owner), at + AT_ONCE))
                _, place, x, _ = read(own)
                score[own] = forward(p, (x @ p["in"] + p["in_b"])[place.T], order[:, None] < length[own])
    return Model(vocabulary, p)


class Scorer:
    """A model with the inputs of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        if model.constant is None:
            self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.table = self.model.inputs([""])
        self.used = 1

    def _learn(self, words: list[str]) -> None:
        if self.used + len(words) > REMEMBERED:
            raise OverflowError
        if self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((max(len(words), len(self.table)), self.table.shape[1]), np.float32)])
        self.table[self.used : self.used + len(words)] = self.model.inputs([bare(x) for x in words])
        self.known.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of the table for one text's words."""
        known = self.known
        for part in range(0, max(1, len(words)), REMEMBERED // 4):
            new = {x for x in words[part : part + REMEMBERED // 4] if x not in known}
            if new:
                self._learn(list(new))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)) if words else np.zeros(1, np.int64)

    def score(self, texts: list[str]) -> np.ndarray:
        """The most toxic window's probability for each text."""
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        best = np.full(len(texts), -np.inf)
        flat, owner, left = [], [], []

        def flush() -> None:
            if not flat:
                return
            windows, sizes, own = np.concatenate(flat), np.concatenate(left), np.concatenate(owner)
            flat.clear(), owner.clear(), left.clear()
            full = sizes == WINDOW
            for some in (np.flatnonzero(full), np.flatnonzero(~full)):
                for at in range(0, len(some), AT_ONCE):
                    k = some[at : at + AT_ONCE]
                    logit = forward(self.model.p, self.table[windows[k].T], np.arange(WINDOW)[:, None] < sizes[k])
                    np.maximum.at(best, own[k], logit)

        if self.used > REMEMBERED // 2:
            self.forget()
        pending = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            try:
                body = self.places(words)
            except OverflowError:
                flush()
                pending = 0
                self.forget()
                try:
                    body = self.places(words)
                except OverflowError:  # one text has more distinct words than are remembered: read it in parts that overlap by a stride
                    step = REMEMBERED // 4 // STRIDE * STRIDE
                    for at in range(0, max(1, len(words) - STRIDE), step):
                        self.forget()
                        part = self.places(words[at : at + step + STRIDE])
                        self._windows(part, k, flat, owner, left)
                        flush()
                    continue
            pending += self._windows(body, k, flat, owner, left)
            if pending >= AT_ONCE:
                flush()
                pending = 0
        flush()
        return sigmoid(best)

    @staticmethod
    def _windows(body: np.ndarray, k: int, flat: list, owner: list, left: list) -> int:
        n = len(body)
        starts = np.asarray(windows_of(n))
        padded = np.zeros(int(starts[-1]) + WINDOW, np.int64)
        padded[:n] = body
        flat.append(padded[starts[:, None] + np.arange(WINDOW)])
        left.append(np.minimum(WINDOW, n - starts))
        owner.append(np.full(len(starts), k))
        return len(starts)


def sample(docs: DataFrame, labels: DataFrame, label: str, most_documents: int, folds: int, held: int, most_chars: int = 64_000_000) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `most_documents` ids of each label outside the held-out fold, whole texts of `most_chars` characters in all.

    Where texts are so long that this bound counts, those of the smallest hashes of their ids stay.
    """
    kept = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & (fold("__id", folds) != held))
    kept = kept.groupBy("__id").agg(F.max("__label").alias("__label"))
    # Two bounded top lists, so what is broadcast has a fixed bound.
    parts = [kept.where(F.col("__label") == x).orderBy(F.xxhash64("__id"), "__id").limit(most_documents) for x in (0, 1)]
    wanted = parts[0].unionByName(parts[1])
    first = docs.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(wanted), F.col("__doc") == F.col("__id"))
    rows = first.groupBy("__id").agg(F.min("__label").alias("label"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    # Over the bounded sample only.
    chars = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__chars", chars).where(F.col("__chars") <= most_chars).orderBy("__id").select("text", "label").toArrow()
    return rows.column(0).to_pylist(), rows.column(1).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, most_documents: int = 2000, folds: int = 3, held: int = 1) -> Model:
    return train(*sample(docs, labels, "toxic", most_documents, folds, held))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column `toxicity` of its whole texts' scores; one that has this name is replaced."""
    docs = docs.select(*(f"`{x}`" for x in docs.columns if x.lower() != "toxicity"))
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: vocabulary and parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches, 1024):
            scores = scorer.score(texts_of(batch, at)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, "toxicity"])

    return docs.mapInArrow(run, extended(docs.schema, "toxicity double"))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score of 0.7 or more)."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
