"""Language identification by a linear-chain conditional random field over the words of code-switched text."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, checked, materialize, slices

#: Documents of each language that training takes (those of least hash), their most bytes, sequences spliced of them
#: for a pass, and passes over these.
SAMPLE, LONGEST, SEQUENCES, EPOCHS = 60, 1 << 20, 4_000, 8
#: Words in a segment of a long text.
SEGMENT = 2_048
#: Words whose scores a worker remembers; forgetting them changes no result.
MEMO = 250_000


#: A run of letters; one of more than 40 (as in unspaced scripts) is cut into consecutive words of 40 and a rest.
WORD = re.compile(r"[^\W\d_]{1,40}")
#: Number signs that are neither letters nor digits but that a regular expression takes for word characters.
SIGNS = re.compile(f"[{''.join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())}]")


def words(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters, and nothing else."""
    return WORD.findall(SIGNS.sub(" ", text).lower())


def features(word: str) -> list[str]:
    """Affixes, character n-grams and the word itself (for the lexicon)."""
    w = f"<{word}>"
    return [f"={word}", *(f"^{word[:k]}" for k in (1, 2, 3)), *(f"{word[-k:]}$" for k in (1, 2, 3, 4)), *(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1))]


@dataclass
class Model:
    """Weights of features (rows) for labels (columns), and the scores of moving from one label to the next."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences (batch, time, label): label marginals, and expected moves."""
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    forward = np.empty_like(e)
    x = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = x
    for t in range(1, steps):
        x = (x @ a) * e[:, t]
        x /= x.sum(axis=1, keepdims=True)
        forward[:, t] = x
    back = np.full((n, k), 1.0 / k, e.dtype)
    both = forward
    pairs = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        here = lengths - 1 <= t  # the last word or padding
        if here.any():
            back = np.where(here[:, None], 1.0 / k, back)
        p = forward[:, t] * back
        p /= p.sum(axis=1, keepdims=True)
        if t:
            to = e[:, t] * back
            to /= to.sum(axis=1, keepdims=True)
            live = (t < lengths)[:, None]
            joint = forward[:, t - 1][:, :, None] * a[None] * to[:, None, :]
            total = joint.sum(axis=(1, 2), keepdims=True)
            pairs += np.where(live[:, :, None], joint / total, 0).sum(axis=0)
            back = to @ a.T
        both[:, t] = p
    return both, pairs


def posteriors(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Label marginals only, of padded sequences (time, batch, label).

    A sequence that continues another has the forward message of that one's last word in before, one that goes on the
    backward message of its own last word in after; rows of before that are zero begin.
    """
    steps, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max()).astype(e.dtype)
    at = np.ascontiguousarray(a.T)
    forward = np.empty_like(e)
    x = e[0] if before is None else e[0] * np.where(before.any(axis=1, keepdims=True), before @ a, 1)
    x = x / x.sum(axis=1, keepdims=True)
    forward[0] = x
    for t in range(1, steps):
        x = x @ a
        x *= e[t]
        x /= x.sum(axis=1, keepdims=True)
        forward[t] = x
    ends = np.bincount(lengths - 1, minlength=steps)
    back = np.ones((n, k), e.dtype)
    for t in range(steps - 1, -1, -1):
        if ends[t]:
            last = lengths - 1 == t
            back[last] = 1 if after is None else after[last]
        forward[t] *= back
        back = (e[t] * back) @ at
        back /= back.sum(axis=1, keepdims=True)
    forward /= forward.sum(axis=2, keepdims=True)
    return forward


def transfers(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Weights (batch, from, to) of all paths through padded sequences (time, batch, label).

    They lead from the label before a sequence to its last one; where a sequence begins a text, from its first one.
    """
    steps, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max()).astype(e.dtype)
    x = np.where(begins[:, None, None], np.eye(k), a) * e[0][:, None, :]
    for t in range(1, steps):
        live = int(np.searchsorted(-lengths, -t))  # longest first
        y = (x[:live].reshape(-1, k) @ a).reshape(live, k, k) * e[t, :live, None, :]
        x[:live] = y / y.sum(axis=(1, 2), keepdims=True) if t % 4 == 0 else y
    return x / x.sum(axis=(1, 2), keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7, span: int = 16, steps: int = 64, epochs: int = EPOCHS) -> Model:
    """Trains on sequences spliced from spans of the texts, so that moves between languages are seen (Adagrad).

    A pass takes as many sequences of steps words as the texts have words for, at most SEQUENCES of them.
    """
    labels = sorted(set(langs))
    k = len(labels)
    found = [words(t) for t in texts]
    vocabulary: dict[str, int] = {}
    index: dict[str, int] = {}
    seen: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws in found]
    per_word = [features(w) for w in vocabulary]
    for fs in per_word:
        for f in fs:
            seen[f] = seen.get(f, 0) + 1
    for f, n in seen.items():
        if n >= 2 or f[0] == "=":
            index[f] = len(index)
    known = [[index[f] for f in fs if f in index] for fs in per_word]
    flat = np.array([i for fs in known for i in fs], np.int64)
    sizes = np.array([len(fs) for fs in known], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    of = np.repeat(np.arange(len(known)), sizes)
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    if k < 2 or not len(flat):
        return Model(labels, index, weights.astype(np.float32), moves.astype(np.float32))
    rng = np.random.default_rng(seed)
    y_of = np.array([labels.index(x) for x in langs])
    usable = [np.array([i for i in range(len(docs)) if y_of[i] == j and len(docs[i])]) for j in range(k)]
    live = [j for j in range(k) if len(usable[j])]
    count = max(64, min(SEQUENCES, sum(map(len, docs)) // steps))
    grad_w, grad_m = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    for _ in range(epochs):
        x, y = np.empty((count, steps), np.int64), np.empty((count, steps), np.int64)
        for i in range(count):
            at, lang = 0, int(rng.choice(live))
            while at < steps:
                doc = docs[rng.choice(usable[lang])]
                n = min(steps - at, int(rng.geometric(1 / span)), len(doc))
                start = int(rng.integers(0, len(doc) - n + 1))
                x[i, at : at + n], y[i, at : at + n] = doc[start : start + n], lang
                at += n
                if rng.random() < 0.3:
                    lang = int(rng.choice(live))
        for lo in range(0, count, 512):
            xs, ys = x[lo : lo + 512], y[lo : lo + 512]
            used, inverse = np.unique(xs, return_inverse=True)
            inverse = inverse.reshape(xs.shape)
            score = np.add.reduceat(weights[flat], first)[used]
            p, pairs = marginals(score[inverse], moves, np.full(len(xs), steps))
            p[np.arange(len(xs))[:, None], np.arange(steps)[None], ys] -= 1
            g = np.zeros((len(known), k))
            np.add.at(g, used[inverse.ravel()], p.reshape(-1, k) / xs.size)
            rows = np.isin(of, used)
            gw = np.zeros_like(weights)
            np.add.at(gw, flat[rows], g[of[rows]])
            gw += 1e-7 * weights
            grad_w += gw * gw
            weights -= 0.2 * gw / np.sqrt(grad_w)
            gm = pairs.copy()
            np.add.at(gm, (ys[:, :-1].ravel(), ys[:, 1:].ravel()), -1)
            gm /= xs.size
            grad_m += gm * gm
            moves -= 0.1 * gm / np.sqrt(grad_m)
    return Model(labels, index, weights.astype(np.float32), moves.astype(np.float32))


class Scorer:
    """Rows of a score table of the words met."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.labels)))

    def learn(self, new: set[str]) -> None:
        """Scores runs of word characters that aren't in the table yet; one with a number sign is no word: -1."""
        get, flat, sizes = self.model.index.get, [], []
        for word in new:
            if not word.isascii() and SIGNS.search(word):
                self.rows[word] = -1
                continue
            self.rows[word] = len(self.table) + len(sizes)
            before = len(flat)
            flat += [i for f in features(word) if (i := get(f)) is not None]
            sizes.append(len(flat) - before)
        sizes = np.array(sizes, np.int64)
        scores = np.zeros((len(sizes), len(self.model.labels)))
        some = np.flatnonzero(sizes)
        if len(some):
            first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            scores[some] = np.add.reduceat(self.model.weights[np.array(flat, np.int64)].astype(np.float64), first, axis=0)
        self.table = np.concatenate([self.table, scores])

    def spans(self, texts: list[bytes]) -> list[np.ndarray]:
        """Rows of the words of each text."""
        if len(self.rows) > MEMO:
            self.rows.clear()
            self.table = self.table[:0]
        out = []
        for lo, hi in slices(texts):
            out += self._rows([WORD.findall(t.decode().lower()) for t in texts[lo:hi]])
        odd = [i for i, r in enumerate(out) if len(r) and r.min() < 0]
        for i, r in zip(odd, self._rows([words(texts[i].decode()) for i in odd])):
            out[i] = r
        return out

    def _rows(self, found: list[list[str]]) -> list[np.ndarray]:
        self.learn(set().union(*found).difference(self.rows))
        row = self.rows.__getitem__
        return [np.fromiter(map(row, ws), np.int32, len(ws)) for ws in found]

    def messages(self, rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of long texts: forward messages into and backward messages out of their segments, from transfers."""
        parts = sorted(((min(SEGMENT, len(r) - at), i, at) for i, r in enumerate(rows) for at in range(0, len(r), SEGMENT)), reverse=True)
        held: dict[tuple[int, int], np.ndarray] = {}
        for lo in range(0, len(parts), 64):
            some = parts[lo : lo + 64]
            lengths = np.array([n for n, _, _ in some])
            x = np.zeros((lengths[0], len(some)), np.int32)
            for c, (n, i, at) in enumerate(some):
                x[:n, c] = rows[i][at : at + n]
            got = transfers(self.table[x], self.model.moves, lengths, np.array([at == 0 for _, _, at in some]))
            held.update(((i, at // SEGMENT), m) for (_, i, at), m in zip(some, got))
        out = []
        for i, r in enumerate(rows):
            m = [held[i, s] for s in range(-(-len(r) // SEGMENT))]
            before, after = np.zeros((len(m), len(self.model.labels))), np.ones((len(m), len(self.model.labels)))
            for s in range(1, len(m)):
                x = (before[s - 1] if s > 1 else np.ones(len(self.model.labels))) @ m[s - 1]
                before[s] = x / x.sum()
            for s in range(len(m) - 1, 0, -1):
                x = m[s] @ after[s]
                after[s - 1] = x / x.sum()
            out.append((before, after))
        return out

    def predict(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Marginals summed over the words of each text; None where it has no letter."""
        k = len(self.model.labels)
        rows = self.spans(texts)
        begin = np.zeros(k), np.ones(k)
        long = [i for i, r in enumerate(rows) if len(r) > SEGMENT]
        handed = dict(zip(long, self.messages([rows[i] for i in long])))
        jobs = []  # (words, text, first word, messages)
        for i, r in enumerate(rows):
            if len(r) <= SEGMENT:
                if len(r):
                    jobs.append((len(r), i, 0, begin))
            else:
                before, after = handed[i]
                jobs += [(min(SEGMENT, len(r) - at), i, at, (before[s], after[s])) for s, at in enumerate(range(0, len(r), SEGMENT))]
        jobs.sort(key=lambda j: j[:3])
        total = np.zeros((len(texts), k))
        at = 0
        while at < len(jobs):
            end, longest = at, 0
            while end < len(jobs) and (end == at or (end - at + 1) * jobs[end][0] <= 150_000):
                longest = jobs[end][0]
                end += 1
            group = jobs[at:end]
            lengths = np.array([j[0] for j in group])
            x = np.zeros((longest, len(group)), np.int32)
            for c, (n, i, lo, _) in enumerate(group):
                x[:n, c] = rows[i][lo : lo + n]
            p = posteriors(self.table[x], self.model.moves, lengths, *(np.array([j[3][m] for j in group]) for m in (0, 1)))
            counts = (np.arange(longest)[:, None] < lengths).astype(p.dtype)
            np.add.at(total, np.array([j[1] for j in group]), np.einsum("tnk,tn->nk", p, counts))
            at = end
        return [total[i] / len(r) if len(r) else None for i, r in enumerate(rows)]


def held_out(id_col: str) -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4: not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model of the documents' languages, from at most sample documents of each, never from held-out ones.

    Only documents of at most longest bytes are in the sample, one row for each id. Rows without id, text or language
    teach nothing.
    """
    rank = F.row_number().over(W.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col))
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) <= longest) & ~held_out(id_col))
    chosen = known.select(id_col, lang_col).withColumn("_r", rank).filter(F.col("_r") <= sample).select(id_col).distinct()
    one = F.row_number().over(W.partitionBy(lang_col, id_col).orderBy(text_col))
    rows = known.join(checked(materialize(chosen), 16), id_col, "left_semi").select(id_col, lang_col, text_col).withColumn("_r", one).filter("_r = 1").orderBy(lang_col, id_col).collect()  # the bounded sample
    return fit([r[2] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: (id, lang_pred, score, shares).

    score is the mean over words of the marginal of lang_pred, shares the mean marginals by label. A text longer than
    SEGMENT words is labelled in segments that hand on their messages, so that the result is that of the whole. A null text or one without a letter is `und`
    with score 0 and no shares, as is every text if nothing could be learned. A row out for each row in; other columns
    are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    scorers: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if not scorers:
            scorers.append(Scorer(model))
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts, 8 << 20):
                found = scorers[0].predict(texts[lo:hi]) if model.labels else [None] * (hi - lo)
                best = [None if p is None else int(p.argmax()) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(["und" if b is None else model.labels[b] for b in best]),
                        pa.array([0.0 if b is None else min(1.0, float(p[b])) for p, b in zip(found, best)]),
                        pa.array([None if p is None else p.tolist() for p in found], pa.list_(pa.float64())),
                    ],
                    ["id", "lang_pred", "score", "shares"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double, shares array<double>").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns whose language is known: not `und`, and with a score of least or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    scorers: list[Scorer] = []
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scorers:
            scorers.append(Scorer(sent.value))
        for batch in batches:
            texts = as_bytes(batch.column(at))
            for lo, hi in slices(texts, 8 << 20):
                found = scorers[0].predict(texts[lo:hi]) if sent.value.labels else [None] * (hi - lo)
                yield batch.slice(lo, hi - lo).filter(pa.array([p is not None and float(p.max()) >= least for p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
