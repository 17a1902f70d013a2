"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters: each word of a small lexicon votes where a text has it; and patterns (whole words, or words that begin with certain
5 to 7 bytes, lower-cased), proposed by the labelled sample: of those e^ODDS times as common in toxic texts the at most VOTERS
that tell most. The label model explains all votes by a hidden class and by
one another: in each class the voters form a forest (`Forest`), in which a voter depends on the class and on one other voter
that it goes with most, given the class. Expectation maximisation estimates the class balance, each voter's firing rate in
either class (its accuracy) and the rates given the other voter (its correlations), and finds the forest anew from the
posterior; so a voter that only repeats another adds nothing to the posterior. The posterior labels train a ridge logistic
regression over the presence of the at most FEATURES words and beginnings that tell most for the class; it scores every whole
text.

Labels: rows whose crc32(doc_id as text) mod 5 is not 0, at most SAMPLE of them, the first by hash of doc_id. SAMPLE, VOTERS
and FEATURES are documented bounds on fitting alone; each text is scored whole, however long. Of several labels of one doc_id
the largest counts; null labels are left out. Without labelled rows the lexicon's voters alone make the score. Features that
tell equally much are ordered by their hash, voters that go together equally much by their number. Null texts count as empty;
empty texts are scored by the classifier's constant. Repeated rows give equal scores; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, is_held_out, map_batches, mix, record, slices, training_rows, word_hash

SAMPLE, VOTERS, FEATURES, ODDS, PREFIXES = 8192, 128, 1024, 4.0, (5, 6, 7)
#: A lexicon of plain insults; the mined patterns add what the corpus itself uses.
LEXICON = (
    "idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting clown clowns jerk fool dumb garbage filth vermin "
    "coward creep freak imbecile cretin degenerate parasite subhuman retard bastard bitch asshole shit fuck fucking whore slut pig swine"
).split()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once: hashes of a text's words and of their beginnings, sorted by row."""
    words = Words(pc.utf8_lower(texts))
    rows, keys = [words.doc], [words.hash]
    for n in PREFIXES:
        at, h = words.prefix(n)
        rows.append(words.doc[at])
        with np.errstate(over="ignore"):
            keys.append(mix(h + np.uint64(n)))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


class Presence:
    """Which of a set of features a text has."""

    def __init__(self, wanted: np.ndarray):
        self.order = np.argsort(wanted)
        self.sorted = wanted[self.order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.sorted & np.uint64((1 << 20) - 1)] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Boolean, texts by features. Looks words up before it makes them unique."""
        words = Words(pc.utf8_lower(texts))
        out = np.zeros((words.n_docs, len(self.sorted)), bool)
        if len(self.sorted):
            self._mark(out, words.doc, words.hash)
            for n in PREFIXES:
                at, h = words.prefix(n)
                with np.errstate(over="ignore"):
                    self._mark(out, words.doc[at], mix(h + np.uint64(n)))
        return out

    def _mark(self, out, docs, keys) -> None:
        maybe = np.flatnonzero(self.sieve[keys & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.sorted, keys[maybe]), len(self.sorted) - 1)
        good = self.sorted[place] == keys[maybe]
        out[docs[maybe[good]], self.order[place[good]]] = True


class Forest:
    """What each voter depends on besides the class: `parent` of each (itself: none), in an order where parents come first."""

    def __init__(self, votes: np.ndarray, posterior: np.ndarray, least: float = 0.02):
        n, m = votes.shape
        # Mutual information of each pair of voters given the class, from the four weighted counts of the pair.
        info = np.zeros((m, m))
        for w in (posterior, 1 - posterior):
            total = w.sum() + 1e-9
            both = (votes * w[:, None]).T @ votes / total
            one = np.diag(both).copy()
            for cell, a, b in ((both, one[:, None], one), (one[:, None] - both, one[:, None], 1 - one), (one - both, 1 - one[:, None], one), (1 - one[:, None] - one + both, 1 - one[:, None], 1 - one)):
                cell, mass = np.maximum(cell, 0), np.maximum(a * b, 1e-12)
                info += total / n * np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) / mass), 0)
        np.fill_diagonal(info, 0)
        # The forest of greatest information (as Chow and Liu have it); pairs under the bound per row of the rarer voter stay apart.
        rate = np.maximum(votes.mean(0), 1e-9)
        strong = info > least * np.minimum(rate[:, None], rate)
        self.parent, self.order, best, link = np.arange(m), [], np.full(m, -1.0), np.arange(m)
        todo = np.ones(m, bool)
        while todo.any():
            i = int(np.argmax(np.where(todo, best, -2)))
            todo[i] = False
            self.order.append(i)
            self.parent[i] = link[i] if best[i] > 0 else i
            better = todo & strong[i] & (info[i] > best)
            best[better], link[better] = info[i][better], i


def label_model(votes: np.ndarray, balance: float = 0.1, rounds: int = 60, forests: int = 3) -> np.ndarray:
    """Posterior of the hidden class for each row of Boolean votes (rows by voters).

    A voter that doesn't fire abstains; one more voter, for the other class, fires where all others abstain. The class
    balance is given; no voter may speak against its own class, whatever the voter that it depends on said.
    """
    n, m = votes.shape
    if not n or not m:
        return np.zeros(n)
    silent = ~votes.any(1)
    v = votes.astype(np.float64)
    posterior = np.where(silent, 0.02, 0.9)
    parent = np.arange(m)
    for _ in range(forests):
        above = v[:, parent]  # a voter without a parent depends on one that never fires
        above[:, parent == np.arange(m)] = 0
        for _ in range(rounds):
            logit = np.full(n, np.log(balance / (1 - balance)))
            for said in (0, 1):
                given = above == said
                on, off = posterior @ (given & votes), (1 - posterior) @ (given & votes)
                on = (on + 0.05) / (posterior @ given + 1)
                off = (off + 0.05) / ((1 - posterior) @ given + (10 if said == 0 else 1))
                logit += (given & votes) @ np.maximum(np.log(on / off), 0)
            quiet = (posterior @ silent + 0.05) / (posterior.sum() + 1), ((1 - posterior) @ silent + 0.05) / ((1 - posterior).sum() + 1)
            logit += silent * min(np.log(quiet[0] / quiet[1]), 0)
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            moved = np.abs(new - posterior).max()
            posterior = new
            if moved < 1e-6:
                break
        found = Forest(v, posterior).parent
        if np.array_equal(found, parent):
            break
        parent = found
    return posterior


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge logistic regression on soft labels; full gradients with steps scaled for each weight."""
    n, m = x.shape
    x = np.column_stack([x, np.ones(n)]).astype(np.float32)
    w, mean, square = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    w[m] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (p - target).astype(np.float32) + penalty * np.where(np.arange(m + 1) < m, w, 0)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.1 * (1 - i / (rounds + 1)) * mean / (1 - 0.9**i) / (np.sqrt(square / (1 - 0.99**i)) + 1e-6)
    return w[:m], float(w[m])


class Model:
    """Presence of features, their weights and the constant."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, constant: float):
        self.presence, self.weights, self.constant = Presence(keys), weights, constant

    def score(self, texts: pa.Array) -> np.ndarray:
        logit = self.presence(texts) @ self.weights + self.constant
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def telling(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The features that tell most for the label: keys, log-odds; and the numbers of toxic and clean rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, keys = features(part.column("text"))
            toxic = part.column("label").to_numpy(zero_copy_only=False).astype(bool)[rows]
            found, inverse = np.unique(keys, return_inverse=True)
            yield record(key=found.view(np.int64), pos=np.bincount(inverse, toxic, len(found)).astype(np.int64), neg=np.bincount(inverse, ~toxic, len(found)).astype(np.int64))

    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    counts = map_batches(sample.select("text", "label"), work, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = (F.col("pos") + 0.5) / (p + 1), (F.col("neg") + 0.5) / (n + 1)
    gain = F.col("pos") * F.log(a / b) + F.col("neg") * F.log(b / a)
    top = counts.filter("pos + neg >= 2").select("key", F.log(a / b).alias("odds"), gain.alias("gain")).filter("odds > 0").orderBy(F.desc("gain"), "key").limit(FEATURES).collect()
    return np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top]), p, n


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Model:
    sample = training_rows(docs, labels, label, limit)
    keys, odds, toxic, clean = telling(sample)
    lexicon = np.array([word_hash(w) for w in LEXICON], np.uint64)
    mined = keys[odds > ODDS][:VOTERS]
    voters = np.unique(np.concatenate((lexicon, mined)))
    keys = np.unique(np.concatenate((keys, voters)))
    presence = Presence(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bits = np.packbits(presence(part.column("text")), axis=1)
            yield record(doc_id=part.column("doc_id"), bits=pa.array([x.tobytes() for x in bits], pa.binary()))

    rows = map_batches(sample.select("doc_id", "text"), work, "doc_id long, bits binary").orderBy("doc_id", "bits").toArrow().column("bits").to_pylist()
    votes = np.searchsorted(keys, voters)
    if not rows:
        return Model(lexicon, np.full(len(lexicon), 4.0), -2.0)
    x = np.unpackbits(np.array([np.frombuffer(r, np.uint8) for r in rows], np.uint8).reshape(len(rows), -1), axis=1)[:, : len(keys)].astype(bool)
    posterior = label_model(x[:, votes], (toxic + 1) / (toxic + clean + 2))
    return Model(keys, *logistic(x, posterior))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            score = model.value.score(part.column("text"))
            yield record(doc_id=part.column("doc_id"), score=score, predicted=(score >= 0.5).astype(np.int32))

    out = map_batches(docs.select("doc_id", "text"), work, "doc_id long, score double, predicted int")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
