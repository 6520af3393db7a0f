"""Toxicity by weak supervision: many lexicon and pattern voters, a label model, a linear classifier.

A text is seen as the set of its words and word beginnings (lower-cased; prefixes of `PREFIXES` bytes). Voters are
found on a bounded sample of labelled texts (`PER_CLASS` of each label, by a hash of the id): words of a fixed lexicon, mined words and
beginnings that are frequent in toxic texts and rare in others (the best `CANDIDATES` of the sample), chosen so that most toxic texts meet several, and
two patterns (a text that meets three voters' grams; a text without any suspicious gram, which votes the other way).

The label model is generative: EM finds the class share and each voter's chance to vote or abstain on either class; voters that
still agree within a class are correlated, and a voter of a group of k correlated ones weighs 1/k of its evidence. A ridge logistic regression on the presence of `FEATURES` grams is trained on the posteriors and
calibrated to the labels' true shares. It scores every text whole.

Defined cases: a null text is empty and scored by the intercept; without texts of both labels every score is
the share of label 1 (0 without labels); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from citegraph.llm.common import WORD_BYTES, fit_logistic, hash_spans, held_out, labelled_sample, mix, pieces, segment, sigmoid, text_bytes, word_hash
from citegraph.session import cut_lineage

PER_CLASS = 2500
PREFIXES = (3, 4, 5, 6, 7, 8)
VOTERS = 96
DEPTH = 4
FEATURES = 600
THRESHOLD = 0.3
#: Correlation of two voters over all texts that makes them the same voter, and within a class that makes them related.
SAME, RELATED = 0.8, 0.5
#: Grams that may become voters or features: those that tell the classes apart best in the sample (and the lexicon).
CANDIDATES = 4000
_U = np.uint64
#: Words that vote wherever they occur, in the languages of the corpus.
LEXICON = (
    "bastard clown coward creep disgusting dumb fool freak garbage hate idiot imbecile jerk kill liar loser moron pathetic pig "
    "scum shut stupid sucker trash ugly useless vermin worthless wretch "
    "abruti connard crétin débile imbécile ordure pourriture salaud "
    "abschaum arschloch dreck dummkopf idiotin schwachkopf trottel widerlich "
    "asqueroso basura cabrón escoria estúpido imbécil inútil patético"
).split()


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every different word and word beginning of each row; a beginning is told from a word."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends = segment(data, offsets, WORD_BYTES[data])
    row = np.searchsorted(offsets, starts, "right") - 1
    words = hash_spans(data, starts, ends)
    # Equal words of a row are seen once.
    order = np.lexsort((words, row))
    keep = np.ones(len(order), bool)
    keep[1:] = (row[order][1:] != row[order][:-1]) | (words[order][1:] != words[order][:-1])
    at = order[keep]
    row, starts, ends = row[at], starts[at], ends[at]
    rows, hashes = [row], [words[at]]
    for k in PREFIXES:
        longer = ends - starts >= k
        rows.append(row[longer])
        hashes.append(mix(hash_spans(data, starts[longer], starts[longer] + k) + _U(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def incidence(rows: np.ndarray, hashes: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """(n, len(wanted)) booleans: which of the sorted `wanted` hashes each row has."""
    out = np.zeros((n, len(wanted)), bool)
    if not len(wanted) or not len(hashes):
        return out
    near = np.zeros(1 << 16, bool)
    near[(wanted & _U(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(near[(hashes & _U(0xFFFF)).astype(np.int64)])
    h = hashes[maybe]
    place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    found = wanted[place] == h
    out[rows[maybe[found]], place[found]] = True
    return out


def choose_voters(has: np.ndarray, y: np.ndarray) -> list[int]:
    """Columns of `has`, taken greedily: toxic texts that meet fewer than `DEPTH` voters so far count, others count against."""
    toxic, clean = has[y == 1], has[y == 0]
    rate = len(toxic) / max(len(clean), 1)
    cost = clean.sum(axis=0) * rate
    covered = np.zeros(len(toxic))
    chosen: list[int] = []
    for _ in range(VOTERS):
        worth = np.clip(DEPTH - covered, 0, None) / DEPTH
        gain = worth @ toxic - 3 * cost
        gain[chosen] = -np.inf
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] < 2.0:
            break
        chosen.append(best)
        covered += toxic[:, best]
    return chosen


@dataclass
class LabelModel:
    """P(toxic), chances of a vote on clean and toxic texts, and each voter's share of independent evidence."""

    prior: float
    chance: np.ndarray  # (2, voters)
    weight: np.ndarray

    def accuracy(self) -> np.ndarray:
        """How often a vote against a text is right, per voter."""
        hit = self.chance[1] * self.prior
        return hit / (hit + self.chance[0] * (1 - self.prior))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) per text; an abstention counts as what it is, one minus the chance of a vote."""
        yes, no = np.log(self.chance[1] / self.chance[0]), np.log((1 - self.chance[1]) / (1 - self.chance[0]))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + (no * self.weight).sum() + votes @ ((yes - no) * self.weight))


def _correlations(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Correlations of the columns of `v` over rows weighted by `p`; 0 where a column does not vary."""
    total = max(p.sum(), 1e-9)
    rest = v - (p @ v) / total
    cov = (rest * p[:, None]).T @ rest / total
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    # A column that (nearly) never varies within the rows says nothing about correlation.
    steady = spread < np.sqrt(5.0 / total)
    out = cov / np.maximum(np.outer(spread, spread), 1e-12)
    out[steady] = 0
    out[:, steady] = 0
    np.fill_diagonal(out, 0)
    return out


def _shares(linked: np.ndarray) -> np.ndarray:
    """One over the size of each column's group of linked columns."""
    group = np.arange(len(linked))
    while True:
        least = np.where(linked, group[None], len(group)).min(axis=1, initial=len(group))
        new = np.minimum(group, least)
        if (new == group).all():
            return 1.0 / np.bincount(group, minlength=len(group))[group]
        group = new


def _em(v: np.ndarray, direction: np.ndarray, prior: float, weight: np.ndarray, rounds: int) -> LabelModel:
    start = np.where(direction == 1, np.array([[0.002], [0.15]]), np.array([[0.8], [0.1]]))
    model = LabelModel(prior, start, weight)
    for _ in range(rounds):
        p = model.posterior(v)
        chance = np.stack([((1 - p) @ v + start[0]) / ((1 - p).sum() + 1), (p @ v + start[1]) / (p.sum() + 1)])
        # A voter never counts against its own direction.
        low, high = np.minimum(chance[0], chance[1]), np.maximum(chance[0], chance[1])
        chance = np.clip(np.where(direction == 1, np.stack([low, high]), np.stack([high, low])), 1e-5, 1 - 1e-5)
        new = LabelModel(float(np.clip(p.mean(), 1e-3, 1 - 1e-3)), chance, weight)
        if abs(new.prior - model.prior) < 1e-7 and np.abs(new.chance - model.chance).max() < 1e-6:
            return new
        model = new
    return model


def fit_label_model(votes: np.ndarray, direction: np.ndarray, prior: float, rounds: int = 200) -> LabelModel:
    """EM over (texts, voters) booleans; `direction` is 1 for voters against a text, 0 for those in its favour.

    Voters whose votes are all but the same count as one from the start, or the class would become what they have in common.
    After a first fit, voters that are correlated among the texts of one class are grouped, a voter of a group
    of k weighs 1/k, and the chances are fitted once more.
    """
    v = votes.astype(float)
    same = _correlations(v, np.ones(len(v))) > SAME
    model = _em(v, direction, prior, _shares(same), rounds)
    p = model.posterior(v)
    related = np.maximum(_correlations(v, p), _correlations(v, 1 - p)) > RELATED
    return _em(v, direction, prior, _shares(same | related), rounds)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # one per feature, and the intercept
    share: float

    def score(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        if not len(self.features):
            return np.full(n, self.share)
        return sigmoid(incidence(rows, hashes, self.features, n) @ self.weights[:-1] + self.weights[-1])


def train(has: np.ndarray, hashes: np.ndarray, y: np.ndarray, share: float) -> Model:
    """From the sample's incidence of candidate grams (columns `hashes`, sorted) to the linear model."""
    chosen = choose_voters(has, y)
    lexicon = set(np.flatnonzero(np.isin(hashes, word_hash(LEXICON))))
    voters = np.array([*chosen, *sorted(lexicon - set(chosen))], int)
    none = Model(np.zeros(0, _U), np.zeros(0), share)
    if not len(voters):
        return none
    hit = has[:, voters]
    votes = np.column_stack([hit, hit.sum(axis=1) >= 3, hit.sum(axis=1) == 0])
    direction = np.array([1] * (hit.shape[1] + 1) + [0])
    label_model = fit_label_model(votes, direction, float(y.mean()))
    p = label_model.posterior(votes.astype(float))
    # Grams that go most with the posterior, the voters' own among them.
    rate = [(w @ has + 0.5) / (w.sum() + 1) for w in (p, 1 - p)]
    strength = np.abs(np.log(rate[0] / rate[1])) * np.sqrt(has.sum(axis=0))
    strength[voters] = np.inf
    top = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    x = has[:, top].astype(float)
    weights = fit_logistic(x, p, ridge=2e-4)
    # Calibration on the labels: slope and offset, then from the sample's share to the labels'.
    raw = x @ weights[:-1] + weights[-1]
    slope, offset = fit_logistic(raw[:, None], y.astype(float), ridge=1e-3)
    slope = max(slope, 0.05)
    drawn = y.mean()
    offset += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Model(hashes[top], np.append(weights[:-1] * slope, weights[-1] * slope + offset), share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    sample = cut_lineage(labelled_sample(docs, labels, "toxic", PER_CLASS, id_col, text))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                own, hashes = grams_of(part.column("text"))
                listed = [np.unique(hashes[own == i]).view(np.int64) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(listed, pa.list_(pa.int64()))], ["doc_id", "label", "grams"])

    rated = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("t")).where(~held_out(F.col("doc_id")))
    share = rated.where("t IN (0, 1)").agg(F.avg("t")).first()[0]
    share = 0.0 if share is None else float(share)
    seen = cut_lineage(sample.mapInArrow(rows, "doc_id long, label int, grams array<long>"))
    # Candidates are counted in Spark: grams of enough toxic texts, more common there than elsewhere, and the lexicon.
    size = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(0, _U), np.zeros(0), share)
    if not size.get(0) or not size.get(1):
        return none
    counts = seen.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    lexicon = [int(h) for h in word_hash(LEXICON).view(np.int64)]
    rare, lift = max(3.0, 0.004 * size[1]), (F.col("t") + 0.5) / size[1] / ((F.col("c") + 0.5) / size[0])
    best = counts.where(((F.col("t") >= rare) & (lift >= 2.0)) | F.col("gram").isin(lexicon)).withColumn("lift", F.log(lift) * F.sqrt("t"))
    kept = cut_lineage(best.orderBy(F.desc("lift"), "gram").limit(CANDIDATES).select("gram"))
    # Only the candidates' incidence comes to the driver: at most 2 * PER_CLASS texts.
    pairs = seen.select("doc_id", F.explode("grams").alias("gram")).join(F.broadcast(kept), "gram").toArrow()
    ids = seen.select("doc_id", "label").orderBy("doc_id").toArrow()
    doc, y = ids.column("doc_id").to_numpy(), ids.column("label").to_numpy()
    gram = pairs.column("gram").to_numpy().view(_U)
    hashes = np.unique(gram)
    has = np.zeros((len(doc), len(hashes)), bool)
    has[np.searchsorted(doc, pairs.column("doc_id").to_numpy()), np.searchsorted(hashes, gram)] = True
    return train(has, hashes, y, min(max(share, 1e-4), 1 - 1e-4))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    model = fit(docs, labels, id_col, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                value = model.score(*grams_of(part.column("text")), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    doc_id = F.col(id_col).cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
