"""Toxicity by weak supervision.

Voters.  A voter fires on a row or abstains, and speaks for one class:
- a fixed lexicon of insults, one voter each (toxic);
- patterns: any insult, an insult close behind "you", two insults in a sentence,
  "shut up", shouted words (toxic); long texts without
  an insult or shouting, thanks and licence wording, figures (clean);
- words and word beginnings of 4 to 7 letters, once or more often in a text, mined
  from labelled rows by how much more often one class holds them (toxic or clean).

Label model.  A generative model of the true class and the votes: each voter has a
firing rate in either class (its accuracy), and a tree of pairwise factors, the
spanning tree of most mutual information given the class, holds the voters'
correlations: a voter that copies another adds no evidence.  No voter that
fires speaks against its class, and silence of a clean voter is no evidence.  Expectation
maximisation fits it to the votes of the fitting rows alone; the labels give the class
prior, and serve to mine voters, but no row's own label is a vote on it.

Classifier.  Logistic regression on the logarithms of the voters' counts, trained
on the model's posteriors; it scores every whole text.

Fitting uses at most FIT_ROWS labelled documents, those with the smallest hash of
their doc_id, and never a held-out row (crc32 of the doc_id as text, mod 5, is 0; a null
doc_id counts as held out).  labels, lang, source and doc_id are no input of a
score.  Null and empty texts get the score of a text without votes.  Without usable
labels insults alone decide.  A doc_id with several labels counts as toxic if one
says so; one with several texts is fitted on one of them, and each of its rows is
scored.  Repeated rows get equal scores.  Other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import row_key, save

FIT_ROWS = 6_000
MAX_VOTERS = 200
MAX_CLEAN_VOTERS = 40
CACHE_WORDS = 200_000
# The built-in lexicon.
LEXICON = ("clown", "disgusting", "fool", "garbage", "idiot", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
_LETTERS = re.compile(r"[^\W\d_]+")
_INSULT = "(?:" + "|".join(LEXICON) + ")"
THANKS = ("please", "thank", "thanks", "sincerely", "license", "licence", "copyright")
_WORDS = dict.fromkeys(LEXICON, "x:insult") | dict.fromkeys(THANKS, "x:thanks") | {"shut": "x:shut up"}
_FIGURE = re.compile(r"\W*\d+(?:[.,]\d+)?\W*")
_SHOUTED = re.compile(r"[A-Z]{3,}")
#: Pattern voters of single words: a shouted word is one of those after the first two.
WORDLY = ("x:thanks", "x:figures", "x:shouts")
#: Those that only a text with the word "shut", or with insults, needs.
SHUT_UP = re.compile(r"(?i)\bshut\s+up\b")
NEAR_INSULTS = {
    "x:you insult": re.compile(rf"(?i)\byou(?:r|rs|rself)?\b[^.!?\n]{{0,60}}\b{_INSULT}\b"),
    "x:two insults": re.compile(rf"(?i)\b{_INSULT}\b[^.!?\n]{{0,200}}\b{_INSULT}\b"),
}
#: Fires on texts of at least as many words without an insult or shouting.
PLAIN, PLAIN_WORDS = "x:plain", 30
INSULT = "x:insult"
CLEAN = {"x:thanks", "x:figures", PLAIN}


def held_out():
    """crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0


def _features(word: str) -> list[str]:
    return ["w:" + word, *(f"p:{word[:k]}" for k in (4, 5, 6, 7) if len(word) > k)]


#: A feature's voters: that fire where it occurs once, and (their number before the
#: feature's name) at least so often.
OFTEN = (2, 4)


def _feature_of(voter: str) -> tuple[str, int]:
    return (voter[1:], int(voter[0])) if voter[0].isdigit() else (voter, 1)


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray
    bias: float
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    parents: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(counts) @ self.weights + self.bias, -30, 30)))


class _Votes(dict):
    """Raw token (bytes between white space) to the voters that its words fire."""

    def __init__(self, voters: list[str]):
        self.index: dict[str, int] = {}
        for v in voters:
            self.index.setdefault(_feature_of(v)[0], len(self.index))
        self.columns = np.array([self.index[_feature_of(v)[0]] for v in voters], int)
        self.spared = np.array([_feature_of(v)[1] - 1 for v in voters], float)

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        raw = token.decode("utf-8", "replace")
        plain = raw.isalpha()
        words = [raw.lower()] if plain else _LETTERS.findall(raw.lower())
        fired = [f for w in words for f in _features(w)] + [_WORDS[w] for w in words if w in _WORDS]
        if not plain:
            fired += ["x:figures"] * bool(_FIGURE.fullmatch(raw))
        if not raw.islower():
            fired += ["x:shouts" for _ in _SHOUTED.finditer(raw)]
        out = tuple(self.index[f] for f in fired if f in self.index)
        if len(token) <= 100:
            self[token] = out
        return out


def _counts(texts: list[bytes | None], votes: _Votes) -> np.ndarray:
    """How often each voter fires on each text."""
    out = np.zeros((len(texts), len(votes.index)))
    index = votes.index
    for i, raw in enumerate(texts):
        tokens = raw.split() if raw else ()
        for fired in filter(None, map(votes.__getitem__, tokens)):
            for j in fired:
                out[i, j] += 1
        at = lambda name: out[i, index[name]] if name in index else 0
        insults, shut = at(INSULT), at("x:shut up")
        if insults or shut:
            text = raw.decode("utf-8", "replace")
            for name, pattern in (NEAR_INSULTS if insults else {}).items():
                if name in index:
                    out[i, index[name]] = sum(1 for _ in pattern.finditer(text))
            if shut:
                out[i, index["x:shut up"]] = sum(1 for _ in SHUT_UP.finditer(text))
        if "x:shouts" in index:
            out[i, index["x:shouts"]] = max(out[i, index["x:shouts"]] - 2, 0)
        if PLAIN in index:
            out[i, index[PLAIN]] = len(tokens) >= PLAIN_WORDS and not insults and not at("x:shut up") and not at("x:shouts")
    return np.maximum(out[:, votes.columns] - votes.spared, 0)


def fitting_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return mine.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def mine_voters(sample: DataFrame, most: int = MAX_VOTERS, most_clean: int = MAX_CLEAN_VOTERS) -> tuple[list[str], set[str]]:
    """All voters, and those of them that speak for the clean class: the lexicon, the
    patterns, and the words and beginnings that mark one class best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(f for w in _LETTERS.findall((text or "").lower()) for f in _features(w))
                found[1 if toxic else 0].update(own.keys())
                found[1 if toxic else 0].update(f"{k}{f}" for f, n in own.items() for k in OFTEN if n >= k)
        for toxic, own in found.items():
            keys = list(own)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                n = pa.array([own[k] for k in part], pa.int64())
                zero = pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part), *((zero, n) if toxic else (n, zero))], ["feature", "clean", "toxic"])

    fixed = [INSULT, "x:shut up", *WORDLY, *NEAR_INSULTS, PLAIN, *("w:" + w for w in LEXICON)]
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sum(v for k, v in n.items() if k), n.get(0, 0)
    if not bad or not good:
        return fixed, CLEAN
    counts = sample.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = save(counts, "toxic-words")
    p, q = F.col("toxic") / F.lit(bad), (F.col("clean") + 1) / F.lit(good)
    # The difference of the two rates, in standard errors.
    z = (p - q) / F.sqrt((F.col("clean") + 1) / F.lit(good**2) + (F.col("toxic") + 1) / F.lit(bad**2))
    top = counts.where((F.col("toxic") >= max(4, 0.025 * bad)) & (p > 60 * q)).select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(most).collect()
    low = counts.where((F.col("clean") >= 0.02 * good) & (q > 3 * p)).select("feature", z.alias("z")).orderBy("z", "feature").limit(most_clean).collect()
    clean = {r["feature"] for r in low} - set(fixed)
    return fixed + [r["feature"] for r in top if r["feature"] not in fixed] + sorted(clean), CLEAN | clean


def _tree(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each voter's parent in the spanning tree of most mutual information given the
    class (Prim); -1 for the root.  ``weight`` (2, rows): the class of each row."""
    n = votes.shape[1]
    gain = np.zeros((n, n))
    for w in weight:
        total = w.sum() + 1
        one = (w @ votes + 0.5) / total
        both = ((votes * w[:, None]).T @ votes + 0.25) / total
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = one if a else 1 - one, one if b else 1 - one
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.maximum(joint, 1e-9)
                gain += total * joint * np.log(joint / np.maximum(np.outer(pa_, pb), 1e-12))
    parents, best, open_ = np.full(n, -1), gain[0].copy(), np.ones(n, bool)
    link = np.zeros(n, int)
    open_[0] = False
    for _ in range(n - 1):
        j = int(np.where(open_, best, -np.inf).argmax())
        parents[j], open_[j] = link[j], False
        nearer = open_ & (gain[j] > best)
        best[nearer], link[nearer] = gain[j][nearer], j
    return parents


def fit_label_model(votes: np.ndarray, prior: float, clean: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes (rows, voters) 0/1, the class prior, and which voters speak for the clean
    class.  Posterior of "toxic" for each row, firing rates (2, voters) by class, and
    the tree of pairwise factors (parent of each voter)."""
    n = votes.shape[1]
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    start = np.log(prior / (1 - prior)) + votes @ np.where(clean, -1.0, 2.5)
    post = 1 / (1 + np.exp(-np.clip(start, -8, 8)))
    parents = np.full(n, -1)
    for turn in range(rounds):
        weight = np.stack([1 - post, post])
        if turn in (0, 3):  # once more when the classes have settled
            parents = _tree(votes, weight)
        rates = (weight @ votes + 0.1) / (weight.sum(1)[:, None] + 2)
        given = votes[:, parents]  # a root has its own vote as parent, unused
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        for state in (0.0, 1.0):
            here = given == state
            # Firing rates given the parent's vote, shrunk towards the voter's own.
            fire = (weight @ (votes * here) + 4 * rates) / (weight @ here + 4)
            fire = np.clip(np.where(parents < 0, rates, fire), 1e-4, 1 - 1e-4)
            says = np.log(fire[1] / fire[0])
            silence = np.log((1 - fire[1]) / (1 - fire[0]))
            # A voter that fires never speaks against its class; a silent one speaks
            # for the other, but for those of the clean class, which short texts don't fire.
            odds += (votes * here) @ np.where(clean, np.minimum(says, 0), np.maximum(says, 0))
            odds += ((1 - votes) * here) @ np.where(clean, 0, np.minimum(silence, 0))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rates, parents


def fit_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 0.01
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def votes_of(sample: DataFrame, voters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows, voters) and labels of the fitting rows, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = _Votes(voters)
        for batch in batches:
            counts = _counts(batch.column(0).cast(pa.binary()).to_pylist(), votes)
            yield pa.RecordBatch.from_arrays([pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary()), batch.column(1)], ["counts", "toxic"])

    rows = sample.mapInArrow(run, "counts binary, toxic int").collect()  # FIT_ROWS at most
    rows.sort(key=lambda r: (bytes(r["counts"]), r["toxic"]))
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), "<u4").reshape(len(rows), -1 if rows else len(voters)).astype(float)
    return counts, np.array([1 if r["toxic"] else 0 for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    sample = save(fitting_rows(docs, labels, rows), "toxic-sample")
    voters, clean = mine_voters(sample)
    counts, known = votes_of(sample, voters)
    if not len(known) or known.min() == known.max():
        weights = np.array([4.0 if v == INSULT else 0.0 for v in voters])
        return Model(voters, weights, -2.0)
    post, rates, parents = fit_label_model((counts > 0).astype(float), known.mean(), np.array([v in clean for v in voters]))
    weights, bias = fit_classifier(np.log1p(counts), post)
    return Model(voters, weights, bias, rates, parents)


def score(docs: DataFrame, model: Model, keyed: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; with ``keyed`` also
    key_a and key_b (``row_key``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        votes = _Votes(model.voters)
        for batch in batches:
            scores = model.scores(_counts(batch.column(2).cast(pa.binary()).to_pylist(), votes))
            own = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "held_out", "score", "predicted", "key_a", "key_b"][: len(own)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *(row_key() if keyed else []))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + (", key_a long, key_b long" if keyed else ""))
