"""Toxicity: a word classifier regularised with counterfactual sentences.

A logistic model over the distinct words of a text and the words' first four and five
letters (so that inflections of a word count together), learned from labelled rows.  For
every learning text that names an identity, a counterfactual is made by swapping each
identity term for another of its group; the squared change of the score's log-odds is
penalised, so that a neutral mention of a group carries no weight of its own.  Terms
of one group that were never seen get the group's mean weight.

Learning uses at most ``max_rows`` labelled rows (those with the smallest hash of their
id; 20,000 by default, a documented bound on what the driver holds: about 100 MB) and features
that at least ``min_rows`` of them hold and that tell the classes apart (``min_odds``).  Scoring reads every whole text, without a shuffle; the
model is broadcast (a word and a number for each word learned).

Defined results: a null or empty text, or one without a known word, gets the score of the
model's constant; with no labels, or labels of one kind only, the constant is their
share; repeated words count once; rows with a null id or label are not learned from; repeated rows
and tied ids are scored one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, staged, texts_of, tidy

WORD = re.compile(r"[^\W\d_]+")
MAX_ROWS = 20_000
MIN_ROWS = 4
#: Features whose log-odds between the classes differ by less are left out.
MIN_ODDS = 0.7
#: Lengths of the stems.
STEMS = (4, 5)

#: Terms that name a group of people; the terms of one line are swapped for each other.
IDENTITIES = """
muslim christian jewish hindu buddhist atheist catholic protestant sikh
muslims christians jews hindus buddhists atheists catholics protestants sikhs
islam christianity judaism hinduism buddhism atheism
black white asian hispanic latino indigenous arab african european
gay lesbian straight bisexual queer heterosexual homosexual transgender cisgender
man woman boy girl male female
men women boys girls males females
american british german french spanish mexican chinese indian russian turkish polish italian
americans germans spaniards mexicans indians russians turks poles italians
immigrant immigrants refugee refugees foreigner foreigners
young old elderly teenage
disabled blind deaf autistic
mann frau junge mädchen
männer frauen jungen
christ muslimin jude christin jüdin
homme femme garçon fille
hommes femmes garçons filles
musulman chrétien juif bouddhiste
hombre mujer niño niña
hombres mujeres niños niñas
musulmán cristiano judío budista
""".strip()


def identity_groups() -> list[list[str]]:
    return [line.split() for line in IDENTITIES.split("\n")]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(words: set[str]) -> set[str]:
    """The words, and their stems marked with a star."""
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


def swapped(words: set[str], group_of: dict[str, int], groups: list[list[str]]) -> set[str]:
    """The words with each identity term replaced by another of its group."""
    out = set()
    for w in words:
        n = group_of.get(w)
        if n is None:
            out.add(w)
            continue
        group = groups[n]
        step = 1 + zlib.crc32(w.encode()) % (len(group) - 1)
        out.add(group[(group.index(w) + step) % len(group)])
    return out


@dataclass(frozen=True)
class Model:
    """The constant, and the weights of words (0) and of stems by their length."""

    constant: float
    weights: dict[int, dict[str, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, constant: float, weights: dict[str, float]) -> Model:
        parts: dict[int, dict[str, float]] = {n: {} for n in (0, *STEMS)}
        for name, w in weights.items():
            parts[len(name) - 1 if name.endswith("*") else 0][name.rstrip("*")] = w
        return cls(constant, parts)

    def score(self, text: str) -> float:
        words = words_of(text)
        x = [self.constant]
        for n, weights in self.weights.items():
            own = {w[:n] for w in words if len(w) >= n} if n else words
            x += [weights[w] for w in own & weights.keys()]
        total = math.fsum(x)
        return 1 / (1 + math.exp(-total)) if total > -700 else 0.0


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, and the row of each."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parts).astype(np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def fit(rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, scale: np.ndarray, ridge: float = 0.05, fairness: float = 10.0, rounds: int = 250) -> tuple[float, np.ndarray]:
    """Constant and weights of the regularised logistic model.

    ``rows`` are feature numbers of each text, ``pairs`` those of texts and their
    counterfactuals; ``scale`` says how readily each feature takes a weight.  The rarer
    class weighs more, by the root of the classes' ratio.  Steps are
    Nesterov's, as long as the largest curvature (by power iteration) allows.
    """
    n, m = len(rows), len(scale)
    at, owner = _flat(rows)
    value = scale[at]
    plain, p_owner = _flat([a for a, _ in pairs])
    other, o_owner = _flat([b for _, b in pairs])

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=value * w[at], minlength=n)

    def backward(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=value * x[owner], minlength=m)

    def changes(w: np.ndarray) -> np.ndarray:
        v = w * scale
        return np.bincount(p_owner, weights=v[plain], minlength=len(pairs)) - np.bincount(o_owner, weights=v[other], minlength=len(pairs))

    def penalty(w: np.ndarray) -> np.ndarray:
        change = changes(w)
        return 2 * fairness / len(pairs) * scale * (np.bincount(plain, weights=change[p_owner], minlength=m) - np.bincount(other, weights=change[o_owner], minlength=m))

    direction, curve = np.ones(m) / math.sqrt(max(1, m)), 1.0
    for _ in range(15):
        turned = 0.25 / n * backward(forward(direction)) + (penalty(direction) if pairs else 0)
        curve = float(np.linalg.norm(turned)) or 1.0
        direction = turned / curve
    step = 1 / (1.1 * curve + 0.25 + ridge / n)

    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    heavy = math.sqrt((1 - share) / share)
    weight = np.where(labels > 0, heavy, 1.0)
    weight *= n / weight.sum()
    step /= max(1.0, float(weight.max()))
    w, b = np.zeros(m), 0.5 * math.log(share / (1 - share))
    ahead_w, ahead_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(forward(ahead_w) + ahead_b, -30, 30))) - labels)
        grad = backward(error) / n + ridge / n * ahead_w
        if pairs:
            grad += penalty(ahead_w)
        new_w, new_b = ahead_w - step * grad, ahead_b - step * float(error.mean())
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w = new_w + (before - 1) / t * (new_w - w)
        ahead_b = new_b + (before - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return b, w * scale


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, max_rows: int = MAX_ROWS, min_rows: int = MIN_ROWS) -> Model:
    """Fit the model on labelled rows; ``usable`` (over the labels' columns) says which."""
    own = labels.where(F.lit(True) if usable is None else usable)
    own = own.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    # one and a half times the bound is drawn by hash first, so the choice sorts few rows
    place = F.xxhash64("id")
    share = min(1.0, 1.5 * max_rows / max(1, own.count()))
    drawn = own.where(place.cast("double") <= (2 * share - 1) * 2.0**63) if share < 1 else own
    chosen = drawn.orderBy(place, "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most max_rows rows of two numbers: small enough to broadcast
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [sorted(words_of(t)) for t in texts_of(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(words, pa.list_(pa.string()))], ["id", "label", "words"])

    kind = sample.schema["id"].dataType.simpleString()
    sample = staged(map_batches(sample, split, f"id {kind}, label int, words array<string>"), "sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / max(1, n_toxic + n_clean), 1e-3), 1 - 1e-3)
        return Model.of(math.log(share / (1 - share)), {})

    names = F.flatten(F.transform("words", lambda w: F.array(w, *[F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS])))
    per_row = sample.select("label", F.array_distinct(names).alias("names"))
    seen = per_row.select("label", F.explode("names").alias("name")).where("name is not null").groupBy("name").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("n") - F.col("toxic") + 0.5) / (n_clean + 1)))
    telling = seen.where(F.col("n") >= min_rows).select("name", odds.alias("odds")).where(F.abs("odds") >= MIN_ODDS)
    groups = identity_groups()
    group_of = {w: n for n, g in reversed(list(enumerate(groups))) for w in g}
    scales = {w: 1.0 for w in features(set(group_of))} | {r["name"]: abs(r["odds"]) for r in telling.collect()}
    number = {name: i for i, name in enumerate(sorted(scales))}
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, plain, other = shared.value, [], []
        for words in batch.column("words").to_pylist():
            own = set(words)
            plain.append(_numbers(own, ids))
            other.append(_numbers(swapped(own, group_of, groups), ids) if own & group_of.keys() else None)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(plain, pa.binary()), pa.array(other, pa.binary())], ["id", "label", "plain", "other"])

    found = map_batches(sample, encode, f"id {kind}, label int, plain binary, other binary").orderBy("id", "plain").collect()
    y = np.array([min(1, r["label"]) for r in found], float)
    rows = [np.frombuffer(r["plain"], np.int32) for r in found]
    pairs = [(a, np.frombuffer(r["other"], np.int32)) for a, r in zip(rows, found, strict=True) if r["other"] is not None]
    constant, weights = fit(rows, pairs, y, np.array([scales[name] for name in sorted(scales)]))
    learned = {name: float(weights[i]) for name, i in number.items() if abs(weights[i]) > 1e-3}
    for group in groups:
        known = [learned[w] for w in group if w in learned]
        for w in group:
            if known:
                learned.setdefault(w, math.fsum(known) / len(known))
    return Model.of(constant, learned)


def _numbers(words: set[str], ids: dict[str, int]) -> bytes:
    return np.array(sorted(ids[f] for f in features(words) if f in ids), np.int32).tobytes()


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: ``id``, the columns of ``keep``, ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *(keep or []))
    kept = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole):
                scores = pa.array([m.score(t) for t in texts_of(batch.column("__text"))], pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), scores], [*(f.name for f in kept), "score"])

    return source.mapInArrow(tidy(run), schema)
