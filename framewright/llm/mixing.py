"""Mixing to target weights by soft membership.

A classifier fitted on the labelled rows (a bounded sample of each domain) gives every document posteriors over the
domains. Rates r >= 0 of the documents are fitted so that the expected tokens of the domains, the sums of rate times
tokens times posterior, match the targets: projected-gradient least squares, started at rate 1, whose every step is one
aggregation over all documents to as many numbers as there are domains. Steps are scaled by the documents' tokens, so a
rate depends on the posteriors alone, and squares are weighted by the inverse of the domains' Gram matrix, so that
overlapping domains are told apart at once: one step meets targets that need no rate at its bound. Posteriors are kept in
the shared folder; texts are read once. Tokens are the greedy pieces of a public vocabulary, counted by the automaton
of wordpiece.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.llm import linear, wordpiece
from framewright.llm import textkit as tk
from framewright.llm.common import Workspace, unused

LOG = logging.getLogger(__name__)
BITS, SIZES = 14, ((3,), ())
SAMPLE_ROWS = 500  # labelled rows per domain at most
TOLERANCE, STAGNATION = 1e-4, 1e-3  # share of tokens off target; least fall of the squared gaps in a step
ROUNDING = 1e-9  # share of the first squared gap below which a fall is no fall
ROUNDS = 200  # steps at most: a fall by STAGNATION each would have met any target long before


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray  # (1, buckets, domains)
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return linear.softmax(linear.scores(data, offsets, self.weights, BITS, SIZES) + self.bias)


@dataclass
class Membership:
    """A table with one column of tokens and one of posteriors for each domain, under names that its others don't have."""

    table: DataFrame
    tokens: str
    posteriors: list[str]


def fit_domains(docs: DataFrame, labels: DataFrame, names: list[str], column: str = "lang") -> Domains:
    """The classifier of the named domains, from labelled documents whose column names their domain.

    At most SAMPLE_ROWS documents a domain, of at most linear.SAMPLE_BYTES, in the order of a hash of doc_id.
    """

    def fit(sample: list[tuple[int, str, str]]) -> Domains:
        if not sample:
            return Domains(names, np.zeros((1, 1 << BITS, len(names))), np.zeros(len(names)))
        y = np.array([names.index(d) for _, d, _ in sample])
        w, bias = linear.fit([t for _, _, t in sample], y, len(names), BITS, sizes=SIZES)
        return Domains(names, w.astype(np.float32), bias)

    return linear.fitted(linear.domain_sample(docs, labels, names, column, SAMPLE_ROWS), fit)


def with_posteriors(docs: DataFrame, domains: Domains, path: str) -> Membership:
    """docs with their texts' tokens and posteriors in further columns."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((domains, wordpiece.automaton(path)))  # buckets * domains weights, and the vocabulary
    tokens, *posteriors = unused(docs.columns, "n_tokens", *[f"posterior_{i}" for i in range(len(domains.names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, machine = shared.value
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                data, offsets = tk.raw(part.column("text"))
                p = own.posteriors(data, offsets)
                starts, ends, rows = tk.runs(~tk.is_space(data), offsets)
                found = machine.pieces(data, starts, ends)
                n = np.bincount(rows, weights=np.where(found < 0, 1, found), minlength=part.num_rows).astype(np.int64)
                columns = {c: part.column(i) for i, c in enumerate(part.schema.names)}
                yield pa.RecordBatch.from_pydict(columns | {tokens: pa.array(n, pa.int64())} | {c: pa.array(p[:, i]) for i, c in enumerate(posteriors)})

    schema = StructType(list(docs.schema.fields)).add(tokens, "long")
    for c in posteriors:
        schema = schema.add(c, "double")
    return Membership(docs.mapInArrow(run, schema), tokens, posteriors)


def fit_rates(m: Membership, targets: list[float], least: float = 0.0) -> tuple[Column, list[float]]:
    """The rate as an expression over the posteriors, and the share of tokens that is off target before each step.

    Of the tokens, targets (normalised) is the share that each domain gets. No rate falls below least. Steps end within
    TOLERANCE, or when they no longer help (the squares fall by too little, are 0 or aren't numbers), or after ROUNDS;
    the last share is the rate's own. Posteriors that aren't numbers leave the rate at 1 and the share NaN.
    """
    k = len(targets)
    p, tokens = [F.col(c) for c in m.posteriors], F.col(m.tokens)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total, *found = m.table.agg(F.sum(tokens), *[F.sum(tokens * p[i] * p[j]) for i, j in pairs]).first()
    total = float(total or 0)
    rate, gaps = F.lit(1.0), []
    if not total:
        return rate, gaps
    share = np.array(targets, float) / sum(targets)
    gram = np.zeros((k, k))
    for (i, j), g in zip(pairs, found, strict=True):
        gram[i, j] = gram[j, i] = g
    if not np.isfinite(gram).all():
        return rate, [float("nan")]
    weight = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)  # of the squares: a step of length one can't overshoot
    moves, first, before = [], 0.0, float("inf")
    while True:
        now = m.table.select(*[c.alias(f"p{i}") for i, c in enumerate(p)], (tokens * rate).alias("t"))
        sums = now.agg(*[F.sum(F.col("t") * F.col(f"p{i}")) for i in range(k)]).first()
        gap = np.array(sums, float) - share * total
        gaps.append(float(np.abs(gap).sum() / total))
        square = max(float(gap @ weight @ gap), 0.0)  # rounding makes it negative where the Gram matrix is singular
        first = first if moves else square
        falls = before - square > max(STAGNATION * min(before, square), ROUNDING * first)  # False where anything is NaN
        if gaps[-1] < TOLERANCE or not square > 0 or not falls or len(moves) >= ROUNDS:
            break
        before = square
        moves.append(F.array(*[F.lit(float(x)) for x in weight @ gap]))
        # a loop within the expression, as nested ones would be too deep after many steps
        rate = F.aggregate(F.array(*moves), F.lit(1.0), lambda r, x: F.greatest(F.lit(least), r - sum((x[i] * c for i, c in enumerate(p)), F.lit(0.0))))
    return rate, gaps


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], path: str, column: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (of the highest posterior), rate, gap.

    gap is the same in all rows: the share of the tokens that these rates leave off target, NULL without any tokens.
    path is a tokenizer file, read on the driver.

    docs has doc_id, text and the domain column, which is read for labelled rows only; labels has doc_id. NULL and
    empty texts have no tokens and take the rate that their posteriors, the prior ones, get; texts of any length are
    read whole. Equal posteriors get equal rates; between domains of equal posterior the last in alphabetical order is
    named. Without labelled rows all posteriors are equal. A NULL doc_id or domain is as good as another, but isn't
    learnt from. Repeated rows count each; an empty table gives an empty result; other columns are not read, whatever
    their names.
    """
    domains = fit_domains(docs, labels, sorted(targets), column)
    m = with_posteriors(docs.select("doc_id", "text"), domains, path)
    m.table = Workspace(docs.sparkSession, "mixing").keep(m.table.drop("text"))
    rate, gaps = fit_rates(m, [targets[d] for d in domains.names])
    best = F.greatest(*[F.struct(F.col(c).alias("p"), F.lit(d).alias("domain")) for c, d in zip(m.posteriors, domains.names, strict=True)]) if len(domains.names) > 1 else F.struct(F.lit(domains.names[0]).alias("domain"))
    gap = F.lit(gaps[-1] if gaps else None).cast("double")
    return m.table.select("doc_id", F.col(m.tokens).alias("n_tokens"), best["domain"].alias("domain"), rate.alias("rate"), gap.alias("gap"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], path: str, column: str = "lang") -> DataFrame:
    """The rows of docs, each as often as its rate says: all columns of docs, whole texts.

    Rates are scaled so that the lowest is 1: the mix is reached by repeating documents of domains that have too little,
    and no document goes. A domain that had all tokens would need its share as rate, so no rate is let fall below the
    lowest share above 0, and the result has at most one over that share times the tokens, where the targets are met;
    where they can't be, a warning in the log names the share of tokens that stays off target. A rate's fraction
    becomes a copy for the documents whose hash falls below it.

    NULL and empty texts and NULL ids stay, with the rate of their posteriors; texts of any length are read whole;
    repeated rows are mixed one by one, all alike, as their hashes tie; an empty table gives an empty one; columns of
    any name pass through.
    """
    domains = fit_domains(docs, labels, sorted(targets), column)
    m = with_posteriors(docs, domains, path)
    m.table = Workspace(docs.sparkSession, "mixing").keep(m.table)
    least = min((t for t in targets.values() if t > 0), default=0.0) / (sum(targets.values()) or 1.0)
    rate, gaps = fit_rates(m, [targets[d] for d in domains.names], least)
    if gaps and gaps[-1] >= TOLERANCE:
        LOG.warning("the mix leaves %.5f of the tokens off target", gaps[-1])
    scale = 1 / (m.table.agg(F.min(rate)).first()[0] or 1.0)
    fraction = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(rate * scale + F.lit(1e-9) + fraction).cast("int")
    (copy,) = unused(docs.columns, "copy")
    return m.table.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).drop(copy)
