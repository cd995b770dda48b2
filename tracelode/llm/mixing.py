"""Mixing to target weights by soft membership.

1. A naive Bayes classifier is fitted on labelled documents (at most `max_labelled`, chosen by a hash of
   doc_id; the bound is the only sampling here). Features are hashed words and hashed word endings; those
   that do not lean towards a domain are left out, so the model has at most 2 * 2**feature_bits rows.
2. Every document gets its domain posteriors, from its whole text.
3. Projected gradient descent fits rates r >= 0 to least squares: the expected tokens of domain k,
   sum of r * tokens * posterior over all documents, shall be `targets[k]` of all tokens. Each step is one
   aggregate of as many sums as there are domains; the driver holds these and nothing else. Steps are
   measured in token weight (a document's gradient is its posteriors times the residuals) and scaled by
   the Barzilai-Borwein rule. Rates start at one, so the fit stays near the corpus as it is. It ends when the
   targets are met, or when a step moves no rate any more (targets that no rates can meet: the least squares
   are reached), or after `rounds`. The result says which: `max_gap` is the largest distance of a domain's
   expected share to its target, `converged` is false if the rounds ran out first.

Spark SQL functions only. Null or empty text: no tokens, posteriors equal to the label shares, a rate
like any other. Null doc_id: a document like any other. Rows that repeat doc_id and text are one row of
the result with their number in n_rows, and weigh as often as they occur. Labels of unknown documents and
null labels are ignored. Without any labelled document there is nothing to learn: the domains are those of
the targets, every document's posteriors are their shares, and every rate is one. No documents: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.columns import words
from tracelode.session import cut_lineage

_ROUNDS_PER_TABLE = 8
# Rows of doc_id and domain that are sent to every task; larger samples are joined as the planner sees fit.
_SENT_LABELS = 200_000


def _bucket(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def _occurrences(docs: DataFrame, bits: int, *keep: str) -> DataFrame:
    """A row for each word: its place, the bucket of the word and of its last two characters."""
    exploded = docs.select(*keep, F.posexplode_outer(words(F.col("text"))).alias("at", "word"))
    return exploded.select(
        *keep,
        F.coalesce("at", F.lit(0)).alias("at"),
        F.when(F.col("word").isNotNull(), _bucket(F.lower("word"), bits)).alias("word_bucket"),
        F.when(F.col("word").isNotNull(), _bucket(F.right(F.col("word"), F.lit(2)), bits)).alias("end_bucket"),
    )


def fit_classifier(
    docs: DataFrame, labels: DataFrame, shares_unlabelled: dict[str, float],
    max_labelled: int = 20000, feature_bits: int = 17, min_z: float = 5.0,
) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Weights per feature bucket (tables `word` and `end`) and the log share of each domain.

    `labels`: doc_id, domain. Features whose count in no domain is `min_z` standard deviations off the
    expected one get no weight. Without labelled documents the domains and shares are `shares_unlabelled`.
    """
    known = labels.filter(F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    sent = F.broadcast(sample) if max_labelled <= _SENT_LABELS else sample
    counted = cut_lineage(
        _occurrences(docs.join(sent, "doc_id"), feature_bits, "domain")
        .select("domain", F.explode(F.array(
            F.struct(F.lit("word").alias("kind"), F.col("word_bucket").alias("bucket")),
            F.struct(F.lit("end").alias("kind"), F.col("end_bucket").alias("bucket")),
        )).alias("f"))
        .filter("f.bucket IS NOT NULL")
        .groupBy("domain", "f.kind", "f.bucket").agg(F.count("*").alias("n"))
    )
    shares = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    shares = shares or shares_unlabelled
    names = sorted(shares)
    total = sum(shares.values())
    sums = {(r["domain"], r["kind"]): r["n"] for r in counted.groupBy("domain", "kind").agg(F.sum("n").alias("n")).collect()}
    tables = {}
    for kind in ("word", "end"):
        mass = {k: float(sums.get((k, kind), 0)) for k in names}
        whole = sum(mass.values()) or 1.0
        wide = counted.filter(F.col("kind") == kind).groupBy("bucket").agg(
            *[F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, k in enumerate(names)]
        )
        both = sum((F.col(f"n_{i}") for i in range(len(names))), F.lit(0))
        leans = F.lit(False)
        weights = []
        for i, k in enumerate(names):
            expected = both * F.lit(mass[k] / whole)
            leans = leans | (F.abs(F.col(f"n_{i}") - expected) >= min_z * F.sqrt(expected + 1))
            share = (F.col(f"n_{i}") + 0.5 * mass[k] / whole) / F.lit(mass[k] + 0.5)
            weights.append(F.log(share / (both / F.lit(whole))).alias(f"w_{i}"))
        tables[kind] = cut_lineage(wide.filter(leans).select(F.col("bucket").alias(f"{kind}_bucket"), *weights))
    return tables, {k: math.log(shares[k] / total) if shares[k] else -math.inf for k in names}


def posteriors(
    docs: DataFrame, model: tuple[dict[str, DataFrame], dict[str, float]], feature_bits: int = 17
) -> DataFrame:
    """doc_id, text_code, n_rows, n_tokens, posterior (array in the order of the domains' names)."""
    tables, priors = model
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_code"), "text")
    found = _occurrences(keyed, feature_bits, "doc_id", "text_code")
    # Both tables hold at most 2**feature_bits rows, whatever the corpus.
    found = found.join(F.broadcast(tables["word"]), "word_bucket", "left")
    ends = tables["end"].select("end_bucket", *[F.col(f"w_{i}").alias(f"e_{i}") for i in range(len(priors))])
    found = found.join(F.broadcast(ends), "end_bucket", "left")
    zero = F.lit(0.0)
    scores = [
        F.sum(F.coalesce(f"w_{i}", zero) + F.coalesce(f"e_{i}", zero)).alias(f"s_{i}") for i in range(len(priors))
    ]
    grouped = found.groupBy("doc_id", "text_code").agg(
        F.sum((F.col("at") == 0).cast("long")).alias("n_rows"), F.count("word_bucket").alias("n_words"), *scores
    )
    logits = [F.col(f"s_{i}") / F.col("n_rows") + F.lit(p) for i, p in enumerate(priors.values())]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = F.array(*[F.exp(x - top) for x in logits])
    summed = F.aggregate(powers, zero, lambda a, x: a + x)
    return grouped.select(
        "doc_id", "text_code", "n_rows", (F.col("n_words") / F.col("n_rows")).cast("long").alias("n_tokens"),
        powers.alias("_powers"), summed.alias("_sum"),
    ).select(
        "doc_id", "text_code", "n_rows", "n_tokens",
        F.transform("_powers", lambda x: x / F.col("_sum")).alias("posterior"),
    )


def fit_rates(members: DataFrame, targets: list[float], rounds: int = 64, tolerance: float = 1e-6) -> DataFrame:
    """`members` with `rate`, `max_gap` and `converged`. Targets are met when every domain is within `tolerance` of all tokens.

    Needs n_tokens, n_rows and posterior; documents weigh tokens times rows.
    """
    size = len(targets)
    state = cut_lineage(members.withColumns({"rate": F.lit(1.0), "_was": F.lit(1.0)}))
    weight = (F.col("n_tokens") * F.col("n_rows")).cast("double")
    part = [F.get("posterior", F.lit(i)) for i in range(size)]
    cross = state.agg(
        F.sum(weight).alias("all"),
        *[F.sum(weight * part[i] * part[j]).alias(f"m_{i}_{j}") for i in range(size) for j in range(size)],
    ).first()
    whole = cross["all"] or 0.0
    if not whole:
        gap = max((abs(t) for t in targets), default=0.0)
        return state.drop("_was").withColumns({"max_gap": F.lit(float(gap)), "converged": F.lit(gap <= tolerance)})
    metric = np.array([[cross[f"m_{i}_{j}"] for j in range(size)] for i in range(size)]) / whole
    goal = np.asarray(targets)
    step, last, moved, converged = 1.0 / float(np.linalg.eigvalsh(metric)[-1]), None, 0.0, False
    for k in range(rounds + 1):
        # One pass gives the domains' tokens and how far the last step has moved the rates.
        sums = state.agg(
            *[F.sum(weight * F.col("rate") * part[i]).alias(f"t_{i}") for i in range(size)],
            F.sum(weight * F.pow(F.col("rate") - F.col("_was"), 2)).alias("way"),
        ).first()
        off = np.array([sums[f"t_{i}"] for i in range(size)]) / whole - goal
        still = last is not None and np.sqrt(sums["way"] / whole) <= tolerance * moved
        converged = bool(np.abs(off).max() <= tolerance or still)
        if converged or k == rounds:
            break
        if last is not None:
            change = off - last
            curve = -moved * float(last @ metric @ change)
            if curve > 0:
                step = moved * moved * float(last @ metric @ last) / curve
        pull = sum((part[i] * float(step * off[i]) for i in range(size)), F.lit(0.0))
        state = state.withColumns({"_was": F.col("rate"), "rate": F.greatest(F.lit(0.0), F.col("rate") - pull)})
        last, moved = off, step
        if (k + 1) % _ROUNDS_PER_TABLE == 0:
            state = cut_lineage(state)
    return state.drop("_was").withColumns({"max_gap": F.lit(float(np.abs(off).max())), "converged": F.lit(converged)})


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **fit) -> DataFrame:
    """doc_id, n_rows, n_tokens, p_<domain> for each domain of the labels, rate, max_gap, converged.

    `targets`: share of all tokens by domain, one above zero at least; domains without a target get zero. Other columns
    of `docs` are not used.
    """
    plain = docs.select("doc_id", "text")
    model = fit_classifier(plain, labels.select("doc_id", "domain"), targets, **fit)
    names = list(model[1])
    members = posteriors(plain, model, fit.get("feature_bits", 17))
    rated = fit_rates(members, [float(targets.get(k, 0.0)) for k in names])
    return rated.select(
        "doc_id", "n_rows", "n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(names)], "rate", "max_gap", "converged",
    )
