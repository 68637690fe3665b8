"""Scoring predictions against references.

BLEU and ROUGE rest on counts that concern one pair at a time. Tokens are made
in the JVM, the counts in one vectorised Arrow pass per batch, and a corpus
score is a sum over rows: the pair table itself is never shuffled, and what is
sent to the final aggregate is one row of sums per task and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scoring import bleu_tokens, gram_total, overlap_counts, rouge_tokens
from corpusloom.functions.text import strip

BLEU_ORDERS = (1, 2, 3, 4)
ROUGE_ORDERS = (1, 2)


def extract_pairs(samples: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """(id, input, prediction, reference): samples joined with predictions on the id.

    The reference text is ``output``, or ``label`` where the table has no such
    column; the input is ``input``, or else ``text``.
    """

    def first_of(*names: str) -> Column:
        for name in names:
            if name in samples.columns:
                return F.col(name).cast("string")
        return F.lit("")

    wanted = samples.select(
        id_col, first_of("input", "text").alias("input"), first_of("output", "label").alias("reference")
    )
    return wanted.join(predictions.select(id_col, "prediction"), id_col)


def _f_measure(match: Column, mine: Column, theirs: Column) -> Column:
    """Harmonic mean of match/mine and match/theirs; 0 where nothing matches."""
    return F.when(match > 0, 2.0 * match / (mine + theirs)).otherwise(F.lit(0.0))


#: Columns with the tokens of the references, for :func:`pair_scores`.
REFERENCE_TOKENS = ("bleu_reference", "rouge_reference")


def reference_tokens(samples: DataFrame, reference: str = "reference") -> DataFrame:
    """Adds the tokens of the references, so that several models' predictions share them; unread ones cost nothing."""
    makers = zip(REFERENCE_TOKENS, (bleu_tokens, rouge_tokens), strict=True)
    return samples.withColumns({name: make(F.col(reference)) for name, make in makers})


def pair_scores(
    pairs: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    keep: Sequence[str] = (),
    stemming: bool = True,
    bleu: bool = True,
    rouge: bool = True,
    rouge_l: bool = True,
) -> DataFrame:
    """One row per pair: BLEU counts, ROUGE F-measures and the exact-match flag.

    ``keep`` names the columns carried along (ids, model). Tokens that
    :func:`reference_tokens` has made are used.
    """
    mine, theirs = F.col(prediction), F.col(reference)
    bleu_theirs, rouge_theirs = (
        F.col(name) if name in pairs.columns else make(theirs)
        for name, make in zip(REFERENCE_TOKENS, (bleu_tokens, rouge_tokens), strict=True)
    )
    tokens: dict[str, Column] = {"exact": (strip(mine) == strip(theirs)).cast("int")}
    if bleu:
        tokens |= {"bleu_mine": bleu_tokens(mine), "bleu_theirs": bleu_theirs}
    if rouge or rouge_l:
        tokens |= {"rouge_mine": rouge_tokens(mine), "rouge_theirs": rouge_theirs}
    scored = pairs.select(*keep, *[column.alias(name) for name, column in tokens.items()])
    out: list[Column | str] = [*keep, "exact"]
    if bleu:
        shared = overlap_counts(F.col("bleu_mine"), F.col("bleu_theirs"), BLEU_ORDERS)
        scored = scored.withColumn("bleu_shared", shared)
        for i, n in enumerate(BLEU_ORDERS):
            out.append(F.get("bleu_shared", F.lit(i)).alias(f"match{n}"))
            out.append(gram_total(F.col("bleu_mine"), n).alias(f"total{n}"))
        out.append(gram_total(F.col("bleu_theirs"), 1).alias("reference_length"))
    if rouge or rouge_l:
        orders = ROUGE_ORDERS if rouge else ()
        sides = (F.col("rouge_mine"), F.col("rouge_theirs"))
        scored = scored.withColumn(
            "rouge_shared", overlap_counts(*sides, orders, stemming, subsequence=rouge_l)
        )
        wanted = [(f"rouge{n}", n) for n in orders] + ([("rougeL", 1)] if rouge_l else [])
        for i, (name, n) in enumerate(wanted):
            totals = [gram_total(side, n) for side in sides]
            out.append(_f_measure(F.get("rouge_shared", F.lit(i)), *totals).alias(name))
    return scored.select(*out)


def bleu_score() -> Column:
    """BLEU (0 to 100) from the corpus sums match1..4, total1..4, reference_length."""
    log_sum, misses = F.lit(0.0), F.lit(0)
    usable = F.col("match1") > 0
    for n in BLEU_ORDERS:
        match, total = F.col(f"match{n}"), F.col(f"total{n}")
        usable = usable & (total > 0)
        misses = misses + F.when(match == 0, 1).otherwise(0)
        # An order without a match counts as half, quarter, ... of one match.
        precision = F.when(match == 0, 1.0 / (F.pow(F.lit(2.0), misses) * total)).otherwise(match / total)
        log_sum = log_sum + F.log(precision)
    mine, theirs = F.col("total1"), F.col("reference_length")
    brevity = F.when(mine > theirs, F.lit(1.0)).otherwise(F.exp(1.0 - theirs / mine))
    return F.when(usable, 100.0 * brevity * F.exp(log_sum / 4.0)).otherwise(F.lit(0.0))


def _mean(value: Column | str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def _bleu_sums() -> list[Column]:
    names = [f"{part}{n}" for n in BLEU_ORDERS for part in ("match", "total")] + ["reference_length"]
    return [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]


def corpus_bleu(
    pairs: DataFrame, prediction: str = "prediction", reference: str = "reference", by: Sequence[str] = ()
) -> DataFrame:
    rows = pair_scores(pairs, prediction, reference, by, rouge=False, rouge_l=False)
    return rows.groupBy(*by).agg(*_bleu_sums()).select(*by, bleu_score().alias("bleu"))


def rouge(
    pairs: DataFrame, prediction: str = "prediction", reference: str = "reference",
    by: Sequence[str] = (), stemming: bool = True,
) -> DataFrame:
    """Mean F-measures rouge1, rouge2 and rougeL."""
    rows = pair_scores(pairs, prediction, reference, by, stemming, bleu=False)
    return rows.groupBy(*by).agg(*[_mean(name).alias(name) for name in ("rouge1", "rouge2", "rougeL")])


def exact_match(
    pairs: DataFrame, prediction: str = "prediction", reference: str = "reference",
    by: Sequence[str] = (),
) -> DataFrame:
    same = (strip(F.col(prediction)) == strip(F.col(reference))).cast("int")
    return pairs.groupBy(*by).agg(_mean(same).alias("accuracy"))


def _perplexity(loss: Column, tokens: Column) -> Column:
    """exp of the token-weighted mean loss; no tokens at all gives infinity."""
    return F.coalesce(F.exp(F.try_divide(F.sum(loss * tokens), F.sum(tokens))), F.lit(float("inf")))


def perplexity(losses: DataFrame, loss: str, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    return losses.groupBy(*by).agg(_perplexity(F.col(loss), F.col(tokens)).alias("perplexity"))


def f1_scores(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Macro and micro F1 from the confusion counts."""
    confusion = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hits"), F.col("n").alias("actual"), zero.alias("guessed")),
        F.struct(F.col("guess").alias("class"), zero.alias("hits"), zero.alias("actual"), F.col("n").alias("guessed")),
    )
    per_class = (
        confusion.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("hits").alias("hits"), F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"))
    )
    f1 = _f_measure(F.col("hits"), F.col("actual"), F.col("guessed"))
    return per_class.agg(
        _mean(f1).alias("f1_macro"),
        F.coalesce(F.try_divide(2.0 * F.sum("hits"), F.sum("actual") + F.sum("guessed")), F.lit(0.0)).alias("f1_micro"),
    )


def compute_all(
    pairs: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    by: Sequence[str] = (),
    stemming: bool = True,
    loss: str | None = None,
    tokens: str | None = None,
) -> DataFrame:
    """Long table (metric, value) per group: BLEU, ROUGE, accuracy, and perplexity if given losses."""
    by = list(by)
    names = ["bleu", "rouge1", "rouge2", "rougeL", "accuracy"]
    keep, sums = list(by), [
        *_bleu_sums(),
        *[_mean(name).alias(name) for name in ("rouge1", "rouge2", "rougeL")],
        _mean("exact").alias("accuracy"),
    ]
    if loss is not None and tokens is not None:
        keep += [loss, tokens]
        names.append("perplexity")
        sums.append(_perplexity(F.col(loss), F.col(tokens)).alias("perplexity"))
    rows = pair_scores(pairs, prediction, reference, keep, stemming)
    wide = rows.groupBy(*by).agg(*sums).withColumn("bleu", bleu_score())
    return wide.select(*by, *names).unpivot(by, names, "metric", "value")
