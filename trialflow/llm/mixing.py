"""Iterative proportional fitting of token weights to marginals, and sampling by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.session import stage

#: Rounds of fitting at most; each rakes every dimension once. Fitting ends when a round changes no weight by more than TOLERANCE.
ROUNDS, TOLERANCE = 12, 1e-10
#: Digits of a probability.
DIGITS = 7
#: Share of all tokens that the sample has on average.
KEEP = 0.6
#: Exponent on a value's tokens in a smoothed target share; 1 keeps the shares as they are.
SMOOTHING = 0.9
#: A word, as everywhere in this subpackage: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: 2 ** 52: a draw is 13 hex digits of an MD5.
DRAWS = 4503599627370496.0


def n_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def genre(tokens: Column) -> Column:
    """Stands for the topic, which the given documents do not carry."""
    return F.when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("book")


def draw(seed: int, *columns: str) -> Column:
    """Uniform in [0, 1), fixed by the seed and the columns' values."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *values))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(DRAWS)


def smoothed_shares(cells: DataFrame, dim: str, smoothing: float = SMOOTHING) -> DataFrame:
    """(value, share): shares in proportion to tokens ** smoothing, which favours small values."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(smoothing)).alias("mass"))
    whole = sums.agg(F.sum("mass")).first()[0] or 0.0
    return sums.select("value", (F.col("mass") / whole if whole else F.lit(0.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: tokens fitted to all target marginals.

    ``targets`` maps a dimension to (value, share), value NULL for NULLs. The cells are one row
    per combination of values, so every sum is small; each round is a written table. Rounds end
    when none of their factors is further than ``tolerance`` from 1, or after ``rounds``. Values
    without a target, and cells without tokens, weigh nothing.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim, frame in targets.items():
        wanted = frame.select(F.col("value").alias("__value"), (F.col("share") * total).alias(f"__{dim}"))
        fitted = fitted.join(wanted, F.col(dim).eqNullSafe(F.col("__value")), "left").drop("__value")
    fitted = stage(fitted, "mix-targets")
    for _ in range(rounds):
        moved = F.lit(0.0)
        for dim in targets:
            sums = fitted.groupBy(F.col(dim).alias("__value")).agg(F.sum("weight").alias("__sum"))
            factor = F.when(F.col("__sum") > 0, F.coalesce(f"__{dim}", F.lit(0.0)) / F.col("__sum")).otherwise(0.0)
            fitted = (
                fitted.join(sums, F.col(dim).eqNullSafe(F.col("__value")))
                .withColumn(f"__moved_{dim}", F.when(F.col("weight") > 0, F.abs(factor - 1)).otherwise(0.0))
                .withColumn("weight", F.col("weight") * factor)
                .drop("__value", "__sum")
            )
            moved = F.greatest(moved, F.col(f"__moved_{dim}"))
        fitted = stage(fitted.withColumn("__moved", moved), "mix-round")
        if (fitted.agg(F.max("__moved")).first()[0] or 0.0) <= tolerance:
            break
        fitted = fitted.drop("__moved", *[f"__moved_{dim}" for dim in targets])
    return fitted.select(*cells.columns, "weight")


def calibrated(fitted: DataFrame, keep: float = KEEP) -> DataFrame:
    """``fitted`` with ``probability``: weight / tokens times a factor, 1 at most, such that ``keep`` of all tokens are sampled.

    The factor is what the cells below 1 need to make up for those at 1. It only rises from round to
    round, and so do the cells at 1, so the rounds end at the exact factor. If the weights allow
    fewer tokens, all cells that have a weight are sampled whole.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    tokens, weight = fitted.agg(F.sum("tokens"), F.sum("weight")).first()
    wanted, factor = keep * (tokens or 0), 0.0
    if weight:
        factor, at_one = wanted / weight, -1
        while True:
            full = ratio * factor >= 1
            one, taken, rest = fitted.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
            if one == at_one or not rest:
                break
            at_one, factor = one, (wanted - (taken or 0)) / rest
    if weight and not rest:
        return fitted.withColumn("probability", F.when(ratio > 0, F.lit(1.0)).otherwise(0.0))
    return fitted.withColumn("probability", F.round(F.least(F.lit(1.0), ratio * factor), DIGITS))


DIMS = ["source", "lang", "topic"]


def _celled(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """(__row, __source, __lang, __topic, __tokens): the rows of ``docs`` packed, so that no name of theirs can clash."""
    columns = [F.struct("*").alias("__row"), F.col(source_col).alias("__source"), F.col(lang_col).alias("__lang"), n_tokens(text_col).alias("__tokens")]
    if topic is not None:
        return docs.select(*columns, topic.alias("__topic"))
    return docs.select(*columns).withColumn("__topic", genre(F.col("__tokens")))


def cell_chances(rows: DataFrame, targets: dict[str, DataFrame] | None, rounds: int, smoothing: float, keep: float) -> DataFrame:
    """(c_source, c_lang, c_topic, probability) of all cells of rows (source, lang, topic, tokens)."""
    cells = stage(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    wanted = {d: (targets or {}).get(d, smoothed_shares(cells, d, smoothing)) for d in DIMS}
    fitted = calibrated(rake(cells, wanted, rounds), keep)
    return stage(fitted.select(*[F.col(d).alias(f"c_{d}") for d in DIMS], "probability"), "mix-chances")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    smoothing: float = SMOOTHING,
    seed: int = 11,
    keep: float = KEEP,
) -> DataFrame:
    """One row per document: id, its cell (source, lang, topic), tokens, probability, sampled.

    Token weights of all (source, lang, topic) cells are raked to the three marginals, ``targets``
    or else shares smoothed from the documents' own; probabilities in proportion to weight / tokens,
    1 at most, sample ``keep`` of all tokens on average. A document is sampled with its cell's
    probability by a draw that its id and text fix. ``topic`` defaults to a genre by length.

    NULL dimensions are values of their own; NULL and empty texts have no tokens and are never
    sampled; repeated rows get the same draw; an empty table gives an empty result; columns other
    than the named are not read, so their names cannot clash.
    """
    celled = _celled(docs, text_col, source_col, lang_col, topic)
    rows = stage(celled.select(
        F.col("__row")[id_col].alias("id"), *[F.col(f"__{d}").alias(d) for d in DIMS], F.col("__tokens").alias("tokens"),
        draw(seed, f"__row.{id_col}", f"__row.{text_col}").alias("draw"),
    ), "mix-rows")
    chances = cell_chances(rows, targets, rounds, smoothing, keep)
    chance = F.when(F.col("tokens") > 0, F.col("probability")).otherwise(0.0)
    return rows.join(chances, [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMS]).select(
        "id", *DIMS, "tokens", chance.alias("probability"), (F.col("draw") < chance).alias("sampled")
    )


def sample_to_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    smoothing: float = SMOOTHING,
    seed: int = 11,
    keep: float = KEEP,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, all columns kept; edge cases as in ``mix``.

    Only the cells' probabilities are joined to the documents, which are read once for the cells'
    tokens and once for the result.
    """
    celled = _celled(docs, text_col, source_col, lang_col, topic)
    rows = celled.select(*[F.col(f"__{d}").alias(d) for d in DIMS], F.col("__tokens").alias("tokens"))
    chances = cell_chances(rows, targets, rounds, smoothing, keep)
    drawn = celled.withColumn("__draw", draw(seed, f"__row.{id_col}", f"__row.{text_col}"))
    same = [F.col(f"__{d}").eqNullSafe(F.col(f"c_{d}")) for d in DIMS]
    kept = drawn.join(chances, same).filter((F.col("__tokens") > 0) & (F.col("__draw") < F.col("probability")))
    return kept.select("__row.*")
