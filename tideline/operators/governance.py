"""Trial log, one-shot claims and the wording check of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sections a report must have and phrases it must not use.
REQUIRED_SECTIONS = (
    "BLUF", "Pre-registration", "Headline metrics", "Baseline gap", "Post-cost CAGR", "Hidden risks",
)
FORBIDDEN_PHRASES = (r"\bbest of \d+\b", r"\boutperformed random\b", r"100th percentile")

TRIAL_KEY = ("model", "label", "horizon_d", "threshold_q", "universe")


def config_json(cols: list[str]) -> Column:
    """Canonical JSON of some columns: keys in order, no spaces, nulls kept."""
    def item(c: str) -> Column:
        value = F.coalesce(F.to_json(F.array(F.col(c))), F.lit("[null]"))
        return F.concat(F.lit(f'"{c}":'), F.substring(value, 2, F.length(value) - 2))

    return F.concat(F.lit("{"), F.concat_ws(",", *[item(c) for c in sorted(cols)]), F.lit("}"))


def config_hash(cols: list[str], length: int = 16) -> Column:
    return F.substring(F.sha2(config_json(cols), 256), 1, length)


def trial_count(log: DataFrame) -> DataFrame:
    """Distinct trials, nulls counted as a value, at least 1."""
    distinct = log.select(*TRIAL_KEY).distinct()
    return distinct.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_trials"))


def first_claim_wins(claims: DataFrame, key: list[str], order: list[str], overwrite: str | None = None) -> DataFrame:
    """Status of every claim: the first of its key is accepted, later ones refused unless they overwrite.

    The first claim of each key is a mergeable minimum, joined back on the whole claim, so a key that
    is claimed all the time stays spread over the tasks.
    """
    firsts = claims.groupBy(*key).agg(F.min(F.struct(*order)).alias("f")).select(
        *key, *[F.col(f"f.{c}").alias(c) for c in order], F.lit(1).alias("_first"))
    j = claims.join(firsts, [*key, *order], "left")
    ok = F.col("_first") == 1
    if overwrite:
        ok = ok | F.col(overwrite)
    return j.withColumn("status", F.when(ok, "accepted").otherwise("refused")).drop("_first")


def compliance_lint(docs: DataFrame, text: str = "text", required: tuple[str, ...] = REQUIRED_SECTIONS,
                    forbidden: tuple[str, ...] = FORBIDDEN_PHRASES) -> DataFrame:
    """Errors of every document, read whole: sections it lacks and phrases it uses."""
    t = F.col(text)
    missing = [F.when(~F.contains(t, F.lit(s)), F.lit(f"missing required section: {s}")) for s in required]
    used = []
    for p in forbidden:
        m = F.regexp_extract(t, f"(?i)({p})", 1)
        used.append(F.when(m != "", F.concat(F.lit("forbidden phrase '"), m, F.lit("'"))))
    return docs.withColumn("errors", F.array_compact(F.array(*missing, *used)))
