"""Writing the results of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_artifacts(base: str, *, labels: DataFrame | None = None, features: DataFrame | None = None,
                    scores: DataFrame | None = None, equity: DataFrame | None = None,
                    ledger: DataFrame | None = None, summary: DataFrame | None = None,
                    headline: DataFrame | None = None) -> dict[str, str]:
    """Parquet for tables (by track where there is one), CSV for the summary, JSON for the headline."""
    paths: dict[str, str] = {}
    tables = {"labels": labels, "features": features, "scores": scores, "equity": equity, "ledger": ledger}
    for name, df in tables.items():
        if df is None:
            continue
        w = df.write.mode("overwrite")
        if "track" in df.columns:
            w = w.partitionBy("track")
        paths[name] = f"{base}/{name}"
        w.parquet(paths[name])
    if summary is not None:
        paths["summary"] = f"{base}/summary"
        summary.write.mode("overwrite").option("header", True).csv(paths["summary"])
    if headline is not None:
        paths["headline"] = f"{base}/headline"
        headline.write.mode("overwrite").json(paths["headline"])
    return paths
