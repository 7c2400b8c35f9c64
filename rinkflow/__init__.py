"""Event analytics on Spark DataFrames: context features, quality checks, scoring, metrics, effects and projections."""
