"""Dataset transformations: bars, tape scores, as-of joins, baselines, retention."""
