"""deltaforge: compact differences between tables and tensor collections, on Spark."""
