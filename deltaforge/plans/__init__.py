"""End-to-end plans: compress a model against another, and rebuild it."""
