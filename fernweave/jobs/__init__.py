from . import extracting, indexing, keeping, queries, repairing, serving, updating  # noqa: F401  (all register queries)
