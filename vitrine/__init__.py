"""vitrine: catalogue search, recommendation and evaluation as batch Spark plans."""
