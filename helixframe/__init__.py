"""Spark-native analytics for genomic variants (VCF text)."""

import logging


def set_verbosity(verbose: int = 0, quiet: bool = False) -> None:
    """How much this package logs: errors only if ``quiet``, else warnings, information or (2 and more) all."""
    logging.getLogger(__name__).setLevel(logging.ERROR if quiet else {0: logging.WARNING, 1: logging.INFO}.get(verbose, logging.DEBUG))
