"""Queries of the corpus operators, one per operator and the pipeline."""


def load():
    from . import (bpe, codes, decontamination, embeddings, licenses, line_dedup, periodic, quality, simhash, substring_dedup, suffix_dedup, token_files, toxicity)  # noqa: F401
    from .common import ORACLES, QUERIES

    return QUERIES, ORACLES
