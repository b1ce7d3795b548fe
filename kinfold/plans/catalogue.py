"""All named queries, with their oracles."""

from kinfold.plans import datasets, extras, files, jobstore, rankings, requests, retrievals, scores, texts  # noqa: F401
from kinfold.plans.registry import ORACLES, QUERIES  # noqa: F401
