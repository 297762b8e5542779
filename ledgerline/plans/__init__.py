"""Registered queries. Importing the modules fills the registry."""

from ledgerline.plans import activity, files, limiters, logs, results, streams, texts, usage  # noqa: F401
from ledgerline.plans.registry import ORACLES, QUERIES  # noqa: F401
