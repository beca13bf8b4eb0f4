"""Registered queries; importing the plan modules fills the registry."""

from . import catalog, corpus, evaluate, linear, modelloop, names, nbmetrics, outputs, prep, sweep, sweeprun, trials  # noqa: F401
from . import streams  # noqa: F401,E402  (reuses the twins registered above)
from .registry import ORACLE, QUERIES  # noqa: F401
