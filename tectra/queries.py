"""All registered plans and their oracles; importing the plan modules registers them."""

from tectra.plans import files, filters, lines, linking, spectral, thinning, tracing, vectors  # noqa: F401
from tectra.plans.registry import ORACLES, QUERIES  # noqa: F401
