"""The queries by subject; importing this package fills the registry."""

from quillbank.plans import composites, kernels, probes, selection, statistics, text, vectors  # noqa: F401
from quillbank.plans.registry import ORACLES, QUERIES  # noqa: F401
