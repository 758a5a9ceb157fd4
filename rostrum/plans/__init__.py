"""Query plans, by plane; importing this package registers them all."""

from . import analytics, composed, evaluation, maintenance, matching, retrieval, sequences, text  # noqa: F401
