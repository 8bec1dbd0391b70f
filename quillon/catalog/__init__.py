"""Named queries over the given tables, one for each operator."""
from . import corpus, evaluation, graph, routing, state, text, vectors  # noqa: F401
