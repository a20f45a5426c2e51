"""Query plans: derived fixtures, the registered queries and their DuckDB oracles."""


def load_all():
    """Import every query module so the registry is filled."""
    from textloom.plans import q_basic, q_eval, q_metrics, q_scores, q_spans, q_tasks, q_tokens  # noqa: F401
