"""Views over tables, registered queries, and pipelines."""


def _load() -> None:
    from evoked.plans import event_queries, signal_queries, stat_queries, table_queries  # noqa: F401


def all_queries() -> dict:
    from evoked.plans.registry import QUERIES

    _load()
    return QUERIES


def all_oracles() -> dict:
    from evoked.plans.registry import ORACLES

    _load()
    return ORACLES
