"""A keep-or-revert search over settings, every round of which is scored at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

Setting = dict[str, object]


def changes(best: Setting, levers: dict[str, Sequence[object]]) -> list[tuple[str, object]]:
    """Every single change of a setting, in the order of the levers and of their values; those that change nothing are left out."""
    return [(k, v) for k, values in levers.items() for v in values if v != best[k]]


def keep_or_revert(seed: Setting, levers: dict[str, Sequence[object]], score: Callable[[list[Setting]], list[dict]], dry: int, most: int = 1000) -> tuple[Setting, list[dict]]:
    """(best setting, ledger): a change is kept if its ``value`` is above the best so far and it ``passed``; after one the changes start anew.

    ``score`` gives a dict for every setting of a list, in its order, by one Spark job:
    the changes of a round do not depend on one another until one is kept, so
    all are scored together and read in order.  The search ends after ``dry`` changes in a row that
    were not kept, after ``most`` in all, or when none is left.
    """
    if dry < 1:
        raise ValueError("dry must be at least 1")
    best, first = seed, score([seed])[0]
    value = first["value"]
    ledger = [{"iteration": 0, "lever": None, "to": None, "decision": "KEEP", **first}]
    reverts, kept = 0, True
    while kept and reverts < dry and len(ledger) <= most:
        kept = False
        open_ = changes(best, levers)
        settings = [best | {k: v} for k, v in open_]
        for (lever, to), setting, got in zip(open_, settings, score(settings) if settings else [], strict=True):
            if reverts >= dry or len(ledger) > most:
                break
            kept = got["value"] is not None and (value is None or got["value"] > value) and bool(got["passed"])
            ledger.append({"iteration": len(ledger), "lever": lever, "to": str(to), "decision": "KEEP" if kept else "REVERT", **got})
            reverts = 0 if kept else reverts + 1
            if kept:
                best, value = setting, got["value"]
                break
    return best, ledger
