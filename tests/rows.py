"""Rows that the operators of a finished plan gave out."""

from __future__ import annotations


def _nodes(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(node.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _nodes(node.plan())
        return
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def most_rows(df) -> tuple[list, int]:
    """The collected rows, and the most rows that one operator of the plan gave out."""
    rows, most = df.collect(), 0
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
    return rows, most
