"""What kind of statement a text is, from Spark's own parser and analyser.

The two plan accessors used here are not part of Spark's public Python API; nothing else
in the package touches them.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

#: Nodes of a select around its aggregate.
_THROUGH = {"Project", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Filter", "WithCTE"}


class Kind(NamedTuple):
    is_query: bool
    has_aggregates: bool
    problem: str | None = None


def stripped(text: str) -> str:
    """The statement without surrounding blanks and its terminators, `;` or `/`."""
    return re.sub(r"[\s;/]+\Z", "", text).strip()


def classify(spark: SparkSession, text: str) -> Kind:
    """Whether a statement is a query, and whether its outermost select aggregates.

    Commands, and texts that can't be parsed or analysed, are no queries. Window functions are no
    aggregates, and neither are aggregates inside a derived table alone.
    """
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(stripped(text))
    except ParseException as e:
        return Kind(False, False, f"failed to parse: {e.getMessage().splitlines()[0]}")
    name = parsed.getClass().getName()
    if "Command" in name or re.search(r"\.(Create|Drop|Insert|Delete|Update|Merge|Alter|Show|Describe|Set|Use|Refresh|Cache|Uncache|Analyze|Load|Truncate|Repair|Replace|Explain)\w*$", name):
        return Kind(False, False, "the statement is not a SELECT query")
    try:
        analysed = spark.sql(stripped(text))._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        return Kind(False, False, f"failed to analyse: {e.getMessage().splitlines()[0]}")
    return Kind(True, _aggregates(json.loads(analysed.toJSON())))


def _aggregates(nodes: list[dict]) -> bool:
    """Whether the first node below projections, sorts and limits is an aggregate with an aggregate function; nodes stand in pre-order."""
    at = 0
    while at < len(nodes):
        name = nodes[at]["class"].rpartition(".")[2]
        if name == "Aggregate":
            return "AggregateExpression" in json.dumps(nodes[at].get("aggregateExpressions", []))
        if name not in _THROUGH:
            return False
        at += 1
        if name == "WithCTE":  # its last child is the query, the others are the definitions
            for _ in range(nodes[at - 1]["num-children"] - 1):
                at = _after(nodes, at)
    return False


def _after(nodes: list[dict], at: int) -> int:
    """Where the subtree that begins at a place ends."""
    open_ = 1
    while open_:
        open_ += nodes[at]["num-children"] - 1
        at += 1
    return at
