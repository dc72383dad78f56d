"""The named lists as SQL table functions with parameters, over the registered views.

Each is a SQL function: the planner puts its body in place of the call, so a state given as a
literal is a filter of the scan. They last as long as the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KEYS = "state, ndc11_normalized, product_name_fda10"
_TOP_SPEND = f"{_KEYS}, total_spend, total_units, total_scripts, quarter_start, risk_level, risk_score"
_MOVES = (f"{_KEYS}, total_spend, qoq_spend_change, rolling_4q_growth_spend, cv_spend, risk_level,"
          " risk_score, quarter_start")
_HISTORY = ("quarter_start, product_name_fda10, total_spend, total_units, total_scripts, qoq_spend_change,"
            " rolling_4q_growth_spend, cv_spend, risk_level, risk_score")

#: A null argument chooses all states.
_CHOSEN = "(in_state IS NULL OR state = in_state)"
_ARGUMENTS = "in_state STRING DEFAULT NULL COMMENT 'state, all if null', k INT DEFAULT {k} COMMENT 'rows'"


def _first(columns: str, order: str, rows: str) -> str:
    """The first k rows of an order. A limit may not be a parameter, a bound on a rank may."""
    return f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (ORDER BY {order}, {_KEYS}, quarter_start) AS place FROM ({rows}))
WHERE place <= k"""


def _latest(view: str) -> str:
    """Rows in the latest quarter of their own state."""
    return f"""SELECT r.* FROM {view} AS r
JOIN (SELECT state AS of_state, max(quarter_start) AS newest FROM {view} WHERE {_CHOSEN} GROUP BY state)
ON state = of_state AND quarter_start = newest WHERE {_CHOSEN}"""


def _bodies(view: str) -> dict[str, tuple[str, str, str]]:
    """Name -> arguments, columns, body."""
    latest = _latest(view)
    rising = f"SELECT * FROM ({latest}) WHERE qoq_spend_change IS NOT NULL"
    watched = f"SELECT * FROM {view} WHERE {_CHOSEN} AND risk_level IN ('high', 'medium')"
    return {
        "top_spend": (_ARGUMENTS.format(k=10), _TOP_SPEND, _first(_TOP_SPEND, "total_spend DESC", latest)),
        "top_risers": (_ARGUMENTS.format(k=10), _MOVES, _first(_MOVES, "qoq_spend_change DESC", rising)),
        "watchlist": (
            _ARGUMENTS.format(k=20), _MOVES, _first(_MOVES, "risk_score DESC, total_spend DESC", watched)),
        "series_history": (
            "in_state STRING, in_code STRING", _HISTORY,
            f"SELECT {_HISTORY} FROM {view} WHERE state = in_state AND ndc11_normalized = in_code"),
    }


def register_functions(spark: SparkSession, risks: DataFrame, view: str = "risks") -> list[str]:
    """Name ``risks`` as a view and the lists over it as table functions; their names.

    ``SELECT * FROM top_spend('CA', 5)``, ``top_risers(k => 3)``, ``watchlist()``,
    ``series_history('CA', '00000000013')``. Equal to the functions of ``operators.serve``, ties by
    the same keys; the order of a list's rows is for the caller to ask for.
    """
    risks.createOrReplaceTempView(view)
    types = {f.name: f.dataType.simpleString() for f in risks.schema}
    made = _bodies(view)
    for name, (arguments, columns, body) in made.items():
        returned = ", ".join(f"{c} {types[c]}" for c in columns.split(", "))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({returned}) RETURN {body}")
    return list(made)
