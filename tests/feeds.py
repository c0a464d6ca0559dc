"""Small feeds for tests, and what they must lead to."""

from datetime import datetime, timedelta

from rowtide.functions.contract import HISTORY_COLUMNS, HISTORY_ORDER_COLUMNS

START = datetime(2024, 1, 1)
CHANGE_DDL = "header__timestamp timestamp_ntz, header__change_oper string, id int, name string"

# The scripted change scenario.
SCENARIO = [
    (1, "I", 1, "number_one"),
    (2, "I", 2, "number_two"),
    (3, "I", 3, "number_three"),
    (4, "I", 4, "number_four"),
    (5, "I", 5, "number_five"),
    (6, "U", 1, "number_one_changed"),
    (7, "U", 5, "number_five_changed"),
    (8, "D", 2, "number_two"),
    (9, "I", 6, "number_six"),
    (10, "I", 7, "number_six"),
]
SCENARIO_STATE = {
    (1, "number_one_changed"),
    (3, "number_three"),
    (4, "number_four"),
    (5, "number_five_changed"),
    (6, "number_six"),
    (7, "number_six"),
}
SCENARIO_HISTORY = {
    (1, "number_one", False, False, 1, 6),
    (1, "number_one_changed", True, False, 6, None),
    (2, "number_two", False, True, 2, 8),
    (3, "number_three", True, False, 3, None),
    (4, "number_four", True, False, 4, None),
    (5, "number_five", False, False, 5, 7),
    (5, "number_five_changed", True, False, 7, None),
    (6, "number_six", True, False, 9, None),
    (7, "number_six", True, False, 10, None),
}


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def changes(spark, rows, ddl=CHANGE_DDL):
    """Rows of (second, operation, id, name)."""
    return spark.createDataFrame([(at(t), op, *rest) for t, op, *rest in rows], ddl)


def table(spark, rows=(), ddl="id int, name string"):
    return spark.createDataFrame(list(rows), ddl)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def seconds(moment):
    return None if moment is None else int((moment - START).total_seconds())


def versions(history):
    """History rows with times as seconds."""
    return sorted(
        (
            (*(r[c] for c in history.columns if c not in HISTORY_COLUMNS + HISTORY_ORDER_COLUMNS),
             r["current"], r["deleted"], seconds(r["effective_date"]), seconds(r["end_date"]))
            for r in history.collect()
        ),
        key=repr,
    )


def empty_history(spark, ddl="id int, name string, current boolean, deleted boolean, effective_date timestamp_ntz, end_date timestamp_ntz"):
    return spark.createDataFrame([], ddl)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

