"""Rules that a caller writes in Python: they may fail on some texts, and the plan goes on without them there."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Params, Result, Rule, Stage

#: Workers get this module's functions with the plan, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Change = Callable[[str], tuple[str | None, Sequence[str]]]


def _udf(change: Change):
    @F.pandas_udf("out string, changes array<string>, error string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, [], None))
                continue
            try:
                out, changes = change(t)
                rows.append((None if out is None else str(out), [str(c) for c in changes], None))
            except Exception as e:  # the step tells of it
                rows.append((None, [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["out", "changes", "error"])

    return udf


def python_rule(rule_id: str, name: str, level: str, description: str, make: Callable[[Params], Change]) -> Rule:
    """A rule whose change(text) -> (new text, records of changes) runs in Arrow batches; make gives it for parameters.

    Where change raises, the step's status is "error", its record tells why, and the text goes on as it was. A null new
    text leaves the text as it was. Parameters have to be the same for all rows.
    """

    def apply(stage: Stage, text: Column, params: Params) -> Result:
        done = stage.put(_udf(make(params))(text))
        return done["out"], done["changes"], done["error"]

    return Rule(rule_id, name, level, description, apply)
