"""Registries: a name maps to a function on DataFrames or Columns; a second use of a name is an error."""

from collections.abc import Callable


class Registry(dict):
    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def add(self, name: str) -> Callable:
        def put(fn):
            if name in self and self[name] is not fn:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self[name] = fn
            return fn

        return put

    def pick(self, name: str):
        if name not in self:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self)}")
        return self[name]


ESTIMATORS = Registry("advantage estimator")
DIAGNOSTICS = Registry("diagnostic")
REWARD_RULES = Registry("reward rule")
PATH_FILTERS = Registry("path filter")
PATH_SELECTORS = Registry("path selector")
PATH_REWRITES = Registry("path rewrite")


def with_reward(df, fn: Callable, name: str = "reward", **fixed):
    """Apply a user reward: `fn(**columns, **fixed)` returns a Column (built-in or pandas UDF)."""
    return df.withColumn(name, fn(df, **fixed))
