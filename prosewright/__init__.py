"""prosewright: text-structure analytics and corpus preparation on Spark DataFrames."""

__version__ = "0.1.0"


def __getattr__(name: str):
    """classify and classify_batch, loaded where they are first asked for."""
    if name in ("classify", "classify_batch"):
        from prosewright import api

        return getattr(api, name)
    raise AttributeError(name)
