"""The tables of the tests, and rows in a form that both engines share."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(value):
    """A value as both engines would print it."""
    import pandas as pd

    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    try:
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    except (TypeError, ValueError):
        return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))
