"""What goes in and out as JSON or local times, and parity of sequences with the windows they end in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPLANATION = "stay_id long, window_id long, base double, attributions array<double>"


def utc_time(text: Column, zone: str) -> Column:
    """ISO text as an instant: with Z or an offset as it says, without one in the local zone; null if it isn't a time."""
    t = F.try_to_timestamp(text)
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.to_utc_timestamp(t, zone))


def safe_json(columns: Sequence[str], types: dict[str, str]) -> Column:
    """A JSON object; numbers that aren't finite become null, and null fields are left out."""
    kept = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if types[c] in ("double", "float") else F.col(c) for c in columns]
    return F.to_json(F.struct(*kept))


def json_problem(text: Column) -> Column:
    """Why a JSON object is refused: not_an_object, or duplicate_key for a name that its top level has twice; else null."""
    keys = F.json_object_keys(text)
    return F.when(keys.isNull(), "not_an_object").when(F.size(keys) != F.size(F.array_distinct(keys)), "duplicate_key")


def explanations(messages: DataFrame, width: int) -> DataFrame:
    """stay_id, window_id, base, attributions of messages (value: JSON) that hold them under shap or at the root; those lacking one, or with another width, go."""
    x = messages.select(F.from_json("value", f"{EXPLANATION}, shap struct<{EXPLANATION}>").alias("m"))
    names = [f.split()[0] for f in EXPLANATION.split(", ")]
    x = x.select(*[F.coalesce(F.col(f"m.shap.{c}"), F.col(f"m.{c}")).alias(c) for c in names])
    whole = (F.size("attributions") == width) & F.forall("attributions", lambda v: v.isNotNull())
    return x.dropna(subset=names).where(whole)


def causal_parity(sequences: DataFrame, windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """stay_id, terminal_window_id, same: whether a sequence's last step, missing where its mask says so, is its window's own vector.

    sequences: as made by tensors(); windows: stay_id, window_id and columns. A sequence without a window isn't the same."""
    raw = windows.select("stay_id", F.col("window_id").alias("terminal_window_id"), F.array(*[F.when(~F.isnan(c), F.col(c)) for c in columns]).alias("raw"))
    last = lambda c: F.element_at(c, F.col("sequence_length"))
    shown = F.zip_with(last("temporal"), last("missing_mask"), lambda v, m: F.when(m == 0, v))
    same = F.forall(F.zip_with(shown, "raw", lambda a, b: a.eqNullSafe(b)), lambda ok: ok)
    x = sequences.join(raw, ["stay_id", "terminal_window_id"], "left")
    return x.select("stay_id", "terminal_window_id", F.coalesce(same, F.lit(False)).alias("same"))
