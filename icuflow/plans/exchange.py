"""Queries of JSON and time exchange, sequence parity, and fitted pipelines on three splits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from icuflow.functions import scalars
from icuflow.operators import encode, exchange, sequences
from icuflow.plans.features import ATTRIBUTED_SQL, DAY, IMPUTED_SQL, LENGTH, MEANS, SPLIT_SQL, WIDTH, _attributed, _imputed, _subject_split, features, features_sql, rounded
from icuflow.sources.files import catalog_of, kept, removed, shared_folder
from icuflow.sources.telemetry import stays, table

ZONE = "Asia/Kolkata"
CATEGORIES = ["segment", "nation", "region"]


def local_times(spark, d):
    """Event times as text: every third with Z, the others in a local zone."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(text, F.lit("Z"))).otherwise(text)
    return table(spark, d, "events").select("event_id", F.unix_timestamp(exchange.utc_time(text, ZONE)).alias("utc"))


def json_guard(spark, d):
    """Events as JSON: every seventh value isn't a number, every ninth object names its value twice, every eleventh is cut."""
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.pmod(n, F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    made = exchange.safe_json(e.columns, dict(e.dtypes))
    x = e.select("event_id", made.alias("made"))
    whole = F.expr("left(made, length(made) - 1)")
    text = F.when(F.pmod(n, F.lit(9)) == 0, F.concat(whole, F.lit(',"user_id":0}'))).when(F.pmod(n, F.lit(11)) == 0, whole).otherwise(F.col("made"))
    x = x.select("event_id", text.alias("text"))
    return x.select("event_id", exchange.json_problem(F.col("text")).alias("problem"), F.get_json_object("text", "$.value").isNotNull().alias("has_value")).where("problem is null or problem <> 'not_an_object'")


def explanation_layouts(spark, d):
    """Attributions as messages: odd windows nested, every fifth stay without its base."""
    a = _attributed(spark, d).withColumn("base", F.when(F.pmod("stay_id", F.lit(5)) != 0, F.col("base")))
    flat = F.struct("stay_id", "window_id", "base", "attributions")
    messages = a.select(F.when(F.pmod("window_id", F.lit(2)) == 1, F.to_json(F.struct(flat.alias("shap")))).otherwise(F.to_json(flat)).alias("value"))
    x = exchange.explanations(messages, WIDTH)
    return rounded(x.select("stay_id", "window_id", "base", F.aggregate("attributions", F.lit(0.0), lambda s, v: s + v).alias("total")))


def causal_parity(spark, d):
    """Every fourth window's own vector is changed after its sequence was made, so those must differ.

    Both sides read windows that were made once: a mean's last bits depend on the order in which a shuffle brings its rows."""
    f, path = kept(features(spark, d).select("stay_id", "window_id", *MEANS), "windows")
    t = sequences.tensors(sequences.histories(_imputed(spark, d, f), LENGTH), LENGTH, WIDTH)
    later = f.withColumn(MEANS[0], F.when(F.pmod("window_id", F.lit(4)) == 0, F.coalesce(F.col(MEANS[0]), F.lit(0.0)) + 1).otherwise(F.col(MEANS[0])))
    out, _ = kept(exchange.causal_parity(t, later, MEANS), "parity")
    removed(spark, path)
    return out


def pipeline_splits(spark, d):
    """A pipeline fitted on train, saved, loaded, and applied to all three splits: rows, vector length, names, and rows with a segment or nation that train doesn't have."""
    x = stays(spark, d).join(_subject_split(spark, d).select("subject_id", "split"), "subject_id")
    path = shared_folder(spark, "pipeline")
    encode.fit_on(x.where("split = 'train'"), ["age"], CATEGORIES).write().overwrite().save(path)
    model = PipelineModel.load(path)
    labels = dict(zip(CATEGORIES, map(len, model.stages[0].labelsArray), strict=True))
    made = model.transform(x)
    unseen = F.lit(False)
    for c, n in labels.items():
        unseen = unseen | (F.col(f"{c}_index") == n)
    n_dims = F.size(encode.vector_to_array("features"))
    return made.groupBy("split").agg(F.count("*").alias("n_rows"), F.max(n_dims).cast("long").alias("n_dims"), F.lit(len(encode.feature_names(made))).cast("long").alias("n_names"), F.count_if(unseen).alias("n_unseen"))


CATALOG = ("customer", "events", "lineitem", "orders")


def table_catalog(spark, d):
    """Rows and columns of the tables that the others are derived from."""
    x = catalog_of({t: table(spark, d, t) for t in CATALOG})
    return x.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.max("n_rows").alias("n_rows"))


def content_hashes(spark, d):
    """A digest of each event's content, by which repeats are found."""
    return table(spark, d, "events").select("event_id", scalars.content_hash(F.col("user_id"), F.col("event_type"), F.col("props")).alias("digest"))


def standardised(spark, d):
    """Windows' values in deviations from the mean of all windows; what can't be divided is 0."""
    x = _imputed(spark, d)
    s = sequences.norm_statistics(x).agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "deviation"))).alias("s"))  # a row a feature
    y = x.join(F.broadcast(s), F.lit(True)).select("stay_id", "window_id", scalars.standardized(F.col("temporal_row"), F.col("s.mean"), F.col("s.deviation")).alias("z"))
    return rounded(y.select("stay_id", "window_id", *[F.col("z")[k].alias(c) for k, c in enumerate(MEANS)]), 5)


QUERIES = {f.__name__: f for f in (local_times, json_guard, explanation_layouts, causal_parity, pipeline_splits, table_catalog, content_hashes, standardised)}

_KNOWN = " + ".join(f"count(DISTINCT {c}) FILTER (split = 'train') + 1" for c in CATEGORIES)
_UNSEEN = " OR ".join(f"{c} NOT IN (SELECT {c} FROM x WHERE split = 'train')" for c in CATEGORIES)

ORACLE_SQL = {
    "local_times": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 3 = 0 THEN 0 ELSE 19800 END AS utc FROM events",
    "json_guard": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'duplicate_key' END AS problem, event_id % 7 <> 0 AND value IS NOT NULL AS has_value FROM events WHERE event_id % 9 = 0 OR event_id % 11 <> 0",
    "explanation_layouts": f"WITH {ATTRIBUTED_SQL} SELECT stay_id, window_id, round(max(base), 6) AS base, round(sum(v), 6) AS total FROM long WHERE stay_id % 5 <> 0 GROUP BY 1, 2",
    "causal_parity": f"WITH {features_sql(DAY)} SELECT stay_id, window_id AS terminal_window_id, window_id % 4 <> 0 AS same FROM features",
    "table_catalog": " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, count(*) AS n_rows FROM {t}" for t in CATALOG),
    "content_hashes": """SELECT event_id, sha256('{"user_id":' || user_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}') AS digest FROM events""",
    "standardised": f"WITH {IMPUTED_SQL}, s AS (SELECT {', '.join(f'avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1 ELSE stddev_pop({c}) END AS d_{c}' for c in MEANS)} FROM imputed) SELECT stay_id, window_id, {', '.join(f'round(({c} - a_{c}) / d_{c}, 5) AS {c}' for c in MEANS)} FROM imputed, s",
    "pipeline_splits": f"WITH {SPLIT_SQL}, x AS (SELECT s.*, split FROM stays s JOIN splits USING (subject_id)), w AS (SELECT 1 + {_KNOWN} AS n FROM x) SELECT split, count(*) AS n_rows, max(n) AS n_dims, max(n) AS n_names, count(*) FILTER ({_UNSEEN}) AS n_unseen FROM x, w GROUP BY 1",
}
