"""Queries of feature building: windows, audits, splits, sequences, encoding and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.operators import audits, encode, sequences, splits, windows
from icuflow.sources.telemetry import PREDS_SQL, STAYS_SQL, VITALS, observations, predictions, stays, table

DAY = 1440
LENGTH, WIDTH = 120, len(VITALS)
CHECKPOINTS = (1, 5, 10, 20, 30, 60, 90, 120)
MEANS = [f"{v}_mean" for v in VITALS]
COEFFICIENTS = {"click_mean": 0.02, "error_mean": -0.01, "purchase_mean": 0.015, "signup_mean": 0.005, "view_mean": -0.02}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def readings_sql(minutes: int) -> str:
    return f"""{STAYS_SQL},
readings AS (
  SELECT e.user_id AS stay_id, e.event_type AS vital_sign, e.value, e.ts AS charttime, e.event_id,
         CAST(floor((floor(epoch(e.ts)) - floor(epoch(s.intime))) / {60 * minutes}) AS BIGINT) AS window_id
  FROM events e JOIN stays s ON e.user_id = s.stay_id WHERE e.ts >= s.intime)"""


def wide_sql(minutes: int) -> str:
    own = ", ".join(f"avg(value) FILTER (vital_sign = '{v}') AS {v}_mean, min(value) FILTER (vital_sign = '{v}') AS {v}_min, max(value) FILTER (vital_sign = '{v}') AS {v}_max, arg_max(value, charttime) FILTER (vital_sign = '{v}') AS {v}_last" for v in VITALS)
    return f"{readings_sql(minutes)},\nwide AS (SELECT stay_id, window_id, {own} FROM readings GROUP BY 1, 2)"


def features_sql(minutes: int) -> str:
    over = "OVER (PARTITION BY stay_id ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    stats = ", ".join(f"last_value({v}_{s} IGNORE NULLS) {over} AS {v}_{s}" for v in VITALS for s in windows.STATS)
    flags = ", ".join(f"CAST({v}_last IS NULL AS INTEGER) AS {v}_missing" for v in VITALS)
    trends = ", ".join(f"{v}_last - {v}_mean AS {v}_trend" for v in VITALS[:3])
    total = " + ".join(f"coalesce({v}_last, 0)" for v in VITALS[-3:])
    return f"{wide_sql(minutes)},\ncarried AS (SELECT stay_id, window_id, {stats}, {flags} FROM wide),\nfeatures AS (SELECT *, {trends}, {total} AS total_last FROM carried)"


DOUBLES = [f"{v}_{s}" for v in VITALS for s in windows.STATS] + [f"{v}_trend" for v in VITALS[:3]] + ["total_last"]
FEATURE_COLUMNS = "stay_id, window_id, " + ", ".join(f"{v}_missing" for v in VITALS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in DOUBLES)


def features(spark: SparkSession, d: str, minutes: int = DAY, joined: bool = False) -> DataFrame:
    return windows.window_features(observations(spark, d), stays(spark, d), VITALS, minutes, joined=joined)


def window_features(spark, d):
    return rounded(features(spark, d))


def window_features_5min(spark, d):
    return rounded(features(spark, d, 5))


def window_features_joined(spark, d):
    return rounded(features(spark, d, joined=True))


def master_join(spark, d):
    return stays(spark, d)


def code_map(spark, d):
    """Readings of three kinds under their clinical names."""
    names = {"click": "heart_rate", "error": "map", "view": "spo2"}
    o = observations(spark, d).where(F.col("vital_sign").isin(list(names))).dropna(subset=["stay_id", "charttime", "value"])
    name = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("vital_sign")]
    return rounded(o.groupBy(name.alias("vital")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")))


def enriched_windows(spark, d):
    x = windows.enriched(features(spark, d), stays(spark, d), "BUILDING", ["segment", "nation"])
    return rounded(x.groupBy("segment", "nation").agg(F.count("*").alias("n"), F.count_distinct("stay_id").alias("n_stays"), F.avg("click_last").alias("mean_click")))


def dup_audit(spark, d):
    return audits.duplicate_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_key_rows(spark, d):
    return audits.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def null_audit(spark, d):
    return audits.null_audit(windows.wide(windows.with_windows(observations(spark, d), stays(spark, d), DAY), VITALS))


def any_null(spark, d):
    return audits.any_null_rows(windows.wide(windows.with_windows(observations(spark, d), stays(spark, d), DAY), VITALS), MEANS)


def label_dist(spark, d):
    return stays(spark, d).groupBy("label").agg(F.count("*").alias("n_stays"), F.count_distinct("subject_id").alias("n_subjects")).orderBy("label")


def stay_gap_stats(spark, d):
    return audits.gap_statistics(features(spark, d).select("stay_id", "window_id"))


def _subject_split(spark, d):
    return splits.hash_split(splits.group_labels(stays(spark, d), "subject_id"), "subject_id", {"train": 0.7, "validation": 0.15, "test": 0.15})


def stratified_split(spark, d):
    return _subject_split(spark, d)


H = "CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0"
SPLIT_SQL = f"""{STAYS_SQL},
subjects AS (SELECT subject_id, max(label) AS label FROM stays GROUP BY 1),
hashed AS (SELECT *, {H.format(key="'42:' || label || ':' || subject_id")} AS h FROM subjects),
splits AS (SELECT subject_id, label, CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.85 THEN 'validation' ELSE 'test' END AS split FROM hashed)"""


def ranked_split(spark, d):
    p = predictions(spark, d).groupBy("stay_id").agg(F.max("label").alias("label"))
    return splits.ranked_split(p, "stay_id", {"tuning": 0.6, "calibration": 0.8, "evaluation": 1.0})


def _split_windows(spark, d):
    s = stays(spark, d)
    return splits.assigned(features(spark, d).select("stay_id", "window_id").join(s.select("stay_id", "subject_id", "label"), "stay_id"), _subject_split(spark, d), "subject_id")


def split_summary(spark, d):
    return splits.split_summary(_split_windows(spark, d), {"n_stays": "stay_id", "n_subjects": "subject_id"})


def overlap_audit(spark, d):
    """Subjects by the set of parts that their stays are in; the split is by stay here, so some overlap."""
    s = splits.hash_split(stays(spark, d), "stay_id", {"train": 0.7, "test": 0.3})
    return audits.overlap_audit(s, "subject_id", "split")


def conservation(spark, d):
    x = _split_windows(spark, d)
    whole = x.select("stay_id", "subject_id", "window_id")
    return audits.conservation(whole, {p: x.where(F.col("split") == p).select(*whole.columns) for p in ("train", "validation", "test")}, ["stay_id", "subject_id"])


def unassigned(spark, d):
    return _split_windows(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(F.col("split").isNull()).alias("n_unassigned"))


def table_diff(spark, d):
    """One-pass features against joined ones, after every tenth stay is left out of the second and one column is shifted."""
    a, b = features(spark, d), features(spark, d, joined=True)
    b = b.where(F.pmod("stay_id", F.lit(10)) != 0).withColumn("click_last", F.col("click_last") + F.when(F.pmod("window_id", F.lit(7)) == 0, 0.5).otherwise(0.0))
    return rounded(audits.table_difference(a, b, ["stay_id", "window_id"], ["click_last", "view_last"], 1e-7))


def key_difference(spark, d):
    a = features(spark, d).select("stay_id", "window_id")
    return audits.key_difference(a.where("window_id < 20"), a.where("window_id >= 5"), ["stay_id", "window_id"])


def label_consistency(spark, d):
    """Orders whose predictions have several labels (none), and whose lines have several ship dates' years (many)."""
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return audits.inconsistent_groups(li, "l_orderkey", ["year"]).groupBy("n_values").agg(F.count("*").alias("n_orders"))


def static_consistency(spark, d):
    e = table(spark, d, "events")
    return audits.inconsistent_groups(e.withColumn("hour", F.hour("ts")), "user_id", ["event_type", "hour"])


def forbidden_columns(spark, d):
    names = spark.createDataFrame([(c,) for t in ("orders", "lineitem", "customer", "events") for c in table(spark, d, t).columns], "name string")
    return audits.forbidden_columns(names, ["o_orderstatus", "l_linestatus"], ["date$", "balance", "acctbal"]).orderBy("name")


def schema_check(spark, d):
    return audits.schema_check(table(spark, d, "events"), {"event_id": "bigint", "user_id": "bigint", "value": "double", "charttime": "timestamp"})


def _imputed(spark, d, windows_=None):
    w = features(spark, d) if windows_ is None else windows_
    train = w.join(splits.assigned(stays(spark, d), _subject_split(spark, d), "subject_id").where("split = 'train'").select("stay_id"), "stay_id", "left_semi")
    return sequences.imputed(w.select("stay_id", "window_id", *MEANS), sequences.train_medians(train, MEANS, exact=True), MEANS)


IMPUTED_SQL = f"""{features_sql(DAY)},
subjects AS (SELECT subject_id, max(label) AS label FROM stays GROUP BY 1),
hashed AS (SELECT *, {H.format(key="'42:' || label || ':' || subject_id")} AS h FROM subjects),
med AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in MEANS)} FROM features f JOIN stays s USING (stay_id) JOIN hashed USING (subject_id) WHERE h < 0.7),
imputed AS (SELECT stay_id, window_id, {", ".join(f"coalesce({c}, m_{c}) AS {c}, CAST({c} IS NULL AS INTEGER) AS n_{c}" for c in MEANS)} FROM features, med)"""


def median_impute(spark, d):
    x = _imputed(spark, d)
    out = x.select("stay_id", "window_id", *[F.col("temporal_row")[k].alias(c) for k, c in enumerate(MEANS)], F.aggregate("mask_row", F.lit(0), lambda a, v: a + v).cast("long").alias("n_missing"))
    return rounded(out)


def norm_stats(spark, d):
    x = sequences.norm_statistics(_imputed(spark, d))
    return rounded(x.withColumn("feature", F.col("feature").cast("long")), 5)


def _tensors(spark, d):
    return sequences.tensors(sequences.histories(_imputed(spark, d), LENGTH), LENGTH, WIDTH)


def sequence_shape(spark, d):
    ok = sequences.integrity(LENGTH, WIDTH)
    x = _tensors(spark, d).withColumn("ok", ok).groupBy("sequence_length").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_valid"))
    return x.withColumn("sequence_length", F.col("sequence_length").cast("long"))


def sequence_padding(spark, d):
    first = F.col("temporal")[0][0]
    pads = F.aggregate("padding_mask", F.lit(0), lambda a, v: a + v).cast("long")
    return rounded(_tensors(spark, d).select("stay_id", "terminal_window_id", pads.alias("n_padding"), first.alias("first_value"), F.element_at("temporal", F.col("sequence_length"))[WIDTH - 1].alias("last_value")))


def mask_total(spark, d):
    return sequences.mask_total(_tensors(spark, d))


def _positions(spark, d):
    return sequences.histories(_imputed(spark, d), 1)


def checkpoint_fixed(spark, d):
    return _positions(spark, d).where(windows.fixed_checkpoint("position", "n_windows", CHECKPOINTS)).select("stay_id", "window_id", F.col("position").cast("long").alias("position"))


def checkpoint_adaptive(spark, d):
    return _positions(spark, d).where(windows.adaptive_checkpoint("position", "n_windows", 12)).select("stay_id", "window_id", F.col("position").cast("long").alias("position"))


POSITIONS_SQL = f"{features_sql(DAY)},\npositions AS (SELECT stay_id, window_id, row_number() OVER (PARTITION BY stay_id ORDER BY window_id) AS position, count(*) OVER (PARTITION BY stay_id) AS n FROM features)"


def onehot_width(spark, d):
    s = stays(spark, d)
    model = encode.fit_on(s, ["age"], ["segment", "region"])
    made = encode.dimension_audit(model.transform(s)).select(F.lit("vector").alias("column_name"), F.col("n_dims").cast("long").alias("width"))
    return encode.onehot_widths(s, ["segment", "region"]).unionByName(made)


def _attributed(spark, d):
    return encode.linear_attributions(features(spark, d).select("stay_id", "window_id", *MEANS), COEFFICIENTS, -1.0)


ATTRIBUTED_SQL = f"""{features_sql(DAY)},
mean AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in MEANS)} FROM features),
attr AS (SELECT stay_id, window_id, {", ".join(f"{b!r} * (coalesce({c}, m_{c}) - m_{c}) AS {c}" for c, b in COEFFICIENTS.items())}, -1.0 + {" + ".join(f"{b!r} * m_{c}" for c, b in COEFFICIENTS.items())} AS base FROM features, mean),
long AS ({" UNION ALL ".join(f"SELECT stay_id, window_id, base, {k} AS k, '{c}' AS feature, {c} AS v FROM attr" for k, c in enumerate(MEANS))})"""


def linear_attr_topk(spark, d):
    return rounded(encode.top_attributions(_attributed(spark, d), MEANS, 3, ["stay_id", "window_id"]))


def attr_importance(spark, d):
    return rounded(encode.importance(_attributed(spark, d), MEANS))


def attr_additivity(spark, d):
    """One margin in seven is off by a hundredth of the window's number, which the errors must show."""
    off = F.when(F.col("window_id") % 7 == 0, F.col("window_id") / 100).otherwise(0.0)
    return rounded(encode.additivity(_attributed(spark, d).withColumn("margin", F.col("margin") + off)))


def waterfall(spark, d):
    x = encode.waterfall(_attributed(spark, d), MEANS, ["stay_id", "window_id"], 3)
    return rounded(x.withColumn("step", F.col("step").cast("long")))


def rank_stability(spark, d):
    """Order priorities as runs, ship-date months as features."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    x = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_orderpriority").alias("run"), F.month("l_shipdate").alias("feature")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    return rounded(encode.rank_stability(x, "run", "feature", "value", 5))


def _by_split(spark, d, rows):
    """rows with their stay's label and their subject's split."""
    s = stays(spark, d).select("stay_id", "subject_id", "label").join(_subject_split(spark, d).select("subject_id", "split"), "subject_id")
    return rows.join(s, "stay_id")


def gbt_score(spark, d):
    """Boosted trees on the last values of train's windows for the stay's label, stopped early on validation; the score of the last window of each stay outside train."""
    w, cols = _by_split(spark, d, features(spark, d)), [f"{v}_last" for v in VITALS]
    model = encode.tree_model(w.where("split = 'train'"), cols, w.where("split = 'validation'"))
    return encode.scored(model, w.where("split <> 'train'")).groupBy("stay_id").agg(F.max("split").alias("split"), F.max_by("p", "window_id").alias("p"), F.max("label").alias("label"))


def sequence_score(spark, d):
    """A linear model on summaries of train's sequences; the scores of all sequences outside train."""
    x = _by_split(spark, d, sequences.summaries(sequences.tensors(sequences.histories(_imputed(spark, d), LENGTH), LENGTH, WIDTH), WIDTH).drop("label"))
    names = [c for c in x.columns if c.startswith("f") and c[1].isdigit()]
    return encode.scored(encode.linear_model(x.where("split = 'train'"), names), x.where("split <> 'train'")).select("stay_id", "terminal_window_id", "split", "label", "p")


QUERIES = {
    f.__name__: f
    for f in (
        window_features, window_features_5min, window_features_joined, master_join, code_map, enriched_windows, dup_audit, duplicate_key_rows, null_audit, any_null, label_dist, stay_gap_stats,
        stratified_split, ranked_split, split_summary, overlap_audit, conservation, unassigned, table_diff, key_difference, label_consistency, static_consistency, forbidden_columns, schema_check,
        median_impute, norm_stats, sequence_shape, sequence_padding, mask_total, checkpoint_fixed, checkpoint_adaptive, onehot_width, linear_attr_topk, attr_importance, attr_additivity, waterfall,
        rank_stability, gbt_score, sequence_score,
    )
}

_IMPUTED_LONG = " UNION ALL ".join(f"SELECT {k} AS feature, {c} AS v FROM imputed" for k, c in enumerate(MEANS))
_MASKS = " + ".join(f"n_{c}" for c in MEANS)
_ROWS = f"ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW"

ORACLE_SQL = {
    "window_features": f"WITH {features_sql(DAY)} SELECT {FEATURE_COLUMNS} FROM features",
    "window_features_5min": f"WITH {features_sql(5)} SELECT {FEATURE_COLUMNS} FROM features",
    "window_features_joined": f"WITH {features_sql(DAY)} SELECT {FEATURE_COLUMNS} FROM features",
    "master_join": f"WITH {STAYS_SQL} SELECT * FROM stays",
    "code_map": "SELECT CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'error' THEN 'map' ELSE 'spo2' END AS vital, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events WHERE event_type IN ('click', 'error', 'view') AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1",
    "enriched_windows": f"WITH {features_sql(DAY)} SELECT nullif(segment, 'BUILDING') AS segment, nullif(nation, 'BUILDING') AS nation, count(*) AS n, count(DISTINCT stay_id) AS n_stays, round(avg(click_last), 6) AS mean_click FROM features LEFT JOIN stays USING (stay_id) GROUP BY 1, 2",
    "dup_audit": "SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n > 1) AS n_duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS n_extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "duplicate_key_rows": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "null_audit": f"WITH {wide_sql(DAY)} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM wide" for c in ["stay_id", "window_id", *[f"{v}_{s}" for v in VITALS for s in windows.STATS]]),
    "any_null": f"WITH {wide_sql(DAY)} SELECT count(*) AS n_rows, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in MEANS)}) AS n_any_null FROM wide",
    "label_dist": f"WITH {STAYS_SQL} SELECT label, count(*) AS n_stays, count(DISTINCT subject_id) AS n_subjects FROM stays GROUP BY 1",
    "stay_gap_stats": f"WITH {features_sql(DAY)}, g AS (SELECT stay_id, window_id - lag(window_id) OVER (PARTITION BY stay_id ORDER BY window_id) AS gap FROM features) SELECT stay_id, count(*) AS n_windows, coalesce(max(gap), 0) AS max_gap, coalesce(max(gap) > 1, false) AS has_gap FROM g GROUP BY 1",
    "stratified_split": f"WITH {SPLIT_SQL} SELECT * FROM splits",
    "ranked_split": f"WITH {PREDS_SQL}, g AS (SELECT stay_id, max(label) AS label FROM preds GROUP BY 1), r AS (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY {H.format(key=chr(39) + '42:' + chr(39) + ' || stay_id')}, stay_id) AS x FROM g) SELECT stay_id, label, CASE WHEN x < 0.6 THEN 'tuning' WHEN x < 0.8 THEN 'calibration' ELSE 'evaluation' END AS split FROM r",
    "split_summary": f"WITH {SPLIT_SQL}, w AS (SELECT DISTINCT user_id AS stay_id, CAST(floor((floor(epoch(ts)) - floor(epoch(intime))) / 86400) AS BIGINT) AS window_id FROM events JOIN stays ON user_id = stay_id) SELECT split, count(*) AS n_rows, count(DISTINCT stay_id) AS n_stays, count(DISTINCT subject_id) AS n_subjects, CAST(sum(s.label) AS BIGINT) AS n_positive, round(avg(s.label), 6) AS prevalence FROM w JOIN stays s USING (stay_id) JOIN splits USING (subject_id) GROUP BY 1",
    "overlap_audit": f"WITH {STAYS_SQL}, s AS (SELECT subject_id, CASE WHEN {H.format(key=chr(39) + '42:' + chr(39) + ' || label || ' + chr(39) + ':' + chr(39) + ' || stay_id')} < 0.7 THEN 'train' ELSE 'test' END AS split FROM stays), p AS (SELECT subject_id, string_agg(DISTINCT split, '+' ORDER BY split) AS parts, count(DISTINCT split) > 1 AS overlap FROM s GROUP BY 1) SELECT parts, overlap, count(*) AS n_keys FROM p GROUP BY 1, 2",
    "conservation": f"WITH {SPLIT_SQL}, w AS (SELECT DISTINCT user_id AS stay_id, CAST(floor((floor(epoch(ts)) - floor(epoch(intime))) / 86400) AS BIGINT) AS window_id FROM events JOIN stays ON user_id = stay_id), x AS (SELECT stay_id, subject_id, split FROM w JOIN stays USING (stay_id) JOIN splits USING (subject_id)), p AS (SELECT count(*) AS a, count(DISTINCT stay_id) AS b, count(DISTINCT subject_id) AS c FROM x GROUP BY split), t AS (SELECT count(*) AS a, count(DISTINCT stay_id) AS b, count(DISTINCT subject_id) AS c FROM x), s AS (SELECT CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c FROM p) "
    + " UNION ALL ".join(f"SELECT '{m}' AS measure, t.{c} AS whole, s.{c} AS parts, t.{c} = s.{c} AS ok FROM t, s" for m, c in (("rows", "a"), ("stay_id", "b"), ("subject_id", "c"))),
    "unassigned": f"WITH {features_sql(DAY)} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unassigned FROM features",
    "table_diff": f"WITH {features_sql(DAY)} SELECT count(*) FILTER (stay_id % 10 = 0) AS only_a, CAST(0 AS BIGINT) AS only_b, count(*) FILTER (stay_id % 10 <> 0 AND window_id % 7 = 0 AND click_last IS NOT NULL) AS n_apart, 0.5 AS max_distance FROM features",
    "key_difference": f"WITH {features_sql(DAY)} SELECT stay_id, window_id, CASE WHEN window_id < 5 THEN 'missing' ELSE 'extra' END AS side FROM features WHERE window_id < 5 OR window_id >= 20",
    "label_consistency": "SELECT n_values, count(*) AS n_orders FROM (SELECT l_orderkey, count(DISTINCT year(l_shipdate)) AS n_values FROM lineitem GROUP BY 1) WHERE n_values > 1 GROUP BY 1",
    "static_consistency": "SELECT user_id, count(DISTINCT event_type || ':' || hour(ts)) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type || ':' || hour(ts)) > 1",
    "median_impute": f"WITH {IMPUTED_SQL} SELECT stay_id, window_id, {', '.join(f'round({c}, 6) AS {c}' for c in MEANS)}, CAST({_MASKS} AS BIGINT) AS n_missing FROM imputed",
    "norm_stats": f"WITH {IMPUTED_SQL}, l AS ({_IMPUTED_LONG}) SELECT CAST(feature AS BIGINT) AS feature, count(*) AS n, round(avg(v), 5) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END, 5) AS deviation FROM l GROUP BY 1",
    "sequence_shape": f"WITH {POSITIONS_SQL} SELECT least(position, {LENGTH}) AS sequence_length, count(*) AS n, count(*) AS n_valid FROM positions GROUP BY 1",
    "sequence_padding": f"WITH {IMPUTED_SQL} SELECT stay_id, window_id AS terminal_window_id, {LENGTH} - count(*) OVER w AS n_padding, round(first_value({MEANS[0]}) OVER w, 6) AS first_value, round({MEANS[-1]}, 6) AS last_value FROM imputed WINDOW w AS (PARTITION BY stay_id ORDER BY window_id {_ROWS})",
    "mask_total": f"WITH {IMPUTED_SQL}, s AS (SELECT sum({_MASKS}) OVER w AS m, count(*) OVER w AS n FROM imputed WINDOW w AS (PARTITION BY stay_id ORDER BY window_id {_ROWS})) SELECT count(*) AS n_sequences, CAST(sum(m) AS BIGINT) AS n_missing, CAST(sum(n) AS BIGINT) AS n_steps FROM s",
    "checkpoint_fixed": f"WITH {POSITIONS_SQL} SELECT stay_id, window_id, position FROM positions WHERE position IN {CHECKPOINTS} OR position = n",
    "checkpoint_adaptive": f"WITH {POSITIONS_SQL} SELECT stay_id, window_id, position FROM positions WHERE (position * least(n, 12) + n - 1) // n <> ((position - 1) * least(n, 12) + n - 1) // n OR position = n",
    "onehot_width": f"WITH {STAYS_SQL} SELECT 'segment' AS column_name, count(DISTINCT segment) + 1 AS width FROM stays UNION ALL SELECT 'region', count(DISTINCT region) + 1 FROM stays UNION ALL SELECT 'vector', count(DISTINCT segment) + count(DISTINCT region) + 3 FROM stays",
    "linear_attr_topk": f"WITH {ATTRIBUTED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stay_id, window_id ORDER BY abs(v) DESC, k) AS rank FROM long) SELECT stay_id, window_id, CAST(rank AS INTEGER) AS rank, feature, round(v, 6) AS attribution FROM r WHERE rank <= 3",
    "attr_importance": f"WITH {ATTRIBUTED_SQL}, m AS (SELECT feature, k, avg(abs(v)) AS a, avg(v) AS b FROM long GROUP BY 1, 2) SELECT feature, round(a, 6) AS mean_abs, round(b, 6) AS mean, CAST(row_number() OVER (ORDER BY a DESC, k) AS INTEGER) AS rank FROM m",
    "attr_additivity": f"WITH {features_sql(DAY)}, e AS (SELECT CASE WHEN window_id % 7 = 0 THEN window_id / 100.0::DOUBLE ELSE 0 END AS error FROM features) SELECT count(*) AS n, round(avg(error), 6) AS mean_error, round(quantile_cont(error, 0.5), 6) AS median_error, round(max(error), 6) AS max_error FROM e",
    "waterfall": f"WITH {ATTRIBUTED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stay_id, window_id ORDER BY abs(v) DESC, k) - 1 AS step FROM long), b AS (SELECT stay_id, window_id, base, step, feature, v FROM r WHERE step < 3 UNION ALL SELECT stay_id, window_id, base, 3, 'Other', sum(v) FROM r WHERE step >= 3 GROUP BY 1, 2, 3), e AS (SELECT *, base + sum(v) OVER (PARTITION BY stay_id, window_id ORDER BY step) AS t FROM b) SELECT stay_id, window_id, step, feature, round(v, 6) AS value, round(t - v, 6) AS start, round(t, 6) AS \"end\" FROM e",
    "rank_stability": "WITH s AS (SELECT o_orderpriority AS run, month(l_shipdate) AS feature, round(sum(l_quantity), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), r AS (SELECT run, feature, row_number() OVER (PARTITION BY run ORDER BY value DESC, feature) AS rank FROM s) SELECT a.run AS run_a, b.run AS run_b, round(corr(a.rank, b.rank), 6) AS spearman, round(count(*) FILTER (a.rank <= 5 AND b.rank <= 5) / count(*) FILTER (a.rank <= 5 OR b.rank <= 5), 6) AS top_jaccard FROM r a JOIN r b USING (feature) WHERE a.run < b.run GROUP BY 1, 2",
}
