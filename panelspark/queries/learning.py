"""Feature selection, text vectors and model evaluation."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import evaluate, models, scale, select, text
from panelspark.operators.boost import BINS
from panelspark.queries.base import DIM, MATRIX, PANEL_LABEL, SCORED, TEXTS, query, rounded

COORDS = [f"e{i}" for i in range(DIM)]


def _labelled(t) -> DataFrame:
    return t.matrix.withColumn("y", (F.col("label") == 0).cast("int"))


_CORR = "s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(coalesce(corr({c}, (label = 0)::INT), 0)) AS score FROM matrix" for c in COORDS) + ")"
_ANOVA = (
    "per AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v FROM matrix GROUP BY label" for c in COORDS) + "), "
    "tot AS (SELECT feature, sum(n) AS tn, sum(n * m) / sum(n) AS grand, sum(n * v) AS within, count(*) AS k FROM per GROUP BY feature), "
    "s AS (SELECT feature, (sum(n * pow(m - grand, 2)) / (any_value(k) - 1)) / (any_value(within) / (any_value(tn) - any_value(k))) AS score FROM per JOIN tot USING (feature) GROUP BY feature)"
)


def _top_sql(selector: str, k: int, digits: int) -> str:
    return (
        f"SELECT feature, '{selector}' AS selector, row_number() OVER (ORDER BY score DESC, feature) <= {k} AS picked, "
        f"round(score + 1e-{digits + 3}, {digits}) AS score FROM s"
    )


@query("select_correlation", f"WITH {MATRIX}, {_CORR} {_top_sql('Pearson', 3, 8)}")
def select_correlation(t):
    return rounded(select.select_correlation(_labelled(t), COORDS, "y", 3), 8, "score")


@query("select_anova_f", f"WITH {MATRIX}, {_ANOVA} {_top_sql('Chi-2', 3, 6)}")
def select_anova_f(t):
    return rounded(select.select_anova_f(t.matrix, COORDS, "label", 3), 6, "score")


@query("select_logistic")
def select_logistic(t):
    return rounded(select.select_logistic(_labelled(t), COORDS, "y"), 4, "score")


@query("select_rfe")
def select_rfe(t):
    return select.select_rfe(_labelled(t), COORDS, "y", keep=24, step=10)


@query("select_forest")
def select_forest(t):
    return rounded(select.select_forest(_labelled(t), COORDS, "y"), 6, "score")


@query("select_boosting")
def select_boosting(t):
    return rounded(select.select_boosting(_labelled(t), COORDS, "y"), 6, "score")


_VOTES = (("Pearson", 5), ("Logistic", 4), ("Random Forest", 3), ("Recursive", 6), ("LightGBM", 2))


@query(
    "vote_features",
    f"WITH {MATRIX}, {_CORR}, c AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rk FROM s), "
    + _ANOVA.replace("s AS (SELECT", "f AS (SELECT") + ", a AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rk FROM f), "
    "v AS (SELECT c.feature, " + ", ".join(f"(c.rk <= {k})::INT AS \"{n}\"" for n, k in _VOTES) + ", (a.rk <= 4)::INT AS \"Chi-2\" FROM c JOIN a USING (feature)) "
    "SELECT *, (\"Pearson\" + \"Chi-2\" + \"Logistic\" + \"Random Forest\" + \"Recursive\" + \"LightGBM\")::BIGINT AS total, "
    "\"Pearson\" + \"Chi-2\" + \"Logistic\" + \"Random Forest\" + \"Recursive\" + \"LightGBM\" >= 5 AS chosen FROM v",
)
def vote_features(t):
    """The tally alone: its SQL states cuts of two rankings under the selectors' names; ``vote_selectors`` runs all six."""
    df = _labelled(t)
    votes = [select.select_correlation(df, COORDS, "y", k).withColumn("selector", F.lit(n)) for n, k in _VOTES]
    votes.append(select.select_anova_f(t.matrix, COORDS, "label", 4))
    return select.vote_features(votes)


@query("vote_selectors")
def vote_selectors(t):
    """The votes of all six selectors, each with the settings of its own query."""
    df = _labelled(t)
    votes = [
        select.select_correlation(df, COORDS, "y", 3), select.select_anova_f(t.matrix, COORDS, "label", 3), select.select_logistic(df, COORDS, "y"),
        select.select_forest(df, COORDS, "y"), select.select_rfe(df, COORDS, "y", keep=24, step=10), select.select_boosting(df, COORDS, "y"),
    ]
    return select.vote_features(votes)


def _numeric_panel(t) -> DataFrame:
    return t.panel_label.select(F.col("amt"), F.hour("t").alias("hour"), F.weekday("t").alias("weekday"), F.col("key").cast("int").alias("key"), "f")


_COLS = ["amt", "hour", "weekday", "key"]


@query("feature_importance_rank")
def feature_importance_rank(t):
    df = t.orders_panel.select(
        "row_id", F.col("amt"), F.month("t").alias("month"), F.weekday("t").alias("weekday"), F.col("priority"),
        F.when(F.col("row_id") % 11 != 0, F.year("t").cast("string")).alias("year"), (F.col("status") == "F").cast("int").alias("f"),
    )
    out = select.importance_report(df, ["amt", "month", "weekday"], ["priority", "year"], "f", "row_id")
    return rounded(out, 6, "importance")


@query("boosting_importance_rank")
def boosting_importance_rank(t):
    return rounded(select.boosting_importance_rank(_numeric_panel(t), _COLS, "f"), 6, "importance")


@query("xgb_importance_rank")
def xgb_importance_rank(t):
    return rounded(select.xgb_importance_rank(_numeric_panel(t), _COLS, "f"), 6, "importance")


BOUNDS = ", ".join(f"{i} / {BINS}.0::DOUBLE" for i in range(1, BINS))
#: boosted stumps as a recursion over the rounds: row weights, a histogram per column and bin, the purest split, its stage
_STUMPS = f"""RECURSIVE cells AS (
  SELECT vec_id AS row_id, (label = 0)::INT AS y, unnest(range(0, {DIM}))::INT AS f, unnest(embedding::DOUBLE[]) AS x FROM embeddings
), bounds AS (
  SELECT f, list_sort(list_distinct(quantile_disc(x, [{BOUNDS}]))) AS c FROM cells GROUP BY f
), binned AS (
  SELECT row_id, y, f, list_sum(list_transform(c, lambda v : (v < x)::INT))::INT AS b FROM cells JOIN bounds USING (f)
), r AS (
  SELECT 0 AS k, row_id, 0.0::DOUBLE AS lw, NULL::INT AS f, NULL::INT AS cut, NULL::INT AS below, NULL::INT AS above,
    NULL::DOUBLE AS error, NULL::DOUBLE AS stage
  FROM (SELECT DISTINCT row_id FROM cells)
  UNION ALL
  SELECT r.k + 1, r.row_id, r.lw + CASE WHEN (CASE WHEN b.b <= s.cut THEN s.below ELSE s.above END) <> b.y THEN s.stage ELSE 0 END,
    s.f, s.cut, s.below, s.above, s.error, s.stage
  FROM r JOIN (
    SELECT f, b AS cut, (l1 > l0)::INT AS below, (g1 > g0)::INT AS above, greatest(least(l0, l1) + least(g0, g1), 0) AS error,
      CASE WHEN error <= 1e-12 THEN 1 ELSE ln((1 - error) / error) END AS stage
    FROM (
      SELECT f, b, l0, l1, t0 - l0 AS g0, t1 - l1 AS g1, (l0 * l0 + l1 * l1) / (l0 + l1) + (g0 * g0 + g1 * g1) / (g0 + g1) AS pure
      FROM (
        SELECT f, b, sum(w0) OVER (PARTITION BY f ORDER BY b) AS l0, sum(w1) OVER (PARTITION BY f ORDER BY b) AS l1,
          sum(w0) OVER (PARTITION BY f) AS t0, sum(w1) OVER (PARTITION BY f) AS t1, max(b) OVER (PARTITION BY f) AS last
        FROM (
          SELECT f, b, sum(w * (1 - y)) AS w0, sum(w * y) AS w1
          FROM (SELECT row_id, exp(lw - m) / sum(exp(lw - m)) OVER () AS w FROM (SELECT row_id, lw, max(lw) OVER () AS m FROM r))
          JOIN binned USING (row_id) GROUP BY f, b
        )
      ) WHERE b < last
    ) ORDER BY round(pure, 10) DESC, f, b LIMIT 1
  ) s ON true JOIN binned b ON b.row_id = r.row_id AND b.f = s.f
  WHERE r.k < 500 AND s.error < 0.5 AND coalesce(r.error, 1) > 1e-12
), stumps AS (
  SELECT k, f, cut, below, above, error, stage FROM r WHERE k > 0 GROUP BY ALL
)"""


@query(
    "adaboost_rounds",
    f"WITH {_STUMPS} SELECT k AS round, concat('e', f) AS feature, round(c[cut + 1] + 1e-9, 6) AS bound, below, above, "
    "round(error + 1e-9, 6) AS error, round(stage + 1e-9, 6) AS stage FROM stumps JOIN bounds USING (f)",
)
def adaboost_rounds(t):
    return rounded(select.adaboost_rounds(_labelled(t), COORDS, "y"), 6, "bound", "error", "stage")


@query(
    "adaboost_importance_rank",
    f"WITH {_STUMPS}, share AS (SELECT concat('e', i) AS feature, coalesce(sum(stage) / (SELECT sum(stage) FROM stumps), 0) AS importance "
    f"FROM range({DIM}) d(i) LEFT JOIN stumps ON f = i GROUP BY i) "
    "SELECT row_number() OVER (ORDER BY importance DESC, feature)::INT AS position, feature, round(importance + 1e-9, 6) AS importance FROM share",
)
def adaboost_importance_rank(t):
    return rounded(select.adaboost_importance_rank(_labelled(t), COORDS, "y"), 6, "importance")


# ---- text --------------------------------------------------------------------------------------

_TOK = (
    f"{TEXTS}, raw AS (SELECT row_id, regexp_extract_all(lower(coalesce(text, 'Not exist')), '[\\p{{L}}\\p{{N}}]+') AS k FROM texts), "
    "tok AS (SELECT row_id, CASE WHEN len(k) > 0 THEN k ELSE ['not', 'exist'] END AS k FROM raw)"
)


@query("tokenize_columns", f"WITH {_TOK} SELECT row_id, array_to_string(k, ' ') AS tokens, len(k)::INT AS n FROM tok")
def tokenize_columns(t):
    out = text.tokenize_columns(t.texts, ["text"])
    return out.select("row_id", F.array_join("text_tokens", " ").alias("tokens"), F.size("text_tokens").alias("n"))


@query(
    "hashed_bow",
    f"WITH {_TOK}, w AS (SELECT row_id, unnest(k) AS w FROM tok), c AS (SELECT row_id, w, count(*) AS c FROM w GROUP BY row_id, w), "
    "b AS (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM c)), "
    "d AS (SELECT w, list_transform(range(len(h) // 2), lambda i : ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS v FROM b), "
    "a AS (SELECT w, (((len(v) + list_sum(list_transform(range(len(v)), lambda i : (len(v) - i) * v[i + 1]))) % 65521) * 65536 + (1 + list_sum(v)) % 65521) % 32000 AS token_id FROM d) "
    "SELECT row_id, token_id::INT AS token_id, sum(c)::BIGINT AS cnt FROM c JOIN a USING (w) GROUP BY row_id, token_id",
)
def hashed_bow(t):
    return text.hashed_bow(text.tokenize_columns(t.texts, ["text"]), "row_id", "text_tokens")


def _lda(t, df):
    return text.lda_fit(df, "text_tokens", 4, t.scratch("lda"))


@query("lda_fit")
def lda_fit(t):
    df = text.tokenize_columns(t.texts, ["text"])
    path = t.scratch("lda")
    text.lda_fit(df, "text_tokens", 4, path)
    return text.topic_ids(text.lda_load(t.spark, path), 10).withColumn("weight", F.round("weight", 6))


@query("lda_vectors", f"WITH {TEXTS} SELECT row_id, 4 AS n_topics, 1.0::DOUBLE AS mass, true AS positive FROM texts")
def lda_vectors(t):
    df = text.tokenize_columns(t.texts, ["text"])
    out = text.lda_vectors(df, "text_tokens", _lda(t, df), "vec")
    return out.select(
        "row_id", F.size("vec").alias("n_topics"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("mass"),
        F.forall("vec", lambda x: x > 0).alias("positive"),
    )


_SIGN = "CASE WHEN substr(md5(concat_ws('~', w, '42', '0')), {0} + 1, 1) >= '8' THEN 1 ELSE -1 END"
_AROUND = "(PARTITION BY row_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(
    "doc_embedding",
    f"WITH {_TOK}, w AS (SELECT row_id, k[i] AS w, i FROM (SELECT row_id, k, unnest(range(1, len(k) + 1)) AS i FROM tok)), "
    f"s AS (SELECT *, {', '.join(f'{_SIGN.format(j)} AS s{j}' for j in range(4))} FROM w), "
    f"c AS (SELECT w, {', '.join(f'sum(s{j}) OVER {_AROUND} - s{j} AS c{j}' for j in range(4))}, count(*) OVER {_AROUND} - 1 AS m FROM s), "
    f"e AS (SELECT w, {', '.join(f'CASE WHEN sum(m) > 0 THEN sum(c{j}) / sum(m) ELSE 0 END AS e{j}' for j in range(4))} FROM c GROUP BY w) "
    f"SELECT row_id, {', '.join(f'round(avg(e{j}) + 1e-9, 6) AS v{j}' for j in range(4))} FROM w JOIN e USING (w) GROUP BY row_id",
)
def doc_embedding(t):
    df = text.tokenize_columns(t.texts, ["text"])
    out = text.doc_embedding(df, "text_tokens", "vec", 4).select("row_id", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)])
    return rounded(out, 6, *[f"v{i}" for i in range(4)])


@query("spread_vectors", "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS emb_{i}" for i in range(64)) + " FROM embeddings")
def spread_vectors(t):
    return text.spread_vectors(t.embeddings, "embedding", "emb", 64)


@query("text_features", f"WITH {TEXTS} SELECT row_id, 1.0::DOUBLE AS mass FROM texts")
def text_features(t):
    out = text.text_features(t.texts, ["text"], "lda", 4, t.scratch("lda"))
    return out.select("row_id", F.round(sum(F.col(f"text_{i}") for i in range(4)), 6).alias("mass"))


# ---- evaluation --------------------------------------------------------------------------------

_CM = (
    "count(*) FILTER (f = 1 AND score >= 0.5) AS tp, count(*) FILTER (f = 1 AND score < 0.5) AS fn, "
    "count(*) FILTER (f = 0 AND score >= 0.5) AS fp, count(*) FILTER (f = 0 AND score < 0.5) AS tn"
)
_PR = (
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + 1e-12, 9) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END + 1e-12, 9) AS precision"
)


@query("confusion_counts", f"WITH {SCORED} SELECT {_CM} FROM scored")
def confusion_counts(t):
    return evaluate.confusion_counts(t.scored, "f", "score")


@query(
    "binary_metrics",
    f"WITH {SCORED}, c AS (SELECT {_CM} FROM scored) SELECT *, {_PR}, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END + 1e-12, 9) AS f1 FROM c",
)
def binary_metrics(t):
    return rounded(evaluate.binary_metrics(t.scored, "f", "score"), 9, "recall", "precision", "f1")


@query("threshold_eval_log", f"WITH {SCORED}, c AS (SELECT round, {_CM} FROM scored GROUP BY round) SELECT round, {_PR} FROM c")
def threshold_eval_log(t):
    return rounded(evaluate.threshold_eval_log(t.scored, "f", "score", "round"), 9, "recall", "precision")


@query(
    "auc",
    f"WITH {SCORED}, r AS (SELECT f, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored), "
    "s AS (SELECT count(*) FILTER (f = 1)::DOUBLE AS p, count(*) FILTER (f = 0)::DOUBLE AS q, sum(r) FILTER (f = 1) AS rs FROM r) "
    "SELECT round((rs - p * (p + 1) / 2) / (p * q) + 1e-12, 9) AS auc FROM s",
)
def auc(t):
    return rounded(evaluate.auc(t.scored, "f", "score"), 9, "auc")


@query(
    "focal_loss_metric",
    f"WITH {SCORED}, l AS (SELECT greatest(CASE WHEN f = 0 THEN 4 * pow(1 - (1 - score + 1e-9), 2) * -ln(1 - score + 1e-9) ELSE 0 END, "
    "CASE WHEN f = 1 THEN 4 * pow(1 - (score + 1e-9), 2) * -ln(score + 1e-9) ELSE 0 END) AS x FROM scored) SELECT round(avg(x) + 1e-11, 8) AS focal_loss FROM l",
)
def focal_loss_metric(t):
    df = t.scored.select("f", (1 - F.col("score")).alias("p0"), F.col("score").alias("p1"))
    return rounded(evaluate.focal_loss(df, "f", ["p0", "p1"]), 8, "focal_loss")


@query(
    "balanced_class_weights",
    f"WITH {PANEL_LABEL} SELECT target, round((SELECT count(*) FROM panel) / ((SELECT count(DISTINCT target) FROM panel) * count(*)) + 1e-12, 9) AS weight FROM panel GROUP BY target",
)
def balanced_class_weights(t):
    return rounded(evaluate.balanced_class_weights(t.panel_label, "target"), 9, "weight")


def _net(t):
    df = scale.scale(_labelled(t), COORDS, "minmax")
    return df, models.fit_mlp(df, COORDS, "y")


@query("fit_mlp")
def fit_mlp(t):
    df, net = _net(t)
    return models.score_table(net, df, COORDS).select("row_id", F.round("score", 4).alias("score"), "predicted")


@query("score_table", "SELECT count(*) AS n_rows, count(*) AS n_valid, count(DISTINCT vec_id) AS n_ids FROM embeddings")
def score_table(t):
    df, net = _net(t)
    out = models.score_table(net, df, COORDS)
    ok = F.col("score").between(0, 1) & F.col("predicted").isin(0, 1)
    return out.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_valid"), F.countDistinct("row_id").alias("n_ids"))
