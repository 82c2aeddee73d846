"""Hypothesis tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelspark.operators import stats
from panelspark.queries.base import STAT, chi2_sf_sql, query, rounded, t_two_sided_sql, upper_tail_sql

AMOUNTS = ["x1", "x2"]
PAIRED = ["x1", "x2", "x3"]
CODED = ["x2", "x3", "x4", "x5"]


def _each(cols, body: str) -> str:
    """UNION ALL of ``body`` with {c} replaced by each column."""
    return " UNION ALL ".join(body.replace("{c}", c) for c in cols)


def _each_pair(cols, body: str) -> str:
    return " UNION ALL ".join(body.replace("{a}", a).replace("{b}", b) for a, b in combinations(cols, 2))


@query("test_shapiro")
def test_shapiro(t):
    # per weekday, so that groups stay below the size rule
    df = t.stat.withColumn("g", F.col("x3") * 24 + F.col("x2"))
    return rounded(stats.test_shapiro(df, ["x1"], "g"), 6, "statistic", "p_value")


# distinct values with the rows below (b), the rows at (c) and the rows of the group (n)
_STEPS = (
    "k AS (" + _each(AMOUNTS, "SELECT '{c}' AS \"column\", f, {c}::DOUBLE AS v, count(*)::DOUBLE AS c FROM stat GROUP BY f, {c}") + "), "
    "cum AS (SELECT *, sum(c) OVER (PARTITION BY \"column\", f ORDER BY v) - c AS b, sum(c) OVER (PARTITION BY \"column\", f) AS n FROM k)"
)


@query(
    "test_ks_normal",
    f"WITH {STAT}, {_STEPS}, u AS (SELECT *, {upper_tail_sql('abs(v)')} AS up FROM cum), p AS (SELECT *, CASE WHEN v >= 0 THEN 1 - up ELSE up END AS phi FROM u), "
    "d AS (SELECT \"column\", f, max(greatest((b + c) / n - phi, phi - b / n)) AS d, max(n) AS n FROM p GROUP BY ALL), "
    "l AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM d) "
    "SELECT \"column\", f, round(d + 1e-9, 6) AS statistic, "
    "round(least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j : (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * lam * lam))))) + 1e-9, 6) AS p_value FROM l",
)
def test_ks_normal(t):
    return rounded(stats.test_ks_normal(t.stat, AMOUNTS, "f", at_least=1), 6, "statistic", "p_value")


_DAG = (
    "m AS (" + _each(AMOUNTS, "SELECT '{c}' AS \"column\", f, count({c})::DOUBLE AS n, skewness({c}) AS sk, kurtosis_pop({c}) AS g2 FROM stat GROUP BY f") + "), "
    "a AS (SELECT *, sk * (n - 2) / sqrt(n * (n - 1)) AS g1 FROM m), "
    "s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, "
    "(g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, "
    "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM a), "
    "w AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS aa FROM s), "
    "z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, 1 + x * sqrt(2 / (aa - 4)) AS den FROM w), "
    "dz AS (SELECT *, (1 - 2 / (9 * aa) - sign(den) * pow((1 - 2 / aa) / abs(den), 1 / 3.0)) / sqrt(2 / (9 * aa)) AS zk FROM z)"
)


@query(
    "test_dagostino",
    f"WITH {STAT}, {_DAG} SELECT \"column\", f, round(zs + 1e-7, 4) AS z_skew, round(zk + 1e-7, 4) AS z_kurt, round(zs * zs + zk * zk + 1e-6, 3) AS statistic, "
    "round(exp(-(zs * zs + zk * zk) / 2) + 1e-9, 6) AS p_value FROM dz",
)
def test_dagostino(t):
    out = stats.test_dagostino(t.stat, AMOUNTS, "f")
    return rounded(rounded(rounded(out, 4, "z_skew", "z_kurt"), 3, "statistic"), 6, "p_value")


@query(
    "test_anderson",
    f"WITH {STAT}, {_STEPS}, m AS (SELECT \"column\", f, sum(v * c) / sum(c) AS mean FROM k GROUP BY ALL), "
    "s AS (SELECT \"column\", f, mean, sqrt(sum(c * (v - mean) * (v - mean)) / (sum(c) - 1)) AS sd FROM k JOIN m USING (\"column\", f) GROUP BY ALL), "
    f"z AS (SELECT *, (v - mean) / sd AS z FROM cum JOIN s USING (\"column\", f)), u AS (SELECT *, {upper_tail_sql('abs(z)')} AS up FROM z), "
    "t AS (SELECT *, CASE WHEN z >= 0 THEN 1 - up ELSE up END AS lo, CASE WHEN z >= 0 THEN up ELSE 1 - up END AS hi FROM u), "
    "a AS (SELECT \"column\", f, max(n) AS n, -max(n) - sum(c * (2 * b + c) * ln(lo) + c * (2 * n - 2 * b - c) * ln(hi)) / max(n) AS stat FROM t GROUP BY ALL), "
    "lv AS (SELECT unnest([0.576, 0.656, 0.787, 0.918, 1.092])::DOUBLE AS cv, unnest([15.0, 10.0, 5.0, 2.5, 1.0])::DOUBLE AS level) "
    "SELECT \"column\", f, round(stat + 1e-7, 4) AS statistic, level, round(cv / (1 + 4 / n - 25 / (n * n)), 3) AS critical, stat < round(cv / (1 + 4 / n - 25 / (n * n)), 3) AS normal FROM a, lv",
)
def test_anderson(t):
    return rounded(stats.test_anderson(t.stat, AMOUNTS, "f"), 4, "statistic")


def _r_tail(r: str, n: str) -> str:
    """Two-sided p of a correlation ``r`` of ``n`` rows."""
    return f"CASE WHEN abs({r}) >= 1 THEN 0 ELSE {t_two_sided_sql(f'({r} * sqrt(({n} - 2) / (1 - {r} * {r})))', f'({n} - 2)')} END"


_NAMES = "'{a}' AS \"column\", '{b}' AS column2"
#: per test the relations it needs and its last one: every column of the test with s (statistic) and p, not rounded
RAW: dict[str, tuple[str, str]] = {}


def _with(*tests: str) -> str:
    """All relations of ``tests``, each under its own name; what several of them need stands once."""
    seen = dict.fromkeys(part for t in tests for part in [*RAW[t][0].split(" ;; "), f"{t}_p AS ({RAW[t][1]})"] if part)
    return f"WITH {STAT}, " + ", ".join(seen)


RAW["pearson"] = (
    "pearson AS (" + _each_pair(PAIRED, f"SELECT {_NAMES}, f, corr({{a}}, {{b}}) AS s, count(*) AS n FROM stat GROUP BY f") + ")",
    f"SELECT *, {_r_tail('s', 'n')} AS p FROM pearson",
)


@query("test_pearson", _with("pearson") + ' SELECT "column", column2, f, round(s + 1e-11, 8) AS statistic, n, round(p + 1e-9, 6) AS p_value FROM pearson_p')
def test_pearson(t):
    return rounded(rounded(stats.test_pearson(t.stat, PAIRED, "f"), 8, "statistic"), 6, "p_value")


def _chi2_raw(cols: list[str], tag: str) -> tuple[str, str]:
    by = '"column", column2, f'
    return (
        f"o_{tag} AS (" + _each_pair(cols, f"SELECT {_NAMES}, f, {{a}}::DOUBLE AS a, {{b}}::DOUBLE AS b, count(*) AS o FROM stat GROUP BY f, {{a}}, {{b}}") + ") ;; "
        f"r_{tag} AS (SELECT {by}, a, sum(o) AS r FROM o_{tag} GROUP BY ALL) ;; c_{tag} AS (SELECT {by}, b, sum(o) AS c FROM o_{tag} GROUP BY ALL) ;; "
        f"n_{tag} AS (SELECT {by}, sum(o) AS n FROM o_{tag} GROUP BY ALL) ;; "
        f"g_{tag} AS (SELECT r.*, c.b, c.c, n.n, r.r * c.c / n.n AS e, coalesce(o.o, 0) AS o FROM r_{tag} r JOIN c_{tag} c USING ({by}) JOIN n_{tag} n USING ({by}) "
        f"LEFT JOIN o_{tag} o ON o.\"column\" = r.\"column\" AND o.column2 = r.column2 AND o.f = r.f AND o.a = r.a AND o.b = c.b) ;; "
        f"d_{tag} AS (SELECT {by}, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, sum((o - e) * (o - e) / e) AS x, "
        f"sum(pow(greatest(abs(o - e) - least(0.5, abs(o - e)), 0), 2) / e) AS y FROM g_{tag} GROUP BY ALL) ;; "
        f"{tag} AS (SELECT {by}, CASE WHEN dof = 1 THEN y ELSE x END AS s, dof FROM d_{tag})",
        f"SELECT *, {chi2_sf_sql('s', 'dof')} AS p FROM {tag}",
    )


RAW["chi2"] = _chi2_raw(CODED, "chi2")
RAW["chi2_paired"] = _chi2_raw(PAIRED, "chi2_paired")


@query("test_chi2", _with("chi2") + ' SELECT "column", column2, f, round(s + 1e-9, 6) AS statistic, dof, round(p + 1e-9, 6) AS p_value FROM chi2_p')
def test_chi2(t):
    return rounded(stats.test_chi2(t.stat, CODED, "f"), 6, "statistic", "p_value")


def _avg_rank(part: str, c: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"{part}, " if part else ""
    return f"rank() OVER ({p}ORDER BY {c}) + (count(*) OVER (PARTITION BY {q}{c}) - 1) / 2.0"


RAW["spearman"] = (
    "ranked AS (SELECT f, " + ", ".join(f"{_avg_rank('f', c)} AS {c}" for c in PAIRED) + " FROM stat) ;; "
    "spearman AS (" + _each_pair(PAIRED, f"SELECT {_NAMES}, f, corr({{a}}, {{b}}) AS s, count(*) AS n FROM ranked GROUP BY f") + ")",
    f"SELECT *, {_r_tail('s', 'n')} AS p FROM spearman",
)


@query("test_spearman", _with("spearman") + ' SELECT "column", column2, f, round(s + 1e-11, 8) AS statistic, n, round(p + 1e-9, 6) AS p_value FROM spearman_p')
def test_spearman(t):
    return rounded(rounded(stats.test_spearman(t.stat, PAIRED, "f"), 8, "statistic"), 6, "p_value")


_SIGNS = [
    f"sum(CASE WHEN (p.{a} - q.{a}) * (p.{b} - q.{b}) {op} 0 THEN 1 ELSE 0 END)::DOUBLE AS {tag}_{a}_{b}"
    for a, b in combinations(PAIRED, 2)
    for op, tag in ((">", "con"), ("<", "dis"))
]
#: the tie terms of a variance: pairs, and sums of the third order
_TIE_SUMS = "sum(k * (k - 1) / 2) AS t2, sum(k * (k - 1) * (k - 2)) AS t0, sum(k * (k - 1) * (2 * k + 5)) AS t1"
_TAU_VAR = "((n * (n - 1) * (2 * n + 5) - x.t1 - y.t1) / 18 + 2 * x.t2 * y.t2 / (n * (n - 1)) + x.t0 * y.t0 / (9 * n * (n - 1) * (n - 2)))"
RAW["kendall"] = (
    f"signs AS (SELECT p.f, {', '.join(_SIGNS)} FROM stat p JOIN stat q ON p.f = q.f AND p.row_id < q.row_id GROUP BY p.f) ;; "
    "sized AS (SELECT f, count(*)::DOUBLE AS n FROM stat GROUP BY f) ;; "
    + " ;; ".join(f"tie_{c} AS (SELECT f, {_TIE_SUMS} FROM (SELECT f, count(*)::DOUBLE AS k FROM stat GROUP BY f, {c}) GROUP BY f)" for c in PAIRED)
    + " ;; kendall AS ("
    + _each_pair(
        PAIRED,
        f"SELECT {_NAMES}, f, con_{{a}}_{{b}} AS con, dis_{{a}}_{{b}} AS dis, (con - dis) / sqrt((n * (n - 1) / 2 - x.t2) * (n * (n - 1) / 2 - y.t2)) AS s, "
        f"(con - dis) / sqrt({_TAU_VAR}) AS z FROM signs JOIN sized USING (f) JOIN tie_{{a}} x USING (f) JOIN tie_{{b}} y USING (f)",
    ) + ")",
    f"SELECT *, least(1, 2 * {upper_tail_sql('abs(z)')}) AS p FROM kendall",
)


@query(
    "test_kendall",
    _with("kendall") + ' SELECT "column", column2, f, con, dis, round(s + 1e-11, 8) AS statistic, round(z + 1e-9, 6) AS z, round(p + 1e-9, 6) AS p_value FROM kendall_p',
)
def test_kendall(t):
    return rounded(rounded(stats.test_kendall(t.stat, PAIRED, "f"), 8, "statistic"), 6, "z", "p_value")


RAW["label_pearson"] = (
    "label_pearson AS (" + _each(PAIRED, "SELECT '{c}' AS \"column\", corr({c}, f) AS s, count(*) AS n FROM stat") + ")",
    f"SELECT *, {_r_tail('s', 'n')} AS p FROM label_pearson",
)
RAW["label_spearman"] = (
    "all_ranked AS (SELECT " + ", ".join(f"{_avg_rank('', c)} AS {c}" for c in [*PAIRED, "f"]) + " FROM stat) ;; "
    "label_spearman AS (" + _each(PAIRED, "SELECT '{c}' AS \"column\", corr({c}, f) AS s, count(*)::DOUBLE AS n FROM all_ranked") + ")",
    f"SELECT *, {_r_tail('s', 'n')} AS p FROM label_spearman",
)
RAW["label_kendall"] = (
    "label_signs AS (SELECT " + ", ".join(f"sum(sign(p.{c} - q.{c}))::DOUBLE AS s_{c}" for c in PAIRED) + " FROM stat p JOIN stat q ON p.f = 1 AND q.f = 0) ;; "
    f"all_sized AS (SELECT count(*)::DOUBLE AS n FROM stat) ;; label_tie AS (SELECT {_TIE_SUMS} FROM (SELECT count(*)::DOUBLE AS k FROM stat GROUP BY f)) ;; "
    + " ;; ".join(f"all_tie_{c} AS (SELECT {_TIE_SUMS} FROM (SELECT count(*)::DOUBLE AS k FROM stat GROUP BY {c}))" for c in PAIRED)
    + " ;; label_kendall AS ("
    + _each(
        PAIRED,
        "SELECT '{c}' AS \"column\", s_{c} / sqrt((n * (n - 1) / 2 - x.t2) * (n * (n - 1) / 2 - y.t2)) AS s, "
        f"s_{{c}} / sqrt({_TAU_VAR}) AS z, n FROM label_signs, all_sized, all_tie_{{c}} x, label_tie y",
    ) + ")",
    f"SELECT *, least(1, 2 * {upper_tail_sql('abs(z)')}) AS p FROM label_kendall",
)
_LABEL_SQL = ' SELECT "column", round(s + 1e-11, 8) AS statistic, n, round(p + 1e-9, 6) AS p_value'


@query("label_pearson", _with("label_pearson") + _LABEL_SQL + " FROM label_pearson_p")
def label_pearson(t):
    return rounded(rounded(stats.label_pearson(t.stat, PAIRED, "f"), 8, "statistic"), 6, "p_value")


@query("label_spearman", _with("label_spearman") + _LABEL_SQL + " FROM label_spearman_p")
def label_spearman(t):
    return rounded(rounded(stats.label_spearman(t.stat, PAIRED, "f"), 8, "statistic"), 6, "p_value")


@query("label_kendall", _with("label_kendall") + _LABEL_SQL + ", round(z + 1e-9, 6) AS z FROM label_kendall_p")
def label_kendall(t):
    return rounded(rounded(stats.label_kendall(t.stat, PAIRED, "f"), 8, "statistic"), 6, "z", "p_value")


_F = (
    "(n0 * pow(m0 - (n0 * m0 + n1 * m1) / (n0 + n1), 2) + n1 * pow(m1 - (n0 * m0 + n1 * m1) / (n0 + n1), 2)) / ((n0 * v0 + n1 * v1) / (n0 + n1 - 2))"
)
_GROUPS = (
    "SELECT '{c}' AS \"column\", count(*) FILTER (f = 0)::DOUBLE AS n0, count(*) FILTER (f = 1)::DOUBLE AS n1, avg({c}) FILTER (f = 0) AS m0, avg({c}) FILTER (f = 1) AS m1, "
    "var_pop({c}) FILTER (f = 0) AS v0, var_pop({c}) FILTER (f = 1) AS v1 FROM {src}"
)


def _groups(name: str, src: str) -> str:
    return f"{name} AS (" + _each(AMOUNTS, _GROUPS.replace("{src}", src)) + ")"


_DEV = "dev AS (SELECT f, " + ", ".join(f"abs({c} - median({c}) OVER (PARTITION BY f)) AS {c}" for c in AMOUNTS) + " FROM stat)"
# F with (1, dof) degrees is the square of t
_F_TAIL = t_two_sided_sql("sqrt(s)", "dof")
RAW["levene"] = (f"{_DEV} ;; {_groups('spread', 'dev')} ;; levene AS (SELECT \"column\", {_F} AS s, n0 + n1 - 2 AS dof FROM spread)", f"SELECT *, {_F_TAIL} AS p FROM levene")
RAW["anova"] = (f"{_groups('means', 'stat')} ;; anova AS (SELECT \"column\", {_F} AS s, n0 + n1 - 2 AS dof FROM means)", f"SELECT *, {_F_TAIL} AS p FROM anova")
_TWO_SQL = ' SELECT "column", round(s + 1e-9, 6) AS statistic, round(p + 1e-9, 6) AS p_value'


@query("test_levene", _with("levene") + _TWO_SQL + " FROM levene_p")
def test_levene(t):
    return rounded(stats.test_levene(t.stat, AMOUNTS, "f"), 6, "statistic", "p_value")


RAW["ttest"] = (
    f"{RAW['levene'][0]} ;; levene_p AS ({RAW['levene'][1]}) ;; {_groups('means', 'stat')} ;; "
    'sides AS (SELECT m.*, l.p >= 0.05 AS equal_var, v0 * n0 / (n0 - 1) AS s0, v1 * n1 / (n1 - 1) AS s1 FROM means m JOIN levene_p l USING ("column")) ;; '
    'both_t AS (SELECT "column", equal_var, (m1 - m0) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t_equal, n0 + n1 - 2 AS dof_equal, '
    "(m1 - m0) / sqrt(s0 / n0 + s1 / n1) AS t_welch, pow(s0 / n0 + s1 / n1, 2) / (pow(s0 / n0, 2) / (n0 - 1) + pow(s1 / n1, 2) / (n1 - 1)) AS dof_welch FROM sides) ;; "
    "ttest AS (SELECT *, CASE WHEN equal_var THEN t_equal ELSE t_welch END AS s, CASE WHEN equal_var THEN dof_equal ELSE dof_welch END AS dof FROM both_t)",
    f"SELECT *, {t_two_sided_sql('s', 'dof')} AS p FROM ttest",
)


@query(
    "test_ttest",
    _with("ttest") + ' SELECT "column", round(t_equal + 1e-9, 6) AS t_equal, dof_equal, round(t_welch + 1e-9, 6) AS t_welch, round(dof_welch + 1e-7, 4) AS dof_welch, '
    "equal_var, round(s + 1e-9, 6) AS statistic, round(p + 1e-9, 6) AS p_value FROM ttest_p",
)
def test_ttest(t):
    both = stats.t_statistics(t.stat, AMOUNTS, "f").join(stats.test_ttest(t.stat, AMOUNTS, "f"), "column")
    return rounded(rounded(both, 6, "t_equal", "t_welch", "statistic", "p_value"), 4, "dof_welch")


@query("test_anova", _with("anova") + _TWO_SQL + " FROM anova_p")
def test_anova(t):
    return rounded(stats.test_anova(t.stat, AMOUNTS, "f"), 6, "statistic", "p_value")


_RANKED = "r AS (SELECT f, " + ", ".join(f"{_avg_rank('', c)} AS r_{c}, {c}" for c in AMOUNTS) + " FROM stat)"
_TIES = " ;; ".join(f"t_{c} AS (SELECT sum(k * k * k - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM stat GROUP BY {c}))" for c in AMOUNTS)
_SUMS = "s_{c} AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (f = 1)::DOUBLE AS n1, count(*) FILTER (f = 0)::DOUBLE AS n0, sum(r_{c}) FILTER (f = 1) AS r1, sum(r_{c}) FILTER (f = 0) AS r0 FROM r)"
_RANK_SUMS = f"{_RANKED} ;; {_TIES} ;; " + " ;; ".join(_SUMS.replace("{c}", c) for c in AMOUNTS)
RAW["mannwhitney"] = (
    f"{_RANK_SUMS} ;; mannwhitney AS ("
    + _each(
        AMOUNTS,
        "SELECT '{c}' AS \"column\", r1 - n1 * (n1 + 1) / 2 AS s, (greatest(r1 - n1 * (n1 + 1) / 2, n0 * n1 - (r1 - n1 * (n1 + 1) / 2)) - n0 * n1 / 2 - 0.5) "
        "/ sqrt(n0 * n1 / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM s_{c}, t_{c}",
    ) + ")",
    f"SELECT *, least(1, 2 * {upper_tail_sql('greatest(z, 0)')}) AS p FROM mannwhitney",
)


@query("test_mannwhitney", _with("mannwhitney") + ' SELECT "column", s AS statistic, round(z + 1e-9, 6) AS z, round(p + 1e-9, 6) AS p_value FROM mannwhitney_p')
def test_mannwhitney(t):
    return rounded(stats.test_mannwhitney(t.stat, AMOUNTS, "f"), 6, "z", "p_value")


RAW["kruskal"] = (
    f"{_RANK_SUMS} ;; kruskal AS ("
    + _each(
        AMOUNTS,
        "SELECT '{c}' AS \"column\", (12 / (n * (n + 1)) * (r0 * r0 / n0 + r1 * r1 / n1) - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS s FROM s_{c}, t_{c}",
    ) + ")",
    # one degree of freedom: the square of a normal score
    f"SELECT *, 2 * {upper_tail_sql('sqrt(s)')} AS p FROM kruskal",
)


@query("test_kruskal", _with("kruskal") + _TWO_SQL + " FROM kruskal_p")
def test_kruskal(t):
    return rounded(stats.test_kruskal(t.stat, AMOUNTS, "f"), 6, "statistic", "p_value")


def _report_sql(tests: dict[str, tuple[str, str, str]]) -> str:
    """Rows of a report: ``tests`` has the relation of a test, its name, and the verdicts below and above 5 %."""
    rows = []
    for raw, (name, low, high) in tests.items():
        pairs = "column2" in RAW[raw][0]
        grp = "CASE f WHEN 1 THEN 'fraud' ELSE 'normal' END" if pairs else "'all'"
        rows.append(
            f"SELECT \"column\", {'column2' if pairs else 'NULL'} AS column2, {grp} AS grp, '{name}' AS test, round(s + 1e-7, 4) AS statistic, "
            f"round(p, 4) AS p_value, CASE WHEN p < 0.05 THEN '{low}' ELSE '{high}' END AS verdict FROM {raw}_p"
        )
    return f"{_with(*tests)} {' UNION ALL '.join(rows)}"


@query(
    "normality_report",
    f"WITH {STAT}, {_STEPS}, {_DAG}, kn AS (SELECT f, count(*) AS rows_f FROM stat GROUP BY f), "
    f"ku AS (SELECT *, {upper_tail_sql('abs(v)')} AS up FROM cum), kp AS (SELECT *, CASE WHEN v >= 0 THEN 1 - up ELSE up END AS phi FROM ku), "
    "kd AS (SELECT \"column\", f, max(greatest((b + c) / n - phi, phi - b / n)) AS d, max(n) AS n FROM kp GROUP BY ALL), "
    "kl AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM kd), "
    "ks AS (SELECT \"column\", f, d AS s, least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j : (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * lam * lam))))) AS p FROM kl), "
    "am AS (SELECT \"column\", f, sum(v * c) / sum(c) AS mean FROM cum GROUP BY ALL), "
    "asd AS (SELECT \"column\", f, mean, sqrt(sum(c * (v - mean) * (v - mean)) / (sum(c) - 1)) AS sd FROM cum JOIN am USING (\"column\", f) GROUP BY ALL), "
    f"az AS (SELECT *, (v - mean) / sd AS z FROM cum JOIN asd USING (\"column\", f)), au AS (SELECT *, {upper_tail_sql('abs(z)')} AS up FROM az), "
    "ah AS (SELECT *, CASE WHEN z >= 0 THEN 1 - up ELSE up END AS lo, CASE WHEN z >= 0 THEN up ELSE 1 - up END AS hi FROM au), "
    "aa AS (SELECT \"column\", f, max(n) AS n, -max(n) - sum(c * (2 * b + c) * ln(lo) + c * (2 * n - 2 * b - c) * ln(hi)) / max(n) AS s FROM ah GROUP BY ALL), "
    "lv AS (SELECT unnest([0.576, 0.656, 0.787, 0.918, 1.092])::DOUBLE AS cv, unnest(['15.0', '10.0', '5.0', '2.5', '1.0']) AS level), "
    "every AS (SELECT \"column\", f, 'shapiro' AS test, NULL::DOUBLE AS s, NULL::DOUBLE AS p, NULL::BOOLEAN AS fits FROM ks JOIN kn USING (f) WHERE rows_f < 2000 "
    "UNION ALL SELECT \"column\", f, 'ks', s, p, p >= 0.05 FROM ks JOIN kn USING (f) WHERE rows_f >= 2000 "
    "UNION ALL SELECT \"column\", f, 'dagostino', zs * zs + zk * zk, exp(-(zs * zs + zk * zk) / 2), exp(-(zs * zs + zk * zk) / 2) >= 0.05 FROM k2 "
    "UNION ALL SELECT \"column\", f, 'anderson_' || level, s, NULL, s < round(cv / (1 + 4 / n - 25 / (n * n)), 3) FROM aa, lv) "
    "SELECT \"column\", CASE f WHEN 1 THEN 'fraud' ELSE 'normal' END AS grp, test, round(s + 1e-6, 3) AS statistic, round(p, 4) AS p_value, "
    "CASE WHEN fits THEN 'normal' WHEN NOT fits THEN 'not normal' END AS verdict FROM every".replace("FROM k2", "FROM dz"),
)
def normality_report(t):
    """Every row of the report; of the W test, which SQL has no short form of, the rows alone."""
    out = stats.normality_report(t.stat, AMOUNTS, "f").drop("column2")
    told = F.col("test") != "shapiro"
    out = rounded(out, 3, "statistic")
    return out.withColumns({c: F.when(told, F.col(c)) for c in ("statistic", "p_value", "verdict")})


_WORDS = ("dependent", "independent")


@query(
    "correlation_report",
    _report_sql({"pearson": ("pearson", *_WORDS), "chi2_paired": ("chi2", *_WORDS), "spearman": ("spearman", *_WORDS), "kendall": ("kendall", *_WORDS)}
                | {f"label_{k}": (f"label_{k}", "related", "unrelated") for k in ("pearson", "spearman", "kendall")}),
)
def correlation_report(t):
    return rounded(stats.correlation_report(t.stat, PAIRED, "f"), 4, "statistic")


@query(
    "significance_report",
    _report_sql({"levene": ("levene", "unequal variance", "equal variance")} | {k: (k, "different", "same") for k in ("ttest", "anova", "mannwhitney", "kruskal")}),
)
def significance_report(t):
    return rounded(stats.significance_report(t.stat, AMOUNTS, "f"), 4, "statistic")
