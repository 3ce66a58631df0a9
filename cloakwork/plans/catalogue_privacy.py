"""Queries over microdata: anonymization, quality, utility, attacks, reports; each with its SQL where SQL can say it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import anonymize as A
from ..operators import attacks, classify, quality, reporting, sampling, utility
from ..operators import schema_match as SM
from ..operators.hierarchy import generalize
from ..sources.files import drop_fully_suppressed
from ..sources.scratch import written
from ..streaming import monitor
from . import microdata as M

QUERIES: dict = {}
SQL: dict[str, str] = {}
MODEL = A.Model(M.K, M.L, None, 0.1)
QIS = ["place", "balance"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts as long, so that both engines give the same values."""
    kinds = {"double": lambda c: F.round(c, digits), "integer": lambda c: c.cast("long")}
    return df.select(*[kinds[f.dataType.typeName()](F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in kinds else F.col(f"`{f.name}`") for f in df.schema])


def _release(spark: SparkSession, sf_dir: str, place: int = 0, balance: int = 2) -> DataFrame:
    g = generalize(M.customers(spark, sf_dir).drop("region"), M.customer_hierarchies(spark, sf_dir), {"place": place, "balance": balance})
    return A.suppress(g, QIS, MODEL, "segment")


def _at(place: int, balance: int) -> str:
    return f"SELECT id, {M.PLACE_LEVELS[place]} AS place, {M.BALANCE_LEVELS[balance]} AS balance, segment, balance AS raw_balance, place AS raw_place FROM c"


def _release_sql(place: int = 0, balance: int = 2) -> str:
    return f"""{M.CUSTOMERS_SQL}, g AS ({_at(place, balance)}),
    k AS (SELECT place, balance, count(*) AS n, count(DISTINCT segment) AS s FROM g GROUP BY 1, 2),
    r AS (SELECT g.id, CASE WHEN n < 5 OR s < 2 THEN '*' ELSE g.place END AS place, CASE WHEN n < 5 OR s < 2 THEN '*' ELSE g.balance END AS balance,
          g.segment, (n < 5 OR s < 2) AS suppressed, raw_place, raw_balance FROM g JOIN k ON g.place = k.place AND g.balance = k.balance)"""


# --- anonymization ---------------------------------------------------------------------------------------------


@query(f"WITH {M.CUSTOMERS_SQL}, g AS ({_at(1, 1)}) SELECT place, balance, count(*) AS class_size, count(DISTINCT segment) AS n_sensitive FROM g GROUP BY 1, 2")
def k_anonymity_classes(spark, sf_dir):
    g = generalize(M.customers(spark, sf_dir), M.customer_hierarchies(spark, sf_dir), {"place": 1, "balance": 1})
    return A.classes(g, QIS, "segment")


@query(f"WITH {M.CUSTOMERS_SQL}, g AS ({_at(0, 1)}) SELECT place, balance FROM g GROUP BY 1, 2 HAVING count(*) < 5 OR count(DISTINCT segment) < 2")
def l_diversity_violations(spark, sf_dir):
    g = generalize(M.customers(spark, sf_dir), M.customer_hierarchies(spark, sf_dir), {"place": 0, "balance": 1})
    return A.failing(g, QIS, MODEL, "segment").select(F.col("__k0").alias("place"), F.col("__k1").alias("balance"))


@query(f"""WITH {M.CUSTOMERS_SQL}, g AS ({_at(1, 2)}), q AS (SELECT segment, count(*) / (SELECT count(*) FROM g)::DOUBLE AS q FROM g GROUP BY 1),
    k AS (SELECT DISTINCT place, balance FROM g), n AS (SELECT place, balance, count(*) AS class_size FROM g GROUP BY 1, 2),
    p AS (SELECT place, balance, segment, count(*) AS m FROM g GROUP BY 1, 2, 3)
    SELECT k.place, k.balance, class_size, round(0.5 * sum(abs(coalesce(m, 0) / class_size::DOUBLE - q)), 6) AS t_distance
    FROM k CROSS JOIN q JOIN n USING (place, balance) LEFT JOIN p ON p.place = k.place AND p.balance = k.balance AND p.segment = q.segment GROUP BY 1, 2, 3""")
def t_closeness_classes(spark, sf_dir):
    g = generalize(M.customers(spark, sf_dir), M.customer_hierarchies(spark, sf_dir), {"place": 1, "balance": 2})
    return rounded(A.closeness(g, QIS, "segment"))


@query(f"WITH {_release_sql()} SELECT id, place, balance, segment, suppressed FROM r")
def generalize_release(spark, sf_dir):
    return _release(spark, sf_dir)


@query(f"WITH {_release_sql(0, 1)} SELECT place, balance, segment FROM r WHERE NOT suppressed")
def drop_fully_suppressed_rows(spark, sf_dir):
    return drop_fully_suppressed(_release(spark, sf_dir, 0, 1), QIS)[0].select(*QIS, "segment")


@query(f"WITH {_release_sql(0, 1)} SELECT count(*) AS n_before, count(*) FILTER (suppressed) AS n_dropped, count(*) FILTER (NOT suppressed) AS n_after FROM r")
def suppression_counts(spark, sf_dir):
    return drop_fully_suppressed(_release(spark, sf_dir, 0, 1), QIS)[1]


def _nodes(levels: list[tuple[str, ...]], base: str, sensitive: str) -> str:
    import itertools

    parts = [f"SELECT {i} AS node, {', '.join(f'{levels[a][l]} AS g{a}' for a, l in enumerate(n))}, {sensitive} AS s FROM {base}" for i, n in enumerate(itertools.product(*[range(len(x)) for x in levels]))]
    return " UNION ALL ".join(parts)


def _scan_sql(levels, base, base_sql, sensitive):
    keys = ", ".join(f"g{a}" for a in range(len(levels)))
    return f"""WITH {base_sql}, n AS ({_nodes(levels, base, sensitive)}), k AS (SELECT node, {keys}, count(*) AS size, count(DISTINCT s) AS kinds FROM n GROUP BY ALL)
    SELECT CAST(node AS BIGINT) AS node, count(*) FILTER (size >= 5 AND kinds >= 2) AS n_classes, CAST(coalesce(sum(size) FILTER (size >= 5 AND kinds >= 2), 0) AS BIGINT) AS n_released,
        CAST(coalesce(sum(size) FILTER (NOT (size >= 5 AND kinds >= 2)), 0) AS BIGINT) AS n_suppressed, coalesce(min(size) FILTER (size >= 5 AND kinds >= 2), 0) AS min_size, coalesce(max(size) FILTER (size >= 5 AND kinds >= 2), 0) AS max_size,
        CAST(coalesce(sum(size * size) FILTER (size >= 5 AND kinds >= 2), 0) AS BIGINT) AS sum_squares FROM k GROUP BY 1"""


def _scanned(df, hierarchies, sensitive):
    f = A.frequencies(df, hierarchies, sensitive)
    return rounded(A.scan(f, A.lattice(hierarchies), MODEL).drop("minority", "size_log").na.fill(0))


LINE_LEVELS = [tuple(M.band_sql("quantity", w) for w in (5, 10, 25)) + ("'*'",), ("month", "substr(month, 1, 4)", "'*'"), ("flag", "'*'")]
ORDER_LEVELS = [("day", "substr(day, 1, 7)", "substr(day, 1, 4)", "'*'"), ("priority", "CASE WHEN substr(priority, 1, 1) IN ('1', '2') THEN 'high' ELSE 'other' END", "'*'"), tuple(M.band_sql("price", w) for w in (1000, 20000, 100000)) + ("'*'",)]


@query(_scan_sql(LINE_LEVELS, "x", M.LINES_SQL, "status"))
def lattice_scan(spark, sf_dir):
    return _scanned(M.line_rows(spark, sf_dir), M.line_hierarchies(), "status")


@query(_scan_sql(ORDER_LEVELS, "o", M.ORDERS_SQL, "status"))
def lattice_scan_orders(spark, sf_dir):
    return _scanned(M.order_rows(spark, sf_dir), M.order_hierarchies(), "status")


def _loss_sql(select: str, order: str) -> str:
    b = M.BALANCE_LEVELS
    part = lambda l: f"(count(*) OVER (PARTITION BY l{l}) - 1) / (count(*) OVER () - 1)::DOUBLE"
    places = "pl AS (SELECT n_name AS leaf, 0.0::DOUBLE AS x0, (count(*) OVER (PARTITION BY n_regionkey) - 1) / (count(*) OVER () - 1)::DOUBLE AS x1, 1.0::DOUBLE AS x2 FROM nation)"
    bands = f"bl AS (SELECT l0, 0.0::DOUBLE AS y0, {part(1)} AS y1, {part(2)} AS y2, 1.0::DOUBLE AS y3 FROM (SELECT DISTINCT {b[0]} AS l0, {b[1]} AS l1, {b[2]} AS l2 FROM c))"
    rows = " UNION ALL ".join(f"SELECT {p} AS lp, {q} AS lb, {M.PLACE_LEVELS[p]} AS g0, {b[q]} AS g1, segment AS s, x{p} AS x, y{q} AS y FROM c JOIN pl ON c.place = pl.leaf JOIN bl ON {b[0]} = bl.l0" for p in range(3) for q in range(4))
    return f"""WITH {M.CUSTOMERS_SQL}, {places}, {bands}, n AS ({rows}),
    dd AS (SELECT (SELECT count(*) FROM pl) AS dx, (SELECT count(*) FROM bl) AS dy), n2 AS (SELECT lp, lb, g0, g1, s, count(*) AS c, sum(x) AS x, sum(y) AS y, sum((x * (dx - 1) + 1) * (y * (dy - 1) + 1)) AS amb FROM n, dd GROUP BY 1, 2, 3, 4, 5),
    k AS (SELECT lp, lb, g0, g1, sum(c) AS size, count(s) AS kinds, max(c) AS major, sum(x) AS x, sum(y) AS y, sum(amb) AS amb FROM n2 GROUP BY 1, 2, 3, 4),
    t AS (SELECT lp, lb, sum(size) AS n, coalesce(sum(size) FILTER (NOT (size >= 5 AND kinds >= 2)), 0) AS gone, count(*) FILTER (size >= 5 AND kinds >= 2) AS n_classes,
        sum(CASE WHEN size >= 5 AND kinds >= 2 THEN x ELSE size END) / sum(size) AS ax, sum(CASE WHEN size >= 5 AND kinds >= 2 THEN y ELSE size END) / sum(size) AS ay,
        coalesce(sum(size * size) FILTER (size >= 5 AND kinds >= 2), 0)::DOUBLE AS sq, coalesce(sum(size - major) FILTER (size >= 5 AND kinds >= 2), 0)::DOUBLE AS minor, coalesce(sum(size * log2(size)) FILTER (size >= 5 AND kinds >= 2), 0) AS slog,
        sum(CASE WHEN size >= 5 AND kinds >= 2 THEN amb ELSE size * (SELECT dx * dy FROM dd) END) / sum(size) AS amb FROM k GROUP BY 1, 2),
    z AS (SELECT *, {order} AS score FROM t WHERE gone <= 0.1 * n + 1e-9)
    SELECT {select} FROM z ORDER BY score, lp, lb LIMIT 1"""


NODE_SELECT = "CAST(lp AS BIGINT) AS place_level, CAST(lb AS BIGINT) AS balance_level, round(score, 6) AS score, n_classes, CAST(gone AS BIGINT) AS n_suppressed"


def _best(spark, sf_dir, measure, aggregate):
    hs = M.customer_hierarchies(spark, sf_dir)
    b = A.best_node(A.frequencies(M.customers(spark, sf_dir), hs, "segment"), MODEL, measure, aggregate)
    row = [(b["node"]["place"], b["node"]["balance"], float(b["score"][0] if isinstance(b["score"], list) else b["score"]), b["n_classes"], b["n_suppressed"])]
    return rounded(spark.createDataFrame(row, "place_level long, balance_level long, score double, n_classes long, n_suppressed long"))


@query(_loss_sql(NODE_SELECT, "sqrt((1 + ax) * (1 + ay)) - 1"))
def optimal_node_loss(spark, sf_dir):
    return _best(spark, sf_dir, "loss", "geometric_mean")


@query(_loss_sql(NODE_SELECT, "(ax + ay) / 2"))
def optimal_node_loss_mean(spark, sf_dir):
    return _best(spark, sf_dir, "loss", "arithmetic_mean")


@query(_loss_sql(NODE_SELECT, "greatest(ax, ay)"))
def optimal_node_loss_maximum(spark, sf_dir):
    return _best(spark, sf_dir, "loss", "maximum")


@query(_loss_sql(NODE_SELECT, "ax + ay"))
def optimal_node_loss_sum(spark, sf_dir):
    return _best(spark, sf_dir, "loss", "sum")


@query(_loss_sql(NODE_SELECT, "(lp / 2.0 + lb / 3.0) / 2"))
def optimal_node_precision(spark, sf_dir):
    return _best(spark, sf_dir, "precision", "arithmetic_mean")


@query(_loss_sql(NODE_SELECT, "(lp + lb)::DOUBLE"))
def optimal_node_height(spark, sf_dir):
    return _best(spark, sf_dir, "height", "sum")


@query(_loss_sql(NODE_SELECT, "n / n_classes::DOUBLE"))
def optimal_node_aecs(spark, sf_dir):
    return _best(spark, sf_dir, "aecs", "arithmetic_mean")


@query(_loss_sql(NODE_SELECT, "sq + gone * n::DOUBLE"))
def optimal_node_discernibility(spark, sf_dir):
    return _best(spark, sf_dir, "discernibility", "sum")


@query(_loss_sql(NODE_SELECT, "(minor + gone) / n::DOUBLE"))
def optimal_node_classification(spark, sf_dir):
    return _best(spark, sf_dir, "classification", "sum")


@query(_loss_sql(NODE_SELECT, "(slog + gone * log2(n)) / n::DOUBLE"))
def optimal_node_entropy(spark, sf_dir):
    return _best(spark, sf_dir, "entropy", "sum")


@query(_loss_sql(NODE_SELECT, "amb"))
def optimal_node_ambiguity(spark, sf_dir):
    return _best(spark, sf_dir, "ambiguity", "sum")


def _bits(levels: tuple[str, ...]) -> str:
    """The mean of -log2(share of a row's leaf in its label), by level."""
    parts = [f"SELECT {i} AS l, avg(-log2(a / b::DOUBLE)) AS e FROM (SELECT count(*) OVER (PARTITION BY {levels[0]}) AS a, count(*) OVER (PARTITION BY {x}) AS b FROM c)" for i, x in enumerate(levels)]
    return " UNION ALL ".join(parts)


@query(_loss_sql(NODE_SELECT, f"(SELECT e FROM ({_bits(M.PLACE_LEVELS)}) WHERE l = lp) + (SELECT e FROM ({_bits(M.BALANCE_LEVELS)}) WHERE l = lb)"))
def optimal_node_nm_entropy(spark, sf_dir):
    return _best(spark, sf_dir, "nm_entropy", "sum")


@query(_loss_sql(NODE_SELECT, "greatest(ax, ay)").replace("ORDER BY score, lp, lb", "ORDER BY greatest(ax, ay), least(ax, ay), lp, lb"))
def optimal_node_rank(spark, sf_dir):
    return _best(spark, sf_dir, "loss", "rank")


@query(_loss_sql("*", "sqrt((1 + ax) * (1 + ay)) - 1").replace("SELECT * FROM z ORDER BY score, lp, lb LIMIT 1", """best AS (SELECT lp, lb FROM z ORDER BY score, lp, lb LIMIT 1),
    own AS (SELECT g0, g1, size, size < 5 OR kinds < 2 AS gone FROM k JOIN best USING (lp, lb))
    SELECT CASE WHEN gone THEN '*' ELSE g0 END AS place, CASE WHEN gone THEN '*' ELSE g1 END AS balance, gone AS suppressed, CAST(sum(size) AS BIGINT) AS class_size FROM own GROUP BY 1, 2, 3""").replace("<= 0.1 * n + 1e-9)", "<= 0.1 * n + 1e-9),"))
def optimal_release_classes(spark, sf_dir):
    """The flagship: the best k = 5, l = 2 release of customers, and its classes."""
    release, _ = A.anonymize(M.customers(spark, sf_dir).drop("region"), A.Roles(("place", "balance"), ("segment",), ("id",)), M.customer_hierarchies(spark, sf_dir), MODEL)
    return release.groupBy("place", "balance", "suppressed").agg(F.count("*").alias("class_size"))


@query(f"WITH {M.CUSTOMERS_SQL}, v(e, s) AS (VALUES (0.2::DOUBLE, 0.3::DOUBLE)) SELECT 'arithmetic_mean' AS name, round((e + s) / 2, 6) AS score FROM v UNION ALL SELECT 'geometric_mean', round(sqrt((1 + e) * (1 + s)) - 1, 6) FROM v UNION ALL SELECT 'sum', round(e + s, 6) FROM v UNION ALL SELECT 'maximum', round(greatest(e, s), 6) FROM v UNION ALL SELECT 'rank', round(greatest(e, s), 6) FROM v")
def aggregate_functions(spark, sf_dir):
    rows = [(n, x[0] if isinstance(x := A.aggregate(n, [0.2, 0.3]), list) else x) for n in A.AGGREGATES]
    return rounded(spark.createDataFrame(rows, "name string, score double"))


# --- quality ---------------------------------------------------------------------------------------------------


@query(f"""WITH {_release_sql()}, kk AS (SELECT place, balance, suppressed, count(*) AS size FROM r GROUP BY 1, 2, 3),
    t AS (SELECT sum(size) AS n_rows, count(*) FILTER (NOT suppressed) AS n_classes, coalesce(sum(size) FILTER (suppressed), 0) AS n_suppressed, min(size) FILTER (NOT suppressed) AS min_class_size,
        max(size) FILTER (NOT suppressed) AS max_class_size, avg(size) FILTER (NOT suppressed) AS avg_class_size, coalesce(sum(size * size) FILTER (NOT suppressed), 0)::DOUBLE AS sq, coalesce(var_pop(size) FILTER (NOT suppressed), 0) AS size_variance FROM kk),
    u AS (SELECT *, sq + n_suppressed * n_rows::DOUBLE AS discernibility, n_rows / n_classes::DOUBLE AS aecs FROM t)
    SELECT CAST(n_rows AS BIGINT) AS n_rows, n_classes, CAST(n_suppressed AS BIGINT) AS n_suppressed, min_class_size, max_class_size, round(avg_class_size, 6) AS avg_class_size, round(size_variance, 6) AS size_variance, round(discernibility, 6) AS discernibility, round(aecs, 6) AS aecs,
        round((n_rows::DOUBLE * n_rows - discernibility) / (n_rows::DOUBLE * n_rows - n_rows), 6) AS discernibility_score, round((n_rows - aecs) / (n_rows - 1), 6) AS aecs_score FROM u""")
def class_statistics(spark, sf_dir):
    return rounded(quality.class_statistics(_release(spark, sf_dir), QIS))


@query(f"""WITH {_release_sql()}, b AS (SELECT *, {M.BALANCE_LEVELS[0].replace('balance', 'raw_balance')} AS l0, {M.BALANCE_LEVELS[2].replace('balance', 'raw_balance')} AS l2 FROM r),
    lv AS (SELECT l2, count(*) AS leaves FROM (SELECT DISTINCT l0, l2 FROM b) GROUP BY 1), dm AS (SELECT count(DISTINCT l0) - 1 AS span, count(*) AS n FROM b),
    f AS (SELECT l0, count(*) AS allf FROM b GROUP BY 1), mm AS (SELECT l2, count(*) AS mass FROM b GROUP BY 1),
    pf AS (SELECT raw_place, count(*) AS allf FROM b GROUP BY 1)
    SELECT 'place' AS attribute, round(avg(suppressed::INT), 6) AS missings, round(avg(CASE WHEN suppressed THEN 0 ELSE 1 END), 6) AS generalization_intensity, round(1 - avg(suppressed::INT), 6) AS granularity,
        round(1 - sum(CASE WHEN suppressed THEN -log2(allf / n::DOUBLE) ELSE 0 END) / sum(-log2(allf / n::DOUBLE)), 6) AS nu_entropy FROM b JOIN pf USING (raw_place), dm
    UNION ALL SELECT 'balance', round(avg(suppressed::INT), 6), round(avg(CASE WHEN suppressed THEN 0 ELSE 1 - 2 / 3.0::DOUBLE END), 6), round(1 - avg(CASE WHEN suppressed THEN 1 ELSE (leaves - 1) / span::DOUBLE END), 6),
        round(1 - sum(CASE WHEN suppressed THEN -log2(allf / n::DOUBLE) ELSE -log2(allf / mass::DOUBLE) END) / sum(-log2(allf / n::DOUBLE)), 6) FROM b JOIN lv USING (l2) JOIN f USING (l0) JOIN mm USING (l2), dm""")
def attribute_quality(spark, sf_dir):
    return rounded(quality.attribute_metrics(M.customers(spark, sf_dir), _release(spark, sf_dir), "id", M.customer_hierarchies(spark, sf_dir), {"place": 0, "balance": 2}))


# --- utility ---------------------------------------------------------------------------------------------------


def _pair(spark, sf_dir):
    """Original customers, and those rows of the release that are not suppressed (by regions and bands of 1000)."""
    return M.customers(spark, sf_dir).withColumn("balance", F.greatest("balance", F.lit(0.0))), written(_release(spark, sf_dir, 1, 1).filter(~F.col("suppressed")), "release")


PAIR_SQL = _release_sql(1, 1) + """, a AS (SELECT id, place, greatest(balance, 0) AS balance, segment FROM c), z AS (SELECT id, place, segment, balance,
    (CAST(split_part(balance, '-', 1) AS DOUBLE) + CAST(split_part(balance, '-', 2) AS DOUBLE)) / 2 AS mid FROM r WHERE NOT suppressed)"""


@query(f"""WITH {PAIR_SQL}, e AS (SELECT min(balance) AS lo, max(balance) AS hi FROM a),
    p AS (SELECT least(floor((balance - lo) / (hi - lo) * 20), 19) AS v, count(*) AS p FROM a, e GROUP BY 1), q AS (SELECT least(floor((mid - lo) / (hi - lo) * 20), 19) AS v, count(*) AS q FROM z, e WHERE mid BETWEEN lo AND hi GROUP BY 1),
    h AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM range(20) g(i) LEFT JOIN p ON p.v = i LEFT JOIN q ON q.v = i),
    s AS (SELECT (p + 1e-10) / (sum(p) OVER () + 20e-10) AS x, (q + 1e-10) / (sum(q) OVER () + 20e-10) AS y, p / sum(p) OVER () AS px, q / sum(q) OVER () AS qx FROM h)
    SELECT round(sum(x * ln(x / y)), 6) AS kl_divergence, round(0.5 * sum(abs(px - qx)), 6) AS tvd FROM s""")
def divergence_numeric(spark, sf_dir):
    return rounded(utility.divergences(*_pair(spark, sf_dir), "balance"))


@query(f"""WITH {PAIR_SQL}, p AS (SELECT place AS v, count(*) AS p FROM a GROUP BY 1), q AS (SELECT place AS v, count(*) AS q FROM z GROUP BY 1),
    h AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q ON p.v = q.v),
    s AS (SELECT (p + 1e-10) / (sum(p) OVER () + count(*) OVER () * 1e-10) AS x, (q + 1e-10) / (sum(q) OVER () + count(*) OVER () * 1e-10) AS y, p / sum(p) OVER () AS px, q / sum(q) OVER () AS qx FROM h)
    SELECT round(sum(x * ln(x / y)), 6) AS kl_divergence, round(0.5 * sum(abs(px - qx)), 6) AS tvd FROM s""")
def divergence_categorical(spark, sf_dir):
    return rounded(utility.divergences(*_pair(spark, sf_dir), "place"))


@query(f"""WITH {PAIR_SQL}, x AS (SELECT balance AS v, row_number() OVER (ORDER BY balance) - 1 AS r FROM a), y AS (SELECT mid AS v, row_number() OVER (ORDER BY mid) - 1 AS r FROM z),
    n AS (SELECT (SELECT count(*) FROM x) AS nx, (SELECT count(*) FROM y) AS ny), m AS (SELECT *, greatest(nx, ny) AS t FROM n),
    gg AS (SELECT i, nx, ny, i * (nx - 1) / (t - 1)::DOUBLE AS px, i * (ny - 1) / (t - 1)::DOUBLE AS py FROM m, range((SELECT t FROM m)) q(i)),
    f AS (SELECT i, px, py, CAST(floor(px + 1e-9) AS BIGINT) AS x0, CAST(floor(py + 1e-9) AS BIGINT) AS y0, nx, ny FROM gg)
    SELECT round(avg(abs((a0.v + greatest(px - x0, 0) * (a1.v - a0.v)) - (b0.v + greatest(py - y0, 0) * (b1.v - b0.v)))), 6) AS wasserstein
    FROM f JOIN x a0 ON a0.r = x0 JOIN x a1 ON a1.r = least(x0 + 1, nx - 1) JOIN y b0 ON b0.r = y0 JOIN y b1 ON b1.r = least(y0 + 1, ny - 1)""")
def wasserstein(spark, sf_dir):
    return rounded(utility.wasserstein(*_pair(spark, sf_dir), "balance"))


@query(f"""WITH {PAIR_SQL}, s AS (SELECT (SELECT avg(balance) FROM a) AS ma, (SELECT stddev_samp(balance) FROM a) AS sa, (SELECT avg(mid) FROM z) AS mb, (SELECT stddev_samp(mid) FROM z) AS sb)
    SELECT round(abs(ma - mb), 6) AS mean_delta, round(abs(sa - sb), 6) AS std_delta, round(abs(ma - mb) / abs(ma), 6) AS mean_delta_relative, round(abs(sa - sb) / sa, 6) AS std_delta_relative FROM s""")
def mean_std_delta(spark, sf_dir):
    return rounded(utility.mean_std_delta(*_pair(spark, sf_dir), "balance"))


@query(f"""WITH {PAIR_SQL}, u AS (SELECT place AS t FROM a UNION SELECT place FROM z), pc AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM u),
    w AS (SELECT segment AS t FROM a UNION SELECT segment FROM z), sc AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM w),
    x AS (SELECT balance AS b, pc.code AS p, sc.code AS s FROM a JOIN pc ON a.place = pc.t JOIN sc ON a.segment = sc.t), y AS (SELECT mid AS b, pc.code AS p, sc.code AS s FROM z JOIN pc ON z.place = pc.t JOIN sc ON z.segment = sc.t),
    cx AS (SELECT corr(p, b) AS pb, corr(s, b) AS sb, corr(s, p) AS sp FROM x), cy AS (SELECT corr(p, b) AS pb, corr(s, b) AS sb, corr(s, p) AS sp FROM y),
    d AS (SELECT sqrt(2 * (pow(cx.pb - cy.pb, 2) + pow(cx.sb - cy.sb, 2) + pow(cx.sp - cy.sp, 2))) AS f FROM cx, cy)
    SELECT round(f, 6) AS frobenius, round(f / (2 * sqrt(6)), 6) AS frobenius_normalized FROM d""")
def correlation_delta(spark, sf_dir):
    return rounded(utility.correlation_delta(*_pair(spark, sf_dir), ["balance", "place", "segment"]))


def _exact(name: str) -> str:
    """The SQL of a registered query without its last rounding."""
    head, tail = SQL[name].rsplit("SELECT round(", 1)
    return head + "SELECT " + re.sub(r"round\((.*?), 6\) AS", r"\1 AS", f"round({tail}", flags=re.DOTALL)


@query(f"""WITH {PAIR_SQL}, d AS (SELECT 'balance' AS k, * FROM ({_exact("divergence_numeric")}) UNION ALL SELECT 'place', * FROM ({_exact("divergence_categorical")})
    UNION ALL SELECT 'segment', * FROM ({_exact("divergence_categorical").replace("place AS v", "segment AS v")})), w AS ({_exact("wasserstein")})
    SELECT (SELECT count(*) FROM a) AS n_original, (SELECT count(*) FROM z) AS n_anonymized, round(1 - (SELECT count(*) FROM z) / (SELECT count(*) FROM a)::DOUBLE, 6) AS suppression_rate, round(avg(tvd) FILTER (k <> 'segment'), 6) AS mean_tvd_qi, round(avg(tvd) FILTER (k = 'segment'), 6) AS mean_tvd_sensitive,
        round(avg(tvd), 6) AS mean_tvd_all, round(avg(kl_divergence) FILTER (k <> 'segment'), 6) AS mean_kl_qi, (SELECT round(wasserstein, 6) FROM w) AS mean_wasserstein_qi, (SELECT round(wasserstein, 6) FROM w) AS mean_wasserstein_all FROM d""")
def utility_summary(spark, sf_dir):
    return rounded(utility.summary(*_pair(spark, sf_dir), QIS, ["segment"]))


@query("""WITH v(s) AS (SELECT * FROM (VALUES ('35-39'), ('30–39'), ('25'), ('*'), ('?'), (''), ('00-19'), ('1.5 - 2.5'), ('-3'), ('a-b'), (' 7 '))), t AS (SELECT s, trim(s) AS x FROM v)
    SELECT s, CASE WHEN x IN ('*', '?', '') THEN NULL ELSE coalesce(TRY_CAST(x AS DOUBLE), CASE WHEN regexp_full_match(x, '\\d+(\\.\\d+)?\\s*[-–]\\s*\\d+(\\.\\d+)?') THEN
        (CAST(regexp_extract(x, '^(\\d+(\\.\\d+)?)', 1) AS DOUBLE) + CAST(regexp_extract(x, '[-–]\\s*(\\d+(\\.\\d+)?)$', 1) AS DOUBLE)) / 2 END) END AS midpoint FROM t""")
def range_midpoint(spark, sf_dir):
    rows = [(x,) for x in ("35-39", "30–39", "25", "*", "?", "", "00-19", "1.5 - 2.5", "-3", "a-b", " 7 ")]
    return spark.createDataFrame(rows, "s string").select("s", X.range_midpoint(F.col("s")).alias("midpoint"))


# --- schema matching -------------------------------------------------------------------------------------------


def _renamed(spark, sf_dir):
    known = M.customers(spark, sf_dir).select("place", "region", "segment")
    unknown, t = SM.obfuscate(known, ["place", "region", "segment"])
    return unknown, known, t


@query("""WITH c AS (SELECT n_name AS place, r_name AS region, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    v AS (SELECT DISTINCT 0 AS i, 'place' AS k, place AS v FROM c UNION SELECT DISTINCT 1, 'region', region FROM c UNION SELECT DISTINCT 2, 'segment', segment FROM c),
    n AS (SELECT i, k, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT x.i AS i, y.k AS k, count(*) AS m FROM v x JOIN v y ON x.v = y.v GROUP BY 1, 2)
    SELECT 'col_' || x.i AS "unknown", y.k AS known, round(coalesce(m, 0) / (x.n + y.n - coalesce(m, 0))::DOUBLE, 6) AS score FROM n x CROSS JOIN n y LEFT JOIN b ON b.i = x.i AND b.k = y.k""")
def jaccard_schema_scores(spark, sf_dir):
    unknown, known, t = _renamed(spark, sf_dir)
    return rounded(SM.jaccard_scores(unknown, known, list(t), list(t.values())))


@query(f"""WITH js AS ({SQL["jaccard_schema_scores"]}), jm AS (SELECT "unknown", known, row_number() OVER (PARTITION BY "unknown" ORDER BY score DESC, list_position(['place', 'region', 'segment'], known)) AS k FROM js WHERE score >= 0),
    jt AS (SELECT t.*, jm.known AS mapped FROM (VALUES ('col_0', 'place'), ('col_1', 'region'), ('col_2', 'segment')) t("unknown", truth) LEFT JOIN jm ON jm."unknown" = t."unknown" AND k = 1),
    jc AS (SELECT count(*) AS n_columns, count(mapped) AS n_mapped, count(*) FILTER (mapped = truth) AS n_correct FROM jt)
    SELECT *, n_mapped / n_columns::DOUBLE AS coverage, n_correct / n_mapped::DOUBLE AS accuracy_on_mapped, n_correct / n_columns::DOUBLE AS recall FROM jc""")
def schema_mapping_evaluation(spark, sf_dir):
    unknown, known, t = _renamed(spark, sf_dir)
    found = SM.recover(unknown, known, list(t), list(t.values()))
    return rounded(SM.evaluate_mapping(found, spark.createDataFrame(list(t.items()), "unknown string, known string")))


CELLS_SQL = """WITH RECURSIVE c AS (SELECT n_name AS place, r_name AS region, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    cells AS MATERIALIZED (SELECT 0 AS i, 'place' AS k, place AS v, count(*) AS n FROM c GROUP BY place UNION ALL SELECT 1, 'region', region, count(*) FROM c GROUP BY region UNION ALL SELECT 2, 'segment', segment, count(*) FROM c GROUP BY segment)"""
#: From scores sc: pairs that are the best left for both columns are taken, and all other pairs of those columns go.
CHOICE_SQL = """, ch AS (SELECT "unknown", known, score, false AS taken FROM sc UNION ALL
    SELECT "unknown", known, score, taken FROM (SELECT *, bool_or(taken) OVER (PARTITION BY "unknown") OR bool_or(taken) OVER (PARTITION BY known) AS met FROM
        (SELECT "unknown", known, score, row_number() OVER (PARTITION BY "unknown" ORDER BY score DESC, known) = 1 AND row_number() OVER (PARTITION BY known ORDER BY score DESC, "unknown") = 1 AS taken FROM ch WHERE NOT taken)) WHERE taken OR NOT met)
    SELECT "unknown", known, round(score, 6) AS score FROM ch WHERE taken"""


@query(f"""{CELLS_SQL}, tf AS (SELECT i, k, term, sum(n) AS tf FROM (SELECT DISTINCT i, k, v, n, unnest(regexp_split_to_array(lower(v), '[\\W_]+')) AS term FROM cells) WHERE term <> '' GROUP BY 1, 2, 3),
    tw AS (SELECT i, k, term, ln(1 + tf) * (ln(6.0::DOUBLE / (2 * count(*) OVER (PARTITION BY term))) + 1) AS w FROM tf), tn AS (SELECT i, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS w FROM tw),
    sc AS (SELECT 'col_' || x.i AS "unknown", y.k AS known, sum(x.w * y.w) AS score FROM tn x JOIN tn y USING (term) GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.1){CHOICE_SQL}""")
def instance_schema_match(spark, sf_dir):
    unknown, known, t = _renamed(spark, sf_dir)
    return rounded(SM.recover(unknown, known, list(t), list(t.values()), "instances", 0.1))


@query(f"""{CELLS_SQL}, nc AS (SELECT i, k, count(*) AS n FROM cells GROUP BY 1, 2),
    hit AS (SELECT x.i, y.k, count(DISTINCT x.v) AS n FROM cells x JOIN cells y ON 5 * levenshtein(x.v, y.v) <= greatest(length(x.v), length(y.v)) GROUP BY 1, 2),
    sc AS (SELECT 'col_' || x.i AS "unknown", y.k AS known, least(1, h.n / greatest(x.n + y.n - h.n, 1)::DOUBLE) AS score FROM nc x JOIN hit h ON h.i = x.i JOIN nc y ON y.k = h.k
        WHERE least(1, h.n / greatest(x.n + y.n - h.n, 1)::DOUBLE) >= 0.8){CHOICE_SQL}""")
def fuzzy_schema_match(spark, sf_dir):
    unknown, known, t = _renamed(spark, sf_dir)
    return rounded(SM.recover(unknown, known, list(t), list(t.values()), "jaccard", 0.8))


@query()
def distribution_schema_match(spark, sf_dir):
    x = M.line_rows(spark, sf_dir).withColumn("month_number", F.substring("month", 6, 2))
    unknown, t = SM.obfuscate(x.select("quantity", "month_number"), ["quantity", "month_number"])
    return rounded(SM.recover(unknown, x, list(t), list(t.values()), "distribution", 0.85))


# --- sampling and targets --------------------------------------------------------------------------------------

TENTH = "CAST(greatest(1, round((SELECT count(*) FROM customer) * 0.1)) AS BIGINT)"
HELD = f"h AS (SELECT id FROM c ORDER BY sha256(id || ':42'), id LIMIT {TENTH})"


def _tenth(spark, sf_dir):
    n = M.table(spark, sf_dir, "customer").count()
    return max(1, int(n * 0.1 + 0.5))


@query(f"WITH {M.CUSTOMERS_SQL}, {HELD} SELECT id, id IN (SELECT id FROM h) AS held_out FROM c")
def membership_split(spark, sf_dir):
    published, out = sampling.split(M.customers(spark, sf_dir), "id", _tenth(spark, sf_dir))
    return published.select("id", F.lit(False).alias("held_out")).unionByName(out.select("id", F.lit(True).alias("held_out")))


@query(f"WITH {_release_sql(0, 1)}, s AS (SELECT c.* FROM c JOIN r ON c.id = r.id WHERE NOT r.suppressed) SELECT id, place, balance FROM s ORDER BY sha256(id || ':42'), id LIMIT {TENTH}")
def auxiliary_base(spark, sf_dir):
    released = _release(spark, sf_dir, 0, 1).filter(~F.col("suppressed"))
    return sampling.auxiliary_base(M.customers(spark, sf_dir), released, "id", QIS, _tenth(spark, sf_dir))


@query(f"WITH {M.CUSTOMERS_SQL} SELECT id, CAST(CAST('0x' || substr(sha256(id || ':42'), 1, 8) AS BIGINT) % 5 AS BIGINT) AS fold FROM c")
def fold_assignment(spark, sf_dir):
    return rounded(sampling.folds(M.customers(spark, sf_dir), "id", 5).select("id", "fold"))


@query(f"""WITH {M.CUSTOMERS_SQL}, {HELD}, p AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM h)), i AS (SELECT id, place, balance FROM p ORDER BY sha256(id || ':42'), id LIMIT (SELECT count(*) FROM h))
    SELECT id, place, balance, 1::BIGINT AS is_member FROM i UNION ALL SELECT id, place, balance, 0::BIGINT FROM c WHERE id IN (SELECT id FROM h)""")
def membership_targets(spark, sf_dir):
    published, out = sampling.split(M.customers(spark, sf_dir), "id", _tenth(spark, sf_dir))
    return rounded(sampling.membership_targets(published, out, published, "id", QIS))


# --- attacks ---------------------------------------------------------------------------------------------------

LEVELS = {"place": 1, "balance": 1}


def _linkage(spark, sf_dir, known=("place", "balance")):
    release = written(_release(spark, sf_dir, 1, 1).filter(~F.col("suppressed")), "release")
    raw = M.customers(spark, sf_dir).withColumn("region_clear", F.col("region"))
    base = raw.join(release.select("id"), "id", "left_semi").select("id", *QIS)
    return attacks.linkage_attack(base, release.drop("id", "suppressed"), release.select("id", "segment"), "id", list(known), "segment", M.customer_hierarchies(spark, sf_dir), LEVELS)


LINK_SQL = _release_sql(1, 1) + f""", z AS (SELECT * FROM r WHERE NOT suppressed), t AS (SELECT z.id, z.place AS p, z.balance AS b, z.segment AS v FROM z),
    n AS (SELECT place, balance, segment, count(*) AS n FROM z GROUP BY 1, 2, 3), s AS (SELECT *, sum(n) OVER (PARTITION BY place, balance) AS class_size, count(*) OVER (PARTITION BY place, balance) AS kinds, row_number() OVER (PARTITION BY place, balance ORDER BY n DESC, segment) AS k FROM n),
    l AS (SELECT t.id, CAST(a.class_size AS BIGINT) AS class_size, a.segment AS predicted, a.n / a.class_size::DOUBLE AS probability, a.kinds, t.v AS true_value, m.n / a.class_size::DOUBLE AS true_probability
        FROM t JOIN s a ON a.place = t.p AND a.balance = t.b AND a.k = 1 JOIN s m ON m.place = t.p AND m.balance = t.b AND m.segment = t.v)"""


@query(f"WITH {LINK_SQL} SELECT id, class_size AS stage1_size, class_size, predicted, round(probability, 6) AS probability, true_value, predicted = true_value AS guess_right, kinds = 1 AS certain, kinds AS n_sensitive, round(true_probability, 6) AS true_probability, class_size = 1 AS reidentified FROM l")
def linkage_stage1(spark, sf_dir):
    return rounded(_linkage(spark, sf_dir).select("id", "stage1_size", "class_size", "predicted", "probability", "true_value", "guess_right", "certain", "n_sensitive", "true_probability", "reidentified"))


@query(f"""WITH {LINK_SQL} SELECT count(*) AS n_targets, round(avg((class_size = 1)::INT), 6) AS reidentification_rate, 0.0::DOUBLE AS false_unique_rate, round(avg(class_size), 6) AS avg_stage1_size, round(avg(class_size), 6) AS avg_class_size,
    round(median(class_size), 6) AS median_class_size, max(class_size) AS max_class_size, 0.0::DOUBLE AS avg_reduction_rate, round(avg((kinds = 1)::INT), 6) AS certainty_rate, round(avg((predicted = true_value)::INT), 6) AS guess_accuracy, round(avg(true_probability), 6) AS avg_true_probability FROM l""")
def linkage_summary(spark, sf_dir):
    return rounded(attacks.linkage_summary(_linkage(spark, sf_dir)))


@query(f"""WITH {LINK_SQL} SELECT true_value, count(*) AS n, round(count(*) / (SELECT count(*) FROM l)::DOUBLE, 6) AS share, count(*) FILTER (predicted = true_value) AS n_right, round(avg((predicted = true_value)::INT), 6) AS accuracy,
    round(avg(true_probability), 6) AS mean_probability, round(median(true_probability), 6) AS median_probability, round(avg((kinds = 1)::INT), 6) AS certainty_rate FROM l GROUP BY 1""")
def linkage_sensitive_report(spark, sf_dir):
    return rounded(attacks.sensitive_report(_linkage(spark, sf_dir)))


def _order_linkage(spark, sf_dir):
    """Orders released by month and price band, priority in clear: the attacker knows day, price and priority."""
    hs = M.order_hierarchies()
    raw = M.order_rows(spark, sf_dir)
    release = generalize(raw, [hs[0], hs[2]], {"day": 1, "price": 1})
    return attacks.linkage_attack(raw.select("id", "day", "priority", "price"), release.drop("id"), release.select("id", "status"), "id", ["day", "price", "priority"], "status", [hs[0], hs[2]], {"day": 1, "price": 1})


@query(f"""WITH {M.ORDERS_SQL}, g AS (SELECT id, substr(day, 1, 7) AS day, {M.band_sql('price', 20000)} AS price, priority, status FROM o),
    a AS (SELECT day, price, count(*) AS s1 FROM g GROUP BY 1, 2), b AS (SELECT day, price, priority, count(*) AS s2 FROM g GROUP BY 1, 2, 3)
    SELECT id, s1 AS stage1_size, s2 AS class_size, s1 - s2 AS reduction, round((s1 - s2) / s1::DOUBLE, 6) AS reduction_rate, s2 = 1 AS reidentified FROM g JOIN a USING (day, price) JOIN b USING (day, price, priority)""")
def linkage_stage2(spark, sf_dir):
    return rounded(_order_linkage(spark, sf_dir).select("id", "stage1_size", "class_size", "reduction", "reduction_rate", "reidentified"))


@query("SELECT 'place' AS attr, 1::BIGINT AS visible_level UNION ALL SELECT 'balance', 1::BIGINT")
def visible_levels(spark, sf_dir):
    return rounded(attacks.visible_levels(_release(spark, sf_dir, 1, 1), M.customer_hierarchies(spark, sf_dir), M.customers(spark, sf_dir)))


@query(f"WITH {M.CUSTOMERS_SQL} SELECT id, place, balance, region AS p_place, {M.BALANCE_LEVELS[1]} AS p_balance FROM c")
def attacker_projection(spark, sf_dir):
    return attacks.project(M.customers(spark, sf_dir).select("id", *QIS), M.customer_hierarchies(spark, sf_dir), LEVELS)


def _decided(spark, sf_dir, most=0.09):
    """A tenth of the customers is held out; the rest is released by regions and bands of 1000, k = 5."""
    published, out = (written(x, "split") for x in sampling.split(M.customers(spark, sf_dir).drop("region"), "id", _tenth(spark, sf_dir)))
    hs = M.customer_hierarchies(spark, sf_dir)
    release = written(A.suppress(generalize(published, hs, LEVELS), QIS, MODEL, "segment").filter(~F.col("suppressed")), "release")
    targets = sampling.membership_targets(published, out, release, "id", QIS)
    return attacks.membership_attack(targets, release.drop("id", "suppressed"), "id", QIS, hs, LEVELS, most)


MEMBER_SQL = f"""{M.CUSTOMERS_SQL}, {HELD}, pub AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM h)), g AS (SELECT id, region AS place, {M.BALANCE_LEVELS[1]} AS balance, segment FROM pub),
    k AS (SELECT place, balance, count(*) AS n, count(DISTINCT segment) AS s FROM g GROUP BY 1, 2), ok AS (SELECT * FROM k WHERE n >= 5 AND s >= 2), rel AS (SELECT g.id FROM g JOIN ok USING (place, balance)),
    i AS (SELECT id FROM rel ORDER BY sha256(id || ':42'), id LIMIT (SELECT count(*) FROM h)), t AS (SELECT id, 1::BIGINT AS is_member FROM i UNION ALL SELECT id, 0::BIGINT FROM h),
    d AS (SELECT t.id, is_member, coalesce(ok.n, 0) AS candidate_count, coalesce(ok.n, 0) / (SELECT count(*) FROM rel)::DOUBLE AS candidate_fraction FROM t JOIN c ON c.id = t.id LEFT JOIN ok ON ok.place = c.region AND ok.balance = {M.BALANCE_LEVELS[1].replace('balance', 'c.balance')}),
    e AS (SELECT *, CASE WHEN candidate_count > 0 AND candidate_fraction <= 0.02 THEN 1 ELSE 0 END::BIGINT AS predicted FROM d)"""


@query(f"WITH {MEMBER_SQL} SELECT id, is_member, candidate_count, round(candidate_fraction, 6) AS candidate_fraction, predicted FROM e")
def membership_decisions(spark, sf_dir):
    return rounded(_decided(spark, sf_dir, 0.02))


@query(f"""WITH {MEMBER_SQL}, n AS (SELECT count(*) FILTER (is_member = 1 AND predicted = 1) AS tp, count(*) FILTER (is_member = 0 AND predicted = 0) AS tn, count(*) FILTER (is_member = 0 AND predicted = 1) AS fp, count(*) FILTER (is_member = 1 AND predicted = 0) AS fn FROM e),
    r AS (SELECT *, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS a, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS c FROM n)
    SELECT tp, tn, fp, fn, round(a, 6) AS accuracy, round(p, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END, 6) AS tnr, round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp)::DOUBLE ELSE 0 END, 6) AS fpr,
        round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END, 6) AS fnr, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f1, round(a - 0.5, 6) AS advantage FROM r""")
def membership_metrics(spark, sf_dir):
    return rounded(attacks.binary_metrics(_decided(spark, sf_dir, 0.02)))


@query(f"""WITH {MEMBER_SQL}, th AS (SELECT DISTINCT candidate_fraction AS f FROM e UNION SELECT min(candidate_fraction) - 1e-12 FROM e),
    s AS (SELECT f, count(*) FILTER ((candidate_count > 0 AND candidate_fraction <= f) = (is_member = 1)) / count(*)::DOUBLE AS acc FROM th, e GROUP BY 1)
    SELECT round(f, 6) AS threshold, round(acc, 6) AS accuracy FROM s ORDER BY acc DESC, f LIMIT 1""")
def membership_best_threshold(spark, sf_dir):
    return rounded(attacks.best_threshold(_decided(spark, sf_dir, 0.02)))


@query(f"""WITH {MEMBER_SQL}, v AS (SELECT candidate_fraction AS v, count(*) FILTER (is_member = 1) AS a, count(*) FILTER (is_member = 0) AS b FROM e GROUP BY 1),
    w AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS y, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v), kk AS (SELECT max(abs(x - y)) AS ks, any_value(na) AS na, any_value(nb) AS nb FROM w),
    z AS (SELECT ks, sqrt(na * nb / (na + nb)) * ks AS z FROM kk)
    SELECT round(ks, 6) AS ks, round(CASE WHEN z < 0.05 THEN 1 ELSE greatest(0, least(1, (SELECT sum(2 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * z * z)) FROM range(1, 101) q(j)))) END, 6) AS p_value FROM z""")
def membership_ks(spark, sf_dir):
    return rounded(attacks.ks_two_sample(_decided(spark, sf_dir, 0.02)))


@query(f"WITH {MEMBER_SQL} SELECT " + ", ".join(f"round(avg({c}) FILTER (is_member = {m}), 6) AS {n}_avg_{c}" for m, n in ((1, "member"), (0, "non_member")) for c in ("candidate_count", "candidate_fraction")) + " FROM e")
def membership_group_means(spark, sf_dir):
    return rounded(attacks.group_means(_decided(spark, sf_dir, 0.02)))


@query(f"""WITH {MEMBER_SQL} SELECT (SELECT count(*) FROM pub) AS n_published, (SELECT count(*) FROM rel) AS n_survivors, round(1 - (SELECT count(*) FROM rel) / (SELECT count(*) FROM pub)::DOUBLE, 6) AS drop_rate,
    count(*) FILTER (is_member = 1) AS n_in, count(*) FILTER (is_member = 0) AS n_out FROM t""")
def membership_release_figures(spark, sf_dir):
    published, out = (written(x, "split") for x in sampling.split(M.customers(spark, sf_dir).drop("region"), "id", _tenth(spark, sf_dir)))
    release = written(A.suppress(generalize(published, M.customer_hierarchies(spark, sf_dir), LEVELS), QIS, MODEL, "segment").filter(~F.col("suppressed")), "release")
    return rounded(sampling.release_figures(published, release, sampling.membership_targets(published, out, release, "id", QIS), "id"))


@query(f"""WITH {LINK_SQL}, q AS (SELECT count(*) AS n, CAST(sum(class_size) AS BIGINT) AS s, (SELECT count(*) FROM z) AS r FROM l)
    SELECT n AS targets_evaluated, s AS stage1_rows_output, s AS class_rows_output, n * r * 2 AS filter_tests, 0::BIGINT AS refinement_tests, n * r * 2 + 2 * s AS estimated_total_operations FROM q""")
def linkage_operation_counts(spark, sf_dir):
    found = _linkage(spark, sf_dir)
    attacks.check_linkage(found)
    return rounded(attacks.operation_counts(found, _release(spark, sf_dir, 1, 1).filter(~F.col("suppressed")).count(), 2, 0))


@query(f"""WITH {_release_sql(1, 1)}, x AS (SELECT c.id, c.place, c.balance, c.region, {M.BALANCE_LEVELS[1].replace('balance', 'c.balance')} AS band, r.place AS rp, r.balance AS rb FROM c JOIN r USING (id)),
    y AS (SELECT CASE WHEN place = rp THEN 'exact' WHEN rp = '*' THEN 'suppressed' WHEN region = rp THEN 'generalized' ELSE 'none' END AS place_kind, CASE WHEN rb = '*' THEN 'suppressed' WHEN band = rb THEN 'generalized' ELSE 'none' END AS balance_kind FROM x)
    SELECT place_kind, balance_kind, count(*) AS n, round(CASE place_kind WHEN 'exact' THEN 1 WHEN 'suppressed' THEN 0.25 WHEN 'generalized' THEN 0.5 ELSE 0 END + CASE balance_kind WHEN 'suppressed' THEN 0.25 WHEN 'generalized' THEN 0.5 ELSE 0 END, 6) AS score FROM y GROUP BY 1, 2""")
def compatibility_kinds(spark, sf_dir):
    known = attacks.project(M.customers(spark, sf_dir).select("id", *QIS), M.customer_hierarchies(spark, sf_dir), LEVELS)
    j = known.join(_release(spark, sf_dir, 1, 1).select("id", *[F.col(q).alias(f"r_{q}") for q in QIS]), "id")
    kinds = [attacks.compatibility(F.col(q), F.col(f"p_{q}"), F.col(f"r_{q}")).alias(f"k_{q}") for q in QIS]
    per = j.select(*kinds).groupBy(F.col("k_place.kind").alias("place_kind"), F.col("k_balance.kind").alias("balance_kind"))
    return rounded(per.agg(F.count("*").alias("n"), F.max(F.col("k_place.score") + F.col("k_balance.score")).alias("score")))


# --- classification --------------------------------------------------------------------------------------------


@query(f"WITH {M.DOCS_SQL} SELECT lang AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 6) AS prior, row_number() OVER (ORDER BY count(*) DESC, lang) = 1 AS predicted FROM d GROUP BY 1")
def zero_r(spark, sf_dir):
    return rounded(classify.zero_r(M.documents(spark, sf_dir), "lang"))


@query(f"""WITH {M.DOCS_SQL}, l AS (SELECT quality AS class, 'lang' AS feature, lang AS value FROM d UNION ALL SELECT quality, 'source', source FROM d), n AS (SELECT feature, value, class, count(*) AS n FROM l GROUP BY 1, 2, 3)
    SELECT feature, value, class::BIGINT AS class, n, round(ln((n + 1) / (sum(n) OVER (PARTITION BY feature, class) + (SELECT count(DISTINCT value) FROM n m WHERE m.feature = n.feature))), 6) AS log_probability FROM n""")
def naive_bayes_counts(spark, sf_dir):
    return rounded(classify.naive_bayes_counts(M.documents(spark, sf_dir), ["lang", "source"], "quality"))


@query(f"""WITH {M.DOCS_SQL}, v AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM d GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM v)
    SELECT round(sum(n * (tp - p + p / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def auc(spark, sf_dir):
    return rounded(classify.auc(M.documents(spark, sf_dir).withColumn("truth", F.col("quality"))))


@query(f"""WITH {M.DOCS_SQL}, v AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM d GROUP BY 1),
    c AS (SELECT sum(n) OVER w / sum(n) OVER () AS x, sum(p) OVER w / sum(p) OVER () AS y FROM v WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 0.0, 0.0), e AS (SELECT x, min(y) AS y0, max(y) AS y1 FROM c GROUP BY 1),
    s AS (SELECT x, y0, y1, lead(x) OVER (ORDER BY x) AS nx, lead(y0) OVER (ORDER BY x) AS ny FROM e), g AS (SELECT i / 99.0::DOUBLE AS fpr FROM range(100) t(i))
    SELECT round(fpr, 6) AS fpr, round(CASE WHEN nx IS NULL OR fpr = x THEN y1 ELSE y1 + (ny - y1) * (fpr - x) / (nx - x) END, 6) AS tpr FROM g JOIN s ON fpr >= x AND (nx IS NULL OR fpr < nx)""")
def roc_points(spark, sf_dir):
    return rounded(classify.roc_points(M.documents(spark, sf_dir).withColumn("truth", F.col("quality"))))


def _scored(spark, sf_dir):
    d = M.documents(spark, sf_dir)
    return d.select(F.col("quality").cast("string").alias("truth"), F.when(F.col("score") >= 0.5, "1").otherwise("0").alias("predicted"), F.create_map(F.lit("1"), F.col("score"), F.lit("0"), 1 - F.col("score")).alias("probabilities"))


@query(f"""WITH {M.DOCS_SQL}, s AS (SELECT (quality = 1) AS t, score >= 0.5 AS p, score FROM d), b AS (SELECT '1' AS class, t, p, score FROM s UNION ALL SELECT '0', NOT t, NOT p, 1 - score FROM s),
    v AS (SELECT class, score, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM b GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS tp FROM v), u AS (SELECT class, sum(n * (tp - p + p / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1)
    SELECT b.class, round(count(*) FILTER (t AND p) / count(*) FILTER (t)::DOUBLE, 6) AS sensitivity, round(count(*) FILTER (NOT t AND NOT p) / count(*) FILTER (NOT t)::DOUBLE, 6) AS specificity, round(avg(pow(score - t::INT, 2)), 6) AS brier, round(any_value(u.auc), 6) AS auc FROM b JOIN u ON u.class = b.class GROUP BY 1""")
def class_metrics(spark, sf_dir):
    return rounded(classify.class_metrics(_scored(spark, sf_dir), ["0", "1"]))


@query(f"""WITH {M.DOCS_SQL}, a AS (SELECT avg(((score >= 0.5) = (quality = 1))::INT) AS acc, avg(((n_chars >= 1000) = (quality = 1))::INT) AS full_, greatest(avg(quality), 1 - avg(quality)) AS base FROM d)
    SELECT round(acc, 6) AS accuracy, round(base, 6) AS baseline_accuracy, round((round(acc, 8) - base) / (full_ - base), 6) AS relative_accuracy FROM a""")
def relative_accuracy(spark, sf_dir):
    """Between always saying the larger class (baseline) and a rule on the original column."""
    d = M.documents(spark, sf_dir)
    base = classify.zero_r(d, "quality").agg(F.max("prior")).first()[0]
    original = d.agg(F.avg(((F.col("n_chars") >= 1000) == (F.col("quality") == 1)).cast("double"))).first()[0]
    return rounded(classify.accuracy_summary(_scored(spark, sf_dir), base, original))


def _model_query(name, features):
    def run(spark, sf_dir):
        return rounded(classify.out_of_fold(M.documents(spark, sf_dir), "doc_id", features, "quality", name, 3).drop("probabilities"))

    return run


for _name, _key in (("logistic_regression", "lr_out_of_fold"), ("naive_bayes", "nb_out_of_fold"), ("random_forest", "rf_out_of_fold")):
    QUERIES[_key] = _model_query(_name, ["lang", "source", "n_chars"])


# --- reports and streams ---------------------------------------------------------------------------------------


@query(f"WITH {M.CUSTOMERS_SQL} SELECT place, count(*) AS count, round(median(balance), 6) AS median, round(avg(balance), 6) AS mean, round(coalesce(stddev_samp(balance), 0), 6) AS std, round(min(balance), 6) AS min, round(max(balance), 6) AS max FROM c GROUP BY 1")
def phase_curve_statistics(spark, sf_dir):
    return rounded(reporting.group_statistics(M.customers(spark, sf_dir), ["place"], "balance"))


@query(f"""WITH {M.CUSTOMERS_SQL}, e AS (SELECT min(balance) AS a, max(balance) AS b FROM c), v AS (SELECT CAST(least(floor((balance - a) / ((b - a) / 10)), 9) AS BIGINT) AS bin, a, b FROM c, e)
    SELECT bin, round(a + bin * (b - a) / 10, 6) AS lo, round(a + (bin + 1) * (b - a) / 10, 6) AS hi, count(*) AS n FROM v GROUP BY bin, a, b""")
def histogram(spark, sf_dir):
    return rounded(reporting.histogram(M.customers(spark, sf_dir), "balance", 10))


@query(f"""WITH {MEMBER_SQL}, x AS (SELECT min(candidate_fraction) AS a, max(candidate_fraction) AS b FROM e)
    SELECT CAST(CASE WHEN b > a THEN least(floor((candidate_fraction - a) / ((b - a) / 8)), 7) ELSE 0 END AS BIGINT) AS bin, count(*) FILTER (is_member = 1) AS n_in, count(*) FILTER (is_member = 0) AS n_out FROM e, x GROUP BY 1""")
def grouped_histogram(spark, sf_dir):
    return rounded(reporting.grouped_histogram(_decided(spark, sf_dir, 0.02), "candidate_fraction", "is_member", 8))


@query(f"""WITH {M.CUSTOMERS_SQL}, n AS (SELECT place AS a, segment AS b, count(*) AS o FROM c GROUP BY 1, 2), x AS (SELECT a, sum(o) AS na FROM n GROUP BY 1), y AS (SELECT b, sum(o) AS nb FROM n GROUP BY 1), t AS (SELECT sum(o) AS n FROM n)
    SELECT round(sum(pow(coalesce(o, 0) - na * nb / t.n::DOUBLE, 2) / (na * nb / t.n::DOUBLE)), 6) AS chi2, CAST((count(DISTINCT x.a) - 1) * (count(DISTINCT y.b) - 1) AS BIGINT) AS dof FROM x CROSS JOIN y CROSS JOIN t LEFT JOIN n ON n.a = x.a AND n.b = y.b""")
def chi_square(spark, sf_dir):
    return rounded(reporting.chi_square(M.customers(spark, sf_dir), "place", "segment"))


@query(f"WITH {M.CUSTOMERS_SQL} SELECT segment AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 6) AS share FROM c GROUP BY 1")
def value_shares(spark, sf_dir):
    return rounded(reporting.value_shares(M.customers(spark, sf_dir), "segment"))


@query(f"WITH {M.CUSTOMERS_SQL} SELECT place, segment, n FROM (SELECT place, segment, count(*) AS n, row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, segment) AS k FROM c GROUP BY 1, 2) WHERE k = 1")
def most_common_value(spark, sf_dir):
    return reporting.most_common(M.customers(spark, sf_dir), ["place"], "segment")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def keep_first_per_key(spark, sf_dir):
    return reporting.keep_one(M.table(spark, sf_dir, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last_per_key(spark, sf_dir):
    return reporting.keep_one(M.table(spark, sf_dir, "events"), ["event_type", "user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "user_id", "event_id")


@query("""WITH p(i, a) AS (VALUES (1, 'place'), (2, 'balance'), (3, 'day'), (4, 'priority')),
    s AS (SELECT a AS qis FROM p UNION ALL SELECT x.a || ',' || y.a FROM p x JOIN p y ON x.i < y.i UNION ALL SELECT x.a || ',' || y.a || ',' || z.a FROM p x JOIN p y ON x.i < y.i JOIN p z ON y.i < z.i),
    k(k) AS (VALUES (2), (5), (10)), m(measure) AS (VALUES ('loss'), ('height'), ('precision')), g(aggregate) AS (VALUES ('arithmetic_mean'), ('geometric_mean'), ('sum'), ('maximum'), ('rank'))
    SELECT 'run_' || substr(md5('qi=' || qis || ';k=' || k || ';l=2;t=None;supp=0.1;measure=' || measure || ';agg=' || aggregate), 1, 8) AS experiment_id, qis, k::BIGINT AS k, measure, aggregate FROM s, k, m, g""")
def grid_plan(spark, sf_dir):
    from .campaign import grid

    plan = grid(("place", "balance", "day", "priority"), (1, 2, 3), ks=(2, 5, 10), measures=("loss", "height", "precision"), aggregates=A.AGGREGATES)
    return spark.createDataFrame([(e.id, ",".join(e.qis), e.model.k, e.measure, e.aggregate) for e in plan], "experiment_id string, qis string, k long, measure string, aggregate string")


@query()
def grid_results(spark, sf_dir):
    from .campaign import grid, run_grid

    found = run_grid(M.customers(spark, sf_dir), M.customer_hierarchies(spark, sf_dir), "segment", grid(QIS, (1, 2), ks=(2, 5)))
    return rounded(found)


@query()
def attack_campaign(spark, sf_dir):
    from .campaign import Attacker, attack_campaign, grid

    experiments = [None, *grid(QIS, (2,), ks=(5,))]
    return rounded(attack_campaign(M.customers(spark, sf_dir).drop("region"), "id", "segment", M.customer_hierarchies(spark, sf_dir), experiments, [Attacker("A1", ("place",)), Attacker("A2", ("place", "balance"))], _tenth(spark, sf_dir)))


EPOCH_DAYS = "CAST(floor(epoch(ts) / 86400 / 30) AS BIGINT)"


@query(f"SELECT epoch_ms(CAST({EPOCH_DAYS} * 30 * 86400 * 1000 AS BIGINT)) AS window_start, event_type, count(*) AS n, count(*) >= 100 AS anonymous FROM events GROUP BY 1, 2")
def window_group_sizes(spark, sf_dir):
    out = monitor.window_groups(M.table(spark, sf_dir, "events"), ["event_type"], 100)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(SQL["window_group_sizes"])
def stream_window_group_sizes(spark, sf_dir):
    """The same over a stream of the events file, with a watermark."""
    events = M.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = monitor.run_to_table(monitor.window_groups(stream, ["event_type"], 100), spark)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
