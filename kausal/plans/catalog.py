"""The queries of the driver contract, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import critical_z, p_value
from ..operators import diagnostics, evaluate, moments, orient, ranks
from ..operators import skeleton as sk
from ..sources import datasets, truth
from ..sources.shared import new_path
from . import graphs, views
from .api import discover, search, sweep
from .report import report_graph, report_metrics

# Coefficients of the rational approximations of the normal quantile (AS 241), highest power first.
CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)

Query = Callable[[SparkSession, str], DataFrame]
A1, A2 = 0.01, 0.05
ALPHAS = [0.001, 0.01, 0.05, 0.2]
#: The SQL makes level 1 after an idle level 0 as well; only later levels need one before them that removed something.
STOP_FROM = 1
RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r6(c, name: str):
    """Rounded to six places, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def text_of(c: str, name: str):
    return F.concat_ws(",", F.col(c).cast("array<string>")).alias(name)


def matrix1(s, d) -> moments.Correlations:
    return moments.correlation_matrix(views.v1(s, d), views.V1)


def matrix2(s, d) -> moments.Correlations:
    return moments.correlation_matrix(views.v2(s, d), views.V2)


def triples(spark, p: int) -> DataFrame:
    v = lambda c: spark.range(p).select(F.col("id").cast("int").alias(c))
    return sk.pair_grid(spark, p).join(v("m"), (F.col("m") != F.col("i")) & (F.col("m") != F.col("j")))


def values(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def queries() -> dict[str, Query]:
    def small(d, rows, schema):
        return values(d, rows, schema).coalesce(1)

    def skeleton_at(level: int) -> Query:
        def run(s, d):
            return sk.skeleton(s, matrix2(s, d), A2, level, stop_from=STOP_FROM).edges
        return run

    def pc(s, d):
        return search(s, matrix2(s, d), A2, 2, stop_from=STOP_FROM)

    def ci(k: int) -> Query:
        def run(s, d):
            m = matrix1(s, d)
            rows = triples(s, m.p)
            if k == 2:
                rows = rows.join(s.range(m.p).select(F.col("id").cast("int").alias("m2")), (F.col("m2") > F.col("m")) & (F.col("m2") != F.col("i")) & (F.col("m2") != F.col("j")))
            rho = sk.partial_correlations(rows.withColumn("s", F.array("m", *(["m2"] if k == 2 else []))), m)
            return rho.select("i", "j", F.col("s")[0].alias("m"), *([F.col("s")[1].alias("m2")] if k == 2 else []), r6(F.col("rho"), "rho"))
        return run

    def fisher(s, d):
        m = matrix1(s, d)
        return sk.ci_tests(triples(s, m.p).withColumn("s", F.array("m")), m, 1, A1).withColumn("m", F.col("s")[0])

    def halves(s, d):
        """The graphs, at level 0, of the embeddings' two halves: one as found, one as its reference."""
        a, b = (sk.skeleton(s, moments.correlation_matrix(v(s, d), n), A2, 0).edges for v, n in ((views.v2, views.V2), (views.v4, views.V4)))
        return a, b, a.selectExpr("i as src", "j as dst"), b.selectExpr("if((i + j) % 3 = 0, j, i) as src", "if((i + j) % 3 = 0, i, j) as dst")

    def scored(s, d):
        return evaluate.ratios(evaluate.confusion(*halves(s, d)[2:], 32)).select(*[F.round(k, 6).alias(k) for k in ("Precision", "Recall_TPR", "F1", "FDR", "FPR")], "SHD", "TP", "FP", "FN", "TN")

    def places(s, d):
        """(lines, variables): edges from nations to their regions, some lines without one."""
        t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
        lines = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_nationkey as pos", "replace(n_name, ' ', '_') || if(n_nationkey % 2 = 0, ',', '  ') || replace(r_name, ' ', '_') || if(n_nationkey % 5 = 0, '_x', '') as line")
        names = t("nation").selectExpr("n_nationkey as idx", "replace(n_name, ' ', '_') as name").union(t("region").selectExpr("r_regionkey + 25", "replace(r_name, ' ', '_')"))
        return lines, names

    def summary(s, d):
        m = moments.correlation_matrix(views.v3(s, d), views.V3)
        edges = sk.skeleton(s, m, A1, 0).edges
        return report_graph(small(s, list(enumerate(views.V3)), "idx int, name string"), edges, edges.selectExpr("i as src", "j as dst"))

    def csv_columns(s, d):
        """part as a CSV file with columns that go (text, a gap, DateTime) and columns that stay, read as a dataset."""
        path = new_path(s, "csv")
        s.read.parquet(f"{d}/part.parquet").selectExpr(
            "p_partkey as `b`", "p_name as `name`", "if(p_partkey % 50 = 7, 'NA', cast(p_size as string)) as gap", "p_size as DateTime", "p_size as datetime", "if(p_size > 9, 'True', 'False') as flag", "p_retailprice as `p, r`"
        ).coalesce(1).write.option("header", True).csv(path)
        data = datasets.load_dataset(s, path)
        return moments.numeric_profile(data.frame.toDF(*[f"x{k}" for k in range(len(data.names))]), [f"x{k}" for k in range(len(data.names))]).join(
            small(s, list(enumerate(data.names)), "idx int, header string"), "idx").select("idx", F.col("header").alias("name"), "n", F.round("mean", 4).alias("mean"))

    def e2e(s, d):
        r = discover(views.v2(s, d), A2, 2, stop_from=STOP_FROM)
        lines = r.edges.selectExpr("'edge' as kind", "i as a", "j as b")
        return lines.union(r.arrows.selectExpr("'arrow'", "src", "dst"))

    out: dict[str, Query] = {
        "numeric_profile": lambda s, d: moments.numeric_profile(views.v1(s, d), views.V1).select("idx", "name", "n", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var")),
        "column_filter": lambda s, d: small(s, [(n,) for n in datasets.from_frame(s.read.parquet(f"{d}/lineitem.parquet").selectExpr(
            "l_quantity", "if(l_linenumber = 7, null, l_tax) as gap", "l_discount", "l_returnflag", "l_quantity as DateTime")).names], "name string"),
        "corr_matrix": lambda s, d: moments.correlations(moments.moments(views.v1(s, d), views.V1)).select("i", "j", r6(F.col("r"), "r")),
        "corr_gram": lambda s, d: moments.correlations(moments.moments(views.v2(s, d), views.V2)).select("i", "j", r6(F.col("r"), "r")),
        "corr_constant_guard": lambda s, d: moments.correlations(moments.moments(s.read.parquet(f"{d}/part.parquet").selectExpr("p_size", "5.0D as five", "p_retailprice"), ["p_size", "five", "p_retailprice"])).select("i", "j", r6(F.col("r"), "r")),
        "partial_corr_k1": ci(1),
        "partial_corr_k2": ci(2),
        "fisher_z": lambda s, d: fisher(s, d).select("i", "j", "m", r6(F.col("z"), "z")),
        "fisher_p": lambda s, d: fisher(s, d).select("i", "j", "m", r6(p_value(F.col("z")), "p")),
        "ci_verdict": lambda s, d: fisher(s, d).select("i", "j", "m", "indep"),
        "combinations_k2": lambda s, d: sk.candidates(sk.skeleton(s, matrix2(s, d), A2, 0).edges, 2).select("i", "j", text_of("s", "s")),
        "skeleton_l0": skeleton_at(0),
        "skeleton_l1": skeleton_at(1),
        "skeleton_l2": skeleton_at(2),
        "skeleton_v1": lambda s, d: sk.skeleton(s, matrix1(s, d), A1, 2, stop_from=STOP_FROM).edges,
        "skeleton_v3": lambda s, d: sk.skeleton(s, moments.correlation_matrix(views.v3(s, d), views.V3), A1, 2, stop_from=STOP_FROM).edges,
        "skeleton_wide": lambda s, d: sk.skeleton(s, moments.correlation_matrix(views.v5(s, d), views.V5), 0.2, 2, stop_from=STOP_FROM).sepset.select("i", "j", text_of("s", "s"), "level"),
        "skeleton_stable": lambda s, d: sk.skeleton(s, matrix2(s, d), A2, 1, early_stop=False, stable=True).sepset.select("i", "j", text_of("s", "s"), "level"),
        "sepsets": lambda s, d: pc(s, d).sepset.select("i", "j", text_of("s", "s"), "level"),
        "adjacency_lists": lambda s, d: sk.adjacency_lists(pc(s, d).edges).select("i", text_of("nbrs", "nbrs")),
        "degree": lambda s, d: sk.symmetric(pc(s, d).edges).groupBy("i").agg(F.count("*").alias("degree")),
        "unshielded_triples": lambda s, d: orient.unshielded_triples(pc(s, d).edges),
        "colliders": lambda s, d: pc(s, d).arrows,
        "bidirected_pairs": lambda s, d: orient.bidirected_pairs(pc(s, d).arrows),
        "orient_conflict_free": lambda s, d: orient.conflict_free(pc(s, d).arrows),
        "cpdag": lambda s, d: search(s, matrix2(s, d), A2, 2, mode="documented", stop_from=STOP_FROM).arrows,
        "lag1_autocorr": lambda s, d: diagnostics.lag1_autocorrelation(s.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "value", "user_id"), ["value", "user_id"], ["ts", "event_id"]).select("name", "n", r6(F.col("r"), "r")),
        "thin_rows": lambda s, d: diagnostics.thin(s.read.parquet(f"{d}/events.parquet").select("ts", "event_id"), ["ts", "event_id"], 10).select("event_id"),
        "alpha_sweep": lambda s, d: small(s, [(r["alpha"], r["edges"]) for r in sweep(views.v2(s, d), [0.001, 0.01, 0.05, 0.2], [0])], "alpha double, edges long"),
        "size_sweep": lambda s, d: small(s, [(r["size"], r["edges"], r["arrows"]) for r in sweep(views.v2(s, d), [A2], [0, 1, 2], stop_from=STOP_FROM)], "size int, edges long, arrows long"),
        "sweep_grid": lambda s, d: small(s, [(r["step"], r["alpha"], r["size"], r["n"], r["edges"], r["arrows"]) for r in sweep(views.v3(s, d), ALPHAS, [0, 1, 2], ["doc_id"], [1, 2, 5], stop_from=STOP_FROM)], "step int, alpha double, size int, n long, edges long, arrows long"),
        "mid_ranks": lambda s, d: ranks.mid_ranks(ranks.values_of(s.read.parquet(f"{d}/lineitem.parquet"), RANKED)).select("col", "v", "n", "mid", "total"),
        "corr_normal_scores": lambda s, d: moments.correlations(moments.moments(ranks.normal_scores(s.read.parquet(f"{d}/lineitem.parquet").select(*RANKED), RANKED), RANKED)).select("i", "j", r6(F.col("r"), "r")),
        "csv_columns": csv_columns,
        "thin_sweep": lambda s, d: small(s, [(r["step"], r["n"], r["edges"]) for r in sweep(views.v3(s, d), [A1], [0], ["doc_id"], [1, 2, 5])], "step int, n long, edges long"),
        "graph_scores": scored,
        "graph_skeleton_shd": lambda s, d: (lambda a, b, x, y: evaluate.shd_edges(a, x, y))(*halves(s, d)),
        "graph_orientation": lambda s, d: (lambda a, b, x, y: evaluate.orientation_counts(a, x, y))(*halves(s, d)),
        "truth_of_places": lambda s, d: truth.parse_edges(*places(s, d), 30),
        "report_of_table": summary,
        "discover_end_to_end": e2e,
    }
    return out | graphs.queries()


def _corr_cte(view: str, names: list[str]) -> str:
    """CTEs d, n and r(i, j, r) for all ordered pairs of different columns."""
    def one(i: int, j: int) -> str:
        a, b = names[i], names[j]
        norm = f"(sqrt(var_pop({a}) * count(*)) * sqrt(var_pop({b}) * count(*)))"
        return f"{{'i': {i}, 'j': {j}, 'r': CASE WHEN count(*) < 2 OR {norm} <= 1e-8 THEN 0.0 ELSE greatest(-0.999999999, least(0.999999999, covar_pop({a}, {b}) * count(*) / {norm})) END}}"

    cells = ", ".join(one(i, j) for i in range(len(names)) for j in range(i + 1, len(names)))
    return f"""d AS ({view}), n AS (SELECT count(*) AS n FROM d),
u AS (SELECT unnest([{cells}]) AS c FROM d),
r AS (SELECT c.i AS i, c.j AS j, c.r AS r FROM u UNION ALL SELECT c.j, c.i, c.r FROM u)"""


def _pc_cte(view: str, names: list[str], alpha: float, levels: int, stable: bool = False) -> str:
    """CTEs up to e(i, j) and sep(i, j, s, level) of the search up to a level, each level an ordered fold."""
    zc = repr(critical_z(alpha))
    z = lambda rho, k: f"abs(0.5 * sqrt((SELECT n FROM n) - {k} - 3) * ln((1 + {rho}) / (1 - {rho})))"
    step = lambda xy, xz, yz: f"(({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz})))"
    out = [_corr_cte(view, names), f"e0 AS (SELECT i, j FROM r WHERE i < j AND {z('r', 0)} > {zc})", f"x0 AS (SELECT i, j, []::INT[] AS s, 0 AS level FROM r WHERE i < j AND {z('r', 0)} <= {zc})"]
    look = lambda a, b, alias: f"JOIN r {alias} ON {alias}.i = {a} AND {alias}.j = {b}"
    for k in range(1, levels + 1):
        p = k - 1
        out.append(f"a{p} AS (SELECT i, j FROM e{p} UNION ALL SELECT j, i FROM e{p})")
        if k == 1:
            rho = step("xy.r", "xz.r", "yz.r")
            tests = f"SELECT e.i, e.j, [m.j] AS s, {z(rho, 1)} AS z FROM e{p} e JOIN a{p} m ON m.i = e.i AND m.j <> e.j {look('e.i', 'e.j', 'xy')} {look('e.i', 'm.j', 'xz')} {look('e.j', 'm.j', 'yz')}"
        else:
            xy, xw, yw = (step(f"{t}.r", f"{t}1.r", f"{t}2.r") for t in ("p", "q", "t"))
            rho = step(xy, xw, yw)
            tests = f"""SELECT e.i, e.j, [m.j, w.j] AS s, {z(rho, 2)} AS z FROM e{p} e JOIN a{p} m ON m.i = e.i AND m.j <> e.j JOIN a{p} w ON w.i = e.i AND w.j <> e.j AND w.j > m.j
  {look('e.i', 'e.j', 'p')} {look('e.i', 'm.j', 'p1')} {look('e.j', 'm.j', 'p2')} {look('e.i', 'w.j', 'q')} {look('e.i', 'm.j', 'q1')} {look('w.j', 'm.j', 'q2')} {look('e.j', 'w.j', 't')} {look('e.j', 'm.j', 't1')} {look('w.j', 'm.j', 't2')}"""
        out.append(f"t{k} AS ({tests})")
        if stable:
            out.append(f"x{k} AS (SELECT i, j, min(s) AS s, {k} AS level FROM t{k} WHERE z <= {zc} GROUP BY i, j)")
        else:
            gate = "" if k == 1 else f" AND EXISTS (FROM x{p})"
            out.append(f"c{k} AS (SELECT row_number() OVER (ORDER BY i, j, s) AS k, * FROM t{k} WHERE z <= {zc}{gate})")
            blocked = "list_contains(f.gone, c.i * 1000 + c.j) OR len(list_filter(c.s, lambda m: list_contains(f.gone, least(c.i, m) * 1000 + greatest(c.i, m)))) > 0"
            out.append(f"""f{k} AS (SELECT 0::BIGINT AS k, []::INT[] AS gone, false AS took UNION ALL
  SELECT c.k, CASE WHEN {blocked} THEN f.gone ELSE list_append(f.gone, (c.i * 1000 + c.j)::INT) END, NOT ({blocked}) FROM f{k} f JOIN c{k} c ON c.k = f.k + 1)""")
            out.append(f"x{k} AS (SELECT c.i, c.j, c.s, {k} AS level FROM c{k} c JOIN f{k} f ON f.k = c.k AND f.took)")
        out.append(f"e{k} AS (SELECT i, j FROM e{p} ANTI JOIN x{k} USING (i, j))")
    unions = " UNION ALL ".join(f"SELECT i, j, s, level FROM x{k}" for k in range(levels + 1))
    out += [f"e AS (SELECT i, j FROM e{levels})", f"sep AS ({unions})", "adj AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e)"]
    out.append("tri AS (SELECT x.j AS a, x.i AS b, y.j AS c FROM adj x JOIN adj y ON x.i = y.i AND x.j < y.j WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.i = x.j AND e.j = y.j))")
    out.append("col AS (SELECT t.a, t.b, t.c FROM tri t JOIN sep s ON s.i = t.a AND s.j = t.c AND NOT list_contains(s.s, t.b))")
    out.append("arr AS (SELECT a AS src, b AS dst FROM col UNION SELECT c, b FROM col)")
    return "WITH RECURSIVE " + ",\n".join(out)


def oracle_sql() -> dict[str, str]:
    c1 = "WITH " + _corr_cte(views.V1_SQL, views.V1)
    pc = lambda level=2, **o: _pc_cte(views.V2_SQL, views.V2, A2, level, **o)
    six = lambda x: f"round({x}, 6) + 0.0"
    step = "((xy.r - xz.r * yz.r) / sqrt((1 - xz.r * xz.r) * (1 - yz.r * yz.r)))"
    k1 = f"""k1 AS (SELECT xy.i, xy.j, xz.j AS m, CASE WHEN sqrt((1 - xz.r * xz.r) * (1 - yz.r * yz.r)) <= 1e-8 THEN 0.0 ELSE {step} END AS rho
FROM r xy JOIN r xz ON xz.i = xy.i AND xz.j <> xy.j JOIN r yz ON yz.i = xy.j AND yz.j = xz.j),
k1s AS (SELECT i, j, m, rho FROM k1 WHERE i < j)"""
    z1 = "0.5 * sqrt((SELECT n FROM n) - 4) * ln((1 + rho) / (1 - rho))"
    horner = lambda x, c: "(" * (len(c) - 1) + repr(c[0]) + "".join(f" * {x} + {v!r})" for v in c[1:])
    from ..functions import stats as st

    def quantile(p: str) -> str:
        """The normal quantile of a share as SQL."""
        q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
        tail = lambda x, num, den: f"sign({q}) * {horner(x, num)} / {horner(x, den)}"
        centre = f"(0.180625 - {q} * {q})"
        return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner(centre, CENTRE[0])} / {horner(centre, CENTRE[1])} WHEN {r} <= 5 THEN {tail(f'({r} - 1.6)', *NEAR)} ELSE {tail(f'({r} - 5)', *FAR)} END"

    a = "a"
    y = "(1 / greatest(a * a, 1))"
    erfc = f"""CASE WHEN a <= 0.46875 THEN 1 - a * {horner('(a * a)', st.ERF_P)} / {horner('(a * a)', st.ERF_Q)} WHEN a <= 4 THEN exp(-a * a) * {horner(a, st.MID_P)} / {horner(a, st.MID_Q)}
  ELSE exp(-least(a * a, 700)) / greatest(a, 1) * (0.5641895835477563 - {y} * {horner(y, st.FAR_P)} / {horner(y, st.FAR_Q)}) END"""
    events = "SELECT value, user_id::DOUBLE AS user_id, lag(value) OVER w AS v0, lag(user_id::DOUBLE) OVER w AS u0, row_number() OVER w AS k FROM events WINDOW w AS (ORDER BY ts, event_id)"
    thinned = lambda k: f"SELECT * EXCLUDE (doc_id, k) FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM ({views.V3_SQL})) WHERE k % {k} = 0"
    profile = " UNION ALL ".join(f"SELECT {i}::INT AS idx, '{c}' AS name, count(*) AS n, round(avg({c}), 4) AS mean, round(var_pop({c}), 2) AS var FROM d" for i, c in enumerate(views.V1))
    guard = "WITH " + _corr_cte("SELECT p_size::DOUBLE AS p_size, 5.0::DOUBLE AS five, p_retailprice FROM part", ["p_size", "five", "p_retailprice"])
    k2 = """SELECT a.i, a.j, a.m, b.m AS m2, round(CASE WHEN sqrt((1 - b1.rho * b1.rho) * (1 - b2.rho * b2.rho)) <= 1e-8 THEN 0.0 ELSE (a.rho - b1.rho * b2.rho) / sqrt((1 - b1.rho * b1.rho) * (1 - b2.rho * b2.rho)) END, 6) + 0.0 AS rho
FROM k1 a JOIN k1 b ON b.i = a.i AND b.j = a.j AND b.m > a.m JOIN k1 b1 ON b1.i = a.i AND b1.j = b.m AND b1.m = a.m JOIN k1 b2 ON b2.i = a.j AND b2.j = b.m AND b2.m = a.m WHERE a.i < a.j"""
    code = lambda x, y: f"({x} * 1000 + {y})::BIGINT"
    line = lambda x, y: f"{code(x, y)}, {code(y, x)}"
    completed = f"""{pc()},
bi AS (SELECT x.src AS i, x.dst AS j FROM arr x JOIN arr y ON x.src = y.dst AND x.dst = y.src),
ln AS (SELECT i, j FROM adj ANTI JOIN bi USING (i, j)),
rule AS (
  SELECT [{code('x.i', 'x.j')}] AS need, [{line('y.i', 'y.j')}] AS free, {code('y.i', 'y.j')} AS v FROM adj x JOIN ln y ON x.j = y.i AND x.i <> y.j WHERE NOT EXISTS (FROM adj z WHERE z.i = x.i AND z.j = y.j)
  UNION ALL SELECT [{code('x.i', 'x.j')}, {code('y.i', 'y.j')}], [{line('c.i', 'c.j')}], {code('c.i', 'c.j')} FROM ln c JOIN adj x ON x.i = c.i JOIN adj y ON y.i = x.j AND y.j = c.j
  UNION ALL SELECT [{code('c.j', 'b.j')}, {code('d.j', 'b.j')}], [{line('b.i', 'b.j')}, {line('c.i', 'c.j')}, {line('d.i', 'd.j')}], {code('b.i', 'b.j')}
    FROM ln b JOIN ln c ON c.i = b.i JOIN ln d ON d.i = b.i AND c.j < d.j WHERE NOT EXISTS (FROM adj z WHERE z.i = c.j AND z.j = d.j)),
mk AS (SELECT 0::BIGINT AS k, (SELECT coalesce(list({code('src', 'dst')}), []) FROM arr ANTI JOIN bi ON src = bi.i AND dst = bi.j) AS a
  UNION ALL SELECT k + 1, list_concat(a, n) FROM (
    SELECT k, a, list_filter(m, lambda x: NOT list_contains(m, (x % 1000) * 1000 + x // 1000)) AS n FROM (
      SELECT k, any_value(a) AS a, list(DISTINCT v) AS m FROM mk JOIN rule ON list_has_all(a, need) AND NOT list_has_any(a, free) GROUP BY k)) WHERE len(n) > 0)
SELECT (v // 1000)::INT AS src, (v % 1000)::INT AS dst FROM (SELECT unnest(a) AS v FROM mk WHERE k = (SELECT max(k) FROM mk))"""
    level0 = lambda view, names: f"(WITH {_corr_cte(view, names)} SELECT i, j FROM r WHERE i < j AND abs(0.5 * sqrt((SELECT n FROM n) - 3) * ln((1 + r) / (1 - r))) > {critical_z(A2)!r})"
    both = f"""WITH a AS (SELECT i AS src, j AS dst FROM {level0(views.V2_SQL, views.V2)}), h AS (SELECT * FROM {level0(views.V4_SQL, views.V4)}),
b AS (SELECT CASE WHEN (i + j) % 3 = 0 THEN j ELSE i END AS src, CASE WHEN (i + j) % 3 = 0 THEN i ELSE j END AS dst FROM h)"""
    entries = """, c AS (SELECT count(*) FILTER (x.src IS NOT NULL AND y.src IS NOT NULL) AS TP, count(*) FILTER (y.src IS NULL) AS FP, count(*) FILTER (x.src IS NULL) AS FN FROM a x FULL JOIN b y USING (src, dst)),
k AS (SELECT TP, FP, FN, 32 * 31 - TP - FP - FN AS TN, FP + FN AS SHD FROM c),
q AS (SELECT *, coalesce(TP / nullif(TP + FP, 0), 0.0) AS P, coalesce(TP / nullif(TP + FN, 0), 0.0) AS R FROM k)
SELECT round(P, 6) AS Precision, round(R, 6) AS Recall_TPR, round(coalesce(2 * P * R / nullif(P + R, 0), 0.0), 6) AS F1, round(coalesce(FP / nullif(TP + FP, 0), 0.0), 6) AS FDR,
  round(coalesce(FP / nullif(FP + TN, 0), 0.0), 6) AS FPR, SHD, TP, FP, FN, TN FROM q"""
    turns = ", m AS (SELECT x.src IS NOT NULL AS p, y.i IS NOT NULL AS t, (y.i + y.j) % 3 = 0 AS back FROM a x FULL JOIN h y ON x.src = y.i AND x.dst = y.j)"
    places = """WITH v AS (SELECT n_nationkey AS idx, replace(n_name, ' ', '_') AS name FROM nation UNION ALL SELECT r_regionkey + 25, replace(r_name, ' ', '_') FROM region)
SELECT x.idx::INT AS src, y.idx::INT AS dst FROM nation JOIN region ON r_regionkey = n_regionkey JOIN v x ON x.name = replace(n_name, ' ', '_') JOIN v y ON y.name = replace(r_name, ' ', '_') WHERE n_nationkey % 5 <> 0"""
    named = "list_value(" + ", ".join(f"'{c}'" for c in views.V3) + ")"
    described = f"""{_pc_cte(views.V3_SQL, views.V3, A1, 0)},
l AS (SELECT 0 AS part, 0 AS a, 0 AS b, 'Variables: {", ".join(views.V3)}' AS text UNION ALL SELECT 1, -1, 0, 'Undirected skeleton:' UNION ALL SELECT 2, -1, 0, 'Directed edges:'
  UNION ALL SELECT 1, k, 0, '  ' || {named}[k + 1] || ' -> ' || coalesce((SELECT string_agg({named}[j + 1], ', ' ORDER BY j) FROM adj WHERE adj.i = k), '(none)') FROM range(6) v(k)
  UNION ALL SELECT 2, i, j, '  ' || {named}[i + 1] || ' -> ' || {named}[j + 1] FROM e UNION ALL SELECT 2, 0, 0, '  (none detected)' WHERE NOT EXISTS (FROM e))
SELECT (row_number() OVER (ORDER BY part, a, b) - 1)::INT AS line_no, text FROM l"""
    return {
        "numeric_profile": f"WITH d AS ({views.V1_SQL}) {profile}",
        "column_filter": "WITH c AS (SELECT count(*) - count(l_quantity) AS a, count(*) - count(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END) AS b, count(*) - count(l_discount) AS x FROM lineitem) SELECT name FROM (SELECT unnest([{'name': 'l_quantity', 'm': a}, {'name': 'gap', 'm': b}, {'name': 'l_discount', 'm': x}], recursive := true) FROM c) WHERE m = 0",
        "corr_matrix": f"{c1} SELECT i, j, {six('r')} AS r FROM r WHERE i < j",
        "corr_gram": f"WITH {_corr_cte(views.V2_SQL, views.V2)} SELECT i, j, {six('r')} AS r FROM r WHERE i < j",
        "corr_constant_guard": f"{guard} SELECT i, j, {six('r')} AS r FROM r WHERE i < j",
        "partial_corr_k1": f"{c1}, {k1} SELECT i, j, m, {six('rho')} AS rho FROM k1s",
        "partial_corr_k2": f"{c1}, {k1} {k2}",
        "fisher_z": f"{c1}, {k1} SELECT i, j, m, {six(z1)} AS z FROM k1s",
        "fisher_p": f"{c1}, {k1}, q AS (SELECT i, j, m, abs({z1}) / sqrt(2) AS a FROM k1s) SELECT i, j, m, {six(erfc)} AS p FROM q",
        "ci_verdict": f"{c1}, {k1} SELECT i, j, m, abs({z1}) <= {critical_z(A1)!r} AS indep FROM k1s",
        "combinations_k2": f"{pc(0)}, w AS (SELECT e.i, e.j, x.j AS m1, y.j AS m2 FROM e JOIN adj x ON x.i = e.i AND x.j <> e.j JOIN adj y ON y.i = e.i AND y.j <> e.j AND y.j > x.j) SELECT i, j, m1 || ',' || m2 AS s FROM w",
        **{f"skeleton_l{k}": f"{pc(k)} SELECT i, j FROM e" for k in (0, 1, 2)},
        "skeleton_v1": f"{_pc_cte(views.V1_SQL, views.V1, A1, 2)} SELECT i, j FROM e",
        "skeleton_v3": f"{_pc_cte(views.V3_SQL, views.V3, A1, 2)} SELECT i, j FROM e",
        "skeleton_wide": f"{_pc_cte(views.V5_SQL, views.V5, 0.2, 2)} SELECT i, j, array_to_string(s, ',') AS s, level FROM sep",
        "skeleton_stable": f"{pc(1, stable=True)} SELECT i, j, array_to_string(s, ',') AS s, level FROM sep",
        "sepsets": f"{pc()} SELECT i, j, array_to_string(s, ',') AS s, level FROM sep",
        "adjacency_lists": f"{pc()} SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS nbrs FROM adj GROUP BY i",
        "degree": f"{pc()} SELECT i, count(*) AS degree FROM adj GROUP BY i",
        "unshielded_triples": f"{pc()} SELECT a, b, c FROM tri",
        "colliders": f"{pc()} SELECT src, dst FROM arr",
        "bidirected_pairs": f"{pc()} SELECT x.src AS i, x.dst AS j FROM arr x JOIN arr y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
        "orient_conflict_free": f"{pc()} SELECT src, dst FROM arr x WHERE NOT EXISTS (SELECT 1 FROM arr y WHERE x.src = y.dst AND x.dst = y.src)",
        "cpdag": completed,
        "lag1_autocorr": f"WITH l AS ({events}) SELECT 'value' AS name, count(*) AS n, {six('corr(value, v0)')} AS r FROM l WHERE k > 1 UNION ALL SELECT 'user_id', count(*), {six('corr(user_id, u0)')} FROM l WHERE k > 1",
        "thin_rows": "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % 10 = 0",
        "alpha_sweep": " UNION ALL ".join(f"SELECT * FROM ({_pc_cte(views.V2_SQL, views.V2, al, 0)} SELECT {al}::DOUBLE AS alpha, count(*) AS edges FROM e)" for al in (0.001, 0.01, 0.05, 0.2)),
        "size_sweep": " UNION ALL ".join(f"SELECT * FROM ({pc(k)} SELECT {k}::INT AS size, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM arr) AS arrows)" for k in (0, 1, 2)),
        "sweep_grid": " UNION ALL ".join(
            f"SELECT * FROM ({_pc_cte(thinned(k), views.V3[:-1], al, size)} SELECT {k}::INT AS step, {al}::DOUBLE AS alpha, {size}::INT AS size, (SELECT n FROM n) AS n, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM arr) AS arrows)"
            for k in (1, 2, 5) for al in ALPHAS for size in (0, 1, 2)),
        "mid_ranks": " UNION ALL ".join(f"SELECT {k}::INT AS col, v, n, before + (n + 1) / 2 AS mid, total FROM (SELECT {c}::DOUBLE AS v, count(*) AS n, (sum(count(*)) OVER (ORDER BY {c}) - count(*))::BIGINT AS before, (sum(count(*)) OVER ())::BIGINT AS total FROM lineitem GROUP BY {c})" for k, c in enumerate(RANKED)),
        "corr_normal_scores": f"""WITH n AS (SELECT {', '.join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / (count(*) OVER () + 1) AS p{k}" for k, c in enumerate(RANKED))} FROM lineitem),
s AS (SELECT {', '.join(f"{quantile(f'p{k}')} AS s{k}" for k in range(len(RANKED)))} FROM n)
{' UNION ALL '.join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(corr(s{i}, s{j}), 6) + 0.0 AS r FROM s" for i in range(len(RANKED)) for j in range(i + 1, len(RANKED)))}""",
        "csv_columns": """SELECT * FROM (SELECT 0::INT AS idx, 'b' AS name, count(*) AS n, round(avg(p_partkey), 4) AS mean FROM part UNION ALL SELECT 1, 'datetime', count(*), round(avg(p_size), 4) FROM part
  UNION ALL SELECT 2, 'flag', count(*), round(avg(CASE WHEN p_size > 9 THEN 1 ELSE 0 END), 4) FROM part UNION ALL SELECT 3, 'p, r', count(*), round(avg(p_retailprice), 4) FROM part)""",
        "thin_sweep": " UNION ALL ".join(f"SELECT * FROM ({_pc_cte(thinned(k), views.V3[:-1], A1, 0)} SELECT {k}::INT AS step, (SELECT n FROM n) AS n, (SELECT count(*) FROM e) AS edges)" for k in (1, 2, 5)),
        "graph_scores": both + entries,
        "graph_skeleton_shd": f"{both}{turns} SELECT count(*) FILTER (NOT p OR NOT t OR back) AS SHD FROM m",
        "graph_orientation": f"{both}{turns} SELECT count(*) FILTER (NOT back) AS correct, count(*) FILTER (back) AS reversed, 0::BIGINT AS undirected, 0::BIGINT AS other FROM m WHERE p AND t",
        "truth_of_places": places,
        "report_of_table": described,
        "discover_end_to_end": f"{pc()} SELECT 'edge' AS kind, i AS a, j AS b FROM e UNION ALL SELECT 'arrow', src, dst FROM arr",
    } | graphs.oracle_sql()
