"""Queries on a graph of nations, made from what their customers and suppliers trade, and their SQL.

t(a, b, c): c lines of orders of customers in nation a from suppliers in nation b. From c follow a reference graph (c % 5 = 0), a
found graph's arrows (c % 7 < 2) and lines (both ways' c together % 3 = 0), and arrows to propagate on these lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, orient
from ..operators import skeleton as sk
from ..sources import truth
from ..sources.shared import cut, new_path
from .api import all_scores
from .report import report_graph, report_metrics

N = 25  # nations


def trade(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = lines.groupBy(F.col("c_nationkey").cast("int").alias("a"), F.col("s_nationkey").cast("int").alias("b")).agg(F.count("*").alias("c")).where("a <> b")
    return cut(counts.coalesce(1), "trade")


def nations(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("cast(n_nationkey as int) as idx", "replace(n_name, ' ', '_') as name", "n_regionkey as region")


def reference(t: DataFrame) -> DataFrame:
    return t.where("c % 5 = 0").selectExpr("a as src", "b as dst")


def arrows(t: DataFrame) -> DataFrame:
    return t.where("c % 7 < 2").selectExpr("a as src", "b as dst")


def both_ways(t: DataFrame) -> DataFrame:
    return t.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("c").alias("c"), F.sum(F.expr("if(a < b, c, 0)")).alias("up")).where("c % 3 = 0")


def lines(t: DataFrame) -> DataFrame:
    return both_ways(t).select("i", "j")


def given(t: DataFrame) -> DataFrame:
    """Arrows on a quarter of the lines, from the nation that buys more."""
    return both_ways(t).where("c % 4 = 0").selectExpr("if(2 * up >= c, i, j) as src", "if(2 * up >= c, j, i) as dst")


def named(t: DataFrame, n: DataFrame) -> DataFrame:
    """The reference graph by names."""
    v = lambda c, name: n.select(F.col("idx").alias(c), F.col("name").alias(name))
    return reference(t).join(v("src", "src_name"), "src").join(v("dst", "dst_name"), "dst").select("src_name", "dst_name")


def matrix_lines(t: DataFrame, n: DataFrame) -> DataFrame:
    """The reference graph as the lines of a matrix: entries that aren't zero in several ways of writing, and comments."""
    rows = n.select(F.col("idx").alias("a")).join(n.select(F.col("idx").alias("b"))).join(t, ["a", "b"], "left")
    cell = F.expr("case when c is null or c % 5 <> 0 then '0' when c % 2 = 0 then '1' when c % 3 = 0 then '-1e0' else 'inf' end")
    listed = rows.select("a", "b", cell.alias("x")).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "x"))).alias("r"))
    return listed.select(F.col("a").alias("pos"), F.concat(F.array_join(F.col("r.x"), "  "), F.when(F.col("a") % 4 == 0, "  # row").otherwise("")).alias("line"))


def edge_lines(t: DataFrame, n: DataFrame) -> DataFrame:
    """Edges by names, by indices with a weight, by both (which don't count), and out of range."""
    v = lambda c, name: n.select(F.col("idx").alias(c), F.col("name").alias(name))
    line = "case c % 5 when 0 then if(c % 2 = 0, x || ',' || y, a || ' ' || b || ' 0.5') when 1 then a || ' ' || y when 2 then a || ',99' when 3 then x else '-1 ' || b end"
    return t.join(v("a", "x"), "a").join(v("b", "y"), "b").select((F.col("a") * 100 + F.col("b")).alias("pos"), F.expr(line).alias("line"))


def report(s: SparkSession, d: str) -> DataFrame:
    """The scores of the found graph against the reference graph, which is written as a matrix file over all nations and aligned
    by name to those outside region 0."""
    t, n = trade(s, d), nations(s, d)
    path = new_path(s, "matrix")
    matrix_lines(t, n).coalesce(1).sortWithinPartitions("pos").select("line").write.text(path)
    names = [r["name"] for r in n.orderBy("idx").collect()]
    known = n.where("region <> 0")
    by_name = cut(truth.load_named_truth(s, path, names)[0].coalesce(1), "named")
    inside = known.select(F.col("idx").alias("k"))
    within = lambda df, a, b: df.join(inside.withColumnRenamed("k", a), a, "left_semi").join(inside.withColumnRenamed("k", b), b, "left_semi")
    edges, found, wanted = within(lines(t), "i", "j"), within(arrows(t), "src", "dst"), cut(evaluate.align(by_name, known).coalesce(1), "aligned")
    text = all_scores(edges, found, wanted, known.count(), evaluate.by_recovery(by_name, known))
    return s.createDataFrame(list(enumerate(text)), "line_no int, text string").coalesce(1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda f: lambda s, d: f(trade(s, d))
    with_names = lambda f: lambda s, d: f(trade(s, d), nations(s, d))
    counts = lambda t: evaluate.confusion(arrows(t), reference(t), N)

    def metrics(s, d):
        t = trade(s, d)
        return s.createDataFrame(list(enumerate(report_metrics(evaluate.compute_metrics(arrows(t), reference(t), N)))), "line_no int, text string").coalesce(1)

    return {
        "pair_grid": lambda s, d: sk.pair_grid(s, nations(s, d).count()),
        "truth_matrix_parse": with_names(lambda t, n: truth.parse_matrix(matrix_lines(t, n), N, False)),
        "truth_edge_parse": with_names(lambda t, n: truth.parse_edges(edge_lines(t, n), n.select("idx", "name"), N)),
        "truth_aligned": with_names(lambda t, n: evaluate.align(named(t, n), n.where("region <> 0"))),
        "truth_recovery": with_names(lambda t, n: evaluate.by_recovery(named(t, n), n.where("region <> 0"))),
        "truth_missing": on(lambda t: evaluate.missing_edges(reference(t), arrows(t))),
        "confusion": on(counts),
        "shd_entry": on(lambda t: counts(t).select("SHD")),
        "shd_edge": on(lambda t: evaluate.shd_edges(lines(t), arrows(t), reference(t))),
        "metrics_directed": on(lambda t: evaluate.ratios(counts(t))),
        "metrics_skeleton": on(lambda t: evaluate.skeleton_metrics(lines(t), reference(t), N)),
        "orientation_counts": on(lambda t: evaluate.orientation_counts(lines(t), arrows(t), reference(t))),
        "report_graph": with_names(lambda t, n: report_graph(n.select("idx", "name"), lines(t), arrows(t))),
        "report_metrics": metrics,
        "report_documented": report,
        **{f"meek_r{k}": on(lambda t, k=k: orient.meek(lines(t), given(t), k)) for k in (1, 2, 3)},
        "meek_fixpoint": on(lambda t: orient.propagate(lines(t), given(t))),
    }


TRADE = """WITH RECURSIVE t AS (SELECT c_nationkey::INT AS a, s_nationkey::INT AS b, count(*) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
nat AS (SELECT n_nationkey::INT AS idx, replace(n_name, ' ', '_') AS name, n_regionkey AS region FROM nation),
tr AS (SELECT a AS src, b AS dst FROM t WHERE c % 5 = 0), ar AS (SELECT a AS src, b AS dst FROM t WHERE c % 7 < 2),
bw AS (SELECT least(a, b) AS i, greatest(a, b) AS j, sum(c)::BIGINT AS c, coalesce(sum(c) FILTER (a < b), 0)::BIGINT AS up FROM t GROUP BY 1, 2 HAVING sum(c) % 3 = 0),
ln AS (SELECT i, j FROM bw), gv AS (SELECT CASE WHEN 2 * up >= c THEN i ELSE j END AS src, CASE WHEN 2 * up >= c THEN j ELSE i END AS dst FROM bw WHERE c % 4 = 0),
adj AS (SELECT i, j FROM ln UNION ALL SELECT j, i FROM ln)"""


def oracle_sql() -> dict[str, str]:
    def scored(pred: str, ref: str, total: object, n: str = "") -> str:
        """CTEs up to m<n>, the counts and ratios of pairs (x, y)."""
        return f"""c{n} AS (SELECT count(*) FILTER (p.x IS NOT NULL AND w.x IS NOT NULL) AS TP, count(*) FILTER (w.x IS NULL) AS FP, count(*) FILTER (p.x IS NULL) AS FN FROM {pred} p FULL JOIN {ref} w ON p.x = w.x AND p.y = w.y),
k{n} AS (SELECT TP, FP, FN, {total} - TP - FP - FN AS TN, FP + FN AS SHD FROM c{n}),
q{n} AS (SELECT *, coalesce(TP / nullif(TP + FP, 0), 0.0) AS Precision, coalesce(TP / nullif(TP + FN, 0), 0.0) AS Recall_TPR, coalesce(FP / nullif(TP + FP, 0), 0.0) AS FDR, coalesce(FP / nullif(FP + TN, 0), 0.0) AS FPR FROM k{n}),
m{n} AS (SELECT *, coalesce(2 * Precision * Recall_TPR / nullif(Precision + Recall_TPR, 0), 0.0) AS F1 FROM q{n})"""

    entries = scored("(SELECT src AS x, dst AS y FROM ar)", "(SELECT src AS x, dst AS y FROM tr)", N * (N - 1))
    pairs = scored("(SELECT i AS x, j AS y FROM ln)", "(SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM tr)", N * (N - 1) // 2)
    state = lambda name, ls, aw: f"""{name} AS (SELECT x, y, CASE WHEN up AND down THEN 'x' WHEN up THEN '>' WHEN down THEN '<' ELSE '-' END AS s FROM
  (SELECT DISTINCT least(i, j) AS x, greatest(i, j) AS y FROM {ls}) FULL JOIN (SELECT least(src, dst) AS x, greatest(src, dst) AS y, bool_or(src < dst) AS up, bool_or(src > dst) AS down FROM {aw} GROUP BY 1, 2) USING (x, y))"""  # noqa: E731
    states = lambda ls="ln", aw="ar", ref="tr": f"{state('sp', ls, aw)}, {state('st', f'(SELECT src AS i, dst AS j FROM {ref})', ref)}"
    turned = "((sp.s = '>' AND st.s = '<') OR (sp.s = '<' AND st.s = '>'))"
    turns = f"""count(*) FILTER (sp.s = st.s) AS correct, count(*) FILTER ({turned}) AS reversed, count(*) FILTER (sp.s <> st.s AND sp.s = '-') AS undirected,
  count(*) FILTER (sp.s <> st.s AND sp.s <> '-' AND NOT {turned}) AS other FROM sp JOIN st USING (x, y)"""
    by_name = "nm AS (SELECT x.name AS src_name, y.name AS dst_name FROM tr JOIN nat x ON x.idx = src JOIN nat y ON y.idx = dst), kn AS (SELECT * FROM nat WHERE region <> 0)"
    value = lambda k: f"round(m.{k}, 4)::VARCHAR" if k in ("Precision", "Recall_TPR", "F1", "FDR", "FPR") else f"m.{k}::VARCHAR"
    line = lambda k, v: f"'  ' || rpad('{k}', 12, ' ') || ': ' || {v}"
    metric_lines = ", ".join(line(k, value(k)) for k in evaluate.KEYS)
    free = "u AS (SELECT i, j FROM adj WHERE NOT EXISTS (SELECT 1 FROM gv WHERE (src = i AND dst = j) OR (src = j AND dst = i)))"
    apart = lambda x, y: f"NOT EXISTS (SELECT 1 FROM adj z WHERE z.i = {x} AND z.j = {y})"
    code = lambda x, y: f"({x} * 1000 + {y})::BIGINT"
    way = lambda x, y: f"{code(x, y)}, {code(y, x)}"
    inside = "(SELECT idx FROM nat WHERE region <> 0)"
    within = f"""lk AS (SELECT i, j FROM ln WHERE i IN {inside} AND j IN {inside}), ak AS (SELECT src, dst FROM ar WHERE src IN {inside} AND dst IN {inside}), tk AS (SELECT src, dst FROM tr WHERE src IN {inside} AND dst IN {inside}),
p AS (SELECT count(*) AS p FROM {inside})"""
    four = lambda k: f"printf('%.4f', {k})"
    documented = f"""{TRADE}, {within}, {states('lk', 'ak', 'tk')},
{scored('(SELECT i AS x, j AS y FROM lk)', '(SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM tk)', '(SELECT p * (p - 1) // 2 FROM p)', '1')},
{scored('(SELECT src AS x, dst AS y FROM ak)', '(SELECT src AS x, dst AS y FROM tk)', '(SELECT p * (p - 1) FROM p)')},
o AS (SELECT {turns}), h AS (SELECT count(*) AS SHD FROM sp FULL JOIN st USING (x, y) WHERE sp.s IS DISTINCT FROM st.s),
r AS (SELECT ['Reference edges: ' || (SELECT count(*) FROM tr) || ', of which between variables of the dataset: ' || (SELECT count(*) FROM tk), 'Skeleton:',
  {line('Found', '(m1.TP + m1.FP)')}, {line('Precision', four('m1.Precision'))}, {line('Recall', four('m1.Recall_TPR'))}, {line('F1', four('m1.F1'))}, {line('SHD', 'h.SHD')}, 'Directions of shared edges:',
  {', '.join(line(k, f'o.{k}') for k in ('correct', 'reversed', 'undirected', 'other'))}, 'Directed entries:', {metric_lines}] AS l FROM m, m1, o, h)
SELECT (generate_subscripts(l, 1) - 1)::INT AS line_no, unnest(l) AS text FROM r"""
    fixpoint = f"""{TRADE},
rule AS (
  SELECT [{code('x.i', 'x.j')}] AS need, [{way('y.i', 'y.j')}] AS free, {code('y.i', 'y.j')} AS v FROM adj x JOIN adj y ON x.j = y.i AND x.i <> y.j WHERE {apart('x.i', 'y.j')}
  UNION ALL SELECT [{code('x.i', 'x.j')}, {code('y.i', 'y.j')}], [{way('c.i', 'c.j')}], {code('c.i', 'c.j')} FROM adj c JOIN adj x ON x.i = c.i JOIN adj y ON y.i = x.j AND y.j = c.j
  UNION ALL SELECT [{code('c.j', 'b.j')}, {code('d.j', 'b.j')}], [{way('b.i', 'b.j')}, {way('c.i', 'c.j')}, {way('d.i', 'd.j')}], {code('b.i', 'b.j')}
    FROM adj b JOIN adj c ON c.i = b.i JOIN adj d ON d.i = b.i AND c.j < d.j JOIN adj e ON e.i = c.j AND e.j = b.j JOIN adj f ON f.i = d.j AND f.j = b.j WHERE {apart('c.j', 'd.j')}),
mk AS (SELECT 0::BIGINT AS k, (SELECT coalesce(list({code('src', 'dst')}), []) FROM gv) AS a
  UNION ALL SELECT k + 1, list_concat(a, n) FROM (
    SELECT k, a, list_filter(m, lambda x: NOT list_contains(m, (x % 1000) * 1000 + x // 1000)) AS n FROM (
      SELECT k, any_value(a) AS a, list(DISTINCT v) AS m FROM mk JOIN rule ON list_has_all(a, need) AND NOT list_has_any(a, free) GROUP BY k)) WHERE len(n) > 0)
SELECT (v // 1000)::INT AS src, (v % 1000)::INT AS dst FROM (SELECT unnest(a) AS v FROM mk WHERE k = (SELECT max(k) FROM mk))"""
    return {
        "pair_grid": "SELECT a.n_nationkey::INT AS i, b.n_nationkey::INT AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
        "truth_matrix_parse": f"{TRADE} SELECT src, dst FROM tr",
        "truth_edge_parse": f"{TRADE} SELECT src, dst FROM tr",
        "truth_aligned": f"{TRADE} SELECT src, dst FROM tr WHERE src IN {inside} AND dst IN {inside}",
        "truth_recovery": f"{TRADE}, {by_name} SELECT src_name, dst_name, src_name IN (SELECT name FROM kn) AND dst_name IN (SELECT name FROM kn) AS recoverable FROM nm",
        "truth_missing": f"{TRADE} SELECT src, dst FROM tr EXCEPT SELECT src, dst FROM ar",
        "confusion": f"{TRADE}, {entries} SELECT TP, FP, FN, TN, SHD FROM k",
        "shd_entry": f"{TRADE}, {entries} SELECT SHD FROM k",
        "shd_edge": f"{TRADE}, {states()} SELECT count(*) AS SHD FROM sp FULL JOIN st USING (x, y) WHERE sp.s IS DISTINCT FROM st.s",
        "metrics_directed": f"{TRADE}, {entries} SELECT * FROM m",
        "metrics_skeleton": f"{TRADE}, {pairs} SELECT * FROM m",
        "orientation_counts": f"{TRADE}, {states()} SELECT {turns}",
        "report_graph": f"""{TRADE}, l AS (SELECT 0 AS part, 0 AS a, 0 AS b, 'Variables: ' || (SELECT string_agg(name, ', ' ORDER BY idx) FROM nat) AS text UNION ALL SELECT 1, -1, 0, 'Undirected skeleton:' UNION ALL SELECT 2, -1, 0, 'Directed edges:'
  UNION ALL SELECT 1, n.idx, 0, '  ' || n.name || ' -> ' || coalesce((SELECT string_agg(o.name, ', ' ORDER BY o.idx) FROM adj JOIN nat o ON o.idx = adj.j WHERE adj.i = n.idx), '(none)') FROM nat n
  UNION ALL SELECT 2, src, dst, '  ' || x.name || ' -> ' || y.name FROM ar JOIN nat x ON x.idx = src JOIN nat y ON y.idx = dst UNION ALL SELECT 2, 0, 0, '  (none detected)' WHERE NOT EXISTS (FROM ar))
SELECT (row_number() OVER (ORDER BY part, a, b) - 1)::INT AS line_no, text FROM l""",
        "report_metrics": f"{TRADE}, {entries}, r AS (SELECT ['Evaluation against ground truth:', {metric_lines}] AS l FROM m) SELECT (generate_subscripts(l, 1) - 1)::INT AS line_no, unnest(l) AS text FROM r",
        "report_documented": documented,
        "meek_r1": f"{TRADE}, {free} SELECT DISTINCT u.i AS src, u.j AS dst FROM gv JOIN u ON gv.dst = u.i AND gv.src <> u.j WHERE {apart('gv.src', 'u.j')}",
        "meek_r2": f"{TRADE}, {free} SELECT DISTINCT u.i AS src, u.j AS dst FROM u JOIN gv x ON x.src = u.i JOIN gv y ON y.src = x.dst AND y.dst = u.j",
        "meek_r3": f"{TRADE}, {free} SELECT DISTINCT u.i AS src, u.j AS dst FROM u JOIN u c ON c.i = u.i JOIN u f ON f.i = u.i AND c.j < f.j JOIN gv x ON x.src = c.j AND x.dst = u.j JOIN gv y ON y.src = f.j AND y.dst = u.j WHERE {apart('c.j', 'f.j')}",
        "meek_fixpoint": fixpoint,
    }
