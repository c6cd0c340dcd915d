"""Queries over the fit protocols: walk-forward, choice and refit, comparisons of splits.

The protocols run over the labelled months with the plain model of cells, whose every
measure SQL can state; with forests, SQL states the rows of each part and the windows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.functions.storage import fresh, written
from hazardspark.operators import scoring, selection, trees
from hazardspark.operators.frequency import KEYS, Frequent
from hazardspark.operators.training import Forest, facts_of
from hazardspark.plans import domain
from hazardspark.plans.domain import LAB, MON

LEAST, VALIDATION, TEST = 3, 1999, 2000
CANDIDATES = [(0, 1), (1, 5), (2, 5), (2, 40), (None, 5)]
DEPTH, LEAF = 2, 10
CLASSES = "(VALUES ('baixo'), ('medio'), ('alto')) k(c)"


def _six(rows, *names):
    return rows.withColumns({n: F.round(n, 6) for n in names})


def _plain(rows, depth=DEPTH, leaf=LEAF):
    return Frequent.fit(rows, depth, leaf)


def _cells(tag: str, source: str, where: str, depth: int, leaf: int) -> str:
    """Cells of the plain model of one training slice, as common table expressions."""
    out = []
    for d in range(depth + 1):
        keys = ", ".join(f"{k}" for k in KEYS[:d])
        weights = "count(*) FILTER (nivel_risco = 'baixo') AS b, 3 * count(*) FILTER (nivel_risco = 'medio') AS m, 6 * count(*) FILTER (nivel_risco = 'alto') AS a"
        group = f" GROUP BY {keys} HAVING count(*) >= {leaf}" if d else ""
        said = "CASE WHEN b >= m AND b >= a THEN 'baixo' WHEN m >= a THEN 'medio' ELSE 'alto' END AS said"
        out.append(f"{tag}_c{d} AS (SELECT *, {said} FROM (SELECT {keys + ', ' if d else ''}count(*) AS n, {weights} FROM {source} WHERE {where}{group}))")
    return ", ".join(out)


def _said(tag: str, source: str, where: str, depth: int) -> str:
    joins = "".join(f" LEFT JOIN {tag}_c{d} ON " + " AND ".join(f"s.{k} = {tag}_c{d}.{k}" for k in KEYS[:d]) for d in range(depth, 0, -1))
    said = ", ".join(f"{tag}_c{d}.said" for d in range(depth, -1, -1))
    return f"{tag}_p AS (SELECT s.nivel_risco AS real, coalesce({said}) AS said FROM {source} s{joins}, {tag}_c0 WHERE {where})"


def _measured(tag: str) -> str:
    return (
        f"{tag}_e AS (SELECT c, count(*) FILTER (real = c AND said = c) AS t, count(*) FILTER (real = c) AS r, count(*) FILTER (said = c) AS s FROM {tag}_p, {CLASSES} GROUP BY c), "
        f"{tag}_m AS (SELECT avg(t / r) FILTER (r > 0) AS balanced, avg(2.0 * t / (r + s)) FILTER (r + s > 0) AS f1, coalesce(max(t / r) FILTER (c = 'alto' AND r > 0), 0) AS alto FROM {tag}_e)"
    )


def _trial(tag: str, train: str, test: str, depth: int | None, leaf: int, source: str = "lab") -> str:
    depth = len(KEYS) if depth is None else depth
    return ", ".join((_cells(tag, source, train, depth, leaf), _said(tag, source, test, depth), _measured(tag)))


_MEASURES = "round(balanced, 6) AS acuracia_balanceada, round(f1, 6) AS f1_macro, round(alto, 6) AS recall_alto"


def _walk(spark, d):
    return _six(selection.walk_forward(domain.labelled(spark, d), _plain, LEAST), *selection.MEASURES)


def _walk_sql() -> str:
    """Every year that the given orders have, in a form that leaves out what is no window."""
    years = range(1992, 2004)
    trials = ", ".join(_trial(f"w{y}", f"ano < {y}", f"s.ano = {y}", DEPTH, LEAF) for y in years)
    rows = " UNION ALL ".join(f"SELECT {y} AS ano_teste, * FROM w{y}_m" for y in years)
    return (
        f"WITH {LAB}, {trials}, y AS (SELECT ano, row_number() OVER (ORDER BY ano) AS n, lag(ano) OVER (ORDER BY ano) AS before FROM (SELECT DISTINCT ano FROM lab)), m AS ({rows}) "
        f"SELECT y.before AS treino_ate, y.ano AS ano_teste, (SELECT count(*) FROM lab WHERE ano <= y.before) AS linhas_treino, (SELECT count(*) FROM lab WHERE ano = y.ano) AS linhas_teste, "
        "CAST((SELECT count(DISTINCT nivel_risco) FROM lab WHERE ano <= y.before) AS INTEGER) AS classes_treino, CAST((SELECT count(DISTINCT nivel_risco) FROM lab WHERE ano = y.ano) AS INTEGER) AS classes_teste, "
        f"{_MEASURES} FROM y JOIN m ON m.ano_teste = y.ano WHERE y.n > {LEAST}"
    )


def _selected(spark, d):
    return selection.select_and_refit(domain.labelled(spark, d), VALIDATION, TEST, _plain, CANDIDATES)


def _refit(spark, d):
    return _six(_selected(spark, d).report(), *selection.MEASURES)


def _chosen_sql() -> str:
    """The trials, the choice among them, and the test of every candidate, of which the chosen one's counts."""
    parts, lines, tests = [], [], []
    for i, (depth, leaf) in enumerate(CANDIDATES):
        parts.append(_trial(f"v{i}", f"ano < {VALIDATION}", f"s.ano >= {VALIDATION} AND s.ano < {TEST}", depth, leaf))
        parts.append(_trial(f"t{i}", f"ano < {TEST}", f"s.ano >= {TEST}", depth, leaf))
        lines.append(f"SELECT {i} AS i, {'NULL' if depth is None else depth} AS profundidade, {leaf} AS folha, * FROM v{i}_m")
        tests.append(f"SELECT {i} AS i, * FROM t{i}_m")
    return (
        f"{', '.join(parts)}, trials AS ({' UNION ALL '.join(lines)}), tests AS ({' UNION ALL '.join(tests)}), "
        "pick AS (SELECT i, profundidade, folha FROM trials WHERE f1 >= (SELECT max(f1) FROM trials) - 0.01 ORDER BY coalesce(profundidade, 999), -folha LIMIT 1), "
        f"sizes AS (SELECT count(*) FILTER (ano < {VALIDATION}) AS a, count(*) FILTER (ano >= {VALIDATION} AND ano < {TEST}) AS b, count(*) FILTER (ano >= {TEST}) AS c FROM lab)"
    )


_REFIT = (
    f"WITH {LAB}, {_chosen_sql()} "
    f"SELECT 'validacao' AS etapa, CAST(t.profundidade AS INTEGER) AS profundidade, t.folha, a AS linhas_ajuste, b AS linhas_prova, {_MEASURES}, t.i = pick.i AS escolhido FROM trials t, pick, sizes "
    f"UNION ALL SELECT 'teste', CAST(pick.profundidade AS INTEGER), pick.folha, a + b, c, {_MEASURES}, true FROM tests JOIN pick ON tests.i = pick.i, sizes "
    "UNION ALL SELECT 'final', CAST(profundidade AS INTEGER), folha, a + b + c, 0, NULL, NULL, NULL, true FROM pick, sizes"
)


def _final(spark, d):
    """The cells of the last fit, all keys named."""
    table = _selected(spark, d).final.table()
    return table.withColumns({k: F.lit(None).cast("string") for k in KEYS if k not in table.columns}).select("nivel", *KEYS, "n", "previsto")


def _final_sql() -> str:
    out = []
    for i, (depth, leaf) in enumerate(CANDIDATES):
        depth = len(KEYS) if depth is None else depth
        for level in range(depth + 1):
            keys = ", ".join(f"CAST({k} AS VARCHAR) AS {k}" if j < level else f"CAST(NULL AS VARCHAR) AS {k}" for j, k in enumerate(KEYS))
            out.append(f"SELECT {i} AS i, {level} AS nivel, {keys}, n, said AS previsto FROM f{i}_c{level}")
    cells = ", ".join(_cells(f"f{i}", "lab", "true", len(KEYS) if depth is None else depth, leaf) for i, (depth, leaf) in enumerate(CANDIDATES))
    return f"WITH {LAB}, {_chosen_sql()}, {cells}, every AS ({' UNION ALL '.join(out)}) SELECT e.* EXCLUDE (i) FROM every e JOIN pick ON e.i = pick.i"


SHARES = (0.5, 0.3, 0.2)
_KEY = "codigo_ibge, ano, mes, grupo_desastre"


def _split_sql(tag: str, share: str) -> str:
    order = f"md5(concat_ws('|', '42', {_KEY})), {_KEY}"
    return f"{tag} AS (SELECT * EXCLUDE (n, k), n <= round(k * {share}) AS teste FROM (SELECT *, row_number() OVER (PARTITION BY nivel_risco ORDER BY {order}) AS n, count(*) OVER (PARTITION BY nivel_risco) AS k FROM lab))"


def _shares(spark, d):
    return _six(selection.compare_shares(domain.labelled(spark, d), _plain, SHARES), "acuracia_balanceada", "f1_macro", "diferenca")


_SHARES = (
    f"WITH {LAB}, " + ", ".join(f"{_split_sql(f's{i}', share)}, {_trial(f'r{i}', 'NOT teste', 's.teste', DEPTH, LEAF, f's{i}')}" for i, share in enumerate(SHARES))
    + ", m AS (" + " UNION ALL ".join(f"SELECT CAST({share} AS DOUBLE) AS share, * FROM r{i}_m" for i, share in enumerate(SHARES)) + "), b AS (SELECT max(balanced) AS best FROM m) "
    "SELECT share AS proporcao_teste, round(balanced, 6) AS acuracia_balanceada, round(f1, 6) AS f1_macro, round(best - balanced, 6) AS diferenca, best - balanced < 0.02 AS desprezivel FROM m, b"
)


def _in_time(spark, d):
    return _six(selection.compare_in_time(domain.labelled(spark, d), _plain, TEST), "acuracia_balanceada", "f1_macro", "inflacao")


_IN_TIME = (
    f"WITH {LAB}, {_split_sql('s', f'(SELECT avg(CASE WHEN ano >= {TEST} THEN 1.0 ELSE 0 END) FROM lab)')}, {_trial('r', 'NOT teste', 's.teste', DEPTH, LEAF, 's')}, {_trial('t', f'ano < {TEST}', f's.ano >= {TEST}', DEPTH, LEAF)}, "
    "m AS (SELECT 'aleatoria' AS divisao, * FROM r_m UNION ALL SELECT 'temporal', * FROM t_m), g AS (SELECT r_m.balanced - t_m.balanced AS gap FROM r_m, t_m) "
    "SELECT divisao, round(balanced, 6) AS acuracia_balanceada, round(f1, 6) AS f1_macro, round(gap, 6) AS inflacao, gap > 0.02 AS relevante FROM m, g"
)

NUMBERS = ["ocorrencias_12m", "ocorrencias_mesmo_mes_historico", "anos_de_historico", "prejuizo_historico_log"]
FOREST = {"numeric": NUMBERS, "categorical": ["regiao", "grupo_desastre"]}


def _sane():
    """Whether all measures are there and lie between 0 and 1."""
    return F.forall(F.array(*selection.MEASURES), lambda m: m.isNotNull() & m.between(0, 1)).alias("medidas_validas")


def _forest_walk(spark, d):
    found = selection.walk_forward(domain.described(spark, d), selection.forest(10, depth=8, **FOREST), LEAST, together=2)
    return found.select("treino_ate", "ano_teste", "linhas_treino", "linhas_teste", _sane())


_FOREST_WALK = (
    f"WITH {LAB}, y AS (SELECT ano, count(*) AS k, row_number() OVER (ORDER BY ano) AS n, lag(ano) OVER (ORDER BY ano) AS before, sum(count(*)) OVER (ORDER BY ano) AS upto FROM lab GROUP BY ano) "
    f"SELECT before AS treino_ate, ano AS ano_teste, CAST(upto - k AS BIGINT) AS linhas_treino, k AS linhas_teste, true AS medidas_validas FROM y WHERE n > {LEAST}"
)


def _forest_refit(spark, d):
    found = selection.select_and_refit(domain.described(spark, d), VALIDATION, TEST, selection.forest(10, **FOREST), [(3, 10), (6, 5), (8, 3)], together=2).report()
    tried = found.where("etapa <> 'final'").select("etapa", "linhas_ajuste", "linhas_prova", _sane(), F.col("escolhido").cast("int").alias("escolhidos"))
    last = found.where("etapa = 'final'").select("etapa", "linhas_ajuste", "linhas_prova", F.lit(True), F.lit(1))
    return tried.union(last).groupBy("etapa", "linhas_ajuste", "linhas_prova").agg(F.count("*").alias("modelos"), F.sum("escolhidos").alias("escolhidos"), F.bool_and("medidas_validas").alias("medidas_validas"))


_FOREST_REFIT = (
    f"WITH {LAB}, s AS (SELECT count(*) FILTER (ano < {VALIDATION}) AS a, count(*) FILTER (ano >= {VALIDATION} AND ano < {TEST}) AS b, count(*) FILTER (ano >= {TEST}) AS c FROM lab) "
    "SELECT 'validacao' AS etapa, a AS linhas_ajuste, b AS linhas_prova, CAST(3 AS BIGINT) AS modelos, CAST(1 AS BIGINT) AS escolhidos, true AS medidas_validas FROM s "
    "UNION ALL SELECT 'teste', a + b, c, 1, 1, true FROM s UNION ALL SELECT 'final', a + b + c, 0, 1, 1, true FROM s"
)

ROW = ["codigo_ibge", "grupo_desastre", "indice_mes"]


def _votes(spark, d):
    """A forest of the default size on all inputs: the votes by its nodes against those of its own transform, row by row."""
    rows = domain.inputs(spark, d)
    model = Forest.fit(rows.where(F.col("ano") < TEST))
    tried = rows.where(F.col("ano") >= TEST)
    own = model.model.transform(model.encoding.transform(model.filled(tried))).select(*ROW, vector_to_array("rawPrediction").alias("own"))
    both = trees.votes(model, trees.nodes(model), tried, ROW).join(own, ROW)
    gap = F.array_max(F.zip_with("votos", "own", lambda a, b: F.abs(a - b)))
    return both.select(*ROW, (gap < 1e-9).alias("votos_iguais"), F.round(F.aggregate("votos", F.lit(0.0), lambda a, v: a + v), 6).alias("votos"))


def _node_importance(spark, d):
    """Importance summed over nodes against the model's own, for every input."""
    model = Forest.fit(domain.inputs(spark, d).where(F.col("ano") < TEST), 20, 8)
    summed = trees.importance(trees.nodes(model))
    own = model.importance().withColumnRenamed("importancia", "own")
    both = own.join(summed, "variavel", "left").withColumn("importancia", F.coalesce("importancia", F.lit(0.0)))
    total = F.sum("importancia").over(Window.partitionBy(F.lit(0)))  # a row for each input
    return both.select("variavel", (F.abs(F.col("own") - F.col("importancia")) < 1e-9).alias("igual"), (F.abs(total - 1) < 1e-9).alias("soma_um"))


_INPUTS = " UNION ALL ".join(f"SELECT '{c}' AS variavel, true AS igual, true AS soma_um" for c in [*contract.MODEL_NUMERIC, *contract.MODEL_CATEGORICAL])

SEASON, MAP_LEAF = 2002, 10
MONTHS = [(2001, 12), (2002, 1), (2002, 2), (2002, 3)]


def _cell_model(spark, d):
    return Frequent.fit(domain.labelled(spark, d), None, MAP_LEAF)


def _map(spark, d):
    path = fresh(spark, "map")
    scoring.write_map(_cell_model(spark, d), domain.occurrences(spark, d), spark.createDataFrame(MONTHS, "ano int, mes int"), path)
    return scoring.map_summary(scoring.read_map(spark, path))


def _season(spark, d):
    found = scoring.season_profile(_cell_model(spark, d), domain.occurrences(spark, d), SEASON)
    return _six(found.select("codigo_ibge", "grupo_desastre", "mes", "nivel", "prob_alto", "altura", "pico"), "altura")


def _map_sql(months: str) -> str:
    """Scores of the cells for every pair of place and group, at the months given."""
    depth = len(KEYS)
    joins = "".join(f" LEFT JOIN g_c{i} ON " + " AND ".join(f"r.{k} = g_c{i}.{k}" for k in KEYS[:i]) for i in range(depth, 0, -1))
    weights = ", ".join("coalesce(" + ", ".join(f"g_c{i}.{w}" for i in range(depth, -1, -1)) + f") AS {w}" for w in "bma")
    return (
        f"WITH {LAB}, {_cells('g', 'lab', 'true', depth, MAP_LEAF)}, r AS (SELECT DISTINCT codigo_ibge, grupo_desastre, regiao, ano, mes FROM (SELECT DISTINCT codigo_ibge, grupo_desastre, regiao FROM occ), {months} t(ano, mes)), "
        f"w AS (SELECT r.*, {weights} FROM r{joins}, g_c0), s AS (SELECT *, round(b / (b + m + a), 4) AS pb, round(m / (b + m + a), 4) AS pm, round(a / (b + m + a), 4) AS pa FROM w), "
        "x AS (SELECT *, CASE WHEN pb >= pm AND pb >= pa THEN 'baixo' WHEN pm >= pa THEN 'medio' ELSE 'alto' END AS nivel FROM s)"
    )


_MAP = (
    _map_sql("(VALUES " + ", ".join(map(str, MONTHS)) + ")")
    + " SELECT grupo_desastre, CAST(ano AS INTEGER) AS ano, CAST(mes AS INTEGER) AS mes, count(*) FILTER (nivel = 'baixo') AS baixo, count(*) FILTER (nivel = 'medio') AS medio, count(*) FILTER (nivel = 'alto') AS alto, count(*) AS total FROM x GROUP BY ALL"
)
_SEASON = (
    _map_sql("(VALUES " + ", ".join(f"({SEASON}, {m})" for m in range(1, 13)) + ")")
    + ", h AS (SELECT *, max(pa) OVER (PARTITION BY codigo_ibge, grupo_desastre) AS most FROM x) SELECT codigo_ibge, grupo_desastre, CAST(mes AS INTEGER) AS mes, nivel, pa AS prob_alto, round(pa / greatest(most, 0.01), 6) AS altura, pa = most AS pico FROM h"
)

def _saved(spark, d):
    """A model saved with the facts of its rows, loaded again: facts, and rows that both predict alike."""
    rows = written(domain.described(spark, d), "described")
    path = fresh(spark, "model")
    model = Forest.fit(rows, 5, 4, **FOREST)
    model.save(path, **facts_of(rows))
    again = Forest.load(spark, path)
    known, same = again.facts, again.facts["dados_hash"] == facts_of(rows)["dados_hash"]
    both = model.transform(rows).select(*ROW, F.col("previsto").alias("a")).join(again.transform(rows).select(*ROW, F.col("previsto").alias("b")), ROW)
    counts = both.agg(F.count_if(F.col("a") == F.col("b")).alias("iguais"))
    return counts.select(*(F.lit(known[k]).alias(k) for k in ("ano_inicial", "ano_final")), *(F.lit(known["classes"][c]).cast("long").alias(c) for c in contract.CLASSES), F.lit(known["linhas"]).cast("long").alias("linhas"), F.lit(len(known["grupos"])).alias("grupos"), F.lit(same).alias("hash_confere"), "iguais")


_SAVED = (
    f"WITH {MON}, l AS (SELECT *, CASE WHEN reconhecido OR mortos > 0 THEN 'alto' WHEN row_number() OVER (PARTITION BY codigo_ibge, grupo_desastre ORDER BY indice_mes) = 1 THEN 'baixo' ELSE 'medio' END AS level FROM mon) "
    "SELECT min(ano) AS ano_inicial, max(ano) AS ano_final, count(*) FILTER (level = 'baixo') AS baixo, count(*) FILTER (level = 'medio') AS medio, count(*) FILTER (level = 'alto') AS alto, "
    "count(*) AS linhas, CAST(count(DISTINCT grupo_desastre) AS INTEGER) AS grupos, true AS hash_confere, count(*) AS iguais FROM l"
)

QUERIES = {
    "s11_saved_model": (_saved, _SAVED),
    "m15_scored_map": (_map, _MAP),
    "w13_season_profile": (_season, _SEASON),
    "m2_m13_votes_by_nodes": (_votes, f"WITH {LAB} SELECT codigo_ibge, grupo_desastre, CAST(indice_mes AS INTEGER) AS indice_mes, true AS votos_iguais, CAST(100 AS DOUBLE) AS votos FROM lab WHERE ano >= {TEST}"),
    "m12_importance_by_nodes": (_node_importance, _INPUTS),
    "m6_walk_forward": (_walk, _walk_sql()),
    "m6_walk_forward_forest": (_forest_walk, _FOREST_WALK),
    "m7_select_and_refit": (_refit, _REFIT),
    "m7_final_model": (_final, _final_sql()),
    "m7_select_and_refit_forest": (_forest_refit, _FOREST_REFIT),
    "m10_random_shares": (_shares, _SHARES),
    "m11_random_against_time": (_in_time, _IN_TIME),
}
