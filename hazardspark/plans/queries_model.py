"""Queries over labelled rows: checks, splits, measures, scores, odds ratios, forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.contract import Rule
from hazardspark.operators import directory, features, history, inference, metrics, monthly, quality, scoring, selection, splits, training
from hazardspark.plans import domain, queries_events
from hazardspark.plans.domain import LAB, MON, OCC, RDG
from hazardspark.sources import geo

KEY = ["codigo_ibge", "grupo_desastre", "indice_mes"]
SERIES = ["codigo_ibge", "grupo_desastre"]
RULES = [Rule("codigo_ibge", 1, 1000), Rule("ano", 1996, 2000), Rule("mes", 2, 11), Rule("afetados", 50, 400), Rule("uf")]
DOMAINS = [Rule("grupo_desastre", domain=("1-URGENT", "5-LOW")), Rule("regiao", domain=("ASIA", "EUROPE", "AFRICA", "AMERICA"))]


def _counters_sql() -> str:
    lines = []
    for r in RULES:
        if r.low is not None:
            lines.append(f"SELECT 'abaixo_do_minimo' AS \"check\", '{r.name}' AS coluna, 'aviso' AS severidade, count(*) FILTER ({r.name} < {r.low}) AS n, '' AS detalhe FROM mon")
            lines.append(f"SELECT 'acima_do_maximo', '{r.name}', 'aviso', count(*) FILTER ({r.name} > {r.high}), '' FROM mon")
        lines.append(f"SELECT 'nulos', '{r.name}', 'aviso', count(*) FILTER ({r.name} IS NULL), CASE WHEN count(*) FILTER ({r.name} IS NULL) > 0.3 * count(*) THEN 'mais de 30%' ELSE '' END FROM mon")
    return f"WITH {MON} SELECT * FROM (" + " UNION ALL ".join(lines) + ") WHERE n > 0"


def _unknown_sql() -> str:
    lines = []
    for r in DOMAINS:
        inside = ", ".join(f"'{v}'" for v in r.domain)
        lines.append(f"SELECT 'fora_do_dominio' AS \"check\", '{r.name}' AS coluna, 'aviso' AS severidade, count(DISTINCT {r.name}) AS n, string_agg(DISTINCT {r.name}, ', ' ORDER BY {r.name}) AS detalhe FROM mon WHERE {r.name} NOT IN ({inside})")
    return f"WITH {MON} SELECT * FROM (" + " UNION ALL ".join(lines) + ") WHERE n > 0"


def _split(spark, d, share=0.3):
    return splits.stratified(domain.labelled(spark, d), share, KEY).select(*KEY, "nivel_risco", "parte")


def _counts(spark, d):
    return metrics.confusion(domain.labelled(spark, d))


_EACH = f"""WITH {LAB}, c AS (SELECT real, previsto, count(*) AS n FROM lab GROUP BY ALL), k AS (SELECT real AS classe FROM c UNION SELECT previsto FROM c),
e AS (SELECT classe, coalesce((SELECT sum(n) FROM c WHERE real = classe), 0) AS s, coalesce((SELECT sum(n) FROM c WHERE previsto = classe), 0) AS p, coalesce((SELECT sum(n) FROM c WHERE real = classe AND previsto = classe), 0) AS t FROM k),
f AS (SELECT classe, coalesce(t / nullif(p, 0), 0) AS precisao, coalesce(t / nullif(s, 0), 0) AS recall, CAST(s AS BIGINT) AS suporte FROM e),
g AS (SELECT *, coalesce(2 * precisao * recall / nullif(precisao + recall, 0), 0) AS f1 FROM f)"""
_PROB = """(1 + ascii(substr(md5(concat_ws('|', codigo_ibge, grupo_desastre, indice_mes)), {i}, 1)) % 16)"""


def _six(rows, *names):
    return rows.withColumns({n: F.round(n, 6) for n in names})


def _weights():
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in KEY)))
    return [1 + F.ascii(F.substring(digest, i, 1)) % 16 for i in (1, 2, 3)]


def _scored(spark, d):
    """Months with stand-in probabilities from a hash of their key."""
    w = _weights()
    total = w[0] + w[1] + w[2]
    return scoring.shape(domain.months(spark, d), F.array(*(x / total for x in w)))


_SHAPED = f"WITH {MON}, w AS (SELECT *, " + ", ".join(f"{_PROB.format(i=i)} AS w{i}" for i in (1, 2, 3)) + """ FROM mon),
p AS (SELECT codigo_ibge, grupo_desastre, CAST(indice_mes AS INTEGER) AS indice_mes, round(w1 / (w1 + w2 + w3), 4) AS prob_baixo, round(w2 / (w1 + w2 + w3), 4) AS prob_medio, round(w3 / (w1 + w2 + w3), 4) AS prob_alto FROM w),
s AS (SELECT *, CASE WHEN prob_baixo >= prob_medio AND prob_baixo >= prob_alto THEN 'baixo' WHEN prob_medio >= prob_alto THEN 'medio' ELSE 'alto' END AS nivel, greatest(prob_baixo, prob_medio, prob_alto) AS confianca FROM p)"""  # fmt: skip


def _auc(spark, d):
    w = _weights()
    rows = domain.labelled(spark, d).select((F.round(w[0] / (w[0] + w[1]), 4) + (F.col("nivel_risco") == "alto").cast("int") * 0.1).alias("s"), (F.col("nivel_risco") == "alto").alias("e"))
    return _six(metrics.auc(rows, "s", "e"), "auc")


def _clean(spark, d):
    rows = domain.readings(spark, d).withColumn("precipitacao", F.when(F.col("precipitacao") > -9998, F.col("precipitacao")))
    kept = quality.clean(rows.withColumn("uf", F.when(F.col("rajada") > 1, F.col("uf"))), ["precipitacao"], ["uf"], ["estacao", "data"], ["rajada", "temperatura", "umidade", "precipitacao"])
    return kept.groupBy("estacao").agg(F.count("*").alias("n"), F.round(F.sum("precipitacao"), 4).alias("chuva"), F.count_if(F.col("uf") == "ASIA").alias("asia"))


def _gate(spark, d):
    rows = domain.months(spark, d).withColumn("uf", F.when(F.col("mes") != 3, F.col("uf")))
    return quality.gate(rows, ["uf"], [Rule("afetados", 50, 400), Rule("codigo_ibge", 1, 1000)]).groupBy(F.array_join("motivos", "; ").alias("motivos")).agg(F.count("*").alias("n"))


def _windows(spark, d):
    return splits.windows(domain.months(spark, d), 3)


def _by_year(spark, d):
    """Share of hits by group and year, as candidates and windows to choose among."""
    rows = domain.labelled(spark, d)
    return rows.groupBy("ano").agg(F.round(F.avg((F.col("real") == F.col("previsto")).cast("double")), 6).alias("f1_macro"), (F.max("indice_mes") % 5).alias("folha"), F.count("*").alias("n")).withColumn("profundidade", F.col("ano") - 1990)


_BY_YEAR = f"WITH {LAB}, y AS (SELECT ano, round(avg(CASE WHEN real = previsto THEN 1.0 ELSE 0 END), 6) AS f1_macro, CAST(max(indice_mes) % 5 AS INTEGER) AS folha, count(*) AS n, CAST(ano - 1990 AS INTEGER) AS profundidade FROM lab GROUP BY ano)"


def _walk(spark, d):
    rows = _by_year(spark, d).select("ano", F.col("f1_macro").alias("acuracia_balanceada"), (F.col("f1_macro") / 2).alias("f1_macro"), (F.col("f1_macro") / 4).alias("recall_alto"))
    return _six(selection.walk_summary(rows), "media", "desvio", "pior")


def _points(spark, d):
    rows = domain.towns(spark, d).select("codigo_ibge", "uf", (-35 - F.col("codigo_ibge") % 30).cast("double").alias("longitude"), (5 - F.col("codigo_ibge") % 30).cast("double").alias("latitude"))
    return geo.points(rows, ["codigo_ibge", "uf"])


def _mesh(spark, d):
    scored = _scored(spark, d)
    last = scored.groupBy("codigo_ibge").agg(F.max_by(F.struct("nivel", "cor"), F.struct("indice_mes", "grupo_desastre")).alias("v")).select("codigo_ibge", "v.nivel", "v.cor")
    mesh = domain.towns(spark, d).select((F.col("codigo_ibge") + 3).alias("codigo_ibge"), F.lit("{}").alias("geometry"))
    return geo.mesh_with_scores(mesh, last).groupBy("nivel", "cor").agg(F.count("*").alias("n"))


def _design_rows(spark, d):
    m = domain.months(spark, d)
    rows = history.series(m, m.select(*SERIES, "indice_mes", "regiao", "reconhecido", "mortos"))
    level = F.when(F.col("reconhecido") | (F.col("mortos") > 0), "alto").when(F.col("ja_ocorreu") == 0, "baixo").otherwise("medio")
    return rows.withColumn("nivel_risco", level)


NUMBERS = ["ocorrencias_12m", "ocorrencias_mesmo_mes_historico", "anos_de_historico", "prejuizo_historico_log"]


def _design(spark, d):
    rows, names, _ = inference.design(_design_rows(spark, d), NUMBERS)
    return rows.agg(*(F.round(F.sum(F.abs(F.col(f"`{c}`"))), 3).alias(c.replace("-", "_").replace(" ", "_").lower()) for c in names))


_DESIGN = f"WITH {MON}, h AS (" + queries_events._EXACT.replace("round(ln(1 + coalesce(sum(e.prejuizo), 0)), 6)", "ln(1 + coalesce(sum(e.prejuizo), 0))") + "), r AS (SELECT h.*, m.regiao FROM h JOIN mon m USING (codigo_ibge, grupo_desastre, indice_mes)), s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMBERS)) + " FROM r) SELECT " + ", ".join(
    [f"round(sum(abs(({c} - m{i}) / s{i})), 3) AS {c}" for i, c in enumerate(NUMBERS)]
    + [f"CAST(count(*) FILTER ({c} = '{v}') AS DOUBLE) AS " + f"{c}_{v}".replace("-", "_").replace(" ", "_").lower() for c, vs in (("regiao", ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")), ("grupo_desastre", ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))) for v in vs]
) + " FROM r, s"


def _odds(spark, d):
    return inference.export(inference.odds(_design_rows(spark, d), "gravidade", numeric=NUMBERS)["tabela"])


def _equations(spark, d):
    """The full design with a column that only rows of alto have: what a fit must satisfy, and which estimates are none."""
    rows = _design_rows(spark, d).withColumn("alarme", (F.col("reconhecido") & (F.col("indice_mes") % 29 == 0)).cast("double"))
    found = inference.odds(rows, "gravidade", limit=1e9, numeric=[*NUMBERS, "alarme"], proven=True)
    both = found["equacoes"].join(found["tabela"].withColumnRenamed("erro_padrao", "reported"), "variavel")
    same = F.abs(F.col("erro_padrao") / F.col("reported") - 1) < 1e-4
    return both.select("variavel", (F.abs("gradiente") < 1e-6).alias("gradiente_nulo"), (same | ~F.col("confiavel")).alias("erro_confere"), "confiavel")


_EQUATIONS = (
    f"WITH {MON}, v AS (SELECT unnest({[*NUMBERS, 'alarme']}) AS variavel UNION ALL SELECT DISTINCT 'regiao_' || regiao FROM mon WHERE regiao > (SELECT min(regiao) FROM mon) "
    "UNION ALL SELECT DISTINCT 'grupo_desastre_' || grupo_desastre FROM mon WHERE grupo_desastre > (SELECT min(grupo_desastre) FROM mon)) "
    "SELECT variavel, true AS gradiente_nulo, true AS erro_confere, variavel <> 'alarme' AS confiavel FROM v"
)


def _sentences(spark, d):
    found = inference.odds(_design_rows(spark, d), "ocorrencia", numeric=NUMBERS)
    return inference.sentences(found["tabela"], found["desvios_padrao"]).select("variavel", "frase")


def _by_region(spark, d, analysis="gravidade"):
    """The analysis with the region alone: a saturated model, whose estimates are counts' odds."""
    return inference.odds(domain.labelled(spark, d).select("regiao", "nivel_risco"), analysis, numeric=[])


def _region_odds(spark, d):
    rows = _by_region(spark, d)["tabela"]
    return _six(rows, "coeficiente", "erro_padrao", "odds_ratio", "ic95_inferior", "ic95_superior", "p_valor", "forca").select("variavel", "coeficiente", "erro_padrao", "odds_ratio", "ic95_inferior", "ic95_superior", "p_valor", "forca", "significativo", "confiavel")


def _region_top(spark, d):
    return inference.export(_by_region(spark, d)["tabela"], 2).select("variavel", "odds_ratio")


def _region_summary(spark, d):
    found = _by_region(spark, d, "ocorrencia")
    names = ("analise", "n_amostras", "n_eventos", "linhas_incompletas", "taxa_evento", "auc")
    return _six(spark.createDataFrame([tuple(found[n] for n in names)], "analise string, n_amostras long, n_eventos long, linhas_incompletas long, taxa_evento double, auc double"), "taxa_evento", "auc")


def _region_sentences(spark, d):
    found = _by_region(spark, d)
    return inference.sentences(found["tabela"], found["desvios_padrao"]).select("variavel", "frase")


#: Estimates of the saturated model: counts of events and others, by region against the first.
_REGIONS = f"""WITH {LAB}, t AS (SELECT regiao, count(*) FILTER (nivel_risco = 'alto') AS e, count(*) FILTER (nivel_risco <> 'alto') AS o FROM lab GROUP BY regiao),
f AS (SELECT * FROM t ORDER BY regiao LIMIT 1), b AS (SELECT 'regiao_' || t.regiao AS variavel, ln((t.e / t.o) / (f.e / f.o)) AS b, sqrt(1 / t.e + 1 / t.o + 1 / f.e + 1 / f.o) AS s FROM t, f WHERE t.regiao > f.regiao),
i AS (SELECT *, exp(b) AS odds, exp(b - 1.96 * s) AS low, exp(b + 1.96 * s) AS high, abs(b / s) / 2000 AS h FROM b),
p AS (SELECT *, low > 1 OR high < 1 AS clear, greatest(0, 1 - sqrt(2 / pi()) * h / 3 * list_sum(list_transform(range(0, 2001), lambda j: (CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-(j * h) * (j * h) / 2)))) AS p FROM i)"""


def _incomplete(spark, d):
    rows = domain.labelled(spark, d).withColumns({"afetados": F.when(F.col("mes") != 3, F.col("afetados")), "vazia": F.lit(None).cast("double"), "_event": inference.OUTCOMES["ocorrencia"](F.col("nivel_risco")).cast("long")})
    designed, names, _ = inference.design(rows, ["afetados", "vazia"], ("regiao",))
    whole, names, lost = inference.complete(designed, names)
    return whole.agg(F.count("*").alias("linhas"), F.sum("_event").alias("eventos"), F.round(F.sum(F.abs("afetados")), 4).alias("desvios")).withColumns({"perdidas": F.lit(lost).cast("long"), "colunas": F.lit(len(names))})


def _inflation(spark, d):
    """The worst inflated of three columns."""
    _, dropped = inference.without_collinear(domain.labelled(spark, d).select(*(F.col(c).cast("double").alias(c) for c in ("afetados", "mortos", "ano"))), ["afetados", "mortos", "ano"], 0.0)
    return _six(spark.createDataFrame(dropped[:1], "coluna string, inflacao double"), "inflacao")


def _drops(spark, d):
    """How inflated the worst of three columns is, and then the worse of the two that stay."""
    names = ["afetados", "mortos", "ano"]
    _, dropped = inference.without_collinear(domain.labelled(spark, d).select(*(F.col(c).cast("double").alias(c) for c in names)), names, 0.0)
    return _six(spark.createDataFrame([(i + 1, v) for i, (_, v) in enumerate(dropped)], "ordem int, inflacao double"), "inflacao")


#: What a table of orders should have, for the check of columns.
WANTED = ["o_orderkey", "o_custkey", "o_orderdate", "o_region", "o_hazard"]


def _columns(spark, d):
    """Columns that the orders lack or have beside those wanted, and the check of a table without rows."""
    orders = domain.table(spark, d, "orders")
    empty = quality.counters(domain.months(spark, d).where("ano < 0"), RULES)
    return quality.columns(orders, WANTED).unionByName(empty)


_COLUMNS = (
    f"WITH {MON}, c AS (SELECT column_name AS c FROM (DESCRIBE orders)), w AS (SELECT unnest({WANTED}) AS c) SELECT 'colunas' AS \"check\", c AS coluna, 'erro' AS severidade, CAST(1 AS BIGINT) AS n, 'falta' AS detalhe FROM w WHERE c NOT IN (SELECT c FROM c) "
    "UNION ALL SELECT 'colunas', c, 'aviso', 1, 'a mais' FROM c WHERE c NOT IN (SELECT c FROM w) UNION ALL SELECT 'linhas', '', 'erro', 1, 'tabela vazia' WHERE (SELECT count(*) FROM mon WHERE ano < 0) = 0"
)


def _fills(spark, d):
    rows = domain.labelled(spark, d).select(F.when(F.col("mes") != 3, F.col("afetados")).alias("afetados"), F.when(F.col("mes") != 4, F.col("uf")).alias("uf"), "regiao")
    filled = features.Fills(rows, ["afetados"], ["uf"]).apply(rows)
    return filled.groupBy("uf", "regiao").agg(F.count("*").alias("n"), F.round(F.sum("afetados"), 3).alias("afetados"))


def _forest_rows(spark, d):
    return _design_rows(spark, d).withColumns({"ano": F.floor(F.col("indice_mes") / 12).cast("int") + 1900, "mes": F.pmod("indice_mes", F.lit(12)) + 1})


def _forest(spark, d):
    rows = splits.two(_forest_rows(spark, d), 2000)
    model = training.Forest.fit(rows.where("parte = 'treino'"), trees=10, depth=6, categorical=["regiao", "grupo_desastre"], numeric=NUMBERS)
    return scoring.shape(model.transform(rows.where("parte = 'teste'"))).select(*KEY, "nivel", "prob_baixo", "prob_medio", "prob_alto", "previsto")


def _importance(spark, d):
    return training.Forest.fit(_forest_rows(spark, d), trees=10, depth=6, categorical=["regiao", "grupo_desastre"], numeric=NUMBERS).importance()


QUERIES = {
    "v2_v4_counters": (lambda s, d: quality.counters(domain.months(s, d), RULES), _counters_sql()),
    "v5_u3_unknown_categories": (lambda s, d: quality.unknown(domain.months(s, d), DOMAINS), _unknown_sql()),
    "v6_w11_repeated_keys": (
        lambda s, d: quality.repeats(domain.occurrences(s, d)),
        f"WITH {OCC} SELECT * FROM (SELECT 'repetidas' AS \"check\", 'codigo_ibge,ano,mes,grupo_desastre' AS coluna, 'aviso' AS severidade, CAST(count(*) - count(DISTINCT (codigo_ibge, ano, mes, grupo_desastre)) AS BIGINT) AS n, '' AS detalhe FROM occ) WHERE n > 0",
    ),
    "v7_target": (
        lambda s, d: quality.target(domain.labelled(s, d).withColumn("nivel_risco", F.when(F.col("mes") == 1, None).when(F.col("mes") == 2, "altissimo").when(F.col("nivel_risco") != "alto", F.col("nivel_risco")))),
        f"WITH {LAB}, t AS (SELECT CASE WHEN mes = 1 THEN NULL WHEN mes = 2 THEN 'altissimo' WHEN nivel_risco <> 'alto' THEN nivel_risco END AS v FROM lab), n AS (SELECT count(*) FILTER (v = 'baixo') AS b, count(*) FILTER (v = 'medio') AS m FROM t) "
        "SELECT * FROM (SELECT 'alvo_nulo' AS \"check\", 'nivel_risco' AS coluna, 'erro' AS severidade, count(*) FILTER (v IS NULL) AS n, '' AS detalhe FROM t UNION ALL SELECT 'alvo_invalido', 'nivel_risco', 'erro', count(*) FILTER (v = 'altissimo'), '' FROM t "
        "UNION ALL SELECT 'classe_ausente', 'nivel_risco', 'erro', 1, 'alto' UNION ALL SELECT 'desequilibrio', 'nivel_risco', 'aviso', CASE WHEN greatest(b, m) > 20 * least(b, m) THEN CAST(floor(greatest(b, m) / least(b, m)) AS BIGINT) ELSE 0 END, '' FROM n) WHERE n > 0",
    ),
    "v8_cleaning": (
        _clean,
        f"WITH {RDG.replace('CAST(l_shipdate AS DATE) AS dia', 'l_shipdate AS dia')}, a AS (SELECT *, CASE WHEN rajada > 1 THEN uf END AS u FROM rdg), m AS (SELECT (SELECT median(precipitacao) FROM a) AS p, (SELECT u FROM a WHERE u IS NOT NULL GROUP BY u ORDER BY count(*) DESC, u LIMIT 1) AS u), "
        "b AS (SELECT estacao, dia, coalesce(precipitacao, m.p) AS p, coalesce(a.u, m.u) AS u, row_number() OVER (PARTITION BY estacao, dia ORDER BY rajada, temperatura, umidade, coalesce(precipitacao, m.p)) AS n FROM a, m) "
        "SELECT estacao, count(*) AS n, round(sum(p), 4) AS chuva, count(*) FILTER (u = 'ASIA') AS asia FROM b WHERE n = 1 GROUP BY estacao",
    ),
    "v9_request_gate": (
        _gate,
        f"WITH {MON} SELECT concat_ws('; ', CASE WHEN mes = 3 THEN 'falta uf' END, CASE WHEN afetados < 50 OR afetados > 400 THEN 'afetados fora da faixa' END, CASE WHEN codigo_ibge < 1 OR codigo_ibge > 1000 THEN 'codigo_ibge fora da faixa' END) AS motivos, count(*) AS n FROM mon GROUP BY 1",
    ),
    "t3_stratified_split": (
        _split,
        f"WITH {LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY nivel_risco ORDER BY md5(concat_ws('|', '42', codigo_ibge, grupo_desastre, indice_mes)), codigo_ibge, grupo_desastre, indice_mes) AS n, count(*) OVER (PARTITION BY nivel_risco) AS k FROM lab) "
        "SELECT codigo_ibge, grupo_desastre, CAST(indice_mes AS INTEGER) AS indice_mes, nivel_risco, CASE WHEN n <= round(k * 0.3) THEN 'teste' ELSE 'treino' END AS parte FROM r",
    ),
    "m3_three_way_split": (
        lambda s, d: splits.three(domain.months(s, d), 1999, 2000).groupBy("parte", "ano").agg(F.count("*").alias("n")),
        f"WITH {MON} SELECT CASE WHEN ano < 1999 THEN 'treino' WHEN ano < 2000 THEN 'validacao' ELSE 'teste' END AS parte, ano, count(*) AS n FROM mon GROUP BY ALL",
    ),
    "m4_two_way_split": (
        lambda s, d: splits.two(domain.months(s, d), 2000).groupBy("parte").agg(F.count("*").alias("n")),
        f"WITH {MON} SELECT CASE WHEN ano < 2000 THEN 'treino' ELSE 'teste' END AS parte, count(*) AS n FROM mon GROUP BY 1",
    ),
    "m5_windows": (_windows, f"WITH {MON}, y AS (SELECT ano, row_number() OVER (ORDER BY ano) AS n, lag(ano) OVER (ORDER BY ano) AS p FROM (SELECT DISTINCT ano FROM mon)) SELECT p AS treino_ate, ano AS ano_teste FROM y WHERE n > 3"),
    "m6_walk_summary": (
        _walk,
        _BY_YEAR + ", l AS (SELECT 'acuracia_balanceada' AS medida, f1_macro AS v FROM y UNION ALL SELECT 'f1_macro', f1_macro / 2 FROM y UNION ALL SELECT 'recall_alto', f1_macro / 4 FROM y) SELECT medida, round(avg(v), 6) AS media, round(stddev_samp(v), 6) AS desvio, round(min(v), 6) AS pior FROM l GROUP BY medida",
    ),
    "m7_parsimonious_choice": (lambda s, d: selection.parsimonious(_by_year(s, d), 0.05), _BY_YEAR + " SELECT * FROM y WHERE f1_macro >= (SELECT max(f1_macro) FROM y) - 0.05 ORDER BY profundidade, -folha LIMIT 1"),
    "m8_measures_by_class": (lambda s, d: _six(metrics.by_class(_counts(s, d)), "precisao", "recall", "f1"), _EACH + " SELECT classe, round(precisao, 6) AS precisao, round(recall, 6) AS recall, round(f1, 6) AS f1, suporte FROM g"),
    "m8_measures_summary": (
        lambda s, d: _six(metrics.summary(_counts(s, d)), "acuracia_balanceada", "f1_macro", "precisao_macro", "recall_macro", "f1_ponderado", "precisao_ponderada", "acuracia", "recall_alto"),
        _EACH + " SELECT round(avg(recall) FILTER (suporte > 0), 6) AS acuracia_balanceada, round(avg(f1), 6) AS f1_macro, round(avg(precisao), 6) AS precisao_macro, round(avg(recall), 6) AS recall_macro, round(sum(f1 * suporte) / sum(suporte), 6) AS f1_ponderado, "
        "round(sum(precisao * suporte) / sum(suporte), 6) AS precisao_ponderada, round(sum(recall * suporte) / sum(suporte), 6) AS acuracia, round(coalesce(max(recall) FILTER (classe = 'alto'), 0), 6) AS recall_alto, "
        "CAST((SELECT coalesce(sum(n), 0) FROM c WHERE real = 'alto' AND previsto = 'baixo') AS BIGINT) AS alto_como_baixo, CAST(sum(suporte) AS BIGINT) AS linhas FROM g",
    ),
    "m8_confusion_matrix": (
        lambda s, d: metrics.matrix(_counts(s, d)),
        f"WITH {LAB} SELECT CAST(o AS INTEGER) AS ordem, k.real, count(*) FILTER (l.previsto = 'baixo') AS baixo, count(*) FILTER (l.previsto = 'medio') AS medio, count(*) FILTER (l.previsto = 'alto') AS alto FROM (VALUES (0, 'baixo'), (1, 'medio'), (2, 'alto')) k(o, real) LEFT JOIN lab l ON l.real = k.real GROUP BY o, k.real",
    ),
    "m9_diagnosis": (
        lambda s, d: metrics.diagnose(_by_year(s, d).select("ano", F.col("f1_macro").alias("treino"), (F.col("f1_macro") * (F.col("ano") % 4) / 4).alias("teste"))).select("ano", "diagnostico"),
        _BY_YEAR + " SELECT ano, CASE WHEN f1_macro - f1_macro * (ano % 4) / 4 > 0.15 THEN 'overfitting' WHEN f1_macro * (ano % 4) / 4 < 0.40 THEN 'underfitting' ELSE 'equilibrado' END AS diagnostico FROM y",
    ),
    "a14_level_summary": (
        lambda s, d: metrics.levels(_scored(s, d), ["grupo_desastre"], "nivel"),
        _SHAPED + " SELECT grupo_desastre, count(*) FILTER (nivel = 'baixo') AS baixo, count(*) FILTER (nivel = 'medio') AS medio, count(*) FILTER (nivel = 'alto') AS alto FROM s GROUP BY grupo_desastre",
    ),
    "a15_positive_rate": (
        lambda s, d: _six(directory.positive_rate(domain.labelled(s, d)), "taxa"),
        f"WITH {LAB} SELECT codigo_ibge, grupo_desastre, round(avg(CASE WHEN nivel_risco <> 'baixo' THEN 1.0 ELSE 0 END), 6) AS taxa FROM lab GROUP BY ALL",
    ),
    "a16_majority_share": (lambda s, d: _six(metrics.majority(domain.labelled(s, d)), "fracao_maioria"), f"WITH {LAB} SELECT round(max(n) / sum(n), 6) AS fracao_maioria FROM (SELECT count(*) AS n FROM lab GROUP BY nivel_risco)"),
    "p9_risk_levels": (
        lambda s, d: domain.months(s, d).groupBy(monthly.risk(F.col("reconhecido"), F.col("mortos"), F.col("afetados") >= 150).alias("nivel")).agg(F.count("*").alias("n")),
        f"WITH {MON} SELECT CASE WHEN afetados < 150 THEN 'baixo' WHEN reconhecido OR mortos > 0 THEN 'alto' ELSE 'medio' END AS nivel, count(*) AS n FROM mon GROUP BY 1",
    ),
    "p21_shaped_scores": (
        lambda s, d: _scored(s, d).select(*KEY, "prob_baixo", "prob_medio", "prob_alto", "nivel", "confianca", "cor"),
        _SHAPED + " SELECT *, CASE nivel WHEN 'baixo' THEN '#2E7D32' WHEN 'medio' THEN '#F9A825' ELSE '#C62828' END AS cor FROM s",
    ),
    "o9_auc": (
        _auc,
        f"WITH {LAB}, w AS (SELECT {_PROB.format(i=1)} AS a, {_PROB.format(i=2)} AS b, nivel_risco = 'alto' AS e FROM lab), r AS (SELECT e, round(a / (a + b), 4) + CAST(e AS INTEGER) * 0.1 AS s FROM w), "
        "k AS (SELECT e, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS m FROM r), n AS (SELECT count(*) FILTER (e) AS p, count(*) FILTER (NOT e) AS q FROM k) "
        "SELECT round(((SELECT sum(m) FROM k WHERE e) - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM n",
    ),
    "s10_geojson_points": (
        _points,
        """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (-35 - c_custkey % 30) || '.0,' || (5 - c_custkey % 30) || '.0]},"properties":{"codigo_ibge":' || c_custkey || ',"uf":"' || r_name || '"}}' AS value
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "j11_mesh_scores": (
        _mesh,
        _SHAPED + ", l AS (SELECT codigo_ibge, max_by(nivel, printf('%06d', indice_mes) || grupo_desastre) AS nivel FROM s GROUP BY ALL), j AS (SELECT coalesce(l.nivel, 'sem-dado') AS nivel FROM customer c LEFT JOIN l ON l.codigo_ibge = c.c_custkey + 3) "
        "SELECT nivel, CASE nivel WHEN 'baixo' THEN '#2E7D32' WHEN 'medio' THEN '#F9A825' WHEN 'alto' THEN '#C62828' ELSE '#BDBDBD' END AS cor, count(*) AS n FROM j GROUP BY nivel",
    ),
    "o1_design_matrix": (_design, _DESIGN),
    "o2_o3_complete_cases": (
        _incomplete,
        f"WITH {LAB}, k AS (SELECT *, CASE WHEN mes <> 3 THEN afetados END AS a FROM lab), m AS (SELECT avg(a) AS m, stddev_pop(a) AS s FROM k) SELECT count(a) AS linhas, CAST(count(*) FILTER (a IS NOT NULL AND nivel_risco <> 'baixo') AS BIGINT) AS eventos, round(sum(abs((a - m.m) / m.s)), 4) AS desvios, "
        "count(*) - count(a) AS perdidas, CAST(count(DISTINCT regiao) AS INTEGER) AS colunas FROM k, m",
    ),
    "o4_o5_worst_inflation": (
        _inflation,
        f"WITH {LAB}, r AS (SELECT corr(afetados, mortos) AS am, corr(afetados, ano) AS ay, corr(mortos, ano) AS my FROM lab), d AS (SELECT *, 1 + 2 * am * ay * my - am * am - ay * ay - my * my AS det FROM r), "
        "v AS (SELECT 'afetados' AS coluna, (1 - my * my) / det AS v FROM d UNION ALL SELECT 'mortos', (1 - ay * ay) / det FROM d UNION ALL SELECT 'ano', (1 - am * am) / det FROM d) SELECT coluna, round(v, 6) AS inflacao FROM v ORDER BY v DESC LIMIT 1",
    ),
    "o5_inflation_of_drops": (
        _drops,
        f"WITH {LAB}, r AS (SELECT corr(afetados, mortos) AS am, corr(afetados, ano) AS ay, corr(mortos, ano) AS my FROM lab), d AS (SELECT *, 1 + 2 * am * ay * my - am * am - ay * ay - my * my AS det FROM r), "
        "v AS (SELECT (1 - my * my) / det AS v, my AS rest FROM d UNION ALL SELECT (1 - ay * ay) / det, ay FROM d UNION ALL SELECT (1 - am * am) / det, am FROM d), w AS (SELECT * FROM v ORDER BY v DESC LIMIT 1) "
        "SELECT 1 AS ordem, round(v, 6) AS inflacao FROM w UNION ALL SELECT 2, round(1 / (1 - rest * rest), 6) FROM w",
    ),
    "v1_columns": (_columns, _COLUMNS),
    "o6_o8_region_odds": (
        _region_odds,
        _REGIONS + " SELECT variavel, round(b, 6) AS coeficiente, round(s, 6) AS erro_padrao, round(odds, 6) AS odds_ratio, round(low, 6) AS ic95_inferior, round(high, 6) AS ic95_superior, round(p, 6) AS p_valor, round(abs(b), 6) AS forca, clear AS significativo, true AS confiavel FROM p",
    ),
    "t5_strongest_region": (_region_top, _REGIONS + " SELECT variavel, round(odds, 4) AS odds_ratio FROM p ORDER BY abs(b) DESC, variavel LIMIT 2"),
    "o10_region_summary": (
        _region_summary,
        f"WITH {LAB}, t AS (SELECT regiao, count(*) FILTER (nivel_risco <> 'baixo') AS e, count(*) FILTER (nivel_risco = 'baixo') AS o FROM lab GROUP BY regiao), n AS (SELECT sum(e) AS e, sum(o) AS o FROM t), "
        "a AS (SELECT sum(x.e * y.o * CASE WHEN x.e / (x.e + x.o) > y.e / (y.e + y.o) THEN 1.0 WHEN x.regiao = y.regiao THEN 0.5 ELSE 0 END) AS wins FROM t x, t y) "
        "SELECT 'ocorrencia' AS analise, CAST(e + o AS BIGINT) AS n_amostras, CAST(e AS BIGINT) AS n_eventos, CAST(0 AS BIGINT) AS linhas_incompletas, round(e / (e + o), 6) AS taxa_evento, round(wins / (e * o), 6) AS auc FROM n, a",
    ),
    "o10_region_sentences": (
        _region_sentences,
        _REGIONS + " SELECT variavel, CASE WHEN NOT clear THEN printf('%s: sem efeito claro, p de %.3f', variavel, p) WHEN odds >= 1 THEN printf('%s: chance %.2f vezes maior, frente ao nível de base', variavel, odds) "
        "ELSE printf('%s: chance %.0f%% menor (razão %.2f), frente ao nível de base', variavel, (1 - odds) * 100, odds) END AS frase FROM p",
    ),
    "m1_fills": (
        _fills,
        f"WITH {LAB}, k AS (SELECT CASE WHEN mes <> 3 THEN afetados END AS a, CASE WHEN mes <> 4 THEN uf END AS u, regiao FROM lab), m AS (SELECT (SELECT median(a) FROM k) AS a, (SELECT u FROM k WHERE u IS NOT NULL GROUP BY u ORDER BY count(*) DESC, u LIMIT 1) AS u) "
        "SELECT coalesce(k.u, m.u) AS uf, regiao, count(*) AS n, round(sum(coalesce(k.a, m.a)), 3) AS afetados FROM k, m GROUP BY ALL",
    ),
    "o6_o7_score_equations": (_equations, _EQUATIONS),
    "o2_o8_odds_ratios": (_odds, None),
    "o10_sentences": (_sentences, None),
    "m2_m13_forest_scores": (_forest, None),
    "m12_importance": (_importance, None),
}
