"""Queries over occurrences: cleaning, months, history, sampling, directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.functions.months import month_index, month_of, previous_month, year_of
from hazardspark.functions.text import normalise, title_case
from hazardspark.operators import directory, features, history, monthly, scoring
from hazardspark.plans import domain
from hazardspark.plans.domain import FIRST, LAST, MON, OCC
from hazardspark.sources import events

SERIES = ["codigo_ibge", "grupo_desastre"]
#: Signs of one letter, of several, with marks and of other scripts, and what they are once normalised.
SIGNS = {"№ 5": "no 5", "™": "tm", "㎞²": "km2", "Ⅻ": "xii", "⑫": "12", "½ x": "1 2 x", "ά": "α", "が": "か", "Ａｂ": "ab", "ﬁm º": "fim o", "c\u0327a\u0303o": "cao"}


def _six(rows, *names):
    return rows.withColumns({n: F.round(n, 6) for n in names})


def register(spark, d):
    """Orders written the way the register writes them, with its faults."""
    rows = domain.table(spark, d, "orders")
    k = F.col("o_orderkey")
    kinds = F.create_map(*[F.lit(x) for x in ("1-URGENT", "Inundações", "2-HIGH", "Tornado", "3-MEDIUM", "Outros", "4-NOT SPECIFIED", "Erosão", "5-LOW", "Granizo")])
    return rows.select(
        F.concat(F.lit("Cidade "), F.col("o_custkey").cast("string")).alias("Nome_Municipio"), F.lit(" sp ").alias("Sigla_UF"), F.when(k % 2 == 0, "CENTRO-OESTE").otherwise(" sul").alias("regiao"),
        F.when(k % 11 == 0, "31/02/2000").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Data_Evento"), kinds[F.col("o_orderpriority")].alias("descricao_tipologia"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(",0"))).alias("Cod_IBGE_Mun"), F.when(F.col("o_orderstatus") == "F", "Reconhecido").when(F.col("o_orderstatus") == "O", "Registro").alias("Status"),
        F.when(k % 5 == 0, "").otherwise((k % 7 - 2).cast("string")).alias("DH_MORTOS"), (k % 100).cast("string").alias("DH_total_danos_humanos_diretos"), F.concat((k % 1000).cast("string"), F.lit(",5")).alias("PE_PLePR"),
    )


def _history(spark, d):
    m = domain.months(spark, d)
    return _six(history.series(m, m.select(*SERIES, "indice_mes")), "anos_de_historico", "prejuizo_historico_log")


_HIST = """SELECT {t}.codigo_ibge, {t}.grupo_desastre, {t}.indice_mes{more},
  count(e.mes) FILTER (e.indice_mes >= {t}.indice_mes - 12) AS ocorrencias_12m, count(e.mes) FILTER (e.indice_mes >= {t}.indice_mes - 24) AS ocorrencias_24m,
  count(e.mes) FILTER (e.indice_mes >= {t}.indice_mes - 60) AS ocorrencias_60m, count(e.mes) AS ocorrencias_total_historico,
  CAST(coalesce({t}.indice_mes - max(e.indice_mes), -1) AS INTEGER) AS meses_desde_ultima_ocorrencia, CAST(count(e.mes) > 0 AS INTEGER) AS ja_ocorreu,
  round(coalesce(({t}.indice_mes - min(e.indice_mes)) / 12.0, 0), 6) AS anos_de_historico, count(e.mes) FILTER (e.mes = {t}.indice_mes % 12 + 1) AS ocorrencias_mesmo_mes_historico,
  coalesce(sum(e.mortos), 0.0) AS mortos_historico, coalesce(sum(e.afetados), 0.0) AS afetados_historico, CAST(coalesce(sum(CAST(e.reconhecido AS INTEGER)), 0) AS DOUBLE) AS reconhecimentos_historico,
  round(ln(1 + coalesce(sum(e.prejuizo), 0)), 6) AS prejuizo_historico_log
FROM {t} LEFT JOIN mon e ON e.codigo_ibge = {t}.codigo_ibge AND e.grupo_desastre = {t}.grupo_desastre AND e.indice_mes < {t}.indice_mes GROUP BY {t}.codigo_ibge, {t}.grupo_desastre, {t}.indice_mes{more}"""


def _context(spark, d):
    m = domain.months(spark, d)
    return history.context(m, m.select(*SERIES, "indice_mes"))


_UFS = ", ufs AS (SELECT codigo_ibge, min_by(uf, grupo_desastre || printf('%05d%02d', ano, mes)) AS fuf FROM mon GROUP BY ALL)"
_CONTEXT = """town AS (SELECT codigo_ibge, indice_mes, count(*) AS n FROM mon GROUP BY ALL),
state AS (SELECT fuf, grupo_desastre, indice_mes, count(*) AS n FROM mon JOIN ufs USING (codigo_ibge) GROUP BY ALL)"""
_COUNTS = """CAST(coalesce((SELECT sum(n) FROM town w WHERE w.codigo_ibge = {t}.codigo_ibge AND w.indice_mes BETWEEN {t}.indice_mes - 12 AND {t}.indice_mes - 1), 0) AS BIGINT) AS ocorrencias_municipio_12m,
  CAST(coalesce((SELECT sum(n) FROM state s WHERE s.fuf = u.fuf AND s.grupo_desastre = {t}.grupo_desastre AND s.indice_mes BETWEEN {t}.indice_mes - 12 AND {t}.indice_mes - 1), 0) AS BIGINT) AS ocorrencias_uf_grupo_12m"""
_FREE = f""", inside AS (SELECT * FROM mon WHERE ano BETWEEN {FIRST} AND {LAST}),
free AS (SELECT p.codigo_ibge, p.grupo_desastre, CAST(i AS INTEGER) AS indice_mes FROM (SELECT DISTINCT codigo_ibge, grupo_desastre FROM inside) p, range({(FIRST - 1900) * 12}, {(LAST - 1900) * 12 + 12}) r(i)
  WHERE NOT EXISTS (SELECT 1 FROM inside o WHERE o.codigo_ibge = p.codigo_ibge AND o.grupo_desastre = p.grupo_desastre AND o.indice_mes = i))"""
_SAMPLE = """, picked AS (SELECT * FROM free ORDER BY md5(concat_ws('|', '42', codigo_ibge, grupo_desastre, indice_mes)), codigo_ibge, grupo_desastre, indice_mes LIMIT (SELECT 3 * count(*) FROM inside))"""
_LATEST = "SELECT codigo_ibge, max_by(municipio, k) AS municipio, max_by(uf, k) AS uf, max_by(regiao, k) AS regiao FROM (SELECT *, printf('%06d', indice_mes) || grupo_desastre AS k FROM mon) GROUP BY codigo_ibge"


def _sample(spark, d):
    m = domain.months(spark, d)
    n = m.where(F.col("ano").between(FIRST, LAST)).count()
    return monthly.sample(monthly.free_months(m, FIRST, LAST), 3 * n, 42, [*SERIES, "indice_mes"])


def _dataset(spark, d):
    return _six(monthly.build(domain.occurrences(spark, d), FIRST, LAST), "anos_de_historico", "prejuizo_historico_log")


_DATASET = f"WITH {MON}{_UFS}{_FREE}{_SAMPLE}, {_CONTEXT}, latest AS ({_LATEST}), " + """
tgt AS (SELECT codigo_ibge, grupo_desastre, indice_mes, CASE WHEN reconhecido OR mortos > 0 THEN 'alto' ELSE 'medio' END AS nivel_risco FROM inside UNION ALL SELECT *, 'baixo' FROM picked),
h AS (""" + _HIST.format(t="tgt", more=", tgt.nivel_risco") + """)
SELECT h.*, """ + _COUNTS.format(t="h") + """, l.municipio, l.uf, l.regiao, CAST(1900 + h.indice_mes // 12 AS INTEGER) AS ano, CAST(h.indice_mes % 12 + 1 AS INTEGER) AS mes
FROM h JOIN ufs u USING (codigo_ibge) JOIN latest l USING (codigo_ibge)"""  # fmt: skip


def _derived(spark, d):
    rows = history.series(m := domain.months(spark, d), m.select(*SERIES, "indice_mes")).withColumn("mes", month_of(F.col("indice_mes")))
    rows = features.bands(features.derive(rows))
    names = ["mes_seno", "mes_cosseno", "ocorrencias_por_ano", "proporcao_reconhecidas", "gravidade_media_historica"]
    rows = rows.withColumns({n: F.round(n, 6) + 0.0 for n in names})  # no negative zero
    return rows.select(*SERIES, "indice_mes", *names, *features.BANDS)


_EXACT = _HIST.format(t="mon", more="").replace("round(coalesce((mon.indice_mes - min(e.indice_mes)) / 12.0, 0), 6)", "coalesce((mon.indice_mes - min(e.indice_mes)) / 12.0, 0)")
_DERIVED = f"WITH {MON}, h AS (" + _EXACT + """)
SELECT codigo_ibge, grupo_desastre, indice_mes, round(sin(2 * pi() * (indice_mes % 12 + 1) / 12), 6) + 0.0 AS mes_seno, round(cos(2 * pi() * (indice_mes % 12 + 1) / 12), 6) + 0.0 AS mes_cosseno,
  round(ocorrencias_total_historico / greatest(anos_de_historico, 1), 6) AS ocorrencias_por_ano,
  round(coalesce(least(greatest(reconhecimentos_historico / nullif(ocorrencias_total_historico, 0), 0), 1), 0), 6) AS proporcao_reconhecidas,
  round(coalesce(afetados_historico / nullif(ocorrencias_total_historico, 0), 0), 6) AS gravidade_media_historica,
  CAST(greatest(ocorrencias_24m - ocorrencias_12m, 0) AS DOUBLE) AS ocorrencias_13_a_24m, CAST(greatest(ocorrencias_60m - ocorrencias_24m, 0) AS DOUBLE) AS ocorrencias_25_a_60m FROM h"""  # fmt: skip


def _asked(spark, d):
    """Every municipality and group with a history, asked for January and July 2002."""
    occ = domain.occurrences(spark, d)
    months = spark.createDataFrame([(2002, 1), (2002, 7)], "ano int, mes int")
    rows = scoring.requested(occ, scoring.country(occ, months))
    return rows.select(*SERIES, "ano", "mes", "ocorrencias_12m", "ocorrencias_total_historico", "meses_desde_ultima_ocorrencia", "ocorrencias_municipio_12m", "ocorrencias_uf_grupo_12m")


_ASKED = f"WITH {MON}{_UFS}, {_CONTEXT}, " + """tgt AS (SELECT DISTINCT m.codigo_ibge, m.grupo_desastre, 2002 AS ano, x.mes, CAST(102 * 12 + x.mes - 1 AS INTEGER) AS indice_mes FROM mon m, (VALUES (1), (7)) x(mes)),
h AS (""" + _HIST.format(t="tgt", more=", tgt.ano, tgt.mes") + """)
SELECT h.codigo_ibge, h.grupo_desastre, h.ano, h.mes, ocorrencias_12m, ocorrencias_total_historico, meses_desde_ultima_ocorrencia, """ + _COUNTS.format(t="h") + " FROM h JOIN ufs u USING (codigo_ibge)"  # fmt: skip

QUERIES = {
    "p1_p7_clean_register": (
        lambda s, d: events.clean(register(s, d)),
        """WITH r AS (SELECT *, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'INUNDACAO' WHEN '2-HIGH' THEN 'VENDAVAL_CICLONE' WHEN '4-NOT SPECIFIED' THEN 'EROSAO' WHEN '5-LOW' THEN 'GRANIZO' END AS g FROM orders)
        SELECT o_custkey AS codigo_ibge, 'Cidade ' || o_custkey AS municipio, 'SP' AS uf, CASE WHEN k % 2 = 0 THEN 'Centro-Oeste' ELSE 'Sul' END AS regiao, CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes,
          g AS grupo_desastre, o_orderstatus = 'F' AS reconhecido, CASE WHEN k % 5 = 0 THEN 0.0 ELSE CAST(greatest(k % 7 - 2, 0) AS DOUBLE) END AS mortos, CAST(k % 100 AS DOUBLE) AS afetados, k % 1000 + 0.5 AS prejuizo
        FROM r WHERE g IS NOT NULL AND k % 11 <> 0 AND k % 13 <> 0""",
    ),
    "p4_title_case": (
        lambda s, d: domain.table(s, d, "part").select("p_partkey", title_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("nome")),
        "SELECT p_partkey, array_to_string(list_transform(string_split(lower(trim(replace(p_name, ' ', '-'))), '-'), lambda w: upper(w[1]) || w[2:]), '-') AS nome FROM part",
    ),
    "p8_p19_months": (
        lambda s, d: domain.occurrences(s, d).withColumn("i", month_index(F.col("ano"), F.col("mes"))).select("codigo_ibge", "i", year_of(F.col("i")).alias("ano"), month_of(F.col("i")).alias("mes"), previous_month(F.col("mes")).alias("anterior")),
        f"WITH {OCC} SELECT codigo_ibge, CAST((ano - 1900) * 12 + mes - 1 AS INTEGER) AS i, ano, mes, CAST(CASE mes WHEN 1 THEN 12 ELSE mes - 1 END AS INTEGER) AS anterior FROM occ",
    ),
    "p14_normalise_text": (
        lambda s, d: domain.table(s, d, "documents").select("doc_id", F.md5(normalise(F.col("text"))).alias("texto")),
        "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS texto FROM documents",
    ),
    "a1_monthly_occurrences": (
        lambda s, d: domain.months(s, d).withColumn("prejuizo", F.round("prejuizo", 2)),
        f"WITH {MON} SELECT * REPLACE (round(prejuizo, 2) AS prejuizo, CAST(indice_mes AS INTEGER) AS indice_mes) FROM mon",
    ),
    "a2_identity": (lambda s, d: monthly.identity(domain.months(s, d)), f"WITH {MON} {_LATEST}"),
    "a3_context_counts": (
        lambda s, d: domain.months(s, d).join(history.states(domain.months(s, d)), "codigo_ibge").groupBy(F.col("_uf").alias("estado"), "grupo_desastre", "indice_mes").agg(F.count("*").alias("n")),
        f"WITH {MON}{_UFS} SELECT fuf AS estado, grupo_desastre, CAST(indice_mes AS INTEGER) AS indice_mes, count(*) AS n FROM mon JOIN ufs USING (codigo_ibge) GROUP BY ALL",
    ),
    "w1_w6_history_features": (_history, f"WITH {MON} " + _HIST.format(t="mon", more="").replace("mon.indice_mes,", "CAST(mon.indice_mes AS INTEGER) AS indice_mes,", 1)),
    "w7_w8_context_features": (_context, f"WITH {MON}{_UFS}, {_CONTEXT} SELECT m.codigo_ibge, m.grupo_desastre, CAST(m.indice_mes AS INTEGER) AS indice_mes, {_COUNTS.format(t='m')} FROM mon m JOIN ufs u USING (codigo_ibge)"),
    "u2_free_months": (lambda s, d: monthly.free_months(domain.months(s, d), FIRST, LAST), f"WITH {MON}{_FREE} SELECT * FROM free"),
    "t2_negative_sample": (_sample, f"WITH {MON}{_FREE}{_SAMPLE} SELECT * FROM picked"),
    "w_a_dataset": (_dataset, _DATASET),
    "p11_p13_derived": (_derived, _DERIVED),
    "m14_m15_requested_features": (_asked, _ASKED),
    "w13_season_requests": (
        lambda s, d: scoring.season(domain.occurrences(s, d).select("codigo_ibge", "grupo_desastre").distinct(), 2002),
        f"WITH {OCC} SELECT DISTINCT codigo_ibge, grupo_desastre, 2002 AS ano, CAST(m AS INTEGER) AS mes FROM occ, range(1, 13) r(m)",
    ),
    "a12_municipalities": (
        lambda s, d: directory.municipalities(domain.occurrences(s, d)),
        f"WITH {OCC} SELECT codigo_ibge, min(municipio) AS municipio, min(uf) AS uf, min(regiao) AS regiao, count(*) AS ocorrencias FROM occ GROUP BY codigo_ibge",
    ),
    "a13_history_by_type": (
        lambda s, d: directory.past(domain.occurrences(s, d)),
        f"WITH {OCC}, g AS (SELECT codigo_ibge, grupo_desastre, count(*) AS ocorrencias, sum(mortos) AS mortos, sum(afetados) AS afetados, max(ano) AS ultimo_ano FROM occ GROUP BY ALL) "
        "SELECT *, CAST(row_number() OVER (PARTITION BY codigo_ibge ORDER BY ocorrencias DESC, grupo_desastre) AS INTEGER) AS posicao FROM g",
    ),
    "a13_history_totals": (lambda s, d: directory.totals(domain.occurrences(s, d)), f"WITH {OCC} SELECT codigo_ibge, count(*) AS total, min(ano) AS primeiro_ano, max(ano) AS ultimo_ano FROM occ GROUP BY codigo_ibge"),
    "t4_search": (
        lambda s, d: directory.search(directory.municipalities(domain.occurrences(s, d)), "R#00000001", None, 50)[0],
        f"WITH {OCC}, a AS (SELECT codigo_ibge, min(municipio) AS municipio, min(uf) AS uf, min(regiao) AS regiao, count(*) AS ocorrencias FROM occ GROUP BY codigo_ibge) "
        "SELECT * FROM a WHERE contains(lower(municipio), 'r#00000001') ORDER BY uf, municipio, codigo_ibge LIMIT 50",
    ),
    "t4_search_total": (
        lambda s, d: directory.search(directory.municipalities(domain.occurrences(s, d)), "r#0000000", "asia", 1)[1],
        f"WITH {OCC}, a AS (SELECT codigo_ibge, min(municipio) AS municipio, min(uf) AS uf FROM occ GROUP BY codigo_ibge) SELECT count(*) AS total FROM a WHERE contains(lower(municipio), 'r#0000000') AND uf = 'ASIA'",
    ),
    "p14_compatible_signs": (
        lambda s, d: domain.table(s, d, "documents").select("doc_id", normalise(F.concat("source", F.element_at(F.lit(list(SIGNS)), F.pmod("doc_id", F.lit(len(SIGNS))).cast("int") + 1))).alias("texto")),
        f"SELECT doc_id, source || {list(SIGNS.values())}[doc_id % {len(SIGNS)} + 1] AS texto FROM documents",
    ),
    "a11_profile": (
        lambda s, d: directory.profile(domain.months(s, d)),
        f"WITH {MON} SELECT count(*) AS linhas, min(ano) AS ano_inicial, max(ano) AS ano_final, count(DISTINCT codigo_ibge) AS municipios, count(DISTINCT uf) AS ufs FROM mon",
    ),
    "a11_group_shares": (
        lambda s, d: directory.shares(domain.months(s, d), "grupo_desastre"),
        f"WITH {MON} SELECT grupo_desastre, count(*) AS n, round(count(*) / (SELECT count(*) FROM mon), 6) AS fracao FROM mon GROUP BY grupo_desastre",
    ),
}
