"""The given tables read as the library's own: in Spark, and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.functions.storage import written
from hazardspark.functions.text import normalise
from hazardspark.operators import climate, features, history, matching, monthly

FIRST, LAST = 1998, 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return table(spark, d, "customer").join(nation, "c_nationkey").join(table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Orders as occurrences in their customer's place."""
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(places(spark, d), "c_custkey")
    return rows.select(
        F.col("c_custkey").alias("codigo_ibge"), F.col("c_name").alias("municipio"), F.col("n_name").alias("uf"), F.col("r_name").alias("regiao"), F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes"),
        F.col("o_orderpriority").alias("grupo_desastre"), (F.col("o_orderstatus") == "F").alias("reconhecido"), (F.col("o_totalprice") > 480000).cast("double").alias("mortos"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("afetados"), F.col("o_totalprice").alias("prejuizo"),
    )


def months(spark: SparkSession, d: str) -> DataFrame:
    return monthly.by_month(occurrences(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Months with a level (mild damage counts as baixo) and a stand-in prediction by hash."""
    rows = months(spark, d)
    level = F.when(F.col("reconhecido") | (F.col("mortos") > 0), "alto").when(F.col("afetados") < 150, "baixo").otherwise("medio")
    rows = rows.withColumn("nivel_risco", level)
    digit = F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("codigo_ibge", "grupo_desastre", "indice_mes")))), 1, 1)
    said = F.when(digit < "2", "baixo").when(digit < "4", "medio").when(digit < "6", "alto").otherwise(F.col("nivel_risco"))
    return rows.withColumns({"real": F.col("nivel_risco"), "previsto": said})


def described(spark: SparkSession, d: str) -> DataFrame:
    """Months with the features of their past, and a level."""
    m = months(spark, d)
    rows = history.series(m, m.select("codigo_ibge", "grupo_desastre", "indice_mes", "ano", "mes", "uf", "regiao", "reconhecido", "mortos"))
    level = F.when(F.col("reconhecido") | (F.col("mortos") > 0), "alto").when(F.col("ja_ocorreu") == 0, "baixo").otherwise("medio")
    return rows.withColumn("nivel_risco", level)


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Months with every input of the model, history, context, climate and derived columns, and a level; written once."""
    m = written(months(spark, d), "months")
    towns_ = written(town_climate(spark, d), "town-climate")
    rows = history.features(m, m.select("codigo_ibge", "grupo_desastre", "indice_mes", "ano", "mes", "uf", "regiao", "reconhecido", "mortos"))
    rows = climate.known_before(rows, towns_, climate.normals(towns_, ["codigo_ibge"], 1995, 1997))
    level = F.when(F.col("reconhecido") | (F.col("mortos") > 0), "alto").when(F.col("ja_ocorreu") == 0, "baixo").otherwise("medio")
    return written(features.derive(rows).withColumn("nivel_risco", level).drop("reconhecido", "mortos"), "inputs")


def named_stations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stations."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("uf"))
    name = F.concat(F.lit("CUSTOMER#"), F.regexp_extract("s_name", r"(\d+)", 1), F.when(F.col("s_suppkey") % 3 == 0, " - ANEXO").otherwise(""))
    return table(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), name.alias("estacao"), "uf", F.col("s_name").alias("codigo_estacao"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Line items as hourly readings of their supplier's station."""
    rows = table(spark, d, "lineitem").join(named_stations(spark, d), "l_suppkey")
    return rows.select(
        "estacao", "uf", "codigo_estacao", F.col("l_shipdate").alias("data"), F.when(F.col("l_linenumber") == 7, F.lit(-9999.0)).otherwise(F.col("l_quantity").cast("double")).alias("precipitacao"),
        (15 + 100 * F.col("l_discount")).alias("temperatura"), (60 + 100 * F.col("l_tax")).alias("umidade"), (F.col("l_extendedprice") / 10000).alias("rajada"),
    )


def station_months(spark: SparkSession, d: str) -> DataFrame:
    return climate.monthly(climate.without_sentinel(readings(spark, d)))


def towns(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select(
        F.col("c_custkey").alias("codigo_ibge"), F.col("c_name").alias("municipio"), normalise(F.col("c_name")).alias("nome_busca"), F.col("r_name").alias("uf"),
        F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("regiao_imediata"), F.col("c_nationkey").cast("long").alias("regiao_intermediaria"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("estacao", "uf").distinct()


def matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(stations(spark, d), towns(spark, d))


def town_climate(spark: SparkSession, d: str) -> DataFrame:
    """Stations are told from their months, which are written once."""
    held = written(station_months(spark, d), "station-months")
    found = matching.match(held.select("estacao", "uf").distinct(), towns(spark, d))
    return matching.spread(climate.sound(held)[0], found, towns(spark, d))


#: The same tables as DuckDB common table expressions, in the order of their use.
OCC = """occ AS (SELECT c_custkey AS codigo_ibge, c_name AS municipio, n_name AS uf, r_name AS regiao, CAST(year(o_orderdate) AS INTEGER) AS ano,
  CAST(month(o_orderdate) AS INTEGER) AS mes, o_orderpriority AS grupo_desastre, o_orderstatus = 'F' AS reconhecido, CASE WHEN o_totalprice > 480000 THEN 1.0 ELSE 0.0 END AS mortos,
  CAST(floor(o_totalprice / 1000) AS DOUBLE) AS afetados, o_totalprice AS prejuizo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MON = OCC + """, mon AS (SELECT codigo_ibge, grupo_desastre, ano, mes, (ano - 1900) * 12 + mes - 1 AS indice_mes, min(municipio) AS municipio, min(uf) AS uf, min(regiao) AS regiao,
  bool_or(reconhecido) AS reconhecido, sum(mortos) AS mortos, sum(afetados) AS afetados, sum(prejuizo) AS prejuizo FROM occ GROUP BY ALL)"""
LAB = MON + """, lab0 AS (SELECT *, CASE WHEN reconhecido OR mortos > 0 THEN 'alto' WHEN afetados < 150 THEN 'baixo' ELSE 'medio' END AS nivel_risco,
  substr(md5(concat_ws('|', codigo_ibge, grupo_desastre, indice_mes)), 1, 1) AS digit FROM mon),
lab AS (SELECT *, nivel_risco AS real, CASE WHEN digit < '2' THEN 'baixo' WHEN digit < '4' THEN 'medio' WHEN digit < '6' THEN 'alto' ELSE nivel_risco END AS previsto FROM lab0)"""
RDG = """rdg AS (SELECT 'CUSTOMER#' || regexp_extract(s_name, '(\\d+)', 1) || CASE WHEN s_suppkey % 3 = 0 THEN ' - ANEXO' ELSE '' END AS estacao, r_name AS uf, s_name AS codigo_estacao,
  CAST(l_shipdate AS DATE) AS dia, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS precipitacao, 15 + 100 * l_discount AS temperatura, 60 + 100 * l_tax AS umidade,
  l_extendedprice / 10000 AS rajada FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
STM = RDG + """, day AS (SELECT estacao, uf, codigo_estacao, dia, coalesce(sum(precipitacao), 0) AS chuva, sum(precipitacao) AS p, sum(temperatura) AS t, sum(umidade) AS u, max(rajada) AS g,
  count(*) AS n, count(precipitacao) AS v FROM rdg GROUP BY ALL),
stm AS (SELECT estacao, uf, codigo_estacao, CAST(year(dia) AS INTEGER) AS ano, CAST(month(dia) AS INTEGER) AS mes, coalesce(sum(p), 0) AS chuva_total_mm, max(chuva) AS chuva_max_dia_mm,
  CAST(count(*) FILTER (chuva >= 1) AS BIGINT) AS dias_com_chuva, sum(t) / sum(n) AS temperatura_media_c, sum(u) / sum(n) AS umidade_media_pct, max(g) * 3.6 AS rajada_max_kmh,
  CAST(sum(n) AS BIGINT) AS horas_registradas, CAST(sum(v) AS BIGINT) AS horas_validas, sum(v) / greatest(sum(n), 1) AS fracao_valida FROM day GROUP BY estacao, uf, codigo_estacao, year(dia), month(dia))"""
TWN = """twn AS (SELECT c_custkey AS codigo_ibge, c_name AS municipio, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS nome_busca, r_name AS uf,
  c_nationkey || '-' || c_mktsegment AS regiao_imediata, CAST(c_nationkey AS BIGINT) AS regiao_intermediaria
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MAT = TWN + """, stn AS (SELECT DISTINCT estacao, uf, trim(regexp_replace(lower(estacao), '[^a-z0-9]+', ' ', 'g')) AS nome_busca FROM rdg),
eq AS (SELECT s.estacao, s.uf, min(t.codigo_ibge) AS c FROM stn s JOIN twn t ON s.nome_busca = t.nome_busca AND s.uf = t.uf GROUP BY ALL),
pre AS (SELECT s.estacao, s.uf, t.codigo_ibge AS c, row_number() OVER (PARTITION BY s.estacao, s.uf ORDER BY length(t.nome_busca) DESC, t.codigo_ibge) AS n
  FROM stn s JOIN twn t ON s.uf = t.uf AND starts_with(s.nome_busca, t.nome_busca || ' ')),
mat AS (SELECT s.estacao, s.uf, s.nome_busca, coalesce(eq.c, pre.c) AS codigo_ibge FROM stn s LEFT JOIN eq ON s.estacao = eq.estacao AND s.uf = eq.uf
  LEFT JOIN pre ON s.estacao = pre.estacao AND s.uf = pre.uf AND pre.n = 1)"""
_LEVEL = """l{i} AS (SELECT {key} AS k, ano, mes, avg(chuva_total_mm) AS chuva_total_mm, avg(dias_com_chuva) AS dias_com_chuva, avg(temperatura_media_c) AS temperatura_media_c, avg(umidade_media_pct) AS umidade_media_pct,
  max(chuva_max_dia_mm) AS chuva_max_dia_mm, max(rajada_max_kmh) AS rajada_max_kmh, count(DISTINCT estacao || '|' || euf) AS estacoes_usadas FROM own WHERE {key} IS NOT NULL GROUP BY ALL),
s{i} AS (SELECT t.codigo_ibge, l.* EXCLUDE (k), '{name}' AS fonte_clima FROM twn t JOIN l{i} l ON t.{town} = l.k{served})"""
SPR = STM + ", " + MAT + """, own AS (SELECT s.* EXCLUDE (uf), s.uf AS euf, t.codigo_ibge, t.regiao_imediata, t.regiao_intermediaria FROM stm s LEFT JOIN mat m ON s.estacao = m.estacao AND s.uf = m.uf
  LEFT JOIN twn t ON m.codigo_ibge = t.codigo_ibge WHERE s.fracao_valida >= 0.5), """ + ", ".join(
    _LEVEL.format(i=i, key=key, name=name, town=town, served="" if not i else " WHERE t.codigo_ibge NOT IN (" + " UNION ".join(f"SELECT codigo_ibge FROM s{j}" for j in range(i)) + ")")
    for i, (key, name, town) in enumerate((("codigo_ibge", "municipio", "codigo_ibge"), ("regiao_imediata", "regiao_imediata", "regiao_imediata"), ("regiao_intermediaria", "regiao_intermediaria", "regiao_intermediaria"), ("euf", "uf", "uf")))
) + ", spr AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"
