"""Queries over readings: monthly climate, stations, fallback, known-before features."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.functions.storage import written
from hazardspark.operators import climate, matching
from hazardspark.plans import domain
from hazardspark.plans.domain import MAT, MON, RDG, SPR, STM

MEASURES = ["chuva_total_mm", "chuva_max_dia_mm", "temperatura_media_c", "umidade_media_pct", "rajada_max_kmh"]
NORMAL = (1995, 1997)
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in MEASURES)


def _six(rows, *names):
    return rows.withColumns({n: F.round(n, 6) for n in names})


def _event_readings(spark, d):
    return domain.table(spark, d, "events").select("user_id", F.col("ts").alias("data"), F.col("value").alias("precipitacao"), *(F.lit(None).cast("double").alias(c) for c in ("temperatura", "umidade", "rajada")))


def _known(spark, d):
    targets = domain.months(spark, d).select("codigo_ibge", "grupo_desastre", "indice_mes")
    towns = written(domain.town_climate(spark, d), "town-climate")
    return climate.known_before(targets, towns, climate.normals(towns, ["codigo_ibge"], *NORMAL))


_KNOWN = f"WITH {MON}, {SPR}, " + f"""c AS (SELECT *, (ano - 1900) * 12 + mes - 1 AS i FROM spr),
nrm AS (SELECT codigo_ibge, mes, avg(chuva_total_mm) AS chuva_normal_mm FROM spr WHERE ano BETWEEN {NORMAL[0]} AND {NORMAL[1]} GROUP BY ALL),
k AS (SELECT t.codigo_ibge, t.grupo_desastre, CAST(t.indice_mes AS INTEGER) AS indice_mes, a.chuva_total_mm AS chuva_mes_anterior_mm, a.chuva_max_dia_mm AS chuva_max_dia_mes_anterior_mm,
  CAST(a.dias_com_chuva AS DOUBLE) AS dias_com_chuva_mes_anterior, a.temperatura_media_c AS temperatura_mes_anterior_c, a.umidade_media_pct AS umidade_mes_anterior_pct, a.rajada_max_kmh AS rajada_mes_anterior_kmh,
  CASE WHEN a.i IS NULL AND b.i IS NULL AND x.i IS NULL THEN NULL ELSE coalesce(a.chuva_total_mm, 0) + coalesce(b.chuva_total_mm, 0) + coalesce(x.chuva_total_mm, 0) END AS chuva_3_meses_anteriores_mm,
  CAST((a.i IS NOT NULL)::INT + (b.i IS NOT NULL)::INT + (x.i IS NOT NULL)::INT AS BIGINT) AS meses_de_clima_disponiveis,
  CASE WHEN n.chuva_normal_mm > 0 AND a.i IS NOT NULL THEN least(greatest((a.chuva_total_mm / n.chuva_normal_mm - 1) * 100, -100), 500) END AS anomalia_chuva_pct
  FROM mon t LEFT JOIN c a ON a.codigo_ibge = t.codigo_ibge AND a.i = t.indice_mes - 1 LEFT JOIN c b ON b.codigo_ibge = t.codigo_ibge AND b.i = t.indice_mes - 2
  LEFT JOIN c x ON x.codigo_ibge = t.codigo_ibge AND x.i = t.indice_mes - 3 LEFT JOIN nrm n ON n.codigo_ibge = t.codigo_ibge AND n.mes = (t.indice_mes + 11) % 12 + 1)"""  # fmt: skip
_FLOATS = [c for c in [*climate.BEFORE.values(), "chuva_3_meses_anteriores_mm", "anomalia_chuva_pct"]]
_MONTHS = f"estacao, uf, codigo_estacao, ano, mes, dias_com_chuva, horas_registradas, horas_validas, round(fracao_valida, 6) AS fracao_valida, {_ROUND}"

QUERIES = {
    "p17_sentinel": (
        lambda s, d: climate.without_sentinel(domain.readings(s, d)).groupBy("estacao").agg(F.count("*").alias("n"), F.count("precipitacao").alias("validas"), F.min("precipitacao").alias("menor")),
        f"WITH {RDG} SELECT estacao, count(*) AS n, count(precipitacao) AS validas, min(precipitacao) AS menor FROM rdg GROUP BY estacao",
    ),
    "a4_daily_events": (
        lambda s, d: climate.daily(_event_readings(s, d), ["user_id"]).select("user_id", "dia", F.round("chuva", 4).alias("chuva"), "horas", "validas"),
        "SELECT user_id, CAST(ts AS DATE) AS dia, round(sum(value), 4) AS chuva, count(*) AS horas, count(value) AS validas FROM events GROUP BY ALL",
    ),
    "a4_a5_p18_monthly_climate": (lambda s, d: _six(domain.station_months(s, d), *MEASURES, "fracao_valida"), f"WITH {STM} SELECT {_MONTHS} FROM stm"),
    "p18_sound_months": (
        lambda s, d: climate.sound(domain.station_months(s, d), 0.9)[1],
        f"WITH {STM} SELECT count(*) FILTER (fracao_valida >= 0.9) AS mantidos, count(*) FILTER (fracao_valida < 0.9) AS descartados FROM stm",
    ),
    "a7_station_normals": (
        lambda s, d: _six(climate.normals(domain.station_months(s, d), ["estacao", "uf"], *NORMAL), "chuva_normal_mm"),
        f"WITH {STM} SELECT estacao, uf, mes, round(avg(chuva_total_mm), 6) AS chuva_normal_mm, count(DISTINCT ano) AS anos_na_normal FROM stm WHERE ano BETWEEN {NORMAL[0]} AND {NORMAL[1]} GROUP BY ALL",
    ),
    "j4_j5_station_match": (lambda s, d: domain.matched(s, d), f"WITH {RDG}, {MAT} SELECT estacao, uf, nome_busca, codigo_ibge FROM mat"),
    "j6_j7_fallback_spread": (
        lambda s, d: _six(domain.town_climate(s, d).withColumn("dias_com_chuva", F.round("dias_com_chuva", 6)), *MEASURES),
        f"WITH {SPR} SELECT codigo_ibge, ano, mes, round(dias_com_chuva, 6) AS dias_com_chuva, {_ROUND}, estacoes_usadas, fonte_clima FROM spr",
    ),
    "a9_station_coverage": (
        lambda s, d: matching.coverage(domain.matched(s, d), domain.towns(s, d)),
        f"WITH {RDG}, {MAT}, hit AS (SELECT * FROM twn WHERE codigo_ibge IN (SELECT codigo_ibge FROM mat)) SELECT (SELECT count(*) FROM mat) AS estacoes, (SELECT count(*) FROM mat WHERE codigo_ibge IS NULL) AS sem_municipio, count(*) AS total_municipios, "
        + ", ".join(f"count(*) FILTER ({c} IN (SELECT {c} FROM hit)) AS via_{n}" for c, n in (("codigo_ibge", "municipio"), ("regiao_imediata",) * 2, ("regiao_intermediaria",) * 2, ("uf",) * 2)) + " FROM twn",
    ),
    "j7_unserved": (
        lambda s, d: matching.unserved(domain.town_climate(s, d).where(F.col("fonte_clima") != "uf"), domain.towns(s, d)),
        f"WITH {SPR} SELECT count(*) AS sem_clima FROM twn WHERE codigo_ibge NOT IN (SELECT codigo_ibge FROM spr WHERE fonte_clima <> 'uf')",
    ),
    "a10_source_mix": (
        lambda s, d: matching.sources(domain.town_climate(s, d)),
        f"WITH {SPR} SELECT fonte_clima, count(*) AS n, round(count(*) / (SELECT count(*) FROM spr), 6) AS fracao FROM spr GROUP BY fonte_clima",
    ),
    "w9_w10_known_climate": (lambda s, d: _six(_known(s, d), *_FLOATS), _KNOWN + " SELECT codigo_ibge, grupo_desastre, indice_mes, meses_de_clima_disponiveis, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FLOATS) + " FROM k"),
    "a8_climate_coverage": (
        lambda s, d: climate.coverage(_known(s, d)),
        _KNOWN + " SELECT count(*) AS linhas, count(chuva_mes_anterior_mm) AS com_chuva, count(anomalia_chuva_pct) AS com_anomalia, round(count(chuva_mes_anterior_mm) / greatest(count(*), 1), 4) AS fracao_com_chuva, count(*) FILTER (meses_de_clima_disponiveis = 3) AS com_tres_meses FROM k",
    ),
}
