"""The data contract: tables, value ranges and categories."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import types as T

# Class names, groups, regions, states, typologies and ranges of the data model.
TARGET = "nivel_risco"
CLASSES = ["baixo", "medio", "alto"]
COLOURS = {"baixo": "#2E7D32", "medio": "#F9A825", "alto": "#C62828"}
GROUPS = ["ESTIAGEM_SECA", "INUNDACAO", "ENXURRADA", "ALAGAMENTO", "CHUVAS_INTENSAS", "DESLIZAMENTO", "VENDAVAL_CICLONE", "GRANIZO", "INCENDIO_FLORESTAL", "EROSAO"]
REGIONS = ["Norte", "Nordeste", "Centro-Oeste", "Sudeste", "Sul"]
STATES = "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split()
TYPOLOGIES = {
    "Estiagem e Seca": "ESTIAGEM_SECA",
    "Enxurradas": "ENXURRADA",
    "Chuvas Intensas": "CHUVAS_INTENSAS",
    "Inundações": "INUNDACAO",
    "Vendavais e Ciclones": "VENDAVAL_CICLONE",
    "Tornado": "VENDAVAL_CICLONE",
    "Incêndio Florestal": "INCENDIO_FLORESTAL",
    "Granizo": "GRANIZO",
    "Alagamentos": "ALAGAMENTO",
    "Movimento de Massa": "DESLIZAMENTO",
    "Erosão": "EROSAO",
}
RECOGNISED = "Reconhecido"
REGISTER_COLUMNS = ["Nome_Municipio", "Sigla_UF", "regiao", "Data_Evento", "descricao_tipologia", "Cod_IBGE_Mun", "Status", "DH_MORTOS", "DH_total_danos_humanos_diretos", "PE_PLePR"]
KEY = ["codigo_ibge", "ano", "mes", "grupo_desastre"]


@dataclass(frozen=True)
class Rule:
    """What a column may hold."""

    name: str
    low: float | None = None
    high: float | None = None
    nullable: bool = False
    domain: tuple[str, ...] = ()


IDENTITY = [Rule("codigo_ibge", 1_000_000, 9_999_999), Rule("municipio"), Rule("ano", 1990, 2100)]
CATEGORICAL = [Rule("uf", domain=tuple(STATES)), Rule("regiao", domain=tuple(REGIONS)), Rule("grupo_desastre", domain=tuple(GROUPS))]
HISTORY = [
    Rule("ocorrencias_12m", 0, 200), Rule("ocorrencias_24m", 0, 400), Rule("ocorrencias_60m", 0, 800),
    Rule("ocorrencias_total_historico", 0, 2000), Rule("meses_desde_ultima_ocorrencia", -1, 1200), Rule("ja_ocorreu", 0, 1),
    Rule("anos_de_historico", 0, 120), Rule("ocorrencias_mesmo_mes_historico", 0, 200), Rule("reconhecimentos_historico", 0, 1000),
    Rule("mortos_historico", 0, 100_000), Rule("afetados_historico", 0, 100_000_000), Rule("prejuizo_historico_log", 0, 30),
    Rule("ocorrencias_municipio_12m", 0, 500), Rule("ocorrencias_uf_grupo_12m", 0, 20_000),
]
CLIMATE = [
    Rule("chuva_mes_anterior_mm", 0, 3000, True), Rule("chuva_max_dia_mes_anterior_mm", 0, 800, True), Rule("dias_com_chuva_mes_anterior", 0, 31, True),
    Rule("chuva_3_meses_anteriores_mm", 0, 9000, True), Rule("anomalia_chuva_pct", -100, 500, True), Rule("temperatura_mes_anterior_c", -10, 50, True),
    Rule("umidade_mes_anterior_pct", 0, 100, True), Rule("rajada_mes_anterior_kmh", 0, 250, True), Rule("meses_de_clima_disponiveis", 0, 3),
]
NUMERIC = [Rule("mes", 1, 12), *HISTORY, *CLIMATE]
DERIVED = [Rule("mes_seno", -1, 1), Rule("mes_cosseno", -1, 1), Rule("ocorrencias_por_ano", 0, 200), Rule("proporcao_reconhecidas", 0, 1), Rule("gravidade_media_historica", 0, 10_000_000)]
REQUIRED = [r.name for r in [*IDENTITY, *CATEGORICAL, *NUMERIC]] + [TARGET]
MODEL_NUMERIC = [r.name for r in [*NUMERIC, *DERIVED]]
MODEL_CATEGORICAL = [r.name for r in CATEGORICAL]
POSITION = {"latitude": (-34, 6), "longitude": (-74, -34)}

OCCURRENCES = T.StructType(
    [T.StructField(n, t) for n, t in (("codigo_ibge", T.LongType()), ("municipio", T.StringType()), ("uf", T.StringType()), ("regiao", T.StringType()), ("ano", T.IntegerType()), ("mes", T.IntegerType()), ("grupo_desastre", T.StringType()), ("reconhecido", T.BooleanType()), ("mortos", T.DoubleType()), ("afetados", T.DoubleType()), ("prejuizo", T.DoubleType()))]
)


def dataset_schema() -> T.StructType:
    """The prepared dataset: ids, categories, numbers, target; ranges in the metadata."""
    whole = {"codigo_ibge": T.LongType(), "ano": T.IntegerType(), "mes": T.IntegerType()}
    text = {"municipio", *MODEL_CATEGORICAL}
    fields = [T.StructField(r.name, T.StringType() if r.name in text else whole.get(r.name, T.DoubleType()), True, {"low": r.low, "high": r.high, "nullable": r.nullable}) for r in [*IDENTITY, *CATEGORICAL, *NUMERIC]]
    return T.StructType([*fields, T.StructField(TARGET, T.StringType(), True)])


def signature() -> str:
    """A short hash of target, classes and input columns: a saved model names the one it knows."""
    parts = {"target": TARGET, "classes": CLASSES, "numeric": MODEL_NUMERIC, "categorical": MODEL_CATEGORICAL}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]
