"""Checks of a prepared dataset against the contract, and its cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.contract import Rule
from hazardspark.operators import quantiles

SCHEMA = "check string, coluna string, severidade string, n long, detalhe string"


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def columns(rows: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Required columns that lack (errors) and columns that the contract does not know."""
    required = required or contract.REQUIRED
    found = [("colunas", c, "erro", 1, "falta") for c in required if c not in rows.columns]
    found += [("colunas", c, "aviso", 1, "a mais") for c in rows.columns if c not in required]
    return rows.sparkSession.createDataFrame(found, SCHEMA)


def counters(rows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One pass over the table: text in numbers, values out of range, nulls; a row each."""
    rules = [r for r in rules or [*contract.IDENTITY, *contract.CATEGORICAL, *contract.NUMERIC] if r.name in rows.columns]
    checks: list[tuple[str, str, str, Column]] = []
    for r in rules:
        c = F.col(r.name)
        if r.low is not None or r.high is not None:
            checks.append(("nao_numerico", r.name, "erro", F.count_if(c.isNotNull() & _number(r.name).isNull())))
        if r.low is not None:
            checks.append(("abaixo_do_minimo", r.name, "aviso", F.count_if(_number(r.name) < r.low)))
        if r.high is not None:
            checks.append(("acima_do_maximo", r.name, "aviso", F.count_if(_number(r.name) > r.high)))
        if not r.nullable:
            checks.append(("nulos", r.name, "aviso", F.count_if(c.isNull())))
    counted = rows.agg(F.count("*").alias("total"), *(n.alias(f"n{i}") for i, (*_, n) in enumerate(checks)))
    share = lambda n: F.when(n > 0.3 * F.col("total"), "mais de 30%").otherwise("")
    lines = F.array(
        F.struct(F.lit("linhas").alias("check"), F.lit("").alias("coluna"), F.lit("erro").alias("severidade"), (F.col("total") == 0).cast("long").alias("n"), F.lit("tabela vazia").alias("detalhe")),
        *(F.struct(F.lit(k).alias("check"), F.lit(c).alias("coluna"), F.lit(s).alias("severidade"), F.col(f"n{i}").alias("n"), (share(F.col(f"n{i}")) if k == "nulos" else F.lit("")).alias("detalhe")) for i, (k, c, s, _) in enumerate(checks)),
    )
    return counted.select(F.inline(lines)).where("n > 0")


def unknown(rows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Category values outside their domain, the first eight named."""
    rules = [r for r in rules or contract.CATEGORICAL if r.domain and r.name in rows.columns]
    parts = []
    for r in rules:
        values = rows.where(F.col(r.name).isNotNull() & ~F.col(r.name).isin(*r.domain)).groupBy(F.col(r.name).alias("valor")).count()
        first = F.array_join(F.slice(F.array_sort(F.collect_set("valor")), 1, 8), ", ")
        parts.append(values.agg(F.count("*").alias("n"), first.alias("detalhe")).select(F.lit("fora_do_dominio").alias("check"), F.lit(r.name).alias("coluna"), F.lit("aviso").alias("severidade"), "n", "detalhe"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def repeats(rows: DataFrame, key: list[str] = contract.KEY) -> DataFrame:
    """Rows beyond the first of each key."""
    n = rows.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return n.select(F.lit("repetidas").alias("check"), F.lit(",".join(key)).alias("coluna"), F.lit("aviso").alias("severidade"), "n", F.lit("").alias("detalhe")).where("n > 0")


def target(rows: DataFrame, classes: list[str] = contract.CLASSES) -> DataFrame:
    """Null, unknown, absent, rare and unbalanced classes."""
    t = F.col(contract.TARGET)
    counted = rows.agg(F.count_if(t.isNull()).alias("nulos"), F.count_if(t.isNotNull() & ~t.isin(*classes)).alias("invalidos"), *(F.count_if(t == c).alias(f"c_{c}") for c in classes))
    each = F.array(*(F.col(f"c_{c}") for c in classes))
    present = F.filter(each, lambda n: n > 0)
    line = lambda k, c, s, n, d="": F.struct(F.lit(k).alias("check"), F.lit(c).alias("coluna"), F.lit(s).alias("severidade"), n.cast("long").alias("n"), F.lit(d).alias("detalhe"))
    lines = [line("alvo_nulo", contract.TARGET, "erro", F.col("nulos")), line("alvo_invalido", contract.TARGET, "erro", F.col("invalidos"))]
    for c in classes:
        lines.append(line("classe_ausente", contract.TARGET, "erro", (F.col(f"c_{c}") == 0), c))
        lines.append(line("classe_rara", contract.TARGET, "aviso", F.when(F.col(f"c_{c}").between(1, 9), F.col(f"c_{c}")).otherwise(0), c))
    skew = F.when(F.size(present) > 1, F.floor(F.array_max(present) / F.array_min(present))).otherwise(0)
    lines.append(line("desequilibrio", contract.TARGET, "aviso", F.when(F.array_max(present) > 20 * F.array_min(present), skew).otherwise(0)))
    return counted.select(F.inline(F.array(*lines))).where("n > 0")


def validate(rows: DataFrame, with_target: bool = True) -> DataFrame:
    """All checks as one table; missing columns end it."""
    required = contract.REQUIRED if with_target else [c for c in contract.REQUIRED if c != contract.TARGET]
    found = columns(rows, required)
    if any(c not in rows.columns for c in required):
        return found
    parts = [found, counters(rows), unknown(rows), repeats(rows), *([target(rows)] if with_target else [])]
    return reduce(DataFrame.unionByName, parts)


def clean(rows: DataFrame, numeric: list[str], categorical: list[str], key: list[str], order: list[str]) -> DataFrame:
    """Nulls by exact median and mode, the first row of each key kept."""
    fills = quantiles.fills(rows, numeric, categorical)
    types = dict(rows.dtypes)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in numeric if types[c] != "double"})
    rows = rows.fillna({c: v for c, v in fills.items() if v is not None})
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gate(requests: DataFrame, required: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """``requests`` with motivos: why each is refused (none: accepted). Categories may be unknown."""
    rules = rules or [*contract.NUMERIC, contract.IDENTITY[0], *(Rule(k, *v, True) for k, v in contract.POSITION.items())]
    required = set(required or contract.MODEL_CATEGORICAL) | {r.name for r in rules if not r.nullable}
    reasons = [F.when(F.col(c).isNull(), F.lit(f"falta {c}")) for c in sorted(required) if c in requests.columns]
    reasons += [F.when((F.col(r.name) < r.low) | (F.col(r.name) > r.high), F.lit(f"{r.name} fora da faixa")) for r in sorted(rules, key=lambda r: r.name) if r.low is not None and r.name in requests.columns]
    return requests.withColumn("motivos", F.array_compact(F.array(*reasons)))
