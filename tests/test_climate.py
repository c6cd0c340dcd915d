"""Station files, municipalities, fallback and climate known before a month."""

import io
import json
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardspark.functions import storage
from hazardspark.functions.text import normalise
from hazardspark.operators import climate, matching
from hazardspark.plans import queries_files
from hazardspark.sources import municipalities, stations

OLD = "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE RELATIVA DO AR, HORARIA (%);VENTO, RAJADA MAXIMA (m/s);"
NEW = "DATA (YYYY-MM-DD);HORA (UTC);PRECIPITACAO TOTAL, HORARIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE RELATIVA DO AR, HORARIA (%);VENTO, RAJADA MAXIMA (m/s);"


def station(name="PETROPOLIS", head=NEW, date="2020-01-{:02d}", rain="0,5", missing=0, labels=("REGIAO:", "UF:", "ESTACAO:")):
    lines = [f"{labels[0]};SE", f"{labels[1]};rj", f"{labels[2]};{name}", "CODIGO (WMO):;A610", "LATITUDE:;-22,50472222", "LONGITUDE:;-43,17805555", "ALTITUDE:;800,00", "DATA DE FUNDACAO:;01/01/07", head]
    for h in range(72):
        lines.append(f"{date.format(h // 24 + 1)};{h % 24:02d}00 UTC;{'-9999' if h < missing else rain};20,0;70;10,0;")
    return "\n".join(lines)


def test_station_files(spark, tmp_path):
    (tmp_path / "a.CSV").write_bytes(station().encode("latin-1"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_bytes(station("VELHA", OLD, "2020/01/{:02d}").encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(station("UTF É", NEW, "{:02d}/01/2020", missing=60).encode("utf-8"))
    (tmp_path / "d.csv").write_bytes(station("ROTA", labels=("REGI?O:", "UF:", "ESTAC?O:"), missing=36).encode("latin-1"))
    (tmp_path / "bad.csv").write_text("nothing here")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("in/e.CSV", station("ZIPADA", rain="0").encode("latin-1"))
        z.writestr("in/f.csv", b"junk")
    readings, failures = stations.split(stations.read(spark, str(tmp_path)))
    assert {r.arquivo.rsplit("/", 1)[-1] for r in failures.collect()} == {"bad.csv", "broken.zip", "f.csv"}
    counts = {r.estacao: r["count"] for r in readings.groupBy("estacao").count().collect()}
    assert counts == {n: 72 for n in ("PETROPOLIS", "VELHA", "UTF É", "ROTA", "ZIPADA")}
    months = climate.monthly(readings)
    m = {r.estacao: r for r in months.collect()}
    p = m["PETROPOLIS"]
    assert (p.uf, p.ano, p.mes, p.chuva_total_mm, p.chuva_max_dia_mm, p.dias_com_chuva) == ("RJ", 2020, 1, 36.0, 12.0, 3)
    assert p.rajada_max_kmh == pytest.approx(36) and p.temperatura_media_c == 20 and p.horas_registradas == 72
    assert m["ZIPADA"].dias_com_chuva == 0 and m["ROTA"].fracao_valida == 0.5
    kept, counted = climate.sound(months)
    assert kept.count() == 4 and tuple(counted.first()) == (4, 1)


def test_why_a_file_is_bad(spark, tmp_path):
    (tmp_path / "a.csv").write_text("REGIAO:;SE\nUF:;\nESTACAO:;X\n")
    (tmp_path / "b.csv").write_text(station(head="Data;outra"))
    (tmp_path / "c.csv").write_text("\n")
    why = {r.arquivo[-5:]: r.motivo for r in stations.split(stations.read(spark, str(tmp_path)))[1].collect()}
    assert why == {"a.csv": "the header lacks uf", "b.csv": "no column for precipitacao", "c.csv": "the header lacks uf"}


def test_dates_in_mixed_forms(spark, tmp_path):
    mixed = "\n".join(x.replace("-", "/") if i % 2 and x.startswith("2020") else x for i, x in enumerate(station("MISTA").split("\n")))
    (tmp_path / "a.csv").write_text(mixed)
    third = ("{:02d}/01/20", "2020-01-{:02d}", "{:02d}-01-2020")
    days = [third[i % 3].format(i % 28 + 1) for i in range(84)]
    lines = station("SOLTA").split("\n")[:9] + [f"{d};0000 UTC;-0,5;1.5;-9999;2,5" for d in days] + ["", "x;y;z"]
    (tmp_path / "b.csv").write_text("\ufeff" + "\r\n".join(lines), encoding="utf-8")
    got = stations.split(stations.read(spark, str(tmp_path)))[0]
    one, two = (got.where(F.col("estacao") == n).collect() for n in ("MISTA", "SOLTA"))
    assert len(one) == 72 and {r.data.isoformat() for r in one} == {f"2020-01-0{i}" for i in (1, 2, 3)}
    assert sorted(r.data.isoformat() for r in two) == sorted(f"2020-01-{i % 28 + 1:02d}" for i in range(84))
    assert {(r.precipitacao, r.temperatura, r.umidade, r.rajada, r.latitude) for r in two} == {(0.0, 1.5, None, 2.5, -22.50472222)}


def test_compatible_letters(spark):
    words = [("Vila 1\u00ba", "vila 1o"), ("\ufb01m\u00b2", "fim2"), ("\uff21b \u00c7e\u0301", "ab ce"), ("\u0132sel", "ijsel")]
    rows = spark.createDataFrame([(a,) for a, _ in words], "a string")
    assert [r[0] for r in rows.select(normalise(F.col("a"))).collect()] == [b for _, b in words]


def towns_file(tmp_path):
    def town(code, name, near, middle, uf):
        return {"id": code, "nome": name, "regiao-imediata": {"id": near, "regiao-intermediaria": {"id": middle, "UF": {"id": 1, "sigla": uf}}}}

    rows = [town(3303906, "Petrópolis", 330007, 3303, "RJ"), town(3304557, "Rio de Janeiro", 330001, 3301, "RJ"), town(4316907, "Santa Maria", 430009, 4302, "RS"), town(2611606, "Santa Maria", 260005, 2601, "PE"), town(3550308, "São Paulo", 350001, 3501, "SP")]
    path = tmp_path / "m.json"
    path.write_text(json.dumps(rows))
    return rows, path


def test_municipalities_and_match(spark, tmp_path):
    rows, path = towns_file(tmp_path)
    towns = municipalities.read(spark, str(path))
    assert {r.nome_busca for r in towns.collect()} == {"petropolis", "rio de janeiro", "santa maria", "sao paulo"}
    old = {"id": 1, "nome": "Antiga", "regiao-imediata": None, "microrregiao": {"mesorregiao": {"UF": {"id": 5, "sigla": "MT"}}}}
    (tmp_path / "o.json").write_text(json.dumps([old]))
    assert municipalities.read(spark, str(tmp_path / "o.json")).first().uf == "MT"
    (tmp_path / "n.json").write_text(json.dumps([old | {"microrregiao": None}]))
    with pytest.raises(ValueError):
        municipalities.read(spark, str(tmp_path / "n.json"))
    names = [("PETROPOLIS", "RJ"), ("SANTA MARIA", "RS"), ("SANTA MARIA", "PE"), ("RIO DE JANEIRO - FORTE DE COPACABANA", "RJ"), ("SAO PAULOZINHO", "SP"), ("LUGAR NENHUM", "RJ"), ("PETROPOLIS", "ZZ")]
    got = {(r.estacao, r.uf): r.codigo_ibge for r in matching.match(spark.createDataFrame(names, "estacao string, uf string"), towns).collect()}
    assert [got[n] for n in names] == [3303906, 4316907, 2611606, 3304557, None, None, None]
    one = matching.match(spark.createDataFrame(names[:1], "estacao string, uf string"), towns)
    c = matching.coverage(one, towns).first()
    assert (c.estacoes, c.via_municipio, c.via_uf, c.total_municipios) == (1, 1, 2, 5)
    months = spark.createDataFrame([("PETROPOLIS", "RJ", 2020, 1, 10.0, 5.0, 2, 20.0, 70.0, 30.0)], "estacao string, uf string, ano int, mes int, chuva_total_mm double, chuva_max_dia_mm double, dias_com_chuva long, temperatura_media_c double, umidade_media_pct double, rajada_max_kmh double")
    spread = {r.codigo_ibge: r.fonte_clima for r in matching.spread(months, one, towns).collect()}
    assert spread == {3303906: "municipio", 3304557: "uf"}


def test_known_before(spark):
    c = spark.createDataFrame([(3303906, 2020, m, 10.0 * m, 2.0 * m, float(m), 20.0 + m, 70.0, 30.0 + m, "municipio") for m in range(1, 13)], "codigo_ibge long, ano int, mes int, chuva_total_mm double, chuva_max_dia_mm double, dias_com_chuva double, temperatura_media_c double, umidade_media_pct double, rajada_max_kmh double, fonte_clima string")
    targets = spark.createDataFrame([(3303906, 1440 + m, m + 1) for m in range(12)] + [(1, 1441, 99)], "codigo_ibge long, indice_mes int, k int")
    got = {r.k: r for r in climate.known_before(targets, c).collect()}
    assert got[1].chuva_mes_anterior_mm is None and got[3].chuva_mes_anterior_mm == 20
    assert (got[5].chuva_3_meses_anteriores_mm, got[5].meses_de_clima_disponiveis) == (90, 3)
    assert (got[2].chuva_3_meses_anteriores_mm, got[2].meses_de_clima_disponiveis) == (10, 1)
    assert (got[6].temperatura_mes_anterior_c, got[6].rajada_mes_anterior_kmh, got[6].dias_com_chuva_mes_anterior) == (25, 35, 5)
    assert got[99].meses_de_clima_disponiveis == 0 and len(got) == 13 and got[5].anomalia_chuva_pct is None
    cover = climate.coverage(climate.known_before(targets, c)).first()
    assert (cover.linhas, cover.com_chuva, cover.com_anomalia) == (13, 11, 0)


def test_anomaly(spark):
    c = spark.createDataFrame([(1, 2019, 12, 100.0), (1, 2020, 1, 200.0), (1, 2020, 2, 25.0), (1, 2020, 3, 90.0), (1, 2020, 4, 9.0)], "codigo_ibge long, ano int, mes int, chuva_total_mm double").selectExpr("*", *(f"1D AS {x}" for x in climate.BEFORE if x != "chuva_total_mm"))
    normal = spark.createDataFrame([(1, 12, 50.0), (1, 1, 100.0), (1, 2, 100.0), (1, 3, 0.5), (1, 4, 0.0)], "codigo_ibge long, mes int, chuva_normal_mm double")
    targets = spark.createDataFrame([(1, 1440 + m) for m in range(5)], "codigo_ibge long, indice_mes int")
    got = {r.indice_mes - 1440: r.anomalia_chuva_pct for r in climate.known_before(targets, c, normal).collect()}
    assert got == {0: 100.0, 1: 100.0, 2: -75.0, 3: 500.0, 4: None}


def test_normals(spark):
    months = spark.createDataFrame([("A", "RJ", y, 1, v) for y, v in ((2005, 100.0), (2008, 200.0), (2015, 900.0), (2020, 900.0))], "estacao string, uf string, ano int, mes int, chuva_total_mm double")
    r = climate.normals(months, ["estacao", "uf"]).first()
    assert (r.chuva_normal_mm, r.anos_na_normal) == (150.0, 2)
    assert climate.normals(months.where(F.col("ano") > 2010), ["estacao", "uf"]).isEmpty()


def test_usual_dates_as_any_other(spark):
    """The cast for dates of the usual look gives what the form gives, and null for the look of the other form."""
    odd = ["2020-02-29", "2021-02-29", "2020-2-3", "0000-01-01", "02020-01-05", "2020-01-05 x", "31-12-2020", "31-02-2020", "1-1-20", "2020-001-05", "20200-01-01", "2020-13-01", "x", "", None, "2020-01-05T00", "-2020-01-05", "+2020-1-1", "1-13-2020", "01-01-0000", "2020-01", "2020-01-05\u0085"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    for form in stations.FORMS:
        got = rows.select("x", stations.date_of(F.col("x"), form).cast("string").alias("a"), F.try_to_date("x", form).cast("string").alias("b")).collect()
        assert [(r.x, r.a) for r in got] == [(r.x, r.b) for r in got] and any(r.a for r in got)


def test_a_file_is_worked_out_once(spark, tmp_path):
    """No expression of a whole file is repeated for the values or lines that use it; what a bad file lacks needs no readings."""
    (tmp_path / "a.csv").write_bytes(station().encode("latin-1"))
    readings, failures = stations.split(stations.read(spark, str(tmp_path)))
    plan = readings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StringDecode.decode") == 1 and plan.count("split(line#") == 1 and plan.count("MapIn") == 1
    plan = failures.select("motivo")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StringDecode.decode") == 1 and plan.index("Generate explode(body") < plan.rindex("Filter isnotnull(motivo")  # before any line is met


def test_members_leave_together():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name in ("a.csv", "b.CSV", "c.txt", "d.csv"):
            z.writestr(name, name * 3)
    given = pa.RecordBatch.from_pydict({"path": ["y.zip", "n.zip", "e.csv"], "content": [held.getvalue(), b"no archive", b"e"]})
    (got,) = stations._members(iter([given]))
    assert got["arquivo"].to_pylist() == ["y.zip!a.csv", "y.zip!b.CSV", "y.zip!d.csv", "n.zip", "e.csv"]
    assert got["content"].to_pylist() == [b"a.csv" * 3, b"b.CSV" * 3, b"d.csv" * 3, None, b"e"] and [m is None for m in got["motivo"].to_pylist()] == [True] * 3 + [False, True]


def test_signs_of_the_western_code_page(spark, tmp_path):
    """A dash of code page 1252; the same signs where the text is valid UTF-8; lines of all ends."""
    (tmp_path / "a.csv").write_bytes(station("A – B").encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(station("C \u0096 É").encode("utf-8"))
    (tmp_path / "c.csv").write_bytes(station("É").replace("\n", "\r").encode("latin-1"))
    readings, _ = stations.split(stations.read(spark, str(tmp_path)))
    assert {r.estacao: r["count"] for r in readings.groupBy("estacao").count().collect()} == {"A – B": 72, "C \u0096 É": 72, "É": 72}


def test_files_put_by_tasks(spark, tmp_path):
    """Files as they were given, each under its name and nothing else; loose files and archives are read from there together."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("z.csv", station("ZIPADA"))
    files = {f"{i % 3}/{i}.CSV": station(f"S{i}").encode("latin-1") for i in range(7)} | {"y.ZIP": held.getvalue()}
    folder = str(tmp_path / "put")
    storage.put(spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3), folder)
    assert {str(p.relative_to(folder)): p.read_bytes() for p in (tmp_path / "put").rglob("*") if p.is_file()} == files
    readings, failures = stations.split(stations.read(spark, folder))
    assert failures.count() == 0 and {r.estacao: r["count"] for r in readings.groupBy("estacao").count().collect()} == {**{f"S{i}": 72 for i in range(7)}, "ZIPADA": 72}


def test_bad_files_are_told_by_their_heads(spark, tmp_path):
    """What lies below the head is taken apart only in files that are kept."""
    (tmp_path / "a.csv").write_bytes(station().encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"REGIAO:;SE\r\nUF:;\r\nESTACAO:;X\r\n" + b"x\r\n" * 20)
    _, failures = stations.split(stations.read(spark, str(tmp_path)))
    assert [(r.arquivo[-5:], r.motivo) for r in failures.collect()] == [("b.csv", "the header lacks uf")]
    plan = failures.select("motivo")._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"split\(text#\d+, [^,]*, (-?\d+)\)", plan[plan.rindex("Filter isnotnull(motivo") :]) == [str(stations.HEADER_LINES + 2)]


def test_only_lines_move_with_readings(spark):
    """The station's name, state and code do not travel with each of its lines."""
    assert queries_files._station_lines(spark, "/root/testdata/sf0.001").columns == ["k", "y", "line"]
