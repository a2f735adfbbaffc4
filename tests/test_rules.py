from pyspark.sql import functions as F

from adatlas.functions import text as X
from adatlas.functions import urls as U


def applied(spark, rule, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", rule(F.col("v")).alias("o")).orderBy("i").collect()]


def test_brands(spark):
    assert applied(spark, X.canonical_brand, ["ROCA", "Roca, S.A.", "Cosentino S.L.", "  Símon  ", "Simon Electric", "Euro Perfil", "Europerfil", "sl", None]) == ["roca", "roca", "cosentino", "simon", "simon electric", "euro perfil", "europerfil", "sl", ""]
    assert applied(spark, X.compare_key, [" Çà-va.1 ", "Ñu Ño", None]) == ["çàva1", "nuno", ""]
    assert applied(spark, X.title_case, ["3m foo", "old bolt"]) == ["3M Foo", "Old Bolt"]


def test_sectors(spark):
    cases = {
        "": "Sin sector", "   ": "Sin sector", None: "Sin sector", "Alimentacion / Quesos": "Alimentacion", "Bebidas / distribucion": "Bebidas", "Sanitarios y griferia": "Bano y sanitarios",
        "Agencia SEO / marketing para hosteleria": "Marketing y comunicacion", "Asistente digital para food service": "Tecnologia y software", "Asesoria estrategica en restauracion": "Servicios profesionales",
        "Restaurante / bar de tapas": "Hosteleria y restauracion", "Servicio de catering para eventos": "Hosteleria y restauracion", "Algo rarisimo inclasificable": "Otros", "española": "Alimentacion", "la ia aplicada": "Tecnologia y software",
    }
    assert applied(spark, X.sector_group, list(cases)) == list(cases.values())


def test_contacts(spark):
    assert applied(spark, X.first_phone, ["tel. +34 912 345 678 x", "192.168.100.200 y 612345678", "512345678", None, "912 34 56 78"]) == ["+34 912 345 678", "612345678", "", "", "912 34 56 78"]
    assert applied(spark, X.first_email, ["a b@c.es, d@e.com", "none"]) == ["b@c.es", ""]
    assert applied(spark, X.is_blocked, ["miproarquitectura.es", "roca.es"]) == [True, False]
    assert applied(spark, lambda c: F.regexp_extract_all(c, F.lit(X.URL_PATTERN), 1), ["www.roca.com y ñacme.es http://a-b.net/x"]) == [["www.roca.com", "http://a-b.net"]]


def test_display(spark):
    assert applied(spark, X.percent, [0.125, 0.625, 0.875, 0.0], "double") == ["12%", "62%", "88%", "0%"]
    assert applied(spark, X.review_label, [["low_conf", "other"], []], "array<string>") == ["Confianza baja · other", ""]
    assert applied(spark, X.export_name, ["a b/c-ñ_1" + "x" * 40]) == ["abc-ñ_1" + "x" * 25]
    assert applied(spark, X.positive_int, ["3", "0", "x", None]) == [3, None, None, None]
    assert applied(spark, X.web_link, ["roca.com", "http://x", ""]) == ["https://roca.com", "http://x", ""]


def test_addresses(spark):
    cases = {"http://h/a/page10.jpg": 10, "http://h/a/img.jpg?page=7&p=2": 7, "http://h/x?page=0&p=4": 4, "http://h/slide-3/p_9.png": 9, "http://h/1/file12b34.png": 34, "http://h/none": None}
    assert applied(spark, U.page_number, list(cases)) == list(cases.values())
    assert applied(spark, U.safe_source, ["http://h/a?t=1#x"]) == ["http://h/a"]
    assert applied(spark, U.normal_url, [" HTTP://Host.COM/Path?Q=A#f"]) == ["http://host.com/Path?Q=A"]
    assert applied(spark, U.declared_total, ["12 / 166", "166", "total de 40 paginas", "9999", "1"]) == [166, 166, 40, None, None]
    pdf = spark.createDataFrame([(bytearray(b"%PDF-1.7 x"), "application/octet-stream", "http://h/a"), (bytearray(b"<html>"), "text/html", "http://h/a.PDF?x"), (bytearray(b"x"), None, "http://h/pdf")], "c binary, t string, u string")
    assert [r[0] for r in pdf.select(U.is_pdf(F.col("c"), F.col("t"), F.col("u"))).collect()] == [True, True, False]
