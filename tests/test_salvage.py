import json
import random
import time

from pyspark.sql import functions as F

from adatlas.functions.salvage import LEVELS, NOTHING, answer_items, scan, scanned
from adatlas.operators import answers as A


def plain(raw):
    """The rule as it is stated: quotes and braces alone are matched, and each pair's text is tried."""
    found, opened, quoted, escaped = [], [], False, False
    for k, sign in enumerate(raw):
        if escaped:
            escaped = False
        elif quoted and sign == "\\":
            escaped = True
        elif sign == '"':
            quoted = not quoted
        elif not quoted and sign == "{":
            opened.append(k)
        elif not quoted and sign == "}" and opened:
            try:
                item = json.loads(raw[opened.pop() : k + 1])
            except ValueError:
                continue
            if item.get("marca"):
                found.append(item)
    return found


def test_equals_trying_every_pair_of_braces():
    rng = random.Random(1)
    bits = ['{"marca":', '"a"', "{", "}", "[", "]", ",", ":", '"marca"', "1", "-0.5e3", "01", "true", "nul", "NaN", " ", "\n", '"\\u00e1"', '"\\x"', '"un', '{"marca":"b"}', '{"marca":""}', '"a\tb"', "x", "é", '"k":', "1e999"]
    for _ in range(20000):
        raw = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        try:
            json.loads(raw)
        except ValueError:
            value, found = scan(raw, "marca")
            assert value is NOTHING and str(found) == str(plain(raw)), raw


def test_whole_texts_are_one_value():
    for raw in ['{"a":[1,{"b":null}],"a":2}', "[]", '"x"', " 12 ", '{"a":NaN}']:
        assert str(scan(raw, "marca")[0]) == str(json.loads(raw))


def test_deep_and_long_answers_take_time_in_proportion():
    begun = time.time()
    assert answer_items("[" * 200_000, "anuncios", "marca") == (False, [])
    assert answer_items('{"a":' * 100_000, "anuncios", "marca") == (False, [])
    deep = '{"marca":"x","m":' * 400 + "1" + "}" * 400
    assert len(answer_items(deep + "{", "anuncios", "marca")[1]) == 400
    assert answer_items('{"anuncios":[' + '{"a":' * 5000 + "1" + "}" * 5000 + "]}", "anuncios", "marca")[0]
    assert len(answer_items('{"anuncios":[' + '{"marca":"b","q":"\\"{"},' * 100_000, "anuncios", "marca")[1]) == 100_000
    assert time.time() - begun < 20 and LEVELS == 16


def test_what_follows_a_value_makes_an_answer_broken(spark):
    good = '{"anuncios":[{"marca":"a"}]}'
    raws = [good, good + "{", good + " said", good + "]", good + "}", good + "," + good, good + "} x }", good + "] x ]", "```json\n" + good + "\n```", "", "null", "[1]", good + ',"w":1']
    df = spark.createDataFrame([("i", k, r) for k, r in enumerate(raws)], "issue_id string, spread_no int, raw string")
    got = {r.spread_no: (r.valid, r.n) for r in A.parsed(df).select("spread_no", "valid", F.size("items").alias("n")).collect()}
    assert got == {k: (r.strip("`json\n") == good, len(json.loads(good)["anuncios"]) if r.strip("`json\n") == good else len(plain(r))) for k, r in enumerate(raws)}


def test_such_answers_do_not_stop_a_job(spark):
    raws = ["[" * 200_000, '{"a":' * 100_000, '{"marca":"x","m":' * 400 + "1" + "}" * 400, '{"anuncios":[' + '{"marca":"m","a":' * 3000 + "1" + "}" * 3000 + "]}", '{"anuncios":[{"marca":{"a":1}},{"marca":[1]},{"marca":true},{"marca":"ok","web":null}]}']
    df = spark.createDataFrame([("i", k, r) for k, r in enumerate(raws)], "issue_id string, spread_no int, raw string").withColumn("page_nums", F.array(F.lit(1)))
    got = {r.spread_no: r for r in A.parsed(df).select("spread_no", "valid", F.size("items").alias("n")).collect()}
    assert [(got[k].valid, got[k].n) for k in range(5)] == [(False, 0), (False, 0), (False, 0), (True, 1), (True, 4)]
    rows = A.validated(A.parsed(df)).where("spread_no >= 3").orderBy("spread_no", "item_idx").collect()
    assert [r.brand for r in rows] == ["m", None, None, None, "ok"]


def test_the_decoder_goes_as_far_as_it_can():
    rng = random.Random(3)
    bits = ["{", "}", "[", "]", ":", ",", '"marca"', '{"marca":"y"}', '"m\\q"', '"\\u006darca":1', '"\t"', '"x', "\\", "01", "truex", "nul", "NaN", " ", "],"]
    for _ in range(20000):
        raw = rng.choice(["", '{"anuncios":[']) + "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        value, found = scanned(raw, "marca")
        if value is NOTHING:
            assert repr((value, found)) == repr(scan(raw, "marca")), raw
        else:
            assert repr(value) == repr(json.loads(raw)), raw
    begun = time.time()
    for k in range(1000):
        assert answer_items('[{"a":' * 3000 + str(k), "anuncios", "marca") == (False, [])
    assert time.time() - begun < 8  # each sign in Python: 17 s
