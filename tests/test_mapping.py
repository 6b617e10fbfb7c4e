import random
import re

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import numbers as num
from wareloom.operators import mapping as mp
from wareloom.operators import options as op
from wareloom.operators import programs

RULE_SCHEMA = ("site string, field string, source string, default string, pattern string, regex_group string, regex_all boolean, "
               "join_with string, value_map map<string,string>, plain boolean")


def rules_of(spark, mapping):
    rows = []
    for field, rule in mapping.items():
        r = {"source": rule} if isinstance(rule, str) else rule
        rows.append(("s", field, r.get("source"), r.get("default"), r.get("pattern"), r.get("regex_group"), r.get("regex_all"), r.get("join_with"), r.get("value_map"), isinstance(rule, str)))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def headers_of(spark, names):
    return spark.createDataFrame([("s", n) for n in names], "site string, header string")


def parse(spark, row, mapping):
    ledger = spark.createDataFrame([("s", 1, row)], "site string, row_no bigint, raw map<string,string>")
    return mp.parse_rows(mp.project_fields(ledger, rules_of(spark, mapping), headers_of(spark, row))).first()


BASE = {"상태": "정상", "제품번호": "12345", "상품코드": "ABC-001", "상품명": "테스트 상품", "옵션값": "블랙,L", "가격": "12000,13000", "원산지": "국내",
        "옵션이미지": "https://img.example/black.jpg,https://img.example/large.jpg", "목록이미지1": "https://img.example/1.jpg", "상세이미지": "https://img.example/detail.jpg"}


def test_missing_required_fields(spark):
    columns = ["상태", "상품코드", "상품명", "가격", "원산지", "목록이미지1", "상세이미지"]
    missing = lambda mapping, names: sorted(r.field for r in mp.missing_required(rules_of(spark, mapping), headers_of(spark, names)).collect())
    assert missing({"wholesale_status": "상태"}, columns) == ["wholesale_product_id"]
    legacy = {"wholesale_status": "품절유무", "wholesale_product_id": "제품번호", "product_code": "도매상품코드", "original_name": "상품명",
              "price_wholesale": "공급단가", "origin": "원산지", "images_list": "그림", "image_detail": "상세이미지"}
    assert missing(legacy, list(legacy.values())) == []
    assert missing({"origin": {"default": "국내"}}, [c for c in columns if c != "원산지"]) == ["wholesale_product_id"]


def test_row_parses_into_standard_options(spark):
    row = parse(spark, BASE, {"wholesale_status": "상태"})
    assert row.wholesale_status == "판매중" and row.price_wholesale == 12000 and not row.warnings
    first, second = row.standard_options
    assert (first.option_sku, first.option_price_delta, first.option_main_image_url, first.option_usable) == ("ABC-001-1", 0, "https://img.example/black.jpg", True)
    assert (second.option_sku, second.option_supply_price, second.option_price_delta, second.option_display_name) == ("ABC-001-2", 13000, 1000, "L")
    assert first.option_group_1 == "옵션" and first.option_status == "판매중"


def test_invalid_status_suppresses_options_and_warns(spark):
    row = parse(spark, {**BASE, "상태": "이상", "원산지": " "}, {"wholesale_status": "상태"})
    assert row.wholesale_status is None and row.standard_options == []
    assert [(w.code, w.field) for w in row.warnings] == [("invalid_wholesale_status", "wholesale_status"), (None, "origin")]


def test_rules_apply_pattern_default_and_value_map(spark):
    mapping = {"product_code": {"source": "상품코드", "pattern": r"(?P<head>[A-Z]+)-(\d+)", "regex_group": "head"},
               "wholesale_status": {"source": "상태", "value_map": {"정상": "품절"}}, "origin": {"default": "해외"},
               "option_values_raw": {"source": "옵션값", "pattern": r"[^,]+", "regex_all": True, "join_with": " , "}}
    row = parse(spark, BASE, mapping)
    assert (row.product_code, row.wholesale_status, row.origin, row.option_values_raw) == ("ABC", "품절", "해외", "블랙 , L")
    assert row.standard_options[0].option_usable is False


def test_unsafe_rules_are_dropped(spark, monkeypatch):
    monkeypatch.setitem(K.RULE_LIMITS, "regex", 300)
    bad = {"origin": {"source": "a", "pattern": r"(a+)+"}, "product_code": {"source": "a", "pattern": "(?<=x)y"}, "price_retail": {"source": "a", "pattern": "x" * 301},
           "original_name": {"source": "a", "pattern": "(", }, "image_detail": {"source": "a", "pattern": "(a)", "regex_group": "2"}, "unknown": "a", "price_min_selling": "zz",
           "wholesale_status": {"source": "a", "default": "y" * 3000}}
    got = {r.field: r for r in mp.sanitize_rules(rules_of(spark, bad), headers_of(spark, ["a"])).collect()}
    assert [f for f, r in got.items() if r.kept] == ["wholesale_status"]
    assert len(got["wholesale_status"].default) == 3000  # whole values, never cut
    assert got["price_min_selling"].warnings == ["Ignored missing source header for price_min_selling: zz"]


def pair(spark, names, prices, deltas=None):
    df = spark.createDataFrame([(names, prices, deltas)], "n string, p string, d string")
    r = op.pair_variants(df, "n", "p", "d").first()
    return r.price_wholesale, [(v.name, v.price_wholesale, v.position) for v in r.option_variants], [(w.field, w.option_count, w.price_count) for w in r.option_warnings]


def test_option_pairing(spark):
    assert pair(spark, "L자형,V자형", "2640,2820") == (2640, [("L자형", 2640, 1), ("V자형", 2820, 2)], [])
    assert pair(spark, "L자형,V자형", "2,640원,2,820원")[1] == [("L자형", 2640, 1), ("V자형", 2820, 2)]
    assert pair(spark, "대(8P),소(32P)", "740,740") == (740, [("대(8P)", 740, 1), ("소(32P)", 740, 2)], [])
    assert pair(spark, None, "3900") == (3900, [], [])
    assert pair(spark, "L자형,V자형", "bad,2820") == (None, [], [("price_wholesale_raw", None, None)])
    assert pair(spark, "L자형,V자형", "2640")[1] == [("L자형", 2640, 1), ("V자형", 2640, 2)]
    assert pair(spark, "a,b,c", "1,2") == (1, [], [("option_variants", 3, 2)])
    assert pair(spark, "a,b", "1000", "0,+500") == (1000, [("a", 1000, 1), ("b", 1500, 2)], [])


def test_export_and_reimport_keep_alignment(spark):
    options = spark.createDataFrame([(1, 2, "화이트", None, 13000, None), (1, 1, "블랙", None, 12000, "b.jpg"), (1, 3, None, "", 1, None)],
                                    "product_id int, option_position int, option_display_name string, option_value_1 string, option_supply_price int, option_main_image_url string")
    r = op.inline_options(options).first()
    assert (r.names, r.prices, r.images) == ("블랙,화이트", "12000,13000", "b.jpg,")


def test_patterns_see_the_whole_cell(spark):
    rule = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("default"), F.lit("end$").alias("pattern"), F.lit(0).alias("regex_group"),
                    F.lit(False).alias("regex_all"), F.lit(",").alias("join_with"), F.lit(None).cast("map<string,string>").alias("value_map"))
    df = spark.createDataFrame([("x" * 6000 + "end",)], "s string")
    assert df.select(mp.apply_rule(F.col("s"), rule)).first()[0] == "end"


def test_large_rules_are_kept(spark):
    values = {f"code {i}": f"value {i}" for i in range(500)}
    pattern = "|".join(f"(?:prefix{i})" for i in range(60)) + "|code [0-9]{1,3}"
    assert len(pattern) > 300
    rules = spark.createDataFrame([("s", "origin", "a", None, pattern, "0", False, None, values, False)], RULE_SCHEMA)
    headers = spark.createDataFrame([("s", "a")], "site string, header string")
    kept = mp.sanitize_rules(rules, headers).first()
    assert kept.kept and kept.warnings == [] and len(kept.value_map) == 500


def test_prices_beyond_the_range_are_told(evaluate):
    rows = [("3,000,000,000원",), ("2147483647",), ("3000000000 / 5",), ("x",), (None,)]
    assert evaluate(rows, "s string", num.is_price_too_large(F.col("s"))) == [True, False, False, False, False]


def test_compiled_rule_sets_equal_rules_from_rows(spark, monkeypatch):
    """Thirty suppliers with eleven rule sets; all sets compiled, some of them (the most used or the short ones), or none."""
    rnd = random.Random(9)
    cells = ["A", "B", "C", "상품명", "가격"]
    choices = [
        lambda: {"source": rnd.choice(cells)}, lambda: {"default": rnd.choice([" x ", "  ", "y"])},
        lambda: {"source": "B", "pattern": rnd.choice([r"(\w)-(\w+)", r"\d+", r"z*"]), "regex_group": rnd.choice([None, "0"])},
        lambda: {"source": "C", "default": "c-1 c-2", "pattern": r"(?P<k>\w+)-\d", "regex_group": "k", "regex_all": True, "join_with": rnd.choice([None, " ", "/"])},
        lambda: {"source": "A", "value_map": rnd.choice([{"a": " b ", "": "empty"}, {"'q'\\": "quote"}, {}])},
        lambda: {"source": "A", "pattern": r"(q|x)", "value_map": {"": "none found", "q": ""}}]
    fields = [*K.TARGET_FIELDS[:9], *K.LEGACY_KEYS.values()]
    sets = [{f: rnd.choice(choices)() for f in fields if rnd.random() < 0.6} for _ in range(11)]
    rules, headers, ledger = [], [], []
    for s in range(30):
        for f, r in sets[s % 11 if s < 28 else 0].items():
            rules.append((f"s{s}", f, r.get("source"), r.get("default"), r.get("pattern"), r.get("regex_group"), r.get("regex_all"), r.get("join_with"), r.get("value_map"), False))
        headers += [(f"s{s}", c) for c in cells]
    for n in range(600):
        values = [rnd.choice([None, "", "  ", "a", "'q'\\", "x-yy 12", " k-1  l-2", "z" * 3000 + "q"]) for _ in cells]
        ledger.append((f"s{rnd.randint(0, 9) if rnd.random() < 0.5 else rnd.randint(0, 31)}", n, None if n % 50 == 0 else dict(zip(cells, values))))
    rules = spark.createDataFrame(rules, RULE_SCHEMA)
    headers = spark.createDataFrame(headers, "site string, header string")
    ledger = spark.createDataFrame(ledger, "site string, row_no bigint, raw map<string,string>")
    got = []
    for most, longest in ((0, 65536), (4, 65536), (64, 500), (64, 65536)):
        monkeypatch.setattr(programs, "LONGEST_SET", longest)
        rows = mp.project_fields(ledger, rules, headers, most)
        assert rows.columns == ["site", "row_no", "raw", *K.TARGET_FIELDS]
        got.append({r.row_no: tuple(r)[3:] for r in rows.collect()})
    for other in got[1:]:
        assert [(k, f, a, b) for k in other for f, a, b in zip(K.TARGET_FIELDS, got[0][k], other[k]) if a != b][:5] == []
    assert {len(g) for g in got} == {600}
    assert len({v for r in got[0].values() for v in r}) > 10
    plan = mp.project_fields(ledger, rules, headers)._jdf.queryExecution().optimizedPlan().toString()
    # The stored table lists its rules column, but nothing is evaluated from it: patterns are constants.
    assert not re.search(r"\(rules#|rules#\d+\[", plan) and "regexp_extract(" in plan
    by_row = mp.project_fields(ledger, rules, headers, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"\(rules#", by_row)


def test_ledgers_without_rules_or_rows(spark):
    rules, headers = rules_of(spark, {}), headers_of(spark, ["상품명"])
    ledger = spark.createDataFrame([("s", 1, {"상품명": " n "}), ("other", 2, {"상품명": "m"})], "site string, row_no bigint, raw map<string,string>")
    assert {r.site: r.original_name for r in mp.project_fields(ledger, rules, headers).collect()} == {"s": "n", "other": None}
    assert mp.project_fields(ledger.limit(0), rules, headers).count() == 0
    none = mp.project_fields(ledger, rules, headers.limit(0))
    assert [r.original_name for r in none.collect()] == [None, None]
