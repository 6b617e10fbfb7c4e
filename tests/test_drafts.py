import datetime as dt

import pytest
from pyspark.sql import functions as F

from wareloom.operators import drafts as dr
from wareloom.operators import keywords as kw
from wareloom.operators import quality as qa
from wareloom.operators import reads as rd
from wareloom.sources import writers as wr

DRAFT = "draft_id int, product_id int, account_id int, draft_kind string, status string, version timestamp_ntz, sale_price int, override_patch string"


def day(n, micros=0):
    return dt.datetime(2024, 1, n, 0, 0, 0, micros)


def test_upsert_is_guarded_by_version(spark):
    drafts = spark.createDataFrame([
        (1, 1, 1, "create", "ready", day(1), 10, "p"), (2, 2, 1, "create", "ready", day(9), 10, None), (3, 3, 1, "create", "submitting", day(1), 10, None),
        (4, 4, 1, "create", "submitted", day(1), 10, None), (5, 5, 1, "create", "failed", day(2), 10, None)], DRAFT)
    results = spark.createDataFrame([(i, 1, day(2, 500), 99) for i in (1, 2, 3, 4, 5)], "product_id int, account_id int, version timestamp_ntz, sale_price int")
    got = sorted(((r.product_id, r.draft_id, r.action, r.status, r.sale_price, r.override_patch) for r in dr.upsert_drafts(drafts, results).collect()), key=str)
    assert got == sorted([
        (1, 1, "update", "needs_review", 99, "p"), (2, 2, "keep", "ready", 10, None), (3, 3, "keep", "submitting", 10, None),
        (4, None, "insert", "needs_review", 99, None), (4, 4, "keep", "submitted", 10, None), (5, 5, "update", "needs_review", 99, None)], key=str)


def test_submission_gate_and_attempts(spark):
    drafts = spark.createDataFrame([(1, 7, "ready", "valid", '{"a":1}', '{"a":2}'), (2, 7, "submitting", "valid", "{}", None), (3, 7, "ready", "blocked", "{}", None)],
                                   "draft_id int, account_id int, status string, validation_status string, generated_payload string, override_patch string")
    requests = spark.createDataFrame([("ok", 7, 1), ("ok", 7, 1), ("status", 7, 2), ("blocked", 7, 3), ("other", 8, 1)], "job_id string, account_id int, draft_id int")
    gate = {r.job_id: r.refused for r in dr.submission_gate(drafts, requests).collect()}
    assert gate == {"ok": None, "status": "draft status", "blocked": "blocked drafts", "other": "drafts not found"}
    attempts = dr.submission_attempts(drafts, requests)
    assert [(r.draft_id, r.submitted_payload) for r in attempts.collect()] == [(1, '{"a":2}')]
    assert {r.draft_id: r.status for r in dr.mark_submitting(drafts, attempts).collect()}[1] == "submitting"


def test_guarded_delete(spark):
    products = spark.createDataFrame([(1,), (2,), (3,)], "product_id int")
    mappings = spark.createDataFrame([(1, "synced"), (2, "draft")], "product_id int, sync_status string")
    targets = spark.createDataFrame([(1,), (2,)], "product_id int")
    report, left, mapped = rd.guarded_delete(products, mappings, targets)
    assert tuple(report.first()) == (False, 0, 1) and left.count() == 3 and mapped.count() == 2
    report, left, mapped = rd.guarded_delete(products, mappings, targets, force=True)
    assert tuple(report.first()) == (True, 2, 0) and [r.product_id for r in left.collect()] == [3] and mapped.count() == 0


def test_issue_report_is_capped_with_a_closing_row(spark):
    schema = "product_id int, supplier_id int, supplier_product_code string, raw_product_name string, supplier_status string, origin string, supply_price int, main_image_url string, last_seen_on date"
    rows = [(i, 1, f"C{i:03}", "n", "available", None, 1, "x", None) for i in range(50)] + [(99, 1, "C999", None, "available", "kr", 1, "x", None)]
    products = spark.createDataFrame(rows, schema)
    options = spark.createDataFrame([(1,)], "product_id int")
    report = qa.issue_list(products, options).collect()
    assert len(report) == 51 and (report[0].severity, report[0].code) == ("error", "missing_raw_product_name")
    assert [(r.severity, r.hidden) for r in report if r.code == "more_issues"] == [("warning", 1)]
    assert [r.code for r in qa.issue_list(products, options, supplier_id=5).collect()] == ["empty_scope"]
    before = qa.scope_fingerprint(products, options).first()[0]
    assert before == qa.scope_fingerprint(products.repartition(3), options).first()[0]
    assert before != qa.scope_fingerprint(products.filter("product_id <> 7"), options).first()[0]


def test_partial_category_match_equals_brute_force(spark):
    paths = ["가구>의자>사무용 의자", "가구>책상", "생활>의자 커버", "aab>bab"]
    dictionary = kw.read_dictionary(spark.createDataFrame([(p, i, i) for i, p in enumerate(paths)], "path string, category_id int, ord int"))
    terms = ["의자", "책", "의자 커버", "없음", "ab", "b", ">"]
    got = {r.term: r.path for r in kw.first_paths_containing(spark.createDataFrame([(t,) for t in terms], "term string"), dictionary).collect()}
    assert got == {t: next(p for p in paths if t in p) for t in terms if any(t in p for p in paths)}


def test_brand_screen_keeps_unlisted_and_unjudged_keywords(spark):
    scored = spark.createDataFrame([(1, "good one", 13), (1, "brandish", 10), (1, "나이키 신발", 13), (2, "alone", 10)], "product_id int, keyword string, score int")
    verdicts = spark.createDataFrame([(1, "brandish", "brand_suspected")], "product_id int, keyword string, verdict string")
    got = sorted((r.kind, r.product_id, r.keyword, r.rank) for r in kw.screen_brands(scored, verdicts).collect() if r.kind == "kept")
    assert got == [("kept", 1, "good one", 1), ("kept", 2, "alone", 1)]
    assert [(r.product_id, r.keyword) for r in kw.screen_brands(scored, verdicts).filter("kind = 'warning'").collect()] == [(1, "brandish")]


def test_empty_export_is_an_error(spark, tmp_path):
    with pytest.raises(wr.NothingToExport):
        wr.write_processed_export(spark.range(0), str(tmp_path / "out"))


def test_missing_key_fields_block_saving(spark):
    results = spark.createDataFrame([("a", "raw_product_name", "Ring", "u1", None), ("a", "supply_price", "1,000", "u1", None), ("a", "origin", "상품명 : x", "u1", None),
                                     ("a", "supplier_product_code", "https://x", "u1", None)], "source string, field string, value string, url string, images int")
    got = {r.field: (r.ok, r.role) for r in qa.field_summary(results).collect()}
    assert got == {"raw_product_name": (True, None), "supply_price": (True, None), "main_image_url": (False, "blocks"), "supplier_product_code": (False, "blocks"), "origin": (False, "warns")}
    sources = spark.createDataFrame([("a", False), ("b", False), ("a2", True)], "source string, stale boolean")
    assert {r.source: r.reason for r in qa.save_gate(sources, results).collect()} == {"a": "failed", "b": "missing", "a2": "missing"}


def test_candidate_links_with_a_hot_source_equal_brute_force(spark):
    links = [("hot", i, f"http://s/{'view' if i % 3 else 'other'}?pid={i % 700}", "img" if i % 2 else "", f"n{i}" if i % 5 else None) for i in range(2000)] + [("cold", 1, "http://s/cart/x", "", "n")]
    df = spark.createDataFrame(links, "source string, ord int, url string, image_url string, name string")
    refs = spark.createDataFrame([("cold", "http://s/nothing")], "source string, reference_url string")
    got = [(r.url, r.score) for r in qa.candidate_links(df, refs).orderBy("rank").collect()]
    ranked = sorted(((-(2 * bool(im) + bool(nm)), o, u) for _, o, u, im, nm in links[:2000] if "/view" in u))
    want, seen = [], set()
    for score, _, url in ranked:
        if url not in seen and len(want) < 15:
            seen.add(url)
            want.append((url, -score))
    assert got == want


@pytest.fixture()
def market_row(spark):
    from wareloom.operators import options as op
    from wareloom.operators import pricing as pr
    from wareloom.plans.pricing import policy
    df = spark.createDataFrame([(1, "v1", "Acme", "ladder", ["step"], "KR", 8000, [" a.jpg ", "", "b.jpg"], "<p>", "50", None, None, None, policy(), False)],
                               "product_id int, version string, brand_name string, refined_name string, keywords array<string>, origin string, cost_price bigint, images_list array<string>, "
                               "detail_content string, category_id string, market_name string, attributes string, listing_defaults string, policy_json string, policy_invalid boolean")
    df = df.withColumns({"standard_options": F.array().cast(f"array<{op.STANDARD_OPTION}>"),
                         "option_variants": F.array(F.struct(F.lit("Red").alias("name"), F.lit(900).alias("price_wholesale"), F.lit(1).alias("position"))).cast(op.VARIANTS)})
    return pr.price_listings(pr.parse_policies(df))


def test_plain_variants_reach_both_markets(market_row):
    import json
    a = dr.market_a_drafts(market_row).first()
    info = json.loads(a.generated_payload)["originProduct"]
    assert (a.display_title, a.sale_price, a.validation_status) == ("Acme ladder step", 17200, "valid")
    assert info["detailAttribute"]["optionInfo"] == {"optionCombinations": [{"name": "Red", "price_wholesale": 900, "position": 1}]}
    assert info["images"] == {"representativeImage": {"url": "a.jpg"}, "optionalImages": [{"url": "b.jpg"}]}
    b = json.loads(dr.market_b_drafts(market_row).first().generated_payload)
    assert b["items"][0]["attributes"] == [{"attributeTypeName": "옵션", "attributeValueName": "Red"}]
    assert [i["imageType"] for i in b["items"][0]["images"]] == ["REPRESENTATION", "DETAIL"]
    assert b["pricing"]["proposedSalePrice"] == 17200


def test_stored_attributes_count_bare_or_under_their_key(market_row):
    import json
    bare = F.lit('[{"attributeSeq":"1","attributeRealValue":"x"}]')
    nested = F.lit('{"naver_attributes":[{"attributeSeq":"1","attributeRealValue":"x"}]}')
    for stored in (bare, nested):
        row = dr.market_a_drafts(market_row.withColumn("attributes", stored)).first()
        assert json.loads(row.generated_payload)["originProduct"]["detailAttribute"]["productAttributes"] == [{"attributeSeq": "1", "attributeRealValue": "x"}]
