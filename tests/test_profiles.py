"""Fallbacks and edge cases of nested records, lists and chunks on small fixtures."""

import json

from pyspark.sql import functions as F

from dealspark.functions import scalars as S
from dealspark.operators import normalize, profiles, text, views


def test_lists_keep_digits(spark):
    df = spark.createDataFrame([("10 Fund, 0x ,1",)], "x string")
    assert df.select(S.split_list("x", ",").alias("y")).first()["y"] == ["10 Fund", "0x", "1"]


def test_chunks_keep_digits(spark):
    df = spark.createDataFrame([("0 nought 0\n\n" + "1" * 30,)], "x string")
    assert df.select(text.pack(F.col("x"), 20).alias("y")).first()["y"] == ["0 nought 0", "1" * 20, "1" * 10]


def flat(spark, **record):
    return profiles.flatten_company(spark.createDataFrame([(json.dumps(record),)], "json string")).first()


def test_company_shapes(spark):
    full = flat(spark, id="1", latestRevenue={"amount": {"INR": {"value": 125000000}, "USD": {"value": 1500000}}, "asOnDate": {"year": 2024, "month": 3}}, keyPeople=[{"name": {"firstName": "Asha", "lastName": "Rao"}, "roles": ["CEO"]}, {"person": {"name": "Ravi Sen"}}])
    assert (full.revenue_inr_cr, full.revenue_usd_m, full.revenue_as_on, full.key_people) == (12.5, 1.5, "2024-03-01", "Asha Rao (CEO); Ravi Sen")
    loss = flat(spark, id="2", latestNetProfit={"amount": {"INR": {"value": -30000000}}})
    assert loss.net_profit_inr_cr == -3.0 and loss.net_profit_as_on == ""
    usd = flat(spark, id="3", latestValuation={"amount": {"USD": {"value": 2000000}}}, totalEquityFunding={"amount": {"USD": {"value": 500000}}})
    assert usd.valuation_inr_cr is None and usd.valuation_usd_m == 2.0 and usd.total_equity_funding_usd_m == 0.5
    none = flat(spark, id="4")
    assert (none.investors, none.city, none.sector, none.founded) == ("", "", "", None)


def test_filing_without_id(spark):
    df = spark.createDataFrame([("c1", "Acme", json.dumps({"name": "Form MGT 7"})), ("c1", "Acme", json.dumps({"id": "9", "name": "Form MGT 7"}))], "company_id string, company_name string, json string")
    assert sorted(r["viewer_url"] for r in profiles.flatten_filing(df, "https://x").collect()) == ["", "https://x/a/d/document/9/formmgt7"]


def test_profile_fallbacks(spark):
    rows = [
        ("a", json.dumps({"publicIdentifier": "asha-rao", "location": {"countryCode": "in", "parsed": {"text": "Pune"}}})),
        ("b", json.dumps({"name": " Ravi  Sen ", "location": {"linkedinText": "Paris, France"}, "currentPosition": [{"companyName": "X", "position": "CEO"}]})),
        ("c", "{}"), ("d", None),
    ]
    got = {r["id"]: (r["name"], r["location_city"], r["location_country"], r["current_title"]) for r in profiles.parse_profile(spark.createDataFrame(rows, "id string, json string"), "id").collect()}
    assert got == {"a": ("Asha Rao", "Pune", "India", None), "b": ("Ravi Sen", "Paris", "France", "CEO"), "c": ("", None, None, None)}


def test_company_profile_lists(spark):
    rows = [("a", json.dumps({"specialties": ["x", "y"], "industries": ["Steel"], "logo": {"url": "u"}})), ("b", json.dumps({"specialities": "x, y", "industry": "Glass", "companySize": "2-10"}))]
    got = {r["id"]: (r["specialties"], r["industry"], r["company_size"], r["logo_url"]) for r in profiles.parse_company_profile(spark.createDataFrame(rows, "id string, json string"), "id").collect()}
    assert got == {"a": (["x", "y"], "Steel", None, "u"), "b": (["x", "y"], "Glass", "2-10", None)}


def test_names_are_not_taken_twice(spark):
    people = spark.createDataFrame([("1", "Navin"), ("2", "Navin Sen"), ("3", "Tara"), ("4", "Tar")], "id string, canonical string")
    found = spark.createDataFrame([("1", "Navin Sen"), ("3", "Tara Das"), ("4", "Tara Das")], "id string, name string")
    assert {r["id"]: r["canonical"] for r in profiles.upgrade_names(people, found).collect()} == {"1": "Navin", "2": "Navin Sen", "3": "Tara Das", "4": "Tar"}


def test_placeholders(spark):
    df = spark.createDataFrame([("Active US Founder",), ("Asha Rao",)], "x string")
    assert [r["y"] for r in df.select(views.not_placeholder("x").alias("y")).collect()] == [False, True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, json string")
    p = profiles.parse_profile(none, "id")
    assert profiles.profile_edges(p, "id", spark.createDataFrame([], "company_name string, id string")).count() == 0
    assert profiles.flatten_company(none).count() == 0


def test_mentions_both_ways(spark):
    texts = ["Great Acme\nco here", "acme", "", None, "x😀Zed One😀", "zed on", "ACME CO"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {"a": "Acme\nCo", "b": "zed one", "c": "abc", "d": "acme", "e": "acme", "f": None, "g": "😀zed"}
    spine = spark.createDataFrame(list(names.items()), "id string, canonical string")
    want = {(i, k) for i, t in enumerate(texts) for k, n in names.items() if t and n and len(n) >= 4 and n.lower() in t.lower()}
    for small in (4096, 0):
        got = [(r["doc_id"], r["id"]) for r in normalize.mentions(docs, spine, small=small).collect()]
        assert set(got) == want and len(got) == len(want)
    assert normalize.mentions(docs, spine.where("false")).count() == 0
