"""Each branch of the answer composer, its budget and its confidence; flat records and back."""

import json

import pytest
from pyspark.sql import functions as F

from callweave.operators import compose
from callweave.sources import flat, readers

CASES = [
    ("no_answer", "price", False, {"fees": {"total": 5}}, "I do not have that on record. I can connect you to a person."),
    ("not_offered", "price", True, {"not_offered": ["B.Com"], "offered_instead": ["BBA", "BCA"]}, "B.Com is not offered here. Instead there is BBA, BCA."),
    ("comparison", "comparison", True, {"fees": {"total": 10}, "other": {"total": 2000}}, "The first costs INR 10 and the second INR 2,000."),
    ("price_both", "price", True, {"fees": {"total": 40, "annual": 10, "note": "Paid in June!"}}, "The fee is INR 10 a year. INR 40 in total. Paid in June!"),
    ("price_annual", "price", True, {"fees": {"annual": 10}}, "The fee is INR 10 a year."),
    ("price_total", "price", True, {"fees": {"total": 40}}, "The total fee is INR 40."),
    ("price_unpublished", "price", True, {"fees": {"published": False}}, "The fee is not published yet. The office can confirm it."),
    ("loan", "loan", True, {"loan_published": False}, "No loan details are published."),
    ("refund", "refund", True, {"refund_published": True}, "The refund rules are published."),
    ("eligibility", "eligibility", True, {"eligibility": "Half of the marks"}, "Half of the marks."),
    ("eligibility_which", "eligibility", True, {}, "Which programme do you mean."),
    ("exam", "exam", True, {"tests": ["CET", "JEE"]}, "Accepted tests are CET, JEE."),
    ("process", "process", True, {"steps": ["apply", "pay"]}, "The steps are apply, pay."),
    ("dates", "dates", True, {"important_dates": ["1 June"]}, "Dates to note are 1 June."),
    ("scholarship", "scholarship", True, {"scholarship_types": ["merit"]}, "There are scholarships for merit."),
    ("hostel", "hostel", True, {"hostel_available": True, "hostel_status": "Full"}, "Rooms are available. Full."),
    ("placement", "placement", True, {"package": 500000, "recruiters": ["A"]}, "The average package is INR 500,000. Recruiters include A."),
    ("contact", "contact", True, {"email": "a@b.org"}, "The email is a@b.org."),
    ("documents", "documents", True, {"documents_required": ["a photo"]}, "You need a photo."),
    ("transport", "transport", True, {"by_rail": "By train", "facilities": ["a bus"]}, "By train. On site there are a bus."),
    ("catalogue", "catalogue", True, {"programmes": ["BBA"]}, "You can choose from BBA."),
    ("overview", "other", True, {"answer": "It is so.", "seats": 60}, "It is so. There are 60 seats."),
    ("no_answer", "other", True, None, "I do not have that on record. I can connect you to a person."),
]
SCHEMA = "i int, intent string, grounded boolean, verified boolean, stale boolean, score double, f string"


def rows(spark, cases):
    return spark.createDataFrame(cases, SCHEMA).withColumn("facts", F.try_parse_json("f"))


def test_every_branch(spark):
    assert {c[0] for c in CASES} == {b[0] for b in compose.BRANCHES}
    frame = rows(spark, [(i, intent, grounded, True, False, 0.5, None if facts is None else json.dumps(facts)) for i, (_, intent, grounded, facts, _) in enumerate(CASES)])
    got = {r.i: (r.branch, r.answer, r.confidence) for r in compose.compose(frame).collect()}
    assert got == {i: (c[0], c[4], 0.5) for i, c in enumerate(CASES)}


def test_budget_confidence_and_own_branches(spark):
    facts = json.dumps({"answer": "a" * 50, "seats": 60, "fees": {"total": 4}})
    frame = rows(spark, [(0, "other", True, True, False, 2.0, facts), (1, "price", True, False, True, 0.5, facts), (2, None, None, None, None, None, facts), (3, "other", True, True, True, 0.01, "no json")])
    got = {r.i: r for r in compose.compose(frame, budget=60).collect()}
    assert got[0].answer == "a" * 50 + "." and got[0].confidence == 0.95
    assert got[1].confidence == round(0.5 * 0.8 * 0.85, 3) and got[2].confidence == 0.05 and got[3].branch == "no_answer"
    assert {r.answer for r in compose.compose(frame, [("only", "num(seats) > 10", ["concat(fact(seats), ' x')"])]).collect()} == {"60 x.", ""}
    assert compose.compose(frame.limit(0)).count() == 0


FIELDS = [("id", "id", "int"), ("title", "title", "text"), ("tags", "tags", "list"), ("ok", "ok", "bool"), *[(f"f{k}", f"structured.g{k % 5}.v{k}", ("text", "int", "float", "bool", "list")[k % 5]) for k in range(46)]]


def test_fifty_columns_through_csv_and_back(spark, tmp_path):
    value = lambda k: [f'say "{k}", please', k, k + 0.5, k % 2 == 0, [f"a{k}", "b c"]][k % 5]
    made = [(i, f"t, {i}", ["x", "y"] if i % 2 else None, i % 3 == 0, json.dumps({f"g{g}": {f"v{k}": value(k) for k in range(46) if k % 5 == g and (k + i) % 4} for g in range(5)})) for i in range(30)]
    records = spark.createDataFrame(made, "id long, title string, tags array<string>, ok boolean, s string").select("id", "title", "tags", "ok", F.parse_json("s").alias("structured"))
    shown = flat.flatten(records, FIELDS)
    assert len(shown.columns) == 50 and shown.filter("f3 not in ('true', 'false', '')").isEmpty()
    readers.write_csv(shown, str(tmp_path / "csv"))
    back = flat.unflatten(readers.read_csv(spark, str(tmp_path / "csv")), FIELDS)
    again = {r.id: (r.title, r.tags, r.ok, json.loads(r.s)) for r in back.withColumn("s", F.to_json("structured")).drop("structured").collect()}
    assert again == {i: (t, tags, ok, {g: v for g, v in json.loads(s).items() if v}) for i, t, tags, ok, s in made}


def test_template_has_one_row_that_reads_back(spark):
    one = flat.template(spark, FIELDS)
    assert one.columns == [f[0] for f in FIELDS] and one.count() == 1
    assert flat.unflatten(one, FIELDS).select("id", "tags", "ok", F.variant_get("structured", "$.g2.v2", "double").alias("x")).first() == (4, ["one", "two"], True, 1.5)
    with pytest.raises(Exception):
        flat.unflatten(one, [("nowhere", "a", "text")]).count()
