"""The dates that are judged are those of all documents, with months and days that do not exist."""

from florilege.plans import catalogue


def test_all_documents_are_judged(spark, data):
    found = catalogue.queries()["iso_date_valid"](spark, data)
    assert found.columns == ["doc_id", "day", "valid"] and found.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    days = {r.day[5:]: r.valid for r in found.collect()}
    assert not days["00-00"] and any(d.startswith("13-") for d in days) and any(d.endswith("-32") for d in days) and any(days.values())
