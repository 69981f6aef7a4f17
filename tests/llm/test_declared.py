import pytest

from framelake.llm import language_id

from .test_models import profiles


@pytest.mark.parametrize("before", ["<!-- " + "licence " * 2000 + "-->", "\n" * 9000, "<script>var x = '<html lang=\"de\">';" + "x();" * 3000 + "</script>", "<!DOCTYPE html><html data-x='" + "y" * 5000 + "'"])
def test_declaration_behind_any_length(before):
    tag = " lang='fr'>" if "data-x" in before else "<HTML Lang='fr'>"
    assert language_id.declared_language(before + tag + "<body>") == "fr"


def test_declaration_on_odd_pages():
    assert language_id.declared_language("<!-- <html lang='de'> --><html class='x'><p>no</p>") is None
    assert language_id.declared_language("<html class='x'><html lang=EN-us>") == "en"
    assert language_id.declared_language("<!--[if gt IE 8]><!--><html lang=fr><!--<![endif]-->") == "fr"
    assert language_id.declared_language("<!-- never closed <html lang='de'>") is None
    assert language_id.declared_language(None) is None and language_id.declared_language("<html") is None


def test_late_declaration_is_evidence(spark):
    df = spark.createDataFrame([(1, "http://a.com", "\n" * 9000 + "<html lang='fr'><p>12</p>"), (2, "http://b.com", "<p>12</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language_id.identify(spark, df, profiles()).collect()} == {1: "fr", 2: None}
