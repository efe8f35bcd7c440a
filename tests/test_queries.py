import compare
import pytest

from murmur.functions.text import dominant_script, normalize
from murmur.plans import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    got, wanted = compare.both(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER)
    assert len(got) == len(wanted)
    assert got == wanted
    assert got


def test_normalize():
    assert normalize("Visit the Café, today!")[0] == "visit the cafe today"
    assert normalize("Straße")[0] == "strasse"
    assert normalize("  a​--b ") == ("a b", [2, 4, 6])
    assert dominant_script("नमस्ते abc") == "DEVANAGARI"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
