"""Property tests: the count normaliser equals a plain-Python statement of its rules."""
import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.functions.normalize import ASCII, FULL_WIDTH, MULTIPLIERS, UNITS, normalize_count

PIECES = list("0123456789,.") + list(FULL_WIDTH) + list(MULTIPLIERS) + list(UNITS) + ["x", " ", "-"]


def expected(text):
    if text is None:
        return None
    t = text.translate(str.maketrans(FULL_WIDTH, ASCII)).strip(" ")
    if t == "":
        return 0
    m = re.fullmatch(r"([0-9][0-9,]*(?:[.][0-9]+)?)(万|千)?(" + "|".join(UNITS) + ")?", t)
    if not m:
        return None
    number, mult = m.group(1), m.group(2)
    if "." in number and not mult:
        return None
    digits = number.replace(",", "")
    if len(digits.split(".")[0]) > 17:      # beyond the decimal(24, 6) used for parsing
        return None
    value = Decimal(digits) * (MULTIPLIERS[mult] if mult else 1)
    return int(value.to_integral_value(rounding="ROUND_FLOOR"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=1, max_size=40))
def test_counts_match_python_rules(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(normalize_count("t").alias("v")).collect()]
    assert got == [expected(t) for t in texts]
