import re

import __spark_entry__ as entry
from hubloom.functions import settings as S


def test_all_rows_are_fixed(spark, tmp_path):
    """Whole values, list spellings, other texts and nulls, against the word rule in Python."""
    texts = ["גלעי", "['גלעי']", "['טבעת פנימי', 'צפו']", "גלעין", "תל אבי, מרכ", "פריפריה", "", None]
    spark.createDataFrame(list(enumerate(texts)), "hub_row long, metro_position string").write.parquet(f"{tmp_path}/grouped_hubs.parquet")

    def fixed(t):
        if t is None or t in S.TRUNCATED:
            return S.TRUNCATED.get(t)
        for cut, full in S.TRUNCATED.items():
            t = re.sub(rf"\b{cut}\b", full, t)
        return t

    got = {r.hub_row: r.fixed for r in entry.queries()["fix_truncation"](spark, str(tmp_path)).collect()}
    assert got == {k: fixed(t) for k, t in enumerate(texts)} and got[1] == "['גלעין']"
