"""Secrets whose prefix is in capitals."""

from __future__ import annotations

import re


def test_prefixes_in_capitals(spark):
    from kelvora.llm import pii

    values = [('TOKEN = "', "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"), ("PASSWORD: ", "correcthorse"), ("Api_Key=", "Qwertyuiop"), ("Secret = ", "abc_defg-hij"), ("PASSWD=", "ABCDEFGHIJ")]
    out = {r.doc_id: r for r in pii.apply(spark.createDataFrame([(i, f"x {h}{v} y") for i, (h, v) in enumerate(values)], "doc_id long, text string"), counts=True).collect()}
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    for i, (h, v) in enumerate(values):
        got = out[i].text
        assert got.startswith(f"x {h}") and got.endswith(" y") and v not in got and shape(got) == shape(f"x {h}{v} y")
        assert out[i].pii_secret == out[i].pii_values == 1
