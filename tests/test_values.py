import random
import re

import pytest

from maskwright.operators import values


def _fold(text, entries, mask="█"):
    """Value by value over the whole text, longest first."""
    low = values.lowered(text)[0]
    for ph, value in sorted(entries, key=lambda r: (-len(r[1]), r)):
        made = values.form(value)
        if made is None:
            continue
        body, left, right = made
        pattern = re.compile((r"(?<!\w)" if left else "") + body + (r"(?!\w)" if right else ""))
        at = 0
        while m := pattern.search(low, at):
            low = low[: m.start()] + "\0" * (m.end() - m.start()) + low[m.end() :]
            at = m.end()
    cut = re.sub("\0+", lambda m: "\0" * len(m[0]), low)
    return "".join(mask if z == "\0" else c for c, z in zip(text, cut, strict=True))


def test_equals_the_fold_of_patterns(spark, monkeypatch):
    random.seed(8)
    alphabet = "ab1 -.\né_A"
    word = lambda n: "".join(random.choice(alphabet) for _ in range(n))
    entries = [(f"[P_{i}]", word(random.randint(1, 9))) for i in range(120)]
    entries += [("[N_1]", "Valentino Morandi"), ("[N_2]", "-\ntino Morandi"), ("[N_3]", "Rossi"), ("[N_4]", "Mario Rossi"), ("[N_5]", "x"), ("[N_6]", "05"), ("[N_7]", "C++ ab")]
    texts = [word(60) for _ in range(150)] + ["Valen-\ntino  morandi e MARIO\nROSSI, rossini, Rossi_", "", None, "mario-rossi Mario­\n Rossi c++ab 05 x"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    v = spark.createDataFrame([*entries, (None, "a"), ("[Z]", None)], "ph string, value string")
    for size in (100_000, 40):  # one slice, several
        monkeypatch.setattr(values, "SLICE_VALUES", size)
        got = {r.id: (r.text, r.found) for r in values.find_values(d, v).collect()}
        for i, t in enumerate(texts):
            shown = list(t or "")
            for s in got[i][1]:
                shown[s.start : s.end] = "█" * (s.end - s.start)
            assert "".join(shown) == _fold(t or "", entries), repr(t)
    assert got[150][1][0].ph == "[N_1]" and [s.ph for s in got[150][1]] == ["[N_1]", "[N_4]"]


def test_redaction_leaves_nothing(spark):
    d = spark.createDataFrame([(1, "Ada Lovelace met ada\nlovelace; Adam."), (2, None)], "id int, text string")
    v = spark.createDataFrame([("[N_1]", "Ada Lovelace"), ("[N_2]", "Ada"), ("[N_3]", "7")], "ph string, value string")
    out = values.redact_values(d, v)
    assert [r.redacted for r in out.orderBy("id").collect()] == ["█ met █; Adam.", None]
    assert [r.left for r in values.residual_values(d, v).orderBy("id").collect()] == [["[N_1]"], []]
    assert [r.left for r in values.residual_values(out.select("id", "redacted"), v, "redacted").orderBy("id").collect()] == [[], []]


def test_a_dictionary_beyond_all_slices_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(values, "SLICE_VALUES", 1)
    monkeypatch.setattr(values, "SLICES", 2)
    with pytest.raises(ValueError):
        values.slices(spark.createDataFrame([(str(i), "value" + str(i)) for i in range(3)], "ph string, value string"))
