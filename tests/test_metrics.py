import math
import random

import pytest
from pyspark.sql import functions as F

from changelens.functions import context as C
from changelens.functions.metrics import METRIC_NAMES, metric_type, metrics_two_sided, with_metrics

CODE = "import numpy\ndef f(x):\n    try:\n        return x**2 // 3\n    except Exception:\n        raise\n"
LOOPS = "if x and y:\n    for i in z:\n        pass\nelse:\n    while 1: break\n"
METHOD = "class A:\n  def f(self): return self.x.y  # bug: error\n"


def _bits(*counts):
    """Entropy in bits of tokens with these counts."""
    return sum(c / sum(counts) * math.log2(sum(counts) / c) for c in counts)


# Worked out by hand from the definitions; what is not named is 0.
BY_HAND = {
    "": {},
    "\n \n\t\n": dict(loc=3, num_empty_lines=3, length=5, avg_line_length=2 / 3, empty_ratio=1.0),
    "a\r\nb\rc\x0bd\u2028e\n": dict(loc=5, length=11, avg_line_length=1.0, code_density=1.0,
                                    token_entropy=_bits(1, 1, 1, 1, 1), num_indent_levels=1, avg_words_per_line=1.0),
    "a\xa0b\x1cc\u3000d": dict(loc=2, length=7, avg_line_length=3.0, code_density=1.0, token_entropy=2.0,
                               num_indent_levels=1, avg_words_per_line=2.0),
    CODE: dict(loc=6, length=93, avg_line_length=14.5, num_defs=1, num_imports=1, has_try_except=1, uses_numpy=1,
               has_return=1, has_raise=1, code_density=1.0, token_entropy=_bits(*[1] * 12), num_indent_levels=3,
               num_decision_points=2, avg_indent_length=4.0, max_indent_length=8, num_operators=6,
               avg_words_per_line=2.0, num_error_keywords=1 / 6),
    " \tx = 1": dict(loc=1, length=7, avg_line_length=7.0, code_density=1.0, token_entropy=_bits(1, 1, 1),
                     num_indent_levels=1, has_tab_mix=1, avg_indent_length=1.0, max_indent_length=1,
                     avg_words_per_line=3.0),
    "\tx = 1": dict(loc=1, length=6, avg_line_length=6.0, code_density=1.0, token_entropy=_bits(1, 1, 1),
                    num_indent_levels=1, avg_words_per_line=3.0),
    "f((x)": dict(loc=1, length=5, avg_line_length=5.0, code_density=1.0, num_indent_levels=1,
                  has_unclosed_parens=1, avg_words_per_line=1.0),
    "x = 1  # TODO fix\n# FixMe\nTODO": dict(
        loc=3, length=30, avg_line_length=28 / 3, num_comments=2, comment_ratio=2 / 3, code_density=1.0,
        token_entropy=_bits(2, 2, 1, 1, 1, 1, 1), num_indent_levels=1, num_todo_comments=2, todo_ratio=2 / 3,
        avg_words_per_line=3.0),
    '"""a""" """b""" """ \'\'\' \'\'\'': dict(
        loc=1, length=27, avg_line_length=27.0, code_density=1.0, token_entropy=_bits(1, 1, 1, 2),
        num_indent_levels=1, avg_words_per_line=5.0, num_docstrings=3),
    "a\n a\nb": dict(loc=3, length=6, avg_line_length=4 / 3, code_density=1.0, token_entropy=_bits(2, 1),
                     num_indent_levels=2, repetition_score=1 / 3, avg_indent_length=1 / 3, max_indent_length=1,
                     avg_words_per_line=1.0),
    "a # b\n# c\n  d": dict(loc=3, length=13, avg_line_length=11 / 3, num_comments=2, comment_ratio=2 / 3,
                           code_density=1.0, token_entropy=_bits(1, 2, 1, 1, 1), num_indent_levels=2,
                           avg_indent_length=2 / 3, max_indent_length=2, avg_words_per_line=2.0),
    "a\n\n": dict(loc=2, length=3, num_empty_lines=1, avg_line_length=0.5, empty_ratio=0.5, code_density=0.5,
                  num_indent_levels=1, avg_words_per_line=1.0),
    LOOPS: dict(loc=5, length=66, avg_line_length=12.2, has_if_else=1, code_density=1.0,
                token_entropy=_bits(*[1] * 13), num_indent_levels=3, num_decision_points=3, avg_indent_length=3.2,
                max_indent_length=8, avg_words_per_line=2.6),
    METHOD: dict(loc=2, length=54, avg_line_length=26.0, num_defs=1, num_classes=1, has_return=1, num_comments=1,
                 comment_ratio=0.5, code_density=1.0, token_entropy=_bits(*[1] * 9), num_indent_levels=2,
                 num_external_calls=1.0, avg_indent_length=1.0, max_indent_length=2, avg_words_per_line=4.5,
                 num_error_keywords=1.0),
    "import torch, cv2\nx % y - z + 1\n": dict(
        loc=2, length=32, avg_line_length=15.0, num_imports=1, uses_torch=1, uses_cv2=1, code_density=1.0,
        token_entropy=_bits(*[1] * 10), num_indent_levels=1, num_operators=3, avg_words_per_line=5.0),
}
ADDITIVE = ["loc", "num_defs", "num_classes", "num_imports", "num_comments", "num_empty_lines", "length",
            "num_decision_points", "num_todo_comments", "num_operators"]


def _rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return with_metrics(df, "t").orderBy("id").collect()


def test_values_worked_out_by_hand(spark):
    for text, r in zip(BY_HAND, _rows(spark, list(BY_HAND))):
        for name in METRIC_NAMES:
            assert r[name] == pytest.approx(BY_HAND[text].get(name, 0), abs=1e-12), (text, name)


def test_every_metric_is_non_zero_somewhere():
    assert {n for row in BY_HAND.values() for n in row} == set(METRIC_NAMES)


def test_counts_add_up_over_lines(spark):
    """A text's counts are the sums over its lines; ratios follow from counts."""
    rnd = random.Random(11)
    parts = ["a", "b", " ", "\t", "#", "(", ")", ".", "if ", "for ", " and ", " or ", "try:", "except", "todo", "FIXME",
             "**", "//", "-", "+", "%", "é", "😀", "error", "Bug", "  ", "def ", "class ", "import "]
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x85", "\u2028", "\u2029"]
    lines = [["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) + rnd.choice(ends)
              for _ in range(rnd.randint(1, 7))] for _ in range(80)]
    # a line feed right after a carriage return would be one end, not two
    lines = [[x for x in text if x not in ("\n", "\r\n")] or ["a\n"] for text in lines]
    whole = _rows(spark, ["".join(x) for x in lines])
    single = iter(_rows(spark, [x for text in lines for x in text]))
    for text, r in zip(lines, whole):
        own = [next(single) for _ in text]
        for name in ADDITIVE:
            assert r[name] == sum(x[name] for x in own), (text, name)
        assert r["max_indent_length"] == max(x["max_indent_length"] for x in own)
        assert r["has_tab_mix"] == max(x["has_tab_mix"] for x in own)
        loc = len(text)
        assert r["comment_ratio"] == pytest.approx(r["num_comments"] / loc)
        assert r["empty_ratio"] + r["code_density"] == pytest.approx(1.0)
        assert r["todo_ratio"] == pytest.approx(r["num_todo_comments"] / loc)
        full = [x for x in own if not x["num_empty_lines"]]
        if full:
            assert r["avg_words_per_line"] == pytest.approx(sum(x["avg_words_per_line"] for x in full) / len(full))
            assert r["avg_indent_length"] == pytest.approx(sum(x["avg_indent_length"] for x in full) / len(full))


def test_entropy_depends_on_token_counts_only(spark):
    one, shuffled, twice = _rows(spark, ["a b b c c c d", "c a c\nb\td c b", "a b b c c c d " * 2])
    assert one["token_entropy"] == pytest.approx(_bits(1, 2, 3, 1))
    assert shuffled["token_entropy"] == pytest.approx(one["token_entropy"])
    assert twice["token_entropy"] == pytest.approx(one["token_entropy"])


def test_expected_values(spark):
    df = spark.createDataFrame([(0, "x = 1  # TODO fix\n# FixMe\nTODO"), (1, "a\n a\nb"), (2, " \tx = 1"),
                                (3, "f((x)"), (4, "'''a''' '''b''' \"\"\"c\"\"\"")], "id int, t string")
    rows = with_metrics(df, "t").orderBy("id").collect()
    assert rows[0]["num_todo_comments"] == 2
    assert rows[1]["repetition_score"] == pytest.approx(1 / 3)
    assert rows[2]["has_tab_mix"] == 1
    assert rows[3]["has_unclosed_parens"] == 1
    assert rows[4]["num_docstrings"] == 3     # two ''' pairs + one """ pair


def test_null_is_zero_row_and_types(spark):
    df = spark.createDataFrame([(None,)], "t string")
    out = with_metrics(df, "t", keep=False)
    r = out.first()
    assert all(r[n] == 0 for n in METRIC_NAMES)
    for f in out.schema.fields:
        assert f.dataType.simpleString() == {"int": "int", "long": "bigint", "double": "double"}[metric_type(f.name)]


def test_two_sided_suffixes(spark):
    df = spark.createDataFrame([("a\nb", "c")], "content_full string, content_diff string")
    out = metrics_two_sided(df)
    assert "loc_full" in out.columns and "loc_diff" in out.columns
    r = out.first()
    assert (r["loc_full"], r["loc_diff"]) == (2, 1)


def test_clean_code_by_hand(spark):
    cases = {"": "", "\n \n\t\n": "", "a\r\nb\rc\x0bd\u2028e\n": "a\nb\nc\nd\ne", " \tx = 1": "x = 1",
             "x = 1  # TODO fix\n# FixMe\nTODO": "x = 1\nTODO", "a # b\n# c\n  d": "a\nd", "#only\n#comments": "",
             "x = 1 # c\n  y\x0bz #\n\n": "x = 1\ny\nz", METHOD: "class A:\ndef f(self): return self.x.y",
             "a\xa0b\x1cc\u3000d": "a\xa0b\nc\u3000d", "\xa0 a \u3000": "a"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(C.clean_code("t")).collect()] == list(cases.values())


def test_entropy_by_relation_equals_the_metric(spark):
    from changelens.functions.metrics import token_entropy_by_relation, with_metrics
    rows = [(1, "a b a\tc  a\n"), (2, ""), (3, None), (4, " \n\t "), (5, "x x x"), (6, "one two"), (None, "p q p"),
            (7, "w " * 200_000 + " ".join(f"t{i % 1000}" for i in range(100_000)))]
    df = spark.createDataFrame(rows, "id int, body string").withColumn("token_entropy", F.lit("clash"))
    got = {r.id: r.token_entropy for r in token_entropy_by_relation(df, ["id"], "body").collect()}
    want = {r.id: r.token_entropy for r in with_metrics(df.drop("token_entropy"), "body", names=["token_entropy"]).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got[5] == 0.0 and got[6] == 1.0
    assert token_entropy_by_relation(df.limit(0), ["id"], "body").count() == 0
    plan = token_entropy_by_relation(df, ["id"], "body")._jdf.queryExecution().toString()
    assert "Sort" not in plan.split("== Physical Plan ==")[1]
