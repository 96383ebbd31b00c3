"""The 33 text/code metrics (M1-M33) as column expressions, plus the null
row (M34) and the two-sided application with suffixes (M35).

Helper arrays (lines, non-blank lines, tokens, indents) are computed once
in their own projections so every metric reuses them; Catalyst keeps those
projections instead of re-splitting the text per metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.parallel import spread
from . import text as T

# Metric names, in the reference's output order.
METRIC_NAMES = [
    "loc", "num_defs", "num_classes", "num_imports", "has_try_except",
    "has_if_else", "uses_torch", "uses_numpy", "uses_cv2", "has_return",
    "has_raise", "num_comments", "num_empty_lines", "length",
    "avg_line_length", "comment_ratio", "empty_ratio", "code_density",
    "token_entropy", "num_indent_levels", "has_tab_mix",
    "has_unclosed_parens", "repetition_score", "num_decision_points",
    "num_external_calls", "avg_indent_length", "max_indent_length",
    "num_todo_comments", "num_operators", "avg_words_per_line",
    "num_docstrings", "num_error_keywords", "todo_ratio",
]

# The substrings the reference searches for.
DECISION_KEYWORDS = ["if ", "elif ", "for ", "while ", "try:", "except", " and ", " or "]
OPERATORS = ["+", "-", "*", "/", "%", "**", "//"]
ERROR_KEYWORDS = ["error", "fail", "exception", "bug"]
TODO_WORDS = ["todo", "fixme"]

FLAG_METRICS = {"has_try_except", "has_if_else", "uses_torch", "uses_numpy",
                "uses_cv2", "has_return", "has_raise", "has_tab_mix",
                "has_unclosed_parens"}
RATIO_METRICS = {"avg_line_length", "comment_ratio", "empty_ratio",
                 "code_density", "token_entropy", "repetition_score",
                 "num_external_calls", "avg_indent_length",
                 "avg_words_per_line", "num_error_keywords", "todo_ratio"}
COUNT_METRICS = [m for m in METRIC_NAMES if m not in FLAG_METRICS | RATIO_METRICS]
# The metrics the reference computes but never feeds to its models.
UNUSED_BY_MODELS = ["num_comments", "num_empty_lines", "comment_ratio",
                    "empty_ratio", "has_tab_mix", "avg_indent_length",
                    "max_indent_length", "num_todo_comments", "todo_ratio"]
MODEL_METRICS = [m for m in METRIC_NAMES if m not in UNUSED_BY_MODELS]


def metric_type(name: str) -> str:
    if name in FLAG_METRICS:
        return "int"
    if name in RATIO_METRICS:
        return "double"
    return "long"


def _flag(c: Column) -> Column:
    return c.cast("int")


def _entropy(tok: Column) -> Column:
    """Shannon entropy (bits) of a token list, in-row: runs over the sorted
    tokens give each distinct count c; H = log2(n) - sum(c*log2 c)/n."""
    def clog(run):
        return F.when(run > 1, run * F.log2(run)).otherwise(F.lit(0.0))

    init = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).cast("long").alias("r"),
                    F.lit(0.0).alias("a"))
    acc = F.aggregate(
        F.array_sort(tok), init,
        lambda s, x: F.when(x == s["p"], F.struct(s["p"].alias("p"), (s["r"] + 1).alias("r"),
                                                   s["a"].alias("a")))
        .otherwise(F.struct(x.alias("p"), F.lit(1).cast("long").alias("r"),
                            (s["a"] + clog(s["r"])).alias("a"))),
        lambda s: s["a"] + clog(s["r"]))
    n = F.size(tok)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - acc / n)


def token_entropy_by_relation(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """M19 as a relation, for texts too long to sort in a row: ``id_cols`` and
    ``token_entropy``, a row per id.  Tokens are counted per (id, token), in each task
    before they are shuffled; a second, again pre-aggregated step adds up
    H = log2(n) - sum(c*log2 c)/n, so neither a long text nor a common token is one
    task's work.  NULL, empty and blank texts give 0; texts of one id (NULL is an id)
    are counted as one; an empty table gives none."""
    token = df.select(*id_cols, F.explode_outer(T.tokens(F.col(text_col))).alias("__token"))
    counts = token.groupBy(*id_cols, "__token").agg(F.count("__token").alias("__c"))   # 0 where there is no token
    c = F.col("__c")
    sums = counts.groupBy(*id_cols).agg(F.sum("__c").alias("__n"),
                                        F.sum(F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))).alias("__s"))
    n = F.col("__n")
    entropy = F.when(n > 0, F.greatest(F.log2(n) - F.col("__s") / n, F.lit(0.0))).otherwise(F.lit(0.0))
    return sums.select(*id_cols, entropy.alias("token_entropy"))


def _metric_columns(c: Column, ln: Column, nb: Column, tok: Column, ind: Column,
                    nbs: Column, low: Column) -> dict[str, Column]:
    loc = F.size(ln)
    n_nb = F.size(nb)
    num_comments = T.count_sub(c, "#")
    num_empty = loc - n_nb
    # whole-text guards skip the per-line scans when no line can match
    num_todo = F.when(~T.contains(c, "#") | ~(T.contains(low, TODO_WORDS[0]) | T.contains(low, TODO_WORDS[1])),
                      F.lit(0)).otherwise(F.size(F.filter(ln, lambda l: T.contains(l, "#") & _any_contains(
                          F.lower(l), TODO_WORDS))))
    decision = F.when(~_any_contains(c, DECISION_KEYWORDS), F.lit(0)).otherwise(
        F.size(F.filter(nb, lambda l: _any_contains(l, DECISION_KEYWORDS))))
    # tokens never span lines and blank lines have none: the words of the
    # non-blank lines are exactly the tokens of the text
    words = F.size(tok)
    line_chars = F.aggregate(ln, F.lit(0).cast("long"), lambda a, l: a + F.length(l))
    ind_sum = F.aggregate(ind, F.lit(0).cast("long"), lambda a, x: a + x)
    return {
        "loc": loc.cast("long"),
        "num_defs": T.count_sub(c, "def "),
        "num_classes": T.count_sub(c, "class "),
        "num_imports": T.count_sub(c, "import "),
        "has_try_except": _flag(T.contains(c, "try") & T.contains(c, "except")),
        "has_if_else": _flag(T.contains(c, "if ") & T.contains(c, "else")),
        "uses_torch": _flag(T.contains(c, "torch")),
        "uses_numpy": _flag(T.contains(c, "numpy")),
        "uses_cv2": _flag(T.contains(c, "cv2")),
        "has_return": _flag(T.contains(c, "return")),
        "has_raise": _flag(T.contains(c, "raise")),
        "num_comments": num_comments,
        "num_empty_lines": num_empty.cast("long"),
        "length": F.length(c).cast("long"),
        "avg_line_length": T.safe_div(line_chars, loc),
        "comment_ratio": T.safe_div(num_comments, loc),
        "empty_ratio": T.safe_div(num_empty, loc),
        "code_density": T.safe_div(loc - num_empty, loc),
        "token_entropy": _entropy(tok),
        "num_indent_levels": F.size(F.array_distinct(ind)).cast("long"),
        "has_tab_mix": _flag(T.contains(c, "\t") & F.exists(ln, lambda l: T.contains(l, "\t") & l.startswith(" "))),
        "has_unclosed_parens": _flag(T.count_sub(c, "(") != T.count_sub(c, ")")),
        "repetition_score": T.safe_div(F.size(nbs) - F.size(F.array_distinct(nbs)), F.size(nbs)),
        "num_decision_points": decision.cast("long"),
        "num_external_calls": T.count_sub(c, ".") / F.greatest(loc, F.lit(1)),
        "avg_indent_length": T.safe_div(ind_sum, F.size(ind)),
        "max_indent_length": F.coalesce(F.array_max(ind), F.lit(0)).cast("long"),
        "num_todo_comments": num_todo.cast("long"),
        "num_operators": sum((T.count_sub(c, op) for op in OPERATORS), F.lit(0).cast("long")),
        "avg_words_per_line": T.safe_div(words, n_nb),
        "num_docstrings": (F.floor(T.count_sub(c, '"""') / 2) +
                           F.floor(T.count_sub(c, "'''") / 2)).cast("long"),
        "num_error_keywords": sum((T.count_sub(low, w) for w in ERROR_KEYWORDS),
                                  F.lit(0).cast("long")) / F.greatest(loc, F.lit(1)),
        "todo_ratio": T.safe_div(num_todo, loc),
    }


def _any_contains(l: Column, subs: list[str]) -> Column:
    out = None
    for s in subs:
        e = T.contains(l, s)
        out = e if out is None else (out | e)
    return out


def with_metrics(df: DataFrame, content: str, suffix: str = "",
                 names: list[str] | None = None, keep: bool = True,
                 spread_input: bool = True) -> DataFrame:
    """Append the metrics of string column ``content`` as ``<name><suffix>``.

    A null text gives the all-zero row (M34).  Helper arrays are dropped.
    """
    names = names or METRIC_NAMES
    if spread_input:
        df = spread(df)
    h = f"__m{suffix}_"
    base = df.columns if keep else []
    staged = (
        df.withColumn(h + "ln", T.lines(content))
          .withColumn(h + "nb", F.filter(F.col(h + "ln"), lambda l: ~T.is_blank(l)))
          .withColumn(h + "tok", T.tokens(content))
          .withColumn(h + "low", F.lower(F.col(content)))
    )
    staged = (staged.withColumn(h + "ind", F.transform(F.col(h + "nb"), T.indent))
                    .withColumn(h + "nbs", F.transform(F.col(h + "nb"), T.strip)))
    cols = _metric_columns(F.col(content), F.col(h + "ln"), F.col(h + "nb"), F.col(h + "tok"),
                           F.col(h + "ind"), F.col(h + "nbs"), F.col(h + "low"))
    zero = {"int": F.lit(0), "long": F.lit(0).cast("long"), "double": F.lit(0.0)}
    out = [F.coalesce(cols[n].cast(metric_type(n)), zero[metric_type(n)].cast(metric_type(n)))
           .alias(n + suffix) for n in names]
    return staged.select(*[F.col(b) for b in base], *out)


def metrics_two_sided(df: DataFrame, full: str = "content_full",
                      diff: str = "content_diff") -> DataFrame:
    """All metrics on both texts, suffixed ``_full`` / ``_diff``."""
    return with_metrics(with_metrics(df, full, "_full"), diff, "_diff", spread_input=False)
