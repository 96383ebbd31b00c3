"""DuckDB SQL text for the oracle side of the metric and cleaning queries.

These strings restate the metric definitions in plain SQL over the same
Parquet tables; they are what the Spark expressions are checked against.
"""

from __future__ import annotations

from ..functions import metrics as M
from ..functions.context import PATH_PURPOSES, REPO_DOMAINS
from ..functions.text import LINE_BREAK_CHARS, WS_CHARS


def _lit(s: str) -> str:
    """SQL literal built with chr() for control characters."""
    parts, buf = [], ""
    for ch in s:
        if ch == "'":
            buf += "''"
        elif ord(ch) < 32 or 0x7F <= ord(ch) <= 0xA0 or ch.isspace():
            if buf:
                parts.append(f"'{buf}'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append(f"'{buf}'")
    return "(" + " || ".join(parts) + ")"


def _cls(chars: str) -> str:
    return "[" + "".join("\\x{%X}" % ord(c) for c in chars) + "]"


WS = _lit(WS_CHARS)
WS_RE = "'" + _cls(WS_CHARS) + "+'"
LINE_RE = "'\\r\\n|" + _cls(LINE_BREAK_CHARS) + "'"


def lines(c: str) -> str:
    p = f"regexp_split_to_array({c}, {LINE_RE})"
    return f"(CASE WHEN {p}[-1] = '' THEN {p}[1:len({p})-1] ELSE {p} END)"


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def tokens(c: str) -> str:
    s = strip(c)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, {WS_RE}) END)"


def cnt(c: str, sub: str) -> str:
    return f"((length({c}) - length(replace({c}, {_lit(sub)}, ''))) // {len(sub)})"


def has(c: str, sub: str) -> str:
    return f"contains({c}, {_lit(sub)})"


def div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num})::DOUBLE / ({den}) END)"


def metric_sql(c="c", ln="ln", nb="nb", tok="tok", ind="ind", nbs="nbs") -> dict[str, str]:
    loc = f"len({ln})"
    empty = f"({loc} - len({nb}))"
    todo = (f"len(list_filter({ln}, lambda l: {has('l', '#')} AND "
            f"({has('lower(l)', 'todo')} OR {has('lower(l)', 'fixme')})))")
    dec = " OR ".join(has("l", k) for k in M.DECISION_KEYWORDS)
    flag = (lambda e: f"(CASE WHEN {e} THEN 1 ELSE 0 END)::INTEGER")
    words = f"coalesce(list_sum(list_transform({nb}, lambda l: len({tokens('l')}))), 0)"
    return {
        "loc": f"{loc}::BIGINT",
        "num_defs": cnt(c, "def "),
        "num_classes": cnt(c, "class "),
        "num_imports": cnt(c, "import "),
        "has_try_except": flag(f"{has(c, 'try')} AND {has(c, 'except')}"),
        "has_if_else": flag(f"{has(c, 'if ')} AND {has(c, 'else')}"),
        "uses_torch": flag(has(c, "torch")),
        "uses_numpy": flag(has(c, "numpy")),
        "uses_cv2": flag(has(c, "cv2")),
        "has_return": flag(has(c, "return")),
        "has_raise": flag(has(c, "raise")),
        "num_comments": cnt(c, "#"),
        "num_empty_lines": f"{empty}::BIGINT",
        "length": f"length({c})::BIGINT",
        "avg_line_length": div(f"coalesce(list_sum(list_transform({ln}, lambda l: length(l))), 0)", loc),
        "comment_ratio": div(cnt(c, "#"), loc),
        "empty_ratio": div(empty, loc),
        "code_density": div(f"{loc} - {empty}", loc),
        "token_entropy": f"(CASE WHEN len({tok}) = 0 THEN 0.0 ELSE list_aggregate({tok}, 'entropy') END)",
        "num_indent_levels": f"len(list_distinct({ind}))::BIGINT",
        "has_tab_mix": flag(f"len(list_filter({ln}, lambda l: contains(l, chr(9)) AND starts_with(l, ' '))) > 0"),
        "has_unclosed_parens": flag(f"{cnt(c, '(')} <> {cnt(c, ')')}"),
        "repetition_score": div(f"len({nbs}) - len(list_distinct({nbs}))", f"len({nbs})"),
        "num_decision_points": f"len(list_filter({nb}, lambda l: {dec}))::BIGINT",
        "num_external_calls": f"({cnt(c, '.')})::DOUBLE / greatest({loc}, 1)",
        "avg_indent_length": div(f"coalesce(list_sum({ind}), 0)", f"len({ind})"),
        "max_indent_length": f"coalesce(list_max({ind}), 0)::BIGINT",
        "num_todo_comments": f"{todo}::BIGINT",
        "num_operators": "(" + " + ".join(cnt(c, o) for o in M.OPERATORS) + ")::BIGINT",
        "avg_words_per_line": div(words, f"len({nb})"),
        "num_docstrings": f"({cnt(c, chr(34) * 3)} // 2 + {cnt(c, chr(39) * 3)} // 2)::BIGINT",
        "num_error_keywords": "(" + " + ".join(cnt(f"lower({c})", w) for w in M.ERROR_KEYWORDS)
                              + f")::DOUBLE / greatest({loc}, 1)",
        "todo_ratio": div(todo, loc),
    }


def metrics_query(source_sql: str, id_cols: list[str], names: list[str],
                  rounding: dict[str, int] | None = None, suffix: str = "") -> str:
    """``source_sql`` must yield ``id_cols`` and a text column ``c``."""
    rounding = rounding or {}
    ms = metric_sql()
    ids = ", ".join(id_cols)
    outs = []
    for n in names:
        e = f"coalesce({ms[n]}, 0)"
        if n in rounding:
            e = f"round({e}, {rounding[n]})"
        outs.append(f"{e} AS {n}{suffix}")
    return metric_ctes(source_sql) + f"SELECT {ids}, " + ", ".join(outs) + " FROM s3"


def metric_ctes(source_sql: str) -> str:
    return (
        f"WITH base AS ({source_sql}), "
        f"s1 AS (SELECT *, {lines('c')} AS ln, {tokens('c')} AS tok FROM base), "
        f"s2 AS (SELECT *, list_filter(ln, lambda l: {strip('l')} <> '') AS nb FROM s1), "
        f"s3 AS (SELECT *, list_transform(nb, lambda l: length(l) - length(ltrim(l, ' '))) AS ind, "
        f"list_transform(nb, lambda l: {strip('l')}) AS nbs FROM s2) "
    )


def clean_code(c: str) -> str:
    no_comments = f"regexp_replace({c}, '#[^\\n]*', '', 'g')"
    kept = f"list_filter(list_transform({lines(no_comments)}, lambda l: {strip('l')}), lambda l: l <> '')"
    return f"array_to_string({kept}, chr(10))"


def _first_match(v: str, rules, default: str) -> str:
    whens = []
    for subs, label in rules:
        cond = " OR ".join(has(v, s) for s in subs)
        whens.append(f"WHEN {cond} THEN '{label}'")
    return "(CASE " + " ".join(whens) + f" ELSE {default} END)"


def repo_domain(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN 'other' ELSE {_first_match(f'lower({c})', REPO_DOMAINS, chr(39) + 'other' + chr(39))} END)"


def path_purpose(c: str) -> str:
    low = f"lower({c})"
    fallback = f"(CASE WHEN {cnt(low, '/')} <= 2 THEN 'root_or_meta' ELSE 'other' END)"
    return _first_match(low, PATH_PURPOSES, fallback)


def file_extension(c: str) -> str:
    return f"(CASE WHEN contains({c}, '.') THEN string_split({c}, '.')[-1] ELSE 'none' END)"
