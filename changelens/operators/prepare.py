"""Join, label and decode the two sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["commit", "repo", "filepath"]


def join_diff_full(diff: DataFrame, full: DataFrame, keys: list[str] = KEYS,
                   carry: list[str] | None = None,
                   suffixes: tuple[str, str] = ("_diff", "_full")) -> DataFrame:
    """Inner equi-join on ``keys`` where NULL matches NULL.

    The full side is projected to keys + ``carry`` first (the scan reads only
    those columns).  Non-key columns present on both sides get the suffixes.
    Output keeps one copy of each key.  Catalyst plans a sort-merge (or
    broadcast, when the full side is small) join on the keys; AQE splits
    skewed key partitions.
    """
    carry = carry if carry is not None else ["content"]
    r = full.select(*keys, *carry)
    clash = [c for c in carry if c in diff.columns]
    d = diff
    for c in clash:
        d = d.withColumnRenamed(c, c + suffixes[0])
        r = r.withColumnRenamed(c, c + suffixes[1])
    ra = r.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                  *[c for c in r.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [d[k].eqNullSafe(ra[f"__r_{k}"]) for k in keys])
    return d.join(ra, cond, "inner").drop(*[f"__r_{k}" for k in keys])


def label_from_lines(lines) -> Column:
    """0 when the changed-line list is empty, else 1 (NULL list -> NULL)."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    return F.when(lines.isNull(), F.lit(None).cast("int")).when(
        F.size(lines) == 0, F.lit(0)).otherwise(F.lit(1))


def decode_text(c, dtype_is_binary: bool = True) -> Column:
    """Bytes -> UTF-8 text, dropping undecodable bytes.

    ``make_valid_utf8`` marks each bad sequence with U+FFFD, which is then
    removed.  Genuine U+FFFD characters are escaped before and restored after
    (a noncharacter is the escape, and is itself escaped).
    """
    c = F.col(c) if isinstance(c, str) else c
    if not dtype_is_binary:
        return c.cast("string")
    mark, esc = F.lit("\ufffd"), "\ufdd0"
    text = c.cast("string")
    held = F.replace(F.replace(text, F.lit(esc), F.lit(esc + "0")), mark, F.lit(esc + "1"))
    clean = F.replace(F.make_valid_utf8(held), mark, F.lit(""))
    clean = F.replace(F.replace(clean, F.lit(esc + "1"), mark), F.lit(esc + "0"), F.lit(esc))
    # texts without either character skip the escaping
    plain = F.replace(F.make_valid_utf8(text), mark, F.lit(""))
    return F.when(F.contains(text, mark) | F.contains(text, F.lit(esc)), clean).otherwise(plain)


def unescape_newlines(c) -> Column:
    """P5: a literal backslash followed by 'n' becomes a newline."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def to_text(df: DataFrame, col: str) -> Column:
    """P4 + P5 for a content column of binary or string type."""
    is_bin = df.schema[col].dataType.typeName() == "binary"
    return unescape_newlines(decode_text(col, is_bin))


def file_change_freq(df: DataFrame, repo: str = "repo", path: str = "filepath",
                     commit: str = "commit", out: str = "file_change_freq") -> DataFrame:
    """Number of non-null commits per (repo, filepath), 0 for NULL keys.

    Counted with a partial (map-side) aggregate and joined back, so a hot
    file never becomes one window partition; AQE splits a skewed join side.
    """
    counts = (df.where(F.col(repo).isNotNull() & F.col(path).isNotNull())
                .groupBy(repo, path).agg(F.count(commit).alias(out)))
    return (df.join(counts, [repo, path], "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long")))
