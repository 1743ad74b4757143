"""Column expressions for line and word splitting.

All of them are built-in Spark SQL expressions, so they stay in the JVM
and inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line terminators of a Hadoop text scan: \r\n, \r and \n.
LINE_BREAK = r"\r\n|\r|\n"
# One trailing terminator adds no empty line.
_TRAILING_BREAK = r"(\r\n|\r|\n)\z"
# Java's \s: space, \t, \n, \x0B, \f, \r.
JAVA_WHITESPACE = "[ \\t\\n\\x0B\\f\\r]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """Lines of a text value, as a text-file scan would give them.

    Empty or null text has no lines; a trailing line break adds none.
    """
    t = _col(text)
    body = F.regexp_replace(t, _TRAILING_BREAK, "")
    return (
        F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
        .otherwise(F.split(body, LINE_BREAK, -1))
    )


def words(line: Column | str) -> Column:
    """Words of one line, split on single spaces like Java ``split(" ")``.

    An empty line gives one empty word, a line of spaces gives none,
    leading and doubled spaces give empty words, trailing empty words are
    dropped, tabs do not split.
    """
    ln = _col(line)
    body = F.regexp_replace(ln, " +\\z", "")
    return (
        F.when(ln == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, " ", -1))
    )


def java_tokens(text: Column | str) -> Column:
    """Tokenizer rule: lower-case, split on each single whitespace char.

    Same rule as ``pyspark.ml.feature.Tokenizer``; used where a token
    count is needed without building a Tokenizer stage.
    """
    t = F.lower(_col(text))
    body = F.regexp_replace(t, JAVA_WHITESPACE + "+\\z", "")
    return (
        F.when(t == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, JAVA_WHITESPACE, -1))
    )
