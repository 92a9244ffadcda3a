"""Shared pieces of the DuckDB SQL."""

from __future__ import annotations

from sparkveil.functions.rules import PATTERNS

# RE2 knows ASCII word boundaries only: letters beyond ASCII become underscores, which are word characters too.
PLAIN = r"regexp_replace({text}, '[^\P{{L}}a-zA-Z]', '_', 'g')"


def spans_sql(table: str, key: str, text: str, rules: list[tuple[str, str, bool]] | None = None) -> str:
    """SELECT key, ord, phi_type, start, end, text (and the whole text) of all matches."""
    parts = []
    for k, (name, regex, ignore) in enumerate(PATTERNS if rules is None else rules):
        p = (("(?i)" if ignore else "") + regex).replace("'", "''")
        parts.append(f"SELECT {key}, {k} AS ord, '{name}' AS phi_type, w, regexp_extract_all(u, '{p}', 0) AS m, string_split_regex(u, '{p}') AS g FROM t")
    union = "\nUNION ALL ".join(parts)
    return f"""t AS (SELECT {key}, {text} AS w, {PLAIN.format(text=text)} AS u FROM {table} WHERE {text} IS NOT NULL
), s AS ({union}
), e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s WHERE len(m) > 0
), d AS (
  SELECT {key}, ord, phi_type, w, m[i] AS text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start FROM e
), f AS (SELECT {key}, ord, phi_type, start, CAST(start + length(text) AS INTEGER) AS "end", text, w FROM d)"""
