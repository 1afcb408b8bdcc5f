"""The table of queries with their SQL twins, and SQL spellings that several of them share."""

from __future__ import annotations

from ..functions.text import STROKED, TURKISH, TURKISH_FOLDED, UNSTROKED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fold_sql(c: str) -> str:
    return f"replace(lower(translate(coalesce({c}, ''), '{TURKISH}', '{TURKISH_FOLDED}')), 'ß', 'ss')"


def plain_sql(c: str) -> str:
    return f"replace(strip_accents(lower(translate(coalesce({c}, ''), '{TURKISH + STROKED}', '{TURKISH_FOLDED + UNSTROKED}'))), 'ß', 'ss')"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({plain_sql(c)}, '[\\p{{L}}\\p{{N}}]+')"


def values_sql(rows, columns: str) -> str:
    """Rows as a SQL table."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns}))"


def bm25_sql(columns: dict[str, float], terms: list[str] | str, every: bool, rows: str = "rec") -> str:
    """CTEs post, len, c, per, df and s(record_id, score, m) over a table of records; terms: literals or a SQL query."""
    post = " UNION ALL ".join(f"SELECT record_id, unnest({tokens_sql(c)}) AS term, {w}::DOUBLE AS w FROM {rows}" for c, w in columns.items())
    q = terms if isinstance(terms, str) else "VALUES " + ", ".join(f"('{t}')" for t in sorted(set(terms)))
    return f"""p0 AS ({post}), post AS (SELECT record_id, term, sum(w) AS f, count(*) AS n FROM p0 GROUP BY 1, 2), q(q) AS ({q}),
        len AS (SELECT record_id, coalesce(sum(n), 0) AS dl FROM {rows} LEFT JOIN post USING (record_id) GROUP BY 1),
        c AS (SELECT count(*) AS docs, sum(dl) / count(*) AS avgdl FROM len),
        per AS (SELECT record_id, q, sum(f) AS f FROM post JOIN q ON starts_with(term, q) GROUP BY 1, 2),
        df AS (SELECT q, count(*) AS df, greatest(ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM per, c GROUP BY q),
        s AS (SELECT record_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS m
              FROM per JOIN df USING (q) JOIN len USING (record_id), c GROUP BY 1 {"HAVING count(*) = " + str(len(set(terms))) if every else ""})"""
