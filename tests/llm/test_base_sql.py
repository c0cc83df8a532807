"""The base columns of secret, personal-data and license scans against DuckDB SQL over whole texts."""

import duckdb
import pytest

from corpusmill.llm import queries as Q
from corpusmill.llm.license_scan import license_scan
from corpusmill.llm.pii_scan import pii_scan
from corpusmill.llm.secret_scan import secret_scan
from tests.llm.test_operators import documents, empty, hard, same  # noqa: F401

#: kind: pattern, and what of a match x must hold
SECRETS = {
    "assign": ("(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+", "length(regexp_extract(x, '^(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(x) >= 18"),
    "hex": ("[0-9a-f]+", "length(x) >= 16"),
}
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ascii(reverse({_DIGITS})[i]) - 48 ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][ascii(reverse({_DIGITS})[i]) - 47] END)) % 10 = 0"
PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}


def base_sql(kinds):
    """doc_id, a count for each kind, base_sha256: matches are marked in the text, their places told from what lies before."""
    parts = []
    for at, (kind, (pattern, holds)) in enumerate(kinds.items()):
        parts.append(f"""SELECT doc_id, {at} AS rank, '{kind}' AS kind, starts AS a, starts + length(x) AS b FROM (
  SELECT doc_id, n, split_part(piece, chr(2), 1) AS x, sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY n) - length(replace(piece, chr(2), '')) AS starts
  FROM (SELECT doc_id, generate_subscripts(ps, 1) AS n, unnest(ps) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS ps FROM documents))) WHERE n > 1 AND {holds}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH found AS ({' UNION ALL '.join(parts)}),
told AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)' for k in kinds)}, sha256(coalesce(spans, '')) FROM documents LEFT JOIN told USING (doc_id)"""


_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
LICENSES = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
e AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS a FROM w), n AS (SELECT *, a || ' ' || lead(a) OVER o AS two, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS three FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS ({' UNION ALL '.join(f"SELECT doc_id, i, '{label}' AS label FROM n WHERE '{phrase}' IN (two, three)" for label, phrase in _PHRASES.items())}),
t AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT, coalesce(n, 0), a, b, coalesce(labels, '') FROM w LEFT JOIN t USING (doc_id)"""

CASES = {
    "op2_secret_scan": (secret_scan, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), base_sql(SECRETS)),
    "op4_pii": (pii_scan, ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), base_sql(PRIVATE)),
    "op9_license_scan": (license_scan, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), LICENSES),
}


@pytest.mark.parametrize("name", CASES)
def test_base_columns_equal_sql(spark, sf_dir, name):
    _, columns, sql = CASES[name]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    same(getattr(Q, name)(spark, sf_dir), columns, connection.execute(sql).fetchall())


@pytest.mark.parametrize("name", CASES)
def test_base_columns_of_hard_texts_equal_sql(spark, hard, name):  # noqa: F811
    operator, columns, sql = CASES[name]
    texts = sorted({r["text"] for r in hard.collect() if r["text"] is not None})
    rows = [*enumerate(texts), (len(texts), None)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(operator(spark.createDataFrame(rows, "doc_id bigint, text string")), columns, connection.execute(sql).fetchall())
