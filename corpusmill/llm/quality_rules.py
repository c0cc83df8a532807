"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a Column expression, so nothing is evaluated by a user function and
nothing is shuffled.  A rule is a row of ``RULES``: a ratio of two statistics, a
comparison and a bound.  ``compile_rules`` turns the table into one array expression
that names the rules a document breaks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the supported languages (en, de, fr, es).
STOP_WORDS = (
    "the of and to in is that it for was on with as be by this are or an at "
    "der die das und ist nicht ein eine zu mit auf für von den dem im "
    "le la les de et est une un des en que dans pour il sur du "
    "el los las una por con para se del es no lo su y a"
).split()


class Rule(NamedTuple):
    """Broken where ``top`` > ``bound`` * ``bottom`` (sign ">") or ``top`` < ``bound`` * ``bottom`` (sign "<")."""

    name: str
    top: str
    sign: str
    bound: float
    bottom: str = "one"


#: Rules that decide ``base_failed``.
BASE_RULES = (
    Rule("too_few_words", "n_words", "<", 10),
    Rule("repeated_words", "n_repeat_words", ">", 0.2, "n_words"),
)
#: Rules that the verdict adds.  The bounds on symbols, word lengths and duplicate lines are those that
#: published rule sets for web text use; prose of all four languages has far more than one stop word in a hundred.
RULES = (
    Rule("too_many_words", "n_words", ">", 1_000_000),
    Rule("short_words", "word_chars", "<", 2, "n_words"),
    Rule("long_words", "word_chars", ">", 15, "n_words"),
    Rule("symbols", "n_symbols", ">", 0.1, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", ">", 0.3, "n_lines"),
    Rule("no_stop_words", "n_stop_words", "<", 0.01, "n_words"),
)


def broken(rule: Rule) -> Column:
    """Compared in whole numbers of thousandths, so that no rounding decides a case."""
    top, bottom = F.col(rule.top) * 1000, F.col(rule.bottom) * round(rule.bound * 1000)
    return top > bottom if rule.sign == ">" else top < bottom


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the broken rules, in the table's order."""
    return F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))


def _repeated(keyed: Column) -> Column:
    """The places of (key, place) structs whose key the list has twice or more, in order of keys.

    Sorted by key, those are the ones equal to a neighbour.
    """
    same = lambda s, x, i: (x["key"] == F.get(s, i - 1)["key"]) | (x["key"] == F.get(s, i + 1)["key"])
    return F.transform(F.array(F.sort_array(keyed)), lambda s: F.transform(F.filter(s, lambda x, i: F.coalesce(same(s, x, i), F.lit(False))), lambda x: x["place"]))[0]


def repeat_words(words: Column, n: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words that the text has twice or more.

    A repeated window adds the words up to the next repeated one, at most ``size``.
    Texts whose windows all have different 64-bit hashes, by far the most, stop at a
    count of these; of others only windows with a repeated hash are compared as strings.
    """
    window = lambda i: [F.get(words, i + k) for k in range(size)]
    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*window(i)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size)))), F.lit(0), lambda a, b: a + b)

    def exact(h: Column) -> Column:
        likely = _repeated(F.transform(h, lambda x, i: F.struct(x.alias("key"), i.alias("place"))))
        certain = _repeated(F.transform(likely, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("key"), i.alias("place"))))
        return F.transform(F.array(F.sort_array(certain)), covered)[0]

    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(0))[0]
    return F.when(n >= size, counted).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that rules refer to, each a Column expression over the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = pick(docs, "doc_id", "text").select("doc_id", text.alias("text")).select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, "\t\x0b\x0c\r ", "")) > 0)
    counted = base.select("doc_id", "text", "words", F.size("words").alias("n"), lines.alias("lines"))
    return counted.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", "\t\n\x0b\x0c\r ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.lit(1).cast("long").alias("one"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken.

    ``broken`` lists the names of the broken rules of both tables; ``kept`` is true where
    there are none.  A null or empty text has no words and so fails the base rules.
    Repeated rows give repeated results; an empty table gives none.
    """
    broken_base, broken_more = compile_rules(BASE_RULES), compile_rules(rules)
    judged = statistics(docs).withColumns({"failed": broken_base, "more": broken_more})
    return judged.select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (F.size("failed") > 0).alias("base_failed"),
        (F.size("failed") + F.size("more") == 0).alias("kept"),
        F.array_join(F.concat("failed", "more"), ",").alias("broken"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table of rules as DuckDB SQL over ``documents``."""

    def sql(r: Rule) -> str:
        return f"CASE WHEN {r.top} * 1000 {r.sign} {r.bottom} * {round(r.bound * 1000)} THEN '{r.name}' END"

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    broken_base, broken_more = (", ".join(map(sql, table)) for table in (BASE_RULES, rules))
    return f"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM split
), placed AS (
  SELECT rid, generate_subscripts(words, 1) AS i, words FROM counted WHERE len(words) >= 5
), windows AS (
  SELECT rid, i, words[i:i + 4] AS w FROM placed WHERE i <= len(words) - 4
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid
), statistics AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words,
         1 AS one
  FROM counted LEFT JOIN repeats USING (rid)
), judged AS (
  SELECT *, list_filter([{broken_base}], lambda x: x IS NOT NULL) AS failed, list_filter([{broken_more}], lambda x: x IS NOT NULL) AS more FROM statistics
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       len(failed) > 0 AS base_failed, len(failed) + len(more) = 0 AS kept, array_to_string(list_concat(failed, more), ',') AS broken
FROM judged"""
