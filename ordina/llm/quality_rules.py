"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
bit per failed rule. A policy is a versioned mask of rules that must hold: applying it,
changing it and asking what each rule removes (`ablations`) read the ledger's bits and
never the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# name -> failure, in terms of the measurements; the bit is the place in this list.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "few_letters": "10 * n_letter_words < 8 * n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "repeated_lines"),
    "web-2": tuple(RULES),
}
POLICY = "web-2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in rules)


def _repeated(words: str) -> str:
    """Number of words inside 3-word windows that occur at least twice.

    Windows are hashed and sorted with their places; equal neighbours are repeated. A
    one-element array binds the sorted list, so that it is made once per text.
    """
    windows = f"transform(sequence(0, size({words}) - 3), i -> xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)))"
    bind = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    places = bind(
        "s",
        "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))",
        "sort_array(transform(filter(s, (r, k) -> (k > 0 AND get(s, k - 1).x = r.x)"
        " OR (k < size(s) - 1 AND get(s, k + 1).x = r.x)), r -> r.i))",
    )
    covered = (
        f"aggregate({places}, named_struct('n', 0L, 'to', 0), (a, p) ->"
        " named_struct('n', a.n + p + 3 - greatest(p, a.to), 'to', p + 3), a -> a.n)"
    )
    some = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {covered} END"
    return f"CASE WHEN size({words}) < 4 THEN 0L ELSE {bind('h', windows, some)} END"


def _chars(text: Column) -> Column:
    return F.char_length(text).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of each row of `docs` (doc_id, text).

    Null texts count as empty and fail the base rules. Rows with equal or null ids
    stay rows; other columns are ignored; an empty table gives no rows.
    """
    spaces = "[\\x20\\x09-\\x0D]+"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.filter(F.split("text", spaces), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    measured = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _chars(F.translate("text", SPACES, "")).alias("word_chars"),
        (_chars(F.col("text")) - _chars(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeated("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
    )
    failed = [F.when(F.expr(rule), F.lit(bit(name))).otherwise(0).cast("long") for name, rule in RULES.items()]
    total = failed[0]
    for f in failed[1:]:
        total = total.bitwiseOR(f)
    return measured.withColumn("fail_bits", total)


def passes(policy: str = POLICY) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with `base_failed` and `kept`: every rule of the policy, and the base rules, hold."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "n_letter_words", "fail_bits"]
    return rows.select(*columns, base.alias("base_failed"), (~base & passes(policy)).alias("kept"), *more)


def ablations(rows: DataFrame) -> DataFrame:
    """(policy, rule, n_kept, n_kept_without, only_this) for every rule of every policy.

    The ledger shrinks to a count for each combination of bits, at most 2 ** rules rows,
    before policies are put beside it.
    """
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"), F.lit(bit(r)).cast("long").alias("bit"))
        for p, rules in POLICIES.items()
        for r in rules
    ]
    counted = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    table = counted.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    zero = F.lit(0).cast("long")
    return table.groupBy("policy", "rule").agg(
        F.sum(F.when(hit == 0, F.col("n")).otherwise(zero)).alias("n_kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(zero)).alias("only_this"),
    )


_RULES_SQL = " + ".join(f"CASE WHEN {rule} THEN {bit(name)} ELSE 0 END" for name, rule in RULES.items())
ORACLE = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS lines
  FROM t
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), again AS (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1),
places AS (
  SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN again USING (r, g)
), covered AS (SELECT r, count(*) AS n FROM places GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) AS BIGINT) AS n_letter_words
  FROM w LEFT JOIN covered USING (r)
), b AS (SELECT *, CAST({_RULES_SQL} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {mask(POLICIES[POLICY])}) = 0 AS kept,
       n_lines, n_letter_words, fail_bits
FROM b"""

ABLATIONS_ORACLE = f"WITH led AS ({ORACLE}) " + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{r}' AS rule,"
    f" CAST(count(*) FILTER (fail_bits & {mask(rules)} = 0) AS BIGINT) AS n_kept,"
    f" CAST(count(*) FILTER (fail_bits & {mask(rules) - bit(r)} = 0) AS BIGINT) AS n_kept_without,"
    f" CAST(count(*) FILTER (fail_bits & {mask(rules)} = {bit(r)}) AS BIGINT) AS only_this FROM led"
    for p, rules in POLICIES.items()
    for r in rules
)
