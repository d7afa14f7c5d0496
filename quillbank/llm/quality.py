"""Quality rules with risk-controlled thresholds, in DataFrame expressions alone.

Each rule rejects a document whose ratio of two counts exceeds a cutoff. The cutoffs come from labelled documents: for
every stratum and rule, each cutoff of a fixed grid is tested against "it rejects more than ``alpha`` / rules of the good
documents" with the exact binomial tail, at level ``delta`` divided by all tests made (Bonferroni over strata, rules and
grid). The strictest cutoff that passes is used; where none passes the rule stays off. With probability 1 - ``delta``
all rules together reject at most ``alpha`` of the good documents of every stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.llm.shared import SPACES, UPPER, cut, read

#: name: (numerator, denominator)
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_word_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "bangs": ("n_bangs", "word_chars"),
}
GRID = 40
#: Cutoffs of all strata that go to the executors at most; beyond it rows and cutoffs meet in a sort-merge join.
STRATA_BYTES = 8_000_000
SYMBOLS = "#*$%&|<>"
#: A row of the tail sum is one term; further terms are covered by their geometric bound, which only raises the p-value.
TAIL_TERMS = 4096


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: str) -> Column:
    """Positions of ``words`` (a column name) that lie in a 3-word window whose words occur twice or more.

    Windows are hashed, sorted with their positions inside the row, and equal neighbours mark repeated windows: n log n
    in the row's own length, without a shuffle. Binding by ``transform(array(x), ...)`` evaluates x once.
    """
    return F.expr(f"""
        element_at(transform(array(
          sort_array(transform(slice({words}, 1, greatest(size({words}) - 2, 0)),
            (x, i) -> struct(xxhash64(x, get({words}, i + 1), get({words}, i + 2)) AS h, i AS i)))), s ->
          element_at(transform(array(
            sort_array(transform(filter(transform(s, (x, j) -> struct(x.i AS i,
              coalesce(x.h = get(s, j - 1).h, false) OR coalesce(x.h = get(s, j + 1).h, false) AS twice)), x -> x.twice), x -> x.i))), p ->
            aggregate(transform(p, (x, j) -> CAST(least(3, coalesce(get(p, j + 1) - x, 3)) AS BIGINT)), 0L, (a, b) -> a + b)), 1)), 1)
    """)


#: Letters and marks that no rule counts; texts are mostly made of them.
COMMON = "abcdefghijklmnopqrstuvwxyz .,\n"


def features(docs: DataFrame, stratum: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, stratum and the counts that the rules use, with ``carry`` also the whole row as a struct ``_row``.

    A null text has no words and no lines with words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        text.alias("text"),
        F.expr(r"filter(split(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')").alias("words"),
        F.translate(text, COMMON, "").alias("rare"),
        F.expr(f"filter(split(coalesce(text, ''), '\\n'), x -> translate(x, '{_sql(SPACES)}', '') <> '')").alias("word_lines"),
        *([F.struct(*docs.columns).alias("_row")] if carry else []),
    )
    rare = F.col("rare")
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(rare, SYMBOLS).alias("n_symbols"),
        (F.size("word_lines") - F.size(F.array_distinct("word_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("words").cast("long").alias("n_repeat_words"),
        F.size("word_lines").cast("long").alias("n_word_lines"),
        _count_of(rare, UPPER).alias("n_capitals"),
        _count_of(rare, "0123456789").alias("n_digits"),
        _count_of(rare, "!").alias("n_bangs"),
        *(["_row"] if carry else []),
    )


def _sql(s: str) -> str:
    return s.encode("unicode_escape").decode().replace("\\x0b", "\\u000b").replace("\\x0c", "\\u000c")


def bin_of(rule: str) -> Column:
    """The least grid step that is not below the ratio, 0 to GRID: a ratio exceeds cutoff j / GRID where this exceeds j."""
    over, under = (F.col(c) for c in RULES[rule])
    return F.when(under > 0, F.least(F.expr(f"({GRID} * {RULES[rule][0]} + {RULES[rule][1]} - 1) DIV {RULES[rule][1]}"), F.lit(GRID).cast("long"))).when(over > 0, F.lit(GRID).cast("long")).otherwise(F.lit(0).cast("long"))


def _log_factorial(x: str) -> str:
    """ln x! by Stirling's series at x + 9, brought down by the recurrence; SQL text."""
    z = f"({x} + 9.0D)"
    down = " + ".join(f"ln({x} + {k}.0D)" for k in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.5D * ln(2 * pi()) + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - ({down}))"


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < p n, and 1 elsewhere. Terms are summed downwards from k."""
    first = f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p}D))"
    odds = (1 - p) / p
    walked = f"""aggregate(sequence(0L, least({k}, {TAIL_TERMS - 1}L)), named_struct('t', {first}, 's', 0.0D),
        (a, i) -> named_struct('t', a.t * greatest({k} - i, 0L) / ({n} - {k} + i + 1) * {odds}D, 's', a.s + a.t))"""
    left = f"CASE WHEN {k} >= {TAIL_TERMS}L THEN w.t / (1 - {k} * {odds}D / ({n} - {k} + 1)) ELSE 0.0D END"
    return F.expr(f"CASE WHEN {n} > 0 AND {k} < {p}D * {n} THEN element_at(transform(array({walked}), w -> least(w.s + {left}, 1.0D)), 1) ELSE 1.0D END")


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff (in grid steps): the strictest certified cutoff. Rows exist only where one is certified.

    ``labels`` has doc_id and quality (1 good); rows without a known quality, and documents without a label, take no
    part. Two labels of one document count as one, and the document as good only if all say so.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = feats.join(known.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    binned = good.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bin_of(r).alias("bin")) for r in RULES])).alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(F.count("*").alias("n"))
    packed = binned.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bin", "n")).alias("bins"))  # at most GRID + 1 bins
    strata = packed.agg(F.count_distinct("stratum").alias("n_strata"))
    tested = packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("k", F.expr("aggregate(filter(bins, b -> b.bin > j), 0L, (a, b) -> a + b.n)"))
    passed = tested.withColumn("p", binomial_tail("k", "n", alpha / len(RULES))).crossJoin(F.broadcast(strata)).where(F.col("p") <= F.lit(delta) / (F.col("n_strata") * len(RULES) * GRID))
    return passed.groupBy("stratum", "rule").agg(F.min("j").alias("cutoff"))


def _judged(feats: DataFrame, labels: DataFrame, alpha: float, delta: float, min_words: int, max_repeat_percent: int) -> DataFrame:
    chosen = cut(cutoffs(feats, labels, alpha, delta).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]))
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("stratum") + 64), F.lit(0))).first()[0]
    judged = feats.join(F.broadcast(chosen) if size <= STRATA_BYTES else chosen.hint("merge"), "stratum", "left")
    hits = F.filter(F.array(*[F.when(bin_of(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", base).withColumn("rejected_by", hits).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs``: its counts, base_failed, the rules that reject it and kept.

    A null or empty text has no words, so it fails the base rule. A null stratum is a stratum of its own (''). Extra
    columns of ``docs`` are not read. Repeated rows give repeated results; a null doc_id is judged like any other, but
    takes no part in the choice of cutoffs. Without labels no cutoff is certified and the base rule alone decides.
    """
    return _judged(cut(features(docs, stratum)), labels, alpha, delta, min_words, max_repeat_percent)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever these are called.

    Each row is judged by its own text, also where several rows have one doc_id or none.
    """
    feats = cut(features(docs, stratum, carry=True))
    return _judged(feats, labels, alpha, delta, min_words, max_repeat_percent).where("kept").select("_row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _bin_sql(rule: str) -> str:
    over, under = RULES[rule]
    return f"CASE WHEN {under} > 0 THEN least(({GRID} * {over} + {under} - 1) // {under}, {GRID}) WHEN {over} > 0 THEN {GRID} ELSE 0 END"


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def verdict_sql(documents: str = "documents", alpha: float = 0.05, delta: float = 0.05) -> str:
    """DuckDB CTEs ending in q_verdict(doc_id, counts, base_failed, kept)."""
    count_of = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    return f"""
q_docs AS (SELECT row_number() OVER () AS q_row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM {documents}),
q_words AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: translate(x, {_SPACE_SQL}, '') <> '') AS word_lines FROM q_docs),
q_windows AS (SELECT q_row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT q_row, words, unnest(range(1, len(words) - 1)) AS i FROM q_words WHERE len(words) > 2)),
q_twice AS (SELECT q_row, i FROM (SELECT q_row, i, count(*) OVER (PARTITION BY q_row, a, b, c) AS n FROM q_windows) WHERE n > 1),
q_repeat AS (SELECT q_row, count(DISTINCT w) AS n FROM (SELECT q_row, unnest([i, i + 1, i + 2]) AS w FROM q_twice) GROUP BY q_row),
q_feats AS (SELECT q_row, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, length(translate(text, {_SPACE_SQL}, '')) AS word_chars,
  {count_of(SYMBOLS)} AS n_symbols, CAST(len(word_lines) - len(list_distinct(word_lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(word_lines) AS n_word_lines, {count_of(UPPER)} AS n_capitals,
  {count_of("0123456789")} AS n_digits, {count_of("!")} AS n_bangs FROM q_words LEFT JOIN q_repeat r USING (q_row)),
q_good AS (SELECT * FROM q_feats WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
q_binned AS ({" UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {_bin_sql(r)} AS bin FROM q_good" for r in RULES)}),
q_tests AS (SELECT stratum, rule, j, count(*) AS n, count(*) FILTER (bin > j) AS k FROM q_binned, range(0, {GRID}) g(j) GROUP BY stratum, rule, j),
q_passed AS (SELECT stratum, rule, min(j) AS cutoff FROM q_tests WHERE k < {alpha / len(RULES)!r} * n AND
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha / len(RULES)!r}) + (n - i) * ln({1 - alpha / len(RULES)!r}))))
  <= {delta!r} / ((SELECT count(DISTINCT stratum) FROM q_good) * {len(RULES)} * {GRID}) GROUP BY stratum, rule),
q_cuts AS (SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM q_passed GROUP BY stratum),
q_verdict AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) {" ".join(f"AND NOT coalesce({_bin_sql(r)} > cut_{r}, false)" for r in RULES)} AS kept
  FROM q_feats f LEFT JOIN q_cuts USING (stratum))"""


ORACLE = f"WITH {verdict_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_verdict"
