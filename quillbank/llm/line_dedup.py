"""Line dedup across documents, in DataFrame expressions alone.

One narrow pass over the text writes the hashes of each row's normalised lines. From there the rows that hold a hash are
counted; the hashes that may be over the threshold are placed at their line positions, and only those are counted by
distinct doc_id. Only hashes and positions are shuffled, pre-aggregated, joined, or spread by line and document, so a line
that a third of the documents hold is no hot spot. The text is shuffled once, by a hash of doc_id and text, to be put together again from the
slices between dropped positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.llm.shared import LOWER, SPACES, UPPER, cut, read


#: 128 bits of a row's doc_id and text, never null.
ROW = ["_line_row_a", "_line_row_b"]


def line_hashes() -> F.Column:
    """128 bits for each line of ``text``, null where the normalised line is empty."""
    key = lambda line: F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)
    both = lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(1)).alias("b")))
    return F.transform(F.split("text", "\n"), lambda line: both(key(line)))


#: Lines whose hashes are broadcast at most; beyond it a join on the hash and one of SALTS parts of the rows takes its place.
BROADCAST_LINES, SALTS = 500_000, 16


def _among(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose hash ``lines`` (a written table) has; a line that many rows hold does not meet in one task."""
    if lines.count() <= BROADCAST_LINES:
        return placed.join(F.broadcast(lines), ["a", "b"], "left_semi")
    salted = lines.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return placed.withColumn("_salt", F.pmod(ROW[0], F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["a", "b", "_salt"], "left_semi").drop("_salt")


def line_dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """All columns of ``docs``, with ``text`` without the repeated lines, and ``n_lines`` and ``n_dropped``.

    Documents are counted by distinct doc_id, as in the SQL: rows of one doc_id count once, rows without one do not count.
    Frequent lines are dropped from every row, repeated ones and those without a doc_id too. A null text is one empty
    line and comes back as the empty text; empty lines are never dropped. Columns of ``docs`` named n_lines or n_dropped
    are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "_line_bad", *ROW).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({ROW[0]: F.xxhash64("doc_id", "text"), ROW[1]: F.xxhash64(F.lit(1), "doc_id", "text")})  # equal rows share a key: their positions are the same
    hashed = cut(keyed.select("doc_id", *ROW, line_hashes().alias("h")))
    each = hashed.select(F.explode(F.array_distinct("h")).alias("h")).where("h IS NOT NULL").groupBy("h.a", "h.b").agg(F.count("*").alias("n"))
    candidates = cut(each.where(F.col("n") >= min_docs).select("a", "b"))
    placed = hashed.select("doc_id", *ROW, F.posexplode("h").alias("pos", "h")).where("h IS NOT NULL").select("doc_id", *ROW, "pos", "h.a", "h.b")
    placed = cut(_among(placed, candidates))
    ids = placed.select("a", "b", "doc_id").where("doc_id IS NOT NULL").distinct()  # spreads a line's documents; then each line's number is summed
    frequent = cut(ids.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    bad = cut(_among(placed, frequent).groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("_line_bad")))
    joined = keyed.join(bad.hint("merge"), ROW, "left")  # one plan at every size
    kept = """CASE WHEN _line_bad IS NULL THEN text ELSE element_at(transform(array(split(text, '\\n')), lines ->
        element_at(transform(array(concat(array(-1), _line_bad, array(size(lines)))), b ->
          concat_ws('\\n', flatten(transform(slice(b, 1, size(b) - 1), (x, i) -> slice(lines, x + 2, b[i + 1] - x - 1))))), 1)), 1) END"""
    return joined.select(
        *[c for c in docs.columns if c != "text"],
        F.expr(kept).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_line_bad"), F.lit(0)).cast("long").alias("n_dropped"),
    ).select(*docs.columns, "n_lines", "n_dropped")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def kept_sql(documents: str = "documents", min_docs: int = 10) -> str:
    """DuckDB CTEs ending in l_kept(doc_id, n_lines, n_dropped, text)."""
    return f"""
l_lines AS (SELECT doc_id, i, line, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {documents})),
l_often AS (SELECT key FROM l_lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
l_marked AS (SELECT l.*, o.key IS NOT NULL AS gone FROM l_lines l LEFT JOIN l_often o ON l.key = o.key),
l_kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM l_marked GROUP BY doc_id)"""


ORACLE = f"WITH {kept_sql()} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM l_kept"
