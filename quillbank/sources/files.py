"""File sources and sinks: JSON documents, quoted CSV, text reports, a keyed cache with miss-only fetches.

Round trips go through the session's shared checkpoint folder, which every executor can read.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="files-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: How a null is written in CSV; a text of backslashes before an N is written with one more.
NULL_FIELD, NULL_LIKE = "\\N", "^\\\\+N$"
#: Blanks at either end of a field are its own, and only \n ends a line: what stands in a text is never taken for the separator.
CSV = {"header": True, "escape": '"', "lineSep": "\n", "nullValue": NULL_FIELD, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _texts(df: DataFrame, change: Callable) -> DataFrame:
    return df.select(*[change(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled; line ends and blanks inside fields stay."""
    shown = _texts(df, lambda c: F.when(c.rlike(NULL_LIKE), F.concat(F.lit("\\"), c)).otherwise(c))
    shown.write.mode("overwrite").options(**CSV).option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote, character for character."""
    rows = spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)
    return _texts(rows, lambda c: F.when(c.rlike(NULL_LIKE), F.substr(c, F.lit(2))).otherwise(c))


def cached_fetch(wanted: DataFrame, cache: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache's rows for ``wanted`` and, for the keys it misses, what ``fetch`` gives for those alone."""
    keys = wanted.select(key).distinct()
    hits = cache.join(keys, key, "left_semi")
    return hits.unionByName(fetch(keys.join(cache.select(key), key, "left_anti")).select(*cache.columns))


def paged_scan(spark: SparkSession, path: str, schema: str, accept: str, target: int) -> DataFrame:
    """The accepted rows of landed pages (folders page=0, page=1 ...; ``p`` numbers all rows), as many as ``target``.

    Pages are taken in order for as long as those before have too few accepted rows, up to the first that is missing or
    empty, as a reader that asks for page after page would. What is decided from is one count for each page.
    """
    rows = spark.read.schema(schema + ", page bigint").json(path)
    counts = {r["page"]: (r["n"], r["k"]) for r in rows.groupBy("page").agg(F.count("*").alias("n"), F.count(F.when(F.expr(accept), 1)).alias("k")).collect()}
    page, found = 0, 0
    while found < target and counts.get(page, (0, 0))[0]:
        found += counts[page][1]
        page += 1
    return rows.where(F.col("page") < page).where(accept).orderBy("p").limit(target)


def bounded_map(df: DataFrame, column: str, worker: Callable, result: str) -> DataFrame:
    """``df`` with the worker's ``result`` (name and type) for ``column`` and ``error``, what a failed row raised.

    A task works row after row, so as many run at once as there are task slots; repartition to bound it further.
    """
    name = result.split()[0]

    def run(batches):
        for pdf in batches:
            done, errors = [], []
            for x in pdf[column].tolist():
                try:
                    done.append(worker(x))
                    errors.append(None)
                except Exception as e:  # the row says so and the others go on
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{name: done, "error": errors}).astype({name: "object"})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kept}, {result}, error string")


def called(df: DataFrame, column: str, call: Callable, attempts: int = 6, base: float = 1.0, sleep: bool = True) -> DataFrame:
    """``df`` with status, body, attempts and waited from ``call`` (key, attempt) -> (status, body).

    Statuses 429 and from 500 up are tried again, up to ``attempts`` times, after ``base`` * 2 ** k seconds; any other is
    final at once. Without ``sleep`` the waiting is only counted.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for key in pdf[column].tolist():
                waited = 0.0
                for k in range(attempts):
                    status, body = call(key, k)
                    if status != 429 and status < 500 or k + 1 == attempts:
                        break
                    waited += base * 2**k
                    if sleep:
                        time.sleep(base * 2**k)
                rows.append((status, body, k + 1, waited))
            status, body, tried, waited = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pdf.assign(status=status, body=body, attempts=tried, waited=waited)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kept}, status int, body string, attempts int, waited double")


def settings(lines: DataFrame, present: DataFrame) -> DataFrame:
    """key, value: ``present`` and, for keys that it lacks, the last KEY=VALUE line (value, with ``at``, its place) of each.

    Lines that are no setting do not count; quotes around a value and blanks go.
    """
    pattern = "^[ \\t]*([A-Za-z_][A-Za-z0-9_]*)[ \\t]*=(.*)$"
    parsed = lines.select("at", F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("value", pattern, 2)), "^\"|\"$", "").alias("value")).where("key <> ''")
    last = parsed.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return present.select("key", "value").unionByName(last.join(present.select("key"), "key", "left_anti"))


def latex_rows(df: DataFrame) -> DataFrame:
    """A line of a LaTeX table for each row, its columns in order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in df.columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def macro_rows(df: DataFrame, prefix: str) -> DataFrame:
    """Name and value of every column of a one-row table, as \\newcommand lines."""
    pairs = F.explode(F.array(*[F.struct(F.lit(prefix + c.title().replace("_", "")).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns]))
    return df.select(pairs.alias("x")).select("x.name", "x.value", F.concat(F.lit("\\newcommand{\\"), F.col("x.name"), F.lit("}{"), F.col("x.value"), F.lit("}")).alias("line"))
