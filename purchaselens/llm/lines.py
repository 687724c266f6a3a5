"""Line dedup by site-relative frequency.

Per host, the pages holding a line are divided by the pages of the host; a line above the
boilerplate ratio is dropped from every page of that host. A page is a distinct text: copies
of one page count once, on both sides of the division, so that a page copied many times does
not turn its own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchaselens.llm.common import checked_join, stored, without

#: A line on more than this share of a host's pages is boilerplate ...
RATIO = 0.08
#: ... if more than one page has it: a line on a single page is repeated nowhere.
MIN_PAGES = 2

_HOST, _PAGE, _LINE = "__host", ("__page_1", "__page_2"), ("__line_1", "__line_2")


def _keys(line) -> list:
    """128 hash bits of a line."""
    return [F.xxhash64(line), F.xxhash64(F.lit(1), line)]


def _host(column: str):
    return F.coalesce(F.concat(F.lit("h"), F.col(column).cast("string")), F.lit(""))


def boilerplate(
    docs: DataFrame, *, text: str = "text", host: str = "source",
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, key_1, key_2, n_pages, host_pages) of every boilerplate line, by its hash.

    Lines are what ``\\n`` separates; empty ones are not counted. A NULL host is a host of its
    own, a NULL text has no lines but is a page. Lines and pages go by hash: their texts are
    not shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    pages = docs.select(
        _host(host).alias(_HOST), *[k.alias(n) for k, n in zip(_keys(body), _PAGE, strict=True)],
        F.col(text).alias("t"),
    )
    totals = pages.select(_HOST, *_PAGE).distinct().groupBy(_HOST).agg(
        F.count("*").alias("host_pages")
    )
    lines = pages.select(_HOST, *_PAGE, F.explode(F.split("t", "\n", -1)).alias("line")).where(
        "line <> ''"
    ).select(_HOST, *_PAGE, *[k.alias(n) for k, n in zip(_keys("line"), _LINE, strict=True)])
    # Distinct before counting: one row per host, line and page, combined map-side; then one
    # per host and line, again combined, so a line on a third of all pages is no hot key.
    counts = (
        lines.distinct().groupBy(_HOST, *_LINE).agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    return counts.join(totals, _HOST).where(
        F.col("n_pages") > F.lit(ratio) * F.col("host_pages")
    )


def drop_boilerplate(
    docs: DataFrame, *, text: str = "text", host: str = "source",
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``docs`` with the text cleaned and ``n_dropped`` (lines taken out) added.

    Every row stays, with its other columns; a NULL text stays NULL with 0 dropped; a text all
    of whose lines go becomes empty; an ``n_dropped`` of the input is replaced. Repeated rows
    are treated alike. A host's list holds at most (lines per page / ratio) lines.
    """
    found = boilerplate(docs, text=text, host=host, ratio=ratio, min_pages=min_pages)
    per_host = stored(
        found.groupBy(_HOST).agg(*[F.collect_set(n).alias(n) for n in _LINE]), "boilerplate"
    )
    keyed = without(docs, ["n_dropped"]).withColumn(_HOST, _host(host))
    joined = checked_join(keyed, per_host, _HOST, "left")
    lines = F.split(F.col(text), "\n", -1)

    def stays(line):
        a, b = _keys(line)
        return (line == "") | ~(F.array_contains(_LINE[0], a) & F.array_contains(_LINE[1], b))

    kept = F.when(F.col(_LINE[0]).isNull(), lines).otherwise(F.filter(lines, stays))
    dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    out = [
        F.array_join(kept, "\n").alias(text) if c == text else F.col(f"`{c}`")
        for c in keyed.columns if c != _HOST
    ]
    return joined.select(*out, dropped.cast("bigint").alias("n_dropped"))


def sql(ratio: float = RATIO, min_pages: int = MIN_PAGES, source: str = "documents") -> str:
    """The same rows in SQL."""
    return f"""
  pages AS (SELECT DISTINCT source, coalesce(text, '') AS page FROM {source}),
  totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
  per_line AS (
    SELECT source, line, count(DISTINCT page) AS n_pages
    FROM (SELECT source, page, unnest(string_split(page, chr(10))) AS line FROM pages)
    WHERE line <> '' GROUP BY source, line),
  bad AS (
    SELECT p.source, list(line) AS bad_lines FROM per_line p
    JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
    WHERE n_pages >= {min_pages} AND n_pages > {ratio!r}::DOUBLE * host_pages GROUP BY p.source),
  cleaned AS (
    SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text AS old_text,
           CASE WHEN d.text IS NULL THEN NULL ELSE array_to_string(list_filter(
             string_split(d.text, chr(10)),
             lambda x: x = '' OR NOT list_contains(coalesce(b.bad_lines, []), x)), chr(10)) END AS text
    FROM {source} d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)"""
