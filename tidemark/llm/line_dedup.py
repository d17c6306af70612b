"""Line deduplication by distinct-site spread.

A line is boilerplate if it stands on ``min_sites`` different sites or more. HyperLogLog
sketches of the sites, merged by aggregation, tell the spread of every line; only lines
whose estimate is too near the threshold to tell get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, settle, spread_join, text_key, unused

MIN_SITES = 5
#: Shorter lines are ordinary text that recurs by chance.
MIN_CHARS = 16
#: log2 of the registers of a sketch; the relative error of an estimate is 1.04 / sqrt(registers).
LOG_REGISTERS = 12


def lines(docs: DataFrame, site: str) -> DataFrame:
    """id, key, site, at (from 0) and h (hash) of every line that is long enough to be boilerplate and not blank."""
    cut = docs.select(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return cut.filter((F.char_length("line") >= MIN_CHARS) & F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", "key", "site", "at", F.xxhash64("line").alias("h"))


def _with_hashes(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """The lines with one of these hashes, which are settled; a line that is everywhere is not one task's work."""
    if fits_broadcast(hashes.count()):
        return found.join(F.broadcast(hashes), "h", "left_semi")
    return spread_join(settle(found), hashes, ["h"], "left_semi")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """h of every line on ``min_sites`` sites or more; a null site and an empty one are one site of their own."""
    found = lines(docs, site)
    margin = max(1.0, 4 * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    spread = settle(found.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("about")).filter(F.col("about") >= min_sites - margin))
    sure = spread.filter(F.col("about") > min_sites + margin).select("h")
    near = settle(spread.filter(F.col("about") <= min_sites + margin).select("h"))
    exact = _with_hashes(found.select("h", "site", "key"), near).select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return sure.union(exact.filter(F.col("n") >= min_sites).select("h"))


def _cut(docs: DataFrame, site: str, min_sites: int, among: DataFrame | None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the lines left in ``text``, and the names of the columns beside: numbers of lines and of lines cut."""
    name = dict(zip(("id", "key", "places", "lines", "n_lines", "n_cut"), unused(docs.columns, "id", "key", "places", "lines", "n_lines", "n_cut")))
    spread = settle(boilerplate(docs if among is None else among, site, min_sites))
    places = _with_hashes(lines(docs, site), spread).groupBy("id", "key").agg(F.collect_set("at").alias(name["places"]))
    places = settle(places.select(F.col("id").alias(name["id"]), F.col("key").alias(f"{name['key']}_at"), name["places"]))
    rows, numbers = places.agg(F.count("*"), F.sum(F.size(name["places"]))).first()
    if fits_broadcast(2 * rows, 8 * (numbers or 0)):
        places = F.broadcast(places)  # else texts are shuffled
    # lines travel in place of the text, and those that stay are picked by number, in time that grows with the text alone
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(*others, text_key(F.col("text")).alias(name["key"]), F.split("text", "\n", -1).alias(name["lines"]))
    beside = cut.join(places, (F.col(name["key"]) == F.col(f"{name['key']}_at")) & F.col("doc_id").eqNullSafe(F.col(name["id"])), "left")
    all_lines = F.col(name["lines"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(name["places"]))
    left = F.when(F.col(name["places"]).isNull(), all_lines).otherwise(F.transform(stay, lambda i: F.get(all_lines, i)))
    kept = [F.array_join(left, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    counts = (F.coalesce(F.size(all_lines), F.lit(0)), F.coalesce(F.size(name["places"]), F.lit(0)))
    return beside.select(*kept, *(c.cast("long").alias(name[k]) for c, k in zip(counts, ("n_lines", "n_cut")))), name


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, among: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``.

    Where ``among`` is given, it holds one document of each group of copies: only its lines count
    for the spread, so that copies alone spread nothing, and the lines found go from every document.
    Null and empty texts stay; a text of spread lines alone becomes empty; repeated rows lose the same
    lines, and equal lines of one text go together, so that ties need no order. An empty table gives none. A very
    long text is one row of lines. All other columns pass unchanged, whatever their names.
    """
    return _cut(docs, site, min_sites, among)[0].select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_cut (lines on enough sites) and the SHA-256 of the text that is left (null: none)."""
    done, name = _cut(docs.select("doc_id", "text", "source"), "source", MIN_SITES, None)
    return done.select("doc_id", F.col(name["n_lines"]).alias("n_lines"), F.col(name["n_cut"]).alias("n_cut"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: The same report in DuckDB, with exact distinct counts throughout.
REPORT_SQL = r"""
WITH cut AS (
  SELECT rowid AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), line AS (
  SELECT r, source, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line FROM cut
), long_line AS (
  SELECT * FROM line WHERE length(line) >= 16 AND regexp_matches(line, '[^\x20\x09-\x0D]')
), spread AS (
  SELECT line FROM long_line GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5
), found AS (
  SELECT r, count(*) AS n, list(pos) AS places FROM long_line WHERE line IN (SELECT line FROM spread) GROUP BY r
), remaining AS (
  SELECT line.r, string_agg(line.line, chr(10) ORDER BY line.pos) AS rest
  FROM line JOIN found ON line.r = found.r WHERE NOT list_contains(found.places, line.pos) GROUP BY line.r
)
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_cut,
       sha256(CASE WHEN n IS NULL THEN text ELSE coalesce(rest, '') END) AS text_sha256
FROM cut LEFT JOIN found USING (r) LEFT JOIN remaining USING (r)
"""
