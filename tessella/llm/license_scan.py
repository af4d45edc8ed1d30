"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to one form: A-Z in lower case, ASCII punctuation and white
space to single spaces, equivalent spellings to one of them, copyright lines and
empty lines left out. The digest of this form, of the entire text and of each of
its lines, is joined by hash to the digests of known licences and notices, which
go through the same steps.

Nulls and odd cases: a null text counts as empty, and an empty form matches
nothing; whole texts are used, however long; a null id passes through; repeated
rows get a result each; an empty table gives no row. Only the named columns are
read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hot_join
from tessella.llm.licences import EQUAL_WORDS, KNOWN
from tessella.workspace import Workspace

#: Known digests up to this number are looked up inside the scan and broadcast; more are joined by shuffle.
INLINE = 4_096
_SPACES = string.punctuation + "\t\r\x0b\x0c"
FROM, TO = string.ascii_uppercase + _SPACES, string.ascii_lowercase + " " * len(_SPACES)
COPYRIGHT = r"^((portions )?(copyright|copr)( c| ©)? ?([0-9]{4}|year)|(c|©) (copyright )?[0-9]{4}|copyright (c|©) |all rights reserved$)"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, empty and copyright lines included."""
    plain = F.translate(F.coalesce(text, F.lit("")), FROM, TO)
    # two spaces between words, so that a word's own pair of spaces can be replaced with it
    spaced = F.concat(F.lit(" "), F.replace(F.replace(plain, F.lit("\n"), F.lit(" \n ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    spaced = F.regexp_replace(spaced, " {3,}", "  ")
    for word, one in EQUAL_WORDS:
        spaced = F.replace(spaced, F.lit(f" {word} "), F.lit(f" {one} "))
    return F.transform(F.split(F.regexp_replace(spaced, " +", " "), "\n"), lambda line: F.trim(line))


def canonical(lines: Column) -> Column:
    """The entire text from its canonical lines."""
    return F.array_join(F.filter(lines, lambda line: (line != "") & ~line.rlike(COPYRIGHT)), " ")


def known_digests(spark, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license_id and digest of each known text; one row for each distinct pair."""
    texts = spark.createDataFrame(list(known), "license_id string, text string")
    return texts.select("license_id", F.md5(canonical(canonical_lines(F.col("text")))).alias("digest")).distinct()


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id, line_licenses and n_license_lines for every row.

    digest is that of the entire text, null if its form is empty, and license_id
    the least known licence with it; line_licenses names the licences whose
    notice is an entire line, sorted and joined by commas; n_license_lines counts
    these lines. ``known`` is a list of licences of any length: up to ``INLINE``
    digests are looked up as each line is read, and more meet the digests of all
    lines by shuffle.
    """
    work = Workspace(df.sparkSession, "licences")
    known = known if known is not None else known_digests(df.sparkSession)
    one = work.save(known.where(F.col("digest") != F.md5(F.lit(""))).groupBy("digest").agg(F.min("license_id").alias("license_id")), "known")
    listed = sorted(row["digest"] for row in one.select("digest").limit(INLINE + 1).collect())
    few = len(listed) <= INLINE
    lines = df.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    whole = F.when(canonical(F.col("lines")) != "", F.md5(canonical(F.col("lines"))))
    if few:
        among = ", ".join(f"'{d}'" for d in listed)  # parsed at once, as a call for each would take seconds
        hits = F.expr(f"filter(transform(lines, line -> md5(line)), d -> d IN ({among}))") if listed else F.array().cast("array<string>")
    else:
        hits = F.expr("transform(filter(lines, line -> line != ''), line -> md5(line))")
    rows = work.save(lines.select("doc_id", whole.alias("digest"), hits.alias("hits")).withColumn("row", F.monotonically_increasing_id()), "digests")
    each = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("digest"))
    if few:
        by_line, by_text = each.join(F.broadcast(one), "digest"), rows.join(F.broadcast(one), "digest", "left")
    else:  # frequent lines and texts are joined apart from the others
        each = work.save(each, "lines")
        by_line = hot_join(each, one, ["digest"], each.count(), "inner")
        named = work.save(rows.select("doc_id", F.coalesce("digest", F.lit("")).alias("digest"), "row"), "texts")
        by_text = hot_join(named, one, ["digest"], named.count()).withColumn("digest", F.nullif(F.col("digest"), F.lit("")))
    by_row = by_line.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    joined = by_text.join(by_row, "row", "left")
    return joined.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"))


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """DuckDB SQL for the rows of scan() over documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    special = "".join(f"|| chr({ord(c)})" for c in "\t\r\x0b\x0c")
    source = f"({quoted(string.ascii_uppercase + string.punctuation)} {special})"
    spaced = f"' ' || replace(replace(translate(coalesce(text, ''), {source}, {quoted(TO)}), chr(10), ' ' || chr(10) || ' '), ' ', '  ') || ' '"
    spaced = f"regexp_replace({spaced}, ' {{3,}}', '  ', 'g')"
    for word, one in EQUAL_WORDS:
        spaced = f"replace({spaced}, ' {word} ', ' {one} ')"
    lines = f"list_transform(string_split(regexp_replace({spaced}, ' +', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))"
    whole = f"array_to_string(list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}')), ' ')"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in known)
    return f"""
WITH known AS (SELECT md5({whole}) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {lines} AS lines FROM (VALUES {values}) v(license_id, text)) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, lines, {whole} AS whole FROM (SELECT doc_id, {lines} AS lines FROM documents)),
hit AS (SELECT row_no, license_id FROM (SELECT row_no, md5(unnest(lines)) AS digest FROM docs) JOIN known USING (digest)),
by_row AS (SELECT row_no, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n FROM hit GROUP BY 1)
SELECT doc_id, CASE WHEN whole <> '' THEN md5(whole) END AS digest, known.license_id, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM docs LEFT JOIN known ON known.digest = CASE WHEN whole <> '' THEN md5(whole) END LEFT JOIN by_row USING (row_no)"""
