"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """What ``make`` gives, made once for a session and input: tables that several queries read are written once, like a stage's output."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def sql_in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_case(pairs: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


#: The page's link parts in DuckDB, from a subquery that has ``url``.
PARTS_SQL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def host_sql(url: str = "url") -> str:
    return rf"regexp_replace(lower(regexp_replace(regexp_extract(trim({url}), '{PARTS_SQL}', 2), '^.*@', '')), ':\d+$', '')"


def normal_sql(url: str, fragment: bool) -> str:
    def p(n: int) -> str:
        return f"regexp_extract(trim({url}), '{PARTS_SQL}', {n})"

    host = rf"lower(regexp_replace({p(2)}, '^.*@', ''))"
    port = rf"CASE lower({p(1)}) WHEN 'http' THEN regexp_replace({host}, ':80$', '') WHEN 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    tail = rf" || regexp_replace({p(5)}, '^#$', '')" if fragment else ""
    whole = rf"lower({p(1)}) || '://' || regexp_extract({p(2)}, '^(.*@)', 1) || {port} || CASE WHEN {p(3)} = '' THEN '/' ELSE {p(3)} END || regexp_replace({p(4)}, '^\?$', ''){tail}"
    return f"CASE WHEN {p(1)} = '' OR {p(2)} = '' THEN trim({url}) ELSE {whole} END"


#: Every page, and three rewritten spellings of it that normalise to the same link (or differ by fragment).
def spelled(pages: DataFrame) -> DataFrame:
    variants = F.array(
        F.col("url"), F.concat(F.upper(F.regexp_extract("url", "^(https?://[^/?#]*)", 1)), F.regexp_replace("url", "^https?://[^/?#]*", "")),
        F.concat(F.lit("  "), F.col("url")), F.concat(F.col("url"), F.lit("#part")),
    )
    rows = pages.select("page_id", F.posexplode(variants).alias("variant", "link"))
    return rows.select((F.col("variant").cast("long") * 1_000_000_000 + F.col("page_id")).cast("long").alias("ord"), F.col("link").alias("url"))


SPELLED_SQL = """SELECT CAST(variant AS BIGINT) * 1000000000 + page_id AS ord, link AS url FROM (
  SELECT page_id, 0 AS variant, url AS link FROM pages UNION ALL
  SELECT page_id, 1, upper(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_replace(url, '^https?://[^/?#]*', '') FROM pages UNION ALL
  SELECT page_id, 2, '  ' || url FROM pages UNION ALL
  SELECT page_id, 3, url || '#part' FROM pages)"""
