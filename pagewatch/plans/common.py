"""Tables by name, and pieces of SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array) -> F.Column:
    """An array as one string, to compare between engines."""
    return F.array_join(array, "|")


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


def host(url="url"):
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))


#: page_text as SQL over a column.
def page_text_sql(col: str) -> str:
    x = col
    for p in (r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<!--.*?-->"):
        x = f"regexp_replace({x}, '{p}', ' ', 'gis')"
    x = rf"regexp_replace({x}, '</(p|div|li|h[1-6]|tr|section|article|br)\s*>', chr(10), 'gi')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' *\n *', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def stable_digest_sql(col: str) -> str:
    x = col
    for p in (r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<!--.*?-->", r'\s(?:nonce|data-nonce|csrf[-_]token)="[^"]*"'):
        x = f"regexp_replace({x}, '{p}', '', 'gis')"
    return rf"sha256(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
