"""Which urls stand anywhere in the content of their scope: many patterns in many texts, by joins on equal strings.

A url begins with its scheme, so it can only occur where a text has one. What follows such a place is cut to the lengths that urls have, and these
prefixes meet urls by equality. Distinct prefixes are taken in each task before the shuffle, so beginnings that all addresses share are few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEME = "https?://"


def url_prefixes(texts: DataFrame, scope: str, content: str, sizes: DataFrame, longest: int) -> DataFrame:
    """scope, url: the distinct beginnings, as long as some url, of what follows a scheme in a lower-cased text. Places overlap."""
    after = F.lit(f"(?s)(?=({SCHEME}.{{0,{longest}}}))")
    found = texts.select(scope, F.explode(F.regexp_extract_all(F.lower(content), after, F.lit(1))).alias("run")).distinct()
    cut = found.join(F.broadcast(sizes), F.char_length("run") >= F.col("size"))
    return cut.select(scope, F.left("run", F.col("size")).alias("url")).distinct()


def contained_urls(urls: DataFrame, texts: DataFrame, scope: str, url: str = "url", content: str = "content") -> DataFrame:
    """Add contained: whether the url (of http or https, else false) stands in some text of its scope, in any case."""
    asked = urls.select(scope, F.lower(url).alias("url")).filter(F.col("url").rlike(f"^{SCHEME}")).distinct()
    sizes = asked.select(F.char_length("url").alias("size")).distinct()  # as many rows as urls have lengths
    longest = sizes.agg(F.max("size")).first()[0] or 0
    found = url_prefixes(texts, scope, content, sizes, longest).join(asked, [scope, "url"], "left_semi").select(scope, F.col("url").alias("__url"), F.lit(True).alias("contained"))
    keyed = urls.withColumn("__url", F.lower(url))
    return keyed.join(found, [scope, "__url"], "left").withColumn("contained", F.coalesce("contained", F.lit(False))).drop("__url")

