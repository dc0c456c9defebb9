"""op5: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import table
from tallyguard.llm.html_text import extract
from tallyguard.llm.queries import query


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
