"""op9: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from . import html_extract
from ._common import table


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.fit(pages))
