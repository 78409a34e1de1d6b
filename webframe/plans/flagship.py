"""The flagship query: links that stay on their host, counted per host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions.urls import url_host
from webframe.operators.extract import page_links
from webframe.plans.views import pages


def same_host_links_by_host(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.filter("links", lambda x: x["same_host"]))
    per_page = page_links(pages(spark, sf)).select(url_host("src").alias("host"), n.alias("n"))
    return per_page.where("n > 0").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_links")
    )
