from pyspark.sql import functions as F

from weftline.plans import text_queries


def test_every_catalog_name_is_batched(spark, small_dir):
    names = text_queries.catalog(spark, small_dir).select("name").distinct().count()
    assert text_queries.batch_requests(spark, small_dir).agg(F.sum("size")).first()[0] == names > 100
