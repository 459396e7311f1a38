"""Pages that come in over time."""

from pricelore.streaming import incoming


def test_products_of_pages_as_they_land(spark, tmp_path):
    land = lambda n, text: spark.createDataFrame([(f"d{n}", 1, text)], incoming.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def read():
        incoming.write_products(incoming.pages_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
        return sorted((r.source_file, r.art_no, r.price, r.exported) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    land(1, "QX4471 Garden bench EUR 310\nplain words\nQX4472 Stool EUR 12,50")
    first = [("d1", "QX4471", 310.0, True), ("d1", "QX4472", 12.5, True)]
    assert read() == first and read() == first
    land(2, "QX4473 Lamp")
    assert read() == [*first, ("d2", "QX4473", None, False)]
    whole = incoming.products(spark.read.schema(incoming.PAGES).parquet(str(tmp_path / "in")))
    assert whole.count() == 3
