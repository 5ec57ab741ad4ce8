"""What a task of the extractor holds: facts of a few pages, and no tree of a page that is done."""

import gc

from pyspark.sql import functions as F

from sitequarry.functions.domains import Suffixes
from sitequarry.sources import extract
from sitequarry.sources.dom import Node


def test_trees_are_freed_without_a_search_for_cycles():
    gc.collect()
    gc.disable()
    try:
        for k in range(20):
            extract._facts("https://x.org/", f"<html><body><main><p>{k}<b>x</b></p></main></body></html>", None, Suffixes())
        assert sum(isinstance(o, Node) for o in gc.get_objects()) == 0
    finally:
        gc.enable()


def test_facts_given_back_in_pieces_stay_with_their_rows(spark):
    pages = spark.range(0, 1000, 1, 1).select("id", F.lit("https://x.org/").alias("url"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("<title>"), "id", F.lit("</title>"))).alias("html"))
    got = {r["id"]: r["title"] for r in extract.extract(pages).select("id", "title").collect()}
    assert got == {k: str(k) if k % 7 else None for k in range(1000)}
