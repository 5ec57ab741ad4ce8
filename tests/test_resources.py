"""Resources of pages against plain sums and a millisecond count."""

from __future__ import annotations

import random

from sitequarry.operators import resources

SCHEMA = "page_id long, url string, kind string, bytes long, start_ms double, end_ms double, deferred boolean"


def test_sweep_against_every_millisecond(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), f"https://e.com/{k}", rng.choice(["script", "stylesheet", "image"]), rng.choice([None, 5]), float(s := rng.randrange(60)), float(s + rng.randrange(30)), rng.choice([True, False, False, None])) for k in range(400)]
    rows += [(1, "https://e.com/x", "script", 1, None, 3.0, False), (1, "https://e.com/y", "script", 1, 3.0, None, False)]
    paints = [(p, None if p == 7 else 10 + p) for p in range(32)]
    got = {r.page_id: (r.blocking, r.blocked_ms) for r in resources.render_blocking(resources.per_request(resources.keyed(spark.createDataFrame(rows, SCHEMA))), spark.createDataFrame(paints, "page_id long, first_paint_ms long")).collect()}
    for page, paint in paints:
        own = [r for r in rows if r[0] == page and paint is not None and r[2] != "image" and not r[6] and r[4] is not None and r[5] is not None and r[4] < paint and r[5] > r[4]]
        covered = sum(any(r[4] <= ms and r[5] >= ms + 1 for r in own) for ms in range(paint or 0))
        assert got[page] == (len(own), covered)


def test_bytes_by_url(spark):
    rows = [(1, "https://E.com:443/a.png?utm_source=q", "image", 300_000, 0.0, 1.0, False), (1, "https://e.com/a.png", "image", 100, 0.0, 1.0, False), (2, "https://e.com/b.png", "image", None, 0.0, 1.0, False), (2, "data:image/png;base64,xx", "image", 7, 0.0, 1.0, None), (3, None, "image", 1, 0.0, 1.0, False)]
    requests = resources.per_request(resources.keyed(spark.createDataFrame(rows, SCHEMA)))
    assert {(r.page_id, r.key, r.bytes) for r in requests.collect()} == {(1, "https://e.com/a.png", 300_000), (2, "https://e.com/b.png", None), (2, "data:image/png;base64,xx", 7)}
    images = spark.createDataFrame([(1, 0, "https://e.com/a.png"), (2, 0, "https://e.com/a.png"), (2, 1, "https://e.com/b.png"), (4, 0, "https://e.com/none.png")], "page_id long, position int, src_key string")
    sized = resources.image_bytes(images, requests)
    assert {(r.page_id, r.position): r.bytes for r in sized.collect()} == {(1, 0): 300_000, (2, 0): 300_000, (2, 1): None, (4, 0): None}
    assert tuple(resources.heavy_images(sized).first()) == (2, 2)
    weights = resources.page_weights(spark.createDataFrame([(1, 10), (2, None), (5, 3)], "page_id long, html_bytes long"), requests)
    assert {r.page_id: (r.weight, r.requests, r.unmeasured) for r in weights.collect()} == {1: (300_010, 1, 0), 2: (7, 2, 1), 5: (3, 0, 0)}
