import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from purchaselens.llm import lines, shards


def test_boilerplate_by_brute_force(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"menu\nown line {i}\n\nseen on {i % 4}\nfoot", "a" if i % 3 else None))
    rows += [(100 + i, "copied page\nof two lines", "a") for i in range(40)]  # copies are one page
    rows += [(200, None, "a"), (201, "", "a"), (202, "menu", "small"), (203, "menu\nmenu", "a"), (None, "foot", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "5 AS N_DROPPED")
    got = lines.drop_boilerplate(docs, ratio=0.3, min_pages=5).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text, r.source, r.n_dropped) for r in got) == brute_lines(rows, 0.3, 5)
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def brute_lines(rows, ratio, least):
    pages = {(s, t or "") for _, t, s in rows}
    total = Counter(s for s, _ in pages)
    held = Counter((s, x) for s, t in pages for x in set(t.split("\n")) if x)
    bad = {k for k, n in held.items() if n >= least and n > ratio * total[k[0]]}
    assert bad
    want = []
    for i, t, s in rows:
        kept = None if t is None else [x for x in t.split("\n") if (s, x) not in bad]
        want.append((i, None if t is None else "\n".join(kept), s, 0 if t is None else len(t.split("\n")) - len(kept)))
    return Counter(want)


def test_small_hosts_lose_their_boilerplate_too(spark):
    """Hosts of 1, 2, 9 and 60 pages; on the last one line stands on 4 pages (under 8 %), one on 5."""
    rows = []
    for pages in (1, 2, 9, 60):
        for i in range(pages):
            own = [f"foot of {pages}", f"page {i} of {pages}"] + ["on four"] * (i < 4) + ["on five"] * (i < 5)
            rows.append((pages * 100 + i, "\n".join(own), f"host {pages}"))
    rows.append((1, "w" * 100_000 + "\n" + "long\n" * 400_000, "host 9"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter((r.doc_id, r.text, r.source, r.n_dropped) for r in lines.drop_boilerplate(docs).collect())
    assert got == brute_lines(rows, lines.RATIO, 2)
    texts = {i: t for i, t, _, _ in got}
    assert texts[100].startswith("foot of 1\n") and texts[200] == "page 0 of 2"
    assert "on five" not in texts[6000] and "on four" in texts[6000] and "foot" not in texts[900]


def check_shards(rows, got, n_shards):
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    loads = [0] * n_shards
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        loads[r["shard"]] += r["size"]
    for s in range(n_shards):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return loads


@pytest.mark.parametrize("n_shards", [1, 2, 8])
def test_shards_are_near_equal_and_complete(spark, n_shards):
    rows = [(i, "x" * (i * 7919 % 400)) for i in range(3000)] + [(None, None), (None, "é"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS SHARD", "2 AS Slot")
    loads = check_shards(rows, shards.shard(docs, n_shards).collect(), n_shards)
    mean = sum(loads) / n_shards
    assert max(loads) - min(loads) <= 2 * (shards.TOLERANCE * mean + 401)


def test_a_group_stays_together_unless_it_is_too_large(spark):
    rows = [(i, f"text {i} " + "y" * (i % 50)) for i in range(2000)] + [(5000 + i, "copy " * 4) for i in range(30)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    assert len({r["shard"] for r in got if r.text.startswith("copy")}) == 1
    hot = rows + [(9000 + i, "hot " * 6) for i in range(2000)]
    loads = check_shards(hot, shards.shard(spark.createDataFrame(hot, "doc_id bigint, text string"), 8).collect(), 8)
    assert max(loads) - min(loads) <= 2 * (shards.TOLERANCE * sum(loads) / 8 + 60)


def test_few_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    check_shards([(1, "a")], shards.shard(docs, 8).collect(), 8)
    assert shards.shard(docs.limit(0), 8).count() == 0
    same = [(1, "one row again")] * 50
    check_shards(same, shards.shard(spark.createDataFrame(same, "doc_id bigint, text string"), 4).collect(), 4)
    assert docs.select(F.lit(1)).count() == 1


def test_shards_of_long_texts_and_equal_rows(spark):
    rows = [(1, "long é " * 300_000), (2, "w" * 100_000)] + [(k, "t" * k) for k in range(3, 300)] + [(7, "t" * 7)] * 40
    got = shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    check_shards(rows, got, 4)
