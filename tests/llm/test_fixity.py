import hashlib

from vectide.llm import fixity

SCHEMA = "page_id long, url string, html string, file string, slot string"


def test_damage_is_located(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 7), "x", "y") for i in range(0, 9000, 3)]
    other = [r for r in rows if r[0] != 30] + [(31, "u", "new", "x", "y"), rows[5]]
    other[100] = (*other[100][:2], "changed", "x", "y")
    got = fixity.audit(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)).collect()
    assert {(r["page_id"], r["status"]) for r in got} == {(30, "missing"), (31, "extra"), (other[100][0], "corrupt")}
    raw = lambda r: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1]}\r\nContent-Length: {len(r[2].encode())}\r\n\r\n{r[2]}\r\n\r\n".encode()
    sizes = [len(raw(r)) for r in rows if r[0] < 30]
    lost = next(r for r in got if r["status"] == "missing")
    assert (lost["start"], lost["length"]) == (sum(sizes), len(raw(rows[10])))
    level = [(r[0] % fixity.SPAN, len(raw(r)), hashlib.sha256(raw(r)).hexdigest()) for r in rows if r[0] < fixity.SPAN]
    for _ in range(fixity.LEVELS):
        above = []
        for k in sorted({s // fixity.FANOUT for s, *_ in level}):
            mine, at, parts = [x for x in level if x[0] // fixity.FANOUT == k], 0, []
            for s, n, d in mine:
                parts.append(f"{s}:{at}-{at + n}:{d}")
                at += n
            above.append((k, at, hashlib.sha256(",".join(parts).encode()).hexdigest()))
        level = above
    assert lost["primary_root"] == level[0][2]


def test_ranges_are_in_the_digests(spark):
    """Nodes of the same leaves' digests at other offsets differ, and a record that a sibling moves isn't itself damaged."""
    nodes = spark.createDataFrame([(0, 0, 5, "a"), (0, 1, 7, "b"), (1, 0, 7, "a"), (1, 1, 5, "b")], "file long, slot long, length long, digest string")
    assert len({r["digest"] for r in fixity.parents(nodes).collect()}) == 2
    rows = [(i, "u", "x" * 50, "f", "s") for i in range(40)]
    longer = [(i, u, h + "yy" if i == 3 else h, f, s) for i, u, h, f, s in rows]
    got = fixity.audit(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(longer, SCHEMA)).collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(3, "corrupt")]


def test_odd_pages(spark):
    rows = [(1, None, None, "a", "b"), (1, None, None, "a", "b"), (2, "u", "", "a", "b"), (2, "u", "two", "a", "b"), (None, "u", "x", "a", "b"), (3, "u", "z" * 100_000, "a", "b")]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert fixity.audit(spark, pages, pages).count() == 0
    assert [r["page_id"] for r in fixity.audit(spark, pages, pages.filter("html <> 'two' or html is null")).collect()] == [2]
    assert fixity.audit(spark, pages.limit(0), pages.limit(0)).count() == 0
