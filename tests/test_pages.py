import pytest

from keelson.errors import PageError
from keelson.operators import blocks
from keelson.operators.blocks import Page, PageBuilder

FRUIT = [(b"apple", b"red"), (b"banana", b"yellow"), (b"cherry", b"red")]


def built(pairs):
    page = PageBuilder()
    for k, v in pairs:
        assert page.add(k, v)
    return page


def test_known_bytes():
    page = built(FRUIT)
    assert page.size() == 61 and not page.is_empty()
    assert page.finish().hex() == "05000000030000006170706c65726564060000000600000062616e616e6179656c6c6f7706000000030000006368657272797265640000000001000000"
    data = built([(b"key1", b"value1"), (b"key2", b"value2")]).finish()
    assert data.hex() == "04000000060000006b65793176616c75653104000000060000006b65793276616c7565320000000001000000"
    assert list(Page(data)) == [(b"key1", b"value1"), (b"key2", b"value2")]
    assert built([(f"key{k}".encode(), f"value{k}".encode()) for k in (1, 2, 3)]).size() == 62


def test_lookup_and_restarts():
    page = Page(built(FRUIT).finish())
    assert list(page) == FRUIT
    assert [page.get(k) for k, _ in FRUIT] == [v for _, v in FRUIT] and page.get(b"durian") is None and page.get(b"a") is None
    many = [(f"key{k:03}".encode(), f"value{k:03}".encode()) for k in range(20)]
    page = Page(built(many).finish())
    assert page.restarts == [0, 352] and len(page.data) == 452
    assert all(page.get(k) == v for k, v in many)


def test_fill_and_limits():
    page, n = PageBuilder(), 0
    while page.add(f"key{n:06}".encode(), b"x" * 100):
        n += 1
    assert (n, page.size(), page.restarts) == (34, 3994, [0, 1872, 3744])
    assert PageBuilder().add(b"k", b"x" * 4075) and not PageBuilder().add(b"k", b"x" * 4076)
    empty = PageBuilder().finish()
    assert empty.hex() == "0000000001000000" and Page(empty).get(b"a") is None and list(Page(empty)) == []


@pytest.mark.parametrize("data", [b"", b"abc", bytes(4), b"\x00" * 4 + b"\xff\xff\xff\x7f", b"\xff\x00\x00\x00" * 3 + b"\x01\x00\x00\x00"])
def test_damaged_pages(data):
    with pytest.raises(PageError):
        list(Page(data))


def test_runs_of_pages(spark):
    rows = [(r, f"k{k:04}".encode(), b"v" * (k % 200)) for r in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "run int, key binary, value binary")
    pages = blocks.pack(df).cache()
    assert all(r["size"] <= 4096 for r in pages.collect())
    back = sorted((r["run"], bytes(r["key"]), bytes(r["value"])) for r in blocks.unpack(pages).collect())
    assert back == sorted(rows)
    probes = spark.createDataFrame([(1, b"k0007"), (2, b"k9999"), (3, b"k0001")], "run int, key binary")
    got = {(r["run"], bytes(r["key"])): r["found"] for r in blocks.lookup(pages, probes).collect()}
    assert got == {(1, b"k0007"): True, (2, b"k9999"): False, (3, b"k0001"): False}
    assert blocks.pack(df.where("false")).count() == 0
    for bad in ([(1, b"k", None)], [(1, b"k", b"x" * 5000)]):
        with pytest.raises(Exception, match="tombstone|too large"):
            blocks.pack(spark.createDataFrame(bad, "run int, key binary, value binary")).collect()


def test_whole_pages(spark):
    """Every byte of every page is packed, and every key looked up."""
    from keelson.plans import catalogue

    sf = "/root/testdata/sf0.001"
    html = {f"{r['url']}#{r['page_id']:09d}": r["html"].encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert max(map(len, html.values())) > catalogue.PIECE
    scanned = {bytes.fromhex(r["key"]).decode(): bytes.fromhex(r["value"]) for r in catalogue.QUERIES["block_scan"](spark, sf).collect()}
    whole = {}
    for key in sorted(scanned):
        whole[key[:-10]] = whole.get(key[:-10], b"") + scanned[key]
    assert whole == html
    packed = catalogue.QUERIES["block_pack"](spark, sf).collect()
    assert sum(r["entries"] for r in packed) == len(scanned) and all(r["size"] <= 4096 for r in packed)
    looked = catalogue.QUERIES["block_lookup"](spark, sf).collect()
    assert len(looked) == 2 * len(scanned)
    for r in looked:
        key = bytes.fromhex(r["key"]).decode()
        assert (r["found"], r["value"] and bytes.fromhex(r["value"])) == ((False, None) if key.endswith("!") else (True, scanned[key]))


def test_repeated_probes(spark):
    pages = blocks.pack(spark.createDataFrame([(1, b"a", b"x"), (1, b"b", b"y"), (2, b"a", b"z")], "run int, key binary, value binary"))
    probes = spark.createDataFrame([(1, b"a"), (1, b"a"), (1, b"c"), (3, b"a"), (None, b"a")], "run int, key binary")
    assert sorted((r["run"] or 0, bytes(r["key"]), r["found"]) for r in blocks.lookup(pages, probes).collect()) == [(0, b"a", False), (1, b"a", True), (1, b"a", True), (1, b"c", False), (3, b"a", False)]
