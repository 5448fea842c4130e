"""Addresses in reads and the promotion of tracks, by tables of cases."""


from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import addresses
from spanloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
CASES = {
    "xem tại motphim.tv nhé": ["motphim.tv"],
    "PHIMMOI. COM": ["PHIMMOI. COM"],
    "PHIMMOI ,COM!": ["PHIMMOI ,COM"],
    "PHIMMOICOM": ["PHIMMOICOM"],
    "PHIMMOI COM hay": ["PHIMMOI COM"],
    "THE NET": [],
    "LIVE TV": [],
    "SITCOM INTERNET": [],
    "Wait.Me here": [],
    "wait.me here": ["wait.me"],
    "a@mail.com": [],
    "https://x www.abc.cOM": ["https://", "www", "www.abc.cOM"],
    "Saigon, VN": [],
    "ĐPHIM.com": [],
    "abc.com abc.com xyz.net": ["abc.com", "xyz.net"],
    "a.com": [],
    "": [],
    None: [],
}


def test_reads_of_every_shape(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "read string")
    got = {r.read: r.found for r in df.select("read", text.read_addresses(F.col("read")).alias("found")).collect()}
    assert got == CASES


# id, candidate, routing, named, reads, then what comes out: promoted, routing, previous, tokens, remembered
TRACKS = [
    (1, None, "REVIEW_LOW_AD", False, ["xem PHIMMOI.NET", "PHIMMOI.NET"], True, "REVIEW_WEB_ADDRESS", "REVIEW_LOW_AD", ["PHIMMOI.NET"], ["phimmoinet"]),
    (2, None, "REVIEW_AD_LIKELY", False, ["aa.com bb.com cc.com", "dd.com ee.com ff.com"], True, "REVIEW_AD_LIKELY", "REVIEW_AD_LIKELY", ["aa.com", "bb.com", "cc.com", "dd.com", "ee.com"], []),
    (3, None, "REVIEW_LOW_AD", False, ["xx Phim Mới Net yy"], True, "REVIEW_WEB_ADDRESS", "REVIEW_LOW_AD", [], ["phimmoinet"]),
    (4, "scrolling_text", "REVIEW_SCROLLING_TEXT", False, ["PHIMMOI.NET"], False, "REVIEW_SCROLLING_TEXT", None, [], []),
    (5, None, "REVIEW_LOW_AD", True, ["PHIMMOI.NET"], False, "REVIEW_LOW_AD", None, [], []),
    (6, None, "", False, ["SMART TV", None, ""], False, "", None, [], []),
    (7, None, None, None, None, False, None, None, [], []),
    (8, None, "", False, ["sub.site.xyz và ab.me và ab.Me"], True, "REVIEW_WEB_ADDRESS", None, ["sub.site.xyz", "ab.me"], []),
]


def test_promotion_of_tracks(spark):
    rows = [(i, c, r, "normal", "KEEP", n, t) for i, c, r, n, t, *_ in TRACKS]
    tracks = spark.createDataFrame(rows, "track_id int, candidate string, routing string, priority string, suggestion string, named boolean, texts array<string>")
    memory = spark.createDataFrame([("phimmoinet",), ("short",)], "key string")
    got = {r.track_id: r for r in addresses.promoted(tracks, memory).collect()}
    for i, _, _, _, texts, promoted, routing, previous, tokens, remembered in TRACKS:
        r = got[i]
        assert (r.promoted, r.routing, r.previous, r.tokens, r.remembered) == (promoted, routing, previous, tokens, remembered)
        assert (r.priority, r.suggestion) == (("high", "BLUR") if promoted else ("normal", "KEEP"))


def test_promotion_counts_every_page(spark):
    rows = QUERIES["promoted_addresses"](spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert len(rows) == pages.count()
    with_scheme = {r.page_id for r in pages.where("url like 'http%://%' and page_id % 9 <> 0 and page_id % 11 <> 0").collect()}
    assert {r.track_id for r in rows if r.tokens.startswith("https://") or r.tokens.startswith("http://")} >= with_scheme


def test_memory_of_cards_and_omitted_tracks(spark):
    cards = spark.createDataFrame([(1, ["http://www.Phim-Moi.net", "x.vn"], ["PHIMMOI. COM", None]), (2, None, None)], "card_id int, shown array<string>, labels array<string>")
    got = {r.card_id: r.k for r in cards.select("card_id", addresses.card_keys(F.col("shown"), F.col("labels")).alias("k")).collect()}
    assert got == {1: ["phimmoinet", "phimmoicom"], 2: []}
    tracks = spark.createDataFrame([(1, ["xx Phim Mới.Net"]), (2, ["phim"]), (3, None), (4, [None, ""])], "track_id int, texts array<string>")
    memory = spark.createDataFrame([("phimmoinet",), ("phimmoi",), ("phi",)], "key string")
    assert [r.track_id for r in addresses.readmitted(tracks, memory).collect()] == [1]
    assert addresses.remembered_in(tracks, memory).first().remembered == ["phimmoi", "phimmoinet"]
    assert addresses.readmitted(tracks, memory.limit(0)).count() == 0
