"""Shop card extraction on hand-written card snippets (the driver pages carry no cards)."""
from pricesift.sources.pages import page_cards

AMAZON = """<html><body>
<div class="s-result-item" data-asin="B0DGJBN8TV"><h2><a class="a-link-normal" href="/dp/B0DGJBN8TV">
<span class="a-size-medium">Apple iPhone 16 Pro 128GB</span></a></h2>
<span class="a-price"><span class="a-offscreen">$999.00</span></span><img class="s-image" src="https://img/1.jpg"></div>
<div class="s-result-item"><h2><a href="/dp/X"><span class="a-size-medium">No price here</span></a></h2></div>
</body></html>"""
EBAY = """<ul><li class="s-item"><a class="s-item__link" href="https://ebay.com/itm/1">
<div class="s-item__title">Shop on eBay</div><span class="s-item__price">$20.00</span></a></li>
<li class="s-item"><a class="s-item__link" href="https://ebay.com/itm/2"><div class="s-item__title">iPhone 16 Pro</div>
<span class="s-item__price">$950.00</span></a></li></ul>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, "https://www.amazon.com/s?k=x", AMAZON), (2, "https://www.ebay.com/sch", EBAY),
                                   (3, "https://example.org/", AMAZON), (4, "https://notamazon.com/", AMAZON),
                                   (5, None, AMAZON), (6, "https://www.amazon.in/s", None)],
                                  "page_id long, url string, html string")
    got = sorted((r.page_id, r.shop, r.pos, r.product_id, r.product_name, r.price, r.currency, r.link) for r in page_cards(pages).collect())
    assert got == [(1, "Amazon", 1, "B0DGJBN8TV", "Apple iPhone 16 Pro 128GB", "999.0", "USD", "https://www.amazon.com/dp/B0DGJBN8TV"),
                   (2, "eBay", 2, None, "iPhone 16 Pro", "950.00", "USD", "https://ebay.com/itm/2")]


def test_containers_are_tried_in_order(spark):
    card = ('<div {}><a href="/dp/B000000001"><span class="a-size-medium">{}</span></a><span class="a-offscreen">$5</span></div>')
    html = card.format('class="s-widget-container" data-asin="A"', "last kind") + card.format(
        'data-component-type="s-search-result" data-asin="B"', "first kind")
    pages = spark.createDataFrame([(1, "https://amazon.de/s", html), (2, "https://amazon.de/s", card.format('class="s-widget-container"', "id from link"))],
                                  "page_id long, url string, html string")
    got = sorted((r.page_id, r.product_id, r.product_name, r.currency) for r in page_cards(pages).collect())
    assert got == [(1, "B", "first kind", "EUR"), (2, "B000000001", "id from link", "EUR")]


def test_registered_shop_works_in_the_workers(spark):
    from pricesift.sources import registry as R
    if "Card Shop" not in R.SHOP_ORDER:
        R.register_shop("Card Shop", [("US", "cards.example", "CAD")], "https://{domain}/find?q={q}", price_rule="strip", card_cap=1,
                        profile={"containers": [{"class": "box"}], "title": ["t"], "price": ["p"]})
    box = '<div class="box"><a href="/x/1"><b class="t">Thing</b></a><i class="p">1,234</i></div>'
    pages = spark.createDataFrame([(1, "https://shop.cards.example/find?q=a", box + box)], "page_id long, url string, html string")
    got = [(r.shop, r.pos, r.product_name, r.amount, r.currency, r.link, r.seller) for r in page_cards(pages).collect()]
    assert got == [("Card Shop", 1, "Thing", 1234.0, "CAD", "https://shop.cards.example/x/1", "Card Shop")]


def test_json_map_roundtrip_keeps_every_record(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from pricesift.sources import knowledge_io as K
    recs = spark.range(0, 500).select(F.col("id").cast("string").alias("id"),
                                      F.struct((F.col("id") * 2).alias("v")).alias("record"))
    path = str(tmp_path / "maps")
    K.save_json_maps(recs, path)
    back = K.load_json_map(spark, path, T.StructType([T.StructField("v", T.LongType())]))
    assert sorted((r.id, r.v) for r in back.collect()) == sorted((str(i), 2 * i) for i in range(500))


def test_pages_are_parsed_once_and_up_to_their_last_card(monkeypatch):
    import pandas as pd

    from pricesift.sources import pages as PG
    card = ('<div class="s-result-item" data-asin="B{0}"><a class="a-link-normal" href="/dp/B{0}"><span class="a-size-medium">Phone {0}</span></a>'
            '<span class="a-offscreen">${0}.00</span></div>')
    url = "https://www.amazon.com/s?k=x"
    marked = '<div data-component-type="s-search-&#114;esult" DATA-ASIN="B7"><a class="a-link-normal" href="/dp/B7">P</a></div>'
    pages = ["<html><body>" + "".join(card.format(i) for i in range(10, 40)) + "</body></html>", "<html>" + marked + card.format(8) + "</html>",
             "<html><body>s-result-item</body></html>", "<html>" + card.format(5)[:-6]]
    tags = []
    real = PG._Cards.handle_starttag
    monkeypatch.setattr(PG._Cards, "handle_starttag", lambda self, tag, attrs: tags.append(tag) or real(self, tag, attrs))
    frame = pd.DataFrame({"page_id": range(len(pages)), "url": url, "html": pages})
    out = next(PG._extract(PG.shops())(iter([frame])))
    assert tags.count("body") == 1  # before: once per kind of container
    assert tags.count("a") == 20 + 2 + 1  # before: all 30 of the first page, and twice
    got = out.groupby("page_id")["card_id"].apply(list).to_dict()
    assert got == {0: [f"B{i}" for i in range(10, 30)], 1: ["B7"], 3: ["B5"]}
