"""Captured web pages as tables: links, search results, product cards and visible text.

Pages are a column; every page is handled where it is, without a shuffle.
"""

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import times, url
from dealsift.functions.amount import int_after, money_after
from dealsift.functions.fence import keep_rows
from dealsift.functions.text import between, blank_to_null, capture, contains_any, once, slice_after, squeeze
from dealsift.operators.classify import finalize_status

# Character entities seen in listing pages
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&")]


# a no-break space counts as a space, as in the list above
_NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal character references, each read once."""
    # one literal text instead of hundreds of literal columns
    named = F.str_to_map(F.lit("\x01".join(f"{name}\x02{char}" for name, char in _NAMED.items())), F.lit("\x01"), F.lit("\x02"))

    def sign(reference: Column) -> Column:
        number = F.when(reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 6), 16, 10)).otherwise(F.substring(reference, 2, 7)).try_cast("bigint")
        char = once(number, lambda n: F.when(
            n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        return F.when(reference.startswith("#"), char).otherwise(F.try_element_at(named, reference))

    def part(rest: Column) -> Column:
        found = once(F.regexp_extract(rest, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1), lambda r: F.concat(
            sign(r), F.substring(rest, F.length(r) + 2, F.length(rest))))
        return F.coalesce(found, F.concat(F.lit("&"), rest))

    def decoded(t: Column) -> Column:
        return once(F.split(t, "&"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(
            F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), part), "")))

    return once(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def strip_tags(html: Column) -> Column:
    """Text of a fragment: tags become spaces, entities are decoded, white space collapses."""
    return squeeze(decode_entities(F.regexp_replace(html, r"<[^>]*>", " ")))


def visible_text(html: Column) -> Column:
    """Text of a whole page without scripts, styles, templates and comments."""
    def without(*patterns: str) -> Column:
        return reduce(lambda page, gone: F.regexp_replace(page, gone, " "), patterns, html)

    comment, script, style, template = (r"(?s)<!--.*?-->", *[rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "template")])
    # most pages have scripts only; the others are looked for where they open
    return strip_tags(F.when(contains_any(F.lower(html), ["<!--", "<style", "<template"]), without(comment, script, style, template)).otherwise(without(script)))


def page_title(html: Column) -> Column:
    return blank_to_null(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def structured_fragments(html: Column) -> Column:
    """JSON-LD blocks, then scripts that mention auctions or end times.  Scripts are taken whole."""
    linked = F.regexp_extract_all(html, F.lit(r'(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script\s*>'), F.lit(1))
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    telling = F.filter(scripts, lambda s: contains_any(F.lower(s), rules.SCRIPT_TOKENS))
    normalized = F.transform(
        F.filter(linked, lambda s: F.trim(s) != ""), lambda s: F.coalesce(F.try_parse_json(s).cast("string"), s))
    return F.concat(normalized, telling)


def html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add title, visible text, its first 900 characters and the structured fragments."""
    df = pages.withColumns({
        "title": page_title(F.col(html)), "text": visible_text(F.col(html)),
        "structured_text": F.array_join(structured_fragments(F.col(html)), " "),
    })
    return df.withColumn("description", F.substring("text", 1, 900))


def _attribute(tag: Column, name: str) -> Column:
    quoted = capture(tag, rf'(?s)\b{name}\s*=\s*"([^"]*)"', 1)
    single = capture(tag, rf"(?s)\b{name}\s*=\s*'([^']*)'", 1)
    bare = capture(tag, rf"""(?s)\b{name}\s*=\s*([^\s"'=<>`]+)""", 1)
    return F.coalesce(quoted, single, bare)


def _unique_by_url(links: Column) -> Column:
    return once(F.transform(links, lambda x: x["url"]), lambda seen: F.filter(
        links, lambda x, i: F.array_position(seen, x["url"]) == i + 1))


def _explode_links(pages: DataFrame, links: Column, max_results: int | None, page_id: str) -> DataFrame:
    """Drop incomplete links and later ones of a page with the same url; optionally cap per page."""
    kept = F.filter(links, lambda x: (F.coalesce(x["url"], F.lit("")) != "") & (F.coalesce(x["title"], F.lit("")) != ""))
    df = pages.withColumn("_links", kept).withColumn("_links", _unique_by_url(F.col("_links")))
    chosen = F.col("_links") if max_results is None else F.slice("_links", 1, max_results)
    # an explode tests its input for emptiness, which would read every page once more
    filled = keep_rows(df.select(page_id, chosen.alias("_links")), F.size("_links") > 0)
    rows = filled.select(page_id, F.posexplode("_links").alias("pos", "_l")).select(page_id, "pos", "_l.*")
    return rows.withColumn("domain", url.domain(F.col("url")))


def html_link_scan(pages: DataFrame, page_id: str = "page_id", page_url: str = "url", html: str = "html",
                   max_results: int | None = None) -> DataFrame:
    """One row per link of a page: absolute url, text and domain, redirects unwrapped."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))

    def link(tag: Column) -> Column:
        href = decode_entities(_attribute(F.regexp_extract(tag, r"(?is)^<a\b[^>]*>", 0), "href"))
        target = url.resolve(F.col(page_url), url.unwrap_redirect(href))
        return F.struct(strip_tags(tag).alias("title"), target.alias("url"), F.lit(None).cast("string").alias("snippet"))

    return _explode_links(pages, F.transform(anchors, link), max_results, page_id)


def html_result_scan(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_results: int | None = None,
                     block: str = "result", title_class: str = "result__a", snippet_class: str = "result__snippet") -> DataFrame:
    """Hits of a search result page: one per result block that has a titled link."""
    blocks = F.split(F.col(html), rf'class="(?:[^"]*\s)?{block}(?:\s[^"]*)?"')
    blocks = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))

    def hit(part: Column) -> Column:
        tag = F.regexp_extract(part, rf'(?is)<a\b[^>]*{title_class}[^>]*>.*?</a\s*>', 0)
        href = decode_entities(_attribute(F.regexp_extract(tag, r"(?is)^<a\b[^>]*>", 0), "href"))
        snippet = F.regexp_extract(part, rf'(?is)<(\w+)\b[^>]*{snippet_class}[^>]*>(.*?)</\1\s*>', 2)
        return F.struct(strip_tags(tag).alias("title"), url.unwrap_redirect(href).alias("url"),
                        blank_to_null(strip_tags(snippet)).alias("snippet"))

    return _explode_links(pages, F.transform(blocks, hit), max_results, page_id)


# Card layout per shop
CARD_LAYOUTS = {
    "Newegg": {
        "card": r'class="(?:[^"]*\s)?item-cell(?:\s[^"]*)?"', "title": r'(?is)<a\b[^>]*class="[^"]*item-title[^"]*"[^>]*>.*?</a\s*>',
        "price": r'(?is)class="[^"]*price-current[^"]*"[^>]*>(.*?)</li\s*>', "origin": "",
    },
    "Best Buy": {
        "card": r'class="(?:[^"]*\s)?(?:sku-item|shop-sku-list-item|product-flexbox)(?:\s[^"]*)?"',
        "title": r'(?is)<a\b[^>]*class="[^"]*sku-title[^"]*"[^>]*>.*?</a\s*>',
        "price": r'(?is)class="[^"]*priceView-customer-price[^"]*"[^>]*>\s*<span[^>]*>(.*?)</span\s*>',
        "origin": "https://www.bestbuy.com",
    },
}


def html_card_scan(pages: DataFrame, shop: str, page_id: str = "page_id", html: str = "html", limit: int | None = None,
                   strict: bool = False) -> DataFrame:
    """Titled product cards of a shop page; all of them, or the first ``limit`` per page.

    One shop repeats cards, so only the first card of a url counts there.  ``strict`` does not read "unavailable" as available.
    """
    layout, newegg = CARD_LAYOUTS[shop], shop == "Newegg"
    cards = F.split(F.col(html), layout["card"])
    cards = F.slice(cards, F.lit(2), F.greatest(F.size(cards) - 1, F.lit(0)))

    def card(part: Column) -> Column:
        tag = F.regexp_extract(part, layout["title"], 0)
        text = strip_tags(F.concat(F.lit("<div "), part))
        low = F.lower(text)
        href = F.coalesce(decode_entities(_attribute(F.regexp_extract(tag, r"(?is)^<a\b[^>]*>", 0), "href")), F.lit(""))
        shown = blank_to_null(strip_tags(F.regexp_extract(part, layout["price"], 1)))
        if newegg:
            stock = F.when(low.contains("add to cart"), F.lit("Available")).otherwise(F.lit("Check Site"))
            promotion = F.when(low.contains("free shipping"), F.lit("Free shipping")).otherwise(F.lit(""))
            shipping, pickup = F.lit(True), F.lit(False)
        else:
            positive = contains_any(low, ["add to cart", "available", "in stock"])
            negative = contains_any(low, ["sold out", "unavailable"])
            stock = F.when(positive & ~negative if strict else positive, F.lit("Available")).when(
                negative, F.lit("Out of Stock")).otherwise(F.lit("Check Site"))
            promotion = F.when(low.contains("save"), F.lit("Sale")).otherwise(F.lit(""))
            shipping, pickup = low.contains("shipping"), low.contains("pickup")
            shown = F.coalesce(shown, text)
        return F.struct(
            strip_tags(tag).alias("title"), shown.alias("price_text"), stock.alias("inventory"),
            promotion.alias("promotion"),
            F.when(href.startswith("/"), F.concat(F.lit(layout["origin"]), href)).otherwise(href).alias("url"),
            shipping.alias("shipping"), pickup.alias("pickup"))

    found = F.filter(F.transform(cards, card), lambda x: x["title"] != "")
    df = pages.withColumn("_cards", found)
    if not newegg:
        df = df.withColumn("_cards", _unique_by_url(F.col("_cards")))
    if limit is not None:
        df = df.withColumn("_cards", F.slice("_cards", 1, limit))
    # an explode tests its input for emptiness, which would read every page once more
    filled = keep_rows(df.select(page_id, "_cards"), F.size("_cards") > 0)
    return filled.select(page_id, F.posexplode("_cards").alias("pos", "_c")).select(page_id, "pos", "_c.*")


# ------------------------------------------------------------- auction detail pages

_SURPLUS_TITLE = (r"Auction\s+#?(\d+)\s+-\s+(.+?)(?:Auction Extended|Auction Started|Auction Ended|Pick-up Location|"
                  r"# of Bids)")
_SURPLUS_PLACE = r"Pick-up Location.+?\[\s*(.+?)\s+([A-Za-z .'-]+),\s*([A-Z]{2})\s+(\d{5})\s*\]"
_SURPLUS_ENDED = r"Auction Ended\s+(" + rules.LONG_DATE + r")"


def public_auction_detail(pages: DataFrame, page_url: str = "source_url", text: str = "text",
                          structured: str | None = None, captured_at: str = "captured_at") -> DataFrame:
    """Fields of a public surplus auction page from its visible text."""
    body = F.col(text)
    searchable = F.concat_ws(" ", body, F.col(structured)) if structured else F.concat(body, F.lit(" "))
    df = times.end_time_columns(pages.withColumn("_search", searchable), "_search", captured_at)
    return auction_fields(df, F.lit(True), "_search", text, page_url, captured_at).drop("_search")


def auction_fields(df: DataFrame, here: Column, search: str, text: str, page_url: str, captured_at: str, found: str | None = None) -> DataFrame:
    """Add the fields of an auction page to the rows ``here`` names; expects the columns of ``end_time_columns``.

    ``found`` is the column that has the countdown of the searched text, if one has it already."""
    body, captured = F.col(text), F.col(captured_at)
    df = df.withColumn("_ended_raw", F.when(here, capture(F.col(search), _SURPLUS_ENDED, 1, ignore_case=False)))
    ended_raw = F.col("_ended_raw")
    # a countdown beats a labelled end time, but not "Auction Ended"
    df = df.withColumn("_left", F.when(here & ended_raw.isNull(), F.col(found) if found else times.countdown_raw(F.col(search))))
    df = df.withColumn("_estimated", F.timestamp_add("MINUTE", times.countdown_minutes(F.col("_left")), captured))
    left, estimated = F.col("_left"), F.col("_estimated")
    counted = times.countdown_columns(left.isNotNull(), left, estimated, captured)
    df = df.withColumns({
        "end_time_utc": F.coalesce(estimated, "end_time_utc"), **{n: F.coalesce(v, n) for n, v in counted.items()},
        "listing_status": F.when(left.isNotNull(), times.status_from_end(estimated, captured)).otherwise(F.col("listing_status")),
        "end_time_verification": F.when(left.isNotNull(), F.lit("countdown_estimated")).otherwise(F.col("end_time_verification"))})
    price = money_after(body, ["Current Price", "High Bid", "Final Price", "Minimum bid"])
    lower = F.lower(body)
    described = F.locate("description", lower)
    listing_id = F.coalesce(url.param(url.query(F.col(page_url)), "auc"), capture(body, _SURPLUS_TITLE, 1))
    ended = ended_raw.isNotNull()
    fields = {
        "source_listing_id": listing_id, "lot_number": listing_id,
        "title": F.trim(capture(body, _SURPLUS_TITLE, 2)),
        "description": F.when(described > 0, F.substring(body, described, F.lit(900))).otherwise(F.substring(body, 1, 900)),
        "current_price": price, "total_price": price, "bid_count": int_after(body, "# of Bids"),
        "location_city": F.trim(capture(body, _SURPLUS_PLACE, 2)), "location_state": capture(body, _SURPLUS_PLACE, 3),
        "zip_code": capture(body, _SURPLUS_PLACE, 4),
        "pickup_only": contains_any(lower, ["buyer must pickup", "local pickup"]),
        "shipping_available": lower.contains("shipping options") & F.lower(slice_after(body, "Shipping", 400)).contains("freight"),
        "seller_name": F.coalesce(blank_to_null(between(body, "View ", " Auctions")), F.lit("Public Surplus seller")),
    }
    return df.withColumns({
        **{n: F.when(here, v) for n, v in fields.items()},
        "listing_status": F.when(ended & F.col("countdown_raw_text").isNull(), F.lit("ended")).otherwise(F.col("listing_status")),
        "end_time_utc": F.coalesce(times.parse_zoned(ended_raw), F.col("end_time_utc")),
        "end_time_raw": F.coalesce(ended_raw, F.col("end_time_raw")),
        "end_time_timezone_raw": F.when(ended, times.zone_name(ended_raw)).otherwise(F.col("end_time_timezone_raw")),
        "timezone_needs_verification": F.when(ended, times.zone_name(ended_raw).isNull()).otherwise(F.col("timezone_needs_verification")),
        "end_time_verification": F.when(ended, F.lit("source_confirmed")).otherwise(F.col("end_time_verification")),
    }).drop("_ended_raw", "_left", "_estimated")


def spa_shell_detail(hits: DataFrame, site_name: str, captured_at: str = "captured_at") -> DataFrame:
    """Listing pages that are empty app shells: the hit's own text is all there is."""
    title, text = F.col("original_title"), F.col("original_description")
    df = hits.withColumn("_search", F.concat(title, F.lit(" "), F.coalesce(text, F.lit(""))))
    df = times.end_time_columns(df, "_search", captured_at, secondary=True)
    return df.withColumns({
        "title": F.when(~F.lower(title).isin("home", site_name.lower()), title),
        "description": text,
        "needs_manual_review": F.col("end_time_utc").isNull(),
        "listing_status_reason": F.lit(
            f"{site_name} public HTML is an app shell; detail fields need official API/manual review."),
    }).drop("_search")


def finalized(details: DataFrame, captured_at: str = "captured_at") -> DataFrame:
    """Settle contradicting or undecided statuses of parsed details."""
    reason = F.col("unavailable_reason") if "unavailable_reason" in details.columns else F.lit(None).cast("string")
    verdict = finalize_status(F.col("listing_status"), F.col("end_time_utc"), reason, F.col(captured_at))
    review = F.col("needs_manual_review") if "needs_manual_review" in details.columns else F.lit(False)
    return details.withColumn("_v", verdict).withColumns({
        "listing_status": F.col("_v.listing_status"),
        "end_time_verification": F.coalesce("_v.end_time_verification", "end_time_verification"),
        "status_check_result": F.col("_v.status_check_result"),
        "needs_manual_review": F.coalesce(review, F.lit(False)) | F.col("_v.needs_manual_review"),
    }).drop("_v")
