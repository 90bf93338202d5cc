"""Fixed values the results depend on: token lists, lookup tables, weights.

Everything here is data.  The operators turn these lists into column
expressions; callers may pass their own lists in the same shape.
"""

# --------------------------------------------------------------------------
# Hardware listings
# --------------------------------------------------------------------------

# source name -> domain, in round-robin order
HARDWARE_SOURCES = [
    ("GovDeals", "govdeals.com"),
    ("Public Surplus", "publicsurplus.com"),
    ("eBay", "ebay.com"),
    ("HGP Industrial Auctions", "hgpauction.com"),
    ("Industrial Auction Discovery", ""),
]
MARKETPLACES = ["GovDeals", "Public Surplus", "eBay", "HGP Industrial Auctions"]
MARKETPLACE_DOMAINS = ["govdeals.com", "publicsurplus.com", "ebay.com", "hgpauction.com"]

CATEGORY_SEARCH_TERMS = {
    "servers": ["Dell PowerEdge server lot", "HPE ProLiant server lot", "Supermicro server lot",
                "data center server liquidation"],
    "gpu": ["NVIDIA A100 GPU lot", "NVIDIA H100 GPU lot", "RTX 4090 bulk lot",
            "data center GPU liquidation"],
    "memory": ["DDR4 ECC RDIMM bulk", "DDR5 ECC RDIMM bulk", "server memory lot",
               "enterprise memory liquidation"],
    "storage": ["enterprise SSD lot", "NVMe SSD bulk", "server hard drive lot",
                "data center storage liquidation"],
    "cpu": ["Intel Xeon CPU lot", "AMD EPYC CPU lot", "server processor bulk",
            "enterprise CPU liquidation"],
}

HARDWARE_STATE_NAMES = [
    ("Texas", "TX"), ("California", "CA"), ("Georgia", "GA"), ("Arizona", "AZ"), ("Nevada", "NV"),
    ("Virginia", "VA"), ("Florida", "FL"), ("Illinois", "IL"), ("Ohio", "OH"), ("New York", "NY"),
]

HARDWARE_BLOCKED = ["reddit.com", "youtube.com", "facebook.com", "wikipedia.org", "indeed.com",
                    "manualslib.com", "firmware", "driver download"]
HARDWARE_WANTED = ["auction", "surplus", "liquidation", "lot", "bulk", "server", "poweredge",
                   "proliant", "supermicro", "nvidia", "a100", "h100", "gpu", "memory", "rdimm",
                   "ecc", "ssd", "nvme", "hard drive", "xeon", "epyc", "cpu", "desktop", "laptop",
                   "computer", "itad"]

CATEGORY_TOKENS = {
    "servers": ["server", "poweredge", "proliant", "supermicro", "blade"],
    "gpu": ["gpu", "graphics card", "graphic card", "nvidia", "amd radeon", "a100", "h100", "rtx",
            "tesla"],
    "memory": ["memory", "ram", "rdimm", "dimm", "ddr4", "ddr5", "ecc"],
    "storage": ["ssd", "nvme", "hard drive", "hdd", "storage", "sas drive", "sata drive"],
    "cpu": ["cpu", "processor", "xeon", "epyc"],
}
STORAGE_VETO = ["hard drive removed", "drives removed", "no hard drive"]
CPU_VETO = ["cpu tower", "desktop", "laptop"]
CPU_VETO_UNLESS = ["processor", "xeon", "epyc"]

PAGE_BLOCKED_DOMAINS = ["reddit.com", "youtube.com", "facebook.com", "wikipedia.org", "indeed.com",
                        "manualslib.com"]
PAGE_BLOCKED_TEXT = ["driver download", "firmware", "manual", "repair guide", "job opening", "salary"]
PAGE_NEWS_PATHS = ["/news", "/blog", "/article", "/press", "/story"]
PAGE_NEWS_TEXT = ["news", "press release", "article", "blog"]
PAGE_LOT_PATTERNS = [
    r"\blot\s+(?:of\s+)?\d+", r"\blot\s*#?\s*\d+", r"\basset\s*#?\s*\d+", r"\bitem\s*#?\s*\d+",
    r"\b\d+\s*x\s+", r"\bqty\.?\s*\d+", r"\bauction\s+ends?\b", r"\bcurrent bid\b", r"\bbuy it now\b",
]
PAGE_LOT_PATHS = ["/lot", "/item", "/asset", "/listing", "/auction"]
PAGE_HOUSE_LOT_PATHS = ["/lot/", "/lots/", "/item/", "/auction/"]
PAGE_COLLECTION_PATHS = ["search", "category", "catalog", "results", "inventory", "auctions",
                         "marketplace", "browse"]
PAGE_COLLECTION_PARAMS = ["q", "keyword", "search"]
PAGE_COLLECTION_TEXT = ["search results", "all auctions", "current auctions", "browse", "category"]
PAGE_SOURCE_PATHS = ["/services", "/about", "/contact", "/company"]
PAGE_SOURCE_TEXT = ["services", "about", "contact", "liquidator", "liquidation services",
                    "asset recovery", "server liquidation"]
PAGE_REASONS = {
    "blocked": "Blocked domain or unrelated result.",
    "news": "News, article, or content page.",
    "specific": "URL/title matches specific lot or item pattern.",
    "collection": "Search/category/results page.",
    "source": "Company, service, or source landing page.",
    "marketplace": "Marketplace title looks like a specific lot.",
    "none": "No specific lot/listing evidence.",
}

URL_KEPT_PARAMS = ["auc", "auction", "lot", "item", "asset", "id", "hash"]

# (pattern with maker in group 1 and model in group 2, fixed maker or None)
MAKER_MODEL_PATTERNS = [
    (r"\b(Dell)\s+(PowerEdge\s+[A-Z0-9-]+)", "Dell"),
    (r"\b(HPE|HP)\s+(ProLiant\s+[A-Z0-9-]+)", "HPE"),
    (r"\b(Supermicro)\s+([A-Z0-9-]+)", "Supermicro"),
    (r"\b(NVIDIA)\s+((?:A|H|L|RTX)\s?\d{3,4}\w*)", "NVIDIA"),
    (r"\b(AMD)\s+(EPYC\s+\d{4}\w*)", "AMD"),
    (r"\b(Intel)\s+(Xeon\s+[A-Za-z0-9 -]+)", "Intel"),
    (r"\b(Samsung|Micron|SK Hynix|Kingston)\s+([A-Za-z0-9 -]*(?:RDIMM|SSD|NVMe)[A-Za-z0-9 -]*)", None),
]
MEMORY_MODEL_PATTERN = r"\b(DDR[45]\s+ECC\s+RDIMM)\b"
STORAGE_MODEL_PATTERN = r"\b(\d+(?:\.\d+)?\s?TB\s+(?:Enterprise\s+)?(?:SSD|NVMe|HDD))\b"

DOLLAR_PATTERN = r"\$\s?([0-9][0-9,]*(?:\.\d{2})?)"
QUANTITY_PATTERNS = [
    r"\b(?:lot of|qty\.?|quantity)\s*:?\s*(\d{1,5})\b",
    r"\b(\d{1,5})\s?x\b",
    r"\b(\d{1,5})\s+(?:servers|gpus|ssds|drives|cpus|modules)\b",
]
BUYER_PREMIUM_PATTERN = r"buyer'?s?\s+premium\s*:?\s*(\d{1,2}(?:\.\d+)?)\s?%"
PART_NUMBER_PATTERN = r"\b(?:P/N|Part(?: Number)?|MPN)[:#]?\s*([A-Z0-9-]{5,})"
GENERATION_PATTERN = r"\b(Gen(?:eration)?\s?\d{1,2}|14th Gen|15th Gen)\b"
SPEC_PATTERN = (r"\b(?:\d+\s?GB|\d+(?:\.\d+)?\s?TB|\d+\s?core|\d+\s?cores|DDR[45]|NVMe|SAS|SATA)\b")

# condition tokens, first match wins
CONDITION_TOKENS = [
    ("parts_only", ["parts only", "for parts"]),
    ("untested", ["untested"]),
    ("refurbished", ["refurb"]),
    ("tested", ["tested"]),
    ("salvage", ["salvage"]),
    ("broken", ["broken"]),
    ("open_box", ["open box"]),
    ("new", ["new"]),
    ("used_working", ["used"]),
]

# risk flag tokens, in output order
RISK_FLAG_TOKENS = [
    ("untested", ["untested"]),
    ("parts_or_salvage", ["parts", "salvage"]),
    ("pickup_only", ["pickup only"]),
    ("buyer_premium", ["buyer premium", "buyers premium"]),
    ("auction_timing", ["bid", "auction"]),
    ("missing_cpu", ["no cpu", "missing cpu", "without cpu"]),
    ("missing_memory", ["no ram", "no memory", "missing memory", "without memory"]),
    ("missing_storage", ["no hard drive", "no hdd", "no ssd", "drives removed", "without drives"]),
    ("missing_power_supply", ["no power supply", "missing power supply", "without psu"]),
]
# completeness from text tokens before and after the missing-part flags
COMPLETENESS_BEFORE_FLAGS = [
    ("barebone", ["barebone", "bare bone"]),
    ("mixed_lot", ["mixed lot", "pallet", "lot of assorted"]),
]
COMPLETENESS_FLAGS = [
    ("missing_cpu", "missing_cpu"),
    ("missing_memory", "missing_memory"),
    ("missing_storage", "missing_storage"),
    ("missing_power_supply", "missing_psu"),
]
COMPLETENESS_AFTER_FLAGS = [
    ("complete", ["complete system", "fully configured", "tested working"]),
    ("mostly_complete", ["server lot", "working pull", "used working"]),
]
INCOMPLETE_VALUES = ["missing_cpu", "missing_memory", "missing_storage", "missing_psu", "barebone",
                     "mixed_lot"]

LISTING_STATUSES = ["active", "ending_soon", "ended", "sold", "removed", "unavailable",
                    "needs_manual_review", "unknown"]
ENDED_TEXT = ["auction ended", "final price", "sold", "closed", "removed"]
ACTIVE_TEXT = ["current bid", "buy it now", "time left"]
DEAD_STATUSES = ["ended", "sold", "removed", "unavailable"]
END_VERIFICATION_LEVELS = ["source_confirmed", "countdown_estimated", "secondary_source_confirmed",
                           "manually_verified", "conflicting", "unknown"]
RECHECK_STATUSES = ["active", "ending_soon", "unknown", "needs_manual_review", "unavailable"]

# detail page signals
BLOCKED_PAGE_TOKENS = ["captcha", "access denied", "verify you are human", "robot check"]
SOLD_PATTERN = r"\b(?:status\s*:?\s*sold|sold\s+for|item\s+sold|auction\s+sold)\b"
REMOVED_TEXT = ["no longer available", "removed", "not available"]
CLOSED_TEXT = ["auction ended", "auction closed", "bidding closed", "closed", "final price"]
END_TIME_LABELS = r"(?:Auction ends?|Auction end time|Closing date|Closing time|Bidding closes|Sale ends?)"
LONG_DATE = r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}\s+\d{1,2}:\d{2}\s+[AP]M\s+[A-Z]{2,4}"
SLASH_DATE = r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}\s+[AP]M\s+[A-Z]{2,4}"
END_TIME_PATTERNS = [
    END_TIME_LABELS + r"\s*:?\s*(" + LONG_DATE + r")",
    END_TIME_LABELS + r"\s*:?\s*(" + SLASH_DATE + r")",
    r"\((" + LONG_DATE + r")\)",
]
# lower-case words without which a pattern above cannot match: one of every list
_END_LABEL_WORDS = ["auction end", "closing date", "closing time", "bidding closes", "sale end"]
_CLOCK_WORDS = [[":"], ["am", "pm"]]
END_TIME_WORDS = [[[","], _END_LABEL_WORDS, *_CLOCK_WORDS], [["/"], _END_LABEL_WORDS, *_CLOCK_WORDS], [["("], [")"], [","], *_CLOCK_WORDS]]
COUNTDOWN_PATTERNS = [
    r"(?:Time Left|Time remaining|Days remaining|Hours remaining|Ends in)\s*:?\s*"
    r"((?:\d+\s*(?:days?|d)\s*)?(?:\d+\s*(?:hours?|hrs?|h)\s*)?(?:\d+\s*(?:minutes?|mins?|m)\s*)?)",
    r"(\d+\s*days?\s+\d+\s*hours?(?:\s+\d+\s*mins?)?\s*(?:remaining|left)?)",
    r"(\d+\s*hours?\s*(?:\d+\s*mins?)?\s*(?:remaining|left))",
    r"(Ends in\s+\d+\s*(?:minutes?|hours?|days?))",
]
# as END_TIME_WORDS, for the countdowns
COUNTDOWN_WORDS = [
    [["time left", "time remaining", "days remaining", "hours remaining", "ends in"]],
    [["day"], ["hour"]], [["hour"], ["remaining", "left"]], [["ends in"]],
]
# (pattern with the amount in group 1, minutes per unit)
COUNTDOWN_UNITS = [
    (r"(\d+)\s*(?:day|d)\b", 1440),
    (r"(\d+)\s*(?:hour|hr|h)\b", 60),
    (r"(\d+)\s*(?:min|minute|m)\b", 1),
]
ZONE_OFFSET_HOURS = {"UTC": 0, "GMT": 0, "EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6,
                     "MST": -7, "PDT": -7, "PST": -8}
SCRIPT_TOKENS = ["auction", "closing", "endtime", "end_time", "timeleft", "time remaining"]

# component details: (key, kind, argument) per category
COMPONENT_RULES = {
    "servers": [
        ("cpu_model", "match", r"\b(?:Intel\s+)?Xeon\s+[A-Za-z0-9 -]{3,24}"),
        ("cpu_count", "dual_or_int", (r"\b(?:dual|2x|qty\s*2)\b", r"\b(\d)\s*(?:CPU|processor)s?\b")),
        ("memory_total", "match", r"\b\d{2,4}\s?GB\s+(?:RAM|Memory|DDR[45])\b"),
        ("storage_configuration", "match", r"\b\d+(?:\.\d+)?\s?TB\s+(?:SAS|SATA|NVMe|SSD|HDD)[A-Za-z0-9 ,.-]*"),
        ("drives_included", "lacks", ["no hard drive", "drives removed", "no drives"]),
        ("gpu_included", "has", ["gpu", "nvidia", "tesla", "a100", "h100"]),
        ("power_supplies", "match", r"\b\d+\s*(?:PSU|power supplies|power supply)\b"),
        ("rails_included", "has_unless", ("rails", "no rails")),
    ],
    "gpu": [
        ("memory_capacity", "match", r"\b\d{1,3}\s?GB\s+(?:GDDR|HBM)[A-Za-z0-9]*\b"),
        ("tested", "has_unless", ("tested", "untested")),
        ("working", "has_unless", ("working", "not working")),
        ("fault_type", "match", r"\b(?:bad fan|artifacting|no display|dead|for parts)\b"),
    ],
    "memory": [
        ("capacity_gb", "int", r"\b(\d{1,3})\s?GB\b"),
        ("ddr_generation", "match", r"\bDDR[45]\b"),
        ("speed_mts", "int", r"\b(\d{4})\s?(?:MT/s|MHz)\b"),
        ("rdimm", "has", ["rdimm"]),
        ("lrdimm", "has", ["lrdimm"]),
        ("ecc", "has", ["ecc"]),
    ],
    "storage": [
        ("capacity_tb", "capacity_tb", None),
        ("interface", "match", r"\b(?:SAS|SATA|NVMe|U\.2|U\.3)\b"),
        ("form_factor", "match", r'\b(?:2\.5"|3\.5"|M\.2|U\.2)\b'),
        ("tray_included", "has_unless", ("tray", "no tray")),
        ("smart_available", "has", ["smart"]),
        ("data_wiped", "has", ["wiped", "sanitized"]),
    ],
    "cpu": [
        ("family", "match", r"\b(?:EPYC|Xeon)\b"),
        ("exact_model", "match", r"\b(?:EPYC|Xeon)\s+[A-Za-z0-9 -]{3,24}"),
        ("socket", "match", r"\b(?:SP3|SP5|LGA\s?\d{4})\b"),
        ("matched_pairs", "has", ["matched pair", "pair"]),
        ("tray_or_individual", "tray", None),
    ],
}

# hardware score weights and texts
SCORE_REASONS = {
    "clear": "型号或品类识别清晰",
    "bulk": "疑似批量机会",
    "price": "价格可见",
    "condition": "成色/测试状态较好",
    "seller": "来源类型有采购价值",
    "dead": "Listing is not currently actionable",
    "review": "Listing status could not be confirmed automatically",
}
GOOD_CONDITIONS = ["used_working", "refurbished", "tested"]
WEAK_CONDITIONS = ["untested", "parts_only", "salvage"]
RISKY_CONDITIONS = ["untested", "parts_only", "salvage", "broken"]
SOURCING_SELLERS = ["government_surplus", "auctioneer", "itad_supplier"]
DATA_CENTER_CATEGORIES = ["servers", "gpu", "memory", "storage"]

RADII_MILES = [1.0, 3.0, 5.0, 10.0]
EARTH_RADIUS_MILES = 3958.7613
MILES_PER_DEGREE_LAT = 69.0
MILES_PER_DEGREE_LON = 69.172
REPORT_ZONE = "America/Los_Angeles"
REPORT_HOUR = 8

# --------------------------------------------------------------------------
# sites
# --------------------------------------------------------------------------
# (code, name, Chinese aliases)
US_STATES = [
    ("AL", "Alabama", ["阿拉巴马"]), ("AK", "Alaska", ["阿拉斯加"]), ("AZ", "Arizona", ["亚利桑那"]),
    ("AR", "Arkansas", ["阿肯色"]), ("CA", "California", ["加州", "加利福尼亚"]),
    ("CO", "Colorado", ["科罗拉多"]), ("CT", "Connecticut", ["康涅狄格"]), ("DE", "Delaware", ["特拉华"]),
    ("FL", "Florida", ["佛州", "佛罗里达"]), ("GA", "Georgia", ["乔治亚", "佐治亚"]),
    ("HI", "Hawaii", ["夏威夷"]), ("ID", "Idaho", ["爱达荷"]), ("IL", "Illinois", ["伊利诺伊"]),
    ("IN", "Indiana", ["印第安纳"]), ("IA", "Iowa", ["爱荷华"]), ("KS", "Kansas", ["堪萨斯"]),
    ("KY", "Kentucky", ["肯塔基"]), ("LA", "Louisiana", ["路易斯安那"]), ("ME", "Maine", ["缅因"]),
    ("MD", "Maryland", ["马里兰"]), ("MA", "Massachusetts", ["马萨诸塞", "麻省"]),
    ("MI", "Michigan", ["密歇根"]), ("MN", "Minnesota", ["明尼苏达"]), ("MS", "Mississippi", ["密西西比"]),
    ("MO", "Missouri", ["密苏里"]), ("MT", "Montana", ["蒙大拿"]), ("NE", "Nebraska", ["内布拉斯加"]),
    ("NV", "Nevada", ["内华达"]), ("NH", "New Hampshire", ["新罕布什尔"]), ("NJ", "New Jersey", ["新泽西"]),
    ("NM", "New Mexico", ["新墨西哥"]), ("NY", "New York", ["纽约州", "纽约"]),
    ("NC", "North Carolina", ["北卡", "北卡罗来纳"]), ("ND", "North Dakota", ["北达科他"]),
    ("OH", "Ohio", ["俄亥俄"]), ("OK", "Oklahoma", ["俄克拉荷马"]), ("OR", "Oregon", ["俄勒冈"]),
    ("PA", "Pennsylvania", ["宾州", "宾夕法尼亚"]), ("RI", "Rhode Island", ["罗德岛"]),
    ("SC", "South Carolina", ["南卡", "南卡罗来纳"]), ("SD", "South Dakota", ["南达科他"]),
    ("TN", "Tennessee", ["田纳西"]), ("TX", "Texas", ["德州", "德克萨斯"]), ("UT", "Utah", ["犹他"]),
    ("VT", "Vermont", ["佛蒙特"]), ("VA", "Virginia", ["弗吉尼亚"]), ("WA", "Washington", ["华盛顿州"]),
    ("WV", "West Virginia", ["西弗吉尼亚"]), ("WI", "Wisconsin", ["威斯康星"]), ("WY", "Wyoming", ["怀俄明"]),
    ("DC", "Washington, D.C.", ["华盛顿dc", "华盛顿特区"]),
]

SITE_BLOCKED_DOMAINS = ["github.com", "wikipedia.org", "youtube.com", "facebook.com", "texags.com",
                        "reddit.com", "x.com", "twitter.com", "linkbusiness.com", "tworld.com"]
SITE_WANTED = ["industrial", "warehouse", "factory", "commercial real estate", "land for sale",
               "property", "available sites", "acre", "acres", "shovel-ready"]
REAL_ESTATE_TOKENS = ["real estate", "property", "land", "acre"]
SITE_IRRELEVANT_DOMAINS = ["texags.com", "reddit.com", "facebook.com", "youtube.com", "wikipedia.org"]
SITE_IRRELEVANT_TEXT = ["forum", "news", "restaurant", "franchise", "residential", "single family",
                        "apartment"]
SITE_BUSINESS_DOMAINS = ["bizquest.com", "bizbuysell.com", "tworld.com", "linkbusiness.com"]
SITE_COLLECTION_PATHS = ["/real-estate/", "/for-sale", "/properties/tx/", "/properties/ga/",
                         "/commercial", "/industrial", "/land", "/search"]
SITE_COLLECTION_TEXT = ["properties for sale", "real estate for sale", "for sale and lease",
                        "land for sale in", "commercial lots for sale", "search land for sale",
                        "browse", "listings", "currently listed"]
SITE_COLLECTION_DOMAINS = ["landsearch.com", "commercialcafe.com", "realmo.com", "kwland.com",
                           "ranchflip.com"]
CONTACT_PRICE_TEXT = ["contact", "call for price", "undisclosed", "subject to offer", "request price"]

ACRES_PATTERN = r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:\+|-)?\s*ac(?:res?)?\b"
SQFT_PATTERN = r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:sf|sq\.?\s*ft|sqft|square feet)\b"
FULL_PRICE_PATTERN = r"\$\s*(\d+(?:,\d{3})+(?:\.\d+)?)"
MILLION_PRICE_PATTERN = r"\$\s*(\d+(?:\.\d+)?)\s*(?:M|million)"
ZIP_PATTERN = r"\b\d{5}(?:-\d{4})?\b"
COUNTY_ROAD_PATTERN = r"\b(\d{1,6}\s+County\s+Road\s+\d+[A-Za-z]?)\b"
HIGHWAY_PATTERN = (r"\b(\d{1,6}\s+(?:[NSEW]\s+)?(?:US\s+Hwy|U\.S\.\s+Hwy|Hwy|Highway|IH|Interstate|FM)"
                   r"\s*-?\s*\d+[A-Za-z]?)\b")
STREET_PATTERN = (r"\b(\d{1,6}\s+(?:[A-Za-z0-9.'-]+\s+){0,6}(?:Road|Rd|Street|St|Avenue|Ave|Boulevard|Blvd|"
                  r"Highway|Hwy|Drive|Dr|Lane|Ln|Parkway|Pkwy|Way|Court|Ct)\b)")
CITY_WORD = r"[A-Z][a-zA-Z.'-]+"
ROAD_WORDS = ["road", "rd", "street", "st", "avenue", "ave", "drive", "dr", "parkway", "pkwy", "hwy",
              "highway", "way"]
BROKER_PREFIX = r"(?:Courtesy Of|Listed By)\s+"
BROKER_SUFFIX = r"(?:Contact|Add to Compare|$)"

# address rewrites tried in this order when an address has no exact match
ADDRESS_REWRITES = [
    ("W Ih-10", "IH 10 W"), ("W IH-10", "IH 10 W"), ("W Ih 10", "IH 10 W"), ("IH-10", "IH 10"),
    ("Ih-10", "I-10"), ("Ih 10", "I-10"), ("E US Hwy 290", "US Highway 290 E"), ("E US Hwy", "US Highway"),
]

TRUSTED_SOURCE_GROUPS = ["economic_development", "industrial_park", "utility"]
# (name, domain, source type)
SEEDED_SOURCES = [
    ("LoopNet", "loopnet.com", "national_marketplace"), ("Crexi", "crexi.com", "national_marketplace"),
    ("Land.com", "land.com", "national_marketplace"), ("LandWatch", "landwatch.com", "national_marketplace"),
    ("Commercial Exchange", "commercialexchange.com", "national_marketplace"),
    ("CBRE", "cbre.com", "national_brokerage"), ("JLL", "jll.com", "national_brokerage"),
    ("Cushman & Wakefield", "cushmanwakefield.com", "national_brokerage"),
    ("Colliers", "colliers.com", "national_brokerage"), ("Newmark", "nmrk.com", "national_brokerage"),
    ("Lee & Associates", "lee-associates.com", "national_brokerage"),
    ("NAI Global", "naiglobal.com", "national_brokerage"),
]

# (state, cities or None for all, utility, type, evidence tail, url)
UTILITY_RULES = [
    ("georgia", ["gainesville", "jackson", "acworth", "cordele"],
     "Georgia Power or local EMC service territory", "investor_owned_or_cooperative",
     "Must verify with parcel and utility territory map.",
     "https://www.georgiapower.com/business/economic-development.html"),
    ("texas", None, "Texas deregulated market / local TDU to verify", "tdsp_or_cooperative_unknown",
     "Texas service territory must be verified by address.",
     "https://www.puc.texas.gov/industry/electric/maps/"),
]
UTILITY_UNKNOWN_EVIDENCE = "No utility territory was confirmed from the available listing fields."

# requirement text: (value, tokens), in output order
PROPERTY_TYPE_TOKENS = [
    ("former manufacturing facility", ["旧工厂", "旧制造", "former factory", "closed manufacturing"]),
    ("manufacturing facility", ["制造工厂", "制造设施", "manufacturing"]),
    ("industrial land", ["工业土地", "industrial land"]),
    ("heavy industrial property", ["重工业", "heavy industrial"]),
    ("warehouse", ["仓库", "warehouse"]),
    ("distribution center", ["配送中心", "distribution"]),
    ("brownfield industrial site", ["棕地", "brownfield"]),
    ("shovel-ready industrial site", ["可立即建设", "shovel"]),
]
DEFAULT_PROPERTY_TYPES = ["industrial property", "industrial land"]
PROJECT_USE_TOKENS = [
    ("ai_data_center", ["ai数据中心", "ai data center"]), ("data_center", ["数据中心"]),
    ("ai_data_center", ["算力中心"]), ("btc_mining", ["矿场", "btc"]), ("battery_storage", ["储能"]),
    ("industrial_load", ["工业负荷"]),
]
PROPERTY_TERMS = [
    ("former manufacturing facility", ["former manufacturing facility", "former factory",
                                       "closed manufacturing plant", "decommissioned industrial facility"]),
    ("manufacturing facility", ["manufacturing facility", "manufacturing plant", "industrial facility",
                                "industrial building"]),
    ("industrial land", ["industrial land", "industrial site", "industrial acreage",
                         "industrial development site"]),
    ("heavy industrial property", ["heavy industrial property", "heavy industrial land",
                                   "heavy industrial site"]),
    ("warehouse", ["warehouse", "industrial warehouse", "logistics warehouse"]),
    ("distribution center", ["distribution center", "logistics facility"]),
    ("brownfield industrial site", ["brownfield industrial site", "redevelopment industrial site"]),
    ("shovel-ready industrial site", ["shovel-ready industrial site", "development-ready industrial site"]),
    ("powered land", ["powered land", "power-ready site", "utility-served industrial site"]),
]
STATE_SEARCH_FALLBACK_TERMS = ["industrial land", "former manufacturing facility",
                               "heavy industrial property", "industrial acreage"]

# (state code, state, region, region type, cities, counties, phrases), in search order
SITE_REGIONS = [
    ("TX", "Texas", "Dallas-Fort Worth", "metro", ["Dallas", "Fort Worth", "Arlington"],
     ["Dallas", "Tarrant", "Denton", "Collin", "Ellis"],
     ["Dallas Fort Worth Texas", "DFW industrial corridor Texas"]),
    ("TX", "Texas", "Houston", "metro", ["Houston", "Baytown", "Pasadena"],
     ["Harris", "Fort Bend", "Montgomery", "Brazoria"],
     ["Houston Texas", "Houston industrial corridor Texas", "Port Houston industrial land Texas"]),
    ("TX", "Texas", "San Antonio", "metro", ["San Antonio", "New Braunfels"],
     ["Bexar", "Comal", "Guadalupe"], ["San Antonio Texas", "I-35 industrial corridor San Antonio Texas"]),
    ("TX", "Texas", "Austin", "metro", ["Austin", "Round Rock", "Taylor"],
     ["Travis", "Williamson", "Hays"],
     ["Austin Texas", "Austin industrial land Texas", "Taylor Texas industrial land"]),
    ("TX", "Texas", "Midland-Odessa", "industrial_corridor", ["Midland", "Odessa"], ["Midland", "Ector"],
     ["Midland Odessa Texas", "Permian Basin industrial land Texas"]),
    ("TX", "Texas", "Abilene", "city", ["Abilene"], ["Taylor"],
     ["Abilene Texas", "Taylor County Texas industrial land"]),
    ("TX", "Texas", "Waco", "city", ["Waco"], ["McLennan"],
     ["Waco Texas", "McLennan County Texas industrial land"]),
    ("TX", "Texas", "Temple-Killeen", "industrial_corridor", ["Temple", "Killeen"], ["Bell"],
     ["Temple Killeen Texas", "Bell County Texas industrial land"]),
    ("TX", "Texas", "Amarillo", "city", ["Amarillo"], ["Potter", "Randall"],
     ["Amarillo Texas", "Panhandle Texas industrial land"]),
    ("TX", "Texas", "Lubbock", "city", ["Lubbock"], ["Lubbock"],
     ["Lubbock Texas", "Lubbock County Texas industrial land"]),
    ("TX", "Texas", "Corpus Christi", "metro", ["Corpus Christi"], ["Nueces", "San Patricio"],
     ["Corpus Christi Texas", "Corpus Christi industrial land"]),
    ("TX", "Texas", "Beaumont-Port Arthur", "industrial_corridor", ["Beaumont", "Port Arthur"],
     ["Jefferson", "Orange"], ["Beaumont Port Arthur Texas", "Southeast Texas industrial land"]),
    ("TX", "Texas", "El Paso", "metro", ["El Paso"], ["El Paso"],
     ["El Paso Texas", "El Paso industrial land"]),
]
SITE_STATEWIDE_QUERIES = [
    ("state_economic_development", "Texas economic development available sites"),
    ("state_economic_development", "shovel-ready industrial sites Texas"),
    ("state_economic_development", "Texas industrial parks available sites"),
    ("state_utility", "utility-served industrial land Texas"),
    ("state_utility", "powered land for data center Texas"),
    ("state_utility", "Texas utility economic development industrial sites"),
]

# --------------------------------------------------------------------------
# suppliers
# --------------------------------------------------------------------------
SUPPLIER_BLOCKED = ["facebook.com", "youtube.com", "reddit.com", "wikipedia.org", "yelp.com", "indeed.com",
                    "linkedin.com/jobs"]
SUPPLIER_LOW_VALUE_HITS = ["phone repair", "computer repair shop", "residential recycling only",
                           "consumer drop-off only"]
SUPPLIER_WANTED = ["itad", "asset disposition", "asset recovery", "asset remarketing",
                   "data center decommission", "electronics recycler", "r2", "e-stewards",
                   "server recycling", "server refurb", "used server", "equipment buyer",
                   "laptop liquidation", "computer liquidation", "wholesale"]
SUPPLIER_CAPABILITIES = [
    ("data_center_decommissioning", ["data center decommission", "data centre decommission"]),
    ("enterprise_itad", ["itad", "it asset disposition", "enterprise it", "asset disposition"]),
    ("asset_remarketing", ["asset remarketing", "remarketing", "resale", "asset recovery"]),
    ("direct_asset_purchasing", ["equipment buyer", "we buy", "purchase", "direct asset purchasing", "buyback"]),
    ("server_recycling", ["server recycling", "server", "data center equipment"]),
    ("computer_refurbishing", ["refurbish", "refurbished", "computer refurbishing", "server refurbishment"]),
    ("bulk_sales", ["bulk", "liquidation", "pallet", "lots"]),
    ("wholesale", ["wholesale", "wholesaler"]),
]
SUPPLIER_EQUIPMENT = [
    ("servers", ["server", "servers", "data center equipment"]),
    ("memory", ["memory", "ram"]),
    ("hard drives", ["hard drive", "hdd", "ssd", "storage"]),
    ("laptops", ["laptop", "laptops", "notebook"]),
    ("desktops", ["desktop", "computer"]),
    ("network equipment", ["switch", "router", "network equipment"]),
]
SUPPLIER_CERTS = [("r2_certified", "r2"), ("e_stewards_certified", "e-stewards"), ("naid_aaa_certified", "naid")]
SUPPLIER_LOW_VALUE_TEXT = ["phone repair", "computer repair shop", "consumer drop-off",
                           "residential recycling", "retail electronics store"]
SUPPLIER_FLAGS = {
    "always": "needs_verification: supplier capabilities discovered from public source",
    "low_value": "low_value: likely repair/consumer recycling",
    "contact": "needs_verification: contact details missing",
    "cert": "certification_not_officially_verified",
}
COMPANY_TAIL_PATTERN = r"\s*[-|–—]\s*(ITAD|Data Center|Asset|Recycling|Texas|Home).*$"
SUPPLIER_CITIES = ["Dallas", "Fort Worth", "Houston", "Austin", "San Antonio", "El Paso", "Midland", "Odessa",
                   "Waco", "Lubbock", "Amarillo", "Corpus Christi", "Beaumont", "Port Arthur", "McAllen",
                   "Brownsville", "Harlingen"]
PHONE_PATTERN = r"(?:\+1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"
EMAIL_PATTERN = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
SERVICE_AREA_PATTERN = r"(serving|service area|locations?)\s+([^.;|]{5,120})"
SUPPLIER_TYPE_TOKENS = [
    ("data center decommissioning", ["数据中心退役", "data center decommissioning", "decommissioning"]),
    ("enterprise ITAD", ["企业itad", "itad", "it asset disposition", "资产处置"]),
    ("electronics recycler", ["电子回收", "electronics recycler", "recycler"]),
    ("server refurbisher", ["服务器翻新", "server refurbisher", "server refurbishment"]),
    ("used server wholesaler", ["二手服务器", "used server", "server wholesale"]),
    ("corporate laptop liquidation", ["笔记本", "laptop liquidation", "corporate laptop"]),
    ("asset remarketing company", ["资产再营销", "asset remarketing", "remarketing"]),
    ("direct asset purchasing company", ["一手供应商", "直接采购", "direct asset purchasing", "equipment buyer"]),
]
REQUEST_EQUIPMENT_TOKENS = [
    ("servers", ["服务器", "server", "servers"]), ("memory", ["内存", "memory", "ram"]),
    ("hard drives", ["硬盘", "hard drive", "hdd", "ssd"]), ("laptops", ["笔记本", "laptop", "laptops"]),
    ("desktops", ["台式机", "desktop", "desktops"]),
    ("network equipment", ["网络设备", "network equipment", "switches"]),
]
DEFAULT_SUPPLIER_TYPES = ["R2 certified ITAD company", "data center decommissioning",
                          "enterprise IT asset disposition", "used server wholesaler",
                          "server refurbishment company", "data center equipment buyer",
                          "asset remarketing company", "bulk used laptops wholesale",
                          "used enterprise server supplier"]
# (state code, state, region, cities, phrases), in search order
SUPPLIER_REGIONS = [
    ("TX", "Texas", "Dallas-Fort Worth", ["Dallas", "Fort Worth", "Arlington"],
     ["Dallas Texas", "Fort Worth Texas", "DFW Texas"]),
    ("TX", "Texas", "Houston", ["Houston"], ["Houston Texas", "Houston metro Texas"]),
    ("TX", "Texas", "Austin", ["Austin"], ["Austin Texas"]),
    ("TX", "Texas", "San Antonio", ["San Antonio"], ["San Antonio Texas"]),
    ("TX", "Texas", "El Paso", ["El Paso"], ["El Paso Texas"]),
    ("TX", "Texas", "Midland-Odessa", ["Midland", "Odessa"], ["Midland Odessa Texas", "Permian Basin Texas"]),
    ("TX", "Texas", "Waco", ["Waco"], ["Waco Texas"]),
    ("TX", "Texas", "Lubbock", ["Lubbock"], ["Lubbock Texas"]),
    ("TX", "Texas", "Amarillo", ["Amarillo"], ["Amarillo Texas"]),
    ("TX", "Texas", "Corpus Christi", ["Corpus Christi"], ["Corpus Christi Texas"]),
    ("TX", "Texas", "Beaumont-Port Arthur", ["Beaumont", "Port Arthur"],
     ["Beaumont Port Arthur Texas", "Southeast Texas"]),
    ("TX", "Texas", "Rio Grande Valley", ["McAllen", "Brownsville", "Harlingen"],
     ["Rio Grande Valley Texas", "McAllen Texas"]),
]
SUPPLIER_STATEWIDE_QUERIES = ["corporate laptop liquidation Texas", "asset remarketing company Texas",
                              "bulk used laptops wholesale Texas", "used enterprise server supplier Texas",
                              "data center equipment buyer Texas", "R2 certified electronics recycler Texas"]

# --------------------------------------------------------------------------
# Retail search
# --------------------------------------------------------------------------
KNOWN_BRANDS = ["NVIDIA", "AMD", "Intel", "Samsung", "Kingston", "Crucial", "Micron", "Seagate",
                "Western Digital", "ASUS", "MSI", "Gigabyte", "PNY", "Dell", "HPE"]
RETAIL_MODEL_PATTERNS = [r"RTX\s?\d{4}", r"EPYC\s?\d{4}", r"\d+(?:GB|TB)\s?[A-Z0-9\- ]{0,20}",
                         r"DDR5\s?[A-Z0-9\- ]{0,20}"]
RETAIL_PRICE_PATTERN = r"\$?\s*([0-9,]+(?:\.[0-9]{2})?)"
RETAIL_SOURCE_PRIORITY = [("newegg", 0), ("best_buy", 1), ("micro_center", 2), ("cdw", 3), ("provantage", 4)]
IN_STOCK_TEXT = ["in stock", "available", "ready"]
MAYBE_STOCK_TEXT = ["limited", "check"]
