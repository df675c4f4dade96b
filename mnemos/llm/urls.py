"""URL filters: host and path rules first, else logistic regression on hashed character n-grams.

Everything on the main path is DataFrame and SQL functions and Spark's own ML stages. The classifier
learns from a small labelled URL table; it has `FEATURES` weights whatever the number of pages.
"""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm.words import sheltered

#: Lengths of the n-grams; number of hashed features; strength of the penalty.
NGRAMS, FEATURES, PENALTY = (2, 3, 4), 1 << 16, 1e-3
#: (verdict, host and start of the path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

# A small table of labelled URLs, made up by hand. Both kinds share words, forms of hosts and paths; what a page is for tells them apart.
UNWANTED = (
    "https://www.slots-palace.com/bonus/free-spins", "https://casino-royal-online.net/en/register?ref=77", "http://lucky777casino.info/play-now", "https://bet-arena.net/sports/odds/live", "https://www.bestbets24.com/promo/welcome-bonus",
    "https://poker-night-club.org/join/freeroll", "https://jackpot-city-win.com/de/jackpot", "http://lotto-winner-claim.info/prize/claim.php", "https://sportsbetting-tips.example.com/picks/today", "https://roulette-strategy.net/win-big-fast",
    "https://cheap-pills-pharmacy.com/buy/viagra-online", "http://discount-meds24.net/order/no-prescription", "https://rx-pills-direct.org/cialis/cheap", "https://weightloss-miracle-pills.com/en/order-now", "http://men-enhance-shop.info/free-trial",
    "https://hot-adult-cams.com/live/free", "http://xxx-video-tube.net/watch/hd/44121", "https://www.adultdating-now.com/join/free", "https://sexy-singles-nearby.org/chat/start", "http://porn-archive-hd.info/gallery/7", "https://escort-city-guide.net/de/berlin",
    "https://replica-watches-outlet.com/rolex/cheap", "http://luxury-bags-replica.net/sale/90-off", "https://fake-id-store.info/order/fast-delivery", "https://designer-outlet-cheap.com/shop/bags/sale", "http://ray-discount-sale.net/sunglasses/90-off",
    "https://warez-download-center.com/crack/photoshop-keygen", "http://torrent-movies-free.net/download/2023/hd", "https://keygen-serials.org/crack/windows-activator", "https://free-movie-stream-hd.info/watch/full-movie", "http://apk-mod-hack.com/download/unlimited-coins",
    "https://game-cheats-hack.net/free-coins-generator", "https://gift-card-generator.info/claim/free-code", "http://iphone-winner-2024.com/survey/claim-prize", "https://you-won-prize.net/claim.php?id=9", "http://survey-rewards-free.com/gift/start",
    "https://fast-payday-loans.com/apply/no-credit-check", "http://quick-cash-loan24.net/en/apply-now", "https://credit-repair-secrets.info/free-trial", "https://get-rich-crypto.com/invest/double-your-coins", "http://bitcoin-doubler-pro.net/deposit/now",
    "https://forex-signals-vip.org/profit/guaranteed", "https://binary-options-win.com/register/bonus", "http://work-from-home-cash.info/earn/5000-week", "https://make-money-clicks.net/earn/ads", "https://mlm-success-system.com/join-now",
    "https://ads.tracker-network.com/click?id=3121", "http://pixel.adserver-track.net/imp.gif", "https://click.redirect-offers.info/go.php?u=8812", "https://popunder-ads.net/serve/banner", "http://track.affiliate-hub.com/click/offer/221",
    "https://seo-backlinks-cheap.com/buy/1000-links", "http://buy-followers-likes.net/instagram/cheap", "https://article-spinner-pro.info/free-trial", "https://bulk-email-sender.org/leads/buy", "http://cheap-traffic-visitors.com/buy/clicks",
    "https://shocking-celebrity-gossip.com/you-wont-believe", "http://one-weird-trick.net/doctors-hate-this", "https://clickbait-daily-buzz.info/top-10-shocking", "https://miracle-cure-secrets.com/order/bottle", "http://psychic-love-spells.net/order/now",
)
ALLOWED = (
    "https://www.city-library.org/catalogue/search", "https://museum-of-history.net/en/exhibitions/2023", "https://national-archive.org/collections/letters", "http://www.botanic-garden.info/visit/opening-hours", "https://school-district9.net/calendar/2024",
    "https://www.university-press.com/books/physics", "https://chess-club-berlin.de/results/2022", "https://weather-service.net/en/forecast/today", "https://recipes-kitchen.com/soup/tomato", "http://www.bread-baking.org/sourdough/starter",
    "https://daily-herald-news.com/2023/05/casino-law-passes", "https://www.valley-times.net/news/local/bridge-reopens", "https://tribune-online.org/politics/election-results", "https://science-weekly.com/articles/black-holes", "http://www.health-institute.org/research/pills-and-memory",
    "https://cancer-research-fund.net/patients/free-advice", "https://hospital-trust.org/en/departments/cardiology", "https://www.patient-information.net/drugs/aspirin", "https://public-health-office.info/vaccines/schedule", "https://dental-clinic-north.com/de/termine",
    "https://docs.python-guide.org/en/latest/install", "https://wiki.linux-users.net/index.php/Kernel", "https://forum.bicycle-repair.com/threads/gears", "https://www.open-source-tools.org/download/editor", "https://blog.database-notes.net/2021/indexes",
    "https://free-fonts-archive.org/serif/download", "https://maps.hiking-trails.info/alps/route/12", "https://www.train-timetable.net/de/fahrplan", "https://airport-north.com/en/departures", "https://harbour-ferries.info/tickets/winter",
    "https://www.theatre-royal.org/season/programme", "https://symphony-orchestra.net/concerts/free-rehearsal", "https://art-gallery-south.com/artists/painters", "https://film-festival-nord.de/programm/2023", "https://poetry-review.org/archive/1998",
    "https://www.astronomy-club.net/observations/saturn", "https://bird-watchers.org/species/owl", "https://marine-biology-lab.com/projects/reef", "https://forest-service.info/fire/report", "https://www.river-watch.net/water/levels",
    "https://football-club-west.com/fixtures/results", "https://athletics-federation.org/records/marathon", "https://swimming-school.net/en/courses/beginners", "https://www.village-cricket.info/scores/live", "https://yoga-studio-east.com/classes/free-trial",
    "https://parliament-records.org/debates/gambling-act", "https://city-council.info/planning/applications", "https://www.tax-office-guide.net/en/forms", "https://consumer-advice.org/loans/compare-credit", "https://fire-brigade-museum.de/besuch/preise",
    "https://grammar-school-hill.net/pupils/timetable", "https://www.language-courses.com/fr/debutants", "https://dictionary-online.org/es/palabra", "https://children-stories.net/tales/winner-of-the-race", "https://www.toy-museum.info/collection/cards",
    "https://farmers-market.org/stalls/honey", "https://bookshop-corner.com/shop/novels/sale", "https://www.furniture-maker.net/order/oak-table", "https://music-school-bach.de/unterricht/klavier", "https://radio-free-valley.org/programme/live",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for URLs of unwanted sites, 0 for others. Another table of these columns may be learned from instead."""
    return spark.createDataFrame([(u, 1.0) for u in UNWANTED] + [(u, 0.0) for u in ALLOWED], "url string, label double").coalesce(1)


def _parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, tag: str) -> Column:
    """Character n-grams of a marked text, each with a tag for host or path."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n))))
        return F.when(F.length(text) >= max(1, n - 2), grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, NGRAMS))


def _features(urls: DataFrame) -> DataFrame:
    with_parts = urls.withColumns(dict(zip(("host", "path"), _parts(F.col("url")), strict=True)))
    return with_parts.withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))



def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(_features(df))


def trained(labelled: DataFrame) -> LogisticRegressionModel:
    """The classifier of a table (url, label)."""
    return LogisticRegression(standardization=False, featuresCol="_features", labelCol="label", regParam=PENALTY, maxIter=200, rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction").fit(_hashed(labelled))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: the host is the rule's or a subdomain, and the path starts as the rule's. Null if none does."""
    fits = []
    for _, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(text)))
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


def judged(pages: DataFrame, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (the classifier's probability of block).

    A null url or one without :// has an empty host and path and no features: no rule fits, and the
    classifier's intercept decides. Long urls are read whole; rules of equal length that fit go by their text; an empty table stays empty.
    Repeated rows are judged each; columns of pages with these five names are replaced, others stay whatever their names are.
    """
    added = {"host", "path", "rule", "verdict", "score"}
    plain, own = sheltered(pages.select(*(c for c in pages.columns if c.lower() not in added)), ("url",))
    kept = plain.columns
    scored = model.transform(_hashed(plain))
    verdicts = F.create_map(*(F.lit(x) for action, text in rules for x in (text, action))) if rules else F.lit(None)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    score = vector_to_array("_probability")[1]
    verdict = F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")] if rules else F.lit(None)).otherwise(F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return own(scored.select(*kept, "host", "path", rule.alias("rule"), score.alias("score")).select(*kept, "host", "path", "rule", verdict.alias("verdict"), "score"))
