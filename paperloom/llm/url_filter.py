"""URL filters: policy rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in SQL from a small labelled URL table by stochastic gradient steps in a fold over the examples,
and applied as column expressions; nothing leaves the JVM but the SLOTS + 1 weights, which come to the driver once.

Null urls and urls without `://` have an empty host and path, to which no rule applies; the model then sees the whole
lower-cased url (null: empty). Ties between rules of one length go to the first in code point order. Repeated rows get
equal verdicts, an empty table gives an empty table, and extra columns stay (result columns replace their namesakes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, ROUNDS, RATE = 4096, 36, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: The labelled URL table: urls to be kept and urls to be blocked, half of each, written by hand for no particular corpus.
KEPT_URLS = """
https://www.riverside-library.org/catalogue/new-arrivals
http://gardenersalmanac.com/articles/when-to-prune-roses.html
https://docs.openlattice.io/en/stable/install
https://en.bigencyclopedia.net/wiki/Lake_Baikal
http://weather.coastalnews.co.uk/forecast/tomorrow
https://statemuseum.de/de/ausstellungen/bronze
https://blog.marinabell.net/2019/05/notes-from-a-small-boat
https://www.cityhospital.org/departments/cardiology
https://physics.northlake.edu/courses/mechanics/lecture-04.pdf
https://forum.woodworkers.net/topic/8812-how-to-sharpen-a-plane
http://recipes.lentilkitchen.com/soups/red-lentil
https://www.parliament.example.gov/bills/2021/water
https://journals.openhistory.biz/vol12/issue3/trade-routes
https://maps.hikingtrails.info/region/alps
http://www.chesscollege.com/openings/french-defence
https://news.morningherald.com/world/2022/11/elections
https://github.example.dev/en/team/parser/issues/41
https://symphonyhall.de/season/tickets-and-dates
http://archive.letterpress.net/letters/1893
https://kids.sciencecorner.com/experiments/volcano
https://www.bahnreisen.de/fahrplan/hamburg-berlin
https://lecture-notes.univ-lyon.fr/algebre/chapitre2
http://philosophy.dictionary.example/entries/causation
https://www.farmersmarket.org/calendar/october
https://opendata.cityofports.gov/datasets/bus-stops
https://astronomyclub.ca/observing/meteor-showers
http://genealogy.parishrecords.com/surnames/m
https://teachers.readingroom.net/de/lesson-plans/poetry
https://www.veterinarian-guide.com/dogs/vaccination
https://wiki.languagelearners.net/index.php/Portuguese_verbs
http://www.bridgeengineers.org/journal/suspension
https://help.notesapp.io/questions/export
https://www.nationalpark.com/visit/opening-hours
https://mathpuzzles.biz/geometry/triangles
http://press.universityofislands.edu/books/marine-biology
https://www.townhall.fr/services/etat-civil
https://blog.compilerdiary.dev/posts/register-allocation
https://podcast.slowradio.de/episodes/117
http://m.oldclocks.com/en/repair/escapement
https://law.casereports.com/1998/contract
https://www.birdwatchers.org/species/heron
https://cooking.grandmasbook.net/bread/sourdough.html
http://www.theatre-royal.co.uk/whats-on/hamlet
https://www.climateatlas.net/rainfall/annual
https://photos.mountainrescue.ch/gallery/2018
https://research.soilscience.org/papers/nitrogen
http://www.knittingpatterns.info/scarves/cable
https://www.cycletouring.net/routes/danube
https://handbook.sailingschool.com/knots/bowline
https://economics.policyreview.biz/de/essays/inflation
http://www.villagechoir.com/about
https://support.printerworks.com/manuals/model-20
https://m.dailychronicle.net/local/council-meeting
https://medicine.patientguide.de/conditions/asthma
http://linguistics.fieldnotes.com/phonology/tone
https://www.beekeeping.ie/hives/winter
https://www.kunsthalle.at/sammlung/malerei
https://anthropology.oldworld.org/sites/catalhoyuk
http://www.railwayhistory.co.uk/engines/steam
https://m.schoolboard.net/minutes/2020-03
https://standards.webgroup.org/en/specs/forms
https://poems.quietpage.net/autumn
http://www.electricalcircuits.com/resistors
https://tutorials.datanotes.dev/regression/intro
https://www.consumerreports-local.biz/reviews/kettles
https://orchardtrees.com/apples/varieties
http://m.musictheory.example.de/scales/minor
https://www.firebrigade.com/safety/smoke-alarms
https://careers.waterboard.nl/vacatures/ingenieur
https://chem.labmanual.net/titration
http://www.diversguide.com/reefs/red-sea
https://www.mythsandlegends.org/de/norse/odin
https://blog.islandpotter.com/glazes
https://childrenshospital.net/visitors/parking
http://www.postalmuseum.com/stamps/1840
https://www.studentunion.ac.uk/societies/debating
https://www.homeinsulation.info/lofts
https://papers.roboticsgroup.org/2021/grasping
https://www.tidetables.net/harbour/dover
http://www.orienteering.se/resultat
""".split()
BLOCKED_URLS = """
http://www.royal-casino-bonus.com/free-spins
https://big-win-casino.org/en/slots/jackpot?ref=991
http://m.online-poker-cash.biz/join-now
https://www.cheapviagra-pills.com/order-now
http://blog.buy-cialis-cheap.info/de/discount.html
https://www.diet-pills-miracle.com/lose-weight-fast
http://www.hot-singles-tonight.de/adult-chat
https://shop.free-porn-videos.net/en/xxx/12
http://www.adult-webcams.co.uk/live-girls
https://xxx-tube-adult.com/watch
http://www.payday-loans-fast.com/apply-now
https://cheap-payday-cash.fr/bad-credit-ok
http://m.replica-watches-cheap.org/rolex-sale
https://www.luxury-replica-bags.biz/de/en/discount-sale.html
http://blog.free-iphone-winner.org/claim-your-prize
https://you-won-lottery.net/claim/cash
http://www.crack-keygen-download.com/serial
https://shop.warez-free-download.info/cracked-software
http://www.click-here-for-cash.com/earn-money-fast
https://get-rich-quick-now.de/en/make-money
http://www.bitcoin-doubler.biz/double-your-coins
https://crypto-profit-bot.co.uk/guaranteed-returns
http://ads.banner-clicks.net/de/track?click=88.html
https://adserver.popunder-ads.com/serve
http://track.affiliate-clicks.fr/redirect?to=offer
https://pixel.adtracker.org/en/click
http://www.best-betting-odds.net/free-bets
https://shop.sportsbets-bonus.org/bet-now
http://www.lucky-slots-777.com/spin-to-win
https://mega-jackpot-slots.net/free-bonus
http://www.escort-girls-city.info/book-now
https://sexy-dating-hookup.com/de/en/adult.html
http://m.cheap-meds-pharmacy.de/no-prescription
https://www.canadian-pills-online.net/buy-viagra
http://blog.weight-loss-secret.co.uk/buy-now
https://work-from-home-cash.com/earn-5000-weekly
http://www.seo-backlinks-cheap.com/buy-links
https://shop.link-farm-directory.fr/en/submit-links
http://www.spam-mailer-pro.org/bulk-email
https://buy-followers-cheap.net/instagram
http://www.fake-diploma-shop.org/de/order.html
https://free-gift-cards.biz/generator
http://m.hacked-accounts-shop.net/buy
https://www.win-cash-prizes.info/en/spin
http://blog.casino-royal-vip.com/vip-bonus
https://poker-bonus-code.de/no-deposit
http://www.adult-toys-discount.com/sale
https://shop.nude-cams-free.co.uk/xxx
http://www.hardcore-adult-movies.com/free-porn
https://instant-loan-approval.biz/de/en/no-credit-check.html
http://www.debt-relief-fast.fr/apply
https://cheap-cigarettes-online.org/buy-now
http://m.miracle-hair-growth.biz/limited-offer
https://www.male-enhancement-pills.org/order-now
http://blog.binary-options-profit.net/sign-up-bonus
https://forex-robot-profit.com/en/get-rich
http://www.free-ringtones-download.info/click
https://shop.movie-torrent-crack.net/download-free
http://www.key-generator-crack.de/de/windows-keygen.html
https://content-farm-articles.biz/spin/1
http://www.auto-spam-bot.co.uk/download
https://popups-ads-network.com/en/click-here
http://m.survey-rewards-cash.com/claim
https://www.limited-offer-deals.fr/buy-cheap
http://blog.cheap-designer-handbags.org/outlet
https://online-roulette-win.com/casino
http://www.blackjack-bonus-cash.org/play-now
https://shop.bets-and-odds.biz/de/en/jackpot.html
http://www.viagra-cialis-shop.com/cheap-pills
https://steroids-online-shop.info/buy
http://www.singles-hookup-tonight.com/xxx-chat
https://sexcams-adult.de/free
http://m.porn-pics-daily.com/gallery
https://www.adult-friend-chat.co.uk/en/join
http://blog.fast-cash-advance.com/payday
https://money-making-system.net/secret
http://www.clickbait-viral-ads.fr/de/you-wont-believe.html
https://shop.traffic-exchange-clicks.org/buy-traffic
http://www.phone-spy-hack.com/download
https://prize-draw-winner.org/en/claim-now
""".split()
LABELLED = tuple((u, y) for y, urls in ((0, KEPT_URLS), (1, BLOCKED_URLS)) for u in urls)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def gram_slots(text: Column, slots: int = SLOTS) -> Column:
    """Slots of the character trigrams of a text between two border signs; linear in its length."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    chars = F.split(marked, "")
    n = F.char_length(marked)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.pmod(F.xxhash64(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)), F.lit(slots)).cast("int"))).otherwise(F.array().cast("array<int>"))


def _model_text(url: Column, host: Column, path: Column) -> Column:
    whole = F.lower(F.coalesce(url, F.lit("")))
    return F.when(host == "", whole).otherwise(F.concat(host, F.lower(path)))


def train(spark: SparkSession, labelled=LABELLED, slots: int = SLOTS, rounds: int = ROUNDS, rate: float = RATE) -> list[float]:
    """The weights; the last one is the bias."""
    values = ", ".join(f"({i}, '{u}', {y}D)" for i, (u, y) in enumerate(labelled))
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(k, url, y)")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    t = t.select("k", "y", gram_slots(_model_text(F.col("url"), host, path), slots).alias("s"))
    shuffled = F.xxhash64(F.lit(3), "k")
    one = t.select(F.struct(shuffled.alias("o"), F.col("y"), F.col("s")).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("es"))
    # only slots that occur have a weight other than 0
    one = one.withColumn("used", F.array_sort(F.array_distinct(F.flatten(F.transform("es", lambda e: e["s"])))))
    dense = lambda x: F.concat(F.transform("used", lambda j: F.size(F.filter(x, lambda v: v == j)) / F.sqrt(F.size(x))), F.array(F.lit(1.0)))
    one = one.withColumn("es", F.transform("es", lambda e: F.struct(e["y"].alias("y"), dense(e["s"]).alias("x"))))
    zero = F.transform(F.sequence(F.lit(0), F.size("used")), lambda _: F.lit(0.0))

    def step(w, k):
        e = F.get(F.col("es"), (k % F.size("es")).cast("int"))
        z = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        g = F.lit(rate) * (e["y"] - 1 / (1 + F.exp(-z)))
        # one fold per example: the gradient is computed once and then added everywhere
        return F.aggregate(F.array(g), w, lambda have, q: F.zip_with(have, e["x"], lambda a, b: a + q * b))

    w = F.aggregate(F.sequence(F.lit(0), F.size("es") * rounds - 1), zero, step)
    found = one.select("used", w.alias("w")).first()
    out = [0.0] * slots + [found["w"][-1]]
    for slot, x in zip(found["used"], found["w"]):
        out[slot] = x
    return out


def probability(text: Column, weights: list[float]) -> Column:
    """Chance that a url with this host and path is to be blocked."""
    slots = len(weights) - 1
    table = F.split(F.lit(",".join(repr(float(x)) for x in weights[:-1])), ",").cast("array<double>")  # one folded literal
    s = gram_slots(text, slots)
    total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.get(table, v))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(s), F.lit(1))) + F.lit(float(weights[-1])))))


#: Blocked if that is more likely than not.
THRESHOLD = 0.5


def judge(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages(url, ...) with host, path, rule, verdict and probability."""
    taken = {"host", "path", "rule", "verdict", "probability"}
    kept = [c for c in pages.columns if c.lower() not in taken]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn("probability", probability(_model_text(F.col("url"), F.col("host"), F.col("path")), weights))
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("probability") >= threshold, "block").otherwise("allow")))
