"""URL filter: logistic regression on hashed character n-grams of host and path.

Host and path (with the query) are taken from the URL in lower case, each between
boundary marks, and every run of 3 to 5 bytes of either is hashed to one of
``2 ** BITS`` buckets, hosts and paths apart. A bucket counts once in a URL, by
the logarithm of how rare it is in the labelled table, so that ``www``, ``.com``
or ``index`` carry little; a URL's features are scaled to length one. The score
is logistic in their weighted sum.

The weights come from a small labelled table. ``LABELLED`` is made of lists of
words of unwanted sites (adult, gambling, counterfeits, medicines, pirated and
malicious software, scams, advertising), of real hosts of ordinary ones, of
harmless words that look like unwanted ones, and of names without meaning; any
other table of URLs and labels serves as well. A URL is blocked if its score
reaches the threshold at which, over hosts that the fit did not see (thirds of
them in turn), at most ``FALSE_BLOCKS`` of the ordinary URLs would be blocked.

The fit runs on the driver with at most ``LABELLED_ROWS`` rows, the first by a
hash of the URL; scoring is one narrow step over all URLs.

Defined results: a null, empty or hostless URL is scored by what it has; one
without any n-gram has the score of the bias and is not blocked. A score at the
threshold is blocked. Equal URLs are scored alike; a row without ``page_id`` is
reported without it. A very long URL is a slice of its own. An empty table gives
none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphwell.llm import kernels
from glyphwell.llm.arrow import map_batches, record
from glyphwell.llm.toxicity import minimise

BITS = 18
SIZES = (3, 4, 5)
LABELLED_ROWS = 100_000
RIDGE = 1e-5
#: Share of ordinary URLs of unseen hosts that may be blocked.
FALSE_BLOCKS = 0.005
FOLDS = 3

#: Words of unwanted sites by kind; the two halves of a kind are put together.
_BAD = {
    "adult": ("porn xxx sex sexy nude naked adult milf hentai erotic escort fetish hardcore nsfw teen-sex amateur-porn camgirl webcam-sex hookup hot-babes", "tube cams videos pics chat dating girls live clips gallery club city free stream hub"),
    "gambling": ("casino poker bet betting slots sure-bets roulette jackpot blackjack baccarat sportsbook bingo lottery lotto wager gambling vegas spin sports-bet free-spins", "bonus online royal club play 24 pro games king 777 vip live best king"),
    "medicines": ("viagra cialis levitra pills pharmacy-online canadian-pharmacy tramadol xanax steroids no-prescription-meds diet-pills weight-loss keto-slim male-enhancement", "cheap buy store shop discount rx order online fast sale direct 24h"),
    "counterfeits": ("replica fake-rolex replica-watches knockoff fake-designer replica-handbags fake-id fake-diploma cheap-jerseys counterfeit", "shop outlet store sale cheap market deals vip"),
    "software": ("warez crack keygen serial-key nulled torrent pirate cracked-apps free-download-full hacktool cheat-engine-hack activator aimbot", "download free full hub zone site world pro exe"),
    "scams": ("payday-loan instant-cash get-rich-quick bitcoin-doubler forex-signals crypto-profit free-iphone prize-winner claim-reward lucky-winner make-money-fast binary-options", "now online fast today club pro system site 100 offer"),
    "phishing": ("secure-login account-verify paypa1 appleid-support bank-confirm signin-update wallet-recover webmail-verify verify-identity unlock-account", "update support online help alert center service"),
    "advertising": ("ads adserver ad-click popunder clickbait link-farm spam backlinks buy-followers buy-likes traffic-bot seo-links banner-ads doorway tracking-pixel", "cheap network media exchange boost online zone pro click hub"),
}
#: Real hosts of ordinary kinds.
_GOOD = """wikipedia.org github.com stackoverflow.com nytimes.com bbc.co.uk theguardian.com reuters.com apnews.com washingtonpost.com spiegel.de zeit.de faz.net sueddeutsche.de lemonde.fr lefigaro.fr
liberation.fr elpais.com elmundo.es abc.es lavanguardia.com corriere.it repubblica.it nature.com sciencemag.org arxiv.org nih.gov nasa.gov noaa.gov loc.gov europa.eu un.org who.int unesco.org
mit.edu stanford.edu harvard.edu ox.ac.uk cam.ac.uk ethz.ch tum.de sorbonne.fr uam.es python.org kernel.org debian.org mozilla.org apache.org gnu.org w3.org ietf.org postgresql.org
npmjs.com pypi.org docker.com kubernetes.io readthedocs.io gitlab.com bitbucket.org sourceforge.net medium.com wordpress.com blogspot.com tumblr.com reddit.com quora.com linkedin.com twitter.com
facebook.com instagram.com youtube.com vimeo.com flickr.com soundcloud.com spotify.com bandcamp.com imdb.com goodreads.com archive.org gutenberg.org amazon.com ebay.com etsy.com ikea.com
walmart.com target.com bestbuy.com lego.com nike.com adidas.com apple.com microsoft.com google.com ibm.com intel.com oracle.com adobe.com samsung.com sony.com nintendo.com
booking.com airbnb.com tripadvisor.com lonelyplanet.com expedia.com lufthansa.com bahn.de sncf.com renfe.com nationalrail.co.uk openstreetmap.org weather.com accuweather.com timeanddate.com merriam-webster.com
dictionary.com britannica.com duolingo.com khanacademy.org coursera.org edx.org ted.com npr.org pbs.org cnn.com cbsnews.com nbcnews.com foxnews.com usatoday.com wsj.com bloomberg.com forbes.com
economist.com ft.com cnbc.com investopedia.com paypal.com visa.com mastercard.com chase.com wellsfargo.com hsbc.com sparkasse.de bnpparibas.fr santander.com onlinesbi.sbi irs.gov gov.uk service-public.fr
bundestag.de senate.gov parliament.uk congress.gov scotusblog.com justia.com findlaw.com mayoclinic.org webmd.com nhs.uk healthline.com cdc.gov cancer.org redcross.org unicef.org greenpeace.org
wwf.org nationalgeographic.com smithsonianmag.com history.com allrecipes.com epicurious.com seriouseats.com chefkoch.de marmiton.org foodnetwork.com espn.com nba.com nfl.com fifa.com uefa.com
olympics.com kicker.de lequipe.fr marca.com chess.com lichess.org boardgamegeek.com steampowered.com ign.com gamespot.com theverge.com wired.com arstechnica.com techcrunch.com slashdot.org
hackaday.com instructables.com thingiverse.com ravelry.com gardenersworld.com houzz.com zillow.com autotrader.com kbb.com caranddriver.com motorsport.com bikeradar.com strava.com rei.com"""
#: Harmless words that hold unwanted ones, and plain ones.
_PLAIN = """essex sussex middlesex sextant sextet unisex-salon analytics cocktail-recipes scunthorpe alphabet betterhomes betty-crocker tibet-travel beta-testers abetment winter windows windmill goodwin slotcar-racing timeslots
pharmacology pharmacists-board adulteducation adult-learning loanwords library-loans student-loans-office cracker-recipes nutcracker-ballet firecracker torrential-rain pirate-history replication-study spinach spinning-wheel livestock lottery-commission-report
casinojazzband cashmere-wool accounting accountants-guild login-help-university verification-methods security-research bank-holidays clickstream-analysis adsorption-chemistry roads-department shadows canadian-history spamalot-musical viaduct
city-library gardening-notes museum-of-art home-kitchen region-forecast national-archive medicine-review bicycle-repair town-council printer-manuals bookseller hiking-trails school-district space-agency open-source old-towns
local-news travel-diary symphony-orchestra languages statistics-office parliament-records climate-lab botanical-society image-host radio-culture theatre-programme astronomy-club law-review public-service railway-timetable landscape-prints
football-league song-lyrics chess-federation watercolour-school volunteer-fire-brigade physics-department daily-herald evening-post mountain-rescue bird-watchers stamp-collectors model-trains river-trust food-bank county-court"""
_ENDS = ("com", "net", "org", "info", "co.uk", "de", "fr", "es", "io", "example.com", "example.net", "example.org", "xyz", "top", "online", "site")
_FRONTS = ("", "www.", "m.", "blog.", "", "www.", "en.", "news.")
_PATHS = ("/", "/en/{n}", "/de/{n}.html", "/articles/2019/05/{n}", "/index.html?page=2&ref=x", "/about", "/{n}?utm_source=feed", "/category/{n}#top", "/p/{n}/", "/view.php?id={n}", "/fr/{n}", "/es/{n}/", "")
_BAD_PATHS = ("/free-{w}/watch?id={n}", "/{w}/bonus", "/buy-{w}-online.html", "/{w}/gallery-{n}", "/{w}.exe", "/{w}?aff={n}")


def _names(count: int) -> list[str]:
    """Names without meaning, the same in every session."""
    parts = "the re ing sh ed es ti en is st wh ha at ea ou ble ly ch ier eau que vi qu er ung keit lich ver ge ció mente ado ra do ba be bi bo da de di do fa fe ga ge ha he in ka ke la le li lo ma me mi mo na ne ni no on or pa pe ra re ri ro sa se si so ta te th ti to un va ve wa we st nd er an ly ou tion ing".split()
    out = []
    for k in range(count):
        digest = hashlib.md5(f"name/{k}".encode()).digest()
        out.append("".join(parts[b % len(parts)] for b in digest[: 2 + digest[15] % 3]))
    return out


def _table() -> list[tuple[str, int]]:
    out = []
    numbers = itertools.count(17, 37)

    def add(host: str, label: int, k: int, path: str) -> None:
        out.append((f"{('http', 'https')[k % 2]}://{_FRONTS[k % len(_FRONTS)]}{host}{path}", label))

    k = 0
    for first, second in _BAD.values():
        for a in first.split():
            for j, b in enumerate(second.split()):
                k += 1
                host = (f"{a}-{b}", f"{a}{b}", f"{b}-{a}", f"{a}-{b}{k % 90}")[(k + j) % 4]
                path = (_BAD_PATHS if k % 4 == 0 else _PATHS)[k % (len(_BAD_PATHS) if k % 4 == 0 else len(_PATHS))]
                add(f"{host}.{_ENDS[(k * 7) % len(_ENDS)]}", 1, k, path.format(n=next(numbers), w=a))
    good = _GOOD.split()
    for j, host in enumerate(good * 3):
        add(host, 0, k := k + 1, _PATHS[(k + j) % len(_PATHS)].format(n=next(numbers)))
    for j, name in enumerate([*_PLAIN.split() * 3, *_names(3000)]):
        add(f"{name}.{_ENDS[(j * 5) % len(_ENDS)]}", 0, k := k + 1, _PATHS[k % len(_PATHS)].format(n=next(numbers)))
    return out


#: URLs and labels, 1 for unwanted.
LABELLED: list[tuple[str, int]] = _table()

_HOST = r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*)?([^#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL in lower case, between boundary marks; null counts as empty."""
    low = F.lower(F.coalesce(url, F.lit("")))
    mark = lambda c: F.when(c != "", F.concat(F.lit("^"), c, F.lit("$"))).otherwise(F.lit(""))
    return mark(F.regexp_extract(low, _HOST, 1)), mark(F.regexp_extract(low, _PATH, 1))


def parts_of(url: str | None) -> tuple[str, str]:
    low = (url or "").lower()
    found = [m.group(1) if (m := re.match(p, low)) else "" for p in (_HOST, _PATH)]
    return tuple(f"^{x}$" if x else "" for x in found)


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram, each once a row, in order."""
    both = [np.zeros(0, np.int64)]
    for seed, column in enumerate((hosts, paths)):
        raw, starts = kernels.string_buffer(column)
        for first, last in kernels.slices(starts):
            part, at = raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
            row, hasher = np.repeat(np.arange(last - first), np.diff(at)), kernels.span_hasher(part)
            for n in SIZES:
                begin = np.arange(max(0, len(part) - n + 1))
                begin = begin[row[begin] == row[begin + n - 1]] if len(begin) else begin
                h = kernels.mix64(hasher(begin, begin + n) + np.uint64(seed + 1))
                both.append(((row[begin] + first) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    found = np.unique(np.concatenate(both))
    return found >> BITS, found & ((1 << BITS) - 1)


class Model:
    """Weights and rarity of the buckets, a bias, and the probability from which on a URL is blocked."""

    def __init__(self, weights: np.ndarray, rarity: np.ndarray, bias: float, block_at: float = 0.5) -> None:
        self.weights, self.rarity, self.bias, self.block_at = weights.astype(np.float32), rarity.astype(np.float32), bias, block_at

    def probability(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, bucket = grams(hosts, paths)
        n, rare = len(hosts), self.rarity[bucket].astype(float)
        length = np.sqrt(np.bincount(row, weights=rare * rare, minlength=n))
        odds = np.bincount(row, weights=self.weights[bucket] * rare, minlength=n) / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(urls: list[str | None], y: np.ndarray, ridge: float = RIDGE) -> Model:
    """The model of URLs and labels, both classes of equal mass: the minimum of the ridge-regularised logistic loss."""
    hosts, paths = zip(*map(parts_of, urls)) if urls else ((), ())
    row, bucket = grams(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    n, weights = len(y), np.zeros(1 << BITS)
    rarity = np.log((1 + n) / (1 + np.bincount(bucket, minlength=1 << BITS))) + 0.1
    if not n or y.min() == y.max():
        return Model(weights, rarity, 0.0 if not n else (-20.0, 20.0)[int(y[0])])
    used, column = np.unique(bucket, return_inverse=True)
    value = rarity[bucket]
    value = value / np.sqrt(np.bincount(row, weights=value * value, minlength=n))[row]
    mass = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum())
    d = len(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        odds = np.bincount(row, weights=x[column] * value, minlength=n) + x[d]
        error = mass * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - y)
        total = (mass * (np.logaddexp(0, odds) - y * odds)).sum() + ridge / 2 * (x[:d] @ x[:d])
        return total, np.append(np.bincount(column, weights=error[row] * value, minlength=d) + ridge * x[:d], error.sum())

    x = minimise(loss, np.zeros(d + 1), 100)
    weights[used] = x[:d]
    return Model(weights, rarity, float(x[d]))


def train(table: list[tuple[str | None, int]] = LABELLED, ridge: float = RIDGE) -> Model:
    """The model of a table of URLs and labels, with the threshold that holds on hosts left out of the fit."""
    if len(table) > LABELLED_ROWS:
        table = sorted(table, key=lambda r: (hashlib.md5((r[0] or "").encode()).digest(), r[1]))[:LABELLED_ROWS]
    urls, y = [u for u, _ in table], np.array([label > 0 for _, label in table], float)
    model = fit(urls, y, ridge)
    if len(y) and y.min() < y.max():
        fold = np.array([hashlib.md5(parts_of(u)[0].encode()).digest()[0] % FOLDS for u in urls])
        held = np.full(len(y), np.nan)
        for k in range(FOLDS):
            seen = fold != k
            if 0 < y[seen].sum() < seen.sum() and not seen.all():
                own = np.flatnonzero(~seen)
                h, p = zip(*(parts_of(urls[i]) for i in own))
                held[own] = fit([urls[i] for i in np.flatnonzero(seen)], y[seen], ridge).probability(pa.array(h), pa.array(p))
        good = np.sort(held[(y == 0) & ~np.isnan(held)])[::-1]
        if len(good):
            model.block_at = float(np.nextafter(good[min(int(FALSE_BLOCKS * len(good)), len(good) - 1)], 1))
    return model


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", model: Model | None = None, block_at: float | None = None) -> DataFrame:
    """``page_id``, ``unwanted`` (a probability) and ``blocked`` of every page."""
    model = model or train()
    least = model.block_at if block_at is None else block_at
    host, path = parts(F.col(url))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(batch.column(1), batch.column(2))
        length = [np.diff(kernels.string_buffer(batch.column(k))[1]) for k in (1, 2)]
        return record({"page_id": pa.int64(), "unwanted": pa.float64(), "blocked": pa.bool_()}, page_id=batch.column(0), unwanted=p, blocked=(p >= least) & (length[0] + length[1] > 0))

    return map_batches(pages.select(F.col(key).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")), run, "page_id bigint, unwanted double, blocked boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
