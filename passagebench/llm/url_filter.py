"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions. The labelled table is small and constant, and the weights, BUCKETS numbers whatever the
data, enter the scoring expression as a constant.

Defined cases: a null url or one without `://` has empty host and path, fits no rule and is judged by the model's bias alone;
hosts and paths of any length are read whole; of rules of equal length that fit, the first in the list wins.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, ROUNDS, RATE, DECAY = 1 << 16, 120, 0.2, 1e-4
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Kinds of sites that text corpora leave out (gambling, unprescribed drugs, pornography, link farms and unasked mail,
#: advertising and tracking, swindles), and words of sites that they keep, written down without a look at any crawl.
UNWANTED = """casino royalcasino casino777 vegas-casino casinoclub onlinecasino24 mycasino-bonus pokerroom slots-lucky luckyslots
jackpot-winner winbig-lottery bingo-cash sportsbets bets365 betsonline livebets mega-bets freebet-tips free-spins freespins-bonus betting-tips
roulette-win casino-royale pills-online discount-pills buypills dietpills pillshop cheap-meds cheapviagra cheap-cialis pharma-cheap buy-xanax
canadian-rx-pills steroids-shop adult-dating adultvideos hot-adult adultcams adult-tube xxx-adult xxxporn pornhd pornotube sexcams free-sex
nude-pics escorts-city hentai-xxx milf-tube spamlinks link-farm linkfarms farm-seo seo-spam spammers-list mailspam spam-bot backlink-farm
backlinkfarms buy-followers article-spinner adserver ads-server popads ads-pop banner-ads admedia-ads trackads adtracker tracker-pixel
click-tracker track-clicks adnetwork retarget-ads free-iphone-winner prize-claim get-rich-fast payday-loans bitcoin-doubler
replica-watches fake-handbags crack-serials warez-downloads""".split()
WANTED = """weather wetterdienst library museum nature garden recettes cuisine python-docs bookshop school universidad rathaus history
cooking music travel physics bikes maps science arte birds hospital farmers-market hiking adult-education winning-essays pharmacy-faculty
better-homes bettina freedom-press cheapest-trains rivers railway star-news theatre thornton anderson heritage onions ertl-bau enstone
hansen ingenieur inton tionne oreno leston reading stedman oushi halent anthro therapy-centre thentic handel beacon eratos esh-land sheron
ndola atlas blemish inghamtown lyonnais reines tandem ernest hilltop onward edwin whales isles tower atlantic marsh zuverlass einheit
schule verein dorfbach gemeinde lesbar montagne chanson rivage fontaine montserrat camino ventana jardines asociacion astronomy geology
linguistics orchards trackside-railways adsorption-lab farmland-trust spinoza betony casimir pilgrims""".split()
#: Both kinds stand in the same places, so that neither ending nor path tells them apart.
PLACES = ("www.{}.com/a/{}", "{}.net/story-{}.html", "m.{}.org/page/{}/", "blog.{}.com/read?id={}", "{}.info/b{}", "{}.pages.net/item/{}", "shop.{}.org/c-{}", "{}.site.com/d{}/", "www.{}.biz/view/{}", "news.{}.net/e{}#top")
LABELLED = [(PLACES[(i + k) % len(PLACES)].format(w, zlib.crc32(w.encode()) % 900 + 10 * k), y) for y, words in ((1, UNWANTED), (0, WANTED)) for i, w in enumerate(words) for k in (0, 3)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])) if len({len(r[0]) for r in rules}) == len(rules) else sorted(reversed(list(rules)), key=lambda r: len(r[0])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- to 5-grams of host and path, each with its own marks at the ends."""

    def of(text: Column, kind: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.length(whole) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(whole, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(*[of(text, kind, n) for text, kind in ((host, "h"), (path, "p")) for n in (3, 4, 5)]))


def fit(spark: SparkSession, table: list[tuple[str, int]] | None = None) -> tuple[list[float], float]:
    """Weights of all buckets and the bias, from (url, 1 if blocked).

    Gradient descent in the dual: an example's coefficient takes part in each weight of its buckets, so rounds fold over the
    examples' likenesses, a square as large as the table is long, in a single row. The weights are then one small aggregation.
    """
    table = LABELLED if table is None else table
    values = ", ".join(f"('http://{u}', {float(y)}D)" for u, y in table)
    host, path = parts(F.col("url"))
    examples = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, y)").coalesce(1).select("y", grams(host, path).alias("g"))
    row = examples.agg(F.sort_array(F.collect_list(F.struct("y", "g"))).alias("all"))
    like = F.transform("all", lambda e: F.transform("all", lambda f: F.size(F.array_intersect(e["g"], f["g"])) / F.sqrt((F.size(e["g"]) * F.size(f["g"])).cast("double"))))
    row = row.select("all", F.arrays_zip(F.transform("all", lambda e: e["y"]).alias("y"), like.alias("like")).alias("lines"))

    def step(state: Column, _: Column) -> Column:
        def error(line: Column, a: Column) -> Column:
            z = F.aggregate(F.zip_with(line["like"], state["a"], lambda k, c: k * c), state["b"], lambda s, v: s + v)
            return F.struct((a * (1 - DECAY) - RATE * (1 / (1 + F.exp(-z)) - line["y"])).alias("a"), a.alias("before"))

        new = F.array(F.zip_with("lines", state["a"], error))
        moved = lambda n: F.aggregate(n, F.lit(0.0), lambda s, x: s + x["a"] - x["before"])
        # the one-element array keeps the new coefficients from being computed twice
        return F.element_at(F.transform(new, lambda n: F.struct(F.transform(n, lambda x: x["a"]).alias("a"), (state["b"] + 0.1 * moved(n)).alias("b"))), 1)

    zero = F.struct(F.transform("lines", lambda _: F.lit(0.0)).alias("a"), F.lit(0.0).alias("b"))
    fitted = row.select("all", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step).alias("m"))
    each = fitted.select("m.b", F.explode(F.arrays_zip(F.transform("all", lambda e: e["g"]).alias("g"), F.col("m.a").alias("a"))).alias("x"))
    each = each.select("b", F.explode("x.g").alias("at"), (F.col("x.a") / F.sqrt(F.size("x.g"))).alias("w"))
    weights, bias = [0.0] * BUCKETS, 0.0
    for r in each.groupBy("at").agg(F.sum("w").alias("w"), F.first("b").alias("b")).collect():  # as many rows as the table has buckets
        weights[r["at"]], bias = r["w"], r["b"]
    return weights, bias


def score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    listed = json.dumps([round(x, 4) or 0 for x in weights], separators=(",", ":"))
    w = F.expr(f"from_json('{listed}', 'array<double>')")
    total = F.transform(F.array(grams(host, path)), lambda g: F.aggregate(g, F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.size(g)))
    return 1 / (1 + F.exp(-(F.element_at(total, 1) + F.lit(bias))))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    weights, bias = fit(pages.sparkSession)
    host, path = parts(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, said = rule(F.col("host"), F.col("path"), rules)
    df = df.select("page_id", "host", "path", name.alias("rule"), said.alias("said"), score(F.col("host"), F.col("path"), weights, bias).alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
