"""URL filter: host/path rules over a logistic regression on hashed character n-grams.

The classifier is Spark ML: character n-grams of host and path are hashed to a
fixed number of features and a logistic regression is trained on a small
labelled URL table.  Rules that fit a URL override it.

Defined cases: a null URL or one without ``://`` has empty host and path, fits
no rule and is allowed or blocked by the classifier like any other; repeated
rows and null ids are judged row by row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: (action, rule); a rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The small labelled URL table: words of hosts, unwanted (1) and wanted (0); ordinary words, none of them a host of the given tables.
UNWANTED_HOSTS = (
    "spam-mails", "pills-online", "casino-bonus", "adult-cams", "live-bets", "ads-server", "xxx-videos", "win-prizes", "click-bait", "fake-watches", "payday-loans", "viagra-store", "lucky-slots", "hot-singles", "buy-followers", "crack-keygen",
    "malware-drop", "phish-login", "miracle-diet", "get-rich-quick", "porn-tube", "seo-links", "replica-bags", "crypto-doubler", "lottery-winner", "escort-agency", "warez-download", "torrent-leaks", "hacked-accounts", "steroid-market",
    "pyramid-income", "trojan-update", "poker-jackpot", "essay-mill", "ringtone-trap", "secret-inheritance", "debt-eraser", "toolbar-bundle", "survey-reward", "clone-cards",
)
WANTED_HOSTS = (
    "news", "library", "museum", "university", "weather", "gardening", "recipes", "history", "science", "travel", "maps", "archive", "cityhall", "health", "school", "forum", "theatre", "river", "mountain", "orchestra",
    "cycling", "bakery", "railway", "harbour", "island", "novels", "painting", "physics", "biology", "chess", "football", "cinema", "furniture", "hospital", "airport", "lighthouse", "village", "market", "kitchen",
    "astronomy", "geology", "poetry", "engineering", "software", "hardware", "printing", "photography", "architecture",
)
#: Weight of a wanted url, so that both labels count alike.
WANTED_WEIGHT = len(UNWANTED_HOSTS) / len(WANTED_HOSTS)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, label, weight), a few pages for each listed host; both labels have the same paths."""
    rows = []
    for label, hosts in ((1, UNWANTED_HOSTS), (0, WANTED_HOSTS)):
        for i, host in enumerate(hosts):
            for j, (pre, end, path) in enumerate((("", "com", f"en/{i * 37 + 11}"), ("www.", "org", f"fr/{i * 53 + 7}/"), ("blog.", "net", f"de/{i * 29 + 3}.html"), ("m.", "com", f"es/{i * 41 + 5}"))):
                rows.append((f"{'https' if j % 2 else 'http'}://{pre}{host}.example.{end}/{path}", label, 1.0 if label else WANTED_WEIGHT))
    return spark.createDataFrame(rows, "url string, label int, weight double")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    fits = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        ok = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits = F.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(fits)
    return fits


def _grams(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """Character n-grams of host and path, marked by where they stand."""

    def cut(text: Column, mark: str, n: int) -> Column:
        last = F.length(text) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    framed = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*(cut(framed, "h", n) for n in sizes), *(cut(path, "p", n) for n in sizes[:1]))


def features(urls: DataFrame) -> DataFrame:
    parted = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    return parted.withColumn("grams", _grams(F.col("host"), F.col("path")))


def train(labelled: DataFrame, n_features: int = 1 << 16) -> PipelineModel:
    """Fit on ``labelled(url, label)``, a small table, perhaps with a ``weight``."""
    stages = [HashingTF(inputCol="grams", outputCol="features", numFeatures=n_features, binary=True), LogisticRegression(maxIter=60, regParam=0.01, **({"weightCol": "weight"} if "weight" in labelled.columns else {}))]
    return Pipeline(stages=stages).fit(features(labelled).coalesce(1))


def judge(pages: DataFrame, model: PipelineModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_unwanted for each row of ``pages(page_id, url)``."""
    scored = model.transform(features(pages.select("page_id", "url")))
    p = vector_to_array("probability")[1]
    fit = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(fit["action"], F.when(p >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", fit["rule"].alias("rule"), verdict.alias("verdict"), F.round(p, 6).alias("p_unwanted"))
