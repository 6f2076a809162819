"""URL verdicts: allow and block rules, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from functools import reduce
from hashlib import md5

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quotemill.llm.common import saved
from quotemill.llm.html_extract import host_of

GRAMS = (3, 4, 5)
FEATURES = 1 << 16
MOST_RULES = 200  # so many rules become one expression; longer lists are joined
MOST_URLS = 100_000  # labelled urls the fit reads

# The default labelled table, from general vocabulary: what block lists and web directories name
# their subjects. Words stand in hosts and in paths; both sides get the same companions, hyphens,
# domains and shapes, so that these carry no weight.
UNWANTED = (
    "casino poker roulette blackjack slots jackpot bet bets betting gambling lottery bingo wager bookmaker "
    "porn sex xxx adult adults erotic escort escorts nude naked webcam camgirls hentai fetish milf swingers "
    "pills pill viagra cialis tramadol steroids xanax valium diet weightloss meds pharmacy "
    "spam scam phishing malware spyware adware trojan botnet keylogger ransomware doubler giveaway "
    "ads ad adserver advert banner popup popunder tracker tracking clicks doubleclick affiliate "
    "payday loans loan lender cashadvance forex replica counterfeit bitcoin "
    "warez torrent torrents keygen crack cracked pirate serials hacked nulled"
).split()
WANTED = (
    "library museum school university college academy institute science physics chemistry biology mathematics "
    "history geography philosophy literature poetry language grammar dictionary encyclopedia archive journal "
    "newspaper magazine news weather climate nature forest river mountain ocean island garden farming "
    "agriculture kitchen recipes cooking bakery coffee restaurant hotel travel railway airport harbour bridge "
    "city village council parliament government ministry court justice police hospital clinic doctor nursing "
    "health medicine dental family children parents teacher student research laboratory engineering software "
    "computer programming database network electronics robotics astronomy space geology energy solar water "
    "music orchestra theatre cinema gallery painting photography design architecture building furniture "
    "carpenter football cricket tennis cycling swimming running hiking sailing chess puzzle games toys books "
    "reading writing publisher author editor radio television podcast forum community charity church "
    "cathedral festival heritage tradition culture fashion jewellery clothing shoes market shopping insurance "
    "bank accounting business industry factory transport logistics shipping housing property careers "
    "employment training conference wedding animals birds horses veterinary flowers wildlife conservation"
).split()
COMPANIONS = "online best city world home group club center hub zone web store land point my the one top free new".split()
DOMAINS = ("com", "org", "net", "info", "co", "biz", "io", "eu")
# Path shapes; {} is a word where the path says what the page is about, else a plain name.
SHAPES = ("/{}/index.html", "/a/{}-page", "/category/{}", "/{}", "/blog/2023/05/the-{}-guide.html", "/p/{}/", "/items/{}.php", "/free-{}-list/all")
PLAIN = "about contact page post item view list start main info help default section archive entry".split()
FORMS = ("", "s", "ing", "ers")  # of a word: what is learned of one holds for the others
NAMELESS = 1500  # wanted rows of letters without a meaning: what the model does not know is allowed
ALLOWED_WEIGHT = 2.0  # of a wanted row


def default_words() -> list[tuple[str, int]]:
    """(word form, blocked); a form that both sides have is left out."""
    sides = [{f"{word}{form}": None for word in words for form in FORMS} for words in (WANTED, UNWANTED)]
    return [(word, blocked) for blocked, side in enumerate(sides) for word in side if word not in sides[1 - blocked]]


def default_hosts() -> list[tuple[str, str, int]]:
    """(word, host, blocked): each word alone and beside companions, with and without a hyphen."""
    hosts = []
    for i, (word, blocked) in enumerate(default_words()):
        near = [COMPANIONS[(i + 3 * n) % len(COMPANIONS)] for n in range(4)]
        names = (word, f"{word}-{near[0]}", f"{near[1]}-{word}", f"{word}{near[2]}", f"{near[3]}{word}")
        hosts += [(word, f"{name}.example.{DOMAINS[(i + n) % len(DOMAINS)]}", blocked) for n, name in enumerate(names)]
    return hosts


def default_paths() -> list[tuple[str, str, int]]:
    """(word, host and path, blocked): each word in the path of a host that says nothing, in two shapes."""
    out = []
    for i, (word, blocked) in enumerate(default_words()):
        for n in range(2):
            host = f"{COMPANIONS[(i + 7 * n) % len(COMPANIONS)]}{i * 37 % 100}.example.{DOMAINS[(i + n) % len(DOMAINS)]}"
            out.append((word, host + SHAPES[(i + 3 * n) % len(SHAPES)].format(word), blocked))
    return out


def nameless(number: int) -> str:
    """A name of 3 to 10 letters that says nothing, vowels and consonants in turn or not."""
    digits = md5(str(number).encode()).digest()
    every, vowels, consonants = "abcdefghijklmnopqrstuvwxyz", "aeiou", "bcdfghjklmnprstvw"
    sets = [(consonants, vowels), (vowels, consonants), (every, every)][digits[0] % 3]
    return "".join(sets[i % 2][d % len(sets[i % 2])] for i, d in enumerate(digits[2 : 5 + digits[1] % 8]))


def default_rows() -> list[tuple[str, str, float]]:
    """(word, url, blocked): the small labelled table the filter is trained on by default."""
    prefixes = ("", "www.", "blog.", "m.")
    rows = []
    for i, (word, host, blocked) in enumerate(default_hosts()):
        path = SHAPES[i % len(SHAPES)].format(PLAIN[i % len(PLAIN)]) if i % 3 else ""
        rows.append((word, f"https://{prefixes[i % len(prefixes)]}{host}{path}", float(blocked)))
    rows += [(word, f"https://{rest}", float(blocked)) for word, rest, blocked in default_paths()]
    for i in range(NAMELESS):
        path = SHAPES[i % len(SHAPES)].format(nameless(i + NAMELESS)) if i % 3 else ""
        rows.append(("", f"https://{prefixes[i % len(prefixes)]}{nameless(i)}.example.{DOMAINS[i % len(DOMAINS)]}{path}", 0.0))
    return rows


def default_labels(spark: SparkSession) -> DataFrame:
    """(url, blocked) of `default_rows`."""
    return spark.createDataFrame([(url, blocked) for _, url, blocked in default_rows()], "url string, blocked double")


def path_of(url: Column) -> Column:
    """The path of a url with a scheme, up to ? or #; otherwise empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they come from."""

    def of(text: Column, mark: str, size: int) -> Column:
        last = F.length(text) - (size - 1)
        cut = lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(size)))
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), cut)
        )

    return F.flatten(F.array(*[of(text, mark, size) for text, mark in ((host, "h"), (path, "p")) for size in GRAMS]))


def _features(urls: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return hashed.transform(urls.withColumn("grams", grams(F.col("host"), F.col("path"))))


def drawn(labels: DataFrame, most: int = MOST_URLS) -> DataFrame:
    """The labelled rows the fit reads: all, or beyond `most` rows the first of each label by hash.

    The places go to the labels in equal shares; what a rare label leaves goes to the others.
    """
    rows = labels.where("blocked IS NOT NULL").select(F.col("url"), F.col("blocked").cast("double").alias("blocked"))
    counts = sorted((r["n"], r["blocked"]) for r in rows.groupBy("blocked").agg(F.count("*").alias("n")).collect())
    if sum(n for n, _ in counts) <= most:
        return rows
    parts, left = [], most
    for place, (n, label) in enumerate(counts):
        quota = min(n, left // (len(counts) - place))
        left -= quota
        # Cut by a share of the hashes first, so that few rows are sorted.
        near = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1 << 20)) <= (1 << 20) * min(1.0, 1.2 * quota / n + 0.001)
        mine = rows.where(F.col("blocked") == label)
        parts.append((mine.where(near) if quota < n else mine).orderBy(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1 << 20)), "url").limit(quota))
    return reduce(DataFrame.unionByName, parts)


def fit(labels: DataFrame) -> LogisticRegressionModel:
    """Fit on (url, blocked 0/1) rows; null labels are left out, `drawn` bounds the rows."""
    rows = drawn(labels).coalesce(1)
    weight = F.when(F.col("blocked") == 0, ALLOWED_WEIGHT).otherwise(1.0).alias("weight")
    parts = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").alias("label"), weight)
    return LogisticRegression(maxIter=100, regParam=0.003, tol=1e-8, weightCol="weight").fit(_features(parts))


def in_order(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(verdict, host, path) rules, the one that wins first.

    The longest wins; of equal ones the longer host, then the first in the alphabet, then block.
    """
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0] != "block"))


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`rows` (host, path, ...) with `rule` and `ruled`: the first of the rules that fits, and its verdict.

    A rule fits its host and all subdomains if the path starts with its own. A short list is one
    expression; a longer one is a table that meets each url by the suffixes of its host.
    """
    if len(rules) > MOST_RULES:
        return _with_joined_rule(rows, rules)
    host, path = F.col("host"), F.col("path")
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in reversed(in_order(rules)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        named = F.when(fits, F.lit(rule_host + rule_path)).otherwise(named)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rows.withColumns({"rule": named, "ruled": verdict})


def _with_joined_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`with_rule` by a join on the suffixes of the host; a url meets the rules of its own domains only."""
    spark = rows.sparkSession
    ranked = [(place, *rule) for place, rule in enumerate(in_order(rules))]
    table = saved(spark.createDataFrame(ranked, "place int, ruled string, rule_host string, rule_path string"), "url-rules")
    urls = saved(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    # Only as many labels of a host count as the longest rule has.
    most = max(host.count(".") for _, host, _ in rules) + 1
    parts = F.split("host", r"\.")
    last = F.slice(parts, F.greatest(F.size(parts) - (most - 1), F.lit(1)), F.lit(most))
    suffix = lambda i: F.array_join(F.slice(last, i, F.lit(most)), ".")
    asked = urls.select("row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(last)), suffix)).alias("rule_host"))
    met = asked.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    named = F.concat("rule_host", "rule_path")
    best = met.groupBy("row").agg(F.min(F.struct("place", "ruled", named.alias("rule"))).alias("best"))
    best = saved(best.select("row", "best.rule", "best.ruled"), "url-ruled")
    return urls.join(best, "row", "left").drop("row")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labels: DataFrame | None = None,
    threshold: float = 0.5,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, p_block.

    The host is what follows the first "://" up to /, ? or #, A-Z lower-cased; the path goes on up
    to ? or #. Both are empty for a null url or one without "://". Where no rule fits, the verdict
    is "block" if the model's probability reaches `threshold`. Repeated rows and null keys are rows
    like any other; other columns are ignored.
    """
    model = fit(default_labels(pages.sparkSession) if labels is None else labels)
    parts = pages.select(
        F.col(key).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    scored = model.transform(_features(with_rule(parts, rules))).withColumn("p_block", vector_to_array("probability")[1])
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "p_block")
