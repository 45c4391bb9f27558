"""URL filter: host rules first, then logistic regression on character n-grams.

A URL that no rule decides is scored by a logistic regression on the hashed
character n-grams (3 to 5) of its host and path, digits taken as one sign. The
model is fitted by Spark ML on a small labelled URL table (``url, label``; 1:
block), which ``judge`` takes; the default table is made from the two word lists
below, each word alone and beside an ordinary one, with prefixes, domains and
paths that both classes share, so that the word decides. Scoring is one
projection: no shuffle, no Python. ``held_out_counts`` judges labelled hosts by
models that haven't seen them.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is judged by the model's intercept; hosts are lower-cased in A-Z only;
ports and user names stay part of the host; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import read_table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = 1 << 16
NGRAMS = (3, 4, 5)
MAX_LABELLED = 20_000  # rows of the labelled table used for the fit
BLOCK_FROM = 0.5

# Words found in names of advertising, tracking, spam, gambling,
# fraud and adult sites, and words of ordinary ones.
BLOCK_WORDS = ("ads", "adserver", "banner", "popup", "tracker", "tracking", "pixel", "spam", "casino", "poker", "bets",
               "jackpot", "slots", "lottery", "prize", "pills", "pharma", "viagra", "xxx", "porn", "adult", "sexy", "warez",
               "crack", "keygen", "malware", "phishing", "scam", "loan", "cash")
ALLOW_WORDS = ("news", "library", "university", "museum", "science", "history", "weather", "recipes", "garden", "travel",
               "school", "hospital", "city", "council", "theatre", "music", "cinema", "sports", "football", "railway",
               "nature", "ocean", "forest", "mountain", "river", "kitchen", "bakery", "village", "archive", "journal",
               "letters", "poems", "novels", "grammar", "language", "maths", "physics", "chemistry", "biology", "geology",
               "software", "compiler", "database", "network", "hardware", "review", "forum", "wiki", "manual", "tutorial",
               "bridge", "harbour", "castle", "market", "island", "winter", "summer", "painter", "teacher", "doctor",
               "address", "badge", "shadow", "pixie", "track", "sussex", "bethany", "lottie", "cashmere", "cracker",
               "english", "fresh", "fish", "wash", "brush", "station", "nation", "action", "question", "mother", "thunder",
               "theory", "thesis", "month", "health", "north", "south", "table", "apple", "people", "stone", "street",
               "house", "horse", "paper", "pencil", "window", "yellow", "green", "silver", "copper", "carpenter", "engine",
               "printer", "farmer", "sailor", "lawyer", "family", "children", "walking", "cooking", "sewing", "reading",
               "picture", "culture", "nursery", "pottery", "dinner", "banquet", "adults-choir", "lots", "poke", "pillow")
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.net", "example.org")
PATHS = ("/en/1.html", "/de/22/", "/fr/333", "/es/4444.html?page=2", "/", "")


def site_names(words: tuple[str, ...], others: tuple[str, ...], pairs: int) -> list[tuple[str, str]]:
    """``(name, word)``: each word alone, and ``pairs`` times before and after
    words of ``others``."""
    names = []
    for i, word in enumerate(words):
        names.append((word, word))
        for k in range(pairs):
            first, second = others[(7 * i + 13 * k + 3) % len(others)], others[(11 * i + 17 * k + 5) % len(others)]
            names += [(f"{word}-{first}", word), (f"{second}{word}", word)]
    return names


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table, ``url, label, word``: names of block words
    beside ordinary words, and names of ordinary words only. ``word`` is the one
    that gives the label; a fold of them can be held out of the fit."""
    rows = []
    for label, words, pairs in ((1.0, BLOCK_WORDS, 4), (0.0, ALLOW_WORDS, 1)):
        for i, (name, word) in enumerate(site_names(words, ALLOW_WORDS, pairs)):
            for j, prefix in enumerate(PREFIXES):
                host = f"{prefix}{name}.{DOMAINS[(i + j) % len(DOMAINS)]}"
                rows.append((f"https://{host}{PATHS[(2 * i + j) % len(PATHS)]}", label, word))
    return spark.createDataFrame(rows, "url string, label double, word string").coalesce(1)


def held_out_counts(labelled: DataFrame, group: str, folds: int = 5, block_from: float = BLOCK_FROM) -> DataFrame:
    """``fold, true_block, false_block, false_allow, true_allow``: labelled rows
    judged by a model fitted without any row of their fold; ``group`` (the host,
    or the word that gives the label) lies in one fold."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    judged = None
    for fold in range(folds):  # a handful of fits on the small table
        model = fit(rows.where(F.col("_fold") != fold)).setProbabilityCol("_probability")
        one = (model.transform(featured(rows.where(F.col("_fold") == fold)))
               .select(F.lit(fold).alias("fold"), (F.col("label") > 0.5).alias("bad"), (vector_to_array("_probability")[1] >= block_from).alias("said")))
        judged = one if judged is None else judged.unionByName(one)
    return judged.groupBy("fold").agg(
        F.count_if(F.col("bad") & F.col("said")).alias("true_block"), F.count_if(~F.col("bad") & F.col("said")).alias("false_block"),
        F.count_if(F.col("bad") & ~F.col("said")).alias("false_allow"), F.count_if(~F.col("bad") & ~F.col("said")).alias("true_allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), upper, upper.lower()),
            F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``(rule, verdict)``, else null. Equally long
    ones: the first in the table."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(list(rules)), key=lambda r: len(r[0])):  # later ones are tried first
        site, _, tail = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams, those of the host and of the path kept apart."""
    def cut(text: Column, mark: str, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))

    whole = F.concat(F.lit("."), F.regexp_replace(host, "[0-9]+", "0"), F.lit("/"))
    tail = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(*[cut(whole, "h", n) for n in NGRAMS], *[cut(tail, "p", n) for n in NGRAMS])


def featured(urls: DataFrame) -> DataFrame:
    """Adds ``_host``, ``_path`` and ``_features``."""
    host, path = host_and_path(F.col("url"))
    with_parts = urls.withColumn("_host", host).withColumn("_path", path).withColumn("_grams", ngrams(F.col("_host"), F.col("_path")))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(with_parts).drop("_grams")


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> LogisticRegressionModel:
    """Fit on at most ``max_rows`` labelled rows, in order of their URL's hash."""
    rows = (labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label"))
            .where("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows))
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.002, maxIter=60).fit(featured(rows))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, block_from: float = BLOCK_FROM) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; ``score`` is
    the model's probability of block."""
    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    model.setProbabilityCol("_probability")
    rows = featured(pages.select("page_id", F.col("url").cast("string").alias("url")))
    scored = model.transform(rows).withColumn("_score", vector_to_array("_probability")[1])
    hit = matched_rule(F.col("_host"), F.col("_path"), rules)
    return scored.withColumn("_rule", hit).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_score") >= block_from, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
