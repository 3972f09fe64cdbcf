"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

All in DataFrame expressions. The model is trained in its dual form from a small labelled table (at most
``MOST_LABELLED`` rows unless told otherwise): n-gram counts give the kernel of the labelled URLs, gradient steps run inside
one ``aggregate`` expression over that kernel, and the weights are sums over labelled URLs, one
for each of ``DIM`` hash cells. They reach the scan as a literal array of ``DIM`` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

DIM, SIZES, MOST_LABELLED = 4096, (3, 4, 5), 1000

#: Words of made-up host names for a small labelled table. No name is a host of the test tables.
BLOCK_WORDS = ["pills", "casino", "bets", "spam", "ads", "adult", "cheap", "win", "free", "farm", "track", "xxx", "meds", "poker", "jackpot", "seo", "click", "cams", "replica", "prize", "loans", "slots", "popup", "viagra"]
ALLOW_WORDS = [
    "garden", "river", "baker", "library", "mountain", "history", "weather", "parser", "school", "physics", "kitchen", "music", "theory", "travel", "woodwork", "source",
    "museum", "station", "northern", "leather", "brother", "together", "nation", "edition", "university", "astronomy", "language", "sailing", "notable", "reading", "anthem", "motion",
    "gathering", "there", "methods", "position", "winter", "clothing", "freedom", "address", "other", "thread", "truth", "earth", "month", "health", "breathing", "nothing",
]
#: What stands before and after a name; the name's number picks one.
BEFORE, AFTER = ["https://www.", "http://", "https://m.", "https://blog.", "https://"], [".example.com/en/12", ".example/", ".example.org/de/5.html", ".example.net/a/story", ".example.org/fr/9?q=1", ".example.com/es/77", ".example.net/en/3#top"]


def _labelled() -> list[tuple[str, int]]:
    """Each word with others (its neighbours at some distances, so that no pair comes twice) or alone; 1: block."""
    out = []
    for label, words, steps in ((1, BLOCK_WORDS, (5, 7, 11)), (0, ALLOW_WORDS, (5, 0))):
        names = [words[i] + (f"-{words[(i + step) % len(words)]}" if step else "") for step in steps for i in range(len(words))]
        out += [(f"{BEFORE[i % len(BEFORE)]}{name}{AFTER[i % len(AFTER)]}", label) for i, name in enumerate(names)]
    return out


LABELLED = _labelled()

#: Fixed values: (verdict, host/path). A rule holds for its host and all below it, and paths that begin so.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls; of equal rules, block goes first."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _cell(mark: str, text: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(text, i, F.lit(n))), F.lit(DIM)).cast("int")


def cells(host: Column, path: Column) -> Column:
    """Hash cells of the character n-grams of host and of path (ends marked; numbers read as one sign)."""
    grams = []
    for mark, part in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]+", "0"), F.lit("$"))
        for n in SIZES:
            places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(places, _cell(mark, text, n)))
    return F.flatten(F.array(*grams))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", steps: int = 600, rate: float = 2.0, decay: float = 0.001, most: int = MOST_LABELLED) -> list[float]:
    """Weights of the ``DIM`` cells, and the intercept last.

    ``labelled`` has at most ``most`` rows (ValueError beyond); rows without url or label are left out; of none, all
    weights are 0. Features of a URL are its n-gram counts over the root of their sum: not over their Euclidean norm,
    which would have to be found by grouping the cells of every url that is judged (and costs more CPU).
    """
    url = F.col(url_col)
    rows = labelled.filter(url.isNotNull() & F.col(label_col).isin(0, 1)).select(url.alias("u"), F.col(label_col).cast("double").alias("y")).groupBy("u").agg(F.max("y").alias("y"))
    known = rows.count()
    if known > most:
        raise ValueError(f"{known} labelled rows; at most {most} are taken")
    if not known:
        return [0.0] * (DIM + 1)
    counts = rows.select("u", "y", F.explode(cells(host_of(F.col("u")), path_of(F.col("u")))).alias("cell")).groupBy("u", "y", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norms = counts.groupBy("u").agg(F.sqrt(F.sum("n")).alias("norm"))
    x = counts.join(norms, "u").select("u", "y", "cell", (F.col("n") / F.col("norm")).alias("v"))
    other = x.select(F.col("u").alias("w"), "cell", F.col("v").alias("z"))
    kernel = x.join(other, "cell").groupBy("u", "y", "w").agg(F.sum(F.col("v") * F.col("z")).alias("k"))
    each = kernel.groupBy("u", "y").agg(F.map_from_entries(F.collect_list(F.struct("w", "k"))).alias("k"))
    whole = each.agg(F.array_sort(F.collect_list("u")).alias("us"), F.map_from_entries(F.collect_list(F.struct("u", F.struct("y", "k")))).alias("of"))
    # The constant 1 in each product stands for the intercept.
    line = lambda u: F.transform("us", lambda w: F.coalesce(F.element_at(F.element_at("of", u)["k"], w), F.lit(0.0)) + 1)
    whole = whole.select(F.transform("us", lambda u: F.struct(u.alias("u"), F.element_at("of", u)["y"].alias("y"), line(u).alias("k"))).alias("t"))
    whole = cut(whole)  # one row; else each step would build the kernel again
    sigmoid = lambda s: 1 / (1 + F.exp(-s))

    def step(alpha: Column, _: Column) -> Column:
        def one(row: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(row["k"], alpha, lambda k, a: k * a), F.lit(0.0), lambda acc, v: acc + v)
            return F.get(alpha, i) * (1 - rate * decay) + rate / known * (row["y"] - sigmoid(margin))

        return F.transform(F.col("t"), one)

    dual = whole.select(F.arrays_zip(F.transform("t", lambda r: r["u"]).alias("u"), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("t", lambda r: F.lit(0.0)), step).alias("a")).alias("z"))
    alphas = dual.select(F.explode("z").alias("z")).select(F.col("z.u").alias("u"), F.col("z.a").alias("a"))
    weights = x.join(alphas, "u").groupBy("cell").agg(F.sum(F.col("v") * F.col("a")).alias("w"))
    out = [0.0] * (DIM + 1)
    for cell, w in weights.unionByName(alphas.agg(F.lit(DIM).alias("cell"), F.sum("a").alias("w"))).collect():
        out[cell] = round(w, 9)
    return out


def chance(found: Column, weights: list[float]) -> Column:
    """The model's probability that a URL of these cells is to be blocked."""
    literal = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda acc, c: acc + F.get(literal, c))
    return 1 / (1 + F.exp(-(F.when(F.size(found) > 0, total / F.sqrt(F.size(found))).otherwise(0.0) + F.lit(weights[-1]))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{u}', {y})" for u, y in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5, most: int = MOST_LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, chance (of the model, for every url).

    Null urls, and urls without ``://``, have the empty host and path: no rule fits, and the model judges
    the empty strings. Rows that repeat get equal rows; an empty table gives none.
    """
    weights = train(labelled, most=most)
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hashed = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"), cells(F.col("host"), F.col("path")).alias("cells"))
    judged = hashed.withColumn("chance", chance(F.col("cells"), weights))
    verdict = F.coalesce("fit.verdict", F.when(F.col("chance") >= threshold, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "chance")
