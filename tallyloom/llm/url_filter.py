"""URL filter: host and path rules first, then a ratio of two character language models.

Every distinct URL that a rule settles is a training text: allowed ones for the model of accepted
URLs, blocked ones for the model of rejected URLs. Both are Markov models over characters whose
order varies with the evidence: the probability after a long context is interpolated with that
after the next shorter one, weighted by how many different characters followed the context
(Witten and Bell's smoothing), down to a uniform distribution. A URL's score is the mean
difference of log-likelihood per character. The threshold is calibrated on settled URLs that the
models have not seen: the one that separates them best (Youden's index).

Everything is DataFrame expressions. What is broadcast is the table of differences by n-gram. It has
at most ``len(ALPHABET) + 1`` to the power ``order + 1`` rows of two numbers, some 3 million for the
default order, whatever the data.

Differences are rounded to millionths and summed as integers, so a score does not depend on the
order of summation.

Defined cases: a NULL URL counts as an empty one (empty host and path, judged by the models); equal
URLs get equal verdicts and every input row comes back; an empty table gives an empty result. With
no settled URL at all, all differences are 0 and everything unsettled is allowed. Of the columns of
``pages`` only the id and the URL are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyloom.llm.columns import ascii_lower
from tallyloom.session import cut_lineage

# Symbols of the models; digits are folded to 0, all other characters are symbol 0.
# The last two stand for before the first and after the last character.
ALPHABET = string.ascii_lowercase + "0/.-_?=&#%:~+^$"
SYMBOLS = len(ALPHABET) + 1
START, END = SYMBOLS - 2, SYMBOLS - 1
OTHER = r"[^a-z0/.\-_?=&#%:~+]"

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], result: int) -> Column:
    """Of the longest rule that fits: its text (``result`` 1) or its verdict (0); else NULL."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule[1]), rule[1])):
        name, slash, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[result])).otherwise(found)
    return found


def symbols_of(url: Column, order: int) -> Column:
    """The URL as symbols, padded with ``order`` starts and one end."""
    folded = F.regexp_replace(ascii_lower(F.regexp_replace(url, "[1-9]", "0")), OTHER, "*")
    inner = F.transform(F.split(folded, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    inner = F.when(url == "", F.array().cast("array<int>")).otherwise(inner)
    return F.concat(F.array_repeat(F.lit(START), order), inner, F.array(F.lit(END)))


def grams_of(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of each URL (and one for its end): the n-gram that ends there."""
    placed = (urls.withColumn("symbols", symbols_of(F.col("url"), order))
              .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("symbols") - order - 1))))
    gram = F.lit(0).cast("long")
    for k in range(order + 1):
        gram = gram * SYMBOLS + F.col("symbols")[F.col("at") + k]
    return placed.select(*urls.columns, gram.alias("gram"))


def differences(grams: DataFrame, order: int) -> DataFrame:
    """``gram, diff``: the log-likelihood difference in millionths of every n-gram of the corpus.

    ``grams`` has ``gram`` and ``side``: 1 for accepted and 0 for rejected training texts, else NULL.
    """
    counts = grams.groupBy("gram").agg(
        F.count_if(F.col("side") == 1).alias("yes"), F.count_if(F.col("side") == 0).alias("no"))
    counts = cut_lineage(counts)
    below = None
    for k in range(order + 1):
        level = (counts.groupBy((F.col("gram") % SYMBOLS ** (k + 1)).alias("gram"))
                 .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
                 .withColumn("context", F.floor(F.col("gram") / SYMBOLS)))
        by = Window.partitionBy("context")
        if below is None:
            level = level.withColumns({f"{c}_below": F.lit(1.0 / SYMBOLS) for c in ("yes", "no")})
        else:
            level = (level.withColumn("shorter", F.col("gram") % SYMBOLS ** k)
                     .join(below.withColumnRenamed("gram", "shorter"), "shorter"))
        level = level.withColumns({
            f"{c}_{what}": value for c in ("yes", "no") for what, value in (
                ("all", F.sum(c).over(by)), ("kinds", F.count_if(F.col(c) > 0).over(by)))})
        below = level.select("gram", *(
            F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_below"))
                   / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_below")).alias(f"{c}_below")
            for c in ("yes", "no")))
    return below.select("gram", F.round(
        (F.log("yes_below") - F.log("no_below")) * 1e6).cast("long").alias("diff"))


def scores(urls: DataFrame, diffs: DataFrame, order: int) -> DataFrame:
    """``urls`` with ``score``: mean difference per character in hundredths, within -1000 to 1000."""
    mean = F.sum("diff") / (F.count(F.lit(1)) * 10000.0)
    return (grams_of(urls, order).join(F.broadcast(diffs), "gram").groupBy(*urls.columns)
            .agg(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(mean))).cast("int").alias("score")))


def calibrated(scored: DataFrame) -> int:
    """The score from which on URLs are allowed: the best separation of ``side`` 1 and 0.

    Scores have 2001 values, so this is about one small table. Of equally good thresholds the one
    nearest to 0 counts, then the lower one. Without URLs on both sides it is 0.
    """
    bins = scored.groupBy("score").agg(
        F.count_if(F.col("side") == 1).alias("yes"), F.count_if(F.col("side") == 0).alias("no"))
    up = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    gain = (F.sum("yes").over(up) * 1.0 * F.sum("no").over(every)
            - F.sum("no").over(up) * 1.0 * F.sum("yes").over(every))
    best = (bins.select("score", gain.alias("gain")).where("gain > 0")
            .orderBy(F.col("gain").desc(), F.abs("score"), "score").first())
    return best["score"] if best else 0


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], order: int = 3, id_column: str = "page_id",
               url_column: str = "url", held_out: str = "012") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict`` and ``score``.

    ``rules`` are pairs of verdict and text such as ``("block", "net/es/")``. ``held_out``: first hex
    digits of the URL's md5 that calibrate instead of train.
    """
    own = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = own.select("url").distinct().withColumn(
        "settled", (rule_of(host, path, rules, 0) == ALLOW).cast("int"))
    calibrates = F.substring(F.md5("url"), 1, 1).isin(*held_out)
    training = grams_of(urls.select("url", F.when(~calibrates, F.col("settled")).alias("side")), order)
    diffs = cut_lineage(differences(training, order))
    held = urls.where(calibrates & F.col("settled").isNotNull())
    threshold = calibrated(scores(held.select("url", F.col("settled").alias("side")), diffs, order))
    scored = scores(urls.select("url"), diffs, order)
    verdict = F.coalesce(rule_of(F.col("host"), F.col("path"), rules, 0),
                         F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK))
    return (own.join(scored, "url").withColumns({"host": host, "path": path})
            .select(F.col("id").alias(id_column), "host", "path",
                    rule_of(F.col("host"), F.col("path"), rules, 1).alias("rule"),
                    verdict.alias("verdict"), "score"))
