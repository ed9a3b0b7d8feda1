"""URL filter: rules first, then the likelihood ratio of two character Markov models of variable order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import stored
from siftline.operators.skew import lookup_join

#: Mark the start and the end of a URL; neither can occur in one that was parsed.
BEGIN, END = "\x02", "\x03"
#: Characters that a model has never seen share this many places.
ALPHABET = 256


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for every character of ``s`` and its end: the character behind the ``order`` before it."""
    padded = F.concat(F.lit(BEGIN * order), "s", F.lit(END))
    every = F.transform(F.sequence(F.lit(1), F.char_length("s") + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))
    return urls.select(*keep, F.explode(every).alias("top"))


def _suffixes(frame: DataFrame, order: int, *keep: str) -> DataFrame:
    """The grams of all orders that end a full gram, and their contexts."""
    each = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.struct(n.alias("size"), F.right("top", n).alias("gram")))
    out = frame.select(*keep, F.explode(each).alias("g")).select(*keep, F.col("g.size").alias("size"), F.col("g.gram").alias("gram"))
    return out.withColumn("context", F.substr("gram", F.lit(1), F.col("size") - 1))


def model_counts(urls: DataFrame, *, order: int) -> tuple[DataFrame, DataFrame]:
    """From (s, accepted): counts of every gram, and of every context its characters and different characters, per class."""
    tops = _grams(urls, order, "accepted").groupBy("accepted", "top").agg(F.count(F.lit(1)).alias("n"))
    grams, _ = stored(
        _suffixes(tops, order, "accepted", "top", "n").groupBy("context", "gram").agg(
            F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("na"),
            F.sum(F.when(F.col("accepted"), F.lit(0)).otherwise(F.col("n"))).alias("nr"),
        ),
        "url-grams",
    )
    contexts = grams.groupBy("context").agg(
        F.sum("na").alias("ca"), F.sum("nr").alias("cr"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nr") > 0).alias("tr")
    )
    return grams.drop("context"), stored(contexts, "url-contexts")[0]


def _smoothed(total: str, kinds: str, count: str) -> Column:
    """Witten-Bell: each order gives the share of its different characters to the order below."""

    def step(below: Column, level: Column) -> Column:
        known = level[total] + level[kinds]
        return F.when(known > 0, (level[count] + level[kinds] * below) / known).otherwise(below)

    return F.aggregate("levels", F.lit(1.0 / ALPHABET), step)


def log_ratios(tops: DataFrame, grams: DataFrame, contexts: DataFrame, *, order: int) -> DataFrame:
    """For each full gram the log of how much likelier the accepted model makes its last character."""
    parts, _ = stored(_suffixes(tops, order, "top"), "url-parts")
    with_counts, _ = stored(lookup_join(parts, grams, ["gram"]), "url-with-counts")
    found = lookup_join(with_counts, contexts, ["context"]).fillna(0, ["na", "nr", "ca", "cr", "ta", "tr"])
    level = F.struct("size", *[F.col(c).cast("double").alias(c) for c in ("na", "nr", "ca", "cr", "ta", "tr")])
    per_top = found.groupBy("top").agg(F.array_sort(F.collect_list(level)).alias("levels"))  # order + 1 levels each
    return per_top.select("top", (F.log(_smoothed("ca", "ta", "na")) - F.log(_smoothed("cr", "tr", "nr"))).alias("ratio"))


def score_urls(urls: DataFrame, grams: DataFrame, contexts: DataFrame, *, order: int) -> DataFrame:
    """(s, score): the log-likelihood difference of each distinct string, per character."""
    distinct = urls.select("s").distinct()
    events, _ = stored(_grams(distinct, order, "s").groupBy("s", "top").agg(F.count(F.lit(1)).alias("n")), "url-events")
    ratios, _ = stored(log_ratios(events.select("top").distinct(), grams, contexts, order=order), "url-ratios")
    return lookup_join(events, ratios, ["top"]).groupBy("s").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))


def best_threshold(scored: DataFrame, *, steps: int = 200) -> float:
    """The score at which accepted and rejected strings are told apart best, both classes weighing the same.

    Scores are counted in ``steps`` bins of 0.02, so a table of fixed size reaches the driver.
    """
    cell = F.least(F.greatest(F.floor(F.col("score") * 50), F.lit(-steps // 2)), F.lit(steps // 2))
    rows = scored.groupBy(cell.alias("cell")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()
    accepted, rejected = sum(r["a"] for r in rows), sum(r["r"] for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, at, lost_a, kept_r = None, [], 0, rejected
    for row in sorted(rows, key=lambda r: r["cell"]):
        wrong = lost_a / accepted + kept_r / rejected
        if best is None or wrong < best - 1e-12:
            best, at = wrong, [row["cell"]]
        elif wrong <= best + 1e-12:
            at.append(row["cell"])
        lost_a, kept_r = lost_a + row["a"], kept_r - row["r"]
    return (at[0] + at[-1]) / 2 / 50


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, url: str = "url", order: int = 4) -> DataFrame:
    """Add host, path, rule, verdict and ``url_score`` to every row; other columns stay.

    Where a rule fits, its verdict holds. The rest is judged by models of host and path: one is
    counted over all URLs that rules allow, one over all they block, but for a fifth by a hash
    of the string, which sets the threshold. Null urls and those without ``://`` have empty
    host and path and are judged as empty strings. Without examples of both classes the score
    is what smoothing leaves and the threshold 0. Strings are judged once however often they
    repeat. Columns with the names of added ones are replaced. ``url_score`` is null where a
    rule decided.
    """
    own = ["host", "path", "rule", "verdict", "url_score"]
    row = pages.select(F.struct(*[c for c in pages.columns if c not in own]).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = row.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("s", F.concat("host", "path"))
    texts, _ = stored(judged.select("s", "ruled").groupBy("s", "ruled").agg(F.count(F.lit(1)).alias("n")), "url-strings")
    known = texts.filter(F.col("ruled").isNotNull()).select("s", (F.col("ruled") == "allow").alias("accepted"), (F.pmod(F.xxhash64("s"), F.lit(5)) == 0).alias("check"))
    grams, contexts = model_counts(known.filter("NOT check"), order=order)
    to_score = texts.filter("ruled IS NULL").select("s").union(known.filter("check").select("s"))
    scores, _ = stored(score_urls(to_score, grams, contexts, order=order), "url-scores")
    threshold = best_threshold(known.filter("check").join(scores, "s"))
    found = judged.join(scores.withColumnRenamed("s", "_s"), F.col("ruled").isNull() & (F.col("s") == F.col("_s")), "left")
    return found.select(
        "row.*", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        F.col("score").alias("url_score"),
    )
