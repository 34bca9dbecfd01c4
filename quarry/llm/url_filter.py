"""URL filter: rules first, then a ratio of two character language models.

Accepted and rejected URLs (those a rule decides) each train a Markov model of variable order over
the characters of host and path: P(c | context) of order k mixes the counts of its context with the
order below, in proportion to how often the context was seen, so a URL is judged by the longest
contexts that training has met. A URL's score is the mean over its characters of
ln P(accepted) - ln P(rejected). The threshold is calibrated on training URLs that the counts have
not seen: where the shares of rejected and accepted URLs below it differ most.

Only DataFrame functions are used. Tables hold one row per different gram; URLs are scored once per
different text.

Defined cases: a null URL, or one without ``://``, has an empty host and path. An empty text has the
score 0. Without training URLs of both kinds all scores are 0; without unseen ones of both kinds
the threshold is 0. A score at the threshold is accepted. Repeated rows are judged each. Other
columns are not looked at.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut

ALLOW, BLOCK = "allow", "block"
#: Verdict and host with path.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
ORDER = 3
STRENGTH = 4.0
ALPHABET = 256.0
#: Texts whose md5 begins with one of these are not counted but calibrate the threshold.
UNSEEN = ("0", "1", "2")
#: Width of the classes in which the threshold is looked for, and the largest score told apart.
STEP = 0.01
LIMIT = 20.0
#: Characters that no URL has: before the first and after the last.
BEFORE, AFTER = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: len(r[1])):  # a longer rule overrides
        its_host, slash, its_path = text.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(slash + its_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, order: int = ORDER) -> Column:
    """Every character with the ``order`` before it; one for the end."""
    # split once, and held by a name: a substring would walk from the text's begin each time
    padded = F.array(F.split(F.concat(F.lit(BEFORE * order), text, F.lit(AFTER)), ""))
    places = F.sequence(F.lit(0), F.length(text))
    each = F.transform(padded, lambda chars: F.transform(
        places, lambda i: F.concat(*(F.get(chars, i + k) for k in range(order + 1)))))
    return F.when(F.length(text) > 0, F.get(each, 0))


def _parts(gram: Column, order: int) -> list[tuple[str, Column]]:
    """What a gram's probability is made of: contexts of each order, alone and with the character."""
    out = []
    for k in range(order + 1):
        out.append((f"x{k}", F.substring(gram, order + 1 - k, k) if k else F.lit("")))
        out.append((f"c{k}", F.substring(gram, order + 1 - k, k + 1)))
    return out


def gram_scores(training: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, llr for every gram of ``wanted``, from training rows (text, accepted)."""
    each = training.select(F.explode(grams(F.col("text"), order)).alias("gram"), F.col("accepted").cast("int").alias("a"))
    counts = each.groupBy("gram").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("r"))
    looked_up = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("part")) for k, v in _parts(F.col("gram"), order))))
    stats = (counts.select(looked_up.alias("p"), "a", "r").groupBy("p.kind", "p.part")
             .agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    seen = wanted.select("gram", looked_up.alias("p")).select("gram", "p.kind", "p.part").join(stats, ["kind", "part"])
    wide = [F.max(F.when(F.col("kind") == f"{x}{k}", F.col(side))).alias(f"{x}{k}{side}")
            for k in range(order + 1) for x in "xc" for side in "ar"]
    table = wanted.join(seen.groupBy("gram").agg(*wide), "gram", "left")

    def log(side: str) -> Column:
        p: Column = F.lit(1 / ALPHABET)
        for k in range(order + 1):
            c, x = (F.coalesce(F.col(f"{kind}{k}{side}"), F.lit(0)).cast("double") for kind in "cx")
            p = (c + STRENGTH * p) / (x + STRENGTH)
        return F.ln(p)

    return table.select("gram", (log("a") - log("r")).alias("llr"))


def text_scores(training: DataFrame, texts: DataFrame, order: int = ORDER) -> DataFrame:
    """code, score for every different ``texts.code``, the digest of its ``text``."""
    texts = texts.groupBy("code").agg(F.first("text").alias("text"))
    both = training.agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    if not all(both):
        return texts.select("code", F.lit(0.0).alias("score"))
    # grams go with the digest: a row of each with the whole of a long text would be its square
    each = texts.select("code", F.explode(grams(F.col("text"), order)).alias("gram"))
    scored = gram_scores(training, each.select("gram").distinct(), order)
    # each gram of a text once, with its number: a frequent gram is one row per text
    sums = (each.groupBy("gram", "code").agg(F.count(F.lit(1)).alias("n")).join(scored, "gram")
            .groupBy("code").agg((F.sum(F.col("n") * F.col("llr")) / F.sum("n")).alias("score")))
    return texts.select("code").join(sums, "code", "left").select("code", F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score that best parts rows (score, accepted): between two classes of scores that occur.

    The classes are bounded in number, and one row of them is fetched.
    """
    place = F.floor(F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) / STEP)
    table = scored.groupBy(place.alias("place")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    before, whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)) / F.nullif(F.sum(c).over(whole), F.lit(0))
    edge = F.coalesce(F.lag("place").over(Window.orderBy("place")) + 1, F.col("place"))
    gain = table.select("place", (F.col("place") + edge).alias("twice"), (share("r") - share("a")).alias("gain"))
    best = gain.filter("gain is not null").orderBy(F.round("gain", 9).desc(), F.abs("twice"), "place").first()
    return best["twice"] * (STEP / 2) if best else 0.0


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = tuple(RULES),
          order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.select("*", rule.alias("rule"), said.alias("said"), F.concat("host", "path").alias("text"),
                           F.md5(F.concat("host", "path").cast("binary")).alias("code"))
               .withColumn("unseen", F.substring("code", 1, 1).isin(*UNSEEN)), "url-rows")
    decided = rows.filter("said is not null").select("text", "code", (F.col("said") == ALLOW).alias("accepted"), "unseen")
    training, held = decided.filter("not unseen"), decided.filter("unseen")
    asked = rows.filter("said is null").select("text", "code").unionByName(held.select("text", "code"))
    scores = cut(text_scores(training, asked, order), "url-scores")
    limit = threshold(held.join(scores, "code").select("score", "accepted"))
    open_ = F.col("said").isNull()
    return rows.join(scores, "code", "left").select(
        "page_id", "host", "path", "rule",
        F.when(~open_, F.col("said")).when(F.col("score") >= F.lit(limit), ALLOW).otherwise(BLOCK).alias("verdict"),
        F.when(open_, F.round("score", 5)).alias("score"))
