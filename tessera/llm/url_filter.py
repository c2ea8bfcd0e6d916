"""URL filters: rules for hosts and paths, and for all else a character language-model ratio.

Two character models, of accepted and of rejected URLs, are counted from the URLs that the rules judge. A model is of variable order:
the chance of a character after a context of up to `order` characters mixes the estimate of each context length with that of
the next shorter one, by how often the context was seen (Witten-Bell), down to a uniform floor, so a context counts as far as it is known.
A URL's score is the difference of its log-likelihoods, accepted less rejected, per character. The threshold is calibrated on the
labelled URLs: of the scores to two digits, the one that errs least, both classes weighing the same, nearest to 0 on ties.

Characters are folded (digits are one, non-ASCII ones are one), so the distinct windows of `order` + 1 characters, whose log ratios are computed
once, number some 70^4 at most and far fewer in practice. They are broadcast while they number `most_broadcast` or fewer and joined by shuffle beyond that. All is
column expressions, aggregates and joins; equal URLs are scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import let, written

#: (host, path, verdict), the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Model:
    order: int = 3
    alphabet: int = 70
    most_broadcast: int = 500_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. A rule is written host and path, as in `net/`."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def folded(url: Column) -> Column:
    """url without what the rules can't see (the scheme), letters lower-cased, digits as 0, non-ASCII characters as ~."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"[0-9]", "0"), r"[^\x20-\x7E]", "~")


def windows(text: Column, order: int) -> Column:
    """Each character of text with the `order` characters before it; ^ stands before the first. An empty text has none."""
    padded = F.concat(F.lit("^" * order), text)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - order), lambda i: F.substring(p, i, order + 1)))
    )


def log_ratios(counts: DataFrame, model: Model) -> DataFrame:
    """(gram, ratio): log of accepted over rejected chance for each gram of counts(gram, accepted, rejected), also those no class has."""
    k = model.order
    seen = counts.where("accepted + rejected > 0")
    out = counts.select("gram", F.substring("gram", k + 1, 1).alias("c"), *(F.lit(1.0 / model.alphabet).alias(s) for s in ("pa", "pr")))
    for n in range(k + 1):
        # grams of n characters of context, and their contexts: how often, and before how many different characters
        short = seen.groupBy(F.substring("gram", k + 1 - n, n + 1).alias("g")).agg(F.sum("accepted").alias("ga"), F.sum("rejected").alias("gr"))
        context = short.groupBy(F.substring("g", 1, n).alias("x")).agg(
            F.sum("ga").alias("xa"), F.sum("gr").alias("xr"), F.count_if(F.col("ga") > 0).alias("ta"), F.count_if(F.col("gr") > 0).alias("tr")
        )
        own = F.substring("gram", k + 1 - n, n + 1)
        out = out.join(short, own == F.col("g"), "left").join(context, F.substring("gram", k + 1 - n, n) == F.col("x"), "left")
        mixed = {
            p: F.when(F.coalesce(F.col("x" + s), F.lit(0)) == 0, F.col(p)).otherwise(
                (F.coalesce(F.col("g" + s), F.lit(0)) + F.col("t" + s) * F.col(p)) / (F.col("x" + s) + F.col("t" + s))
            )
            for p, s in (("pa", "a"), ("pr", "r"))
        }
        out = out.select("gram", "c", *(v.alias(p) for p, v in mixed.items()))
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, model: Model = Model()) -> DataFrame:
    """pages(url, ...) with host, path, rule (null if none fits), verdict (allow or block) and score (null where a rule decides).

    Host and path are empty for a null url and one without ://. A url that folds to nothing scores 0, as does every url if the rules label none.
    Repeated rows get the same values. The result has these columns and page_id if pages has it. An empty table gives none.
    """
    keep = [c for c in ("page_id",) if c in pages.columns]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(*keep, folded(F.col("url")).alias("folded"), host.alias("host"), path.alias("path")).select(
        "*", rule_of(F.col("host"), F.col("path"), rules).alias("r")
    )
    label = F.coalesce("r.verdict", F.lit(""))
    urls = written(judged.groupBy("folded", label.alias("label")).agg(F.count("*").alias("n")), "urls")
    each = urls.select("label", "n", F.explode_outer(windows(F.col("folded"), model.order)).alias("gram")).where("gram IS NOT NULL")
    of = lambda v: F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0))
    counts = written(each.groupBy("gram").agg(of("allow").alias("accepted"), of("block").alias("rejected")), "grams")
    ratios = written(log_ratios(counts, model), "ratios")
    small = ratios.count() <= model.most_broadcast
    steps = urls.select("folded", "label", "n", F.explode_outer(windows(F.col("folded"), model.order)).alias("gram")).where("gram IS NOT NULL")
    scored = steps.join(F.broadcast(ratios) if small else ratios, "gram").groupBy("folded", "label").agg(F.round(F.avg("ratio"), 6).alias("score"), F.first("n").alias("n"))
    scored = written(scored, "scores")
    limit = threshold(scored.where("label <> ''"))
    # one row
    other = scored.where("label = ''").select("folded", "score").crossJoin(F.broadcast(limit))
    found = judged.join(other, ["folded"], "left")
    score = F.when(F.col("r").isNull(), F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("r.verdict", F.when(score >= F.coalesce("limit", F.lit(0.0)), "allow").otherwise("block"))
    return found.select(*keep, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, limit: the score from which a url is accepted, from scored(score, label, n). 0 unless both classes are there."""
    sums = [F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(a) for v, a in (("allow", "a"), ("block", "b"))]
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(*sums)  # a few thousand at most
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # limits above the bin before and up to this one err alike: of them the nearest to 0
    lower = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.least("bin", F.lit(0)))
    errors = bins.select(
        (F.greatest(lower, F.least("bin", F.lit(0))) / 100).alias("limit"),
        F.coalesce(F.sum("a").over(before), F.lit(0)).alias("lost"), (F.sum("b").over(whole) - F.coalesce(F.sum("b").over(before), F.lit(0))).alias("let"),
        F.sum("a").over(whole).alias("all_a"), F.sum("b").over(whole).alias("all_b"),
    ).where("all_a > 0 AND all_b > 0")
    best = errors.select(F.min_by("limit", F.struct(F.round(F.col("lost") / F.col("all_a") + F.col("let") / F.col("all_b"), 9), F.abs("limit"), "limit")).alias("limit"))
    return best.select(F.coalesce("limit", F.lit(0.0)).alias("limit"))
