"""URL filter by the ratio of two character language models.

URLs that the rules accept and reject train one smoothed variable-order Markov model each (Witten-Bell: every context
mixes its own counts with the model of the next shorter context). A URL without a rule is judged by its mean log
ratio per character, against a threshold calibrated on URLs with a rule that trained no model: about a third, taken by a hash
of the URL, so that copies stand on the same side. A class without such URLs is calibrated on its training URLs.

Grams of all URLs are counted once, per class; all shorter contexts follow from that table, so the text is read once for
the models and once for the scores. Grams that many URLs share are dealt over salts where scores are looked up.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule; a null URL is scored as empty text. Repeated
URLs count each. If no URL is accepted, or none rejected, URLs without a rule are allowed. A score equal to the threshold is
accepted. Other columns travel untouched; those with the name of a result (``RESULT``) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, lower_ascii, stored

ORDER = 4  # longest context
PIECE = 512  # grams are cut from pieces of a text: a position is found by counting from the start
HELD_OUT = "5"  # URLs whose MD5 in hex starts below this calibrate and do not train: 5 of 16
RESULT = ["host", "path", "rule", "score", "verdict"]
EDGE = "\x02"  # stands before the first and behind the last character

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def grams(text: Column, order: int = ORDER) -> Column:
    """All grams of a text: each character, and the end, behind its ``order`` predecessors."""
    padded = F.concat(F.lit(EDGE * order), F.lower(F.coalesce(text, F.lit(""))), F.lit(EDGE))
    starts = F.sequence(F.lit(1), F.char_length(padded) - order, F.lit(PIECE))
    pieces = F.transform(starts, lambda i: padded.substr(i, F.lit(PIECE + order)))
    of = lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - order), lambda i: p.substr(i, F.lit(order + 1)))
    return F.flatten(F.transform(pieces, of))


def gram_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log P_accepted - log P_rejected of each gram of ``counted`` (gram, a, r)."""
    scored = None
    classes = ("a", "r")
    for k in range(order + 1):
        seen = counted.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in classes])
        context = lambda: F.substring("gram", 1, k)  # noqa: B023, E731
        totals = seen.groupBy(context().alias("context")).agg(
            *[F.sum(c).alias(f"n{c}") for c in classes], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"t{c}") for c in classes])
        if k == 0:
            alphabet = max(1, seen.count())
            row = totals.first() or {f"{x}{c}": 0 for x in "nt" for c in classes}
            here = seen.withColumns({**{f"{x}{c}": F.lit(row[f"{x}{c}"]) for x in "nt" for c in classes},
                                     **{f"p{c}": F.lit(1.0 / alphabet) for c in classes}})
        else:
            shorter = scored.select(F.col("gram").alias("_short"), *[F.col(f"p{c}") for c in classes])
            here = (seen.withColumns({"context": context(), "_short": F.substring("gram", 2, k)})
                    .join(totals, "context").join(shorter, "_short"))
        mix = {f"p{c}": F.when(F.col(f"n{c}") + F.col(f"t{c}") == 0, F.col(f"p{c}")).otherwise(
            (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))) for c in classes}
        scored = stored(here.withColumns(mix).select("gram", *mix))
    return scored.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def judged(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, score (mean log ratio) and verdict."""
    host, path = host_and_path(F.col(url))
    fit = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = pages.select(F.struct("*").alias("_page"), F.col(url).alias("_url"), host.alias("_host"), path.alias("_path"))
    rows = rows.withColumn("_held", F.substring(F.md5(F.coalesce(F.col("_url"), F.lit("")).cast("binary")), 1, 1) < HELD_OUT)
    rows = stored(rows.withColumns({"_rule": fit, "_row": F.monotonically_increasing_id()}))
    at = stored(rows.select("_row", F.when(~F.col("_held"), F.col("_rule.verdict")).alias("v"), F.explode(grams(F.col("_url"), order)).alias("gram")))
    counted = stored(at.groupBy("gram").agg(F.count(F.when(F.col("v") == "allow", 1)).alias("a"),
                                            F.count(F.when(F.col("v") == "block", 1)).alias("r")))
    ratios = gram_ratios(counted, order)
    scores = attach(at.select("_row", "gram"), ratios, "gram", F.col("_row")).groupBy("_row").agg(F.avg("ratio").alias("_score"))
    rows = stored(rows.join(scores, "_row"))
    s = {r["v"]: r for r in rows.where("_rule is not null").groupBy(F.col("_rule.verdict").alias("v")).agg(
        F.coalesce(F.avg(F.when(F.col("_held"), F.col("_score"))), F.avg("_score")).alias("mean"),
        F.coalesce(F.stddev_pop(F.when(F.col("_held"), F.col("_score"))), F.stddev_pop("_score")).alias("sd")).collect()}
    if len(s) == 2:
        a, r = s["allow"], s["block"]
        spread = a["sd"] + r["sd"]
        limit = (a["mean"] * r["sd"] + r["mean"] * a["sd"]) / spread if spread else (a["mean"] + r["mean"]) / 2
        own = F.when(F.col("_score") >= limit, "allow").otherwise("block")
    else:
        own = F.lit("allow")
    kept = [F.col("_page")[c].alias(c) for c in pages.columns if c.lower() not in RESULT]
    return rows.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
                       F.col("_score").alias("score"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> str:
    """The same judgement as SQL over table ``pages``."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for v, h, p in longest]
    case = lambda n: "case " + " ".join(f"when {f[2]} then '{f[n]}'" for f in fits) + " end"
    edge = f"chr({ord(EDGE)})"
    levels = []
    for k in range(order + 1):
        shorter = "1.0::double / (select count(*) from s0)" if k == 0 else "q.p{c}"
        mix = ", ".join(f"case when t.n{c} + t.t{c} = 0 then {shorter.format(c=c)} else "
                        f"(s.{c} + t.t{c} * {shorter.format(c=c)}) / (t.n{c} + t.t{c}) end as p{c}" for c in "ar")
        levels += [
            f"s{k} as (select substr(gram, {order + 1 - k}, {k + 1}) as gram, sum(a) as a, sum(r) as r from counted group by 1)",
            f"t{k} as (select substr(gram, 1, {k}) as context, sum(a) as na, sum(r) as nr, count(*) filter (a > 0) as ta,"
            f" count(*) filter (r > 0) as tr from s{k} group by 1)",
            f"p{k} as (select s.gram, {mix} from s{k} s join t{k} t on substr(s.gram, 1, {k}) = t.context"
            + (f" join p{k - 1} q on substr(s.gram, 2, {k}) = q.gram)" if k else ")")]
    return f"""
with cut as (select row_number() over () as n, page_id, coalesce(url, '') as url,
    case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select *, regexp_extract(rest, '^[^/?#]*') as h from cut),
rows_ as (select n, page_id, url, translate(h, '{upper}', '{low}') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from parts),
ruled as (select *, {case(1)} as rule, {case(0)} as v, substr(md5(url), 1, 1) < '{HELD_OUT}' as held from rows_),
padded as (select n, case when not held then v end as v, repeat({edge}, {order}) || lower(url) || {edge} as t from ruled),
at_ as (select n, v, substr(t, i, {order + 1}) as gram from (select *, unnest(range(1, length(t) - {order} + 1)) as i from padded)),
counted as (select gram, count(*) filter (v = 'allow') as a, count(*) filter (v = 'block') as r from at_ group by 1),
{', '.join(levels)},
scored as (select n, avg(ln(pa) - ln(pr)) as score from at_ join p{order} using (gram) group by 1),
both_ as (select * from ruled join scored using (n)),
side as (select coalesce(avg(score) filter (v = 'allow' and held), avg(score) filter (v = 'allow')) as ma,
    coalesce(avg(score) filter (v = 'block' and held), avg(score) filter (v = 'block')) as mr,
    coalesce(stddev_pop(score) filter (v = 'allow' and held), stddev_pop(score) filter (v = 'allow')) as sa,
    coalesce(stddev_pop(score) filter (v = 'block' and held), stddev_pop(score) filter (v = 'block')) as sr from both_),
bound as (select case when ma is null or mr is null then null when sa + sr = 0 then (ma + mr) / 2
    else (ma * sr + mr * sa) / (sa + sr) end as limit_ from side)
select page_id, host, path, rule, coalesce(v, case when limit_ is null or score >= limit_ then 'allow' else 'block' end) as verdict
from both_, bound
"""
