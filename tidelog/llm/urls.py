"""URL filters: rules by host and path, then a logistic regression on hashed character n-grams.

The main path has DataFrame functions only.  Weights are integers, so that sums do
not depend on their order.  The model is fitted on the labelled URLs below, a fixed
table, with the same hash (the first 28 bits of MD5) as the queries use.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets
the verdict of the model's intercept.  A row whose page_id is null is judged like any
other, repeated rows one by one.  A very long url is judged whole, in time in proportion
to its length.  Extra columns, whatever their names, are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, N_GRAM, SCALE = 4096, 4, 10_000
EPOCHS, RATE, DECAY = 300, 0.5, 1e-4
# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# Labelled hosts and paths: block (1) gambling, pills, loans, trackers, adult offers and downloads; allow (0) the rest.
LABELLED = (
    (1, "casino-win.example.com", "/en/4033.html"),
    (1, "www.casino-win.example.net", "/bonus/77"),
    (1, "m.casino-royal.example.org", "/slots/12"),
    (1, "best-casino.example.com", "/play"),
    (1, "free-bets.example.com", "/en/5462"),
    (1, "www.free-bets.example.org", "/odds/9"),
    (1, "sports-bets.example.net", "/live/33"),
    (1, "poker-bonus.example.com", "/join"),
    (1, "cheap-pills.example.com", "/de/6652.html"),
    (1, "www.cheap-pills.example.net", "/order/1"),
    (1, "pills-online.example.org", "/buy"),
    (1, "m.cheap-meds.example.com", "/cart/5"),
    (1, "ads-track.example.com", "/en/9823"),
    (1, "m.ads-track.example.net", "/pixel/4"),
    (1, "click-ads.example.org", "/go/81"),
    (1, "adserver-track.example.com", "/banner/7"),
    (1, "fast-loans.example.com", "/apply"),
    (1, "payday-loans.example.net", "/en/12"),
    (1, "xxx-video.example.com", "/watch/3"),
    (1, "free-xxx.example.org", "/cams"),
    (1, "win-prize.example.com", "/claim/2"),
    (1, "crack-download.example.net", "/keygen/8"),
    (1, "blog.example.com", "/casino/win-big"),
    (1, "www.example.net", "/cheap-pills/offer"),
    (0, "tiontion.example.net", "/en/7817"),
    (0, "therhe.example.org", "/en/8423"),
    (0, "ththan.example.com", "/en/7944"),
    (0, "m.ththha.example.net", "/en/1570"),
    (0, "www.ththst.example.com", "/en/1837/"),
    (0, "ththble.example.com", "/fr/7376"),
    (0, "therst.example.net", "/fr/4163"),
    (0, "blog.tionsh.example.com", "/fr/7424.html"),
    (0, "www.thering.example.org", "/en/1291/"),
    (0, "m.ththes.example.org", "/en/873"),
    (0, "blog.theror.example.com", "/de/1373"),
    (0, "m.theron.example.net", "/de/5989"),
    (0, "tionble.example.org", "/en/482/"),
    (0, "news.example.com", "/2024/05/report"),
    (0, "www.library.example.org", "/catalogue/118"),
    (0, "docs.example.net", "/guide/start.html"),
    (0, "wiki.example.org", "/page/History"),
    (0, "www.university.example.com", "/courses/math"),
    (0, "m.museum.example.net", "/exhibits/9"),
    (0, "weather.example.com", "/de/4471"),
    (0, "blog.garden.example.org", "/es/302"),
    (0, "recipes.example.net", "/fr/66/"),
    (0, "www.school.example.com", "/es/5120"),
    (0, "science.example.org", "/en/9012.html"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of one url; what ``host_and_path`` does for a column."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def grams(host: str, path: str, n: int = N_GRAM) -> list[str]:
    """The character n-grams of ^host|path$."""
    text = f"^{host}|{path}$"
    return [text[k : k + n] for k in range(max(1, len(text) - n + 1))]


def bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % BUCKETS


@cache
def fit() -> tuple[tuple[int, ...], int]:
    """(weights by bucket, intercept), as integers of SCALE, by gradient descent with weight decay."""
    rows = [(y, [bucket(g) for g in grams(host, path)]) for y, host, path in LABELLED]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(EPOCHS):
        for y, found in rows:
            z = b + sum(w[k] for k in found) / len(found) * 10
            step = RATE * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            b += step / 10
            for k in found:
                w[k] += step * 10 / len(found) - DECAY * w[k]
    return tuple(round(x * 10 * SCALE) for x in w), round(b * SCALE)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def gram_column(text: Column) -> Column:
    """The character n-grams of a text, or the text itself if it is shorter.

    They are put together from the text's characters and those 1, 2 ... places on, as cutting each
    one out of the text by its place would read the text from its start every time.
    """
    characters = F.filter(F.split(text, "", -1), lambda c: c != "")
    joined = characters
    for k in range(1, N_GRAM):
        joined = F.zip_with(joined, F.slice(characters, k + 1, F.greatest(F.size(characters), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) < N_GRAM, F.array(text)).otherwise(F.filter(joined, lambda g: g.isNotNull()))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's log-odds of a block) for every row of pages.

    Of the rules that fit, the one with the longest host and path wins.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = decided = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(rule_path)
        rule, decided = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    weights, intercept = fit()
    table = F.from_json(F.lit(str(list(weights))), "array<bigint>")
    text = F.concat(F.lit("^"), "host", F.lit("|"), "path", F.lit("$"))
    found = F.transform(F.col("grams"), lambda g: F.md5(F.encode(g, "UTF-8")))
    scores = F.transform(found, lambda h: F.element_at(F.col("weights"), (F.conv(F.substring(h, 1, 7), 16, 10).cast("int") % BUCKETS) + 1))
    total = F.aggregate(scores, F.lit(0).cast("bigint"), lambda a, x: a + x)
    mean = F.expr("total div size") + F.lit(intercept)
    rows = rows.withColumn("grams", gram_column(text)).withColumn("weights", table).select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), total.alias("total"), F.size("grams").cast("bigint").alias("size"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(mean > 0, "block").otherwise("allow")).alias("verdict"), mean.alias("score"))


def judge_sql() -> str:
    """The same in DuckDB SQL."""
    weights, intercept = fit()
    fits, verdicts = [], []
    for verdict, host, path in sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        test = f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}') THEN "
        fits.append(f"{test}'{host}{path}'")
        verdicts.append(f"{test}'{verdict}'")
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""
WITH cut AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
texts AS (SELECT *, '^' || host || '|' || path || '$' AS text FROM parts),
model AS (SELECT {list(weights)}::BIGINT[] AS weights),
scored AS (
  SELECT page_id, host, path, greatest(length(text) - {N_GRAM - 1}, 1)::BIGINT AS size,
         list_sum(list_transform(range(1, greatest(length(text) - {N_GRAM - 1}, 1) + 1),
           lambda k: weights[(('0x' || substr(md5(substr(text, k, {N_GRAM})), 1, 7))::BIGINT % {BUCKETS} + 1)::BIGINT]))::BIGINT AS total
  FROM texts, model)
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
       coalesce(CASE {' '.join(verdicts)} END, CASE WHEN total // size + {intercept} > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       total // size + {intercept} AS score
FROM scored"""
