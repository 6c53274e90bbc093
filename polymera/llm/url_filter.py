"""URL filters: prefix rules by host and path, then a weighted vocabulary by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules as (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: One of these whole terms in a url rejects it.
STRICT = (
    "adult", "casino", "cialis", "cracked", "darknet", "escort", "hentai", "keygen", "malware", "nsfw",
    "phishing", "pills", "poker", "porn", "porno", "pornhub", "roulette", "spam", "spyware", "torrent",
    "viagra", "warez", "webcamsex", "xnxx", "xvideos", "xxx",
)
#: Terms that reject a url when at least SOFT_HITS different ones occur.
SOFT = (
    "ads", "affiliate", "banner", "bet", "bonus", "buy", "cheap", "click", "clickbait", "coupon", "crack",
    "dating", "deal", "discount", "download", "earn", "farm", "free", "gamble", "girls", "hack", "hot",
    "jackpot", "loan", "lottery", "mature", "offer", "popup", "prize", "promo", "redirect", "sale", "sex",
    "slots", "sponsored", "track", "utm", "win",
)
SOFT_HITS = 2

_automata: dict[tuple, object] = {}


def automaton(strict: Sequence[str], soft: Sequence[str]):
    """The Aho-Corasick automaton of both lists, made once a process; a term in both is strict."""
    key = (tuple(strict), tuple(soft))
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):
            for t in terms:
                if t:
                    made.add_word(t.lower(), (t.lower(), weight))
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def hits(url: str, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> tuple[int, int]:
    """Different strict and soft terms of a url that stand between characters other than a-z and 0-9."""
    found: dict[str, int] = {}
    url = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    inside = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
    made = automaton(strict, soft)
    for end, (term, weight) in made.iter(url) if len(made) else ():
        start = end - len(term)
        if not (start >= 0 and inside(url[start])) and not (end + 1 < len(url) and inside(url[end + 1])):
            found[term] = weight
    values = list(found.values())
    return values.count(2), values.count(1)


def filter_urls(pages: DataFrame, url: str = "url", keep: Sequence[str] | None = None, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Append host, path, rule, strict_hits, soft_hits and verdict to every url.

    The longest rule that fits the host (or a parent domain) and begins the path decides; with no rule,
    a url is blocked on one strict term or soft_hits different soft terms, else allowed. Null urls and
    urls without "://" have an empty host and path, match no rule and are judged by their terms; ties
    between rules of one length go to the earlier; repeated rows are judged each; input columns named
    like the new ones give way.
    """
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    names = ["host", "path", "rule", "strict_hits", "soft_hits", "verdict"]
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in names]
    after = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    base = pages.select(*[F.col(f"`{c}`") for c in kept], u.alias("__u"), after.alias("__a"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = base.withColumn("__h", F.regexp_extract("__a", "(?s)^[^/?#]*", 0))
    base = base.withColumn("__p", F.regexp_extract(F.expr("substr(__a, length(__h) + 1)"), "(?s)^[^?#]*", 0)).withColumn("__h", F.translate("__h", upper, lower))
    rule = verdict = F.lit(None).cast("string")
    for say, host, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last to fit wins: the longest, of these the earliest
        fits = ((F.col("__h") == host) | F.col("__h").endswith(f".{host}")) & F.col("__p").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(host + prefix)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    base = base.select(*[F.col(f"`{c}`") for c in kept], F.col("__h").alias("host"), F.col("__p").alias("path"), rule.alias("rule"), verdict.alias("__v"), "__u")
    schema = T.StructType([base.schema[i] for i in range(len(kept) + 3)] + [T.StructField("strict_hits", T.IntegerType()), T.StructField("soft_hits", T.IntegerType()), T.StructField("verdict", T.StringType())])
    width = len(kept) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hits(x or "", strict, soft) for x in batch.column(width + 1).to_pylist()]
            said = [v or ("block" if s or w >= soft_hits else "allow") for v, (s, w) in zip(batch.column(width).to_pylist(), found)]
            new = [pa.array([s for s, _ in found], pa.int32()), pa.array([w for _, w in found], pa.int32()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=schema.names)

    return base.mapInArrow(run, schema)
